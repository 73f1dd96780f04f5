"""Toxicity scores by FTRL-proximal logistic regression over hashed n-grams and skip-grams.

Training reads a bounded, seeded sample of labelled rows; FTRL-proximal (per-coordinate
rates, L1) leaves few weights, which are sent to all executors as two short arrays.
Scoring reads every whole text once, without a shuffle.

Features are the distinct hashes of words, adjacent pairs, and pairs that skip one word or
two.  The settings (SETTINGS) are those that ``tune_toxicity`` chose by cross-validation
inside the training part; neither training nor that choice reads a held-out label.

Defined results: null and empty texts get the score of the bias alone; texts of any length
are scored whole; a score of exactly THRESHOLD is predicted 1; a repeated label counts as
its maximum, null labels are ignored; a row that is repeated counts once in training and
is scored as often as it occurs; without labelled rows of both classes every score is the
share of positive labels (0.5 without any); rows are independent and further columns are
ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Bounds of the training sample: labelled rows, and the length of a text to be among them.
SAMPLE_ROWS = 10_000
SAMPLE_CHARS = 20_000
BITS = 22
THRESHOLD = 0.7
_CACHE_WORDS = 200_000
_WORD = re.compile(r"[^\W_]+(?:'[^\W_]+)*")
_SEED = 11
_ODD = np.uint64(0x9E3779B97F4A7C15)
#: One odd number for each distance of a pair's words.
_GAPS = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


@dataclass(frozen=True)
class Settings:
    """Passes over the sample, the rate's numerator, the penalties, and what a positive example weighs."""

    epochs: int = 12
    alpha: float = 16.0
    l1: float = 32.0
    l2: float = 0.0
    positive: float = 8.0


SETTINGS = Settings()


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > _CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"), _SEED)
        return value


_hashes = _Hashes()


def features(text: str) -> np.ndarray:
    """Hashed words, pairs and skip-pairs of a text, repeats included, below 2 ** BITS."""
    words = _WORD.findall(text.lower())
    h = np.fromiter(map(_hashes.__getitem__, words), dtype=np.uint64, count=len(words))
    pairs = [(h[: -k - 1] * odd) ^ (h[k + 1 :] + odd) for k, odd in enumerate(_GAPS)]
    mixed = np.concatenate([h, *pairs]) * _ODD
    return (mixed >> np.uint64(64 - BITS)).astype(np.int32)


@dataclass(frozen=True)
class Model:
    """Sparse weights: sorted feature numbers, their weights, and the bias."""

    index: np.ndarray
    weight: np.ndarray
    bias: float


def train(rows: list[tuple[str, int]], settings: Settings = SETTINGS) -> Model:
    return fit([(np.unique(features(t)), y) for t, y in rows], settings)


def fit(examples: list[tuple[np.ndarray, int]], settings: Settings) -> Model:
    """FTRL-proximal over (feature numbers, label), one example a step in a fixed shuffled order; the bias has no L1."""
    positive = sum(y for _, y in examples)
    if not examples or positive in (0, len(examples)):
        share = min(max(positive / len(examples), 1e-6), 1 - 1e-6) if examples else 0.5
        return Model(np.zeros(0, dtype=np.int64), np.zeros(0), float(np.log(share / (1 - share))))
    bias = 1 << BITS  # the last feature
    places = [np.append(i, np.int32(bias)) for i, _ in examples]
    z, n = np.zeros(bias + 1), np.zeros(bias + 1)  # 64 MB, whatever the sample
    rng, s = np.random.default_rng(_SEED), settings

    def weights(zi: np.ndarray, ni: np.ndarray) -> np.ndarray:
        """Of features whose last is the bias."""
        over = np.abs(zi) - s.l1
        over[-1] = abs(zi[-1])
        return np.where(over > 0, -np.sign(zi) * over / ((1.0 + np.sqrt(ni)) / s.alpha + s.l2), 0.0)

    for _ in range(s.epochs):
        for k in rng.permutation(len(examples)):
            i, y = places[k], examples[k][1]
            zi, ni = z[i], n[i]
            w = weights(zi, ni)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y
            g *= s.positive if y else 1.0
            z[i] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / s.alpha * w
            n[i] = ni + g * g
    w = weights(z, n)
    kept = np.flatnonzero(w[:-1])
    return Model(kept, w[kept], float(w[-1]))


def sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> list[tuple[str, int]]:
    """At most SAMPLE_ROWS labelled rows outside the held-out part, chosen by a hash of their id."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).cast("int").alias("_y"))
    known = known.where(~common.held_out(id_col))
    chosen = known.orderBy(F.xxhash64(F.col(id_col), F.lit(_SEED)), id_col).limit(SAMPLE_ROWS)
    texts = docs.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias("_t")).where(F.length("_t") <= SAMPLE_CHARS)
    # an id with several texts gives its least one, so rows are bounded by ids before they leave the executors
    found = texts.join(F.broadcast(chosen), id_col).groupBy(id_col).agg(F.min("_t").alias("_t"), F.max("_y").alias("_y")).toPandas()
    found = found.sort_values(id_col, kind="stable")
    return list(zip(found["_t"], (found["_y"] > 0).astype(int), strict=True))


def probability(model: Model, found: np.ndarray) -> float:
    """Of a text by its distinct features."""
    at = np.searchsorted(model.index, found)
    there = at < len(model.index)
    at = at[there][model.index[at[there]] == found[there]]
    return float(1 / (1 + np.exp(-np.clip(model.bias + model.weight[at].sum(), -500, 500))))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, held_out, score, predicted."""
    spark = docs.sparkSession
    common.ship(spark)
    sent = spark.sparkContext.broadcast((model.index, model.weight, model.bias))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, weight, bias = sent.value
        used = np.zeros(1 << BITS, dtype=bool)
        used[index] = True
        for batch in batches:
            kept = batch.schema.field(0).type
            for keys, texts in common.text_blocks(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                out = np.empty(len(texts))
                for k, text in enumerate(texts):
                    f = features(text)
                    f = np.unique(f[used[f]])
                    out[k] = bias + weight[np.searchsorted(index, f)].sum()
                out = 1 / (1 + np.exp(-np.clip(out, -500, 500)))
                yield pa.RecordBatch.from_arrays([pa.array(keys, kept), pa.array(out)], names=[id_col, "score"])

    scored = docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, score double")
    return scored.select(id_col, common.held_out(id_col).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """Train on the labelled sample and score all documents."""
    return score(docs, train(sample(docs, labels, id_col, text_col, label_col)), id_col, text_col)
