"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads the UTF-8 bytes of a whole lower-cased text, forwards and backwards, and
gives every byte position a distribution over the languages; a document's distribution is
the mean over all its positions.  Texts longer than a window are read in windows of WINDOW
labelled positions that begin and end CONTEXT bytes earlier and later, so the state has
read at least that much of both sides before it labels a position.  All windows of a block
of texts go through the network together, a byte a step.  It is trained in numpy by
backpropagation through time with Adam.

``fit`` trains on pieces of a bounded sample.  ``fit_with_limit`` only starts so: then every
byte of every text of the training part goes through backpropagation, in shards of about
SHARD_BYTES that are trained side by side and averaged by their bytes; each language weighs
the same, by its bytes in all texts.  A shard's rows and their order follow from the rows'
hashes, not from how the table is stored; a repeated row is one there.  A fifth of the training
part, by the texts' CRC, is for validation alone, and ``limit`` is LEAST of the lowest
pooled probability that a rightly labelled text among all of those has; a language of
validation texts alone is not learned.

Defined results: a null text or one without a letter is ``und`` with score 0, as is every
text if there are no labelled rows; a text of any length is read whole; ties go to the
first language in alphabetical order; rows are independent, so repeated rows get equal
results; further columns are ignored, whatever their names (``accept`` keeps them); an
empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Bounds of the training sample: expected rows of each language, and the length of a text among them.
SAMPLE_ROWS = 400
SAMPLE_CHARS = 20_000
#: Training pieces of each language, and their length in bytes.
PIECES = 6_000
PIECE_BYTES = 64
HIDDEN = 8
WINDOW = 448
CONTEXT = 32
#: Windows that go through the network together.
ROWS = 1024
#: Texts whose pooled probability is below this share of the least that validation texts have are rejected.
LEAST = 0.9
#: Bytes of training texts that one task learns after the other, expected; pieces of a step there, and its first rate.
SHARD_BYTES = 4 << 20
STEP_PIECES = 256
RATE = 0.005
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")
_SEED = 7


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def spelled(text: str) -> bytes:
    """What the network reads."""
    return text.lower().encode("utf-8", "surrogatepass")


def pack(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(the pieces' bytes, padded by 0; their lengths)."""
    size = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
    wide = int(size.max()) if len(size) else 0
    flat = np.frombuffer(b"".join(p.ljust(wide, b"\0") for p in pieces), dtype=np.uint8)
    return flat.reshape(len(pieces), wide), size


class Network:
    """Parameters, forward pass and gradients."""

    def __init__(self, params: dict[str, np.ndarray]):
        self.p = params

    @classmethod
    def fresh(cls, classes: int, hidden: int = HIDDEN) -> Network:
        rng = np.random.default_rng(_SEED)
        p = {}
        for d in "fb":
            p[f"x{d}"] = rng.normal(0, 0.3, (256, 3 * hidden))
            p[f"h{d}"] = rng.normal(0, 1 / np.sqrt(hidden), (hidden, 3 * hidden))
        p["o"] = rng.normal(0, 0.3, (2 * hidden, classes))
        p["c"] = np.zeros(classes)
        return cls({k: v.astype(np.float32) for k, v in p.items()})

    def _run(self, x: np.ndarray, size: np.ndarray, d: str, keep: bool) -> tuple[np.ndarray, list]:
        """States after each byte, in reading order of direction d; a padded step keeps the state."""
        wx, wh = self.p[f"x{d}"], self.p[f"h{d}"]
        n = wh.shape[0]
        rows, wide = x.shape
        state = np.zeros((rows, n), dtype=wx.dtype)
        out, tape = np.zeros((wide, rows, n), dtype=wx.dtype), []
        for t in range(wide) if d == "f" else range(wide - 1, -1, -1):
            live = (t < size)[:, None]
            a = wx.take(x[:, t], axis=0)
            b = state @ wh
            zr = _sigmoid(a[:, : 2 * n] + b[:, : 2 * n])
            z, r = zr[:, :n], zr[:, n:]
            g = np.tanh(a[:, 2 * n :] + r * b[:, 2 * n :])
            new = np.where(live, state + z * (g - state), state)
            if keep:
                tape.append((t, state, z, r, g, b[:, 2 * n :], live))
            state = new
            out[t] = state
        return out, tape

    def positions(self, x: np.ndarray, size: np.ndarray) -> np.ndarray:
        """(positions, rows, classes) probabilities."""
        h = np.concatenate([self._run(x, size, "f", False)[0], self._run(x, size, "b", False)[0]], axis=2)
        return self._soft(h)

    def _soft(self, h: np.ndarray) -> np.ndarray:
        y = h @ self.p["o"] + self.p["c"]
        y = np.exp(y - y.max(axis=2, keepdims=True))
        return y / y.sum(axis=2, keepdims=True)

    def gradients(self, x: np.ndarray, size: np.ndarray, label: np.ndarray, weight: np.ndarray | None = None) -> dict[str, np.ndarray]:
        """Of the mean cross entropy of all positions, each with its row's weight, by backpropagation through time."""
        runs = {d: self._run(x, size, d, True) for d in "fb"}
        h = np.concatenate([runs["f"][0], runs["b"][0]], axis=2)
        y = self._soft(h)
        y[:, np.arange(len(label)), label] -= 1
        live = (np.arange(x.shape[1])[:, None] < size)[:, :, None]
        if weight is None:
            dy = (y * live / size.sum()).astype(self.p["o"].dtype)
        else:
            dy = (y * live * (weight / (size * weight).sum())[:, None]).astype(self.p["o"].dtype)
        grads = {"o": np.tensordot(h, dy, axes=((0, 1), (0, 1))), "c": dy.sum(axis=(0, 1))}
        dh = dy @ self.p["o"].T
        n = dh.shape[2] // 2
        for d, part in (("f", dh[:, :, :n]), ("b", dh[:, :, n:])):
            wh = self.p[f"h{d}"]
            gh = np.zeros_like(wh)
            into = np.zeros((x.shape[1], len(label), 3 * n), dtype=wh.dtype)
            carry = np.zeros((len(label), n), dtype=wh.dtype)
            for t, state, z, r, g, bg, ok in reversed(runs[d][1]):
                total = part[t] + carry
                on = total * ok
                dg = on * z * (1 - g * g)
                dz = on * (g - state) * z * (1 - z)
                dr = dg * bg * r * (1 - r)
                into[t] = np.concatenate([dz, dr, dg], axis=1)
                db = np.concatenate([dz, dr, dg * r], axis=1)
                gh += state.T @ db
                carry = total * ~ok + on * (1 - z) + db @ wh.T
            # rows of one byte value lie together and are summed in one go
            at = x.T.reshape(-1)
            order = np.argsort(at, kind="stable")
            value, first = np.unique(at[order], return_index=True)
            gx = np.zeros_like(self.p[f"x{d}"])
            gx[value] = np.add.reduceat(into.reshape(-1, 3 * n)[order], first, axis=0)
            grads[f"x{d}"], grads[f"h{d}"] = gx, gh
        return grads


class Reader:
    """The network's forward pass over blocks of whole texts."""

    def __init__(self, langs: list[str], params: dict[str, np.ndarray]):
        self.langs = langs
        n = params["hf"].shape[0]
        half = np.float32(0.5)
        gate = lambda w, k: np.ascontiguousarray(w[:, k * n : (k + 1) * n], dtype=np.float32)
        # a gate's sigmoid is (1 + tanh(x / 2)) / 2: the inner half stands in the tables, and so does what r halves
        self.sides = [
            [gate(params[f"x{d}"], 0) * half, gate(params[f"x{d}"], 1) * half, gate(params[f"x{d}"], 2), gate(params[f"h{d}"], 0) * half, gate(params[f"h{d}"], 1) * half, gate(params[f"h{d}"], 2) * half, np.ascontiguousarray(o, dtype=np.float32)]
            for d, o in (("f", params["o"][:n]), ("b", params["o"][n:]))
        ]
        self.bias = params["c"].astype(np.float32)

    def _side(self, side: list[np.ndarray], x: np.ndarray, live: list[int]) -> np.ndarray:
        """(steps, rows, classes): one direction's share of the classes' scores; x is (steps, rows), longer rows first."""
        xz, xr, xg, hz, hr, hg, o = side
        one, half = np.float32(1), np.float32(0.5)
        state = np.zeros((x.shape[1], hz.shape[0]), dtype=np.float32)
        out = np.zeros((*x.shape, o.shape[1]), dtype=np.float32)
        for t, n in enumerate(live):
            s, b = state[:n], x[t, :n].astype(np.intp)
            r = s @ hr
            r += xr.take(b, axis=0)
            np.tanh(r, out=r)
            r += one
            r *= s @ hg
            r += xg.take(b, axis=0)
            np.tanh(r, out=r)
            z = s @ hz
            z += xz.take(b, axis=0)
            np.tanh(z, out=z)
            z += one
            z *= half
            r -= s
            r *= z
            s += r
            np.matmul(s, o, out=out[t, :n])
        return out

    def pooled(self, texts: list[bytes]) -> np.ndarray:
        """For each text the mean of its positions' distributions; zeros for an empty one."""
        size = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        flat = np.frombuffer(b"".join(texts), dtype=np.uint8)
        total = np.zeros((len(texts), len(self.bias)))
        if not len(flat):
            return total
        count = -(-size // WINDOW)
        text = np.repeat(np.arange(len(texts)), count)
        begin = (np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)) * WINDOW  # of the labelled part
        first, last = np.maximum(begin - CONTEXT, 0), np.minimum(begin + WINDOW + CONTEXT, size[text])
        start = (np.cumsum(size) - size)[text] + first
        order = np.argsort(first - last, kind="stable")  # the longest first
        for i in range(0, len(order), ROWS):
            part = order[i : i + ROWS]
            np.add.at(total, text[part], self._rows(flat, start[part], (last - first)[part], (begin - first)[part], (np.minimum(begin + WINDOW, last) - first)[part]))
        return total / np.maximum(size, 1)[:, None]

    def _rows(self, flat: np.ndarray, start: np.ndarray, long: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """For each window, the longest first, the sum of the distributions of its positions from ``begin`` to ``end``."""
        steps = int(long[0])
        live = np.searchsorted(-long, -np.arange(steps), side="left").tolist()  # windows longer than t
        t = np.arange(steps, dtype=np.int64)[:, None]
        back = long - 1 - t
        out = self._side(self.sides[1], flat.take(start + back, mode="clip"), live)
        # the other direction's step of each position
        out = out.reshape(-1, out.shape[2]).take(np.maximum(back, 0) * len(long) + np.arange(len(long)), axis=0)
        out += self._side(self.sides[0], flat.take(start + t, mode="clip"), live)
        out += self.bias
        np.exp(np.minimum(out, 80, out=out), out=out)
        whole = out @ np.ones((out.shape[2], 1), dtype=np.float32)
        # padding, and what was read for context alone, has no say
        out *= ((t >= begin) & (t < end))[:, :, None] / whole
        return out.sum(axis=0, dtype=np.float64)

    def label(self, texts: list[str]) -> list[tuple[str, float]]:
        """(language, its pooled probability) of each text."""
        says = [bool(self.langs and _LETTER.search(t)) for t in texts]
        pooled = self.pooled([spelled(t) for t, s in zip(texts, says, strict=True) if s])
        best = pooled.argmax(axis=1) if len(pooled) else []
        found = iter([(self.langs[k], float(min(p[k], 1.0))) for k, p in zip(best, pooled, strict=True)])
        return [next(found) if s else (UNKNOWN, 0.0) for s in says]


def pieces(texts: dict[str, list[str]]) -> tuple[list[bytes], np.ndarray]:
    """(PIECES pieces of each language's texts, drawn by length; the number of each one's language)."""
    rng = np.random.default_rng(_SEED)
    out, labels = [], []
    for k, lang in enumerate(sorted(texts)):
        data = [b for t in sorted(texts[lang]) if (b := spelled(t))]
        if not data:
            continue
        size = np.array([len(b) for b in data], dtype=float)
        for i in rng.choice(len(data), PIECES, p=size / size.sum()):
            at = int(rng.integers(0, max(1, len(data[i]) - PIECE_BYTES + 1)))
            out.append(data[i][at : at + PIECE_BYTES])
            labels.append(k)
    return out, np.array(labels)


def train(texts: dict[str, list[str]], hidden: int = HIDDEN, epochs: int = 2, batch: int = 128, rate: float = 0.02) -> tuple[list[str], Network]:
    """Train on each language's texts; (languages, network)."""
    langs = sorted(texts)
    data, labels = pieces(texts)
    net = Network.fresh(len(langs), hidden)
    rng = np.random.default_rng(_SEED)

    def batches() -> Iterator[tuple[np.ndarray, ...]]:
        for _ in range(epochs):
            order = rng.permutation(len(data))
            for i in range(0, len(order), batch):
                part = order[i : i + batch]
                yield *pack([data[k] for k in part]), labels[part]

    descend(net, batches(), epochs * (len(data) // batch + 1), rate)
    return langs, net


def descend(net: Network, batches: Iterator[tuple[np.ndarray, ...]], steps: int, rate: float) -> None:
    """Adam, a step for each batch (arguments of ``gradients``), with a rate that falls to nothing."""
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    v = {k: np.zeros_like(a) for k, a in net.p.items()}
    for step, batch in enumerate(batches, 1):
        for k, g in net.gradients(*batch).items():
            m[k] += 0.1 * (g - m[k])
            v[k] += 0.001 * (g * g - v[k])
            move = (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
            net.p[k] -= (rate * (1 - step / (steps + 1)) * move).astype(np.float32)


def cut(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every byte of the texts in pieces one after the other: (the pieces, padded by 0; their lengths; the number of each one's text)."""
    size = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    count = -(-size // PIECE_BYTES)
    text = np.repeat(np.arange(len(texts)), count)
    place = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    flat = np.frombuffer(b"".join(t.ljust(n * PIECE_BYTES, b"\0") for t, n in zip(texts, count.tolist(), strict=True)), dtype=np.uint8)
    return flat.reshape(-1, PIECE_BYTES), np.minimum(size[text] - place * PIECE_BYTES, PIECE_BYTES), text


def refine(net: Network, texts: list[bytes], labels: list[int], weight: np.ndarray) -> None:
    """Train ``net`` on every byte of the texts once; ``weight`` has one number for each language."""
    x, size, text = cut(texts)
    label = np.array(labels, dtype=np.int64)[text]
    order = np.random.default_rng(_SEED).permutation(len(x))
    parts = [order[i : i + STEP_PIECES] for i in range(0, len(order), STEP_PIECES)]
    descend(net, ((x[p], size[p], label[p], weight[label[p]]) for p in parts), len(parts), RATE)


def sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> dict[str, list[str]]:
    """The texts of about SAMPLE_ROWS rows of each language outside the held-out part."""
    rows = docs.select(F.col(id_col).alias("_i"), F.col(text_col).alias("_t"), F.col(lang_col).alias("_l"))
    rows = rows.where(F.col("_l").isNotNull() & F.col("_t").isNotNull() & ~common.held_out("_i"))
    rows = rows.where(F.col("_i").isNotNull() & (F.length("_t") <= SAMPLE_CHARS))
    sizes = {r["_l"]: r["n"] for r in rows.groupBy("_l").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return {}
    # a uniform number from the row decides; each language has its own share
    u = F.pmod(F.xxhash64(F.col("_i"), F.col("_t"), F.lit(_SEED)), F.lit(1_000_000)) / 1_000_000
    share = F.element_at(F.create_map(*(F.lit(x) for lang, n in sorted(sizes.items()) for x in (lang, min(1.0, SAMPLE_ROWS / n)))), F.col("_l"))
    chosen = rows.withColumn("_u", u).where(F.col("_u") < share).distinct()  # a row repeated without end is one
    chosen = chosen.orderBy("_u", "_i", "_l").limit(4 * SAMPLE_ROWS * len(sizes))
    out: dict[str, list[str]] = {lang: [] for lang in sizes}
    for r in chosen.select("_t", "_l").toPandas().itertuples(index=False):
        if _LETTER.search(r[0]):
            out[r[1]].append(r[0])
    return {lang: ts for lang, ts in out.items() if ts}


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], Network]:
    """(languages, network), learned from rows outside the held-out part."""
    texts = sample(docs, id_col, text_col, lang_col)
    return train(texts) if texts else ([], Network.fresh(1))


def fit_with_limit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], Network, float]:
    """(languages, network, limit of the pooled probability), learned from all rows outside the held-out part."""
    rows = docs.select(F.col(id_col).alias("_i"), F.col(text_col).alias("_t"), F.col(lang_col).alias("_l"))
    rows = rows.where(F.col("_l").isNotNull() & F.col("_t").isNotNull() & F.col("_i").isNotNull() & ~common.held_out("_i"))
    aside = F.crc32(F.col("_t").cast("binary")) % 5 == 0
    seen = rows.where(~aside).withColumn("_h", F.xxhash64("_i", "_t", "_l"))
    sizes = spelled_bytes(seen)
    if not sizes:
        return [], Network.fresh(1), 0.0
    start = sample(seen.withColumn("_t", F.substring("_t", 1, SAMPLE_CHARS)), "_i", "_t", "_l")
    langs, net = train({lang: start.get(lang, []) for lang in sizes})
    net = train_on_all(seen, langs, net, sizes)
    return langs, net, LEAST * least_right(rows.where(aside), langs, net)


def spelled_bytes(rows: DataFrame) -> dict[str, int]:
    """The bytes that the network reads of each language's distinct rows (_h, _t, _l); texts without a letter have no say."""
    common.ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = [len(spelled(t)) if _LETTER.search(t) else None for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(size, pa.int64())], names=["_h", "_l", "n"])

    found = rows.select("_h", "_t", "_l").mapInArrow(run, "_h long, _l string, n long").where("n is not null").distinct()
    return {r["_l"]: r["n"] for r in found.groupBy("_l").agg(F.sum("n").alias("n")).collect()}


def train_on_all(rows: DataFrame, langs: list[str], net: Network, sizes: dict[str, int]) -> Network:
    """``net`` trained on every text of ``rows`` (_h, _t, _l): the mean, by bytes, of what it becomes in each shard."""
    spark = rows.sparkSession
    common.ship(spark)
    total = sum(sizes.values())
    weight = np.array([total / (len(langs) * sizes[lang]) for lang in langs])
    names, shard_bytes = sorted(net.p), SHARD_BYTES
    sent = spark.sparkContext.broadcast((langs, net.p, weight))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, params, weight = sent.value
        own = Network({k: v.copy() for k, v in params.items()})
        number = {lang: k for k, lang in enumerate(langs)}
        texts, labels, held, done, last = [], [], 0, 0, None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row == last or not _LETTER.search(row[1]):
                    continue
                last = row
                texts.append(spelled(row[1]))
                labels.append(number[row[2]])
                held += len(texts[-1])
                if held > 4 * shard_bytes:  # long texts can make a shard much larger than others
                    refine(own, texts, labels, weight)
                    texts, labels, held, done = [], [], 0, done + held
        if held:
            refine(own, texts, labels, weight)
        if done + held:
            flat = b"".join(own.p[k].tobytes() for k in names)
            yield pa.RecordBatch.from_arrays([pa.array([flat], pa.binary()), pa.array([done + held], pa.int64())], names=["params", "n"])

    def mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, count = 0.0, 0
        for batch in batches:
            for flat, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                whole, count = whole + np.frombuffer(flat, dtype=np.float32).astype(float) * n, count + n
        if count:
            yield pa.RecordBatch.from_arrays([pa.array([(whole / count).tobytes()], pa.binary())], names=["params"])

    dealt = rows.select("_h", "_t", "_l").repartition(-(-total // SHARD_BYTES), "_h").sortWithinPartitions("_h", "_t", "_l")
    shards = dealt.mapInArrow(run, "params binary, n long").repartition(1).sortWithinPartitions("params")  # one order of summation
    found = np.frombuffer(shards.mapInArrow(mean, "params binary").collect()[0][0])
    ends = np.cumsum([net.p[k].size for k in names])
    return Network({k: part.reshape(net.p[k].shape).astype(np.float32) for k, part in zip(names, np.split(found, ends[:-1]), strict=True)})


def least_right(rows: DataFrame, langs: list[str], net: Network) -> float:
    """The lowest pooled probability of a rightly labelled text of ``rows`` (_t, _l); 0 if there is none."""
    spark = rows.sparkSession
    common.ship(spark)
    sent = spark.sparkContext.broadcast((langs, net.p))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _reader(*sent.value)
        for batch in batches:
            found = _labelled(own, batch.column(0).to_pylist())
            right = [score for (got, score), lang in zip(found, batch.column(1).to_pylist(), strict=True) if got == lang != UNKNOWN]
            yield pa.RecordBatch.from_arrays([pa.array([min(right, default=None)], pa.float64())], names=["least"])

    least = rows.select("_t", "_l").mapInArrow(run, "least double").agg(F.min("least")).collect()[0][0]
    return 0.0 if least is None else least


def _reader(langs: list[str], params: dict[str, np.ndarray]) -> Reader:
    key = b"".join(params[k].tobytes() for k in sorted(params)) + repr(langs).encode()
    return common.resident(("langid", key), lambda: Reader(langs, params))


def _labelled(own: Reader, texts: list) -> list[tuple[str, float]]:
    out: list[tuple[str, float]] = []
    for _, block in common.text_blocks([None] * len(texts), texts):
        out += own.label(block)
    return out


def predict(docs: DataFrame, langs: list[str], net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, lang_pred and score."""
    spark = docs.sparkSession
    common.ship(spark)
    sent = spark.sparkContext.broadcast((langs, net.p))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _reader(*sent.value)
        for batch in batches:
            found = _labelled(own, batch.column(1).to_pylist())
            columns = [batch.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([y for _, y in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[id_col, "lang_pred", "score"])

    return docs.select(id_col, F.col(text_col).alias("_text")).mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, lang_pred string, score double")


def accept(docs: DataFrame, langs: list[str], net: Network, text_col: str = "text", limit: float = 0.0, lang_col: str | None = None) -> DataFrame:
    """The rows, all columns, that have a language: not ``und``, and a pooled probability of ``limit`` at least.

    ``lang_col`` names a column that then holds the predicted language.  If no language was
    learned, nothing is rejected; with one language, all that has a letter stays.
    """
    if not langs:
        return docs
    spark = docs.sparkSession
    common.ship(spark)
    sent = spark.sparkContext.broadcast((langs, net.p))
    at = docs.columns.index(text_col)
    to = docs.columns.index(lang_col) if lang_col in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _reader(*sent.value)
        for batch in batches:
            found = _labelled(own, batch.column(at).to_pylist())
            columns = list(batch.columns)
            if to is not None:
                columns[to] = pa.array([lang for lang, _ in found], columns[to].type)
            out = pa.RecordBatch.from_arrays(columns, schema=batch.schema)
            yield out.filter(pa.array([lang != UNKNOWN and score >= limit for lang, score in found], pa.bool_()))

    return common.map_rows(docs, run)
