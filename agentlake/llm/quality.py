"""Quality rules with host verdicts, in built-in SQL functions alone.

Each document is measured in one pass without a shuffle of its text.  The measures (a few
numbers a row) are written once; failures are counted by host, hosts' failure rates are
shrunk towards the mean of all hosts by a beta prior fitted to those rates, and documents
of hosts whose shrunk rate exceeds the limit are rejected.

Windows of words are compared by 64-bit hashes, so two different ones of one text could
count as equal, with a probability of less than 1e-9 for a text of 100,000 words.

Defined results: a null text has no words, so it fails; a text of any length is measured
whole; a host at exactly the limit is kept; documents with a null host are judged by their
own rules alone; repeated rows and ids count and return as often as they occur; further
columns are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Java's form of ASCII white space.
SPACE = r"[\x20\x09-\x0D]"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: Hosts whose shrunk failure rate is higher are rejected.
MAX_HOST_RATE = 0.5
#: More rejected hosts than this are joined by a shuffle, not by broadcasting.
BROADCAST_HOSTS = 100_000


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), where value is computed once for each row however often body names it."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, f"{SPACE}+"), "")


def _covered(grams: Column) -> Column:
    """Words in windows that occur twice or more: hash and place are sorted together, equal neighbours repeat."""
    placed = F.sort_array(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    equal = lambda s, e, j: F.coalesce(F.get(s, j)["h"] == e["h"], F.lit(False))
    places = let(placed, lambda s: F.transform(F.filter(s, lambda e, j: equal(s, e, j - 1) | equal(s, e, j + 1)), lambda e: e["i"]))
    steps = let(F.sort_array(places), lambda p: F.transform(p, lambda x, j: F.least(F.lit(WINDOW), F.coalesce(F.get(p, j + 1), x + WINDOW) - x)))
    return F.aggregate(steps, F.lit(0), lambda a, b: a + b)


def repeat_words(words: Column) -> Column:
    """Number of words in WINDOW-word windows found twice or more; ``words`` must be a bound array."""
    n = F.size(words)
    grams = F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*(words[i + k] for k in range(WINDOW))))
    some = let(grams, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(_covered(g)))
    return F.when(n > WINDOW, some).otherwise(F.lit(0))


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """One row per document: id, host and the numbers that the rules use."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    counted = let(words_of(text), lambda w: F.struct(F.size(w).alias("n"), repeat_words(w).alias("r")))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    dup = let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))
    out = docs.select(
        F.col(id_col),
        F.col(host_col).alias("host"),
        counted.alias("c"),
        F.length(F.regexp_replace(text, f"{SPACE}+", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        dup.cast("long").alias("n_dup_lines"),
    )
    out = out.select(id_col, "host", F.col("c.n").cast("long").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", F.col("c.r").cast("long").alias("n_repeat_words"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return out.withColumn("base_failed", failed)


def host_rates(measured: DataFrame) -> DataFrame:
    """Per host: documents, failures and the failure rate shrunk by an empirical beta prior.

    The prior has the mean of the hosts' rates, and by moments the strength
    mean * (1 - mean) / variance - 1, held to at least 1; without any spread it is 1.
    """
    hosts = measured.where("host is not null").groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("base_failed").cast("long")).alias("failures"))
    hosts = hosts.withColumn("rate", F.col("failures") / F.col("n"))
    prior = hosts.agg(F.avg("rate").alias("mean"), F.var_pop("rate").alias("var")).first()
    mean, var = prior["mean"] or 0.0, prior["var"] or 0.0
    strength = max(1.0, mean * (1 - mean) / var - 1) if var > 0 else 1.0
    return hosts.withColumn("shrunk", (F.col("failures") + mean * strength) / (F.col("n") + strength))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """One row per document: id, measures, base_failed, host_rejected and kept."""
    measured = materialize(measure(docs, id_col, text_col, host_col))
    rejected = host_rates(measured).where(F.col("shrunk") > MAX_HOST_RATE).select("host", F.lit(True).alias("host_rejected"))
    rejected = materialize(rejected)
    if rejected.count() <= BROADCAST_HOSTS:
        rejected = F.broadcast(rejected)
    out = measured.join(rejected, "host", "left").withColumn("host_rejected", F.coalesce("host_rejected", F.lit(False)))
    return out.withColumn("kept", ~F.col("base_failed") & ~F.col("host_rejected")).drop("host")
