"""The registered queries of the training-data operators, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontam, langid, license_scan, line_dedup, quality, secret_scan, simhash, toxicity, warc
from .common import documents, held_out

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document its toxicity score and prediction."""
    return toxicity.toxicity(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document its predicted language and the network's pooled probability."""
    docs = documents(spark, sf_dir)
    out = langid.predict(docs, *langid.fit(docs))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document its text without boilerplate lines, and the numbers of lines and of dropped ones."""
    return line_dedup.dedup(documents(spark, sf_dir)).select("doc_id", "text", "n_lines", "n_dropped")


OP2_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, text, coalesce('h' || source, '') AS h, string_split(text, chr(10)) AS ls,
             ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) AS sp FROM documents),
l AS (SELECT DISTINCT rid, h, trim(x, sp) AS line FROM (SELECT rid, h, sp, unnest(ls) AS x FROM d) WHERE trim(x, sp) <> ''),
t AS (SELECT h, count(*) AS total FROM d GROUP BY h),
b AS (SELECT l.h, list(line) AS bad FROM (SELECT h, line, count(*) AS pages FROM l GROUP BY h, line) l JOIN t ON l.h = t.h
      WHERE pages >= 2 AND pages > 0.05 * total GROUP BY l.h),
k AS (SELECT d.*, CASE WHEN b.bad IS NULL THEN ls ELSE list_filter(ls, lambda x: NOT list_contains(b.bad, trim(x, sp))) END AS kept
      FROM d LEFT JOIN b ON d.h = b.h)
SELECT doc_id, array_to_string(kept, chr(10)) AS text, CAST(coalesce(len(ls), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(ls) - len(kept), 0) AS BIGINT) AS n_dropped FROM k
"""


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, item_id, distance, budget): the benchmark items that each document contains within the error budget."""
    return decontam.matches(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, license, containment, first_word, windows) of the license notices in all documents."""
    return license_scan.scan(documents(spark, sf_dir))


def op3_sql() -> str:
    """Exact containment in every window, without MinHash."""
    notices = [(n, t) for n, ts in license_scan.TEMPLATES.items() for t in ts]
    rows = ", ".join("({}, '{}', '{}')".format(i, n, t.replace("'", "''")) for i, (n, t) in enumerate(notices))
    words = "list_filter(regexp_split_to_array(lower({}), '[^a-z0-9]+'), lambda x: x <> '')"
    grams = "list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])"
    return f"""
WITH t0(tid, license, text) AS (VALUES {rows}), t1 AS (SELECT tid, license, {words.format("text")} AS w FROM t0),
t2 AS (SELECT tid, license, {grams} AS g FROM t1),
t AS (SELECT tid, license, list_distinct(g) AS need, CAST(pow(2, ceil(log2(len(g)))) AS BIGINT) AS cls FROM t2),
d0 AS (SELECT row_number() OVER () AS rid, doc_id, {words.format("coalesce(text, '')")} AS w FROM documents),
d AS (SELECT rid, doc_id, {grams} AS g FROM d0 WHERE len(w) >= 3),
h AS (SELECT rid, p FROM (SELECT rid, unnest(g) AS s, unnest(range(0, len(g))) AS p FROM d) WHERE s IN (SELECT DISTINCT unnest(need) FROM t)),
v AS (SELECT DISTINCT rid, cls, p // cls - k AS j FROM h, (SELECT DISTINCT cls FROM t), (VALUES (0), (1)) AS o(k) WHERE p // cls - k >= 0),
x AS (SELECT doc_id, license, j * v.cls AS place, (j + 2) * v.cls AS stop, len(need) AS n, len(list_intersect(need, g[j * v.cls + 1 : j * v.cls + 2 * v.cls])) / len(need) AS c
      FROM v JOIN t ON t.cls = v.cls JOIN d ON d.rid = v.rid),
y AS (SELECT *, row_number() OVER () AS xid FROM x WHERE c >= {license_scan.CONTAINED}),
worse AS (SELECT DISTINCT a.xid FROM y a JOIN y b ON a.doc_id IS NOT DISTINCT FROM b.doc_id AND a.license <> b.license AND a.place < b.stop AND b.place < a.stop AND (b.c > a.c OR (b.c = a.c AND b.n > a.n)))
SELECT doc_id, license, CAST(max(c) AS DOUBLE) AS containment, CAST(min(place) AS BIGINT) AS first_word, CAST(count(*) AS BIGINT) AS windows
FROM y WHERE xid NOT IN (SELECT xid FROM worse) GROUP BY doc_id, license
"""


def op5_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per page its metadata and conversion records."""
    made = warc.derivatives(warc.responses(documents(spark, sf_dir, "pages")))
    return made.drop("record")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document the counts of the base kinds, the digest of their spans, and all spans."""
    found = secret_scan.scan(documents(spark, sf_dir))
    base = [r.kind for r in secret_scan.BASE]
    line = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))))
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *(count(k).alias(f"n_{k}") for k in base),
        F.sha2(line(F.filter("found", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"),
        line(F.col("found")).alias("spans"),
    )


def op7_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document the number and digest of its token ids and the digest of what they decode to."""
    return bpe.encode(documents(spark, sf_dir), tokenizer_path())


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document its fingerprint and its near-duplicate class."""
    return simhash.classes(documents(spark, sf_dir)).select("doc_id", simhash.hex16(F.col("fp")).alias("fingerprint"), "component_id")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document its measures, whether its own rules fail, and the verdict with its host's."""
    return quality.judge(documents(spark, sf_dir))


OP10_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, source, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT rid, i, array_to_string(ws[i:i + 4], ' ') AS gram
      FROM (SELECT rid, ws, unnest(generate_series(1, len(ws) - 4)) AS i FROM w WHERE len(ws) >= 5)),
p AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS c FROM g) WHERE c > 1),
r AS (SELECT rid, count(DISTINCT i + k) AS n FROM p, generate_series(0, 4) AS s(k) GROUP BY rid),
m AS (SELECT w.rid, doc_id, source, CAST(len(ws) AS BIGINT) AS n_words,
        CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
        CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN r ON r.rid = w.rid),
b AS (SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed FROM m),
h AS (SELECT source, count(*) AS n, sum(CAST(base_failed AS INT)) AS f, sum(CAST(base_failed AS INT)) / count(*) AS rate
      FROM b WHERE source IS NOT NULL GROUP BY source),
q AS (SELECT avg(rate) AS mean, var_pop(rate) AS var FROM h),
k AS (SELECT mean, CASE WHEN var > 0 THEN greatest(1.0, mean * (1 - mean) / var - 1) ELSE 1.0 END AS s FROM q),
x AS (SELECT source FROM h, k WHERE (f + mean * s) / (n + s) > 0.5)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  (source IS NOT NULL AND source IN (SELECT source FROM x)) AS host_rejected,
  NOT base_failed AND NOT (source IS NOT NULL AND source IN (SELECT source FROM x)) AS kept FROM b
"""


def queries() -> dict[str, Query]:
    return {"op3_license_scan": op3_license_scan, "op5_warc_derivatives": op5_warc_derivatives, "op2_line_dedup": op2_line_dedup, "op9_decontamination": op9_decontamination, "op1_toxicity": op1_toxicity, "op6_language_id": op6_language_id, "op4_secret_scan": op4_secret_scan, "op7_bpe_codec": op7_bpe_codec, "op8_simhash": op8_simhash, "op10_quality_rules": op10_quality_rules}


def oracle_sql() -> dict[str, str]:
    return {"op2_line_dedup": OP2_SQL, "op3_license_scan": op3_sql(), "op10_quality_rules": OP10_SQL}
