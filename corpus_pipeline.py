"""Corpus pipeline: language ID, line dedup, near-dedup, decontamination, BPE.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but
the last return the columns of ``documents``.  ``run`` writes each stage's result as
Parquet to the cluster's shared folder and reads it again, so a stage that is lost with an
executor is computed from its predecessor's files.

Defined results: null texts have no language and go in the first stage, as do texts without
a letter; ``lang`` holds the predicted language afterwards; texts of any length pass whole;
of repeated rows near-dedup keeps one; an empty table passes as one, and empty stages do
too; further columns of ``documents``, of any name, are kept as they are up to the last
stage.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agentlake.llm import bpe, common, decontam, langid, line_dedup, simhash
from agentlake.llm.queries import tokenizer_path


#: Pages of its host that a line must stand on to be boilerplate, besides the ratio.  Two pages may be copies
#: of one another, which near-dedup removes whole; from 60 pages of a host on the ratio decides alone.
LINE_PAGES = 3


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language the network knows go; ``lang`` holds the predicted one from here on."""
    langs, net, limit = langid.fit_with_limit(docs)
    return langid.accept(docs, langs, net, limit=limit, lang_col="lang")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines go; no document does, and one of such lines alone is left as it is."""
    out = line_dedup.dedup(docs, min_pages=LINE_PAGES, keep_whole=True).select(*(f"`{c}`" for c in docs.columns))
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays, the one with the smallest id."""
    return simhash.survivors(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item within its error budget go."""
    return decontam.clean(docs, common.documents(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's token ids, and the digests of the ids and of what they decode to."""
    return bpe.encode(docs, tokenizer_path(), keep_ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("line_dedup", lines),
    ("simhash_near_dedup", near_duplicates),
    ("decontamination", decontamination),
    ("bpe", tokens),
]

#: SQL has no trained network, edit-distance automaton or BPE; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, applied to ``documents``."""
    docs = common.documents(spark, sf_dir)
    folder = f"{common.shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}-{name}")
            docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
