"""Snapshot visibility over version rows, statistics, and reclaimable files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def includes(txn: Column, high_water: int, active: list[int]) -> Column:
    """Whether a snapshot sees a transaction as committed."""
    seen = txn < high_water
    return seen & ~txn.isin(active) if active else seen


def visible(versions: DataFrame, high_water: int, active: list[int], own: int | None = None) -> DataFrame:
    """The version rows that a snapshot sees: begun for it and not ended for it; an end of 0 is open.

    ``versions`` has ``begin_ts`` and ``end_ts``.
    """
    begun, ended = includes(F.col("begin_ts"), high_water, active), includes(F.col("end_ts"), high_water, active)
    if own is not None:
        begun, ended = begun | (F.col("begin_ts") == own), ended | (F.col("end_ts") == own)
    return versions.where(begun & ~((F.col("end_ts") != 0) & ended))


def resolve(versions: DataFrame, key: str, high_water: int, active: list[int]) -> DataFrame:
    """Each key's newest visible version."""
    seen = visible(versions, high_water, active)
    others = [c for c in versions.columns if c != key]
    best = F.max_by(F.struct(*others), F.col("begin_ts")).alias("_r")
    return seen.groupBy(key).agg(best).select(key, *(F.col(f"_r.{c}").alias(c) for c in others))


def analyze(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, row_count, n_distinct, n_nulls, min, max), bounds as text, in one pass."""
    columns = columns or df.columns
    stats = df.agg(
        F.count("*").alias("n"),
        *(F.struct(F.count_distinct(F.col(c)).alias("d"), F.sum(F.col(c).isNull().cast("bigint")).alias("u"), F.min(c).cast("string").alias("lo"), F.max(c).cast("string").alias("hi")).alias(f"s{k}") for k, c in enumerate(columns)),
    )
    rows = F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"s{k}.d").alias("n_distinct"), F.coalesce(f"s{k}.u", F.lit(0)).cast("bigint").alias("n_nulls"), F.col(f"s{k}.lo").alias("min"), F.col(f"s{k}.hi").alias("max")) for k, c in enumerate(columns)))
    return stats.select("n", F.explode(rows).alias("r")).select("r.column", F.col("n").alias("row_count"), "r.n_distinct", "r.n_nulls", "r.min", "r.max")


def write_conflicts(versions: DataFrame, key: str, high_water: int, active: list[int]) -> DataFrame:
    """(key, first_writer, refused): of the writers of a row that a snapshot does not see, the first wins and the others are refused."""
    later = versions.where(~includes(F.col("begin_ts"), high_water, active))
    return later.groupBy(key).agg(F.min("begin_ts").alias("first_writer"), (F.count("*") - 1).alias("refused")).where("refused > 0")


def reclaimable(files: DataFrame, forks: DataFrame) -> DataFrame:
    """Files that no live fork can see: none has birth <= fork_epoch < freed.

    ``files`` (owner, file, birth, freed), ``forks`` (owner, fork_epoch): forks look for the
    files' lifetimes by bins, so an owner of many forks is not gathered.
    """
    from agentlake.operators.provenance import range_join

    spans = files.select("owner", F.col("file").alias("_file"), F.col("birth").cast("double").alias("_birth"), F.col("freed").cast("double").alias("_freed"))
    needed = range_join(forks.select("owner", "fork_epoch").distinct(), spans, "fork_epoch", "_birth", "_freed", ["owner"]).select("owner", "_file").distinct()
    return files.join(needed, (files["owner"] == needed["owner"]) & (files["file"] == needed["_file"]), "left_anti")
