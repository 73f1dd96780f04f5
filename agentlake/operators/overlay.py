"""Branch views: a base table overlaid with a branch's rows, and differences of two images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DELETED = "_deleted"


def latest(delta: DataFrame, key: str, *order: str) -> DataFrame:
    """Each key's last staged image by the order columns."""
    others = [c for c in delta.columns if c != key]
    best = F.max_by(F.struct(*others), F.struct(*order)).alias("_r")
    return delta.groupBy(key).agg(best).select(key, *(F.col(f"_r.{c}").alias(c) for c in others))


def overlay(base: DataFrame, delta: DataFrame, key: str) -> DataFrame:
    """The base with the delta's rows in place of its own; ``delta`` has one row a key and ``_deleted``."""
    live = delta.where(~F.col(DELETED)).select(*base.columns)
    return base.join(delta.select(key), key, "left_anti").select(*base.columns).unionByName(live)


def differs(left: str, right: str, columns: list[str]) -> Column:
    out = F.lit(False)
    for c in columns:
        out = out | ~F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}"))
    return out


def row_diff(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """(key, kind, before, after) of the rows that differ; kind is INSERT, UPDATE or DELETE."""
    values = [c for c in before.columns if c != key]
    b = before.select(F.col(key), F.struct(*before.columns).alias("before"))
    a = after.select(F.col(key), F.struct(*before.columns).alias("after"))
    both = b.join(a, key, "full_outer")
    kind = F.when(F.col("before").isNull(), "INSERT").when(F.col("after").isNull(), "DELETE").when(differs("before", "after", values), "UPDATE")
    return both.withColumn("kind", kind).where(F.col("kind").isNotNull()).select(key, "kind", "before", "after")


def blind_writes(writes: DataFrame, reads: DataFrame, table_reads: DataFrame | None = None, keys: tuple[str, ...] = ("tbl", "key")) -> DataFrame:
    """Written rows that were not read; a predicate read covers its whole table."""
    out = writes.join(reads.select(*keys).distinct(), list(keys), "left_anti")
    return out if table_reads is None else out.join(table_reads.select("tbl").distinct(), "tbl", "left_anti")
