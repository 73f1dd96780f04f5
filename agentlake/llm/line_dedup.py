"""Line dedup by site-relative frequency.

For each host, the share of its pages that contain a line; lines with a share above RATIO
are boilerplate of that host and are dropped from its pages.  A line must stand on
MIN_PAGES pages to be a repetition at all: on a host of fewer than 1 / RATIO pages a line
of one page would be above any ratio.
Lines are compared by their text without outer ASCII white space and stand in the counts
as 96 bits of two hashes (two lines of equal hashes count as one); only those leave the map
side, partially counted, so a line of a third of all pages is one row for each task.  The
boilerplate lines are few by construction (at most mean lines a page / RATIO for each
host): below BROADCAST_LINES they are sent to all tasks, beyond that pages and lines meet
by a shuffle.

Defined results: blank lines are kept and not counted; a page of boilerplate alone becomes
its blank lines, or an empty text (``keep_whole`` leaves such a page as it is); a null text
stays null with 0 lines; a text of any length is split whole; a share of exactly RATIO is
kept; pages with a null host are one site of their own; repeated rows count as pages;
further columns are kept, and where the input has an ``n_lines`` or ``n_dropped`` the
result's own is named with a further underscore; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

RATIO = 0.05
MIN_PAGES = 2
BROADCAST_LINES = 50_000
#: A host's lines are sent in so many lists by their hash, so that few are looked through for each line of a page.
LISTS = 256
_NOT_BLANK = r"[^\x20\x09-\x0D]"
_TRIM = " \t\n\x0b\x0c\r"


def _key(line: Column) -> Column:
    trimmed = F.btrim(line, F.lit(_TRIM))
    return F.struct(F.xxhash64(trimmed).alias("k"), F.hash(trimmed).alias("k2"))


def _host(host_col: str) -> Column:
    """Null hosts get a name that differs from all others."""
    return F.coalesce(F.concat(F.lit("h"), F.col(host_col)), F.lit(""))


def boilerplate(docs: DataFrame, text_col: str = "text", host_col: str = "source", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(h, k, k2, pages, total) of the lines above the ratio."""
    lines = F.filter(F.split(F.col(text_col), "\n"), lambda x: x.rlike(_NOT_BLANK))
    keys = F.array_distinct(F.transform(lines, _key))
    pages = docs.select(_host(host_col).alias("h"), F.explode(keys).alias("l")).groupBy("h", "l.k", "l.k2").agg(F.count("*").alias("pages"))
    totals = docs.groupBy(_host(host_col).alias("h")).agg(F.count("*").alias("total"))
    # totals: one row a host, a number each
    return pages.where(F.col("pages") >= min_pages).join(totals, "h").where(F.col("pages") > ratio * F.col("total"))


def dedup(docs: DataFrame, text_col: str = "text", host_col: str = "source", ratio: float = RATIO, min_pages: int = MIN_PAGES, broadcast_lines: int = BROADCAST_LINES, keep_whole: bool = False) -> DataFrame:
    """The input with its boilerplate lines dropped from the text, and the longs n_lines and n_dropped."""
    found = materialize(boilerplate(docs, text_col, host_col, ratio, min_pages).select("h", F.struct("k", "k2").alias("l")))
    joined = _by_broadcast(docs, found, text_col, host_col) if found.count() <= broadcast_lines else _by_shuffle(docs, found, text_col, host_col)
    return _columns(docs, joined, text_col, keep_whole)


def _list(key: Column) -> Column:
    return F.pmod(key["k"], F.lit(LISTS)).cast("int")


def _by_broadcast(docs: DataFrame, found: DataFrame, text_col: str, host_col: str) -> DataFrame:
    lists = found.groupBy(F.col("h").alias("__al_h"), _list(F.col("l")).alias("b")).agg(F.collect_list("l").alias("ls"))
    by = lists.groupBy("__al_h").agg(F.map_from_entries(F.collect_list(F.struct("b", "ls"))).alias("m"))
    bad = by.select("__al_h", F.transform(F.sequence(F.lit(0), F.lit(LISTS - 1)), lambda i: F.col("m")[i]).alias("__al_bad"))
    joined = docs.withColumn("__al_h", _host(host_col)).join(F.broadcast(bad), "__al_h", "left")
    lines = F.split(F.col(text_col), "\n")
    known = lambda key: F.coalesce(F.array_contains(F.col("__al_bad")[_list(key)], key), F.lit(False))
    kept = F.filter(lines, lambda x: ~F.exists(F.array(_key(x)), known))
    kept = F.when(F.col("__al_bad").isNull(), lines).otherwise(kept)
    return joined.withColumn("__al_lines", lines).withColumn("__al_kept", kept)


def _free(name: str, taken: list[str]) -> str:
    while name.lower() in [c.lower() for c in taken]:
        name += "_"
    return name


def _columns(docs: DataFrame, joined: DataFrame, text_col: str, keep_whole: bool) -> DataFrame:
    lines, kept, null = F.col("__al_lines"), F.col("__al_kept"), F.col(text_col).isNull()
    if keep_whole:
        joined = joined.withColumn("__al_kept", F.when(F.exists(kept, lambda x: x.rlike(_NOT_BLANK)), kept).otherwise(lines))
    count = lambda c: F.coalesce(F.when(~null, c), F.lit(0)).cast("long")
    columns = [F.when(~null, F.array_join(kept, "\n")).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns]
    return joined.select(*columns, count(F.size(lines)).alias(_free("n_lines", docs.columns)), count(F.size(lines) - F.size(kept)).alias(_free("n_dropped", docs.columns)))


def _by_shuffle(docs: DataFrame, found: DataFrame, text_col: str, host_col: str) -> DataFrame:
    """For any number of boilerplate lines: pages' line keys meet them by a shuffle, then the places return to the pages."""
    rows = materialize(docs.withColumn("__al_row", F.expr("uuid()")).withColumn("__al_h", _host(host_col)))
    keys = rows.select("__al_row", F.col("__al_h").alias("h"), F.posexplode(F.transform(F.split(F.col(text_col), "\n"), _key)).alias("__al_i", "l"))
    drop = keys.join(found, ["h", "l"], "left_semi").groupBy("__al_row").agg(F.array_sort(F.collect_list("__al_i")).alias("__al_drop"))
    joined = rows.join(drop, "__al_row", "left").withColumn("__al_lines", F.split(F.col(text_col), "\n"))
    kept = F.filter("__al_lines", lambda x, i: ~F.array_contains(F.col("__al_drop"), i))
    return joined.withColumn("__al_kept", F.when(F.col("__al_drop").isNull(), F.col("__al_lines")).otherwise(kept))
