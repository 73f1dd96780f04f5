"""Change feeds: decode in commit order, fold, validate, upsert, cut over and compare."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agentlake.errors import FeedError

PUTS = ("READ", "INSERT", "UPDATE")
SCHEMA_OPS = ("CREATE_TABLE", "DROP_TABLE")
OPS = (*PUTS, "DELETE", *SCHEMA_OPS)
#: Types whose JSON numbers would lose digits in common readers.
AS_TEXT = ("bigint", "decimal", "timestamp")


def decode(changes: DataFrame, ends: DataFrame) -> DataFrame:
    """Row events of committed transactions with (commit_lsn, commit_end_lsn); aborted and open ones are withheld.

    ``changes`` has ``txn`` and ``lsn``; ``ends`` (txn, op, lsn, end_lsn) with op COMMIT or ABORT.
    """
    commits = ends.where("op = 'COMMIT'").select("txn", F.col("lsn").alias("commit_lsn"), F.col("end_lsn").alias("commit_end_lsn"))
    return changes.join(commits, "txn")


def open_transactions(changes: DataFrame, ends: DataFrame) -> DataFrame:
    """(txn, first_lsn) of transactions without an end, which hold the cursor back."""
    return changes.join(ends.select("txn").distinct(), "txn", "left_anti").groupBy("txn").agg(F.min("lsn").alias("first_lsn"))


def decode_report(changes: DataFrame, ends: DataFrame, tables: list[str]) -> DataFrame:
    """One row of counts: events that decoding emits, withholds (open), discards (aborted), and that no declared table has or nothing can be read of."""
    state = changes.join(ends.select("txn", F.col("op").alias("_end")).distinct(), "txn", "left")
    known, readable = F.col("tbl").isin(tables), F.col("op").isin(*OPS) & F.col("key").isNotNull()
    done = F.col("_end") == "COMMIT"
    return state.agg(
        F.count_if(done & known & readable).alias("emitted"),
        F.count_if(F.col("_end").isNull()).alias("withheld"),
        F.count_if(F.col("_end") == "ABORT").alias("discarded"),
        F.count_if(done & ~known).alias("unknown_table"),
        F.count_if(done & known & ~F.coalesce(readable, F.lit(False))).alias("undecodable"),
    )


def next_cursor(cursor: int, decoded: DataFrame, opened: DataFrame) -> int:
    """min(max(cursor, greatest commit end), earliest open record)."""
    top = decoded.agg(F.max("commit_end_lsn")).first()[0]
    low = opened.agg(F.min("first_lsn")).first()[0]
    at = max(cursor, top if top is not None else cursor)
    return at if low is None else min(at, low)


def boundary(changes: DataFrame, ends: DataFrame, lsn: int) -> dict:
    """What a snapshot read at a log position has seen: {"high_water", "active"}, sampled from one state of the log.

    All transactions that began up to the position are below the high water; those without
    an end by then are ``active`` (a DataFrame of txn), and so are not in the copy.
    """
    begun = changes.where(F.col("lsn") <= lsn).select("txn").distinct()
    high = begun.agg(F.max("txn")).first()[0]
    return {"high_water": 0 if high is None else high + 1, "active": begun.join(ends.where(F.col("lsn") <= lsn).select("txn"), "txn", "left_anti")}


def pump(decoded: DataFrame, emitted_through: int, snapshot: dict | None = None, cursor: int | None = None, base: int | None = None) -> DataFrame:
    """Events to emit: not delivered by the snapshot (table and transaction), then beyond ``emitted_through``.

    A ``cursor`` below the log's ``base`` is refused: what it points at is gone.
    """
    if cursor is not None and base is not None and cursor < base:
        raise FeedError(f"the feed stopped at {cursor}, but the log begins at {base}: what lies between is lost; copy the tables anew and follow from {base}")
    out = decoded.where(F.col("commit_lsn") > emitted_through)
    if not snapshot:
        return out
    active = snapshot["active"]
    copied = F.col("tbl").isin(sorted(snapshot["tables"])) & (F.col("txn") != 0) & (F.col("txn") < snapshot["high_water"])
    if isinstance(active, DataFrame):
        marked = out.join(active.select(F.col("txn").alias("_txn")).distinct(), F.col("txn") == F.col("_txn"), "left")
        return marked.where(~copied | F.col("_txn").isNotNull()).drop("_txn")
    return out.where(~(copied & ~F.col("txn").isin(sorted(active))) if active else ~copied)


def _dealt(events: DataFrame, *order: str) -> DataFrame:
    """Events dealt out by ranges of table and order, with ``_p``, the number of the range; written, so that both readers see one dealing."""
    from agentlake.operators.provenance import checkpointed

    return checkpointed(events.repartitionByRange("tbl", *order).withColumn("_p", F.spark_partition_id()))


def commit_order(events: DataFrame) -> DataFrame:
    """A dense position by (commit_lsn, lsn) within each table: places in a range, and the ranges' sizes added up.

    A table's events lie in as many tasks as their number asks for; only the ranges' sizes meet in one.
    """
    dealt = _dealt(events, "commit_lsn", "lsn")
    before = Window.partitionBy("tbl").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy("tbl", "_p").agg(F.count("*").alias("_n")).select("tbl", "_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("tbl", "_p").orderBy("commit_lsn", "lsn"))
    out = dealt.withColumn("_place", place).join(sizes, ["tbl", "_p"])
    return out.withColumn("position", (F.col("_before") + F.col("_place")).cast("bigint")).select(*events.columns, "position")


def position() -> Column:
    return F.struct("commit_lsn", "lsn")


def fold(events: DataFrame, key: str, image: list[str], drops: DataFrame | None = None) -> DataFrame:
    """The table that the events build: each key's last event, unless it is a DELETE; only after the last DROP_TABLE."""
    rows = events.where(~F.col("op").isin(*SCHEMA_OPS))
    if drops is not None:
        last = drops.agg(F.max(position()).alias("p"))  # one row
        rows = rows.join(F.broadcast(last), F.col("p").isNull() | (position() > F.col("p")), "inner").drop("p")
    best = F.max_by(F.struct("op", *image), position()).alias("r")
    latest = rows.groupBy(key).agg(best).where(F.col("r.op") != "DELETE")
    return latest.select(key, *(F.col(f"r.{c}").alias(c) for c in image))


def guarded_upsert(destination: DataFrame, events: DataFrame, key: str, image: list[str]) -> DataFrame:
    """The destination after the events: an event applies if its (commit_lsn, lsn) is strictly greater; deletes are soft.

    The destination has ``_commit_lsn``, ``_lsn`` and ``_deleted`` besides key and image.
    """
    best = F.max_by(F.struct("op", "commit_lsn", "lsn", *image), position()).alias("n")
    new = events.where(~F.col("op").isin(*SCHEMA_OPS)).groupBy(key).agg(best)
    old = destination.select(key, F.struct("_commit_lsn", "_lsn", "_deleted", *image).alias("o"))
    both = old.join(new, key, "full_outer")
    newer = F.col("o").isNull() | (F.struct(F.col("n.commit_lsn"), F.col("n.lsn")) > F.struct(F.col("o._commit_lsn"), F.col("o._lsn")))
    take = F.col("n").isNotNull() & newer
    pick = lambda a, b: F.when(take, F.col(a)).otherwise(F.col(b))
    return both.select(
        key,
        *(pick(f"n.{c}", f"o.{c}").alias(c) for c in image),
        pick("n.commit_lsn", "o._commit_lsn").alias("_commit_lsn"),
        pick("n.lsn", "o._lsn").alias("_lsn"),
        F.when(take, F.col("n.op") == "DELETE").otherwise(F.col("o._deleted")).alias("_deleted"),
    )


def beyond_cursor(events: DataFrame, cursors: DataFrame) -> DataFrame:
    """Events that a consumer has not applied; READ and schema events always pass.  ``cursors`` (tbl, c_commit, c_lsn)."""
    joined = events.join(cursors, "tbl", "left")
    passes = F.col("op").isin("READ", *SCHEMA_OPS) | F.col("c_commit").isNull() | (position() > F.struct("c_commit", "c_lsn"))
    return joined.where(passes).drop("c_commit", "c_lsn")


def violations(events: DataFrame) -> DataFrame:
    """(lsn, reason) of events that break the envelope's rules or the commit order of their arrival ``line``."""
    before, after = F.col("before").isNotNull(), F.col("after").isNotNull()
    op = F.col("op")
    shape = (
        F.when(~op.isin(*OPS) | op.isNull(), "unknown op")
        .when(op.isin("READ", "INSERT") & (before | ~after), "needs after alone")
        .when((op == "UPDATE") & ~(before & after), "needs before and after")
        .when((op == "DELETE") & (~before | after), "needs before alone")
        .when((op != "READ") & ~(F.col("commit_end_lsn") > F.col("commit_lsn")), "commit_end_lsn not beyond commit_lsn")
    )
    dealt = _dealt(events, "line")
    within = F.lag("commit_lsn").over(Window.partitionBy("tbl", "_p").orderBy("line"))
    # an event that begins a range follows the last one of the range before
    ends = dealt.groupBy("tbl", "_p").agg(F.max_by("commit_lsn", "line").alias("_end"), F.min("line").alias("_first"))
    ends = ends.select("tbl", "_p", "_first", F.lag("_end").over(Window.partitionBy("tbl").orderBy("_p")).alias("_border"))
    out = dealt.withColumn("_last", within).join(ends, ["tbl", "_p"])
    last = F.when(F.col("line") == F.col("_first"), F.col("_border")).otherwise(F.col("_last"))
    reason = F.coalesce(shape, F.when(last > F.col("commit_lsn"), "commit_lsn goes back"))
    return out.withColumn("reason", reason).where("reason is not null").select("lsn", "reason")


def encoded(columns: dict[str, str]) -> Column:
    """A JSON object of the columns (name to type); BIGINT, DECIMAL and TIMESTAMP are strings, nulls are kept."""
    value = lambda c, t: F.col(c).cast("string") if t.lower().split("(")[0] in AS_TEXT else F.col(c)
    return F.to_json(F.struct(*(value(c, t).alias(c) for c, t in columns.items())), {"ignoreNullFields": "false"})


def source_diff(materialized: DataFrame, source: DataFrame, key: str, check_empty: bool = True) -> DataFrame:
    """(key, problem, column) where a materialised table differs from its source; both empty is refused."""
    columns = [c for c in source.columns if c != key]
    if check_empty and not materialized.limit(1).count() and not source.limit(1).count():
        raise FeedError("both sides are empty: the comparison would prove nothing; check the feed and the dump")
    m = materialized.select(F.col(key), F.struct(*columns).alias("m"))
    s = source.select(F.col(key), F.struct(*columns).alias("s"))
    both = m.join(s, key, "full_outer")
    differing = F.filter(F.array(*(F.when(~F.col(f"m.{c}").eqNullSafe(F.col(f"s.{c}")), F.lit(c)) for c in columns)), lambda x: x.isNotNull())
    cause = F.when(F.col("m").isNull(), F.array(F.struct(F.lit("missing").alias("problem"), F.lit(None).cast("string").alias("column"))))
    cause = cause.when(F.col("s").isNull(), F.array(F.struct(F.lit("extra").alias("problem"), F.lit(None).cast("string").alias("column"))))
    cause = cause.otherwise(F.transform(differing, lambda c: F.struct(F.lit("differs").alias("problem"), c.alias("column"))))
    return both.select(key, F.explode(cause).alias("p")).select(key, "p.problem", "p.column")


def precision_report(events: DataFrame, json_col: str, columns: list[str]) -> DataFrame:
    """(column, strings, numbers, lossy): how each column's values are written, and numbers a double cannot hold."""
    raw = lambda c: F.regexp_extract(F.col(json_col), rf'"{c}":\s*("(?:[^"\\]|\\.)*"|[^,}}\]]+)', 1)
    rows = events.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), raw(c).alias("raw")) for c in columns))).alias("r")).select("r.*")
    rows = rows.where("raw <> '' and raw <> 'null'")
    number = ~F.col("raw").startswith('"')
    whole = F.col("raw").rlike(r"^-?[0-9]+$")
    held = F.col("raw").try_cast("double")
    back = F.when(whole, F.col("raw").try_cast("decimal(38,0)").try_cast("double").cast("decimal(38,0)").cast("string") != F.col("raw"))
    # two spellings of one double with the same significant digits are one number; a fraction may be its shortest spelling or have lost digits
    digits = lambda c: F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"[eE].*$", ""), r"^-|\.", ""), r"^0+|0+$", "")
    back = F.when(whole, back).otherwise(F.when(held.isNotNull(), digits(F.col("raw")) != digits(held.cast("string"))))
    return rows.groupBy("column").agg(
        F.count_if(~number).alias("strings"),
        F.count_if(number).alias("numbers"),
        F.count_if(number & F.coalesce(back, F.lit(False))).alias("lossy"),
    )


def encoded_struct(name: str, columns: dict[str, str]) -> Column:
    """The same for the fields of a struct column."""
    value = lambda c, t: F.col(f"{name}.{c}").cast("string") if t.lower().split("(")[0] in AS_TEXT else F.col(f"{name}.{c}")
    return F.to_json(F.struct(*(value(c, t).alias(c) for c, t in columns.items())), {"ignoreNullFields": "false"})


def with_schema(events: DataFrame, declarations: DataFrame) -> DataFrame:
    """Each event with the declaration that held at its LSN: the last one of its table at or before it.

    ``declarations`` (tbl, lsn, columns) are few a table; they become LSN ranges and meet
    the events by bins, so that a hot table is not sorted in one task.
    """
    from agentlake.operators.provenance import range_join

    until = F.lead("lsn").over(Window.partitionBy("tbl").orderBy("lsn"))
    spans = declarations.select("tbl", F.col("columns"), F.col("lsn").cast("double").alias("_from"), until.cast("double").alias("_until"))
    return range_join(events, spans, "lsn", "_from", "_until", ["tbl"]).drop("_from", "_until")
