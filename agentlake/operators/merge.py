"""Three-way merge of typed operations, as joins, sorted folds and case expressions.

Operations are rows (side, txn, seq, pos, key, col, kind, v): ``side`` is ours or theirs,
``kind`` is Assign, Add, Max or Min for a cell, or RowCreate or RowDelete for a row, whose
``col`` is null.  Base cells are rows (key, col, b).  Values are of one numeric type.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agentlake.errors import MergeError

OURS, THEIRS = "ours", "theirs"
REJECT, LWW, MULTI, ADDITIVE = "reject", "lww", "multivalue", "additive"
CLEAN, COMMUTING, LOSS, CONFLICT = "Clean", "Commuting", "ResolvedWithLoss", "Conflict"
#: Outcomes from the weakest to the one that decides.
RANK = {CLEAN: 0, COMMUTING: 1, LOSS: 2, CONFLICT: 3}


def dedup_frames(ops: DataFrame) -> DataFrame:
    """One frame for each transaction, ours before theirs, then the first: an Add must not be applied twice.

    A partial aggregate finds each transaction's frame, so one of any size is not gathered.
    """
    first = ops.groupBy("txn").agg(F.min(F.struct("side", "seq")).alias("_f"))
    return ops.join(first, "txn").where(F.struct("side", "seq") == F.col("_f")).select(*ops.columns)


def _fold(kind: Column, value: Column, op: Column, b: Column) -> Column:
    """The folded operation after one more; ``b`` is the cell's base value."""
    k, v = op["kind"], op["v"]
    now = F.when(kind == "Assign", value).when(kind == "Add", b + value).when(kind == "Max", F.greatest(b, value)).otherwise(F.least(b, value))
    keeps = kind.isNull() | (k == "Assign") | (kind == k)
    same = F.when(kind.isNull() | (k == "Assign"), v).when(k == "Add", value + v).when(k == "Max", F.greatest(value, v)).otherwise(F.least(value, v))
    moved = F.when(k == "Add", now + v).when(k == "Max", F.greatest(now, v)).otherwise(F.least(now, v))
    return F.struct(F.when(keeps, k).otherwise("Assign").alias("kind"), F.when(keeps, same).otherwise(moved).alias("v"))


def fold_sides(ops: DataFrame, base: DataFrame) -> DataFrame:
    """(key, col, b, o_kind, o_v, o_at, t_kind, t_v, t_at): both sides' net operations on each cell, in (txn, seq, pos) order.

    One aggregate by cell has both sides as conditional columns, and the base meets it once.
    A side that did one kind of operation on a cell is reduced by partial aggregates (a sum,
    a bound, or the last Assign), so a hot counter is a few numbers a task.  Only cells with
    mixed kinds are read again and folded in order, from their last Assign on.
    """
    kind = ops.schema["v"].dataType.simpleString()
    cells = ops.where("col is not null")
    at = F.struct("txn", "seq", "pos")

    def stats(side: str, p: str) -> list[Column]:
        on = F.col("side") == side
        only = lambda c: F.when(on, c)
        return [
            F.min(only(F.col("kind"))).alias(f"{p}_k0"), F.max(only(F.col("kind"))).alias(f"{p}_k1"), F.sum(only(F.col("v"))).cast(kind).alias(f"{p}_total"),
            F.max(only(F.col("v"))).alias(f"{p}_most"), F.min(only(F.col("v"))).alias(f"{p}_least"), F.max(F.when(on & (F.col("kind") == "Assign"), F.struct(at.alias("at"), "v"))).alias(f"{p}_set"),
            F.max(F.when(on, F.struct("txn", "seq"))).alias(f"{p}_at"),
        ]

    both = cells.groupBy("key", "col").agg(*stats(OURS, "o"), *stats(THEIRS, "t")).join(base.select("key", "col", "b"), ["key", "col"], "left")
    mixed = lambda p: F.col(f"{p}_k0") != F.col(f"{p}_k1")
    sides = F.filter(F.array(*(F.struct(F.lit(s).alias("side"), mixed(p).alias("m"), F.col(f"{p}_set.at").alias("reset")) for s, p in ((OURS, "o"), (THEIRS, "t")))), lambda x: x["m"])
    again = both.select("key", "col", "b", F.explode(sides).alias("s")).select("key", "col", "b", "s.side", "s.reset")
    tail = cells.join(again, ["key", "col", "side"]).where(F.col("reset").isNull() | (at >= F.col("reset")))
    lists = tail.groupBy("key", "col", "side").agg(F.array_sort(F.collect_list(F.struct("txn", "seq", "pos", "kind", "v"))).alias("ops"), F.first("b").alias("b"))
    start = F.struct(F.lit(None).cast("string").alias("kind"), F.lit(None).cast(kind).alias("v"))
    net = lists.select("key", "col", "side", F.aggregate("ops", start, lambda acc, op: _fold(acc["kind"], acc["v"], op, F.col("b"))).alias("net"))
    net = net.groupBy("key", "col").agg(*(F.max(F.when(F.col("side") == s, F.col("net"))).alias(f"{p}_net") for s, p in ((OURS, "o"), (THEIRS, "t"))))
    both = both.join(net, ["key", "col"], "left")

    def result(p: str) -> list[Column]:
        k = F.col(f"{p}_k0")
        plain = F.when(k == "Add", F.col(f"{p}_total")).when(k == "Max", F.col(f"{p}_most")).when(k == "Min", F.col(f"{p}_least")).otherwise(F.col(f"{p}_set.v"))
        return [F.when(mixed(p), F.col(f"{p}_net.kind")).otherwise(k).alias(f"{p}_kind"), F.when(mixed(p), F.col(f"{p}_net.v")).otherwise(plain).alias(f"{p}_v"), F.col(f"{p}_at")]

    return both.select("key", "col", "b", *result("o"), *result("t"))


def net_value(kind: Column, v: Column, b: Column) -> Column:
    return F.when(kind == "Assign", v).when(kind == "Add", b + v).when(kind == "Max", F.greatest(b, v)).when(kind == "Min", F.least(b, v))


def compose_cells(folded: DataFrame, policies: dict[str, str] | None = None, default: str = REJECT) -> DataFrame:
    """(key, col, b, value, outcome, reason, lost_side, lost_kind, lost_v, kept) of every cell that a side wrote.

    ``kept`` has both sides' net operations where the multi-value policy keeps them beside
    the later value; ``folded`` is as ``fold_sides`` gives it.
    """
    both = folded
    policy = F.lit(default)
    for name, p in (policies or {}).items():
        policy = F.when(F.col("col") == name, p).otherwise(policy)
    ok, tk, ov, tv, b = (F.col(c) for c in ("o_kind", "t_kind", "o_v", "t_v", "b"))
    o_net, t_net = net_value(ok, ov, b), net_value(tk, tv, b)
    one = ok.isNull() | tk.isNull()
    commute = (ok == tk) & ((ok != "Assign") | ov.eqNullSafe(tv))
    together = F.when(ok == "Add", b + ov + tv).when(ok == "Max", F.greatest(b, ov, tv)).when(ok == "Min", F.least(b, ov, tv)).otherwise(ov)
    ours_later = F.col("o_at") > F.col("t_at")
    later = F.when(ours_later, o_net).otherwise(t_net)
    both = both.withColumn("policy", policy).withColumn("_ours", ours_later)
    p = F.col("policy")
    value = (
        F.when(one, F.coalesce(o_net, t_net)).when(commute, together)
        .when(p == ADDITIVE, b + (o_net - b) + (t_net - b)).when(p.isin(LWW, MULTI), later)
    )
    outcome = F.when(one, CLEAN).when(commute | p.isin(ADDITIVE, MULTI), COMMUTING).when(p == LWW, LOSS).otherwise(CONFLICT)
    lost = outcome == LOSS
    sides = F.array(*(F.struct(F.lit(s).alias("side"), k.alias("kind"), v.alias("v")) for s, k, v in ((OURS, ok, ov), (THEIRS, tk, tv))))
    return both.select(
        "key", "col", "b", value.alias("value"), outcome.alias("outcome"),
        F.when(outcome == CONFLICT, "ContradictoryAssign").alias("reason"),
        F.when(lost, F.when(F.col("_ours"), THEIRS).otherwise(OURS)).alias("lost_side"),
        F.when(lost, F.when(F.col("_ours"), tk).otherwise(ok)).alias("lost_kind"),
        F.when(lost, F.when(F.col("_ours"), tv).otherwise(ov)).alias("lost_v"),
        F.when(~one & ~commute & (p == MULTI), sides).alias("kept"),
    )


def compose_rows(ops: DataFrame) -> DataFrame:
    """(key, row_outcome, row_reason, action) for rows that a side created or deleted.

    A delete against any other operation of the other side is DeleteVsWrite; two equal
    creates (by ``v``, an image's hash or value) are one, different ones contradict.
    """
    row = F.col("col").isNull()
    per = ops.groupBy("key", "side").agg(
        F.max_by(F.when(row, F.struct("kind", "v")), F.when(row, F.struct("txn", "seq", "pos"))).alias("last"),
        F.count("*").alias("n"),
    )
    side = lambda s, p: per.where(F.col("side") == s).select("key", F.col("last.kind").alias(f"{p}_kind"), F.col("last.v").alias(f"{p}_v"), F.lit(True).alias(p))
    both = side(OURS, "o").join(side(THEIRS, "t"), "key", "full_outer")
    od, td = F.coalesce(F.col("o_kind") == "RowDelete", F.lit(False)), F.coalesce(F.col("t_kind") == "RowDelete", F.lit(False))
    oc, tc = F.coalesce(F.col("o_kind") == "RowCreate", F.lit(False)), F.coalesce(F.col("t_kind") == "RowCreate", F.lit(False))
    wrote = F.col("o").isNotNull() & F.col("t").isNotNull()
    bad_delete = wrote & (od != td)
    bad_create = oc & tc & ~F.col("o_v").eqNullSafe(F.col("t_v"))
    out = both.where(od | td | oc | tc)
    return out.select(
        "key",
        F.when(bad_delete | bad_create, CONFLICT).when(wrote, COMMUTING).otherwise(CLEAN).alias("row_outcome"),
        F.when(bad_delete, "DeleteVsWrite").when(bad_create, "ContradictoryAssign").alias("row_reason"),
        F.when(bad_delete | bad_create, F.lit(None)).when(od | td, "delete").otherwise("create").alias("action"),
    )


def three_way_merge(base: DataFrame, ops: DataFrame, policies: dict[str, str] | None = None, default: str = REJECT) -> tuple[DataFrame, DataFrame]:
    """(cells, rows): composed cells without those of rows that conflict or go, and row results."""
    ops = dedup_frames(ops)
    rows = compose_rows(ops)
    cells = compose_cells(fold_sides(ops, base), policies, default)
    gone = rows.where("row_outcome = 'Conflict' or action = 'delete'").select("key")
    return cells.join(gone, "key", "left_anti"), rows


def overall(column: str = "outcome") -> Column:
    """The decisive one of an outcome column, for use in an aggregate."""
    rank = F.create_map(*(F.lit(x) for k, v in RANK.items() for x in (k, v)))
    names = F.create_map(*(F.lit(x) for k, v in RANK.items() for x in (v, k)))
    return names[F.max(rank[F.col(column)])]


def in_order(rows: DataFrame, key: str, order: list[str], start, step, out: str) -> DataFrame:
    """A fold that accepts or refuses each of a key's rows by the state so far, which no partial aggregate can do.

    The rows of a key are one task's by definition; they come sorted and leave as they are
    decided, so nothing but the state is held.  ``start(row)`` gives a key's first state,
    ``step(state, row)`` the next state and the values that the row gets as well.
    """
    columns = rows.columns
    dealt = rows.repartition(key).sortWithinPartitions(key, *order)

    def run(batches):
        import pandas as pd

        now, state = None, None
        for batch in batches:
            made = []
            for row in batch.to_dict("records"):
                if state is None or row[key] != now:
                    now, state = row[key], start(row)
                state, values = step(state, row)
                made.append(values)
            if made:
                yield pd.concat([batch, pd.DataFrame(made, index=batch.index)], axis=1)

    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in columns)
    return dealt.mapInPandas(run, f"{schema}, {out}")


def guarded_adds(base: DataFrame, ops: DataFrame) -> DataFrame:
    """(key, txn, seq, ok, value): each key's guarded additions in order; one applies if the running value is at least ``need``.

    ``base`` has (key, b), ``ops`` (key, txn, seq, need, v).
    """

    def step(now, row):
        ok = now >= row["need"]
        now = now + row["v"] if ok else now
        return now, {"ok": ok, "value": now}

    rows = ops.select("key", "txn", "seq", "need", "v").join(base.select("key", "b"), "key")
    return in_order(rows, "key", ["txn", "seq"], lambda row: row["b"], step, f"ok boolean, value {ops.schema['v'].dataType.simpleString()}").select("key", "txn", "seq", "ok", "value")


def orset_merge(inserts: DataFrame, removes: DataFrame) -> DataFrame:
    """(key, elem): an insert survives unless some side's remove names its dot; ``inserts`` (key, elem, dot), ``removes`` (key, dot)."""
    return inserts.join(removes.select("key", "dot").distinct(), ["key", "dot"], "left_anti").select("key", "elem").distinct()


def compose_sets(ops: DataFrame) -> DataFrame:
    """(key, col, elem, outcome) of set-valued cells: what either side inserted and neither removed by its dot; both sides' operations commute.

    ``ops`` (side, key, col, act, elem, dot) with act Insert or Remove.  A cell of which
    nothing is left has one row with a null elem.
    """
    sides = ops.groupBy("key", "col").agg(F.when(F.min("side") == F.max("side"), CLEAN).otherwise(COMMUTING).alias("outcome"))
    gone = ops.where("act = 'Remove'").select("key", "col", "dot").distinct()
    left = ops.where("act = 'Insert'").join(gone, ["key", "col", "dot"], "left_anti").select("key", "col", "elem").distinct()
    return sides.join(left, ["key", "col"], "left").select("key", "col", "elem", "outcome")


def inverse_ops(ops: DataFrame) -> DataFrame:
    """What undoes operations: Add by its negative, Assign by its witness, a row's creation by its deletion and back.

    Max and Min have no inverse; they come back with kind null.
    """
    k = F.col("kind")
    kind = F.when(k.isin("Add", "Assign"), k).when(k == "RowCreate", "RowDelete").when(k == "RowDelete", "RowCreate")
    return ops.withColumn("v", F.when(k == "Add", -F.col("v")).when(k.isin("Assign", "RowDelete"), F.col("witness"))).withColumn("kind", kind)


def schema_conflicts(frames: DataFrame) -> DataFrame:
    """(tbl, versions) of tables whose frames were written under different schema versions; such a merge is a conflict."""
    return frames.groupBy("tbl").agg(F.array_sort(F.collect_set("schema_ver")).alias("versions")).where(F.size("versions") > 1)


def bound_breaks(cells: DataFrame, bounds: DataFrame) -> DataFrame:
    """Composed cells whose value is below the floor or above the ceiling; null bounds are open.  ``bounds`` (key, col, floor, ceiling)."""
    joined = cells.join(bounds, ["key", "col"])
    return joined.where((F.col("value") < F.col("floor")) | (F.col("value") > F.col("ceiling")))


def append_frames(log: DataFrame, new: DataFrame) -> DataFrame:
    """The log with new frames: what it has already is a no-op, a longer history extends it, anything else is refused.

    Both have (txn, seq, content); the result is the union with each frame once.
    """
    key = ["txn", "seq"]
    old = log.select(*key, F.xxhash64("content").alias("_old"))
    differing = new.select(*key, F.xxhash64("content").alias("_new")).join(old, key).where("_old <> _new")
    last = lambda df, name: df.groupBy("txn").agg(F.max("seq").alias(name))
    shorter = last(new, "n").join(last(log, "o"), "txn").where("n < o")
    bad = differing.select("txn").unionByName(shorter.select("txn")).distinct()
    if count := bad.count():
        raise MergeError(f"{count} transaction(s) contradict the log, such as {bad.first()[0]}; append only what extends it")
    return log.unionByName(new.join(old.select(*key), key, "left_anti").select(*log.columns))
