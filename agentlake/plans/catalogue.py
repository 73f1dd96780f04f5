"""The registered queries over the driver's tables, each with its ANSI SQL for DuckDB."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from agentlake.functions import scalar
from agentlake.operators import cdc, escrow, merge, mvcc, overlay, provenance
from agentlake.plans.binder import Field
from agentlake.session import Engine

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lake(spark: SparkSession, **tables: DataFrame) -> Engine:
    """An engine on a store of its own in the shared folder, with these tables; the first column is the key."""
    engine = Engine(spark, f"{provenance.shared_folder(spark)}/lake-{uuid.uuid4().hex}")
    kinds = {"int": "INTEGER", "bigint": "BIGINT", "double": "FLOAT"}
    for name, df in tables.items():
        engine.load(name, df, [Field(c, kinds[t], 0, k > 0) for k, (c, t) in enumerate(df.dtypes)])
    return engine


def agent(engine: Engine, name: str, *statements: str):
    """A branch session after some statements."""
    s = engine.connect()
    s.execute(f"BEGIN AGENT SESSION AS '{name}'")
    for text in statements:
        s.execute(text)
    return s


# -- scans, filters, scalars ------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 45 AND l_returnflag = 'R'")
def scan_filter_project(spark, d):
    return table(spark, d, "lineitem").where("l_quantity > 45 and l_returnflag = 'R'").select("l_orderkey", "l_linenumber", "l_quantity")


@query("SELECT p_partkey, p_size FROM part WHERE p_partkey BETWEEN 10 AND 99")
def range_scan(spark, d):
    return table(spark, d, "part").where(F.col("p_partkey").between(10, 99)).select("p_partkey", "p_size")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey = 77")
def point_lookup(spark, d):
    return table(spark, d, "orders").where("o_orderkey = 77").select("o_orderkey", "o_custkey")


@query("""SELECT o_orderkey FROM (SELECT *, CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE o_totalprice END AS p FROM orders)
WHERE NOT (p > 100000 AND o_orderstatus = 'F') OR p < 50000""")
def null_logic_filter(spark, d):
    o = table(spark, d, "orders").withColumn("p", F.when(F.col("o_custkey") % 3 == 0, F.lit(None)).otherwise(F.col("o_totalprice")))
    return o.where(~((F.col("p") > 100000) & (F.col("o_orderstatus") == "F")) | (F.col("p") < 50000)).select("o_orderkey")


@query("SELECT l_orderkey, l_linenumber, CAST((l_linenumber - 5) // 2 AS INTEGER) AS q FROM lineitem")
def int_division(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", scalar.int_div(F.col("l_linenumber") - 5, F.lit(2), "int").alias("q"))


@query("""SELECT event_id, epoch_us(ts) // 1000 + 1000 AS shifted, epoch_us(ts) // 1000 - 1700000000123 AS since FROM events""")
def timestamp_shift(spark, d):
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    return table(spark, d, "events").select("event_id", scalar.ts_shift(ms, F.lit(1000)).alias("shifted"), scalar.ts_diff(ms, F.lit(1700000000123)).alias("since"))


@query("SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net, l_extendedprice / (l_quantity + 1) AS unit FROM lineitem")
def float_arith(spark, d):
    t = table(spark, d, "lineitem")
    net = F.col("l_extendedprice") * (F.lit(1) - F.col("l_discount"))
    return t.select("l_orderkey", "l_linenumber", net.alias("net"), scalar.float_div(F.col("l_extendedprice"), F.col("l_quantity") + 1).alias("unit"))


@query("""WITH x AS (SELECT 9007199254740992 + p_partkey AS k, CAST(9007199254740992 + p_partkey AS DOUBLE) AS r FROM part),
y AS (SELECT k, r, CASE WHEN k < CAST(floor(r) AS BIGINT) THEN -1 WHEN k > CAST(floor(r) AS BIGINT) THEN 1 WHEN r > floor(r) THEN -1 ELSE 0 END AS c FROM x)
SELECT CAST(sum(CAST(c < 0 AS INT)) AS BIGINT) AS less, CAST(sum(CAST(c = 0 AS INT)) AS BIGINT) AS equal, CAST(sum(CAST(c > 0 AS INT)) AS BIGINT) AS greater FROM y""")
def exact_bigint_double_cmp(spark, d):
    x = table(spark, d, "part").select((F.lit(9007199254740992) + F.col("p_partkey")).alias("k")).withColumn("r", F.col("k").cast("double"))
    c = scalar.exact_cmp(F.col("k"), F.col("r"))
    return x.agg(F.count_if(c < 0).alias("less"), F.count_if(c == 0).alias("equal"), F.count_if(c > 0).alias("greater"))


@query("""WITH x AS (SELECT CASE WHEN p_partkey % 2 = 0 THEN '-' ELSE '' END || CAST(p_partkey % 50 AS VARCHAR) || '.' || CAST(p_size AS VARCHAR) || '0' AS t FROM part)
SELECT t, CAST(dense_rank() OVER (ORDER BY CAST(t AS DECIMAL(18,6))) AS INTEGER) AS r FROM (SELECT DISTINCT t FROM x)""")
def decimal_text_order(spark, d):
    """Distinct numbers are dealt out by ranges and numbered in each; only the ranges' sizes meet in one task."""
    sign = F.when(F.col("p_partkey") % 2 == 0, "-").otherwise("")
    t = F.concat(sign, (F.col("p_partkey") % 50).cast("string"), F.lit("."), F.col("p_size").cast("string"), F.lit("0"))
    x = table(spark, d, "part").select(t.alias("t")).distinct().withColumn("k", scalar.decimal_key(F.col("t")))
    keys = cdc.commit_order(x.select(F.lit("").alias("tbl"), F.col("k").alias("commit_lsn"), F.lit(0).alias("lsn")).distinct())
    return x.join(keys.select(F.col("commit_lsn").alias("k"), F.col("position").cast("int").alias("r")), "k").select("t", "r")


# -- joins ---------------------------------------------------------------------------


@query("SELECT o_orderkey, c_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 200000")
def join_inner_hash(spark, d):
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    return o.where("o_totalprice > 200000").join(c, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name", "o_totalprice")


@query("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'F' AND o_totalprice > 300000")
def join_left_hash(spark, d):
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    on = (F.col("c_custkey") == F.col("o_custkey")) & (F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 300000)
    return c.join(o, on, "left").select("c_custkey", "o_orderkey")


@query("SELECT r_name, n_name FROM region JOIN nation ON r_regionkey < n_regionkey")
def join_theta_inner(spark, d):
    return table(spark, d, "region").join(table(spark, d, "nation"), F.col("r_regionkey") < F.col("n_regionkey")).select("r_name", "n_name")


@query("SELECT a.s_suppkey AS a_key, b.n_nationkey AS b_key FROM supplier a LEFT JOIN nation b ON a.s_nationkey > b.n_nationkey AND b.n_nationkey > 20")
def join_theta_left(spark, d):
    a, b = table(spark, d, "supplier"), table(spark, d, "nation").where("n_nationkey > 20")
    return a.join(b, F.col("s_nationkey") > F.col("n_nationkey"), "left").select(F.col("s_suppkey").alias("a_key"), F.col("n_nationkey").alias("b_key"))


@query("""SELECT r_name, n_name, CAST(count(*) AS BIGINT) AS n, sum(o_totalprice) AS total FROM region JOIN nation ON n_regionkey = r_regionkey
JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey GROUP BY r_name, n_name""")
def join_multiway(spark, d):
    t = lambda n: table(spark, d, n)
    per = t("orders").groupBy("o_custkey").agg(F.count("*").alias("k"), F.sum("o_totalprice").alias("s"))  # before the join: one row a customer
    j = per.join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    j = j.join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy("r_name", "n_name").agg(F.sum("k").alias("n"), F.sum("s").alias("total"))


@query("SELECT a.n_name AS left_name, b.n_name AS right_name FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def join_self_alias(spark, d):
    n = table(spark, d, "nation")
    a, b = n.alias("a"), n.alias("b")
    on = (F.col("a.n_regionkey") == F.col("b.n_regionkey")) & (F.col("a.n_nationkey") < F.col("b.n_nationkey"))
    return a.join(b, on).select(F.col("a.n_name").alias("left_name"), F.col("b.n_name").alias("right_name"))


@query("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey WHERE o_totalprice > 250000")
def left_join_right_filter(spark, d):
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    return c.join(o, F.col("c_custkey") == F.col("o_custkey"), "left").where("o_totalprice > 250000").select("c_custkey", "o_orderkey")


@query("SELECT c_custkey, o_orderkey FROM customer FULL JOIN orders ON c_custkey = o_custkey + 20")
def join_full_outer(spark, d):
    """Shifted keys, so that both sides have rows without a partner."""
    c, o = table(spark, d, "customer"), table(spark, d, "orders").withColumn("o_custkey", F.col("o_custkey") + 20)
    return c.join(o, F.col("c_custkey") == F.col("o_custkey"), "full_outer").select("c_custkey", "o_orderkey")


@query("SELECT n_name, r_name FROM nation RIGHT JOIN region ON n_regionkey = r_regionkey AND n_nationkey > 20")
def join_right_outer(spark, d):
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    return n.join(r, (F.col("n_regionkey") == F.col("r_regionkey")) & (F.col("n_nationkey") > 20), "right").select("n_name", "r_name")


# -- writes, statistics, versions -----------------------------------------------------


@query("""SELECT p_partkey, CASE WHEN p_size > 25 THEN p_size - 5 ELSE p_size END AS p_size,
CASE WHEN p_size > 25 THEN CAST(p_size AS DOUBLE) ELSE p_retailprice END AS p_retailprice FROM part""")
def dml_update_case(spark, d):
    s = lake(spark, part=table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice")).connect()
    s.execute("UPDATE part SET p_size = p_size - 5, p_retailprice = p_size * 1.0 WHERE p_size > 25")  # both right sides see the old row
    return s.query("SELECT * FROM part")


@query("SELECT p_partkey, p_size FROM part WHERE NOT coalesce(p_size > 40, FALSE)")
def dml_delete(spark, d):
    s = lake(spark, part=table(spark, d, "part").select("p_partkey", "p_size")).connect()
    s.execute("DELETE FROM part WHERE p_size > 40")
    return s.query("SELECT * FROM part")


@query("""WITH new AS (SELECT p_partkey + 100 AS p_partkey, p_size FROM part)
SELECT p_partkey, p_size FROM part UNION ALL SELECT p_partkey, p_size FROM new WHERE p_partkey NOT IN (SELECT p_partkey FROM part)""")
def dml_insert_unique(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_size")
    engine = lake(spark, part=p)
    engine.load("part", p.withColumn("p_partkey", F.col("p_partkey") + 100), [], skip_present=True)
    return engine.view("part")


@query(" UNION ALL ".join(
    f"""SELECT '{c}' AS "column", CAST(count(*) AS BIGINT) AS row_count, CAST(count(DISTINCT {c}) AS BIGINT) AS n_distinct,
CAST(sum(CAST({c} IS NULL AS INT)) AS BIGINT) AS n_nulls, CAST(min({c}) AS VARCHAR) AS min, CAST(max({c}) AS VARCHAR) AS max FROM part"""
    for c in ("p_partkey", "p_brand", "p_type", "p_size")))
def analyze_stats(spark, d):
    return mvcc.analyze(table(spark, d, "part"), ["p_partkey", "p_brand", "p_type", "p_size"])


_VERSIONS = """v AS (SELECT o_custkey AS k, o_orderkey AS begin_ts, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey + 50 ELSE 0 END AS end_ts, o_totalprice AS val FROM orders),
s AS (SELECT *, (begin_ts < 900 AND begin_ts NOT IN (100, 101, 102)) AS b, (end_ts < 900 AND end_ts NOT IN (100, 101, 102)) AS e FROM v),
vis AS (SELECT * FROM s WHERE b AND NOT (end_ts <> 0 AND e))"""


def _versions(spark, d):
    o = table(spark, d, "orders")
    end = F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderkey") + 50).otherwise(F.lit(0))
    return o.select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("begin_ts"), end.cast("bigint").alias("end_ts"), F.col("o_totalprice").alias("val"))


@query(f"WITH {_VERSIONS} SELECT k, begin_ts, CAST(end_ts AS BIGINT) AS end_ts, val FROM vis QUALIFY row_number() OVER (PARTITION BY k ORDER BY begin_ts DESC) = 1")
def mvcc_visible_versions(spark, d):
    return mvcc.resolve(_versions(spark, d), "k", 900, [100, 101, 102])


@query("""WITH w AS (SELECT o_custkey AS k, o_orderkey AS begin_ts FROM orders WHERE o_orderkey >= 900)
SELECT k, CAST(min(begin_ts) AS BIGINT) AS first_writer, CAST(count(*) - 1 AS BIGINT) AS refused FROM w GROUP BY k HAVING count(*) > 1""")
def mvcc_write_conflicts(spark, d):
    return mvcc.write_conflicts(_versions(spark, d), "k", 900, [])


# -- branches -----------------------------------------------------------------------------


def _delta(spark, d, n: int, amount: int):
    """A branch's overlay of part: every n-th row less by an amount, every 7n-th deleted, and some new rows."""
    p = table(spark, d, "part").select("p_partkey", "p_size")
    k = F.col("p_partkey")
    changed = p.where(k % n == 0).select(k, (F.col("p_size") - amount).alias("p_size"), (k % (7 * n) == 0).alias("_deleted"))
    new = p.where(k % (11 * n) == 0).select((k + 1_000_000).alias("p_partkey"), "p_size", F.lit(False).alias("_deleted"))
    return p, changed.unionByName(new)


def _delta_sql(n: int, amount: int) -> str:
    return f"""d{n} AS (SELECT p_partkey, p_size - {amount} AS p_size, p_partkey % {7 * n} = 0 AS del FROM part WHERE p_partkey % {n} = 0
UNION ALL SELECT p_partkey + 1000000, p_size, FALSE FROM part WHERE p_partkey % {11 * n} = 0),
b{n} AS (SELECT p_partkey, p_size FROM part WHERE p_partkey NOT IN (SELECT p_partkey FROM d{n}) UNION ALL SELECT p_partkey, p_size FROM d{n} WHERE NOT del)"""


@query(f"WITH {_delta_sql(3, 2)} SELECT p_partkey, p_size FROM b3")
def branch_overlay_view(spark, d):
    p, delta = _delta(spark, d, 3, 2)
    return overlay.overlay(p, delta, "p_partkey")


@query(f"WITH {_delta_sql(5, 4)} SELECT p_partkey, p_size FROM b5 WHERE p_size > 20")
def as_of_branch(spark, d):
    p, delta = _delta(spark, d, 5, 4)
    return overlay.overlay(p, delta, "p_partkey").where("p_size > 20")


@query(f"""WITH {_delta_sql(3, 2)} SELECT coalesce(a.p_partkey, b.p_partkey) AS p_partkey,
CASE WHEN a.p_partkey IS NULL THEN 'INSERT' WHEN b.p_partkey IS NULL THEN 'DELETE' ELSE 'UPDATE' END AS kind, a.p_size AS size_before, b.p_size AS size_after
FROM part a FULL JOIN b3 b ON a.p_partkey = b.p_partkey WHERE a.p_partkey IS NULL OR b.p_partkey IS NULL OR a.p_size IS DISTINCT FROM b.p_size""")
def branch_diff(spark, d):
    p, delta = _delta(spark, d, 3, 2)
    # only rows that the branch touched can differ, so the base is cut to them before the full join
    touched = p.join(delta.select("p_partkey"), "p_partkey", "left_semi")
    diff = overlay.row_diff(touched, delta.where("not _deleted").drop("_deleted"), "p_partkey")
    return diff.select("p_partkey", "kind", F.col("before.p_size").alias("size_before"), F.col("after.p_size").alias("size_after"))


@query("""SELECT user_id AS key, CAST(max_by(value, event_id) AS DOUBLE) AS value, max_by(event_type, event_id) = 'error' AS _deleted FROM events GROUP BY user_id""")
def branch_latest_images(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("key"), "event_id", "value", (F.col("event_type") == "error").alias("_deleted"))
    return overlay.latest(e, "key", "event_id").drop("event_id")


# -- merge --------------------------------------------------------------------------------------


@query("""SELECT p_partkey AS key, CAST(p_size - CASE WHEN p_partkey % 2 = 0 THEN 5 ELSE 0 END - CASE WHEN p_partkey % 3 = 0 THEN 3 ELSE 0 END AS BIGINT) AS value,
CASE WHEN p_partkey % 6 = 0 THEN 'Commuting' WHEN p_partkey % 2 = 0 OR p_partkey % 3 = 0 THEN 'Clean' ELSE 'Untouched' END AS outcome FROM part""")
def merge_add_commute(spark, d):
    """Two branches decrement overlapping parts; additions commute."""
    base = table(spark, d, "part").select(F.col("p_partkey").alias("key"), F.lit("p_size").alias("col"), F.col("p_size").cast("bigint").alias("b"))
    side = lambda name, n, txn, v: base.where(F.col("key") % n == 0).select(
        F.lit(name).alias("side"), (F.col("key") * 10 + txn).alias("txn"), F.lit(1).cast("bigint").alias("seq"), F.lit(0).alias("pos"), "key", "col", F.lit("Add").alias("kind"), F.lit(v).cast("bigint").alias("v"))
    cells, _ = merge.three_way_merge(base, side("ours", 2, 1, -5).unionByName(side("theirs", 3, 2, -3)))
    m = base.select("key", "b").join(cells.select("key", "value", "outcome"), "key", "left")
    return m.select("key", F.coalesce("value", "b").alias("value"), F.coalesce("outcome", F.lit("Untouched")).alias("outcome"))


def _cell_ops(spark, d, kinds: tuple[str, str]):
    """Both sides operate on part.p_size: ours on even keys by their modulus, theirs on every third."""
    base = table(spark, d, "part").select(F.col("p_partkey").alias("key"), F.lit("p_size").alias("col"), F.col("p_size").cast("bigint").alias("b"))
    row = lambda side, kind, n, txn, v: base.where(F.col("key") % n == 0).select(
        F.lit(side).alias("side"), (F.col("key") * 10 + txn).alias("txn"), F.lit(1).cast("bigint").alias("seq"), F.lit(0).alias("pos"),
        "key", "col", F.lit(kind).alias("kind"), v.cast("bigint").alias("v"))
    k = F.col("key")
    return base, row("ours", kinds[0], 2, 1, k % 40).unionByName(row("theirs", kinds[1], 3, 2, k % 30))


_AB = "x AS (SELECT p_partkey AS key, CAST(p_size AS BIGINT) AS b, p_partkey % 2 = 0 AS o, p_partkey % 3 = 0 AS t, CAST(p_partkey % 40 AS BIGINT) AS ov, CAST(p_partkey % 30 AS BIGINT) AS tv FROM part WHERE p_partkey % 2 = 0 OR p_partkey % 3 = 0)"


def _cells(spark, d, kinds, policy):
    base, ops = _cell_ops(spark, d, kinds)
    cells, _ = merge.three_way_merge(base, ops, {"p_size": policy})
    return cells


@query(f"WITH {_AB} SELECT key, CASE WHEN o AND t AND ov <> tv THEN NULL WHEN o THEN ov ELSE tv END AS value, CASE WHEN NOT (o AND t) THEN 'Clean' WHEN ov = tv THEN 'Commuting' ELSE 'Conflict' END AS outcome FROM x")
def merge_policy_reject(spark, d):
    return _cells(spark, d, ("Assign", "Assign"), merge.REJECT).select("key", "value", "outcome")


@query(f"""WITH {_AB} SELECT key, CASE WHEN NOT t THEN ov ELSE tv END AS value, CASE WHEN NOT (o AND t) THEN 'Clean' WHEN ov = tv THEN 'Commuting' ELSE 'ResolvedWithLoss' END AS outcome,
CASE WHEN o AND t AND ov <> tv THEN 'ours' END AS lost_side, CASE WHEN o AND t AND ov <> tv THEN ov END AS lost_v FROM x""")
def merge_policy_lww(spark, d):
    return _cells(spark, d, ("Assign", "Assign"), merge.LWW).select("key", "value", "outcome", "lost_side", "lost_v")


@query(f"WITH {_AB} SELECT key, CASE WHEN NOT t THEN ov WHEN NOT o THEN b + tv ELSE b + (ov - b) + tv END AS value, CASE WHEN o AND t THEN 'Commuting' ELSE 'Clean' END AS outcome FROM x")
def merge_policy_additive(spark, d):
    return _cells(spark, d, ("Assign", "Add"), merge.ADDITIVE).select("key", "value", "outcome")


@query(f"""WITH {_AB} SELECT key, CASE WHEN NOT t THEN ov ELSE greatest(b, tv) END AS value, CASE WHEN o AND t THEN 'Commuting' ELSE 'Clean' END AS outcome,
CASE WHEN o AND t THEN 'ours Assign ' || ov || ', theirs Max ' || tv END AS kept FROM x""")
def merge_policy_multivalue(spark, d):
    spelled = F.array_join(F.transform("kept", lambda x: F.concat_ws(" ", x["side"], x["kind"], x["v"].cast("string"))), ", ")
    return _cells(spark, d, ("Assign", "Max"), merge.MULTI).select("key", "value", "outcome", spelled.alias("kept"))


@query(f"""WITH {_AB} SELECT key, 'max' AS kind, CASE WHEN NOT t THEN greatest(b, ov) WHEN NOT o THEN greatest(b, tv) ELSE greatest(b, ov, tv) END AS value FROM x
UNION ALL SELECT key, 'min', CASE WHEN NOT t THEN least(b, ov) WHEN NOT o THEN least(b, tv) ELSE least(b, ov, tv) END FROM x""")
def merge_max_min(spark, d):
    one = lambda kind: _cells(spark, d, (kind, kind), merge.REJECT).select("key", F.lit(kind.lower()).alias("kind"), "value")
    return one("Max").unionByName(one("Min"))


@query("""WITH x AS (SELECT p_partkey AS key, CAST(p_size AS BIGINT) AS b FROM part)
SELECT key, CASE WHEN key % 3 = 0 THEN greatest(CAST(7 AS BIGINT) - 2, 6) ELSE greatest(b + 4, 30) - 1 END AS value FROM x""")
def merge_fold_order(spark, d):
    """One side's operations on a cell in order: Assign 7, Add -2, Max 6 on some keys; Add 4, Max 30, Add -1 on the others."""
    base = table(spark, d, "part").select(F.col("p_partkey").alias("key"), F.lit("p_size").alias("col"), F.col("p_size").cast("bigint").alias("b"))
    lists = F.when(F.col("key") % 3 == 0, F.expr("array(struct('Assign' as kind, 7L as v), struct('Add' as kind, -2L as v), struct('Max' as kind, 6L as v))")).otherwise(
        F.expr("array(struct('Add' as kind, 4L as v), struct('Max' as kind, 30L as v), struct('Add' as kind, -1L as v))"))
    ops = base.select("key", "col", F.posexplode(lists).alias("pos", "op")).select(
        F.lit("ours").alias("side"), F.col("key").alias("txn"), F.lit(1).alias("seq"), "pos", "key", "col", "op.kind", "op.v")
    return merge.compose_cells(merge.fold_sides(ops, base)).select("key", "value")


_ROWS = """r AS (SELECT p_partkey AS key, CASE WHEN p_partkey % 4 = 0 THEN 'RowDelete' WHEN p_partkey % 4 = 1 THEN 'Add' END AS o,
CASE WHEN p_partkey % 6 = 0 THEN 'RowDelete' WHEN p_partkey % 5 = 0 THEN 'Add' END AS t FROM part)"""


def _row_ops(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("key"))
    k = F.col("key")
    kinds = {"ours": F.when(k % 4 == 0, "RowDelete").when(k % 4 == 1, "Add"), "theirs": F.when(k % 6 == 0, "RowDelete").when(k % 5 == 0, "Add")}
    out = None
    for n, (side, kind) in enumerate(kinds.items()):
        o = p.withColumn("kind", kind).where("kind is not null").select(
            F.lit(side).alias("side"), (k * 10 + n).alias("txn"), F.lit(1).alias("seq"), F.lit(0).alias("pos"), "key",
            F.when(F.col("kind") == "Add", "p_size").alias("col"), "kind", F.when(F.col("kind") == "Add", F.lit(1)).cast("bigint").alias("v"))
        out = o if out is None else out.unionByName(o)
    return out


@query(f"""WITH {_ROWS} SELECT key, CASE WHEN o IS NOT NULL AND t IS NOT NULL AND (o = 'RowDelete') <> (t = 'RowDelete') THEN 'Conflict'
WHEN o IS NOT NULL AND t IS NOT NULL THEN 'Commuting' ELSE 'Clean' END AS row_outcome,
CASE WHEN o IS NOT NULL AND t IS NOT NULL AND (o = 'RowDelete') <> (t = 'RowDelete') THEN 'DeleteVsWrite' END AS row_reason FROM r WHERE o = 'RowDelete' OR t = 'RowDelete'""")
def merge_delete_vs_write(spark, d):
    return merge.compose_rows(_row_ops(spark, d)).select("key", "row_outcome", "row_reason")


@query(f"""WITH {_AB} SELECT outcome, CAST(count(*) AS BIGINT) AS n FROM (SELECT CASE WHEN NOT (o AND t) THEN 'Clean' WHEN ov = tv THEN 'Commuting' ELSE 'Conflict' END AS outcome FROM x) GROUP BY outcome""")
def merge_outcomes_by_row(spark, d):
    return _cells(spark, d, ("Assign", "Assign"), merge.REJECT).groupBy("outcome").agg(F.count("*").alias("n"))


@query(f"WITH {_AB} SELECT CASE WHEN count(*) FILTER (WHERE o AND t AND ov <> tv) > 0 THEN 'ResolvedWithLoss' ELSE 'Commuting' END AS outcome FROM x")
def merge_overall_outcome(spark, d):
    return _cells(spark, d, ("Assign", "Assign"), merge.LWW).agg(merge.overall().alias("outcome"))


@query("""SELECT event_type AS tbl, CAST(count(DISTINCT user_id % 3) AS BIGINT) AS n FROM events WHERE user_id % 3 = 0 OR event_type = 'click' GROUP BY event_type HAVING count(DISTINCT user_id % 3) > 1""")
def merge_schema_mismatch(spark, d):
    frames = table(spark, d, "events").select(F.col("event_type").alias("tbl"), (F.col("user_id") % 3).alias("schema_ver")).where("schema_ver = 0 or tbl = 'click'")
    return merge.schema_conflicts(frames).select("tbl", F.size("versions").cast("bigint").alias("n"))


@query(f"WITH {_AB} SELECT key, CASE WHEN o AND t THEN b + ov + tv WHEN o THEN b + ov ELSE b + tv END AS value FROM x WHERE CASE WHEN o AND t THEN b + ov + tv WHEN o THEN b + ov ELSE b + tv END > 60")
def merge_bound_recheck(spark, d):
    base, ops = _cell_ops(spark, d, ("Add", "Add"))
    cells, _ = merge.three_way_merge(base, ops)
    bounds = base.select("key", "col", F.lit(0).cast("bigint").alias("floor"), F.lit(60).cast("bigint").alias("ceiling"))
    return merge.bound_breaks(cells, bounds).select("key", "value")


@query("""WITH base AS (SELECT p_partkey AS key, CAST(p_size AS BIGINT) AS b FROM part)
SELECT key, CAST(1 AS INTEGER) AS txn, b >= 15 AS ok, CASE WHEN b >= 15 THEN b - 15 ELSE b END AS value FROM base
UNION ALL SELECT key, 2, (CASE WHEN b >= 15 THEN b - 15 ELSE b END) >= 15, CASE WHEN b >= 30 THEN b - 30 WHEN b >= 15 THEN b - 15 ELSE b END FROM base""")
def merge_guard_recheck(spark, d):
    base = table(spark, d, "part").select(F.col("p_partkey").alias("key"), F.col("p_size").cast("bigint").alias("b"))
    ops = base.select("key", F.explode(F.array(F.lit(1), F.lit(2))).alias("txn"), F.lit(1).alias("seq"), F.lit(15).cast("bigint").alias("need"), F.lit(-15).cast("bigint").alias("v"))
    return merge.guarded_adds(base, ops).select("key", "txn", "ok", "value")


@query("SELECT p_partkey AS key, CAST(p_size - 18 AS BIGINT) AS lowest, p_size - 18 < 0 AS breaks FROM part")
def merge_floor_guard_negative(spark, d):
    """A precondition qty >= 0 does not protect the floor: both decrements hold it and the result may be negative."""
    base = table(spark, d, "part").select(F.col("p_partkey").alias("key"), F.col("p_size").cast("bigint").alias("b"))
    ops = base.select("key", F.explode(F.array(F.lit(1), F.lit(2))).alias("txn"), F.lit(1).alias("seq"), F.lit(-9).cast("bigint").alias("v"))
    return escrow.running_floor(base, ops)


@query("""SELECT p_partkey AS cell, CAST(CASE WHEN p_size >= 15 THEN 1 ELSE 0 END + CASE WHEN p_size - CASE WHEN p_size >= 15 THEN 15 ELSE 0 END >= 25 THEN 1 ELSE 0 END AS BIGINT) AS granted,
CAST(CASE WHEN p_size >= 15 THEN 15 ELSE 0 END + CASE WHEN p_size - CASE WHEN p_size >= 15 THEN 15 ELSE 0 END >= 25 THEN 25 ELSE 0 END AS BIGINT) AS claimed FROM part""")
def escrow_budget(spark, d):
    cells = table(spark, d, "part").select(F.col("p_partkey").alias("cell"), F.col("p_size").cast("bigint").alias("slack"))
    claims = cells.select("cell", F.explode(F.expr("array(struct(1 as seq, 'b_1' as branch, 15L as amount), struct(2 as seq, 'b_2' as branch, 25L as amount))")).alias("c")).select("cell", "c.*")
    done = escrow.grant_claims(cells, claims)
    return done.groupBy("cell").agg(F.count_if("granted").alias("granted"), F.sum(F.when(F.col("granted"), F.col("amount")).otherwise(0)).alias("claimed"))


@query("""SELECT user_id AS cell, event_type AS branch, CAST(sum(CASE WHEN event_id % 2 = 0 THEN 3 ELSE 0 END) AS BIGINT) AS claimed,
CAST(sum(CASE WHEN event_id % 2 = 1 THEN 1 ELSE 0 END) AS BIGINT) AS spent, FALSE AS closed FROM events GROUP BY user_id, event_type""")
def escrow_outstanding(spark, d):
    even = F.col("event_id") % 2 == 0
    ledger = table(spark, d, "events").select(F.col("user_id").alias("cell"), F.col("event_type").alias("branch"), F.when(even, "Claim").otherwise("Spend").alias("act"), F.when(even, 3).otherwise(1).cast("bigint").alias("amount"))
    return escrow.outstanding(ledger)


@query("SELECT user_id AS key, CAST(sum(event_id % 10) AS BIGINT) AS total FROM events GROUP BY user_id")
def txn_dedup_replay(spark, d):
    e = table(spark, d, "events")
    ops = e.select(F.lit("ours").alias("side"), F.col("event_id").alias("txn"), F.lit(1).alias("seq"), F.col("user_id").alias("key"), (F.col("event_id") % 10).alias("v"))
    replay = ops.where("txn % 3 = 0").withColumn("side", F.lit("theirs"))
    return merge.dedup_frames(ops.unionByName(replay)).groupBy("key").agg(F.sum("v").alias("total"))


@query("""SELECT DISTINCT i.user_id AS key, i.event_type AS elem FROM events i WHERE i.event_id % 2 = 0
AND NOT EXISTS (SELECT 1 FROM events r WHERE r.event_id % 5 = 0 AND r.user_id = i.user_id AND r.event_id = i.event_id)""")
def orset_merge(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_type").alias("elem"), F.col("event_id").alias("dot"))
    return merge.orset_merge(e.where("dot % 2 = 0"), e.where("dot % 5 = 0"))


@query("""WITH o AS (SELECT user_id AS key, event_type AS elem, event_id AS dot, CASE WHEN event_id % 2 = 0 THEN 'ours' ELSE 'theirs' END AS side, 'Insert' AS act FROM events
UNION ALL SELECT user_id, NULL, event_id, 'theirs', 'Remove' FROM events WHERE event_id % 3 = 0),
s AS (SELECT key, CASE WHEN count(DISTINCT side) > 1 THEN 'Commuting' ELSE 'Clean' END AS outcome FROM o GROUP BY key),
l AS (SELECT DISTINCT key, elem FROM o WHERE act = 'Insert' AND dot % 3 <> 0)
SELECT s.key, l.elem, s.outcome FROM s LEFT JOIN l ON s.key = l.key""")
def merge_set_union(spark, d):
    """Both sides insert into a set-valued column, one also removes what it saw."""
    e = table(spark, d, "events").select(F.col("user_id").alias("key"), F.lit("tags").alias("col"), F.col("event_type").alias("elem"), F.col("event_id").alias("dot"))
    inserts = e.withColumn("side", F.when(F.col("dot") % 2 == 0, merge.OURS).otherwise(merge.THEIRS)).withColumn("act", F.lit("Insert"))
    removes = e.where("dot % 3 = 0").withColumn("elem", F.lit(None).cast("string")).withColumn("side", F.lit(merge.THEIRS)).withColumn("act", F.lit("Remove"))
    return merge.compose_sets(inserts.unionByName(removes)).select("key", "elem", "outcome")


# -- provenance ---------------------------------------------------------------------------------------


@query("""SELECT DISTINCT w.user_id AS key FROM events w WHERE w.event_id % 2 = 0 AND NOT EXISTS (SELECT 1 FROM events r WHERE r.event_id % 8 = 1 AND r.event_type = 'click' AND r.user_id = w.user_id)""")
def blind_writes(spark, d):
    e = table(spark, d, "events").select(F.lit("t").alias("tbl"), F.col("user_id").alias("key"), "event_id", "event_type")
    writes = e.where("event_id % 2 = 0").select("tbl", "key").distinct()
    return overlay.blind_writes(writes, e.where("event_id % 8 = 1 and event_type = 'click'")).select("key")


@query("""WITH v AS (SELECT user_id AS key, max(event_id) AS now FROM events GROUP BY user_id)
SELECT e.user_id AS key, e.event_id AS version, v.now AS version_now FROM events e JOIN v ON v.key = e.user_id WHERE e.event_id <> v.now""")
def read_premise_moved(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("version"))
    return provenance.moved_premises(e, e.groupBy("key").agg(F.max("version").alias("version")))


_EDGES = """w AS (SELECT event_id AS txn, user_id AS key, event_id AS version FROM events),
rd AS (SELECT event_id AS txn, user_id AS key, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS version FROM events),
edges AS (SELECT DISTINCT w.txn AS writer, rd.txn AS reader FROM w JOIN rd ON w.key = rd.key AND w.version = rd.version WHERE rd.txn % 3 <> 0)"""


def _edges(spark, d):
    """Each event's transaction wrote its user's row; two of three also read the version before."""
    e = table(spark, d, "events").select(F.col("event_id").alias("txn"), F.col("user_id").alias("key"), F.col("event_id").alias("version"))
    reads = e.withColumn("version", F.lag("version").over(Window.partitionBy("key").orderBy("version"))).where("txn % 3 <> 0")
    return provenance.dependency_edges(e, reads)


@query(f"WITH {_EDGES} SELECT writer, reader FROM edges")
def dependency_edges(spark, d):
    return _edges(spark, d)


@query("""SELECT DISTINCT w.event_id AS writer, r.s_suppkey AS reader FROM events w JOIN supplier r
ON w.value >= r.s_suppkey AND w.value < r.s_suppkey + 2 AND w.event_id < 20 * r.s_suppkey WHERE w.event_id <> r.s_suppkey""")
def dependency_range_edges(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("txn"), F.lit("t").alias("tbl"), F.col("user_id").alias("key"), F.col("event_id").alias("version"), "value", F.col("event_id").alias("ts"))
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("txn"), F.lit("t").alias("tbl"), F.col("s_suppkey").cast("double").alias("lo"), (F.col("s_suppkey") + 2).cast("double").alias("hi"), (F.col("s_suppkey") * 20).alias("observed_at"))
    none = e.select("txn", "key", "version").where("false")
    return provenance.dependency_edges(e, none, s)


@query(f"""WITH RECURSIVE {_EDGES}, c(root, txn) AS (SELECT writer, reader FROM edges WHERE writer % 100 = 0 UNION SELECT c.root, e.reader FROM c JOIN edges e ON e.writer = c.txn)
SELECT root, txn FROM c WHERE root <> txn""")
def revert_cascade_closure(spark, d):
    """What depends on each merge of a stated query set, the ids divisible by 100."""
    edges = _edges(spark, d)
    return provenance.dependents(edges, edges.where("writer % 100 = 0").select(F.col("writer").alias("root")))


@query("""SELECT p_partkey AS key, CASE WHEN p_partkey % 3 = 0 THEN 'Add' WHEN p_partkey % 3 = 1 THEN 'Assign' END AS kind,
CASE WHEN p_partkey % 3 = 0 THEN CAST(-p_size AS BIGINT) WHEN p_partkey % 3 = 1 THEN CAST(p_size + 1 AS BIGINT) END AS v FROM part""")
def revert_inverse_ops(spark, d):
    k = F.col("p_partkey") % 3
    ops = table(spark, d, "part").select(F.col("p_partkey").alias("key"), F.when(k == 0, "Add").when(k == 1, "Assign").otherwise("Max").alias("kind"), F.col("p_size").cast("bigint").alias("v"), (F.col("p_size") + 1).cast("bigint").alias("witness"))
    return merge.inverse_ops(ops).select("key", "kind", "v")


@query("SELECT user_id AS key, max_by(event_type, event_id) AS author FROM events GROUP BY user_id")
def who_wrote_row(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_type").alias("author"), F.col("event_id").alias("version"))
    return provenance.last_writer(e)


@query("SELECT event_type AS author, CAST(count(DISTINCT user_id) AS BIGINT) AS n FROM events GROUP BY event_type")
def rows_written_by(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_type").alias("author"))
    return provenance.authors_of(e).select(F.explode("authors").alias("author")).groupBy("author").agg(F.count("*").alias("n"))


@query("""SELECT o.o_orderkey AS file FROM orders o WHERE NOT EXISTS (SELECT 1 FROM (SELECT user_id % 100 AS owner, event_id AS e FROM events) f
WHERE f.owner = o.o_custkey % 100 AND f.e >= o.o_orderkey AND f.e < o.o_orderkey + 40)""")
def reclaimable_files(spark, d):
    files = table(spark, d, "orders").select((F.col("o_custkey") % 100).alias("owner"), F.col("o_orderkey").alias("file"), F.col("o_orderkey").alias("birth"), (F.col("o_orderkey") + 40).alias("freed"))
    forks = table(spark, d, "events").select((F.col("user_id") % 100).alias("owner"), F.col("event_id").alias("fork_epoch"))
    return mvcc.reclaimable(files, forks).select("file")


# -- sessions --------------------------------------------------------------------------------------------


def _part(spark, d, more: int = 0):
    return table(spark, d, "part").select("p_partkey", (F.col("p_size") + more).alias("p_size"), "p_retailprice")


@query("""SELECT p_partkey, CAST(p_size - CASE WHEN p_partkey < 150 THEN 5 ELSE 0 END + CASE WHEN p_partkey >= 50 THEN 3 ELSE 0 END AS BIGINT) AS p_size,
CASE WHEN p_partkey < 40 THEN 1.5 ELSE p_retailprice END AS p_retailprice FROM part WHERE p_partkey < 190 OR p_partkey >= 195""")
def session_merge_commute(spark, d):
    """Two sessions' additions meet in the trunk, beside an assignment and a deletion of one of them."""
    e = lake(spark, part=_part(spark, d))
    a = agent(e, "a", "UPDATE part SET p_size = p_size - 5 WHERE p_partkey < 150", "UPDATE part SET p_retailprice = 1.5 WHERE p_partkey < 40")
    b = agent(e, "b", "UPDATE part SET p_size = 3 + p_size WHERE p_partkey >= 50", "DELETE FROM part WHERE p_partkey >= 190 AND p_partkey < 195")
    a.execute("MERGE")
    b.execute("MERGE")
    return e.view("part").withColumn("p_size", F.col("p_size").cast("bigint"))


@query("""SELECT CAST(p_partkey AS VARCHAR) AS key, 'ContradictoryAssign' AS reason FROM part WHERE p_partkey < 120 AND p_size <> 1
UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'DeleteVsWrite' FROM part WHERE p_partkey >= 120 AND p_partkey < 140""")
def session_merge_conflicts(spark, d):
    e = lake(spark, part=_part(spark, d))
    a = agent(e, "a", "UPDATE part SET p_size = 1 WHERE p_partkey < 120", "DELETE FROM part WHERE p_partkey >= 120 AND p_partkey < 140")
    b = agent(e, "b", "UPDATE part SET p_size = 2 WHERE p_partkey < 160")
    a.execute("MERGE")
    return e.conflicts(b.execute("MERGE").report["merge"]).select("key", "reason")


@query("SELECT CAST(p_partkey AS VARCHAR) AS key, 'BoundViolated' AS reason FROM part WHERE p_size < 5")
def session_bound_recheck(spark, d):
    """Both decrements keep the floor alone; the merged value does not."""
    e = lake(spark, part=_part(spark, d, 10))
    e.bounds["part", "p_size"] = (5, None)
    a, b = (agent(e, name, "UPDATE part SET p_size = p_size - 5") for name in "ab")
    a.execute("MERGE")
    return e.conflicts(b.execute("MERGE").report["merge"]).select("key", "reason")


@query("""SELECT 'part' AS tbl, CAST(p_partkey AS VARCHAR) AS key, CASE WHEN p_partkey >= 60 THEN 'DELETE' ELSE 'UPDATE' END AS kind,
CASE WHEN p_partkey >= 60 THEN '' WHEN p_partkey < 20 THEN 'p_retailprice: Assign, p_size: Add' ELSE 'p_size: Add' END AS ops, CASE WHEN p_partkey < 10 THEN 'pending (target moved)' ELSE 'pending' END AS status
FROM part WHERE p_partkey < 70""")
def session_diff_ops(spark, d):
    e = lake(spark, part=_part(spark, d))
    a = agent(e, "a", "UPDATE part SET p_size = p_size + 1 WHERE p_partkey < 60", "UPDATE part SET p_retailprice = 0.25 WHERE p_partkey < 20", "DELETE FROM part WHERE p_partkey >= 60 AND p_partkey < 70")
    e.connect().execute("UPDATE part SET p_size = 1000 WHERE p_partkey < 10")
    return a.execute("DIFF").df.select("tbl", "key", "kind", F.array_join("ops", ", ").alias("ops"), "status")


@query("SELECT p_partkey, CAST(CASE WHEN p_partkey >= 120 THEN 7 WHEN p_partkey >= 100 THEN 12 ELSE p_size END AS INTEGER) AS p_size, p_retailprice FROM part")
def session_revert(spark, d):
    """A merge is undone by the inverse of its operations, also below a later one that stays."""
    e = lake(spark, part=_part(spark, d))
    a = agent(e, "a", "UPDATE part SET p_size = p_size - 5 WHERE p_partkey < 120", "DELETE FROM part WHERE p_partkey < 9").execute("MERGE").report["merge"]
    agent(e, "b", "UPDATE part SET p_size = 7 WHERE p_partkey >= 100").execute("MERGE")
    e.connect().execute(f"REVERT MERGE {a}")
    return e.view("part")


@query("SELECT 'part' AS tbl, 'SchemaMismatch' AS reason, FALSE AS published, CAST(count(*) AS BIGINT) AS trunk_rows FROM part")
def session_schema_mismatch(spark, d):
    """The target's table was made anew with other columns while a branch worked on the old one."""
    e = lake(spark, part=_part(spark, d))
    a = agent(e, "a", "UPDATE part SET p_size = 1 WHERE p_partkey < 50")
    e.connect().execute("DROP TABLE part")
    new = table(spark, d, "part").select("p_partkey", "p_retailprice")
    e.load("part", new, [Field("p_partkey", "BIGINT", 0, False), Field("p_retailprice", "FLOAT")])
    report = a.execute("MERGE").report
    found = report["conflicts"][0]
    return e.view("part").agg(F.lit(found["table"]).alias("tbl"), F.lit(found["reason"]).alias("reason"), F.lit(report["published"]).alias("published"), F.count("*").alias("trunk_rows"))


# -- change feed ------------------------------------------------------------------------------------------


def _changes(spark, d):
    """events as a change log: seven rows a transaction; every fifth transaction aborts, every eleventh stays open."""
    e = table(spark, d, "events")
    txn = F.floor(F.col("event_id") / 7) + 1
    op = F.when(F.col("event_type") == "error", "DELETE").when(F.col("event_id") % 4 == 0, "INSERT").otherwise("UPDATE")
    changes = e.select(txn.cast("bigint").alias("txn"), F.col("event_id").alias("lsn"), F.lit("t").alias("tbl"), op.alias("op"), F.col("user_id").alias("key"), "value")
    end = F.when(F.col("txn") % 5 == 0, "ABORT").otherwise("COMMIT")
    ends = changes.groupBy("txn").agg(F.max("lsn").alias("last")).where("txn % 11 <> 0").select("txn", end.alias("op"), (1_000_000 + F.col("last")).alias("lsn"), (1_000_001 + F.col("last")).alias("end_lsn"))
    return changes, ends


_FEED = """ch AS (SELECT CAST(event_id // 7 + 1 AS BIGINT) AS txn, event_id AS lsn, CASE WHEN event_type = 'error' THEN 'DELETE' WHEN event_id % 4 = 0 THEN 'INSERT' ELSE 'UPDATE' END AS op, user_id AS key, value FROM events),
en AS (SELECT txn, max(lsn) AS last FROM ch GROUP BY txn), co AS (SELECT txn, 1000000 + last AS commit_lsn, 1000001 + last AS commit_end_lsn FROM en WHERE txn % 11 <> 0 AND txn % 5 <> 0),
f AS (SELECT ch.*, commit_lsn, commit_end_lsn FROM ch JOIN co ON ch.txn = co.txn)"""


@query(f"WITH {_FEED} SELECT lsn, txn, op, CAST(commit_lsn AS BIGINT) AS commit_lsn, CAST(row_number() OVER (ORDER BY commit_lsn, lsn) AS BIGINT) AS position FROM f")
def cdc_commit_order(spark, d):
    return cdc.commit_order(cdc.decode(*_changes(spark, d))).select("lsn", "txn", "op", "commit_lsn", "position")


@query(f"""WITH {_FEED}, k AS (SELECT ch.txn, lsn % 13 <> 0 AS known, e.txn IS NULL AS opened, ch.txn % 5 = 0 AS aborted FROM ch LEFT JOIN (SELECT txn FROM en WHERE txn % 11 <> 0) e ON e.txn = ch.txn)
SELECT CAST(count(*) FILTER (WHERE NOT opened AND NOT aborted AND known) AS BIGINT) AS emitted, CAST(count(*) FILTER (WHERE opened) AS BIGINT) AS withheld,
CAST(count(*) FILTER (WHERE NOT opened AND aborted) AS BIGINT) AS discarded, CAST(count(*) FILTER (WHERE NOT opened AND NOT aborted AND NOT known) AS BIGINT) AS unknown_table, CAST(0 AS BIGINT) AS undecodable FROM k""")
def cdc_decode_report(spark, d):
    changes, ends = _changes(spark, d)
    return cdc.decode_report(changes.withColumn("tbl", F.when(F.col("lsn") % 13 == 0, "dropped").otherwise("t")), ends, ["t"])


@query(f"WITH {_FEED} SELECT txn, CAST(min(lsn) AS BIGINT) AS first_lsn FROM ch WHERE txn % 11 = 0 GROUP BY txn")
def cdc_aborted_open(spark, d):
    return cdc.open_transactions(*_changes(spark, d))



_LAST = "g AS (SELECT key, op, value, commit_lsn, lsn FROM f QUALIFY row_number() OVER (PARTITION BY key ORDER BY commit_lsn DESC, lsn DESC) = 1)"


@query(f"WITH {_FEED}, {_LAST} SELECT key, value FROM g WHERE op <> 'DELETE'")
def cdc_fold_latest(spark, d):
    return cdc.fold(cdc.decode(*_changes(spark, d)), "key", ["value"])


@query(f"WITH {_FEED} SELECT lsn, txn FROM f WHERE NOT (txn < 60 AND txn NOT IN (12, 13, 37)) AND commit_lsn > 1000100")
def cdc_cutover_exact(spark, d):
    feed = cdc.decode(*_changes(spark, d))
    return cdc.pump(feed, 1_000_100, {"high_water": 60, "active": {12, 13, 37}, "tables": {"t"}}).select("lsn", "txn")


@query(f"WITH {_FEED} SELECT lsn, txn FROM f WHERE commit_lsn > 1000300")
def cdc_snapshot_boundary(spark, d):
    """A copy read at one position of the log, and what the feed has beyond it: what was at work then comes by the feed."""
    changes, ends = _changes(spark, d)
    seen = cdc.boundary(changes, ends, 1_000_300)
    return cdc.pump(cdc.decode(changes, ends), 0, seen | {"tables": {"t"}}, cursor=0, base=0).select("lsn", "txn")


@query(f"""WITH {_FEED}, {_LAST}, o AS (SELECT c_custkey AS key, c_acctbal AS value, 1000000 + c_custkey * 8 AS cl, c_custkey AS l, FALSE AS del FROM customer),
j AS (SELECT coalesce(o.key, g.key) AS key, o.key IS NULL OR (g.key IS NOT NULL AND (g.commit_lsn > o.cl OR (g.commit_lsn = o.cl AND g.lsn > o.l))) AS take, g.value AS gv, o.value AS ov, g.commit_lsn AS gc, o.cl, g.lsn AS gl, o.l, g.op, o.del FROM o FULL JOIN g ON o.key = g.key)
SELECT key, CASE WHEN take THEN gv ELSE ov END AS value, CAST(CASE WHEN take THEN gc ELSE cl END AS BIGINT) AS _commit_lsn, CAST(CASE WHEN take THEN gl ELSE l END AS BIGINT) AS _lsn, CASE WHEN take THEN op = 'DELETE' ELSE del END AS _deleted FROM j""")
def cdc_guarded_upsert(spark, d):
    old = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("value"), (1_000_000 + F.col("c_custkey") * 8).alias("_commit_lsn"), F.col("c_custkey").alias("_lsn"), F.lit(False).alias("_deleted"))
    return cdc.guarded_upsert(old, cdc.decode(*_changes(spark, d)), "key", ["value"])


@query("""SELECT p_partkey, '{"p_partkey":"' || CAST(p_partkey AS VARCHAR) || '","p_size":' || CASE WHEN p_size % 10 = 0 THEN 'null' ELSE CAST(p_size AS VARCHAR) END || ',"p_name":"' || p_name || '"}' AS json FROM part""")
def cdc_json_encoding(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.when(F.col("p_size") % 10 != 0, F.col("p_size")).alias("p_size"), "p_name")
    return p.select("p_partkey", cdc.encoded({"p_partkey": "BIGINT", "p_size": "INTEGER", "p_name": "VARCHAR(55)"}).alias("json"))


@query(f"""WITH {_FEED}, {_LAST}, m AS (SELECT key, value FROM g WHERE op <> 'DELETE'), s AS (SELECT user_id AS key, max_by(value, event_id) AS value FROM events GROUP BY user_id)
SELECT coalesce(m.key, s.key) AS key, CASE WHEN m.key IS NULL THEN 'missing' WHEN s.key IS NULL THEN 'extra' ELSE 'differs' END AS problem,
CASE WHEN m.key IS NOT NULL AND s.key IS NOT NULL THEN 'value' END AS "column" FROM m FULL JOIN s ON m.key = s.key WHERE m.key IS NULL OR s.key IS NULL OR m.value IS DISTINCT FROM s.value""")
def cdc_source_diff(spark, d):
    folded = cdc.fold(cdc.decode(*_changes(spark, d)), "key", ["value"])
    source = table(spark, d, "events").groupBy(F.col("user_id").alias("key")).agg(F.max_by("value", "event_id").alias("value"))
    return cdc.source_diff(folded, source, "key", check_empty=False)


@query("""WITH e AS (SELECT event_id AS lsn, CASE WHEN event_id % 9 = 0 THEN 'UPSERT' WHEN event_type = 'error' THEN 'DELETE' ELSE 'INSERT' END AS op, event_id % 13 = 0 AS b, event_type <> 'error' AS a,
event_id AS cl, CASE WHEN event_id % 17 = 0 THEN event_id ELSE event_id + 1 END AS ce FROM events)
SELECT * FROM (SELECT lsn, CASE WHEN op = 'UPSERT' THEN 'unknown op' WHEN op = 'INSERT' AND (b OR NOT a) THEN 'needs after alone' WHEN op = 'DELETE' AND (NOT b OR a) THEN 'needs before alone'
WHEN NOT ce > cl THEN 'commit_end_lsn not beyond commit_lsn' END AS reason FROM e) WHERE reason IS NOT NULL""")
def cdc_validate(spark, d):
    k = F.col("event_id")
    e = table(spark, d, "events").select(
        k.alias("lsn"), k.alias("line"), F.lit("t").alias("tbl"), F.when(k % 9 == 0, "UPSERT").when(F.col("event_type") == "error", "DELETE").otherwise("INSERT").alias("op"),
        F.when(k % 13 == 0, F.col("value")).alias("before"), F.when(F.col("event_type") != "error", F.col("value")).alias("after"),
        k.alias("commit_lsn"), F.when(k % 17 == 0, k).otherwise(k + 1).alias("commit_end_lsn"))
    return cdc.violations(e)


@query("""SELECT 'p_partkey' AS "column", CAST(0 AS BIGINT) AS strings, CAST(count(*) AS BIGINT) AS numbers, CAST(count(*) FILTER (WHERE p_partkey % 2 = 1) AS BIGINT) AS lossy FROM part
UNION ALL SELECT 'p_name', count(*), 0, 0 FROM part""")
def cdc_precision(spark, d):
    p = table(spark, d, "part").select(F.to_json(F.struct((F.lit(9007199254740992) + F.col("p_partkey") % 2).alias("p_partkey"), "p_name")).alias("j"))
    return cdc.precision_report(p, "j", ["p_partkey", "p_name"])


@query(f"WITH {_FEED} SELECT lsn FROM f WHERE commit_lsn > 1000300 OR (commit_lsn = 1000300 AND lsn > 298)")
def cdc_cursor_filter(spark, d):
    feed = cdc.decode(*_changes(spark, d))
    cursors = spark.range(1).select(F.lit("t").alias("tbl"), F.lit(1_000_300).cast("bigint").alias("c_commit"), F.lit(298).cast("bigint").alias("c_lsn"))
    return cdc.beyond_cursor(feed, cursors).select("lsn")


@query("""WITH d AS (SELECT event_type AS tbl, event_id AS lsn, 'v' || CAST(event_id AS VARCHAR) AS columns FROM events WHERE event_id % 100 = 0)
SELECT e.event_id AS lsn, max_by(d.columns, d.lsn) AS columns FROM events e JOIN d ON d.tbl = e.event_type AND d.lsn <= e.event_id GROUP BY e.event_id""")
def cdc_schema_as_of(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("tbl"), F.col("event_id").alias("lsn"))
    ddl = e.where("lsn % 100 = 0").select("tbl", "lsn", F.concat(F.lit("v"), F.col("lsn").cast("string")).alias("columns"))
    return cdc.with_schema(e, ddl).select("lsn", "columns")
