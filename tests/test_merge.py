"""Laws of the merge, checked against a plain fold in Python, and single operators on edge values."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from agentlake.errors import MergeError
from agentlake.functions import scalar
from agentlake.operators import escrow, gate, merge, mvcc, overlay, provenance

OPS = "side string, txn long, seq long, pos int, key int, col string, kind string, v long"
KINDS = ["Assign", "Add", "Max", "Min"]
NET = {"Assign": lambda b, v: v, "Add": lambda b, v: b + v, "Max": max, "Min": min}


def fold(b, ops):
    """(kind, value) of operations in order."""
    kind, v = None, None
    for k, x in ops:
        if kind is None or k == "Assign":
            kind, v = k, x
        elif k == kind:
            v = v + x if k == "Add" else max(v, x) if k == "Max" else min(v, x)
        else:
            now = NET[kind](b, v)
            kind, v = "Assign", NET[k](now, x)
    return kind, v


def merged(b, ours, theirs, policy, stamps):
    """(value, outcome)"""
    o, t = fold(b, ours), fold(b, theirs)
    if o[0] is None or t[0] is None:
        k, v = t if o[0] is None else o
        return NET[k](b, v), "Clean"
    ov, tv = NET[o[0]](b, o[1]), NET[t[0]](b, t[1])
    if o[0] == t[0] and (o[0] != "Assign" or o[1] == t[1]):
        return {"Add": b + o[1] + t[1], "Max": max(b, o[1], t[1]), "Min": min(b, o[1], t[1]), "Assign": o[1]}[o[0]], "Commuting"
    later = ov if stamps[0] > stamps[1] else tv
    return {"reject": (None, "Conflict"), "additive": (b + ov - b + tv - b, "Commuting"), "multivalue": (later, "Commuting"), "lww": (later, "ResolvedWithLoss")}[policy]


side = st.lists(st.tuples(st.sampled_from(KINDS), st.integers(-50, 50)), max_size=4)
case = st.tuples(st.integers(-50, 50), side, side, st.booleans()).filter(lambda c: c[1] or c[2])


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(case, min_size=20, max_size=40))
def test_three_way_merge_equals_plain_fold(spark, cases):
    rows, base = [], []
    for key, (b, ours, theirs, ours_later) in enumerate(cases):
        base.append((key, "c", b))
        for name, ops, txn in (("ours", ours, key * 10 + (5 if ours_later else 1)), ("theirs", theirs, key * 10 + 3)):
            rows += [(name, txn, 1, pos, key, "c", k, v) for pos, (k, v) in enumerate(ops)]
    base_df, ops_df = spark.createDataFrame(base, "key int, col string, b long"), spark.createDataFrame(rows, OPS)
    for policy in ("reject", "lww", "multivalue", "additive"):
        cells, _ = merge.three_way_merge(base_df, ops_df, default=policy)
        got = {r["key"]: (r["value"], r["outcome"]) for r in cells.collect()}
        want = {}
        for key, (b, ours, theirs, later) in enumerate(cases):
            want[key] = merged(b, ours, theirs, policy, (key * 10 + (5 if later else 1), key * 10 + 3))
        assert got == want


def test_rows_and_replays(spark):
    rows = [("ours", 1, 1, 0, 1, None, "RowDelete", None), ("theirs", 2, 1, 0, 1, "c", "Add", 1), ("ours", 3, 1, 0, 2, None, "RowDelete", None), ("theirs", 4, 1, 0, 2, None, "RowDelete", None),
            ("ours", 5, 1, 0, 3, None, "RowCreate", 7), ("theirs", 6, 1, 0, 3, None, "RowCreate", 7), ("ours", 7, 1, 0, 4, None, "RowCreate", 7), ("theirs", 8, 1, 0, 4, None, "RowCreate", 8),
            ("ours", 9, 1, 0, 5, "c", "Add", 2), ("theirs", 9, 1, 0, 5, "c", "Add", 2)]
    base = spark.createDataFrame([(1, "c", 10), (5, "c", 10)], "key int, col string, b long")
    cells, rows_ = merge.three_way_merge(base, spark.createDataFrame(rows, OPS))
    assert [(r["key"], r["value"]) for r in cells.collect()] == [(5, 12)]  # one frame, not two
    assert {r["key"]: (r["row_outcome"], r["row_reason"]) for r in rows_.collect()} == {1: ("Conflict", "DeleteVsWrite"), 2: ("Commuting", None), 3: ("Commuting", None), 4: ("Conflict", "ContradictoryAssign")}


def test_overlay_and_diff_with_nulls(spark):
    base = spark.createDataFrame([(1, None), (2, 5), (3, 6)], "id int, v int")
    delta = spark.createDataFrame([(1, 4, False), (2, None, True), (9, None, False)], "id int, v int, _deleted boolean")
    after = overlay.overlay(base, delta, "id")
    assert sorted(map(tuple, after.collect())) == [(1, 4), (3, 6), (9, None)]
    assert {r["id"]: r["kind"] for r in overlay.row_diff(base, after, "id").collect()} == {1: "UPDATE", 2: "DELETE", 9: "INSERT"}
    assert overlay.row_diff(base, base, "id").count() == 0


def test_exact_comparison(spark):
    rows = [(9007199254740993, 9007199254740992.0, 1), (5, 5.0, 0), (5, 5.5, -1), (-5, -5.5, 1), (2**63 - 1, float(2**63), -1), (-(2**63), -float(2**63), 0), (0, float("nan"), -1), (0, float("-inf"), 1), (1, None, None)]
    df = spark.createDataFrame([r[:2] for r in rows], "k long, r double").select(scalar.exact_cmp(F.col("k"), F.col("r")).alias("c"))
    assert [r["c"] for r in df.collect()] == [r[2] for r in rows]


def test_decimal_keys_sort_by_value(spark):
    import decimal

    texts = ["0", "-0", "0.00", "1.50", "1.5", "-1.5", "10", "9", "-10", "-9", "1" * 60, "-" + "1" * 60, "-0." + "0" * 19 + "1", ".5", "007"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("k", scalar.decimal_key(F.col("t"))).collect()
    for a in got:
        for b in got:
            x, y = decimal.Decimal(a["t"]), decimal.Decimal(b["t"])
            assert (a["k"] < b["k"]) == (x < y) and (a["k"] == b["k"]) == (x == y)
    assert spark.createDataFrame([("x1",)], "t string").select(scalar.decimal_key(F.col("t"))).first()[0] is None


acts = st.lists(st.tuples(st.sampled_from(["claim", "spend", "settle", "release"]), st.sampled_from("abcd"), st.integers(1, 15)), max_size=40)


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 40), acts)
def test_escrow_never_goes_below_the_floor(slack, acts):
    ledger = escrow.Ledger()
    ledger.open("c", slack)
    spent = 0
    for act, branch, amount in acts:
        held = ledger.claims["c"].get(branch, [0, 0])[1]
        try:
            if act == "claim":
                ledger.claim("c", branch, amount)
            elif act == "spend":
                ledger.spend(branch, {"c": amount})
            elif act == "settle":
                ledger.settle(branch)
                spent += held
            else:
                ledger.release(branch)
        except Exception as e:
            assert isinstance(e, escrow.EscrowError)
        assert ledger.left("c") >= 0 and ledger.slack["c"] == slack - spent >= 0


def test_sequential_claims(spark):
    cells = spark.createDataFrame([("p", 20)], "cell string, slack long")
    claims = spark.createDataFrame([("p", f"b{k}", k, 12) for k in range(5)], "cell string, branch string, seq int, amount long")
    assert [r["seq"] for r in escrow.grant_claims(cells, claims).where("granted").collect()] == [0]


def test_closure_ends_on_cycles(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (7, 8)], "writer long, reader long")
    out = provenance.dependents(edges, spark.createDataFrame([(1,)], "root long"))
    assert sorted(r["txn"] for r in out.collect()) == [2, 3, 4]


def test_range_join_equals_all_pairs(spark):
    import random

    rng = random.Random(1)
    points = [(k, "t" if k % 3 else "u", rng.choice([rng.uniform(-50, 50), float(rng.randint(-9, 9)), 1e12])) for k in range(80)]
    ranges = []
    for k in range(60):
        lo = rng.choice([None, rng.uniform(-60, 60), float(rng.randint(-9, 9))])
        ranges.append((k, "t" if k % 2 else "u", lo, rng.choice([None, (lo or 0.0) + rng.choice([0.0, 0.001, 1.0, 16.0, 1000.0])])))
    got = provenance.range_join(spark.createDataFrame(points, "p int, tbl string, v double"), spark.createDataFrame(ranges, "r int, tbl string, lo double, hi double"), "v", "lo", "hi", ["tbl"])
    want = sorted((p, r) for p, a, v in points for r, b, lo, hi in ranges if a == b and (lo is None or v >= lo) and (hi is None or v < hi))
    assert sorted((r["p"], r["r"]) for r in got.collect()) == want


def test_visibility(spark):
    v = spark.createDataFrame([("a", 1, 5, "old"), ("a", 5, 0, "new"), ("b", 2, 3, "gone"), ("c", 9, 0, "later")], "k string, begin_ts long, end_ts long, v string")
    assert {r["k"]: r["v"] for r in mvcc.resolve(v, "k", 8, []).collect()} == {"a": "new"}
    assert {r["k"]: r["v"] for r in mvcc.resolve(v, "k", 8, [5]).collect()} == {"a": "old"}
    stats = {r["column"]: r for r in mvcc.analyze(v).collect()}
    assert (stats["k"]["row_count"], stats["k"]["n_distinct"], stats["end_ts"]["n_nulls"]) == (4, 3, 0)


def test_gate_stops_between_tiers():
    ran = []
    check = lambda name, status, cost, rate, tier: gate.Check(name, lambda facts: ran.append(name) or [gate.Finding(name, status)], cost, rate, tier)
    checks = [check("slow", gate.PASS, 100, 0.5, 2), check("cheap", gate.RETRY, 1, 0.5, 0), check("beside", gate.QUARANTINE, 9, 0.1, 0)]
    status, found = gate.evaluate(checks, {})
    assert status == gate.QUARANTINE and ran == ["cheap", "beside"] and len(found) == 2
    assert gate.evaluate([], {}) == (gate.PASS, [])


def test_runs_are_interned():
    runs = provenance.Runs()
    assert runs.intern("a", "r", "m/1") == runs.intern("a", "r", "m/1") == 1
    try:
        runs.intern("b", "r", "m/1")
        raise AssertionError
    except provenance.ProvenanceError:
        pass
    assert runs.describe(0) == "unattributed" and "run r" in runs.describe(1)


def test_effect_log_append(spark):
    frame = "txn long, seq long, content string"
    log = spark.createDataFrame([(1, 1, "a"), (1, 2, "b")], frame)
    assert merge.append_frames(log, log).count() == 2
    longer = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, 3, "c"), (2, 1, "x")], frame)
    assert merge.append_frames(log, longer).count() == 4
    for bad in ([(1, 1, "z"), (1, 2, "b")], [(1, 1, "a")]):
        with pytest.raises(MergeError, match="contradict"):
            merge.append_frames(log, spark.createDataFrame(bad, frame))
