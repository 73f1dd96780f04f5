import pytest

from agentlake.errors import BindError, BranchError, ConstraintError, EscrowError, FeedError, ParseError, TransactionError
from agentlake.session import Engine


@pytest.fixture()
def engine(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/lake")
    s = e.connect()
    s.execute("CREATE TABLE seats (flight INTEGER NOT NULL, free INTEGER)")
    s.execute("INSERT INTO seats VALUES (1, 31); INSERT INTO seats VALUES (2, 8)")
    return e


def rows(s, text):
    return sorted(s.execute(text).rows())


def agent(engine, name, *statements):
    s = engine.connect()
    s.execute(f"BEGIN AGENT SESSION AS '{name}'")
    for x in statements:
        s.execute(x)
    return s


def test_commuting_decrements(engine):
    a = agent(engine, "a", "UPDATE seats SET free = free - 4 WHERE flight = 1")
    b = agent(engine, "b", "UPDATE seats SET free = -6 + free WHERE flight = 1")
    assert rows(a, "SELECT * FROM seats") == [(1, 27), (2, 8)]
    assert a.execute("MERGE").report["outcome"] == "Clean"
    assert b.execute("DIFF").df.collect()[0]["status"] == "pending (target moved)"
    assert b.execute("MERGE").report["outcome"] == "Commuting"
    assert rows(engine.connect(), "SELECT * FROM seats") == [(1, 21), (2, 8)]
    assert engine.who_wrote("seats", 1) == "b"


def test_conflict_publishes_nothing_and_lww_reports_loss(engine):
    a = agent(engine, "a", "UPDATE seats SET free = 1 WHERE flight = 1")
    b = agent(engine, "b", "UPDATE seats SET free = 2 WHERE flight = 1")
    a.execute("MERGE")
    report = b.execute("MERGE").report
    assert report["outcome"] == "Conflict" and not report["published"] and report["conflicts"][0]["reason"] == "ContradictoryAssign"
    assert b.branch is not None
    engine.policies[("seats", "free")] = "lww"
    assert b.execute("MERGE").report["outcome"] == "ResolvedWithLoss"
    assert rows(engine.connect(), "SELECT free FROM seats WHERE flight = 1") == [(2,)]


def test_guard_is_a_precondition(engine):
    a = agent(engine, "a", "UPDATE seats SET free = free - 17 WHERE flight = 1 AND free >= 17")
    b = agent(engine, "b", "UPDATE seats SET free = free - 17 WHERE flight = 1 AND free >= 17")
    a.execute("MERGE")
    found = b.execute("MERGE").report["conflicts"]
    assert found == [{"table": "seats", "key": 1, "reason": "GuardFailed", "guards": ["flight = 1 AND free >= 17"]}]
    c = agent(engine, "c", "UPDATE seats SET free = free - 8 WHERE flight = 1 AND free >= 0")
    d = agent(engine, "d", "UPDATE seats SET free = free - 8 WHERE flight = 1 AND free >= 0")
    assert c.execute("MERGE").report["published"] and d.execute("MERGE").report["published"]
    assert rows(engine.connect(), "SELECT free FROM seats WHERE flight = 1") == [(-2,)]


def test_escrow_and_statement_atomicity(engine):
    engine.ledger.open(("seats", 1, "free"), 31)
    a = agent(engine, "a", "UPDATE seats SET free = free - 19 WHERE flight = 1")
    b = agent(engine, "b")
    with pytest.raises(EscrowError, match="12 left"):
        b.execute("UPDATE seats SET free = free - 19")
    assert rows(b, "SELECT * FROM seats") == [(1, 31), (2, 8)]
    a.execute("ABANDON")
    b.execute("UPDATE seats SET free = free - 19 WHERE flight = 1")
    assert b.execute("MERGE").report["published"]
    assert engine.ledger.left(("seats", 1, "free")) == 12


def test_delete_vs_write_insert_vs_insert(engine):
    a = agent(engine, "a", "DELETE FROM seats WHERE flight = 1", "INSERT INTO seats VALUES (3, 1)")
    b = agent(engine, "b", "UPDATE seats SET free = 9 WHERE flight = 1", "INSERT INTO seats VALUES (3, 2)")
    assert a.execute("MERGE").report["published"]
    assert {(c["key"], c["reason"]) for c in b.execute("MERGE").report["conflicts"]} == {(1, "DeleteVsWrite"), (3, "ContradictoryAssign")}
    assert rows(engine.connect(), "SELECT * FROM seats") == [(2, 8), (3, 1)]


def test_causal_revert(engine):
    agent(engine, "a", "UPDATE seats SET free = free - 5 WHERE flight = 1").execute("MERGE")
    agent(engine, "b", "SELECT free FROM seats WHERE flight = 1", "UPDATE seats SET free = 100 WHERE flight = 2").execute("MERGE")
    s = engine.connect()
    halted = s.execute("REVERT MERGE m_1").report
    assert halted["halted"] and halted["dependents"] == ["m_2"]
    assert s.execute("REVERT MERGE m_1 CASCADE").report["reverted"] == ["m_2", "m_1"]
    assert rows(s, "SELECT * FROM seats") == [(1, 31), (2, 8)]


def test_read_premise_quarantines(engine):
    b = agent(engine, "b", "SELECT free FROM seats WHERE flight = 1", "UPDATE seats SET free = 0 WHERE flight = 2")
    engine.connect().execute("UPDATE seats SET free = 3 WHERE flight = 1")
    report = b.execute("MERGE").report
    assert report["gate"] == "Quarantine" and not report["published"]
    with pytest.raises(BranchError, match="quarantined"):
        b.execute("MERGE")
    assert rows(engine.connect(), f"SELECT free FROM seats AS OF BRANCH {b.branch.name} WHERE flight = 2") == [(0,)]


def test_nested_branch_publishes_into_its_parent(engine):
    a = agent(engine, "a", "UPDATE seats SET free = free - 1 WHERE flight = 1")
    child = engine.connect()
    child.branch = engine.fork("c", parent=a.branch)
    child.execute("UPDATE seats SET free = free - 2 WHERE flight = 1")
    assert child.execute("MERGE").report["published"]
    assert rows(a, "SELECT free FROM seats WHERE flight = 1") == [(28,)]
    assert rows(engine.connect(), "SELECT free FROM seats WHERE flight = 1") == [(31,)]


def test_leases(engine):
    b = engine.fork("x", lease=100)
    assert engine.reap_expired(99) == [] and engine.reap_expired(100) == [b.name] and engine.reap_expired(100) == []
    with pytest.raises(BranchError, match="Reaped"):
        engine.branch(b.name)


def test_transactions_and_conflicts(engine):
    a, b = engine.connect(), engine.connect()
    a.execute("BEGIN; UPDATE seats SET free = 1 WHERE flight = 1")
    assert rows(b, "SELECT free FROM seats WHERE flight = 1") == [(31,)]
    b.execute("UPDATE seats SET free = 2 WHERE flight = 1")
    with pytest.raises(TransactionError, match="changed by another transaction"):
        a.execute("COMMIT")
    a.execute("BEGIN; DELETE FROM seats; ROLLBACK")
    assert rows(a, "SELECT * FROM seats") == [(1, 2), (2, 8)]


def test_refusals_name_the_object(engine):
    s = engine.connect()
    for text, error, match in [
        ("SELECT nope FROM seats", BindError, "columns are flight, free"),
        ("SELECT * FROM nope", BindError, "tables are seats"),
        ("SELECT flight FROM seats WHERE free = 'x'", BindError, "INTEGER with VARCHAR"),
        ("SELECT COUNT(flight) FROM seats", ParseError, "query"),
        ("SELECT flight FROM seats ORDER BY flight", ParseError, "ORDER"),
        ("INSERT INTO seats VALUES (1, 5)", ConstraintError, "already"),
        ("INSERT INTO seats VALUES (NULL, 5)", ConstraintError, "NOT NULL"),
        ("UPDATE seats SET flight = 5", BindError, "key"),
        ("SELECT flight FROM seats JOIN seats ON TRUE", BindError, "used twice"),
        ("MERGE", BranchError, "session"),
    ]:
        with pytest.raises(error, match=match):
            s.execute(text)


def test_wide_types_round_trip(spark, tmp_path):
    s = Engine(spark, f"file://{tmp_path}/wide").connect()
    s.execute("CREATE TABLE wide (flight INTEGER NOT NULL, big BIGINT, dec DECIMAL, ts TIMESTAMP, note VARCHAR(6), f FLOAT)")
    digits = "1" * 60
    s.execute(f"INSERT INTO wide VALUES (1, -9223372036854775808, {digits}, 1700000000123, 'ééé', 2)")
    assert s.execute("SELECT * FROM wide").rows() == [(1, -(2**63), digits, 1700000000123, "ééé", 2.0)]
    assert s.execute("SELECT ts + 1, ts - ts, big / 2 FROM wide WHERE dec > 1.50 AND f = 2").rows() == [(1700000000124, 0, -(2**62))]
    with pytest.raises(ConstraintError, match="VARCHAR"):
        s.execute("INSERT INTO wide VALUES (2, 1, 1, 1, 'éééé', 1)")
    with pytest.raises(BindError, match="DECIMAL"):
        s.execute("SELECT dec + 1 FROM wide")


def test_feed_of_commits_folds_to_the_table(engine):
    from agentlake.operators import cdc

    s = engine.connect()
    s.execute("UPDATE seats SET free = 100 WHERE flight = 1; DELETE FROM seats WHERE flight = 2; INSERT INTO seats VALUES (2, 5)")
    feed = engine.store.changes(0)
    assert {r["op"] for r in feed.collect()} == {"CREATE_TABLE", "INSERT", "UPDATE", "DELETE"}
    folded = cdc.fold(feed, "key", ["after"])
    assert sorted((r["key"], r["after"]) for r in folded.collect()) == [("1", '{"flight":1,"free":100}'), ("2", '{"flight":2,"free":5}')]
    assert cdc.violations(feed.withColumn("line", feed["lsn"])).count() == 0


def test_fork_copies_no_file_and_diff_reads_changed_parts(engine):
    before = {n: engine.store.names(n) for n in ("data/seats", "manifests")}
    engine.fork("x")
    assert before == {n: engine.store.names(n) for n in ("data/seats", "manifests")}
    at = engine.store.head()
    engine.connect().execute("INSERT INTO seats VALUES (9, 9)")
    d = engine.structural_diff("seats", at, at + 1)
    assert [(r["kind"], r["flight"]) for r in d.collect()] == [("INSERT", 9)]


def test_engine_reopens(engine, spark):
    a = agent(engine, "a", "UPDATE seats SET free = 1 WHERE flight = 1")
    again = Engine(spark, engine.store.root)
    assert rows(again.connect(), f"SELECT free FROM seats AS OF BRANCH {a.branch.name} WHERE flight = 1") == [(1,)]
    assert again.connect().execute(f"MERGE BRANCH {a.branch.name}").report["published"]


def test_collapse_keeps_the_view_and_the_merge(engine):
    a = agent(engine, "a", "UPDATE seats SET free = free - 5 WHERE flight = 1", "UPDATE seats SET free = free - 1 WHERE flight = 1", "INSERT INTO seats VALUES (5, 5)")
    engine.connect().execute("INSERT INTO seats VALUES (8, 8)")
    engine.collapse(a.branch)
    assert rows(a, "SELECT * FROM seats") == [(1, 25), (2, 8), (5, 5)]
    assert a.execute("MERGE").report["published"]
    assert rows(engine.connect(), "SELECT * FROM seats") == [(1, 25), (2, 8), (5, 5), (8, 8)]


# -- several writers, several engines


def between(monkeypatch, engine, work):
    """Run ``work`` once while a statement has read its base and not yet published."""
    publish = engine.store.publish

    def late(*args, **more):
        monkeypatch.setattr(engine.store, "publish", publish)
        work()
        return publish(*args, **more)

    monkeypatch.setattr(engine.store, "publish", late)


@pytest.mark.parametrize("text", ["UPDATE seats SET free = 1 WHERE flight = 1", "DELETE FROM seats WHERE flight = 1", "INSERT INTO seats VALUES (4, 4)", "CREATE INDEX i ON seats (free)", "DROP TABLE seats"])
def test_a_commit_between_reading_and_publishing_is_not_lost(engine, monkeypatch, text):
    a, b = engine.connect(), engine.connect()
    between(monkeypatch, engine, lambda: b.execute("INSERT INTO seats VALUES (3, 30)"))
    with pytest.raises(TransactionError, match="changed by another transaction"):
        a.execute(text)
    assert rows(b, "SELECT * FROM seats") == [(1, 31), (2, 8), (3, 30)]
    a.execute("UPDATE seats SET free = 1 WHERE flight = 1")
    assert rows(b, "SELECT * FROM seats") == [(1, 1), (2, 8), (3, 30)]


def test_two_engines_share_a_store(engine, spark):
    other = Engine(spark, engine.store.root)
    a = agent(engine, "a", "UPDATE seats SET free = free - 1 WHERE flight = 1")
    b = agent(other, "b", "UPDATE seats SET free = free - 2 WHERE flight = 1")
    assert a.branch.name != b.branch.name
    first, second = a.execute("MERGE").report, b.execute("MERGE").report
    assert first["merge"] != second["merge"] and second["outcome"] == "Commuting"
    assert rows(engine.connect(), "SELECT free FROM seats WHERE flight = 1") == [(28,)]
    assert engine.who_wrote("seats", 1) == "b" and other.who_wrote("seats", 1) == "b"


def test_a_branch_changed_elsewhere_is_refused_and_read_again(engine, spark):
    a = agent(engine, "a", "UPDATE seats SET free = 5 WHERE flight = 1")
    other = Engine(spark, engine.store.root)
    other.connect().execute(f"ABANDON BRANCH {a.branch.name}")
    with pytest.raises(BranchError, match="Abandoned"):
        a.execute("UPDATE seats SET free = 6 WHERE flight = 1")
    c = agent(engine, "c")
    stale = c.branch
    stale.version -= 1
    with pytest.raises(BranchError, match="another engine"):
        engine.save(stale)


def test_runs_budgets_policies_and_bounds_outlive_the_engine(engine, spark):
    engine.ledger.open(("seats", 1, "free"), 31)
    engine.policies["seats", "free"] = "lww"
    engine.bounds["seats", "free"] = (0, None)
    a = agent(engine, "a", "UPDATE seats SET free = free - 20 WHERE flight = 1")
    again = Engine(spark, engine.store.root)
    assert again.ledger.left(("seats", 1, "free")) == 11 and again.policies == {("seats", "free"): "lww"} and again.bounds == {("seats", "free"): (0, None)}
    with pytest.raises(EscrowError, match="11 left"):
        agent(again, "b", "UPDATE seats SET free = free - 12 WHERE flight = 1")
    a.execute("MERGE")
    assert Engine(spark, engine.store.root).who_wrote("seats", 1) == "a"
    assert again.ledger.left(("seats", 1, "free")) == 11


def test_bounds_and_schema_are_looked_at_again(engine):
    engine.bounds["seats", "free"] = (0, 100)
    a, b = (agent(engine, n, "UPDATE seats SET free = free - 20 WHERE flight = 1") for n in "ab")
    assert a.execute("MERGE").report["published"]
    report = b.execute("MERGE").report
    assert [(c["key"], c["reason"]) for c in report["conflicts"]] == [(1, "BoundViolated")] and report["n_conflicts"] == 1
    assert engine.conflicts(report["merge"]).count() == 1
    assert rows(engine.connect(), "SELECT free FROM seats WHERE flight = 1") == [(11,)]
    c = agent(engine, "c", "UPDATE seats SET free = 1 WHERE flight = 2")
    engine.connect().execute("DROP TABLE seats; CREATE TABLE seats (flight INTEGER NOT NULL, sold INTEGER)")
    assert [x["reason"] for x in c.execute("MERGE").report["conflicts"]] == ["SchemaMismatch"]


def test_diff_names_operations_and_held_branches_are_listed(engine):
    b = agent(engine, "b", "SELECT free FROM seats WHERE flight = 2", "UPDATE seats SET free = 3 + free WHERE flight = 1")
    assert b.execute("DIFF").df.first()["ops"] == ["free: Add"]
    engine.connect().execute("UPDATE seats SET free = 0 WHERE flight = 2")
    report = b.execute("MERGE").report
    assert report["findings"][0]["certainty"] == "exact" and b.branch.reads[0][3] == b.branch.fork
    assert engine.quarantined() == [(b.branch.name, report["findings"][0]["detail"])]
    c = agent(engine, "c", "SELECT * FROM seats", "SELECT free FROM seats WHERE flight = 2", "UPDATE seats SET free = 7 WHERE flight = 1")
    engine.connect().execute("UPDATE seats SET free = 9 WHERE flight = 2")
    assert c.execute("MERGE").report["findings"][0]["certainty"] == "heuristic"


def test_updates_rewrite_only_the_parts_they_meet(engine):
    s = engine.connect()
    before = {p.path: p for p in engine.store.manifest("seats").parts}
    s.execute("UPDATE seats SET free = 4 WHERE flight = 2")
    after = {p.path for p in engine.store.manifest("seats").parts}
    assert {before[p].low for p in before if p in after} == {1}
    agent(engine, "a", "UPDATE seats SET free = 5 WHERE flight = 2").execute("MERGE")
    assert {before[p].low for p in before if p in {x.path for x in engine.store.manifest("seats").parts}} == {1}


def test_vacuum_keeps_what_is_in_use_and_backups_stand_alone(engine, spark, tmp_path):
    s = engine.connect()
    held = agent(engine, "held", "UPDATE seats SET free = 2 WHERE flight = 2")
    gone = agent(engine, "gone", "UPDATE seats SET free = 3 WHERE flight = 2")
    for k in range(3):
        s.execute(f"UPDATE seats SET free = {k} WHERE flight = 1")
    gone.execute("ABANDON")
    copy = f"file://{tmp_path}/copy"
    assert engine.store.backup(copy) == 2
    engine.vacuum(keep=1)
    assert rows(held, "SELECT * FROM seats") == [(1, 31), (2, 2)] and rows(s, "SELECT * FROM seats") == [(1, 2), (2, 8)]
    held.execute("ABANDON")
    done = engine.vacuum(keep=0)
    assert done["commits"] and done["manifests"] and done["files"]
    assert rows(s, "SELECT * FROM seats") == [(1, 2), (2, 8)]
    assert rows(Engine(spark, copy).connect(), "SELECT * FROM seats") == [(1, 2), (2, 8)]
    with pytest.raises(FeedError, match="gap"):
        engine.store.changes(0)
    feed, at = engine.store.snapshot("seats")
    assert feed.count() == 2 and engine.store.changes(at) is None


def test_metadata_by_a_file_system_other_than_the_local_one(spark, tmp_path):
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.lake.link./at", f"file://{tmp_path}")
    store = Engine(spark, "viewfs://lake/at/lake").store
    assert store.create("x/1.json", "a") and not store.create("x/1.json", "b") and store.load("x/1.json") == "a"


def test_revert_shows_what_depends(engine):
    agent(engine, "a", "UPDATE seats SET free = free - 5 WHERE flight = 1").execute("MERGE")
    agent(engine, "b", "SELECT free FROM seats WHERE flight = 1", "UPDATE seats SET free = 9 WHERE flight = 2").execute("MERGE")
    agent(engine, "c", "SELECT free FROM seats WHERE flight = 2", "INSERT INTO seats VALUES (3, 3)").execute("MERGE")
    assert engine.connect().execute("REVERT MERGE m_1").report["tree"] == "m_1 (to be reverted)\n  m_2\n    m_3"


def test_decimals_against_float_literals_and_columns(spark, tmp_path):
    s = Engine(spark, f"file://{tmp_path}/d").connect()
    s.execute("CREATE TABLE t (id INTEGER NOT NULL, d DECIMAL, f FLOAT); INSERT INTO t VALUES (1, 0.1, 0.1); INSERT INTO t VALUES (2, 0.5, 0.5)")
    assert rows(s, "SELECT id FROM t WHERE d = f") == [(2,)]  # no double is 0.1
    assert rows(s, "SELECT id FROM t WHERE d >= 0.5") == [(2,)]


def test_an_index_leaves_out_parts_without_the_value(engine):
    s = engine.connect()
    s.execute("CREATE INDEX by_free ON seats (free); INSERT INTO seats VALUES (3, 8)")
    m = engine.store.manifest("seats")
    assert m.indexes == ["free"] and sorted(p.bounds["free"] for p in m.parts) == [[8, 8], [8, 8], [31, 31]]
    read = lambda text: len(s.query(text).inputFiles())
    assert read("SELECT * FROM seats WHERE free = 8") == 2 and read("SELECT * FROM seats WHERE free = 8 AND flight = 3") == 1 and read("SELECT * FROM seats WHERE flight = 2") == 1
    assert read("SELECT * FROM seats WHERE free = 8 OR flight = 1") == 3
    assert rows(s, "SELECT flight FROM seats WHERE free = 8") == [(2,), (3,)] and rows(s, "SELECT * FROM seats WHERE free = 9") == []
    s.execute("UPDATE seats SET free = 9 WHERE flight = 3")
    assert rows(s, "SELECT flight FROM seats WHERE free = 9") == [(3,)]


def test_a_feed_of_many_commits_is_written_in_between(engine, monkeypatch):
    from agentlake.operators import cdc
    from agentlake.sources import store

    monkeypatch.setattr(store, "COMMITS_A_PLAN", 2)
    s = engine.connect()
    for k in range(3):
        s.execute(f"UPDATE seats SET free = {k} WHERE flight = 1")
    assert sorted((r["key"], r["after"]) for r in cdc.fold(engine.store.changes(0), "key", ["after"]).collect()) == [("1", '{"flight":1,"free":2}'), ("2", '{"flight":2,"free":8}')]
