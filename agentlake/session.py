"""Sessions: statements against a store, isolated branches, merges and reverts.

    engine = Engine(spark, "hdfs:///lake")
    session = engine.connect()
    session.execute("CREATE TABLE seats (flight INTEGER NOT NULL, free INTEGER);")
    session.execute("BEGIN AGENT SESSION AS 'booker' RUN 'monday';")
    session.execute("UPDATE seats SET free = free - 2 WHERE flight = 77 AND free >= 2;")
    session.execute("MERGE;")
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from agentlake.errors import BindError, BranchError, ConstraintError, EngineError, MergeError, TransactionError
from agentlake.operators import gate, merge, mvcc, overlay, provenance
from agentlake.operators.escrow import Ledger
from agentlake.plans.binder import SPARK, Binder, Field, Scope, column
from agentlake.plans.grammar import Statement, TableRef, parse, parse_expression
from agentlake.sources.store import Manifest, Part, Store

MAX_DEPTH = 8
LIVE, MERGED, ABANDONED, REAPED, QUARANTINED = "Live", "Merged", "Abandoned", "Reaped", "Quarantined"
_NUMBERS = ("INTEGER", "BIGINT", "FLOAT")
_HIDDEN = ["_deleted", "_seq", "_kinds", "_guard"]


@dataclass
class Result:
    """What a statement gave: a DataFrame, a count of rows, or a report."""

    message: str
    df: DataFrame | None = None
    count: int | None = None
    report: dict = field(default_factory=dict)

    def rows(self) -> list[tuple]:
        return [] if self.df is None else [tuple(r) for r in self.df.collect()]


@dataclass
class Branch:
    id: int
    parent: int | None
    fork: int
    depth: int
    agent: str
    prov: int
    state: str = LIVE
    lease: int | None = None
    generation: int = 0
    #: number of the state's file; each change of the branch is the next
    version: int = 0
    seq: int = 0
    reason: str = ""
    #: table: overlay parts, the inherited ones first
    deltas: dict[str, list[Part]] = field(default_factory=dict)
    inherited: dict[str, int] = field(default_factory=dict)
    reads: list[list] = field(default_factory=list)

    @property
    def name(self) -> str:
        return f"b_{self.id}"


class Settings(dict):
    """(table, column): value, each kept in the store from the moment it is set."""

    def __init__(self, store: Store, folder: str):
        self.store, self.folder = store, folder
        for name in store.names(folder):
            table, col, value = json.loads(store.load(f"{folder}/{name}"))
            super().__setitem__((table, col), tuple(value) if isinstance(value, list) else value)

    def __setitem__(self, cell: tuple[str, str], value: object) -> None:
        text = json.dumps([*cell, value])
        while not self.store.create(f"{self.folder}/{len(self.store.names(self.folder)):06d}.json", text):  # the last one of a cell holds
            pass
        super().__setitem__(cell, value)


class Engine:
    """One store with its branches, runs, budgets, bounds and merge policies; all of them outlive the engine.

    Several engines may work on one store: names are given once, and a branch that another
    engine has changed meanwhile is refused and read again.
    """

    def __init__(self, spark: SparkSession, root: str, clock: Callable[[], int] | None = None):
        self.spark, self.store = spark, Store(spark, root)
        self.runs, self.ledger = provenance.Runs(self.store), Ledger(self.store)
        self.policies = Settings(self.store, "policies")
        #: (table, column): (floor, ceiling) that a merge's result must keep; None is open
        self.bounds = Settings(self.store, "bounds")
        self.checks: list[gate.Check] = [gate.Check("read_premise", self._premise, 1.0, 0.5)]
        self.clock = clock or (lambda: 0)
        self.branches: dict[int, Branch] = {}
        self.merges: list[dict] = []
        self.refresh()

    def refresh(self) -> None:
        """Take over what other engines have done: their branches, and merges and reverts."""
        for name in self.store.names("branches"):
            self._read_branch(int(name))
        known = {m["id"] for m in self.merges}
        for name in self.store.names("merges"):
            if name not in known and self.store.exists(f"merges/{name}/merge.json"):
                self.merges.append(json.loads(self.store.load(f"merges/{name}/merge.json")))
        self.merges.sort(key=lambda m: int(m["id"][2:]))
        for m in self.merges:
            m["reverted"] = m["reverted"] or self.store.exists(f"merges/{m['id']}/reverted.json")

    def _read_branch(self, ident: int) -> Branch | None:
        """The branch as the store has it; an object in use is brought up to date."""
        known = self.branches.get(ident)
        folder = f"branches/{ident:08d}"
        if known is not None and not self.store.exists(f"{folder}/{known.version + 1:08d}.json"):
            return known
        if not (names := self.store.names(folder)):
            return known
        d = json.loads(self.store.load(f"{folder}/{names[-1]}"))
        d["deltas"] = {t: [Part(**p) for p in ps] for t, ps in d["deltas"].items()}
        if known is None:
            known = self.branches[ident] = Branch(**d)
        else:
            known.__dict__.update(d)
        return known

    def connect(self) -> Session:
        return Session(self)

    def load(self, table: str, rows: DataFrame, fields: list[Field], skip_present: bool = False) -> int:
        """Publish rows in bulk, as a new table or as more rows of one; a key that is there is refused or skipped."""
        base = self.store.head()
        known = table in self.store.commit(base)["tables"]
        m = self.store.manifest(table, base) if known else Manifest(table, fields)
        rows = rows.select(*(F.col(f.name).cast(SPARK[f.type]).alias(f.name) for f in m.fields))
        if known and skip_present:
            rows = rows.join(self.store.read(m).select(m.key), m.key, "left_anti").dropDuplicates([m.key]).select(*m.names)
        self.connect()._check(m, rows, m.fields)
        parts = self.store.write_part(f"data/{table}", rows, m.key, base + 1, ranged=True, indexes=m.indexes)
        if not skip_present:
            new = self.store.read(m, parts)
            twice = new.groupBy(m.key).count().where("count > 1").limit(1).count()
            if twice or (known and parts and new.join(self.store.read(m).select(m.key), m.key, "left_semi").limit(1).count()):
                raise ConstraintError(f"a key of the rows for {table!r} is there already or comes twice; nothing was loaded")
        self.store.publish(base, {table: self.store.with_parts(m, m.parts + parts)})
        return sum(p.rows for p in parts)

    # -- branches ------------------------------------------------------------------------

    def save(self, b: Branch) -> None:
        """The branch's next state; refused if another engine has written one since this one was read."""
        folder = f"branches/{b.id:08d}"
        b.version += 1
        if not self.store.create(f"{folder}/{b.version:08d}.json", json.dumps(asdict(b))):
            b.version -= 1
            self._read_branch(b.id)
            raise BranchError(f"{b.name} was changed by another engine meanwhile; look at it again and repeat the statement")
        if b.version > 2:  # readers may be at the last one
            self.store.delete(f"{self.store.root}/{folder}/{b.version - 2:08d}.json")

    def fork(self, agent: str, run: str | None = None, model: str | None = None, parent: Branch | None = None, lease: int | None = None) -> Branch:
        """A branch is a pointer: the commit and, in a nested one, its parent's overlay parts; no file is copied."""
        if parent is not None and parent.state != LIVE:
            raise BranchError(f"{parent.name} is {parent.state}; fork a live branch")
        depth = 1 if parent is None else parent.depth + 1
        if depth > MAX_DEPTH:
            raise BranchError(f"branches nest to depth {MAX_DEPTH}; merge {parent.name} first")
        prov = self.runs.intern(agent, run, model)
        deltas = {} if parent is None else {t: list(ps) for t, ps in parent.deltas.items()}
        ident = max(self.branches, default=0) + 1
        while True:
            b = Branch(ident, parent.id if parent else None, parent.fork if parent else self.store.head(), depth, agent, prov, lease=lease, deltas=deltas, inherited={t: len(ps) for t, ps in deltas.items()}, seq=parent.seq if parent else 0)
            if self.store.create(f"branches/{ident:08d}/{0:08d}.json", json.dumps(asdict(b))):
                self.branches[ident] = b
                return b
            self._read_branch(ident)  # another engine's
            ident += 1

    def branch(self, name: str, *states: str) -> Branch:
        text = name.removeprefix("b_")
        b = self._read_branch(int(text)) if text.isdigit() else None
        if b is None:
            raise BranchError(f"no branch {name!r}; branches are {', '.join(x.name for x in self.branches.values()) or 'none'}")
        if b.state not in (states or (LIVE, QUARANTINED)):
            raise BranchError(f"{b.name} is {b.state} and cannot be used for this")
        return b

    def check(self, b: Branch, generation: int) -> None:
        """Refuse a branch that has ended since a session took it, whoever ended it."""
        self._read_branch(b.id)
        if b.generation != generation or b.state not in (LIVE, QUARANTINED):
            raise BranchError(f"{b.name} is {b.state} (generation {b.generation}, the session has {generation}); begin a new session")

    def quarantined(self) -> list[tuple[str, str]]:
        """(branch, why) of all that are held."""
        self.refresh()
        return [(b.name, b.reason) for b in sorted(self.branches.values(), key=lambda b: b.id) if b.state == QUARANTINED]

    def quarantine(self, b: Branch, reason: str) -> None:
        b.state, b.reason = QUARANTINED, reason
        self.save(b)

    def release(self, b: Branch) -> None:
        if b.state != QUARANTINED:
            raise BranchError(f"{b.name} is {b.state}, not quarantined")
        b.state, b.reason = LIVE, ""
        self.save(b)

    def end(self, b: Branch, state: str) -> None:
        b.state, b.generation = state, b.generation + 1
        (self.ledger.settle if state == MERGED else self.ledger.release)(b.name)
        self.save(b)

    def reap_expired(self, now: int | None = None) -> list[str]:
        """Reap live branches whose lease has run out, the deepest and youngest first, and delete what only they wrote."""
        now = self.clock() if now is None else now
        gone = [b for b in self.branches.values() if b.state == LIVE and b.lease is not None and b.lease <= now]
        gone.sort(key=lambda b: (-b.depth, -b.fork, -b.id))
        for b in gone:
            self.end(b, REAPED)
        self._drop_overlays(gone)
        return [b.name for b in gone]

    def _drop_overlays(self, gone: list[Branch]) -> None:
        """Delete what only these ended branches wrote; what a crash leaves of it, ``vacuum`` finds."""
        alive = self._overlay_paths()
        for b in gone:
            for p in {p.path for ps in b.deltas.values() for p in ps} - alive:
                self.store.delete(p)

    def _overlay_paths(self) -> set[str]:
        return {p.path for b in self.branches.values() if b.state in (LIVE, QUARANTINED) for ps in b.deltas.values() for p in ps}

    def vacuum(self, keep: int = 100) -> dict[str, int]:
        """Reclaim commits beyond the last ``keep`` and all files that no kept commit and no branch in use needs.

        A branch in use keeps the commits from its fork on.  Interrupted reaps and merges leave
        files that nothing names; they go here too.
        """
        self.refresh()
        forks = [b.fork for b in self.branches.values() if b.state in (LIVE, QUARANTINED)]
        return self.store.vacuum(min([self.store.head() - keep, *forks]), self._overlay_paths())

    def collapse(self, b: Branch) -> None:
        """Rewrite a branch's own overlay parts as one, the latest image of each row with all that led to it."""
        for table in self.touched(b):
            m = self.store.manifest(table, b.fork)
            own = self.own_parts(b, table)
            if len(own) < 2:
                continue
            delta = self._delta(m, own)
            names = [f.name for f in m.fields[1:]]
            # conditions are a list, so a row that came under several statements keeps all of theirs
            last = delta.groupBy(m.key).agg(F.max_by(F.struct(*names, "_deleted", "_seq"), F.col("_seq")).alias("l"), F.array_distinct(F.flatten(F.collect_list("_guard"))).alias("_guard"), *(F.max(F.col("_kinds")[n]).alias(f"k_{i}") for i, n in enumerate(names)))
            pairs = F.filter(F.array(*(F.struct(F.lit(n).alias("c"), F.col(f"k_{i}").alias("k")) for i, n in enumerate(names))), lambda x: x["k"].isNotNull())
            out = last.select(m.key, *(F.col(f"l.{c}").alias(c) for c in (*names, "_deleted", "_seq")), F.map_from_entries(pairs).alias("_kinds"), "_guard")
            parts = self.store.write_part(f"overlays/{b.name}/{table}", out.select(*m.names, *_HIDDEN), m.key)
            b.deltas[table] = b.deltas[table][: b.inherited.get(table, 0)] + parts
        self.save(b)

    def view(self, table: str, b: Branch | None = None, at: int | None = None, upto: dict[str, int] | None = None) -> DataFrame:
        """A table on the trunk (at a commit) or on a branch (up to some of its overlay parts)."""
        if b is None:
            m = self.store.manifest(table, at)
            return self.store.read(m)
        m = self.store.manifest(table, b.fork)
        parts = b.deltas.get(table, [])
        parts = parts[: upto.get(table, 0)] if upto is not None else parts
        base = self.store.read(m)
        if not parts:
            return base
        return overlay.overlay(base, overlay.latest(self._delta(m, parts), m.key, "_seq").select(*m.names, "_deleted"), m.key)

    def _delta(self, m: Manifest, parts: list[Part]) -> DataFrame:
        return self.spark.read.parquet(*(p.path for p in parts)).select(*m.names, *_HIDDEN)

    def structural_diff(self, table: str, a: int, b: int) -> DataFrame:
        """Rows that differ between two commits; parts in both are never read."""
        x, y = self.store.manifest(table, a), self.store.manifest(table, b)
        gone, come = [p for p in x.parts if p not in y.parts], [p for p in y.parts if p not in x.parts]
        return overlay.row_diff(self.store.read(x, gone), self.store.read(x, come), x.key)

    # -- merge -----------------------------------------------------------------------------

    def own_parts(self, b: Branch, table: str) -> list[Part]:
        return b.deltas.get(table, [])[b.inherited.get(table, 0) :]

    def touched(self, b: Branch) -> list[str]:
        return sorted(t for t in b.deltas if self.own_parts(b, t))

    def resolve(self, b: Branch, table: str) -> tuple[Manifest, DataFrame]:
        """Each row that the branch touched with its fork image, the target's image, the result and the outcome."""
        m = self.store.manifest(table, b.fork)
        delta = self._delta(m, self.own_parts(b, table))
        key, values = m.key, [f for f in m.fields if f.name != m.key]
        names = m.names
        last = delta.groupBy(key).agg(
            F.max_by(F.struct(*names, "_deleted"), F.col("_seq")).alias("l"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("_guard")))).alias("guards"),
            *(F.max(F.col("_kinds")[f.name]).alias(f"k_{i}") for i, f in enumerate(values)),  # S (assign) is above A (add)
        )
        parent = self.branches[b.parent] if b.parent is not None else None
        # a nested branch was forked from its parent's overlay as it then was
        base = self.view(table, b, upto=b.inherited)
        now = self.view(table, parent) if parent is not None else self.view(table)
        keys = last.select(key)
        cut = lambda df, p: df.join(keys, key, "left_semi").select(key, F.struct(*names).alias(p))
        j = last.join(cut(base, "b"), key, "left").join(cut(now, "n"), key, "left")
        adds = self._applied_adds(table, b)
        if adds is not None:
            j = j.join(adds, F.col(key).cast("string") == F.col("_akey"), "left").drop("_akey")
        else:
            j = j.withColumn("adds", F.lit(None).cast("map<string,double>"))
        same = ~overlay.differs("n", "b", names)
        had, there, gone = F.col("b").isNotNull(), F.col("n").isNotNull(), F.col("l._deleted")
        results, conflicts, losses, commutes = [], [], [], []
        for i, f in enumerate(values):
            kind, bv, nv, lv = F.col(f"k_{i}"), F.col(f"b.{f.name}"), F.col(f"n.{f.name}"), F.col(f"l.{f.name}")
            moved = ~nv.eqNullSafe(bv)
            both_add = F.lit(False)
            total = lv
            if f.type in _NUMBERS:
                theirs = F.col("adds")[f.name]
                both_add = F.coalesce((kind == "A") & (theirs == (nv - bv).cast("double")), F.lit(False))
                total = (nv + (lv - bv)).cast(SPARK[f.type])
            equal = (kind == "S") & lv.eqNullSafe(nv)
            wrote = kind.isNotNull() & moved
            lww = F.lit(self.policies.get((table, f.name)) == merge.LWW)
            results.append(F.when(kind.isNull(), nv).when(~moved, lv).when(both_add, total).otherwise(lv).alias(f.name))
            commutes.append(wrote & both_add)
            losses.append(wrote & ~both_add & ~equal & lww)
            conflicts.append(wrote & ~both_add & ~equal & ~lww)
        some = lambda cs: F.array_contains(F.array(F.lit(False), *cs), True)
        guard_ok = F.lit(True)
        for text in [r["g"] for r in last.select(F.explode("guards").alias("g")).distinct().collect()]:  # at most one a statement
            guard_ok = guard_ok & (~F.array_contains("guards", text) | F.coalesce(self._guard(m, text), F.lit(False)))
        update = had & ~gone & there
        by_name = dict(zip([f.name for f in values], results, strict=True))
        broken = []
        for (t, c), (floor, ceiling) in self.bounds.items():  # of the merged value, which neither side may have seen
            if t == table and c in by_name:
                v = F.when(update, by_name[c]).otherwise(F.col(f"l.{c}"))
                broken += [F.coalesce(v < floor, F.lit(False))] * (floor is not None) + [F.coalesce(v > ceiling, F.lit(False))] * (ceiling is not None)
        out_of_bounds = ~gone & some(broken)
        reason = (
            F.when(~had & ~gone & there, "ContradictoryAssign")
            .when(had & gone & there & ~same, "DeleteVsWrite")
            .when(had & ~gone & ~there, "DeleteVsWrite")
            .when(update & some(conflicts), "ContradictoryAssign")
            .when(had & there & ~guard_ok, "GuardFailed")
            .when(out_of_bounds, "BoundViolated")
        )
        action = F.when(reason.isNotNull(), "none").when(~had, F.when(gone, "none").otherwise("insert")).when(gone, F.when(there, "delete").otherwise("none")).otherwise("update")
        outcome = F.when(reason.isNotNull(), merge.CONFLICT).when(update & some(losses), merge.LOSS).when(update & some(commutes), merge.COMMUTING).otherwise(merge.CLEAN)
        after = F.when(action == "insert", F.struct(*(F.col(f"l.{n}").alias(n) for n in names))).when(action == "update", F.struct(F.col(key), *results))
        kinds = F.map_from_arrays(F.array(*(F.lit(f.name) for f in values)), F.array(*(F.col(f"k_{i}") for i in range(len(values))))) if values else F.lit(None).cast("map<string,string>")
        return m, j.select(key, F.col("b").alias("fork"), F.col("n").alias("before"), after.alias("after"), action.alias("action"), outcome.alias("outcome"), reason.alias("reason"), "guards", kinds.alias("kinds"))

    def _guard(self, m: Manifest, text: str) -> Column:
        """A statement's condition on the target's row, typed as the statement's own."""
        c = Binder(Scope().add("n", m.fields)).boolean(parse_expression(text))
        return c

    def _applied_adds(self, table: str, b: Branch) -> DataFrame | None:
        """(_akey, adds): per row the sums of what merges since the fork added to its columns."""
        if b.parent is not None:
            return None
        paths = [f"{self.store.root}/merges/{m['id']}/{table}" for m in self.merges if m["commit"] > b.fork and table in m["tables"]]
        if not paths:
            return None
        rows = self.spark.read.parquet(*paths).where("action = 'update'")
        m = self.store.manifest(table, b.fork)
        numbers = [f.name for f in m.fields[1:] if f.type in _NUMBERS]
        if not numbers:
            return None
        add = lambda c: F.sum(F.when(F.col("kinds")[c] == "A", (F.col(f"after.{c}") - F.col(f"before.{c}")).cast("double")).otherwise(0.0))
        sums = rows.groupBy(F.col(m.key).cast("string").alias("_akey")).agg(*(add(c).alias(f"a_{i}") for i, c in enumerate(numbers)))
        return sums.select("_akey", F.map_from_arrays(F.array(*(F.lit(c) for c in numbers)), F.array(*(F.col(f"a_{i}") for i in range(len(numbers))))).alias("adds"))

    def merge(self, b: Branch) -> dict:
        """Publish the branch as one commit, or nothing; the report says which and why."""
        if b.state == QUARANTINED:
            raise BranchError(f"{b.name} is quarantined ({b.reason}); release it first")
        self.refresh()
        number = max((int(n[2:]) for n in self.store.names("merges")), default=0) + 1
        while not self.store.create(f"merges/m_{number}/begun.json", json.dumps({"branch": b.name})):
            number += 1
        ident = f"m_{number}"
        base = self.store.head()
        report = {"merge": ident, "branch": b.name, "outcome": merge.CLEAN, "conflicts": [], "n_conflicts": 0, "rows": 0, "published": False, "blind": []}
        found: dict[str, tuple[Manifest, DataFrame]] = {}
        for table in self.touched(b):
            if self._schema_moved(b, table, base):
                report["outcome"], report["n_conflicts"] = merge.CONFLICT, report["n_conflicts"] + 1
                report["conflicts"].append({"table": table, "key": None, "reason": "SchemaMismatch", "guards": []})
                continue
            m, rows = self.resolve(b, table)
            path = f"{self.store.root}/merges/{ident}/{table}"
            rows.write.parquet(path)  # computed once; read by the report, the commit and later merges
            rows = self.spark.read.parquet(path)
            found[table] = (m, rows)
            total = rows.agg(merge.overall().alias("o"), F.count_if(F.col("action") != "none").alias("n"), F.count("reason").alias("bad")).first()
            if total["o"] is not None and merge.RANK[total["o"]] > merge.RANK[report["outcome"]]:
                report["outcome"] = total["o"]
            report["rows"] += total["n"]
            report["n_conflicts"] += total["bad"]
            bad = rows.where("reason is not null").select(m.key, "reason", "guards").limit(100).collect()  # the first; ``conflicts`` gives all
            report["conflicts"] += [{"table": table, "key": r[0], "reason": r[1], "guards": sorted(r[2])} for r in bad]
            if not any(t == table and kind == "pred" for t, kind, *_ in b.reads):
                report["blind"] += [table] if rows.join(self._read_keys(b.reads, table, m), m.key, "left_anti").limit(1).count() else []
        status, findings = gate.evaluate(self.checks, {"branch": b, "engine": self})
        report["gate"], report["findings"] = status, [asdict(x) for x in findings]
        if report["outcome"] == merge.CONFLICT or status != gate.PASS:
            if status != gate.PASS and report["outcome"] != merge.CONFLICT:
                self.quarantine(b, "; ".join(f.detail for f in findings if f.status != gate.PASS))
            self._record(ident, b, -1, [], report)
            return report
        if b.parent is not None:
            parent = self.branches[b.parent]
            for table, (m, rows) in found.items():
                self._stage_result(parent, m, rows)
            self.save(parent)
            commit = base
        else:
            changes = {t: self.applied(self.store.manifest(t, base), rows) for t, (_, rows) in found.items()}
            commit = self.store.publish(base, changes) if changes else base
        report["published"], report["commit"] = True, commit
        self._record(ident, b, commit, sorted(found), report)
        self.end(b, MERGED)
        return report

    def conflicts(self, ident: str) -> DataFrame | None:
        """(tbl, key, reason, guards): all conflicts of a merge that was tried, of any number."""
        out = None
        for name in self.store.names(f"merges/{ident}"):
            if name.endswith(".json"):
                continue
            rows = self.spark.read.parquet(f"{self.store.root}/merges/{ident}/{name}").where("reason is not null")
            rows = rows.select(F.lit(name).alias("tbl"), F.col(rows.columns[0]).cast("string").alias("key"), "reason", "guards")
            out = rows if out is None else out.unionByName(rows)
        return out

    def _schema_moved(self, b: Branch, table: str, base: int) -> bool:
        """Whether the target's table has gone or has other columns than the branch was forked with."""
        if b.parent is not None:
            return False
        now = self.store.commit(base)["tables"].get(table)
        return now is None or self.store.manifest(table, base).fields != self.store.manifest(table, b.fork).fields

    def _read_keys(self, reads: list[list], table: str, m: Manifest) -> DataFrame:
        """The keys that a branch read exactly, one a statement, as rows."""
        keys = sorted({r[2] for r in reads if r[0] == table and r[1] == "exact"})
        return self.spark.createDataFrame([(k,) for k in keys], T.StructType([T.StructField(m.key, m.schema[m.key].dataType)]))

    def _record(self, ident: str, b: Branch, commit: int, tables: list[str], report: dict) -> None:
        entry = {"id": ident, "branch": b.name, "commit": commit, "fork": b.fork, "tables": tables, "agent": b.agent, "prov": b.prov, "reads": b.reads, "outcome": report["outcome"], "reverted": False}
        self.merges.append(entry)
        self.store.create(f"merges/{ident}/merge.json", json.dumps(entry))

    def _stage_result(self, parent: Branch, m: Manifest, rows: DataFrame) -> None:
        parent.seq += 1
        gone = F.col("action") == "delete"
        image = [F.when(gone, F.col(f"before.{n}")).otherwise(F.col(f"after.{n}")).alias(n) for n in m.names]
        out = rows.where("action <> 'none'").select(*image, gone.alias("_deleted"), F.lit(parent.seq).alias("_seq"), F.col("kinds").alias("_kinds"), F.array().cast("array<string>").alias("_guard"))
        parent.deltas.setdefault(m.table, []).extend(self.store.write_part(f"overlays/b_{parent.id}/{m.table}", out, m.key))

    def applied(self, m: Manifest, rows: DataFrame) -> Manifest:
        """The manifest after the rows' actions: only parts whose key range they meet are rewritten."""
        key = m.key
        act = rows.where("action <> 'none'")
        span = act.where("action <> 'insert'").agg(F.min(key).alias("lo"), F.max(key).alias("hi"), F.count("*").alias("n")).first()
        hit, rest = self.store.split(m, span["lo"], span["hi"]) if span["n"] else ([], m.parts)
        if hit:  # of those in range, by their key column alone, the ones that hold a touched row
            meet = self.store.read(m, hit).select(key, "_metadata").join(act.where("action <> 'insert'").select(key), key, "left_semi")
            hit, others, _ = self.store.holding(hit, meet)
            rest = rest + others
        new = act.where("action <> 'delete'").select(*(F.col(f"after.{n}").alias(n) for n in m.names))
        if hit:
            kept = self.store.read(m, hit).join(act.select(key), key, "left_anti").select(*m.names)
            new = kept.unionByName(new)
        born = self.store.head() + 1
        return self.store.with_parts(m, rest + self.store.write_part(f"data/{m.table}", new, key, born, ranged=True, indexes=m.indexes))

    def _premise(self, facts: dict) -> list[gate.Finding]:
        """Rows that the branch read by key and did not write must be on the target as they were at the fork."""
        b, out = facts["branch"], []
        if b.parent is not None:
            return out
        certainty = "heuristic" if any(r[1] == "pred" for r in b.reads) else "exact"
        head = self.store.head()
        for table in sorted({r[0] for r in b.reads if r[1] == "exact"}):
            if self._schema_moved(b, table, head):
                continue  # a conflict of its own
            m = self.store.manifest(table, b.fork)
            keys = self._read_keys(b.reads, table, m)
            pick = lambda df, m=m, keys=keys: df.join(keys, m.key, "left_semi")
            moved = overlay.row_diff(pick(self.view(table, at=b.fork)), pick(self.view(table)), m.key).select(m.key)
            if own := self.own_parts(b, table):
                moved = moved.join(self._delta(m, own).select(m.key), m.key, "left_anti")
            if n := moved.count():
                some = sorted(r[0] for r in moved.limit(20).collect())
                out.append(gate.Finding("read_premise", gate.QUARANTINE, f"{n} row(s) of {table} changed after {b.name} read them at commit {b.fork}, now {head}: {some}{' and more' if n > len(some) else ''}", certainty))
        return out

    # -- revert ---------------------------------------------------------------------------------

    def dependents_of(self, ident: str) -> list[str]:
        """Merges that transitively read what this one wrote: forked after it, and their reads meet its rows."""
        self.refresh()
        done = {m["id"]: m for m in self.merges if m["commit"] >= 0 and not m["reverted"]}
        if ident not in done:
            raise MergeError(f"{ident} is not a published merge that can be reverted; there are {', '.join(done) or 'none'}")
        found, queue = [], [ident]
        while queue:
            w = queue.pop(0)
            for r in self._readers(done, w):
                if r not in (ident, *found):
                    found.append(r)
                    queue.append(r)
        return sorted(found, key=lambda i: int(i[2:]))

    def _readers(self, done: dict[str, dict], writer: str) -> list[str]:
        w = done[writer]
        return [r["id"] for r in done.values() if r["id"] != writer and r["fork"] >= w["commit"] and any(self._reads_meet(r, w, t) for t in w["tables"])]

    def revert_tree(self, ident: str) -> str:
        """What depends on a merge, as an indented text."""
        deps = self.dependents_of(ident)
        done = {m["id"]: m for m in self.merges if m["id"] in (ident, *deps)}
        return provenance.render_tree(ident, {i: self._readers(done, i) for i in done})

    def _reads_meet(self, reader: dict, writer: dict, table: str) -> bool:
        m = self.store.manifest(table, writer["commit"])
        wrote = self.spark.read.parquet(f"{self.store.root}/merges/{writer['id']}/{table}").where("action <> 'none'")
        if any(r[0] == table and r[1] == "exact" for r in reader["reads"]) and wrote.join(self._read_keys(reader["reads"], table, m), m.key, "left_semi").limit(1).count():
            return True
        for t, kind, text, *_ in reader["reads"]:
            if t == table and kind == "pred":
                if not text:
                    return True
                if wrote.where("after is not null").where(Binder(Scope().add("after", m.fields)).boolean(parse_expression(text))).limit(1).count():
                    return True
        return False

    def revert(self, ident: str, cascade: bool = False) -> dict:
        """Undo a merge, and with ``cascade`` what depends on it, the deepest first; without, dependents stop it."""
        deps = self.dependents_of(ident)
        if deps and not cascade:
            return {"reverted": [], "halted": True, "dependents": deps, "tree": self.revert_tree(ident)}
        for i in [*sorted(deps, key=lambda x: -int(x[2:])), ident]:
            self._undo(next(m for m in self.merges if m["id"] == i))
        return {"reverted": [*sorted(deps, key=lambda x: -int(x[2:])), ident], "halted": False, "dependents": deps}

    def _undo(self, entry: dict) -> None:
        base, changes = self.store.head(), {}
        for table in entry["tables"]:
            m = self.store.manifest(table, base)
            did = self.spark.read.parquet(f"{self.store.root}/merges/{entry['id']}/{table}").where("action <> 'none'")
            now = self.store.read(m).join(did.select(m.key), m.key, "left_semi").select(m.key, F.struct(*m.names).alias("now"))
            j = did.join(now, m.key, "left")
            back = []
            for f in m.fields[1:]:
                was, is_, cur, kind = F.col(f"before.{f.name}"), F.col(f"after.{f.name}"), F.col(f"now.{f.name}"), F.col("kinds")[f.name]
                undone = F.when(kind == "A", (cur - (is_ - was)).cast(SPARK[f.type])).when(kind == "S", was).otherwise(cur) if f.type in _NUMBERS else F.when(kind.isNotNull(), was).otherwise(cur)
                back.append(undone.alias(f.name))
            updated = (F.col("action") == "update") & F.col("now").isNotNull()
            after = F.when(updated, F.struct(F.col(m.key), *back)).when(F.col("action") == "delete", F.col("before"))
            action = F.when(updated, "update").when((F.col("action") == "insert") & F.col("now").isNotNull(), "delete").when((F.col("action") == "delete") & F.col("now").isNull(), "insert").otherwise("none")
            changes[table] = self.applied(m, j.select(m.key, after.alias("after"), action.alias("_act")).withColumnRenamed("_act", "action"))
        self.store.publish(base, changes)
        entry["reverted"] = True
        self.store.create(f"merges/{entry['id']}/reverted.json", json.dumps({"commit": self.store.head()}))

    # -- authorship -------------------------------------------------------------------------------

    def who_wrote(self, table: str, key: object) -> str:
        """The run whose merge last wrote a row; writes without a session are unattributed."""
        self.refresh()
        for m in reversed(self.merges):
            if m["commit"] >= 0 and table in m["tables"]:
                rows = self.spark.read.parquet(f"{self.store.root}/merges/{m['id']}/{table}")
                name = self.store.manifest(table, m["commit"]).key
                if rows.where((F.col(name) == F.lit(key)) & (F.col("action") != "none")).limit(1).count():
                    return self.runs.describe(m["prov"])
        return self.runs.describe(self.runs.NONE)


class Session:
    """One connection: autocommit, an explicit transaction, or a branch session."""

    def __init__(self, engine: Engine):
        self.engine, self.store = engine, engine.store
        self._branch: Branch | None = None
        self._generation = 0
        self.txn: dict | None = None  # {"base": commit, "changes": {table: Manifest}}

    @property
    def branch(self) -> Branch | None:
        return self._branch

    @branch.setter
    def branch(self, b: Branch | None) -> None:
        self._branch, self._generation = b, b.generation if b else 0

    # -- statements ------------------------------------------------------------------------------

    def execute(self, text: str) -> Result:
        """Run the text's statements; the last one's result."""
        out = Result("nothing to do")
        for s in parse(text):
            if self.branch is not None:
                self.engine.check(self.branch, self._generation)
            try:
                out = getattr(self, f"_{s.kind}")(s)
            except EngineError:
                if self.txn is not None and s.kind in ("insert", "update", "delete", "select", "commit"):
                    self.txn = None  # an error ends the transaction
                raise
        return out

    def query(self, text: str) -> DataFrame:
        """A SELECT's DataFrame, which takes all that Spark can do."""
        return self.execute(text).df

    def _base(self) -> int:
        """The commit that a statement works on; it takes it once, and a write is published on top of that one."""
        return self.branch.fork if self.branch is not None else self.txn["base"] if self.txn else self.store.head()

    def _manifest(self, table: str, base: int | None = None) -> Manifest:
        if self.branch is None and self.txn and table in self.txn["changes"]:
            return self.txn["changes"][table]
        return self.store.manifest(table, self._base() if base is None else base)

    def _rows(self, ref: TableRef, where: tuple | None = None) -> tuple[Manifest, DataFrame]:
        if ref.branch is not None:
            b = self.engine.branch(ref.branch)
            return self.store.manifest(ref.name, b.fork), self.engine.view(ref.name, b)
        m = self._manifest(ref.name)
        if self.branch is not None:
            return m, self.engine.view(ref.name, self.branch)
        parts = [p for p in m.parts if all(p.may_hold(name, m.key, value) for name, value in _equalities(m, where))]
        return m, self.store.read(m, parts)

    def _select(self, s: Statement) -> Result:
        if s.joins and any(r.branch for r in (s.source, *(j.table for j in s.joins))):
            raise BindError("AS OF BRANCH reads a single table; join the DataFrames that query() returns")
        scope, m, df = Scope(), *self._rows(s.source, None if s.joins else s.where)
        scope.add(s.source.alias, m.fields)
        df = df.alias(s.source.alias)
        for j in s.joins:
            jm, right = self._rows(j.table)
            scope.add(j.table.alias, jm.fields)
            df = df.join(right.alias(j.table.alias), Binder(scope).boolean(j.on), {"inner": "inner", "left": "left", "right": "right", "full": "full_outer"}[j.kind])
        binder = Binder(scope)
        if s.where is not None:
            df = df.where(binder.boolean(s.where))
        columns: list[Column] = []
        for item in s.items:
            if item[0] == "star":
                chosen = [(a, f) for a, fs in scope.tables for f in fs if item[1] in (None, a)]
                if not chosen:
                    raise BindError(f"no table or alias {item[1]!r} for {item[1]}.*")
                columns += [column(a, f.name).alias(f.name) for a, f in chosen]
            else:
                columns.append(binder.bind(item)[0].alias(item[2] if item[0] == "col" else "?column?"))
        if self.branch is not None:
            self._note_read(m, s)
        return Result("SELECT", df.select(*columns))

    def _note_read(self, m: Manifest, s: Statement) -> None:
        """By shape, never by size: a key equal to a literal is an exact read, all else a predicate."""
        w = s.where
        if not s.joins and w is not None and w[0] == "=" and w[1][0] == "col" and w[1][2] == m.key and w[2][0] in ("num", "str"):
            value = w[2][1] if w[2][0] == "str" or m.fields[0].type == "DECIMAL" else float(w[2][1]) if "." in w[2][1] else int(w[2][1])
            self.branch.reads.append([m.table, "exact", value, self.branch.fork])  # the version read is the fork's
        else:
            self.branch.reads.append([m.table, "pred", "" if s.joins else s.where_text, self.branch.fork])
            self.branch.reads += [[j.table.name, "pred", "", self.branch.fork] for j in s.joins]
        self.engine.save(self.branch)

    def _explain(self, s: Statement) -> Result:
        df = self._select(s.inner).df
        return Result(df._jdf.queryExecution().explainString(self.engine.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("cost")), df)

    # -- writes ------------------------------------------------------------------------------------

    def _check(self, m: Manifest, rows: DataFrame, fields: list[Field]) -> None:
        """One aggregate finds every broken constraint before anything is staged."""
        tests = [(f"column {f.name!r} of {m.table!r} is NOT NULL", F.col(f.name).isNull()) for f in fields if not f.nullable or f.name == m.key]
        tests += [(f"a value is longer than {f.sql} of column {f.name!r} of {m.table!r}", F.octet_length(f.name) > f.size) for f in fields if f.type == "VARCHAR"]
        if tests:
            found = rows.agg(*(F.count_if(t).alias(f"t{i}") for i, (_, t) in enumerate(tests))).first()
            for i, (text, _) in enumerate(tests):
                if found[i]:
                    raise ConstraintError(f"{text}: {found[i]} row(s) refused, nothing was written")

    def _insert(self, s: Statement) -> Result:
        base = self._base()
        m = self._manifest(s.table, base)
        if len(s.items) != len(m.fields):
            raise BindError(f"{s.table!r} has {len(m.fields)} columns ({', '.join(m.names)}), VALUES has {len(s.items)}")
        binder = Binder(Scope())
        row = self.engine.spark.range(1).select(*(binder.value_for(e, f).alias(f.name) for e, f in zip(s.items, m.fields, strict=True)))
        self._check(m, row, m.fields)
        present = self.engine.view(s.table, self.branch) if self.branch is not None else self.store.read(m)
        if row.join(present.select(m.key), m.key, "left_semi").limit(1).count():
            raise ConstraintError(f"key {row.first()[0]!r} is in {s.table!r} already; UPDATE it or use another key")
        if self.branch is not None:
            return self._stage(m, row, F.lit(False), {n: "S" for n in m.names[1:]}, "")
        self._commit_parts(base, m, m.parts + self.store.write_part(f"data/{m.table}", row, m.key, base + 1, indexes=m.indexes))
        return Result("INSERT 1", count=1)

    def _update(self, s: Statement) -> Result:
        base = self._base()
        m = self._manifest(s.table, base)
        fields = {f.name: f for f in m.fields}
        binder = Binder(Scope().add(s.table, m.fields))
        new, kinds = {}, {}
        for name, e in s.items:
            binder.scope.find(None, name)
            if name == m.key:
                raise BindError(f"{name!r} is the key of {s.table!r} and cannot be assigned; DELETE and INSERT instead")
            new[name] = binder.value_for(e, fields[name])
            own = ("col", None, name)
            adds = (e[0] in ("+", "-") and e[1] == own and e[2][0] == "num") or (e[0] == "+" and e[2] == own and e[1][0] == "num")
            kinds[name] = "A" if adds and fields[name].type in _NUMBERS else "S"
        pred = F.coalesce(binder.boolean(s.where), F.lit(False)) if s.where is not None else F.lit(True)
        source = self.engine.view(s.table, self.branch) if self.branch is not None else self.store.read(m)
        changed = source.alias(s.table).where(pred).select(*(new.get(n, column(s.table, n)).alias(n) for n in m.names))
        self._check(m, changed, [fields[n] for n in new])
        if self.branch is not None:
            self._charge(m, source, changed, list(new))
            return self._stage(m, changed, F.lit(False), kinds, s.where_text)
        hit, rest, found = self._touched(m, pred)
        if hit:  # the other parts stay as they are
            rows = self.store.read(m, hit).alias(s.table).select(*(F.when(pred, new[n]).otherwise(column(s.table, n)).alias(n) if n in new else column(s.table, n).alias(n) for n in m.names))
            self._commit_parts(base, m, rest + self.store.write_part(f"data/{m.table}", rows, m.key, base + 1, ranged=True, indexes=m.indexes))
        return Result(f"UPDATE {found}", count=found)

    def _touched(self, m: Manifest, pred: Column) -> tuple[list[Part], list[Part], int]:
        """(parts with rows that the condition takes, the others, the number of such rows)."""
        if not m.parts:
            return [], [], 0
        hit, rest, found = self.store.holding(m.parts, self.store.read(m).alias(m.table).where(pred))
        return hit, rest, sum(found.values())

    def _delete(self, s: Statement) -> Result:
        base = self._base()
        m = self._manifest(s.table, base)
        binder = Binder(Scope().add(s.table, m.fields))
        pred = F.coalesce(binder.boolean(s.where), F.lit(False)) if s.where is not None else F.lit(True)
        if self.branch is not None:
            return self._stage(m, self.engine.view(s.table, self.branch).alias(s.table).where(pred).select(*m.names), F.lit(True), {}, s.where_text)
        hit, rest, found = self._touched(m, pred)
        if hit:
            rows = self.store.read(m, hit).alias(s.table).where(~pred).select(*m.names)
            self._commit_parts(base, m, rest + self.store.write_part(f"data/{m.table}", rows, m.key, base + 1, ranged=True, indexes=m.indexes))
        return Result(f"DELETE {found}", count=found)

    def _charge(self, m: Manifest, before: DataFrame, after: DataFrame, names: list[str]) -> None:
        """Decreases of bounded cells are charged as one batch, before anything is staged."""
        cells = [c for c in self.engine.ledger.slack if c[0] == m.table and c[2] in names]
        if not cells:
            return
        keys = sorted({c[1] for c in cells})  # the opened budgets
        pick = lambda df, p: df.where(F.col(m.key).isin(keys)).select(m.key, *(F.col(n).alias(f"{p}{n}") for n in names))
        costs = {}
        for r in pick(before, "b_").join(pick(after, "a_"), m.key).collect():
            for n in names:
                if (m.table, r[m.key], n) in cells and r[f"b_{n}"] is not None and r[f"a_{n}"] is not None:
                    costs[(m.table, r[m.key], n)] = int(r[f"b_{n}"] - r[f"a_{n}"])
        self.engine.ledger.spend(self.branch.name, costs)

    def _stage(self, m: Manifest, rows: DataFrame, deleted: Column, kinds: dict[str, str], guard: str) -> Result:
        b = self.branch
        kind_map = F.create_map(*(F.lit(x) for kv in kinds.items() for x in kv)) if kinds else F.lit(None)
        out = rows.select(*m.names, deleted.alias("_deleted"), F.lit(b.seq + 1).alias("_seq"), kind_map.cast("map<string,string>").alias("_kinds"), (F.array(F.lit(guard)) if guard else F.array().cast("array<string>")).alias("_guard"))
        parts = self.store.write_part(f"overlays/{b.name}/{m.table}", out, m.key)
        b.seq += 1
        if parts:
            b.deltas.setdefault(m.table, []).extend(parts)
        self.engine.save(b)
        count = sum(p.rows for p in parts)
        return Result(f"STAGED {count}", count=count)

    def _commit_parts(self, base: int, m: Manifest, parts: list[Part]) -> None:
        new = self.store.with_parts(m, parts)
        if self.txn is not None:
            self.txn["changes"][m.table] = new
        else:
            self.store.publish(base, {m.table: new})

    # -- definitions and transactions -----------------------------------------------------------------

    def _outside(self, what: str) -> None:
        if self.txn is not None or self.branch is not None:
            raise TransactionError(f"{what} is refused inside a transaction or agent session; finish it first")

    def _create_table(self, s: Statement) -> Result:
        self._outside("CREATE TABLE")
        base = self.store.head()
        if s.table in self.store.commit(base)["tables"]:
            raise BindError(f"table {s.table!r} exists; DROP TABLE it first")
        names = [c[0] for c in s.columns]
        if len(set(names)) < len(names):
            raise BindError(f"a column of {s.table!r} is named twice")
        self.store.publish(base, {s.table: Manifest(s.table, [Field(*c) for c in s.columns])})
        return Result("CREATE TABLE")

    def _drop_table(self, s: Statement) -> Result:
        self._outside("DROP TABLE")
        base = self._base()
        self.store.manifest(s.table, base)
        self.store.publish(base, {s.table: None})
        return Result("DROP TABLE")

    def _create_index(self, s: Statement) -> Result:
        """An index is each part's bounds of the column; lookups by it read only the parts that can hold the value."""
        self._outside("CREATE INDEX")
        base = self._base()
        m = self.store.manifest(s.table, base)
        if s.columns[0] not in m.names:
            raise BindError(f"no column {s.columns[0]!r} in {s.table!r}; columns are {', '.join(m.names)}")
        self.store.publish(base, {s.table: self.store.indexed(m, s.columns[0])})
        return Result("CREATE INDEX")

    def _analyze(self, s: Statement) -> Result:
        return Result("ANALYZE", mvcc.analyze(self.store.read(self._manifest(s.table))))

    def _begin(self, s: Statement) -> Result:
        self._outside("BEGIN")
        self.txn = {"base": self.store.head(), "changes": {}}
        return Result("BEGIN")

    def _commit(self, s: Statement) -> Result:
        if self.txn is None:
            raise TransactionError("no transaction to COMMIT; BEGIN one first")
        done, self.txn = self.txn, None
        if done["changes"]:
            self.store.publish(done["base"], done["changes"])
        return Result("COMMIT")

    def _rollback(self, s: Statement) -> Result:
        if self.txn is None:
            raise TransactionError("no transaction to ROLLBACK; BEGIN one first")
        self.txn = None
        return Result("ROLLBACK")

    # -- branch statements -----------------------------------------------------------------------------

    def _begin_session(self, s: Statement) -> Result:
        if self.txn is not None or self.branch is not None:
            raise BranchError("an agent session begins outside transactions and other sessions; COMMIT, MERGE or ABANDON first")
        self.branch = self.engine.fork(s.options["agent"], s.options.get("run"), s.options.get("model"))
        return Result(f"SESSION {self.branch.name}", report={"branch": self.branch.name})

    def _named(self, s: Statement, *states: str) -> Branch:
        if s.name:
            return self.engine.branch(s.name, *states)
        if self.branch is None:
            raise BranchError(f"{s.kind.upper()} needs an agent session or BRANCH name")
        return self.branch

    def _diff(self, s: Statement) -> Result:
        """(tbl, key, kind, ops, before, after, guards, status) of the branch's changes; images are JSON, ops say Add or Assign by column."""
        b, out = self._named(s), None
        for table in self.engine.touched(b):
            m, rows = self.engine.resolve(b, table)
            own = self.engine._delta(m, self.engine.own_parts(b, table)).select(m.key).distinct()
            cut = lambda df, own=own, m=m: df.join(own, m.key, "left_semi")
            d = overlay.row_diff(cut(self.engine.view(table, b, upto=b.inherited)), cut(self.engine.view(table, b)), m.key)
            named = lambda x: F.concat(x["key"], F.lit(": "), F.when(x["value"] == "A", "Add").otherwise("Assign"))
            ops = F.array_sort(F.transform(F.filter(F.map_entries("kinds"), lambda x: x["value"].isNotNull()), named))
            moved = rows.select(m.key, "guards", ops.alias("ops"), (overlay.differs("fork", "before", m.names) | (F.col("fork").isNull() != F.col("before").isNull())).alias("moved"))
            d = d.join(moved, m.key, "left").select(
                F.lit(table).alias("tbl"), F.col(m.key).cast("string").alias("key"), "kind", "ops", F.to_json("before").alias("before"), F.to_json("after").alias("after"), "guards",
                F.when(F.col("moved"), "pending (target moved)").otherwise("pending").alias("status"))
            out = d if out is None else out.unionByName(d)
        return Result("DIFF", out)

    def _merge(self, s: Statement) -> Result:
        b = self._named(s)
        report = self.engine.merge(b)
        if report["published"] and self.branch is not None and self.branch.id == b.id:
            self.branch = None
        return Result(f"MERGE {report['outcome']}", report=report)

    def _abandon(self, s: Statement) -> Result:
        b = self._named(s)
        self.engine.end(b, ABANDONED)
        self.engine._drop_overlays([b])
        if self.branch is not None and self.branch.id == b.id:
            self.branch = None
        return Result(f"ABANDON {b.name}")

    def _revert(self, s: Statement) -> Result:
        name = s.name if s.name.startswith("m_") else f"m_{s.name}"
        report = self.engine.revert(name, s.options["cascade"])
        return Result("REVERT " + ("halted" if report["halted"] else "done"), report=report)


def _equalities(m: Manifest, where: tuple | None) -> list[tuple[str, object]]:
    """(column, value) of the condition's parts that must all hold and compare a column with a literal of its type."""
    if where is None:
        return []
    if where[0] == "and":
        return _equalities(m, where[1]) + _equalities(m, where[2])
    if where[0] != "=" or where[1][0] != "col" or where[2][0] not in ("num", "str"):
        return []
    kind, name, text = {f.name: f.type for f in m.fields}.get(where[1][2]), where[1][2], where[2][1]
    if kind in ("INTEGER", "BIGINT", "TIMESTAMP") and where[2][0] == "num" and "." not in text:
        return [(name, int(text))]
    return [(name, text)] if kind == "VARCHAR" and where[2][0] == "str" else []
