"""Who wrote what, what depended on it, and what a revert must undo."""

from __future__ import annotations

import json
import re
import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agentlake.errors import ProvenanceError

SALTS = 16


def last_writer(applied: DataFrame, key: str = "key", order: tuple[str, ...] = ("version",), author: str = "author") -> DataFrame:
    """(key, author): the author of each key's last applied operation."""
    return applied.groupBy(key).agg(F.max_by(author, F.struct(*order)).alias(author))


def authors_of(applied: DataFrame, key: str = "key", author: str = "author") -> DataFrame:
    return applied.groupBy(key).agg(F.array_sort(F.collect_set(author)).alias("authors"))


def moved_premises(reads: DataFrame, versions: DataFrame, key: str = "key") -> DataFrame:
    """Exact reads whose version is no longer current, with both versions; a key that is gone has a null one."""
    joined = reads.join(versions.select(key, F.col("version").alias("version_now")), key, "left")
    return joined.where(~F.col("version").eqNullSafe(F.col("version_now")))


def dependency_edges(writes: DataFrame, reads: DataFrame, ranges: DataFrame | None = None) -> DataFrame:
    """(writer, reader): a transaction read exactly the version that another wrote, or a range that held its value.

    ``writes`` (txn, key, version, value, ts), ``reads`` (txn, key, version), ``ranges``
    (txn, tbl, lo, hi, observed_at) with ``writes.tbl``; a range read sees earlier writes only.
    """
    w = writes.select(F.col("txn").alias("writer"), "key", "version")
    edges = w.join(reads.select(F.col("txn").alias("reader"), "key", "version"), ["key", "version"]).select("writer", "reader")
    if ranges is not None:
        points = writes.select(F.col("txn").alias("writer"), "tbl", "value", "ts")
        hits = range_join(points, ranges.withColumnRenamed("txn", "reader"), "value", "lo", "hi", ["tbl"])
        edges = edges.unionByName(hits.where("ts < observed_at").select("writer", "reader"))
    return edges.where("writer <> reader").distinct()


def range_join(points: DataFrame, ranges: DataFrame, value: str, low: str, high: str, on: list[str]) -> DataFrame:
    """Pairs with low <= value < high and equal ``on`` columns, without comparing all pairs.

    A range belongs to the level of the power of two that is not less than its width, and so
    meets three bins of that level at most; a point looks in its one bin of each level that
    some range has, so these pairs are an equi-join.  A null bound is open; such a range
    would be one bin with everything beyond its other bound, so it is compared with the
    points of its ``on`` columns, which a salt deals out over SALTS tasks.
    """
    lo, hi = F.col(low).cast("double"), F.col(high).cast("double")
    inside = (F.col(low).isNull() | (F.col(value) >= F.col(low))) & (F.col(high).isNull() | (F.col(value) < F.col(high)))
    closed = ranges.where(lo < hi).withColumn("_level", F.ceil(F.log2(F.greatest(hi - lo, F.lit(1e-9)))).cast("int"))
    levels = [r[0] for r in closed.select("_level").distinct().collect()]  # exponents of doubles: at most some hundreds
    salts = F.explode(F.array(*(F.lit(k) for k in range(SALTS)))).alias("_salt")
    half = ranges.where(lo.isNull() | hi.isNull()).select(*ranges.columns, salts)
    salted = points.withColumn("_salt", F.pmod(F.xxhash64(*points.columns), F.lit(SALTS)).cast("int"))
    out = salted.join(half, [*on, "_salt"]).where(inside).drop("_salt")
    if not levels:
        return out
    # bins are whole doubles, far from exact beyond 2**53 bins, but equal for equal quotients
    cut = lambda x, k: F.floor(F.greatest(F.least(x / F.pow(F.lit(2.0), k), F.lit(9e18)), F.lit(-9e18)))
    binned = closed.withColumn("_bin", F.explode(F.sequence(cut(lo, F.col("_level")), cut(hi, F.col("_level")))))
    spots = F.array(*(F.struct(F.lit(k).alias("_level"), cut(F.col(value).cast("double"), F.lit(float(k))).alias("_bin")) for k in levels))
    placed = points.withColumn("_s", F.explode(spots)).select(*points.columns, "_s._level", "_s._bin")
    joined = placed.join(binned, [*on, "_level", "_bin"]).where(inside).drop("_level", "_bin")
    return joined.unionByName(out)


def dependents(edges: DataFrame, roots: DataFrame, materialize=None, most_rounds: int = 1000) -> DataFrame:
    """(root, txn): everything that transitively read from each root; cycles end by the anti-join.

    ``edges`` (writer, reader), ``roots`` (root).  Each round extends the frontier alone;
    ``materialize`` writes a round's result to storage that outlives executors.
    """
    keep = materialize or checkpointed
    edges = keep(edges)
    frontier = keep(roots.select("root", F.col("root").alias("txn")).distinct())
    found = frontier
    for _ in range(most_rounds):
        step = frontier.join(edges, frontier["txn"] == edges["writer"]).select("root", F.col("reader").alias("txn")).distinct()
        frontier = keep(step.join(found, ["root", "txn"], "left_anti"))
        if not frontier.limit(1).count():
            return found.where("root <> txn")
        found = keep(found.unionByName(frontier))
    raise ProvenanceError(f"dependents did not settle in {most_rounds} rounds")


def shared_folder(spark) -> str:
    """The folder that driver and executors share; one of our own only where all run in one process."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        found = sc.getConf().get("spark.checkpoint.dir")
        if not found and not re.fullmatch(r"local(\[[^]]*\])?", sc.master):
            raise ProvenanceError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(found or tempfile.mkdtemp(prefix="agentlake-checkpoint-"))
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Written once to the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


class Runs:
    """Interned runs: an id for each (agent, run, model); the same run again gives the same id.

    With a store they are files whose names are given once, so they outlive the engine and
    two engines never give one id twice.
    """

    NONE = 0

    def __init__(self, store=None) -> None:
        self.store = store
        self.rows: list[tuple[int, str, str | None, str | None]] = []
        self._load()

    def _load(self) -> None:
        for name in self.store.names("runs")[len(self.rows) :] if self.store else []:
            self.rows.append((len(self.rows) + 1, *json.loads(self.store.load(f"runs/{name}"))))

    def intern(self, agent: str, run: str | None = None, model: str | None = None) -> int:
        while True:
            self._load()
            for i, a, r, m in self.rows:
                if r == run and run is not None and (a, m) != (agent, model):
                    raise ProvenanceError(f"run {run!r} belongs to {a!r} with model {m!r}; use another run name for {agent!r}")
                if (a, r, m) == (agent, run, model):
                    return i
            i = len(self.rows) + 1
            if self.store is None:
                self.rows.append((i, agent, run, model))
                return i
            self.store.create(f"runs/{i:09d}.json", json.dumps([agent, run, model]))  # or another engine has: look again

    def describe(self, prov: int) -> str:
        if prov == self.NONE:
            return "unattributed"
        if prov > len(self.rows):
            self._load()
        _, agent, run, model = self.rows[prov - 1]
        return agent + (f" run {run}" if run else "") + (f" model {model}" if model else "")


def render_tree(root: str, children: dict[str, list[str]]) -> str:
    """What a halted revert shows: each dependent below what it read from; one that is above itself already is not followed."""
    out = [f"{root} (to be reverted)"]

    def walk(node: str, depth: int, path: tuple[str, ...]) -> None:
        for c in children.get(node, []):
            out.append("  " * depth + c + (" (again)" if c in path else ""))
            if c not in path:
                walk(c, depth + 1, (*path, c))

    walk(root, 1, (root,))
    return "\n".join(out)
