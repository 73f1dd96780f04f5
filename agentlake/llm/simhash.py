"""SimHash fingerprints and their near-duplicate classes by pivot distance tables.

1. Each text's fingerprint is computed in one pass; what follows works on the distinct ones.
2. The pivot table has each fingerprint's Hamming distances to PIVOTS fixed reference
   fingerprints, taken over each of BLOCKS blocks of bits; over all blocks they add up to
   the distances themselves.  Two fingerprints within RADIUS bits differ in RADIUS blocks
   at most, so all coordinates of two blocks at least are equal: the coordinates of each
   pair of blocks name a cell of the table, and a link's two ends share a cell.  No link
   is lost, and with 16 references a cell has hardly more than the fingerprints that
   agree on the bits of its blocks.
3. In a cell every pair is held against the table: by the triangle inequality one whose
   distances to any reference differ by more than RADIUS is no link.  The survivors are
   verified.  A cell gives a chain through each class that it finds, not its pairs.  A cell
   of more than CHUNK fingerprints is dealt out as pairs of chunks, so none is gathered in
   one task; that copies each of a cell's n distinct fingerprints n / CHUNK times.
4. Classes are found by label propagation with pointer jumping on the distinct
   fingerprints that have an edge; each round is written to shared storage.  As edges are
   chains, no fingerprint has many; labels, which many share, are joined with a salt.

Defined results: null and empty texts have fingerprint zero, which is linked like any
other; a bit set in exactly half of the hashes is 0; texts of any length are read whole;
fingerprints of repeated rows are equal, so they are in one class, and ``survivors`` keeps
one of them; a null id is in the class of its fingerprint, but is a class's name only if
the class has no other id; further columns are ignored, whatever their names
(``survivors`` keeps them); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

SHINGLE = 3
RADIUS = 3
#: Blocks of bits; RADIUS + 2, so that two of them are untouched.
BLOCKS = 5
PIVOTS = 16
#: Fingerprints of a cell that one task compares with as many others at most.
CHUNK = 4096
#: Cells up to this size are compared many at a time.
SMALL = 48
#: Fingerprints of more documents than this are joined to them by broadcasting, if there are not too many.
HOT_ROWS = 10_000
BROADCAST_ROWS = 100_000
SALTS = 16
_SEED = 42
_MAX_ROUNDS = 60


def fingerprint(text: str) -> int:
    """64 bits: each is 1 if it is set in over half of the hashes of the text's shingles."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # of bytes: ASCII alone
    if not words:
        return 0
    line = b" ".join(words)
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    stop = np.cumsum(size + 1) - 1
    start = stop - size
    k = min(SHINGLE, len(words))
    digest = xxhash.xxh64_intdigest
    hashes = [digest(line[a:b], _SEED) for a, b in zip(start[: len(words) - k + 1].tolist(), stop[k - 1 :].tolist(), strict=True)]
    h = np.array(hashes, dtype=np.uint64)
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ``fp``, the fingerprint as a signed long, and ``h``, a hash of the text."""
    common.ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.array([fingerprint(t or "") for t in batch.column(2).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out.view(np.int64))], names=[id_col, "h", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.xxhash64(text_col).alias("h"), text_col).mapInArrow(run, f"`{id_col}` {kind}, h long, fp long")


def _masks() -> list[int]:
    cuts = [round(64 * i / BLOCKS) for i in range(BLOCKS + 1)]
    return [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:])]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def references() -> np.ndarray:
    return np.random.default_rng(_SEED).integers(0, 1 << 64, PIVOTS, dtype=np.uint64)


def distances(fps: np.ndarray) -> np.ndarray:
    """(fingerprints, PIVOTS): Hamming distances to the references; computed anew where they are used, as that costs less than moving them."""
    return np.bitwise_count(fps[:, None] ^ references()[None, :]).astype(np.int8)


def cells(nodes: DataFrame) -> DataFrame:
    """(fp, cell, key): the cell of the pivot table that each pair of blocks gives each distinct fingerprint."""
    near = lambda p, m: F.bit_count(F.col("fp").bitwiseXOR(F.lit(_signed(int(p)))).bitwiseAND(F.lit(_signed(m)))).cast("byte")
    blocks = nodes.select("fp", *(F.xxhash64(*(near(p, m) for p in references())).alias(f"b{k}") for k, m in enumerate(_masks())))
    keys = [F.xxhash64(*(f"b{k}" for k in pick)) for pick in combinations(range(BLOCKS), BLOCKS - RADIUS)]
    return blocks.select("fp", F.posexplode(F.array(*keys)).alias("cell", "key"))


def _survivors(fps: np.ndarray, table: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs (a, b) of places the table does not discard and are links."""
    kept = np.flatnonzero(np.abs(table[a] - table[b]).max(axis=1) <= RADIUS)
    return kept[np.bitwise_count(fps[a[kept]] ^ fps[b[kept]]) <= RADIUS]


def classes_of(fps: np.ndarray, left: int | None = None) -> np.ndarray:
    """For each fingerprint the number of its class among the links; with ``left``, of links between the first ``left`` and the rest."""
    table = distances(fps)
    label = np.arange(len(fps))
    order = np.argsort(table[:, 0], kind="stable") if left is None else left + np.argsort(table[left:, 0], kind="stable")
    key = table[order, 0].astype(np.int64)
    for i in range(len(fps) - 1 if left is None else left):
        if left is None:  # only a window of the first coordinate is compared
            a, lo, hi = order[i], i + 1, np.searchsorted(key, key[i] + RADIUS, side="right")
        else:
            a, at = i, int(table[i, 0])
            lo, hi = np.searchsorted(key, at - RADIUS), np.searchsorted(key, at + RADIUS, side="right")
        rest = order[lo:hi]
        links = rest[_survivors(fps, table, np.full(len(rest), a), rest)]
        if len(links):
            met = np.unique(np.append(label[links], label[a]))
            if len(met) > 1:
                label[np.isin(label, met)] = met[0]
    return label


def chains(fps: np.ndarray, label: np.ndarray) -> np.ndarray:
    """(edges, 2): for each label's fingerprints, in order of value, each with the next."""
    signed = fps.view(np.int64)
    order = np.lexsort((signed, label))
    same = label[order[1:]] == label[order[:-1]]
    return np.stack([signed[order[:-1]][same], signed[order[1:]][same]], axis=1)


def _many(fps: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Chains in many small cells at once; ``group`` numbers the cells, whose fingerprints lie together."""
    table = distances(fps)
    parent = list(range(len(fps)))
    step, links = 1, []
    while len(a := np.flatnonzero(group[step:] == group[:-step])):
        kept = _survivors(fps, table, a, a + step)
        links.append(np.stack([a[kept], a[kept] + step], axis=1))
        step += 1

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for a, b in np.concatenate(links).tolist() if links else []:
        parent[root(a)] = root(b)
    return chains(fps, np.fromiter(map(root, parent), dtype=np.int64, count=len(parent)))


def edges(nodes: DataFrame) -> DataFrame:
    """Edges (a, b) that connect what is linked among the distinct fingerprints ``fp`` of ``nodes``."""
    keyed = cells(nodes)
    sizes = common.materialize(keyed.groupBy("cell", "key").agg(F.count("*").alias("n")).where("n > 1"))
    zero = F.lit(0)
    dealt = keyed.join(sizes.where(F.col("n") <= CHUNK), ["cell", "key"]).select("cell", "key", zero.alias("x"), zero.alias("y"), "fp", zero.alias("c"))
    large = sizes.where(F.col("n") > CHUNK)
    if count := large.count():
        rows = keyed.join(F.broadcast(large) if count <= BROADCAST_ROWS else large, ["cell", "key"]).withColumn("chunks", F.ceil(F.col("n") / CHUNK).cast("int"))
        rows = rows.withColumn("c", F.pmod(F.xxhash64("fp", "cell"), F.col("chunks")).cast("int"))
        # (x, y): chunk pair; a fingerprint of chunk c goes to all pairs with c, its own one included
        pairs = F.transform(F.sequence(zero, F.col("chunks") - 1), lambda o: F.struct(F.least(o, F.col("c")).alias("x"), F.greatest(o, F.col("c")).alias("y")))
        dealt = dealt.unionByName(rows.select("cell", "key", "fp", "c", F.explode(pairs).alias("p")).select("cell", "key", "p.x", "p.y", "fp", "c"))
    return _grouped_edges(dealt)


def _grouped_edges(dealt: DataFrame) -> DataFrame:
    """Sorted groups are read from the partition's batches; of a group that goes on in the next batch no part is solved before."""
    common.ship(dealt.sparkSession)
    keys = ["cell", "key", "x", "y"]
    sorted_ = dealt.repartition(*keys).sortWithinPartitions(*keys)

    def solve(fps: np.ndarray, c: np.ndarray, x: int, y: int) -> np.ndarray:
        if x == y:
            return chains(fps, classes_of(fps))
        both = np.concatenate([fps[c == x], fps[c != x]])
        return chains(both, classes_of(both, int((c == x).sum())))

    def groups(batch: pd.DataFrame, last: bool) -> tuple[pd.DataFrame, pd.DataFrame]:
        """(edges of the groups that are whole, rows of the last group if it may go on)."""
        values = batch[keys].to_numpy()
        cut = np.flatnonzero((values[1:] != values[:-1]).any(axis=1)) + 1
        starts = np.concatenate(([0], cut, [len(batch)] if last else [])).astype(np.int64)
        end = int(starts[-1])
        size = np.diff(starts)
        fps, c = batch["fp"].to_numpy().view(np.uint64), batch["c"].to_numpy()
        small = np.repeat((size <= SMALL) & (values[starts[:-1], 2] == values[starts[:-1], 3]), size)
        found = [_many(fps[:end][small], np.repeat(np.arange(len(size)), size)[small])]
        for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            if not small[a]:
                found.append(solve(fps[a:b], c[a:b], int(values[a, 2]), int(values[a, 3])))
        return pd.DataFrame(np.concatenate(found), columns=["a", "b"]), batch.iloc[end:]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: pd.DataFrame | None = None
        for batch in batches:
            if rest is not None and len(rest):
                batch = pd.concat([rest, batch], ignore_index=True)
            if len(batch):
                found, rest = groups(batch, False)
                yield found
        if rest is not None and len(rest):
            yield groups(rest, True)[0]

    return sorted_.mapInPandas(run, "a long, b long").distinct()


def _spread(rows: DataFrame, table: DataFrame, key: str, by: str) -> DataFrame:
    """The join of rows, many of which may have one ``key``, with a table that has each key once.

    By sorting, never by broadcasting the rows: then those of one key would all lie where the table has it.
    """
    salted = table.withColumn("_salt", F.explode(F.array(*(F.lit(k) for k in range(SALTS)))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")).join(salted.hint("merge"), [key, "_salt"]).drop("_salt")


def components(edges_: DataFrame) -> DataFrame:
    """(fp, root): each node of the edges and the smallest node that it is connected with."""
    links = common.materialize(edges_.select("a", "b").union(edges_.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    count = links.count()
    labels = common.materialize(links.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("root")).withColumnRenamed("a", "fp"), count)
    for _ in range(_MAX_ROUNDS):
        near = links.join(labels.withColumnRenamed("fp", "b"), "b").groupBy(F.col("a").alias("fp")).agg(F.min("root").alias("near"))
        hooked = common.materialize(labels.join(near, "fp").select("fp", F.least("root", "near").alias("next"), F.col("root").alias("old")), count)
        jump = hooked.select("next").distinct().join(hooked.select(F.col("fp").alias("next"), F.col("next").alias("far")), "next")
        new = common.materialize(_spread(hooked, jump, "next", "fp").select("fp", F.least("next", "far").alias("root"), "old"), count)
        labels = new.select("fp", "root")
        if not new.where("root <> old").limit(1).count():
            return labels
    raise RuntimeError(f"components did not settle in {_MAX_ROUNDS} rounds")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, h, fp, root (the class) and component_id, the smallest id that its fingerprint's links reach."""
    found = common.materialize(fingerprints(docs, id_col, text_col))
    rows = found.count()
    nodes = common.materialize(found.groupBy("fp").agg(F.min(id_col).alias("least"), F.count("*").alias("n")), rows)
    linked = nodes.join(components(edges(nodes)), "fp").select("fp", "least", "root")
    named = _spread(linked, linked.groupBy("root").agg(F.min("least").alias("name")), "root", "fp").select("fp", "root", "name")
    placed = nodes.join(named, "fp", "left").select("fp", "n", F.coalesce("root", "fp").alias("root"), F.coalesce("name", "least").alias("component_id"))
    placed = common.materialize(placed, rows)
    hot = placed.where(F.col("n") > HOT_ROWS).drop("n")
    count = hot.count()
    if not 0 < count <= BROADCAST_ROWS:
        return found.join(placed.drop("n"), "fp")
    return found.join(placed.where(F.col("n") <= HOT_ROWS).drop("n"), "fp").unionByName(found.join(F.broadcast(hot), "fp"))


def survivors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input's columns of one row of each class: the one with the smallest id (null last)."""
    found = common.materialize(classes(docs, id_col, text_col).select(id_col, "h", "root"))
    first = F.struct(F.col(id_col).isNull().alias("n"), F.col(id_col).alias("i"), F.col("h"))
    keep = found.groupBy("root").agg(F.min(first).alias("k")).select(F.col("k.i").alias("__al_i"), F.col("k.h").alias("__al_h"))
    # texts move once, to the partition of their id, against ids and hashes in a hash table
    out = docs.withColumn("__al_t", F.xxhash64(text_col))
    out = out.join(keep.distinct().hint("shuffle_hash"), out[id_col].eqNullSafe(F.col("__al_i")) & (F.col("__al_t") == F.col("__al_h")), "left_semi")
    if found.groupBy(id_col, "h").count().where("count > 1").limit(1).count():
        out = out.dropDuplicates([id_col, "__al_t"])  # repeated rows
    return out.select(*(F.col(f"`{c}`") for c in docs.columns))


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
