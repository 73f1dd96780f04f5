"""Benchmark decontamination by pigeonhole edit matching.

Texts are compared as lower-cased runs of letters and digits joined by single spaces.  A
passage matches an item if its edit distance to the item's whole text is at most the
item's error budget, ERRORS of its length rounded down.  The item is split into budget + 1
pieces: at most ``budget`` edits cannot touch all of them, so every match contains a piece
unchanged.  All pieces are found in one pass over each text with an Aho-Corasick
automaton.

The pieces are short (8 to 10 characters), so most hits are chance.  They are the leaves of
a binary tree whose nodes have a budget each, children's budgets + 1 together: a match
within a node's budget is within the budget of one of its children, and so there is a leaf
hit above which every node matches.  From each hit the nodes are tried upwards, and chance
hits mostly end at the first; only around those that reach the root is the item's whole
pattern verified with Myers' bit-parallel approximate matching.

Items of fewer than MIN_CHARS normalised characters have budget 0 and match where they
stand word for word, between word borders; longer ones also match inside words.

The items go to the workers in blocks of BLOCK_CHARS characters, each with a pass over
the documents of its own, so the automaton's size is bounded whatever the benchmark's.

Defined results: null and empty texts match nothing, nor do null items and those without a
letter or digit; an item of one common word matches every text with that word; items with equal
text each get their row; repeated documents each get theirs; rows are one a document
row, item: the match of least distance, then least end; a text of any length is searched
whole; further columns are ignored, whatever their names (``clean`` keeps them); an empty
table of documents gives an empty result, an empty benchmark matches nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Edits a character of the item.
ERRORS = 0.1
#: Shorter items are matched exactly.
MIN_CHARS = 40
BLOCK_CHARS = 4_000_000
_GAP = re.compile(r"[\W_]+")


def normal(text: str) -> str:
    return _GAP.sub(" ", text.lower()).strip()


def budget(pattern: str) -> int:
    return int(ERRORS * len(pattern)) if len(pattern) >= MIN_CHARS else 0


def halves(lo: int, hi: int, most: int) -> list[tuple[int, int, int]]:
    """The children (begin, end, budget) of a node of budget 1 at least; their budgets and 1 make its own."""
    left = (most + 2) // 2
    cut = lo + (hi - lo) * left // (most + 1)
    return [(lo, cut, left - 1), (cut, hi, most - left)]


def pieces(pattern: str) -> list[tuple[int, str, tuple[int, int, int] | None]]:
    """(offset, piece, parent): budget + 1 pieces of about equal length that make up the pattern, from left to right."""
    out = []

    def walk(node: tuple[int, int, int], parent: tuple[int, int, int] | None) -> None:
        if node[2]:
            for child in halves(*node):
                walk(child, node)
        else:
            out.append((node[0], pattern[node[0] : node[1]], parent))

    walk((0, len(pattern), budget(pattern)), None)
    return out


def above(pattern: str, at: int) -> list[tuple[int, int, int]]:
    """The nodes between root and leaf, without either, from the leaf at this offset upwards."""
    node, out = (0, len(pattern), budget(pattern)), []
    while node[2]:
        left, right = halves(*node)
        node = left if at < left[1] else right
        out.append(node)
    return out[-2::-1]


def sibling(pattern: str, line: str, start: int, at: int, size: int, parent: tuple[int, int, int]) -> bool:
    """False if the rest of the parent cannot stand beside the hit: of its budget + 1 parts none is there unchanged."""
    lo, hi, most = parent
    if at > lo:
        a, b, near = lo, at, line[max(0, start - (at - lo) - most) : start]
    else:
        a, b, near = at + size, hi, line[start + size : start + hi - at + most]
    n = most + 1
    return any(pattern[a + (b - a) * i // n : a + (b - a) * (i + 1) // n] in near for i in range(n))


def myers(pattern: str, text: str, most: int) -> tuple[int, int] | None:
    """(least distance of the pattern to any substring of the text, first end of one), or None above ``most``."""
    m = len(pattern)
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, best = full, 0, m, None
    for j, c in enumerate(text):
        eq = masks.get(c, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        ph = minus | (~(xh | plus) & full)
        mh = plus & xh
        if ph & top:
            score += 1
        if mh & top:
            score -= 1
        ph = (ph << 1) & full  # the text may begin anywhere
        mh = (mh << 1) & full
        plus = mh | (~(xv | ph) & full)
        minus = ph & xv
        if score <= most and (best is None or score < best[0]):
            best = (score, j + 1)
            if not score:
                break
    return best


class Matcher:
    """Automaton over the pieces of one block of items."""

    def __init__(self, items: list[tuple[int, str]]):
        self.items = [(i, p) for i, t in items if (p := normal(t))]
        places: dict[str, list[tuple]] = {}
        for k, (_, p) in enumerate(self.items):
            if len(p) < MIN_CHARS:
                places.setdefault(f" {p} ", []).append((k, None, None))
                continue
            for at, piece, parent in pieces(p):
                places.setdefault(piece, []).append((k, at, parent))
        self.automaton = ahocorasick.Automaton()
        for piece, where in places.items():
            self.automaton.add_word(piece, (len(piece), where))
        if places:
            self.automaton.make_automaton()
        self.empty = not places

    def match(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item id, distance, end in the normalised text, budget) of every item that the text contains."""
        if self.empty:
            return []
        line = normal(text)
        windows: dict[int, list[list[int]]] = {}
        whole: dict[int, int] = {}  # short items: the first end of each
        for end, (size, where) in self.automaton.iter(f" {line} "):
            start = end - size  # in the line without its first border
            for k, at, parent in where:
                p = self.items[k][1]
                if at is None:
                    whole.setdefault(k, end - 1)
                    continue
                if parent and not sibling(p, line, start, at, size, parent):
                    continue
                slack = budget(p)
                a, b = max(0, start - at - slack), min(len(line), start - at + len(p) + slack)
                got = windows.get(k)
                if got and got[-1][0] <= a and b <= got[-1][1]:
                    continue
                if not all(myers(p[lo:hi], line[max(0, start - at + lo - most) : start - at + hi + most], most) for lo, hi, most in above(p, at)):
                    continue
                got = windows.setdefault(k, [])
                if got and a <= got[-1][1]:  # hits come from left to right; overlapping windows are one
                    got[-1][1] = max(got[-1][1], b)
                    got[-1][0] = min(got[-1][0], a)
                else:
                    got.append([a, b])
        out = [(self.items[k][0], 0, end, 0) for k, end in whole.items()]
        for k, spans in windows.items():
            i, p = self.items[k]
            best = None
            for a, b in spans:
                if (hit := myers(p, line[a:b], budget(p))) and (best is None or hit[0] < best[0]):
                    best = (hit[0], a + hit[1])
            if best:
                out.append((i, *best, budget(p)))
        return out


def blocks(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of bounded size, read one partition at a time."""
    block, size = [], 0
    rows = benchmark.where(F.col(text_col).isNotNull() & F.col(item_col).isNotNull()).select(item_col, text_col)
    for i, t in rows.toLocalIterator():
        if block and size + len(t) > BLOCK_CHARS:
            yield block
            block, size = [], 0
        block.append((i, t))
        size += len(t)
    if block:
        yield block


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(id, item_id, distance, budget): the items that each document contains."""
    spark = docs.sparkSession
    common.ship(spark)
    item = benchmark.schema[item_col].dataType.simpleString()
    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, `{item_col}` {item}, distance int, budget int"

    def one(block: list[tuple[int, str]]) -> DataFrame:
        sent = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = Matcher(sent.value)
            for batch in batches:
                place, found = [], []
                for k, text in enumerate(batch.column(1).to_pylist()):
                    if text and (got := own.match(text)):
                        found += got
                        place += [k] * len(got)
                if not found:
                    continue
                ids = batch.column(0).take(pa.array(place))
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array([x[0] for x in found]), pa.array(np.array([x[1] for x in found], np.int32)), pa.array(np.array([x[3] for x in found], np.int32))],
                    names=[id_col, item_col, "distance", "budget"],
                )

        return docs.select(id_col, text_col).mapInArrow(run, schema)

    found = [one(b) for b in blocks(benchmark, item_col, item_text_col)]
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], schema)


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, all columns, that contain no item."""
    spark = docs.sparkSession
    common.ship(spark)
    out, at = docs, docs.columns.index(text_col)
    for block in blocks(benchmark, "item_id", "text"):
        sent = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            own = Matcher(sent.value)
            for batch in batches:
                texts = batch.column(at).to_pylist()
                yield batch.filter(pa.array([not (t and own.match(t)) for t in texts], pa.bool_()))

        out = common.map_rows(out, run)
    return out
