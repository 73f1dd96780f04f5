"""Secret scanning with a trigram index.

Each rule's regex is reduced to a Boolean query over the byte trigrams that every match
must contain.  A block of documents is indexed by trigram (postings: trigram to sorted
document numbers, for the trigrams that some query names), the queries intersect and
unite postings, and only the candidates are searched with the regex.  A rule without
mandatory trigrams is searched in every document.  The index answers "may match", so the
spans are the same as those of searching all texts.

Defined results: a null text is empty and has no spans; a text of any length is scanned
whole, in a block of its own; rows are independent, so repeated rows give repeated results;
matches of one kind do not overlap and run from left to right, those of several kinds may;
at equal starts they stand in the order of the rules; positions are code points, the end
exclusive; further columns are ignored, whatever their names; an empty table gives an empty
result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

try:  # the parser's module was renamed
    from re import _parser as sre_parse
except ImportError:  # pragma: no cover
    import sre_parse


@dataclass(frozen=True)
class Rule:
    """A kind of secret: its regex and, where the regex does not say it, the least length of a group."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


def either_case(word: str) -> str:
    """The word as ASCII character classes; IGNORECASE would also take the long s and the Kelvin sign."""
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in word)


_KEYS = "|".join([*map(either_case, ("password", "passwd", "secret", "token")), either_case("api") + "_?" + either_case("key")])

#: The base kinds, in the order in which they are listed at equal starts, then further ones.
BASE = (
    Rule("assign", rf"({_KEYS})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
)
MORE = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[sr]k_(?:live|test)_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
)
RULES = BASE + MORE

#: More exact strings than this are given up for the trigrams found so far.
_MOST_STRINGS = 64

# A query is True (any document), ("tri", code), ("and", queries) or ("or", queries).


def _both(*queries):
    found = {q for q in queries if q is not True}
    return True if not found else next(iter(found)) if len(found) == 1 else ("and", frozenset(found))


def _any(*queries):
    found = set(queries)
    return True if True in found else next(iter(found)) if len(found) == 1 else ("or", frozenset(found))


def _of_string(s: bytes):
    return _both(*(("tri", s[i] << 16 | s[i + 1] << 8 | s[i + 2]) for i in range(len(s) - 2)))


def trigram_query(pattern: str):
    """The Boolean trigram query that every text with a match of the pattern satisfies."""
    strings, query = _analyse(list(sre_parse.parse(pattern)))
    return query if strings is None else _both(query, _any(*map(_of_string, strings)))


def _analyse(items: list) -> tuple[set[bytes] | None, object]:
    """(the exact strings that the items can match, or None; what holds besides)."""
    runs: list[set[bytes] | None] = [{b""}]
    query = True
    for op, arg in items:
        name = str(op)
        strings, more = None, True
        if name == "LITERAL":
            strings = {chr(arg).encode()}
        elif name == "IN":
            strings = _class(arg)
        elif name == "SUBPATTERN":
            strings, more = _analyse(list(arg[-1]))
        elif name == "BRANCH":
            parts = [_analyse(list(x)) for x in arg[1]]
            if all(s is not None for s, _ in parts):
                strings, more = set().union(*(s for s, _ in parts)), _any(*(q for _, q in parts))
            else:
                more = _any(*(_both(q, True if s is None else _any(*map(_of_string, s))) for s, q in parts))
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            low, high, sub = arg
            s, q = _analyse(list(sub))
            if s is not None and (int(low), int(high)) in ((0, 1), (1, 1)):
                strings, more = s | ({b""} if int(low) == 0 else set()), q if int(low) else True
            elif int(low) >= 1:
                more = _both(q, True if s is None else _any(*map(_of_string, s)))
        elif name == "AT":
            strings = {b""}
        if strings is not None and runs[-1] is not None and len(joined := {a + b for a in runs[-1] for b in strings}) <= _MOST_STRINGS:
            runs[-1] = joined
        else:  # close the run; what follows begins another
            query = _both(query, True if runs[-1] is None else _any(*map(_of_string, runs[-1])))
            if strings is not None and runs[-1] is not None:
                # keep the border: the last two bytes go on with the next strings
                tails = {a[-2:] for a in runs[-1]}
                joined = {a + b for a in tails for b in strings}
                runs.append(joined if len(joined) <= 4096 else strings)
            else:
                runs.append(strings)
        query = _both(query, more)
    if len(runs) == 1:
        return runs[0], query
    return None, _both(query, True if runs[-1] is None else _any(*map(_of_string, runs[-1])))


def _class(items: list) -> set[bytes] | None:
    out: set[bytes] = set()
    for op, arg in items:
        if str(op) == "LITERAL":
            out.add(chr(arg).encode())
        elif str(op) == "RANGE" and arg[1] - arg[0] < 8:
            out |= {chr(c).encode() for c in range(arg[0], arg[1] + 1)}
        else:
            return None
    return out if len(out) <= 8 else None


def trigrams_of(query) -> set[int]:
    if query is True:
        return set()
    return {query[1]} if query[0] == "tri" else set().union(*map(trigrams_of, query[1]))


class Index:
    """Postings of a block of texts for the trigrams that queries name."""

    def __init__(self, wanted: list[int]):
        self.wanted = wanted
        self.slot = np.zeros(1 << 24, dtype=np.uint16)
        self.slot[wanted] = np.arange(1, len(wanted) + 1)
        self.first = np.zeros(1 << 16, dtype=bool)
        self.first[[w >> 8 for w in wanted]] = True

    def build(self, texts: list[str]) -> None:
        data = [t.encode("utf-8", "surrogatepass") for t in texts]
        ends = np.cumsum([len(d) for d in data])
        flat = np.frombuffer(b"".join(data), dtype=np.uint8)
        self.size = len(texts)
        self.postings: dict[int, np.ndarray] = {}
        if len(flat) < 3:
            return
        pairs = flat[:-2].astype(np.uint16) << 8 | flat[1:-1]
        at = np.flatnonzero(self.first[pairs])
        slot = self.slot[pairs[at].astype(np.uint32) << 8 | flat[at + 2]]
        at, slot = at[slot > 0], slot[slot > 0]
        doc = np.searchsorted(ends, at, side="right")
        whole = at + 2 < ends[doc]  # not across two documents
        order = np.unique(slot[whole].astype(np.int64) * self.size + doc[whole])
        slots, docs = order // self.size, order % self.size
        cut = np.searchsorted(slots, np.arange(1, len(self.wanted) + 2))
        for k, code in enumerate(self.wanted):
            self.postings[code] = docs[cut[k] : cut[k + 1]]

    def answer(self, query) -> np.ndarray:
        if query is True:
            return np.arange(self.size)
        if query[0] == "tri":
            return self.postings.get(query[1], np.zeros(0, dtype=np.int64))
        parts = sorted((self.answer(q) for q in query[1]), key=len)
        out = parts[0]
        for p in parts[1:]:
            out = np.intersect1d(out, p, assume_unique=True) if query[0] == "and" else np.union1d(out, p)
            if query[0] == "and" and not len(out):
                break
        return out


def _spans(rule: Rule, pattern: re.Pattern, text: str) -> list[tuple[int, int]]:
    return [m.span() for m in pattern.finditer(text) if m.end(rule.group) - m.start(rule.group) >= rule.least]


class Scanner:
    """Finds the spans of all rules in blocks of texts."""

    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        self.patterns = [re.compile(r.pattern) for r in rules]
        # Runs of one class are found as fast by asking for their least length at once.
        self.search = [re.compile(f"{r.pattern[:-1]}{{{r.least},}}") if r.least and not r.group and r.pattern.endswith("+") and r.pattern.startswith("[") else p for r, p in zip(rules, self.patterns, strict=True)]
        self.queries = [trigram_query(r.pattern) for r in rules]
        self.index = Index(sorted(set().union(*map(trigrams_of, self.queries))))

    def scan(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        """For each text the sorted (start, rule number, end)."""
        self.index.build(texts)
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        for k, (rule, pattern, query) in enumerate(zip(self.rules, self.search, self.queries, strict=True)):
            for i in self.index.answer(query).tolist():
                out[i] += [(s, k, e) for s, e in _spans(rule, pattern, texts[i])]
        return [sorted(x) for x in out]


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id and ``found``, an array of (kind, start, end) by start, then rule order."""
    common.ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = common.resident(("secrets", rules), lambda: Scanner(rules))
        for batch in batches:
            kept = batch.schema.field(0).type
            for keys, texts in common.text_blocks(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = [[{"kind": rules[k].kind, "start": s, "stop": e} for s, k, e in x] for x in scanner.scan(texts)]
                yield pa.RecordBatch.from_arrays([pa.array(keys, kept), pa.array(found, pa.list_(span))], names=[id_col, "found"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, found array<struct<kind:string,start:bigint,stop:bigint>>")


def digest(spans: list[tuple[str, int, int]]) -> str:
    """Lowercase hex SHA-256 of the comma-joined kind:start:end (for tests and other callers)."""
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()
