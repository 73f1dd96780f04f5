"""BPE encoding and decoding by speculation and verification.

A word's greedy longest-match split is proposed first.  A sequence of tokens is what
merging gives exactly if each token is what merging gives for its own string and no
merge ever crosses the border of two neighbours.  Both are properties of single tokens
and of adjacent pairs, so all pairs of a block's new words are checked at once in numpy
and only words with a failing pair go through the merge loop.  The proposals of a block
are found together too: all words walk a trie of the vocabulary, a byte a step.

A worker remembers up to CACHE_WORDS words, their ids and decoded strings side by side in
arrays, and forgets the half that was not used of late when it has more.

Defined results: a null text encodes as an empty one (no tokens, empty decoded text);
rows are independent, so repeated rows and ids give repeated results and there are no
ties; a text of any length is encoded whole, a very long word by a heap; further columns
of the input, of any name, are ignored; an empty table gives an empty result.  Special
tokens' strings in a text become their ids, as in the library's default.  Letters that
the newest Unicode versions added are classed as the installed ``regex`` and Python
class them.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from itertools import repeat
from struct import pack

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from . import common

#: Words that a Python worker remembers.
CACHE_WORDS = 250_000
#: Longer words are merged one by one with a heap.
LONG_WORD = 64
#: Unicode White_Space, which is what the vocabulary's normalizer collapses.
_SPACES = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_ASTRAL = re.compile("[\U00010000-\U0010ffff]")
_NEVER = np.int64(1) << 40
_PAIR_SLOTS = 1 << 18


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    moved = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(moved)) for b in range(256)]


class Table:
    """Distinct numbers from 0 on to numbers, asked by whole arrays: open addressing, at most a quarter full."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, (4 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, dtype=np.int64), np.full(1 << bits, -1, dtype=np.int32)
        slot = self._slot(keys)
        while len(keys):
            free = self.keys[slot] < 0
            self.keys[slot[free]] = keys[free]  # of rivals for a slot one stays
            done = self.keys[slot] == keys
            self.values[slot[done]] = values[done]
            keys, values, slot = keys[~done], values[~done], (slot[~done] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The values, -1 for keys that are not there."""
        slot = self._slot(keys)
        there = self.keys[slot]
        out = np.where(there == keys, self.values[slot], -1)
        more = np.flatnonzero((there != keys) & (there >= 0))
        while len(more):
            slot[more] = (slot[more] + 1) & self.mask
            there = self.keys[slot[more]]
            hit = there == keys[more]
            out[more[hit]] = self.values[slot[more[hit]]]
            more = more[~hit & (there >= 0)]
        return out


class Codec:
    """Encoder and decoder of one ``tokenizers`` JSON file with a BPE model and byte-level words."""

    def __init__(self, spec: str):
        d = json.loads(spec)
        model = d["model"]
        vocab: dict[str, int] = model["vocab"]
        end: str = model.get("end_of_word_suffix") or ""
        self.added = {t["content"]: t["id"] for t in d["added_tokens"]}
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        split = next(p for p in d["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        pattern = split["pattern"]["Regex"].replace(r"\s", _SPACES)
        self.any_words = regex.compile(pattern).findall
        # the standard module is twice as fast, but knows the classes of characters only if they are spelled out
        for c in (r"\p{L}", r"\p{N}"):
            pattern = pattern.replace(c, _ranges(c))
        self.words = re.compile(pattern).findall
        self.strings = [b""] * (1 + max([*vocab.values(), *self.added.values()]))
        for t, i in (*vocab.items(), *self.added.items()):
            self.strings[i] = f"{t} ".encode()
        self.widths = np.array([len(t) for t in self.strings])
        value = {c: b for b, c in enumerate(byte_alphabet())}
        spelled = lambda t: bytes(value[c] for c in t)
        final = {spelled(t.removesuffix(end)): i for t, i in vocab.items() if t.endswith(end) and t != end}
        inner = {spelled(t): i for t, i in vocab.items() if not t.endswith(end)} if end else final
        self._trie(inner, final)
        self.byte_inner, self.byte_final = (np.array([side[bytes([b])] for b in range(256)], dtype=np.int64) for side in (inner, final))
        self._merges(vocab, model["merges"])
        self.pair_keys, self.pair_fits = np.full(_PAIR_SLOTS, -1, dtype=np.int64), np.zeros(_PAIR_SLOTS, dtype=bool)
        self.memory = Memory()

    # -- tables -----------------------------------------------------------------

    def _trie(self, inner: dict[bytes, int], final: dict[bytes, int]) -> None:
        """Node 0 is the root; a node has the tokens that its bytes are inside a word and at its end."""
        step: dict[int, int] = {}
        tokens: list[list[int]] = [[-1, -1]]
        for side, known in enumerate((inner, final)):
            for t, i in known.items():
                node = 0
                for b in t:
                    key = node << 8 | b
                    node = step.get(key, 0)
                    if not node:
                        node = step[key] = len(tokens)
                        tokens.append([-1, -1])
                tokens[node][side] = i
        self.inner, self.final = (np.array(x, dtype=np.int32) for x in zip(*tokens, strict=True))
        self.children = Table(np.fromiter(step.keys(), dtype=np.int64, count=len(step)), np.fromiter(step.values(), dtype=np.int64, count=len(step)))

    def _merges(self, vocab: dict[str, int], merges: list) -> None:
        n = max(vocab.values()) + 1
        self.n = n
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        left, right = np.arange(n), np.arange(n)
        made = np.full(n, -1, dtype=np.int64)
        for k, m in enumerate(merges):
            a, b = m if isinstance(m, list) else m.split(" ")
            x, y, z = vocab[a], vocab[b], vocab[a + b]
            self.rank.setdefault((x, y), (k, z))
            if made[z] < 0:
                left[z], right[z], made[z] = x, y, k
        self.made_by_rank = np.zeros(len(merges), dtype=np.int64)
        for k, z in self.rank.values():
            self.made_by_rank[k] = z
        self.ranks = Table(np.array([x * n + y for x, y in self.rank], dtype=np.int64), np.array([r for r, _ in self.rank.values()], dtype=np.int64))
        self.right_edge, self.right_until = self._edges(right, made)
        self.left_edge, self.left_until = self._edges(left, made)
        # A token is its own encoding if its two halves are and meet by no earlier merge.
        sound = np.ones(n, dtype=bool)
        again = np.flatnonzero(made >= 0)
        sound[again] = self._first_crossing(left[again], right[again]) == made[again]
        for z in again[np.argsort(made[again])]:
            sound[z] = sound[z] and sound[left[z]] and sound[right[z]]
        self.sound = sound

    def _edges(self, side: np.ndarray, made: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each token, the pieces that lie at one of its ends while it is merged, and each one's last rank."""
        nodes, until = [np.arange(self.n)], [np.full(self.n, _NEVER)]
        while (made[nodes[-1]] >= 0).any():
            now = nodes[-1]
            ok = made[now] >= 0
            nodes.append(np.where(ok, side[now], -1))
            until.append(np.where(ok, made[now], -1))
            nodes[-1][nodes[-2] < 0] = -1
            if (nodes[-1] < 0).all():
                break
        return np.stack(nodes), np.stack(until)

    def _first_crossing(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Lowest rank of a merge across the border of tokens a and b, ``_NEVER`` if none takes place."""
        best = np.full(len(a), _NEVER)
        for x, xu in zip(self.right_edge, self.right_until, strict=True):
            xa, ua = x[a], xu[a]
            if (xa < 0).all():
                break
            for y, yu in zip(self.left_edge, self.left_until, strict=True):
                yb, ub = y[b], yu[b]
                live = np.flatnonzero((xa >= 0) & (yb >= 0))
                if not len(live):
                    break
                r = self._rank(xa[live], yb[live])
                # Equal ranks go from left to right: a's own merge comes before, b's after.
                r = np.where((r < ua[live]) & (r <= ub[live]), r, _NEVER)
                best[live] = np.minimum(best[live], r)
        return best

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the merge of each pair, ``_NEVER`` if there is none."""
        r = self.ranks.get(a * self.n + b)
        return np.where(r < 0, _NEVER, r)

    # -- words ------------------------------------------------------------------

    def _greedy(self, flat: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(tokens, the number of each one's word, words without a proposal): the longest token at each place, all words together."""
        owners, tokens, failed = [], [], np.zeros(len(start), dtype=bool)
        live, at = np.arange(len(start)), start
        while len(live):
            end = stop[live]
            token, to = np.full(len(live), -1, dtype=np.int64), at.copy()
            walk, node, here = np.arange(len(live)), np.zeros(len(live), dtype=np.int64), at
            while len(walk):
                node = self.children.get(node << 8 | flat[here])
                there = node >= 0
                walk, node, here = walk[there], node[there], here[there] + 1
                last = here == end[walk]
                found = np.where(last, self.final[node], self.inner[node])
                hit = found >= 0
                token[walk[hit]], to[walk[hit]] = found[hit], here[hit]
                walk, node, here = walk[~last], node[~last], here[~last]
            none = token < 0
            failed[live[none]] = True
            owners.append(live[~none])
            tokens.append(token[~none])
            go = ~none & (to < end)
            live, at = live[go], to[go]
        owner = np.concatenate(owners) if owners else np.zeros(0, dtype=np.int64)
        order = np.argsort(owner, kind="stable")
        return (np.concatenate(tokens)[order] if tokens else owner), owner[order], failed

    def _misfits(self, tokens: np.ndarray, owner: np.ndarray, count: int) -> np.ndarray:
        """Which words' proposals are not their exact encodings."""
        bad = np.zeros(count, dtype=bool)
        bad[owner[~self.sound[tokens]]] = True
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        pair = tokens[inner] * self.n + tokens[inner + 1]
        slot = ((pair.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 18)).astype(np.int64)
        known = self.pair_keys[slot] == pair
        fits = self.pair_fits[slot]
        if not known.all():  # new pairs, and those that another has driven out of its slot
            new, back = np.unique(pair[~known], return_inverse=True)
            fresh = self._first_crossing(new // self.n, new % self.n) == _NEVER
            fits[~known] = fresh[back]
            self.pair_keys[slot], self.pair_fits[slot] = pair, fits
            again = self.pair_keys[slot] == pair  # of rivals for a slot the last has both its entries
            self.pair_fits[slot[again]] = fits[again]
        bad[owner[inner[~fits]]] = True
        return bad

    def merged(self, words: list[bytes]) -> list[list[int]]:
        """Exact encodings by merging, in each word, the leftmost pair of the lowest rank, all words a step at a time."""
        out: list[list[int]] = [[]] * len(words)
        short = [i for i, w in enumerate(words) if len(w) <= LONG_WORD]
        for i, w in enumerate(words):
            if len(w) > LONG_WORD:
                out[i] = self._merged_long([*self.byte_inner[list(w[:-1])].tolist(), int(self.byte_final[w[-1]])])
        if not short:
            return out
        size = np.array([len(words[i]) for i in short])
        flat = np.frombuffer(b"".join([words[i] for i in short]), dtype=np.uint8)
        tokens = self.byte_inner[flat]
        tokens[np.cumsum(size) - 1] = self.byte_final[flat[np.cumsum(size) - 1]]
        who = np.array(short)
        owner = np.repeat(np.arange(len(size)), size)
        rank = np.full(len(tokens), _NEVER)
        at = np.flatnonzero(owner[1:] == owner[:-1])
        rank[at] = self._rank(tokens[at], tokens[at + 1])
        while len(size):
            start = np.cumsum(size) - size
            least = np.minimum.reduceat(rank, start)
            if (done := least == _NEVER).any():
                for w in np.flatnonzero(done).tolist():
                    out[who[w]] = tokens[start[w] : start[w] + size[w]].tolist()
                keep = np.repeat(~done, size)
                tokens, rank, size, who, least = tokens[keep], rank[keep], size[~done], who[~done], least[~done]
                if not len(size):
                    break
            owner = np.repeat(np.arange(len(size)), size)
            hits = np.flatnonzero(rank == least[owner])
            hits = hits[np.concatenate(([True], owner[hits[1:]] != owner[hits[:-1]]))]  # one in each word, the leftmost
            tokens[hits] = self.made_by_rank[least]
            keep = np.ones(len(tokens), dtype=bool)
            keep[hits + 1] = False
            at = hits - np.arange(len(hits))  # places after the removal
            tokens, owner = tokens[keep], owner[keep]
            rank[hits] = rank[hits + 1]
            rank = rank[keep]
            size = size - 1
            for x in (at, at - 1):
                x = x[(x >= 0) & (x < len(tokens) - 1)]
                same = owner[x] == owner[x + 1]
                rank[x[~same]] = _NEVER
                x = x[same]
                rank[x] = self._rank(tokens[x], tokens[x + 1])
            if len(at) and at[-1] == len(tokens) - 1:
                rank[-1] = _NEVER
        return out

    def _merged_long(self, part: list[int]) -> list[int]:
        """The same for one very long word, by a heap: n log n."""
        n, rank = len(part), self.rank
        after, before = [*range(1, n), -1], list(range(-1, n - 1))
        heap = [(rank[p][0], i, p) for i, p in enumerate(zip(part, part[1:])) if p in rank]
        heapq.heapify(heap)
        gone = bytearray(n)
        while heap:
            _, i, p = heapq.heappop(heap)
            j = after[i] if not gone[i] else -1
            if j < 0 or (part[i], part[j]) != p:
                continue
            part[i] = rank[p][1]
            gone[j] = 1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (q := (part[i], part[k])) in rank:
                    heapq.heappush(heap, (rank[q][0], i, q))
            if (h := before[i]) >= 0 and (q := (part[h], part[i])) in rank:
                heapq.heappush(heap, (rank[q][0], h, q))
        return [part[i] for i in range(n) if not gone[i]]

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, bytes, np.ndarray]:
        """(ids of all words, how many each has, what they decode to with a space after each token, how long that is)."""
        spelled = [w.encode("utf-8", "surrogatepass") for w in words]
        size = np.fromiter(map(len, spelled), dtype=np.int64, count=len(spelled))
        stop = np.cumsum(size)
        tokens, owner, failed = self._greedy(np.frombuffer(b"".join(spelled), dtype=np.uint8), stop - size, stop)
        failed |= self._misfits(tokens, owner, len(words))
        failed[[i for i, w in enumerate(words) if w in self.added]] = True
        again = np.flatnonzero(failed).tolist()
        known = {i: [self.added[words[i]]] for i in again if words[i] in self.added}
        rest = [i for i in again if i not in known]
        known |= zip(rest, self.merged([spelled[i] for i in rest]), strict=True)
        good = ~failed[owner]
        more = np.array([t for i in again for t in known[i]], dtype=np.int64)
        owner = np.concatenate([owner[good], np.repeat(again, [len(known[i]) for i in again]).astype(np.int64)])
        order = np.argsort(owner, kind="stable")
        tokens, owner = np.concatenate([tokens[good], more])[order], owner[order]
        text = b"".join(map(self.strings.__getitem__, tokens.tolist()))
        long = np.bincount(owner, weights=self.widths[tokens], minlength=len(words)).astype(np.int64)
        return tokens, np.bincount(owner, minlength=len(words)), text, long

    # -- texts ------------------------------------------------------------------

    def _words(self, text: str) -> list[str]:
        """The text's words in order; a special token's string is a word of its own."""
        if not any(s in text for s in self.added):
            return self._plain(text)
        out: list[str] = []
        for k, piece in enumerate(self.special.split(text)):
            out += [piece] if k % 2 else self._plain(piece)
        return out

    def _plain(self, text: str) -> list[str]:
        if text.isascii():
            return self.words(text.lower())
        # characters are lowered one by one: no final sigma
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        return (self.any_words if _ASTRAL.search(text) else self.words)(text)

    def encode_block(self, texts: list[str]) -> Iterator[tuple[bytes, str]]:
        """For each text its ids as little-endian unsigned 32-bit integers and its decoded text."""
        return ((ids, text.decode("utf-8", "surrogatepass")) for ids, text in self.encode_raw(texts))

    def encode_raw(self, texts: list[str]) -> Iterator[tuple[bytes, bytes]]:
        """The same with the decoded text in UTF-8."""
        words: list[str] = []
        counts = np.zeros(len(texts), dtype=np.int64)
        for k, text in enumerate(texts):
            found = self._words(text)
            counts[k] = len(found)
            words += found
        place = self.memory.places(words, self.encode_words)
        ends = np.cumsum(counts)
        ids, id_ends = self.memory.ids.gather(place)
        text, text_ends = self.memory.texts.gather(place)
        packed, decoded = ids.astype("<u4").tobytes(), text.tobytes()
        cut = lambda e: np.concatenate(([0], e))[np.concatenate(([0], ends))].tolist()
        at, to = cut(id_ends), cut(text_ends)
        for k in range(len(texts)):
            yield packed[4 * at[k] : 4 * at[k + 1]], decoded[to[k] : max(to[k], to[k + 1] - 1)]


class Runs:
    """Runs of values, one after the other in an array, by number."""

    def __init__(self, kind: str):
        self.flat, self.at, self.size = np.zeros(1024, dtype=kind), np.zeros(1024, dtype=np.int32), np.zeros(1024, dtype=np.int32)
        self.count = self.used = 0

    def append(self, values: np.ndarray, size: np.ndarray) -> None:
        n, m = self.count + len(size), self.used + len(values)
        if n > len(self.at):
            self.at, self.size = (np.concatenate([x, np.zeros(n, dtype=np.int32)]) for x in (self.at, self.size))
        if m > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(m, dtype=self.flat.dtype)])
        self.size[self.count : n] = size
        self.at[self.count : n] = self.used + np.cumsum(size) - size
        self.flat[self.used : m] = values
        self.count, self.used = n, m

    def gather(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the runs of these numbers in a row, where each ends)."""
        size = self.size[which]
        ends = np.cumsum(size, dtype=np.int64)
        total = int(ends[-1]) if len(ends) else 0
        step = np.repeat(self.at[which] - (ends - size).astype(np.int32), size)
        step += np.arange(total, dtype=np.int32)
        return self.flat[step], ends

    def keep(self, which: np.ndarray) -> None:
        flat, ends = self.gather(which)
        size = self.size[which]
        self.flat, self.size, self.at = flat, size, (ends - size).astype(np.int32)
        self.count, self.used = len(which), len(flat)


class Memory:
    """The words that a worker knows, with their ids and decoded bytes."""

    def __init__(self) -> None:
        self.place: dict[str, int] = {}
        self.ids, self.texts = Runs("int32"), Runs("uint8")
        self.last = np.zeros(0, dtype=np.int64)
        self.block = 0

    def places(self, words: list[str], encode) -> np.ndarray:
        """The words' numbers, after those that are new have been encoded."""
        if len(self.place) > CACHE_WORDS:
            self._forget()
        self.block += 1
        out = np.fromiter(map(self.place.get, words, repeat(-1)), dtype=np.int64, count=len(words))
        if len(at := np.flatnonzero(out < 0)):
            missing = [words[i] for i in at.tolist()]
            new = list(dict.fromkeys(missing))
            first = len(self.place)
            ids, count, text, long = encode(new)
            self.ids.append(ids, count)
            self.texts.append(np.frombuffer(text, dtype=np.uint8), long)
            self.place.update(zip(new, range(first, first + len(new)), strict=True))
            self.last = np.concatenate([self.last, np.zeros(len(new), dtype=np.int64)])
            out[at] = list(map(self.place.__getitem__, missing))
        self.last[out] = self.block
        return out

    def _forget(self) -> None:
        kept = np.flatnonzero(self.last > np.median(self.last))  # half of them at most
        words = list(self.place)
        self.place = {words[i]: k for k, i in enumerate(kept.tolist())}
        self.ids.keep(kept)
        self.texts.keep(kept)
        self.last = self.last[kept]


def _ranges(category: str) -> str:
    """The characters of a Unicode category below U+10000 as ranges of a class."""
    out: list[list[int]] = []
    for c in regex.findall(category, "".join(chr(c) for c in range(1 << 16) if not 0xD800 <= c < 0xE000)):
        if out and out[-1][1] == ord(c) - 1:
            out[-1][1] += 1
        else:
            out.append([ord(c), ord(c)])
    return "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in out)


def codec(spec: str) -> Codec:
    """The worker's codec of this specification, with what it has cached so far."""
    return common.resident(("bpe", hashlib.sha256(spec.encode()).digest()), lambda: Codec(spec))


def encode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False, keep_decoded: bool = False) -> DataFrame:
    """One row per document: id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, the ids and decoded text."""
    spark = docs.sparkSession
    common.ship(spark)
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids + ", decoded string" * keep_decoded

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(spec.value)
        for batch in batches:
            kept = batch.schema.field(0).type
            for keys, texts in common.text_blocks(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = list(own.encode_raw(texts))
                columns = [
                    pa.array(keys, kept),
                    pa.array([len(b) // 4 for b, _ in rows], pa.int64()),
                    pa.array([hashlib.sha256(b).hexdigest() for b, _ in rows]),
                    pa.array([hashlib.sha256(t).hexdigest() for _, t in rows]),
                ]
                names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
                if keep_ids:
                    columns.append(pa.array([np.frombuffer(b, dtype="<i4") for b, _ in rows], pa.list_(pa.int32())))
                    names.append("ids")
                if keep_decoded:
                    columns.append(pa.array([t.decode("utf-8", "replace") for _, t in rows], pa.string()))
                    names.append("decoded")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select(id_col, text_col).mapInArrow(run, schema)
