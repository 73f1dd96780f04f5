"""Each operator against a brute-force version, and on nulls, empty, very long, repeated and clashing input."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from agentlake.llm import bpe, decontam, langid, license_scan, line_dedup, quality, secret_scan, simhash, toxicity, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, fp string, n_words string, found int, __x string"
WORDS = "the of and to in is that for it was with as be on at this from or an are by".split()
TERMS = "der die und nicht mit auch von ist ein das".split()


def prose(rng, n, words=WORDS):
    return " ".join("".join(rng.choice(words) for _ in range(rng.randint(1, 3))) for _ in range(n))


def edge_rows():
    rng = random.Random(5)
    long = prose(rng, 30_000)
    same = prose(rng, 40)
    rows = [(0, None), (1, ""), (2, " \t\n\x0b"), (3, long), (4, same), (4, same), (5, same), (None, same), (6, "é 日本 \U0001f600 ñ"), (7, None), (8, "123 456 !?"), (None, None)]
    rows += [(k, prose(rng, 60, WORDS if k % 2 else TERMS)) for k in range(20, 60)]
    return [(i, t, None if k % 7 == 3 else ("en" if k % 2 else "de"), None if k % 9 == 4 else f"s{k % 3}", None, 0.5, "f", "n", 1, "x") for k, (i, t) in enumerate(rows)]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(edge_rows(), DOCS)


@pytest.fixture(scope="module")
def empty(edge):
    return edge.where("false")


# -- BPE


def tokenizer():
    P = pytest.importorskip("public_tokenizers")
    return P.path("word_bpe_49k.json")


def test_bpe_equals_library(edge, empty):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(tokenizer())
    got = sorted(map(tuple, bpe.encode(edge, tokenizer(), keep_decoded=True).collect()), key=repr)
    want = []
    for i, t, *_ in edge_rows():
        ids = lib.encode(t or "", add_special_tokens=False).ids
        text = lib.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest(), text))
    assert got == sorted(want, key=repr)
    assert bpe.encode(empty, tokenizer()).count() == 0


def test_bpe_speculation_is_exact_on_odd_words():
    from tokenizers import Tokenizer

    lib, own = Tokenizer.from_file(tokenizer()), bpe.Codec(open(tokenizer()).read())
    rng = random.Random(1)
    texts = ["<|endoftext|>a<|startoftext|> B", "ΣΑΣ", "don't we'LL", "a" * 3000, "\x1c \x85 a", "x́y"]
    texts += ["".join(rng.choice("abcdefgt'  .,!019éßÑ中\n") for _ in range(rng.randint(1, 120))) for _ in range(600)]
    for t, (b, decoded), e in zip(texts, own.encode_block(texts), lib.encode_batch(texts, add_special_tokens=False)):
        assert np.frombuffer(b, "<u4").tolist() == e.ids and decoded == lib.decode(e.ids, skip_special_tokens=False), t


# -- secrets


def test_secret_spans_equal_full_scan():
    rng = random.Random(2)
    parts = ["password", "PassWd", "sEcret", "TOKEN", "api_key", "apikey", " ", "=", ":", "'", '"', "abc", "123456", "AKIA", "ABCDEFGH1234567890", "deadbeef", "0123456789abcdef", "ſecret", "é", "\n", "ghp_" + "a" * 36, "token=", "-----BEGIN RSA PRIVATE KEY-----"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(1500)]
    for t, got in zip(texts, secret_scan.Scanner().scan(texts)):
        want = sorted((m.start(), k, m.end()) for k, r in enumerate(secret_scan.RULES) for m in re.finditer(r.pattern, t) if m.end(r.group) - m.start(r.group) >= r.least)
        assert got == want


def test_secret_queries_name_trigrams():
    q = {r.kind: secret_scan.trigram_query(r.pattern) for r in secret_scan.RULES}
    assert q["hex"] is True and len(secret_scan.trigrams_of(q["access"])) == 2
    assert all(secret_scan.trigrams_of(q[r.kind]) for r in secret_scan.RULES if r.kind != "hex")


def test_secret_edges(edge, empty):
    assert secret_scan.scan(edge).count() == len(edge_rows()) and secret_scan.scan(empty).count() == 0
    assert all(r["found"] == [] for r in secret_scan.scan(edge.where("text is null")).collect())


# -- quality


def brute_quality(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {i + k for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered), n < 10 or 100 * len(covered) > 20 * n


def test_quality_equals_brute_force(spark, edge, empty):
    rng = random.Random(3)
    rows = [(k, "\n".join(rng.choice(["a b c d e f", "a b c", "", " ", "x# y* |", prose(rng, 8)]) for _ in range(rng.randint(1, 12))), f"h{k % 4}") for k in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in quality.judge(docs).collect()}
    for i, t, _ in rows:
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == brute_quality(t)
        assert r["kept"] == (not r["base_failed"] and not r["host_rejected"])
    assert quality.judge(edge).count() == len(edge_rows()) and quality.judge(empty).count() == 0
    assert all(r["base_failed"] for r in quality.judge(edge.where("text is null")).collect())


def test_quality_rejects_bad_hosts(spark):
    good = prose(random.Random(1), 50)
    rows = [(k, good if h != "bad" or k % 9 == 0 else "x", h) for k, h in enumerate(["bad", "a", "b", "c"] * 40)]
    out = quality.judge(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert {r[0] for r in out.where("host_rejected").join(spark.createDataFrame([(k, h) for k, _, h in rows], "doc_id long, h string"), "doc_id").select("h").distinct().collect()} == {"bad"}


# -- line dedup


def brute_lines(rows, ratio, least):
    total, pages = Counter(), Counter()
    key = lambda x: x.strip(" \t\n\x0b\x0c\r")
    for _, t, h in rows:
        total[h] += 1
        for x in {key(x) for x in (t or "").split("\n") if key(x)}:
            pages[h, x] += 1
    bad = {(h, x) for (h, x), n in pages.items() if n >= least and n > ratio * total[h]}
    out = []
    for i, t, h in rows:
        if t is None:
            out.append((i, None, 0, 0))
            continue
        lines = t.split("\n")
        kept = [x for x in lines if not (key(x) and (h, key(x)) in bad)]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("limit", [50_000, 0])
def test_line_dedup_equals_brute_force(spark, edge, empty, limit):
    rng = random.Random(4)
    pool = ["menu", " menu ", "all rights", "", "  ", *(prose(rng, 5) for _ in range(40))]
    rows = [(k, None if k % 31 == 0 else "\n".join(rng.choice(pool) for _ in range(rng.randint(1, 9))), None if k % 13 == 0 else f"s{k % 3}") for k in range(150)]
    rows += [(500 + k, "menu", "s1") for k in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = line_dedup.dedup(docs, ratio=0.2, min_pages=3, broadcast_lines=limit)
    assert sorted(((r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in got.collect()), key=repr) == brute_lines(rows, 0.2, 3)
    out = line_dedup.dedup(edge, broadcast_lines=limit)
    assert out.count() == len(edge_rows()) and out.columns[: len(edge.columns)] == edge.columns and line_dedup.dedup(empty).count() == 0


# -- SimHash


def brute_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def partition(nodes, links):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[root(a)] = root(b)
    out = {}
    for n in nodes:
        out.setdefault(root(n), set()).add(n)
    return sorted(map(sorted, out.values()))


def clustered(n_centres=30, n=40):
    rng = np.random.default_rng(0)
    one = np.uint64(1)
    centres = rng.integers(0, 1 << 64, n_centres, dtype=np.uint64)
    flips = lambda: one << rng.integers(0, 64, n_centres).astype(np.uint64)
    return np.unique(np.concatenate([centres, *((centres ^ flips()) ^ flips() for _ in range(n))]))


def brute_links(f):
    near = np.bitwise_count(f[:, None] ^ f[None, :]) <= 3
    s = f.view(np.int64).tolist()
    return [(s[i], s[j]) for i, j in zip(*np.nonzero(np.triu(near, 1)))]


@pytest.mark.parametrize("chunk", [4096, 7])
def test_simhash_components_equal_all_pairs(spark, monkeypatch, chunk):
    monkeypatch.setattr(simhash, "CHUNK", chunk)  # small chunks: every large bucket is dealt out in pairs
    f = clustered()
    nodes = f.view(np.int64).tolist()
    edges = simhash.edges(spark.createDataFrame([(x,) for x in nodes], "fp long"))
    found = [tuple(r) for r in simhash.components(edges).collect()]
    assert partition(nodes, found) == partition(nodes, brute_links(f))


def test_simhash_classes_and_survivors(edge, empty):
    rows = edge_rows()
    got = simhash.classes(edge).collect()
    assert sorted((r["doc_id"], r["fp"] % 2**64) for r in got if r["doc_id"] is not None) == sorted((i, brute_fingerprint(t)) for i, t, *_ in rows if i is not None)
    by_fp = {}
    for i, t, *_ in rows:
        by_fp.setdefault(brute_fingerprint(t), []).append(i)
    f = np.array(sorted(by_fp), dtype=np.uint64)
    groups = partition(f.view(np.int64).tolist(), brute_links(f))
    least = {fp: min((i for g in group for i in by_fp[g % 2**64] if i is not None), default=None) for group in groups for fp in group}
    assert all(r["component_id"] == least[r["fp"]] for r in got)
    kept = simhash.survivors(edge)
    assert kept.columns == edge.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(least.values()))
    assert simhash.classes(empty).count() == 0 and simhash.survivors(empty).count() == 0


# -- decontamination


def brute_distance(p, t):
    row = [0] * (len(t) + 1)
    for i, c in enumerate(p, 1):
        new = [i]
        for j, d in enumerate(t, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def test_myers_equals_dynamic_programme():
    rng = random.Random(3)
    for _ in range(300):
        p = "".join(rng.choice("abc ") for _ in range(rng.randint(1, 20)))
        t = "".join(rng.choice("abc ") for _ in range(rng.randint(1, 60)))
        assert decontam.myers(p, t, 10**9)[0] == brute_distance(p, t)


def test_decontamination_equals_brute_force(spark, edge, empty):
    rng = random.Random(6)
    items = [(k, prose(rng, 20)) for k in range(6)] + [(90, "short"), (91, None)]
    rows = []
    for k in range(40):
        text = prose(rng, 30)
        if k % 2:
            passage = list(rng.choice(items[:6])[1])
            for _ in range(rng.randint(0, 14)):
                at = rng.randrange(len(passage))
                passage[at] = rng.choice(["", "q", passage[at] + "z"])
            text += " " + "".join(passage).upper() + ". " + prose(rng, 10)
        rows.append((k, text))
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["distance"] for r in decontam.matches(docs, bench).collect()}
    want = {}
    for i, t in rows:
        for k, b in items[:6]:
            p = decontam.normal(b)
            if (d := brute_distance(p, decontam.normal(t))) <= decontam.budget(p):
                want[i, k] = d
    assert got == want and len({d for d in want.values()}) > 2
    assert {r["doc_id"] for r in decontam.clean(docs, bench).collect()} == {i for i, _ in rows} - {i for i, _ in want}
    assert decontam.clean(edge, bench).count() == len(edge_rows()) and decontam.matches(empty, bench).count() == 0
    assert decontam.matches(docs, bench.where("false")).count() == 0


def test_decontamination_finds_the_declared_tenth():
    rng = random.Random(11)
    for size in (40, 60, 80, 83, 120, 240):
        item = prose(rng, 120)[:size].strip() + "q" * 3
        p = decontam.normal(item)
        own = decontam.Matcher([(7, item)])
        for edits in (0, len(p) // 10 - 1, len(p) // 10, len(p) // 10 + 1, len(p) // 10 + 3):
            for spread in (True, False):  # edits evenly over the item, so that few pieces stay whole, or at random places
                passage = list(p)
                for e in range(edits):
                    at = len(p) * e // edits if spread else rng.randrange(len(p))
                    passage[at] = rng.choice(["", "x", passage[at] + "z"])
                line = decontam.normal(prose(rng, 12) + " " + "".join(passage) + " " + prose(rng, 12))
                d = brute_distance(p, line)
                assert [(i, n) for i, n, *_ in own.match(line)] == ([(7, d)] if d <= len(p) // 10 else []), (size, edits, d)


def test_decontamination_finds_short_items_word_for_word(spark):
    items = [(1, "What is the capital of France?"), (2, "Paris"), (3, "x" * 39), (4, "?!"), (5, "Forty-two"), (6, ""), (7, "paris")]
    rows = [(1, "So: what is the CAPITAL of France"), (2, "Comparison, parishes"), (3, "paris - forty  two; PARIS"), (4, "x" * 39), (5, "x" * 40), (6, "forty two."), (7, "What is a capital of France?"), (8, "? !")]
    want = {(1, 1), (3, 2), (3, 5), (3, 7), (4, 3), (6, 5)}
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = decontam.matches(docs, bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want and len(got) == len(want) and all(r["distance"] == r["budget"] == 0 for r in got)
    assert {r["doc_id"] for r in decontam.clean(docs, bench).collect()} == {2, 5, 7, 8}
    rng = random.Random(12)
    texts, short = [prose(rng, 40) for _ in range(60)], [(k, prose(rng, rng.randint(1, 3))[:39].strip()) for k in range(80)]
    own, found = decontam.Matcher(short), 0
    for t in texts:
        t += " " + rng.choice(short)[1]
        got = {i: end for i, _, end, _ in own.match(t)}
        assert got == {k: re.search(rf"\b{p}\b", t).end() for k, p in short if re.search(rf"\b{p}\b", t)}
        found += len(got)
    assert found >= len(texts)


def test_decontamination_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontam, "BLOCK_CHARS", 100)
    rng = random.Random(8)
    items = [(k, prose(rng, 20)) for k in range(3)]
    docs = spark.createDataFrame([(k, "x " + t) for k, t in items], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert sorted((r[0], r[1]) for r in decontam.matches(docs, bench).collect()) == [(k, k) for k in range(3)]
    assert decontam.clean(docs, bench).count() == 0


# -- licenses


def test_license_windows_equal_brute_force(spark, edge, empty):
    rng = random.Random(9)
    notices = [(n, t) for n, ts in license_scan.TEMPLATES.items() for t in ts]
    rows, want = [], set()
    for k in range(40):
        text = prose(rng, rng.randint(0, 80))
        if k % 2:
            name, notice = notices[k % len(notices)]
            text += "\n" + notice.upper() + "\n" + prose(rng, 30)
            want.add((k, name))
        rows.append((k, text))
    out = license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert want <= {(r["doc_id"], r["license"]) for r in out}
    toks = lambda t: [w for w in re.split("[^a-z0-9]+", t.lower()) if w]
    grams = lambda t: {tuple(t[i : i + 3]) for i in range(len(t) - 2)}
    for r in out:  # nothing is found that the text does not contain
        mine = grams(toks(rows[r["doc_id"]][1]))
        assert max(len(g & mine) / len(g) for n, t in notices if n == r["license"] for g in [grams(toks(t))]) >= license_scan.CONTAINED
    assert all(license_scan.collision(n, 2 * license_scan.size_class(n)) > 0.9999 for n in range(2, 2000))
    assert license_scan.scan(empty).count() == 0 and license_scan.scan(edge).count() == 0


# -- WARC


def test_warc_records_are_linked_and_whole(spark):
    pages = spark.createDataFrame([(1, "http://a/é", "<title>T</title><script>var t='</p>';</script><p>a &amp; b<br>c <b>d</b><!-- x --> 1 < 2</p>"), (2, None, None), (3, "http://b", ""), (3, "http://b", "")], "page_id long, url string, html string")
    made = warc.derivatives(warc.responses(pages)).collect()
    assert len(made) == 8
    for source in warc.responses(pages).collect():
        headers, block = warc.parse(bytes(source["record"]))
        two = [m for m in made if m["refers_to"] == headers["WARC-Record-ID"]]
        assert {m["warc_type"] for m in two} == {"metadata", "conversion"} and headers["WARC-Block-Digest"] == warc.digest(block)
        for m in two:
            h, b = warc.parse(bytes(m["record"]))
            assert h["WARC-Refers-To"] == headers["WARC-Record-ID"] and h["WARC-Block-Digest"] == warc.digest(b) == m["block_digest"] and h.get("WARC-Target-URI") == headers.get("WARC-Target-URI")
            assert h["Source-Payload-Digest"] == headers["WARC-Payload-Digest"] and int(h["Content-Length"]) == len(b) == m["content_length"]
        meta = next(m for m in two if m["warc_type"] == "metadata")["block"]
        assert f"source-warc-payload-digest: {headers['WARC-Payload-Digest']}" in meta and "http-content-type: text/html" in meta
    assert next(m["block"] for m in made if m["page_id"] == 1 and m["warc_type"] == "conversion") == "T\na & b\nc d 1 < 2"
    bad = spark.createDataFrame([(1, b"junk"), (2, None)], "page_id long, record binary")
    assert [m["warc_type"] for m in warc.derivatives(bad).collect()] == ["metadata"] * 2
    assert warc.derivatives(bad.where("false")).count() == 0


# -- learned operators


def test_toxicity_learns_outside_the_held_out_rows(spark, edge, empty):
    rng = random.Random(10)
    rows = [(k, prose(rng, 30) + (" scumword " + prose(rng, 5) if k % 3 == 0 else "")) for k in range(900)]
    docs = spark.createDataFrame([*rows, (9000, None), (9001, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k, _ in rows], "doc_id long, toxic int")
    out = {r["doc_id"]: r for r in toxicity.toxicity(docs, labels).collect()}
    assert len(out) == 902 and out[9000]["score"] == out[9001]["score"]
    held = [k for k, _ in rows if zlib.crc32(str(k).encode()) % 3 == 1]
    assert all(out[k]["held_out"] for k in held)
    assert np.mean([out[k]["predicted"] == (k % 3 == 0) for k in held]) > 0.97
    used = toxicity.sample(docs, labels, "doc_id", "text", "toxic")
    assert not {t for t, _ in used} & {rows[k][1] for k in held}
    assert toxicity.toxicity(edge, labels.where("false")).select("score").distinct().collect()[0][0] == 0.5
    assert toxicity.toxicity(empty, labels).count() == 0


def test_language_id_on_held_out_rows(edge, empty):
    rows = edge_rows()
    langs, net = langid.fit(edge)
    out = langid.predict(edge, langs, net).collect()
    assert len(out) == len(rows) and langs == ["de", "en"]
    for (_, t, *_), r in zip(sorted(rows, key=repr), sorted(out, key=repr)):
        assert 0 <= r["score"] <= 1
    und = [r for r in langid.predict(edge.where("text is null or doc_id in (1, 2, 8)"), langs, net).collect()]
    assert all(r["lang_pred"] == "und" and r["score"] == 0 for r in und)
    assert langid.predict(empty, langs, net).count() == 0
    assert langid.fit(empty)[0] == [] and langid.accept(edge, [], net).count() == len(rows)


def test_language_network_gradients_by_differences():
    net = langid.Network.fresh(3, hidden=4)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, size = langid.pack(["abé".encode(), b"de"])
    label = np.array([0, 2])

    def loss():
        y = net.positions(x, size)
        live = np.arange(x.shape[1])[:, None] < size
        return -(np.log(y[:, np.arange(2), label]) * live).sum() / size.sum()

    grads = net.gradients(x, size, label)
    for name in net.p:
        flat = net.p[name].reshape(-1)
        for k in [int(np.abs(grads[name]).reshape(-1).argmax()), 0]:
            old, e = flat[k], 1e-3
            flat[k] = old + e
            up = loss()
            flat[k] = old - e
            down = loss()
            flat[k] = old
            assert abs((up - down) / (2 * e) - grads[name].reshape(-1)[k]) < 2e-3


# -- pipeline


def test_pipeline_drops_boilerplate_of_small_hosts(spark):
    import corpus_pipeline

    own = lambda k: f"line of page {k} alone"
    rows = [(k, own(k) + ("\nfooter" if k < 9 else "") + ("\ntwice" if k > 12 else ""), "fifteen") for k in range(15)]
    rows += [(100 + k, f"menu\n{own(100 + k)}", "three") for k in range(3)]
    rows += [(200 + k, f"menu\n{own(200 + k)}", "two") for k in range(2)]
    rows += [(300 + k, own(300 + k) + ("\nthree" if k < 3 else "") + ("\nfour" if k < 4 else ""), "sixty") for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.lines(spark, docs, "").collect()}
    assert got == {i: own(i) + ("\ntwice" if i in (13, 14) else "\nthree" if i in (300, 301, 302) else "") if h != "two" else t for i, t, h in rows}


def test_pipeline_on_the_smallest_tables(spark):
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    out = corpus_pipeline.run(spark, d).collect()
    ids = [r["doc_id"] for r in out]
    assert len(ids) == len(set(ids)) and 0 < len(ids) < docs.count()
    bench = spark.read.parquet(f"{d}/benchmark.parquet")
    leaked = {r[0] for r in decontam.matches(docs, bench).select("doc_id").collect()}
    assert not leaked & set(ids)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), d).columns == docs.columns, name
