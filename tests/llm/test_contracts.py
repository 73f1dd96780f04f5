"""The registered queries on the smallest tables against independent versions and their SQL, and the pipeline on odd input."""

import hashlib
import html
import re
import zlib
from html.parser import HTMLParser

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from agentlake.llm import langid, line_dedup, queries, toxicity, warc

from .test_operators import brute_fingerprint, brute_links, brute_quality, edge_rows, partition, tokenizer

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs():
    return duckdb.sql(f"SELECT doc_id, text, lang, source FROM '{D}/documents.parquet'").fetchall()


def run(spark, name):
    return [r.asDict() for r in queries.queries()[name](spark, D).collect()]


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "pages", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    want = con.sql(queries.oracle_sql()[name])
    columns = sorted(want.columns)
    plain = lambda v: round(v, 9) if isinstance(v, float) else v
    left = sorted(repr([plain(r[c]) for c in columns]) for r in run(spark, name))
    at = [want.columns.index(c) for c in columns]
    assert left == sorted(repr([plain(r[k]) for k in at]) for r in want.fetchall()) and left


def test_secrets_as_the_contract_spells_them(spark):
    wide = "/root/testdata/sf0.01"  # the smallest tables have none
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{wide}/documents.parquet'").fetchall()
    base = {
        "assign": (re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A), 2, 6),
        "access": (re.compile("AKIA[A-Z0-9]+"), 0, 20),
        "hex": (re.compile("[0-9a-f]+"), 0, 24),
    }
    got = {r["doc_id"]: r for r in queries.op4_secret_scan(spark, wide).collect()}
    assert len(got) == len(docs)
    found = 0
    for i, text, *_ in docs:
        spans = [(m.start(), k, kind, m.end()) for k, (kind, (p, g, least)) in enumerate(base.items()) for m in p.finditer(text or "") if len(m[g]) >= least]
        line = ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in sorted(spans))
        r = got[i]
        assert [r[f"n_{k}"] for k in base] == [sum(s[2] == k for s in spans) for k in base]
        assert r["base_sha256"] == hashlib.sha256(line.encode()).hexdigest() and set(line.split(",")) <= {*r["spans"].split(","), ""}
        found += len(spans)
    assert found


def test_codec_query_equals_library(spark, docs):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(tokenizer())
    got = {r["doc_id"]: r for r in run(spark, "op7_bpe_codec")}
    for i, text, *_ in docs:
        ids = lib.encode(text or "", add_special_tokens=False).ids
        want = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest())
        assert (got[i]["n_tokens"], got[i]["ids_sha256"], got[i]["decoded_sha256"]) == want


def test_simhash_query_equals_all_pairs(spark, docs):
    got = {r["doc_id"]: r for r in run(spark, "op8_simhash")}
    by = {}
    for i, text, *_ in docs:
        by.setdefault(brute_fingerprint(text), []).append(i)
        assert got[i]["fingerprint"] == f"{brute_fingerprint(text):016x}"
    f = np.array(sorted(by), dtype=np.uint64)
    for group in partition(f.view(np.int64).tolist(), brute_links(f)):
        members = [i for fp in group for i in by[fp % 2**64]]
        assert {got[i]["component_id"] for i in members} == {min(members)}


def test_quality_query_equals_brute_force(spark, docs):
    got = {r["doc_id"]: r for r in run(spark, "op10_quality_rules")}
    for i, text, *_ in docs:
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == brute_quality(text)
        assert not (r["base_failed"] and r["kept"])


def test_toxicity_never_reads_held_out_labels(spark, docs):
    table = spark.read.parquet(f"{D}/documents.parquet")
    labels = spark.read.parquet(f"{D}/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    flipped = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    scores = lambda y: sorted((r["doc_id"], r["score"], r["predicted"]) for r in toxicity.toxicity(table, y).collect())
    got = scores(labels)
    assert got == scores(flipped) == sorted((r["doc_id"], r["score"], r["predicted"]) for r in run(spark, "op1_toxicity"))
    assert all(p == (s >= 0.7) for _, s, p in got)


def test_toxicity_score_is_the_sum_of_its_weights(spark):
    rows = [(k, "plain words here " + ("vile " * 3 if k % 4 == 0 else "") + f"w{k}") for k in range(400)]
    model = toxicity.train([(t, int("vile" in t)) for _, t in rows])
    frame = spark.createDataFrame([*rows, (1000, "vile words"), (1001, None)], "doc_id long, text string")
    for r in toxicity.score(frame, model).join(frame, "doc_id").collect():
        weights = dict(zip(model.index.tolist(), model.weight.tolist()))
        total = model.bias + sum(weights.get(f, 0.0) for f in set(toxicity.features(r["text"] or "").tolist()))
        assert r["score"] == pytest.approx(1 / (1 + np.exp(-total))) == toxicity.probability(model, np.unique(toxicity.features(r["text"] or "")))
    assert 0 < len(model.index) < 100


def test_language_query_is_right_on_held_out_rows(spark, docs):
    got = {r["doc_id"]: r for r in run(spark, "op6_language_id")}
    held = [(i, lang) for i, t, lang, _ in docs if zlib.crc32(str(i).encode()) % 3 == 1 and lang and re.search(r"[^\W\d_]", t or "")]
    assert all(got[i]["held_out"] for i, _ in held)
    assert np.mean([got[i]["lang_pred"] == lang for i, lang in held]) > 0.95
    for i, t, *_ in docs:
        assert (got[i]["lang_pred"] == "und") == (not re.search(r"[^\W\d_]", t or "")) and 0 <= got[i]["score"] <= 1


def plain_forward(net, data):
    """Every position's distribution, one byte after the other, in plain loops."""
    sig = lambda x: 1 / (1 + np.exp(-x))
    n = net.p["hf"].shape[0]
    states = {}
    for d in "fb":
        h, out = np.zeros(n), []
        for b in data if d == "f" else data[::-1]:
            a, c = net.p[f"x{d}"][b].astype(float), h @ net.p[f"h{d}"].astype(float)
            z, r = sig(a[:n] + c[:n]), sig(a[n : 2 * n] + c[n : 2 * n])
            h = h + z * (np.tanh(a[2 * n :] + r * c[2 * n :]) - h)
            out.append(h)
        states[d] = out if d == "f" else out[::-1]
    y = np.concatenate([states["f"], states["b"]], axis=1) @ net.p["o"] + net.p["c"]
    y = np.exp(y - y.max(axis=1, keepdims=True))
    return y / y.sum(axis=1, keepdims=True)


def test_language_reader_equals_plain_forward_pass(monkeypatch):
    monkeypatch.setattr(langid, "WINDOW", 40)
    monkeypatch.setattr(langid, "CONTEXT", 8)
    monkeypatch.setattr(langid, "ROWS", 3)
    net = langid.Network.fresh(3)
    texts = ["a", "kurz", "Éà ça, 12 mots!", "x" * 40, "y" * 41, "lorem ipsum 3.14 dolor ß " * 9]
    got = langid.Reader(["a", "b", "c"], net.p).pooled([langid.spelled(t) for t in texts])
    for t, p in zip(texts, got):
        data = langid.spelled(t)
        total = np.zeros(3)
        for a in range(0, len(data), 40):  # each position is labelled once, with the window's context
            lo, hi = max(0, a - 8), min(len(data), a + 48)
            total += plain_forward(net, data[lo:hi])[a - lo : min(a + 40, len(data)) - lo].sum(axis=0)
        assert np.allclose(p, total / len(data), atol=1e-5)
    labels = langid.Reader(["a", "b", "c"], net.p).label([*texts, "", "12 !"])
    assert [x for x, _ in labels[:-2]] == ["abc"[k] for k in got.argmax(axis=1)] and labels[-2:] == [("und", 0.0)] * 2


class Words(HTMLParser):
    """Text with a break at every tag that is not inline, by the standard library's parser."""

    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.out, self.skip = [], 0

    def _break(self, tag):
        self.out += ["\n"] * (tag not in warc._INLINE)

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("script", "style", "noscript", "template")
        self._break(tag)

    def handle_endtag(self, tag):
        if tag in ("script", "style", "noscript", "template"):
            self.skip = max(0, self.skip - 1)
        self._break(tag)

    def handle_data(self, data):
        self.out += [data] * (not self.skip)

    def handle_entityref(self, name):
        self.handle_data(f"&{name};")

    def handle_charref(self, name):
        self.handle_data(f"&#{name};")


def test_conversion_records_equal_another_extractor(spark):
    pages = duckdb.sql(f"SELECT page_id, html FROM '{D}/pages.parquet'").fetchall()
    got = {r["page_id"]: r["block"] for r in run(spark, "op5_warc_derivatives") if r["warc_type"] == "conversion"}
    for i, page in pages:
        words = Words()
        words.feed(page or "")
        words.close()
        lines = (" ".join(x.split()) for x in html.unescape("".join(words.out)).split("\n"))
        assert got[i] == "\n".join(x for x in lines if x), i


def test_warc_names_in_any_case_and_repeated_headers(spark):
    block = b"HTTP/1.1 200 OK\r\ncontent-TYPE: text/html; CHARSET=latin-1\r\nSet-Cookie: a=1\r\nSet-Cookie: b=2\r\n\r\n<p>\xe9"
    record = b"WARC/1.0\r\nwarc-type: response\r\nwarc-record-id: <urn:x>\r\nWARC-Protocol: h2\r\nWARC-Protocol: tls/1.3\r\nWARC-Target-URI: http://a/\r\n b\r\ncontent-length: %d\r\n\r\n" % len(block) + block
    meta, text = warc.derive(record)
    assert text["block"] == "é" and text["refers_to"] == meta["refers_to"] == "<urn:x>" and text["target_uri"] == "http://a/ b"
    for line in ("source-warc-protocol: h2", "source-warc-protocol: tls/1.3", "http-set-cookie: a=1", "http-set-cookie: b=2"):
        assert line in meta["block"].split("\r\n")
    long = "<p>" + "word " * 400_000
    pages = spark.createDataFrame([(1, "u", long, "x", b"y"), (1, "u", "<p>other", "x", b"y")], "page_id long, url string, html string, block string, record binary")
    made = warc.derivatives(warc.responses(pages)).collect()
    assert max(len(m["block"]) for m in made) == 400_000 * 5 - 1 and len({m["record_id"] for m in made}) == 4


def test_line_dedup_keeps_columns_of_its_own_names(spark):
    rows = [(k, f"menu\nline {k}", "h", 7, "mine") for k in range(50)] + [(99, "menu", "h", 7, "mine")]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string, n_lines int, N_Dropped string")
    out = line_dedup.dedup(table)
    assert out.columns == [*table.columns, "n_lines_", "n_dropped_"]
    got = {r["doc_id"]: r for r in out.collect()}
    assert got[3]["text"] == "line 3" and got[3]["n_lines"] == 7 and got[3]["N_Dropped"] == "mine" and (got[3]["n_lines_"], got[3]["n_dropped_"]) == (2, 1)
    assert got[99]["text"] == "" and got[99]["n_dropped_"] == 1
    assert {r["doc_id"]: r["text"] for r in line_dedup.dedup(table, keep_whole=True).collect()}[99] == "menu"


def test_pipeline_stages_on_odd_rows(spark):
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, fp string, n_words string, n_lines int, `a.b` string"
    docs = spark.createDataFrame([(*r[:4], r[4], r[5], r[6], r[7], 1, "z") for r in edge_rows()], schema)
    benchmark = spark.createDataFrame([(1, "nothing that any of the texts contains at all, not even nearly so")], "item_id long, text string")
    folder = f"{spark.conf.get('spark.checkpoint.dir')}/odd"
    benchmark.write.mode("overwrite").parquet(f"{folder}/benchmark.parquet")
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, folder)
        assert out.columns == docs.columns, name
        now = spark.createDataFrame(out.collect(), out.schema)
        assert 0 < now.count()
    kept = {r["doc_id"]: r for r in now.collect()}
    assert 3 in kept and len(kept[3]["text"]) > 100_000 and {0, 1, 2, 7, 8} & set(kept) == set()
    assert sum(i in kept for i in (4, 5)) == 1 and all(r["n_lines"] == 1 and r["a.b"] == "z" and r["lang"] in ("de", "en") for r in kept.values())
    tokens = corpus_pipeline.STAGES[-1][1](spark, now, folder).collect()
    assert {r["doc_id"] for r in tokens} == set(kept)


def test_language_limit_comes_from_the_training_part(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    one = langid.fit_with_limit(docs)
    two = langid.fit_with_limit(docs.withColumn("lang", F.when(held, F.lit("xx")).otherwise(F.col("lang"))))
    assert one[0] == two[0] and one[2] == two[2] > 1 / len(one[0]) * 0.9
    assert all(np.array_equal(one[1].p[k], two[1].p[k]) for k in one[1].p)


def test_language_model_and_limit_come_from_every_row_of_the_training_part(spark, monkeypatch):
    """Against plain loops over all rows: F1's fit read about SAMPLE_ROWS rows of a language, none over SAMPLE_CHARS."""
    monkeypatch.setattr(langid, "SAMPLE_ROWS", 3)  # of the start alone
    monkeypatch.setattr(langid, "PIECES", 100)
    monkeypatch.setattr(langid, "SHARD_BYTES", 60_000)
    rows = duckdb.sql(f"SELECT doc_id, text, lang FROM '{D}/documents.parquet'").fetchall()
    rows += [(10_000 + k, f"oj{k} zjy qvuu kzy " * (1300 + k), "zz") for k in range(12)]  # no text of this one is short
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    starts = []
    train = langid.train
    monkeypatch.setattr(langid, "train", lambda texts: starts.append(train(texts)) or starts[-1])
    langs, net, limit = langid.fit_with_limit(docs)
    assert langs == sorted({lang for *_, lang in rows if lang})

    part = [r for r in rows if r[1] and r[2] and zlib.crc32(str(r[0]).encode()) % 3 != 1 and re.search(r"[^\W\d_]", r[1])]
    aside = [r for r in part if zlib.crc32(r[1].encode()) % 5 == 0]
    seen = {r[0]: r for r in part if zlib.crc32(r[1].encode()) % 5}
    size = {lang: sum(len(langid.spelled(t)) for _, t, x in seen.values() if x == lang) for lang in langs}
    weight = np.array([sum(size.values()) / len(langs) / size[lang] for lang in langs])
    n = -(-sum(size.values()) // 60_000)
    placed = docs.where(F.col("lang").isNotNull()).select("doc_id", F.xxhash64("doc_id", "text", "lang").alias("h")).select("doc_id", "h", F.expr(f"pmod(hash(h), {n})").alias("shard"))
    shards = {}
    for i, _, s in sorted(((r["doc_id"], r["h"], r["shard"]) for r in placed.collect()), key=lambda x: x[1]):
        if i in seen:
            shards.setdefault(s, []).append(seen[i])
    total = {k: 0.0 for k in net.p}
    for members in shards.values():
        own = langid.Network({k: v.copy() for k, v in starts[0][1].p.items()})
        data = [langid.spelled(t) for _, t, _ in members]
        langid.refine(own, data, [langs.index(lang) for *_, lang in members], weight)
        for k in total:
            total[k] = total[k] + own.p[k].astype(float) * sum(map(len, data)) / sum(size.values())
    assert len(shards) > 3 and sum(map(len, shards.values())) == len(seen) > 100
    assert all(np.allclose(net.p[k], total[k], atol=1e-4) for k in net.p)
    assert any(not np.allclose(net.p[k], starts[0][1].p[k], atol=1e-2) for k in net.p)

    found = langid.Reader(langs, net.p).label([t for _, t, _ in aside])
    right = [score for (lang, score), r in zip(found, aside) if lang == r[2]]
    assert limit == pytest.approx(langid.LEAST * min(right), rel=1e-5) and len(right) > 15

    monkeypatch.setattr(langid, "train", lambda texts: starts[0])
    again = langid.fit_with_limit(docs.union(docs.limit(50)).repartition(7))  # stored otherwise, with repeated rows
    assert again[0] == langs and all(np.array_equal(again[1].p[k], net.p[k]) for k in net.p) and again[2] == pytest.approx(limit, rel=1e-5)


def test_language_training_reads_every_byte_once_with_its_weight():
    texts = [b"ab", b"x" * langid.PIECE_BYTES, bytes(range(1, 200))]
    x, size, text = langid.cut(texts)
    assert [b"".join(bytes(x[k][: size[k]]) for k in np.flatnonzero(text == i)) for i in range(3)] == texts
    net = langid.Network.fresh(2)
    x, size = langid.pack([b"abc", b"de"])
    one = net.gradients(x, size, np.array([0, 1]), np.array([1.0, 3.0]))
    three = net.gradients(x[[0, 1, 1, 1]], size[[0, 1, 1, 1]], np.array([0, 1, 1, 1]))
    assert all(np.allclose(one[k], three[k], atol=1e-6) for k in one)


def test_toxicity_settings_are_measured_on_folds_left_out():
    from agentlake.llm import tune_toxicity

    rows = [(f"some words {k % 7} and w{k} " + ("vile" if k % 3 == 0 else "fine"), int(k % 3 == 0)) for k in range(600)]
    data = [(k // 3 % 3, np.unique(toxicity.features(t)), y) for k, (t, y) in enumerate(rows)]
    strong, blind = toxicity.Settings(l1=4.0), toxicity.Settings(l1=1e6)
    assert tune_toxicity.measure(data, strong)[2] > 0.95 > tune_toxicity.measure(data, blind)[2]
    assert toxicity.SETTINGS in tune_toxicity.GRID


def least_distance(p, t):
    """Of p to any part of t, by the dynamic programme, a row at a time."""
    text = np.frombuffer(t.encode("utf-32-le"), np.uint32)
    at = np.arange(len(text) + 1)
    row = np.zeros(len(text) + 1, dtype=np.int64)
    for i, c in enumerate(p, 1):
        new = np.empty_like(row)
        new[0] = i
        new[1:] = np.minimum(row[1:] + 1, row[:-1] + (text != ord(c)))
        row = np.minimum.accumulate(new - at) + at
    return int(row.min())


def test_pipeline_equals_brute_force(spark):
    """Each stage on what its predecessor kept, against its own plain version."""
    import random

    import corpus_pipeline
    from agentlake.llm import decontam
    from tokenizers import Tokenizer

    from .test_operators import brute_lines

    docs = spark.read.parquet(f"{D}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    rows = lambda df: {r["doc_id"]: r.asDict() for r in df.collect()}
    again = lambda df: spark.createDataFrame(df.collect(), df.schema)

    langs, net, limit = langid.fit_with_limit(docs)
    before = rows(docs)
    now = again(stages["language_id"](spark, docs, D))
    labels = langid.Reader(langs, net.p).label([r["text"] or "" for r in before.values()])
    want = {i: lang for i, (lang, score) in zip(before, labels) if lang != "und" and score >= limit}
    assert {i: r["lang"] for i, r in rows(now).items()} == want

    before = rows(now)
    now = again(stages["line_dedup"](spark, now, D))
    flat = [(i, r["text"], r["source"]) for i, r in before.items()]
    want = {i: t if any(x.strip() for x in t.split("\n")) else before[i]["text"] for i, t, *_ in brute_lines(flat, line_dedup.RATIO, corpus_pipeline.LINE_PAGES)}
    assert {i: r["text"] for i, r in rows(now).items()} == want and all(r["n_chars"] == len(r["text"]) for r in rows(now).values())

    before = rows(now)
    now = again(stages["simhash_near_dedup"](spark, now, D))
    by = {}
    for i, r in before.items():
        by.setdefault(brute_fingerprint(r["text"]), []).append(i)
    f = np.array(sorted(by), dtype=np.uint64)
    assert sorted(rows(now)) == sorted(min(i for fp in g for i in by[fp % 2**64]) for g in partition(f.view(np.int64).tolist(), brute_links(f)))

    before = rows(now)
    items = duckdb.sql(f"SELECT item_id, text FROM '{D}/benchmark.parquet'").fetchall()
    found = {(r["doc_id"], r["item_id"]): r["distance"] for r in decontam.matches(now, spark.read.parquet(f"{D}/benchmark.parquet")).collect()}
    now = again(stages["decontamination"](spark, now, D))
    rng = random.Random(1)
    tried = {(i, k) for i in before for k in rng.sample(range(len(items)), 4)} | {(i, k) for k, (n, _) in enumerate(items) for i in before if (i, n) in found}
    for i, k in tried:
        p = decontam.normal(items[k][1])
        d = least_distance(p, decontam.normal(before[i]["text"]))
        assert found.get((i, items[k][0])) == (d if d <= len(p) // 10 else None)
    assert sorted(rows(now)) == sorted(set(before) - {i for i, _ in found}) and found

    lib = Tokenizer.from_file(tokenizer())
    out = rows(stages["bpe"](spark, now, D))
    for i, r in rows(now).items():
        assert out[i]["ids"] == lib.encode(r["text"], add_special_tokens=False).ids
