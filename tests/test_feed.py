import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from agentlake.errors import FeedError
from agentlake.operators import cdc
from agentlake.sources import feed
from agentlake.streaming import sinks
from agentlake.streaming.release import commit_release

LOG = "txn long, lsn long, tbl string, op string, key string, value double, end_lsn long"


def log_rows():
    out, lsn = [], 0
    for txn in range(1, 13):
        for k in range(3):
            lsn += 1
            out.append((txn, lsn, "t", "DELETE" if (txn + k) % 5 == 0 else "UPDATE", str((txn * k) % 4), float(lsn), None))
        lsn += 1
        if txn % 4:
            out.append((txn, lsn, "t", "ABORT" if txn % 3 == 0 else "COMMIT", None, None, lsn + 1))
    return out


def batch_decode(spark):
    log = spark.createDataFrame(log_rows(), LOG)
    ends = log.where("op in ('COMMIT', 'ABORT')").select("txn", "op", "lsn", "end_lsn")
    return cdc.decode(log.where("op not in ('COMMIT', 'ABORT')").drop("end_lsn"), ends)


def test_stream_release_and_upsert_equal_batch(spark, tmp_path):
    rows = log_rows()
    for i in range(3):
        part = spark.createDataFrame(rows[i * 17 : i * 17 + 17], LOG)  # transactions span batches
        part.coalesce(1).write.parquet(f"{tmp_path}/log/{i}")
    image = T.StructType([T.StructField("key", T.StringType()), T.StructField("value", T.DoubleType())])
    sink = sinks.ParquetSink(spark, f"file://{tmp_path}/sink", "key", image)
    stream = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/log/*")
    run = commit_release(stream).writeStream.foreachBatch(sink.apply).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    run.awaitTermination()
    want = sorted(map(tuple, cdc.fold(batch_decode(spark), "key", ["value"]).collect()))
    assert sorted(map(tuple, sink.live().select("key", "value").collect())) == want and want
    sink.apply(batch_decode(spark), sink.versions()[-1] + 1)  # a replay changes nothing
    assert sorted(map(tuple, sink.live().select("key", "value").collect())) == want


EVENTS = [
    ("t", "CREATE_TABLE", 0, 1, 1, 2, None, '{"columns":[{"name":"id","type":"INTEGER","nullable":false},{"name":"big","type":"BIGINT","nullable":true}]}'),
    ("t", "INSERT", 1, 3, 5, 6, None, '{"id":1,"big":"9007199254740993"}'),
    ("t", "INSERT", 1, 4, 5, 6, None, '{"id":2,"big":null}'),
    ("t", "UPDATE", 2, 7, 8, 9, '{"id":2,"big":null}', '{"id":2,"big":"-1"}'),
    ("t", "DELETE", 3, 10, 11, 12, '{"id":1,"big":"9007199254740993"}', None),
    ("t", "INSERT", 4, 13, 14, 15, None, '{"id":1,"big":"7"}'),
]
SCHEMA = "tbl string, op string, txn long, lsn long, commit_lsn long, commit_end_lsn long, before string, after string"


def test_feed_round_trip_and_refusals(spark, tmp_path):
    events = spark.createDataFrame(EVENTS, SCHEMA)
    feed.write_feed(events, f"{tmp_path}/feed")
    assert sorted(map(tuple, feed.read_feed(spark, f"{tmp_path}/feed").collect()), key=lambda r: r[3]) == EVENTS
    spark.createDataFrame([("{broken",)], "value string").write.text(f"{tmp_path}/bad")
    with pytest.raises(FeedError, match="no events"):
        feed.read_feed(spark, f"{tmp_path}/bad")
    spark.createDataFrame([], "value string").write.text(f"{tmp_path}/none")
    with pytest.raises(FeedError, match="empty"):
        feed.read_feed(spark, f"{tmp_path}/none")


@pytest.mark.parametrize("kind", ["sqlite", "duckdb"])
def test_database_sinks_converge_under_replay(spark, tmp_path, kind):
    sink = getattr(sinks, f"{kind}_sink")(f"{tmp_path}/x.{kind}")
    events = spark.createDataFrame(EVENTS, SCHEMA)
    live = lambda: sorted((a, int(b)) for a, b in sink.connection.execute('SELECT id, big FROM t WHERE NOT _deleted').fetchall())
    sink.apply(events.where("commit_lsn <= 8"))
    assert live() == [(1, 9007199254740993), (2, -1)]
    sink.apply(events)
    sink.apply(events.where("commit_lsn <= 11"))
    assert live() == [(1, 7), (2, -1)] and sink.cursor("t") == (14, 13)
    other = spark.createDataFrame([("t", "CREATE_TABLE", 0, 20, 20, 21, None, '{"columns":[{"name":"id","type":"VARCHAR(4)","nullable":false}]}')], SCHEMA)
    with pytest.raises(FeedError, match="declares"):
        sink.apply(other)


def test_violations_and_cutover(spark):
    bad = [*EVENTS, ("t", "INSERT", 9, 30, 31, 31, None, "{}"), ("t", "UPDATE", 9, 32, 33, 34, None, "{}"), ("t", "MAGIC", 9, 35, 36, 37, None, "{}")]
    df = spark.createDataFrame(bad, SCHEMA).withColumn("line", F.col("lsn")).where("op <> 'CREATE_TABLE'")
    assert {r["lsn"] for r in cdc.violations(df).collect()} == {30, 32, 35}
    decoded = spark.createDataFrame(EVENTS[1:], SCHEMA)
    left = cdc.pump(decoded, 0, {"high_water": 4, "active": {2}, "tables": {"t"}})
    assert {r["txn"] for r in left.collect()} == {2, 4}
    opened = spark.createDataFrame([(7, 9)], "txn long, first_lsn long")
    assert cdc.next_cursor(3, decoded, opened) == 9 and cdc.next_cursor(3, decoded, opened.where("false")) == 15


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 3), st.sampled_from(["INSERT", "UPDATE", "DELETE"])), min_size=1, max_size=12), st.randoms())
def test_upsert_converges_in_any_order(spark, ops, rng):
    rows = [(k, op, i, i * 10, float(i)) for i, (k, op) in enumerate(ops)]
    shuffled = [*rows, *rows[: len(rows) // 2]]
    rng.shuffle(shuffled)
    schema = "key int, op string, lsn long, commit_lsn long, value double"
    empty = spark.createDataFrame([], "key int, value double, _commit_lsn long, _lsn long, _deleted boolean")
    half = len(shuffled) // 2
    out = empty
    for part in (shuffled[:half], shuffled[half:]):
        out = cdc.guarded_upsert(out, spark.createDataFrame(part, schema), "key", ["value"])
    want = {}
    for k, op, _, _, v in rows:
        want[k] = None if op == "DELETE" else v
    got = {r["key"]: None if r["_deleted"] else r["value"] for r in out.collect()}
    assert got == want


def test_tcp_feed_goes_on_from_its_cursor(spark, tmp_path):
    import socketserver
    import threading

    lines = [(k, f'{{"table":"t","op":"INSERT","txn":{k},"lsn":{k * 10},"commit_lsn":{k * 10 + 1},"commit_end_lsn":{k * 10 + 2},"before":null,"after":"{{}}"}}') for k in range(1, 7)]
    asked, most = [], [3]

    class Serve(socketserver.StreamRequestHandler):
        def handle(self):
            cursor = int(self.rfile.readline())
            asked.append(cursor)
            for k, line in lines[: most[0]]:
                if k * 10 + 2 > cursor:
                    self.wfile.write(f"{line}\n".encode())

    with socketserver.ThreadingTCPServer(("127.0.0.1", 0), Serve) as server:
        threading.Thread(target=server.serve_forever, daemon=True).start()
        seen = []

        def once():
            stream = feed.follow(spark, "127.0.0.1", server.server_address[1], idle=0.3)
            run = stream.writeStream.foreachBatch(lambda df, _: seen.extend(r["txn"] for r in df.collect())).option("checkpointLocation", f"{tmp_path}/cp").start()
            try:
                run.processAllAvailable()
            finally:
                run.stop()

        once()
        assert sorted(seen) == [1, 2, 3]
        most[0] = 6
        once()  # a new query with the old checkpoint
        assert sorted(seen) == [1, 2, 3, 4, 5, 6] and 0 in asked and 32 in asked
        server.shutdown()


def test_streams_refuse_or_keep_malformed_lines(spark, tmp_path):
    (tmp_path / "feed").mkdir()
    (tmp_path / "feed" / "a").write_text('{"table":"t","op":"INSERT","txn":1,"lsn":1,"commit_lsn":2,"commit_end_lsn":3,"before":null,"after":"{}"}\nnot json\n')
    run = lambda df, n: df.writeStream.format("memory").queryName(n).option("checkpointLocation", f"{tmp_path}/{n}").trigger(availableNow=True).start()
    with pytest.raises(Exception, match="no event"):
        run(feed.stream_feed(spark, f"file://{tmp_path}/feed"), "refused").awaitTermination()
    run(feed.stream_feed(spark, f"file://{tmp_path}/feed", keep_corrupt=True), "kept").awaitTermination()
    assert spark.table("kept").where("_corrupt is not null").count() == 1 and spark.table("kept").count() == 2


def test_fractions_in_the_precision_report(spark):
    texts = ["0.1", "0.10", "2.5", "1e5", "0.12345678901234567890", "123456789.123456789", "-0.001", "12345678901234567890.5"]
    df = spark.createDataFrame([(f'{{"x":{t}}}',) for t in texts], "j string")
    r = cdc.precision_report(df, "j", ["x"]).first()
    assert (r["strings"], r["numbers"], r["lossy"]) == (0, 8, 3)


def test_sink_refuses_a_destination_of_other_types(tmp_path):
    import duckdb

    duckdb.connect(f"{tmp_path}/d.db").execute('CREATE TABLE t (id VARCHAR PRIMARY KEY, v BIGINT, _commit_lsn BIGINT, _lsn BIGINT, _deleted BOOLEAN)').close()
    sink = sinks.duckdb_sink(f"{tmp_path}/d.db")
    with pytest.raises(FeedError, match="drop the destination"):
        sink.declare("t", [("id", "INTEGER"), ("v", "BIGINT")])
    with pytest.raises(FeedError, match="what lies between is lost"):
        cdc.pump(None, 0, cursor=5, base=9)
