"""JSON Lines change feeds: one event a line, read and written in batch or as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from agentlake.errors import FeedError

#: The envelope; every field is always present in a written line.
ENVELOPE = T.StructType(
    [
        T.StructField("table", T.StringType()),
        T.StructField("op", T.StringType()),
        T.StructField("txn", T.LongType()),
        T.StructField("lsn", T.LongType()),
        T.StructField("commit_lsn", T.LongType()),
        T.StructField("commit_end_lsn", T.LongType()),
        T.StructField("before", T.StringType()),
        T.StructField("after", T.StringType()),
        T.StructField("_corrupt", T.StringType()),
    ]
)
#: Destination types of the sinks.
DUCKDB_TYPES = {"INTEGER": "BIGINT", "BIGINT": "BIGINT", "TIMESTAMP": "BIGINT", "DECIMAL": "VARCHAR", "VARCHAR": "VARCHAR", "FLOAT": "DOUBLE", "BOOLEAN": "BOOLEAN"}
SQLITE_TYPES = {"INTEGER": "INTEGER", "BIGINT": "INTEGER", "TIMESTAMP": "INTEGER", "DECIMAL": "TEXT", "VARCHAR": "TEXT", "FLOAT": "REAL", "BOOLEAN": "INTEGER"}


def events_of(lines: DataFrame) -> DataFrame:
    """Events of a DataFrame with ``value``; lines that are no JSON object keep their text in ``_corrupt``."""
    parsed = F.from_json("value", ENVELOPE, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    return lines.where(F.length(F.trim("value")) > 0).select(parsed.alias("e")).select("e.*").withColumnRenamed("table", "tbl")


def read_feed(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """A feed file or folder; ``strict`` refuses an empty feed and lines that are no events."""
    out = events_of(spark.read.text(path))
    if strict:
        found = out.agg(F.count("*").alias("n"), F.count("_corrupt").alias("bad"), F.first("_corrupt", ignorenulls=True).alias("line")).first()
        if not found["n"]:
            raise FeedError(f"feed {path} is empty; a feed declares its tables at least")
        if found["bad"]:
            raise FeedError(f"feed {path} has {found['bad']} line(s) that are no events, such as {found['line'][:80]!r}")
    return out.drop("_corrupt")


def _refused(events: DataFrame) -> DataFrame:
    """A stream's events; a line that is none ends the stream with an error that shows it, as skipping it would lose a change."""
    text = F.concat(F.lit("a line of the feed is no event: "), F.substring("_corrupt", 1, 80))
    return events.where(F.when(F.col("_corrupt").isNull(), F.lit(True)).otherwise(F.raise_error(text).cast("boolean"))).drop("_corrupt")


def stream_feed(spark: SparkSession, path: str, files_per_batch: int = 16, keep_corrupt: bool = False) -> DataFrame:
    """The same as a stream of the folder's files; the checkpoint keeps the cursor.

    With ``keep_corrupt`` lines that are no events come with their text in ``_corrupt``, for
    a destination of their own, instead of ending the stream.
    """
    events = events_of(spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(path))
    return events if keep_corrupt else _refused(events)


def feed_lines(events: DataFrame) -> DataFrame:
    """One ``value`` an event; the images are JSON objects already and are embedded as they are."""
    image = lambda c: F.concat(F.lit(f'"{c}":'), F.coalesce(F.col(c), F.lit("null")))
    head = F.to_json(F.struct(F.col("tbl").alias("table"), "op", "txn", "lsn", "commit_lsn", "commit_end_lsn"), {"ignoreNullFields": "false"})
    return events.select(F.concat(F.regexp_replace(head, r"\}$", ""), F.lit(","), image("before"), F.lit(","), image("after"), F.lit("}")).alias("value"))


def write_feed(events: DataFrame, path: str) -> None:
    feed_lines(events).write.text(path)


def snapshot(rows: DataFrame, tbl: str, columns: dict[str, str], resume_lsn: int) -> DataFrame:
    """READ events of a table's rows at one position, for a consumer that starts from a copy."""
    from agentlake.operators.cdc import encoded

    at = F.lit(resume_lsn).cast("long")
    key = next(iter(columns))
    return rows.select(
        F.lit(tbl).alias("tbl"), F.lit("READ").alias("op"), F.lit(0).cast("long").alias("txn"), at.alias("lsn"), at.alias("commit_lsn"), at.alias("commit_end_lsn"),
        F.col(key).cast("string").alias("key"), F.lit(None).cast("string").alias("before"), encoded(columns).alias("after"))


def dump(rows: DataFrame, columns: dict[str, str]) -> DataFrame:
    """A source dump: one JSON object a row."""
    from agentlake.operators.cdc import encoded

    return rows.select(encoded(columns).alias("value"))


def follow(spark: SparkSession, host: str, port: int, cursor: int = 0, idle: float = 1.0) -> DataFrame:
    """Events of a TCP feed as a stream: each batch connects, sends the cursor as a line and takes what comes.

    The offset is the last commit's end, kept by the stream's checkpoint; a batch that is
    repeated asks the feed again from its old cursor.  ``idle`` seconds without a line end
    a batch; a commit's lines are sent together.
    """
    spark.dataSource.register(_tcp_source())
    lines = spark.readStream.format("agentlake_tcp_feed").option("host", host).option("port", str(port)).option("cursor", str(cursor)).option("idle", str(idle)).load()
    return _refused(events_of(lines))


def _tcp_source() -> type:
    """The source's class, made here so that workers get it whole."""
    import json
    import socket

    from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

    class Reader(SimpleDataSourceStreamReader):
        def __init__(self, options: dict):
            self.at = (options["host"], int(options["port"]))
            self.first, self.idle = int(options.get("cursor", "0")), float(options.get("idle", "1"))

        def initialOffset(self) -> dict:
            return {"cursor": self.first}

        def read(self, start: dict):
            lines = self._lines(start["cursor"], None)
            ends = [e for _, e in lines if e is not None]
            return iter([(line,) for line, _ in lines]), {"cursor": max([start["cursor"], *ends])}

        def readBetweenOffsets(self, start: dict, end: dict):
            return iter([(line,) for line, _ in self._lines(start["cursor"], end["cursor"])])

        def _lines(self, cursor: int, until: int | None) -> list[tuple[str, int | None]]:
            """(line, the end of its commit); a line that is no event comes as it is, to be refused."""
            out: list[tuple[str, int | None]] = []
            with socket.create_connection(self.at, timeout=30) as connection:
                connection.sendall(f"{cursor}\n".encode())
                connection.settimeout(self.idle)
                rest = b""
                while True:
                    try:
                        got = connection.recv(1 << 16)
                    except TimeoutError:
                        break
                    if not got:
                        break
                    *whole, rest = (rest + got).split(b"\n")
                    for line in filter(None, whole):
                        text = line.decode("utf-8", "replace")
                        try:
                            end = int(json.loads(text)["commit_end_lsn"])
                        except (ValueError, KeyError, TypeError):
                            end = None
                        if until is not None and end is not None and end > until:
                            return out
                        out.append((text, end))
            return out

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return "agentlake_tcp_feed"

        def schema(self) -> str:
            return "value string"

        def simpleStreamReader(self, schema) -> Reader:
            return Reader(self.options)

    return Source
