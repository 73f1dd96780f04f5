"""Sinks for change feeds: each event applies if its (commit_lsn, lsn) is beyond what the row has, so replays change nothing."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from agentlake.errors import FeedError
from agentlake.operators import cdc
from agentlake.sources.feed import DUCKDB_TYPES, SQLITE_TYPES


class ParquetSink:
    """A soft-deleting Parquet table: every batch writes the next version, named by the batch.

    ``foreachBatch`` may repeat a batch after a failure; its version is then already there.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, image: T.StructType):
        self.spark, self.path, self.key, self.image = spark, path.rstrip("/"), key, image

    def _fs(self):
        jvm = self.spark._jvm
        return jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        fs, root = self._fs(), self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not fs.exists(root):
            return []
        found = [s.getPath() for s in fs.listStatus(root) if s.getPath().getName().startswith("v")]
        return sorted(int(p.getName()[1:]) for p in found if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def read(self) -> DataFrame:
        """All rows with their bookkeeping; the live ones are those that are not ``_deleted``."""
        found = self.versions()
        if found:
            return self.spark.read.parquet(f"{self.path}/v{found[-1]}")
        fields = [*self.image.fields, T.StructField("_commit_lsn", T.LongType()), T.StructField("_lsn", T.LongType()), T.StructField("_deleted", T.BooleanType())]
        return self.spark.createDataFrame([], T.StructType(fields))

    def live(self) -> DataFrame:
        return self.read().where("not _deleted").drop("_commit_lsn", "_lsn", "_deleted")

    def apply(self, events: DataFrame, batch: int) -> None:
        """For ``foreachBatch``: fold the batch's events over the last version."""
        done = self.versions()
        if done and batch <= done[-1]:
            return
        names = [f.name for f in self.image.fields if f.name != self.key]
        out = cdc.guarded_upsert(self.read(), events, self.key, names)
        out.write.mode("overwrite").parquet(f"{self.path}/v{batch}")
        old = [v for v in done if v < batch][:-1]  # the last two stay, for readers
        for v in old:
            self._fs().delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/v{v}"), True)


class DatabaseSink:
    """A DB-API destination (SQLite or DuckDB) with its own checkpoint, in one transaction a batch.

    Events are reduced to the last of each key in Spark and sent over a partition at a time.
    """

    def __init__(self, connect: Callable[[], object], types: dict[str, str]):
        self.connection, self.types = connect(), types
        self.connection.execute("CREATE TABLE IF NOT EXISTS _sink_position (destination VARCHAR PRIMARY KEY, at_commit BIGINT, at_record BIGINT)")
        self.columns: dict[str, list[tuple[str, str]]] = {}

    def declare(self, table: str, columns: list[tuple[str, str]]) -> None:
        """Create the destination; one that exists with other columns is refused.  The first column is the key."""
        kinds = [(c, self.types[t.split("(")[0]]) for c, t in columns]
        if table in self.columns and self.columns[table] != kinds:
            raise FeedError(f"table {table!r} has columns {self.columns[table]}, the feed declares {kinds}; drop the destination or fix the feed")
        spelled = ", ".join(f'"{c}" {t}' for c, t in kinds)
        self.connection.execute(f'CREATE TABLE IF NOT EXISTS "{table}" ({spelled}, _commit_lsn BIGINT, _lsn BIGINT, _deleted BOOLEAN, PRIMARY KEY ("{kinds[0][0]}"))')
        wanted = [*kinds, ("_commit_lsn", "BIGINT"), ("_lsn", "BIGINT"), ("_deleted", "BOOLEAN")]
        there = [(r[1], r[2].upper()) for r in self.connection.execute(f"PRAGMA table_info('{table}')").fetchall()]
        if there != wanted:
            raise FeedError(f"destination {table!r} has columns {there}, the feed needs {wanted}; drop the destination or fix the feed")
        self.columns[table] = kinds

    def cursor(self, table: str) -> tuple[int, int] | None:
        found = self.connection.execute("SELECT at_commit, at_record FROM _sink_position WHERE destination = ?", [table]).fetchone()
        return tuple(found) if found else None

    def apply(self, events: DataFrame, batch: int = 0) -> None:
        """Schema events in order, then each table's rows; ``events`` as ``feed.read_feed`` gives them."""
        schema = events.where(F.col("op").isin(*cdc.SCHEMA_OPS)).orderBy("commit_lsn", "lsn").select("tbl", "op", "after", "commit_lsn", "lsn").collect()
        for e in schema:
            if e["op"] == "DROP_TABLE":
                self.connection.execute(f'DROP TABLE IF EXISTS "{e["tbl"]}"')
                self.columns.pop(e["tbl"], None)
            else:
                self.declare(e["tbl"], [(c["name"], c["type"]) for c in json.loads(e["after"])["columns"]])
        for table in list(self.columns):
            dropped = max(((e["commit_lsn"], e["lsn"]) for e in schema if e["tbl"] == table and e["op"] == "DROP_TABLE"), default=(-1, -1))
            self._rows(table, events.where(F.col("tbl") == table), dropped)

    def _rows(self, table: str, events: DataFrame, dropped: tuple[int, int]) -> None:
        names = [c for c, _ in self.columns[table]]
        image = F.coalesce("after", "before")
        row = events.where(~F.col("op").isin(*cdc.SCHEMA_OPS)).where(F.struct("commit_lsn", "lsn") > _at(dropped))
        at = self.cursor(table)
        if at is not None:
            row = row.where((F.col("op") == "READ") | (F.struct("commit_lsn", "lsn") > _at(at)))
        row = row.select("op", "commit_lsn", "lsn", image.alias("image"), F.get_json_object(image, f"$.{names[0]}").alias("key"))
        last = row.groupBy("key").agg(F.max_by(F.struct("op", "commit_lsn", "lsn", "image"), F.struct("commit_lsn", "lsn")).alias("r")).select("r.*")
        spelled, marks = ", ".join(f'"{c}"' for c in names), ", ".join("?" for _ in names)
        sets = ", ".join(f'"{c}" = excluded."{c}"' for c in [*names[1:], "_commit_lsn", "_lsn", "_deleted"])
        newer = f'excluded._commit_lsn > "{table}"._commit_lsn OR (excluded._commit_lsn = "{table}"._commit_lsn AND excluded._lsn > "{table}"._lsn)'
        sql = f'INSERT INTO "{table}" ({spelled}, _commit_lsn, _lsn, _deleted) VALUES ({marks}, ?, ?, ?) ON CONFLICT ("{names[0]}") DO UPDATE SET {sets} WHERE {newer}'
        top = at
        self.connection.execute("BEGIN")
        try:
            for r in last.toLocalIterator():
                values = json.loads(r["image"])
                self.connection.execute(sql, [values.get(c) for c in names] + [r["commit_lsn"], r["lsn"], r["op"] == "DELETE"])
                top = max(filter(None, (top, (r["commit_lsn"], r["lsn"]))))
            if top is not None:
                self.connection.execute("INSERT INTO _sink_position VALUES (?, ?, ?) ON CONFLICT (destination) DO UPDATE SET at_commit = excluded.at_commit, at_record = excluded.at_record", [table, *top])
            self.connection.execute("COMMIT")
        except BaseException:
            self.connection.execute("ROLLBACK")
            raise


def _at(position: tuple[int, int]) -> Column:
    return F.struct(*(F.lit(x).cast("long") for x in position))


def sqlite_sink(path: str) -> DatabaseSink:
    import sqlite3

    return DatabaseSink(lambda: sqlite3.connect(path, isolation_level=None, check_same_thread=False), SQLITE_TYPES)


def duckdb_sink(path: str) -> DatabaseSink:
    import duckdb

    return DatabaseSink(lambda: duckdb.connect(path), DUCKDB_TYPES)
