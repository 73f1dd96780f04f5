"""Helpers shared by the training-data operators."""

from __future__ import annotations

import io
import re
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path
from typing import TypeVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

T = TypeVar("T")

#: Python operators work on blocks of about this many characters, so that a worker's
#: memory follows the block (or one long document), not the Arrow batch.
BLOCK_CHARS = 1 << 20
#: Rows of a few numbers each that are written as one file.
ROWS_A_FILE = 250_000
ARROW_ROWS = 2_000
ARROW_BYTES = 8 << 20


def ship(spark: SparkSession) -> None:
    """Make this package importable by the Python workers of every executor (once a context), and bound their batches.

    Texts can be long, so the default of 10,000 rows a batch is no bound of memory; a session
    that has not chosen otherwise gets ARROW_ROWS and ARROW_BYTES.
    """
    sc = spark.sparkContext
    for key, default, value in (("maxRecordsPerBatch", "10000", ARROW_ROWS), ("maxBytesPerBatch", "67108864b", ARROW_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        if not sc.getConf().contains(key) and spark.conf.get(key, default) == default:
            spark.conf.set(key, str(value))
    if getattr(sc, "_agentlake_shipped", False):
        return
    root = Path(__file__).resolve().parents[2]
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as archive:
        for path in sorted(root.glob("agentlake/**/*.py")):
            archive.write(path, path.relative_to(root))
    folder = Path(tempfile.mkdtemp(prefix="agentlake-"))  # read by the driver alone, which serves it to executors
    (folder / "agentlake_src.zip").write_bytes(buffer.getvalue())
    sc.addPyFile(str(folder / "agentlake_src.zip"))
    sc._agentlake_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where none is set (local tests)."""
    sc = spark.sparkContext
    if found := sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None):
        return found
    if sc.getCheckpointDir() is None:
        if not re.fullmatch(r"local(\[[^]]*\])?", sc.master):  # local-cluster has executors of their own
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="agentlake-checkpoint-"))
    return sc.getCheckpointDir()


def materialize(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Compute once and cut the lineage, in shared storage that outlives executors.

    ``rows``, where it is known what there are at most, spares small tables a file for each
    of the session's shuffle partitions.
    """
    shared_dir(df.sparkSession)
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // ROWS_A_FILE)))
    return df.checkpoint(eager=True)


def map_rows(docs: DataFrame, run: Callable[[Iterator], Iterator]) -> DataFrame:
    """``mapInArrow`` over all columns, which keep their names, whatever characters those have; ``run`` goes by position."""
    plain = docs.toDF(*(f"c{k}" for k in range(len(docs.columns))))
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the rows that no model may learn from: crc32(id as text) mod 3 is 1; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def text_blocks(ids: list, texts: list, limit: int = BLOCK_CHARS) -> Iterator[tuple[list, list[str]]]:
    """Runs of (ids, texts) of at least one row and about ``limit`` characters; null texts are empty."""
    a, b, size = [], [], 0
    for i, t in zip(ids, texts, strict=True):
        t = t or ""
        if b and size + len(t) > limit:
            yield a, b
            a, b, size = [], [], 0
        a.append(i)
        b.append(t)
        size += len(t)
    if b:
        yield a, b


_resident: dict[tuple, object] = {}


def resident(key: tuple, build: Callable[[], T]) -> T:
    """State that a Python worker keeps between tasks, such as a vocabulary with its cache.

    A worker serves one operator after another and has the memory of one: only the last
    key's state stays.
    """
    if key not in _resident:
        _resident.clear()
        _resident[key] = build()
    return _resident[key]


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
