"""Helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from learnlens.functions import staging


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder: the one named in `spark.checkpoint.dir`, or on one machine one below the warehouse."""
    return staging.shared_folder(spark).rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Write `df` to the shared checkpoint folder and return a frame that reads it, so that lost executors cost a re-read."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder that this package has written, through the file system that Spark itself uses for it."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def bounded_batches(df: DataFrame, rows: int = 2_000) -> DataFrame:
    """`df`, after asking its session for smaller batches of rows to Python, as whole texts are long."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    return df


def held_out(doc_id: Column) -> Column:
    """True for the documents kept apart from every training set: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def slices(batch: pa.RecordBatch, column: str, most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that the text of each part stays near `most_bytes`; a single longer text is a part of its own."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start, total = 0, 0
    for i, size in enumerate(sizes):
        if i > start and total + size > most_bytes:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield batch.slice(start)


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of a batch, null as empty."""
    return [x or "" for x in batch.column(column).to_pylist()]


def record(columns: dict[str, object], types: Sequence[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x := columns[name], pa.Array) else pa.array(x, type=kind) for name, kind in types], names=[name for name, _ in types])
