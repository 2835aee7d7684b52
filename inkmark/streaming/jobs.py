"""Structured Streaming jobs: scoring, exact deduplication and running counts.

Every job reads a file stream to its end with ``availableNow`` and writes to a table below the path
it is given, with its checkpoint next to it; a restart with the same path continues there. State
lives in RocksDB unless the session names another provider, so it may outgrow the memory of the
executors. The provider is a setting of the session: it holds for all queries started meanwhile.
"""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import StructType

from inkmark.functions.text import squash_spaces
from inkmark.session import scratch_path

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DEFAULT = "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def _rocksdb_state(spark: SparkSession):
    """RocksDB for the query started inside, unless the session names a provider."""
    named = spark.conf.get(PROVIDER, None)
    keep = named is not None and named != DEFAULT
    if not keep:
        spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        if not keep:
            spark.conf.unset(PROVIDER)


def file_stream(spark: SparkSession, folder: str, pattern: str, schema: StructType, files_per_batch: int = 1000) -> DataFrame:
    """The files of a folder that match the pattern. A table written as a folder is streamed as that folder, see ``table_stream``."""
    return (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", pattern)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(folder)
    )


def table_stream(spark: SparkSession, folder: str, name: str, schema: StructType, files_per_batch: int = 1000) -> DataFrame:
    """The table ``name`` of a folder, be it one file or a folder of part files.

    The pattern of a stream is held against the names of files only, so a table that is a folder would match none.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{name}")
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
        return file_stream(spark, f"{folder.rstrip('/')}/{name}", "*", schema, files_per_batch)
    return file_stream(spark, folder, name, schema, files_per_batch)


def _run(writer: DataStreamWriter, path: str) -> None:
    query = writer.option("checkpointLocation", f"{path}/_state").trigger(availableNow=True).start()
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()


def run_to_table(stream: DataFrame, path: str) -> DataFrame:
    """Append mode into a parquet table; exactly once through the sink's own log."""
    spark = stream.sparkSession
    with _rocksdb_state(spark):
        _run(stream.writeStream.format("parquet").outputMode("append").option("path", f"{path}/rows"), path)
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")


def run_complete(aggregate: DataFrame, path: str) -> DataFrame:
    """Complete mode: every batch overwrites the small table of current totals."""
    spark = aggregate.sparkSession

    def overwrite(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows")

    with _rocksdb_state(spark):
        _run(aggregate.writeStream.outputMode("complete").foreachBatch(overwrite), path)
    written = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/rows")
    if not written.getFileSystem(spark._jsc.hadoopConfiguration()).exists(written):
        # a stream without files runs no batch
        return spark.createDataFrame([], aggregate.schema)
    return spark.read.schema(aggregate.schema).parquet(f"{path}/rows")


def stream_dedup(stream: DataFrame, text: str = "text") -> DataFrame:
    """First arrival of every distinct normalised text, keyed by its digest.

    The state holds one digest per distinct text for as long as the stream lives, and never the
    text itself; a copy is found however late it comes.
    """
    keyed = stream.withColumn("text_md5", F.md5(squash_spaces(F.col(text)).cast("binary")))
    return keyed.filter(F.length(F.trim(F.col(text))) > 0).dropDuplicates(["text_md5"])


def stream_label_counts(stream: DataFrame, by: list[str]) -> DataFrame:
    """Running counts per metadata value; map-side partial sums meet in the state store."""
    return stream.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def stream_score(stream: DataFrame, score: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Stateless scoring: features and scorer are plain expressions or a fitted model."""
    return score(stream)


def scratch_run(stream: DataFrame, name: str, complete: bool = False) -> DataFrame:
    path = scratch_path(stream.sparkSession, name)
    return run_complete(stream, path) if complete else run_to_table(stream, path)
