"""Session helpers: shared scratch space, lineage cuts and size-checked broadcasts."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows, and bytes of their values, that a broadcast side may hold; both are checked first.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20


def local_session(cpus: int | str = "*", app: str = "inkmark") -> SparkSession:
    """A local session for tests and the benchmark; clusters bring their own."""
    parallel = str(os.cpu_count() if cpus == "*" else cpus)
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", parallel)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a temp folder only where none is set."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if current is None:
        if configured is None and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a shared folder before running on a cluster")
        context.setCheckpointDir(configured or tempfile.mkdtemp(prefix="inkmark-"))
        current = context.getCheckpointDir()
    return configured or current


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/inkmark/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the result survives lost executors and is not computed again."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """The table written below the shared folder and read back; later jobs read only the columns they use."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def hold(df: DataFrame) -> DataFrame:
    """Keep a table that several actions read; lost blocks are recomputed from lineage."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def broadcast_checked(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast only after counting rows and bytes.

    Larger tables keep the shuffled join, whose hot partitions Spark splits at run time (AQE). The choice changes the
    plan only, never the result.
    """
    wide = [F.coalesce(F.octet_length(F.col(f.name).cast("string")), F.lit(0)) for f in df.schema.fields]
    size = df.limit(max_rows + 1).agg(F.count(F.lit(1)).alias("n"), F.sum(sum(wide, F.lit(16))).alias("b")).first()
    return F.broadcast(df) if size["n"] <= max_rows and (size["b"] or 0) <= max_bytes else df


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Repartition a plain scan only when it yields fewer splits than the cluster has slots.

    For scans only: asking a plan with shuffles for its partitions would already run them.
    Small inputs arrive as one parquet split and would run CPU-heavy text work in
    one task; a large table already has enough splits and is left alone.
    """
    slots = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= slots:
        return df
    return df.repartition(slots, *keys) if keys else df.repartition(slots)
