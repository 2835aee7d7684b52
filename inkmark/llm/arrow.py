"""Arrow helpers shared by the operators: text columns as byte blocks, files in shared folders, samples, tables.

Spark bounds an Arrow batch by bytes (``spark.sql.execution.arrow.maxBytesPerBatch``); the pieces and blocks below
bound the working memory inside a batch as well: a kernel needs a small multiple of ``BLOCK_BYTES`` or of one text.
"""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkmark.session import scratch_path

BLOCK_BYTES = 2 << 20
PIECE_BYTES = 8 << 20


class Block:
    """Consecutive texts joined by line feeds; null texts are empty."""

    def __init__(self, texts: list[bytes], first: int):
        self.texts = texts
        self.first = first
        self.sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        self.ends = np.cumsum(self.sizes + 1) - 1
        self.starts = self.ends - self.sizes
        self.data = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)

    def sums(self, weights: np.ndarray) -> np.ndarray:
        """Sum per text of a small weight per byte."""
        total = np.zeros(len(weights) + 1, dtype=np.int64)
        np.cumsum(weights, out=total[1:])
        return total[self.ends] - total[self.starts]

    def counts(self, positions: np.ndarray) -> np.ndarray:
        """Bounds per text in a sorted array of byte positions, as one array of len + 1 offsets."""
        return np.searchsorted(positions, np.append(self.starts, len(self.data)))


def texts_of(column) -> list[bytes]:
    """UTF-8 bytes per row; null becomes empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return [value or b"" for value in column.cast(pa.large_binary()).to_pylist()]


def blocks(column, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """The column's texts in blocks of at most ``limit`` bytes; a longer text is a block of its own."""
    part: list[bytes] = []
    first = size = 0
    for i, text in enumerate(texts_of(column)):
        if part and size + len(text) > limit:
            yield Block(part, first)
            part, size, first = [], 0, i
        part.append(text)
        size += len(text)
    if part:
        yield Block(part, first)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends, and lost executors cost nothing."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def map_batches(df: DataFrame, function: Callable[[pa.RecordBatch], dict], schema: str) -> DataFrame:
    """Apply a function of one record batch, which returns the output columns, to every batch."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                columns = function(piece)
                yield pa.RecordBatch.from_arrays([as_array(columns[f.name], f.type) for f in arrow], schema=arrow)
            # what a kernel freed would else stay with the worker beside the next batch
            give_back()

    return df.mapInArrow(run, schema)


def give_back() -> None:
    """Return freed memory to the system after a batch, since Spark keeps its Python workers."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def pieces(batch: pa.RecordBatch, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about ``limit`` bytes, so that copies made of a slice stay small."""
    rows = max(1, int(batch.num_rows * limit / max(batch.nbytes, 1)))
    for first in range(0, batch.num_rows, rows):
        yield batch.slice(first, rows)


def as_array(values, kind: pa.DataType) -> pa.Array:
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    return values.cast(kind) if isinstance(values, pa.Array) else pa.array(values, type=kind)


def row_hash(*columns: str | Column, seed: int = 0) -> Column:
    """A stable hash of a row in [0, 1)."""
    return F.pmod(F.xxhash64(F.lit(seed), *columns), F.lit(1 << 32)) / F.lit(float(1 << 32))


def bounded_sample(df: DataFrame, rows: int, keys: list[str], seed: int) -> DataFrame:
    """At most ``rows`` rows with the smallest hashes of ``keys``: the same rows on every run and cluster."""
    total = df.count()
    share = min(1.0, 1.3 * rows / max(total, 1) + 20.0 / max(total, 1))
    order = row_hash(*keys, seed=seed)
    picked = df.filter(order < share) if share < 1 else df
    return picked.orderBy(order, *keys).limit(rows)


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int, seed: int) -> DataFrame:
    """Documents of at most ``rows`` labelled ids; the ids are few by this bound and are broadcast."""
    picked = bounded_sample(labels, rows, ["doc_id"], seed)
    return docs.join(F.broadcast(picked), "doc_id")


def crc_mod(column: str, modulus: int) -> Column:
    """crc32 of the id's text, modulo a small number; a missing id counts as 0."""
    return F.coalesce(F.pmod(F.crc32(F.encode(F.col(column).cast("string"), "UTF-8")), F.lit(modulus)), F.lit(0))


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    """Arrow's file system and path of a folder; plain paths are local."""
    if uri.startswith("file:"):
        uri = "/" + uri[5:].lstrip("/")
    return (fs.LocalFileSystem(), uri) if uri.startswith("/") else fs.FileSystem.from_uri(uri)


def commit_file(system: fs.FileSystem, temporary: str, final: str) -> None:
    """Give a finished file its final name; a repeated task replaces it by equal bytes."""
    system.move(temporary, final)
