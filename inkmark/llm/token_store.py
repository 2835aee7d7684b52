"""Token-id output: raw id payloads in shards, found by key through a minimal perfect hash index.

Folder of a store:

* ``payload/shard-N.bin``: the ids of a range of documents in ascending key order, little-endian unsigned integers,
  each document closed by the end id; then the end position of every row (64 bits each) and their number.
* ``index/part-P.npz``: for the keys of hash part P a minimal perfect hash and, per slot, a fingerprint, the shard,
  the first row and the number of rows. A lookup costs a hash, a fingerprint check and one read.
* ``rows`` and ``manifest``: Parquet tables of the rows and of the shards, the latter with the ids before each shard.

Files appear under a temporary name and get the final one when they are complete; a task that runs again writes equal bytes.
"""

from __future__ import annotations

import io
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkmark.llm import perfect_hash
from inkmark.llm.arrow import as_array, blocks, commit_file, file_system, map_batches, pieces, table
from inkmark.llm.hashing import U
from inkmark.llm.ranges import key_shards, shard_count
from inkmark.llm.tokens import encoder, public_path
from inkmark.session import scratch_path

VOCABULARY = "word_bpe_49k.json"
END_ID = 1
# Bytes of text per shard, and keys per part of the index.
SHARD_BYTES = 64 << 20
PART_KEYS = 1 << 16
FLUSH_BYTES = 16 << 20


def _encoded(df: DataFrame, tokenizer: str, end_id: int, width: int) -> DataFrame:
    """(shard, key, text) to (shard, key, ids): the ids as raw bytes, the end id included."""

    def encode(batch):
        model, payload, sizes = encoder(tokenizer), [], []
        for block in blocks(batch.column(2)):
            ids, count = model.ids(block)
            if len(ids) and int(ids.max()) >= 1 << (8 * width):
                raise ValueError(f"id {int(ids.max())} needs more than {width} bytes")
            payload.append(np.insert(ids, np.cumsum(count), end_id).astype(f"<u{width}"))
            sizes.append(count + 1)
        offsets = np.concatenate(([0], np.cumsum(np.concatenate(sizes)) * width)).astype(np.int32)
        raw = pa.Array.from_buffers(
            pa.binary(), batch.num_rows, [None, pa.py_buffer(offsets), pa.py_buffer(np.concatenate(payload).tobytes())]
        )
        return {"shard": batch.column(0), "key": batch.column(1), "ids": raw}

    return map_batches(df, encode, "shard int, key bigint, ids binary")


class _Shard:
    """A payload file being written."""

    def __init__(self, folder: str, number: int):
        self.system, root = file_system(folder)
        self.system.create_dir(root, recursive=True)
        self.final = f"{root}/shard-{number:07d}.bin"
        self.temporary = f"{root}/.{uuid.uuid4().hex}.tmp"
        self.number = number
        self.stream = self.system.open_output_stream(self.temporary)
        self.ends: list[np.ndarray] = []
        self.rows = self.size = self.crc = 0

    def add(self, raw: bytes, sizes: np.ndarray) -> np.ndarray:
        """Append rows; their numbers in the shard come back."""
        self.stream.write(raw)
        self.crc = zlib.crc32(raw, self.crc)
        self.ends.append(self.size + np.cumsum(sizes))
        first, self.rows, self.size = self.rows, self.rows + len(sizes), self.size + len(raw)
        return np.arange(first, self.rows)

    def close(self) -> None:
        self.stream.write(np.concatenate(self.ends).astype("<u8").tobytes() + np.array([self.rows], dtype="<u8").tobytes())
        self.stream.close()
        commit_file(self.system, self.temporary, self.final)


def _write_payload(df: DataFrame, folder: str, width: int) -> DataFrame:
    """Write sorted (shard, key, ids) rows; one output row per document: key, shard, row, n."""
    schema = pa.schema([("key", pa.int64()), ("shard", pa.int32()), ("row", pa.int64()), ("n", pa.int64())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = None
        for batch in (piece for batch in batches for piece in pieces(batch)):
            numbers = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), len(numbers)]
            for low, high in zip(cuts, cuts[1:]):
                if shard is None or shard.number != numbers[low]:
                    if shard is not None:
                        shard.close()
                    shard = _Shard(folder, int(numbers[low]))
                values = batch.column(2).slice(low, high - low).to_pylist()
                sizes = np.fromiter(map(len, values), dtype=np.int64, count=len(values))
                rows = shard.add(b"".join(values), sizes)
                yield pa.RecordBatch.from_arrays(
                    [as_array(batch.column(1).slice(low, high - low), pa.int64())]
                    + [pa.array(x, type=t) for x, t in ((numbers[low:high], pa.int32()), (rows, pa.int64()), (sizes // width, pa.int64()))],
                    schema=schema,
                )
        if shard is not None:
            shard.close()

    return df.mapInArrow(write, "key bigint, shard int, row bigint, n bigint")


def _part(parts: int):
    return F.pmod(F.xxhash64("key"), F.lit(parts)).cast("int")


def _write_index(rows: DataFrame, folder: str, parts: int) -> DataFrame:
    """One perfect hash per part; a key's rows are neighbours, so a slot holds the first and their number."""
    keys = (
        rows.filter("key IS NOT NULL")
        .groupBy("key", "shard")
        .agg(F.min("row").alias("row"), F.count(F.lit(1)).alias("rows"))
        .withColumn("part", _part(parts))
    )
    keys = keys.repartition(shard_count(rows), "part").sortWithinPartitions("part", "key")

    def save(part: int, pieces: list[pa.RecordBatch]) -> pa.RecordBatch:
        data = {c: np.concatenate([p.column(c).to_numpy() for p in pieces]) for c in ("key", "shard", "row", "rows")}
        key = data.pop("key").view(U)
        function = perfect_hash.build(key)
        slot = perfect_hash.slots(function, key)
        arrays = {"fingerprint": perfect_hash.fingerprints(key), **data}
        for name, values in arrays.items():
            placed = np.empty_like(values)
            placed[slot] = values
            arrays[name] = placed
        out = io.BytesIO()
        np.savez(out, **function, **arrays)
        system, root = file_system(folder)
        system.create_dir(root, recursive=True)
        temporary = f"{root}/.{uuid.uuid4().hex}.tmp"
        with system.open_output_stream(temporary) as stream:
            stream.write(out.getvalue())
        commit_file(system, temporary, f"{root}/part-{part:07d}.npz")
        return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "keys": pa.array([len(key)], pa.int64())})

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_part, pieces = None, []
        for batch in batches:
            numbers = batch.column("part").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), len(numbers)]
            for low, high in zip(cuts, cuts[1:]):
                if low < high and numbers[low] != open_part:
                    if pieces:
                        yield save(open_part, pieces)
                    open_part, pieces = int(numbers[low]), []
                pieces.append(batch.slice(low, high - low))
        if open_part is not None:
            yield save(open_part, pieces)

    return keys.mapInArrow(write, "part int, keys bigint")


def write_store(
    df: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID,
    shard_bytes: int = SHARD_BYTES, part_keys: int = PART_KEYS, width: int = 2,
) -> None:
    """Encode every text and write a store.

    ``width`` is the number of bytes per id (2 holds vocabularies up to 65,536). Keys are integers; null keys come first,
    in shard 0; rows with one key stay together, ordered by their ids. A null text is empty and holds the end id only.
    Columns other than id and text are ignored. An empty table gives a store without files. Texts are shuffled once,
    as ids.
    """
    spark = df.sparkSession
    docs = df.select(F.col(id_col).cast("long").alias("key"), F.col(text_col).alias("text"))
    placed = key_shards(docs, "key", F.octet_length(F.coalesce("text", F.lit(""))) + 1, shard_bytes)
    encoded = _encoded(placed.select("shard", "key", "text"), tokenizer, end_id, width)
    by_shard = encoded.repartition(shard_count(df), "shard").sortWithinPartitions("shard", "key", "ids")
    _write_payload(by_shard, f"{path}/payload", width).write.parquet(f"{path}/rows")
    rows = spark.read.parquet(f"{path}/rows")
    # one row per shard: small, and needed as a whole for the running total
    shards = rows.groupBy("shard").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("n_tokens")).orderBy("shard").collect()
    total, manifest = 0, []
    for r in shards:
        manifest.append((r.shard, r.rows, r.n_tokens, total))
        total += r.n_tokens
    parts = max(1, -(-sum(r.rows for r in shards) // part_keys))
    _write_index(rows, f"{path}/index", parts).write.parquet(f"{path}/parts")
    schema = "shard int, rows bigint, n_tokens bigint, base bigint, parts int, width int"
    spark.createDataFrame([(*m, parts, width) for m in manifest], schema).coalesce(1).write.parquet(f"{path}/manifest")


def lookup(spark: SparkSession, path: str, keys: DataFrame) -> DataFrame:
    """Place of each key of a one-column table: key, shard, row, rows; unknown keys are left out."""
    first = spark.read.parquet(f"{path}/manifest").limit(1).collect()
    keys = keys.select(F.col(keys.columns[0]).cast("long").alias("key"))
    if not first:
        return keys.limit(0).selectExpr("key", "0 AS shard", "0L AS row", "0L AS rows")
    parts = first[0].parts
    nulls = spark.read.parquet(f"{path}/manifest").filter("shard = 0").collect()
    schema = pa.schema([("key", pa.int64()), ("shard", pa.int32()), ("row", pa.int64()), ("rows", pa.int64())])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = file_system(f"{path}/index")
        loaded, arrays = None, {}
        for batch in batches:
            numbers = batch.column(1).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), len(numbers)]
            for low, high in zip(cuts, cuts[1:]):
                if low == high:
                    continue
                if numbers[low] != loaded:
                    loaded, name = int(numbers[low]), f"{root}/part-{int(numbers[low]):07d}.npz"
                    arrays = {}
                    if system.get_file_info(name).is_file:
                        with system.open_input_file(name) as file:
                            with np.load(io.BytesIO(file.read())) as saved:
                                arrays = dict(saved)
                if not arrays:
                    continue
                key = batch.column(0).slice(low, high - low).to_numpy().view(U)
                slot = perfect_hash.slots(arrays, key)
                known = (slot >= 0) & (arrays["fingerprint"][slot] == perfect_hash.fingerprints(key))
                slot = slot[known]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key[known].view(np.int64))] + [pa.array(arrays[c][slot], type=schema.field(c).type) for c in ("shard", "row", "rows")],
                    schema=schema,
                )

    found = (
        keys.filter("key IS NOT NULL").withColumn("part", _part(parts))
        .repartition(shard_count(keys), "part").sortWithinPartitions("part")
        .mapInArrow(find, "key bigint, shard int, row bigint, rows bigint")
    )
    if not nulls:
        return found
    return found.unionByName(keys.filter("key IS NULL").selectExpr("key", "0 AS shard", "0L AS row", f"{nulls[0].rows}L AS rows"))


def read_rows(spark: SparkSession, path: str, places: DataFrame, keep_ids: bool = True) -> DataFrame:
    """The ids behind looked-up places: key, start (ids before the row in the whole store), ids (raw bytes; null unless
    kept), n_tokens, ids_crc32."""
    manifest = spark.read.parquet(f"{path}/manifest")
    width = (manifest.limit(1).collect() or [None])[0]
    width = width.width if width else 2
    schema = pa.schema([("key", pa.int64()), ("shard", pa.int32()), ("place", pa.int64()), ("ids", pa.binary()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = file_system(f"{path}/payload")
        number, file, ends = None, None, np.zeros(0, dtype=np.int64)
        for batch in batches:
            out, held = [], 0
            for key, shard, row, rows in zip(*(batch.column(c).to_pylist() for c in range(4))):
                if shard != number:
                    if file is not None:
                        file.close()
                    number, file = shard, system.open_input_file(f"{root}/shard-{shard:07d}.bin")
                    size = file.size()
                    count = int(np.frombuffer(file.read_at(8, size - 8), dtype="<u8")[0])
                    ends = np.concatenate(([0], np.frombuffer(file.read_at(8 * count, size - 8 - 8 * count), dtype="<u8").astype(np.int64)))
                for r in range(row, row + rows):
                    raw = file.read_at(int(ends[r + 1] - ends[r]), int(ends[r]))
                    ids = np.frombuffer(raw, dtype=f"<u{width}")
                    checksum = zlib.crc32(ids.astype("<u4").tobytes())
                    out.append((key, shard, int(ends[r]) // width, raw if keep_ids else None, len(ids), checksum))
                    held += len(raw) if keep_ids else 64
                    if held > FLUSH_BYTES:
                        yield batch_of(out)
                        out, held = [], 0
            if out:
                yield batch_of(out)
        if file is not None:
            file.close()

    by_shard = places.select("key", "shard", "row", "rows").repartition(shard_count(places), "shard").sortWithinPartitions("shard", "row")
    rows = by_shard.mapInArrow(read, "key bigint, shard int, place bigint, ids binary, n_tokens bigint, ids_crc32 bigint")
    # the manifest has one short row per shard; Spark broadcasts it while it is small
    joined = rows.join(manifest.select("shard", "base"), "shard")
    return joined.select("key", (F.col("base") + F.col("place")).alias("start"), "ids", "n_tokens", "ids_crc32")


def op1_token_ids(spark, sf_dir):
    """All documents written as token ids, then read back by key through the index."""
    docs = table(spark, sf_dir, "documents")
    path = scratch_path(spark, "token-ids")
    write_store(docs, path, public_path(VOCABULARY))
    rows = read_rows(spark, path, lookup(spark, path, docs.select("doc_id").distinct()), keep_ids=False)
    return rows.select(F.col("key").alias("doc_id"), "start", "n_tokens", "ids_crc32")
