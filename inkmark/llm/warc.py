"""WARC archives: a deterministic sharded writer and its reader.

Records are sorted by page id into ranges of about equal size (exact histogram, no sampling), a file is rolled when its
compressed size passes a limit, headers and digests are made anew from the payload, and a file gets its name when it is
complete. The manifest, a Parquet table written after all files, lists what belongs to the archive; other files are left
over from lost tasks. Equal input gives equal bytes on any cluster.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkmark.llm.arrow import commit_file, file_system, table
from inkmark.llm.ranges import key_shards, shard_count
from inkmark.session import scratch_path

# Payload bytes per range, compressed bytes at which a file is rolled, and the date that records bear.
RANGE_BYTES = 64 << 20
ROLL_BYTES = 16 << 20
DATE = "2026-01-01T00:00:00Z"
READ_BYTES = 1 << 20


def digest_of(payload: bytes) -> str:
    """Upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _urn(page) -> str:
    return f"<urn:page:{'null' if page is None else page}>"


def _record(page, url: str | None, payload: bytes, first, is_revisit: bool, date: str) -> bytes:
    """One WARC/1.1 record; a revisit keeps the HTTP header, whose length is that of the full payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if is_revisit else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if is_revisit else 'response'}",
        f"WARC-Record-ID: {_urn(page)}",
        f"WARC-Date: {date}",
        "WARC-Target-URI: " + re.sub(r"[\r\n]+", " ", url or "urn:unknown"),
        "Content-Type: application/http;msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest_of(payload)}",
        f"WARC-Block-Digest: sha1:{digest_of(block)}",
    ]
    if is_revisit:
        lines += [f"WARC-Refers-To: {_urn(first)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += [f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


class _Files:
    """The rolling files of one range."""

    def __init__(self, folder: str, shard: int, roll: int):
        self.system, self.root = file_system(folder)
        self.system.create_dir(self.root, recursive=True)
        self.shard, self.roll, self.number, self.stream, self.done = shard, roll, 0, None, []

    def add(self, record: bytes) -> None:
        if self.stream is None:
            self.temporary = f"{self.root}/.{uuid.uuid4().hex}.tmp"
            self.stream, self.size, self.records = self.system.open_output_stream(self.temporary), 0, 0
        packer = zlib.compressobj(6, zlib.DEFLATED, 31)
        member = packer.compress(record) + packer.flush()
        self.stream.write(member)
        self.size += len(member)
        self.records += 1
        if self.size >= self.roll:
            self.close()

    def close(self) -> None:
        if self.stream is not None:
            self.stream.close()
            name = f"part-{self.shard:07d}-{self.number:05d}.warc.gz"
            commit_file(self.system, self.temporary, f"{self.root}/{name}")
            self.done.append((name, self.records, self.size))
            self.number, self.stream = self.number + 1, None


def _write_files(rows: DataFrame, folder: str, roll: int, date: str) -> DataFrame:
    schema = pa.schema([("file", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, key, first = None, None, None
        for batch in batches:
            html = batch.column("payload").cast(pa.binary())
            columns = [batch.column(c).to_pylist() for c in ("shard", "page_id", "sha", "is_page", "url", "first")]
            for i, (shard, page, sha, is_page, url, refers) in enumerate(zip(*columns)):
                if not is_page:  # the note that the pages after it, of this id and payload, are copies
                    key, first = (shard, page, sha), refers
                    continue
                if files is None or files.shard != shard:
                    if files is not None:
                        files.close()
                        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, d)) for d in files.done], schema=schema)
                    files = _Files(folder, shard, roll)
                files.add(_record(page, url, html[i].as_py() or b"", first, key == (shard, page, sha), date))
        if files is not None:
            files.close()
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, d)) for d in files.done], schema=schema)

    return rows.mapInArrow(write, "file string, records bigint, bytes bigint")


def write_warc(
    pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
    min_bytes: int = 0, range_bytes: int = RANGE_BYTES, roll_bytes: int = ROLL_BYTES, date: str = DATE,
) -> DataFrame:
    """Write one record per row and return the manifest (file, records, bytes).

    Of records with equal payloads of at least ``min_bytes`` the one with the largest id is the response and the others
    are revisits of it; rows repeated with one id and payload are all responses if that id is the largest. A row without
    id sorts first and is a revisit if any row with an id has its payload. A null payload is empty, a null address is
    ``urn:unknown``, other columns are ignored, an empty table gives an empty manifest. Payloads are shuffled once; the
    search for copies moves ids and digests only, and is pre-aggregated by digest.
    """
    records = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"),
        F.coalesce(F.col(payload_col), F.lit("")).alias("payload"),
    ).withColumn("sha", F.sha1(F.col("payload").cast("binary")))
    narrow = records.filter(F.octet_length("payload") >= min_bytes).select("page_id", "sha")
    best = narrow.groupBy("sha").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("copies"))
    notes = (
        narrow.join(best.filter("copies > 1 AND first IS NOT NULL"), "sha")
        .filter("page_id IS NULL OR page_id < first")
        .select("page_id", "sha", "first").distinct()
    )
    rows = records.withColumn("is_page", F.lit(True)).unionByName(
        notes.withColumn("is_page", F.lit(False)), allowMissingColumns=True
    )
    placed = key_shards(rows, "page_id", F.coalesce(F.octet_length("payload"), F.lit(0)) + 1, range_bytes)
    ordered = placed.repartition(shard_count(pages), "shard").sortWithinPartitions("shard", "page_id", "sha", "is_page", "url")
    _write_files(ordered, f"{path}/files", roll_bytes, date).write.parquet(f"{path}/manifest")
    return pages.sparkSession.read.parquet(f"{path}/manifest")


def _members(stream) -> Iterator[bytes]:
    """Uncompressed gzip members of a stream, one after another."""
    pending = b""
    while True:
        unpacker, parts = zlib.decompressobj(31), []
        while not unpacker.eof:
            pending = pending or stream.read(READ_BYTES)
            if not pending:
                if parts:
                    raise ValueError("a WARC file ends inside a record")
                return
            parts.append(unpacker.decompress(pending))
            pending = unpacker.unused_data
        yield b"".join(parts)


def parse_record(raw: bytes) -> dict:
    """Fields of a record whose digests were verified."""
    head, block = raw.split(b"\r\n\r\n", 1)
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = block[: int(fields["Content-Length"])]
    http, payload = block.split(b"\r\n\r\n", 1)
    number = lambda urn: None if urn is None or urn == "<urn:page:null>" else int(urn[len("<urn:page:") : -1])
    is_revisit = fields["WARC-Type"] == "revisit"
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Block-Digest"] != f"sha1:{digest_of(block)}" or not (is_revisit or digest == digest_of(payload)):
        raise ValueError(f"digest mismatch in {fields['WARC-Record-ID']}")
    return {
        "page_id": number(fields["WARC-Record-ID"]),
        "url": fields["WARC-Target-URI"],
        "payload_bytes": int(re.search(rb"Content-Length: (\d+)", http)[1]),
        "payload_digest": digest,
        "record_type": fields["WARC-Type"],
        "refers_to": number(fields.get("WARC-Refers-To")),
        "payload": None if is_revisit else payload,
    }


def read_warc(spark: SparkSession, path: str, keep_payload: bool = True) -> DataFrame:
    """One row per record of the files in the manifest; digests are checked. Tasks take whole files."""
    kinds = {"page_id": pa.int64(), "url": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "payload": pa.binary(), "file": pa.string()}
    schema = pa.schema(list(kinds.items()))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = file_system(f"{path}/files")
        for batch in batches:
            for name in batch.column(0).to_pylist():
                out, held = [], 0
                with system.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    for raw in _members(stream):
                        record = parse_record(raw) | {"file": name}
                        if not keep_payload:
                            record["payload"] = None
                        out.append(record)
                        held += 500 + len(record["payload"] or b"")
                        if held > READ_BYTES * 16:
                            yield pa.RecordBatch.from_pylist(out, schema=schema)
                            out, held = [], 0
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema=schema)

    files = spark.read.parquet(f"{path}/manifest").select("file")
    return files.repartition(shard_count(files), "file").mapInArrow(
        read,
        "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload binary, file string",
    )


def op2_warc(spark, sf_dir):
    """All pages written as WARC records, then read back from the archives."""
    path = scratch_path(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), path)
    return read_warc(spark, path, keep_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


# Five hexadecimal digits are four characters of base32.
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
OP2_SQL = f"""WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT *, array_to_string(list_transform(range(32), lambda i:
  '{_BASE32}'[1 + ((CAST('0x' || h[(i // 4) * 5 + 1:(i // 4) * 5 + 5] AS BIGINT) >> (15 - 5 * (i % 4))) & 31)]), '') AS digest,
  max(page_id) OVER (PARTITION BY h) AS largest FROM p)
SELECT page_id, octet_length(encode(html)) AS payload_bytes, digest AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM largest THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM largest THEN largest END AS refers_to FROM d"""
