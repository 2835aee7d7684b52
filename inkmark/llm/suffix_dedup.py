"""Removal of repeated byte strings by a sparse suffix array over all texts.

Every window of ``length`` bytes has an anchor: the place of the least 16-byte gram (by hash) among those that start in its
first half. Equal windows have their anchor at the same distance, so only suffixes that start at anchors, some 1 % of all,
need be sorted. The windows of one anchor are a run; they all hold its core, the bytes from the anchor that none can miss.

1. Cores that occur once have no repeated window. A bit map of fixed size over the others says which anchors go on.
2. Anchors with equal runs of windows (the whole bytes that these cover) form classes; those of two and more are repeated.
3. What is left are runs whose core is repeated but which are not: at the ends of repeated passages. Their suffixes, and one
   of each class with such a core, are range-partitioned by their leading bytes with sampled splitters. Each bucket sorts its
   suffixes, and the bytes before the anchors, by multikey quicksort and compares neighbours: a window is repeated where both
   its part from the anchor on and its part before it are shared with another one.
4. Runs of suffixes that reach the ends of a bucket are compared across the boundaries: first by the bytes that some
   windows in a row have in common, and where two buckets hold the same ones, by the windows.

Splitters may fall inside a group of equal suffixes, so no group has to fit one bucket.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkmark.llm.arrow import map_batches, stored, table
from inkmark.llm.bitmaps import bitmap, is_set
from inkmark.llm.hashing import U, mix
from inkmark.llm.joins import looked_up

LENGTH = 400
BITS = 1 << 25
# Bytes of text taken at once; a longer text is taken in pieces whose windows do not overlap.
BLOCK_BYTES = 1 << 20
# Bytes of suffixes in a bucket, about.
BUCKET_BYTES = 32 << 20
# Suffixes that a task remembers to have sent, so that copies of a text are sent once.
SENT = 500_000
# Windows in a row that are compared across boundaries by what they have in common, before each by itself.
STEP = 16

_POSITION = U((1 << 22) - 1)
_GRAM = 16


class Anchors:
    """The anchors of some texts: text number, start of the first window, bytes before the anchor, number of windows."""

    def __init__(self, data: bytes, begins: np.ndarray, ends: np.ndarray, length: int):
        self.data, self.length, self.spread = data, length, length // 2
        self.core = length - self.spread + 1
        gram = min(_GRAM, 1 << max(0, (length // 4).bit_length() - 1))
        raw = np.frombuffer(data, dtype=np.uint8)
        self.first = self.lead = self.count = np.zeros(0, dtype=np.int64)
        if len(raw) < length:
            return
        hashes = mix(raw.astype(U) + U(1))
        size = 1
        while size < gram:
            hashes = mix(hashes[:-size] * U(0x9E3779B97F4A7C15) + hashes[size:])
            size *= 2
        keys = (hashes & ~_POSITION) | np.arange(len(hashes), dtype=U)
        least = self._least(keys) & _POSITION
        windows = np.zeros(len(raw) + 1, dtype=np.int8)
        some = ends - begins >= length
        np.add.at(windows, begins[some], 1)
        np.add.at(windows, ends[some] - length + 1, -1)
        starts = np.flatnonzero(np.cumsum(windows[:-1], dtype=np.int8))
        at = least[starts].astype(np.int64)
        heads = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1))))[: len(starts)]
        self.first, self.lead = starts[heads], at[heads] - starts[heads]
        self.count = np.diff(np.append(heads, len(starts)))

    def _least(self, keys: np.ndarray) -> np.ndarray:
        """The least of every ``spread`` consecutive keys, from minima towards both ends of blocks."""
        width = self.spread
        padded = np.full((len(keys) // width + 2) * width, np.iinfo(np.uint64).max, dtype=U)
        padded[: len(keys)] = keys
        rows = padded.reshape(-1, width)
        left = np.minimum.accumulate(rows, axis=1).ravel()
        right = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        return np.minimum(right[: len(padded) - width + 1], left[width - 1 :])

    def cores(self) -> np.ndarray:
        at = (self.first + self.lead).tolist()
        return _digests(self.data[p : p + self.core] for p in at)

    def runs(self, chosen: np.ndarray) -> np.ndarray:
        """Hashes of all bytes that the windows of the chosen anchors cover, and of the anchor's place in them."""
        rows = zip(self.first[chosen].tolist(), self.lead[chosen].tolist(), self.count[chosen].tolist())
        return _digests(self.data[f : f + n - 1 + self.length] + lead.to_bytes(4, "little") for f, lead, n in rows)


def _digests(parts) -> np.ndarray:
    return np.frombuffer(b"".join(hashlib.blake2b(p, digest_size=8).digest() for p in parts), dtype=U)


def _parts(texts: list[bytes], length: int) -> Iterator[tuple[Anchors, np.ndarray, np.ndarray, np.ndarray]]:
    """Anchors of consecutive texts, with the places of the texts, their numbers and the offsets at which they were cut."""
    rows, size = [], 0

    def made(rows):
        data = b"".join(r[2] for r in rows)
        sizes = np.array([len(r[2]) for r in rows], dtype=np.int64)
        ends = np.cumsum(sizes)
        return Anchors(data, ends - sizes, ends, length), ends - sizes, np.array([r[0] for r in rows]), np.array([r[1] for r in rows])

    for number, text in enumerate(texts):
        if len(text) < length:
            continue
        for offset in range(0, len(text) - length + 1, BLOCK_BYTES):
            piece = text[offset : offset + BLOCK_BYTES + length - 1]
            if rows and size + len(piece) > BLOCK_BYTES:
                yield made(rows)
                rows, size = [], 0
            rows.append((number, offset, piece))
            size += len(piece)
    if rows:
        yield made(rows)


def _bytes_of(column: pa.Array) -> list[bytes]:
    return [t or b"" for t in column.to_pylist()]


def _signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def _places(keys: list[bytes], text: np.ndarray, start: np.ndarray) -> np.ndarray:
    """A 64-bit name of a window's place: its text's key and where it starts."""
    own = np.frombuffer(b"".join(k[:8] for k in keys), dtype=U)
    return mix(own[text] + mix(start.astype(U)))


def _cores(texts: DataFrame, length: int) -> DataFrame:
    def run(batch):
        found = [a.cores() for a, *_ in _parts(_bytes_of(batch.column(0)), length)]
        return {"core": _signed(np.concatenate([np.zeros(0, dtype=U), *found]))}

    return map_batches(texts.select("text"), run, "core bigint")


def _members(texts: DataFrame, bits: np.ndarray, length: int) -> DataFrame:
    """(core, run, key, start, windows, place) of the anchors whose core may be repeated."""

    def run(batch):
        rows, keys = _bytes_of(batch.column(0)), batch.column(1).to_pylist()
        out = {name: [] for name in ("core", "run", "key", "start", "windows", "place")}
        for a, begins, number, offset in _parts(rows, length):
            core = a.cores()
            chosen = np.flatnonzero(is_set(bits, core))
            piece = np.searchsorted(begins, a.first[chosen], "right") - 1
            start = a.first[chosen] - begins[piece] + offset[piece]
            out["core"].append(_signed(core[chosen]))
            out["run"].append(_signed(a.runs(chosen)))
            out["key"] += [keys[i] for i in number[piece].tolist()]
            out["start"].append(start)
            out["windows"].append(a.count[chosen])
            out["place"].append(_signed(_places(keys, number[piece], start)))
        none = np.zeros(0, dtype=np.int64)
        return {n: v if n == "key" else np.concatenate([none, *v]) for n, v in out.items()}

    return map_batches(texts, run, "core bigint, run bigint, key binary, start bigint, windows bigint, place bigint")


def _suffixes(texts: DataFrame, bits: np.ndarray, length: int) -> DataFrame:
    """(suffix, before, key, start, windows): bytes from the anchor on and, backwards, those before it, of the wanted anchors."""

    def run(batches):
        sent: set[int] = set()
        for batch in batches:
            rows, keys = _bytes_of(batch.column(0)), batch.column(1).to_pylist()
            out = []
            for a, begins, number, offset in _parts(rows, length):
                piece = np.searchsorted(begins, a.first, "right") - 1
                start = a.first - begins[piece] + offset[piece]
                place = _places(keys, number[piece], start)
                for i in np.flatnonzero(is_set(bits, place)).tolist():
                    if int(place[i]) in sent:
                        continue
                    if len(sent) >= SENT:
                        sent.clear()
                    sent.add(int(place[i]))
                    f, lead, n = int(a.first[i]), int(a.lead[i]), int(a.count[i])
                    out.append((a.data[f + lead : f + n - 1 + length], a.data[f : f + lead][::-1], keys[number[piece[i]]], int(start[i]), n))
            kinds = (pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64())
            columns = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["suffix", "before", "key", "start", "windows"])

    return texts.mapInArrow(run, "suffix binary, before binary, key binary, start bigint, windows bigint")


def multikey_sort(strings: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the strings, and how many bytes each has in common with the one before it (0 for the first).

    A multikey quicksort, all ties at once: at every depth the strings that are still equal are told apart by their next
    eight bytes; those that differ there are done.
    """
    sizes = np.array([len(s) for s in strings], dtype=np.int64)
    width = -(-max(width, 1) // 8) * 8
    data = np.frombuffer(b"".join(s.ljust(width, b"\0") for s in strings), dtype=np.uint8).reshape(len(strings), width)
    words = data.view(">u8")
    order = np.arange(len(strings))
    head = np.zeros(len(strings), dtype=bool)
    head[:1] = True
    for depth in range(words.shape[1]):
        tied = ~head
        tied[:-1] |= ~head[1:]
        at = np.flatnonzero(tied)
        if len(at) == 0:
            break
        group = np.cumsum(head)[at]
        word = words[order[at], depth].astype(U)
        by = np.lexsort((word, group))
        order[at] = order[at][by]
        word, group = word[by], group[by]
        head[at[1:]] |= (word[1:] != word[:-1]) | (group[1:] != group[:-1])
    shared = np.zeros(len(strings), dtype=np.int64)
    for a in range(1, len(strings), 4096):
        b = min(a + 4096, len(strings))
        differ = data[order[a:b]] != data[order[a - 1 : b - 1]]
        same = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
        shared[a:b] = np.minimum(same, np.minimum(sizes[order[a:b]], sizes[order[a - 1 : b - 1]]))
    return order, shared


def compare_bucket(
    suffixes: list[bytes], before: list[bytes], windows: np.ndarray, length: int, below: bool, above: bool
) -> tuple[np.ndarray, np.ndarray]:
    """Per suffix and window: is it repeated within the bucket, and may it be so beyond (its equals reach an end with a neighbour)?"""
    spread = length // 2
    lead = np.array([len(b) for b in before], dtype=np.int64)
    order, shared = multikey_sort(suffixes, length)
    order_before, shared_before = multikey_sort(before, spread)
    repeated = np.zeros((len(suffixes), spread), dtype=bool)
    beyond = np.zeros((len(suffixes), spread), dtype=bool)
    group, group_before = np.empty(len(suffixes), dtype=np.int64), np.empty(len(suffixes), dtype=np.int64)
    for back in range(spread):  # windows that start so many bytes before their anchors
        own = np.flatnonzero((lead >= back) & (lead - windows < back))
        if len(own) == 0:
            continue
        group[order] = np.cumsum(shared < length - back)
        group_before[order_before] = np.cumsum(shared_before < back) if back else 0
        _, inverse, n = np.unique(group[own] * (len(suffixes) + 1) + group_before[own], return_inverse=True, return_counts=True)
        column = lead[own] - back
        repeated[own, column] = n[inverse] > 1
        ends = group[own]
        beyond[own, column] = (below & (ends == group[order[0]])) | (above & (ends == group[order[-1]]))
    return repeated, beyond


def _compared(suffixes: DataFrame, length: int) -> DataFrame:
    """(key, start, windows, digest, fine, bucket): repeated runs of windows without digest, and with it those for the boundaries.

    A row for the boundaries stands for up to ``STEP`` windows of a suffix that may be repeated beyond the bucket: ``digest``
    is that of the bytes which they have in common, ``fine`` has per window its place from ``start`` on (a byte) and its own
    digest. Windows that are repeated within the bucket come once per bucket and without key, only to be met. Every bucket
    takes it that another one follows, since Spark may make more or fewer than asked for.
    """

    def run(batches):
        # copies of a text send a suffix once per task; equal rows lie in one bucket, and one of them stands for all, since
        # windows of a text that occurs twice are known to be repeated
        seen: set[tuple[bytes, int]] = set()
        columns: list[list] = [[], [], [], [], []]
        for batch in batches:
            place = list(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()))
            new = [i for i, p in enumerate(place) if p not in seen and not seen.add(p)]
            for i in range(5):
                columns[i] += batch.column(i).take(pa.array(new, pa.int32())).to_pylist()
        suffix, before, keys, start, windows = columns
        out = []
        if suffix:
            bucket = TaskContext.get().partitionId()
            repeated, beyond = compare_bucket(suffix, before, np.array(windows), length, bucket > 0, True)
            for i in np.flatnonzero(repeated.any(axis=1)).tolist():
                edge = np.flatnonzero(np.diff(np.concatenate(([False], repeated[i], [False])).astype(np.int8)))
                out += [(keys[i], start[i] + a, b - a, None, None, bucket) for a, b in zip(edge[0::2].tolist(), edge[1::2].tolist())]
            told = set()
            for i in np.flatnonzero(beyond.any(axis=1)).tolist():
                whole, lead = before[i][::-1] + suffix[i], len(before[i])
                steps: dict[int, list[int]] = {}
                for t in np.flatnonzero(beyond[i]).tolist():
                    steps.setdefault((lead - t) // STEP, []).append(t)
                for step, own in steps.items():
                    least, most = step * STEP, min(step * STEP + STEP, length // 2) - 1
                    # what all windows that start least to most bytes before the anchor have in common
                    common = step.to_bytes(4, "little") + whole[lead - least : lead + length - most]
                    new, again = [], []
                    for t in own:
                        digest = hashlib.blake2b(whole[t : t + length], digest_size=16).digest()
                        if not repeated[i, t]:
                            new.append(bytes([t - own[0]]) + digest)
                        elif digest not in told:
                            told.add(digest)
                            again.append(bytes([t - own[0]]) + digest)
                    digest = hashlib.blake2b(common, digest_size=16).digest()
                    if new:
                        out.append((keys[i], start[i] + own[0], len(new), digest, b"".join(new), bucket))
                    if again:
                        out.append((None, 0, len(again), digest, b"".join(again), bucket))
        kinds = (pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int32())
        names = ["key", "start", "windows", "digest", "fine", "bucket"]
        for a in range(0, max(len(out), 1), 20_000):
            part = list(zip(*out[a : a + 20_000])) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(part, kinds)], names=names)

    return suffixes.mapInArrow(run, "key binary, start bigint, windows bigint, digest binary, fine binary, bucket int")


def _across(compared: DataFrame) -> DataFrame:
    """(key, start, windows): single windows that are repeated in other buckets."""
    coarse = compared.filter("digest IS NOT NULL")
    met = coarse.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min("bucket").alias("least"), F.max("bucket").alias("most"))
    met = met.filter("least < most").select("digest", "n")
    live = looked_up(coarse, met, ["digest"], "n").filter("n IS NOT NULL").select("key", "start", "fine")

    def run(batch):
        out = {name: [] for name in ("key", "start", "digest")}
        for key, start, fine in zip(*(c.to_pylist() for c in batch.columns)):
            for at in range(0, len(fine), 17):
                out["key"].append(key)
                out["start"].append(start + fine[at])
                out["digest"].append(fine[at + 1 : at + 17])
        return out

    edges = stored(map_batches(live, run, "key binary, start bigint, digest binary"), "edges")
    # a digest comes at most once per bucket and text place, so no group of it is large
    meeting = edges.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    across = looked_up(edges.filter("key IS NOT NULL"), meeting, ["digest"], "n").filter("n IS NOT NULL")
    return across.select("key", "start", F.lit(1).cast("long").alias("windows"))


def _cleaned(spans: DataFrame, texts: DataFrame, length: int, with_text: bool) -> DataFrame:
    """key, n_removed, n_spans, kept_sha256 (and the kept bytes) of the texts with repeated windows."""
    keyed = spans.groupBy("key").agg(F.collect_list(F.struct("start", "windows")).alias("spans"))
    rows = texts.join(keyed, "key").select("key", "text", "spans")

    def run(batch):
        out = {name: [] for name in ("n_removed", "n_spans", "kept_sha256", "kept")}
        for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            kept, end, n_spans = [], 0, 0
            stop = None
            for start, last in sorted((s["start"], s["start"] + s["windows"] - 1 + length) for s in spans):
                if stop is None or start > stop:
                    kept.append(text[end:start])
                    n_spans += 1
                    stop = last
                stop = max(stop, last)
                end = stop
            kept.append(text[end:])
            rest = b"".join(kept)
            out["n_removed"].append(len(text) - len(rest))
            out["n_spans"].append(n_spans)
            out["kept_sha256"].append(hashlib.sha256(rest).hexdigest())
            out["kept"].append(rest if with_text else None)
        return {"key": batch.column(0)} | out

    return map_batches(rows, run, "key binary, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")


def remove_repeats(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, with_text: bool = False
) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, ``kept`` (binary).

    Every byte within a string of ``length`` bytes (4 at least) that also starts elsewhere, in this text or any other, is
    removed; overlapping occurrences count, and the texts are judged as they came. Null texts are empty. Repeated rows, rows
    with one id and rows without id are texts each. Other columns are ignored, an empty table gives an empty result.
    """
    raw = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    texts = df.select(raw.alias("text")).withColumn("key", F.unhex(F.sha2("text", 256))).select("text", "key")
    rows = stored(
        df.select(F.col(id_col).alias("doc_id"), F.unhex(F.sha2(raw, 256)).alias("key"), F.octet_length(raw).cast("long").alias("n_bytes")), "rows"
    )
    copies = stored(rows.groupBy("key").agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1"), "copies")
    again = _cores(texts, length).groupBy("core").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    bits = bitmap(again.select(F.pmod("core", F.lit(BITS)).alias("residue")), "residue", BITS)

    members = stored(_members(texts, bits, length), "members")
    classes = members.groupBy("core", "run").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("place"))
    classes = stored(classes, "runs")
    # only hashes of the core decide here what goes on: an anchor too many is compared like any other
    cores = classes.groupBy("core").agg(F.count(F.lit(1)).alias("kinds"), F.min("n").alias("least")).filter("kinds > 1 AND least = 1")
    wanted = stored(looked_up(classes, cores.select("core", "kinds"), ["core"], "kinds").filter("kinds IS NOT NULL").select("place"), "wanted")
    bits = bitmap(wanted.select(F.pmod("place", F.lit(BITS)).alias("residue")), "residue", BITS)
    parts = max(1, wanted.count() * (length + length // 2) // BUCKET_BYTES + 1)
    suffixes = _suffixes(texts, bits, length).repartitionByRange(parts, "suffix", "before")
    compared = stored(_compared(suffixes, length), "compared")

    equal = looked_up(members, classes.filter("n > 1").select("core", "run", "n"), ["core", "run"], "n").filter("n IS NOT NULL")
    within = compared.filter("digest IS NULL")
    spans = equal.select("key", "start", "windows").unionByName(within.select("key", "start", "windows")).unionByName(_across(compared))
    # texts that occur again as a whole go as a whole
    spans = stored(looked_up(spans, copies, ["key"], "copies").filter("copies IS NULL").select("key", "start", "windows"), "spans")

    affected = bitmap(spans.select(F.pmod(F.xxhash64("key"), F.lit(BITS)).alias("residue")).distinct(), "residue", BITS)
    hashed = texts.withColumn("hash", F.xxhash64("key"))

    def chosen(batches):
        for batch in batches:
            own = is_set(affected, batch.column(2).to_numpy().view(U))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(own)) for c in batch.columns[:2]], names=["text", "key"])

    cleaned = stored(_cleaned(spans, hashed.mapInArrow(chosen, "text binary, key binary"), length, with_text), "cleaned")
    out = looked_up(rows, copies, ["key"], "copies").join(cleaned, "key", "left")
    whole = (F.col("copies") > 1) & (F.col("n_bytes") >= length)
    columns = [
        "doc_id",
        "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(whole, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, F.sha2(F.lit(b""), 256)).otherwise(F.coalesce("kept_sha256", F.lower(F.hex("key")))).alias("kept_sha256"),
    ]
    if not with_text:
        return out.select(*columns)
    back = texts.dropDuplicates(["key"]).select("key", "text")
    return out.join(back, "key").select(*columns, F.when(whole, F.lit(b"")).otherwise(F.coalesce("kept", "text")).alias("kept"))


def op11_repeats(spark, sf_dir):
    """Repeated strings of all whole documents."""
    return remove_repeats(table(spark, sf_dir, "documents"))
