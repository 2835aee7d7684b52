"""Best-fit packing into sequences of several permitted lengths.

Pieces are packed in groups that hold a bounded number of tokens, so the work is spread and no task sees all. Within a
group pieces go, longest first, to the open bin with the least room that takes them; where none does, the bin size that is
expected to cost least per token, once filled with pieces still to come and shrunk, is opened. The sizes are chosen jointly:
that outcome competes with one for each size below which no bin is opened, and the cheapest stays. In the end every bin
shrinks to the smallest size that holds its contents.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkmark.llm.arrow import stored, table
from inkmark.llm.ranges import shard_count
from inkmark.llm.token_counts import VOCABULARY, count_tokens
from inkmark.llm.tokens import public_path

CAPACITIES = (512, 1024, 2048, 4096, 8192)
# Cost of a bin of c tokens: c, an attention share of c * c / ATTENTION, and a fixed part.
ATTENTION = 16_384
FIXED = 16
# Bounds of a group.
GROUP_TOKENS = 4 << 20
GROUP_PIECES = 100_000


def cost(capacity: int) -> float:
    return capacity + capacity * capacity / ATTENTION + FIXED


def fitted(tokens: int, capacities: tuple[int, ...]) -> int:
    """The smallest permitted size that holds the tokens."""
    return next(c for c in capacities if c >= tokens)


class _Outlook:
    """What a new bin of each size is expected to cost per token, given the pieces that are still to come."""

    def __init__(self, lengths: list[int], capacities: tuple[int, ...]):
        self.sizes = sorted(set(lengths))
        self.left = [0] * len(self.sizes)
        self.at = {n: i for i, n in enumerate(self.sizes)}
        for n in lengths:
            self.left[self.at[n]] += 1
        self.capacities = capacities
        self.known: dict[int, int] = {}

    def choose(self, length: int) -> int:
        """The size whose bin, filled with this piece and the largest ones to come that fit, is cheapest after shrinking.

        Decided when a bin is first opened for a length, and kept for that length.
        """
        if length not in self.known:
            offers = []
            for capacity in self.capacities:
                if capacity >= length:
                    total, free = length, capacity - length
                    i = bisect_right(self.sizes, free) - 1
                    while i >= 0:
                        # pieces come longest first, so all shorter ones are still to come
                        n = min(self.left[i], free // self.sizes[i])
                        total += n * self.sizes[i]
                        free -= n * self.sizes[i]
                        i = min(i - 1, bisect_right(self.sizes, free) - 1)
                    offers.append((cost(fitted(total, self.capacities)) / total, capacity))
            self.known[length] = min(offers)[1]
        return self.known[length]


def _best_fit(lengths: list[int], capacities: tuple[int, ...], least: int | None) -> tuple[list[int], list[int]]:
    """Bin of each piece (lengths falling), and the tokens per bin.

    A new bin has the size that the outlook chooses or, with ``least``, the least size from there on that takes the piece.
    """
    bins: list[int] = []  # tokens
    room: list[tuple[int, int]] = []  # (free tokens, bin), rising
    placed = []
    outlook = _Outlook(lengths, capacities) if least is None else None
    for length in lengths:
        if outlook:
            outlook.left[outlook.at[length]] -= 1
        at = bisect_left(room, (length, -1))
        if at < len(room):
            free, number = room.pop(at)
        else:
            free = outlook.choose(length) if outlook else next(c for c in capacities if c >= max(length, least))
            number = len(bins)
            bins.append(0)
        bins[number] += length
        placed.append(number)
        if free > length:
            insort(room, (free - length, number))
    return placed, bins


def outcomes(lengths: list[int], capacities: tuple[int, ...]) -> list[tuple[list[int], list[int]]]:
    """Packings with sizes chosen by the outlook and, for each permitted size, with no smaller bin opened than that."""
    return [_best_fit(lengths, capacities, least) for least in (None, *capacities)]


def pack_group(lengths: list[int], capacities: tuple[int, ...]) -> tuple[list[int], list[int]]:
    """The cheapest of the outcomes after shrinking."""
    return min(outcomes(lengths, capacities), key=lambda o: sum(cost(fitted(b, capacities)) for b in o[1]))


def pack(lengths: DataFrame, capacities: tuple[int, ...] = CAPACITIES, group_tokens: int = GROUP_TOKENS, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Pack rows of (doc_id, n_tokens).

    Result, one row per piece: doc_id, copy (number among rows equal in both columns), piece, start (first token of the
    piece in its document), n_tokens, bin_id, bin_offset, bin_tokens, bin_capacity. A document longer than the largest
    capacity is cut into full pieces and a rest; no token is dropped. Rows of 0 tokens or null need no place and are left
    out. Null ids are packed like others; the group of a piece follows its id, length and number, so repeated rows spread.
    """
    capacities = tuple(sorted(capacities))
    largest = capacities[-1]
    rows = lengths.filter("n_tokens > 0").groupBy("doc_id", "n_tokens").agg(F.count(F.lit(1)).alias("copies"))
    rows = rows.select("doc_id", "n_tokens", F.explode(F.sequence(F.lit(1), "copies")).alias("copy"))
    last = F.ceil(F.col("n_tokens") / largest) - 1
    cut = rows.select("doc_id", "copy", "n_tokens", F.explode(F.sequence(F.lit(0), last.cast("int"))).alias("piece"))
    start = F.col("piece").cast("long") * largest
    pieces = cut.select("doc_id", "copy", "piece", start.alias("start"), F.least(F.lit(largest), F.col("n_tokens") - start).alias("length"))
    pieces = stored(pieces, "pieces")
    total, count = pieces.agg(F.coalesce(F.sum("length"), F.lit(0)), F.count(F.lit(1))).first()
    groups = max(1, -(-total // group_tokens), -(-count // group_pieces))
    grouped = pieces.withColumn("group", F.pmod(F.xxhash64("doc_id", "copy", "piece", "length"), F.lit(groups)))
    ordered = grouped.repartition(min(groups, max(shard_count(pieces), 1) * 4), "group").sortWithinPartitions(
        "group", F.col("length").desc(), "doc_id", "copy", "piece"
    )

    def place(group: int, batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        data = pa.Table.from_batches(batches).combine_chunks()
        size = data.column("length").to_numpy()
        number, tokens = pack_group(size.tolist(), capacities)
        number = np.array(number)
        order = np.argsort(number, kind="stable")
        before = np.cumsum(size[order]) - size[order]
        first = np.flatnonzero(np.diff(number[order], prepend=-1))
        offset = np.empty(len(size), dtype=np.int64)
        offset[order] = before - np.repeat(before[first], np.diff(np.append(first, len(size))))
        tokens = np.array(tokens, dtype=np.int64)
        capacity = np.array([fitted(t, capacities) for t in tokens.tolist()], dtype=np.int32)
        columns = [*(data.column(c).combine_chunks() for c in ("doc_id", "copy", "piece", "start", "length"))]
        columns += [pa.array((group << 32) + number), pa.array(offset), pa.array(tokens[number]), pa.array(capacity[number])]
        return pa.RecordBatch.from_arrays([c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in columns], names=names)

    names = ["doc_id", "copy", "piece", "start", "n_tokens", "bin_id", "bin_offset", "bin_tokens", "bin_capacity"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_group, held = None, []
        for batch in batches:
            numbers = batch.column("group").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), len(numbers)]
            for low, high in zip(cuts, cuts[1:]):
                if low < high and numbers[low] != open_group:
                    if held:
                        yield place(open_group, held)
                    open_group, held = int(numbers[low]), []
                if low < high:
                    held.append(batch.slice(low, high - low))
        if held:
            yield place(open_group, held)

    return ordered.mapInArrow(
        run,
        "doc_id bigint, copy bigint, piece int, start bigint, n_tokens bigint, bin_id bigint, bin_offset bigint, bin_tokens bigint, bin_capacity int",
    )


def pack_documents(docs: DataFrame) -> DataFrame:
    """Token counts of whole documents, one more for the end id, packed. A null text has the end id alone."""
    counts = count_tokens(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), public_path(VOCABULARY))
    return pack(counts.select("doc_id", (F.col("n_tokens") + 1).alias("n_tokens")))


def op5_packing(spark, sf_dir):
    """All documents packed into sequences of 512 to 8,192 tokens."""
    return pack_documents(table(spark, sf_dir, "documents"))
