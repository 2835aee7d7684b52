"""Terms of Arrow batches as numbers: what ``ngrams.add_terms`` spells out as strings, counted inside the row's own task.

A term is a run of symbols, words or characters. Symbols are numbered within a piece of a batch and a run's numbers are packed
into one 64-bit integer, so that occurrences are counted by sorting integers; only distinct terms become strings. Nothing is
compared by hashes, except where terms are asked for as 64-bit digests.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from inkmark.functions.ngrams import TermSpec

# Words or bytes of text counted at once; this bounds the memory of a task.
PIECE = 1 << 20
SPACE = ord(" ")


def pieces(batch: pa.RecordBatch, columns: list[int]) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``PIECE`` words or bytes in the columns; a row is never cut."""
    if not batch.num_rows:
        return
    sizes = sum(np.diff(batch.column(c).offsets.to_numpy() if pa.types.is_list(batch.column(c).type) else _offsets(batch.column(c))) for c in columns)
    cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // PIECE)) + 1
    for first, end in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
        yield batch.slice(first, end - first)


def _offsets(texts: pa.StringArray) -> np.ndarray:
    return np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)


class _Words:
    """The words of a list column."""

    def __init__(self, lists: pa.ListArray):
        encoded = lists.flatten().dictionary_encode()
        self.names = encoded.dictionary
        self.codes = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
        self.size = max(len(self.names), 1)

    def numbers(self) -> np.ndarray:
        digests = [hashlib.blake2b(w.encode(), digest_size=8).digest() for w in self.names.to_pylist()]
        return np.frombuffer(b"".join(digests), dtype=np.uint64)

    def spelled(self, codes: np.ndarray) -> pa.Array:
        words = [self.names.take(pa.array(codes[:, j])) for j in range(codes.shape[1])]
        return words[0] if len(words) == 1 else pc.binary_join_element_wise(*words, " ")


class _Characters:
    """The code points of a text column."""

    def __init__(self, texts: pa.StringArray):
        bounds = _offsets(texts)
        data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[bounds[0] : bounds[-1]]
        begins = np.flatnonzero((data & 0xC0) != 0x80)
        points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
        self.row = np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(begins, bounds - bounds[0])))
        seen = np.zeros(0x110000, dtype=bool)
        seen[points] = True
        self.names = np.flatnonzero(seen).astype(np.uint32)
        number = np.zeros(0x110000, dtype=np.int32)
        number[self.names] = np.arange(len(self.names))
        self.codes = number[points].astype(np.int64)
        self.blank = points == SPACE
        self.size = max(len(self.names), 1)

    def numbers(self) -> np.ndarray:
        return self.names.astype(np.uint64)

    def spelled(self, codes: np.ndarray) -> pa.Array:
        points = self.names[codes]
        wide = 1 + sum((points >= limit).astype(np.int32) for limit in (0x80, 0x800, 0x10000))
        ends = np.concatenate(([0], np.cumsum(wide.sum(axis=1)))).astype(np.int32)
        data = points.astype("<u4").tobytes().decode("utf-32-le").encode("utf-8")
        return pa.StringArray.from_buffers(len(codes), pa.py_buffer(ends), pa.py_buffer(data))


def _packed(codes: np.ndarray, n: int, size: int, room: int) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """One integer below ``room`` for each run of ``n`` symbols; prefixes are numbered anew where it would not fit."""
    last, span, tables = len(codes) - n + 1, size, {}
    keys = codes[:last]
    for j in range(1, n):
        if span * size > room:
            tables[j], keys = np.unique(keys, return_inverse=True)
            span = len(tables[j])
        keys = keys * size + codes[j : last + j]
        span *= size
    return keys, tables


def _unpacked(keys: np.ndarray, n: int, size: int, tables: dict[int, np.ndarray]) -> np.ndarray:
    """(key, n): the symbols of the keys."""
    out = np.empty((len(keys), n), dtype=np.int64)
    for j in range(n - 1, 0, -1):
        out[:, j] = keys % size
        keys = keys // size
        if j in tables:
            keys = tables[j][keys]
    out[:, 0] = keys
    return out


def _runs(symbols, spec: TermSpec) -> Iterator[tuple[int, np.ndarray]]:
    """(length, mask of the first symbols) of all kinds of terms."""
    row = symbols.row
    sizes = [(n, False) for n in range(spec.min_n, spec.max_n + 1)]
    if spec.analyzer == "char_wb":
        # padded words shorter than the smallest gram are a term themselves
        sizes += [(k + 2, True) for k in range(1, spec.min_n - 2)]
    for n, whole in sizes:
        last = len(row) - n + 1
        if last <= 0:
            continue
        fits = row[:last] == row[n - 1 :]
        if spec.analyzer == "char_wb":
            # only the first and the last character may be a space
            for j in range(1, n - 1):
                fits &= ~symbols.blank[j : last + j]
            if whole:
                fits &= symbols.blank[:last] & symbols.blank[n - 1 :]
        yield n, fits


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose bits all depend on all bits."""
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return h ^ (h >> np.uint64(31))


def _digests(codes: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """One 64-bit digest per run of symbols, the same in every piece."""
    h = np.full(len(codes), codes.shape[1], dtype=np.uint64)
    for j in range(codes.shape[1]):
        h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + numbers[codes[:, j]])
    return h.view(np.int64)


def counted(column: pa.Array, spec: TermSpec, digests: bool = False) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """Per kind of term: the distinct terms, spelled or as 64-bit digests, and, sorted by term, the cells (term's place, row, occurrences)."""
    rows = max(len(column), 1)
    if not len(column):
        return
    symbols = _Words(column) if spec.analyzer == "word" else _Characters(column)
    for n, fits in _runs(symbols, spec):
        keys, tables = _packed(symbols.codes, n, symbols.size, (1 << 62) // rows)
        cells = np.sort(keys[fits] * rows + symbols.row[: len(keys)][fits])
        if not len(cells):
            continue
        first = np.flatnonzero(np.concatenate(([True], cells[1:] != cells[:-1])))
        tf = np.diff(np.append(first, len(cells)))
        key, row = cells[first] // rows, cells[first] % rows
        new = np.concatenate(([True], key[1:] != key[:-1]))
        codes = _unpacked(key[new], n, symbols.size, tables)
        yield _digests(codes, symbols.numbers()) if digests else symbols.spelled(codes), np.cumsum(new) - 1, row, tf


def totals(column: pa.Array, spec: TermSpec) -> Iterator[pa.RecordBatch]:
    """(term, df, cf) of the rows of a piece."""
    for terms, place, _, tf in counted(column, spec):
        df = np.bincount(place, minlength=len(terms))
        cf = np.bincount(place, tf, len(terms)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([terms, pa.array(df), pa.array(cf)], names=["term", "df", "cf"])


def weights(
    column: pa.Array, spec: TermSpec, known: pa.Array, idf: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, place among the known terms, occurrences, weight) of the known terms; a row's weights are of unit length."""
    found = [(np.zeros(0, np.int64),) * 3]
    for terms, place, row, tf in counted(column, spec) if len(known) else ():
        at = pc.fill_null(pc.index_in(terms, value_set=known), -1).to_numpy(zero_copy_only=False).astype(np.int64)[place]
        hit = at >= 0
        found.append((row[hit], at[hit], tf[hit]))
    row, at, tf = (np.concatenate(x) for x in zip(*found))
    w = (np.log(tf) + 1.0 if spec.sublinear else tf) * idf[at]
    norm = np.sqrt(np.bincount(row, w * w, max(len(column), 1)))
    return row, at, tf, w / norm[row]
