"""Vectorised word splitting and 64-bit hashing of UTF-8 text (numpy, inside tasks).

Words are runs of bytes other than space and ``\\x09-\\x0D``. UTF-8 never uses those bytes inside a longer
character, so byte-wise splitting equals splitting by code points.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

U = np.uint64
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
# An odd multiplier mixes the hashes of the parts of a window.
_BASE = 0x9E3779B97F4A7C15
SEGMENT = 4 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of 64-bit integers with well-spread bits."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def distinct_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """The distinct byte strings among the spans ``data[start:end]``, and the number of its string for each span.

    The spans are in order and do not overlap. Strings are told apart by their bytes, not by a hash.
    """
    if len(starts) == 0:
        return np.zeros(0, dtype=np.int64), []
    edges = np.zeros(len(data) + 1, dtype=np.int8)
    filled = starts < ends
    edges[starts[filled]] += 1
    edges[ends[filled]] -= 1
    compact = data[np.cumsum(edges[:-1], dtype=np.int8).view(bool)]
    offsets = np.zeros(len(starts) + 1, dtype=np.int64)
    np.cumsum(ends - starts, out=offsets[1:])
    spans = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(compact)])
    encoded = spans.dictionary_encode()
    return encoded.indices.to_numpy(), encoded.dictionary.to_pylist()


def string_hashes(strings: list[bytes]) -> np.ndarray:
    """64 bits of a cryptographic hash of each string, so structured strings collide no more than others."""
    return np.frombuffer(b"".join(hashlib.blake2b(s, digest_size=8).digest() for s in strings), dtype=U)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each byte span ``data[start:end]``; equal bytes give equal hashes wherever they stand.

    The spans are in order and do not overlap. Long data is taken in segments, which bounds the working memory.
    """
    if len(starts) > 1 and int(ends[-1] - starts[0]) > SEGMENT:
        cuts = np.searchsorted(starts, np.arange(int(starts[0]), int(ends[-1]), SEGMENT))
        cuts = np.unique(np.concatenate((cuts, [len(starts)])))
        return np.concatenate([_hashed(data, starts[i:j], ends[i:j]) for i, j in zip(cuts, cuts[1:])])
    return _hashed(data, starts, ends)


def _hashed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    if len(starts) == 0:
        return np.zeros(0, dtype=U)
    base = starts[0]
    numbers, strings = distinct_spans(data[base : ends[-1]], starts - base, ends - base)
    return string_hashes(strings)[numbers]


def lowered(data: np.ndarray) -> np.ndarray:
    """ASCII letters in lower case."""
    return _LOWER[data]


def is_space(byte: int) -> bool:
    return bool(_SPACE[byte])


def words_of(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets (start, end) of the words."""
    edge = np.flatnonzero(np.diff(np.concatenate(([True], _SPACE[data], [True])).astype(np.int8)))
    return edge[0::2], edge[1::2]


def combine(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of every window of ``size`` consecutive hashes."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=U)
    out = np.zeros(n, dtype=U)
    for i in range(size):
        out = (out + hashes[i : i + n]) * U(_BASE)
        out ^= out >> U(29)
    return mix(out)


def word_hashes(text: bytes, lower: bool = True) -> np.ndarray:
    """One hash per word, in text order."""
    data = np.frombuffer(text, dtype=np.uint8)
    if lower:
        data = lowered(data)
    return span_hashes(data, *words_of(data))


def shingle_set(words: np.ndarray, size: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text's word hashes; a shorter text is one shingle, one without words none."""
    if len(words) == 0:
        return np.zeros(0, dtype=U)
    if len(words) < size:
        return combine(words, len(words)) ^ U(len(words))
    return np.unique(combine(words, size))
