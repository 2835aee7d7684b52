"""Token encoding with public vocabularies, word by word where that is exact.

A tokenizer that drops white space never joins characters across it, so ASCII white space is a safe boundary:
the ids of a text are those of its words, in order. Each distinct word is encoded once per worker by the library and
found again by its bytes; long texts are thereby split as well. Other tokenizers get whole texts.

Where the pre-tokenizer is known to part letters from signs and to lower the case, words are cut there too, and letters of
ASCII and Latin-1 are lowered before they are looked up: there are fewer distinct words, and these need no normalising.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import regex

from inkmark.llm.arrow import Block
from inkmark.llm.hashing import distinct_spans, is_space, lowered, words_of

# Words kept per worker; when the memory is full it starts anew.
KNOWN_WORDS = 500_000
# Bytes of text per call of the library.
CALL_BYTES = 1 << 20
LINE_WORDS = 500


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _drops_space(path: str) -> bool:
    """True where the pre-tokenizer keeps only matches without white space."""
    with open(path, encoding="utf-8") as file:
        first = json.load(file).get("pre_tokenizer") or {}
    parts = first.get("pretokenizers", [first])
    split = parts[0] if parts else {}
    pattern = (split.get("pattern") or {}).get("Regex")
    drops = split.get("type") == "Split" and bool(split.get("invert")) and split.get("behavior") == "Removed"
    return bool(drops and pattern) and not _matches_space(pattern)


def _matches_space(pattern: str) -> bool:
    """True where a match of the pattern may hold white space: tried on words of all kinds among ASCII white space."""
    signs = "aZ09é一'’_.,!?#$%-(\u0301\U0001f600"
    words = [a + b + c for a in signs for b in signs for c in ("s", "", "7")]
    try:
        found = regex.finditer(pattern, "".join(w + " \t\n\x0b\x0c\r"[i % 6] * (1 + i % 3) for i, w in enumerate(words)))
    except regex.error:
        return True
    return any(regex.search(r"\s", m.group()) for m in found)


# A match of this pattern never holds both a letter and a sign other than the apostrophe, and none depends on its surroundings.
_PARTING = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
# The product of the kinds of two neighbours is 2 between a letter and a sign only.
_GAP, _LETTER, _SIGN, _OTHER = range(4)


def _kinds(path: str) -> np.ndarray | None:
    """The kind of each ASCII byte if the file's tokenizer may be fed letters and signs apart, lowered; else None.

    It normalises by NFC, white space and lower case only. NFC and lower case leave ASCII signs alone, and a letter of ASCII
    or Latin-1 changes only with a mark behind it. Signs that occur in added tokens stay with their neighbours.
    """
    with open(path, encoding="utf-8") as file:
        made = json.load(file)
    steps = (made.get("normalizer") or {}).get("normalizers", [])
    known = [s["type"] for s in steps] == ["NFC", "Replace", "Lowercase"] and steps[1]["pattern"] == {"Regex": "\\s+"} and steps[1]["content"] == " "
    parts = (made.get("pre_tokenizer") or {}).get("pretokenizers", [])
    known &= [p["type"] for p in parts] == ["Split", "ByteLevel"] and parts[0]["pattern"] == {"Regex": _PARTING}
    if not known or parts[1]["use_regex"] or parts[1]["add_prefix_space"]:
        return None
    held = set("'").union(*(t["content"] for t in made.get("added_tokens") or []))
    kinds = np.full(256, _OTHER, dtype=np.uint8)
    for byte in range(33, 127):
        if chr(byte).isalpha():
            kinds[byte] = _LETTER
        elif not chr(byte).isdigit() and chr(byte) not in held:
            kinds[byte] = _SIGN
    kinds[[is_space(b) for b in range(256)]] = _GAP
    return kinds


def _parted(data: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes, lowered in words of letters alone; starts and ends of the words, cut between letters and signs; which are letters."""
    kind = kinds[data]
    lead = np.flatnonzero(data[:-1] == 0xC3)
    trail = data[lead + 1]
    # Latin-1 letters: all from U+00C0 on but the signs of multiplication and division
    lead = lead[(trail >= 0x80) & (trail <= 0xBF) & (trail != 0x97) & (trail != 0xB7)]
    kind[lead] = kind[lead + 1] = _LETTER
    gap = kind == _GAP
    cut = kind[1:] * kind[:-1] == _LETTER * _SIGN
    starts = np.flatnonzero(~gap & np.concatenate(([True], gap[:-1] | cut)))
    ends = np.flatnonzero(~gap & np.concatenate((gap[1:] | cut, [True]))) + 1
    low = lowered(data)
    low[lead[data[lead + 1] < 0x9F] + 1] += 0x20
    others = np.concatenate(([0], np.cumsum(kind == _OTHER)))
    mixed = others[ends] > others[starts]
    if mixed.any():
        edges = np.zeros(len(data) + 1, dtype=np.int8)
        edges[starts[mixed]] += 1
        edges[ends[mixed]] -= 1
        low = np.where(np.cumsum(edges[:-1], dtype=np.int8).view(bool), data, low)
    return low, starts, ends, ~mixed & (kind[starts] == _LETTER)


def _balanced(items: list, sizes, limit: int = CALL_BYTES) -> Iterator[list]:
    """Consecutive items in lists of about ``limit`` bytes."""
    part, total = [], 0
    for item, size in zip(items, sizes):
        if part and total + size > limit:
            yield part
            part, total = [], 0
        part.append(item)
        total += size
    if part:
        yield part


class Encoder:
    """Ids of texts as the library for the file gives them, without added special tokens."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self._encode = lambda texts: model.encode(texts, num_threads=1)
            self.by_word = False
        else:
            from tokenizers import Tokenizer, normalizers, pre_tokenizers

            model = Tokenizer.from_file(path)
            model.no_truncation()
            model.no_padding()
            self._encode = lambda texts: [e.ids for e in model.encode_batch_fast(texts, add_special_tokens=False)]
            self._lines = lambda texts: model.encode_batch(texts, add_special_tokens=False)
            self.by_word = _drops_space(path)
            self.kinds, self._plain = _kinds(path) if self.by_word else None, None
            if self.kinds is not None:
                # lowered letters need the library's merges only
                plain = Tokenizer.from_file(path)
                plain.no_truncation()
                plain.no_padding()
                plain.normalizer = normalizers.Sequence([])
                split = [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
                plain.pre_tokenizer = pre_tokenizers.Sequence(split)
                self._plain = lambda texts: plain.encode_batch(texts, add_special_tokens=False)
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.begin = np.zeros(0, dtype=np.int64)
        self.length = np.zeros(0, dtype=np.int64)
        self.pool = np.zeros(0, dtype=np.uint32)

    def _whole(self, texts: list[bytes]) -> list[list[int]]:
        out = []
        for part in _balanced(texts, map(len, texts)):
            out += self._encode([t.decode("utf-8", "replace") for t in part])
        return out

    def _words(self, words: list[bytes], encode) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words and their number per word; words travel as lines, and offsets tell them apart."""
        ids, sizes = [np.zeros(0, dtype=np.uint32)], []
        for part in _balanced(words, map(len, words)):
            lines = [[w.decode("utf-8", "replace") for w in part[i : i + LINE_WORDS]] for i in range(0, len(part), LINE_WORDS)]
            for line, encoded in zip(lines, encode([" ".join(line) for line in lines])):
                lengths = np.fromiter(map(len, line), dtype=np.int64, count=len(line))
                begins = np.cumsum(lengths + 1) - lengths - 1
                ids.append(np.array(encoded.ids, dtype=np.uint32))
                word = np.searchsorted(begins, [o[0] for o in encoded.offsets], side="right") - 1
                sizes.append(np.bincount(word, minlength=len(line)) if len(word) else np.zeros(len(line), dtype=np.int64))
        return np.concatenate(ids), np.concatenate(sizes)

    def _slots(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """Starts of all words, and their index in the memory after new ones were encoded; words are compared by their bytes."""
        if self.kinds is None:
            data, (starts, ends) = block.data, words_of(block.data)
            letters = np.zeros(len(starts), dtype=bool)
        else:
            data, starts, ends, letters = _parted(block.data, self.kinds)
        numbers, words = distinct_spans(data, starts, ends)
        plain = np.zeros(len(words), dtype=bool)
        plain[numbers[letters]] = True
        slots = [self.known.get(w, -1) for w in words]
        new = [i for i, slot in enumerate(slots) if slot < 0]
        if new:
            if self.known and len(self.known) + len(new) > KNOWN_WORDS:
                self._forget()
                new = range(len(words))
            flags = plain.tolist()
            parts = [[i for i in new if flags[i]], [i for i in new if not flags[i]]]
            for part, encode in zip(parts, (self._plain, self._lines)):
                if part:
                    own = [words[i] for i in part]
                    ids, sizes = self._words(own, encode)
                    self.begin = np.concatenate([self.begin, len(self.pool) + np.cumsum(sizes) - sizes])
                    self.length = np.concatenate([self.length, sizes])
                    self.pool = np.concatenate([self.pool, ids])
                    first = len(self.known)
                    self.known.update(zip(own, range(first, first + len(own))))
                    for slot, i in enumerate(part, first):
                        slots[i] = slot
        return starts, np.array(slots, dtype=np.int64)[numbers]

    def counts(self, block: Block) -> np.ndarray:
        """Ids per text."""
        if not self.by_word:
            return np.fromiter(map(len, self._whole(block.texts)), dtype=np.int64, count=len(block.texts))
        starts, slots = self._slots(block)
        total = np.concatenate(([0], np.cumsum(self.length[slots])))
        bounds = block.counts(starts)
        return total[bounds[1:]] - total[bounds[:-1]]

    def ids(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the block's texts in order, and the number per text."""
        if not self.by_word:
            parts = self._whole(block.texts)
            sizes = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
            return np.fromiter((i for x in parts for i in x), dtype=np.uint32, count=int(sizes.sum())), sizes
        starts, slots = self._slots(block)
        length = self.length[slots]
        total = np.concatenate(([0], np.cumsum(length)))
        # position in the pool = start of the word's ids + distance from the word's first output place
        places = np.arange(total[-1]) + np.repeat(self.begin[slots] - total[:-1], length)
        bounds = block.counts(starts)
        return self.pool[places], total[bounds[1:]] - total[bounds[:-1]]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a file; loaded once."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
