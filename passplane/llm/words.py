"""Words of many texts at once, as arrays: where they lie, their 64-bit hashes, and small tables keyed by hash."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from passplane.llm.base import segment_sums

#: Kinds of characters. OTHER: not in the table below. END: after each text.
MARK, LETTER, NUMBER, SPACE, END, OTHER = range(6)

_LIMIT = 0x2100


def _kinds() -> np.ndarray:
    """Kinds by code point for characters whose properties are the same in every version of Unicode and that no
    normal form changes: ASCII, Latin-1, Latin Extended-A but for dotted and dotless i and the long s, Cyrillic, and
    general punctuation."""
    kind = np.full(_LIMIT, OTHER, np.uint8)
    kind[0x21:0x7F] = MARK
    kind[0xA1:0x17F] = LETTER
    kind[0xA1:0xC0] = MARK
    kind[[0xD7, 0xF7]] = MARK
    kind[[0xAA, 0xB5, 0xBA]] = LETTER
    kind[[0xB2, 0xB3, 0xB9, 0xBC, 0xBD, 0xBE]] = NUMBER
    kind[[0xAD, 0x130, 0x131, 0x149]] = OTHER
    kind[0x400:0x460] = LETTER
    kind[0x2010:0x2028] = MARK
    kind[0x2030:0x205F] = MARK
    kind[0x20AC] = MARK
    kind[[9, 10, 13, 32]] = SPACE
    kind[0x30:0x3A] = NUMBER
    kind[0x41:0x5B] = kind[0x61:0x7B] = LETTER
    kind[0] = END
    return kind


KIND = _kinds()
LOWER = np.array([ord(chr(c).lower()) if KIND[c] == LETTER else c for c in range(_LIMIT)], np.uint32)


@dataclass
class Batch:
    """Texts end to end, each with a U+0000 after it.

    text: the string; cps: its code points; kind: their kinds (beyond the table: OTHER); ends: the place of each U+0000;
    plain: whether a text has only characters of the table.
    """

    text: str
    cps: np.ndarray
    kind: np.ndarray
    ends: np.ndarray
    plain: np.ndarray


def batch_of(texts: list[str]) -> Batch:
    """The texts as one array of code points."""
    if any("\0" in x for x in texts):
        inside = np.array(["\0" in x for x in texts])
        texts = [x.replace("\0", "�") for x in texts]
    else:
        inside = np.zeros(len(texts), bool)
    text = "\0".join([*texts, ""])
    cps = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(lengths + 1) - 1
    kind = KIND[np.minimum(cps, _LIMIT - 1)]
    kind[cps >= _LIMIT] = OTHER
    odd = np.flatnonzero(kind == OTHER)
    plain = ~inside
    plain[np.searchsorted(ends, odd)] = False
    return Batch(text, cps, kind, ends, plain)


_RANDOM = np.random.default_rng(2024).integers(1, 2**63, 0x800, dtype=np.uint64) | np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def hashes(cps: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each range of code points. Ranges ascend and do not overlap; gaps do not count. Never 0."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = stops - starts
    bounds = np.empty(2 * len(starts), np.int64)
    bounds[::2], bounds[1::2] = starts, stops
    powers = np.cumprod(np.full(int(lengths.max()) + 1, _STEP | np.uint64(1), np.uint64))
    place = np.arange(len(cps)) - np.repeat(np.concatenate([[0], starts]), np.diff(np.concatenate([[0], starts, [len(cps)]])))
    value = _RANDOM[cps & 0x7FF] + cps * np.uint64(0xD6E8FEB86659FD93)
    value *= powers[np.minimum(place, len(powers) - 1)]
    at_end = bounds[-1] == len(cps)
    sums = np.add.reduceat(value, bounds[:-1] if at_end else bounds)[::2]
    sums ^= lengths.astype(np.uint64) * _STEP
    sums ^= sums >> np.uint64(32)
    sums *= np.uint64(0xD6E8FEB86659FD93)
    sums ^= sums >> np.uint64(29)
    return np.maximum(sums, np.uint64(1))


def splits(b: Batch, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, stops, code points): the words of plain texts by a byte-level vocabulary's rules.

    With lower, code points are lower-cased, digits stand alone and spaces are dropped. Otherwise a single space before a
    word belongs to it, and of a longer run of white space the last. In both, an apostrophe that begins a run of marks takes
    a following s, t, m, d, re, ve or ll.
    """
    cps, kind = (LOWER[np.minimum(b.cps, _LIMIT - 1)] if lower else b.cps), b.kind
    new = np.empty(len(kind), bool)
    new[0] = True
    np.not_equal(kind[1:], kind[:-1], out=new[1:])
    new |= kind == END
    if lower:
        new |= kind == NUMBER
    else:
        # the last white space of a run that something follows stands alone, and a space there joins what follows
        last = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & (kind[1:] != END))
        new[last] = True
        joins = last[cps[last] == 0x20]
        new[joins + 1] = False
    # apostrophes: alone as a run of marks, and not joined to a space
    at = np.flatnonzero((cps[:-2] == 0x27) & (kind[1:-1] == LETTER))
    at = at[new[at]]
    if len(at):
        one, two = cps[at + 1], cps[at + 2]
        takes = np.where(np.isin(one, [0x73, 0x74, 0x6D, 0x64]), 1, np.where(((one == 0x72) | (one == 0x76)) & (two == 0x65) | (one == 0x6C) & (two == 0x6C), 2, 0))
        at, takes = at[takes > 0], takes[takes > 0]
        new[at + 1] = False
        rest = at + 1 + takes
        new[rest] |= kind[rest] == LETTER
    starts = np.flatnonzero(new)
    stops = np.append(starts[1:], len(kind))
    keep = (kind[starts] != END) & ((kind[starts] != SPACE) if lower else True)
    return starts[keep], stops[keep], cps


def counts_by_text(b: Batch, starts: np.ndarray) -> np.ndarray:
    """How many of the ascending places lie in each text."""
    return np.diff(np.searchsorted(starts, b.ends), prepend=0)


class HashTable:
    """Numbers 64-bit hashes in the order in which they first appear."""

    def __init__(self, bits: int = 16):
        self.keys, self.values, self.size = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32), 0

    def _find(self, h: np.ndarray) -> np.ndarray:
        """The slot of each hash, or of the empty slot where it would be."""
        mask = np.uint64(len(self.keys) - 1)
        slot = (h & mask).astype(np.int64)
        todo = np.flatnonzero((self.keys[slot] != h) & (self.keys[slot] != 0))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & int(mask)
            key = self.keys[slot[todo]]
            todo = todo[(key != h[todo]) & (key != 0)]
        return slot

    def _insert(self, h: np.ndarray, value: np.ndarray) -> None:
        """Adds distinct hashes that are not there."""
        while len(h):
            slot = self._find(h)
            self.keys[slot] = h  # of several for one slot, one stays; the others find another
            won = self.keys[slot] == h
            self.values[slot[won]] = value[won]
            h, value = h[~won], value[~won]

    def of(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of each hash, and the positions in h of those that are new, in the order of their numbers."""
        slot = self._find(h)
        missing = np.flatnonzero(self.keys[slot] == 0)
        if not len(missing):
            return self.values[slot], missing
        new, first = np.unique(h[missing], return_index=True)
        if 2 * (self.size + len(new)) > len(self.keys):
            held = self.keys != 0
            old, values = self.keys[held], self.values[held]
            bits = int(2 * (self.size + len(new))).bit_length()
            self.keys, self.values = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32)
            self._insert(old, values)
        self._insert(new, np.arange(self.size, self.size + len(new), dtype=np.int32))
        self.size += len(new)
        return self.values[self._find(h)], missing[first]


def letters_in(b: Batch, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Letters of the table in each of the ascending ranges."""
    total = np.concatenate([[0], np.cumsum(b.kind == LETTER)])
    return total[stops] - total[starts]


def sums_by_text(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive values by text."""
    return segment_sums(values, counts)
