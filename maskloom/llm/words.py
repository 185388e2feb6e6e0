"""Words of texts as numbers: found, counted and looked up for whole blocks at once.

A word is a run of bytes between ASCII white space, in lower case. Its key is its last
eight bytes, the eight before them, zeros where it has fewer, and its length: up to
``LONGEST`` bytes it is the word itself. Longer words are told apart by all their bytes.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

LONGEST = 16
AT_ONCE = 1 << 15  # words whose keys are made together; it bears on speed alone
GROUPED = 1 << 18  # words that are grouped before they join what is held

Keys = tuple[np.ndarray, np.ndarray, np.ndarray]

_PLAIN = bytes(32 if bytes([b]).isspace() else bytes([b]).lower()[0] for b in range(256))
_GAP = b" " * LONGEST
# The bytes of a word that are in the last eight and in the eight before, by its length.
_LAST = np.array([2**64 - (1 << 8 * (8 - min(n, 8))) for n in range(LONGEST + 1)], np.uint64)
_BEFORE = np.array([2**64 - (1 << 8 * (LONGEST - max(n, 8))) if n > 8 else 0 for n in range(LONGEST + 1)], np.uint64)


class Block:
    """The words of some texts: ``data`` holds them in lower case, from ``starts`` to ``ends``; ``sizes`` has their number in each text."""

    def __init__(self, texts: list[bytes]):
        self.data = b" ".join([_GAP, *texts, _GAP]).translate(_PLAIN)
        space = np.frombuffer(self.data, np.uint8) == 32
        edges = np.flatnonzero(space[1:] != space[:-1])
        edges += 1
        self.starts, self.ends = edges[::2], edges[1::2]
        behind = len(_GAP) + np.cumsum([1 + len(text) for text in texts], dtype=np.int64)
        self.sizes = np.diff(np.searchsorted(self.starts, behind), prepend=0)

    def __len__(self) -> int:
        return len(self.ends)

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]]

    def keys(self) -> Iterator[tuple[slice, Keys]]:
        eight = np.ndarray(len(self.data) - 7, "<u8", self.data, strides=(1,))
        for start in range(0, len(self), AT_ONCE):
            part = slice(start, min(start + AT_ONCE, len(self)))
            ends = self.ends[part] - 8
            size = ends - self.starts[part]
            size += 8
            known = np.minimum(size, LONGEST)
            last, before = eight[ends], eight[ends - 8]
            last &= _LAST.take(known)
            before &= _BEFORE.take(known)
            yield part, (last, before, size)


def hashed(keys: Keys, seed: int = 0) -> np.ndarray:
    """64 bits, of which the upper ones are the best."""
    last, before, size = keys
    by = np.random.default_rng(seed).integers(0, 2**63, 3, np.uint64) * np.uint64(2) + np.uint64(1)
    h = last + size.astype(np.uint64)
    h *= by[0]
    h ^= h >> np.uint64(32)  # short words differ in upper bits alone
    h += before
    h *= by[1]
    h ^= h >> np.uint64(32)
    h *= by[2]
    return h


# --- counting ----------------------------------------------------------------


def _grouped(keys: Keys, n: np.ndarray | None) -> tuple[Keys, np.ndarray]:
    """Distinct keys and the sum of ``n``, or their number, for each."""
    # Hash and place in one number, for plain numbers are sorted fastest.
    bits = np.uint64(max(len(keys[0]) - 1, 1).bit_length())
    mark = hashed(keys)
    mark >>= bits
    mark <<= bits
    mark |= np.arange(len(mark), dtype=np.uint64)
    mark.sort()
    order = (mark & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    mark >>= bits
    fresh = np.append(True, mark[1:] != mark[:-1])[: len(mark)]
    keys = tuple(k.take(order) for k in keys)
    other = np.zeros(len(fresh), bool)
    for k in keys:
        other[1:] |= k[1:] != k[:-1]
    if (other[1:] & ~fresh[1:]).any():  # two words with one hash
        by_value = np.lexsort(keys)
        order, keys = order[by_value], tuple(k[by_value] for k in keys)
        fresh = np.zeros(len(fresh), bool)
        fresh[:1] = True
        for k in keys:
            fresh[1:] |= k[1:] != k[:-1]
    first = np.flatnonzero(fresh)
    sums = np.diff(first, append=len(fresh)) if n is None else np.add.reduceat(n.take(order), first) if len(first) else n
    return tuple(k.take(first) for k in keys), sums


class Counts:
    """How often each word comes; ``most`` words are held at most, and as many again before they are grouped."""

    def __init__(self, most: int):
        self.most, self.long = most, Counter()
        self.loose: list[Keys] = []
        self.parts: list[tuple[Keys, np.ndarray]] = []
        self.waiting = self.held = 0

    def add(self, texts: list[bytes]) -> Iterator[pa.RecordBatch]:
        """Counts the words, and gives and forgets the counts when they are too many."""
        block = Block(texts)
        for part, keys in block.keys():
            beyond = np.flatnonzero(keys[2] > LONGEST)
            if len(beyond):
                self.long.update(block.word(i) for i in (beyond + part.start).tolist())
                keys = tuple(np.delete(k, beyond) for k in keys)
            self.loose.append(keys)
            self.waiting += len(keys[0])
            if self.waiting >= GROUPED:
                self._group()
            if merged := self.held > 2 * self.most:
                self._merge()
            if (merged and self.held > self.most) or len(self.long) > self.most:
                yield self.told()

    def _group(self) -> None:
        if self.loose:
            self.parts.append(_grouped(tuple(map(np.concatenate, zip(*self.loose, strict=True))), None))
            self.loose, self.waiting = [], 0
            self.held += len(self.parts[-1][1])

    def _merge(self) -> None:
        self._group()
        if len(self.parts) > 1:
            keys, n = zip(*self.parts, strict=True)
            self.parts = [_grouped(tuple(map(np.concatenate, zip(*keys, strict=True))), np.concatenate(n))]
            self.held = len(self.parts[0][1])

    def told(self) -> pa.RecordBatch:
        """(word, n), to be counted anew from here."""
        self._merge()
        arrays = [(pa.array(self.long.keys(), pa.binary()), pa.array(self.long.values(), pa.int64()))]
        for (last, before, size), n in self.parts:
            row = np.stack([before, last], axis=1).astype("<u8").view(np.uint8)
            data = row[np.arange(LONGEST) >= LONGEST - size[:, None]]
            ends = np.append(0, np.cumsum(size)).astype(np.int32)
            arrays.append((pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(ends), pa.py_buffer(data)]), pa.array(n, pa.int64())))
        self.long.clear()
        self.parts, self.held = [], 0
        word, n = (pa.concat_arrays(column) for column in zip(*arrays, strict=True))
        return pa.RecordBatch.from_arrays([word, n], ["word", "n"])


# --- looking up --------------------------------------------------------------


class Places:
    """The place of each word in a list, or the length of the list for any other."""

    def __init__(self, words: Iterable[bytes]):
        numbers = {word: i for i, word in enumerate(words)}
        self.n = max(numbers.values(), default=-1) + 1
        self.long = {word: i for word, i in numbers.items() if len(word) > LONGEST}
        short = [(word, i) for word, i in numbers.items() if len(word) <= LONGEST]
        at = np.array([i for _, i in short], np.int64)
        found = [keys for _, keys in Block([word for word, _ in short]).keys()]
        self.keys = tuple(np.zeros(self.n + 1, kind) for kind in (np.uint64, np.uint64, np.int64))  # no word has length 0
        if found:
            keys = tuple(map(np.concatenate, zip(*found, strict=True)))
            for known, k in zip(self.keys, keys, strict=True):
                known[at] = k
        self.last_of_long = np.array([keys[0][0] for word in self.long for _, keys in Block([word]).keys()], np.uint64)
        # A hash under which no two words meet; a few tries find it.
        self.seed, bits = 0, max(8, (len(short) ** 2 // 12).bit_length())
        while True:
            self.shift = np.uint64(64 - bits - self.seed // 256)
            slot = hashed(tuple(k[at] for k in self.keys), self.seed) >> self.shift
            if len(np.unique(slot)) == len(slot):
                break
            self.seed += 1
        self.table = np.full(1 << (64 - int(self.shift)), self.n, np.uint16 if self.n < 1 << 16 else np.int64)
        self.table[slot] = at

    def of(self, block: Block, part: slice, keys: Keys) -> np.ndarray:
        place = self.table.take((hashed(keys, self.seed) >> self.shift).astype(np.int64))
        same = self.keys[0].take(place) == keys[0]
        same &= self.keys[1].take(place) == keys[1]
        same &= self.keys[2].take(place) == keys[2]
        place[~same] = self.n
        if self.long:
            for i in np.flatnonzero((keys[2] > LONGEST) & np.isin(keys[0], self.last_of_long)).tolist():
                place[i] = self.long.get(block.word(part.start + i), self.n)
        return place


class Endings:
    """The crc32 of the last three bytes of each word, or of all it has.

    The crc of bytes of one number is that of zeros with a term for each byte.
    """

    def __init__(self) -> None:
        self.terms = np.zeros((3, 3, 256), np.uint32)  # by number of bytes, place from the end, byte
        for n in range(1, 4):
            zero = zlib.crc32(bytes(n))
            for place in range(n):
                crc = [zlib.crc32(bytes(n - 1 - place) + bytes([b]) + bytes(place)) for b in range(256)]
                self.terms[n - 1, place] = np.array(crc, np.uint32) ^ np.uint32(zero if place else 0)
        self.terms = np.ascontiguousarray(self.terms.transpose(1, 0, 2)).reshape(3, -1)

    def of(self, last: np.ndarray, size: np.ndarray) -> np.ndarray:
        row = (np.minimum(size, 3) - 1) << 8
        byte = last[:, None].astype("<u8").view(np.uint8)
        crc = self.terms[0].take(row + byte[:, 7])
        crc ^= self.terms[1].take(row + byte[:, 6])
        crc ^= self.terms[2].take(row + byte[:, 5])
        return crc
