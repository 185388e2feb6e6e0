"""Suffix order and common prefixes of a byte string by external induced sorting.

Suffixes of a string are of type S or L, smaller or larger than the one after them.
Those of type S that follow an L are the stars. Star substrings are named by an
external sort, and the string of names, a third as long or less, is sorted by the
same means until it is short. From the sorted stars a priority queue induces the L
suffixes in one scan upwards, and from those another the S suffixes in one scan
downwards. Queue tuples are (symbol, position, common prefix): the symbol and the
order of arrival sort them, and the common prefix of neighbours is one more than
the least common prefix the scan met between the tuples they came from.

A queue keeps at most ``memory`` tuples and writes sorted runs beyond that; texts,
names and flags are memory-mapped files. All files are unlinked as soon as they
are open, in the folder where Spark spills itself, and belong to one task: a task
that is run again starts anew, and no other task or executor ever reads them.

Each step of a scan takes as many tuples as cannot be overtaken: what a tuple
induces has a key no smaller than its own, so the smallest keys up to the least one
they induce leave the queue at once, as arrays.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable, Iterator

import numpy as np

MEMORY = 1 << 20  # tuples a queue holds; also the longest string of names that is sorted in memory
STEP = 1 << 12
FAR = 1 << 30
# Symbols of a byte string: bytes from 2 on, what separates texts, and the end. 255 pads keys.
SEPARATOR, SHIFT = 1, 2
PAD = 255


def _folder() -> str:
    return os.environ.get("SPARK_LOCAL_DIRS", tempfile.gettempdir()).split(",")[0]


def disk_array(size: int, dtype) -> np.ndarray:
    """A zeroed array in an unlinked file; the system may drop its pages from memory."""
    if not size:
        return np.empty(0, dtype)
    with tempfile.TemporaryFile(dir=_folder()) as file:
        file.truncate(size * np.dtype(dtype).itemsize)
        return np.memmap(file, dtype, "r+", shape=(size,))


# A block of tuples has two rows: keys, and positions with common prefixes in the low bits.
LCP_BITS = 20
_LCP = (1 << LCP_BITS) - 1


def tuples(key, pos, lcp) -> np.ndarray:
    out = np.empty((2, len(pos)), np.int64)
    out[0] = key
    out[1] = (pos << LCP_BITS) | np.minimum(lcp, _LCP)
    return out


def position(block: np.ndarray) -> np.ndarray:
    return block[1] >> LCP_BITS


def common(block: np.ndarray) -> np.ndarray:
    return block[1] & _LCP


def on_disk(block: np.ndarray) -> np.ndarray:
    run = disk_array(block.size, np.int64).reshape(block.shape)
    run[:] = block
    return run


def _order(keys: np.ndarray) -> np.ndarray:
    """The stable order of non-negative keys; short ones are sorted digit by digit."""
    if len(keys) and keys.max() < 1 << 16:
        keys = keys.astype(np.uint16)
    return np.argsort(keys, kind="stable")


class Queue:
    """Tuples in the order of their keys, those of one key as they came; taken from the front in blocks."""

    def __init__(self, memory: int):
        self.memory = memory
        self.runs: list[np.ndarray] = []  # sorted, the older first; runs on disk before those in memory
        self.at: list[int] = []
        self.spilled = 0

    def insert(self, block: np.ndarray) -> None:
        """Adds a block that comes after all earlier ones."""
        if not block.size:
            return
        self.runs.append(np.take(block, _order(block[0]), axis=1))
        self.at.append(0)
        while len(self.runs) - self.spilled > 1 and self._left(-2) < 2 * self._left(-1):
            self._merge(len(self.runs) - 2)
        if sum(self._left(i) for i in range(self.spilled, len(self.runs))) > self.memory:
            self._merge(self.spilled)
            self.runs[-1] = on_disk(self.runs[-1])
            self.spilled += 1

    def add_run(self, run: np.ndarray) -> None:
        """A run that is sorted already, whose keys are shared by no other run's."""
        self.runs.insert(0, run)
        self.at.insert(0, 0)
        self.spilled += 1

    def _left(self, i: int) -> int:
        return self.runs[i].shape[1] - self.at[i]

    def _merge(self, first: int) -> None:
        block = np.concatenate([run[:, at:] for run, at in zip(self.runs[first:], self.at[first:], strict=True)], axis=1)
        del self.runs[first:], self.at[first:]
        self.runs.append(np.take(block, _order(block[0]), axis=1))
        self.at.append(0)

    def peek(self, most: int) -> tuple[np.ndarray, np.ndarray]:
        """The first tuples, about ``most`` of each run, and the run each lies in."""
        heads, told, bound = [], [], None
        for i, run in enumerate(self.runs):
            head = np.asarray(run)[:, self.at[i] : self.at[i] + most]
            if head.size:
                heads.append(head)
                told.append(i)
                if head.shape[1] < self._left(i):
                    last = int(head[0, -1])
                    bound = last if bound is None else min(bound, last)
        if not heads:
            return np.empty((2, 0), np.int64), np.empty(0, np.int64)
        if bound is not None:
            if min(int(head[0, 0]) for head in heads) < bound:
                heads = [head[:, : np.searchsorted(head[0], bound)] for head in heads]
            else:
                # One key fills a head: its tuples in order, up to the first run that has more of it.
                kept = []
                for head, i in zip(heads, told, strict=True):
                    same = int(np.searchsorted(head[0], bound, side="right"))
                    kept.append(head[:, :same])
                    if same == head.shape[1] < self._left(i):
                        break
                heads, told = kept, told[: len(kept)]
        block = np.concatenate(heads, axis=1)
        run_of = np.repeat(told, [head.shape[1] for head in heads])
        order = _order(block[0])
        return np.take(block, order, axis=1), run_of[order]

    def drop(self, run_of: np.ndarray) -> None:
        """Leaves out the first tuples, given the run of each."""
        for i, n in enumerate(np.bincount(run_of, minlength=len(self.runs))):
            self.at[i] += int(n)
        for i in reversed(range(len(self.runs))):
            if not self._left(i):
                self.spilled -= i < self.spilled
                del self.runs[i], self.at[i]

    def drain(self, most: int) -> Iterator[np.ndarray]:
        while self.runs:
            block, run_of = self.peek(most)
            self.drop(run_of)
            yield block


def _least(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The least of ``values[low:high]`` for each pair; ``FAR`` where there is none."""
    out = np.full(len(low), FAR, np.int64)
    table, width, size = values, 1, high - low
    while len(table) and (size >= width).any():
        at = np.flatnonzero((size >= width) & (size < 2 * width))
        out[at] = np.minimum(table[low[at]], table[high[at] - width])
        if len(table) <= width:
            break
        table, width = np.minimum(table[:-width], table[width:]), 2 * width
    return out


def common_prefixes(text: np.ndarray, size: int, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Up to ``most`` symbols that the suffixes at ``a`` and ``b`` share. ``text`` goes on for ``most`` + 8 zeros."""
    words = np.ndarray((len(text) - 7,), "<u8", text, strides=(1,))
    out = np.full(len(a), most, np.int32)
    live = np.arange(len(a))
    for offset in range(0, most, 8):
        apart = words[a[live] + offset] ^ words[b[live] + offset]
        done = np.flatnonzero(apart)
        low = apart[done]
        low &= ~low + np.uint64(1)  # the lowest bit that differs
        bit = np.log2(low.astype(np.float64)).astype(np.int64)
        out[live[done]] = offset + bit // 8
        live = live[apart == 0]
        if not len(live):
            break
    return np.minimum(out, np.minimum(most, size - np.maximum(a, b))).astype(np.int32)


# Takes keys, positions and common prefixes.
Emit = Callable[[np.ndarray, np.ndarray, np.ndarray | None], None]


class Scan:
    """One scan over a string: sorted seeds and what they induce, in order, handed to ``emit`` as keys, positions and common prefixes.

    ``key_of`` gives the bucket of positions: the symbol upwards, its complement
    downwards. Induced tuples of a bucket come before its seeds. With ``most`` = 0
    common prefixes are not kept.
    """

    def __init__(self, symbols: np.ndarray, size: int, top: int, most: int, memory: int, down: bool = False):
        self.symbols, self.size, self.top, self.most, self.memory, self.down = symbols, size, top, most, memory, down

    def key_of(self, pos: np.ndarray) -> np.ndarray:
        symbol = self.symbols[pos].astype(np.int64)
        return self.top - symbol if self.down else symbol

    def run(self, seeds: np.ndarray, emit: Emit) -> None:
        queue = Queue(self.memory)
        if not self.down:
            # The end, smaller than any suffix, induces the last one.
            last = np.array([self.size - 1])
            queue.insert(tuples(2 * self.key_of(last), last, 0))
        queue.add_run(seeds)
        carry = np.full(self.top + 1 if self.most else 0, FAR, np.int64)
        before: tuple[int, int] | None = None  # key and position of the last tuple
        most = STEP
        while queue.runs:
            block, run_of = queue.peek(most)
            induces, key = self._induced(block[0], position(block))
            least = np.minimum.accumulate(np.where(induces, 2 * key, np.iinfo(np.int64).max))
            late = block[0, 1:] > least[:-1]
            size = block.shape[1]
            n = int(np.argmax(late)) + 1 if late.any() else size
            # More at once where all could go, fewer where most had to stay.
            most = min(self.memory, 2 * most) if n == size else max(STEP // 16, most // 2) if 4 * n < size else most
            block, induces, key = block[:, :n], induces[:n], key[:n]
            queue.drop(run_of[:n])
            pos = position(block)
            shared, pending = None, 0
            if self.most:
                shared = self._shared(block, pos, before)
                pending = self._pending(shared, induces, key, carry)
            emit(block[0], pos, shared)
            before = int(block[0, -1]), int(pos[-1])
            queue.insert(tuples(2 * key[induces], pos[induces] - 1, pending))

    def _induced(self, own: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which tuples induce the position before theirs, and its bucket."""
        key = self.key_of(np.maximum(pos - 1, 0))
        # A seed induces into a later bucket only: 2 * key >= own + 1 from its odd key on.
        return (pos > 0) & (2 * key >= own), key

    def _shared(self, block: np.ndarray, pos: np.ndarray, before: tuple[int, int] | None) -> np.ndarray:
        """The common prefix of each tuple with the one before it in the scan."""
        key = block[0]
        earlier = np.concatenate([[-1 if before is None else before[0]], key[:-1]])
        shared = np.where(key == earlier, common(block) + 1 - (key & 1), 0)
        # The first seed after the induced tuples of its bucket: one such place a bucket.
        for i in np.flatnonzero((earlier == key - 1) & (key & 1 == 1)):
            other = int(pos[i - 1]) if i else before[1]
            shared[i] = common_prefixes(self.symbols, self.size, np.array([other]), pos[i : i + 1], self.most)[0]
        return np.minimum(shared, self.most)

    def _pending(self, shared: np.ndarray, induces: np.ndarray, key: np.ndarray, carry: np.ndarray) -> np.ndarray:
        """The least common prefix since the last tuple that induced into the same bucket."""
        at = np.flatnonzero(induces)
        order = _order(key[at])
        place, bucket = at[order], key[at][order]
        first = np.concatenate([[True], bucket[1:] != bucket[:-1]]) if len(bucket) else np.empty(0, bool)
        low = np.where(first, 0, np.concatenate([[0], place[:-1] + 1])) if len(bucket) else place
        least = _least(shared, low, place + 1)
        least[first] = np.minimum(least[first], carry[bucket[first]])
        pending = np.empty(len(at), np.int64)
        pending[order] = least
        np.minimum(carry, shared.min(), out=carry)
        if len(bucket):
            last = np.concatenate([first[1:], [True]])
            ends = place[last] + 1
            carry[bucket[last]] = _least(shared, ends, np.full(len(ends), len(shared)))
        return pending


def _stars(symbols: np.ndarray, size: int) -> np.ndarray:
    """Positions of type S after one of type L, in order; the end is not among them."""
    found, block = [], 1 << 22
    s_after = False  # the last position is larger than the end
    for high in range(size, 0, -block):
        low = max(0, high - block)
        part = symbols[low : min(high + 1, size)].astype(np.int64)
        if high == size:
            part = np.concatenate([part, [-1]])
        rise = part[:-1] < part[1:]
        told = np.flatnonzero(part[:-1] != part[1:])
        after = np.searchsorted(told, np.arange(high - low))
        known = after < len(told)
        s = np.where(known, rise[told[np.minimum(after, len(told) - 1)]] if len(told) else False, s_after)
        # A star is S and the one before it is larger.
        ahead = symbols[max(low - 1, 0) : high - 1].astype(np.int64)
        ahead = np.concatenate([[-1], ahead]) if low == 0 else ahead
        found.append(low + np.flatnonzero(s & (ahead > part[:-1])))
        s_after = bool(s[0])
    out = disk_array(sum(map(len, found)), np.int64)
    np.concatenate([*reversed(found), np.empty(0, np.int64)], out=out)
    return out


def _part_keys(symbols: np.ndarray, size: int, start: np.ndarray, length: np.ndarray, offset: int, top: int) -> tuple[np.ndarray, int]:
    """The next symbols of star substrings as one number each, larger where they have ended, and how many symbols it holds."""
    wide = symbols.dtype == np.uint8
    # The end of the string is 0; numbers are moved up by one, and what has ended is larger than any.
    width, base, pad = (7, 256, PAD) if wide else (2 if top < 1 << 30 else 1, top + 3, top + 2)
    key = np.zeros(len(start), np.int64)
    for step in range(offset, offset + width):
        at = start + step
        symbol = np.where(at < size, symbols[np.minimum(at, size - 1)].astype(np.int64) + (0 if wide else 1), 0)
        key = key * base + np.where(step < length, symbol, pad)
    return key, width


def _names(symbols: np.ndarray, size: int, stars: np.ndarray, top: int, memory: int) -> tuple[np.ndarray, int]:
    """The rank of each star's substring, up to and with the next star, among all; equal ones share it."""
    m = len(stars)
    names = disk_array(m, np.int64)
    order = disk_array(m, np.int64)
    new = disk_array(m, bool)  # whether a place in the order begins another name

    def lengths(index: np.ndarray) -> np.ndarray:
        return np.where(index + 1 < m, stars[np.minimum(index + 1, m - 1)], size) - stars[index] + 1

    queue = Queue(memory)
    width = 1
    for low in range(0, m, memory):
        index = np.arange(low, min(m, low + memory))
        key, width = _part_keys(symbols, size, np.asarray(stars[index]), lengths(index), 0, top)
        queue.insert(tuples(key, index, 0))
    done, last = 0, None
    for block in queue.drain(memory):
        n, key = block.shape[1], block[0]
        order[done : done + n] = position(block)
        new[done : done + n] = np.concatenate([[key[0] != last], key[1:] != key[:-1]])
        done, last = done + n, key[-1]
    offset = width
    # Places whose substrings go on and are not alone yet: the next symbols part them.
    live = np.arange(m)
    while True:
        flag = np.concatenate([new[live], [True]])
        # Neighbours in ``live`` are neighbours in the order or begin another name.
        shared = ~(flag[:-1] & flag[1:])
        live = live[shared]
        if len(live):
            group = np.cumsum(new[live])
            goes_on = lengths(order[live]) > offset
            held = np.bincount(group, weights=goes_on, minlength=int(group[-1]) + 1) > 0
            live = live[held[group]]
        if not len(live):
            break
        group = np.cumsum(new[live])
        index = np.asarray(order[live])
        by_key, by_group = Queue(memory), Queue(memory)
        for low in range(0, len(live), memory):
            part = index[low : low + memory]
            key, width = _part_keys(symbols, size, np.asarray(stars[part]), lengths(part), offset, top)
            by_key.insert(tuples(key, np.arange(low, low + len(part)), 0))
        rank, count, last = np.empty(len(live), np.int64), 0, None
        for block in by_key.drain(memory):
            key, at = block[0], position(block)
            fresh = np.concatenate([[key[0] != last], key[1:] != key[:-1]])
            rank[at] = count + np.cumsum(fresh)
            count, last = count + int(fresh.sum()), key[-1]
            by_group.insert(tuples(group[at], at, 0))
        moved = np.concatenate([position(block) for block in by_group.drain(memory)])
        order[live] = index[moved]
        ranks = rank[moved]
        new[live[1:]] |= (ranks[1:] != ranks[:-1]) & (group[moved][1:] == group[moved][:-1])
        offset += width
    name = -1
    for low in range(0, m, memory):
        part = new[low : low + memory]
        ranks = name + np.cumsum(part)
        names[order[low : low + len(part)]] = ranks
        name = int(ranks[-1])
    return names, name + 1


def _doubled(names: np.ndarray) -> np.ndarray:
    """The suffix order of a string in memory, by doubling prefixes."""
    m = len(names)
    rank = names.astype(np.int64)
    step = 1
    while True:
        after = np.zeros(m, np.int64)
        after[: max(0, m - step)] = rank[step:] + 1
        key = rank * (m + 2) + after
        order = np.argsort(key)
        ranked = key[order]
        fresh = np.concatenate([[0], np.cumsum(ranked[1:] != ranked[:-1])])
        rank = np.empty(m, np.int64)
        rank[order] = fresh
        if fresh[-1] == m - 1:
            return order
        step *= 2


def _star_order(symbols: np.ndarray, size: int, stars: np.ndarray, top: int, memory: int) -> np.ndarray:
    """Indices of the stars in the order of their suffixes."""
    names, count = _names(symbols, size, stars, top, memory)
    m = len(stars)
    if count == m:
        order = disk_array(m, np.int64)
        order[names] = np.arange(m)
        return order
    if m <= memory:
        return _doubled(names)
    order = disk_array(m, np.int64)
    suffix_order(names, m, count - 1, memory, order)
    return order


def _seeds(scan: Scan, blocks: Iterator[tuple[np.ndarray, np.ndarray]], size: int) -> np.ndarray:
    run = disk_array(2 * size, np.int64).reshape(2, size)
    low = 0
    for pos, lcp in blocks:
        run[:, low : low + len(pos)] = tuples(2 * scan.key_of(pos) + 1, pos, lcp)
        low += len(pos)
    return run


def _both_scans(symbols: np.ndarray, size: int, top: int, most: int, memory: int, emit: Emit) -> None:
    """All suffixes to ``emit``, the largest first, with their common prefix with the one before."""
    stars = _stars(symbols, size)
    m = len(stars)
    order = _star_order(symbols, size, stars, top, memory) if m else stars

    def sorted_stars() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for low in range(0, m, memory):
            pos = stars[order[low : low + memory]]
            earlier = np.concatenate([stars[order[max(low - 1, 0) : low]], pos[:-1]])
            lcp = np.zeros(len(pos), np.int64)
            if most:
                lcp[len(pos) - len(earlier) :] = common_prefixes(symbols, size, earlier, pos[len(pos) - len(earlier) :], most)
            yield pos, lcp

    up = Scan(symbols, size, top, most, memory)
    larger = _Gathered(memory)
    up.run(_seeds(up, sorted_stars(), m), larger.add)
    del order, stars

    def largest_first() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        after = 0  # a suffix's common prefix downwards is that of the one that came after it upwards
        for block in larger.backwards():
            lcp = common(block)[::-1]
            yield position(block)[::-1], np.concatenate([[after], lcp[:-1]])
            after = int(lcp[-1])

    down = Scan(symbols, size, top, most, memory, down=True)
    down.run(_seeds(down, largest_first(), larger.size), emit)


class _Gathered:
    """Induced tuples of a scan, in order, on disk."""

    def __init__(self, memory: int):
        self.memory, self.held, self.done, self.size, self.waiting = memory, [], [], 0, 0

    def add(self, key: np.ndarray, pos: np.ndarray, shared: np.ndarray | None) -> None:
        induced = key & 1 == 0
        self.held.append(tuples(key[induced], pos[induced], 0 if shared is None else shared[induced]))
        self.size += self.held[-1].shape[1]
        self.waiting += self.held[-1].shape[1]
        if self.waiting > self.memory:
            self._flush()

    def _flush(self) -> None:
        if self.held:
            self.done.append(on_disk(np.concatenate(self.held, axis=1)))
        self.held, self.waiting = [], 0

    def backwards(self) -> Iterator[np.ndarray]:
        """The blocks, the last first; each is given up once it was taken."""
        self._flush()
        while self.done:
            block = self.done.pop()
            if block.size:
                yield block


def suffix_order(symbols: np.ndarray, size: int, top: int, memory: int, out: np.ndarray) -> None:
    """Writes the suffix order of a string of numbers 0 to ``top`` to ``out``."""
    left = size

    def emit(key: np.ndarray, pos: np.ndarray, shared: np.ndarray | None) -> None:
        nonlocal left
        out[left - len(pos) : left] = pos[::-1]
        left -= len(pos)

    _both_scans(symbols, size, top, 0, memory, emit)


class Text:
    """A byte string on disk, filled piece by piece; a separator follows each piece."""

    def __init__(self, spare: int):
        self.spare, self.size = spare, 0
        self.file = tempfile.TemporaryFile(dir=_folder())  # noqa: SIM115

    def add(self, pieces: list[bytes]) -> None:
        block = b"".join(piece + b"\xff" for piece in pieces)
        # Bytes of UTF-8 are below 0xF8: 0xFF becomes the separator.
        self.file.write((np.frombuffer(block, np.uint8) + np.uint8(SHIFT)).tobytes())
        self.size += len(block)

    def symbols(self) -> np.ndarray:
        self.file.write(bytes(self.spare + 8))
        self.file.flush()
        found = np.memmap(self.file, np.uint8, "r", shape=(self.size + self.spare + 8,))
        self.file.close()
        return found


def repeated_starts(text: Text, length: int, memory: int = MEMORY) -> np.ndarray:
    """Whether the ``length`` bytes from each position on also begin elsewhere in the text."""
    flags = disk_array(text.size, bool)
    symbols = text.symbols()
    before = np.empty(0, np.int64)

    def emit(key: np.ndarray, pos: np.ndarray, shared: np.ndarray | None) -> None:
        nonlocal before
        at = np.flatnonzero(shared >= length)
        flags[pos[at]] = True
        flags[pos[at[at > 0] - 1]] = True
        if len(at) and at[0] == 0 and len(before):
            flags[before] = True
        before = pos[-1:].copy()

    if text.size:
        _both_scans(symbols, text.size, PAD, length, memory, emit)
    return flags
