"""External induced suffix sorting with common-prefix values.

Suffixes are sorted by induction: those that start a rise (here *peaks' feet*:
a suffix smaller than its right neighbour whose left neighbour is larger) are
sorted first, and the order of all others follows in two scans, a suffix taken
from the queue placing the one a symbol longer.  The queues are priority queues
over the first symbol, first in, first out within one, and keep their entries
(position, common-prefix value) on disk beyond a bound of memory.  A common
prefix is carried along: the entry placed shares one symbol more with the entry
placed before it than the least common prefix met between their two sources.

The feet themselves are sorted by recursion: one induction without prefix values
sorts the pieces between feet, pieces get names, and the string of names is
ranked over ever longer runs of names (each round sorts tuples of two ranks)
until all ranks differ or runs are longer than any prefix that matters.

All steps run on numpy blocks; only the text and two bits per suffix are
addressed at random, and they are memory-mapped beyond the same bound.
"""

from __future__ import annotations

import tempfile
from collections import deque
from collections.abc import Iterator

import numpy as np

from frametally.llm import bytekernels as bk

#: Symbols: the end of everything, the end of a text, then the bytes.
END, SEP, SHIFT = 0, 1, 2
SYMBOLS = 256 + SHIFT
#: Entries in a block.
BLOCK = 1 << 18


class DiskQueues:
    """First-in first-out queues of (position, prefix) blocks, one for each symbol.

    Beyond ``memory`` bytes the fullest queue's blocks go to a temporary file.
    """

    def __init__(self, memory: int):
        self.memory, self.held = memory, 0
        self.blocks: list[deque] = [deque() for _ in range(SYMBOLS)]
        self.size = np.zeros(SYMBOLS, dtype=np.int64)  # bytes in memory
        self.file = None

    def push(self, symbol: int, position: np.ndarray, prefix: np.ndarray | None) -> None:
        for i in range(0, len(position), BLOCK):
            block = (position[i : i + BLOCK], None if prefix is None else prefix[i : i + BLOCK])
            n = sum(x.nbytes for x in block if x is not None)
            self.blocks[symbol].append(block)
            self.size[symbol] += n
            self.held += n
        while self.held > self.memory and self.size.max() > 0:
            self._spill(int(self.size.argmax()))

    def _spill(self, symbol: int) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        for i, block in enumerate(self.blocks[symbol]):
            if isinstance(block, tuple):
                at = self.file.seek(0, 2)
                for x in block:
                    if x is not None:
                        x.tofile(self.file)
                self.blocks[symbol][i] = [at, len(block[0]), block[0].dtype, None if block[1] is None else block[1].dtype]
        self.held -= int(self.size[symbol])
        self.size[symbol] = 0

    def pop(self, symbol: int, last: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """The first blocks (the last ones, if last) of about BLOCK entries, joined."""
        queue, own, entries = self.blocks[symbol], [], 0
        while queue and entries < BLOCK:
            block = queue.pop() if last else queue.popleft()
            if isinstance(block, tuple):
                n = sum(x.nbytes for x in block if x is not None)
                self.size[symbol] -= n
                self.held -= n
            else:
                at, n, kind, prefix = block
                self.file.flush()
                self.file.seek(at)
                block = np.fromfile(self.file, kind, n), None if prefix is None else np.fromfile(self.file, prefix, n)
            own.append(block)
            entries += len(block[0])
        if last:
            own.reverse()
        if len(own) == 1:
            return own[0]
        position, prefix = zip(*own)
        return np.concatenate(position), None if prefix[0] is None else np.concatenate(prefix)

    def __contains__(self, symbol: int) -> bool:
        return bool(self.blocks[symbol])

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


def _least(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Minimum of values[low..high] (inclusive) of every pair, by doubling."""
    out = np.empty(len(low), dtype=values.dtype)
    span = np.frexp((high - low + 1).astype(float))[1] - 1
    table, width = values, 1
    for level in range(int(span.max()) + 1 if len(span) else 0):
        own = np.flatnonzero(span == level)
        if len(own):
            out[own] = np.minimum(table[low[own]], table[high[own] - width + 1])
        if len(table) > width:
            table = np.minimum(table[:-width], table[width:])
        width *= 2
    return out


class Scan:
    """Places, for each scanned suffix, the one that begins a symbol earlier."""

    def __init__(self, text: np.ndarray, rising: np.ndarray, wanted: bool, queues: DiskQueues, limit: int | None):
        self.text, self.rising, self.wanted, self.queues, self.limit = text, rising, wanted, queues, limit
        self.since = np.zeros(SYMBOLS, dtype=np.uint16)  # least prefix met since the last entry placed under a symbol
        self.fresh = np.ones(SYMBOLS, dtype=bool)

    def block(self, position: np.ndarray, prefix: np.ndarray | None) -> None:
        before = position - 1
        ok = np.flatnonzero((position > 0) & (self.rising[before] == self.wanted))
        if self.limit is None:
            if len(ok):
                q = before[ok]
                first = self.text[q]
                order = np.argsort(first, kind="stable")
                cut = np.flatnonzero(np.diff(first[order])) + 1
                for part in np.split(q[order], cut):
                    self.queues.push(int(self.text[part[0]]), part, None)
            return
        if not len(ok):
            if len(prefix):
                np.minimum(self.since, prefix.min(), out=self.since)
            return
        q = before[ok]
        first = self.text[q]
        order = np.argsort(first, kind="stable")
        at, symbol, q = ok[order], first[order], q[order]
        head = np.ones(len(at), dtype=bool)
        head[1:] = symbol[1:] != symbol[:-1]
        low = np.zeros(len(at), dtype=np.int64)
        low[1:] = at[:-1] + 1
        low[head] = 0
        found = _least(prefix, low, at)
        heads = np.flatnonzero(head)
        own = symbol[heads]
        found[heads] = np.where(self.fresh[own], 0, np.minimum(found[heads], self.since[own]))
        value = np.minimum(found + np.uint16(1), np.uint16(self.limit)).astype(np.uint16)
        value[heads[self.fresh[own]]] = 0
        self.fresh[own] = False
        np.minimum(self.since, prefix.min(), out=self.since)
        tails = np.concatenate([heads[1:], [len(at)]]) - 1
        after = at[tails] + 1
        rest = np.full(len(own), np.iinfo(np.uint16).max, dtype=np.uint16)
        some = np.flatnonzero(after < len(prefix))
        if len(some):
            rest[some] = _least(prefix, after[some], np.full(len(some), len(prefix) - 1))
        self.since[own] = rest
        for s, a, b in zip(own.tolist(), heads.tolist(), (tails + 1).tolist()):
            self.queues.push(s, q[a:b], value[a:b])


def common_prefix(words: np.ndarray, a: np.ndarray, b: np.ndarray, limit: int) -> np.ndarray:
    """Symbols that suffixes a and b share, at most limit.  words: four symbols from each position."""
    out = np.full(len(a), limit, dtype=np.uint16)
    live = np.arange(len(a))
    for at in range(0, limit, 4):
        x = words[np.minimum(a[live] + at, len(words) - 1)] ^ words[np.minimum(b[live] + at, len(words) - 1)]
        gone = np.flatnonzero(x)
        if len(gone):
            low = x[gone] & (~x[gone] + np.uint64(1))
            out[live[gone]] = np.minimum(at + (np.frexp(low.astype(float))[1] - 1) // 16, limit)
            live = live[x == 0]
            if not len(live):
                break
    return out


def _induce(text: np.ndarray, rising: np.ndarray, feet: np.ndarray, prefix: np.ndarray | None, words: np.ndarray | None, limit: int | None, memory: int) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
    """All suffixes in falling order, in blocks, given the feet in rising order.

    With prefix values each entry's value is that shared with the entry before
    it in falling order.
    """
    carry = prefix is not None

    def touching(a: int, b: int) -> np.uint16:
        return common_prefix(words, np.array([a]), np.array([b]), limit)[0]

    bounds = np.searchsorted(text[feet], np.arange(SYMBOLS + 1))
    falling, placed, done = DiskQueues(memory), DiskQueues(memory), DiskQueues(memory)
    try:
        scan = Scan(text, rising, False, falling, limit if carry else None)
        for symbol in range(SYMBOLS):
            last = -1
            while symbol in falling:
                block = falling.pop(symbol)
                done.push(symbol, *block)
                scan.block(*block)
                last = int(block[0][-1])
            a, b = bounds[symbol], bounds[symbol + 1]
            for i in range(a, b, BLOCK):
                own = feet[i : min(b, i + BLOCK)]
                values = None
                if carry:
                    values = prefix[i : i + len(own)].copy()
                    if i == a:
                        values[0] = touching(last, int(own[0])) if last >= 0 else 0
                scan.block(own, values)
        placed.push(END, np.array([len(text) - 1], dtype=feet.dtype), np.zeros(1, np.uint16) if carry else None)
        scan = Scan(text, rising, True, placed, limit if carry else None)
        for symbol in range(SYMBOLS - 1, -1, -1):
            last = -1
            while symbol in placed:
                block = placed.pop(symbol)
                scan.block(*block)
                last = int(block[0][-1])
                yield block
            bridge = None
            while symbol in done:
                position, values = done.pop(symbol, last=True)
                position = position[::-1]
                if carry:
                    # turned round, a value belongs to the entry after
                    head = touching(last, int(position[0])) if bridge is None and last >= 0 else np.uint16(0) if bridge is None else bridge
                    bridge = values[0]
                    values = np.concatenate([np.array([head], dtype=np.uint16), values[:0:-1]])
                scan.block(position, values)
                yield position, values
    finally:
        for q in (falling, placed, done):
            q.close()


def _rank_names(names: np.ndarray, rounds: int) -> np.ndarray:
    """Order of the suffixes of a string of names, as far as 2**rounds names tell."""
    order = np.argsort(names, kind="stable")
    rank = np.empty(len(names), dtype=np.int64)

    def give(order: np.ndarray, new: np.ndarray, start: np.ndarray) -> None:
        first = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
        rank[order] = start + first

    v = names[order]
    new = np.ones(len(v), dtype=bool)
    new[1:] = v[1:] != v[:-1]
    give(order, new, np.zeros(1, dtype=np.int64))
    step = 1
    slot = np.arange(len(names))  # places in order that aren't settled
    for _ in range(rounds):
        alone = new.copy()
        alone[:-1] &= new[1:]
        slot = slot[~alone]
        if not len(slot):
            break
        own = order[slot]
        later = np.where(own + step < len(names), rank[np.minimum(own + step, len(names) - 1)] + 1, 0)
        by = np.lexsort((later, rank[own]))
        own, later = own[by], later[by]
        order[slot] = own
        r = rank[own]
        new = np.ones(len(own), dtype=bool)
        new[1:] = (r[1:] != r[:-1]) | (later[1:] != later[:-1])
        rank[own] = slot[np.maximum.accumulate(np.where(new, np.arange(len(own)), 0))]
        step *= 2
    return order


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all texts, each with its end, and where each text begins."""
    begin = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=begin[1:])
    out = np.empty(begin[-1] + 1, dtype=np.uint16)
    out[:-1] = np.frombuffer(b"\0".join(texts) + b"\0", dtype=np.uint8) if texts else 0
    out[:-1] += SHIFT
    out[begin[1:] - 1] = SEP
    out[-1] = END
    return out, begin[:-1]


def _mapped(x: np.ndarray, memory: int) -> np.ndarray:
    if x.nbytes <= memory:
        return x
    file = tempfile.TemporaryFile()
    x.tofile(file)
    file.flush()
    return np.memmap(file, dtype=x.dtype, mode="r", shape=x.shape)


def sorted_suffixes(text: np.ndarray, limit: int, memory: int = 256 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of (positions, prefixes) of all suffixes of ``text``, in falling order.

    Suffixes are in order as far as their first ``limit`` symbols go; a prefix
    is what an entry shares with the one before it, at most ``limit``.
    """
    n = len(text)
    kind = np.int32 if n < 1 << 31 else np.int64
    if n == 1:
        yield np.zeros(1, kind), np.zeros(1, np.uint16)
        return
    step = np.sign(np.diff(text.astype(np.int32)))
    turn = np.flatnonzero(step)
    rising = np.ones(n, dtype=bool)
    rising[:-1] = step[turn[np.searchsorted(turn, np.arange(n - 1))]] > 0
    del step
    foot = rising.copy()
    foot[0] = False
    foot[1:] &= ~rising[:-1]
    places = np.flatnonzero(foot).astype(kind)
    words = np.zeros(n + 4, dtype=np.uint64)
    for i in range(4):
        words[: n - i] |= text[i:].astype(np.uint64) << np.uint64(16 * i)
    text, words = _mapped(text, memory), _mapped(words, memory)
    # pieces in order, by an induction from feet that are in order of first symbol only
    start = places[np.argsort(text[places], kind="stable")]
    pieces = np.empty(len(places), dtype=kind)
    at = len(places)
    for position, _ in _induce(text, rising, start, None, None, None, memory):
        own = position[foot[position]]
        at -= len(own)
        pieces[at : at + len(own)] = own[::-1]
    index = np.empty(n if len(places) else 0, dtype=kind)
    index[places] = np.arange(len(places), dtype=kind)
    stop = np.minimum(np.append(places[1:], n - 1) + 1, n)
    # symbols fit no byte: two hashes of bytes tell pieces apart
    sums = bk.prefix_sums(text)
    end = stop[index[pieces]]
    h = bk.range_hash(sums, pieces.astype(np.int64), end.astype(np.int64))
    new = np.ones(len(pieces), dtype=bool)
    new[1:] = h[1:] != h[:-1]
    del sums
    names = np.empty(len(places), dtype=np.int64)
    names[index[pieces]] = np.cumsum(new)
    order = _rank_names(names, int(np.ceil(np.log2(limit))) + 1) if not new.all() else index[pieces]
    feet = places[order]
    prefix = np.zeros(len(feet), dtype=np.uint16)
    prefix[1:] = common_prefix(words, feet[:-1], feet[1:], limit)
    yield from _induce(text, rising, feet, prefix, words, limit, memory)


def repeated_starts(texts: list[bytes], length: int, memory: int = 256 << 20) -> list[np.ndarray]:
    """For each text, the rising places at which a string of ``length`` bytes
    starts that also starts anywhere else in the texts."""
    text, begin = joined(texts)
    hit = np.zeros(len(text), dtype=bool)
    last = None
    for position, prefix in sorted_suffixes(text, length, memory):
        same = np.flatnonzero(prefix >= length)
        hit[position[same]] = True
        hit[position[same[same > 0] - 1]] = True
        if len(same) and same[0] == 0 and last is not None:
            hit[last] = True
        last = position[-1]
    out = []
    for t, b in zip(texts, begin.tolist()):
        most = max(0, len(t) - length + 1)
        out.append(np.flatnonzero(hit[b : b + most]))
    return out
