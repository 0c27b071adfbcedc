"""Vectorised kernels over the bytes of many texts at once.

A *chunk* is a contiguous uint8 array holding the UTF-8 bytes of several whole
texts plus the offsets of each text, taken straight from an Arrow string column
(no Python strings are made).  Every kernel runs over all texts of a chunk with
numpy; chunks hold whole texts and about ``CHUNK_BYTES`` bytes, so temporaries
stay small whatever the Arrow batch size is.  A text longer than that is a
chunk of its own: memory then follows the longest single text.

Nulls read as empty texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20

#: Odd, so that it has an inverse modulo 2**64.
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_BASE_INV = pow(_BASE, -1, 1 << 64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after A-Z are lower-cased.
WORD = np.zeros(256, dtype=bool)
WORD[0x30:0x3A] = WORD[0x61:0x7B] = True
WORD[0x80:] = True
WORD[0x41:0x5B] = True  # upper case counts as its lower case

#: Bytes of words ``[^\x20\x09-\x0D]+``.
TOKEN = np.ones(256, dtype=bool)
TOKEN[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False

_powers: dict[str, np.ndarray] = {}


def _power(base: int, n: int, key: str) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept and grown by doubling."""
    have = _powers.get(key)
    if have is None:
        have = np.ones(1, dtype=np.uint64)
    while len(have) < n:
        step = np.uint64(pow(base, len(have), 1 << 64))
        with np.errstate(over="ignore"):
            have = np.concatenate([have, have * step])
        _powers[key] = have
    return have[:n]


def text_chunks(column: pa.Array | pa.ChunkedArray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) for runs of whole texts of a string column.

    ``offsets`` has one more entry than the run has rows and starts at 0.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if not (pa.types.is_string(column.type) or pa.types.is_large_string(column.type)):
        column = column.cast(pa.string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, dtype=width)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    row = 0
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1
        end = min(n, max(end, row + 1))
        yield row, end, raw[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def spans(buf: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (byte positions in the chunk) of the maximal runs of
    ``table`` bytes that stay inside one text, and the run index where each text begins."""
    if not len(buf):
        z = np.zeros(0, dtype=np.int64)
        return z, z, np.zeros(len(offsets), dtype=np.int64)
    inside = table[buf]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    at = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[at] = inside[at]
    last = inside
    tail = np.empty_like(inside)
    tail[:-1] = last[:-1] & ~inside[1:]
    tail[-1] = last[-1]
    stop = at_end = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    tail[stop] = inside[at_end]
    starts = np.flatnonzero(first)
    ends = np.flatnonzero(tail) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values (in place)."""
    with np.errstate(over="ignore"):
        h ^= h >> np.uint64(33)
        h *= np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(33)
        h *= np.uint64(0xC4CEB9FE1A85EC53)
        h ^= h >> np.uint64(33)
    return h


def prefix_sums(buf: np.ndarray) -> np.ndarray:
    """Prefix sums of byte times base**position modulo 2**64; one more entry than bytes."""
    out = np.zeros(len(buf) + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        term = buf.astype(np.uint64)
        term += np.uint64(1)
        term *= _power(_BASE, len(buf), "up")
        np.cumsum(term, out=out[1:])
    return out


def range_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges, equal for equal bytes wherever they stand."""
    with np.errstate(over="ignore"):
        h = sums[ends] - sums[starts]
        h *= _power(_BASE_INV, len(sums), "down")[starts]
        h += (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return mix(h)


def word_hashes(buf: np.ndarray, offsets: np.ndarray, table: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, starts and ends of the words of a chunk, and each text's first word."""
    low = LOWER[buf] if lower else buf
    starts, ends, first = spans(low, offsets, table)
    return range_hash(prefix_sums(low), starts, ends), starts, ends, first


def word_hash(word: bytes) -> int:
    """The hash that :func:`word_hashes` gives to one (lower-cased) word."""
    raw = np.frombuffer(word, dtype=np.uint8)
    return int(range_hash(prefix_sums(raw), np.array([0]), np.array([len(raw)]))[0])


def run_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k word hashes from each position on (length ``len(words)-k+1``)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        h = np.zeros(n, dtype=np.uint64)
        for i in range(k):
            h *= np.uint64(0x9FB21C651E98DF25)
            h += words[i : i + n]
            h ^= h >> np.uint64(29)
    return mix(h)


def shingles(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of every text, laid end to end, and the offset of each text's.

    A text of fewer than k words, but not none, has one shingle: all its words.
    """
    count = np.diff(first)
    made = np.where(count >= k, count - k + 1, (count > 0).astype(count.dtype))
    at = np.zeros(len(made) + 1, dtype=np.int64)
    np.cumsum(made, out=at[1:])
    out = np.zeros(at[-1], dtype=np.uint64)
    if not len(out):
        return out, at
    whole = run_hashes(words, k)
    long = np.flatnonzero(count >= k)
    if len(long):
        n = made[long]
        source = np.repeat(first[:-1][long] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        target = np.repeat(at[:-1][long] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        out[target] = whole[source]
    for i in np.flatnonzero((count > 0) & (count < k)):
        out[at[i]] = run_hashes(words[first[i] : first[i + 1]], int(count[i]))[0]
    return out, at


def code_points(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Code points of each text: bytes that don't continue a character."""
    lead = np.zeros(len(buf) + 1, dtype=np.int64)
    np.cumsum((buf & 0xC0) != 0x80, out=lead[1:])
    return lead[offsets[1:]] - lead[offsets[:-1]]


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
