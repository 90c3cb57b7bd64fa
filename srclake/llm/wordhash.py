"""Vectorised word hashing over Arrow string columns.

A word is a maximal run of bytes outside a separator set. Every word of a whole
batch gets a 64-bit polynomial hash (random byte values, odd base, arithmetic
modulo 2**64, then a final mix) through prefix sums, with no Python object per
word. Multi-byte characters are safe: separators are ASCII only.
"""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_PIECE = 1 << 18  # bytes hashed at once; bounds memory, not the text
_BASE = 0x9E3779B97F4A7C15 | 1
_RNG = np.random.default_rng(20240607)
_VALUES = _RNG.integers(1, 2**63 - 1, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POW: dict[str, np.ndarray] = {}


def slices(batches, at: int, size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Every row of the batches, in slices with about ``size`` bytes in text column ``at`` (more for a longer text)."""
    _libc()
    try:
        for batch in batches:
            total = np.cumsum(pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            step = 0
            while step < len(total):
                done = total[step - 1] if step else 0
                n = max(1, int(np.searchsorted(total[step:], done + size)))
                yield batch.slice(step, n)
                step += n
    finally:
        trim()


def strings(texts: pa.Array) -> list[str | None]:
    """The texts as Python has them; bytes that are no UTF-8, which Spark lets pass, as lone surrogates."""
    try:
        return texts.to_pylist()
    except UnicodeDecodeError:
        return [None if t is None else t.decode(errors="surrogateescape") for t in texts.cast(pa.large_binary()).to_pylist()]


def array(texts: list[str | None], kind: pa.DataType) -> pa.Array:
    """The Arrow column of what ``strings`` gave, with the bytes of old for lone surrogates."""
    try:
        return pa.array(texts, kind)
    except UnicodeEncodeError:
        raw = [None if t is None else t.encode(errors="surrogateescape") for t in texts]
        return pa.array(raw, pa.large_binary() if pa.types.is_large_string(kind) else pa.binary()).view(kind)


_LIBC: list = []


def _libc():
    """The C library of a worker, told once to return every large block as soon as it is free; None where there is another."""
    if not _LIBC:
        pa.set_memory_pool(pa.system_memory_pool())
        try:
            _LIBC.append(ctypes.CDLL("libc.so.6") if sys.platform == "linux" else None)
            if _LIBC[0]:
                _LIBC[0].mallopt(-3, 4 << 20)  # M_MMAP_THRESHOLD: fixed, or it grows with what is freed
                _LIBC[0].mallopt(-1, 32 << 20)  # M_TRIM_THRESHOLD: so much may stay for the next arrays
        except (OSError, AttributeError):  # another C library
            _LIBC[:] = [None]
    return _LIBC[0]


def trim() -> None:
    """Give freed memory back to the system: a worker lives on and must not hold what its last task needed."""
    pa.default_memory_pool().release_unused()
    if libc := _libc():
        libc.malloc_trim(0)


def table(separators: bytes | set[int]) -> np.ndarray:
    """256 hash values by byte: 0 for separators, A-Z as a-z."""
    t = _VALUES.copy()
    t[65:91] = t[97:123]
    t[list(separators)] = 0
    return t


#: Words are runs without white space of ASCII.
SPACE_TABLE = table({0x20, *range(0x09, 0x0E)})
#: Words are runs of digits, letters and everything beyond ASCII.
ALNUM_TABLE = table({*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)})


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POW or len(_POW["up"]) < n:
        size = max(n, _PIECE + 1)
        up = np.full(size, _BASE, dtype=np.uint64)
        down = np.full(size, pow(_BASE, -1, 1 << 64), dtype=np.uint64)
        up[0] = down[0] = 1
        _POW["up"], _POW["down"] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _POW["up"], _POW["down"]


def _buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string array; null texts have no bytes."""
    texts = texts.fill_null("").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def _pieces(raw: np.ndarray, offsets: np.ndarray, t: np.ndarray) -> Iterator[tuple[int, int]]:
    """Byte ranges of about _PIECE that end at the end of a text or before a separator."""
    at, end = 0, len(raw)
    while at < end:
        to = min(at + _PIECE, end)
        if to < end:
            edge = offsets[np.searchsorted(offsets, to, side="right") - 1]
            if edge > at:
                to = int(edge)
            else:  # one text is longer than a piece: cut at a separator, further on if need be
                back = np.flatnonzero(t[raw[at + 1 : to]] == 0)
                if len(back):
                    to = at + 1 + int(back[-1])
                else:
                    stop = int(offsets[np.searchsorted(offsets, at, side="right")])
                    ahead = np.flatnonzero(t[raw[to:stop]] == 0)
                    to = to + int(ahead[0]) if len(ahead) else stop
        yield at, to
        at = to


#: Classes by byte: 1 letters, 2 punctuation between which and a letter no token reaches, 0 the rest.
_KINDS = np.zeros(256, dtype=np.uint8)
_KINDS[[*range(65, 91), *range(97, 123)]] = 1
_KINDS[[b for b in range(0x21, 0x7F) if not chr(b).isalnum() and chr(b) not in "'<|>"]] = 2


def _spans(raw: np.ndarray, offsets: np.ndarray, t: np.ndarray, parts: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and end of every word; with ``parts``, words also end where _KINDS goes from 1 to 2 or back."""
    found = [(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for a, b in _pieces(raw, offsets, t):
        v = t[raw[a:b]]
        word = v != 0
        edge = np.zeros(b - a + 1, dtype=bool)
        edge[0] = edge[-1] = True
        edge[offsets[np.searchsorted(offsets, a) : np.searchsorted(offsets, b, side="right")] - a] = True
        if parts:
            k = _KINDS[raw[a:b]]
            edge[1:-1] |= k[:-1] + k[1:] == 3
        edge[1:-1] |= word[:-1] != word[1:]
        start = np.flatnonzero(word & edge[:-1])
        if not len(start):
            continue
        stop = np.flatnonzero(word & edge[1:]) + 1
        up, down = _powers(b - a + 1)
        sums = np.zeros(b - a + 1, dtype=np.uint64)
        np.cumsum(v * up[: b - a], out=sums[1:])
        found.append((mix((sums[stop] - sums[start]) * down[start]), start + a, stop + a))
    return tuple(np.concatenate(x) for x in zip(*found))


def words(texts: pa.Array, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and for each text where its words begin (length n + 1)."""
    raw, offsets = _buffers(texts)
    hashes, start, _ = _spans(raw, offsets, t, False)
    return hashes, np.searchsorted(start, offsets)


def parts(texts: pa.Array, t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As ``words``, with letters and punctuation apart: hashes, begins, first bytes, ends, and the bytes."""
    raw, offsets = _buffers(texts)
    hashes, start, stop = _spans(raw, offsets, t, True)
    return hashes, np.searchsorted(start, offsets), start, stop, raw


def shingles(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words; of the whole sequence when it is shorter; none without words."""
    if not len(h):
        return h
    k = min(n, len(h))
    total = np.zeros(len(h) - k + 1, dtype=np.uint64)
    for j in range(k):
        total = total * np.uint64(0xD6E8FEB86659FD93) + h[j : len(h) - k + 1 + j]
    return mix(total + np.uint64(k))


def grams(texts: pa.Array, t: np.ndarray, sizes: tuple[int, ...]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text number, hash) of every word, then of every word's first k bytes for each k, piece by piece."""
    raw, offsets = _buffers(texts)
    for a, b in _pieces(raw, offsets, t):
        v = t[raw[a:b]]
        word = v != 0
        edge = np.zeros(b - a + 1, dtype=bool)
        edge[0] = edge[-1] = True
        edge[offsets[np.searchsorted(offsets, a) : np.searchsorted(offsets, b, side="right")] - a] = True
        edge[1:-1] |= word[:-1] != word[1:]
        start = np.flatnonzero(word & edge[:-1])
        if not len(start):
            continue
        stop = np.flatnonzero(word & edge[1:]) + 1
        doc = np.searchsorted(offsets, start + a, side="right") - 1
        up, down = _powers(b - a + 1)
        sums = np.zeros(b - a + 1, dtype=np.uint64)
        np.cumsum(v * up[: b - a], out=sums[1:])
        yield doc, mix((sums[stop] - sums[start]) * down[start])
        for k in sizes:
            keep = stop - start > k
            s = start[keep]
            yield doc[keep], mix((sums[s + k] - sums[s]) * down[s] + np.uint64(k))
