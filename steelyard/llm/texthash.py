"""Numpy helpers on the UTF-8 bytes of Arrow columns: chunks, words and rolling fingerprints."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts are handled together up to so many bytes; a longer text is a chunk by itself.
CHUNK = 1 << 20
#: Base of the polynomial and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)

_BYTES = np.random.default_rng(2024).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SEPARATOR = np.zeros(256, dtype=bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts of a string or binary column, null as empty, and the n + 1 offsets."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return (data[offsets[0] : offsets[-1]], offsets - offsets[0]) if len(offsets) else (data[:0], np.zeros(1, dtype=np.int64))


def chunks(offsets: np.ndarray, most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of texts of ``most`` bytes together, one text at least."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
        yield at, min(to, n)
        at = to


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i in 0 .. n - 1 at least."""
    if not _POWERS or len(_POWERS[0][0]) < n:
        n = max(n, CHUNK + 1)
        up, down = np.full(n, BASE, dtype=np.uint64), np.full(n, INVERSE, dtype=np.uint64)
        up[0] = down[0] = 1
        _POWERS[0] = np.cumprod(up), np.cumprod(down)
    return _POWERS[0]


def prefixes(data: np.ndarray) -> np.ndarray:
    """Polynomial hashes of all prefixes, n + 1 values modulo 2**64."""
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTES[data] * powers(len(data) + 1)[0][: len(data)], out=out[1:])
    return out


def spans(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Fingerprints of data[start:end], by content alone."""
    return mix((prefix[end] - prefix[start]) * powers(len(prefix))[1][start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+`` of the texts, and each text's first word (n + 1)."""
    inside = ~_SEPARATOR[data]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    start[heads] = inside[heads]
    end = inside.copy()
    end[:-1] &= ~inside[1:]
    tails = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    end[tails] = inside[tails]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offsets)


def ngrams(hashes: np.ndarray, first: np.ndarray, n: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams of each text's items and each text's first n-gram; a text of fewer items has
    one n-gram of all of them, one without items none."""
    lengths = np.diff(first)
    count = np.where(lengths >= n, lengths - n + 1, (lengths > 0).astype(lengths.dtype))
    firsts = np.concatenate([[0], np.cumsum(count)])
    at = np.arange(firsts[-1]) + np.repeat(first[:-1] - firsts[:-1], count)
    last = np.repeat(first[1:], count)
    out = np.full(len(at), (seed * 2 + 1) * 0x9FB21C651E98DF25 % 2**64, dtype=np.uint64)
    for k in range(n):
        more = at + k < last
        out = np.where(more, mix(out ^ hashes[np.minimum(at + k, max(len(hashes) - 1, 0))]) if len(hashes) else out, out)
    return out, firsts
