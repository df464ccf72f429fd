"""Vectorised word and shingle hashing over Arrow text columns.

Texts are read straight from the Arrow buffers as UTF-8 bytes. A word's hash is a polynomial over its bytes with a random
64-bit value for each byte, mixed at the end, so it depends on the bytes alone: it is the same in every task and run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_rng = np.random.RandomState(20240229)
BYTE = _rng.randint(0, 1 << 62, 256, dtype=np.int64).astype(np.uint64) * np.uint64(4) + np.arange(256, dtype=np.uint64)
SHIFT = (_rng.randint(0, 1 << 62, 16, dtype=np.int64).astype(np.uint64) << np.uint64(1)) | np.uint64(1)
PRIME = np.uint64(0x9E3779B97F4A7C15)

#: Bytes of words: all but space and \t \n \v \f \r.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
SAME = np.arange(256, dtype=np.uint8)
LOWER = SAME.copy()
LOWER[0x41:0x5B] += 0x20

_powers = np.cumprod(np.full(256, PRIME, np.uint64))


def powers(n: int) -> np.ndarray:
    global _powers
    if n > len(_powers):
        _powers = np.cumprod(np.full(2 * n, PRIME, np.uint64))
    return _powers


def mixed(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column and the offsets of its rows (null as empty), starting at 0."""
    col = pc.fill_null(col.cast(pa.large_string()), "")
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = col.buffers()
    offs = np.frombuffer(offs, np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offs - offs[0]


def pieces(data: np.ndarray, offs: np.ndarray, limit: int = 2_000_000) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Ranges of rows with about limit bytes: first row, row after the last, their bytes and offsets."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        yield i, j, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


def _words(data, offs, keep_of, fold):
    keep = keep_of[data]
    first = keep.copy()
    first[1:] &= ~keep[:-1]
    begin = offs[:-1][offs[:-1] < len(data)]
    first[begin] = keep[begin]
    at = np.flatnonzero(first)
    if not len(at):
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, none
    own = fold[data[keep]]
    offset = np.flatnonzero(first[keep])
    lens = np.diff(np.append(offset, len(own)))
    place = np.arange(len(own)) - np.repeat(offset, lens)
    h = np.add.reduceat(BYTE[own] * powers(int(lens.max()))[place], offset)
    return mixed(h + lens.astype(np.uint64)), np.searchsorted(offs, at, "right") - 1, at, lens


def words(data: np.ndarray, offs: np.ndarray, keep_of: np.ndarray = NOT_SPACE, fold: np.ndarray = SAME, limit: int = 4_000_000):
    """For each word: hash, row, place of its first byte and length in bytes. A very long row is hashed in parts cut between words."""
    if len(data) <= limit:
        return _words(data, offs, keep_of, fold)
    found, a = [], 0
    while a < len(data):
        b = min(len(data), a + limit)
        while b < len(data) and (keep_of[ahead := data[b : b + limit]]).all():
            b += len(ahead)
        if b < len(data):
            b += int(np.argmin(keep_of[data[b : b + limit]]))
        inner = offs[(offs > a) & (offs < b)]
        h, row, at, lens = _words(data[a:b], np.concatenate([[0], inner - a, [b - a]]), keep_of, fold)
        found.append((h, np.searchsorted(offs, at + a, "right") - 1, at + a, lens))
        a = b
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def windows(h: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n words in sequence within one row, and the places of their first words."""
    if len(h) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        total += h[k : len(h) - n + 1 + k] * SHIFT[k]
    at = np.flatnonzero(row[: len(h) - n + 1] == row[n - 1 :])
    return mixed(total[at]), at


def shingle_sets(data: np.ndarray, offs: np.ndarray, n: int = 5) -> Iterator[np.ndarray]:
    """For each row the sorted hashes of its distinct n-word shingles, A-Z as a-z; of fewer words all as one; none without words."""
    for _, _, part, own in pieces(data, offs):
        h, row, _, _ = words(part, own, NOT_SPACE, LOWER)
        got, at = windows(h, row, n)
        of = row[at]
        rows = len(own) - 1
        edge = np.searchsorted(of, np.arange(rows + 1))
        begin = np.searchsorted(row, np.arange(rows + 1))
        for i in range(rows):
            if edge[i] < edge[i + 1]:
                yield np.unique(got[edge[i] : edge[i + 1]])
            elif k := begin[i + 1] - begin[i]:
                few = h[begin[i] : begin[i + 1]]
                yield mixed(np.array([np.sum(few * SHIFT[8 : 8 + k], dtype=np.uint64) + np.uint64(k)], np.uint64))
            else:
                yield np.zeros(0, np.uint64)
