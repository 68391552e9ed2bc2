"""Vectorised hashing of words and byte windows over the text buffers of Arrow batches."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_BASE = U64(0x9E3779B97F4A7C15)
_powers: list[np.ndarray] = []
#: Bytes up to which a word's hash is polynomial. Powers of an odd base modulo 2**64 repeat their low bits, so longer
#: spans of a regular pattern could meet in one value; they are hashed by BLAKE2b.
LONG_WORD = 32

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse, modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        found = []
        for factor in (int(_BASE), pow(int(_BASE), -1, 1 << 64)):
            steps = np.full(max(n, 1 << 16), U64(factor), U64)
            steps[0] = 1
            found.append(np.multiply.accumulate(steps))
        _powers[:] = found
    up, down = _powers
    return up[:n], down[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words."""
    x = x ^ (x >> U64(32))
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    return x


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Sums whose differences are polynomial hashes of the spans of `data`."""
    up, _ = powers(len(data))
    out = np.zeros(len(data) + 1, U64)
    np.cumsum((data.astype(U64) + U64(1)) * up, out=out[1:])
    return out


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans [start, end) of `data`."""
    sums = prefix_sums(data)
    _, down = powers(len(sums))
    out = mix((sums[end] - sums[start]) * down[start] + (end - start).astype(U64))
    long = np.flatnonzero(end - start > LONG_WORD)
    if len(long):
        out[long] = digests(data, start[long], end[long], 8)[:, 0]
    return out


def digests(data: np.ndarray, start: np.ndarray, end: np.ndarray, size: int) -> np.ndarray:
    """BLAKE2b digests of `size` bytes of the spans [start, end), as rows of 64-bit words."""
    raw = data.tobytes()
    found = b"".join([hashlib.blake2b(raw[a:b], digest_size=size).digest() for a, b in zip(start.tolist(), end.tolist(), strict=True)])
    return np.frombuffer(found, "<u8").reshape(-1, size // 8)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, int64 offsets); null texts are empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def blocks(offsets: np.ndarray, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Runs of whole documents with at most `limit` bytes, or one longer document."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and document numbers of the words between ASCII white space."""
    solid = ~SPACE[data]
    if not len(data):
        return (np.zeros(0, np.int64),) * 3
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]  # a word ends where its document does
    first[edges] = solid[edges]
    last[edges - 1] = solid[edges - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


def shingle_hashes(word_hash: np.ndarray, owner: np.ndarray, width: int, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and documents of all runs of `width` words; a shorter document is one run of all its words."""
    count = np.bincount(owner, minlength=n_docs)
    factors = mix(np.arange(1, width + 1, dtype=U64) * _BASE) | U64(1)
    n = len(word_hash)
    if n >= width:
        whole = owner[: n - width + 1] == owner[width - 1 :]
        total = np.zeros(n - width + 1, U64)
        for k in range(width):
            total += word_hash[k : n - width + 1 + k] * factors[k]
        hashes, docs = mix(total[whole]), owner[: n - width + 1][whole]
    else:
        hashes, docs = np.zeros(0, U64), np.zeros(0, np.int64)
    short = np.flatnonzero((count > 0) & (count < width))
    if len(short):
        begin = np.searchsorted(owner, short)
        total = count[short].astype(U64) * _BASE
        for k in range(width - 1):
            has = count[short] > k
            total[has] += word_hash[begin[has] + k] * factors[k]
        hashes, docs = np.concatenate([hashes, mix(total)]), np.concatenate([docs, short])
    return hashes, docs


def document_sets(column: pa.Array, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row number, sorted distinct shingle hashes) of every text."""
    data, offsets = text_buffers(column)
    for i, j in blocks(offsets):
        part = LOWER[data[offsets[i] : offsets[j]]]
        at = offsets[i : j + 1] - offsets[i]
        start, end, owner = words(part, at)
        hashes, docs = shingle_hashes(word_hashes(part, start, end), owner, width, j - i)
        order = np.argsort(docs, kind="stable")
        cuts = np.searchsorted(docs[order], np.arange(j - i + 1))
        hashes = hashes[order]
        for k in range(j - i):
            yield i + k, np.unique(hashes[cuts[k] : cuts[k + 1]])


def block_words(data: np.ndarray, cuts: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct words as bytes, number of each word in that list, document numbers, starts, ends) of a block of texts."""
    start, end, owner = words(data, cuts)
    _, index, inverse = np.unique(word_hashes(data, start, end), return_index=True, return_inverse=True)
    raw = data.tobytes()
    return [raw[a:b] for a, b in zip(start[index].tolist(), end[index].tolist(), strict=True)], inverse, owner, start, end


def bare_word(word: bytes) -> str:
    """A word in lower case without what isn't a letter or digit at its ends."""
    text = word.decode("utf-8", "replace").lower()
    if text.isalnum():
        return text
    a, b = 0, len(text)
    while a < b and not text[a].isalnum():
        a += 1
    while b > a and not text[b - 1].isalnum():
        b -= 1
    return text[a:b]
