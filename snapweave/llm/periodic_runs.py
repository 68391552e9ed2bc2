"""Runs of words that repeat with a period, and texts with the repetitions folded into one period.

A document's words are numbered by their rank in byte order. Under either order of these numbers, the Lyndon
array (the next smaller suffix of every place) comes from one pass with a stack: place j is compared with the
places on the stack until one is smaller. What the compared suffixes have in common is needed for that, and
is kept. It is found in linear time in all, since matched stretches are never read again:

* Neighbours j-1 and j share what is left of the repeated word that starts at j-1.
* If i is compared after k, their common length follows from those of (i, k) and (k, j) unless these are equal.
* Inside the stretch that matched furthest to the right, the same pair one shift to the left has been compared
  before. What it had in common holds here too, up to the stretch's end.

A comparison thus reads words only past the furthest stretch and moves its end. (Let [e, end) be that stretch and
j < end. Where the last rule has no pair to look at, suffixes between i and j lie between those of i and j in
order, and so share with j all that is left of the stretch, which the second rule then gives.)

A run's period is the length of a Lyndon word that starts inside it, under the order in which the word that ends
the run is the smaller one, so both orders give all runs. No suffix array, hash or fingerprint takes part.

Before that, what can't lie in a run of `exponent` periods is left out: past its first period q, a run of at least
`exponent * q` words has every word at most q places after its last occurrence, for (exponent - 1) * q places.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .textbits import blocks, text_buffers


@dataclass(frozen=True)
class RunConfig:
    """Words that a run has at least, and periods that it has at least (2 or more)."""

    least: int = 6
    exponent: int = 4

    def __post_init__(self) -> None:
        if self.exponent < 2 or self.least < 1:
            raise ValueError("a run has at least two periods and one word")


#: Which words of a document to read, from its id and their count: places in order, or None for all as they are.
Arrange = Callable[[int | None, int], "np.ndarray | None"]

RESULT = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def lyndon_array(text: list[int]) -> tuple[list[int], list[int]]:
    """For every place the next smaller suffix (or the end), and the number of words that both suffixes share.

    `text` has numbers of 0 and more; a suffix is smaller than its continuations.
    """
    n = len(text)
    t = [*text, -1]
    following, shared = [n] * n, [0] * n
    before, shared_before = [-1] * n, [0] * n
    same = [0] * (n + 1)  # how many times the number here is repeated right after it
    for i in range(n - 2, -1, -1):
        if t[i] == t[i + 1]:
            same[i] = same[i + 1] + 1
    start = again = end = 0  # the furthest match: [start, ...) equals [again, end)
    for j in range(1, n):
        i = j - 1
        size = same[i]
        if j + size > end:
            start, again, end = i, j, j + size
        while t[i + size] > t[j + size]:
            following[i], shared[i] = j, size
            known, i = shared_before[i], before[i]
            if i < 0:
                break
            if known < size:
                size = known
            elif known == size:
                if i >= again and j < end:
                    shift = again - start
                    a, b = i - shift, j - shift
                    found = shared[a] if following[a] == b else shared_before[b] if before[b] == a else size
                    if found < end - j and found > size:
                        size = found
                        continue
                    size = max(size, min(found, end - j))
                while t[i + size] == t[j + size]:
                    size += 1
                if j + size > end:
                    start, again, end = i, j, j + size
        if i >= 0:
            before[j], shared_before[j] = i, size
    return following, shared


def runs(text: list[int], config: RunConfig) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs that `config` asks for, in order of start and period."""
    found: set[tuple[int, int, int]] = set()
    top = max(text, default=0)
    for order in (text, [top - x for x in text]):
        following, shared = lyndon_array(order)
        ahead, size = np.array(following, np.int64), np.array(shared, np.int64)
        period = ahead - np.arange(len(order))
        for i in np.flatnonzero(size > (config.exponent - 2) * period).tolist():
            j, p, right = following[i], following[i] - i, shared[i]
            if i >= p and following[i - p] == i and shared[i - p] == right + p:
                continue  # not the first such word of its run
            left = 0
            while left < i and order[i - 1 - left] == order[j - 1 - left]:
                left += 1
            if left + p + right >= max(config.least, config.exponent * p):
                found.add((i - left, left + p + right, p))
    return sorted(found, key=lambda x: (x[0], x[2]))


def possible_spans(back: np.ndarray, opening: np.ndarray, config: RunConfig) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the disjoint spans that hold all runs, whole; each lies in one document.

    From the distance to each word's last occurrence in its document (0: none) and the first place of that document.
    """
    rest = config.exponent - 1
    shortest = min(max(config.least, config.exponent * q) - q for q in range(1, config.least + 1))
    at = np.flatnonzero(back > 0)
    for last in [False] * 20 + [True]:  # more rounds would leave out more, but all runs are in what is left after any
        first = np.ones(len(at), bool)
        first[1:] = at[1:] != at[:-1] + 1
        begin = np.flatnonzero(first)
        size = np.diff(np.append(begin, len(at)))
        keep = (rest * back[at] <= np.repeat(size, size)) & (np.repeat(size, size) >= shortest)
        if last or keep.all():
            break
        at = at[keep]
    low, high = np.maximum(at[begin] - size // rest, opening[at[begin]]), at[begin] + size
    if not len(low):
        return low, high
    low = np.minimum.accumulate(low[::-1])[::-1]  # a later, longer span may reach back over several
    first = np.flatnonzero(np.append(True, low[1:] >= high[:-1]))
    return low[first], np.append(high[first[1:] - 1], high[-1])


def _distances(codes: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Distance to the last occurrence of the word in its document; 0 where there is none."""
    key = owner * (int(codes.max(initial=0)) + 1) + codes
    order = np.argsort(key, kind="stable")
    back = np.zeros(len(codes), np.int64)
    equal = key[order[1:]] == key[order[:-1]]
    back[order[1:][equal]] = (order[1:] - order[:-1])[equal]
    return back


def block_runs(documents: list[list[bytes]], config: RunConfig) -> list[list[tuple[int, int, int]]]:
    """Runs of each document of a block."""
    sizes = np.array([len(x) for x in documents], np.int64)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    found: list[list[tuple[int, int, int]]] = [[] for _ in documents]
    words = [w for x in documents for w in x]
    if not words:
        return found
    codes = pc.rank(pa.array(words, pa.large_binary()), sort_keys="ascending", tiebreaker="dense").to_numpy().astype(np.int64)
    owner = np.repeat(np.arange(len(documents)), sizes)
    low, high = possible_spans(_distances(codes, owner), offsets[owner], config)
    for k, a, b in zip(owner[low].tolist(), low.tolist(), high.tolist(), strict=True):
        shift = a - int(offsets[k])
        found[k] += [(s + shift, n, p) for s, n, p in runs((codes[a:b] - 1).tolist(), config)]
    return found


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run holds after its first period."""
    if not found:
        return words
    gone = np.zeros(len(words) + 1, np.int64)
    for start, length, period in found:
        gone[start + period] += 1
        gone[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(gone[:-1]) == 0).tolist()]


def _find(config: RunConfig, arrange: Arrange | None):
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column("text"))
            ids = batch.column("doc_id").to_pylist()
            for i, j in blocks(offsets):
                raw, at = data[offsets[i] : offsets[j]].tobytes(), (offsets[i : j + 1] - offsets[i]).tolist()
                documents = [raw[a:b].split() for a, b in zip(at[:-1], at[1:], strict=True)]  # at ASCII white space
                if arrange is not None:
                    for k, doc_id in enumerate(ids[i:j]):
                        if (places := arrange(doc_id, len(documents[k]))) is not None:
                            documents[k] = [documents[k][x] for x in places.tolist()]
                found = block_runs(documents, config)
                values = [x for each in found for x in each]
                columns = [pa.array([x[c] for x in values], pa.int64()) for c in range(3)]
                ends = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(columns, fields=list(kind.value_type)), type=kind)
                texts = pa.array([b" ".join(collapsed(w, f)) for w, f in zip(documents, found, strict=True)], pa.binary())
                sizes = pa.array([len(x) for x in documents], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[i:j], sizes, lists, texts.view(pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])

    return run


def find_runs(docs: DataFrame, config: RunConfig, arrange: Arrange | None = None) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, n_words, runs (start, length, period), collapsed.

    Words stand between ASCII white space and are numbered from 0. A run is a stretch with smallest period
    `period` that no neighbouring word extends, of at least `least` words and `exponent` periods; runs are in
    order of start and period. `collapsed` has the words that no run holds after its first period, joined by one
    space. Null and empty texts have no words, no runs and an empty `collapsed`. Null and repeated doc_ids are rows like
    any other; other columns are ignored; an empty table gives an empty result. A text is handled whole in one
    task, in memory of a few hundred bytes for each of its words.
    """
    return docs.select("doc_id", "text").selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(_find(config, arrange), RESULT)
