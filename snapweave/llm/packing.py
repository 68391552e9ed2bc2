"""Mixture-controlled packing: deficit round-robin over source queues into windows of fixed length.

The tokens of each source form one queue. Every window takes from each queue, in turn, the tokens that the
target mixture owes it; what rounding leaves is a deficit that the queue carries into the next window.
Queues hang in a binary tree whose two sides weigh about the same. Of the first y tokens of a node, its left
side has the rounded part that its weight is owed and its right side has the rest, so both only ever grow,
and all queues' tokens add up to y. The deficits that a sequential round-robin would carry are thus known in
closed form: a task can place any token from its place in the queue alone, and deficits carry over windows
and partitions with no state passed between tasks. When a queue runs out, the others share its part from
that token on.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch
from .textbits import LOWER, SPACE, U64, blocks, text_buffers, word_hashes


@dataclass(frozen=True)
class PackingConfig:
    """Vocabulary file, id that closes a document, tokens of a window, and target weights by source (None: as in the corpus; `rest`: of every source without one of its own, else 0)."""

    tokenizer: str
    end_id: int = 2
    window: int = 4096
    weights: dict[str, float] | None = None
    cache_words: int = 500_000


REST = "rest"


@dataclass(frozen=True)
class Words:
    """Encoded words as arrays in order of their hashes; `heads` are their first eight bytes, `begins` and `sizes` say where in `pool` their ids are."""

    keys: np.ndarray
    heads: np.ndarray
    begins: np.ndarray
    sizes: np.ndarray
    pool: np.ndarray

    @classmethod
    def none(cls, kind: np.dtype) -> Words:
        return cls(np.zeros(0, U64), np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, kind))

    def find(self, keys: np.ndarray, heads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, is it the word?) for every key."""
        if not len(self.keys):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return at, (self.keys[at] == keys) & (self.heads[at] == heads)

    def plus(self, keys: np.ndarray, heads: np.ndarray, ids: list[np.ndarray]) -> Words:
        """With these words too; they replace others with the same hash."""
        sizes = np.array([len(x) for x in ids], np.int32)
        begins = len(self.pool) + np.cumsum(sizes, dtype=np.int64) - sizes
        merged = np.concatenate([keys, self.keys])
        order = np.argsort(merged, kind="stable")
        order = order[np.append(True, merged[order[1:]] != merged[order[:-1]])]
        both = (np.concatenate(x)[order] for x in ((heads, self.heads), (begins, self.begins), (sizes, self.sizes)))
        return Words(merged[order], *both, np.concatenate([self.pool, *ids]))


class WordCache:
    """Encoded words in two generations: when the young one is full it becomes the old one, and words that are used again move back."""

    def __init__(self, kind: np.dtype) -> None:
        self.kind, self.young, self.old = kind, Words.none(kind), Words.none(kind)

    def of(self, keys: np.ndarray, heads: np.ndarray, most: int, encode: Callable[[np.ndarray], list[np.ndarray]]) -> tuple[np.ndarray, Words]:
        """Rows of these distinct words in the young generation, and that; `encode` gives the ids of the words at these places."""
        if len(self.young.keys) + len(keys) > most:
            self.young, self.old = Words.none(self.kind), self.young
        at, known = self.young.find(keys, heads)
        rest = np.flatnonzero(~known)
        if len(rest):
            row, had = self.old.find(keys[rest], heads[rest])
            old, back, new = self.old, rest[had], rest[~had]
            ids = [old.pool[a : a + n] for a, n in zip(old.begins[row[had]].tolist(), old.sizes[row[had]].tolist(), strict=True)]
            found = np.concatenate([back, new])
            self.young = self.young.plus(keys[found], heads[found], [*ids, *encode(new)])
            at, _ = self.young.find(keys, heads)
        return at, self.young


_encoders: dict[str, tuple] = {}


def _encoder(path: str) -> tuple:
    """The tokenizer, its id type and a cache of encoded words, once for each Python worker."""
    if path not in _encoders:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark gives each task one core
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        kind = np.dtype("<u2" if tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        _encoders[path] = (tokenizer, kind, WordCache(kind))
    return _encoders[path]


_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_STOP = np.zeros(256, bool)
_STOP[[44, 46]] = True  # a comma or full stop after an ASCII letter begins a word of its own in this pre-tokenizer


def encode_block(data: np.ndarray, cuts: np.ndarray, config: PackingConfig) -> list[bytes]:
    """Ids of every text of a block, equal to encoding it whole; each distinct word is encoded once."""
    tokenizer, kind, cache = _encoder(config.tokenizer)
    if not len(data):
        return [b""] * (len(cuts) - 1)
    raw = data.tobytes()
    if b"<|" not in raw:  # special tokens are case-sensitive
        data = LOWER[data]
        raw = data.tobytes()
    solid = ~SPACE[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1] | (_STOP[data[1:]] & _LETTER[data[:-1]])
    edges = cuts[(cuts > 0) & (cuts < len(data))]
    first[edges] = solid[edges]
    start = np.flatnonzero(first)
    nothing = np.append(np.flatnonzero(~solid), len(data))
    limit = np.minimum(nothing[np.searchsorted(nothing, start)], np.append(start[1:], len(data)))
    end = np.minimum(limit, cuts[np.searchsorted(cuts, start, "right")])
    keys, index, inverse = np.unique(word_hashes(data, start, end), return_index=True, return_inverse=True)
    low, high = start[index], end[index]
    heads = np.zeros(len(index), U64)
    for k in range(8):
        heads = (heads << U64(8)) | np.where(low + k < high, data[np.minimum(low + k, len(data) - 1)], 0).astype(U64)

    def encode(places: np.ndarray) -> list[np.ndarray]:
        new = [raw[a:b].decode() for a, b in zip(low[places].tolist(), high[places].tolist(), strict=True)]
        return [np.array(e.ids, kind) for e in tokenizer.encode_batch_fast(new, add_special_tokens=False)]

    rows, known = cache.of(keys, heads, config.cache_words, encode)
    rows = rows[inverse]
    pool, lengths = known.pool, known.sizes[rows].astype(np.int64)
    ends = np.cumsum(lengths)
    at = np.repeat(known.begins[rows] - ends + lengths, lengths) + np.arange(int(ends[-1]) if len(ends) else 0)
    ids = pool[at]
    bounds = np.concatenate([[0], ends])[np.searchsorted(start, cuts)]
    return [ids[a:b].tobytes() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


#: Text with the places where vocabularies cut words in different ways (fixed value).
PROBE = "Don't stop, A.B,c\u2026 x\u00c9  y\n\tz 12,5 3.14 #a_b-c (d) \u4e2d\u6587, e\u0301. \u00a0f\u2003g <|endoftext|> h.i, , .j ,k l. m"


def check_words(config: PackingConfig) -> None:
    """Raises unless this vocabulary cuts words where `encode_block` does."""
    data = np.frombuffer(PROBE.encode(), np.uint8)
    tokenizer, kind, _ = _encoder(config.tokenizer)
    if np.frombuffer(encode_block(data, np.array([0, len(data)]), config)[0], kind).tolist() != tokenizer.encode(PROBE, add_special_tokens=False).ids:
        raise ValueError(f"{config.tokenizer} doesn't cut words at ASCII white space and before a comma or full stop after a letter")


def _tokenize(config: PackingConfig):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, served = TaskContext.get().partitionId(), {}
        kind = _encoder(config.tokenizer)[1]
        close = np.array([config.end_id], kind).tobytes()
        for batch in batches:
            data, offsets = text_buffers(batch.column("text"))
            keys = batch.column("queue").to_pylist()
            for i, j in blocks(offsets):
                ids = [x + close for x in encode_block(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], config)]
                sizes, begin = [len(x) // kind.itemsize for x in ids], []
                for key, n in zip(keys[i:j], sizes, strict=True):
                    begin.append(served.get(key, 0))
                    served[key] = begin[-1] + n
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id")[i:j], pa.array([part] * (j - i), pa.int32()), pa.array(keys[i:j], pa.string()), pa.array(begin, pa.int64()), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary())],
                    names=["doc_id", "part", "queue", "begin", "n", "ids"],
                )

    return run


@dataclass(frozen=True)
class Phase:
    """A stretch of the packed stream in which the same queues are served: its first token, and by queue the tokens that it serves and those served before."""

    first: int
    names: list[str]
    served: list[int]
    taken: list[int]

    @property
    def size(self) -> int:
        return sum(self.served)

    def paths(self) -> dict[str, list[tuple[int, int, bool]]]:
        """For every queue its way down the tree: (weight of the left side, weight of both, is it on the right?)."""
        order = sorted(range(len(self.names)), key=lambda s: (-self.served[s], self.names[s]))
        totals = np.concatenate([[0], np.cumsum([self.served[s] for s in order])]).tolist()
        found: dict[str, list[tuple[int, int, bool]]] = {}
        todo: list[tuple[int, int, list[tuple[int, int, bool]]]] = [(0, len(order), [])]
        while todo:
            a, b, path = todo.pop()
            if b - a == 1:
                found[self.names[order[a]]] = path
                continue
            middle = min(range(a + 1, b), key=lambda c: (abs(totals[a] + totals[b] - 2 * totals[c]), c))
            left, both = totals[middle] - totals[a], totals[b] - totals[a]
            todo += [(a, middle, [*path, (left, both, False)]), (middle, b, [*path, (left, both, True)])]
        return found


def had(path: list[tuple[int, int, bool]], x: int) -> int:
    """Tokens of the queue at the end of `path` among the first x of its phase."""
    for left, both, right in path:
        part = (2 * x * left + both) // (2 * both)
        x = x - part if right else part
    return x


def span(path: list[tuple[int, int, bool]], x: int, y: int) -> tuple[int, int, int]:
    """(`had` of x, `had` of y, tokens of the queues left of this one between the first x and the first y of the phase)."""
    ahead = 0
    for left, both, right in path:
        a, b = (2 * x * left + both) // (2 * both), (2 * y * left + both) // (2 * both)
        if right:
            ahead += b - a
            x, y = x - a, y - b
        else:
            x, y = a, b
    return x, y, ahead


def schedule(totals: dict[str, int], weights: dict[str, float] | None) -> list[Phase]:
    """Phases that serve all tokens: within a phase, shares are fixed; it ends when a queue runs out."""
    left, phases, first = {k: n for k, n in sorted(totals.items()) if n > 0}, [], 0
    done = dict.fromkeys(left, 0)
    while left:
        share = {k: Fraction(left[k]) if weights is None else Fraction(str(weights.get(k, weights.get(REST, 0)))) for k in left}
        if not any(share.values()):
            share = {k: Fraction(n) for k, n in left.items()}
        length = min(left[k] / v for k, v in share.items() if v)
        served = {k: min(n, int(length * share[k])) for k, n in left.items()}
        if weights is None or not any(served.values()):
            served = dict(left)
        names = [k for k, n in served.items() if n]
        phases.append(Phase(first, names, [served[k] for k in names], [done[k] for k in names]))
        first += phases[-1].size
        for k, n in served.items():
            done[k] += n
        left = {k: n - served[k] for k, n in left.items() if n > served[k]}
    return phases


def _window_of(path: list[tuple[int, int, bool]], edge: Callable[[int], int], k: int, at: int) -> int:
    """The window that holds token `at` of a queue, from a guess k: in growing steps, then by halving."""
    step = 1
    while had(path, edge(k)) > at:
        k, step = k - step, step * 2
    low, step = k, 1
    while had(path, edge(k + 1)) <= at:
        low, k, step = k + 1, k + step, step * 2
    while low < k:
        middle = (low + k) // 2
        if had(path, edge(middle + 1)) > at:
            k = middle
        else:
            low = middle + 1
    return k


def _placer(phases: list[Phase], window: int) -> Callable[[str, int, int], Iterator[tuple[int, int, int]]]:
    homes: dict[str, list[tuple[int, int, int, int, list]]] = {}
    for phase in phases:
        paths = phase.paths()
        for name, n, taken in zip(phase.names, phase.served, phase.taken, strict=True):
            homes.setdefault(name, []).append((phase.first, phase.size, n, taken, paths[name]))

    def place(queue: str, low: int, high: int) -> Iterator[tuple[int, int, int]]:
        """(tokens, window, place in it) of the pieces that hold the queue's tokens low..high."""
        for first, size, n, taken, path in homes[queue]:
            at, end = max(low - taken, 0), min(high - taken, n)
            if at >= end:
                continue
            edge = lambda k: min(max(k * window - first, 0), size)  # noqa: B023, E731
            k = (first + at * size // n) // window
            begun, done, ahead = span(path, edge(k), edge(k + 1))
            while at < end:
                if not begun <= at < done:
                    k = _window_of(path, edge, k, at)
                    begun, done, ahead = span(path, edge(k), edge(k + 1))
                stop = min(done, end)
                yield stop - at, k, first + edge(k) - k * window + ahead + at - begun
                at, k = stop, k + 1
                if at < end:
                    begun, done, ahead = span(path, edge(k), edge(k + 1))

    return place


def _pieces(phases: list[Phase], window: int, kind: np.dtype):
    place = _placer(phases, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            columns = [batch.column(x).to_pylist() for x in ("doc_id", "queue_name", "at", "ids")]
            for doc_id, queue, low, data in zip(*columns, strict=True):
                ids = np.frombuffer(data, kind).astype("<u4")
                done = 0
                for n, k, offset in place(queue, low, low + len(ids)):
                    out.append((doc_id, done, n, zlib.crc32(ids[done : done + n].tobytes()), len(ids), k, offset))
                    done += n
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            lists = zip(*out, strict=True) if out else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in lists], names=names)

    return run


def pack(docs: DataFrame, config: PackingConfig) -> DataFrame:
    """One row per piece of a document of `docs` (doc_id, text, source): doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null and empty texts have the closing id alone. A null source is a queue of its own, and so is every source
    with a stated weight. Of the others, sources owed less than one token of a window share the queue `rest`,
    which has their weights' sum, so at most `window` names besides the stated ones come to the driver. In every
    window each queue has its share to within two tokens. Rows that repeat a doc_id and null ids are
    documents like any other. Only the last window has room left. Other columns are ignored; an empty
    table gives an empty result.
    """
    check_words(config)
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    key = F.when(F.col("source").isNull(), F.lit("")).otherwise(F.concat(F.lit("s:"), F.col("source").cast("string")))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", key.alias("queue"))
    schema = "doc_id long, part int, queue string, begin long, n long, ids binary"
    tokens = scratch.save(rows.mapInArrow(_tokenize(config), schema), "tokens")
    parts = scratch.save(tokens.groupBy("part", "queue").agg(F.sum("n").alias("n")), "totals")
    total = parts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    stated = {f"s:{k}": Fraction(str(w)) for k, w in (config.weights or {}).items() if k != REST}
    other = Fraction(str((config.weights or {}).get(REST, 0)))
    sizes = parts.groupBy("queue").agg(F.sum("n").alias("n"))
    named = {r.queue: r.n for r in sizes.where(F.col("queue").isin(list(stated))).collect()} if stated else {}
    free = sizes.where(~F.col("queue").isin(list(named))) if named else sizes
    rest = total - sum(named.values())  # tokens of the sources without a stated weight
    if other:  # equal targets: all are owed a token of a window, or none
        count = free.count()
        enough = config.window * other >= sum(stated[k] for k in named) + count * other
        own = {r.queue: r.n for r in free.collect()} if enough else {}
    else:  # served as in the corpus, all the time or once the stated sources have run out
        own = {r.queue: r.n for r in free.where(F.col("n") >= F.lit(-(-rest // config.window))).collect()}  # at most `window` rows
    left = rest - sum(own.values())
    weights = None
    if config.weights is not None:
        weights = {k: stated.get(k, other) for k in [*named, *own]}
        if left:
            weights[REST] = other * (free.count() - len(own))
    own |= named
    totals = own | ({REST: left} if left else {})
    phases = schedule(totals, weights)
    name = F.when(F.col("queue").isin(list(own)), F.col("queue")).otherwise(F.lit(REST)) if own else F.lit(REST)
    parts = parts.withColumn("queue_name", name)
    by_part = parts.groupBy("queue_name", "part").agg(F.sum("n").alias("sum"))
    before = by_part.withColumn("base", F.sum("sum").over(Window.partitionBy("queue_name").orderBy("part")) - F.col("sum")).drop("sum")
    inside = parts.withColumn("within", F.sum("n").over(Window.partitionBy("queue_name", "part").orderBy("queue")) - F.col("n")).drop("n")
    starts = inside.join(before, ["queue_name", "part"]).select("part", "queue", "queue_name", (F.col("base") + F.col("within")).alias("first"))
    placed = tokens.join(scratch.save(starts, "starts"), ["part", "queue"]).select("doc_id", "queue_name", (F.col("first") + F.col("begin")).alias("at"), "ids")
    kind = _encoder(config.tokenizer)[1]
    result = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return placed.mapInArrow(_pieces(phases, config.window, kind), result)
