"""Incremental, reversible line deduplication: sharded cuckoo filters over exact reference-count tables.

The state under one folder has two kinds of tables. Reference tables hold, for each (line key, document),
how many lines the document has of it; keys are 128-bit hashes. Filter tables hold, for each shard of the
key space, the cuckoo filters of the keys that have references. Adding a batch asks the filters which of
its keys may be known: only those, and keys that the batch itself repeats, are looked up in the exact
tables; all other keys are new for certain. Every addition makes filters of a new generation, and each
reference says which generation holds its key. Removing documents removes their references, and the
fingerprints of keys that lose their last one from the filters of the key's own generation, so a removal
undoes an addition exactly, whatever false positives the other filters have.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch
from .textbits import LOWER, SPACE, U64, blocks, digests, mix, text_buffers

SLOTS = 4


class CuckooFilter:
    """16-bit fingerprints in buckets of four slots; each has two buckets, and either gives the other."""

    def __init__(self, table: np.ndarray) -> None:
        self.table = table

    @classmethod
    def sized(cls, n: int) -> CuckooFilter:
        return cls(np.zeros((1 << max(1, int(np.ceil(np.log2(max(n, 1) / (SLOTS * 0.84))))), SLOTS), np.uint16))

    @classmethod
    def of(cls, low: np.ndarray, high: np.ndarray) -> CuckooFilter:
        """A filter of all these distinct keys, doubled until they fit."""
        made = cls.sized(len(low))
        while not made.add(low, high):
            made = cls(np.zeros((2 * len(made.table), SLOTS), np.uint16))
        return made

    @classmethod
    def from_bytes(cls, data: bytes) -> CuckooFilter:
        return cls(np.frombuffer(data, np.uint16).reshape(-1, SLOTS).copy())

    def to_bytes(self) -> bytes:
        return self.table.tobytes()

    def _places(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mark = (high.astype(U64) >> U64(48)).astype(np.uint16)
        mark[mark == 0] = 1
        return mark, (low.astype(U64) & U64(len(self.table) - 1)).astype(np.int64)

    def _other(self, bucket: np.ndarray, mark: np.ndarray) -> np.ndarray:
        return bucket ^ (mix(mark.astype(U64)) & U64(len(self.table) - 1)).astype(np.int64)

    def has(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        mark, bucket = self._places(low, high)
        near = (self.table[bucket] == mark[:, None]).any(axis=1)
        return near | (self.table[self._other(bucket, mark)] == mark[:, None]).any(axis=1)

    def add(self, low: np.ndarray, high: np.ndarray) -> bool:
        """Insert all keys, many at a time; False if some key found no place."""
        mark, bucket = self._places(low, high)
        for turn in range(2000):
            if not len(mark):
                return True
            _, one = np.unique(bucket, return_index=True)  # one key a bucket and round
            free = self.table[bucket[one]] == 0
            has_free = free.any(axis=1)
            slot = np.where(has_free, free.argmax(axis=1), turn % SLOTS if turn % 2 else (turn // 2) % SLOTS)
            evict = ~has_free & (turn > 0)
            write = has_free | evict
            rows, columns = bucket[one][write], slot[write]
            out = self.table[rows, columns]
            self.table[rows, columns] = mark[one][write]
            rest = np.ones(len(mark), bool)
            rest[one] = False
            waiting = one[~write]  # the first round tries the other bucket before it evicts
            pushed = out != 0
            next_mark = np.concatenate([mark[rest], mark[waiting], out[pushed]])
            next_bucket = np.concatenate([bucket[rest], self._other(bucket[waiting], mark[waiting]), self._other(rows[pushed], out[pushed])])
            mark, bucket = next_mark, next_bucket
        return False

    def remove(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Clear one fingerprint of every key that has one here; says which had.

        Keys with one fingerprint that share a bucket share both, so which of their equal slots is cleared makes no odds.
        """
        mark, bucket = self._places(low, high)
        done = np.zeros(len(mark), bool)
        for side in (bucket, self._other(bucket, mark)):
            left = np.flatnonzero(~done)
            while len(left):
                _, one = np.unique(side[left], return_index=True)  # one key a bucket and round
                now = left[one]
                hit = self.table[side[now]] == mark[now, None]
                now, slot = now[hit.any(axis=1)], hit.argmax(axis=1)[hit.any(axis=1)]
                self.table[side[now], slot] = 0
                done[now] = True
                left = np.delete(left, one)
        return done


def line_keys(data: np.ndarray, cuts: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """(document number, start, end, key low, key high, is the key long enough) of every line of a block of texts; short keys are 0."""
    breaks = np.flatnonzero(data == 10)
    owner = np.concatenate([np.arange(len(cuts) - 1), np.searchsorted(cuts, breaks, "right") - 1])
    start = np.concatenate([cuts[:-1], breaks + 1])
    order = np.lexsort((start, owner))
    owner, start = owner[order], start[order]
    end = cuts[owner + 1].copy()
    inner = np.flatnonzero(owner[1:] == owner[:-1])
    end[inner] = start[inner + 1] - 1
    solid = np.append(np.flatnonzero(~SPACE[data]), len(data))
    first = np.minimum(solid[np.searchsorted(solid, start)], end)
    before = np.searchsorted(solid, end) - 1
    last = np.maximum(np.where(before >= 0, solid[before] + 1, 0), first)
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    long = points[last] - points[first] >= least
    keys = np.zeros((len(owner), 2), np.int64)
    keys[long] = digests(LOWER[data], first[long], last[long], 16).view(np.int64)
    return owner, start, end, keys[:, 0], keys[:, 1], long


def _references(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column("text"))
            ids = batch.column("doc_id").to_numpy()
            for i, j in blocks(offsets):
                owner, _, _, low, high, long = line_keys(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], least)
                owner, low, high = owner[long], low[long], high[long]
                order = np.lexsort((high, low, owner))
                owner, low, high = owner[order], low[order], high[order]
                new = np.ones(len(owner), bool)
                new[1:] = (owner[1:] != owner[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])
                heads = np.flatnonzero(new)
                n = np.diff(np.append(heads, len(owner)))
                yield pa.RecordBatch.from_arrays([pa.array(low[heads]), pa.array(high[heads]), pa.array(ids[i + owner[heads]]), pa.array(n)], names=["low", "high", "doc_id", "n"])

    return run


_KINDS = {"shard": pa.int32(), "kind": pa.int32(), "generation": pa.int32(), "low": pa.int64(), "high": pa.int64(), "repeated": pa.bool_(), "data": pa.binary()}
_STATE = "shard int, kind int, generation int, low long, high long, repeated boolean, data binary"


def _close(shard: int, made: int, filters: dict[int, CuckooFilter], held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What `_probe` gives for one shard; filters that change or are new are replaced in `filters`."""
    schema = pa.schema(list(_KINDS.items()))
    if held:
        keys = pa.Table.from_batches(held)
        kind, generation, low, high, repeated = (keys.column(x).to_numpy() for x in ("kind", "generation", "low", "high", "repeated"))
        asked = kind == 1
        known = np.zeros(len(kind), bool)
        for one in filters.values():
            known[asked] |= one.has(low[asked], high[asked])
        for at, one in filters.items():
            gone = (kind == 3) & (generation == at)
            if not one.remove(low[gone], high[gone]).all():
                raise ValueError(f"shard {shard}: a key to take out isn't in the filter of generation {at}")
        fresh = (asked & ~known) | (kind == 2)
        if fresh.any():
            filters[made] = CuckooFilter.of(low[fresh], high[fresh])
        tell = asked & (known | repeated)
        n = int(tell.sum())
        out = [np.full(n, shard), np.where(known[tell], 1, 2), np.full(n, made), low[tell], high[tell], repeated[tell], [None] * n]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, _KINDS.values(), strict=True)], schema=schema)
    for at, one in filters.items():
        if one.table.any():
            yield pa.RecordBatch.from_pylist([{"shard": shard, "kind": 0, "generation": at, "data": one.to_bytes()}], schema=schema)


def _probe(made: int):
    """Rows sorted by shard, a shard's old filters first: which keys need an exact look, and a filter, of generation `made`, of the others.

    Kinds in: 0 a filter, 1 a key of the batch, 2 a key to insert unasked, 3 a key to take out of its generation's filter.
    Kinds out: 0 a filter, 1 a key that may be known, 2 a key that only this batch repeats.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, filters, held = None, {}, []
        for batch in batches:
            for now in np.unique(batch.column("shard").to_numpy()).tolist():
                part = batch.filter(pa.array(batch.column("shard").to_numpy() == now))
                if now != shard:
                    if shard is not None:
                        yield from _close(shard, made, filters, held)
                    shard, filters, held = now, {}, []
                old = pa.array(part.column("kind").to_numpy() == 0)
                known = part.filter(old)
                filters |= {g: CuckooFilter.from_bytes(x) for g, x in zip(known.column("generation").to_pylist(), known.column("data").to_pylist(), strict=True)}
                if known.num_rows < part.num_rows:
                    held.append(part.select(["kind", "generation", "low", "high", "repeated"]).filter(pc.invert(old)))
        if shard is not None:
            yield from _close(shard, made, filters, held)

    return run


class LineDedup:
    """The state of a deduplicated corpus; `keys_per_shard` bounds what one task holds of a batch, `most_generations` the filters of a shard."""

    def __init__(self, spark: SparkSession, least: int = 10, keys_per_shard: int = 500_000, most_generations: int = 16) -> None:
        self.scratch = Scratch(spark, "line-dedup")
        self.spark, self.least, self.per_shard, self.most = spark, least, keys_per_shard, most_generations
        self.shards = self.rows = self.generation = self.oldest = 0
        self.references: DataFrame | None = None
        self.filters: DataFrame | None = None
        self.suspects: DataFrame | None = None

    def _shard(self, frame: DataFrame) -> DataFrame:
        return frame.withColumn("shard", F.pmod(F.xxhash64("high"), F.lit(self.shards)).cast("int"))

    def _through_filters(self, keys: DataFrame, label: str) -> DataFrame:
        """`_probe` of rows (low, high, kind, repeated, generation); filters that this makes get the next generation."""
        self.generation += 1
        rows = self._shard(keys).select("shard", "kind", "generation", "low", "high", "repeated", F.lit(None).cast("binary").alias("data"))
        if self.filters is not None:
            rows = rows.unionByName(self.filters)
        sent = rows.repartition(self.shards, "shard").sortWithinPartitions("shard", "kind")
        return self.scratch.save(sent.mapInArrow(_probe(self.generation), _STATE), label)

    @staticmethod
    def _keys(frame: DataFrame, kind: int, generation: Column | None = None) -> DataFrame:
        return frame.select("low", "high", F.lit(kind).alias("kind"), F.lit(False).alias("repeated"), (F.lit(None).cast("int") if generation is None else generation).alias("generation"))

    def compact(self) -> None:
        """Make the filters anew from the exact references: one generation, in as many shards as the state's size asks for."""
        self.shards, self.filters, self.oldest = max(8, -(-self.rows // self.per_shard)), None, self.generation
        self.filters = self._through_filters(self._keys(self.references.select("low", "high").distinct(), 2), "filters").where("kind = 0")
        self.references = self.references.withColumn("generation", F.lit(self.generation))

    def insert(self, docs: DataFrame) -> None:
        """Add documents (doc_id, text) that the state doesn't hold. Rows with a null doc_id are left out."""
        texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null")
        batch = self.scratch.save(texts.mapInArrow(_references(self.least), "low long, high long, doc_id long, n long"), "references")
        self.rows += batch.count()
        if self.references is None:
            self.shards = max(8, -(-self.rows // self.per_shard))
        elif self.rows > 4 * self.shards * self.per_shard or self.generation - self.oldest >= self.most:
            self.compact()
        keys = batch.groupBy("low", "high").agg((F.min("doc_id") < F.max("doc_id")).alias("repeated"))
        told = self._through_filters(keys.withColumn("kind", F.lit(1)).withColumn("generation", F.lit(None).cast("int")), "probed")
        fresh, generation = F.lit(self.generation), F.lit(self.generation)
        self.filters = told.where("kind = 0")
        if self.references is not None:
            asked = told.where("kind = 1").select("low", "high")
            held = self.references.join(asked, ["low", "high"], "left_semi").groupBy("low", "high").agg(F.first("generation").alias("generation"))
            told_of = self.scratch.save(asked.join(held, ["low", "high"], "left"), "asked")
            self.filters = self._through_filters(self._keys(told_of.where("generation is null"), 2), "filters").where("kind = 0")
            generation = F.when(F.col("asked"), F.coalesce("generation", F.lit(self.generation))).otherwise(fresh)
            batch = batch.join(told_of.withColumn("asked", F.lit(True)), ["low", "high"], "left")
        suspects = told.where("kind > 0").select("low", "high")
        self.suspects = suspects if self.suspects is None else self.suspects.unionByName(suspects)
        batch = batch.select("low", "high", "doc_id", "n", generation.cast("int").alias("generation"))
        if self.references is not None:
            batch = self.references.unionByName(self.scratch.save(batch, "references"))
        self.references = batch

    def delete(self, doc_ids: DataFrame) -> None:
        """Take out the documents whose ids `doc_ids` (doc_id) lists; unknown ids change nothing."""
        if self.references is None:
            return
        ids = doc_ids.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
        kept = self.scratch.save(self.references.join(ids, "doc_id", "left_anti").select("low", "high", "doc_id", "n", "generation"), "references")
        touched = self.references.join(ids, "doc_id", "left_semi").select("low", "high", "generation").distinct()
        lost = touched.join(kept, ["low", "high"], "left_anti")
        self.filters = self._through_filters(self._keys(lost, 3, F.col("generation")), "filters").where("kind = 0")
        self.references, self.rows = kept, kept.count()

    def reference_counts(self) -> DataFrame:
        """(low, high, documents, lines, first_doc) of every key: the exact counts behind the filters."""
        return self.references.groupBy("low", "high").agg(F.countDistinct("doc_id").alias("documents"), F.sum("n").alias("lines"), F.min("doc_id").alias("first_doc"))

    def dropped(self) -> DataFrame:
        """(doc_id, lows, highs): keys that each document loses to a document with a smaller id."""
        held = self.scratch.save(self.references.join(self.suspects.distinct(), ["low", "high"], "left_semi").select("low", "high", "doc_id"), "suspects")
        owners = held.groupBy("low", "high").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
        owners = self.scratch.save(owners, "owners")  # so that a common line's rows can be split in the join
        lost = held.join(owners, ["low", "high"]).where("doc_id > first")
        lists = lost.groupBy("doc_id").agg(F.collect_list(F.struct("low", "high")).alias("k"))
        return lists.select("doc_id", F.col("k.low").alias("lows"), F.col("k.high").alias("highs"))

    def apply(self, docs: DataFrame) -> DataFrame:
        """One row per row of `docs`: doc_id, n_lines, n_dropped, kept_sha256.

        Null or empty text is one empty line; a text whose lines all go is empty. A null doc_id loses
        nothing. Rows that repeat a doc_id count as one document.
        """
        texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        joined = texts.join(self.dropped().hint("merge"), "doc_id", "left").select("doc_id", "text", "lows", "highs")
        return joined.mapInArrow(_digest(self.least), "doc_id long, n_lines long, n_dropped long, kept_sha256 string")

    def rewrite(self, docs: DataFrame) -> DataFrame:
        """`docs` with the lines that go taken out of `text`, and n_chars, where there is one, counted again; null texts stay null."""
        names, least = docs.columns, self.least
        free = "lost"
        while free in names:  # a name that no column of the documents has
            free += "_"
        lost = self.dropped().select(F.struct("doc_id", "lows", "highs").alias(free)).hint("merge")
        joined = docs.join(lost, docs["doc_id"].cast("long") == lost[free]["doc_id"], "left")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                _, lows, highs = batch.column(free).flatten()
                kept = [None if text is None else body.decode() for text, (_, _, body) in zip(batch.column("text").to_pylist(), _kept(batch.column("text"), lows, highs, least), strict=True)]
                columns = [pa.array(kept, pa.string()) if name == "text" else batch.column(name) for name in names]
                yield pa.RecordBatch.from_arrays(columns, names=names)

        out = joined.mapInArrow(run, docs.schema)
        return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out


def _kept(column: pa.Array, lows: pa.Array, highs: pa.Array, least: int) -> Iterator[tuple[int, int, bytes]]:
    """(lines, dropped lines, what stays) of every text, given the keys it loses."""
    data, offsets = text_buffers(column)
    for i in range(len(column)):
        whole = data[offsets[i] : offsets[i + 1]]
        text, gone = whole.tobytes(), 0
        n_lines = text.count(b"\n") + 1
        if lows[i].is_valid:
            _, start, end, low, high, _ = line_keys(whole, np.array([0, len(whole)]), least)
            lost = set(zip(lows[i].values.to_pylist(), highs[i].values.to_pylist(), strict=True))
            stay = [text[a:b] for a, b, x, y in zip(start.tolist(), end.tolist(), low.tolist(), high.tolist(), strict=True) if (x, y) not in lost]
            gone, text = len(start) - len(stay), b"\n".join(stay)
        yield n_lines, gone, text


def _digest(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(n, gone, hashlib.sha256(text).hexdigest()) for n, gone, text in _kept(batch.column("text"), batch.column("lows"), batch.column("highs"), least)]
            lists = zip(*rows, strict=True) if rows else [()] * 3
            kinds = (pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, t) for x, t in zip(lists, kinds, strict=True))], names=["doc_id", "n_lines", "n_dropped", "kept_sha256"])

    return run


def loaded(docs: DataFrame, least: int = 10) -> LineDedup:
    """A new state with all of `docs`, added in two batches dealt by doc_id: the second probes the filters of the first."""
    state = LineDedup(docs.sparkSession, least)
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2))
    for part in (0, 1):
        state.insert(docs.where(half == part))
    return state


def dedup_lines(docs: DataFrame, least: int = 10) -> DataFrame:
    """`LineDedup.apply` with the state that `docs` (doc_id, text) themselves make."""
    return loaded(docs, least).apply(docs)
