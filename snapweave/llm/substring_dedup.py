"""Removal of repeated byte strings by threshold-bounded interval expansion on Burrows-Wheeler transforms.

Every `length`-byte string is keyed by its anchor, the smallest-hashing `seed`-byte string inside it, so
equal strings have equal anchors wherever they start. Neighbouring starts with one anchor form a segment.
Only segments whose anchor occurs again, or that may repeat inside themselves, go on. Segments with equal
bytes (by BLAKE2b) are one class, for which two of its members stand. These go, with the members of the
other classes of their anchor, into a block whose suffix array and Burrows-Wheeler transform are built.
Breadth-first backward extension then derives common prefix lengths in increasing order and stops at
`length`: what has no length by then is repeated, in the two members of a copied class as anywhere else. Copied
classes that are alone under their anchors, and whose two members follow each other in both texts, go there as
one pair of longer strings, up to about `run_bytes`, since neighbouring segments overlap by most of their bytes.

An anchor whose classes have more than `anchor_bytes` is split before that: its segments are cut into pairs of
neighbouring starts, and pairs meet by the bytes that both strings of a pair share, which equal strings have
in common too. A pair has two bytes besides those, so what meets is bounded, however many segments there are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch
from .textbits import U64, blocks, digests, mix, powers, prefix_sums, text_buffers


@dataclass(frozen=True)
class SubstringDedupConfig:
    """Bytes of a repeated string and of its anchor, at which a block is closed (small ones stay in a core's cache), of one anchor's segments, of copied segments in a row, and of what one task gets."""

    length: int = 200
    seed: int = 100
    block_bytes: int = 1 << 17
    anchor_bytes: int = 1 << 19
    run_bytes: int = 1 << 15
    task_bytes: int = 1 << 21


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix array of non-negative symbols by prefix doubling; only suffixes that still tie are sorted again."""
    n = len(text)
    bits = max(1, int(text.max() + 1).bit_length())
    step = max(1, 62 // bits)
    padded = np.concatenate([text.astype(np.int64) + 1, np.zeros(step, np.int64)])
    key = np.zeros(n, np.int64)
    for k in range(step):
        key = (key << bits) + padded[k : k + n]
    suffixes = np.argsort(key)
    slots = np.arange(n)
    rank = np.zeros(n + 1, np.int64)  # 1 + slot of the first suffix of the tie; 0 past the end
    order, keys = suffixes.copy(), key[suffixes]
    active, at = order, slots
    while True:
        new = np.ones(len(active), bool)
        new[1:] = keys[1:] != keys[:-1]
        head = np.maximum.accumulate(np.where(new, at, 0))
        rank[active] = head + 1
        tied = ~new
        tied[:-1] |= ~new[1:]
        active, at = active[tied], at[tied]
        if not len(active):
            return suffixes
        keys = rank[active] * (n + 1) + rank[np.minimum(active + step, n)]
        order = np.argsort(keys)
        active, keys = active[order], keys[order]
        suffixes[at] = active
        step *= 2


def _next_bound(bound: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The first place after each of `at` that is set in `bound`, whose last is: in growing windows, or one pass where these would read more."""
    found, last = at + 1, len(bound) - 1
    left, width = np.flatnonzero(~bound[found]), 8
    while len(left):
        if 8 * len(left) * width > len(bound):  # a pass reads a place faster
            known = np.flatnonzero(bound)
            found[left] = known[np.searchsorted(known, found[left])]
            break
        window = bound[np.minimum(found[left, None] + np.arange(width), last)]
        ahead = window.argmax(axis=1)
        hit = window[np.arange(len(left)), ahead]
        found[left] += np.where(hit, ahead, width)
        left, width = left[~hit], width * 8
    return found


def repeated_starts(strings: list[bytes], length: int) -> np.ndarray:
    """For the strings laid end to end, each with a closing separator: does the `length`-byte string here start elsewhere too?"""
    m, sizes = len(strings), np.array([len(s) for s in strings])
    ends = np.cumsum(sizes + 1) - 1
    n = int(ends[-1]) + 1
    text = np.zeros(n, np.int64)
    inside = np.ones(n, bool)
    inside[ends] = False
    text[inside] = np.frombuffer(b"".join(strings), np.uint8).astype(np.int64) + m
    text[ends] = np.arange(m)  # separators differ, so no common prefix crosses one
    suffixes = suffix_array(text)
    last = text[suffixes - 1]  # the Burrows-Wheeler transform
    by_symbol = np.argsort(last.astype(np.uint16) if m < 65_000 else last, kind="stable")
    step_to = np.empty(n, np.int64)
    step_to[by_symbol] = np.arange(n)
    previous = np.full(n, -1)
    same = last[by_symbol[1:]] == last[by_symbol[:-1]]
    previous[by_symbol[1:][same]] = by_symbol[:-1][same]
    first = text[suffixes]
    bound = np.ones(n + 1, bool)
    bound[1:n] = first[1:] != first[:-1]
    fresh = np.flatnonzero(bound[:n])
    for _ in range(length - 1):  # after this round all common prefixes of up to one byte more are known
        if not len(fresh):
            break
        sizes = _next_bound(bound, fresh) - fresh
        begin = np.repeat(fresh, sizes)
        at = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes) + begin
        before = previous[at]
        target = step_to[at[(before >= 0) & (before < begin)]]
        fresh = np.sort(target[~bound[target]])
        bound[fresh] = True
    deep = np.flatnonzero(~bound[:n])
    flags = np.zeros(n, bool)
    flags[suffixes[deep]] = True
    flags[suffixes[deep - 1]] = True
    return flags


def anchors_of(part: np.ndarray, config: SubstringDedupConfig) -> tuple[np.ndarray, np.ndarray]:
    """(hash, place) of the anchor of every `length`-byte string of `part`."""
    seed, width, size = config.seed, config.length - config.seed + 1, len(part)
    sums = prefix_sums(part)
    _, down = powers(size + 1)
    hashes = mix((sums[seed:] - sums[:-seed]) * down[: size - seed + 1])
    bits = U64(max(20, size.bit_length()))
    packed = (hashes >> bits << bits) | np.arange(len(hashes), dtype=U64)
    lowest = np.full(-(-len(packed) // width) * width, np.iinfo(np.uint64).max, U64)
    lowest[: len(packed)] = packed
    grid = lowest.reshape(-1, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    count = size - config.length + 1
    best = np.minimum(behind[:count], ahead[width - 1 : width - 1 + count])
    place = (best & ((U64(1) << bits) - U64(1))).astype(np.int64)
    return hashes[place], place


def _segments(config: SubstringDedupConfig):
    length, width = config.length, config.length - config.seed + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column("text"))
            ids = batch.column("doc_id").to_numpy()
            for i, j in blocks(offsets):
                part, cuts = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                if len(part) < length:
                    continue
                value, place = anchors_of(part, config)
                owner = np.repeat(np.arange(j - i), np.diff(cuts))[: len(value)]
                valid = np.flatnonzero(np.arange(len(value)) + length <= cuts[owner + 1])
                if not len(valid):
                    continue
                place, value = place[valid], value[valid]
                new = np.ones(len(valid), bool)
                new[1:] = (valid[1:] != valid[:-1] + 1) | (value[1:] != value[:-1])
                heads = np.flatnonzero(new)
                within = np.arange(len(valid)) - np.repeat(heads, np.diff(np.append(heads, len(valid))))
                new |= within % width == 0  # a periodic text may keep one anchor for long
                heads = np.flatnonzero(new)
                n = np.diff(np.append(heads, len(valid)))
                start, tail = valid[heads], heads + n - 1
                shape = digests(part, start, start + n + length - 1, 8)[:, 0]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(value[heads].astype(np.int64)),
                        pa.array(shape.astype(np.int64)),
                        pa.array(ids[i + owner[start]]),
                        pa.array(start - cuts[owner[start]]),
                        pa.array(n.astype(np.int32)),
                        pa.array(place[heads] != place[tail]),
                    ],
                    names=["anchor", "shape", "doc_id", "start", "n", "inner"],
                )

    return run


def _cut(length: int):
    """Texts with lists of parts become a row of bytes for each part; bytes that another row of the same doc_id has there are passed over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, shape, found = [], [], []
            for text, parts in zip(batch.column("text").cast(pa.binary()), batch.column("parts"), strict=True):
                whole = text.as_py() or b""
                for p in parts.as_py():
                    at, same = p["start"], True
                    for n, digest in zip(p["sizes"], p["digests"], strict=True):
                        some = whole[at : at + n + length - 1]
                        same &= int.from_bytes(hashlib.blake2b(some, digest_size=8).digest(), "little", signed=True) == digest
                        at += n
                    if same:
                        key.append(p["key"])
                        shape.append(p["digests"][0])
                        found.append(whole[p["start"] : at + length - 1])
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(shape, pa.int64()), pa.array(found, pa.binary())], names=["key", "shape", "bytes"])

    return run


def _pairs(config: SubstringDedupConfig):
    """Segments become pairs of neighbouring starts, keyed by what their strings share and its place beside the anchor."""
    length = config.length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, raw in enumerate(batch.column("bytes")):
                part = np.frombuffer(raw.as_py(), np.uint8)
                _, place = anchors_of(part, config)
                side = (place - np.arange(len(place))) // 2
                new = np.ones(len(place), bool)
                new[1:] = (side[1:] != side[:-1]) | (place[1:] != place[:-1])
                low = np.flatnonzero(new)
                n = np.diff(np.append(low, len(place)))
                core = place[low] - 2 * side[low]
                shared = digests(part, core, core + length - 1, 8)[:, 0]
                key = mix(shared + mix(side[low].astype(U64)))
                shape = digests(part, low, low + n + length - 1, 8)[:, 0]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("key").take(pa.array([at] * len(low))),
                        batch.column("shape").take(pa.array([at] * len(low))),
                        pa.array(key.astype(np.int64)),
                        pa.array(shape.astype(np.int64)),
                        pa.array(low),
                        pa.array(n.astype(np.int32)),
                    ],
                    names=["anchor", "segment", "key", "shape", "start", "n"],
                )

    return run


def _expand(config: SubstringDedupConfig):
    """Rows sorted by key and shape, in blocks of whole keys, become runs of repeated starts, once for each shape."""
    schema = pa.schema([("key", pa.int64()), ("shape", pa.int64()), ("low", pa.int32()), ("high", pa.int32())])

    def solve(held: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        flags = repeated_starts([x[2] for x in held], config.length)
        edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
        low, high = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        begin = np.concatenate([[0], np.cumsum([len(x[2]) + 1 for x in held])])
        row = np.searchsorted(begin, low, "right") - 1
        once = np.array([r == 0 or held[r][:2] != held[r - 1][:2] for r in row], bool)
        low, high, row = low[once], high[once], row[once]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([held[r][0] for r in row], pa.int64()),
                pa.array([held[r][1] for r in row], pa.int64()),
                pa.array((low - begin[row]).astype(np.int32)),
                pa.array((high - begin[row]).astype(np.int32)),
            ],
            schema=schema,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, bytes]] = []
        size = 0
        for batch in batches:
            for row in zip(batch.column("key").to_pylist(), batch.column("shape").to_pylist(), batch.column("bytes").to_pylist(), strict=True):
                if size >= config.block_bytes and row[0] != held[-1][0]:
                    yield solve(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[2])
        if held:
            yield solve(held)

    return run


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        size, removed, spans, digest = [], [], [], []
        for text, lows, highs in zip(batch.column("text").cast(pa.binary()), batch.column("lows"), batch.column("highs"), strict=True):
            whole = text.as_py() or b""
            kept, at, gone, runs = hashlib.sha256(), 0, 0, 0
            if lows.is_valid:
                low, high = lows.values.to_numpy(), highs.values.to_numpy()
                order = np.argsort(low, kind="stable")
                low, high = low[order], np.maximum.accumulate(high[order])
                new = np.concatenate([[True], low[1:] > high[:-1]])
                heads = np.flatnonzero(new)
                for a, b in zip(low[heads].tolist(), high[np.append(heads[1:] - 1, len(high) - 1)].tolist(), strict=True):
                    kept.update(whole[at:a])
                    at, gone, runs = b, gone + b - a, runs + 1
            kept.update(whole[at:])
            size.append(len(whole))
            removed.append(gone)
            spans.append(runs)
            digest.append(kept.hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digest, pa.string())],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
        )


def repeated_spans(docs: DataFrame, config: SubstringDedupConfig = SubstringDedupConfig()) -> DataFrame:
    """Byte ranges [low, high) of `docs` (doc_id, text) covered by repeated strings: rows (doc_id, low, high), which may overlap.

    Rows with a null doc_id or text give none. Rows that repeat a doc_id count as one document that holds
    the strings of each row.
    """
    scratch = Scratch(docs.sparkSession, "substrings")
    length = config.length
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("doc_id").isNotNull() & (F.octet_length("text") >= length))
    rows = scratch.save(texts.mapInArrow(_segments(config), "anchor long, shape long, doc_id long, start long, n int, inner boolean"), "segments")
    again = rows.groupBy("anchor").agg(F.count("*").alias("c"), F.max("inner").alias("i")).where("c > 1 or i").select("anchor")
    again = scratch.save(again, "repeated-anchors")  # so that a common anchor's rows can be split in the join
    hits = scratch.save(rows.join(again, "anchor").drop("inner"), "candidates")
    scratch.drop(rows)
    classes = scratch.save(_classes(hits, "anchor", ["doc_id", "start", "n"]), "classes")
    sizes = classes.groupBy("anchor").agg(F.sum((F.col("first.n") + length - 1) * F.least("copies", F.lit(2))).alias("size"), ((F.count("*") == 1) & (F.min("copies") > 1)).alias("alone"), F.first(F.struct("shape", "first", "last")).alias("only"))
    sizes = scratch.save(sizes, "anchor-sizes")
    large = sizes.where((F.col("size") > config.anchor_bytes) & ~F.col("alone")).select("anchor")
    alone = sizes.where("alone").select("anchor", "only.*")
    mixed = classes.join(sizes.where("not alone").select("anchor"), "anchor")
    copied = scratch.save(_in_a_row(alone, config.run_bytes), "copied")
    lists = _members(mixed, "anchor").select("doc_id", _part(F.col("anchor"), F.col("start"), F.array("n"), F.array("shape")))
    lists = lists.unionByName(_places(copied).select("doc_id", _part(F.col("key"), F.col("start"), F.col("sizes"), F.col("digests"))))
    wanted = lists.groupBy("doc_id").agg(F.collect_list("part").alias("parts"))
    cut = scratch.save(wanted.join(texts, "doc_id").select("text", "parts").mapInArrow(_cut(length), "key long, shape long, bytes binary"), "segment-bytes")
    runs = _repeated(scratch, cut.join(large.withColumnRenamed("anchor", "key"), "key", "left_anti"), config)
    rows = copied.select("key", F.posexplode("classes").alias("at", "c"))
    rows = rows.select("key", "c.anchor", "c.shape", F.col("c.offset").alias("offset"), F.col("c.n").alias("n")).join(runs.select("key", "low", "high"), "key")
    rows = rows.select("anchor", "shape", F.greatest(F.col("low") - F.col("offset"), F.lit(0)).cast("int").alias("low"), F.least(F.col("high") - F.col("offset"), F.col("n")).cast("int").alias("high")).where("low < high")
    runs = runs.join(copied.select("key"), "key", "left_anti").withColumnRenamed("key", "anchor").unionByName(rows)

    # Large anchors: pairs of starts that share all but their outer bytes meet instead of segments.
    crowded = cut.join(large.withColumnRenamed("anchor", "key"), "key", "left_semi").dropDuplicates(["key", "shape"])
    pairs = scratch.save(crowded.mapInArrow(_pairs(config), "anchor long, segment long, key long, shape long, start long, n int"), "pairs")
    known = classes.select("anchor", F.col("shape").alias("segment"), "copies")
    shared = pairs.join(known, ["anchor", "segment"]).groupBy("key").agg(F.sum("copies").alias("c")).where("c > 1").select("key")
    met = scratch.save(pairs.join(scratch.save(shared, "shared-keys"), "key"), "met-pairs")
    counted = met.join(known, ["anchor", "segment"])
    kinds = scratch.save(_classes(counted, "key", ["anchor", "segment", "start", "n"], F.sum("copies")), "pair-classes")
    lists = _members(kinds, "key").select("anchor", "segment", _part(F.col("key"), F.col("start").cast("long"), F.array("n"), F.array("shape")))
    lists = lists.groupBy("anchor", "segment").agg(F.collect_list("part").alias("parts"))
    bodies = crowded.select(F.col("key").alias("anchor"), F.col("shape").alias("segment"), F.col("bytes").alias("text"))
    pieces = lists.join(bodies, ["anchor", "segment"]).select("text", "parts").mapInArrow(_cut(length), "key long, shape long, bytes binary")
    found = met.join(_repeated(scratch, scratch.save(pieces, "pair-bytes"), config), ["key", "shape"])
    found = found.select("anchor", F.col("segment").alias("shape"), (F.col("start") + F.col("low")).cast("int").alias("low"), (F.col("start") + F.col("high")).cast("int").alias("high"))

    joined = hits.join(scratch.save(runs.select(found.columns).unionByName(found), "runs"), ["anchor", "shape"])
    return joined.select("doc_id", (F.col("start") + F.col("low")).alias("low"), (F.col("start") + F.col("high") + length - 1).alias("high"))


def _classes(rows: DataFrame, key: str, place: list[str], count: Column | None = None) -> DataFrame:
    """(key, shape, copies, first, last) of rows with equal bytes; first and last are two of their places if there are two."""
    at = F.struct(*place)
    return rows.groupBy(key, "shape").agg((F.count("*") if count is None else count).alias("copies"), F.min(at).alias("first"), F.max(at).alias("last"))


def _members(classes: DataFrame, key: str) -> DataFrame:
    """The places that stand for a class: one, or two where it has copies."""
    both = F.when(F.col("copies") > 1, F.array("first", "last")).otherwise(F.array("first"))
    return classes.select(key, "shape", F.explode(both).alias("at")).select(key, "shape", "at.*")


def _part(key: Column, start: Column, sizes: Column, digests: Column) -> Column:
    """What `_cut` takes out of a text: one or more segments in a row, with the digest of each."""
    return F.struct(key.alias("key"), start.alias("start"), sizes.alias("sizes"), digests.alias("digests")).alias("part")


def _in_a_row(classes: DataFrame, most: int) -> DataFrame:
    """Copied classes whose two members follow each other: (key, sizes, digests, classes, one, two), `one` and `two` being the places of the members."""
    first, last = F.col("first"), F.col("last")
    rows = classes.select("anchor", "shape", first["doc_id"].alias("a"), last["doc_id"].alias("b"), first["start"].alias("start"), (last["start"] - first["start"]).alias("shift"), first["n"].alias("n"))
    order = Window.partitionBy("a", "b", "shift").orderBy("start")
    stretch = F.call_function("div", F.col("start"), F.lit(most).cast("long"))
    goes_on = (F.lag(F.col("start") + F.col("n")).over(order) == F.col("start")) & (F.lag(stretch).over(order) == stretch)
    rows = rows.withColumn("head", F.when(F.coalesce(goes_on, F.lit(False)), None).otherwise(F.col("start")))
    rows = rows.withColumn("begin", F.last("head", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.groupBy("a", "b", "shift", "begin").agg(F.array_sort(F.collect_list(F.struct("start", "n", "anchor", "shape"))).alias("c"))
    parts = F.transform("c", lambda x: F.struct(x["anchor"].alias("anchor"), x["shape"].alias("shape"), (x["start"] - F.col("begin")).alias("offset"), x["n"].alias("n")))
    place = lambda doc, at: F.struct(F.col(doc).alias("doc_id"), at.alias("start"))
    # The anchor of the first class is no other row's key: it belongs to this class alone.
    return rows.select(F.col("c")[0]["anchor"].alias("key"), F.col("c.n").alias("sizes"), F.col("c.shape").alias("digests"), parts.alias("classes"), place("a", F.col("begin")).alias("one"), place("b", F.col("begin") + F.col("shift")).alias("two"))


def _places(copied: DataFrame) -> DataFrame:
    return copied.select("key", "sizes", "digests", F.explode(F.array("one", "two")).alias("at")).select("key", "sizes", "digests", "at.*")


def _repeated(scratch: Scratch, parts: DataFrame, config: SubstringDedupConfig) -> DataFrame:
    """(key, shape, low, high): runs of repeated starts of the rows (key, shape, bytes) of each key."""
    size = parts.agg(F.coalesce(F.sum(F.octet_length("bytes")), F.lit(0))).first()[0]
    tasks = int(min(max(-(-size // config.task_bytes), parts.sparkSession.sparkContext.defaultParallelism), 100_000))
    spread = parts.repartition(tasks, "key").sortWithinPartitions("key", "shape")
    return scratch.save(spread.mapInArrow(_expand(config), "key long, shape long, low int, high int"), "repeated")


def remove_repeats(docs: DataFrame, config: SubstringDedupConfig = SubstringDedupConfig()) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Texts are UTF-8 bytes; null is empty. A byte goes if a `length`-byte string over it also starts anywhere
    else; texts shorter than that stay. Rows with a null doc_id stay whole. Other columns are ignored; an
    empty table gives an empty result.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    spans = repeated_spans(docs, config).groupBy("doc_id").agg(F.collect_list(F.struct("low", "high")).alias("s"))
    spans = spans.select("doc_id", F.col("s.low").alias("lows"), F.col("s.high").alias("highs"))
    joined = source.join(spans, "doc_id", "left").select("doc_id", "text", "lows", "highs")
    return joined.mapInArrow(_remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
