"""Near-duplicate documents by SetSketch registers, bands, joint likelihood and exact verification.

A document's shingle set is summarised by `registers` SetSketch registers: register i is
``1 - floor(log_b(minimum over the set of exponential variates of rate RATE))``, truncated to 16 bits. Registers of
unions are maxima, so sketches merge. Bands of register values retrieve candidates, the joint likelihood
of two sketches removes hopeless ones, and the full shingle sets of the rest are compared.

Recall: two sets with Jaccard J share a band with probability at least 1 - (1 - J**rows)**bands; at the
default 28 bands of 4 rows and J = 0.8 a link is missed with probability 4e-7, and the likelihood
estimate, whose standard error is at most 0.04 there, must fall 0.2 below the threshold to drop a pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bounded_batches, connected_components, sorted_groups
from .textbits import U64, document_sets, mix


#: Rate of the variates; it lifts the registers of one-element sets above the truncation at 0.
RATE = 64.0


@dataclass(frozen=True)
class NearDedupConfig:
    """Words per shingle, threshold in per cent, sketch and band sizes, and rows of a block that is compared at once and of a task."""

    width: int = 5
    percent: int = 80
    bands: int = 28
    rows: int = 4
    base: float = 1.001
    margin: float = 0.2
    block: int = 512
    task_rows: int = 8192

    @property
    def registers(self) -> int:
        return self.bands * self.rows


def set_sketch(items: np.ndarray, count: int, base: float) -> np.ndarray:
    """The registers of one set of 64-bit hashes."""
    seeds = mix(np.arange(1, count + 1, dtype=U64)) | U64(1)
    lowest = np.full(count, np.iinfo(np.uint64).max, U64)
    for at in range(0, len(items), 8192):
        lowest = np.minimum(lowest, np.multiply.outer(seeds, items[at : at + 8192]).min(axis=1))
    share = (lowest.astype(np.float64) + 1.0) / 2.0**64
    values = 1 - np.floor(np.log(-np.log1p(-np.minimum(share, 1 - 1e-16)) / RATE) / np.log(base))
    return np.clip(values, 0, 65535).astype(np.uint16)


def merge_sketches(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The registers of the union of two sets."""
    return np.maximum(left, right)


def joint_likelihood(share: np.ndarray, n_left: np.ndarray, n_right: np.ndarray, above: np.ndarray, below: np.ndarray, m: int, base: float) -> np.ndarray:
    """Log likelihood of a Jaccard similarity, given the registers that are larger on the left and on the right."""
    u, v = n_left / (n_left + n_right), n_right / (n_left + n_right)
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (base - 1) / base) / np.log(base)
    more, less = p(u - v * share), p(v - u * share)
    same = np.clip(1 - more - less, 1e-12, 1)
    return above * np.log(np.maximum(more, 1e-12)) + below * np.log(np.maximum(less, 1e-12)) + (m - above - below) * np.log(same)


def joint_estimate(n_left: np.ndarray, n_right: np.ndarray, above: np.ndarray, below: np.ndarray, m: int, base: float) -> np.ndarray:
    """The similarity of the greatest likelihood, to a hundredth of the largest that the sizes allow."""
    top = np.minimum(n_left / n_right, n_right / n_left)
    shares = [top * x for x in np.linspace(0, 1, 101)]
    fits = [joint_likelihood(j, n_left, n_right, above, below, m, base) for j in shares]
    return np.stack(shares)[np.argmax(fits, axis=0), np.arange(len(top))]


def joint_at_least(floor: float, n_left: np.ndarray, n_right: np.ndarray, above: np.ndarray, below: np.ndarray, m: int, base: float) -> np.ndarray:
    """Is the similarity of the greatest likelihood `floor` or more? The likelihood has one peak, so its slope there tells."""
    top = np.minimum(n_left / n_right, n_right / n_left)
    low, high = (joint_likelihood(np.minimum(top, floor + step), n_left, n_right, above, below, m, base) for step in (-0.002, 0.002))
    return (top >= floor) & (high >= low)


def _sketches(width: int, count: int, base: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, low, high, registers = [], [], [], []
            for _, items in document_sets(batch.column("text"), width):
                size.append(len(items))
                low.append(int(mix(items).sum(dtype=U64).astype(np.int64)))
                high.append(int(mix(items + U64(1)).sum(dtype=U64).astype(np.int64)))
                registers.append(set_sketch(items, count, base).tobytes() if len(items) else b"")
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(low, pa.int64()), pa.array(high, pa.int64()), pa.array(registers, pa.binary())],
                names=["doc_id", "n_shingles", "low", "high", "registers"],
            )

    return run


def _bands(bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            values = np.frombuffer(b"".join(batch.column("registers").to_pylist()), np.uint16).reshape(-1, bands, rows)
            factors = mix(np.arange(1, rows + 1, dtype=U64)) | U64(1)
            keys = mix((values.astype(U64) * factors).sum(axis=2, dtype=U64) + mix(np.arange(bands, dtype=U64) + U64(99)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys.astype(np.int64).ravel()), pa.array(np.tile(np.arange(bands, dtype=np.int32), batch.num_rows)), pa.array(np.repeat(batch.column("rep").to_numpy(), bands))],
                names=["bucket", "band", "rep"],
            )

    return run


def _linked(left: np.ndarray, right: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(left, right, assume_unique=True))
    return both > 0 and 100 * both >= percent * (len(left) + len(right) - both)


def _verify(width: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(document_sets(batch.column("text_a"), width), document_sets(batch.column("text_b"), width), strict=True)
            keep = [_linked(left, right, percent) for (_, left), (_, right) in pairs]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = pa.array([items.tobytes() for _, items in document_sets(batch.column("text"), width)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), sets], names=["rep", "items"])

    return run


class Block:
    """The rows of one block pair, and which of them may be linked."""

    def __init__(self, rows: pa.Table, config: NearDedupConfig) -> None:
        self.config = config
        order = np.argsort(rows.column("rep").to_numpy(), kind="stable")
        self.rows = rows = rows.take(pa.array(order))
        self.reps, self.comps, self.sizes, self.block = (rows.column(x).to_numpy().copy() for x in ("rep", "component", "n_shingles", "block"))
        self.i, self.j, self.band = (int(rows.column(x)[0].as_py()) for x in ("i", "j", "band"))
        self.values = np.frombuffer(b"".join(rows.column("registers").to_pylist()), np.uint16).reshape(-1, config.registers)

    def likely(self) -> Iterator[tuple[int, np.ndarray]]:
        """(row, later rows or rows of the other block) of other components that the sketches may link, most alike first.

        The joint likelihood decides; a count of equal registers, with twice its margin, only spares it hopeless pairs.
        A pair that shares several bands is left to the first.
        """
        c, m = self.config, self.config.registers
        for k in np.flatnonzero(self.block == self.i):
            other = (self.block == self.j) & (self.comps != self.comps[k])
            if self.i == self.j:
                other[: k + 1] = False
            other &= 100 * np.minimum(self.sizes, self.sizes[k]) >= c.percent * np.maximum(self.sizes, self.sizes[k])
            other = np.flatnonzero(other)
            same = self.values[other] == self.values[k]
            alike = same.sum(1)
            keep = alike >= m * (c.percent / 100 - 2 * c.margin)
            if self.band and keep.any():
                keep &= ~same[:, : self.band * c.rows].reshape(len(other), self.band, c.rows).all(2).any(1)
            other, alike = other[keep], alike[keep]
            if not len(other):
                continue
            above, below = (self.values[k] > self.values[other]).sum(1), (self.values[k] < self.values[other]).sum(1)
            n = self.sizes[other].astype(float)
            fit = joint_at_least(c.percent / 100 - c.margin, np.full(len(n), float(self.sizes[k])), n, above, below, m, c.base)
            if fit.any():
                yield int(k), other[fit][np.argsort(-alike[fit], kind="stable")]


_BLOCK = ["bucket", "i", "j"]


def _sift(config: NearDedupConfig):
    """Rows of each block pair that the sketches may link with another component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in sorted_groups(batches, _BLOCK):
            block = Block(rows, config)
            marked = np.zeros(rows.num_rows, bool)
            for k, other in block.likely():
                marked[k] = marked[other] = True
            if marked.any():
                yield from block.rows.filter(pa.array(marked)).to_batches()

    return run


def _compare_blocks(config: NearDedupConfig):
    """Links between components inside one block pair, one for each two components that meet.

    Whole sets of likely pairs are compared. Components that a link has joined aren't compared again, so no
    list of pairs arises.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in sorted_groups(batches, _BLOCK):
            block, out = Block(rows, config), []
            sets = [np.frombuffer(x, U64) for x in block.rows.column("items").to_pylist()]
            comps = block.comps
            for k, others in block.likely():
                for at in others:
                    if comps[at] != comps[k] and _linked(sets[k], sets[at], config.percent):
                        out.append((int(block.reps[k]), int(block.reps[at])))
                        comps[comps == comps[at]] = comps[k]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=["a", "b"])

    return run


def _likely(config: NearDedupConfig) -> Column:
    m, base, floor = config.registers, config.base, config.percent / 100 - config.margin

    @F.pandas_udf("boolean")
    def likely(n_a: pd.Series, n_b: pd.Series, r_a: pd.Series, r_b: pd.Series) -> pd.Series:
        if not len(n_a):
            return pd.Series([], dtype=bool)
        left = np.frombuffer(b"".join(r_a), np.uint16).reshape(-1, m)
        right = np.frombuffer(b"".join(r_b), np.uint16).reshape(-1, m)
        return pd.Series(joint_at_least(floor, n_a.to_numpy(float), n_b.to_numpy(float), (left > right).sum(1), (left < right).sum(1), m, base))

    return likely("n_a", "n_b", "r_a", "r_b")


def near_duplicates(docs: DataFrame, config: NearDedupConfig = NearDedupConfig()) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, n_shingles, component_id, kept.

    Texts are ASCII-lower-cased and cut at ASCII white space; a text of fewer words than `width` is one
    shingle; null, empty and blank texts have an empty set, link with nothing and are kept. Copies (equal
    sets) are one class with one representative, so a group of copies costs no pairs. A null doc_id gives a
    null component and kept = true. Rows that repeat a doc_id keep a row each. Other columns are ignored;
    an empty table gives an empty result.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    scratch = Scratch(spark, "near-dedup")
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketched = scratch.save(
        source.mapInArrow(
            _sketches(config.width, config.registers, config.base),
            "doc_id long, n_shingles long, low long, high long, registers binary",
        ),
        "sketches",
    )
    same = ["n_shingles", "low", "high"]
    usable = sketched.where("doc_id is not null and n_shingles > 0")
    reps = scratch.save(usable.groupBy(*same).agg(F.min("doc_id").alias("rep"), F.min("registers").alias("registers")), "classes")
    banded = scratch.save(reps.select("rep", "registers").mapInArrow(_bands(config.bands, config.rows), "bucket long, band int, rep long"), "bands")
    buckets = banded.groupBy("bucket").agg(F.min("rep").alias("pivot"), F.count("*").alias("size")).where("size > 1")
    buckets = scratch.save(buckets, "buckets")  # so that a large bucket's rows can be split in the join
    members = scratch.save(banded.join(buckets.hint("merge"), "bucket"), "members")
    scratch.drop(banded)

    ids = members.select(F.col("rep").alias("doc_id")).distinct()
    texts = scratch.save(source.where("doc_id is not null").join(ids.hint("merge"), "doc_id", "left_semi"), "texts")
    light = reps.select("rep", "n_shingles", "registers")

    # Members are compared with the smallest member of each of their buckets.
    star = members.where("rep <> pivot").select(F.col("pivot").alias("a"), F.col("rep").alias("b")).distinct()
    star = star.join(light.toDF("a", "n_a", "r_a"), "a").join(light.toDF("b", "n_b", "r_b"), "b")
    pairs = scratch.save(star.where(_likely(config)).select("a", "b"), "star-pairs")
    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    both = pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b").select("a", "b", "text_a", "text_b")
    first = scratch.save(both.mapInArrow(_verify(config.width, config.percent), "a long, b long"), "star-links")

    # Members of one bucket that this left in different components are compared with each other: sketches first,
    # then the sets of the rows that these leave.
    joined = connected_components(scratch, first)
    labelled = members.join(joined, members.rep == joined.node, "left").select("bucket", "band", "rep", "size", F.coalesce("component", "rep").alias("component"))
    labelled = scratch.save(labelled, "labelled")
    split = labelled.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("bucket")
    crowds = labelled.join(split, "bucket").groupBy("bucket", "component").agg(F.count("*").alias("c"))
    crowds = crowds.groupBy("bucket").agg(F.max_by("component", F.struct("c", "component")).alias("main"), F.max("c").alias("n_main"), (F.sum("c") - F.max("c")).alias("n_minor"))
    crowds = scratch.save(crowds, "open-buckets")
    # Blocks of the largest component come first; they aren't compared with each other.
    blocks_of = lambda c: F.ceil(F.col(c) / config.block).cast("int")
    open_rows = labelled.join(crowds, "bucket").withColumn("is_main", F.col("component") == F.col("main")).withColumn("from", blocks_of("n_main")).withColumn("to", blocks_of("n_main") + blocks_of("n_minor") - 1)
    own = lambda n: F.pmod(F.xxhash64("rep"), n).cast("int")
    open_rows = open_rows.withColumn("block", F.when(F.col("is_main"), own(F.col("from"))).otherwise(F.col("from") + own(F.col("to") - F.col("from") + 1)))
    open_rows = open_rows.withColumn("low", F.when(F.col("is_main"), F.col("from")).otherwise(F.lit(0))).select("bucket", "band", "rep", "component", "block", "low", "to")
    open_rows = scratch.save(open_rows, "open-rows")
    copies = open_rows.agg(F.coalesce(F.sum(F.col("to") - F.col("low") + 1), F.lit(0))).first()[0]
    tasks = int(min(max(-(-copies // config.task_rows), spark.sparkContext.defaultParallelism), 100_000))
    paired = open_rows.join(light, "rep").withColumn("other", F.explode(F.sequence("low", "to")))
    paired = paired.select("bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "band", "block", "rep", "component", "n_shingles", "registers")
    sent = lambda rows: rows.repartition(tasks, *_BLOCK).sortWithinPartitions(*_BLOCK)
    likely = scratch.save(sent(paired).mapInArrow(_sift(config), paired.schema), "likely-rows")
    sets = texts.join(likely.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi").select("doc_id", "text")
    sets = scratch.save(sets.mapInArrow(_sets(config.width), "rep long, items binary"), "sets").dropDuplicates(["rep"])
    second = scratch.save(sent(likely.join(sets, "rep")).mapInArrow(_compare_blocks(config), "a long, b long"), "cross-links")

    components = connected_components(scratch, first.unionByName(second))
    classes = reps.join(components, reps.rep == components.node, "left").select(*same, F.coalesce("component", "rep").alias("component_id"))
    rows = sketched.select("doc_id", *same).join(classes, same, "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return rows.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    )


def without_near_duplicates(docs: DataFrame, config: NearDedupConfig = NearDedupConfig()) -> DataFrame:
    """`docs` with the smallest doc_id of each component only; all columns and the documents without links stay."""
    extra = near_duplicates(docs, config).where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(extra.hint("merge"), "doc_id", "left_anti").select(docs.columns)
