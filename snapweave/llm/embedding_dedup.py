"""Near-duplicate vectors by random-hyperplane signs in several tables, exact cosines and components.

Vectors are compared within one label and dimension. Equal vectors are one class, so copies cost nothing.
A pair at the threshold falls into one bucket of a table with probability p**bits, where p = 1 - angle/pi;
bits follow the size of the largest label (buckets stay near `bucket` vectors), and the number of tables
follows from bits, so that a pair at the threshold escapes all tables with probability `miss` at most.
Buckets are compared in block pairs of bounded size: first by the signs of all tables, which say how far apart
two vectors may be, and then, for the rows that these leave, by the vectors themselves. A pair that shares
several buckets counts in the first of them, so no list of pairs is made: a block gives link counts and a
spanning set of links.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, connected_components, sorted_groups


@dataclass(frozen=True)
class EmbeddingDedupConfig:
    """Cosine threshold, chance to miss a pair at it, vectors aimed at in a bucket, vectors of a block and of a task, and seed of the planes."""

    threshold: float = 0.98
    miss: float = 1e-7
    bucket: int = 48
    block: int = 512
    task_rows: int = 65_536
    seed: int = 7

    def shape(self, largest: int) -> tuple[int, int]:
        """(bits, tables) for the number of different vectors of the largest label."""
        bits = int(min(30, max(4, np.ceil(np.log2(max(largest, 1) / self.bucket)))))
        hit = (1 - np.arccos(self.threshold) / np.pi) ** bits
        return bits, int(np.ceil(np.log(self.miss) / np.log1p(-hit)))

    def most_different(self, n: int) -> int:
        """Signs out of n beyond which a pair at the threshold differs with chance miss / 100 at most (Chernoff's bound)."""
        p = np.arccos(self.threshold) / np.pi
        share = np.clip(np.arange(n + 1) / n, 1e-12, 1 - 1e-12)
        bound = -n * (share * np.log(share / p) + (1 - share) * np.log((1 - share) / (1 - p)))
        enough = np.flatnonzero((share > p) & (bound <= np.log(self.miss / 100)))
        return int(enough[0]) if len(enough) else n


def planes(dimension: int, bits: int, tables: int, seed: int) -> np.ndarray:
    return np.random.default_rng((seed, dimension)).standard_normal((dimension, bits * tables))


def scaled(matrix: np.ndarray) -> np.ndarray:
    """Rows times powers of two that bring their largest component to between a half and one, so that neither norms nor products leave the range of doubles."""
    return np.ldexp(matrix, -np.frexp(np.abs(matrix).max(axis=1))[1][:, None])


def _codes(bits: int, tables: int, seed: int):
    """Class rows become one row for each table: the bucket, and the signs of all tables."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                for at in range(0, part.num_rows, 256):
                    some = part.slice(at, 256)
                    matrix = scaled(some.column("vector").flatten().to_numpy().reshape(some.num_rows, dim))
                    signs = matrix @ planes(int(dim), bits, tables, seed) >= 0
                    codes = (signs.reshape(-1, tables, bits) * (1 << np.arange(bits))).sum(axis=2).astype(np.int32)
                    rows = pa.array(np.repeat(np.arange(some.num_rows), tables))
                    packed = pa.array([x.tobytes() for x in np.packbits(signs, axis=1)])
                    yield pa.RecordBatch.from_arrays(
                        [
                            some.column("label").take(rows),
                            some.column("dim").take(rows),
                            pa.array(np.tile(np.arange(tables, dtype=np.int32), some.num_rows)),
                            pa.array(codes.ravel()),
                            some.column("node").take(rows),
                            packed.take(rows),
                        ],
                        names=["label", "dim", "table", "code", "node", "signs"],
                    )

    return run


_BLOCK = ["label", "dim", "table", "code", "i", "j"]


def _sides(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, bool]:
    """Rows of the two blocks of a pair; for a block against itself, the same rows twice."""
    block, i, j = rows.column("block").to_numpy(), rows.column("i")[0].as_py(), rows.column("j")[0].as_py()
    return np.flatnonzero(block == i), np.flatnonzero(block == j), i == j


def _signs(rows: pa.Table, n: int) -> np.ndarray:
    packed = np.frombuffer(b"".join(rows.column("signs").to_pylist()), np.uint8).reshape(rows.num_rows, -1)
    return np.unpackbits(packed, axis=1)[:, :n]


def _sift(config: EmbeddingDedupConfig, bits: int, tables: int):
    """Rows of each block pair that some row on the other side may be near to by the signs of all tables."""
    n = bits * tables
    most = config.most_different(n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in sorted_groups(batches, _BLOCK):
            left, right, own = _sides(rows)
            if not len(left) or not len(right) or (own and len(left) < 2):
                continue
            signs = _signs(rows, n).astype(np.float32) * 2 - 1
            near = signs[left] @ signs[right].T >= n - 2 * most
            if own:
                np.fill_diagonal(near, False)
            keep = np.zeros(rows.num_rows, bool)
            keep[left[near.any(axis=1)]] = True
            keep[right[near.any(axis=0)]] = True
            if keep.any():
                yield from rows.filter(pa.array(keep)).to_batches()

    return run


def _compare(config: EmbeddingDedupConfig, bits: int, tables: int):
    """(node, links, peer): links of each row in each block pair, weighted by copies, and the smallest node it reaches there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in sorted_groups(batches, _BLOCK):
            left, right, own = _sides(rows)
            if not len(left) or not len(right):
                continue
            dim, table = rows.column("dim")[0].as_py(), rows.column("table")[0].as_py()
            matrix = scaled(rows.column("vector").combine_chunks().flatten().to_numpy().reshape(rows.num_rows, dim))
            size = np.sqrt((matrix * matrix).sum(1))
            linked = (matrix[left] @ matrix[right].T) / size[left][:, None] / size[right][None, :] >= config.threshold
            if own:
                np.fill_diagonal(linked, False)
            near = np.argwhere(linked)
            if len(near) and table:
                earlier = _signs(rows, table * bits).reshape(-1, table, bits)
                both = [(earlier[left[x[:, 0]]] == earlier[right[x[:, 1]]]).all(2).any(1) for x in np.array_split(near, -(-len(near) // 20_000))]
                gone = near[np.concatenate(both)]
                linked[gone[:, 0], gone[:, 1]] = False
            if not linked.any():
                continue
            nodes, copies = rows.column("node").to_numpy(), rows.column("copies").to_numpy()
            links = np.zeros(rows.num_rows, np.int64)
            links[left] += linked @ copies[right]
            if not own:
                links[right] += linked.T @ copies[left]
            names, top = nodes.copy(), np.iinfo(np.int64).max
            while True:  # the smallest reachable row: a spanning set of the links
                new = names.copy()
                new[left] = np.minimum(new[left], np.where(linked, names[right][None, :], top).min(1))
                new[right] = np.minimum(new[right], np.where(linked, new[left][:, None], top).min(0))
                if (new == names).all():
                    break
                names = new
            found = (links > 0) | (names != nodes)
            yield pa.RecordBatch.from_arrays([pa.array(x[found]) for x in (nodes, links, names)], names=["node", "links", "peer"])

    return run


def embedding_duplicates(vectors: DataFrame, config: EmbeddingDedupConfig = EmbeddingDedupConfig()) -> DataFrame:
    """One row per row of `vectors` (vec_id, embedding, label): vec_id, n_links, component_id, kept.

    Rows with a null label or id, and vectors that are null, empty, zero or hold a null, infinite or
    not-a-number component, link with nothing and are kept. Rows that repeat a vec_id are vectors of their
    own under one id. Vectors of different lengths never link. Other columns are ignored; an empty table
    gives an empty result.
    """
    scratch = Scratch(vectors.sparkSession, "embeddings")
    source = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"), "label")
    sound = F.forall("vector", lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    usable = source.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(sound, F.lit(False)))
    classed = usable.withColumn("vector", F.transform("vector", lambda x: x + F.lit(0.0)))  # -0.0 becomes 0.0
    key = ["label", "vector"]
    classes = classed.groupBy(*key).agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")).withColumn("dim", F.size("vector"))
    classes = scratch.save(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    largest = classes.groupBy("label", "dim").count().agg(F.max("count")).first()[0] or 0
    bits, tables = config.shape(largest)
    kind = classes.schema["label"].dataType.simpleString()
    coded = classes.select("label", "dim", "node", "vector").mapInArrow(_codes(bits, tables, config.seed), f"label {kind}, dim int, table int, code int, node long, signs binary")
    coded = scratch.save(coded, "codes")
    bucket = ["label", "dim", "table", "code"]
    sizes = scratch.save(coded.groupBy(*bucket).agg(F.count("*").alias("size")).where("size > 1"), "buckets")
    rows = coded.join(sizes, bucket).withColumn("n", F.ceil(F.col("size") / config.block).cast("int"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("node"), F.col("n")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    rows = rows.select(*bucket, F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "signs")
    total = sizes.agg(F.coalesce(F.sum(F.col("size") * F.ceil(F.col("size") / config.block)), F.lit(0))).first()[0]
    tasks = int(min(max(-(-total // config.task_rows), vectors.sparkSession.sparkContext.defaultParallelism), 100_000))
    sent = lambda frame: frame.repartition(tasks, *_BLOCK).sortWithinPartitions(*_BLOCK)
    near = scratch.save(sent(rows).mapInArrow(_sift(config, bits, tables), rows.schema), "near-rows")
    whole = near.join(classes.select("node", "copies", "vector"), "node")
    found = scratch.save(sent(whole).mapInArrow(_compare(config, bits, tables), "node long, links long, peer long"), "links")
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    components = connected_components(scratch, found.where("node <> peer").select(F.col("node").alias("a"), F.col("peer").alias("b")).distinct())
    reached = classes.select("node", "rep").join(components, "node")
    smallest = reached.groupBy("component").agg(F.min("rep").alias("least"))
    placed = scratch.save(components.join(smallest, "component").select("node", "least"), "placed")
    named = classes.join(counts, "node", "left").join(placed, "node", "left")
    named = named.select(*key, (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("least", "rep").alias("component_id"))
    linked = classed.join(named, key).select("vec_id", "n_links", "component_id")
    alone = source.where(F.col("vec_id").isNull() | F.col("label").isNull() | ~F.coalesce(sound, F.lit(False)))
    result = linked.unionByName(alone.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return result.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
