"""What several operators share: groups of sorted rows, and connected components on tables in the cluster's shared folder."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import Scratch

#: Bytes of whole texts that go to a Python worker at a time; the JVM side of a task, the worker and what it makes of them hold several times as many.
BATCH_BYTES = 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """From now on the session sends at most `BATCH_BYTES` at a time to Python workers, or one longer row; a smaller setting stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch()) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of every value of `keys`, by which the batches are sorted; keys have no nulls."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        new = np.zeros(n, bool)
        new[0] = bool(held) and any(held[0].column(k)[0] != batch.column(k)[0] for k in keys)
        for k in keys:
            new[1:] |= pc.not_equal(batch.column(k)[1:], batch.column(k)[:-1]).to_numpy(zero_copy_only=False)
        cuts = [0, *np.flatnonzero(new).tolist(), n] if not new[0] else [*np.flatnonzero(new).tolist(), n]
        if new[0]:
            yield pa.Table.from_batches(held).combine_chunks()
            held = []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if held and a:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def connected_components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """Smallest reachable id for every id in `edges` (a, b): rows (node, component).

    Alternating large-star and small-star rounds; every round is two grouped minima with
    map-side combine and two joins, and leaves one table in the shared folder. Self-loops and
    null ends are ignored; an empty edge table gives an empty result.
    """
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    current, before = scratch.save(pairs, "edges"), None
    while True:
        seen = current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == before or not seen[0]:
            break
        before = seen
        both = current.select("u", "v").unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = scratch.save(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "star")
        scratch.drop(current)
        current = after
    roots = current.select(F.col("v").alias("node")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component"))
    )
