"""Joins by prefix: names against a table of prefixes, and hex prefixes against an index of hashes."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..storage import Scratch

SHORTEST = 7


#: What a row of a sweep is; of equal names, entries come before the refs that they touch.
_PREFIX, _EXACT, _REF = 0, 1, 2


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (_name, _what, ..): refs with `_hit`, by entries of this range; a last row says by `_last` which prefix was the last that no other covers.

    Names under a prefix follow it without a gap, so one prefix is all that there is to keep.
    """
    last, exact, empty = b"", None, None
    for batch in batches:
        what, hits = batch.column("_what").to_pylist(), []
        for name, kind in zip(batch.column("_name").to_pylist(), what, strict=True):
            if kind == _REF:
                hits.append(name is not None and (name == exact or (last != b"" and name.startswith(last))))
            elif kind == _EXACT:
                exact = name
            elif last == b"" or not name.startswith(last):
                last = name
        rows = batch.filter(pc.equal(batch.column("_what"), _REF)).drop_columns(["_what"])
        rows = rows.append_column("_hit", pa.array(hits, pa.bool_())).append_column("_last", pa.nulls(len(hits), pa.binary()))
        empty = rows.slice(0, 0)
        yield rows
    if empty is not None:
        yield pa.RecordBatch.from_arrays([*(pa.nulls(1, f.type) for f in empty.schema if f.name != "_last"), pa.array([last], pa.binary())], names=empty.schema.names)


def excluded_by(refs: DataFrame, prefixes: DataFrame, exact: DataFrame | None = None) -> DataFrame:
    """The rows of `refs` (ref, ..) with `excluded`: does the name begin with one of `prefixes` (prefix) or equal one of `exact` (ref)?

    White space around entries doesn't count, blank entries count for nothing. Names and entries are sorted together in ranges
    and swept once; a task keeps one prefix, so neither the number of prefixes nor that of the names under one matters. What a
    prefix covers in later ranges follows from the last prefix of each range.
    """
    spark = refs.sparkSession

    def entries(frame: DataFrame, name: str, what: int) -> DataFrame:
        plain = frame.select(F.regexp_replace(name, r"^\s+|\s+$", "").cast("binary").alias("_name")).where(F.octet_length("_name") > 0)
        return plain.withColumn("_what", F.lit(what).cast("byte"))

    rows = refs.select(F.col("ref").cast("binary").alias("_name"), F.lit(_REF).cast("byte").alias("_what"), *(c for c in refs.columns if c != "ref"))
    rows = rows.unionByName(entries(prefixes, "prefix", _PREFIX), allowMissingColumns=True)
    if exact is not None:
        rows = rows.unionByName(entries(exact, "ref", _EXACT), allowMissingColumns=True)
    ordered = rows.repartitionByRange("_name").sortWithinPartitions("_name", "_what")
    schema = StructType([StructField(f.name, f.dataType) for f in ordered.schema if f.name != "_what"]).add("_hit", "boolean").add("_last", "binary")
    swept = Scratch(spark, "excluded").save(ordered.mapInArrow(_sweep, schema).withColumn("_range", F.spark_partition_id()), "swept")
    before, last = [], b""
    for at, own in sorted((r["_range"], bytes(r["_last"])) for r in swept.where("_last is not null").select("_range", "_last").collect()):  # a row for each range
        before.append((at, last or None))
        last = own if own and not (last and own.startswith(last)) else last
    covered = F.coalesce(F.startswith(F.col("_name"), F.col("_before")), F.lit(False))
    told = swept.where("_last is null").join(F.broadcast(spark.createDataFrame(before, "_range int, _before binary")), "_range", "left")
    return told.select(*(F.col("_name").cast("string").alias("ref") if c == "ref" else F.col(c) for c in refs.columns), (F.col("_hit") | covered).alias("excluded"))


def shared_length(a: Column, b: Column) -> Column:
    """How many characters two hashes of at most 64 digits begin with alike; 0 for an absent one."""
    return F.when(a.isNull() | b.isNull(), 0).otherwise(F.size(F.filter(F.sequence(F.lit(1), F.lit(64)), lambda n: (n <= F.length(a)) & (F.substring(a, F.lit(1), n) == F.substring(b, F.lit(1), n)))))


class PrefixIndex:
    """Hashes (hash) in ranges, each a folder of its own, with the length from which on a beginning names that hash alone.

    Ranges are of first seven digits, so all hashes that a look-up can't tell apart lie in one range, and what a hash shares
    with any of them it shares with a neighbour there: one shuffle and one sort make the index. `bounds` (range, low, high)
    says which range holds what; a look-up reads the ranges that its prefixes fall into, and no others.
    """

    def __init__(self, hashes: DataFrame, ranges: int | None = None) -> None:
        self._scratch = Scratch(hashes.sparkSession, "prefixes")
        self.path = f"{self._scratch.root}/index"
        self._ranged(hashes, ranges).write.partitionBy("range").option("compression", "zstd").parquet(self.path)
        self.table = hashes.sparkSession.read.schema("hash string, alone_from int, range int").parquet(self.path)
        self.bounds = self._scratch.save(self.table.groupBy("range").agg(F.min("hash").alias("low"), F.max("hash").alias("high")), "bounds")

    @staticmethod
    def _ranged(hashes: DataFrame, ranges: int | None) -> DataFrame:
        """(hash, alone_from, range) of the distinct hashes, sorted by range and hash."""
        known = hashes.select(F.lower("hash").alias("hash")).where("hash is not null").withColumn("head", F.substring("hash", 1, SHORTEST))
        spread = (known.repartitionByRange(ranges, "head") if ranges else known.repartitionByRange("head")).withColumn("range", F.spark_partition_id())
        order = Window.partitionBy("range", "head").orderBy("hash")
        rows = spread.withColumn("left", F.lag("hash").over(order)).where("left is null or left <> hash").withColumn("right", F.lead("hash").over(order))
        alone = F.greatest(F.lit(SHORTEST), 1 + shared_length(F.col("hash"), F.col("left")), 1 + shared_length(F.col("hash"), F.col("right")))
        return rows.select("hash", alone.cast("int").alias("alone_from"), "range")

    def _placed(self, prefixes: DataFrame) -> DataFrame:
        """(prefix, range) of the range that may hold hashes with the prefix; there are at most as many bounds as ranges."""
        touches = (F.col("high") >= F.col("prefix")) & (F.left("low", F.length("prefix")) <= F.col("prefix"))
        return prefixes.join(F.broadcast(self.bounds), touches).select("prefix", "range")

    def resolve(self, prefixes: DataFrame) -> DataFrame:
        """(prefix, verdict, hash) of hex prefixes (prefix) of 7 digits and more: unique, ambiguous or none."""
        wanted = self._scratch.save(prefixes.select(F.lower("prefix").alias("prefix")).where("prefix is not null").distinct(), "wanted")
        placed = self._scratch.save(self._placed(wanted), "placed")  # of known size, so that a few prefixes go to the hashes and not these to them
        touched = [r.range for r in placed.select("range").distinct().collect()]  # at most as many as there are ranges
        head = lambda x: F.substring(x, 1, SHORTEST).alias("head")
        near = placed.select("prefix", "range", head("prefix")).join(self.table.where(F.col("range").isin(touched)).select("hash", "alone_from", "range", head("hash")), ["range", "head"])
        found = near.where(F.col("hash").startswith(F.col("prefix"))).groupBy("prefix").agg(F.min("hash").alias("hash"), F.min("alone_from").alias("alone_from"))
        out = wanted.join(found, "prefix", "left")
        alone = F.length("prefix") >= F.col("alone_from")
        verdict = F.when(F.col("hash").isNull(), "none").when(alone, "unique").otherwise("ambiguous")
        return out.select("prefix", verdict.alias("verdict"), F.when(alone, F.col("hash")).alias("hash"))
