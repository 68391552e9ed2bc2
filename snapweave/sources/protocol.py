"""Readers of reference listings, capability lists and commit bodies kept as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Features of a target by the column that tells of them (fixed values).
FEATURES = {"atomic": "atomic", "delete_refs": "delete-refs", "no_thin": "no-thin", "ofs_delta": "ofs-delta", "report_status": "report-status", "sideband": "side-band", "sideband_64k": "side-band-64k"}


def listed_refs(lines: DataFrame) -> DataFrame:
    """(ref, hash, head_target) of listing lines (line): `<hash> <ref> [attributes]`.

    Unborn refs are dropped. HEAD has a null hash and the ref that it points to; other rows a null head_target.
    """
    parts = F.split(F.trim(F.regexp_replace("line", r"\s+", " ")), " ")
    rows = lines.select(F.get(parts, F.lit(0)).alias("hash"), F.get(parts, F.lit(1)).alias("ref"), "line").where(F.col("ref").isNotNull() & (F.col("hash") != "unborn"))
    head = F.col("ref") == "HEAD"
    target = F.nullif(F.regexp_extract("line", r"symref-target:(\S+)", 1), F.lit(""))
    return rows.select("ref", F.when(~head, F.col("hash")).alias("hash"), F.when(head, target).alias("head_target"))


def read_listed_refs(spark: SparkSession, path: str) -> DataFrame:
    return listed_refs(spark.read.text(path).withColumnRenamed("value", "line"))


def advertised_refs(rows: DataFrame) -> DataFrame:
    """(ref, hash) of an older advertisement (ref, hash, at) without peeled tags; the last of repeated names wins."""
    plain = rows.where(~F.col("ref").endswith("^{}") & (F.col("ref") != "HEAD"))
    return plain.groupBy("ref").agg(F.max_by("hash", "at").alias("hash"))


def advertised_head(capabilities: DataFrame) -> DataFrame:
    """One row, `head`: the target of the first `symref` value (at, value) that begins with HEAD:."""
    found = F.regexp_extract("value", "^HEAD:(.*)$", 1)
    return capabilities.where(F.col("value").startswith("HEAD:")).agg(F.min_by(found, "at").alias("head"))


def capability_map(text: Column) -> Column:
    """MAP of the lines of an advertisement; a line without `=` maps to an empty string, the last of a name wins."""
    lines = F.filter(F.split(text, "\n"), lambda x: x != "")
    pairs = F.transform(lines, lambda x: F.struct(F.regexp_extract(x, "^([^=]*)", 1).alias("key"), F.regexp_replace(x, "^[^=]*=?", "").alias("value")))
    last = F.filter(pairs, lambda x, i: ~F.exists(F.slice(pairs, i + F.lit(2), F.size(pairs)), lambda y: y["key"] == x["key"]))
    return F.map_from_entries(last)


def supports(capabilities: Column, name: str) -> Column:
    return F.map_contains_key(capabilities, name)


def fetch_supports(capabilities: Column, feature: str) -> Column:
    """Whether the `fetch` value lists a feature."""
    return F.coalesce(F.array_contains(F.split(F.try_element_at(capabilities, F.lit("fetch")), " "), feature), F.lit(False))


def preferred_sideband(names: Column) -> Column:
    return F.when(F.array_contains(names, "side-band-64k"), "side-band-64k").when(F.array_contains(names, "side-band"), "side-band").otherwise("")


def target_features(targets: DataFrame) -> DataFrame:
    """(target, one boolean for each feature) of rows (target, names ARRAY)."""
    return targets.select("target", *(F.array_contains("names", name).alias(column) for column, name in FEATURES.items()))


def commit_parents(body: Column) -> Column:
    """Parents of a commit body: the run of 40-digit parent lines right after the tree line; a zero or malformed one ends it."""
    run = F.regexp_extract(body, r"^tree [^\n]*\n((?:parent (?!0{40})[0-9a-fA-F]{40}(?:\n|$))*)", 1)
    return F.transform(F.regexp_extract_all(run, F.lit("parent ([0-9a-fA-F]{40})"), 1), lambda x: F.lower(x))


def last_write(rows: DataFrame) -> DataFrame:
    """(ref, hash): one row for each name, the last by `at`; rows that aren't hash refs are dropped."""
    order = Window.partitionBy("ref").orderBy(F.col("at").desc())
    return rows.where("kind = 'hash'").withColumn("_n", F.row_number().over(order)).where("_n = 1").select("ref", "hash")
