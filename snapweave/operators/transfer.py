"""Summaries of transfers and benchmark runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import refs as R
from ..plans.actions import positions

#: Samples in a rate window, and spans in microseconds under which a rate means nothing or a side counts as idle (fixed values).
SAMPLES, LEAST_SPAN, IDLE = 10, 50_000, 750_000


def service_stats(log: DataFrame) -> DataFrame:
    """(name, requests, request_bytes, response_bytes) of rows (name, request_bytes, response_bytes); unknown lengths count 0."""
    known = lambda c: F.sum(F.greatest(F.coalesce(c, F.lit(0)), F.lit(0)))
    return log.groupBy("name").agg(F.count("*").alias("requests"), known("request_bytes").alias("request_bytes"), known("response_bytes").alias("response_bytes"))


def side_stats(log: DataFrame, start: Column, now: Column) -> DataFrame:
    """(label, bytes, active_us, idle_us) of rows (label, at_us, bytes): spans from start to last byte and on to now."""
    last = F.max(F.when(F.col("bytes") > 0, F.col("at_us")))
    rows = log.groupBy("label").agg(F.sum("bytes").alias("bytes"), last.alias("last"))
    span = lambda c: F.coalesce(F.greatest(c, F.lit(0)), F.lit(0)).cast("long")
    return rows.select("label", "bytes", span(F.col("last") - start).alias("active_us"), span(now - F.col("last")).alias("idle_us"))


def average_rates(sides: DataFrame) -> DataFrame:
    """(label, rate) in bytes a second over the active span; 0 if that is short or nothing was sent."""
    usable = (F.col("active_us") >= LEAST_SPAN) & (F.col("bytes") > 0)
    return sides.select("label", F.when(usable, F.col("bytes").cast("double") / (F.col("active_us").cast("double") / F.lit(1e6))).otherwise(F.lit(0.0)).alias("rate"))


def _blocked(samples: DataFrame, block: int, before: int = 0, after: int = 0) -> tuple[DataFrame, Column]:
    """(rows, are they of their own block): samples in order of label and time, cut into blocks that also get the last rows before and the first after them.

    So windows over a label are computed block by block, however many samples it has.
    """
    placed = positions(samples, ["label", "at_us", "total"])
    own = F.call_function("div", F.col("pos"), F.lit(block).cast("long"))
    at = F.pmod("pos", F.lit(block))
    places = F.array(own, F.when(at >= block - before, own + 1), F.when(at < after, own - 1))
    rows = placed.withColumn("block", F.explode(F.array_compact(places)))
    return rows, F.col("block") == own


def instant_rates(samples: DataFrame, block: int = 100_000) -> DataFrame:
    """(label, at_us, total, rate): bytes a second between the oldest and newest of the last ten samples (label, at_us, total)."""
    rows, own = _blocked(samples.select("label", "at_us", "total"), block, before=SAMPLES - 1)
    ring = Window.partitionBy("label", "block").orderBy("pos").rowsBetween(-(SAMPLES - 1), 0)
    span = F.col("at_us") - F.first("at_us").over(ring)
    grown = F.col("total") - F.first("total").over(ring)
    rate = F.when((F.count("*").over(ring) >= 2) & (span >= LEAST_SPAN) & (grown > 0), grown.cast("double") / (span.cast("double") / F.lit(1e6)))
    return rows.select("label", "at_us", "total", F.coalesce(rate, F.lit(0.0)).alias("rate"), own.alias("own")).where("own").drop("own")


def idle_marks(samples: DataFrame, block: int = 100_000) -> DataFrame:
    """(label, at_us, total, done): whether at least the idle span passes before the label's next sample, or none comes."""
    rows, own = _blocked(samples.select("label", "at_us", "total"), block, after=1)
    gap = F.lead("at_us").over(Window.partitionBy("label", "block").orderBy("pos")) - F.col("at_us")
    return rows.select("label", "at_us", "total", (gap.isNull() | (gap >= IDLE)).alias("done"), own.alias("own")).where("own").drop("own")


def running_totals(log: DataFrame, block: int = 100_000) -> DataFrame:
    """(label, at_us, total) of rows (label, at_us, bytes, event_id): sums up to each row, from sums inside blocks and of the blocks before."""
    placed = positions(log.select("label", "at_us", "event_id", "bytes"), ["label", "at_us", "event_id"]).withColumn("block", F.call_function("div", F.col("pos"), F.lit(block).cast("long")))
    inside = placed.withColumn("part", F.sum("bytes").over(Window.partitionBy("label", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)))
    sums = placed.groupBy("label", "block").agg(F.sum("bytes").alias("sum"))  # one row for each block
    before = sums.select("label", "block", (F.sum("sum").over(Window.partitionBy("label").orderBy("block")) - F.col("sum")).alias("before"))
    return inside.join(before, ["label", "block"]).select("label", "at_us", (F.col("before") + F.col("part")).alias("total"))


def peaks(samples: DataFrame) -> DataFrame:
    """(run, elapsed_us, peak_alloc, peak_heap, total_alloc, gc) of rows (run, at_us, alloc, heap, total_alloc, gc): peaks, and growth from first to last."""
    grown = lambda c: F.max_by(c, "at_us") - F.min_by(c, "at_us")
    return samples.groupBy("run").agg((F.max("at_us") - F.min("at_us")).alias("elapsed_us"), F.max("alloc").alias("peak_alloc"), F.max("heap").alias("peak_heap"), grown("total_alloc").alias("total_alloc"), grown("gc").alias("gc"))


def bench_summary(runs: DataFrame) -> DataFrame:
    """One row for rows (wall_ms, elapsed_ms, peak_alloc, peak_heap, total_alloc, gc, relay_mode, batching, batch_count, planned, error).

    Failed runs count as failed only. Batch figures are over batched runs; absent figures are 0.
    """
    ok = F.col("error").isNull() | (F.col("error") == "")
    batched = ok & F.coalesce("batching", F.lit(False))
    planned = F.coalesce("planned", F.lit(0))
    zero = lambda c, kind="long": F.coalesce(c, F.lit(0)).cast(kind)
    out = [F.count("*").alias("runs"), F.count_if(ok).alias("ok_runs"), F.count_if(~ok).alias("failed_runs"), F.count_if(batched).alias("batched_runs")]
    for name, value, which in (("wall_ms", F.col("wall_ms"), ok), ("elapsed_ms", F.col("elapsed_ms"), ok), ("batch_count", F.col("batch_count"), batched), ("planned", planned, batched)):
        picked = F.when(which, value)
        out += [zero(F.min(picked)).alias(f"min_{name}"), zero(F.max(picked)).alias(f"max_{name}"), zero(F.sum(picked).cast("double") / F.nullif(F.count_if(which), F.lit(0).cast("long")).cast("double"), "double").alias(f"avg_{name}")]
    for name in ("peak_alloc", "peak_heap", "total_alloc", "gc"):
        out.append(zero(F.max(F.when(ok, F.col(name)))).alias(f"max_{name}"))
    modes = F.collect_set(F.when(ok & (F.trim("relay_mode") != ""), F.trim("relay_mode")))
    return runs.agg(*out, F.array_join(F.array_sort(modes), ",").alias("relay_modes"))


def type_counts(objects: DataFrame) -> DataFrame:
    return objects.groupBy("type").agg(F.count("*").alias("objects"))


def side_lines(sides: DataFrame, fallback_us: int, finished: bool = False) -> DataFrame:
    """(label, line) for rows (label, display, bytes, active_us, idle_us, instant): host, bytes and rate, the flow arrow on its side.

    A side that moves shows its instant rate; one that is idle or finished its average, and a mark.
    """
    name = R.short_host(F.when(F.coalesce("display", F.lit("")) == "", F.col("label")).otherwise(F.col("display")))
    done = (F.col("bytes") > 0) & (F.lit(finished) | (F.col("idle_us") >= IDLE))
    span = F.when(F.col("active_us") > 0, F.col("active_us")).otherwise(F.lit(fallback_us))
    average = R.rate_text(F.col("bytes"), span)
    speed = F.when(~done & (F.col("instant") > 0), F.concat(R.human_bytes(F.col("instant").cast("long")), F.lit("/s"))).otherwise(average)
    rate = F.concat(R.human_bytes(F.col("bytes")), F.lit(" @ "), speed, F.when(done, " ✓").otherwise(""))
    arrow = F.lit(" → ")
    line = F.when(F.col("label") == "source", F.concat(name, arrow, rate)).when(F.col("label") == "target", F.concat(rate, arrow, name)).otherwise(F.concat(name, F.lit(": "), rate))
    return sides.select("label", line.alias("line"))
