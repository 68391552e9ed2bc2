"""Streams over restarts, late rows and crashes, against plain versions."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from snapweave.functions import batching
from snapweave.streaming import sink as sinks
from snapweave.streaming.counters import COUNTERS, first_stop, upload_counters
from snapweave.streaming.transfer import Landing, active_sessions, replay, sliding_totals, stream_side_totals

LOG = "label string, at_us long, event_id long, bytes long, objects long, total long"


def samples(rng, n, labels="abc", step=400_000):
    rows, at = [], 0
    for k in range(n):
        at += rng.choice([0, 1, step // 4, step, 749_999, 750_000, 750_001])
        label = rng.choice(labels)
        rows.append((label, at, k, rng.randrange(2_000_000), rng.randrange(4), 60 if label == "b" else 400))
    return rows


def timed(log):
    return log.withColumn("at", F.timestamp_micros("at_us"))


def test_stop_rule_equals_the_column_version(spark):
    rng = random.Random(1)
    rows = [(rng.choice([0, 1, 1 << 23, 90_000_000, rng.randrange(200_000_000)]), rng.randrange(5), rng.randrange(90)) for _ in range(300)]
    frame = spark.createDataFrame(rows, "sent long, objects long, total long")
    for budget in (0, 100_000_000, 1):
        want = [r.x for r in frame.select(batching.should_stop(*map(F.col, ("sent", "objects", "total")), F.lit(budget)).alias("x")).collect()]
        assert [first_stop(*(np.array([v]) for v in r), budget) == 0 for r in rows] == want


def plain_counters(rows, budget):
    found = {}
    for label, at, event, size, objects, total in sorted(rows, key=lambda r: (r[1], r[2])):
        sent, seen, stop_at, stop_event = found.get(label, (0, 0, None, None))
        if stop_at is None:
            sent, seen = sent + size, seen + objects
            most = budget * 95 // 100
            stop = sent >= most or (sent >= 1 << 23 and seen > 0 and total > 0 and sent * total // seen > most)
            found[label] = (sent, seen, at if stop else None, event if stop else None)
    return {(k, *v) for k, v in found.items()}


def test_counters_stop_once_and_stay_stopped(spark):
    rows = samples(random.Random(2), 300)
    log = spark.createDataFrame(rows, LOG)
    sink = replay(log, "at_us", 5, lambda s: upload_counters(s, 100_000_000), "t", "update", sinks.ROCKS)
    found = {tuple(r) for r in sink.latest(COUNTERS, ["label"]).collect()}
    assert found == plain_counters(rows, 100_000_000)
    assert {r[3] is None for r in found} == {True, False} or len({r[3] for r in found}) > 1
    stopped = {r.label: r.batch for r in sink.read(COUNTERS).where("stopped_at is not null").collect()}
    assert all(r.batch <= stopped.get(r.label, r.batch) for r in sink.read(COUNTERS).collect())


def test_sliding_windows_drop_late_rows(spark, tmp_path):
    landing, sink = Landing(spark, str(tmp_path / "in")), sinks.CommittedBatches(spark, str(tmp_path / "out"))
    slices = [[("a", 5_000_000, 1), ("a", 30_000_000, 2)], [("a", 17_000_000, 32), ("a", 19_000_000, 4), ("b", 25_000_000, 8), ("a", 60_000_000, 16)]]
    for rows in slices:
        landing.land(spark.createDataFrame(rows, "label string, at_us long, bytes long"))
        stream = landing.stream(spark.createDataFrame([], "label string, at_us long, bytes long").schema)
        sinks.run_available(sliding_totals(timed(stream)), sink, "append")
    found = {(r.label, r.x): (r.bytes, r.samples) for r in sink.read("label string, begin timestamp, bytes long, samples long").withColumn("x", F.unix_micros("begin")).collect()}
    want = defaultdict(lambda: (0, 0))
    for mark, rows in zip((-(10**9), 20_000_000), slices, strict=True):  # the watermark when the rows come: 17 s is late for all its windows, 19 s for some
        for label, at, size in rows:
            for k in range(10):
                begin = (at // 200_000 - k) * 200_000
                if mark < begin + 2_000_000 <= 50_000_000:
                    want[label, begin] = (want[label, begin][0] + size, want[label, begin][1] + 1)
    assert found == dict(want) and sum(n for _, n in want.values()) == 10 + 10 + 5 + 10


def test_sessions_merge_over_batches(spark):
    rows = samples(random.Random(4), 400, "ab")
    sink = replay(spark.createDataFrame(rows, LOG), "at_us", 6, lambda s: active_sessions(timed(s)), "s", "append")
    found = {tuple(r) for r in sink.read("label string, begin timestamp, last timestamp, bytes long, samples long").select("label", F.unix_micros("begin"), F.unix_micros("last"), "bytes", "samples").collect()}
    mark, want = max(r[1] for r in rows) // 1000 * 1000 - 10_000_000, set()
    for label in "ab":
        held = []
        for _, at, _, size, _, _ in sorted(r for r in rows if r[0] == label):
            if held and at - held[-1][0] >= 750_000:
                want.add((label, held[0][0], held[-1][0], sum(x for _, x in held), len(held)))
                held = []
            held.append((at, size))
        want.add((label, held[0][0], held[-1][0], sum(x for _, x in held), len(held)))
    assert found == {x for x in want if x[2] + 749_999 <= mark}
    assert max(x[4] for x in want) > 3


class Killed(Exception):
    pass


def test_a_run_killed_between_write_and_commit_counts_once(spark, tmp_path, monkeypatch):
    rows = samples(random.Random(5), 200)
    log = spark.createDataFrame(rows, LOG)
    landing = Landing(spark, str(tmp_path / "in"))
    sink, commit, fails = sinks.CommittedBatches(spark, str(tmp_path / "out")), sinks.CommittedBatches.commit, [1, 1]

    def break_down(self, batch_id, attempt):
        if batch_id == 1 and fails:
            fails.pop()
            raise Killed("between write and commit")
        commit(self, batch_id, attempt)

    monkeypatch.setattr(sinks.CommittedBatches, "commit", break_down)
    process = lambda: stream_side_totals(landing.stream(log.schema))
    for part in range(3):
        landing.land(log.where(F.col("event_id") % 3 == part))
        for _ in range(2 if part == 1 else 0):
            with pytest.raises(Exception, match="between write and commit"):
                sinks.run_available(process(), sink, "update")
        sinks.run_available(process(), sink, "update")
    assert not fails
    found = {tuple(r) for r in sink.latest("label string, bytes long, samples long", ["label"]).collect()}
    assert found == {(x, sum(r[3] for r in rows if r[0] == x), sum(r[0] == x for r in rows)) for x in "abc"}
    names = sink.attempts()
    assert len(names) == len({x[:12] for x in names}) >= 3
    sink.write(log.select("label", "bytes", F.lit(1).cast("long").alias("samples")), 1)  # a batch that has its entry is left alone
    assert sink.attempts() == names
    commit(sink, 1, f"{1:012d}-other")
    assert sink.attempts() == names
    assert sinks.CommittedBatches(spark, str(tmp_path / "none")).latest("label string, bytes long", ["label"]).isEmpty()
