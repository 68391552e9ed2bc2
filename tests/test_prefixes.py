"""Prefix joins and the notes tree, against plain versions."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from snapweave.operators.conversion import notes_tree
from snapweave.operators.prefixes import PrefixIndex, excluded_by


def test_excluded_by_a_hundred_thousand_prefixes(spark):
    names = spark.range(3000).select(F.concat(F.lit("refs/heads/"), F.col("id").cast("string")).alias("ref"), (F.col("id") * 2).alias("x"))
    names = names.unionByName(spark.createDataFrame([(None, 1), ("refs/tags/v1", 2), ("refs/tags/v1", 3), ("", 4), ("refs/pullx", 5)], "ref string, x long"))
    prefixes = spark.range(100_000).select(F.concat(F.lit(" refs/heads/"), (F.col("id") + 2500).cast("string"), F.lit("\t")).alias("prefix"))
    prefixes = prefixes.unionByName(spark.createDataFrame([(" ",), ("",), (None,), ("refs/pull/",), ("refs/heads/12",)], "prefix string"))
    exact = spark.createDataFrame([("refs/tags/v1 ",), (" ",), ("refs/heads/7",), (None,)], "ref string")
    found = [(r.ref, r.x, r.excluded) for r in excluded_by(names, prefixes, exact).collect()]
    assert len(found) == 3005
    for ref, _, hit in found:
        number = int(ref[11:]) if ref and ref.startswith("refs/heads/") else None
        want = ref == "refs/tags/v1" or number is not None and (number >= 2500 or str(number).startswith("12") or number == 7)
        assert hit == want, ref
    assert not any(r.excluded for r in excluded_by(names, prefixes.limit(0)).collect())


def test_names_under_one_prefix_are_spread(spark):
    """A prefix that covers whole ranges, others below it, and names beyond ASCII; names under one prefix don't meet in one task."""
    names = [f"refs/notes/1{k:05d}" for k in range(20_000)] + [f"refs/notes/{k}" for k in range(2, 900)] + ["refs/notés/1", "refs/notés", "refs/notes/\U0001f600x"]
    entries = ["refs/notes/1", "refs/notes/105", "refs/notes/11\n", "refs/notes/3", "refs/notés/", "refs/notes/\U0001f600"]
    exact = ["refs/notes/2", " refs/notes/100001", "refs/notes/4"]
    frame = spark.createDataFrame([(n, [n[-1:]]) for n in names] + [(None, None)], "ref string, x array<string>").repartition(8)
    found = excluded_by(frame, spark.createDataFrame([(p,) for p in entries], "prefix string"), spark.createDataFrame([(e,) for e in exact], "ref string"))
    want = {n: any(n.startswith(p.strip()) for p in entries) or n in {e.strip() for e in exact} for n in names} | {None: False}
    rows = found.collect()
    assert len(rows) == len(want) and {r.ref: r.excluded for r in rows} == want and all(r.ref is None or r.x == [r.ref[-1:]] for r in rows)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "SortMergeJoin" not in plan


def test_sweep_of_ranges_with_nested_prefixes(spark):
    """Random names of few letters, so that prefixes nest and lie on the ends of ranges."""
    rng = random.Random(13)
    word = lambda most: "".join(rng.choice("ab") for _ in range(rng.randrange(most + 1)))
    parallel = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for count in (0, 1, 5, 12):
            names, entries = [word(9) for _ in range(300)], [word(6) for _ in range(count)]
            found = excluded_by(spark.createDataFrame([(n,) for n in names], "ref string"), spark.createDataFrame([(p,) for p in entries], "prefix string"))
            want = sorted((n, any(p and n.startswith(p) for p in entries)) for n in names)
            assert sorted((r.ref, r.excluded) for r in found.collect()) == want
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", parallel)


def test_prefix_index_reads_the_ranges_that_it_needs(spark):
    rng = random.Random(10)
    hashes = {f"{rng.randrange(16**6):06x}" + "".join(rng.choice("01") for _ in range(34)) for _ in range(300)}
    hashes |= {h[:k] + "f" * (40 - k) for h in list(hashes)[:60] for k in (7, 12, 39)}
    index = PrefixIndex(spark.createDataFrame([(h,) for h in hashes], "hash string"), 8)
    wanted = {h[: rng.randrange(7, 41)] for h in hashes} | {"0" * 7, "f" * 40, "abcdef1"} | {h.upper() for h in list(hashes)[:5]}
    for some in (wanted, set(sorted(wanted)[:3])):
        found = {r.prefix: (r.verdict, r.hash) for r in index.resolve(spark.createDataFrame([(p,) for p in some] + [(None,)], "prefix string")).collect()}
        want = {}
        for p in {x.lower() for x in some}:
            hits = [h for h in hashes if h.startswith(p)]
            want[p] = ("none", None) if not hits else ("unique", hits[0]) if len(hits) == 1 else ("ambiguous", None)
        assert found == want
    one = index.resolve(spark.createDataFrame([(sorted(hashes)[0],)], "prefix string"))
    one.collect()
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^]]*range#\d+ = 0\)", plan)
    read = [str(x) for x in one.sparkSession.read.parquet(index.path).select("range").distinct().collect()]
    assert len(read) == 8  # of which the look-up names one
    assert [r.range for r in index._placed(spark.createDataFrame([(sorted(hashes)[0],)], "prefix string")).collect()] == [0]


def test_prefix_index_moves_the_hashes_once(spark):
    """Hashes in one range and shuffle, repeated and in capitals."""
    hashes = [hashlib.sha1(b"%d" % (k % 1500)).hexdigest() for k in range(2000)]
    hashes += [h[:7] + "0" * 33 for h in hashes[:40]] + [h[:20] + "f" * 20 for h in hashes[:40]] + [h.upper() for h in hashes[:5]]
    seen: list[str] = []
    index = PrefixIndex(spark.createDataFrame([(h,) for h in hashes] + [(None,)], "hash string"), 6)
    known = {h.lower() for h in hashes}
    rows = index.table.collect()
    assert len(rows) == len(known) and {r.hash for r in rows} == known
    assert all(len({r.range for r in rows if r.hash[:7] == h[:7]}) == 1 for h in hashes[:40])
    for r in rows:
        others = [h for h in known if h[:7] == r.hash[:7] and h != r.hash]
        assert r.alone_from == max([7, *(1 + next(k for k in range(40) if h[k] != r.hash[k]) for h in others)])
    for h in hashes[:200]:
        seen += [h[:7], h[:20], h[:21], h]
    found = index.resolve(spark.createDataFrame([(p,) for p in [*seen, "0" * 12]], "prefix string"))
    want = {p: [h for h in known if h.startswith(p)] for p in {*seen, "0" * 12}}
    assert {r.prefix: (r.verdict, r.hash) for r in found.collect()} == {p: ("none", None) if not x else ("unique", x[0]) if len(x) == 1 else ("ambiguous", None) for p, x in want.items()}
    plan = PrefixIndex._ranged(spark.createDataFrame([(h,) for h in hashes], "hash string"), 6)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count(" Sort ") == 1


def plain_tree(entries):
    body = b"".join(b"%s %s\0%s" % (mode, name.encode(), bytes.fromhex(value)) for name, (mode, value) in sorted(entries.items()))
    return hashlib.sha256(b"tree %d\0" % len(body) + body).hexdigest()


@pytest.mark.parametrize("fan", [0, 1, 2, None])
def test_notes_tree(spark, fan):
    notes = {hashlib.sha256(b"%d" % k).hexdigest(): hashlib.sha1(b"%d" % k).hexdigest() + "\n" for k in range(700)}
    frame = spark.createDataFrame(list(notes.items()), "path string, body string")
    found = {r.path: (r.hash, r.entries) for r in notes_tree(frame, fan).collect()}

    def build(prefix, depth):
        below = {p: b for p, b in notes.items() if p.startswith(prefix)}
        if depth == 0:
            entries = {p[len(prefix) :]: (b"100644", hashlib.sha256(b"blob %d\0" % len(b) + b.encode()).hexdigest()) for p, b in below.items()}
        else:
            entries = {d: (b"40000", build(prefix + d, depth - 1)) for d in {p[len(prefix) : len(prefix) + 2] for p in below}}
        assert found[prefix] == (plain_tree(entries), len(entries))
        return found[prefix][0]

    build("", fan or 0)
    assert notes_tree(frame.limit(0), fan).isEmpty()
