import math
import random
from fractions import Fraction

import duckdb
import pytest
from pyspark.sql import functions as F

from snapweave import queries
from snapweave.functions import batching as B
from snapweave.functions import refs as R
from snapweave.operators import chains, conversion, transfer
from snapweave.sources import protocol as P

MIB = 1 << 20


def value(spark, column, **values):
    return spark.range(1).select(column(*(F.lit(v) for v in values.values())).alias("v")).first().v


def numbers(seed, n, *tops):
    """Rows of numbers from below 0 to far above the tops, many near them."""
    rng = random.Random(seed)
    return [tuple(rng.choice([rng.randrange(-2, 3), rng.randrange(top), int(top * rng.uniform(0.8, 1.2)), top]) for top in tops) for _ in range(n)]


def computed(spark, column, names, rows):
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {', '.join(f'{n} long' for n in names)}")
    return [r.v for r in frame.select("i", column(*(F.col(n) for n in names)).alias("v")).orderBy("i").collect()]


def test_batch_count_by_its_formula(spark):
    rows = numbers(11, 300, 5000, 200 * MIB)
    plain = lambda n, limit: 1 if n <= 0 or limit <= 0 else max(1, math.ceil(Fraction(n * 65_536, limit)))
    assert computed(spark, B.batch_count, ["n", "limit"], rows) == [plain(*r) for r in rows]


def test_split_factor_by_its_formula(spark):
    """Parts of at most half the limit, or of a quarter if nearly all of it was sent; two at least."""
    rows = numbers(12, 300, 3 << 30, 600 * MIB) + [(9 * k, 10 * k) for k in (1, 7, MIB)] + [(9 * k - 1, 10 * k) for k in (1, 7, MIB)]

    def plain(sent, limit):
        if sent <= 0 or limit <= 0:
            return 2
        part = Fraction(limit, 4 if Fraction(sent, limit) >= Fraction(9, 10) else 2)
        return max(2, math.ceil(sent / part))

    assert computed(spark, B.split_factor, ["sent", "limit"], rows) == [plain(*r) for r in rows]


def test_drop_count_by_its_formula(spark):
    """Doublings of what was sent until half the limit would be passed, eight at most."""
    rows = numbers(13, 300, 90_000_000, 70_000_000, 12) + [(1, limit, 50) for limit in range(0, 600, 7)]

    def plain(sent, limit, most):
        drops = 0
        while min(sent, limit, most) > 0 and drops < min(8, most) and 2 * (sent << drops) <= limit // 2:
            drops += 1
        return drops

    assert computed(spark, B.drop_count, ["sent", "limit", "most"], rows) == [plain(*r) for r in rows]


def chain(spark, n, branch=1):
    return spark.createDataFrame([(branch, i, f"h{i}") for i in range(n)], "branch long, pos long, hash string")


def test_even_checkpoints_cut_into_equal_parts(spark):
    rows = [(k, size, n) for k, (size, n) in enumerate((size, n) for size in (1, 2, 7, 12, 25) for n in (0, 1, 2, 5, 7, 12, 30))]
    whole = spark.createDataFrame([(k, i, f"h{i}") for k, size, _ in rows for i in range(size)], "branch long, pos long, hash string")
    found = {k: [] for k, _, _ in rows}
    for r in chains.even_checkpoints(whole, spark.createDataFrame([(k, n) for k, _, n in rows], "branch long, n int")).collect():
        found[r.branch].append(r.pos)
    for k, size, n in rows:
        part = size // n if 1 < n < size else size
        want = [part * i - 1 for i in range(1, n)] if 1 < n < size else []
        assert sorted(found[k]) == [*want, size - 1], (size, n)


def test_subdivided_halves_every_gap(spark):
    rng = random.Random(14)
    cases = [(k, sorted(rng.sample(range(30), rng.randrange(1, 6))), rng.choice([None, rng.randrange(3), 99])) for k in range(20)]
    whole = spark.createDataFrame([(k, i, f"h{i}") for k, _, _ in cases for i in range(30)], "branch long, pos long, hash string")
    now = spark.createDataFrame([(k, p) for k, points, _ in cases for p in points], "branch long, pos long")
    current = spark.createDataFrame([(k, f"h{at}") for k, _, at in cases if at is not None], "branch long, hash string")
    found = {k: set() for k, _, _ in cases}
    for r in chains.subdivided(whole, now, current).collect():
        found[r.branch].add(r.pos)
    for k, points, at in cases:
        begins = [-1 if at is None else at, *points]
        middles = [] if at == 99 else [a + (b - a) // 2 for a, b in zip(begins, points, strict=False) if b - a > 1]  # 99 isn't in the chain
        assert found[k] == {*points, *middles}, (points, at)


def test_subdivided_to(spark):
    rows = spark.createDataFrame([(1, 9)], "branch long, pos long")
    assert chains.subdivided_to(chain(spark, 10), rows, 4).count() >= 4


def test_subdivided_to_by_the_plain_loop(spark):
    """Branches that begin with different numbers of checkpoints stop by themselves; the plan doesn't grow with the rounds."""
    rng = random.Random(15)
    cases = [(k, size := rng.choice([1, 2, 3, 11, 64, 200]), sorted({*rng.sample(range(size), min(size, rng.randrange(1, 6))), size - 1}), rng.choice([None, None, 0, 999])) for k in range(40)]
    whole = spark.createDataFrame([(k, i, f"h{i}") for k, size, _, _ in cases for i in range(size)], "branch long, pos long, hash string")
    now = spark.createDataFrame([(k, p) for k, _, points, _ in cases for p in points], "branch long, pos long")
    current = spark.createDataFrame([(k, f"h{at}") for k, _, _, at in cases if at is not None], "branch long, hash string")
    plans = []
    for least in (1, 4, 8, 100):
        found = {k: set() for k, *_ in cases}
        frame = chains.subdivided_to(whole, now, least, current)
        plans.append(len(frame._jdf.queryExecution().analyzed().toString()))
        for r in frame.collect():
            assert r.pos not in found[r.branch] and r.hash == f"h{r.pos}"
            found[r.branch].add(r.pos)
        for k, _, points, at in cases:
            def halved(points, at=at):
                begins = [-1 if at is None else at, *points]
                return points if at == 999 else sorted({*points, *(a + (b - a) // 2 for a, b in zip(begins, points, strict=False) if b - a > 1)})

            want, before = halved(points), len(points)
            while len(want) > before and len(want) < least:
                want, before = halved(want), len(want)
            assert found[k] == set(want), (k, points, at, least)
    assert max(plans) < 1.1 * min(plans)  # but for the digits of expression numbers


@pytest.mark.parametrize("block", [1, 7, 100_000])
def test_under_limit_by_probes(spark, block):
    """Against probes one after another; one branch is most of the table."""
    rng = random.Random(block)
    cases = {k: ([rng.choice([0, 1, 5, 90]) for _ in range(4000 if k == 0 else rng.randrange(1, 30))], rng.choice([-1, 0, 3, 40]), rng.choice([0, 1, 2, 9, 50])) for k in range(60)}
    cases[0] = (cases[0][0], 11, 3000)
    chain_ = spark.createDataFrame([(k, i, s) for k, (sizes, _, _) in cases.items() for i, s in enumerate(sizes)], "branch long, pos long, size long")
    state = spark.createDataFrame([(k, at, span) for k, (_, at, span) in cases.items()] + [(99, -1, 0)], "branch long, at int, span int")
    for limit in (0, 60, 50_000):
        found = {r.branch: (r.pos, r.sampled) for r in chains.under_limit(chain_, state, limit, block).collect()}
        assert found.pop(99) == (-1, -1)
        for k, (sizes, at, span) in cases.items():
            low, high = at + 1, len(sizes) - 1
            fits = lambda x, low=low, sizes=sizes: sum(sizes[low : x + 1]) <= limit
            best = max((x for x in range(low, high + 1) if fits(x)), default=-1)
            probes, step = [], (low + span - 1 if span > 0 else high)
            for _ in range(4):
                probes.append(min(max(step, low), high))
                step = low + max(step - low, 0) // 2
            sampled = next((x for x in sorted({*probes, low}, reverse=True) if fits(x)), -1) if low <= high else -1
            assert found[k] == (best, sampled), (k, limit)


def test_prefixes_and_messages(spark):
    one, two = "deadbee1" + "1" * 32, "deadbee2" + "2" * 32
    known = spark.createDataFrame([(one, "commit"), (two, "tag"), ("a" * 40, "commit"), ("b" * 40, "blob")], "hash string, type string")
    mapping = spark.createDataFrame([(one, "N1"), ("a" * 40, "NA"), ("b" * 40, "NB")], "sha1 string, sha256 string")
    texts = ["see commit deadbee for details", "A" * 40 + " and aaaaaaa, not 1234567", "b" * 40, "deadbee1", None]
    messages = spark.createDataFrame(list(enumerate(texts)), "id long, message string")
    found = {r.id: (r.message, r.rewrites) for r in conversion.rewrite_messages(messages, known, mapping).collect()}
    assert found == {0: (texts[0], 0), 1: ("NA and NA, not 1234567", 2), 2: (texts[2], 0), 3: ("N1", 1), 4: (None, 0)}
    assert [r.prefix for r in conversion.ambiguous_prefixes(messages, known).collect()] == ["deadbee"]


def test_content_hash(spark):
    row = spark.range(1).select(conversion.content_hash(F.lit("blob"), F.lit("hi\n")).alias("new"), conversion.content_hash(F.lit("blob"), F.lit("hi\n"), 0).alias("old")).first()
    assert row.new == conversion.blob_sha256(b"hi\n") and row.old == "45b983be36b73c0788dc9cbcb76cbb80fc7bb057"


def test_mapping_file(spark, tmp_path):
    rows = spark.createDataFrame([("b", "2"), ("a", "1"), ("c", "3")], "sha1 string, sha256 string")
    conversion.write_mapping(rows, str(tmp_path / "map"))
    parts = sorted((tmp_path / "map").glob("part-*.txt"))
    lines = [x for p in parts for x in p.read_text().splitlines() if x]
    assert lines[0] == "# sha1\tsha256" and lines[1:] == ["a\t1", "b\t2", "c\t3"]


H, G = "1" * 40, "2" * 40


def plain_parents(body):
    """Line by line: a tree line first, then parents for as long as they go on and are sound."""
    lines, out = body.split("\n"), []
    if not lines[0].startswith("tree "):
        return out
    for line in lines[1:]:
        word, _, name = line.partition(" ")
        if word != "parent" or len(name) != 40 or not set(name.lower()) <= set("0123456789abcdef") or not name.strip("0"):
            break
        out.append(name.lower())
    return out


def test_commit_parents_of_generated_bodies(spark):
    rng = random.Random(15)
    name = lambda: f"{rng.randrange(1 << 160):040x}"
    kinds = [lambda: f"parent {name()}", lambda: f"parent {name().upper()}", lambda: f"parent {name()}", lambda: "parent " + "0" * 40, lambda: f"parent {name()[:30]}", lambda: f"parent {name()[:39]}g", lambda: f"author {name()}", lambda: ""]
    bodies = [""] + ["\n".join([f"tree {name()}"] * (k % 7 > 0) + [rng.choice(kinds[: rng.choice([3, 8])])() for _ in range(rng.randrange(6))] + ["author a", "", "parent of all"]) for k in range(200)]
    frame = spark.createDataFrame(list(enumerate(bodies)), "i int, body string")
    found = [r.v for r in frame.select("i", P.commit_parents(F.col("body")).alias("v")).orderBy("i").collect()]
    assert found == [plain_parents(b) for b in bodies] and sum(map(bool, found)) > 60


def test_same_repository_by_its_rule(spark):
    """Spellings of one address are the same; another port, host, path or scheme is not."""
    rng = random.Random(16)
    base = {"scheme": "https", "host": "git.example.org", "port": "", "path": "/team/tool"}

    def spelled(scheme, host, port, path):
        if not port and rng.random() < 0.5:
            port = {"https": ":443", "http": ":80"}[scheme]
        user = rng.choice(["", "bot@", "bot:key@"])
        return rng.choice(["", " "]) + rng.choice([scheme, scheme.upper()]) + "://" + user + rng.choice([host, host.title()]) + port + path + rng.choice(["", "/", "//"])

    changes = {"scheme": "http", "host": "git2.example.org", "port": ":8443", "path": "/team/Tool"}
    rows = [(spelled(**base), spelled(**base), True) for _ in range(40)] + [(spelled(**base), spelled(**(base | {k: v})), False) for k, v in changes.items() for _ in range(10)]
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a string, b string, want boolean")
    found = [r.v for r in frame.select("i", R.same_repository(F.col("a"), F.col("b")).alias("v")).orderBy("i").collect()]
    assert found == [want for *_, want in rows]


def test_bench_summary(spark):
    schema = "wall_ms long, elapsed_ms long, peak_alloc long, peak_heap long, total_alloc long, gc long, relay_mode string, batching boolean, batch_count long, planned long, error string"
    rows = [(100, 90, 10, 20, 30, 1, "bootstrap", False, None, None, None), (140, 130, 50, 60, 70, 2, "bootstrap-batch", True, 3, 4, ""), (0, 0, 0, 0, 0, 0, "", False, None, None, "boom")]
    r = transfer.bench_summary(spark.createDataFrame(rows, schema)).first()
    assert (r.ok_runs, r.failed_runs, r.batched_runs, r.min_wall_ms, r.max_wall_ms, r.avg_wall_ms) == (2, 1, 1, 100, 140, 120.0)
    assert (r.min_elapsed_ms, r.max_elapsed_ms, r.avg_elapsed_ms, r.min_batch_count, r.avg_batch_count, r.avg_planned) == (90, 130, 110.0, 3, 3.0, 4.0)
    assert r.relay_modes == "bootstrap,bootstrap-batch"
    r = transfer.bench_summary(spark.createDataFrame(rows[2:], schema)).first()
    assert (r.min_wall_ms, r.min_batch_count, r.avg_wall_ms) == (0, 0, 0.0)


def test_rates(spark):
    rows = [("s", 100_000 * i, 1000 * i) for i in range(12)] + [("t", 0, 5), ("t", 10, 9)]
    found = transfer.instant_rates(spark.createDataFrame(rows, "label string, at_us long, total long")).orderBy("label", "at_us").collect()
    assert [r.rate for r in found if r.label == "s"][0] == 0 and [r.rate for r in found if r.label == "s"][11] == pytest.approx(10_000)
    assert [r.rate for r in found if r.label == "t"] == [0, 0]
    marks = transfer.idle_marks(spark.createDataFrame(rows, "label string, at_us long, total long")).orderBy("label", "at_us").collect()
    assert [r.done for r in marks if r.label == "s"] == [False] * 11 + [True]


def test_rates_and_totals_do_not_depend_on_blocks(spark):
    rng = random.Random(17)
    log = spark.createDataFrame([(rng.choice("ab"), rng.randrange(30_000_000), rng.randrange(1000), i) for i in range(400)], "label string, at_us long, bytes long, event_id long")
    whole = transfer.running_totals(log)
    rows = lambda f: sorted(tuple(r) for r in f.collect())
    assert rows(whole) == rows(transfer.running_totals(log, 13)) and whole.agg(F.max("total")).first()[0] > 0
    for of in (transfer.instant_rates, transfer.idle_marks):
        assert rows(of(whole)) == rows(of(whole, 13))


@pytest.mark.parametrize(("n", "want"), [(0, "0 B"), (1023, "1023 B"), (1024, "1.00 KB"), (15_360, "15.0 KB"), (102_400, "100 KB"), (1 << 20, "1.00 MB"), (3 << 40, "3.00 TB")])
def test_human_bytes(spark, n, want):
    assert value(spark, R.human_bytes, n=n) == want


def test_capabilities(spark):
    text = "agent=git/2=x\nserver-option\nfetch=shallow filter\nserver-option=1"
    assert value(spark, P.capability_map, t=text) == {"agent": "git/2=x", "fetch": "shallow filter", "server-option": "1"}


def test_listed_refs_keep_the_head_apart(spark, tmp_path):
    (tmp_path / "refs.txt").write_text(f"{H} HEAD symref-target:refs/heads/main\nunborn HEAD symref-target:refs/heads/x\n{G} refs/tags/v1 peeled:{H}\n")
    found = {(r.ref, r.hash, r.head_target) for r in P.read_listed_refs(spark, str(tmp_path)).collect()}
    assert found == {("HEAD", None, "refs/heads/main"), ("refs/tags/v1", G, None)}


@pytest.mark.parametrize("n, want", [(1152, "1.12 KB"), (1408, "1.38 KB"), (10496, "10.2 KB"), (102912, "100 KB"), (9285 << 30, "9.07 TB"), (10 * 1024 - 1, "10.00 KB"), (None, None)])
def test_human_bytes_ties_and_large(spark, n, want):
    assert spark.createDataFrame([(n,)], "n long").select(R.human_bytes(F.col("n"))).first()[0] == want


def _same_as_sql(spark, tmp_path, name, ids):
    """A query of `events` (event_id) against its SQL."""
    spark.createDataFrame([(i,) for i in ids], "event_id long").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    found = queries.QUERIES[name](spark, str(tmp_path))
    with duckdb.connect() as db:
        db.sql(f"CREATE VIEW events AS FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
        want = db.sql(queries.SQL[name])
        assert found.columns == want.columns and sorted(map(tuple, found.collect())) == sorted(want.fetchall())


def test_batch_sizes_of_large_ids(spark, tmp_path):
    _same_as_sql(spark, tmp_path, "batch_sizes", [0, 1, 9, 16, 512, 16_384, 40_000, 96_628, 100_000, 1_100_000, 5_999_999])


def test_header_counts_of_large_ids(spark, tmp_path):
    _same_as_sql(spark, tmp_path, "header_counts", [0, 1, 65_535, 65_536, 65_545, 99_715, 5_999_999])
