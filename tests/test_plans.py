import random

import pytest
from pyspark.sql import functions as F

from snapweave.functions import refs as R
from snapweave.plans import actions as A
from snapweave.plans.policy import Mapping, Policy, PolicyError


def refs(spark, rows):
    return spark.createDataFrame(rows, "ref string, hash string")


ONE, TWO, THREE, ZERO = "1" * 40, "2" * 40, "3" * 40, "0" * 40


def actions(plans):
    return {r.target_ref: (r.action, r.reason) for r in plans.collect()}


def test_plan_mix(spark):
    source = refs(spark, [(f"refs/heads/branch-{i:03d}", f"{i + 1:040x}") for i in range(100)])
    target = refs(spark, [(f"refs/heads/branch-{i:03d}", f"{i + 1:040x}" if i < 50 else THREE) for i in range(100) if not 50 <= i < 75])
    desired = A.desired_refs(source, Policy())
    known = spark.createDataFrame([(f"{i + 1:040x}", THREE) for i in range(75, 100)], "start string, ancestor string")
    found = A.tally(A.plan_sync(desired, target, Policy(), known)).first()
    assert (found.pushed, found.skipped, found.blocked, found.deleted) == (50, 50, 0, 0)
    assert A.tally(A.plan_sync(desired, target, Policy(), known.limit(0))).first().blocked == 25


def test_first_matching_case_wins(spark):
    source = refs(spark, [("refs/heads/a", ONE), ("refs/tags/t", ONE), ("refs/notes/n", ONE), ("refs/heads/new", ONE), ("refs/heads/same", TWO)])
    target = refs(spark, [("refs/heads/a", TWO), ("refs/tags/t", TWO), ("refs/notes/n", TWO), ("refs/heads/same", TWO), ("refs/heads/stale", THREE)])
    none = spark.createDataFrame([], "start string, ancestor string")
    plain = actions(A.plan_sync(A.desired_refs(source, Policy(all_refs=True)), target, Policy(all_refs=True), none))
    assert plain["refs/heads/a"] == ("block", "22222222 is not an ancestor of 11111111")
    assert plain["refs/tags/t"][0] == "block" and "tag ref refs/tags/t" in plain["refs/tags/t"][1]
    assert plain["refs/heads/new"] == ("create", "11111111 -> <new>") and plain["refs/heads/same"][0] == "skip"
    assert "refs/heads/stale" not in plain
    forced = actions(A.plan_sync(A.desired_refs(source, Policy(all_refs=True)), target, Policy(all_refs=True, force=True, prune=True), none))
    assert forced["refs/heads/a"] == ("update", "22222222 -> 11111111 (force)")
    assert forced["refs/notes/n"] == ("update", "22222222 -> 11111111 (force other update)")
    assert forced["refs/heads/stale"] == ("delete", "33333333 -> <deleted>")
    deep = spark.createDataFrame([(ONE, TWO, True)], "start string, ancestor string, exceeded boolean")
    assert "depth limit" in actions(A.plan_sync(A.desired_refs(source, Policy()), target, Policy(force=True), deep))["refs/heads/a"][1]


def test_zero_hash_is_no_source_and_no_target(spark):
    desired = A.desired_refs(refs(spark, [("refs/heads/a", ONE), ("refs/heads/z", ZERO), ("refs/heads/n", None)]), Policy())
    assert [r.target_ref for r in desired.collect()] == ["refs/heads/a"]
    target = refs(spark, [("refs/heads/a", ZERO)])
    assert A.plan_replication(desired, target, Policy()).first().action == "create"
    assert A.plan_bootstrap(desired, target).first().action == "create"
    with pytest.raises(Exception, match="target ref exists"):
        A.plan_bootstrap(desired, refs(spark, [("refs/heads/a", TWO)])).collect()


def test_exclusion_by_its_rule(spark):
    """Generated names: out by a name's beginning or by the whole name, and by nothing blank."""
    rng = random.Random(1)
    names = sorted({"refs/" + "/".join(rng.choice(["heads", "wip", "bot", "x1"]) for _ in range(rng.randrange(1, 5))) for _ in range(60)})
    source = refs(spark, [(n, ONE) for n in names])
    for _ in range(6):
        prefixes = [n[: rng.randrange(6, len(n) + 1)] for n in rng.sample(names, 2)] + ["", "\t"]
        exact = [*rng.sample(names, 3), " "]
        found = A.desired_refs(source, Policy(all_refs=True, exclude_prefixes=tuple(f" {p} " for p in prefixes), exclude_refs=tuple(exact)))
        out = {n for n in names for p in prefixes if p.strip() and n[: len(p)] == p} | set(exact)
        assert {r.target_ref for r in found.collect()} == set(names) - out


def test_overlapping_excludes_by_their_rule(spark):
    """A prefix overlaps a name space if some name begins with both."""
    spaces = ("refs/heads/", "refs/tags/")
    prefixes = [x[:k] + tail for x in (*spaces, "refs/notes/", "other/") for k in range(len(x) + 1) for tail in ("", "q", " ")]
    frame = spark.createDataFrame(list(enumerate(prefixes)), "at int, prefix string")
    found = [r.prefix for r in A.overlapping_excludes(frame).orderBy("at").collect()]
    meets = lambda p, x: all(a == b for a, b in zip(p, x, strict=False))
    first = {p.strip(): p for p in reversed(prefixes)}
    assert sorted(found) == sorted(raw for p, raw in first.items() if any(meets(p, x) for x in spaces))


def test_scan_scope_reaches_the_scan(spark, tmp_path, capsys):
    refs(spark, [("refs/heads/a", ONE), ("refs/tags/t", ONE), ("refs/notes/n", ONE), ("junk", ONE)]).write.parquet(str(tmp_path / "refs"))
    table = spark.read.parquet(str(tmp_path / "refs"))
    for policy, want in ((Policy(), {"refs/heads/a"}), (Policy(include_tags=True), {"refs/heads/a", "refs/tags/t"}), (Policy(all_refs=True), {"refs/heads/a", "refs/tags/t", "refs/notes/n"})):
        desired = A.desired_refs(table, policy)
        assert {r.source_ref for r in desired.collect()} == want
        desired.explain("formatted")
        pushed = [line for line in capsys.readouterr().out.splitlines() if "PushedFilters" in line]
        assert pushed and all("StringStartsWith(ref" in line for line in pushed)


def test_mappings(spark):
    assert Mapping("a", "b").normalized(False) == Mapping("refs/heads/a", "refs/heads/b")
    for bad in (Mapping("a", "refs/heads/b"), Mapping("refs/heads/a", "refs/tags/b"), Mapping("refs/notes/a", "refs/notes/b"), Mapping(" ", "b")):
        with pytest.raises(PolicyError):
            bad.normalized(False)
    assert Mapping("refs/notes/a", "refs/notes/b").normalized(True)
    with pytest.raises(PolicyError):
        Policy(mappings=(Mapping("a", "c"), Mapping("b", "c"))).checked()
    with pytest.raises(Exception, match="source ref not found"):
        A.desired_refs(refs(spark, [("refs/heads/a", ONE)]), Policy(mappings=(Mapping("x", "y"),))).collect()
    assert Policy(branches=("a",), all_refs=True).checked().branches == ()
    assert Policy(mappings=(Mapping("a", "b"),), include_tags=True).scan_prefixes() == ["refs/heads/", "refs/tags/"]


def test_head_ladder(spark):
    desired = lambda *names: A.desired_refs(refs(spark, [(n, ONE) for n in names]), Policy(all_refs=True))
    assert A.pick_head(desired("refs/heads/b", "refs/heads/main"), "refs/heads/b").first().head == "refs/heads/b"
    assert A.pick_head(desired("refs/heads/b", "refs/heads/main"), "refs/heads/gone").first().head == "refs/heads/main"
    assert A.pick_head(desired("refs/heads/b", "refs/heads/master"), "").first().head == "refs/heads/master"
    assert A.pick_head(desired("refs/heads/c", "refs/heads/b"), "").first().head == "refs/heads/b"
    assert A.pick_head(desired("refs/tags/v1"), "").first().head is None


def test_eligibility_reports_the_first_fault(spark):
    rows = [("b", "refs/heads/b", "refs/heads/b", ONE, None, "branch", "create", ""), ("a", "refs/heads/a", "refs/heads/a", ONE, ONE, "branch", "skip", ""), ("t", "refs/tags/t", "refs/heads/t", ONE, TWO, "tag", "update", "")]
    plans = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in A.PLAN_COLUMNS))
    assert A.incremental_eligibility(plans, Policy()).first().reason == "incremental-branch-action-not-update-or-create"
    assert A.incremental_eligibility(plans.where("branch = 't'"), Policy()).first().reason == "incremental-non-tag-mapping"
    assert A.incremental_eligibility(plans.where("branch = 'b'"), Policy()).first().eligible
    assert A.incremental_eligibility(plans, Policy(prune=True)).first().reason == "incremental-disabled-by-force-prune-or-dry-run"
    assert A.replicate_eligibility(plans.where("branch = 't'")).first().reason == "replicate-non-tag-mapping"
    assert A.replicate_eligibility(plans.limit(0)).first().eligible


def test_eligibilities_take_one_pass(spark):
    """All checks at once, against each by itself, over rows with and without faults; the rows are joined and read once."""
    rng = random.Random(16)
    kinds = {"branch": "refs/heads/", "tag": "refs/tags/", "other": "refs/notes/"}
    schema = ", ".join(f"{c} string" for c in A.PLAN_COLUMNS)
    boot = lambda frame, policy: A.bootstrap_eligibility(frame.select("target_ref"), frame.select(F.col("target_ref").alias("ref"), F.col("target_hash").alias("hash")), policy)
    for count, actions_ in ((0, ["create"]), (1, ["create", "skip"]), (30, ["create", "update"]), (30, ["create", "update", "skip", "block"])):
        rows = []
        for i in range(count):
            kind = rng.choice(list(kinds))
            source = kinds[kind if rng.random() < 0.9 else "tag"] + f"{i * 7 % 31:02d}"
            rows.append((f"{i}", source, kinds[kind] + f"{i * 7 % 31:02d}", ONE, rng.choice([None, ZERO, ONE, TWO]), kind, rng.choice(actions_), ""))
        plans = spark.createDataFrame(rows, schema).repartition(3)
        branch = F.col("kind") == "branch"
        checks = {
            "boot": A.bootstrap_check(Policy()), "forced": A.bootstrap_check(Policy(force=True)), "all": A.incremental_check(Policy()), "pruned": A.incremental_check(Policy(prune=True)),
            "branches": A.incremental_check(Policy()).on(branch), "unknown": A.incremental_check(Policy(), False), "none": A.replicate_check().on(F.lit(False)),
            "replicate": A.replicate_check(A.replication_action()), "tags": A.tag_create_check(), "fallback": (A.incremental_check(Policy()), A.tag_create_check()),
        }
        apart = {
            "boot": boot(plans, Policy()), "forced": boot(plans, Policy(force=True)), "all": A.incremental_eligibility(plans, Policy()), "pruned": A.incremental_eligibility(plans, Policy(prune=True)),
            "branches": A.incremental_eligibility(plans.where(branch), Policy()), "unknown": A.incremental_eligibility(plans, Policy(), False), "none": A.replicate_eligibility(plans.limit(0)),
            "replicate": A.replicate_eligibility(plans.withColumn("action", A.replication_action())), "tags": A.tag_create_eligibility(plans),
        }
        together = A.eligibilities(plans, checks)
        found = {r.check: (r.eligible, r.reason) for r in together.collect()}
        assert {k: found[k] for k in apart} == {k: tuple(frame.first()) for k, frame in apart.items()}
        assert found["fallback"][1] == A.fallback_reason(plans, Policy()).first().reason == (found["all"] if found["all"][0] else found["tags"])[1]
        assert found["forced"] == (False, "bootstrap-disabled-by-force-or-prune") and found["pruned"] == (False, "incremental-disabled-by-force-prune-or-dry-run")
        assert together._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange SinglePartition") == 1


def test_positions_are_gapless(spark):
    found = A.positions(spark.range(1000).selectExpr("cast(id * 7919 % 1000 as string) as name"), ["name"]).orderBy("name").collect()
    assert [r.pos for r in found] == list(range(1000)) and [r.name for r in found] == sorted(r.name for r in found)


def test_zero_hashes_of_both_lengths(spark):
    rows = [("0" * 40, "<zero>"), ("0" * 64, "<zero>"), (None, "<zero>"), ("0" * 41, "0" * 8), ("1" * 64, "1" * 8)]
    frame = spark.createDataFrame([(h,) for h, _ in rows], "hash string")
    assert [r.x for r in frame.select(R.short_hash(F.col("hash")).alias("x")).collect()] == [x for _, x in rows]
