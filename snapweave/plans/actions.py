"""Reconciliation of two ref snapshots into plan rows, and what follows from the rows.

Snapshots are frames (ref, hash) with unique refs. Plan rows have branch, source_ref, target_ref,
source_hash, target_hash, kind, action and reason; absent hashes are null. Every step is one equi-join or
one grouped pass; nothing is collected.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.refs import action_for_target, excluded, is_zero, lease_failure, plan_line, ref_kind, short_hash, short_name
from ..storage import Scratch
from .policy import HEADS, TAGS, Policy

PLAN_COLUMNS = ("branch", "source_ref", "target_ref", "source_hash", "target_hash", "kind", "action", "reason")


def desired_refs(source: DataFrame, policy: Policy) -> DataFrame:
    """(kind, label, source_ref, target_ref, source_hash) of the refs that the target should have."""
    policy = policy.checked()
    source = in_scan_scope(source, policy).where(~is_zero(F.col("hash")))
    named = source.select(F.col("ref").alias("source_ref"), F.col("ref").alias("target_ref"), F.col("hash").alias("source_hash"), ref_kind(F.col("ref")).alias("kind"))
    allowed = ~excluded(F.col("source_ref"), policy.exclude_prefixes, policy.exclude_refs)
    rest = (F.lit(policy.wants_tags) & (F.col("kind") == "tag")) | (F.lit(policy.all_refs) & (F.col("kind") == "other"))
    if policy.mappings:
        pairs = source.sparkSession.createDataFrame([(m.source, m.target) for m in policy.mappings], "source_ref string, target_ref string")
        mapped = pairs.join(named.select("source_ref", "source_hash"), "source_ref", "left")
        mapped = mapped.withColumn("source_hash", F.when(F.col("source_hash").isNull(), F.raise_error(F.concat(F.lit("source ref not found: "), "source_ref"))).otherwise(F.col("source_hash")))
        mapped = mapped.withColumn("kind", ref_kind(F.col("target_ref")))
        others = named.where(rest & allowed).join(pairs.select("target_ref"), "target_ref", "left_anti")
        rows = mapped.unionByName(others.select(mapped.columns))
    else:
        wanted = F.col("kind") == "branch"
        if policy.branches:
            wanted = wanted & short_name(F.col("source_ref")).isin(list(policy.branches))
        rows = named.where((wanted | rest) & allowed)
    return rows.select("kind", short_name(F.col("target_ref")).alias("label"), "source_ref", "target_ref", "source_hash")


def in_scan_scope(source: DataFrame, policy: Policy) -> DataFrame:
    """The refs (ref, ..) under the prefixes that the policy can use; over a table of refs the scan itself is so limited."""
    wanted = [F.col("ref").startswith(p) for p in policy.scan_prefixes()]
    return source.where(reduce(lambda a, b: a | b, wanted))


def overlapping_excludes(excludes: DataFrame) -> DataFrame:
    """(at, prefix) of exclusion prefixes (at, prefix) that could hide a branch or a tag, the first of equal ones.

    Up to the end of the shorter of the two, such a prefix and the name space of branches or of tags are the same.
    """
    trimmed = excludes.select("at", "prefix", F.trim("prefix").alias("name"))
    shared = lambda space: F.left("name", F.lit(len(space))) == F.left(F.lit(space), F.length("name"))
    return trimmed.where(shared(HEADS) | shared(TAGS)).groupBy("name").agg(F.min("at").alias("at"), F.min_by("prefix", "at").alias("prefix")).select("at", "prefix")


def prune_scope(ref: Column, policy: Policy) -> Column:
    """Whether a target ref outside the desired set is ours to delete."""
    kind = ref_kind(ref)
    free = not policy.mappings
    scope = (F.lit(policy.wants_tags) & (kind == "tag")) | (F.lit(free and not policy.branches) & (kind == "branch")) | (F.lit(free and policy.all_refs) & (kind == "other"))
    return scope & ~excluded(ref, policy.exclude_prefixes, policy.exclude_refs)


def _matched(desired: DataFrame, target: DataFrame, policy: Policy) -> DataFrame:
    """Desired rows with the target's hash, and under prune the target refs that no row wants."""
    there = target.select(F.col("ref").alias("target_ref"), F.col("hash").alias("target_hash"), F.lit(True).alias("there"))
    both = desired.join(there, "target_ref", "full_outer" if policy.prune else "left")
    return both.where(F.col("source_hash").isNotNull() | prune_scope(F.col("target_ref"), policy)) if policy.prune else both


def _rows(joined: DataFrame, action: Column, reason: Column) -> DataFrame:
    kind = F.coalesce("kind", ref_kind(F.col("target_ref")))
    branch = F.coalesce("label", short_name(F.col("target_ref")))
    return joined.select(branch.alias("branch"), "source_ref", "target_ref", "source_hash", "target_hash", kind.alias("kind"), action.alias("action"), reason.alias("reason"))


def plan_sync(desired: DataFrame, target: DataFrame, policy: Policy, ancestors: DataFrame | None = None) -> DataFrame:
    """One action for each desired ref: create, skip, update or block, and delete under prune.

    `ancestors` has (start, ancestor) for the (source_hash, target_hash) pairs in question, and optionally
    `exceeded`; without it every branch change counts as a fast-forward.
    """
    policy = policy.checked()
    joined = _matched(desired, target, policy)
    if ancestors is None:
        joined = joined.withColumn("forward", F.lit(True)).withColumn("exceeded", F.lit(False))
    else:
        if "exceeded" not in ancestors.columns:
            ancestors = ancestors.withColumn("exceeded", F.lit(False))
        known = ancestors.select(F.col("start").alias("source_hash"), F.col("ancestor").alias("target_hash"), F.lit(True).alias("forward"), "exceeded").dropDuplicates(["source_hash", "target_hash"])
        joined = joined.join(known, ["source_hash", "target_hash"], "left")
    s, t, kind = short_hash(F.col("source_hash")), short_hash(F.col("target_hash")), F.col("kind")
    fixed, moved = kind.isin("tag", "other"), F.concat(t, F.lit(" -> "), s)
    gone, absent = F.col("source_hash").isNull(), F.col("there").isNull()
    same, far = F.col("source_hash") == F.col("target_hash"), F.coalesce("exceeded", F.lit(False))
    forward = F.coalesce("forward", F.lit(False)) & ~far
    force = F.lit(policy.force)
    cases = [
        (gone, "delete", F.concat(t, F.lit(" -> <deleted>"))),
        (absent, "create", F.concat(s, F.lit(" -> <new>"))),
        (same, "skip", F.concat(s, F.lit(" already current"))),
        (fixed & force, "update", F.concat(moved, F.lit(" (force "), kind, F.lit(" update)"))),
        (fixed, "block", F.concat(t, F.lit(" differs from "), s, F.lit("; use --force-with-lease to update "), kind, F.lit(" ref "), "target_ref")),
        (far, "block", F.concat(F.lit("ancestry check for "), "target_ref", F.lit(" exceeded depth limit; use --force-with-lease if this is a valid fast-forward"))),
        (forward, "update", moved),
        (force, "update", F.concat(moved, F.lit(" (force)"))),
    ]
    action, reason = F.lit("block"), F.concat(t, F.lit(" is not an ancestor of "), s)
    for condition, name, text in reversed(cases):
        action, reason = F.when(condition, name).otherwise(action), F.when(condition, text).otherwise(reason)
    return _rows(joined, action, reason)


def replication_action() -> Column:
    """What a replication does with a row (source_hash, target_hash)."""
    gone, same = F.col("source_hash").isNull(), F.col("source_hash") == F.col("target_hash")
    return F.when(gone, "delete").when(same, "skip").otherwise(action_for_target(F.col("target_hash")))


def plan_replication(desired: DataFrame, target: DataFrame, policy: Policy) -> DataFrame:
    """As `plan_sync`, but what differs is overwritten."""
    joined = _matched(desired, target, policy.checked())
    s, t = short_hash(F.col("source_hash")), short_hash(F.col("target_hash"))
    moved = F.concat(t, F.lit(" -> "), s)
    over = F.when(F.col("kind") == "tag", " (replicate tag overwrite)").otherwise(" (replicate overwrite)")
    gone, same, new = F.col("source_hash").isNull(), F.col("source_hash") == F.col("target_hash"), is_zero(F.col("target_hash"))
    reason = F.when(gone, F.concat(t, F.lit(" -> <deleted>"))).when(same, F.concat(s, F.lit(" already current"))).when(new, F.concat(s, F.lit(" -> <new>"))).otherwise(F.concat(moved, over))
    return _rows(joined, replication_action(), reason)


def plan_bootstrap(desired: DataFrame, target: DataFrame) -> DataFrame:
    """A create for each desired ref; raises while running if one exists on the target."""
    there = target.where(~is_zero(F.col("hash"))).select(F.col("ref").alias("target_ref"), F.col("hash").alias("found"))
    joined = desired.join(there, "target_ref", "left")
    checked = F.when(F.col("found").isNotNull(), F.raise_error(F.concat(F.lit("target ref exists: "), "target_ref"))).otherwise(F.lit("create"))
    reason = F.concat(F.lit("create "), "target_ref", F.lit(" at "), short_hash(F.col("source_hash")))
    return _rows(joined.withColumn("target_hash", F.lit(None).cast("string")), checked, reason)


def push_commands(plans: DataFrame, blind: bool = False) -> DataFrame:
    """(name, old, new, delete) of plan rows; `blind` expects nothing of the old value unless a ref is deleted."""
    delete = F.col("action") == "delete"
    old = F.when(~delete & F.lit(blind), F.lit(None).cast("string")).otherwise(F.col("target_hash"))
    return plans.select(F.col("target_ref").alias("name"), old.alias("old"), F.when(~delete, F.col("source_hash")).alias("new"), delete.alias("delete"))


def apply_rejections(plans: DataFrame, rejections: DataFrame) -> DataFrame:
    """Plan rows whose ref is in `rejections` (target_ref, status) become warnings."""
    told = plans.join(rejections.withColumn("rejected", F.lit(True)), "target_ref", "left")
    status = F.coalesce("status", F.lit(""))
    reason = F.when(status == "", "target rejected ref update").otherwise(F.concat(F.lit("target rejected ref update: "), status))
    hit = F.coalesce("rejected", F.lit(False))
    return told.withColumn("action", F.when(hit, "warn").otherwise(F.col("action"))).withColumn("reason", F.when(hit, reason).otherwise(F.col("reason"))).select(*PLAN_COLUMNS)


def lease_failures(rejections: DataFrame) -> DataFrame:
    """(target_ref, status) of the rejections that mean that the target moved; under a lease, any of them is fatal."""
    return rejections.where(lease_failure(F.coalesce("status", F.lit("")))).select("target_ref", "status")


def tally(plans: DataFrame, dry_run: bool = False) -> DataFrame:
    """One row: pushed, deleted, skipped, blocked, warned."""
    a = F.col("action")
    push, delete = a.isin("create", "update"), a == "delete"
    none = F.lit(0).cast("long")
    return plans.agg(
        (none if dry_run else F.count_if(push)).alias("pushed"),
        (none if dry_run else F.count_if(delete)).alias("deleted"),
        F.count_if((a == "skip") | ((push | delete) & F.lit(dry_run))).alias("skipped"),
        F.count_if(a == "block").alias("blocked"),
        F.count_if(a == "warn").alias("warned"),
    )


def plan_lines(plans: DataFrame) -> DataFrame:
    return plans.select("target_ref", plan_line(F.col("action"), F.col("branch"), F.col("target_ref"), F.col("reason")).alias("line"))


def plan_json(plans: DataFrame) -> DataFrame:
    """Rows as JSON text with the public field names; absent values are empty strings."""
    names = {"branch": "branch", "source_ref": "sourceRef", "target_ref": "targetRef", "source_hash": "sourceHash", "target_hash": "targetHash", "kind": "kind", "action": "action", "reason": "reason"}
    return plans.select("target_ref", F.to_json(F.struct(*(F.coalesce(c, F.lit("")).alias(n) for c, n in names.items()))).alias("json"))


def needs_closure(desired: DataFrame, target: DataFrame, policy: Policy) -> DataFrame:
    """One row: whether some desired ref is on the target with another hash, or the policy needs ancestry anyway."""
    there = target.where(~is_zero(F.col("hash"))).select(F.col("ref").alias("target_ref"), F.col("hash").alias("target_hash"))
    moved = desired.join(there, "target_ref").where("source_hash <> target_hash")
    return moved.agg((F.lit(policy.force or policy.prune) | (F.count("*") > 0)).alias("needed"))


def replication_can_bootstrap(desired: DataFrame, target: DataFrame, policy: Policy) -> DataFrame:
    """One row: no desired ref is on the target, and prune would delete nothing."""
    policy = policy.checked()
    there = target.where(~is_zero(F.col("hash"))).select(F.col("ref").alias("target_ref"))
    taken = there.join(desired.select("target_ref"), "target_ref", "left_semi")
    stale = there.join(desired.select("target_ref"), "target_ref", "left_anti").where(F.lit(policy.prune) & prune_scope(F.col("target_ref"), policy))
    return taken.unionByName(stale).agg((F.count("*") == 0).alias("can_bootstrap"))


#: Reasons of the eligibility checks (fixed values).
REASONS = {
    "none": "incremental-no-plans",
    "policy": "incremental-disabled-by-force-prune-or-dry-run",
    "unknown": "incremental-missing-target-capabilities",
    "forward": "fast-forward-branch-or-tag-create",
    "tags": "tag-create-full-pack",
    "replicate": "replicate-overwrite-relay",
    "boot_policy": "bootstrap-disabled-by-force-or-prune",
    "boot_none": "bootstrap-no-managed-refs",
    "boot_exists": "bootstrap-target-ref-exists",
    "boot_ok": "empty-target-managed-refs",
    "branch_mapping": "incremental-non-branch-mapping",
    "branch_missing": "incremental-branch-target-missing",
    "branch_taken": "incremental-branch-create-target-not-empty",
    "branch_action": "incremental-branch-action-not-update-or-create",
    "tag_mapping": "incremental-non-tag-mapping",
    "tag_action": "incremental-tag-action-not-create",
    "other_kind": "incremental-unsupported-ref-kind",
    "tags_plan": "incremental-tag-relay-non-tag-plan",
    "tags_mapping": "incremental-tag-relay-non-tag-mapping",
    "tags_action": "incremental-tag-relay-tag-action-not-create",
    "replicate_kind": "replicate-unsupported-ref-kind",
    "relay_unknown": "replicate-missing-target-capabilities",
    "relay_no_thin": "replicate-target-capable-no-thin",
    "relay_ok": "replicate-target-capable",
}


class Check(NamedTuple):
    """What has to hold for all rows: `fault` says what is wrong with one, `good` and `empty` are the reasons if no row is wrong and if there is none. Only rows `of` a kind count."""

    fault: Column
    good: str
    empty: str | None = None
    of: Column | None = None

    def on(self, of: Column) -> Check:
        return self._replace(of=of if self.of is None else self.of & of)


def eligibilities(plans: DataFrame, checks: dict[str, Check | Sequence[Check]]) -> DataFrame:
    """(check, eligible, reason) of all checks, in one pass: the fault of the first faulty row in target_ref order, else `good`; `empty` for no rows.

    Of several checks under one name the first that passes tells the reason, else the last.
    """
    ladders = {name: [one] if isinstance(one, Check) else list(one) for name, one in checks.items()}
    places = {(name, k): f"_{i}" for i, (name, k) in enumerate((name, k) for name, ladder in ladders.items() for k in range(len(ladder)))}
    said, tallies = [], []
    for (name, k), at in places.items():
        one = ladders[name][k]
        said.append(F.when(F.lit(True) if one.of is None else one.of, F.coalesce(one.fault, F.lit(""))).alias(at))  # null: not of the kind
        bad = F.col(at) != ""
        tallies += [F.min_by(F.when(bad, F.col(at)), F.when(bad, F.col("target_ref"))).alias(f"{at}_fault"), F.count(at).alias(f"{at}_n")]
    found, out = plans.select("target_ref", *said).agg(*tallies), []
    for name, ladder in ladders.items():
        eligible = reason = None
        for k in reversed(range(len(ladder))):
            at, one = places[name, k], ladder[k]
            own = F.coalesce(f"{at}_fault", F.lit(one.good))
            if one.empty is not None:
                own = F.when(F.col(f"{at}_n") == 0, one.empty).otherwise(own)
            passes = own == one.good
            eligible, reason = (passes, own) if reason is None else (passes | eligible, F.when(passes, own).otherwise(reason))
        out.append(F.struct(F.lit(name).alias("check"), eligible.alias("eligible"), reason.alias("reason")))
    return found.select(F.inline(F.array(*out)))


def _quantified(plans: DataFrame, *ladder: Check) -> DataFrame:
    """(eligible, reason) of one check."""
    return eligibilities(plans, {"": ladder}).select("eligible", "reason")


def _refused(reason: str) -> Check:
    """A check that no rows pass."""
    return Check(F.lit(reason), "", reason, F.lit(False))


def incremental_check(policy: Policy, capabilities_known: bool = True) -> Check:
    """All rows are branch creates, branch updates or tag creates."""
    if policy.force or policy.prune or policy.dry_run:
        return _refused(REASONS["policy"])
    kind, action, source, target = F.col("kind"), F.col("action"), ref_kind(F.col("source_ref")), ref_kind(F.col("target_ref"))
    missing = is_zero(F.col("target_hash"))
    fault = (
        F.when((kind == "branch") & ~((source == "branch") & (target == "branch")), REASONS["branch_mapping"])
        .when((kind == "branch") & (action == "update") & missing, REASONS["branch_missing"])
        .when((kind == "branch") & (action == "create") & ~missing, REASONS["branch_taken"])
        .when((kind == "branch") & ~action.isin("create", "update"), REASONS["branch_action"])
        .when((kind == "tag") & ~((source == "tag") & (target == "tag")), REASONS["tag_mapping"])
        .when((kind == "tag") & (action != "create"), REASONS["tag_action"])
        .when(kind == "other", REASONS["other_kind"])
    )
    return Check(fault if capabilities_known else F.lit(REASONS["unknown"]), REASONS["forward"], REASONS["none"])


def incremental_eligibility(plans: DataFrame, policy: Policy, capabilities_known: bool = True) -> DataFrame:
    """Whether all rows are branch creates, branch updates or tag creates."""
    if policy.force or policy.prune or policy.dry_run:
        plans = plans.limit(0)
    return _quantified(plans, incremental_check(policy, capabilities_known))


def tag_create_check() -> Check:
    kind, source, target = F.col("kind"), ref_kind(F.col("source_ref")), ref_kind(F.col("target_ref"))
    fault = (
        F.when(kind != "tag", REASONS["tags_plan"])
        .when(~((source == "tag") & (target == "tag")), REASONS["tags_mapping"])
        .when(F.col("action") != "create", REASONS["tags_action"])
    )
    return Check(fault, REASONS["tags"], REASONS["none"])


def tag_create_eligibility(plans: DataFrame) -> DataFrame:
    return _quantified(plans, tag_create_check())


def fallback_reason(plans: DataFrame, policy: Policy, capabilities_known: bool = True) -> DataFrame:
    """The reason of the incremental check if that passes, else of the tag check."""
    return _quantified(plans, incremental_check(policy, capabilities_known), tag_create_check()).select("reason")


def replicate_check(action: Column | None = None) -> Check:
    """All rows are creates or updates (by `action`, else by their own) between refs of one kind."""
    kind, source, target = F.col("kind"), ref_kind(F.col("source_ref")), ref_kind(F.col("target_ref"))
    action = F.col("action") if action is None else action
    fault = (
        F.when(~kind.isin("branch", "tag", "other"), REASONS["replicate_kind"])
        .when((source != kind) | (target != kind), F.concat(F.lit("replicate-non-"), kind, F.lit("-mapping")))
        .when(~action.isin("create", "update"), F.concat(F.lit("replicate-"), kind, F.lit("-action-not-create-or-update")))
    )
    return Check(fault, REASONS["replicate"])


def replicate_eligibility(plans: DataFrame) -> DataFrame:
    """Whether all rows are creates or updates between refs of one kind; no rows pass."""
    return _quantified(plans, replicate_check())


def bootstrap_check(policy: Policy) -> Check:
    """There are rows, and no target has a hash yet."""
    if policy.force or policy.prune:
        return _refused(REASONS["boot_policy"])
    return Check(F.when(~is_zero(F.col("target_hash")), REASONS["boot_exists"]), REASONS["boot_ok"], REASONS["boot_none"])


def bootstrap_eligibility(desired: DataFrame, target: DataFrame, policy: Policy) -> DataFrame:
    if policy.force or policy.prune:
        desired = desired.limit(0)
    joined = desired.join(target.select(F.col("ref").alias("target_ref"), F.col("hash").alias("target_hash")), "target_ref", "left")
    return _quantified(joined, bootstrap_check(policy))


def relay_support(targets: DataFrame) -> DataFrame:
    """(target, supported, reason) for rows (target, capabilities_known, no_thin)."""
    known = F.col("capabilities_known")
    reason = F.when(~known, REASONS["relay_unknown"]).when(F.col("no_thin"), REASONS["relay_no_thin"]).otherwise(REASONS["relay_ok"])
    return targets.select("target", known.alias("supported"), reason.alias("reason"))


def duplicate_targets(desired: DataFrame) -> DataFrame:
    """(target_ref, sources) of targets wanted from more than one source; a valid set has none."""
    return desired.groupBy("target_ref").agg(F.count_distinct("source_ref").alias("sources")).where("sources > 1")


def subset_of_plans(desired: DataFrame, plans: DataFrame) -> DataFrame:
    """Desired refs that some plan row uses."""
    return desired.join(plans.select("target_ref"), "target_ref", "left_semi")


def pick_head(desired: DataFrame, advertised: str) -> DataFrame:
    """One row, `head`: the advertised ref if wanted, else main, master or the first branch, else null."""
    ladder = F.when(F.col("target_ref") == advertised, 0).when(F.col("target_ref") == "refs/heads/main", 1).when(F.col("target_ref") == "refs/heads/master", 2)
    rank = ladder.when(ref_kind(F.col("target_ref")) == "branch", 3)
    return desired.where(rank.isNotNull()).agg(F.min_by("target_ref", F.struct(rank, "target_ref")).alias("head"))


def hoisted(plans: DataFrame, head: str) -> DataFrame:
    """Plan rows with `pos` in push order: the first row of the source's head, then all by target_ref.

    The position is a prefix count by range-partitioned sort, so no task holds all rows.
    """
    keyed = plans.withColumn("late", F.when(F.col("source_ref") == head, 0).otherwise(1))
    return positions(keyed, ["late", "target_ref"]).drop("late")


def positions(frame: DataFrame, order: list[str]) -> DataFrame:
    """Rows with `pos` from 0 in the given total order: ranges are sorted apart and offset by the sizes of those before."""
    ranges = frame.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())  # a range's number, and 33 bits for the place in it
    spread = Scratch(frame.sparkSession, "positions").save(ranges, "ranges").withColumn("_part", F.shiftright("_id", 33))
    sizes = spread.groupBy("_part").count()  # as many rows as there are partitions
    before = sizes.select("_part", (F.sum("count").over(Window.orderBy("_part")) - F.col("count")).alias("_before"))
    return spread.join(F.broadcast(before), "_part").withColumn("pos", F.col("_before") + F.col("_id") % (1 << 33)).drop("_part", "_id", "_before")
