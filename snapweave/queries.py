"""Queries over the sample tables for every operator outside the corpus package, and the same in DuckDB SQL.

The comment before each query names the inventory rows that it covers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import batching as B
from .functions import refs as R
from .operators import chains, conversion, graph, transfer
from .operators.parts import SMALL
from .operators.prefixes import PrefixIndex, excluded_by
from .operators.reach import ReachIndex
from .operators.reach import walk_sizes as walk_guard
from .plans import actions as A
from .plans.policy import Mapping, Policy
from .sources import derived as D
from .sources import protocol as P

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

EVERYTHING = Policy(all_refs=True)
PRUNING = Policy(all_refs=True, prune=True, force=True, exclude_prefixes=("refs/notes/1", " "), exclude_refs=("refs/tags/4", ""))
RENAMES = Policy(mappings=(Mapping("3", "renamed-3"), Mapping("refs/tags/1", "refs/tags/renamed-1"), Mapping("refs/heads/6", "refs/heads/8")), include_tags=True, prune=True)


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


KIND = "CASE WHEN {0} LIKE 'refs/heads/%' THEN 'branch' WHEN {0} LIKE 'refs/tags/%' THEN 'tag' WHEN {0} LIKE 'refs/%' THEN 'other' ELSE '' END"
SHORT = "regexp_replace({0}, '^refs/(heads/|tags/)?', '')"
KEY_REF = "'refs/' || CASE o_orderkey % 3 WHEN 0 THEN 'heads' WHEN 1 THEN 'tags' ELSE 'notes' END || '/' || o_orderkey"
HASH = "sha1('s:' || o_orderstatus || o_orderkey)"
SNAPSHOTS = f"""src AS (SELECT {KEY_REF} AS ref, {HASH} AS hash FROM orders WHERE o_orderkey % 7 <> 0),
tgt AS (SELECT {KEY_REF} AS ref, CASE WHEN o_orderkey % 5 = 0 THEN sha1('t:' || o_orderstatus || o_orderkey) ELSE {HASH} END AS hash FROM orders WHERE o_orderkey % 11 <> 0)"""
DESIRED = f"{SNAPSHOTS}, des AS (SELECT {KIND.format('ref')} AS kind, {SHORT.format('ref')} AS label, ref AS source_ref, ref AS target_ref, hash AS source_hash FROM src)"
S8, T8 = "coalesce(left(source_hash, 8), '<zero>')", "coalesce(left(target_hash, 8), '<zero>')"
PLAN_REST = "branch, source_ref, target_ref, source_hash, target_hash, kind, action, reason"
#: The plan of everything, every branch change being a fast-forward.
FORWARD = f"""{DESIRED}, plan AS (
  SELECT label AS branch, source_ref, target_ref, source_hash, t.hash AS target_hash, kind,
    CASE WHEN t.ref IS NULL THEN 'create' WHEN source_hash = t.hash THEN 'skip' WHEN kind = 'branch' THEN 'update' ELSE 'block' END AS action,
    CASE WHEN t.ref IS NULL THEN left(source_hash, 8) || ' -> <new>' WHEN source_hash = t.hash THEN left(source_hash, 8) || ' already current'
      WHEN kind = 'branch' THEN left(t.hash, 8) || ' -> ' || left(source_hash, 8)
      ELSE left(t.hash, 8) || ' differs from ' || left(source_hash, 8) || '; use --force-with-lease to update ' || kind || ' ref ' || target_ref END AS reason
  FROM des LEFT JOIN tgt t ON t.ref = des.target_ref)"""


def _forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.plan_sync(A.desired_refs(D.source_refs(spark, sf_dir), EVERYTHING), D.target_refs(spark, sf_dir), EVERYTHING)


def _desired(spark: SparkSession, sf_dir: str, policy: Policy = EVERYTHING) -> DataFrame:
    return A.desired_refs(D.source_refs(spark, sf_dir), policy)


# Everything but excluded names
@query(f"""WITH {SNAPSHOTS} SELECT {KIND.format('ref')} AS kind, {SHORT.format('ref')} AS label, ref AS source_ref, ref AS target_ref, hash AS source_hash
FROM src WHERE NOT starts_with(ref, 'refs/notes/1') AND ref <> 'refs/tags/4'""")
def scope_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _desired(spark, sf_dir, PRUNING)


# Named branches, unknown names dropped
@query(f"WITH {SNAPSHOTS} SELECT 'branch' AS kind, {SHORT.format('ref')} AS label, ref AS source_ref, ref AS target_ref, hash AS source_hash FROM src WHERE ref IN ('refs/heads/3', 'refs/heads/9')")
def scope_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _desired(spark, sf_dir, Policy(branches=("3", "9", "absent")))


# Renames, and tags that no rename makes
@query(f"""WITH {SNAPSHOTS}, m(source_ref, target_ref) AS (VALUES ('refs/heads/3', 'refs/heads/renamed-3'), ('refs/tags/1', 'refs/tags/renamed-1'), ('refs/heads/6', 'refs/heads/8')), both_ AS (
SELECT source_ref, target_ref, hash FROM m JOIN src ON ref = source_ref
UNION ALL SELECT ref, ref, hash FROM src WHERE ref LIKE 'refs/tags/%' AND ref NOT IN (SELECT target_ref FROM m))
SELECT {KIND.format('target_ref')} AS kind, {SHORT.format('target_ref')} AS label, source_ref, target_ref, hash AS source_hash FROM both_""")
def scope_renames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _desired(spark, sf_dir, RENAMES)


# The plan if every branch change is a fast-forward (flagship)
@query(f"WITH {FORWARD} SELECT {PLAN_REST} FROM plan")
def plan_fast_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _forward(spark, sf_dir)


# Full outer reconciliation under prune and force
@query(f"""WITH {SNAPSHOTS}, des AS (SELECT * FROM src WHERE NOT starts_with(ref, 'refs/notes/1') AND ref <> 'refs/tags/4'), j AS (
SELECT coalesce(d.ref, t.ref) AS target_ref, d.ref AS source_ref, d.hash AS source_hash, t.hash AS target_hash, t.ref IS NOT NULL AS there, {KIND.format('coalesce(d.ref, t.ref)')} AS kind
FROM des d FULL JOIN tgt t ON d.ref = t.ref WHERE d.ref IS NOT NULL OR (NOT starts_with(t.ref, 'refs/notes/1') AND t.ref <> 'refs/tags/4'))
SELECT {SHORT.format('target_ref')} AS branch, source_ref, target_ref, source_hash, target_hash, kind,
CASE WHEN source_ref IS NULL THEN 'delete' WHEN NOT there THEN 'create' WHEN source_hash = target_hash THEN 'skip' ELSE 'update' END AS action,
CASE WHEN source_ref IS NULL THEN {T8} || ' -> <deleted>' WHEN NOT there THEN {S8} || ' -> <new>' WHEN source_hash = target_hash THEN {S8} || ' already current'
WHEN kind = 'branch' THEN {T8} || ' -> ' || {S8} ELSE {T8} || ' -> ' || {S8} || ' (force ' || kind || ' update)' END AS reason FROM j""")
def plan_prune_force(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.plan_sync(_desired(spark, sf_dir, PRUNING), D.target_refs(spark, sf_dir), PRUNING)


# Overwriting plan
@query(f"""WITH {DESIRED} SELECT label AS branch, source_ref, target_ref, source_hash, t.hash AS target_hash, kind,
CASE WHEN source_hash = t.hash THEN 'skip' WHEN t.ref IS NULL THEN 'create' ELSE 'update' END AS action,
CASE WHEN source_hash = t.hash THEN left(source_hash, 8) || ' already current' WHEN t.ref IS NULL THEN left(source_hash, 8) || ' -> <new>'
ELSE left(t.hash, 8) || ' -> ' || left(source_hash, 8) || CASE WHEN kind = 'tag' THEN ' (replicate tag overwrite)' ELSE ' (replicate overwrite)' END END AS reason
FROM des LEFT JOIN tgt t ON t.ref = des.target_ref""")
def plan_replicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.plan_replication(_desired(spark, sf_dir), D.target_refs(spark, sf_dir), EVERYTHING)


# Creates against a target without branches
@query(f"""WITH {DESIRED} SELECT label AS branch, source_ref, target_ref, source_hash, CAST(NULL AS VARCHAR) AS target_hash, kind, 'create' AS action,
'create ' || target_ref || ' at ' || left(source_hash, 8) AS reason FROM des WHERE kind = 'branch'""")
def plan_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = D.target_refs(spark, sf_dir).where(~F.col("ref").startswith("refs/heads/"))
    return A.plan_bootstrap(_desired(spark, sf_dir, Policy()), target)


GRAPH = f"""o AS (SELECT o_custkey AS branch, {HASH} AS node, o_orderkey AS key, o_orderdate AS date FROM orders),
edges AS (SELECT * FROM (SELECT node AS child, lag(node) OVER (PARTITION BY branch ORDER BY date, key) AS parent, 1 AS ord FROM o) WHERE parent IS NOT NULL
UNION ALL SELECT a.node, arg_max(b.node, (b.date, b.key)), 2 FROM o a JOIN o b ON b.branch = xor(a.branch, 1) AND (b.date, b.key) < (a.date, a.key) WHERE a.key % 4 = 0 GROUP BY a.node),
tips AS (SELECT branch, arg_max(node, (date, key)) AS node FROM o GROUP BY branch)"""
REACH = f"{GRAPH}, reach AS (SELECT node AS start, node FROM tips UNION SELECT r.start, e.parent FROM reach r JOIN edges e ON e.child = r.node)"
BRANCHES = """snap AS (SELECT 'refs/heads/c' || t.branch AS ref, t.node AS source_hash,
CASE t.branch % 4 WHEN 0 THEN t.node WHEN 1 THEN e.parent WHEN 2 THEN b.node END AS target_hash
FROM tips t LEFT JOIN edges e ON e.child = t.node AND e.ord = 1 LEFT JOIN tips b ON b.branch = xor(t.branch, 1))"""


# The plan with real ancestry
@query(f"""WITH RECURSIVE {REACH}, {BRANCHES}, j AS (SELECT s.*, r.node IS NOT NULL AS forward FROM snap s LEFT JOIN reach r ON r.start = s.source_hash AND r.node = s.target_hash)
SELECT {SHORT.format('ref')} AS branch, ref AS source_ref, ref AS target_ref, source_hash, target_hash, 'branch' AS kind,
CASE WHEN target_hash IS NULL THEN 'create' WHEN source_hash = target_hash THEN 'skip' WHEN forward THEN 'update' ELSE 'block' END AS action,
CASE WHEN target_hash IS NULL THEN {S8} || ' -> <new>' WHEN source_hash = target_hash THEN {S8} || ' already current' WHEN forward THEN {T8} || ' -> ' || {S8}
ELSE {T8} || ' is not an ancestor of ' || {S8} END AS reason FROM j""")
def plan_with_ancestry(spark: SparkSession, sf_dir: str) -> DataFrame:
    source, target = D.branch_snapshots(spark, sf_dir)
    desired = A.desired_refs(source, Policy())
    moved = desired.join(target, F.col("target_ref") == F.col("ref")).where("source_hash <> hash").select(F.col("source_hash").alias("start"), F.col("hash").alias("ancestor"))
    return A.plan_sync(desired, target, Policy(), graph.ancestor_pairs(D.commit_edges(spark, sf_dir), moved))


# Plan lines
@query(f"WITH {FORWARD} SELECT target_ref, upper(action) || ' ' || target_ref || ' - ' || reason AS line FROM plan")
def plan_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.plan_lines(_forward(spark, sf_dir))


# Plan rows as JSON
@query(f"""WITH {FORWARD} SELECT target_ref, CAST(to_json({{'branch': branch, 'sourceRef': source_ref, 'targetRef': target_ref, 'sourceHash': source_hash,
'targetHash': coalesce(target_hash, ''), 'kind': kind, 'action': action, 'reason': reason}}) AS VARCHAR) AS json FROM plan""")
def plan_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.plan_json(_forward(spark, sf_dir))


# push commands
@query(f"WITH {FORWARD} SELECT target_ref AS name, CAST(NULL AS VARCHAR) AS old, source_hash AS new, false AS delete FROM plan")
def push_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.push_commands(_forward(spark, sf_dir), blind=True)


REJECTED = "rej AS (SELECT ref AS target_ref, CASE WHEN length(ref) % 4 = 0 THEN '' WHEN length(ref) % 4 = 1 THEN 'Stale info' WHEN length(ref) % 4 = 2 THEN 'hook declined' ELSE 'non-fast-forward' END AS status FROM tgt WHERE ref LIKE '%3')"


def _rejections(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length("ref") % 4
    status = F.when(n == 0, "").when(n == 1, "Stale info").when(n == 2, "hook declined").otherwise("non-fast-forward")
    return D.target_refs(spark, sf_dir).where(F.col("ref").endswith("3")).select(F.col("ref").alias("target_ref"), status.alias("status"))


# Rejections become warnings
@query(f"""WITH {FORWARD}, {REJECTED} SELECT branch, source_ref, p.target_ref, source_hash, target_hash, kind, CASE WHEN r.target_ref IS NULL THEN action ELSE 'warn' END AS action,
CASE WHEN r.target_ref IS NULL THEN reason WHEN status = '' THEN 'target rejected ref update' ELSE 'target rejected ref update: ' || status END AS reason FROM plan p LEFT JOIN rej r ON r.target_ref = p.target_ref""")
def plan_rejections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.apply_rejections(_forward(spark, sf_dir), _rejections(spark, sf_dir))


# Rejections that mean a moved target
@query(f"WITH {SNAPSHOTS}, {REJECTED} SELECT target_ref, status FROM rej WHERE status IN ('Stale info', 'non-fast-forward')")
def lease_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.lease_failures(_rejections(spark, sf_dir))


# Tallies of a real and a dry run
@query(f"""WITH {FORWARD}, {REJECTED}, p AS (SELECT CASE WHEN r.target_ref IS NULL THEN action ELSE 'warn' END AS a FROM plan p LEFT JOIN rej r ON r.target_ref = p.target_ref)
SELECT dry, CAST(CASE WHEN dry THEN 0 ELSE count(*) FILTER (a IN ('create', 'update')) END AS BIGINT) AS pushed, CAST(CASE WHEN dry THEN 0 ELSE count(*) FILTER (a = 'delete') END AS BIGINT) AS deleted,
count(*) FILTER (a = 'skip' OR dry AND a IN ('create', 'update', 'delete')) AS skipped, count(*) FILTER (a = 'block') AS blocked, count(*) FILTER (a = 'warn') AS warned
FROM p, (VALUES (true), (false)) v(dry) GROUP BY dry""")
def plan_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    plans = A.apply_rejections(_forward(spark, sf_dir), _rejections(spark, sf_dir))
    return A.tally(plans, True).withColumn("dry", F.lit(True)).unionByName(A.tally(plans).withColumn("dry", F.lit(False)))


# Eligibility checks over several plans
@query("""SELECT * FROM (VALUES ('bootstrap', false, 'bootstrap-target-ref-exists'), ('bootstrap-forced', false, 'bootstrap-disabled-by-force-or-prune'),
('incremental', false, 'incremental-unsupported-ref-kind'), ('incremental-branches', true, 'fast-forward-branch-or-tag-create'), ('incremental-none', false, 'incremental-no-plans'),
('incremental-unknown', false, 'incremental-missing-target-capabilities'), ('tags', true, 'tag-create-full-pack'), ('replicate', false, 'replicate-branch-action-not-create-or-update'),
('replicate-none', true, 'replicate-overwrite-relay'), ('fallback', NULL, 'incremental-tag-relay-non-tag-plan')) v("check", eligible, reason)""")
def eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, action = F.col("kind"), F.col("action")
    moved = action.isin("create", "update")
    branches = (kind == "branch") & moved
    checks = {
        "bootstrap": A.bootstrap_check(EVERYTHING),
        "bootstrap-forced": A.bootstrap_check(Policy(force=True)),
        "incremental": A.incremental_check(EVERYTHING).on(moved | (kind == "other")),
        "incremental-branches": A.incremental_check(EVERYTHING).on(branches),
        "incremental-none": A.incremental_check(EVERYTHING).on(F.lit(False)),
        "incremental-unknown": A.incremental_check(EVERYTHING, False).on(branches),
        "tags": A.tag_create_check().on((kind == "tag") & (action == "create")),
        "replicate": A.replicate_check(A.replication_action()),
        "replicate-none": A.replicate_check(A.replication_action()).on(F.lit(False)),
        "fallback": [c.on(kind != "tag") for c in (A.incremental_check(EVERYTHING), A.tag_create_check())],
    }
    found = A.eligibilities(_forward(spark, sf_dir), checks)  # the rows of a replication have the same refs and hashes
    return found.select("check", F.when(F.col("check") != "fallback", F.col("eligible")).alias("eligible"), "reason")


# Relay support of targets
@query("""SELECT s_suppkey AS target, s_suppkey % 3 <> 0 AS supported, CASE WHEN s_suppkey % 3 = 0 THEN 'replicate-missing-target-capabilities'
WHEN s_suppkey % 2 = 0 THEN 'replicate-target-capable-no-thin' ELSE 'replicate-target-capable' END AS reason FROM supplier""")
def relay_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    return A.relay_support(D.table(spark, sf_dir, "supplier").select(k.alias("target"), (k % 3 != 0).alias("capabilities_known"), (k % 2 == 0).alias("no_thin")))


# Does planning need ancestry, can a replication begin afresh
@query(f"WITH {DESIRED} SELECT count(*) > 0 AS needed, false AS can_bootstrap FROM des JOIN tgt t ON t.ref = des.target_ref WHERE source_hash <> t.hash")
def closure_needed(spark: SparkSession, sf_dir: str) -> DataFrame:
    desired, target = _desired(spark, sf_dir), D.target_refs(spark, sf_dir)
    return A.needs_closure(desired, target, EVERYTHING).join(A.replication_can_bootstrap(desired, target, PRUNING))


# Targets wanted twice
@query(f"WITH {SNAPSHOTS} SELECT left(ref, 12) AS target_ref, count(DISTINCT ref) AS sources FROM src GROUP BY 1 HAVING count(DISTINCT ref) > 1")
def duplicate_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.duplicate_targets(_desired(spark, sf_dir).withColumn("target_ref", F.substring("target_ref", 1, 12)))


# Desired refs that the push uses
@query(f"WITH {FORWARD} SELECT d.kind, d.label, d.source_ref, d.target_ref, d.source_hash FROM des d WHERE target_ref IN (SELECT target_ref FROM plan WHERE action IN ('create', 'update'))")
def refs_of_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.subset_of_plans(_desired(spark, sf_dir), _forward(spark, sf_dir).where("action in ('create', 'update')"))


# The head ladder
@query(f"WITH {SNAPSHOTS} SELECT min(ref) AS head FROM src WHERE ref LIKE 'refs/heads/%'")
def pick_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.pick_head(_desired(spark, sf_dir), "refs/heads/trunk")


# Push order with the head first
@query(f"WITH {FORWARD} SELECT {PLAN_REST}, CAST(row_number() OVER (ORDER BY CASE WHEN source_ref = 'refs/heads/99' THEN 0 ELSE 1 END, target_ref) - 1 AS BIGINT) AS pos FROM plan")
def hoisted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.hoisted(_forward(spark, sf_dir), "refs/heads/99")


# Chunks of ref updates
@query(f"WITH {FORWARD} SELECT target_ref AS name, target_hash AS old, source_hash AS new, false AS delete, CAST((row_number() OVER (ORDER BY target_ref) - 1) // 500 AS BIGINT) AS chunk FROM plan")
def chunked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chains.chunked(A.push_commands(_forward(spark, sf_dir)), 500)


# foreign change-request refs
@query("""SELECT count(*) FILTER (event_id % 4 < 3) AS foreign_refs, count(*) AS refs FROM events""")
def foreign_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    space = F.when(e % 4 == 0, "refs/pull/").when(e % 4 == 1, "refs/pull-requests/").when(e % 4 == 2, "refs/merge-requests/").otherwise("refs/pullx/")
    refs = D.table(spark, sf_dir, "events").select(F.concat(space, e.cast("string")).alias("ref"))
    return refs.agg(F.count_if(R.foreign_pull(F.col("ref"))).alias("foreign_refs"), F.count("*").alias("refs"))


# What server messages mean
@query("""WITH m AS (SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'Body exceeded size limit ' || (event_id * 1000) WHEN 1 THEN 'HTTP 413' WHEN 2 THEN 'request body is TOO LARGE' WHEN 3 THEN 'http 408 timeout'
WHEN 4 THEN 'remote ref has changed' WHEN 5 THEN 'payload ok' ELSE 'fetch first' END AS m FROM events)
SELECT event_id, event_id % 7 IN (0, 1, 2) AS too_large, event_id % 7 = 3 AS too_slow, event_id % 7 = 4 AS moved, event_id % 7 = 6 AS lease, CAST(CASE WHEN event_id % 7 = 0 THEN event_id * 1000 ELSE 0 END AS BIGINT) AS body_limit FROM m""")
def message_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    text = F.when(e % 7 == 0, F.concat(F.lit("Body exceeded size limit "), (e * 1000).cast("string"))).when(e % 7 == 1, "HTTP 413").when(e % 7 == 2, "request body is TOO LARGE")
    text = text.when(e % 7 == 3, "http 408 timeout").when(e % 7 == 4, "remote ref has changed").when(e % 7 == 5, "payload ok").otherwise("fetch first")
    m = D.table(spark, sf_dir, "events").select("event_id", text.alias("m"))
    c = F.col("m")
    return m.select("event_id", R.body_limit_error(c).alias("too_large"), R.deadline_error(c).alias("too_slow"), R.concurrent_move(c).alias("moved"), R.lease_failure(c).alias("lease"), R.body_limit(c).alias("body_limit"))


# URLs
@query("""WITH u AS (SELECT page_id, url, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path,
regexp_extract(url, '^[^?#]*([?][^#]*)', 1) AS q, regexp_extract(url, '(#.*)$', 1) AS f FROM pages)
SELECT page_id, scheme || '://' || host || CASE WHEN rtrim(path, '/') = '' THEN '/' ELSE rtrim(path, '/') END || q || f AS normalized, host, url AS redacted, true AS same,
regexp_extract(url, '^[a-z]+://[^/]+/([^/?#]+/[^/?#]+?)/?$', 1) AS owner_repo FROM u""")
def urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    dressed = F.concat(F.lit("  "), F.regexp_replace(F.regexp_replace(u, "^https://", "HTTPS://me:secret@"), "^http://", "Http://me@"))
    dressed = F.when(u.rlike("[?#]"), dressed).otherwise(F.concat(dressed, F.lit("/")))
    secret = F.regexp_replace(u, "://", "://me:secret@")
    return D.table(spark, sf_dir, "pages").select(
        "page_id", R.normalized_url(dressed).alias("normalized"), R.url_host(u).alias("host"), R.redacted_url(secret).alias("redacted"), R.same_repository(u, dressed).alias("same"), R.owner_and_repo(u).alias("owner_repo")
    )


# Sizes and batch arithmetic
@query("""WITH e AS (SELECT event_id, event_id * event_id * 997 AS sent, event_id * 65536 AS lim, event_id % 50 AS objects FROM events), h AS (SELECT *, sent / 1024.0::DOUBLE AS kb, sent / 1048576.0::DOUBLE AS mb, sent / 1073741824.0::DOUBLE AS gb, sent / 1099511627776.0::DOUBLE AS tb, sent / 1125899906842624.0::DOUBLE AS pb FROM e)
SELECT event_id, CASE WHEN sent < 1024 THEN sent || ' B' WHEN sent < 1048576 THEN CASE WHEN kb >= 100 THEN printf('%.0f', kb) WHEN kb >= 10 THEN printf('%.1f', kb) ELSE printf('%.2f', kb) END || ' KB'
WHEN sent < 1073741824 THEN CASE WHEN mb >= 100 THEN printf('%.0f', mb) WHEN mb >= 10 THEN printf('%.1f', mb) ELSE printf('%.2f', mb) END || ' MB'
WHEN sent < 1099511627776 THEN CASE WHEN gb >= 100 THEN printf('%.0f', gb) WHEN gb >= 10 THEN printf('%.1f', gb) ELSE printf('%.2f', gb) END || ' GB'
WHEN sent < 1125899906842624 THEN CASE WHEN tb >= 100 THEN printf('%.0f', tb) WHEN tb >= 10 THEN printf('%.1f', tb) ELSE printf('%.2f', tb) END || ' TB'
ELSE CASE WHEN pb >= 100 THEN printf('%.0f', pb) WHEN pb >= 10 THEN printf('%.1f', pb) ELSE printf('%.2f', pb) END || ' PB' END AS human,
CAST(CASE WHEN event_id <= 0 OR lim <= 0 THEN 1 ELSE greatest((event_id * 65536 + lim * 3 - 1) // (lim * 3), 1) END AS BIGINT) AS batches,
CAST(CASE WHEN sent <= 0 OR lim <= 0 THEN 2 ELSE greatest((sent * CASE WHEN sent * 10 >= lim * 9 THEN 4 ELSE 2 END + lim - 1) // lim, 2) END AS BIGINT) AS split,
CAST(CASE WHEN sent > 0 AND objects > 0 AND 2 * sent // objects > 750 THEN 2 * sent // objects ELSE 0 END AS BIGINT) AS calibrated,
CAST(CASE WHEN sent > 0 AND lim > 0 AND sent < lim // 2 THEN least((sent * 2 <= lim // 2)::INT + (sent * 4 <= lim // 2)::INT + (sent * 8 <= lim // 2)::INT + (sent * 16 <= lim // 2)::INT + (sent * 32 <= lim // 2)::INT
 + (sent * 64 <= lim // 2)::INT + (sent * 128 <= lim // 2)::INT + (sent * 256 <= lim // 2)::INT, 5) ELSE 0 END AS BIGINT) AS dropped,
lim > 0 AND (sent >= lim * 95 // 100 OR (sent >= 8388608 AND objects > 0 AND sent * 60 // nullif(objects, 0) > lim * 95 // 100)) AS stop,
CAST(CASE WHEN objects = 0 AND event_id % 2 = 0 THEN 1 ELSE objects END AS BIGINT) AS effective, objects * 750 AS estimated FROM h""")
def batch_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    rows = D.table(spark, sf_dir, "events").select("event_id", (e * e * 997).alias("sent"), (e * 65536).alias("lim"), (e % 50).alias("objects"))
    sent, lim, objects, n = F.col("sent"), F.col("lim"), F.col("objects"), lambda x: F.lit(x).cast("long")
    return rows.select(
        "event_id", R.human_bytes(sent).alias("human"), B.batch_count(e, lim * 3).alias("batches"), B.split_factor(sent, lim).alias("split"), B.calibrated_object_bytes(sent, objects, n(750)).alias("calibrated"),
        B.drop_count(sent, lim, n(5)).alias("dropped"), B.should_stop(sent, objects, n(60), lim).alias("stop"), B.effective_objects(objects, n(60), e % 2 == 0).alias("effective"), B.estimated_pack_bytes(objects, n(750)).alias("estimated"),
    )


# Names and lists
@query("""SELECT c_custkey, 'refs/snapweave/staging/heads/' || c_custkey AS staging, 'v2' AS mode, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_name END AS map_source, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE 'a:b' END AS map_target,
CASE WHEN c_custkey % 2 = 0 THEN 'refs/tags/' || c_custkey ELSE 'refs/heads/' || c_custkey END AS have, c_mktsegment || ',' || c_custkey AS listed, replace(c_name, '#', '-') || '-x' AS token FROM customer""")
def names_and_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, name = F.col("c_custkey").cast("string"), F.col("c_name")
    pair = R.parse_mapping(F.when(F.col("c_custkey") % 5 == 0, F.concat(name, F.lit(":"))).otherwise(F.concat(F.lit(" "), name, F.lit(" : a:b"))))
    return D.table(spark, sf_dir, "customer").select(
        "c_custkey", R.staging_ref(F.concat(F.lit("refs/heads/"), k)).alias("staging"), R.protocol_mode(F.lit("v2")).alias("mode"), pair["source"].alias("map_source"), pair["target"].alias("map_target"),
        R.have_ref(F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("refs/tags/"), k)).otherwise(k)).alias("have"),
        F.array_join(R.split_list(F.concat(F.lit(" ,"), "c_mktsegment", F.lit(", ,"), k, F.lit(","))), ",").alias("listed"),
        R.token(F.concat(F.lit(" "), F.regexp_replace(name, "#", "  "), F.lit(" \t x "))).alias("token"),
    )


# Everything reachable from the tips
@query(f"WITH RECURSIVE {REACH} SELECT start, node FROM reach")
def reachable_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.reachable_pairs(D.commit_edges(spark, sf_dir), D.tips(spark, sf_dir).select(F.col("node").alias("start")))


# Questions of ancestry over an index of the graph
@query(f"""WITH RECURSIVE {REACH} SELECT t.node AS start, o.node AS ancestor FROM tips t JOIN o ON o.branch = xor(t.branch, 1) AND o.key % 5 < 2 JOIN reach r ON r.start = t.node AND r.node = o.node""")
def indexed_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = D.commits(spark, sf_dir)
    asked = nodes.where("key % 5 < 2").select(F.expr("branch ^ 1").alias("branch"), F.col("node").alias("ancestor"))
    pairs = D.tips(spark, sf_dir).select("branch", F.col("node").alias("start")).join(asked, "branch")
    return ReachIndex(D.commit_edges(spark, sf_dir), nodes.select("node"), small=SMALL).ancestor_pairs(pairs)


# How far walks go, and which pass the guard
@query(f"WITH RECURSIVE {REACH} SELECT start, CAST(least(count(*), 20) AS BIGINT) AS visited, count(*) > 20 AS exceeded FROM reach GROUP BY start")
def walk_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return walk_guard(D.commit_edges(spark, sf_dir), D.tips(spark, sf_dir).select(F.col("node").alias("start")), 20)


# Whether a store passes the guard on its number of objects
@query("SELECT count(*) > 1000 AS exceeded FROM lineitem")
def limit_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.limit_verdict(D.table(spark, sf_dir, "lineitem").select("l_orderkey"), 1000)


# Closure of the wants minus what the haves hold
@query(f"""WITH RECURSIVE {GRAPH}, stop AS (SELECT node FROM o WHERE key % 5 = 0),
reach AS (SELECT node FROM tips WHERE node NOT IN (SELECT node FROM stop) UNION SELECT e.parent FROM reach r JOIN edges e ON e.child = r.node WHERE e.parent NOT IN (SELECT node FROM stop))
SELECT node FROM reach""")
def objects_to_push(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = D.commits(spark, sf_dir)
    return graph.objects_to_push(D.commit_edges(spark, sf_dir), D.tips(spark, sf_dir), nodes.where("key % 5 = 0").select("node"), nodes.select("node"))


# Branches whose tip the trunk already holds
@query(f"""WITH RECURSIVE {GRAPH}, reach AS (SELECT node FROM tips WHERE branch = (SELECT max(branch) FROM tips) UNION SELECT e.parent FROM reach r JOIN edges e ON e.child = r.node)
SELECT o.branch, o.node FROM o JOIN reach USING (node)""")
def subsumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = D.tips(spark, sf_dir)
    trunk = ends.join(ends.agg(F.max("branch").alias("branch")), "branch").select("node")
    return D.commits(spark, sf_dir).select("branch", "node").join(graph.reachable(D.commit_edges(spark, sf_dir), trunk), "node", "left_semi").select("branch", "node")


# First-parent chains
@query(f"WITH {GRAPH} SELECT t.node AS tip, o.node, CAST(row_number() OVER (PARTITION BY o.branch ORDER BY o.date, o.key) - 1 AS BIGINT) AS pos FROM o JOIN tips t USING (branch)")
def first_parent_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.first_parent_chains(D.commit_edges(spark, sf_dir), D.tips(spark, sf_dir).select("node"))


# Levels of the whole graph
@query(f"""WITH RECURSIVE {GRAPH}, walk AS (SELECT node, 0 AS level FROM o UNION SELECT e.child, w.level + 1 FROM walk w JOIN edges e ON e.parent = w.node)
SELECT node, CAST(max(level) AS INTEGER) AS level FROM walk GROUP BY node""")
def graph_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.levels(D.commit_edges(spark, sf_dir), D.commits(spark, sf_dir))


# Smallest-ready-first order of the whole graph (no SQL; tested against a walker)
@query()
def topological_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.topological_order(D.commit_edges(spark, sf_dir), D.commits(spark, sf_dir).select("node"))


# Everything reachable from the tips, with types
@query(f"WITH RECURSIVE {REACH} SELECT DISTINCT node AS hash, 'commit' AS type FROM reach")
def typed_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = D.commits(spark, sf_dir).select(F.col("node").alias("hash"), F.lit("commit").alias("type"))
    return graph.typed_closure(D.commit_edges(spark, sf_dir), D.tips(spark, sf_dir).select("node"), kinds)


CHAIN = f"o AS (SELECT o_custkey AS branch, {HASH} AS hash, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS BIGINT) AS pos, count(*) OVER (PARTITION BY o_custkey) AS size FROM orders)"
EVEN = f"{CHAIN}, even_ AS (SELECT branch, pos, hash FROM o WHERE pos = size - 1 OR (size > 3 AND (pos + 1) % (size // 3) = 0 AND (pos + 1) // (size // 3) < 3))"


def _even(spark: SparkSession, sf_dir: str) -> DataFrame:
    chain = D.first_parents(spark, sf_dir)
    return chains.even_checkpoints(chain, chain.select("branch").distinct().withColumn("n", F.lit(3)))


# Even checkpoints
@query(f"WITH {EVEN} SELECT branch, pos, hash FROM even_")
def even_checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _even(spark, sf_dir)


# Gaps halved, from where each branch stands
@query(f"""WITH {EVEN}, cur AS (SELECT branch, pos AS at FROM o WHERE pos = 0 AND branch % 2 = 0), g AS (SELECT e.branch, e.pos, coalesce(lag(e.pos) OVER (PARTITION BY e.branch ORDER BY e.pos), c.at, -1) AS prev FROM even_ e LEFT JOIN cur c USING (branch)),
p AS (SELECT branch, pos FROM g UNION ALL SELECT branch, prev + (pos - prev) // 2 FROM g WHERE pos - prev > 1) SELECT branch, pos, hash FROM p JOIN o USING (branch, pos)""")
def subdivided(spark: SparkSession, sf_dir: str) -> DataFrame:
    chain = D.first_parents(spark, sf_dir)
    return chains.subdivided(chain, _even(spark, sf_dir), chain.where("pos = 0 and branch % 2 = 0").select("branch", "hash"))


def _halved(before: str, after: str) -> str:
    """SQL: a relation of checkpoints with the middles of its gaps."""
    gaps = f"(SELECT branch, pos, coalesce(lag(pos) OVER (PARTITION BY branch ORDER BY pos), -1) AS prev FROM {before})"
    return f"{after} AS (SELECT branch, pos FROM {before} UNION ALL SELECT branch, prev + (pos - prev) // 2 FROM {gaps} WHERE pos - prev > 1)"


# Halved until there are three, from the tips alone
@query(f"WITH {CHAIN}, tip AS (SELECT branch, pos FROM o WHERE pos = size - 1), {_halved('tip', 'one')}, {_halved('one', 'two')} SELECT branch, pos, hash FROM two JOIN o USING (branch, pos)")
def subdivided_to(spark: SparkSession, sf_dir: str) -> DataFrame:
    chain = D.first_parents(spark, sf_dir)
    tips = chains.even_checkpoints(chain, chain.select("branch").distinct().withColumn("n", F.lit(1)))
    return chains.subdivided_to(chain, tips.select("branch", "pos"), 3)


# Each branch by itself, from one to four checkpoints to at least five
@query(f"""WITH RECURSIVE {CHAIN}, begun AS (SELECT branch, pos, size FROM (SELECT *, 1 + branch % 4 AS n FROM o) x WHERE pos = size - 1 OR (n > 1 AND n < size AND (pos + 1) % (size // n) = 0 AND (pos + 1) // (size // n) < n)),
h AS (SELECT branch, 0 AS k, list(pos ORDER BY pos) AS p, 0 AS before FROM begun GROUP BY branch
UNION ALL
SELECT branch, k + 1, list_sort(list_distinct(list_concat(p, list_filter(list_transform(range(1, len(p) + 1), lambda i: CASE WHEN i = 1 THEN -1 ELSE p[i - 1] END + (p[i] - CASE WHEN i = 1 THEN -1 ELSE p[i - 1] END) // 2), lambda x: x >= 0)))), len(p)
FROM h WHERE k = 0 OR (len(p) > before AND len(p) < 5)),
done AS (SELECT branch, unnest(arg_max(p, k)) AS pos FROM h GROUP BY branch)
SELECT branch, pos, hash FROM done JOIN o USING (branch, pos)""")
def subdivided_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    chain = D.first_parents(spark, sf_dir)
    begun = chains.even_checkpoints(chain, chain.select("branch").distinct().withColumn("n", 1 + F.col("branch") % 4))
    return chains.subdivided_to(chain, begun.select("branch", "pos"), 5)


# The largest checkpoint under a limit, by all sizes and by a few probes
@query("""WITH z AS (SELECT branch, pos, size AS n, coalesce(q, 0) AS s FROM (SELECT o_custkey AS branch, o_orderkey AS k, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS BIGINT) AS pos, count(*) OVER (PARTITION BY o_custkey) AS size FROM orders) y
LEFT JOIN (SELECT l_orderkey AS k, CAST(sum(l_quantity) AS BIGINT) AS q FROM lineitem GROUP BY 1) l USING (k)),
t AS (SELECT branch, pos, n, branch % 4 - 1 AS pre, branch % 6 AS span, sum(s) OVER (PARTITION BY branch ORDER BY pos) AS total FROM z),
b AS (SELECT branch, any_value(n) - 1 AS tip, any_value(pre) AS pre, any_value(span) AS span, max(CASE WHEN pos = pre THEN total END) AS base FROM t GROUP BY branch),
f AS (SELECT b.branch, max(pos) AS fit FROM t JOIN b ON b.branch = t.branch AND pos > b.pre AND total <= coalesce(base, 0) + 300 GROUP BY b.branch),
c AS (SELECT b.branch, fit, unnest([pre + 1] || list_transform([1, 2, 4, 8], lambda x: least(tip, pre + 1 + greatest(CASE WHEN span > 0 THEN span - 1 ELSE tip - pre - 1 END, 0) // x))) AS probe FROM b JOIN f USING (branch) WHERE pre < tip)
SELECT branch, coalesce(max(fit), -1) AS pos, CAST(coalesce(max(CASE WHEN probe <= fit THEN probe END), -1) AS BIGINT) AS sampled FROM b LEFT JOIN c USING (branch) GROUP BY branch""")
def under_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    chain = D.sized_chain(spark, sf_dir)
    state = chain.select("branch").distinct().select("branch", (F.col("branch") % 4 - 1).alias("at"), (F.col("branch") % 6).alias("span"))
    return chains.under_limit(chain, state, 300)


# Where to resume
@query(f"WITH {CHAIN} SELECT branch, CAST(max(CASE WHEN pos % 4 = 0 THEN pos + 1 END) AS BIGINT) AS resume_at FROM o GROUP BY branch")
def resume_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    chain = D.first_parents(spark, sf_dir)
    return chains.resume_positions(chain, chain.where("pos % 4 = 0").select("branch", "hash"))


# Finished checkpoints as haves
@query(f"WITH {EVEN} SELECT branch || '-have-' || pos AS ref, hash FROM even_")
def checkpoint_haves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chains.checkpoint_haves(_even(spark, sf_dir))


# Haves by name and by hash
@query(f"WITH {SNAPSHOTS} SELECT ref, hash FROM src WHERE ref LIKE 'refs/heads/%' UNION ALL SELECT 'refs/haves/' || o_orderkey, {HASH} FROM orders")
def have_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = D.source_refs(spark, sf_dir)
    names = source.where(F.col("ref").startswith("refs/heads/")).select(R.have_ref(R.short_name(F.col("ref"))).alias("ref"))
    return chains.have_set(D.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("at"), D.order_hash().alias("hash")), names, source)


# Branches that were only staged
@query(f"""WITH {SNAPSHOTS} SELECT t.ref, CASE WHEN t.ref LIKE 'refs/heads/%' AND length(t.ref) % 2 = 0 AND t.hash = s.hash THEN NULL ELSE t.hash END AS hash FROM tgt t LEFT JOIN src s ON s.ref = t.ref""")
def unfinished_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    desired = _desired(spark, sf_dir)
    staged = desired.where("length(target_ref) % 2 = 0").select("target_ref", F.col("source_hash").alias("hash"))
    return chains.unfinished_targets(desired, D.target_refs(spark, sf_dir), staged)


# Budgets over attempts
@query("""WITH a AS (SELECT user_id AS run, event_id AS attempt, CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 3 = 0 THEN event_id % 900 + 1 WHEN event_id % 500 > 0 THEN event_id % 500 END AS c FROM events)
SELECT run, attempt, CAST(coalesce(min(c) OVER (PARTITION BY run ORDER BY attempt), 0) AS BIGINT) AS budget FROM a""")
def budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    rows = D.table(spark, sf_dir, "events").select(F.col("user_id").alias("run"), e.alias("attempt"), F.when(e % 3 == 0, e % 900 + 1).otherwise(0).alias("announced"), (e % 500).alias("sent"), (e % 7 == 0).alias("stopped"))
    return chains.budgets(rows)


# A4: per-service statistics
@query("""SELECT event_type AS name, count(*) AS requests, CAST(sum(CASE WHEN event_id % 13 = 0 THEN 0 ELSE event_id % 1000 END) AS BIGINT) AS request_bytes, CAST(sum(event_id * 7 % 5000) AS BIGINT) AS response_bytes FROM events GROUP BY 1""")
def service_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transfer.service_stats(D.service_log(spark, sf_dir))


# Per-side totals, spans and average rates
@query("""WITH b AS (SELECT min(epoch_us(ts)) + 3600000000 AS s, max(epoch_us(ts)) - 3600000000 AS n FROM events), g AS (SELECT event_type AS label, CAST(sum(event_id % 1000) AS BIGINT) AS bytes, max(CASE WHEN event_id % 1000 > 0 THEN epoch_us(ts) END) AS l FROM events GROUP BY 1),
r AS (SELECT label, bytes, CAST(greatest(l - s, 0) AS BIGINT) AS active_us, CAST(greatest(n - l, 0) AS BIGINT) AS idle_us FROM g, b)
SELECT *, CASE WHEN active_us >= 50000 AND bytes > 0 THEN CAST(bytes AS DOUBLE) / (CAST(active_us AS DOUBLE) / 1e6) ELSE 0.0 END AS rate FROM r""")
def side_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = D.transfer_log(spark, sf_dir)
    bounds = log.agg((F.min("at_us") + 3_600_000_000).alias("s"), (F.max("at_us") - 3_600_000_000).alias("n")).first()
    sides = transfer.side_stats(log, F.lit(bounds.s), F.lit(bounds.n))
    return sides.join(transfer.average_rates(sides), "label")


SAMPLES = "s AS (SELECT event_type AS label, epoch_us(ts) AS at_us, CAST(sum(event_id % 1000) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total FROM events)"


# Rates over the last ten samples
@query(f"""WITH {SAMPLES}, w AS (SELECT *, at_us - first_value(at_us) OVER r AS d, total - first_value(total) OVER r AS b, count(*) OVER r AS n FROM s WINDOW r AS (PARTITION BY label ORDER BY at_us, total ROWS 9 PRECEDING))
SELECT label, at_us, total, CASE WHEN n >= 2 AND d >= 50000 AND b > 0 THEN CAST(b AS DOUBLE) / (CAST(d AS DOUBLE) / 1e6) ELSE 0.0 END AS rate FROM w""")
def instant_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transfer.instant_rates(D.rate_samples(spark, sf_dir))


# T4: idle marks
@query(f"WITH {SAMPLES}, w AS (SELECT *, lead(at_us) OVER (PARTITION BY label ORDER BY at_us, total) - at_us AS gap FROM s) SELECT label, at_us, total, gap IS NULL OR gap >= 750000 AS done FROM w")
def idle_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transfer.idle_marks(D.rate_samples(spark, sf_dir))


# A10: peaks and growth
@query("""SELECT user_id AS run, max(event_id) - min(event_id) AS elapsed_us, max(event_id % 997) AS peak_alloc, max(event_id % 499) AS peak_heap, CAST(arg_max(event_id * 3, event_id) - arg_min(event_id * 3, event_id) AS BIGINT) AS total_alloc,
CAST(arg_max(event_id // 100, event_id) - arg_min(event_id // 100, event_id) AS BIGINT) AS gc FROM events GROUP BY 1""")
def peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    return transfer.peaks(D.table(spark, sf_dir, "events").select(F.col("user_id").alias("run"), e.alias("at_us"), (e % 997).alias("alloc"), (e % 499).alias("heap"), (e * 3).alias("total_alloc"), F.floor(e / 100).alias("gc")))


# Benchmark summary
@query("""WITH d AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n, max(event_id) AS pa, max(event_id % 1000) AS ph, CAST(sum(event_id % 100) AS BIGINT) AS ta FROM events GROUP BY 1),
r AS (SELECT *, day(day) % 10 <> 3 AS ok, day(day) % 10 <> 3 AND day(day) % 2 = 0 AS b, n % 5 + 1 AS bc, n % 4 + 1 AS pl, CASE WHEN day(day) % 3 = 0 THEN 'relay' WHEN day(day) % 3 = 1 THEN 'batch' END AS mode FROM d)
SELECT count(*) AS runs, count(*) FILTER (ok) AS ok_runs, count(*) FILTER (NOT ok) AS failed_runs, count(*) FILTER (b) AS batched_runs,
coalesce(min(n) FILTER (ok), 0) AS min_wall_ms, coalesce(max(n) FILTER (ok), 0) AS max_wall_ms, coalesce(CAST(sum(n) FILTER (ok) AS DOUBLE) / nullif(count(*) FILTER (ok), 0), 0) AS avg_wall_ms,
coalesce(min(n - 1) FILTER (ok), 0) AS min_elapsed_ms, coalesce(max(n - 1) FILTER (ok), 0) AS max_elapsed_ms, coalesce(CAST(sum(n - 1) FILTER (ok) AS DOUBLE) / nullif(count(*) FILTER (ok), 0), 0) AS avg_elapsed_ms,
coalesce(min(bc) FILTER (b), 0) AS min_batch_count, coalesce(max(bc) FILTER (b), 0) AS max_batch_count, coalesce(CAST(sum(bc) FILTER (b) AS DOUBLE) / nullif(count(*) FILTER (b), 0), 0) AS avg_batch_count,
coalesce(min(pl) FILTER (b), 0) AS min_planned, coalesce(max(pl) FILTER (b), 0) AS max_planned, coalesce(CAST(sum(pl) FILTER (b) AS DOUBLE) / nullif(count(*) FILTER (b), 0), 0) AS avg_planned,
coalesce(max(pa) FILTER (ok), 0) AS max_peak_alloc, coalesce(max(ph) FILTER (ok), 0) AS max_peak_heap, coalesce(max(ta) FILTER (ok), 0) AS max_total_alloc, coalesce(max(n % 7) FILTER (ok), 0) AS max_gc,
coalesce(string_agg(DISTINCT mode, ',' ORDER BY mode) FILTER (ok AND mode IS NOT NULL), '') AS relay_modes FROM r""")
def bench_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transfer.bench_summary(D.bench_runs(spark, sf_dir))


# Objects by type
@query("SELECT CASE o_orderkey % 4 WHEN 0 THEN 'blob' WHEN 1 THEN 'tree' WHEN 2 THEN 'commit' ELSE 'tag' END AS type, count(*) + CAST(coalesce(sum((o_orderkey % 10 = 2 AND o_orderkey % 4 = 2)::INT), 0) AS BIGINT) + CASE WHEN o_orderkey % 4 = 2 THEN (SELECT count(*) FROM orders WHERE o_orderkey % 10 = 2 AND o_orderkey % 4 <> 2) ELSE 0 END AS objects FROM orders GROUP BY o_orderkey % 4")
def type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transfer.type_counts(D.objects(spark, sf_dir))


# Distinct hashes in order
@query(f"WITH {SNAPSHOTS}, h AS (SELECT hash FROM src UNION SELECT hash FROM tgt) SELECT hash, CAST(row_number() OVER (ORDER BY hash) - 1 AS BIGINT) AS pos FROM h")
def distinct_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = D.source_refs(spark, sf_dir).select("hash").unionByName(D.target_refs(spark, sf_dir).select("hash")).distinct()
    return A.positions(both, ["hash"])


# Content hashes of blobs
@query("""SELECT DISTINCT sha1(CAST('blob ' || octet_length(encode(text)) || chr(0) || text AS VARCHAR)) AS sha1, sha256('blob ' || octet_length(encode(text)) || chr(0) || text) AS sha256, 'blob' AS type FROM documents""")
def hash_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversion.hash_mapping(D.table(spark, sf_dir, "documents").select(F.lit("blob").alias("type"), F.col("text").alias("body")))


OBJECTS = f"""obj AS (SELECT {HASH} AS hash, CASE o_orderkey % 4 WHEN 0 THEN 'blob' WHEN 1 THEN 'tree' WHEN 2 THEN 'commit' ELSE 'tag' END AS type FROM orders
UNION ALL SELECT left({HASH}, 10) || left(sha1('x:' || o_orderstatus || o_orderkey), 30), 'commit' FROM orders WHERE o_orderkey % 10 = 2)"""
MESSAGES = f"msg AS (SELECT doc_id AS id, text || coalesce(' see ' || left({HASH}, CAST(7 + doc_id % 34 AS INTEGER)) || '.', '') AS message FROM documents LEFT JOIN orders ON o_orderkey = doc_id)"
RUNS = f"{MESSAGES}, runs AS (SELECT id, unnest(regexp_extract_all(message, '(?i)\\b[0-9a-f]{{7,40}}\\b')) AS prefix FROM msg)"
VERDICTS = f"{RUNS}, p AS (SELECT DISTINCT lower(prefix) AS prefix FROM runs), {OBJECTS}, v AS (SELECT p.prefix, count(DISTINCT hash) AS n, min(hash) AS hash FROM p LEFT JOIN (SELECT DISTINCT hash FROM obj WHERE type IN ('commit', 'tag')) k ON starts_with(k.hash, p.prefix) GROUP BY 1)"


# Prefixes looked up in an index of the hashes, by ranges
@query(f"WITH {VERDICTS} SELECT prefix, CASE WHEN n = 0 THEN 'none' WHEN n = 1 THEN 'unique' ELSE 'ambiguous' END AS verdict, CASE WHEN n = 1 THEN hash END AS hash FROM v")
def indexed_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = D.objects(spark, sf_dir).where("type in ('commit', 'tag')")
    return PrefixIndex(known, 16).resolve(conversion.message_prefixes(D.messages(spark, sf_dir)).select("prefix"))


# Prefixes in messages and what they name
@query(f"WITH {VERDICTS} SELECT prefix, CASE WHEN n = 0 THEN 'none' WHEN n = 1 THEN 'unique' ELSE 'ambiguous' END AS verdict, CASE WHEN n = 1 THEN hash END AS hash FROM v")
def resolve_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversion.resolve_prefixes(conversion.message_prefixes(D.messages(spark, sf_dir)), D.objects(spark, sf_dir))


# Rewritten messages (no SQL; tested against a plain rewrite)
@query()
def rewrite_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    objects = D.objects(spark, sf_dir)
    mapping = objects.select(F.col("hash").alias("sha1"), F.sha2("hash", 256).alias("sha256")).distinct()
    return conversion.rewrite_messages(D.messages(spark, sf_dir), objects, mapping)


# Ambiguous references
@query(f"WITH {VERDICTS} SELECT prefix FROM v WHERE n > 1")
def ambiguous_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversion.ambiguous_prefixes(D.messages(spark, sf_dir), D.objects(spark, sf_dir))


# A whole object graph rehashed (no SQL; tested against a walker)
@query()
def convert_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversion.convert_objects(*D.object_store(spark, sf_dir))


MAPPED = f"{DESIRED}, map AS (SELECT {HASH} AS sha1, sha256({HASH}) AS sha256 FROM orders)"


def _mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.table(spark, sf_dir, "orders").select(D.order_hash().alias("sha1"), F.sha2(D.order_hash(), 256).alias("sha256"), F.when(F.col("o_orderkey") % 2 == 0, "commit").otherwise("tag").alias("type"))


# Refs at their new hashes
@query(f"WITH {MAPPED} SELECT target_ref AS ref, sha256 AS hash FROM des JOIN map ON sha1 = source_hash")
def written_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversion.written_refs(_desired(spark, sf_dir), _mapping(spark, sf_dir))


# Do the written refs stand
@query(f"WITH {MAPPED} SELECT count(*) AS expected, count(*) FILTER (NOT ends_with(target_ref, '7')) AS resolved, min(target_ref) FILTER (ends_with(target_ref, '7')) AS first_missing FROM des")
def ref_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    desired, mapping = _desired(spark, sf_dir), _mapping(spark, sf_dir)
    return conversion.ref_check(desired, mapping, conversion.written_refs(desired, mapping).where(~F.col("ref").endswith("7")))


# Does HEAD stand
@query(f"WITH {MAPPED} SELECT 'refs/heads/3' AS head, min(sha256) AS hash, count(*) > 0 AS stands FROM des JOIN map ON sha1 = source_hash WHERE target_ref = 'refs/heads/3'")
def head_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = spark.createDataFrame([("refs/heads/3",)], "head string")
    return conversion.head_check(head, conversion.written_refs(_desired(spark, sf_dir), _mapping(spark, sf_dir)))


# K5: the lines of the mapping file
@query(f"WITH m AS (SELECT {HASH} AS sha1, sha256({HASH}) AS sha256 FROM orders) SELECT row_number() OVER (ORDER BY sha1) AS pos, sha1 || chr(9) || sha256 AS line FROM m UNION ALL SELECT 0, '# sha1' || chr(9) || 'sha256'")
def mapping_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversion.mapping_lines(_mapping(spark, sf_dir))


# K6: the trees of the notes, in directories of two digits; the root by its entries in order
@query(f"""WITH n AS (SELECT sha256({HASH}) AS path, sha256('blob 41' || chr(0) || {HASH} || chr(10)) AS blob FROM orders WHERE o_orderkey % 2 = 0),
e AS (SELECT left(path, 2) AS path, substr(path, 3) AS name, hex(encode('100644 ' || substr(path, 3))) || '00' || upper(blob) AS entry FROM n),
b AS (SELECT path, string_agg(entry, '' ORDER BY name) AS body, count(*) AS entries FROM e GROUP BY path),
l AS (SELECT path, sha256(unhex(hex(encode('tree ' || length(body) // 2)) || '00' || body)) AS hash, entries FROM b),
r AS (SELECT string_agg(hex(encode('40000 ' || path)) || '00' || upper(hash), '' ORDER BY path) AS body, count(*) AS entries FROM l)
SELECT * FROM l UNION ALL SELECT '', sha256(unhex(hex(encode('tree ' || length(body) // 2)) || '00' || body)), entries FROM r""")
def notes_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversion.notes_tree(conversion.origin_notes(_mapping(spark, sf_dir)), 1)


# K6: notes with the old hashes
@query(f"SELECT sha256({HASH}) AS path, {HASH} || chr(10) AS body FROM orders WHERE o_orderkey % 2 = 0")
def origin_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversion.origin_notes(_mapping(spark, sf_dir))


# Signatures stripped
@query("SELECT o_orderkey AS id, o_orderpriority AS author, CAST((o_orderkey % 2 = 0)::INT + o_orderkey % 3 AS BIGINT) AS stripped FROM orders")
def strip_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    header = lambda key, value: F.struct(F.lit(key).alias("key"), value.alias("value"))
    signed = F.when(k % 2 == 0, F.array(header("gpgsig", F.lit("s")), header("gpgsig-sha256", F.lit("t")))).otherwise(F.array())
    entries = F.concat(signed, F.array_repeat(header("mergetag", F.lit("m")), (k % 3).cast("int")), F.array(header("author", F.col("o_orderpriority"))))
    found = conversion.strip_signatures(D.table(spark, sf_dir, "orders").select(k.alias("id"), entries.alias("headers")))
    return found.select("id", F.col("headers")[0]["value"].alias("author"), "stripped")


# names against a table of prefixes and names
@query(f"""WITH {SNAPSHOTS}, p AS (SELECT ' refs/heads/' || c_custkey || ' ' AS prefix FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT ' ' UNION ALL SELECT 'refs/notes/1'),
x AS (SELECT {KEY_REF} AS ref FROM orders WHERE o_orderkey % 13 = 0)
SELECT ref, EXISTS (SELECT 1 FROM p WHERE trim(prefix) <> '' AND starts_with(src.ref, trim(prefix))) OR ref IN (SELECT ref FROM x) AS excluded FROM src""")
def excluded_by_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    prefixes = D.table(spark, sf_dir, "customer").where("c_custkey % 3 = 0").select(F.concat(F.lit(" refs/heads/"), F.col("c_custkey").cast("string"), F.lit(" ")).alias("prefix"))
    prefixes = prefixes.unionByName(spark.createDataFrame([(" ",), ("refs/notes/1",)], "prefix string"))
    exact = D.table(spark, sf_dir, "orders").where("o_orderkey % 13 = 0").select(D.order_ref().alias("ref"))
    return excluded_by(D.source_refs(spark, sf_dir).select("ref"), prefixes, exact)


# exclusions that would hide branches or tags
@query(f"""WITH x AS (SELECT o_orderkey AS "at", ' ' || left({KEY_REF}, CAST(o_orderkey % 13 AS INTEGER)) AS prefix FROM orders),
h AS (SELECT *, trim(prefix) AS name FROM x) SELECT min("at") AS "at", arg_min(prefix, "at") AS prefix FROM h
WHERE starts_with(name, 'refs/heads/') OR starts_with('refs/heads/', name) OR starts_with(name, 'refs/tags/') OR starts_with('refs/tags/', name) GROUP BY name""")
def overlapping_excludes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    prefix = F.concat(F.lit(" "), F.left(D.order_ref(), (k % 13).cast("int")))
    return A.overlapping_excludes(D.table(spark, sf_dir, "orders").select(k.alias("at"), prefix.alias("prefix")))


# names that side outputs would overwrite
@query(f"WITH {DESIRED} SELECT target_ref FROM des WHERE target_ref IN ('refs/notes/2', 'refs/notes/5', 'refs/notes/origin')")
def name_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversion.name_collisions(_desired(spark, sf_dir), ["refs/notes/2", "refs/notes/5", "refs/notes/origin"])


# Preview of a list
@query(f"WITH {SNAPSHOTS} SELECT (SELECT string_agg(ref, ', ' ORDER BY ref) FROM (SELECT DISTINCT ref FROM src ORDER BY ref LIMIT 5)) || ' (' || (count(DISTINCT ref) - 5) || ' more)' AS preview FROM src")
def list_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversion.listed(D.source_refs(spark, sf_dir).select(F.col("ref").alias("name")))


# Listing lines
@query(f"""WITH {SNAPSHOTS}, n AS (SELECT ref, hash, length(ref) AS l FROM src) SELECT ref, hash, CAST(NULL AS VARCHAR) AS head_target FROM n WHERE ref NOT LIKE '%17'
UNION ALL SELECT 'HEAD', NULL, 'refs/heads/3'""")
def listed_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    ref = F.col("ref")
    line = F.when(ref.endswith("17"), F.concat(F.lit("unborn "), ref)).when(ref.startswith("refs/tags/"), F.concat("hash", F.lit("  "), ref, F.lit(" peeled:"), "hash", F.lit("\n"))).otherwise(F.concat("hash", F.lit(" "), ref))
    lines = D.source_refs(spark, sf_dir).select(line.alias("line"))
    return P.listed_refs(lines.unionByName(spark.createDataFrame([("0123 HEAD symref-target:refs/heads/3",)], "line string")))


# Older advertisements, peeled tags dropped, last write wins
@query(f"WITH {SNAPSHOTS} SELECT coalesce(t.ref, s.ref) AS ref, coalesce(t.hash, s.hash) AS hash FROM src s FULL JOIN tgt t ON t.ref = s.ref")
def advertised_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, second = D.source_refs(spark, sf_dir).withColumn("at", F.lit(1)), D.target_refs(spark, sf_dir).withColumn("at", F.lit(2))
    peeled = first.select(F.concat("ref", F.lit("^{}")).alias("ref"), F.lit("0").alias("hash"), F.lit(3).alias("at"))
    return P.advertised_refs(first.unionByName(second).unionByName(peeled))


# Only hash refs, the last of each name
@query(f"WITH {SNAPSHOTS} SELECT ref, hash FROM src WHERE ref NOT LIKE 'refs/notes/%'")
def last_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = D.source_refs(spark, sf_dir).withColumn("kind", F.when(F.col("ref").startswith("refs/notes/"), "symbolic").otherwise("hash"))
    return P.last_write(rows.withColumn("at", F.lit(2)).unionByName(rows.withColumn("hash", F.lit("old")).withColumn("at", F.lit(1))))


# The advertised head
@query("SELECT 'refs/heads/' || min(event_id) AS head FROM events WHERE event_id % 3 = 1")
def advertised_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    value = F.concat(F.when(e % 3 == 1, "HEAD:refs/heads/").otherwise("refs/x:refs/heads/"), e.cast("string"))
    return P.advertised_head(D.table(spark, sf_dir, "events").select(e.alias("at"), value.alias("value")))


# Capability lists
@query("""SELECT event_id, 'x=' || event_id AS agent, CAST(3 + (event_id % 2 = 0)::INT AS INTEGER) AS n, event_id % 3 = 0 AS filter, event_id % 2 = 0 AS server_option, CASE event_id % 3 WHEN 0 THEN 'side-band-64k' WHEN 1 THEN 'side-band' ELSE '' END AS sideband,
event_id % 5 = 0 AS no_thin, 'agent,fetch,object-format' || CASE WHEN event_id % 2 = 0 THEN ',server-option' ELSE '' END AS names FROM events""")
def capabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    text = F.concat(F.lit("agent=old\nagent=x="), e.cast("string"), F.lit("\nfetch=shallow"), F.when(e % 3 == 0, " filter").otherwise(" wait-for-done"), F.lit("\nobject-format=sha1\n"), F.when(e % 2 == 0, "server-option\n").otherwise(""))
    names = F.array_compact(F.array(F.when(e % 3 != 2, "side-band"), F.when(e % 3 == 0, "side-band-64k"), F.when(e % 5 == 0, "no-thin")))
    rows = D.table(spark, sf_dir, "events").select("event_id", P.capability_map(text).alias("c"), names.alias("names"))
    flags = P.target_features(rows.select(F.col("event_id").alias("target"), "names")).select(F.col("target").alias("event_id"), "no_thin")
    c = F.col("c")
    found = rows.select("event_id", c["agent"].alias("agent"), F.size(c).alias("n"), P.fetch_supports(c, "filter").alias("filter"), P.supports(c, "server-option").alias("server_option"), P.preferred_sideband(F.col("names")).alias("sideband"), F.array_join(F.array_sort(F.map_keys(c)), ",").alias("names"))
    return found.join(flags, "event_id")


# Parents in commit bodies
@query(f"""SELECT o_orderkey, CASE o_orderkey % 6 WHEN 2 THEN {HASH} WHEN 3 THEN {HASH} || ',' || sha1('p' || o_orderkey) WHEN 5 THEN {HASH} ELSE '' END AS parents FROM orders""")
def commit_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, h = F.col("o_orderkey"), D.order_hash()
    tree, author = F.concat(F.lit("tree "), h, F.lit("\n")), F.lit("author a\n\nparent of all")
    one = F.concat(F.lit("parent "), h, F.lit("\n"))
    two = F.concat(one, F.lit("parent "), F.sha1(F.concat(F.lit("p"), k.cast("string")).cast("binary")), F.lit("\n"))
    body = F.when(k % 6 == 0, F.concat(one, tree)).when(k % 6 == 1, F.concat(tree, author)).when(k % 6 == 2, F.concat(tree, one, author)).when(k % 6 == 3, F.concat(tree, two, author))
    body = body.when(k % 6 == 4, F.concat(tree, F.lit("author a\n"), one)).otherwise(F.concat(tree, one, F.lit("parent 12\n"), two))
    return D.table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(P.commit_parents(body), ",").alias("parents"))


# Object counts in pack headers, which hold 32 bits
@query("SELECT event_id, event_id * 65537 % 4294967296 AS objects FROM events")
def header_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    header = F.concat(F.lit(b"PACK\x00\x00\x00\x02"), F.unhex(F.right(F.lpad(F.hex(F.col("event_id") * 65537), 16, "0"), F.lit(8))))
    return D.table(spark, sf_dir, "events").select("event_id", R.header_count(header).alias("objects"))


def _human(x: str) -> str:
    """SQL for `human_bytes`, up to gigabytes."""
    digits = lambda v: f"CASE WHEN {v} >= 100 THEN printf('%.0f', {v}) WHEN {v} >= 10 THEN printf('%.1f', {v}) ELSE printf('%.2f', {v}) END"
    steps = " ".join(f"WHEN {x} < {1024 ** (k + 1)} THEN {digits(f'(CAST({x} AS DOUBLE) / {1024**k}.0::DOUBLE)')} || ' {u}'" for k, u in enumerate(("KB", "MB", "GB"), 1))
    return f"CASE WHEN {x} < 1024 THEN {x} || ' B' {steps} END"


# Progress lines
@query(f"""WITH g AS (SELECT event_type AS label, CAST(sum(event_id % 1000) AS BIGINT) AS bytes, CAST(count(*) * 7919 AS BIGINT) AS active_us, CAST(count(*) % 2 * 1000000 AS BIGINT) AS idle_us FROM events GROUP BY 1),
r AS (SELECT *, CASE WHEN idle_us >= 750000 THEN CAST(trunc(CAST(bytes AS DOUBLE) / (CAST(active_us AS DOUBLE) / 1e6)) AS BIGINT) ELSE bytes // 3 END AS speed FROM g)
SELECT label, left('cache-node-17.' || label || '.eu.example-cdn.com', 14) || '…example-cdn.com: ' || {_human('bytes')} || ' @ ' || {_human('speed')} || '/s' || CASE WHEN idle_us >= 750000 THEN ' ✓' ELSE '' END AS line FROM r""")
def side_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = D.transfer_log(spark, sf_dir).groupBy("label").agg(F.sum("bytes").alias("bytes"), (F.count("*") * 7919).alias("active_us"), (F.count("*") % 2 * 1_000_000).alias("idle_us"))
    g = g.withColumn("display", F.concat(F.lit("cache-node-17."), "label", F.lit(".eu.example-cdn.com")))
    return transfer.side_lines(g.withColumn("instant", F.call_function("div", F.col("bytes"), F.lit(3).cast("long"))), 1)


# Checker reports, and epochs in text
@query("""SELECT event_id, event_id % 6 IN (0, 1, 2, 3) AS damaged, CAST(CASE WHEN event_id % 4 = 0 THEN 0 ELSE event_id END AS BIGINT) AS epoch FROM events""")
def checker_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    report = F.when(e % 6 == 0, "ok\n  ERROR: x").when(e % 6 == 1, "fatalInTree: y").when(e % 6 == 2, "missing blob 12\n").when(e % 6 == 3, "notice\n\tbroken link from a").when(e % 6 == 4, "dangling commit\nwarning: bad date").otherwise("")
    time = R.epoch_time(F.when(e % 8 == 0, "").when(e % 4 == 0, "soon").otherwise(e.cast("string")))
    return D.table(spark, sf_dir, "events").select("event_id", R.report_has_error(report).alias("damaged"), F.unix_seconds(time).alias("epoch"))


# Per-side totals as a stream (Spark capability)
@query("SELECT event_type AS label, CAST(sum(event_id % 1000) AS BIGINT) AS bytes, count(*) AS samples FROM events GROUP BY 1")
def stream_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    from .streaming.transfer import run_to_table, stream_side_totals

    batch = spark.read.parquet(f"{sf_dir}/events.parquet")
    log = spark.readStream.schema(batch.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    rows = log.select(F.col("event_type").alias("label"), (F.col("event_id") % 1000).alias("bytes"))
    return run_to_table(stream_side_totals(rows), f"totals_{uuid.uuid4().hex}")


FAST = "f AS (SELECT event_type AS label, event_id, epoch_us(ts) // 1000 AS at_us, event_id % 1000 AS bytes FROM events)"
#: Watermark of the streams below at the end: ten seconds behind the newest sample, in whole milliseconds.
MARK = "m AS (SELECT max(at_us) // 1000 * 1000 - 10000000 AS mark FROM f)"


# Rates over two seconds, every 200 ms, as a stream that starts anew three times (Spark capability)
@query(f"""WITH {FAST}, {MARK}, w AS (SELECT label, (at_us // 200000 - k) * 200000 AS begin_us, bytes FROM f, range(10) r(k))
SELECT label, begin_us, CAST(sum(bytes) AS BIGINT) AS bytes, count(*) AS samples, CAST(sum(bytes) AS DOUBLE) / 2 AS rate FROM w, m WHERE begin_us + 2000000 <= mark GROUP BY label, begin_us""")
def stream_sliding_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .streaming.transfer import replay, sliding_totals

    sink = replay(D.fast_log(spark, sf_dir), "at_us", 4, lambda log: sliding_totals(D.timed(log)), "sliding", "append")
    rows = sink.read("label string, begin timestamp, bytes long, samples long")
    return rows.select("label", F.unix_micros("begin").alias("begin_us"), "bytes", "samples", (F.col("bytes").cast("double") / 2).alias("rate"))


# T4: spans without a pause of 750 ms, merged over micro-batches (Spark capability)
@query(f"""WITH {FAST}, {MARK}, g AS (SELECT *, CASE WHEN at_us - lag(at_us) OVER w < 750000 THEN 0 ELSE 1 END AS new FROM f WINDOW w AS (PARTITION BY label ORDER BY at_us)),
s AS (SELECT *, sum(new) OVER (PARTITION BY label ORDER BY at_us ROWS UNBOUNDED PRECEDING) AS k FROM g),
e AS (SELECT label, min(at_us) AS begin_us, max(at_us) AS last_us, CAST(sum(bytes) AS BIGINT) AS bytes, count(*) AS samples FROM s GROUP BY label, k)
SELECT e.* FROM e, m WHERE last_us + 749999 <= mark""")
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .streaming.transfer import active_sessions, replay

    sink = replay(D.fast_log(spark, sf_dir), "at_us", 4, lambda log: active_sessions(D.timed(log)), "sessions", "append")
    rows = sink.read("label string, begin timestamp, last timestamp, bytes long, samples long")
    return rows.select("label", F.unix_micros("begin").alias("begin_us"), F.unix_micros("last").alias("last_us"), "bytes", "samples")


# Counters that stop an upload in mid-stream, with state over restarts (Spark capability)
@query("""WITH f AS (SELECT event_type AS label, event_id, epoch_us(ts) // 1000 AS at_us, CASE WHEN event_type = 'error' THEN 10 ELSE 100 END * (event_id % 1000) AS bytes, event_id % 5 AS objects, 450 * length(event_type) AS total FROM events),
c AS (SELECT *, sum(bytes) OVER w AS sent, sum(objects) OVER w AS seen, row_number() OVER w AS k FROM f WINDOW w AS (PARTITION BY label ORDER BY at_us, event_id ROWS UNBOUNDED PRECEDING)),
s AS (SELECT label, max(k) AS last, min(CASE WHEN sent >= 57000000 OR (sent >= 8388608 AND seen > 0 AND sent * total // seen > 57000000) THEN k END) AS stop FROM c GROUP BY label)
SELECT label, CAST(sent AS BIGINT) AS bytes, CAST(seen AS BIGINT) AS objects, CASE WHEN stop IS NULL THEN -1 ELSE at_us END AS stopped_at, CASE WHEN stop IS NULL THEN -1 ELSE event_id END AS stopped_event FROM c JOIN s USING (label) WHERE k = coalesce(stop, last)""")
def stream_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .streaming.counters import COUNTERS, upload_counters
    from .streaming.sink import ROCKS
    from .streaming.transfer import replay

    e, label = F.col("event_id"), F.col("label")
    log = D.fast_log(spark, sf_dir).select("label", "at_us", "event_id", (F.when(label == "error", 10).otherwise(100) * F.col("bytes")).alias("bytes"), (e % 5).alias("objects"), (450 * F.length(label)).cast("long").alias("total"))
    sink = replay(log, "at_us", 4, lambda rows: upload_counters(rows, 60_000_000), "counters", "update", ROCKS)
    none = F.lit(-1).cast("long")
    return sink.latest(COUNTERS, ["label"]).select("label", "bytes", "objects", F.coalesce("stopped_at", none).alias("stopped_at"), F.coalesce("stopped_event", none).alias("stopped_event"))


# T5: totals through a sink whose batches count once, over restarts (Spark capability)
@query("SELECT event_type AS label, CAST(sum(event_id % 1000) AS BIGINT) AS bytes, count(*) AS samples FROM events GROUP BY 1")
def stream_resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .streaming.transfer import replay, stream_side_totals

    sink = replay(D.fast_log(spark, sf_dir), "at_us", 4, stream_side_totals, "totals", "update")
    return sink.latest("label string, bytes long, samples long", ["label"])
