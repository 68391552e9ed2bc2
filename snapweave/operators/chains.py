"""Checkpoints and chunks of ordered chains: frames (branch, pos, hash), pos from 0 to the tip."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.actions import positions
from ..storage import Scratch


def even_checkpoints(chain: DataFrame, batches: DataFrame) -> DataFrame:
    """(branch, pos, hash) of checkpoints that cut every branch into its number of `batches` (branch, n); the tip is one.

    With as many batches as commits, or one, there is only the tip.
    """
    sizes = chain.groupBy("branch").agg(F.count("*").alias("size")).join(batches, "branch")
    rows = chain.join(sizes, "branch")
    step = F.call_function("div", F.col("size"), F.greatest(F.col("n").cast("long"), F.lit(1).cast("long")))
    tip = F.col("pos") == F.col("size") - 1
    cut = (F.col("n") > 1) & (F.col("n") < F.col("size")) & ((F.col("pos") + 1) % step == 0) & (F.call_function("div", F.col("pos") + 1, step) < F.col("n"))
    return rows.where(tip | cut).select("branch", "pos", "hash")


def _begin(chain: DataFrame, checkpoints: DataFrame, current: DataFrame | None) -> DataFrame:
    """(branch, at): where each branch stands; null where its chain doesn't hold its hash."""
    begin = checkpoints.select("branch").distinct()
    if current is None:
        return begin.withColumn("at", F.lit(-1).cast("long"))
    found = current.join(chain.select("branch", "hash", F.col("pos").alias("at")), ["branch", "hash"], "left").select("branch", "at", F.lit(True).alias("given"))
    return begin.join(found, "branch", "left").select("branch", F.when(F.col("given").isNull(), F.lit(-1).cast("long")).otherwise(F.col("at")).alias("at"))


def _gaps(checkpoints: DataFrame, begin: DataFrame) -> DataFrame:
    """(branch, pos, at, prev): every checkpoint with the one before it, or where its branch stands."""
    order = Window.partitionBy("branch").orderBy("pos")
    return checkpoints.select("branch", "pos").join(begin, "branch").withColumn("prev", F.coalesce(F.lag("pos").over(order), F.col("at")))


def subdivided(chain: DataFrame, checkpoints: DataFrame, current: DataFrame | None = None) -> DataFrame:
    """The checkpoints (branch, pos) with the middle of every gap of more than one added.

    `current` (branch, hash) is where each branch stands; branches without one begin before pos 0. A
    `current` that its chain doesn't hold leaves the checkpoints of that branch as they are.
    """
    gaps = _gaps(checkpoints, _begin(chain, checkpoints, current))
    middle = F.col("prev") + F.floor((F.col("pos") - F.col("prev")) / 2)
    added = gaps.where((F.col("at").isNotNull()) & (F.col("pos") - F.col("prev") > 1)).select("branch", middle.cast("long").alias("pos"))
    return checkpoints.select("branch", "pos").unionByName(added).join(chain, ["branch", "pos"]).select("branch", "pos", "hash")


#: Halvings that a gap can take: positions are below 2**40.
MOST_HALVINGS = 40


def subdivided_to(chain: DataFrame, checkpoints: DataFrame, least: int, current: DataFrame | None = None) -> DataFrame:
    """Each branch halves its gaps as `subdivided` does, once, and goes on until it has `least` checkpoints or no gap of more than one.

    A gap of g has min(g, 2**k) parts after k rounds, so a branch's rounds follow from sums over its gaps, and a part's
    place from its number's binary digits: no round reads what another has written, and branches stop on their own.
    """
    gaps = _gaps(checkpoints, _begin(chain, checkpoints, current))
    size = F.greatest(F.col("pos") - F.col("prev"), F.lit(1).cast("long"))
    after = F.array(*[F.sum(F.least(size, F.lit(1 << k).cast("long"))) for k in range(MOST_HALVINGS + 1)])
    sums = gaps.where("at is not null").groupBy("branch").agg(after.alias("after"))
    rounds = F.element_at(F.filter(F.sequence(F.lit(1), F.lit(MOST_HALVINGS)), lambda k: (F.get("after", k) >= least) | (F.get("after", k) == F.get("after", F.lit(MOST_HALVINGS)))), 1)
    cut = gaps.join(sums.select("branch", rounds.alias("rounds")), "branch").where(size > 1)
    parts = F.expr("shiftleft(1L, rounds)")
    numbers = F.sequence(F.lit(1).cast("long"), F.least(size, parts) - 1)
    whole = size <= parts  # every position is a checkpoint
    rows = cut.withColumn("number", F.explode(numbers)).withColumn("whole", whole)
    walked = F.expr("""aggregate(sequence(1, rounds), struct(cast(prev as bigint) as low, cast(pos as bigint) as high), (s, k) ->
        if(shiftright(number, rounds - k) % 2 = 1, struct(s.low + (s.high - s.low) div 2 as low, s.high as high), struct(s.low as low, s.low + (s.high - s.low) div 2 as high)), s -> s.low)""")
    added = rows.select("branch", F.when(F.col("whole"), F.col("prev") + F.col("number")).otherwise(walked).cast("long").alias("pos"))
    return checkpoints.select("branch", "pos").unionByName(added).join(chain, ["branch", "pos"]).select("branch", "pos", "hash")


def under_limit(chain: DataFrame, state: DataFrame, limit: int, block: int = 100_000) -> DataFrame:
    """Where each branch of `state` (branch, at, span) can go next with at most `limit` bytes: branch, pos, sampled.

    `chain` is (branch, pos, size), sizes from 0 up; `at` is the last finished position or -1 and `span` the number of commits of the last
    batch or 0. `pos` is the largest position after `at` up to which sizes add up to at most `limit`; `sampled` the first of
    the positions that a search by probes would try (where the last span leads, then half, a quarter and an eighth of
    that, then the next commit) and find to fit. Both are -1 where not even the next commit fits, or none is left. Rows of `state` for branches
    without a chain are -1 too.

    Sums of blocks of positions are formed first; the block of a branch in which its limit is reached follows from these, and only the rows of that
    block, and of the one that `at` is in, are looked at one by one.
    """
    own = F.call_function("div", F.col("pos"), F.lit(block).cast("long"))
    rows = chain.select("branch", F.col("pos").cast("long").alias("pos"), F.col("size").cast("long").alias("size")).withColumn("block", own)
    sums = rows.groupBy("branch", "block").agg(F.sum("size").alias("sum"), F.max("pos").alias("last"))
    order = Window.partitionBy("branch").orderBy("block")
    blocks = Scratch(chain.sparkSession, "under_limit").save(sums.withColumn("before", F.sum("sum").over(order) - F.col("sum")), "blocks")
    asked = state.select("branch", F.col("at").cast("long").alias("at"), F.col("span").cast("long").alias("span"))
    here = asked.where("at >= 0").select("branch", "at", F.call_function("div", F.col("at"), F.lit(block).cast("long")).alias("block"))
    inside = rows.join(here, ["branch", "block"]).where("pos <= at").groupBy("branch").agg(F.sum("size").alias("part"))
    base = here.join(blocks, ["branch", "block"]).join(inside, "branch").select("branch", (F.col("before") + F.col("part")).alias("base"))
    ends = blocks.groupBy("branch").agg(F.max("last").alias("tip"))
    goal = asked.join(ends, "branch", "left").join(base, "branch", "left").withColumn("goal", F.coalesce("base", F.lit(0).cast("long")) + limit)
    reached = blocks.join(goal, "branch").where("before <= goal").groupBy("branch").agg(F.max("block").alias("block"), F.max_by("before", "block").alias("before"), F.max("goal").alias("goal"))
    running = F.sum("size").over(Window.partitionBy("branch").orderBy("pos")) + F.col("before")
    fits = rows.join(reached, ["branch", "block"]).withColumn("total", running).where("total <= goal").groupBy("branch").agg(F.max("pos").alias("fit"))
    found = goal.join(reached.select("branch", (F.col("block") * block - 1).alias("edge")), "branch", "left").join(fits, "branch", "left")
    none, low, tip = F.lit(-1).cast("long"), F.col("at") + 1, F.col("tip")
    best = F.coalesce("fit", "edge", none)
    ahead = F.greatest(F.when(F.col("span") > 0, F.col("span") - 1).otherwise(tip - low), F.lit(0).cast("long"))
    tried = F.array(*[F.least(tip, low + F.shiftright(ahead, k)) for k in range(4)], low)
    some = (low <= tip) & (best >= low)
    return found.select("branch", F.when(some, best).otherwise(none).alias("pos"), F.when(some, F.array_max(F.filter(tried, lambda x: x <= best))).otherwise(none).alias("sampled"))


def resume_positions(chain: DataFrame, done: DataFrame) -> DataFrame:
    """(branch, resume_at): the position after the last finished hash of `done` (branch, hash); 0 if the chain doesn't hold it."""
    found = done.join(chain, ["branch", "hash"], "left")
    return found.groupBy("branch").agg(F.coalesce(F.max("pos") + 1, F.lit(0)).cast("long").alias("resume_at"))


def unfinished_targets(desired: DataFrame, target: DataFrame, staged: DataFrame) -> DataFrame:
    """The target snapshot in which branches that were only staged count as absent.

    `staged` has (target_ref, hash): a branch whose target and staging ref both equal the wanted hash isn't
    cut over yet, and gets a null hash.
    """
    both = desired.where("kind = 'branch'").select("target_ref", "source_hash").join(staged.toDF("target_ref", "staged_hash"), "target_ref")
    both = both.where("staged_hash = source_hash").select(F.col("target_ref").alias("ref"), "source_hash")
    joined = target.join(both, "ref", "left")
    return joined.select("ref", F.when(F.col("source_hash") == F.col("hash"), F.lit(None).cast("string")).otherwise(F.col("hash")).alias("hash"))


def have_set(haves: DataFrame, names: DataFrame, source: DataFrame) -> DataFrame:
    """(ref, hash) of what a target holds: `names` (ref) looked up in the source, hashes `haves` (at, hash) as refs/haves/<at>.

    A name that the source lacks raises while running.
    """
    found = names.join(source, "ref", "left").select("ref", F.when(F.col("hash").isNull(), F.raise_error(F.concat(F.lit("have ref not found: "), "ref"))).otherwise(F.col("hash")).alias("hash"))
    return found.unionByName(haves.select(F.format_string("refs/haves/%d", F.col("at")).alias("ref"), "hash"))


def checkpoint_haves(checkpoints: DataFrame) -> DataFrame:
    """(ref, hash) of finished checkpoints (branch, pos, hash) under generated names; absent hashes are dropped."""
    return checkpoints.where("hash is not null").select(F.format_string("%s-have-%d", F.col("branch").cast("string"), F.col("pos")).alias("ref"), "hash")


def chunked(commands: DataFrame, limit: int = 5000, order: tuple[str, ...] = ("name",)) -> DataFrame:
    """Commands with `chunk`: at most `limit` in each, in the given order."""
    return positions(commands, list(order)).withColumn("chunk", F.call_function("div", F.col("pos"), F.lit(limit).cast("long"))).drop("pos")


def budgets(attempts: DataFrame) -> DataFrame:
    """(run, attempt, budget) after each attempt (run, attempt, announced, sent, stopped): budgets only ever fall.

    An attempt counts by the limit that the server announced, else by what was sent; one that was stopped
    early counts for nothing. No budget yet is 0.
    """
    seen = F.when(F.col("stopped"), None).when(F.col("announced") > 0, F.col("announced")).when(F.col("sent") > 0, F.col("sent"))
    order = Window.partitionBy("run").orderBy("attempt").rowsBetween(Window.unboundedPreceding, 0)
    return attempts.select("run", "attempt", F.coalesce(F.min(seen).over(order), F.lit(0)).cast("long").alias("budget"))
