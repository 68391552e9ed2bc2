"""Integer expressions that size batches of an ordered chain."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes assumed for a commit, bytes sent before a projection counts, per cent of a budget that stops a push, most checkpoints dropped (fixed values).
BYTES_PER_COMMIT = 65_536
LEAST_SENT = 8 << 20
STOP_PERCENT = 95
MOST_DROPPED = 8


def _div(a: Column, b: Column) -> Column:
    """Integer quotient of non-negative longs; null for a zero divisor."""
    return F.call_function("div", a, F.nullif(b, F.lit(0).cast("long")))


def batch_count(chain_length: Column, limit: Column) -> Column:
    """Batches of about `limit` bytes for a chain; 1 when either is not positive."""
    n, most = chain_length.cast("long"), limit.cast("long")
    count = F.greatest(_div(n * BYTES_PER_COMMIT + most - 1, most), F.lit(1).cast("long"))
    return F.when((n <= 0) | (most <= 0), F.lit(1).cast("long")).otherwise(count)


def split_factor(sent: Column, limit: Column) -> Column:
    """Parts that a rejected push is cut into: twice what the bytes sent call for, four times near the limit, 2 at least."""
    sent, limit = sent.cast("long"), limit.cast("long")
    times = F.when(sent * 10 >= limit * 9, 4).otherwise(2).cast("long")
    return F.when((sent <= 0) | (limit <= 0), F.lit(2).cast("long")).otherwise(F.greatest(_div(sent * times + limit - 1, limit), F.lit(2).cast("long")))


def calibrated_object_bytes(sent: Column, objects: Column, current: Column) -> Column:
    """Twice the bytes seen for each object where that is more than assumed, else 0."""
    found = _div(sent.cast("long") * 2, objects.cast("long"))
    return F.when((sent > 0) & (objects > 0) & (found > current), found).otherwise(F.lit(0).cast("long"))


def drop_count(sent: Column, limit: Column, most: Column) -> Column:
    """Checkpoints to skip after a small push: doublings that stay within half the limit."""
    sent, half = sent.cast("long"), _div(limit.cast("long"), F.lit(2).cast("long"))
    fits = F.lit(0).cast("long")
    for k in range(1, MOST_DROPPED + 1):
        fits = fits + F.when(sent * (1 << k) <= half, 1).otherwise(0)
    usable = (sent > 0) & (limit > 0) & (most > 0) & (sent < half)
    return F.when(usable, F.least(fits, most.cast("long"))).otherwise(F.lit(0).cast("long"))


def effective_objects(sent: Column, total: Column, stopped: Column) -> Column:
    """Objects sent, but 1 for a push that was stopped inside its first object."""
    return F.when((sent == 0) & (total > 0) & stopped, F.lit(1).cast("long")).otherwise(sent.cast("long"))


def should_stop(sent: Column, objects: Column, total: Column, budget: Column) -> Column:
    """Whether a push nears its budget, or is on course to once enough bytes are sent."""
    sent, budget = sent.cast("long"), budget.cast("long")
    most = _div(budget * STOP_PERCENT, F.lit(100).cast("long"))
    projected = _div(sent * total, objects.cast("long"))
    late = (sent >= LEAST_SENT) & (objects > 0) & (total > 0) & (projected > most)
    return F.coalesce((budget > 0) & ((sent >= most) | late), F.lit(False))


def estimated_pack_bytes(objects: Column, object_bytes: Column) -> Column:
    return objects.cast("long") * object_bytes.cast("long")
