"""Bounded samples of labelled documents, and the fold that a label is learned from."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(modulus: int) -> Column:
    """crc32 of the doc_id as text, modulo `modulus`."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(modulus))


#: Pieces that stand for a text over the bound (fixed value).
PIECES = 8


def excerpt(max_bytes: int) -> Column:
    """`text`, or if it is over `max_bytes` about as many bytes of whole words in pieces spread evenly from its start to its end."""
    n = F.length("text").cast("long")
    size = F.greatest(F.floor(n * F.lit(max_bytes) / F.octet_length("text") / PIECES), F.lit(1)).cast("int")
    parts = []
    for k in range(PIECES):
        start = F.floor((n - size) * F.lit(k) / (PIECES - 1)).cast("int") + 1
        edges = [r"^\S*\s"] * (k > 0) + [r"\s\S*$"] * (k < PIECES - 1)
        parts.append(F.regexp_replace(F.substring(F.col("text"), start, size), "|".join(edges), ""))
    return F.when(F.octet_length("text") <= max_bytes, F.col("text")).otherwise(F.concat_ws("\n", *parts))


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, modulus: int, held_out: int, rows: int, max_bytes: int) -> list[tuple[str, int]]:
    """About `rows` (text, label) at most, in order of a hash of doc_id; none from fold `held_out`, none with a null label; of texts over `max_bytes`, an excerpt.

    A doc_id with both labels counts as 1. Only the ids of the sample are sent to the documents, so no text is shuffled.
    """
    usable = labels.where(F.col(column).isin(0, 1) & (fold(modulus) != held_out)).groupBy("doc_id").agg(F.max(column).cast("int").alias("label"))
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    found = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(chosen), "doc_id").orderBy("doc_id", F.xxhash64("text")).limit(rows)
    return [(r.text, r.label) for r in found.select(excerpt(max_bytes).alias("text"), "label").collect()]


def fit_logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3, steps: int = 60) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(weights with the intercept last, means, scales) by Newton steps on standardised features."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    ridge = penalty * len(x) * np.eye(z.shape[1])
    ridge[-1, -1] = 1e-9
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + ridge, z.T @ (p - y) + ridge @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w, mean, scale


def logistic(x: np.ndarray, model: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    w, mean, scale = model
    return 1 / (1 + np.exp(-np.clip((x - mean) / scale @ w[:-1] + w[-1], -30, 30)))
