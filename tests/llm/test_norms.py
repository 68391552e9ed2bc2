"""Cosines of vectors with norms from one end of the doubles to the other, against exact fractions."""

import random
from fractions import Fraction

import numpy as np

from snapweave.llm.embedding_dedup import EmbeddingDedupConfig, embedding_duplicates, scaled


def linked(a, b):
    """Whether the cosine is at least 0.98, by exact arithmetic."""
    a, b = [Fraction(x) for x in a], [Fraction(x) for x in b]
    dot = sum(x * y for x, y in zip(a, b, strict=True))
    return dot > 0 and dot * dot >= Fraction(98, 100) ** 2 * sum(x * x for x in a) * sum(y * y for y in b)


def test_extreme_norms(spark):
    rng = random.Random(5)
    base = [[1.0, 0.6, 0.6], [1.0, 1.0, 1.0], [1.0, -0.2, 0.1], [0.0, 0.0, 1.0]]
    vectors = [[1e-200] * 3, [1.0, 0.6, 0.6], [5e-324, 0.0, 0.0], [5e-324, 5e-324, 0.0], [1.7e308, 1.7e308, -1.7e308], [1.0, 1.0, -1.0]]
    for k in range(60):
        scale = 10.0 ** rng.choice([-300, -160, -20, 0, 20, 160, 300])
        vectors.append([scale * (x + rng.uniform(-0.06, 0.06)) for x in base[k % 4]])
    rows = [(k, v, "x") for k, v in enumerate(vectors)]
    found = {r.vec_id: (r.n_links, r.component_id) for r in embedding_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string"), EmbeddingDedupConfig(threshold=0.98)).collect()}
    near = {k: [j for j in range(len(vectors)) if j != k and linked(vectors[k], vectors[j])] for k in range(len(vectors))}
    component = {}
    for k in near:
        seen, todo = {k}, [k]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        component[k] = min(seen)
    assert found == {k: (len(near[k]), component[k]) for k in near}
    assert not linked(vectors[0], vectors[1]) and any(near.values())


def test_scaling_is_exact():
    rng = np.random.default_rng(1)
    matrix = rng.normal(size=(50, 8)) * 10.0 ** rng.integers(-250, 250, (50, 1))
    some = scaled(matrix)
    assert ((np.abs(some).max(1) >= 0.5) & (np.abs(some).max(1) < 1)).all()
    exponent = np.frexp(np.abs(matrix).max(1))[1]
    assert (np.ldexp(some, exponent[:, None]) == matrix).all()
