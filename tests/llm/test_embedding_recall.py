"""Recall of the cell index among many vectors with links: one vector in twenty against all others."""

from __future__ import annotations

import numpy as np
import pytest

from shopmill.llm import embedding_dedup


def near_copies(draw, x, low=0.9, high=0.93):
    """Vectors whose cosine with the given unit vectors lies between two numbers, in any direction."""
    cosine = draw.uniform(low, high, len(x))[:, None]
    other = draw.normal(size=x.shape)
    other -= (other * x).sum(axis=1, keepdims=True) * x
    other /= np.linalg.norm(other, axis=1, keepdims=True)
    return cosine * x + np.sqrt(1 - cosine**2) * other


@pytest.mark.parametrize("size", [16, 64])
def test_recall_among_twenty_thousand(spark, size):
    draw = np.random.default_rng(size)
    x = draw.normal(size=(12_000, size))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    # every fourth vector has two near copies, and one group is large
    x = np.concatenate([x, near_copies(draw, x[::4]), near_copies(draw, x[::4]), near_copies(draw, np.repeat(x[:1], 2_000, 0), 0.93, 0.99)])
    x = x[draw.permutation(len(x))].astype(np.float32)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {r.vec_id: r.n_links for r in embedding_dedup.near_duplicates(rows).collect()}
    unit = x.astype(float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    asked = np.arange(0, len(x), 20)
    true = (unit[asked] @ unit.T >= 0.9).sum(axis=1) - 1
    found = np.array([got[i] for i in asked.tolist()])
    assert len(got) == len(x) and (found <= true).all()
    assert true.sum() > 3_000 and found.sum() >= 0.98 * true.sum()
    few = true < 100  # the large group does not hide what others miss
    assert found[few].sum() >= 0.97 * true[few].sum()
