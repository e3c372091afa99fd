"""The forest at its shipped parameters: recall at the threshold, growth of the spill, links against brute force."""

import numpy as np
from pyspark.sql import functions as F

from millrace.llm import embed_dedup


def pairs_at(cosine, n, dim, g):
    a = g.normal(size=(n, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    off = g.normal(size=(n, dim))
    off -= (off * a).sum(axis=1, keepdims=True) * a
    off /= np.linalg.norm(off, axis=1, keepdims=True)
    return a, cosine * a + (1 - cosine**2) ** 0.5 * off


def test_recall_and_spill_by_depth():
    g = np.random.default_rng(2)
    a, b = pairs_at(embed_dedup.THRESHOLD, 20_000, 64, g)
    for depth in (3, 8, 12, 16):
        trees = embed_dedup.Forest(a[: embed_dedup.SAMPLE], depth, embed_dedup.TREES, embed_dedup.THRESHOLD)
        (row, code), (other, far) = trees.leaves(a), trees.leaves(b)
        met = np.unique(np.intersect1d(row * (1 << 32) + code, other * (1 << 32) + far) >> 32)
        assert len(met) / len(a) > 0.995
        assert len(row) / len(a) < 3.3 * 1.15**depth


def test_links_against_brute_force(spark):
    """Clusters of 5,000 vectors in two labels, deep enough for 8 levels of trees, at shipped margins."""
    g = np.random.default_rng(9)
    center = g.normal(size=(250, 24))
    x = (center[g.integers(0, 250, 5000)] + g.normal(size=(5000, 24)) * 0.12).astype("f4")
    label = g.integers(0, 2, 5000)
    df = spark.createDataFrame([(i, v.tolist(), int(y)) for i, (v, y) in enumerate(zip(x, label, strict=True))], "vec_id long, embedding array<float>, label int")
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    expected = np.array([((unit @ u >= 0.98) & (label == y)).sum() - 1 for u, y in zip(unit, label, strict=True)])
    found = np.zeros(5000)
    before = embed_dedup.MIN_DEPTH
    try:
        embed_dedup.MIN_DEPTH = 8
        for r in embed_dedup.near_duplicate_vectors(df.withColumn("_e_id", F.lit("clash")).withColumn("code", F.lit(1))).collect():
            found[r["vec_id"]] = r["n_links"]
    finally:
        embed_dedup.MIN_DEPTH = before
    assert expected.sum() > 5000 and (found <= expected).all() and found.sum() / expected.sum() > 0.995


def test_met_before():
    g = np.random.default_rng(1)
    lists = [sorted(g.choice(40, g.integers(0, 6), replace=False).tolist()) for _ in range(50)]
    starts, codes = np.cumsum([0, *map(len, lists)]), np.array([c for x in lists for c in x])
    x, y = g.integers(0, 50, 400), g.integers(0, 50, 400)
    assert embed_dedup._met_before(x, y, starts, codes).tolist() == [bool(set(lists[i]) & set(lists[j])) for i, j in zip(x, y, strict=True)]
