"""Connected components of random and chained graphs, in one partition and by star passes."""

import numpy as np
import pytest

from millrace.llm import common


@pytest.mark.parametrize("part", [1 << 20, 40])
def test_components(spark, monkeypatch, part):
    monkeypatch.setattr(common, "PART_EDGES", part)
    g = np.random.default_rng(7)
    edges = [(int(a), int(b)) for a, b in g.integers(0, 300, (170, 2))] + [(1000 + i, 1001 + i) for i in range(60)] + [(-5, 2000 + i) for i in range(50)] + [(7, 7)]
    least = {n: n for e in edges for n in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            m = min(least[a], least[b])
            if least[a] != m or least[b] != m:
                least[a] = least[b] = m
                changed = True
    linked = {n for a, b in edges if a != b for n in (a, b)}
    found = {r["node"]: r["component"] for r in common.components(spark.createDataFrame(edges, "a long, b long").repartition(5)).collect()}
    assert found == {n: least[n] for n in linked}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0
