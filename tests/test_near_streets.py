"""Betweenness where sources reach few nodes: worked out block by block of sources, with no state that moves from round to round."""

import numpy as np
import pytest

from panelwright.operators import graph
from test_operators import brute_betweenness

RNG = np.random.default_rng(6)


def _lattices(spark, nets, n):
    want, rows = {}, []
    for net in range(nets):
        arcs = {}
        for u in range(n):
            for v in (u + 1, u - 1, u + 5, u - 5):
                if 0 <= v < n and abs(u // 5 - v // 5) + abs(u % 5 - v % 5) == 1 and RNG.uniform() < 0.7:
                    arcs[(u, v)] = float(RNG.integers(1, 4))
        rows += [(net, u, v, 0, w, w) for (u, v), w in arcs.items()]
        want[net] = brute_betweenness(arcs, range(n))
    edges = spark.createDataFrame(rows, "net int, src long, dst long, key int, length double, travel_time double")
    nodes = spark.createDataFrame([(net, i, 0.0, 0.0) for net in range(nets) for i in range(n)], "net int, node long, x double, y double")
    return edges, nodes, want


@pytest.mark.parametrize("near", [10_000, 12])
def test_near_and_far_sources(spark, monkeypatch, near):
    """All near: nothing goes round by round.  Some far: both ways together make the whole."""
    edges, nodes, want = _lattices(spark, 2 if near > 12 else 1, 20)
    for name, value in (("REGION", 5), ("NEAR_SOURCES", 3), ("BLOCK", 4), ("NEAR_NODES", near), ("PAIRS_AT_ONCE", 40), ("FAR_ROWS", 100)):
        monkeypatch.setattr(graph, name, value)
    turns, kept = [], graph._until_still
    monkeypatch.setattr(graph, "_until_still", lambda *a: turns.append(1) or kept(*a))
    for r in graph.edge_betweenness(edges, nodes).collect():
        assert r.betweenness == pytest.approx(want[r.net].get(frozenset((r.lo, r.hi)), 0.0), abs=1e-12)
    assert bool(turns) == (near == 12)
