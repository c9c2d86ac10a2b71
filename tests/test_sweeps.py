"""Rounds over blocks against the operators' joins, which other graphs still take, and against loops over a small graph."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.graph import Graph
from loomgraph.operators import centrality, components, traversal
from loomgraph.plans import sweeps

N = 40


@pytest.fixture(scope="module")
def graph(spark):
    rng = np.random.default_rng(8)
    e = {(min(a, b) * 10, max(a, b) * 10): float((a * 31 + b * 17) % 9 + 1) for a, b in rng.integers(0, N, (110, 2)).tolist()}
    e |= {(1000, 1010): 2.0, (1010, 1020): 1.0}  # a component of its own; self-loops are there too
    return Graph.from_edgelist(spark.createDataFrame([(*k, w) for k, w in e.items()], "src bigint, dst bigint, weight double"), weight="weight")


@pytest.fixture(autouse=True)
def small_blocks(monkeypatch):
    monkeypatch.setattr(sweeps, "EDGES", 30)


@pytest.fixture(scope="module")
def plain(graph):
    """The same graph, for the operators' joins."""
    return Graph(graph.edges.localCheckpoint())


def same(a, b):
    a, b = (sorted(map(tuple, x.collect()), key=str) for x in (a, b))
    assert len(a) == len(b) and all(x == pytest.approx(y, rel=1e-9) for x, y in zip(a, b))


@pytest.mark.parametrize("f", [
    lambda g: centrality.katz_centrality(g, alpha=0.01, max_iter=5, tol=None),
    lambda g: centrality.katz_centrality(g, alpha=0.001),
    lambda g: centrality.eigenvector_centrality(g, max_iter=5, tol=None),
    lambda g: traversal.bfs(g, g.edges.sparkSession.createDataFrame([(0,), (50,)], "vertex bigint")),
    lambda g: traversal.bfs(g, g.edges.sparkSession.createDataFrame([(0,)], "vertex bigint"), 1),
    lambda g: traversal.sssp(g, 0),
    lambda g: traversal.sssp(g, 0, cutoff=5.0),
    components.weakly_connected_components,
    components.core_number,
    lambda g: components.k_core(g, 2),
    lambda g: components.k_core(g, 4),
    components.k_core,
    components.minimum_spanning_tree,
    components.maximum_spanning_tree,
    components.maximal_independent_set,
])
def test_rounds_give_what_joins_give(graph, plain, f):
    assert sweeps.fits(graph) and not sweeps.fits(plain)
    same(f(graph), f(plain))


def test_rounds_take_several_blocks(graph):
    assert len(sweeps.Sweeps(graph).blocks) > 3


def test_rounds_join_and_write_no_tables(graph, monkeypatch):
    def never(*_):
        raise AssertionError("a table of a round")

    for module in (centrality, traversal):
        monkeypatch.setattr(module, "written", never)
    centrality.katz_centrality(graph, alpha=0.01, max_iter=2, tol=None)
    centrality.eigenvector_centrality(graph, max_iter=2, tol=None)
    traversal.sssp(graph, 0)


def test_core_of_a_long_path_and_a_ring(spark):
    from loomgraph.sources import generators

    e = generators.path_graph(spark, 3000).unionByName(spark.createDataFrame([(5000, 5001), (5001, 5002), (5002, 5000)], "src bigint, dst bigint"))
    g = Graph.from_edgelist(e)
    assert sorted(map(tuple, components.k_core(g, 2).where("src < dst").collect())) == [(5000, 5001), (5000, 5002), (5001, 5002)]
    assert {tuple(r) for r in components.core_number(g).groupBy("core_number").count().collect()} == {(1, 3000), (2, 3)}


@pytest.mark.parametrize("directed", [True, False])
@pytest.mark.parametrize("endpoints", [False])
def test_betweenness_without_joins(graph, spark, directed, endpoints):
    small = Graph.from_edgelist(graph.edges.where("src < 100 AND dst < 100"), directed=directed)
    named = Graph(small.edges.select(*[F.concat(F.lit("v"), F.lpad(F.col(c).cast("string"), 6, "0")).alias(c) for c in ("src", "dst")]), directed=directed)
    got = {r[0]: r[1] for r in centrality.betweenness_centrality(small, endpoints=endpoints).collect()}
    want = {int(r[0][1:]): r[1] for r in centrality.betweenness_centrality(named, endpoints=endpoints).collect()}
    assert got == pytest.approx(want, rel=1e-9)
    if not endpoints:
        got = {(r[0], r[1]): r[2] for r in centrality.edge_betweenness_centrality(small).collect()}
        want = {(int(r[0][1:]), int(r[1][1:])): r[2] for r in centrality.edge_betweenness_centrality(named).collect()}
        assert got == pytest.approx(want, rel=1e-9)
