"""Operators on blocks of whole rows: results against plain loops over a small graph, and what they shuffle."""

from itertools import permutations

import numpy as np
import pytest

from loomgraph.functions import common_neighbors
from loomgraph.graph import Graph
from loomgraph.operators import community, patterns, similarity, structure
from loomgraph.plans import blocks

N = 60


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture(scope="module")
def pairs():
    rng = np.random.default_rng(5)
    return sorted({(min(a, b), max(a, b)) for a, b in rng.integers(0, N, (400, 2)).tolist() if a != b})


@pytest.fixture(scope="module")
def graph(spark, pairs):
    e = [(a * 1000, b * 1000, float((a * 31 + b * 17) % 9 + 1)) for a, b in pairs]
    return Graph.from_edgelist(spark.createDataFrame(e, "src bigint, dst bigint, weight double"), weight="weight")


@pytest.fixture()
def small_blocks(monkeypatch):
    """Several blocks, and several steps in each, of a graph that would fit one."""
    monkeypatch.setattr(blocks, "MOST", 100)
    monkeypatch.setattr(blocks, "STEP", 50)


@pytest.fixture(scope="module")
def near(pairs):
    out = {}
    for a, b in pairs:
        w = float((a * 31 + b * 17) % 9 + 1)
        out.setdefault(a * 1000, {})[b * 1000] = w
        out.setdefault(b * 1000, {})[a * 1000] = w
    return out


def expected(near, kind, weighted):
    out = {}
    for u, x in near.items():
        for v, y in near.items():
            both = x.keys() & y.keys()
            if not both:
                continue
            i = sum(min(x[k], y[k]) for k in both) if weighted else len(both)
            da, db = (sum(z.values()) if weighted else len(z) for z in (x, y))
            if kind == "cosine":
                dot, xx, yy = (sum(f(k) for k in both) for f in (lambda k: x[k] * y[k], lambda k: x[k] ** 2, lambda k: y[k] ** 2))
                out[u, v] = dot / (xx * yy) ** 0.5 if weighted else 1.0
            else:
                out[u, v] = {"jaccard": i / (da + db - i), "sorensen": 2 * i / (da + db), "overlap": i / min(da, db)}[kind]
    return out


@pytest.mark.parametrize("weighted", [False, True])
@pytest.mark.parametrize("kind", similarity.KINDS)
def test_similarity_of_all_pairs_joins_no_wedges(graph, near, small_blocks, kind, weighted):
    got = similarity.similarity(graph, kind, use_weight=weighted)
    assert "Join" not in plan(got) and "Aggregate" not in plan(got)
    found = {(r[0], r[1]): r[2] for r in got.collect()}
    want = expected(near, kind, weighted)
    assert found.keys() == want.keys() and all(abs(found[k] - want[k]) < 1e-12 for k in want)


def test_all_pairs_of_some_vertices(graph, near, small_blocks, spark):
    some = spark.createDataFrame([(3000,), (7000,)], "vertex bigint")
    found = {(r[0], r[1]): r[2] for r in similarity.all_pairs(graph, "jaccard", some).collect()}
    want = {k: v for k, v in expected(near, "jaccard", False).items() if k[0] in (3000, 7000) and k[0] != k[1]}
    assert found.keys() == want.keys() and all(abs(found[k] - want[k]) < 1e-12 for k in want)


def test_two_hop_of_a_directed_graph(pairs, small_blocks, spark):
    e = spark.createDataFrame(pairs, "src bigint, dst bigint")
    got = structure.two_hop(Graph(e, directed=True))
    assert "Join" not in plan(got)
    assert sorted(map(tuple, got.collect())) == sorted({(a, d) for a, b in pairs for c, d in pairs if b == c})
    assert structure.two_hop(Graph(e.where("src < 0"), directed=True)).isEmpty()


def triangles_of(near):
    return sorted((a, b, c) for a in near for b in near[a] for c in near[a] if a < b < c and c in near[b])


@pytest.mark.parametrize("far", [False, True])
def test_triangles_join_no_wedges(graph, near, small_blocks, far):
    wide = Graph(graph.edges.selectExpr("src * 1000000000000 AS src", "dst * 1000000000000 AS dst")) if far else graph
    got = community.triangles(wide)
    assert "Join" not in plan(got)
    by = 10**12 if far else 1
    assert sorted(tuple(sorted(x // by for x in r)) for r in got.collect()) == triangles_of(near)


@pytest.mark.parametrize("k", [2, 3, 4, 5])
def test_truss(graph, near, small_blocks, k):
    left = {(a, b) for a in near for b in near[a] if a < b}
    while True:
        weak = {(a, b) for a, b in left if sum((min(a, c), max(a, c)) in left and (min(b, c), max(b, c)) in left for c in near) < k - 2}
        if not weak:
            break
        left -= weak
    assert set(map(tuple, community.k_truss(graph, k).collect())) == left


def test_common_neighbors_of_edges_join_no_wedges(pairs, small_blocks, spark):
    got = common_neighbors(spark.createDataFrame(pairs, "src bigint, dst bigint"))
    assert "Join" not in plan(got)
    there = set(pairs)
    assert sorted(map(tuple, got.collect())) == sorted((a, b, n) for a, b in pairs for n in range(N) if (a, n) in there and (b, n) in there)


def test_pattern_with_a_triangle_starts_from_triangles(graph, near):
    got = patterns.subgraph_monomorphism(graph, [(1, 2), (2, 3), (3, 1), (3, 4)])
    want = [(p, q, r, s) for a, b, c in triangles_of(near) for p, q, r in permutations((a, b, c)) for s in near[r] if s not in (p, q, r)]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    alone = patterns.subgraph_monomorphism(graph, [(1, 2), (2, 3), (3, 1)])
    assert "Join" not in plan(alone) and alone.count() == 6 * len(triangles_of(near))
