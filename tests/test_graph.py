"""Operators against the literal values of the small fixtures."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.graph import Graph
from loomgraph.operators import centrality, community, components, patterns, sampling, similarity, structure, traversal
from loomgraph.sources import files, generators

# Published small fixtures (edges, weights) and the results they must give, here and in the tests below.
SRC = [0, 1, 1, 2, 2, 2, 3, 4]
DST = [1, 3, 4, 0, 1, 3, 5, 5]
WEIGHT = [0.1, 2.1, 1.1, 5.1, 3.1, 4.1, 7.2, 3.2]


@pytest.fixture(scope="module")
def g6d(spark):
    e = spark.createDataFrame(list(zip(SRC, DST, WEIGHT)), "src bigint, dst bigint, weight double").coalesce(1)
    return Graph(e, directed=True)


@pytest.fixture(scope="module")
def g6u(g6d):
    return Graph(generators.symmetrized(g6d.edges), directed=False)


def values(df, column):
    return [r[column] for r in df.orderBy("vertex").collect()]


def test_pagerank(g6d):
    got = centrality.pagerank(g6d, alpha=0.95, tol=1e-4, max_iter=40)
    assert np.allclose(values(got, "pagerank"), [0.0915528, 0.168382, 0.0656831, 0.191468, 0.120677, 0.362237], atol=1e-4)


def test_katz(g6d):
    got = centrality.katz_centrality(g6d, alpha=0.01)
    assert np.allclose(values(got, "katz_centrality"), [0.410614, 0.403211, 0.390689, 0.415175, 0.395125, 0.433226], atol=1e-5)


def test_eigenvector(g6u):
    got = centrality.eigenvector_centrality(g6u)
    assert np.allclose(values(got, "eigenvector_centrality"), [0.236325, 0.292055, 0.458457, 0.60533, 0.190498, 0.495942], atol=1e-4)


def test_hits(g6d):
    got = centrality.hits(g6d, normalized=False, max_iter=100)
    assert np.allclose(values(got, "hubs"), [0.347296, 0.532089, 1, 0.00003608, 0.00003608, 0], atol=1e-3)
    assert np.allclose(values(got, "authorities"), [0.652703, 0.879385, 0, 1, 0.347296, 0.00009136], atol=1e-3)


def test_not_converged(g6d):
    from loomgraph.plans.loop import FailedToConvergeError

    with pytest.raises(FailedToConvergeError):
        centrality.pagerank(g6d, max_iter=1, tol=1e-12)


def test_bfs(g6d, spark):
    got = traversal.bfs(g6d, spark.createDataFrame([(0,)], "vertex bigint"))
    assert values(got, "distance") == [0, 1, 2147483647, 2, 2, 3]
    assert values(got, "predecessor") == [-1, 0, -1, 1, 1, 3]


def test_sssp(g6d):
    got = traversal.sssp(g6d, 0)
    far = traversal.FAR_FLOAT
    assert np.allclose(values(got, "distance"), [0, 0.1, far, 2.2, 1.2, 4.4])
    assert values(got, "predecessor") == [-1, 0, -1, 1, 1, 4]
    assert values(traversal.sssp(g6d, 0, cutoff=2.2), "distance")[3] == far  # strict


def test_betweenness(g6u, g6d, spark):
    assert np.allclose(values(centrality.betweenness_centrality(g6u, normalized=False), "betweenness_centrality"), np.array([0, 3.66667, 0.833333, 2.16667, 0.833333, 0.5]), atol=1e-4)
    two = spark.createDataFrame([(0,), (3,)], "vertex bigint")
    assert np.allclose(values(centrality.betweenness_centrality(g6u, k=two, normalized=True), "betweenness_centrality"), [0, 0.395833, 0.166667, 0.166667, 0.0416667, 0.0625], atol=1e-5)
    assert np.allclose(values(centrality.betweenness_centrality(g6d, endpoints=True), "betweenness_centrality"), [0.166667, 0.3, 0.166667, 0.2, 0.166667, 0.166667], atol=1e-5)


def test_triangles(g6u, spark):
    start = spark.createDataFrame([(0,), (1,), (2,), (4,)], "vertex bigint")
    assert values(community.triangle_count(g6u, start), "counts") == [1, 2, 2, 0]


def test_jaccard(g6u, spark):
    pairs = [(0, 1), (0, 3), (0, 4), (1, 2), (1, 3), (1, 5), (2, 3), (2, 4), (2, 5), (3, 4)]
    got = similarity.similarity(g6u, "jaccard", spark.createDataFrame(pairs, "first bigint, second bigint"))
    want = [0.2, 0.666667, 0.333333, 0.4, 0.166667, 0.5, 0.2, 0.25, 0.25, 0.666667]
    assert np.allclose([r[2] for r in got.orderBy("first", "second").collect()], want, atol=1e-5)


def test_strong_components(spark):
    e = spark.createDataFrame([(0, 1), (1, 2), (2, 0), (2, 3), (3, 4), (4, 3), (5, 0)], "src bigint, dst bigint")
    assert values(components.strongly_connected_components(Graph(e, directed=True)), "labels") == [0, 0, 0, 3, 3, 5]


def test_spanning_tree_weight(g6u):
    tree = components.minimum_spanning_tree(g6u).collect()
    assert len(tree) == 5 and abs(sum(r["weight"] for r in tree) - (0.1 + 1.1 + 2.1 + 3.1 + 3.2)) < 1e-9
    assert abs(sum(r["weight"] for r in components.maximum_spanning_tree(g6u).collect()) - (7.2 + 5.1 + 4.1 + 3.2 + 3.1)) < 1e-9


def test_matching_and_colours(g6u):
    matched = components.weighted_matching(g6u).collect()
    ends = [x for r in matched for x in (r["src"], r["dst"])]
    assert len(ends) == len(set(ends)) and (3, 5) in [(r["src"], r["dst"]) for r in matched]
    colour = {r[0]: r[1] for r in components.vertex_coloring(g6u).collect()}
    assert all(colour[a] != colour[b] for a, b in zip(SRC, DST)) and len(colour) == 6


def test_assignment():
    cost = np.random.default_rng(1).uniform(0, 10, (6, 7))
    from itertools import permutations

    want = min(sum(cost[i, j] for i, j in enumerate(p)) for p in permutations(range(7), 6))
    assert abs(patterns.assignment(cost)[0] - want) < 1e-9


def test_louvain_finds_two_cliques(spark):
    e = [(a + o, b + o) for o in (0, 10) for a in range(5) for b in range(5) if a < b] + [(0, 10)]
    part, q = community.louvain(Graph.from_edgelist(spark.createDataFrame(e, "src bigint, dst bigint")))
    of = {r[0]: r[1] for r in part.collect()}
    assert len(set(of.values())) == 2 and of[1] == of[4] != of[11] and q > 0.4


def test_walks_follow_edges(g6d, spark):
    walks = sampling.random_walks(g6d, spark.createDataFrame([(2,), (2,)], "vertex bigint"), 3, biased=True).orderBy("walk_id", "step").collect()
    edges = set(zip(SRC, DST))
    for a, b in zip(walks, walks[1:]):
        if a["walk_id"] == b["walk_id"]:
            assert (a["vertex"], b["vertex"]) in edges


def test_sample_fanout(g6u, spark):
    seeds = spark.createDataFrame([(0, 2), (1, 2)], "batch_id bigint, vertex bigint")
    got = sampling.neighbor_sample(g6u, seeds, [2, 1])
    counts = got.groupBy("batch_id", "hop_id", "src").count().collect()
    assert all(r["count"] <= [2, 1][r["hop_id"]] for r in counts) and got.join(g6u.edges, ["src", "dst"], "left_anti").isEmpty()
    assert sampling.renumber_sample(got).where("hop_id = 0 AND src_id != 0").isEmpty()


def test_build_rules(spark):
    e = spark.createDataFrame([(1, 2, 3.0), (2, 1, 5.0), (1, 2, 9.0), (3, 3, 1.0), (None, 1, 1.0)], "src bigint, dst bigint, weight double")
    g = Graph.from_edgelist(e, weight="weight")
    assert sorted(map(tuple, g.edges.collect())) == [(1, 2, 3.0), (2, 1, 3.0), (3, 3, 1.0)]
    assert g.number_of_edges() == 2 and g.has_self_loop() and not g.has_edge(1, 3)
    assert {tuple(r)[:2]: r[2] for r in structure.symmetrize(e.where("src IS NOT NULL")).collect()}[(1, 2)] == 4.0


def test_files(spark, tmp_path):
    (tmp_path / "a.mtx").write_text("%%MatrixMarket matrix coordinate\n% a comment\n3 3 2\n1 2 0.5\n2 3 1.5\n")
    assert sorted(map(tuple, files.matrix_market(spark, str(tmp_path / "a.mtx")).collect())) == [(1, 2, 0.5), (2, 3, 1.5)]
    (tmp_path / "b.csv").write_text("0 1 2.0\n1 2 3.0\n")
    assert files.Dataset(str(tmp_path / "b.csv")).graph(spark).number_of_edges() == 2


def test_empty_graph(spark):
    g = Graph(spark.createDataFrame([], "src bigint, dst bigint"), directed=True)
    assert structure.degrees(g).count() == 0 and components.weakly_connected_components(g).count() == 0


def test_layout(g6u):
    got = patterns.force_atlas2(g6u, max_iter=20).collect()
    assert len(got) == 6 and all(np.isfinite([r["x"], r["y"]]).all() for r in got)


def test_streamed_degrees(spark):
    from loomgraph.streaming import windowed_degrees

    e = spark.createDataFrame([(1, 2, "2024-01-01 00:10:00"), (1, 3, "2024-01-01 00:20:00")], "src bigint, dst bigint, at string").withColumn("at", F.to_timestamp("at"))
    assert windowed_degrees(e, "at").first()["out_degree"] == 2


def test_core_number_of_a_long_path(spark):
    path = generators.path_graph(spark, 3000)
    got = components.core_number(Graph.from_edgelist(path)).groupBy("core_number").count().collect()
    assert [tuple(r) for r in got] == [(1, 3000)]
    from loomgraph.plans.loop import FailedToConvergeError

    with pytest.raises(FailedToConvergeError):
        components.core_number(Graph.from_edgelist(generators.path_graph(spark, 41)), max_rounds=5)


def test_parallel_edges_keep_one_edge(spark):
    e = spark.createDataFrame([(1, 2, 5.0, 7), (1, 2, 3.0, 9)], "src bigint, dst bigint, w double, e bigint")
    assert Graph.from_edgelist(e, weight="w", edge_id="e", directed=True).edges.first()[2:] == (3.0, 9)


def test_string_ids(spark):
    e = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0), ("x", "y", 1.0)], "src string, dst string, weight double")
    g = Graph(e, directed=True)
    got = {r[0]: tuple(r)[1:] for r in traversal.bfs(g, spark.createDataFrame([("a",)], "vertex string")).collect()}
    assert got["c"] == (2, "b") and got["a"] == (0, None) and got["y"][0] == traversal.FAR_INT
    assert {r[0]: r[2] for r in traversal.sssp(g, "a").collect()}["c"] == "b"
    assert traversal.shortest_path_length(g, "a", "c") == 2.0
    with pytest.raises(ValueError):
        traversal.shortest_path_length(g, "a", "nowhere")
    tree = traversal.bfs(g, spark.createDataFrame([("a",)], "vertex string"))
    assert [r["vertex"] for r in traversal.traversed_path(tree, "c").orderBy("step").collect()] == ["c", "b", "a"]
    assert traversal.padded_paths(tree, spark.createDataFrame([("c",)], "vertex string")).first()["path"] == ["a", "b", "c"]


def test_walks_do_not_depend_on_partitions(g6d, spark):
    start = spark.createDataFrame([(i % 3,) for i in range(12)], "vertex bigint")
    a, b = (sorted(map(str, sampling.random_walks(g6d, start.repartition(n), 3).collect())) for n in (1, 5))
    assert a == b and len({r["walk_id"] for r in sampling.random_walks(g6d, start, 1).collect()}) == 12


def test_negative_samples_all_there_are(g6d):
    got = [tuple(r) for r in sampling.negative_sampling(g6d, 1000).collect()]
    assert len(got) == len(set(got)) == 36 - 8 and not set(got) & set(zip(SRC, DST))


def test_strong_component_of_one(spark):
    e = spark.createDataFrame([(0, 1), (1, 2), (2, 0), (2, 3)], "src bigint, dst bigint")
    g = Graph(e, directed=True)
    assert values(components.strong_connected_component(g, 1), "vertex") == [0, 1, 2]
    assert values(components.connected_components(g, "strong"), "labels") == [0, 0, 0, 3]
