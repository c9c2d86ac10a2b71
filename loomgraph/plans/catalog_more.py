"""Further registered queries: sources and sinks, neighbourhood functions, predicates, paths, and checks of what chance or ties decide.

Where a result depends on chance or on ties, the query counts its size and what
would break its definition, over whole tables; SQL says how many there must be.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from loomgraph.functions import aggregate_by_end_key, aggregate_neighbors, common_neighbors, expand_frontier, reduce_edges, reduce_edges_by_key, reduce_vertices, top_k_edges, transform_edges
from loomgraph.graph import Graph
from loomgraph.operators import community, components, patterns, sampling, similarity, structure, traversal
from loomgraph.plans.catalog import DEG, SIM, V, chain, customers, events, friends, query, rounded, some, users
from loomgraph.plans.catalog import ORACLE_SQL, QUERIES
from loomgraph.plans.shared import shared_dir, written
from loomgraph.sources import files, generators, tables


@query("SELECT src, dst, weight FROM ps", "fr")
def csv_dataset(spark, d):
    """A graph out of a delimited file, described by names and types."""
    where = f"{shared_dir(spark)}/csv/{uuid.uuid4().hex}"
    tables.users_together(spark, d).write.option("sep", " ").csv(where)
    return files.Dataset(where, kinds=("int64", "int64", "float64")).graph(spark).edges


@query("SELECT n_regionkey::BIGINT AS src, n_nationkey::BIGINT AS dst, 1.0::DOUBLE AS weight FROM nation")
def pandas_edgelist(spark, d):
    frame = tables.read(spark, d, "nation").selectExpr("cast(n_regionkey AS bigint) AS src", "cast(n_nationkey AS bigint) AS dst", "1.0D AS w").toPandas()  # 25 rows
    return files.from_pandas_edgelist(spark, frame, weight="w", directed=True).edges


@query("SELECT n_regionkey::BIGINT AS src, n_nationkey::BIGINT AS dst, (n_nationkey + 1)::DOUBLE AS weight FROM nation")
def coordinate_edges(spark, d):
    rows = tables.read(spark, d, "nation").select("n_regionkey", "n_nationkey").collect()  # 25 rows
    return files.from_coordinates(spark, [r[0] for r in rows], [r[1] for r in rows], [r[1] + 1 for r in rows])


@query("SELECT src, (sum(n) OVER (ORDER BY src) - n)::BIGINT AS \"offset\", n::INTEGER AS n, indices FROM (SELECT src, count(*) AS n, array_to_string(list_sort(list(dst)), ',') AS indices FROM ud GROUP BY src)", "us")
def compressed_rows(spark, d):
    return files.compressed_rows(users(spark, d).edges).selectExpr("src", "offset", "size(indices) AS n", "array_join(indices, ',') AS indices")


@query("WITH+" + V.format(e="ps") + " SELECT (SELECT count(*) FROM v) AS vertices, count(*) AS edges, (SELECT count(*) FROM ps) AS directed_edges FROM pt", "fr")
def graph_counts(spark, d):
    g = friends(spark, d)
    return spark.createDataFrame([(g.number_of_vertices(), g.number_of_edges(), g.number_of_edges(True))], "vertices bigint, edges bigint, directed_edges bigint")


@query("SELECT (SELECT min(src) FROM ud) AS vertex, true AS node, (SELECT count(*) > 0 FROM ud WHERE src = dst) AS self_loop, false AS isolated, true AS edge", "us")
def graph_predicates(spark, d):
    g = users(spark, d)
    a, b = g.edges.groupBy().agg(F.min(F.struct("src", "dst")).alias("m")).select("m.*").first()
    return spark.createDataFrame([(a, g.has_node(a), g.has_self_loop(), g.has_isolated_vertices(), g.has_edge(a, b))], "vertex bigint, node boolean, self_loop boolean, isolated boolean, edge boolean")


@query("SELECT DISTINCT dst AS vertex FROM ud WHERE src = 1", "us")
def neighbors(spark, d):
    return users(spark, d).neighbors(1)


@query("SELECT src, dst FROM ud UNION SELECT dst, src FROM ud", "us")
def to_undirected(spark, d):
    return users(spark, d).to_undirected().edges


@query("SELECT src, dst, weight FROM ps", "fr")
def to_directed(spark, d):
    return friends(spark, d).to_directed().edges


@query("WITH+" + V.format(e="ud") + " SELECT vertex, CASE WHEN vertex % 3 = 0 THEN vertex + 1000 ELSE vertex END AS label FROM v", "us")
def relabel(spark, d):
    v = users(spark, d).vertices()
    return structure.relabel(v.withColumn("label", F.col("vertex")), v.where("vertex % 3 = 0").selectExpr("vertex AS old", "vertex + 1000 AS new"))


@query("WITH+" + V.format(e="ud") + " SELECT least(20, (SELECT count(*) FROM v)) AS n, 0::BIGINT AS strangers", "us")
def random_vertices(spark, d):
    g = users(spark, d)
    got, _ = written(structure.random_vertices(g, 20))
    return got.agg(F.countDistinct("vertex").alias("n")).crossJoin(got.join(g.vertices(), "vertex", "left_anti").agg(F.count("*").alias("strangers")))  # one row each


@query(f"SELECT DISTINCT dst AS vertex FROM cs", "cs")
def bipartite_sets(spark, d):
    g = customers(spark, d)
    g.add_nodes_from(g.edges.select(F.col("src").alias("vertex")), "customers")
    return g.sets()[1]


@query("WITH+" + V.format(e="ud") + " SELECT k0 AS vertex, out_degree FROM (SELECT vertex AS k0 FROM v) JOIN (SELECT src, count(*) AS out_degree FROM ud GROUP BY src) ON src = k0", "us")
def renumber_and_back(spark, d):
    """Degrees counted on numbers, with the vertices put back."""
    g = users(spark, d)
    ids, _ = written(structure.renumber(g.edges, [["src"], ["dst"]]))
    numbered = structure.to_internal(g.edges, ids, ["src"]).groupBy(F.col("id").alias("vertex")).agg(F.count("*").alias("out_degree"))
    return structure.to_external(numbered, ids).withColumnRenamed("k0", "vertex")


DG = DEG.format(e="ud")


@query("WITH+" + DG + " SELECT dst AS vertex, sum(out_degree)::BIGINT AS total FROM ud JOIN deg ON deg.vertex = src GROUP BY dst", "us")
def aggregate_incoming(spark, d):
    g = users(spark, d)
    return aggregate_neighbors(g.edges, structure.degrees(g), F.sum("src_out_degree").alias("total"))


@query("WITH+" + DG + " SELECT src AS vertex, count(*) AS larger FROM ud JOIN deg a ON a.vertex = src JOIN deg b ON b.vertex = dst WHERE b.in_degree > a.in_degree GROUP BY src", "us")
def aggregate_outgoing_where(spark, d):
    g = users(spark, d)
    return aggregate_neighbors(g.edges, structure.degrees(g), F.count("*").alias("larger"), incoming=False, where=F.expr("dst_in_degree > src_in_degree"))


@query("SELECT src AS vertex, dst % 7 AS key, count(*) AS n FROM ud GROUP BY 1, 2", "us")
def aggregate_by_key(spark, d):
    g = users(spark, d)
    return aggregate_by_end_key(g.edges, g.vertices().selectExpr("vertex", "vertex % 7 AS key"), F.count("*").alias("n"))


@query("SELECT src, dst, weight FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS n FROM ps) WHERE n <= 3", "fr")
def top_k_by_vertex(spark, d):
    return top_k_edges(friends(spark, d).edges, F.desc("weight"), 3)


@query("SELECT a.src AS first, b.src AS second, a.dst AS neighbor FROM ud a JOIN ud b ON a.dst = b.dst JOIN ud e ON e.src = a.src AND e.dst = b.src", "us")
def edge_end_intersection(spark, d):
    g = users(spark, d)
    return common_neighbors(g.edges)


@query("SELECT dst AS vertex, min(src) AS source FROM ud WHERE src % 5 = 0 GROUP BY dst", "us")
def frontier_reduce(spark, d):
    g = users(spark, d)
    return expand_frontier(g.vertices().where("vertex % 5 = 0"), g.edges, F.min("src").alias("source"))


@query("WITH+" + DG + " SELECT src, dst, a.degree_sum + b.degree_sum AS ends FROM ud JOIN (SELECT vertex, in_degree + out_degree AS degree_sum FROM deg) a ON a.vertex = src JOIN (SELECT vertex, in_degree + out_degree AS degree_sum FROM deg) b ON b.vertex = dst WHERE src < dst", "us")
def edge_transform(spark, d):
    g = users(spark, d)
    return transform_edges(g.edges, structure.degrees(g), F.expr("src_degree + dst_degree AS ends"), F.expr("src < dst"))


@query("WITH+" + DG + " SELECT sum(a.out_degree * b.in_degree)::BIGINT AS total FROM ud JOIN deg a ON a.vertex = src JOIN deg b ON b.vertex = dst", "us")
def edge_reduce(spark, d):
    g = users(spark, d)
    return reduce_edges(g.edges, structure.degrees(g), F.sum(F.expr("src_out_degree * dst_in_degree")).alias("total"))


@query("WITH+" + DG + " SELECT a.out_degree % 4 AS key, max(b.in_degree) AS top FROM ud JOIN deg a ON a.vertex = src JOIN deg b ON b.vertex = dst GROUP BY 1", "us")
def edge_reduce_by_key(spark, d):
    g = users(spark, d)
    return reduce_edges_by_key(g.edges, structure.degrees(g), F.expr("src_out_degree % 4"), F.max("dst_in_degree").alias("top"))


@query("WITH+" + DG + " SELECT count(*) AS n FROM deg WHERE in_degree > out_degree", "us")
def vertex_count_if(spark, d):
    return reduce_vertices(structure.degrees(users(spark, d)), F.count("*").alias("n"), F.expr("in_degree > out_degree"))


WALK = "b(vertex, distance) AS (SELECT vertex, 0 FROM v WHERE vertex = (SELECT min(vertex) FROM v) UNION SELECT dst, distance + 1 FROM b JOIN ud ON src = b.vertex WHERE distance < 20), t AS (SELECT vertex, min(distance) AS d FROM b GROUP BY vertex)"


@query("WITH+" + V.format(e="ud") + ", " + WALK + " SELECT min(x.vertex) AS src, y.vertex AS dst FROM t y JOIN ud ON ud.dst = y.vertex JOIN t x ON x.vertex = ud.src AND x.d = y.d - 1 GROUP BY y.vertex", "us", True)
def bfs_edges(spark, d):
    g = users(spark, d)
    return traversal.bfs_edges(g, g.vertices().agg(F.min("vertex").alias("vertex")))


@query("WITH+" + V.format(e="ud") + ", " + WALK + " SELECT vertex AS destination, d::INTEGER AS hops, (SELECT min(vertex) FROM v) AS root FROM t", "us", True)
def padded_paths(spark, d):
    g = users(spark, d)
    tree, _ = written(traversal.bfs(g, g.vertices().agg(F.min("vertex").alias("vertex"))))
    return traversal.padded_paths(tree, tree.select("vertex")).selectExpr("destination", "size(path) - 1 AS hops", "path[0] AS root")


DIST = chain("SELECT a.vertex AS s, b.vertex, CASE WHEN a.vertex = b.vertex THEN 0.0::DOUBLE END AS x FROM v a, v b WHERE a.vertex IN (1, 2, 3)", "SELECT p.s, p.vertex, least(p.x, g.m) AS x FROM {p} p LEFT JOIN (SELECT s, dst AS vertex, min(x + weight) AS m FROM ps JOIN {p} ON {p}.vertex = src GROUP BY s, dst) g ON g.vertex = p.vertex AND g.s = p.s", 25)


@query("WITH+" + V.format(e="ps") + ", " + DIST + " SELECT s AS origin, vertex AS destination, coalesce(x, 1.7976931348623157e308) AS distance FROM r25 WHERE vertex % 2 = 0", "fr")
def od_shortest_distances(spark, d):
    g = friends(spark, d)
    return traversal.od_shortest_distances(g, some(spark, 1, 2, 3), g.vertices().where("vertex % 2 = 0"))


@query("WITH+" + V.format(e="ps") + ", " + DIST + " SELECT vertex, x AS distance FROM r25 WHERE s = 1 AND x IS NOT NULL", "fr")
def shortest_path_length(spark, d):
    return traversal.filter_unreachable(traversal.shortest_path_length(friends(spark, d), 1))


@query("WITH+" + V.format(e="ps") + ", " + DIST + " SELECT vertex, x AS cost FROM r25 WHERE s = 1 AND x IS NOT NULL", "fr")
def traversed_cost(spark, d):
    """The weights along the shortest paths add up to the distances."""
    g = friends(spark, d)
    tree, _ = written(traversal.filter_unreachable(traversal.sssp(g, 1)))
    return traversal.traversed_cost(tree, g.edges.select("src", "dst", F.col("weight").alias("value")))


@query("WITH+c(a, b) AS (SELECT src, src FROM ud UNION SELECT a, dst FROM c JOIN ud ON src = b) SELECT DISTINCT x.b AS vertex FROM c x JOIN c y ON y.a = x.b AND y.b = x.a WHERE x.a = 1", "us", True)
def strong_component_of_one(spark, d):
    return components.strong_connected_component(users(spark, d), 1)


@query("WITH+c(a, b) AS (SELECT src, src FROM ps UNION SELECT a, dst FROM c JOIN ps ON src = b) SELECT a AS vertex, min(b) AS labels FROM c GROUP BY a", "fr", True)
def connected_components(spark, d):
    return components.connected_components(friends(spark, d), "weak")


WD = ", wd AS (SELECT src, sum(weight) AS w FROM ps GROUP BY src)"
ENDS = " FROM s JOIN wd x ON x.src = first JOIN wd y ON y.src = second"
ALL_PAIRS = {"sorensen": "2 * i / (da + db)", "overlap": "i / least(da, db)", "cosine": "1.0::DOUBLE"}
WEIGHTED = {"sorensen": "2 * m / (x.w + y.w)", "overlap": "m / least(x.w, y.w)"}


def _pairs(kind: str) -> None:
    @query(f"WITH+{SIM} SELECT first, second, round({ALL_PAIRS[kind]}, 8) AS {kind}_coeff FROM s WHERE first <> second", "fr")
    def f(spark, d):
        return rounded(similarity.all_pairs(friends(spark, d), kind), f"{kind}_coeff", digits=8)

    QUERIES[f"all_pairs_{kind}"], ORACLE_SQL[f"all_pairs_{kind}"] = QUERIES.pop("f"), ORACLE_SQL.pop("f")


def _weighted(kind: str) -> None:
    @query(f"WITH+{SIM}{WD} SELECT first, second, round({WEIGHTED[kind]}, 8) AS {kind}_coeff{ENDS}", "fr")
    def f(spark, d):
        return rounded(similarity.similarity(friends(spark, d), kind, use_weight=True), f"{kind}_coeff", digits=8)

    QUERIES[f"{kind}_weighted"], ORACLE_SQL[f"{kind}_weighted"] = QUERIES.pop("f"), ORACLE_SQL.pop("f")


for _kind in ALL_PAIRS:
    _pairs(_kind)
for _kind in WEIGHTED:
    _weighted(_kind)


@query("SELECT a.src AS first, b.dst AS second, round(sum(a.weight * b.weight) / (sqrt(sum(a.weight * a.weight)) * sqrt(sum(b.weight * b.weight))), 8) AS cosine_coeff FROM ps a JOIN ps b ON a.dst = b.src GROUP BY 1, 2", "fr")
def cosine_weighted(spark, d):
    return rounded(similarity.similarity(friends(spark, d), "cosine", use_weight=True), "cosine_coeff", digits=8)


@query("WITH+" + V.format(e="geo") + " SELECT count(*) AS vertices, 0::BIGINT AS clashes FROM v", "geo")
def coloring_is_valid(spark, d):
    g = Graph.from_edgelist(tables.geography(spark, d))
    got, _ = written(components.vertex_coloring(g))
    a, b = (got.select(F.col("vertex").alias(end), F.col("color").alias(x)) for end, x in (("src", "a"), ("dst", "b")))
    clashes = g.edges.join(a, "src").join(b, "dst").where("a = b AND src != dst").agg(F.count("*").alias("clashes"))
    return got.agg(F.countDistinct("vertex").alias("vertices")).crossJoin(clashes)  # one row each


@query("SELECT 0::BIGINT AS inside, 0::BIGINT AS uncovered")
def independent_set_is_maximal(spark, d):
    g = friends(spark, d)
    got, _ = written(components.maximal_independent_set(g))
    touched = g.edges.join(got.select(F.col("vertex").alias("src")), "src", "left_semi").select(F.col("dst").alias("vertex")).distinct()
    inside = touched.join(got, "vertex", "left_semi").agg(F.count("*").alias("inside"))
    return inside.crossJoin(g.vertices().join(got, "vertex", "left_anti").join(touched, "vertex", "left_anti").agg(F.count("*").alias("uncovered")))  # one row each


@query("SELECT 0::BIGINT AS twice, 0::BIGINT AS open_edges")
def matching_is_maximal(spark, d):
    g = friends(spark, d)
    got, _ = written(components.weighted_matching(g))
    ends = got.select(F.explode(F.array("src", "dst")).alias("vertex"))
    twice = ends.groupBy("vertex").count().where("count > 1").agg(F.count("*").alias("twice"))
    free = g.edges.where("src != dst").join(ends.select(F.col("vertex").alias("src")), "src", "left_anti").join(ends.select(F.col("vertex").alias("dst")), "dst", "left_anti")
    return twice.crossJoin(free.agg(F.count("*").alias("open_edges")))  # one row each


@query("WITH+" + V.format(e="ps") + ", c(a, b) AS (SELECT vertex, vertex FROM v UNION SELECT a, dst FROM c JOIN ps ON src = b), k AS (SELECT count(DISTINCT m) AS k FROM (SELECT a, min(b) AS m FROM c GROUP BY a)) SELECT (SELECT count(*) FROM v) - k AS edges, k AS trees, true AS ordered FROM k", "fr", True)
def spanning_trees(spark, d):
    """Numbers of edges and trees of both forests, and that the least weighs no more than the largest."""
    g = friends(spark, d)
    low, _ = written(components.minimum_spanning_tree(g))
    high, _ = written(components.maximum_spanning_tree(g))
    n = g.vertices().agg(F.count("*").alias("n"))
    a, b = (t.agg(F.count("*").alias(f"m{i}"), F.sum("weight").alias(f"w{i}")) for i, t in enumerate((low, high)))
    return a.crossJoin(b).crossJoin(n).where("m0 = m1").selectExpr("m0 AS edges", "n - m0 AS trees", "w0 <= w1 AS ordered")  # one row each


def _walk_check(name: str, graph, **options) -> None:
    @query("WITH+" + V.format(e="ud") + " SELECT count(*) AS walks, 0::BIGINT AS off_edges FROM v", "us")
    def f(spark, d):
        g = graph(spark, d)
        got, _ = written(sampling.random_walks(g, users(spark, d).vertices(), 5, **options))
        steps = got.select("walk_id", (F.col("step") + 1).alias("step"), F.col("vertex").alias("src")).join(got.select("walk_id", "step", F.col("vertex").alias("dst")), ["walk_id", "step"])
        off = steps.join(g.edges.select("src", "dst").distinct(), ["src", "dst"], "left_anti").agg(F.count("*").alias("off_edges"))
        return got.where("step = 0").agg(F.count("*").alias("walks")).crossJoin(off)  # one row each

    QUERIES[name], ORACLE_SQL[name] = QUERIES.pop("f"), ORACLE_SQL.pop("f")


_walk_check("uniform_walks_follow_edges", users)
_walk_check("biased_walks_follow_edges", lambda s, d: Graph(users(s, d).edges.withColumn("weight", (F.col("dst") % 5 + 1).cast("double")), directed=True), biased=True)
_walk_check("node2vec_walks_follow_edges", users, p=0.5, q=2.0)


@query("WITH+" + V.format(e="ud") + " SELECT least(500, (SELECT count(*) FROM v) * (SELECT count(*) FROM v) - (SELECT count(*) FROM ud)) AS pairs, 0::BIGINT AS edges", "us")
def negative_samples_are_no_edges(spark, d):
    g = users(spark, d)
    got, _ = written(sampling.negative_sampling(g, 500))
    return got.agg(F.count("*").alias("pairs")).crossJoin(got.join(g.edges, ["src", "dst"], "left_semi").agg(F.count("*").alias("edges")))  # one row each


@query("SELECT sum(least(n, 2))::BIGINT AS taken, 0::BIGINT AS crowded FROM (SELECT src, count(*) AS n FROM us GROUP BY src)", "us")
def neighbor_sample_fanout(spark, d):
    """Two edges at most of each of all vertices."""
    g = events(spark, d)
    got, _ = written(sampling.neighbor_sample(g, g.vertices().selectExpr("0L AS batch_id", "vertex"), [2]))
    crowded = got.groupBy("src").count().where("count > 2").agg(F.count("*").alias("crowded"))
    return got.agg(F.count("*").alias("taken")).crossJoin(crowded)  # one row each


@query("SELECT sum(least(n, 1))::BIGINT AS taken FROM (SELECT src, edge_type, count(*) AS n FROM us GROUP BY ALL)", "us")
def heterogeneous_sample_fanout(spark, d):
    g = events(spark, d)
    return sampling.neighbor_sample(g, g.vertices().selectExpr("0L AS batch_id", "vertex"), [1], per_type=True).agg(F.count("*").alias("taken"))


def _clusters(name: str, find) -> None:
    @query("WITH+" + V.format(e="ps") + " SELECT count(*) AS vertices, true AS agrees FROM v", "fr")
    def f(spark, d):
        """All vertices have a cluster, and the modularity told is that of the clusters."""
        g = friends(spark, d)
        part, q = find(g)
        again = community.modularity(g, part.withColumnRenamed("partition", "cluster")).first()[0]
        return part.agg(F.countDistinct("vertex").alias("vertices")).withColumn("agrees", F.lit(abs(q - again) < 1e-6))

    QUERIES[name], ORACLE_SQL[name] = QUERIES.pop("f"), ORACLE_SQL.pop("f")


_clusters("louvain_clusters", community.louvain)
_clusters("leiden_clusters", community.leiden)
_clusters("ecg_clusters", lambda g: community.ecg(g, ensemble_size=4))


@query("SELECT c.n_nationkey::BIGINT AS vertex FROM nation c")
def hungarian_workers(spark, d):
    """Each of 25 nations gets a nation of its own at the least total cost."""
    n = tables.read(spark, d, "nation").selectExpr("cast(n_nationkey AS bigint) AS k")
    cost = n.selectExpr("k AS src").crossJoin(n.selectExpr("k + 100 AS dst")).selectExpr("src", "dst", "cast((src * 7 + dst * 13) % 29 AS double) AS weight")  # 625 cells are the problem
    return patterns.hungarian(Graph(cost, directed=True), n.selectExpr("k AS vertex"))[1].select("vertex")


@query("SELECT i AS src, i + s AS dst FROM range(0, 210) t(i), (VALUES (1), (6), (42)) x(s) WHERE CASE s WHEN 1 THEN i % 6 < 5 WHEN 6 THEN i // 6 % 7 < 6 ELSE i // 42 < 4 END")
def mesh_3d(spark, d):
    return generators.mesh_3d(spark, 6, 7, 5)


@query("SELECT i AS src, 20 + j AS dst FROM range(0, 20) a(i), range(0, 30) b(j)")
def complete_bipartite(spark, d):
    return generators.complete_bipartite(spark, 20, 30).select("src", "dst")


@query("SELECT 20000::BIGINT AS edges, 0::BIGINT AS outside")
def rmat_bipartite_bounds(spark, d):
    e = generators.rmat(spark, 9, 20_000, dst_scale=7)
    return e.agg(F.count("*").alias("edges"), F.coalesce(F.sum(F.expr("cast(src < 0 OR src >= 512 OR dst < 0 OR dst >= 128 AS bigint)")), F.lit(0)).alias("outside"))


@query("SELECT 4096::BIGINT AS ids")
def scrambled_ids(spark, d):
    """The mixing is one to one."""
    return generators.scramble_ids(spark.range(4096).selectExpr("id AS src", "id AS dst"), 12).agg(F.countDistinct("src").alias("ids"))
