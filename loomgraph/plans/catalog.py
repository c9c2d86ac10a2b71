"""Registered graph queries over the business tables' graphs, and SQL for each where SQL can say it.

Iterations without a fixpoint test run a fixed number of rounds on both sides; the
SQL side has them unrolled. Doubles are rounded on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.graph import Graph
from loomgraph.operators import centrality, community, components, patterns, sampling, similarity, structure, traversal
from loomgraph.sources import generators, tables
from loomgraph.sources.tables import SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, base: str = "", recursive: bool = False):
    """Registers a function under its name; ``base`` names the graph's SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            first = SQL[base] + (", " if sql.lstrip().startswith("WITH+") else " ") if base else ""
            body = sql.lstrip().removeprefix("WITH+") if base else sql
            ORACLE_SQL[f.__name__] = (f"WITH {'RECURSIVE ' if recursive else ''}{first}{body}") if base else sql
        return f

    return add


def customers(spark, d) -> Graph:
    return Graph(tables.customer_supplier(spark, d), directed=True)


def parts(spark, d) -> Graph:
    return Graph.from_edgelist(tables.parts_together(spark, d, distinct=False), weight="weight")


def friends(spark, d) -> Graph:
    return Graph.from_edgelist(tables.users_together(spark, d, distinct=False), weight="weight")


def users(spark, d) -> Graph:
    return Graph(tables.user_sequence(spark, d).select("src", "dst").distinct(), directed=True)


def events(spark, d) -> Graph:
    return Graph(tables.user_sequence(spark, d), directed=True, multi=True)


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in cols})


def some(spark, *ids: int) -> DataFrame:
    return spark.createDataFrame([(i,) for i in ids], "vertex bigint")


def chain(first: str, step: str, n: int) -> str:
    """``r0`` and the rounds r1 to rn, where ``{p}`` is the one before."""
    return ", ".join([f"r0 AS MATERIALIZED ({first})", *[f"r{i} AS MATERIALIZED ({step.format(p=f'r{i - 1}')})" for i in range(1, n + 1)]])


V = "v AS (SELECT src AS vertex FROM {e} UNION SELECT dst FROM {e})"
ROUNDS = 10

PR = V.format(e="cs") + ", o AS (SELECT src, count(*)::DOUBLE AS w FROM cs GROUP BY src), n AS (SELECT count(*)::DOUBLE AS n FROM v), " + chain(
    "SELECT vertex, 1 / n AS x FROM v, n",
    "SELECT v.vertex, 0.85 * coalesce(g.s, 0) + (0.85 * d.s + 0.15) / n.n AS x FROM v LEFT JOIN (SELECT dst AS vertex, sum(x / w) AS s FROM cs JOIN {p} ON {p}.vertex = cs.src JOIN o ON o.src = cs.src GROUP BY dst) g ON g.vertex = v.vertex, (SELECT sum(x) AS s FROM {p} WHERE vertex NOT IN (SELECT src FROM o)) d, n",
    ROUNDS,
)


@query(f"WITH+{PR} SELECT vertex, round(x, 8) AS pagerank FROM r{ROUNDS} ORDER BY pagerank DESC, vertex LIMIT 10", "cs")
def pagerank(spark, d):
    """The ten highest after ten rounds."""
    got = centrality.pagerank(customers(spark, d), max_iter=ROUNDS, tol=None)
    return rounded(got, "pagerank", digits=8).orderBy(F.desc("pagerank"), "vertex").limit(10)


@query(f"WITH+{PR} SELECT vertex, round(x, 8) AS pagerank FROM r{ROUNDS}", "cs")
def pagerank_all(spark, d):
    return rounded(centrality.pagerank(customers(spark, d), max_iter=ROUNDS, tol=None), "pagerank", digits=8)


@query(
    "WITH+" + V.format(e="ud") + ", o AS (SELECT src, count(*)::DOUBLE AS w FROM ud GROUP BY src), " + chain("SELECT vertex, 1.0::DOUBLE / (SELECT count(*) FROM v) AS x FROM v", "SELECT v.vertex, 0.85 * coalesce(g.s, 0) + (0.85 * coalesce(d.s, 0) + 0.15) * CASE v.vertex WHEN 1 THEN 0.25 WHEN 2 THEN 0.75 ELSE 0 END AS x FROM v LEFT JOIN (SELECT dst AS vertex, sum(x / w) AS s FROM ud JOIN {p} ON {p}.vertex = ud.src JOIN o ON o.src = ud.src GROUP BY dst) g ON g.vertex = v.vertex, (SELECT sum(x) AS s FROM {p} WHERE vertex NOT IN (SELECT src FROM o)) d", 8) + " SELECT vertex, round(x, 8) AS pagerank FROM r8",
    "us",
)
def pagerank_personalized(spark, d):
    to = spark.createDataFrame([(1, 1.0), (2, 3.0)], "vertex bigint, value double")
    return rounded(centrality.pagerank(users(spark, d), personalization=to, max_iter=8, tol=None), "pagerank", digits=8)


@query(
    "WITH+" + V.format(e="ud") + ", r0 AS MATERIALIZED (SELECT vertex, 1.0::DOUBLE / (SELECT count(*) FROM v) AS h, 0.0::DOUBLE AS a FROM v), " + ", ".join(f"a{i} AS MATERIALIZED (SELECT v.vertex, coalesce(s, 0) / (max(coalesce(s, 0)) OVER ()) AS a FROM v LEFT JOIN (SELECT dst AS vertex, sum(h) AS s FROM ud JOIN r{i - 1} ON r{i - 1}.vertex = src GROUP BY dst) g ON g.vertex = v.vertex), r{i} AS MATERIALIZED (SELECT a{i}.vertex, coalesce(s, 0) / (max(coalesce(s, 0)) OVER ()) AS h, a{i}.a FROM a{i} LEFT JOIN (SELECT src AS vertex, sum(a) AS s FROM ud JOIN a{i} ON a{i}.vertex = dst GROUP BY src) g ON g.vertex = a{i}.vertex)" for i in range(1, 6)) + " SELECT vertex, round(h / sum(h) OVER (), 8) AS hubs, round(a / sum(a) OVER (), 8) AS authorities FROM r5",
    "us",
)
def hits(spark, d):
    return rounded(centrality.hits(users(spark, d), max_iter=5, tol=None), "hubs", "authorities", digits=8)


@query("WITH+" + V.format(e="ps") + ", " + chain("SELECT vertex, 0.0::DOUBLE AS x FROM v", "SELECT v.vertex, 0.0001 * coalesce(s, 0) + 1 AS x FROM v LEFT JOIN (SELECT dst AS vertex, sum(weight * x) AS s FROM ps JOIN {p} ON {p}.vertex = src GROUP BY dst) g ON g.vertex = v.vertex", 8) + " SELECT vertex, round(x / sqrt(sum(x * x) OVER ()), 8) AS katz_centrality FROM r8", "pt")
def katz_centrality(spark, d):
    return rounded(centrality.katz_centrality(parts(spark, d), alpha=0.0001, max_iter=8, tol=None), "katz_centrality", digits=8)


@query("WITH+" + V.format(e="ps") + ", " + chain("SELECT vertex, 1.0::DOUBLE / (SELECT count(*) FROM v) AS x FROM v", "SELECT vertex, y / sqrt(sum(y * y) OVER ()) AS x FROM (SELECT {p}.vertex, {p}.x + coalesce(s, 0) AS y FROM {p} LEFT JOIN (SELECT dst AS vertex, sum(weight * x) AS s FROM ps JOIN {p} ON {p}.vertex = src GROUP BY dst) g ON g.vertex = {p}.vertex)", 6) + " SELECT vertex, round(x, 8) AS eigenvector_centrality FROM r6", "pt")
def eigenvector_centrality(spark, d):
    return rounded(centrality.eigenvector_centrality(parts(spark, d), max_iter=6, tol=None), "eigenvector_centrality", digits=8)


DEG = "deg AS (SELECT vertex, sum(i)::BIGINT AS in_degree, sum(o)::BIGINT AS out_degree FROM (SELECT src AS vertex, 0 AS i, 1 AS o FROM {e} UNION ALL SELECT dst, 1, 0 FROM {e}) GROUP BY vertex)"


@query("WITH+" + DEG.format(e="ud") + " SELECT vertex, in_degree, out_degree, in_degree + out_degree AS degree FROM deg", "us")
def degrees(spark, d):
    return structure.degrees(users(spark, d))


@query("WITH+" + DEG.format(e="ps") + " SELECT vertex, round((in_degree + out_degree) / ((SELECT count(*) FROM deg) - 1), 8) AS degree_centrality FROM deg", "pt")
def degree_centrality(spark, d):
    return rounded(centrality.degree_centrality(parts(spark, d)), "degree_centrality", digits=8)


@query("WITH+" + V.format(e="ps") + " SELECT round(2.0 * (SELECT count(*) FROM ps) / (count(*) * (count(*) - 1)), 8) AS density FROM v", "pt")
def density(spark, d):
    return rounded(structure.density(parts(spark, d)), "density", digits=8)


@query("SELECT src, dst, count(*) AS multiplicity FROM us GROUP BY src, dst", "us")
def multiplicity(spark, d):
    return structure.multiplicity(events(spark, d).edges)


@query("SELECT sum(CASE WHEN src = dst THEN 1 ELSE 0 END)::BIGINT AS self_loops, (count(*) - (SELECT count(*) FROM ud))::BIGINT AS multi_edges FROM us", "us")
def loop_counts(spark, d):
    return structure.loop_counts(events(spark, d).edges)


@query("SELECT src, dst, edge_id FROM us WHERE src <> dst", "us")
def remove_self_loops(spark, d):
    return structure.remove_self_loops(events(spark, d).edges.select("src", "dst", "edge_id"))


@query("SELECT src, dst, min(edge_id) AS edge_id FROM us GROUP BY src, dst", "us")
def remove_multi_edges(spark, d):
    return structure.remove_multi_edges(events(spark, d).edges.select("src", "dst", "edge_id"))


SYM = "w AS (SELECT src, dst, min(edge_id)::DOUBLE AS weight FROM us GROUP BY src, dst), p AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, {f}(weight) AS weight, count(*) AS n FROM w GROUP BY 1, 2)"


@query("WITH+" + SYM.format(f="avg") + " SELECT a AS src, b AS dst, weight FROM p UNION ALL SELECT b, a, weight FROM p WHERE a <> b", "us")
def symmetrize_mean(spark, d):
    return structure.symmetrize(events(spark, d).edges.select("src", "dst", F.col("edge_id").cast("double").alias("weight")))


@query("WITH+" + SYM.format(f="min") + " SELECT a AS src, b AS dst, weight FROM p WHERE n = 2 OR a = b UNION ALL SELECT b, a, weight FROM p WHERE n = 2 AND a <> b", "us")
def symmetrize_reciprocal(spark, d):
    return structure.symmetrize(events(spark, d).edges.select("src", "dst", F.col("edge_id").cast("double").alias("weight")), how="min", reciprocal=True)


@query("SELECT least(src, dst) AS src, greatest(src, dst) AS dst, min(edge_id)::DOUBLE AS weight FROM us GROUP BY 1, 2", "us")
def edge_list(spark, d):
    """Build: merge parallel edges, symmetrise by the least, then the upper triangle."""
    return Graph.from_edgelist(events(spark, d).edges, weight="edge_id").edge_list()


@query("SELECT dst AS src, src AS dst FROM ud", "us")
def transpose(spark, d):
    return structure.transpose(users(spark, d).edges)


@query("SELECT src, array_to_string(list_sort(list(dst)), ',') AS neighbors FROM ud GROUP BY src", "us")
def adjacency(spark, d):
    return structure.adjacency(users(spark, d).edges).select("src", F.expr("array_join(neighbors, ',')").alias("neighbors"))


@query("WITH+" + V.format(e="ud") + " SELECT vertex FROM v", "us")
def vertices(spark, d):
    return users(spark, d).vertices()


@query("SELECT vertex, sum(i) AS in_weight, sum(o) AS out_weight FROM (SELECT src AS vertex, 0.0::DOUBLE AS i, weight AS o FROM ps UNION ALL SELECT dst, weight, 0.0 FROM ps) GROUP BY vertex", "pt")
def weight_sums(spark, d):
    return structure.weight_sums(parts(spark, d))


@query("SELECT src % 10 AS src, dst % 10 AS dst, sum(weight) AS weight FROM ps GROUP BY 1, 2", "pt")
def coarsen(spark, d):
    g = parts(spark, d)
    return structure.coarsen(g, g.vertices().withColumn("label", F.col("vertex") % 10))


@query("SELECT src % 10 AS subgraph, src, dst, weight FROM ps WHERE src % 10 = dst % 10", "pt")
def induced_subgraph(spark, d):
    g = parts(spark, d)
    return structure.induced_subgraph(g, g.vertices().withColumn("subgraph", F.col("vertex") % 10))


@query("SELECT DISTINCT a.src AS first, b.dst AS second FROM ps a JOIN ps b ON a.dst = b.src", "fr")
def two_hop(spark, d):
    return structure.two_hop(friends(spark, d))


@query("SELECT DISTINCT a.src AS start, c.dst AS vertex FROM ud a JOIN ud b ON a.dst = b.src JOIN ud c ON b.dst = c.src WHERE a.src IN (1, 2, 3)", "us")
def k_hop(spark, d):
    return structure.k_hop(users(spark, d), some(spark, 1, 2, 3), 3)


@query("WITH+" + V.format(e="ud") + " SELECT row_number() OVER (ORDER BY vertex) - 1 AS id, vertex AS k0 FROM v", "us")
def renumber(spark, d):
    return structure.renumber(users(spark, d).edges, [["src"], ["dst"]])


@query("SELECT concat('event_id::', c_custkey) AS src, concat('c_mktsegment::', c_mktsegment) AS dst, 'c_mktsegment' AS edge_type FROM customer UNION ALL SELECT concat('event_id::', c_custkey), concat('c_nationkey::', c_nationkey), 'c_nationkey' FROM customer")
def hypergraph(spark, d):
    return structure.hypergraph(tables.read(spark, d, "customer"), ["c_mktsegment", "c_nationkey"], "c_custkey")[1]


@query("SELECT r AS edge_id, (r % 3)::INTEGER AS edge_type, coalesce(src, -1) AS src, coalesce(dst, -1) AS dst FROM (SELECT event_id AS r FROM events) LEFT JOIN us ON us.edge_id = r", "us")
def edge_lookup(spark, d):
    return structure.edge_lookup(events(spark, d).edges, tables.read(spark, d, "events").select(F.col("event_id").alias("edge_id"), (F.col("event_id") % 3).cast("int").alias("edge_type")))


BFS = "b(vertex, distance) AS (SELECT vertex, 0 FROM v WHERE vertex = (SELECT min(vertex) FROM v) UNION SELECT dst, distance + 1 FROM b JOIN ps ON src = b.vertex WHERE distance < 40)"


@query("WITH+" + V.format(e="ps") + ", " + BFS + " SELECT v.vertex, coalesce(min(distance), 2147483647)::INTEGER AS distance FROM v LEFT JOIN b ON b.vertex = v.vertex GROUP BY v.vertex", "pt", True)
def bfs(spark, d):
    g = parts(spark, d)
    return traversal.bfs(g, g.vertices().agg(F.min("vertex").alias("vertex"))).select("vertex", "distance")


SSSP = chain("SELECT vertex, CASE WHEN vertex = (SELECT min(vertex) FROM v) THEN 0.0::DOUBLE END AS x FROM v", "SELECT {p}.vertex, least({p}.x, s) AS x FROM {p} LEFT JOIN (SELECT dst AS vertex, min(x + weight) AS s FROM ps JOIN {p} ON {p}.vertex = src GROUP BY dst) g ON g.vertex = {p}.vertex", 40)


@query("WITH+" + V.format(e="ps") + ", " + SSSP + " SELECT vertex, x AS distance FROM r40 WHERE x IS NOT NULL", "pt")
def sssp(spark, d):
    g = parts(spark, d)
    return traversal.filter_unreachable(traversal.sssp(g, g.vertices().agg(F.min("vertex")).first()[0]).select("vertex", "distance"))


@query("WITH+b(source, vertex, distance) AS (SELECT v, v, 0 FROM (VALUES (1::BIGINT), (2), (3)) t(v) UNION SELECT source, dst, distance + 1 FROM b JOIN ud ON src = vertex WHERE distance < 3) SELECT source, vertex, min(distance)::INTEGER AS distance FROM b GROUP BY source, vertex", "us", True)
def multi_source_bfs(spark, d):
    return traversal.multi_source_bfs(users(spark, d), some(spark, 1, 2, 3), 3).select("source", "vertex", "distance")


@query("SELECT r.src AS destination, 0 AS step, r.src AS vertex FROM (SELECT c_custkey + 1000 AS src, c_nationkey + 100::BIGINT AS n FROM customer) r UNION ALL SELECT c_custkey + 1000, 1, c_nationkey + 100::BIGINT FROM customer UNION ALL SELECT c_custkey + 1000, 2, n_regionkey::BIGINT FROM customer JOIN nation ON n_nationkey = c_nationkey")
def extract_paths(spark, d):
    g = Graph(tables.geography(spark, d), directed=True)
    tree = traversal.bfs(g, some(spark, 0, 1, 2, 3, 4))
    return traversal.extract_paths(tree, tree.where(f"vertex BETWEEN 1000 AND {tables.SUPPLIER_BASE - 1}").select("vertex"))


@query("SELECT DISTINCT vertex, level FROM (SELECT r_regionkey::BIGINT AS vertex, 0 AS level FROM region UNION ALL SELECT n_nationkey + 100::BIGINT, 1 FROM nation UNION ALL SELECT c_custkey + 1000, 2 FROM customer UNION ALL SELECT s_suppkey + 10000000, 2 FROM supplier)")
def topological_sort(spark, d):
    return components.topological_sort(Graph(tables.geography(spark, d), directed=True))


@query("WITH+" + V.format(e="ps") + ", " + chain("SELECT vertex, vertex AS x FROM v", "SELECT {p}.vertex, least({p}.x, coalesce(s, {p}.x)) AS x FROM {p} LEFT JOIN (SELECT dst AS vertex, min(x) AS s FROM ps JOIN {p} ON {p}.vertex = src GROUP BY dst) g ON g.vertex = {p}.vertex", 25) + " SELECT vertex, x AS labels FROM r25", "pt")
def weakly_connected_components(spark, d):
    return components.weakly_connected_components(parts(spark, d))


@query("WITH+" + V.format(e="ud") + ", c(a, b) AS (SELECT vertex, vertex FROM v UNION SELECT a, dst FROM c JOIN ud ON src = b) SELECT x.a AS vertex, min(x.b) AS labels FROM c x JOIN c y ON x.a = y.b AND x.b = y.a GROUP BY x.a", "us", True)
def strongly_connected_components(spark, d):
    return components.strongly_connected_components(users(spark, d))


HIDX = chain("SELECT src AS vertex, count(*) AS x FROM ps GROUP BY src", "SELECT vertex, max(least(i, x)) AS x FROM (SELECT src AS vertex, x, row_number() OVER (PARTITION BY src ORDER BY x DESC) AS i FROM ps JOIN {p} ON {p}.vertex = dst) GROUP BY vertex", 25)


@query("WITH+" + HIDX + " SELECT vertex, x::BIGINT AS core_number FROM r25", "pt")
def core_number(spark, d):
    return components.core_number(parts(spark, d))


@query("WITH+" + HIDX + " SELECT src, dst, weight FROM ps JOIN r25 a ON a.vertex = src JOIN r25 b ON b.vertex = dst WHERE a.x >= 4 AND b.x >= 4", "pt")
def k_core(spark, d):
    return components.k_core(parts(spark, d), 4)


TRI = "t AS (SELECT a.src AS a, a.dst AS b, b.dst AS c FROM pt a JOIN pt b ON a.dst = b.src JOIN pt c ON c.src = a.src AND c.dst = b.dst)"


@query("WITH+" + V.format(e="ps") + ", " + TRI + " SELECT v.vertex, count(x) AS counts FROM v LEFT JOIN (SELECT unnest([a, b, c]) AS x FROM t) ON x = v.vertex GROUP BY v.vertex", "pt")
def triangle_count(spark, d):
    return community.triangle_count(parts(spark, d))


@query("WITH+" + TRI + ", e AS (SELECT a AS src, b AS dst FROM t UNION ALL SELECT a, c FROM t UNION ALL SELECT b, c FROM t) SELECT pt.src, pt.dst, count(e.src) AS counts FROM pt LEFT JOIN e ON e.src = pt.src AND e.dst = pt.dst GROUP BY pt.src, pt.dst", "pt")
def edge_triangle_count(spark, d):
    return community.edge_triangle_count(parts(spark, d))


@query("WITH+" + chain("SELECT src, dst FROM pt", "SELECT e.src, e.dst FROM {p} e JOIN (SELECT unnest([struct_pack(s := a.src, d := a.dst), struct_pack(s := a.src, d := b.dst), struct_pack(s := b.src, d := b.dst)]) AS x FROM {p} a JOIN {p} b ON a.dst = b.src JOIN {p} c ON c.src = a.src AND c.dst = b.dst) t ON t.x.s = e.src AND t.x.d = e.dst GROUP BY e.src, e.dst HAVING count(*) >= 1", 12) + " SELECT src, dst FROM r12", "pt")
def k_truss(spark, d):
    return community.k_truss(parts(spark, d), 3)


@query("WITH+b AS (SELECT s AS subgraph, s AS vertex FROM (VALUES (1::BIGINT), (7)) t(s) UNION SELECT src, dst FROM ud WHERE src IN (1, 7)) SELECT a.subgraph, ud.src, ud.dst FROM ud JOIN b a ON a.vertex = ud.src JOIN b c ON c.vertex = ud.dst AND c.subgraph = a.subgraph", "us")
def ego_graph(spark, d):
    return community.ego_graph(users(spark, d), some(spark, 1, 7), 1)


CLUSTERS = "l AS (SELECT src, dst, weight, src % 5 AS a, dst % 5 AS b FROM ps)"


@query("WITH+" + CLUSTERS + ", k AS (SELECT a, sum(weight) AS k, sum(CASE WHEN a = b THEN weight ELSE 0 END) AS i FROM l GROUP BY a), t AS (SELECT sum(weight) AS t FROM ps) SELECT round(sum(i / t - (k / t) * (k / t)), 8) AS modularity FROM k, t", "pt")
def modularity(spark, d):
    g = parts(spark, d)
    return rounded(community.modularity(g, g.vertices().withColumn("cluster", F.col("vertex") % 5)), "modularity", digits=8)


@query("WITH+" + V.format(e="ps") + ", " + CLUSTERS + ", c AS (SELECT a, sum(weight) AS c FROM l WHERE a <> b GROUP BY a), n AS (SELECT vertex % 5 AS a, count(*) AS n FROM v GROUP BY 1) SELECT round(sum(c) / 2, 6) AS edge_cut, round(sum(c / n), 6) AS ratio_cut FROM n JOIN c ON c.a = n.a", "pt")
def edge_cut(spark, d):
    g = parts(spark, d)
    return rounded(community.edge_cut(g, g.vertices().withColumn("cluster", F.col("vertex") % 5)), "edge_cut", "ratio_cut")


SIM = "{v}, dg AS (SELECT src, count(*)::DOUBLE AS d FROM ps GROUP BY src), pr AS (SELECT a.src AS first, b.dst AS second, count(*)::DOUBLE AS i, sum(least(a.weight, b.weight)) AS m FROM ps a JOIN ps b ON a.dst = b.src GROUP BY 1, 2), s AS (SELECT pr.*, x.d AS da, y.d AS db FROM pr JOIN dg x ON x.src = first JOIN dg y ON y.src = second)".format(v=V.format(e="ps"))


def _similar(kind: str, sql: str):
    @query(f"WITH+{SIM} SELECT first, second, round({sql}, 8) AS {kind}_coeff FROM s", "fr")
    def f(spark, d):
        return rounded(similarity.similarity(friends(spark, d), kind), f"{kind}_coeff", digits=8)

    QUERIES[kind], ORACLE_SQL[kind] = QUERIES.pop("f"), ORACLE_SQL.pop("f")


_similar("jaccard", "i / (da + db - i)")
_similar("sorensen", "2 * i / (da + db)")
_similar("overlap", "i / least(da, db)")
_similar("cosine", "CASE WHEN i > 0 THEN 1.0::DOUBLE ELSE 0 END")


@query(f"WITH+{SIM}, wd AS (SELECT src, sum(weight) AS w FROM ps GROUP BY src) SELECT first, second, round(m / (x.w + y.w - m), 8) AS jaccard_coeff FROM s JOIN wd x ON x.src = first JOIN wd y ON y.src = second", "fr")
def jaccard_weighted(spark, d):
    return rounded(similarity.similarity(friends(spark, d), "jaccard", use_weight=True), "jaccard_coeff", digits=8)


@query(f"WITH+{SIM} SELECT first, second, round(i / (da + db - i), 8) AS jaccard_coeff FROM s WHERE first <> second ORDER BY i / (da + db - i) DESC, first, second LIMIT 25", "fr")
def all_pairs_jaccard(spark, d):
    return rounded(similarity.all_pairs(friends(spark, d), "jaccard", topk=25), "jaccard_coeff", digits=8)


@query("SELECT a.src AS \"1\", a.dst AS \"2\", b.dst AS \"3\" FROM ps a JOIN ps b ON a.dst = b.src JOIN ps c ON c.src = b.dst AND c.dst = a.src", "fr")
def subgraph_monomorphism(spark, d):
    return patterns.subgraph_monomorphism(friends(spark, d), [(1, 2), (2, 3), (3, 1)])


@query("SELECT i AS src, i + 1 AS dst FROM range(0, 99) t(i)")
def path_graph(spark, d):
    return generators.path_graph(spark, 100)


@query("SELECT i AS src, i + 1 AS dst FROM range(0, 48) t(i) WHERE i % 8 < 7 UNION ALL SELECT i, i + 8 FROM range(0, 40) t(i)")
def mesh_2d(spark, d):
    return generators.mesh_2d(spark, 8, 6)


@query("SELECT i AS src, j AS dst FROM range(0, 30) a(i), range(0, 30) b(j) WHERE i < j")
def complete_graph(spark, d):
    return generators.complete_graph(spark, 30)


@query("SELECT 0::BIGINT AS batch_id, 0 AS hop_id, src, dst, edge_id, start_time, edge_type FROM us WHERE src IN (1, 2, 3)", "us")
def neighbor_sample_all(spark, d):
    """A fan-out of -1 takes every edge."""
    return sampling.neighbor_sample(events(spark, d), some(spark, 1, 2, 3).withColumn("batch_id", F.lit(0).cast("bigint")), [-1])


@query("WITH+h AS (SELECT src, dst, edge_id, start_time, edge_type FROM us WHERE src = 1), f AS (SELECT DISTINCT dst AS vertex, start_time AS t FROM h) SELECT 0::BIGINT AS batch_id, 0 AS hop_id, * FROM h UNION ALL SELECT 0, 1, us.src, us.dst, us.edge_id, us.start_time, us.edge_type FROM us JOIN f ON f.vertex = us.src AND us.start_time > f.t", "us")
def temporal_neighbor_sample(spark, d):
    seeds = some(spark, 1).select(F.lit(0).cast("bigint").alias("batch_id"), "vertex", F.lit(0).cast("bigint").alias("time"))
    return sampling.neighbor_sample(events(spark, d), seeds, [-1, -1], temporal="strictly_increasing")


@query()
def uniform_random_walks(spark, d):
    return sampling.random_walks(users(spark, d), some(spark, 1, 2, 3), 5)


@query()
def biased_random_walks(spark, d):
    return sampling.random_walks(parts(spark, d), parts(spark, d).vertices().orderBy("vertex").limit(5), 4, biased=True)


@query()
def node2vec_random_walks(spark, d):
    return sampling.random_walks(users(spark, d), some(spark, 1, 2, 3), 4, p=0.5, q=2.0)


@query()
def negative_sampling(spark, d):
    return sampling.negative_sampling(users(spark, d), 100)


@query()
def minimum_spanning_tree(spark, d):
    return components.minimum_spanning_tree(parts(spark, d))


@query()
def weighted_matching(spark, d):
    return components.weighted_matching(parts(spark, d))


@query()
def maximal_independent_set(spark, d):
    return components.maximal_independent_set(parts(spark, d))


LEVELS = 9
#: Distances and numbers of shortest paths of all pairs, level by level.
PATHS = V.format(e="ud") + ", d0 AS MATERIALIZED (SELECT vertex AS s, vertex AS t, 0 AS d, 1.0::DOUBLE AS n FROM v), " + ", ".join(f"d{i} AS MATERIALIZED (SELECT * FROM d{i - 1} UNION ALL SELECT s, dst AS t, {i} AS d, sum(n) AS n FROM d{i - 1} a JOIN ud ON src = a.t WHERE a.d = {i - 1} AND NOT EXISTS (SELECT 1 FROM d{i - 1} x WHERE x.s = a.s AND x.t = ud.dst) GROUP BY s, dst)" for i in range(1, LEVELS + 1))


@query(f"WITH+{PATHS}, b AS (SELECT a.t AS vertex, sum(a.n * c.n / st.n) AS b FROM d{LEVELS} a JOIN d{LEVELS} c ON c.s = a.t JOIN d{LEVELS} st ON st.s = a.s AND st.t = c.t WHERE a.d > 0 AND c.d > 0 AND st.d = a.d + c.d GROUP BY a.t) SELECT v.vertex, round(coalesce(b, 0) / ((SELECT (count(*) - 1.0) * (count(*) - 2) FROM v)), 8) AS betweenness_centrality FROM v LEFT JOIN b ON b.vertex = v.vertex", "us")
def betweenness_centrality(spark, d):
    return rounded(centrality.betweenness_centrality(users(spark, d)), "betweenness_centrality", digits=8)


@query(f"WITH+{PATHS} SELECT count(*) AS edges, round((SELECT sum(d) FROM d{LEVELS}) / (SELECT count(*) * (count(*) - 1.0) FROM v), 6) AS total FROM ud", "us")
def edge_betweenness_total(spark, d):
    """All edges' values add up to the mean distance: every shortest path counts once for each of its edges."""
    got = centrality.edge_betweenness_centrality(users(spark, d))
    return got.agg(F.count("*").alias("edges"), F.round(F.sum("betweenness_centrality"), 6).alias("total"))


@query()
def louvain(spark, d):
    return community.louvain(friends(spark, d))[0]


@query()
def rmat(spark, d):
    return generators.rmat(spark, 10, 5000)
