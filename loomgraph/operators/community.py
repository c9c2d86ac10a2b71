"""Communities: triangles, trusses, ego graphs, modularity methods and measures of a clustering."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.graph import Graph
from loomgraph.operators.structure import induced_subgraph
from loomgraph.operators.traversal import multi_source_bfs
from loomgraph.plans import blocks
from loomgraph.plans.shared import forget, written


def _oriented(g: Graph) -> DataFrame:
    """Each edge once, from the end of lower degree: a hub's many edges point at it, so no vertex has many going out."""
    e = g.edges.where("src != dst").select("src", "dst").distinct()
    d = e.groupBy(F.col("src").alias("v")).agg(F.count("*").alias("d"))
    both = e.where("src < dst").join(d.select(F.col("v").alias("src"), F.col("d").alias("ds")), "src").join(d.select(F.col("v").alias("dst"), F.col("d").alias("dd")), "dst")
    first = F.expr("ds < dd OR (ds = dd AND src < dst)")
    return both.select(F.when(first, F.col("src")).otherwise(F.col("dst")).alias("u"), F.when(first, F.col("dst")).otherwise(F.col("src")).alias("v"))


def triangles(g: Graph) -> DataFrame:
    """(a, b, c) of every triangle once."""
    if blocks.numbered(g.edges):
        return blocks.shared_by_edges(blocks.cut(g.edges.where("src < dst").select("src", "dst")), ("a", "b", "c"))
    o, _ = written(_oriented(g))
    wedge = o.select(F.col("u").alias("a"), F.col("v").alias("b")).join(o.select(F.col("u").alias("a"), F.col("v").alias("c")), "a").where("b != c")
    return wedge.join(o.select(F.col("u").alias("b"), F.col("v").alias("c")), ["b", "c"]).select("a", "b", "c")


def _sides(t: DataFrame) -> DataFrame:
    """src, dst of the three edges of each triangle, src < dst."""
    x = t.select(F.explode(F.array(F.struct("a", "b"), F.struct("a", F.col("c").alias("b")), F.struct(F.col("b").alias("a"), F.col("c").alias("b")))).alias("x"))
    return x.select(F.least("x.a", "x.b").alias("src"), F.greatest("x.a", "x.b").alias("dst"))


def triangle_count(g: Graph, start: DataFrame | None = None) -> DataFrame:
    """vertex, counts."""
    n = triangles(g).select(F.explode(F.array("a", "b", "c")).alias("vertex")).groupBy("vertex").agg(F.count("*").alias("counts"))
    return (g.vertices() if start is None else start.select("vertex")).join(n, "vertex", "left").fillna(0, ["counts"])


def edge_triangle_count(g: Graph) -> DataFrame:
    """src, dst, counts of each edge, src < dst."""
    t = _sides(triangles(g)).groupBy("src", "dst").agg(F.count("*").alias("counts"))
    return g.edges.where("src < dst").select("src", "dst").distinct().join(t, ["src", "dst"], "left").fillna(0, ["counts"])


def k_truss(g: Graph, k: int) -> DataFrame:
    """src, dst, src < dst: the largest set of edges that each lie in k - 2 of its triangles. Triangles are found once; those with an edge that lies in too few go, until none has one."""
    if k <= 2:
        return g.edges.where("src < dst").select("src", "dst").distinct()
    t, path = written(triangles(g))
    while True:
        support = _sides(t).groupBy("src", "dst").agg(F.count("*").alias("n"))
        if k == 3:  # an edge of a triangle lies in one
            return support.select("src", "dst")
        weak, weak_path = written(support.where(F.col("n") < k - 2).select("src", "dst"))
        if weak.isEmpty():
            return support.select("src", "dst")
        left = t
        for a, b in (("a", "b"), ("a", "c"), ("b", "c")):
            left = left.withColumns({"src": F.least(a, b), "dst": F.greatest(a, b)}).join(weak, ["src", "dst"], "left_anti").select("a", "b", "c")
        old, (t, path) = path, written(left)
        forget(g.edges.sparkSession, old)
        forget(g.edges.sparkSession, weak_path)


def ego_graph(g: Graph, seeds: DataFrame, radius: int = 1) -> DataFrame:
    """subgraph, src, dst...: edges among what lies within ``radius`` of each seed."""
    ball = multi_source_bfs(g, seeds, radius).select(F.col("source").alias("subgraph"), "vertex")
    return induced_subgraph(g, ball)


def modularity(g: Graph, clusters: DataFrame, resolution: float = 1.0) -> DataFrame:
    """One row: modularity of (vertex, cluster) on an undirected graph."""
    w = g.weights()
    total = w.agg(F.sum("weight").alias("t"))
    inside = w.join(clusters.select(F.col("vertex").alias("src"), F.col("cluster").alias("a")), "src").join(clusters.select(F.col("vertex").alias("dst"), F.col("cluster").alias("b")), "dst")
    per = inside.groupBy("a").agg(F.sum("weight").alias("k"), F.sum(F.when(F.col("a") == F.col("b"), F.col("weight")).otherwise(0.0)).alias("i"))
    return per.crossJoin(F.broadcast(total)).agg(F.sum(F.expr(f"i / t - {float(resolution)!r}D * (k / t) * (k / t)")).alias("modularity"))


def edge_cut(g: Graph, clusters: DataFrame) -> DataFrame:
    """One row: edge_cut, the weight between clusters (each edge once), and ratio_cut, the sum of each cluster's cut by its size."""
    size = clusters.groupBy(F.col("cluster").alias("a")).agg(F.count("*").alias("n"))
    cut = g.weights().join(clusters.select(F.col("vertex").alias("src"), F.col("cluster").alias("a")), "src").join(clusters.select(F.col("vertex").alias("dst"), F.col("cluster").alias("b")), "dst").where("a != b").groupBy("a").agg(F.sum("weight").alias("c"))
    return size.join(cut, "a", "left").fillna(0.0, ["c"]).agg((F.sum("c") / 2).alias("edge_cut"), F.sum(F.col("c") / F.col("n")).alias("ratio_cut"))


def _moves(e: DataFrame, state: DataFrame, m2: float, resolution: float, up: bool, within: DataFrame | None = None) -> DataFrame:
    """One sweep: each vertex goes to the neighbouring cluster of the best gain in modularity, up or down in the order of cluster ids only, so that no two swap."""
    k = state.select("vertex", "cluster", "k")
    sigma = k.groupBy("cluster").agg(F.sum("k").alias("s"))
    at = e.where("src != dst").join(k.select(F.col("vertex").alias("dst"), F.col("cluster").alias("c")), "dst")
    if within is not None:
        at = at.join(within.select(F.col("vertex").alias("src"), F.col("cluster").alias("p")), "src").join(within.select(F.col("vertex").alias("dst"), F.col("cluster").alias("q")), "dst").where("p = q")
    near = at.groupBy(F.col("src").alias("vertex"), "c").agg(F.sum("weight").alias("w"))
    own = near.join(k, "vertex").where("c = cluster").select("vertex", F.col("w").alias("w0"))
    tried = near.join(k, "vertex").where("c " + (">" if up else "<") + " cluster").join(sigma.select(F.col("cluster").alias("c"), F.col("s").alias("sc")), "c").join(sigma.select("cluster", F.col("s").alias("s0")), "cluster").join(own, "vertex", "left").fillna(0.0, ["w0"])
    gain = F.expr(f"2 * ((w - w0) / {m2!r}D - {float(resolution)!r}D * k * (sc - s0 + k) / ({m2!r}D * {m2!r}D))")
    best = tried.withColumn("gain", gain).where("gain > 1e-12").groupBy("vertex").agg(F.max(F.struct("gain", (-F.col("c")).alias("n"))).alias("b")).select("vertex", (-F.col("b.n")).alias("to"))
    return state.join(best, "vertex", "left").select("vertex", F.coalesce("to", "cluster").alias("cluster"), "k", F.col("to").isNotNull().alias("moved"))


def _level(e: DataFrame, resolution: float, sweeps: int, threshold: float, start: DataFrame | None = None, within: DataFrame | None = None) -> tuple[DataFrame, float]:
    """Local moving on one level: (vertex, cluster), and its modularity."""
    k = e.groupBy(F.col("src").alias("vertex")).agg(F.sum("weight").alias("k"))
    m2 = float(e.agg(F.sum("weight")).first()[0] or 0.0)
    state = k.select("vertex", F.col("vertex").alias("cluster"), "k") if start is None else k.join(start, "vertex").select("vertex", "cluster", "k")
    state, path = written(state)
    if not m2:
        return state.select("vertex", "cluster"), 0.0

    def q(s: DataFrame) -> float:
        return modularity(Graph(e), s.select("vertex", "cluster"), resolution).first()[0] or 0.0

    best, at = q(state), state
    for i in range(sweeps):
        new, path = written(_moves(e, state, m2, resolution, i % 2 == 0, within))
        state = new.drop("moved")
        now = q(state)
        if now > best + threshold:
            best, at = now, state
        elif i % 2:
            break
    return at.select("vertex", "cluster"), best


def _contracted(e: DataFrame, c: DataFrame) -> DataFrame:
    return written(e.join(c.select(F.col("vertex").alias("src"), F.col("cluster").alias("a")), "src").join(c.select(F.col("vertex").alias("dst"), F.col("cluster").alias("b")), "dst").groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.sum("weight").alias("weight")))[0]


def flatten_dendrogram(levels: list[DataFrame]) -> DataFrame:
    """The labels of the first level's vertices through all levels (vertex, cluster)."""
    out = levels[0]
    for level in levels[1:]:
        out = out.join(level.select(F.col("vertex").alias("cluster"), F.col("cluster").alias("_c")), "cluster", "left").select("vertex", F.coalesce("_c", "cluster").alias("cluster"))
    return out


def louvain(g: Graph, max_level: int = 100, resolution: float = 1.0, threshold: float = 1e-7, sweeps: int = 20) -> tuple[DataFrame, float]:
    """(vertex, partition) and its modularity. The same each time: ties go to the smaller cluster id."""
    if g.directed:
        raise ValueError("an undirected graph is needed")
    e, _ = written(g.weights())
    levels, best = [], -1.0
    for _ in range(max_level):
        part, q = _level(e, resolution, sweeps, threshold)
        if q <= best + threshold:
            break
        levels, best = [*levels, part], q
        e = _contracted(e, part)
    found = flatten_dendrogram(levels) if levels else g.vertices().withColumn("cluster", F.col("vertex"))
    return written(g.vertices().join(found, "vertex", "left").select("vertex", F.coalesce("cluster", "vertex").alias("partition")))[0], best


def leiden(g: Graph, max_iter: int = 100, resolution: float = 1.0, threshold: float = 1e-7, sweeps: int = 20) -> tuple[DataFrame, float]:
    """As louvain, but each level contracts a refinement (moves from singletons within each community) and goes on from the communities."""
    if g.directed:
        raise ValueError("an undirected graph is needed")
    e, _ = written(g.weights())
    levels, best, start, final = [], -1.0, None, None
    for _ in range(max_iter):
        part, q = _level(e, resolution, sweeps, threshold, start)
        if q <= best + threshold:
            break
        best = q
        final = flatten_dendrogram([*levels, part])
        fine, _ = _level(e, resolution, sweeps, threshold, within=part)
        levels.append(fine)
        start, _ = written(part.join(fine.withColumnRenamed("cluster", "f"), "vertex").groupBy(F.col("f").alias("vertex")).agg(F.min("cluster").alias("cluster")))
        e = _contracted(e, fine)
    found = final if final is not None else g.vertices().withColumn("cluster", F.col("vertex"))
    return written(g.vertices().join(found, "vertex", "left").select("vertex", F.coalesce("cluster", "vertex").alias("partition")))[0], best


def ecg(g: Graph, min_weight: float = 1e-4, ensemble_size: int = 16, resolution: float = 1.0, seed: int = 42) -> tuple[DataFrame, float]:
    """Louvain on weights that follow how often one-level runs, each on seeded renamed vertices, put an edge's ends together."""
    base, _ = written(g.weights())
    votes = base.select("src", "dst", F.lit(0).alias("same")).limit(0)
    for i in range(ensemble_size):
        name, _ = written(g.vertices().withColumn("n", F.xxhash64(F.lit(seed + i), "vertex")))
        e = base.join(name.select(F.col("vertex").alias("src"), F.col("n").alias("a")), "src").join(name.select(F.col("vertex").alias("dst"), F.col("n").alias("b")), "dst").select(F.col("a").alias("src"), F.col("b").alias("dst"), "weight")
        part, _ = _level(written(e)[0], resolution, 2, 0.0)
        part, _ = written(name.join(part.withColumnRenamed("vertex", "n"), "n").select("vertex", "cluster"))
        votes = votes.unionByName(base.join(part.select(F.col("vertex").alias("src"), F.col("cluster").alias("a")), "src").join(part.select(F.col("vertex").alias("dst"), F.col("cluster").alias("b")), "dst").select("src", "dst", F.expr("cast(a = b AS int)").alias("same")))
    share = votes.groupBy("src", "dst").agg((F.sum("same") / ensemble_size).alias("f"))
    again, _ = written(base.join(share, ["src", "dst"]).select("src", "dst", (F.lit(min_weight) + (F.col("weight") - min_weight) * F.col("f")).alias("weight")))
    part, _ = louvain(Graph(again, own_vertices=g.vertices()), resolution=resolution)
    return part, modularity(g, part.withColumnRenamed("partition", "cluster")).first()[0]


def spectral_clustering(g: Graph, num_clusters: int, num_eigen_vects: int = 2, rounds: int = 60, seed: int = 42) -> DataFrame:
    """vertex, cluster: k-means on the leading vectors of the normalised adjacency, found by orthogonal iteration over the edge table."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    w = g.weights()
    d = w.groupBy(F.col("src").alias("vertex")).agg(F.sum("weight").alias("d"))
    e, _ = written(w.join(d.select(F.col("vertex").alias("src"), F.col("d").alias("ds")), "src").join(d.select(F.col("vertex").alias("dst"), F.col("d").alias("dd")), "dst").select("src", "dst", (F.col("weight") / F.sqrt(F.col("ds") * F.col("dd"))).alias("weight")))
    names = [f"x{i}" for i in range(num_eigen_vects)]
    state, _ = written(d.select("vertex", *[(F.sqrt("d") if i == 0 else (F.pmod(F.xxhash64(F.lit(seed + i), "vertex"), F.lit(20001)) - 10000) / 10000.0).alias(n) for i, n in enumerate(names)]))
    for i in range(rounds):
        got = e.join(state.withColumnRenamed("vertex", "src"), "src").groupBy(F.col("dst").alias("vertex")).agg(*[F.sum(F.col("weight") * F.col(n)).alias(f"y{j}") for j, n in enumerate(names)])
        new = state.join(got, "vertex").select("vertex", *[(F.col(n) + F.col(f"y{j}")).alias(n) for j, n in enumerate(names)])
        if i % 5 == 4 or i + 1 == rounds:
            new, _ = written(new)
            for j, n in enumerate(names):  # Gram-Schmidt: a few sums a vector
                dots = new.agg(*[F.sum(F.col(n) * F.col(m)).alias(m) for m in names[: j + 1]], F.lit(0).alias("_")).first()
                base = F.col(n)
                for m in names[:j]:
                    base = base - F.lit(dots[m]) * F.col(m)
                new = new.withColumn(n, base)
                norm = new.agg(F.sqrt(F.sum(F.col(n) ** 2))).first()[0] or 1.0
                new, _ = written(new.withColumn(n, F.col(n) / F.lit(norm)))
        state = new
    ready = VectorAssembler(inputCols=names, outputCol="_f").transform(state)
    return KMeans(k=num_clusters, seed=seed, featuresCol="_f", predictionCol="cluster").fit(ready).transform(ready).select("vertex", "cluster")
