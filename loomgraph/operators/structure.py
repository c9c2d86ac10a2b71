"""Structure: cleaning, degrees, neighbourhoods, contraction, subgraphs, renumbering."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.graph import Graph
from loomgraph.plans import blocks
from loomgraph.plans.shared import written


def remove_self_loops(e: DataFrame) -> DataFrame:
    return e.where("src != dst")


def remove_multi_edges(e: DataFrame) -> DataFrame:
    """One edge for each pair, that of the least attributes."""
    rest = [c for c in e.columns if c not in ("src", "dst")]
    return e.groupBy("src", "dst").agg(F.min(F.struct(*rest)).alias("_m")).select("src", "dst", "_m.*") if rest else e.distinct()


def symmetrize(e: DataFrame, how: str = "mean", reciprocal: bool = False) -> DataFrame:
    """Adds missing reversed edges; where both are there the weight is their ``mean`` (or ``min``). ``reciprocal`` keeps pairs that have both."""
    weighted = "weight" in e.columns
    once = e.groupBy("src", "dst").agg(F.min("weight").alias("weight")) if weighted else e.select("src", "dst").distinct()
    pair = once.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), *(["weight"] if weighted else []))
    agg = [F.count("*").alias("n"), *([(F.avg if how == "mean" else F.min)("weight").alias("weight")] if weighted else [])]
    both = pair.groupBy("a", "b").agg(*agg)
    if reciprocal:
        both = both.where("n = 2 OR a = b")
    cols = ["weight"] if weighted else []
    return both.select(F.col("a").alias("src"), F.col("b").alias("dst"), *cols).unionByName(both.where("a != b").select(F.col("b").alias("src"), F.col("a").alias("dst"), *cols))


def transpose(e: DataFrame) -> DataFrame:
    return e.withColumns({"src": F.col("dst"), "dst": F.col("src")})


def degrees(g: Graph, subset: DataFrame | None = None) -> DataFrame:
    """vertex, in_degree, out_degree, degree (their sum, so twice the neighbours of an undirected graph)."""
    ends = g.edges.select(F.explode(F.array(F.struct(F.col("src").alias("vertex"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("vertex"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("x")).select("x.*")
    got = ends.groupBy("vertex").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
    if g.own_vertices is not None:
        got = g.vertices().join(got, "vertex", "left").fillna(0, ["in_degree", "out_degree"])
    if subset is not None:
        got = got.join(subset, "vertex", "left_semi")
    return got.withColumn("degree", F.col("in_degree") + F.col("out_degree"))


def density(g: Graph) -> DataFrame:
    """factor * stored edges / (n (n - 1)); the factor is 2 if undirected."""
    n = g.vertices().agg(F.count("*").alias("n"))
    m = g.edges.agg(F.count("*").alias("m"))
    return n.join(m, F.lit(True)).select((F.lit(1.0 if g.directed else 2.0) * F.col("m") / (F.col("n") * (F.col("n") - 1))).alias("density"))


def multiplicity(e: DataFrame) -> DataFrame:
    return e.groupBy("src", "dst").agg(F.count("*").alias("multiplicity"))


def loop_counts(e: DataFrame) -> DataFrame:
    """self_loops, multi_edges: self-loop rows, and rows beyond the first of their pair."""
    return multiplicity(e).agg(F.sum(F.when(F.col("src") == F.col("dst"), F.col("multiplicity")).otherwise(0)).alias("self_loops"), F.sum(F.col("multiplicity") - 1).alias("multi_edges"))


def adjacency(e: DataFrame) -> DataFrame:
    """src and its neighbours in order."""
    return e.groupBy("src").agg(F.sort_array(F.collect_set("dst")).alias("neighbors"))


def weight_sums(g: Graph) -> DataFrame:
    w = g.weights()
    ends = w.select(F.explode(F.array(F.struct(F.col("src").alias("vertex"), F.lit(0.0).alias("i"), F.col("weight").alias("o")), F.struct(F.col("dst").alias("vertex"), F.col("weight").alias("i"), F.lit(0.0).alias("o")))).alias("x")).select("x.*")
    return ends.groupBy("vertex").agg(F.sum("i").alias("in_weight"), F.sum("o").alias("out_weight"))


def coarsen(g: Graph, labels: DataFrame) -> DataFrame:
    """Vertices become their labels (vertex, label); weights of merged edges add up, edges within a label become self-loops."""
    a, b = labels.select(F.col("vertex").alias("src"), F.col("label").alias("a")), labels.select(F.col("vertex").alias("dst"), F.col("label").alias("b"))
    return g.weights().join(a, "src").join(b, "dst").groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.sum("weight").alias("weight"))


def relabel(values: DataFrame, pairs: DataFrame, column: str = "label", keep_missing: bool = True) -> DataFrame:
    """Replaces ``column`` by the pairs (old, new); missing ones stay or become null."""
    to = F.coalesce("new", column) if keep_missing else F.col("new")
    return values.join(pairs, F.col(column) == F.col("old"), "left").select(*[to.alias(c) if c == column else F.col(c) for c in values.columns])


def induced_subgraph(g: Graph, sets: DataFrame) -> DataFrame:
    """Edges with both ends in a set. ``sets``: vertex, or vertex and subgraph."""
    if "subgraph" not in sets.columns:
        return g.edges.join(sets.select(F.col("vertex").alias("src")), "src", "left_semi").join(sets.select(F.col("vertex").alias("dst")), "dst", "left_semi").select(*g.edges.columns)
    a, b = sets.select(F.col("vertex").alias("src"), "subgraph"), sets.select(F.col("vertex").alias("dst"), "subgraph")
    return g.edges.join(a, "src").join(b, ["dst", "subgraph"]).select("subgraph", *g.edges.columns)


def two_hop(g: Graph, start: DataFrame | None = None) -> DataFrame:
    """Distinct (first, second) that an edge and then another lead to; (u, u) included."""
    if blocks.numbered(g.edges):
        e = g.edges.select("src", "dst")
        right = blocks.cut(e if not g.directed else transpose(e))
        left = right if start is None and not g.directed else blocks.cut(e if start is None else e.join(start.select(F.col("vertex").alias("src")), "src", "left_semi"))
        return blocks.products(left, right, None, "first bigint, second bigint")
    e = g.edges.select("src", "dst").distinct()
    a = e if start is None else e.join(start.select(F.col("vertex").alias("src")), "src", "left_semi")
    return a.select(F.col("src").alias("first"), F.col("dst").alias("mid")).join(e.select(F.col("src").alias("mid"), F.col("dst").alias("second")), "mid").select("first", "second").distinct()


def k_hop(g: Graph, start: DataFrame, k: int) -> DataFrame:
    """(start, vertex): reached by walks of exactly k edges."""
    e = g.edges.select("src", "dst").distinct()
    now = start.select(F.col("vertex").alias("start"), "vertex").distinct()
    for _ in range(k):
        now = now.join(e, F.col("vertex") == F.col("src")).select("start", F.col("dst").alias("vertex")).distinct()
    return now


def renumber(df: DataFrame, keys: list[list[str]]) -> DataFrame:
    """(id, key...): a number for each distinct key, by its order; each item of ``keys`` names one end's columns. Ranges are numbered in parallel."""
    names = [f"k{i}" for i in range(len(keys[0]))]
    all_ = None
    for cols in keys:
        part = df.select(*[F.col(c).alias(n) for c, n in zip(cols, names, strict=True)])
        all_ = part if all_ is None else all_.unionByName(part)
    ranged = all_.distinct().repartitionByRange(*names).withColumn("_p", F.spark_partition_id())
    held, _ = written(ranged.withColumn("_r", F.row_number().over(Window.partitionBy("_p").orderBy(*names))))  # read twice, so the ranges must stay the same
    counts = held.groupBy("_p").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_b", F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_p")) - F.col("_n"))  # a row for each partition
    return held.join(before, "_p").select((F.col("_b") + F.col("_r") - 1).alias("id"), *names)


def hypergraph(df: DataFrame, columns: list[str], event: str, drop_null: bool = True) -> tuple[DataFrame, DataFrame]:
    """Entity nodes ``column::value`` and event nodes; an edge from each event to each of its entities."""
    pairs = df.select(F.col(event).cast("string").alias("event"), F.explode(F.array(*[F.struct(F.lit(c).alias("category"), F.col(c).cast("string").alias("value")) for c in columns])).alias("x")).select("event", "x.*")
    pairs = pairs.where("value IS NOT NULL") if drop_null else pairs.fillna("null", ["value"])
    edges = pairs.select(F.concat_ws("::", F.lit("event_id"), "event").alias("src"), F.concat_ws("::", "category", "value").alias("dst"), F.col("category").alias("edge_type"))
    nodes = edges.select(F.col("dst").alias("node_id"), F.col("edge_type").alias("category")).unionByName(edges.select(F.col("src").alias("node_id"), F.lit("event").alias("category"))).distinct()
    return nodes, edges


def edge_lookup(e: DataFrame, wanted: DataFrame) -> DataFrame:
    """Ends of (edge_id, edge_type); -1 where there is no such edge."""
    return wanted.join(e.select("edge_id", "edge_type", "src", "dst"), ["edge_id", "edge_type"], "left").select("edge_id", "edge_type", F.coalesce("src", F.lit(-1)).alias("src"), F.coalesce("dst", F.lit(-1)).alias("dst"))


def to_external(values: DataFrame, numbers: DataFrame, column: str = "vertex") -> DataFrame:
    """``values`` with the numbers in ``column`` replaced by the keys that :func:`renumber` gave them."""
    keys = [c for c in numbers.columns if c != "id"]
    return values.join(numbers, F.col(column) == F.col("id")).select(*keys, *[c for c in values.columns if c != column])


def to_internal(values: DataFrame, numbers: DataFrame, columns: list[str]) -> DataFrame:
    """``values`` with ``id``, the number of the key in ``columns``."""
    keys = [c for c in numbers.columns if c != "id"]
    on = F.lit(True)
    for c, k in zip(columns, keys, strict=True):
        on = on & (F.col(c) == F.col(k))
    return values.join(numbers, on).select(*values.columns, "id")


def random_vertices(g: Graph, n: int, seed: int = 42) -> DataFrame:
    """``n`` vertices in the order of a seeded hash."""
    return g.vertices().orderBy(F.xxhash64(F.lit(seed), "vertex"), "vertex").limit(n)

