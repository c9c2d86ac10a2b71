"""Edge, vertex and neighbourhood functions that operators are composed of, as DataFrame helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.plans import blocks


def triplets(edges: DataFrame, values: DataFrame) -> DataFrame:
    """Edges with both ends' values: src_* and dst_* for each column of ``values`` (vertex, ...)."""
    rest = [c for c in values.columns if c != "vertex"]
    for end in ("src", "dst"):
        edges = edges.join(values.select(F.col("vertex").alias(end), *[F.col(c).alias(f"{end}_{c}") for c in rest]), end)
    return edges


def aggregate_neighbors(edges: DataFrame, values: DataFrame, agg: Column, incoming: bool = True, where: Column | None = None) -> DataFrame:
    """For each vertex an aggregate over its incoming or outgoing triplets; only those where ``where`` holds."""
    t = triplets(edges, values)
    return (t if where is None else t.where(where)).groupBy(F.col("dst" if incoming else "src").alias("vertex")).agg(agg)


def expand_frontier(frontier: DataFrame, edges: DataFrame, agg: Column) -> DataFrame:
    """One row for each vertex that the frontier's edges lead to; ``agg`` over them."""
    return frontier.withColumnRenamed("vertex", "src").join(edges, "src").groupBy(F.col("dst").alias("vertex")).agg(agg)


def top_k_edges(edges: DataFrame, by: Column, k: int, per: tuple[str, ...] = ("src",)) -> DataFrame:
    """The first ``k`` edges of each vertex (or vertex and type) by ``by``, then by dst."""
    return edges.withColumn("_n", F.row_number().over(Window.partitionBy(*per).orderBy(by, "dst"))).where(F.col("_n") <= k).drop("_n")


def common_neighbors(edges: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """first, second, neighbor for every neighbour that both ends of a pair have. By default the pairs are the edges."""
    if pairs is None and blocks.numbered(edges):
        return blocks.shared_by_edges(blocks.cut(edges.select("src", "dst")), ("first", "second", "neighbor"))
    pairs = edges.select(F.col("src").alias("first"), F.col("dst").alias("second")).distinct() if pairs is None else pairs
    e = edges.select("src", "dst").distinct()
    return pairs.join(e.select(F.col("src").alias("first"), F.col("dst").alias("neighbor")), "first").join(e.select(F.col("src").alias("second"), F.col("dst").alias("neighbor")), ["second", "neighbor"]).select("first", "second", "neighbor")


def transform_edges(edges: DataFrame, values: DataFrame, out: Column, where: Column | None = None) -> DataFrame:
    """src, dst and ``out`` (named) for each triplet, only those where ``where`` holds."""
    t = triplets(edges, values)
    return (t if where is None else t.where(where)).select("src", "dst", out)


def reduce_edges(edges: DataFrame, values: DataFrame, agg: Column) -> DataFrame:
    """One row: an aggregate over all triplets."""
    return triplets(edges, values).agg(agg)


def reduce_edges_by_key(edges: DataFrame, values: DataFrame, key: Column, agg: Column) -> DataFrame:
    """key and an aggregate over the triplets of each key."""
    return triplets(edges, values).groupBy(key.alias("key")).agg(agg)


def aggregate_by_end_key(edges: DataFrame, keys: DataFrame, agg: Column) -> DataFrame:
    """vertex, key and an aggregate over the vertex's edges to each key of their ends (keys: vertex, key)."""
    return edges.join(keys.select(F.col("vertex").alias("dst"), "key"), "dst").groupBy(F.col("src").alias("vertex"), "key").agg(agg)


def reduce_vertices(values: DataFrame, agg: Column, where: Column | None = None) -> DataFrame:
    """One row: an aggregate (a count, a sum, an extreme) over vertices."""
    return (values if where is None else values.where(where)).agg(agg)
