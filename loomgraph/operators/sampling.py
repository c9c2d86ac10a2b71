"""Walks and samples. Every random choice is a hash of a seed and what it chooses for, so results don't depend on partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.graph import Graph
from loomgraph.plans.shared import written


def uniform(seed: int, *keys) -> Column:
    """A number in (0, 1) from a hash of the keys."""
    return (F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 52)) + 0.5) / float(1 << 52)


def random_walks(g: Graph, start: DataFrame, max_depth: int, seed: int = 42, biased: bool = False, p: float | None = None, q: float | None = None) -> DataFrame:
    """walk_id, step, vertex, weight: a walk for each row of ``start`` (vertex), named by a hash of the vertex and which of its rows it is; it ends early where nothing leads on. With ``p`` and ``q`` steps are biased by the vertex before (node2vec)."""
    edges, _ = written(g.weights().groupBy("src", "dst").agg(F.sum("weight").alias("weight")))
    first, _ = written(start.groupBy("vertex").agg(F.count("*").alias("_n")).select("vertex", F.explode(F.sequence(F.lit(1), "_n")).alias("_k")).withColumn("walk_id", F.xxhash64("vertex", "_k")))
    front = first.select("walk_id", F.lit(0).alias("step"), "vertex", F.lit(None).cast("double").alias("weight"), F.lit(None).cast(g.edges.schema["src"].dataType).alias("prev"))
    out, front = front, front
    for step in range(1, max_depth + 1):
        tried = front.select("walk_id", F.col("vertex").alias("src"), "prev").join(edges, "src")
        bias = F.col("weight") if biased or (p and g.weighted) else F.lit(1.0)
        if p is not None:
            back = edges.select(F.col("src").alias("prev"), F.col("dst"), F.lit(True).alias("near")).distinct()
            tried = tried.join(back, ["prev", "dst"], "left")
            bias = bias * F.when(F.col("prev").isNull(), 1.0).when(F.col("dst") == F.col("prev"), 1.0 / p).when(F.col("near"), 1.0).otherwise(1.0 / (q or 1.0))
        race = -F.log(uniform(seed, F.lit(step), "walk_id", "dst")) / bias  # the least of such draws wins in proportion to its bias
        front = tried.where(bias > 0).groupBy("walk_id", F.col("src").alias("prev")).agg(F.min(F.struct(race.alias("r"), "dst", "weight")).alias("x")).select("walk_id", F.lit(step).alias("step"), F.col("x.dst").alias("vertex"), F.col("x.weight").alias("weight"), "prev")
        front, _ = written(front)
        out = out.unionByName(front)
    return out.select("walk_id", "step", "vertex", "weight")


def neighbor_sample(g: Graph, seeds: DataFrame, fanout: list[int], seed: int = 42, with_replacement: bool = False, biased: bool = False, per_type: bool = False, prior: str = "default", temporal: str | None = None, window: int | None = None) -> DataFrame:
    """batch_id, hop_id, src, dst...: up to ``fanout`` edges of each frontier vertex, hop by hop; -1 takes all.

    ``seeds``: batch_id, vertex (and time, if temporal). ``per_type`` draws within
    each edge type. ``prior`` is default (the new ends go on), carry_over (and all
    sources) or exclude (but no source again). ``temporal`` compares an edge's
    start_time with the time of its frontier vertex: strictly_increasing,
    monotonically_increasing, strictly_decreasing or monotonically_decreasing;
    ``window`` bounds the distance from the seed's time. With replacement each draw is on its own.
    """
    compare = {None: None, "strictly_increasing": "start_time > time", "monotonically_increasing": "start_time >= time", "strictly_decreasing": "start_time < time", "monotonically_decreasing": "start_time <= time"}[temporal]
    keys = ["batch_id", "vertex", *(["time", "origin"] if temporal else [])]
    front = seeds.select("batch_id", "vertex", *([F.col("time"), F.col("time").alias("origin")] if temporal else [])).distinct()
    sources, out = front, None
    for hop, k in enumerate(fanout):
        tried = front.join(g.edges.withColumnRenamed("src", "vertex"), "vertex")
        if compare:
            tried = tried.where(compare)
            if window is not None:
                tried = tried.where(F.abs(F.col("start_time") - F.col("origin")) <= window)
        group = [*keys, *(["edge_type"] if per_type else [])]
        ident = [c for c in ("dst", "edge_id", "edge_type", "start_time") if c in tried.columns]
        draw = uniform(seed, F.lit(hop), *group, *ident)
        score = -F.log(draw) / F.col("weight") if biased else draw
        if k < 0:
            got = tried
        elif with_replacement:
            copies = tried.withColumn("_d", F.explode(F.sequence(F.lit(1), F.lit(max(k, 1)))))
            again = uniform(seed, F.lit(hop), "_d", *group, *ident)
            got = copies.withColumn("_n", F.row_number().over(Window.partitionBy(*group, "_d").orderBy(-F.log(again) / (F.col("weight") if biased else F.lit(1.0)), *ident))).where("_n = 1").drop("_n", "_d") if k else tried.limit(0)
        else:
            got = tried.withColumn("_n", F.row_number().over(Window.partitionBy(*group).orderBy(score, *ident))).where(F.col("_n") <= k).drop("_n")
        got, _ = written(got.withColumn("hop_id", F.lit(hop)))
        out = got if out is None else out.unionByName(got)
        front = got.select("batch_id", F.col("dst").alias("vertex"), *([F.col("start_time").alias("time"), "origin"] if temporal else [])).distinct()
        if prior == "carry_over":
            front = front.unionByName(sources).distinct()
        elif prior == "exclude":
            front = front.join(sources, ["batch_id", "vertex"], "left_anti")
        front, _ = written(front)
        sources = sources.unionByName(front).distinct()
    rest = [c for c in g.edges.columns if c not in ("src", "dst")]
    return out.select("batch_id", "hop_id", F.col("vertex").alias("src"), "dst", *rest)


def renumber_sample(sample: DataFrame) -> DataFrame:
    """Adds src_id and dst_id: numbers from 0 within each batch, by the hop a vertex first came in (as a source before as an end), then by the vertex."""
    ends = sample.select("batch_id", F.explode(F.array(F.struct((2 * F.col("hop_id")).alias("h"), F.col("src").alias("v")), F.struct((2 * F.col("hop_id") + 1).alias("h"), F.col("dst").alias("v")))).alias("x"))
    first = ends.groupBy("batch_id", F.col("x.v").alias("v")).agg(F.min("x.h").alias("h"))
    named = first.select("batch_id", "v", (F.row_number().over(Window.partitionBy("batch_id").orderBy("h", "v")) - 1).alias("id"))
    return sample.join(named.select("batch_id", F.col("v").alias("src"), F.col("id").alias("src_id")), ["batch_id", "src"]).join(named.select("batch_id", F.col("v").alias("dst"), F.col("id").alias("dst_id")), ["batch_id", "dst"])


def negative_sampling(g: Graph, n: int, seed: int = 42) -> DataFrame:
    """src, dst: ``n`` different pairs of vertices without an edge; all there are, if fewer."""
    v, _ = written(g.vertices())
    total = v.count()
    ranged = v.repartitionByRange("vertex").withColumn("_p", F.spark_partition_id())
    held = ranged.withColumn("_r", F.row_number().over(Window.partitionBy("_p").orderBy("vertex")))
    held, _ = written(held)
    before = held.groupBy("_p").agg(F.count("*").alias("_n")).withColumn("_b", F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_p")) - F.col("_n"))
    named, _ = written(held.join(before, "_p").select((F.col("_b") + F.col("_r") - 1).alias("i"), "vertex"))
    edges, out = g.edges.select("src", "dst"), None
    spark = g.edges.sparkSession
    free = total * total - edges.join(named.select(F.col("vertex").alias("src")), "src", "left_semi").distinct().count()
    r = -1
    while True:
        r += 1
        draws = spark.range(2 * n).select(*[F.floor(uniform(seed, F.lit(r), F.lit(e), "id") * total).cast("bigint").alias(e) for e in ("a", "b")])
        pairs = draws.join(named.select(F.col("i").alias("a"), F.col("vertex").alias("src")), "a").join(named.select(F.col("i").alias("b"), F.col("vertex").alias("dst")), "b").select("src", "dst").distinct().join(edges, ["src", "dst"], "left_anti")
        out, _ = written(pairs if out is None else out.unionByName(pairs).distinct())
        if out.count() >= min(n, free):
            break
    return out.orderBy(F.xxhash64(F.lit(seed), "src", "dst"), "src", "dst").limit(n)
