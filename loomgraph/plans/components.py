"""Connected components by alternating star contraction, for edge tables of any size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.plans.shared import forget, written


def connected_labels(edges: DataFrame, u: str = "src", v: str = "dst", max_rounds: int = 60) -> DataFrame:
    """``(vertex, label)`` for every end of ``edges``; the label is the smallest vertex reachable.

    Each round points neighbours at the smallest one around them, first those that
    are larger than the vertex, then those that are smaller. Only minima are
    gathered per vertex, so hubs combine before the shuffle. Self-loops keep their
    vertex in the result; rows with a null end are left out.
    """
    spark = edges.sparkSession
    pairs = edges.select(F.col(u).alias("a"), F.col(v).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    vertices, _ = written(pairs.select(F.explode(F.array("a", "b")).alias("vertex")).distinct())
    state, path = written(pairs.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    for _ in range(max_rounds):
        both = state.unionByName(state.selectExpr("b AS a", "a AS b"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
        large = both.join(low, F.col("a") == F.col("k")).where("b > a AND b != m").selectExpr("b AS a", "m AS b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "k")
        small = large.join(least, F.col("a") == F.col("k")).selectExpr("explode(array(struct(a AS a, m AS b), struct(b AS a, m AS b))) AS e").selectExpr("e.a", "e.b").where("a != b").distinct()
        old, (state, path) = path, written(small)
        forget(spark, old)
        got = state.agg(F.count("*"), F.coalesce(F.expr("sum(cast(xxhash64(a, b) AS decimal(38, 0)))"), F.lit(0))).first()
        if tuple(got) == mark:
            break
        mark = tuple(got)
    else:
        raise RuntimeError(f"no fixpoint in {max_rounds} rounds")
    return vertices.join(state.selectExpr("a AS vertex", "b AS root"), "vertex", "left").select("vertex", F.coalesce("root", "vertex").alias("label"))


#: Edges that one task joins.
ALONE = 2_000_000


def smallest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For each of ``n`` places the smallest that edges (a, b) lead to: roots are hooked on smaller ones and paths cut short until none changes."""
    label = np.arange(n)
    while True:
        x, y = label[a], label[b]
        low = np.minimum(x, y)
        if (x == y).all():
            return label
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        while ((deeper := label[label]) != label).any():
            label = deeper


def joined_labels(edges: DataFrame, u: str = "src", v: str = "dst") -> DataFrame:
    """As :func:`connected_labels`, for ids that are whole numbers: one task where there are few edges."""
    held, _ = written(edges.select(F.col(u).cast("bigint").alias("src"), F.col(v).cast("bigint").alias("dst")).where("src IS NOT NULL AND dst IS NOT NULL"))
    if held.count() > ALONE:
        return connected_labels(held)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if got:
            a, b = (np.concatenate([x.column(c).to_numpy() for x in got]) for c in ("src", "dst"))
            ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
            label = ids[smallest(at[: len(a)], at[len(a) :], len(ids))]
            for i in range(0, len(ids), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(ids[i : i + 100_000]), pa.array(label[i : i + 100_000])], names=["vertex", "label"])

    return held.coalesce(1).mapInArrow(join, "vertex bigint, label bigint")
