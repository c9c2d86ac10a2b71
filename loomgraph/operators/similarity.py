"""Similarity of vertex pairs by their neighbourhoods."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.graph import Graph
from loomgraph.operators.structure import two_hop
from loomgraph.plans import blocks

KINDS = ("jaccard", "sorensen", "overlap", "cosine")


def similarity(g: Graph, kind: str, pairs: DataFrame | None = None, use_weight: bool = False) -> DataFrame:
    """first, second, <kind>_coeff for the pairs, by default all two hops apart (a vertex and itself included).

    Unweighted cosine is 1 with a common neighbour, else 0; weighted cosine has
    norms over the common neighbours only, and is NaN without any.
    """
    if kind not in KINDS:
        raise ValueError(kind)
    if pairs is None and _in_blocks(g):
        return _two_hops_apart(g, kind, None, use_weight)
    e = g.weights().groupBy("src", "dst").agg(F.sum("weight").alias("weight")) if use_weight else g.edges.select("src", "dst", F.lit(1.0).alias("weight"))
    size = e.groupBy("src").agg(F.sum("weight").alias("d"))
    pairs = two_hop(g) if pairs is None else pairs.select("first", "second").distinct()
    common = pairs.join(e.select(F.col("src").alias("first"), F.col("dst").alias("n"), F.col("weight").alias("a")), "first").join(e.select(F.col("src").alias("second"), F.col("dst").alias("n"), F.col("weight").alias("b")), ["second", "n"])
    met = common.groupBy("first", "second").agg(F.sum(F.least("a", "b")).alias("i"), F.sum(F.col("a") * F.col("b")).alias("ab"), F.sum(F.col("a") * F.col("a")).alias("aa"), F.sum(F.col("b") * F.col("b")).alias("bb"))
    got = pairs.join(met, ["first", "second"], "left").join(size.select(F.col("src").alias("first"), F.col("d").alias("da")), "first", "left").join(size.select(F.col("src").alias("second"), F.col("d").alias("db")), "second", "left").fillna(0.0, ["i", "da", "db"])
    formula = {
        "jaccard": "CASE WHEN da + db - i > 0 THEN i / (da + db - i) ELSE 0D END",
        "sorensen": "CASE WHEN da + db > 0 THEN 2 * i / (da + db) ELSE 0D END",
        "overlap": "CASE WHEN least(da, db) > 0 THEN i / least(da, db) ELSE 0D END",
        "cosine": "coalesce(ab / (sqrt(aa) * sqrt(bb)), double('NaN'))" if use_weight else "CASE WHEN i > 0 THEN 1D ELSE 0D END",
    }[kind]
    return got.select("first", "second", F.expr(formula).alias(f"{kind}_coeff"))


def _in_blocks(g: Graph) -> bool:
    """Whether pairs two hops apart are those with a common neighbour, and ids fit blocks."""
    return not g.directed and not g.multi and blocks.numbered(g.edges)


def _coefficient(kind: str, use_weight: bool):
    def value(n, added, a, b, da, db):
        if kind == "cosine":
            return added(a * b) / (np.sqrt(added(a * a)) * np.sqrt(added(b * b))) if use_weight else np.ones(len(n))
        i = added(np.minimum(a, b)) if use_weight else n.astype(float)
        top, below = {"jaccard": (i, da + db - i), "sorensen": (2 * i, da + db), "overlap": (i, np.minimum(da, db))}[kind]
        return np.divide(top, below, out=np.zeros(len(i)), where=below > 0)

    return value


def _two_hops_apart(g: Graph, kind: str, vertices: DataFrame | None, use_weight: bool) -> DataFrame:
    """The same for all pairs two hops apart, from rows of neighbours that meet in one task: no wedge is shuffled."""
    e = g.weights() if use_weight else g.edges.select("src", "dst")
    right = blocks.cut(e)
    left = right if vertices is None else blocks.cut(e.join(vertices.select(F.col("vertex").alias("src")), "src", "left_semi"))
    return blocks.products(left, right, _coefficient(kind, use_weight), f"first bigint, second bigint, {kind}_coeff double")


def all_pairs(g: Graph, kind: str, vertices: DataFrame | None = None, use_weight: bool = False, topk: int | None = None) -> DataFrame:
    """All pairs two hops apart but a vertex and itself; with ``topk`` those of the highest scores, ties by the pair."""
    out = _two_hops_apart(g, kind, vertices, use_weight).where("first != second") if _in_blocks(g) else similarity(g, kind, two_hop(g, vertices).where("first != second"), use_weight)
    return out if topk is None else out.orderBy(F.desc(f"{kind}_coeff"), "first", "second").limit(topk)
