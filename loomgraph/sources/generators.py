"""Synthetic edge lists, made in parallel from ranges and hashes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators.sampling import uniform


def path_graph(spark: SparkSession, n: int, base: int = 0) -> DataFrame:
    return spark.range(max(n - 1, 0)).select((F.col("id") + base).alias("src"), (F.col("id") + base + 1).alias("dst"))


def mesh_2d(spark: SparkSession, x: int, y: int, base: int = 0) -> DataFrame:
    """Each cell to the next in x and in y."""
    cell = spark.range(x * y)
    return cell.select(F.explode(F.expr(f"filter(array(CASE WHEN id % {x} < {x - 1} THEN id + 1 END, CASE WHEN id div {x} < {y - 1} THEN id + {x} END), d -> d IS NOT NULL)")).alias("dst"), "id").select((F.col("id") + base).alias("src"), (F.col("dst") + base).alias("dst"))


def mesh_3d(spark: SparkSession, x: int, y: int, z: int, base: int = 0) -> DataFrame:
    cell = spark.range(x * y * z)
    steps = f"array(CASE WHEN id % {x} < {x - 1} THEN id + 1 END, CASE WHEN id div {x} % {y} < {y - 1} THEN id + {x} END, CASE WHEN id div {x * y} < {z - 1} THEN id + {x * y} END)"
    return cell.select(F.explode(F.expr(f"filter({steps}, d -> d IS NOT NULL)")).alias("dst"), "id").select((F.col("id") + base).alias("src"), (F.col("dst") + base).alias("dst"))


def complete_graph(spark: SparkSession, n: int, base: int = 0) -> DataFrame:
    """Each pair once, src < dst."""
    return spark.range(max(n - 1, 0)).select("id", F.explode(F.expr(f"sequence(id + 1, {n - 1}L)")).alias("dst")).select((F.col("id") + base).alias("src"), (F.col("dst") + base).alias("dst"))


def complete_bipartite(spark: SparkSession, a: int, b: int, seed: int = 42) -> DataFrame:
    """src below ``a``, dst from ``a`` on, a random weight each."""
    return spark.range(a).select(F.col("id").alias("src"), F.explode(F.expr(f"sequence({a}L, {a + b - 1}L)")).alias("dst")).withColumn("weight", uniform(seed, "src", "dst"))


def erdos_renyi(spark: SparkSession, n: int, p: float, seed: int = 42) -> DataFrame:
    """Each ordered pair of different vertices with probability ``p``."""
    return spark.range(n).select(F.col("id").alias("src"), F.explode(F.expr(f"sequence(0L, {n - 1}L)")).alias("dst")).where((F.col("src") != F.col("dst")) & (uniform(seed, "src", "dst") < p))


def rmat(spark: SparkSession, scale: int, num_edges: int, a: float = 0.57, b: float = 0.19, c: float = 0.19, seed: int = 42, clip_and_flip: bool = False, dst_scale: int | None = None, scramble: bool = False) -> DataFrame:
    """Quadrants drawn bit by bit; ``dst_scale`` makes it bipartite, ``clip_and_flip`` keeps src >= dst."""
    src, dst = F.lit(0).cast("bigint"), F.lit(0).cast("bigint")
    scales = (scale, dst_scale or scale)
    for bit in range(max(scales)):
        u = uniform(seed, F.lit(bit), "id")
        down, right = (u >= a + b).cast("bigint"), (((u >= a) & (u < a + b)) | (u >= a + b + c)).cast("bigint")
        src = src * 2 + down if bit < scales[0] else src
        dst = dst * 2 + right if bit < scales[1] else dst
    e = spark.range(num_edges).select(src.alias("src"), dst.alias("dst"))
    if clip_and_flip:
        e = e.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
    return scramble_ids(e, max(scales)) if scramble else e


def multi_rmat(spark: SparkSession, n: int, min_scale: int, max_scale: int, edge_factor: int = 16, seed: int = 42) -> list[DataFrame]:
    return [rmat(spark, s := min_scale + (seed * 31 + i * 17) % (max_scale - min_scale + 1), edge_factor << s, seed=seed + i) for i in range(n)]


def scramble_ids(e: DataFrame, scale: int) -> DataFrame:
    """A fixed one-to-one mixing of the lowest ``scale`` bits of both ends."""
    mask, half = (1 << scale) - 1, max(scale // 2, 1)

    def mixed(x: str):
        y = F.col(x)
        for k in (0x9E3779B1, 0x85EBCA6B):
            y = (y * F.lit(k % (1 << min(scale, 31)) | 1)).bitwiseAND(F.lit(mask))
            y = y.bitwiseXOR(F.shiftright(y, half))
        return y

    return e.withColumns({"src": mixed("src"), "dst": mixed("dst")})


def symmetrized(e: DataFrame) -> DataFrame:
    return e.unionByName(e.where("src != dst").withColumns({"src": F.col("dst"), "dst": F.col("src")}))


def combined(lists: list[DataFrame], remove_multi_edges: bool = True) -> DataFrame:
    out = lists[0]
    for e in lists[1:]:
        out = out.unionByName(e)
    return out.dropDuplicates(["src", "dst"]) if remove_multi_edges else out


def with_attributes(e: DataFrame, seed: int = 42, types: int = 1) -> DataFrame:
    """Adds weight in (0, 1), edge_id and edge_type below ``types``, from the ends' hash."""
    return e.withColumns({"weight": uniform(seed, "src", "dst"), "edge_id": F.monotonically_increasing_id(), "edge_type": F.pmod(F.xxhash64(F.lit(seed), "src", "dst"), F.lit(types)).cast("int")})
