"""Edge tables from files, matrices and pandas, with explicit types; and a dataset's description."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.graph import Graph
from loomgraph.plans.shared import written

KINDS = {"int32": T.IntegerType(), "int64": T.LongType(), "float32": T.FloatType(), "float64": T.DoubleType(), "str": T.StringType()}


@dataclass
class Dataset:
    """A delimited file of edges: src, dst and perhaps weight, in this order."""

    path: str
    names: tuple[str, ...] = ("src", "dst", "weight")
    kinds: tuple[str, ...] = ("int32", "int32", "float32")
    sep: str = " "
    header: bool = False
    directed: bool = False
    multi: bool = False

    def edgelist(self, spark: SparkSession) -> DataFrame:
        schema = T.StructType([T.StructField(n, KINDS[k]) for n, k in zip(self.names, self.kinds, strict=True)])
        return spark.read.schema(schema).option("sep", self.sep).option("header", self.header).csv(self.path)

    def number_of_edges(self, spark: SparkSession) -> int:
        return self.edgelist(spark).count()

    def number_of_vertices(self, spark: SparkSession) -> int:
        e = self.edgelist(spark)
        return e.select(F.explode(F.array(*self.names[:2]))).distinct().count()

    def graph(self, spark: SparkSession, ignore_weights: bool = False) -> Graph:
        weight = self.names[2] if len(self.names) > 2 and not ignore_weights else None
        return Graph.from_edgelist(self.edgelist(spark), self.names[0], self.names[1], weight=weight, directed=self.directed, multi=self.multi)


def matrix_market(spark: SparkSession, path: str) -> DataFrame:
    """src, dst, weight of a Matrix Market coordinate file; the size line, which has a count in third place and comes first, is told apart by its position."""
    lines = spark.read.text(path).where("NOT startswith(value, '%') AND trim(value) != ''").withColumn("_at", F.monotonically_increasing_id())
    first = F.broadcast(lines.agg(F.min("_at").alias("_first")))
    cells = lines.crossJoin(first).where("_at != _first").select(F.split(F.trim("value"), r"\s+").alias("p"))
    return cells.select(F.col("p")[0].cast("bigint").alias("src"), F.col("p")[1].cast("bigint").alias("dst"), F.coalesce(F.try_element_at("p", F.lit(3)).cast("double"), F.lit(1.0)).alias("weight"))


def from_adjlist(spark: SparkSession, offsets: list[int], indices: list[int], values: list[float] | None = None) -> DataFrame:
    """Edges of compressed rows."""
    rows = [(i, j, float(values[k]) if values else 1.0) for i in range(len(offsets) - 1) for k, j in enumerate(indices[offsets[i] : offsets[i + 1]], offsets[i])]
    return spark.createDataFrame(rows, "src bigint, dst bigint, weight double")


def from_matrix(spark: SparkSession, matrix, names: list | None = None) -> DataFrame:
    """Edges of the cells of a dense matrix (numpy or pandas) that aren't 0."""
    import numpy as np

    m = np.asarray(matrix, float)
    at = list(names) if names is not None else list(range(len(m)))
    rows = [(at[i], at[j], float(m[i, j])) for i, j in zip(*np.nonzero(m), strict=True)]
    kind = "string" if at and isinstance(at[0], str) else "bigint"
    return spark.createDataFrame(rows, f"src {kind}, dst {kind}, weight double")


def from_pandas_edgelist(spark: SparkSession, frame, source: str = "src", destination: str = "dst", weight: str | None = None, directed: bool = False) -> Graph:
    """A graph of a pandas table's edges."""
    cols = [source, destination, *([weight] if weight else [])]
    return Graph.from_edgelist(spark.createDataFrame(frame[cols]), source, destination, weight=weight, directed=directed)


def from_coordinates(spark: SparkSession, rows, columns, values=None) -> DataFrame:
    """Edges of a sparse matrix's coordinates."""
    values = [1.0] * len(rows) if values is None else values
    return spark.createDataFrame([(int(i), int(j), float(x)) for i, j, x in zip(rows, columns, values, strict=True)], "src bigint, dst bigint, weight double")


def from_columns(spark: SparkSession, offsets: list[int], indices: list[int], values: list[float] | None = None) -> DataFrame:
    """Edges of compressed columns."""
    e = from_adjlist(spark, offsets, indices, values)
    return e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")


def compressed_rows(edges: DataFrame) -> DataFrame:
    """src, offset, indices, weights: a table of compressed rows; the offset is of the row's first edge in the order of src."""
    weight = F.col("weight") if "weight" in edges.columns else F.lit(1.0)
    rows = edges.groupBy("src").agg(F.sort_array(F.collect_list(F.struct("dst", weight.alias("weight")))).alias("x")).withColumn("n", F.size("x"))
    ranged = rows.repartitionByRange("src").withColumn("_p", F.spark_partition_id())
    held, _ = written(ranged.withColumn("_in", F.sum("n").over(Window.partitionBy("_p").orderBy("src").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")))
    before = held.groupBy("_p").agg(F.sum("n").alias("_n")).withColumn("_b", F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_p")) - F.col("_n"))  # a row for each partition
    return held.join(before, "_p").select("src", (F.col("_b") + F.col("_in")).alias("offset"), F.expr("transform(x, y -> y.dst)").alias("indices"), F.expr("transform(x, y -> y.weight)").alias("weights"))
