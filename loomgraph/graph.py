"""A graph: a table of edges, perhaps one of vertices, and two properties. All of it is lazy DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType


def numbered(edges: DataFrame) -> bool:
    """Whether both ends are whole numbers."""
    return all(isinstance(edges.schema[c].dataType, IntegralType) for c in ("src", "dst"))


@dataclass
class Graph:
    """``edges`` has src and dst and may have weight, edge_id, edge_type, start_time and end_time. An undirected graph stores both directions."""

    edges: DataFrame
    directed: bool = False
    multi: bool = False
    own_vertices: DataFrame | None = None
    parts: dict[str, DataFrame] = field(default_factory=dict)
    #: Both directions are there, each once, ids are whole numbers and rows lie in ranges of src, a vertex's together.
    ranged: bool = False

    @classmethod
    def from_edgelist(cls, df: DataFrame, source: str = "src", destination: str = "dst", *, weight: str | None = None, edge_id: str | None = None, edge_type: str | None = None, start_time: str | None = None, end_time: str | None = None, directed: bool = False, multi: bool = False, drop_self_loops: bool = False, vertices: DataFrame | None = None) -> Graph:
        """Copies the named columns, then drops self-loops if asked, adds reversed edges, merges parallel edges (one of them stays, that of the least attributes in their order)."""
        named = {"weight": weight, "edge_id": edge_id, "edge_type": edge_type, "start_time": start_time, "end_time": end_time}
        lacking = [c for c in (source, destination, *filter(None, named.values())) if c not in df.columns]
        if lacking:
            raise ValueError(f"no such columns: {lacking}")
        cols = [F.col(source).alias("src"), F.col(destination).alias("dst")]
        cols += [(F.col(c).cast("double") if role == "weight" else F.col(c)).alias(role) for role, c in named.items() if c]
        edges = df.select(*cols).where("src IS NOT NULL AND dst IS NOT NULL")
        if drop_self_loops:
            edges = edges.where("src != dst")
        rest = [c for c in edges.columns if c not in ("src", "dst")]
        ranged = not directed and not multi and numbered(edges)
        if ranged:  # dealt once, by ranges of src: what is counted by either end meets before it is dealt again
            ways = F.when(F.col("src") == F.col("dst"), F.array(F.struct("src", "dst"))).otherwise(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"))))
            edges = edges.select(F.explode(ways).alias("_x"), *rest).select("_x.*", *rest).repartitionByRange("src")
        elif not directed:
            edges = edges.unionByName(edges.where("src != dst").withColumns({"src": F.col("dst"), "dst": F.col("src")}))
        if not multi and len(rest) == 1:
            edges = edges.groupBy("src", "dst").agg(F.when(F.count(rest[0]) == F.count("*"), F.min(rest[0])).alias(rest[0]))  # null comes first
        elif not multi:
            edges = edges.groupBy("src", "dst").agg(F.min(F.struct(*rest)).alias("_m")).select("src", "dst", "_m.*") if rest else edges.distinct()
        return cls(edges, directed, multi, vertices, ranged=ranged)

    @property
    def weighted(self) -> bool:
        return "weight" in self.edges.columns

    def vertices(self) -> DataFrame:
        ends = self.edges.select(F.col("src").alias("vertex") if self.ranged else F.explode(F.array("src", "dst")).alias("vertex"))
        if self.own_vertices is not None:
            ends = ends.unionByName(self.own_vertices.select(F.col(self.own_vertices.columns[0]).alias("vertex")))
        return ends.distinct()

    def weights(self) -> DataFrame:
        """src, dst, weight; 1 where the graph has none."""
        return self.edges.select("src", "dst", F.col("weight") if self.weighted else F.lit(1.0).alias("weight"))

    def edge_list(self) -> DataFrame:
        """Directed: the edges. Undirected: each once, src <= dst."""
        return self.edges if self.directed else self.edges.where("src <= dst")

    def number_of_vertices(self) -> int:
        return self.vertices().count()

    def number_of_edges(self, directed_edges: bool = False) -> int:
        return (self.edges if self.directed or directed_edges else self.edges.where("src >= dst")).count()

    def has_node(self, n) -> bool:
        return not self.vertices().where(F.col("vertex") == F.lit(n)).isEmpty()

    def has_edge(self, u, v) -> bool:
        return not self.edges.where((F.col("src") == F.lit(u)) & (F.col("dst") == F.lit(v))).isEmpty()

    def has_self_loop(self) -> bool:
        return not self.edges.where("src = dst").isEmpty()

    def has_isolated_vertices(self) -> bool:
        return not self.vertices().join(self.edges.select(F.explode(F.array("src", "dst")).alias("vertex")), "vertex", "left_anti").isEmpty()

    def neighbors(self, n) -> DataFrame:
        return self.edges.where(F.col("src") == F.lit(n)).select(F.col("dst").alias("vertex")).distinct()

    def to_directed(self) -> Graph:
        return Graph(self.edges, True, self.multi, self.own_vertices)

    def to_undirected(self) -> Graph:
        return Graph.from_edgelist(self.edges, **{c: c for c in self.edges.columns if c not in ("src", "dst")}, directed=False, multi=self.multi, vertices=self.own_vertices)

    def add_nodes_from(self, nodes: DataFrame, part: str) -> None:
        """Records a part of an n-partite graph."""
        self.parts[part] = nodes.select(F.col(nodes.columns[0]).alias("vertex")).distinct()

    def sets(self) -> tuple[DataFrame, DataFrame]:
        """The two parts; the second is all other vertices if only one was given."""
        first, *rest = self.parts.values()
        return first, rest[0] if rest else self.vertices().join(first, "vertex", "left_anti")

    def to_pandas_edgelist(self):
        return self.edge_list().toPandas()

    def adjacency_matrix(self) -> DataFrame:
        """A row for each src, a column for each dst, 0 where there is no edge. As wide as the graph has vertices."""
        return self.weights().groupBy("src").pivot("dst").agg(F.sum("weight")).fillna(0.0)
