"""Components, cores, orderings, spanning forests and matchings."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.graph import Graph
from loomgraph.operators.structure import induced_subgraph
from loomgraph.plans import blocks, sweeps
from loomgraph.plans.components import connected_labels, joined_labels, smallest
from loomgraph.plans.loop import FailedToConvergeError
from loomgraph.plans.shared import forget, written


def weakly_connected_components(g: Graph) -> DataFrame:
    """vertex, labels: the smallest vertex of the component."""
    if sweeps.fits(g):
        s = sweeps.Sweeps(g, weighted=False)
        found = joined_labels(s.told([], _joined, [], "src bigint, dst bigint"))
        return s.vertices().join(found, "vertex", "left").select(F.col("vertex").cast(g.edges.schema["src"].dataType).alias("vertex"), F.coalesce("label", "vertex").cast(g.edges.schema["src"].dataType).alias("labels"))
    found = connected_labels(g.edges)
    return g.vertices().join(found, "vertex", "left").select("vertex", F.coalesce("label", "vertex").alias("labels"))


def _joined(ids, edges, own, around, near):
    """What a block's edges join, as an edge from each vertex to the smallest."""
    label = smallest(edges["own"][sweeps.row_of(edges)], edges["at"], len(near))
    there = np.flatnonzero(label != np.arange(len(near)))
    return [near[there], near[label[there]]]


def _least_reaching(edges: DataFrame, state: DataFrame) -> DataFrame:
    """The smallest id that reaches each vertex along ``edges`` (src, dst), itself included."""
    spark, path = edges.sparkSession, None
    state = state.select("vertex", F.col("vertex").alias("m"))
    while True:
        offer = edges.join(state.select(F.col("vertex").alias("src"), "m"), "src").groupBy(F.col("dst").alias("vertex")).agg(F.min("m").alias("o"))
        new, new_path = written(state.join(offer, "vertex", "left").select("vertex", F.least("m", F.coalesce("o", "m")).alias("m"), F.expr("coalesce(o < m, false)").alias("c")))
        if path:
            forget(spark, path)
        path = new_path
        more = not new.where("c").isEmpty()
        state = new.drop("c")
        if not more:
            return state


def strongly_connected_components(g: Graph) -> DataFrame:
    """vertex, labels: the smallest vertex of the component. Forward colours by the smallest id that reaches a vertex; a root's component is what reaches it within its colour."""
    edges, _ = written(g.edges.where("src != dst").select("src", "dst").distinct())
    left, _ = written(g.vertices())
    done = None
    while not left.isEmpty():
        colour = _least_reaching(edges, left)
        inside, _ = written(edges.join(colour.select(F.col("vertex").alias("src"), F.col("m").alias("a")), "src").join(colour.select(F.col("vertex").alias("dst"), F.col("m").alias("b")), "dst").where("a = b").select("src", "dst", F.col("a").alias("m")))
        front, _ = written(colour.where("vertex = m").select("vertex", "m"))
        found = front
        while not front.isEmpty():
            front, _ = written(inside.join(front.select(F.col("vertex").alias("dst"), "m"), ["dst", "m"]).select(F.col("src").alias("vertex"), "m").distinct().join(found.select("vertex"), "vertex", "left_anti"))
            found, _ = written(found.unionByName(front))
        done = found if done is None else done.unionByName(found)
        left, _ = written(left.join(found.select("vertex"), "vertex", "left_anti"))
        edges, _ = written(inside.select("src", "dst").join(left.select(F.col("vertex").alias("src")), "src", "left_semi").join(left.select(F.col("vertex").alias("dst")), "dst", "left_semi"))
    return done.select("vertex", F.col("m").alias("labels")) if done is not None else g.vertices().select("vertex", F.col("vertex").alias("labels"))


def _trees(edges: DataFrame) -> DataFrame:
    """vertex: those of components without a cycle."""
    labels, _ = written(connected_labels(edges))
    n = labels.groupBy("label").agg(F.count("*").alias("n"))
    m = edges.join(labels.select(F.col("vertex").alias("src"), "label"), "src").groupBy("label").agg((F.count("*") / 2).alias("m"))
    return labels.join(n.join(m, "label").where("m = n - 1").select("label"), "label", "left_semi").select("vertex")


def core_number(g: Graph, max_rounds: int | None = None, patience: int = 16) -> DataFrame:
    """vertex, core_number: each value becomes the h-index of the neighbours' until none changes. Self-loops don't count.

    After ``patience`` rounds components that are trees, where long paths would take
    a round a vertex, are settled at once: 1 throughout. With ``max_rounds`` it
    raises if no fixpoint is met in as many.
    """
    if max_rounds is None and sweeps.fits(g):
        s = sweeps.Sweeps(g, weighted=False)
        return s.frame(_cores(s, g, patience), "c bigint").select(F.col("vertex").cast(g.edges.schema["src"].dataType).alias("vertex"), F.col("c").alias("core_number"))
    spark = g.edges.sparkSession
    edges, _ = written(g.edges.where("src != dst").select("src", "dst").distinct())
    state, path = written(g.vertices().join(edges.groupBy(F.col("src").alias("vertex")).agg(F.count("*").alias("c")), "vertex", "left").fillna(0, ["c"]).withColumn("f", F.lit(True)))
    rounds = 0
    while True:
        if max_rounds is not None and rounds >= max_rounds:
            raise FailedToConvergeError(f"core_number: no fixpoint in {max_rounds} rounds")
        rounds += 1
        if rounds == patience:
            settled, _ = written(_trees(edges).withColumn("tree", F.lit(True)))
            old, (state, path) = path, written(state.join(settled, "vertex", "left").select("vertex", F.when(F.col("tree"), F.least("c", F.lit(1))).otherwise(F.col("c")).alias("c"), "f"))
            forget(spark, old)
            edges, _ = written(edges.join(settled.select(F.col("vertex").alias("src")), "src", "left_anti"))
        seen = edges.join(state.select(F.col("vertex").alias("dst"), F.col("c").alias("v")), "dst").groupBy("src", "v").agg(F.count("*").alias("n"))  # counts by value, so a hub's neighbours combine
        packed = seen.groupBy(F.col("src").alias("vertex")).agg(F.reverse(F.sort_array(F.collect_list(F.struct("v", "n")))).alias("vs"))
        h = F.expr("aggregate(vs, struct(0L AS seen, 0L AS h), (a, x) -> struct(a.seen + x.n AS seen, greatest(a.h, least(x.v, a.seen + x.n)) AS h), a -> a.h)")
        old, (state, path) = path, written(state.join(packed.select("vertex", h.alias("h")), "vertex", "left").select("vertex", F.least("c", F.coalesce("h", "c")).alias("c"), F.expr("coalesce(h < c, false)").alias("f")))
        forget(spark, old)
        if state.where("f").isEmpty():
            break
    return state.select("vertex", F.col("c").alias("core_number"))


#: Steps that a block takes by itself in one round.
ALONE = 200


def _cores(s: sweeps.Sweeps, g: Graph, patience: int) -> sweeps.State:
    """State c, core numbers, by rounds over blocks. Values only fall and the fixpoint is one, so a block goes on by itself while its neighbours' values stay."""

    def step(edges, own, around):
        c, there, at, start = own["c"], around["c"], edges["at"], edges["start"]
        count, todo, some = np.diff(start), np.arange(len(start) - 1), 0
        for _ in range(ALONE):
            which, place = blocks.runs(count[todo], start[todo])
            v = np.minimum(np.where(at[place] == edges["own"][todo][which], 0, there[at[place]]), np.minimum(c, count)[todo][which])
            wide, first = int(v.max()) + 1, np.cumsum(count[todo]) - count[todo]
            v = wide - 1 - np.sort(which * wide + (wide - 1 - v)) % wide  # falling in each row
            h = np.maximum.reduceat(np.minimum(v, np.arange(len(which)) - np.repeat(first, count[todo]) + 1), first)
            fell = h < c[todo]
            if not fell.any():
                return {"c": c}, {"fell": some, "more": 0}
            some += int(fell.sum())
            c[todo[fell]] = h[fell]
            there[edges["own"][todo[fell]]] = h[fell]
            mark = np.zeros(len(there), bool)
            mark[edges["own"][todo[fell]]] = True
            todo = np.flatnonzero(np.logical_or.reduceat(mark[at], start[:-1]))
            if not len(todo):
                return {"c": c}, {"fell": some, "more": 0}
        return {"c": c}, {"fell": some, "more": 1}

    state, rounds, live = s.start(lambda rows: {"c": np.full(len(rows), 1 << 40)}), 0, list(range(len(s.blocks)))
    while live:
        rounds += 1
        if rounds == patience:
            settled = _trees(g.edges.where("src != dst").select("src", "dst")).withColumn("tree", F.lit(True))
            state = s.aligned(s.frame(state, "c bigint").join(settled, "vertex", "left").select("vertex", F.when(F.col("tree"), F.least("c", F.lit(1))).otherwise(F.col("c")).alias("c")), {"c": 0})
        state, said = s.round(state, step, ["c"], ["fell", "more"], live)
        live = sorted({*s.near({i for i, x in said.items() if x["fell"]}), *(i for i, x in said.items() if x["more"])})
    return state


def _core_edges(g: Graph, k: int, patience: int = 16) -> DataFrame:
    """Edges of the ``k``-core by rounds over blocks: vertices with fewer neighbours left go, until none has."""
    s = sweeps.Sweeps(g)

    def step(edges, own, around):
        left, there, at, some = own["left"], around["left"], edges["at"], 0
        other = at != edges["own"][sweeps.row_of(edges)]
        for _ in range(ALONE):
            goes = left & (np.add.reduceat((there[at] & other).astype(np.int64), edges["start"][:-1]) < k)
            if not goes.any():
                return {"left": left}, {"gone": some, "more": 0}
            some += int(goes.sum())
            left[goes] = False
            there[edges["own"][goes]] = False
        return {"left": left}, {"gone": some, "more": 1}

    state, rounds, live = s.start(lambda rows: {"left": np.ones(len(rows), bool)}), 0, list(range(len(s.blocks)))
    while live:
        rounds += 1
        if rounds == patience and k > 1:
            settled = _trees(g.edges.where("src != dst").select("src", "dst")).withColumn("tree", F.lit(True))
            state = s.aligned(s.frame(state, "left boolean").join(settled, "vertex", "left").select("vertex", F.expr("left AND tree IS NULL").alias("left")), {"left": False})
        state, said = s.round(state, step, ["left"], ["gone", "more"], live)
        live = sorted({*s.near({i for i, x in said.items() if x["gone"]}), *(i for i, x in said.items() if x["more"])})

    def tell(ids, edges, own, around, near):
        row = sweeps.row_of(edges)
        e = np.flatnonzero(own["left"][row] & around["left"][edges["at"]])
        return [ids[row[e]], near[edges["at"][e]], *([edges["weight"][e]] if "weight" in edges else [])]

    kinds = dict(g.edges.dtypes)
    return s.told(state, tell, ["left"], "src bigint, dst bigint" + (", weight double" if g.weighted else "")).select(*[F.col(c).cast(kinds[c]).alias(c) for c in g.edges.columns])


def connected_components(g: Graph, connection: str = "weak") -> DataFrame:
    """The weak or strong components, by name."""
    if connection not in ("weak", "strong"):
        raise ValueError("connection is weak or strong")
    return weakly_connected_components(g) if connection == "weak" else strongly_connected_components(g)


def strong_connected_component(g: Graph, vertex) -> DataFrame:
    """vertex: the strong component that holds one vertex, by what it reaches and what reaches it."""
    edges, _ = written(g.edges.select("src", "dst").distinct())
    start = g.vertices().where(F.col("vertex") == F.lit(vertex))

    def reached(e: DataFrame) -> DataFrame:
        found, path = written(start)
        front = found
        while not front.isEmpty():
            front, _ = written(front.join(e, F.col("vertex") == F.col("src")).select(F.col("dst").alias("vertex")).distinct().join(found, "vertex", "left_anti"))
            old, (found, path) = path, written(found.unionByName(front))
            forget(g.edges.sparkSession, old)
        return found

    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return reached(edges).join(reached(back), "vertex", "left_semi")


def k_core(g: Graph, k: int | None = None) -> DataFrame:
    """Edges among vertices of core number ``k`` or more; the largest there is by default."""
    if k is not None and sweeps.fits(g) and set(g.edges.columns) <= {"src", "dst", "weight"}:
        return _core_edges(g, k)
    cores, _ = written(core_number(g))
    k = cores.agg(F.max("core_number")).first()[0] if k is None else k
    return induced_subgraph(g, cores.where(F.col("core_number") >= k).select("vertex"))


def topological_sort(g: Graph) -> DataFrame:
    """vertex, level: the longest path from a source. Raises on cycles."""
    edges, _ = written(g.edges.select("src", "dst").distinct())
    left, _ = written(g.vertices())
    out, level = None, 0
    while not left.isEmpty():
        front, _ = written(left.join(edges.select(F.col("dst").alias("vertex")), "vertex", "left_anti"))
        if front.isEmpty():
            raise ValueError("the graph has a cycle")
        part = front.withColumn("level", F.lit(level))
        out = part if out is None else out.unionByName(part)
        left, _ = written(left.join(front, "vertex", "left_anti"))
        edges, _ = written(edges.join(front.select(F.col("vertex").alias("src")), "src", "left_anti"))
        level += 1
    return out if out is not None else left.withColumn("level", F.lit(0))


def minimum_spanning_tree(g: Graph) -> DataFrame:
    """src, dst, weight of a spanning forest's edges, src < dst; ties by the ends, so it is the same each time. Borůvka rounds."""
    if sweeps.fits(g):
        return _forest_in_blocks(g)
    edges, _ = written(g.weights().where("src != dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "weight").groupBy("src", "dst").agg(F.min("weight").alias("weight")))
    live, _ = written(edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.struct("weight", "src", "dst").alias("e")))
    chosen = None
    while not live.isEmpty():
        ends = live.select(F.explode(F.array("a", "b")).alias("c"), "e")
        picked, _ = written(ends.groupBy("c").agg(F.min("e").alias("e")).select("e").distinct())
        chosen = picked if chosen is None else chosen.unionByName(picked)
        joined = live.join(picked, "e", "left_semi").select(F.col("a").alias("src"), F.col("b").alias("dst"))
        labels, _ = written(connected_labels(joined))
        live, _ = written(live.join(labels.select(F.col("vertex").alias("a"), F.col("label").alias("x")), "a", "left").join(labels.select(F.col("vertex").alias("b"), F.col("label").alias("y")), "b", "left").select(F.coalesce("x", "a").alias("a"), F.coalesce("y", "b").alias("b"), "e").where("a != b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min("e").alias("e")))
    if chosen is None:
        return edges
    return chosen.distinct().select("e.src", "e.dst", "e.weight")


def _forest_in_blocks(g: Graph) -> DataFrame:
    """The same rounds with the edges in blocks: a block tells the least edge out of each tree that it has vertices of."""
    s, kind, chosen = sweeps.Sweeps(g), g.edges.schema["src"].dataType, None

    def tell(ids, edges, own, around, near):
        row, at = sweeps.row_of(edges), edges["at"]
        out = own["tree"][row] != around["tree"][at]
        w = np.where(out, sweeps.weight(edges), np.inf)
        e = np.flatnonzero(out & (w == np.minimum.reduceat(w, edges["start"][:-1])[row]))
        a, b, tree = ids[row[e]], near[at[e]], own["tree"][row[e]]
        low, high = np.minimum(a, b), np.maximum(a, b)
        order = np.lexsort((high, low, w[e], tree))
        _, first = np.unique(tree[order], return_index=True)
        o = order[first]
        return [tree[o], w[e][o], low[o], high[o], around["tree"][at[e[o]]]]

    state = s.start(lambda rows: {"tree": rows})
    while True:
        told = s.told(state, tell, ["tree"], "tree bigint, weight double, src bigint, dst bigint, other bigint")
        picked, _ = written(told.groupBy("tree").agg(F.min(F.struct("weight", "src", "dst", "other")).alias("e")).select("tree", "e.*"))
        found = picked.select("src", "dst", "weight")
        chosen = found if chosen is None else chosen.unionByName(found)
        if picked.isEmpty():
            break
        labels = joined_labels(picked, "tree", "other").select(F.col("vertex").alias("tree"), "label")
        state = s.aligned(s.frame(state, "tree bigint").join(labels, "tree", "left").select("vertex", F.coalesce("label", "tree").alias("tree")), {"tree": 0})
    return chosen.distinct().select(F.col("src").cast(kind).alias("src"), F.col("dst").cast(kind).alias("dst"), "weight")


def maximum_spanning_tree(g: Graph) -> DataFrame:
    flipped = Graph(g.weights().withColumn("weight", -F.col("weight")), g.directed, own_vertices=g.own_vertices, ranged=g.ranged)
    return minimum_spanning_tree(flipped).withColumn("weight", -F.col("weight"))


def weighted_matching(g: Graph) -> DataFrame:
    """src, dst, weight, src < dst: each vertex offers to its heaviest neighbour (ties to the larger id), mutual offers match, until none is left."""
    live, _ = written(g.weights().where("src != dst"))
    out = None
    while not live.isEmpty():
        offer = live.groupBy("src").agg(F.max(F.struct("weight", "dst")).alias("o")).select("src", F.col("o.dst").alias("dst"), F.col("o.weight").alias("weight"))
        pairs, _ = written(offer.join(offer.select(F.col("src").alias("dst"), F.col("dst").alias("src")), ["src", "dst"]))
        if pairs.isEmpty():
            break
        out = pairs if out is None else out.unionByName(pairs)
        taken = pairs.select("src")
        live, _ = written(live.join(taken, "src", "left_anti").join(taken.select(F.col("src").alias("dst")), "dst", "left_anti"))
    return out.where("src < dst") if out is not None else live


def maximal_independent_set(g: Graph, seed: int = 42) -> DataFrame:
    """vertex: those whose seeded hash is smallest around them, again and again among what is left."""
    if sweeps.fits(g):
        return _independent_in_blocks(g, seed)
    edges, _ = written(g.edges.where("src != dst").select("src", "dst").distinct())
    left, _ = written(g.vertices())
    out = None
    while not left.isEmpty():
        mark = F.struct(F.xxhash64(F.lit(seed), "dst"), "dst")
        low = edges.groupBy(F.col("src").alias("vertex")).agg(F.min(mark).alias("m"))
        won, _ = written(left.join(low, "vertex", "left").where(F.col("m").isNull() | (F.struct(F.xxhash64(F.lit(seed), "vertex"), "vertex") < F.col("m"))).select("vertex"))
        out = won if out is None else out.unionByName(won)
        around = edges.join(won.select(F.col("vertex").alias("src")), "src", "left_semi").select(F.col("dst").alias("vertex")).unionByName(won)
        left, _ = written(left.join(around, "vertex", "left_anti"))
        edges, _ = written(edges.join(left.select(F.col("vertex").alias("src")), "src", "left_semi").join(left.select(F.col("vertex").alias("dst")), "dst", "left_semi"))
    return out if out is not None else left


def _independent_in_blocks(g: Graph, seed: int) -> DataFrame:
    """The same rounds with the edges in blocks. State now: 0 left, 1 taken, 2 beside one taken."""
    s, kind = sweeps.Sweeps(g, weighted=False), g.edges.schema["src"].dataType
    hashed = s.vertices().select("vertex", F.xxhash64(F.lit(seed), F.col("vertex").cast(kind)).alias("mark"), F.lit(0).cast("bigint").alias("now"))
    state = s.aligned(hashed, {"mark": 0, "now": 2})

    def take(edges, own, around):
        at, row = edges["at"], sweeps.row_of(edges)
        mark, mine = around["mark"][at], own["mark"][row]
        before = (around["now"][at] == 0) & ((mark < mine) | ((mark == mine) & (at < edges["own"][row])))
        won = (own["now"] == 0) & ~np.logical_or.reduceat(before, edges["start"][:-1])
        own["now"][won] = 1
        return own, {"some": won.sum(), "left": 0}

    def leave(edges, own, around):
        beside = np.logical_or.reduceat(around["now"][edges["at"]] == 1, edges["start"][:-1])
        own["now"][(own["now"] == 0) & beside] = 2
        return own, {"some": 0, "left": (own["now"] == 0).sum()}

    live = list(range(len(s.blocks)))
    while live:
        state, _ = s.round(state, take, ["mark", "now"], ["some", "left"], live)
        state, said = s.round(state, leave, ["now"], ["some", "left"], live)
        live = [i for i, x in said.items() if x["left"]]
    return s.frame(state, "now bigint").where("now = 1").select(F.col("vertex").cast(kind).alias("vertex"))


def vertex_coloring(g: Graph, seed: int = 42) -> DataFrame:
    """vertex, color: the round in which an independent set took the vertex."""
    out, color, now = None, 0, g
    left, _ = written(g.vertices())
    while not left.isEmpty():
        won, _ = written(maximal_independent_set(Graph(now.edges, False, own_vertices=left), seed + color))
        part = won.withColumn("color", F.lit(color))
        out = part if out is None else out.unionByName(part)
        left, _ = written(left.join(won, "vertex", "left_anti"))
        edges, _ = written(now.edges.join(left.select(F.col("vertex").alias("src")), "src", "left_semi").join(left.select(F.col("vertex").alias("dst")), "dst", "left_semi"))
        now, color = Graph(edges), color + 1
    return out if out is not None else left.withColumn("color", F.lit(0))
