"""Pattern matching as joins, bicliques, assignment and layout."""

from __future__ import annotations

from itertools import combinations, permutations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.graph import Graph
from loomgraph.operators.community import triangles
from loomgraph.plans.blocks import numbered
from loomgraph.plans.shared import written


def subgraph_monomorphism(g: Graph, pattern: list[tuple[int, int]]) -> DataFrame:
    """A column for each pattern vertex, a row for each injective mapping that keeps the pattern's edges. The pattern is connected. Where it holds a triangle, triangles come first, so that their wedges are joined to nothing."""
    left, known, out = list(dict.fromkeys(tuple(sorted(x)) for x in pattern)), [], None
    three = next((x for x in combinations(sorted({v for p in left for v in p}), 3) if all(y in left for y in combinations(x, 2))), None)
    if three and not g.directed and numbered(g.edges):
        ways = F.array(*[F.struct(*[F.col(c).alias(f"v{v}") for v, c in zip(three, way, strict=True)]) for way in permutations("abc")])
        out, known, left = triangles(g).select(F.explode(ways).alias("x")).select("x.*"), list(three), [x for x in left if not set(x) <= set(three)]
    e, _ = written(g.edges.where("src != dst").select("src", "dst").distinct()) if left else (None, None)
    while left:
        at = next((x for x in left if known and (x[0] in known or x[1] in known)), left[0] if not known else None)
        if at is None:
            raise ValueError("the pattern isn't connected")
        left.remove(at)
        a, b = at if not known or at[0] in known else at[::-1]
        step = e.select(F.col("src").alias(f"v{a}"), F.col("dst").alias(f"v{b}"))
        out = step if out is None else out.join(step, [f"v{x}" for x in (a, b) if x in known])
        for new in (x for x in (a, b) if x not in known):
            for old in known:
                out = out.where(F.col(f"v{new}") != F.col(f"v{old}"))
            known.append(new)
    return out.select(*[F.col(f"v{x}").alias(str(x)) for x in sorted(known)])


def find_bicliques(df: DataFrame, support: float = 1.0, min_features: int = 1, min_machines: int = 2, k: int = 10) -> DataFrame:
    """biclique, machines, features of (src machine, dst feature) rows: of the ``k`` commonest features, its machines and the features that ``support`` of them share."""
    e, _ = written(df.select("src", "dst").distinct())
    tops = e.groupBy("dst").agg(F.count("*").alias("n")).where(F.col("n") >= min_machines).orderBy(F.desc("n"), "dst").limit(k)
    machines = e.join(tops.select(F.col("dst"), F.col("n")), "dst").select(F.col("dst").alias("biclique"), "src", "n")
    shared = machines.join(e, "src").groupBy("biclique", "n", "dst").agg(F.count("*").alias("c")).where(F.col("c") >= F.ceil(F.lit(support) * F.col("n")))
    return shared.groupBy("biclique", F.col("n").alias("machines")).agg(F.count("*").alias("features")).where(F.col("features") >= min_features)


def assignment(costs: np.ndarray) -> tuple[float, list[int]]:
    """The least total cost of giving each row a column of its own, and the columns (shortest augmenting paths)."""
    c = np.asarray(costs, float)
    n, m = c.shape
    if n > m:
        raise ValueError("more rows than columns")
    u, v, row_of = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        row_of[0], j = i, 0
        least, way, used = np.full(m + 1, np.inf), np.zeros(m + 1, int), np.zeros(m + 1, bool)
        while True:
            used[j] = True
            free = np.flatnonzero(~used[1:]) + 1
            reduced = c[row_of[j] - 1, free - 1] - u[row_of[j]] - v[free]
            better = reduced < least[free]
            least[free[better]], way[free[better]] = reduced[better], j
            nxt = free[np.argmin(least[free])]
            delta = least[nxt]
            u[row_of[used]] += delta
            v[used] -= delta
            least[~used] -= delta
            j = nxt
            if row_of[j] == 0:
                break
        while j:
            row_of[j] = row_of[way[j]]
            j = way[j]
    columns = [0] * n
    for j in range(1, m + 1):
        if row_of[j]:
            columns[row_of[j] - 1] = j - 1
    return float(sum(c[i, j] for i, j in enumerate(columns))), columns


def hungarian(g: Graph, workers: DataFrame, most: int = 4000) -> tuple[float, DataFrame]:
    """(cost, (vertex, assignment)): the cheapest matching of all workers along edges. One dense problem, so at most ``most`` vertices a side; more raise."""
    spark = g.edges.sparkSession
    e = g.weights().join(workers.select(F.col("vertex").alias("src")), "src", "left_semi").groupBy("src", "dst").agg(F.min("weight").alias("weight"))
    rows, cols = ([r[0] for r in e.select(c).distinct().orderBy(c).limit(most + 1).collect()] for c in ("src", "dst"))
    if max(len(rows), len(cols)) > most:
        raise ValueError(f"more than {most} vertices a side")
    at_row, at_col = {x: i for i, x in enumerate(rows)}, {x: i for i, x in enumerate(cols)}
    cost = np.full((len(rows), len(cols)), 1e12)
    for r in e.collect():
        cost[at_row[r[0]], at_col[r[1]]] = r[2]
    total, columns = assignment(cost)
    return total, spark.createDataFrame([(rows[i], cols[j]) for i, j in enumerate(columns)], "vertex bigint, assignment bigint")


def force_atlas2(g: Graph, max_iter: int = 100, scaling_ratio: float = 2.0, gravity: float = 1.0, lin_log: bool = False, strong_gravity: bool = False, seed: int = 42, most: int = 20_000, callback=None) -> DataFrame:
    """vertex, x, y: a spring layout with exact repulsion, in numpy on the driver, for at most ``most`` vertices; more raise."""
    spark = g.edges.sparkSession
    names = [r[0] for r in g.vertices().orderBy("vertex").limit(most + 1).collect()]
    if len(names) > most:
        raise ValueError(f"more than {most} vertices")
    at = {x: i for i, x in enumerate(names)}
    rows = [(at[r[0]], at[r[1]], r[2]) for r in g.weights().where("src != dst").collect()]
    src, dst = np.array([r[0] for r in rows], int), np.array([r[1] for r in rows], int)
    w, n = np.array([r[2] for r in rows], float), len(names)
    pos, mass = np.random.default_rng(seed).uniform(-100, 100, (n, 2)), 1.0 + np.bincount(src, minlength=n)
    old, speed = np.zeros((n, 2)), 1.0
    for i in range(max_iter):
        force = np.zeros((n, 2))
        for lo in range(0, n, 1024):
            gap = pos[lo : lo + 1024, None] - pos[None]
            square = (gap**2).sum(2)
            np.maximum(square, 1e-9, out=square)
            force[lo : lo + 1024] = (gap * (scaling_ratio * mass[lo : lo + 1024, None] * mass[None] / square)[:, :, None]).sum(1)
        far = np.linalg.norm(pos, axis=1, keepdims=True) + 1e-9
        force -= gravity * mass[:, None] * pos * (1.0 if strong_gravity else 1 / far)
        if len(src):
            gap = pos[src] - pos[dst]
            pull = w * (np.log1p(d := np.linalg.norm(gap, axis=1)) / np.maximum(d, 1e-9) if lin_log else 1.0)
            np.add.at(force, src, -gap * pull[:, None])
        swing, drive = (mass * np.linalg.norm(force - old, axis=1)).sum(), (mass * np.linalg.norm(force + old, axis=1)).sum() / 2
        speed = min(speed * 1.5, drive / (swing + 1e-9))
        each = speed / (1 + np.sqrt(speed * mass * np.linalg.norm(force - old, axis=1)))
        pos, old = pos + force * each[:, None], force
        if callback:
            callback(i, pos)
    return spark.createDataFrame([(v, float(x), float(y)) for v, (x, y) in zip(names, pos, strict=True)], "vertex bigint, x double, y double")
