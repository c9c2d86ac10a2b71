"""Rounds over an undirected graph's blocks: each task holds a block's edges and what its rows and their neighbours are worth.

What vertices are worth lies in a file for each block, in the order of its rows; a
round writes new ones. No round shuffles anything, and the driver gets a few numbers
a block.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.graph import Graph
from loomgraph.plans.blocks import META, Blocks, load, packer, save, sliced, store
from loomgraph.plans.shared import forget, shared_dir

#: Edges of a block, some more where a vertex has many.
EDGES = 1_000_000

State = list[str]


def fits(g: Graph) -> bool:
    """Whether rounds over blocks can do ``g``: every vertex has a row, and every neighbour is one."""
    return g.ranged and g.own_vertices is None


class Sweeps:
    """The blocks of ``g`` (weights of 1 where it has none), each neighbour known by its place among the rows of the blocks around."""

    def __init__(self, g: Graph, weighted: bool = True, edges: int | None = None):
        self.spark = g.edges.sparkSession
        self.folder = f"{shared_dir(self.spark)}/blocks/{uuid.uuid4().hex}"
        e = g.edges.select("src", "dst", *(["weight"] if weighted and g.weighted else []))
        found = e.mapInArrow(packer(self.folder, "sum", edges or EDGES), META).collect()
        self.blocks = Blocks(self.spark, self.folder, sorted((tuple(r) for r in found), key=lambda r: r[1]))
        meta = self.blocks.meta
        lo, hi = np.array([m[1] for m in meta], np.int64), np.array([m[2] for m in meta], np.int64)
        self.lo, self.n = lo, sum(m[3] for m in meta)
        self.around = [range(int(np.searchsorted(hi, m[5])), int(np.searchsorted(lo, m[6], "right"))) for m in meta]
        folder, around = self.folder, self.around

        def rows_out(i: int) -> Iterator[pa.RecordBatch]:
            save(f"{folder}/rows-{i}.npz", {"rows": load(meta[i][0])["rows"]})
            yield pa.RecordBatch.from_pylist([{"i": i}])

        def link(i: int) -> Iterator[pa.RecordBatch]:
            b, ids = load(meta[i][0]), np.concatenate([load(f"{folder}/rows-{j}.npz")["rows"] for j in around[i]])
            arrays = {"at": np.searchsorted(ids, b["dst"]).astype(np.int32), "start": b["start"], "own": np.searchsorted(ids, b["rows"]) if len(b["rows"]) else b["rows"]}
            save(f"{folder}/edges-{i}.npz", arrays | ({"weight": b["weight"]} if "weight" in b else {}))
            yield pa.RecordBatch.from_pylist([{"i": i}])

        everything = list(range(len(meta)))
        for work in (rows_out, link):
            self.blocks.tasks(everything, work, "i bigint").collect()

        def drop(i: int) -> Iterator[pa.RecordBatch]:
            files, path = store(meta[i][0])
            files.delete_file(path)
            yield pa.RecordBatch.from_pylist([{"i": i}])

        self.blocks.tasks(everything, drop, "i bigint").collect()  # linked edges take its place

    def start(self, make: Callable[[np.ndarray], dict[str, np.ndarray]]) -> State:
        """Values of all rows by their ids."""
        folder, name = self.folder, uuid.uuid4().hex

        def work(i: int) -> Iterator[pa.RecordBatch]:
            save(f"{folder}/{name}-{i}.npz", make(load(f"{folder}/rows-{i}.npz")["rows"]))
            yield pa.RecordBatch.from_pylist([{"i": i}])

        self.blocks.tasks(list(range(len(self.blocks))), work, "i bigint").collect()
        return [f"{folder}/{name}-{i}.npz" for i in range(len(self.blocks))]

    def aligned(self, df: DataFrame, missing: dict) -> State:
        """Values of the rows that ``df`` has (vertex and the columns of ``missing``); others are as ``missing`` says. The ids are there too, as id."""
        folder, name, lo, names = self.folder, uuid.uuid4().hex, self.lo, list(missing)

        def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                at = np.maximum(np.searchsorted(lo, b.column("vertex").to_numpy(zero_copy_only=False), "right") - 1, 0)
                yield b.append_column("_block", pa.array(at.astype(np.int64)))

        def put(table: pa.Table) -> pa.Table:
            i = table.column("_block")[0].as_py()
            rows, ids = load(f"{folder}/rows-{i}.npz")["rows"], table.column("vertex").to_numpy()
            at = np.minimum(np.searchsorted(rows, ids), len(rows) - 1)
            there = rows[at] == ids
            arrays = {"id": rows}
            for c in names:
                got = table.column(c).to_numpy()
                got = got.astype(bool) if got.dtype == object else got
                arrays[c] = np.full(len(rows), missing[c], got.dtype)
                arrays[c][at[there]] = got[there]
            save(f"{folder}/{name}-{i}.npz", arrays)
            return pa.table({"i": pa.array([i], pa.int64())})

        dealt = df.select(F.col("vertex").cast("bigint").alias("vertex"), *names)
        done = {r[0] for r in dealt.mapInArrow(placed, ", ".join(f"{c} {t}" for c, t in dealt.dtypes) + ", _block bigint").groupBy("_block").applyInArrow(put, "i bigint").collect()}
        rest = self.start(lambda rows: {"id": rows} | {c: np.full(len(rows), v) for c, v in missing.items()}) if len(done) < len(self.blocks) else []
        return [f"{folder}/{name}-{i}.npz" if i in done else rest[i] for i in range(len(self.blocks))]

    def round(self, state: State, step: Callable, needs: list[str], stats: list[str], only: list[int] | None = None) -> tuple[State, dict[int, dict[str, float]]]:
        """New values by ``step(edges, own, around)``, which gives them and ``stats`` (numbers); of blocks not in ``only`` the old ones stay.

        ``around`` has the columns in ``needs`` of the rows around; ``edges`` has at
        (a place there for each edge), start (of each row's edges), own (the rows'
        places there) and weight.
        """
        folder, around, name = self.folder, self.around, uuid.uuid4().hex
        items = [(i, state[i], [state[j] for j in around[i]]) for i in (range(len(self.blocks)) if only is None else only)]

        def work(item) -> Iterator[pa.RecordBatch]:
            i, mine, near = item
            held = [load(f) for f in near] if needs else []
            there = {c: np.concatenate([h[c] for h in held]) for c in needs}
            new, said = step(load(f"{folder}/edges-{i}.npz") if needs else None, load(mine), there)
            save(f"{folder}/{name}-{i}.npz", new)
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), *[pa.array([float(said[s])]) for s in stats]], names=["i", *stats])

        got = self.blocks.tasks(items, work, ", ".join(["i bigint", *[f"{s} double" for s in stats]])).collect() if items else []
        new = list(state)
        for r in got:
            new[r[0]] = f"{folder}/{name}-{r[0]}.npz"
        self._drop([old for old, now in zip(state, new, strict=True) if old != now])
        return new, {r[0]: {s: r[k + 1] for k, s in enumerate(stats)} for r in got}

    def _drop(self, names: list[str]) -> None:
        for name in names:
            forget(self.spark, name)

    def near(self, changed: set[int]) -> list[int]:
        """Blocks that have neighbours in those."""
        return [i for i, r in enumerate(self.around) if any(j in changed for j in r)]

    def told(self, state: State, tell: Callable, needs: list[str], schema: str, with_edges: bool = True) -> DataFrame:
        """Rows that ``tell(ids, edges, own, around, ids around)`` gives for each block, as columns."""
        folder, around = self.folder, self.around
        names = [c.split()[0] for c in schema.split(", ")]
        items = [(i, state[i] if state else None, [state[j] for j in around[i]] if state else []) for i in range(len(self.blocks))]

        def work(item) -> Iterator[pa.RecordBatch]:
            i, mine, near = item
            there = {}
            if needs:
                held = [load(f) for f in near]
                there = {c: np.concatenate([h[c] for h in held]) for c in needs}
            ids = np.concatenate([load(f"{folder}/rows-{j}.npz")["rows"] for j in around[i]]) if with_edges else None
            out = tell(load(f"{folder}/rows-{i}.npz")["rows"], load(f"{folder}/edges-{i}.npz") if with_edges else None, load(mine) if mine else None, there, ids)
            yield from sliced(names, list(out))

        return self.spark.createDataFrame([], schema) if not items else self.blocks.tasks(items, work, schema)

    def vertices(self) -> DataFrame:
        return self.told([], lambda ids, *rest: [ids], [], "vertex bigint", with_edges=False)

    def frame(self, state: State, schema: str) -> DataFrame:
        """vertex and the columns that ``schema`` names."""
        names = [c.split()[0] for c in schema.split(", ")]
        return self.told(state, lambda ids, _, own, *rest: [ids, *[own[c] for c in names]], [], f"vertex bigint, {schema}", with_edges=False)


def summed(edges: dict, values: np.ndarray) -> np.ndarray:
    """For each row the sum of its edges' values."""
    return np.add.reduceat(values, edges["start"][:-1])


def weight(edges: dict):
    """An edge's weight; 1 where there are none."""
    return edges.get("weight", 1.0)


def row_of(edges: dict) -> np.ndarray:
    return np.repeat(np.arange(len(edges["start"]) - 1), np.diff(edges["start"]))
