"""Edges cut into blocks of whole rows (a vertex and all its neighbours), files in the shared folder.

A task holds one block, or two of them: what two vertices have in common is found
where their rows are, and nothing that grows with the number of wedges is shuffled.
Blocks are ranges of ids, so pairs of blocks without common neighbours are left out.
Ids are whole numbers.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from loomgraph.graph import numbered  # noqa: F401  blocks need whole numbers
from loomgraph.plans.shared import forget, shared_dir, written

#: Edges of a block at most (one vertex's are never parted), and of a block where there are fewer blocks than cores.
MOST, LEAST = 4_000_000, 50_000
#: Wedges held at once, and rows given back at once.
STEP, OUT = 2_000_000, 100_000


def store(where: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(where)


def save(where: str, arrays: dict[str, np.ndarray]) -> None:
    """Writes arrays as one file, whole or not at all."""
    files, path = store(where)
    files.create_dir(path.rsplit("/", 1)[0], recursive=True)
    held, draft = io.BytesIO(), f"{path}.{uuid.uuid4().hex}"
    np.savez(held, **arrays)
    with files.open_output_stream(draft, compression=None) as out:
        out.write(held.getbuffer())
    files.move(draft, path)


def load(where: str) -> dict[str, np.ndarray]:
    files, path = store(where)
    with files.open_input_stream(path, compression=None) as f:
        found = np.load(io.BytesIO(f.read()))
        return {k: found[k] for k in found.files}


@dataclass
class Blocks:
    """``meta`` has a tuple for each block, by ids: file, first and last row, rows, edges, least and largest neighbour."""

    spark: SparkSession
    folder: str
    meta: list[tuple]

    def __len__(self) -> int:
        return len(self.meta)

    def tasks(self, items: list, work: Callable[[object], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
        """``work`` on each of the items, a task each."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in batch.column("id").to_pylist():
                    yield from work(items[i])

        return self.spark.range(0, len(items), 1, max(1, len(items))).mapInArrow(run, schema)

    def forget(self) -> None:
        forget(self.spark, self.folder)


def cut(edges: DataFrame, merge: str = "sum", most: int | None = None) -> Blocks:
    """Blocks of (src, dst) or (src, dst, weight), rows by src; weights of parallel edges by ``merge``: sum or min."""
    spark, weighted = edges.sparkSession, "weight" in edges.columns
    held, path = written(edges.select("src", "dst", *(["weight"] if weighted else [])))  # counted, then read for the ranges and for the rows
    n, cores = held.count(), spark.sparkContext.defaultParallelism
    parts = max(-(-n // (most or MOST)), min(cores, -(-n // LEAST)), 1)
    folder = f"{shared_dir(spark)}/blocks/{uuid.uuid4().hex}"

    found = held.repartitionByRange(parts, "src").mapInArrow(packer(folder, merge, None), META).collect()
    forget(spark, path)
    return Blocks(spark, folder, sorted((tuple(r) for r in found), key=lambda r: r[1]))


META = "file string, lo bigint, hi bigint, n bigint, m bigint, a bigint, b bigint"


def packer(folder: str, merge: str, most: int | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Writes a partition of whole rows as one block, or as blocks of some ``most`` edges."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        table = pa.Table.from_batches(got)
        src, dst = (table.column(c).to_numpy().astype(np.int64, copy=False) for c in ("src", "dst"))
        order = np.lexsort((dst, src))
        src, dst = src[order], dst[order]
        first = np.flatnonzero(np.r_[True, (src[1:] != src[:-1]) | (dst[1:] != dst[:-1])])
        dst, w = dst[first], None
        if "weight" in table.column_names:
            w = table.column("weight").to_numpy()[order]
            w = w if len(first) == len(w) else {"sum": np.add, "min": np.minimum}[merge].reduceat(w, first)
        rows, start = np.unique(src[first], return_index=True)
        start = np.r_[start, len(first)].astype(np.int64)
        for lo, hi in steps(np.diff(start), most) if most else [(0, len(rows))]:
            e = slice(start[lo], start[hi])
            arrays = {"rows": rows[lo:hi], "start": start[lo : hi + 1] - start[lo], "dst": dst[e]}
            if w is not None:
                arrays["weight"] = w[e]
            name = f"{folder}/{uuid.uuid4().hex}.npz"
            save(name, arrays)
            yield pa.RecordBatch.from_pylist([{"file": name, "lo": int(rows[lo]), "hi": int(rows[hi - 1]), "n": hi - lo, "m": int(e.stop - e.start), "a": int(dst[e].min()), "b": int(dst[e].max())}])

    return pack


def runs(count: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges of ``count`` places from ``start``: which range, and the place."""
    which = np.repeat(np.arange(len(count)), count)
    return which, np.arange(len(which)) + np.repeat(start - (np.cumsum(count) - count), count)


def steps(work: np.ndarray, most: int = STEP) -> Iterator[tuple[int, int]]:
    """Slices of ``work`` that add up to some ``most`` each."""
    done, at = np.cumsum(work), 0
    while at < len(work):
        to = max(at + 1, int(np.searchsorted(done, (done[at - 1] if at else 0) + most, "right")))
        yield at, to
        at = to


def sliced(names: list[str], columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(columns[0]), OUT):
        yield pa.RecordBatch.from_arrays([pa.array(c[i : i + OUT]) for c in columns], names=names)


def _places(of: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each of ``of`` is in the sorted ``among``, and whether it is."""
    at = np.minimum(np.searchsorted(among, of), len(among) - 1)
    return at, among[at] == of


def products(left: Blocks, right: Blocks, value: Callable | None, schema: str) -> DataFrame:
    """A row for each pair of a row of ``left`` and one of ``right`` that share a neighbour: first, second and what ``value`` says.

    ``value`` gets the number of shared neighbours, a function that adds up an array
    over them for each pair, both weights at every wedge (None without weights), and
    the sums of both whole rows.
    """
    names = [c.split()[0] for c in schema.split(", ")]

    def work(item) -> Iterator[pa.RecordBatch]:
        a, b = (load(x) for x in item)
        wa, wb = a.get("weight"), b.get("weight")
        mids_of_b = np.argsort(b["dst"], kind="stable")
        mids, begin = np.unique(b["dst"][mids_of_b], return_index=True)
        begin = np.r_[begin, len(mids_of_b)]
        row_b = np.repeat(np.arange(len(b["rows"])), np.diff(b["start"]))[mids_of_b]
        at, there = _places(a["dst"], mids)
        count = np.where(there, begin[at + 1] - begin[at], 0)
        row_a = np.repeat(np.arange(len(a["rows"])), np.diff(a["start"]))
        size_a, size_b = (np.diff(x["start"]).astype(float) if w is None else np.add.reduceat(w, x["start"][:-1]) for x, w in ((a, wa), (b, wb)))
        wide, total = len(b["rows"]), np.r_[0, np.cumsum(count)]
        for lo, hi in steps(total[a["start"][1:]] - total[a["start"][:-1]]):
            e = slice(a["start"][lo], a["start"][hi])
            which, place = runs(count[e], begin[at[e]])
            if not len(which):
                continue
            key = (row_a[e][which] - lo) * wide + row_b[place]
            if (hi - lo) * wide <= 6 * len(key):  # most cells are met: count in place
                n = np.bincount(key, minlength=(hi - lo) * wide)
                cells = np.flatnonzero(n)
                n = n[cells]

                def added(x, key=key, cells=cells, size=(hi - lo) * wide):
                    return np.bincount(key, x, minlength=size)[cells]
            else:
                order = None if wa is None else np.argsort(key)
                key = np.sort(key) if order is None else key[order]
                first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
                cells, n = key[first], np.diff(np.r_[first, len(key)])

                def added(x, order=order, first=first):
                    return np.add.reduceat(x[order], first)
            r, c = cells // wide + lo, cells % wide
            out = [a["rows"][r], b["rows"][c]]
            if value:
                weights = (None, None) if wa is None else (wa[e][which], wb[mids_of_b[place]])
                out.append(value(n, added, *weights, size_a[r], size_b[c]))
            yield from sliced(names, out)

    items = [(x[0], y[0]) for x in left.meta for y in right.meta if x[5] <= y[6] and y[5] <= x[6]]
    return left.spark.createDataFrame([], schema) if not items else left.tasks(items, work, schema)


class _Members:
    """Whether a block has (row, neighbour): a table of hashes, then the sorted pairs."""

    def __init__(self, block: dict[str, np.ndarray], least: int, wide: int):
        row = np.repeat(np.arange(len(block["rows"])), np.diff(block["start"]))
        self.least, self.wide, self.keys = least, wide, row * wide + (block["dst"] - least)
        self.shift = np.uint64(64 - max(10, (16 * len(row)).bit_length()))
        self.seen = np.zeros(1 << (64 - int(self.shift)), bool)
        self.seen[self._hash(self.keys)] = True

    def _hash(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def have(self, row: np.ndarray, dst: np.ndarray) -> np.ndarray:
        """Places of those that are there."""
        keys = row * self.wide + (dst - self.least)
        maybe = np.flatnonzero(self.seen[self._hash(keys)])
        return maybe[_places(keys[maybe], self.keys)[1]]


def shared_by_edges(blocks: Blocks, names: tuple[str, str, str]) -> DataFrame:
    """For each edge (u, v) and each vertex that both lead to: u, v and it. The shorter of both rows is gone through."""

    def work(item) -> Iterator[pa.RecordBatch]:
        a = load(item[0])
        b = a if item[0] == item[1] else load(item[1])
        v, there = _places(a["dst"], b["rows"])
        edge = np.flatnonzero(there)
        if not len(edge):
            return
        u, v = np.repeat(np.arange(len(a["rows"])), np.diff(a["start"]))[edge], v[edge]
        least = min(a["dst"].min(), b["dst"].min())
        wide = int(max(a["dst"].max(), b["dst"].max()) - least) + 1
        da, db = np.diff(a["start"])[u], np.diff(b["start"])[v]
        if max(len(a["rows"]), len(b["rows"])) * wide >= 1 << 62:  # far ids: by their order among those here
            ids = np.unique(np.concatenate([a["dst"], b["dst"]]))
            a, b = ({**x, "dst": np.searchsorted(ids, x["dst"])} for x in (a, b))
            least, wide = 0, len(ids)
        else:
            ids = None
        for mine, over, held, over_at, held_at in ((da > db, b, a, v, u), (da <= db, a, b, u, v)):
            mine = np.flatnonzero(mine)
            if not len(mine):
                continue
            members, count = _Members(held, least, wide), np.diff(over["start"])[over_at[mine]]
            for lo, hi in steps(count):
                at = mine[lo:hi]
                which, place = runs(count[lo:hi], over["start"][over_at[at]])
                c = over["dst"][place]
                got = members.have(held_at[at][which], c)
                e = at[which[got]]
                c = c[got] if ids is None else ids[c[got]]
                yield from sliced(list(names), [a["rows"][u[e]], b["rows"][v[e]], c])

    schema = ", ".join(f"{n} bigint" for n in names)
    items = [(x[0], y[0]) for x in blocks.meta for y in blocks.meta if x[5] <= y[2] and y[1] <= x[6] and x[5] <= y[6] and y[5] <= x[6]]
    return blocks.spark.createDataFrame([], schema) if not items else blocks.tasks(items, work, schema)
