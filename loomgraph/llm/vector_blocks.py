"""Vectors in blocks: every query block meets every candidate block once, each pair a task's unit of work."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.plans.shared import written

#: Vectors in a block, about. They set the size of a unit of work, not what is compared.
BLOCK = 2048


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``(_id, _v)`` of the rows with an id and a vector of finite components; the vector as doubles."""
    v = vectors.select(F.col(id_col).cast("bigint").alias("_id"), F.col(vec_col).cast("array<double>").alias("_v"))
    return v.where("_id IS NOT NULL AND _v IS NOT NULL AND size(_v) > 0 AND forall(_v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity'))")


def distinct(vectors: DataFrame) -> tuple[DataFrame, int]:
    """Rows of :func:`usable` that differ in id or vector, written in the shared folder, and their number."""
    rows, _ = written(vectors.select("_id", "_v").dropDuplicates())
    return rows, rows.count()


def sample(vectors: DataFrame, count: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """At most ``most`` of ``count`` rows, by the order of a hash of the id: ids, one row each, and vectors of the commonest length among them.

    Only rows below a limit of the hash are sorted, some twice as many as are wanted;
    else every partition of the table would send the driver ``most`` rows of its own.
    """
    share = 2 * most / max(1, count)
    while True:
        low = vectors if share >= 1 else vectors.where(F.xxhash64("_id") < F.lit(int(share * 2.0**64) - 2**63))
        rows = low.groupBy("_id").agg(F.min("_v").alias("_v")).orderBy(F.xxhash64("_id"), "_id").limit(most).collect()
        if len(rows) == most or share >= 1:
            break
        share *= 2  # ids repeat: fewer of them lie below the limit
    if not rows:
        return np.zeros(0, np.int64), np.zeros((0, 0))
    sizes = [len(r[1]) for r in rows]
    size = max(set(sizes), key=lambda n: (sizes.count(n), n))
    kept = [r for r in rows if len(r[1]) == size]
    return np.array([r[0] for r in kept], np.int64), np.array([r[1] for r in kept])


def once(ids: np.ndarray, scores: np.ndarray) -> np.ndarray:
    """Places of rows that differ in id or score, one each."""
    if len(np.unique(ids)) == len(ids):
        return np.arange(len(ids))
    return np.array(sorted(dict(zip(zip(ids.tolist(), scores.tolist()), range(len(ids)))).values()), np.int64)


def floors(scores: np.ndarray, qids: np.ndarray, known_ids: np.ndarray, k: int) -> np.ndarray:
    """Of each query (rows of ``scores``) the k-th best among known rows of different ids, its own apart; -inf where there are fewer."""
    held = np.where(qids[:, None] == known_ids[None, :], -np.inf, scores)
    return np.partition(held, -k, axis=1)[:, -k] if held.shape[1] >= k else np.full(len(qids), -np.inf)


def best_pairs(vectors: DataFrame, count: int, query: Column, k: int, prepare: Callable[[np.ndarray], list[np.ndarray]], search: Callable[..., tuple[np.ndarray, np.ndarray, np.ndarray]], score: str) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` best of all candidates for each row where ``query`` holds; ``vectors`` and ``count`` as :func:`distinct` gives them.

    ``prepare(matrix)`` gives a block's index arrays, kept with it;
    ``search(query ids, queries, query arrays, ids, vectors, arrays)`` gives
    (query id, id, score) of at least those in a block that are among the ``k`` best
    of all, each (id, score) counted once. Vectors compare with those of their length. Rows that agree in
    id and score count once; a query is never its own candidate.
    """
    n_blocks, n_queries = max(1, -(-count // BLOCK)), max(1, -(-count // (50 * BLOCK)))

    def packed(table: pa.Table) -> pa.Table:
        ids = table.column("_id").combine_chunks().to_numpy(zero_copy_only=False)
        v = table.column("_v").combine_chunks()
        matrix = np.asarray(v.flatten()).reshape(len(ids), -1)
        order = np.lexsort((*matrix.T[::-1], ids))  # the same block however its rows arrive
        ids, matrix = ids[order], np.ascontiguousarray(matrix[order])
        arrays = [np.ascontiguousarray(x) for x in prepare(matrix)]
        head = {"block": [table.column("block")[0].as_py()], "n": [len(ids)], "ids": [ids.tobytes()], "matrix": [matrix.tobytes()]}
        return pa.table(head | {"arrays": [[x.tobytes() for x in arrays]], "kinds": [[x.dtype.str for x in arrays]]}, schema=pa.schema([("block", pa.int64()), ("n", pa.int64()), ("ids", pa.binary()), ("matrix", pa.binary()), ("arrays", pa.list_(pa.binary())), ("kinds", pa.list_(pa.string()))]))

    shape = "block bigint, n bigint, ids binary, matrix binary, arrays array<binary>, kinds array<string>"
    dealt = vectors.withColumn("_dim", F.size("_v"))
    blocks, _ = written(dealt.withColumn("block", F.expr(f"pmod(xxhash64(_id, _v), {n_blocks})")).groupBy("_dim", "block").applyInArrow(packed, shape))
    asked = dealt.where(query).withColumn("block", F.expr(f"pmod(xxhash64(1, _id, _v), {n_queries})")).groupBy("_dim", "block").applyInArrow(packed, shape)
    asked = asked.select(*[F.col(c).alias(f"q_{c}") for c in ("n", "ids", "matrix", "arrays", "kinds")], F.explode(F.expr(f"sequence(0L, {n_blocks - 1}L)")).alias("block"))

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}

                def part(p: str, row: dict = row) -> tuple:
                    n = row[f"{p}n"]
                    arrays = [np.frombuffer(x, np.dtype(kind)) for x, kind in zip(row[f"{p}arrays"], row[f"{p}kinds"], strict=True)]
                    return np.frombuffer(row[f"{p}ids"], np.int64), np.frombuffer(row[f"{p}matrix"]).reshape(n, -1), [x.reshape(n, -1) for x in arrays]

                queries, candidates = part("q_"), part("")
                if queries[1].shape[1] != candidates[1].shape[1]:
                    continue
                q, c, s = search(*queries, *candidates)
                yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(c, pa.int64()), pa.array(s)], names=["query_id", "vec_id", "score"])

    # Spark takes the queries for as small as they are before they are repeated for every block, and might broadcast them.
    found = asked.hint("merge").join(blocks, "block").mapInArrow(met, f"query_id bigint, vec_id bigint, score {score}").distinct()
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
