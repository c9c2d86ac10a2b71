"""Exact top-k inner products by pivot-table elimination.

Each candidate has a table row: its distances to many pivots. For a query the
largest gap |d(query, pivot) - d(candidate, pivot)| is a lower bound of their
distance, and so, the norms known, an upper bound of their inner product.
Candidates are evaluated in the order of this bound, the first few and then all up
to where it falls below the k-th best score, which ends the search exactly.

The search runs block by block. A query's k-th best score among the sampled vectors,
which are rows of the table, bounds its k-th best of all from below, so that each
block starts from it and not from nothing.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.vector_blocks import best_pairs, distinct, floors, once, sample, usable

#: Vectors the pivots and first bounds come from (a bounded sample; results don't depend on it), and candidates evaluated first.
PIVOT_SAMPLE, STEP = 512, 64


def pivots(vectors: np.ndarray, n: int) -> np.ndarray:
    """``n`` vectors of the sample, each the farthest from those before it."""
    if not len(vectors):
        return vectors
    chosen, far = [0], np.linalg.norm(vectors - vectors[0], axis=1)
    while len(chosen) < min(n, len(vectors)):
        chosen.append(int(far.argmax()))
        far = np.minimum(far, np.linalg.norm(vectors - vectors[chosen[-1]], axis=1))
    return vectors[chosen]


def exact_search(vectors: DataFrame, query: Column, *, k: int = 5, scale: float = 256.0, n_pivots: int = 32, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` highest inner products of floor(scale * x), ties to the smaller id.

    Vectors that are null or empty, or hold null or non-finite components, and rows
    with a null id take no part; other columns are left out. Rows that agree in id and
    score count once. Components are whole numbers after scaling; products beyond 64 bits are held at its ends.
    """
    whole = usable(vectors, id_col, vec_col).withColumn("_v", F.expr(f"transform(_v, x -> cast(floor({float(scale)!r}D * x) AS double))"))
    whole, count = distinct(whole)
    known_ids, known = sample(whole, count, PIVOT_SAMPLE)
    own = pivots(known, n_pivots)

    def prepare(m: np.ndarray) -> list[np.ndarray]:
        table = np.zeros((len(m), 1)) if m.shape[1] != own.shape[1] else np.stack([np.linalg.norm(m - p, axis=1) for p in own], 1)
        return [(m * m).sum(1), table]

    def products(rows: np.ndarray, q: np.ndarray, small: bool) -> np.ndarray:
        """Inner products of whole numbers, exactly: in doubles where no sum leaves their whole numbers, else in integers of any size."""
        if small:
            return (rows @ q).astype(np.int64)
        full = [sum(int(x) * int(y) for x, y in zip(row, q)) for row in rows]
        return np.array([min(max(x, -(2**63)), 2**63 - 1) for x in full], np.int64)

    def search(qids, queries, q_arrays, ids, matrix, arrays):
        norms, table = arrays[0].ravel(), np.ascontiguousarray(arrays[1].T)
        single = len(np.unique(ids)) == len(ids)

        def best(found: np.ndarray, scores: np.ndarray) -> np.ndarray:
            return scores if single else scores[once(found, scores)]

        with np.errstate(all="ignore"):
            top = np.abs(queries).max() * matrix.shape[1]
            small = bool(top * max(np.abs(matrix).max(), np.abs(known).max(initial=0)) < 2.0**53)
            start = np.full(len(qids), -np.inf)
            if small and known.shape[1:] == matrix.shape[1:]:
                start = floors(queries @ known.T, qids, known_ids, k)
        out = ([], [], [])
        for i, qid in enumerate(qids.tolist()):
            q, kth = queries[i], start[i]
            with np.errstate(all="ignore"):
                gap = np.abs(table - q_arrays[1][i][:, None]).max(0)
                bound = (norms + q_arrays[0][i, 0] - gap * gap) / 2
                bound += 1e-9 * (norms + q_arrays[0][i, 0]) + 1e-6  # what rounding may have taken
            bound[np.isnan(bound)] = np.inf  # out of the doubles' range: no bound
            bound[ids == qid] = -np.inf
            left = np.flatnonzero((bound >= kth) & (bound > -np.inf))
            if len(left) > 2 * STEP:
                split = np.argpartition(-bound[left], STEP)
                first, left = left[split[:STEP]], left[split[STEP:]]
                scores = products(matrix[first], q, small)
                held = best(ids[first], scores)
                if len(held) >= k:
                    kth = max(kth, np.partition(held, -k)[-k])
                left = left[bound[left] >= kth]
                found, scores = np.concatenate([first, left]), np.concatenate([scores, products(matrix[left], q, small)])
            else:
                found, scores = left, products(matrix[left], q, small)
            keep = scores >= kth
            found, scores = ids[found[keep]], scores[keep]
            if not single:
                own_rows = once(found, scores)
                found, scores = found[own_rows], scores[own_rows]
            top = np.lexsort((found, -scores))[:k] if len(scores) > 1 else np.arange(len(scores))
            out[0].extend([qid] * len(top))
            out[1].extend(found[top].tolist())
            out[2].extend(scores[top].tolist())
        return out

    return best_pairs(whole, count, query, k, prepare, search, "bigint")
