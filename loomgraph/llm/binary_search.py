"""Approximate nearest neighbours by randomly rotated one-bit codes.

Unit vectors are turned by one random rotation and kept as the signs of their
components, packed into words, with one scalar each: the product of the vector
with its own code. A query, rotated and cut into bit planes, meets the codes by
counting common bits; divided by the scalar that estimates the cosine, with an
error bound that holds with high probability. Vectors whose bound reaches the
k-th best exact cosine are scored exactly.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame

from loomgraph.llm.vector_blocks import best_pairs, distinct, floors, once, sample, usable

#: Bits of a query's components, standard deviations the error bound covers, and rows of which each query knows the exact cosines before it meets a block (a bounded sample that only saves work).
PLANES, SIGMAS, KNOWN = 6, 3.0, 512


def rotation(size: int, seed: int = 42) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((size, size)))
    return q * np.sign(np.diag(r))


def packed(signs: np.ndarray) -> np.ndarray:
    """Rows of booleans as rows of 64-bit words."""
    pad = -signs.shape[1] % 64
    return np.packbits(np.pad(signs, ((0, 0), (0, pad))), axis=1, bitorder="little").view(np.uint64)


def even(m: np.ndarray) -> np.ndarray:
    """Rows multiplied by a power of two each, so that the largest component is about 1: cosines stay the same to the last bit, and no square leaves the doubles' range."""
    return np.ldexp(m, -np.frexp(np.abs(m).max(1, keepdims=True))[1])


def binary_search(vectors: DataFrame, query: Column, *, k: int = 5, seed: int = 42, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` nearest found by cosine, scored exactly in doubles, ties to the smaller id.

    Every row is in the index, which is fitted on nothing. Vectors that are null,
    empty or zero, or hold null or non-finite components, and rows with a null id take
    no part; other columns are left out. Rows that agree in id and score count once.
    """
    some, count = distinct(usable(vectors, id_col, vec_col).where("exists(_v, x -> x != 0)"))
    known_ids, known = sample(some, count, KNOWN)
    known = even(known) if len(known) else known
    known_norms = np.sqrt((known * known).sum(1)) if len(known) else known

    def prepare(m: np.ndarray) -> list[np.ndarray]:
        scaled = even(m)
        turned = scaled / np.linalg.norm(scaled, axis=1, keepdims=True) @ rotation(m.shape[1], seed)
        return [packed(turned > 0), np.abs(turned).sum(1) / np.sqrt(m.shape[1])]

    def search(qids, queries, _, ids, matrix, arrays):
        size = matrix.shape[1]
        codes, scalar = arrays[0], arrays[1].ravel()
        matrix, queries = even(matrix), even(queries)
        unit = queries
        turned = unit / np.linalg.norm(unit, axis=1, keepdims=True) @ rotation(size, seed)
        low = turned.min(1, keepdims=True)
        step = np.maximum((turned.max(1, keepdims=True) - low) / (2**PLANES - 1), 1e-300)
        levels = np.rint((turned - low) / step).astype(np.int64)
        ones = np.bitwise_count(codes).sum(1, dtype=np.int64)
        error = SIGMAS * (np.sqrt(np.maximum(1 - scalar**2, 0)) / np.sqrt(max(size - 1, 1)) + step.max() / np.sqrt(12)) / scalar
        norms = np.sqrt((matrix * matrix).sum(1))
        query_norms = np.sqrt((queries * queries).sum(1))
        near = np.zeros((len(qids), 0))
        start = np.full(len(qids), -np.inf)
        if known.shape[1:] == matrix.shape[1:]:
            near = (queries @ known.T) / (known_norms[None, :] * query_norms[:, None])
            start = floors(near, qids, known_ids, k) - 1e-12
        alone = len(np.unique(ids)) == len(ids)

        def own_rows(found: np.ndarray, scores: np.ndarray) -> np.ndarray:
            return np.arange(len(found)) if alone else once(found, scores)

        out = ([], [], [])
        for i, qid in enumerate(qids.tolist()):
            planes = packed((levels[i] >> np.arange(PLANES)[:, None] & 1).astype(bool))
            common = (np.bitwise_count(codes & planes[:, None]).sum(2, dtype=np.int64) << np.arange(PLANES)[:, None]).sum(0)
            cosine = (2 * (step[i] * common + low[i] * ones) - (step[i] * levels[i].sum() + low[i] * size)) / np.sqrt(size) / scalar
            cosine[ids == qid] = -np.inf
            others = int((ids != qid).sum())
            if not others:
                continue

            q = queries[i]
            own_norm = query_norms[i]

            def exact(at: np.ndarray, q: np.ndarray = q, own_norm: float = own_norm) -> np.ndarray:
                return (matrix[at] * q).sum(1) / (norms[at] * own_norm)

            kth = start[i]
            sure = known_ids[(near[i] >= kth) & (known_ids != qid)] if kth > -np.inf else known_ids[:0]
            n = min(2 * k, others)
            while kth == -np.inf:
                tried = np.argpartition(-cosine, n - 1)[:n]
                best = exact(tried)
                best = best[own_rows(ids[tried], best)]
                if len(best) >= k or n == others:
                    kth = np.sort(best)[-min(k, len(best))]
                n = min(2 * n, others)
            chosen = np.flatnonzero((cosine + error >= kth) & (ids != qid))
            if len(chosen) > 8 * k:  # the likeliest ones first may raise the bound
                tried = chosen[np.argpartition(-cosine[chosen], 4 * k)[: 4 * k]]
                best = exact(tried)
                best = best[own_rows(ids[tried], best)]
                if len(best) >= k and (high := np.partition(best, -k)[-k]) > kth:
                    chosen = chosen[(cosine + error)[chosen] >= high]
                    chosen = np.union1d(chosen, tried)
            if len(sure):  # what the bound comes from is found at any rate, so there are k at least
                chosen = np.union1d(chosen, np.flatnonzero(np.isin(ids, sure) & (ids != qid)))
            scores = exact(chosen)
            single = own_rows(ids[chosen], scores)
            chosen, scores = chosen[single], scores[single]
            top = np.lexsort((ids[chosen], -scores))[:k]
            out[0].extend([qid] * len(top))
            out[1].extend(ids[chosen[top]].tolist())
            out[2].extend(scores[top].tolist())
        return out

    return best_pairs(some, count, query, k, prepare, search, "double")
