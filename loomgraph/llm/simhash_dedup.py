"""SimHash near-duplicates found by Golay-code fuzzy hashing.

A fingerprint's 64 bits fall into segments a, b and c of 23, 23 and 18. The perfect
Golay code has one codeword within three bits of any 23-bit word. Two sets of
codewords stand for a segment: the near ones (of itself and of all words one bit
away, six at most), of which segments that differ in up to two bits share one, and
the lower ones (its own, and of the near ones those of smaller index), of which
segments that differ in one bit share one, for it is one of the two's own.

Three differing bits fall into few cases. If c agrees, a or b differs in one bit at
most: a key of c and a lower codeword. Else a and b differ in two bits together: in
the one alone (a key of the other as it is and a near codeword), or in a bit each,
and then half of c agrees (a key of two lower codewords and that half). Each key has
30 bits or more. Fingerprints that share a key are compared, and what is linked
forms components.

For near copies of a given Jaccard similarity of shingles these links come first,
each checked exactly. Such texts may differ in more bits than keys can bridge, so
what is still in different components is then found by prefix filters
(:mod:`loomgraph.llm.shingle_dedup`), which lose no pair.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from fractions import Fraction
from functools import lru_cache
from itertools import combinations, islice, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.row_types import with_id
from loomgraph.llm.shingle_dedup import same_or_near, shingle_marks
from loomgraph.plans.components import connected_labels
from loomgraph.plans.shared import written

#: The Golay code's generator polynomial, and its word, message and check lengths.
GENERATOR, WORD_BITS, CHECK_BITS = 0b110001110101, 23, 11
SEED = 42
#: Fingerprints that share a key and are compared with each other; larger groups are linked through hubs.
GROUP = 1024
#: Texts of more characters are read word by word.
LONG_TEXT = 1 << 22


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The fingerprint of a whole text as a signed 64-bit number; 0 if it has no words."""
    import xxhash

    data = (text or "").encode("utf-8", "surrogatepass").lower()
    words: Iterator[bytes] = iter(data.split()) if len(data) <= LONG_TEXT else (m[0] for m in re.finditer(rb"[^\x20\x09-\x0D]+", data))
    ones, n, tail = np.zeros(64, np.int64), 0, []
    while part := list(islice(words, 1 << 16)):
        part = tail + part
        marks = np.fromiter(map(xxhash.xxh64_intdigest, map(b" ".join, zip(*[part[i:] for i in range(shingle)])), repeat(SEED)), np.uint64)
        ones += np.unpackbits(marks.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        n += len(marks)
        tail = part[-(shingle - 1) :] if shingle > 1 else []
    if not n and tail:
        ones, n = np.unpackbits(np.array([xxhash.xxh64_intdigest(b" ".join(tail), SEED)], np.uint64).view(np.uint8), bitorder="little").astype(np.int64), 1
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``(id, fp)`` of every row."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint(t.as_py(), shingle) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], names=[id_col, "fp"])

    return docs.select(f"`{id_col}`", f"`{text_col}`").mapInArrow(mark, with_id(docs, id_col, "fp bigint"))


@lru_cache(1)
def _golay() -> tuple[np.ndarray, np.ndarray]:
    """For each syndrome the error pattern of up to three bits; for each 23-bit word its syndrome."""
    rest = np.zeros(1 << WORD_BITS, np.int32)
    for bit in range(WORD_BITS):
        r = 1 << bit
        for high in range(bit, CHECK_BITS - 1, -1):
            if r >> high & 1:
                r ^= GENERATOR << (high - CHECK_BITS)
        rest[1 << bit : 2 << bit] = rest[: 1 << bit] ^ r
    errors = np.array([sum(1 << b for b in bits) for k in range(4) for bits in combinations(range(WORD_BITS), k)], np.int64)
    pattern = np.zeros(1 << CHECK_BITS, np.int64)
    pattern[rest[errors]] = errors
    return pattern, rest


def codewords(words: np.ndarray) -> np.ndarray:
    """Index (0 to 4095) of the codeword within three bits of each 23-bit word."""
    pattern, rest = _golay()
    return (words ^ pattern[rest[words]]) >> CHECK_BITS


def near_codewords(words: np.ndarray) -> np.ndarray:
    """Rows of up to six distinct codeword indices around each word, padded with -1."""
    flips = np.concatenate([[0], 1 << np.arange(WORD_BITS)])
    found = np.sort(codewords(words[:, None] ^ flips[None, :]), 1)
    found[:, 1:][found[:, 1:] == found[:, :-1]] = 4096
    found = np.sort(found, 1)[:, :6]
    return np.where(found == 4096, -1, found)


def fuzzy_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) for every key of every fingerprint; a key's highest bits tell its kind."""
    bits = fps.view(np.uint64)
    a, b, c = ((bits >> np.uint64(s) & np.uint64((1 << n) - 1)).astype(np.int64) for s, n in ((0, 23), (23, 23), (46, 18)))
    near_a, near_b = near_codewords(a), near_codewords(b)
    low_a, low_b = (np.where(near <= codewords(own)[:, None], near, -1) for near, own in ((near_a, a), (near_b, b)))
    both = np.where((low_a[:, :, None] < 0) | (low_b[:, None, :] < 0), -1, low_a[:, :, None] << 12 | low_b[:, None, :]).reshape(len(fps), -1)
    parts = [(c, low_a, 12), (c, low_b, 12), (a, near_b, 12), (b, near_a, 12), (c & 511, both, 24), (c >> 9, both, 24)]
    keys = np.concatenate([np.where(code < 0, -1, kind << 56 | own[:, None] << width | code) for kind, (own, code, width) in enumerate(parts)], 1)
    row, at = np.nonzero(keys >= 0)
    return row, keys[row, at]


def _forest(fps: np.ndarray, most: int) -> list[tuple[int, int]]:
    """For each fingerprint of a group that isn't its component's smallest, a pair with that one."""
    bits = fps.view(np.uint64)  # of a negative number bitwise_count would count the magnitude's bits
    near = np.bitwise_count(bits[:, None] ^ bits[None, :]) <= most
    label = np.arange(len(fps))
    while True:
        low = np.where(near, label[None, :], len(fps)).min(1)
        if (low == label).all():
            break
        label = low[low]
    return [(int(fps[i]), int(fps[j])) for i, j in enumerate(label) if i != j]


def links(fps: DataFrame, most: int = 3, group: int = GROUP) -> DataFrame:
    """``(a, b)``: pairs that connect the distinct values of ``fp`` exactly as all pairs of ``most`` (3 at most) differing bits do."""
    if not 0 <= most <= 3:
        raise ValueError("the keys hold for up to three differing bits")

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at in range(0, big.num_rows, 4096):
                own = big.column(0).slice(at, 4096).to_numpy(zero_copy_only=False)
                row, key = fuzzy_keys(own)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(own[row])], names=["key", "fp"])

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by key. A group above the limit passes as single fingerprints, without being held."""
        last, held, passing = None, np.zeros(0, np.int64), False

        def out(pairs: list[tuple[int, int | None]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in pairs], pa.int64()), pa.array([x[1] for x in pairs], pa.int64())], names=["a", "b"])

        for batch in batches:
            keys, own = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            if not len(keys):
                continue
            begin = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1])
            end = np.concatenate([begin[1:], [len(keys)]])
            made: list[tuple[int, int | None]] = []
            for i, j in zip(begin.tolist(), end.tolist(), strict=True):
                if keys[i] != last:
                    if not passing and len(held) > 1:
                        made += _forest(held, most)
                    last, held, passing = keys[i], own[i:j], False
                else:
                    held = np.concatenate([held, own[i:j]])
                if passing or len(held) > group:
                    made += [(int(x), None) for x in held]
                    held, passing = held[:0], True
            if made:
                yield out(made)
        if not passing and len(held) > 1 and (made := _forest(held, most)):
            yield out(made)

    keys = fps.select("fp").mapInArrow(keyed, "key bigint, fp bigint").repartition("key").sortWithinPartitions("key")
    found, _ = written(keys.mapInArrow(compared, "a bigint, b bigint").distinct())
    pairs, crowd = found.where("b IS NOT NULL"), found.where("b IS NULL").select(F.col("a").alias("fp"))
    return pairs if crowd.isEmpty() else pairs.unionByName(hub_links(crowd, most))


def hub_links(fps: DataFrame, most: int = 3) -> DataFrame:
    """The same for fingerprints in crowded groups: rows in proportion to them, and no group is gathered.

    Any two within three bits have a word between them, one bit at most from one
    and two at most from the other. Each word's smallest fingerprint within the
    near distance links with all around that word, which lie within three bits of it.
    """
    near = min(1, most // 2)
    far = most - near
    masks = {k: [sum(1 << b for b in bits) for n in range(k + 1) for bits in combinations(range(64), n)] for k in {near, far}}
    signed = {k: np.array(v, np.uint64).view(np.int64) for k, v in masks.items()}

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at in range(0, big.num_rows, 256):
                own = big.column(0).slice(at, 256).to_numpy(zero_copy_only=False)
                for inner, masks_of in ((True, signed[near]), (False, signed[far])):
                    words = (own[:, None] ^ masks_of[None, :]).ravel()
                    yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(np.repeat(own, len(masks_of))), pa.array(np.full(len(words), inner))], names=["word", "fp", "inner"])

    rows = fps.select("fp").mapInArrow(around, "word bigint, fp bigint, inner boolean").repartition("word")
    hubs = rows.groupBy("word").agg(F.min(F.when(F.col("inner"), F.col("fp"))).alias("hub"), F.count("*").alias("n")).where("hub IS NOT NULL AND n > 1").select("word", "hub")
    return rows.join(hubs, "word").where("fp != hub").selectExpr("fp AS a", "hub AS b").distinct()


def simhash_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, most: int = 3, group: int = GROUP, least: Fraction | None = None) -> DataFrame:
    """``(id, fingerprint, component_id)`` of every row.

    Null and empty texts have fingerprint 0 and are linked like any other. The
    component's id is the smallest in it; null ids count only where there is no
    other. Rows that repeat and copies share a row until the end, so no group of
    copies is gathered. A long text is read a part of its words at a time.

    With ``least`` links aren't of ``most`` differing bits but of that Jaccard
    similarity or more between the texts' shingles, repeats aside, all of them;
    texts without words then are copies of nothing.
    """
    if least is not None:
        return near_copies(docs, id_col=id_col, text_col=text_col, shingle=shingle, most=most, group=group, least=least)
    marked, _ = written(fingerprints(docs, id_col=id_col, text_col=text_col, shingle=shingle))
    own = marked.groupBy("fp").agg(F.min(f"`{id_col}`").alias("least"))
    labels = connected_labels(links(own, most, group), "a", "b")
    joined = own.join(labels, F.col("fp") == F.col("vertex"), "left").select("fp", "least", F.coalesce("label", "fp").alias("root"))
    joined, _ = written(joined)
    roots = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    named = joined.join(roots, "root").select(F.col("fp").alias("_fp"), F.col("component_id").alias("_component"))
    return marked.join(named, F.col("fp") == F.col("_fp")).select(f"`{id_col}`", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("_component").alias("component_id"))


def near_copies(docs: DataFrame, *, id_col: str, text_col: str, shingle: int, most: int, group: int, least: Fraction) -> DataFrame:
    """:func:`simhash_dedup` with ``least``: fingerprint links, checked, then prefix filters between what they leave apart."""
    marked, _ = written(shingle_marks(docs, id_col=id_col, text_col=text_col, shingle=shingle, least=least, seed=SEED))
    own, _ = written(marked.where("sig IS NOT NULL").groupBy("sig").agg(F.min("_id").alias("least"), F.first("fp").alias("fp"), F.first("n").alias("n")))
    # A fingerprint's smallest set stands for it: the others link with that one, linked fingerprints through theirs.
    heads, _ = written(own.groupBy("fp").agg(F.min("sig").alias("head"), F.count("*").alias("sets")))
    found = links(heads.select("fp"), most, group)
    across = found.join(heads.selectExpr("fp AS a", "head AS _a"), "a").join(heads.selectExpr("fp AS b", "head AS _b"), "b").selectExpr("_a AS a", "_b AS b")
    within = own.select("sig", "fp").join(heads.where("sets > 1"), "fp").where("sig != head").selectExpr("head AS a", "sig AS b")
    first, _ = written(across.unionByName(within))
    labels = same_or_near(docs, marked, own.select("sig", "least", "n"), first, id_col=id_col, text_col=text_col, shingle=shingle, least=least, seed=SEED)
    joined, _ = written(own.join(labels, F.col("sig") == F.col("vertex"), "left").select("sig", "least", F.coalesce("label", "sig").alias("root")))
    roots = joined.groupBy("root").agg(F.min("least").alias("_component"))
    named = joined.join(roots, "root").select(F.col("sig").alias("_sig"), "_component")
    out = marked.select("_id", "sig", "fp").join(named, F.col("sig") == F.col("_sig"), "left")
    return out.select(F.col("_id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.expr("CASE WHEN sig IS NULL THEN _id ELSE _component END").alias("component_id"))
