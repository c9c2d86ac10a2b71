"""Pairs of texts by the exact Jaccard similarity of word shingles, found without loss by prefix filters.

Sets of similarity t share members among their first p = n - ceil(t n) + 1 in any
common order: of o members in common, all up to the prefix that ends first are in
both prefixes, so o - max(n - p of either) at least. Members that are common in a
sample of texts come last, the others in the order of their hashes; the sample
moves work only, any order gives the same pairs.

Where a member is in the prefixes of many sets, these sets are ordered again by how
rare their members are among them. What is crowded even then is mostly one large
group of near copies: its sets are compared with one of them first, and then those
that are still in different components with each other. Sets that are known to be
in one component aren't compared at all: before pairs are made, each member's first set is compared
with its others, and what that links counts as one. Every pair found is checked exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from loomgraph.llm.thinning import thinned
from loomgraph.plans.components import connected_labels
from loomgraph.plans.shared import forget, release, written

#: Sets that share a key and are all paired at once; the limit sets the order of the work, not what is found.
GROUP = 64
#: Texts that common shingles are told from, their bytes at most, and how many shingles are kept; all move work only.
SAMPLE_DOCS, SAMPLE_BYTES, COMMON = 1 << 13, 1 << 15, 1 << 17


def hashed(text: str | None, shingle: int, seed: int) -> np.ndarray:
    """The hashes of a text's lower-case shingles in order; a shorter text is one shingle, a text without words none."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    grams = map(b" ".join, zip(*[words[i:] for i in range(shingle)])) if len(words) >= shingle else [b" ".join(words)]
    return np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(seed)), np.uint64)


def majority(marks: np.ndarray) -> int:
    """The bits set in over half of the hashes, as a signed number."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(marks), 1 << 16):
        ones += np.unpackbits(marks[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(marks), bitorder="little").view(np.int64)[0])


def _signature(s: np.ndarray, seed: int) -> int | None:
    import xxhash

    return int(np.uint64(xxhash.xxh64_intdigest(s.tobytes(), seed)).view(np.int64)) if len(s) else None


def _lists(parts: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate([np.zeros(0, np.uint64), *parts]).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parts)]), pa.int32()), pa.array(flat))


def spark_slots(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def common_shingles(docs: DataFrame, *, text_col: str, shingle: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, sorted, of what several of ``SAMPLE_DOCS`` texts (not long ones, by the order of their hash) hold, ``COMMON`` of them at most, and how many texts do."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in b.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(hashed(t.as_py(), shingle, seed)).view(np.int64))], names=["key"])

    some = docs.select(F.col(f"`{text_col}`").alias("_t")).where(F.octet_length("_t") <= SAMPLE_BYTES).orderBy(F.xxhash64("_t")).limit(SAMPLE_DOCS)
    some = some.repartition(spark_slots(docs.sparkSession))  # a limit's rows stand in one partition
    found = some.mapInArrow(mark, "key bigint").groupBy("key").agg(F.count("*").alias("n")).where("n > 1").orderBy(F.desc("n"), "key").limit(COMMON).toArrow()
    keys, n = (found.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in ("key", "n"))
    order = np.argsort(keys.view(np.uint64))
    return keys.view(np.uint64)[order], n[order]


def shingle_marks(docs: DataFrame, *, id_col: str, text_col: str, shingle: int, least: Fraction, seed: int) -> DataFrame:
    """``(_id, sig, fp, n, pre)`` of every row: what names its set of shingles (null without words), its fingerprint, the set's size and prefix."""
    p, q = least.numerator, least.denominator
    common, times = common_shingles(docs, text_col=text_col, shingle=shingle, seed=seed)

    def prefix(s: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(common, s), max(len(common) - 1, 0))
        known = common[at] == s if len(common) else np.zeros(len(s), bool)
        last = s[known][np.argsort(times[at[known]], kind="stable")] if len(common) else s[:0]
        return np.concatenate([s[~known], last])[: len(s) + p * len(s) // -q + 1]

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at in range(0, big.num_rows, 512):
                b = big.slice(at, 512)
                marks = [hashed(t.as_py(), shingle, seed) for t in b.column(1)]
                sets = list(map(np.unique, marks))
                pre = [prefix(s) if len(s) else s for s in sets]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([_signature(s, seed) for s in sets], pa.int64()), pa.array(map(majority, marks), pa.int64()), pa.array([len(s) for s in sets], pa.int64()), _lists(pre)], names=["_id", "sig", "fp", "n", "pre"])

    own = StructType([StructField("_id", docs.schema[id_col].dataType), *StructType.fromDDL("sig bigint, fp bigint, n bigint, pre array<bigint>").fields])
    return docs.select(f"`{id_col}`", f"`{text_col}`").mapInArrow(mark, own)


def same_or_near(docs: DataFrame, marked: DataFrame, own: DataFrame, first: DataFrame, *, id_col: str, text_col: str, shingle: int, least: Fraction, seed: int, group: int = GROUP) -> DataFrame:
    """``(vertex, label)``: components of the sets ``own`` (sig, least, n; least is the id of a row that has it) of similarity ``least`` or more.

    ``marked`` are the rows that :func:`shingle_marks` gives. ``first`` has pairs (a, b) that are likely to be linked; they are checked
    before all else, so that what they connect needn't be compared again.
    """
    p, q = least.numerator, least.denominator

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                sets = [np.unique(hashed(t.as_py(), shingle, seed)) for t in b.column(0).slice(at, 512)]
                yield pa.RecordBatch.from_arrays([pa.array([_signature(s, seed) for s in sets], pa.int64()), _lists(sets)], names=["sig", "hashes"])

    def enough(met: DataFrame, crowded: DataFrame | None = None) -> DataFrame:
        """``(a, b)`` of the pairs met (a, b, na, nb), a row for each key of both prefixes, that share as many as the similarity asks for; ``crowded`` (sig, more) says how many further ones a set has."""
        met = met.groupBy("a", "b", "na", "nb").agg(F.count("*").alias("shared"), F.lit(0).alias("ma"), F.lit(0).alias("mb"))
        if crowded is not None:
            for x in "ab":
                met = met.drop(f"m{x}").join(crowded.selectExpr(f"sig AS {x}", f"more AS m{x}"), x, "left")
        # n - p is ceil(t n) - 1, and the members in common are ceil(t / (1 + t) (na + nb)) at least
        rest = f"(greatest(na, nb) * {p} + {q - 1}) div {q} - 1"
        return met.where(f"shared + least(coalesce(ma, 0), coalesce(mb, 0)) >= ((na + nb) * {p} + {p + q - 1}) div {p + q} - ({rest})").select("a", "b")

    common = f"((x.n + y.n) * {p} + {p + q - 1}) div {p + q}"

    def paired(keys: DataFrame, more: str = "true") -> DataFrame:
        """Pairs of different components that share a key (sig, n, key, c), a row for each key."""
        on = F.expr(f"x.key = y.key AND x.sig < y.sig AND x.c != y.c AND x.n * {p} <= y.n * {q} AND y.n * {p} <= x.n * {q} AND {more}")
        return keys.alias("x").join(keys.alias("y"), on).selectExpr("x.sig AS a", "y.sig AS b", "x.n AS na", "y.n AS nb")

    def starred(keys: DataFrame) -> DataFrame:
        """The same of each key's first set with its others only."""
        fits = f"head.n * {p} <= n * {q} AND n * {p} <= head.n * {q}"
        return keys.where(f"head.sig != sig AND {fits}").selectExpr("head.sig AS a", "sig AS b", "head.n AS na", "n AS nb")

    def sets_of(wanted: DataFrame) -> tuple[DataFrame, str]:
        """``(sig, hashes)`` of the sets named, from the texts of a row each."""
        wanted, _ = written(own.select("sig", F.xxhash64("least").alias("at")).join(wanted, "sig", "left_semi"))
        rows = thinned(docs.select(F.xxhash64(f"`{id_col}`").alias("_at_id"), F.col(f"`{text_col}`").alias("_t")), "_at_id", wanted.select("at"), wanted.count())
        found = rows.select("_t").mapInArrow(whole, "sig bigint, hashes array<bigint>").join(wanted, "sig", "left_semi")
        return written(found.groupBy("sig").agg(F.first("hashes").alias("hashes")))

    def ends(pairs: DataFrame) -> DataFrame:
        return pairs.selectExpr("explode(array(a, b)) AS sig").distinct()

    def checked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
        a, b = (sets.select(F.col("sig").alias(x), F.col("hashes").alias(f"_{x}")) for x in "ab")
        return written(pairs.join(a, "a").join(b, "b").where(f"size(array_intersect(_a, _b)) * {p + q} >= {p} * (size(_a) + size(_b))").select("a", "b"))[0]

    def apart(keys: DataFrame) -> DataFrame:
        """Keys (sig, n, key, c) that sets of different components share, with ``df``, the number of their sets, and the first of these, ``head``."""
        by_key = Window.partitionBy("key")
        both = keys.select("sig", "n", "key", "c", *[x for x in keys.columns if x == "_i"]).withColumns({"df": F.count("*").over(by_key), "head": F.min(F.struct("sig", "n")).over(by_key), "_low": F.min("c").over(by_key), "_high": F.max("c").over(by_key)})
        return both.where("_low != _high").drop("_low", "_high")

    def labelled(sets: DataFrame, labels: DataFrame) -> DataFrame:
        """Rows of sets with ``c``, their component."""
        return sets.join(labels, F.col("sig") == F.col("vertex"), "left").withColumn("c", F.coalesce("label", "sig")).drop("vertex", "label")

    spark, held = docs.sparkSession, []
    prefixes = marked.groupBy("sig").agg(F.first("n").alias("n"), F.first("pre").alias("pre")).where("sig IS NOT NULL")
    met, path = written(apart(prefixes.selectExpr("sig", "n", "sig AS c", "explode(pre) AS key")))
    release(spark)
    first, _ = written(first.unionByName(enough(starred(met))).distinct())
    likely, likely_path = sets_of(ends(first))
    links = checked(first, likely)
    forget(spark, likely_path)
    labels, _ = written(connected_labels(links, "a", "b"))
    shared, shared_path = written(apart(labelled(met.drop("c"), labels)))
    held += [path, shared_path]
    release(spark)
    crowd, _ = written(shared.where(f"df > {group}").groupBy("sig").agg(F.count("*").alias("more")))
    pairs, _ = written(enough(paired(shared.where(f"df <= {group}")), crowd))
    sets, path = sets_of(ends(pairs).unionByName(crowd.select("sig")).distinct())
    held.append(path)
    release(spark)
    big = None
    if not crowd.isEmpty():
        known = labelled(own.select("sig", "n").join(crowd, "sig", "left_semi"), labels)
        again = sets.join(known, "sig").select("sig", "n", "c", F.explode("hashes").alias("key")).withColumn("df", F.count("*").over(Window.partitionBy("key")))
        own_keys = Window.partitionBy("sig")  # the members that no other set has come first, and needn't be ranked
        again = again.where("df > 1").withColumn("_i", F.col("n") - F.count("*").over(own_keys) + F.row_number().over(own_keys.orderBy("df", "key"))).where(f"_i <= n - (n * {p} + {q - 1}) div {q} + 1")
        again, path = written(apart(again))
        held.append(path)
        release(spark)
        big = again.where(f"df > {group}")
        small = enough(paired(again.where(f"df <= {group}")), big.groupBy("sig").agg(F.count("*").alias("more")))
        pairs = pairs.unionByName(small).unionByName(starred(big).select("a", "b")).distinct()
    links = links.unionByName(checked(pairs, sets))
    labels = connected_labels(links, "a", "b")
    if big is not None and not big.isEmpty():
        labels, _ = written(labels)
        cross, path = written(apart(labelled(big.drop("c"), labels)))
        held.append(path)
        # What meets here shares no other keys. At the first that two sets share, only what comes after it in both can be in common too.
        near = paired(cross, f"{common} <= 1 + least(x.n - x._i, y.n - y._i)").select("a", "b").distinct()
        labels = connected_labels(links.unionByName(checked(near, sets)), "a", "b")
    labels, _ = written(labels)
    for path in held:
        forget(spark, path)
    return labels
