"""Line dedup through a deletion-neighbourhood join, in DataFrame functions only.

A line goes when an earlier line (by document id, then position) equals it or
lies within one character edit of it. Both tests apply to the line without the
white space around it; the edit test needs ``min_fuzzy_chars`` characters.

One edit leaves the first or the last half of the shorter line as it is, so only
lines that share such a half (by hash) can have a partner. They are narrowed to
blocks of ``block_chars`` around the edit, and there every deletion variant is
emitted as a hashed key. A key holds the place of the deletion: two lines that
share one differ by one edit at most, so each group needs its earliest member
alone, never its pairs. What is found is verified by edit distance.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.thinning import thinned
from loomgraph.plans.shared import written

WHITE = "' \\t\\r\\u000b\\u000c'"


def _half(n: str) -> str:
    """Characters in the shared half of lines of ``n``: n/2 cut to its four leading bits, so that neighbouring lengths mostly agree."""
    half = f"shiftright({n}, 1)"
    drop = f"greatest(length(bin({half})) - 4, 0)"
    return f"shiftleft(shiftright({half}, {drop}), {drop})"


def find_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_fuzzy_chars: int = 20, block_chars: int = 256) -> DataFrame:
    """The lines to take out: ``(_id, _h, drops)``, drops being positions from 0.

    ``_h`` hashes the whole text, so that rows that share an id don't mix; rows
    that agree in both stand at the same place and keep the same lines. Lines
    compare by a 128-bit hash for equality. A null id sorts first. Null text has
    no lines; blank lines are never taken out.
    """
    base = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text")).where("_text IS NOT NULL")
    base = base.withColumn("_h", F.xxhash64("_text"))
    lines = base.select("_id", "_h", F.posexplode(F.split("_text", "\n")).alias("pos", "line")).selectExpr("_id", "_h", "pos", f"btrim(line, {WHITE}) AS s").where("s != ''")
    hashes = ["xxhash64(s) AS h1", "xxhash64(7, s) AS h2"]
    p1, p0 = _half("n"), _half("n - 1")
    keyed = lines.selectExpr("_id", "_h", "pos", "s", "length(s) AS n", *hashes).selectExpr("*", f"{p1} AS p1", f"{p0} AS p0")
    fuzzy = f"n >= {min_fuzzy_chars}"
    keyed = keyed.selectExpr(
        "h1", "h2", "struct(_id, _h, pos) AS at",
        f"CASE WHEN {fuzzy} THEN xxhash64('P', p1, left(s, p1)) END AS k1", f"CASE WHEN {fuzzy} THEN xxhash64('S', p1, right(s, p1)) END AS k2",
        f"CASE WHEN {fuzzy} AND p0 != p1 THEN xxhash64('P', p0, left(s, p0)) END AS k3", f"CASE WHEN {fuzzy} AND p0 != p1 THEN xxhash64('S', p0, right(s, p0)) END AS k4",
    )
    # One row per distinct line: its first place, how often it occurs, its half keys.
    distinct, distinct_path = written(keyed.groupBy("h1", "h2").agg(F.min("at").alias("first"), F.count("*").alias("copies"), *[F.max(k).alias(k) for k in ("k1", "k2", "k3", "k4")]))
    halves = distinct.selectExpr("h1", "h2", "stack(4, k1, k2, k3, k4) AS half").where("half IS NOT NULL").repartition("half")
    shared = halves.groupBy("half").agg(F.count("*").alias("c")).where("c > 1").select("half")
    matched = halves.join(shared, "half").groupBy("h1", "h2").agg(F.collect_set("half").alias("halves"))  # four at most
    # Texts of the candidates, by the document that holds their first copy.
    wanted, wanted_path = written(distinct.select("h1", "h2", "first").join(matched, ["h1", "h2"]))
    spots = wanted.selectExpr("first._id AS _id", "first._h AS _h", "first.pos AS pos", "h1", "h2", "first", "halves")
    spots = spots.groupBy("_id", "_h").agg(F.collect_list(F.struct("pos", "h1", "h2", "first", "halves")).alias("spots")).alias("w")
    # Rows that agree in id and text would each bring the line.
    holders = thinned(base, "_h", wanted.selectExpr("first._h AS _h"), wanted.count()).dropDuplicates(["_id", "_h"]).alias("b")
    held = holders.join(spots, F.expr("b._id <=> w._id AND b._h = w._h")).selectExpr("split(_text, '\\n') AS ls", "explode(spots) AS w")
    texts, texts_path = written(held.selectExpr("w.h1", "w.h2", "w.first", "w.halves", f"btrim(ls[w.pos], {WHITE}) AS s"))
    variants = _variants(texts, block_chars)
    least = variants.groupBy("key").agg(F.min("first").alias("earliest"), F.count("*").alias("c")).where("c > 1")
    links = variants.join(least, "key").where("first > earliest").selectExpr("h1", "h2", "earliest").distinct()
    own = texts.select("h1", "h2", "s")
    other = texts.selectExpr("first AS earliest", "s AS t")
    near = links.join(own, ["h1", "h2"]).join(other, "earliest").where("levenshtein(s, t, 1) BETWEEN 0 AND 1").select("h1", "h2").distinct().withColumn("near", F.lit(True))
    # Written, so that the join below stands between two exchanges, where adaptive execution splits the places of a common line.
    classes, _ = written(distinct.select("h1", "h2", "first", "copies").join(near, ["h1", "h2"], "left").where("copies > 1 OR near"))
    gone = lines.selectExpr("_id", "_h", "pos", *hashes).join(classes, ["h1", "h2"]).where("near OR struct(_id, _h, pos) != first")
    return gone.groupBy("_id", "_h").agg(F.collect_set("pos").alias("drops"))


def _variants(texts: DataFrame, block_chars: int) -> DataFrame:
    """Deletion variants as hashed keys: ``(key, h1, h2, first)``.

    ``n`` is the shorter length of a possible pair. A line takes part as the
    shorter or equal one (n is its length) and as the longer one (n is one less).
    """
    parts = texts.selectExpr("h1", "h2", "first", "s", "length(s) AS size", "halves", "explode(array(length(s), length(s) - 1)) AS n").selectExpr("*", f"{_half('n')} AS p")
    parts = parts.selectExpr("h1", "h2", "first", "n", "size = n AS short", "n - p AS m", "size - p AS olen", "halves", "stack(2, xxhash64('P', p, left(s, p)), substring(s, p + 1), xxhash64('S', p, right(s, p)), left(s, size - p)) AS (half, other)")
    parts = parts.where("array_contains(halves, half)").selectExpr("*", f"greatest(1, cast(ceil(m / {block_chars}) AS int)) AS blocks").drop("halves")
    blocks = parts.selectExpr("*", "explode(sequence(0, blocks - 1)) AS b").selectExpr("*", "cast(b * m div blocks AS int) AS lo", "cast((b + 1) * m div blocks AS int) AS hi")
    blocks = blocks.selectExpr("h1", "h2", "first", "short", "xxhash64(half, n, b, left(other, lo), right(other, m - hi)) AS block", "substring(other, lo + 1, olen - lo - (m - hi)) AS mid").repartition("block")
    shared = blocks.groupBy("block").agg(F.count("*").alias("c"), F.count_if("short").alias("shorts")).where("c > 1 AND shorts > 0").select("block")
    cut = "xxhash64(block, {tag}, i, left(mid, i), substring(mid, i + 2))"
    dels = "transform(sequence(0, length(mid) - 1), i -> " + cut + ")"
    swaps = f"CASE WHEN short AND mid != '' THEN {dels.format(tag=0)} ELSE array() END"
    gaps = f"CASE WHEN short THEN transform(sequence(0, length(mid)), i -> xxhash64(block, 1, i, left(mid, i), substring(mid, i + 1))) WHEN mid != '' THEN {dels.format(tag=1)} ELSE array() END"
    return blocks.join(shared, "block").selectExpr("h1", "h2", "first", f"explode(array_distinct(concat({swaps}, {gaps}))) AS key").repartition("key")


def line_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_fuzzy_chars: int = 20, block_chars: int = 256) -> DataFrame:
    """``docs`` with repeated lines taken out of the text, plus ``n_lines`` and ``n_dropped``.

    Every row stays, with all its columns (one named like an added column is
    replaced). Null text stays null with 0 lines; empty text has one blank line.
    Equal lines tie by document id, text hash and position, so the earliest stays.
    """
    gone = find_repeats(docs, id_col=id_col, text_col=text_col, min_fuzzy_chars=min_fuzzy_chars, block_chars=block_chars)
    own = docs.drop("n_lines", "n_dropped")
    names = own.columns
    left = own.withColumn("_ld_h", F.xxhash64(f"`{text_col}`")).alias("d")
    # A byte for each line up to the last that goes, 1 where it goes: looked up at once, where a list would be searched for each line.
    gone = gone.selectExpr("_id AS _ld_id", "_h AS _ld_g", "size(drops) AS _ld_n", "array_sort(drops) AS _s")
    mask = "cast(array_join(zip_with(_s, concat(array(-1), slice(_s, 1, size(_s) - 1)), (x, before) -> concat(repeat('0', x - before - 1), '1')), '') AS binary)"
    right = gone.selectExpr("_ld_id", "_ld_g", "_ld_n", f"{mask} AS _ld_mask")
    out = left.join(right, F.col(f"d.`{id_col}`").eqNullSafe(F.col("_ld_id")) & (F.col("_ld_h") == F.col("_ld_g")), "left")
    parts = f"split(d.`{text_col}`, '\\n')"
    kept = f"CASE WHEN _ld_mask IS NULL THEN d.`{text_col}` ELSE array_join(filter({parts}, (x, i) -> substring(_ld_mask, i + 1, 1) != X'31'), '\\n') END"
    return out.select(*[F.expr(kept).alias(c) if c == text_col else F.col(f"d.`{c}`") for c in names], F.expr(f"CASE WHEN d.`{text_col}` IS NULL THEN 0L ELSE cast(size({parts}) AS bigint) END").alias("n_lines"), F.expr("coalesce(cast(_ld_n AS bigint), 0L)").alias("n_dropped"))
