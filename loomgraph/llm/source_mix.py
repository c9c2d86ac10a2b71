"""Mixing sources to target weights by Sainte-Laguë apportionment, in DataFrame functions only.

The mix is counted in blocks of equal size. Blocks go to sources by the highest
quotients target/(2k + 1), and a source's blocks to its shards by the highest
quotients size/(2k + 1): integer quotas per shard. A shard lines its documents up
in a seeded order and takes its first blocks; past its end it starts again, so
nothing is taken more than twice while targets stay within twice the size. Shards
get no more whole blocks than they have words for. What a source's blocks lack of its
target in whole words is handed out as parts of blocks, what they exceed it by is
taken off last blocks, so a source meets its target but for the part of a word.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.plans.shared import written

WORD = r"[^\x20\x09-\x0D]+"
#: Documents a shard holds about, and shards a source has at most; they set task sizes, not the mix.
SHARD_DOCS = 512
MOST_SHARDS = 65_536


def sainte_lague(df: DataFrame, votes: str, seats: str, by: list[str], tie: list[str], quota: str, bound: str | None = None) -> DataFrame:
    """Adds ``quota``: the ``seats`` (equal within ``by``) given to rows by the highest quotients votes/(2k + 1), ties by ``tie``, none above its ``bound``.

    Rounded shares come out of the same quotients for a number of seats close by;
    only the quotients around them are ranked to add or take away the difference.
    """
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    rows = df.withColumn("_all", F.sum(votes).over(group)).withColumn("_share", F.expr(f"CASE WHEN _all > 0 THEN {votes} * {seats} / _all ELSE 0D END"))
    rows = rows.withColumn("_a", F.expr(f"least(cast(floor(_share + 0.5) AS bigint), {bound or 'bigint(9223372036854775807)'})")).withColumn("_off", F.abs(F.col(seats) - F.sum("_a").over(group)))
    rows = rows.withColumn("_open", F.sum(votes).over(group) if bound is None else F.coalesce(F.sum(F.when(F.col("_a") < F.col(bound), F.col(votes))).over(group), F.lit(0)))
    rows = rows.withColumn("_m", F.expr(f"CASE WHEN _open > 0 THEN cast(ceil(_off * {votes} / _open) AS bigint) + 2 ELSE 0L END")).withColumn("_base", F.expr("greatest(0L, _a - _m)"))
    rows = rows.withColumn("_need", F.col(seats) - F.sum("_base").over(group))
    last = F.col("_a") + F.col("_m") if bound is None else F.least(F.col("_a") + F.col("_m"), F.greatest(F.col(bound) - 1, F.col("_base")))
    tried = rows.select(*by, *tie, votes, *([bound] if bound else []), "_need", F.explode(F.sequence("_base", last)).alias("_k")).where(f"_k < {bound}" if bound else "true").withColumn("_q", F.expr(f"{votes} / (2 * _k + 1)"))
    order = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy(F.desc("_q"), *[F.asc_nulls_last(t) for t in tie], "_k")
    won = tried.withColumn("_n", F.row_number().over(order)).where(f"_n <= _need AND {votes} > 0").groupBy(*by, *tie).agg(F.count("*").alias("_won"))
    keys = [*by, *tie]
    won = won.select(*[F.col(k).alias(f"_k_{k}") for k in keys], "_won")
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return rows.join(won, on, "left").withColumn(quota, F.col("_base") + F.coalesce("_won", F.lit(0))).select(*df.columns, quota)


def source_targets(sources: DataFrame, weights: tuple[int, ...], ratio: float, most: float) -> DataFrame:
    """Adds ``target`` to ``(source, source_size)``: shares of ``ratio`` times all sizes by weight, none above ``most`` times its source's size. One row a source."""
    one = Window.partitionBy(F.lit(0))
    rows = sources.withColumn("_n", F.row_number().over(one.orderBy(F.asc_nulls_last("source"))) - 1)
    rows = rows.withColumn("_w", F.element_at(F.array(*map(F.lit, weights)), (F.col("_n") % len(weights) + 1).cast("int")).cast("double"))
    rows = rows.withColumn("_cap", F.col("source_size") * F.lit(float(most))).withColumn("_total", F.sum("source_size").over(one) * F.lit(float(ratio)))
    before = one.orderBy(F.expr("_cap / _w"), "_n").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_caps", F.coalesce(F.sum("_cap").over(before), F.lit(0.0))).withColumn("_left", F.sum("_w").over(one) - F.coalesce(F.sum("_w").over(before), F.lit(0.0)))
    rows = rows.withColumn("_full", F.expr("(_total - _caps) * _w >= _cap * _left"))
    rest = F.col("_total") - F.sum(F.when(F.col("_full"), F.col("_cap")).otherwise(0.0)).over(one)
    shared = F.sum(F.when(F.col("_full"), 0.0).otherwise(F.col("_w"))).over(one)
    return rows.withColumn("target", F.when(F.col("_full"), F.col("_cap")).otherwise(rest * F.col("_w") / shared)).select(*sources.columns, "target")


def source_mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (5, 2, 1), ratio: float = 1.5, most: float = 2.0, block_words: int = 32, seed: int = 42, key_col: str | None = None) -> DataFrame:
    """``(id, size, source_size, target, taken)`` of every row; with ``key_col`` that column too, which breaks the ties left in the order.

    Null and empty texts have size 0 and take part with 0. A null source is a
    source of its own, last in order. Rows that repeat count each. The seeded order
    is that of a hash of id and text, so null or repeated ids don't gather in a
    shard; rows equal in both are alike, and their size breaks the tie. Texts of any
    length are counted whole, in the scan. Other columns are left out, whatever their names.
    """
    size = F.coalesce(F.regexp_count(F.col(f"`{text_col}`"), F.lit(WORD)), F.lit(0)).cast("bigint")
    mark = F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")), F.xxhash64(f"`{text_col}`").cast("string")))
    base, _ = written(docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{source_col}`").alias("source"), size.alias("size"), mark.alias("_mark"), *([F.col(f"`{key_col}`").alias("_key")] if key_col else [])))
    dealt = base.groupBy("source").agg(F.expr(f"least({MOST_SHARDS}L, greatest(1L, count(*) div {SHARD_DOCS}))").alias("_shards")).withColumnRenamed("source", "_source")
    base = base.join(dealt, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    base = base.withColumn("_shard", F.expr("cast(conv(substring(_mark, 1, 8), 16, 10) AS bigint) % _shards")).drop("_shards")
    shards = base.groupBy("source", "_shard").agg(F.sum("size").alias("_shard_size"))
    sources = source_targets(shards.groupBy("source").agg(F.sum("_shard_size").alias("source_size")), weights, ratio, most)
    sources = sainte_lague(sources.withColumn("_seats", F.round(F.sum("target").over(Window.partitionBy(F.lit(0))) / block_words).cast("bigint")), "target", "_seats", [], ["source"], "_blocks")
    named = sources.select(F.col("source").alias("_source"), "source_size", "target", "_blocks")
    held = shards.join(named, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    held = held.withColumn("_bound", F.expr(f"2 * _shard_size div {block_words}"))
    given = sainte_lague(held, "_shard_size", "_blocks", ["source"], ["_shard"], "_quota", "_bound").withColumn("_free", F.expr(f"2 * _shard_size - _quota * {block_words}"))
    own = Window.partitionBy("source")
    given = given.withColumn("_given", F.col("_quota") * block_words).withColumn("_lack", F.round("target").cast("bigint") - F.sum("_given").over(own))
    line = own.orderBy("_shard").rowsBetween(Window.unboundedPreceding, 0)
    given = given.withColumns({"_before": F.sum("_free").over(line) - F.col("_free"), "_earlier": F.sum("_given").over(line) - F.col("_given")})
    take = F.expr("_given + least(greatest(_lack - _before, 0L), _free) - least(greatest(-_lack - _earlier, 0L), _given)")
    quotas = given.select(F.col("source").alias("_source"), F.col("_shard").alias("_s"), "source_size", "target", "_shard_size", take.alias("_take"))
    line = Window.partitionBy("source", "_shard").orderBy("_mark", "_id", "size", *(["_key"] if key_col else [])).rowsBetween(Window.unboundedPreceding, 0)
    placed = base.withColumn("_start", F.sum("size").over(line) - F.col("size"))
    placed = placed.join(quotas, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_shard") == F.col("_s")))
    part = "least(greatest({r} - _start, 0L), size)"
    taken = F.expr(f"{part.format(r='_take')} + {part.format(r='(_take - _shard_size)')}")
    return placed.select(*([F.col("_key").alias(key_col)] if key_col else []), F.col("_id").alias(id_col), "size", "source_size", F.col("target").cast("double").alias("target"), taken.alias("taken"))
