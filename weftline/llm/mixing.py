"""Mixing sources to target weights by Sainte-Laguë apportionment (operator 9).

Only DataFrame functions, on a narrow table (id, source, size).

1. Sources in the order of their names weigh WEIGHTS, repeating, and share
   ``budget`` times all sizes.  A target stops at ``repeats`` times its
   source's size and the excess is shared again by weight; that ends at
   min(repeats * size, level * weight), and the level follows from one ordered
   pass over the sources.
2. Each source is dealt by a seeded hash to shards of about ``shard_words`` words
   and ``shard_rows`` rows, so that a large source is many groups.  Equal rows are numbered first, so they spread too.
   A shard's votes are its part of the target.  The mix has a fixed number of blocks of one word each, ``budget`` times all
   words.  They go to the shards of all sources with the highest quotients votes / (2k - 1), ties by source and
   shard.  Two divisors bound what each shard wins for sure and at most; only the quotients
   in between, about two a shard, are ranked.  So a quota is a number of words, for small sources too.
3. Inside a shard documents are ordered by the seeded hash and their words cut into
   stretches of equal length: LEAST_BLOCKS of them, of ``block_words`` words at most and of one at least, whatever other shards
   have.  A quota takes all words as often as it can, and for its rest the
   first stretches of a seeded permutation, the last of them in part.  A document's taken words are those in
   taken stretches; no word is taken more than ``repeats`` times.

Defined results: a null text has size 0 and takes 0; a null source is a source,
the last; sources of size 0 have target 0; repeated rows are separate
documents, ordered by the text's hash where ids are equal; an empty table gives
no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, n_words

WEIGHTS = (5, 2, 1)
#: Stretches that a shard should have.
LEAST_BLOCKS = 64
#: Equal rows that one task numbers.
CHUNK = 10_000
#: A prime above the number of any shard's blocks.
STEP = 2_147_483_647


def targets(sources: DataFrame, *, budget: float = 1.5, repeats: int = 2) -> DataFrame:
    """``sources`` (source, source_size) with each one's target.  One row a source: the windows see no documents."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sources.withColumn("weight", F.get(F.array(*map(F.lit, WEIGHTS)), F.pmod(F.row_number().over(order) - 1, F.lit(len(WEIGHTS)))))
    ranked = ranked.withColumn("full_at", repeats * F.col("source_size") / F.col("weight"))
    by_level = Window.orderBy("full_at", F.col("source").asc_nulls_last())
    capped = F.coalesce(F.sum(repeats * F.col("source_size")).over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    open_weight = F.sum("weight").over(by_level.rowsBetween(0, Window.unboundedFollowing))
    total = F.sum("source_size").over(by_level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    levels = ranked.withColumn("level", (budget * total - capped) / open_weight)
    # the first source in order that its level doesn't fill: of sources that fill at one level the first, too, as the others count as open there
    levels = levels.withColumn("place", F.row_number().over(by_level))
    level = F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("place", "level"))).over(Window.orderBy("place").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    target = F.least((repeats * F.col("source_size")).cast("double"), level["level"] * F.col("weight"))
    return levels.select("source", "source_size", target.alias("target"))


def first_rows(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of ``df`` in a total ``order``.  One row a range of it meets in one task, not the rows."""
    ranged = materialise(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()))
    counts = ranged.groupBy("__range").agg(F.count("*").alias("__n"))
    starts = counts.withColumn("__before", F.sum("__n").over(Window.orderBy("__range")) - F.col("__n")).where(F.col("__before") < n)
    placed = ranged.join(starts, "__range").withColumn("__place", F.row_number().over(Window.partitionBy("__range").orderBy(*order)))
    return placed.where(F.col("__before") + F.col("__place") <= n).drop("__range", "__n", "__before", "__place")


def quotas(shards: DataFrame, blocks: int) -> DataFrame:
    """``shards`` (source, shard, votes, ...; read twice) with quota: its part of ``blocks`` by Sainte-Laguë's highest quotients.

    For a divisor d the rounded votes / d of n shards sum to between total / d - n / 2
    and total / d + n / 2.  So the divisor that hands out all blocks lies between total / (blocks + n / 2)
    and total / (blocks - n / 2).
    """
    total, n = shards.agg(F.coalesce(F.sum("votes"), F.lit(0.0)), F.count("*")).first()
    if not total or blocks < 1:
        return shards.withColumn("quota", F.lit(0).cast("long"))
    rounded = lambda share: F.floor(F.col("votes") * share / total + 0.5).cast("long")
    bounds = shards.withColumns({"__sure": rounded(max(0.0, blocks - n / 2 - 1)), "__most": rounded(blocks + n / 2 + 1)})
    contested = bounds.where("__most > __sure").select("source", "shard", "votes", F.explode(F.sequence(F.col("__sure") + 1, "__most")).alias("__k"))
    contested = contested.select("source", "shard", (F.col("votes") / (2 * F.col("__k") - 1)).alias("quotient"))
    left = blocks - (bounds.agg(F.sum("__sure")).first()[0] or 0)
    won = first_rows(contested, [F.desc("quotient"), F.asc_nulls_last("source"), F.asc("shard")], left)
    won = won.groupBy(F.col("source").alias("__source"), F.col("shard").alias("__shard")).agg(F.count("*").alias("__won"))
    joined = bounds.join(won, bounds.source.eqNullSafe(F.col("__source")) & (bounds.shard == F.col("__shard")), "left")
    return joined.withColumn("quota", F.col("__sure") + F.coalesce("__won", F.lit(0))).drop("__sure", "__most", "__source", "__shard", "__won")


def _numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with ``copy``: equal rows are counted and numbered from 0, so alike in each run.  A count of over CHUNK is shared out to tasks first."""
    counted = rows.groupBy(*rows.columns).agg((F.count("*") - 1).alias("last"))
    few = counted.where(F.col("last") < CHUNK).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("bigint"), "last")))
    parts = counted.where(F.col("last") >= CHUNK).withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(F.col("last") / CHUNK)))).repartition(*rows.columns, "part")
    many = parts.withColumn("copy", F.explode(F.sequence(F.col("part") * CHUNK, F.least("last", (F.col("part") + 1) * CHUNK - 1)))).drop("part")
    return few.unionByName(many).drop("last")


def dealt(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    *,
    budget: float = 1.5,
    repeats: int = 2,
    shard_words: int = 200_000,
    shard_rows: int = 20_000,
    seed: int = 17,
) -> DataFrame:
    """(id, source, size, text_digest, draw, source_size, target, shard) of each row of ``df``, by a seeded hash of id, text and number."""
    text = F.col(f"`{text_col}`")
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").alias("source"), n_words(text).alias("size"), F.xxhash64(text).alias("text_digest"), F.md5(text.cast("binary")).alias("key"))
    rows = _numbered(materialise(rows)).withColumn("draw", _md5(F.col("id").cast("string"), F.col("key"), F.col("copy").cast("string"), F.lit(str(seed)))).drop("key", "copy")
    rows = materialise(rows)
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    n_shards = F.greatest(F.ceil(F.col("source_size") / shard_words), F.ceil(F.col("rows") / shard_rows))
    shared = targets(sources, budget=budget, repeats=repeats).join(sources.select(F.col("source").alias("s"), n_shards.alias("n_shards")), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    joined = rows.join(shared, rows.source.eqNullSafe(shared.source)).drop(shared.source)
    return joined.withColumn("shard", F.pmod(F.conv(F.substring("draw", 1, 8), 16, 10).cast("bigint"), F.col("n_shards")))


def _md5(*parts: Column) -> Column:
    return F.md5(F.concat_ws(":", *parts).cast("binary"))


def plan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *, budget: float = 1.5, repeats: int = 2, block_words: int = 128, seed: int = 17, **sizes) -> DataFrame:
    """(id_col, text_digest, size, source_size, target, taken) of each row of ``df``; ``sizes`` are ``shard_words`` and ``shard_rows`` of ``dealt``."""
    rows = dealt(df, id_col, text_col, source_col, budget=budget, repeats=repeats, seed=seed, **sizes)
    votes = F.col("target") * F.col("shard_size") / F.nullif("source_size", F.lit(0))
    shards = rows.groupBy("source", "shard", "source_size", "target").agg(F.sum("size").alias("shard_size"))
    shards = materialise(shards.withColumn("votes", F.coalesce(votes, F.lit(0.0))))
    words = shards.agg(F.coalesce(F.sum("shard_size"), F.lit(0))).first()[0]
    blocks = int(min(budget, repeats) * words + 0.5)
    # a permutation of a shard's stretches: a prime above all their numbers as step, a seeded start
    block = F.greatest(F.lit(1), F.least(F.lit(block_words), F.floor(F.col("shard_size") / LEAST_BLOCKS))).cast("bigint")
    start = F.conv(F.substring(_md5(F.col("source").cast("string"), F.col("shard").cast("string"), F.lit(str(seed))), 1, 8), 16, 10).cast("bigint")
    won = quotas(shards, blocks).select("source", "shard", F.least("quota", repeats * F.col("shard_size")).alias("quota"), "shard_size", block.alias("block"), start.alias("start"))
    won = won.withColumn("n_blocks", F.greatest(F.ceil(F.col("shard_size") / F.col("block")), F.lit(1).cast("bigint")))
    placed = rows.join(won, rows.source.eqNullSafe(won.source) & (rows.shard == won.shard)).drop(won.source, won.shard)
    inside = Window.partitionBy("source", "shard").orderBy("draw", "text_digest", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = placed.withColumn("stop", F.sum("size").over(inside)).withColumn("begin", F.col("stop") - F.col("size"))
    rest = F.pmod("quota", F.greatest("shard_size", F.lit(1)))
    whole, part = F.floor(rest / F.col("block")), F.pmod(rest, F.col("block"))

    def in_stretch(j: Column, length: Column) -> Column:
        return F.greatest(F.lit(0).cast("bigint"), F.least("stop", j * F.col("block") + length) - F.greatest("begin", j * F.col("block")))

    def drawn_from(j: Column) -> Column:
        place = (j * STEP + F.col("start")) % F.col("n_blocks")
        return F.when(place < whole, in_stretch(j, F.col("block"))).when(place == whole, in_stretch(j, part)).otherwise(0)

    stretches = F.sequence(F.floor(F.col("begin") / F.col("block")), F.floor((F.col("stop") - 1) / F.col("block")))
    drawn = F.aggregate(stretches, F.lit(0).cast("bigint"), lambda got, j: got + drawn_from(j))
    drawn = F.when((F.col("size") > 0) & (rest > 0), drawn).otherwise(0)
    taken = F.floor(F.col("quota") / F.greatest("shard_size", F.lit(1))) * F.col("size") + drawn
    return placed.select(F.col("id").alias(id_col), "text_digest", "size", "source_size", "target", taken.cast("long").alias("taken"))


def apply(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **parameters) -> DataFrame:
    """The rows of ``df``, each as many times as the mix takes its words, to the nearest whole time.

    ``parameters`` are those of ``plan``.  Rows with equal id, text and source share what they take.
    """
    digest = F.xxhash64(F.col(f"`{text_col}`"))
    taken = plan(df, id_col, text_col, source_col, **parameters).groupBy(id_col, "text_digest").agg(F.sum("taken").alias("taken"), F.sum("size").alias("size"))
    times = taken.where("taken > 0").select(F.col(id_col).alias("__id"), F.col("text_digest").alias("__digest"), F.round(F.col("taken") / F.col("size")).cast("int").alias("__times"))
    joined = df.join(times.where("__times > 0"), df[id_col].eqNullSafe(F.col("__id")) & (digest == F.col("__digest")))
    return joined.withColumn("__copy", F.explode(F.sequence(F.lit(1), "__times"))).drop("__id", "__digest", "__times", "__copy")
