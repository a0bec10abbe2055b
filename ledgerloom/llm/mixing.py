"""Mixing sources to target weights by Sainte-Lague apportionment of word blocks.

Targets come from source weights with a ceiling per source. The mix is then dealt
in blocks of equally many words: sources win blocks by highest quotients, and each
source's blocks are dealt the same way to its shards, which are hash groups of its
documents. Within a shard documents lie in seeded order and its words form blocks;
the quota is met by whole passes and one seeded run of blocks. So only one row per
source and a bounded number of rows per shard meet in a window; documents meet
shard by shard, and a source with most of the rows has most of the shards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.store import written
from ledgerloom.llm.text import word_count, words

# Weights of the sources in order, repeating.
WEIGHTS = (5, 2, 1)
SHARE, CEILING = 1.5, 2
# Words of a block; words of a shard at least; shards of a source at most.
BLOCK, SHARD_WORDS, SHARDS = 16, 65_536, 4096
SEED = "mix-1"


def seeded(*parts: Column) -> Column:
    """A hash of the parts as 32 hexadecimal digits; nulls count as empty."""
    texts = [F.coalesce(p.cast("string"), F.lit("")) for p in parts]
    return F.md5(F.concat_ws("|", F.lit(SEED), *texts))


def number(digits: Column) -> Column:
    """The first eight hexadecimal digits as a number."""
    return F.conv(F.substring(digits, 1, 8), 16, 10).cast("long")


def targets(sources: DataFrame, share: float = SHARE, ceiling: int = CEILING, weights: tuple = WEIGHTS) -> DataFrame:
    """``target`` for each row of ``source, source_size``; one row per source, so one task is enough.

    Sources in code-point order, null last, take the weights in turn. A target stops at
    ``ceiling`` times the source's size and what is over goes to the others by weight:
    the level where sources stop rising is found by filling the smallest
    ceiling-to-weight ratios first.
    """
    ordered = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    steps = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sources.withColumn("place", ordered).withColumn("weight", F.element_at(steps, (F.col("place") - 1) % len(weights) + 1))
    ranked = ranked.withColumn("cap", F.col("source_size") * float(ceiling)).withColumn("ratio", F.col("cap") / F.col("weight"))
    rising = Window.orderBy("ratio", "place")
    goal = F.sum("source_size").over(Window.partitionBy()) * F.lit(share)
    filled = F.coalesce(F.sum("cap").over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    open_weight = F.sum("weight").over(rising.rowsBetween(0, Window.unboundedFollowing))
    levels = ranked.withColumn("goal", goal).withColumn("level", (F.col("goal") - filled) / open_weight)
    level = F.max(F.when(F.col("level") < F.col("ratio"), F.col("level"))).over(Window.partitionBy())
    target = F.least(F.col("cap"), F.coalesce(level * F.col("weight"), F.col("cap")))
    return levels.select("source", "source_size", "goal", target.alias("target"), "place")


def apportion(units: DataFrame, group: list[str], order: list[str], weight: str, seats: str) -> DataFrame:
    """Add ``won``: each unit's seats when ``seats`` of its group go to the highest quotients
    ``weight / (2 k + 1)``; equal quotients go in ``order``. A unit without weight wins none.

    All seats above a safe quotient are granted at once and only the few candidates around
    the last seat, about two per unit, are ranked.
    """
    whole = Window.partitionBy(*group)
    some = units.withColumns({
        "all_weight": F.sum(weight).over(whole).cast("double"),
        "n_units": F.sum(F.when(F.col(weight) > 0, 1).otherwise(0)).over(whole),
    })
    w, n, u = F.col(weight).cast("double"), F.col(seats).cast("double"), F.col("n_units").cast("double")
    doubled_base = F.when((2 * n > u) & (F.col("all_weight") > 0), w * (2 * n - u) / F.col("all_weight")).otherwise(0.0)
    doubled_top = F.when(F.col("all_weight") > 0, w * (2 * n + u) / F.col("all_weight")).otherwise(0.0)
    based = some.withColumns({
        "base": F.when(w > 0, F.floor((doubled_base + 1) / 2)).otherwise(0).cast("long"),
        "top": F.when(w > 0, F.floor((doubled_top + 1) / 2) + 1).otherwise(0).cast("long"),
    })
    left = based.withColumn("left", F.col(seats) - F.sum("base").over(whole))
    tries = F.when(F.col("top") > F.col("base"), F.sequence(F.col("base"), F.col("top") - 1)).otherwise(F.array().cast("array<long>"))
    seat = left.select(*units.columns, "base", "left", F.explode_outer(tries).alias("k"))
    quotient = (F.col(weight) / (2 * F.col("k") + 1)).desc_nulls_last()
    turn = F.row_number().over(whole.orderBy(quotient, *order, "k"))
    more = F.sum(F.when(F.col("k").isNotNull() & (F.col("turn") <= F.col("left")), 1).otherwise(0))
    won = seat.withColumn("turn", turn).groupBy(*units.columns, "base").agg(more.alias("more"))
    return won.select(*units.columns, (F.col("base") + F.col("more")).alias("won"))


def mix(
    documents: DataFrame,
    share: float = SHARE,
    ceiling: int = CEILING,
    weights: tuple = WEIGHTS,
    block: int = BLOCK,
    sized: str | None = None,
) -> DataFrame:
    """One row per input row: ``row`` (the whole input row) with ``doc_id, size, source_size,
    target, taken`` and where its taken words lie: ``passes`` times the whole document and
    words ``part_from`` up to ``part_to`` once more.

    Size counts words (0 for null). The mix has ``share`` times all words; a document is
    never taken more than ``ceiling`` times. Null is a source of its own, the last one.
    Documents are ordered by a hash of the id, so reruns agree; rows with one id or none
    are told apart by size only, equal rows being interchangeable. Empty documents give
    nothing; an empty table gives no rows. ``sized`` names a column that has the sizes.
    """
    size = F.col(sized) if sized else word_count(F.col("text"))
    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"), "doc_id", "source", size.alias("size"))
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    blocks = F.ceil(F.col("source_size") / block)
    n_blocks = F.round(F.col("goal") / block).cast("long")
    dealt = apportion(targets(sums, share, ceiling, weights).withColumn("seats", n_blocks), [], ["place"], "target", "seats")
    shards = F.greatest(F.lit(1), F.least(F.lit(SHARDS), F.floor(F.col("source_size") / SHARD_WORDS)))
    # One row per source, used twice below.
    quotas = written(
        dealt.select(
            F.col("source").alias("of"), "source_size", "target", F.least("won", ceiling * blocks).alias("quota"), shards.alias("shards")
        ),
        "mix-sources",
    )
    # A place in the source's shards and in the shard, both by hashes of the id.
    by_source = rows.join(quotas, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    placed = by_source.withColumn("shard", number(seeded(F.lit("shard"), F.col("doc_id"))) % F.col("shards"))
    held = placed.groupBy("source", "source_size", "quota", "shard").agg(F.sum("size").alias("shard_size"))
    won = apportion(held, ["source"], ["shard"], "shard_size", "quota")
    n = F.ceil(F.col("shard_size") / block)
    draws = (
        won.withColumn("n", n)
        .withColumn("seats", F.least("won", ceiling * F.col("n")))
        .where("n > 0")
        .withColumns({"passes": F.floor(F.col("seats") / F.col("n")), "rest": F.col("seats") % F.col("n")})
        .withColumn("first", number(seeded(F.lit("run"), F.col("source"), F.col("shard"))) % (F.col("n") - F.col("rest") + 1))
        .select(F.col("source").alias("of"), F.col("shard").alias("in"), "passes", "first", "rest")
    )
    draws = written(draws, "mix-shards")
    inner = Window.partitionBy("source", "shard").orderBy(seeded(F.lit("place"), F.col("doc_id")), "doc_id", "size")
    upto = F.sum("size").over(inner.rowsBetween(Window.unboundedPreceding, 0))
    laid = placed.withColumn("end", upto).withColumn("begin", F.col("end") - F.col("size"))
    same = F.col("source").eqNullSafe(F.col("of")) & (F.col("shard") == F.col("in"))
    drawn = laid.join(draws, same, "left").drop("of", "in")
    low = F.greatest(F.col("begin"), F.col("first") * block)
    high = F.greatest(low, F.least(F.col("end"), (F.col("first") + F.col("rest")) * block))
    passes = F.coalesce("passes", F.lit(0))
    part_from, part_to = F.coalesce(low - F.col("begin"), F.lit(0)), F.coalesce(high - F.col("begin"), F.lit(0))
    return drawn.select(
        "row", "doc_id", "size", "source_size", "target",
        (passes * F.col("size") + part_to - part_from).cast("long").alias("taken"),
        passes.alias("passes"), part_from.alias("part_from"), part_to.alias("part_to"),
    )


def mixed_documents(documents: DataFrame) -> DataFrame:
    """The mix itself, in the columns of ``documents``: a row for each time a document is
    taken whole, and one with the words of its partly taken pass (joined by spaces).

    ``n_chars``, if there is one, follows the text.
    """
    found = mix(documents)
    again = F.explode(F.array_repeat(F.lit(1), F.col("passes").cast("int")))
    whole = found.where("passes > 0 and size > 0").select("row", again).select("row.*")
    cut = found.where("part_to > part_from")
    text = F.col("row.text")
    full = (F.col("part_from") == 0) & (F.col("part_to") == F.col("size"))
    piece = F.array_join(F.slice(words(text), F.col("part_from").cast("int") + 1, (F.col("part_to") - F.col("part_from")).cast("int")), " ")
    parts = cut.select(F.col("row").withField("text", F.when(full, text).otherwise(piece)).alias("row")).select("row.*")
    if "n_chars" in documents.columns:
        parts = parts.withColumn("n_chars", F.char_length("text").cast(documents.schema["n_chars"].dataType))
    return whole.union(parts)
