"""Which months each code was bought in, as one bit per month.

A code's months fit into a few 64-bit words, so one aggregation with fixed-width
buffers replaces groups per code and month: what is shuffled is a row per code and
word. Gaps, missing cells and membership are bit tests on the code's row; nothing is
joined on code x month.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

WORD = 64


def _word(month: Column | str) -> Column:
    month = F.col(month) if isinstance(month, str) else month
    return F.shiftright(month, 6)


def _bit(month: Column | str) -> Column:
    month = F.col(month) if isinstance(month, str) else month
    return month.bitwiseAND(F.lit(WORD - 1))


def month_bits(ledger: DataFrame, counts: Column | None = None) -> DataFrame:
    """A row per code: ``bits`` (word to 64 months) and ``first_month`` of the rows for which ``counts`` holds.

    A code none of whose rows count has no bits and no first month. The map holds a
    word per 64 calendar months.
    """
    counts = F.lit(True) if counts is None else counts
    # Shifting is by column: a long one, moved by the month's place in its word.
    bit = F.when(counts, F.call_function("shiftleft", F.lit(1).cast("long"), _bit("month_idx")))
    words = ledger.groupBy("rm_code", _word("month_idx").alias("word")).agg(
        F.bit_or(bit).alias("bits"), F.min(F.when(counts, F.col("month_idx"))).alias("first_month")
    )
    return words.groupBy("rm_code").agg(
        F.map_from_entries(
            F.collect_list(F.when(F.col("bits").isNotNull() & F.col("word").isNotNull(), F.struct("word", "bits")))
        ).alias("bits"),
        F.min("first_month").alias("first_month"),
    )


def is_bought(month: Column | str = "month_idx", bits: str = "bits") -> Column:
    """Whether a month's bit is set in the code's ``bits``."""
    word = F.coalesce(F.try_element_at(F.col(bits), _word(month)), F.lit(0).cast("long"))
    return F.call_function("shiftrightunsigned", word, _bit(month)).bitwiseAND(F.lit(1).cast("long")) == 1


def absent_months(bits: DataFrame, calendar: Column) -> DataFrame:
    """Calendar months a code's bits lack; ``is_leading`` marks those before its first."""
    cells = bits.select("rm_code", "bits", "first_month", F.explode(calendar).alias("month_idx"))
    leading = F.coalesce(F.col("month_idx") < F.col("first_month"), F.lit(True))
    return cells.where(~is_bought()).select("rm_code", "month_idx", leading.alias("is_leading"))


def only_bought(df: DataFrame, bits: DataFrame) -> DataFrame:
    """Rows of ``df`` in months the code was bought in; the join brings one row per code."""
    held = bits.select("rm_code", F.col("bits").alias("_bits"))
    return df.join(held, "rm_code").where(is_bought(bits="_bits")).drop("_bits")
