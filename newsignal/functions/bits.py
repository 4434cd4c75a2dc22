"""A fixed number of bits for a set of any size: tells most other values apart without a join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _place(value: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(value), F.lit(bits))


def bit_table(values: DataFrame, column: str, bits: int) -> DataFrame:
    """One row with one array of ``bits`` / 64 numbers, in which the bit of every value is set."""
    place = _place(F.col(column), bits)
    words = values.groupBy(F.shiftright(place, 6).cast("int").alias("word")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), (place % 64).cast("int"))).alias("bits"))
    full = values.sparkSession.range(bits >> 6).select(F.col("id").cast("int").alias("word")).join(words, "word", "left")
    rows = full.agg(F.sort_array(F.collect_list(F.struct("word", F.coalesce("bits", F.lit(0)).alias("bits")))).alias("rows"))
    return rows.select(F.transform("rows", lambda x: x["bits"]).alias("bits"))


def may_hold(table: Column, value: Column, bits: int) -> Column:
    """True for every value that is in the table, false for most others. ``table`` is the array, a scalar subquery as a rule."""
    place = _place(value, bits)
    word = F.get(table, F.shiftright(place, 6).cast("int"))
    return F.call_function("shiftright", word, (place % 64).cast("int")).bitwiseAND(F.lit(1)) == 1
