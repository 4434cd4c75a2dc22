"""Rank, quartile and position over a whole table without a one-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLOTS = 65_536


def with_global_rank(df: DataFrame, value: str, tie: str, low: float = -1.0, high: float = 1.0) -> DataFrame:
    """Adds ``rank`` (ties share it), ``position`` (1..n) and ``row_total``, by ``value`` descending.

    ``value`` is a double within [low, high]; NULL ranks last. Equal values are put in the order of md5(tie), tie.

    ``rank() over (order by …)`` would move every row to one task. Here the rows are counted per
    cell (slot of the value range, value, first two digits of the tie digest); only the slot
    totals, at most SLOTS + 1 rows, are summed up in one task. A value shared by a third of the
    rows falls into 256 cells.
    """
    slot = F.coalesce(F.floor((F.lit(high) - F.col(value)) / (high - low) * SLOTS), F.lit(SLOTS + 1))
    digest = F.md5(F.col(tie).cast("string"))
    rows = df.withColumns({"_slot": slot, "_digest": digest, "_part": F.substring(digest, 1, 2)})

    cells = rows.groupBy("_slot", value, "_part").agg(F.count(F.lit(1)).alias("_n"))
    in_order = Window.orderBy("_slot")
    everything = in_order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    slots = (
        cells.groupBy("_slot").agg(F.sum("_n").alias("_slot_n"))
        .select(
            "_slot",
            (F.sum("_slot_n").over(in_order) - F.col("_slot_n")).alias("_before_slot"),
            F.sum("_slot_n").over(everything).alias("row_total"),
        )
    )
    by_value = Window.partitionBy("_slot").orderBy(F.desc_nulls_last(value))
    by_cell = Window.partitionBy("_slot").orderBy(F.desc_nulls_last(value), "_part")
    same_value = Window.partitionBy("_slot", value)
    offsets = cells.select(
        "_slot", value, "_part",
        (F.sum("_n").over(by_value) - F.sum("_n").over(same_value)).alias("_above"),
        (F.sum("_n").over(by_cell) - F.col("_n")).alias("_before_cell"),
    )
    within = Window.partitionBy("_slot", value, "_part").orderBy("_digest", tie)
    return (
        rows.withColumn("_key", F.coalesce(value, F.lit(high + 1)))
        .join(offsets.withColumn("_key", F.coalesce(value, F.lit(high + 1))).drop(value), ["_slot", "_key", "_part"])
        .join(slots, "_slot")
        .withColumn("rank", F.col("_before_slot") + F.col("_above") + 1)
        .withColumn("position", F.col("_before_slot") + F.col("_before_cell") + F.row_number().over(within))
        .drop("_slot", "_key", "_digest", "_part", "_above", "_before_cell", "_before_slot")
    )


def tile(position: Column, total: Column, tiles: int) -> Column:
    """NTILE from a 1-based position: the first ``total mod tiles`` tiles hold one row more."""
    size = F.floor(total / tiles)
    larger = total % tiles
    edge = larger * (size + 1)
    return (
        F.when(position <= edge, F.floor((position - 1) / (size + 1)) + 1)
        .otherwise(larger + F.floor((position - edge - 1) / F.greatest(size, F.lit(1))) + 1)
        .cast("int")
    )
