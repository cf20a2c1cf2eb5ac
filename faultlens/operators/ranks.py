"""Positions and running sums over a whole table's order, without one task that sees all rows.

Rows are dealt by range and sorted inside their part; what earlier parts hold is added from a table
with a row per part. The dealt rows are stored, since places must not change between two uses.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from faultlens.sources.tables import stored

#: Bits of monotonically_increasing_id() that count rows inside a part.
INSIDE = (1 << 33) - 1


def dealt(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """df with _part and _pos, which ascend in the order given."""
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return stored(placed.withColumn("_part", F.spark_partition_id()).withColumn("_pos", F.monotonically_increasing_id().bitwiseAND(F.lit(INSIDE))), "dealt")


def positions(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """df with each row's place, from 0, in a total order."""
    placed = dealt(df, order)
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    earlier = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # a row per part: its size is that of the plan, not of the data
    return placed.join(F.broadcast(sizes.select("_part", earlier.alias("_off"))), "_part").withColumn(name, F.col("_pos") + F.col("_off")).drop("_part", "_pos", "_off")


def running_sums(df: DataFrame, order: Sequence[Column], values: Sequence[str]) -> DataFrame:
    """df with cum_<v>, the sum of v up to and with the row, and all_<v>, the whole sum."""
    placed = dealt(df, order)
    per = placed.groupBy("_part").agg(*[F.sum(v).alias(f"_s_{v}") for v in values])
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per.select("_part", *[F.coalesce(F.sum(f"_s_{v}").over(before), F.lit(0)).alias(f"_o_{v}") for v in values], *[F.sum(f"_s_{v}").over(Window.partitionBy()).alias(f"all_{v}") for v in values])
    inside = Window.partitionBy("_part").orderBy("_pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = placed.join(F.broadcast(offsets), "_part")
    for v in values:
        out = out.withColumn(f"cum_{v}", F.sum(v).over(inside) + F.col(f"_o_{v}"))
    return out.drop("_part", "_pos", *[f"_o_{v}" for v in values])
