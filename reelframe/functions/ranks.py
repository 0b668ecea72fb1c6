"""Numbers of rows in a sort order, without one task that holds a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import hold


def numbered(df: DataFrame, by: list[str], order: list[Column], name: str) -> DataFrame:
    """df with a column that numbers each group's rows from 1 in the given order; without by, all rows.

    Rows are parted by ranges of group and order, so a large group lies in several parts. A row's number is its place
    in its part and group plus what the parts before hold of the group. Only groups in several parts have anything
    before them, and there are fewer of those than parts: they go to every task. The parts are written once, as both
    sides must see the same ones."""
    parts = hold(df.repartitionByRange(*map(F.col, by), *order).withColumn("__part", F.spark_partition_id()))
    counts = parts.groupBy("__part", *by).agg(F.count("*").alias("__n"))
    within = Window.partitionBy(*by).orderBy("__part")
    if not by:  # as many rows as parts
        before = counts.select("__part", (F.sum("__n").over(within) - F.col("__n")).alias("__before"))
    else:
        before = counts.select("__part", *by, (F.sum("__n").over(within) - F.col("__n")).alias("__before")).where("__before > 0")
    place = F.row_number().over(Window.partitionBy("__part", *by).orderBy(*order)).cast("long")
    keyed = [F.col(c).alias(f"__by{i}") for i, c in enumerate(by)]
    before = F.broadcast(before.select(F.col("__part").alias("__of"), *keyed, "__before"))
    same = F.col("__part") == F.col("__of")
    for i, c in enumerate(by):
        same &= F.col(c).eqNullSafe(F.col(f"__by{i}"))
    placed = parts.withColumn("__place", place)
    return placed.join(before, same, "left").select(*df.columns, (F.col("__place") + F.coalesce("__before", F.lit(0))).alias(name))


def in_order(df: DataFrame, name: str) -> DataFrame:
    """df, which is sorted, with a column that numbers its rows from 1 in their order: a row's place in its part plus what
    the parts before hold. The rows are written once and not shuffled again."""
    parts = hold(df.withColumn("__row", F.monotonically_increasing_id()))
    part = F.shiftright("__row", 33)  # the number of the part is in the upper bits, the place in it in the lower ones
    counts = parts.groupBy(part.alias("__of")).agg(F.count("*").alias("__n"))
    before = counts.select("__of", (F.sum("__n").over(Window.orderBy("__of")) - F.col("__n")).alias("__before"))  # as many rows as parts
    placed = parts.join(F.broadcast(before), part == F.col("__of"))
    return placed.select(*df.columns, (F.col("__row").bitwiseAND((1 << 33) - 1) + F.col("__before") + 1).alias(name))


def parted(rows: DataFrame, *by: str, given: DataFrame | None = None, most: int = 500_000) -> DataFrame:
    """rows parted by columns for windows over them, over as many tasks as keep about so many rows each, so that what a
    task sorts doesn't grow with the table; at least as many as there are shuffle partitions.

    given, if rows are costly to make, is a table that has as many of them or more."""
    parts = -(-(rows if given is None else given).count() // most)
    return rows.repartition(max(parts, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *by)
