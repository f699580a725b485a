"""Numbers of rows in the order of a group, where one group may hold most of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written


def numbered(df: DataFrame, by: list[str], coarse: Column, order: list, name: str = "n") -> DataFrame:
    """df with the place of each row, from 1, in its group's order.

    coarse never falls in that order. Rows are numbered for each of its values alone, and moved on by the counts of the values
    before, so a group is in as many tasks as coarse has values; only the counts of a group meet in one. The counts are written,
    so that the numbered rows are not shuffled once more to meet them where they are few.
    """
    rows = df.withColumn("__part", coarse)
    sizes = rows.groupBy(*by, "__part").agg(F.count("*").alias("__size"))
    before = sizes.withColumn("__before", F.sum("__size").over(Window.partitionBy(*by).orderBy("__part")) - F.col("__size")).drop("__size")
    before = written(before, narrow=True)
    inside = F.row_number().over(Window.partitionBy(*by, "__part").orderBy(*order))
    return rows.withColumn("__in", inside).join(before, [*by, "__part"]).withColumn(name, (F.col("__before") + F.col("__in")).cast("int")).drop("__part", "__in", "__before")


def falling(amount: Column) -> Column:
    """A coarse order of amounts from the largest down: their number of bits in cents, then the first ten of these."""
    cents = (amount * 100).cast("long")
    bits = F.when(cents > 0, F.length(F.bin(cents))).otherwise(0)
    return F.struct(-bits, F.when(cents > 0, -F.call_function("shiftright", cents, F.greatest(bits - 10, F.lit(0)))).otherwise(0))
