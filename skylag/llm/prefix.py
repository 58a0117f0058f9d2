"""Running totals over numbered rows without one task seeing them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 128


def running_before(df: DataFrame, number: str, values: dict[str, Column]) -> DataFrame:
    """The frame with, for each value, the total over all rows of a smaller number.

    `number` is a unique non-negative integer. Totals of blocks of 128 numbers are summed
    first and added to the totals inside each block, so a task holds one block, or one row
    per block.
    """
    block = F.floor(F.col(number) / F.lit(BLOCK))
    numbered = df.withColumn("_block", block)
    per_block = numbered.groupBy("_block").agg(*[F.sum(v).alias(f"_sum_{n}") for n, v in values.items()])
    earlier_blocks = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    bases = per_block.select("_block", *[F.coalesce(F.sum(f"_sum_{n}").over(earlier_blocks), F.lit(0)).alias(f"_base_{n}") for n in values])
    earlier_rows = Window.partitionBy("_block").orderBy(number).rowsBetween(Window.unboundedPreceding, -1)
    inside = numbered.withColumns({f"_in_{n}": F.coalesce(F.sum(v).over(earlier_rows), F.lit(0)) for n, v in values.items()})
    joined = inside.join(bases, "_block")
    return joined.select(*df.columns, *[(F.col(f"_base_{n}") + F.col(f"_in_{n}")).alias(n) for n in values])
