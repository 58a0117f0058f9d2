"""Order-dependent results over groups of any size.

A window over one large group runs in one task. Here a group is cut into buckets
that follow its order; work inside a bucket is local, and what a bucket needs from
the ones before it comes from a table with one row per bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skylag.session import materialized


def previous_value(
    df: DataFrame,
    keys: Sequence[str],
    bucket: dict[str, Column],
    order: Sequence[str],
    value: str,
    alias: str,
) -> DataFrame:
    """The value of the preceding row of the same key, as `lag` gives it.

    Every key is cut into buckets; `bucket` names columns that are a coarser form of
    `order` (for instance the date and the hour of a date and clock order). The last
    value of a bucket enters the next bucket in use as one extra row, so that the rows
    are shuffled once and not joined. The same plan serves keys of any size.
    """
    names = list(bucket)
    local = [*keys, *names]
    rows = df.withColumns(bucket)

    # One row per key and bucket: its last value, moved on to the next bucket.
    last = F.max_by(F.struct(F.col(value).alias("v")), F.struct(*order)).alias("__last")
    across = Window.partitionBy(*keys).orderBy(*names)
    per_bucket = rows.groupBy(*local).agg(last).withColumn("__next", F.lead(F.struct(*names)).over(across))
    carried = per_bucket.filter(F.col("__next").isNotNull()).select(
        *keys, *[F.col(f"__next.{n}").alias(n) for n in names], F.col("__last.v").alias(value), F.lit(0).alias("__own")
    )

    together = rows.withColumn("__own", F.lit(1)).unionByName(carried, allowMissingColumns=True)
    within = Window.partitionBy(*local).orderBy("__own", *order)
    return together.withColumn(alias, F.lag(value).over(within)).filter(F.col("__own") == 1).drop("__own", *names)


def range_bucketed(df: DataFrame, order: Sequence[str], bucket: str = "__bucket") -> DataFrame:
    """The rows dealt out by ranges of `order`, written once, with the number of their range.

    Ranges ascend with the order and hold about equally many rows; Spark samples their
    bounds. They only balance the work: results do not depend on them.
    """
    dealt = df.repartitionByRange(*order).withColumn(bucket, F.spark_partition_id())
    return materialized(dealt, "range-buckets")


def running_totals(
    df: DataFrame,
    order: str,
    bucket: str,
    measures: Sequence[str],
    keys: Sequence[str] = (),
) -> DataFrame:
    """Adds `<measure>_before`: the sum over all rows of the key that sort earlier.

    `df` holds one row per key and order value, `bucket` is monotone in `order`.
    """
    local = [*keys, bucket]
    per_bucket = df.groupBy(*local).agg(*[F.sum(m).alias(m) for m in measures])
    earlier = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_bucket.select(
        *local, *[F.coalesce(F.sum(m).over(earlier), F.lit(0)).alias(f"__{m}_offset") for m in measures]
    )
    inside = Window.partitionBy(*local).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    summed = df.withColumns({f"{m}_before": F.coalesce(F.sum(m).over(inside), F.lit(0)) for m in measures})
    return (
        summed.join(offsets, local)
        .withColumns({f"{m}_before": F.col(f"{m}_before") + F.col(f"__{m}_offset") for m in measures})
        .drop(*[f"__{m}_offset" for m in measures])
    )
