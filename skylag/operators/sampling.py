"""Exact-size samples and splits by hash order.

Rows are ordered by a seeded hash of their key. Instead of sorting, totals of slices of
the hash range show in which slice the quota is reached, first by its upper 16 bits and
inside that slice by the next 16. Only rows that share these 32 bits with the cut are
ranked. The same rows come out on every run and under every partitioning. The key should
identify a row: rows with equal keys share a slice.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skylag.session import materialized

SLICE_BITS = 16
XXHASH_BITS = 64


def key_hash(keys: Sequence[str], seed: int = 42) -> Column:
    return F.xxhash64(F.lit(seed), *[F.col(k) for k in keys])


def _prepare(df: DataFrame, keys: Sequence[str], seed: int, rank_by: str | None, rank_bits: int) -> DataFrame:
    """The hash, its upper bits and the bits after them."""
    order = F.col(rank_by).cast("bigint") if rank_by else key_hash(keys, seed)
    bits = rank_bits if rank_by else XXHASH_BITS
    upper, lower = max(bits - SLICE_BITS, 0), max(bits - 2 * SLICE_BITS, 0)
    return df.withColumn("__hash", order).withColumns({"__slice": F.shiftright("__hash", upper), "__part": F.shiftright("__hash", lower)})


def _cuts(counts: DataFrame, strata: Sequence[str], slices: str, quota: Column) -> DataFrame:
    """Per stratum of (strata, slice, n, ...): the slice in which the quota is reached, as
    `__cut_*`, and how many of its rows are still wanted. At most 65,536 slices a stratum."""
    order = Window.partitionBy(*strata).orderBy(slices).rowsBetween(Window.unboundedPreceding, 0)
    summed = counts.withColumn("__upto", F.sum("n").over(order)).withColumn("__quota", quota.cast("bigint"))
    reached = (F.col("__upto") >= F.col("__quota")) & (F.col("__upto") - F.col("n") < F.col("__quota"))
    return summed.filter(reached).select(
        *strata, F.col(slices).alias(f"__cut{slices}"), (F.col("__quota") - F.col("__upto") + F.col("n")).alias(f"__wanted{slices}")
    )


def _matched(rows: DataFrame, table: DataFrame, strata: Sequence[str]) -> DataFrame:
    """Rows with the row of their stratum; one row per stratum, so that the real size decides how it is joined."""
    named = table.withColumnsRenamed({s: f"__of_{s}" for s in strata})
    same = None
    for s in strata:
        equal = F.col(s).eqNullSafe(F.col(f"__of_{s}"))
        same = equal if same is None else same & equal
    return rows.join(named, same, "left").drop(*[f"__of_{s}" for s in strata])


def _chosen(rows: DataFrame, strata: Sequence[str], keys: Sequence[str], quota: Callable[[Column], Column], alias: str) -> DataFrame:
    """Rows with a flag that is true for the first `quota` rows of their stratum in hash order."""
    slices = rows.groupBy(*strata, "__slice").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(*strata))
    first = materialized(_cuts(slices, strata, "__slice", quota(total)), "sample-slices")
    inside = _matched(rows, first, strata).filter(F.col("__slice") == F.col("__cut__slice"))
    parts = inside.groupBy(*strata, "__part", "__wanted__slice").agg(F.count(F.lit(1)).alias("n"))
    second = materialized(_cuts(parts, strata, "__part", F.col("__wanted__slice")), "sample-parts")
    placed = _matched(rows, second, strata)
    # No cut: the quota of the stratum is 0.
    settled = placed.filter(~F.col("__part").eqNullSafe(F.col("__cut__part")))
    settled = settled.withColumn(alias, F.coalesce(F.col("__part") < F.col("__cut__part"), F.lit(False)))
    order = Window.partitionBy(*strata).orderBy("__hash", *keys)
    on_cut = placed.filter(F.col("__part") == F.col("__cut__part")).withColumn("__rank", F.row_number().over(order))
    ranked = on_cut.withColumn(alias, F.col("__rank") <= F.col("__wanted__part")).drop("__rank")
    return settled.unionByName(ranked).drop("__hash", "__slice", "__part", "__cut__part", "__wanted__part")


def sample_exact(
    df: DataFrame,
    n: int,
    keys: Sequence[str],
    seed: int = 42,
    rank_by: str | None = None,
    rank_bits: int = XXHASH_BITS,
) -> DataFrame:
    """Exactly min(n, rows) rows, without replacement.

    `rank_by` replaces the hash by a given non-negative integer column of `rank_bits` bits.
    """
    rows = _prepare(df, keys, seed, rank_by, rank_bits).withColumn("__all", F.lit(1))
    chosen = _chosen(rows, ["__all"], keys, lambda total: F.least(F.lit(n), total), "__chosen")
    return chosen.filter("__chosen").drop("__all", "__chosen")


def stratified_split(
    df: DataFrame,
    label: str,
    keys: Sequence[str],
    train_fraction: float = 0.8,
    seed: int = 42,
    rank_by: str | None = None,
    rank_bits: int = XXHASH_BITS,
    alias: str = "split",
) -> DataFrame:
    """Every row marked 'train' or 'test', with floor(fraction * rows) train rows per label value."""
    rows = _prepare(df, keys, seed, rank_by, rank_bits)
    chosen = _chosen(rows, [label], keys, lambda total: F.floor(total * train_fraction), "__chosen")
    return chosen.withColumn(alias, F.when(F.col("__chosen"), "train").otherwise("test")).drop("__chosen")


def split_by_year(
    df: DataFrame,
    train: Sequence[int] = (2018, 2019, 2020),
    validation: Sequence[int] = (2021,),
    test: Sequence[int] = (2022,),
    year: str = "Year",
    alias: str = "split",
) -> DataFrame:
    """Rows of the named years marked with their part; other years are left out."""
    part = (
        F.when(F.col(year).isin(list(train)), "train")
        .when(F.col(year).isin(list(validation)), "validation")
        .when(F.col(year).isin(list(test)), "test")
    )
    return df.withColumn(alias, part).filter(F.col(alias).isNotNull())
