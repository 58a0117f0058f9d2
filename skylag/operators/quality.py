"""Data-quality profiles and leakage checks."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skylag import fixed_values as fixed
from skylag.functions.numeric import percent
from skylag.operators.rates import share_of_total
from skylag.schemas import columns_named_like, numeric_columns
from skylag.session import materialized


def _one_row_to_long(row: DataFrame, entries: list) -> DataFrame:
    """A wide one-row aggregate as one row per column."""
    return row.select(F.inline(F.array(*entries)))


def null_profile(df: DataFrame, columns: Sequence[str] | None = None, digits: int | None = 2) -> DataFrame:
    """Missing values and their percent per column, all columns in one scan."""
    names = [c for c in (df.columns if columns is None else columns) if c in df.columns]
    counts = df.agg(F.count(F.lit(1)).alias("total"), *[F.count(F.col(c)).alias(f"n_{i}") for i, c in enumerate(names)])
    entries = []
    for i, c in enumerate(names):
        missing = F.col("total") - F.col(f"n_{i}")
        pct = percent(missing, F.col("total"))
        entries.append(
            F.struct(
                F.lit(c).alias("column"),
                missing.alias("missing_count"),
                (pct if digits is None else F.bround(pct, digits)).alias("missing_pct"),
            )
        )
    return _one_row_to_long(counts, entries)


def completeness(profile: DataFrame) -> DataFrame:
    """100 minus the mean missing percent."""
    return profile.agg((100 - F.avg("missing_pct")).alias("completeness_pct"))


def missing_fractions(df: DataFrame, columns: Sequence[str] = tuple(fixed.WEATHER_MEASURES), digits: int = 3) -> DataFrame:
    """Missing fraction per column that exists."""
    profile = null_profile(df, columns, digits=None)
    return profile.select("column", F.bround(F.col("missing_pct") / 100, digits).alias("missing_fraction"))


def _target_counts(df: DataFrame, target: str) -> DataFrame:
    return df.groupBy(F.col(target).alias("target")).agg(F.count(F.lit(1)).alias("count"))


def target_distribution(df: DataFrame, target: str = "DepDel15") -> DataFrame:
    """Rows and percent per target value, null included."""
    return share_of_total(_target_counts(df, target), "count", "pct")


def imbalance(df: DataFrame, target: str = "DepDel15", warn_below: float = 0.1) -> DataFrame:
    """Smaller over larger class, and whether it is below the warning level."""
    return _imbalance(_target_counts(df, target), warn_below)


def _imbalance(per_target: DataFrame, warn_below: float) -> DataFrame:
    def rows_with(value: int) -> Column:
        return F.coalesce(F.sum(F.when(F.col("target") == value, F.col("count"))), F.lit(0))

    counts = per_target.agg(rows_with(0).alias("negatives"), rows_with(1).alias("positives"))
    both = (F.col("negatives") > 0) & (F.col("positives") > 0)
    value = F.when(both, F.least("negatives", "positives") / F.greatest("negatives", "positives"))
    return counts.select(
        "negatives", "positives", value.alias("imbalance_ratio"), (value < warn_below).alias("severely_imbalanced")
    )


def correlations(df: DataFrame, target: str = "DepDel15", columns: Sequence[str] | None = None) -> DataFrame:
    """Pearson correlation of every numeric column with the target over rows where both are known.

    Rows are laid out by column, so that one small aggregate serves any number of columns.
    """
    names = [c for c in (numeric_columns(df) if columns is None else columns) if c != target]
    y = F.col(target).cast("double")

    values = F.array(*[F.col(c).cast("double") for c in names]) if names else F.array().cast("array<double>")
    known = df.filter(y.isNotNull()).select(y.alias("y"), F.posexplode(values).alias("i", "x")).filter("x IS NOT NULL")
    # Not the built-in corr: in ANSI mode it raises on a constant column.
    pearson = F.try_divide(F.covar_pop("x", "y"), F.stddev_pop("x") * F.stddev_pop("y"))
    found = known.groupBy("i").agg(pearson.alias("r")).agg(F.map_from_entries(F.collect_list(F.struct("i", "r"))).alias("by_column"))
    return _one_row_to_long(
        found, [F.struct(F.lit(c).alias("column"), F.try_element_at("by_column", F.lit(i)).alias("correlation")) for i, c in enumerate(names)]
    )


def strong_correlations(df: DataFrame, target: str = "DepDel15", threshold: float = 0.9, columns: Sequence[str] | None = None) -> DataFrame:
    """Columns that correlate so strongly that they probably leak; constant columns have none."""
    return correlations(df, target, columns).filter(F.abs("correlation") >= threshold)


def _as_rows(spark: SparkSession, check: str, names: Sequence[str]) -> DataFrame:
    return spark.createDataFrame([(check, n) for n in names], "check string, column string")


def leakage_columns(columns: Sequence[str], keywords: Sequence[str] = tuple(fixed.LEAKAGE_KEYWORDS)) -> list[str]:
    return columns_named_like(columns, keywords)


def time_travel_columns(columns: Sequence[str], keywords: Sequence[str] = tuple(fixed.TIME_TRAVEL_KEYWORDS)) -> list[str]:
    return columns_named_like(columns, keywords)


def column_audit(df: DataFrame) -> DataFrame:
    """Columns whose names point to leakage or time travel."""
    spark = df.sparkSession
    return _as_rows(spark, "leakage", leakage_columns(df.columns)).unionByName(
        _as_rows(spark, "time_travel", time_travel_columns(df.columns))
    )


def health_report(df: DataFrame, target: str = "DepDel15", columns: Sequence[str] | None = None) -> DataFrame:
    """All checks as (check, item, value): named columns, target distribution and
    imbalance, strong correlations. Two scans: target counts, and correlations."""
    number = F.lit(None).cast("double")
    audit = column_audit(df).select("check", F.col("column").alias("item"), number.alias("value"))
    counts = materialized(_target_counts(df, target), "target-counts")
    share = share_of_total(counts, "count", "pct").select(
        F.lit("target_pct").alias("check"), F.coalesce(F.col("target").cast("string"), F.lit("null")).alias("item"), F.col("pct").alias("value")
    )
    ratio_row = _imbalance(counts, 0.1).select(
        F.lit("imbalance_ratio").alias("check"), F.lit(target).alias("item"), F.col("imbalance_ratio").alias("value")
    )
    strong = strong_correlations(df, target, columns=columns).select(
        F.lit("strong_correlation").alias("check"), F.col("column").alias("item"), F.col("correlation").alias("value")
    )
    return audit.unionByName(share).unionByName(ratio_row).unionByName(strong)


def _numbers(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The columns as doubles v0, v1, ...: neutral names, so that any column name works; not-a-number is unknown."""
    return df.select(*[F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(f"v{i}") for i, c in enumerate(columns)])


def by_column(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows (place, value): the columns' values as doubles, one row each, with the place of the column among them."""
    return df.select(F.posexplode(F.array(*[F.col(c).cast("double") for c in columns])).alias("place", "value"))


DIGITS = 65_536  # counts a column, range and pass
LOG_ENDS = 710.0  # logarithms of doubles lie between


def _log_digit(value: Column) -> Column:
    """The first digit: equal shares of the logarithm, which covers all doubles."""
    size = F.least(F.log1p(F.abs(value)), F.lit(LOG_ENDS))
    return F.floor((F.signum(value) * size + LOG_ENDS) / (2 * LOG_ENDS) * (DIGITS - 1)).cast("bigint")


def _cells(df: DataFrame, columns: Sequence[str], ranges: Sequence[tuple[int, float, float, dict[int, int] | None]]) -> DataFrame:
    """Rows (range, digit, value) of all known values within a range of their column; the ranges of a column do not overlap.

    Values are laid out by column first, so that one small expression gives the range and digit for any number of columns.
    """
    places = sorted({i for i, *_ in ranges})
    laid = by_column(df, [columns[i] for i in places]).filter(F.col("value").isNotNull() & ~F.isnan("value"))
    if ranges[0][3] is None:  # the first pass: one range a column, which holds all values
        return laid.select(F.col("place").alias("range"), _log_digit(F.col("value")).alias("digit"), "value")
    own = [[number for number, r in enumerate(ranges) if r[0] == i] for i in places]

    def known(numbers: Sequence[int | None], end: int) -> Column:
        return F.array(*[F.lit(None if n is None else ranges[n][end]).cast("double") for n in numbers])

    layers = [[n[k] if k < len(n) else None for n in own] for k in range(max(map(len, own)))]
    place, value = F.col("place"), F.col("value")
    number = F.coalesce(*[F.when(value.between(known(layer, 1)[place], known(layer, 2)[place]), F.array(*[F.lit(n).cast("int") for n in layer])[place]) for layer in layers])
    within = laid.select(number.alias("range"), "value").filter("range IS NOT NULL")
    low, high = (known(range(len(ranges)), end)[F.col("range")] for end in (1, 2))
    return within.select("range", F.floor((value - low) / (high - low) * (DIGITS - 1)).cast("bigint").alias("digit"), "value")


def _places(total: int, shares: Sequence[float]) -> list[int]:
    """The ranks, from 0, on both sides of each share of so many values."""
    return sorted({f((total - 1) * q) for q in shares for f in (math.floor, math.ceil)})


def ranked_values(df: DataFrame, columns: Sequence[str], shares: Sequence[float]) -> dict[str, tuple[int, dict[int, float]]]:
    """Per column the number of its known values, and the values on both sides of each share of them by rank from 0.

    Radix selection: a pass counts the rows of at most 65,536 digits, of all values at first
    and then only of the ranges that hold a wanted rank; a range whose values are all the same
    is done. Digits rise with the values, first by their logarithm and then in equal shares of
    the range between its own least and largest value. Only counts are moved and sorted; a few
    passes resolve all doubles.
    """
    found: dict[str, tuple[int, dict[int, float]]] = {c: (0, {}) for c in columns}
    # Ranges looked at: column, least and largest value, and the wanted ranks with their place inside.
    ranges: list[tuple[int, float, float, dict[int, int] | None]] = [(i, -math.inf, math.inf, None) for i in range(len(columns))]
    while ranges:
        each = _cells(df, columns, ranges)
        counts = each.groupBy("range", "digit").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))
        rising = Window.partitionBy("range").orderBy("digit").rowsBetween(Window.unboundedPreceding, -1)
        placed = counts.withColumns({"before": F.coalesce(F.sum("n").over(rising), F.lit(0)), "total": F.sum("n").over(Window.partitionBy("range"))})

        def holds(rank: Column) -> Column:
            return (F.col("before") <= rank) & (rank < F.col("before") + F.col("n"))

        asked = []
        for number, (_, _, _, wanted) in enumerate(ranges):
            inner = [f((F.col("total") - 1) * q) for q in shares for f in (F.floor, F.ceil)] if wanted is None else [F.lit(r) for r in sorted(set(wanted.values()))]
            asked.append((F.col("range") == number) & reduce(lambda x, y: x | y, map(holds, inner)))
        following = []
        for row in placed.filter(reduce(lambda x, y: x | y, asked)).collect():  # at most a row for each wanted rank
            i, _, _, wanted = ranges[row["range"]]
            if wanted is None:
                wanted = {r: r for r in _places(row["total"], shares)}
                found[columns[i]] = (row["total"], found[columns[i]][1])
            own = {rank: inner - row["before"] for rank, inner in wanted.items() if row["before"] <= inner < row["before"] + row["n"]}
            if row["low"] == row["high"]:
                found[columns[i]][1].update(dict.fromkeys(own, row["low"]))
            else:
                following.append((i, row["low"], row["high"], own))
        ranges = following
    return found


def _between(total: int, values: dict[int, float], share: float) -> float | None:
    """The quantile, interpolated between the two nearest values."""
    if not total:
        return None
    place = (total - 1) * share
    low, high = values[math.floor(place)], values[math.ceil(place)]
    return low + (high - low) * (place - math.floor(place)) if low != high else low


def medians(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Exact median per column that has a known value, interpolated between the two middle values."""
    found = ranked_values(df, columns, [0.5])
    rows = [(c, _between(*found[c], 0.5)) for c in columns if found[c][0]]
    return df.sparkSession.createDataFrame(rows, "column string, median double")


QUARTILES = {"q25": 0.25, "q50": 0.5, "q75": 0.75}


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per column: count, mean, stddev, min, exact quartiles and max, as numbers.

    Quartiles are interpolated between the two nearest values. A column without a known
    value has a count of 0 and nulls.
    """
    found = ranked_values(df, columns, list(QUARTILES.values()))
    quartiles = [(c, *[_between(*found[c], q) for q in QUARTILES.values()]) for c in columns]
    table = df.sparkSession.createDataFrame(quartiles, "column string, " + ", ".join(f"{n} double" for n in QUARTILES))
    measures = {"count": F.count, "mean": F.avg, "stddev": F.stddev_samp, "min": F.min, "max": F.max}
    row = _numbers(df, columns).agg(*[f(f"v{i}").alias(f"{n}_{i}") for i in range(len(columns)) for n, f in measures.items()])
    entries = [F.struct(F.lit(c).alias("column"), *[F.col(f"{n}_{i}").alias(n) for n in measures]) for i, c in enumerate(columns)]
    return _one_row_to_long(row, entries).join(table, "column").select("column", "count", "mean", "stddev", "min", *QUARTILES, "max")
