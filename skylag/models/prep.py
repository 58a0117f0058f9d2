"""Feature preparation. Statistics come from the training rows only; every fit
returns a Spark ML stage, so a fitted pipeline can be saved and loaded whole."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer, FeatureHasher, OneHotEncoder, QuantileDiscretizer, SQLTransformer, StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skylag.operators.ordered import range_bucketed, running_totals
from skylag.operators.quality import by_column, medians
from skylag.session import materialized


def labelled(df: DataFrame, target: str = "DepDel15") -> DataFrame:
    """Rows with a known target, as an integer."""
    return df.filter(F.col(target).isNotNull()).withColumn(target, F.col(target).cast("int"))


def balanced_weights(df: DataFrame, label: str = "DepDel15", alias: str = "weight") -> DataFrame:
    """Rows weighted by n / (2 * n_class) for a 0/1 label."""
    counts = df.agg(
        F.struct(F.count_if(F.col(label) == 0).alias("neg"), F.count_if(F.col(label) == 1).alias("pos"))
    ).scalar()
    neg, pos = counts.getField("neg"), counts.getField("pos")
    of_class = F.when(F.col(label) == 1, pos).otherwise(neg)
    return df.withColumn(alias, (neg + pos) / (of_class * 2))


def cost_weights(df: DataFrame, label: str = "DepDel15", miss_cost: float = 5.0, alias: str = "weight") -> DataFrame:
    """Positives weighted by the cost of missing one."""
    return df.withColumn(alias, F.when(F.col(label) == 1, float(miss_cost)).otherwise(1.0))


def _sql_stage(columns: dict[str, str]) -> SQLTransformer:
    added = ", ".join(f"{expression} AS `{name}`" for name, expression in columns.items())
    return SQLTransformer(statement=f"SELECT *, {added} FROM __THIS__")


def with_known_values(train: DataFrame, columns: Sequence[str]) -> list[str]:
    """The columns that have a value in at least one training row; nothing can be learned from others."""
    if not columns:
        return []
    counts = train.agg(*[F.count(F.col(c)).alias(f"n_{i}") for i, c in enumerate(columns)]).first()
    return [c for i, c in enumerate(columns) if counts[f"n_{i}"]]


def fit_median_imputer(train: DataFrame, columns: Sequence[str], suffix: str = "_imp") -> SQLTransformer:
    """Fill missing numbers with the training median; a column without a known training value is refused."""
    found = {r["column"]: r["median"] for r in medians(train, columns).collect()}
    unknown = [c for c in columns if c not in found]
    if unknown:
        raise ValueError(f"no known training value: {', '.join(unknown)}")
    return _sql_stage({f"{c}{suffix}": f"coalesce(cast(`{c}` as double), {found[c]!r}D)" for c in columns})


def category_filler(columns: Sequence[str], placeholder: str = "missing", suffix: str = "_cat") -> SQLTransformer:
    """Fill missing categories with a placeholder."""
    return _sql_stage({f"{c}{suffix}": f"coalesce(cast(`{c}` as string), '{placeholder}')" for c in columns})


def known_or_missing(df: DataFrame, train: DataFrame, column: str, placeholder: str = "missing") -> DataFrame:
    """Replace values that do not occur in the training rows by the placeholder."""
    seen = train.select(F.coalesce(F.col(column), F.lit(placeholder)).alias("__seen")).distinct()
    filled = df.withColumn(column, F.coalesce(F.col(column), F.lit(placeholder)))
    return filled.join(seen, F.col(column) == F.col("__seen"), "left").withColumn(
        column, F.coalesce("__seen", F.lit(placeholder))
    ).drop("__seen")


def unseen_values(df: DataFrame, train: DataFrame, column: str) -> DataFrame:
    """Distinct values that the training rows do not have."""
    return df.select(column).subtract(train.select(column))


def fit_indexer(train: DataFrame, columns: Sequence[str], suffix: str = "_idx") -> StringIndexerModel:
    """Alphabetical codes; all unseen values share the code after the last one."""
    return StringIndexer(
        inputCols=list(columns),
        outputCols=[f"{c}{suffix}" for c in columns],
        stringOrderType="alphabetAsc",
        handleInvalid="keep",
    ).fit(train)


def label_codes(train: DataFrame, column: str, alias: str = "code") -> DataFrame:
    """Alphabetical codes 0.. of the known training values as a table, for any number of values.

    Distinct values are dealt out by ranges; a code is the number of values in earlier ranges
    and earlier in its own. No vocabulary passes through the driver.
    """
    known = train.filter(F.col(column).isNotNull()).select(F.col(column).cast("string").alias("__value")).distinct()
    dealt = range_bucketed(known.withColumn("__one", F.lit(1)), ["__value"])
    ranked = running_totals(dealt, "__value", "__bucket", ["__one"])
    return materialized(ranked.select(F.col("__value").alias(column), F.col("__one_before").cast("bigint").alias(alias)), "label-codes")


def encode(df: DataFrame, codes: DataFrame, column: str, suffix: str = "_idx", alias: str = "code") -> DataFrame:
    """The frame with the code of a column; unseen and unknown values share the code after the last one."""
    others = codes.agg(F.coalesce(F.max(alias) + 1, F.lit(0)).alias("n")).scalar()
    named = codes.select(F.col(column).alias("__seen"), F.col(alias).alias("__code"))
    joined = df.join(named, F.col(column).cast("string") == F.col("__seen"), "left")
    return joined.withColumn(f"{column}{suffix}", F.coalesce("__code", others).cast("double")).drop("__seen", "__code")


def fit_one_hot_codes(train: DataFrame, columns: Sequence[str], suffix: str = "_vec"):
    """One slot per code of `encode`, fitted on training rows: rows with the code after the last one get all zeros.

    Only the largest code of each column reaches the driver.
    """
    return OneHotEncoder(inputCols=list(columns), outputCols=[f"{c}{suffix}" for c in columns], dropLast=True, handleInvalid="keep").fit(train)


def split_by_variety(train: DataFrame, columns: Sequence[str], most: int = 1000) -> tuple[list[str], list[str]]:
    """Columns of about `most` different values or fewer, and all others, in one scan."""
    if not columns:
        return [], []
    counts = train.agg(*[F.approx_count_distinct(F.col(c)).alias(f"n_{i}") for i, c in enumerate(columns)]).first()
    few = [c for i, c in enumerate(columns) if counts[f"n_{i}"] <= most]
    return few, [c for c in columns if c not in few]


def hasher(columns: Sequence[str], slots: int, output: str = "hashed") -> FeatureHasher:
    """All columns' values dealt to a fixed number of slots by hash: nothing is learned, so any number of values will do."""
    return FeatureHasher(inputCols=list(columns), categoricalCols=list(columns), numFeatures=slots, outputCol=output)


def hash_codes(columns: Sequence[str], slots: int, suffix: str = "_hash") -> SQLTransformer:
    """Each column's values dealt to so many numbers by hash."""
    return _sql_stage({f"{c}{suffix}": f"cast(pmod(xxhash64(cast(`{c}` as string)), {slots}L) as double)" for c in columns})


def unseen_as_missing(model: StringIndexerModel, placeholder: str = "missing", suffix: str = "_known") -> SQLTransformer:
    """Give unseen values the placeholder's code where the training rows contain the placeholder."""
    columns = {}
    for name, labels in zip(model.getOutputCols(), model.labelsArray):
        code = labels.index(placeholder) if placeholder in labels else len(labels)
        columns[f"{name}{suffix}"] = f"CASE WHEN `{name}` >= {len(labels)} THEN {float(code)!r}D ELSE `{name}` END"
    return _sql_stage(columns)


def fit_one_hot(train: DataFrame, columns: Sequence[str], suffix: str = "_vec"):
    """One slot per known code. The indexer's extra code for unseen values is the dropped
    last slot, so those rows get all zeros."""
    return OneHotEncoder(inputCols=list(columns), outputCols=[f"{c}{suffix}" for c in columns], dropLast=True).fit(train)


def fit_scaler(train: DataFrame, columns: Sequence[str], suffix: str = "_std") -> SQLTransformer:
    """Subtract the mean and divide by the population standard deviation (1 if that is 0)."""
    measures = by_column(train, columns).groupBy("place").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("spread"))
    found = {r["place"]: (r["mean"], r["spread"]) for r in measures.collect()}
    stage = {}
    for i, c in enumerate(columns):
        mean, spread = found.get(i, (None, None))
        mean, spread = mean or 0.0, spread or 1.0
        stage[f"{c}{suffix}"] = f"(cast(`{c}` as double) - {mean!r}D) / {spread!r}D"
    return _sql_stage(stage)


def plain_numbers(columns: Sequence[str], suffix: str = "_num") -> SQLTransformer:
    """Copies without category metadata, so that a tree treats codes as numbers."""
    return _sql_stage({f"{c}{suffix}": f"cast(`{c}` as double) + 0D" for c in columns})


def fit_bins(train: DataFrame, columns: Sequence[str], bins: int, suffix: str = "_bin") -> Bucketizer:
    """Each column's values dealt to so many bins of about equal numbers of training rows; not-a-number has a bin of its own."""
    return QuantileDiscretizer(
        inputCols=list(columns), outputCols=[f"{c}{suffix}" for c in columns], numBuckets=bins, relativeError=0.001, handleInvalid="keep").fit(train)


def assembler(columns: Sequence[str], output: str = "features") -> VectorAssembler:
    return VectorAssembler(inputCols=list(columns), outputCol=output)
