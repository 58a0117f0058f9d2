"""Cost-aware delay classifiers on Spark ML."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skylag import fixed_values as fixed
from skylag.models import prep
from skylag.operators.filters import without_columns_named_like
from skylag.operators.quality import by_column, leakage_columns, time_travel_columns
from skylag.schemas import numeric_columns, text_columns
from skylag.session import ensure_checkpoint_dir, materialized


def check_features(features: Sequence[str], allow: Sequence[str] = ()) -> None:
    """Refuse features whose name says they are known only after departure."""
    suspects = set(leakage_columns(features)) | set(time_travel_columns(features))
    refused = sorted(suspects - set(allow))
    if refused:
        raise ValueError(f"leaking features: {', '.join(refused)}; list them in `allow` if they are known in advance")


def safe_features(df: DataFrame, target: str = "DepDel15", allow: Sequence[str] = ()) -> tuple[list[str], list[str]]:
    """Numeric and text columns a trainer may use."""
    kept = without_columns_named_like(df.drop(target), fixed.TRAINING_EXCLUSIONS)
    suspects = set(leakage_columns(kept.columns)) | set(time_travel_columns(kept.columns))
    usable = kept.drop(*(suspects - set(allow)))
    return numeric_columns(usable), text_columns(usable)


def _prepared(train: DataFrame, numeric: Sequence[str], categorical: Sequence[str], target: str, weighting: str | None, miss_cost: float) -> DataFrame:
    """Label, weight and features of the training rows, written once: every fit reads only these."""
    rows = _weighted(prep.labelled(train, target), target, weighting, miss_cost)
    return materialized(rows.select(target, "weight", *dict.fromkeys([*numeric, *categorical])), "training-rows")


class _Steps:
    """Fitted stages and the training rows as the last of them left them."""

    def __init__(self, train: DataFrame):
        self.rows = train
        self.stages: list[Transformer] = []

    def add(self, stage: Transformer) -> None:
        self.stages.append(stage)
        self.rows = stage.transform(self.rows)


def _weighted(train: DataFrame, target: str, weighting: str | None, miss_cost: float) -> DataFrame:
    if weighting == "balanced":
        return prep.balanced_weights(train, target)
    if weighting == "cost":
        return prep.cost_weights(train, target, miss_cost)
    if weighting is None:
        return train.withColumn("weight", F.lit(1.0))
    raise ValueError("weighting must be 'balanced', 'cost' or None")


def fit_logistic(
    train: DataFrame,
    numeric: Sequence[str],
    categorical: Sequence[str],
    target: str = "DepDel15",
    weighting: str | None = None,
    miss_cost: float = 5.0,
    max_iter: int = 1000,
    inverse_regularization: float = 1.0,
    allow: Sequence[str] = (),
    hashed: Sequence[str] = (),
    slots: int = 4096,
) -> PipelineModel:
    """Median and placeholder imputation, one-hot, standard scaling, L2 logistic regression.

    The vocabularies of `categorical` columns pass through the driver; `hashed` ones are text
    without a bound, whose values share a fixed number of slots.
    """
    check_features([*numeric, *categorical, *hashed], allow)
    rows = _prepared(train, numeric, [*categorical, *hashed], target, weighting, miss_cost)
    steps = _Steps(rows)
    vectors: list[str] = []
    if numeric:
        steps.add(prep.fit_median_imputer(steps.rows, numeric))
        imputed = [f"{c}_imp" for c in numeric]
        steps.add(prep.fit_scaler(steps.rows, imputed))
        vectors += [f"{c}_std" for c in imputed]
    if categorical:
        steps.add(prep.category_filler(categorical, "missing"))
        indexer = prep.fit_indexer(steps.rows, [f"{c}_cat" for c in categorical])
        steps.add(indexer)
        encoder = prep.fit_one_hot(steps.rows, indexer.getOutputCols())
        # Unseen values are recoded after the encoder learned the training codes.
        recode = prep.unseen_as_missing(indexer)
        steps.add(recode)
        recoded = [f"{c}_known" for c in indexer.getOutputCols()]
        steps.add(encoder.setInputCols(recoded))
        vectors += encoder.getOutputCols()
    if hashed:
        steps.add(prep.category_filler(hashed, "missing", "_text"))
        steps.add(prep.hasher([f"{c}_text" for c in hashed], slots))
        vectors.append("hashed")
    steps.add(prep.assembler(vectors))
    total_weight = rows.agg(F.sum("weight")).first()[0]
    learner = LogisticRegression(
        featuresCol="features",
        labelCol=target,
        weightCol="weight",
        maxIter=max_iter,
        regParam=1.0 / (inverse_regularization * total_weight),
        elasticNetParam=0.0,
        standardization=False,
    )
    steps.add(learner.fit(steps.rows))
    return PipelineModel(steps.stages)


TREE_BINS = 32  # what the tree learner cuts a number into, as it does by default


def _mergeable(rows: DataFrame, inputs: Sequence[str]) -> list[str] | None:
    """The inputs of more than TREE_BINS values if rows that are equal, these inputs cut into bins, are at most half of all; else None.

    A tree sees a number only by its bin. Every pass of the learner then reads the merged rows,
    whose number is bounded by the values and not by the rows. Two scans of approximate counts decide.
    """
    if not inputs:
        return None
    counts = by_column(rows, inputs).groupBy("place").agg(F.count(F.lit(1)).alias("rows"), F.approx_count_distinct("value", 0.02).alias("n")).collect()
    total = max((r["rows"] for r in counts), default=0)
    wide = [inputs[i] for i in sorted(r["place"] for r in counts if r["n"] > TREE_BINS)]
    most = 2 * TREE_BINS ** len(wide)  # merged rows for each combination of the other inputs, with the label
    if 2 * most > total:
        return None
    narrow = [c for c in inputs if c not in wide]
    cells = rows.agg(F.approx_count_distinct(F.xxhash64(*narrow), 0.02)).first()[0] if narrow else 1
    return wide if 2 * cells * most <= total else None


def fit_boosted_trees(
    train: DataFrame,
    numeric: Sequence[str],
    categorical: Sequence[str],
    target: str = "DepDel15",
    weighting: str | None = "balanced",
    miss_cost: float = 5.0,
    rounds: int = 100,
    seed: int = 42,
    allow: Sequence[str] = (),
    depth: int = 5,
    hashed: Sequence[str] = (),
    slots: int = 1024,
) -> PipelineModel:
    """Median and placeholder imputation, alphabetical codes, gradient-boosted trees.

    Where equal rows are many, they are merged first, their weights added up; see `_mergeable`.

    `hashed` columns are text without a bound: their codes come from a hash, not from a vocabulary.
    """
    check_features([*numeric, *categorical, *hashed], allow)
    ensure_checkpoint_dir(train.sparkSession)
    steps = _Steps(_prepared(train, numeric, [*categorical, *hashed], target, weighting, miss_cost))
    inputs: list[str] = []
    if numeric:
        steps.add(prep.fit_median_imputer(steps.rows, numeric))
        inputs += [f"{c}_imp" for c in numeric]
    if categorical:
        steps.add(prep.category_filler(categorical, "Missing"))
        indexer = prep.fit_indexer(steps.rows, [f"{c}_cat" for c in categorical])
        steps.add(indexer)
        steps.add(prep.plain_numbers(indexer.getOutputCols()))
        inputs += [f"{c}_num" for c in indexer.getOutputCols()]
    if hashed:
        steps.add(prep.hash_codes(hashed, slots))
        inputs += [f"{c}_hash" for c in hashed]
    wide = _mergeable(steps.rows, inputs)
    if wide is not None:
        if wide:
            steps.add(prep.fit_bins(steps.rows, wide, TREE_BINS))
            inputs = [f"{c}_bin" if c in wide else c for c in inputs]
        merged = steps.rows.groupBy(target, *inputs).agg(F.sum("weight").alias("weight"))
        steps.rows = materialized(merged, "merged-rows")
    steps.add(prep.assembler(inputs))
    learner = GBTClassifier(
        featuresCol="features", labelCol=target, weightCol="weight", maxIter=rounds, maxDepth=depth, seed=seed, maxBins=TREE_BINS, checkpointInterval=10
    )
    steps.add(learner.fit(steps.rows))
    return PipelineModel(steps.stages)


def score(model: Transformer, df: DataFrame, target: str = "DepDel15") -> DataFrame:
    """Rows with a known target plus `label`, `prediction` and `score`, the probability of a delay."""
    scored = model.transform(prep.labelled(df, target))
    return scored.withColumns(
        {"label": F.col(target), "score": vector_to_array("probability")[1]}
    )


def converged(model: PipelineModel) -> bool:
    """Whether the logistic regression just fitted ended by its tolerance, below its limit of iterations."""
    learned = model.stages[-1]
    return learned.summary.totalIterations < learned.getMaxIter()


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
