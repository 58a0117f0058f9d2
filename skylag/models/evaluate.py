"""Scores of a binary classifier: confusion counts, ROC, cost."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skylag.functions.numeric import ratio, ratio_or_zero
from skylag.operators.ordered import previous_value, range_bucketed, running_totals


def confusion(scored: DataFrame, label: str = "label", prediction: str = "prediction", copies: str | None = None, **more: Column) -> DataFrame:
    """tp, fp, fn and tn in one row, and `more` measures of the same pass; a row counts as often as its column `copies` says."""
    actual, guess = F.col(label) == 1, F.col(prediction) == 1
    return scored.agg(
        count_rows(actual & guess, copies).alias("tp"),
        count_rows(~actual & guess, copies).alias("fp"),
        count_rows(actual & ~guess, copies).alias("fn"),
        count_rows(~actual & ~guess, copies).alias("tn"),
        *[measure.alias(name) for name, measure in more.items()],
    )


def count_rows(condition: Column, copies: str | None = None) -> Column:
    """How many rows fulfil the condition, each counted as often as its column `copies` says."""
    if copies is None:
        return F.count_if(condition)
    return F.coalesce(F.sum(F.when(condition, F.col(copies))), F.lit(0))


def class_metrics(counts: DataFrame) -> DataFrame:
    """Accuracy and the positive class's precision, recall and F1; 0 where undefined."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counts.select(
        ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"),
        ratio_or_zero(tp, tp + fp).alias("precision"),
        ratio_or_zero(tp, tp + fn).alias("recall"),
        ratio_or_zero(tp * 2, tp * 2 + fp + fn).alias("f1"),
    )


def _score_counts(scored: DataFrame, label: str, score: str, prediction: str | None = None) -> DataFrame:
    """One row per distinct score (and prediction): its positives and negatives, and its range.

    Several passes follow; it is written once, so that the model scores each row once.
    """
    keys = [F.col(score).cast("double").alias("score"), *([F.col(prediction).cast("double").alias("prediction")] if prediction else [])]
    counts = scored.groupBy(*keys).agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))
    return range_bucketed(counts, ["score"])


def _ranked_scores(counts: DataFrame) -> DataFrame:
    """Score counts with the positives and negatives below each score, and all of them."""
    per_score = counts.groupBy("score", "__bucket").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    totals = counts.agg(F.struct(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))).scalar()
    return running_totals(per_score, "score", "__bucket", ["pos", "neg"]).withColumns(
        {"all_pos": totals.getField("pos"), "all_neg": totals.getField("neg")}
    )


def _auc(ranked: DataFrame) -> DataFrame:
    wins = F.col("pos") * (F.col("neg_before") + F.col("neg") / 2)
    return ranked.agg(
        ratio(F.sum(wins), F.max(F.col("all_pos").cast("double") * F.col("all_neg").cast("double"))).alias("auc")
    )


def roc_auc(scored: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """Area under the ROC curve: the chance that a positive outranks a negative, ties half."""
    return _auc(_ranked_scores(_score_counts(scored, label, score)))


def roc_curve(
    scored: DataFrame,
    label: str = "label",
    score: str = "score",
    drop_collinear: bool = True,
) -> DataFrame:
    """(threshold, fpr, tpr) per distinct score and the start (infinity, 0, 0).

    `drop_collinear` leaves out points on a straight line between their neighbours.
    """
    ranked = _ranked_scores(_score_counts(scored, label, score)).withColumn("__step", F.struct("pos", "neg"))
    if drop_collinear:
        stepped = previous_value(
            ranked.select("score", F.col("__bucket").alias("range"), "__step"), [], {"__range": F.col("range")}, ["score"], "__step", "__lower"
        )
        ranked = ranked.join(stepped.select("score", "__lower"), "score")
        first = (F.col("pos_before") + F.col("pos") == F.col("all_pos")) & (F.col("neg_before") + F.col("neg") == F.col("all_neg"))
        ranked = ranked.filter(first | F.col("__lower").isNull() | (F.col("__step") != F.col("__lower")))
    points = ranked.select(
        F.col("score").alias("threshold"),
        ratio(F.col("all_neg") - F.col("neg_before"), F.col("all_neg")).alias("fpr"),
        ratio(F.col("all_pos") - F.col("pos_before"), F.col("all_pos")).alias("tpr"),
    )
    start = scored.sparkSession.createDataFrame([(float("inf"), 0.0, 0.0)], "threshold double, fpr double, tpr double")
    return start.unionByName(points)


def total_cost(counts: DataFrame, miss_cost: float = 5.0, false_alarm_cost: float = 1.0) -> DataFrame:
    """Operating cost, the cost of never predicting a delay, and the percent saved against it."""
    cost = F.col("fn") * miss_cost + F.col("fp") * false_alarm_cost
    zero_rule = (F.col("tp") + F.col("fn")) * miss_cost
    return counts.select(
        cost.cast("double").alias("total_cost"),
        zero_rule.cast("double").alias("zero_rule_cost"),
        ((1 - ratio(cost, zero_rule)) * 100).alias("cost_reduction_pct"),
    )


def operating_point(scored: DataFrame, miss_cost: float = 5.0, false_alarm_cost: float = 1.0, label: str = "label", score: str = "score") -> DataFrame:
    """The threshold of least cost, ties to the larger: (threshold, total_cost, zero_rule_cost, cost_reduction_pct).

    A delay is predicted from the threshold on; infinity predicts none. Costs follow from the
    running totals of the distinct scores, so no task sorts them all. No rows, no threshold.
    """
    ranked = _ranked_scores(_score_counts(scored, label, score))
    cost = F.col("pos_before") * miss_cost + (F.col("all_neg") - F.col("neg_before")) * false_alarm_cost
    never = F.col("all_pos") * miss_cost
    choice = F.struct(cost.cast("double").alias("cost"), (-F.col("score")).alias("low"))
    best = ranked.agg(F.min(choice).alias("best"), F.max(never).cast("double").alias("zero_rule_cost")).filter("best IS NOT NULL")
    none = F.col("zero_rule_cost") <= F.col("best.cost")
    named = best.select(
        F.when(none, float("inf")).otherwise(-F.col("best.low")).alias("threshold"), F.least("best.cost", "zero_rule_cost").alias("total_cost"), "zero_rule_cost")
    return named.withColumn("cost_reduction_pct", (1 - ratio(F.col("total_cost"), F.col("zero_rule_cost"))) * 100)


def metrics_table(parts: Mapping[str, DataFrame], label: str = "label", prediction: str = "prediction", score: str = "score") -> DataFrame:
    """One row per named part with accuracy, precision, recall, F1 and AUC; the model scores each row once."""
    rows = []
    for name, scored in parts.items():
        counts = _score_counts(scored, label, score, prediction)
        guess = F.col("prediction") == 1
        sums = {
            "tp": F.sum(F.when(guess, F.col("pos"))), "fp": F.sum(F.when(guess, F.col("neg"))),
            "fn": F.sum(F.when(~guess, F.col("pos"))), "tn": F.sum(F.when(~guess, F.col("neg"))),
        }
        metrics = class_metrics(counts.agg(*[F.coalesce(v, F.lit(0)).alias(n) for n, v in sums.items()]))
        rows.append(metrics.select(F.lit(name).alias("part"), "*", _auc(_ranked_scores(counts)).scalar().alias("auc")))
    return reduce(DataFrame.unionByName, rows)
