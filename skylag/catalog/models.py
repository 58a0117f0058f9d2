"""Feature preparation, training and scoring."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from skylag.catalog import views
from skylag.catalog.causes_and_rates import FLAG_SQL
from skylag.catalog.registry import query
from skylag.catalog.views import FLIGHT_KEY, HASH_BITS, with_flights
from skylag.models import evaluate, prep, train
from skylag.operators.calendar import add_calendar_features
from skylag.operators.sampling import split_by_year, stratified_split
from skylag.session import scratch_path

no_origin = partial(views.flights, with_origin=False)
KEY = ", ".join(FLIGHT_KEY)
TRAIN_YEARS, VALIDATION_YEARS, TEST_YEARS = (1995, 1996, 1997, 1998), (1999,), (2000, 2001)
NUMERIC = ["dep_hour", "Month", "DayOfWeek", "Distance", "is_weekend", "is_peak_hour"]
CATEGORICAL = ["Marketing_Airline_Network", "Dest", "time_of_day"]

query("m01_labelled", with_flights("SELECT CAST(DepDel15 AS INTEGER) AS DepDel15, count(*) AS n FROM flights_v WHERE DepDel15 IS NOT NULL GROUP BY 1"))(
    lambda spark, sf: prep.labelled(no_origin(spark, sf)).groupBy("DepDel15").agg(F.count(F.lit(1)).alias("n")))


@query("m02_median_imputation", with_flights(
    f"SELECT {KEY}, coalesce(ArrDelay, (SELECT median(ArrDelay) FROM flights_v WHERE Year <= 1998)) AS ArrDelay_imp, "
    "coalesce(DepTime, (SELECT median(DepTime) FROM flights_v WHERE Year <= 1998)) AS DepTime_imp FROM flights_v"))
def _imputed(spark, sf):
    df = no_origin(spark, sf)
    stage = prep.fit_median_imputer(df.filter("Year <= 1998"), ["ArrDelay", "DepTime"])
    return stage.transform(df).select(*FLIGHT_KEY, "ArrDelay_imp", "DepTime_imp")


query("m03_category_placeholder", with_flights("SELECT coalesce(Tail_Number, 'Missing') AS Tail_Number_cat, count(*) AS n FROM flights_v GROUP BY 1"))(
    lambda spark, sf: prep.category_filler(["Tail_Number"], "Missing").transform(no_origin(spark, sf))
    .groupBy("Tail_Number_cat").agg(F.count(F.lit(1)).alias("n")))

SLOT = "Dest || '@' || CAST(CRSDepTime AS VARCHAR)"


@query("m04_j14_unseen_to_missing", with_flights(
    f"SELECT CASE WHEN {SLOT} IN (SELECT {SLOT} FROM flights_v WHERE Year <= 1998) THEN {SLOT} ELSE 'missing' END AS slot, count(*) AS n "
    "FROM flights_v WHERE Year > 1998 GROUP BY 1"))
def _known_slots(spark, sf):
    df = no_origin(spark, sf).select("Year", F.concat("Dest", F.lit("@"), F.col("CRSDepTime").cast("string")).alias("slot"))
    return prep.known_or_missing(df.filter("Year > 1998"), df.filter("Year <= 1998"), "slot").groupBy("slot").agg(F.count(F.lit(1)).alias("n"))


@query("m05_label_codes", with_flights(
    "SELECT Dest, Marketing_Airline_Network, CAST(dense_rank() OVER (ORDER BY Dest) - 1 AS DOUBLE) AS Dest_idx, "
    "CAST(dense_rank() OVER (ORDER BY Marketing_Airline_Network) - 1 AS DOUBLE) AS Marketing_Airline_Network_idx, count(*) AS n "
    "FROM flights_v GROUP BY Dest, Marketing_Airline_Network"))
def _codes(spark, sf):
    df = no_origin(spark, sf)
    columns = ["Dest", "Marketing_Airline_Network"]
    coded = df.select(*columns)
    for c in columns:
        coded = prep.encode(coded, prep.label_codes(df, c), c)
    return coded.groupBy(*columns, *[f"{c}_idx" for c in columns]).agg(F.count(F.lit(1)).alias("n"))


@query("m05_codes_of_unbounded_text", with_flights(
    "SELECT Tail_Number, CAST(coalesce(code, (SELECT count(*) FROM codes)) AS DOUBLE) AS Tail_Number_idx, count(*) AS n "
    "FROM flights_v LEFT JOIN codes USING (Tail_Number) WHERE Year > 1998 GROUP BY ALL",
    "codes AS (SELECT Tail_Number, row_number() OVER (ORDER BY Tail_Number) - 1 AS code FROM "
    "(SELECT DISTINCT Tail_Number FROM flights_v WHERE Year <= 1998 AND DepDel15 = 1 AND Tail_Number IS NOT NULL))"))
def _tail_codes(spark, sf):
    """Codes of the tails that were late in the early years, for the later ones: unseen and unknown ones share a code."""
    df = no_origin(spark, sf)
    codes = prep.label_codes(df.filter("Year <= 1998 AND DepDel15 = 1"), "Tail_Number")
    return prep.encode(df.filter("Year > 1998").select("Tail_Number"), codes, "Tail_Number").groupBy("Tail_Number", "Tail_Number_idx").agg(F.count(F.lit(1)).alias("n"))


@query("m06_one_hot", with_flights(
    "SELECT Marketing_Airline_Network, CAST(dense_rank() OVER (ORDER BY Marketing_Airline_Network) - 1 AS INTEGER) AS hot_slot, "
    "CAST(count(*) OVER () AS INTEGER) AS slots, n FROM (SELECT Marketing_Airline_Network, count(*) AS n FROM flights_v GROUP BY 1)"))
def _hot_slots(spark, sf):
    from pyspark.ml.functions import vector_to_array

    df = no_origin(spark, sf).select("Marketing_Airline_Network")
    indexed = prep.encode(df, prep.label_codes(df, "Marketing_Airline_Network"), "Marketing_Airline_Network")
    encoded = prep.fit_one_hot_codes(indexed, ["Marketing_Airline_Network_idx"]).transform(indexed)
    slots = vector_to_array("Marketing_Airline_Network_idx_vec")
    return encoded.groupBy(
        "Marketing_Airline_Network",
        (F.array_position(slots, F.lit(1.0)) - 1).cast("int").alias("hot_slot"),
        F.size(slots).alias("slots"),
    ).agg(F.count(F.lit(1)).alias("n"))


@query("m07_m08_standard_scaling", with_flights(
    f"SELECT {KEY}, round((Distance - avg(Distance) OVER ()) / stddev_pop(Distance) OVER (), 6) AS Distance_std, "
    "round((CRSDepTime - avg(CRSDepTime) OVER ()) / stddev_pop(CRSDepTime) OVER (), 6) AS CRSDepTime_std FROM flights_v"))
def _scaled(spark, sf):
    from pyspark.ml.functions import vector_to_array

    df = no_origin(spark, sf)
    columns = ["Distance", "CRSDepTime"]
    scaled = prep.fit_scaler(df, columns).transform(df)
    vector = vector_to_array("features")
    return prep.assembler([f"{c}_std" for c in columns]).transform(scaled).select(
        *FLIGHT_KEY, *[vector[i].alias(f"{c}_std") for i, c in enumerate(columns)])


query("m11_balanced_weights", with_flights(
    "SELECT DepDel15, round(sum(n) OVER () / (2 * n), 6) AS weight, n FROM ("
    "SELECT CAST(DepDel15 AS INTEGER) AS DepDel15, CAST(count(*) AS BIGINT) AS n FROM flights_v WHERE DepDel15 IS NOT NULL GROUP BY 1)"))(
    lambda spark, sf: prep.balanced_weights(prep.labelled(no_origin(spark, sf))).groupBy("DepDel15", "weight").agg(F.count(F.lit(1)).alias("n")))


def _hash_scored(spark, sf):
    return no_origin(spark, sf).filter("DepDel15 IS NOT NULL").select(
        F.col("DepDel15").alias("label"), "score", (F.col("score") >= 0.5).cast("double").alias("prediction"))


def _risk_scored(spark, sf):
    """Scores that say something: later delays with some noise, in steps of a thousandth."""
    noisy = (F.col("row_hash") % 400 + F.when(F.col("DepDel15") == 1, 300).otherwise(0)) / 1000
    return no_origin(spark, sf).filter("DepDel15 IS NOT NULL").select(F.col("DepDel15").alias("label"), noisy.alias("score"))


RISK_SQL = "scored AS (SELECT DepDel15 AS label, (row_hash % 400 + CASE WHEN DepDel15 = 1 THEN 300 ELSE 0 END) / CAST(1000 AS DOUBLE) AS score FROM flights_v WHERE DepDel15 IS NOT NULL)"
SCORED_SQL = "scored AS (SELECT DepDel15 AS label, score, CAST(score >= 0.5 AS DOUBLE) AS prediction FROM flights_v WHERE DepDel15 IS NOT NULL)"
CONFUSION_SQL = (
    "counts AS (SELECT count(*) FILTER (label = 1 AND prediction = 1) AS tp, count(*) FILTER (label = 0 AND prediction = 1) AS fp, "
    "count(*) FILTER (label = 1 AND prediction = 0) AS fn, count(*) FILTER (label = 0 AND prediction = 0) AS tn FROM scored)"
)
query("m13_class_metrics", with_flights(
    "SELECT round((tp + tn) / CAST(tp + fp + fn + tn AS DOUBLE), 6) AS accuracy, round(tp / CAST(tp + fp AS DOUBLE), 6) AS precision, "
    "round(tp / CAST(tp + fn AS DOUBLE), 6) AS recall, round(2 * tp / CAST(2 * tp + fp + fn AS DOUBLE), 6) AS f1 FROM counts", SCORED_SQL, CONFUSION_SQL))(
    lambda spark, sf: evaluate.class_metrics(evaluate.confusion(_hash_scored(spark, sf))))
query("m14_roc_auc", with_flights(
    "SELECT round(sum(pos * (below + neg / 2.0::DOUBLE)) / (CAST(sum(pos) AS DOUBLE) * CAST(sum(neg) AS DOUBLE)), 6) AS auc FROM ("
    "SELECT *, coalesce(sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM ("
    "SELECT score, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg FROM scored GROUP BY 1))", SCORED_SQL))(
    lambda spark, sf: evaluate.roc_auc(_hash_scored(spark, sf)))
POINTS_SQL = (
    "points AS (SELECT score AS threshold, sum(neg) OVER w / CAST(sum(neg) OVER () AS DOUBLE) AS fpr, "
    "sum(pos) OVER w / CAST(sum(pos) OVER () AS DOUBLE) AS tpr, pos, neg, row_number() OVER w AS i, count(*) OVER () AS k, "
    "lead(pos) OVER w AS next_pos, lead(neg) OVER w AS next_neg FROM ("
    "SELECT score, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg FROM scored GROUP BY 1) WINDOW w AS (ORDER BY score DESC))"
)
_START = "SELECT CAST('infinity' AS DOUBLE) AS threshold, CAST(0 AS DOUBLE) AS fpr, CAST(0 AS DOUBLE) AS tpr UNION ALL "
query("m15_roc_curve", with_flights(
    _START + "SELECT threshold, round(fpr, 6), round(tpr, 6) FROM points", SCORED_SQL, POINTS_SQL))(
    lambda spark, sf: evaluate.roc_curve(_hash_scored(spark, sf), drop_collinear=False))
query("m15_roc_curve_without_collinear", with_flights(
    _START + "SELECT threshold, round(fpr, 6), round(tpr, 6) FROM points WHERE i = 1 OR i = k OR pos <> next_pos OR neg <> next_neg",
    SCORED_SQL, POINTS_SQL))(
    lambda spark, sf: evaluate.roc_curve(_hash_scored(spark, sf)))
query("m18_m19_cost", with_flights(
    "SELECT CAST(5 * fn + fp AS DOUBLE) AS total_cost, CAST(5 * (tp + fn) AS DOUBLE) AS zero_rule_cost, "
    "round((1 - (5 * fn + fp) / CAST(5 * (tp + fn) AS DOUBLE)) * 100, 6) AS cost_reduction_pct FROM counts", SCORED_SQL, CONFUSION_SQL))(
    lambda spark, sf: evaluate.total_cost(evaluate.confusion(_hash_scored(spark, sf))))
query("m18_operating_point", with_flights(
    "SELECT threshold, cost AS total_cost, zero_rule_cost, round((1 - cost / zero_rule_cost) * 100, 6) AS cost_reduction_pct FROM costs "
    "ORDER BY cost, threshold DESC LIMIT 1", RISK_SQL,
    "ends AS (SELECT CAST(count(*) FILTER (label = 1) AS DOUBLE) * 5 AS zero_rule_cost FROM scored)",
    "costs AS (SELECT threshold, CAST(5 * count(*) FILTER (label = 1 AND score < threshold) + count(*) FILTER (label = 0 AND score >= threshold) AS DOUBLE) AS cost, zero_rule_cost "
    "FROM scored, (SELECT DISTINCT score AS threshold FROM scored UNION ALL SELECT CAST('infinity' AS DOUBLE)), ends GROUP BY threshold, zero_rule_cost)"))(
    lambda spark, sf: evaluate.operating_point(_risk_scored(spark, sf)))
query("m18_cost_weights", with_flights(
    "SELECT CAST(DepDel15 AS INTEGER) AS DepDel15, CAST(CASE WHEN DepDel15 = 1 THEN 5 ELSE 1 END AS DOUBLE) AS weight, count(*) AS n "
    "FROM flights_v WHERE DepDel15 IS NOT NULL GROUP BY ALL"))(
    lambda spark, sf: prep.cost_weights(prep.labelled(no_origin(spark, sf))).groupBy("DepDel15", "weight").agg(F.count(F.lit(1)).alias("n")))


def _training_rows(spark, sf):
    return add_calendar_features(no_origin(spark, sf))


# Next to no regularization: the probability of a class is its weighted share, whatever learns it.
_LOGISTIC_SQL = (
    "rates AS (SELECT Marketing_Airline_Network, count(*) AS n, count(*) FILTER (DepDel15 = 1) AS pos, count(*) FILTER (DepDel15 = 0) AS neg "
    "FROM flights_v WHERE DepDel15 IS NOT NULL GROUP BY 1)",
    "scores AS (SELECT *, 5 * pos / CAST(5 * pos + neg AS DOUBLE) AS p FROM rates)",
)


def _airline_scores(spark, sf):
    rows = prep.labelled(no_origin(spark, sf))
    model = train.fit_logistic(rows, [], ["Marketing_Airline_Network"], weighting="cost", inverse_regularization=1e12)
    return train.score(model, rows)


query("m09_m12_logistic_scores", with_flights(
    "SELECT Marketing_Airline_Network, n, round(p, 3) AS score, CAST(p > 0.5 AS DOUBLE) AS prediction FROM scores", *_LOGISTIC_SQL), digits=3)(
    lambda spark, sf: _airline_scores(spark, sf).groupBy("Marketing_Airline_Network").agg(
        F.count(F.lit(1)).alias("n"), F.max("score").alias("score"), F.max("prediction").alias("prediction")))
query("m16_logistic_metrics_table", with_flights(
    "SELECT 'All' AS part, round((tp + tn) / CAST(tp + fp + fn + tn AS DOUBLE), 6) AS accuracy, round(coalesce(tp / nullif(CAST(tp + fp AS DOUBLE), 0), 0), 6) AS precision, "
    "round(coalesce(tp / nullif(CAST(tp + fn AS DOUBLE), 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(CAST(2 * tp + fp + fn AS DOUBLE), 0), 0), 6) AS f1, round(auc, 6) AS auc "
    "FROM totals, area", *_LOGISTIC_SQL,
    "totals AS (SELECT coalesce(sum(pos) FILTER (p > 0.5), 0) AS tp, coalesce(sum(neg) FILTER (p > 0.5), 0) AS fp, "
    "coalesce(sum(pos) FILTER (p <= 0.5), 0) AS fn, coalesce(sum(neg) FILTER (p <= 0.5), 0) AS tn FROM scores)",
    "area AS (SELECT sum(pos * (below + neg / 2.0::DOUBLE)) / (CAST(sum(pos) AS DOUBLE) * CAST(sum(neg) AS DOUBLE)) AS auc FROM ("
    "SELECT *, coalesce(sum(neg) OVER (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM scores))"))(
    lambda spark, sf: evaluate.metrics_table({"All": _airline_scores(spark, sf)}))

# On one 0/1 feature every tree is one mean per value: the first of the labels -1 and 1, each
# later one of the residuals, added at a tenth.
_BOOSTED_SQL = (
    f"flagged AS (SELECT {FLAG_SQL['is_weekend']} AS is_weekend, DepDel15 FROM flights_v WHERE DepDel15 IS NOT NULL)",
    "sides AS (SELECT is_weekend, count(*) AS n, count(*) FILTER (DepDel15 = 1) AS pos, count(*) FILTER (DepDel15 = 0) AS neg FROM flagged GROUP BY 1)",
    "shares AS (SELECT is_weekend, n, (pos / a) / (pos / a + neg / b) AS p FROM sides, (SELECT CAST(sum(pos) AS DOUBLE) AS a, CAST(sum(neg) AS DOUBLE) AS b FROM sides))",
    "steps AS (SELECT is_weekend, n, p, 1 AS tree, 2 * p - 1 AS f FROM shares UNION ALL "
    "SELECT is_weekend, n, p, tree + 1, f + 0.1::DOUBLE * (p * 4 / (1 + exp(2 * f)) - (1 - p) * 4 / (1 + exp(-2 * f))) FROM steps WHERE tree < 100)",
)


@query("m10_m17_boosted_trees_scores", "WITH RECURSIVE " + with_flights(
    "SELECT is_weekend, n, round(1 / (1 + exp(-2 * f)), 6) AS score, CAST(f > 0 AS DOUBLE) AS prediction FROM steps WHERE tree = 100", *_BOOSTED_SQL).removeprefix("WITH "))
def _boosted_scores(spark, sf):
    """100 rounds with balanced weights, saved and loaded again."""
    rows = prep.labelled(_training_rows(spark, sf))
    model = train.fit_boosted_trees(rows, ["is_weekend"], [])
    path = scratch_path(spark, "boosted-trees")
    train.save_model(model, path)
    scored = train.score(train.load_model(path), rows)
    return scored.groupBy("is_weekend").agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("score"), F.max("prediction").alias("prediction"))


# Depth 1 over two 0/1 features: every round each feature's split is judged by the weighted sums
# of its sides, and the better one adds its two means at a tenth. Weights balance the classes.
_STUMPS_SQL = (
    f"flagged AS (SELECT {FLAG_SQL['is_weekend']} AS a, CASE WHEN CRSDepTime // 100 BETWEEN 7 AND 9 OR CRSDepTime // 100 BETWEEN 17 AND 19 THEN 1 ELSE 0 END AS b, DepDel15 FROM flights_v WHERE DepDel15 IS NOT NULL)",
    "cells AS (SELECT a, b, count(*) AS n, CAST(count(*) FILTER (DepDel15 = 1) AS DOUBLE) AS pos, CAST(count(*) FILTER (DepDel15 = 0) AS DOUBLE) AS neg FROM flagged GROUP BY ALL)",
    "weighed AS (SELECT a, b, n, pos / sum(pos) OVER () AS p, neg / sum(neg) OVER () AS q FROM cells)",
    "steps AS (SELECT a, b, n, p, q, 0 AS tree, CAST(0 AS DOUBLE) AS f FROM weighed UNION ALL "
    "SELECT a, b, n, p, q, tree + 1, f + CASE WHEN tree = 0 THEN 1 ELSE 0.1::DOUBLE END * CASE WHEN gain_a >= gain_b THEN sa / wa ELSE sb / wb END FROM ("
    "SELECT *, sum(sa * s / wa) OVER () AS gain_a, sum(sb * s / wb) OVER () AS gain_b FROM ("
    "SELECT *, sum(s) OVER (PARTITION BY a) AS sa, sum(p + q) OVER (PARTITION BY a) AS wa, sum(s) OVER (PARTITION BY b) AS sb, sum(p + q) OVER (PARTITION BY b) AS wb FROM ("
    "SELECT *, CASE WHEN tree = 0 THEN p - q ELSE p * 4 / (1 + exp(2 * f)) - q * 4 / (1 + exp(-2 * f)) END AS s FROM steps WHERE tree < 100))))",
)


@query("m10_boosted_stumps_on_two_features", "WITH RECURSIVE " + with_flights(
    "SELECT a AS is_weekend, b AS is_peak_hour, n, round(1 / (1 + exp(-2 * f)), 6) AS score, CAST(f > 0 AS DOUBLE) AS prediction FROM steps WHERE tree = 100", *_STUMPS_SQL).removeprefix("WITH "))
def _stumps(spark, sf):
    """100 rounds of trees of one split, balanced weights."""
    rows = prep.labelled(_training_rows(spark, sf))
    scored = train.score(train.fit_boosted_trees(rows, ["is_weekend", "is_peak_hour"], [], depth=1), rows)
    return scored.groupBy("is_weekend", "is_peak_hour").agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("score"), F.max("prediction").alias("prediction"))


@query("m09_m12_m16_logistic_metrics")
def _logistic(spark, sf):
    """Trained on the early years with the cost weights, scored on the later ones."""
    parts = split_by_year(_training_rows(spark, sf), TRAIN_YEARS, VALIDATION_YEARS, TEST_YEARS)
    model = train.fit_logistic(parts.filter("split = 'train'"), NUMERIC, CATEGORICAL, weighting="cost")
    scored = {name: train.score(model, parts.filter(F.col("split") == name.lower())) for name in ("Validation", "Test")}
    return evaluate.metrics_table(scored)


@query("m10_m17_boosted_trees_metrics")
def _boosted(spark, sf):
    """Trained on the stratified split with balanced weights, saved, loaded and scored on the rest."""
    rows = prep.labelled(_training_rows(spark, sf))
    parts = stratified_split(rows, "DepDel15", FLIGHT_KEY, rank_by="row_hash", rank_bits=HASH_BITS)
    model = train.fit_boosted_trees(parts.filter("split = 'train'"), NUMERIC, CATEGORICAL)
    path = scratch_path(spark, "boosted-trees")
    train.save_model(model, path)
    return evaluate.metrics_table({"Test": train.score(train.load_model(path), parts.filter("split = 'test'"))})
