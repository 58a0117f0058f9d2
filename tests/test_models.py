"""Feature preparation and classifiers."""

import glob
import math
import os
import random

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from skylag.models import evaluate, prep, train
from skylag.operators import quality
from skylag.session import shared_folder


def test_scaler_uses_population_deviation(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,)], "x double")
    got = [r["x_std"] for r in prep.fit_scaler(df, ["x"]).transform(df).orderBy("x").collect()]
    assert got == pytest.approx([(v - 7 / 3) / 1.2472191289 for v in (1, 2, 4)])


def test_scaler_of_constant(spark):
    df = spark.createDataFrame([(3.0,), (3.0,)], "x double")
    assert [r["x_std"] for r in prep.fit_scaler(df, ["x"]).transform(df).collect()] == [0.0, 0.0]


def test_imputer_uses_training_median(spark):
    fit = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (100.0,), (None,)], "x double")
    other = spark.createDataFrame([(None,), (9.0,)], "x double")
    assert {r["x_imp"] for r in prep.fit_median_imputer(fit, ["x"]).transform(other).collect()} == {3.0, 9.0}


def test_statistics_of_many_columns_are_one_small_expression(spark):
    """An expression for each column makes code that the JVM does not compile; laid out by column there is one for all."""
    rng = random.Random(4)
    rows = [[rng.choice([None, float("nan"), -0.0, float(rng.randrange(50)), rng.gauss(0, 1e4), 10.0**rng.randrange(-300, 300)]) for _ in range(60)] for _ in range(300)]
    names = [f"c {i}" for i in range(60)]
    df = spark.createDataFrame(rows, ", ".join(f"`{c}` double" for c in names))
    cells = quality._cells(df, names, [(i, -math.inf, math.inf, None) for i in range(60)])
    assert cells._jdf.queryExecution().executedPlan().toString().count("LOG1P") == 1
    found = quality.ranked_values(df, names, [0.25, 0.5, 0.75])
    for i, c in enumerate(names):
        known = sorted(r[i] for r in rows if r[i] is not None and r[i] == r[i])
        places = {f((len(known) - 1) * q) for q in (0.25, 0.5, 0.75) for f in (math.floor, math.ceil)}
        assert found[c] == (len(known), {k: known[k] for k in places})


def test_scaler_and_merging_read_values_by_column(spark):
    df = spark.createDataFrame([(i % 2, float(i % 40), None, 5.0) for i in range(800)], "a int, b double, c double, d double")
    got = prep.fit_scaler(df, ["a", "c", "b", "d"]).transform(df).select("a_std", "b_std", "c_std", "d_std").first()
    assert tuple(got) == (pytest.approx(-1.0), pytest.approx(-19.5 / ((40**2 - 1) / 12) ** 0.5), None, 0.0)
    assert train._mergeable(df, ["a", "b", "d"]) == ["b"] and train._mergeable(df, []) is None
    assert train._mergeable(df.limit(0), ["a", "b"]) is None


def test_one_hot_of_unseen_value_is_zero(spark):
    fit = spark.createDataFrame([("a",), ("b",)], "c string")
    indexer = prep.fit_indexer(fit, ["c"])
    encoder = prep.fit_one_hot(indexer.transform(fit), ["c_idx"])
    test = spark.createDataFrame([("a",), ("b",), ("zz",)], "c string")
    rows = encoder.transform(indexer.transform(test)).select("c", vector_to_array("c_idx_vec").alias("v")).collect()
    assert {r["c"]: r["v"] for r in rows} == {"a": [1.0, 0.0], "b": [0.0, 1.0], "zz": [0.0, 0.0]}


def test_unseen_value_takes_the_placeholder_code(spark):
    fit = spark.createDataFrame([("a",), ("missing",)], "c string")
    indexer = prep.fit_indexer(fit, ["c"])
    test = indexer.transform(spark.createDataFrame([("a",), ("zz",)], "c string"))
    assert {r["c"]: r["c_idx_known"] for r in prep.unseen_as_missing(indexer).transform(test).collect()} == {"a": 0.0, "zz": 1.0}


def test_known_or_missing(spark):
    fit = spark.createDataFrame([("a",), (None,)], "c string")
    got = prep.known_or_missing(spark.createDataFrame([("a",), ("b",), (None,)], "c string"), fit, "c")
    assert sorted(r["c"] for r in got.collect()) == ["a", "missing", "missing"]


def test_label_codes_are_alphabetical(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",)], "c string")
    assert {r["c"]: r["code"] for r in prep.label_codes(df, "c").collect()} == {"a": 0, "b": 1}


def test_balanced_weights(spark):
    df = spark.createDataFrame([(1,), (0,), (0,), (0,)], "DepDel15 int")
    assert {r["DepDel15"]: r["weight"] for r in prep.balanced_weights(df).collect()} == {1: 2.0, 0: pytest.approx(2 / 3)}


def test_metrics_and_cost(spark):
    counts = spark.createDataFrame([(4, 3, 2, 11)], "tp long, fp long, fn long, tn long")
    m = evaluate.class_metrics(counts).first()
    assert tuple(m) == pytest.approx((0.75, 4 / 7, 4 / 6, 8 / 13))
    assert tuple(evaluate.total_cost(counts).first()) == pytest.approx((13.0, 30.0, (1 - 13 / 30) * 100))
    none = spark.createDataFrame([(0, 0, 0, 5)], "tp long, fp long, fn long, tn long")
    assert tuple(evaluate.class_metrics(none).first()) == (1.0, 0.0, 0.0, 0.0)


@pytest.mark.parametrize("name", ["DepDelay", "ArrDel15", "CRSDepTime", "LateAircraftDelay", "origin_delay_rate_7d", "dest_wx"])
def test_trainers_refuse_leaking_features(name):
    with pytest.raises(ValueError, match=name):
        train.check_features(["Distance", name])
    train.check_features(["Distance", name], allow=[name])


def test_safe_features(spark):
    df = spark.createDataFrame([(1.0, 900, 5.0, "A", 2.0, 0.1)], "DepDel15 double, CRSDepTime int, CarrierDelay double, Origin string, Distance double, route_delay_rate_7d double")
    assert train.safe_features(df) == (["Distance"], ["Origin"])
    assert train.safe_features(df, allow=["route_delay_rate_7d"])[0] == ["Distance", "route_delay_rate_7d"]


@pytest.fixture(scope="module")
def learnable(spark):
    rng = random.Random(2)
    rows = []
    for i in range(1200):
        hub, distance = rng.choice(["A", "B", None]), rng.choice([None, rng.uniform(0, 1)])
        p = 0.15 + 0.5 * (hub == "A") + 0.3 * ((distance or 0.5) > 0.5)
        rows.append((i, float(rng.random() < p) if i % 50 else None, hub, distance))
    return spark.createDataFrame(rows, "id int, DepDel15 double, Origin string, Distance double").cache()


@pytest.mark.parametrize("weighting", [None, "balanced", "cost"])
def test_logistic_learns(spark, learnable, weighting):
    fit, rest = learnable.filter("id < 800"), learnable.filter("id >= 800")
    model = train.fit_logistic(fit, ["Distance"], ["Origin"], weighting=weighting)
    unseen = rest.withColumn("Origin", F.when(F.col("id") % 100 == 0, "new").otherwise(F.col("Origin")))
    metrics = evaluate.metrics_table({"Test": train.score(model, unseen)}).first()
    assert metrics["auc"] > 0.7


def test_cost_weighting_raises_recall(spark, learnable):
    plain, costed = (train.score(train.fit_logistic(learnable, ["Distance"], ["Origin"], weighting=w), learnable) for w in (None, "cost"))
    recall = [evaluate.class_metrics(evaluate.confusion(s)).first()["recall"] for s in (plain, costed)]
    assert recall[1] > recall[0]
    cost = [evaluate.total_cost(evaluate.confusion(s)).first()["total_cost"] for s in (plain, costed)]
    assert cost[1] < cost[0]


def test_boosted_trees_learn_and_reload(spark, learnable, tmp_path):
    model = train.fit_boosted_trees(learnable.filter("id < 800"), ["Distance"], ["Origin"], rounds=5)
    rest = learnable.filter("id >= 800")
    scored = train.score(model, rest)
    assert evaluate.roc_auc(scored).first()["auc"] > 0.7
    train.save_model(model, str(tmp_path / "model"))
    again = train.score(train.load_model(str(tmp_path / "model")), rest)
    key = ["id", "prediction"]
    assert sorted(map(tuple, scored.select(key).collect())) == sorted(map(tuple, again.select(key).collect()))


def test_unknown_weighting_is_refused(spark, learnable):
    with pytest.raises(ValueError):
        train.fit_logistic(learnable, ["Distance"], [], weighting="other")


def merged_rows(spark):
    """What the last fit merged its rows to."""
    folders = glob.glob(os.path.join(shared_folder(spark), "merged-rows-*"))
    return spark.read.parquet(max(folders, key=os.path.getmtime)).collect() if folders else []


def test_equal_rows_are_merged_before_trees(spark):
    rng = random.Random(9)
    rows = [(i, rng.randrange(2), rng.choice(["a", "b"])) for i in range(400)]
    late = {(0, "a"): 0.2, (0, "b"): 0.4, (1, "a"): 0.6, (1, "b"): 0.9}
    df = spark.createDataFrame([(*r, int(rng.random() < late[r[1:]])) for r in rows], "id int, x int, c string, DepDel15 int")
    model = train.fit_boosted_trees(df, ["x"], ["c"], rounds=5)
    merged = merged_rows(spark)
    assert len(merged) == 8 and sum(r["weight"] for r in merged) == pytest.approx(400)
    kept = train._mergeable
    train._mergeable = lambda *_: None
    try:
        plain = train.fit_boosted_trees(df, ["x"], ["c"], rounds=5)
    finally:
        train._mergeable = kept
    scores = [{(r["x"], r["c"]): r["score"] for r in train.score(m, df).select("x", "c", "score").collect()} for m in (model, plain)]
    assert scores[0] == pytest.approx(scores[1])


def test_wide_numbers_are_merged_by_bins(spark):
    rng = random.Random(2)
    df = spark.createDataFrame([(float(v), int(v + rng.randrange(400) > 700)) for v in (rng.randrange(1000) for _ in range(3000))], "v double, DepDel15 int")
    model = train.fit_boosted_trees(df, ["v"], [], rounds=5)
    merged = merged_rows(spark)
    assert 32 <= len(merged) <= 64 and {r["DepDel15"] for r in merged} == {0, 1}
    scored = train.score(model, df)
    assert evaluate.roc_auc(scored).first()["auc"] > 0.9


def test_rows_that_hardly_repeat_are_not_merged(spark):
    rows = spark.createDataFrame([(i / 7, i % 3, i % 50, 1) for i in range(500)], "a double, b int, c int, DepDel15 int")
    assert train._mergeable(rows, ["a", "b", "c"]) is None
    assert train._mergeable(rows, ["b"]) == []
    assert train._mergeable(rows, ["a", "b"]) == ["a"]
    assert train._mergeable(rows.limit(300), ["a", "b"]) is None
