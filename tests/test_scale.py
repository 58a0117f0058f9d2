"""The forms built for large and skewed data against plain ones on small data."""

import datetime as dt
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from skylag import fixed_values as fixed
from skylag.catalog import propagation as catalog_propagation
from skylag.catalog import views
from skylag.models import evaluate, prep
from skylag.operators import history, ordered, propagation, quality, rates, sampling, stations, weather
from skylag.plans import eda, feature_table
from skylag.session import scratch_path
from skylag.sources import sinks


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def skewed_legs(spark):
    """A third of all flights on one tail number, a third without one; gaps of days."""
    rng = random.Random(7)
    rows = []
    for i in range(3000):
        tail = ["hot", None, f"t{rng.randrange(40)}"][i % 3]
        day = dt.date(2020, 1, 1) + dt.timedelta(days=rng.choice([0, 1, 5, 6, 20]))
        rows.append((tail, day, rng.randrange(24) * 100, rng.choice([None, 5.0, 30.0]), False, i))
    return spark.createDataFrame(rows, "Tail_Number string, FlightDate date, CRSDepTime int, ArrDelay double, Cancelled boolean, id int")


@pytest.mark.parametrize("drop", [True, False])
def test_previous_leg_is_lag(skewed_legs, drop):
    got = propagation.previous_leg(skewed_legs, ["id"], drop_unknown_tails=drop)
    order = Window.partitionBy("Tail_Number").orderBy("FlightDate", "CRSDepTime", "id")
    plain = skewed_legs.filter("Tail_Number IS NOT NULL") if drop else skewed_legs
    want = plain.withColumn("prev_arr_delay", F.lag("ArrDelay").over(order))
    assert rows_of(got.select(want.columns)) == rows_of(want)


def test_recent_arrivals_equal_band_join(spark):
    rng = random.Random(3)
    rows = []
    for i in range(1500):
        airport = "HUB" if i % 3 else f"a{rng.randrange(4)}"
        day = dt.date(2020, 1, 1) + dt.timedelta(days=rng.randrange(3))
        def clock():
            m = rng.choice([rng.randrange(1440), 1439, 0, 1320, 120])
            return rng.choice([None] + [float(m // 60 * 100 + m % 60)] * 9)
        rows.append((i, day.year, day, airport, f"a{rng.randrange(4)}" if i % 2 else "HUB", clock(), clock(), float(rng.randrange(-20, 90)), float(rng.randrange(2))))
    df = spark.createDataFrame(rows, "id int, Year int, FlightDate date, Origin string, Dest string, DepTime double, ArrTime double, ArrDelay double, ArrDel15 double").cache()
    names = ["origin_delay_rate_past2h", "origin_arr_delay_avg_past2h", "origin_late_arrivals_past2h"]
    got = {r["id"]: tuple(r[n] for n in names) for r in propagation.add_recent_arrival_features(df).collect()}
    timed = propagation.add_timestamps(df).collect()
    for flight in timed:
        seen = [a for a in timed if a["Dest"] == flight["Origin"] and a["ArrTimestamp"] is not None and flight["DepTimestamp"] is not None
                and flight["DepTimestamp"] - 120 <= a["ArrTimestamp"] < flight["DepTimestamp"]]
        late, n = sum(a["ArrDel15"] for a in seen), len(seen)
        want = (late / n, sum(a["ArrDelay"] for a in seen) / n, late) if n else (0.0, 0.0, 0.0)
        assert got[flight["id"]] == pytest.approx(want)
    df.unpersist()


def test_recent_arrivals_plan_has_no_band_join(spark, sf_dir):
    df = propagation.add_recent_arrival_features(views.flights(spark, sf_dir))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_stations_equal_brute_force(spark):
    rng = random.Random(11)
    # A third of the stations share one spot; one airport lies at the date line, one at a pole.
    spots = [(1000 + i, 40.0, -73.0) for i in range(100)]
    spots += [(i, rng.uniform(-90, 90), rng.uniform(-180, 180)) for i in range(200)]
    sites = spark.createDataFrame(spots, "station_id int, latitude double, longitude double")
    ports = spark.createDataFrame(
        [("hub", 40.0, -73.0), ("near", 40.01, -73.0), ("line", 10.0, 179.99), ("pole", 89.9, 0.0), ("south", -60.0, 20.0)],
        "airport_code string, latitude double, longitude double")
    from skylag.functions.geo import haversine_km

    pairs = ports.withColumnsRenamed({"latitude": "a", "longitude": "o"}).crossJoin(sites)
    order = Window.partitionBy("airport_code").orderBy("distance_km", "station_id")
    want = pairs.withColumn("distance_km", haversine_km("a", "o", "latitude", "longitude")).withColumn("rank", F.row_number().over(order)).filter("rank <= 5")
    got = stations.nearest_stations(ports, sites, 5)
    assert rows_of(got.select("airport_code", "station_id", "rank")) == rows_of(want.select("airport_code", "station_id", "rank"))


def test_clustered_stations_are_not_all_measured(spark, monkeypatch):
    """Many airports far from one spot with all the stations: a few candidates each."""
    rng = random.Random(4)
    sites = spark.createDataFrame([(i, 50 + rng.uniform(0, 0.01), 8 + rng.uniform(0, 0.01)) for i in range(2000)], "station_id int, latitude double, longitude double")
    ports = spark.createDataFrame([(f"p{i}", 60 + rng.uniform(-1, 1), 8 + rng.uniform(-1, 1)) for i in range(60)], "airport_code string, latitude double, longitude double")
    kept = {}
    inner = stations._possible

    def watched(reached, level, k):
        kept[level] = inner(reached, level, k)
        return kept[level]

    monkeypatch.setattr(stations, "_possible", watched)
    assert stations.nearest_stations(ports, sites, 1).count() == 60
    assert kept[stations.LEVELS[-1]].count() <= 5 * 60


def test_fewer_stations_than_asked(spark):
    ports = spark.createDataFrame([("a", 0.0, 0.0)], "airport_code string, latitude double, longitude double")
    sites = spark.createDataFrame([(1, 0.0, 170.0), (2, 1.0, 0.0)], "station_id int, latitude double, longitude double")
    assert [r["station_id"] for r in stations.nearest_stations(ports, sites, 5).orderBy("rank").collect()] == [2, 1]
    assert stations.assign_station(ports, sites.limit(0)).first()["station_id"] is None


def test_medians_under_skew(spark):
    rng = random.Random(5)
    rows = [(0.0 if i % 3 == 0 else rng.uniform(-1, 1), float(i % 7), None if i % 2 else 1.5) for i in range(2001)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    import statistics

    got = {r["column"]: r["median"] for r in quality.medians(df, ["a", "b", "c"]).collect()}
    want = {c: statistics.median([r[i] for r in rows if r[i] is not None]) for i, c in enumerate("abc")}
    assert got == pytest.approx(want)


def scored(spark, n=600, levels=37):
    rng = random.Random(1)
    rows = [(float(rng.random() < 0.4), 0.5 if i % 3 == 0 else rng.randrange(levels) / levels) for i in range(n)]
    return rows, spark.createDataFrame(rows, "label double, score double")


def plain_auc(rows):
    pos, neg = [s for y, s in rows if y == 1], [s for y, s in rows if y == 0]
    wins = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    return wins / len(pos) / len(neg)


def test_auc_is_rank_statistic(spark):
    rows, df = scored(spark)
    assert evaluate.roc_auc(df).first()["auc"] == pytest.approx(plain_auc(rows))


def test_roc_curve_ends_and_area(spark):
    _, df = scored(spark)
    for collinear in (True, False):
        points = evaluate.roc_curve(df, drop_collinear=collinear).orderBy("fpr", "tpr").collect()
        assert (points[0]["fpr"], points[0]["tpr"]) == (0.0, 0.0) and (points[-1]["fpr"], points[-1]["tpr"]) == (1.0, 1.0)
        area = sum((b["fpr"] - a["fpr"]) * (a["tpr"] + b["tpr"]) / 2 for a, b in zip(points, points[1:]))
        assert area == pytest.approx(evaluate.roc_auc(df).first()["auc"])


def test_auc_of_one_class_is_null(spark):
    df = spark.createDataFrame([(1.0, 0.3), (1.0, 0.4)], "label double, score double")
    assert evaluate.roc_auc(df).first()["auc"] is None


def test_range_buckets_are_monotone(spark):
    df = spark.createDataFrame([(x / 10,) for x in range(-20, 20)], "v double")
    got = [r["__bucket"] for r in ordered.range_bucketed(df, ["v"]).orderBy("v").collect()]
    assert got == sorted(got)


@pytest.fixture
def partitions(spark, request):
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    spark.conf.set(name, request.param)
    # Tiny shuffles would be merged again: results must not depend on that either.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield request.param
    spark.conf.set(name, before)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


@pytest.mark.parametrize("partitions", ["2", "200"], indirect=True)
def test_results_do_not_depend_on_partitions(spark, skewed_legs, partitions):
    rng = random.Random(5)
    values = [(rng.choice([None, 1.0, 2.5]) if i % 3 else float(rng.randrange(500)), i) for i in range(999)]
    df = spark.createDataFrame(values, "v double, id int").repartition(3)
    known = sorted(v for v, _ in values if v is not None)
    middle = (known[(len(known) - 1) // 2] + known[len(known) // 2]) / 2
    assert quality.medians(df, ["v"]).first()["median"] == middle
    row = quality.describe(df, ["v"]).first()
    assert (row["count"], row["min"], row["q50"], row["max"]) == (len(known), known[0], middle, known[-1])
    ids = {r["id"] for r in sampling.sample_exact(df, 100, ["id"], seed=3).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    assert ids == {r["id"] for r in sampling.sample_exact(df.repartition(5), 100, ["id"], seed=3).collect()} and len(ids) == 100
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    plain, scores = scored(spark)
    assert evaluate.roc_auc(scores).first()["auc"] == pytest.approx(plain_auc(plain))


def test_equal_ranks_are_still_counted_exactly(spark):
    df = spark.range(1000).select("id", (F.col("id") % 3).alias("h"))
    assert sampling.sample_exact(df, 500, ["id"], rank_by="h", rank_bits=2).count() == 500
    assert sampling.sample_exact(df, 0, ["id"], rank_by="h", rank_bits=2).count() == 0


@pytest.mark.parametrize("n", [0, 1, 777, 5000])
def test_exact_sample(spark, n):
    df = spark.range(3000).withColumn("k", F.col("id") % 3)
    sample = sampling.sample_exact(df, n, ["id"], seed=1)
    assert sample.count() == min(n, 3000)
    again = sampling.sample_exact(df.repartition(7), n, ["id"], seed=1)
    assert rows_of(sample) == rows_of(again)


def test_samples_differ_by_seed(spark):
    df = spark.range(3000)
    assert rows_of(sampling.sample_exact(df, 100, ["id"], 1)) != rows_of(sampling.sample_exact(df, 100, ["id"], 2))


def test_stratified_split_sizes(spark):
    df = spark.range(1003).withColumn("y", F.when(F.col("id") % 10 == 0, 1).when(F.col("id") % 10 < 9, 0))
    parts = sampling.stratified_split(df, "y", ["id"])
    assert parts.count() == 1003
    got = {(r["y"], r["split"]): r["count"] for r in parts.groupBy("y", "split").count().collect()}
    sizes = {r["y"]: r["count"] for r in df.groupBy("y").count().collect()}
    for y, size in sizes.items():
        assert got[(y, "train")] == int(size * 0.8) and got[(y, "test")] == size - int(size * 0.8)


def test_history_sees_only_earlier_days(spark):
    day = dt.date(2020, 1, 10)
    rows = [("A", "B", "X", day - dt.timedelta(days=d), late, False, i) for i, (d, late) in enumerate([(0, 1.0), (0, 1.0), (1, 0.0), (7, 1.0), (8, 1.0), (30, 1.0), (31, 0.0)])]
    rows.append(("A", "B", "X", day - dt.timedelta(days=1), None, True, 99))
    df = spark.createDataFrame(rows, "Origin string, Dest string, Marketing_Airline_Network string, FlightDate date, DepDel15 double, Cancelled boolean, id int")
    row = history.add_history(df).filter("id = 0").first()
    assert row["route_delay_rate_7d"] == pytest.approx(1 / 2) and row["origin_delay_rate_30d"] == pytest.approx(3 / 4)
    first = history.add_history(df).filter("id = 6").first()
    assert first["airline_delay_rate_30d"] is None


def test_one_aggregate_gives_all_breakdowns(spark, sf_dir):
    flights = views.flights(spark, sf_dir, with_origin=False).cache()
    reports = eda.time_reports(eda.time_base(flights))
    direct = {
        "yearly": rates.by_year(flights), "monthly": rates.by_month(flights), "day_of_week": rates.by_day_of_week(flights),
        "hourly": rates.by_departure_hour(flights), "quarterly": rates.by_quarter(flights), "period": rates.by_period(flights),
        "cancellations": rates.cancellation_by_year(flights),
    }
    for name, want in direct.items():
        columns = sorted(want.columns)
        assert rows_of(reports[name].select(columns)) == rows_of(want.select(columns)), name
    flights.unpersist()


def test_totals_agree(spark, sf_dir):
    flights = views.flights(spark, sf_dir, with_origin=False)
    total = rates.overall(flights).first()
    for report in (rates.by_year(flights), rates.by_month(flights), rates.by_departure_hour(flights)):
        sums = report.agg(F.sum("total_flights"), F.sum("delayed_flights")).first()
        assert tuple(sums) == (total["total_flights"], total["delayed_flights"])
    assert rates.severity_histogram(flights).agg(F.sum("percentage")).first()[0] == pytest.approx(100)


def test_few_rows_carry_a_previous_leg_over(spark, sf_dir, monkeypatch):
    """Buckets, each of which hands one row on, are under a third of the flights, and rows without a tail are cut finely."""
    seen = {}
    monkeypatch.setattr(propagation, "previous_value", lambda df, keys, bucket, *rest: seen.update(df=df, keys=keys, bucket=bucket) or df)
    for drop in (True, False):
        propagation.previous_leg(views.flights(spark, sf_dir, with_origin=False), views.FLIGHT_KEY, drop_unknown_tails=drop)
        cut = seen["df"].withColumns(seen["bucket"]).groupBy(*seen["keys"], *seen["bucket"]).agg(F.count(F.lit(1)).alias("n"))
        known = cut.filter("Tail_Number IS NOT NULL").agg(F.count(F.lit(1)).alias("buckets"), F.sum("n").alias("rows")).first()
        assert 3 * known.buckets < known.rows
    unknown = cut.filter("Tail_Number IS NULL").agg(F.count(F.lit(1)).alias("buckets"), F.sum("n").alias("rows")).first()
    assert 2 * unknown.buckets > unknown.rows


@pytest.mark.parametrize("scale", [1.0, 1e-300, 1e300])
def test_ranked_values_resolve_all_doubles(spark, scale):
    rng = random.Random(int(scale > 1))
    inf = float("inf")
    values = [rng.choice([rng.gauss(0, 1), rng.gauss(0, 1) ** 21, 1.0, -1.0, 0.0, -0.0, 1 + rng.randrange(9) * 2**-52]) * scale for _ in range(3000)] + [inf, -inf, 5e-324, -5e-324]
    nothing = [None, float("nan")]
    df = spark.createDataFrame([(v, 7.0, None) for v in values + nothing], "`a b` double, same double, none double").repartition(5)
    shares = [0.0, 0.013, 0.25, 0.5, 0.9, 1.0]
    found = quality.ranked_values(df, ["a b", "same", "none"], shares)
    total, got = found["a b"]
    ranked = sorted(values)
    assert total == len(values) and found["same"] == (len(values) + 2, dict.fromkeys(quality._places(len(values) + 2, shares), 7.0)) and found["none"] == (0, {})
    assert got == {r: ranked[r] for r in quality._places(total, shares)}
    described = {r["column"]: r for r in quality.describe(df.filter("abs(`a b`) < 1e308"), ["a b", "none"]).collect()}
    finite = [v for v in ranked if abs(v) < 1e308]
    assert described["a b"]["count"] == len(finite) and (described["a b"]["min"], described["a b"]["max"]) == (finite[0], finite[-1])
    assert tuple(described["none"])[1:] == (0, *[None] * 7)


def test_history_of_appended_years_is_that_of_all(spark):
    rng = random.Random(9)
    rows = []
    for i in range(2500):
        day = dt.date(2019, 11, 1) + dt.timedelta(days=rng.choice([*range(0, 160, 3), 61, 62, 420, 430]))
        rows.append((i, day if i % 50 else None, rng.choice(["A", "B", None]), rng.choice(["x", "y"]), rng.choice(["C", "D"]), rng.choice([0.0, 1.0, None]), rng.random() < 0.1))
    df = spark.createDataFrame(rows, "id int, FlightDate date, Origin string, Dest string, Marketing_Airline_Network string, DepDel15 double, Cancelled boolean")
    path = scratch_path(spark, "daily-sums")
    years = sorted({r[1].year for r in rows if r[1]})
    got = []
    for year in years:
        own = df.filter(F.year("FlightDate") == year)
        for _ in range(2):  # safe to repeat
            history.keep_daily_sums(own, path)
        got += rows_of(history.add_history_from(own, path))
    want = history.add_history(df).filter("FlightDate IS NOT NULL")
    assert len(years) == 3 and sorted(got, key=str) == rows_of(want.select(history.add_history_from(df, path).columns))
    assert history.add_history_from(df.limit(0), path).count() == 0
    undated = history.add_history_from(df.filter("FlightDate IS NULL"), path)
    assert undated.count() == 50 and undated.filter("origin_delay_rate_7d IS NOT NULL").count() == 0


def test_replacing_years_leaves_the_others(spark):
    path = scratch_path(spark, "years")
    sinks.write_by_year(spark.createDataFrame([(1, 2000), (2, 2001), (3, 2001), (4, None)], "v int, Year int"), path)
    fresh = spark.createDataFrame([(5, 2001), (6, 2002)], "v int, Year int")
    sinks.replace_years(fresh, path)
    sinks.replace_years(fresh, path)
    sinks.replace_years(fresh.limit(0), path)
    assert sorted(r.v for r in spark.read.parquet(path).collect()) == [1, 4, 5, 6]


def test_codes_of_any_number_of_values(spark):
    train = spark.range(20_000).select(F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 == 0, None).otherwise(F.concat(F.lit("v"), (F.col("id") % 5000).cast("string"))).alias("c"))
    codes = prep.label_codes(train, "c")
    got = {r.c: r.code for r in codes.collect()}
    assert got == {v: i for i, v in enumerate(sorted(got))} and len(got) > 4000
    others = spark.createDataFrame([("hot",), ("never seen",), (None,)], "c string")
    assert {r.c: r.c_idx for r in prep.encode(others, codes, "c").collect()} == {"hot": got["hot"], "never seen": len(got), None: len(got)}
    none = prep.label_codes(train.limit(0), "c")
    assert none.count() == 0 and {r.c_idx for r in prep.encode(others, none, "c").collect()} == {0.0}
    few = prep.label_codes(others, "c")
    coded = prep.encode(others, few, "c")
    encoded = prep.fit_one_hot_codes(prep.encode(others.filter("c IS NOT NULL"), few, "c"), ["c_idx"]).transform(coded)
    assert {r.c: r.c_idx_vec.toArray().tolist() for r in encoded.collect()} == {"hot": [1.0, 0.0], "never seen": [0.0, 1.0], None: [0.0, 0.0]}
    assert prep.split_by_variety(train.withColumn("few", F.lit("x")), ["c", "few"]) == (["few"], ["c"])


def test_operating_point_is_the_cheapest(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(2), rng.randrange(40) / 40) for _ in range(500)]
    for own in (rows, [(0, 0.5)] * 3, [(1, 0.5)] * 3, rows[:1]):
        costs = [(sum(5 if label and s < t else 1 if not label and s >= t else 0 for label, s in own), -t) for t in {s for _, s in own} | {float("inf")}]
        got = evaluate.operating_point(spark.createDataFrame(own, "label int, score double")).first()
        assert (got.total_cost, -got.threshold) == min(costs)
    assert evaluate.operating_point(spark.createDataFrame([], "label int, score double")).count() == 0


def weather_copies(spark):
    """Four flights of one airport, two of them in the same hour; weather rows of that hour, some alike, and of another airport."""
    day = dt.date(2020, 1, 1)
    flights = spark.createDataFrame(
        [(1, 2020, day, "A", "B", 900, 905.0, 1000.0, 1.0, 20.0), (2, 2020, day, "A", "B", 930, 940.0, 1030.0, 0.0, 3.0),
         (3, 2020, day, "B", "A", 1100, 1100.0, 1200.0, 1.0, 30.0), (4, 2020, day, "A", "B", 1300, 1300.0, None, None, None)],
        "id int, Year int, FlightDate date, Origin string, Dest string, CRSDepTime int, DepTime double, ArrTime double, ArrDel15 double, ArrDelay double")
    nine, eleven = dt.datetime(2020, 1, 1, 9), dt.datetime(2020, 1, 1, 11)
    rows = spark.createDataFrame(
        [("A", nine, 1.0, 5.0), ("A", nine, 1.0, 5.0), ("A", nine, 1.0, 6.0), ("A", nine, None, 6.0), ("B", eleven, 2.0, 2.0)],
        "airport_code string, time timestamp_ntz, temp double, pres double")
    return flights, rows


@pytest.mark.parametrize("measures", [[], ["temp"], ["temp", "pres"]])
def test_equal_weather_rows_of_an_hour_are_one_row_with_their_number(spark, measures):
    flights, rows = weather_copies(spark)
    plain = weather.join_weather(flights, rows, measures)
    counted = weather.join_weather(flights, rows, measures, copies="copies")
    assert plain.count() == 10
    assert counted.count() == {0: 4, 1: 6, 2: 8}[len(measures)]
    assert rows_of(counted.withColumn("copies", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))).drop("copies")) == rows_of(plain)


def test_copies_arrive_as_often_as_the_rows_they_stand_for(spark):
    flights, rows = weather_copies(spark)
    mapping = spark.createDataFrame([], "missing string, source string")
    names = ["id", "temp", "origin_delay_rate_past2h", "origin_arr_delay_avg_past2h", "origin_late_arrivals_past2h"]
    plain = feature_table.propagation_table(flights, rows, mapping, ["temp"]).select(names)
    counted = feature_table.propagation_table(flights, rows, mapping, ["temp"], "copies")
    assert plain.filter("id = 3").first()["origin_late_arrivals_past2h"] == 4.0
    assert rows_of(counted.withColumn("copies", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))).select(names)) == rows_of(plain)


def test_training_table_does_not_grow_with_weather_rows_of_an_hour(spark, sf_dir, monkeypatch):
    """Weather for every test flight's hour, so many rows an hour; none in the years trained on."""
    hours = views.flights(spark, sf_dir).filter("Year >= 2000").selectExpr(
        "Origin AS airport_code", "CAST(FlightDate AS TIMESTAMP_NTZ) + make_interval(0, 0, 0, 0, CRSDepTime DIV 100) AS time").distinct()
    sizes = []
    for many in (1, 3):
        rows = hours.crossJoin(spark.range(many)).selectExpr("airport_code", "time", *[f"CAST(id AS DOUBLE) AS {c}" for c in fixed.WEATHER_MEASURES])
        monkeypatch.setattr(views, "weather", lambda *_: rows)
        parts, _, numeric, _, _ = catalog_propagation._training_parts(spark, sf_dir)
        assert "copies" not in numeric and not set(numeric) & set(fixed.WEATHER_MEASURES)
        sizes.append((parts.count(), parts.agg(F.sum("copies")).first()[0]))
    flights, late = views.flights(spark, sf_dir).count(), views.flights(spark, sf_dir).filter("Year >= 2000").count()
    assert sizes == [(flights, flights), (flights, flights + 2 * late)]


def test_correlations_are_one_small_aggregate(spark):
    rng = random.Random(5)
    rows = [(rng.choice([0, 1, None]), *[rng.choice([None, rng.random()]) for _ in range(12)], None) for _ in range(300)]
    df = spark.createDataFrame(rows, "y int, " + ", ".join(f"c{i} double" for i in range(12)) + ", none double")
    found = quality.correlations(df, "y")
    assert found._jdf.queryExecution().optimizedPlan().toString().count("covar_pop") <= 1
    got = {r["column"]: r["correlation"] for r in found.collect()}
    assert set(got) == {*df.columns} - {"y"} and got["none"] is None
    for i in range(12):
        known = [(r[0], r[i + 1]) for r in rows if r[0] is not None and r[i + 1] is not None]
        ys, xs = zip(*known)
        my, mx = sum(ys) / len(ys), sum(xs) / len(xs)
        both = sum((a - my) * (b - mx) for a, b in known)
        assert got[f"c{i}"] == pytest.approx(both / (sum((a - my) ** 2 for a in ys) * sum((b - mx) ** 2 for b in xs)) ** 0.5)
    assert {r["correlation"] for r in quality.correlations(df.limit(0), "y").collect()} == {None}
