"""The report bundles: each part must equal the operator that it bundles."""

from __future__ import annotations

from skylag.catalog import causes_and_rates, profiles, views  # noqa: F401  (their queries come first)
from skylag.catalog.registry import ORACLES, query
from skylag.plans import eda

# Part of a bundle and the query with the same rows.
PLACES = {"airlines": "a08_airline_ranking", "worst_origins": "a09_worst_origins", "busiest_origins": "a10_busiest_origins", "worst_routes": "a11_worst_routes"}
CAUSES = {"causes": "a06_cause_table", "causes_yearly": "a07_cause_millions_by_year", "cause_ranking": "w06_cause_ranking", "severity": "a16_severity_histogram"}
QUALITY = {"missing": "a19_null_profile", "completeness": "a21_completeness"}

for _part, _same in PLACES.items():
    query(f"report_{_part}", ORACLES[_same])(
        lambda spark, sf, part=_part: eda.place_reports(views.flights(spark, sf), min_airport=100, min_route=50)[part])
for _part, _same in CAUSES.items():
    query(f"report_{_part}", ORACLES[_same])(lambda spark, sf, part=_part: eda.cause_reports(views.flights(spark, sf, with_origin=False))[part])
for _part, _same in QUALITY.items():
    query(f"report_{_part}", ORACLES[_same])(lambda spark, sf, part=_part: eda.quality_reports(views.flights(spark, sf))[part])


query("report_period", ORACLES["a15_by_period"])(
    lambda spark, sf: eda.time_reports(
        eda.time_base(views.flights(spark, sf, with_origin=False)), 1998, causes_and_rates.PERIODS)["period"])
query("report_cancellations", ORACLES["a18_cancellation_by_year"])(
    lambda spark, sf: eda.time_reports(eda.time_base(views.flights(spark, sf, with_origin=False)))["cancellations"])
