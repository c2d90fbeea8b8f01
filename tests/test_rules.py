"""Rules on tiny frames that the shared tables can't show."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from wattline import sinks
from wattline.functions import errors
from wattline.functions.calendar import holiday_dates, is_us_holiday
from wattline.lineage import fresh_dir
from wattline.operators import features, news, risk, scoring
from wattline.sources import readings


def test_holiday_rule_in_any_year(spark):
    days = spark.sql("SELECT explode(sequence(DATE '1975-01-01', DATE '2080-12-31')) AS d")
    found = {r.d for r in days.where(is_us_holiday(F.col("d"))).collect()}
    assert found == set(holiday_dates(dt.date(1975, 1, 1), dt.date(2080, 12, 31)))


def test_a_value_beats_a_missing_one(make, spark):
    df = make([("a", None, 1), ("a", 5.0, 2), ("b", None, 3)], "k string, v double, n int")
    assert {(r.k, r.v) for r in features.keep_first(df, ["k"], ["v"]).collect()} == {("a", 5.0), ("b", None)}
    raw = spark.createDataFrame([("2024-01-01T05", "X", "Y", "n/a"), ("2024-01-01T05", "X", "Y", "5"), ("junk", "X", "Y", "1"), ("worse", "X", "Y", "2")], "period string, fromba string, toba string, value string")
    got = readings.normalize_interchange(raw).collect()
    assert sorted(r.value for r in got) == [1.0, 2.0, 5.0]


def test_news_counts_from_the_next_hour(make):
    told = make([("2024-01-01 10:45:00", ["A", "A"], -0.8, 0.5, "PRICE"), ("2024-01-01 12:00:00", ["A"], 0.4, 0.1, "PRICE")], "event_time string, ba_codes array<string>, sentiment_score double, risk_magnitude double, event_type string", times=("event_time",))
    got = {str(r.period): r for r in news.decayed_mean(told, half_life=1.0, reach=3).collect()}
    assert "2024-01-01 10:00:00" not in got
    assert got["2024-01-01 11:00:00"].decayed_volume == pytest.approx(0.5**0.25)
    assert got["2024-01-01 12:00:00"].decayed_volume == pytest.approx(0.5**1.25 + 1)
    assert news.risk_hourly(told).where("total_events > 1").count() == 0


def test_cascade_gives_what_is_taken(spark):
    fuel = spark.createDataFrame([("N", 0.0, 1000.0), ("D1", 0.0, 1000.0), ("D2", 0.0, 1000.0), ("M", 100.0, 100.0), ("K", 100.0, 100.0)], "ba_code string, gas_mw double, total_mw double")
    edges = spark.createDataFrame([("D1", "M"), ("D2", "M"), ("M", "D1"), ("M", "K"), ("K", "M")], "src string, dst string")
    got = {r.ba_code: r for r in risk.cascade({"gas_mw": 1.0}, fuel, edges, hops=2).collect()}
    # two donors of 100 share a need of 100; what is left of them covers the area one edge further
    assert got["M"].compensated_mw == pytest.approx(100) and got["K"].compensated_mw == pytest.approx(100)
    short = {r.ba_code: r for r in risk.cascade({"gas_mw": 1.0}, fuel, edges.where("src <> 'D2'"), hops=2).collect()}
    assert sum(r.compensated_mw for r in short.values()) == pytest.approx(100)
    assert {r.impact_hops for r in short.values() if r.shortfall_mw > r.compensated_mw + 1e-6} == {0} and short["N"].impact_hops is None


def test_merge_again_adds_nothing(spark, make):
    path = fresh_dir(spark, "table")
    rows = make([(1, "2024-01-05 00:00:00", 1.0), (2, "2024-02-05 00:00:00", 2.0), (3, None, 3.0)], "id long, period string, v double")
    for _ in range(3):
        sinks.write_merge(spark, rows, path, ["id", "period"])
    sinks.write_merge(spark, make([(1, "2024-03-01 00:00:00", 9.0)], "id long, period string, v double"), path, ["id"])
    assert sorted(r.v for r in spark.read.parquet(path).collect()) == [1.0, 2.0, 3.0]


def test_months_are_named_to_the_reader(spark, make):
    path = fresh_dir(spark, "table")
    rows = make([(i, f"2024-0{i}-05 00:00:00") for i in range(1, 7)], "id long, period string")
    sinks.write_append(rows, path)
    touched = sinks.months_of(spark.read.parquet(path), sinks.with_month(rows.where("id = 3")))
    plan = touched._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "2024-03" in plan and touched.count() == 1


def test_stake_and_probability_limits(spark):
    sent = spark.createDataFrame([(1, "A", "t", 10, 500), (1, "A", "t", 30, 10_001), (2, "A", "t", 20, 10_000)], "node_id long, ba_code string, target string, predicted_mw long, prob_bp long")
    lost = spark.createDataFrame([(1, 500), (1, 60), (1, 60)], "node_id long, amount int")
    got = {r.node_id: r for r in risk.node_stats(sent, lost, stake=100).collect()}
    assert (got[1].remaining_stake, got[1].n_penalties, got[2].remaining_stake) == (40, 1, 100)
    assert [r.n_submissions for r in risk.consensus(sent).collect()] == [2]


def test_episodes_end_after_one_gap(make):
    at = ["2024-01-01 00:00:00", "2024-01-01 01:00:00", "2024-01-01 02:00:01"]
    df = make([(p, "A", True, 1.0) for p in at], "period string, ba_code string, is_spike boolean, spike_magnitude double")
    assert sorted(r.n_hours for r in risk.episodes(df, gap_hours=1).collect()) == [1, 2]


def test_unknown_variant_is_refused(spark):
    m = spark.createDataFrame([("A", 1.0), ("D", 2.0)], "model string, mape double")
    with pytest.raises(Exception, match="variant D"):
        scoring.ablation(m, ["mape"], variants=["A", "B"]).collect()
    assert scoring.ablation(m, ["mape"]).columns == ["metric", "A", "D"]


def test_outer_quantiles_weigh_more():
    assert errors.quantile_weights(2.0, 7) == [2.0, 1.5, 1.0, 1.0, 1.0, 1.5, 2.0] and errors.quantile_weights(3.0, 3) == [3.0, 1.0, 3.0]


def test_correlation_of_a_constant_is_null(spark):
    """Spark's own correlation divides by zero there; pairs with a NULL count on neither side."""
    from wattline.operators import aggregates

    rows = [("A", 0.0, 1.0), ("A", 0.0, 2.0), ("A", 0.0, 4.0), ("A", None, 9.0), ("B", 1.0, 5.0), ("B", 2.0, 3.0), ("B", 9.0, None), ("D", 1.0, 1.0)]
    df = spark.createDataFrame(rows, "ba_code string, x double, demand_mw double")
    got = {r.ba_code: r.corr_x for r in aggregates.group_corr(df, ["x"]).collect()}
    assert (got["A"], got["D"]) == (None, None) and got["B"] == pytest.approx(-1)
