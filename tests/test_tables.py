"""Readers, merges, joins and scores on small frames."""

import math
import random

import pytest
from pyspark.sql import functions as F

from wattline import sinks
from wattline.lineage import fresh_dir
from wattline.operators import forecast, joins, panel, prep, quality, risk, scoring
from wattline.sources import readings


def test_normalisers_coerce_and_keep_rows(spark):
    raw = spark.createDataFrame(
        [("2025-03-15T14", "PJM", "PJM area", "D", "Demand", "12.5", "x"), ("bad", "PJM", "PJM area", "D", "Demand", "n/a", "x")],
        ["period", "respondent", "respondent-name", "type", "type-name", "value", "extra"],
    )
    out = readings.normalize_region(raw)
    assert out.columns == ["period", "respondent", "respondent_name", "type", "type_name", "value"]
    rows = {str(r.period): r.value for r in out.collect()}
    assert rows == {"2025-03-15 14:00:00": 12.5, "None": None}


def test_interchange_fills_respondent_and_dedupes(spark):
    raw = spark.createDataFrame([("2025-03-15T14", "A", "B", "1")] * 2 + [("2025-03-15T14", "B", "A", "2")], ["period", "fromba", "toba", "value"])
    rows = readings.normalize_interchange(raw).collect()
    assert {(r.fromba, r.respondent, r.respondent_name) for r in rows} == {("A", "A", "Unknown"), ("B", "B", "Unknown")} and len(rows) == 2


def test_csv_files_take_any_foreign_columns(spark):
    path = fresh_dir(spark, "csvs")
    spark.createDataFrame([("2025-03-15T14", "A", "Aa", "B", "3", "MWh", "z")], ["period", "fromba", "fromba-name", "toba", "value", "value-units", "odd"]).write.option("header", True).csv(path)
    r = readings.read_interchange_csvs(spark, path).first()
    assert (r.respondent, r.respondent_name, r.value, r.units) == ("A", "Aa", 3.0, "MWh")


def test_price_fan_out(make):
    hours = make([("2024-01-01 05:00", "A")], "period string, ba_code string")
    prices = make([("2024-01-01", "s1", 2.0), ("2024-01-01", "s2", 4.0)], "period string, series_name string, value double", ())
    rows = joins.join_daily(hours, prices, {"value": "oil_price"}).collect()
    assert len(rows) == 1 and rows[0].oil_price == 3.0


def test_patch_null_overwrites_and_misses_keep(make):
    target = make([("a", 1.0), ("b", 2.0)], "k string, v double", ())
    src = make([("a", None)], "k string, v double", ())
    assert {r.k: r.v for r in joins.patch(target, src, ["k"], ["v"]).collect()} == {"a": None, "b": 2.0}


def test_flag_dates_with_empty_list(make, spark):
    df = make([("2024-01-01 05:00", "A")], "period string, ba_code string")
    none = spark.createDataFrame([], "holiday_date date")
    assert joins.flag_dates(df, none).first().is_holiday is False


def test_partial_upsert(make):
    old = make([("k", 1.0, 10.0)], "key string, demand double, gas double", ())
    new = make([("k", 2.0, 20.0), ("n", 3.0, 30.0)], "key string, demand double, gas double", ())
    got = {r.key: (r.demand, r.gas) for r in sinks.upsert_cols(old, new, ["key"], ["gas"]).collect()}
    assert got == {"k": (1.0, 20.0), "n": (3.0, 30.0)}


def test_insert_ignore_is_idempotent(make):
    old = make([("k", 1.0)], "key string, v double", ())
    new = make([("k", 9.0), ("n", 3.0), ("n", 2.0)], "key string, v double", ())
    once = sinks.insert_ignore(old, new, ["key"])
    assert {r.key: r.v for r in once.collect()} == {"k": 1.0, "n": 2.0}
    assert sinks.insert_ignore(once, new, ["key"]).count() == 2


def test_write_merge_and_months(make, spark):
    path = fresh_dir(spark, "t")
    a = make([("2024-01-05 00:00", "A", 1.0), ("2024-02-05 00:00", "A", 2.0)], "period string, ba_code string, v double")
    sinks.write_merge(spark, a, path, ["period", "ba_code"])
    b = make([("2024-02-05 00:00", "A", 9.0), ("2024-02-06 00:00", "A", 3.0)], "period string, ba_code string, v double")
    for _ in range(2):
        sinks.write_merge(spark, b, path, ["period", "ba_code"])
    assert sorted(r.v for r in spark.read.parquet(path).collect()) == [1.0, 2.0, 3.0]
    sinks.write_months(make([("2024-02-07 00:00", "A", 7.0)], "period string, ba_code string, v double"), path)
    assert sorted(r.v for r in spark.read.parquet(path).collect()) == [1.0, 7.0]


def test_ledger(spark):
    path = fresh_dir(spark, "ledger")
    sinks.write_ledger(spark, path, "demand", "PJM", "failed: x")
    sinks.write_ledger(spark, path, "demand", "PJM", "completed")
    sinks.write_ledger(spark, path, "demand", "TVA", "failed: x")
    work = spark.createDataFrame([("demand", "PJM"), ("demand", "TVA"), ("demand", "DUK")], "table_name string, work_key string")
    assert {r.work_key for r in sinks.pending(work, spark.read.parquet(path)).collect()} == {"TVA", "DUK"}


def test_fuel_pivot_defaults(make):
    r = panel.pivot_fuel(make([("2024-01-01", "A", "NG", 30.0), ("2024-01-01", "A", "SUN", 10.0)], "period string, respondent string, fueltype string, value double")).first()
    assert (r.coal_mw, r.total_mw, r.gas_pct, r.renewable_pct) == (0.0, 40.0, 75.0, 25.0)


def test_asof_carries_over_weekend(make):
    hours = make([("2024-01-05 10:00", "A"), ("2024-01-07 10:00", "A"), ("2024-01-04 10:00", "A")], "period string, ba_code string")
    prices = make([("2024-01-05", 2.5)], "period string, value double", ())
    got = {r.period.day: r.value for r in joins.asof_last(hours, prices, ["value"]).collect()}
    assert got == {5: 2.5, 7: 2.5, 4: None}


def test_impute_chain_ends_in_zero(make):
    df = make([("2024-01-01 00:00", "A", None), ("2024-01-01 01:00", "A", None), ("2024-01-01 00:00", "B", 4.0)], "period string, ba_code string, x double")
    assert {(r.ba_code, r.x) for r in prep.impute(df, ["x"]).collect()} == {("A", 0.0), ("B", 4.0)}


def test_consensus_integer_half(make):
    rows = [(1, "A", 10, 100), (2, "A", 11, 100), (3, "A", 40, 200), (1, "B", 10, 5), (2, "B", 11, 8)]
    df = make(rows, "node_id int, ba_code string, predicted_mw long, prob_bp long", ()).withColumn("target", F.lit(1))
    got = {r.ba_code: (r.median_mw, r.median_prob_bp, r.n_submissions) for r in risk.consensus(df).collect()}
    assert got == {"A": (11, 100, 3), "B": (10, 6, 2)}


def test_settlement_is_zero_sum_with_winners(make):
    subs = make([(1, "A", 1, 100.0), (2, "A", 1, 101.0), (3, "A", 1, 300.0)], "node_id int, ba_code string, target int, predicted_mw double", ())
    actual = make([("A", 1, 100.0)], "ba_code string, target int, actual double", ())
    rows = risk.settle(subs, actual).collect()
    assert sum(r.balance for r in rows) == pytest.approx(0.0) and [r.node_id for r in rows if r.penalised] == [3]


def test_bounds_report(make):
    df = make([("PJM", 100.0), ("PJM", 99999.0), ("TVA", 9000.0), ("XX", 1.0)], "ba_code string, demand_mw double", ())
    got = {r.ba_code: (r.n_below, r.n_above, r.passed) for r in quality.validate_bounds(df).collect()}
    assert got == {"PJM": (1, 0, False), "TVA": (0, 0, True)}


def two_models(make, n=60):
    rng = random.Random(4)
    rows = [(f"2024-01-{1 + h // 24:02d} {h % 24:02d}:00", "A", 100.0, 100.0 + rng.gauss(0, 3), 100.0 + rng.gauss(0, 2)) for h in range(n)]
    return make(rows, "period string, ba_code string, actual double, q50_a double, q50_b double")


def test_test_statistics_have_normal_tails(make):
    df = two_models(make)
    r = scoring.diebold_mariano(df, h=3).first()
    assert r.p_value == pytest.approx(math.erfc(abs(r.dm_stat) / math.sqrt(2)))
    w = scoring.wilcoxon(df).first()
    assert w.w_plus + w.w_minus == w.n * (w.n + 1) / 2 and 0 <= w.p_value <= 1


def test_decomposition_recovers_trend_and_week(spark):
    days = spark.range(0, 800).select(F.lit("A").alias("ba_code"), F.date_add(F.lit("2021-01-01"), F.col("id").cast("int")).alias("date"), F.col("id"))
    y = 500 + F.col("id") * 0.5 + 20 * F.sin(F.unix_date("date") * 2 * math.pi / 7)
    out = forecast.decompose(days.select("ba_code", "date", y.alias("y")))
    worst = out.select(F.max(F.abs(F.col("y") - F.col("prophet_trend") - F.col("prophet_weekly") - F.col("prophet_yearly")))).first()[0]
    assert worst < 2.0
    late = forecast.decompose(days.select("ba_code", "date", y.alias("y")), train_end="2022-12-01")
    assert late.count() == 800


def test_cascade_never_gives_more_than_needed(spark):
    fuel = spark.createDataFrame([("A", 80.0, 100.0), ("B", 0.0, 400.0), ("C", 0.0, 1000.0)], "ba_code string, gas_mw double, total_mw double")
    edges = spark.createDataFrame([("B", "A"), ("A", "B"), ("C", "B"), ("B", "C")], "src string, dst string")
    one = {r.ba_code: r for r in risk.cascade({"gas_mw": 1.0}, fuel, edges, hops=1).collect()}
    two = {r.ba_code: r for r in risk.cascade({"gas_mw": 1.0}, fuel, edges, hops=2).collect()}
    assert (one["A"].shortfall_mw, one["A"].compensated_mw) == (80.0, 40.0)
    assert two["A"].compensated_mw == 80.0 and two["A"].risk_score == 0.0


def test_splits_are_disjoint(make):
    df = make([("2024-06-30 23:00", "A"), ("2024-07-01 00:00", "A"), ("2025-07-01 00:00", "A"), ("2026-04-01 00:00", "A")], "period string, ba_code string")
    assert [r.split for r in prep.label_split(df).orderBy("period").collect()] == ["train", "val", "test", None]


def test_origins_need_all_rows(make):
    rows = [(f"2024-01-{1 + h // 24:02d} {h % 24:02d}:00", "A") for h in range(24 * 10) if h != 230]
    got = prep.rolling_origins(make(rows, "period string, ba_code string"), "2024-01-01", "2024-01-11").collect()
    # the eighth day has a full week before it; later origins miss an hour or run out of rows
    assert [str(r.origin) for r in sorted(got, key=lambda r: r.origin)] == ["2024-01-08 00:00:00", "2024-01-09 00:00:00"]


def test_peak_profile_and_forecast_bands_are_ordered(make):
    rows = [(f"2024-01-{1 + h // 24:02d} {h % 24:02d}:00", "A", 100.0 + (h * 13) % 37) for h in range(24 * 20)]
    f = forecast.forecast(make(rows, "period string, ba_code string, demand_mw double"), "2024-01-15")
    assert f.count() == 24 * 6 and f.where("q02 > q50 OR q50 > q98").count() == 0


def test_samples_keep_missing_hours_in_their_slots(make):
    from wattline.operators import prep

    rows = [("2024-01-01 00:00", "A", 1.0), ("2024-01-01 01:00", "A", 2.0), ("2024-01-01 02:00", "A", None), ("2024-01-01 03:00", "A", 4.0), ("2024-01-01 05:00", "A", 6.0), ("2024-02-01 00:00", "A", 7.0), ("2024-02-01 01:00", "A", 8.0)]
    d = make(rows, "period string, ba_code string, demand_mw double")
    plain = {str(r.period)[5:16]: (r.history, r.future) for r in prep.make_samples(d, 4, 1, min_enc=1).collect()}
    assert plain["01-01 03:00"] == ([1.0, 2.0, None, 4.0], [6.0]) and plain["01-01 01:00"] == ([1.0, 2.0], [None])
    found = {str(r.period)[5:16]: r for r in prep.hour_samples(d, 4, 3, min_enc=1).collect()}
    slots = {k: (r.history, r.future) for k, r in found.items()}
    assert slots == {
        "01-01 00:00": ([None, None, None, 1.0], [2.0, None, 4.0]), "01-01 01:00": ([None, None, 1.0, 2.0], [None, 4.0, None]), "01-01 02:00": ([None, 1.0, 2.0, None], [4.0, None, 6.0]),
        "01-01 03:00": ([1.0, 2.0, None, 4.0], [None, 6.0, None]), "02-01 00:00": ([None, None, None, 7.0], [8.0, None, None]),
    }
    assert all(r.history_mask == [x is not None for x in r.history] and r.future_mask == [x is not None for x in r.future] for r in found.values())
