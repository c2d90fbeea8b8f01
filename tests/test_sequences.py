"""Chunked windows equal whole-key windows, whatever the gaps and chunk sizes."""

import datetime as dt
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from wattline.operators import features
from wattline.operators.sequences import chunk_plan, fill, number_rows, over_rows


def gappy(spark, seed, hours=900, keep=0.6, empty_days=True):
    rng = random.Random(seed)
    start = dt.datetime(2024, 1, 25)
    rows = []
    for ba in ("A", "B", "C"):
        share = keep if ba != "B" else 0.05
        for h in range(hours):
            at = start + dt.timedelta(hours=h)
            if empty_days and at.day % 9 == 0:
                continue
            if rng.random() < share:
                rows.append((at.strftime("%Y-%m-%d %H:%M:%S"), ba, None if rng.random() < 0.2 else float(rng.randint(0, 500))))
    return spark.createDataFrame(rows, "period string, ba_code string, x double").withColumn("period", F.col("period").cast("timestamp"))


def columns(w):
    return {
        "lag": F.lag("x", 24).over(w),
        "lead": F.lead("x", 11).over(w),
        "mean": F.avg("x").over(w.rowsBetween(-23, 0)),
        "total": F.sum("x").over(w.rowsBetween(-5, 11)),
    }


def same(a, b):
    cols = sorted(a.columns)
    left, right = (sorted(map(tuple, d.select(*cols).collect()), key=str) for d in (a, b))
    assert len(left) == len(right)
    for x, y in zip(left, right, strict=True):
        assert x == pytest.approx(y) if all(not isinstance(v, str) for v in x) else tuple(
            round(v, 9) if isinstance(v, float) else v for v in x
        ) == tuple(round(v, 9) if isinstance(v, float) else v for v in y)


@pytest.mark.parametrize("chunk_rows", [1, 7, 24, 40, 5000])
def test_over_rows_equals_whole_key_window(spark, chunk_rows):
    df = gappy(spark, chunk_rows).cache()
    whole = df.withColumns(columns(Window.partitionBy("ba_code").orderBy("period")))
    chunked = over_rows(df, ["ba_code"], "period", columns, back=24, ahead=11, chunk_rows=chunk_rows)
    same(whole, chunked)


def test_cells_larger_than_chunks(spark):
    df = gappy(spark, 3).cache()
    whole = df.withColumns(columns(Window.partitionBy("ba_code").orderBy("period")))
    month = F.date_trunc("month", "period")
    same(whole, over_rows(df, ["ba_code"], "period", columns, back=24, ahead=11, chunk_rows=3, cell_by=month))


def test_chunks_are_bounded(spark):
    df = gappy(spark, 5).cache()
    plan = chunk_plan(df, ["ba_code"], "period", back=24, chunk_rows=48)
    sizes = (
        df.withColumn("_cell", F.date_trunc("day", "period"))
        .join(plan, ["ba_code", "_cell"])
        .select("ba_code", F.explode("_homes").alias("c"))
        .groupBy("ba_code", "c")
        .count()
    )
    # a chunk, a day over, and a halo of at most the reach and a day
    assert sizes.agg(F.max("count")).first()[0] <= 48 + 24 + 24 + 24


def test_number_rows(spark):
    df = gappy(spark, 6)
    w = Window.partitionBy("ba_code").orderBy("period")
    same(df.withColumn("row_no", F.row_number().over(w) - 1), number_rows(df, ["ba_code"], "period", F.date_trunc("day", "period")))


@pytest.mark.parametrize("backward", [True, False])
def test_fill_across_slices(spark, backward):
    df = gappy(spark, 7).withColumn("x", F.when(F.col("period") < "2024-02-08", None).otherwise(F.col("x"))).cache()
    w = Window.partitionBy("ba_code").orderBy("period")
    steps = [F.last("x", True).over(w.rowsBetween(Window.unboundedPreceding, 0))]
    if backward:
        steps.append(F.first("x", True).over(w.rowsBetween(0, Window.unboundedFollowing)))
    same(df.withColumn("x", F.coalesce(*steps)), fill(df, ["x"], ["ba_code"], backward=backward, slice_by=F.date_trunc("day", "period")))


def test_fill_small_case(make):
    df = make([("2024-01-01 00:00", "A", None), ("2024-01-01 01:00", "A", 7.0), ("2024-02-09 00:00", "A", None), ("2024-01-01 00:00", "B", None)], "period string, ba_code string, x double")
    got = {(r.ba_code, str(r.period)): r.x for r in fill(df, ["x"], ["ba_code"]).collect()}
    assert got == {("A", "2024-01-01 00:00:00"): 7.0, ("A", "2024-01-01 01:00:00"): 7.0, ("A", "2024-02-09 00:00:00"): 7.0, ("B", "2024-01-01 00:00:00"): None}


def test_halo_window_equals_whole_window_without_gaps(spark):
    df = gappy(spark, 8, keep=2.0, empty_days=False).where("ba_code <> 'B'").withColumn("x", F.coalesce("x", F.lit(0.0))).cache()

    def build(w):
        return {"m": features.mean_over(w, "x", 168), "l": F.lag("x", 168).over(w)}

    same(df.withColumns(build(Window.partitionBy("ba_code").orderBy("period"))), features.halo_window(df, build, halo="169 hours"))


def test_lag_counts_rows_not_hours(make):
    df = make([("2024-01-01 04:00", "A", 4.0), ("2024-01-01 06:00", "A", 6.0)], "period string, ba_code string, demand_mw double")
    rows = {r.period.hour: r for r in features.add_lags(df, ns=(1,)).collect()}
    assert rows[6].demand_mw_lag_1h == 4.0 and rows[4].demand_mw_lag_1h is None
    timed = {r.period.hour: r for r in features.add_hour_lags(df, ns=(1, 2)).collect()}
    assert timed[6].demand_mw_lag_1h is None and timed[6].demand_mw_lag_2h == 4.0


def test_spikes_of_single_and_constant_rows(make):
    one = make([("2024-01-01 00:00", "A", 5.0)], "period string, ba_code string, demand_mw double")
    r = features.spikes(one).first()
    assert r.is_spike is False and r.spike_magnitude is None
    flat = make([(f"2024-01-01 {h:02d}:00", "A", 0.1) for h in range(24)], "period string, ba_code string, demand_mw double")
    assert features.spikes(flat).where("is_spike").count() == 0


def test_latest_rows(spark):
    df = gappy(spark, 9)
    got = features.latest_n(df, ["ba_code"], 5).groupBy("ba_code").count().collect()
    assert {r["count"] for r in got} == {5}


def test_keep_first(make):
    df = make([("k", 2, "late"), ("k", 1, "early"), ("j", 3, "only")], "key string, at int, v string", ())
    assert {r.key: r.v for r in features.keep_first(df, ["key"], ["at"]).collect()} == {"k": "early", "j": "only"}


def test_trailing_z_warm_up_and_flat(make):
    rows = [(f"2024-01-{d:02d}", "A", float(d % 4)) for d in range(1, 13)] + [(f"2024-01-{d:02d}", "F", 0.3) for d in range(1, 13)]
    df = make(rows, "day string, ba_code string, r double", ())
    out = features.trailing_z(df, ["r"], 30, "day", ["ba_code"]).orderBy("ba_code", "day").collect()
    moving = [r.r_z for r in out if r.ba_code == "A"]
    assert moving[:7] == [0.0] * 7 and moving[7] != 0.0
    assert all(abs(r.r_z) < 1e-9 for r in out if r.ba_code == "F")
