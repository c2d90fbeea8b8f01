"""Golden values of single expressions."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from wattline.functions import calendar as cal
from wattline.functions import errors, hashing
from wattline.functions import measures as m


def value(spark, c):
    return spark.range(1).select(c.alias("v")).first().v


@pytest.mark.parametrize(
    "severe, events, oil, world, want",
    [(4483, 23329, 6843, 105042, 2.573), (5377, 23174, 23659, 113642, 4.402), (1, 2, None, 4, 0.0), (1, 0, 3, 4, 0.0)],
)
def test_geo_risk(spark, severe, events, oil, world, want):
    c = m.geo_risk(*[F.lit(x).cast("bigint") for x in (severe, events, oil, world)])
    assert round(value(spark, c), 3) == want


@pytest.mark.parametrize("temp, want", [(None, (0, 0)), (25.0, (0, 7)), (10.0, (8, 0))])
def test_degree_days(spark, temp, want):
    t = F.lit(temp).cast("double")
    assert (value(spark, m.hdd(t)), value(spark, m.cdd(t))) == want


def test_sunday_is_zero_and_weekend(spark):
    sunday = F.lit("2024-01-07").cast("timestamp")
    assert value(spark, cal.dow0(sunday)) == 0 and value(spark, cal.is_weekend(sunday))


@pytest.mark.parametrize("z, want", [(0, 1), (1.5, 2), (3, 5), (5, 9), (9, 9)])
def test_crisis_weight(spark, z, want):
    assert value(spark, m.crisis_weight([F.lit(float(-z)), F.lit(0.0)])) == want


def test_observed_holidays_2021():
    days = [d.strftime("%m-%d") for d in cal.holiday_dates(dt.date(2021, 1, 1), dt.date(2021, 12, 31))]
    assert days == "01-01 01-18 02-15 05-31 06-18 07-05 09-06 10-11 11-11 11-25 12-24 12-31".split()


def test_holidays_match_pandas():
    pd = pytest.importorskip("pandas")
    from pandas.tseries.holiday import USFederalHolidayCalendar

    want = [d.date() for d in USFederalHolidayCalendar().holidays("1990-01-01", "2040-12-31")]
    assert cal.holiday_dates(dt.date(1990, 1, 1), dt.date(2040, 12, 31)) == want
    assert pd is not None


def test_parsing(spark):
    assert value(spark, cal.parse_hour(F.lit("2025-03-15T14"))) == dt.datetime(2025, 3, 15, 14)
    assert value(spark, cal.parse_hour(F.lit("soon"))) is None
    assert value(spark, cal.parse_int_date(F.lit(20250315))) == dt.date(2025, 3, 15)


def test_clip_keeps_null(spark):
    assert value(spark, m.clip(F.lit(None).cast("double"), 0, 100)) is None
    assert value(spark, m.clip(F.lit(140.0), 0, 100)) == 100.0


def test_finite_or_null(spark):
    assert value(spark, m.finite_or_null(F.lit(float("nan")))) is None
    assert value(spark, m.finite_or_null(F.lit(float("-inf")))) is None
    assert value(spark, m.finite_or_null(F.lit(2.0))) == 2.0


def test_content_hash_normalises(spark):
    import hashlib

    want = hashlib.sha256("grid down|wire".encode()).hexdigest()
    assert value(spark, hashing.content_hash(F.lit(" Grid DOWN\n"), F.lit("wire"))) == want


def test_quantile_weights():
    assert errors.quantile_weights(2.0) == [2, 1.5, 1, 1, 1, 1.5, 2]


def test_percentage_error_masks_zeros(spark):
    df = spark.createDataFrame([(0.0, 5.0), (100.0, 90.0)], "a double, p double")
    assert df.agg(errors.mape(F.col("a"), F.col("p"))).first()[0] == pytest.approx(10.0)
    assert df.where("a = 0").agg(errors.mape(F.col("a"), F.col("p"))).first()[0] is None


def test_coverage_includes_ends(spark):
    df = spark.createDataFrame([(1.0, 1.0, 2.0), (2.0, 1.0, 2.0), (3.0, 1.0, 2.0)], "a double, lo double, hi double")
    assert df.agg(errors.coverage(F.col("a"), F.col("lo"), F.col("hi"))).first()[0] == pytest.approx(200 / 3)


def test_log_scale_matches_numpy(spark):
    import numpy as np

    x = [5.0, 1.0, 9.0, 0.0, 2.0, 7.0]
    got = spark.range(1).select(*[c.alias(n) for n, c in m.log1p_robust(F.array(*map(F.lit, x))).items()]).first()
    logs = np.log1p(x)
    assert got.centre == pytest.approx(np.median(logs))
    assert got.scale == pytest.approx(np.percentile(logs, 75) - np.percentile(logs, 25))


def test_alert_levels(spark):
    def level(mw, p):
        return value(spark, m.alert_level(F.lit(mw), F.lit(p), F.lit(50)))

    assert [level(60, 0.9), level(60, 0.7), level(10, 0.8), level(10, 0.1)] == ["RED", "YELLOW", "YELLOW", "GREEN"]
