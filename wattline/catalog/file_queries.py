"""Readers over archives that are first written from the shared tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from wattline.catalog import bindings as b
from wattline.catalog.registry import query
from wattline.lineage import fresh_dir
from wattline.schemas import WEATHER_VARIABLES
from wattline.sources import readings as rd
from wattline.sources import signals as sg


def _text_hour(c="period"):
    return F.date_format(c, "yyyy-MM-dd'T'HH")


def _pages(t, rows, endpoint, by):
    """Write records as archive pages of one day and area each, at most a few hundred records."""
    record = F.map_from_arrays(
        F.array(*[F.lit(c) for c in rows.columns if c not in by]), F.array(*[F.col(f"`{c}`").cast("string") for c in rows.columns if c not in by])
    )
    pages = rows.groupBy(*by).agg(F.collect_list(record).alias("data")).select(
        F.lit(endpoint).alias("endpoint"), F.create_map(F.lit("length"), F.lit("5000")).alias("params"),
        F.struct(F.size("data").cast("string").alias("total"), F.col("data")).alias("response"),
    )
    path = fresh_dir(t.spark, "pages")
    pages.write.json(path)
    return path


def _odd_value():
    """Every reading above 150 is written as text that is no number."""
    n = F.col("value")
    return F.when(n > 150, F.lit("n/a")).otherwise(n.cast("string"))


_ODD = "CASE WHEN value > 150 THEN NULL ELSE value END AS value"


@query("read_region_readings", f"SELECT period, respondent, 'Area ' || respondent AS respondent_name, type, 'Type ' || type AS type_name, {_ODD} FROM region_readings", "value")
def _(t):
    r = b.region_readings(t)
    rows = r.select(
        F.to_date("period").alias("day"), F.col("respondent").alias("area"), _text_hour().alias("period"), "respondent",
        F.concat(F.lit("Area "), "respondent").alias("respondent-name"), "type", F.concat(F.lit("Type "), "type").alias("type-name"), _odd_value().alias("value"),
    )
    path = _pages(t, rows, "region-data", ["day", "area"])
    return rd.normalize_region(rd.read_readings(t.spark, path, rd.REGION_FIELDS, page_per_file=False))


@query("read_fuel_readings", f"SELECT period, respondent, fueltype, {_ODD} FROM fuel_readings", "value")
def _(t):
    rows = b.fuel_readings(t).select(
        F.to_date("period").alias("day"), F.col("respondent").alias("area"), _text_hour().alias("period"), "respondent", "fueltype", _odd_value().alias("value")
    )
    path = _pages(t, rows, "fuel-type-data", ["day", "area"])
    return rd.normalize_fuel(rd.read_readings(t.spark, path, ["period", "respondent", "fueltype", "value"], page_per_file=False))


@query(
    "read_interchange_readings",
    f"SELECT period, fromba, toba, fromba AS respondent, 'Unknown' AS respondent_name, {_ODD} FROM interchange",
    "value",
)
def _(t):
    one = b.interchange(t).select(F.to_date("period").alias("day"), F.col("fromba").alias("area"), _text_hour().alias("period"), "fromba", "toba", _odd_value().alias("value"))
    # every record is archived three times: twice alike, as a re-run would, and once with a value that can't be read
    path = _pages(t, one.unionByName(one).unionByName(one.withColumn("value", F.lit("n/a"))), "interchange-data", ["day", "area"])
    return rd.normalize_interchange(rd.read_readings(t.spark, path, ["period", "fromba", "toba", "value"], page_per_file=False))


def _daily_csv(t, df):
    path = fresh_dir(t.spark, "csv")
    df.write.option("header", True).csv(path)
    return t.spark.read.option("header", True).csv(path)


@query("read_gas_prices", "SELECT period, series_name, process_name, value FROM gas_prices", "value")
def _(t):
    raw = _daily_csv(t, b.gas_prices(t).withColumnsRenamed({"series_name": "series-description", "process_name": "process-name"}).withColumn("extra", F.lit(1)))
    return rd.normalize_gas(raw)


@query("read_oil_prices", "SELECT period, series_name, value FROM oil_prices", "value")
def _(t):
    return rd.normalize_oil(_daily_csv(t, b.oil_prices(t).withColumnRenamed("series_name", "series")))


@query("read_nuclear_outages", "SELECT period, 100.0::DOUBLE AS capacity, NULL::DOUBLE AS outage, pct_outage FROM outages", "capacity pct_outage")
def _(t):
    o = b.outages(t).select("period", F.lit("100").alias("capacity"), F.lit("unknown").alias("outage"), F.col("pct_outage").alias("percentOutage"))
    return rd.normalize_outage(_daily_csv(t, o))


@query(
    "read_weather",
    """SELECT period, ba_code, temperature_2m, relative_humidity_2m, cloud_cover, c.latitude, c.longitude FROM weather w
       JOIN (SELECT * FROM (VALUES ('ERCO', 31.9686, -99.9018), ('PJM', 40.7128, -74.0060), ('CISO', 36.7783, -119.4179), ('MISO', 40.0, -89.0), ('NYIS', 43.0, -75.0),
             ('ISNE', 42.0, -71.5), ('SWPP', 38.0, -97.0), ('SOCO', 33.0, -86.0), ('TVA', 36.0, -86.0), ('DUK', 35.0, -80.0), ('FPL', 27.0, -81.0), ('BPAT', 45.0, -120.0)) v(code, latitude, longitude)) c
       ON c.code = w.ba_code""",
    "temperature_2m relative_humidity_2m cloud_cover latitude longitude",
)
def _(t):
    w = b.weather(t).select("*", F.lit(0.0).alias("wind_direction_10m"), F.lit(0.0).alias("precipitation"))
    # a page holds one day of an area: at most 24 entries per array
    hours = F.struct(F.date_format("period", "yyyy-MM-dd'T'HH:mm").alias("time"), *WEATHER_VARIABLES)
    pages = w.groupBy("ba_code", F.to_date("period").alias("day")).agg(F.collect_list(hours).alias("h")).select(
        "ba_code", F.struct(*[F.col(f"h.{c}").alias(c) for c in ["time", *WEATHER_VARIABLES]]).alias("hourly")
    )
    path = fresh_dir(t.spark, "weather")
    pages.write.json(path)
    return sg.read_weather(t.spark, path, page_per_file=False).select("period", "ba_code", "temperature_2m", "relative_humidity_2m", "cloud_cover", "latitude", "longitude")


@query(
    "read_domestic_events",
    "SELECT event_date, us_event_count, us_avg_goldstein, us_severe_conflict, 7::BIGINT AS us_crisis_events FROM events_daily",
    "us_avg_goldstein",
)
def _(t):
    raw = {new: old for old, new in sg.US_EVENT_NAMES.items()}
    e = b.events_daily(t)
    have = {c: F.col(c) for c in ("us_event_count", "us_avg_goldstein", "us_severe_conflict")}
    csv = e.select(F.date_format("event_date", "yyyyMMdd").alias("SQLDATE"), *[have.get(c, F.lit(7)).alias(raw[c]) for c in sg.US_EVENT_NAMES.values()])
    path = fresh_dir(t.spark, "events")
    csv.write.option("header", True).csv(path)
    return sg.read_events_us(t.spark, path).select("event_date", "us_event_count", "us_avg_goldstein", "us_severe_conflict", "us_crisis_events")


@query("read_global_events", "SELECT event_date, global_event_count, oil_region_event_count, 3::BIGINT AS global_very_negative FROM events_daily")
def _(t):
    raw = {new: old for old, new in sg.GLOBAL_EVENT_NAMES.items()}
    have = {c: F.col(c) for c in ("global_event_count", "oil_region_event_count")}
    csv = b.events_daily(t).select(
        F.date_format("event_date", "yyyyMMdd").alias("SQLDATE"), *[have.get(c, F.lit(3)).alias(raw[c]) for c in sg.GLOBAL_EVENT_NAMES.values()]
    )
    path = fresh_dir(t.spark, "events")
    csv.write.option("header", True).csv(path)
    return sg.read_events_global(t.spark, path).select("event_date", "global_event_count", "oil_region_event_count", "global_very_negative")


@query("read_state_news", "SELECT * FROM state_news", "avg_energy_tone min_energy_tone")
def _(t):
    path = fresh_dir(t.spark, "news")
    news = b.state_news(t)
    from wattline.schemas import STATE_NEWS_CSV

    order = [part.strip().split(" ")[0] for part in STATE_NEWS_CSV.split(",")]
    news.select(*order).write.option("header", True).csv(path)
    return sg.read_state_news(t.spark, path)


@query("read_risk_index", "SELECT * FROM risk_raw WHERE date >= DATE '2021-01-01'", "GPRD GPRD_ACT GPRD_THREAT GPRD_MA7")
def _(t):
    path = fresh_dir(t.spark, "index")
    b.risk_raw(t).write.option("header", True).csv(path)
    return sg.read_risk_index(t.spark, path)


@query("read_interchange_csvs", "SELECT period, fromba, toba, fromba AS respondent, 'Unknown' AS respondent_name, value, 'MWh' AS units FROM interchange", "value")
def _(t):
    path = fresh_dir(t.spark, "interchange")
    b.interchange(t).select(
        _text_hour().alias("period"), "fromba", "toba", F.col("value").cast("string").alias("value"), F.lit("MWh").alias("value-units"), F.lit("x").alias("foreign")
    ).write.option("header", True).csv(path)
    return rd.read_interchange_csvs(t.spark, path)


@query("region_dictionary", """SELECT * FROM (VALUES ('ERCO', 7::BIGINT), ('PJM', 7), ('CISO', 5), ('MISO', 7), ('NYIS', 5)) v(ba_code, n_names)
    JOIN (SELECT ba_code AS code, count(*) AS n_events FROM ev GROUP BY 1) ON code = ba_code""")
def _(t):
    from wattline.operators.regions import region_dim

    areas = b.events(t).groupBy(F.col("ba_code").alias("code")).agg(F.count(F.lit(1)).alias("n_events"))
    dim = region_dim(t.spark).select("ba_code", F.size("region_names").alias("n_names"))
    return dim.join(areas, F.col("code") == F.col("ba_code"))
