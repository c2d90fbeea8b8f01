"""Weather, daily event, news and risk-index files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wattline.functions.calendar import parse_int_date
from wattline.reference_data import BA_CENTRES
from wattline.schemas import (
    EVENTS_GLOBAL_CSV,
    EVENTS_US_CSV,
    RISK_INDEX_CSV,
    STATE_NEWS_CSV,
    WEATHER_JSON,
    WEATHER_VARIABLES,
)
from wattline.sources.readings import to_hour

# fixed values: raw column names of the event files
US_EVENT_NAMES = {
    "event_count": "us_event_count", "avg_goldstein": "us_avg_goldstein", "min_goldstein": "us_min_goldstein",
    "max_goldstein": "us_max_goldstein", "std_goldstein": "us_std_goldstein", "avg_tone": "us_avg_tone",
    "min_tone": "us_min_tone", "total_mentions": "us_total_mentions", "total_articles": "us_total_articles",
    "severe_conflict_count": "us_severe_conflict", "moderate_conflict_count": "us_moderate_conflict",
    "tension_count": "us_tension_count", "cooperation_count": "us_cooperation_count",
    "very_negative_article_count": "us_very_negative", "crisis_event_count": "us_crisis_events",
}
GLOBAL_EVENT_NAMES = {
    "global_event_count": "global_event_count", "global_avg_goldstein": "global_avg_goldstein",
    "global_min_goldstein": "global_min_goldstein", "global_std_goldstein": "global_std_goldstein",
    "global_avg_tone": "global_avg_tone", "global_total_articles": "global_total_articles",
    "oil_region_event_count": "oil_region_event_count", "oil_region_avg_goldstein": "oil_region_avg_goldstein",
    "severe_conflict_global": "global_severe_conflict", "moderate_conflict_global": "global_moderate_conflict",
    "crisis_event_count": "global_crisis_events", "very_negative_article_count": "global_very_negative",
}


def centre_of(ba_code: Column) -> tuple[Column, Column]:
    """Latitude and longitude of an area's centre point."""
    lat = F.create_map(*[x for k, (la, _) in BA_CENTRES.items() for x in (F.lit(k), F.lit(la))])
    lon = F.create_map(*[x for k, (_, lo) in BA_CENTRES.items() for x in (F.lit(k), F.lit(lo))])
    return F.try_element_at(lat, ba_code), F.try_element_at(lon, ba_code)


def explode_weather(raw: DataFrame) -> DataFrame:
    """One struct of parallel arrays per area to one row per hour, with the centre point."""
    lat, lon = centre_of(F.col("ba_code"))
    zipped = F.arrays_zip("hourly.time", *[f"hourly.{v}" for v in WEATHER_VARIABLES])
    rows = raw.select("ba_code", F.explode(zipped).alias("h"))
    return rows.select(
        to_hour(F.regexp_replace("h.time", r"(T\d\d):00$", "$1")).alias("period"),
        "ba_code",
        lat.alias("latitude"),
        lon.alias("longitude"),
        *[F.col(f"h.{v}").alias(v) for v in WEATHER_VARIABLES],
    )


def read_weather(spark: SparkSession, path: str, page_per_file: bool = True) -> DataFrame:
    return explode_weather(spark.read.schema(WEATHER_JSON).option("multiLine", page_per_file).json(path))


def _event_rows(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.select(
        parse_int_date(F.col("SQLDATE")).alias("event_date"), *[F.col(raw).alias(name) for raw, name in names.items()]
    )


def read_events_us(spark: SparkSession, path: str) -> DataFrame:
    return _event_rows(spark.read.schema(EVENTS_US_CSV).option("header", True).option("enforceSchema", False).csv(path), US_EVENT_NAMES)


def read_events_global(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.schema(EVENTS_GLOBAL_CSV).option("header", True).option("enforceSchema", False).csv(path)
    return _event_rows(raw, GLOBAL_EVENT_NAMES)


def read_state_news(spark: SparkSession, path: str) -> DataFrame:
    """State-by-day energy news."""
    return spark.read.schema(STATE_NEWS_CSV).option("header", True).option("enforceSchema", False).csv(path)


def read_risk_index(spark: SparkSession, path: str, since: str = "2021-01-01") -> DataFrame:
    """Daily risk index from ``since`` on; spreadsheets are expected as CSV."""
    raw = spark.read.schema(RISK_INDEX_CSV).option("header", True).option("enforceSchema", False).csv(path)
    return risk_index_rows(raw, since)


def risk_index_rows(raw: DataFrame, since: str = "2021-01-01") -> DataFrame:
    return raw.where(F.col("date") >= F.lit(since).cast("date")).select("date", "GPRD", "GPRD_ACT", "GPRD_THREAT", "GPRD_MA7")
