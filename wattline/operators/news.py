"""News events to hourly features per area."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattline.functions.hashing import content_hash
from wattline.functions.measures import ratio
from wattline.lineage import stage
from wattline.reference_data import CONFLICT_ROOT_CODES, ENERGY_THEME_PARTS

HOUR = 3600


def unnest(df: DataFrame, arr: str, name: str) -> DataFrame:
    return df.select("*", F.explode(arr).alias(name))


def conflict_events(events: DataFrame, country: str = "US", first_date: int = 20210101) -> DataFrame:
    """Conflict and protest events of one country from a first day on."""
    return events.where(
        (F.col("country_code") == country)
        & F.col("root_code").isin(CONFLICT_ROOT_CODES)
        & (F.col("sqldate").cast("int") >= first_date)
    )


def energy_articles(articles: DataFrame, place: str = "US", parts: list[str] = ENERGY_THEME_PARTS) -> DataFrame:
    """Articles located in ``place`` that carry any energy theme."""
    hit = F.lit(False)
    for part in parts:
        hit = hit | F.col("themes").contains(part)
    return articles.where(F.col("locations").contains(place) & hit)


def dedupe_articles(docs: DataFrame, id_col: str = "doc_id", headline: str = "text", source: str = "source") -> DataFrame:
    """The first article (lowest id) of every content hash.

    Only hash and id are shuffled for the grouping, and the smallest id combines map-side, so a story
    copied into a third of all rows does not gather anywhere.
    """
    hashed = docs.withColumn("content_hash", content_hash(F.col(headline), F.col(source)))
    first = hashed.groupBy("content_hash").agg(F.min(id_col).alias(id_col))
    return docs.join(first, id_col)


def risk_hourly(news: DataFrame) -> DataFrame:
    """Hourly index per area: sentiment, risk, disruptions, policy events and all events."""
    return (
        news.select(
            F.date_trunc("hour", "event_time").alias("hour"),
            F.explode(F.array_distinct("ba_codes")).alias("ba_code"),
            "sentiment_score",
            "risk_magnitude",
            "event_type",
        )
        .groupBy("hour", "ba_code")
        .agg(
            F.avg("sentiment_score").alias("avg_sentiment"),
            F.min("sentiment_score").alias("min_sentiment"),
            F.max("risk_magnitude").alias("max_risk"),
            F.count_if(F.col("event_type") == "SUPPLY_DISRUPTION").alias("disruption_count"),
            F.count_if(F.col("event_type") == "POLICY").alias("policy_count"),
            F.count(F.lit(1)).alias("total_events"),
        )
    )


def news_in_last(news: DataFrame, hours: int = 24) -> DataFrame:
    """Per area and hour h the totals of events in [h - hours, h], both ends included.

    Events are first added up per area and per hour they start to count in, apart from those exactly on
    the hour, which count in one hour more. Each of these totals, not each event, is then handed to the
    hours it serves, so the work grows with the hours of the calendar and not with events x hours.
    """
    first = F.date_trunc("hour", "event_time")
    on_hour = F.col("event_time") == first
    start = F.when(on_hour, first).otherwise(first + F.expr("INTERVAL 1 HOUR"))
    per_hour = (
        news.select(
            F.explode(F.array_distinct("ba_codes")).alias("ba_code"),
            start.alias("_start"),
            on_hour.alias("_on_hour"),
            "sentiment_score",
            "risk_magnitude",
            (F.col("event_type") == "SUPPLY_DISRUPTION").alias("_disruption"),
        )
        .groupBy("ba_code", "_start", "_on_hour")
        .agg(
            F.sum("sentiment_score").alias("_sum"),
            F.count("sentiment_score").alias("_scored"),
            F.max("risk_magnitude").alias("_risk"),
            F.count(F.lit(1)).alias("_n"),
            F.bool_or("_disruption").alias("_disrupted"),
        )
    )
    steps = F.sequence(F.lit(0), F.when(F.col("_on_hour"), hours).otherwise(hours - 1))
    served = per_hour.select("*", F.explode(steps).alias("_step")).withColumn(
        "period", F.timestamp_seconds(F.unix_timestamp("_start") + F.col("_step") * HOUR)
    )
    return served.groupBy("period", "ba_code").agg(
        ratio(F.sum("_sum"), F.sum("_scored").cast("double")).alias("news_sentiment_24h"),
        F.max("_risk").alias("news_max_risk_24h"),
        F.sum("_n").alias("news_event_count_24h"),
        F.bool_or("_disrupted").alias("supply_disruption_24h"),
    )


def news_rollup(news: DataFrame, spine: DataFrame, hours: int = 24) -> DataFrame:
    """Trailing news features for every hour of the spine, with neutral values where no news fell."""
    return spine.join(news_in_last(news, hours), ["period", "ba_code"], "left").select(
        "period",
        "ba_code",
        F.coalesce("news_sentiment_24h", F.lit(0.0)).alias("news_sentiment_24h"),
        F.coalesce("news_max_risk_24h", F.lit(0.0)).alias("news_max_risk_24h"),
        F.coalesce("news_event_count_24h", F.lit(0)).alias("news_event_count_24h"),
        F.coalesce("supply_disruption_24h", F.lit(False)).alias("supply_disruption_24h"),
    )


def join_news(panel: DataFrame, news_hourly: DataFrame) -> DataFrame:
    return panel.join(news_hourly, ["period", "ba_code"], "left")


def range_window(df: DataFrame, by: list[str], c: str, hours: int = 24, time: str = "period") -> DataFrame:
    """Per key and hour the sum and number of values in the closed range [t - hours, t] of hourly rows.

    Each hourly total is handed to the hours it serves; only hours present in ``df`` are kept.
    """
    totals = df.groupBy(*by, time).agg(F.sum(c).alias("_s"), F.count(c).alias("_n"))
    served = totals.select("*", F.explode(F.sequence(F.lit(0), F.lit(hours))).alias("_h")).select(
        *by, F.timestamp_seconds(F.unix_timestamp(time) + F.col("_h") * HOUR).alias(time), "_s", "_n"
    )
    ranges = served.groupBy(*by, time).agg(F.sum("_s").alias(f"{c}_sum_{hours}h"), F.sum("_n").alias(f"{c}_n_{hours}h"))
    return totals.select(*by, time).join(ranges, [*by, time])


def decayed_hours(news: DataFrame, values: dict[str, Column], half_life: float, reach: int) -> DataFrame:
    """Per area and hour the sums of values of events up to ``reach`` hours old, halved every ``half_life`` hours of true age.

    An event counts from the first full hour that isn't before it. Sums are made per area and that hour, with the part of an
    hour in between already decayed; only these totals are handed to the hours they serve.
    """
    rate = math.log(2) / half_life
    first = F.date_trunc("hour", "event_time")
    on_hour = F.col("event_time") == first
    start = F.when(on_hour, first).otherwise(first + F.expr("INTERVAL 1 HOUR"))
    aged = F.exp((F.unix_micros("event_time") - F.unix_micros(start)) / (HOUR * 1e6) * rate)
    per_hour = (
        news.select(F.explode(F.array_distinct("ba_codes")).alias("ba_code"), start.alias("_start"), on_hour.alias("_on"), *[(v * aged).alias(n) for n, v in values.items()])
        .groupBy("ba_code", "_start", "_on")
        .agg(*[F.sum(n).alias(n) for n in values])
    )
    served = per_hour.select("*", F.explode(F.sequence(F.lit(0), F.when(F.col("_on"), reach).otherwise(reach - 1))).alias("_h")).select(
        "ba_code",
        F.timestamp_seconds(F.unix_timestamp("_start") + F.col("_h") * HOUR).alias("period"),
        *[(F.col(n) * F.exp(F.col("_h") * F.lit(-rate))).alias(n) for n in values],
    )
    return served.groupBy("period", "ba_code").agg(*[F.sum(n).alias(n) for n in values])


def decayed_mean(
    news: DataFrame,
    half_life: float = 24.0,
    reach: int = 168,
    value: str = "sentiment_score",
    name: str = "decayed_sentiment",
) -> DataFrame:
    """Exponentially decaying mean of the values of events up to ``reach`` hours old, per area and hour.

    The weight halves every ``half_life`` hours; an event counts from the first full hour after it.
    """
    known = F.when(F.col(value).isNotNull(), 1.0)
    sums = decayed_hours(news, {"_s": F.col(value), "_n": known}, half_life, reach)
    return sums.select("period", "ba_code", ratio(F.col("_s"), F.col("_n")).alias(name), F.col("_n").alias("decayed_volume"))


def risk_index(
    news: DataFrame, weights: dict[str, float] | None = None, half_life: float = 24.0, reach: int = 168
) -> DataFrame:
    """Risk 0..100 per area and hour: negative news, weighted by severity and type, decaying with time.

    Raw risk adds ``-sentiment x risk_magnitude x type weight`` of negative events; it is scaled by the
    smallest and largest raw value of the whole table.
    """
    weights = weights or {"SUPPLY_DISRUPTION": 1.0, "PRICE": 0.6, "POLICY": 0.4, "DEMAND": 0.3}
    by_type: Column = F.lit(0.0)
    for kind, weight in weights.items():
        by_type = F.when(F.col("event_type") == kind, F.lit(weight)).otherwise(by_type)
    harm = F.greatest(-F.col("sentiment_score"), F.lit(0.0)) * F.col("risk_magnitude") * by_type
    # the raw table is read for its span and again for the rows
    raw = stage(decayed_hours(news, {"raw_risk": harm}, half_life, reach), "raw_risk")
    span = raw.agg(F.struct(F.min("raw_risk").alias("lo"), F.max("raw_risk").alias("hi"))).scalar()
    return raw.select("*", span.alias("_span")).select(
        "period",
        "ba_code",
        "raw_risk",
        (ratio(F.col("raw_risk") - F.col("_span.lo"), F.col("_span.hi") - F.col("_span.lo")) * 100).alias("risk_index"),
    )


def tag_articles(
    docs: DataFrame, keywords: list[tuple[str, str, str]], id_col: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Event type and fuels of each article by keyword lists over its whole text.

    ``keywords`` holds (kind, label, word) with kind ``type`` or ``fuel``. The first type in list order
    whose word occurs wins; every fuel that occurs is kept.
    """
    words = docs.select(id_col, F.array_distinct(F.split(F.lower(text), r"[^\p{L}]+")).alias("_words"))
    hit = {}
    for kind, label, word in keywords:
        hit.setdefault((kind, label), []).append(word)
    tagged = {
        key: F.arrays_overlap(F.col("_words"), F.array(*[F.lit(w) for w in ws])) for key, ws in hit.items()
    }
    event_type = F.coalesce(*[F.when(cond, F.lit(label)) for (kind, label), cond in tagged.items() if kind == "type"])
    fuels = F.array_compact(
        F.array(*[F.when(cond, F.lit(label)) for (kind, label), cond in tagged.items() if kind == "fuel"])
    )
    return words.select(id_col, event_type.alias("event_type"), fuels.alias("fuel_types"))


# --- selectors ---------------------------------------------------------------------------------


def nlp_features(news_hourly: DataFrame, ba: str, start: str, end: str) -> DataFrame:
    """Hourly news features of one area in [start, end)."""
    return news_hourly.where(
        (F.col("ba_code") == ba)
        & (F.col("period") >= F.lit(start).cast("timestamp"))
        & (F.col("period") < F.lit(end).cast("timestamp"))
    )


def recent_alerts(news: DataFrame, now: Column, hours: int = 24, min_risk: float = 0.7) -> DataFrame:
    """High-risk events of the last hours with a description."""
    recent = F.col("event_time").between(now - F.expr(f"INTERVAL {int(hours)} HOURS"), now)
    return news.where(recent & (F.col("risk_magnitude") >= min_risk)).select(
        "event_id",
        "event_time",
        "event_type",
        "risk_magnitude",
        F.concat_ws(" ", "event_type", F.lit("affecting"), F.concat_ws(",", "ba_codes")).alias("description"),
    )


def risk_map(risk: DataFrame) -> DataFrame:
    """Latest risk index of every area."""
    return risk.groupBy("ba_code").agg(
        F.max("period").alias("period"), F.max_by("risk_index", "period").alias("risk_index")
    )
