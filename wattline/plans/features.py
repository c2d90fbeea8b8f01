"""The feature table: panel, broadcast signals, one window pass, patches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wattline.functions.calendar import dow0, hour_of, is_us_holiday, is_weekend, month_of
from wattline.functions.measures import cdd, default0, geo_risk, hdd, rate, supply_margin
from wattline.operators.aggregates import fuel_profiles, news_daily
from wattline.operators.features import PANEL_BACK, add_panel_windows, trailing_z
from wattline.operators.joins import flag_dates, join_daily, join_fuel, join_weather, patch, patch_daily
from wattline.operators.quality import only_bas
from wattline.operators.sequences import chunk_plan
from wattline.reference_data import FEATURE_BAS

EVENT_COLUMNS = [
    "us_avg_goldstein", "us_min_goldstein", "us_event_count", "us_severe_conflict",
    "oil_region_event_count", "global_event_count",
]

# fixed values: the columns of the feature table, in its order
FEATURE_COLUMNS = [
    "period", "ba_code", "demand_mw", "hour_of_day", "day_of_week", "month", "is_weekend", "is_holiday",
    "demand_lag_1h", "demand_lag_24h", "demand_lag_168h", "demand_rolling_24h", "demand_rolling_168h",
    "demand_std_24h", "temperature_c", "humidity_pct", "wind_speed_kmh", "cloud_cover_pct", "solar_radiation",
    "hdd", "cdd", "generation_mw", "supply_demand_gap", "gas_pct", "renewable_pct", "interchange_mw",
    "gas_price", "oil_price", "gas_price_change_7d", "nuclear_outage_pct", "sentiment_mean_24h",
    "sentiment_min_24h", "event_count_24h", "geo_risk_index", "is_spike", "spike_magnitude",
    "supply_margin_pct", "gas_pct_delta_24h", "gas_price_volatility_7d",
]


def demand_rows(demand: DataFrame, start: str | None, end: str | None, bas: list[str]) -> DataFrame:
    """Demand of the listed areas in [start, end), and before it as many rows of each area as its windows reach.

    Windows count rows, so with missing hours they reach back further than their length in time. Rows are
    counted per area and day; the days are taken that hold the last ``PANEL_BACK`` rows before ``start``.
    """
    panel = only_bas(demand, bas)
    if end is not None:
        panel = panel.where(F.col("period") < F.lit(end).cast("timestamp"))
    if start is None:
        return panel
    begin = F.lit(start).cast("timestamp")
    days = panel.where(F.col("period") < begin).groupBy("ba_code", F.to_date("period").alias("_day")).agg(F.count(F.lit(1)).alias("_n"))
    later = Window.partitionBy("ba_code").orderBy(F.desc("_day")).rowsBetween(Window.unboundedPreceding, -1)
    needed = days.withColumn("_later", F.coalesce(F.sum("_n").over(later), F.lit(0))).where(F.col("_later") < PANEL_BACK)
    first = needed.groupBy(F.col("ba_code").alias("_area")).agg(F.min("_day").cast("timestamp").alias("_first"))
    bounded = panel.join(first, F.col("ba_code") == F.col("_area"), "left")
    return bounded.where(F.col("period") >= F.least(begin, F.coalesce("_first", begin))).select(panel.columns)


def base_panel(
    demand: DataFrame,
    fuel_mix: DataFrame,
    weather: DataFrame,
    events: DataFrame,
    gas: DataFrame,
    oil: DataFrame,
    outages: DataFrame,
    start: str | None = None,
    end: str | None = None,
    bas: list[str] = FEATURE_BAS,
) -> DataFrame:
    """Hourly rows with every joined signal, before any window.

    The three hourly tables share the key (period, ba_code), so they are shuffled once by it. All daily
    tables are reduced to a row per day and broadcast.
    """
    panel = demand_rows(demand, start, end, bas)
    panel = join_weather(join_fuel(panel, fuel_mix), weather)
    panel = join_daily(panel, events, EVENT_COLUMNS, date="event_date")
    panel = join_daily(panel, gas, {"value": "gas_price"}, where=F.col("process_name") == "Spot Price")
    panel = join_daily(panel, oil, {"value": "oil_price"})
    panel = join_daily(panel, outages, {"pct_outage": "nuclear_outage_pct"})
    p, t = F.col("period"), F.col("temperature_c")
    return panel.withColumns(
        {
            "hour_of_day": hour_of(p),
            "day_of_week": dow0(p),
            "month": month_of(p),
            "is_weekend": is_weekend(p),
            "supply_margin_pct": supply_margin(F.col("generation_mw"), F.col("demand_mw")),
            "hdd": hdd(t),
            "cdd": cdd(t),
            "sentiment_mean_24h": default0(F.col("us_avg_goldstein")),
            "sentiment_min_24h": default0(F.col("us_min_goldstein")),
            "event_count_24h": default0(F.col("us_event_count")),
            "geo_risk_index": geo_risk(
                F.col("us_severe_conflict"), F.col("us_event_count"),
                F.col("oil_region_event_count"), F.col("global_event_count"),
            ),
        }
    ).drop(*EVENT_COLUMNS)


def build_features(
    demand: DataFrame,
    fuel_mix: DataFrame,
    weather: DataFrame,
    events: DataFrame,
    gas: DataFrame,
    oil: DataFrame,
    outages: DataFrame,
    holidays: DataFrame | None = None,
    start: str | None = None,
    end: str | None = None,
    bas: list[str] = FEATURE_BAS,
) -> DataFrame:
    """The feature table in one plan.

    ``start`` and ``end`` bound the result; as many rows before ``start`` are read as the windows of the first
    rows reach, so they equal those of the unbounded run. Without ``holidays`` the federal rule flags any year.
    """
    base = base_panel(demand, fuel_mix, weather, events, gas, oil, outages, start, end, bas)
    # chunks are planned on the demand rows alone, so that counting them runs none of the joins
    chunks = chunk_plan(demand_rows(demand, start, end, bas), ["ba_code"], "period", back=PANEL_BACK)
    out = add_panel_windows(base, plan=chunks)
    if start is not None:
        out = out.where(F.col("period") >= F.lit(start).cast("timestamp"))
    flagged = out.withColumn("is_holiday", is_us_holiday(F.to_date("period"))) if holidays is None else flag_dates(out, holidays)
    return flagged.select(*FEATURE_COLUMNS)


def news_zscores(state_news: DataFrame) -> DataFrame:
    """Area-day article rates scored against the thirty days before."""
    daily = news_daily(state_news)
    rated = daily.withColumns(
        {
            "grid_stress": rate(F.col("grid_stress_articles"), F.col("total_energy_articles")),
            "gas_pipeline": rate(F.col("gas_pipeline_articles"), F.col("total_energy_articles")),
            "electricity_buzz": rate(F.col("electricity_articles"), F.col("total_energy_articles")),
        }
    )
    scored = trailing_z(rated, ["grid_stress", "gas_pipeline", "electricity_buzz"], 30, "article_date", ["ba_code"], suffix="zscore")
    return scored.select(
        "ba_code",
        "article_date",
        "grid_stress_zscore",
        "gas_pipeline_zscore",
        "electricity_buzz_zscore",
        F.coalesce("avg_energy_tone", F.lit(0.0)).alias("energy_tone_regional"),
    )


def risk_zscore(index: DataFrame) -> DataFrame:
    """Smoothed risk index and its distance from the ninety days before (one row a day)."""
    scored = trailing_z(index, ["GPRD_MA7"], 90, "date", suffix="z")
    return scored.select("date", F.coalesce("GPRD_MA7", F.lit(0.0)).alias("gpr_index"), F.col("GPRD_MA7_z").alias("gpr_zscore"))


def add_signals(
    features: DataFrame,
    fuel_mix: DataFrame,
    state_news: DataFrame,
    risk_index: DataFrame,
    seasonal: DataFrame | None = None,
    train_end: str | None = None,
) -> DataFrame:
    """Patch fuel profiles, news scores, risk index and seasonal parts onto the feature table."""
    profiles = fuel_profiles(fuel_mix, train_end)
    out = patch(features, profiles, ["ba_code"], ["gas_sensitivity", "renewable_sensitivity", "nuclear_sensitivity"], bounded=True)
    out = patch_daily(
        out,
        news_zscores(state_news),
        ["grid_stress_zscore", "gas_pipeline_zscore", "electricity_buzz_zscore", "energy_tone_regional"],
        "article_date",
        ["ba_code"],
    )
    out = patch_daily(out, risk_zscore(risk_index), ["gpr_index", "gpr_zscore"], "date")
    if seasonal is not None:
        out = patch_daily(out, seasonal, ["prophet_trend", "prophet_weekly", "prophet_yearly"], "date", ["ba_code"])
    return out
