"""Grouped summaries of demand, prices, events and news."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattline.functions.calendar import season
from wattline.functions.measures import ratio
from wattline.operators.joins import map_states
from wattline.operators.quality import windows_at
from wattline.operators.ranks import percentiles
from wattline.reference_data import CRISIS_WINDOWS, THEME_GROUPS


def daily_summary(panel: DataFrame) -> DataFrame:
    """Average, peak, lowest and spread of demand per day and area."""
    return panel.groupBy(F.window("period", "1 day").start.alias("day"), "ba_code").agg(
        F.avg("demand_mw").alias("avg_demand"),
        F.max("demand_mw").alias("peak_demand"),
        F.min("demand_mw").alias("min_demand"),
        F.stddev_samp("demand_mw").alias("stddev_demand"),
    )


def daily_mean(panel: DataFrame, c: str = "demand_mw") -> DataFrame:
    return (
        panel.where(F.col(c).isNotNull()).groupBy("ba_code", F.to_date("period").alias("date")).agg(F.avg(c).alias("y"))
    )


NEWS_COUNTS = [
    "total_energy_articles", "grid_stress_articles", "gas_pipeline_articles",
    "electricity_articles", "nuclear_articles", "renewable_articles",
]


def news_daily(news: DataFrame) -> DataFrame:
    """State-day news to area-day news: counts summed, tone averaged, lowest tone kept."""
    return (
        map_states(news)
        .groupBy("ba_code", "article_date")
        .agg(
            *[F.sum(c).alias(c) for c in NEWS_COUNTS],
            F.avg("avg_energy_tone").alias("avg_energy_tone"),
            F.min("min_energy_tone").alias("min_energy_tone"),
        )
    )


def fuel_profiles(fuel_mix: DataFrame, train_end: str | None = None) -> DataFrame:
    """Fuel sensitivity of each area. ``train_end`` keeps later rows out, to avoid leakage."""
    if train_end is not None:
        fuel_mix = fuel_mix.where(F.col("period") < F.lit(train_end).cast("timestamp"))
    nuclear = ratio(F.coalesce("nuclear_mw", F.lit(0.0)), F.col("total_mw"))
    return fuel_mix.groupBy("ba_code").agg(
        F.coalesce(F.avg("gas_pct") / 100, F.lit(0.0)).alias("gas_sensitivity"),
        F.coalesce(F.avg("renewable_pct") / 100, F.lit(0.0)).alias("renewable_sensitivity"),
        F.coalesce(F.avg(nuclear), F.lit(0.0)).alias("nuclear_sensitivity"),
    )


def effect_by_flag(df: DataFrame, flag: str = "is_holiday", c: str = "demand_mw") -> DataFrame:
    return df.groupBy("ba_code", flag).agg(F.avg(c).alias("avg_demand"), F.count(c).alias("n_hours"))


def signal_timeline(df: DataFrame, start: str, end: str, cols: list[str]) -> DataFrame:
    """Daily means of signals inside one closed window."""
    inside = F.col("period").between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp"))
    return df.where(inside).groupBy(F.to_date("period").alias("date")).agg(*[F.avg(c).alias(c) for c in cols])


def event_tiers_daily(
    events: DataFrame,
    cuts: tuple[float, float, float, float] = (-7.0, -4.0, 0.0, 4.0),
    very_negative: float = -5.0,
    date: str = "event_date",
) -> DataFrame:
    """Daily roll-up of single events on the -10..+10 conflict scale.

    ``cuts`` are severe, moderate, tension and cooperation, in rising order: severe at or under the first,
    moderate up to the second, tension under the third, cooperation from the fourth on. A crisis event is
    severe and told in a very negative tone. The cut-offs are parameters because no source fixes them.
    """
    severe, moderate, tension, cooperation = cuts
    g, tone = F.col("goldstein"), F.col("tone")
    return events.groupBy(date).agg(
        F.count(F.lit(1)).alias("event_count"),
        F.avg(g).alias("avg_goldstein"),
        F.min(g).alias("min_goldstein"),
        F.max(g).alias("max_goldstein"),
        F.stddev_samp(g).alias("std_goldstein"),
        F.avg(tone).alias("avg_tone"),
        F.min(tone).alias("min_tone"),
        F.sum("mentions").alias("total_mentions"),
        F.sum("articles").alias("total_articles"),
        F.count_if(g <= severe).alias("severe_conflict"),
        F.count_if((g > severe) & (g <= moderate)).alias("moderate_conflict"),
        F.count_if((g > moderate) & (g < tension)).alias("tension_count"),
        F.count_if(g >= cooperation).alias("cooperation_count"),
        F.count_if(tone <= very_negative).alias("very_negative"),
        F.count_if((g <= severe) & (tone <= very_negative)).alias("crisis_events"),
    )


def theme_counts(articles: DataFrame, groups: dict[str, list[str]] = THEME_GROUPS) -> DataFrame:
    """Articles per state and day that carry a theme of each group, with tone statistics."""
    themes = F.split("themes", ";")
    return articles.groupBy("state_code", "article_date").agg(
        F.count(F.lit(1)).alias("total_energy_articles"),
        *[
            F.count_if(F.arrays_overlap(themes, F.array(*[F.lit(t) for t in names]))).alias(f"{group}_articles")
            for group, names in groups.items()
        ],
        F.avg("tone").alias("avg_energy_tone"),
        F.min("tone").alias("min_energy_tone"),
        F.stddev_samp("tone").alias("std_energy_tone"),
    )


def _corr(x: Column, y: Column) -> Column:
    """Correlation, NULL where either side does not vary (Spark's own divides by zero there, an error in ANSI mode)."""
    both = x.isNotNull() & y.isNotNull()
    r = ratio(F.covar_pop(x, y), F.stddev_pop(F.when(both, x)) * F.stddev_pop(F.when(both, y)))
    return F.when(~F.isnan(r), r)


def group_corr(df: DataFrame, xs: list[str], y: str = "demand_mw", by: list[str] | None = None) -> DataFrame:
    """Correlation of each signal with ``y`` per area."""
    return df.groupBy(*(by or ["ba_code"])).agg(*[_corr(F.col(x), F.col(y)).alias(f"corr_{x}") for x in xs])


def separation(daily: DataFrame, col: str, windows: list[tuple] = CRISIS_WINDOWS, date: str = "date") -> DataFrame:
    """Days, mean and spread of a signal per window and for normal days, with the distance from normal."""
    labels = F.transform(windows_at(F.col(date), windows), lambda w: w["window"])
    labelled = daily.select(
        F.explode(F.when(F.size(labels) > 0, labels).otherwise(F.array(F.lit("normal")))).alias("window"),
        F.col(col).alias("_x"),
    )
    # one row per window from here on
    stats = labelled.groupBy("window").agg(
        F.count("_x").alias("n_days"), F.avg("_x").alias("mean"), F.stddev_samp("_x").alias("std")
    )
    normal = F.max(F.when(F.col("window") == "normal", F.col("mean"))).over(Window.partitionBy())
    return stats.withColumn("from_normal", F.col("mean") - normal)


def yoy_change(
    daily: DataFrame, col: str, windows: list[tuple] = CRISIS_WINDOWS, by: list[str] | None = None, date: str = "date"
) -> DataFrame:
    """Mean in each window, in the same days a year before, and the change in percent."""
    by = by or ["ba_code"]
    now = F.transform(windows_at(F.col(date), windows), lambda w: F.struct(w["window"], F.lit(0).alias("ago")))
    shifted = F.add_months(F.col(date), 12)
    ago = F.transform(windows_at(shifted, windows), lambda w: F.struct(w["window"], F.lit(1).alias("ago")))
    placed = daily.select(*by, F.col(col).alias("_x"), F.explode(F.concat(now, ago)).alias("_w"))
    means = placed.groupBy(*by, F.col("_w.window").alias("window")).agg(
        F.avg(F.when(F.col("_w.ago") == 0, F.col("_x"))).alias("in_window"),
        F.avg(F.when(F.col("_w.ago") == 1, F.col("_x"))).alias("year_before"),
    )
    change = ratio(F.col("in_window") - F.col("year_before"), F.col("year_before")) * 100
    return means.withColumn("change_pct", change)


def demand_z(daily: DataFrame, c: str = "y", by: list[str] | None = None) -> DataFrame:
    """Distance of each day from its area's mean in its spreads (statistics joined, not windowed)."""
    by = by or ["ba_code"]
    stats = daily.groupBy(*by).agg(F.avg(c).alias("_m"), F.stddev_samp(c).alias("_s"))
    return daily.join(stats, by).withColumn("demand_z", ratio(F.col(c) - F.col("_m"), F.col("_s"))).drop("_m", "_s")


def extreme_day_test(
    daily: DataFrame, stress: str = "grid_stress", q: float = 0.95, means: tuple[str, ...] = ("demand_z", "tone")
) -> DataFrame:
    """Mean demand and tone on days above the stress percentile of their area against all other days."""
    cut = percentiles(daily, ["ba_code"], stress, {"_cut": q}, few_keys=True)
    marked = daily.join(F.broadcast(cut), "ba_code").withColumn("is_extreme", F.col(stress) > F.col("_cut"))
    return marked.groupBy("ba_code", "is_extreme").agg(
        F.count(F.lit(1)).alias("n_days"), *[F.avg(c).alias(f"avg_{c}") for c in means]
    )


def spike_catalogue(panel: DataFrame, q: float = 0.95, c: str = "demand_mw", temp: str = "temperature_c") -> DataFrame:
    """Hours above the area's percentile per month: number, share of the month's hours, mean temperature."""
    cut = percentiles(panel, ["ba_code"], c, {"_cut": q}, few_keys=True)
    high = F.col(c) > F.col("_cut")
    return (
        panel.join(F.broadcast(cut), "ba_code")
        .groupBy("ba_code", F.month("period").alias("month"))
        .agg(
            F.count_if(high).alias("n_spikes"),
            F.avg(high.cast("double")).alias("spike_share"),
            F.avg(F.when(high, F.col(temp))).alias("avg_spike_temp"),
        )
    )


def weighted_state_avg(index: DataFrame, weights: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """State index to areas: mean weighted by each state's share of the area's load."""
    return (
        index.join(weights, "state_code")
        .groupBy("ba_code", *by)
        .agg(ratio(F.sum(F.col(value) * F.col("weight")), F.sum(F.when(F.col(value).isNotNull(), F.col("weight")))).alias("weighted"))
    )


def uncertainty_daily(docs: DataFrame, lexicons: dict[str, list[str]], text: str = "text", date: str = "date") -> DataFrame:
    """Share of each day's articles with a hit in every term list; intensity is their number."""
    words = F.array_distinct(F.split(F.lower(text), r"[^\p{L}]+"))
    all_lists = F.lit(True)
    for terms in lexicons.values():
        all_lists = all_lists & F.arrays_overlap(F.col("_words"), F.array(*[F.lit(t) for t in terms]))
    return (
        docs.select(date, words.alias("_words"))
        .groupBy(date)
        .agg(F.avg(all_lists.cast("double")).alias("uncertainty"), F.count(F.lit(1)).alias("intensity"))
    )


def policy_sensitivity(panel_daily: DataFrame, index: DataFrame, y: str = "y", x: str = "uncertainty") -> DataFrame:
    """Correlation of day-over-day demand change with day-over-day index change per area."""
    days = Window.partitionBy("ba_code").orderBy("date")
    shocks = index.select("date", (F.col(x) - F.lag(x).over(Window.orderBy("date"))).alias("_dx"))
    change = panel_daily.select("ba_code", "date", (F.col(y) - F.lag(y).over(days)).alias("_dy"))
    return change.join(F.broadcast(shocks), "date").groupBy("ba_code").agg(
        _corr(F.col("_dx"), F.col("_dy")).alias("policy_sensitivity")
    )


def season_risk(features: DataFrame) -> DataFrame:
    """Spike rate and mean spike size per area and season."""
    return features.groupBy("ba_code", season(F.col("period")).alias("season")).agg(
        F.avg(F.col("is_spike").cast("double")).alias("spike_rate"),
        F.avg(F.when(F.col("is_spike"), F.col("spike_magnitude"))).alias("avg_magnitude"),
    )


def lag_corr(a: DataFrame, b: DataFrame, max_lag: int, date: str = "date", x: str = "x", y: str = "y") -> DataFrame:
    """Correlation of ``b`` on a day with ``a`` 0..max_lag days before, for two daily series."""
    led = a.select(F.explode(F.sequence(F.lit(0), F.lit(max_lag))).alias("lag_days"), date, x).select(
        "lag_days", F.date_add(date, F.col("lag_days")).alias(date), x
    )
    return led.join(b.select(date, y), date).groupBy("lag_days").agg(
        _corr(F.col(x), F.col(y)).alias("corr"), F.count(F.lit(1)).alias("n_days")
    )


def share(df: DataFrame, c: str, name: str = "share") -> DataFrame:
    """Each row's part of the column total."""
    total = df.agg(F.sum(c)).scalar()
    return df.select("*", ratio(F.col(c).cast("double"), total.cast("double")).alias(name))


def is_peak(panel: DataFrame, day_q: float = 0.75, c: str = "demand_mw") -> DataFrame:
    """Mark hours above the percentile of their own day and area (a group of at most 24 hours)."""
    cut = panel.groupBy("ba_code", F.to_date("period").alias("_date")).agg(F.percentile(c, day_q).alias("_cut"))
    return (
        panel.withColumn("_date", F.to_date("period"))
        .join(cut, ["ba_code", "_date"])
        .withColumn("is_peak", F.col(c) > F.col("_cut"))
        .drop("_date", "_cut")
    )


def top_k(df: DataFrame, by: str, k: int, ties: list[str]) -> DataFrame:
    """The ``k`` largest rows, ties broken by ``ties``; each task keeps only ``k`` rows."""
    return df.orderBy(F.desc(by), *ties).limit(k)


def top_stress_days(daily: DataFrame, k: int = 20) -> DataFrame:
    return top_k(daily, "grid_stress", k, ["ba_code", "date"])


def best_run(runs: DataFrame, metric: str = "val_loss", run: str = "run") -> DataFrame:
    return runs.agg(F.min_by(run, F.struct(metric, run)).alias("run"), F.min(metric).alias(metric))


def ordered(df: DataFrame) -> DataFrame:
    return df.orderBy("ba_code", "period")


def concat(*dfs: DataFrame) -> DataFrame:
    out = dfs[0]
    for df in dfs[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def dedupe(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.dropDuplicates(keys)
