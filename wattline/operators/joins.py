"""Joins of the hourly panel with other tables, merges and patches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattline.operators.sequences import fill
from wattline.reference_data import BA_STATES

PANEL_KEY = ["period", "ba_code"]


def join_fuel(panel: DataFrame, fuel_mix: DataFrame) -> DataFrame:
    """Gas and renewable shares by (period, ba_code), 0 where the mix is unknown."""
    mix = fuel_mix.select(*PANEL_KEY, "gas_pct", "renewable_pct")
    return panel.join(mix, PANEL_KEY, "left").withColumns(
        {c: F.coalesce(c, F.lit(0.0)) for c in ("gas_pct", "renewable_pct")}
    )


def join_weather(panel: DataFrame, weather: DataFrame) -> DataFrame:
    """Weather columns by (period, ba_code) under their feature names."""
    named = weather.select(
        *PANEL_KEY,
        F.col("temperature_2m").alias("temperature_c"),
        F.col("relative_humidity_2m").alias("humidity_pct"),
        F.col("wind_speed_10m").alias("wind_speed_kmh"),
        F.col("cloud_cover").alias("cloud_cover_pct"),
        F.col("shortwave_radiation").alias("solar_radiation"),
    )
    return panel.join(named, PANEL_KEY, "left")


def one_per_day(daily: DataFrame, date: str, cols: list[str], where: Column | None = None) -> DataFrame:
    """Reduce a daily table to one row per day (means), so a join on the day cannot multiply rows."""
    kept = daily if where is None else daily.where(where)
    return kept.groupBy(F.to_date(date).alias("_date")).agg(*[F.avg(c).alias(c) for c in cols])


def join_daily(
    panel: DataFrame,
    daily: DataFrame,
    cols: list[str] | dict[str, str],
    date: str = "period",
    where: Column | None = None,
) -> DataFrame:
    """Put daily national values on every hour of their day.

    The daily side is reduced to one row per calendar day before it is broadcast, at most 366 rows a year.
    ``cols`` may map source names to result names.
    """
    names = cols if isinstance(cols, dict) else {c: c for c in cols}
    dim = one_per_day(daily, date, list(names), where).select("_date", *[F.col(s).alias(t) for s, t in names.items()])
    return (
        panel.withColumn("_date", F.to_date("period")).join(F.broadcast(dim), "_date", "left").drop("_date")
    )


def merge_events(us: DataFrame, world: DataFrame) -> DataFrame:
    """Domestic and global daily events side by side; a day may be missing on either."""
    return us.join(world, "event_date", "full_outer")


def ba_state_map(mapping: dict[str, list[str]] = BA_STATES) -> Column:
    """State code to the areas it feeds, as a map literal."""
    feeds: dict[str, list[str]] = {}
    for ba, states in mapping.items():
        for state in states:
            feeds.setdefault(state, []).append(ba)
    parts = []
    for state, bas in feeds.items():
        parts += [F.lit(state), F.array(*[F.lit(b) for b in bas])]
    return F.create_map(*parts)


def map_states(news: DataFrame, state: str = "state_code") -> DataFrame:
    """One row per (state row, area fed); states that feed no area drop out as in an inner join."""
    return news.select("*", F.explode(F.try_element_at(ba_state_map(), F.col(state))).alias("ba_code"))


def patch(target: DataFrame, src: DataFrame, on: list[str], cols: list[str], bounded: bool = False) -> DataFrame:
    """``UPDATE ... FROM``: on a key match the columns take the source's value, NULLs included.

    The source must be unique per key. ``bounded`` says that it has at most one row per area or per area
    and day; it is then broadcast, and a large area is not gathered by the join.
    """
    renamed = src.select(*on, F.lit(True).alias("_hit"), *[F.col(c).alias(f"_new_{c}") for c in cols])
    joined = target.join(F.broadcast(renamed) if bounded else renamed, on, "left")
    hit = F.col("_hit").isNotNull()
    values = {
        c: F.when(hit, F.col(f"_new_{c}")).otherwise(F.col(c)) if c in target.columns else F.col(f"_new_{c}")
        for c in cols
    }
    keep = [*target.columns, *[c for c in cols if c not in target.columns]]
    return joined.withColumns(values).select(*keep)


def patch_daily(target: DataFrame, src: DataFrame, cols: list[str], date: str, by: list[str] | None = None) -> DataFrame:
    """Patch hourly rows from a table with one row per day (and key)."""
    keyed = src.withColumn("_date", F.to_date(date)).drop(*([date] if date != "_date" else []))
    return patch(target.withColumn("_date", F.to_date("period")), keyed, [*(by or []), "_date"], cols, bounded=True).drop("_date")


def flag_dates(df: DataFrame, dates: DataFrame, date: str = "holiday_date", name: str = "is_holiday") -> DataFrame:
    """Flag rows whose UTC day is listed; works with an empty list too.

    The list holds distinct days, at most 366 a year, so it is broadcast.
    """
    listed = dates.select(F.col(date).alias("_date")).distinct().withColumn("_hit", F.lit(True))
    return (
        df.drop(name)
        .withColumn("_date", F.to_date("period"))
        .join(F.broadcast(listed), "_date", "left")
        .withColumn(name, F.coalesce("_hit", F.lit(False)))
        .drop("_date", "_hit")
    )


def on_dates(df: DataFrame, dates: DataFrame, date: str = "holiday_date") -> DataFrame:
    """Rows whose UTC day is listed."""
    listed = dates.select(F.col(date).alias("_date"))
    return df.withColumn("_date", F.to_date("period")).join(listed, "_date", "left_semi").drop("_date")


def anti_new(new: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` whose key the target does not hold yet; a NULL in a key equals a NULL."""
    held = target.select([F.col(k).alias(f"_held_{k}") for k in keys])
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_held_{k}"))
    return new.join(held, same, "left_anti")


def asof_last(panel: DataFrame, daily: DataFrame, cols: list[str], date: str = "period") -> DataFrame:
    """Last known daily value on every later hour, weekends and holidays included.

    Gaps are filled on the daily table itself, once for all areas: each daily row is valid until the day
    before the next one, and those days are generated and broadcast (one row per calendar day).
    """
    reduced = one_per_day(daily, date, cols)
    known = reduced.where(" OR ".join(f"{c} IS NOT NULL" for c in cols))
    last = panel.agg(F.to_date(F.max("period"))).scalar()
    grid = known.agg(F.min("_date").alias("a"), F.greatest(F.max("_date"), last).alias("b")).select(
        F.explode(F.sequence("a", "b", F.expr("INTERVAL 1 DAY"))).alias("_date")
    )
    full = grid.join(known, "_date", "left").withColumn("_key", F.lit(1))
    carried = fill(full, cols, ["_key"], "_date", backward=False, slice_by=F.date_trunc("year", "_date")).drop("_key")
    return panel.withColumn("_date", F.to_date("period")).join(F.broadcast(carried), "_date", "left").drop("_date")


def align(a: DataFrame, b: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Forecasts of two models for the same area and hour, columns suffixed ``_a`` and ``_b``."""
    cols = cols or ["q50"]
    left = a.select(*PANEL_KEY, "actual", *[F.col(c).alias(f"{c}_a") for c in cols])
    right = b.select(*PANEL_KEY, *[F.col(c).alias(f"{c}_b") for c in cols])
    return left.join(right, PANEL_KEY)


def interchange_for(edges: DataFrame, ba: str) -> DataFrame:
    """Exports and imports of one area, repeats removed."""
    return edges.where(F.col("fromba") == ba).unionByName(edges.where(F.col("toba") == ba)).distinct()


both_directions = interchange_for


def distinct_ba(df: DataFrame, c: str = "ba_code") -> DataFrame:
    return df.select(c).distinct()
