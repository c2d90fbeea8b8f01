"""Silver tables, filters, audits, merges."""

from __future__ import annotations

from pyspark.sql import functions as F

from wattline import sinks
from wattline.catalog import bindings as b
from wattline.catalog.registry import query
from wattline.functions import measures as m
from wattline.lineage import fresh_dir, stage
from wattline.operators import aggregates, features, joins, panel, quality
from wattline.operators.ranks import medians
from wattline.reference_data import FEATURE_BAS, REFRESHED_COLUMNS

HALF = "TIMESTAMP '2024-01-16'"
WINDOWS = [
    ("storm", "Storm week", "2024-01-08", "2024-01-12", "2024-01-10"),
    ("freeze", "Freeze days", "2024-01-11", "2024-01-20", None),
]
# windows on the years of the order lines
YEAR_WINDOWS = [
    ("early", "Early window", "1996-02-10", "1996-03-25", None),
    ("late", "Late window", "1999-06-01", "1999-08-15", None),
]
BOUNDS = {"ERCO": (20, 150), "PJM": (10, 400), "CISO": (0, 60), "MISO": (5, 5000), "BPAT": (1, 90)}
_BOUNDS_SQL = ", ".join(f"('{k}', {lo}.0::DOUBLE, {hi}.0::DOUBLE)" for k, (lo, hi) in BOUNDS.items())
_LOCAL = {
    "bounds": f"SELECT * FROM (VALUES {_BOUNDS_SQL}) v(ba_code, lo, hi)",
    "wins": "SELECT * FROM (VALUES " + ", ".join(
        f"('{k}', '{label}', TIMESTAMP '{a}', TIMESTAMP '{z}', {f"DATE '{e}'" if e else 'NULL'})" for k, label, a, z, e in WINDOWS
    ) + ") v(win, label, a, z, escalation)",
}


@query(
    "pivot_demand",
    """SELECT *, demand_mw - forecast_mw AS demand_forecast_gap, generation_mw - demand_mw AS supply_demand_gap FROM (
         SELECT period, respondent AS ba_code, max(value) FILTER (WHERE type = 'D') AS demand_mw,
                max(value) FILTER (WHERE type = 'DF') AS forecast_mw, max(value) FILTER (WHERE type = 'NG') AS generation_mw,
                max(value) FILTER (WHERE type = 'TI') AS interchange_mw
         FROM region_readings GROUP BY 1, 2)""",
    "demand_mw forecast_mw generation_mw interchange_mw demand_forecast_gap supply_demand_gap",
)
def _(t):
    return panel.pivot_demand(b.region_readings(t))


_FUEL_FLOATS = "coal_mw gas_mw nuclear_mw oil_mw solar_mw hydro_mw wind_mw other_mw total_mw gas_pct renewable_pct"


@query("pivot_fuel_hourly", "SELECT * FROM fuel_mix", _FUEL_FLOATS)
def _(t):
    return b.fuel_mix(t)


@query("pivot_fuel_daily", "SELECT * FROM daily_fuel_mix", _FUEL_FLOATS)
def _(t):
    return panel.pivot_fuel(b.daily_fuel_readings(t))


_SPINE = """SELECT unnest(generate_series((SELECT min(period) FROM demand), (SELECT max(period) FROM demand), INTERVAL 1 HOUR)) AS period,
                   ba_code FROM (SELECT DISTINCT ba_code FROM demand)"""


@query("hour_spine", _SPINE)
def _(t):
    d = b.demand(t)
    return panel.hour_spine(d, d.agg(F.min("period")).scalar(), d.agg(F.max("period")).scalar())


@query(
    "fill_hours",
    f"""SELECT s.period, s.ba_code, d.demand_mw, d.demand_mw IS NULL AS is_interpolated
        FROM ({_SPINE}) s LEFT JOIN demand d ON s.period = d.period AND s.ba_code = d.ba_code""",
    "demand_mw",
)
def _(t):
    return panel.fill_hours(b.demand(t).select("period", "ba_code", "demand_mw"))


@query("only_listed_areas", "SELECT * FROM demand WHERE ba_code IN ('PJM', 'TVA', 'CISO')", "demand_mw forecast_mw generation_mw interchange_mw supply_demand_gap")
def _(t):
    return quality.only_bas(b.demand(t), ["PJM", "TVA", "CISO"])


@query(
    "half_open_period",
    "SELECT period, ba_code, demand_mw FROM demand WHERE period >= TIMESTAMP '2024-01-08' AND period < TIMESTAMP '2024-01-15'",
    "demand_mw",
)
def _(t):
    return quality.between_half_open(b.demand(t), "2024-01-08", "2024-01-15").select("period", "ba_code", "demand_mw")


@query(
    "closed_period",
    "SELECT period, ba_code, demand_mw FROM demand WHERE period BETWEEN TIMESTAMP '2024-01-08' AND TIMESTAMP '2024-01-15'",
    "demand_mw",
)
def _(t):
    return quality.between_closed(b.demand(t), "2024-01-08", "2024-01-15").select("period", "ba_code", "demand_mw")


@query(
    "crisis_windows",
    'SELECT d.period, d.ba_code, d.demand_mw, w.win AS "window", w.label, w.escalation FROM demand d JOIN wins w ON d.period BETWEEN w.a AND w.z',
    "demand_mw",
    ctes=_LOCAL,
)
def _(t):
    return quality.in_windows(b.demand(t).select("period", "ba_code", "demand_mw"), WINDOWS)


@query(
    "validate_bounds",
    """SELECT *, n_below = 0 AND n_above = 0 AS passed FROM (
         SELECT d.ba_code, min(demand_mw) AS min_value, max(demand_mw) AS max_value,
                count(*) FILTER (WHERE demand_mw < lo) AS n_below, count(*) FILTER (WHERE demand_mw > hi) AS n_above
         FROM demand d JOIN bounds x ON x.ba_code = d.ba_code WHERE demand_mw IS NOT NULL GROUP BY 1)""",
    "min_value max_value",
    ctes=_LOCAL,
)
def _(t):
    return quality.validate_bounds(b.demand(t), BOUNDS)


_CLEAN = """SELECT d.period, d.ba_code, CASE WHEN demand_mw < lo OR demand_mw > hi THEN NULL ELSE demand_mw END AS demand_mw,
                   supply_demand_gap
            FROM demand d LEFT JOIN bounds x ON x.ba_code = d.ba_code"""


@query("null_out_of_bounds", _CLEAN, "demand_mw supply_demand_gap", ctes=_LOCAL)
def _(t):
    return quality.null_out_of_bounds(b.demand(t), BOUNDS).select("period", "ba_code", "demand_mw", "supply_demand_gap")


@query(
    "cascade_null",
    f"SELECT period, ba_code, demand_mw, CASE WHEN demand_mw IS NOT NULL THEN supply_demand_gap END AS supply_demand_gap FROM ({_CLEAN})",
    "demand_mw supply_demand_gap",
    ctes=_LOCAL,
)
def _(t):
    d = quality.null_out_of_bounds(b.demand(t), BOUNDS).select("period", "ba_code", "demand_mw", "supply_demand_gap")
    return quality.cascade_null(d, "demand_mw", ["supply_demand_gap"])


@query(
    "clip_renewable_share",
    "SELECT period, ba_code, least(greatest(renewable_pct, 10), 60) AS renewable_pct FROM daily_fuel_mix",
    "renewable_pct",
)
def _(t):
    mix = panel.pivot_fuel(b.daily_fuel_readings(t)).select("period", "ba_code", "renewable_pct")
    return quality.clip_column(mix, "renewable_pct", 10, 60)


@query("drop_dead_column", "SELECT period, ba_code, demand_mw FROM demand", "demand_mw")
def _(t):
    d = b.demand(t).select("period", "ba_code", "demand_mw", F.lit(None).cast("double").alias("oil_price"))
    return quality.drop_dead(d)


@query(
    "positive_target",
    "SELECT period, ba_code, supply_demand_gap FROM demand WHERE supply_demand_gap > 0",
    "supply_demand_gap",
)
def _(t):
    return quality.positive_target(b.demand(t), "supply_demand_gap").select("period", "ba_code", "supply_demand_gap")


@query(
    "flag_to_text",
    "SELECT period, ba_code, CASE WHEN dayofweek(period) IN (0, 6) THEN '1' ELSE '0' END AS is_weekend FROM demand",
)
def _(t):
    from wattline.functions.calendar import is_weekend

    d = b.demand(t).select("period", "ba_code", is_weekend(F.col("period")).alias("is_weekend"))
    return quality.flags_to_str(d, ["is_weekend"])


@query(
    "infinite_to_null",
    "SELECT event_id, CASE WHEN k % 10 < 3 THEN NULL ELSE value END AS x FROM ev",
    "x",
)
def _(t):
    odd = F.when(F.col("k") % 10 == 0, F.lit(float("inf"))).when(F.col("k") % 10 == 1, F.lit(float("-inf")))
    x = odd.when(F.col("k") % 10 == 2, F.lit(float("nan"))).otherwise(F.col("value"))
    return quality.inf_to_null(b.events(t).select("event_id", x.alias("x")), ["x"])


@query(
    "null_report",
    """SELECT "column", n_null, n_null * 100.0::DOUBLE / n AS null_pct FROM (
         SELECT unnest(['demand_mw', 'forecast_mw', 'generation_mw', 'interchange_mw']) AS "column",
                unnest([count(*) - count(demand_mw), count(*) - count(forecast_mw), count(*) - count(generation_mw),
                        count(*) - count(interchange_mw)]) AS n_null, count(*) AS n FROM demand)""",
    "null_pct",
)
def _(t):
    return quality.null_report(b.demand(t), ["demand_mw", "forecast_mw", "generation_mw", "interchange_mw"])


@query(
    "table_counts",
    """SELECT 'events' AS table_name, count(*) AS n_rows FROM events UNION ALL SELECT 'orders', count(*) FROM orders
       UNION ALL SELECT 'lineitem', count(*) FROM lineitem UNION ALL SELECT 'absent', -1""",
)
def _(t):
    return quality.table_counts({"events": t.events, "orders": t.orders, "lineitem": t.lineitem, "absent": None})


@query(
    "table_stats",
    "SELECT count(*) AS n_rows, count(DISTINCT ba_code) AS n_keys, min(period) AS first_period, max(period) AS last_period FROM demand",
)
def _(t):
    return quality.table_stats(b.demand(t))


@query(
    "demand_audit",
    """SELECT ba_code, min(demand_mw) AS min_value, max(demand_mw) AS max_value, avg(demand_mw) AS avg_value,
              quantile_cont(demand_mw, 0.99) AS p_value FROM demand GROUP BY 1""",
    "min_value max_value avg_value p_value",
)
def _(t):
    return quality.demand_audit(b.demand(t))


@query(
    "count_nulls",
    """SELECT ba_code, count(*) AS n_rows, count(*) FILTER (WHERE interchange_mw IS NULL) AS n_null,
              count(*) FILTER (WHERE interchange_mw <= 0) AS n_not_positive FROM demand GROUP BY 1""",
)
def _(t):
    return quality.count_nulls(b.demand(t), ["ba_code"], "interchange_mw")


@query(
    "volume_report",
    """SELECT table_name, part, sum(n)::BIGINT AS n_rows FROM (
         SELECT 'orders' AS table_name, o_orderstatus AS part, count(*) AS n FROM orders GROUP BY 2
         UNION ALL SELECT 'lineitem', l_linestatus, count(*) FROM lineitem GROUP BY 2)
       GROUP BY ROLLUP (table_name, part)""",
)
def _(t):
    return quality.volume_report(
        {"orders": t.orders.withColumnRenamed("o_orderstatus", "part_"), "lineitem": t.lineitem.withColumnRenamed("l_linestatus", "part_")},
        "part_",
    )


@query("group_median", "SELECT ba_code, median(demand_mw) AS demand_mw, median(interchange_mw) AS interchange_mw FROM demand GROUP BY 1", "demand_mw interchange_mw")
def _(t):
    return medians(b.demand(t), ["ba_code"], ["demand_mw", "interchange_mw"])


# --- keys, sets and merges -----------------------------------------------------------------------


@query(
    "keep_first_row",
    """SELECT ba_code, event_type, event_id, value FROM (
         SELECT *, row_number() OVER (PARTITION BY ba_code, event_type ORDER BY ts, event_id) AS rn FROM ev) WHERE rn = 1""",
    "value",
)
def _(t):
    e = b.events(t).select("ba_code", "event_type", "ts", "event_id", "value")
    return features.keep_first(e, ["ba_code", "event_type"], ["ts", "event_id"]).drop("ts")


@query("distinct_areas", "SELECT DISTINCT ba_code FROM demand")
def _(t):
    return joins.distinct_ba(b.demand(t))


@query(
    "dedupe_on_key",
    "SELECT DISTINCT o_custkey, o_orderstatus FROM orders",
)
def _(t):
    return aggregates.dedupe(t.orders.select("o_custkey", "o_orderstatus"), ["o_custkey", "o_orderstatus"])


_EDGES = "SELECT period, fromba, toba, value FROM interchange WHERE fromba = 'PJM' OR toba = 'PJM'"


@query("interchange_both_directions", _EDGES, "value")
def _(t):
    # the two directions come from the same rows, so distinct guards the union only
    return joins.both_directions(b.interchange(t), "PJM")


@query(
    "concat_areas",
    "SELECT period, ba_code, demand_mw FROM demand",
    "demand_mw",
)
def _(t):
    d = b.demand(t).select("period", "ba_code", "demand_mw")
    return aggregates.concat(*[d.where(F.col("ba_code") == area) for area in FEATURE_BAS])


_OLD = f"SELECT period, ba_code, demand_mw, forecast_mw FROM demand WHERE period < {HALF}"
_NEW = "SELECT period, ba_code, demand_mw * 2 AS demand_mw, forecast_mw * 3 AS forecast_mw FROM demand WHERE period >= TIMESTAMP '2024-01-10'"


def _old_new(t):
    d = b.demand(t).select("period", "ba_code", "demand_mw", "forecast_mw")
    new = d.where("period >= '2024-01-10'").withColumns({"demand_mw": F.col("demand_mw") * 2, "forecast_mw": F.col("forecast_mw") * 3})
    return d.where("period < '2024-01-16'"), new


@query(
    "insert_ignore",
    f"""SELECT * FROM ({_OLD}) UNION ALL
        SELECT n.* FROM ({_NEW}) n ANTI JOIN ({_OLD}) o ON n.period = o.period AND n.ba_code = o.ba_code""",
    "demand_mw forecast_mw",
)
def _(t):
    old, new = _old_new(t)
    return sinks.insert_ignore(old, new, ["period", "ba_code"])


@query(
    "new_keys_only",
    f"SELECT n.* FROM ({_NEW}) n ANTI JOIN ({_OLD}) o ON n.period = o.period AND n.ba_code = o.ba_code",
    "demand_mw forecast_mw",
)
def _(t):
    old, new = _old_new(t)
    return joins.anti_new(new, old, ["period", "ba_code"])


@query(
    "refresh_some_columns",
    f"""SELECT coalesce(o.period, n.period) AS period, coalesce(o.ba_code, n.ba_code) AS ba_code,
               CASE WHEN o.period IS NOT NULL THEN o.demand_mw ELSE n.demand_mw END AS demand_mw,
               CASE WHEN n.period IS NOT NULL THEN n.forecast_mw ELSE o.forecast_mw END AS forecast_mw
        FROM ({_OLD}) o FULL JOIN ({_NEW}) n ON n.period = o.period AND n.ba_code = o.ba_code""",
    "demand_mw forecast_mw",
)
def _(t):
    old, new = _old_new(t)
    return sinks.upsert_cols(old, new, ["period", "ba_code"], ["forecast_mw"])


@query(
    "refresh_feature_table",
    """SELECT * REPLACE (CASE WHEN period >= TIMESTAMP '2024-01-20' THEN demand_mw + 1000 ELSE demand_mw END AS demand_mw,
                         CASE WHEN period >= TIMESTAMP '2024-01-12' THEN gas_price * 2 ELSE gas_price END AS gas_price,
                         CASE WHEN period >= TIMESTAMP '2024-01-12' THEN NULL ELSE demand_lag_168h END AS demand_lag_168h) FROM features""",
    b.FEATURE_FLOATS,
)
def _(t):
    table = b.features(t)
    old = table.where("period < '2024-01-20'")
    # a rebuild from the 12th on: known hours take the refreshed columns only, new hours come whole
    changes = {"demand_mw": F.col("demand_mw") + 1000, "gas_price": F.col("gas_price") * 2, "demand_lag_168h": F.lit(None).cast("double")}
    new = table.where("period >= '2024-01-12'").withColumns(changes)
    path = fresh_dir(t.spark, "features")
    sinks.write_months(old, path)
    stored = t.spark.read.parquet(path)
    merged = stage(sinks.upsert_cols(stored.drop("month").withColumn("month", F.month("period")), new, ["period", "ba_code"], REFRESHED_COLUMNS), "merged")
    sinks.write_months(merged.withColumnRenamed("month", "month_of_year"), path)
    return t.spark.read.parquet(path).drop("month").withColumnRenamed("month_of_year", "month")


@query(
    "patch_by_day",
    """SELECT d.period, d.ba_code, CASE WHEN x.date IS NOT NULL THEN x.GPRD ELSE d.demand_mw END AS demand_mw
       FROM demand d LEFT JOIN (SELECT * FROM risk_raw WHERE GPRD > 250) x ON x.date = CAST(d.period AS DATE)""",
    "demand_mw",
)
def _(t):
    src = b.risk_raw(t).where("GPRD > 250").select("date", F.col("GPRD").alias("demand_mw"))
    return joins.patch_daily(b.demand(t).select("period", "ba_code", "demand_mw"), src, ["demand_mw"], "date")


@query(
    "patch_by_area_day",
    """SELECT d.period, d.ba_code, d.demand_mw, x.y FROM demand d
       LEFT JOIN daily x ON x.date = CAST(d.period AS DATE) AND x.ba_code = d.ba_code AND x.y > 60""",
    "demand_mw y",
)
def _(t):
    src = b.daily(t).where("y > 60")
    return joins.patch_daily(b.demand(t).select("period", "ba_code", "demand_mw"), src, ["y"], "date", ["ba_code"])


_PROFILES = """SELECT ba_code, coalesce(avg(gas_pct) / 100, 0) AS gas_sensitivity,
                      coalesce(avg(renewable_pct) / 100, 0) AS renewable_sensitivity,
                      coalesce(avg(coalesce(nuclear_mw, 0) / nullif(total_mw, 0)), 0) AS nuclear_sensitivity
               FROM daily_fuel_mix GROUP BY 1"""
_SENS = ["gas_sensitivity", "renewable_sensitivity", "nuclear_sensitivity"]


@query("fuel_profiles", _PROFILES, " ".join(_SENS))
def _(t):
    return aggregates.fuel_profiles(panel.pivot_fuel(b.daily_fuel_readings(t)))


@query(
    "fuel_profiles_train_only",
    _PROFILES.replace("GROUP BY 1", "WHERE period < TIMESTAMP '1999-01-01' GROUP BY 1"),
    " ".join(_SENS),
)
def _(t):
    return aggregates.fuel_profiles(panel.pivot_fuel(b.daily_fuel_readings(t)), train_end="1999-01-01")


@query(
    "patch_by_area",
    f"""SELECT d.period, d.ba_code, d.demand_mw, p.gas_sensitivity, p.renewable_sensitivity, p.nuclear_sensitivity
        FROM demand d LEFT JOIN ({_PROFILES}) p ON p.ba_code = d.ba_code""",
    "demand_mw " + " ".join(_SENS),
)
def _(t):
    profiles = aggregates.fuel_profiles(panel.pivot_fuel(b.daily_fuel_readings(t)))
    return joins.patch(b.demand(t).select("period", "ba_code", "demand_mw"), profiles, ["ba_code"], _SENS)


@query(
    "flag_holidays",
    "SELECT d.period, d.ba_code, h.holiday_date IS NOT NULL AS is_holiday FROM demand d LEFT JOIN us_holidays h ON h.holiday_date = CAST(d.period AS DATE)",
)
def _(t):
    from wattline.functions.calendar import is_us_holiday

    days = b.demand(t).select(F.to_date("period").alias("holiday_date")).distinct()
    return joins.flag_dates(b.demand(t).select("period", "ba_code"), days.where(is_us_holiday(F.col("holiday_date"))))


@query(
    "rows_on_holidays",
    "SELECT period, ba_code, demand_mw FROM demand WHERE CAST(period AS DATE) IN (SELECT holiday_date FROM us_holidays)",
    "demand_mw",
)
def _(t):
    from wattline.functions.calendar import is_us_holiday

    days = b.demand(t).select(F.to_date("period").alias("holiday_date")).distinct()
    return joins.on_dates(b.demand(t).select("period", "ba_code", "demand_mw"), days.where(is_us_holiday(F.col("holiday_date"))))


@query(
    "pending_work",
    """WITH ledger AS (SELECT o_orderstatus AS table_name, o_custkey AS work_key,
                              CASE WHEN arg_max(o_orderkey, o_orderkey) % 3 = 0 THEN 'completed' ELSE 'failed' END AS status
                       FROM orders GROUP BY 1, 2)
       SELECT DISTINCT 'F' AS table_name, c_custkey AS work_key FROM customer
       WHERE c_custkey NOT IN (SELECT work_key FROM ledger WHERE table_name = 'F' AND status = 'completed')""",
)
def _(t):
    ledger = t.orders.select(
        F.col("o_orderstatus").alias("table_name"),
        F.col("o_custkey").alias("work_key"),
        F.when(F.col("o_orderkey") % 3 == 0, "completed").otherwise("failed").alias("status"),
        F.col("o_orderkey").alias("logged_at"),
    )
    return sinks.pending(t.customer.select(F.lit("F").alias("table_name"), F.col("c_custkey").alias("work_key")), ledger)


def _written(t, df, name, how):
    """Write to a fresh table in the shared folder and read it back."""
    from wattline.lineage import fresh_dir

    path = fresh_dir(t.spark, name)
    how(df, path)
    return path


@query("append_by_month", "SELECT period, ba_code, demand_mw FROM demand", "demand_mw")
def _(t):
    path = _written(t, b.demand(t).select("period", "ba_code", "demand_mw"), "append", sinks.write_append)
    return t.spark.read.parquet(path).drop("month")


@query(
    "merge_into_table",
    f"""SELECT * FROM ({_OLD}) UNION ALL
        SELECT n.* FROM ({_NEW}) n ANTI JOIN ({_OLD}) o ON n.period = o.period AND n.ba_code = o.ba_code""",
    "demand_mw forecast_mw",
)
def _(t):
    old, new = _old_new(t)
    path = _written(t, old, "merge", sinks.write_append)
    # twice: the second run must add nothing
    for _i in range(2):
        sinks.write_merge(t.spark, new, path, ["period", "ba_code"])
    return t.spark.read.parquet(path).drop("month")


@query("write_result_csv", "SELECT ba_code, count(*) AS n FROM demand GROUP BY 1")
def _(t):
    path = _written(t, b.demand(t).groupBy("ba_code").agg(F.count(F.lit(1)).alias("n")), "csv", sinks.write_results)
    return t.spark.read.schema("ba_code string, n bigint").option("header", True).csv(path)


@query(
    "prediction_log",
    """SELECT period AS target_period, ba_code, q50 AS predicted_demand, actual AS actual_demand,
              q10 AS confidence_lower, q90 AS confidence_upper, abs((actual - q50) / nullif(actual, 0)) * 100 AS mape
       FROM forecasts WHERE model = 'A'""",
    "predicted_demand actual_demand confidence_lower confidence_upper mape",
)
def _(t):
    from wattline.operators.risk import fill_actuals

    log = sinks.log_predictions(b.forecasts(t).where("model = 'A'"), F.lit("2024-02-01").cast("timestamp"), "A")
    return fill_actuals(log, b.demand(t)).select(
        "target_period", "ba_code", "predicted_demand", "actual_demand", "confidence_lower", "confidence_upper", "mape"
    )


# --- joins ---------------------------------------------------------------------------------------


@query(
    "join_fuel_mix",
    """SELECT d.period, d.ba_code, d.demand_mw, coalesce(f.gas_pct, 0) AS gas_pct, coalesce(f.renewable_pct, 0) AS renewable_pct
       FROM demand d LEFT JOIN fuel_mix f ON f.period = d.period AND f.ba_code = d.ba_code""",
    "demand_mw gas_pct renewable_pct",
)
def _(t):
    return joins.join_fuel(b.demand(t).select("period", "ba_code", "demand_mw"), b.fuel_mix(t))


@query(
    "join_weather",
    """SELECT d.period, d.ba_code, w.temperature_2m AS temperature_c, w.relative_humidity_2m AS humidity_pct,
              w.wind_speed_10m AS wind_speed_kmh, w.cloud_cover AS cloud_cover_pct, w.shortwave_radiation AS solar_radiation
       FROM demand d LEFT JOIN weather w ON w.period = d.period AND w.ba_code = d.ba_code""",
    "temperature_c humidity_pct wind_speed_kmh cloud_cover_pct solar_radiation",
)
def _(t):
    return joins.join_weather(b.demand(t).select("period", "ba_code"), b.weather(t))


@query(
    "join_daily_events",
    """SELECT d.period, d.ba_code, CAST(e.us_event_count AS DOUBLE) AS us_event_count, e.us_avg_goldstein
       FROM demand d LEFT JOIN events_daily e ON e.event_date = CAST(d.period AS DATE)""",
    "us_event_count us_avg_goldstein",
)
def _(t):
    return joins.join_daily(b.demand(t).select("period", "ba_code"), b.events_daily(t), ["us_event_count", "us_avg_goldstein"], "event_date")


@query(
    "join_spot_gas_price",
    """SELECT d.period, d.ba_code, g.value AS gas_price FROM demand d
       LEFT JOIN (SELECT period, avg(value) AS value FROM gas_prices WHERE process_name = 'Spot Price' GROUP BY 1) g
              ON g.period = CAST(d.period AS DATE)""",
    "gas_price",
)
def _(t):
    return joins.join_daily(
        b.demand(t).select("period", "ba_code"), b.gas_prices(t), {"value": "gas_price"}, where=F.col("process_name") == "Spot Price"
    )


@query(
    "join_oil_price",
    """SELECT d.period, d.ba_code, g.value AS oil_price FROM demand d
       LEFT JOIN (SELECT period, avg(value) AS value FROM oil_prices GROUP BY 1) g ON g.period = CAST(d.period AS DATE)""",
    "oil_price",
)
def _(t):
    return joins.join_daily(b.demand(t).select("period", "ba_code"), b.oil_prices(t), {"value": "oil_price"})


@query(
    "join_nuclear_outage",
    "SELECT d.period, d.ba_code, n.pct_outage AS nuclear_outage_pct FROM demand d LEFT JOIN outages n ON n.period = CAST(d.period AS DATE)",
    "nuclear_outage_pct",
)
def _(t):
    return joins.join_daily(b.demand(t).select("period", "ba_code"), b.outages(t), {"pct_outage": "nuclear_outage_pct"})


@query(
    "merge_domestic_and_global_events",
    """SELECT coalesce(u.event_date, g.event_date) AS event_date, us_event_count, global_event_count FROM
         (SELECT event_date, us_event_count FROM events_daily WHERE event_date < DATE '2024-01-20') u
         FULL JOIN (SELECT event_date, global_event_count FROM events_daily WHERE event_date > DATE '2024-01-10') g
         ON u.event_date = g.event_date""",
)
def _(t):
    e = b.events_daily(t)
    us = e.where("event_date < '2024-01-20'").select("event_date", "us_event_count")
    return joins.merge_events(us, e.where("event_date > '2024-01-10'").select("event_date", "global_event_count"))


_FEEDS = ", ".join(f"('{ba}', '{s}')" for ba, states in b.BA_STATES.items() for s in states)
_MAP = {"feeds": f"SELECT * FROM (VALUES {_FEEDS}) v(ba_code, state_code)"}


@query(
    "map_states_to_areas",
    "SELECT n.article_date, n.state_code, n.total_energy_articles, f.ba_code FROM state_news n JOIN feeds f ON f.state_code = n.state_code",
    ctes=_MAP,
)
def _(t):
    return joins.map_states(b.state_news(t).select("article_date", "state_code", "total_energy_articles"))


@query(
    "asof_last_price",
    """WITH p AS (SELECT period AS day, avg(value) AS value FROM gas_prices WHERE process_name = 'Spot Price' GROUP BY 1)
       SELECT d.period, d.ba_code, p.value FROM demand d ASOF LEFT JOIN p ON CAST(d.period AS DATE) >= p.day""",
    "value",
)
def _(t):
    spot = b.gas_prices(t).where("process_name = 'Spot Price'").select("period", "value")
    return joins.asof_last(b.demand(t).select("period", "ba_code"), spot, ["value"])


@query("align_models", "SELECT * FROM aligned", "actual q50_a q50_b")
def _(t):
    return b.aligned(t)


@query(
    "supply_margin",
    "SELECT period, ba_code, (generation_mw - demand_mw) / nullif(demand_mw, 0) AS supply_margin_pct FROM demand",
    "supply_margin_pct",
)
def _(t):
    return b.demand(t).select("period", "ba_code", m.supply_margin(F.col("generation_mw"), F.col("demand_mw")).alias("supply_margin_pct"))
