"""The shared test tables in the roles of the energy tables: once on Spark, once as SQL.

Times stay in their own units; areas come from ``user_id``, fuels from the JSON ``k`` of an event, prices
from orders and order lines, articles from documents.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattline.operators.panel import pivot_fuel
from wattline.reference_data import BA_STATES, FEATURE_BAS, FUEL_COLUMNS, NEWS_TYPES
from wattline.catalog.registry import Tables

FUELS = list(FUEL_COLUMNS)
STATES = sorted({s for states in BA_STATES.values() for s in states})
EPOCH = "2024-01-01"


def _list(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def pick(values: list[str], index: str) -> Column:
    """Entry number ``index`` (an SQL expression, taken modulo the length) of a list."""
    listed = ", ".join(f"'{v}'" for v in values)
    return F.expr(f"element_at(array({listed}), CAST(({index}) % {len(values)} AS INT) + 1)")


def pick_sql(values: list[str], index: str) -> str:
    return f"{_list(values)}[CAST(({index}) % {len(values)} AS INTEGER) + 1]"


def ba(index: str) -> Column:
    return pick(FEATURE_BAS, index)


def ba_sql(index: str) -> str:
    return pick_sql(FEATURE_BAS, index)


# --- Spark side ----------------------------------------------------------------------------------


def events(t: Tables) -> DataFrame:
    """Events with area, hour and the number in their JSON."""
    return t.events.select(
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("period"),
        "user_id",
        ba("user_id").alias("ba_code"),
        "event_type",
        "value",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )


def region_readings(t: Tables) -> DataFrame:
    code = (
        F.when(F.col("event_type") == "click", "D")
        .when(F.col("event_type") == "purchase", "DF")
        .when(F.col("event_type") == "view", "NG")
        .otherwise("TI")
    )
    rows = events(t).select("period", F.col("ba_code").alias("respondent"), code.alias("type"), "value")
    return rows.groupBy("period", "respondent", "type").agg(F.sum("value").alias("value"))


def demand(t: Tables) -> DataFrame:
    """Hourly panel: one row per hour and area that has any event."""
    kind = F.col("event_type")
    return (
        events(t)
        .groupBy("period", "ba_code")
        .agg(
            F.sum("value").alias("demand_mw"),
            F.sum(F.when(kind.isin("click", "view", "purchase"), F.col("value") * 1.5)).alias("forecast_mw"),
            F.sum(F.when(kind != "error", F.col("value") * 1.2)).alias("generation_mw"),
            F.sum(F.when(kind == "signup", F.col("value"))).alias("interchange_mw"),
        )
        .withColumn("supply_demand_gap", F.col("generation_mw") - F.col("demand_mw"))
    )


def fuel_readings(t: Tables) -> DataFrame:
    rows = events(t).select("period", F.col("ba_code").alias("respondent"), pick(FUELS, "k").alias("fueltype"), "value")
    return rows.groupBy("period", "respondent", "fueltype").agg(F.sum("value").alias("value"))


def fuel_mix(t: Tables) -> DataFrame:
    return pivot_fuel(fuel_readings(t))


def daily_fuel_readings(t: Tables) -> DataFrame:
    """Fuel readings at day grain from order lines."""
    fuel = pick(FUELS, "l_partkey")
    return (
        t.lineitem.select(
            F.col("l_shipdate").cast("timestamp").alias("period"), ba("l_suppkey").alias("respondent"), fuel.alias("fueltype"), "l_quantity"
        )
        .groupBy("period", "respondent", "fueltype")
        .agg(F.sum("l_quantity").alias("value"))
    )


def weather(t: Tables) -> DataFrame:
    return (
        events(t)
        .groupBy("period", "ba_code")
        .agg(
            (F.avg("k") * 0.5 - 5).alias("temperature_2m"),
            F.max("k").cast("double").alias("relative_humidity_2m"),
            F.min("k").cast("double").alias("wind_speed_10m"),
            F.avg("value").alias("cloud_cover"),
            F.max("value").alias("shortwave_radiation"),
        )
    )


def events_daily(t: Tables) -> DataFrame:
    g = F.col("k") / 5.0 - 10
    kind = F.col("event_type")
    return (
        events(t)
        .groupBy(F.to_date("ts").alias("event_date"))
        .agg(
            F.count(F.lit(1)).alias("us_event_count"),
            F.avg(g).alias("us_avg_goldstein"),
            F.min(g).alias("us_min_goldstein"),
            F.count_if(kind == "error").alias("us_severe_conflict"),
            F.count_if(kind == "signup").alias("oil_region_event_count"),
            F.count_if(kind != "click").alias("global_event_count"),
        )
    )


def january(date: str, span: int = 30) -> Column:
    """A table date folded into the ``span`` days from 2024-01-01 on."""
    return F.date_add(F.lit(EPOCH).cast("date"), F.datediff(F.col(date).cast("date"), F.lit("1995-01-01")) % span)


def gas_prices(t: Tables) -> DataFrame:
    """Five series a day in two processes, with no spot price on two days in seven."""
    offset = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1995-01-01")) % 30
    return (
        t.orders.groupBy(
            january("o_orderdate").alias("period"),
            F.col("o_orderpriority").alias("series_name"),
            F.when((F.col("o_orderstatus") == "F") & (offset % 7 < 5), "Spot Price").otherwise("Futures").alias("process_name"),
        ).agg((F.avg("o_totalprice") / 1000).alias("value"))
    )


def oil_prices(t: Tables) -> DataFrame:
    return (
        t.orders.groupBy(january("o_orderdate").alias("period"), F.col("o_orderpriority").alias("series_name")).agg((F.avg("o_totalprice") / 2000).alias("value"))
    )


def outages(t: Tables) -> DataFrame:
    return t.lineitem.groupBy(january("l_shipdate").alias("period")).agg((F.avg("l_discount") * 100).alias("pct_outage"))


def state_news(t: Tables) -> DataFrame:
    tone = F.col("k") / 5.0 - 10
    kind = F.col("event_type")
    return (
        events(t)
        .groupBy(F.to_date("ts").alias("article_date"), pick(STATES, "user_id").alias("state_code"))
        .agg(
            F.count(F.lit(1)).alias("total_energy_articles"),
            F.count_if(kind == "error").alias("grid_stress_articles"),
            F.count_if(kind == "click").alias("gas_pipeline_articles"),
            F.count_if(kind == "view").alias("electricity_articles"),
            F.count_if(kind == "purchase").alias("nuclear_articles"),
            F.count_if(kind == "signup").alias("renewable_articles"),
            F.avg(tone).alias("avg_energy_tone"),
            F.min(tone).alias("min_energy_tone"),
        )
    )


def risk_raw(t: Tables) -> DataFrame:
    """Daily index over years, moved so that it covers January 2024."""
    daily = t.orders.groupBy(F.date_add(F.col("o_orderdate").cast("date"), 8400).alias("date")).agg(
        (F.avg("o_totalprice") / 1000).alias("GPRD"),
        (F.min("o_totalprice") / 1000).alias("GPRD_ACT"),
        (F.max("o_totalprice") / 1000).alias("GPRD_THREAT"),
        (F.sum("o_totalprice") / 10000).alias("GPRD_MA7"),
    )
    return daily


def interchange(t: Tables) -> DataFrame:
    to = ba("user_id DIV 12")
    return (
        events(t)
        .select("period", F.col("ba_code").alias("fromba"), to.alias("toba"), "value")
        .where("fromba <> toba")
        .groupBy("period", "fromba", "toba")
        .agg(F.sum("value").alias("value"))
    )


def news(t: Tables) -> DataFrame:
    """Documents as news events in January 2024; a third of them name one area twice."""
    d = F.col("doc_id")
    minute = (d % 720) * 60 + (d * 37) % 60
    return t.documents.select(
        d.alias("event_id"),
        F.timestamp_seconds(F.unix_timestamp(F.lit(EPOCH).cast("timestamp")) + minute * 60).alias("event_time"),
        F.array(ba("doc_id"), ba("doc_id * 5")).alias("ba_codes"),
        pick(NEWS_TYPES, "n_chars").alias("event_type"),
        ((F.col("n_chars") % 201 - 100) / 100.0).alias("sentiment_score"),
        ((F.col("n_chars") % 101) / 100.0).alias("risk_magnitude"),
        "source",
        F.col("text").alias("headline"),
    )


# --- SQL side ------------------------------------------------------------------------------------

CTES: dict[str, str] = {
    "ev": f"""
        SELECT event_id, ts, date_trunc('hour', ts) AS period, user_id, {ba_sql('user_id')} AS ba_code, event_type, value,
               CAST(regexp_extract(props, '[0-9]+') AS INTEGER) AS k
        FROM events""",
    "region_readings": """
        SELECT period, ba_code AS respondent,
               CASE event_type WHEN 'click' THEN 'D' WHEN 'purchase' THEN 'DF' WHEN 'view' THEN 'NG' ELSE 'TI' END AS type,
               sum(value) AS value
        FROM ev GROUP BY 1, 2, 3""",
    "demand": """
        SELECT *, generation_mw - demand_mw AS supply_demand_gap FROM (
            SELECT period, ba_code, sum(value) AS demand_mw,
                   sum(CASE WHEN event_type IN ('click', 'view', 'purchase') THEN value * 1.5 END) AS forecast_mw,
                   sum(CASE WHEN event_type <> 'error' THEN value * 1.2 END) AS generation_mw,
                   sum(CASE WHEN event_type = 'signup' THEN value END) AS interchange_mw
            FROM ev GROUP BY 1, 2)""",
    "fuel_readings": f"""
        SELECT period, ba_code AS respondent, {pick_sql(FUELS, 'k')} AS fueltype, sum(value) AS value
        FROM ev GROUP BY 1, 2, 3""",
    "daily_fuel_readings": f"""
        SELECT l_shipdate AS period, {ba_sql('l_suppkey')} AS respondent, {pick_sql(FUELS, 'l_partkey')} AS fueltype,
               sum(l_quantity) AS value
        FROM lineitem GROUP BY 1, 2, 3""",
    "weather": """
        SELECT period, ba_code, avg(k) * 0.5 - 5 AS temperature_2m, CAST(max(k) AS DOUBLE) AS relative_humidity_2m,
               CAST(min(k) AS DOUBLE) AS wind_speed_10m, avg(value) AS cloud_cover, max(value) AS shortwave_radiation
        FROM ev GROUP BY 1, 2""",
    "events_daily": """
        SELECT CAST(ts AS DATE) AS event_date, count(*) AS us_event_count, avg(k / 5.0 - 10) AS us_avg_goldstein,
               min(k / 5.0 - 10) AS us_min_goldstein,
               count(*) FILTER (WHERE event_type = 'error') AS us_severe_conflict,
               count(*) FILTER (WHERE event_type = 'signup') AS oil_region_event_count,
               count(*) FILTER (WHERE event_type <> 'click') AS global_event_count
        FROM ev GROUP BY 1""",
    "gas_prices": """
        SELECT DATE '2024-01-01' + CAST(off % 30 AS INTEGER) AS period, o_orderpriority AS series_name,
               CASE WHEN o_orderstatus = 'F' AND (off % 30) % 7 < 5 THEN 'Spot Price' ELSE 'Futures' END AS process_name,
               avg(o_totalprice) / 1000 AS value
        FROM (SELECT *, CAST(o_orderdate AS DATE) - DATE '1995-01-01' AS off FROM orders)
        GROUP BY 1, 2, 3""",
    "oil_prices": """
        SELECT DATE '2024-01-01' + CAST((CAST(o_orderdate AS DATE) - DATE '1995-01-01') % 30 AS INTEGER) AS period,
               o_orderpriority AS series_name, avg(o_totalprice) / 2000 AS value
        FROM orders GROUP BY 1, 2""",
    "outages": """
        SELECT DATE '2024-01-01' + CAST((CAST(l_shipdate AS DATE) - DATE '1995-01-01') % 30 AS INTEGER) AS period,
               avg(l_discount) * 100 AS pct_outage
        FROM lineitem GROUP BY 1""",
    "state_news": f"""
        SELECT CAST(ts AS DATE) AS article_date, {pick_sql(STATES, 'user_id')} AS state_code,
               count(*) AS total_energy_articles,
               count(*) FILTER (WHERE event_type = 'error') AS grid_stress_articles,
               count(*) FILTER (WHERE event_type = 'click') AS gas_pipeline_articles,
               count(*) FILTER (WHERE event_type = 'view') AS electricity_articles,
               count(*) FILTER (WHERE event_type = 'purchase') AS nuclear_articles,
               count(*) FILTER (WHERE event_type = 'signup') AS renewable_articles,
               avg(k / 5.0 - 10) AS avg_energy_tone, min(k / 5.0 - 10) AS min_energy_tone
        FROM ev GROUP BY 1, 2""",
    "risk_raw": """
        SELECT CAST(o_orderdate AS DATE) + 8400 AS date, avg(o_totalprice) / 1000 AS GPRD,
               min(o_totalprice) / 1000 AS GPRD_ACT, max(o_totalprice) / 1000 AS GPRD_THREAT,
               sum(o_totalprice) / 10000 AS GPRD_MA7
        FROM orders GROUP BY 1""",
    "interchange": f"""
        SELECT period, fromba, toba, sum(value) AS value FROM (
            SELECT period, ba_code AS fromba, {ba_sql('user_id // 12')} AS toba, value FROM ev)
        WHERE fromba <> toba GROUP BY 1, 2, 3""",
    "news": f"""
        SELECT doc_id AS event_id,
               TIMESTAMP '2024-01-01' + to_minutes(CAST((doc_id % 720) * 60 + (doc_id * 37) % 60 AS INTEGER)) AS event_time,
               [{ba_sql('doc_id')}, {ba_sql('doc_id * 5')}] AS ba_codes,
               {pick_sql(NEWS_TYPES, 'n_chars')} AS event_type,
               (n_chars % 201 - 100) / 100.0 AS sentiment_score, (n_chars % 101) / 100.0 AS risk_magnitude,
               source, text AS headline
        FROM documents""",
    "fuel_mix": """
        SELECT *, gas_mw * 100 / nullif(total_mw, 0) AS gas_pct,
               (solar_mw + wind_mw + hydro_mw) * 100 / nullif(total_mw, 0) AS renewable_pct
        FROM (SELECT *, coal_mw + gas_mw + nuclear_mw + oil_mw + solar_mw + hydro_mw + wind_mw + other_mw AS total_mw
              FROM (SELECT period, respondent AS ba_code,
                           coalesce(sum(value) FILTER (WHERE fueltype = 'COL'), 0) AS coal_mw,
                           coalesce(sum(value) FILTER (WHERE fueltype = 'NG'), 0) AS gas_mw,
                           coalesce(sum(value) FILTER (WHERE fueltype = 'NUC'), 0) AS nuclear_mw,
                           coalesce(sum(value) FILTER (WHERE fueltype = 'OIL'), 0) AS oil_mw,
                           coalesce(sum(value) FILTER (WHERE fueltype = 'SUN'), 0) AS solar_mw,
                           coalesce(sum(value) FILTER (WHERE fueltype = 'WAT'), 0) AS hydro_mw,
                           coalesce(sum(value) FILTER (WHERE fueltype = 'WND'), 0) AS wind_mw,
                           coalesce(sum(value) FILTER (WHERE fueltype IN ('OTH', 'UNK')), 0) AS other_mw
                    FROM fuel_readings GROUP BY 1, 2))""",
}
CTES["daily_fuel_mix"] = CTES["fuel_mix"].replace("fuel_readings", "daily_fuel_readings")

# windows over one area, with a guard against spreads that are rounding noise
_W = "PARTITION BY ba_code ORDER BY period"
_SD24 = f"stddev_samp(demand_mw) OVER ({_W} ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)"
_MEAN24 = f"avg(demand_mw) OVER ({_W} ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)"
_MEAN168 = f"avg(demand_mw) OVER ({_W} ROWS BETWEEN 167 PRECEDING AND CURRENT ROW)"
_GAS_SD = f"stddev_samp(gas_price) OVER ({_W} ROWS BETWEEN 167 PRECEDING AND CURRENT ROW)"

_FIXED = "(extract(month FROM {d}), extract(day FROM {d})) IN ((1, 1), (7, 4), (11, 11), (12, 25))"
CTES["us_holidays"] = f"""
    SELECT d AS holiday_date FROM (SELECT DISTINCT CAST(period AS DATE) AS d FROM demand)
    WHERE (extract(dow FROM d) BETWEEN 1 AND 5 AND ({_FIXED.format(d='d')} OR extract(year FROM d) >= 2021 AND extract(month FROM d) = 6 AND extract(day FROM d) = 19))
       OR (extract(dow FROM d) = 5 AND ({_FIXED.format(d='(d + 1)')} OR extract(year FROM d) >= 2021 AND extract(month FROM d) = 6 AND extract(day FROM d) = 18))
       OR (extract(dow FROM d) = 1 AND ({_FIXED.format(d='(d - 1)')} OR extract(year FROM d) >= 2021 AND extract(month FROM d) = 6 AND extract(day FROM d) = 20))
       OR (extract(dow FROM d) = 1 AND (extract(month FROM d) = 1 AND extract(year FROM d) >= 1986 AND extract(day FROM d) BETWEEN 15 AND 21
           OR extract(month FROM d) = 2 AND extract(day FROM d) BETWEEN 15 AND 21 OR extract(month FROM d) = 5 AND extract(day FROM d) >= 25
           OR extract(month FROM d) = 9 AND extract(day FROM d) <= 7 OR extract(month FROM d) = 10 AND extract(day FROM d) BETWEEN 8 AND 14))
       OR (extract(dow FROM d) = 4 AND extract(month FROM d) = 11 AND extract(day FROM d) BETWEEN 22 AND 28)"""
CTES["base"] = """
    SELECT d.period, d.ba_code, d.demand_mw, d.generation_mw, d.supply_demand_gap, d.interchange_mw, d.forecast_mw,
           extract(hour FROM d.period) AS hour_of_day, extract(dow FROM d.period) AS day_of_week,
           extract(month FROM d.period) AS month, extract(dow FROM d.period) IN (0, 6) AS is_weekend,
           h.holiday_date IS NOT NULL AS is_holiday,
           coalesce(f.gas_pct, 0) AS gas_pct, coalesce(f.renewable_pct, 0) AS renewable_pct,
           (d.generation_mw - d.demand_mw) / nullif(d.demand_mw, 0) AS supply_margin_pct,
           g.value AS gas_price, o.value AS oil_price, n.pct_outage AS nuclear_outage_pct,
           w.temperature_2m AS temperature_c, w.relative_humidity_2m AS humidity_pct, w.wind_speed_10m AS wind_speed_kmh,
           w.cloud_cover AS cloud_cover_pct, w.shortwave_radiation AS solar_radiation,
           greatest(18.0 - coalesce(w.temperature_2m, 18.0), 0.0) AS hdd,
           greatest(coalesce(w.temperature_2m, 18.0) - 18.0, 0.0) AS cdd,
           coalesce(e.us_avg_goldstein, 0) AS sentiment_mean_24h, coalesce(e.us_min_goldstein, 0) AS sentiment_min_24h,
           CAST(coalesce(e.us_event_count, 0) AS DOUBLE) AS event_count_24h,
           coalesce(CAST(e.us_severe_conflict AS DOUBLE) / nullif(e.us_event_count, 0) * 10
                    + CAST(e.oil_region_event_count AS DOUBLE) / nullif(e.global_event_count, 0) * 10, 0) AS geo_risk_index
    FROM demand d
    LEFT JOIN fuel_mix f ON f.period = d.period AND f.ba_code = d.ba_code
    LEFT JOIN weather w ON w.period = d.period AND w.ba_code = d.ba_code
    LEFT JOIN events_daily e ON e.event_date = CAST(d.period AS DATE)
    LEFT JOIN (SELECT period, avg(value) AS value FROM gas_prices WHERE process_name = 'Spot Price' GROUP BY 1) g
           ON g.period = CAST(d.period AS DATE)
    LEFT JOIN (SELECT period, avg(value) AS value FROM oil_prices GROUP BY 1) o ON o.period = CAST(d.period AS DATE)
    LEFT JOIN outages n ON n.period = CAST(d.period AS DATE)
    LEFT JOIN us_holidays h ON h.holiday_date = CAST(d.period AS DATE)"""
CTES["features"] = f"""
    SELECT * EXCLUDE (forecast_mw),
           gas_pct - lag(gas_pct, 24) OVER ({_W}) AS gas_pct_delta_24h,
           (gas_price - lag(gas_price, 168) OVER ({_W})) / nullif(lag(gas_price, 168) OVER ({_W}), 0) AS gas_price_change_7d,
           {_GAS_SD} AS gas_price_volatility_7d,
           lag(demand_mw, 1) OVER ({_W}) AS demand_lag_1h, lag(demand_mw, 24) OVER ({_W}) AS demand_lag_24h,
           lag(demand_mw, 168) OVER ({_W}) AS demand_lag_168h,
           {_MEAN24} AS demand_rolling_24h, {_MEAN168} AS demand_rolling_168h, {_SD24} AS demand_std_24h,
           coalesce(abs(demand_mw - {_MEAN24}) > 2 * {_SD24} AND {_SD24} > 1e-9, FALSE) AS is_spike,
           abs(demand_mw - {_MEAN24}) / CASE WHEN {_SD24} > 1e-9 THEN {_SD24} END AS spike_magnitude
    FROM base"""
FEATURE_FLOATS = (
    "demand_mw demand_lag_1h demand_lag_24h demand_lag_168h demand_rolling_24h demand_rolling_168h demand_std_24h "
    "temperature_c humidity_pct wind_speed_kmh cloud_cover_pct solar_radiation hdd cdd generation_mw supply_demand_gap "
    "gas_pct renewable_pct interchange_mw gas_price oil_price gas_price_change_7d nuclear_outage_pct sentiment_mean_24h "
    "sentiment_min_24h event_count_24h geo_risk_index spike_magnitude supply_margin_pct gas_pct_delta_24h "
    "gas_price_volatility_7d"
)

# forecasts of two models: yesterday's row (A) and the mean of the 24 rows before (B)
_QUANTILES = ", ".join(
    f"p * (1 + ({q} - 0.5) * 0.8) AS {n}"
    for n, q in zip(["q02", "q10", "q25", "q50", "q75", "q90", "q98"], [0.02, 0.1, 0.25, 0.5, 0.75, 0.9, 0.98], strict=True)
)
CTES["forecasts"] = f"""
    SELECT period, ba_code, model, demand_mw AS actual, {_QUANTILES} FROM (
        SELECT period, ba_code, demand_mw, 'A' AS model, lag(demand_mw, 24) OVER ({_W}) AS p FROM demand
        UNION ALL
        SELECT period, ba_code, demand_mw, 'B' AS model,
               avg(demand_mw) OVER ({_W} ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING) AS p FROM demand)
    WHERE p IS NOT NULL"""
CTES["aligned"] = """
    SELECT a.period, a.ba_code, a.actual, a.q50 AS q50_a, b.q50 AS q50_b
    FROM forecasts a JOIN forecasts b ON a.period = b.period AND a.ba_code = b.ba_code
    WHERE a.model = 'A' AND b.model = 'B'"""
CTES["daily"] = "SELECT ba_code, CAST(period AS DATE) AS date, avg(demand_mw) AS y FROM demand GROUP BY 1, 2"


def _least_squares(source: str, terms: list[str], ridge: float = 1e-6) -> dict[str, str]:
    """CTEs that fit ``y`` on the terms per area by elimination, one step for each term: ``fitted`` has c0, c1, ..."""
    n = len(terms)
    upper = [(i, j) for i in range(n) for j in range(i, n)]
    made = {"season_terms": f"SELECT ba_code, date, y, {', '.join(f'{x} AS x{i}' for i, x in enumerate(terms))} FROM (SELECT *, CAST(date - DATE '1970-01-01' AS DOUBLE) AS day FROM {source})"}
    sums = [f"sum(x{i} * x{j}) AS a{i}_{j}" for i, j in upper] + [f"sum(x{i} * y) AS b{i}" for i in range(n)]
    made["season_sums"] = f"SELECT ba_code, {', '.join(sums)} FROM season_terms WHERE y IS NOT NULL GROUP BY 1"
    trace = f"greatest({' + '.join(f'a{i}_{i}' for i in range(n))}, 1.0)"
    made["season_0"] = f"SELECT * REPLACE ({', '.join(f'a{i}_{i} + {ridge} * {trace} / {n} AS a{i}_{i}' for i in range(n))}) FROM season_sums"
    for k in range(n - 1):
        less = [f"a{i}_{j} - a{k}_{i} * a{k}_{j} / a{k}_{k} AS a{i}_{j}" for i, j in upper if i > k]
        less += [f"b{i} - a{k}_{i} * b{k} / a{k}_{k} AS b{i}" for i in range(k + 1, n)]
        made[f"season_{k + 1}"] = f"SELECT * REPLACE ({', '.join(less)}) FROM season_{k}"
    above = f"season_{n - 1}"
    for k in reversed(range(n)):
        made[f"season_c{k}"] = f"SELECT *, (b{k} {''.join(f' - a{k}_{j} * c{j}' for j in range(k + 1, n))}) / a{k}_{k} AS c{k} FROM {above}"
        above = f"season_c{k}"
    made["fitted"] = f"SELECT ba_code, {', '.join(f'c{k}' for k in range(n))} FROM {above}"
    return made


def seasonal_daily(t: Tables) -> DataFrame:
    """Seven years of daily quantities per area, moved by 27 years so that they hold January 2024."""
    return t.lineitem.groupBy(ba("l_suppkey").alias("ba_code"), F.date_add(F.to_date("l_shipdate"), 9861).alias("date")).agg(F.sum("l_quantity").alias("y"))


CTES["seasonal_daily"] = f"""
    SELECT {ba_sql('l_suppkey')} AS ba_code, CAST(l_shipdate AS DATE) + 9861 AS date, CAST(sum(l_quantity) AS DOUBLE) AS y FROM lineitem GROUP BY 1, 2"""
_WAVES = [f"{f}(day * {2 * math.pi * k / length!r})" for length, terms in ((7.0, 3), (365.25, 4)) for k in range(1, terms + 1) for f in ("sin", "cos")]
CTES |= _least_squares("seasonal_daily", ["1.0::DOUBLE", "(day - 18628.0) / 1000.0", *_WAVES])
CTES["season_parts"] = f"""
    SELECT t.ba_code, t.date, c0 * x0 + c1 * x1 AS prophet_trend, {' + '.join(f'c{i} * x{i}' for i in range(2, 8))} AS prophet_weekly,
           {' + '.join(f'c{i} * x{i}' for i in range(8, 16))} AS prophet_yearly, y FROM season_terms t JOIN fitted f ON f.ba_code = t.ba_code"""


def features(t: Tables) -> DataFrame:
    from wattline.plans.features import build_features

    return build_features(
        demand(t), fuel_mix(t), weather(t), events_daily(t), gas_prices(t), oil_prices(t), outages(t)
    )


def both_models(t: Tables) -> DataFrame:
    """Each hour's demand with the medians of both models (A, B), from one window pass."""
    from wattline.operators.features import over_rows

    panel = demand(t).select("period", "ba_code", "demand_mw")
    return over_rows(
        panel,
        ["ba_code"],
        "period",
        lambda w: {"A": F.lag("demand_mw", 24).over(w), "B": F.avg("demand_mw").over(w.rowsBetween(-24, -1))},
        back=24,
    )


def forecasts(t: Tables) -> DataFrame:
    """A row for each model and hour."""
    from wattline.reference_data import QUANTILE_COLUMNS, QUANTILES

    long = both_models(t).unpivot(["period", "ba_code", "demand_mw"], ["A", "B"], "model", "p").where("p IS NOT NULL")
    return long.select(
        "period",
        "ba_code",
        "model",
        F.col("demand_mw").alias("actual"),
        *[(F.col("p") * (1 + (F.lit(q) - 0.5) * 0.8)).alias(n) for n, q in zip(QUANTILE_COLUMNS, QUANTILES, strict=True)],
    )


def aligned(t: Tables) -> DataFrame:
    """Both models side by side, from the row that holds them."""
    both = both_models(t).where("A IS NOT NULL AND B IS NOT NULL")
    return both.select("period", "ba_code", F.col("demand_mw").alias("actual"), F.col("A").alias("q50_a"), F.col("B").alias("q50_b"))


def daily(t: Tables) -> DataFrame:
    from wattline.operators.aggregates import daily_mean

    return daily_mean(demand(t))
