"""Window features, calendar and scalar functions, the feature table, signals and correlations."""

from __future__ import annotations

from pyspark.sql import functions as F

from wattline.catalog import bindings as b
from wattline.catalog.panel_queries import _MAP, YEAR_WINDOWS
from wattline.catalog.registry import query
from wattline.functions import calendar as cal
from wattline.functions import hashing as h
from wattline.functions import measures as m
from wattline.operators import aggregates, features, panel, prep
from wattline.lineage import stage
from wattline.operators.sequences import fill, number_rows
from wattline.plans.model_frame import model_frame
from wattline.plans import features as plan
from wattline.reference_data import FEATURE_FAMILIES, THEME_GROUPS, VARIANT_REALS

W = "OVER (PARTITION BY ba_code ORDER BY period)"


def frame(n: int) -> str:
    return f"OVER (PARTITION BY ba_code ORDER BY period ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def slim(t):
    return b.demand(t).select("period", "ba_code", "demand_mw")


@query(
    "feature_table",
    "SELECT * FROM features",
    b.FEATURE_FLOATS,
)
def feature_table(t):
    return b.features(t)


@query(
    "demand_lags",
    f"""SELECT period, ba_code, demand_mw, lag(demand_mw, 1) {W} AS demand_mw_lag_1h,
               lag(demand_mw, 24) {W} AS demand_mw_lag_24h, lag(demand_mw, 168) {W} AS demand_mw_lag_168h FROM demand""",
    "demand_mw demand_mw_lag_1h demand_mw_lag_24h demand_mw_lag_168h",
)
def _(t):
    return features.add_lags(slim(t))


@query(
    "demand_hour_lags",
    """SELECT d.period, d.ba_code, d.demand_mw, a.demand_mw AS demand_mw_lag_1h, z.demand_mw AS demand_mw_lag_24h
       FROM demand d LEFT JOIN demand a ON a.ba_code = d.ba_code AND a.period = d.period - INTERVAL 1 HOUR
       LEFT JOIN demand z ON z.ba_code = d.ba_code AND z.period = d.period - INTERVAL 24 HOUR""",
    "demand_mw demand_mw_lag_1h demand_mw_lag_24h",
)
def _(t):
    return features.add_hour_lags(slim(t), ns=(1, 24))


@query("rolling_mean_24", f"SELECT period, ba_code, demand_mw, avg(demand_mw) {frame(24)} AS m FROM demand", "demand_mw m")
def _(t):
    return features.roll_mean(slim(t), "demand_mw", 24, "m")


@query("rolling_mean_168", f"SELECT period, ba_code, demand_mw, avg(demand_mw) {frame(168)} AS m FROM demand", "demand_mw m")
def _(t):
    return features.roll_mean(slim(t), "demand_mw", 168, "m")


@query("rolling_std_24", f"SELECT period, ba_code, demand_mw, stddev_samp(demand_mw) {frame(24)} AS s FROM demand", "demand_mw s")
def _(t):
    return features.roll_std(slim(t), "demand_mw", 24, "s")


_PRICED = """SELECT d.period, d.ba_code, g.value AS gas_price FROM demand d
             LEFT JOIN (SELECT period, avg(value) AS value FROM gas_prices WHERE process_name = 'Spot Price' GROUP BY 1) g
             ON g.period = CAST(d.period AS DATE)"""


def priced(t):
    from wattline.operators.joins import join_daily

    return join_daily(slim(t).drop("demand_mw"), b.gas_prices(t), {"value": "gas_price"}, where=F.col("process_name") == "Spot Price")


@query("gas_price_volatility", f"SELECT *, stddev_samp(gas_price) {frame(168)} AS s FROM ({_PRICED})", "gas_price s")
def _(t):
    return features.roll_std(priced(t), "gas_price", 168, "s")


@query("gas_share_delta", f"SELECT period, ba_code, gas_pct - lag(gas_pct, 24) {W} AS d FROM fuel_mix", "d")
def _(t):
    return features.delta(b.fuel_mix(t).select("period", "ba_code", "gas_pct"), "gas_pct", 24, "d").drop("gas_pct")


@query(
    "gas_price_change",
    f"SELECT *, (gas_price - lag(gas_price, 168) {W}) / nullif(lag(gas_price, 168) {W}, 0) AS c FROM ({_PRICED})",
    "gas_price c",
)
def _(t):
    return features.rel_change(priced(t), "gas_price", 168, "c")


@query("spike_flags", "SELECT period, ba_code, is_spike, spike_magnitude FROM features", "spike_magnitude")
def _(t):
    return features.spikes(slim(t)).drop("demand_mw")


@query(
    "holiday_neighbours",
    f"""SELECT period, ba_code, is_holiday, coalesce(lead(CAST(is_holiday AS BIGINT), 24) {W}, 0) AS is_pre_holiday,
               coalesce(lag(CAST(is_holiday AS BIGINT), 24) {W}, 0) AS is_post_holiday
        FROM base""",
)
def _(t):
    d = slim(t).drop("demand_mw").withColumn("is_holiday", cal.is_us_holiday(F.to_date("period")))
    return features.holiday_neighbours(d)


_RATED = """SELECT ba_code, article_date, sum(total_energy_articles) AS tot, sum(grid_stress_articles) AS gs,
                   sum(gas_pipeline_articles) AS gp, sum(electricity_articles) AS el, avg(avg_energy_tone) AS tone,
                   min(min_energy_tone) AS lowest
            FROM state_news n JOIN feeds f ON f.state_code = n.state_code GROUP BY 1, 2"""


def _z(x: str, n: int, part: str, order: str) -> str:
    over = f"OVER ({part} ORDER BY {order} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
    sd = f"CASE WHEN stddev_samp({x}) {over} < 1e-12 THEN 1 ELSE stddev_samp({x}) {over} END"
    return f"coalesce(CASE WHEN count({x}) {over} >= 7 THEN ({x} - avg({x}) {over}) / ({sd}) END, 0)"


_AREA = "PARTITION BY ba_code"
_ZSCORES = f"""SELECT ba_code, article_date, {_z('r1', 30, _AREA, 'article_date')} AS grid_stress_zscore,
                      {_z('r2', 30, _AREA, 'article_date')} AS gas_pipeline_zscore,
                      {_z('r3', 30, _AREA, 'article_date')} AS electricity_buzz_zscore, coalesce(tone, 0) AS energy_tone_regional
               FROM (SELECT *, gs / CAST(tot AS DOUBLE) AS r1, gp / CAST(tot AS DOUBLE) AS r2, el / CAST(tot AS DOUBLE) AS r3 FROM ({_RATED}))"""
_NEWS_COLS = "grid_stress_zscore gas_pipeline_zscore electricity_buzz_zscore energy_tone_regional"


@query("news_zscores", _ZSCORES, _NEWS_COLS, ctes=_MAP)
def _(t):
    return plan.news_zscores(b.state_news(t))


@query(
    "news_daily",
    f"SELECT ba_code, article_date, tot::BIGINT AS total_energy_articles, gs::BIGINT AS grid_stress_articles, tone AS avg_energy_tone, lowest AS min_energy_tone FROM ({_RATED})",
    "avg_energy_tone min_energy_tone",
    ctes=_MAP,
)
def _(t):
    return aggregates.news_daily(b.state_news(t)).select(
        "ba_code", "article_date", "total_energy_articles", "grid_stress_articles", "avg_energy_tone", "min_energy_tone"
    )


_RISK_Z = f"SELECT date, GPRD_MA7 AS gpr_index, {_z('GPRD_MA7', 90, '', 'date')} AS gpr_zscore FROM risk_raw WHERE date >= DATE '2021-01-01'"


@query("risk_zscore", _RISK_Z, "gpr_index gpr_zscore")
def _(t):
    from wattline.operators.forecast import decompose
    from wattline.sources.signals import risk_index_rows

    return plan.risk_zscore(risk_index_rows(b.risk_raw(t)))


_PROFILE = """SELECT ba_code, coalesce(avg(gas_pct) / 100, 0) AS gas_sensitivity, coalesce(avg(renewable_pct) / 100, 0) AS renewable_sensitivity,
                     coalesce(avg(coalesce(nuclear_mw, 0) / nullif(total_mw, 0)), 0) AS nuclear_sensitivity
              FROM daily_fuel_mix GROUP BY 1"""
_SIGNALS = f"""SELECT f.*, p.gas_sensitivity, p.renewable_sensitivity, p.nuclear_sensitivity, z.grid_stress_zscore, z.gas_pipeline_zscore,
                      z.electricity_buzz_zscore, z.energy_tone_regional, r.gpr_index, r.gpr_zscore, s.prophet_trend, s.prophet_weekly, s.prophet_yearly
               FROM features f LEFT JOIN ({_PROFILE}) p ON p.ba_code = f.ba_code
               LEFT JOIN ({_ZSCORES}) z ON z.ba_code = f.ba_code AND z.article_date = CAST(f.period AS DATE)
               LEFT JOIN ({_RISK_Z}) r ON r.date = CAST(f.period AS DATE)
               LEFT JOIN season_parts s ON s.ba_code = f.ba_code AND s.date = CAST(f.period AS DATE)"""
_SIGNAL_FLOATS = f"gas_sensitivity renewable_sensitivity nuclear_sensitivity {_NEWS_COLS} gpr_index gpr_zscore prophet_trend prophet_weekly prophet_yearly"


def signals(t):
    from wattline.operators.forecast import decompose
    from wattline.sources.signals import risk_index_rows

    return plan.add_signals(
        b.features(t), panel.pivot_fuel(b.daily_fuel_readings(t)), b.state_news(t), risk_index_rows(b.risk_raw(t)), decompose(b.seasonal_daily(t))
    )


@query(
    "feature_table_from_start",
    "SELECT * FROM features WHERE period >= TIMESTAMP '2024-01-15' AND period < TIMESTAMP '2024-01-28'",
    b.FEATURE_FLOATS,
)
def _(t):
    return plan.build_features(
        b.demand(t), b.fuel_mix(t), b.weather(t), b.events_daily(t), b.gas_prices(t), b.oil_prices(t), b.outages(t), start="2024-01-15", end="2024-01-28"
    )


@query("feature_table_with_signals", _SIGNALS, f"{b.FEATURE_FLOATS} {_SIGNAL_FLOATS}", ctes=_MAP)
def _(t):
    return signals(t)


@query(
    "fill_forward_and_backward",
    f"""SELECT period, ba_code, coalesce(last_value(interchange_mw IGNORE NULLS) OVER (PARTITION BY ba_code ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
               first_value(interchange_mw IGNORE NULLS) OVER (PARTITION BY ba_code ORDER BY period ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS interchange_mw
        FROM demand""",
    "interchange_mw",
)
def _(t):
    d = b.demand(t).select("period", "ba_code", "interchange_mw")
    return fill(d, ["interchange_mw"], ["ba_code"], slice_by=F.date_trunc("day", "period"))


@query(
    "fill_forward_only",
    """SELECT period, ba_code, last_value(interchange_mw IGNORE NULLS) OVER (PARTITION BY ba_code ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS interchange_mw
       FROM demand""",
    "interchange_mw",
)
def _(t):
    return fill(b.demand(t).select("period", "ba_code", "interchange_mw"), ["interchange_mw"], ["ba_code"], backward=False)


@query("row_numbers", f"SELECT period, ba_code, row_number() {W} - 1 AS row_no FROM demand")
def _(t):
    return number_rows(slim(t).drop("demand_mw"), ["ba_code"], "period", F.date_trunc("week", "period"))


@query(
    "time_index",
    "SELECT period, ba_code, date_diff('hour', (SELECT min(period) FROM demand), period) AS time_idx FROM demand",
)
def _(t):
    return features.time_index(slim(t).drop("demand_mw"))


@query(
    "latest_rows",
    "SELECT period, ba_code, demand_mw FROM (SELECT *, row_number() OVER (PARTITION BY ba_code ORDER BY period DESC) AS rn FROM demand) WHERE rn <= 168",
    "demand_mw",
)
def _(t):
    return features.latest_n(slim(t), ["ba_code"], 168)


@query(
    "halo_chunks_on_full_grid",
    f"""SELECT period, ba_code, avg(demand_mw) {frame(168)} AS m, lag(demand_mw, 168) {W} AS l FROM (
          SELECT s.period, s.ba_code, coalesce(d.demand_mw, 0) AS demand_mw FROM (
            SELECT unnest(generate_series((SELECT min(period) FROM demand), (SELECT max(period) FROM demand), INTERVAL 1 HOUR)) AS period,
                   ba_code FROM (SELECT DISTINCT ba_code FROM demand)) s
          LEFT JOIN demand d ON s.period = d.period AND s.ba_code = d.ba_code)""",
    "m l",
)
def _(t):
    full = panel.fill_hours(slim(t)).withColumn("demand_mw", F.coalesce("demand_mw", F.lit(0.0)))
    return features.halo_window(
        full,
        lambda w: {"m": features.mean_over(w, "demand_mw", 168), "l": F.lag("demand_mw", 168).over(w)},
        chunk="week",
        halo="169 hours",
    ).select("period", "ba_code", "m", "l")


_DAYS = "OVER (ORDER BY event_date ROWS BETWEEN {n} PRECEDING AND CURRENT ROW)"


@query(
    "rolling_daily_signals",
    f"""SELECT event_date, avg(us_avg_goldstein) {_DAYS.format(n=2)} AS us_avg_goldstein_3d_avg,
               avg(us_avg_goldstein) {_DAYS.format(n=6)} AS us_avg_goldstein_7d_avg,
               (sum(us_severe_conflict) {_DAYS.format(n=6)})::BIGINT AS us_severe_conflict_7d_sum,
               avg(us_avg_goldstein) {_DAYS.format(n=29)} AS us_avg_goldstein_30d_avg FROM events_daily""",
    "us_avg_goldstein_3d_avg us_avg_goldstein_7d_avg us_avg_goldstein_30d_avg",
)
def _(t):
    specs = [("us_avg_goldstein", "avg", 3), ("us_avg_goldstein", "avg", 7), ("us_severe_conflict", "sum", 7), ("us_avg_goldstein", "avg", 30)]
    rolled = features.roll_daily(b.events_daily(t), specs, "event_date")
    return rolled.select("event_date", *[f"{c}_{n}d_{kind}" for c, kind, n in specs])


@query(
    "temperature_lag",
    f"SELECT period, ba_code, lag(temperature_2m, 24) {W} AS temp_lag_24h FROM weather",
    "temp_lag_24h",
)
def _(t):
    from wattline.operators.features import over_rows

    wt = b.weather(t).select("period", "ba_code", "temperature_2m")
    return over_rows(wt, ["ba_code"], "period", lambda w: {"temp_lag_24h": F.lag("temperature_2m", 24).over(w)}, back=24).drop("temperature_2m")


@query(
    "tone_moving_average",
    f"SELECT ba_code, article_date, avg(tone) OVER ({_AREA} ORDER BY article_date ROWS BETWEEN 27 PRECEDING AND CURRENT ROW) AS avg_energy_tone_28d_avg FROM ({_RATED})",
    "avg_energy_tone_28d_avg",
    ctes=_MAP,
)
def _(t):
    daily = aggregates.news_daily(b.state_news(t))
    return features.roll_daily(daily, [("avg_energy_tone", "avg", 28)], "article_date", ["ba_code"]).select(
        "ba_code", "article_date", "avg_energy_tone_28d_avg"
    )


@query(
    "tone_shock",
    f"SELECT ba_code, article_date, tone - lag(tone) OVER ({_AREA} ORDER BY article_date) AS shock FROM ({_RATED})",
    "shock",
    ctes=_MAP,
)
def _(t):
    daily = aggregates.news_daily(b.state_news(t))
    return features.daily_change(daily, "avg_energy_tone", "article_date", ["ba_code"], "shock").select("ba_code", "article_date", "shock")


_SERIES = {
    "gas_daily": "SELECT CAST(o_orderdate AS DATE) AS date, avg(o_totalprice) AS x FROM orders GROUP BY 1",
    "oil_daily": "SELECT CAST(l_shipdate AS DATE) AS date, avg(l_extendedprice) AS y FROM lineitem GROUP BY 1",
}


@query(
    "price_lead_lag",
    """SELECT lag_days, corr(x, y) AS corr, count(*) AS n_days FROM (SELECT unnest(range(0, 6)) AS lag_days)
       JOIN gas_daily g ON TRUE JOIN oil_daily o ON o.date = g.date + CAST(lag_days AS INTEGER) GROUP BY 1""",
    "corr",
    ctes=_SERIES,
)
def _(t):
    a = t.orders.groupBy(F.to_date("o_orderdate").alias("date")).agg(F.avg("o_totalprice").alias("x"))
    z = t.lineitem.groupBy(F.to_date("l_shipdate").alias("date")).agg(F.avg("l_extendedprice").alias("y"))
    return aggregates.lag_corr(a, z, 5)


@query(
    "training_samples",
    f"""SELECT period, ba_code, n_history, n_future, sum_history, sum_future FROM (
          SELECT period, ba_code, count(*) OVER (PARTITION BY ba_code ORDER BY period ROWS BETWEEN 167 PRECEDING AND CURRENT ROW) AS n_history,
                 count(*) OVER (PARTITION BY ba_code ORDER BY period ROWS BETWEEN 1 FOLLOWING AND 24 FOLLOWING) AS n_future,
                 sum(demand_mw) OVER (PARTITION BY ba_code ORDER BY period ROWS BETWEEN 167 PRECEDING AND CURRENT ROW) AS sum_history,
                 sum(demand_mw) OVER (PARTITION BY ba_code ORDER BY period ROWS BETWEEN 1 FOLLOWING AND 24 FOLLOWING) AS sum_future
          FROM demand) WHERE n_history >= 84 AND n_future >= 1""",
    "sum_history sum_future",
)
def _(t):
    s = prep.make_samples(b.demand(t))

    def total(c):
        return F.aggregate(c, F.lit(0.0), lambda acc, x: acc + x)

    return s.select(
        "period", "ba_code", F.size("history").alias("n_history"), F.size("future").alias("n_future"),
        total("history").alias("sum_history"), total("future").alias("sum_future"),
    )


@query(
    "hour_samples",
    """SELECT period, ba_code, n_history, n_future, sum_history, sum_future, at_history, at_future FROM (
         SELECT period, ba_code, count(v) OVER h AS n_history, count(v) OVER f AS n_future, sum(v) OVER h AS sum_history, sum(v) OVER f AS sum_future,
                sum(v * hour_no) OVER h - (hour_no - 167) * sum(v) OVER h AS at_history, sum(v * hour_no) OVER f - (hour_no + 1) * sum(v) OVER f AS at_future
         FROM (SELECT period, ba_code, CASE WHEN hour(period) % 5 <> 0 THEN demand_mw END AS v, date_diff('hour', TIMESTAMP '2024-01-01', period) AS hour_no FROM demand WHERE hour(period) % 7 <> 3)
         WINDOW h AS (PARTITION BY ba_code ORDER BY period RANGE BETWEEN INTERVAL 167 HOUR PRECEDING AND CURRENT ROW),
                f AS (PARTITION BY ba_code ORDER BY period RANGE BETWEEN INTERVAL 1 HOUR FOLLOWING AND INTERVAL 24 HOUR FOLLOWING))
       WHERE n_history >= 60 AND n_future >= 1""",
    "sum_history sum_future at_history at_future",
    digits=2,
)
def _(t):
    # some hours are missing and others have no value
    d = b.demand(t).where(F.hour("period") % 7 != 3).select("period", "ba_code", F.when(F.hour("period") % 5 != 0, F.col("demand_mw")).alias("demand_mw"))
    s = prep.hour_samples(d, 168, 24, min_enc=60)

    def total(c):
        return F.aggregate(c, F.lit(0.0), lambda acc, x: acc + F.coalesce(x, F.lit(0.0)))

    def known(c):
        return F.size(F.filter(f"{c}_mask", lambda x: x))

    def placed(c):
        return total(F.transform(c, lambda x, i: x * i))

    return s.select(
        "period", "ba_code", known("history").alias("n_history"), known("future").alias("n_future"), total("history").alias("sum_history"), total("future").alias("sum_future"),
        placed("history").alias("at_history"), placed("future").alias("at_future"),
    )


@query(
    "robust_log_scale",
    """SELECT period, ba_code, quantile_cont(v, 0.5) AS centre, quantile_cont(v, 0.75) - quantile_cont(v, 0.25) AS scale FROM (
         SELECT period, ba_code, unnest(hist) AS v FROM (
           SELECT period, ba_code, list(ln(1 + demand_mw)) OVER (PARTITION BY ba_code ORDER BY period ROWS BETWEEN 167 PRECEDING AND CURRENT ROW) AS hist
           FROM demand)) GROUP BY 1, 2 HAVING count(*) >= 24""",
    "centre scale",
)
def _(t):
    whole = prep.make_samples(b.demand(t), enc=168, dec=1, min_enc=24).select("ba_code", "period", "history")
    # the last row of an area has no future row and so is no sample: its window is added on its own
    tail = features.latest_n(slim(t), ["ba_code"], 168).groupBy("ba_code").agg(
        F.max("period").alias("period"), F.collect_list("demand_mw").alias("history")
    ).where(F.size("history") >= 24)
    return whole.unionByName(tail).select("period", "ba_code", *[c.alias(n) for n, c in m.log1p_robust(F.col("history")).items()])


@query(
    "rolling_origins",
    """SELECT ba_code, origin, count(*) AS n_rows FROM demand JOIN (
         SELECT unnest(generate_series(TIMESTAMP '2024-01-08', TIMESTAMP '2024-01-28', INTERVAL 24 HOUR)) AS origin)
         ON period >= origin - INTERVAL 168 HOUR AND period < origin + INTERVAL 24 HOUR
       WHERE origin < TIMESTAMP '2024-01-28' GROUP BY 1, 2 HAVING count(*) >= 120""",
)
def _(t):
    # fewer rows than hours are asked for here, because the panel has gaps
    return prep.rolling_origins(slim(t), "2024-01-08", "2024-01-28", 24, 168, 24, min_rows=120)


# --- scalar functions -----------------------------------------------------------------------------


@query(
    "calendar_parts",
    """SELECT period, ba_code, extract(hour FROM period) AS hour_of_day, extract(month FROM period) AS month,
              extract(dow FROM period) AS day_of_week, extract(dow FROM period) IN (0, 6) AS is_weekend, CAST(period AS DATE) AS day,
              (epoch(period) + 86400)::BIGINT AS target_epoch, CASE WHEN month(period) IN (12, 1, 2) THEN 'winter' ELSE 'other' END AS season
       FROM demand""",
)
def _(t):
    p = F.col("period")
    return slim(t).select(
        "period", "ba_code", cal.hour_of(p).alias("hour_of_day"), cal.month_of(p).alias("month"), cal.dow0(p).alias("day_of_week"),
        cal.is_weekend(p).alias("is_weekend"), cal.utc_date(p).alias("day"), cal.target_epoch(p).alias("target_epoch"), cal.season(p).alias("season"),
    )


@query("floor_to_hour", "SELECT event_id, date_trunc('hour', ts) AS hour FROM events")
def _(t):
    return t.events.select("event_id", cal.floor_hour(F.col("ts").cast("timestamp")).alias("hour"))


@query(
    "local_time_to_utc",
    "SELECT event_id, ts + INTERVAL 5 HOUR AS utc FROM events",
)
def _(t):
    # the table lies in January, when Eastern time is five hours behind
    return t.events.select("event_id", cal.to_utc(F.col("ts").cast("timestamp"), "America/New_York").alias("utc"))


@query(
    "fourier_terms",
    """SELECT o_orderkey, sin(2 * pi() * dayofyear(o_orderdate) / 365.25) AS sin_1, cos(2 * pi() * dayofyear(o_orderdate) / 365.25) AS cos_1,
              sin(4 * pi() * dayofyear(o_orderdate) / 365.25) AS sin_2, cos(4 * pi() * dayofyear(o_orderdate) / 365.25) AS cos_2 FROM orders""",
    "sin_1 cos_1 sin_2 cos_2",
)
def _(t):
    return t.orders.select("o_orderkey", *[c.alias(n) for n, c in cal.fourier(F.col("o_orderdate"), 365.25, 2).items()])


@query(
    "degree_days",
    "SELECT period, ba_code, greatest(18.0 - temperature_2m, 0) AS hdd, greatest(temperature_2m - 18.0, 0) AS cdd FROM weather",
    "hdd cdd",
)
def _(t):
    x = F.col("temperature_2m")
    return b.weather(t).select("period", "ba_code", m.hdd(x).alias("hdd"), m.cdd(x).alias("cdd"))


@query(
    "geo_risk_index",
    """SELECT event_date, us_severe_conflict / CAST(us_event_count AS DOUBLE) * 10 + oil_region_event_count / CAST(global_event_count AS DOUBLE) * 10 AS geo_risk_index
       FROM events_daily""",
    "geo_risk_index",
)
def _(t):
    c = F.col
    risk = m.geo_risk(c("us_severe_conflict"), c("us_event_count"), c("oil_region_event_count"), c("global_event_count"))
    return b.events_daily(t).select("event_date", risk.alias("geo_risk_index"))


@query(
    "article_rates",
    "SELECT article_date, state_code, grid_stress_articles / CAST(CASE WHEN total_energy_articles = 0 THEN 1 ELSE total_energy_articles END AS DOUBLE) AS r FROM state_news",
    "r",
)
def _(t):
    return b.state_news(t).select("article_date", "state_code", m.rate(F.col("grid_stress_articles"), F.col("total_energy_articles")).alias("r"))


@query(
    "content_hashes",
    "SELECT doc_id, sha256(trim(lower(text), ' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12) || chr(28) || chr(29) || chr(30) || chr(31) || chr(133) || chr(160)) || '|' || source) AS h FROM documents",
)
def _(t):
    return t.documents.select("doc_id", h.content_hash(F.col("text"), F.col("source")).alias("h"))


@query(
    "prediction_fingerprints",
    "SELECT event_id, sha256(event_id || '|' || epoch(period)::BIGINT || '|' || event_type) AS h, sha256(ba_code || '|' || epoch(period)::BIGINT) AS round FROM ev",
)
def _(t):
    ts = F.unix_timestamp("period")
    return b.events(t).select("event_id", h.audit_hash(F.col("event_id"), ts, F.col("event_type")).alias("h"), h.round_id(F.col("ba_code"), ts).alias("round"))


@query(
    "basis_points",
    "SELECT event_id, CAST(trunc((k / 100.0 + 0.00004) * 10000) AS BIGINT) AS bp FROM ev",
)
def _(t):
    return b.events(t).select("event_id", m.basis_points(F.col("k") / 100.0 + 0.00004).alias("bp"))


_GKG = ["grid_stress_zscore", "gas_pipeline_zscore", "electricity_buzz_zscore", "energy_tone_regional"]


@query(
    "crisis_weights",
    f"""SELECT ba_code, article_date, 1 + 2 * least(greatest(greatest(abs(grid_stress_zscore), abs(gas_pipeline_zscore),
               abs(electricity_buzz_zscore), abs(energy_tone_regional)) - 1, 0), 4) AS weight FROM ({_ZSCORES})""",
    "weight",
    ctes=_MAP,
)
def _(t):
    return plan.news_zscores(b.state_news(t)).select("ba_code", "article_date", m.crisis_weight([F.col(c) for c in _GKG]).alias("weight"))


@query(
    "json_fuel_share",
    "SELECT event_id, k / 100.0 AS known, 0.0::DOUBLE AS unknown FROM ev",
    "known unknown",
)
def _(t):
    shares = F.from_json("props", "map<string,double>")
    return t.events.select("event_id", (m.json_share(shares, "k") / 100).alias("known"), m.json_share(shares, "z").alias("unknown"))


@query(
    "risk_classes",
    """SELECT event_id, CASE WHEN k >= 75 THEN 'CRITICAL' WHEN k >= 50 THEN 'HIGH' WHEN k >= 25 THEN 'MEDIUM' ELSE 'LOW' END AS class,
              CASE WHEN value > 60 AND k / 100.0 > 0.7 THEN 'RED' WHEN value > 60 OR k / 100.0 > 0.7 THEN 'YELLOW' ELSE 'GREEN' END AS alert FROM ev""",
)
def _(t):
    return b.events(t).select(
        "event_id", m.risk_class(F.col("k")).alias("class"), m.alert_level(F.col("value"), F.col("k") / 100.0, F.lit(60)).alias("alert")
    )


@query(
    "share_of_total",
    "SELECT ba_code, n, n / CAST(sum(n) OVER () AS DOUBLE) AS share FROM (SELECT ba_code, count(*) AS n FROM ev GROUP BY 1)",
    "share",
)
def _(t):
    return aggregates.share(b.events(t).groupBy("ba_code").agg(F.count(F.lit(1)).alias("n")), "n")


@query(
    "feature_families",
    """SELECT p_partkey, CASE WHEN contains(lower(p_name), 'red') OR contains(lower(p_name), 'blue') THEN 'signal'
              WHEN contains(lower(p_name), 'small') THEN 'price' ELSE 'other' END AS family FROM part""",
)
def _(t):
    keywords = dict(zip(FEATURE_FAMILIES, (["red", "blue"], ["small"]), strict=True))
    return t.part.select("p_partkey", m.family(F.col("p_name"), keywords).alias("family"))


@query(
    "peak_hours",
    """SELECT d.period, d.ba_code, d.demand_mw > c.cut AS is_peak FROM demand d JOIN (
         SELECT ba_code, CAST(period AS DATE) AS day, quantile_cont(demand_mw, 0.75) AS cut FROM demand GROUP BY 1, 2) c
       ON c.ba_code = d.ba_code AND c.day = CAST(d.period AS DATE)""",
)
def _(t):
    return aggregates.is_peak(slim(t)).drop("demand_mw")


@query("unnest_area_codes", "SELECT event_id, unnest(ba_codes) AS ba_code, list_contains(ba_codes, 'PJM') AS has_pjm FROM news")
def _(t):
    from wattline.operators.news import unnest

    n = b.news(t).select("event_id", "ba_codes")
    return unnest(n, "ba_codes", "ba_code").select("event_id", "ba_code", m.has(F.col("ba_codes"), "PJM").alias("has_pjm"))


# --- aggregates -------------------------------------------------------------------------------------


@query(
    "daily_summary",
    """SELECT date_trunc('day', period)::TIMESTAMP AS day, ba_code, avg(demand_mw) AS avg_demand, max(demand_mw) AS peak_demand,
              min(demand_mw) AS min_demand, stddev_samp(demand_mw) AS stddev_demand FROM demand GROUP BY 1, 2""",
    "avg_demand peak_demand min_demand stddev_demand",
)
def _(t):
    return aggregates.daily_summary(slim(t))


@query("daily_mean", "SELECT * FROM daily", "y")
def _(t):
    return b.daily(t)


@query(
    "holiday_effect",
    "SELECT ba_code, is_holiday, avg(demand_mw) AS avg_demand, count(demand_mw) AS n_hours FROM base GROUP BY 1, 2",
    "avg_demand",
)
def _(t):
    return aggregates.effect_by_flag(slim(t).withColumn("is_holiday", cal.is_us_holiday(F.to_date("period"))))


@query(
    "signal_timeline",
    """SELECT CAST(period AS DATE) AS date, avg(demand_mw) AS demand_mw, avg(forecast_mw) AS forecast_mw, avg(interchange_mw) AS interchange_mw FROM demand
       WHERE period BETWEEN TIMESTAMP '2024-01-08' AND TIMESTAMP '2024-01-20' GROUP BY 1""",
    "demand_mw forecast_mw interchange_mw",
)
def _(t):
    return aggregates.signal_timeline(b.demand(t), "2024-01-08", "2024-01-20", ["demand_mw", "forecast_mw", "interchange_mw"])


@query(
    "event_tiers_daily",
    """SELECT CAST(ts AS DATE) AS event_date, count(*) AS event_count, avg(g) AS avg_goldstein, min(g) AS min_goldstein, max(g) AS max_goldstein,
              stddev_samp(g) AS std_goldstein, avg(tone) AS avg_tone, min(tone) AS min_tone, sum(k)::BIGINT AS total_mentions,
              count(*)::BIGINT AS total_articles, count(*) FILTER (WHERE g <= -7) AS severe_conflict,
              count(*) FILTER (WHERE g > -7 AND g <= -4) AS moderate_conflict, count(*) FILTER (WHERE g > -4 AND g < 0) AS tension_count,
              count(*) FILTER (WHERE g >= 4) AS cooperation_count, count(*) FILTER (WHERE tone <= -5) AS very_negative,
              count(*) FILTER (WHERE g <= -7 AND tone <= -5) AS crisis_events
       FROM (SELECT *, k / 5.0 - 10 AS g, value / 10.0 - 8 AS tone FROM ev) GROUP BY 1""",
    "avg_goldstein min_goldstein max_goldstein std_goldstein avg_tone min_tone",
)
def _(t):
    e = b.events(t).select(
        F.to_date("ts").alias("event_date"), (F.col("k") / 5.0 - 10).alias("goldstein"), (F.col("value") / 10.0 - 8).alias("tone"),
        F.col("k").alias("mentions"), F.lit(1).alias("articles"),
    )
    return aggregates.event_tiers_daily(e)


_THEMES = [name for names in THEME_GROUPS.values() for name in names] + ["TAX_FNCACT", "EDUCATION"]
_THEMED = {
    "themed": f"""SELECT CAST(ts AS DATE) AS article_date, {b.pick_sql(b.STATES, 'user_id')} AS state_code,
                         [{b.pick_sql(_THEMES, 'k')}, {b.pick_sql(_THEMES, 'event_id')}] AS themes, value / 10.0 - 8 AS tone FROM ev"""
}


def _any(names) -> str:
    return f"list_has_any(themes, {b._list(names)})"


@query(
    "theme_counts",
    f"""SELECT state_code, article_date, count(*) AS total_energy_articles,
               {', '.join(f"count(*) FILTER (WHERE {_any(names)}) AS {g}_articles" for g, names in THEME_GROUPS.items())},
               avg(tone) AS avg_energy_tone, min(tone) AS min_energy_tone, stddev_samp(tone) AS std_energy_tone FROM themed GROUP BY 1, 2""",
    "avg_energy_tone min_energy_tone std_energy_tone",
    ctes=_THEMED,
)
def _(t):
    return aggregates.theme_counts(_themed(t))


def _themed(t):
    e = b.events(t)
    return e.select(
        F.to_date("ts").alias("article_date"),
        b.pick(b.STATES, "user_id").alias("state_code"),
        F.concat_ws(";", b.pick(_THEMES, "k"), b.pick(_THEMES, "event_id")).alias("themes"),
        (F.col("value") / 10.0 - 8).alias("tone"),
    )


@query(
    "signal_correlations",
    """SELECT ba_code, corr(temperature_c, demand_mw) AS corr_temperature_c, corr(hdd, demand_mw) AS corr_hdd,
              corr(cdd, demand_mw) AS corr_cdd, corr(gas_price, demand_mw) AS corr_gas_price FROM base GROUP BY 1""",
    "corr_temperature_c corr_hdd corr_cdd corr_gas_price",
)
def _(t):
    return aggregates.group_corr(b.features(t), ["temperature_c", "hdd", "cdd", "gas_price"])


_YEARS = {
    "ywins": "SELECT * FROM (VALUES " + ", ".join(f"('{k}', DATE '{a}', DATE '{z}')" for k, _, a, z, _e in YEAR_WINDOWS) + ") v(win, a, z)",
    "ydaily": f"SELECT CAST(l_shipdate AS DATE) AS date, {b.ba_sql('l_suppkey')} AS ba_code, avg(l_extendedprice) AS x FROM lineitem GROUP BY 1, 2",
}


def _yearly(t, *by):
    cols = {"ba_code": b.ba("l_suppkey").alias("ba_code")}
    return t.lineitem.groupBy(F.to_date("l_shipdate").alias("date"), *[cols[c] for c in by]).agg(F.avg("l_extendedprice").alias("x"))


@query(
    "crisis_separation",
    """SELECT *, mean - max(CASE WHEN "window" = 'normal' THEN mean END) OVER () AS from_normal FROM (
         SELECT coalesce(win, 'normal') AS "window", count(x) AS n_days, avg(x) AS mean, stddev_samp(x) AS std
         FROM (SELECT date, avg(l_extendedprice) AS x FROM (SELECT CAST(l_shipdate AS DATE) AS date, l_extendedprice FROM lineitem) GROUP BY 1)
         LEFT JOIN ywins ON date BETWEEN a AND z GROUP BY 1)""",
    "mean std from_normal",
    ctes=_YEARS,
)
def _(t):
    return aggregates.separation(_yearly(t), "x", YEAR_WINDOWS)


@query(
    "year_over_year",
    """SELECT ba_code, "window", in_window, year_before, (in_window - year_before) / nullif(year_before, 0) * 100 AS change_pct FROM (
         SELECT ba_code, win AS "window", avg(CASE WHEN date BETWEEN a AND z THEN x END) AS in_window,
                avg(CASE WHEN date + INTERVAL 12 MONTH BETWEEN a AND z THEN x END) AS year_before
         FROM ydaily JOIN ywins ON date BETWEEN a AND z OR date + INTERVAL 12 MONTH BETWEEN a AND z GROUP BY 1, 2)""",
    "in_window year_before change_pct",
    ctes=_YEARS,
)
def _(t):
    return aggregates.yoy_change(_yearly(t, "ba_code"), "x", YEAR_WINDOWS)


_STRESS = {
    "zdaily": "SELECT *, (y - avg(y) OVER (PARTITION BY ba_code)) / nullif(stddev_samp(y) OVER (PARTITION BY ba_code), 0) AS demand_z FROM daily",
    "stressed": f"""SELECT z.ba_code, z.date, z.demand_z, CAST(r.gs AS DOUBLE) AS grid_stress, r.tone
                    FROM zdaily z JOIN ({_RATED}) r ON r.ba_code = z.ba_code AND r.article_date = z.date""",
    **_MAP,
}


def _stressed(t):
    news = aggregates.news_daily(b.state_news(t)).select(
        "ba_code", F.col("article_date").alias("date"), F.col("grid_stress_articles").cast("double").alias("grid_stress"), F.col("avg_energy_tone").alias("tone")
    )
    return aggregates.demand_z(b.daily(t)).join(news, ["ba_code", "date"]).select("ba_code", "date", "demand_z", "grid_stress", "tone")


@query(
    "extreme_day_test",
    """SELECT s.ba_code, grid_stress > cut AS is_extreme, count(*) AS n_days, avg(demand_z) AS avg_demand_z, avg(tone) AS avg_tone
       FROM stressed s JOIN (SELECT ba_code, quantile_cont(grid_stress, 0.9) AS cut FROM stressed GROUP BY 1) c ON c.ba_code = s.ba_code GROUP BY 1, 2""",
    "avg_demand_z avg_tone",
    ctes=_STRESS,
)
def _(t):
    return aggregates.extreme_day_test(_stressed(t), q=0.9)


@query(
    "top_stress_days",
    "SELECT * FROM stressed ORDER BY grid_stress DESC, ba_code, date LIMIT 20",
    "demand_z grid_stress tone",
    ctes=_STRESS,
)
def _(t):
    return aggregates.top_stress_days(_stressed(t))


@query(
    "spike_catalogue",
    """SELECT b.ba_code, month(period) AS month, count(*) FILTER (WHERE demand_mw > cut) AS n_spikes,
              avg(CAST(demand_mw > cut AS INTEGER)) AS spike_share, avg(CASE WHEN demand_mw > cut THEN temperature_c END) AS avg_spike_temp
       FROM base b JOIN (SELECT ba_code, quantile_cont(demand_mw, 0.95) AS cut FROM demand GROUP BY 1) c ON c.ba_code = b.ba_code GROUP BY 1, 2""",
    "spike_share avg_spike_temp",
)
def _(t):
    from wattline.operators.joins import join_weather

    return aggregates.spike_catalogue(join_weather(slim(t), b.weather(t)))


_WEIGHTS = {
    "loads": "SELECT ba_code, state_code, CAST(1 + (length(ba_code) * 7 + ascii(state_code)) % 5 AS DOUBLE) AS weight FROM feeds",
    **_MAP,
}


@query(
    "weighted_state_average",
    """SELECT ba_code, article_date, sum(avg_energy_tone * weight) / sum(weight) AS weighted
       FROM state_news n JOIN loads l ON l.state_code = n.state_code GROUP BY 1, 2""",
    "weighted",
    ctes=_WEIGHTS,
)
def _(t):
    listed = ", ".join(f"('{ba}', '{s}')" for ba, states in b.BA_STATES.items() for s in states)
    feeds = t.spark.sql(f"SELECT * FROM VALUES {listed} AS v(ba_code, state_code)")
    weights = feeds.withColumn("weight", (1 + (F.length("ba_code") * 7 + F.ascii("state_code")) % 5).cast("double"))
    return aggregates.weighted_state_avg(b.state_news(t), weights, ["article_date"], "avg_energy_tone")


LEXICONS = {"doubt": ["the", "la", "die", "el"], "economy": ["of", "de", "und", "and"], "policy": ["in", "on", "en", "with"]}
_WORDS = "regexp_split_to_array(lower(text), '[^\\p{L}]+')"
_UNCERTAIN = f"""SELECT DATE '2024-01-01' + CAST(doc_id % 30 AS INTEGER) AS date,
                        avg(CAST({' AND '.join(f"list_has_any({_WORDS}, {b._list(words)})" for words in LEXICONS.values())} AS INTEGER)) AS uncertainty,
                        count(*) AS intensity FROM documents GROUP BY 1"""


def _uncertain(t):
    dated = t.documents.withColumn("date", F.date_add(F.lit(b.EPOCH).cast("date"), (F.col("doc_id") % 30).cast("int")))
    return aggregates.uncertainty_daily(dated, LEXICONS)


@query("uncertainty_index", _UNCERTAIN, "uncertainty")
def _(t):
    return _uncertain(t)


@query(
    "policy_sensitivity",
    f"""SELECT ba_code, corr(dx, dy) AS policy_sensitivity FROM
          (SELECT date, uncertainty - lag(uncertainty) OVER (ORDER BY date) AS dx FROM ({_UNCERTAIN})) i
          JOIN (SELECT ba_code, date, y - lag(y) OVER (PARTITION BY ba_code ORDER BY date) AS dy FROM daily) d ON d.date = i.date GROUP BY 1""",
    "policy_sensitivity",
)
def _(t):
    return aggregates.policy_sensitivity(b.daily(t), _uncertain(t))


@query(
    "seasonal_risk",
    """SELECT ba_code, 'winter' AS season, avg(CAST(is_spike AS INTEGER)) AS spike_rate, avg(CASE WHEN is_spike THEN spike_magnitude END) AS avg_magnitude
       FROM features GROUP BY 1""",
    "spike_rate avg_magnitude",
)
def _(t):
    return aggregates.season_risk(features.spikes(slim(t)))


@query("ordered_panel", "SELECT period, ba_code, demand_mw FROM demand ORDER BY ba_code, period", "demand_mw")
def _(t):
    return aggregates.ordered(slim(t))


@query(
    "best_run",
    "SELECT arg_min(o_orderkey, o_totalprice) AS run, min(o_totalprice) AS val_loss FROM orders",
    "val_loss",
)
def _(t):
    return aggregates.best_run(t.orders.select(F.col("o_orderkey").alias("run"), F.col("o_totalprice").alias("val_loss")))


@query(
    "largest_orders",
    "SELECT o_orderkey AS variable, o_totalprice AS importance FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10",
    "importance",
)
def _(t):
    o = t.orders.select(F.col("o_orderkey").alias("variable"), F.col("o_totalprice").alias("importance"))
    return aggregates.top_k(o, "importance", 10, ["variable"])


# --- preparation of the model frame ----------------------------------------------------------------

SPLITS = {"train": ("2024-01-01", "2024-01-15"), "val": ("2024-01-15", "2024-01-22"), "test": ("2024-01-22", "2024-01-29")}


@query(
    "load_features",
    "SELECT period, ba_code, demand_mw, demand_lag_168h FROM features WHERE demand_mw IS NOT NULL AND demand_lag_168h IS NOT NULL",
    "demand_mw demand_lag_168h",
)
def _(t):
    return prep.load_features(b.features(t)).select("period", "ba_code", "demand_mw", "demand_lag_168h")


@query(
    "split_labels",
    """SELECT period, ba_code, CASE WHEN period < TIMESTAMP '2024-01-15' THEN 'train' WHEN period < TIMESTAMP '2024-01-22' THEN 'val'
              WHEN period < TIMESTAMP '2024-01-29' THEN 'test' END AS split FROM demand""",
)
def _(t):
    return prep.label_split(slim(t), SPLITS).select("period", "ba_code", "split")


@query(
    "ordered_split",
    """WITH i AS (SELECT period, ba_code, date_diff('hour', (SELECT min(period) FROM demand), period) AS time_idx FROM demand)
       SELECT *, time_idx <= (SELECT quantile_cont(time_idx, 0.8) FROM i) AS is_train FROM i""",
)
def _(t):
    return prep.ordered_split(features.time_index(slim(t).drop("demand_mw")))


@query(
    "category_codes",
    """SELECT period, ba_code, CASE WHEN r IS NULL THEN (SELECT count(DISTINCT ba_code) FROM demand WHERE ba_code < 'N') ELSE r END AS ba_code_code FROM demand d
       LEFT JOIN (SELECT ba_code AS b, row_number() OVER (ORDER BY ba_code) - 1 AS r FROM (SELECT DISTINCT ba_code FROM demand WHERE ba_code < 'N')) x ON x.b = d.ba_code""",
)
def _(t):
    d = slim(t).drop("demand_mw")
    return prep.encode(d.where("ba_code < 'N'"), d, ["ba_code"]).withColumn("ba_code_code", F.col("ba_code_code").cast("int"))


_FILLED = """coalesce(last_value({c} IGNORE NULLS) OVER (PARTITION BY ba_code ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                      first_value({c} IGNORE NULLS) OVER (PARTITION BY ba_code ORDER BY period ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""


@query(
    "impute_chain",
    f"""WITH h AS (SELECT period, ba_code, CASE WHEN ba_code = 'PJM' THEN NULL ELSE interchange_mw END AS a, generation_mw AS g FROM demand)
        SELECT period, ba_code, coalesce({_FILLED.format(c='a')}, 0) AS a, coalesce({_FILLED.format(c='g')}, 0) AS g FROM h""",
    "a g",
)
def _(t):
    d = b.demand(t).select(
        "period", "ba_code", F.when(F.col("ba_code") != "PJM", F.col("interchange_mw")).alias("a"), F.col("generation_mw").alias("g")
    )
    return prep.impute(d, ["a", "g"])


@query(
    "median_imputation",
    """SELECT period, ba_code, coalesce(interchange_mw, median(interchange_mw) OVER (PARTITION BY ba_code)) AS interchange_mw FROM demand""",
    "interchange_mw",
)
def _(t):
    return prep.group_median(b.demand(t).select("period", "ba_code", "interchange_mw"), ["interchange_mw"])


def _frame_sql(variant: str) -> tuple[str, str]:
    statics = ["gas_sensitivity", "renewable_sensitivity", "nuclear_sensitivity"]
    known = ["temperature_c", "hdd", "cdd", "prophet_trend", "prophet_weekly", "prophet_yearly"]
    carried = list(VARIANT_REALS[variant])
    medians_of = [*known, *carried]
    filled = ", ".join(f"{_FILLED.format(c=f'CAST({c} AS DOUBLE)')} AS {c}" for c in carried)
    fixed = ", ".join(f"coalesce({c}, median({c}) OVER (PARTITION BY ba_code), 0) AS {c}" for c in medians_of)
    weight = "1.0"
    if variant == "C":
        weight = "1 + 2 * least(greatest(greatest(" + ", ".join(f"abs({c})" for c in _GKG) + ") - 1, 0), 4)"
    sql = f"""
      SELECT *, {weight} AS weight FROM (
        SELECT period, ba_code, time_idx, demand_mw, hour_of_day, day_of_week, month, {', '.join(statics)}, is_weekend, is_holiday,
               is_pre_holiday, is_post_holiday, {fixed}
        FROM (SELECT period, ba_code, date_diff('hour', (SELECT min(period) FROM demand), period) AS time_idx, demand_mw, hour_of_day, day_of_week, month,
                     {', '.join(f'coalesce({c}, 0) AS {c}' for c in statics)}, CAST(CAST(is_weekend AS INTEGER) AS VARCHAR) AS is_weekend,
                     CAST(CAST(is_holiday AS INTEGER) AS VARCHAR) AS is_holiday,
                     CAST(coalesce(lead(CAST(is_holiday AS INTEGER), 24) {W}, 0) AS VARCHAR) AS is_pre_holiday,
                     CAST(coalesce(lag(CAST(is_holiday AS INTEGER), 24) {W}, 0) AS VARCHAR) AS is_post_holiday,
                     {', '.join(known)}, {filled}
              FROM (SELECT * REPLACE (least(greatest(renewable_pct, 0), 100) AS renewable_pct) FROM ({_SIGNALS}))))
      WHERE demand_mw > 0"""
    return sql, " ".join(["demand_mw", *statics, *medians_of, "weight"])


for _variant in ("A", "B", "C"):
    _sql, _floats = _frame_sql(_variant)

    @query(f"model_frame_{_variant.lower()}", _sql, _floats, ctes=_MAP)
    def _(t, variant=_variant):
        return model_frame(stage(signals(t), "features"), variant)


@query(
    "variant_columns",
    "SELECT period, 0::BIGINT AS time_idx, demand_mw, ba_code, hour_of_day, day_of_week, month, temperature_c, hdd, cdd, prophet_trend, prophet_weekly, prophet_yearly, "
    "gas_sensitivity, renewable_sensitivity, nuclear_sensitivity, is_weekend, is_holiday, FALSE AS is_pre_holiday, FALSE AS is_post_holiday, "
    + ", ".join(VARIANT_REALS["A"]) + f" FROM ({_SIGNALS})",
    "demand_mw temperature_c hdd cdd prophet_trend prophet_weekly prophet_yearly gas_sensitivity renewable_sensitivity nuclear_sensitivity " + " ".join(VARIANT_REALS["A"]),
    ctes=_MAP,
)
def _(t):
    from wattline.operators.quality import select_variant

    none = F.lit(False)
    return select_variant(signals(t).withColumns({"time_idx": F.lit(0).cast("long"), "is_pre_holiday": none, "is_post_holiday": none}), "A")

