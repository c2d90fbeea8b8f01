"""Supply risk, prediction rounds, forecasts and models."""

from __future__ import annotations

from pyspark.sql import functions as F

from wattline.catalog import bindings as b
from wattline.catalog.registry import query
from wattline.lineage import stage
from wattline.operators import forecast, panel, risk
from wattline.reference_data import QUANTILE_COLUMNS, QUANTILES

_RISK = {
    "edges": "SELECT DISTINCT fromba AS src, toba AS dst FROM interchange UNION SELECT DISTINCT toba, fromba FROM interchange",
    "gaps": "SELECT period, ba_code, generation_mw - demand_mw AS gap FROM demand",
    "subs": f"""SELECT user_id AS node_id, {b.ba_sql('event_id')} AS ba_code, date_trunc('hour', ts) AS target, CAST(floor(value) AS BIGINT) AS predicted_mw, k * 130 AS prob_bp FROM ev""",
}


def _edges(t):
    return risk.ba_edges(b.interchange(t))


@query("area_edges", "SELECT src, dst FROM edges", ctes=_RISK)
def _(t):
    return _edges(t)


@query(
    "neighbour_cover",
    """SELECT s.period, s.ba_code, -s.gap AS deficit_mw, coalesce(sum(o.gap), 0) AS neighbour_mw, coalesce(sum(o.gap), 0) >= -s.gap AS covered
       FROM gaps s LEFT JOIN (SELECT g.period, g.gap, e.dst FROM gaps g JOIN edges e ON e.src = g.ba_code WHERE g.gap > 0) o ON o.period = s.period AND o.dst = s.ba_code
       WHERE s.gap < 0 GROUP BY s.period, s.ba_code, s.gap""",
    "deficit_mw neighbour_mw",
    ctes=_RISK,
)
def _(t):
    return risk.neighbour_cover(b.demand(t), _edges(t))


@query(
    "match_surplus",
    """SELECT period, buyer, seller, deficit_mw, surplus_mw FROM (
         SELECT s.period, s.ba_code AS buyer, o.ba_code AS seller, -s.gap AS deficit_mw, o.gap AS surplus_mw,
                row_number() OVER (PARTITION BY s.period, s.ba_code ORDER BY o.gap DESC, o.ba_code DESC) AS rn
         FROM gaps s JOIN edges e ON e.dst = s.ba_code JOIN gaps o ON o.ba_code = e.src AND o.period = s.period
         WHERE s.gap < 0 AND o.gap > 0 AND o.gap >= -s.gap) WHERE rn = 1""",
    "deficit_mw surplus_mw",
    ctes=_RISK,
)
def _(t):
    return risk.match_surplus(b.demand(t), _edges(t))


_CENTRES = ", ".join(f"('{k}', {la}::DOUBLE, {lo}::DOUBLE)" for k, (la, lo) in risk.BA_CENTRES.items())
_NEAR = {
    "centres": f"SELECT * FROM (VALUES {_CENTRES}) v(ba_code, lat, lon)",
    "placed": """SELECT event_id, CAST(ts AS DATE) AS date, 25 + k * 0.23 AS latitude, -120.0::DOUBLE + (user_id * 7 % 460) / 10.0 AS longitude, value / 10.0 - 8 AS tone FROM ev""",
    "near": """SELECT p.*, c.ba_code FROM placed p JOIN centres c ON
                 2 * 3958.8 * asin(least(sqrt(sin(radians(lat - latitude) / 2) ** 2 + cos(radians(latitude)) * cos(radians(lat)) * sin(radians(lon - longitude) / 2) ** 2), 1.0)) <= 100""",
}


def _placed(t):
    return b.events(t).select(
        "event_id", F.to_date("ts").alias("date"), (25 + F.col("k") * F.lit(0.23)).alias("latitude"),
        (-120.0 + (F.col("user_id") * 7 % 460) / 10.0).alias("longitude"), (F.col("value") / 10.0 - 8).alias("tone"),
    )


@query("articles_near_centres", "SELECT event_id, ba_code FROM near", ctes=_NEAR)
def _(t):
    return risk.near_ba(_placed(t)).select("event_id", "ba_code")


@query(
    "station_tone",
    "SELECT ba_code, date, count(*) AS n_articles, avg(tone) AS avg_tone, min(tone) AS min_tone FROM near GROUP BY 1, 2",
    "avg_tone min_tone",
    ctes=_NEAR,
)
def _(t):
    return risk.station_tone(_placed(t))


def submissions(t):
    return b.events(t).select(
        F.col("user_id").alias("node_id"), b.ba("event_id").alias("ba_code"), F.col("period").alias("target"),
        F.floor("value").cast("bigint").alias("predicted_mw"), (F.col("k") * 130).cast("bigint").alias("prob_bp"),
    )


_MEDIAN = "CASE WHEN n % 2 = 1 THEN {c}[(n + 1) // 2] ELSE ({c}[n // 2] + {c}[n // 2 + 1]) // 2 END"


@query(
    "round_consensus",
    f"""SELECT ba_code, target, {_MEDIAN.format(c='m')}::BIGINT AS median_mw, {_MEDIAN.format(c='p')}::BIGINT AS median_prob_bp, n AS n_submissions FROM (
          SELECT ba_code, target, list_sort(list(predicted_mw)) AS m, list_sort(list(prob_bp)) AS p, count(*) AS n FROM subs WHERE prob_bp <= 10000 GROUP BY 1, 2)""",
    ctes=_RISK,
)
def _(t):
    return risk.consensus(submissions(t))


@query(
    "node_statistics",
    """SELECT s.node_id, n_submissions, least(coalesce(n_penalties, 0), 2) AS n_penalties, (95 - 40 * least(coalesce(n_penalties, 0), 2))::BIGINT AS remaining_stake
       FROM (SELECT node_id, count(*) AS n_submissions FROM subs GROUP BY 1) s
       LEFT JOIN (SELECT node_id, count(*) AS n_penalties FROM subs WHERE prob_bp > 8000 GROUP BY 1) p ON p.node_id = s.node_id""",
    ctes=_RISK,
)
def _(t):
    s = submissions(t)
    return risk.node_stats(s, s.where("prob_bp > 8000").select("node_id", F.lit(40).alias("amount")), stake=95)


@query(
    "settle_rounds",
    """WITH c AS (SELECT s.*, d.demand_mw AS actual, abs(predicted_mw - demand_mw) > 0.5 * abs(demand_mw) AS penalised
                  FROM subs s JOIN demand d ON d.ba_code = s.ba_code AND d.period = s.target),
            p AS (SELECT ba_code, target, count(*) FILTER (WHERE penalised) * 100.0::DOUBLE AS pool, count(*) FILTER (WHERE NOT penalised) AS w FROM c GROUP BY 1, 2)
       SELECT c.node_id, c.ba_code, c.target, predicted_mw, actual, penalised, CASE WHEN penalised THEN -100.0::DOUBLE ELSE pool / nullif(w, 0) END AS balance
       FROM c JOIN p ON p.ba_code = c.ba_code AND p.target = c.target""",
    "actual balance",
    ctes=_RISK,
)
def _(t):
    actuals = b.demand(t).select("ba_code", F.col("period").alias("target"), F.col("demand_mw").alias("actual"))
    return risk.settle(submissions(t), actuals, tol=0.5)


@query(
    "hourly_limits",
    """SELECT ba_code, extract(hour FROM period) AS hour, extract(dow FROM period) + 1 AS dow, quantile_cont(demand_mw, 0.95) AS limit_mw FROM demand GROUP BY 1, 2, 3""",
    "limit_mw",
)
def _(t):
    return risk.hourly_limits(b.demand(t))


@query(
    "alert_rules",
    """SELECT f.period, f.ba_code, demand_surge, supply_shortfall, renewable_drop, nuclear_outage,
              CAST(demand_surge AS BIGINT) + CAST(supply_shortfall AS INTEGER) + CAST(renewable_drop AS INTEGER) + CAST(nuclear_outage AS INTEGER) AS n_alerts
       FROM (SELECT f.period, f.ba_code, coalesce(demand_rolling_24h > limit_mw, FALSE) AS demand_surge,
                    coalesce(demand_rolling_24h > generation_mw + coalesce(interchange_mw, 0), FALSE) AS supply_shortfall,
                    coalesce(renewable_pct < renewable_normal * 0.5, FALSE) AS renewable_drop, coalesce(nuclear_outage_pct > 5, FALSE) AS nuclear_outage
             FROM features f JOIN (SELECT ba_code, avg(renewable_pct) AS renewable_normal FROM features GROUP BY 1) r ON r.ba_code = f.ba_code
             LEFT JOIN (SELECT ba_code, extract(hour FROM period) AS hour, extract(dow FROM period) AS dow, quantile_cont(demand_mw, 0.95) AS limit_mw FROM demand GROUP BY 1, 2, 3) l
               ON l.ba_code = f.ba_code AND l.hour = f.hour_of_day AND l.dow = f.day_of_week) f""",
)
def _(t):
    f = stage(b.features(t), "features")
    normal = f.groupBy("ba_code").agg(F.avg("renewable_pct").alias("renewable_normal"))
    rows = f.join(normal, "ba_code").withColumnRenamed("demand_rolling_24h", "q50")
    return risk.alerts(rows, risk.hourly_limits(b.demand(t)), outage_pct=5.0)


_AREA_FUEL = "SELECT ba_code, " + ", ".join(f"sum({c}) AS {c}" for c in ["coal_mw", "gas_mw", "nuclear_mw", "oil_mw", "solar_mw", "hydro_mw", "wind_mw", "other_mw", "total_mw"]) + " FROM daily_fuel_mix GROUP BY 1"
_CASCADE = {
    **_RISK,
    "st0": f"""SELECT ba_code, total_mw, CASE WHEN gas_mw / total_mw > 0.111 THEN gas_mw * 0.9 ELSE 0 END + CASE WHEN coal_mw / total_mw > 0.111 THEN coal_mw * 0.9 ELSE 0 END AS shortfall_mw FROM ({_AREA_FUEL})""",
    "st1": "SELECT ba_code, shortfall_mw AS need, CASE WHEN shortfall_mw > 0 THEN 0 ELSE total_mw * 0.1 END AS offer FROM st0",
}


def _hop(number: int, state: str, reach: str) -> dict[str, str]:
    return {
        f"pr{number}": f"SELECT r.src, r.dst, n.need, o.offer FROM {reach} r JOIN {state} n ON n.ba_code = r.dst AND n.need > 0 JOIN {state} o ON o.ba_code = r.src AND o.offer > 0",
        f"of{number}": f"SELECT *, offer * need / greatest(sum(need) OVER (PARTITION BY src), offer) AS give0 FROM pr{number}",
        f"gv{number}": f"SELECT *, give0 * least(1.0, need / sum(give0) OVER (PARTITION BY dst)) AS give FROM of{number}",
        f"st{number + 1}": f"""SELECT s.ba_code, need - least(coalesce(got, 0), need) AS need, greatest(offer - coalesce(spent, 0), 0) AS offer FROM {state} s
            LEFT JOIN (SELECT dst, sum(give) AS got FROM gv{number} GROUP BY 1) g ON g.dst = s.ba_code LEFT JOIN (SELECT src, sum(give) AS spent FROM gv{number} GROUP BY 1) p ON p.src = s.ba_code""",
    }


_CASCADE |= _hop(1, "st1", "edges")
_CASCADE["reach2"] = "SELECT DISTINCT a.src, z.dst FROM edges a JOIN edges z ON z.src = a.dst WHERE a.src <> z.dst"
_CASCADE |= _hop(2, "st2", "reach2")


@query(
    "cascade",
    """SELECT z.ba_code, shortfall_mw, shortfall_mw - f.need AS compensated_mw, coalesce(f.need / nullif(total_mw, 0) * 100, 0) AS risk_score,
              CASE WHEN f.need > 1e-6 THEN 0 ELSE (SELECT min(hop) FROM (SELECT src, dst, 1 AS hop FROM edges UNION ALL SELECT src, dst, 2 FROM reach2) w
                 JOIN st3 u ON u.ba_code = w.dst AND u.need > 1e-6 WHERE w.src = z.ba_code) END AS impact_hops
       FROM st0 z JOIN st3 f ON f.ba_code = z.ba_code""",
    "shortfall_mw compensated_mw risk_score",
    digits=3,
    ctes=_CASCADE,
)
def _(t):
    mix = panel.pivot_fuel(b.daily_fuel_readings(t))
    fuel = mix.groupBy("ba_code").agg(*[F.sum(c).alias(c) for c in mix.columns if c.endswith("_mw")])
    return risk.cascade({"gas_mw": 0.9, "coal_mw": 0.9}, fuel, _edges(t), hops=2, min_share=0.111)


@query(
    "fuel_vulnerability",
    """SELECT ba_code, fuel, share, CASE WHEN share > 0.12 THEN 'HIGH' WHEN share > 0.1 THEN 'MEDIUM' ELSE 'LOW' END AS vulnerability FROM (
         SELECT ba_code, unnest(['coal', 'gas', 'nuclear', 'oil', 'solar', 'hydro', 'wind', 'other']) AS fuel,
                unnest([avg(coal_mw / nullif(total_mw, 0)), avg(gas_mw / nullif(total_mw, 0)), avg(nuclear_mw / nullif(total_mw, 0)), avg(oil_mw / nullif(total_mw, 0)),
                        avg(solar_mw / nullif(total_mw, 0)), avg(hydro_mw / nullif(total_mw, 0)), avg(wind_mw / nullif(total_mw, 0)), avg(other_mw / nullif(total_mw, 0))]) AS share FROM daily_fuel_mix GROUP BY 1)""",
    "share",
)
def _(t):
    mix = panel.pivot_fuel(b.daily_fuel_readings(t))
    fuels = [c.removesuffix("_mw") for c in mix.columns if c.endswith("_mw") and c != "total_mw"]
    p = mix.groupBy("ba_code").agg(*[F.avg(F.try_divide(f"{n}_mw", "total_mw")).alias(n) for n in fuels])
    return risk.vulnerability(p, fuels, high=0.12, medium=0.1)


@query(
    "alert_episodes",
    """SELECT ba_code, min(period) AS first_hour, max(period) AS last_hour, count(*) AS n_hours, max(spike_magnitude) AS max_magnitude FROM (
         SELECT *, sum(CASE WHEN gap <= 21600 THEN 0 ELSE 1 END) OVER (PARTITION BY ba_code ORDER BY period) AS grp FROM (
           SELECT *, epoch(period) - epoch(lag(period) OVER (PARTITION BY ba_code ORDER BY period)) AS gap FROM features WHERE is_spike)) GROUP BY ba_code, grp""",
    "max_magnitude",
)
def _(t):
    from wattline.operators.features import spikes

    return risk.episodes(spikes(b.demand(t).select("period", "ba_code", "demand_mw")), gap_hours=6)


@query(
    "verified_predictions",
    "SELECT period AS target_period, ba_code, (extract(day FROM period) <> 7) AS intact FROM forecasts WHERE model = 'A'",
)
def _(t):
    from wattline.sinks import log_predictions

    log = log_predictions(b.forecasts(t).where("model = 'A'"), F.lit("2024-02-01").cast("timestamp"), "A")
    ledger = log.select("ba_code", "target_period", "model_name", "prediction_hash")
    # predictions of one day are altered after they were sealed
    touched = log.withColumn("prediction_hash", F.when(F.dayofmonth("target_period") == 7, F.sha2(F.lit("x"), 256)).otherwise(F.col("prediction_hash")))
    return risk.verify_predictions(touched, ledger).select("target_period", "ba_code", "intact")


# --- models and forecasts ---------------------------------------------------------------------


_NAMES = [f"q{round(q * 100):02d}" for q in QUANTILES]


@query(
    "quantile_forecast",
    f"""WITH p AS (SELECT * FROM (SELECT period, ba_code, demand_mw, lag(demand_mw, 24) OVER (PARTITION BY ba_code ORDER BY period) AS p FROM demand) WHERE p IS NOT NULL),
             r AS (SELECT ba_code, extract(hour FROM period) AS hour, {', '.join(f'quantile_cont(demand_mw - p, {q}) AS r{n}' for q, n in zip(QUANTILES, _NAMES, strict=True))}
                   FROM p WHERE period < TIMESTAMP '2024-01-21' GROUP BY 1, 2)
        SELECT p.period, p.ba_code, 'seasonal' AS model, demand_mw AS actual, {', '.join(f'p + r{n} AS {n}' for n in _NAMES)}
        FROM p LEFT JOIN r ON r.ba_code = p.ba_code AND r.hour = extract(hour FROM p.period) WHERE p.period >= TIMESTAMP '2024-01-21'""",
    "actual " + " ".join(QUANTILE_COLUMNS),
)
def _(t):
    return forecast.forecast(b.demand(t), "2024-01-21")


@query(
    "seasonal_naive",
    "SELECT period, ba_code, demand_mw, lag(demand_mw, 24) OVER (PARTITION BY ba_code ORDER BY period) AS q50 FROM demand",
    "demand_mw q50",
)
def _(t):
    return forecast.seasonal_naive(b.demand(t).select("period", "ba_code", "demand_mw"))


@query("seasonal_decomposition", "SELECT * FROM season_parts", "prophet_trend prophet_weekly prophet_yearly y")
def _(t):
    return forecast.decompose(b.seasonal_daily(t))


@query(
    "residual_anomalies",
    """WITH r AS (SELECT ba_code, date, y - prophet_trend - prophet_weekly - prophet_yearly AS residual FROM season_parts),
            d AS (SELECT r.*, residual - m AS off, abs(residual - m) AS dev FROM r JOIN (SELECT ba_code, median(residual) AS m FROM r GROUP BY 1) c ON c.ba_code = r.ba_code),
            s AS (SELECT ba_code, median(dev) AS mad FROM d GROUP BY 1)
       SELECT d.ba_code, date, residual, 0.6745 * off / nullif(mad, 0) AS robust_z, coalesce(abs(0.6745 * off / nullif(mad, 0)) > 3.5, FALSE) AS is_anomaly
       FROM d JOIN s ON s.ba_code = d.ba_code""",
    "residual robust_z",
)
def _(t):
    parts = forecast.decompose(b.seasonal_daily(t))
    residual = parts.select("ba_code", "date", (F.col("y") - F.col("prophet_trend") - F.col("prophet_weekly") - F.col("prophet_yearly")).alias("residual"))
    return forecast.anomalies(stage(residual, "residual"), "residual")


@query(
    "robust_anomalies",
    """WITH m AS (SELECT ba_code, median(demand_mw) AS med FROM demand GROUP BY 1), d AS (SELECT d.*, med, abs(demand_mw - med) AS dev FROM demand d JOIN m ON m.ba_code = d.ba_code),
            s AS (SELECT ba_code, median(dev) AS mad FROM d GROUP BY 1)
       SELECT period, d.ba_code, demand_mw, 0.6745 * (demand_mw - med) / nullif(mad, 0) AS robust_z, coalesce(abs(0.6745 * (demand_mw - med) / nullif(mad, 0)) > 3.5, FALSE) AS is_anomaly
       FROM d JOIN s ON s.ba_code = d.ba_code""",
    "demand_mw robust_z",
)
def _(t):
    return forecast.anomalies(b.demand(t).select("period", "ba_code", "demand_mw"), "demand_mw")


# boosted trees and clusters have no SQL form; their properties are tested instead
@query("spike_probabilities")
def _(t):
    f = stage(b.features(t).where("demand_lag_24h IS NOT NULL"), "features")
    model = forecast.spike_model(f.where("period < '2024-01-25'"))
    return forecast.spike_probability(model, f.where("period >= '2024-01-25'")).select("period", "ba_code", "is_spike", "spike_prob")


@query("feature_importance")
def _(t):
    f = stage(b.features(t).where("demand_lag_24h IS NOT NULL"), "features")
    return forecast.importance(forecast.spike_model(f))


@query("load_profiles")
def _(t):
    return forecast.load_profiles(b.demand(t))


_HOURS = [f"h{h:02d}" for h in range(24)]


@query(
    "day_profiles",
    f"""SELECT ba_code, date, {', '.join(f'coalesce(h{h:02d} / nullif(m, 0), 1) AS h{h:02d}' for h in range(24))} FROM (
          SELECT ba_code, CAST(period AS DATE) AS date, avg(demand_mw) AS m, {', '.join(f'avg(CASE WHEN extract(hour FROM period) = {h} THEN demand_mw END) AS h{h:02d}' for h in range(24))}
          FROM demand GROUP BY 1, 2)""",
    " ".join(_HOURS),
)
def _(t):
    return forecast.day_profiles(b.demand(t))
