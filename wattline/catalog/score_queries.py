"""Forecast scores and model comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from wattline.catalog import bindings as b
from wattline.catalog.panel_queries import WINDOWS, _LOCAL
from wattline.catalog.registry import query
from wattline.functions import errors
from wattline.operators import scoring
from wattline.reference_data import QUANTILE_COLUMNS, QUANTILES


def _pinball(weights=None) -> str:
    weights = weights or [1.0] * 7
    parts = [
        f"{w} * greatest({q} * (actual - {n}), ({q} - 1) * (actual - {n}))" for n, q, w in zip(QUANTILE_COLUMNS, QUANTILES, weights, strict=True)
    ]
    return f"(({' + '.join(parts)}) / 7.0)"


_MAPE = "avg(abs((actual - q50) / nullif(actual, 0))) * 100"
_COV = "avg(CAST(actual >= q10 AND actual <= q90 AS INTEGER)) * 100"
_SCORES = f"{_MAPE} AS mape, avg(abs(actual - q50)) AS mae, sqrt(avg((actual - q50) ** 2)) AS rmse, avg(actual) AS mean_mw, {_COV} AS coverage_80"
_SCORE_FLOATS = "mape mae rmse mean_mw coverage_80"


@query("forecast_table", "SELECT * FROM forecasts", "actual " + " ".join(QUANTILE_COLUMNS))
def _(t):
    return b.forecasts(t)


@query("percentage_error", f"SELECT model, {_MAPE} AS mape FROM forecasts GROUP BY 1", "mape")
def _(t):
    return b.forecasts(t).groupBy("model").agg(errors.mape(F.col("actual"), F.col("q50")).alias("mape"))


@query("squared_error", "SELECT model, sqrt(avg((actual - q50) ** 2)) AS rmse FROM forecasts GROUP BY 1", "rmse")
def _(t):
    return b.forecasts(t).groupBy("model").agg(errors.rmse(F.col("actual"), F.col("q50")).alias("rmse"))


@query("absolute_error", "SELECT model, avg(abs(actual - q50)) AS mae FROM forecasts GROUP BY 1", "mae")
def _(t):
    return b.forecasts(t).groupBy("model").agg(errors.mae(F.col("actual"), F.col("q50")).alias("mae"))


@query("interval_coverage", f"SELECT model, ba_code, {_COV} AS coverage FROM forecasts GROUP BY 1, 2", "coverage")
def _(t):
    return b.forecasts(t).groupBy("model", "ba_code").agg(errors.coverage(F.col("actual"), F.col("q10"), F.col("q90")).alias("coverage"))


@query("scores_by_area", f"SELECT model, ba_code, {_SCORES} FROM forecasts GROUP BY 1, 2", _SCORE_FLOATS)
def _(t):
    return scoring.score_by(b.forecasts(t), ["model", "ba_code"])


_OVERALL = f"""
    SELECT o.model, mape_simple, rmse, mae, coverage_80, n_predictions, mape_weighted, mape_healthy_mean, n_bas_total, n_bas_healthy, n_bas_outlier
    FROM (SELECT model, {_MAPE} AS mape_simple, sqrt(avg((actual - q50) ** 2)) AS rmse, avg(abs(actual - q50)) AS mae, {_COV} AS coverage_80,
                 count(*) AS n_predictions FROM forecasts GROUP BY 1) o
    JOIN (SELECT model, CASE WHEN count(*) FILTER (WHERE mape < LIMIT_) > 0 THEN sum(CASE WHEN mape < LIMIT_ THEN mape * mean_mw END) / sum(CASE WHEN mape < LIMIT_ THEN mean_mw END)
                              ELSE avg(mape) END AS mape_weighted,
                 avg(CASE WHEN mape < LIMIT_ THEN mape END) AS mape_healthy_mean, count(*) AS n_bas_total, count(*) FILTER (WHERE mape < LIMIT_) AS n_bas_healthy,
                 count(*) FILTER (WHERE mape >= LIMIT_) AS n_bas_outlier
          FROM (SELECT model, ba_code, {_MAPE} AS mape, avg(actual) AS mean_mw FROM forecasts GROUP BY 1, 2) GROUP BY 1) a ON a.model = o.model"""


@query("scores_overall", _OVERALL.replace("LIMIT_", "400"), "mape_simple rmse mae coverage_80 mape_weighted mape_healthy_mean")
def _(t):
    return scoring.score_overall(b.forecasts(t), healthy_below=400.0)


@query("scores_overall_default_limit", _OVERALL.replace("LIMIT_", "50"), "mape_simple rmse mae coverage_80 mape_weighted mape_healthy_mean")
def _(t):
    return scoring.score_overall(b.forecasts(t))


@query(
    "coverage_bands",
    f"SELECT model, {_COV} AS coverage_80, avg(CAST(actual >= q02 AND actual <= q98 AS INTEGER)) * 100 AS coverage_96 FROM forecasts GROUP BY 1",
    "coverage_80 coverage_96",
)
def _(t):
    return scoring.coverage_bands(b.forecasts(t), ["model"])


@query("floored_percentage_error", "SELECT model, ba_code, avg(abs(actual - q50) / greatest(actual, 1)) * 100 AS mape FROM forecasts GROUP BY 1, 2", "mape")
def _(t):
    return b.forecasts(t).groupBy("model", "ba_code").agg(errors.mape_floor(F.col("actual"), F.col("q50")).alias("mape"))


@query("pinball_loss", f"SELECT model, ba_code, avg({_pinball()}) AS pinball FROM forecasts GROUP BY 1, 2", "pinball")
def _(t):
    return scoring.pinball(b.forecasts(t), ["model", "ba_code"])


@query(
    "pinball_by_quantile",
    """SELECT model, quantile, avg(greatest(level * (actual - predicted), (level - 1) * (actual - predicted))) AS pinball FROM (
         SELECT model, actual, unnest(['q02', 'q10', 'q25', 'q50', 'q75', 'q90', 'q98']) AS quantile,
                unnest([0.02, 0.1, 0.25, 0.5, 0.75, 0.9, 0.98]) AS level, unnest([q02, q10, q25, q50, q75, q90, q98]) AS predicted FROM forecasts) GROUP BY 1, 2""",
    "pinball",
)
def _(t):
    return scoring.pinball_by_quantile(b.forecasts(t), ["model"])


_W7 = [2.0, 1.5, 1.0, 1.0, 1.0, 1.5, 2.0]


@query("weighted_pinball", f"SELECT model, avg({_pinball(_W7)}) AS pinball_weighted FROM forecasts GROUP BY 1", "pinball_weighted")
def _(t):
    return scoring.pinball_weighted(b.forecasts(t), ["model"])


@query(
    "weighted_pinball_by_row",
    f"SELECT model, sum({_pinball(_W7)} * actual) / sum(actual) AS pinball_weighted FROM forecasts GROUP BY 1",
    "pinball_weighted",
)
def _(t):
    return scoring.pinball_weighted(b.forecasts(t), ["model"], row_weight=F.col("actual"))


@query(
    "fair_loss",
    f"""SELECT p.model, pinball, pinball * (1 + 0.5 * coalesce(cv, 0)) AS fair_loss FROM (SELECT model, avg({_pinball()}) AS pinball FROM forecasts GROUP BY 1) p
        JOIN (SELECT model, CASE WHEN count(m) > 1 THEN stddev_pop(m) / greatest(avg(m), 1e-6) END AS cv FROM (
                SELECT model, ba_code, avg(CASE WHEN actual > 100 THEN abs(actual - q50) / actual END) AS m FROM forecasts GROUP BY 1, 2) GROUP BY 1) s ON s.model = p.model""",
    "pinball fair_loss",
)
def _(t):
    return scoring.fair_loss(b.forecasts(t))


@query("stacked_metrics", f"SELECT model, {_MAPE} AS mape FROM forecasts GROUP BY 1 UNION ALL SELECT 'AB', {_MAPE} FROM forecasts", "mape")
def _(t):
    f = b.forecasts(t)
    one = f.groupBy("model").agg(errors.mape(F.col("actual"), F.col("q50")).alias("mape"))
    both = f.agg(errors.mape(F.col("actual"), F.col("q50")).alias("mape")).select(F.lit("AB").alias("model"), "mape")
    return scoring.stack_metrics(one, both)


@query(
    "ablation_table",
    f"""WITH m AS (SELECT model, {_SCORES} FROM forecasts GROUP BY 1),
             l AS (SELECT model, unnest(['mape', 'mae', 'rmse']) AS metric, unnest([mape, mae, rmse]) AS v FROM m)
        SELECT metric, max(v) FILTER (WHERE model = 'A') AS A, max(v) FILTER (WHERE model = 'B') AS B, max(v) FILTER (WHERE model = 'C') AS C FROM l GROUP BY 1""",
    "A B",
)
def _(t):
    return scoring.ablation(scoring.score_by(b.forecasts(t), ["model"]), ["mape", "mae", "rmse"], variants=["A", "B", "C"])


_GAMMA = " + ".join(f"2 * coalesce(sum(c * lag{k}), 0)" for k in range(1, 24))
_LAGS = ", ".join(f"lag(c, {k}) OVER (PARTITION BY ba_code ORDER BY period) AS lag{k}" for k in range(1, 24))
_DM = f"""
    WITH d AS (SELECT ba_code, period, (actual - q50_a) ** 2 - (actual - q50_b) ** 2 AS d FROM aligned),
         m AS (SELECT ba_code, avg(d) AS mean, count(*) AS n FROM d GROUP BY 1),
         c AS (SELECT d.ba_code, d.period, d - mean AS c FROM d JOIN m ON m.ba_code = d.ba_code),
         l AS (SELECT *, {_LAGS} FROM c),
         g AS (SELECT ba_code, sum(c * c) + {_GAMMA} AS g FROM l GROUP BY 1)
    SELECT g.ba_code, n, CASE WHEN g / n > 0 THEN mean / sqrt(g / n / n) END AS dm_stat FROM g JOIN m ON m.ba_code = g.ba_code"""


@query("diebold_mariano", _DM, "dm_stat")
def _(t):
    # the tail probability has no SQL counterpart and is tested on its own
    return scoring.diebold_mariano(b.aligned(t)).drop("p_value")


@query(
    "wilcoxon_signed_rank",
    """WITH d AS (SELECT round(abs(actual - q50_a) - abs(actual - q50_b), 9) AS d FROM aligned),
            r AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2.0 AS r FROM d WHERE d <> 0),
            t AS (SELECT sum(c ** 3 - c) AS ties FROM (SELECT count(*)::DOUBLE AS c FROM d WHERE d <> 0 GROUP BY abs(d))),
            s AS (SELECT count(*)::DOUBLE AS n, sum(CASE WHEN d > 0 THEN r ELSE 0 END)::DOUBLE AS w_plus, sum(CASE WHEN d < 0 THEN r ELSE 0 END)::DOUBLE AS w_minus FROM r)
       SELECT n::BIGINT AS n, w_plus, w_minus, least(w_plus, w_minus) AS w_stat,
              (least(w_plus, w_minus) - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48) AS z FROM s, t""",
    "w_plus w_minus w_stat z",
    digits=1,
)
def _(t):
    return scoring.wilcoxon(b.aligned(t)).drop("p_value")


@query(
    "average_ranks",
    """SELECT ba_code, period, rank() OVER (PARTITION BY ba_code ORDER BY e) + (count(*) OVER (PARTITION BY ba_code, e) - 1) / 2.0 AS avg_rank
       FROM (SELECT ba_code, period, floor(abs(actual - q50_a)) AS e FROM aligned)""",
    "avg_rank",
)
def _(t):
    from wattline.operators.ranks import average_ranks

    e = b.aligned(t).select("ba_code", "period", F.floor(F.abs(F.col("actual") - F.col("q50_a"))).alias("e"))
    return average_ranks(e, ["ba_code"], "e").drop("e")


@query(
    "scores_by_horizon",
    f"""SELECT (extract(hour FROM period) + 1) AS horizon, model, avg(abs(actual - q50) / greatest(actual, 1)) * 100 AS mape, avg(abs(actual - q50)) AS mae,
               {_COV} AS coverage_80, count(*) AS n FROM forecasts GROUP BY 1, 2""",
    "mape mae coverage_80",
)
def _(t):
    f = b.forecasts(t).withColumn("horizon", F.hour("period") + 1)
    return scoring.score_rolling(f, ["horizon", "model"])


@query(
    "benchmark_baselines",
    """SELECT ba_code, avg(abs((demand_mw - forecast_mw) / nullif(demand_mw, 0))) * 100 AS operator_mape, avg(abs((demand_mw - d) / nullif(demand_mw, 0))) * 100 AS day_mape,
              avg(abs((demand_mw - w) / nullif(demand_mw, 0))) * 100 AS week_mape
       FROM (SELECT *, lag(demand_mw, 24) OVER (PARTITION BY ba_code ORDER BY period) AS d, lag(demand_mw, 168) OVER (PARTITION BY ba_code ORDER BY period) AS w FROM demand) GROUP BY 1""",
    "operator_mape day_mape week_mape",
)
def _(t):
    return scoring.baselines(b.demand(t))


@query(
    "loss_reduction",
    f"""WITH p AS (SELECT model, avg({_pinball()}) AS l FROM forecasts GROUP BY 1)
        SELECT a.l AS loss_a, z.l AS loss_b, (z.l - a.l) / nullif(z.l, 0) * 100 AS reduction_pct FROM p a JOIN p z ON a.model = 'B' AND z.model = 'A'""",
    "loss_a loss_b reduction_pct",
)
def _(t):
    return scoring.rel_reduction(scoring.pinball(b.forecasts(t), ["model"]), "B", "A")


@query(
    "tail_event_error",
    f"""SELECT model, in_window, {_MAPE} AS mape, count(*) AS n FROM (
          SELECT *, EXISTS (SELECT 1 FROM wins w WHERE f.period BETWEEN w.a AND w.z) AS in_window FROM forecasts f) GROUP BY 1, 2""",
    "mape",
    ctes=_LOCAL,
)
def _(t):
    return scoring.tail_mape(b.forecasts(t), WINDOWS)


@query(
    "gap_direction",
    "SELECT ba_code, avg(CAST(sign(supply_demand_gap) = sign(forecast_mw - demand_mw) AS INTEGER)) AS direction_acc FROM demand GROUP BY 1",
    "direction_acc",
)
def _(t):
    return scoring.direction_acc(b.demand(t), F.col("supply_demand_gap"), F.col("forecast_mw") - F.col("demand_mw"), ["ba_code"])


@query(
    "spike_detection_scores",
    """WITH s AS (SELECT is_spike AS y, hour_of_day + floor(gas_pct / 10) AS s FROM features),
            c AS (SELECT count(*) FILTER (WHERE y AND s >= 15) AS tp, count(*) FILTER (WHERE NOT y AND s >= 15) AS fp,
                         count(*) FILTER (WHERE y AND s < 15) AS fn, count(*) FILTER (WHERE y)::DOUBLE AS p, count(*) FILTER (WHERE NOT y)::DOUBLE AS n FROM s),
            r AS (SELECT sum(r) FILTER (WHERE y)::DOUBLE AS rs FROM (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS r FROM s))
       SELECT tp, fp, fn, tp / nullif(tp + fp, 0)::DOUBLE AS precision, tp / nullif(tp + fn, 0)::DOUBLE AS recall,
              2.0 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE AS f1, (rs - p * (p + 1) / 2) / nullif(p * n, 0) AS auc FROM c, r""",
    "precision recall f1 auc",
)
def _(t):
    f = b.features(t).select("is_spike", (F.col("hour_of_day") + F.floor(F.col("gas_pct") / 10)).cast("double").alias("score"))
    return scoring.spike_scores(f, [], cut=15.0)


@query(
    "interval_width",
    "SELECT model, ba_code, avg(q90 - q10) AS avg_width, avg((q90 - q10) / nullif(q50, 0)) AS avg_relative_width FROM forecasts GROUP BY 1, 2",
    "avg_width avg_relative_width",
)
def _(t):
    return scoring.spread(b.forecasts(t), ["model", "ba_code"])
