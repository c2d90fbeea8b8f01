"""Scoring and comparing quantile forecasts."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattline.functions import errors
from wattline.functions.measures import ratio
from wattline.lineage import stage
from wattline.operators.features import over_rows
from wattline.operators.quality import windows_at
from wattline.operators.ranks import value_ranks
from wattline.reference_data import CRISIS_WINDOWS, QUANTILE_COLUMNS, QUANTILES


def _a() -> Column:
    return F.col("actual")


def _p() -> Column:
    return F.col("q50")


def score_by(df: DataFrame, by: list[str]) -> DataFrame:
    """MAPE, MAE, RMSE, mean demand and 80 % coverage per group."""
    return df.groupBy(*by).agg(
        errors.mape(_a(), _p()).alias("mape"),
        errors.mae(_a(), _p()).alias("mae"),
        errors.rmse(_a(), _p()).alias("rmse"),
        F.avg("actual").alias("mean_mw"),
        errors.coverage(_a(), F.col("q10"), F.col("q90")).alias("coverage_80"),
    )


def score_overall(df: DataFrame, by: list[str] | None = None, healthy_below: float = 50.0) -> DataFrame:
    """Whole-model row: plain errors over all rows, and MAPE over areas weighted by their mean demand.

    Areas at or above ``healthy_below`` are left out of the weighted figure; when none is left, the plain
    mean over areas is used.
    """
    by = by or ["model"]
    per_ba = score_by(df, [*by, "ba_code"])
    healthy = F.col("mape") < healthy_below
    weight = F.when(healthy, F.col("mean_mw"))
    weighted = ratio(F.sum(F.col("mape") * weight), F.sum(weight))
    areas = per_ba.groupBy(*by).agg(
        F.when(F.count_if(healthy) > 0, weighted).otherwise(F.avg("mape")).alias("mape_weighted"),
        F.avg(F.when(healthy, F.col("mape"))).alias("mape_healthy_mean"),
        F.count(F.lit(1)).alias("n_bas_total"),
        F.count_if(healthy).alias("n_bas_healthy"),
        F.count_if(~F.coalesce(healthy, F.lit(False))).alias("n_bas_outlier"),
    )
    rows = df.groupBy(*by).agg(
        errors.mape(_a(), _p()).alias("mape_simple"),
        errors.rmse(_a(), _p()).alias("rmse"),
        errors.mae(_a(), _p()).alias("mae"),
        errors.coverage(_a(), F.col("q10"), F.col("q90")).alias("coverage_80"),
        F.count(F.lit(1)).alias("n_predictions"),
    )
    return rows.join(areas, by)


def coverage_bands(df: DataFrame, by: list[str]) -> DataFrame:
    """Coverage of the 80 % and the 96 % band."""
    return df.groupBy(*by).agg(
        errors.coverage(_a(), F.col("q10"), F.col("q90")).alias("coverage_80"),
        errors.coverage(_a(), F.col("q02"), F.col("q98")).alias("coverage_96"),
    )


def pinball(df: DataFrame, by: list[str]) -> DataFrame:
    """Mean pinball loss over rows and quantiles."""
    return df.groupBy(*by).agg(F.avg(errors.pinball_row(_a())).alias("pinball"))


def pinball_by_quantile(df: DataFrame, by: list[str]) -> DataFrame:
    """Pinball loss of every quantile, from the quantile columns turned into rows."""
    level = F.lit(None).cast("double")
    for name, q in zip(QUANTILE_COLUMNS, QUANTILES, strict=True):
        level = F.when(F.col("quantile") == name, F.lit(q)).otherwise(level)
    long = df.unpivot([*by, "actual"], QUANTILE_COLUMNS, "quantile", "predicted").withColumn("level", level)
    e = F.col("actual") - F.col("predicted")
    loss = F.when(e.isNotNull(), F.greatest(F.col("level") * e, (F.col("level") - 1) * e))
    return long.groupBy(*by, "quantile").agg(F.avg(loss).alias("pinball"))


def pinball_weighted(df: DataFrame, by: list[str], outer: float = 2.0, row_weight: Column | None = None) -> DataFrame:
    """Pinball loss with heavier outer quantiles, optionally weighted by row."""
    loss = errors.pinball_row(_a(), weights=errors.quantile_weights(outer))
    if row_weight is None:
        return df.groupBy(*by).agg(F.avg(loss).alias("pinball_weighted"))
    kept = F.when(loss.isNotNull(), row_weight)
    return df.groupBy(*by).agg(ratio(F.sum(loss * row_weight), F.sum(kept)).alias("pinball_weighted"))


def fair_loss(df: DataFrame, by: list[str] | None = None, min_mw: float = 100.0, strength: float = 0.5) -> DataFrame:
    """Pinball loss raised by the unevenness of MAPE over areas (population spread over mean).

    Only rows above ``min_mw`` enter the MAPE; with fewer than two areas nothing is added.
    """
    by = by or ["model"]
    valid = F.col("actual") > min_mw
    part = F.when(valid, F.abs(_a() - _p()) / F.when(valid, _a()))
    per_ba = df.groupBy(*by, "ba_code").agg(F.avg(part).alias("_mape"))
    spread = per_ba.groupBy(*by).agg(
        F.when(F.count("_mape") > 1, F.stddev_pop("_mape") / F.greatest(F.avg("_mape"), F.lit(1e-6))).alias("_cv")
    )
    factor = F.lit(1.0) + F.lit(strength) * F.coalesce("_cv", F.lit(0.0))
    return pinball(df, by).join(spread, by).select(*by, "pinball", (F.col("pinball") * factor).alias("fair_loss"))


def stack_metrics(*metrics: DataFrame) -> DataFrame:
    """Metric rows of several variants under each other."""
    out = metrics[0]
    for m in metrics[1:]:
        out = out.unionByName(m)
    return out


def ablation(metrics: DataFrame, cols: list[str], variant: str = "model", variants: list[str] | None = None) -> DataFrame:
    """One row per metric, one column per variant; ``metrics`` holds a row for each variant.

    Without ``variants`` those found get a column each. A variant that isn't listed raises an error when the
    result is read, rather than vanish.
    """
    long = metrics.unpivot([variant], cols, "metric", "value")
    if variants is None:
        return long.groupBy("metric").pivot(variant).agg(F.max("value"))
    listed = F.col(variant).isin(variants)
    known = F.when(listed, F.col(variant)).otherwise(F.raise_error(F.concat(F.lit("no column for variant "), F.coalesce(variant, F.lit("NULL")))).cast("string"))
    return long.withColumn(variant, known).groupBy("metric").pivot(variant, variants).agg(F.max("value"))


# --- tests of equal accuracy --------------------------------------------------------------------


@F.pandas_udf(T.DoubleType())
def _two_sided_p(z: pd.Series) -> pd.Series:
    """Two-sided normal tail probability; applied to one row per test."""
    return z.map(lambda v: None if v is None or v != v else math.erfc(abs(v) / math.sqrt(2)))


def diebold_mariano(aligned: DataFrame, h: int = 24, by: list[str] | None = None) -> DataFrame:
    """Diebold-Mariano test on squared errors of two aligned models, per area.

    The long-run variance adds twice the auto-covariances of the first ``h - 1`` lags. Lagged products are
    built in chunks of the series, so a long series is not sorted in one task.
    """
    by = by or ["ba_code"]
    d = F.pow(F.col("actual") - F.col("q50_a"), 2) - F.pow(F.col("actual") - F.col("q50_b"), 2)
    # read for the means, the centred rows and the plan of the chunks
    diffs = stage(aligned.select(*by, "period", d.alias("_d")).where(F.col("_d").isNotNull()), "differences")
    means = diffs.groupBy(*by).agg(F.avg("_d").alias("_mean"), F.count(F.lit(1)).alias("n"))
    # one row per area
    centred = diffs.join(F.broadcast(means), by).select(*by, "period", (F.col("_d") - F.col("_mean")).alias("_c"))

    def lagged(w):
        products = {"_g0": F.pow("_c", 2)}
        for k in range(1, h):
            products[f"_g{k}"] = F.col("_c") * F.lag("_c", k).over(w)
        return products

    sums = over_rows(centred, by, "period", lagged, back=h).groupBy(*by).agg(
        *[F.sum(f"_g{k}").alias(f"_g{k}") for k in range(h)]
    )
    gammas = F.col("_g0")
    for k in range(1, h):
        gammas = gammas + 2 * F.coalesce(f"_g{k}", F.lit(0.0))
    long_run = gammas / F.col("n")
    stat = F.when(long_run > 0, F.col("_mean") / F.sqrt(long_run / F.col("n")))
    return sums.join(means, by).select(*by, "n", stat.alias("dm_stat")).withColumn("p_value", _two_sided_p("dm_stat"))


def wilcoxon(aligned: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Wilcoxon signed-rank test on absolute errors of two aligned models.

    Zero differences are dropped, ties share their mean rank, and the normal approximation is corrected
    for ties.
    """
    by = by or []
    diff = F.abs(F.col("actual") - F.col("q50_a")) - F.abs(F.col("actual") - F.col("q50_b"))
    # rounding makes differences that are equal on paper equal in binary
    rows = aligned.select(*by, F.round(diff, 9).alias("_diff")).where("_diff <> 0")
    signed = rows.groupBy(*by, F.abs("_diff").alias("_size")).agg(
        F.count_if(F.col("_diff") > 0).alias("_plus"), F.count_if(F.col("_diff") < 0).alias("_minus")
    )
    sized = rows.select(*by, F.abs("_diff").alias("_size"))
    ranks = value_ranks(sized, by, "_size").withColumn("_rank", F.col("cum") - (F.col("n") - 1) / 2)
    joined = ranks.join(signed, [*by, "_size"])
    ties = F.sum(F.pow(F.col("n").cast("double"), 3) - F.col("n"))
    sums = joined.groupBy(*by).agg(
        F.sum(F.col("_rank") * F.col("_plus")).cast("double").alias("w_plus"),
        F.sum(F.col("_rank") * F.col("_minus")).cast("double").alias("w_minus"),
        F.max("total").alias("n"),
        ties.alias("_ties"),
    )
    n = F.col("n").cast("double")
    w = F.least("w_plus", "w_minus")
    var = n * (n + 1) * (2 * n + 1) / 24 - F.col("_ties") / 48
    z = F.when(var > 0, (w - n * (n + 1) / 4) / F.sqrt(var))
    return sums.select(*by, "n", "w_plus", "w_minus", w.alias("w_stat"), z.alias("z")).withColumn("p_value", _two_sided_p("z"))


def score_rolling(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Errors per step ahead (or any other key) of stitched rolling-origin forecasts."""
    return df.groupBy(*(by or ["horizon"])).agg(
        errors.mape_floor(_a(), _p()).alias("mape"),
        errors.mae(_a(), _p()).alias("mae"),
        errors.coverage(_a(), F.col("q10"), F.col("q90")).alias("coverage_80"),
        F.count(F.lit(1)).alias("n"),
    )


def baselines(panel: DataFrame) -> DataFrame:
    """Percentage error per area of the operator's own forecast and of yesterday's and last week's value."""
    lagged = over_rows(
        panel.select("ba_code", "period", "demand_mw", "forecast_mw"),
        ["ba_code"],
        "period",
        lambda w: {"_day": F.lag("demand_mw", 24).over(w), "_week": F.lag("demand_mw", 168).over(w)},
        back=168,
    )
    a = F.col("demand_mw")
    return lagged.groupBy("ba_code").agg(
        errors.mape(a, F.col("forecast_mw")).alias("operator_mape"),
        errors.mape(a, F.col("_day")).alias("day_mape"),
        errors.mape(a, F.col("_week")).alias("week_mape"),
    )


def rel_reduction(df: DataFrame, a: str, b: str, loss: str = "pinball") -> DataFrame:
    """Reduction in percent of the loss of model ``a`` against model ``b``, from per-model rows."""
    of = {m: F.max(F.when(F.col("model") == m, F.col(loss))) for m in (a, b)}
    return df.agg(of[a].alias("loss_a"), of[b].alias("loss_b")).withColumn(
        "reduction_pct", ratio(F.col("loss_b") - F.col("loss_a"), F.col("loss_b")) * 100
    )


def tail_mape(df: DataFrame, windows: list[tuple] = CRISIS_WINDOWS, by: list[str] | None = None) -> DataFrame:
    """Percentage error inside and outside the named windows."""
    inside = F.size(windows_at(F.col("period"), windows)) > 0
    return df.groupBy(*(by or ["model"]), inside.alias("in_window")).agg(
        errors.mape(_a(), _p()).alias("mape"), F.count(F.lit(1)).alias("n")
    )


def direction_acc(df: DataFrame, actual: Column, predicted: Column, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(errors.direction_accuracy(actual, predicted).alias("direction_acc"))


def spike_scores(df: DataFrame, by: list[str], label: str = "is_spike", score: str = "score", cut: float = 0.5) -> DataFrame:
    """Precision, recall, F1 at a cut and the area under the ROC curve by rank sums."""
    yes = F.col(label)
    called = F.col(score) >= cut
    counts = df.groupBy(*by).agg(
        F.count_if(yes & called).alias("tp"),
        F.count_if(~yes & called).alias("fp"),
        F.count_if(yes & ~called).alias("fn"),
        F.count_if(yes & F.col(score).isNotNull()).alias("_pos"),
        F.count_if(~yes & F.col(score).isNotNull()).alias("_neg"),
    )
    ranks = value_ranks(df.where(yes.isNotNull()), by, score).withColumn("_rank", F.col("cum") - (F.col("n") - 1) / 2)
    hits = df.where(yes).groupBy(*by, score).agg(F.count(F.lit(1)).alias("_hits"))
    sums = ranks.join(hits, [*by, score]).groupBy(*by).agg(F.sum(F.col("_rank") * F.col("_hits")).cast("double").alias("_ranksum"))
    pos, neg = F.col("_pos").cast("double"), F.col("_neg").cast("double")
    precision = ratio(F.col("tp").cast("double"), (F.col("tp") + F.col("fp")).cast("double"))
    recall = ratio(F.col("tp").cast("double"), (F.col("tp") + F.col("fn")).cast("double"))
    f1 = ratio(2.0 * F.col("tp"), (2 * F.col("tp") + F.col("fp") + F.col("fn")).cast("double"))
    auc = ratio(F.col("_ranksum") - pos * (pos + 1) / 2, pos * neg)
    joined = counts.join(sums, by, "left") if by else counts.withColumn("_ranksum", sums.select("_ranksum").scalar())
    return joined.select(
        *by, "tp", "fp", "fn", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"), auc.alias("auc")
    )


def spread(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Mean width of the 80 % band, in megawatts and relative to the median forecast."""
    width = F.col("q90") - F.col("q10")
    return df.groupBy(*(by or ["ba_code"])).agg(
        F.avg(width).alias("avg_width"), F.avg(ratio(width, F.col("q50"))).alias("avg_relative_width")
    )
