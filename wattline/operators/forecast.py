"""Decomposition, forecasts, spike classifier, load profiles and anomalies on Spark."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattline.operators.features import over_rows
from wattline.operators.ranks import medians, percentiles
from wattline.reference_data import QUANTILE_COLUMNS, QUANTILES, SPIKE_FEATURES

WEEKLY_TERMS, YEARLY_TERMS = 3, 4
ROWS_PER_TASK = 50_000


def _season_terms(date: Column) -> dict[str, Column]:
    """Trend and Fourier terms of a day, all of order one."""
    day = F.unix_date(date).cast("double")
    terms = {"one": F.lit(1.0), "trend": (day - 18628.0) / 1000.0}
    for k in range(1, WEEKLY_TERMS + 1):
        terms[f"w_sin{k}"] = F.sin(day * (2 * math.pi * k / 7.0))
        terms[f"w_cos{k}"] = F.cos(day * (2 * math.pi * k / 7.0))
    for k in range(1, YEARLY_TERMS + 1):
        terms[f"y_sin{k}"] = F.sin(day * (2 * math.pi * k / 365.25))
        terms[f"y_cos{k}"] = F.cos(day * (2 * math.pi * k / 365.25))
    return terms


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _solve(moments: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Ridge-stabilised least squares from the packed moments (X'X row by row, then X'y) of one key."""
    for batch in moments:
        out = []
        for packed in batch:
            values = np.asarray(packed, dtype="float64")
            n = int(round((math.sqrt(1 + 4 * len(values)) - 1) / 2))
            xtx, xty = values[: n * n].reshape(n, n), values[n * n :]
            out.append(np.linalg.solve(xtx + 1e-6 * max(np.trace(xtx), 1.0) / n * np.eye(n), xty).tolist())
        yield pd.Series(out)


def decompose(daily: DataFrame, train_end: str | None = None) -> DataFrame:
    """Trend, weekly and yearly part of a daily series per area by least squares.

    Input columns ba_code, date, y. The products of terms are summed by Spark; only one small system per
    area is solved in Python. ``train_end`` fits on earlier days only and still predicts all days.
    """
    terms = _season_terms(F.col("date"))
    names = list(terms)
    rows = daily.select("ba_code", "date", F.col("y").cast("double").alias("y"), *[c.alias(n) for n, c in terms.items()])
    fit_on = rows if train_end is None else rows.where(F.col("date") < F.lit(train_end).cast("date"))
    fit_on = fit_on.where("y IS NOT NULL")
    # one row for each product, summed map-side: every pair once, then those with y
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    products = F.array(*[F.col(names[i]) * F.col(names[j]) for i, j in pairs], *[F.col(n) * F.col("y") for n in names])
    sums = fit_on.select("ba_code", F.posexplode(products).alias("at", "v")).groupBy("ba_code", "at").agg(F.sum("v").alias("v"))
    moments = sums.groupBy("ba_code").agg(F.array_sort(F.collect_list(F.struct("at", "v"))).alias("_m"))
    place = {pair: k for k, pair in enumerate(pairs)}
    whole = [place[min(i, j), max(i, j)] for i in range(len(names)) for j in range(len(names))] + [len(pairs) + i for i in range(len(names))]
    fitted = moments.select("ba_code", _solve(F.array(*[F.col("_m")[k]["v"] for k in whole])).alias("_beta"))

    def part(prefixes: tuple[str, ...]) -> Column:
        total = F.lit(0.0)
        for i, n in enumerate(names):
            if n.startswith(prefixes):
                total = total + F.col("_beta")[i] * F.col(n)
        return total

    # one row per key: Spark broadcasts it where it is small
    return rows.join(fitted, "ba_code").select(
        "ba_code",
        "date",
        part(("one", "trend")).alias("prophet_trend"),
        part(("w_",)).alias("prophet_weekly"),
        part(("y_",)).alias("prophet_yearly"),
        "y",
    )


# --- spike classifier -----------------------------------------------------------------------------


def spike_model(train: DataFrame, cols: list[str] = SPIKE_FEATURES, label: str = "is_spike", pos_weight: float = 10.0, iterations: int = 500):
    """Gradient-boosted trees for spikes, rare positives weighted up; returns the fitted pipeline.

    Every round passes over the data once for each level of a tree, so rows are dealt into as many partitions as they fill.
    """
    data = train.repartition(max(1, train.count() // ROWS_PER_TASK)).withColumns(
        {
            **{c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in cols},
            "_label": F.col(label).cast("double"),
            "_weight": F.when(F.col(label), pos_weight).otherwise(1.0),
        }
    )
    stages = [
        VectorAssembler(inputCols=cols, outputCol="_features"),
        GBTClassifier(
            featuresCol="_features", labelCol="_label", weightCol="_weight", maxDepth=6, maxIter=iterations, stepSize=0.05, subsamplingRate=0.8, featureSubsetStrategy="0.8", seed=7
        ),
    ]
    return Pipeline(stages=stages).fit(data)


def spike_probability(model, df: DataFrame, cols: list[str] = SPIKE_FEATURES) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    ready = df.withColumns({f"_x_{c}": F.col(c) for c in cols}).withColumns(
        {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in cols}
    )
    scored = model.transform(ready).withColumn("spike_prob", vector_to_array("probability")[1])
    return scored.select(*[F.col(f"_x_{c}").alias(c) if c in cols else F.col(c) for c in df.columns], "spike_prob")


def importance(model, cols: list[str] = SPIKE_FEATURES, k: int = 20) -> DataFrame:
    """Features by importance, largest first; one row per feature."""
    from pyspark.sql import SparkSession

    weights = model.stages[-1].featureImportances.toArray().tolist()
    rows = SparkSession.getActiveSession().createDataFrame(
        list(zip(cols, [float(x) for x in weights], strict=True)), "variable string, importance double"
    )
    return rows.orderBy(F.desc("importance"), "variable").limit(k)


# --- quantile forecast ----------------------------------------------------------------------------


def seasonal_naive(panel: DataFrame, lag: int = 24, c: str = "demand_mw") -> DataFrame:
    """Value ``lag`` rows ago as the median forecast of every row."""
    return over_rows(panel, ["ba_code"], "period", lambda w: {"q50": F.lag(c, lag).over(w)}, back=lag)


def forecast(
    panel: DataFrame, train_end: str, quantiles: list[float] = QUANTILES, lag: int = 24, c: str = "demand_mw"
) -> DataFrame:
    """Quantile forecast of every hour from ``train_end`` on.

    The median is the value ``lag`` rows before; the other quantiles add the residual quantiles of the same
    area and hour of day found before ``train_end``, and are NULL where there are none.
    """
    pred = seasonal_naive(panel.select("ba_code", "period", c), lag, c).where("q50 IS NOT NULL")
    cut = F.lit(train_end).cast("timestamp")
    past = pred.where(F.col("period") < cut).select("ba_code", F.hour("period").alias("hour"), (F.col(c) - F.col("q50")).alias("_res"))
    names = [f"q{round(q * 100):02d}" for q in quantiles]
    spread = percentiles(past, ["ba_code", "hour"], "_res", {f"_{n}": q for n, q in zip(names, quantiles, strict=True)}, few_keys=True)
    ahead = pred.where(F.col("period") >= cut).withColumn("hour", F.hour("period"))
    base = F.col("q50")
    return ahead.withColumn("_base", base).join(F.broadcast(spread), ["ba_code", "hour"], "left").select(
        "period",
        "ba_code",
        F.lit("seasonal").alias("model"),
        F.col(c).alias("actual"),
        *[(F.col("_base") + F.col(f"_{n}")).alias(n) for n in names],
    )


def quantile_forecasts(panel: DataFrame, center: str, model: str, width: float = 0.8) -> DataFrame:
    """Forecast rows around a given centre column, each quantile a fixed part away from it."""
    p = F.col(center)
    return panel.where(p.isNotNull()).select(
        "period",
        "ba_code",
        F.lit(model).alias("model"),
        F.col("demand_mw").alias("actual"),
        *[(p * (1 + (q - 0.5) * width)).alias(n) for n, q in zip(QUANTILE_COLUMNS, QUANTILES, strict=True)],
    )


# --- profiles and anomalies --------------------------------------------------------------------


def day_profiles(panel: DataFrame, c: str = "demand_mw") -> DataFrame:
    """24 hourly shares of each day's mean demand per area; missing hours count as the mean."""
    hours = [f"h{h:02d}" for h in range(24)]
    wide = panel.groupBy("ba_code", F.to_date("period").alias("date")).agg(
        F.avg(c).alias("_mean"),
        *[F.avg(F.when(F.hour("period") == h, F.col(c))).alias(n) for h, n in enumerate(hours)],
    )
    mean = F.nullif(F.col("_mean"), F.lit(0.0))
    return wide.select("ba_code", "date", *[F.coalesce(F.col(n) / mean, F.lit(1.0)).alias(n) for n in hours])


def load_profiles(panel: DataFrame, k: int = 4, c: str = "demand_mw", seed: int = 7) -> DataFrame:
    """Cluster of every area-day by its 24-hour profile."""
    profiles = day_profiles(panel, c)
    hours = [n for n in profiles.columns if n not in ("ba_code", "date")]
    stages = [
        VectorAssembler(inputCols=hours, outputCol="_features"),
        KMeans(featuresCol="_features", predictionCol="cluster", k=k, seed=seed, maxIter=20),
    ]
    return Pipeline(stages=stages).fit(profiles).transform(profiles).select("ba_code", "date", "cluster")


def anomalies(df: DataFrame, c: str, by: list[str] | None = None, cut: float = 3.5) -> DataFrame:
    """Robust z-score (median, median absolute deviation) and a flag beyond ``cut``.

    Groups are areas (a fixed list), so their two statistics are broadcast.
    """
    by = by or ["ba_code"]
    centre = medians(df, by, [c], few_keys=True).withColumnRenamed(c, "_med")
    off = df.join(F.broadcast(centre), by).withColumn("_dev", F.abs(F.col(c) - F.col("_med")))
    scale = medians(off, by, ["_dev"], few_keys=True).withColumnRenamed("_dev", "_mad")
    z = F.lit(0.6745) * (F.col(c) - F.col("_med")) / F.when(F.col("_mad") > 0, F.col("_mad"))
    return (
        off.join(F.broadcast(scale), by)
        .withColumn("robust_z", z)
        .withColumn("is_anomaly", F.coalesce(F.abs("robust_z") > cut, F.lit(False)))
        .drop("_med", "_dev", "_mad")
    )
