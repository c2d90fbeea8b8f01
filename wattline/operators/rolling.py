"""Regression forecasts that are fitted again at every origin, in one pass over the data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattline.operators.features import add_hour_lags

#: Fixed value: the standard normal quantile of 0.9.
Z90 = 1.2815515655446004


def rolling_forecast(panel: DataFrame, c: str = "demand_mw", lags: tuple[int, ...] = (24, 168), history: int = 7, least: int = 48) -> DataFrame:
    """Forecast of the 24 hours after each midnight, fitted on the ``history`` days before it: period, ba_code, origin, horizon (1 to 24), actual, q10, q50, q90.

    The median is a least-squares line in the values ``lags`` hours ago (at least 24, so all are known at the origin), the other two lie 1.28 residual spreads away.
    Hours without all lags, and origins with fewer than ``least`` usable hours or without a unique line, have no forecast.

    Products of a day are added up once per area; the sums of an origin are those of the days before it. So n origins cost one pass
    over the data and a few numbers per area and day, whatever the length of the history.
    """
    if min(lags) < 24:
        raise ValueError("a lag under 24 hours isn't known at the origin")
    names = [f"{c}_lag_{n}h" for n in lags]
    rows = add_hour_lags(panel.select("period", "ba_code", c), c, lags).where(" AND ".join(f"`{n}` IS NOT NULL" for n in names))
    rows = rows.select("period", "ba_code", F.to_date("period").alias("origin"), F.col(c).cast("double").alias("_y"), F.lit(1.0).alias("_x0"), *[F.col(n).cast("double").alias(f"_x{i + 1}") for i, n in enumerate(names)])
    x = [f"_x{i}" for i in range(len(names) + 1)]
    products = {f"_a{i}_{j}": F.col(x[i]) * F.col(x[j]) for i in range(len(x)) for j in range(i, len(x))}
    products |= {f"_b{i}": F.col(x[i]) * F.col("_y") for i in range(len(x))} | {"_yy": F.col("_y") * F.col("_y")}
    daily = rows.where("_y IS NOT NULL").groupBy("ba_code", "origin").agg(*[F.sum(v).alias(k) for k, v in products.items()])
    # an origin of its own for every day that has a row to forecast, also where none can be learnt from
    days = rows.select("ba_code", "origin").distinct().join(daily, ["ba_code", "origin"], "left").withColumn("_day", F.datediff("origin", F.lit("1970-01-01")))
    before = Window.partitionBy("ba_code").orderBy("_day").rangeBetween(-history, -1)
    sums = days.select("ba_code", "origin", *[F.sum(k).over(before).alias(k) for k in products]).where(F.col("_a0_0") >= least)
    fitted = solved(sums, len(x)).where("_beta IS NOT NULL")
    line: Column = F.lit(0.0)
    for i, name in enumerate(x):
        line = line + F.col("_beta")[i] * F.col(name)
    out = rows.join(fitted.select("ba_code", "origin", "_beta", "_spread"), ["ba_code", "origin"])
    return out.select(
        "period", "ba_code", F.col("origin").cast("timestamp").alias("origin"), (F.hour("period") + 1).alias("horizon"), F.col("_y").alias("actual"),
        (line - Z90 * F.col("_spread")).alias("q10"), line.alias("q50"), (line + Z90 * F.col("_spread")).alias("q90"),
    )


def solved(sums: DataFrame, n: int) -> DataFrame:
    """Adds ``_beta`` and ``_spread`` from the products ``_a{i}_{j}``, ``_b{i}``, ``_yy``; NULL without a unique solution.

    Elimination column by column: the matrix is symmetric and not negative, so no rows need to be exchanged.
    """
    out = sums.withColumn("_n", F.col("_a0_0"))
    for i in range(n):
        out = out.withColumn(f"_c{i}", F.col(f"_b{i}"))
        out = out.withColumn(f"_d{i}", F.col(f"_a{i}_{i}"))
    for k in range(n):
        # what is left of a column next to nothing is rounding
        pivot = F.when(F.col(f"_a{k}_{k}") > 1e-9 * F.col(f"_d{k}"), F.col(f"_a{k}_{k}"))
        out = out.withColumns({f"_f{k}_{j}": F.col(f"_a{k}_{j}") / pivot for j in range(k + 1, n)} | {f"_c{k}": F.col(f"_c{k}") / pivot})
        out = out.withColumns({f"_a{i}_{j}": F.col(f"_a{i}_{j}") - F.col(f"_f{k}_{i}") * F.col(f"_a{k}_{j}") for i in range(k + 1, n) for j in range(i, n)} | {f"_c{i}": F.col(f"_c{i}") - F.col(f"_a{k}_{i}") * F.col(f"_c{k}") for i in range(k + 1, n)})
    for k in reversed(range(n)):
        value = F.col(f"_c{k}")
        for j in range(k + 1, n):
            value = value - F.col(f"_f{k}_{j}") * F.col(f"_s{j}")
        out = out.withColumn(f"_s{k}", value)
    rest = F.col("_yy")
    for k in range(n):
        rest = rest - F.col(f"_s{k}") * F.col(f"_b{k}")
    out = out.withColumn("_spread", F.when(F.col("_n") > n, F.sqrt(F.greatest(rest, F.lit(0.0)) / (F.col("_n") - n))))
    return out.withColumn("_beta", F.when(F.col("_s0").isNotNull() & F.col("_spread").isNotNull(), F.array(*[f"_s{k}" for k in range(n)])))


def score_rolling(forecasts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Errors of rolling forecasts per horizon: n, mae, rmse, bias, and the share of actual values between q10 and q90."""
    off = F.col("actual") - F.col("q50")
    return forecasts.where("actual IS NOT NULL").groupBy(*(by or ["horizon"])).agg(
        F.count("*").alias("n"), F.avg(F.abs(off)).alias("mae"), F.sqrt(F.avg(off * off)).alias("rmse"), F.avg(-off).alias("bias"),
        F.avg(F.col("actual").between(F.col("q10"), F.col("q90")).cast("double")).alias("coverage"),
    )
