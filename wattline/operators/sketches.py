"""Distinct counts and quantiles from stored sketches that merge over any range of months."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Registers of a distinct-count sketch as a power of two, and the relative standard error that goes with them.
LOG_REGISTERS = 14
DISTINCT_ERROR = 1.04 / 2 ** (LOG_REGISTERS / 2)
#: Width of a quantile bin: values between 1.01 ** i and 1.01 ** (i + 1) share one, so a quantile is off by half a percent of itself at most.
BIN = 1.01
QUANTILE_ERROR = (BIN - 1) / (BIN + 1)


def monthly(rows: DataFrame, by: list[str], item: str, value: str, time: str = "period") -> DataFrame:
    """A row per month and key: ``distinct`` (a sketch of ``item``), ``bins`` (how many ``value`` fall in which bin), to be stored.

    Bins are relative, with the sign kept and zero on its own, so there are some 1,400 for each factor of a million. Hot keys combine
    map-side: a bin is a count.
    """
    month = F.date_format(time, "yyyy-MM").alias("month")
    v = F.col(value).cast("double")
    number = F.when(v == 0, F.lit(0)).otherwise(F.signum(v).cast("int") * (F.floor(F.log(F.abs(v)) / F.log(F.lit(BIN))).cast("int") + 100_000))
    counts = rows.where(v.isNotNull()).groupBy(month, *by, number.alias("bin")).agg(F.count("*").alias("n"))
    bins = counts.groupBy("month", *by).agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("bins"))
    distinct = rows.groupBy(month, *by).agg(F.hll_sketch_agg(item, LOG_REGISTERS).alias("distinct"))
    return distinct.join(bins, ["month", *by], "left")


def distinct_count(sketches: DataFrame, by: list[str]) -> DataFrame:
    """``n_distinct`` over all months of ``sketches``, within about 2 DISTINCT_ERROR."""
    return sketches.groupBy(*by).agg(F.hll_sketch_estimate(F.hll_union_agg("distinct")).alias("n_distinct"))


def quantiles(sketches: DataFrame, by: list[str], q: list[float]) -> DataFrame:
    """For each key and ``q`` the value of that rank (the smallest that as large a share doesn't exceed), off by at most QUANTILE_ERROR of itself."""
    counts = sketches.select(*by, F.explode("bins").alias("bin", "n")).groupBy(*by, "bin").agg(F.sum("n").alias("n"))
    listed = counts.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("bin", "n"))).alias("bins"), F.sum("n").alias("total"))
    at = listed.withColumn("q", F.explode(F.array(*[F.lit(float(x)) for x in q])))
    rank = "greatest(ceil(q * total), 1)"
    found = F.expr(f"aggregate(bins, struct(0L AS seen, CAST(NULL AS INT) AS bin), (s, x) -> struct(s.seen + x.n AS seen, IF(s.bin IS NULL AND s.seen + x.n >= {rank}, x.bin, s.bin) AS bin)).bin")
    b = F.col("_bin")
    # negative bins count from the largest size down, which array_sort's order of numbers keeps
    size = F.pow(F.lit(BIN), F.abs(b) - 100_000) * (2 * BIN / (BIN + 1))
    return at.withColumn("_bin", found).select(*by, "q", F.when(b == 0, F.lit(0.0)).otherwise(F.signum(b) * size).alias("value"))
