"""Exact ranks and percentiles without a global sort in one task.

Rows are first counted per distinct value (map-side combined, so a value shared by a third of all rows is
one row per map task). A quantile sketch then only proposes where to cut the distinct values into slices;
ranks come from exact counts, so the sketch's error affects balance and never the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattline.lineage import stage

#: Distinct values that one task orders, about.
PER_SLICE = 50_000


def value_ranks(df: DataFrame, by: list[str], col: str, slices: int | None = None, few_keys: bool = False) -> DataFrame:
    """One row per (key, distinct value): count ``n``, rows up to and including it ``cum``, key ``total``.

    The counts are stored, since the cuts, the slices' starts and the ranks all read them. Without ``slices`` there
    are as many as the number of counts asks for.

    ``few_keys`` says that the keys come from a fixed list, such as area codes; the cut points (one row per
    key) are then broadcast, so a key with a third of all rows stays spread out.
    """
    counts = stage(df.where(F.col(col).isNotNull()).groupBy(*by, col).agg(F.count(F.lit(1)).alias("n")), "counts")
    slices = slices or 1 + counts.count() // PER_SLICE
    marks = [i / slices for i in range(1, slices)]
    proposed = F.percentile_approx(F.col(col).cast("double"), marks, 10_000) if marks else F.array().cast("array<double>")
    cuts = counts.groupBy(*by).agg(proposed.alias("_cuts") if marks else F.first(proposed).alias("_cuts"), F.sum("n").alias("total"))
    if by:
        with_cuts = counts.join(F.broadcast(cuts) if few_keys else cuts, by)
    else:
        one = cuts.select(F.struct("_cuts", "total").alias("_one")).scalar()
        with_cuts = counts.select("*", one.alias("_one")).select(*counts.columns, "_one._cuts", "_one.total")
    value = F.col(col).cast("double")
    sliced = with_cuts.withColumn("_slice", F.size(F.filter("_cuts", lambda c: c < value))).drop("_cuts")
    keys = [*by, "_slice"]
    # at most ``slices`` rows per key
    before = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        sliced.groupBy(*keys)
        .agg(F.sum("n").alias("_n"))
        .select(*keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    )
    inside = Window.partitionBy(*keys).orderBy(col).rowsBetween(Window.unboundedPreceding, 0)
    return (
        sliced.join(starts, keys)
        .withColumn("cum", F.col("_before") + F.sum("n").over(inside))
        .select(*by, col, "n", "cum", "total")
    )


def percentile_bounds(
    df: DataFrame, by: list[str], col: str, ps: dict[str, float], slices: int | None = None, few_keys: bool = False
) -> DataFrame:
    """Per key and named percentile the two neighbouring values and the fraction between them.

    Columns ``<name>_lo``, ``<name>_hi`` and ``<name>_frac`` for every name in ``ps``, and the number of
    values ``total``.
    """
    ranked = value_ranks(df, by, col, slices, few_keys)
    first, last = F.col("cum") - F.col("n"), F.col("cum") - 1
    aggs: list[Column] = [F.max("total").alias("total")]
    wanted = F.lit(False)
    for name, p in ps.items():
        pos = (F.col("total") - 1) * F.lit(float(p))
        lo, hi = F.floor(pos), F.ceil(pos)
        at_lo, at_hi = lo.between(first, last), hi.between(first, last)
        wanted = wanted | at_lo | at_hi
        aggs += [
            F.max(F.when(at_lo, F.col(col))).alias(f"{name}_lo"),
            F.max(F.when(at_hi, F.col(col))).alias(f"{name}_hi"),
            F.max(pos - lo).alias(f"{name}_frac"),
        ]
    return ranked.where(wanted).groupBy(*by).agg(*aggs)


def percentiles(
    df: DataFrame, by: list[str], col: str, ps: dict[str, float], slices: int | None = None, few_keys: bool = False
) -> DataFrame:
    """Exact interpolated percentiles per key, one column per name in ``ps``."""
    bounds = percentile_bounds(df, by, col, ps, slices, few_keys)
    return bounds.select(
        *by,
        *[
            (F.col(f"{n}_lo") + (F.col(f"{n}_hi") - F.col(f"{n}_lo")) * F.col(f"{n}_frac")).alias(n)
            for n in ps
        ],
    )


def medians(df: DataFrame, by: list[str], cols: list[str], slices: int | None = None, few_keys: bool = False) -> DataFrame:
    """Exact median of several columns per key, in one pass over the long form of the columns."""
    pairs = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in cols])
    long = df.select(*by, F.explode(pairs).alias("_p")).select(*by, "_p.name", "_p.value")
    mids = percentiles(long, [*by, "name"], "value", {"median": 0.5}, slices, few_keys)
    return mids.groupBy(*by).agg(*[F.max(F.when(F.col("name") == c, F.col("median"))).alias(c) for c in cols])


def average_ranks(df: DataFrame, by: list[str], col: str, name: str = "avg_rank", slices: int | None = None) -> DataFrame:
    """Add the rank of each row's value in its key, ties sharing the mean rank."""
    ranks = value_ranks(df, by, col, slices)
    mean_rank = F.col("cum") - (F.col("n") - 1) / 2
    return df.join(ranks.select(*by, col, mean_rank.cast("double").alias(name)), [*by, col], "left").select(
        *df.columns, name
    )
