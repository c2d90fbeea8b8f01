"""Splits, imputation and training samples."""

from __future__ import annotations

from pyspark.ml.feature import StringIndexer
from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from wattline.operators.features import over_rows
from wattline.operators.ranks import percentiles
from wattline.operators.sequences import fill
from wattline.reference_data import HISTORY_HOURS, HORIZON_HOURS, SPLIT_DATES

BY = ["ba_code"]


def load_features(features: DataFrame) -> DataFrame:
    """Rows fit for modelling, in area and time order."""
    return features.where("demand_mw IS NOT NULL AND demand_lag_168h IS NOT NULL").orderBy("ba_code", "period")


def label_split(df: DataFrame, dates: dict[str, tuple[str, str]] = SPLIT_DATES) -> DataFrame:
    """Name of the half-open date range each row falls in; NULL outside all of them."""
    label: Column = F.lit(None).cast("string")
    for name, (start, end) in dates.items():
        inside = (F.col("period") >= F.lit(start).cast("timestamp")) & (F.col("period") < F.lit(end).cast("timestamp"))
        label = F.when(inside, name).otherwise(label)
    return df.withColumn("split", label)


def ordered_split(df: DataFrame, fraction: float = 0.8, order: str = "time_idx") -> DataFrame:
    """Mark the earlier ``fraction`` of the time range of rows as training data.

    The cut is the percentile of the time index over all rows, so every area is cut at the same hour.
    """
    cut = percentiles(df, [], order, {"cut": fraction}).scalar()
    return df.select("*", (F.col(order) <= cut).alias("is_train"))


def encode(train: DataFrame, df: DataFrame, cols: list[str]) -> DataFrame:
    """Category codes learned on ``train``; values unseen there share one extra code."""
    indexer = StringIndexer(
        inputCols=cols, outputCols=[f"{c}_code" for c in cols], handleInvalid="keep", stringOrderType="alphabetAsc"
    )
    return indexer.fit(train).transform(df)


def group_median(df: DataFrame, cols: list[str], by: list[str] | None = None) -> DataFrame:
    """Fill NULLs with the exact median of their group.

    Medians are worked out only for the columns of a group that have a NULL there, which keeps the values
    to rank few when little is missing. Groups are areas, or keys from a list as short: their medians are
    broadcast.
    """
    by = by or BY
    gaps = df.groupBy(*by).agg(
        F.array_compact(F.array(*[F.when(F.count_if(F.col(c).isNull()) > 0, F.lit(c)) for c in cols])).alias("_gaps")
    )
    pairs = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in cols])
    asked = F.filter(pairs, lambda p: F.array_contains(F.col("_gaps"), p["name"]) & p["value"].isNotNull())
    long = df.join(F.broadcast(gaps), by).select(*by, F.explode(asked).alias("_p")).select(*by, "_p.name", "_p.value")
    mids = (
        percentiles(long, [*by, "name"], "value", {"median": 0.5}, few_keys=True)
        .groupBy(*by)
        .agg(*[F.max(F.when(F.col("name") == c, F.col("median"))).alias(f"_med_{c}") for c in cols])
    )
    return df.join(F.broadcast(mids), by, "left").withColumns({c: F.coalesce(c, f"_med_{c}") for c in cols}).select(*df.columns)


def impute(df: DataFrame, cols: list[str], by: list[str] | None = None, backward: bool = True) -> DataFrame:
    """Known value forward, then backward, then the group's median, then 0."""
    by = by or BY
    carried = fill(df, cols, by, backward=backward)
    return group_median(carried, cols, by).withColumns({c: F.coalesce(c, F.lit(0.0)) for c in cols})


def _values(c: str, w: WindowSpec) -> Column:
    """All values of a frame in order, NULLs included."""
    return F.transform(F.collect_list(F.struct(F.col(c).alias("v"))).over(w), lambda x: x["v"])


def make_samples(
    df: DataFrame, enc: int = HISTORY_HOURS, dec: int = HORIZON_HOURS, target: str = "demand_mw", min_enc: int | None = None
) -> DataFrame:
    """History and future arrays around every row, as training samples.

    A sample needs at least half the history and one future row. Arrays hold at most ``enc`` and ``dec``
    values, whatever the length of the series. Slots are rows, one without a value holds a NULL; see ``hour_samples`` for slots that are hours.
    """
    min_enc = enc // 2 if min_enc is None else min_enc
    out = over_rows(
        df.select("ba_code", "period", target),
        BY,
        "period",
        lambda w: {
            "history": _values(target, w.rowsBetween(-(enc - 1), 0)),
            "future": _values(target, w.rowsBetween(1, dec)),
        },
        back=enc,
        ahead=dec,
    )
    return out.where((F.size("history") >= min_enc) & (F.size("future") >= 1))


def hour_samples(df: DataFrame, enc: int = HISTORY_HOURS, dec: int = HORIZON_HOURS, target: str = "demand_mw", min_enc: int | None = None) -> DataFrame:
    """Samples whose slots are hours: ``history`` (the ``enc`` hours up to a row), ``future`` (the ``dec`` hours after it) and masks of what is known.

    An hour that is missing, or has no value, is a NULL in its own slot with a false mask, so every slot stays at its distance from the row. A sample
    needs ``min_enc`` (default: half) known hours of history and a known one to come. One row per hour and area is asked for.
    """
    min_enc = enc // 2 if min_enc is None else min_enc
    rows = df.select("ba_code", "period", F.col(target).alias("_v"))
    # missing hours become rows, but of a long gap only those that a frame at its end or beginning reaches
    gaps = over_rows(rows, BY, "period", lambda w: {"_next": F.lead("period").over(w)}, ahead=1)
    wide = ((F.unix_timestamp("_next") - F.unix_timestamp("period")) / 3600).cast("int")
    first = F.sequence(F.lit(1), F.least(wide - 1, F.lit(dec)))
    last = F.sequence(F.greatest(wide - enc, F.lit(1)), wide - 1)
    steps = F.when(F.coalesce(wide, F.lit(1)) > 1, F.array_distinct(F.concat(first, last)))
    holes = gaps.select("ba_code", "period", F.explode(steps).alias("_n")).select(
        "ba_code", F.timestamp_seconds(F.unix_timestamp("period") + F.col("_n") * 3600).alias("period"), F.lit(None).cast("double").alias("_v"), F.lit(False).alias("_real")
    )
    dense = rows.withColumn("_v", F.col("_v").cast("double")).withColumn("_real", F.lit(True)).unionByName(holes)
    out = over_rows(dense, BY, "period", lambda w: {"history": _values("_v", w.rowsBetween(-(enc - 1), 0)), "future": _values("_v", w.rowsBetween(1, dec))}, back=enc, ahead=dec).where("_real")
    nothing = F.lit(None).cast("double")
    out = out.select(
        "ba_code", "period",
        F.concat(F.array_repeat(nothing, enc - F.size("history")), F.col("history")).alias("history"),
        F.concat(F.col("future"), F.array_repeat(nothing, dec - F.size("future"))).alias("future"),
    )
    masked = out.withColumns({f"{c}_mask": F.transform(c, lambda x: x.isNotNull()) for c in ("history", "future")})
    known = {c: F.size(F.filter(f"{c}_mask", lambda x: x)) for c in ("history", "future")}
    return masked.where((known["history"] >= min_enc) & (known["future"] >= 1))


def rolling_origins(
    df: DataFrame, start: str, end: str, step: int = HORIZON_HOURS, enc: int = HISTORY_HOURS, dec: int = HORIZON_HOURS,
    min_rows: int | None = None,
) -> DataFrame:
    """Forecast origins every ``step`` hours that have all of their history and future rows.

    Each row is handed to the few origins whose window it lies in (window / step of them) and counted;
    no range join takes place. The window is [origin - enc, origin + dec); ``min_rows`` asks for fewer rows
    than it has hours.
    """
    min_rows = enc + dec if min_rows is None else min_rows
    first, last = F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")
    hours_in = F.floor((F.unix_timestamp("period") - F.unix_timestamp(first)) / 3600)
    # origin number k serves hours k*step - enc .. k*step + dec - 1
    lo = F.ceil((hours_in - dec + 1) / step)
    hi = F.floor((hours_in + enc) / step)
    n_origins = F.ceil((F.unix_timestamp(last) - F.unix_timestamp(first)) / (3600 * step))
    lo, hi = F.greatest(lo, F.lit(0)), F.least(hi, n_origins - 1)
    served = df.select("ba_code", F.explode(F.when(lo <= hi, F.sequence(lo, hi))).alias("_k"))
    return (
        served.groupBy("ba_code", "_k")
        .agg(F.count(F.lit(1)).alias("n_rows"))
        .where(F.col("n_rows") >= min_rows)
        .select("ba_code", F.timestamp_seconds(F.unix_timestamp(first) + F.col("_k") * step * 3600).alias("origin"), "n_rows")
    )
