"""As-of joins of two tables with irregular times, both of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

HOUR = 3_600_000_000


def micros(interval: str) -> int:
    """Microseconds of an interval such as ``2 hours``."""
    n, unit = interval.split()
    return int(n) * {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 604800}[unit.rstrip("s")] * 1_000_000


def slice_width(rows: DataFrame, by: list[str], per_slice: int) -> int:
    """Microseconds of time in which no key has more than about ``per_slice`` rows; ``_t`` is the time."""
    busiest = rows.groupBy(*by, (F.col("_t") - F.pmod("_t", F.lit(HOUR))).alias("_h")).count().agg(F.max("count")).first()[0] or 1
    return max(1_000_000, HOUR * per_slice // busiest)


def asof_join(
    left: DataFrame, right: DataFrame, by: list[str], time: str = "period", right_time: str | None = None, cols: list[str] | None = None,
    direction: str = "backward", tolerance: str | None = None, exact: bool = True, matched: str = "matched_at", per_slice: int = 100_000,
) -> DataFrame:
    """Every left row with ``cols`` of the right row of its key that was last known at its time, and that row's time as ``matched``.

    ``direction`` is ``backward``, ``forward`` (the next to come) or ``nearest`` (the earlier of two as near). With ``tolerance`` a row farther
    away doesn't match; without ``exact`` nor does one of the same time. Of right rows with one time the one with the largest ``cols`` counts.
    Left rows with a NULL key or time, and those without a match, stay with NULLs.

    Both sides are put in one row of time per key, which is cut into slices of at most about ``per_slice`` rows. A slice needs the last right row before
    it: those come from a table with one row per slice, so a key with most of the rows is spread over all tasks, and nothing is broadcast.
    """
    right_time = right_time or time
    cols = cols if cols is not None else [c for c in right.columns if c not in (*by, right_time)]
    if clash := {*cols, matched} & set(left.columns):
        raise ValueError(f"columns {sorted(clash)} are on both sides; rename them first")
    if direction == "nearest":
        far = [f"_next_{c}" for c in (*cols, matched)]
        back = asof_join(left, right, by, time, right_time, cols, "backward", tolerance, exact, matched, per_slice)
        later = right.select(*by, right_time, *[F.col(c).alias(f"_next_{c}") for c in cols])
        both = asof_join(back, later, by, time, right_time, far[:-1], "forward", tolerance, exact, far[-1], per_slice)
        off, ahead = (F.abs(F.unix_micros(F.col(c).cast("timestamp")) - F.unix_micros(F.col(time).cast("timestamp"))) for c in (matched, far[-1]))
        take = F.col(matched).isNull() | (ahead < off)
        return both.select(*left.columns, *[F.when(take, F.col(f)).otherwise(F.col(c)).alias(c) for c, f in zip((*cols, matched), far, strict=True)])
    if direction not in ("backward", "forward"):
        raise ValueError("direction is backward, forward or nearest")
    sign = 1 if direction == "backward" else -1
    keys = [f"_k{i}" for i in range(len(by))]

    def placed(df: DataFrame, t: str, side: int, **payload) -> DataFrame:
        at = F.lit(sign) * F.unix_micros(F.col(t).cast("timestamp"))
        return df.select(*[F.col(b).alias(k) for b, k in zip(by, keys, strict=True)], at.alias("_t"), F.lit(side).alias("_side"), *[v.alias(k) for k, v in payload.items()])

    usable = F.lit(True)
    for b in by:
        usable = usable & F.col(b).isNotNull()
    # of rows with one time those on the right come first, unless only earlier ones count
    known = right.where(usable & F.col(right_time).isNotNull())
    found = F.struct(F.col(right_time).alias(matched), *[F.col(c) for c in cols])
    sides = (0, 1) if exact else (1, 0)
    lefts = placed(left.where(usable & F.col(time).isNotNull()), time, sides[1], _l=F.struct(*[F.col(c) for c in left.columns]))
    rights = placed(known, right_time, sides[0], _r=found)
    both = lefts.unionByName(rights, allowMissingColumns=True)
    width = slice_width(both.select(*keys, "_t"), keys, per_slice)
    both = both.withColumn("_slice", F.col("_t") - F.pmod("_t", F.lit(width)))
    last = both.groupBy(*keys, "_slice").agg(F.max(F.when(F.col("_r").isNotNull(), F.struct("_t", "_r"))).alias("_last"))
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select(*keys, "_slice", F.last("_last", ignorenulls=True).over(before).alias("_before"))
    inside = Window.partitionBy(*keys, "_slice").orderBy("_t", "_side", "_r").rowsBetween(Window.unboundedPreceding, 0)
    # of the right rows with one time the largest is the last
    met = both.join(carried, [*keys, "_slice"]).withColumn("_m", F.coalesce(F.last("_r", ignorenulls=True).over(inside), F.col("_before._r"))).where("_l IS NOT NULL")
    hit = F.col("_m").isNotNull()
    if tolerance is not None:
        hit = hit & (F.abs(F.unix_micros(F.col(f"_m.{matched}").cast("timestamp")) * sign - F.col("_t")) <= micros(tolerance))
    out = met.select("_l.*", *[F.when(hit, F.col(f"_m.{c}")).alias(c) for c in (*cols, matched)])
    lost = left.where(~usable | F.col(time).isNull())
    return out.unionByName(lost.select("*", *[F.lit(None).cast(out.schema[c].dataType).alias(c) for c in (*cols, matched)]))
