"""Joins on time intervals that come from tables.

An interval belongs to the scale whose buckets are at least as long as it, so it lies in two buckets at most. Rows meet on scale and
bucket, an equality, however many intervals there are and however they overlap; no plan compares all with all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattline.operators.asof import micros, slice_width

#: How totals of parts become totals of the whole.
MERGED = {"count": F.sum, "sum": F.sum, "min": F.min, "max": F.max}
#: Points that a bucket of a window's ends holds at most, about.
PER_BUCKET = 8


def _at(time: str | Column) -> Column:
    return F.unix_micros((F.col(time) if isinstance(time, str) else time).cast("timestamp"))


def _width(level: Column, base: int) -> Column:
    return F.lit(base) * F.pow(F.lit(2.0), level).cast("bigint")


def _bucket(t: Column, level: Column, base: int) -> Column:
    width = _width(level, base)
    return ((t - F.pmod(t, width)) / width).cast("bigint")


def _level(length: Column, base: int) -> Column:
    """The smallest scale with buckets as long as the interval."""
    return F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(length, F.lit(1)).cast("double") / base))).cast("int")


def _levels(df: DataFrame) -> list[int]:
    """Scales that occur: at most one for each doubling of a length."""
    return sorted(r[0] for r in df.select("_level").distinct().collect())


def _scaled(df: DataFrame, start: str, end: str, base: int, prefix: str) -> DataFrame:
    """Intervals with their ends and scale; those without an end, or that end before they start, go."""
    a, z = F.col(f"_{prefix}a"), F.col(f"_{prefix}z")
    timed = df.withColumns({f"_{prefix}a": _at(start), f"_{prefix}z": _at(end)}).where(a <= z)
    return timed.withColumn("_level", _level(z - a, base))


def interval_join(points: DataFrame, windows: DataFrame, time: str = "period", start: str = "start", end: str = "end", by: list[str] | None = None, base: str = "1 hour", closed: str = "both", totals: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """Each point with each window of its key (``by``) that holds its time, all columns of both; ``closed`` is both, left, right or neither.

    NULL times and keys match nothing. With ``totals`` (name to count, sum, min or max, and a column of the points or ``*``) the points come
    added up: a few rows for each window, with its columns and the totals of a part of it, which the caller adds up (``MERGED``).
    """
    by, step = by or [], micros(base)
    if totals:
        return _added_up(points, windows, time, start, end, by, closed, totals)
    if clash := (set(points.columns) & set(windows.columns)) - set(by):
        raise ValueError(f"columns {sorted(clash)} are on both sides; rename them first")
    ranged = _scaled(windows, start, end, step, "w")
    levels = _levels(ranged)
    a, z, t, level = F.col("_wa"), F.col("_wz"), F.col("_t"), F.col("_level")
    covered = ranged.withColumn("_bucket", F.explode(F.sequence(_bucket(a, level, step), _bucket(z, level, step))))
    timed = points.withColumn("_t", _at(time)).withColumn("_level", F.explode(F.array(*[F.lit(x) for x in levels]).cast("array<int>")))
    timed = timed.withColumn("_bucket", _bucket(t, level, step))
    inside = (t >= a if closed in ("both", "left") else t > a) & (t <= z if closed in ("both", "right") else t < z)
    out = timed.join(covered, [*by, "_level", "_bucket"]).where(inside)
    return out.select(*points.columns, *[c for c in windows.columns if c not in by])


def _added_up(points: DataFrame, windows: DataFrame, time: str, start: str, end: str, by: list[str], closed: str, totals: dict[str, tuple[str, str]]) -> DataFrame:
    """Windows with the totals of their parts: whole buckets, doubling in width, and two ends that meet single points.

    A window has two whole buckets of each width at most, so its rows grow with the logarithm of its length and not with its points.
    """
    merged = {n: MERGED[kind] for n, (kind, _) in totals.items()}
    timed = points.select(*by, _at(time).alias("_t"), *_values(totals)).where("_t IS NOT NULL")
    width = slice_width(timed, by, PER_BUCKET)
    a, z, first, last, level, side = (F.col(c) for c in ("_a", "_z", "_first", "_last", "_level", "_side"))
    # times are whole microseconds, so an open end is a closed one a microsecond further in
    open_a, open_z = int(closed in ("right", "neither")), int(closed in ("left", "neither"))
    ranged = windows.withColumns({"_a": _at(start) + open_a, "_z": _at(end) - open_z}).where(a <= z)
    ranged = ranged.withColumns({"_first": _bucket(a, F.lit(0), width), "_last": _bucket(z, F.lit(0), width)})
    span = ranged.agg(F.max(last - first)).first()[0] or 0

    ends = ranged.withColumn("_side", F.explode(F.when(first == last, F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))))
    ends = ends.withColumns({"_from": F.timestamp_micros(F.when(side == 0, a).otherwise(last * width)), "_to": F.timestamp_micros(F.when(side == 1, z).otherwise(F.least(z, (first + 1) * width - 1)))})
    kept = [F.col(c) for c in windows.columns]
    met = interval_join(timed.withColumn("_moment", F.timestamp_micros("_t")).drop("_t"), ends.select(*windows.columns, "_from", "_to"), "_moment", "_from", "_to", by, f"{-(-width // 1_000_000)} seconds")
    out = met.select(*kept, *[F.col(f"_v_{n}").alias(n) for n in totals])
    if span < 2:
        return out

    doublings = range(int(span - 1).bit_length())
    parts = _whole_buckets(ranged, kept, doublings)
    small = timed.groupBy(*by, _bucket(F.col("_t"), F.lit(0), width).alias("_b")).agg(*[f(f"_v_{n}").alias(f"_v_{n}") for n, f in merged.items()])
    whole = small.withColumn("_level", F.explode(F.array(*[F.lit(k) for k in doublings])))
    whole = whole.groupBy(*by, "_level", F.floor(F.col("_b") / F.pow(F.lit(2.0), level)).cast("bigint").alias("_bucket")).agg(*[f(f"_v_{n}").alias(f"_v_{n}") for n, f in merged.items()])
    joined = parts.join(whole, [*by, "_level", "_bucket"])
    return out.unionByName(joined.select(*kept, *[F.col(f"_v_{n}").alias(n) for n in totals]))


def _values(totals: dict[str, tuple[str, str]]) -> list[Column]:
    """What each row gives to the totals, as ``_v_`` and the name."""
    one = {n: F.lit(1).cast("bigint") if c == "*" else F.col(c).isNotNull().cast("bigint") if kind == "count" else F.col(c) for n, (kind, c) in totals.items()}
    return [v.alias(f"_v_{n}") for n, v in one.items()]


def _whole_buckets(ranged: DataFrame, kept: list[Column], doublings: range) -> DataFrame:
    """The buckets, doubling in width, that fill what lies between the first and the last bucket of each window.

    They lie from lo to hi at each width, hi left out; an odd lo, or the one before an odd hi, has no larger bucket to go into.
    """
    first, last, level, side = (F.col(c) for c in ("_first", "_last", "_level", "_side"))
    sides = F.array(*[F.struct(F.lit(k).alias("_level"), F.lit(x).alias("_side")) for k in doublings for x in (0, 1)])
    lo, hi = F.ceil((first + 1) / F.pow(F.lit(2.0), level)).cast("bigint"), F.floor(last / F.pow(F.lit(2.0), level)).cast("bigint")
    parts = ranged.where(last - first > 1).select(*kept, "_first", "_last", F.inline(sides)).withColumns({"_lo": lo, "_hi": hi})
    odd = F.when(side == 0, F.pmod("_lo", F.lit(2))).otherwise(F.pmod("_hi", F.lit(2))) == 1
    return parts.where((F.col("_lo") < F.col("_hi")) & odd).withColumn("_bucket", F.when(side == 0, F.col("_lo")).otherwise(F.col("_hi") - 1))


def _lasting(a: DataFrame, b: DataFrame, start: str, end: str, other_start: str, other_end: str, by: list[str], totals: dict[str, tuple[str, str]]) -> DataFrame:
    """Intervals of ``a`` with the totals of those of ``b`` that began before them and last until their start or longer.

    The other way round than ``_added_up``: intervals of ``b`` are added up in the whole buckets they fill, and the two ends of each meet single starts.
    """
    merged = {n: MERGED[kind] for n, (kind, _) in totals.items()}
    sums = [f(f"_v_{n}").alias(f"_v_{n}") for n, f in merged.items()]
    t, first, last, level, side, bucket = (F.col(c) for c in ("_t", "_first", "_last", "_level", "_side", "_bucket"))
    mine = a.withColumns({"_t": _at(start)}).where(t <= _at(end))
    moments = mine.select(*by, "_t").distinct()
    width = slice_width(moments, by, PER_BUCKET)
    base = _bucket(t, F.lit(0), width)
    lasting = b.select(*by, (_at(other_start) + 1).alias("_a"), _at(other_end).alias("_z"), *_values(totals)).where("_a <= _z")
    lasting = lasting.withColumns({"_first": _bucket(F.col("_a"), F.lit(0), width), "_last": _bucket(F.col("_z"), F.lit(0), width)})
    span = lasting.agg(F.max(last - first)).first()[0] or 0

    ends = lasting.withColumn("_side", F.explode(F.when(first == last, F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1))))).withColumn("_bucket", F.when(side == 0, first).otherwise(last))
    met = moments.withColumn("_bucket", base).join(ends.drop("_first", "_last", "_side"), [*by, "_bucket"]).where((F.col("_a") <= t) & (t <= F.col("_z")))
    met = met.groupBy(*by, "_t").agg(*sums)
    kept = [F.col(c) for c in a.columns]
    out = mine.join(met, [*by, "_t"]).select(*kept, *[F.col(f"_v_{n}").alias(n) for n in totals])
    if span < 2:
        return out

    doublings = range(int(span - 1).bit_length())
    filled = _whole_buckets(lasting, [F.col(c) for c in (*by, *[f"_v_{n}" for n in totals])], doublings).groupBy(*by, "_level", "_bucket").agg(*sums)
    up = F.explode(F.array(*[F.lit(k) for k in doublings]))
    asked = moments.select(*by, base.alias("_base")).distinct().withColumn("_level", up).withColumn("_bucket", F.floor(F.col("_base") / F.pow(F.lit(2.0), level)).cast("bigint"))
    filled = asked.join(filled, [*by, "_level", "_bucket"]).groupBy(*by, "_base").agg(*sums)
    joined = mine.withColumn("_base", base).join(filled, [*by, "_base"])
    return out.unionByName(joined.select(*kept, *[F.col(f"_v_{n}").alias(n) for n in totals]))


def overlap_join(a: DataFrame, b: DataFrame, start: str = "start", end: str = "end", other_start: str = "other_start", other_end: str = "other_end", by: list[str] | None = None, base: str = "1 hour", totals: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """Pairs of intervals of one key that share a moment, ends included; all columns of both.

    A pair meets at the coarser of its two scales, and is kept in the first bucket that both lie in. With ``totals`` (name to count, sum, min or
    max, and a column of ``b`` or ``*``) there are no pairs: an interval of ``a`` comes in a few rows, with totals of parts of what it
    overlaps, which the caller adds up (``MERGED``). What it overlaps either begins inside it or lasts at its start.
    """
    by, step = by or [], micros(base)
    if totals:
        whole = b.where(_at(other_start) <= _at(other_end))
        inside = _added_up(whole, a, other_start, start, end, by, "both", totals)
        return inside.unionByName(_lasting(a, whole, start, end, other_start, other_end, by, totals))
    if clash := (set(a.columns) & set(b.columns)) - set(by):
        raise ValueError(f"columns {sorted(clash)} are on both sides; rename them first")
    left, right = _scaled(a, start, end, step, "l").withColumnRenamed("_level", "_lo"), _scaled(b, other_start, other_end, step, "r").withColumnRenamed("_level", "_ro")
    levels = sorted({*_levels(left.withColumnRenamed("_lo", "_level")), *_levels(right.withColumnRenamed("_ro", "_level"))})
    every, level = F.array(*[F.lit(x) for x in levels]).cast("array<int>"), F.col("_level")

    def spread(df: DataFrame, own: str, s: str) -> DataFrame:
        up = df.withColumn("_level", F.explode(F.filter(every, lambda x: x >= F.col(own))))
        first = _bucket(F.col(f"_{s}a"), level, step)
        return up.withColumn(f"_{s}f", first).withColumn("_bucket", F.explode(F.sequence(F.col(f"_{s}f"), _bucket(F.col(f"_{s}z"), level, step))))

    met = spread(left, "_lo", "l").join(spread(right, "_ro", "r"), [*by, "_level", "_bucket"])
    met = met.where((level == F.greatest("_lo", "_ro")) & (F.col("_bucket") == F.greatest("_lf", "_rf")) & (F.col("_la") <= F.col("_rz")) & (F.col("_ra") <= F.col("_lz")))
    return met.select(*a.columns, *[c for c in b.columns if c not in by])


def flag_windows(df: DataFrame, windows: DataFrame, time: str = "period", start: str = "start", end: str = "end", name: str = "in_window") -> DataFrame:
    """Whether a row's time lies in any window of a table, ends included; NULL times are in none.

    Windows are looked up once for each distinct time.
    """
    times = df.select(F.col(time).alias("_moment")).where("_moment IS NOT NULL").distinct()
    hit = interval_join(times, windows.select(F.col(start).alias("_start"), F.col(end).alias("_end")), "_moment", "_start", "_end").select("_moment").distinct()
    out = df.drop(name).join(hit.withColumn(name, F.lit(True)), F.col(time) == F.col("_moment"), "left")
    return out.withColumn(name, F.coalesce(name, F.lit(False))).drop("_moment")


def separation_in(daily: DataFrame, windows: DataFrame, col: str, label: str = "label", time: str = "period", start: str = "start", end: str = "end") -> DataFrame:
    """For each label of a table of windows: mean, spread and days of ``col`` inside its windows, and how far that is from all days in none.

    A day in several windows of a label counts once for it.
    """
    days = daily.select(F.col(time).alias("_time"), F.col(col).cast("double").alias("_v"))
    named = windows.select(F.col(label).alias("label"), F.col(start).alias("_start"), F.col(end).alias("_end"))
    times = days.select("_time").distinct()
    inside = interval_join(times, named, "_time", "_start", "_end").select("_time", "label").distinct()
    calm = flag_windows(days, named, "_time", "_start", "_end").where("NOT in_window").agg(F.avg("_v").alias("_calm"))
    each = days.join(inside, "_time").groupBy("label").agg(F.avg("_v").alias("mean"), F.stddev_samp("_v").alias("std"), F.count("_v").alias("days"))
    # one row
    return each.join(F.broadcast(calm)).select("label", "mean", "std", "days", (F.col("mean") - F.col("_calm")).alias("delta"))
