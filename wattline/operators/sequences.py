"""Row-ordered work on long keys without putting a whole key into one task.

``Window.partitionBy("ba_code")`` sends every row of an area to one task, so its speed is capped by the
number of areas and one large area can stall the job. The functions here cut each key into slices, carry
the little that must cross a slice border (a row count, a last known value, a partial sum) through a small
per-slice table, and then work on all slices at once. Results equal those of the plain window.

The slice expression only has to rise with the order column. For hourly tables a month is a good slice: at
most 744 rows per area.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def month_slice(order: str = "period") -> Column:
    return F.date_trunc("month", F.col(order))


def number_rows(
    df: DataFrame,
    by: list[str],
    order: str | list[str],
    slice_by: Column | None = None,
    name: str = "row_no",
) -> DataFrame:
    """Add the 0-based position of each row in its key, exactly as one long window would.

    Counts per (key, slice) are summed up over the few slices of a key to give each slice its first
    position; rows are then numbered inside their slice.
    """
    orders = [order] if isinstance(order, str) else list(order)
    slice_by = month_slice(orders[0]) if slice_by is None else slice_by
    keys = [*by, "_slice"]
    sliced = df.withColumn("_slice", slice_by)
    before = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        sliced.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(*keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    )
    inside = Window.partitionBy(*keys).orderBy(*orders)
    return (
        sliced.join(starts, keys)
        .withColumn(name, F.col("_first") + F.row_number().over(inside) - 1)
        .drop("_slice", "_first")
    )


def chunk_plan(
    df: DataFrame,
    by: list[str],
    order: str,
    back: int = 0,
    ahead: int = 0,
    chunk_rows: int = 2048,
    cell_by: Column | None = None,
) -> DataFrame:
    """One row per (key, cell): the chunk that owns its rows and all chunks that must see them.

    A cell is a short stretch of the order column, by default a day. Cells are counted, their first row
    number is the running total, and consecutive cells make up chunks of about ``chunk_rows`` rows. A cell
    is also shown to every later chunk that starts within ``back`` rows of it and to every earlier chunk
    that ends within ``ahead`` rows of it. Everything here works on cells, at most 366 a year and key.
    """
    cell_by = F.date_trunc("day", F.col(order)) if cell_by is None else cell_by
    in_order = Window.partitionBy(*by).orderBy("_cell")
    cells = (
        df.select(*by, cell_by.alias("_cell"))
        .groupBy(*by, "_cell")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_end", F.sum("_n").over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("_start", F.col("_end") - F.col("_n"))
        .withColumn("_own", F.floor(F.col("_start") / chunk_rows))
    )
    homes = [F.array("_own")]
    # the next cell starts where this one ends, so its range frame tells who lies within reach
    if back:
        near = Window.partitionBy(*by).orderBy("_start").rangeBetween(0, back - 1)
        cells = cells.withColumn("_after", F.collect_set("_own").over(near))
        homes.append(F.coalesce(F.lead("_after").over(in_order), F.array().cast("array<bigint>")))
    if ahead:
        near = Window.partitionBy(*by).orderBy("_end").rangeBetween(-(ahead - 1), 0)
        cells = cells.withColumn("_before", F.collect_set("_own").over(near))
        homes.append(F.coalesce(F.lag("_before").over(in_order), F.array().cast("array<bigint>")))
    return cells.select(*by, "_cell", "_own", F.array_distinct(F.concat(*homes)).alias("_homes"))


def over_rows(
    df: DataFrame,
    by: list[str],
    order: str,
    build: Callable[[WindowSpec], dict[str, Column]],
    back: int = 0,
    ahead: int = 0,
    chunk_rows: int = 2048,
    cell_by: Column | None = None,
    plan: DataFrame | None = None,
    few_keys: bool = False,
) -> DataFrame:
    """Row-frame window functions over chunks with a halo; same output as over whole keys.

    ``build`` gets a window ordered inside one chunk and returns the columns to add. It may look at most
    ``back`` rows back and ``ahead`` rows ahead, counted in rows, so frames are complete whatever hours are
    missing. Rows go to every chunk that ``chunk_plan`` names for their cell and those shown as halo are
    dropped at the end: one shuffle and one sort of the table.

    ``plan`` may hold a chunk plan made on a narrower table with the same rows, for instance before joins.
    ``few_keys`` says that the keys come from a fixed list, such as the area codes; the plan then has at
    most a row per area and day and is broadcast. Otherwise Spark chooses the join by size.
    """
    cell_by = F.date_trunc("day", F.col(order)) if cell_by is None else cell_by
    if plan is None:
        plan = chunk_plan(df, by, order, back, ahead, chunk_rows, cell_by)
    if few_keys:
        plan = F.broadcast(plan)
    spread = (
        df.withColumn("_cell", cell_by)
        .join(plan, [*by, "_cell"])
        .drop("_cell")
        .withColumn("_chunk", F.explode("_homes"))
        .drop("_homes")
    )
    w = Window.partitionBy(*by, "_chunk").orderBy(order)
    return spread.withColumns(build(w)).where(F.col("_chunk") == F.col("_own")).drop("_own", "_chunk")


def fill(
    df: DataFrame,
    cols: list[str],
    by: list[str],
    order: str = "period",
    backward: bool = True,
    slice_by: Column | None = None,
    few_keys: bool = False,
) -> DataFrame:
    """Last known value forward, then (optionally) first known value backward, per key.

    The value that enters a slice from earlier ones (or, backward, from later ones) is found on a table
    with one row per slice, so a gap may span any number of slices. Backward fill looks into the future;
    turn it off where that matters. ``few_keys``: see ``over_rows``.
    """
    slice_by = month_slice(order) if slice_by is None else slice_by
    keys = [*by, "_slice"]
    sliced = df.withColumn("_slice", slice_by)
    edge = []
    for c in cols:
        known = F.when(F.col(c).isNotNull(), F.col(order))
        edge.append(F.max_by(c, known).alias(f"_last_{c}"))
        if backward:
            edge.append(F.min_by(c, known).alias(f"_first_{c}"))
    # looking ahead is looking back in falling order: a frame that grows costs one step per row, one that
    # shrinks would be worked out anew for every row
    earlier = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy(*by).orderBy(F.desc("_slice")).rowsBetween(Window.unboundedPreceding, -1)
    carried = [F.last(f"_last_{c}", ignorenulls=True).over(earlier).alias(f"_in_{c}") for c in cols]
    if backward:
        carried += [F.last(f"_first_{c}", ignorenulls=True).over(later).alias(f"_out_{c}") for c in cols]
    borders = sliced.groupBy(*keys).agg(*edge).select(*keys, *carried)
    if few_keys:
        borders = F.broadcast(borders)
    past = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    future = Window.partitionBy(*keys).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0)
    filled = {}
    for c in cols:
        steps = [F.last(c, ignorenulls=True).over(past), F.col(f"_in_{c}")]
        if backward:
            steps += [F.last(c, ignorenulls=True).over(future), F.col(f"_out_{c}")]
        filled[c] = F.coalesce(*steps)
    return sliced.join(borders, keys).withColumns(filled).select(*df.columns)
