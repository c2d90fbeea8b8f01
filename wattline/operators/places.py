"""Joins of places within a radius, by a grid of cells on the globe."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from wattline.lineage import stage

RADIUS_KM = 6371.0088
#: A cell with so many pairs of a point and a centre is added up in blocks, of so many points and centres at most.
DENSE, POINTS, CENTRES = 1 << 14, 1 << 15, 1 << 13
#: Cosines nearer than this to that of the radius, or to the largest of a centre, are left to the great circle; rounding moves them far less.
SLACK, AT_ONCE = 1e-13, 1 << 18


def distance_km(lat: Column, lon: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance of two places in degrees."""
    a, b = F.radians(lat), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(lon2 - lon) / 2), 2)
    return 2 * RADIUS_KM * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def radius_join(
    points: DataFrame, centres: DataFrame, km: float, lat: str = "lat", lon: str = "lon", centre_lat: str = "centre_lat", centre_lon: str = "centre_lon", name: str = "distance_km",
    totals: dict[str, tuple[str, str]] | None = None,
) -> DataFrame:
    """Each point with each centre at most ``km`` away, all columns of both and the distance.

    The globe is cut into bands as high as the radius and each band into cells at least as wide, so fewer of them towards the poles. A point lies
    in one cell; a centre is listed in the few that its circle reaches, across the date line and over the poles. Both meet on the cell, so no
    table of centres is too long. Places that aren't on the globe (a latitude beyond 90, NULLs) are near nothing.

    With ``totals`` (name to count, min or max, and ``*``, a column of whole numbers of the points or, for min, the distance) the points come added
    up: a few rows for each centre, with its columns and the totals of a part, which the caller adds up (a sum of counts, else min and max).
    """
    if not 0 < km < 5000:
        raise ValueError("a radius is between 0 and 5000 km")
    if clash := set(points.columns) & set(centres.columns):
        raise ValueError(f"columns {sorted(clash)} are on both sides; rename them first")
    step = math.degrees(km / RADIUS_KM) * 1.000001

    def on_globe(df: DataFrame, a: str, o: str, p: str) -> DataFrame:
        turned = F.pmod(F.col(o).cast("double") + 180, F.lit(360.0))
        return df.withColumns({f"_{p}a": F.col(a).cast("double"), f"_{p}o": turned}).where(f"_{p}a BETWEEN -90 AND 90 AND _{p}o >= 0")

    def band(a: Column) -> Column:
        return F.floor(a / step)

    def cells(b: Column) -> Column:
        """How many cells a band has: each at least a radius wide at the edge nearer to a pole."""
        edge = F.least(F.greatest(F.abs(b * step), F.abs((b + 1) * step)), F.lit(90.0))
        return F.greatest(F.lit(1), F.floor(360 * F.cos(F.radians(edge)) / step))

    def cell(o: Column, n: Column) -> Column:
        return F.floor(o * n / 360)

    placed = on_globe(points, lat, lon, "p").withColumn("_band", band(F.col("_pa")))
    placed = placed.withColumn("_cell", F.least(cell(F.col("_po"), cells(F.col("_band"))), cells(F.col("_band")) - 1))
    reach = on_globe(centres, centre_lat, centre_lon, "c").withColumn("_band", F.explode(F.sequence(band(F.col("_ca") - step), band(F.col("_ca") + step))))
    # the circle's half width in longitude; all of them where it holds a pole
    half = F.when(F.abs("_ca") + step >= 90, F.lit(180.0)).otherwise(F.degrees(F.asin(F.least(F.sin(F.radians(F.lit(step))) / F.cos(F.radians("_ca")), F.lit(1.0)))) * 1.000001)
    reach = reach.withColumns({"_n": cells(F.col("_band")), "_half": half})
    lo, hi = cell(F.col("_co") - F.col("_half"), F.col("_n")), cell(F.col("_co") + F.col("_half"), F.col("_n"))
    near = F.when(hi - lo + 1 >= F.col("_n"), F.sequence(F.lit(0).cast("bigint"), F.col("_n").cast("bigint") - 1)).otherwise(F.transform(F.sequence(lo, hi), lambda c: F.pmod(c, F.col("_n").cast("bigint"))))
    reach = reach.withColumn("_cell", F.explode(F.array_distinct(near)))
    placed = placed.withColumn("_cell", F.col("_cell").cast("bigint"))
    if totals:
        return _added_up(placed, reach, centres.columns, km, name, totals)
    return _met(placed, reach, km, name).select(*points.columns, *centres.columns, name)


def _met(placed: DataFrame, reach: DataFrame, km: float, name: str) -> DataFrame:
    met = placed.join(reach, ["_band", "_cell"])
    return met.withColumn(name, distance_km(F.col("_pa"), F.col("_po"), F.col("_ca"), F.col("_co"))).where(F.col(name) <= km)


def _added_up(placed: DataFrame, reach: DataFrame, kept: list[str], km: float, name: str, totals: dict[str, tuple[str, str]]) -> DataFrame:
    """Centres with the totals of the points near them in each cell; pairs never leave the task of a cell with many of them."""
    kinds = {n: T.LongType() if kind == "count" else T.DoubleType() if c == name else placed.schema[c].dataType for n, (kind, c) in totals.items()}
    for n, (kind, c) in totals.items():
        whole = c == "*" or (c != name and isinstance(placed.schema[c].dataType, T.IntegralType))
        if not (kind == "count" and c != name or kind in ("min", "max") and c != "*" and whole or (kind, c) == ("min", name)):
            raise ValueError(f"no total {kind} of {c}")
    of_points = {c for _, c in totals.values()} - {"*", name}
    here = placed.select("_band", "_cell", "_pa", "_po", *[F.col(c).alias(f"_v_{c}") for c in of_points])
    there = reach.select("_band", "_cell", "_ca", "_co", *kept)

    cells = here.groupBy("_band", "_cell").agg(F.count("*").alias("_np")).join(there.groupBy("_band", "_cell").agg(F.count("*").alias("_nc")), ["_band", "_cell"])
    cells = stage(cells.selectExpr("_band", "_cell", f"_np * _nc >= {DENSE} AS _dense", f"CAST(ceil(_np / {POINTS}) AS INT) AS _pb", f"CAST(ceil(_nc / {CENTRES}) AS INT) AS _cb"), "cells")
    few, many = cells.where("NOT _dense").select("_band", "_cell"), cells.where("_dense").drop("_dense")

    single = {n: F.lit(1) if c == "*" else F.col(c) if c == name else F.col(f"_v_{c}").isNotNull() if kind == "count" else F.col(f"_v_{c}") for n, (kind, c) in totals.items()}
    apart = _met(here.join(few, ["_band", "_cell"]), there, km, name).select(*kept, *[v.cast(kinds[n]).alias(n) for n, v in single.items()])

    # blocks of a cell's points meet blocks of its centres
    row = F.monotonically_increasing_id()
    asked = here.withColumn("_row", row).join(many, ["_band", "_cell"]).withColumns({"_i": F.expr("pmod(_row, _pb)"), "_j": F.explode(F.expr("sequence(0L, _cb - 1L)"))})
    asking = there.withColumn("_row", row).join(many, ["_band", "_cell"]).withColumns({"_j": F.expr("pmod(_row, _cb)"), "_i": F.explode(F.expr("sequence(0L, _pb - 1L)"))})
    schema = T.StructType([reach.schema[c] for c in kept] + [T.StructField(n, kind) for n, kind in kinds.items()])

    def add_up(points: pa.Table, centres: pa.Table) -> pa.Table:
        out = to_arrow_schema(schema)
        if not points.num_rows or not centres.num_rows:
            return out.empty_table()
        lat, lon, lat2, lon2 = (t.column(c).to_numpy() for t, c in ((points, "_pa"), (points, "_po"), (centres, "_ca"), (centres, "_co")))

        def on_sphere(a: np.ndarray, o: np.ndarray) -> np.ndarray:
            a, o = np.radians(a), np.radians(o)
            return np.column_stack([np.cos(a) * np.cos(o), np.cos(a) * np.sin(o), np.sin(a)])

        def exact(c: np.ndarray, p: np.ndarray) -> np.ndarray:
            a, b = np.radians(lat[p]), np.radians(lat2[c])
            h = np.sin((b - a) / 2) ** 2 + np.cos(a) * np.cos(b) * np.sin(np.radians(lon2[c] - lon[p]) / 2) ** 2
            return 2 * RADIUS_KM * np.arcsin(np.sqrt(np.minimum(h, 1.0)))

        at_points, at_centres, edge = np.ascontiguousarray(on_sphere(lat, lon).T), on_sphere(lat2, lon2), math.cos(km / RADIUS_KM)
        columns = {c: points.column(f"_v_{c}") for c in of_points}
        known = {c: None if not x.null_count else x.is_valid().to_numpy() for c, x in columns.items()}
        values = {c: x.fill_null(0).to_numpy() for c, x in columns.items()}
        found, valid = ({n: [] for n in totals} for _ in range(2))
        for first in range(0, len(at_centres), step := max(1, AT_ONCE // len(lat))):
            cosine = at_centres[first : first + step] @ at_points
            inside, sure = cosine >= edge - SLACK, cosine >= edge + SLACK
            if np.count_nonzero(inside) != np.count_nonzero(sure):
                c, p = np.nonzero(inside != sure)
                inside[c, p] = exact(first + c, p) <= km
            some = inside.any(axis=1)
            for n, (kind, column) in totals.items():
                counts = inside if known.get(column) is None else inside & known[column]
                if kind == "count":
                    found[n].append(counts.sum(axis=1))
                elif column == name:
                    c, p = np.nonzero(cosine >= cosine.max(axis=1, keepdims=True) - SLACK)
                    nearest = np.full(len(cosine), np.inf)
                    np.minimum.at(nearest, c, exact(first + c, p))
                    found[n].append(nearest)
                else:
                    v = values[column]
                    worst, best = (np.iinfo(v.dtype).min, np.max) if kind == "max" else (np.iinfo(v.dtype).max, np.min)
                    found[n].append(best(np.where(counts, v, worst), axis=1))
                valid[n].append(np.ones(len(some), bool) if kind == "count" else counts.any(axis=1))
            valid.setdefault("", []).append(some)
        sums = [pa.array(np.concatenate(found[n]), mask=~np.concatenate(valid[n])).cast(out.field(n).type) for n in totals]
        near = np.concatenate(valid[""])
        return pa.Table.from_arrays([*(centres.column(c) for c in kept), *sums], schema=out).filter(pa.array(near))

    keys = ["_band", "_cell", "_i", "_j"]
    together = asked.drop("_row", "_pb", "_cb").groupBy(*keys).cogroup(asking.drop("_row", "_pb", "_cb").groupBy(*keys)).applyInArrow(add_up, schema)
    return apart.union(together)
