"""Intermediate tables and block counts of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattline.lineage import stage

ROW = "_row"


def numbered(df: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder with a unique number in each row, which stays as written."""
    return stage(df.withColumn(ROW, F.monotonically_increasing_id()), name)


def ranked(df: DataFrame, key: str, rows: int, block: int = 20_000) -> tuple[DataFrame, DataFrame]:
    """``rank``, from 0 without gaps, of each row among those of its key, and the count of each key.

    Rows are counted by key and block of about ``block`` rows; a block's ranks begin where the blocks before it
    end. So no task orders more than a block, however many rows share a key. Needs the column of ``numbered``.
    """
    blocks = max(1, -(-rows // block))
    df = df.withColumn("_block", F.pmod(F.xxhash64(ROW), F.lit(blocks)))
    counts = stage(df.groupBy(key, "_block").agg(F.count("*").alias("_n")), "counts")
    before = counts.selectExpr(key, "_block", f"sum(_n) OVER (PARTITION BY {key} ORDER BY _block) - _n AS _before")
    inside = df.withColumn("_at", F.expr(f"row_number() OVER (PARTITION BY _block, {key} ORDER BY {ROW}) - 1"))
    out = inside.join(before, [key, "_block"]).withColumn("rank", F.col("_before") + F.col("_at"))
    return out.drop("_block", "_before", "_at"), counts.groupBy(key).agg(F.sum("_n").alias("n"))
