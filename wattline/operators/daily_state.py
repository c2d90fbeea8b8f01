"""A daily summary kept as a table of states that merge, refreshed by the days that new rows touch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattline.lineage import stage
from wattline.sinks import table_exists

STATE = "ba_code string, n bigint, total double, m2 double, low double, high double, refresh bigint, day date"
LOG = "refresh bigint, day date, n_rows bigint, counted boolean"


def partial(rows: DataFrame, c: str = "demand_mw") -> DataFrame:
    """States of each day and area: count, sum, sum of squares around the mean, smallest and largest."""
    return rows.groupBy("day", "ba_code").agg(
        F.count(c).alias("n"), F.sum(F.col(c).cast("double")).alias("total"), (F.var_pop(c) * F.count(c)).alias("m2"), F.min(F.col(c).cast("double")).alias("low"), F.max(F.col(c).cast("double")).alias("high"),
    )


def merged(states: DataFrame) -> DataFrame:
    """States of the same day and area made one; a few of each at most, as they come from refreshes."""
    one = states.groupBy("day", "ba_code").agg(
        F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("low").alias("low"), F.max("high").alias("high"), F.max("refresh").alias("refresh"),
        F.collect_list(F.struct("n", "total", "m2")).alias("_parts"),
    )
    around = F.expr("aggregate(filter(_parts, p -> p.n > 0), 0D, (s, p) -> s + p.m2 + p.n * pow(p.total / p.n - total / n, 2))")
    return one.withColumn("m2", F.when(F.col("n") > 0, around)).select("ba_code", "n", "total", "m2", "low", "high", "refresh", "day")


def states(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(STATE).parquet(f"{path}/states")


def log(spark: SparkSession, path: str) -> DataFrame:
    """What each refresh did: rows per day, and whether they counted or came too late."""
    return spark.read.schema(LOG).parquet(f"{path}/log")


def refresh(rows: DataFrame, path: str, number: int, reach: int = 3, time: str = "period", c: str = "demand_mw") -> None:
    """Merge new rows (period, ba_code, demand_mw) into the table; days further back than ``reach`` before the newest one known are closed.

    Only the days that the rows touch are read and written. Refreshes are numbered upwards; one that was broken off may be run again with the
    same rows: days it has written already carry its number and are left as they are, and one that is in the log does nothing.
    """
    spark, known = rows.sparkSession, None
    if table_exists(spark, f"{path}/log"):
        done = log(spark, path).agg(F.max("refresh"), F.max(F.when(F.col("counted"), F.col("day")))).first()
        if done[0] is not None and number <= done[0]:
            return
        known = done[1]
    dated = rows.withColumn("day", F.to_date(time)).where("day IS NOT NULL")
    open_ = F.lit(True) if known is None else F.col("day") >= F.date_sub(F.lit(known), reach)
    seen = stage(dated.withColumn("counted", open_).groupBy("day", "counted").agg(F.count("*").alias("n_rows")), "seen")
    days = [r.day for r in seen.where("counted").select("day").orderBy("day").collect()]  # one value a day
    if days:
        new = partial(dated.where(open_), c).withColumn("refresh", F.lit(number).cast("bigint"))
        if table_exists(spark, f"{path}/states"):
            old = states(spark, path).where(F.col("day").isin(days))
            applied = old.where(F.col("refresh") >= number).select("day").distinct()
            new = old.unionByName(new.join(applied, "day", "left_anti"))
        # read before the files it comes from are replaced
        ready = stage(merged(new), "states")
        ready.repartition("day").sortWithinPartitions("day", "ba_code").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(f"{path}/states")
    entries = seen.select(F.lit(number).cast("bigint").alias("refresh"), "day", "n_rows", "counted")
    (entries if days or not seen.isEmpty() else spark.createDataFrame([(number, None, 0, True)], LOG)).coalesce(1).write.mode("append").parquet(f"{path}/log")


def summary(spark: SparkSession, path: str) -> DataFrame:
    """The daily summary: day, ba_code, avg_demand, peak_demand, min_demand, stddev_demand."""
    s = states(spark, path)
    return s.select(
        F.col("day").cast("timestamp").alias("day"), "ba_code", F.when(F.col("n") > 0, F.col("total") / F.col("n")).alias("avg_demand"), F.col("high").alias("peak_demand"), F.col("low").alias("min_demand"),
        F.when(F.col("n") > 1, F.sqrt(F.col("m2") / (F.col("n") - 1))).alias("stddev_demand"),
    )
