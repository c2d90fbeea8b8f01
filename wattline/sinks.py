"""Writing tables and merging new rows into them.

Tables are Parquet folders partitioned by month. Merges are first built as DataFrames (``insert_ignore``,
``upsert_cols``); the ``write_*`` functions put results on storage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wattline.operators.features import keep_first
from wattline.operators.joins import anti_new


def with_month(df: DataFrame, time: str = "period") -> DataFrame:
    return df.withColumn("month", F.date_format(F.date_trunc("month", F.col(time)), "yyyy-MM"))


def write_append(df: DataFrame, path: str, time: str = "period", sort: list[str] | None = None) -> None:
    """Append rows to a month-partitioned table.

    Rows are spread by area and day, so a large area is written by many tasks, each sorted for compact
    columns and useful min/max statistics. Adaptive execution merges small shares.
    """
    sort = sort or [c for c in ("ba_code", time) if c in df.columns]
    dated = with_month(df, time)
    spread = dated.repartition("month", F.date_trunc("day", F.col(time)), *[c for c in sort if c != time][:1])
    spread.sortWithinPartitions("month", *sort).write.mode("append").partitionBy("month").parquet(path)


def insert_ignore(target: DataFrame, new: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """Target plus the new rows whose key it does not hold; existing rows never change."""
    return target.unionByName(fresh_rows(target, new, keys, order), allowMissingColumns=True)


def fresh_rows(target: DataFrame, new: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """New rows that an insert-ignore would add: one per key, first by ``order``."""
    rest = order or [c for c in new.columns if c not in keys]
    return anti_new(keep_first(new, keys, rest), target, keys)


#: Months of a batch that are named to the reader one by one; a batch with more of them reads the whole table.
NAMED_MONTHS = 240


def months_of(target: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of ``target`` in the months that occur in ``new``, as a filter that leaves other partitions unread."""
    named = [r[0] for r in new.select("month").distinct().limit(NAMED_MONTHS + 1).collect()]
    if len(named) > NAMED_MONTHS:
        return target
    wanted = F.col("month").isin([m for m in named if m is not None])
    return target.where(wanted | F.col("month").isNull() if None in named else wanted)


def upsert_cols(target: DataFrame, new: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """Insert new keys whole; on keys that exist refresh only ``cols``.

    A column matched by a NULL takes the NULL, as an upsert statement does.
    """
    marked_t = target.withColumn("_t", F.lit(True))
    renamed = new.select(*keys, F.lit(True).alias("_n"), *[F.col(c).alias(f"_new_{c}") for c in new.columns if c not in keys])
    joined = marked_t.join(renamed, keys, "full_outer")
    has_t, has_n = F.col("_t").isNotNull(), F.col("_n").isNotNull()

    def value(c: str) -> Column:
        if c not in new.columns:
            return F.col(c)
        fresh = F.col(f"_new_{c}")
        if c in cols:
            return F.when(has_n, fresh).otherwise(F.col(c)).alias(c)
        return F.when(has_t, F.col(c)).otherwise(fresh).alias(c)

    return joined.select(*keys, *[value(c) for c in target.columns if c not in keys])


def write_months(df: DataFrame, path: str, time: str = "period") -> None:
    """Replace exactly the months present in ``df`` and leave all others."""
    (
        with_month(df, time)
        .repartition("month", F.date_trunc("day", F.col(time)), *[c for c in ("ba_code",) if c in df.columns])
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("month")
        .parquet(path)
    )


def write_merge(spark: SparkSession, new: DataFrame, path: str, keys: list[str], time: str = "period") -> None:
    """Insert-ignore ``new`` into the table at ``path``; safe to run again with the same rows.

    Where the keys hold the time, only the months that occur in ``new`` are read from the target; else a
    key may sit in any month and all are. Rows without a time are one month of their own.
    """
    if not table_exists(spark, path):
        write_append(keep_first(new, keys, [c for c in new.columns if c not in keys]), path, time)
        return
    target = spark.read.parquet(path)
    if time in keys:
        target = months_of(target, with_month(new, time))
    write_append(fresh_rows(target.drop("month"), new, keys), path, time)


def write_bucketed(df: DataFrame, path: str, keys: list[str], buckets: int = 64) -> DataFrame:
    """Write a table dealt into buckets by ``keys`` and sorted by them, and read it back as such.

    Tables with the same keys and number of buckets join on these keys without moving a row. Each bucket is one file. With the time among the
    keys a large area is spread over all buckets.
    """
    spark, name = df.sparkSession, f"bucketed_{uuid.uuid4().hex}"
    df.repartition(buckets, *keys).write.format("parquet").option("path", path).bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(name)
    return spark.table(name)


def read_bucketed(spark: SparkSession, path: str, schema: str, keys: list[str], buckets: int = 64) -> DataFrame:
    """A table of ``write_bucketed`` in another session, with what it was dealt by."""
    name, by = f"bucketed_{uuid.uuid4().hex}", ", ".join(keys)
    spark.sql(f"CREATE TABLE {name} ({schema}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(name)


def table_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)


def pending(work: DataFrame, ledger: DataFrame) -> DataFrame:
    """Work items (table_name, work_key) whose latest ledger entry is not ``completed``."""
    latest = ledger.groupBy("table_name", "work_key").agg(F.max_by("status", "logged_at").alias("status"))
    done = latest.where(F.col("status") == "completed").select("table_name", "work_key")
    return work.join(done, ["table_name", "work_key"], "left_anti")


def write_ledger(spark: SparkSession, path: str, table: str, key: str, status: str) -> None:
    """Log the outcome of one work item."""
    row = spark.range(1).select(
        F.lit(table).alias("table_name"),
        F.lit(key).alias("work_key"),
        F.lit(status).alias("status"),
        F.current_timestamp().alias("logged_at"),
    )
    row.coalesce(1).write.mode("append").parquet(path)


def write_results(df: DataFrame, path: str) -> None:
    """Write a small metric table (rows per area or model) as one CSV file with a header."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def log_predictions(forecasts: DataFrame, made_at: Column, model: str) -> DataFrame:
    """Forecast rows in the form of the prediction log, with an empty actual and a sealed fingerprint."""
    from wattline.functions.hashing import audit_hash

    return forecasts.select(
        made_at.alias("predicted_at"),
        F.col("period").alias("target_period"),
        "ba_code",
        F.lit(model).alias("model_name"),
        F.col("q50").alias("predicted_demand"),
        F.lit(None).cast("double").alias("actual_demand"),
        F.col("q10").alias("confidence_lower"),
        F.col("q90").alias("confidence_upper"),
        F.lit(None).cast("double").alias("mape"),
        audit_hash(F.col("q50"), F.unix_timestamp("period"), F.lit(model)).alias("prediction_hash"),
    )

