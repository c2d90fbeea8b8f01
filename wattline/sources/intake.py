"""Reading of archived text files with bad lines set aside and files taken once.

Lines that don't parse go to a side table with their file and byte offset. A ledger holds the files of every batch before it is read and
counts of good and bad lines after it; a batch that was broken off is read again into the same folder, so a file counts once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattline.lineage import stage
from wattline.sinks import table_exists

LEDGER = "batch bigint, file string, status string, n_good bigint, n_bad bigint"
#: Files in a batch; Spark's driver holds their names while it lists them.
FILES = 10_000


def lines_of(spark: SparkSession, files: list[str]) -> DataFrame:
    """Lines with the byte at which they begin: file, at, line.

    A task counts the bytes of its lines; where a split of a file begins follows from the bytes of the splits before it, so large files are read in parallel.
    """
    raw = spark.read.option("lineSep", "\n").text(files).select(F.col("value").cast("binary").alias("line"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, at = None, 0
        for batch in batches:
            splits = list(zip(batch.column("file").to_pylist(), batch.column("split").to_pylist(), strict=True))
            begin = np.zeros(len(splits), np.int64)
            for i, (split, line) in enumerate(zip(splits, batch.column("line"), strict=True)):
                if split != now:
                    now, at = split, 0
                begin[i] = at
                at += len(line.as_buffer()) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(begin)], names=["line", "file", "split", "inside"])

    counted = stage(raw.mapInArrow(count, "line binary, file string, split bigint, inside bigint"), "lines")
    sizes = counted.groupBy("file", "split").agg(F.max(F.col("inside") + F.octet_length("line") + 1).alias("_n"))
    base = sizes.selectExpr("file", "split", "sum(_n) OVER (PARTITION BY file ORDER BY split) - _n AS _base")
    return counted.join(base, ["file", "split"]).select("file", (F.col("_base") + F.col("inside")).alias("at"), F.rtrim(F.col("line").cast("string"), F.lit("\r")).alias("line"))


def parsed(lines: DataFrame, schema: str, kind: str) -> DataFrame:
    """``row`` (the fields, NULL for a bad line) and ``bad`` of each line that isn't blank; the first line of a CSV file is its header."""
    names = [x.strip().split()[0] for x in schema.split(",")]
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    if kind == "csv":
        rows, value = lines.where("at > 0"), F.from_csv("line", schema + ", _bad string", options)
    else:
        rows, value = lines, F.from_json("line", schema + ", _bad string", options)
    rows = rows.where("trim(line) <> ''").withColumn("_row", value).withColumn("bad", F.col("_row").isNull() | F.col("_row._bad").isNotNull())
    return rows.select("file", "at", "line", "bad", F.when(~F.col("bad"), F.struct(*[F.col(f"_row.`{n}`").alias(n) for n in names])).alias("row"))


def ledger(spark: SparkSession, home: str) -> DataFrame:
    if not table_exists(spark, f"{home}/ledger"):
        return spark.createDataFrame([], LEDGER)
    return spark.read.schema(LEDGER).parquet(f"{home}/ledger")


def good(spark: SparkSession, home: str) -> DataFrame:
    return spark.read.parquet(f"{home}/good").drop("batch")


def bad(spark: SparkSession, home: str) -> DataFrame:
    """file, at (byte), line."""
    return spark.read.schema("file string, at bigint, line string, batch bigint").parquet(f"{home}/bad").drop("batch")


def intake(spark: SparkSession, path: str, home: str, schema: str, kind: str = "csv", files: int = FILES) -> None:
    """Read the files below ``path`` (csv with a header line, or json with an object per line) that weren't read before.

    ``home`` gets the tables good, bad and ledger. A line is bad if it has another number of fields than ``schema``, a value of another type,
    or no JSON object; it is kept as it is. A file that changed after it was read isn't read again.
    """
    while True:
        known = ledger(spark, home)
        per_file = known.groupBy("file").agg(F.max(F.col("status") == "completed").alias("done"), F.max("batch").alias("batch"))
        broken = per_file.where("NOT done").agg(F.min("batch")).first()[0]
        if broken is None:
            found = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"))
            fresh = [r.file for r in found.join(per_file, "file", "left_anti").orderBy("file").limit(files).collect()]
            if not fresh:
                return
            batch = (known.agg(F.max("batch")).first()[0] or 0) + 1
            started = spark.createDataFrame([(batch, f, "started", 0, 0) for f in fresh], LEDGER)
            started.coalesce(1).write.mode("append").parquet(f"{home}/ledger")
        else:
            batch = broken
            fresh = [r.file for r in known.where((F.col("batch") == batch) & (F.col("status") == "started")).select("file").distinct().collect()]
        rows = stage(parsed(lines_of(spark, fresh), schema, kind), "parsed")
        rows.where("NOT bad").select("row.*", F.col("file").alias("source_file")).write.mode("overwrite").parquet(f"{home}/good/batch={batch}")
        rows.where("bad").select("file", "at", "line").write.mode("overwrite").parquet(f"{home}/bad/batch={batch}")
        counts = rows.groupBy("file").agg(F.count_if(~F.col("bad")).alias("n_good"), F.count_if("bad").alias("n_bad"))
        every = spark.createDataFrame([(batch, f) for f in fresh], "batch bigint, file string").join(counts, "file", "left")
        done = every.select("batch", "file", F.lit("completed").alias("status"), F.coalesce("n_good", F.lit(0)).alias("n_good"), F.coalesce("n_bad", F.lit(0)).alias("n_bad"))
        done.coalesce(1).write.mode("append").parquet(f"{home}/ledger")
