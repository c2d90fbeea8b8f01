"""Benchmark items inside documents: size-partitioned MinHash containment search, then exact containment.

Items are grouped by the number of their shingles, each group up to twice as large as the one before. An item's sketch
is its k smallest shingle hashes under one random order, with k set by its group: one more than the largest
item of the group may miss. A document that holds enough of the item's shingles then holds at least k less
the number it may miss of the sketch, so no item is lost, however long the document is. Candidates
are verified by counting the item's shingles in the document. An item with fewer words than a shingle is one shingle of all of them, and is looked
up among the documents' runs of that many words. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattline.lineage import stage

WIDTH, LEAST = 5, 0.75
WORD = r"[^\x20\x09-\x0D]+"


def words(column: str) -> Column:
    return F.regexp_extract_all(F.lower(F.col(column)), F.lit(WORD), F.lit(0))


def shingles(column: str, width: int, hashed: bool) -> Column:
    """Every run of ``width`` words of an array, as hashes or strings; of fewer words, the whole array as one."""
    run = ", ".join(f"{column}[i + {k}]" for k in range(width))
    one = f"xxhash64({run})" if hashed else f"concat_ws(' ', {run})"
    few = f"xxhash64(array_join({column}, ' '))" if hashed else f"array_join({column}, ' ')"
    return F.expr(f"CASE WHEN size({column}) >= {width} THEN transform(sequence(0, size({column}) - {width}), i -> {one}) WHEN size({column}) > 0 THEN array({few}) END")


def runs(column: str, width: int, short: list[int], hashed: bool) -> Column:
    """The shingles of an array of words, and all its runs of each of the ``short`` lengths."""
    out = [shingles(column, width, hashed)]
    for m in short:
        run = f"array_join(slice({column}, i + 1, {m}), ' ')"
        out.append(F.expr(f"CASE WHEN size({column}) >= {m} THEN transform(sequence(0, size({column}) - {m}), i -> {f'xxhash64({run})' if hashed else run}) END"))
    return F.flatten(F.array_compact(F.array(*out))) if short else out[0]


def contained(docs: DataFrame, items: DataFrame, least: float = LEAST, width: int = WIDTH, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """Pairs of a document and an item of which it holds the share ``least`` or more: key, text_hash, item, n_shared, n_item, containment.

    The share is of the item's distinct shingles of ``width`` words, in lower case. An item with fewer words
    is one shingle of all of them, found wherever a document has these words in a row. Null, empty and
    blank texts hold nothing and are in nothing. ``text_hash`` (xxhash64) parts documents that share a key or have none;
    rows alike in both, and items alike in id and text, count once. Other columns are ignored.
    """
    if item == key:
        raise ValueError("key and item need different names")
    texts = docs.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").alias("_text")).where("_text IS NOT NULL")
    texts = texts.withColumn("_print", F.xxhash64("_text"))
    tests = items.select(F.col(f"`{item}`").alias("_item"), F.col(f"`{item_text}`").alias("_t")).where("_t IS NOT NULL").distinct()
    tests = tests.select("_item", F.xxhash64("_t").alias("_of"), words("_t").alias("_words")).where(F.size("_words") > 0)
    tests = tests.withColumn("_strings", F.array_distinct(shingles("_words", width, False))).withColumn("_n", F.size("_strings"))
    tests = stage(tests.withColumn("_hashes", F.array_distinct(shingles("_words", width, True))).withColumn("_m", F.size("_words")).drop("_words"), "items")
    short = sorted(r[0] for r in tests.where(F.col("_m") < width).select("_m").distinct().collect())  # numbers below width

    # the largest of a size group has 2 * 2 ** floor(log2(n)) - 1 shingles; the smallest hashes in a random order are the sketch
    may_miss = F.expr(f"_n - CAST(ceil({least} * _n - 1e-9) AS INT)")
    of_group = F.expr("CAST(2 * pow(2, floor(log2(_n))) - 1 AS INT)")
    k = F.least(F.col("_n"), (of_group - F.ceil(F.lit(least) * of_group - 1e-9) + 1).cast("int"))
    order = F.expr("array_sort(transform(_hashes, h -> struct(xxhash64(h, 17) AS o, h AS h)))")
    sketch = tests.withColumn("_k", k).withColumn("_need", F.col("_k") - may_miss).withColumn("_order", order)
    sketch = sketch.select("_item", "_of", "_need", F.explode(F.expr("transform(slice(_order, 1, _k), x -> x.h)")).alias("_h"))
    sketch = stage(sketch, "sketch")
    seen = texts.select("_key", "_print", words("_text").alias("_words"))
    seen = seen.select("_key", "_print", F.explode(runs("_words", width, short, True)).alias("_h"))
    hits = seen.join(sketch, "_h").groupBy("_key", "_print", "_item", "_of", "_h").agg(F.first("_need").alias("_need"))
    near = hits.groupBy("_key", "_print", "_item", "_of").agg(F.count("*").alias("_hits"), F.first("_need").alias("_need")).where("_hits >= _need")
    near = stage(near.select("_key", "_print", "_item", "_of"), "near")

    wanted = near.select("_key", "_print").distinct().withColumnsRenamed({"_key": "_k", "_print": "_p"})
    full = texts.join(wanted, F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_print") == F.col("_p")), "left_semi").dropDuplicates(["_key", "_print"])
    full = full.select("_key", "_print", words("_text").alias("_words")).select("_key", "_print", F.explode(F.array_distinct(runs("_words", width, short, False))).alias("_s"))
    shared = full.join(tests.select("_item", "_of", "_n", F.explode("_strings").alias("_s")), "_s")
    pairs = near.withColumnsRenamed({"_key": "_k", "_print": "_p", "_item": "_i", "_of": "_o"})
    shared = shared.groupBy("_key", "_print", "_item", "_of", "_n").agg(F.count("*").alias("n_shared"))
    same = F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_print") == F.col("_p")) & F.col("_item").eqNullSafe(F.col("_i")) & (F.col("_of") == F.col("_o"))
    shared = shared.join(pairs, same, "left_semi").where(f"n_shared >= {least} * _n - 1e-9")
    return shared.select(F.col("_key").alias(key), F.col("_print").alias("text_hash"), F.col("_item").alias(item), "n_shared", F.col("_n").cast("long").alias("n_item"), (F.col("n_shared") / F.col("_n")).alias("containment"))


def clean(docs: DataFrame, items: DataFrame, least: float = LEAST, key: str = "doc_id", text: str = "text", **more) -> DataFrame:
    """The documents that hold no item: all their rows and columns, also those without a text."""
    bad = stage(contained(docs, items, least, key=key, text=text, **more).select(F.col(key).alias("_k"), F.col("text_hash").alias("_p")).distinct(), "contaminated")
    return docs.join(bad, docs[f"`{key}`"].eqNullSafe(bad["_k"]) & (F.xxhash64(docs[f"`{text}`"]) == bad["_p"]), "left_anti")
