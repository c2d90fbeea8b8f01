"""Jaccard join of documents on word shingles by T-occurrence search.

Each distinct shingle set is searched once. Its smallest shingle hashes are its query: all of a set of n up to SKETCH, else the first
n - ceil(3n/4) + ENOUGH, and SKETCH at least. The documents that have a hash form that hash's inverted list. Two sets that link share at least T of
these hashes: 3/7 of both sizes together where both queries are whole, and else ENOUGH, since of the first n - ceil(3n/4) hashes
of a set all may be missing in the other, but none of the shared ones beyond. The search for the documents that occur in T lists goes as in DivideSkip:

1. Every list proposes its first document to the others, and each document is verified against the proposal it shares most
   lists with, if it shares T with it. That costs one pair per document at most and joins many groups of near copies at once.
2. Lists whose documents are all joined by now are done. Of the others the short ones are merged, which counts the shared
   hashes of each pair not joined yet; pairs that can reach T with their long lists are verified.
3. The long lists are not merged: a document with fewer than T of them must show up in a short list with any partner. For documents
   with more, those that a long list has apart from its largest group are looked up, in blocks, in a
   local index whose long lists are only probed (by binary search) for the candidates that the short ones leave. A block verifies
   them itself and hands on only links that joined two groups.

Verification counts both whole sets. Nothing is capped: every pair that may link is either verified or already joined.

Steps whose shuffles would hold all hashes, pairs or texts at once go slice by slice, one after the other, and a table goes when its last slice
is read: where most documents have near copies, all hashes are in lists and all texts are compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattline.lineage import forget, stage
from wattline.llm import text
from wattline.llm.components import components
from wattline.llm.tables import ROW

#: Texts make large rows, so few of them go to a worker at once.
BATCH, ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", "1000"
WIDTH, SKETCH, ENOUGH, SHORT, BLOCK, BLOCK_BYTES = 5, 64, 26, 64, 2048, 1 << 22
#: So many bytes of hashes make a slice; beyond MOST slices they grow with the input, and with them what a step shuffles at once.
SLICE_BYTES, MOST = 1 << 26, 4
LEAST = (75, 100)


def shingle_sets(w: text.Words, width: int) -> list[np.ndarray]:
    """The distinct shingle hashes of each text, sorted; of a text with fewer words, one hash of all of them."""
    hashes = w.hashes()
    grams = text.runs(hashes, width)
    out = []
    for a, z in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
        if z - a >= width:
            out.append(np.unique(grams[a : z - width + 1]))
        elif z > a:
            out.append(text.mix(text.runs(hashes[a:z], z - a, "check") + np.uint64(z - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def query_size(n: np.ndarray, least: tuple[int, int]) -> np.ndarray:
    """How many of a set's smallest hashes are searched for, so that linked sets share ENOUGH of them (or all that they share)."""
    return np.where(n <= SKETCH, n, np.maximum(SKETCH, n + (-least[0] * n) // least[1] + ENOUGH).clip(max=n))


def described(texts: DataFrame, key: str, width: int, least: tuple[int, int] = LEAST) -> DataFrame:
    """One row per document: key, print, size of its set, a 128-bit hash of the set and the hashes searched for."""
    schema = T.StructType([
        T.StructField(key, texts.schema[key].dataType), T.StructField("_print", T.LongType()), T.StructField("n", T.LongType()),
        T.StructField("f1", T.LongType()), T.StructField("f2", T.LongType()), T.StructField("sketch", T.ArrayType(T.LongType())),
    ])

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        out = to_arrow_schema(schema)
        for rows, data, offsets in text.blocks(batches):
            sets = shingle_sets(text.Words(data, offsets, lower=True), width)
            size = np.array([len(s) for s in sets], np.int64)
            marks = np.array([[s.sum(dtype=np.uint64), np.bitwise_xor.reduce(text.mix(s)) if len(s) else 0] for s in sets], np.uint64).reshape(-1, 2)
            asked = query_size(size, least)
            small = [s[:k] for s, k in zip(sets, asked.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([
                rows.column(key).cast(out.field(0).type), rows.column("_print"), pa.array(size), pa.array(text.signed(text.mix(marks[:, 0] + size.astype(np.uint64)))), pa.array(text.signed(marks[:, 1].copy())),
                text.lists(text.signed(np.concatenate(small)) if small else np.zeros(0, np.int64), asked),
            ], schema=out)

    return texts.mapInArrow(describe, schema)


def together(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def dealt(row: str, into: int) -> str:
    """SQL: the slice of a row."""
    return f"CAST(pmod(xxhash64({row}, 11), {into}) AS INT)"


def verified(pairs: DataFrame, texts: DataFrame, width: int, least: tuple[int, int], parts: int = 1) -> DataFrame:
    """The pairs (a, b) whose whole sets link, written to the shared folder.

    ``texts`` are dealt into ``parts`` by row; the pairs between two parts are verified at a time, so that only those texts travel.
    """

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                raw = [open_(x) for c in ("text_a", "text_b") for x in part.column(c).to_pylist()]
                if not raw:
                    continue
                offsets = text.offsets_of(np.array([len(x) for x in raw]))
                sets = shingle_sets(text.Words(np.frombuffer(b"".join(raw), np.uint8), offsets, lower=True), width)
                n = part.num_rows
                links = [linked(one, two, least) for one, two in zip(sets[:n], sets[n:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b")], names=["a", "b"]).filter(pa.array(links))

    pairs, out = stage(pairs.select("a", "b"), "pairs"), []
    for i in range(parts):
        for j in range(parts):
            one = texts.where(f"part = {i}").selectExpr(f"{ROW} AS a", "text AS text_a")
            two = texts.where(f"part = {j}").selectExpr(f"{ROW} AS b", "text AS text_b")
            both = pairs.where(f"{dealt('a', parts)} = {i} AND {dealt('b', parts)} = {j}").join(one, "a").join(two, "b")
            out.append(stage(both.select("a", "b", "text_a", "text_b").mapInArrow(check, "a long, b long"), "verified"))
    forget(pairs)
    return together(out)


def may_link(x: str, y: str, least: tuple[int, int]) -> str:
    """SQL: sets of these sizes can link at all."""
    return f"{least[1]} * least({x}, {y}) >= {least[0]} * greatest({x}, {y})"


def must_share(x: str, y: str, least: tuple[int, int]) -> str:
    """SQL: T, the number of sketch hashes that linked sets of these sizes share."""
    whole = f"ceil({least[0]}D * ({x} + {y}) / {least[0] + least[1]} - 1e-9)"
    return f"CAST(CASE WHEN greatest({x}, {y}) <= {SKETCH} THEN {whole} ELSE least({ENOUGH}, {whole}) END AS INT)"


def linked(one: np.ndarray, two: np.ndarray, least: tuple[int, int]) -> bool:
    """Whether two sorted sets link: the smaller is looked up in the larger by binary search."""
    few, many = (one, two) if len(one) <= len(two) else (two, one)
    if not len(few):
        return False
    both = int((many[np.minimum(np.searchsorted(many, few), len(many) - 1)] == few).sum())
    return least[1] * both >= least[0] * (len(one) + len(two) - both)


def looked_up(asked: DataFrame, others: DataFrame, blocks: int, chunks: int, width: int, least: tuple[int, int], first: int, last: int) -> DataFrame:
    """Links (a, b) that join the groups of ``asked``, here its blocks from ``first`` to ``last``, to those of ``others`` (row, n, root, sketch, text).

    Both sides are dealt into blocks by hash, and each block of one side meets each of the other. A block verifies every pair
    that shares T sketch hashes and isn't joined by then, those that share most first, and hands on only the
    links that joined two groups: fewer than it has documents.
    """
    asked = asked.withColumn("i", F.expr(f"pmod(xxhash64({ROW}), {blocks})")).where(f"i BETWEEN {first} AND {last}")
    grid = asked.withColumns({"j": F.expr(f"explode(sequence(0L, {chunks - 1}L))"), "asks": F.lit(True)})
    rest = others.withColumns({"i": F.expr(f"explode(sequence({first}L, {last}L))"), "j": F.expr(f"pmod(xxhash64({ROW}, 7), {chunks})"), "asks": F.lit(False)})

    def search(table: pa.Table) -> pa.Table:
        asks = table.column("asks").to_numpy().astype(bool)
        row, n, root = (table.column(c).to_numpy() for c in (ROW, "n", "root"))
        sketches = table.column("sketch").combine_chunks()
        at, flat = sketches.offsets.to_numpy() - sketches.offsets[0].as_py(), sketches.flatten().to_numpy()
        sets: list[np.ndarray] = []
        open_, waiting, size = zstandard.ZstdDecompressor().decompress, [], 0
        packed = table.column("text").to_pylist()
        for k, x in enumerate(packed):
            waiting.append(open_(x))
            size += len(waiting[-1])
            if size >= 1 << 20 or k == len(packed) - 1:
                raw = np.frombuffer(b"".join(waiting), np.uint8)
                sets += shingle_sets(text.Words(raw, text.offsets_of(np.array([len(x) for x in waiting])), lower=True), width)
                waiting, size = [], 0
        queries, docs = np.flatnonzero(asks), np.flatnonzero(~asks)
        q_of = np.repeat(np.arange(len(queries)), np.diff(at)[queries])
        q_hash = np.concatenate([flat[at[q] : at[q + 1]] for q in queries]) if len(queries) else np.zeros(0, np.int64)
        order = np.argsort(q_hash, kind="stable")
        lists, ids = q_hash[order], q_of[order]
        label = root.copy()
        a, b, n_q = [], [], n[queries]
        for d in docs.tolist() if len(queries) else []:
            own = flat[at[d] : at[d + 1]]
            begin, end = np.searchsorted(lists, own, "left"), np.searchsorted(lists, own, "right")
            size = end - begin
            whole = np.ceil(least[0] * (n_q + n[d]) / (least[0] + least[1]) - 1e-9)
            need = np.where(np.maximum(n_q, n[d]) <= SKETCH, whole, np.minimum(ENOUGH, whole))
            # the longest lists, one fewer than any candidate needs, are only probed
            probe = np.sort(np.argsort(size, kind="stable")[::-1][: max(int(need.min()) - 1, 0)])
            hits = [ids[begin[k] : end[k]] for k in np.setdiff1d(np.arange(len(own)), probe) if size[k]]
            if not hits:
                continue
            seen = np.bincount(np.concatenate(hits), minlength=len(queries))
            ok = (seen > 0) & (seen + len(probe) >= need) & (label[queries] != label[d]) & (least[1] * np.minimum(n_q, n[d]) >= least[0] * np.maximum(n_q, n[d]))
            candidates = np.flatnonzero(ok)
            for k in probe:
                if not len(candidates):
                    break
                if size[k]:
                    of = ids[begin[k] : end[k]]
                    place = np.minimum(np.searchsorted(of, candidates), len(of) - 1)
                    seen[candidates] += of[place] == candidates
            candidates = candidates[seen[candidates] >= need[candidates]]
            candidates = queries[candidates[np.argsort(-seen[candidates], kind="stable")]]
            for q in candidates.tolist():
                if label[q] != label[d] and linked(sets[q], sets[d], least):
                    a.append(int(row[q])), b.append(int(row[d]))
                    label[label == label[q]] = label[d]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return grid.unionByName(rest).groupBy("i", "j").applyInArrow(search, "a long, b long")


def classes(docs: DataFrame, key: str = "doc_id", column: str = "text", width: int = WIDTH, least: tuple[int, int] = LEAST) -> DataFrame:
    """Every document with its set's size and group: key, text_hash, n_shingles, group, component_id.

    Words are compared with A-Z in lower case. Two documents link when ``least[1]`` times their shared shingles are ``least[0]`` times
    all of both, or more; a group is what links join, directly or not, and ``component_id`` its smallest key (null if all
    are null). Documents without words link with nothing, not even each other. Every row stays, also with a null or
    repeated key. Other columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    before = spark.conf.get(BATCH)
    spark.conf.set(BATCH, ROWS)
    try:
        return _classes(docs, key, column, width, least)
    finally:
        spark.conf.set(BATCH, before)


def _classes(docs: DataFrame, key: str, column: str, width: int, least: tuple[int, int]) -> DataFrame:
    texts = text.keyed(docs, key, column).withColumn("_print", F.xxhash64("text"))
    # what no later step reads is deleted at once; hashes searched for are kept once, and only of distinct sets
    whole = stage(described(texts, key, width, least).withColumn(ROW, F.monotonically_increasing_id()), "described")
    kinds = stage(whole.where("n > 0").groupBy("f1", "f2").agg(F.min(ROW).alias(ROW)), "sets")
    sets = stage(whole.select(ROW, "n", "sketch").join(kinds.select(ROW), ROW), "sketches")
    all_ = stage(whole.drop("sketch"), "documents")
    forget(whole)

    hashes = (sets.agg(F.sum(F.size("sketch"))).first()[0] or 0) * 8
    slices = min(MOST, max(1, -(-hashes // SLICE_BYTES)))
    parts, room = -(-slices // 2), max(2 * SLICE_BYTES, hashes // 2)

    lists, posts = sets.select(ROW, "n", F.explode("sketch").alias("hash")), []
    for k in range(slices):
        own = lists.where(f"pmod(hash, {slices}) = {k}")
        known = stage(own.groupBy("hash").agg(F.count("*").alias("df"), F.min(ROW).alias("first")).where("df > 1"), "lists")
        posts.append(stage(own.join(known, "hash"), "postings"))
        forget(known)

    sizes = sets.select(F.col(ROW).alias("first"), F.col("n").alias("n_first"))
    offers = together(posts).where(f"{ROW} <> first").groupBy(ROW, "n", "first").agg(F.count("*").alias("shared"))
    # fewer shared lists mean a common passage at most; step 2 looks at such pairs again
    offers = offers.join(sizes, "first").where(may_link("n", "n_first", least)).where(f"shared >= {must_share('n', 'n_first', least)}")
    best = offers.groupBy(ROW).agg(F.max(F.struct("shared", (-F.col("first")).alias("first"))).alias("x"))
    best = stage(best.select((-F.col("x.first")).alias("a"), F.col(ROW).alias("b")), "offers")

    @F.pandas_udf("binary")
    def squeeze(raw):
        pack = zstandard.ZstdCompressor(level=3).compress
        return raw.map(lambda x: pack(x or b""))

    # joined and told apart by the same two columns, so that texts travel once
    ident = [F.xxhash64(key).alias("_id"), F.col("_print")]
    wanted = stage(all_.select(*ident, ROW).join(together(posts).select(ROW).distinct(), ROW), "wanted")
    bodies = texts.select(*ident, squeeze("text").alias("text")).join(wanted, ["_id", "_print"]).dropDuplicates(["_id", "_print"])
    bodies = bodies.select(ROW, "text", F.expr(dealt(ROW, parts)).alias("part"))
    bodies = stage(bodies, "texts", "part")
    forget(wanted)

    links = verified(best, bodies, width, least, parts)
    forget(best)

    def rooted(df: DataFrame) -> DataFrame:
        tree = components(links).select(F.col("node").alias("_at"), F.col("root").alias("root"))
        return df.join(tree, F.col(ROW) == F.col("_at"), "left").withColumn("root", F.coalesce("root", ROW)).drop("_at")

    # 2: short lists with documents from different groups
    long_lists = together(posts).where(f"df > {SHORT}").groupBy(ROW).agg(F.count("*").alias("long"))
    nodes = stage(rooted(sets.select(ROW).join(long_lists, ROW, "left")).select(ROW, "root", F.coalesce("long", F.lit(0)).alias("long")), "rooted")
    marked = []
    for own in posts:
        every = stage(own.select("hash", ROW, "n", "df").join(nodes, ROW), "postings")
        forget(own)
        active = every.groupBy("hash").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("hash")
        marked.append(stage(every.join(active, "hash"), "active"))
        forget(every)
    forget(nodes)
    short = together(marked).where(f"df <= {SHORT}").select("hash", ROW, "n", "root", "long", "df")
    # a list of n rows makes n (n - 1) / 2 pairs, of some 32 bytes each
    many = int((short.agg(F.sum((F.col("df") - 1) / 2)).first()[0] or 0) * 32 // room) + 1
    other, candidates = short.select("hash", *[F.col(c).alias(f"{c}2") for c in (ROW, "n", "root", "long")]), []
    for k in range(many):
        pairs = short.where(f"{dealt(ROW, many)} = {k}").join(other, "hash").where(f"{ROW} < {ROW}2 AND root <> root2 AND {may_link('n', 'n2', least)}")
        pairs = pairs.groupBy(ROW, f"{ROW}2", "n", "n2").agg(F.count("*").alias("shared"), F.first("long").alias("long"), F.first("long2").alias("long2"))
        pairs = pairs.where(f"shared + least(long, long2) >= {must_share('n', 'n2', least)}")
        candidates.append(stage(pairs.select(F.col(ROW).alias("a"), F.col(f"{ROW}2").alias("b")), "candidates"))
    links = stage(links.union(verified(together(candidates), bodies, width, least, parts)), "linked")
    forget(*candidates)

    # 3: documents that long lists alone could join, in blocks
    heavy = together(marked).where(f"long >= least({ENOUGH}, ceil({least[0]}D * n / {least[1]})) AND df > {SHORT}").select("hash", ROW, "n")
    if not heavy.isEmpty():
        now = stage(rooted(heavy), "heavy")
        groups = now.groupBy("hash", "root").agg(F.count("*").alias("size"))
        largest = groups.groupBy("hash").agg(F.max(F.struct("size", "root")).alias("x"), F.count("*").alias("kinds")).where("kinds > 1").select("hash", F.col("x.root").alias("top"))
        apart = now.join(stage(largest, "largest"), "hash")
        asked = stage(apart.where("root <> top").select(ROW).distinct(), "asked")
        apart, others = stage(apart.select(ROW, "root").distinct(), "apart"), []
        for k in range(parts):
            own = [df.where(f"{dealt(ROW, parts)} = {k}") for df in (apart, sets)]
            own = own[0].join(own[1], ROW).join(bodies.where(f"part = {k}"), ROW).select(ROW, "n", "root", "sketch", "text")
            others.append(stage(own, "others"))
        found, others = others, together(others)
        asks = stage(others.join(asked, ROW), "asks")
        size = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum(F.length("text")) / BLOCK_BYTES)).cast("int")
        blocks, chunks = asks.agg(size).first()[0], others.agg(size).first()[0]
        # every block of those that ask meets all others, so few blocks go at once where the others are many
        each = max(1, room // (others.agg(F.sum(F.length("text") + 8 * F.size("sketch"))).first()[0] or 1))
        for first in range(0, blocks or 0, each):
            links = stage(links.union(looked_up(asks, others, blocks, chunks, width, least, first, min(blocks, first + each) - 1)), "linked")
        forget(now, apart, asks, *found)
    forget(*marked, sets, bodies)

    groups = all_.join(kinds.select("f1", "f2", F.col(ROW).alias("_set")), ["f1", "f2"], "left").withColumn("_set", F.when(F.col("n") > 0, F.col("_set")).otherwise(F.col(ROW)))
    tree = components(links).select(F.col("node").alias("_at"), "root")
    groups = stage(groups.join(tree, F.col("_set") == F.col("_at"), "left").select(key, F.col("_print").alias("text_hash"), F.col("n").alias("n_shingles"), F.coalesce("root", "_set").alias("group")), "groups")
    forget(all_, kinds)
    smallest = groups.groupBy("group").agg(F.min(key).alias("component_id"))
    return groups.join(smallest, "group").select(key, "text_hash", "n_shingles", "group", "component_id")


def one_each(docs: DataFrame, key: str = "doc_id", column: str = "text", **more) -> DataFrame:
    """One document of each group, with all its columns: that with the smallest key, then the smallest text hash.

    Rows that repeat both key and text leave one row; documents without words all stay.
    """
    found = classes(docs, key, column, **more)
    groups = found.where("n_shingles > 0").groupBy("group").agg(F.min(F.struct(F.col(key).isNull().alias("last"), F.col(key).alias("k"), F.col("text_hash").alias("p"))).alias("x"))
    # joined and told apart by the same two columns, so that documents travel once
    keep = stage(groups.select(F.xxhash64("x.k").alias("_id"), F.col("x.p").alias("_print")), "kept")
    blank = ~F.coalesce(F.col(f"`{column}`"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    marked = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), F.xxhash64(f"`{key}`").alias("_id"), F.xxhash64(F.col(f"`{column}`").cast("binary")).alias("_print"), blank.alias("_blank"))
    chosen = marked.where("NOT _blank").join(keep, ["_id", "_print"])
    return chosen.dropDuplicates(["_id", "_print"]).select("_doc.*").union(marked.where("_blank").select("_doc.*"))
