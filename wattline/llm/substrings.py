"""Repeated runs of words, found with suffix trees over groups of suffixes.

A window is a run of ``window`` words; it repeats if the same words also start anywhere else. Its anchor is the run of
``PREFIX`` words inside it with the smallest hash, the leftmost of them, so equal windows have equal anchors in the same
place. Suffixes (the places where windows start) are split into groups by their anchor, the variable-length prefix at
which their group is small enough: consecutive suffixes with one anchor travel together as one segment, and an anchor
that only one place in the corpus has is left out before any text moves. Each group's suffix tree is built
level by level, the depth doubling each time and suffixes that have become unique dropped out (prefix doubling). Its internal nodes of
depth ``window`` are the repeated windows; windows that follow each other join to maximal repeats. A group too large
for memory gets longer prefixes instead, whole segments and then whole windows, whose nodes Spark counts.

Documents with the same words as another are found first by a 128-bit hash and take part in the search once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattline.lineage import stage
from wattline.llm import text
from wattline.llm.tables import ROW

WINDOW, PREFIX = 35, 12
LARGE, AT_ONCE = 2_000, 1 << 18


def segments(w: text.Words, hashes: np.ndarray, window: int, prefix: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: text number, first window, number of windows, anchor place, anchor hash.

    Places are word numbers in the block.
    """
    n, reach = len(hashes), window - prefix + 1
    if n < window:
        return tuple(np.zeros(0, np.int64) for _ in range(4)) + (np.zeros(0, np.uint64),)
    grams = text.runs(hashes, prefix)
    best = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    have = 1
    while have * 2 <= reach:
        best = np.minimum(best[:-have], best[have:])
        have *= 2
    if have < reach:
        best = np.minimum(best[: len(best) - (reach - have)], best[reach - have :])
    anchor = (best & np.uint64(0xFFFFFFFF)).astype(np.int64)
    doc = np.repeat(np.arange(len(w.first) - 1), np.diff(w.first))
    valid = np.flatnonzero(np.arange(len(anchor)) + window <= w.first[1:][doc[: len(anchor)]])
    if not len(valid):
        return tuple(np.zeros(0, np.int64) for _ in range(4)) + (np.zeros(0, np.uint64),)
    anchor, doc = anchor[valid], doc[valid]
    new = np.ones(len(valid), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    return doc[at], valid[at], np.diff(np.append(at, len(valid))), anchor[at], grams[anchor[at]]


def described(texts: DataFrame, key: str, window: int, prefix: int) -> DataFrame:
    """One row per document: key, print, 128-bit hash of its words, their number, their digest, and its anchors."""
    kind = texts.schema[key].dataType
    from pyspark.sql import types as T

    schema = T.StructType([
        T.StructField(key, kind), T.StructField("_print", T.LongType()), T.StructField("c1", T.LongType()), T.StructField("c2", T.LongType()), T.StructField("n_words", T.LongType()),
        T.StructField("whole_sha256", T.StringType()), T.StructField("anchors", T.ArrayType(T.LongType())), T.StructField("places", T.ArrayType(T.IntegerType())),
    ])

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        out = to_arrow_schema(schema)
        for rows, data, offsets in text.blocks(batches):
            w = text.Words(data, offsets)
            doc, _, _, at, anchor = segments(w, w.hashes(), window, prefix)
            raw = data.tobytes()
            digests = [hashlib.sha256(b" ".join(raw[a:z].split())).digest() for a, z in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            halves = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 4)
            per = np.bincount(doc, minlength=rows.num_rows)
            yield pa.RecordBatch.from_arrays([
                rows.column(key).cast(out.field(0).type), rows.column("_print"), pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy()), pa.array(np.diff(w.first).astype(np.int64)),
                pa.array([d.hex() for d in digests]), text.lists(text.signed(anchor), per), text.lists((at - w.first[doc]).astype(np.int32), per),
            ], schema=out)

    return texts.mapInArrow(describe, schema)


def carved(chosen: DataFrame, window: int, prefix: int) -> DataFrame:
    """Segments of the documents' anchors that other places share, and the documents' texts, in one table.

    ``count`` > 0 without ``windows``: that many windows from ``first`` on under anchor ``prefix``, with their words. With
    ``windows``: the same of a large group, known by the 128-bit hash (``prefix``, ``mark``) of its words and those of its windows
    (two numbers each). ``count`` < 0: the whole text, compressed.
    """

    def carve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for rows, data, offsets in text.blocks(batches):
            w = text.Words(data, offsets)
            hashes = w.hashes()
            doc, first, count, at, anchor = segments(w, hashes, window, prefix)
            key = doc << 32 | (at - w.first[doc])
            places = rows.column("places")
            own = np.repeat(np.arange(rows.num_rows), np.diff(places.offsets.to_numpy())) << 32 | places.flatten().to_numpy()
            large = own[rows.column("large").flatten().to_numpy(zero_copy_only=False).astype(bool)]
            kept = np.isin(key, own)
            doc, first, count, anchor, big = doc[kept], first[kept], count[kept], anchor[kept], np.isin(key[kept], large)
            raw, row = data.tobytes(), rows.column(ROW).to_numpy()
            groups, r, f, c, words, mark, windows = [], [], [], [], [], [], []
            for i in np.flatnonzero(~big).tolist():
                a, n = int(first[i]), int(count[i])
                groups.append(int(anchor[i].view(np.int64))), r.append(int(row[doc[i]])), f.append(a - int(w.first[doc[i]])), c.append(n)
                words.append(raw[w.starts[a] : w.ends[a + n + window - 2]])
            if big.any():
                pairs = np.column_stack([text.runs(hashes, window), text.runs(hashes, window, "check")]).view(np.int64)
                for i in np.flatnonzero(big).tolist():
                    a, n = int(first[i]), int(count[i])
                    one, two = np.frombuffer(hashlib.blake2b(hashes[a : a + n + window - 1].tobytes(), digest_size=16).digest(), "<i8").tolist()
                    groups.append(one), r.append(int(row[doc[i]])), f.append(a - int(w.first[doc[i]])), c.append(n), words.append(b"")
                    mark.append((len(groups) - 1, two)), windows.append((len(groups) - 1, pairs[a : a + n].ravel()))
            for i in range(rows.num_rows):
                groups.append(0), r.append(int(row[i])), f.append(0), c.append(-1), words.append(squeeze(raw[offsets[i] : offsets[i + 1]]))
            marks, held = dict(mark), dict(windows)
            yield pa.RecordBatch.from_arrays([
                pa.array(groups, pa.int64()), pa.array(r, pa.int64()), pa.array(f, pa.int32()), pa.array(c, pa.int32()), pa.array(words, pa.binary()),
                pa.array([marks.get(i) for i in range(len(groups))], pa.int64()), pa.array([held.get(i) for i in range(len(groups))], pa.list_(pa.int64())),
            ], names=["prefix", ROW, "first", "count", "words", "mark", "windows"])

    return chosen.mapInArrow(carve, f"prefix long, {ROW} long, first int, count int, words binary, mark long, windows array<long>")


def counted(parts: DataFrame, window: int) -> DataFrame:
    """As ``trees``, for the large groups: row, start, end.

    Segments alike in all words are found first, by one row per task and content. If there are several, every window in
    them repeats. Of each content one goes on to the count of windows, by which those of single segments are judged.
    """
    place = F.struct(ROW, "first")
    kinds = parts.groupBy("prefix", "mark").agg(F.min(place).alias("a"), F.max(place).alias("z"), F.first("count").alias("count"), F.first("windows").alias("windows"))
    kinds = stage(kinds.withColumn("alike", F.expr("a <> z")), "contents")
    alike = kinds.where("alike").select("prefix", "mark")
    whole = parts.join(alike, ["prefix", "mark"]).select(ROW, F.col("first").cast("long").alias("start"), (F.col("first") + F.col("count") + window - 1).cast("long").alias("end"))
    each = kinds.select("a", "alike", F.expr("explode(transform(sequence(0, count - 1), i -> struct(i, windows[2 * i] AS one, windows[2 * i + 1] AS two))) AS w"))
    each = each.select(f"a.{ROW}", (F.col("a.first") + F.col("w.i")).cast("long").alias("start"), "alike", "w.one", "w.two")
    many = stage(each.groupBy("one", "two").agg(F.count("*").alias("n")).where("n > 1").select("one", "two"), "windows")
    single = each.where("NOT alike").join(many, ["one", "two"]).select(ROW, "start", (F.col("start") + window).alias("end"))
    return whole.union(single)


def deep_nodes(group: np.ndarray, symbols: np.ndarray, begins: np.ndarray, ends: np.ndarray, counts: np.ndarray, window: int) -> np.ndarray:
    """Places of the suffixes below an internal node of depth ``window`` in their group's suffix tree.

    ``symbols`` are word hashes, segment by segment; a suffix starts at each of a segment's first ``counts`` words. Level by level
    a suffix is named by its two halves; after each level only suffixes with a namesake in their group go on.
    """
    alive = np.repeat(begins - offsets_before(counts), counts) + np.arange(counts.sum())
    owner = np.repeat(np.arange(len(begins)), counts)
    _, name = np.unique(symbols, return_inverse=True)
    name = name.astype(np.int64)
    depth = 1
    while len(alive):
        step = min(depth, window - depth)
        left, right = name[alive], name[alive + step] if step else np.zeros(len(alive), np.int64)
        keys = np.stack([group[owner], left, right])
        order = np.lexsort(keys[::-1])
        sorted_ = keys[:, order]
        new = np.ones(len(order), bool)
        new[1:] = (sorted_[:, 1:] != sorted_[:, :-1]).any(axis=0)
        size = np.diff(np.append(np.flatnonzero(new), len(order)))
        node = np.empty(len(order), np.int64)
        node[order] = np.cumsum(new) - 1
        stays = size[node] > 1
        alive, owner = alive[stays], owner[stays]
        if not step:
            break
        # names of the next depth for every place, not only where suffixes start, since they are right halves later
        place = np.arange(len(name) - step)
        pair = name[place] * (int(name.max()) + 1) + name[place + step]
        _, named = np.unique(pair, return_inverse=True)
        longer = np.empty(len(name), np.int64)
        longer[place], longer[len(place) :] = named, np.arange(len(named), len(named) + step)
        name, depth = longer, depth + step
    return alive


def offsets_before(counts: np.ndarray) -> np.ndarray:
    return np.cumsum(counts) - counts


def trees(parts: DataFrame, window: int) -> DataFrame:
    """Words of each document that a repeated window covers, from the segments of each group: row, start, end."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def solve(table: pa.Table) -> pa.RecordBatch | None:
            prefix, row, first, count = (table.column(c).to_numpy() for c in ("prefix", ROW, "first", "count"))
            _, only = np.unique(np.stack([prefix, row, first.astype(np.int64)]), axis=1, return_index=True)  # repeated rows count once
            prefix, row, first, count = prefix[only], row[only], first[only], count[only]
            raw = table.column("words").combine_chunks().take(pa.array(only)).cast(pa.large_binary())
            offsets = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
            w = text.Words(np.frombuffer(raw.buffers()[2], np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0])
            deep = deep_nodes(np.unique(prefix, return_inverse=True)[1], w.hashes(), w.first[:-1], w.first[1:], count.astype(np.int64), window)
            if not len(deep):
                return None
            of = np.searchsorted(w.first, deep, "right") - 1
            place = first[of] + deep - w.first[of]
            order = np.lexsort([place, row[of]])
            of, place = of[order], place[order]
            new = np.ones(len(of), bool)
            new[1:] = (row[of][1:] != row[of][:-1]) | (place[1:] > place[:-1] + 1)
            last = np.append(np.flatnonzero(new)[1:], len(of)) - 1
            return pa.RecordBatch.from_arrays([pa.array(row[of][new]), pa.array(place[new].astype(np.int64)), pa.array(place[last].astype(np.int64) + window)], names=[ROW, "start", "end"])

        for batch in batches:
            held.append(batch)
            size += int(batch.column("count").to_numpy().sum()) + batch.num_rows * window
            if size < AT_ONCE:
                continue
            table = pa.Table.from_batches(held)
            prefix = table.column("prefix").to_numpy()
            cut = int(np.searchsorted(prefix, prefix[-1]))  # the last group may go on
            if cut:
                if (found := solve(table.slice(0, cut))) is not None:
                    yield found
                rest = table.slice(cut).combine_chunks()
                held = rest.to_batches()
                size = int(rest.column("count").to_numpy().sum()) + rest.num_rows * window
        if held and sum(b.num_rows for b in held) and (found := solve(pa.Table.from_batches(held))) is not None:
            yield found

    return parts.mapInArrow(build, f"{ROW} long, start long, end long")


def repeats(docs: DataFrame, key: str = "doc_id", column: str = "text", window: int = WINDOW, prefix: int = PREFIX) -> DataFrame:
    """Every document with the words that repeated windows cover and the digest of the others.

    Columns: key, n_words, n_removed, kept_sha256 (of the kept words, joined by one space), spans (start and end word of each
    maximal run of removed words, in order). Words are kept as they are; windows are judged on the input, in the same
    document too. Null and blank texts have no words. Every row stays, also with a null or repeated key; rows that repeat
    count as documents of their own. Other columns are ignored; an empty table gives an empty result.
    """
    texts = text.keyed(docs, key, column).withColumn("_print", F.xxhash64("text"))
    all_ = stage(described(texts, key, window, prefix).withColumn(ROW, F.monotonically_increasing_id()), "documents")
    kinds = stage(all_.groupBy("c1", "c2").agg(F.min(ROW).alias(ROW), F.count("*").alias("copies")), "contents")

    places = all_.select(ROW, F.explode(F.arrays_zip("anchors", "places")).alias("x"), "c1", "c2").select(F.col("x.anchors").alias("anchor"), ROW, F.col("x.places").alias("place"), F.xxhash64("c1", "c2", "x.places").alias("spot"))
    shared = places.groupBy("anchor").agg(F.min("spot").alias("a"), F.max("spot").alias("z"), F.count("*").alias("n")).where("a <> z")
    shared = stage(shared.select("anchor", (F.col("n") > LARGE).alias("large")), "anchors")
    chosen = places.select("anchor", ROW, "place").join(shared, "anchor").groupBy(ROW).agg(F.collect_list(F.struct("place", "large")).alias("x"))
    chosen = stage(chosen.join(kinds.select(ROW), ROW).select(ROW, F.col("x.place").alias("places"), F.col("x.large").alias("large")), "chosen")
    ids = stage(all_.select(key, "_print", ROW).join(chosen, ROW).withColumnsRenamed({key: "_k", "_print": "_p"}), "chosen")
    found = texts.join(ids, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_print") == F.col("_p"))).select(ROW, "text", "places", "large")
    parts = stage(carved(found, window, prefix), "segments")

    cold = trees(parts.where("count > 0 AND windows IS NULL").select("prefix", ROW, "first", "count", "words").repartition("prefix").sortWithinPartitions("prefix"), window)
    hot = counted(parts.where("windows IS NOT NULL").select("prefix", "mark", ROW, "first", "count", "windows"), window)
    spans = stage(cold.unionByName(hot).groupBy(ROW).agg(F.collect_list(F.struct("start", "end")).alias("x")), "spans")

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            out = []
            for row, packed, x in zip(*(batch.column(c).to_pylist() for c in (ROW, "words", "x")), strict=True):
                words, runs = open_(packed).split(), []
                for s in sorted(x, key=lambda s: s["start"]):
                    if runs and s["start"] <= runs[-1]["end"]:
                        runs[-1]["end"] = max(runs[-1]["end"], s["end"])
                    else:
                        runs.append(dict(s))
                kept, at = [], 0
                for s in runs:
                    kept += words[at : s["start"]]
                    at = s["end"]
                kept += words[at:]
                out.append((row, len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest(), runs))
            if out:
                cols = list(zip(*out, strict=True))
                kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2]), pa.array(cols[3], kind)], names=[ROW, "n_removed", "kept_sha256", "spans"])

    whole = parts.where("count < 0").select(ROW, "words").dropDuplicates([ROW])
    stripped = whole.join(spans, ROW).mapInArrow(strip, f"{ROW} long, n_removed long, kept_sha256 string, spans array<struct<start:long,end:long>>")
    copied = (F.col("copies") > 1) & (F.col("n_words") >= window)
    out = all_.select(key, ROW, "c1", "c2", "n_words", "whole_sha256").join(kinds.select("c1", "c2", "copies"), ["c1", "c2"]).join(stripped, ROW, "left")
    return out.select(
        key, "n_words", F.when(copied, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copied, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("kept_sha256", "whole_sha256")).alias("kept_sha256"),
        F.when(copied, F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_words").alias("end")))).otherwise(F.coalesce("spans", F.expr("CAST(array() AS array<struct<start:long,end:long>>)"))).alias("spans"),
    )
