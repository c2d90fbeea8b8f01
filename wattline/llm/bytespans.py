"""Strings of bytes that start anywhere earlier, found in suffix arrays sorted by external induction.

Every window of ``window`` bytes has an anchor, the ``GRAM`` bytes inside it with the smallest hash, the leftmost of them; equal
windows have equal anchors at the same offset. Windows that follow each other under one anchor make a segment. Of
segments with the same anchor and bytes only the first in the corpus goes on, in each block of documents already and then
in all; the windows of the others start earlier, too. Of the anchors with several different segments these segments, which may
share some windows, are dealt into shards by anchor. Each shard's suffixes are sorted with their common prefixes
(``induced``): suffixes that share ``window`` bytes and more are the same window, and all but the first of them repeat.

Documents are known by id and hash of their text; rows alike in both are copies of one document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattline.lineage import only_last_stays, spread, stage
from wattline.llm import induced, text
from wattline.llm.tables import ROW, numbered

WINDOW, GRAM = 100, 28
#: Bytes of a block of documents, of a piece of it that is worked on at once, and of a shard of segments.
BLOCK, PIECE, SHARD = 1 << 21, 1 << 19, 1 << 22
DOC = ["known", "id", "print"]


def segments(data: np.ndarray, offsets: np.ndarray, window: int, gram: int) -> list[np.ndarray]:
    """Runs of windows with one anchor: text number, first window (in its text), number of windows, hashes of the anchor and of all bytes."""
    reach, out = window - gram + 1, []
    for at in range(0, max(len(data) - window + 1, 0), PIECE):
        own = data[at : at + PIECE + window - 1]
        n = len(own) - window + 1
        doc = np.searchsorted(offsets, np.arange(at, at + n), "right") - 1
        first = np.flatnonzero(np.arange(at, at + n) + window <= offsets[doc + 1])
        if not len(first):
            continue
        grams = text.runs(text.BYTE_CODES[own], gram, "byte")
        best, have = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64), 1
        while have * 2 <= reach:
            best = np.minimum(best[:-have], best[have:])
            have *= 2
        if have < reach:
            best = np.minimum(best[: len(best) - (reach - have)], best[reach - have :])
        anchor = (best & np.uint64(0xFFFFFFFF)).astype(np.int64)[first]
        doc = doc[first]
        start = np.flatnonzero(induced.changes(anchor) | induced.changes(doc))
        count = np.diff(np.append(start, len(first)))
        first, doc = first[start], doc[start]
        end = first + count + window - 1
        up, down = text.powers("check", len(own) + 1)
        total = np.zeros(len(own) + 1, np.uint64)
        np.cumsum(text.BYTE_CODES[own] * up[: len(own)], out=total[1:])
        whole = text.mix((total[end] - total[first]) * down[first] + (end - first).astype(np.uint64))
        out.append((doc, first + at - offsets[doc], count, text.signed(grams[anchor[start]]), text.signed(whole)))
    return [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 5


#: ``kind`` 0: the first place of a segment's bytes in a block. 1: windows that start earlier. 2: a segment that others with its anchor may share windows with.
SPOT = "kind int, anchor long, whole long, known boolean, id long, print long, first int, count int"
NAMES = [x.split()[0] for x in SPOT.split(", ")]


def rows_of(kind: int, anchor, whole, known, ids, prints, first, count) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip((np.full(len(first), kind), anchor, whole, known, ids, prints, first, count), kinds, strict=True)], names=NAMES)


def joined(doc: np.ndarray, first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows of the same document, in order, with those that follow each other made one."""
    new = induced.changes(doc)
    new[1:] |= first[1:] != first[:-1] + count[:-1]
    at = np.flatnonzero(new)
    return doc[at], first[at], np.add.reduceat(count, at) if len(at) else count


def spots(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """Of each block the first place of each segment's bytes, and the windows of all other places."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in text.blocks(batches, size=BLOCK):
            known, ids, prints = (rows.column(c).to_numpy(zero_copy_only=False) for c in DOC)
            doc, first, count, anchor, whole = segments(data, offsets, window, gram)
            order = np.lexsort((prints, ids, known))
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            new = induced.changes(known[order]) | induced.changes(ids[order]) | induced.changes(prints[order])
            real = np.zeros(len(order), bool)
            real[order[new]] = True
            keep = real[doc]
            doc, first, count, anchor, whole = (x[keep] for x in (doc, first, count, anchor, whole))
            by = np.lexsort((first, rank[doc], whole, anchor))
            lead = induced.changes(anchor[by]) | induced.changes(whole[by])
            a = by[lead]
            yield rows_of(0, anchor[a], whole[a], known[doc[a]], ids[doc[a]], prints[doc[a]], first[a], count[a])
            b = np.sort(by[~lead])
            if len(b):
                d, f, c = joined(doc[b], first[b], count[b])
                yield rows_of(1, text.signed(text.mix((prints[d] + f).view(np.uint64))), np.zeros(len(d), np.int64), known[d], ids[d], prints[d], f, c)

    return docs.select(*DOC, "text").mapInArrow(find, SPOT)


def settled(found: DataFrame) -> DataFrame:
    """The windows that start earlier by whole segments, and the different segments of anchors that have several."""

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rival = None, False
        for batch in batches:
            kind = batch.column("kind").to_numpy()
            if (kind == 1).any():
                yield batch.filter(pa.array(kind == 1))
                batch = batch.filter(pa.array(kind == 0))
            columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in NAMES[1:]]
            if held is not None:
                columns = [np.append(h, c) for h, c in zip(held, columns, strict=True)]
            if not len(columns[0]):
                continue
            anchor, whole, known, ids, prints, first, count = columns
            new = induced.changes(anchor)
            lead = new | induced.changes(whole)
            at = np.flatnonzero(lead)
            of = at[np.cumsum(lead) - 1]
            again = (known != known[of]) | (ids != ids[of]) | (prints != prints[of]) | (first != first[of])
            if again.any():
                yield rows_of(1, *(c[again] for c in columns))
            several = ~new[at]
            several[:-1] |= ~new[at[1:]]
            several[0] |= rival
            held, rival = [c[at[-1:]] for c in columns], bool(several[-1])
            yield rows_of(2, *(c[at[:-1][several[:-1]]] for c in columns))
        if held is not None and rival:
            yield rows_of(2, *held)

    order = ["anchor", "whole", "known", "id", "print", "first"]
    return stage(spread(found, "anchor").sortWithinPartitions("kind", *order).mapInArrow(settle, SPOT), "settled")


def texts_of(docs: DataFrame) -> DataFrame:
    """Documents with their texts compressed, for a shuffle."""

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shrink = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            for b in (batch.slice(i, 512) for i in range(0, batch.num_rows, 512)):
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in DOC), pa.array([shrink(x) for x in b.column("text").to_pylist()], pa.binary())], names=[*DOC, "body"])

    return docs.select(*DOC, "text").mapInArrow(squeeze, "known boolean, id long, print long, body binary")


def carved(docs: DataFrame, rivals: DataFrame, window: int) -> DataFrame:
    """The bytes of segments."""
    wanted = rivals.groupBy(*DOC).agg(F.collect_list(F.struct("anchor", "first", "count")).alias("own"))
    both = texts_of(docs).join(wanted.hint("merge"), DOC)

    def carve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for i in range(batch.num_rows):
                own = batch.column("own")[i].values
                first, count = (own.field(c).to_numpy() for c in ("first", "count"))
                raw = open_(batch.column("body")[i].as_py())
                parts = [raw[a : a + n + window - 1] for a, n in zip(first.tolist(), count.tolist(), strict=True)]
                doc = [pa.array([batch.column(c)[i].as_py()] * len(first), batch.column(c).type) for c in DOC]
                yield pa.RecordBatch.from_arrays([own.field("anchor"), *doc, pa.array(first), pa.array(count), pa.array(parts, pa.binary())], names=["anchor", *DOC, "first", "count", "bytes"])

    return both.mapInArrow(carve, "anchor long, known boolean, id long, print long, first int, count int, bytes binary")


def later(symbols: np.ndarray, starts: np.ndarray, window: int) -> np.ndarray:
    """Of the places in ``starts`` those from which on ``window`` symbols are the same as from an earlier one."""
    gone, least = np.zeros(len(symbols), bool), -1
    for places, shared in induced.suffixes(symbols, 257, window):
        group = np.cumsum(shared < window)
        real = starts[places]
        places, group = places[real], group[real]
        if not len(places):
            if len(shared) and (shared < window).any():
                least = -1
            continue
        at = np.flatnonzero(induced.changes(group))
        gone[places] = True
        low = np.minimum.reduceat(places, at)
        if group[0] == 0 and least >= 0:  # goes on with the last group before
            low[0] = min(low[0], least)
        gone[low] = False
        if group[0] == 0 and least >= 0 and low[0] != least:
            gone[least] = True
        least = low[-1] if group[-1] == np.count_nonzero(shared < window) else -1
    return gone


def sorted_out(pieces: DataFrame, shards: int, window: int) -> DataFrame:
    """The windows of segments that start earlier in another segment, by the suffixes of each shard in order."""
    out = "known boolean, id long, print long, first int, count int"

    def sort(table: pa.Table) -> pa.Table:
        known, ids, prints, first, count = (table.column(c).to_numpy() for c in (*DOC, "first", "count"))
        order = np.lexsort((first, prints, ids, known))
        new = np.zeros(len(order), bool)
        for x in (known, ids, prints, first):
            new |= induced.changes(x[order])
        order = order[new]  # copies of a document bring its segments several times
        known, ids, prints, first, count = (x[order] for x in (known, ids, prints, first, count))
        parts = table.column("bytes").take(pa.array(order)).to_pylist()
        symbols = np.zeros(sum(map(len, parts)) + len(parts), np.uint16)
        begin = text.offsets_of(np.array([len(x) + 1 for x in parts]))
        for a, x in zip(begin[:-1].tolist(), parts, strict=True):
            symbols[a : a + len(x)] = np.frombuffer(x, np.uint8)
        inside = np.ones(len(symbols), bool)
        inside[begin[1:] - 1] = False
        symbols[inside] += 1
        del parts
        # segments are in order, so the place in the shard's text is the order of windows
        starts = np.zeros(len(symbols) + 1, np.int32)
        np.add.at(starts, begin[:-1], 1)
        np.add.at(starts, begin[:-1] + count, -1)
        starts = np.cumsum(starts[:-1]).astype(bool)
        gone = later(symbols, starts, window)
        at = np.flatnonzero(gone)
        part = np.searchsorted(begin, at, "right") - 1
        d, f, c = joined(part, at - begin[part], np.ones(len(at), np.int64))
        return pa.table({"known": pa.array(known[d]), "id": pa.array(ids[d]), "print": pa.array(prints[d]), "first": pa.array((first[d] + f).astype(np.int32)), "count": pa.array(c.astype(np.int32))})

    return stage(pieces.withColumn("shard", F.pmod("anchor", F.lit(shards))).groupBy("shard").applyInArrow(sort, out), "sorted")


def cut_out(docs: DataFrame, runs: DataFrame, window: int) -> DataFrame:
    """Documents with such windows: bytes and runs removed, and the digest of what is left."""
    # runs of windows that touch share bytes, and are joined per document
    own = runs.groupBy(*DOC).agg(F.array_sort(F.collect_list(F.struct("first", "count"))).alias("runs"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                raw, values = open_(batch.column("body")[i].as_py()), batch.column("runs")[i].values
                a = values.field("first").to_numpy().astype(np.int64)
                z = np.maximum.accumulate(a + values.field("count").to_numpy() + window - 1)
                new = np.append(True, a[1:] > z[:-1])
                begin, end = a[new], np.append(z[:-1][new[1:]], z[-1])
                digest = hashlib.sha256()
                for x, y in zip([0, *end.tolist()], [*begin.tolist(), len(raw)], strict=True):
                    digest.update(raw[x:y])
                out.append((int((end - begin).sum()), len(begin), digest.hexdigest()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in DOC), *(pa.array(x) for x in zip(*out, strict=True))], names=[*DOC, "n_removed", "n_spans", "kept_sha256"])

    both = texts_of(docs).join(own.hint("merge"), DOC)
    return stage(both.mapInArrow(cut, "known boolean, id long, print long, n_removed long, n_spans long, kept_sha256 string").dropDuplicates(DOC), "cut")


def repeats(docs: DataFrame, window: int = WINDOW, key: str = "doc_id", column: str = "text") -> DataFrame:
    """For every row: key, n_bytes, n_removed, n_spans (runs removed, as long as can be), kept_sha256.

    A byte goes if a string of ``window`` bytes (64 to 250) that covers it also starts earlier: in a document with a smaller id, or in the same one before.
    Ids are integers; null ids come first; different texts with the same id go by a hash of the text. Of rows alike in id and text the
    first keeps its bytes and each string of the others starts earlier, so a text of ``window`` bytes or more goes whole.
    A null text is empty; shorter texts stay. Texts are worked on in pieces, however long. Other columns are ignored; an
    empty table gives no rows.
    """
    if not 64 <= window <= 250:
        raise ValueError("window must be from 64 to 250 bytes")
    with only_last_stays(docs.sparkSession):
        return _repeats(docs, window, key, column)


def _repeats(docs: DataFrame, window: int, key: str, column: str) -> DataFrame:
    own = docs.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{column}`").cast("binary"), F.lit(b"")).alias("text"))
    own = own.select("key", F.col("key").isNotNull().alias("known"), F.coalesce(F.col("key").cast("long"), F.lit(0)).alias("id"), F.xxhash64("text").alias("print"), "text")
    found = settled(spots(own, window, GRAM))
    rivals = found.where("kind = 2").drop("kind", "whole")
    size = rivals.agg(F.sum(F.col("count") + window)).first()[0] or 0
    late = found.where("kind = 1").select(*DOC, "first", "count")
    if size:
        late = late.unionByName(sorted_out(carved(own, rivals, window), 1 + size // SHARD, window))
    done = cut_out(own, late, window)
    rows = numbered(own.select("key", *DOC, F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("whole")), "rows")
    about = rows.groupBy(*DOC).agg(F.min(ROW).alias("_lead")).join(done, DOC, "left")
    out = rows.join(stage(about, "about"), DOC)
    copy = (F.col(ROW) != F.col("_lead")) & (F.col("n_bytes") >= window)
    nothing = F.lit(hashlib.sha256().hexdigest())
    return stage(out.select(
        F.col("key").alias(key), "n_bytes", F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(copy, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"), F.when(copy, nothing).otherwise(F.coalesce("kept_sha256", "whole")).alias("kept_sha256"),
    ), "byte_repeats")
