"""Ranked lexical search over inverted lists with range-maximum tables.

Documents are dealt into segments of bounded size, each with an inverted list per term: the positions of the documents that
hold it, in ascending order of their ids, and how often. A document's score is the sum of the impacts of the query's
terms. Sparse tables over the impacts give the largest one, and the document it belongs to, of any interval of documents
in two look-ups; summed over the query's lists they bound every score in the interval.

A query starts with the whole segment as one interval. The intervals with the highest bounds are split, each at the document with the
largest single impact in it: that document is scored exactly, and the intervals to its left and right get bounds of their own. The search ends
when no bound reaches the last of the best documents found so far, which a task carries from segment to segment. Every task hands on
its best documents of each query, and the best of these are merged in two steps, so no task sees all of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wattline.lineage import stage
from wattline.llm import text

#: A term is a run of ASCII letters and digits and of all characters beyond ASCII.
BETWEEN = np.ones(256, bool)
BETWEEN[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
#: Postings and documents of a segment, cells of its table of ranks, and intervals that are split together.
POSTINGS, DOCUMENTS, CELLS, SPLITS = 1 << 19, 1 << 12, 1 << 23, 32
#: Terms of the queries in a block; every block meets the whole index once.
BLOCK_TERMS = 1 << 17
#: An impact and, below it, a document position counted from the end, in one 64-bit number.
SHIFT = 20
MASK = (1 << SHIFT) - 1


def squeeze(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x).tobytes())


def swell(x: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(x), kind)


def counted(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of some texts: terms of each with repeats, and the distinct terms (hash, text number, occurrences)."""
    w = text.Words(data, offsets, lower=True, between=BETWEEN)
    doc, term = np.repeat(np.arange(len(offsets) - 1), np.diff(w.first)), w.hashes()
    order = np.lexsort((doc, term))
    doc, term = doc[order], term[order]
    new = np.ones(len(term), bool)
    new[1:] = (term[1:] != term[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    return np.diff(w.first), term[at], doc[at], np.diff(np.append(at, len(term)))


INDEX = "segment long, documents long, terms long, ids binary, known binary, lengths binary, vocabulary binary, sizes binary, places binary, times binary"


def build(docs: DataFrame, key: str = "doc_id", column: str = "text") -> DataFrame:
    """The index, a row per segment, stored. Documents without a term stay out; null texts have none."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId(), 0
        held: list[tuple] = []

        def flush() -> pa.RecordBatch:
            nonlocal made
            shift = text.offsets_of(np.array([len(x[0]) for x in held]))
            ids, known, n = (np.concatenate([x[i] for x in held]) for i in range(3))
            term, times = np.concatenate([x[3] for x in held]), np.concatenate([x[5] for x in held])
            doc = np.concatenate([x[4] + s for x, s in zip(held, shift[:-1], strict=True)])
            held.clear()
            order = np.lexsort((ids, ~known))
            order = order[n[order] > 0]
            place = np.full(len(n), -1)
            place[order] = np.arange(len(order))
            doc = place[doc]
            by = np.lexsort((doc, term))
            term, doc, times = term[by], doc[by], times[by]
            new = np.ones(len(term), bool)
            new[1:] = term[1:] != term[:-1]
            at = np.flatnonzero(new)
            arrays = (ids[order], known[order], n[order], term[at], np.diff(np.append(at, len(term))).astype(np.int32), doc.astype(np.int32), times.astype(np.int32))
            made += 1
            head = [pa.array([x], pa.int64()) for x in (task << 32 | made, len(order), int(n.sum()))]
            return pa.RecordBatch.from_arrays([*head, *(pa.array([squeeze(x)], pa.binary()) for x in arrays)], names=[x.split()[0] for x in INDEX.split(", ")])

        for rows, data, offsets in text.blocks(batches):
            n, term, doc, times = counted(data, offsets)
            ids = rows.column(key)
            if held and (sum(len(x[3]) for x in held) + len(term) > POSTINGS or sum(len(x[0]) for x in held) + len(n) > DOCUMENTS):
                yield flush()
            held.append((ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_valid().to_numpy(zero_copy_only=False), n, term, doc, times))
        if held:
            yield flush()

    own = docs.select(F.col(f"`{key}`").cast("long").alias(key), F.col(f"`{column}`").cast("binary").alias("text"))
    return stage(own.mapInArrow(index, INDEX).where("documents > 0"), "index")


def asked(items: DataFrame, item: str, column: str) -> DataFrame:
    """The queries, stored and numbered: query, block, item, distinct terms."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in text.blocks(batches):
            n, term, doc, _ = counted(data, offsets)
            order = np.argsort(doc, kind="stable")
            terms = text.lists(text.signed(term[order]), np.bincount(doc, minlength=len(n)))
            yield pa.RecordBatch.from_arrays([rows.column("query"), terms], names=["query", "terms"])

    own = stage(items.select(F.monotonically_increasing_id().alias("query"), F.col(f"`{item}`").alias("item"), F.col(f"`{column}`").cast("binary").alias("text")), "items")
    terms = stage(own.select("query", "text").mapInArrow(parse, "query long, terms array<long>").where("size(terms) > 0"), "terms")
    blocks = 1 + int(terms.agg(F.sum(F.size("terms"))).first()[0] or 0) // BLOCK_TERMS
    return stage(terms.join(own.select("query", "item"), "query").withColumn("block", F.pmod(F.xxhash64("query"), F.lit(blocks)).cast("int")), "queries")


def meet(index: DataFrame, columns: list[str], queries: DataFrame, tasks: int, blocks: int) -> DataFrame:
    """Queries and segments in one stream: every task gets all queries of a block, then its segments one by one."""
    left = queries.withColumn("task", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1)))).withColumn("segment", F.lit(-1).cast("long"))
    right = index.select("segment", *columns).withColumn("task", F.pmod(F.xxhash64("segment"), F.lit(tasks)).cast("int"))
    right = right.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    both = left.unionByName(right, allowMissingColumns=True)
    return both.repartition(tasks * blocks, "block", "task").sortWithinPartitions("block", "task", "segment")


def streams(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, pa.RecordBatch]]:
    """Rows of ``meet`` one by one, and whether a row is the first of its block and task."""
    last = None
    for batch in batches:
        blocks, tasks = batch.column("block").to_pylist(), batch.column("task").to_pylist()
        for i in range(batch.num_rows):
            now = (blocks[i], tasks[i])
            yield now != last, batch.slice(i, 1)
            last = now


def frequencies(index: DataFrame, queries: DataFrame, tasks: int, blocks: int) -> DataFrame:
    """In how many documents each term of the queries is."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms: list[np.ndarray] = []
        wanted = n = None

        def out() -> Iterator[pa.RecordBatch]:
            if wanted is not None and n.any():
                yield pa.RecordBatch.from_arrays([pa.array(text.signed(wanted[n > 0])), pa.array(n[n > 0])], names=["term", "n"])

        for first, row in streams(batches):
            if first:
                yield from out()
                terms, wanted = [], None
            if row.column("segment")[0].as_py() < 0:
                terms.append(np.array(row.column("terms")[0].values).view(np.uint64))
                continue
            if wanted is None:
                wanted = np.unique(np.concatenate([*terms, np.zeros(0, np.uint64)]))
                n = np.zeros(len(wanted), np.int64)
            own, sizes = swell(row.column("vocabulary")[0].as_py(), np.uint64), swell(row.column("sizes")[0].as_py(), np.int32)
            at = np.minimum(np.searchsorted(own, wanted), len(own) - 1)
            n += np.where(own[at] == wanted, sizes[at], 0)
        yield from out()

    pairs = meet(index, ["vocabulary", "sizes"], queries.select("block", "query", "terms"), tasks, blocks).mapInArrow(count, "term long, n long")
    # a term in several blocks is counted in each
    return stage(queries.select("block", F.explode("terms").alias("term")).groupBy("term").agg(F.countDistinct("block").alias("b")).join(pairs.groupBy("term").agg(F.sum("n").alias("n")), "term").selectExpr("term", "n div b AS df"), "frequencies")


class Segment:
    """Impacts of the lists that some queries need, with their range-maximum table."""

    def __init__(self, places: np.ndarray, impacts: np.ndarray, sizes: np.ndarray, n: int):
        self.n, self.begin = n, text.offsets_of(sizes)[:-1]
        of = np.repeat(np.arange(len(sizes)), sizes)
        self.before = self.keys = None
        if len(sizes) * (n + 1) <= 4 * CELLS:  # before[t, d]: how many documents of list t lie before d
            before = np.zeros((len(sizes), n + 1), np.int32)
            before[of, places + 1] = 1
            self.before = np.cumsum(before, axis=1, out=before)
        else:
            self.keys = of * (n + 1) + places
        self.level = np.zeros(int(sizes.max(initial=1)) + 1, np.int64)
        self.level[1:] = np.floor(np.log2(np.arange(1, len(self.level)))).astype(np.int64)
        table = [impacts << SHIFT | (MASK - places)]
        for k in range(int(self.level[-1])):
            half, wide = 1 << k, table[-1].copy()
            np.maximum(table[-1][:-half], table[-1][half:], out=wide[: len(wide) - half])
            table.append(wide)
        self.table = np.stack(table)

    def rank(self, lists: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """Of each list (a row) how many documents lie before each of ``docs``."""
        if self.before is not None:
            return self.before[lists[:, None], docs]
        return np.searchsorted(self.keys, lists[:, None] * (self.n + 1) + docs) - self.begin[lists][:, None]

    def bounds(self, lists: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of intervals of documents: the sum of the lists' largest impacts, and the document with the largest of all."""
        a, z = self.rank(lists, lo), self.rank(lists, hi)
        term, of = np.nonzero(z > a)
        a, z = a[term, of], z[term, of]
        level, a, z = self.level[z - a], a + self.begin[lists[term]], z + self.begin[lists[term]]
        best = np.maximum(self.table[level, a], self.table[level, z - (1 << level)])
        total, top = np.zeros(len(lo), np.int64), np.zeros(len(lo), np.int64)
        order = np.argsort(of, kind="stable")
        of, best = of[order], best[order]
        at = np.flatnonzero(np.append(True, of[1:] != of[:-1])) if len(of) else of
        total[of[at]], top[of[at]] = np.add.reduceat(best >> SHIFT, at), np.maximum.reduceat(best, at)
        return total, MASK - (top & MASK)

    def scores(self, lists: np.ndarray, docs: np.ndarray) -> np.ndarray:
        a = self.rank(lists, docs)
        has = self.rank(lists, docs + 1) > a
        at = np.where(has, a + self.begin[lists][:, None], 0)
        return np.where(has, self.table[0][at] >> SHIFT, 0).sum(axis=0)


class Best:
    """The best documents of a query so far: score, known id (False for a null), id."""

    def __init__(self, k: int):
        self.k, self.score, self.unknown, self.id = k, np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)
        self.splits = 0

    def add(self, score: np.ndarray, unknown: np.ndarray, ids: np.ndarray) -> None:
        score, unknown, ids = (np.concatenate(x) for x in ((self.score, score), (self.unknown, unknown), (self.id, ids)))
        order = np.lexsort((ids, unknown, -score))[: self.k]
        self.score, self.unknown, self.id = score[order], unknown[order], ids[order]

    def open(self, bound: np.ndarray, unknown: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Whether a document with this score or less could still enter; ids are the smallest of each interval."""
        if len(self.score) < self.k:
            return bound > 0
        least, last = self.score[-1], (self.unknown[-1], self.id[-1])
        smaller = (unknown < last[0]) | ((unknown == last[0]) & (ids < last[1]))
        return (bound > least) | ((bound == least) & smaller)


def search(part: Segment, lists: np.ndarray, unknown: np.ndarray, ids: np.ndarray, best: Best) -> None:
    """Best-first search of one query in one segment."""
    lo, hi = np.array([0]), np.array([part.n])
    bound, top = part.bounds(lists, lo, hi)
    while True:
        keep = best.open(bound, unknown[lo], ids[lo]) if len(lo) else np.zeros(0, bool)
        if not keep.any():
            return
        lo, hi, bound, top = lo[keep], hi[keep], bound[keep], top[keep]
        take = np.argpartition(-bound, SPLITS - 1)[:SPLITS] if len(bound) > SPLITS else np.arange(len(bound))
        docs = top[take]
        best.splits += len(take)
        score = part.scores(lists, docs)
        best.add(score, unknown[docs], ids[docs])
        left, right = np.concatenate([lo[take], docs + 1]), np.concatenate([docs, hi[take]])
        real = right > left
        left, right = left[real], right[real]
        sums, tops = part.bounds(lists, left, right)
        rest = np.ones(len(lo), bool)
        rest[take] = False
        lo, hi, bound, top = (np.concatenate(x) for x in ((lo[rest], left), (hi[rest], right), (bound[rest], sums), (top[rest], tops)))


def top(docs: DataFrame, items: DataFrame, k: int = 50, key: str = "doc_id", column: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """The ``k`` documents with the highest scores above 0 for each item: item, rank (from 1), key, score.

    A term's weight is floor(1000 ln((2N + 2) / (2 df + 1))), a document's length counts as m = 50 + (50 n N) div L, and the
    impact of a term that occurs tf times is weight * ((10^9 tf) div (1000 tf + 20 m)). N documents have a term, L terms are in all.
    Equal scores go by ascending id, a null id last. Ids are integers. Repeated rows and ids are documents, or queries, of their own.
    Null, empty and termless texts are never found and find nothing; an empty table gives no rows. Other columns are ignored. A text
    is indexed whole, however long; a document longer than a segment makes one of its own.
    """
    if item == key:
        raise ValueError("key and item need different names")
    spark, index, queries = docs.sparkSession, build(docs, key, column), asked(items, item, item_text)
    n_segments, n_docs, n_terms = (x or 0 for x in index.agg(F.count("*"), F.sum("documents"), F.sum("terms")).first())
    blocks = (queries.agg(F.max("block")).first()[0] or 0) + 1
    tasks = max(1, min(n_segments, max(spark.sparkContext.defaultParallelism, n_segments // 8)))
    df = frequencies(index, queries, tasks, blocks)
    weight = F.floor(1000 * F.log((2.0 * n_docs + 2) / (2 * F.col("df") + 1))).cast("long")
    weighed = queries.select("block", "query", F.explode("terms").alias("term")).join(df, "term").withColumn("weight", weight).where("weight > 0")
    weighed = weighed.groupBy("block", "query").agg(F.collect_list("term").alias("terms"), F.collect_list("weight").alias("weights"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, terms, weights, best, chunks = [], [], [], [], None

        def out() -> Iterator[pa.RecordBatch]:
            for name, b in zip(names, best, strict=True):
                if len(b.score):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(b.score), name)), pa.array(b.id, mask=b.unknown), pa.array(b.score)], names=["query", "doc", "score"])

        for first, row in streams(batches):
            if first:
                yield from out()
                names, terms, weights, best, chunks = [], [], [], [], None
            if row.column("segment")[0].as_py() < 0:
                names.append(row.column("query")[0].as_py())
                terms.append(np.array(row.column("terms")[0].values).view(np.uint64)), weights.append(np.array(row.column("weights")[0].values))
                best.append(Best(k))
                continue
            if chunks is None:  # queries that are searched together
                chunks = np.cumsum([len(x) for x in terms])
            kinds = {"ids": np.int64, "known": bool, "lengths": np.int64, "vocabulary": np.uint64, "sizes": np.int32, "places": np.int32, "times": np.int32}
            s = {c: swell(row.column(c)[0].as_py(), kind) for c, kind in kinds.items()}
            begin = text.offsets_of(s["sizes"])
            m = 50 + (50 * s["lengths"] * n_docs) // n_terms
            together = chunks // max(1, CELLS // (len(s["ids"]) + 1))
            for chunk in np.unique(together):
                own = np.flatnonzero(together == chunk)
                wanted, where = np.unique(np.concatenate([terms[i] for i in own]), return_index=True)
                weight = np.concatenate([weights[i] for i in own])[where]
                at = np.minimum(np.searchsorted(s["vocabulary"], wanted), len(s["vocabulary"]) - 1)
                hit = s["vocabulary"][at] == wanted
                wanted, weight, at = wanted[hit], weight[hit], at[hit]
                if not len(wanted):
                    continue
                sizes = s["sizes"][at].astype(np.int64)
                posting = np.repeat(begin[at] - text.offsets_of(sizes)[:-1], sizes) + np.arange(sizes.sum())
                places, times = s["places"][posting].astype(np.int64), s["times"][posting].astype(np.int64)
                impacts = np.repeat(weight, sizes) * ((1_000_000_000 * times) // (1000 * times + 20 * m[places]))
                part = Segment(places, impacts, sizes, len(s["ids"]))
                for i in own:
                    lists = np.searchsorted(wanted, terms[i])
                    lists = lists[(lists < len(wanted)) & (wanted[np.minimum(lists, len(wanted) - 1)] == terms[i])]
                    if len(lists):
                        search(part, lists, ~s["known"], s["ids"], best[i])
        yield from out()

    columns = ["ids", "known", "lengths", "vocabulary", "sizes", "places", "times"]
    found = stage(meet(index, columns, weighed, tasks, blocks).mapInArrow(find, "query long, doc long, score long"), "found")
    order = [F.desc("score"), F.col("doc").asc_nulls_last()]
    some = found.withColumn("_part", F.pmod(F.xxhash64("doc"), F.lit(64)))
    some = some.withColumn("rank", F.row_number().over(Window.partitionBy("query", "_part").orderBy(*order))).where(F.col("rank") <= k)
    last = some.drop("rank", "_part").withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where(F.col("rank") <= k)
    return last.join(queries.select("query", "item"), "query").select(F.col("item").alias(item), "rank", F.col("doc").alias(key), "score")
