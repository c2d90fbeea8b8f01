"""Toxicity by class-conditional Kneser-Ney models of words and bigrams.

For toxic and for ordinary documents, discounted counts are interpolated with what they leave over: the bigrams of the class
with those of both classes, these with the class's words by the number of distinct words they are seen after, and these with equal
chances for all words. Discounts are n1 / (n1 + 2 n2) of each class, so every expression seen keeps some evidence.

A text's log-likelihood ratio is taken per word, for words alone and for bigrams, over the whole text and over its most toxic
passage. A logistic curve of these four and the logarithm of the length turns them into 0 to 1. The curve and the length of the
passages are fitted on at most ``CURVE_ROWS`` labelled documents of one fold, scored by counts that this fold isn't in. Final counts
are of all labelled documents that aren't held out.

Words and bigrams are known by 64-bit hashes, and counts are stored tables as large as the corpus makes them. Every bigram is kept.
Counts are summed up in parts by hash, packed as arrays. Documents travel in blocks; a block asks once for each of its distinct words
and bigrams, and a part is answered by binary search. Scoring goes slice by slice, and the shuffles of a slice are removed when its
scores are written, so only one slice's take room at a time.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from wattline.lineage import forget, only_last_stays, stage
from wattline.llm import text

PASSAGES, AT_ONCE, BLOCK, PART, SLICES = (2, 4, 8, 16, 32), 1 << 19, 1 << 20, 1 << 20, 8
#: Texts and packed arrays make large rows, so few of them go to a worker at once.
BATCH, ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", "1000"
#: Counting goes over the lessons this often, each time for another share of the bigrams.
TIMES = 2
HELD_OUT_FOLD, CURVE_FOLD, FOLDS = 2, 3, 4
#: Models by number: the first is counted without the fold that fits the curve, the second with all that may teach.
MODELS = (0, 1)
CURVE_ROWS = 20_000
START = np.uint64(0x5D9F3B7A6C1E8427)
#: Log-ratios per word of a text: by words and by bigrams, of the whole and of the most toxic passage of each length.
def names_of(passages: tuple[int, ...]) -> list[str]:
    return ["mean_word", "mean_pair", *(f"{x}_{n}" for n in passages for x in ("top_word", "top_pair"))]


#: What a word is asked for (its own chances, then those of what follows it) and what a bigram is.
ABOUT_WORD, ABOUT_PAIR = ("after0", "after1", "all0", "all1", "kinds0", "kinds1", "kinds"), ("n0", "n1")


def pack(x: np.ndarray) -> bytes:
    """64-bit numbers, byte by byte of all, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8).T).tobytes())


def unpack(x: bytes, kind=np.int64) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(x), np.uint8)
    return np.ascontiguousarray(raw.reshape(8, -1).T).view(kind).ravel()


def wrap(rows: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema) as out:
        out.write_batch(rows)
    return zstandard.ZstdCompressor(level=3).compress(sink.getvalue())


def unwrap(body: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(body)).read_next_batch()


def dealt(keys: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The order that puts sorted keys into their parts, and where each part begins and the last ends."""
    part = (keys % np.uint64(parts)).astype(np.int64)
    return np.argsort(part, kind="stable"), text.offsets_of(np.bincount(part, minlength=parts))


def both(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    """One hash of a word and the word before it."""
    return text.mix(text.mix(before + np.uint64(1)) + word)


def grams(w: text.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words, of the word before each (START at the start of a text) and of both together."""
    word = w.hashes()
    before = np.concatenate([[START], word[:-1]]).astype(np.uint64)[: len(word)]
    before[w.first[:-1][w.first[:-1] < len(word)]] = START
    return word, before, both(before, word)


def read_block(body: bytes, column: str) -> tuple[pa.RecordBatch, text.Words]:
    whole = unwrap(body)
    ((rows, data, offsets),) = text.blocks(iter([whole]), column, 1 << 62)
    return rows, text.Words(data, offsets, lower=True)


def fold(key: str):
    """crc32 of the key as text, modulo FOLDS; null for a null key."""
    return F.crc32(F.col(f"`{key}`").cast("string").cast("binary")) % FOLDS


def blocks(docs: DataFrame, column: str, model: int, name: str = "blocks", packed: bool = False) -> DataFrame:
    """The rows in stored blocks of some text each: block, model (the one that scores it), body. Compressed texts are opened (``packed``)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, _, _ in text.blocks(swollen(batches, column) if packed else batches, column, BLOCK):
            yield pa.RecordBatch.from_arrays([pa.array([wrap(rows)], pa.binary())], names=["body"])

    return stage(docs.mapInArrow(cut, "body binary").select(F.monotonically_increasing_id().alias("block"), F.lit(model).alias("model"), "body"), name)


def squeezed(docs: DataFrame) -> DataFrame:
    """Key and compressed text, for a shuffle."""

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shrink = zstandard.ZstdCompressor(level=1).compress
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shrink(x or b"") for x in b.column(1).to_pylist()], pa.binary())], schema=b.schema)

    return docs.mapInArrow(squeeze, docs.schema)


def swollen(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """The rows with their texts opened, in runs of a block's text. A step of its own would hold a second worker for each task."""
    open_ = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        texts, at, size = [], 0, 0
        for k, x in enumerate(batch.column(column)):
            one = open_(x.as_py())
            if texts and size + len(one) > BLOCK:
                yield replaced(batch.slice(at, len(texts)), column, texts)
                texts, at, size = [], k, 0
            texts.append(one)
            size += len(one)
        if texts:
            yield replaced(batch.slice(at), column, texts)


def replaced(rows: pa.RecordBatch, column: str, texts: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(texts, pa.binary()) if c == column else rows.column(c) for c in rows.schema.names], names=rows.schema.names)


def grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order that sorts keys, and where each distinct one begins in it."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    return order, np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))


def pair_counts(lessons: DataFrame, parts: tuple[int, int], at: int = 0, times: int = 1) -> DataFrame:
    """Every bigram of the lessons (model, toxic, body) in packed parts by its hash, and what they add to their words.

    ``kind`` 0: part, keys, and in ``rows`` how often each bigram is in four kinds of lessons, 2 * model + toxic, where lessons of model
    0 are in both models. ``stats`` has, by model, how many are seen once and twice by ordinary, toxic and all lessons. ``kind`` 1: the part's share of
    ``word_counts``, by parts of words. ``parts`` are the numbers of parts of words and of bigrams. Of the bigrams only the share ``at`` of ``times`` is counted.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = zstandard.ZstdDecompressor().decompress
        waiting: list[tuple[np.ndarray, ...]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            before, word, kind, keys = (np.concatenate(x) for x in zip(*waiting, strict=True))
            waiting.clear()
            order, first = grouped(keys)
            kind = kind[order]
            rows = np.stack([np.add.reduceat((kind == k).astype(np.int64), first) for k in range(4)])
            lead = order[first]
            by, edge = dealt(keys[lead], parts[1])
            for p in np.flatnonzero(np.diff(edge)):
                own = by[edge[p] : edge[p + 1]]
                own = own[np.argsort(word[lead[own]], kind="stable")]  # in order of words, which packs them closer
                values = (np.diff(word[lead[own]], prepend=np.uint64(0)), before[lead[own]], rows[:, own].ravel())
                yield pa.RecordBatch.from_arrays([pa.array([p]), *(pa.array([pack(x)], pa.binary()) for x in values)], names=["part", "word", "before", "rows"])

        held = 0
        for batch in batches:
            kinds = (2 * batch.column("model").to_numpy() + batch.column("toxic").to_numpy()).astype(np.int64)
            bodies = batch.column("body")
            i = 0
            while i < len(bodies):
                raw, to, size = [], i, 0
                while to < len(bodies) and size < BLOCK:
                    raw.append(open_(bodies[to].as_py()))
                    size += len(raw[-1])
                    to += 1
                w = text.Words(np.frombuffer(b"".join(raw), np.uint8), text.offsets_of(np.array([len(x) for x in raw])), lower=True)
                word, before, keys = grams(w)
                own = np.flatnonzero((keys >> np.uint64(40)) % np.uint64(times) == at)
                own = (before[own], word[own], np.repeat(kinds[i:to], np.diff(w.first))[own], keys[own])
                for a in range(0, len(own[0]), AT_ONCE):
                    waiting.append(tuple(x[a : a + AT_ONCE] for x in own))
                    held += len(waiting[-1][0])
                    if held >= AT_ONCE:
                        held = 0
                        yield from flush()
                i = to
        if held:
            yield from flush()

    schema = "kind int, part long, keys binary, rows binary, stats array<long>"

    def merge(table: pa.Table) -> pa.Table:
        word = np.concatenate([np.cumsum(unpack(x, np.uint64), dtype=np.uint64) for x in table.column("word").to_pylist()])
        before = np.concatenate([unpack(x, np.uint64) for x in table.column("before").to_pylist()])
        rows = np.concatenate([unpack(x).reshape(4, -1) for x in table.column("rows").to_pylist()], axis=1)
        keys = both(before, word)
        order, first = grouped(keys)
        rows, at = np.stack([np.add.reduceat(x[order], first) for x in rows]), order[first]
        keys, before, word = keys[at], before[at], word[at]
        seen = [(of(rows, 0, m), of(rows, 1, m), of(rows, 0, m) + of(rows, 1, m)) for m in MODELS]
        stats = [int((n == k).sum()) for three in seen for n in three for k in (1, 2)]
        after, follow = ([np.zeros(len(word), np.int64)] * (len(ABOUT_WORD) * len(MODELS)) for _ in range(2))
        for m, (n0, n1, n) in zip(MODELS, seen, strict=True):
            i = m * len(ABOUT_WORD)
            after[i : i + 2] = n0 > 0, n1 > 0
            follow[i + 2 : i + 7] = n0, n1, n0 > 0, n1 > 0, n > 0
        of_word, about = summed(np.concatenate([word, before]), [np.concatenate(x) for x in zip(after, follow, strict=True)])
        by, edge = dealt(of_word, parts[0])
        shares = [(1, p, of_word[own], about[:, own], None) for p in np.flatnonzero(np.diff(edge)) for own in [by[edge[p] : edge[p + 1]]]]
        out = [(0, table.column("part")[0].as_py(), keys, rows, stats), *shares]
        kind, part, k, r, s = zip(*out, strict=True)
        return pa.table([pa.array(kind, pa.int32()), pa.array(part, pa.int64()), pa.array([pack(x) for x in k], pa.binary()), pa.array([pack(x.ravel()) for x in r], pa.binary()), pa.array(s, pa.list_(pa.int64()))], names=["kind", "part", "keys", "rows", "stats"])

    counted = lessons.select("model", "toxic", "body").mapInArrow(count, "part long, word binary, before binary, rows binary")
    return stage(counted.groupBy("part").applyInArrow(merge, schema), "pairs")


def of(rows: np.ndarray, c: int, m: int) -> np.ndarray:
    """Counts of a class as model m has them."""
    return rows[c] + rows[2 + c] if m else rows[c]


def summed(keys: np.ndarray, rows) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sums of their rows."""
    order, first = grouped(keys)
    return keys[order[first]], np.stack([np.add.reduceat(x[order].astype(np.int64), first) for x in rows])


def word_counts(pairs: DataFrame) -> DataFrame:
    """For each word and model ABOUT_WORD: after how many words it is seen, how often it is followed, and by how many words.

    In packed parts by hash: part, keys, rows, stats (by model and class: the sum of the words it is seen after, and how many words have any, one, two; then the number of words).
    """
    wide = len(ABOUT_WORD) * len(MODELS)

    def merge(table: pa.Table) -> pa.Table:
        keys = np.concatenate([unpack(x, np.uint64) for x in table.column("keys").to_pylist()])
        keys, rows = summed(keys, np.concatenate([unpack(x).reshape(wide, -1) for x in table.column("rows").to_pylist()], axis=1))
        stats = [int(x) for m in MODELS for n in rows[m * len(ABOUT_WORD) : m * len(ABOUT_WORD) + 2] for x in (n.sum(), (n > 0).sum(), (n == 1).sum(), (n == 2).sum())]
        return pa.table({"part": table.column("part")[:1], "keys": pa.array([pack(keys)], pa.binary()), "rows": pa.array([pack(rows.ravel())], pa.binary()), "stats": pa.array([[*stats, len(keys)]])})

    shares = pairs.where("kind = 1").select("part", "keys", "rows")
    return stage(shares.groupBy("part").applyInArrow(merge, "part long, keys binary, rows binary, stats array<long>"), "words")


@dataclass(frozen=True)
class Sizes:
    """What each model is made of: words known, and by class discounts and totals."""

    known: int
    word_discount: tuple
    total: tuple
    kinds: tuple
    discount: tuple


def sizes(pairs: DataFrame, table: DataFrame) -> dict[int, Sizes]:
    def total(of: DataFrame, n: int) -> list[int]:
        sums = {r[0]: r[1] for r in of.select(F.posexplode("stats").alias("at", "n")).groupBy("at").agg(F.sum("n")).collect()}
        return [sums.get(i, 0) for i in range(n)]

    of_words, of_pairs = total(table, 8 * len(MODELS) + 1), total(pairs, 6 * len(MODELS))

    def discount(n1: int, n2: int) -> float:
        return (n1 + 1) / (n1 + 2 * n2 + 2)

    out = {}
    for m in MODELS:
        w = [of_words[8 * m + 4 * c : 8 * m + 4 * c + 4] for c in (0, 1)]
        p = [of_pairs[6 * m + 2 * c : 6 * m + 2 * c + 2] for c in range(3)]
        out[m] = Sizes(max(of_words[-1], 1), tuple(discount(x[2], x[3]) for x in w), tuple(x[0] for x in w), tuple(x[1] for x in w), tuple(discount(*x) for x in p))
    return out


def asked(w: text.Words) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], list[np.ndarray]]:
    """The words of a block, and its distinct words and bigrams.

    Of each word the number of its bigram; of each bigram the numbers of its word and of the word before, all among the distinct ones.
    """
    word, _, pair = grams(w)
    words, of_word = np.unique(np.append(word, START), return_inverse=True)
    before = np.append(of_word[-1:], of_word[:-2])[: len(word)]
    before[w.first[:-1][w.first[:-1] < len(word)]] = of_word[-1]
    pairs, first, of_pair = np.unique(pair, return_index=True, return_inverse=True)
    return (of_pair, of_word[:-1][first], before[first]), [words, pairs]


def ratios(size: Sizes, numbers: tuple[np.ndarray, np.ndarray, np.ndarray], values: list[np.ndarray]) -> list[np.ndarray]:
    """The log-likelihood ratio of each word, by words alone and by bigrams; worked out once for each bigram."""
    pair, word, before = numbers
    about, n = values[0].astype(np.float64), values[1].astype(np.float64)

    def over(base: np.ndarray, n: np.ndarray, everything: np.ndarray, kinds: np.ndarray, discount: float) -> np.ndarray:
        rest = np.where(everything > 0, discount * kinds / np.maximum(everything, 1), 1.0)
        return np.maximum(n - discount, 0) / np.maximum(everything, 1)[before] + rest[before] * base

    alone, after = [], []
    for c in (0, 1):
        total = size.total[c]
        rest = size.word_discount[c] * size.kinds[c] / total if total else 1.0
        alone.append((np.maximum(about[c] - size.word_discount[c], 0) / max(total, 1) + rest / size.known)[word])
        shared = over(alone[c], n[0] + n[1], about[2] + about[3], about[6], size.discount[2])
        after.append(over(shared, n[c], about[2 + c], about[4 + c], size.discount[c]))
    return [np.log(x[1] / x[0])[pair] for x in (alone, after)]


def features(w: text.Words, values: list[np.ndarray], passages: tuple[int, ...] = PASSAGES) -> list[np.ndarray]:
    """Words of each text, means and tops of passages; a text shorter than a passage is one."""
    n = np.diff(w.first)
    sums = [np.concatenate([[0.0], np.cumsum(x)]) for x in values]
    means = [(s[w.first[1:]] - s[w.first[:-1]]) / np.maximum(n, 1) for s in sums]
    tops = []
    for length in passages:
        long = np.flatnonzero(n >= length)
        # the passages of a text are those that start at its words but for the last few
        edges = np.column_stack([w.first[:-1][long], w.first[1:][long] - length + 1]).ravel()
        for s, mean in zip(sums, means, strict=True):
            top = mean.copy()
            if len(long):
                found = (s[length:] - s[:-length]) / length
                top[long] = np.maximum.reduceat(np.append(found, -np.inf), np.minimum(edges, len(found)))[::2]
            tops.append(top)
    return [n, *means, *tops]


def measured(of_docs: DataFrame, stored: DataFrame, parts: tuple[int, int], known: dict[int, Sizes], column: str, carry: dict[str, str], passages: tuple[int, ...] = PASSAGES) -> DataFrame:
    """Of every row of the blocks: the columns ``carry`` (with their types), words, mean and top ratios."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, model, body in zip(*(batch.column(c).to_pylist() for c in ("block", "model", "body")), strict=True):
                _, keys_of = asked(read_block(body, column)[1])
                out: list[tuple] = []
                for shift, keys in enumerate(keys_of):
                    order, edge = dealt(keys, parts[shift])
                    out += [(2 * p + shift, block, model, pack(np.diff(keys[order[edge[p] : edge[p + 1]]], prepend=np.uint64(0)))) for p in np.flatnonzero(np.diff(edge))]
                part, of_block, by, keys = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(of_block, pa.int64()), pa.array(by, pa.int32()), pa.array(keys, pa.binary())], names=["part", "block", "model", "keys"])

    def answer(table: pa.Table, questions: pa.Table) -> pa.Table:
        part = questions.column("part")[0].as_py() if questions.num_rows else 0
        names = ABOUT_PAIR if part % 2 else ABOUT_WORD
        wide = 4 if part % 2 else len(ABOUT_WORD) * len(MODELS)
        keys = [unpack(x, np.uint64) for x in table.column("keys").to_pylist()]
        rows = [unpack(x).reshape(wide, -1) for x in table.column("rows").to_pylist()] if questions.num_rows else []
        own, values = np.concatenate([*keys, np.zeros(0, np.uint64)]).astype(np.uint64), np.concatenate([*rows, np.zeros((wide, 0), np.int64)], axis=1)
        order = np.argsort(own, kind="stable")  # few sorted runs, which are merged
        own, values = own[order], values[:, order] if rows else values
        found = []
        for model, x in zip(questions.column("model").to_pylist(), questions.column("keys").to_pylist(), strict=True):
            wanted = np.cumsum(unpack(x, np.uint64), dtype=np.uint64)
            out = np.zeros((len(names), len(wanted)), np.int64)
            if len(own):
                at = np.minimum(np.searchsorted(own, wanted), len(own) - 1)
                hit = own[at] == wanted
                if part % 2:
                    for c in (0, 1):
                        out[c, hit] = of(values, c, model)[at[hit]]
                else:
                    out[:, hit] = values[len(names) * model : len(names) * (model + 1), at[hit]]
            found.append(pack(out.ravel()))
        return pa.table({"block": questions.column("block"), "part": questions.column("part"), "found": pa.array(found, pa.binary())})

    def judge(of_block: pa.Table, answers: pa.Table) -> pa.Table:
        results = []
        found = dict(zip(answers.column("part").to_pylist(), answers.column("found").to_pylist(), strict=True))
        for model, body in zip(of_block.column("model").to_pylist(), of_block.column("body").to_pylist(), strict=True):
            rows, w = read_block(body, column)
            numbers, keys_of = asked(w)
            values = []
            for shift, (keys, names) in enumerate(zip(keys_of, (ABOUT_WORD, ABOUT_PAIR), strict=True)):
                order, edge = dealt(keys, parts[shift])
                values.append(np.zeros((len(names), len(keys)), np.int64))
                for p in np.flatnonzero(np.diff(edge)):
                    values[-1][:, order[edge[p] : edge[p + 1]]] = unpack(found[2 * p + shift]).reshape(len(names), -1)
            scores = features(w, ratios(known[model], numbers, values), passages)
            results.append(pa.table([*(rows.column(c).cast(out_schema.field(c).type) for c in carry), *(pa.array(x) for x in scores)], schema=out_schema))
        return pa.concat_tables(results) if results else out_schema.empty_table()

    schema = "".join(f"`{c}` {kind}, " for c, kind in carry.items()) + "words long, " + ", ".join(f"{x} double" for x in names_of(passages))
    out_schema = to_arrow_schema(of_docs.sparkSession.createDataFrame([], schema).schema)
    questions = of_docs.mapInArrow(ask, "part long, block long, model int, keys binary")
    answers = stored.groupBy("part").cogroup(questions.groupBy("part")).applyInArrow(answer, "block long, part long, found binary")
    return stage(of_docs.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(judge, schema), "measured")


@dataclass(frozen=True)
class Curve:
    """Weights of the two means, the two tops of passages of a length, the logarithm of the words, and a constant."""

    passage: int = PASSAGES[0]
    weights: tuple = (0.0,) * 6

    def inputs(self) -> list[str]:
        return ["mean_word", "mean_pair", f"top_word_{self.passage}", f"top_pair_{self.passage}", "ln(1 + words)", "1D"]


def logistic(x: np.ndarray, toxic: np.ndarray, passage: int) -> tuple[float, Curve]:
    """Loss and weights of the likeliest curve, each class smoothed by one document (Newton's steps)."""
    n1 = int(toxic.sum())
    n0, weights = len(toxic) - n1, np.zeros(x.shape[1])
    weights[-1] = math.log((n1 + 1) / (n0 + 1))
    y = np.where(toxic > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        z = np.clip(x @ w, -30, 30)
        return float((np.log1p(np.exp(z)) - y * z).sum()), 1 / (1 + np.exp(-z))

    now, p = loss(weights)
    for _ in range(20):
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(len(weights)), x.T @ (y - p) - 1e-3 * weights)
        for _ in range(4):
            then = loss(weights + step)
            if then[0] <= now:
                break
            step = step / 4
        if then[0] > now:
            break
        gain, weights, (now, p) = now - then[0], weights + step, then
        if gain < 1e-4 * (1 + now):
            break
    return now, Curve(passage, tuple(weights.tolist()))


def fitted(seen: DataFrame) -> Curve:
    """The likeliest curve of all lengths of passages, of scored documents (words, toxic, names_of(PASSAGES)), of which at most CURVE_ROWS are taken, by hash."""
    rows = seen.where("words > 0").select("words", "toxic", *names_of(PASSAGES)).orderBy(F.xxhash64("words", *names_of(PASSAGES)), "toxic").limit(CURVE_ROWS).toPandas()
    toxic = rows["toxic"].to_numpy(np.int64)
    n1 = int(toxic.sum())
    if not 0 < n1 < len(toxic):
        return Curve(weights=(*[0.0] * 5, math.log((n1 + 1) / (len(toxic) - n1 + 1))))
    same = [rows["mean_word"], rows["mean_pair"], np.log1p(rows["words"]), np.ones(len(rows))]

    def inputs(n: int) -> np.ndarray:
        return np.column_stack([*same[:2], rows[f"top_word_{n}"], rows[f"top_pair_{n}"], *same[2:]]).astype(np.float64)

    return min((logistic(inputs(n), toxic, n) for n in PASSAGES), key=lambda x: x[0])[1]


def judged(docs: DataFrame, labels: DataFrame, key: str, column: str, label: str = "toxic") -> DataFrame:
    """For each document its key, print (xxhash64 of its bytes), score, and log-ratios.

    A key with several labels counts as toxic if one of them says so; null labels and keys teach nothing. Without labels
    of both classes every text with words gets the same score.
    """
    spark, docs, column = docs.sparkSession, text.keyed(docs, key, column), "text"
    before = spark.conf.get(BATCH)
    spark.conf.set(BATCH, ROWS)
    try:
        with only_last_stays(spark):
            return _judged(spark, docs, labels, key, column, label)
    finally:
        spark.conf.set(BATCH, before)


def _judged(spark: SparkSession, docs: DataFrame, labels: DataFrame, key: str, column: str, label: str) -> DataFrame:
    truth = labels.where(F.col(f"`{label}`").isNotNull()).groupBy(F.col(f"`{key}`").alias("_k")).agg((F.max(F.col(f"`{label}`")) > 0).cast("int").alias("toxic"))
    # labels have no size bound, so they are never broadcast
    taught = squeezed(docs.where(fold(key) != HELD_OUT_FOLD)).join(truth.hint("merge"), F.col(key) == F.col("_k"))
    last = (fold(key) == CURVE_FOLD).cast("int")
    lessons = stage(taught.select(last.alias("model"), "toxic", F.col(column).alias("body")), "lessons")
    size, n_curve = lessons.agg(F.sum(F.octet_length("body")), F.count_if(F.col("model") == 1)).first()
    parts = (1 + (size or 0) // (2 * PART), 1 + (size or 0) // PART)
    share = min(1.0, CURVE_ROWS / max(n_curve, 1))
    some = lessons.where("model = 1").where(F.pmod(F.xxhash64("body"), F.lit(1 << 20)) < int(share * (1 << 20)))
    sample = blocks(some.select(F.col("body").alias("text"), "toxic"), "text", 0, "sample", packed=True)
    counted = [pair_counts(lessons, parts, i, TIMES) for i in range(TIMES)]
    forget(lessons)
    pairs = functools.reduce(DataFrame.unionByName, counted)
    table = word_counts(pairs)
    known = sizes(pairs, table)
    both_ = stage(table.select((2 * F.col("part")).alias("part"), "keys", "rows").unionByName(pairs.where("kind = 0").select((2 * F.col("part") + 1).alias("part"), "keys", "rows")), "counts")
    forget(table, *counted)
    seen = measured(sample, both_, parts, known, "text", {"toxic": "int"})
    best = fitted(seen)
    forget(sample, seen)
    kind, found = docs.select(f"`{key}`").schema[0].dataType.simpleString(), []
    for at in range(SLICES):
        with only_last_stays(spark):
            own = blocks(docs.where(F.pmod(F.xxhash64(key, "text"), F.lit(SLICES)) == at).withColumn("print", F.xxhash64("text")), "text", 1)
            found.append(measured(own, both_, parts, known, "text", {key: kind, "print": "long"}, (best.passage,)))
    raw = " + ".join(f"({w!r}D * {x})" for w, x in zip(best.weights, best.inputs(), strict=True))
    out = functools.reduce(DataFrame.unionByName, found).withColumn("raw", F.col(f"top_pair_{best.passage}"))
    out = out.withColumn("score", F.expr(f"IF(words = 0, 0D, 1 / (1 + exp(-({raw}))))"))
    return stage(out.select(key, "print", "score", "raw", F.col("mean_pair").alias("mean")), "scores")


def score(docs: DataFrame, labels: DataFrame, key: str = "doc_id", column: str = "text", label: str = "toxic", threshold: float = 0.3) -> DataFrame:
    """Every document's key, held_out, score (0 to 1) and predicted (1 from ``threshold`` on), with raw and mean log-ratios.

    ``raw`` is the bigrams' log-ratio per word of the most toxic passage, ``mean`` that of the whole text. A text
    without words scores 0. Every row stays, also with a null (never held out) or repeated key. Other columns are
    ignored; an empty table gives none.
    """
    out = judged(docs, labels, key, column, label)
    return out.select(key, F.coalesce(fold(key) == HELD_OUT_FOLD, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "raw", "mean")


def kept(docs: DataFrame, labels: DataFrame, key: str = "doc_id", column: str = "text", threshold: float = 0.3) -> DataFrame:
    """The documents that aren't predicted toxic, with all their rows and columns."""
    out = judged(docs, labels, key, column)
    gone = stage(out.where(F.col("score") >= threshold).select(F.col(key).alias("_k"), F.col("print").alias("_p")).distinct(), "toxic")
    print_ = F.xxhash64(docs[f"`{column}`"].cast("binary"))
    return docs.join(gone, docs[f"`{key}`"].eqNullSafe(gone["_k"]) & (print_ == gone["_p"]), "left_anti")
