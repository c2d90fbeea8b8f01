"""Vectors as short codes: a codebook for each of a few consecutive parts, refined in rounds, exact in whole numbers.

Assignment goes by norm-of-sum bounds. The codebooks of all rounds are kept. For each vector, part and group of entries a lower
bound on the distance to the group is stored with the round it was measured in. In a later round the bound less the largest true net
displacement of the group's entries between those two rounds still holds. A net displacement is at most the sum of the
drifts of the rounds between, and often far less, as entries go back and forth. The distance to the vector's own entry is exact; only groups
whose bound doesn't exceed it are scanned again.

Vectors travel in packed blocks; a round hands on every block with its bounds and the sums of its parts by entry, which Spark adds up. Only
codebooks (``entries`` vectors), and no rows, reach the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from wattline.lineage import only_last_stays, spread, stage
from wattline.llm import text

PARTS, ENTRIES, ROUNDS, SCALE, GROUPS = 4, 256, 4, 1024, 16
#: Numbers of components in a block of vectors.
BLOCK = 1 << 18
#: Components count as at most this, up or down, after scaling, so that squared distances fit 64 bits.
LIMIT = 1 << 24


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of x to all rows of y, both whole numbers."""
    top = int(np.abs(x).max(initial=0)) + int(np.abs(y).max(initial=0))
    if x.shape[1] * top * top < 1 << 53:  # every sum is a whole number that a double holds
        a, b = x.astype(np.float64), y.astype(np.float64)
        return ((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)).astype(np.int64)
    out = np.zeros((len(x), len(y)), np.int64)
    for i in range(x.shape[1]):
        out += (x[:, i, None] - y[:, i]) ** 2
    return out


@dataclass
class Bounds:
    """Of the vectors of a block for one part: their entries and, by group, lower bounds on the other entries and their rounds."""

    entry: np.ndarray
    error: np.ndarray
    lower: np.ndarray
    stamp: np.ndarray
    scanned: int = 0


@dataclass
class History:
    """The codebooks of one part in all rounds so far, and the groups of its entries."""

    books: list[np.ndarray]
    groups: list[np.ndarray] = field(default_factory=list)

    def __post_init__(self):
        if not self.groups:  # entries side by side along their main direction
            book = self.books[0].astype(np.float64)
            main = np.linalg.svd(book - book.mean(axis=0), full_matrices=False)[2][:1] if book.size else book[:1]
            order = np.argsort((book @ main.T).ravel() if book.size else np.zeros(len(book)), kind="stable")
            self.groups = [np.sort(x) for x in np.array_split(order, min(GROUPS, max(len(book), 1)))]

    def displaced(self) -> np.ndarray:
        """For each earlier round and each group the largest net displacement of an entry since."""
        moved = [np.sqrt(((self.books[-1] - b).astype(np.float64) ** 2).sum(axis=1)) for b in self.books]
        return np.array([[m[g].max(initial=0) for g in self.groups] for m in moved])


def first_look(x: np.ndarray, now: "Now") -> Bounds:
    n = len(x)
    return closest(x, now, Bounds(np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max), np.full((n, len(now.groups)), -1.0, np.float32), np.zeros((n, len(now.groups)), np.uint8)))


@dataclass(frozen=True)
class Now:
    """What a task needs of one part: the round, its codebook, the groups, and displacements since each earlier round."""

    round: int
    book: np.ndarray
    groups: list[np.ndarray]
    moved: np.ndarray


def closest(x: np.ndarray, now: Now, old: Bounds) -> Bounds:
    """The closest entry of each vector (of equal ones the first), scanning only groups whose bounds can't rule them out."""
    known = old.error < np.iinfo(np.int64).max
    own = ((x - now.book[old.entry]) ** 2).sum(axis=1)
    entry, error, scanned = np.where(known, old.entry, len(now.book)), np.where(known, own, np.iinfo(np.int64).max), len(x)
    held = old.lower - now.moved[old.stamp, np.arange(len(now.groups))]
    lower, stamp = old.lower.copy(), old.stamp.copy()
    need = np.sqrt(own)[:, None] * (1 + 1e-9) >= held
    need[~known] = True
    seen = []
    for g, members in enumerate(now.groups):
        rows = np.flatnonzero(need[:, g])
        if not len(rows):
            continue
        far = squared(x[rows], now.book[members])
        scanned += far.size
        at = far.argmin(axis=1)
        least = far[np.arange(len(rows)), at]
        far[np.arange(len(rows)), at] = np.iinfo(np.int64).max
        seen.append((g, rows, members[at], least, far.min(axis=1)))
        better = (least < error[rows]) | ((least == error[rows]) & (members[at] < entry[rows]))
        entry[rows[better]], error[rows[better]] = members[at][better], least[better]
    # the entry a vector left counts among its group's others again
    group_of = np.zeros(len(now.book), np.int64)
    for g, members in enumerate(now.groups):
        group_of[members] = g
    left = np.flatnonzero(known & (entry != old.entry))
    g = group_of[old.entry[left]]
    lower[left, g], stamp[left, g] = np.minimum(held[left, g], np.sqrt(own[left])) * (1 - 1e-6), now.round
    for g, rows, at, least, second in seen:
        others = np.where(at == entry[rows], second, least)
        lower[rows, g], stamp[rows, g] = np.sqrt(others.astype(np.float64)) * (1 - 1e-6), now.round
    return Bounds(entry, error, lower, stamp, scanned)


def parted(n: int) -> list[slice]:
    """Consecutive parts; if their lengths can't be equal, the first ones are longer by one."""
    edge = text.offsets_of(np.array([len(x) for x in np.array_split(np.arange(n), PARTS)]))
    return [slice(a, z) for a, z in zip(edge[:-1], edge[1:], strict=True)]


def packed(rows: DataFrame, dimension: int) -> DataFrame:
    """Blocks of vectors in whole numbers: ids, labels, vectors."""
    kinds = {c: rows.schema[c].dataType for c in ("id", "label")}
    schema = T.StructType([T.StructField("ids", T.ArrayType(kinds["id"])), T.StructField("labels", T.ArrayType(kinds["label"])), T.StructField("vectors", T.BinaryType())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = to_arrow_schema(schema), max(1, BLOCK // dimension)
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                b = batch.slice(at, size)
                whole = np.floor(b.column("vector").flatten().to_numpy(zero_copy_only=False) * SCALE)
                vectors = np.clip(whole, -LIMIT, LIMIT).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array([0, b.num_rows], pa.int32()), b.column(c)).cast(out.field(i).type) for i, c in enumerate(("id", "label"))]
                yield pa.RecordBatch.from_arrays([*lists, pa.array([vectors.tobytes()], pa.binary())], schema=out)

    return stage(rows.mapInArrow(pack, schema), "vectors")


STATE = ", entries binary, errors binary, lower binary, stamps binary, slots binary, sums binary, scanned long"


def assigned(blocks: DataFrame, now: list[Now], dimension: int, first: bool) -> DataFrame:
    """One round: blocks with their entries, bounds, and sums by slot (part and entry), stored."""
    kept = ["ids", "labels", "vectors"]
    schema = T.StructType([*(blocks.schema[c] for c in kept), *T._parse_datatype_string(STATE[2:]).fields])

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, cuts = to_arrow_schema(schema), parted(dimension)
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                vectors = np.frombuffer(row.column("vectors")[0].as_py(), np.int32).reshape(-1, dimension).astype(np.int64)
                n, done, slots, sums = len(vectors), [], [], []
                get = {} if first else {c: row.column(c)[0].as_py() for c in ("entries", "errors", "lower", "stamps")}
                at = 0
                for p, (cut, have) in enumerate(zip(cuts, now, strict=True)):
                    x, g = vectors[:, cut], len(have.groups)
                    if first:
                        b = first_look(x, have)
                    else:
                        entry, error = (np.frombuffer(get[c], np.int64)[p * n : (p + 1) * n] for c in ("entries", "errors"))
                        lower, stamp = np.frombuffer(get["lower"], np.float32), np.frombuffer(get["stamps"], np.uint8)
                        b = closest(x, have, Bounds(entry, error, lower[at : at + n * g].reshape(n, g), stamp[at : at + n * g].reshape(n, g)))
                    at += n * g
                    done.append(b)
                    used, inverse, count = np.unique(b.entry, return_inverse=True, return_counts=True)
                    order = np.argsort(inverse, kind="stable")
                    slots.append(np.column_stack([np.full(len(used), p), used, count]))
                    sums.append(np.add.reduceat(x[order], text.offsets_of(count)[:-1], axis=0).ravel())
                state = [np.concatenate([getattr(b, c).ravel() for b in done]) for c in ("entry", "error", "lower", "stamp")]
                values = [*(x.astype(k) for x, k in zip(state, (np.int64, np.int64, np.float32, np.uint8), strict=True)), np.concatenate(slots).astype(np.int64), np.concatenate(sums).astype(np.int64)]
                yield pa.RecordBatch.from_arrays([*(row.column(c) for c in kept), *(pa.array([x.tobytes()], pa.binary()) for x in values), pa.array([sum(b.scanned for b in done)], pa.int64())], schema=out)

    return stage(blocks.mapInArrow(step, schema), "round")


def refined(blocks: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """Codebooks whose used entries are the means, rounded down, of the parts they stand for."""
    cuts = [b.shape[1] for b in books]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros((len(b), w + 1), np.int64) for b, w in zip(books, cuts, strict=True)]
        for batch in batches:
            for slots, sums in zip(batch.column("slots").to_pylist(), batch.column("sums").to_pylist(), strict=True):
                slots, sums, at = np.frombuffer(slots, np.int64).reshape(-1, 3), np.frombuffer(sums, np.int64), 0
                for p, w in enumerate(cuts):
                    own = slots[slots[:, 0] == p]
                    total[p][own[:, 1], 0] += own[:, 2]
                    total[p][own[:, 1], 1:] += sums[at : at + len(own) * w].reshape(len(own), w)
                    at += len(own) * w
        for p, t in enumerate(total):
            used = np.flatnonzero(t[:, 0])
            place, entry = np.tile(np.arange(t.shape[1]), len(used)), np.repeat(used, t.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(entry), p)), pa.array(entry), pa.array(place), pa.array(t[used].ravel())], names=["part", "entry", "place", "total"])

    out = [np.zeros((len(b), w + 1), np.int64) for b, w in zip(books, cuts, strict=True)]
    parts = blocks.select("slots", "sums").mapInArrow(add, "part long, entry long, place long, total long")
    for r in parts.groupBy("part", "entry", "place").agg(F.sum("total").alias("total")).collect():  # as many numbers as the codebooks hold
        out[r.part][r.entry, r.place] = r.total
    return [np.where(t[:, :1] > 0, t[:, 1:] // np.maximum(t[:, :1], 1), b) for t, b in zip(out, books, strict=True)]


def codes(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """For each kept vector: key, code, error, label_error, codebooks_sha256.

    Left out are vectors that are null or empty, hold null or non-finite components, or have another length than most
    (of equally frequent lengths, the smallest counts). A component x becomes floor(1024 x), at most 2^24 up or down. Vectors are cut
    into four consecutive parts, the first ones longer by one where they can't be equal. Codebooks begin with the 256 smallest keys
    (all, if fewer), null keys last, repeated keys by their vectors. ``error`` sums the squared distances, ``label_error`` the
    errors of equal labels, nulls together. Repeated rows stay rows of their own; other columns are ignored; an empty table gives no rows.
    """
    with only_last_stays(vectors.sparkSession):
        return _codes(vectors, key, vector, label)


def _codes(vectors: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    rows = vectors.select(F.col(f"`{key}`").alias("id"), F.col(f"`{label}`").alias("label"), F.col(f"`{vector}`").cast("array<double>").alias("vector"))
    rows = rows.where("size(vector) > 0 AND forall(vector, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity'))")
    lengths = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    dimension = lengths[0].n if lengths else PARTS
    rows = rows.where(F.size("vector") == dimension)
    start = np.array([r.vector for r in rows.orderBy(F.col("id").asc_nulls_last(), "vector").limit(ENTRIES).collect()], np.float64).reshape(-1, dimension)
    start = np.clip(np.floor(start * SCALE), -LIMIT, LIMIT).astype(np.int64)
    blocks = packed(spread(rows), dimension)
    history = [History([start[:, cut]]) for cut in parted(dimension)]
    for r in range(ROUNDS + 1):
        now = [Now(r, h.books[-1], h.groups, h.displaced()) for h in history]
        blocks = assigned(blocks, now, dimension, r == 0)
        if r < ROUNDS:
            for h, book in zip(history, refined(blocks, [h.books[-1] for h in history]), strict=True):
                h.books.append(book)
    digest = hashlib.sha256(",".join(str(v) for h in history for v in h.books[-1].ravel().tolist()).encode()).hexdigest()
    kinds = {c: rows.schema[c].dataType for c in ("id", "label")}
    schema = T.StructType([T.StructField("id", kinds["id"]), T.StructField("label", kinds["label"]), T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = to_arrow_schema(schema)
        for batch in batches:
            for i in range(batch.num_rows):
                entry, error = (np.frombuffer(batch.column(c)[i].as_py(), np.int64).reshape(PARTS, -1) for c in ("entries", "errors"))
                written = [x.hex() for x in entry.T.astype(np.uint8)[:, None].copy().view(f"V{PARTS}").ravel().tolist()]
                yield pa.RecordBatch.from_arrays([*(batch.column(c)[i].values.cast(out.field(j).type) for j, c in enumerate(("ids", "labels"))), pa.array(written, pa.string()), pa.array(error.sum(axis=0))], schema=out)

    coded = stage(blocks.select("ids", "labels", "entries", "errors").mapInArrow(unpacked, schema), "coded")
    sums = stage(coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "_label"), "label_errors")
    out = coded.join(sums, F.col("label").eqNullSafe(F.col("_label")))
    return stage(out.select(F.col("id").alias(key), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256")), "codes")
