"""Best-fit packing of token sequences.

Documents are packed by best-fit decreasing: longest first, each into the fullest sequence that still has room,
which a segment tree over the remaining capacities finds in logarithmic time. Documents of one length are alike to
the method, and it only ever needs to know how many there are. So the driver plans on the count of each length (at
most ``capacity`` numbers, whatever the corpus), moving groups of equal sequences at once, and the rows find their
places from their rank within their length.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattline.llm import tables, text, tokens

CAPACITY = 2048
END = 0
RANK_BITS = 44


class Room:
    """How many open sequences there are of each remaining capacity: a segment tree of sums."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.sums = [0] * (2 * self.size)
        self.groups: dict[int, list[tuple[int, int]]] = defaultdict(list)

    def add(self, room: int, first: int, n: int) -> None:
        if n > 0 and room > 0:
            self.groups[room].append((first, n))
            self._change(room, n)

    def take(self, room: int) -> tuple[int, int]:
        first, n = self.groups[room].pop()
        self._change(room, -n)
        return first, n

    def _change(self, room: int, by: int) -> None:
        at = self.size + room
        while at:
            self.sums[at] += by
            at >>= 1

    def tightest(self, need: int) -> int | None:
        """The smallest capacity of at least ``need`` that an open sequence has."""
        at = self.size + need
        if self.sums[at]:
            return need
        while at > 1:
            if at % 2 == 0 and self.sums[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at if self.sums[2 * at] else 2 * at + 1
                return at - self.size
            at >>= 1
        return None


def plan(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Best-fit decreasing over the number of documents of each length.

    Rows of (length, first rank, first sequence, documents per sequence, offset of the first): the documents of
    that length from that rank on fill that many sequences in turn, up to the next row of the length.
    """
    room, used, steps = Room(capacity), 0, []
    for length in sorted((k for k, n in counts.items() if n), reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"a length of {length} doesn't fit into {capacity}")
        left, rank = counts[length], 0
        while left:
            here = room.tightest(length)
            if here is None:
                first, n, here = used, -(-left // (capacity // length)), capacity
                used += n
            else:
                first, n = room.take(here)
            each = here // length
            whole = min(n, left // each)
            rest = left - whole * each if whole < n else 0
            rest = min(rest, each)
            if whole:
                steps.append((length, rank, first, each, capacity - here))
                room.add(here - each * length, first, whole)
                rank += whole * each
                left -= whole * each
            if rest:
                steps.append((length, rank, first + whole, each, capacity - here))
                room.add(here - rest * length, first + whole, 1)
                rank += rest
                left -= rest
                whole += 1
            room.add(here, first + whole, n - whole)
    return np.array(sorted(steps), np.int64).reshape(-1, 5)


def placed(steps: np.ndarray, length: Column, rank: Column) -> Column:
    """The sequence and offset of the document with this rank among those of its length."""
    keys = (steps[:, 0] << RANK_BITS) + steps[:, 1]

    @F.pandas_udf(T.StructType([T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]))
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        size, at = length.to_numpy(np.int64), rank.to_numpy(np.int64)
        step = steps[np.searchsorted(keys, (size << RANK_BITS) + at, "right") - 1]
        bin_, inside = np.divmod(at - step[:, 1], step[:, 3])
        return pd.DataFrame({"sequence_id": step[:, 2] + bin_, "offset": step[:, 4] + inside * size})

    return place(length, rank)


def pieces(docs: DataFrame, tokenizer: str, key: str = "doc_id", column: str = "text", capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """Tokens of whole texts, cut only where longer than ``capacity``: key, piece, start, length, ids.

    ``tokenizer`` is the file of a byte-level vocabulary. Every document ends with the id ``end``; a null text counts
    as empty and is that one id. Of a longer document the first piece takes what is left over and the others are
    full. ``ids`` are little-endian unsigned 32-bit integers. Rows with a null or repeated key are documents of their own.
    """
    kind = docs.schema[key].dataType
    schema = T.StructType([
        T.StructField(key, kind), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()),
        T.StructField("length", T.IntegerType()), T.StructField("ids", T.BinaryType()),
    ])
    tail = np.asarray([end], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        encode, out = tokens.encoder(tokenizer).ids, to_arrow_schema(schema)
        for rows, _, _ in text.blocks(batches):
            at, piece, start, length, ids = [], [], [], [], []
            for i, raw in enumerate(encode([tokens.to_text(x) for x in rows.column("text").to_pylist()])):
                raw += tail
                n = len(raw) // 4
                cuts = [0, *range(n % capacity or capacity, n + 1, capacity)] if n > capacity else [0, n]
                for k, (a, z) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    at.append(i), piece.append(k), start.append(a), length.append(z - a), ids.append(raw[4 * a : 4 * z])
            yield pa.RecordBatch.from_arrays(
                [rows.column(key).take(pa.array(at, pa.int32())).cast(out.field(0).type), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int32()), pa.array(ids, pa.binary())],
                schema=out,
            )

    return text.keyed(docs, key, column).mapInArrow(cut, schema)


def pack(rows: DataFrame, capacity: int = CAPACITY, length: str = "length") -> DataFrame:
    """Every row with the ``sequence_id`` and the ``offset`` at which its ``length`` tokens go.

    Sequences hold at most ``capacity`` tokens, without gaps from 0 on. Keeps all columns of ``rows``; only the narrow
    ones should be handed in, since rows are written once to the shared folder and shuffled. No row is left out, an
    empty table gives an empty result, and a null length or one outside 1 to ``capacity`` raises an error.
    """
    if taken := {"sequence_id", "offset", "rank", "_place"} & set(rows.columns):
        raise ValueError(f"columns {sorted(taken)} are made here; rename them first")
    kept = tables.numbered(rows, "pieces")
    order, sizes = tables.ranked(kept, length, kept.count())
    counts = {r[0]: r[1] for r in sizes.limit(capacity + 1).collect()}
    if None in counts:
        raise ValueError(f"{length} is null in some rows")
    steps = plan(counts, capacity)
    if not len(steps):
        return kept.drop(tables.ROW).selectExpr("*", "CAST(NULL AS BIGINT) AS sequence_id", "CAST(NULL AS BIGINT) AS offset")
    out = order.withColumn("_place", placed(steps, F.col(length), F.col("rank")))
    return out.select(*rows.columns, "_place.sequence_id", "_place.offset")
