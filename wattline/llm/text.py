"""Words, word hashes and Arrow helpers shared by the operators of this subpackage.

Texts travel as bytes: a column is cast to binary before it reaches Python, so invalid UTF-8 does no harm.
A word is a run of bytes other than space and 0x09 to 0x0D, which in UTF-8 is the same as a run of characters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GAP = np.zeros(256, bool)
GAP[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
BYTE_CODES = np.random.default_rng(20240501).integers(0, 2**64, 256, np.uint64)
BASES = {"byte": 0x9E3779B97F4A7C15, "word": 0xD1342543DE82EF95, "check": 0xAF251AF3B0F025B5}
#: Hashes are worked out for so many bytes or values at a time, which bounds memory and the tables of powers.
PIECE = 1 << 16
_POWERS: dict[str, tuple[np.ndarray, np.ndarray]] = {}


def powers(kind: str, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of a base modulo 2**64, and their inverses."""
    if kind not in _POWERS or len(_POWERS[kind][0]) < n:
        n = max(n, 1 << 16)
        out = []
        for b in (BASES[kind], pow(BASES[kind], -1, 2**64)):
            p = np.full(n, b, np.uint64)
            p[0] = 1
            out.append(np.cumprod(p, dtype=np.uint64))
        _POWERS[kind] = (out[0], out[1])
    return _POWERS[kind]


def mix(x: np.ndarray) -> np.ndarray:
    """Scatter 64-bit values so that near values share nothing."""
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


def runs(values: np.ndarray, k: int, kind: str = "word") -> np.ndarray:
    """A hash of every k consecutive values."""
    n = len(values)
    if n < k:
        return np.zeros(0, np.uint64)
    out, step = np.empty(n - k + 1, np.uint64), max(PIECE, k)
    for at in range(0, len(out), step):
        own = values[at : at + step + k - 1]
        up, down = powers(kind, len(own) + 1)
        total = np.zeros(len(own) + 1, np.uint64)
        np.cumsum(own * up[: len(own)], out=total[1:])
        out[at : at + step] = mix((total[k:] - total[:-k]) * down[: len(own) - k + 1])
    return out


class Words:
    """The words of some texts: byte data, word starts and ends, and where each text's words begin."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False, between: np.ndarray = GAP):
        self.data = LOWER[data] if lower else data
        n = len(data)
        gap = np.ones(n + 2, bool)
        gap[1:-1] = between[data]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        word = ~gap[1:-1]
        self.starts = np.flatnonzero(word & (gap[:n] | edge[:n]))
        self.ends = np.flatnonzero(word & (gap[2:] | edge[1:])) + 1
        self.first = np.searchsorted(self.starts, offsets)

    def hashes(self) -> np.ndarray:
        """One 64-bit hash for each word."""
        out = np.empty(len(self.starts), np.uint64)
        up, down = powers("byte", PIECE + 1)
        at = 0
        while at < len(out):
            base = self.starts[at]
            to = max(at + 1, int(np.searchsorted(self.ends, base + PIECE, "right")))
            data, starts, ends = self.data[base : self.ends[to - 1]], self.starts[at:to] - base, self.ends[at:to] - base
            sums = np.zeros(1, np.uint64)
            if len(data) > PIECE:  # one word longer than a piece
                for i in range(0, len(data), PIECE):
                    part = data[i : i + PIECE]
                    sums += np.sum(BYTE_CODES[part] * up[: len(part)], dtype=np.uint64, keepdims=True) * np.uint64(pow(BASES["byte"], i, 2**64))
            else:
                total = np.zeros(len(data) + 1, np.uint64)
                np.cumsum(BYTE_CODES[data] * up[: len(data)], out=total[1:])
                sums = (total[ends] - total[starts]) * down[starts]
            out[at:to] = mix(sums + (ends - starts).astype(np.uint64))
            at = to
        return out


def blocks(batches: Iterator[pa.RecordBatch], text: str = "text", size: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cut batches into runs of rows with about ``size`` bytes of text: the rows, the bytes and the row offsets.

    A longer text makes a block of its own and is never cut. Nulls count as empty.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(text).cast(pa.large_binary())
        if column.null_count:
            column = column.fill_null(b"")
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
            own = offsets[at : to + 1]
            yield batch.slice(at, to - at), data[own[0] : own[-1]], own - own[0]
            at = to


def keyed(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The key and the text as bytes, without any other column."""
    return docs.select(F.col(f"`{key}`").alias(key), F.col(f"`{text}`").cast("binary").alias("text"))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def offsets_of(counts: np.ndarray) -> np.ndarray:
    out = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=out[1:])
    return out


def lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """A list column from flat values and the length of each list."""
    return pa.ListArray.from_arrays(pa.array(offsets_of(counts).astype(np.int32)), pa.array(values))
