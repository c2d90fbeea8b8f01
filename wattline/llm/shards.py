"""Token ids in training order: fixed-stride binary shards in a keyed random order.

The documents' tokens, each document ended by one id, form one long row of sequences of equal length. A keyed Feistel
network over the next power of four, walked along its cycles until it falls inside, turns the sequence's number into its
slot, so the order is a permutation that nobody has to store or sort. Shard and place in the file follow
from the slot by division, and a reader can begin at any slot.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattline.lineage import fresh_dir, stage
from wattline.llm import text, tokens

LENGTH, PER_SHARD, ROUNDS = 2048, 4096, 6
WIDTHS = {2: "<u2", 4: "<u4"}


def round_keys(key: str) -> np.ndarray:
    return np.frombuffer(hashlib.blake2b(key.encode(), digest_size=8 * ROUNDS).digest(), "<u8").copy()


def permuted(index: np.ndarray, n: int, key: str, back: bool = False) -> np.ndarray:
    """The slot of each number below n, or with ``back`` the number at each slot."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    low, shift = np.uint64((1 << half) - 1), np.uint64(half)
    keys = round_keys(key)

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> shift, x & low
        for k in keys[::-1] if back else keys:
            if back:
                left, right = right ^ (text.mix(left ^ k) & low), left
            else:
                left, right = right, left ^ (text.mix(right ^ k) & low)
        return left << shift | right

    out = once(np.asarray(index, np.uint64))
    while (far := out >= np.uint64(n)).any():
        out[far] = once(out[far])
    return out.astype(np.int64)


SPLIT = ["file", "block", "task"]


def encoded(docs: DataFrame, tokenizer: str, key: str, column: str, end: int, width: int) -> DataFrame:
    """Each document's ids, the piece of a file (or else the task) it comes from and where they begin among the ids of that."""
    schema = T.StructType([
        T.StructField(key, docs.schema[key].dataType), T.StructField("file", T.StringType()), T.StructField("block", T.LongType()), T.StructField("task", T.IntegerType()),
        T.StructField("at", T.LongType()), T.StructField("n", T.LongType()), T.StructField("ids", T.BinaryType()),
    ])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_schema

        task, at, out = TaskContext.get().partitionId(), {}, to_arrow_schema(schema)
        of, tail = tokens.encoder(tokenizer).ids, np.asarray([end], "<u4").tobytes()
        for rows, _, _ in text.blocks(batches):
            raw = of([tokens.to_text(x) for x in rows.column("text").to_pylist()])
            sizes = np.array([len(x) // 4 + 1 for x in raw])
            packed = np.frombuffer(tail.join([*raw, b""]), "<u4").astype(WIDTHS[width]).tobytes()
            edge = (text.offsets_of(sizes) * width).tolist()
            begin, splits = [], list(zip(rows.column("file").to_pylist(), rows.column("block").to_pylist(), strict=True))
            for split, n in zip(splits, sizes.tolist(), strict=True):
                begin.append(at.get(split, 0))
                at[split] = begin[-1] + n
            ids = [packed[a:z] for a, z in zip(edge[:-1], edge[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([rows.column(key).cast(out.field(0).type), rows.column("file"), rows.column("block"), pa.array([task] * len(begin), pa.int32()), pa.array(begin, pa.int64()), pa.array(sizes), pa.array(ids, pa.binary())], schema=out)

    own = docs.select(F.col(f"`{key}`").alias(key), F.col(f"`{column}`").cast("binary").alias("text"), F.input_file_name().alias("file"), F.input_file_block_start().alias("block"))
    return own.mapInArrow(encode, schema)


def resolved(spark: SparkSession, folder: str) -> str:
    """The folder with the scheme that Spark gives it, for the workers' own writers and readers."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    whole = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return "file://" + whole[5:] if whole.startswith("file:/") and not whole.startswith("file://") else whole


def materialise(docs: DataFrame, tokenizer: str, order_key: str, folder: str | None = None, key: str = "doc_id", column: str = "text", length: int = LENGTH, per_shard: int = PER_SHARD, end: int = 0, width: int = 2) -> DataFrame:
    """Write the shards and return their index: slot, sequence, shard, position, keys, n_tokens, ids_crc32.

    ``folder`` (default: a new one in the shared folder) gets ``shard-NNNNNN.bin`` files of ``per_shard`` records and a
    ``manifest``; a record holds ``length`` ids of ``width`` bytes and starts at byte ``position`` of its shard. The last
    sequence is filled up with ``end``. ``keys`` are the documents in the sequence, in order, ``n_tokens`` the ids without
    filling. A null text is an empty document of one ``end``; rows with a null or repeated key are documents of their
    own; an empty table gives no shard. Every shard is written aside and then renamed, so a task may be run again.
    """
    spark = docs.sparkSession
    folder = resolved(spark, folder or fresh_dir(spark, "shards"))
    path = fresh_dir(spark, "ids")  # the largest table here, read once more: it is worth a closer packing
    packing = {"compression": "zstd", "parquet.compression.codec.zstd.level": "9", "parquet.page.size": str(4 << 20)}  # level 9 gains on 6 only with larger pages
    encoded(docs, tokenizer, key, column, end, width).write.options(**packing).parquet(path)
    staged = spark.read.parquet(path)
    per_split = staged.groupBy(*SPLIT).agg(F.sum("n").alias("n"))
    parts = stage(per_split.selectExpr(*SPLIT, "n", "sum(n) OVER (ORDER BY file, block, task) - n AS base"), "parts")
    total = parts.agg(F.sum("n")).first()[0] or 0
    count = -(-total // length)
    shards = max(1, -(-count // per_shard))
    kind = docs.schema[key].dataType
    piece_schema = T.StructType([T.StructField("shard", T.LongType()), T.StructField("slot", T.LongType()), T.StructField("sequence", T.LongType()), T.StructField("place", T.IntegerType()), T.StructField(key, kind), T.StructField("n", T.IntegerType()), T.StructField("ids", T.BinaryType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        out = to_arrow_schema(piece_schema)
        squeeze = zstandard.ZstdCompressor(level=4).compress
        for batch in batches:
            doc, sequence, place, sizes, packed = [], [], [], [], []
            for i, (at, ids) in enumerate(zip(batch.column("start").to_pylist(), batch.column("ids").to_pylist(), strict=True)):
                to, begin = at + len(ids) // width, at
                while begin < to:
                    seq, inside = divmod(begin, length)
                    stop = min(to, (seq + 1) * length)
                    chunk = ids[(begin - at) * width : (stop - at) * width]
                    doc.append(i), sequence.append(seq), place.append(inside), sizes.append(stop - begin), packed.append(squeeze(chunk))
                    begin = stop
            if not doc:
                continue
            slot = permuted(np.asarray(sequence), count, order_key)
            yield pa.RecordBatch.from_arrays([pa.array(slot // per_shard), pa.array(slot), pa.array(sequence, pa.int64()), pa.array(place, pa.int32()), batch.column(key).take(pa.array(doc, pa.int32())).cast(out.field(4).type), pa.array(sizes, pa.int32()), pa.array(packed, pa.binary())], schema=out)

    placed = staged.join(parts.select(*SPLIT, "base"), SPLIT).select(key, (F.col("base") + F.col("at")).alias("start"), "ids").mapInArrow(cut, piece_schema)
    sorted_ = placed.repartitionById(shards, F.col("shard").cast("int")).sortWithinPartitions("shard", "slot", "place")
    index = T.StructType([T.StructField("slot", T.LongType()), T.StructField("sequence", T.LongType()), T.StructField("shard", T.LongType()), T.StructField("position", T.LongType()), T.StructField("keys", T.ArrayType(kind)), T.StructField("n_tokens", T.IntegerType()), T.StructField("ids_crc32", T.LongType())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        out, open_ = to_arrow_schema(index), zstandard.ZstdDecompressor().decompress
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        fill = np.asarray([end], WIDTHS[width]).tobytes()
        rows: list[tuple] = []
        now, file, name, aside, record, docs_, number = None, None, "", "", b"", [], 0

        def finish_record() -> None:
            nonlocal record, docs_
            shard, slot = now
            rows.append((slot, number, shard, (slot - shard * per_shard) * length * width, docs_, len(record) // width, zlib.crc32(record)))
            file.write(record + fill * (length - len(record) // width))
            record, docs_ = b"", []

        def finish_file() -> None:
            file.close()
            fs.move(aside, name)

        for batch in batches:
            for shard, slot, seq, doc, raw in zip(*(batch.column(c).to_pylist() for c in ("shard", "slot", "sequence", key, "ids")), strict=True):
                if now != (shard, slot):
                    if now is not None:
                        finish_record()
                    if now is None or now[0] != shard:
                        if file is not None:
                            finish_file()
                        name, aside = f"{root}/shard-{shard:06d}.bin", f"{root}/.shard-{shard:06d}-{uuid.uuid4().hex}"
                        file = fs.open_output_stream(aside)
                    now, number = (shard, slot), seq
                record += open_(raw)
                docs_.append(doc)
            if len(rows) >= 500:
                cols = list(zip(*rows, strict=True))
                rows.clear()
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, out, strict=True)], schema=out)
        if now is not None:
            finish_record()
            finish_file()
        if rows:
            cols = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, out, strict=True)], schema=out)

    result = stage(sorted_.mapInArrow(write, index), "index")
    manifest = {"sequences": count, "tokens": total, "length": length, "per_shard": per_shard, "width": width, "end": end, "key": order_key}
    spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/manifest")
    return result


def read_from(spark: SparkSession, folder: str, slot: int = 0, until: int | None = None) -> DataFrame:
    """The records from a slot on, in training order: slot, sequence, ids. Reads only the bytes after that slot."""
    folder = resolved(spark, folder)
    m = json.loads(spark.read.text(f"{folder}/manifest").first()[0])
    until = m["sequences"] if until is None else min(until, m["sequences"])
    stride, per, length = m["length"] * m["width"], m["per_shard"], m["length"]
    first, last = slot // per, max(slot // per, -(-until // per))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for shard in batch.column("id").to_pylist():
                begin, stop = max(slot, shard * per), min(until, (shard + 1) * per)
                with fs.open_input_file(f"{root}/shard-{shard:06d}.bin") as f:
                    f.seek((begin - shard * per) * stride)
                    for at in range(begin, stop, 256):
                        n = min(256, stop - at)
                        ids = np.frombuffer(f.read(n * stride), WIDTHS[m["width"]]).astype(np.int32)
                        slots = np.arange(at, at + n)
                        yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array(permuted(slots, m["sequences"], m["key"], back=True)), text.lists(ids, np.full(n, length))], names=["slot", "sequence", "ids"])

    if slot >= until:
        return spark.createDataFrame([], "slot long, sequence long, ids array<int>")
    return spark.range(first, last, numPartitions=last - first).mapInArrow(read, "slot long, sequence long, ids array<int>")
