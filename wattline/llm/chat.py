"""Conversations as training text, with a loss mask over the tokens.

The template writes ``<|im_start|>role<|im_sep|>text<|im_end|>`` for each turn. Inside roles and texts every ``<|``
gets a backslash between its characters, one more where some are there already, so that no text holds a control
string and every text can be read back as it was. The three control strings are special tokens of the encoder.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import AddedToken, Tokenizer

from wattline.lineage import spread

START, MIDDLE, STOP = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
OPEN, SHUT = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
TURN = re.compile(r"<\|im_start\|>(.*?)<\|im_sep\|>(.*?)<\|im_end\|>", re.DOTALL)
#: Code points after which a conversation is encoded and passed on; control tokens part a text, so the ids stay the same.
PART = 1 << 20


def escape(text: str) -> str:
    return OPEN.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return SHUT.sub(r"<\1|", text)


@functools.lru_cache(4)
def encoder(path: str) -> Tokenizer:
    """The tokenizer with the control strings as tokens of their own."""
    t = Tokenizer.from_file(path)
    t.add_special_tokens([AddedToken(x, special=True, normalized=False) for x in (START, MIDDLE, STOP)])
    return t


def masked(starts: np.ndarray, ends: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """Which tokens share a character with a span; spans are sorted and apart from each other.

    The span that could hold a token is found by binary search for the token's start among the spans' ends.
    """
    if not len(spans):
        return np.zeros(len(starts), bool)
    at = np.searchsorted(spans[:, 1], starts, "right")
    near = np.minimum(at, len(spans) - 1)
    return (at < len(spans)) & (spans[near, 0] < ends) & (starts < ends)


def format_conversations(turns: DataFrame, tokenizer: str, role: str = "assistant", key: str = "conv_id", part: int = PART) -> DataFrame:
    """Whole conversations as text and tokens: key, part, n_turns, formatted, ids, offsets, mask.

    ``turns`` has the key, ``turn``, ``role`` and ``text``. Turns go by number, nulls first, ties by role and text; repeated
    rows stay. Null roles and texts count as empty; rows with a null key are one conversation. ``offsets`` are the
    tokens' starts in code points of ``formatted``, ``mask`` is true for tokens of texts whose role is ``role``. A
    conversation of more than ``part`` code points goes on in a further row, at a turn, so that none has to
    fit into memory as a whole. Other columns are ignored; an empty table gives an empty result.
    """
    schema = T.StructType([
        T.StructField(key, turns.schema[key].dataType), T.StructField("part", T.IntegerType()), T.StructField("n_turns", T.IntegerType()), T.StructField("formatted", T.StringType()),
        T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("offsets", T.ArrayType(T.IntegerType())), T.StructField("mask", T.ArrayType(T.BooleanType())),
    ])
    sorted_turns = spread(turns.select(F.col(key), F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")), key)
    sorted_turns = sorted_turns.sortWithinPartitions(F.col(key).asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text")

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        t, out = encoder(tokenizer), to_arrow_schema(schema)
        done: list[tuple] = []

        def close(conv, number: int, texts: list[str], spans: list[tuple[int, int]], turns: int) -> None:
            whole = "".join(texts)
            e = t.encode(whole, add_special_tokens=False)
            pairs = np.asarray(e.offsets, np.int64).reshape(-1, 2)
            done.append((conv, number, turns, whole, np.asarray(e.ids, np.int32), pairs[:, 0].astype(np.int32), masked(pairs[:, 0], pairs[:, 1], np.asarray(spans, np.int64).reshape(-1, 2))))

        def flush() -> pa.RecordBatch:
            cols = list(zip(*done, strict=True))
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, out, strict=True)], schema=out)

        conv, number, texts, spans, length, open_ = None, 0, [], [], 0, False
        for batch in batches:
            for c, r, x in zip(*(batch.column(n).to_pylist() for n in (key, "role", "text")), strict=True):
                if open_ and (c != conv or length >= part):
                    close(conv, number, texts, spans, len(texts))
                    number, texts, spans, length = number + 1 if c == conv else 0, [], [], 0
                    if len(done) >= 200:
                        yield flush()
                conv, open_, head, body = c, True, f"{START}{escape(r)}{MIDDLE}", escape(x)
                if r == role and body:
                    spans.append((length + len(head), length + len(head) + len(body)))
                texts.append(head + body + STOP)
                length += len(texts[-1])
        if open_:
            close(conv, number, texts, spans, len(texts))
        if done:
            yield flush()

    return sorted_turns.mapInArrow(render, schema)


def read_back(formatted: str) -> list[tuple[str, str]]:
    """The roles and texts that a formatted conversation was made of."""
    return [(unescape(r), unescape(x)) for r, x in TURN.findall(formatted)]


def loss_texts(formatted: str, offsets: list[int], mask: list[bool]) -> list[str]:
    """The texts under the mask, in order: each run of masked tokens, from its first to where the next token starts."""
    on = np.flatnonzero(np.diff(np.asarray([False, *mask, False], np.int8)))
    ends = [*offsets, len(formatted)]
    return [unescape(formatted[ends[a] : ends[z]]) for a, z in on.reshape(-1, 2)]
