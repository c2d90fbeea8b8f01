"""Token ids of byte-level vocabularies, with the same ids as the tokenizers library gives."""

from __future__ import annotations

import functools
import json

import numpy as np
import tiktoken
from tokenizers import Tokenizer

#: Fixed value: how byte-level tokenizers of this kind cut a text before they merge. It cuts as
#: 's|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+ does, and goes back over fewer characters.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"


def byte_letters() -> dict[str, int]:
    """Byte-level files write each byte as one printable letter: itself, or the next free one from U+0100 on."""
    shown = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Encoder:
    """Ids of whole texts as little-endian unsigned 32-bit integers.

    Each text goes through the merges in one call: looking up kept words one by one in Python took twice the time. A text
    that holds the string of a special token goes to the tokenizers library, which turns it into that token.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(letters[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        self.core = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=self.special)
        self.path = path

    @functools.cached_property
    def library(self) -> Tokenizer:
        return Tokenizer.from_file(self.path)

    def exact(self, text: str) -> bytes:
        return np.asarray(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def plain(self, text: str) -> bytes:
        try:  # without a list of numbers between; special tokens are named to the encoding since its search for none is slow
            return self.core.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()
        except Exception:  # the regex engine gives up on some very long runs
            return self.exact(text)

    def ids(self, texts: list[str]) -> list[bytes]:
        return [self.exact(t) if any(s in t for s in self.special) else self.plain(t) for t in texts]


@functools.lru_cache(4)
def encoder(path: str) -> Encoder:
    """One encoder per worker process and vocabulary file."""
    return Encoder(path)


def to_text(raw: bytes | None) -> str:
    return raw.decode("utf-8", "replace") if raw else ""
