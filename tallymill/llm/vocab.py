"""Token ids of public vocabularies inside tasks, equal to those of the libraries that own them.

Both encoders have a fast way for texts in a plain alphabet, where the pattern that splits text
is certain to agree between libraries, and hand every other text to the library itself.
Vocabulary files are read on the driver and travel in a broadcast (each below 2 MB).
"""

from __future__ import annotations

import base64
import json
import re
import unicodedata
from functools import cached_property

import public_tokenizers
from pyspark import Broadcast
from pyspark.sql import SparkSession

#: Characters on which every library agrees what is a letter, a digit or a blank.
PLAIN = "\t\n\r" + "".join(
    chr(c) for c in (*range(0x20, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100), 0x152, 0x153,
                     *range(0x2013, 0x2015), *range(0x2018, 0x201F), 0x2022, 0x2026, 0x20AC)
)
_PLAIN_TEXT = re.compile(f"[{re.escape(PLAIN)}]*")


def _of_kind(kind: str) -> str:
    return "".join(re.escape(c) for c in PLAIN if unicodedata.category(c)[0] == kind)


def is_plain(text: str) -> bool:
    return _PLAIN_TEXT.fullmatch(text) is not None


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class ByteEncoder:
    """Ids of a byte-level vocabulary: rank-file codec for plain texts, the library otherwise."""

    def __init__(self, library_json: str, ranks: dict[bytes, int]):
        import tiktoken

        self.text = library_json
        self.codec = tiktoken.Encoding(
            "ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.special = [t["content"] for t in json.loads(library_json)["added_tokens"]]

    @cached_property
    def library(self):
        """Made when the first text asks for it; most tasks never need it."""
        from tokenizers import Tokenizer

        return Tokenizer.from_str(self.text)

    def ids(self, text: str) -> list[int]:
        if is_plain(text) and not any(s in text for s in self.special):
            return self.codec.encode_ordinary(text)
        return self.library.encode(text, add_special_tokens=False).ids


def byte_signs() -> dict[str, int]:
    """The byte that each sign of a byte-level vocabulary file stands for: visible Latin-1
    characters are themselves, the other bytes are the characters from 256 on, in order."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + n): b for n, b in enumerate(hidden)}


class WordEncoder:
    """Ids of a lower-casing vocabulary with word ends.

    A plain text is split into words as the vocabulary's own pattern does, and the words are merged
    by a rank codec in which a line feed, which no word holds, stands for the word end: a byte with
    a word end ranks before all merges, as the vocabulary lists it. Other texts, and texts with a
    special string, go to the library whole.
    """

    END = "</w>"

    def __init__(self, library_json: str):
        import tiktoken

        self.text, own = library_json, json.loads(library_json)
        self.special = [t["content"] for t in own["added_tokens"]]
        letters, digits = _of_kind("L"), _of_kind("N")
        self.words = re.compile(
            f"'(?:s|t|re|ve|m|ll|d)|[{letters}]+|[{digits}]|[^\\s{letters}{digits}]+").findall
        signs, ranks = byte_signs(), {}
        for token, rank in own["model"]["vocab"].items():
            if token not in self.special:
                ends = token.endswith(self.END) and token != self.END
                own = token.removesuffix(self.END) if ends else token
                ranks[bytes(signs[c] for c in own) + b"\n" * ends] = rank
        self.codec = tiktoken.Encoding("words", pat_str=r"[^\n]+\n", mergeable_ranks=ranks, special_tokens={})

    @cached_property
    def library(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_str(self.text)

    def split(self, text: str) -> list[str] | None:
        """The words of a text, or None where only the library can tell."""
        if is_plain(text) and not any(s in text for s in self.special):
            return self.words(text.lower())
        return None

    def merged(self, words: list[str]) -> list[int]:
        return self.codec.encode_ordinary("\n".join(words) + "\n") if words else []

    def ids(self, text: str) -> list[int]:
        words = self.split(text)
        if words is None:
            return self.library.encode(text, add_special_tokens=False).ids
        return self.merged(words)


_LOADED: dict[tuple, object] = {}


def once(key: tuple, make):
    """One encoder per worker process: that of the vocabulary in use."""
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = make()
    return _LOADED[key]


def sent(spark: SparkSession, path: str) -> Broadcast:
    """A vocabulary file's text, sent to the executors once."""
    with open(path, encoding="utf-8") as file:
        return spark.sparkContext.broadcast(file.read())


def sent_ranks(spark: SparkSession, path: str) -> Broadcast:
    return spark.sparkContext.broadcast(read_ranks(path))
