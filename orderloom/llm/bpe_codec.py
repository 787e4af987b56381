"""Byte-pair encoding and decoding with a word-end vocabulary.

``encode`` gives each text's ids as little-endian unsigned 32-bit integers, and
``decode`` turns such ids back into text; both work on Arrow batches, so memory
is bounded by a batch and the word cache. Words are merged with the contiguous
rank arrays of ``bpe.py``.

Null texts count as empty and have no ids; null ids decode to empty text.
Special strings inside a text are special tokens, as in the library. Repeated
rows are encoded one by one. Letters are told from signs by the Unicode tables
of the ``regex`` module, which know some newer letters than the library does. Only the named column is read, so other columns
may have any name.
"""

from __future__ import annotations

import array
import json
import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderloom.llm.bpe import Bounded, merge, pair
from orderloom.llm.common import slices, tokenizer_file

FILE = "word_bpe_49k.json"
#: Chunks between white space that a worker remembers.
CACHED_CHUNKS = 250_000
#: Python splits at these too, the vocabulary's white space does not have them.
_NOT_SPACE = re.compile("[\x1c-\x1f]")
_SPACE = re.compile("[\t-\r \x85\xa0  -     　]+")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself if printable, else the next free one above 255."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in printable else next(spare)) for b in range(256)]


class WordCodec:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            loaded = json.load(file)
        model = loaded["model"]
        self.ids: dict[str, int] = dict(model["vocab"])
        self.end = model["end_of_word_suffix"]
        self.ranks = {tuple(pair): rank for rank, pair in enumerate(model["merges"])}
        self.special = {token["content"]: token["id"] for token in loaded["added_tokens"]}
        self.letters = byte_letters()
        everything = {**self.ids, **self.special}
        self.tokens = [""] * (max(everything.values()) + 1)
        for token, number in everything.items():
            self.tokens[number] = token
        words = loaded["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.words = regex.compile(words)
        self.specials = re.compile("|".join(map(re.escape, self.special)))
        self.chunks = Bounded(self._chunk, CACHED_CHUNKS)

    def word(self, word: str) -> list[int]:
        """Ids of one word; its last letter carries the word's end."""
        parts = [self.letters[b] for b in word.encode()]
        parts[-1] += self.end
        return [self.ids[part] for part in merge(parts, self.ranks, pair)]

    def _chunk(self, chunk: str) -> bytes:
        ids = [number for word in self.words.findall(chunk) for number in self.word(word)]
        return np.array(ids, dtype="<u4").tobytes()

    def _plain(self, text: str) -> bytes:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # sigma without its final form
        text = text.lower()
        chunks = _SPACE.split(text) if _NOT_SPACE.search(text) else text.split()
        return b"".join(map(self.chunks.__getitem__, chunks))

    def encode(self, text: str) -> bytes:
        if "<|" not in text:
            return self._plain(text)
        found, at = [], 0
        for hit in self.specials.finditer(text):
            found += [self._plain(text[at : hit.start()]), np.array([self.special[hit[0]]], dtype="<u4").tobytes()]
            at = hit.end()
        return b"".join([*found, self._plain(text[at:])])

    def decode(self, ids: bytes) -> str:
        numbers = array.array("I", ids)
        if sys.byteorder == "big":
            numbers.byteswap()
        return " ".join(map(self.tokens.__getitem__, numbers))


@lru_cache(maxsize=2)
def codec(path: str) -> WordCodec:
    return WordCodec(path)


def encode(text: Column, path: str | None = None) -> Column:
    """Ids of a text column as packed integers."""
    path = path or tokenizer_file(FILE)

    @F.pandas_udf("binary")
    def encoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        word_codec = codec(path)
        for texts in batches:
            yield pd.Series([word_codec.encode(t or "") for t in texts], dtype=object)

    return encoded(text)


def decode(ids: Column, path: str | None = None) -> Column:
    """Text of packed ids, special tokens included."""
    path = path or tokenizer_file(FILE)

    @F.pandas_udf("string")
    def decoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        word_codec = codec(path)
        for packed in batches:
            yield pd.Series([word_codec.decode(p or b"") for p in packed], dtype=object)

    return decoded(ids)


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Ids and decoded text of every document: doc_id, ids, decoded."""
    path = path or tokenizer_file(FILE)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word_codec = codec(path)
        for batch in slices(batches):
            ids = [word_codec.encode(text or "") for text in batch["text"].to_pylist()]
            decoded = [word_codec.decode(packed) for packed in ids]
            columns = [batch["doc_id"], pa.array(ids, pa.binary()), pa.array(decoded, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", "decoded"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(coded, "doc_id long, ids binary, decoded string")


def digests(trips: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return trips.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
