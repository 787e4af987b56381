"""Token counts of whole texts, with a shortcut for words that are one token.

Before any text is read, every string of the vocabulary is merged alone; those
that come out as one token are proven to count as one wherever they are a whole
pre-token. Only the other pre-tokens are merged, by their character pairs, and
a character outside the vocabulary counts as its bytes.

Pre-tokens end before a run of spaces and around line breaks. That no token
reaches across such a place is proven on the vocabulary too, when it is loaded.

Null texts count as empty: no bytes and no tokens. Repeated rows are counted one
by one; only the named columns are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from operator import add

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderloom.llm.bpe import Bounded, merge
from orderloom.llm.common import tokenizer_file

FILE = "piece_bpe_32k.model"
#: Pre-tokens that a worker remembers besides the proven ones.
CACHED_WORDS = 250_000
SPACE = "▁"
_PRE_TOKENS = re.compile(" +[^ \n]*|\n|[^ \n]+")


class WholeTokenCounter(Bounded):
    """Counts by pre-token; the proven ones stay, the others may be forgotten."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.scores = {
            model.id_to_piece(i): -model.get_score(i)
            for i in range(model.get_piece_size())
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))
        }
        for piece in self.scores:
            if SPACE in piece.lstrip(SPACE) or "\n" in piece:
                raise ValueError(f"the token {piece!r} reaches across pre-tokens")
        super().__init__(self.merged, CACHED_WORDS)
        self.whole = {
            piece.replace(SPACE, " "): 1 for piece in self.scores if self.merged(piece.replace(SPACE, " ")) == 1
        }
        self.most += len(self.whole)
        self.update(self.whole)

    def clear(self) -> None:
        super().clear()
        self.update(self.whole)

    def merged(self, word: str) -> int:
        """Tokens of one pre-token by merging."""
        parts = merge(word.replace(" ", SPACE), self.scores, add)
        return sum(1 if part in self.scores else len(part.encode()) for part in parts)

    def count(self, text: str) -> int:
        if not text:
            return 0
        spaced = " " + text.replace(SPACE, " ")
        return sum(map(self.__getitem__, _PRE_TOKENS.findall(spaced)))


@lru_cache(maxsize=2)
def counter(path: str) -> WholeTokenCounter:
    return WholeTokenCounter(path)


def n_tokens(text: Column, path: str | None = None) -> Column:
    """Tokens of each text without begin or end tokens."""
    path = path or tokenizer_file(FILE)

    @F.pandas_udf("long")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokens = counter(path)
        for texts in batches:
            yield pd.Series([tokens.count(t or "") for t in texts], dtype="int64")

    return counted(text)


def token_counts(docs: DataFrame, limit: int = 4096, path: str | None = None) -> DataFrame:
    """doc_id, n_bytes, n_tokens and whether the count is over the limit."""
    text = F.coalesce("text", F.lit(""))
    counts = docs.select(
        "doc_id",
        F.octet_length(text).cast("long").alias("n_bytes"),
        n_tokens(F.col("text"), path).alias("n_tokens"),
    )
    return counts.withColumn("over_limit", F.col("n_tokens") > limit)
