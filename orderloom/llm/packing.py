"""Packing of token pieces into sequences by length patterns.

Documents become token ids with an end id; longer ones are cut into full pieces
behind a first piece that may be shorter. Packing looks at the histogram of
piece lengths only, which has at most one entry per possible length whatever the
number of documents: patterns of two or three lengths that fill a sequence are
enumerated, their repeat counts are fitted to the histogram by non-negative
least squares, rounded down and applied as far as pieces are left, and the
residual is packed by best fit, again on counts. Every piece then finds its
place from its rank among the pieces of its length.

Null texts count as empty and give one piece of the end id alone. Repeated rows
are packed one by one; a null doc_id stays null. An empty table gives no pieces.
Only doc_id and text are read, so other columns may have any name.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from orderloom.llm.bpe import Bounded
from orderloom.llm.common import slices, stored, tokenizer_file

RANK_FILE = "byte_bpe_50k.tiktoken"
END_TEXT, END_TEXT_ID = "<|endoftext|>", 50256
CACHED_CHUNKS = 150_000
#: A word with the space before it, or white space; words are split further by the vocabulary's own pattern.
_CHUNKS = re.compile(r" ?\S+|\s+(?!\S)|\s+")
#: Python takes these for white space, the vocabulary's pattern does not.
_NOT_SPACE = re.compile("[\x1c-\x1f]")
#: Rows that one window group should hold.
RANKED_ROWS = 100_000
#: Step between the middle lengths of three-piece patterns.
TRIPLE_STEP = 16
FIT_ROUNDS = 300
#: The residual is fitted again so often before it is packed by best fit.
FITS = 4

_ARROW = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
PIECES = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("piece", T.IntegerType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids", T.BinaryType()),
    ]
)


class ByteCodec:
    """Byte-level ids; words are remembered with the space before them."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        pattern = public_tokenizers.PATTERN
        self.encoding = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.chunks = Bounded(self._chunk, CACHED_CHUNKS)

    def _chunk(self, chunk: str) -> bytes:
        return np.array(self.encoding.encode_ordinary(chunk), dtype="<u4").tobytes()

    def _plain(self, text: str) -> bytes:
        if _NOT_SPACE.search(text):
            return self._chunk(text)
        return b"".join(map(self.chunks.__getitem__, _CHUNKS.findall(text)))

    def encode(self, text: str) -> bytes:
        special = np.array([END_TEXT_ID], dtype="<u4").tobytes()
        return special.join(map(self._plain, text.split(END_TEXT)))


@lru_cache(maxsize=2)
def codec(path: str) -> ByteCodec:
    return ByteCodec(path)


def token_pieces(docs: DataFrame, capacity: int = 1024, end_id: int = 2, path: str | None = None) -> DataFrame:
    """The pieces of every document with their ids as packed integers: doc_id, piece, start, length, ids."""
    path = path or tokenizer_file(RANK_FILE)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = codec(path), np.array([end_id], dtype="<u4").tobytes()
        for batch in slices(batches):
            rows = []
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
                ids = encoder.encode(text or "") + end
                n = len(ids) // 4
                starts = [0, *range(n % capacity or capacity, n, capacity)]
                for piece, (start, stop) in enumerate(zip(starts, [*starts[1:], n])):
                    rows.append((doc_id, piece, start, stop - start, ids[4 * start : 4 * stop]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(column, kind) for column, kind in zip(list(zip(*rows)) or [()] * 5, _ARROW)], names=PIECES.names
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, PIECES)


class Run(NamedTuple):
    """``repeats`` sequences of the same lengths; each length takes that many ranks from its first one on."""

    repeats: int
    lengths: tuple[int, ...]
    first_ranks: tuple[int, ...]


def filling_patterns(capacity: int, present: np.ndarray) -> np.ndarray:
    """Patterns of two or three present lengths that fill a sequence, as rows; pairs have a 0 in front."""
    here = np.zeros(capacity + 1, dtype=bool)
    here[present] = True
    low = np.arange(1, capacity // 2 + 1)
    pairs = np.column_stack([np.zeros_like(low), low, capacity - low])
    first, middle = np.meshgrid(np.arange(1, capacity), np.arange(TRIPLE_STEP, capacity, TRIPLE_STEP))
    last = capacity - first - middle
    triples = np.sort(np.column_stack([first.ravel(), middle.ravel(), last.ravel()])[last.ravel() > 0], axis=1)
    rows = np.unique(np.vstack([pairs, triples]), axis=0)
    return rows[(here[rows] | (rows == 0)).all(axis=1)]


def fit_repeats(patterns: np.ndarray, histogram: np.ndarray, rounds: int = FIT_ROUNDS) -> np.ndarray:
    """Non-negative least squares of the patterns' repeat counts by multiplicative updates."""
    wanted = histogram.astype(float)
    wanted[0] = 0
    target = wanted[patterns].sum(axis=1)
    x = target / (1 + 3 * np.bincount(patterns.ravel(), minlength=len(wanted))[patterns].max(axis=1))
    for _ in range(rounds):
        made = np.bincount(patterns.ravel(), weights=np.repeat(x, 3), minlength=len(wanted))
        made[0] = 0
        x *= target / np.maximum(made[patterns].sum(axis=1), 1e-9)
    return x


def plan(histogram: np.ndarray, capacity: int) -> list[Run]:
    """Runs of sequences that take every piece shorter than a sequence; ``histogram`` is indexed by length."""
    left = histogram.astype(np.int64).copy()
    taken = np.zeros_like(left)
    runs: list[Run] = []

    def take(lengths: tuple[int, ...], repeats: int) -> Run:
        ranks = []
        for length in lengths:
            ranks.append(int(taken[length]))
            taken[length] += repeats
            left[length] -= repeats
        return Run(repeats, lengths, tuple(ranks))

    for _ in range(FITS):
        patterns = filling_patterns(capacity, np.flatnonzero(left))
        if not len(patterns):
            break
        for row, fitted in zip(patterns.tolist(), np.floor(fit_repeats(patterns, left)).tolist()):
            lengths = tuple(length for length in row if length)
            repeats = int(min([fitted, *(left[length] // lengths.count(length) for length in lengths)]))
            if repeats > 0:
                runs.append(take(lengths, repeats))

    opened: dict[int, list[Run]] = {}
    for length in range(capacity - 1, 0, -1):
        while left[length] > 0:
            room = min((r for r in opened if r >= length), default=None)
            if room is None:
                fit = capacity // length
                repeats = int(left[length] // fit) or 1
                run = take((length,) * min(fit, int(left[length])), repeats)
                opened.setdefault(capacity - length * len(run.lengths), []).append(run)
                continue
            run = opened[room].pop()
            if not opened[room]:
                del opened[room]
            repeats = min(run.repeats, int(left[length]))
            if repeats < run.repeats:
                rest = tuple(rank + repeats for rank in run.first_ranks)
                opened.setdefault(room, []).append(Run(run.repeats - repeats, run.lengths, rest))
            more = take((length,), repeats)
            grown = Run(repeats, run.lengths + more.lengths, run.first_ranks + more.first_ranks)
            if room > length:
                opened.setdefault(room - length, []).append(grown)
            else:
                runs.append(grown)
    return runs + [run for group in opened.values() for run in group]


def slots(runs: list[Run]) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset), sorted by length and first rank."""
    rows, sequence = [], 0
    for run in runs:
        offset = 0
        for length, rank in zip(run.lengths, run.first_ranks):
            rows.append((length, rank, sequence, offset))
            offset += length
        sequence += run.repeats
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 4)


def _ranked(pieces: DataFrame, total: int) -> DataFrame:
    """Adds ``rank``, from 0 among the pieces of a length, without sorting a whole length in one task."""
    parts = max(8, -(-total // RANKED_ROWS))
    dealt = pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(parts)))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("length", "part").count().select(
        "length", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before")
    )
    within = Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32")
    numbered = dealt.withColumn("within", F.row_number().over(within) - 1)
    return numbered.join(starts, ["length", "part"]).withColumn("rank", F.col("before") + F.col("within"))


def _placed(table: np.ndarray, column: int, length: Column, rank: Column) -> Column:
    """The sequence (column 2) or offset (column 3) of a piece; the table has at most a few rows per length."""
    shift = 1 << 40
    keys, values, first = table[:, 0] * shift + table[:, 1], table[:, column], table[:, 1]

    @F.pandas_udf("long")
    def found(lengths: pd.Series, ranks: pd.Series) -> pd.Series:
        at = np.searchsorted(keys, lengths.to_numpy() * shift + ranks.to_numpy(), side="right") - 1
        moved = ranks.to_numpy() - first[at] if column == 2 else 0
        return pd.Series(values[at] + moved)

    return found(length, rank)


def pack(pieces: DataFrame, capacity: int = 1024) -> DataFrame:
    """Adds sequence_id and offset to pieces with doc_id, piece, start, length and ids_crc32.

    ``pieces`` is read more than once, so it should be a stored table.
    """
    histogram = np.zeros(capacity + 1, dtype=np.int64)
    for length, count in pieces.groupBy("length").count().collect():  # at most one row for each length
        histogram[length] = count
    whole = histogram[capacity]
    histogram[capacity] = 0
    runs = plan(histogram, capacity)
    table, sequences = slots(runs), sum(run.repeats for run in runs)
    columns = [*pieces.columns, "rank"]
    ranked = _ranked(pieces, int(histogram.sum() + whole)).select(*columns)
    full = F.col("length") == capacity
    parts = [ranked.where(full).withColumns({"sequence_id": F.col("rank") + sequences, "offset": F.lit(0).cast("long")})]
    if len(table):
        place = {name: _placed(table, i, F.col("length"), F.col("rank")) for i, name in ((2, "sequence_id"), (3, "offset"))}
        parts.append(ranked.where(~full).withColumns(place))
    packed = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return packed.drop("rank")


def pack_documents(docs: DataFrame, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of all pieces."""
    pieces = token_pieces(docs, capacity, end_id)
    light = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return pack(stored(light, "pieces"), capacity)
