"""Nearest neighbours from an inverted multi-index.

Vectors are cut into two halves, and each half is assigned to the nearest of K
centroids, fitted on a bounded sample (``FIT_ROWS``). A cell is a pair of
centroids; all rows are indexed by their cell. A query walks the cells in order
of the summed distance of its halves to the two centroids, with a heap over
pairs, until the cells hold enough rows, and the rows of these cells are
reranked by their exact distance.

How many rows are enough is measured, not guessed: for ``AUDITED`` queries the
true neighbours are found by brute force over all rows, and the budget is the
number of rows after which ``RECALL`` of them have been met on the walk.

Cells are gathered into shards of at most about ``SHARD_ROWS`` rows; a larger
cell is dealt over several shards, so no group grows with the data. Queries are
dealt in the same way, by their own cell, into blocks of ``QUERY_BLOCK``, so that
the queries of a block visit much the same shards; a row is sent to the blocks
that visit its shard and to no others. Only statistics by cell, at most K * K
numbers, reach the driver.

Vectors that are null, zero or hold null or non-finite components and rows without
an identifier take no part. Each length of vectors has an index and a search of
its own. Rows with the query's identifier are not its candidates; a repeated query
is searched once, repeated candidates count one by one. Ties go to the smaller
identifier. Fewer candidates than asked for give fewer rows; an empty table
gives none. Only the named columns are read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from orderloom.llm.common import bounded_sample, slices, stored
from orderloom.llm.vectors import by_length, column, groups, matrix, proper_vectors

FIT_ROWS = 20_000
CELL_ROWS = 40
MOST_CENTROIDS = 256
AUDITED = 64
RECALL = 0.97
SHARD_ROWS = 4096
QUERY_BLOCK = 2048


def kmeans(rows: np.ndarray, k: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """Centroids of some rows; an empty cluster takes the row that lies farthest out."""
    draw = np.random.default_rng(seed)
    centroids = rows[draw.choice(len(rows), k, replace=False)].copy()
    for _ in range(rounds):
        gaps = _squared(rows, centroids)
        nearest, far = gaps.argmin(axis=1), gaps.min(axis=1)
        for c in range(k):
            own = nearest == c
            centroids[c] = rows[own].mean(axis=0) if own.any() else rows[far.argmax()]
            if not own.any():
                far[far.argmax()] = -1
    return centroids


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a**2).sum(axis=1)[:, None] - 2 * a @ b.T + (b**2).sum(axis=1)[None], 0)


class Codebooks(NamedTuple):
    """Centroids of both halves; a cell's number is first * K + second."""

    first: np.ndarray
    second: np.ndarray

    def halves(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cut = self.first.shape[1]
        return _squared(rows[:, :cut], self.first), _squared(rows[:, cut:], self.second)

    def cells(self, rows: np.ndarray) -> np.ndarray:
        a, b = self.halves(rows)
        return a.argmin(axis=1) * len(self.second) + b.argmin(axis=1)

    def walk(self, query: np.ndarray) -> Iterator[int]:
        """All cells by summed distance, one by one."""
        a, b = (half[0] for half in self.halves(query[None]))
        by_a, by_b = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
        queue, done = [(a[by_a[0]] + b[by_b[0]], 0, 0)], {(0, 0)}
        while queue:
            _, i, j = heapq.heappop(queue)
            yield int(by_a[i] * len(b) + by_b[j])
            for x, y in ((i + 1, j), (i, j + 1)):
                if x < len(a) and y < len(b) and (x, y) not in done:
                    done.add((x, y))
                    heapq.heappush(queue, (a[by_a[x]] + b[by_b[y]], x, y))


class MultiIndex(NamedTuple):
    """The codebooks, the rows with their cell and shard, rows per cell, and each cell's first shard and shard count."""

    books: Codebooks
    rows: DataFrame
    counts: np.ndarray
    first_shard: np.ndarray
    shards: np.ndarray


def fit_codebooks(vectors: DataFrame, total: int) -> Codebooks:
    """Fitted on ``FIT_ROWS`` rows, the first by a hash of their identifier."""
    rows = matrix(bounded_sample(vectors, FIT_ROWS, "vec_id").select("vector").toArrow())
    cut = rows.shape[1] // 2
    k = int(np.clip(2 ** round(np.log2(max(1.0, total / CELL_ROWS)) / 2), 1, min(MOST_CENTROIDS, len(rows))))
    return Codebooks(kmeans(rows[:, :cut], k), kmeans(rows[:, cut:], k))


def build(vectors: DataFrame, total: int) -> MultiIndex:
    """Index every row of vec_id and vector, a stored table."""
    books = fit_codebooks(vectors, total)
    size = len(books.first) * len(books.second)

    def assign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4096):
            yield batch.append_column("cell", pa.array(books.cells(matrix(batch)), pa.int32()))

    rows = stored(vectors.mapInArrow(assign, "vec_id long, vector array<double>, cell int"), "cells")
    counts = np.zeros(size, dtype=np.int64)
    for cell, count in rows.groupBy("cell").count().collect():  # at most K * K rows
        counts[cell] = count
    return MultiIndex(books, rows, counts, *dealt(counts, SHARD_ROWS))


def dealt(counts: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Cells gathered in order into groups of at most about ``most``: each cell's first group and number of groups."""
    parts = np.maximum(1, -(-counts // most))
    first, at, filled = np.zeros(len(counts), dtype=np.int64), 0, 0
    for cell in range(len(counts)):
        if parts[cell] > 1 or filled + counts[cell] > most:
            at, filled = at + (filled > 0), 0
        first[cell] = at
        filled += int(counts[cell])
        if parts[cell] > 1:
            at, filled = at + int(parts[cell]), 0
    return first, parts


def in_groups(rows: DataFrame, first: np.ndarray, parts: np.ndarray, key: str, name: str) -> DataFrame:
    """Rows with a cell, and the group that each is dealt to."""
    spread = pd.DataFrame({"cell": np.arange(len(first)), "first": first, "parts": parts})
    table = F.broadcast(rows.sparkSession.createDataFrame(spread))  # K * K rows
    return rows.join(table, "cell").withColumn(name, F.col("first") + F.pmod(F.xxhash64(key), F.col("parts"))).drop("first", "parts")


def _budget(index: MultiIndex, queries: DataFrame, k: int, total: int) -> int:
    """Rows to look at so that the walks of audited queries meet ``RECALL`` of the true neighbours."""
    audited = bounded_sample(queries, AUDITED, "vec_id").collect()
    if not audited:
        return total
    ids, wanted = np.array([r.vec_id for r in audited]), np.array([r.vector for r in audited])

    def nearest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 8192):
            gaps = _squared(wanted, matrix(batch))
            gaps[ids[:, None] == column(batch, "vec_id")[None]] = np.inf
            best = np.argsort(gaps, axis=1)[:, :k]
            kept = np.take_along_axis(gaps, best, axis=1)
            at, place = np.nonzero(np.isfinite(kept))
            yield pa.RecordBatch.from_arrays(
                [pa.array(at, pa.int32()), pa.array(kept[at, place]), pa.array(column(batch, "cell")[best[at, place]], pa.int32())],
                names=["query", "gap", "cell"],
            )

    found = index.rows.mapInArrow(nearest, "query int, gap double, cell int")
    best = Window.partitionBy("query").orderBy("gap")
    truth = found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k).select("query", "cell").collect()
    met = {q: np.zeros(len(index.counts), dtype=np.int64) for q in range(len(audited))}
    for q, ahead in met.items():
        total_ahead = 0
        for cell in index.books.walk(wanted[q]):
            total_ahead += int(index.counts[cell])
            ahead[cell] = total_ahead
    needed = sorted(int(met[row.query][row.cell]) for row in truth)
    return needed[min(len(needed) - 1, int(np.ceil(RECALL * len(needed))))] if needed else total


def search(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest rows by Euclidean distance.

    Both tables have vec_id and vector; ``vectors`` is read several times and should be stored.
    """
    total = vectors.count()
    if not total:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    index = build(vectors, total)
    queries = queries.groupBy("vec_id").agg(F.min("vector").alias("vector"))
    wanted, books, counts = _budget(index, queries, k, total), index.books, index.counts
    first, shards = index.first_shard, index.shards

    def visit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            for number, vector in zip(column(batch, "vec_id").tolist(), matrix(batch)):
                cells, met, home = {}, 0, -1
                for cell in books.walk(vector):
                    home = cell if home < 0 else home
                    if counts[cell]:
                        met += int(counts[cell])
                        for shard in range(first[cell], first[cell] + shards[cell]):
                            cells.setdefault(shard, []).append(cell)
                    if met >= wanted:
                        break
                out += [(number, home, shard, own) for shard, own in cells.items()]
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int32()))
            columns = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, kinds)], names=["vec_id", "cell", "shard", "cells"]
            )

    visits = stored(queries.mapInArrow(visit, "vec_id long, cell int, shard long, cells array<int>"), "visits")
    homes = np.zeros(len(counts), dtype=np.int64)
    for cell, count in visits.groupBy("cell").agg(F.count_distinct("vec_id")).collect():  # at most K * K rows
        homes[cell] = count
    visits = in_groups(visits, *dealt(homes, QUERY_BLOCK), "vec_id", "block")
    asked = visits.join(queries, "vec_id").select(
        "shard", "block", F.col("vec_id").alias("number"), "vector", "cells", F.lit(1).alias("side")
    )
    held = visited_rows(index, visits).select(
        "shard", "block", F.col("vec_id").alias("number"), "vector", F.array("cell").alias("cells"), F.lit(0).alias("side")
    )

    def rerank(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, ["shard", "block"]):
            side = column(group, "side")
            rows, asks = group.filter(pa.array(side == 0)), group.filter(pa.array(side == 1))
            if not rows.num_rows or not asks.num_rows:
                continue
            yield _nearest(rows, asks, k)

    both = held.unionByName(asked).repartition("shard", "block").sortWithinPartitions("shard", "block", "side", "number")
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = both.mapInArrow(rerank, "query_id long, vec_id long, score double").withColumn("rank", F.row_number().over(best))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def visited_rows(index: MultiIndex, visits: DataFrame) -> DataFrame:
    """The indexed rows with their shard, once for every block of queries that visits it."""
    blocks = visits.select("shard", "block").distinct()
    return in_groups(index.rows, index.first_shard, index.shards, "vec_id", "shard").join(blocks, "shard")


def _run_places(starts: np.ndarray) -> np.ndarray:
    """The place of every row in its run; ``starts`` marks the first rows."""
    first = np.flatnonzero(starts)
    return np.arange(len(starts)) - np.repeat(first, np.diff(np.r_[first, len(starts)]))


def _needed(vectors: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the rows that some query can need.

    Of equal vectors those with the smallest identifiers: k repeats of one, since no query takes more, and 2 k
    rows, since a query leaves out the rows of one identifier.
    """
    packed = np.ascontiguousarray(vectors).view(np.dtype((np.void, vectors.itemsize * vectors.shape[1]))).ravel()
    kind = np.unique(packed, return_inverse=True)[1].ravel()
    order = np.lexsort((ids, kind))
    by_kind, by_id = kind[order], ids[order]
    order = order[_run_places(np.r_[True, (by_kind[1:] != by_kind[:-1]) | (by_id[1:] != by_id[:-1])]) < k]
    by_kind = kind[order]
    return np.sort(order[_run_places(np.r_[True, by_kind[1:] != by_kind[:-1]]) < 2 * k])


def _nearest(rows: pa.Table, asks: pa.Table, k: int) -> pa.RecordBatch:
    """The k nearest of a shard's rows in the cells that each query visits, with exact distances.

    Rounded distances only rule out rows that k others beat by more than the rounding, so ties are all compared.
    """
    vectors, ids = matrix(rows), column(rows, "number")
    needed = _needed(vectors, ids, k)
    cells = rows["cells"].combine_chunks().flatten().to_numpy()[needed]
    vectors, ids = vectors[needed], ids[needed]
    known, place = np.unique(cells, return_inverse=True)
    length = np.sqrt((vectors**2).sum(axis=1))
    rounding = 4 * (vectors.shape[1] + 8) * np.finfo(float).eps
    out = []
    for at in range(0, asks.num_rows, 256):
        part = asks.slice(at, 256)
        wanted, numbers = matrix(part), column(part, "number")
        visited = np.zeros((len(numbers), len(known)), dtype=bool)
        for q, own in enumerate(part["cells"].to_pylist()):
            visited[q, np.searchsorted(known, np.intersect1d(own, known))] = True
        gaps = np.where(visited[:, place] & (numbers[:, None] != ids[None]), _squared(wanted, vectors), np.inf)
        slack = rounding * (np.sqrt((wanted**2).sum(axis=1))[:, None] + length[None]) ** 2
        most = min(k, len(ids))
        bound = np.partition(gaps + slack, most - 1, axis=1)[:, most - 1]
        for q in range(len(numbers)):
            own = np.flatnonzero(np.isfinite(gaps[q]) & (gaps[q] - slack[q] <= bound[q]))
            exact = np.sqrt(((vectors[own] - wanted[q]) ** 2).sum(axis=1))
            order = np.lexsort((ids[own], exact))[:k]
            out.append((np.full(len(order), numbers[q]), ids[own][order], exact[order]))
    return pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate(c), t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.float64()))],
        names=["query_id", "vec_id", "score"],
    )


def neighbours(embeddings: DataFrame, step: int = 100, k: int = 10) -> DataFrame:
    """The k nearest rows of every row whose vec_id is divisible by ``step``."""
    vectors = stored(proper_vectors(embeddings), "vectors")
    parts = ((part, part.where(F.col("vec_id") % step == 0)) for part in by_length(vectors))
    return reduce(DataFrame.unionByName, (search(part, queries, k) for part, queries in parts))
