"""Vector operators against brute force."""

import numpy as np
import pyarrow as pa
import pytest
from orderloom.llm import components, multi_index, nn_descent
from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("vec_id", T.LongType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        *(T.StructField(name, T.IntegerType()) for name in ("label", "vector", "cell", "other", "shard", "links")),
    ]
)


@pytest.fixture(scope="module")
def make_vectors(spark):
    def make(rows):
        return spark.createDataFrame([(i, v, 1, 2, 3, 4, 5, 6) for i, v in rows], SCHEMA).repartition(3)

    return make


BAD = [None, [], [0.0] * 16, [float("nan")] + [1.0] * 15, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15, [1.0] * 3]


def crowd(seed=3, n=500, size=16):
    """Loose points, a tight crowd of 60, pairs, and copies."""
    draw = np.random.default_rng(seed)
    loose = draw.normal(size=(n, size))
    centre = draw.normal(size=size)
    tight = centre + 0.12 * draw.normal(size=(60, size))
    pairs = loose[:40] + 0.1 * draw.normal(size=(40, size))
    copies = np.repeat(loose[50:53], 7, axis=0)
    points = np.vstack([loose, tight, pairs, copies]).astype(np.float32)
    return list(enumerate(points.tolist()))


def plain_links(rows, threshold=0.9):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], dtype=np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    linked = x @ x.T >= threshold
    root = dict(zip(ids.tolist(), ids.tolist()))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in zip(*np.nonzero(linked)):
        a, b = find(int(ids[a])), find(int(ids[b]))
        if a != b:
            root[max(a, b)] = min(a, b)
    return {int(i): (int(n) - 1, find(int(i))) for i, n in zip(ids, linked.sum(axis=1))}


@pytest.mark.parametrize("block", [1024, 16])
def test_near_duplicates_equal_brute_force(make_vectors, monkeypatch, block):
    monkeypatch.setattr(nn_descent, "PAIR_BLOCK", block)
    rows = crowd()
    found = nn_descent.near_duplicates(make_vectors([*rows, *((1000 + i, v) for i, v in enumerate(BAD))]), width=6).collect()
    assert len(found) == len(rows) + len(BAD)
    wanted = {**plain_links(rows), **{1000 + i: (0, 1000 + i) for i in range(len(BAD))}}
    assert {r.vec_id: (r.n_links, r.component_id) for r in found} == wanted
    assert all(r.kept == (r.vec_id == r.component_id) for r in found)


@pytest.mark.parametrize("centres", [4096, 2])
def test_groups_whose_lists_are_full_are_linked_with_each_other(make_vectors, monkeypatch, centres):
    """Three tight groups, the second linked with both others; every list of ten holds its own group only."""
    monkeypatch.setattr(nn_descent, "CENTRES", centres, raising=False)
    draw = np.random.default_rng(8)
    axes = np.linalg.qr(draw.normal(size=(16, 16)))[0]
    turn = np.arccos(0.92)
    middles = [np.cos(k * turn) * axes[0] + np.sin(k * turn) * axes[1] for k in range(3)] + list(axes[2:5])
    points = np.vstack([m + 0.004 * draw.normal(size=(30, 16)) for m in middles])
    rows = list(enumerate(points.astype(np.float32).tolist()))
    wanted = plain_links(rows)
    assert {c for _, c in wanted.values()} == {0, 90, 120, 150} and wanted[0][0] == 59 and wanted[30][0] == 89
    found = nn_descent.near_duplicates(make_vectors(rows)).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in found} == wanted
    assert sum(r.kept for r in found) == 4


def test_rare_links_are_found(make_vectors, monkeypatch):
    """Planted pairs just above the threshold among many loose vectors, in blocks that are short for them."""
    monkeypatch.setattr(nn_descent, "BLOCK", 8)
    draw = np.random.default_rng(9)
    loose = draw.normal(size=(6000, 48))
    loose /= np.linalg.norm(loose, axis=1, keepdims=True)
    aside = draw.normal(size=(150, 48))
    aside -= (aside * loose[:150]).sum(axis=1, keepdims=True) * loose[:150]
    aside /= np.linalg.norm(aside, axis=1, keepdims=True)
    rows = list(enumerate(np.vstack([loose, 0.905 * loose[:150] + np.sqrt(1 - 0.905**2) * aside]).tolist()))
    found = {r.vec_id: r.component_id for r in nn_descent.near_duplicates(make_vectors(rows)).collect()}
    assert len(found) == len(rows)
    assert sum(found[6000 + i] == i for i in range(150)) >= 147


def test_a_recall_that_is_not_reached_fails(make_vectors, monkeypatch):
    monkeypatch.setattr(nn_descent, "MOST_ROUNDS", 2)
    monkeypatch.setattr(nn_descent, "audit", lambda *_: (0.5, 100))
    with pytest.raises(RuntimeError, match="2 rounds"):
        nn_descent.near_duplicates(make_vectors(crowd(n=80)), width=6).collect()


def test_near_duplicates_of_odd_tables(make_vectors):
    assert nn_descent.near_duplicates(make_vectors([])).count() == 0
    only_bad = nn_descent.near_duplicates(make_vectors(list(enumerate(BAD[:6])))).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in only_bad) == [(i, 0, i, True) for i in range(6)]
    one = [(5, [1.0] * 16), (None, [1.0] * 16), (5, [1.0] * 16), (9, [2.0] * 16)]
    found = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in nn_descent.near_duplicates(make_vectors(one)).collect()), key=repr)
    assert found == [(5, 2, 5, True), (5, 2, 5, True), (9, 2, 5, False), (None, 0, None, True)]


def test_search_recall_and_order(make_vectors):
    rows = crowd(n=3000)
    found = multi_index.neighbours(make_vectors([*rows, *((10_000 + i, v) for i, v in enumerate(BAD))])).collect()
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], dtype=np.float32).astype(float)
    hits = 0
    queries = [i for i in ids.tolist() if i % 100 == 0]
    for q in queries:
        own = sorted((r for r in found if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in own] == list(range(1, 11))
        assert [(r.score, r.vec_id) for r in own] == sorted((r.score, r.vec_id) for r in own)
        gaps = np.sqrt(((x - x[ids == q][0]) ** 2).sum(axis=1))
        for r in own:
            assert r.vec_id != q and r.score == gaps[ids == r.vec_id][0]
        gaps[ids == q] = np.inf
        hits += len({r.vec_id for r in own} & set(ids[np.lexsort((ids, gaps))[:10]].tolist()))
    assert len(found) == 10 * len(queries) and hits >= 0.9 * len(found)


def test_search_in_cells_dealt_over_shards(make_vectors, monkeypatch):
    """With every budget spent the search is exact, however cells and queries are dealt."""
    monkeypatch.setattr(multi_index, "SHARD_ROWS", 20)
    monkeypatch.setattr(multi_index, "QUERY_BLOCK", 2)
    monkeypatch.setattr(multi_index, "RECALL", 1.1)
    monkeypatch.setattr(multi_index, "_budget", lambda index, queries, k, total: total)
    rows = crowd(n=300)
    found = multi_index.neighbours(make_vectors(rows), step=40).collect()
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], dtype=np.float32).astype(float)
    wanted = set()
    for q in [i for i in ids.tolist() if i % 40 == 0]:
        gaps = np.sqrt(((x - x[ids == q][0]) ** 2).sum(axis=1))
        gaps[ids == q] = np.inf
        wanted |= {(q, rank, int(ids[i]), gaps[i]) for rank, i in enumerate(np.lexsort((ids, gaps))[:10], 1)}
    assert {tuple(r) for r in found} == wanted


def test_rows_are_sent_only_to_blocks_that_visit_their_shard(make_vectors, monkeypatch):
    """Thirty tight clouds far apart: a query needs its own cloud, so rows times blocks would be thirty times too many."""
    monkeypatch.setattr(multi_index, "SHARD_ROWS", 60)
    monkeypatch.setattr(multi_index, "QUERY_BLOCK", 4)
    sent = []

    def counted(index, visits, plain=multi_index.visited_rows):
        rows = plain(index, visits)
        sent.append((rows.count(), index.rows.count(), visits.select("block").distinct().count()))
        return rows

    monkeypatch.setattr(multi_index, "visited_rows", counted)
    draw = np.random.default_rng(12)
    clouds = [100 * draw.normal(size=8) + draw.normal(size=(50, 8)) for _ in range(30)]
    rows = list(enumerate(np.vstack(clouds).tolist()))
    found = multi_index.neighbours(make_vectors(rows), step=10).collect()
    assert len(found) == 1500 and {r.vec_id // 50 == r.query_id // 50 for r in found} == {True}
    ((copies, all_rows, blocks),) = sent
    assert all_rows == 1500 and blocks >= 30 and copies <= 0.25 * all_rows * blocks


def test_each_length_of_vectors_is_searched(make_vectors):
    draw = np.random.default_rng(13)
    rows = [(i, draw.normal(size=16 if i % 3 else 24).tolist()) for i in range(300)]
    rows += [(300 + i, v) for i, (_, v) in enumerate(rows[:40])] + [(350, [1.0, 2.0])]
    found = multi_index.neighbours(make_vectors(rows), step=50).collect()
    known = dict(rows)
    assert {r.query_id for r in found} == {i for i in range(0, 301, 50)}
    assert all(len(known[r.query_id]) == len(known[r.vec_id]) for r in found)
    assert {(r.query_id, r.vec_id) for r in found if r.score == 0} == {(0, 300), (300, 0)}
    links = {r.vec_id: (r.n_links, r.component_id) for r in nn_descent.near_duplicates(make_vectors(rows)).collect()}
    wanted = {}
    for size in (2, 16, 24):
        wanted |= plain_links([(i, v) for i, v in rows if len(v) == size])
    assert links == wanted and links[339] == (1, 39)


@pytest.mark.parametrize("seed", range(5))
def test_ties_of_a_shard_go_to_the_smallest_identifiers(seed):
    """Most rows are copies of two vectors at one distance from the queries; some identifiers repeat."""
    draw = np.random.default_rng(seed)
    turned = np.repeat([[3.0, 0, 0, 4.0], [0, 3.0, 4.0, 0]], 300, axis=0)
    x = np.vstack([turned, draw.integers(-9, 9, (200, 4)), np.tile([1.0, 1, 1, 1], (60, 1))])
    ids = np.concatenate([draw.permutation(600), 600 + draw.integers(0, 150, 200), np.repeat([900, 901], 30)])
    asks = {900: [1.0] * 4, 950: [0.0] * 4, 5: x[ids == 5][0].tolist()}
    order = np.argsort(ids, kind="stable")
    x, ids = x[order], ids[order]
    lists = {"number": ids, "vector": x.tolist(), "cells": [[1]] * len(ids)}
    asked = {"number": np.array(list(asks)), "vector": list(asks.values()), "cells": [[1, 2]] * len(asks)}
    found = multi_index._nearest(*(pa.table({**t, "cells": pa.array(t["cells"], pa.list_(pa.int32()))}) for t in (lists, asked)), 10)
    wanted = []
    for q, v in asks.items():
        gaps = np.sqrt(((x - v) ** 2).sum(axis=1))
        gaps[ids == q] = np.inf
        wanted += [(q, int(ids[i]), gaps[i]) for i in np.lexsort((ids, gaps))[:10]]
    assert list(zip(*(c.to_pylist() for c in found.columns))) == wanted


def test_search_of_odd_tables(make_vectors):
    assert multi_index.neighbours(make_vectors([])).count() == 0
    assert multi_index.neighbours(make_vectors(list(enumerate(BAD[:6])))).count() == 0
    few = [(0, [1.0] * 16), (0, [1.0] * 16), (7, [2.0] * 16), (7, [2.0] * 16), (8, [2.0] * 16), (None, [3.0] * 16)]
    found = multi_index.neighbours(make_vectors(few)).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in found) == [(0, 1, 7, 4.0), (0, 2, 7, 4.0), (0, 3, 8, 4.0)]


def test_walk_meets_every_cell_in_order():
    draw = np.random.default_rng(4)
    books = multi_index.Codebooks(draw.normal(size=(6, 3)), draw.normal(size=(6, 2)))
    query = draw.normal(size=5)
    a, b = (half[0] for half in books.halves(query[None]))
    walked = list(books.walk(query))
    sums = [a[cell // 6] + b[cell % 6] for cell in walked]
    assert sorted(walked) == list(range(36)) and sums == sorted(sums)


def test_components_equal_a_plain_search(spark):
    draw = np.random.default_rng(6)
    edges = [(int(a), int(b)) for a, b in draw.integers(0, 400, (300, 2))] + [(500 + i, 501 + i) for i in range(60)]
    edges += [(900, 900 + i) for i in range(1, 200)]
    root = {}

    def find(i):
        root.setdefault(i, i)
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    frame = spark.createDataFrame([*edges, (None, 1), (2, None), (7, 7)], "a long, b long")
    found = {r.id: r.component for r in components.components(frame).collect()}
    assert found == {i: find(i) for i in root}
    assert components.components(frame.limit(0)).count() == 0
