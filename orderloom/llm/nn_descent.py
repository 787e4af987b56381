"""Near-duplicate vectors by NN-descent.

Equal vectors become one node. The first neighbour lists come from sorted random
projections: each table orders all vectors by a code of random hyperplanes, and a
vector is compared with those around it in blocks of fixed length. There are so
many tables, growing with the number of nodes, that two vectors at the threshold
share a block of some table with a chance of ``MEETING``, if vectors are spread
evenly. Every round adds as many tables with new hyperplanes, and then a join of
neighbours of neighbours refines the lists: every node gathers its neighbours in
both directions, compares them with each other, and each keeps the ``width``
nearest it has met.

A list in which every entry is a link is saturated: more links may not have
fitted. The nodes with saturated lists are first compared with those of every
other connected group: they are cut into blocks with a centre and a radius, all
centres are compared, and where the radii allow a link the members are compared,
so no link between two groups is left out. Then every group with a saturated
list is compared as a whole in pairs of blocks and its links counted, not stored,
so that groups of any size keep every link at bounded memory.

A round has settled if at least ``RECALL`` of the links that it leaves were known
before it; as its tables are new ones, that holds for links however rare they
are. The result is then audited: nodes are compared with all vectors by brute
force, and a true link counts as met if it is listed or lies inside a group that
is compared as a whole. Nodes are added until ``LINKS_SEEN`` true links were seen
or ``MOST_AUDITED`` nodes were asked. Below ``RECALL`` another round follows, with
lists twice as long; after ``MOST_ROUNDS`` rounds the query fails rather than
return less.

Vectors that are null, zero or hold null or non-finite components link with nothing
and are kept; vectors of one length are compared with each other only. Rows that
repeat an identifier, with the same vector or another, share one node and what
is found for it. A row without an identifier has no component, no links, and is kept.
An empty table gives no rows. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderloom.llm.common import bounded_sample, slices, stored
from orderloom.llm.components import components
from orderloom.llm.vectors import by_length, column, groups, matrix, proper_vectors, unit

THRESHOLD = 0.9
WIDTH = 10
#: At least so many tables and planes.
TABLES = 6
PLANES = 16
MEETING = 0.97
BLOCK = 256
AUDITED = 256
MOST_AUDITED = 16_384
LINKS_SEEN = 500
RECALL = 0.98
MOST_ROUNDS = 24
#: Lists grow to so many times their first length.
WIDENED = 64
#: Neighbours of one direction that a node compares in a round.
GATHERED = 2
PAIR_BLOCK = 1024
#: Centres that are compared with each other in a task.
CENTRES = 4096

_LISTS = "vec_id long, near array<struct<cosine:double,other:long>>"
_PAIRS = "vec_id long, other long, cosine double"


def classes(vectors: DataFrame) -> DataFrame:
    """vec_id (the smallest), vector and number of copies of every different vector, with its content's digest."""
    keyed = vectors.withColumn("content", F.md5(F.to_json("vector")))
    return keyed.groupBy("content").agg(
        F.min("vec_id").alias("vec_id"), F.count(F.lit(1)).alias("copies"), F.first("vector").alias("vector")
    )


def _pairs(best: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    columns = [np.concatenate(c) for c in zip(*best)] if best else [np.array([])] * 3
    kinds = (pa.int64(), pa.int64(), pa.float64())
    return pa.RecordBatch.from_arrays(
        [pa.array(c.astype(t.to_pandas_dtype()), t) for c, t in zip(columns, kinds)], names=["vec_id", "other", "cosine"]
    )


def _nearest_within(ids: np.ndarray, unit_rows: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nearest of each row among the others."""
    cosine = np.clip(unit_rows @ unit_rows.T, -1, 1)
    cosine[ids[:, None] == ids[None]] = -np.inf
    most = min(width, len(ids) - 1)
    near = np.argpartition(-cosine, most - 1, axis=1)[:, :most] if most else np.zeros((len(ids), 0), dtype=int)
    value = np.take_along_axis(cosine, near, axis=1)
    at, place = np.nonzero(np.isfinite(value))
    return ids[at], ids[near[at, place]], value[at, place]


def _top(pairs: DataFrame, width: int) -> DataFrame:
    """The ``width`` nearest that each node has met, nearest first; a cosine met twice may differ in its last digits."""
    once = pairs.repartition("vec_id").groupBy("vec_id", "other").agg(F.max("cosine").alias("cosine"))
    met = F.sort_array(F.collect_list(F.struct("cosine", "other")), asc=False)
    return once.groupBy("vec_id").agg(F.slice(met, 1, width).alias("near"))


def table_shape(total: int, threshold: float = THRESHOLD) -> tuple[int, int]:
    """Tables and planes for so many nodes."""
    bits = max(0.0, np.log2(total / (BLOCK / 2)))  # that split the nodes into half blocks
    together = (1 - np.arccos(threshold) / np.pi) ** bits
    tables = np.log(1 - MEETING) / np.log1p(-together) if together < 1 else 1
    return max(TABLES, int(np.ceil(tables))), min(50, max(PLANES, int(np.ceil(bits)) + 4))  # a code is exact in a double


def first_lists(nodes: DataFrame, width: int = WIDTH, seed: int = 11, threshold: float = THRESHOLD) -> DataFrame:
    """Neighbours from sorted random projections."""
    size = len(nodes.select("vector").first()["vector"])
    tables, directions = table_shape(nodes.count(), threshold)
    planes = np.random.default_rng(seed).normal(size=(tables, directions, size))

    def code(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2048):
            rows = unit(matrix(batch))
            for table in range(tables):
                projected = rows @ planes[table].T
                bits = (projected[:, :-1] > 0) @ (1 << np.arange(directions - 1)[::-1])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(rows), table), pa.int32()), pa.array(bits + 0.5 * np.tanh(projected[:, -1]), pa.float64()), batch["vec_id"], batch["vector"]],
                    names=["table", "code", "vec_id", "vector"],
                )

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, last_ids, last_rows = None, np.zeros(0, dtype=np.int64), np.zeros((0, size))
        for half in slices(batches, BLOCK // 2):
            for group in groups([half], ["table"]):
                table, ids, rows = group["table"][0].as_py(), column(group, "vec_id"), unit(matrix(group))
                if table == last:
                    block = np.concatenate([last_ids, ids]), np.vstack([last_rows, rows])
                else:
                    block = ids, rows
                yield _pairs([_nearest_within(*block, width)])
                last, last_ids, last_rows = table, ids, rows

    coded = nodes.select("vec_id", "vector").mapInArrow(code, "table int, code double, vec_id long, vector array<double>")
    ordered = coded.repartitionByRange("table", "code", "vec_id").sortWithinPartitions("table", "code", "vec_id")
    return _top(ordered.mapInArrow(compare, _PAIRS), width)


def refine(nodes: DataFrame, lists: DataFrame, width: int) -> DataFrame:
    """One neighbours-of-neighbours round over stored lists."""
    forward = lists.select("vec_id", F.explode("near").alias("n")).select("vec_id", F.col("n.other").alias("other"), F.col("n.cosine").alias("cosine"))
    # The nearest of those that list a node; further ones meet through the lists themselves.
    backward = _top(forward.select(F.col("other").alias("vec_id"), F.col("vec_id").alias("other"), "cosine"), GATHERED * width)
    both = forward.select("vec_id", "other").union(backward.select("vec_id", F.explode("near.other").alias("other")))
    members = both.union(lists.select("vec_id", F.col("vec_id").alias("other"))).distinct()
    gathered = members.join(nodes.select(F.col("vec_id").alias("other"), "vector"), "other")

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, rows = [], 0
        for group in groups(batches, ["vec_id"]):
            if group.num_rows > 1:
                best.append(_nearest_within(column(group, "other"), unit(matrix(group)), width))
                rows += len(best[-1][0])
            if rows > 50_000:
                yield _pairs(best)
                best, rows = [], 0
        yield _pairs(best)

    local = gathered.repartition("vec_id").sortWithinPartitions("vec_id", "other").mapInArrow(compare, _PAIRS)
    return _top(forward.union(local.select("vec_id", "other", "cosine")), width)


def _blocks(members: DataFrame) -> DataFrame:
    """members with the last block of their component and a block of about ``PAIR_BLOCK`` rows by a hash of vec_id."""
    sizes = members.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    last = F.floor((F.col("size") - 1) / PAIR_BLOCK).cast("int")
    return members.join(sizes, "component").withColumn("last", last).withColumn(
        "block", F.pmod(F.xxhash64("vec_id"), F.col("last") + 1).cast("int")
    )


def _components_that_link(members: DataFrame, threshold: float) -> DataFrame:
    """Pairs of components, a < b, with a link between their members, exact; members have component, vec_id, vector."""
    if members.select("component").distinct().limit(2).count() < 2:
        return members.select(F.col("component").alias("a"), F.col("component").alias("b")).limit(0)
    dealt = stored(_blocks(members).select("component", "block", "vec_id", "vector"), "open")

    def enclose(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, ["component", "block"]):
            rows = unit(matrix(group))
            centre = rows.mean(axis=0)
            centre = unit(centre[None])[0] if centre.any() else rows[0]
            radius = float(np.arccos(np.clip(rows @ centre, -1, 1)).max())
            first = group.slice(0, 1)
            yield pa.RecordBatch.from_arrays(
                [first["component"].combine_chunks(), first["block"].combine_chunks(), pa.array([centre.tolist()]), pa.array([radius])],
                names=["component", "block", "vector", "radius"],
            )

    balls = dealt.repartition("component", "block").sortWithinPartitions("component", "block")
    balls = stored(balls.mapInArrow(enclose, "component long, block int, vector array<double>, radius double"), "balls")
    last = max(0, -(-balls.count() // CENTRES) - 1)
    met = balls.withColumn("chunk", F.pmod(F.xxhash64("component", "block"), F.lit(last + 1)).cast("int"))
    met = met.withColumn("partner", F.explode(F.sequence(F.lit(0), F.lit(last)))).select(
        F.least("chunk", "partner").alias("low"), F.greatest("chunk", "partner").alias("high"), "chunk", "component", "block", "vector", "radius"
    )
    reach = float(np.arccos(threshold)) + 1e-6  # angles are rounded

    def meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, ["low", "high"]):
            rows, radius, chunk = matrix(group), column(group, "radius"), column(group, "chunk")
            component, block = column(group, "component"), column(group, "block")
            within = bool(group["low"][0].as_py() == group["high"][0].as_py())
            for at in range(0, len(rows), 256):
                own = slice(at, at + 256)
                angle = np.arccos(np.clip(rows[own] @ rows.T, -1, 1))
                near = (angle <= radius[own][:, None] + radius[None] + reach) & (component[own][:, None] < component[None])
                if not within:
                    near &= chunk[own][:, None] != chunk[None]
                i, j = np.nonzero(near)
                i += at
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in ((component[i], pa.int64()), (block[i], pa.int32()), (component[j], pa.int64()), (block[j], pa.int32()))],
                    names=keys,
                )

    keys = ["a", "block_a", "b", "block_b"]
    near = met.repartition("low", "high").sortWithinPartitions("low", "high").mapInArrow(meet, "a long, block_a int, b long, block_b int")
    sides = F.array(*(F.struct(F.col(c).alias("component"), F.col(f"block_{c}").alias("block")) for c in "ab"))
    asked = stored(near, "near").withColumn("side", F.explode(sides)).select(*keys, "side.component", "side.block")

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, keys):
            rows, first = unit(matrix(group)), column(group, "component") == group["a"][0].as_py()
            others = rows[~first].T
            if any((rows[first][at : at + 256] @ others >= threshold).any() for at in range(0, int(first.sum()), 256)):
                yield pa.RecordBatch.from_arrays([group[c].slice(0, 1).combine_chunks() for c in "ab"], names=["a", "b"])

    pairs = asked.join(dealt.drop("vec_id"), ["component", "block"]).repartition(*keys).sortWithinPartitions(*keys)
    return pairs.mapInArrow(compare, "a long, b long").distinct()


def grouped(nodes: DataFrame, lists: DataFrame, width: int, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """The listed links, and the nodes with component and whether all links inside it are to be counted.

    ``lists`` were made with that width. A node without links has no component.
    """
    saturated = (F.size("near") >= width) & (F.element_at("near", -1)["cosine"] >= threshold)
    listed = lists.select("vec_id", saturated.alias("saturated"), F.explode("near").alias("n"))
    edges = stored(
        listed.where(F.col("n.cosine") >= threshold).select(F.col("vec_id").alias("a"), F.col("n.other").alias("b"), "saturated"), "links"
    )
    named = stored(components(edges), "components").withColumnRenamed("id", "vec_id")
    full = edges.where("saturated").select(F.col("a").alias("vec_id")).distinct().join(named, "vec_id")
    across = _components_that_link(full.join(nodes.select("vec_id", "vector"), "vec_id"), threshold)
    merged = components(across).select(F.col("id").alias("component"), F.col("component").alias("into"))
    named = stored(
        named.join(merged, "component", "left").select("vec_id", F.coalesce("into", "component").alias("component")), "merged"
    )
    whole = full.select("vec_id").join(named, "vec_id").select("component").distinct().withColumn("whole", F.lit(True))
    members = named.join(whole, "component", "left").withColumn("whole", F.coalesce("whole", F.lit(False)))
    labelled = nodes.join(members, "vec_id", "left").withColumn("whole", F.coalesce("whole", F.lit(False)))
    return edges, stored(labelled, "members")


def audit(edges: DataFrame, labelled: DataFrame, threshold: float = THRESHOLD) -> tuple[float, int]:
    """Recall of links over some nodes, by a hash of their identifier, and the number of true links seen."""
    total, most, asked = labelled.count(), AUDITED, 0
    while True:
        asked = most
        met, links = _audited(edges, labelled, threshold, asked)
        most = min(4 * asked, MOST_AUDITED)
        if links >= LINKS_SEEN or asked >= min(total, MOST_AUDITED):
            return (met / links if links else 1.0), links


def _audited(edges: DataFrame, labelled: DataFrame, threshold: float, most: int) -> tuple[int, int]:
    """Links met and true links of so many nodes."""
    known = labelled.select("vec_id", "vector", "whole", F.coalesce("component", "vec_id").alias("component"))
    asked = bounded_sample(known, most, "vec_id").toArrow()
    ids, wanted = column(asked, "vec_id"), unit(matrix(asked))
    open_group = np.where(column(asked, "whole"), column(asked, "component"), -1)
    in_group = column(asked, "whole").astype(bool)

    def linked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2048):
            others, component, rows = column(batch, "vec_id"), column(batch, "component"), unit(matrix(batch)).T
            for at in range(0, len(ids), 1024):
                own = slice(at, at + 1024)
                links = (wanted[own] @ rows >= threshold) & (ids[own][:, None] != others[None])
                inside = links & in_group[own][:, None] & (open_group[own][:, None] == component[None])
                met, (i, j) = inside.sum(axis=1), np.nonzero(links & ~inside)
                some = np.flatnonzero(met)
                columns = (np.r_[ids[own][some], ids[own][i]], np.r_[ids[own][some], others[j]], np.r_[met[some], np.ones(len(i))])
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=["a", "b", "links"])

    # Those inside a group that is compared as a whole are counted, under the node itself.
    true = stored(known.mapInArrow(linked, "a long, b long, links long"), "audit")
    both = edges.select("a", "b").union(edges.select("b", "a")).distinct().withColumn("listed", F.lit(True))
    met = F.when(F.col("listed") | (F.col("a") == F.col("b")), F.col("links")).otherwise(0)
    row = true.join(both, ["a", "b"], "left").agg(F.sum(met).alias("met"), F.sum("links").alias("links")).first()
    return row["met"] or 0, row["links"] or 0


def known_before(before: DataFrame, after: DataFrame, width: int, threshold: float = THRESHOLD) -> float:
    """The share of the links in lists after a round that were in those before it; saturated lists are compared elsewhere."""

    def linked(lists: DataFrame, name: str) -> DataFrame:
        near = F.filter("near", lambda n: n["cosine"] >= threshold - 1e-12)  # a cosine may differ in its last digits
        return lists.select("vec_id", F.transform(near, lambda n: n["other"]).alias(name))

    both = linked(after, "now").where((F.size("now") > 0) & (F.size("now") < width)).join(linked(before, "then"), "vec_id", "left")
    old = F.coalesce(F.size(F.array_intersect("now", "then")), F.lit(0))
    row = both.agg(F.sum(F.when(F.col("then").isNotNull(), old).otherwise(0)).alias("old"), F.sum(F.size("now")).alias("links")).first()
    return row["old"] / row["links"] if row["links"] else 1.0


def linked_nodes(nodes: DataFrame, width: int = WIDTH, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """Links and nodes as ``grouped`` gives them, from refined lists; ``nodes`` is a stored table."""
    widest = WIDENED * width
    lists = stored(first_lists(nodes, width, threshold=threshold), "lists")
    for number in range(MOST_ROUNDS):
        fresh = first_lists(nodes, width, 12 + number, threshold)
        met = lists.union(fresh).select("vec_id", F.explode("near").alias("n")).select("vec_id", "n.other", "n.cosine")
        before, lists = lists, stored(refine(nodes, stored(_top(met, width), "met"), width), "lists")
        if known_before(before, lists, width, threshold) < RECALL:
            continue
        found = grouped(nodes, lists, width, threshold)
        if audit(*found, threshold)[0] >= RECALL:
            return found
        width = min(2 * width, widest)
    raise RuntimeError(f"less than {RECALL} of the links were found in {MOST_ROUNDS} rounds")


def _counted_in_blocks(members: DataFrame, threshold: float) -> DataFrame:
    """Links of every member within its component, weighted by copies; members have component, vec_id, vector, copies."""
    dealt = _blocks(members)
    paired = dealt.withColumn("partner", F.explode(F.sequence(F.lit(0), F.col("last")))).select(
        "component", F.least("block", "partner").alias("low"), F.greatest("block", "partner").alias("high"), "block", "vec_id", "copies", "vector"
    )

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, ["component", "low", "high"]):
            ids, copies, rows = column(group, "vec_id"), column(group, "copies"), unit(matrix(group))
            block = column(group, "block")
            within = bool(group["low"][0].as_py() == group["high"][0].as_py())
            out = np.zeros(len(ids), dtype=np.int64)
            for at in range(0, len(ids), 512):
                own = slice(at, at + 512)
                links = (rows[own] @ rows.T >= threshold) & (ids[own][:, None] != ids[None])
                if not within:
                    links &= block[own][:, None] != block[None]
                out[own] = links @ copies
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.int64())], names=["vec_id", "links"])

    keys = ["component", "low", "high"]
    ordered = paired.repartition(*keys).sortWithinPartitions(*keys, "vec_id")
    return ordered.mapInArrow(count, "vec_id long, links long").groupBy("vec_id").agg(F.sum("links").alias("links"))


def _answers(vectors: DataFrame, threshold: float, width: int) -> DataFrame:
    """content, n_links and component_id of every different vector of one length, stored."""
    nodes = stored(classes(vectors), "nodes")
    edges, labelled = linked_nodes(nodes, width, threshold)
    whole = _counted_in_blocks(labelled.where("whole").select("component", "vec_id", "vector", "copies"), threshold)
    both = edges.select("a", "b").union(edges.select("b", "a")).distinct()
    few = (
        both.join(labelled.where("not whole").select(F.col("vec_id").alias("b"), "copies"), "b")
        .groupBy("a")
        .agg(F.sum("copies").alias("links"))
        .select(F.col("a").alias("vec_id"), "links")
    )
    links = whole.union(few)
    answers = labelled.select("content", "vec_id", "copies", "component").join(links, "vec_id", "left")
    return stored(
        answers.select(
            "content",
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.coalesce("component", "vec_id").alias("component_id"),
        ),
        "answers",
    )


def near_duplicates(embeddings: DataFrame, threshold: float = THRESHOLD, width: int = WIDTH) -> DataFrame:
    """vec_id, n_links, component_id, kept."""
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    vectors = stored(proper_vectors(rows), "vectors")
    if vectors.isEmpty():
        return rows.select(
            "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept")
        )
    answers = reduce(DataFrame.unionByName, (_answers(part, threshold, width) for part in by_length(vectors)))
    own = vectors.select("vec_id", F.md5(F.to_json("vector")).alias("content")).join(answers, "content")
    found = own.groupBy("vec_id", "content").agg(
        F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"), F.count(F.lit(1)).alias("times")
    )
    found = found.select("vec_id", "n_links", "component_id", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).drop("col")
    out = found.unionByName(_unlinked(rows, vectors))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def _unlinked(rows: DataFrame, vectors: DataFrame) -> DataFrame:
    """The rows that take no part."""
    left = rows.groupBy("vec_id").count().join(
        vectors.groupBy("vec_id").agg(F.count(F.lit(1)).alias("taken")), "vec_id", "left"
    )
    rest = left.select("vec_id", (F.col("count") - F.coalesce("taken", F.lit(0))).cast("int").alias("rest")).where("rest > 0")
    return rest.select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.explode(F.sequence(F.lit(1), F.col("rest")))
    ).drop("col")
