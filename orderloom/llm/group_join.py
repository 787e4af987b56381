"""Near-duplicate texts by a token-group matrix.

The join works on sets of word shingles (``shingles.py``) and finds groups of
documents that are linked, directly or through others, by a Jaccard similarity
of at least ``percent`` hundredths. It is exact but for hash collisions.

1. Equal sets become one node, so copies are never compared.
2. Similar nodes are put into groups: signatures of minimum hashes are cut into
   bands, and the nodes of a band's bucket that look like its leader join the
   leader's group. This only decides on the partition; a node that is missed
   here stays a group of its own. Nodes that are truly linked with their leader
   form the first components.
3. Groups are stored in parts of about ``PART`` members with the union of their
   tokens; a first component that is larger has parts of its own. Within a group
   every node meets the parts after its own, except those of its component.
4. The matrix of tokens and groups is built from the groups' token prefixes. A
   prefix holds so many of a set's rarest tokens that two linked sets must share
   one there. Tokens of many documents count as late; that order is a bitmap of
   fixed size, and any order gives the same links. The members of the smaller of
   two groups that meet in the matrix, and whose set sizes allow a link, meet all
   parts of the larger one.
5. A node whose overlap with a part's union is too small skips the part. Only
   parts that qualify are opened, that is, the overlaps with all members are
   counted at once from the part's own token matrix.

No pairs of documents are built: a row is a node and a part.

Documents without words have an empty set and link with nothing; null texts
count as empty. Repeated rows give repeated results. ``doc_id`` names a document:
rows without it get a count of shingles, and the component of the copies that
have one, if any. An empty table gives no rows. Only doc_id and text are read, so
other columns may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderloom.llm.common import slices, stored
from orderloom.llm.components import components
from orderloom.llm.shingles import shingle_sets
from orderloom.llm.vectors import groups

PERCENT = 80
BANDS, ROWS = 8, 3
#: Equal minimum hashes, of BANDS * ROWS, that make a comparison with a leader worth while.
ALIKE = 10
PART = 64
#: Queries that meet one copy of a part.
SALTED = 512
#: Share of a set, by hash, that is counted to find frequent tokens.
COUNTED = 0.4
FREQUENT = 16
BITS = 1 << 27
#: Most bits that are set, which bounds the false ones.
MOST_FREQUENT = 1 << 22
#: Rows of two numbers that are broadcast at most; larger tables are joined by a shuffle.
BROADCAST_ROWS = 1 << 20
#: Tokens that a task gathers before it sends them.
FLUSHED = 1 << 20
DOCS_PER_BUCKET = 2000

_MULTIPLIERS = (np.random.default_rng(17).integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) << np.uint64(1)) + np.uint64(1)


def _signature(tokens: np.ndarray) -> list[int]:
    """The smallest of several multiplicative hashes, shortened to 32 bits."""
    return [int((tokens * m).min() >> np.uint64(32)) - (1 << 31) for m in _MULTIPLIERS]


def document_sets(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, content (a digest of the set) and signature of every document."""

    def describe(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sizes, contents, signatures = [], [], []
            for tokens in shingle_sets(batch["text"].to_pylist()):
                sizes.append(len(tokens))
                contents.append(hashlib.blake2b(tokens.tobytes(), digest_size=16).digest())
                signatures.append(_signature(tokens) if len(tokens) else None)
            columns = [pa.array(sizes, pa.int64()), pa.array(contents, pa.binary()), pa.array(signatures, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *columns], names=["doc_id", "n_shingles", "content", "signature"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        describe, "doc_id long, n_shingles long, content binary, signature array<int>"
    )


def set_classes(sets: DataFrame) -> DataFrame:
    """One row per different set: its digest, smallest doc_id, copies, size and signature."""
    return (
        sets.where("n_shingles > 0")
        .groupBy("content")
        .agg(
            F.min("doc_id").alias("id"),
            F.count(F.lit(1)).alias("copies"),
            F.first("n_shingles").alias("size"),
            F.first("signature").alias("signature"),
        )
        .where("id is not null")
    )


def leader_pairs(classes: DataFrame) -> DataFrame:
    """(id, leader) of nodes that share a band and look alike; at most one leader per node and band."""
    bands = F.array(*(F.xxhash64(F.lit(b), *(F.col("signature")[b * ROWS + r] for r in range(ROWS))) for b in range(BANDS)))
    buckets = classes.select("id", "copies", "signature", F.posexplode(bands).alias("band", "key"))
    # Even bands follow the set with the most copies, odd ones a member at random.
    rank = F.struct(F.when(F.col("band") % 2 == 0, F.col("copies")).otherwise(0), F.xxhash64("band", "id"), "id")
    leaders = (
        buckets.groupBy("band", "key")
        .agg(F.max_by(F.struct("id", "signature"), rank).alias("leader"), F.count(F.lit(1)).alias("members"))
        .where("members > 1")
        .select("band", "key", "leader")
    )
    met = (
        buckets.select("id", "band", "key")
        .join(stored(leaders, "leaders"), ["band", "key"])
        .where(F.col("id") != F.col("leader.id"))
        .groupBy("id", F.col("leader.id").alias("leader"))
        .agg(F.first("leader.signature").alias("other"))
    )
    equal = F.aggregate(F.zip_with("signature", "other", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    return met.join(classes.select("id", "signature"), "id").where(equal >= ALIKE).select("id", "leader")


def bounded_broadcast(df: DataFrame) -> DataFrame:
    """A stored table, with a broadcast hint if it is shorter than the bound."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Texts of some documents, stored."""
    wanted = bounded_broadcast(stored(ids.select(F.col("id").alias("doc_id")).distinct(), "ids"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(wanted, "doc_id", "left_semi")
    return stored(texts.dropDuplicates(["doc_id"]).withColumnRenamed("doc_id", "id"), "texts")


KEYS = ["group", "large", "owner", "piece"]


class Part:
    """The members of a part, their token union and the members that have each token."""

    def __init__(self, ids: list[int], sets: list[np.ndarray]):
        self.ids, self.sizes = np.array(ids, dtype=np.int64), np.array([len(s) for s in sets])
        tokens = np.concatenate(sets)
        order = np.argsort(tokens, kind="stable")
        self.owners = np.repeat(np.arange(len(ids)), self.sizes)[order]
        self.union, first = np.unique(tokens[order], return_index=True)
        self.bounds = np.append(first, len(tokens))

    def linked(self, number: int, query: np.ndarray, percent: int) -> np.ndarray:
        """The members linked with a query."""
        place = np.minimum(np.searchsorted(self.union, query), len(self.union) - 1)
        place = place[self.union[place] == query]
        # A member that is linked shares so many tokens with the query, and they are all in the union.
        if 100 * len(place) < percent * len(query) or not len(place):
            return self.ids[:0]
        begin, lengths = self.bounds[place], self.bounds[place + 1] - self.bounds[place]
        at = np.repeat(begin - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
        shared = np.bincount(self.owners[at], minlength=len(self.ids))
        fits = 100 * shared >= percent * (len(query) + self.sizes - shared)
        return self.ids[fits & (self.ids != number)]


def open_parts(texts: DataFrame, members: DataFrame, queries: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Links (a, b) between queries and members of the parts they meet.

    Both have ``KEYS`` and id. The members of a part are held in memory, queries
    stream by; with many queries a part is held in several tasks. A query gives
    one link for a part of one owner, else all of its links there.
    """
    salts = queries.groupBy(*KEYS).agg(F.ceil(F.count(F.lit(1)) / SALTED).cast("int").alias("salts"))
    salts = stored(salts, "salts")
    salted = F.pmod(F.xxhash64("id"), F.col("salts")).cast("int")
    asked = queries.join(salts, KEYS).select(*KEYS, salted.alias("salt"), F.lit(1).alias("side"), "id")
    every = F.explode(F.sequence(F.lit(0), F.col("salts") - 1))
    held = members.join(salts, KEYS).select(*KEYS, every.alias("salt"), F.lit(0).alias("side"), "id")
    rows = held.union(asked).join(texts, "id")
    order = [*KEYS, "salt"]

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, sets, part = None, [], [], None
        for batch in slices(batches):
            found = [(np.zeros(0, dtype=np.int64),) * 2]
            tokens = shingle_sets(batch["text"].to_pylist())
            names = zip(*(batch[c].to_pylist() for c in (*order, "side", "id")))
            for (*own, side, number), query in zip(names, tokens):
                if own != key:
                    key, ids, sets, part = own, [], [], None
                if side == 0:
                    ids.append(number)
                    sets.append(query)
                    continue
                if not sets:
                    continue
                part = part or Part(ids, sets)
                links = part.linked(number, query, percent)
                links = links[:1] if own[1] else links
                found.append((np.full(len(links), number), links))
            columns = [np.concatenate(c) for c in zip(*found)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["a", "b"])

    ordered = rows.repartition(*order).sortWithinPartitions(*order, "side", "id").select(*order, "side", "id", "text")
    return stored(ordered.mapInArrow(compare, "a long, b long"), "links")


def _bucketed(tokens: np.ndarray, values: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Sorted tokens and a number for each, cut into rows by the tokens' upper bits."""
    bucket = ((tokens >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    cuts = np.flatnonzero(np.diff(bucket, prepend=np.uint64(buckets + 1)))
    ends = [*cuts[1:], len(tokens)]
    columns = [
        pa.array(bucket[cuts].astype(np.int64), pa.int64()),
        pa.array([tokens[a:b].tobytes() for a, b in zip(cuts, ends)], pa.binary()),
        pa.array([values[a:b].tobytes() for a, b in zip(cuts, ends)], pa.binary()),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["bucket", "tokens", "numbers"])


_BUCKETED = "bucket long, tokens binary, numbers binary"


def _gathered(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and numbers of one bucket, sorted by both."""
    tokens = np.frombuffer(b"".join(group["tokens"].to_pylist()), dtype=np.uint64)
    numbers = np.frombuffer(b"".join(group["numbers"].to_pylist()), dtype=np.int64)
    order = np.lexsort((numbers, tokens))
    return tokens[order], numbers[order]


def frequent_tokens(docs: DataFrame, buckets: int) -> np.ndarray:
    """A bitmap over the upper bits of the tokens that many documents have."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in slices(batches):
            for tokens in shingle_sets(batch["text"].to_pylist()):
                held.append(tokens[: int(np.ceil(COUNTED * len(tokens)))])
                size += len(held[-1])
            if size > FLUSHED:
                yield _bucketed(*np.unique(np.concatenate(held), return_counts=True), buckets)
                held, size = [], 0
        if size:
            yield _bucketed(*np.unique(np.concatenate(held), return_counts=True), buckets)

    def total(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, ["bucket"]):
            tokens, counts = _gathered(group)
            first = np.flatnonzero(np.diff(tokens, prepend=~tokens[:1]))
            sums = np.add.reduceat(counts, first)
            often = sums >= FREQUENT
            bits = (tokens[first][often] >> np.uint64(37)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(bits, pa.int64()), pa.array(sums[often], pa.int64())], names=["bit", "documents"])

    counted = docs.select("text").mapInArrow(count, _BUCKETED).repartition("bucket").sortWithinPartitions("bucket")
    often = stored(counted.mapInArrow(total, "bit long, documents long"), "frequent")
    levels = often.groupBy(F.floor(F.log2("documents")).cast("int").alias("level")).count().orderBy(F.desc("level")).collect()
    least, filled = 63, 0
    for row in levels:
        if filled + row["count"] > MOST_FREQUENT:
            break
        least, filled = row["level"], filled + row["count"]
    bits = often.where(F.col("documents") >= F.lit(2.0**least)).select("bit").toArrow()  # at most MOST_FREQUENT rows
    bitmap = np.zeros(BITS // 8, dtype=np.uint8)
    numbers = bits["bit"].to_numpy()
    np.bitwise_or.at(bitmap, numbers >> 3, np.left_shift(1, numbers & 7).astype(np.uint8))
    return bitmap


def prefix(tokens: np.ndarray, bitmap: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The first tokens of a set, frequent ones last, of which a linked set must share one."""
    n = len(tokens)
    most = n - -(-percent * n // 100) + 1
    bit = (tokens >> np.uint64(37)).astype(np.int64)
    late = (bitmap[bit >> 3] >> (bit & 7)) & 1 == 1
    early = tokens[~late]
    return early[:most] if len(early) >= most else np.concatenate([early, tokens[late][: most - len(early)]])


def meeting_groups(docs: DataFrame, bitmap: np.ndarray, buckets: int, percent: int = PERCENT) -> DataFrame:
    """Pairs (low, high) of groups whose prefixes share a token; docs have a group and a text."""
    shipped = docs.sparkSession.sparkContext.broadcast(bitmap)  # BITS / 8 bytes

    def spread(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size, late = 0, shipped.value
        for batch in slices(batches):
            for group, tokens in zip(batch["group"].to_pylist(), shingle_sets(batch["text"].to_pylist())):
                if len(tokens):
                    own = prefix(tokens, late, percent)
                    held.append((own, np.full(len(own), group, dtype=np.int64)))
                    size += len(own)
            if size > FLUSHED // 2:
                yield _bucketed(*_union(held), buckets)
                held, size = [], 0
        if size:
            yield _bucketed(*_union(held), buckets)

    def meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket in groups(batches, ["bucket"]):
            tokens, owners = _distinct(*_gathered(bucket))
            first = np.flatnonzero(np.diff(tokens, prepend=~tokens[:1]))
            pairs = set()
            for start, stop in zip(first, [*first[1:], len(tokens)]):
                if stop - start > 1:
                    pairs.update((a, b) for i, a in enumerate(owners[start:stop].tolist()) for b in owners[start + i + 1 : stop].tolist())
                if len(pairs) > 200_000:
                    yield _group_pairs(pairs)
                    pairs = set()
            yield _group_pairs(pairs)

    matrix = docs.mapInArrow(spread, _BUCKETED).repartition("bucket").sortWithinPartitions("bucket")
    return matrix.mapInArrow(meet, "low long, high long").distinct()


def _distinct(tokens: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    new = np.ones(len(tokens), dtype=bool)
    new[1:] = (tokens[1:] != tokens[:-1]) | (owners[1:] != owners[:-1])
    return tokens[new], owners[new]


def _union(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The groups' token prefixes without repeats, by token."""
    tokens, owners = (np.concatenate(part) for part in zip(*held))
    order = np.lexsort((owners, tokens))
    return _distinct(tokens[order], owners[order])


def _group_pairs(pairs: Iterable[tuple[int, int]]) -> pa.RecordBatch:
    columns = list(zip(*pairs)) or [(), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["low", "high"])


def _parts(grouped: DataFrame) -> DataFrame:
    """id, size, KEYS and owners: members of large components get parts of their owner, the others share parts."""
    owned = grouped.groupBy("group", "component").agg(F.count(F.lit(1)).alias("own"))
    sized = grouped.join(stored(owned, "owned"), ["group", "component"])
    large = F.col("own") > PART
    named = sized.select(
        "id", "size", "group", "component", large.alias("large"), F.when(large, F.col("component")).otherwise(0).alias("owner")
    )
    counts = named.groupBy("group", "large", "owner").agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("pieces"))
    piece = F.pmod(F.xxhash64("id"), F.col("pieces")).cast("int").alias("piece")
    return named.join(stored(counts, "pieces"), ["group", "large", "owner"]).select("id", "size", "component", *KEYS[:3], piece)


def _within(placed: DataFrame) -> DataFrame:
    """Queries (KEYS and id) between the components of one group."""
    mixed = placed.groupBy("group").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high")
    mixed = stored(mixed.select("group"), "mixed")
    inside = stored(placed.join(mixed, "group", "left_semi").select("id", *KEYS), "inside")
    pieces = stored(inside.select(*KEYS).distinct(), "targets").select("group", *(F.col(k).alias(f"to_{k}") for k in KEYS[1:]))
    later = (
        (~F.col("large") & (F.col("to_large") | (F.col("to_piece") >= F.col("piece"))))
        | (F.col("large") & F.col("to_large") & (F.col("to_owner") > F.col("owner")))
    )
    return inside.join(pieces, "group").where(later).select("group", *(F.col(f"to_{k}").alias(k) for k in KEYS[1:]), "id")


def _between(pairs: DataFrame, placed: DataFrame, percent: int) -> DataFrame:
    """Queries (KEYS and id) of the pairs of groups whose set sizes allow a link."""
    spans = stored(
        placed.groupBy("group").agg(F.min("size").alias("least"), F.max("size").alias("most"), F.count(F.lit(1)).alias("members")),
        "spans",
    )

    def side(name: str) -> DataFrame:
        return spans.select(F.col("group").alias(name), F.struct("least", "most", "members").alias(f"{name}_span"))

    both = pairs.join(side("low"), "low").join(side("high"), "high")
    low, high = F.col("low_span"), F.col("high_span")
    fits = (100 * low["most"] >= percent * high["least"]) & (100 * high["most"] >= percent * low["least"])
    first = low["members"] >= high["members"]
    chosen = both.where(fits).select(
        F.when(first, F.col("high")).otherwise(F.col("low")).alias("small"),
        F.when(first, F.col("low")).otherwise(F.col("high")).alias("group"),
    )
    asking = stored(chosen, "candidates").join(placed.select(F.col("group").alias("small"), "id"), "small").select("group", "id")
    return asking.join(placed.select(*KEYS).distinct(), "group").select(*KEYS, "id")


def set_links(docs: DataFrame, classes: DataFrame, sets: DataFrame, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """Links between different sets that connect all that is connected, and the components they give."""
    pairs = stored(leader_pairs(classes), "pairs")
    part = [F.col("leader").alias("group"), F.lit(True).alias("large"), F.col("leader").alias("owner"), F.lit(0).alias("piece")]
    leaders = pairs.select(*part, F.col("leader").alias("id")).distinct()
    followers = pairs.select(*part, "id")
    texts = _texts_of(docs, leaders.select("id").union(followers.select("id")))
    near = open_parts(texts, leaders, followers, percent)
    alike = components(pairs.select(F.col("id").alias("a"), F.col("leader").alias("b"))).withColumnRenamed("component", "family")
    first = stored(components(near), "first")
    grouped = classes.join(stored(alike, "families"), "id", "left").join(first, "id", "left").select(
        "id", "size", "content", F.coalesce("family", "id").alias("group"), F.coalesce("component", "id").alias("component")
    )
    grouped = stored(grouped, "grouped")
    placed = stored(_parts(grouped), "placed")

    buckets = max(32, sets.count() // DOCS_PER_BUCKET)
    bitmap = frequent_tokens(docs, buckets)
    special = (
        sets.where("doc_id is not null").select("doc_id", "content").join(grouped, "content")
        .where("doc_id <> id or group <> id")
        .groupBy("doc_id").agg(F.max(F.col("doc_id") != F.col("id")).alias("copy"), F.min("group").alias("group"))
    )
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    own = keyed.join(bounded_broadcast(stored(special, "special")), "doc_id", "left").where("copy is null or not copy")
    met = meeting_groups(own.select(F.coalesce("group", "doc_id").alias("group"), "text"), bitmap, buckets, percent)
    between = _between(stored(met, "meeting"), placed, percent)
    queries = stored(_within(placed).union(between), "queries")
    members = placed.select(*KEYS, "id").join(queries.select(*KEYS).distinct(), KEYS, "left_semi")
    members = stored(members, "members")
    texts = _texts_of(docs, members.select("id").union(queries.select("id")))
    links = stored(near.union(open_parts(texts, members, queries, percent)), "links")
    return links, stored(components(links), "components")


def near_duplicate_groups(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    sets = stored(document_sets(docs), "sets")
    classes = stored(set_classes(sets), "classes")
    _, named = set_links(docs, classes, sets, percent)
    answers = stored(
        classes.join(named, "id", "left").select("content", F.coalesce("component", "id").alias("component_id")), "answers"
    )
    return sets.join(answers, "content", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")
    )
