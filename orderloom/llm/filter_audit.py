"""How five filters interact: what each removes at every place of every order, and its Shapley share.

A document fails some of the filters. What a filter removes depends only on the
set of filters that ran before it, so the 120 orders are paths through the
lattice of 32 sets: an edge adds one filter to a set. The documents are reduced
to counts per part and set of failed filters, an edge's removals are sums of
these, and everything else is read from the edges. The number of paths that
reach a set (forward) times the number that leave the edge's end (backward) is
the number of orders through an edge, which weights its removals for Shapley;
the steps of an order are the edges on its path.

The filters, each by its condition for failing:
A fewer than ``MIN_WORDS`` words; B fewer distinct words than 80 % of all;
C capitals A-Z are more than 10 % of the code points; D any of ``#$%&*|``;
E the text equals that of a smaller doc_id anywhere in the table.
Words are maximal runs without spaces, tabs and line breaks, case-sensitive.

Texts are compared by SHA-256. Documents are grouped with their copies, then by
digest with counts, so a text that a third of all rows share is a few counted
rows per part and label. At most 32 rows per part reach the lattice.

A null text counts as empty, and equals other empty texts; a null lang is the
part with the empty name. Repeated rows of one doc_id count one by one and do
not fail E for each other. A row without doc_id is not larger than any other and
never fails E, nor does it make others fail. A document is good or toxic if any
of its labels says so; one without labels is neither. An empty table gives no
rows. Extra columns may have any name.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FILTERS = "ABCDE"
MIN_WORDS = 100
_SPACE = "[\\x20\\x09-\\x0D]+"


def path_counts(n: int) -> tuple[list[int], list[int]]:
    """Paths from the empty set to each set of n filters, and from each set to the full one."""
    full = (1 << n) - 1
    forward, backward = [0] * (full + 1), [0] * (full + 1)
    forward[0] = backward[full] = 1
    for state in range(full + 1):
        for bit in range(n):
            if not state >> bit & 1:
                forward[state | 1 << bit] += forward[state]
    for state in range(full, -1, -1):
        for bit in range(n):
            if not state >> bit & 1:
                backward[state] += backward[state | 1 << bit]
    return forward, backward


def lattice_edges(filters: str = FILTERS) -> list[tuple[int, int, int, list[tuple[str, int]]]]:
    """before (a set), filter (a bit), weight (orders through the edge), and these orders with the step."""
    n = len(filters)
    forward, backward = path_counts(n)
    through: dict[tuple[int, int], list[tuple[str, int]]] = {}
    for order in permutations(range(n)):
        before = 0
        for step, bit in enumerate(order, 1):
            through.setdefault((before, bit), []).append(("".join(filters[b] for b in order), step))
            before |= 1 << bit
    return [(s, b, forward[s] * backward[s | 1 << b], orders) for (s, b), orders in sorted(through.items())]


def failed_filters(text: Column, min_words: int = MIN_WORDS) -> Column:
    """The filters A to D that a text fails, as bits 0 to 3."""
    words = F.filter(F.split(text, _SPACE), lambda w: w != "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    failed = (
        n < min_words,
        F.lit(100).cast("long") * distinct < F.lit(80).cast("long") * n,
        F.lit(100).cast("long") * capitals > F.lit(10).cast("long") * F.length(text),
        text.rlike("[#$%&*|]"),
    )
    bits = (F.when(f, 1 << bit).otherwise(0) for bit, f in enumerate(failed))
    return sum(bits, F.lit(0))


def failure_counts(docs: DataFrame, labels: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """part, failed (bits 0 to 4), n, n_good, n_toxic: at most 32 rows per part."""
    text = F.coalesce(F.col("text"), F.lit(""))
    copies = (
        docs.select(
            "doc_id",
            F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"),
            F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"),
            failed_filters(text, min_words).alias("own"),
        )
        .groupBy("doc_id", "part", "digest", "own")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    marks = labels.groupBy("doc_id").agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"),
    )
    marked = copies.join(marks, "doc_id", "left")
    kinds = ["digest", "part", "own", "good", "toxic"]
    # Only the rows of a digest's smallest doc_id pass E; the struct brings their number along.
    named = marked.where("doc_id is not null").groupBy(*kinds, "doc_id").agg(F.sum("n").alias("n"))
    groups = named.groupBy(*kinds).agg(
        F.sum("n").alias("n"), F.min(F.struct("doc_id", "n")).alias("first")
    )
    least = groups.groupBy("digest").agg(F.min("first.doc_id").alias("least"))
    judged = groups.join(least, "digest").select(
        "part", "own", "good", "toxic", "n", F.when(F.col("first.doc_id") == F.col("least"), F.col("first.n")).otherwise(0).alias("firsts")
    )
    nameless = marked.where("doc_id is null").select("part", "own", "good", "toxic", "n", F.col("n").alias("firsts"))
    split = judged.unionByName(nameless).select(
        "part",
        "good",
        "toxic",
        F.inline(
            F.array(
                F.struct(F.col("own").alias("failed"), F.col("firsts").alias("n")),
                F.struct((F.col("own") + 16).alias("failed"), (F.col("n") - F.col("firsts")).alias("n")),
            )
        ),
    )
    return split.groupBy("part", "failed").agg(
        F.sum("n").alias("n"),
        F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("n_good"),
        F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("n_toxic"),
    )


def audit(docs: DataFrame, labels: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    counts = failure_counts(docs, labels, min_words)
    edges = lattice_edges()
    lattice = F.array(
        *(
            F.struct(F.lit(before).alias("before"), F.lit(1 << bit).alias("own"), F.lit(FILTERS[bit]).alias("filter"), F.lit(weight).alias("weight"))
            for before, bit, weight, _ in edges
        )
    )
    there = F.col("failed").bitwiseAND(F.col("before")) == 0
    fails = F.col("failed").bitwiseAND(F.col("own")) != 0

    def total(condition: Column, name: str = "n") -> Column:
        return F.sum(F.when(condition, F.col(name)).otherwise(0))

    per_edge = (
        counts.select("*", F.inline(lattice))
        .groupBy("part", "before", "filter", "weight")
        .agg(
            total(there & ~fails).alias("kept"),
            total(there & fails).alias("removed"),
            total(~there & fails).alias("redundant"),
            total(F.col("failed") == F.col("own")).alias("unique_fails"),
            total(there & fails, "n_good").alias("good_lost"),
            total(there & fails, "n_toxic").alias("toxic_lost"),
        )
    )
    share = F.sum(F.col("removed") * F.col("weight")).over(Window.partitionBy("part", "filter"))  # 16 edges
    # Every order once per edge on its path, looked up by the edge.
    paths = F.map_from_arrays(
        F.array(*(F.lit(f"{before}{FILTERS[bit]}") for before, bit, _, _ in edges)),
        F.array(*(F.lit(" ".join(f"{order}{step}" for order, step in orders)) for *_, orders in edges)),
    )
    place = F.explode(F.split(paths[F.concat(F.col("before").cast("string"), F.col("filter"))], " "))
    return (
        per_edge.withColumn("shapley", share)
        .withColumn("place", place)
        .select(
            "part",
            F.substring("place", 1, len(FILTERS)).alias("filter_order"),
            F.substring("place", len(FILTERS) + 1, 1).cast("int").alias("step"),
            "kept",
            "removed",
            "redundant",
            "unique_fails",
            "good_lost",
            "toxic_lost",
            "shapley",
        )
    )


_CONDITIONS = {
    "A": f"len(words) < {MIN_WORDS}",
    "B": "100 * len(list_distinct(words)) < 80 * len(words)",
    "C": "100 * length(regexp_replace(body, '[^A-Z]', '', 'g')) > 10 * length(body)",
    "D": "regexp_matches(body, '[#$%&*|]')",
    "E": "coalesce(t.doc_id > min(t.doc_id) over (partition by body), false)",
}
_FAILS = ", ".join(f"cast({condition} as int) as {name}" for name, condition in _CONDITIONS.items())

SQL = f"""
with texts as (
    select doc_id, coalesce(lang, '') as part, coalesce(text, '') as body,
           list_filter(string_split_regex(coalesce(text, ''), '[ \\x09-\\x0D]+'), lambda x: x <> '') as words
    from documents
), marks as (
    select doc_id, max(coalesce(quality = 1, false)) as good, max(coalesce(toxic = 1, false)) as toxic from labels group by doc_id
), judged as (
    select t.doc_id, part, coalesce(good, false) as good, coalesce(toxic, false) as toxic, {_FAILS}
    from texts t left join marks m on m.doc_id = t.doc_id
), long as (
    select row, part, good, toxic, letter, failed, sum(failed) over (partition by row) as fails
    from (select row_number() over () as row, * from judged)
    unpivot (failed for letter in (A, B, C, D, E))
), letters as (select unnest(['A', 'B', 'C', 'D', 'E']) as l
), orders as (
    select a.l || b.l || c.l || d.l || e.l as filter_order
    from letters a, letters b, letters c, letters d, letters e
    where len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5
), first_failure as (
    -- per document and order the step that removes it (6: none), over the distinct patterns only
    select p.pattern, o.filter_order, coalesce(min(case when contains(p.pattern, substr(o.filter_order, s.step, 1)) then s.step end), 6) as gone
    from (select distinct coalesce(string_agg(letter, '' order by letter) filter (failed = 1), '') as pattern from long group by row) p,
         orders o, (select unnest([1, 2, 3, 4, 5]) as step) s
    group by p.pattern, o.filter_order
), counts as (
    select part, pattern, count(*) as n, count(*) filter (good) as n_good, count(*) filter (toxic) as n_toxic
    from (select row, part, good, toxic, coalesce(string_agg(letter, '' order by letter) filter (failed = 1), '') as pattern
          from long group by row, part, good, toxic)
    group by part, pattern
), steps as (
    select part, filter_order, step, substr(filter_order, step, 1) as letter,
           sum(case when gone > step then n else 0 end) as kept,
           sum(case when gone = step then n else 0 end) as removed,
           sum(case when gone < step and contains(pattern, substr(filter_order, step, 1)) then n else 0 end) as redundant,
           sum(case when pattern = substr(filter_order, step, 1) then n else 0 end) as unique_fails,
           sum(case when gone = step then n_good else 0 end) as good_lost,
           sum(case when gone = step then n_toxic else 0 end) as toxic_lost
    from counts join first_failure using (pattern), (select unnest([1, 2, 3, 4, 5]) as step) s
    group by part, filter_order, step
)
select part, filter_order, cast(step as integer) as step, cast(kept as bigint) as kept, cast(removed as bigint) as removed,
       cast(redundant as bigint) as redundant, cast(unique_fails as bigint) as unique_fails, cast(good_lost as bigint) as good_lost,
       cast(toxic_lost as bigint) as toxic_lost, cast(sum(removed) over (partition by part, letter) as bigint) as shapley
from steps
"""
