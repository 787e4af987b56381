"""Phrases of two and three words that occur together, by top-order marginalisation.

Texts are lower-cased (A-Z), cut into pieces at punctuation and line breaks and
into words at spaces and tabs. Every word starts one window: itself and the two
words that lead it within its piece, padded with nulls where the piece ends.
Only these longest windows are counted. The counts of all shorter phrases are
sums over their continuations, which Spark's ROLLUP takes over (lang, word,
second, third): no shorter phrase is exploded on its own.

Before they are counted, windows are cut to the prefix that can matter: a pair
can be a candidate only if it reaches ``least``, a triple only if it does and both
pairs in it do. Pairs are counted by a hash of ``SLOTS`` values first, then the
triples of frequent pairs; those that reach ``least`` set a bit in a table of
``BITS`` bits each, the only broadcasts, 16 MB at most whatever the corpus. A hash
or bit shared by chance leaves a window longer than needed and never changes a
result; beyond some ten million frequent pairs the table cuts less and more
windows are shuffled. Cut windows still count towards every shorter phrase. All
counts are combined before they are shuffled, keys are whole windows, so neither
a frequent word nor a frequent pair is summed in one task.

Scores are exact integers: counts up to 10^15 are safe, beyond that the query
fails instead of rounding.

Null texts count as empty, a null lang is ``und``; texts without words count for
nothing. Repeated rows count each. An empty table gives no phrases. Extra columns
may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderloom.llm.common import stored

LEAST = 10
INSIDE_PERCENT = 50
TOP = 2000
BITS = 1 << 26
#: Kinds of hash; more would be longer to shuffle, and what shares one only leaves windows longer.
SLOTS = 1 << 32
_RANKED_PARTS = 32

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BREAKS = ".,;:!?\n\x0b\x0c\r"


def windows(docs: DataFrame) -> DataFrame:
    """lang, w1, w2, w3: one row per word with the two that lead it in its piece, null beyond the end."""
    plain = F.translate(F.coalesce("text", F.lit("")), _UPPER + _BREAKS + "\t", _LOWER + "\n" * len(_BREAKS) + " ")
    tokens = F.array_remove(F.split(F.replace(plain, F.lit("\n"), F.lit(" \n ")), " "), "")
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), tokens.alias("tokens"))
    leads = (F.slice("tokens", 1 + k, F.size("tokens")).alias(f"w{1 + k}") for k in range(3))
    rows = texts.select("lang", F.inline(F.arrays_zip(*leads))).where("w1 <> '\n'")
    second = F.when(F.col("w2") != "\n", F.col("w2"))
    return rows.select("lang", "w1", second.alias("w2"), F.when(second.isNotNull() & (F.col("w3") != "\n"), F.col("w3")).alias("w3"))


def _slot(*words: str) -> Column:
    return F.xxhash64("lang", *words).bitwiseAND(F.lit(SLOTS - 1))


def _block(slot: Column, bits: int) -> Column:
    """The row of the bit table that holds a slot's bit."""
    return F.shiftrightunsigned(slot, 6).bitwiseAND(F.lit(bits // 64 - 1).cast("long"))


def _frequent(rows: DataFrame, words: tuple[str, ...], least: int, bits: int) -> DataFrame:
    """block and mask, at most bits / 64 rows: the bits of all phrases of these columns that occur ``least`` times, and of some others."""
    counted = rows.where(F.col(words[-1]).isNotNull()).groupBy(_slot(*words).alias("slot")).agg(F.count(F.lit(1)).alias("n"))
    often = counted.where(F.col("n") >= least).select("slot")
    bit = F.expr("shiftleft(1L, cast(slot & 63 as int))")
    return often.groupBy(_block(F.col("slot"), bits).alias("block")).agg(F.bit_or(bit).alias("mask"))


def frequent_pairs(rows: DataFrame, least: int, bits: int = BITS) -> DataFrame:
    return _frequent(rows, ("w1", "w2"), least, bits)


def _known(rows: DataFrame, table: DataFrame, words: tuple[str, ...], name: str, bits: int) -> DataFrame:
    """The rows and whether the bit of these columns is set."""
    own = F.broadcast(table.select(F.col("block").alias("_block"), F.col("mask").alias(name)))
    joined = rows.withColumn("_slot", _slot(*words)).join(own, _block(F.col("_slot"), bits) == F.col("_block"), "left")
    hit = F.expr(f"shiftrightunsigned({name}, cast(_slot & 63 as int)) & 1") == 1
    return joined.withColumn(name, F.coalesce(hit, F.lit(False))).drop("_slot", "_block")


def cut_windows(rows: DataFrame, least: int, bits: int = BITS) -> DataFrame:
    """The windows, each cut to the longest prefix that can reach ``least``."""
    pairs = stored(frequent_pairs(rows, least, bits), "pairs")
    started = _known(rows, pairs, ("w1", "w2"), "_start", bits)
    both = _known(started.where("_start and w3 is not null"), pairs, ("w2", "w3"), "_rest", bits).where("_rest")
    triples = stored(_frequent(both, ("w1", "w2", "w3"), least, bits), "triples")
    return _known(started, triples, ("w1", "w2", "w3"), "_whole", bits).select(
        "lang",
        "w1",
        F.when(F.col("_start"), F.col("w2")).alias("w2"),
        F.when(F.col("_start") & F.col("_whole"), F.col("w3")).alias("w3"),
    )


def phrase_counts(docs: DataFrame, least: int = LEAST, bits: int = BITS) -> DataFrame:
    """lang, w1, w2, w3, n, size (words, 0 for all words of a lang): every phrase of ``least`` occurrences."""
    longest = cut_windows(windows(docs), least, bits).groupBy("lang", "w1", "w2", "w3").agg(F.count(F.lit(1)).alias("n"))
    summed = longest.rollup("lang", "w1", "w2", "w3").agg(F.sum("n").alias("n"), F.grouping_id().alias("level"))
    # A padded window and a sum over windows both end in null; the level tells them apart, and
    # the phrase's own number is the sum.
    size = F.size(F.array_compact(F.array("w1", "w2", "w3")))
    whole = F.col("level") == F.element_at(F.array(*(F.lit((1 << k) - 1) for k in (3, 2, 1, 0))), size + 1)
    return summed.where(F.col("lang").isNotNull() & whole & ((size == 0) | (F.col("n") >= least))).select(
        "lang", "w1", "w2", "w3", "n", size.alias("size")
    )


def exact_score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 * a * a / (left * right)) without rounding."""

    def wide(c: Column) -> Column:
        return c.cast("decimal(38,0)")

    top = wide(wide(F.lit(1_000_000) * wide(a)) * wide(a))
    return F.call_function("div", top, wide(wide(left) * wide(right))).cast("long")


def collocations(docs: DataFrame, least: int = LEAST, inside_percent: int = INSIDE_PERCENT, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first ``top`` phrases of each language."""
    counts = stored(phrase_counts(docs, least), "phrases")
    totals = counts.where("size = 0").select("lang", F.col("n").alias("total"))
    words = counts.where("size = 1").select("lang", F.col("w1").alias("word"), F.col("n").alias("of_word"))
    pairs = counts.where("size = 2").select("lang", "w1", "w2", F.col("n").alias("a"))
    triples = counts.where("size = 3").select("lang", "w1", "w2", "w3", F.col("n").alias("a"))

    def with_word(df: DataFrame, column: str, name: str) -> DataFrame:
        own = words.select("lang", F.col("word").alias(column), F.col("of_word").alias(name))
        return df.join(own, ["lang", column])

    # Pairs inside a triple of at least half their number are dropped.
    around = (
        triples.select("lang", "w1", "w2", "a")
        .unionByName(triples.select("lang", F.col("w2").alias("w1"), F.col("w3").alias("w2"), "a"))
        .groupBy("lang", "w1", "w2")
        .agg(F.max("a").alias("around"))
    )
    free = pairs.join(around, ["lang", "w1", "w2"], "left").where(
        F.col("around").isNull() | (100 * F.col("around") < inside_percent * F.col("a"))
    )
    both = with_word(with_word(free, "w1", "l"), "w2", "r")
    scored = both.select(
        "lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), "a", "l", "r", exact_score(F.col("a"), F.col("l"), F.col("r")).alias("score")
    )
    starts = pairs.withColumnRenamed("a", "of_start")
    rests = pairs.select("lang", F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("a").alias("of_rest"))
    cuts = with_word(with_word(triples, "w1", "l1"), "w3", "r2").join(starts, ["lang", "w1", "w2"]).join(rests, ["lang", "w2", "w3"])
    first = exact_score(F.col("a"), F.col("l1"), F.col("of_rest"))
    second = exact_score(F.col("a"), F.col("of_start"), F.col("r2"))
    worst = F.least(
        F.struct(first.alias("score"), F.lit(1).alias("k"), F.col("l1").alias("l"), F.col("of_rest").alias("r")),
        F.struct(second.alias("score"), F.lit(2).alias("k"), F.col("of_start").alias("l"), F.col("r2").alias("r")),
    )
    long = cuts.select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a", worst.alias("cut")).select(
        "lang", "phrase", "a", "cut.l", "cut.r", "cut.score"
    )
    order = (F.col("score").desc(), F.col("a").desc(), F.col("phrase"))
    found = scored.unionByName(long).withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(_RANKED_PARTS)))
    # The first of every part hold the first of all, and are a bounded number.
    ahead = found.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    ranked = ahead.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("total").alias("n"), "score"
    )


SQL = f"""
with parts_of_texts as (
    select row_number() over () as piece, lang, part
    from (
        select coalesce(lang, 'und') as lang,
               unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                         '[.,;:!?\\x0A-\\x0D]')) as part
        from documents
    )
), words as (
    select piece, lang, generate_subscripts(words, 1) as pos, unnest(words) as w1
    from (select piece, lang, list_filter(string_split_regex(part, '[ \\x09]+'), lambda x: x <> '') as words from parts_of_texts)
), leads as (
    select lang, w1, lead(w1, 1) over (partition by piece order by pos) as w2, lead(w1, 2) over (partition by piece order by pos) as w3 from words
), grams as (
    select lang, 1 as size, [w1] as g from leads
    union all select lang, 2, [w1, w2] from leads where w2 is not null
    union all select lang, 3, [w1, w2, w3] from leads where w3 is not null
), f as (
    select lang, size, array_to_string(g, ' ') as phrase, g, cast(count(*) as hugeint) as n from grams group by lang, size, g
), total as (
    select lang, sum(n) as n from f where size = 1 group by lang
), candidates as (
    select * from f where size > 1 and n >= {LEAST}
), parts as (
    select lang, size, phrase, n as a, 1 as k, g[1] as head, array_to_string(list_slice(g, 2, size), ' ') as rest from candidates
    union all
    select lang, size, phrase, n as a, 2 as k, g[1] || ' ' || g[2], g[3] from candidates where size = 3
), cuts as (
    select p.lang, p.phrase, a, k, l.n as l, r.n as r, (1000000 * a * a) // (l.n * r.n) as score
    from parts p
    join f l on l.lang = p.lang and l.phrase = p.head
    join f r on r.lang = p.lang and r.phrase = p.rest
), worst as (
    select * from (select *, row_number() over (partition by lang, phrase order by score, k) as place from cuts) where place = 1
), covered as (
    select lang, phrase, max(n) as around
    from (select lang, g[1] || ' ' || g[2] as phrase, n from candidates where size = 3
          union all select lang, g[2] || ' ' || g[3], n from candidates where size = 3)
    group by lang, phrase
)
select w.lang, row_number() over (partition by w.lang order by score desc, a desc, w.phrase) as rank, w.phrase,
       cast(a as bigint) as a, cast(l as bigint) as l, cast(r as bigint) as r, cast(t.n as bigint) as n, cast(score as bigint) as score
from worst w join total t on t.lang = w.lang left join covered c on c.lang = w.lang and c.phrase = w.phrase
where c.around is null or 100 * c.around < {INSIDE_PERCENT} * w.a
qualify rank <= {TOP}
"""
