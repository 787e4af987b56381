"""Running totals, ranks and quantiles that need a global order.

A window over a whole group sorts it in one task, which is the cheapest way for
a group that fits one. The operators here store their input once, count the rows
of each group, and take a plain window for all groups of up to ``SLOT_ROWS``. Only
larger groups are aggregated per slot of the order (such as a minute); the totals
before each slot come from those few rows, and windows work within slots.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderloom.functions.scalars import BROADCAST_ROWS, bounded
from orderloom.session import stored

# A slot with more rows is cut into pieces of about this many.
SLOT_ROWS = 2_000_000
# Most cuts of all slots together, which travel to every task.
_ALL_CUTS = 1_000_000
_FAN, _LEVELS = 16, 4
# Ranges that a quantile's bracket is put in order by.
_BRACKET_SLOTS = 1024


def running_totals(
    df: DataFrame,
    by: Sequence[str],
    slot: Column,
    order: Sequence[str],
    totals: Mapping[str, Column],
    *,
    minima: Mapping[str, Column] | None = None,
    descending: bool = False,
    slot_rows: int = SLOT_ROWS,
) -> DataFrame:
    """Add running sums and minima over the rows of each group in order.

    The input is written to the shared folder and counted when this is called,
    so what it is made of is computed once. Groups of up to ``slot_rows`` rows
    get one window; the others go through slots, as follows.

    ``order`` names the columns to order by, all of them falling if
    ``descending``; together they should tell the rows of a group apart. ``slot``
    cuts the order into ranges and must not decrease along it. The values before
    a slot come from one row per group and slot. A slot of more than
    ``slot_rows`` rows is cut again at rows picked by their hash, into as many
    pieces as its own number of rows asks for. Both cuts follow from the data
    alone and are the same in a retry.

    The cuts are broadcast, so there may be no more than 10 000 slots with cuts
    and a million cuts: beyond 2 * 10^10 rows only slots of more than one in
    10 000 rows are cut, and beyond 5 * 10^11 rows pieces grow.
    """
    folds = {n: (e, F.sum, F.lit(0)) for n, e in totals.items()}
    folds |= {n: (e, F.min, None) for n, e in (minima or {}).items()}
    rows = stored(df, "ordered")
    # One struct, unlike plain columns, joins null groups as equal.
    group = F.struct(*by, F.lit(0).alias("_group"))
    sizes = rows.groupBy(group.alias("_of")).agg(F.count(F.lit(1)).alias("_rows"))
    large = stored(sizes.where(F.col("_rows") > slot_rows).select("_of"), "large_groups")
    if large.isEmpty():
        return _windowed(rows, by, order, folds, descending)
    marked = rows.withColumn("_of", group)
    few = marked.join(large, "_of", "left_anti").select(*df.columns)
    many = marked.join(large, "_of", "left_semi").select(*df.columns)
    return _windowed(few, by, order, folds, descending).unionByName(
        _by_slots(many, by, slot, order, folds, descending=descending, slot_rows=slot_rows)
    )


def _running(by: Sequence[str], order: Sequence[str], descending: bool) -> Window:
    return (
        Window.partitionBy(*by)
        .orderBy(*(F.col(c).desc() if descending else F.col(c) for c in order))
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )


def _windowed(df: DataFrame, by: Sequence[str], order: Sequence[str], folds: Mapping[str, tuple], descending: bool) -> DataFrame:
    """The running values of groups that fit one task."""
    within = _running(by, order, descending)
    return df.select(*df.columns, *(fold(e).over(within).alias(n) for n, (e, fold, _) in folds.items()))


def _by_slots(
    df: DataFrame,
    by: Sequence[str],
    slot: Column,
    order: Sequence[str],
    folds: Mapping[str, tuple],
    *,
    descending: bool,
    slot_rows: int,
) -> DataFrame:
    """The running values of groups of any size."""
    coarse = df.withColumn(
        "_coarse", F.struct(*by, F.coalesce(slot.cast("bigint"), F.lit(-(2**62))).alias("_slot"))
    ).withColumn("_place", F.struct(*order))

    def folded(rows: DataFrame, *keys: str) -> DataFrame:
        values = (fold(e).alias(f"_all_{n}") for n, (e, fold, _) in folds.items())
        return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *values)

    per_coarse = folded(coarse, "_coarse")
    rows = per_coarse.agg(F.sum("_n").alias("n")).select("n").scalar()
    least = F.greatest(F.lit(slot_rows), rows / F.lit(BROADCAST_ROWS))
    piece = F.greatest(F.lit(slot_rows), 4 * rows / F.lit(_ALL_CUTS))
    hot = per_coarse.where(F.col("_n") > least).select("_coarse", F.col("_n"), piece.alias("_piece"))
    cuts = bounded(_cuts(coarse, bounded(hot, BROADCAST_ROWS)), BROADCAST_ROWS)

    def keyed(rows: DataFrame, how: str) -> DataFrame:
        """Rows with their key: one struct, unlike plain columns, joins null groups as
        equal and keeps a single shuffle for the window and the join."""
        fine = F.when(F.col("_cuts").isNotNull(), _place_among(F.col("_place")))
        return (
            rows.join(cuts, "_coarse", how)
            .withColumn("_key", F.struct("_coarse.*", (-fine if descending else fine).alias("_fine")))
            .drop("_cuts")
        )

    # Slots as they are, except for hot ones, whose rows are read once more.
    whole = F.struct("_coarse.*", F.lit(None).cast("int").alias("_fine"))
    per_slot = (
        per_coarse.join(cuts, "_coarse", "left")
        .where(F.col("_cuts").isNull())
        .withColumn("_key", whole)
        .drop("_coarse", "_cuts")
        .unionByName(folded(keyed(coarse, "inner"), "_key"))
    )
    earlier = (
        Window.partitionBy(*(f"_key.{c}" for c in by))
        .orderBy("_key._slot", "_key._fine")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = per_slot.select(
        "_key", *(fold(f"_all_{n}").over(earlier).alias(f"_before_{n}") for n, (_, fold, _) in folds.items())
    )
    within = _running(["_key"], order, descending)
    inside = {f"_in_{n}": fold(e).over(within) for n, (e, fold, _) in folds.items()}
    joined = keyed(coarse, "left").withColumns(inside).join(offsets, "_key")

    def combined(name: str, start: Column | None) -> Column:
        before, inside = F.col(f"_before_{name}"), F.col(f"_in_{name}")
        if start is None:
            return F.least(before, inside).alias(name)
        return (F.coalesce(before, start) + inside).alias(name)

    return joined.select(*df.columns, *(combined(n, start) for n, (_, _, start) in folds.items()))


def _cuts(df: DataFrame, hot: DataFrame) -> DataFrame:
    """Some places of each hot slot, those with the lowest hashes, as a tree of sorted arrays.

    Each level holds the last places of the chunks of the level below. There are
    about four places for each piece that a slot should be cut into.
    """
    place, n = F.col("_place"), F.col("_n")
    wanted = F.least(4 * F.ceil(n / F.col("_piece")), F.lit(_FAN**_LEVELS // 2))
    picked = df.select("_coarse", "_place").join(hot, "_coarse").where(F.pmod(F.xxhash64(place), n) < wanted)

    def every(step: int) -> Column:
        return F.filter("a", lambda _, i: (i + 1) % step == 0)

    levels = [every(_FAN**level).alias(f"level{level}") for level in range(_LEVELS)]
    distinct = F.slice(F.array_sort(F.collect_set(place)), 1, _FAN**_LEVELS)
    return picked.groupBy("_coarse").agg(distinct.alias("a")).select("_coarse", F.struct(*levels).alias("_cuts"))


def _place_among(place: Column) -> Column:
    """Number of cuts, in the column ``_cuts``, before a place; a step down per level."""
    before = F.lit(0)
    for level in reversed(range(_LEVELS)):
        chunk = F.slice(F.col(f"_cuts.level{level}"), before + 1, _FAN)
        before = before + F.size(F.filter(chunk, lambda cut: cut < place))
        if level:
            before = before * _FAN
    return before


def value_rank(df: DataFrame, column: str, slots: int = 4096, copies: str | None = None) -> DataFrame:
    """Rank of each distinct value of a column; equal rows share their mean rank.

    ``copies`` names a column with how many rows each row stands for.

    Distinct values are counted and laid into slots of equal width between the
    lowest and the highest value. A slot follows from the value and these two
    alone, so it is the same in every task and every retry.
    """
    number = F.count(F.lit(1)) if copies is None else F.sum(copies)
    counted = df.where(F.col(column).isNotNull()).groupBy(column).agg(number.alias("copies"))
    ends = df.agg(F.min(column).alias("low"), F.max(column).alias("high"))
    shared = _shared_length("low", "high") if df.schema[column].dataType == T.StringType() else F.lit(0)
    scale = ends.select(
        F.struct(
            shared.alias("shared"),
            _code(df, "low", column, shared).alias("low"),
            _code(df, "high", column, shared).alias("high"),
        ).alias("scale")
    ).select("scale")
    scaled = counted.withColumn("_scale", scale.scalar())
    code = _code(df, column, column, F.col("_scale.shared"))
    width = F.nullif(F.col("_scale.high") - F.col("_scale.low"), F.lit(0.0))
    slot = F.coalesce(F.floor((code - F.col("_scale.low")) / width * slots), F.lit(0))
    ranked = running_totals(scaled, [], slot, [column], {"upto": F.col("copies")})
    return ranked.select(
        column, (F.col("upto") - (F.col("copies") - 1) / F.lit(2.0)).cast("double").alias("rank")
    )


def _shared_length(low: str, high: str) -> Column:
    """Length of the common start of two texts, which all texts between them have."""
    longest = F.least(F.length(low), F.length(high))
    same = F.filter(
        F.sequence(F.lit(0), longest),
        lambda n: F.substring(F.col(low), F.lit(1), n) == F.substring(F.col(high), F.lit(1), n),
    )
    return F.coalesce(F.array_max(same), F.lit(0))


def _code(df: DataFrame, source: str, typed_as: str, shared: Column) -> Column:
    """A double that does not decrease along the order of a column."""
    kind = df.schema[typed_as].dataType
    c = F.col(source)
    if isinstance(kind, T.StringType):
        # Six bytes after the start that all values share.
        tail = F.encode(F.substring(c, shared + 1, F.lit(6)), "UTF-8")
        return F.conv(F.rpad(F.hex(F.substring(tail, 1, 6)), 12, "0"), 16, 10).cast("double")
    if isinstance(kind, T.BooleanType):
        return c.cast("int").cast("double")
    if isinstance(kind, T.DateType):
        return F.datediff(c, F.lit("1970-01-01").cast("date")).cast("double")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        origin = F.lit("1970-01-01 00:00:00").cast(kind)
        return F.timestamp_diff("MICROSECOND", origin, c).cast("double")
    return c.cast("double")


def exclusive_quantile(
    df: DataFrame,
    value: str,
    by: Sequence[str] = (),
    *,
    cut: int = 19,
    parts: int = 20,
    accuracy: int = 50_000,
    name: str = "quantile",
) -> DataFrame:
    """Exact quantile at ``cut / parts`` of each group, by the exclusive method.

    The position is ``cut * (n + 1) / parts``, interpolated between neighbours.
    A sketch with a guaranteed rank error brackets the position in groups of
    more than ``accuracy`` rows. Rows below the bracket are only counted, rows
    above it are dropped, and rows inside are counted per distinct value, which
    all happens before the shuffle. So the order is only built over a few
    values, and the result is still the exact one; a bracket that misses the
    position, which the sketch's guarantee rules out, fails the query instead of
    giving a wrong value. The values of a bracket are put in order by ranges, so
    no task sorts a whole bracket.
    """
    by = list(by)
    rows = df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v"))
    share, margin = cut / parts, 4 / accuracy
    sketch = F.percentile_approx(
        "_v", [max(share - margin, 0.0), min(share + margin, 1.0)], accuracy
    )
    stats = rows.groupBy(*by).agg(F.count("_v").alias("_n"), sketch.alias("_b"))
    scaled = F.lit(cut) * (F.col("_n") + 1)
    rank = F.greatest(F.lit(1), F.least((scaled / F.lit(parts)).cast("bigint"), F.col("_n") - 1))
    wide = F.col("_n") >= accuracy
    bracket = stats.select(
        *by,
        F.col("_n"),
        F.when(wide, F.col("_b")[0]).alias("_lo"),
        F.when(wide, F.col("_b")[1]).alias("_hi"),
        rank.alias("_rank"),
        (scaled - rank * parts).alias("_rest"),
    )
    if by:
        key = F.struct(*by).alias("_key")
        limits = bracket.select(key, "_n", "_lo", "_hi", "_rank", "_rest")
        marked = rows.select("*", key).join(limits, "_key")
    else:
        marked = rows.withColumns(
            {c: bracket.select(c).scalar() for c in ("_n", "_lo", "_hi", "_rank", "_rest")}
        )
    inside = F.when(F.col("_lo").isNull() | (F.col("_v") >= F.col("_lo")), F.col("_v"))
    counted = (
        marked.where(F.col("_hi").isNull() | (F.col("_v") <= F.col("_hi")))
        .groupBy(*by, "_n", "_lo", "_hi", "_rank", "_rest", inside.alias("_value"))
        .agg(F.count(F.lit(1)).alias("_copies"))
    )
    width = F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0))
    slot = F.coalesce(F.floor((F.col("_value") - F.col("_lo")) / width * _BRACKET_SLOTS), F.lit(-1))
    ordered = running_totals(counted, by, slot, ["_value"], {"_upto": F.col("_copies")})

    def at(position: Column) -> Column:
        return F.min(F.when(F.col("_upto") >= position, F.col("_value")))

    picked = (
        ordered.groupBy(*by, "_n", "_rank", "_rest")
        .agg(
            at(F.col("_rank")).alias("_x"),
            at(F.least(F.col("_rank") + 1, F.col("_n"))).alias("_y"),
            F.max(F.when(F.col("_value").isNull(), F.col("_upto"))).alias("_below"),
        )
    )
    missed = F.col("_x").isNull() | F.col("_y").isNull() | (F.col("_below") >= F.col("_rank"))
    result = (F.col("_x") * (parts - F.col("_rest")) + F.col("_y") * F.col("_rest")) / F.lit(parts)
    return picked.select(
        *by,
        F.when(missed, F.raise_error(F.lit("the sketch did not bracket the quantile")).cast("double"))
        .otherwise(result)
        .alias(name),
    )

