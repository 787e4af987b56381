"""Line removal by site-relative frequency, in DataFrame functions only.

A line is boilerplate of a site when the pages of the site that contain it are
more than ``max_ratio`` of all its pages, and at least ``min_pages``. Such lines
are dropped from the site's pages; a line counts once per page, blank lines are
neither counted nor dropped, and spaces, tabs and carriage returns around a line
do not matter. What is left keeps its order and its exact bytes.

Lines travel as digests, and only lines of enough pages reach the join with the
page totals, so a site that holds a third of all rows is counted in parts. A
site keeps at most (lines per page / max_ratio) boilerplate lines.

A null text stays null; a text of boilerplate alone becomes empty; a null site
is one with the empty site. Repeated rows count as pages of their own. An empty
table stays empty. Extra columns are kept whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderloom.llm.common import stored

MAX_RATIO = 0.08
#: Two pages may be copies of each other, which says nothing of the site; three do not meet by chance.
MIN_PAGES = 3
_AROUND = " \t\r"


def _key(line: Column) -> Column:
    return F.unhex(F.md5(F.btrim(line, F.lit(_AROUND))))


def _not_blank(line: Column) -> Column:
    return F.btrim(line, F.lit(_AROUND)) != ""


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def boilerplate(docs: DataFrame, site: str = "source", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """One row per site that has boilerplate: site, and the digests of its lines."""
    pages = docs.select(F.coalesce(F.col(site).cast("string"), F.lit("")).alias("site"), F.col("text"))
    totals = pages.groupBy("site").agg(F.count(F.lit(1)).alias("pages"))
    keys = F.array_distinct(F.transform(F.filter(_lines(F.col("text")), _not_blank), _key))
    seen = (
        pages.select("site", F.explode(keys).alias("line"))
        .groupBy("site", "line")
        .agg(F.count(F.lit(1)).alias("with_line"))
        .where(F.col("with_line") >= min_pages)
    )
    common = seen.join(totals, "site").where(F.col("with_line") > F.col("pages") * F.lit(max_ratio))
    return common.groupBy("site").agg(F.collect_list("line").alias("lines"))


def drop_boilerplate(
    docs: DataFrame, site: str = "source", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES
) -> DataFrame:
    """row (all columns as they were), text without boilerplate, n_lines, n_dropped."""
    common = stored(boilerplate(docs, site, max_ratio, min_pages), "boilerplate")
    packed = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"),
        F.coalesce(F.col(site).cast("string"), F.lit("")).alias("site"),
    )
    lines = _lines(F.col("row.text"))
    kept = F.filter(lines, lambda line: ~(_not_blank(line) & F.array_contains("lines", _key(line))))
    joined = packed.join(common, "site", "left")
    cleaned = joined.select("row", F.when(F.col("lines").isNull(), lines).otherwise(kept).alias("kept"))
    return cleaned.select(
        "row",
        F.array_join("kept", "\n").alias("text"),
        F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size(lines) - F.size("kept"), F.lit(0)).cast("long").alias("n_dropped"),
    )


def cleaned_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, text."""
    return drop_boilerplate(docs).select(F.col("row.doc_id").alias("doc_id"), "n_lines", "n_dropped", "text")


SQL = f"""
with pages as (
    select row_number() over () as page, doc_id, coalesce(source, '') as site, text from documents
), lines as (
    select page, site, generate_subscripts(parts, 1) as place, unnest(parts) as line
    from (select page, site, string_split(text, chr(10)) as parts from pages)
), keyed as (
    select page, site, place, line, trim(line, ' ' || chr(9) || chr(13)) as key from lines
), common as (
    select k.site, k.key
    from (select site, key, count(distinct page) as with_line from keyed where key <> '' group by site, key) k
    join (select site, count(*) as pages from pages group by site) t on t.site = k.site
    where with_line >= {MIN_PAGES} and with_line > pages * {MAX_RATIO}
), judged as (
    select k.*, c.key is not null as dropped from keyed k left join common c on c.site = k.site and c.key = k.key
), rebuilt as (
    select page, count(*) as n_lines, count(*) filter (dropped) as n_dropped,
           coalesce(string_agg(line, chr(10) order by place) filter (not dropped), '') as cleaned
    from judged group by page
)
select p.doc_id, coalesce(r.n_lines, 0) as n_lines, coalesce(r.n_dropped, 0) as n_dropped,
       case when p.text is not null then r.cleaned end as text
from pages p left join rebuilt r on r.page = p.page
"""
