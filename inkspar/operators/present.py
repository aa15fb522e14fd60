"""Ranking and grouping of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import display_relevance, display_title
from ..schema import INDEX, PAGE, TERM
from ..staging import stage


def rank_order() -> list[Column]:
    return [F.desc("rel"), F.asc("entry_type"), F.asc("target")]


def entry_order() -> list[Column]:
    return [F.asc("subj"), F.desc("rel"), F.asc("entry_type"), F.asc("target")]


def ranked(df: DataFrame) -> DataFrame:
    return df.orderBy(*rank_order())


def top(df: DataFrame, k: int) -> DataFrame:
    """The k best, without a full sort."""
    return df.orderBy(*rank_order()).limit(k)


def pages(df: DataFrame) -> DataFrame:
    return df.where(F.col("entry_type") == PAGE)


def related_terms(df: DataFrame) -> DataFrame:
    return df.where(F.col("entry_type") == TERM)


def related_indexes(df: DataFrame) -> DataFrame:
    return df.where(F.col("entry_type") == INDEX)


def newest_edition(df: DataFrame) -> DataFrame:
    """All pages of the newest edition of each site, by an aggregation that is written and a join: a site with many pages stays spread,
    as both sides of the join are plain and adaptive execution cuts what is large.  df is read twice."""
    newest = stage(df.groupBy("site").agg(F.max("edition").alias("newest")))
    return df.join(newest, "site").where(F.col("edition") == F.col("newest")).drop("newest")


def mark_newest(df: DataFrame) -> DataFrame:
    newest = stage(df.groupBy("site").agg(F.max("edition").alias("newest_edition")))
    return df.join(newest, "site").withColumn("newest", F.col("edition") == F.col("newest_edition")).drop("newest_edition")


def site_groups(df: DataFrame) -> DataFrame:
    """(site, edition, pages, rel): the relevance of a site is the best of its pages."""
    return df.groupBy("site", "edition").agg(F.count("*").alias("pages"), F.max("rel").alias("rel"))


def older_versions(df: DataFrame) -> DataFrame:
    """(site, older): matching editions besides the newest."""
    editions = df.select("site", "edition").distinct()
    return editions.groupBy("site").agg((F.count("*") - 1).alias("older"))


def count_line(df: DataFrame) -> DataFrame:
    return df.agg(F.concat(F.lit("Found "), F.count("*").cast("string"), F.lit(" results")).alias("line"))


def present(df: DataFrame, group_sites: bool = True, show_old: bool = False) -> DataFrame:
    """What a result page shows: newest editions first by site, or a flat list by relevance."""
    shown = df if show_old or not group_sites else newest_edition(df)
    out = shown.withColumn("shown_title", display_title(F.col("title"), F.col("target"))).withColumn("relevance", display_relevance(F.col("rel")))
    if not group_sites:
        return out.orderBy(*rank_order())
    best = out.groupBy("site").agg(F.max("rel").alias("site_rel"))
    return out.join(best, "site").orderBy(F.desc("site_rel"), "site", "edition", F.desc("rel"), "target")


#: What a stop query, which gives no plan, is answered with.
STOP_MESSAGE = "All words of the query are too common to be searched for."


def message(found: DataFrame | None) -> DataFrame | str:
    return STOP_MESSAGE if found is None else count_line(found)


def to_html(df: DataFrame | None, limit: int = 1000) -> str:
    """A page for people: how many results there are, and the first of them."""
    import html

    if df is None:
        return f"<p>{STOP_MESSAGE}</p>"
    total = count_line(df).first()["line"]
    rows = present(df, group_sites=False).limit(limit).collect()
    items = "".join(f"<li><a href='{html.escape(r['target'])}'>{html.escape(r['shown_title'] or r['target'])}</a> {html.escape(r['relevance'])}</li>" for r in rows)
    return f"<p>{total}</p><ol>{items}</ol>"
