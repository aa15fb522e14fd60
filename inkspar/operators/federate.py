"""Trust-weighted relevance over several indexes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import INDEX, PAGE, TERM


def avg_relevance(votes: DataFrame) -> DataFrame:
    """(subj, term, rel) from (subj, term, trust, rel); rel null: the index gives none.

    Weighted mean of those that answer, reduced when they are less than a third of all trust: two of nine equal indexes
    that say 0.5 give 1/3.
    """
    answered = F.col("rel").isNotNull()
    w = F.sum(F.when(answered, F.col("trust")).otherwise(0.0))
    top = F.sum(F.when(answered, F.col("trust") * F.col("rel")).otherwise(0.0))
    value = F.when(w > 0, top / w * F.least(F.lit(1.0), 3 * w / F.sum("trust"))).otherwise(0.0)
    return votes.groupBy("subj", "term").agg(value.alias("rel"))


def effective_relevance(edges: DataFrame, root: str, max_hops: int = 8) -> DataFrame:
    """(term, rel, hops): the largest product of relevances over paths from root, of at most max_hops edges (src, dst, rel).

    The frontier of each round is joined with the edges; relevances are held to 1, so the products can only fall and
    the rounds end when nothing improves.
    """
    from ..staging import stage

    spark = edges.sparkSession
    usable = edges.select("src", "dst", F.least("rel", F.lit(1.0)).alias("rel")).where("rel > 0").groupBy("src", "dst").agg(F.max("rel").alias("rel"))
    best = spark.createDataFrame([(root, 1.0, 0)], "term string, rel double, hops int")
    frontier = best
    for hop in range(1, max_hops + 1):
        step = frontier.select(F.col("term").alias("src"), F.col("rel").alias("up")).join(usable, "src").groupBy(F.col("dst").alias("term")).agg(F.max(F.col("up") * F.col("rel")).alias("rel"))
        old = best.select("term", F.col("rel").alias("old"))
        frontier = stage(step.join(old, "term", "left").where(F.col("old").isNull() | (F.col("rel") > F.col("old"))).select("term", "rel", F.lit(hop).alias("hops")))
        if frontier.isEmpty():
            break
        best = stage(best.unionByName(frontier).groupBy("term").agg(F.max("rel").alias("rel"), F.max_by("hops", "rel").alias("hops")))
    return best


def frontier_terms(state: DataFrame) -> DataFrame:
    """(term, trust, min_hops) of a federated query: a term reached twice keeps its least distance and best trust."""
    return state.groupBy("term").agg(F.max("trust").alias("trust"), F.min("hops").alias("min_hops"))


def results_with_parents(rows: DataFrame) -> DataFrame:
    """(term, parents): the relevances that each parent gave, by parent; of equal ones one, so a map is as large as a term has different ones."""
    by_parent = rows.groupBy("term", "parent").agg(F.array_sort(F.collect_set("rel")).alias("rels"))
    return by_parent.groupBy("term").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("parent", "rels")))).alias("parents"))


def federated_search(entries: DataFrame, root: str, term: str, max_hops: int = 4) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Search index after index: (pages, indexes, terms) from entries (index, term, entry_type, target, rel).

    The query begins with one index, trusted fully, and one term.  Every round looks up all open terms in all known indexes, in one join each:
    INDEX entries make another index known, with the trust of the one that names it times their relevance; TERM entries open another
    term, with its relevance times theirs; relevances are held to 1, and the best way to an index or a term counts.  Rounds end when
    nothing improves, or after max_hops.

    indexes: (index, trust, hops, done, pending): its terms that were looked up in the last state, and those that were not.  terms: (term, rel, hops).
    pages: (subj, target, rel, parents): relevance by avg_relevance over the indexes that answered a term for the page, times that of the
    term, the best term counting; parents: the indexes that gave it.
    """
    from ..staging import stage

    spark = entries.sparkSession
    usable = entries.withColumn("rel", F.least("rel", F.lit(1.0))).where("rel > 0")
    indexes = spark.createDataFrame([(root, 1.0, 0)], "index string, trust double, hops int")
    terms = spark.createDataFrame([(term, 1.0, 0)], "term string, weight double, hops int")
    mark = None
    for hop in range(1, max_hops + 1):
        hits = usable.where(F.col("entry_type") != PAGE).join(indexes.select("index", "trust"), "index").join(terms.select("term", "weight"), "term")
        hits = stage(hits.select("entry_type", "target", "rel", "trust", "weight"))
        more = hits.where(F.col("entry_type") == INDEX).groupBy(F.col("target").alias("index")).agg(F.max(F.col("trust") * F.col("rel")).alias("trust")).withColumn("hops", F.lit(hop))
        indexes = stage(indexes.unionByName(more).groupBy("index").agg(F.max("trust").alias("trust"), F.min("hops").alias("hops")))
        more = hits.where(F.col("entry_type") == TERM).groupBy(F.col("target").alias("term")).agg(F.max(F.col("weight") * F.col("rel")).alias("weight")).withColumn("hops", F.lit(hop))
        terms = stage(terms.unionByName(more).groupBy("term").agg(F.max("weight").alias("weight"), F.min("hops").alias("hops")))
        state = (indexes.agg(F.count("*"), F.sum("trust")).first(), terms.agg(F.count("*"), F.sum("weight")).first())
        if state == mark:
            break
        mark = state
    found = usable.where(F.col("entry_type") == PAGE).join(indexes.select("index", "trust"), "index").join(terms.select("term", "weight"), "term")
    found = stage(found.select("index", "trust", "term", "weight", "target", "rel"))
    # for each page and term: what the indexes that have the term say, the others that have it say nothing
    asked = found.select("index", "trust", "term").distinct()
    trust = asked.groupBy("term").agg(F.sum("trust").alias("all_trust"))
    said = found.groupBy("term", "weight", "target", "index", "trust").agg(F.max("rel").alias("rel"))
    means = said.groupBy("term", "weight", "target").agg(F.sum("trust").alias("w"), F.sum(F.col("trust") * F.col("rel")).alias("top"))
    rel = F.col("top") / F.col("w") * F.least(F.lit(1.0), 3 * F.col("w") / F.col("all_trust")) * F.col("weight")
    best = means.join(trust, "term").groupBy("target").agg(F.max(rel).alias("rel"))
    parents = said.groupBy("target").agg(F.array_sort(F.collect_set("index")).alias("parents"))
    pages = best.join(parents, "target").select(F.lit(term).alias("subj"), "target", "rel", "parents")
    have = usable.select("index", "term").distinct().join(terms.select("term"), "term", "left_semi").groupBy("index").agg(F.count("*").alias("done"))
    total = terms.count()
    state = indexes.join(have, "index", "left").select("index", "trust", "hops", F.coalesce("done", F.lit(0)).cast("bigint").alias("done"), (F.lit(total) - F.coalesce("done", F.lit(0))).cast("bigint").alias("pending"))
    return pages, state, terms.withColumnRenamed("weight", "rel")
