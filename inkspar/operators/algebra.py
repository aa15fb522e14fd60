"""Set algebra over result sets.

A result set has the columns subj, entry_type, target, rel, title, positions (and may have site, edition).  Operators work on target
identity, (entry_type, target); only the observed union also looks at rel.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import PAGE, TARGET

RESULT = ["subj", "entry_type", "target", "rel", "title", "positions"]


def from_postings(postings: DataFrame) -> DataFrame:
    return postings.select(F.col("term").alias("subj"), "entry_type", "target", "rel", "title", "positions")


def resubject(df: DataFrame, subj: str, rel: Column | None = None) -> DataFrame:
    out = df.withColumn("subj", F.lit(subj))
    return out if rel is None else out.withColumn("rel", rel)


single = resubject


def _tagged(dfs: tuple[DataFrame, ...]) -> DataFrame:
    parts = [d.select(*RESULT, F.lit(k).alias("input")) for k, d in enumerate(dfs)]
    return reduce(DataFrame.unionByName, parts)


def intersect(*dfs: DataFrame, subj: str = "and") -> DataFrame:
    """Targets of all inputs; rel is the mean over all inputs, title and positions come from the first.

    One aggregation for any number of inputs.  Where an input has a target twice, its largest rel counts.
    """
    if len(dfs) < 2:
        raise ValueError("an intersection needs two inputs or more")
    # first to one row for each input and target, then over the inputs; both on the target, so one exchange serves both
    best = _tagged(dfs).groupBy(*TARGET, "input").agg(F.max_by(F.struct("rel", "title", "positions"), "rel").alias("e"))
    joined = best.groupBy(*TARGET).agg(F.count("*").alias("n"), F.sum("e.rel").alias("total"), F.max(F.when(F.col("input") == 0, F.col("e"))).alias("first"))
    return joined.where(F.col("n") == len(dfs)).select(
        F.lit(subj).alias("subj"), *TARGET, (F.col("total") / len(dfs)).alias("rel"), F.col("first.title").alias("title"), F.col("first.positions").alias("positions")
    )


def merged_rel(a: Column, b: Column) -> Column:
    """Average of two relevances in which 0 means unknown."""
    return a / F.when(b == 0, 1).otherwise(2) + b / F.when(a == 0, 1).otherwise(2)


def union(*dfs: DataFrame, subj: str = "or", mode: str = "merge") -> DataFrame:
    """merge: one row for each target, relevances averaged in the order of the inputs, positions united, the first
    title that is not null.  observed: a target with two relevances stays twice, nothing is merged."""
    if len(dfs) < 2:
        raise ValueError("a union needs two inputs or more")
    rows = _tagged(dfs)
    if mode == "observed":
        first = rows.groupBy(*TARGET, "rel").agg(F.min_by(F.struct("title", "positions"), "input").alias("e"))
        return first.select(F.lit(subj).alias("subj"), *TARGET, "rel", "e.title", "e.positions")
    if mode != "merge":
        raise ValueError(f"no such mode: {mode}")
    best = rows.groupBy(*TARGET, "input").agg(F.max_by(F.struct("rel", "title", "positions"), "rel").alias("e"))
    # at most one row for each input here
    grouped = best.groupBy(*TARGET).agg(F.array_sort(F.collect_list(F.struct("input", F.col("e.rel").alias("rel"), F.col("e.title").alias("title"), F.col("e.positions").alias("positions")))).alias("es"))
    rel = F.aggregate(F.slice("es", 2, len(dfs)), F.element_at("es", 1)["rel"], lambda acc, e: merged_rel(acc, e["rel"]))
    title = F.get(F.filter(F.transform("es", lambda e: e["title"]), lambda t: t.isNotNull()), F.lit(0))
    known = F.filter(F.transform("es", lambda e: e["positions"]), lambda p: p.isNotNull())
    positions = F.when(F.size(known) > 0, F.array_sort(F.array_distinct(F.flatten(known))))
    return grouped.select(F.lit(subj).alias("subj"), *TARGET, rel.alias("rel"), title.alias("title"), positions.alias("positions"))


def exclude(df: DataFrame, minus: DataFrame) -> DataFrame:
    """Rows of df whose target is not in minus; the subject stays that of df."""
    return df.join(minus.select(*TARGET).distinct(), TARGET, "left_anti").select(*df.columns)


def semi(df: DataFrame, other: DataFrame) -> DataFrame:
    return df.join(other.select(*TARGET).distinct(), TARGET, "left_semi").select(*df.columns)


def phrase(words: list[tuple[DataFrame, int]], subj: str = "phrase") -> DataFrame:
    """Pages with the words at those offsets; positions are where the phrase begins, rel and title those of the first word.

    Every position votes for the place where the phrase would begin, and a begin with a vote of each word stands: one
    exchange on (target, begin) for a phrase of any length.
    """
    if not 0 < len(words) < 63:
        raise ValueError("a phrase has 1 to 62 words")
    base = words[0][1]
    votes = [
        d.where((F.col("entry_type") == PAGE) & F.col("positions").isNotNull())
        .select("target", F.explode("positions").alias("p"), F.lit(1 << k).cast("bigint").alias("bit"), F.when(F.lit(k == 0), F.col("rel")).alias("rel"), F.when(F.lit(k == 0), F.col("title")).alias("title"))
        .withColumn("begin", F.col("p") - (offset - base))
        for k, (d, offset) in enumerate(words)
    ]
    all_ = reduce(DataFrame.unionByName, votes)
    full = sum(1 << k for k in range(len(words)))
    begins = all_.groupBy("target", "begin").agg(F.bit_or("bit").alias("seen"), F.max("rel").alias("rel"), F.max("title").alias("title"))
    hit = begins.where(F.col("seen") == full)
    return hit.groupBy("target").agg(F.max("rel").alias("rel"), F.max("title").alias("title"), F.array_sort(F.collect_list("begin")).alias("positions")).select(
        F.lit(subj).alias("subj"), F.lit(PAGE).cast("tinyint").alias("entry_type"), "target", "rel", "title", "positions"
    )


def multi_index(dfs: list[DataFrame], subj: str = "multi", mode: str = "merge") -> DataFrame:
    """The union over several indexes; a single survivor is returned as it is."""
    if not dfs:
        raise ValueError("no index is left")
    return resubject(dfs[0], subj) if len(dfs) == 1 else union(*dfs, subj=subj, mode=mode)
