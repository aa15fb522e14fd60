"""Merging postings into an index: upsert, delete, metadata, flush policy."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import IDENTITY


def upsert(old: DataFrame, new: DataFrame, latest_wins: bool = False) -> DataFrame:
    """Set union by identity, which includes rel; merging the same rows again changes nothing.

    latest_wins keeps one entry for each target of a term, the new one where there is one.
    """
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    keys = [k for k in IDENTITY if not (latest_wins and k == "rel")]
    rest = [c for c in both.columns if c not in keys and c != "_new"]
    # of one identity the old row stays; the aggregation combines before it shuffles
    pick = F.max_by if latest_wins else F.min_by
    chosen = both.groupBy(*keys).agg(pick(F.struct(*rest), "_new").alias("_row"))
    return chosen.select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in both.columns if c != "_new"])


def update_with(old: DataFrame, new: DataFrame, handlers: dict[str, Column], key: str = "term") -> DataFrame:
    """Merge, and what the handlers make of each key that new has: aggregates over the merged rows, where the column `fresh` marks new ones.

    Handlers are aggregate expressions, so they combine before they shuffle and a key with very many rows is no task of its own.
    """
    merged = upsert(old, new).withColumn("fresh", F.lit(False)).unionByName(new.select(*new.columns, F.lit(True).alias("fresh")), allowMissingColumns=True)
    groups = merged.groupBy(key).agg(F.max("fresh").alias("_touched"), *[c.alias(n) for n, c in handlers.items()])
    return groups.where("_touched").drop("_touched")


def delete(old: DataFrame, gone: DataFrame, keys: list[str] | None = None) -> DataFrame:
    keys = keys or ["term", "entry_type", "target"]
    return old.join(gone.select(*keys).distinct(), keys, "left_anti").select(*old.columns)


def merge_full(old: DataFrame, new: DataFrame) -> DataFrame:
    """(term, old_n, new_n, merged_n): what a merge does to each term, missing ones on either side included."""
    a = old.groupBy("term").agg(F.count("*").alias("old_n"))
    b = new.groupBy("term").agg(F.count("*").alias("new_n"))
    c = upsert(old, new).groupBy("term").agg(F.count("*").alias("merged_n"))
    zero = lambda n: F.coalesce(n, F.lit(0)).alias(n)
    return a.join(b, "term", "full_outer").join(c, "term", "full_outer").select("term", zero("old_n"), zero("new_n"), zero("merged_n"))


def merge_metadata(old: dict, new: dict, additive: bool = True) -> dict:
    """Names of the new batch replace the old ones; the number of pages adds up, an unknown old number counts as 0."""
    out = old | {k: v for k, v in new.items() if v is not None}
    if additive:
        counts = [n for n in (old.get("total_pages"), new.get("total_pages")) if n is not None and n >= 0]
        out["total_pages"] = sum(counts) if counts else -1
    return out


def metadata_of(batches: DataFrame) -> DataFrame:
    """merge_metadata over a table (batch, name, owner, owner_email, total_pages): the newest name, owner and address, and the sum of the known pages."""
    latest = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("batch"))).alias(c) for c in ("name", "owner", "owner_email")]
    return batches.agg(*latest, F.coalesce(F.sum(F.when(F.col("total_pages") >= 0, F.col("total_pages"))), F.lit(-1)).alias("total_pages"))


def distinct_pages(postings: DataFrame) -> DataFrame:
    return postings.agg(F.countDistinct("target").alias("total_pages"))


@dataclass(frozen=True)
class FlushPolicy:
    """When the small index is merged into the published one."""

    max_terms: int = 10_000
    max_updates: int = 16
    max_entries_per_term: int = 10_000
    max_hours: float = 24.0

    def due(self, terms: int, updates: int, largest_term_in_batch: int, hours_since: float) -> bool:
        return terms > self.max_terms or updates > self.max_updates or largest_term_in_batch > self.max_entries_per_term or hours_since > self.max_hours

    def measure(self, index: DataFrame, batch: DataFrame) -> tuple[int, int]:
        """Distinct terms of the index and entries of the batch's largest term: two numbers."""
        terms = index.select("term").distinct().count()
        largest = batch.groupBy("term").count().agg(F.max("count")).first()[0] or 0
        return terms, largest
