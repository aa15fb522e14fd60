"""Postings, frequencies and relevance from documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import PAGE, TARGET
from ..staging import spread, stage

NO_EDITION = -(1 << 63)


def build_postings(docs: DataFrame, key: str = "doc_id", text: str = "text", site: Column | None = None, edition: Column | None = None, title: Column | None = None) -> DataFrame:
    """One PAGE posting for each term of each document, rel = term frequency / number of words.

    A document's tokens never leave the task that holds the document: frequencies and positions are array functions over
    the row, so the index is built without a shuffle.
    """
    from ..functions.text import tokens

    with_tokens = spread(docs).select(
        F.col(key).cast("string").alias("target"),
        (title if title is not None else F.lit(None).cast("string")).alias("title"),
        (site if site is not None else F.lit(None).cast("string")).alias("site"),
        (edition if edition is not None else F.lit(NO_EDITION)).cast("bigint").alias("edition"),
        tokens(F.col(text)).alias("words"),
    )
    counted = with_tokens.withColumn("word_count", F.size("words")).where("word_count > 0")
    # equal words of the sorted list are neighbours: (word, position) pairs, cut where the word changes
    at = F.array_sort(F.transform("words", lambda w, k: F.struct(w.alias("w"), k.cast("int").alias("p"))))
    cut = counted.withColumn("at", at).withColumn(
        "begin", F.filter(F.sequence(F.lit(1), F.size("at")), lambda k: (k == 1) | (F.element_at("at", k)["w"] != F.element_at("at", F.greatest(k - 1, F.lit(1)))["w"]))
    )
    runs = F.transform(
        "begin",
        lambda b, k: F.struct(
            F.element_at("at", b)["w"].alias("term"),
            F.transform(F.slice("at", b, F.coalesce(F.get("begin", k + 1), F.size("at") + 1) - b), lambda x: x["p"]).alias("positions"),
        ),
    )
    flat = cut.select("target", "title", "site", "edition", "word_count", F.explode(runs).alias("r"))
    tf = F.size("r.positions")
    return flat.select(
        F.col("r.term").alias("term"), F.lit(PAGE).cast("tinyint").alias("entry_type"), "target", "title",
        (tf / F.col("word_count")).cast("double").alias("rel"), tf.alias("tf"), F.col("r.positions").alias("positions"),
        F.lit(None).cast("map<int,string>").alias("fragments"), "site", "edition", "word_count",
    )


def postings_of_terms(docs: DataFrame, terms: list[str], key: str = "doc_id", text: str = "text", site: Column | None = None, edition: Column | None = None) -> DataFrame:
    """The rows of build_postings for those terms, from documents that have no stored index.

    The terms are filtered right behind the generator, in generated code, so only their positions are aggregated and
    shuffled, not the postings of all terms.
    """
    from ..functions.text import tokens

    found = spread(docs).select(
        F.col(key).cast("string").alias("target"), (site if site is not None else F.lit(None).cast("string")).alias("site"),
        (edition if edition is not None else F.lit(NO_EDITION)).cast("bigint").alias("edition"), tokens(F.col(text)).alias("words"),
    )
    flat = found.select("target", "site", "edition", F.size("words").alias("word_count"), F.posexplode("words").alias("p", "term")).where(F.col("term").isin(list(terms)))
    rows = flat.groupBy("target", "term").agg(F.first("site").alias("site"), F.first("edition").alias("edition"), F.first("word_count").alias("word_count"), F.array_sort(F.collect_list("p")).alias("positions"))
    tf = F.size("positions")
    return rows.select(
        "term", F.lit(PAGE).cast("tinyint").alias("entry_type"), "target", F.lit(None).cast("string").alias("title"), (tf / F.col("word_count")).cast("double").alias("rel"),
        tf.alias("tf"), "positions", F.lit(None).cast("map<int,string>").alias("fragments"), "site", "edition", "word_count",
    )


def word_counts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    from ..functions.text import tokens

    return docs.select(key, F.size(tokens(F.col(text))).cast("bigint").alias("word_count"))


def doc_frequency(postings: DataFrame) -> DataFrame:
    return postings.groupBy("term").agg(F.count("*").alias("df"))


def tfidf(postings: DataFrame, total_pages: Column | int) -> DataFrame:
    """rel := tf / words x ln(pages / df).  The frequencies come from a map-side combined count joined back, not from a
    window over a term, which would put all postings of a frequent term into one task; they are written first, so that both
    sides of the join are plain exchanges (or one is small and broadcast) and adaptive execution can cut a frequent term.
    postings are read twice: a stored table, not the tokenizer."""
    total = F.lit(total_pages) if isinstance(total_pages, int) else total_pages
    joined = postings.join(stage(doc_frequency(postings)), "term")
    factor = F.when((total > 0) & (F.col("df") > 0), F.log(total / F.col("df"))).otherwise(1.0)
    rel = F.when((F.col("tf") > 0) & (F.col("word_count") > 0), F.col("tf") / F.col("word_count") * factor).otherwise(0.0)
    return joined.withColumn("rel", rel)


def idf_factor(total_pages: Column, df: Column) -> Column:
    """ln(pages / df); 1 where the number of pages is unknown or the logarithm negative."""
    value = F.log(total_pages / df)
    return F.when(total_pages <= 0, 1.0).when(value < 0, 1.0).otherwise(value)


def idf_rescale(postings: DataFrame, total_pages: int) -> DataFrame:
    """Rescale PAGE rows at query time; other entries keep their relevance.  postings are read twice, as in tfidf."""
    df = stage(doc_frequency(postings))
    joined = postings.join(df, "term")
    scaled = F.when(F.col("entry_type") == PAGE, F.col("rel") * idf_factor(F.lit(total_pages), F.col("df"))).otherwise(F.col("rel"))
    return joined.withColumn("rel", scaled).drop("df")


def group_by_term(postings: DataFrame) -> DataFrame:
    """(term, entries, first, last): each term's distinct entries as their number and ends; the entries themselves stay rows, sorted by the index."""
    one = postings.select("term", *TARGET).distinct()
    return one.groupBy("term").agg(F.count("*").alias("entries"), F.min("target").alias("first"), F.max("target").alias("last"))


def forward_index(postings: DataFrame) -> DataFrame:
    """(uri, terms): the terms of each page, sorted."""
    return postings.groupBy(F.col("target").alias("uri")).agg(F.array_sort(F.collect_set("term")).alias("terms"))
