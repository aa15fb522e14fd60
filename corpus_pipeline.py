"""Preparation of a training corpus: language, exact copies, near copies, personal data, packing.

Every stage works on all rows that the one before it kept, and all but the last return the columns of documents, whatever others there are
and whatever they are called.  Defined results:

- an empty table, and a table that a stage leaves empty, gives no rows;
- a null, empty or letterless text goes in the first stage, as it has no language; a null lang, source, n_chars or doc_id is no reason to drop a
  row, and null ids sort last where the smallest id stays;
- of rows with the same text, or of one group of near copies, one row stays: the one with the smallest doc_id, and of rows that also have
  that in common any one;
- n_chars follows the text where personal data were replaced;
- the result has a row for each piece of a document in a sequence, with the ids of its tokens, so it is the packed corpus itself; ids of documents
  whose texts are too long for a sequence occur in several rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from inkspar.llm import content_sort, language_id, pii, prob_minhash, vector_packing
from inkspar.llm.common import release, stage, table, vocabulary


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without texts that have no letter or score as letter junk; doubt between languages is no reason to drop a document."""
    return language_id.keep_known(docs, *language_id.fit_gate(docs, ~language_id.held_out()))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return content_sort.keep_first(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return prob_minhash.keep_one(docs)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Surrogates under the session's key (see inkspar.llm.pii)."""
    return pii.replace_texts(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return vector_packing.pack_documents(docs, vocabulary("word_bpe_49k.json"), with_ids=True)


STAGES = [
    ("language", known_language),
    ("exact dedup", without_copies),
    ("near dedup", without_near_copies),
    ("surrogates", without_personal_data),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (_, f) in enumerate(STAGES):
        docs = f(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stage(docs)
            if before is not None:
                release(before)
            before = docs
    return docs


#: A trained network takes part in the first stage.
ORACLE_SQL = None
