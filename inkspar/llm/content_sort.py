"""Exact dedup by a content sort.

Sampled splitters range-partition the normalised texts, each partition is sorted externally, and neighbours are
compared in full.  The place of a row is (first bytes, digest, doc_id) in 56 bytes that sort as these do, so the driver's sample of
places is small however long texts are, and because the id is part of it a group of copies that holds a third of all
rows is cut into many partitions instead of filling one.  Only the sampled rows are normalised for the splitters, all rows once
for the sort.  Splitters share out the sample's bytes, and there are as many partitions as the estimated bytes ask for.  Runs of equal texts that touch the edge of a partition are put
together from one summary row each (two per partition at most).

Defined results: null text counts as empty; the empty text is a text like any other, so all empty rows form one group;
a null doc_id sorts last and stays only if its whole group has null ids; of rows with the same text and the same
doc_id exactly one stays; an empty table gives an empty result; other columns are carried or ignored, never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_texts, stage, table

#: White space that is folded: space and the characters 9 to 13.
RUN = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"
#: Bytes of the text in the place; the digest separates texts with a longer common beginning.
KEY_BYTES = 16
#: Bytes of a place: of the text, of the digest and of the id.
PLACE_BYTES = KEY_BYTES + 32 + 8
#: Texts of a partition, about; more partitions than the session's setting are made where it asks for larger ones.
PART_BYTES = 512 << 20
#: Sampled rows: for each partition, or one for so many rows, whichever is more; and the most that the driver takes.
PART_SAMPLES, SAMPLED_OF, MOST_SAMPLES = 100, 5000, 1_000_000
#: What a row weighs beside its text.
ROW_BYTES = 100


def normalise(text: Column) -> Column:
    """One space for each run of white space.  Single spaces are left alone instead of being replaced by themselves."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), RUN, " ")


def _runs(keep_row: bool, heads_only: bool):
    """Scan a sorted partition: equal neighbours form runs.  Only digests, ids and flags are held for an open run."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 36
        row = 0
        last = None  # text of the row before
        held: list[tuple[pa.RecordBatch, int]] = []  # rows of the open run, with the index of the first
        head = (None, None)
        size = 0
        first_run = True

        def out(parts, size, edge):
            for part, at in parts:
                n = part.num_rows
                cols = {"doc_id": part.column("doc_id"), "sha": part.column("sha")}
                cols["ord"] = pa.array(range(base + at, base + at + n), pa.int64())
                cols["head_ord"] = pa.array([head[0]] * n, pa.int64())
                cols["head_id"] = pa.array([head[1]] * n, pa.int64())
                cols["run_size"] = pa.array([size] * n, pa.int64())
                cols["edge"] = pa.array([edge] * n, pa.bool_())
                if keep_row:
                    cols["doc"] = part.column("doc")
                yield pa.RecordBatch.from_pydict(cols)

        def slim(batch):
            if not heads_only:
                return batch
            return batch.slice(0, 1)

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            text = batch.column("norm")
            starts = []
            if last is None or text[0].as_py() != last:
                starts.append(0)
            if n > 1:
                differs = pc.not_equal(text.slice(1), text.slice(0, n - 1))
                starts += [i + 1 for i in pc.indices_nonzero(differs).to_pylist()]
            bare = batch.drop_columns(["norm"])
            bounds = [*starts, n]
            if not starts or starts[0] > 0:  # the open run goes on
                stop = bounds[0]
                size += stop
                if not heads_only:
                    held.append((bare.slice(0, stop), row))
            for start, stop in zip(starts, bounds[1:], strict=True):
                if held:
                    yield from out(held, size, first_run)
                    first_run = False
                head = (base + row + start, bare.column("doc_id")[start].as_py())
                held = [(slim(bare.slice(start, stop - start)), row + start)]
                size = stop - start
            last = text[n - 1].as_py()
            row += n
        if held:
            yield from out(held, size, True)

    return scan


def _placed(docs: DataFrame, text_col: str, id_col: str, keep_row: bool) -> DataFrame:
    """doc_id, norm, place (and doc): places compare as (first bytes, digest, id), null ids last."""
    cols = [F.col(f"`{id_col}`").cast("long").alias("doc_id"), normalise(F.col(f"`{text_col}`")).alias("norm")]
    if keep_row:
        cols.append(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    raw = F.encode("norm", "utf-8")
    # with the sign bit turned over, eight bytes sort as the numbers do
    number = F.coalesce("doc_id", F.lit((1 << 63) - 1)).bitwiseXOR(F.lit(-(1 << 63)))
    place = F.concat(F.rpad(F.substring(raw, 1, KEY_BYTES), KEY_BYTES, F.lit(b"\0")), F.unhex(F.sha2(raw, 256)), F.unhex(F.lpad(F.hex(number), 16, "0")))
    return docs.select(*cols).withColumn("place", place)


def splitters(docs: DataFrame, text_col: str, id_col: str) -> tuple[list[bytes], int]:
    """Places between partitions, and the number of partitions, from a sample of rows that the driver can hold."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.count()
    wanted = min(MOST_SAMPLES, max(PART_SAMPLES * parts, rows // SAMPLED_OF))
    some = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    some = some.sample(wanted / rows, seed=1) if rows > wanted else some
    taken = sorted((bytes(r["place"]), r["n"]) for r in _placed(some, "text", "id", False).select("place", F.octet_length("norm").alias("n")).collect())
    ends = np.cumsum([n + ROW_BYTES for _, n in taken])
    if not len(ends):
        return [], parts
    parts = max(parts, int(ends[-1] * (rows / len(taken)) // PART_BYTES) + 1)
    at = np.searchsorted(ends, ends[-1] * np.arange(1, parts) / parts)
    return sorted({taken[k][0] for k in at}), parts


def partition_of(place: Column, cuts: list[bytes]) -> Column:
    """How many of the sorted cuts lie below place: a binary search in one literal."""
    if not cuts:
        return F.lit(0)
    packed = F.lit(b"".join(cuts))
    steps = F.array(*[F.lit(1 << e) for e in reversed(range(len(cuts).bit_length()))])

    def search(at: Column, step: Column) -> Column:
        cut = F.substring(packed, (at + step - 1) * PLACE_BYTES + 1, F.lit(PLACE_BYTES))
        return at + F.when((at + step <= len(cuts)) & (cut < place), step).otherwise(0)

    return F.aggregate(steps, F.lit(0), search)


def _sorted(docs: DataFrame, text_col: str, id_col: str, keep_row: bool) -> DataFrame:
    cuts, parts = splitters(docs, text_col, id_col)
    dealt = _placed(docs, text_col, id_col, keep_row).repartitionById(parts, partition_of(F.col("place"), cuts))
    ordered = dealt.sortWithinPartitions("place", "norm", F.col("doc_id").asc_nulls_last())
    return ordered.withColumn("sha", F.substring("place", KEY_BYTES + 1, 32)).drop("place")


def content_sort(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", keep_row: bool = False, heads_only: bool = False) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256 (and doc, its whole row, with keep_row).

    heads_only leaves out rows that another row of the same partition replaces; what is kept is the same.
    """
    ordered = _sorted(docs, text_col, id_col, keep_row)
    schema = T._parse_datatype_string("doc_id long, sha binary, ord long, head_ord long, head_id long, run_size long, edge boolean")
    if keep_row:
        schema = schema.add(ordered.schema["doc"])
    runs = stage(map_texts(ordered, _runs(keep_row, heads_only), schema))
    # at most two rows a partition, so this side has a bound that does not depend on the groups
    edges = (
        runs.where("edge and ord = head_ord")
        .groupBy("sha")
        .agg(F.min("head_ord").alias("e_ord"), F.min_by("head_id", "head_ord").alias("e_id"), F.sum("run_size").alias("e_size"))
    )
    joined = runs.join(F.broadcast(edges.withColumn("edge", F.lit(True))), ["sha", "edge"], "left")
    cols = [
        F.col("doc_id"),
        F.coalesce("e_id", "head_id").alias("keep_id"),
        F.coalesce("e_size", "run_size").alias("group_size"),
        (F.col("ord") == F.coalesce("e_ord", "head_ord")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    ]
    return joined.select(*cols, *(["doc"] if keep_row else []))


def keep_first(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows that stay, with the columns of docs."""
    return content_sort(docs, text_col, id_col, keep_row=True, heads_only=True).where("kept").select("doc.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content_sort(table(spark, sf_dir, "documents").select("doc_id", "text"))


ORACLE = """
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM n WINDOW w AS (PARTITION BY t)
"""
