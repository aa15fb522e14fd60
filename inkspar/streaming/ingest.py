"""Continuous ingest: posting files or push buffers -> small index -> published index.

The files of the source folder are the durable log.  Each micro-batch is merged as a delta under its own name, so a batch
that is run again after a failure replaces itself; deltas are merged into a new edition when the flush policy says so.  Beside each
delta stands one row about it (its terms as a sketch, its largest term, its header), so the policy never reads the deltas again.
An edition records which deltas it holds: what a failure leaves behind is not merged twice.

A compaction rewrites the whole index.  So that a long backlog is not rewritten for each batch, the limits on terms and entries
count once the deltas hold as many rows as the index; those on updates and hours always do.  The edition before the newest one stays for
those who read it, until the next compaction.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime
from hashlib import md5

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import shard_key
from ..operators.merge import FlushPolicy, merge_metadata, upsert
from ..schema import IDENTITY, POSTINGS, struct
from ..sources import codecs
from ..sources.store import SHARD_DIGITS, StoredIndex, _exists, children, delete_path, shard_writers, size_of
from ..staging import shared_folder

DELTA = T.StructType([*POSTINGS.fields, T.StructField("shard", T.StringType())])
ABOUT = struct(number="bigint", terms=T.BinaryType(), largest="bigint", name="string", owner="string", owner_email="string", total_pages="bigint")
#: tells: whether the header counts, as it does where the column is missing.
BUFFERS = struct(data=T.BinaryType(), tells=T.BooleanType())
#: Size of the sketches of terms; their count is right to about 1 %.
SKETCH = 13


class Broken(RuntimeError):
    """The ingest stopped at an error and takes nothing in until `repair`."""


@dataclass
class Ingest:
    spark: SparkSession
    index_path: str
    policy: FlushPolicy = field(default_factory=FlushPolicy)
    #: Called with ("merged", name of the delta), ("published", edition) or ("broken", error).
    on_event: Callable[[str, object], None] | None = None
    broken: Exception | None = None

    @property
    def deltas(self) -> str:
        return f"{self.index_path}/deltas"

    @property
    def about(self) -> str:
        return f"{self.index_path}/about"

    @property
    def index(self) -> StoredIndex:
        return StoredIndex(self.spark, self.index_path)

    def _tell(self, what: str, of: object) -> None:
        if self.on_event:
            self.on_event(what, of)

    def merge_batch(self, batch: DataFrame, batch_id: int, log: str = "", header: dict | None = None) -> str:
        """One delta for each log and batch id: idempotent.  What a batch holds twice is there twice until it is merged into an edition."""
        name = f"{md5(log.encode()).hexdigest()[:8]}-{batch_id}" if log else str(batch_id)
        # in the shards of the index, so that a compaction can take some of them at a time
        rows = batch.withColumn("shard", shard_key(F.col("term"), SHARD_DIGITS))
        with shard_writers(batch.sparkSession):
            rows.write.mode("overwrite").option("compression", "zstd").partitionBy("shard").parquet(f"{self.deltas}/batch={name}")
        delta = self.spark.read.schema(POSTINGS).parquet(f"{self.deltas}/batch={name}")
        sizes = delta.groupBy("term").agg(F.count("*").alias("n"))
        header = header or {}
        row = sizes.agg(F.hll_sketch_agg("term", F.lit(SKETCH)).alias("terms"), F.max("n").alias("largest")).select(
            F.lit(batch_id).cast("bigint").alias("number"), F.coalesce("terms", F.lit(b"")).alias("terms"), F.coalesce("largest", F.lit(0)).cast("bigint").alias("largest"),
            *[F.lit(header.get(k)).cast("string").alias(k) for k in ("name", "owner", "owner_email")], F.lit(header.get("total_pages")).cast("bigint").alias("total_pages"),
        )
        row.coalesce(1).write.mode("overwrite").parquet(f"{self.about}/batch={name}")
        self._tell("merged", name)
        return name

    def pending_names(self) -> list[str]:
        """Whole deltas that the newest edition does not hold yet."""
        held = set((self.index.meta().get("extra") or {}).get("merged", "").split(",")) if self.index.latest() >= 0 else set()
        there = [c.removeprefix("batch=") for c in children(self.spark, self.about) if _exists(self.spark, f"{self.about}/{c}/_SUCCESS")]
        return sorted(set(there) - held)

    def _read(self, names: list[str]) -> DataFrame:
        rows = self.spark.createDataFrame([], DELTA)
        cut = {n for n in names if any(c.startswith("shard=") for c in children(self.spark, f"{self.deltas}/batch={n}"))}
        if cut:
            rows = self.spark.read.schema(DELTA).option("basePath", self.deltas).parquet(*[f"{self.deltas}/batch={n}" for n in names if n in cut]).drop("batch")
        if set(names) - cut:  # without rows, or of an earlier version
            plain = self.spark.read.schema(POSTINGS).parquet(*[f"{self.deltas}/batch={n}" for n in names if n not in cut])
            rows = rows.unionByName(plain.withColumn("shard", shard_key(F.col("term"), SHARD_DIGITS)))
        return rows

    def pending(self) -> DataFrame:
        return self._read(self.pending_names()).drop("shard")

    def _facts(self, names: list[str]) -> list[Row]:
        """The rows about deltas, in the order of their batches: as many as there are deltas since the last edition, which the policy bounds."""
        return self.spark.read.schema(ABOUT).parquet(*[f"{self.about}/batch={n}" for n in names]).orderBy("number").collect() if names else []

    def snapshot(self) -> DataFrame:
        """What a search sees: the published edition together with all deltas."""
        names = self.pending_names()
        new = self._read(names).drop("shard")
        if self.index.latest() < 0:
            return new.dropDuplicates(IDENTITY)
        if not names and "largest" in (self.index.meta().get("extra") or {}):  # of a compaction: each identity is there once
            return self.index.postings().drop("shard")
        return upsert(self.index.postings().drop("shard"), new)

    def due(self, last: str | None = None) -> bool:
        names = self.pending_names()
        if not names:
            return False
        if self.policy.due(0, len(names), 0, self.hours_since()):
            return True
        if self.index.latest() >= 0 and self._read(names).count() < self.index.postings().count():  # both from the footers of files
            return False
        about = self.spark.read.schema(ABOUT).parquet(*[f"{self.about}/batch={n}" for n in names])
        terms = about.where(F.length("terms") > 0).agg(F.hll_sketch_estimate(F.hll_union_agg("terms")).alias("n")).first()["n"] or 0
        largest = self._facts([last])[0]["largest"] if last in names else max(r["largest"] for r in self._facts(names))
        return self.policy.due(terms, len(names), largest, self.hours_since())

    def _size(self, names: list[str]) -> int:
        return sum(size_of(self.spark, f"{self.deltas}/batch={n}") for n in names)

    def hours_since(self, now: datetime | None = None) -> float:
        """Since the newest edition; 0 before the first one."""
        if self.index.latest() < 0:
            return 0.0
        return max(0.0, ((now or datetime.now()) - self.index.meta()["modified"]).total_seconds() / 3600)

    def compact(self) -> int:
        """Publish a new edition with the metadata of all its deltas.  Deltas stay until the edition is complete."""
        names = self.pending_names()
        meta = self.index.meta() if self.index.latest() >= 0 else {"total_pages": -1}
        facts = self._facts(names)
        for r in facts:
            meta = merge_metadata(meta, {k: r[k] for k in ("name", "owner", "owner_email", "total_pages")})
        extra = dict(meta.get("extra") or {}) | {"merged": ",".join(names)}
        self.index.forget()
        edition = self.index.write_merged(self._read(names), self._size(names), sum(r["largest"] for r in facts), meta | {"extra": extra, "modified": None}, self.index._kept_uris())
        for name in names:
            delete_path(self.spark, f"{self.about}/batch={name}")
            delete_path(self.spark, f"{self.deltas}/batch={name}")
        self._tell("published", edition)
        return edition

    def repair(self) -> None:
        self.broken = None

    def start(self, source: str, checkpoint: str, available_now: bool = False, interval: str = "10 seconds", max_files: int = 5, buffers: bool = False, clean: bool = False) -> StreamingQuery:
        """Posting files, or with buffers tables with a column `data` of push buffers.  With clean, Spark deletes the files of
        batches that are committed, and so are whole deltas or in an edition: only for a folder that nothing else reads.

        maxFilesPerTrigger holds the producer's backlog off the engine; a failed query starts again from its checkpoint, once
        `repair` has been called on an ingest that broke.
        """
        if self.broken:
            raise Broken(str(self.broken)) from self.broken
        reader = self.spark.readStream.schema(BUFFERS if buffers else POSTINGS).option("maxFilesPerTrigger", max_files).option("cleanSource", "delete" if clean else "off")
        stream = reader.parquet(source)

        def each(batch: DataFrame, batch_id: int) -> None:
            try:
                header = None
                if buffers:
                    header = batch_header(codecs.buffer_headers(batch.where(F.coalesce("tells", F.lit(True)))))
                    batch = from_entries(codecs.decode_buffers(batch))
                name = self.merge_batch(batch, batch_id, checkpoint, header)
                if self.due(name):
                    self.compact()
            except Exception as e:
                self.broken = e
                self._tell("broken", e)
                raise

        writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)).start()


def batch_header(headers: DataFrame) -> dict:
    """One header for the buffers of a batch: the greatest of names, and the sum of the pages that they tell."""
    known = F.col("total_pages") >= 0
    return headers.agg(F.max("name").alias("name"), F.max("owner").alias("owner"), F.max("owner_email").alias("owner_email"), F.sum(F.when(known, F.col("total_pages"))).alias("total_pages")).first().asDict()


def from_entries(entries: DataFrame) -> DataFrame:
    """Entries of a codec as postings."""
    have = {"tf": F.size("positions"), "entry_type": F.col("entry_type").cast("tinyint"), "site": F.lit(None).cast("string"), "edition": F.lit(None).cast("bigint")}
    return entries.select(*[have.get(f.name, F.col(f.name)).cast(f.dataType).alias(f.name) for f in POSTINGS.fields])


def push(buffers: DataFrame, source: str) -> None:
    """Hand push buffers (data) to the ingest that reads this folder: they are durable when this returns.

    All buffers that one call of `encode_buffers` made (column made) have the same header, and rows decide how many there are: one of them
    tells it, so that its pages add up once for each push.  A buffer of unknown make tells its own.
    """
    if "made" not in buffers.columns:
        buffers.select("data", F.lit(True).alias("tells")).write.mode("append").parquet(source)
        return
    spark = buffers.sparkSession
    path = shared_folder(spark, "push")
    buffers.select("data", "made", F.monotonically_increasing_id().alias("k")).write.parquet(path)
    kept = spark.read.parquet(path)
    first = kept.groupBy("made").agg(F.min("k").alias("first"))
    told = kept.join(F.broadcast(first), "made", "left").select("data", F.coalesce(F.col("k") == F.col("first"), F.lit(True)).alias("tells"))
    told.write.mode("append").parquet(source)
    delete_path(spark, path)
