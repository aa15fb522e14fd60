"""Indexes on disk: sorted Parquet, cut into shards by the md5 of the term, with editions, a registry and type detection."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from hashlib import md5

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import shard_key
from ..schema import FORMAT_VERSION, META, POSTINGS, REGISTRY, URIS
from ..staging import release

SHARD_DIGITS = 1
#: Bytes of files that one pass of a merge reads, unless that takes more passes than there are shards.
PASS = 32 << 20
#: Entries of one term that a merge leaves together; those of larger terms are dealt by their targets too.
HOT = 1_000_000
#: Columns that are not published.
PRIVATE = ["insert_key"]


class IndexFormatError(ValueError):
    pass


def route(term: str, shard_keys: list[str]) -> str:
    """The greatest shard key not above the md5 of the term."""
    keys = sorted(shard_keys)
    at = bisect_right(keys, md5(term.encode()).hexdigest())
    if not at:
        raise LookupError(f"no shard for {term}")
    return keys[at - 1]


def route_column(df: DataFrame, shard_keys: list[str], term: str = "term") -> DataFrame:
    """shard: the same for a column, from a short list of keys."""
    h = F.md5(F.col(term))
    return df.withColumn("shard", F.array_max(F.filter(F.array(*[F.lit(k) for k in shard_keys]), lambda k: k <= h)))


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if it is not there."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []


def delete_path(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def size_of(spark: SparkSession, path: str) -> int:
    """Bytes of all files below a path; 0 if it is not there."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.getContentSummary(p).getLength() if fs.exists(p) else 0


@contextmanager
def shard_writers(spark: SparkSession) -> Iterator[None]:
    """Meanwhile a task writes the files of all shards at once, so its rows need not be sorted by shard."""
    name = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(name, "0")
    spark.conf.set(name, str(max(int(before), 16**SHARD_DIGITS + 1)))
    try:
        yield
    finally:
        spark.conf.set(name, before)


@dataclass
class StoredIndex:
    spark: SparkSession
    path: str

    # an edition is there when its row of metadata is, which is written last
    def editions(self) -> list[int]:
        found = [int(m[1]) for c in children(self.spark, f"{self.path}/meta") if (m := re.fullmatch(r"edition=(\d+)", c))]
        return sorted(e for e in found if _exists(self.spark, f"{self.path}/meta/edition={e}/_SUCCESS"))

    def latest(self) -> int:
        """-1 when nothing is published."""
        return max(self.editions(), default=-1)

    def write(self, postings: DataFrame, meta: dict | None = None, uris: DataFrame | None = None, files: int | None = None) -> int:
        """A new edition; what a failed write of the same number left is overwritten.

        Rows are dealt by parts of a shard that the md5 of their term picks, and adaptive execution joins small parts and cuts those that a
        frequent term makes large: their number follows the size, and the plan below is run once, as nothing has to be
        sampled for borders.  Files are sorted, so that row groups of other terms are skipped, and have Bloom filters of
        their terms, so that files of other terms are.
        """
        edition = self.latest() + 1
        rows = postings.drop(*PRIVATE).withColumn("shard", shard_key(F.col("term"), SHARD_DIGITS))
        part = F.substring(F.md5("term"), SHARD_DIGITS + 1, 2)
        dealt = rows.withColumn("_part", part).hint("rebalance", *([files] if files else []), "shard", "_part").drop("_part")
        sorted_ = dealt.sortWithinPartitions("shard", "term", F.desc("rel"), "entry_type", "target")
        self._files(sorted_, edition, "overwrite")
        return self._publish(edition, meta, uris)

    def write_merged(self, new: DataFrame, size: int, largest: int = 0, meta: dict | None = None, uris: DataFrame | None = None) -> int:
        """A new edition: the newest one and new (with a column shard, by which its files are pruned), each identity once, the old row first.

        size: bytes of the files of new; largest: entries of its largest term, at most.  The shards are merged in several passes, so that
        the shuffled rows, which take several times the space of files, are those of a part of the shards; what a pass has shuffled is
        dropped before the next.  A pass is one shuffle and one sort: identities meet where their rows are sorted for the file.
        """
        latest = self.latest()
        edition = latest + 1
        delete_path(self.spark, f"{self.path}/postings/edition={edition}")
        both = new.withColumn("_new", F.lit(1))
        if latest >= 0:
            path = f"{self.path}/postings/edition={latest}"
            size += size_of(self.spark, path)
            kept = self.postings(latest)
            if children(self.spark, path):
                # shards that are all digits would be read as numbers
                kept = self.spark.read.schema(T.StructType([T.StructField("shard", T.StringType()) if f.name == "shard" else f for f in kept.schema.fields])).parquet(path)
            both = kept.withColumn("_new", F.lit(0)).unionByName(both, allowMissingColumns=True)
            held = (self.meta(latest).get("extra") or {}).get("largest")
            largest += int(held) if held else kept.groupBy("term").count().agg(F.max("count")).first()[0] or 0
        shards = [f"{k:0{SHARD_DIGITS}x}" for k in range(16**SHARD_DIGITS)]
        passes = max(1, min(len(shards), -(-size // PASS)))
        keys = ["term", "_down", "entry_type", "target"]
        dealt = ["shard", "_part", "_cut"]
        for k in range(passes):
            mine = F.col("shard").isin(shards[k::passes])
            rows = both.where(mine if k else mine | F.col("shard").isNull()).drop(*PRIVATE).withColumn("_down", -F.col("rel"))
            rows = rows.withColumn("_part", F.pmod(F.xxhash64("term"), F.lit(256))).withColumn("_cut", F.pmod(F.xxhash64("target"), F.lit(1 + largest // HOT)))
            before = F.lag(F.lit(1)).over(Window.partitionBy(*keys, *dealt).orderBy("_new"))
            once = rows.repartition(*dealt).withColumn("_again", before).where("_again IS NULL").drop("_again", "_new", "_down", "_part", "_cut")
            with shard_writers(self.spark):
                self._files(once, edition, "append")
            del rows, once
            release(self.spark)
        meta = meta or {}
        return self._publish(edition, meta | {"extra": (meta.get("extra") or {}) | {"largest": str(largest)}}, uris)

    def _files(self, rows: DataFrame, edition: int, mode: str) -> None:
        writer = rows.write.mode(mode).option("compression", "zstd").option("parquet.bloom.filter.enabled#term", "true").option("parquet.bloom.filter.expected.ndv#term", "100000")
        writer.partitionBy("shard").parquet(f"{self.path}/postings/edition={edition}")

    def _publish(self, edition: int, meta: dict | None, uris: DataFrame | None) -> int:
        """The rest of an edition, its row of metadata last."""
        if uris is not None:
            uris.select(*URIS.fieldNames()).repartitionByRange("uri_key", "uri").sortWithinPartitions("uri_key", "uri").write.mode("overwrite").parquet(f"{self.path}/uris/edition={edition}")
        else:
            delete_path(self.spark, f"{self.path}/uris/edition={edition}")
        meta = meta or {}
        from datetime import datetime

        row = (meta.get("name"), meta.get("owner"), meta.get("owner_email"), int(meta.get("total_pages", -1)), meta.get("modified") or datetime.now(), FORMAT_VERSION, meta.get("extra") or {})
        self.spark.createDataFrame([row], META).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/meta/edition={edition}")
        return edition

    def meta(self, edition: int | None = None) -> dict:
        edition = self.latest() if edition is None else edition
        if edition < 0:
            raise IndexFormatError(f"no index at {self.path}")
        row = self.spark.read.parquet(f"{self.path}/meta/edition={edition}").first().asDict()
        if row["format_version"] != FORMAT_VERSION:
            raise IndexFormatError(f"format {row['format_version']}, not {FORMAT_VERSION}")
        return row

    def postings(self, edition: int | None = None) -> DataFrame:
        edition = self.latest() if edition is None else edition
        if edition < 0:
            raise IndexFormatError(f"no index at {self.path}")
        path = f"{self.path}/postings/edition={edition}"
        if not any(c.startswith("shard=") for c in children(self.spark, path)):  # an edition without rows has no files
            return self.spark.createDataFrame([], POSTINGS).withColumn("shard", F.lit(""))
        return self.spark.read.parquet(path)

    def lookup(self, *terms: str, edition: int | None = None) -> DataFrame:
        """Entries of terms.  Shards are computed here, so that the filter on them is literal and prunes directories."""
        shards = sorted({md5(t.encode()).hexdigest()[:SHARD_DIGITS] for t in terms})
        return self.postings(edition).where(F.col("shard").isin(shards) & F.col("term").isin(list(terms))).drop("shard")

    def lookup_all(self, terms: DataFrame) -> DataFrame:
        """Entries of a table of terms: one pass for all requests."""
        wanted = terms.select("term").distinct().withColumn("shard", shard_key(F.col("term"), SHARD_DIGITS))
        return self.postings().join(wanted, ["shard", "term"], "left_semi").drop("shard")

    def keys(self) -> DataFrame:
        """All terms in order; the scan reads the one column."""
        return self.postings().select("term").distinct().orderBy("term")

    def uris(self) -> DataFrame:
        """The table of addresses of the newest edition; empty where none was written."""
        path = f"{self.path}/uris/edition={self.latest()}"
        return self.spark.read.schema(URIS).parquet(path) if _exists(self.spark, path) else self.spark.createDataFrame([], URIS)

    def uri(self, uri: str) -> DataFrame:
        """What is known of one address: at most one row, and only the row groups of its site are read."""
        return self.uris().where((F.col("uri_key") == uri_key_py(uri)) & (F.col("uri") == uri))

    def put(self, new: DataFrame, **options) -> int:
        """A new edition with those entries too."""
        from ..operators.merge import merge_metadata, upsert

        if self.latest() < 0:
            return self.write(new, options.get("meta"))
        old = self.postings().drop("shard")
        meta = merge_metadata(self.meta(), options["meta"]) if options.get("meta") else self.meta()
        return self.write(upsert(old, new, options.get("latest_wins", False)), meta, self._kept_uris())

    def remove(self, gone: DataFrame) -> int:
        """A new edition without those entries, by term, entry type and target."""
        from ..operators.merge import delete

        return self.write(delete(self.postings().drop("shard"), gone), self.meta(), self._kept_uris())

    def forget(self, keep: int = 1) -> None:
        """Delete all editions but the newest ones."""
        for e in self.editions()[:-keep]:
            for kind in ("meta", "postings", "uris"):
                delete_path(self.spark, f"{self.path}/{kind}/edition={e}")

    def _kept_uris(self) -> DataFrame | None:
        return self.uris() if _exists(self.spark, f"{self.path}/uris/edition={self.latest()}") else None

    def put_uris(self, new: DataFrame) -> int:
        """A new edition with those addresses; of an address that is there already the new row stays."""
        rest = [c for c in URIS.fieldNames() if c not in ("uri_key", "uri")]
        both = self.uris().withColumn("_new", F.lit(0)).unionByName(with_uri_key(new).withColumn("_new", F.lit(1)), allowMissingColumns=True)
        merged = both.groupBy("uri_key", "uri").agg(F.max_by(F.struct(*rest), "_new").alias("row")).select("uri_key", "uri", "row.*")
        return self.write(self.postings().drop("shard"), self.meta(), merged)

    def remove_uris(self, gone: DataFrame) -> int:
        return self.write(self.postings().drop("shard"), self.meta(), self.uris().join(gone.select("uri").distinct(), "uri", "left_anti"))


_SITE = r"^(\w+:/*[^/]+).*$"


def with_uri_key(rows: DataFrame) -> DataFrame:
    """uri_key: the digest of the site, and the other columns of the table where they are missing."""
    out = rows.withColumn("uri_key", F.sha2(F.regexp_replace("uri", _SITE, "$1"), 256))
    return out.select(*[(F.col(f.name) if f.name in out.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in URIS.fields])


def uri_key_py(uri: str) -> str:
    """Addresses of one site share the beginning of their key."""
    from hashlib import sha256

    site = re.sub(_SITE, r"\1", uri)
    return sha256(site.encode()).hexdigest()


def index_type(name: str, spark: SparkSession | None = None) -> str:
    """parquet, xml, yaml or view, from a MIME type, a file name or a path, and with a session from what a folder holds."""
    low = name.lower()
    if low.startswith("view:"):
        return "view"
    if low in ("application/xml", "text/xml") or low.endswith(("index.xml", ".xml")):
        return "xml"
    if low in ("application/yaml", "text/yaml", "text/x-yaml") or low.endswith((".yml", ".yaml")):
        return "yaml"
    if spark:
        inside = [c.lower() for c in children(spark, name)]
        if "index.xml" in inside:
            return "xml"
        if "meta" not in inside and any(c.endswith((".yml", ".yaml")) for c in inside):
            return "yaml"
    return "parquet"


@dataclass
class VirtualIndex:
    """An index that is a view of the session, whatever stands behind it."""

    spark: SparkSession
    name: str

    @staticmethod
    def create(postings: DataFrame, name: str) -> VirtualIndex:
        postings.createOrReplaceTempView(name)
        return VirtualIndex(postings.sparkSession, name)

    def postings(self) -> DataFrame:
        return self.spark.table(self.name)

    def lookup(self, *terms: str) -> DataFrame:
        return self.postings().where(F.col("term").isin(list(terms)))


@dataclass
class Registry:
    """alias -> location, kept as a table; `bookmark:name` resolves through it."""

    spark: SparkSession
    path: str

    def table(self) -> DataFrame:
        latest = self._latest()
        if latest < 0:
            return self.spark.createDataFrame([], REGISTRY)
        return self.spark.read.schema(REGISTRY).parquet(f"{self.path}/v={latest}")

    def _latest(self) -> int:
        return max((int(m[1]) for c in children(self.spark, self.path) if (m := re.fullmatch(r"v=(\d+)", c)) and _exists(self.spark, f"{self.path}/{m[0]}/_SUCCESS")), default=-1)

    def _save(self, rows: list[tuple]) -> None:
        self.spark.createDataFrame(rows, REGISTRY).coalesce(1).write.parquet(f"{self.path}/v={self._latest() + 1}")

    def add(self, alias: str, location: str, edition: int = -1) -> None:
        rows = {r["alias"]: tuple(r) for r in self.table().collect()}
        self._save(list((rows | {alias: (alias, location, edition)}).values()))

    def remove(self, alias: str) -> None:
        self._save([tuple(r) for r in self.table().where(F.col("alias") != alias).collect()])

    def names(self) -> list[str]:
        return sorted(r[0] for r in self.table().select("alias").collect())

    def resolve(self, address: str) -> str:
        if address.startswith("bookmark:"):
            row = self.table().where(F.col("alias") == address.removeprefix("bookmark:")).first()
            if row is None:
                raise LookupError(address)
            return row["location"]
        return address

    def resolve_all(self, addresses: str) -> list[str]:
        return [self.resolve(a) for a in re.split(r"[ ;]", addresses) if a]


def open_index(spark: SparkSession, address: str, registry: Registry | None = None):
    """A StoredIndex, XmlIndex or VirtualIndex, or the postings of a YAML index."""
    location = registry.resolve(address) if registry else address
    kind = index_type(location, spark)
    if kind == "view":
        return VirtualIndex(spark, location.partition(":")[2])
    if not _exists(spark, location):
        raise FileNotFoundError(location)
    if kind == "xml":
        from .xml_index import XmlIndex

        folder = location.rsplit("/", 1)[0] if location.lower().endswith(".xml") else location
        return XmlIndex(spark, folder, _exists(spark, f"{folder}/words"))
    if kind == "yaml":
        from .codecs import read_yaml

        return read_yaml(spark, location)
    return StoredIndex(spark, location)
