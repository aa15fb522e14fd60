"""The XML index: a root that lists shards, and shards with a keywords and a files section."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import parse_positions
from ..schema import PAGE, struct
from .store import route, route_column

WORD = struct(_v="string", _fileCount="bigint", file=T.ArrayType(struct(_id="string", _VALUE="string")))
FILE = struct(_id="string", _key="string", _title="string", _wordCount="int")
FILES = struct(_totalFileCount="bigint", file=T.ArrayType(struct(_id="string")))
ROOT = struct(header=struct(title="string", owner="string", email="string"), keywords=struct(subIndex=T.ArrayType(struct(_key="string"))))


@dataclass
class XmlIndex:
    spark: SparkSession
    path: str
    #: Are the sections of the shards folders, as write_xml makes them, or both in one file for each shard?
    folders: bool = False

    def file(self, key: str, section: str) -> str:
        """Where a section of a shard is: words, files or totals."""
        return f"{section}/shard={key}" if self.folders else f"index_{key}.xml"

    def _read(self, file: str, tag: str, schema: T.StructType) -> DataFrame:
        return self.spark.read.format("xml").option("rowTag", tag).schema(schema).load(f"{self.path}/{file}")

    def root(self) -> tuple[dict, list[str]]:
        """Header and shard keys; a key has 1 to 32 hexadecimal digits."""
        row = self._read("index.xml", "main_index", ROOT).first()
        if row is None or row["keywords"] is None:
            raise ValueError("no main_index in index.xml")
        keys = [s["_key"].lower() for s in row["keywords"]["subIndex"] or []]
        bad = [k for k in keys if not re.fullmatch("[0-9a-f]{1,32}", k)]
        if bad or not keys:
            raise ValueError(f"bad shard keys: {bad}")
        return (row["header"].asDict() if row["header"] else {}), keys

    def words(self, file: str) -> DataFrame:
        """(term, file_count, id, positions): what is not a number in the list of positions is skipped."""
        w = self._read(file, "word", WORD)
        return w.select(F.col("_v").alias("term"), F.col("_fileCount").alias("file_count"), F.explode("file").alias("f")).select("term", "file_count", F.col("f._id").alias("id"), parse_positions(F.col("f._VALUE")).alias("positions"))

    def files(self, file: str) -> DataFrame:
        """(id, page, title, word_count); of the file elements only those with a key, and title and size of those with three attributes or more."""
        f = self._read(file, "file", FILE).where("_key is not null")
        given = F.size(F.filter(F.array("_id", "_key", "_title", F.col("_wordCount").cast("string")), lambda a: a.isNotNull()))
        return f.select(F.col("_id").alias("id"), F.col("_key").alias("page"), F.when(given >= 3, F.col("_title")).alias("title"), F.when(given >= 3, F.col("_wordCount")).alias("word_count"))

    def total_files(self, file: str) -> DataFrame:
        return self._read(file, "files", FILES).agg(F.max("_totalFileCount").alias("total_files"))

    def lookup(self, *terms: str) -> DataFrame:
        """Postings of terms, with relevance; every shard that is needed is read once for all of its terms."""
        _, keys = self.root()
        shards: dict[str, list[str]] = {}
        for t in terms:
            shards.setdefault(route(t, keys), []).append(t)
        parts = [self._shard(k, ts) for k, ts in shards.items()]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def _shard(self, key: str, terms: list[str]) -> DataFrame:
        words = self.words(self.file(key, "words")).where(F.col("term").isin(terms))
        joined = words.join(self.files(self.file(key, "files")), "id").crossJoin(F.broadcast(self.total_files(self.file(key, "totals"))))  # one row
        return word_file_postings(joined)


#: Files of a word that stand in one element; a word with more has several.
FILES_OF_WORD = 1000


def write_xml(postings: DataFrame, path: str, keys: list[str], total_files: int, title: str = "", owner: str = "", email: str = "") -> XmlIndex:
    """Write PAGE postings (with word_count) as an XML index with those shards.

    A section of a shard is a folder of files; a frequent word is cut into several elements, so nothing gathers all its
    pages.
    """
    spark = postings.sparkSession
    pages = route_column(postings.where(F.col("entry_type") == PAGE), keys)
    count = pages.groupBy("term").agg(F.count("*").alias("_fileCount"))
    file = F.struct(F.col("target").alias("_id"), F.array_join(F.transform("positions", lambda p: p.cast("string")), ",").alias("_VALUE"))
    cut = F.pmod(F.xxhash64("target"), F.ceil(F.col("_fileCount") / FILES_OF_WORD))
    words = pages.join(count, "term").groupBy("shard", F.col("term").alias("_v"), "_fileCount", cut.alias("cut")).agg(F.collect_list(file).alias("file")).drop("cut")
    files = pages.select("shard", F.col("target").alias("_id"), F.col("target").alias("_key"), F.col("title").alias("_title"), F.col("word_count").alias("_wordCount")).distinct()
    totals = spark.createDataFrame([(k, total_files, "") for k in keys], "shard string, _totalFileCount bigint, _VALUE string")
    for section, tag, rows in (("words", "word", words), ("files", "file", files), ("totals", "files", totals)):
        rows.write.format("xml").option("rootTag", section).option("rowTag", tag).partitionBy("shard").save(f"{path}/{section}")
    header = "".join(f"<{tag}>{html.escape(text)}</{tag}>" for tag, text in (("title", title), ("owner", owner), ("email", email)) if text)
    root = f"<main_index><header>{header}</header><keywords>{''.join(f'<subIndex key={k!r}/>' for k in keys)}</keywords></main_index>"
    spark.createDataFrame([(root,)], "value string").coalesce(1).write.text(f"{path}/index.xml")
    return XmlIndex(spark, path, True)


def word_file_postings(joined: DataFrame) -> DataFrame:
    """Postings from (term, file_count, positions, page, title, word_count, total_files)."""
    tf = F.size("positions")
    idf = F.when((F.col("total_files") > 0) & (F.col("file_count") > 0), F.log(F.col("total_files") / F.col("file_count"))).otherwise(1.0)
    rel = F.when((tf > 0) & (F.coalesce(F.col("word_count"), F.lit(0)) > 0), tf / F.col("word_count") * idf).otherwise(0.0)
    return joined.select("term", F.lit(PAGE).cast("tinyint").alias("entry_type"), F.col("page").alias("target"), "title", rel.cast("double").alias("rel"), tf.alias("tf"), "positions")
