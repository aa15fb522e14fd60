"""The registered queries of the index engine, each with the same result in SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import algebra, federate, indexer, merge, ordered, present
from ..schema import INDEX, PAGE, TERM
from ..sources import codecs, store, xml_index
from ..staging import shared_folder, stage
from .query import Engine, MissingTerm, parse, show

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

TOKENS = r"""tok AS (SELECT doc_id, lang, source, unnest(t) AS term, unnest(range(len(t))) AS pos, len(t) AS wc
 FROM (SELECT *, regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[\p{L}\p{Nd}]+') AS t FROM documents))"""
POSTINGS = TOKENS + """,
post AS (SELECT term, CAST(doc_id AS VARCHAR) AS target, any_value(lang) AS lang, any_value(source) AS site,
 any_value((doc_id // 20) // 5) AS edition, any_value(wc) AS wc, count(*) AS tf, count(*) / any_value(wc) AS rel, list_sort(list(pos)) AS positions
 FROM tok GROUP BY term, doc_id)"""
WITH = f"WITH {POSTINGS} "


def register(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def docs_of(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def postings(spark: SparkSession, d: str, lang: str | None = None) -> DataFrame:
    docs = docs_of(spark, d)
    if lang:
        docs = docs.where(F.col("lang") == lang)
    return indexer.build_postings(docs, site=F.col("source"), edition=F.expr("(doc_id div 20) div 5"))


def of_terms(spark: SparkSession, d: str, terms: list[str], lang: str | None = None) -> DataFrame:
    docs = docs_of(spark, d)
    if lang:
        docs = docs.where(F.col("lang") == lang)
    return indexer.postings_of_terms(docs, terms, site=F.col("source"), edition=F.expr("(doc_id div 20) div 5"))


def engine(spark: SparkSession, d: str, **options) -> Engine:
    return Engine({"all": lambda terms: of_terms(spark, d, terms)}, **options)


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*columns, F.round("rel", 6).alias("rel"))


def listed(column: str):
    return F.array_join(F.transform(column, lambda p: p.cast("string")), ",").alias(column)


def flagship(spark: SparkSession, d: str) -> DataFrame:
    found = engine(spark, d).search('attion -"anea eriner"')
    return present.ranked(found).select("target", F.round("rel", 6).alias("rel"))


# tokens and postings

register("tokenize_latin", f"WITH {TOKENS} SELECT doc_id, pos, term FROM tok")(lambda s, d: tx.tokenize(docs_of(s, d)).withColumn("pos", F.col("pos").cast("bigint")))
register("fold_case", "SELECT doc_id, md5(replace(lower(text), 'ß', 'ss')) AS folded FROM documents")(lambda s, d: docs_of(s, d).select("doc_id", F.md5(tx.fold(F.col("text"))).alias("folded")))
register(
    "stop_word_filter", f"WITH {TOKENS} SELECT term, count(*) AS n FROM tok WHERE length(term) >= 3 AND term NOT IN ('the', 'and', 'that', 'have', 'for') GROUP BY term"
)(lambda s, d: tx.tokenize(docs_of(s, d)).where(~tx.is_stop_word(F.col("term"))).groupBy("term").agg(F.count("*").alias("n")))
_CJK = "VALUES (1, '日本語'), (2, '東京'), (3, '한'), (4, 'a'), (5, '')"
register(
    "tokenize_cjk_pairs",
    f"""SELECT id, array_to_string(flatten([CASE WHEN k < length(t) THEN [substr(t, k, 1), substr(t, k, 2)] ELSE [substr(t, k, 1)] END FOR k IN range(1, length(t) + 1)]), '|') AS grams
 FROM ({_CJK}) v(id, t)""",
)(lambda s, d: s.sql(f"SELECT * FROM ({_CJK}) v(id, t)").select("id", F.array_join(tx.cjk_grams(F.col("t")), "|").alias("grams")))
_WORDS = "VALUES ('the'), ('who'), ('ab'), ('日'), ('3日'), ('日本'), ('x'), ('fora'), ('have')"
register(
    "stop_words_and_scripts",
    f"""SELECT w, (w IN ('the', 'and', 'that', 'have', 'for') OR (length(w) < 3 AND NOT unicode(w) BETWEEN 19968 AND 40959 AND NOT (length(w) = 2 AND unicode(substr(w, 2, 1)) BETWEEN 19968 AND 40959))) AS stop,
 unicode(w) BETWEEN 19968 AND 40959 AS cjk FROM ({_WORDS}) v(w)""",
)(lambda s, d: s.sql(f"SELECT * FROM ({_WORDS}) v(w)").select("w", tx.is_stop_word(F.col("w")).alias("stop"), tx.is_cjk(F.col("w")).alias("cjk")))
register("word_counts", f"WITH {TOKENS} SELECT doc_id, len(t) AS word_count FROM (SELECT doc_id, regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[\\p{{L}}\\p{{Nd}}]+') AS t FROM documents)")(
    lambda s, d: indexer.word_counts(docs_of(s, d))
)
register("postings", WITH + "SELECT term, target, tf, round(rel, 6) AS rel, site, edition FROM post")(
    lambda s, d: postings(s, d).select("term", "target", F.col("tf").cast("bigint").alias("tf"), F.round("rel", 6).alias("rel"), "site", "edition")
)
register("posting_positions", WITH + "SELECT term, target, array_to_string(positions, ',') AS positions FROM post")(lambda s, d: postings(s, d).select("term", "target", listed("positions")))
register("doc_frequency", WITH + "SELECT term, count(*) AS df FROM post GROUP BY term")(lambda s, d: indexer.doc_frequency(postings(s, d)))
register("tf_relevance", WITH + "SELECT target, max(round(rel, 6)) AS best, count(*) AS n FROM post GROUP BY target")(
    lambda s, d: postings(s, d).groupBy("target").agg(F.max(F.round("rel", 6)).alias("best"), F.count("*").alias("n"))
)
register(
    "tfidf_relevance",
    WITH + ", n AS (SELECT count(*) AS total FROM documents), f AS (SELECT term, count(*) AS df FROM post GROUP BY term) SELECT p.term, p.target, round(p.tf / p.wc * ln(n.total / f.df), 6) AS rel FROM post p JOIN f USING (term), n",
)(lambda s, d: rounded(indexer.tfidf(stage(postings(s, d).select("term", "target", "tf", "word_count")), docs_of(s, d).count()), "term", "target"))
register(
    "idf_rescale_clamped",
    WITH + ", f AS (SELECT term, count(*) AS df FROM post GROUP BY term) SELECT p.term, p.target, round(p.rel * CASE WHEN ln(100 / f.df) < 0 THEN 1 ELSE ln(100 / f.df) END, 6) AS rel FROM post p JOIN f USING (term)",
)(lambda s, d: rounded(indexer.idf_rescale(stage(postings(s, d).select("term", "target", "entry_type", "rel")), 100), "term", "target"))
register("forward_index_terms", WITH + "SELECT target AS uri, md5(array_to_string(list_sort(list(term)), ' ')) AS terms FROM post GROUP BY target")(
    lambda s, d: indexer.forward_index(postings(s, d)).select("uri", F.md5(F.array_join("terms", " ")).alias("terms"))
)
register(
    "conversation_terms",
    r"SELECT term, count(*) AS n, count(DISTINCT conv_id) AS convs FROM (SELECT conv_id, unnest(regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[\p{L}\p{Nd}]+')) AS term FROM conversations) GROUP BY term",
)(lambda s, d: tx.tokenize(table(s, d, "conversations"), "conv_id").groupBy("term").agg(F.count("*").alias("n"), F.countDistinct("conv_id").alias("convs")))

# lookups and ranges

register("term_lookup", WITH + "SELECT target, tf, round(rel, 6) AS rel FROM post WHERE term = 'attion'")(
    lambda s, d: of_terms(s, d, ["attion"]).select("target", F.col("tf").cast("bigint").alias("tf"), F.round("rel", 6).alias("rel"))
)
register("multi_term_lookup", WITH + "SELECT term, target, round(rel, 6) AS rel FROM post WHERE term IN ('anea', 'eriner', 'pour')")(
    lambda s, d: rounded(of_terms(s, d, ["anea", "eriner", "pour"]), "term", "target")
)
register("key_scan_distinct_terms", f"WITH {TOKENS} SELECT DISTINCT term FROM tok")(lambda s, d: tx.tokenize(docs_of(s, d)).select("term").distinct())
register("key_range_terms", f"WITH {TOKENS} SELECT DISTINCT term FROM tok WHERE term > 'an' AND term < 'ao'")(lambda s, d: ordered.key_range(tx.tokenize(docs_of(s, d)).select("term"), "term", "an", "ao").distinct())
register("prefix_terms", f"WITH {TOKENS} SELECT DISTINCT term FROM tok WHERE starts_with(term, 'that')")(lambda s, d: ordered.prefix(tx.tokenize(docs_of(s, d)).select("term"), "term", "that").distinct())
register("position_filter", WITH + "SELECT term, target FROM post WHERE list_contains(positions, 3)")(lambda s, d: postings(s, d).where(tx.has_position(F.col("positions"), 3)).select("term", "target"))
register("positions_size", WITH + "SELECT term, CAST(sum(len(positions)) AS BIGINT) AS n, min(positions[1]) AS first FROM post GROUP BY term")(
    lambda s, d: postings(s, d).groupBy("term").agg(F.sum(F.size("positions")).alias("n"), F.min(F.element_at("positions", 1)).cast("bigint").alias("first"))
)

# algebra and queries


def searched(name: str, query: str, sql: str, **options) -> None:
    register(name, WITH + sql)(lambda s, d: rounded(engine(s, d, **options).search(query), "target"))


def _one(term: str) -> str:
    return f"(SELECT target, rel, positions FROM post WHERE term = '{term}')"


_TWO = f"SELECT a.target, round((a.rel + b.rel) / 2, 6) AS rel FROM {_one('anea')} a JOIN {_one('eriner')} b USING (target)"
_PHRASE = f"SELECT a.target, round(a.rel, 6) AS rel FROM {_one('anea')} a JOIN {_one('eriner')} b USING (target) WHERE len(list_filter(a.positions, lambda p: list_contains(b.positions, p + 1))) > 0"
searched("single_term", "attion", "SELECT target, round(rel, 6) AS rel FROM post WHERE term = 'attion'")
searched("intersect_two", "anea eriner", _TWO)
searched("intersect_three", "anea eriner thanedble", f"SELECT a.target, round((a.rel + b.rel + c.rel) / 3, 6) AS rel FROM {_one('anea')} a JOIN {_one('eriner')} b USING (target) JOIN {_one('thanedble')} c USING (target)")
searched("intersect_stopword_dropped", "anea the of eriner", _TWO)
searched("exclude", "anea -eriner", f"SELECT target, round(rel, 6) AS rel FROM {_one('anea')} WHERE target NOT IN (SELECT target FROM post WHERE term = 'eriner')")
searched("exclude_not", "anea not eriner", f"SELECT target, round(rel, 6) AS rel FROM {_one('anea')} WHERE target NOT IN (SELECT target FROM post WHERE term = 'eriner')")
searched("phrase_two", '"anea eriner"', _PHRASE)
searched("phrase_hyphen", "anea-eriner", _PHRASE)
searched(
    "phrase_gap_stopword", '"thanedble the anea"',
    f"SELECT a.target, round(a.rel, 6) AS rel FROM {_one('thanedble')} a JOIN {_one('anea')} b USING (target) WHERE len(list_filter(a.positions, lambda p: list_contains(b.positions, p + 2))) > 0",
)
_UNION = f"SELECT target, round(CASE WHEN a.rel IS NULL THEN b.rel WHEN b.rel IS NULL THEN a.rel ELSE (a.rel + b.rel) / 2 END, 6) AS rel FROM {_one('anea')} a FULL JOIN {_one('eriner')} b USING (target)"
searched("union_merge", "anea or eriner", _UNION)
searched("union_observed", "anea or eriner", "SELECT DISTINCT target, round(rel, 6) AS rel FROM (SELECT DISTINCT target, rel FROM post WHERE term IN ('anea', 'eriner'))", union_mode="observed")
searched("query_mixed", 'attion -"anea eriner"', f"SELECT target, round(rel, 6) AS rel FROM {_one('attion')} WHERE target NOT IN (SELECT target FROM ({_PHRASE}))")
searched(
    "query_or_and_not", "attion pour or anea -eriner",
    f"""SELECT a.target, round((a.rel + o.rel) / 2, 6) AS rel FROM {_one('attion')} a
 JOIN (SELECT target, CASE WHEN p.rel IS NULL THEN q.rel WHEN q.rel IS NULL THEN p.rel ELSE (p.rel + q.rel) / 2 END AS rel FROM {_one('pour')} p FULL JOIN {_one('anea')} q USING (target)) o USING (target)
 WHERE a.target NOT IN (SELECT target FROM post WHERE term = 'eriner')""",
)
register("phrase_positions", WITH + f"SELECT target, array_to_string(p, ',') AS positions FROM (SELECT target, list_filter(a.positions, lambda p: list_contains(b.positions, p + 1)) AS p FROM {_one('anea')} a JOIN {_one('eriner')} b USING (target)) WHERE len(p) > 0")(
    lambda s, d: engine(s, d).search('"anea eriner"').select("target", listed("positions"))
)
register("semi_join", WITH + "SELECT target, round(rel, 6) AS rel FROM post WHERE term = 'anea' AND target IN (SELECT target FROM post WHERE term = 'eriner')")(
    lambda s, d: rounded(algebra.semi(*[algebra.from_postings(of_terms(s, d, [t])) for t in ("anea", "eriner")]), "target")
)
register("multi_index_union", WITH + "SELECT target, round(rel, 6) AS rel FROM post WHERE term = 'attion' AND lang IN ('en', 'de', 'fr', 'es')")(
    lambda s, d: rounded(Engine({x: lambda terms, x=x: of_terms(s, d, terms, x) for x in ("en", "de", "fr", "es")}).search("attion", "en de;fr es"), "target")
)
register("resubject", WITH + "SELECT 'attion@all' AS subj, count(*) AS n FROM post WHERE term = 'attion'")(lambda s, d: engine(s, d).search("Attion ").groupBy("subj").agg(F.count("*").alias("n")))

# ranking and presentation

_RANKED = "SELECT target, round(CASE WHEN a.rel IS NULL THEN b.rel WHEN b.rel IS NULL THEN a.rel ELSE (a.rel + b.rel) / 2 END, 6) AS rel"
register("rank_topk", WITH + f"{_RANKED} FROM {_one('attion')} a FULL JOIN {_one('pour')} b USING (target) ORDER BY CASE WHEN a.rel IS NULL THEN b.rel WHEN b.rel IS NULL THEN a.rel ELSE a.rel / 2 + b.rel / 2 END DESC, target LIMIT 10")(
    lambda s, d: rounded(present.top(engine(s, d).search("attion or pour"), 10), "target")
)


def _with_site(s: SparkSession, d: str, term: str) -> DataFrame:
    return stage(of_terms(s, d, [term]))


register("site_groups", WITH + "SELECT site, edition, count(*) AS pages, round(max(rel), 6) AS rel FROM post WHERE term = 'anea' GROUP BY site, edition")(
    lambda s, d: rounded(present.site_groups(_with_site(s, d, "anea")), "site", "edition", "pages")
)
register("newest_edition_only", WITH + "SELECT site, edition, target, round(rel, 6) AS rel FROM (SELECT *, rank() OVER (PARTITION BY site ORDER BY edition DESC) AS k FROM post WHERE term = 'anea') WHERE k = 1")(
    lambda s, d: rounded(present.newest_edition(_with_site(s, d, "anea")), "site", "edition", "target")
)
register("newest_flag", WITH + "SELECT target, edition = max(edition) OVER (PARTITION BY site) AS newest FROM post WHERE term = 'anea'")(lambda s, d: present.mark_newest(_with_site(s, d, "anea")).select("target", "newest"))
register("older_version_count", WITH + "SELECT site, count(DISTINCT edition) - 1 AS older FROM post WHERE term = 'anea' GROUP BY site")(lambda s, d: present.older_versions(_with_site(s, d, "anea")))
register("result_count", WITH + f"SELECT 'Found ' || count(*) || ' results' AS line FROM ({_TWO})")(lambda s, d: present.count_line(engine(s, d).search("anea eriner")))
_ENTRIES = "VALUES ('test', 1, 0.8, 'lol'), ('test', 0, 0.8, 'CHK@MIh5'), ('test', 1, 0.8, 'lol2'), ('lol', 2, 0.8, 'CHK@9eDo'), ('lol', 2, 0.9, 'CHK@9eDo')"
register("entry_type_order", f"SELECT subj, entry_type, target, row_number() OVER (ORDER BY subj, rel DESC, entry_type, target) - 1 AS place FROM ({_ENTRIES}) v(subj, entry_type, rel, target)")(
    lambda s, d: ordered.with_rank(s.sql(f"SELECT * FROM ({_ENTRIES}) v(subj, entry_type, rel, target)"), *present.entry_order(), name="place").select("subj", "entry_type", "target", "place")
)
_KINDS = "SELECT subj, CAST(entry_type AS TINYINT) AS entry_type, target, rel FROM"
register("entry_type_filter", f"SELECT entry_type, target, count(*) AS n FROM ({_ENTRIES}) v(subj, entry_type, rel, target) GROUP BY entry_type, target")(
    lambda s, d: _by_kind(s.sql(f"{_KINDS} ({_ENTRIES}) v(subj, entry_type, rel, target)"))
)


def _by_kind(rows: DataFrame) -> DataFrame:
    parts = [f(rows) for f in (present.pages, present.related_terms, present.related_indexes)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy(F.col("entry_type").cast("int").alias("entry_type"), "target").agg(F.count("*").alias("n"))


register(
    "editions_ascending",
    WITH + """, b AS (SELECT site, max(rel) AS best FROM post WHERE term = 'anea' GROUP BY site)
 SELECT p.target, row_number() OVER (ORDER BY b.best DESC, p.site, p.edition, p.rel DESC, p.target) - 1 AS place FROM post p JOIN b USING (site) WHERE p.term = 'anea'""",
)(lambda s, d: _placed(present.present(_with_site(s, d, "anea"), show_old=True)))


def _placed(shown: DataFrame) -> DataFrame:
    """The place of each row in an ordered frame, by the same order."""
    return ordered.with_rank(stage(shown), F.desc("site_rel"), F.asc("site"), F.asc("edition"), F.desc("rel"), F.asc("target"), name="place").select("target", "place")


register(
    "url_site_edition",
    r"""SELECT page_id, regexp_replace(regexp_replace(url, '[?#].*$', ''), '/\d+(\.html?)?/?$', '') AS site,
 coalesce(TRY_CAST(nullif(regexp_extract(regexp_replace(url, '[?#].*$', ''), '/(\d+)(?:\.html?)?/?$', 1), '') AS BIGINT), -9223372036854775808) AS edition FROM pages""",
)(lambda s, d: table(s, d, "pages").select("page_id", tx.site_of(F.col("url")).alias("site"), tx.edition_of(F.col("url")).alias("edition")))
_TITLES = "VALUES (1, ' ', 'a/b/c.html', 0.0), (2, 'T', 'x', 0.5), (3, CAST(NULL AS STRING), 'u/v', 0.25)"
register(
    "title_fallback",
    f"SELECT id, CASE WHEN trim(coalesce(t, '')) = '' THEN regexp_extract(u, '[^/]*$') ELSE trim(t) END AS title, CASE WHEN rel = 0 THEN 'unknown' ELSE CAST(round(CAST(rel AS DOUBLE) * 100, 2) AS VARCHAR) || '%' END AS relevance FROM ({_TITLES.replace('STRING', 'VARCHAR')}) v(id, t, u, rel)",
)(lambda s, d: s.sql(f"SELECT id, t, u, CAST(rel AS DOUBLE) AS rel FROM ({_TITLES}) v(id, t, u, rel)").select("id", tx.display_title(F.col("t"), F.col("u")).alias("title"), tx.display_relevance(F.col("rel")).alias("relevance")))

# merging and storage

_SLICES = "SELECT term, count(*) AS n, round(sum(rel), 4) AS rel FROM post GROUP BY term"


@register("merge_upsert", WITH + _SLICES)
def _merge(s: SparkSession, d: str) -> DataFrame:
    docs = docs_of(s, d)
    edge = docs.agg(F.max("doc_id")).first()[0] or 0
    part = lambda rows: indexer.build_postings(rows)
    merged = merge.upsert(part(docs.where(F.col("doc_id") <= edge * 2 // 3)), part(docs.where(F.col("doc_id") >= edge // 3)))
    return merged.groupBy("term").agg(F.count("*").alias("n"), F.round(F.sum("rel"), 4).alias("rel"))


register("merge_full_outer", WITH + "SELECT coalesce(a.term, b.term) AS term, coalesce(a.n, 0) AS old_n, coalesce(b.n, 0) AS new_n, coalesce(a.n, 0) + coalesce(b.n, 0) AS merged_n FROM (SELECT term, count(*) AS n FROM post WHERE lang = 'de' GROUP BY term) a FULL JOIN (SELECT term, count(*) AS n FROM post WHERE lang = 'fr' GROUP BY term) b ON a.term = b.term")(
    lambda s, d: merge.merge_full(postings(s, d, "de"), postings(s, d, "fr"))
)
register("delete_anti", WITH + "SELECT term, count(*) AS n FROM post WHERE lang <> 'de' GROUP BY term")(lambda s, d: merge.delete(postings(s, d), postings(s, d, "de")).groupBy("term").agg(F.count("*").alias("n")))
register("additive_total_pages", "SELECT 'Ω ' || max(lang) AS name, count(*) AS total_pages FROM documents")(
    lambda s, d: merge.metadata_of(docs_of(s, d).groupBy("lang").agg(F.count("*").alias("total_pages")).select(F.col("lang").alias("batch"), F.concat(F.lit("Ω "), "lang").alias("name"), F.lit(None).cast("string").alias("owner"), F.lit(None).cast("string").alias("owner_email"), "total_pages")).select("name", "total_pages")
)
register("distinct_pages", WITH + "SELECT count(DISTINCT target) AS total_pages FROM post")(lambda s, d: merge.distinct_pages(postings(s, d)))
register("group_by_term", WITH + "SELECT term, count(DISTINCT target) AS entries, min(target) AS first, max(target) AS last FROM post GROUP BY term")(lambda s, d: indexer.group_by_term(postings(s, d)))
register("merge_handlers", WITH + "SELECT term, count(*) AS n, count(*) FILTER (lang = 'fr') AS fresh FROM post WHERE lang IN ('de', 'fr') AND term IN (SELECT term FROM post WHERE lang = 'fr') GROUP BY term")(
    lambda s, d: merge.update_with(postings(s, d, "de"), postings(s, d, "fr"), {"n": F.count(F.when(~F.col("fresh"), 1)), "added": F.count(F.when(F.col("fresh"), 1))}).select("term", "n", F.col("added").alias("fresh"))
)
register("md5_shard_route", f"WITH {TOKENS} SELECT DISTINCT term, CASE WHEN md5(term) >= 'c' THEN 'c' WHEN md5(term) >= '8' THEN '8' WHEN md5(term) >= '4' THEN '4' ELSE '0' END AS shard FROM tok")(
    lambda s, d: store.route_column(tx.tokenize(docs_of(s, d)).select("term").distinct(), ["0", "4", "8", "c"]).select("term", "shard")
)
register("hex_round_trip", "SELECT doc_id, md5(text) AS h, md5(text) AS back, sha256(text) AS sha FROM documents")(
    lambda s, d: docs_of(s, d).select("doc_id", F.md5("text").alias("h"), F.lower(F.hex(F.unhex(F.md5("text")))).alias("back"), F.sha2("text", 256).alias("sha"))
)
register("cache_key", "SELECT doc_id, to_base64(unhex(sha256(text))) AS key FROM documents")(lambda s, d: docs_of(s, d).select("doc_id", tx.cache_key(F.col("text")).alias("key")))
_PLACES = "VALUES (1, '3,7,x,9'), (2, ''), (3, ' 4 ,5'), (4, 'a')"
register("parse_positions", f"SELECT id, array_to_string(list_filter([TRY_CAST(trim(x) AS INTEGER) FOR x IN string_split(t, ',')], lambda p: p IS NOT NULL), ',') AS positions FROM ({_PLACES}) v(id, t)")(
    lambda s, d: s.sql(f"SELECT * FROM ({_PLACES}) v(id, t)").select("id", tx.parse_positions(F.col("t")).alias("positions")).select("id", listed("positions"))
)


_TFIDF = ", n AS (SELECT count(*) AS total FROM documents), f AS (SELECT term, count(*) AS df FROM post GROUP BY term) SELECT p.term, p.target, round(p.tf / p.wc * ln(n.total / f.df), 6) AS rel FROM post p JOIN f USING (term), n"


def _xml(s: SparkSession, d: str) -> xml_index.XmlIndex:
    """All postings, written as an XML index of four shards."""
    return xml_index.write_xml(stage(postings(s, d)), shared_folder(s, "xml"), ["0", "4", "8", "c"], docs_of(s, d).count(), "documents & more", "nobody")


@register("xml_word_file_join", WITH + _TFIDF + " WHERE p.term IN ('anea', 'eriner')")
def _xml_join(s: SparkSession, d: str) -> DataFrame:
    """The two sections of the shards, words with their places and files with their sizes, read back and joined on the file id."""
    return rounded(_xml(s, d).lookup("anea", "eriner"), "term", "target")


@register("xml_root", "SELECT unnest(['0', '4', '8', 'c']) AS key, 'documents & more' AS title, 'nobody' AS owner")
def _xml_root(s: SparkSession, d: str) -> DataFrame:
    index = _xml(s, d)
    header, keys = store.open_index(s, f"{index.path}/index.xml").root()
    return s.createDataFrame([(k, header["title"], header["owner"]) for k in keys], "key string, title string, owner string")


@register("xml_sections", WITH + ", r AS (SELECT *, CASE WHEN md5(term) >= 'c' THEN 'c' WHEN md5(term) >= '8' THEN '8' WHEN md5(term) >= '4' THEN '4' ELSE '0' END AS shard FROM post) SELECT 'word' AS kind, term AS name, count(*) AS n FROM r WHERE shard = '4' GROUP BY term UNION ALL SELECT DISTINCT 'file', target, wc FROM r WHERE shard = '4'")
def _xml_sections(s: SparkSession, d: str) -> DataFrame:
    index = _xml(s, d)
    words = index.words(index.file("4", "words")).groupBy("term", "file_count").agg(F.count("*").alias("n")).where("n = file_count")
    files = index.files(index.file("4", "files")).select(F.lit("file").alias("kind"), F.col("page").alias("name"), F.col("word_count").cast("bigint").alias("n"))
    return words.select(F.lit("word").alias("kind"), F.col("term").alias("name"), "n").unionByName(files)


@register("stored_lookup", WITH + "SELECT target, round(rel, 6) AS rel FROM post WHERE term = 'attion'")
def _stored(s: SparkSession, d: str) -> DataFrame:
    index = store.StoredIndex(s, shared_folder(s, "index"))
    index.write(postings(s, d), {"name": "documents"})
    return rounded(index.lookup("attion"), "target")


@register("stored_lookup_all", WITH + "SELECT term, count(*) AS n FROM post WHERE term IN (SELECT term FROM post WHERE target = '7') GROUP BY term")
def _stored_all(s: SparkSession, d: str) -> DataFrame:
    """All terms of one document at once, from the stored index."""
    index = store.StoredIndex(s, shared_folder(s, "index"))
    index.write(postings(s, d))
    return index.lookup_all(index.postings().where("target = '7'").select("term")).groupBy("term").agg(F.count("*").alias("n"))


@register("uri_table", "SELECT url AS uri, min(page_id) AS size FROM pages WHERE page_id % 3 <> 0 GROUP BY url")
def _uris(s: SparkSession, d: str) -> DataFrame:
    """Addresses put into an index in two editions, some taken out again, and read one by one by their keys."""
    index = store.StoredIndex(s, shared_folder(s, "index"))
    urls = table(s, d, "pages").groupBy(F.col("url").alias("uri"), (F.col("page_id") % 3 == 0).alias("gone")).agg(F.min("page_id").alias("size"))
    kept = urls.where("not gone").drop("gone")
    index.write(of_terms(s, d, ["pour"]))
    index.put_uris(urls.where("gone").join(kept.select("uri"), "uri", "left_anti").select("uri", "size"))
    index.put_uris(kept)
    index.remove_uris(urls.where("gone").join(kept.select("uri"), "uri", "left_anti"))
    return index.uris().select("uri", F.col("size").cast("bigint").alias("size"))


@register("stored_remove", WITH + "SELECT term, count(*) AS n FROM post WHERE term IN ('anea', 'eriner') AND lang <> 'de' GROUP BY term")
def _removed(s: SparkSession, d: str) -> DataFrame:
    index = store.StoredIndex(s, shared_folder(s, "index"))
    both = of_terms(s, d, ["anea", "eriner"])
    index.write(both)
    index.remove(of_terms(s, d, ["anea", "eriner"], "de"))
    return index.postings().groupBy("term").agg(F.count("*").alias("n"))


@register("stream_ingest_equals_batch", WITH + "SELECT term, count(*) AS n FROM post GROUP BY term")
def _streamed(s: SparkSession, d: str) -> DataFrame:
    from ..schema import POSTINGS as SCHEMA
    from ..streaming.ingest import Ingest

    root = shared_folder(s, "index")
    postings(s, d).select(*SCHEMA.fieldNames()).write.option("compression", "zstd").parquet(f"{root}/in")
    ingest = Ingest(s, f"{root}/index")
    ingest.start(f"{root}/in", f"{root}/log", available_now=True, clean=True).awaitTermination()
    if ingest.pending_names():
        ingest.compact()
    return ingest.snapshot().groupBy("term").agg(F.count("*").alias("n"))


@register("push_buffer_ingest", WITH + "SELECT term, count(*) AS n, 'documents' AS name, 14 AS total_pages FROM post WHERE term IN ('anea', 'eriner', 'pour', 'attion') GROUP BY term")
def _pushed(s: SparkSession, d: str) -> DataFrame:
    """Two slices pushed as buffers with headers, the first one twice: the metadata of both, each entry once."""
    from ..streaming.ingest import Ingest, push

    root = shared_folder(s, "index")
    rows = of_terms(s, d, ["anea", "eriner", "pour", "attion"])
    ingest = Ingest(s, f"{root}/index", merge.FlushPolicy(max_updates=0))
    for k, (terms, pages) in enumerate(((["anea", "eriner"], 3), (["pour", "attion"], 4))):
        some = stage(rows.where(F.col("term").isin(terms)).coalesce(1))
        for _ in range(2 - k):
            push(codecs.encode_buffers(some, {"name": "documents", "total_pages": pages}, 1 << 20), f"{root}/in")
    push(codecs.encode_buffers(stage(rows.where("term = 'pour'").coalesce(1)), {"owner": "x", "total_pages": 4}, 1 << 20), f"{root}/in")
    ingest.start(f"{root}/in", f"{root}/log", available_now=True, max_files=1, buffers=True).awaitTermination()
    meta = ingest.index.meta()
    return ingest.snapshot().groupBy("term").agg(F.count("*").alias("n")).select("term", "n", F.lit(meta["name"]).alias("name"), F.lit(meta["total_pages"]).cast("int").alias("total_pages"))


@register("ingest_restart", WITH + "SELECT term, count(*) AS n, 1 AS edition FROM post WHERE term IN ('anea', 'eriner') GROUP BY term")
def _restarted(s: SparkSession, d: str) -> DataFrame:
    """A write that failed left files of the next edition behind: it is written all the same, and holds no delta twice."""
    from ..schema import POSTINGS as SCHEMA
    from ..streaming.ingest import Ingest

    root = shared_folder(s, "index")
    ingest = Ingest(s, f"{root}/index")
    rows = of_terms(s, d, ["anea", "eriner"]).select(*SCHEMA.fieldNames())
    ingest.merge_batch(rows.where("term = 'anea'"), 0)
    ingest.compact()
    ingest.merge_batch(rows, 1)
    rows.limit(3).withColumn("shard", F.lit("x")).write.partitionBy("shard").parquet(f"{root}/index/postings/edition=1")
    edition = ingest.compact()
    return ingest.snapshot().groupBy("term").agg(F.count("*").alias("n")).withColumn("edition", F.lit(edition))


@register("binary_round_trip", WITH + "SELECT term, target, tf FROM post WHERE term IN ('anea', 'eriner', 'pour')")
def _codec(s: SparkSession, d: str) -> DataFrame:
    back = codecs.decode_rows(codecs.encode_rows(of_terms(s, d, ["anea", "eriner", "pour"])))
    return back.select("term", "target", F.size("positions").cast("bigint").alias("tf"))


@register("yaml_round_trip", WITH + "SELECT term, target, array_to_string(positions, ',') AS positions FROM post WHERE term IN ('anea', 'eriner', 'pour')")
def _yaml(s: SparkSession, d: str) -> DataFrame:
    """Written as files of block YAML and read back."""
    folder = shared_folder(s, "yaml")
    codecs.encode_yaml(of_terms(s, d, ["anea", "eriner", "pour"])).write.text(folder)
    return codecs.read_yaml(s, f"{folder}/part-*").select("term", "target", listed("positions"))


# the search language and the strict tokenizer, against what they must give

_TREES = {
    "Foo": "foo", "the": "-", "foo bar": "(and foo bar)", "foo the bar": "(and foo bar)", "foo or bar": "(or foo bar)", "foo bar or baz": "(and foo (or bar baz))", "foo or the": "-",
    "foo -bar": "(not foo bar)", "foo not bar": "(not foo bar)", "foo notebook": "(and foo notebook)", "-foo": "-", "the and": "-", "foo -the": "-", '"jesus of nazareth"': '"jesus+0 nazareth+2"', '"the who"': "-",
    "free-software": '"free+0 software+1"', 'foo "bar': "(and foo bar)", 'freenet -"freenet message system"': '(not freenet "freenet+0 message+1 system+2")',
    'freenet or "free network"': '(or freenet "free+0 network+1")', "日本": "(and 日 本)", "  Foo   BAR ": "(and foo bar)", "foo bar -baz -qux": "(not (not (and foo bar) baz) qux)", "foo or": "error", "or foo": "error", "foo not": "error", "   ": "error", "foo or not bar": "error",
}


def _values(pairs: dict[str, str]) -> str:
    quoted = lambda t: "'" + t.replace("'", "''") + "'"
    return "VALUES " + ", ".join(f"({quoted(a)}, {quoted(b)})" for a, b in pairs.items())


def _tree(query: str) -> str:
    try:
        return show(parse(query))
    except ValueError:
        return "error"


register("query_trees", f"SELECT * FROM ({_values(_TREES)}) v(query, tree)")(lambda s, d: s.createDataFrame([(q, _tree(q)) for q in _TREES], "query string, tree string"))
_STRICT = {"Don't stop' 12 345 67": "don't stop 345 67", "日本語字": "日 日本 本 本語 語 語字 字", "ab日本": "ab 日 日本 本", "12 a1 99": "a1 99", "Straße": "strasse", "it's 7日": "it's 7日 日", "": ""}
register("tokenize_mixed_scripts", f"SELECT * FROM ({_values(_STRICT)}) v(text, tokens)")(
    lambda s, d: s.createDataFrame([(t,) for t in _STRICT], "text string").join(
        tx.tokenize_strict(s.createDataFrame([(t, t) for t in _STRICT], "doc_id string, text string"), pairs=True).groupBy(F.col("doc_id").alias("text")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "term"))), lambda x: x["term"]), " ").alias("tokens")), "text", "left",
    ).select("text", F.coalesce("tokens", F.lit("")).alias("tokens"))
)


@register("missing_term", "SELECT * FROM (VALUES ('empty', '0'), ('error', 'nosuchword')) v(mode, found)")
def _missing(s: SparkSession, d: str) -> DataFrame:
    def found(mode: str) -> str:
        try:
            return str(engine(s, d, on_missing=mode).search("anea nosuchword").count())
        except MissingTerm as e:
            return str(e)

    return s.createDataFrame([(m, found(m)) for m in ("empty", "error")], "mode string, found string")


@register("multi_index_with_failures", WITH + "SELECT target, round(rel, 6) AS rel FROM post WHERE term = 'attion'")
def _failing(s: SparkSession, d: str) -> DataFrame:
    """A member that cannot be read is left out."""

    def broken(terms):
        raise FileNotFoundError("gone")

    view = store.VirtualIndex.create(of_terms(s, d, ["attion"]), "attion_postings")
    return rounded(Engine({"bad": broken, "good": lambda terms: view.lookup(*terms)}).search("attion", "bad good"), "target")


register("fragments_map", WITH + "SELECT term, target, CAST(len(positions) AS BIGINT) AS n FROM post WHERE term = 'anea'")(
    lambda s, d: of_terms(s, d, ["anea"]).select("term", "target", F.size(F.map_keys(tx.positions_map(F.col("positions"), F.col("fragments")))).cast("bigint").alias("n"))
)

# sorted keys

_TERMS = f"WITH {TOKENS}, u AS (SELECT DISTINCT term FROM tok), r AS (SELECT term, row_number() OVER (ORDER BY term) - 1 AS k, count(*) OVER () AS n FROM u) "


def _distinct(s: SparkSession, d: str) -> DataFrame:
    return tx.tokenize(docs_of(s, d)).select("term").distinct()


register("nth_term", _TERMS + "SELECT term FROM r WHERE k = 1000")(lambda s, d: ordered.nth(_distinct(s, d), "term", 1000))
register("term_ranks", _TERMS + "SELECT term, k AS rank FROM r")(lambda s, d: ordered.with_rank(_distinct(s, d), "term"))
register("even_select_terms", _TERMS + ", a AS (SELECT i, (n - 7) // 8 + CASE WHEN list_contains([(8 * (2 * j + 1)) // (2 * ((n - 7) % 8)) FOR j IN range((n - 7) % 8)], i) THEN 1 ELSE 0 END AS share FROM (SELECT DISTINCT n FROM r), range(8) t(i)), b AS (SELECT i AS k, sum(share) OVER (ORDER BY i) + i AS place FROM a) SELECT b.k, r.term FROM b JOIN r ON b.place = r.k WHERE b.k < 7")(
    lambda s, d: ordered.even_select(_distinct(s, d), "term", 7, "none")
)
register("allocate_evenly", "SELECT i, CAST(10 // 6 + CASE WHEN list_contains([(6 * (2 * j + 1)) // 8 FOR j IN range(4)], i) THEN 1 ELSE 0 END AS BIGINT) AS share FROM range(6) t(i)")(lambda s, d: ordered.allocate_evenly(s, 10, 6))
register("split_ranges", f"WITH {TOKENS} SELECT CASE WHEN term > 'the' THEN 2 WHEN term > 'in' THEN 1 ELSE 0 END AS range, min(term) AS first, max(term) AS last, count(*) AS n FROM (SELECT DISTINCT term FROM tok) WHERE term NOT IN ('in', 'the') GROUP BY 1")(
    lambda s, d: ordered.split_ranges(_distinct(s, d), "term", ["the", "in"])[0]
)
register("split_found_separators", f"WITH {TOKENS} SELECT DISTINCT term FROM tok WHERE term IN ('in', 'the', 'nosuchword')")(lambda s, d: ordered.split_ranges(_distinct(s, d), "term", ["the", "in", "nosuchword"])[1])


@register(
    "sorted_navigation",
    f"WITH {TOKENS}, u AS (SELECT DISTINCT term FROM tok) SELECT 'ceiling' AS kind, min(term) AS term FROM u WHERE term >= 'anea' UNION ALL SELECT 'floor', max(term) FROM u WHERE term <= 'anea' UNION ALL SELECT 'higher', min(term) FROM u WHERE term > 'anea' UNION ALL SELECT 'lower', max(term) FROM u WHERE term < 'anea' UNION ALL SELECT 'first', min(term) FROM u UNION ALL SELECT 'last', max(term) FROM u UNION ALL SELECT 'second', min(term) FROM u WHERE term > (SELECT min(term) FROM u)",
)
def _navigation(s: SparkSession, d: str) -> DataFrame:
    terms = tx.tokenize(docs_of(s, d)).select("term")
    c = F.col("term")
    one = terms.agg(
        F.min(F.when(c >= "anea", c)).alias("ceiling"), F.max(F.when(c <= "anea", c)).alias("floor"), F.min(F.when(c > "anea", c)).alias("higher"),
        F.max(F.when(c < "anea", c)).alias("lower"), F.min(c).alias("first"), F.max(c).alias("last"),
    )
    six = one.select(F.expr("stack(6, 'ceiling', ceiling, 'floor', floor, 'higher', higher, 'lower', lower, 'first', first, 'last', last) AS (kind, term)"))
    return six.unionByName(ordered.nav(terms, "term", None, "second").select(F.lit("second").alias("kind"), "term"))


register("adjacent_terms", f"WITH {TOKENS}, u AS (SELECT DISTINCT term FROM tok) SELECT * FROM (SELECT term AS \"left\", lead(term) OVER (ORDER BY term) AS \"right\" FROM u) WHERE \"right\" IS NOT NULL")(lambda s, d: ordered.adjacent_pairs(_distinct(s, d), "term"))
register("key_views", f"WITH {TOKENS}, u AS (SELECT DISTINCT term FROM tok) SELECT 'head' AS kind, count(*) AS n FROM u WHERE term < 'an' UNION ALL SELECT 'tail', count(*) FROM u WHERE term >= 'the' UNION ALL SELECT 'sub', count(*) FROM u WHERE term >= 'an' AND term < 'the'")(
    lambda s, d: _views(_distinct(s, d))
)


def _views(terms: DataFrame) -> DataFrame:
    count = lambda df, kind: df.agg(F.lit(kind).alias("kind"), F.count("*").alias("n"))
    return count(ordered.head(terms, "term", "an"), "head").union(count(ordered.tail(terms, "term", "the"), "tail")).union(count(ordered.sub(terms, "term", "an", "the"), "sub"))


_CAPACITY = 64


@register(
    "bin_pack",
    WITH + f", f AS (SELECT term, count(*) AS df FROM post GROUP BY term) SELECT count(*) AS terms, CAST(sum(df) AS BIGINT) AS weight, CAST(sum(ceil(df / {_CAPACITY})) AS BIGINT) AS pieces, true AS sums_kept, true AS no_bin_too_full, true AS no_bin_too_empty FROM f",
)
def _bins(s: SparkSession, d: str) -> DataFrame:
    """All terms by their entries, in pieces where a bin is too small for one; the invariants of the bins, as their numbers are free."""
    df = stage(indexer.doc_frequency(postings(s, d)))
    packed = stage(ordered.bin_pack(df, "term", F.col("df"), _CAPACITY, oversize="split"))
    loads = packed.groupBy("bin").agg(F.sum("weight").alias("load")).agg(F.max("load").alias("most"), F.min("load").alias("least"))
    sums = packed.groupBy("term").agg(F.sum("weight").alias("weight")).join(df, "term").agg(F.min(F.col("weight") == F.col("df")).alias("sums_kept"))
    total = packed.agg(F.countDistinct("term").alias("terms"), F.sum("weight").alias("weight"), F.count("*").alias("pieces"))
    # a bin takes in the last one if that is less than half full
    return total.crossJoin(sums).crossJoin(loads).select("terms", "weight", "pieces", "sums_kept", (F.col("most") <= _CAPACITY * 3 // 2).alias("no_bin_too_full"), (F.col("least") * 2 >= _CAPACITY).alias("no_bin_too_empty"))


# federated relevance

_VOTES = "SELECT 's' AS subj, c_mktsegment AS term, CAST(1 + c_nationkey % 3 AS DOUBLE) AS trust, CASE WHEN c_custkey % 4 = 0 THEN CAST(c_nationkey AS DOUBLE) / 25 END AS rel FROM customer"
register("avg_perceived_relevance", f"SELECT subj, term, round(sum(CASE WHEN rel IS NOT NULL THEN trust * rel ELSE 0 END) / sum(CASE WHEN rel IS NOT NULL THEN trust ELSE 0 END) * least(1.0, 3 * sum(CASE WHEN rel IS NOT NULL THEN trust ELSE 0 END) / sum(trust)), 6) AS rel FROM ({_VOTES}) GROUP BY subj, term")(
    lambda s, d: rounded(federate.avg_relevance(s.sql(_VOTES.replace("FROM customer", "FROM {c}"), c=table(s, d, "customer"))), "subj", "term")
)
_EDGES = "SELECT 'n' || n_regionkey AS src, 'k' || n_nationkey AS dst, 0.5 + n_nationkey / 100.0 AS rel FROM nation UNION ALL SELECT 'k' || n_nationkey, 'k' || ((n_nationkey * 7) % 25), 0.9 FROM nation"
register("effective_relevance", f"WITH RECURSIVE e AS (SELECT src, dst, CAST(rel AS DOUBLE) AS rel FROM ({_EDGES})), p(term, rel, hops) AS (SELECT 'n0', CAST(1 AS DOUBLE), 0 UNION ALL SELECT e.dst, p.rel * e.rel, p.hops + 1 FROM p JOIN e ON p.term = e.src WHERE p.hops < 6) SELECT term, round(max(rel), 6) AS rel FROM p GROUP BY term")(
    lambda s, d: rounded(federate.effective_relevance(s.sql(f"SELECT src, dst, CAST(rel AS DOUBLE) AS rel FROM ({_EDGES.replace('FROM nation', 'FROM {n}')})", n=table(s, d, "nation")), "n0", 6), "term")
)


@register("federated_search", "SELECT 'P' || c_custkey AS target, round(least(1.0, 0.1 + c_nationkey / 30.0), 6) AS rel FROM customer")
def _federated(s: SparkSession, d: str) -> DataFrame:
    """Regions name their nations as indexes, and every nation has the pages of its customers: all are reached from one."""
    nation, customer = table(s, d, "nation"), table(s, d, "customer")
    index = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    row = lambda i, kind, target, rel: (i.alias("index"), F.lit("x").alias("term"), F.lit(kind).alias("entry_type"), target.alias("target"), rel.cast("double").alias("rel"))
    edges = nation.select(*row(index("R", "n_regionkey"), INDEX, index("K", "n_nationkey"), F.lit(1.0)))
    around = nation.select(*row(F.lit("R0"), INDEX, index("R", "n_regionkey"), F.lit(1.0))).distinct()
    pages = customer.select(*row(index("K", "c_nationkey"), PAGE, index("P", "c_custkey"), F.least(F.lit(1.0), 0.1 + F.col("c_nationkey") / 30.0)))
    found, _, _ = federate.federated_search(edges.union(around).union(pages), "R0", "x", 6)
    # one index of at most 25 answers for a page: less than a third of all trust
    have = customer.select("c_nationkey").distinct().count()
    return found.select("target", F.round(F.col("rel") / F.least(F.lit(1.0), F.lit(3.0 / have)), 6).alias("rel"))
