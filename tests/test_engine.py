"""The index engine: text, algebra, search language, order, storage, ingest, codecs."""

import math
import random

import pytest
from pyspark.sql import functions as F

from inkspar.functions import text as tx
from inkspar.operators import algebra, federate, indexer, merge, ordered, present
from inkspar.plans.query import And, Engine, Not, Or, Phrase, QueryError, Term, parse
from inkspar.sources import codecs, store
from inkspar.sources.xml_index import XmlIndex
from inkspar.streaming.ingest import Ingest

ENTRY = "term string, entry_type tinyint, target string, rel double, title string, positions array<int>"


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_strict_tokens():
    assert list(tx.strict_tokens("Don't stop' 12 345 67")) == ["don't", "stop", "345", "67"]
    assert list(tx.strict_tokens("日本語字", pairs=True)) == ["日", "日本", "本", "本語", "語", "語字", "字"]
    assert list(tx.strict_tokens("ab日本")) == ["ab", "日", "本"]
    assert list(tx.strict_tokens("")) == []


def test_tokenize_strict_on_spark(spark):
    df = spark.createDataFrame([(1, "It's 12 日本"), (2, None)], "doc_id long, text string")
    assert [r["term"] for r in tx.tokenize_strict(df).orderBy("pos").collect()][0] == "it's"


@pytest.mark.parametrize("word,stop", [("the", True), ("and", True), ("that", True), ("have", True), ("for", True), ("ab", True), ("who", False), ("日", False), ("3日", False)])
def test_stop_words(spark, word, stop):
    assert tx.is_stop_word_py(word) is stop
    assert spark.range(1).select(tx.is_stop_word(F.lit(word))).first()[0] is stop


def test_postings_without_and_with_a_term_filter_agree(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, ""), (3, None), (4, "b Straße b c")], "doc_id long, text string")
    whole = indexer.build_postings(docs)
    assert rows(whole, "term", "target", "tf") == [("a", "1", 2), ("b", "1", 1), ("b", "4", 2), ("c", "4", 1), ("strasse", "4", 1)]
    some = indexer.postings_of_terms(docs, ["b"])
    cols = ("term", "target", "tf", "rel", "positions")
    assert rows(some, *cols) == rows(whole.where("term = 'b'"), *cols)


def test_algebra_against_sets(spark):
    rng = random.Random(4)
    sets = [{f"p{rng.randrange(30)}": rng.random() for _ in range(18)} for _ in range(3)]
    dfs = [spark.createDataFrame([(f"t{k}", 2, t, r, None, [1]) for t, r in s.items()], "subj string, entry_type tinyint, target string, rel double, title string, positions array<int>") for k, s in enumerate(sets)]
    common = set(sets[0]) & set(sets[1]) & set(sets[2])
    got = {r["target"]: r["rel"] for r in algebra.intersect(*dfs).collect()}
    assert got.keys() == common and all(math.isclose(v, sum(s[t] for s in sets) / 3) for t, v in got.items())
    assert {r["target"] for r in algebra.exclude(dfs[0], dfs[1]).collect()} == set(sets[0]) - set(sets[1])
    merged = {r["target"]: r["rel"] for r in algebra.union(dfs[0], dfs[1]).collect()}
    assert merged.keys() == set(sets[0]) | set(sets[1])
    for t, v in merged.items():
        both = [s[t] for s in sets[:2] if t in s]
        assert math.isclose(v, sum(both) / len(both))
    assert algebra.union(dfs[0], dfs[1], mode="observed").count() == sum(len({s[t] for s in sets[:2] if t in s}) for t in merged)
    with pytest.raises(ValueError):
        algebra.intersect(dfs[0])


@pytest.mark.parametrize("a,b,want", [(0.4, 0.0, 0.4), (0.4, 0.2, 0.3), (0.0, 0.0, 0.0)])
def test_merged_relevance(spark, a, b, want):
    assert math.isclose(spark.range(1).select(algebra.merged_rel(F.lit(a), F.lit(b))).first()[0], want)


@pytest.mark.parametrize(
    "query,tree",
    [
        ("Foo", Term("foo")),
        ("the", None),
        ("foo bar", And((Term("foo"), Term("bar")))),
        ("foo the bar", And((Term("foo"), Term("bar")))),
        ("foo or bar", Or((Term("foo"), Term("bar")))),
        ("foo bar or baz", And((Term("foo"), Or((Term("bar"), Term("baz")))))),
        ("foo or the", None),
        ("foo -bar", Not(Term("foo"), Term("bar"))),
        ("foo not bar", Not(Term("foo"), Term("bar"))),
        ("foo notebook", And((Term("foo"), Term("notebook")))),
        ("-foo", None),
        ('"jesus of nazareth"', Phrase((("jesus", 0), ("nazareth", 2)))),
        ('"the who"', None),
        ("free-software", Phrase((("free", 0), ("software", 1)))),
        ('foo -"free message system"', Not(Term("foo"), Phrase((("free", 0), ("message", 1), ("system", 2))))),
        ('foo or "free network"', Or((Term("foo"), Phrase((("free", 0), ("network", 1)))))),
        ("日本", And((Term("日"), Term("本")))),
    ],
)
def test_parse(query, tree):
    assert parse(query) == tree


def test_parse_errors():
    for bad in ("", "  ", "foo or", "foo not"):
        with pytest.raises(QueryError):
            parse(bad)
    assert parse("aaa bbb -ccc") == Not(And((Term("aaa"), Term("bbb"))), Term("ccc"))


def test_search(spark):
    docs = spark.createDataFrame([(1, "alpha beta gamma"), (2, "beta alpha"), (3, "alpha the beta"), (4, "gamma")], "doc_id long, text string")
    e = Engine({"x": indexer.build_postings(docs), "y": indexer.build_postings(docs.where("doc_id = 4"))})
    find = lambda q, n="x": [r["target"] for r in e.search(q, n).orderBy("target").collect()]
    assert find("alpha beta") == ["1", "2", "3"]
    assert find('"alpha beta"') == ["1"]
    assert find('"alpha the beta"') == ["3"]
    assert find("alpha -gamma") == ["2", "3"]
    assert find("gamma", "x;y") == ["1", "4"]
    assert find("nothing") == []
    assert e.search("the", "x") is None


def test_idf(spark):
    v = spark.range(1).select(indexer.idf_factor(F.lit(100), F.lit(10)) * 0.5, indexer.idf_factor(F.lit(5), F.lit(10)) * 0.5, indexer.idf_factor(F.lit(0), F.lit(1))).first()
    assert math.isclose(v[0], 1.1512925464970228) and v[1] == 0.5 and v[2] == 1.0


@pytest.mark.parametrize("total,num,want", [(10, 5, [2] * 5), (6, 4, [1, 2, 1, 2]), (10, 6, [2, 1, 2, 2, 1, 2])])
def test_allocate(spark, total, num, want):
    assert [r["share"] for r in ordered.allocate_evenly(spark, total, num).orderBy("i").collect()] == want


@pytest.mark.parametrize("inc,want", [("none", [2, 5]), ("left", [0, 4]), ("right", [3, 7]), ("both", [0, 7])])
def test_even_select(spark, inc, want):
    df = spark.createDataFrame([(k,) for k in range(8)], "k int").withColumnRenamed("k", "x")
    assert [r["x"] for r in ordered.even_select(df, "x", 2, inc).orderBy("k").collect()] == want


@pytest.mark.parametrize(
    "keys,ranges,found",
    [
        (range(1, 16), [(1, 7), (9, 15)], [8]),
        ([19, 24, 25], [(19, 19), (25, 25)], [24]),
        ([17, 19, 21], [(17, 21)], []),
        ([16, 24], [], [16, 24]),
        ([4, 8, 12, 16, 20, 24, 28, 32, 36], [(4, 4), (12, 12), (20, 20), (28, 28), (36, 36)], [8, 16, 24, 32]),
    ],
)
def test_split(spark, keys, ranges, found):
    df = spark.createDataFrame([(k,) for k in keys], "x int")
    got, seps = ordered.split_ranges(df, "x", [8, 16, 24, 32])
    assert [(r["first"], r["last"]) for r in got.orderBy("range").collect()] == ranges
    assert sorted(r[0] for r in seps.collect()) == found


def test_navigation_and_ranks(spark):
    df = spark.createDataFrame([(k,) for k in (5, 1, 9, 3)], "x int")
    want = {"ceiling": 5, "floor": 3, "higher": 5, "lower": 3, "first": 1, "last": 9, "second": 3}
    assert {k: ordered.nav(df, "x", 4, k).first()[0] for k in want} == want
    assert ordered.nth(df, "x", 2).first()["x"] == 5
    assert rows(ordered.adjacent_pairs(df, "x"), "left", "right") == [(1, 3), (3, 5), (5, 9)]
    assert rows(ordered.key_range(df, "x", 1, 9), "x") == [(3,), (5,)]


def test_bins():
    rng = random.Random(1)
    items = [(k, rng.randint(1, 15)) for k in range(300)]
    for no_tiny in (True, False):
        packed = ordered.BestFit(64, no_tiny).pack(items)
        assert sorted((k, w) for k, w, _ in packed) == items
        loads = {}
        for _, w, b in packed:
            loads[b] = loads.get(b, 0) + w
        assert sum(2 * v < 64 for v in loads.values()) <= (0 if no_tiny else 1)
        assert max(loads.values()) <= (96 if no_tiny else 64)


def test_merge_is_idempotent(spark):
    old = spark.createDataFrame([("a", 2, "p", 0.1, None, [1]), ("b", 2, "q", 0.2, None, None)], ENTRY)
    new = spark.createDataFrame([("a", 2, "p", 0.3, "t", [2]), ("a", 2, "p", 0.1, "u", [9])], ENTRY)
    once = merge.upsert(old, new)
    assert once.count() == 3 and merge.upsert(once, new).count() == 3
    assert rows(merge.upsert(old, new.limit(1), latest_wins=True), "term", "rel") == [("a", 0.3), ("b", 0.2)]
    assert rows(merge.delete(once, new), "term") == [("b",)]
    assert merge.merge_metadata({"total_pages": -1}, {"total_pages": 5}) == {"total_pages": 5}
    assert merge.FlushPolicy().due(10_001, 0, 0, 0) and not merge.FlushPolicy().due(10_000, 16, 10_000, 24)


def test_store_prunes_and_counts_editions(spark, tmp_path):
    docs = spark.createDataFrame([(k, f"word{k % 7} common") for k in range(50)], "doc_id long, text string")
    index = store.StoredIndex(spark, str(tmp_path / "i"))
    assert index.latest() == -1
    index.write(indexer.build_postings(docs.where("doc_id < 30")))
    assert index.put(indexer.build_postings(docs.where("doc_id >= 20"))) == 1
    assert index.lookup("common").count() == 50
    plan = index.lookup("word3")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(shard" in plan or "PartitionFilters: [shard" in plan
    assert "EqualTo(term,word3)" in plan or "In(term" in plan
    assert [r[0] for r in index.keys().collect()] == ["common", *[f"word{k}" for k in range(7)]]
    registry = store.Registry(spark, str(tmp_path / "r"))
    registry.add("mine", index.path)
    assert store.open_index(spark, "bookmark:mine", registry).lookup("word1").count() == len(range(1, 50, 7))
    registry.remove("mine")
    assert registry.names() == []
    assert [store.index_type(n) for n in ("a/index.xml", "x.yml", "text/xml", "dir")] == ["xml", "yaml", "xml", "parquet"]


def test_route():
    assert store.route("x", ["0", "4", "8", "c"]) in "048c"
    from hashlib import md5

    for w in ("a", "b", "abc", "zz"):
        h = md5(w.encode()).hexdigest()
        assert store.route(w, ["0", "4", "8", "c"]) == max(k for k in "048c" if k <= h)


def test_streamed_batches_equal_one(spark, tmp_path):
    from inkspar.schema import POSTINGS

    docs = spark.createDataFrame([(k, f"w{k % 5} x y{k}") for k in range(40)], "doc_id long, text string")
    whole = indexer.build_postings(docs).select(*POSTINGS.fieldNames())
    for part in range(4):
        whole.where(F.pmod(F.col("target").cast("int"), F.lit(4)) == part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    ingest = Ingest(spark, str(tmp_path / "index"), merge.FlushPolicy(max_updates=1))
    ingest.start(str(tmp_path / "in"), str(tmp_path / "log"), available_now=True, max_files=1).awaitTermination()
    assert rows(ingest.snapshot(), "term", "target") == rows(whole, "term", "target")
    ingest.compact()
    assert rows(ingest.snapshot(), "term", "target") == rows(whole, "term", "target")


def test_ingest_of_a_backlog_keeps_no_old_rows_on_disk(spark, tmp_path, monkeypatch):
    from inkspar.schema import POSTINGS

    monkeypatch.setattr(store, "PASS", 1)
    monkeypatch.setattr(store, "HOT", 2)
    docs = spark.createDataFrame([(k, f"w{k % 5} x y{k} sté{k % 3}") for k in range(40)], "doc_id long, text string")
    whole = indexer.build_postings(docs).select(*POSTINGS.fieldNames()).cache()
    for part in range(3):  # they overlap
        whole.where(F.pmod(F.col("target").cast("int"), F.lit(3)) != part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    whole.limit(1).withColumn("title", F.lit("later")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    told = []
    ingest = Ingest(spark, str(tmp_path / "index"), merge.FlushPolicy(max_updates=0), lambda *e: told.append(e))
    ingest.start(str(tmp_path / "in"), str(tmp_path / "log"), available_now=True, max_files=1, clean=True).awaitTermination()
    assert [e[0] for e in told] == ["merged", "published"] * 4 and ingest.index.editions() == [2, 3]
    assert sorted(store.children(spark, f"{ingest.index_path}/postings")) == ["edition=2", "edition=3"] and not store.children(spark, ingest.deltas)
    for found in (ingest.snapshot(), ingest.index.postings()):
        assert rows(found, "term", "target", "tf") == rows(whole, "term", "target", "tf")
    assert rows(ingest.index.lookup("x"), "target") == rows(whole.where("term = 'x'"), "target")
    assert ingest.index.meta()["extra"]["largest"] >= "40"


def test_limits_on_terms_wait_until_the_deltas_hold_as_many_rows_as_the_index(spark, tmp_path):
    from inkspar.schema import POSTINGS

    docs = spark.createDataFrame([(k, f"w{k % 5} x y{k}") for k in range(80)], "doc_id long, text string")
    whole = indexer.build_postings(docs).select(*POSTINGS.fieldNames())
    ingest = Ingest(spark, str(tmp_path / "index"), merge.FlushPolicy(max_terms=1))
    published = []
    for part in range(8):
        name = ingest.merge_batch(whole.where(F.pmod(F.col("target").cast("int"), F.lit(8)) == part).coalesce(1), part)
        if ingest.due(name):
            ingest.compact()
            published.append(part)
        assert ingest.snapshot().count() == 30 * (part + 1)
    assert published == [0, 1, 3, 7]
    assert rows(ingest.snapshot(), "term", "target") == rows(whole, "term", "target")


def test_codecs(spark, tmp_path):
    entries = [
        {"term": "test", "entry_type": 1, "target": "lol", "title": None, "rel": 0.5, "positions": None, "fragments": None},
        {"term": "test", "entry_type": 0, "target": "CHK@x", "title": None, "rel": 0.25, "positions": None, "fragments": None},
        {"term": "lol", "entry_type": 2, "target": "CHK@y", "title": "title", "rel": 0.75, "positions": [1, 4], "fragments": [(1, "ab"), (4, None)]},
        {"term": "ü", "entry_type": 2, "target": "p", "title": None, "rel": 0.5, "positions": [7], "fragments": None},
    ]
    data = b"".join(map(codecs.encode_entry, entries))
    assert list(codecs.decode_entries(data)) == entries
    assert list(codecs.from_yaml(codecs.to_yaml(entries))) == entries
    meta, back = codecs.decode_buffer(codecs.encode_buffer({"name": "n", "total_pages": 3}, entries))
    assert meta == {"name": "n", "total_pages": 3} and list(back) == entries
    with pytest.raises(codecs.CodecError):
        list(codecs.decode_entries(data[:-1]))
    (tmp_path / "b.bin").write_bytes(data)
    assert codecs.read_binary(spark, str(tmp_path / "b.bin")).count() == 4
    (tmp_path / "b.yml").write_text(codecs.to_yaml(entries))
    assert codecs.read_yaml(spark, str(tmp_path / "b.yml")).count() == 4


def test_xml_index(spark, tmp_path):
    (tmp_path / "index.xml").write_text("<main_index><header><title>T</title><owner>O</owner></header><keywords><subIndex key='0'/><subIndex key='8'/></keywords></main_index>")
    word = "<word v='007' fileCount='2'><file id='1'>3,x,5</file><file id='2'>1</file></word>"
    files = "<files totalFileCount='10'><file id='1' key='k1' title='one' wordCount='4'/><file id='2' key='k2' title='two' wordCount='5'/></files>"
    for k in "08":
        (tmp_path / f"index_{k}.xml").write_text(f"<sub_index><keywords>{word}</keywords>{files}</sub_index>")
    x = XmlIndex(spark, str(tmp_path))
    assert x.root() == ({"title": "T", "owner": "O", "email": None}, ["0", "8"])
    got = {r["target"]: (r["title"], r["positions"], r["rel"]) for r in x.lookup("007").collect()}
    assert got["k1"][:2] == ("one", [3, 5]) and math.isclose(got["k1"][2], 2 / 4 * math.log(5))
    assert got["k2"][:2] == ("two", [1]) and math.isclose(got["k2"][2], 1 / 5 * math.log(5))


def test_presentation(spark):
    df = spark.createDataFrame([("s", 2, "u/a", 0.5, " ", [1], "x", 1), ("s", 2, "u/b", 0.9, "B", [1], "x", 2), ("s", 2, "u/c", 0.1, "C", [1], "x", 2), ("s", 2, "u/d", 0.0, None, [1], "y", 1)], "subj string, entry_type tinyint, target string, rel double, title string, positions array<int>, site string, edition long")
    assert rows(present.newest_edition(df), "target") == [("u/b",), ("u/c",), ("u/d",)]
    assert rows(present.older_versions(df), "site", "older") == [("x", 1), ("y", 0)]
    assert [r["target"] for r in present.present(df).collect()] == ["u/b", "u/c", "u/d"]
    assert "Found 4 results" in present.to_html(df) and "unknown" in present.to_html(df)


def test_federation(spark):
    votes = spark.createDataFrame([("s", "t", 1.0, 0.5 if k < 2 else None) for k in range(9)], "subj string, term string, trust double, rel double")
    assert math.isclose(federate.avg_relevance(votes).first()["rel"], 1 / 3)
    edges = spark.createDataFrame([("r", "a", 0.5), ("a", "b", 0.5), ("r", "b", 0.2), ("b", "r", 2.0)], "src string, dst string, rel double")
    assert rows(federate.effective_relevance(edges, "r"), "term", "rel") == [("a", 0.5), ("b", 0.25), ("r", 1.0)]


def test_entry_is_registered(spark):
    import __spark_entry__ as e

    queries = e.queries()
    assert len(queries) > 60 and set(e.oracle_sql()) <= set(queries)
    assert e.entry(spark).count() == 11
