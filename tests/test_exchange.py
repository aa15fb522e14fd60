"""Codecs, stored indexes, ingest with metadata, listeners, bins and federated search."""

import math
import random
from collections import defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from inkspar.operators import federate, indexer, merge, ordered, present
from inkspar.plans.query import Engine, QueryError, parse
from inkspar.schema import INDEX, PAGE, POSTINGS, TERM
from inkspar.sources import codecs, store, xml_index, yaml_text
from inkspar.sources.yaml_text import Tagged, Translator
from inkspar.streaming.ingest import Broken, Ingest, push
from inkspar.streaming.listen import Progress, Subscription

ENTRIES = [
    {"term": "test", "entry_type": TERM, "target": "lol", "title": None, "rel": 0.5, "positions": None, "fragments": None},
    {"term": "true", "entry_type": INDEX, "target": "CHK@x, y: #z", "title": None, "rel": 0.25, "positions": None, "fragments": None},
    {"term": "lol", "entry_type": PAGE, "target": "CHK@y", "title": "a 'title' \"with\"\nlines", "rel": 0.75, "positions": [1, 4], "fragments": [(1, "ab"), (4, None)]},
    {"term": "007", "entry_type": PAGE, "target": "p", "title": "", "rel": 0.5, "positions": [7], "fragments": None},
]


def postings(spark, rows):
    """Rows term, target, rel as postings."""
    return spark.createDataFrame([(t, PAGE, p, None, r, 1, [0], None, None, None) for t, p, r in rows], POSTINGS)


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_yaml_round_trip():
    text = codecs.to_yaml(ENTRIES)
    assert text.startswith("- !TermTermEntry\n  subj: test\n") and list(codecs.from_yaml(text)) == ENTRIES
    value = {"a": [1, -2.5, 1e30, None, True, "no: t", "~", "- x", "", "7", "ü"], "b c": {"d": [], "e": {}, "f": [[1, [2]], {"g": [{"h": "i"}]}]}, "t": Tagged("!Some", {"x": Tagged("!Other", 5)})}
    assert yaml_text.load(yaml_text.dump(value)) == value
    assert yaml_text.load("") is None and list(codecs.from_yaml("")) == []


def test_yaml_of_other_writers():
    text = """
--- # an index
- !TermPageEntry {subj: lol, rel: 0.75, page: !FreenetURI 'CHK@y',
    title: "t", positions: {1: ab, 4: null}}
- !TermTermEntry
  rel: 0.5
  subj: 'it''s'
  term: lol   # why
-
  !TermIndexEntry
  index: !FreenetURI 'USK@a/b/3/'
  subj: test
  rel: 1
""".replace("-\n  !TermIndexEntry\n", "- !TermIndexEntry\n")
    got = list(codecs.from_yaml(text))
    assert [(e["term"], e["target"], e["rel"]) for e in got] == [("lol", "CHK@y", 0.75), ("it's", "lol", 0.5), ("test", "USK@a/b/3/", 1.0)]
    assert got[0]["positions"] == [1, 4] and got[0]["fragments"] == [(1, "ab")]
    assert yaml_text.load("a:\n- 1\n- b: 2\n  c: 3\nd: |\n  one\n  two\n") == {"a": [1, {"b": 2, "c": 3}], "d": "one\ntwo\n"}
    for bad in ("- !TermPageEntry {subj: x}", "- 5", "- !TermPageEntry [", "a: 1\na: 2", "- !TermPageEntry {subj: x, rel: 1, page: null}"):
        with pytest.raises(codecs.CodecError):
            list(codecs.from_yaml(bad))


def test_yaml_translators():
    class Pair:
        def __init__(self, a, b):
            self.a, self.b = a, b

        def __eq__(self, other):
            return (self.a, self.b) == (other.a, other.b)

    both = [Translator("!Pair", Pair, lambda p: [p.a, p.b], lambda v: Pair(*v))]
    value = {"k1": Pair("x", 5), "k2": [Pair("%l", None), Pair(True, [Pair(1, 2)])]}
    assert yaml_text.load(yaml_text.dump(value, both), both) == value


def test_push_buffers(spark):
    df = codecs.decode_rows(spark.createDataFrame([(codecs.encode_entry(e),) for e in ENTRIES], "data binary"))
    buffers = codecs.encode_buffers(df.coalesce(1), {"name": "n", "total_pages": 3}, 3)
    assert buffers.count() == 2 and rows(codecs.decode_buffers(buffers), "term") == sorted((e["term"],) for e in ENTRIES)
    assert rows(codecs.buffer_headers(buffers), "name", "total_pages") == [("n", 3)] * 2
    assert codecs.buffer_headers(codecs.encode_buffers(df.coalesce(1))).first()["total_pages"] == -1


def test_ingest_of_buffers_merges_metadata(spark, tmp_path):
    told = []
    ingest = Ingest(spark, str(tmp_path / "i"), merge.FlushPolicy(max_updates=1), lambda *e: told.append(e))
    listener = Progress()
    spark.streams.addListener(listener)
    source, log = str(tmp_path / "in"), str(tmp_path / "log")
    for name, pages, some in (("one", 5, [("a", "p", 0.5)]), ("two", 7, [("a", "q", 0.25), ("b", "p", 0.5)]), (None, -1, [("a", "p", 0.5)])):
        push(codecs.encode_buffers(postings(spark, some).coalesce(1), {"name": name, "total_pages": pages}), source)
        ingest.start(source, log, available_now=True, buffers=True).awaitTermination()
    assert rows(ingest.snapshot(), "term", "target") == [("a", "p"), ("a", "q"), ("b", "p")]
    assert ingest.index.latest() == 0 and ingest.index.meta()["name"] == "two" and ingest.index.meta()["total_pages"] == 12
    assert ingest.compact() == 1 and ingest.index.meta()["total_pages"] == 12 and ingest.pending_names() == []
    assert [e[0] for e in told] == ["merged", "merged", "published", "merged", "published"]
    spark.streams.removeListener(listener)
    assert {"started", "terminated"} <= {e["event"] for e in listener.events} or not listener.events


def test_pages_of_a_push_in_many_buffers_count_once(spark, tmp_path):
    source = str(tmp_path / "in")
    some = postings(spark, [(f"t{k}", "p", 0.5) for k in range(10)])
    for _ in range(2):
        push(codecs.encode_buffers(some.repartition(3), {"name": "n", "total_pages": 3}, 2), source)
    both = codecs.encode_buffers(some, {"total_pages": 5}, 4).unionByName(codecs.encode_buffers(some, {"total_pages": 7}, 4))
    push(both, source)
    push(codecs.encode_buffers(some.limit(1), {"total_pages": 100}).select("data"), source)
    ingest = Ingest(spark, str(tmp_path / "i"))
    ingest.start(source, str(tmp_path / "log"), available_now=True, buffers=True).awaitTermination()
    ingest.compact()
    assert ingest.index.meta()["total_pages"] == 3 + 3 + 5 + 7 + 100 and ingest.index.meta()["name"] == "n"
    assert ingest.snapshot().count() == 10


def test_ingest_recovers(spark, tmp_path):
    ingest = Ingest(spark, str(tmp_path / "i"))
    some = postings(spark, [("a", "p", 0.5), ("b", "q", 0.5)])
    ingest.merge_batch(some, 0, header={"total_pages": 2})
    # the folder of the edition is there, its metadata are not
    some.limit(1).withColumn("shard", F.lit("z")).write.partitionBy("shard").parquet(str(tmp_path / "i/postings/edition=0"))
    assert ingest.compact() == 0 and ingest.index.postings().count() == 2
    # an edition that holds a delta which a failure did not delete
    ingest.merge_batch(some, 1, header={"total_pages": 9})
    held = ingest.index.meta()
    ingest.index.write(ingest.snapshot(), held | {"extra": {"merged": "1"}, "total_pages": 11})
    assert ingest.pending_names() == [] and ingest.compact() == 2 and ingest.index.meta()["total_pages"] == 11
    assert ingest.hours_since(datetime.now() + timedelta(hours=25)) > 24
    ingest.merge_batch(some, 2)
    assert not ingest.due("2")
    ingest.policy = merge.FlushPolicy(max_hours=-1.0)
    assert ingest.due("2")


def test_ingest_stops_at_an_error(spark, tmp_path):
    def fail(what, of):
        if what == "merged":
            raise RuntimeError("no")

    ingest = Ingest(spark, str(tmp_path / "i"), on_event=fail)
    postings(spark, [("a", "p", 0.5)]).write.parquet(str(tmp_path / "in"))
    with pytest.raises(Exception):
        ingest.start(str(tmp_path / "in"), str(tmp_path / "log"), available_now=True).awaitTermination()
    with pytest.raises(Broken):
        ingest.start(str(tmp_path / "in"), str(tmp_path / "log"), available_now=True)
    ingest.on_event = None
    ingest.repair()
    ingest.start(str(tmp_path / "in"), str(tmp_path / "log"), available_now=True).awaitTermination()
    assert ingest.snapshot().count() == 1


def test_subscription(spark, tmp_path):
    index, seen = store.StoredIndex(spark, str(tmp_path / "i")), []
    registry = store.Registry(spark, str(tmp_path / "r"))
    feed = Subscription(index, seen.append, registry=registry, alias="mine")
    assert not feed.poll()
    index.write(postings(spark, [("a", "p", 0.5)]))
    index.put(postings(spark, [("b", "p", 0.5)]))
    assert feed.poll() and not feed.poll() and seen == [1]
    assert registry.table().first()["edition"] == 1 and store.open_index(spark, "bookmark:mine", registry).lookup("b").count() == 1


def test_index_types_and_views(spark, tmp_path):
    (tmp_path / "y").mkdir()
    (tmp_path / "y/a.yml").write_text(codecs.to_yaml(ENTRIES))
    assert store.index_type(str(tmp_path / "y"), spark) == "yaml" and store.open_index(spark, str(tmp_path / "y")).count() == 4
    made = xml_index.write_xml(indexer.build_postings(spark.createDataFrame([(1, "x <y> & x"), (2, "x")], "doc_id long, text string")), str(tmp_path / "x"), ["0", "8"], 2, "t <&>")
    assert store.index_type(str(tmp_path / "x"), spark) == "xml" and made.root()[0]["title"] == "t <&>"
    assert rows(store.open_index(spark, str(tmp_path / "x")).lookup("x", "y"), "term", "target", "tf") == [("x", "1", 2), ("x", "2", 1), ("y", "1", 1)]
    store.VirtualIndex.create(postings(spark, [("a", "p", 0.5)]), "some_view")
    assert store.open_index(spark, "view:some_view").lookup("a").count() == 1
    with pytest.raises(FileNotFoundError):
        store.open_index(spark, str(tmp_path / "gone"))


def test_xml_files_with_few_attributes(spark, tmp_path):
    (tmp_path / "f.xml").write_text("<files totalFileCount='3'><file id='1' key='k1' wordCount='4'/><file key='k2' wordCount='5'/><file id='3' key='k3' title='t'/></files>")
    assert sorted(((r["page"], r["title"], r["word_count"]) for r in xml_index.XmlIndex(spark, str(tmp_path)).files("f.xml").collect())) == [("k1", None, 4), ("k2", None, None), ("k3", "t", None)]


def test_addresses(spark, tmp_path):
    index = store.StoredIndex(spark, str(tmp_path / "i"))
    index.write(postings(spark, [("a", "p", 0.5)]))
    assert index.uri("http://h/a").count() == 0
    index.put_uris(spark.createDataFrame([("http://h/a", "old"), ("http://h/b", "b")], "uri string, title string"))
    index.put_uris(spark.createDataFrame([("http://h/a", "new")], "uri string, title string"))
    assert index.uri("http://h/a").first()["title"] == "new" and len({r["uri_key"] for r in index.uris().collect()}) == 1
    index.remove(postings(spark, [("a", "p", 0.1)]))
    assert index.postings().count() == 0 and index.uris().count() == 2
    index.remove_uris(index.uris().where("title = 'b'"))
    assert rows(index.uris(), "uri") == [("http://h/a",)] and index.latest() == 4


def brute_loads(packed):
    loads = defaultdict(int)
    for r in packed:
        loads[r["bin"]] += r["weight"]
    return loads


@pytest.mark.parametrize("even", [False, True])
@pytest.mark.parametrize("no_tiny", [False, True])
def test_bins_over_tasks(spark, monkeypatch, even, no_tiny):
    monkeypatch.setattr(ordered, "BINS_PER_TASK", 6)
    rng = random.Random(2)
    items = [(f"k{k}", rng.randint(1, 150)) for k in range(400)]
    df = spark.createDataFrame(items, "k string, w long")
    packed = ordered.bin_pack(df.repartition(5), "k", F.col("w") + 0, 64, no_tiny, "split", even=even).collect()
    sums = defaultdict(int)
    for r in packed:
        sums[r["k"]] += r["weight"]
    assert dict(sums) == dict(items)
    loads = brute_loads(packed)
    assert max(loads.values()) <= (96 if no_tiny else 64) and sum(2 * v < 64 for v in loads.values()) <= (0 if no_tiny else 1)
    assert len(loads) <= math.ceil(sum(w for _, w in items) / 64 * 1.25) + 1
    again = ordered.bin_pack(df.repartition(2), "k", "w", 64, no_tiny, "split", even=even).collect()
    assert {(r["k"], r["piece"]): r["bin"] for r in packed} == {(r["k"], r["piece"]): r["bin"] for r in again}
    with pytest.raises(ValueError):
        ordered.bin_pack(df, "k", "w", 64)


def test_bins_that_are_there_are_filled_first(spark):
    old = spark.createDataFrame([("a", 0, 40, 7), ("b", 0, 60, 9)], "k string, piece int, weight long, bin long")
    got = {r["k"]: r["bin"] for r in ordered.bin_pack(spark.createDataFrame([("c", 24), ("d", 4), ("e", 50)], "k string, w long"), "k", "w", 64, bins=old).collect()}
    assert got["c"] == 7 and got["d"] == 9 and got["e"] > 9
    assert ordered.bin_pack(spark.createDataFrame([], "k string, w long"), "k", "w", 64).count() == 0


def test_key_views(spark):
    df = spark.createDataFrame([(k,) for k in range(8)], "x int")
    assert rows(ordered.head(df, "x", 3), "x") == [(0,), (1,), (2,)] and rows(ordered.tail(df, "x", 6), "x") == [(6,), (7,)] and rows(ordered.sub(df, "x", 2, 4), "x") == [(2,), (3,)]
    assert rows(ordered.key_range(df, "x", 2, 4, True, True), "x") == [(2,), (3,), (4,)]


def test_federated_search(spark):
    entries = [
        ("r", "t", INDEX, "i1", 0.5), ("r", "t", INDEX, "i2", 0.9), ("i1", "t", INDEX, "i2", 1.0), ("i2", "t", TERM, "u", 0.5), ("r", "t", PAGE, "p", 0.4), ("i2", "t", PAGE, "p", 0.8),
        ("i1", "u", PAGE, "q", 1.0), ("i2", "u", INDEX, "i3", 3.0), ("i3", "t", PAGE, "z", 0.6), ("i9", "t", PAGE, "far", 1.0),
    ]
    df = spark.createDataFrame(entries, "index string, term string, entry_type int, target string, rel double")
    pages, indexes, terms = federate.federated_search(df, "r", "t", 6)
    assert {r["index"]: (round(r["trust"], 6), r["hops"]) for r in indexes.collect()} == {"r": (1.0, 0), "i1": (0.5, 1), "i2": (0.9, 1), "i3": (0.9, 3)}
    assert {r["term"]: r["rel"] for r in terms.collect()} == {"t": 1.0, "u": 0.5}
    got = {r["target"]: (r["rel"], r["parents"]) for r in pages.collect()}
    trust = 1.0 + 0.9 + 0.9  # of the indexes with pages for t
    assert set(got) == {"p", "q", "z"} and got["p"][1] == ["i2", "r"] and math.isclose(got["p"][0], (0.4 + 0.9 * 0.8) / 1.9)
    assert math.isclose(got["z"][0], 0.6 * min(1, 3 * 0.9 / trust)) and math.isclose(got["q"][0], 0.5)
    done = {r["index"]: (r["done"], r["pending"]) for r in indexes.collect()}
    assert done == {"r": (1, 1), "i1": (2, 0), "i2": (2, 0), "i3": (1, 1)}
    votes = spark.createDataFrame([("t", "p", 0.5), ("t", "p", 0.25), ("t", "p", 0.5), ("t", "q", 1.0)], "term string, parent string, rel double")
    assert federate.results_with_parents(votes).first()["parents"] == {"p": [0.25, 0.5], "q": [1.0]}
    states = spark.createDataFrame([("t", 0.5, 2), ("t", 0.9, 3)], "term string, trust double, hops int")
    assert rows(federate.frontier_terms(states), "term", "trust", "min_hops") == [("t", 0.9, 2)]


def test_members_that_fail_are_left_out(spark):
    def broken(terms):
        raise FileNotFoundError("gone")

    docs = spark.createDataFrame([(1, "alpha beta")], "doc_id long, text string")
    good = indexer.build_postings(docs)
    engine = Engine({"bad": broken, "good": good, "lacks": good}, on_missing="error")
    assert engine.search("alpha", "bad good").count() == 1 and engine.search("alpha", "bad good") is engine.search(" Alpha", "bad good")
    engine.forget()
    with pytest.raises(FileNotFoundError):
        engine.search("alpha", "bad")
    with pytest.raises(LookupError):
        engine.search("gamma", "good lacks")
    assert engine.search("the", "good") is None and present.message(None) == present.STOP_MESSAGE and present.STOP_MESSAGE in present.to_html(None)
    with pytest.raises(QueryError):
        parse("foo or not bar")


def test_page_tells_all_results(spark):
    df = spark.createDataFrame([("s", PAGE, f"u/{k}", 0.5, None, [1], "x", 1) for k in range(30)], "subj string, entry_type int, target string, rel double, title string, positions array<int>, site string, edition long")
    html = present.to_html(df, 10)
    assert "Found 30 results" in html and html.count("<li>") == 10


def test_update_with_handlers(spark):
    old, new = postings(spark, [("a", "p", 0.5), ("b", "p", 0.5)]), postings(spark, [("a", "p", 0.5), ("a", "q", 0.5), ("c", "p", 0.5)])
    got = merge.update_with(old, new, {"n": F.count(F.when(~F.col("fresh"), 1)), "best": F.max("rel")})
    assert rows(got, "term", "n", "best") == [("a", 2, 0.5), ("c", 1, 0.5)]
    meta = spark.createDataFrame([(1, "a", None, None, 3), (2, None, "o", None, -1), (3, "b", None, None, 4)], "batch long, name string, owner string, owner_email string, total_pages long")
    assert merge.metadata_of(meta).first().asDict() == {"name": "b", "owner": "o", "owner_email": None, "total_pages": 7}
