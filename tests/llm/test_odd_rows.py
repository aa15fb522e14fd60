"""Every operator over rows with nulls, repeated ids, one very long text, and columns named like its own."""

from collections import Counter

import pytest

from inkspar.llm import bpe, content_sort, hilbert, language_id, license_scan, pii, prob_minhash, quality_rules, secret_scan, vector_packing
from inkspar.llm.common import vocabulary

#: Names that the operators use for columns of their own.
CLASH = """a b before block c class_id class_size draw e entity first group_size held_out id ids keep_id kept key label length lo hi m n
 node norm ord other part path predicted quality rank root row score sha share sig spans start sum surrogate text_sha256 u v value x y offset
 sequence_id lang_pred n_tokens below draws""".split()
LONG = "many words of one text that is long " * 30_000
ROWS = [(None, "a null id here"), (None, None), (None, "a null id here"), (7, "said twice, by one id"), (7, "said twice, by one id"), (8, None), (9, ""), (10, LONG), (11, "z" * 400_000), (12, "tie " * 12), (13, "tie " * 12)]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, None, None, None, *["?"] * len(CLASH)) for i, t in ROWS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASH)).repartition(3)


IDS = Counter(i for i, _ in ROWS)


def ids(df):
    return Counter(r["doc_id"] for r in df.select("doc_id").collect())


def test_packing(odd):
    rows = vector_packing.pack_documents(odd, vocabulary("word_bpe_49k.json")).collect()
    assert {r["doc_id"] for r in rows} == set(IDS)
    whole = Counter()
    for r in rows:
        whole[r["doc_id"], r["doc_tokens"]] += r["length"]
    assert whole[7, next(n for i, n in whole if i == 7)] == 2 * next(n for i, n in whole if i == 7)
    assert whole[8, 1] == whole[9, 1] == whole[None, 1] == 1


def test_surrogates(odd):
    assert ids(pii.surrogates(odd, b"k")) == IDS
    out = pii.replace_texts(odd)
    assert ids(out) == IDS and out.columns == odd.columns and out.where("text is null").count() == 2


def test_content_sort(odd):
    rows = content_sort.content_sort(odd).collect()
    assert Counter(r["doc_id"] for r in rows) == IDS
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in rows if r["kept"]) == [(False, i) for i in (7, 8, 10, 11, 12)] + [(True, None)]
    assert content_sort.keep_first(odd).columns == odd.columns


def test_near_duplicates(odd):
    rows = prob_minhash.near_duplicates(odd).collect()
    assert Counter(r["doc_id"] for r in rows) == IDS
    assert Counter(r["doc_id"] for r in rows if r["kept"]) == Counter([None, None, 7, 8, 9, 10, 11, 12])
    kept = prob_minhash.keep_one(odd)
    assert kept.columns == odd.columns and kept.count() == 8


def test_neighbours(spark):
    rows = [(None, [1.0, 2.0], "?"), (0, [1.0, 2.0], "?"), (0, [1.0, 2.0], "?"), (1, None, "?"), (2, [], "?"), (3, [1.0, None], "?"), (4, [1.0, 2.0], "?"), (5, [4.0, 6.0], "?")]
    for names in ("key string", "score string", "rank string", "query_id string", "side string"):
        df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, " + names)
        got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in hilbert.nearest(df, lambda i: i == 0).collect()]
        assert sorted(got) == [(0, 1, 4, 0.0), (0, 2, 5, 5.0)]


def test_license_scan(odd):
    assert license_scan.find_licenses(odd).count() == 0


def test_secret_scan(spark, odd):
    words = secret_scan.dictionary(vocabulary("word_bpe_49k.json"))
    forest = secret_scan.train(secret_scan.labelled_findings(spark, 200, seed=1), words)
    assert secret_scan.scan(odd, forest, words).count() == 0
    # a run whose first digit comes late, and a text with many candidates
    key = "token = \"9fK2mQx81LzP0aVt7RbY3cWn\" "
    df = spark.createDataFrame([(1, "a" * 500 + "1" + "b" * 20, None), (2, key * 3000, None)], "doc_id long, text string, source string")
    assert [(r["start"], r["end"]) for r in secret_scan.candidates(df).where("doc_id = 1").collect()] == [(0, 521)]
    found = secret_scan.candidates(df).where("doc_id = 2").orderBy("start").collect()
    assert [(r["start"], r["end"]) for r in found] == [(k * len(key) + 9, k * len(key) + 33) for k in range(3000)] and {r["after"][:1] for r in found} == {'"'}


def test_language(spark, odd):
    assert language_id.fit(odd) is None
    df = spark.createDataFrame([(k % 3 or None, w, g, "?", "?", "?") for k in range(60) for w, g in (("abab abba", "x"), ("cdcd dccd", "y"), (None, "z"), ("", "z"))], "doc_id long, text string, lang string, draw string, n string, below string")
    net = language_id.fit(df)
    assert net.languages == ["x", "y"]
    assert ids(language_id.predict(odd, net)) == IDS
    kept = language_id.keep_known(odd, net, 0.0)
    assert kept.columns == odd.columns and ids(kept) == IDS - Counter([None, 8, 9])


def test_language_sample_is_bounded(spark, monkeypatch):
    """One language in nearly all rows, one in few: both give the smallest draws, as many as the bound allows."""
    seen = {}
    monkeypatch.setattr(language_id, "ROWS_PER_LANGUAGE", 20)
    monkeypatch.setattr(language_id, "train", lambda samples, names: seen.update(samples=samples, names=names))
    df = spark.range(3000).selectExpr("id as doc_id", "concat('text ', id) as text", "if(id % 300 = 0, 'few', 'most') as lang")
    language_id.fit(df)
    assert seen["names"] == ["few", "most"] and Counter(k for _, k in seen["samples"]) == {0: 10, 1: 20}
    draws = df.where("lang = 'most'").selectExpr("text", "xxhash64(doc_id, 'language sample') as draw").orderBy("draw").limit(20).collect()
    assert sorted(s.decode() for s, k in seen["samples"] if k == 1) == sorted(r["text"] for r in draws)


def test_bpe(odd):
    path = vocabulary("byte_bpe_50k.json")
    rows = bpe.encode_digests(odd, path).collect()
    assert Counter(r["doc_id"] for r in rows) == IDS and all((r["n_tokens"] == 0) == (r["doc_id"] in (8, 9)) for r in rows if r["doc_id"] is not None)


def test_quality(spark, odd):
    labels = spark.createDataFrame([(7, 1, "?"), (7, 0, "?"), (8, 0, "?"), (None, 1, "?"), (9, None, "?")], "doc_id long, quality int, text string")
    got = quality_rules.score(odd, quality_rules.learn(odd, labels)).collect()
    assert Counter(r["doc_id"] for r in got) == IDS and all(0 <= r["score"] <= 1 for r in got)
