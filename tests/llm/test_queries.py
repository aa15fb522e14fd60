"""The registered queries on small tables, against plain Python."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from inkspar.llm.common import vocabulary
from inkspar.llm.queries import QUERIES
from tests.llm.test_llm import brute_classes, check_pieces

KINDS = {"aa": ["bado", "kelu", "mino", "tarin"], "bb": ["strn", "ghtz", "pflk", "vrsm"], "cc": ["жизнь", "слово", "дерево", "город"]}
KEY = "9fK2mQx81LzP0aVt7RbY3cWn"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """documents, labels and embeddings, with nulls, empty and repeated rows and columns of clashing names."""
    rng, root = random.Random(17), tmp_path_factory.mktemp("corpus")
    rows, labels = [], []
    for k in range(320):
        lang, good = rng.choice(sorted(KINDS)), rng.random() < 0.6
        text = ". ".join(" ".join(rng.choice(KINDS[lang]) + rng.choice("aeo") + ("" if good else rng.choice(["##", "$", "%%"])) for _ in range(rng.randrange(4, 30))) for _ in range(rng.randrange(1, 6)))
        rows.append((k, text, lang if k % 9 else None))
        labels.append((k, int(good)))
    rows += [(400, None, "aa"), (401, "", "aa"), (402, " \n\t", None), (403, "12 34", None), (404, rows[3][1], "aa"), (405, rows[3][1] + " end", "aa"), (406, f'token = "{KEY}" and the commit {"0123456789abcdef" * 2}01234567', None)]
    rows += [(407, f"card 4952935900253052, secret: '{KEY}', then '{KEY}' # example", None)]
    spark.createDataFrame([(i, t, g, "s", "x", "y") for i, t, g in rows], "doc_id long, text string, lang string, source string, score string, kept string").repartition(3).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(i, q, "x") for i, q in labels] + [(None, 1, "x"), (5, None, "x")], "doc_id long, quality int, score string").write.parquet(f"{root}/labels.parquet")
    x = np.random.default_rng(2).normal(size=(900, 12)).astype(np.float32)
    x[200:260] = x[200]
    spark.createDataFrame([(k, v.tolist(), "x") for k, v in enumerate(x)] + [(1000, None, "x"), (1100, [0.0] * 12, "x")], "vec_id long, embedding array<float>, rank string").write.parquet(f"{root}/embeddings.parquet")
    return str(root), {i: t for i, t, _ in rows}, {i: g for i, _, g in rows}, dict(labels), x


def run(spark, corpus, name):
    return QUERIES[name](spark, corpus[0]).collect()


def test_packing(spark, corpus):
    from tokenizers import Tokenizer

    check_pieces(run(spark, corpus, "op1_vector_packing"), corpus[1], Tokenizer.from_file(vocabulary("word_bpe_49k.json")))


def test_content_sort(spark, corpus):
    groups = defaultdict(list)
    for i, t in corpus[1].items():
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    want = {i: (min(ids), len(ids), i == min(ids), hashlib.sha256(t.encode()).hexdigest()) for t, ids in groups.items() for i in ids}
    assert {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in run(spark, corpus, "op3_content_sort")} == want


def test_neighbours(spark, corpus):
    x, got = corpus[4].astype(float), defaultdict(dict)
    for r in run(spark, corpus, "op4_hilbert_neighbours"):
        got[r["query_id"]][r["rank"]] = (r["vec_id"], r["score"])
    assert sorted(got) == list(range(0, 900, 100))
    hits = 0
    for q, found in got.items():
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        assert sorted(found) == list(range(1, 11)) and all(s == d[i] for i, s in found.values())
        assert [found[k] for k in sorted(found)] == sorted(found.values(), key=lambda f: (f[1], f[0]))
        hits += len({i for i, _ in found.values()} & set(np.lexsort((np.arange(len(x)), d))[:10].tolist()))
    assert hits >= 0.9 * 10 * len(got)


def test_secrets(spark, corpus):
    want = {(406, 9), (407, 32)}
    got = {(r["doc_id"], r["start"]): r for r in run(spark, corpus, "op6_secret_scan")}
    assert set(got) == want
    for (i, at), r in got.items():
        assert corpus[1][i][at : r["end"]] == KEY and r["length"] == len(KEY) and r["secret_sha256"] == hashlib.sha256(KEY.encode()).hexdigest()


def test_language(spark, corpus):
    got = {r["doc_id"]: r for r in run(spark, corpus, "op7_language_id")}
    assert set(got) == set(corpus[1])
    for i, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r["score"] <= 1
        assert (r["lang_pred"] == "und") == (not any(map(str.isalpha, corpus[1][i] or "")))
    held = [i for i in range(320) if got[i]["held_out"] and corpus[2][i]]
    assert len(held) > 40 and np.mean([got[i]["lang_pred"] == corpus[2][i] for i in held]) > 0.95


def test_near_duplicates(spark, corpus):
    ids = sorted(corpus[1])
    want = brute_classes([corpus[1][i] for i in ids])
    assert {r["doc_id"]: r["class_id"] for r in run(spark, corpus, "op8_prob_minhash")} == {i: ids[w] for i, w in zip(ids, want)}


def test_bpe(spark, corpus):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    want = {}
    for i, t in corpus[1].items():
        ids = library.encode(t or "", add_special_tokens=False).ids
        want[i] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in run(spark, corpus, "op9_prefix_bpe")} == want


def test_quality(spark, corpus):
    got = {r["doc_id"]: r for r in run(spark, corpus, "op10_quality_rules")}
    assert set(got) == set(corpus[1])
    for i, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    held = [i for i in range(320) if got[i]["held_out"]]
    assert len(held) > 60 and np.mean([got[i]["predicted"] == corpus[3][i] for i in held]) > 0.95
