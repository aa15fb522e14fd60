"""License scans: every occurrence within the allowed changes is found, against aligning everything."""

import math
import random

import pytest

from inkspar.llm import license_scan as L

SHORT = {n: t for n, t in L.TEMPLATES.items() if len(L.words_of(t)[0]) <= 40}


def changed(rng, words, changes, kinds=3):
    words = list(words)
    for _ in range(changes):
        kind, at = rng.randrange(kinds), rng.randrange(len(words))
        if kind == 0:
            words[at] = f"zz{rng.randrange(99)}"
        elif kind == 1:
            words.pop(at)
        else:
            words.insert(at, f"new{rng.randrange(99)}")
    return words


@pytest.mark.parametrize("name", sorted(L.TEMPLATES))
def test_changes_up_to_the_bound_are_found(name):
    rng, index = random.Random(name), L.Index(L.TEMPLATES)
    words = L.TEMPLATES[name].split()
    n = len(L.words_of(L.TEMPLATES[name])[0])
    for _ in range(15):
        around = [f"word{rng.randrange(9)}" for _ in range(rng.randrange(30))]
        assert L.scan(" ".join(around + changed(rng, words, rng.randint(0, n - math.ceil(0.8 * n))) + around), index)


def test_named_cases():
    index = L.Index(L.TEMPLATES)
    for text in ("Released underneath the MIT License.", "Released under the MIT Agreement.", "It was released under a MIT license, they say"):
        assert [(f[0], f[1]) for f in L.scan(text, index)] == [("MIT-notice", 0.8)]
    assert L.scan("under the bridge and under the hill", index) == []


def test_query_against_aligning_everything(spark, tmp_path):
    rng, texts = random.Random(7), [None, "", "under the tree"]
    for name, t in SHORT.items():
        n = len(L.words_of(t)[0])
        for k in range(6):
            # replaced words only, up to twice the bound, so that some texts match and some do not
            words = changed(rng, t.split(), rng.randint(0, 2 * (n - math.ceil(0.8 * n))), 1)
            texts.append(" ".join([f"a{rng.randrange(99)}" for _ in range(k)] + words + ["end"] * k))
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = {}
    for r in L.query(spark, str(tmp_path)).collect():
        got.setdefault(r["doc_id"], set()).add(r["license"])
    for k, t in enumerate(texts):
        words = L.words_of(t or "")[0]
        want = {}
        for name, template in L.TEMPLATES.items():
            pattern = L.words_of(template)[0]
            share = len(L.align(pattern, words, -len(pattern), len(words))) / len(pattern) if words else 0
            if share >= 0.8:
                want[name] = share
        assert bool(got.get(k)) == bool(want) and got.get(k, set()) <= set(want), (t, got.get(k), want)
        if want:
            assert any(abs(want[n] - max(want.values())) < 1e-9 for n in got[k])
