"""Surrogates: distinctness, coreference and type over notations, countries, scopes, scripts and endings."""

import random
from ipaddress import ip_address

import pytest

from inkspar.llm import pii


@pytest.fixture(scope="module")
def made():
    return pii.Surrogates(b"k")


def surrogate(made, kind, text):
    return pii.identity(kind, made(kind, text))


def test_notations_of_a_number_are_one(made):
    for notations in (["+1 (017) 555-7713", "(017) 555-7713", "017.555.7713", "017 555 7713", "+10175557713"], ["+44 20 7946 0958", "+44 (0)20 7946 0958", "+442079460958"]):
        assert len({pii.identity("phone", n) for n in notations}) == len({surrogate(made, "phone", n) for n in notations}) == 1
    for text, code in (("+380 44 123 4567", "+380 "), ("+353 1 234 5678", "+353 "), ("+7 912 345 67 89", "+7 "), ("+49 30 1234567", "+49 ")):
        new = made("phone", text)
        assert new.startswith(code) and new != text and [c.isdigit() for c in new] == [c.isdigit() for c in text]
    assert made("phone", "+1 (651) 126-1686") != made("phone", "+1 (597) 555-3955")


def test_numbers_stay_apart(made):
    rng = random.Random(3)
    numbers = {f"+1 ({rng.randrange(1000):03d}) {rng.choice([555, rng.randrange(1000)]):03d}-{rng.randrange(10000):04d}" for _ in range(4000)}
    numbers |= {f"0{rng.randrange(10**9):09d}" for _ in range(500)} | {f"+380 {rng.randrange(10**9):09d}" for _ in range(500)}
    want = {pii.identity("phone", n) for n in numbers}
    got = {surrogate(made, "phone", n) for n in numbers}
    assert len(got) == len(want) and all((n[9:12] == "555") == (made("phone", n)[9:12] == "555") for n in numbers if n.startswith("+1 ("))


def test_addresses_keep_their_scope(made):
    for text in ("10.0.0.1", "192.168.7.9", "127.0.0.1", "203.0.113.9", "fe80::1", "2001:db8::7", "fd00::12", "2a02::9"):
        old, new = ip_address(text), ip_address(made("ipv6" if ":" in text else "ipv4", text))
        assert new != old and all(getattr(old, p) == getattr(new, p) for p in ("version", "is_private", "is_loopback", "is_link_local", "is_multicast"))
    rng = random.Random(4)
    public = {f"{rng.randrange(1, 224)}.{rng.randrange(256)}.{rng.randrange(256)}.{rng.randrange(256)}" for _ in range(500)}
    new = {made("ipv4", a) for a in public}
    assert len(new) == len(public) and all(pii.scope(pii.number_4(a), pii._RANGES_4) == pii.scope(pii.number_4(made("ipv4", a)), pii._RANGES_4) for a in public)
    assert surrogate(made, "ipv6", "2A02:1::7") == surrogate(made, "ipv6", "2a02:1:0:0:0:0:0:7")


def test_names(made):
    assert made("person", "Mr Zorblina")[3:] == made("person", "Mrs Zorblina")[4:] == made("person", "Dr Zorblina")[3:] != "Zorblina"
    assert made("person", "Frau Petrova").endswith("ova") and made("person", "Herr Petrov").endswith("ov") and made("person", "Господин Петров").endswith("ов")
    for text in ("Dr Ø", "Mrs Łukasz Wójcik", "Mr Don", "Mr Ðórr", "Mr Айбек", "Mrs Ґанна", "Mr 金田"):
        new = made("person", text)
        words = lambda t: t.split()[1:]
        assert not set(words(new)) & set(words(text)) and not any(c in words(new)[0] for c in "ŁØÐ" if c in text), (text, new)
    rng = random.Random(5)
    words = ["Don", "Ton", "Van", "La", "Smith", "Petrova", "Meriva", "Kasova", "Ana", "Anna", "John", "Ø", "Dr", "M", "Ova", "Eva", "Jo", "Al", "SMITH", "Straße"]
    seen: dict[str, str] = {}
    for _ in range(5000):
        text = rng.choice(["Mr ", "Mrs ", "M. ", "Herr ", "Dr "]) + " ".join(rng.choice(words) for _ in range(rng.randrange(1, 4)))
        assert seen.setdefault(surrogate(made, "person", text), pii.identity("person", text)) == pii.identity("person", text)


def test_whole_entities_are_replaced(made):
    detect = pii.Detector()
    cases = [
        ("email", "x" * 80 + "@mail.org"), ("email", "иван.петров@почта.рф"), ("email", "a+b_c%d@x-y.example.com"), ("ipv6", "2a02:8108:8ac0:1234:5678:9abc:def0:1234"), ("ipv6", "fe80::1ff:fe23:4567:890a"),
        ("phone", "+353 1 234 5678"), ("phone", "+44 (0)20 7946 0958"),
    ]
    for kind, entity in cases:
        text = f"then {entity}, at 12:34:56 in std::vector."
        assert [(text[a:b], k) for a, b, k in detect(text)] == [(entity, kind)]
        new, _ = pii.rewrite(text, detect(text), made)
        assert entity not in new and new.endswith(", at 12:34:56 in std::vector.") and entity[:20] not in new
    long = "q" * 5000 + "@mail.org"
    assert len(made("email", long)) == len(long) and sum(a == b for a, b in zip(made("email", long), long)) < 600


def test_keys(spark):
    with pytest.raises(ValueError):
        pii.Surrogates(b"")
    assert pii.key_of(spark) == pii.key_of(spark) and len(pii.key_of(spark)) == 32
    spark.conf.set(pii.KEY_SETTING, "mine")
    assert pii.key_of(spark) == b"mine"
    spark.conf.unset(pii.KEY_SETTING)
    assert pii.Surrogates(b"a")("phone", "+1 (651) 126-1686") != pii.Surrogates(b"b")("phone", "+1 (651) 126-1686")


def test_check_finds_collisions(spark):
    kind = "doc_id long, text string, entities " + pii.ENTITY
    row = lambda i, e, s: (i, "", [(0, 1, "card", e, s, e, s)])
    assert pii.check(spark.createDataFrame([row(1, "1", "5"), row(2, "2", "6"), row(3, "1", "5")], kind)).count() == 3
    for rows in ([row(1, "1", "5"), row(2, "2", "5")], [row(1, "1", "5"), row(2, "1", "6")]):
        with pytest.raises(pii.Collision):
            pii.check(spark.createDataFrame(rows, kind))


def test_query_against_one_text_at_a_time(spark, tmp_path):
    """The registered query gives for each document what a plain loop over its text gives."""
    texts = ["Mr John Smith wrote to a.b@c.example.com", "a.b@C.example.com and (017) 555-7713", "+1 (017) 555-7713 from 10.0.0.1", None, "", "Mr John Smith", "Mr John Smith"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.conf.set(pii.KEY_SETTING, "one")
    got = {r["doc_id"]: r for r in pii.query(spark, str(tmp_path)).collect()}
    spark.conf.unset(pii.KEY_SETTING)
    detect, made = pii.Detector(), pii.Surrogates(b"one")
    for k, t in enumerate(texts):
        spans = detect(t) if t else []
        assert got[k]["text"] == (pii.rewrite(t, spans, made)[0] if t else t)
        assert [got[k][f"n_{n}"] for n in pii.TYPES] == [sum(s[2] == n for s in spans) for n in pii.TYPES]
    assert got[5]["text"] == got[6]["text"] and got[5]["text"] in got[0]["text"]
