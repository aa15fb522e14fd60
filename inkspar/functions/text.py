"""Text functions: folding, tokens, stop words, scripts."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A token is a run of letters and decimal digits.
TOKEN = r"[\p{L}\p{Nd}]+"
STOP_WORDS = ["the", "and", "that", "have", "for"]
#: First and last code points of the scripts that are written without spaces (fixed values; Kannada is among them).
CJK_RANGES = [
    (0x1100, 0x11FF), (0x2E80, 0x2FDF), (0x3000, 0x303F), (0x3040, 0x30FF), (0x3100, 0x312F), (0x3130, 0x318F), (0x3190, 0x319F),
    (0x31A0, 0x31BF), (0x31F0, 0x31FF), (0x3300, 0x33FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xAC00, 0xD7AF), (0xF900, 0xFAFF),
    (0xFE30, 0xFE4F), (0x0C80, 0x0CFF), (0x20000, 0x2A6DF), (0x2F800, 0x2FA1F),
]
CJK_CLASS = "[" + "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in CJK_RANGES) + "]"


def fold(text: Column) -> Column:
    """Small letters, with ß as ss.  Not lower(upper(x)): the optimizer turns that into lower(x)."""
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(fold(text), F.lit(TOKEN), F.lit(0))


def tokenize(docs: DataFrame, key: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """(key, keep..., pos, term); positions count from 0 and stop words have theirs."""
    return docs.select(key, *(keep or []), F.posexplode(tokens(F.col(text))).alias("pos", "term"))


def is_cjk(text: Column) -> Column:
    """Does the text begin with a code point of those scripts?"""
    return text.rlike("^" + CJK_CLASS)


def is_cjk_py(c: str) -> bool:
    return any(a <= ord(c) <= b for a, b in CJK_RANGES)


def is_stop_word(word: Column) -> Column:
    """A listed word, or one too short: under three characters, unless its first is CJK, or its second where it has two."""
    short = (F.length(word) < 3) & ~is_cjk(word) & ~((F.length(word) == 2) & is_cjk(F.substring(word, 2, 1)))
    return word.isin(STOP_WORDS) | short


def is_stop_word_py(word: str) -> bool:
    if word in STOP_WORDS:
        return True
    if len(word) >= 3:
        return False
    return not (word and (is_cjk_py(word[0]) or (len(word) == 2 and is_cjk_py(word[1]))))


def fix_cjk(query: str) -> str:
    """A space between neighbouring CJK characters of a query, so that they are searched one by one."""
    out = []
    for k, c in enumerate(query):
        if k and is_cjk_py(c) and is_cjk_py(query[k - 1]):
            out.append(" ")
        out.append(c)
    return "".join(out)


def cjk_grams(text: Column, pairs: bool = True) -> Column:
    """C1, C1C2, C2, C2C3, C3 of a run of characters; without pairs the characters alone."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    if not pairs:
        return chars
    return F.flatten(F.transform(chars, lambda c, k: F.when(k + 1 < F.size(chars), F.array(c, F.concat(c, F.get(chars, k + 1)))).otherwise(F.array(c))))


def strict_tokens(text: str, pairs: bool = False) -> Iterator[str]:
    """Tokens of mixed scripts, one text at a time.

    Letters and digits make segments; a change between spaced and unspaced scripts ends one, digits join whichever is
    open.  An apostrophe inside a word belongs to it and is cut at its end.  A segment of one or two digits alone is
    dropped unless it ends the text.  Unspaced segments come as single characters, or with pairs in between; digits in
    them appear in pairs only.
    """
    text = text.upper().lower()
    kind, segment = "", ""

    def flush(trim: bool, last: bool) -> Iterator[str]:
        if not segment:
            return
        if kind == "cjk":
            for k, c in enumerate(segment):
                if is_cjk_py(c):
                    yield c
                if pairs and k + 1 < len(segment):
                    yield segment[k : k + 2]
            return
        if not kind and len(segment) < 3 and not last:
            return
        word = segment.rstrip("'") if trim else segment
        if word:
            yield word

    for c in text:
        group = unicodedata.category(c)
        if group == "Nd":
            segment += c
        elif group[0] == "L":
            new = "cjk" if is_cjk_py(c) else "latin"
            if kind and new != kind:
                yield from flush(False, False)
                segment = ""
            kind = new
            segment += c
        elif c == "'" and segment and kind != "cjk":
            segment += c
        else:
            yield from flush(True, False)
            kind, segment = "", ""
    yield from flush(True, True)


def tokenize_strict(docs: DataFrame, key: str = "doc_id", text: str = "text", pairs: bool = False) -> DataFrame:
    """(key, pos, term) by strict_tokens, in Arrow batches; for mixed scripts, which the pattern cannot express."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            keys, pos, terms = [], [], []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for p, w in enumerate(strict_tokens(t or "", pairs)):
                    keys.append(k)
                    pos.append(p)
                    terms.append(w)
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.column(0).type), pa.array(pos, pa.int32()), pa.array(terms, pa.string())], [key, "pos", "term"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"{key} {kind}, pos int, term string")


def parse_positions(text: Column) -> Column:
    """`3,7,x,9` -> [3, 7, 9]; what is no number is skipped."""
    return F.filter(F.transform(F.split(text, ","), lambda p: F.trim(p).try_cast("int")), lambda p: p.isNotNull())


def positions_map(positions: Column, fragments: Column) -> Column:
    """The fragments, or a null fragment for each position."""
    return F.coalesce(fragments, F.map_from_arrays(positions, F.transform(positions, lambda p: F.lit(None).cast("string"))))


def has_positions(positions: Column) -> Column:
    return positions.isNotNull()


def has_position(positions: Column, at) -> Column:
    return F.coalesce(F.array_contains(positions, at), F.lit(False))


def has_fragments(fragments: Column) -> Column:
    return fragments.isNotNull()


def display_title(title: Column, url: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(title), F.lit("")), F.element_at(F.split(url, "/"), -1))


def display_relevance(rel: Column) -> Column:
    return F.when(rel == 0, "unknown").otherwise(F.concat(F.round(rel * 100, 2).cast("string"), F.lit("%")))


def site_of(uri: Column) -> Column:
    """What stays the same over the editions of a page: the address without query, fragment and number."""
    return F.regexp_replace(F.regexp_replace(uri, r"[?#].*$", ""), r"/\d+(\.html?)?/?$", "")


def edition_of(uri: Column) -> Column:
    """The number at the end of the path, or the smallest long where there is none."""
    number = F.nullif(F.regexp_extract(F.regexp_replace(uri, r"[?#].*$", ""), r"/(\d+)(?:\.html?)?/?$", 1), F.lit(""))
    return F.coalesce(number.try_cast("bigint"), F.lit(-(1 << 63)))


def shard_key(term: Column, digits: int = 1) -> Column:
    return F.substring(F.md5(term), 1, digits)


def cache_key(data: Column) -> Column:
    """base64 of the SHA-256."""
    return F.base64(F.unhex(F.sha2(data, 256)))
