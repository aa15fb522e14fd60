"""Exact byte-level BPE by dynamic programming over prefixes.

For every prefix of a pretoken exactly one token can be the last of its encoding.  A suffix automaton over the vocabulary
yields, for each prefix, the tokens that end it, the longest first; the first one whose pair with the last token of
the prefix before it is compatible (the merges would leave the two side by side) is stored.  Following the stored
tokens back from the end gives the ids, the same as those of the merge procedure, in time linear in the text.

A text is cut into segments that begin at a space; cuts are only made where the pretokenizer cuts as well, other texts
(white space runs with inner spaces) are taken whole.  Each distinct segment of a batch is encoded once, and
pretokens are remembered within a bound.

Defined results: null text is the empty text, with 0 tokens and the digests of the empty string; repeated rows repeat;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_texts, table, vocabulary

#: Bounds of what a task remembers.
PRETOKENS, PAIRS = 600_000, 600_000
#: Characters of text encoded at one time, if one text is not longer.
CHUNK = 12_000_000
_SPACE = r"[\s\x0b\x{85}\pZ\x1c-\x1f]"
#: A space that follows white space and does not begin a word: here the segments are not the pretokenizer's.
_INNER = f"{_SPACE} ({_SPACE}|$)"


def byte_letters() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable bytes for themselves, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


class PrefixBPE:
    def __init__(self, path: str):
        import ahocorasick
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        raw = lambda t: bytes(letters[c] for c in t)
        vocab = spec["model"]["vocab"]
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = special
        self.special_pattern = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(special, key=len, reverse=True)) + ")") if special else None
        ids = {raw(t): i for t, i in vocab.items() if t not in special}
        self.bytes_of: dict[int, bytes] = {i: b for b, i in ids.items()} | {i: s.encode() for s, i in special.items()}
        self.length = [0] * (1 + max(self.bytes_of))
        for i, b in self.bytes_of.items():
            self.length[i] = len(b)
        self.merged: dict[tuple[int, int], tuple[int, int]] = {}  # pair -> rank, result
        self.halves: dict[int, tuple[int, int, int]] = {}  # token -> rank of its merge, its halves
        for rank, m in enumerate(spec["model"]["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            left, right = ids[raw(a)], ids[raw(b)]
            whole = ids[raw(a) + raw(b)]
            self.merged.setdefault((left, right), (rank, whole))
            self.halves.setdefault(whole, (rank, left, right))
        automaton = ahocorasick.Automaton()
        for b, i in ids.items():
            if self.reachable(i):
                automaton.add_word(b.decode("latin-1"), i)
        automaton.make_automaton()
        self.matches = automaton.iter
        # the pretokenizer of this family of vocabularies, with the white space of Unicode
        self.cut = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+").findall
        self.pairs: dict[int, bool] = {}
        self.known: dict[str, tuple[int, ...]] = {}

    def compatible(self, left: int, right: int, limit: int = 1 << 60) -> bool:
        """Would the merges before limit leave left and right side by side?

        Undo the later of the two tokens' own merges, step by step: whenever the tokens that meet at the border would
        merge before the merge that was undone last, BPE would have crossed the border.
        """
        merged, halves = self.merged, self.halves
        while True:
            across = merged.get((left, right))
            if across and across[0] < limit:
                return False
            a, b = halves.get(left), halves.get(right)
            if a is None and b is None:
                return True
            # of the two merges the later one is undone; at one rank the one to the left happened first, and so
            # would a merge across the border before the right token's
            if b is None or (a is not None and a[0] > b[0]):
                limit, left = a[0], a[2]
            else:
                limit, right = b[0] + 1, b[1]

    def reachable(self, token: int) -> bool:
        """Do the merges of the token's own bytes end at the token?"""
        made = self.halves.get(token)
        return made is None or (self.compatible(made[1], made[2], made[0]) and self.reachable(made[1]) and self.reachable(made[2]))

    def pretoken(self, text: str) -> tuple[int, ...]:
        found = self.known.get(text)
        if found is not None:
            return found
        data = text.encode().decode("latin-1")
        n = len(data)
        last: list[int | None] = [None] * (n + 1)
        length, known_pair = self.length, self.pairs.get
        for at, token in self.matches(data):
            end = at + 1
            if last[end] is None:
                start = end - length[token]
                if start:
                    before = last[start]
                    if before is None:
                        continue
                    ok = known_pair(before << 20 | token)
                    if ok is None:
                        ok = self.pairs[before << 20 | token] = self.compatible(before, token)
                    if ok:
                        last[end] = token
                else:
                    last[end] = token
        ids = []
        while n:
            token = last[n]
            ids.append(token)
            n -= length[token]
        ids.reverse()
        out = tuple(ids)
        if len(self.known) >= PRETOKENS:
            self.known.clear()
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        if len(text) <= 64:
            self.known[text] = out
        return out

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        parts = self.special_pattern.split(text) if self.special_pattern else [text]
        for part in parts:
            if part in self.special:
                ids.append(self.special[part])
            elif part:
                for p in self.cut(part):
                    ids += self.pretoken(p)
        return ids

    def decode(self, ids) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")

    def plain(self, segment: str) -> list[int]:
        ids: list[int] = []
        for p in self.cut(segment):
            ids += self.pretoken(p)
        return ids

    def digests(self, texts: pa.Array) -> tuple[list[int], list[str], list[str]]:
        """n_tokens and both digests of each text."""
        odd = pc.or_(pc.match_substring_regex(texts, _INNER), pc.match_substring(texts, "\0"))
        for s in self.special:
            odd = pc.or_(odd, pc.match_substring(texts, s))
        marked = pc.replace_substring(pc.if_else(odd, "", texts), " ", "\0 ")
        lists = pc.split_pattern(marked, "\0")
        segments = lists.values.dictionary_encode()
        counts, listed, decoded = [], [], []
        known = self.known.get
        for s in segments.dictionary.to_pylist():
            ids = known(s) or self.plain(s)
            counts.append(len(ids))
            listed.append(",".join(map(str, ids)))
            decoded.append(b"".join(map(self.bytes_of.__getitem__, ids)))
        index = segments.indices
        ends = np.concatenate([[0], np.cumsum(np.array(counts, np.int64)[index.to_numpy(zero_copy_only=False)])])
        offsets = lists.offsets.to_numpy()
        n = (ends[offsets[1:]] - ends[offsets[:-1]]).tolist()
        ids_text = pc.binary_join(pa.ListArray.from_arrays(lists.offsets, pa.array(listed, pa.string()).take(index)), ",")
        ids_text = pc.ascii_ltrim(ids_text, ",")  # a text that begins with a space has an empty first segment
        back = pc.binary_join(pa.ListArray.from_arrays(lists.offsets, pa.array(decoded, pa.binary()).take(index)), b"")
        sha = lambda b: hashlib.sha256(b).hexdigest()
        id_sha, back_sha = [], []
        for k in range(len(texts)):
            if odd[k].as_py():
                ids = self.encode(texts[k].as_py())
                n[k] = len(ids)
                id_sha.append(sha(",".join(map(str, ids)).encode()))
                back_sha.append(sha(self.decode(ids).encode()))
            else:
                id_sha.append(sha(ids_text[k].as_buffer()))
                # pieces of valid UTF-8 put together are valid again, so no replacement can occur here
                back_sha.append(sha(back[k].as_buffer()))
        return n, id_sha, back_sha


def by_chars(texts: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Row ranges of about limit bytes of text."""
    size = pc.binary_length(texts).to_numpy(zero_copy_only=False)
    ends = np.cumsum(size)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, "right")))
        yield at, min(to, len(texts))
        at = to


SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _digests(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = PrefixBPE(path)
        for batch in batches:
            texts = batch.column("text").cast(pa.large_string())
            for a, b in by_chars(texts):
                n, ids, back = bpe.digests(texts.slice(a, b - a))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(n, pa.int64()), pa.array(ids), pa.array(back)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def encode_digests(docs: DataFrame, path: str, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    return map_texts(rows, _digests(path), SCHEMA)


def encode(docs: DataFrame, path: str, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, ids."""

    def run(batches):
        bpe = PrefixBPE(path)
        for batch in batches:
            ids = [bpe.encode(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    return map_texts(rows, run, "doc_id long, ids array<int>")


def decode(rows: DataFrame, path: str) -> DataFrame:
    """doc_id, ids -> doc_id, text; null ids give the empty text, an id outside the vocabulary is an error."""

    def run(batches):
        bpe = PrefixBPE(path)
        for batch in batches:
            text = [bpe.decode(i or []) for i in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(text, pa.string())], ["doc_id", "text"])

    return map_texts(rows.select("doc_id", "ids"), run, "doc_id long, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))
