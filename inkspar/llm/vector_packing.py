"""Packing of instruction data by vector bins.

An example has a demand vector (tokens, segments, loss-bearing tokens) and a sequence has a limit for each.  A sequence is
filled by the dot-product heuristic: of the pool, the example whose demand has the largest dot product with
what is left of the limits (both as shares of the limits) goes in next, if it fits.  When nothing fits whole, the best
example is cut, where cutting is allowed, and its rest returns to the pool; so only the last sequence of a task has room
left over, but for what a limit on segments or loss leaves.  Segments and loss-bearing tokens of an example that is cut divide with its
tokens, rounded up; a segment that is cut counts on both sides.  `query` packs documents: one segment each, every token bears loss, and
a sequence may hold any number of them.  `query_conversations` packs instruction data: a turn is a segment, and what the assistant says bears
loss.  The pool is bounded, rows flow through it, and nothing is shuffled: each task packs the rows of its own
input split.

Defined results: null text is the empty text, which still has its end token; an example without tokens gives no piece;
an example longer than a sequence, or with more segments, is cut; repeated rows are packed like any others; an empty table gives no
rows; turns with a null text have their end token, turns with a null role bear no loss, a null conv_id is a conversation like any other.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import by_chars, byte_letters
from .common import free_memory, map_texts, table, vocabulary

SEQUENCE = 4096
#: Documents in a sequence: each has a token, so this is no limit.
DOCUMENTS = (SEQUENCE, SEQUENCE, SEQUENCE)
#: Tokens, turns and loss-bearing tokens of a sequence of conversations.
CONVERSATIONS = (SEQUENCE, 32, 3072)
LEARNED_ROLE = "assistant"
#: Examples that wait in a task at one time.
POOL = 2048
#: Words whose ids a task remembers.
CACHE = 300_000


#: Letters below U+0250, then ASCII punctuation without the apostrophe: two pretokens, or one.
_PLAIN = re.compile(r"([A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+)([!-&(-/:-@\[-`{-~]*)")


class WordIds:
    """ids of whole texts, from the ids of their words.

    Every pattern of this vocabulary's tokenizer ends at a space, and spaces leave no ids, so a text's ids are those
    of its words one after another.  Each distinct word goes through the tokenizers library once per task while the
    bounded memory lasts: plain words straight through its merges, which skips normalising what is normal already,
    all others through the whole of it.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.merges = self.tokenizer.model
        self.letter = {b: c for c, b in byte_letters().items()}
        self.known: dict[str, bytes] = {}
        self.stems: dict[str, bytes] = {}

    def full(self, word: str) -> bytes:
        return array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()

    def stem(self, low: str) -> bytes:
        shown = low if low.isascii() else "".join(map(self.letter.__getitem__, low.encode()))
        return array("I", [t.id for t in self.merges.tokenize(shown)]).tobytes()

    def word(self, word: str) -> bytes:
        plain = _PLAIN.fullmatch(word)
        if not plain:
            return self.full(word)
        letters, rest = plain.groups()
        low = letters.lower()
        if len(low) != len(letters):  # a capital whose small form is a letter and a mark
            return self.full(word)
        stems = self.stems
        ids = stems.get(low)
        if ids is None:
            ids = stems[low] = self.stem(low)
        if not rest:
            return ids
        end = stems.get(rest)
        if end is None:
            end = stems[rest] = self.full(rest)
        return ids + end

    def lookup(self, words: list[str]) -> list[bytes]:
        known = self.known
        if len(known) > CACHE:
            known.clear()
        if len(self.stems) > CACHE:
            self.stems.clear()
        out = []
        for w in words:
            ids = known.get(w)
            if ids is None:
                ids = known[w] = self.word(w)
            out.append(ids)
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        array = pa.array(texts, pa.large_string())
        lists = pc.split_pattern(pc.replace_substring(array, "\n", " "), " ")
        words = lists.values.dictionary_encode()
        parts = self.lookup(words.dictionary.to_pylist())
        sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        flat = np.frombuffer(b"".join(parts), np.uint32)
        begin = np.cumsum(sizes) - sizes
        index = words.indices.to_numpy(zero_copy_only=False)
        n = sizes[index]
        ends = np.cumsum(n)
        # place of every id in flat: the word's begin plus a running count inside the word
        place = np.repeat(begin[index] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)
        ids = flat[place]
        cuts = np.concatenate([[0], ends])[lists.offsets.to_numpy()]
        return [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


class Packer:
    """Packs examples (key, demand) into sequences; see the module's text."""

    def __init__(self, limits: tuple[int, int, int], pool: int = POOL, cut: bool = True):
        self.limits = np.array(limits, float)
        self.pool, self.cut = pool, cut
        self.demand = np.zeros((pool, 3))
        self.keys: list = [None] * pool
        self.start = [0] * pool
        self.free = list(range(pool - 1, -1, -1))
        self.bins = 0
        self.room = self.limits.copy()
        self.offset = 0
        self.out: list[tuple] = []

    def put(self, slot: int, tokens: int, segments: int, loss: int) -> None:
        self.out.append((self.keys[slot], self.start[slot], tokens, self.bins, self.offset, segments, loss))
        self.room -= (tokens, segments, loss)
        self.offset += tokens
        if self.room[0] < 1 or self.room[1] < 1:
            self.close()

    def close(self) -> None:
        if self.offset:
            self.bins += 1
        self.room, self.offset = self.limits.copy(), 0

    def add(self, key, tokens: int, segments: int, loss: int) -> None:
        """segments and loss are those of the whole example, at most one for each token; both divide with its tokens when it is cut."""
        if tokens <= 0:
            return
        segments, loss = min(segments, tokens), min(loss, tokens)
        if not self.cut and (tokens > self.limits[0] or segments > self.limits[1] or loss > self.limits[2]):
            raise ValueError("an example is larger than a sequence and may not be cut")
        if loss and self.limits[2] < 1:
            raise ValueError("an example bears loss where none may be")
        if not self.free:
            self.fill()
        slot = self.free.pop()
        self.keys[slot], self.start[slot] = key, 0
        self.demand[slot] = (tokens, segments, loss)

    def fill(self) -> None:
        """Place until a quarter of the pool is free."""
        while len(self.free) < max(1, self.pool // 4):
            self.place()

    def place(self) -> None:
        tokens = self.demand[:, 0]
        share = np.minimum(self.demand, self.limits) / self.limits
        score = share @ (self.room / self.limits)
        score[tokens == 0] = -1
        fits = (self.demand <= self.room).all(1) & (tokens > 0)
        if fits.any():
            slot = int(np.argmax(np.where(fits, score, -1)))
            t, s, loss = self.demand[slot]
            self.demand[slot] = 0
            self.free.append(slot)
            self.put(slot, int(t), int(s), int(loss))
            return
        slot = int(np.argmax(score))
        t, s, loss = self.demand[slot]
        take = int(min(self.room[0], t))
        if loss > 0:
            take = min(take, int(self.room[2] * t // loss))
        if s > 0:
            take = min(take, int(self.room[1] * t // s))
        if not self.cut or take < 1:
            self.close()
            return
        part, turns = min(int(np.ceil(loss * take / t)), int(loss)), min(int(np.ceil(s * take / t)), int(s))
        self.put(slot, take, turns, part)
        self.start[slot] += take
        rest = t - take
        self.demand[slot] = (rest, max(s - turns, min(s, 1)) if rest else 0, loss - part)
        if not rest:
            self.free.append(slot)

    def finish(self) -> None:
        while len(self.free) < self.pool:
            self.place()
        self.close()

    def drain(self) -> list[tuple]:
        out, self.out = self.out, []
        return out


def pack(examples: Iterator[tuple], limits=DOCUMENTS, pool: int = POOL, cut: bool = True) -> list[tuple]:
    """(key, tokens, segments, loss) -> (key, start, length, sequence, offset, segments, loss), for lists that fit in memory."""
    packer = Packer(limits, pool, cut)
    for e in examples:
        packer.add(*e)
    packer.finish()
    return packer.drain()


PIECE = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])


def _pack_texts(path: str, end_id: int, limits, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        words = WordIds(path)
        packer = Packer(limits)
        base = TaskContext.get().partitionId() << 40
        live: dict[int, list] = {}  # number -> doc_id, ids, tokens not yet placed
        n = 0
        schema = PIECE.append(pa.field("ids", pa.list_(pa.int32()))) if with_ids else PIECE

        def rows() -> pa.RecordBatch:
            out, parts = [], []
            for key, start, length, seq, offset, _, _ in packer.drain():
                doc = live[key]
                ids = doc[1][start : start + length]
                doc[2] -= length
                piece = [doc[0], start, length, crc32(ids.astype("<u4").tobytes()), len(doc[1]), base + seq, offset]
                out.append(piece)
                if with_ids:
                    parts.append(ids)
                if not doc[2]:
                    del live[key]
            cols = [pa.array(c, pa.int64()) for c in list(zip(*out, strict=True)) or [()] * len(PIECE)]
            if with_ids:
                ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
                cols.append(pa.ListArray.from_arrays(ends, np.concatenate([*parts, np.empty(0, np.uint32)]).astype(np.int32)))
            return pa.RecordBatch.from_arrays(cols, schema=schema)

        for batch in batches:
            for at, to in by_chars(batch.column("text").cast(pa.large_string()), 4_000_000):
                part = batch.slice(at, to - at)
                for key, ids in zip(part.column("doc_id").to_pylist(), words.encode(part.column("text").to_pylist()), strict=True):
                    ids = np.append(ids, np.uint32(end_id))
                    live[n] = [key, ids, len(ids)]
                    packer.add(n, len(ids), 1, len(ids))
                    n += 1
                if packer.out:
                    yield rows()
            free_memory()
        packer.finish()
        yield rows()

    return run


def pack_documents(docs: DataFrame, path: str, end_id: int = 2, limits=DOCUMENTS, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents and their places in sequences; with_ids adds the ids of each piece."""
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    schema = ", ".join(f"{n} long" for n in PIECE.names) + (", ids array<int>" if with_ids else "")
    return map_texts(rows, _pack_texts(path, end_id, limits, with_ids), schema)


def pack_demands(examples: DataFrame, limits: tuple[int, int, int], cut: bool = True) -> DataFrame:
    """Counted examples (id, tokens, segments, loss) -> (id, start, length, segments, loss, sequence_id, offset).

    Nulls count as 0; rows with no tokens give nothing.
    """
    names = ["id", "start", "length", "segments", "loss", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        packer, base = Packer(limits, cut=cut), TaskContext.get().partitionId() << 40

        def rows() -> pa.RecordBatch:
            cols = list(zip(*((k, at, n, s, loss, base + q, o) for k, at, n, q, o, s, loss in packer.drain()), strict=True)) or [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names)

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("id", "tokens", "segments", "loss")), strict=True):
                packer.add(*row)
            yield rows()
        packer.finish()
        yield rows()

    zero = F.lit(0)
    rows = examples.select(F.col("id").cast("long"), *[F.coalesce(F.col(c), zero).cast("long").alias(c) for c in ("tokens", "segments", "loss")])
    return rows.mapInArrow(run, ", ".join(f"{n} long" for n in names))


def conversation_demands(turns: DataFrame, path: str, learned: str = LEARNED_ROLE) -> DataFrame:
    """(id, tokens, segments, loss) of each conversation of (conv_id, role, text): turns are counted where they lie, and only counts are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordIds(path)
        for batch in batches:
            for at, to in by_chars(batch.column("text").cast(pa.large_string()), 4_000_000):
                part = batch.slice(at, to - at)
                sizes = [len(ids) + 1 for ids in words.encode(part.column("text").to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column("conv_id"), part.column("learned"), pa.array(sizes, pa.int64())], ["conv_id", "learned", "n"])
            free_memory()

    rows = turns.select(F.col("conv_id").cast("long"), F.coalesce(F.col("role") == learned, F.lit(False)).alias("learned"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    counted = map_texts(rows, run, "conv_id long, learned boolean, n long")
    return counted.groupBy(F.col("conv_id").alias("id")).agg(F.sum("n").alias("tokens"), F.count("*").alias("segments"), F.sum(F.when(F.col("learned"), F.col("n")).otherwise(0)).alias("loss"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def query_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all conversations: conv_id, start, length, segments, loss, sequence_id, offset."""
    return pack_demands(conversation_demands(table(spark, sf_dir, "conversations"), vocabulary("word_bpe_49k.json")), CONVERSATIONS).withColumnRenamed("id", "conv_id")
