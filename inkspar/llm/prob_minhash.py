"""Near-duplicate detection by ProbMinHash over weighted word shingles.

Every shingle of five words is a source of a Poisson process whose rate is its weight (1 + ln of its count); an arrival
picks one of M registers, and a register keeps the shingle that reaches it first.  Two texts agree in a register with
their probability Jaccard.  A shingle's arrivals end as soon as they are later than the latest register.  Texts in which a
shingle repeats have a second signature with all weights 1, for the plain Jaccard; for the others both are one.  Bands
of registers that agree, of either signature, make candidates; candidates are filtered by the larger share of equal
registers of both and then verified on the texts themselves.  As each similarity has a signature of its own, the bands overlook a pair
at 0.8 with probability 3e-6, and the filter with 5e-8 (binomial, 160 registers); both only fall with the similarity.  Texts are linked when the probability Jaccard or the plain Jaccard of their shingles is 0.8
or more, and the classes are the connected components of the links.

Rows are numbered in one table, written first, and everything reads that table, so a number means one row whatever
happens to executors.  Work is kept linear in a bucket: equal texts (same words) are one node; the nodes of a bucket are sorted and
cut where partitions end, and each is paired with the first one only.  Buckets whose other nodes still lie in different
components after that, or also the first where a bucket was cut, are compared block against block, inside tasks that return at most one link for each node,
so that no link is lost and no list of all pairs is ever made.

Defined results: words are lower-cased and cut at white space; a text of one to four words is one shingle; texts with no
word (null, empty, only white space) stay alone, each in a class of its own; rows with equal ids stay apart, one of
them is kept; null ids sort last; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_memory, map_texts, release, stage, table
from .graph import components

WORDS, SIMILARITY = 5, 0.8
#: 32 bands of 5 registers miss a pair at 0.8 with probability 3e-6.
BANDS, ROWS = 32, 5
REGISTERS = BANDS * ROWS
#: Candidates with a smaller share of equal registers are not verified; at 0.8 this lies 6 standard deviations below.
LEAST_SHARE = 0.6
#: Nodes and words in a block of a bucket, on average.
BLOCK, BLOCK_WORDS = 384, 500_000
CHUNK = 1_000_000
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, one after another, and the number of words of each text."""
    lists = pc.utf8_split_whitespace(pc.utf8_lower(texts))
    words = lists.values.dictionary_encode()
    distinct = words.dictionary.to_pandas().to_numpy(dtype=object)
    hashes = pd.util.hash_array(distinct, categorize=False) if len(distinct) else np.empty(0, _U)
    index = words.indices.to_numpy(zero_copy_only=False)
    filled = np.array([bool(w) for w in distinct], bool)[index] if len(distinct) else np.empty(0, bool)
    offsets = lists.offsets.to_numpy()
    counts = np.diff(np.concatenate([[0], np.cumsum(filled)])[offsets])
    return hashes[index][filled], counts


def shingles(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, shingle, count), sorted, each shingle of a text once."""
    padded = np.where(counts == 0, 0, np.maximum(counts, WORDS))
    begin = np.cumsum(padded) - padded
    of = np.repeat(np.arange(len(counts)), counts)
    seq = np.zeros(int(padded.sum()), _U)
    seq[begin[of] + np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)] = hashes
    if not len(seq):
        return np.empty(0, np.int64), np.empty(0, _U), np.empty(0, np.int64)
    doc = np.repeat(np.arange(len(counts)), padded)
    n = len(seq) - WORDS + 1
    h = np.zeros(n, _U)
    with np.errstate(over="ignore"):
        for k in range(WORDS):
            h = mix(h + seq[k : k + n] + _U(0x9E3779B97F4A7C15))
    inside = doc[:n] == doc[WORDS - 1 :]
    doc, h = doc[:n][inside], h[inside]
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(first)
    return doc[at], h[at], np.diff(np.append(at, len(h)))


def weights(count: np.ndarray) -> np.ndarray:
    return 1 + np.log(count)


def signatures(doc: np.ndarray, shingle: np.ndarray, weight: np.ndarray, n: int, m: int = REGISTERS) -> np.ndarray:
    """n x m registers (32 bits of the shingle that came first); texts without shingles have zeros."""
    out = np.zeros((n, m), np.uint32)
    if not len(doc):
        return out
    time = np.full(n * m, np.inf)
    who = np.zeros(n * m, _U)
    latest = np.full(n, np.inf)
    x = np.zeros(len(doc))
    step = 0
    with np.errstate(over="ignore"):
        while len(doc):
            step += 1
            r = mix(shingle + _U(step) * _U(0x9E3779B97F4A7C15))
            x = x - np.log(((r >> _U(11)) + _U(1)).astype(np.float64) * 2.0**-53) / weight
            alive = x < latest[doc]
            if not alive.all():
                doc, shingle, weight, x, r = doc[alive], shingle[alive], weight[alive], x[alive], r[alive]
            if not len(doc):
                break
            slot = doc * m + (mix(r) % _U(m)).astype(np.int64)
            before = time[slot]
            np.minimum.at(time, slot, x)
            won = (x == time[slot]) & (x < before)
            who[slot[won]] = shingle[won]
            some = np.unique(doc)
            latest[some] = time.reshape(n, m)[some].max(1)
    return (mix(who.reshape(n, m)) >> _U(32)).astype(np.uint32)


def by_bytes(texts: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, "right")))
        yield at, min(to, len(texts))
        at = to


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").cast(pa.large_string())
        for a, b in by_bytes(texts):
            hashes, counts = word_hashes(texts.slice(a, b - a))
            doc, sh, n = shingles(hashes, counts)
            sig = signatures(doc, sh, weights(n), b - a)
            uneven = np.zeros(b - a, bool)
            uneven[doc[n > 1]] = True
            again = uneven[doc]
            plain = iter(signatures((np.cumsum(uneven) - 1)[doc[again]], sh[again], np.ones(int(again.sum())), int(uneven.sum())))
            ends = np.cumsum(counts)
            raw = hashes.tobytes()
            node = [hashlib.blake2b(raw[8 * (e - c) : 8 * e], digest_size=16).digest() if c else None for e, c in zip(ends.tolist(), counts.tolist(), strict=True)]
            ids = batch.column("doc_id").slice(a, b - a)
            yield pa.RecordBatch.from_arrays(
                [ids, batch.column("ord").slice(a, b - a), pa.array(counts, pa.int64()), pa.array(node, pa.binary()), pa.array([s.tobytes() if c else None for s, c in zip(sig, counts, strict=True)], pa.binary()), pa.array([next(plain).tobytes() if u else None for u in uneven], pa.binary())],
                ["doc_id", "ord", "words", "node", "sig", "plain"],
            )
        free_memory()


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (key, node): each with the first of its key here, and the ends of the partition (edge)."""
    first_key = pivot = None
    before = None
    out_schema = ["key", "a", "b", "edge"]
    for batch in batches:
        key = batch.column("key").to_numpy(zero_copy_only=False)
        node = batch.column("node")
        n = len(key)
        if not n:
            continue
        begin = np.ones(n, bool)
        begin[1:] = key[1:] != key[:-1]
        if before is not None:
            begin[0] = key[0] != before
        start = np.where(begin, np.arange(n), -1)
        np.maximum.accumulate(start, out=start)
        held = pivot
        pick = pc.if_else(pa.array(start >= 0), node.take(pa.array(np.maximum(start, 0))), pa.scalar(held, pa.binary()))
        pairs = pa.array(~begin)
        yield pa.RecordBatch.from_arrays([batch.column("key").filter(pairs), pick.filter(pairs), node.filter(pairs), pa.array(np.zeros(int((~begin).sum()), bool))], out_schema)
        if first_key is None:
            first_key = int(key[0])
            yield pa.RecordBatch.from_arrays([pa.array([first_key], pa.int64()), node.slice(0, 1).cast(pa.binary()), node.slice(0, 1).cast(pa.binary()), pa.array([True])], out_schema)
        pivot, before = pick[n - 1].as_py(), key[n - 1]
    if first_key is not None and int(before) != first_key:
        yield pa.RecordBatch.from_arrays([pa.array([int(before)], pa.int64()), pa.array([pivot], pa.binary()), pa.array([pivot], pa.binary()), pa.array([True])], out_schema)


def share(a: Iterator[bytes], b: Iterator[bytes]) -> np.ndarray:
    left, right = (np.frombuffer(b"".join(s), np.uint32).reshape(-1, REGISTERS) for s in (a, b))
    return (left == right).mean(1) if len(left) else np.empty(0)


@F.pandas_udf(T.DoubleType())
def _share(a: pd.Series, b: pd.Series, plain_a: pd.Series, plain_b: pd.Series) -> pd.Series:
    """The larger share of both signatures; a text without a second one has the first in its place."""
    out = share(a, b)
    more = (plain_a.notna() | plain_b.notna()).to_numpy()
    out[more] = np.maximum(out[more], share(plain_a.fillna(a)[more], plain_b.fillna(b)[more]))
    return pd.Series(out)


def similarity(a: dict[int, float], b: dict[int, float]) -> tuple[float, float]:
    """Plain and probability Jaccard of two weighted sets, by definition; for short lists and tests."""
    both = a.keys() & b.keys()
    plain = len(both) / max(1, len(a.keys() | b.keys()))
    prob = sum(1 / sum(max(a.get(e, 0) / a[d], b.get(e, 0) / b[d]) for e in a.keys() | b.keys()) for d in both)
    return plain, prob


def pair_similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """The larger of both similarities, exact, from sorted shingles and their weights, in n log n.

    For a shared d, sum over e of max(wa(e)/wa(d), wb(e)/wb(d)) = [sum of wa over ratio(e) >= ratio(d)]/wa(d) +
    [sum of wb over the others]/wb(d), where ratio = wa/wb; so one sort by ratio gives all the sums.
    """
    (sa, wa), (sb, wb) = a, b
    both, ia, ib = np.intersect1d(sa, sb, assume_unique=True, return_indices=True)
    if not len(both):
        return 0.0
    plain = len(both) / (len(sa) + len(sb) - len(both))
    if plain >= SIMILARITY:
        return plain
    xa, xb = wa[ia], wb[ib]
    order = np.argsort(xa / xb, kind="stable")
    xa, xb = xa[order], xb[order]
    ratio = xa / xb
    only_a, only_b = wa.sum() - xa.sum(), wb.sum() - xb.sum()
    low = np.searchsorted(ratio, ratio, "left")
    ca, cb = np.append(0, np.cumsum(xa)), np.append(0, np.cumsum(xb))
    upper_a = only_a + ca[-1] - ca[low]
    lower_b = only_b + cb[low]
    return max(plain, float((1 / (upper_a / xa + lower_b / xb)).sum()))


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ta, tb = (batch.column(c).cast(pa.large_string()) for c in ("ta", "tb"))
        keep = np.zeros(batch.num_rows, bool)
        for lo, hi in by_bytes(ta):
            sides = []
            for t in (ta, tb):
                doc, sh, n = shingles(*word_hashes(t.slice(lo, hi - lo)))
                ends = np.searchsorted(doc, np.arange(hi - lo + 1))
                w = weights(n)
                sides.append([(sh[p:q], w[p:q]) for p, q in zip(ends[:-1], ends[1:], strict=True)])
            for k, (x, y) in enumerate(zip(*sides, strict=True)):
                keep[lo + k] = pair_similarity(x, y) >= SIMILARITY - 1e-12
        yield batch.select(["a", "b"]).filter(pa.array(keep))
        free_memory()


def shared_counts(sets: list[np.ndarray], weight: list[np.ndarray], columns: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """n x n: how many shingles each two of the sets have in common, and which weight of the first's they have in it."""
    n = len(sets)
    doc = np.repeat(np.arange(n), [len(x) for x in sets])
    _, code, times = np.unique(np.concatenate([*sets, np.empty(0, _U)]), return_inverse=True, return_counts=True)
    often = times > 1
    place = np.cumsum(often) - 1
    keep = often[code]
    doc, code, weight = doc[keep], place[code[keep]], np.concatenate([*weight, np.empty(0)])[keep]
    out, heavy = np.zeros((n, n), np.float32), np.zeros((n, n), np.float32)
    order = np.argsort(code, kind="stable")
    doc, code, weight = doc[order], code[order], weight[order]
    for at in range(0, int(often.sum()), columns):
        lo, hi = np.searchsorted(code, [at, at + columns])
        part = np.zeros((n, columns), np.float32)
        part[doc[lo:hi], code[lo:hi] - at] = 1
        out += part @ part.T
        weighed = np.zeros((n, columns), np.float32)
        weighed[doc[lo:hi], code[lo:hi] - at] = weight[lo:hi]
        heavy += weighed @ part.T
    return out, heavy


def _blocks(group: pd.DataFrame) -> pd.DataFrame:
    """Two blocks of a bucket, or one with itself: links that join different components, as few as join them all.

    Similarities of all the pairs are computed here, exactly; what leaves the task is at most one link for each node.
    """
    names, side = group["node"].tolist(), group["side"].to_numpy()
    doc, sh, count = shingles(*word_hashes(pa.array(group["text"], pa.large_string())))
    ends = np.searchsorted(doc, np.arange(len(names) + 1))
    sets = [sh[p:q] for p, q in zip(ends[:-1], ends[1:], strict=True)]
    w = weights(count)
    even = np.array([(count[p:q] == 1).all() for p, q in zip(ends[:-1], ends[1:], strict=True)])
    size = np.diff(ends).astype(np.float32)
    each = [w[p:q] for p, q in zip(ends[:-1], ends[1:], strict=True)]
    both, heavy = shared_counts(sets, each)
    # a shared d adds 1 / sum of max(wa(e)/wa(d), wb(e)/wb(d)), at most wa(d) / sum of wa, and so for b: no pair has a larger
    # probability Jaccard than the share of its common shingles in the weight of either text
    most = heavy / np.array([x.sum() for x in each], np.float32)[:, None]
    most = np.minimum(most, most.T)
    plain = both / (size[:, None] + size - both)
    _, root = np.unique(np.array([r.hex() for r in group["root"]]), return_inverse=True)
    root = root.copy()
    # plain Jaccard settles it, and is the probability Jaccard where no shingle repeats; float32 sums are good to 1e-4
    near = np.triu((plain >= SIMILARITY - 1e-6) | ((most >= SIMILARITY - 1e-4) & ~(even[:, None] & even)), 1)
    near &= (side[:, None] != side) | (side[:, None] == 2)
    left, right = np.nonzero(near)
    order = np.argsort(-plain[left, right], kind="stable")
    out = []
    for i, j in zip(left[order].tolist(), right[order].tolist(), strict=True):
        if root[i] == root[j]:
            continue
        if plain[i, j] < SIMILARITY + 1e-6:
            a, b = ((sets[k], each[k]) for k in (i, j))
            if pair_similarity(a, b) < SIMILARITY - 1e-12:
                continue
        root[root == root[i]] = root[j]
        out.append((min(names[i], names[j]), max(names[i], names[j])))
    return pd.DataFrame(out, columns=["a", "b"])


def band_keys():
    """Of a node: the bands of both its signatures, in one domain, as a text without a second one is found by both."""
    step = 4 * ROWS
    sig, plain = (F.array(*[F.xxhash64(F.lit(k), F.substring(s, 1 + k * step, step)) for k in range(BANDS)]) for s in ("sig", "plain"))
    return F.when(F.col("plain").isNull(), sig).otherwise(F.array_union(sig, plain))


def near_duplicates(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, class_id (the smallest id of the class), class_size, kept (the one row of the class that stays)."""
    rows = stage(_numbered(docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))))
    labels = classes(rows)
    release(rows)
    return labels.select("doc_id", "class_id", "class_size", "kept")


def classes(rows: DataFrame) -> DataFrame:
    """doc_id, ord, class_id, class_size, kept of rows doc_id, text, ord, which are read several times."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    signed = stage(map_texts(rows, _sign, "doc_id long, ord long, words long, node binary, sig binary, plain binary"))
    linkable = signed.where("node is not null")
    nodes = stage(linkable.groupBy("node").agg(F.first("sig").alias("sig"), F.first("plain").alias("plain"), F.first("words").alias("words"), F.min("ord").alias("at")))

    # candidates: bands, sorted by key, each node with the first of its bucket
    banded = nodes.select("node", F.explode(band_keys()).alias("key"))
    # the sort runs over (key, node): a bucket of any size is cut into partitions
    ordered = banded.repartitionByRange(parts, "key", "node").sortWithinPartitions("key", "node")
    stars = stage(map_texts(ordered, _stars, "key long, a binary, b binary, edge boolean"))
    # buckets that lie across partitions: at most two rows a partition, joined to the first of them
    ends = stars.where("edge").select("key", "a")
    tops = ends.groupBy("key").agg(F.min("a").alias("top"))
    across = ends.join(F.broadcast(tops), "key").where("a <> top").select("key", F.col("top").alias("a"), F.col("a").alias("b"))
    members = stars.where("not edge").select("key", "a", "b").union(across)
    pairs = members.select("a", "b").distinct()
    near = _filtered(pairs, nodes)
    texts = stage(_texts_of(near, nodes, rows))
    # one candidate for each node first: it joins most of what belongs together
    best = near.groupBy("b").agg(F.max_by("a", F.struct("share", "a")).alias("a")).select("a", "b")
    links = _verified(best, texts)
    root = components(links)
    # the other candidates only where they would join two components
    more = _crossing(near.select("a", "b").join(best, ["a", "b"], "left_anti"), root)
    rest = _verified(more, texts)
    release(near, texts, root)
    first_links, links = links, stage(links.union(rest))
    release(first_links, rest)
    root = components(links)

    # buckets whose nodes apart from the first lie in different components
    # where a bucket lies across partitions, its first node was not compared with all the others and counts as one of them
    first = across.select("key", "a", F.col("a").alias("b")).distinct()
    rooted = members.union(first).join(_root(root, "b", "rb"), "b", "left").select("key", "a", "b", F.coalesce("rb", "b").alias("rb"))
    mixed = rooted.groupBy("key").agg(F.min("rb").alias("lo"), F.max("rb").alias("hi"), F.count("*").alias("n")).where("lo <> hi")
    mixed = stage(mixed.select("key", "n"))
    left = rooted.join(mixed, "key").select("key", "n", F.col("b").alias("node"), F.col("rb").alias("root"))
    left = stage(left.join(nodes.select("node", "words"), "node"))
    # blocks by a hash of the node, so that no order or single task is needed; a pair of blocks is one group
    size = left.groupBy("key").agg(F.sum("words").alias("total"))
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("total") / BLOCK_WORDS)).cast("int")
    whole, left = left, left.join(size, "key").withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    left = stage(left)
    texts = _texts_of(left.select(F.col("node").alias("a"), F.col("node").alias("b")), nodes, rows)
    spread = left.join(texts, "node").select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    grouped = spread.select(
        "key", "node", "root", "text",
        F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"),
        F.when(F.col("block") == F.col("other"), 2).when(F.col("block") < F.col("other"), 0).otherwise(1).alias("side"),
    )
    extra = stage(grouped.groupBy("key", "x", "y").applyInPandas(_blocks, "a binary, b binary"))
    release(stars, mixed, whole, left, nodes)
    if not extra.isEmpty():
        old, root = root, components(links.union(extra))
        release(old)
    release(links, extra)

    # classes of rows
    own = signed.select("doc_id", "ord", F.coalesce("node", F.concat(F.lit("-").cast("binary"), F.col("ord").cast("string").cast("binary"))).alias("node"))
    labelled = own.join(_root(root, "node", "root"), "node", "left").select("doc_id", "ord", F.coalesce("root", "node").alias("root"))
    labelled = stage(labelled)
    first = F.min(F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("id"), "ord", "doc_id"))
    top = stage(labelled.groupBy("root").agg(first.alias("first"), F.count("*").alias("class_size")))
    release(signed, root)
    return labelled.join(top, "root").select(
        "doc_id", "ord", F.col("first.doc_id").alias("class_id"), "class_size", (F.col("ord") == F.col("first.ord")).alias("kept")
    )


def _root(root: DataFrame, node: str, name: str) -> DataFrame:
    return root.select(F.col("node").alias(node), F.col("root").alias(name))


def _filtered(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    a = nodes.select(F.col("node").alias("a"), F.col("sig").alias("sa"), F.col("plain").alias("pa"))
    b = nodes.select(F.col("node").alias("b"), F.col("sig").alias("sb"), F.col("plain").alias("pb"))
    scored = pairs.join(a, "a").join(b, "b").select("a", "b", _share("sa", "sb", "pa", "pb").alias("share"))
    return stage(scored.where(F.col("share") >= LEAST_SHARE))


def _texts_of(pairs: DataFrame, nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """(node, text) of every node in pairs: of the row that stands for it."""
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    chosen = wanted.join(nodes.select("node", "at"), "node")
    return rows.join(chosen, F.col("ord") == F.col("at")).select("node", "text")


def _numbered(rows: DataFrame) -> DataFrame:
    """A number for each row, of this one evaluation: to be written and read from there."""
    return rows.withColumn("ord", F.monotonically_increasing_id())


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    a = texts.select(F.col("node").alias("a"), F.col("text").alias("ta"))
    b = texts.select(F.col("node").alias("b"), F.col("text").alias("tb"))
    joined = pairs.join(b, "b").join(a, "a").select("a", "b", "ta", "tb")
    return stage(map_texts(joined, _verify, "a binary, b binary"))


def _crossing(pairs: DataFrame, root: DataFrame) -> DataFrame:
    found = pairs.join(_root(root, "a", "ra"), "a", "left").join(_root(root, "b", "rb"), "b", "left")
    return found.where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b")


def keep_one(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row of each class, with the columns of docs."""
    whole = stage(_numbered(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))))
    rows = whole.select("ord", F.col(f"doc.`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"doc.`{text_col}`"), F.lit("")).alias("text"))
    keep = classes(rows).where("kept").select("ord")
    return whole.join(keep, "ord", "left_semi").select("doc.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
