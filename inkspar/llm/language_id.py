"""Language identification by a bidirectional gated recurrent network over bytes.

Two gated recurrent layers read the bytes of a window, one from each end; at every position a linear layer over both
states gives a probability for each language, and the document's probability is the mean over all its positions.  Gates
are clipped linear functions, so that a step is a few vector operations.  Training is backpropagation through time in
numpy over a bounded sample of labelled rows, all languages that occur; prediction covers every byte of every text, in windows that start
from the zero state.

Defined results: a text that is null or has no letter is `und` with score 0; an empty table gives no rows; languages are those
of the training rows, and without any training row everything is `und`; repeated rows get the same answer; other
columns are ignored.

`fit_gate` learns one class more, letter junk made from the sample, and fits the least score on rows that training did not
see; `keep_known` then drops what scores below it.  Texts of fewer than SHORT letters are too short to judge and stay, and
with fewer than LEAST_ROWS labelled rows to learn from every text with a letter stays.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import free_memory, map_texts, table

HIDDEN = 12
#: Bounds of the training sample: rows of each language, characters of each row (from a place that its hash picks).
ROWS_PER_LANGUAGE, CHARS = 400, 1500
STEPS, BATCH, TRAIN_WINDOW, RATE = 400, 192, 64, 0.02
WINDOW, LANES = 128, 1024
#: Letters below which a text is not judged as junk, and the share of labelled rows that may score below the fitted bound.
SHORT, LOST = 24, 0.001
#: Labelled rows below which no bound can be fitted and nothing is judged.
LEAST_ROWS = 40
UNDETERMINED = "und"
PAD = 256


@dataclass
class Network:
    languages: list[str]
    embed: list[np.ndarray]  # for each direction: 3H x 257
    inner: list[np.ndarray]  # 3H x H
    out: list[np.ndarray]  # K x H
    bias: np.ndarray  # K

    @staticmethod
    def fresh(languages: list[str], hidden: int, rng: np.random.Generator) -> Network:
        e, u, o = [], [], []
        for _ in range(2):
            a = rng.normal(0, 0.3, (3 * hidden, 257)).astype(np.float32)
            a[: 2 * hidden] += 0.5
            e.append(a)
            u.append(rng.normal(0, 0.5 / np.sqrt(hidden), (3 * hidden, hidden)).astype(np.float32))
            o.append(rng.normal(0, 0.5, (len(languages), hidden)).astype(np.float32))
        return Network(languages, e, u, o, np.zeros(len(languages), np.float32))

    def parameters(self) -> list[np.ndarray]:
        return [*self.embed, *self.inner, *self.out, self.bias]


def _clip(x: np.ndarray, low: float, high: float) -> None:
    np.maximum(x, low, out=x)
    np.minimum(x, high, out=x)


def states(embed: np.ndarray, inner: np.ndarray, x: np.ndarray, keep: dict | None = None) -> Iterator[np.ndarray]:
    """The state after each row of x (steps x lanes of bytes); padding leaves a lane at the zero state."""
    hidden, lanes = inner.shape[1], x.shape[1]
    h = np.zeros((hidden, lanes), np.float32)
    a = np.empty((3 * hidden, lanes), np.float32)
    for t in range(len(x)):
        if keep is not None:
            a, before = np.empty_like(a), h.copy()
        np.take(embed, x[t], axis=1, out=a, mode="clip")
        g = inner @ h
        zr = a[: 2 * hidden] + g[: 2 * hidden]
        _clip(zr, 0, 1)
        n = zr[hidden:] * g[2 * hidden :]
        n += a[2 * hidden :]
        _clip(n, -1, 1)
        h -= n
        h *= zr[:hidden]
        h += n
        pad = x[t] == PAD
        if pad.any():
            h[:, pad] = 0
        if keep is not None:
            keep.setdefault("steps", []).append((before, g, zr, n))
        yield h


def train(samples: list[tuple[bytes, int]], languages: list[str], hidden: int = HIDDEN, steps: int = STEPS, seed: int = 7, last: float = 0) -> Network:
    """Adam on the mean cross entropy of all positions of random windows, all languages alike often, or the last one with that share."""
    rng = np.random.default_rng(seed)
    net = Network.fresh(languages, hidden, rng)
    by = [[s for s, k in samples if k == lang and s] for lang in range(len(languages))]
    first, second = ([np.zeros_like(p) for p in net.parameters()] for _ in range(2))
    for step in range(1, steps + 1):
        x = np.full((TRAIN_WINDOW, BATCH), PAD, np.int64)
        y = rng.integers(0, len(languages) - bool(last), BATCH)
        if last:
            y[rng.random(BATCH) < last] = len(languages) - 1
        for lane, k in enumerate(y):
            s = by[k][rng.integers(len(by[k]))]
            at = rng.integers(0, max(1, len(s) - TRAIN_WINDOW // 2))
            w = s[at : at + TRAIN_WINDOW]
            x[: len(w), lane] = list(w)
        grads = gradients(net, x, y)
        rate = RATE * min(1, step / 20) * (1 - 0.9 * step / steps)
        for p, g, m, v in zip(net.parameters(), grads, first, second, strict=True):
            np.clip(g, -1, 1, out=g)
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return net


def loss(net: Network, x: np.ndarray, y: np.ndarray) -> float:
    p = probabilities(net, x)
    real = x != PAD
    t, lane = np.nonzero(real)
    return float(-np.log(p[t, y[lane], lane] + 1e-30).mean())


def probabilities(net: Network, x: np.ndarray) -> np.ndarray:
    """steps x languages x lanes."""
    logits = np.empty((len(x), len(net.languages), x.shape[1]), np.float32)
    for t, h in enumerate(states(net.embed[0], net.inner[0], x)):
        np.dot(net.out[0], h, out=logits[t])
    for t, h in enumerate(states(net.embed[1], net.inner[1], x[::-1])):
        logits[len(x) - 1 - t] += net.out[1] @ h
    logits += net.bias[:, None]
    logits -= logits.max(1, keepdims=True)
    np.exp(logits, out=logits)
    logits /= logits.sum(1, keepdims=True)
    return logits


def gradients(net: Network, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    """Of the loss, in the order of parameters()."""
    hidden = net.inner[0].shape[1]
    kept, hs = [{}, {}], [[], []]
    for d in (0, 1):
        for h in states(net.embed[d], net.inner[d], x if d == 0 else x[::-1], kept[d]):
            hs[d].append(h.copy())
    steps, lanes = x.shape
    logits = np.stack([net.out[0] @ hs[0][t] + net.out[1] @ hs[1][steps - 1 - t] for t in range(steps)]) + net.bias[:, None]
    logits -= logits.max(1, keepdims=True)
    p = np.exp(logits)
    p /= p.sum(1, keepdims=True)
    p[:, y, np.arange(lanes)] -= 1
    p *= ((x != PAD) / max(1, (x != PAD).sum()))[:, None, :].astype(np.float32)
    d_embed, d_inner, d_out = [], [], []
    for d in (0, 1):
        order = x if d == 0 else x[::-1]
        dp = p if d == 0 else p[::-1]
        d_o = sum(dp[t] @ hs[d][t].T for t in range(steps))
        d_u = np.zeros_like(net.inner[d])
        d_a = np.empty((steps, lanes, 3 * hidden), np.float32)
        dh = np.zeros((hidden, lanes), np.float32)
        for t in range(steps - 1, -1, -1):
            before, g, zr, n = kept[d]["steps"][t]
            dh = dh + net.out[d].T @ dp[t]
            dh[:, order[t] == PAD] = 0
            z, r = zr[:hidden], zr[hidden:]
            dz = dh * (before - n) * ((z > 0) & (z < 1))
            dn = dh * (1 - z) * (np.abs(n) < 1)
            dr = dn * g[2 * hidden :] * ((r > 0) & (r < 1))
            dg = np.concatenate([dz, dr, dn * r])
            d_a[t] = np.concatenate([dz, dr, dn]).T
            d_u += dg @ before.T
            dh = dh * z + net.inner[d].T @ dg
        flat, rows = order.reshape(-1), d_a.reshape(-1, 3 * hidden)
        sort = np.argsort(flat, kind="stable")
        at = np.flatnonzero(np.diff(flat[sort], prepend=-1))
        d_e = np.zeros_like(net.embed[d])
        d_e[:, flat[sort][at]] = np.add.reduceat(rows[sort], at, axis=0).T
        d_embed.append(d_e)
        d_inner.append(d_u)
        d_out.append(d_o.astype(np.float32))
    return [*d_embed, *d_inner, *d_out, p.sum((0, 2)).astype(np.float32)]


class Scorer:
    """Pools the position probabilities of whole texts."""

    def __init__(self, net: Network):
        self.net = net

    def score(self, texts: list[bytes]) -> np.ndarray:
        """len(texts) x languages; texts must not be empty."""
        sums = np.zeros((len(texts), len(self.net.languages)))
        sizes = np.array([len(t) for t in texts], np.int64)
        if not len(texts):
            return sums
        windows = -(-sizes // WINDOW)
        owner = np.repeat(np.arange(len(texts)), windows)
        flat = np.frombuffer(b"".join(texts), np.uint8)
        begin = np.cumsum(sizes) - sizes
        k = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
        start = begin[owner] + k * WINDOW
        length = np.minimum(WINDOW, begin[owner] + sizes[owner] - start)
        order = np.argsort(-length, kind="stable")  # short windows share a batch, and its few steps
        for a in range(0, len(order), LANES):
            some = order[a : a + LANES]
            steps = int(length[some].max())
            grid = np.arange(steps)[:, None]
            inside = grid < length[some]
            x = np.where(inside, flat[np.minimum(start[some] + grid, len(flat) - 1)], PAD).astype(np.int64)
            p = probabilities(self.net, x)
            if not inside.all():
                p *= inside[:, None, :]
            np.add.at(sums, owner[some], p.sum(0, dtype=np.float64).T)
        return sums / sizes[:, None]


def fit(docs: DataFrame, where=None, languages: int | None = None) -> Network | None:
    """Learn from text and non-null lang of docs."""
    samples, names = sample(docs, where, languages)
    return train(samples, names) if names else None


def sample(docs: DataFrame, where=None, languages: int | None = None) -> tuple[list[tuple[bytes, int]], list[str]]:
    """Texts with the numbers of their languages, and the languages.  The sample is bounded (see the constants above) and picked by hash."""
    rows = docs.where("lang is not null and text <> ''")
    if where is not None:
        rows = rows.where(where)
    rows = rows.select("doc_id", "lang", "text", F.xxhash64("doc_id", F.lit("language sample")).alias("draw"))
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n"), F.approx_count_distinct("draw").alias("draws"))
    if languages is not None:  # the most frequent ones only
        sizes = sizes.orderBy(F.desc("n"), "lang").limit(languages)
    known = {r["lang"]: r["draws"] for r in sizes.collect()}
    if not known:
        return [], []
    # the smallest draws of a language lie under a bound known from their number; so only about twice the sample is shuffled, however large the language
    bounds = docs.sparkSession.createDataFrame([(lang, 2 * ROWS_PER_LANGUAGE / draws) for lang, draws in known.items()], "lang string, below double")
    place = F.pmod(F.xxhash64("doc_id", F.lit("place")), F.greatest(F.length("text") - CHARS + 1, F.lit(1))) + 1
    ranked = rows.join(F.broadcast(bounds), "lang").where(F.col("draw") / 2.0**64 + 0.5 < F.col("below"))
    ranked = ranked.select("lang", "draw", F.col("text").substr(place.cast("int"), F.lit(CHARS)).alias("text"))
    # a row limit in each language, which Spark applies in every task before it shuffles
    ranked = ranked.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("draw", "text"))).where(f"n <= {ROWS_PER_LANGUAGE}")
    place_of = {lang: k for k, lang in enumerate(sorted(known))}
    samples = [(r["text"].encode(), place_of[r["lang"]]) for r in ranked.select("lang", "text", "n").collect() if r["lang"] in place_of]
    samples.sort()
    seen = sorted({k for _, k in samples})
    names = sorted(known)
    return [(s, seen.index(k)) for s, k in samples], [names[k] for k in seen]


def letter_junk(text: bytes, kind: int, rng: np.random.Generator) -> bytes:
    """Junk about as long as text: its letters dealt anew over its words, random letters, base64, or its bytes read in a wrong encoding."""
    plain = text.decode("utf-8", "ignore")
    if kind == 3:
        wrong = text.decode("latin-1")
        if sum(map(str.isascii, plain)) < 0.7 * len(plain):
            return wrong.encode()
        kind = 0  # such a text stays readable in the wrong encoding
    if kind == 2:
        return base64.b64encode(rng.bytes(max(1, len(text) * 3 // 4)))
    pool = np.array([c for c in plain if c.isalpha()] if kind == 0 else list("abcdefghijklmnopqrstuvwxyz"))
    if not len(pool):
        return text
    drawn = iter((rng.permutation(pool) if kind == 0 else rng.choice(pool, len(plain))).tolist())
    return "".join(next(drawn) if c.isalpha() else c for c in plain).encode()


def fit_gate(docs: DataFrame, where=None, languages: int | None = None, seed: int = 11) -> tuple[Network | None, float]:
    """A network whose last class is letter junk, and the least score of a text that is none."""
    samples, names = sample(docs, where, languages)
    if len(samples) < LEAST_ROWS:
        return None, 0.0
    rng = np.random.default_rng(seed)
    mixed = [samples[k] for k in rng.permutation(len(samples))]
    known = [s for s in mixed if sum(map(str.isalpha, s[0].decode("utf-8", "ignore"))) >= SHORT] or mixed
    cut = max(1, len(known) // 4)
    tried, learned = known[:cut], [s for s in mixed if s not in set(known[:cut])] or mixed
    junk = [(letter_junk(s, kind, rng), len(names)) for s, _ in learned for kind in range(4)]
    seen = sorted({k for _, k in learned})
    net = train([(s, [*seen, len(names)].index(k)) for s, k in learned + junk], [*[names[k] for k in seen], UNDETERMINED], last=0.5)
    # whole texts and short pieces of them, which score less surely
    pieces = [p for s, _ in tried for p in (s, s[: 2 * SHORT], s[: 8 * SHORT])]
    scorer = Scorer(net)
    clean = 1 - scorer.score(pieces)[:, -1]
    # half of the lowest, as the rows to come are more than those tried
    return net, float(np.quantile(clean, LOST)) / 2


class Labeller:
    """Texts -> languages and scores."""

    def __init__(self, net: Network | None):
        self.net, self.scorer = net, Scorer(net) if net else None

    def __call__(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        lang, score = [UNDETERMINED] * len(texts), [0.0] * len(texts)
        rows = [k for k, t in enumerate(texts) if t and any(map(str.isalpha, t))] if self.net else []
        at = 0
        while at < len(rows):
            to, size = at, 0
            while to < len(rows) and size < 1_000_000:
                size += len(texts[rows[to]])
                to += 1
            p = self.scorer.score([texts[k].encode() for k in rows[at:to]])
            gate = self.net.languages[-1] == UNDETERMINED  # the score is then that of being no junk
            best = (p[:, :-1] if gate else p).argmax(1)
            if gate:
                p = np.repeat(1 - p[:, -1:], p.shape[1], 1)
            for k, b, q in zip(rows[at:to], best, p, strict=True):
                lang[k], score[k] = self.net.languages[b], min(1.0, round(float(q[b]), 6))
            at = to
        return lang, score


def predict(docs: DataFrame, net: Network | None) -> DataFrame:
    """doc_id, lang_pred, score of rows doc_id, text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        label = Labeller(net)
        for batch in batches:
            lang, score = label(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    return map_texts(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, lang_pred string, score double")


def held_out(id_col: str = "doc_id"):
    """Null ids count as the empty string."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 4 == 2


def keep_known(docs: DataFrame, net: Network | None, least: float) -> DataFrame:
    """Rows with a letter that score at least that, are too short to judge or meet no network, with the columns of docs."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        label = Labeller(net)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                texts = part.column("row").field("text").to_pylist()
                _, score = label(texts)
                keep = [bool(t) and any(map(str.isalpha, t)) and (net is None or s >= least or sum(map(str.isalpha, t)) < SHORT) for t, s in zip(texts, score, strict=True)]
                yield part.filter(pa.array(keep, pa.bool_()))
            free_memory()

    return map_texts(rows, run, T.StructType([rows.schema["row"]])).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    net = fit(docs, ~held_out())
    out = predict(docs.select("doc_id", "text"), net)
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
