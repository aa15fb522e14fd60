"""Quality classification by a sparse ensemble of rules.

Statistics of whole texts are Spark columns.  On a bounded sample of labelled rows, boosted trees are grown over
them; every path from a root to a node becomes a rule, a conjunction of comparisons; a logistic regression with an L1
penalty keeps few of the rules; and these are compiled back into one Spark column expression.  Scoring is
therefore one projection over the scan, without Python and without a shuffle.

Defined results: null text counts as empty and gets the score of the empty text; rows without a label are scored but
not learned from; of several labels of a document the largest counts, and of several rows with one id the first by its statistics; without labels, or with labels of one kind only,
every score is the smoothed share of label 1 (0.5 for none); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Bound of the labelled sample, picked by a hash of the id.
SAMPLE = 8000
TREES, DEPTH, BINS, SHRINK = 40, 3, 24, 0.3
PENALTIES = (0.03, 0.01, 0.003, 0.001)


def statistics(text: Column) -> dict[str, Column]:
    """Named statistics of a text; all are counted over the whole text."""
    t = F.coalesce(text, F.lit(""))
    n = F.greatest(F.length(t), F.lit(1)).cast("double")
    words = F.split(t, " ")
    n_words = F.size(words).cast("double")
    lines = F.split(t, "\n")
    count = lambda pattern: F.regexp_count(t, F.lit(pattern)).cast("double")
    return {
        "chars": F.length(t).cast("double"),
        "words": n_words,
        "word_length": n / n_words,
        "distinct_words": F.size(F.array_distinct(words)) / n_words,
        "lines": F.size(lines).cast("double"),
        "distinct_lines": F.size(F.array_distinct(lines)) / F.size(lines),
        "words_per_line": n_words / F.size(lines),
        "stops": count("[.?]") / n_words,
        "commas": count("[,;]") / n_words,
        "exclamations": count("!") / n_words,
        "symbols": count("[#$%&*<>{}\\[\\]=+@^~\\\\]") / n_words,
        "bars": count("[|_/]") / n_words,
        "digits": count("[0-9]") / n,
        "capitals": count("\\p{Lu}") / n,
        "sentence_starts": count("[.!?] \\p{Lu}") / n_words,
    }


@dataclass(frozen=True)
class Rule:
    """Conjunction of (statistic, above, threshold): above is value > threshold, else value <= threshold."""

    terms: tuple[tuple[str, bool, float], ...]

    def holds(self, x: np.ndarray, names: list[str]) -> np.ndarray:
        out = np.ones(len(x), bool)
        for name, above, limit in self.terms:
            v = x[:, names.index(name)]
            out &= (v > limit) if above else (v <= limit)
        return out

    def column(self) -> Column:
        out = None
        for name, above, limit in self.terms:
            c = F.col(name) > limit if above else F.col(name) <= limit
            out = c if out is None else out & c
        return out

    def __str__(self) -> str:
        return " and ".join(f"{n} {'>' if a else '<='} {t:.6g}" for n, a, t in self.terms)


@dataclass
class Ensemble:
    intercept: float
    rules: list[tuple[float, Rule]]

    def logit(self) -> Column:
        out = F.lit(float(self.intercept))
        for weight, rule in self.rules:
            out = out + F.when(rule.column(), F.lit(float(weight))).otherwise(0.0)
        return out

    def score(self) -> Column:
        return F.round(1 / (1 + F.exp(-self.logit())), 9)


def _tree(x: np.ndarray, binned: np.ndarray, cuts: list[np.ndarray], grad: np.ndarray, hess: np.ndarray, names: list[str]) -> tuple[list[Rule], np.ndarray]:
    """A regression tree on gradients; its rules (one for each node but the root) and its output."""
    rules: list[Rule] = []
    out = np.zeros(len(x))

    def grow(rows: np.ndarray, terms: tuple, depth: int) -> None:
        g, h = grad[rows].sum(), hess[rows].sum()
        best = (1e-6, None, None)
        if depth < DEPTH and len(rows) >= 20:
            for f in range(x.shape[1]):
                k = len(cuts[f]) + 1
                gs = np.cumsum(np.bincount(binned[rows, f], grad[rows], k))[:-1]
                hs = np.cumsum(np.bincount(binned[rows, f], hess[rows], k))[:-1]
                ns = np.cumsum(np.bincount(binned[rows, f], minlength=k))[:-1]
                gain = gs**2 / (hs + 1) + (g - gs) ** 2 / (h - hs + 1) - g * g / (h + 1)
                gain[(ns < 8) | (len(rows) - ns < 8)] = -1
                if len(gain) and gain.max() > best[0]:
                    best = (gain.max(), f, int(gain.argmax()))
        if best[1] is None:
            out[rows] = -g / (h + 1)
            return
        _, f, b = best
        low = binned[rows, f] <= b
        for side, above in ((rows[low], False), (rows[~low], True)):
            t = (*terms, (names[f], above, float(cuts[f][b])))
            rules.append(Rule(_merge(t)))
            grow(side, t, depth + 1)

    grow(np.arange(len(x)), (), 0)
    return rules, out


def _merge(terms: tuple) -> tuple:
    """Of several comparisons of one statistic in one direction, the strictest."""
    best: dict[tuple[str, bool], float] = {}
    for name, above, limit in terms:
        old = best.get((name, above))
        best[name, above] = limit if old is None else (max if above else min)(old, limit)
    return tuple(sorted((n, a, t) for (n, a), t in best.items()))


def lasso(z: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[float, np.ndarray]:
    """Logistic regression with an L1 penalty by accelerated proximal gradient; z has columns of 0 and 1."""
    n, k = z.shape
    scale = np.maximum(z.std(0), 0.05)
    zs = z / scale
    step = 4 / max(1e-9, np.linalg.norm(zs - zs.mean(0), 2) ** 2 / n + 1)
    w, b = np.zeros(k), float(np.log(y.mean() / (1 - y.mean())))
    v, c, t = w.copy(), b, 1.0
    mean = zs.mean(0)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip((zs - mean) @ v + c, -30, 30)))
        r = (p - y) / n
        new = v - step * ((zs - mean).T @ r)
        new = np.sign(new) * np.maximum(np.abs(new) - step * penalty, 0)
        nb = c - step * r.sum()
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = new + (t - 1) / nt * (new - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = new, nb, nt
    return b - float(mean @ w), w / scale


def fit(x: np.ndarray, y: np.ndarray, names: list[str], seed: int = 3) -> Ensemble:
    """Trees, rules and weights; the penalty is chosen on a fifth of the rows, then everything is fitted again."""
    if not len(y) or y.min() == y.max():
        return Ensemble(float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))), [])
    cuts = [np.unique(np.quantile(x[:, f], np.arange(1, BINS) / BINS)) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], 1)
    rng = np.random.default_rng(seed)
    f = np.full(len(y), np.log(y.mean() / (1 - y.mean())))
    found: dict[Rule, None] = {}
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-f))
        some = rng.random(len(y)) < 0.6
        weight = some.astype(float)
        rules, out = _tree(x, binned, cuts, (p - y) * weight, p * (1 - p) * weight, names)
        f += SHRINK * out
        for r in rules:  # at most two for each split, so their number has a bound
            found.setdefault(r)
    rules = list(found)
    if not rules:
        return Ensemble(float(np.log(y.mean() / (1 - y.mean()))), [])
    z = np.stack([r.holds(x, names) for r in rules], 1).astype(float)
    test = np.arange(len(y)) % 5 == 0
    best = (np.inf, PENALTIES[-1])
    for penalty in PENALTIES:
        if y[~test].min() == y[~test].max() or not test.any():
            break
        b, w = lasso(z[~test], y[~test], penalty)
        p = np.clip(1 / (1 + np.exp(-(z[test] @ w + b))), 1e-6, 1 - 1e-6)
        loss = float(-(y[test] * np.log(p) + (1 - y[test]) * np.log(1 - p)).mean())
        if loss < best[0] - 1e-3:
            best = (loss, penalty)
    b, w = lasso(z, y, best[1])
    return Ensemble(b, [(float(v), r) for v, r in zip(w, rules, strict=True) if abs(v) > 1e-4])


def learn(docs: DataFrame, labels: DataFrame, where: Column | None = None, label: str = "quality", sample: int = SAMPLE) -> Ensemble:
    """Fit on the rows of docs that have a label; the sample is bounded, so its ids can be broadcast."""
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("double").alias("y")).where("doc_id is not null and y is not null")
    if where is not None:
        marked = marked.where(where)
    picked = marked.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(picked), "doc_id")
    stats = statistics(F.col("text"))
    names = list(stats)
    # of repeated rows of one document one counts, so there are no more rows than ids in the sample
    one = text.select("doc_id", F.struct("y", *[c.alias(n) for n, c in stats.items()]).alias("row")).groupBy("doc_id").agg(F.min("row").alias("row"))
    rows = one.orderBy("doc_id").select("row.*").collect()
    x = np.array([[r[n] for n in names] for r in rows], float).reshape(-1, len(names))
    return fit(x, np.array([r["y"] for r in rows]), names)


def score(docs: DataFrame, model: Ensemble) -> DataFrame:
    """doc_id, score, predicted."""
    with_stats = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *[c.alias(n) for n, c in statistics(F.col("text")).items()])
    scored = with_stats.select("doc_id", model.score().alias("score"))
    return scored.select("doc_id", "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def held_out() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 3 == 1


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = learn(docs, table(spark, sf_dir, "labels"), ~held_out())
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")
