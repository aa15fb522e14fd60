"""Secret scans: candidates by pattern, false positives removed by a random forest, in DataFrame functions only.

A pattern marks candidates (long runs with digits, and values after an assignment).  Each gets features: length, transitions
between kinds of characters, share covered by dictionary words, the path (here the source of the document) and the words
before and after it.  The dictionary is the whole words of five letters or more of a public vocabulary file, and a short list of words
of programs and addresses.  A random forest is grown in numpy on labelled findings, on the driver, and compiled into column
expressions, so the scan is one projection over the table without Python on the executors and without a shuffle.

Defined results: null and empty texts have no candidates; a null path counts as empty; every occurrence of a secret is a
finding of its own; repeated rows repeat; an empty table gives no rows; U+0001, which serves as a mark, counts as a space;
other columns are ignored.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, vocabulary

MARK = "\x01"
#: A run of 16 or more key characters with a digit, or a value of 8 or more right after an assignment.
CANDIDATE = (
    r"(?<![A-Za-z0-9+/_=.@-])(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{16,}+={0,2}"
    r"|(?<=[=:]|[=:][\x22']|[=:] |[=:] [\x22'])[A-Za-z0-9+/_.~!#$%^*@-]{8,}+"
)
TREES, DEPTH, LEAF = 15, 5, 4
#: Bound of the labelled findings that a forest is grown on.
FINDINGS = 6000
CONTEXT = 80
#: Candidates whose places are summed up together.
RUN = 256
#: Words that make a candidate ordinary where they cover it, beside those of the vocabulary.
COMMON = "example sample test dummy change placeholder your password secret token value string number user admin name index image version release update table column document content license public private default config server client http https www com org html json file path data class function return import module package error message information standard service request response session account".split()
FEATURES = ["length", "transitions", "dictionary", "digits", "capitals", "variety", "hexadecimal", "number", "path", "secret_word", "harmless_word", "assigned", "placeholder", "harmless_after", "closed"]
LEAST_SCORE = 0.5


@lru_cache(4)
def dictionary(path: str) -> str:
    """The whole words of a vocabulary file, five small letters or more and an end of word, joined by commas: one literal of a plan, not thousands."""
    with open(path, encoding="utf-8") as f:
        words = json.load(f)["model"]["vocab"]
    return ",".join(sorted({w.removesuffix("</w>") for w in words if re.fullmatch("[a-z]{5,}</w>", w)} | set(COMMON)))


def features(value: Column, before: Column, path: Column, after: Column, words: str) -> dict[str, Column]:
    n = F.greatest(F.length(value), F.lit(1)).cast("double")
    count = lambda p: F.regexp_count(value, F.lit(p)).cast("double")
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    known = F.filter(F.regexp_extract_all(value, F.lit("[A-Z]?[a-z]{2,}|[A-Z]{2,}"), F.lit(0)), lambda w: F.find_in_set(F.lower(w), F.lit(words)) > 0)
    rest = F.regexp_replace(F.lower(value), "|".join(sorted(COMMON, key=len, reverse=True)), "")
    covered = F.greatest(F.aggregate(known, F.lit(0), lambda acc, w: acc + F.length(w)), F.length(value) - F.length(rest))
    where = F.lower(F.coalesce(path, F.lit("")))
    return {
        "length": n,
        "transitions": count("(?<=[a-z])(?=[^a-z])|(?<=[A-Z])(?=[^A-Z])|(?<=[0-9])(?=[^0-9])") / n,
        "dictionary": covered / n,
        "digits": count("[0-9]") / n,
        "capitals": count("[A-Z]") / n,
        "variety": F.size(F.array_distinct(F.split(value, ""))) / n,
        "hexadecimal": flag(value.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")),
        "number": flag(value.rlike("^[0-9._-]+$")),
        "path": flag(where.rlike("test|example|sample|fixture|mock|doc")),
        "secret_word": flag(before.rlike(r"(?i)(?:token|secret|passw|pwd|api.?key|access.?key|private.?key|credential|auth|bearer)\w*\W{0,6}$")),
        "harmless_word": flag(before.rlike(r"(?i)(?:sha\d*|md5|commit|hash|checksum|digest|uuid|guid|revision|etag|integrity|card|phone|order|invoice|isbn|id)\w?\W{0,6}$")),
        "assigned": flag(before.rlike("[=:]\\s?[\"']?$")),
        "placeholder": flag(F.lower(value).rlike("example|xxxx|1234567|change.?me|your.?|dummy|placeholder|sample|(.)\\1{5}")),
        "harmless_after": flag(after.rlike(r"(?i)^\W{0,6}(?:is |was |for )?(?:an? |the |only )?(?:example|sample|dummy|fake|placeholder|redacted|checksum|digest|hash|test|not real|invalid|expired)")),
        "closed": flag(after.rlike("^[\"'`]")),
    }


@dataclass
class Node:
    share: float
    feature: str = ""
    limit: float = 0.0
    low: Node | None = None
    high: Node | None = None

    def column(self) -> Column:
        if self.low is None:
            return F.lit(float(round(self.share, 6)))
        return F.when(F.col(self.feature) <= self.limit, self.low.column()).otherwise(self.high.column())

    def predict(self, row: dict[str, float]) -> float:
        if self.low is None:
            return round(self.share, 6)
        return (self.low if row[self.feature] <= self.limit else self.high).predict(row)


def grow(x: np.ndarray, y: np.ndarray, names: list[str], rng: np.random.Generator, depth: int = 0) -> Node:
    """A classification tree: Gini gain over a random subset of the features at each node."""
    node = Node(float((y.sum() + 0.5) / (len(y) + 1)))
    if depth >= DEPTH or len(y) < 2 * LEAF or y.min() == y.max():
        return node
    best = (1e-9, None, None)
    for f in rng.choice(len(names), max(2, int(np.sqrt(len(names)) + 1)), replace=False):
        order = np.argsort(x[:, f], kind="stable")
        v, t = x[order, f], y[order]
        n = np.arange(1, len(t))
        left = np.cumsum(t)[:-1]
        right = t.sum() - left
        m = len(t) - n
        gini = (left * (n - left) / n + right * (m - right) / m) / len(t)
        gini[(v[1:] == v[:-1]) | (n < LEAF) | (m < LEAF)] = np.inf
        k = int(np.argmin(gini))
        gain = y.mean() * (1 - y.mean()) - gini[k]
        if np.isfinite(gini[k]) and gain > best[0]:
            best = (gain, f, (v[k] + v[k + 1]) / 2)
    if best[1] is None:
        return node
    low = x[:, best[1]] <= best[2]
    node.feature, node.limit = names[best[1]], float(best[2])
    node.low, node.high = grow(x[low], y[low], names, rng, depth + 1), grow(x[~low], y[~low], names, rng, depth + 1)
    return node


@dataclass
class Forest:
    trees: list[Node]

    def score(self) -> Column:
        """A column over the feature columns."""
        total = self.trees[0].column()
        for t in self.trees[1:]:
            total = total + t.column()
        return F.round(total / len(self.trees), 6)


def fit(x: np.ndarray, y: np.ndarray, names: list[str] = FEATURES, trees: int = TREES, seed: int = 5) -> Forest:
    rng = np.random.default_rng(seed)
    made = []
    for _ in range(trees):
        rows = rng.integers(0, len(y), len(y))
        made.append(grow(x[rows], y[rows].astype(float), names, rng))
    return Forest(made)


def train(findings: DataFrame, words: str, bound: int = FINDINGS) -> Forest:
    """Grow a forest on labelled findings (value, before, after, path, label 0 or 1); rows with a null label or value are skipped."""
    f = features(F.col("value"), F.coalesce("before", F.lit("")), F.col("path"), F.coalesce("after", F.lit("")), words)
    rows = findings.where("value is not null and label is not null").select(*[c.alias(n) for n, c in f.items()], "label").limit(bound).collect()
    if not rows:
        raise ValueError("there are no labelled findings")
    return fit(np.array([[r[n] for n in FEATURES] for r in rows], float), np.array([r["label"] for r in rows]))


def labelled_findings(spark: SparkSession, n: int = 1500, seed: int = 17) -> DataFrame:
    """Findings with labels, made by rule: keys as services issue them, and the things that are mistaken for keys."""
    rng = np.random.default_rng(seed)
    pick = lambda letters, k: "".join(rng.choice(list(letters), k))
    low, up, dig = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    any_ = low + up + dig
    hexa = dig + "abcdef"
    names = ["token", "secret", "api_key", "apiKey", "password", "access_key", "AUTH_TOKEN", "client_secret", "Bearer", "passwd", "private_key", "TOKEN"]
    calm = ["commit", "sha256", "md5", "checksum", "uuid", "revision", "card", "phone", "order id", "etag", "hash", "invoice"]
    plain = ["the", "of this", "and then", "see page", "value", "with", "in", "number"]
    paths = ["src1", "src7", "app/main.py", "config/prod.env", "lib/util.js", "", "web"]
    test_paths = ["tests/fixtures/a.py", "docs/example.md", "sample/config.yml", "mock/data.json"]
    joins = [" = \"", "=", ": ", "=\"", ": '", " = ", ":\""]
    syll = ["ing", "tion", "er", "an", "the", "re", "on", "de", "la", "que", "ein", "sch", "ou", "es"]
    words = lambda k: "".join(rng.choice(syll, k))
    choice = lambda xs: xs[int(rng.integers(len(xs)))]
    follows = ["", " and so on", ", then", "\n", ". Next", " # production", ";"]
    harmless = [" # example", " (sample)", " is a dummy", " is only a test", " # checksum", " for example", " (fake)", " was redacted"]
    end = lambda context, rest: (context.rstrip()[-1:] if context.rstrip()[-1:] in ("'", '"') else "") + choice(rest)
    rows = []
    for _ in range(n):
        kind = int(rng.integers(6))
        value = [
            pick(hexa, choice([32, 40, 64])), "AKIA" + pick(up + dig, 16), "ghp_" + pick(any_, 36), pick(any_, int(rng.integers(20, 60))),
            pick(any_ + "+/", 40) + choice(["", "="]), pick(any_ + "!#$%*", int(rng.integers(9, 20))),
        ][kind]
        if rng.random() < 0.15:
            value = value.upper()
        context = choice(plain) + " " + (choice(names) + choice(joins) if kind in (0, 3, 4, 5) or rng.random() < 0.7 else "")
        rows.append((value, context, end(context, follows), choice(paths), 1))
        # the same with words after it that say what it is
        if rng.random() < 0.2:
            rows.append((value, context, end(context, harmless), choice(paths), 0))
        kind = int(rng.integers(9))
        value = [
            pick(hexa, choice([32, 40, 64])), pick(dig, int(rng.integers(16, 20))), f"{pick(hexa, 8)}-{pick(hexa, 4)}-{pick(hexa, 4)}-{pick(hexa, 4)}-{pick(hexa, 12)}",
            words(6) + pick(dig, 2), "your_" + choice(["api_key", "token_here", "password1"]) + "_example", "x" * int(rng.integers(16, 30)) + "1",
            choice(["password", "changeme", "example"]) + "1234567", words(3) + "-" + words(3) + "-" + pick(dig, 4), choice(["https", "file", "user"]) + "/" + words(4) + "/" + pick(dig, 3),
        ][kind]
        context = choice(plain) + " " + (choice(calm) + choice(joins + [" "]) if kind in (0, 1, 2) else choice(names) + choice(joins) if kind in (4, 5, 6) else choice([*plain, "url", "page"]) + choice([" ", ": ", "="]))
        rows.append((value, context, end(context, follows if rng.random() < 0.8 else harmless), choice(paths if rng.random() < 0.7 else test_paths), 0))
        # the same shapes of keys under a test path are not secrets
        if rng.random() < 0.15:
            context = choice(names) + choice(joins)
            rows.append((pick(any_, 32), context, end(context, follows), choice(test_paths), 0))
    return spark.createDataFrame(rows, "value string, before string, after string, path string, label int")


def once(column: Column) -> Column:
    """A generator of one row is a border that the optimizer moves nothing across: what is used many times is computed once."""
    return F.explode(F.array(column))


def candidates(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", path_col: str | None = "source") -> DataFrame:
    """doc_id, start, end, value, before, after, path of every candidate; start counts characters, end is exclusive."""
    path = F.col(f"`{path_col}`").cast("string") if path_col else F.lit(None).cast("string")
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.translate(F.col(f"`{text_col}`"), MARK, " ").alias("text"), path.alias("path"))
    marked = rows.where(F.col("text").rlike(CANDIDATE)).select("doc_id", "path", F.split(F.regexp_replace("text", f"({CANDIDATE})", f"{MARK}$1{MARK}"), MARK).alias("part"))
    # parts alternate: text, candidate, text, ...; ends of parts are sums over the runs before theirs and inside their own, so the
    # work for a text with very many candidates is not the square of their number
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda acc, n: acc + n)
    runs = F.sequence(F.lit(0), F.floor((F.size("sizes") - 1) / RUN).cast("int"))
    of_runs = F.transform(runs, lambda r: total(F.slice("sizes", r * RUN + 1, RUN)))
    before_runs = F.transform(runs, lambda r: total(F.slice("sums", 1, r)))
    ends = F.transform(
        "sizes",
        lambda _, k: F.get("starts", F.floor(k / RUN).cast("int")) + total(F.slice("sizes", F.floor(k / RUN).cast("int") * RUN + 1, k % RUN + 1)),
    )
    at = F.sequence(F.lit(2), F.size("part"), F.lit(2))
    found = F.transform(
        at,
        lambda k: F.struct(
            F.element_at("ends", k - 1).alias("start"), F.element_at("ends", k).alias("end"),
            F.element_at("part", k).alias("value"), F.element_at("part", k - 1).substr(F.greatest(F.length(F.element_at("part", k - 1)) - CONTEXT + 1, F.lit(1)), F.lit(CONTEXT)).alias("before"),
            F.substring(F.element_at("part", k + 1), 1, CONTEXT).alias("after"),
        ),
    )
    with_ends = marked
    for name, column in (("sizes", F.transform("part", F.length)), ("sums", of_runs), ("starts", before_runs), ("ends", ends)):
        with_ends = with_ends.select("*", once(column).alias(name))
    return with_ends.select("doc_id", "path", F.explode(found).alias("c")).select("doc_id", F.col("c.start").cast("long").alias("start"), F.col("c.end").cast("long").alias("end"), "c.value", "c.before", "c.after", "path")


def scan(docs: DataFrame, forest: Forest, words: str, least: float = LEAST_SCORE, text_col: str = "text", id_col: str = "doc_id", path_col: str | None = "source") -> DataFrame:
    """doc_id, start, end, value, score of the findings that the forest does not remove."""
    found = candidates(docs, text_col, id_col, path_col)
    f = features(F.col("value"), F.col("before"), F.col("path"), F.col("after"), words)
    # each feature, and the score, is computed once instead of once for each mention in the trees
    listed = found.select("doc_id", "start", "end", "value", once(F.struct(*[c.alias(n) for n, c in f.items()])).alias("f"))
    scored = listed.select("doc_id", "start", "end", "value", "f.*").select("doc_id", "start", "end", "value", once(forest.score()).alias("score"))
    return scored.where(F.col("score") >= least)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings, each secret by its digest and length only."""
    words = dictionary(vocabulary("word_bpe_49k.json"))
    found = scan(table(spark, sf_dir, "documents"), train(labelled_findings(spark), words), words)
    return found.select("doc_id", "start", "end", F.length("value").cast("long").alias("length"), F.sha2("value", 256).alias("secret_sha256"), "score")
