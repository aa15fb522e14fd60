"""Approximate nearest neighbours by shifted space-filling curves.

Several Hilbert curves are laid through randomly rotated, projected and shifted copies of the vectors.  Vectors are
range-partitioned by their key on each curve, a query looks at a window of keys around its own, and the candidates of all
windows are merged and ranked by the exact distance of the original vectors.  The number of curves and the width of the
window are fitted on a bounded sample: for each number of curves the window is the smallest share of the rows that reaches
the wanted recall there, and the number is the one with the least work, counted in distances (`work`).  Clustered vectors get many
curves with narrow windows; vectors without any structure get few curves with wide ones.  Only the fit sees a sample; all rows are indexed.  A query goes to the partitions its windows overlap, so no partition has to
hold more than its own range, and what is sent back is bounded by the number of neighbours.

Equal vectors have equal keys on every curve and would make a hot range.  They are one entry of the index, with the
smallest ids of the group, as many as a result can use; nothing else of the group can be in a result.

Defined results: rows whose vector is null, zero, of another length than most, or holds null or non-finite components
take no part, neither as queries nor as candidates, nor do rows with a null id; rows that repeat an id and its vector
count once; ties go to the smaller id; with fewer candidates than neighbours asked for, all of them are returned.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stage, table

#: Projected dimensions and bits of each, of a key of at most 63 bits.
DIMENSIONS, BITS = 10, 6
#: Numbers of curves to choose from.
CURVES = (2, 4, 8, 16, 32)
#: What it costs to place a row on one more curve, in distances.
PLACING = 250
#: Bound of the sample that curves and windows are fitted on, and of its queries.
SAMPLE, SAMPLE_QUERIES = 6000, 300
#: Recall that the window must reach on the sample.
RECALL = 0.96
NEIGHBOURS = 10
#: Queries whose distances are one matrix product.
BLOCK = 64
#: Entries and queries that meet in one task; larger ranges are cut, and each cut of one side meets each of the other.
ENTRIES, QUERIES = 60_000, 20_000
#: Rows of a range, as long as the sample gives enough borders; a query gets partial results from each range it sees.
RANGE = 8_000


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position of each row of cells (n x d, integers of that many bits) along the Hilbert curve.

    Gray-code transform after Skilling (2004), on all rows at once.
    """
    x = cells.astype(np.uint64).T.copy()
    d = len(x)
    one = np.uint64(1)
    for b in range(bits - 1, 0, -1):
        q, p = np.uint64(1 << b), np.uint64((1 << b) - 1)
        for i in range(d):
            up = (x[i] & q) != 0
            t = np.where(up, np.uint64(0), (x[0] ^ x[i]) & p)
            x[0] ^= np.where(up, p, t)
            if i:
                x[i] ^= t
    for i in range(1, d):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        q = np.uint64(1 << b)
        t ^= np.where((x[d - 1] & q) != 0, np.uint64((1 << b) - 1), np.uint64(0))
    x ^= t
    key = np.zeros(x.shape[1], np.uint64)
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            key = key << one | x[i] >> np.uint64(b) & one
    return key.astype(np.int64)


@dataclass
class Curves:
    turn: np.ndarray  # curves x d x dimensions
    steps: np.ndarray  # curves x dimensions x (2**BITS - 1): borders of the cells, at shifted quantiles
    ranks: np.ndarray  # curves x sample: sorted keys of the sample, which stand for shares of all rows
    reach: float  # half the width of a window, as a share of all rows

    def keys(self, x: np.ndarray) -> np.ndarray:
        """curves x n."""
        out = np.empty((len(self.turn), len(x)), np.int64)
        for c, (turn, steps) in enumerate(zip(self.turn, self.steps, strict=True)):
            y = x @ turn
            cells = np.stack([np.searchsorted(s, y[:, k], "right") for k, s in enumerate(steps)], 1)
            out[c] = hilbert_keys(cells, BITS)
        return out

    def window(self, curve: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The keys between which a query's candidates lie."""
        ranks = self.ranks[curve]
        n = len(ranks)
        width = int(np.ceil(self.reach * n)) + 1
        low = np.searchsorted(ranks, keys, "left") - width
        high = np.searchsorted(ranks, keys, "right") + width
        floor, top = np.iinfo(np.int64).min, np.iinfo(np.int64).max
        return np.where(low < 0, floor, ranks[np.maximum(low, 0)]), np.where(high >= n, top, ranks[np.minimum(high, n - 1)])


def window_share(reach: float) -> float:
    """Share of all rows in a window of that reach, on average over places: it ends where the curve does."""
    return 2 * reach - reach * reach if reach < 1 else 1.0


def work(curves: int, reach: float, queries: int) -> float:
    """For each row of the index: places on curves and distances to queries, in distances."""
    return curves * (PLACING + queries * window_share(reach))


def fit_curves(sample: np.ndarray, neighbours: int = NEIGHBOURS, curves: tuple[int, ...] = CURVES, recall: float = RECALL, queries: int = 1000, seed: int = 11) -> Curves:
    rng = np.random.default_rng(seed)
    n, d = sample.shape
    k = min(DIMENSIONS, d)
    turn, steps = [], []
    most = max(curves) if n > neighbours + 1 else min(curves)
    for _ in range(most):
        q, _ = np.linalg.qr(rng.normal(size=(d, d)))
        turn.append(q[:, :k])
        y = np.sort(sample @ q[:, :k], axis=0)
        cells = 1 << BITS
        shift = rng.random(k)
        places = np.clip(((np.arange(1, cells)[:, None] - 0.5 + shift) / cells * n).astype(int), 0, n - 1)
        steps.append(np.take_along_axis(y, places, 0).T)
    made = Curves(np.array(turn), np.array(steps), np.zeros((most, 0), np.int64), 1.0)
    keys = made.keys(sample)
    made.ranks = np.sort(keys, axis=1)
    if n <= neighbours + 1:
        return made
    # place of each sample row on each curve; a neighbour is found when one curve has it near enough
    place = np.empty_like(keys)
    for c in range(most):
        place[c, np.argsort(keys[c], kind="stable")] = np.arange(n)
    gaps = []
    for at in rng.choice(n, min(SAMPLE_QUERIES, n), replace=False):
        dist = ((sample - sample[at]) ** 2).sum(1)
        dist[at] = np.inf
        near = np.argpartition(dist, neighbours)[:neighbours]
        gaps.append(np.minimum.accumulate(np.abs(place[:, near] - place[:, [at]])))
    best = np.concatenate(gaps, axis=1)  # row c: the smallest gap on the first c + 1 curves
    reach = {c: float(np.quantile(best[c - 1], recall)) / n for c in curves}
    chosen = min(curves, key=lambda c: work(c, reach[c], queries))
    return Curves(made.turn[:chosen], made.steps[:chosen], made.ranks[:chosen], reach[chosen])


def _usable(rows: DataFrame, vector: str, dim: int | None = None) -> DataFrame:
    v = F.col(vector)
    ok = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return rows.where(ok if dim is None else ok & (F.size(v) == dim))


def nearest(rows: DataFrame, is_query, neighbours: int = NEIGHBOURS, id_col: str = "vec_id", vector: str = "embedding", curves: tuple[int, ...] = CURVES, recall: float = RECALL) -> DataFrame:
    """query_id, rank, vec_id, score: of each row where is_query holds, the nearest other rows by Euclidean distance."""
    spark = rows.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    named = rows.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("v")).where("id is not null")
    sizes = _usable(named, "v").groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if sizes is None:
        return spark.createDataFrame([], schema)
    dim = sizes["d"]
    good = _usable(named, "v", dim)
    # -0.0 and 0.0 are one value to Spark's grouping and to the distance
    group = Window.partitionBy("v").orderBy("id")
    few = good.distinct().withColumn("n", F.row_number().over(group)).where(F.col("n") <= neighbours + 1)
    index = stage(few.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids")))
    drawn = index.select("v").orderBy(F.xxhash64("v")).limit(SAMPLE).collect()
    sample = np.array([r["v"] for r in drawn], float)
    chosen = stage(good.where(is_query(F.col("id"))).distinct().select(F.array("id").alias("ids"), "v"))
    n, queries = index.count(), chosen.count()
    fitted = fit_curves(sample, neighbours, curves, recall, queries)
    # borders at equal shares of the sample
    parts = max(1, min(-(-n // RANGE), len(sample) // 32))
    borders = [np.unique(r[(np.arange(1, parts) * len(r)) // parts]) for r in fitted.ranks]

    cuts = max(1, -(-n // (parts * ENTRIES)))
    asks = max(1, int(-(-queries * (2 * fitted.reach + 2 / parts) // QUERIES)))

    def place(role: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = np.array(batch.column("v").flatten()).reshape(-1, dim)
                keys = fitted.keys(x)
                for c in range(len(keys)):
                    if role:  # a query goes to all partitions that its window overlaps
                        low, high = fitted.window(c, keys[c])
                        a, b = np.searchsorted(borders[c], low, "right"), np.searchsorted(borders[c], high, "right")
                        n = b - a + 1
                        at = np.repeat(np.arange(len(n)), n)
                        part = a[at] + np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
                        low, high = low[at], high[at]
                    else:
                        at = np.arange(batch.num_rows)
                        part = np.searchsorted(borders[c], keys[c], "right")
                        low = high = keys[c]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(at), c, np.int32)), pa.array(part.astype(np.int32)), pa.array(low[: len(at)]), pa.array(high[: len(at)]), batch.column("v").take(pa.array(at)), batch.column("ids").take(pa.array(at))],
                        ["curve", "part", "low", "high", "v", "ids"],
                    )

        return run

    fields = "curve int, part int, low long, high long, v array<double>, ids array<long>"
    # the borders come from the sample, so a range grows with the rows; hashes cut both sides of it into pieces
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    piece = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    entries = index.mapInArrow(place(0), fields).withColumn("cut", piece("v", cuts)).withColumn("ask", every(asks))
    asked = chosen.mapInArrow(place(1), fields).withColumn("ask", piece("ids", asks)).withColumn("cut", every(cuts))

    def local(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if left.num_rows and right.num_rows:
            ids = left.column("ids").combine_chunks()
            keys = left.column("low").to_numpy()
            order = np.argsort(keys, kind="stable")
            keys = keys[order]
            x = np.array(left.column("v").combine_chunks().flatten()).reshape(-1, dim)[order]
            offsets = ids.offsets.to_numpy()[order], ids.offsets.to_numpy()[1:][order]
            flat = ids.values.to_numpy()
            q = np.array(right.column("v").combine_chunks().flatten()).reshape(-1, dim)
            qid = right.column("ids").combine_chunks().flatten().to_numpy()
            a = np.searchsorted(keys, right.column("low").to_numpy(), "left")
            b = np.searchsorted(keys, right.column("high").to_numpy(), "right")
            norm = (x * x).sum(1)
            # queries in the order of their windows: those of a block overlap, and one matrix product serves them
            turn = np.argsort(a + b, kind="stable")
            turn = turn[a[turn] < b[turn]]
            for block in range(0, len(turn), BLOCK):
                some = turn[block : block + BLOCK]
                base = a[some].min()
                products = x[base : b[some].max()] @ q[some].T
                for column, at in enumerate(some.tolist()):
                    lo, hi = a[at], b[at]
                    rough = norm[lo:hi] - 2 * products[lo - base : hi - base, column]
                    m = min(neighbours + 1, hi - lo)
                    limit = np.partition(rough, m - 1)[m - 1]
                    near = lo + np.flatnonzero(rough <= limit + 1e-9 * (1 + abs(limit)))
                    exact = np.sqrt(((x[near] - q[at]) ** 2).sum(1))
                    found = sorted((d, i) for d, e in zip(exact.tolist(), near.tolist(), strict=True) for i in flat[offsets[0][e] : offsets[1][e]].tolist() if i != qid[at])
                    out += [(int(qid[at]), i, d) for d, i in found[:neighbours]]
        cols = list(zip(*out, strict=True)) or [(), (), ()]
        return pa.table({"query_id": pa.array(cols[0], pa.int64()), "vec_id": pa.array(cols[1], pa.int64()), "score": pa.array(cols[2], pa.float64())})

    task = ["curve", "part", "cut", "ask"]
    found = entries.groupBy(*task).cogroup(asked.groupBy(*task)).applyInArrow(local, "query_id long, vec_id long, score double")
    best = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= neighbours)
    return ranked.select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), lambda i: i % 100 == 0)
