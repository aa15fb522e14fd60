"""Connected components of an edge table: of few edges in one task, of more as DataFrame joins."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_texts, release, stage

#: Edges that one task takes, about 100 bytes each in its memory.  The rounds of joins cost some dozens of shuffles, however few the edges are.
FEW = 250_000


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All edges (u, v) -> (node, root), by hooking roots to smaller ones and halving the paths until nothing moves."""
    parts = list(batches)
    if not parts:
        return
    edges = pa.Table.from_batches(parts)
    ends = pa.chunked_array([*edges["u"].chunks, *edges["v"].chunks]).combine_chunks().dictionary_encode()
    order = pc.sort_indices(ends.dictionary)
    names = ends.dictionary.take(order)
    place = np.empty(len(names), np.int64)
    place[order.to_numpy()] = np.arange(len(names))
    u, v = place[ends.indices.to_numpy()].reshape(2, -1)
    root = np.arange(len(names))
    while True:
        before = root.copy()
        low = np.minimum(before[u], before[v])
        np.minimum.at(root, before[u], low)
        np.minimum.at(root, before[v], low)
        while (root[root] != root).any():
            root = root[root]
        if (root == before).all():
            break
    yield pa.RecordBatch.from_arrays([names, names.take(pa.array(root))], ["node", "root"])


def components(edges: DataFrame) -> DataFrame:
    """(a, b) -> (node, root): root is the smallest node of the component; nodes without an edge do not appear.

    Beyond FEW edges: large-star and small-star steps in turn: each rewires every edge to the smallest neighbour, so the graph becomes a
    set of stars in a logarithmic number of rounds.  No step gathers a node's neighbours in one place: smallest neighbours come
    from aggregations with partial results, and are written before they are joined to the edges, so that both sides of the
    join are plain exchanges, whose partitions adaptive execution splits where a hub has many edges.
    """
    both = stage(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")))
    if both.count() <= FEW:
        kind = both.schema["u"].dataType
        out = stage(map_texts(both.coalesce(1), _solve, T.StructType().add("node", kind).add("root", kind)))
        release(both)
        return out
    mark = None
    while True:
        # large star: neighbours above u move to u's smallest neighbour
        sym = both.union(both.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = stage(sym.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")))
        large = sym.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = stage(large)
        release(low, both)
        # small star: u and its neighbours below move to the smallest of them
        low = stage(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        both = stage(small.union(low.select("u", F.col("m").alias("v"))).distinct())
        release(low, large)
        now = both.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    roots = both.select(F.col("v").alias("node")).distinct().withColumn("root", F.col("node"))
    out = stage(both.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots))
    release(both)
    return out
