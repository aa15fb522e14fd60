"""Operators on sorted keys: ranges, navigation, ranks, even selection, splitting, packing into bins."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..staging import stage


def key_range(df: DataFrame, key: str, lo=None, hi=None, with_lo: bool = False, with_hi: bool = False) -> DataFrame:
    """Keys between lo and hi, strictly unless with_lo or with_hi; None is no bound."""
    c = F.col(key)
    if lo is not None:
        df = df.where(c >= lo if with_lo else c > lo)
    if hi is not None:
        df = df.where(c <= hi if with_hi else c < hi)
    return df


def head(df: DataFrame, key: str, to) -> DataFrame:
    """Keys below to."""
    return key_range(df, key, hi=to)


def tail(df: DataFrame, key: str, at) -> DataFrame:
    """Keys from at on, with it."""
    return key_range(df, key, lo=at, with_lo=True)


def sub(df: DataFrame, key: str, at, to) -> DataFrame:
    """Keys from at, with it, to before to."""
    return key_range(df, key, at, to, with_lo=True)


def prefix(df: DataFrame, key: str, start: str) -> DataFrame:
    return df.where(F.col(key).startswith(start))


def nav(df: DataFrame, key: str, at, kind: str) -> DataFrame:
    """One row, column key: ceiling (>=), floor (<=), higher (>), lower (<), first, last or second; null if there is none."""
    c = F.col(key)
    if kind == "ceiling":
        return df.where(c >= at).agg(F.min(c).alias(key))
    if kind == "floor":
        return df.where(c <= at).agg(F.max(c).alias(key))
    if kind == "higher":
        return df.where(c > at).agg(F.min(c).alias(key))
    if kind == "lower":
        return df.where(c < at).agg(F.max(c).alias(key))
    if kind == "first":
        return df.agg(F.min(c).alias(key))
    if kind == "last":
        return df.agg(F.max(c).alias(key))
    if kind == "second":
        two = df.select(c).distinct().orderBy(c).limit(2)
        return two.agg(F.when(F.count("*") == 2, F.max(c)).alias(key))
    raise ValueError(f"no such kind: {kind}")


def with_rank(df: DataFrame, *order: Column | str, name: str = "rank") -> DataFrame:
    """Rows numbered from 0 in that order, without sorting everything in one task.

    A range partitioning, a sort inside partitions, and the sizes of the partitions before, of which there are as many
    as partitions.  With a fixed number of partitions both uses of the exchange are one.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    numbered = ordered.withColumn("_p", F.spark_partition_id()).withColumn("_k", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    sizes = numbered.groupBy("_p").agg(F.count("*").alias("_n"))
    listed = sizes.agg(F.collect_list(F.struct("_p", "_n")).alias("_all"))
    before = sizes.crossJoin(F.broadcast(listed)).select(
        "_p", F.aggregate("_all", F.lit(0).cast("bigint"), lambda acc, x: acc + F.when(x["_p"] < F.col("_p"), x["_n"]).otherwise(0)).alias("_before")
    )
    return numbered.join(F.broadcast(before), "_p").withColumn(name, F.col("_before") + F.col("_k")).drop("_p", "_k", "_before")


def nth(df: DataFrame, key: str, n: int) -> DataFrame:
    """The row with n rows before it in key order."""
    return with_rank(df, key).where(F.col("rank") == n).drop("rank")


def allocated_before(total: int, num: int, upto: Column) -> Column:
    """How much the first upto of num recipients get when total is spread evenly over them."""
    k, r = divmod(total, num)
    if not r:
        return upto * k
    # extras go to the recipients floor(num (2j + 1) / 2r)
    q = ((2 * r) * upto - 1) / num
    extra = F.floor((F.floor(q) + 1) / 2)
    return upto * k + F.when(upto <= 0, 0).otherwise(F.greatest(extra, F.lit(0)))


def allocate_evenly(spark: SparkSession, total: int, num: int) -> DataFrame:
    """(i, share): total spread over num recipients, the larger shares evenly between the smaller."""
    if total < 0 or num <= 0:
        raise ValueError("total must not be negative, num must be positive")
    i = F.col("id")
    share = allocated_before(total, num, i + 1) - allocated_before(total, num, i)
    return spark.range(num).select(i.alias("i"), share.cast("bigint").alias("share"))


def even_places(spark: SparkSession, size: int, n: int, inclusive: str = "none") -> DataFrame:
    """(k, place): places of n evenly spaced elements out of size; inclusive: none, left, right or both ends."""
    inclusive = inclusive.lower()
    if n < 0 or size < n:
        raise ValueError(f"cannot select {n} of {size}")
    if n == 0 and inclusive != "none" or n == 1 and inclusive == "both":
        raise ValueError(f"cannot select {n} with the ends: {inclusive}")
    if n == 0:
        return spark.range(0).select(F.col("id").alias("k"), F.col("id").alias("place"))
    rows, k = spark.range(n), F.col("id")
    if size == n:
        return rows.select(k.alias("k"), k.alias("place"))
    if inclusive in ("left", "both"):
        gaps = n if inclusive == "left" else n - 1
        place = k + (F.when(k > 0, allocated_before(size - n, gaps, k)).otherwise(0) if gaps else 0)
    else:
        gaps = n + 1 if inclusive == "none" else n
        place = k + allocated_before(size - n, gaps, k + 1)
    return rows.select(k.alias("k"), place.cast("bigint").alias("place"))


def even_select(df: DataFrame, key: str, n: int, inclusive: str = "none") -> DataFrame:
    places = even_places(df.sparkSession, df.count(), n, inclusive)
    return with_rank(df.select(key), key).join(F.broadcast(places), F.col("rank") == F.col("place")).select("k", key)


def split_ranges(df: DataFrame, key: str, separators: list) -> tuple[DataFrame, DataFrame]:
    """Ranges between separators as (range, first, last, n), and the separators that occur in df.

    separators is a short list known to the driver, as in an index node.
    """
    seps = sorted(set(separators))
    c = F.col(key)
    bucket = F.aggregate(F.array(*[F.lit(s) for s in seps]), F.lit(0), lambda acc, s: acc + F.when(s < c, 1).otherwise(0)) if seps else F.lit(0)
    inside = df.where(~c.isin(seps)) if seps else df
    ranges = inside.groupBy(bucket.alias("range")).agg(F.min(c).alias("first"), F.max(c).alias("last"), F.count("*").alias("n"))
    found = df.where(c.isin(seps)).select(key).distinct() if seps else df.select(key).limit(0)
    return ranges, found


def adjacent_pairs(df: DataFrame, key: str) -> DataFrame:
    """(left, right) of neighbours in key order: a look back inside each range, and one row a range for the pairs across borders."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.select(key).repartitionByRange(parts, key).withColumn("_p", F.spark_partition_id())
    inside = ranged.select(F.lag(key).over(Window.partitionBy("_p").orderBy(key)).alias("left"), F.col(key).alias("right")).where("left is not null")
    ends = ranged.groupBy("_p").agg(F.min(key).alias("first"), F.max(key).alias("last"))
    # as many rows as ranges
    across = ends.select(F.lag("last").over(Window.orderBy("_p")).alias("left"), F.col("first").alias("right")).where("left is not null")
    return inside.union(across)


class BestFit:
    """Best-fit decreasing bins of one capacity; no bin but one is less than half full, and with no_tiny none is."""

    def __init__(self, capacity: int, no_tiny: bool = True):
        self.capacity, self.no_tiny = capacity, no_tiny

    def pack(self, items: list[tuple]) -> list[tuple]:
        """(key, weight) -> (key, weight, bin)."""
        from bisect import bisect_left, insort

        rooms: list[tuple[int, int]] = []  # room, bin
        bins: list[list[tuple]] = []
        for key, weight in sorted(items, key=lambda x: (-x[1], str(x[0]))):
            if weight > self.capacity:
                raise ValueError(f"{key} weighs more than a bin holds")
            at = bisect_left(rooms, (weight, -1))
            if at < len(rooms):
                room, b = rooms.pop(at)
            else:
                room, b = self.capacity, len(bins)
                bins.append([])
            bins[b].append((key, weight))
            insort(rooms, (room - weight, b))
        loads = [sum(w for _, w in b) for b in bins]
        if self.no_tiny and len(bins) > 1:
            small = min(range(len(bins)), key=loads.__getitem__)
            if 2 * loads[small] < self.capacity:
                into = min((k for k in range(len(bins)) if k != small), key=loads.__getitem__)
                bins[into] += bins[small]
                bins[small] = []
        return [(k, w, n) for n, b in enumerate(b for b in bins if b) for k, w in b]


#: Weight, in capacities, that one task packs.
BINS_PER_TASK = 20_000


def bin_pack(df: DataFrame, key: str, weight: str | Column, capacity: int, no_tiny: bool = True, oversize: str = "error", bins: DataFrame | None = None, even: bool = False) -> DataFrame:
    """(key, piece, weight, bin): bins of that capacity over the whole table; all are at least half full but at most one, which no_tiny merges into another.

    weight is a column or an expression.  Rows are dealt by a hash of their key to as many tasks as the total weight asks for, and sorted by
    weight there, heaviest first, so a task holds no more than the room of its open bins, and the result depends on the rows alone,
    not on how they lie.  What is less than half full after that, at most one bin a task, is packed again together.  A row that
    weighs more than a bin is an error, or with oversize="split" pieces of the capacity and a rest.

    bins: (key, weight, bin) of an earlier call, whose rows stay where they are; new rows fill their room first.  even: new bins share the
    weight of their task alike (the emptiest takes the next row) instead of being filled one after the other.
    """
    spark = df.sparkSession
    kind = df.schema[key].dataType.simpleString()
    heavy = F.col(weight) if isinstance(weight, str) else weight
    rows = df.select(F.col(key).alias("key"), heavy.cast("long").alias("weight"))
    if oversize == "split":
        pieces = F.greatest(F.lit(1), F.ceil(F.col("weight") / capacity)).cast("int")
        rows = rows.select("key", F.explode(F.sequence(F.lit(0), pieces - 1)).alias("piece"), "weight").select("key", "piece", F.least(F.lit(capacity), F.col("weight") - F.col("piece").cast("long") * capacity).alias("weight"))
    elif oversize == "error":
        rows = rows.select("key", F.lit(0).alias("piece"), "weight")
    else:
        raise ValueError(f"no such way with large rows: {oversize}")
    size = rows.agg(F.sum("weight").alias("total"), F.max("weight").alias("most")).first()
    if (size["most"] or 0) > capacity:
        raise ValueError("a row weighs more than a bin holds")
    tasks = max(1, -(-(size["total"] or 0) // (capacity * BINS_PER_TASK)))
    loads = rows.select("key", "piece", "weight", F.lit(None).cast("long").alias("bin"), F.pmod(F.xxhash64("key", "piece"), F.lit(tasks)).cast("int").alias("task"))
    if bins is not None:
        old = bins.groupBy("bin").agg(F.sum("weight").alias("weight"))
        loads = loads.unionByName(old.select(F.lit(None).cast(kind).alias("key"), F.lit(-1).alias("piece"), "weight", "bin", F.pmod(F.xxhash64("bin"), F.lit(tasks)).cast("int").alias("task")))
    totals = {r["task"]: r["total"] for r in loads.where("bin is null").groupBy("task").agg(F.sum("weight").alias("total")).collect()} if even else {}
    above = (bins.agg(F.max("bin")).first()[0] if bins is not None else None) or 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from bisect import bisect_left, insort

        rooms: list[tuple[int, int]] = []
        task, made = None, 0
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("weight", "bin", "task")]
            placed = []
            for w, b, t in zip(*cols, strict=True):
                if t != task:
                    task, made, rooms = t, 0, []
                    base = above + 1 + (t << 40)
                    if even and totals.get(t):
                        made = -(-totals[t] // capacity)
                        rooms = sorted((capacity, base + k) for k in range(made))
                if b is not None:  # a bin of an earlier call
                    insort(rooms, (max(0, capacity - w), b))
                    placed.append(b)
                    continue
                at = len(rooms) - 1 if even else bisect_left(rooms, (w, -1))
                if 0 <= at < len(rooms) and rooms[at][0] >= w:
                    room, to = rooms.pop(at)
                else:
                    room, to, made = capacity, base + made, made + 1
                insort(rooms, (room - w, to))
                placed.append(to)
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("piece"), batch.column("weight"), pa.array(placed, pa.int64())], ["key", "piece", "weight", "bin"])

    dealt = loads.repartition(max(1, min(tasks, 1 << 20)), "task").sortWithinPartitions("task", F.col("bin").isNull(), F.desc("weight"), "bin", "key", "piece")
    packed = stage(dealt.mapInArrow(run, f"key {kind}, piece int, weight long, bin long"))
    first = packed.where("piece >= 0").select(F.col("key").alias(key), "piece", "weight", "bin")
    whole = packed.groupBy("bin").agg(F.sum("weight").alias("load"), F.max(F.col("piece") < 0).alias("old"))
    # at most one bin a task is this small, unless it is an old one, which stays
    small = [(r["bin"], r["load"]) for r in whole.where(F.col("load") * 2 < capacity).where("not old").orderBy(F.desc("load"), "bin").collect()]
    moved = {b: small[n][0] for b, _, n in BestFit(capacity, False).pack(small)}
    sums: dict[int, int] = {}
    for b, w in small:
        sums[moved[b]] = sums.get(moved[b], 0) + w
    tiny = min((b for b in sums if 2 * sums[b] < capacity), key=lambda b: sums[b], default=None) if no_tiny else None
    if tiny is not None:
        into = whole.where(~F.col("bin").isin([b for b, _ in small])).orderBy("load", "bin").first()
        target = into["bin"] if into else next((b for b in sums if b != tiny), tiny)
        moved = {b: target if to == tiny else to for b, to in moved.items()}
    moves = [(b, to) for b, to in moved.items() if b != to]
    if not moves:
        return first
    # as many rows as tasks at most
    change = F.broadcast(spark.createDataFrame(moves, "bin long, to long"))
    return first.join(change, "bin", "left").select(key, "piece", "weight", F.coalesce("to", "bin").alias("bin"))
