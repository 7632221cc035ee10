"""Where series go: equal slices, node groups, and a density-aware deal of root buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import decimal_to_gray

ROUND, RATE = 4000, 1.05


def slice_of(position: Column, total: Column, parts: int) -> Column:
    """Which of so many equal slices a position (from 0) is in; what doesn't divide goes to the last."""
    size = F.greatest(F.lit(1), F.floor(total / parts))
    return F.least(F.floor(position / size), F.lit(parts - 1)).cast("int")


def equal_slices(series: DataFrame, parts: int, key: str = "series_id") -> DataFrame:
    """key, part for each series whose ids count from 0 without gaps: position is the id, so nothing is sorted."""
    total = series.agg((F.max(key) + 1).alias("total"))
    return series.select(key).crossJoin(F.broadcast(total)).select(key, slice_of(F.col(key), F.col("total"), parts).alias("part"))


def node_groups(ranks: DataFrame, per_group: int) -> DataFrame:
    """rank -> group, and whether it coordinates its group (the group's first rank)."""
    return ranks.select("rank", F.floor(F.col("rank") / per_group).cast("int").alias("group_id"), (F.col("rank") % per_group == 0).alias("coordinator"))


def histogram(entries: DataFrame) -> DataFrame:
    """root, n: at most as many rows as there are roots."""
    return entries.groupBy("root").agg(F.count("*").alias("n"))


def gray_deal(buckets: DataFrame, groups: int) -> DataFrame:
    """Roots in Gray-code order, dealt in turn: neighbours in the order differ in few symbols, so near series spread."""
    order = Window.orderBy(decimal_to_gray(F.col("root")))
    return buckets.select("root", "n", ((F.row_number().over(order) - 1) % groups).cast("int").alias("group_id"))


def largest(buckets: DataFrame, most: int = ROUND) -> DataFrame:
    """The largest buckets, as many as there are up to most, largest first, ties by root."""
    order = Window.orderBy(F.desc("n"), "root")
    return buckets.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most).select("root", "n", F.col("place").cast("int").alias("place"))


def split_bucket(entries: DataFrame, groups: int) -> DataFrame:
    """Members of each bucket in id order, in turn over all groups.

    The order within a bucket is found from counts of id ranges, so that a bucket with most of the series isn't
    ordered in one task: range counts are summed, and only a range is ranked at a time.
    """
    ranges = 1024
    top = entries.agg(F.max("series_id").alias("top"), F.min("series_id").alias("bottom"))
    width = F.greatest(F.lit(1), F.ceil((F.col("top") - F.col("bottom") + 1) / F.lit(ranges)))
    ranged = entries.select("root", "series_id").crossJoin(F.broadcast(top)).withColumn("range", F.floor((F.col("series_id") - F.col("bottom")) / width)).select("root", "series_id", "range")
    before = F.coalesce(F.sum("m").over(Window.partitionBy("root").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = ranged.groupBy("root", "range").agg(F.count("*").alias("m")).select("root", "range", before.alias("before"))
    place = F.row_number().over(Window.partitionBy("root", "range").orderBy("series_id")) - 1
    return ranged.withColumn("place", place).join(counts, ["root", "range"]).select("root", "series_id", ((F.col("place") + F.col("before")) % groups).cast("int").alias("group_id"))


def group_counts(dealt: DataFrame) -> DataFrame:
    """Series in each group, from dealt buckets (n, group_id)."""
    return dealt.groupBy("group_id").agg(F.sum("n").alias("n_series"))


def rebalance(buckets: list[tuple[int, int, int]], groups: int, rate: float = RATE) -> tuple[list[int], list[float]]:
    """Roots to split over all groups until the fullest group is within rate of the mean; loads after it.

    buckets: (root, n, group). Works on the histogram, whose size is bounded by the number of roots.
    """
    loads = [0.0] * groups
    own: dict[int, list[tuple[int, int]]] = {g: [] for g in range(groups)}
    for root, n, g in buckets:
        loads[g] += n
        own[g].append((n, root))
    for roots in own.values():
        roots.sort(key=lambda b: (b[0], -b[1]))
    split: list[int] = []
    mean = sum(loads) / max(1, groups)
    while mean and max(loads) / mean > rate:
        fullest = max(range(groups), key=lambda g: (loads[g], -g))
        if not own[fullest]:
            break
        n, root = own[fullest].pop()
        split.append(root)
        loads[fullest] -= n
        loads = [load + n / groups for load in loads]
    return split, loads


def density_aware(entries: DataFrame, groups: int, most: int = 0, rate: float = RATE) -> DataFrame:
    """series_id, group_id: roots dealt in Gray order, the largest and those that rebalancing picks split over all groups."""
    buckets = histogram(entries)
    dealt = gray_deal(buckets, groups)
    rows = [(r.root, r.n, r.group_id) for r in dealt.toLocalIterator()]  # at most as many as roots
    chosen = {r.root for r in largest(buckets, most).toLocalIterator()} if most else set()
    split, _ = rebalance([b for b in rows if b[0] not in chosen], groups, rate)
    spark = entries.sparkSession
    picked = spark.createDataFrame([(r,) for r in sorted(chosen | set(split))], "root long")
    whole = entries.join(dealt.select("root", "group_id"), "root").join(picked, "root", "left_anti").select("series_id", "group_id")
    parts = split_bucket(entries.join(picked, "root", "left_semi"), groups).select("series_id", "group_id")
    return whole.unionByName(parts)


def root_batches(roots: DataFrame, workers: int) -> DataFrame:
    """Contiguous batches of roots, the last takes the rest: root, place, batch_id."""
    order = Window.orderBy("root")
    n = F.count("*").over(Window.partitionBy())
    ranked = roots.select("root").distinct().select("root", (F.row_number().over(order) - 1).alias("place"), n.alias("total"))
    return ranked.select("root", "place", slice_of(F.col("place"), F.col("total"), workers).alias("batch_id"))
