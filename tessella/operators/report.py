"""Statistics of runs, queues and subtrees."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.storage import numbered


def query_time_range(times: DataFrame) -> DataFrame:
    """times (query_id, node, sec): least and most over nodes."""
    return times.groupBy("query_id").agg(F.min("sec").alias("min_sec"), F.max("sec").alias("max_sec"))


def counter_sums(metrics: DataFrame, columns: list[str]) -> DataFrame:
    return metrics.groupBy("run").agg(*(F.sum(c).alias(c) for c in columns))


def slowest_node_mean(metrics: DataFrame, column: str) -> DataFrame:
    """The most over a run's nodes, then the mean over runs."""
    return metrics.groupBy("run").agg(F.max(column).alias("m")).agg(F.avg("m").alias(column))


def node_means(metrics: DataFrame, column: str) -> DataFrame:
    return metrics.groupBy("node").agg(F.avg(column).alias(column))


def mean_query_times(times: DataFrame) -> DataFrame:
    """times (run, query_id, sec): mean over runs of times rounded to six places."""
    return times.groupBy("query_id").agg(F.avg(F.round("sec", 6)).alias("sec"))


def queue_sizes(stats: DataFrame, most: int | None = 90) -> DataFrame:
    """stats (query_id, bsf, sizes): mean and median queue size of each initial distance, of a repeated one the last query's; smallest distances first."""
    last = Window.partitionBy("bsf").orderBy(F.desc("query_id"))
    one = stats.withColumn("r", F.row_number().over(last)).filter("r = 1")
    each = one.select("bsf", F.explode("sizes").alias("size")).groupBy("bsf").agg(F.avg("size").alias("mean_size"), F.median("size").alias("median_size"), F.count("*").alias("queues"))
    return each.orderBy("bsf").limit(most) if most is not None else each


def size_histogram(sizes: DataFrame, column: str = "n") -> DataFrame:
    """Sizes by power of ten."""
    return sizes.groupBy(F.floor(F.log10(column)).cast("int").alias("power")).agg(F.count("*").alias("n_buckets"), F.sum(column).alias("n_series"))


def empty_share(stats: DataFrame) -> DataFrame:
    """Per cent of subtrees without height."""
    return stats.agg(F.avg(F.when(F.col("height") > 0, 0.0).otherwise(100.0)).alias("empty_pct"))


def symbol_spread(entries: DataFrame, segments: int) -> DataFrame:
    """Mean and population deviation of each segment's symbols."""
    each = entries.select(F.posexplode("sax").alias("segment", "symbol"))
    return each.groupBy("segment").agg(F.avg("symbol").alias("mean"), F.stddev_pop("symbol").alias("deviation"))


def hardest(queries: DataFrame, easy: int, hard: int) -> DataFrame:
    """A benchmark: the easy cheapest and the hard dearest queries by est, each once, cheapest first."""
    ranked, total = numbered(queries, "est", "query_id", name="place"), queries.count()
    up = F.col("place") + 1
    return ranked.filter((up <= easy) | (up > total - hard)).select(*queries.columns, up.cast("int").alias("place"))


def by_setting(metrics: DataFrame, settings: list[str], column: str) -> DataFrame:
    """Comparison of settings (a mode, a threshold, a batch or group size): the most over a run's nodes, then the mean over runs."""
    return metrics.groupBy(*settings, "run").agg(F.max(column).alias("m")).groupBy(*settings).agg(F.avg("m").alias(column), F.count("*").alias("runs"))
