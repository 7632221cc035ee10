"""Text files of estimates, models, statistics and run results, read and written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import parse_series


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """line_no (from 0, over all files by name and place) and value.

    Lines are numbered within the file blocks that are read at once, and blocks by the sums of those before: only the
    table of blocks is ordered as a whole.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("m"))
    inside = F.row_number().over(Window.partitionBy("file", "block").orderBy("m")) - 1
    earlier = F.coalesce(F.sum("n").over(Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = lines.groupBy("file", "block").agg(F.count("*").alias("n")).select("file", "block", earlier.alias("before"))
    return lines.withColumn("k", inside).join(blocks, ["file", "block"]).select("value", (F.col("k") + F.col("before")).cast("long").alias("line_no"))


def write_doubles(rows: DataFrame, order: str, value: str, path: str) -> None:
    """One number a line, in order over files by name: estimates, times or initial distances of a query set."""
    rows.orderBy(order).select(F.format_string("%s", F.col(value)).alias("value")).write.text(path)


def read_doubles(spark: SparkSession, path: str, key: str = "query_id", value: str = "est") -> DataFrame:
    return _lines(spark, path).select(F.col("line_no").alias(key), F.trim("value").cast("double").alias(value))


def read_basis_function(spark: SparkSession, path: str) -> tuple[float, float, float, float, float]:
    """The line "sigmoid m M b c d"."""
    name, *numbers = spark.read.text(path).first()["value"].split()
    if name != "sigmoid" or len(numbers) != 5:
        raise ValueError("expected: sigmoid m M b c d")
    return tuple(map(float, numbers))


def read_delimited_series(spark: SparkSession, path: str, delimiter: str = ",") -> DataFrame:
    return _lines(spark, path).select(F.col("line_no").alias("series_id"), parse_series(F.col("value"), delimiter).alias("values"))


def write_delimited_series(series: DataFrame, path: str, delimiter: str = ",") -> None:
    series.orderBy("series_id").select(F.array_join(F.transform("values", lambda x: x.cast("string")), delimiter).alias("value")).write.text(path)


QUEUE_HEADER = "#query #bsf #th #total_pqs #per_pq_size"


def _with_header(rows: DataFrame, header: str, path: str) -> None:
    spark = rows.sparkSession
    head = spark.createDataFrame([(0, -1, header)], "h int, n long, value string")
    # Ranges in order over files by name; the header sorts first.
    head.unionByName(rows.select(F.lit(1).alias("h"), "n", "value")).orderBy("h", "n").select("value").write.text(path)


def write_queue_stats(stats: DataFrame, path: str) -> None:
    """stats (query_id, bsf, th, total, sizes): a header, then ragged lines."""
    sizes = F.array_join(F.transform("sizes", lambda s: s.cast("string")), " ")
    line = F.concat_ws(" ", F.col("query_id").cast("string"), F.col("bsf").cast("string"), F.col("th").cast("string"), F.col("total").cast("string"), sizes)
    _with_header(stats.select(F.col("query_id").alias("n"), line.alias("value")), QUEUE_HEADER, path)


def read_queue_stats(spark: SparkSession, path: str) -> DataFrame:
    words = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).filter("value not like '#%' and trim(value) <> ''").select(words.alias("w"))
    sizes = F.transform(F.slice("w", 5, F.greatest(F.size("w") - 4, F.lit(0))), lambda x: x.cast("long"))
    return rows.select(F.col("w")[0].cast("long").alias("query_id"), F.col("w")[1].cast("double").alias("bsf"), F.col("w")[2].cast("long").alias("th"), F.col("w")[3].cast("long").alias("total"), sizes.alias("sizes"))


def write_spaced(rows: DataFrame, path: str, header: bool = True) -> None:
    """Rows as lines of values between blanks."""
    rows.write.option("sep", " ").option("header", header).csv(path)


def read_prediction_stats(spark: SparkSession, path: str) -> DataFrame:
    """Query# BSF# BSFresult Leafs# TimeMS: first answers only, seconds."""
    schema = "query_id long, bsf_no int, bsf double, leaves long, time_ms double"
    rows = spark.read.schema(schema).option("sep", " ").option("header", True).option("enforceSchema", True).csv(path)
    return rows.filter("bsf_no = 0").select("query_id", "bsf", "leaves", (F.col("time_ms") / 1000).alias("sec"))


def read_subtree_stats(spark: SparkSession, path: str, with_empty: bool = False) -> DataFrame:
    schema = "query_id long, root long, height int, nodes long, root_lb double, lbs long, leaves long, bsf double"
    rows = spark.read.schema(schema).option("sep", " ").option("header", True).option("enforceSchema", True).csv(path)
    return rows if with_empty else rows.filter("height > 0")


def read_run_results(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """One file a run, in a folder run=<n>; one row a node."""
    schema = "node int, " + ", ".join(f"{c} double" for c in columns)
    return spark.read.schema(f"{schema}, run int").option("sep", " ").csv(path)


def write_run_results(metrics: DataFrame, path: str) -> None:
    """metrics (run, node, ...): a folder run=<n> each."""
    metrics.write.partitionBy("run").option("sep", " ").csv(path)


def write_lines(lines: DataFrame, path: str) -> None:
    lines.select("line").write.text(path)
