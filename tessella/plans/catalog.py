"""The registered queries: each operator over whole tables, and the SQL that gives the same rows.

Series are the z-normalised embeddings; queries are all of them again, each moved by a fixed pattern and z-normalised,
so that every query has a near but not equal neighbour. Indexes of one leaf a root have SQL for every stage; those
with split leaves share the SQL of the full scan, which is the test that they are exact.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import experiments, generate, index, partition, predict, report, schedule, search
from ..sources import binary, text
from .config import IndexConfig
from .storage import new_path, numbered, stamps, written

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

CONFIG = IndexConfig(length=64, segments=8, bits=8, leaf_size=2000)
#: So small that most roots split: for queries that are about the tree, or that show that its shape doesn't matter.
SPLIT = IndexConfig(length=64, segments=8, bits=8, leaf_size=3)
W, N, GROUPS, NODES = 8, 64, 4, 4
#: A sigmoid and a line for the prediction functions: low, high, b, c, d; slope, intercept.
SIGMOID, LINE = (2.0, 900.0, 3.5, 0.25, 12.0), (0.85, -4.0)


def query(name: str, sql: str | None = None):
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return keep


# -- tables ------------------------------------------------------------------------------------------------------


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def series_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = embeddings(spark, sf_dir)
    return table.select(F.col("vec_id").alias("series_id"), C.z_normalize(C.doubles(F.col("embedding"))).alias("values"))


def queries_of(series: DataFrame) -> DataFrame:
    return series.select(F.col("series_id").alias("query_id"), C.z_normalize(C.perturbed(F.col("values"), F.col("series_id"))).alias("values"))


def both(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    series = series_of(spark, sf_dir)
    return series, queries_of(series)


_stored: dict[tuple, str] = {}


def built(spark: SparkSession, sf_dir: str, split: bool | None, anew: bool = False) -> tuple[index.Index, DataFrame, DataFrame]:
    """An index of one leaf a root (False), of SPLIT leaves (True), or as it is used (None); stored, and opened again for the same files."""
    series, asked = both(spark, sf_dir)
    key = (spark.sparkContext.applicationId, split, stamps(spark, f"{sf_dir}/embeddings.parquet"))
    if anew or key not in _stored or not stamps(spark, _stored[key]):
        _stored[key] = index.build(series, SPLIT if split else CONFIG, split is not False).path
    return index.load(spark, _stored[key]), series, asked


def _norm(inner: str) -> str:
    """SQL for a z-normalised list over a CTE with a list column v."""
    return f"SELECT id, label, list_transform(v, lambda x: (x - m) / d) AS v FROM (SELECT *, sqrt(list_sum(list_transform(v, lambda x: (x - m) * (x - m))) / len(v)) AS d FROM (SELECT *, list_sum(v) / len(v) AS m FROM ({inner})))"


_BREAKS = "[" + ", ".join(f"{b!r}::DOUBLE" for b in C.breakpoints(256)) + "]"
_PAA = f"list_transform(range({W}), lambda i: list_sum(v[i * {N // W} + 1 : i * {N // W} + {N // W}]) / {N // W})"
_SERIES = f"""
WITH RECURSIVE bp AS (SELECT {_BREAKS} AS b),
s AS MATERIALIZED ({_norm('SELECT vec_id AS id, label, embedding::DOUBLE[] AS v FROM embeddings')}),
q AS MATERIALIZED ({_norm(f'SELECT id, label, list_transform(range({N}), lambda i: v[i + 1] + ((id * 31 + i * 17) % 13 - 6) * 0.05::DOUBLE) AS v FROM s')})"""
_D2 = "list_sum(list_transform(range(64), lambda i: (q.v[i + 1] - s.v[i + 1]) * (q.v[i + 1] - s.v[i + 1])))"
#: Summaries: paa p, symbols x, root r, for series (ss) and queries (qs).
_SUMMARY = ",\n".join(
    f"""{t}p AS MATERIALIZED (SELECT id, label, v, {_PAA} AS p FROM {t}),
{t}x AS MATERIALIZED (SELECT id, label, v, p, list_transform(p, lambda y: len(list_filter(b, lambda z: z < y))) AS x FROM {t}p, bp),
{t}s AS MATERIALIZED (SELECT *, list_sum(list_transform(range({W}), lambda i: (x[i + 1] // 128) * (1 << ({W - 1} - i))))::BIGINT AS r FROM {t}x)"""
    for t in "sq"
)
_S = f"{_SERIES},\n{_SUMMARY}"
#: Squared gaps of a mean to a range (l, h): edges may be infinite.
_GAP = "CASE WHEN {m} < {l} THEN ({l} - {m}) * ({l} - {m}) WHEN {m} > {h} THEN ({m} - {h}) * ({m} - {h}) ELSE 0 END"
_LO, _HI = "CASE WHEN {s} = 0 THEN '-inf'::DOUBLE ELSE b[{s}] END", "CASE WHEN {s} = 255 THEN 'inf'::DOUBLE ELSE b[{s} + 1] END"


def _lb(means: str, low_symbol: str, high_symbol: str) -> str:
    gap = _GAP.format(m=f"{means}[i + 1]", l=f"({_LO.format(s=low_symbol)})", h=f"({_HI.format(s=high_symbol)})")
    return f"list_sum(list_transform(range({W}), lambda i: {gap})) * {N / W}::DOUBLE"


_LB_ROOT = _lb("q.p", f"(((roots.r >> ({W - 1} - i)) & 1) * 128)", f"(((roots.r >> ({W - 1} - i)) & 1) * 128 + 127)")
_LB_RECORD = _lb("q.p", "s.x[i + 1]", "s.x[i + 1]")
_PAIRS = f"{_S},\nroots AS (SELECT r, count(*) AS n FROM ss GROUP BY r),\nd AS MATERIALIZED (SELECT q.id AS query_id, s.id AS series_id, s.r, q.r AS qr, {_D2} AS d2 FROM qs AS q, ss AS s),\nbsf AS MATERIALIZED (SELECT q.id AS query_id, min(d2) AS bsf FROM qs AS q LEFT JOIN d ON d.query_id = q.id AND d.r = d.qr GROUP BY q.id)"
_BOUNDS = f"{_PAIRS},\nlb AS MATERIALIZED (SELECT q.id AS query_id, roots.r, n, {_LB_ROOT} AS lb FROM qs AS q, roots, bp)"
_RECORDS = f"{_BOUNDS},\nrec AS MATERIALIZED (SELECT q.id AS query_id, s.id AS series_id, s.r, {_LB_RECORD} AS lb FROM qs AS q, ss AS s, bp)"


def _nearest(k: int, more: str = "", columns: str = "query_id, rank, series_id, round(d2, 6) AS d2") -> str:
    return f"{_PAIRS},\nranked AS (SELECT query_id, series_id, d2, row_number() OVER (PARTITION BY query_id ORDER BY d2, series_id)::INTEGER AS rank FROM d {more})\nSELECT {columns} FROM ranked WHERE rank <= {k}"


def rounded(found: DataFrame) -> DataFrame:
    return found.withColumn("d2", F.round("d2", 6))


# -- scans and text sources --------------------------------------------------------------------------------------


@query("s1_binary_scan", "SELECT vec_id AS series_id, len(embedding)::BIGINT AS length, round(list_sum(embedding::DOUBLE[]), 6) AS total FROM embeddings")
def s1(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "series-bin")
    binary.write_series(embeddings(spark, sf_dir).select(F.col("vec_id").alias("series_id"), F.col("embedding").alias("values")), path, N)
    back = binary.read_series(spark, path, N)
    return back.select("series_id", F.size("values").cast("long").alias("length"), F.round(C.total(C.doubles(F.col("values"))), 6).alias("total"))


@query("s2_rank_slices", f"SELECT vec_id AS series_id, least(vec_id // greatest(1, (SELECT max(vec_id) + 1 FROM embeddings) // {NODES}), {NODES - 1})::INTEGER AS part FROM embeddings")
def s2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partition.equal_slices(series_of(spark, sf_dir), NODES)


@query("s3_chunk_scan", "SELECT least(vec_id // greatest(1, (SELECT count(*) FROM embeddings) // 4), 3)::INTEGER AS chunk, count(*)::BIGINT AS n, min(vec_id) AS first_id, max(vec_id) AS last_id FROM embeddings GROUP BY 1")
def s3(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "series-bin")
    table = embeddings(spark, sf_dir).select(F.col("vec_id").alias("series_id"), F.col("embedding").alias("values"))
    binary.write_series(table, path, N)
    n = table.count()
    size, out = max(1, n // 4), None
    for k in range(4):
        chunk = binary.read_series(spark, path, N, first=k * size, rows=size if k < 3 else n - 3 * size, strict="true").select(F.lit(k).alias("chunk"), "series_id")
        out = chunk if out is None else out.unionByName(chunk)
    return out.groupBy("chunk").agg(F.count("*").alias("n"), F.min("series_id").alias("first_id"), F.max("series_id").alias("last_id"))


@query("s4_group_slices", f"SELECT group_id, count(*)::BIGINT AS n, sum(vec_id)::BIGINT AS ids FROM (SELECT vec_id, least(vec_id // greatest(1, (SELECT max(vec_id) + 1 FROM embeddings) // 2), 1)::INTEGER AS group_id FROM embeddings) GROUP BY 1")
def s4(spark: SparkSession, sf_dir: str) -> DataFrame:
    sliced = partition.equal_slices(series_of(spark, sf_dir), 2)
    return sliced.groupBy(F.col("part").alias("group_id")).agg(F.count("*").alias("n"), F.sum("series_id").alias("ids"))


@query("s5_query_scan", "SELECT count(*)::BIGINT AS n, bool_and(len(embedding) = 64) AS valid FROM embeddings")
def s5(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "queries-bin")
    table = embeddings(spark, sf_dir).select(F.col("vec_id").alias("series_id"), F.col("embedding").alias("values"))
    binary.write_series(table, path, N)
    back = binary.read_series(spark, path, N, rows=table.count(), strict="true")
    return back.agg(F.count("*").alias("n"), F.bool_and(F.size("values") == N).alias("valid"))


_COSTS = "SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS query_id, o_totalprice / 1000 AS est FROM orders"


def costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query set with estimates: all orders, their price as cost. Positions are ranks of the key in ranges, so nothing is sorted in one task."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", (F.col("o_totalprice") / 1000).alias("est"))
    width = 1 << 14
    ranged = orders.withColumn("range", F.floor(F.col("o_orderkey") / width))
    before = F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = ranged.groupBy("range").agg(F.count("*").alias("n")).select("range", before.alias("before"))
    place = F.row_number().over(Window.partitionBy("range").orderBy("o_orderkey")) - 1
    return ranged.withColumn("place", place).join(counts, "range").select((F.col("place") + F.col("before")).alias("query_id"), "est")


@query("s7_queries_with_estimates", f"WITH c AS ({_COSTS}) SELECT vec_id AS query_id, est FROM embeddings LEFT JOIN c ON c.query_id = vec_id")
def s7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings(spark, sf_dir).select(F.col("vec_id").alias("query_id")).join(costs(spark, sf_dir), "query_id", "left")


@query("s8_estimates_text", f"SELECT query_id, est FROM ({_COSTS})")
def s8(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "estimates")
    text.write_doubles(costs(spark, sf_dir), "query_id", "est", path)
    return text.read_doubles(spark, path)


@query("s9_basis_function", "SELECT 'sigmoid' AS name, 2.0::DOUBLE AS low, 900.0::DOUBLE AS high, 3.5::DOUBLE AS b, 0.25::DOUBLE AS c, 12.0::DOUBLE AS d")
def s9(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "basis")
    spark.createDataFrame([("sigmoid " + " ".join(map(str, SIGMOID)),)], "value string").coalesce(1).write.text(path)
    return spark.createDataFrame([("sigmoid", *text.read_basis_function(spark, path))], "name string, low double, high double, b double, c double, d double")


@query("s10_delimited_series", "SELECT vec_id AS series_id, len(embedding)::BIGINT AS length, round(list_sum(embedding::DOUBLE[]), 6) AS total FROM embeddings")
def s10(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "delimited")
    text.write_delimited_series(embeddings(spark, sf_dir).select(F.col("vec_id").alias("series_id"), C.doubles(F.col("embedding")).alias("values")), path)
    back = text.read_delimited_series(spark, path)
    return back.select("series_id", F.size("values").cast("long").alias("length"), F.round(C.total(F.col("values")), 6).alias("total"))


#: Queue statistics made of orders and their lines: an order is a query, its total its first distance, its lines its queues.
_QUEUES = "SELECT o_orderkey AS query_id, o_totalprice AS bsf, 100::BIGINT AS th, count(*)::BIGINT AS total, list(l_quantity::BIGINT ORDER BY l_linenumber, l_quantity) AS sizes FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL"


def queue_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("long").alias("q"))
    sizes = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "q"))).alias("s"))
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_totalprice")
    joined = orders.join(sizes, orders.o_orderkey == sizes.l_orderkey)
    return joined.select(F.col("o_orderkey").alias("query_id"), F.col("o_totalprice").alias("bsf"), F.lit(100).cast("long").alias("th"), F.size("s").cast("long").alias("total"), F.transform("s", lambda x: x["q"]).alias("sizes"))


@query("s11_queue_stats_text", f"SELECT query_id, bsf, th, total, list_sum(sizes)::BIGINT AS size, sizes[1] AS first_size FROM ({_QUEUES})")
def s11(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "queues")
    text.write_queue_stats(queue_stats(spark, sf_dir), path)
    back = text.read_queue_stats(spark, path)
    return back.select("query_id", "bsf", "th", "total", F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x).alias("size"), F.col("sizes")[0].alias("first_size"))


#: Prediction statistics made of lines: an order's first line is a query's first answer.
_TIMES = "SELECT l_orderkey AS query_id, (l_linenumber - 1)::INTEGER AS bsf_no, l_extendedprice AS bsf, l_suppkey AS leaves, l_quantity AS time_ms FROM lineitem"


def prediction_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return lines.select(F.col("l_orderkey").alias("query_id"), (F.col("l_linenumber") - 1).cast("int").alias("bsf_no"), F.col("l_extendedprice").alias("bsf"), F.col("l_suppkey").alias("leaves"), F.col("l_quantity").alias("time_ms"))


@query("s12_prediction_stats_text", f"SELECT query_id, bsf, leaves, time_ms / 1000 AS sec FROM ({_TIMES}) WHERE bsf_no = 0")
def s12(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "predictions")
    text.write_spaced(prediction_rows(spark, sf_dir), path)
    return text.read_prediction_stats(spark, path)


def subtree_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subtree statistics of the one-leaf-a-root index: every query and root, roots without series with height 0."""
    one, _, asked = built(spark, sf_dir, False)
    prepared = written(search.prepared(asked, one), "asked")
    seeded, _ = search.seeded(prepared, one, 1)
    seeded = written(seeded, "seeded")
    bounds = search.leaf_bounds(prepared, one)
    roots = spark.range(1 << W).select(F.col("id").alias("root"))
    n = one.leaves.select("leaf", "root")
    full = bounds.join(n, "leaf").join(seeded.select("query_id", "bsf"), "query_id")
    known = full.select("query_id", "root", F.lit(1).alias("height"), F.lit(1).cast("long").alias("nodes"), "lb", F.lit(1).cast("long").alias("lbs"), (F.col("lb") <= F.coalesce("bsf", F.lit(float("inf")))).cast("long").alias("leaves"), "bsf")
    missing = roots.join(one.leaves.select("root"), "root", "left_anti").crossJoin(prepared.select("query_id"))  # 2^w roots at most
    empty = missing.select("query_id", "root", F.lit(0).alias("height"), F.lit(0).cast("long").alias("nodes"), F.lit(None).cast("double").alias("lb"), F.lit(0).cast("long").alias("lbs"), F.lit(0).cast("long").alias("leaves"), F.lit(None).cast("double").alias("bsf"))
    return known.unionByName(empty)


@query("s13_subtree_stats_text", f"{_BOUNDS} SELECT lb.query_id, r AS root, 1 AS height, round(lb, 6) AS root_lb, (lb <= coalesce(bsf, 'inf'::DOUBLE))::BIGINT AS leaves FROM lb JOIN bsf ON bsf.query_id = lb.query_id")
def s13(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "subtrees")
    text.write_spaced(subtree_rows(spark, sf_dir), path)
    return text.read_subtree_stats(spark, path).select("query_id", "root", "height", F.round("root_lb", 6).alias("root_lb"), "leaves")


#: Run metrics made of events: a user's hour is a run's node.
_METRICS = "SELECT (date_part('day', ts) % 5)::INTEGER AS run, (user_id % 4)::INTEGER AS node, round(sum(value), 6) AS total_time, count(*)::DOUBLE AS real_distances, max(value) AS slowest FROM events GROUP BY 1, 2"


def run_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    keyed = events.select((F.dayofmonth("ts") % 5).alias("run"), (F.col("user_id") % 4).cast("int").alias("node"), "value")
    return keyed.groupBy("run", "node").agg(F.round(F.sum("value"), 6).alias("total_time"), F.count("*").cast("double").alias("real_distances"), F.max("value").alias("slowest"))


@query("s14_run_results_text", f"SELECT run, node, round(total_time, 4) AS total_time, real_distances, slowest FROM ({_METRICS})")
def s14(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "runs")
    text.write_run_results(run_metrics(spark, sf_dir).select("run", "node", "total_time", "real_distances", "slowest"), path)
    back = text.read_run_results(spark, path, ["total_time", "real_distances", "slowest"])
    return back.select("run", "node", F.round("total_time", 4).alias("total_time"), "real_distances", "slowest")


# -- functions ---------------------------------------------------------------------------------------------------


def _exploded(rows: DataFrame, key: str, column: str, name: str, places: int | None = 9) -> DataFrame:
    out = rows.select(key, F.posexplode(column).alias("place", name))
    return out.withColumn(name, F.round(name, places)) if places is not None else out


@query("f1_paa", f"{_S} SELECT id AS series_id, unnest(range({W}))::INTEGER AS place, round(unnest(p), 9) AS mean FROM sp")
def f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _exploded(series_of(spark, sf_dir).select("series_id", C.paa(F.col("values"), N, W).alias("p")), "series_id", "p", "mean")


@query("f2_sax_from_paa", f"{_S} SELECT id AS series_id, unnest(range({W}))::INTEGER AS place, unnest(x)::INTEGER AS symbol FROM sx")
def f2(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = series_of(spark, sf_dir).select("series_id", C.paa(F.col("values"), N, W).alias("p"))
    return _exploded(means.select("series_id", C.sax_from_paa(F.col("p")).alias("x")), "series_id", "x", "symbol", None)


@query("f3_sax_from_series", SQL["f2_sax_from_paa"])
def f3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The Arrow kernel; f2 is the column function."""
    return _exploded(index.summarise(series_of(spark, sf_dir), CONFIG), "series_id", "sax", "symbol", None)


@query("f6_mindist_node", f"{_BOUNDS} SELECT query_id, r AS root, round(lb, 6) AS lb FROM lb")
def f6(spark: SparkSession, sf_dir: str) -> DataFrame:
    one, _, asked = built(spark, sf_dir, False)
    bounds = search.leaf_bounds(search.prepared(asked, one), one)
    return bounds.select("query_id", F.col("leaf").cast("long").alias("root"), F.round("lb", 6).alias("lb"))


def _paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each query with the series that it was made of."""
    series = series_of(spark, sf_dir)
    rows = series.select("series_id", F.col("values").alias("s"), C.z_normalize(C.perturbed(F.col("values"), F.col("series_id"))).alias("q"))
    return rows.select("series_id", "s", "q", C.paa(F.col("q"), N, W).alias("qp"), C.sax_from_series(F.col("s"), N, W).alias("x"))


@query("f8_mindist_record", f"{_S} SELECT s.id AS series_id, round({_LB_RECORD}, 6) AS lb, round({_D2}, 6) AS d2, {_LB_RECORD} <= {_D2} AS holds FROM qs AS q JOIN ss AS s ON s.id = q.id, bp")
def f8(spark: SparkSession, sf_dir: str) -> DataFrame:
    lb, d2 = C.mindist_record(F.col("qp"), F.col("x"), N / W), C.euclid2(F.col("q"), F.col("s"))
    return _paired(spark, sf_dir).select("series_id", F.round(lb, 6).alias("lb"), F.round(d2, 6).alias("d2"), (lb <= d2).alias("holds"))


@query("f11_mindist_record_bounded", f"{_S}, lbs AS (SELECT s.id AS series_id, {_LB_RECORD} AS lb, (s.id % 7) * 0.02::DOUBLE AS bsf FROM qs AS q JOIN ss AS s ON s.id = q.id, bp) SELECT series_id, CASE WHEN lb <= bsf THEN round(lb, 6) END AS lb FROM lbs")
def f11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bound of a record where it is within a best distance so far, else null."""
    lb = C.mindist_record_bounded(F.col("qp"), F.col("x"), N / W, F.col("series_id") % 7 * 0.02)
    return _paired(spark, sf_dir).select("series_id", F.round(lb, 6).alias("lb"))


@query("f7_mindist_word", f"{_S} SELECT s.id AS series_id, round({_lb('q.p', '(s.x[i + 1] // 32 * 32)', '(s.x[i + 1] // 32 * 32 + 31)')}, 6) AS lb FROM qs AS q JOIN ss AS s ON s.id = q.id, bp")
def f7(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = F.array(*([F.lit(3)] * W))
    return _paired(spark, sf_dir).select("series_id", F.round(C.mindist(F.col("qp"), C.isax_word(F.col("x"), kept), kept, N / W), 6).alias("lb"))


@query("f12_euclid2", f"{_SERIES} SELECT id AS series_id, round(d2, 6) AS d2, round(CASE WHEN d2 < 2.25 THEN d2 END, 6) AS under FROM (SELECT s.id, {_D2} AS d2 FROM q JOIN s ON s.id = q.id)")
def f12(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _paired(spark, sf_dir)
    return rows.select("series_id", F.round(C.euclid2(F.col("q"), F.col("s")), 6).alias("d2"), F.round(C.euclid2_bounded(F.col("q"), F.col("s"), F.lit(2.25)), 6).alias("under"))


@query("f15_z_normalize", f"{_SERIES} SELECT id AS series_id, unnest(range({N}))::INTEGER AS place, round(unnest(v), 9) AS value FROM s")
def f15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _exploded(series_of(spark, sf_dir), "series_id", "values", "value")


@query("f16_root_mask", f"{_S} SELECT id AS series_id, r AS root FROM ss")
def f16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series_of(spark, sf_dir).select("series_id", C.root_mask(C.sax_from_series(F.col("values"), N, W)).alias("root"))


@query("f17_isax_word", f"{_S} SELECT id AS series_id, array_to_string(list_transform(x, lambda y: y // 32), ' ') AS word FROM ss")
def f17(spark: SparkSession, sf_dir: str) -> DataFrame:
    word = C.isax_word(C.sax_from_series(F.col("values"), N, W), F.array(*([F.lit(3)] * W)))
    return series_of(spark, sf_dir).select("series_id", F.array_join(word.cast("array<string>"), " ").alias("word"))


@query("f18_gray_code", "SELECT o_orderkey, xor(o_orderkey, o_orderkey >> 1) AS gray, o_orderkey AS back FROM orders")
def f18(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", C.decimal_to_gray(F.col("o_orderkey")).alias("gray"))
    return rows.withColumn("back", C.gray_to_decimal(F.col("gray")))


_SIG = "2.0::DOUBLE + (900.0::DOUBLE - 2.0::DOUBLE) / (1 + 3.5::DOUBLE * exp(-0.25::DOUBLE * (value - 12.0::DOUBLE)))"


@query("f20_sigmoid", f"SELECT event_id, round({_SIG}, 6) AS y FROM events")
def f20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.round(C.sigmoid(F.col("value"), *SIGMOID), 6).alias("y"))


@query("f21_estimate_threshold", f"SELECT event_id, greatest(1, trunc({_SIG})::INTEGER // 16)::INTEGER AS th, -1 AS without_model FROM events")
def f21(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.select("event_id", C.estimate_threshold(F.col("value"), SIGMOID, 16).alias("th"), C.estimate_threshold(F.col("value"), None).alias("without_model"))


@query("f22_linear_predict", "SELECT event_id, round(CASE WHEN value * 0.85::DOUBLE - 4.0::DOUBLE < 0 THEN 1e-5::DOUBLE ELSE value * 0.85::DOUBLE - 4.0::DOUBLE END, 6) AS y FROM events")
def f22(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.round(C.linear_predict(F.col("value"), *LINE), 6).alias("y"))


@query("f23_model_forms", "SELECT event_id, round((0.5::DOUBLE * value - 2) * value + 3, 6) AS poly2, round(((((1e-6::DOUBLE * value + 1e-5::DOUBLE) * value - 1e-4::DOUBLE) * value + 0.01::DOUBLE) * value - 1) * value + 5, 4) AS poly5, round(1.5::DOUBLE + 2.5::DOUBLE * ln(value), 6) AS logarithm FROM events WHERE value > 0")
def f23(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("value")
    return spark.read.parquet(f"{sf_dir}/events.parquet").filter(x > 0).select("event_id", F.round(C.polynomial(x, (0.5, -2, 3)), 6).alias("poly2"), F.round(C.polynomial(x, (1e-6, 1e-5, -1e-4, 0.01, -1, 5)), 4).alias("poly5"), F.round(C.logarithm(x, 1.5, 2.5), 6).alias("logarithm"))


@query("f24_pct_error", "SELECT l_orderkey, l_linenumber, round(abs(l_extendedprice - l_quantity * 1500) * 100 / (l_quantity * 1500), 6) AS error, round(l_extendedprice / 7, 2) AS two FROM lineitem")
def f24(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    error = C.pct_error(F.col("l_extendedprice"), F.col("l_quantity") * 1500)
    return lines.select("l_orderkey", "l_linenumber", F.round(error, 6).alias("error"), C.two_decimals(F.col("l_extendedprice") / 7).alias("two"))


@query("f26_bit_string", f"{_S} SELECT id AS series_id, array_to_string(list_transform(x, lambda y: lpad(bin(y::BIGINT), 8, '0')), ' ') AS bits FROM ss")
def f26(spark: SparkSession, sf_dir: str) -> DataFrame:
    bits = F.transform(C.sax_from_series(F.col("values"), N, W), lambda s: C.bit_string(s))
    return series_of(spark, sf_dir).select("series_id", F.array_join(bits, " ").alias("bits"))


@query("f27_pair_rank", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey + 1 ELSE o_orderkey - 1 END AS pair FROM orders")
def f27(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", C.pair_rank(F.col("o_orderkey")).alias("pair"))


def _drawn(seed: int, key: str) -> str:
    return f"('0x' || substr(md5('{seed}:' || {key}), 1, 8))::BIGINT"


@query("f28_shuffle", f"SELECT vec_id AS series_id, row_number() OVER (ORDER BY md5('7:' || vec_id), vec_id) - 1 AS place, {_drawn(8, 'vec_id')} % 100 AS number FROM embeddings")
def f28(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A seeded order of all series, and a seeded whole number for each."""
    series = generate.shuffled(series_of(spark, sf_dir).select("series_id"), 7)
    return series.select("series_id", "place", generate.random_int(8, 100, F.col("series_id")).alias("number"))


@query("f29_gaussian_noise")
def f29(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series_of(spark, sf_dir).select("series_id", generate.gaussian_noise_of(0.25, 11, F.col("series_id")).alias("noise"))


# -- pruning and joins -------------------------------------------------------------------------------------------


@query("p1_leaves_not_pruned", f"{_BOUNDS} SELECT lb.query_id, count(*) FILTER (WHERE lb <= coalesce(bsf, 'inf'::DOUBLE))::BIGINT AS leaves, count(*) FILTER (WHERE lb <= least(coalesce(bsf, 'inf'::DOUBLE), 10))::BIGINT AS in_radius FROM lb JOIN bsf ON bsf.query_id = lb.query_id GROUP BY 1")
def p1(spark: SparkSession, sf_dir: str) -> DataFrame:
    one, _, asked = built(spark, sf_dir, False)
    prepared = written(search.prepared(asked, one), "asked")
    seeded, _ = search.seeded(prepared, one, 1)
    rows = search.leaf_bounds(prepared, one).join(seeded.select("query_id", F.coalesce("bsf", F.lit(float("inf"))).alias("bsf")), "query_id")
    return rows.groupBy("query_id").agg(F.count_if(F.col("lb") <= F.col("bsf")).alias("leaves"), F.count_if(F.col("lb") <= F.least("bsf", F.lit(10.0))).alias("in_radius"))


@query("p3_a5_search_counts", f"{_RECORDS} SELECT lb.query_id, count(*) FILTER (WHERE rec.lb <= coalesce(bsf, 'inf'::DOUBLE))::BIGINT AS real, count(*)::BIGINT AS bounds, count(DISTINCT lb.r)::BIGINT AS leaves FROM lb JOIN bsf ON bsf.query_id = lb.query_id JOIN rec ON rec.query_id = lb.query_id AND rec.r = lb.r WHERE lb.lb <= coalesce(bsf, 'inf'::DOUBLE) GROUP BY 1")
def p3(spark: SparkSession, sf_dir: str) -> DataFrame:
    one, _, asked = built(spark, sf_dir, False)
    return search.counts(asked, one).select("query_id", "real", "bounds", "leaves")


@query("p4_zero_distance_exit", f"{_SERIES} SELECT q.id AS query_id, 1 AS rank, min(s.id) AS series_id, 0.0::DOUBLE AS d2 FROM s AS q JOIN s ON s.v = q.v GROUP BY 1")
def p4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries that are in the collection have their answer at the seed, and visit nothing else."""
    tree, series, _ = built(spark, sf_dir, True)
    return search.exact(series.withColumnRenamed("series_id", "query_id"), tree, 1, seeds_first=True)


@query("p5_radius_search", f"{_BOUNDS}, kept AS (SELECT d.query_id, d.series_id, d.d2 FROM d JOIN lb ON lb.query_id = d.query_id AND lb.r = d.r JOIN bsf ON bsf.query_id = d.query_id WHERE d.r = d.qr OR lb.lb <= least(coalesce(bsf, 'inf'::DOUBLE), 0.05)), ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d2, series_id)::INTEGER AS rank FROM kept) SELECT query_id, rank, series_id, round(d2, 6) AS d2 FROM ranked WHERE rank = 1")
def p5(spark: SparkSession, sf_dir: str) -> DataFrame:
    one, _, asked = built(spark, sf_dir, False)
    return rounded(search.exact(asked, one, 1, radius=0.05))


@query("p6_empty_roots", f"{_S} SELECT (256 - count(DISTINCT r))::BIGINT AS empty_roots, 100.0::DOUBLE * (256 - count(DISTINCT r)) / 256 AS empty_pct FROM ss")
def p6(spark: SparkSession, sf_dir: str) -> DataFrame:
    full = partition.histogram(index.summarise(series_of(spark, sf_dir), CONFIG))
    return full.agg((F.lit(1 << W) - F.count("*")).alias("empty_roots"), (F.lit(100.0) * (F.lit(1 << W) - F.count("*")) / (1 << W)).alias("empty_pct"))


@query("j1_exact_nn", _nearest(1))
def j1(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree, _, asked = built(spark, sf_dir, None)
    return rounded(search.exact(asked, tree, 1))


@query("j2_seed_leaf", f"{_PAIRS} SELECT q.id AS query_id, roots.r AS root, roots.n AS n FROM qs AS q LEFT JOIN roots ON roots.r = q.r")
def j2(spark: SparkSession, sf_dir: str) -> DataFrame:
    one, _, asked = built(spark, sf_dir, False)
    return search.prepared(asked, one).select("query_id", F.col("leaf").cast("long").alias("root"), F.col("leaf_n").alias("n"))


@query("j4_candidate_series", f"{_BOUNDS} SELECT lb.query_id, d.series_id FROM lb JOIN d ON d.query_id = lb.query_id AND d.r = lb.r JOIN bsf ON bsf.query_id = lb.query_id WHERE lb <= coalesce(bsf, 'inf'::DOUBLE)")
def j4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The series of the leaves that aren't pruned, of each query."""
    one, _, asked = built(spark, sf_dir, False)
    return search.candidates(asked, one)


@query("j5_query_distances", f"{_SERIES} SELECT a AS query_id, round(min(d2), 6) AS nearest, round(max(d2), 6) AS farthest, round(avg(d2), 6) AS mean FROM (SELECT q.id AS a, {_D2.replace('s.v', 'o.v')} AS d2 FROM q JOIN q AS o ON o.id <> q.id) GROUP BY 1")
def j5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.self_distances(queries_of(series_of(spark, sf_dir)), N).select("query_id", *(F.round(c, 6).alias(c) for c in ("nearest", "farthest", "mean")))


# -- search ------------------------------------------------------------------------------------------------------


@query("r1_approximate_nn", _nearest(1, "WHERE r = qr"))
def r1(spark: SparkSession, sf_dir: str) -> DataFrame:
    one, _, asked = built(spark, sf_dir, False)
    return rounded(search.approximate(search.prepared(asked, one), one))


@query("r2_exact_root_leaves", _nearest(1))
def r2(spark: SparkSession, sf_dir: str) -> DataFrame:
    one, _, asked = built(spark, sf_dir, False)
    return rounded(search.exact(asked, one, 1))


def _batched(entries: DataFrame) -> DataFrame:
    return partition.root_batches(entries.select("root"), NODES)


@query("r3_exact_by_batches", _nearest(1))
def r3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every batch of roots searched on its own with the shared seed distance, then merged."""
    tree, _, asked = built(spark, sf_dir, True)
    prepared = written(search.prepared(asked, tree), "asked")
    seeded, seeds = search.seeded(prepared, tree, 1)
    bsf = written(seeded.select("query_id", "bsf"), "bsf")
    answers = seeds.select("query_id", "series_id", "d2")
    for row in _batched(tree.entries).groupBy("batch_id").agg(F.min("root").alias("a"), F.max("root").alias("b")).collect():
        answers = answers.unionByName(search.exact(asked, tree, 1, bsf=bsf, only=F.col("root").between(row.a, row.b)).select("query_id", "series_id", "d2"))
    return rounded(schedule.merged(answers)).select("query_id", F.lit(1).alias("rank"), "series_id", "d2")


_SOME = f"{_PAIRS}, places AS (SELECT r, row_number() OVER (ORDER BY r) - 1 AS place, count(*) OVER () AS total FROM roots), batches AS (SELECT r, least(place // greatest(1, total // {NODES}), {NODES - 1}) AS batch_id FROM places)"


@query("r4_stolen_batches", f"{_SOME}, ranked AS (SELECT d.query_id, series_id, d2, row_number() OVER (PARTITION BY d.query_id ORDER BY d2, series_id)::INTEGER AS rank FROM d JOIN batches USING (r) JOIN bsf ON bsf.query_id = d.query_id WHERE batch_id IN (1, 3) AND d2 <= coalesce(bsf, 'inf'::DOUBLE)) SELECT query_id, rank, series_id, round(d2, 6) AS d2 FROM ranked WHERE rank = 1")
def r4(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree, _, asked = built(spark, sf_dir, True)
    one = index.build(series_of(spark, sf_dir), CONFIG, False)
    bsf = written(search.seeded(search.prepared(asked, one), one)[0].select("query_id", "bsf"), "bsf")
    stolen = [r.root for r in _batched(tree.entries).filter("batch_id in (1, 3)").collect()]
    return rounded(search.exact(asked, tree, 1, bsf=bsf, only=F.col("root").isin(stolen)))


@query("r5_limited_refine", f"{_BOUNDS}, chosen AS (SELECT query_id, r FROM (SELECT query_id, r, row_number() OVER (PARTITION BY query_id ORDER BY lb, r::VARCHAR) AS k FROM lb) WHERE k <= 5 UNION SELECT query_id, r FROM d WHERE r = qr), ranked AS (SELECT d.query_id, series_id, d2, row_number() OVER (PARTITION BY d.query_id ORDER BY d2, series_id)::INTEGER AS rank FROM d JOIN chosen ON chosen.query_id = d.query_id AND chosen.r = d.r) SELECT query_id, rank, series_id, round(d2, 6) AS d2 FROM ranked WHERE rank = 1")
def r5(spark: SparkSession, sf_dir: str) -> DataFrame:
    one, _, asked = built(spark, sf_dir, False)
    return rounded(search.limited(asked, one, 5))


@query("r6_leaf_scan", f"{_PAIRS} SELECT query_id, r AS root, count(*)::BIGINT AS n, round(min(d2), 6) AS d2 FROM d WHERE r = qr GROUP BY ALL")
def r6(spark: SparkSession, sf_dir: str) -> DataFrame:
    one, _, asked = built(spark, sf_dir, False)
    prepared = written(search.prepared(asked, one), "asked")
    best = search.approximate(prepared, one)
    return rounded(best.join(prepared.select("query_id", F.col("leaf").cast("long").alias("root"), F.col("leaf_n").alias("n")), "query_id")).select("query_id", "root", "n", "d2")


@query("r7_leaf_scan_with_bounds", f"{_PAIRS} SELECT query_id, count(*)::BIGINT AS bounds, round(min(d2), 6) AS d2 FROM d WHERE r = qr GROUP BY 1")
def r7(spark: SparkSession, sf_dir: str) -> DataFrame:
    one, _, asked = built(spark, sf_dir, False)
    return rounded(search.leaf_scan(search.prepared(asked, one), one).select("query_id", "bounds", "d2"))


@query("r9_r10_per_root_answers", f"{_RECORDS}, best AS (SELECT query_id, r, min(d2) AS d2 FROM d GROUP BY ALL), tight AS (SELECT query_id, r, min(lb) AS tight FROM rec GROUP BY ALL) SELECT query_id, r AS root, round(lb.lb, 6) AS lb, round(tight, 6) AS tight, round(d2, 6) AS d2 FROM lb JOIN best USING (query_id, r) JOIN tight USING (query_id, r)")
def r10(spark: SparkSession, sf_dir: str) -> DataFrame:
    one, _, asked = built(spark, sf_dir, False)
    found = search.per_root(asked, one)
    return found.select("query_id", F.col("leaf").cast("long").alias("root"), *(F.round(c, 6).alias(c) for c in ("lb", "tight", "d2")))


@query("r13_exact_given_bsf", _nearest(1))
def r13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No seed of our own: the distance to the series that the query was made of is known before."""
    series, asked = both(spark, sf_dir)
    known = asked.join(series.withColumnRenamed("values", "s"), F.col("query_id") == F.col("series_id")).select("query_id", (C.euclid2(F.col("values"), F.col("s")) * (1 + 1e-12)).alias("bsf"))
    tree = index.build(series, SPLIT)
    return rounded(search.exact(asked, tree, 1, bsf=written(known, "bsf")))


@query("r15_root_range", f"{_PAIRS}, ranked AS (SELECT d.query_id, series_id, d2, row_number() OVER (PARTITION BY d.query_id ORDER BY d2, series_id)::INTEGER AS rank FROM d WHERE r BETWEEN 64 AND 191) SELECT query_id, rank, series_id, round(d2, 6) AS d2 FROM ranked WHERE rank = 1")
def r15(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree, _, asked = built(spark, sf_dir, True)
    unknown = asked.select("query_id", F.lit(None).cast("double").alias("bsf"))
    return rounded(search.exact(asked, tree, 1, bsf=unknown, only=F.col("root").between(64, 191)))


@query("r17_top_k_exact", _nearest(5))
def r17(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree, _, asked = built(spark, sf_dir, None)
    return rounded(search.exact(asked, tree, 5))


@query("r17_top_k_approximate", _nearest(5, "WHERE r = qr"))
def r17a(spark: SparkSession, sf_dir: str) -> DataFrame:
    one, _, asked = built(spark, sf_dir, False)
    return rounded(search.approximate(search.prepared(asked, one), one, 5))


@query("r18_knn_classify", f"{_PAIRS}, ranked AS (SELECT query_id, series_id, row_number() OVER (PARTITION BY query_id ORDER BY d2, series_id) AS rank FROM d), votes AS (SELECT query_id, label, count(*)::BIGINT AS votes FROM ranked JOIN embeddings ON vec_id = series_id WHERE rank <= 5 GROUP BY ALL) SELECT query_id, label, votes FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY votes DESC, label) AS k FROM votes) WHERE k = 1")
def r18(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree, _, asked = built(spark, sf_dir, None)
    labels = embeddings(spark, sf_dir).select(F.col("vec_id").alias("series_id"), "label")
    return search.classify(search.exact(asked, tree, 5), labels)


@query("r19_serial_scan", _nearest(1))
def r19(spark: SparkSession, sf_dir: str) -> DataFrame:
    series, asked = both(spark, sf_dir)
    return rounded(search.serial(asked, series, CONFIG))


# -- index -------------------------------------------------------------------------------------------------------


@query("i1_summarise_and_route", f"{_S} SELECT id AS series_id, r AS root, array_to_string(x, ' ') AS sax FROM ss")
def i1(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = index.summarise(series_of(spark, sf_dir), CONFIG)
    return rows.select("series_id", "root", F.array_join(F.col("sax").cast("array<string>"), " ").alias("sax"))


@query("i2_tree_leaves")
def i2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves of the split tree, built anew: their words, and how many series each holds."""
    tree, _, _ = built(spark, sf_dir, True, anew=True)
    return tree.leaves.select("leaf", "root", F.array_join(F.col("word").cast("array<string>"), " ").alias("word"), F.array_join(F.col("kept").cast("array<string>"), " ").alias("kept"), "n")


@query("i2_tree_invariants", f"{_S} SELECT r AS root, count(*)::BIGINT AS n_series, 0::BIGINT AS broken FROM ss GROUP BY 1")
def i2i(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each root its series, and those whose leaf is too full though it could split, or whose word, root or path isn't the leaf's."""
    tree, _, _ = built(spark, sf_dir, True)
    rows = tree.entries.select("series_id", "sax", "leaf", F.col("root").alias("own")).join(tree.leaves, "leaf")
    taken = F.size(F.split("leaf", r"\.")) / 2
    able = F.exists(F.zip_with("kept", "sax", lambda k, x: k < SPLIT.bits), lambda x: x)
    told = F.concat(F.col("root").cast("string"), F.lit("."))
    wrong = (C.isax_word(F.col("sax"), F.col("kept"), SPLIT.bits) != F.col("word")) | (F.col("own") != F.col("root")) | (F.aggregate("kept", F.lit(0), lambda a, k: a + k) != W + F.floor(taken)) | ~((F.col("leaf") == F.col("root").cast("string")) | F.startswith("leaf", told))
    words = rows.groupBy("leaf").agg(F.count_distinct("sax").alias("words"))
    rows = rows.join(words, "leaf")
    full = (F.col("n") > SPLIT.leaf_size) & able & (F.col("words") > 1)
    return rows.groupBy("root").agg(F.count("*").alias("n_series"), F.count_if(wrong | full).alias("broken"))


@query("i8_validity", f"{_S} SELECT count(*)::BIGINT AS n_series, count(*)::BIGINT AS n_in_leaves FROM ss")
def i8(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree, series, _ = built(spark, sf_dir, True)
    return index.validity(tree, series).select("n_series", "n_in_leaves")


@query("i9_tree_statistics", f"{_S} SELECT r AS root, count(*)::BIGINT AS n_series FROM ss GROUP BY 1")
def i9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series per root, counted through the tree's statistics; shapes are tested against invariants."""
    tree, _, _ = built(spark, sf_dir, True)
    return index.statistics(tree).select("root", "n_series")


@query("i9_tree_shape")
def i9s(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree, _, _ = built(spark, sf_dir, True)
    return index.statistics(tree)


@query("i10_series_per_root", f"{_S} SELECT r AS root, count(*)::BIGINT AS n FROM ss GROUP BY 1")
def i10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partition.histogram(index.summarise(series_of(spark, sf_dir), CONFIG))


@query("i14_query_groups", f"{_SERIES},\n{_SUMMARY}, g AS (SELECT r, min(id) AS representative, count(*)::BIGINT AS n FROM qs GROUP BY 1) SELECT s.id AS query_id, s.r AS root, representative, n, round({_D2}, 6) AS d2 FROM qs AS s JOIN g ON g.r = s.r JOIN qs AS q ON q.id = representative")
def i14(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = index.summarise(queries_of(series_of(spark, sf_dir)), CONFIG, "query_id").select("query_id", "values", "root")
    groups = asked.groupBy("root").agg(F.min("query_id").alias("representative"), F.count("*").alias("n"))
    first = asked.select(F.col("query_id").alias("representative"), F.col("values").alias("r_values"))
    rows = asked.join(groups, "root").join(first, "representative")
    return rows.select("query_id", "root", "representative", "n", F.round(C.euclid2(F.col("r_values"), F.col("values")), 6).alias("d2"))


@query("k10_dot_export")
def k10(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "dot")
    tree, _, _ = built(spark, sf_dir, True)
    text.write_lines(index.dot_edges(tree), path)
    return spark.read.text(path)


# -- partitioning ------------------------------------------------------------------------------------------------


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.summarise(series_of(spark, sf_dir), CONFIG).select("series_id", "root")


_GRAY = f"{_S}, h AS (SELECT r, count(*)::BIGINT AS n FROM ss GROUP BY 1), dealt AS (SELECT r AS root, n, ((row_number() OVER (ORDER BY xor(r, r >> 1)) - 1) % {GROUPS})::INTEGER AS group_id FROM h)"

QUERIES["d1_equal_split"], SQL["d1_equal_split"] = s2, SQL["s2_rank_slices"]
QUERIES["d2_group_split"], SQL["d2_group_split"] = s4, SQL["s4_group_slices"]


@query("d3_node_groups", "SELECT s_suppkey AS rank, (s_suppkey // 4)::INTEGER AS group_id, s_suppkey % 4 = 0 AS coordinator FROM supplier")
def d3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partition.node_groups(spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("rank")), 4)


@query("d4_gray_deal", f"{_GRAY} SELECT * FROM dealt")
def d4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partition.gray_deal(partition.histogram(_entries(spark, sf_dir)), GROUPS)


_SPLIT_ALL = f"SELECT id AS series_id, ((row_number() OVER (PARTITION BY r ORDER BY id) - 1) % {GROUPS})::INTEGER AS group_id FROM ss"


@query("d4_density_aware", f"{_S} {_SPLIT_ALL}")
def d4a(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest 4000 buckets split over all groups: here that is all of them."""
    return partition.density_aware(_entries(spark, sf_dir), GROUPS, partition.ROUND)


@query("d4_density_aware_largest", f"{_GRAY}, big AS (SELECT root FROM dealt ORDER BY n DESC, root LIMIT 8) SELECT series_id, group_id FROM ({_SPLIT_ALL.replace('SELECT id', 'SELECT r, id')}) WHERE r IN (FROM big) UNION ALL SELECT id, group_id FROM ss JOIN dealt ON root = r WHERE r NOT IN (FROM big)")
def d4l(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 8 largest buckets split, the others dealt, at a rate that needs no rebalancing."""
    return partition.density_aware(_entries(spark, sf_dir), GROUPS, 8, rate=1e9)


@query("d4_density_aware_rebalanced")
def d4r(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partition.density_aware(_entries(spark, sf_dir), GROUPS, 8)


@query("d5_split_bucket", f"{_S} SELECT id AS series_id, r AS root, ((row_number() OVER (PARTITION BY r ORDER BY id) - 1) % {GROUPS})::INTEGER AS group_id FROM ss")
def d5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partition.split_bucket(_entries(spark, sf_dir), GROUPS).select("series_id", "root", "group_id")


@query("d6_rebalance", f"""{_GRAY},
g AS MATERIALIZED (SELECT list(sizes ORDER BY group_id) AS own, list(load ORDER BY group_id) AS loads FROM (SELECT group_id, list(n ORDER BY n DESC, root) AS sizes, sum(n)::DOUBLE AS load FROM dealt GROUP BY 1)),
f AS (SELECT 0::BIGINT AS k, loads, list_transform(loads, lambda x: 0::BIGINT) AS taken, list_sum(loads) / {GROUPS} AS mean FROM g
UNION ALL SELECT k + 1, list_transform(f.loads, lambda x, i: x - CASE WHEN i = list_position(f.loads, list_max(f.loads)) THEN own[i][taken[i] + 1] ELSE 0 END + own[list_position(f.loads, list_max(f.loads))][taken[list_position(f.loads, list_max(f.loads))] + 1] / {GROUPS}::DOUBLE),
  list_transform(taken, lambda x, i: x + (i = list_position(f.loads, list_max(f.loads)))::BIGINT), mean
  FROM f, g WHERE list_max(f.loads) / mean > 1.05 AND taken[list_position(f.loads, list_max(f.loads))] < len(own[list_position(f.loads, list_max(f.loads))])),
e AS (SELECT * FROM f ORDER BY k DESC LIMIT 1)
SELECT (unnest(range({GROUPS})))::INTEGER AS group_id, round(unnest(loads), 6) AS load, k::INTEGER AS n_split FROM e""")
def d6(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = partition.gray_deal(partition.histogram(_entries(spark, sf_dir)), GROUPS)
    split, loads = partition.rebalance([(r.root, r.n, r.group_id) for r in dealt.collect()], GROUPS)
    return spark.createDataFrame([(g, round(load, 6), len(split)) for g, load in enumerate(loads)], "group_id int, load double, n_split int")


@query("d8_group_counts", f"{_GRAY} SELECT group_id, sum(n)::BIGINT AS n_series FROM dealt GROUP BY 1")
def d8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partition.group_counts(partition.gray_deal(partition.histogram(_entries(spark, sf_dir)), GROUPS))


@query("d9_half_of_roots", _nearest(1, columns="query_id, series_id, round(d2, 6) AS d2"))
def d9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each of two nodes has the whole index and searches half of the subtrees with the shared seed; the answers are merged."""
    tree, _, asked = built(spark, sf_dir, True)
    seeded, seeds = search.seeded(written(search.prepared(asked, tree), "asked"), tree, 1)
    bsf = written(seeded.select("query_id", "bsf"), "bsf")
    answers = seeds.select("query_id", "series_id", "d2")
    for low, high in ((0, 127), (128, 255)):
        answers = answers.unionByName(search.exact(asked, tree, 1, bsf=bsf, only=F.col("root").between(low, high)).select("query_id", "series_id", "d2"))
    return rounded(schedule.merged(answers))


@query("o3_largest_buckets", f"{_S} SELECT root, n, place FROM (SELECT r AS root, count(*)::BIGINT AS n, row_number() OVER (ORDER BY count(*) DESC, r)::INTEGER AS place FROM ss GROUP BY 1) WHERE place <= 4000")
def o3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partition.largest(partition.histogram(_entries(spark, sf_dir)))


# -- scheduling and queues ---------------------------------------------------------------------------------------


#: The queries that have an estimate: all of costs().
_EST = f"WITH RECURSIVE e AS MATERIALIZED ({_COSTS})"


def _inorder(order: str) -> str:
    """The estimates in an order as one list, ests, and the queries, ids; n of them."""
    return f"{_EST}, l AS MATERIALIZED (SELECT list(est ORDER BY {order}) AS ests, list(query_id ORDER BY {order}) AS ids, count(*) AS n FROM e)"


def _greedy(order: str, nodes: int = NODES) -> str:
    """k, given (the node of query k), scores after it."""
    now = "scores[node + 1] + ests[k + 1]"
    return f"""{_inorder(order)}, f AS (SELECT 0::BIGINT AS k, 0 AS given, 0 AS node, list_transform(range({nodes}), lambda i: 0.0::DOUBLE) AS scores, 0.0::DOUBLE AS highest
UNION ALL SELECT k + 1, node, CASE WHEN {now} >= highest THEN (node + 1) % {nodes} ELSE node END, list_transform(scores, lambda s, i: CASE WHEN i = node + 1 THEN {now} ELSE s END), greatest(highest, {now}) FROM f, l WHERE k < n)"""


def _dynamic(burst: int, order: str = "query_id", nodes: int = NODES) -> str:
    """k, node, began, clocks after each query."""
    return f"""{_inorder(order)}, f AS (SELECT 0::BIGINT AS k, 0 AS node, 0.0::DOUBLE AS began, list_transform(range({nodes}), lambda i: 0.0::DOUBLE) AS clocks
UNION ALL SELECT k + 1, who, clocks[who + 1], list_transform(clocks, lambda c, i: CASE WHEN i = who + 1 THEN c + ests[k + 1] ELSE c END)
  FROM (SELECT *, (CASE WHEN k < {burst * nodes} THEN k % {nodes} ELSE list_position(clocks, list_min(clocks)) - 1 END)::INTEGER AS who FROM f), l WHERE k < n)"""


_PLACED = "SELECT ids[k] AS query_id, given AS node FROM f, l WHERE k > 0"
_DYNAMIC = f'{_dynamic(2)} SELECT ids[k] AS query_id, node, round(began, 6) AS "start", round(clocks[node + 1], 6) AS "end" FROM f, l WHERE k > 0'


def _stealing(given: int, stride: int, high: str) -> str:
    """k, batch, node. A node's batches are a run (from low, below high) of those that one node began with (own): every stride-th query."""
    return f"""{_inorder('query_id')}, f AS (SELECT 0::BIGINT AS k, NULL::BIGINT AS batch, NULL::INTEGER AS node, list_transform(range({NODES}), lambda i: i * {int(stride > 1)}) AS own, list_transform(range({NODES}), lambda i: 0::BIGINT) AS low,
  list_transform(range({NODES}), lambda i: {high}) AS high, list_transform(range({NODES}), lambda i: 0.0::DOUBLE) AS clocks FROM l
UNION ALL SELECT k + 1, batch_, (who - 1)::INTEGER, list_transform(own, lambda x, i: CASE WHEN i = who THEN own[source] ELSE x END),
  list_transform(low, lambda x, i: CASE WHEN i = who THEN first + 1 ELSE x END),
  list_transform(high, lambda x, i: CASE WHEN i = who THEN high[source] WHEN i = source THEN first ELSE x END),
  list_transform(clocks, lambda c, i: CASE WHEN i = who THEN c + ests[batch_ + 1] ELSE c END)
  FROM (SELECT *, own[source] + {stride} * first AS batch_ FROM (SELECT *, CASE WHEN source = who THEN low[who] ELSE greatest(low[source], high[source] - {given}) END AS first FROM (
    SELECT *, CASE WHEN high[who] > low[who] THEN who ELSE list_position(left_, list_max(left_)) END AS source FROM (
    SELECT *, list_position(clocks, list_min(clocks)) AS who, list_transform(high, lambda x, i: x - low[i]) AS left_ FROM f)))), l WHERE k < n)"""


_STEALING = _stealing(4, NODES, f"(n + {NODES - 1} - i) // {NODES}") + " SELECT batch::INTEGER AS batch, node FROM f WHERE k > 0"


@query("q1_sequential_merge", _nearest(1, columns="query_id, series_id, round(d2, 6) AS d2"))
def q1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node scans its slice for every query; the best answers are merged."""
    series, asked = both(spark, sf_dir)
    placed = partition.equal_slices(series, NODES).join(series, "series_id")
    answers = None
    for node in range(NODES):
        part = search.serial(asked, placed.filter(F.col("part") == node).select("series_id", "values"), CONFIG).select("query_id", "series_id", "d2")
        answers = part if answers is None else answers.unionByName(part)
    return rounded(schedule.merged(answers))


@query("q2_static", f"{_EST} SELECT query_id, least((row_number() OVER (ORDER BY query_id) - 1) // greatest(1, count(*) OVER () // {NODES}), {NODES - 1})::INTEGER AS node FROM e")
def q2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schedule.static(costs(spark, sf_dir), NODES)


@query("q3_dynamic", _DYNAMIC)
def q3(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = schedule.dynamic_schedule(costs(spark, sf_dir), NODES, burst=2)
    return found.withColumns({"start": F.round("start", 6), "end": F.round("end", 6)})


@query("q5_greedy_sorted", _greedy("est DESC, query_id") + _PLACED)
def q5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schedule.greedy_schedule(costs(spark, sf_dir), NODES)


@query("q5_greedy", _greedy("query_id") + _PLACED)
def q5u(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schedule.greedy_schedule(costs(spark, sf_dir), NODES, sort=False)


@query("q6_sorted_by_estimate", f"{_EST} SELECT query_id, row_number() OVER (ORDER BY est DESC, query_id)::INTEGER AS place FROM e")
def q6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schedule.ordered(costs(spark, sf_dir), "est")


@query("q7_sorted_by_first_distance", f"{_PAIRS} SELECT query_id, row_number() OVER (ORDER BY round(bsf, 9) DESC, query_id)::INTEGER AS place FROM bsf WHERE bsf IS NOT NULL")
def q7(spark: SparkSession, sf_dir: str) -> DataFrame:
    one, _, asked = built(spark, sf_dir, False)
    seeds = search.approximate(search.prepared(asked, one), one)
    return schedule.ordered(seeds.select("query_id", F.round("d2", 9).alias("bsf")), "bsf")


@query("w1_root_batches", f"{_SOME} SELECT r AS root, place, batch_id::INTEGER AS batch_id FROM batches JOIN places USING (r)")
def w1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partition.root_batches(_entries(spark, sf_dir), NODES).select("root", F.col("place").cast("long").alias("place"), "batch_id")


def _queues(spark: SparkSession, sf_dir: str) -> DataFrame:
    one, _, asked = built(spark, sf_dir, False)
    prepared = written(search.prepared(asked, one), "asked")
    bounds = search.leaf_bounds(prepared, one).withColumn("lb", F.round("lb", 9)).withColumn("root", F.col("leaf").cast("long"))
    batched = bounds.join(_batched(one.entries).select("root", "batch_id"), "root")
    return schedule.bounded_queues(batched.select("query_id", "batch_id", F.col("root").alias("leaf"), "lb"), 16)


_QUEUED = f"{_SOME}, lb AS MATERIALIZED (SELECT q.id AS query_id, roots.r, round({_LB_ROOT}, 9) AS lb FROM qs AS q, roots, bp), queued AS (SELECT query_id, batch_id::INTEGER AS batch_id, r AS leaf, lb, ((row_number() OVER (PARTITION BY query_id, batch_id ORDER BY lb, r) - 1) // 16)::INTEGER AS queue FROM lb JOIN batches USING (r)), heads AS (SELECT query_id, batch_id, queue, min(lb) AS head, count(*)::BIGINT AS size FROM queued GROUP BY ALL), placed AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY head, batch_id, queue) - 1)::INTEGER AS place FROM heads)"


@query("w2_bounded_queues", f"{_QUEUED} SELECT query_id, batch_id, leaf, queue FROM queued")
def w2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _queues(spark, sf_dir).select("query_id", "batch_id", "leaf", "queue")


@query("w3_queue_order", f"{_QUEUED} SELECT query_id, batch_id, queue, size, place FROM placed")
def w3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schedule.queue_order(_queues(spark, sf_dir)).drop("head")


@query("w3_batch_ranges", f'{_QUEUED} SELECT query_id, batch_id, min(place) AS "first", max(place) AS "last" FROM placed GROUP BY ALL')
def w3r(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schedule.batch_ranges(schedule.queue_order(_queues(spark, sf_dir)))


@query("w4_stealing", _STEALING)
def w4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schedule.stealing_schedule(costs(spark, sf_dir), NODES)


@query("q2_15_scheduled_search", _nearest(1))
def scheduled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries placed greedily by their estimates, each node's answered by a search that is given to the scheduler."""
    tree, _, asked = built(spark, sf_dir, None)
    estimates = asked.select("query_id").join(costs(spark, sf_dir), "query_id", "left").na.fill(1.0, ["est"])
    placed = written(schedule.greedy_schedule(estimates, NODES), "placed")
    return rounded(schedule.answered(asked, placed, NODES, lambda mine: search.exact(mine, tree, 1)).drop("node"))


# -- prediction --------------------------------------------------------------------------------------------------

_POINTS = "SELECT l_orderkey AS query_id, l_quantity + l_discount AS x, l_extendedprice / 1000 AS y FROM lineitem"


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return lines.select(F.col("l_orderkey").alias("query_id"), (F.col("l_quantity") + F.col("l_discount")).alias("x"), (F.col("l_extendedprice") / 1000).alias("y"))


@query("a14_fit_linear", f"SELECT round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 6) AS intercept, regr_count(y, x)::BIGINT AS n FROM ({_POINTS})")
def a14(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predict.fit_linear(points(spark, sf_dir)).select(F.round("slope", 6).alias("slope"), F.round("intercept", 6).alias("intercept"), "n")


@query("a14_fit_logarithm", f"SELECT round(regr_intercept(y, ln(x)), 6) AS a, round(regr_slope(y, ln(x)), 6) AS b, regr_count(y, ln(x))::BIGINT AS n FROM ({_POINTS}) WHERE x > 0")
def a14l(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predict.fit_logarithm(points(spark, sf_dir)).select(F.round("a", 6).alias("a"), F.round("b", 6).alias("b"), "n")


@query("a14_fit_sigmoid")
def a14s(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([predict.fit_sigmoid(points(spark, sf_dir).select("x", "y"))], "low double, high double, b double, c double, d double")


_PARABOLA = f"""WITH m AS (SELECT covar_pop(x, x) AS a, covar_pop(x, x * x) AS b, covar_pop(x * x, x * x) AS c, covar_pop(x, y) AS p, covar_pop(x * x, y) AS q, avg(x) AS mx, avg(x * x) AS mxx, avg(y) AS my FROM ({_POINTS})),
k AS (SELECT *, (q * a - p * b) / (a * c - b * b) AS c2, (p * c - q * b) / (a * c - b * b) AS c1 FROM m)
SELECT unnest([0, 1, 2]) AS power, round(unnest([my - c1 * mx - c2 * mxx, c1, c2]), 4) AS coefficient FROM k"""


@query("a14_fit_polynomial", _PARABOLA)
def a14p(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(k, round(c, 4)) for k, c in enumerate(reversed(predict.fit_polynomial(points(spark, sf_dir), 2)))], "power int, coefficient double")


_PREDICTED = f"SELECT query_id, y AS real, CASE WHEN x * 0.85::DOUBLE - 4.0::DOUBLE < 0 THEN 1e-5::DOUBLE ELSE x * 0.85::DOUBLE - 4.0::DOUBLE END AS predicted FROM ({_POINTS})"


@query("a13_error_histogram", f"SELECT least(floor(abs(real - predicted) * 100 / predicted / 10), 20)::BIGINT AS bucket, count(*)::BIGINT AS n FROM ({_PREDICTED}) GROUP BY 1")
def a13(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = predict.predictions(points(spark, sf_dir), *LINE).withColumnRenamed("y", "real")
    return predict.error_histogram(predict.errors(told))


# -- reports -----------------------------------------------------------------------------------------------------

_TIME = "SELECT user_id AS query_id, (event_id % 4)::INTEGER AS node, (date_part('day', ts) % 5)::INTEGER AS run, value AS sec FROM events"


def times(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.select(F.col("user_id").alias("query_id"), (F.col("event_id") % 4).cast("int").alias("node"), (F.dayofmonth("ts") % 5).alias("run"), F.col("value").alias("sec"))


@query("a2_query_time_range", f"SELECT query_id, min(sec) AS min_sec, max(sec) AS max_sec FROM ({_TIME}) GROUP BY 1")
def a2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.query_time_range(times(spark, sf_dir))


@query("a3_a4_counter_sums", f"SELECT run, sum(real_distances) AS real_distances, round(sum(total_time), 4) AS total_time FROM ({_METRICS}) GROUP BY 1")
def a3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.counter_sums(run_metrics(spark, sf_dir), ["real_distances", "total_time"]).withColumn("total_time", F.round("total_time", 4))


@query("a6_slowest_node_mean", f"SELECT round(avg(m), 6) AS slowest FROM (SELECT run, max(slowest) AS m FROM ({_METRICS}) GROUP BY 1)")
def a6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.slowest_node_mean(run_metrics(spark, sf_dir), "slowest").select(F.round("slowest", 6).alias("slowest"))


@query("a7_node_means", f"SELECT node, round(avg(slowest), 6) AS slowest FROM ({_METRICS}) GROUP BY 1")
def a7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.node_means(run_metrics(spark, sf_dir), "slowest").withColumn("slowest", F.round("slowest", 6))


@query("a8_mean_query_times", f"SELECT query_id, round(avg(round(sec, 6)), 6) AS sec FROM ({_TIME}) GROUP BY 1")
def a8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.mean_query_times(times(spark, sf_dir)).withColumn("sec", F.round("sec", 6))


@query("a9_queue_sizes", f"WITH s AS ({_QUEUES}), one AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY bsf ORDER BY query_id DESC) = 1), x AS (SELECT bsf, unnest(sizes) AS size FROM one) SELECT bsf, round(avg(size), 6) AS mean_size, median(size)::DOUBLE AS median_size, count(*)::BIGINT AS queues FROM x GROUP BY bsf ORDER BY bsf LIMIT 90")
def a9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report's own limit: the 90 smallest first distances."""
    return report.queue_sizes(queue_stats(spark, sf_dir)).withColumn("mean_size", F.round("mean_size", 6))


@query("a10_symbol_spread", f"{_S}, u AS (SELECT unnest(range({W}))::INTEGER AS segment, unnest(x) AS symbol FROM ss) SELECT segment, round(avg(symbol), 6) AS mean, round(stddev_pop(symbol), 6) AS deviation FROM u GROUP BY 1")
def a10(spark: SparkSession, sf_dir: str) -> DataFrame:
    spread = report.symbol_spread(index.summarise(series_of(spark, sf_dir), CONFIG), W)
    return spread.select("segment", F.round("mean", 6).alias("mean"), F.round("deviation", 6).alias("deviation"))


@query("a11_size_histogram", f"{_S}, h AS (SELECT r, count(*) AS n FROM ss GROUP BY 1) SELECT floor(log10(n))::INTEGER AS power, count(*)::BIGINT AS n_buckets, sum(n)::BIGINT AS n_series FROM h GROUP BY 1")
def a11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.size_histogram(partition.histogram(_entries(spark, sf_dir)))


@query("a12_empty_subtrees", f"{_S} SELECT round(100.0::DOUBLE * (256 - count(DISTINCT r)) / 256, 6) AS empty_pct FROM ss")
def a12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.empty_share(subtree_rows(spark, sf_dir)).select(F.round("empty_pct", 6).alias("empty_pct"))


@query("a15_subtree_stats", f"{_BOUNDS}, k AS (SELECT lb.query_id, r, (lb <= coalesce(bsf, 'inf'::DOUBLE))::BIGINT AS keep FROM lb JOIN bsf ON bsf.query_id = lb.query_id) SELECT query_id, count(*)::BIGINT AS subtrees, 256::BIGINT AS roots, sum(keep)::BIGINT AS unpruned FROM k GROUP BY 1")
def a15(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = subtree_rows(spark, sf_dir)
    return rows.groupBy("query_id").agg(F.count_if(F.col("height") > 0).alias("subtrees"), F.count("*").alias("roots"), F.sum("leaves").alias("unpruned"))


@query("o6_benchmark_selection", f"{_EST}, ranked AS (SELECT *, row_number() OVER (ORDER BY est, query_id)::INTEGER AS place, row_number() OVER (ORDER BY est DESC, query_id DESC) AS down FROM e) SELECT query_id, est, place FROM ranked WHERE place <= 250 OR down <= 51")
def o6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The selection's own limits: the 250 easiest and the 51 hardest queries."""
    return report.hardest(costs(spark, sf_dir), 250, 51)


@query("o7_union_of_query_sets", "SELECT vec_id AS query_id, 'given' AS kind FROM embeddings UNION ALL SELECT o_orderkey, 'made' FROM orders")
def o7(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = embeddings(spark, sf_dir).select(F.col("vec_id").alias("query_id"), F.lit("given").alias("kind"))
    made = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("query_id"), F.lit("made").alias("kind"))
    return given.unionByName(made)


# -- generators --------------------------------------------------------------------------------------------------


def _summary(rows: DataFrame) -> DataFrame:
    v = F.col("values")
    return rows.select("series_id", F.size(v).alias("length"), F.round(F.abs(C.total(v)), 6).alias("mean"), F.round(C.total(F.transform(v, lambda x: x * x)) / F.size(v), 6).alias("variance"))


@query("g1_random_walks", "SELECT vec_id AS series_id, 128 AS length, 0.0::DOUBLE AS mean, 1.0::DOUBLE AS variance FROM embeddings")
def g1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many walks as there are embeddings; z-normalised, so their moments are known."""
    return _summary(generate.random_walks(spark, embeddings(spark, sf_dir).count(), 128, seed=3))


@query("g2_skewed_walks", "SELECT vec_id // 4 AS walk, count(*)::BIGINT AS copies FROM embeddings GROUP BY 1")
def g2(spark: SparkSession, sf_dir: str) -> DataFrame:
    walks = generate.random_walks(spark, embeddings(spark, sf_dir).count(), 32, seed=5, skew=0.75)
    return walks.groupBy("values").agg(F.min(F.floor(F.col("series_id") / 4)).alias("walk"), F.count("*").alias("copies")).select("walk", "copies")


@query("g3_labels", f"SELECT vec_id AS series_id, {_drawn(1, 'vec_id')} % 9 AS label FROM embeddings")
def g3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generate.labels(series_of(spark, sf_dir), 10)


@query("g4_noisy_queries")
def g4(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = series_of(spark, sf_dir)
    return generate.noisy_queries(series, series.count(), 0.1, seed=9)


@query("g5_size_sweep", "SELECT * FROM (VALUES (5.0::DOUBLE, 5242880::BIGINT, 524::BIGINT, 256, 1.0::DOUBLE), (10.0::DOUBLE, 10485760::BIGINT, 1048::BIGINT, 256, 1.0::DOUBLE), (20.0::DOUBLE, 20971520::BIGINT, 2097::BIGINT, 256, 1.0::DOUBLE)) AS t(gigabytes, n, made, length, variance)")
def g5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sets of each size, generated at a ten-thousandth of it; their walks have the variance 1."""
    out = None
    for g, rows in generate.sweep(spark, (5.0, 10.0, 20.0), 256, 1e-4).items():
        each = _summary(rows).agg(F.count("*").alias("made"), F.max("length").alias("length"), F.round(F.avg("variance"), 6).alias("variance"))
        each = each.select(F.lit(g).alias("gigabytes"), F.lit(generate.size_for(g, 256)).cast("long").alias("n"), "made", "length", "variance")
        out = each if out is None else out.unionByName(each)
    return out


# -- experiments -------------------------------------------------------------------------------------------------


@query("e6_mode_comparison", f"{_EST}, p AS (SELECT est, row_number() OVER (ORDER BY query_id) - 1 AS k, count(*) OVER () AS m FROM e), n AS (SELECT unnest([2, 4, 8]) AS nodes), l AS (SELECT nodes, least(k // greatest(1, m // nodes), nodes - 1) AS node, sum(est) AS load FROM p, n GROUP BY ALL) SELECT nodes, round(max(load), 4) AS makespan, round(sum(load), 4) AS total FROM l GROUP BY 1")
def e6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The static mode of the comparison; e6_all_modes has the others."""
    rows = experiments.modes(costs(spark, sf_dir), (2, 4, 8), ("static",))
    return rows.select("nodes", F.round("makespan", 4).alias("makespan"), F.round("total", 4).alias("total"))


def _modes(nodes: int) -> list[str]:
    """mode, nodes, makespan, total, a query for each mode."""
    static = f"{_EST}, p AS (SELECT est, row_number() OVER (ORDER BY query_id) - 1 AS k, count(*) OVER () AS m FROM e) SELECT 'static' AS mode, {nodes} AS nodes, round(max(load), 4) AS makespan, round(sum(load), 4) AS total FROM (SELECT sum(est) AS load FROM p GROUP BY least(k // greatest(1, m // {nodes}), {nodes - 1}))"
    told = lambda mode, sums: f" SELECT '{mode}' AS mode, {nodes} AS nodes, round(list_max({sums}), 4) AS makespan, round(list_sum({sums}), 4) AS total FROM f, l WHERE k = n"
    return [static] + [sql + told(mode, sums) for by, tail in (("query_id", ""), ("est DESC, query_id", "_sorted")) for sql, mode, sums in ((_greedy(by, nodes), f"greedy{tail}", "scores"), (_dynamic(1, by, nodes), f"dynamic{tail}", "clocks"))]


@query("e6_all_modes", " UNION ALL ".join(f"SELECT * FROM ({sql})" for nodes in (1, 2, 4, 8, 16) for sql in _modes(nodes)))
def e6a(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = experiments.modes(costs(spark, sf_dir), (1, 2, 4, 8, 16))
    return rows.withColumns({c: F.round(c, 4) for c in ("makespan", "total")})


@query("e7_burst_sweep", " UNION ALL ".join(f"SELECT * FROM ({_dynamic(b)} SELECT {b} AS burst, round(max(list_max(clocks)), 6) AS makespan FROM f)" for b in (1, 2, 4, 8)))
def e7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return experiments.bursts(costs(spark, sf_dir), NODES, (1, 2, 4, 8)).withColumn("makespan", F.round("makespan", 6))


@query("e8_threshold_divisors", f"SELECT divisor, round(avg(th), 6) AS mean_th, max(th)::INTEGER AS max_th FROM (SELECT divisor, greatest(1, trunc({_SIG})::INTEGER // divisor) AS th FROM events, (SELECT unnest([1, 4, 16, 64]) AS divisor)) GROUP BY 1")
def e8(spark: SparkSession, sf_dir: str) -> DataFrame:
    distances = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("value").alias("x"))
    return experiments.thresholds(distances, SIGMOID, (1, 4, 16, 64)).withColumn("mean_th", F.round("mean_th", 6))


@query("e9_steal_sweep", " UNION ALL ".join(f"SELECT * FROM ({_stealing(g, 1, 'CASE WHEN i = 0 THEN n ELSE 0 END')} SELECT {g} AS given, count_if(node <> 0)::INTEGER AS moved FROM f WHERE k > 0)" for g in (1, 2, 4, 8)))
def e9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return experiments.steals(costs(spark, sf_dir), NODES, (1, 2, 4, 8))


def _deal(groups: int) -> str:
    return f"SELECT {groups} AS groups, max(n)::BIGINT AS fullest, sum(n) / {groups} AS mean FROM (SELECT sum(n) AS n FROM (SELECT n, (row_number() OVER (ORDER BY xor(r, r >> 1)) - 1) % {groups} AS g FROM h) GROUP BY g)"


@query("e10_group_sweep", f"{_S}, h AS (SELECT r, count(*)::BIGINT AS n FROM ss GROUP BY 1) {_deal(1)} UNION ALL {_deal(2)} UNION ALL {_deal(4)} UNION ALL {_deal(8)}")
def e10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return experiments.group_sweep(_entries(spark, sf_dir), (1, 2, 4, 8))


@query("e11_index_scaling", "SELECT q::INTEGER AS quarters, count(*)::BIGINT AS n_series, count(*)::BIGINT AS n_in_leaves FROM embeddings, range(1, 5) AS t(q) WHERE vec_id < (SELECT max(vec_id) + 1 FROM embeddings) * q / 4 GROUP BY 1")
def e11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return experiments.index_scaling(series_of(spark, sf_dir), CONFIG).select("quarters", "n_series", "n_in_leaves")


@query("e1_node_policy_sweep", f"""{_RECORDS}, n AS (SELECT unnest([1, 2, 4]) AS nodes), p AS (SELECT unnest(['own', 'shared']) AS policy),
k AS (SELECT q.id AS query_id, q.r AS qr, coalesce(bsf, 'inf'::DOUBLE) AS bsf FROM qs AS q JOIN bsf ON bsf.query_id = q.id),
t AS (SELECT nodes, policy, sum(CASE WHEN policy = 'shared' OR qr % nodes = rec.r % nodes THEN (lb.lb <= bsf AND rec.lb <= bsf)::BIGINT ELSE 1 END)::BIGINT AS real
  FROM rec JOIN lb ON lb.query_id = rec.query_id AND lb.r = rec.r JOIN k ON k.query_id = rec.query_id, n, p GROUP BY 1, 2)
SELECT nodes, policy, run, real FROM t, (SELECT unnest([1, 2]) AS run)""")
def e1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances computed by so many nodes, by whether they share the seed, for each run."""
    one, _, asked = built(spark, sf_dir, False)
    return experiments.bsf_policies(one, asked, (1, 2, 4), runs=2)


@query("e3_result_layout", f"SELECT 'events' AS dataset, node, run, count(*)::BIGINT AS n, round(sum(sec), 4) AS sec FROM ({_TIME}) GROUP BY ALL")
def e3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results in folders dataset=/node=/run=, read back by their folders."""
    path = new_path(spark, "results")
    times(spark, sf_dir).withColumn("dataset", F.lit("events")).write.partitionBy("dataset", "node", "run").csv(path)
    back = spark.read.schema("query_id long, sec double, dataset string, node int, run int").csv(path)
    return back.groupBy("dataset", "node", "run").agg(F.count("*").alias("n"), F.round(F.sum("sec"), 4).alias("sec"))


#: Settings made of events: the type is the mode, the day's part of the month the threshold.
_SETTINGS = "SELECT event_type AS mode, (event_id % 3)::INTEGER AS threshold, (event_id % 4)::INTEGER AS node, (date_part('day', ts) % 5)::INTEGER AS run, value AS sec FROM events"


def _by_setting(keys: str) -> str:
    return f"SELECT {keys}, round(avg(m), 6) AS sec, count(*)::BIGINT AS runs FROM (SELECT {keys}, run, max(sec) AS m FROM ({_SETTINGS}) GROUP BY ALL) GROUP BY ALL"


def settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.select(F.col("event_type").alias("mode"), (F.col("event_id") % 3).cast("int").alias("threshold"), (F.dayofmonth("ts") % 5).alias("run"), F.col("value").alias("sec"))


@query("e13_mode_report", _by_setting("mode"))
def e13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.by_setting(settings(spark, sf_dir), ["mode"], "sec").withColumn("sec", F.round("sec", 6))


@query("e14_parameter_report", _by_setting("mode, threshold"))
def e14(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.by_setting(settings(spark, sf_dir), ["mode", "threshold"], "sec").withColumn("sec", F.round("sec", 6))


# -- sinks -------------------------------------------------------------------------------------------------------


@query("k1_answers", _nearest(1, columns="query_id, round(d2, 6) AS d2"))
def k1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each query's smallest distance, written and read."""
    series, asked = both(spark, sf_dir)
    return rounded(written(search.serial(asked, series, CONFIG).select("query_id", "d2"), "answers"))


#: 17 times, 2 counters of distances and 4 of best-so-far changes, made of events.
RUN_COLUMNS = [*(f"{c}_time" for c in ("input", "output", "read", "summary", "tree", "index", "query", "seed", "queue", "refine", "merge", "share", "steal", "wait", "schedule", "preprocess", "total")), "bound_distances", "real_distances", "bsf_changes", "bsf_shares", "bsf_receives", "bsf_wrong"]
_RUN = "SELECT (date_part('day', ts) % 5)::INTEGER AS run, (user_id % 4)::INTEGER AS node, " + ", ".join(f"round(sum(value) * {k + 1} / 17, 4) AS {c}" if k < 17 else f"count(*) FILTER (WHERE event_id % {k - 15} = 0)::DOUBLE AS {c}" for k, c in enumerate(RUN_COLUMNS)) + " FROM events GROUP BY 1, 2"


def run_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metrics of all runs, written as files and read back."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select((F.dayofmonth("ts") % 5).alias("run"), (F.col("user_id") % 4).cast("int").alias("node"), "event_id", "value")
    each = (F.round(F.sum("value") * (k + 1) / 17, 4) if k < 17 else F.count_if(F.col("event_id") % (k - 15) == 0).cast("double") for k in range(len(RUN_COLUMNS)))
    metrics = events.groupBy("run", "node").agg(*(e.alias(c) for e, c in zip(each, RUN_COLUMNS, strict=True)))
    path = new_path(spark, "runs")
    text.write_run_results(metrics.select("run", "node", *RUN_COLUMNS), path)
    return text.read_run_results(spark, path, RUN_COLUMNS).select("run", "node", *(F.round(c, 2).alias(c) for c in RUN_COLUMNS))


@query("k2_run_metrics_file", f"SELECT run, node, {', '.join(f'round({c}, 2) AS {c}' for c in RUN_COLUMNS)} FROM ({_RUN})")
def k2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_files(spark, sf_dir)


@query("a4_bsf_counter_sums", f"SELECT run, {', '.join(f'sum({c}) AS {c}' for c in RUN_COLUMNS[17:])} FROM ({_RUN}) GROUP BY 1")
def a4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.counter_sums(run_files(spark, sf_dir), RUN_COLUMNS[17:])


@query("k4_query_times_file", "SELECT event_id AS query_id, value AS sec FROM events")
def k4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One time a line; events stand for queries, their ids for the order."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("query_id"), F.col("value").alias("sec"))
    path = new_path(spark, "times")
    text.write_doubles(events, "query_id", "sec", path)
    return text.read_doubles(spark, path, "query_id", "sec")


@query("k7_first_answers", _nearest(1, "WHERE r = qr", "query_id, round(d2, 6) AS bsf"))
def k7(spark: SparkSession, sf_dir: str) -> DataFrame:
    one, _, asked = built(spark, sf_dir, False)
    return search.approximate(search.prepared(asked, one), one).select("query_id", F.round("d2", 6).alias("bsf"))


@query("k9_benchmark_files", f"{_EST}, v AS (SELECT query_id, est FROM e JOIN embeddings ON vec_id = query_id), ranked AS (SELECT *, row_number() OVER (ORDER BY est, query_id) AS up, row_number() OVER (ORDER BY est DESC, query_id DESC) AS down FROM v), chosen AS (SELECT query_id, est, row_number() OVER (ORDER BY up) - 1 AS n FROM ranked WHERE up <= 800 OR down <= 1) SELECT n AS query_id, est, round(list_sum(embedding::DOUBLE[]), 6) AS total FROM chosen JOIN embeddings ON vec_id = chosen.query_id")
def k9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Binary queries and their estimates, the selection's own 800 easiest and the hardest, read back side by side."""
    vectors = embeddings(spark, sf_dir).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("values"))
    estimated = costs(spark, sf_dir).join(vectors.select("query_id"), "query_id")
    chosen = written(report.hardest(estimated, 800, 1).join(vectors, "query_id"), "benchmark")
    chosen = numbered(chosen, "place", name="series_id")
    queries, estimates = new_path(spark, "queries-bin"), new_path(spark, "estimates")
    binary.write_series(chosen.select("series_id", "values"), queries, N)
    text.write_doubles(chosen, "series_id", "est", estimates)
    back = binary.read_series(spark, queries, N).select(F.col("series_id").alias("query_id"), F.round(C.total(C.doubles(F.col("values"))), 6).alias("total"))
    return back.join(text.read_doubles(spark, estimates), "query_id").select("query_id", "est", "total")


@query("k11_report_table", f"SELECT node, round(avg(total_time), 4) AS total_time, round(avg(real_distances), 6) AS real_distances, round(avg(slowest), 6) AS slowest FROM ({_METRICS}) GROUP BY 1")
def k11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means over runs of each node, as a CSV table that is read back."""
    path = new_path(spark, "report")
    metrics = run_metrics(spark, sf_dir)
    means = metrics.groupBy("node").agg(F.round(F.avg("total_time"), 4).alias("total_time"), F.round(F.avg("real_distances"), 6).alias("real_distances"), F.round(F.avg("slowest"), 6).alias("slowest"))
    means.write.option("header", True).csv(path)
    return spark.read.schema("node int, total_time double, real_distances double, slowest double").option("header", True).option("enforceSchema", False).csv(path)


# -- the same operation under its other ids ----------------------------------------------------------------------

#: Variants that differ by thread model, vector instructions or message passing, and not in what they compute.
SAME = {
    "s6_query_load": "s5_query_scan", "f4_sax_vectorised": "f3_sax_from_series", "f5_breakpoint_search": "f2_sax_from_paa", "f10_mindist_record_vectorised": "f8_mindist_record", "f13_euclid2_vectorised": "f12_euclid2",
    "f19_gray_decode": "f18_gray_code", "f25_two_decimals": "f24_pct_error", "p2_queue_stop": "p1_leaves_not_pruned", "j3_query_leaf_bounds": "f6_mindist_node", "j6_queries_join_estimates": "s7_queries_with_estimates",
    "r14_exact_coordinated": "j1_exact_nn", "r16_top_k_buffer": "r17_top_k_exact", "q8_result_merge": "q1_sequential_merge", "a1_minimum_distance": "r6_leaf_scan", "o2_sorted_queues": "w3_queue_order",
}
for _name, _of in SAME.items():
    QUERIES[_name] = QUERIES[_of]
    if _of in SQL:
        SQL[_name] = SQL[_of]
