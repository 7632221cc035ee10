from __future__ import annotations

import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessella.operators import experiments, generate, partition, predict, report, schedule
from tessella.plans.storage import numbered


def test_static_7_on_3(spark):
    found = schedule.static(spark.range(7).withColumnRenamed("id", "query_id"), 3).collect()
    assert [n for _, n in sorted(Counter(r.node for r in found).items())] == [2, 2, 3]


def test_batches_10_on_4(spark):
    found = partition.root_batches(spark.range(10).withColumnRenamed("id", "root"), 4).collect()
    assert [n for _, n in sorted(Counter(r.batch_id for r in found).items())] == [2, 2, 2, 4]


def test_greedy():
    assert schedule.greedy([5, 4, 3, 2], 2) == [0, 1, 1, 0]


def test_dynamic_runs_each_query_once():
    runs = schedule.dynamic([4.0, 1.0, 1.0, 1.0, 2.0], 2)
    assert [r[0] for r in runs] == [0, 1, 1, 1, 1]
    assert schedule.dynamic([], 3) == []
    by_node = {}
    for node, start, end in schedule.dynamic([1.0] * 20, 3, burst=2):
        by_node.setdefault(node, []).append((start, end))
    assert all(a[1] <= b[0] for runs in by_node.values() for a, b in zip(sorted(runs), sorted(runs)[1:], strict=False))


def test_stealing_runs_each_batch_once():
    found = schedule.stealing([(0, k, 1.0) for k in range(10)], 3)
    assert [b for b, _ in found] == list(range(10)) and len({n for _, n in found}) == 3


def test_merge_ignores_missing_answers(spark):
    rows = [(1, 4, 2.0), (1, 3, 2.0), (1, None, None), (2, None, None)]
    found = {r.query_id: (r.series_id, r.d2) for r in schedule.merged(spark.createDataFrame(rows, "query_id long, series_id long, d2 double")).collect()}
    assert found == {1: (3, 2.0), 2: (None, None)}


def test_split_bucket_is_even(spark):
    rows = spark.range(1000).select((F.col("id") * 7).alias("series_id"), F.lit(3).cast("long").alias("root"))
    found = partition.split_bucket(rows, 4).orderBy("series_id").collect()
    assert [r.group_id for r in found] == [k % 4 for k in range(1000)]


def test_rebalance():
    split, loads = partition.rebalance([(0, 100, 0), (1, 10, 1), (2, 10, 0)], 2)
    assert split == [0] and sorted(loads) == [60.0, 60.0]
    assert partition.rebalance([], 3) == ([], [0.0, 0.0, 0.0])


def test_fits(spark):
    import math

    line = spark.createDataFrame([(float(x), 3.0 * x - 2) for x in range(30)], "x double, y double")
    row = predict.fit_linear(line).first()
    assert abs(row.slope - 3) < 1e-9 and abs(row.intercept + 2) < 1e-9
    c = predict.fit_polynomial(spark.createDataFrame([(float(x), 0.5 * x * x - x + 4) for x in range(-10, 20)], "x double, y double"), 2)
    assert all(abs(a - b) < 1e-6 for a, b in zip(c, (0.5, -1, 4), strict=True))
    curve = spark.createDataFrame([(x / 4, 2 + 8 / (1 + math.exp(-1.5 * (x / 4 - 5)))) for x in range(48)], "x double, y double")
    low, high, b, c, d = predict.fit_sigmoid(curve)
    assert max(abs(low - 2), abs(high - 10), abs(c - 1.5), abs(d - 5)) < 1e-3 and b == 1.0


def test_benchmark_selection_takes_each_once(spark):
    q = spark.createDataFrame([(k, float(k)) for k in range(6)], "query_id long, est double")
    assert [r.query_id for r in report.hardest(q, 4, 4).orderBy("place").collect()] == [0, 1, 2, 3, 4, 5]


def test_places_without_one_task(spark):
    """Ties, nulls, many ranges; the places are those of a sort."""
    rows = spark.range(0, 5000, 1, 13).select((F.col("id") * 7919 % 5000).alias("id"), F.when(F.col("id") % 5 > 0, F.col("id") % 50).alias("x"))
    found = numbered(rows, F.col("x").asc_nulls_last(), "id").collect()
    expected = sorted(((r.x is None, r.x, r.id) for r in found), key=lambda t: (t[0], t[1] or 0, t[2]))
    assert {r.id: r.place for r in found} == {i: k for k, (_, _, i) in enumerate(expected)}
    assert numbered(rows.limit(0), "id").isEmpty()
    assert sorted(r.place for r in generate.shuffled(spark.range(100).withColumnRenamed("id", "series_id"), 3).collect()) == list(range(100))


def test_folds_are_bounded(spark, monkeypatch):
    rows = spark.range(20).select(F.col("id").alias("query_id"), F.lit(1.0).alias("est"))
    assert schedule.folded(rows) == [(k, 1.0) for k in range(20)]
    monkeypatch.setattr(schedule, "FOLDED", 19)
    with pytest.raises(ValueError, match="19 queries at most"):
        schedule.folded(rows)


def test_searches_are_given_to_the_scheduler(spark):
    queries = spark.range(9).withColumnRenamed("id", "query_id")
    placed = schedule.static(queries, 2)
    found = schedule.answered(queries, placed, 2, lambda mine: mine.withColumn("d2", F.lit(1.0))).collect()
    assert {r.query_id: r.node for r in found} == {r.query_id: r.node for r in placed.collect()} and len(found) == 9


def test_settings_are_compared(spark):
    rows = [("a", 0, 1.0), ("a", 0, 3.0), ("a", 1, 5.0), ("b", 0, 2.0)]
    found = report.by_setting(spark.createDataFrame(rows, "mode string, run int, sec double"), ["mode"], "sec").collect()
    assert sorted(map(tuple, found)) == [("a", 4.0, 2), ("b", 2.0, 1)]


def test_schedules_take_any_number_of_queries(spark, monkeypatch):
    """No limit of queries, and batches smaller than the whole: the same as the plain folds over the whole."""
    monkeypatch.setattr(schedule, "FOLDED", 19)
    costs = [float(k * 37 % 23 + 1) / 8 for k in range(1000)]
    rows = spark.createDataFrame(list(enumerate(costs)), "query_id long, est double").repartition(7)
    dearest = sorted(range(1000), key=lambda k: (-costs[k], k))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        assert {tuple(r) for r in schedule.greedy_schedule(rows, 3, sort=False).collect()} == set(enumerate(schedule.greedy(costs, 3)))
        assert {tuple(r) for r in schedule.greedy_schedule(rows, 3).collect()} == set(zip(dearest, schedule.greedy([costs[k] for k in dearest], 3), strict=True))
        runs = schedule.dynamic(costs, 4, 5)
        assert {tuple(r) for r in schedule.dynamic_schedule(rows, 4, 5).collect()} == {(k, *run) for k, run in enumerate(runs)}
        assert {tuple(r) for r in experiments.bursts(rows, 4, (1, 5, 400)).filter("burst = 5").collect()} == {(5, max(end for _, _, end in runs))}
        assert {tuple(r) for r in schedule.stealing_schedule(rows, 4, 3).collect()} == set(schedule.stealing([(k % 4, k, e) for k, e in enumerate(costs)], 4, 3))
        moved = {g: sum(n > 0 for _, n in schedule.stealing([(0, k, e) for k, e in enumerate(costs)], 3, g)) for g in (1, 6)}
        assert dict(map(tuple, experiments.steals(rows, 3, (1, 6)).collect())) == moved
        found = {(r["mode"], r.nodes): (r.makespan, r.total) for r in experiments.modes(rows, (1, 3)).collect()}
        assert set(found) == {(m, n) for m in experiments.MODES for n in (1, 3)} and {t for _, t in found.values()} == {sum(costs)}
        assert found["static", 3][0] == max(sum(costs[:333]), sum(costs[333:666]), sum(costs[666:])) and found["dynamic", 3][0] == max(end for _, _, end in schedule.dynamic(costs, 3))
        empty = rows.limit(0)
        assert schedule.stealing_schedule(empty, 4).isEmpty() and schedule.greedy_schedule(empty, 4).isEmpty()
        assert {tuple(r) for r in experiments.bursts(empty, 4, (1,)).collect()} == {(1, 0.0)}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_stealing_from_the_fullest_is_linear():
    """Half a million batches on one node: what is given away is not cut out of a list."""
    began = time.perf_counter()
    found = schedule.stealing([(0, k, 1.0) for k in range(500_000)], 4, 1)
    assert len(found) == 500_000 and time.perf_counter() - began < 30
