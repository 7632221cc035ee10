from __future__ import annotations

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import experiments, generate, index, partition, search
from tessella.plans.config import IndexConfig
from tessella.plans.storage import written


@pytest.fixture(scope="module")
def walks(spark):
    return written(generate.random_walks(spark, 600, 32, seed=4), "walks")


@pytest.fixture(scope="module")
def asked(walks):
    return written(generate.noisy_queries(walks, 40, 0.05, seed=2).select("query_id", "values"), "noisy")


def rows(df):
    return sorted((r.query_id, r["rank"], r.series_id, round(r.d2, 9)) for r in df.collect())


@pytest.mark.parametrize(("segments", "leaf", "k"), [(8, 20, 1), (4, 7, 3), (8, 10_000, 5)])
def test_index_is_exact(spark, walks, asked, segments, leaf, k):
    config = IndexConfig(32, segments, 8, leaf)
    tree = index.build(walks, config)
    expected = rows(search.serial(asked, walks, config, k))
    assert len(expected) == 40 * k
    assert rows(search.exact(asked, tree, k)) == expected
    counts = search.counts(asked, tree).agg(F.sum("real"), F.sum("bounds")).first()
    assert counts[0] < counts[1] <= 600 * 40


@pytest.mark.parametrize(("pack_bytes", "split"), [(1 << 26, True), (32 * 48 * 8, True), (32 * 48 * 8, False)])
def test_visits_of_many_blocks(spark, walks, asked, tmp_path, pack_bytes, split):
    """Small blocks and packs: roots that a task can't hold, folders, seeds and visited blocks."""
    config = IndexConfig(32, 4, 8, 9)
    index.build(walks, config, split, to=f"{tmp_path}/index", pack_bytes=pack_bytes, block=32)
    tree = index.load(spark, f"{tmp_path}/index")
    assert tree.config == config and tree.n_series == 600 and not tree.few
    sizes = tree.entries.groupBy("block").count()
    assert sizes.agg(F.max("count")).first()[0] <= (32 if split else 64) and tree.entries.select("series_id").distinct().count() == 600
    assert tree.spans.agg(F.sum("n")).first()[0] == tree.leaves.agg(F.sum("n")).first()[0] == 600
    for k in (1, 4):
        assert rows(search.exact(asked, tree, k)) == rows(search.serial(asked, walks, config, k))
    one = index.build(walks, config, split)
    for f in (search.approximate, lambda q, t: search.exact(q.select("query_id", "values"), t, 1, radius=0.5), lambda q, t: search.limited(q.select("query_id", "values"), t, 2)):
        assert rows(f(search.prepared(asked, tree), tree)) == rows(f(search.prepared(asked, one), one))
    a, b = (sorted(map(tuple, search.counts(asked, t).collect())) for t in (tree, one))
    assert a == b
    assert sorted(map(tuple, tree.splits.collect())) == sorted(map(tuple, one.splits.collect())) or not split


def test_only_visited_folders_are_read(spark):
    """Two far groups of series; queries near one of them."""
    rng = np.random.default_rng(0)
    x = np.repeat([[1.0] * 8 + [-1.0] * 8, [-1.0] * 8 + [1.0] * 8], 400, axis=0) + rng.normal(0, 0.01, (800, 16))
    series = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "series_id long, values array<double>")
    tree = index.build(series, IndexConfig(16, 4, 8, 20), pack_bytes=1 << 14, block=50)
    same = series.filter("series_id < 10").withColumnRenamed("series_id", "query_id")
    assert rows(search.exact(same, tree)) == [(i, 1, i, 0.0) for i in range(10)]  # found at the seed; nothing more is visited
    found = search.exact(same.withColumn("values", F.transform("values", lambda v: v * 1.0001)), tree)
    assert {(r.query_id, r.series_id) for r in found.collect()} == {(i, i) for i in range(10)}
    folders = {f.split("part=")[1].split("/")[0] for f in tree.entries.inputFiles()}
    plan = found._jdf.queryExecution().toString()
    read = re.findall(r"PartitionFilters: \[([^\]]*part#\d+[^\]]*)\]", plan)
    some_folders = {n for r in read for n in re.findall(r"(?<![#\w])\d+(?![\w#])", re.sub(r"part#\d+", "", r))}
    assert some_folders and some_folders < folders


def test_series_that_are_left_out(spark):
    """Null, constant (undefined once normalised), infinite and partly null series: neither indexed nor answered, nor does the job fail."""
    nan, good = float("nan"), [1.0, -1.0, 2.0, -2.0]
    rows_ = [(0, good), (1, None), (2, [nan] * 4), (3, [1.0, None, 2.0, 0.0]), (4, [float("inf"), 0.0, 0.0, 0.0]), (5, [2.0, -2.0, 1.0, -1.0])]
    series = spark.createDataFrame(rows_, "series_id long, values array<double>")
    config = IndexConfig(4, 2, 8, 5)
    tree = index.build(series, config)
    assert {r.series_id for r in tree.entries.collect()} == {0, 5} and tree.n_series == 2
    assert {r.series_id for r in index.rejected(series).collect()} == {1, 2, 3, 4}
    asked = series.withColumnRenamed("series_id", "query_id")
    assert rows(search.exact(asked, tree)) == [(0, 1, 0, 0.0), (5, 1, 5, 0.0)]
    assert rows(search.serial(asked, series, config)) == [(0, 1, 0, 0.0), (5, 1, 5, 0.0)]
    assert index.build(series.limit(0), config).leaves.isEmpty()
    assert search.exact(asked, index.build(series.limit(0), config)).isEmpty()


def test_tree_invariants(spark, walks):
    config = IndexConfig(32, 4, 8, 9)
    tree = index.build(walks, config)
    v = index.validity(tree, walks).first()
    assert v.n_series == v.n_in_leaves == 600 and v.fullest <= 9
    assert tree.entries.groupBy("series_id").count().filter("count <> 1").isEmpty()
    words = tree.entries.join(tree.leaves.select("leaf", "word"), "leaf").collect()
    assert all([s >> (8 - k) for s, k in zip(r.sax, r.kept, strict=True)] == r.word for r in words)
    assert index.statistics(tree).agg(F.sum("n_series")).first()[0] == 600
    assert index.dot_edges(tree).count() > tree.leaves.count() / 2


def test_unsplittable_series_stay_together(spark):
    same = spark.createDataFrame([(i, [1.0, -1.0] * 4) for i in range(30)], "series_id long, values array<double>")
    tree = index.build(same, IndexConfig(8, 4, 8, 5))
    assert tree.leaves.count() == 1
    found = search.exact(same.withColumnRenamed("series_id", "query_id"), tree).collect()
    assert {(r.series_id, r.d2) for r in found} == {(0, 0.0)}  # ties go to the smallest id


def test_approximate_and_radius(spark, walks, asked):
    config = IndexConfig(32, 8, 8, 25)
    tree = index.build(walks, config)
    near = {r.query_id: r.d2 for r in search.approximate(search.prepared(asked, tree), tree).collect()}
    true = {r.query_id: r.d2 for r in search.exact(asked, tree).collect()}
    assert all(near[q] >= true[q] for q in near)
    none = search.exact(asked, tree, radius=-1.0).collect()
    assert {r.query_id: r.d2 for r in none} == near  # the seed leaf's answer stays
    few = {r.query_id: r.d2 for r in search.limited(asked, tree, 3).collect()}
    assert all(true[q] <= few[q] + 1e-12 for q in few) and all(few[q] <= near[q] for q in near)


def test_empty_root_still_gets_an_answer(spark):
    series = spark.createDataFrame([(0, [1.0] * 4 + [-1.0] * 4)], "series_id long, values array<double>")
    q = spark.createDataFrame([(5, [-1.0] * 4 + [1.0] * 4)], "query_id long, values array<double>")
    tree = index.build(series, IndexConfig(8, 2, 8, 5))
    assert search.approximate(search.prepared(q, tree), tree).isEmpty()
    assert [(r.series_id, r.d2) for r in search.exact(q, tree).collect()] == [(0, 32.0)]


def test_wrong_lengths_are_rejected(spark):
    with pytest.raises(ValueError):
        IndexConfig(100, 16)
    bad = spark.createDataFrame([(0, [1.0, 2.0])], "series_id long, values array<double>")
    with pytest.raises(Exception, match="must have"):
        index.summarise(bad, IndexConfig(8, 2)).collect()


def test_classification(spark):
    near = spark.createDataFrame([(0, 1), (0, 2), (0, 3), (1, 1), (1, 2)], "query_id long, series_id long")
    labels = spark.createDataFrame([(1, 7), (2, 5), (3, 5)], "series_id long, label long")
    found = {r.query_id: (r.label, r.votes) for r in search.classify(near, labels).collect()}
    assert found == {0: (5, 2), 1: (5, 1)}


def test_density_aware_places_each_series_once(spark, walks):
    entries = index.summarise(walks, IndexConfig(32, 4)).select("series_id", "root")
    placed = partition.density_aware(entries, 4).toPandas()
    assert sorted(placed.series_id) == list(range(600))
    sizes = np.bincount(placed.group_id, minlength=4)
    assert sizes.max() / sizes.mean() < 1.06


def test_groups_of_any_size(spark, walks, asked, monkeypatch):
    """Groups of a few rows on both sides, with blocks visited by some: the same answers and counts as in one group."""
    config = IndexConfig(32, 4, 8, 9)
    tree = index.build(walks, config, True, pack_bytes=32 * 48 * 8, block=32)
    one = index.build(walks, config, False)
    bsf = asked.select("query_id", F.lit(None).cast("double").alias("bsf"))

    def all_of():
        found = rows(search.exact(asked, tree, 2)), rows(search.exact(asked, tree, 1, bsf=bsf, only=F.col("root") < 8)), rows(search.serial(asked, walks, config, 2))
        each = (search.counts(asked, tree), search.per_root(asked, one), search.candidates(asked, tree), search.self_distances(asked, 32))
        return *found, *(sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect()) for df in each)

    whole = all_of()
    assert whole[0] == whole[2]
    monkeypatch.setattr(search, "GROUP_BYTES", 32 * 8 * 15)
    assert search._n_groups(600, 32) == 40 and search._n_groups(40, 32) == 3
    assert all_of() == whole


def test_a_row_is_shuffled_for_a_few_groups(spark, walks, asked):
    """The blocks of 4096 and 2048 before sent each of 600,000 rows to 150 and 300 groups; and plans don't grow with nodes and policies."""
    assert search._n_groups(10_000, 64) == search._n_groups(500_000, 64) == 8 and search._n_groups(600_000, 64) == 10
    one = index.build(walks, IndexConfig(32, 4, 8, 9), False)
    plan = experiments.bsf_policies(one, asked, (1, 2, 4), runs=2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("CoGroupsInArrow") == 1


def test_products_at_any_scale():
    """Many copies, and series whose squares a single-precision product can't hold: distances, ties and ids as by differences."""
    rng = np.random.default_rng(1)
    for scale in (1.0, 1e-14, 1e18):
        x = np.repeat(rng.normal(size=(60, 16)), 5, axis=0) * scale
        q, ids = x[::7] + rng.normal(size=(43, 16)) * scale * 0.1, rng.permutation(300)
        best = search._Nearest(q, 7)
        for at in range(0, 300, 41):
            best.take(x[at : at + 41], ids[at : at + 41])
        d = ((q[:, None] - x[None]) ** 2).sum(axis=2)
        order = np.lexsort((np.broadcast_to(ids, d.shape), np.round(d / scale**2, 9)), axis=1)[:, :7]
        assert (best.ids == ids[order]).all() and np.allclose(best.d, np.take_along_axis(d, order, axis=1))
        assert sorted(ids[search._of_each(x, ids, 2)]) == sorted(i for k in range(60) for i in sorted(ids[5 * k : 5 * k + 5])[:2])
