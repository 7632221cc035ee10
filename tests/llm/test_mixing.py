from __future__ import annotations

import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tessella.llm import mixing


def water_filling(sizes, share, most):
    """By rounds: give by weight, clamp what is over, share the excess again."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    left, target, open_ = share * sum(sizes.values()), {}, set(order)
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if level * weight[s] > most * sizes[s]]
        if not over:
            return target | {s: level * weight[s] for s in open_}
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
            open_.discard(s)
    return target


@pytest.mark.parametrize("share", [0.4, 1.0, 1.5, 1.99])
def test_targets(spark, share):
    sizes = {"a": 100, "b": 3, "Z": 40, "é": 7, None: 9, "c": 0, "日": 55}
    rows = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    found = {r.source: r.target for r in mixing.targets(rows, share).collect()}
    expected = water_filling(sizes, share, 2.0)
    assert all(abs(found[s] - expected[s]) < 1e-6 for s in sizes)


def check(docs, found, ranges=None):
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r in docs.collect():
        sizes[r.source] += words(r.text)
    rows = found.collect()
    assert len(rows) == docs.count()
    for r in rows:
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert r.source_size == sizes[r.source] and 0 <= r.taken <= 2 * r.size and r.taken == r.repeats * r.size + r.part
    assert all(abs(taken[s] - target[s]) <= 0.5 + 1e-9 for s in sizes)


@pytest.mark.parametrize("ranges", [1, 3, 4096])
def test_mix(spark, documents, odd, ranges):
    check(documents, mixing.mix(documents, ranges=ranges))
    check(odd, mixing.mix(odd, ranges=ranges))
    key = ["doc_id", "taken", "part"]
    assert sorted(mixing.mix(documents, ranges=ranges).select(*key).collect()) == sorted(mixing.mix(documents.repartition(5)).select(*key).collect())


def test_mixed_rows(spark, documents, odd, empty):
    rows = mixing.mixed_rows(documents)
    assert rows.columns == documents.columns
    times = {r.doc_id: r["count"] for r in rows.groupBy("doc_id").count().collect()}
    plan = mixing.mix(documents).collect()
    assert all(times.get(r.doc_id, 0) == r.repeats + (r.size > 0 and 2 * r.part >= r.size) for r in plan)
    assert mixing.mixed_rows(odd).columns == odd.columns
    assert mixing.mix(empty).isEmpty() and mixing.mixed_rows(empty).isEmpty()


def test_rows_without_an_id_of_their_own(spark):
    """Null ids, repeated ids and equal rows: each source's rows come near its target, and reruns agree."""
    rows = [(None if k % 3 else 7, f"{'w ' * (k % 5 + 1)}{k}", "ab"[k % 2]) for k in range(300)] + [(None, "same words", "a")] * 50
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, source string, __row int, __key int")
    target = {r.source: r.target for r in mixing.mix(docs).collect()}
    runs = []
    for some in (docs, docs.repartition(7)):
        out = mixing.mixed_rows(some)
        assert out.columns == docs.columns
        runs.append(sorted(map(tuple, out.collect()), key=repr))
        for source, words in target.items():
            assert abs(sum(len(t.split()) for _, t, s, *_ in runs[-1] if s == source) - words) <= 6  # the border's document counts as a whole or not
    assert runs[0] == runs[1]
    assert max(Counter(runs[0])[r] for r in runs[0] if r[1] != "same words") <= 2


def test_no_python_in_the_plan(spark, documents):
    plan = mixing.mix(documents)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    assert mixing.mix(documents).agg(F.sum("taken")).first()[0] > 0
