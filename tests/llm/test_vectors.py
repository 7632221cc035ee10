from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import topk, vectordup

ODD = [
    (1000, None, 1), (1001, [1.0, None], 1), (1002, [float("nan"), 1.0], 1), (1003, [float("inf"), 1.0], 1), (1004, [0.0, 0.0], 1), (1005, [1.0, 2.0], None),
    (None, [1.0, 2.0], 1), (1006, [1.0, 2.0, 3.0], 1), (1007, [], 1), (1008, [1e30, 1e30], 1), (1009, [2e30, 2e30], 1),
]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 9, 9) for r in rows], "vec_id long, embedding array<float>, label int, rank int, block int")


def ok(v):
    return v is not None and all(x is not None and np.isfinite(x) for x in v)


def brute_top(rows, queries, k):
    out = []
    for q, v, _ in queries:
        if q is None or not ok(v):
            continue
        a = [int(np.floor(256 * float(x))) for x in v]
        found = [(-sum(p * int(np.floor(256 * float(y))) for p, y in zip(a, w, strict=True)), i) for i, w, _ in rows if i is not None and i != q and ok(w) and len(w) == len(v)]
        out += [(q, rank + 1, i, -s) for rank, (s, i) in enumerate(sorted(found)[:k])]
    return sorted(out)


@pytest.mark.parametrize(("n", "blocks", "lists"), [(200, (16, 7), 2), (90, (1000, 1000), 4), (3, (2, 2), 1)])
def test_top_k(spark, n, blocks, lists):
    rng = np.random.default_rng(n)
    x = np.round(rng.standard_normal((n, 6)), 1)  # many ties
    rows = [(i, [float(v) for v in np.float32(r)], 0) for i, r in enumerate(x)] + [r for r in ODD if r[0] not in (1008, 1009)]
    queries = [r for r in rows if r[0] is not None and r[0] % 9 == 0]
    found = topk.top_k(frame(spark, rows), frame(spark, queries), 5, lists, 256, *blocks).collect()
    assert sorted(map(tuple, found)) == brute_top(rows, queries, 5)


def test_top_k_of_nothing(spark):
    assert topk.top_k(frame(spark, ODD).limit(0), frame(spark, ODD).limit(0)).isEmpty()
    assert topk.top_k(frame(spark, ODD[:5]), frame(spark, ODD[:4])).isEmpty()


def brute_links(rows, threshold):
    usable = lambda r: r[0] is not None and r[2] is not None and ok(r[1]) and any(r[1])
    n = len(rows)
    links, root = [0] * n, list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            a, b = rows[i], rows[j]
            if usable(a) and usable(b) and a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = (np.array(v[1], np.float64) / max(map(abs, v[1])) for v in (a, b))
                if x @ y / (np.sqrt(x @ x) * np.sqrt(y @ y)) >= threshold:
                    links[i] += 1
                    links[j] += 1
                    root[find(i)] = find(j)
    least = {}
    for i in range(n):
        if rows[i][0] is not None:
            least[find(i)] = min(least.get(find(i), rows[i][0]), rows[i][0])
    return sorted(((r[0] is None, r[0] or 0), links[i], least.get(find(i))) for i, r in enumerate(rows))


@pytest.mark.parametrize(("dim", "block"), [(3, 16), (40, 10), (40, 1000)])
def test_near_duplicates(spark, dim, block):
    rng = np.random.default_rng(dim)
    centres = rng.standard_normal((12, dim))
    x = centres[rng.integers(0, 12, 150)] + rng.standard_normal((150, dim)) * 0.09
    x[100:120] = x[80]  # copies
    rows = [(i, [float(v) for v in np.float32(r)], int(i % 2)) for i, r in enumerate(x)] + ODD
    found = vectordup.near_duplicates(frame(spark, rows), 0.98, block).collect()
    assert sorted(((r.vec_id is None, r.vec_id or 0), r.n_links, r.component_id) for r in found) == brute_links(rows, 0.98)
    assert all(r.kept == (r.vec_id is None or r.vec_id == r.component_id) for r in found)


def test_near_duplicates_of_nothing(spark):
    assert vectordup.near_duplicates(frame(spark, ODD).limit(0)).isEmpty()


def test_repeated_ids(spark):
    """Rows of one id: in near_duplicates each has its own links; in top_k the id's queries share one list."""
    rows = [(1, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (2, [1.0, 0.01], 0), (3, [1.0, 0.02], 0), (0, [0.01, 1.0], 0), (1, [1.0, 0.0], 0), (2, [0.5, -1.0], 0)]
    found = vectordup.near_duplicates(frame(spark, rows), 0.98).collect()
    assert sorted(((False, r.vec_id), r.n_links, r.component_id) for r in found) == brute_links(rows, 0.98)
    assert sorted((r.vec_id, r.n_links) for r in found) == [(0, 1), (1, 1), (1, 3), (1, 3), (2, 0), (2, 3), (3, 3)]
    found = topk.top_k(frame(spark, rows), frame(spark, rows), 4).collect()
    by_id = {}
    for q, _, i, s in brute_top(rows, rows, 100):
        by_id.setdefault(q, []).append((-s, i))
    assert sorted(map(tuple, found)) == sorted((q, k + 1, i, -s) for q, all_ in by_id.items() for k, (s, i) in enumerate(sorted(all_)[:4]))


def test_bound_never_loses_a_pair():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((300, 24))
    x[150:] = x[:150] + rng.standard_normal((150, 24)) * 0.2
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    axes = np.linalg.eigh(unit.T @ unit)[1][:, ::-1]
    i, j = vectordup._pairs(x, x, unit @ axes, unit @ axes, 0.98, True)
    expected = np.argwhere(np.triu(unit @ unit.T >= 0.98, 1))
    assert sorted(zip(i.tolist(), j.tolist(), strict=True)) == sorted(map(tuple, expected.tolist()))


def test_whole_table(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    found = vectordup.near_duplicates(vectors)
    assert found.count() == vectors.count() and found.filter(F.col("kept") != (F.col("vec_id") == F.col("component_id"))).isEmpty()
