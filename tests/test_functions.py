from __future__ import annotations

import math

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessella.functions import columns as C
from tessella.functions import kernels


def one(spark, rows, schema, *columns):
    return spark.createDataFrame(rows, schema).select(*columns).first()


def test_paa_small(spark):
    assert one(spark, [([1.0, 3.0, 2.0, 2.0, 0.0, 4.0, -1.0, 1.0],)], "v array<double>", C.paa(F.col("v"), 8, 4).alias("p")).p == [2, 2, 2, 0]


def test_sax_edges(spark):
    cuts = C.breakpoints(256)
    means = [cuts[9], -50.0, 50.0, math.nan, math.nextafter(cuts[9], 9)]
    assert one(spark, [(means,)], "v array<double>", C.sax_from_paa(F.col("v")).alias("x")).x == [9, 0, 255, 0, 10]
    assert kernels.sax(np.array([means]), 8).tolist() == [[9, 0, 255, 0, 10]]


def test_root_word_gray(spark):
    row = one(spark, [([0, 128, 127, 255],)], "x array<int>", C.root_mask(F.col("x")).alias("r"))
    assert row.r == 0b0101
    row = one(spark, [([179], [3])], "x array<int>, k array<int>", C.isax_word(F.col("x"), F.col("k")).alias("w"), C.bit_string(F.col("x")[0]).alias("b"))
    assert (row.w, row.b) == ([5], "10110011")
    rows = spark.range(8).select(C.decimal_to_gray(F.col("id")).alias("g"), C.gray_to_decimal(C.decimal_to_gray(F.col("id"))).alias("b")).collect()
    assert [r.g for r in rows] == [0, 1, 3, 2, 6, 7, 5, 4] and [r.b for r in rows] == list(range(8))


def test_constant_series_has_no_normal_form(spark):
    rows = [([2.0, 2.0],), ([],), (None,), ([1.0, 3.0],)]
    found = spark.createDataFrame(rows, "v array<double>").select(C.z_normalize(F.col("v")).alias("z")).collect()
    assert [r.z for r in found] == [None, None, None, [-1.0, 1.0]]


def test_model_functions(spark):
    x = F.col("x")
    row = one(spark, [(3.0,)], "x double", C.sigmoid(x, 1, 5, 1, 2, 3).alias("s"), C.estimate_threshold(x, (1, 5, 1, 2, 3), 2).alias("t"), C.linear_predict(x, -1, 1).alias("l"), C.polynomial(x, (1, 0, -2)).alias("p"), C.pct_error(x, F.lit(0.0)).alias("e"), C.pct_error(x, F.lit(4.0)).alias("f"))
    assert (row.s, row.t, row.l, row.p, row.e, row.f) == (3.0, 1, 1e-5, 7.0, None, 25.0)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.floats(-40, 40, width=32), min_size=16, max_size=16), min_size=2, max_size=6), st.integers(1, 8))
def test_bounds_hold(rows, kept):
    """node bound <= record bound <= distance."""
    x = np.array(rows)
    means, bits = kernels.paa(x, 4), 8
    sax = kernels.sax(means, bits)
    low, high = kernels.edges(bits)
    record = kernels.bounds(means, low[sax], high[sax], 4.0)
    k = np.full(sax.shape, kept)
    node = kernels.bounds(means, *kernels.node_ranges(sax >> (bits - kept), k, bits), 4.0)
    d = kernels.distances(x, x)
    assert (node <= record + 1e-9).all() and (record <= d * (1 + 1e-9) + 1e-9).all()
