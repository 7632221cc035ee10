"""Column functions. A series is array<double>; distances and bounds are squared, without a root."""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = [
    "breakpoints", "doubles", "total", "z_normalize", "paa", "sax_from_paa", "sax_from_series", "root_mask", "isax_word", "mindist", "mindist_record", "euclid2", "euclid2_bounded",
    "decimal_to_gray", "gray_to_decimal", "sigmoid", "estimate_threshold", "linear_predict", "polynomial", "logarithm", "pct_error", "two_decimals", "bit_string", "pair_rank", "mindist_record_bounded", "gaussian_noise", "parse_series", "perturbed",
]


@lru_cache
def breakpoints(cardinality: int) -> tuple[float, ...]:
    """The cardinality - 1 values that cut the standard normal distribution into equally likely parts."""
    normal = NormalDist()
    return tuple(normal.inv_cdf(i / cardinality) for i in range(1, cardinality))


def _literal(values: Sequence[float]) -> Column:
    return F.array(*(F.lit(float(v)) for v in values))


def doubles(values: Column) -> Column:
    return values.cast("array<double>")


def total(values: Column) -> Column:
    """Sum of an array of doubles, from the first to the last."""
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def let(value: Column, body) -> Column:
    """body of a value that is computed once; lambdas would compute an expression again for every element."""
    return F.transform(F.array(value), body)[0]


def z_normalize(values: Column) -> Column:
    """(x - mean) / population standard deviation; null for a constant or an empty series, never NaN."""
    scaled = lambda c: let(F.sqrt(total(F.transform(c, lambda x: x * x)) / F.size(c)), lambda d: F.when(d > 0, F.transform(c, lambda x: x / d)))
    centred = lambda v: let(total(v) / F.size(v), lambda m: let(F.transform(v, lambda x: x - m), scaled))
    return F.when(F.size(values) > 0, let(values, centred))


def paa(values: Column, length: int, segments: int) -> Column:
    """Means of equal blocks."""
    width = length // segments
    if width * segments != length:
        raise ValueError("the length must be a multiple of the segments")
    return let(values, lambda v: F.transform(F.sequence(F.lit(0), F.lit(segments - 1)), lambda i: total(F.slice(v, i * width + 1, width)) / width))


def sax_from_paa(means: Column, bits: int = 8) -> Column:
    """For each mean the number of breakpoints below it; NaN counts as 0."""
    table = _literal(breakpoints(1 << bits))
    return F.transform(means, lambda m: F.when(F.isnan(m), 0).otherwise(F.size(F.filter(table, lambda b: b < m))))


def sax_from_series(values: Column, length: int, segments: int, bits: int = 8) -> Column:
    return sax_from_paa(paa(values, length, segments), bits)


def root_mask(sax: Column, bits: int = 8) -> Column:
    """The symbols' top bits, the first segment's on top."""
    half = 1 << (bits - 1)
    return F.aggregate(sax, F.lit(0).cast("long"), lambda a, s: a * 2 + (s >= half).cast("long"))


def isax_word(sax: Column, kept: Column, bits: int = 8) -> Column:
    """Each symbol's top bits; kept: how many of each."""
    return F.zip_with(sax, kept, lambda s, k: F.floor(s / F.pow(F.lit(2.0), bits - k)).cast("int"))


def _edges(bits: int) -> tuple[Column, Column]:
    """Lower and upper edge of each symbol's range; without end outside."""
    cuts = breakpoints(1 << bits)
    return _literal([float("-inf"), *cuts]), _literal([*cuts, float("inf")])


def _gaps(means: Column, low: Column, high: Column, scale: float) -> Column:
    """low, high: the ranges' edges, in step with the means."""
    both = F.zip_with(means, F.arrays_zip(low.alias("l"), high.alias("h")), lambda m, e: F.when(m < e["l"], (e["l"] - m) * (e["l"] - m)).when(m > e["h"], (m - e["h"]) * (m - e["h"])).otherwise(0.0))
    return total(both) * scale


def mindist(means: Column, word: Column, kept: Column, scale: float, bits: int = 8) -> Column:
    """A lower bound of the distance from a series with these means to any under the node (word, kept bits)."""
    lows, highs = _edges(bits)
    first = F.zip_with(word, kept, lambda v, k: (v * F.pow(F.lit(2.0), bits - k)).cast("int"))
    last = F.zip_with(word, kept, lambda v, k: ((v + 1) * F.pow(F.lit(2.0), bits - k)).cast("int") - 1)
    return _gaps(means, F.transform(first, lambda s: F.element_at(lows, s + 1)), F.transform(last, lambda s: F.element_at(highs, s + 1)), scale)


def mindist_record(means: Column, sax: Column, scale: float, bits: int = 8) -> Column:
    """The same for one record, whose symbols are known to all bits."""
    lows, highs = _edges(bits)
    return _gaps(means, F.transform(sax, lambda s: F.element_at(lows, s + 1)), F.transform(sax, lambda s: F.element_at(highs, s + 1)), scale)


def mindist_record_bounded(means: Column, sax: Column, scale: float, bsf: Column, bits: int = 8) -> Column:
    """The record's bound where it is within the best distance so far, else null."""
    lb = mindist_record(means, sax, scale, bits)
    return F.when(lb <= bsf, lb)


def euclid2(a: Column, b: Column) -> Column:
    """Squared Euclidean distance."""
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def euclid2_bounded(a: Column, b: Column, bound: Column) -> Column:
    """The distance where it is under the bound, else null: what early abandoning decides."""
    d = euclid2(a, b)
    return F.when(d < bound, d)


def decimal_to_gray(x: Column) -> Column:
    return x.bitwiseXOR(F.shiftright(x, 1))


def gray_to_decimal(x: Column, bits: int = 62) -> Column:
    step = 1
    while step < bits:
        x = x.bitwiseXOR(F.shiftright(x, step))
        step *= 2
    return x


def sigmoid(x: Column, low: float, high: float, b: float, c: float, d: float) -> Column:
    return F.lit(low) + (high - low) / (1 + b * F.exp(-c * (x - d)))


def estimate_threshold(x: Column, model: tuple[float, float, float, float, float] | None, divisor: int = 1) -> Column:
    """Queue size from a sigmoid, truncated, divided, at least 1; without a model -1."""
    if model is None:
        return F.lit(-1)
    return F.greatest(F.lit(1), F.floor(sigmoid(x, *model).cast("int") / divisor).cast("int"))


def linear_predict(x: Column, slope: float, intercept: float) -> Column:
    y = x * slope + intercept
    return F.when(y < 0, 1e-5).otherwise(y)


def polynomial(x: Column, coefficients: Sequence[float]) -> Column:
    """Highest power first."""
    y = F.lit(0.0)
    for c in coefficients:
        y = y * x + c
    return y


def logarithm(x: Column, a: float, b: float) -> Column:
    return F.lit(a) + b * F.log(x)


def pct_error(real: Column, predicted: Column) -> Column:
    """In percent of the prediction; null where that is 0."""
    return F.when(predicted != 0, F.abs(real - predicted) * 100 / predicted)


def two_decimals(x: Column) -> Column:
    return F.round(x, 2)


def bit_string(x: Column, bits: int = 8) -> Column:
    return F.lpad(F.bin(x), bits, "0")


def pair_rank(rank: Column) -> Column:
    return rank + F.when(rank % 2 == 0, 1).otherwise(-1)


def gaussian_noise(variance: float, seed: int) -> Column:
    return F.randn(seed) * float(variance) ** 0.5


def parse_series(text: Column, delimiter: str = ",") -> Column:
    """A line of delimited numbers."""
    return F.transform(F.split(F.trim(text), delimiter), lambda x: F.trim(x).cast("double"))


def perturbed(values: Column, key: Column, step: float = 0.05) -> Column:
    """A query near a series: a fixed whole-number pattern of key and place, times step."""
    return F.transform(values, lambda x, i: x + ((key * 31 + i.cast("long") * 17) % 13 - 6) * F.lit(step))
