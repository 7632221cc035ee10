"""Seeded generators. A row depends on the seed and its id only, so any partition of the work gives the same rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import kernels, z_normalize
from ..plans.storage import numbered

GIB = 1 << 30


def random_walks(spark: SparkSession, n: int, length: int, seed: int = 1, skew: float = 0.0, normalise: bool = True) -> DataFrame:
    """Cumulative normal steps: series_id, values. skew repeats each walk so that n (1 - skew) are different."""
    repeat = max(1, round(n / max(1.0, n * (1 - skew))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                ids = batch.column(0).slice(at, 1024).to_numpy()
                steps = np.stack([np.random.Generator(np.random.Philox(key=[seed, int(k) // repeat])).standard_normal(length) for k in ids])
                walks = np.cumsum(steps, axis=1)
                if normalise:
                    walks -= walks.mean(axis=1, keepdims=True)
                    walks /= walks.std(axis=1, keepdims=True)
                yield pa.RecordBatch.from_arrays([pa.array(ids), kernels.lists(walks)], ["series_id", "values"])

    return spark.range(n).withColumnRenamed("id", "series_id").mapInArrow(run, "series_id long, values array<double>")


def size_for(gigabytes: float, length: int) -> int:
    """Series of 32-bit floats in so many GiB."""
    return int(gigabytes * GIB // (4 * length))


def drawn(seed: int, key: Column) -> Column:
    """A whole number from 0 to 2^32 - 1 of a seed and a key, by a digest that other engines have too."""
    return F.conv(F.substring(_digest(seed, key), 1, 8), 16, 10).cast("long")


def _digest(seed: int, key: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def random_int(seed: int, below: int, key: Column) -> Column:
    return F.pmod(drawn(seed, key), F.lit(below))


def labels(series: DataFrame, classes: int, seed: int = 1) -> DataFrame:
    """series_id, label: uniform over 0 .. classes - 2."""
    return series.select("series_id", random_int(seed, max(1, classes - 1), F.col("series_id")).alias("label"))


def shuffled(rows: DataFrame, seed: int, key: str = "series_id") -> DataFrame:
    """Rows in a seeded order: adds place, from 0, each once."""
    return numbered(rows, _digest(seed, F.col(key)), key)


def noisy_queries(series: DataFrame, n: int, noise: float, seed: int = 1) -> DataFrame:
    """n series in a seeded order, each value with normal noise of a variance, z-normalised: query_id, series_id, values."""
    picked = numbered(series.select("series_id", "values"), F.xxhash64(F.lit(seed), "series_id"), "series_id").filter(F.col("place") < n)
    noisy = F.transform("values", lambda x, i: x + gaussian_noise_of(noise, seed, F.col("series_id"), i))
    return picked.select(F.col("place").alias("query_id"), "series_id", z_normalize(noisy).alias("values"))


def gaussian_noise_of(variance: float, seed: int, *keys: Column) -> Column:
    """Box-Muller from two hashes of the keys, so that a rerun on other partitions agrees."""
    uniform = lambda salt: (F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), *keys), F.lit(1 << 53)).cast("double") + 0.5) / float(1 << 53)
    return F.sqrt(-2 * F.log(uniform(1))) * F.cos(2 * np.pi * uniform(2)) * float(variance) ** 0.5


def sweep(spark: SparkSession, sizes: tuple[float, ...], length: int, scale: float = 1.0) -> dict[float, DataFrame]:
    """A data set per size in GiB, seeded by its size; scale shrinks all of them."""
    return {g: random_walks(spark, max(1, int(size_for(g, length) * scale)), length, seed=int(g)) for g in sizes}
