from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import generate, index, search
from tessella.plans.config import IndexConfig
from tessella.sources import binary, text
from tessella.streaming.answers import answer


def test_binary_round_trip_and_chunks(spark, tmp_path):
    x = np.arange(200, dtype="<f4").reshape(50, 4)
    (tmp_path / "one.bin").write_bytes(x.tobytes())
    back = binary.read_series(spark, str(tmp_path / "one.bin"), 4, rows_per_partition=7).orderBy("series_id").collect()
    assert [r.series_id for r in back] == list(range(50)) and [list(r["values"]) for r in back] == x.tolist()
    part = binary.read_series(spark, str(tmp_path / "one.bin"), 4, first=20, rows=10).agg(F.min("series_id"), F.max("series_id"), F.count("*")).first()
    assert tuple(part) == (20, 29, 10)
    with pytest.raises(Exception, match="fewer than"):
        binary.read_series(spark, str(tmp_path / "one.bin"), 4, rows=60, strict="true").count()
    with pytest.raises(Exception, match="whole records"):
        binary.read_series(spark, str(tmp_path / "one.bin"), 7).count()
    binary.write_series(spark.createDataFrame(back), str(tmp_path / "many"), 4, 3)
    again = binary.read_series(spark, str(tmp_path / "many"), 4).orderBy("series_id").collect()
    assert [list(r["values"]) for r in again] == x.tolist()


def test_text_files(spark, tmp_path):
    est = spark.createDataFrame([(k, k * 1.5) for k in range(30)], "query_id long, est double")
    text.write_doubles(est, "query_id", "est", str(tmp_path / "est"))
    assert sorted(map(tuple, text.read_doubles(spark, str(tmp_path / "est")).collect())) == [(k, k * 1.5) for k in range(30)]
    (tmp_path / "basis").write_text("sigmoid -283.53 2996.23 3.529 0.1264 10.398\n")
    assert text.read_basis_function(spark, str(tmp_path / "basis"))[1] == 2996.23
    (tmp_path / "queues").write_text("#query #bsf #th #total_pqs #per_pq_size\n4 1.191736 2147483647 6 11 15 63 21 74 29\n5 2.5 1 0\n")
    a, b = text.read_queue_stats(spark, str(tmp_path / "queues")).orderBy("query_id").collect()
    assert (a.bsf, a.th, a.sizes) == (1.191736, 2147483647, [11, 15, 63, 21, 74, 29]) and b.sizes == []
    (tmp_path / "pred").write_text("Query# BSF# BSFresult Leafs# TimeMS\n1 0 0.5 0 7.552\n1 1 0.4 3 9\n")
    assert [tuple(r) for r in text.read_prediction_stats(spark, str(tmp_path / "pred")).collect()] == [(1, 0.5, 0, 0.007552)]


def test_generators_repeat(spark):
    a = generate.random_walks(spark, 20, 16, seed=1).repartition(3).orderBy("series_id").collect()
    assert a == generate.random_walks(spark, 20, 16, seed=1).coalesce(1).orderBy("series_id").collect()
    noisy = generate.noisy_queries(spark.createDataFrame(a), 5, 0.1).orderBy("query_id").collect()
    assert [r.query_id for r in noisy] == list(range(5)) and all(abs(sum(r["values"])) < 1e-9 for r in noisy)
    assert generate.random_walks(spark, 20, 16, seed=1, skew=0.75).select("values").distinct().count() == 5


def test_stream_of_queries(spark, tmp_path):
    walks = generate.random_walks(spark, 50, 16, seed=6)
    tree = index.build(walks, IndexConfig(16, 4, 8, 10))
    walks.withColumnRenamed("series_id", "query_id").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("query_id long, values array<double>").parquet(str(tmp_path / "in"))
    answer(stream, tree, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    found = spark.read.parquet(str(tmp_path / "out")).collect()
    assert len(found) == 50 and all(r.query_id == r.series_id and r.d2 == 0 for r in found)
    assert search.exact(walks.withColumnRenamed("series_id", "query_id"), tree).count() == 50
