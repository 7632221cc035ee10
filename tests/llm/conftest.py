from __future__ import annotations

import pytest
from pyspark.sql import types as T


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in any column, empty, wordless and long texts, repeated rows and ids, columns that operators use inside."""
    long = "lorem ipsum dolor sit amet consectetur " * 3000
    rows = [
        (0, "a b c d e f g", "en", "s1", 13),
        (0, "a b c d e f g", "en", "s1", 13),
        (1, None, None, None, None),
        (2, "", "en", "s1", 0),
        (3, " \t\n ", "en", None, 4),
        (4, "A B c d e f g", "en", "s2", 13),
        (5, long, "en", "s2", len(long)),
        (6, long, None, "s1", len(long)),
        (7, "x" * 20000, "en", "s3", 20000),
        (8, "two words", "en", "é", 9),
        (9, "Two WORDS", "en", "é", 9),
        (None, "a b c d e f g", "en", "s1", 13),
        (None, None, None, None, None),
        (10, "日本語 テスト 🙂 ▁ <|endoftext|> don't", "ja", "s3", 30),
    ]
    return spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, __id int, size int, `a.b` int, label int")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], T.StructType.fromDDL("doc_id long, text string, lang string, source string, n_chars long"))
