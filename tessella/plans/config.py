"""Settings of an index and of a session."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class IndexConfig:
    """length = segments * values per segment; symbols have bits bits; leaves hold leaf_size series at most, if they can be split."""

    length: int = 64
    segments: int = 8
    bits: int = 8
    leaf_size: int = 2000

    def __post_init__(self) -> None:
        if self.length % self.segments:
            raise ValueError(f"a length of {self.length} can't be cut into {self.segments} equal segments")
        if not 1 <= self.segments <= 62 or not 1 <= self.bits <= 16 or self.leaf_size < 1:
            raise ValueError("segments must be 1..62, bits 1..16 and leaves hold a series at least")

    @property
    def scale(self) -> float:
        """A lower bound over segments counts this often."""
        return self.length / self.segments

    @property
    def cardinality(self) -> int:
        return 1 << self.bits


def local_session(cpus: int | str = "*", memory: str = "8g", partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    settings = {
        "spark.sql.shuffle.partitions": partitions,
        "spark.driver.memory": memory,
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("tessella")
    for key, value in settings.items():
        builder = builder.config(key, str(value))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
