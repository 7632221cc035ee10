"""Queries that arrive as a stream, answered against an index that stays."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.index import Index
from ..operators.search import SearchStrategy, exact


def answer(queries: DataFrame, index: Index, to: str, checkpoint: str, strategy: SearchStrategy | None = None, k: int = 1) -> StreamingQuery:
    """queries: a streaming DataFrame (query_id, values). Each micro-batch is one bulk search; a batch that is run again
    replaces its own folder, so answers are written once."""

    def run(batch: DataFrame, number: int) -> None:
        found = strategy(batch, index) if strategy else exact(batch, index, k)
        found.write.mode("overwrite").parquet(f"{to}/batch={number}")

    return queries.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
