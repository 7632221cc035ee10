"""Exact top-k by inner product with a three-phase uniform threshold.

A score is the sum of partial scores over lists: slices of the dimensions. Phase 1: in each block of rows every
list gives its own best k entries for each query; their totals are resolved, and the k-th best total over all
blocks is a safe cutoff: k rows reach it. Phase 2: the cutoff goes with the query to every block; a row whose
total reaches the cutoff has a partial score of at least cutoff / lists in some list, so each list collects just
those entries. Phase 3: their totals are resolved exactly, and the best k remain. Queries and rows meet in blocks
of bounded size, so a row is copied once for thousands of queries; blocks send at most k entries a query.

Components are floor(scale * x), x as double, so scores are whole numbers and exact. Rules: rows whose vector is
null or has null or non-finite components take no part, neither as query nor as candidate; vectors of another
length than the query's aren't candidates; an empty vector scores 0 with other empty vectors; a query is never
its own candidate (by id); repeated rows count as rows; ties go to the smaller id; an empty table gives an empty
result. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Components in a block of rows, and of queries; queries of a block that meet its rows at once.
ROWS, QUERIES, STRIP = 1 << 20, 1 << 19, 128


def finite(column: str):
    x = F.col(column)
    return x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & (F.abs(v.cast("double")) < float("inf")) & ~F.isnan(v))


def _matrix(table: pa.Table, column: str, scale: int) -> np.ndarray:
    lists = table.column(column).combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(flat * scale).reshape(table.num_rows, -1)


def _best(scores: np.ndarray, k: int) -> np.ndarray:
    """A bool matrix: in each row, entries that reach the row's k-th best."""
    if scores.shape[1] <= k:
        return np.ones(scores.shape, bool)
    return scores >= np.partition(scores, -k, axis=1)[:, [-k]]


def _totals(q: np.ndarray, x: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Exact totals of the marked entries, resolved in pieces."""
    i, j = np.nonzero(at)
    big = np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * max(1, q.shape[1]) >= 2.0**53
    a, b = (q.astype(np.int64), x.astype(np.int64)) if big else (q, x)
    out = np.empty(len(i), np.int64)
    for s in range(0, len(i), 1 << 16):
        e = slice(s, s + (1 << 16))
        out[e] = (a[i[e]] * b[j[e]]).sum(axis=1)
    return i, j, out


def _block(k: int, lists: int, scale: int, with_cutoff: bool):
    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        none = {"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())}
        if not rows.num_rows or not queries.num_rows:
            return pa.table(none)
        q, x = _matrix(queries, "query", scale), _matrix(rows, "embedding", scale)
        q_id, x_id = queries.column("query_id").to_numpy(), rows.column("vec_id").to_numpy()
        cut = queries.column("cutoff").to_numpy(zero_copy_only=False).astype(np.float64)[:, None] if with_cutoff else None
        found = [strip(q[s], x, q_id[s], x_id, cut[s] if with_cutoff else None) for s in (slice(at, at + STRIP) for at in range(0, len(q), STRIP))]
        return pa.table(dict(zip(none, map(np.concatenate, zip(*found, strict=True)), strict=True)))

    def strip(q: np.ndarray, x: np.ndarray, q_id: np.ndarray, x_id: np.ndarray, cut: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        own = q_id[:, None] == x_id[None, :]
        keep = np.zeros(own.shape, bool)
        for part in np.array_split(np.arange(q.shape[1]), lists):
            partial = q[:, part] @ x[:, part].T
            partial[own] = -np.inf
            # A part in 10^9 covers rounding where partial scores pass 2^53; totals are exact.
            keep |= _best(partial, k) if cut is None else ~(partial * lists < cut - np.abs(cut) * 1e-9)
        i, j, total = _totals(q, x, keep & ~own)
        if cut is not None:
            enough = ~(total < cut[i, 0])
            i, j, total = i[enough], j[enough], total[enough]
        order = np.lexsort((x_id[j], -total, i))
        i, j, total = i[order], j[order], total[order]
        rank = np.arange(len(i)) - np.searchsorted(i, i)
        i, j, total = i[rank < k], j[rank < k], total[rank < k]
        return q_id[i].astype(np.int64), x_id[j].astype(np.int64), total

    return run


def _blocks(vectors: DataFrame, column: str, components: int, rows: int | None, least: int = 1) -> int:
    """How many blocks of so many components, or rows; at least so many, unless they got under 1024 rows."""
    n, dim = vectors.agg(F.count("*"), F.max(F.size(column))).first()
    if rows:
        return max(1, -(-n // rows))
    return max(1, min(least, -(-n // 1024)), -(-n // max(256, components // max(1, dim or 1))))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, lists: int = 2, scale: int = 256, block_rows: int | None = None, block_queries: int | None = None) -> DataFrame:
    """vectors, queries (vec_id, embedding): returns query_id, rank, vec_id, score."""
    vectors = vectors.select("vec_id", "embedding").filter(finite("embedding") & F.col("vec_id").isNotNull())
    queries = queries.filter(finite("embedding") & F.col("vec_id").isNotNull()).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    n_rows = _blocks(vectors, "embedding", ROWS, block_rows, vectors.sparkSession.sparkContext.defaultParallelism)
    n_queries = _blocks(queries, "query", QUERIES, block_queries)
    dealt = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    rows = vectors.withColumn("dim", F.size("embedding")).withColumn("rb", dealt("vec_id", n_rows))
    rows = rows.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(n_queries - 1))))
    asked = queries.withColumn("dim", F.size("query")).withColumn("qb", dealt("query_id", n_queries))
    tile = ["dim", "rb", "qb"]
    schema = "query_id long, vec_id long, score long"
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def met(asked: DataFrame, with_cutoff: bool) -> DataFrame:
        spread = asked.withColumn("rb", F.explode(F.sequence(F.lit(0), F.lit(n_rows - 1))))
        found = rows.groupBy(*tile).cogroup(spread.groupBy(*tile)).applyInArrow(_block(k, lists, scale, with_cutoff), schema)
        return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)

    # Phase 1. Fewer than k candidates in all: no cutoff, so every entry is collected.
    lists_of = met(asked, False)
    cutoffs = lists_of.groupBy("query_id").agg(F.when(F.count("*") == k, F.min("score")).alias("cutoff"))
    cutoffs = written(cutoffs, "cutoffs")
    asked = asked.join(cutoffs, "query_id", "left").withColumn("cutoff", F.col("cutoff").cast("double"))
    return met(asked, True).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
