"""Sweeps over settings: how schedules, stealing, thresholds, groups and index sizes compare. Rows, not charts."""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import estimate_threshold
from ..plans.config import IndexConfig
from ..plans.storage import written
from . import index, partition, schedule, search

MODES = ("static", "greedy", "greedy_sorted", "dynamic", "dynamic_sorted")


def modes(queries: DataFrame, nodes: Sequence[int], of: Sequence[str] = MODES) -> DataFrame:
    """mode, nodes, makespan, total of scheduling modes, from estimates (query_id, est): a pass in id order, and one dearest first."""
    total = queries.count()
    schema, names = "mode string, nodes int, makespan double, total double", ["mode", "nodes", "makespan", "total"]

    def told(tail: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            static = {n: [0.0] * n for n in nodes if f"static{tail}" in of}
            greedy, dynamic = ({n: kind(n) for n in nodes if f"{name}{tail}" in of} for name, kind in (("greedy", schedule.Greedy), ("dynamic", schedule.Dynamic)))
            sums, at = [], 0
            for batch in batches:
                given = schedule.estimates_of(batch)
                for deal in greedy.values():
                    deal.take(given)
                for deal in dynamic.values():
                    deal.pass_over(given)
                for n, loads in static.items():
                    size, k = max(1, total // n), 0
                    while k < len(given):
                        node = min((at + k) // size, n - 1)
                        end = len(given) if node == n - 1 else min(len(given), (node + 1) * size - at)
                        loads[node], k = float(np.cumsum([loads[node], *given[k:end]])[-1]), end
                sums, at = [*sums, sum(given)] if len(sums) < 1 << 12 else [math.fsum(sums), sum(given)], at + len(given)
            loads = [("static", n, x) for n, x in static.items()] + [("greedy", n, g.scores) for n, g in greedy.items()] + [("dynamic", n, d.clocks) for n, d in dynamic.items()]
            yield pa.RecordBatch.from_pylist([dict(zip(names, (f"{mode}{tail}", n, max(x), math.fsum(sums)), strict=True)) for mode, n, x in loads], pa.schema(list(zip(names, (pa.string(), pa.int32(), pa.float64(), pa.float64()), strict=True))))

        return fold

    passes = [schedule.in_order(queries, told(tail), schema, by) for tail, by in (("", None), ("_sorted", "est")) if any(m.endswith("_sorted") == bool(tail) for m in of)]
    return reduce(DataFrame.unionByName, passes)


def bursts(queries: DataFrame, nodes: int, sizes: Sequence[int]) -> DataFrame:
    """burst, makespan: how many queries a node gets at first."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        deals, last = [schedule.Dynamic(nodes, b) for b in sizes], [0.0] * len(sizes)
        for batch in batches:
            given = schedule.estimates_of(batch)
            last = [max(end, *deal.take(given)[2]) for end, deal in zip(last, deals, strict=True)] if given else last
        yield pa.RecordBatch.from_arrays([pa.array(sizes, pa.int32()), pa.array(last, pa.float64())], ["burst", "makespan"])

    return schedule.in_order(queries, fold, "burst int, makespan double")


def steals(queries: DataFrame, nodes: int, given: Sequence[int]) -> DataFrame:
    """given, moved: batches that end up on another node, by how many are given away at once; all begin on node 0."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        costs = schedule.kept_costs(batches)
        moved = [sum(node != 0 for _, _, node in schedule.stolen([costs, *[()] * (nodes - 1)], g)) for g in given]
        yield pa.RecordBatch.from_arrays([pa.array(given, pa.int32()), pa.array(moved, pa.int32())], ["given", "moved"])

    return schedule.in_order(queries, fold, "given int, moved int")


def thresholds(distances: DataFrame, model: tuple[float, float, float, float, float], divisors: Sequence[int]) -> DataFrame:
    """divisor, mean_th, max_th of the estimated queue sizes over distances (x)."""
    rows = distances.select("x", F.explode(F.array(*map(F.lit, divisors))).alias("divisor"))
    th = F.coalesce(*(F.when(F.col("divisor") == d, estimate_threshold(F.col("x"), model, d)) for d in divisors))
    return rows.groupBy("divisor").agg(F.avg(th).alias("mean_th"), F.max(th).alias("max_th"))


def group_sweep(entries: DataFrame, groups: Sequence[int]) -> DataFrame:
    """groups, fullest, mean: how even the Gray-order deal is."""
    buckets, out = partition.histogram(entries), None
    for g in groups:
        each = partition.group_counts(partition.gray_deal(buckets, g)).agg(F.max("n_series").alias("fullest"), (F.sum("n_series") / g).alias("mean")).select(F.lit(g).alias("groups"), "fullest", "mean")
        out = each if out is None else out.unionByName(each)
    return out


def bsf_policies(tree: index.Index, queries: DataFrame, nodes: Sequence[int], runs: int = 1) -> DataFrame:
    """nodes, policy, run, real: distances computed by nodes that each hold every so-manieth root, with the seed of each node's
    own leaf alone (own) or of whichever node has the query's leaf (shared)."""
    asked = written(search.prepared(queries, tree), "asked")
    each = search.policy_counts(search.seeded(asked, tree, 1)[0], tree, nodes)
    policies = F.explode(F.array(*(F.struct(F.lit(p).alias("policy"), F.col(p).alias("real")) for p in ("own", "shared")))).alias("of")
    each = each.select("nodes", policies).select("nodes", "of.policy", "of.real")
    return each.select("nodes", "policy", F.explode(F.sequence(F.lit(1), F.lit(runs))).alias("run"), "real")


def index_scaling(series: DataFrame, config: IndexConfig, quarters: Sequence[int] = (1, 2, 3, 4)) -> DataFrame:
    """quarters, n_series, n_in_leaves, n_leaves and build_sec of indexes over the first quarters of the ids."""
    total, out = series.agg(F.max("series_id") + 1).first()[0] or 0, None
    for q in quarters:
        part = series.filter(F.col("series_id") < total * q / 4)
        began = time.perf_counter()
        tree = index.build(part, config)
        took = time.perf_counter() - began
        each = index.validity(tree, part).select(F.lit(q).alias("quarters"), "n_series", "n_in_leaves", "n_leaves", F.lit(took).alias("build_sec"))
        out = each if out is None else out.unionByName(each)
    return out
