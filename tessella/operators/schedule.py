"""Which node answers which query, and queues of leaves. Results don't depend on any of it; reports do.

Static, sorted and merge steps are DataFrame operations. Greedy, dynamic and stealing runs are folds over queries in
order, each step of which needs the one before: one task reads ids and estimates in order, a batch at a time, and holds
no more than a few numbers a node. Stealing takes from both ends, so its task keeps the estimates in a mapped file.
"""

from __future__ import annotations

import heapq
import mmap
import tempfile
from collections.abc import Callable, Iterator, Sequence
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.storage import numbered

FOLDED = 5_000_000


def static(queries: DataFrame, nodes: int) -> DataFrame:
    """Equal runs of queries in id order; the last node takes the rest. query_id counts from 0."""
    placed, total = numbered(queries.select("query_id"), "query_id"), queries.count()
    return placed.select("query_id", F.least(F.floor(F.col("place") / max(1, total // nodes)), F.lit(nodes - 1)).cast("int").alias("node"))


def ordered(queries: DataFrame, by: str) -> DataFrame:
    """Hardest first, ties by id: query_id, place."""
    return numbered(queries.select("query_id", by), F.desc(by), "query_id").select("query_id", (F.col("place") + 1).cast("int").alias("place"))


class Greedy:
    """The current node gets a query; once its score reaches the highest, the next node's turn comes."""

    def __init__(self, nodes: int):
        self.scores, self.highest, self.node = [0.0] * nodes, 0.0, 0

    def take(self, estimates: Sequence[float]) -> list[int]:
        """The node of each query in turn."""
        scores, highest, node, out = self.scores, self.highest, self.node, []
        for e in estimates:
            out.append(node)
            score = scores[node] = scores[node] + e
            if score >= highest:
                highest, node = score, (node + 1) % len(scores)
        self.highest, self.node = highest, node
        return out


def greedy(estimates: Sequence[float], nodes: int) -> list[int]:
    return Greedy(nodes).take(estimates)


class Dynamic:
    """A burst in turn to every node, then the next query to whichever is free first. clocks: when each node is free."""

    def __init__(self, nodes: int, burst: int = 1):
        self.nodes, self.left, self.at, self.free = nodes, nodes * burst, 0, [(0.0, n) for n in range(nodes)]

    @property
    def clocks(self) -> list[float]:
        return [at for at, _ in self.free]

    def take(self, estimates: Sequence[float]) -> tuple[list[int], list[float], list[float]]:
        """node, start and end of each query in turn."""
        nodes, starts, ends, head = [], [], [], estimates[: self.left]
        self.left -= len(head)
        for e in head:  # in turn; free is in the order of nodes
            node = self.at % self.nodes
            at = self.free[node][0]
            self.free[node], self.at = (at + e, node), self.at + 1
            nodes.append(node), starts.append(at), ends.append(at + e)
        if not self.left and len(head):
            heapq.heapify(self.free)
        free, replace = self.free, heapq.heapreplace
        for e in estimates[len(head) :] if head else estimates:
            at, node = free[0]
            end = at + e
            replace(free, (end, node))
            nodes.append(node), starts.append(at), ends.append(end)
        return nodes, starts, ends

    def pass_over(self, estimates: Sequence[float]) -> None:
        """As take(), where only the clocks matter."""
        if self.left:
            self.take(estimates)
            return
        free, replace = self.free, heapq.heapreplace
        for e in estimates:
            at, node = free[0]
            replace(free, (at + e, node))


def dynamic(estimates: Sequence[float], nodes: int, burst: int = 1) -> list[tuple[int, float, float]]:
    """(node, start, end) of each query."""
    return list(zip(*Dynamic(nodes, burst).take(estimates), strict=True))


def stolen(costs: Sequence[Sequence[float]], given: int = 4) -> Iterator[tuple[int, int, int]]:
    """(node, place, runner) as batches run. costs: of each node's batches, by queue index.

    A node without work takes, from the fullest node, up to given batches that are not begun, those with the largest queue
    index. So what a node has left is always a run (low to high) of the batches that one node began with (own).
    """
    nodes = range(len(costs))
    own, low, high, clock = list(nodes), [0] * len(costs), [len(c) for c in costs], [(0.0, n) for n in nodes]
    while clock:
        at, node = clock[0]
        if low[node] == high[node]:
            left = [h - k for h, k in zip(high, low, strict=True)]
            victim = left.index(max(left))
            if not left[victim]:
                heapq.heappop(clock)
                continue
            own[node], high[node] = own[victim], high[victim]
            low[node] = high[victim] = max(low[victim], high[victim] - given)
        source, k = own[node], low[node]
        low[node] = k + 1
        yield source, k, node
        heapq.heapreplace(clock, (at + costs[source][k], node))


def stealing(batches: Sequence[tuple[int, int, float]], nodes: int, given: int = 4) -> list[tuple[int, int]]:
    """(batch, node) after stealing. batches: (node, smallest queue index, cost)."""
    own: list[list[tuple[int, float, int]]] = [[] for _ in range(nodes)]
    for k, (node, queue, cost) in enumerate(batches):
        own[node].append((queue, cost, k))
    for work in own:
        work.sort()
    return sorted((own[source][k][2], node) for source, k, node in stolen([[cost for _, cost, _ in work] for work in own], given))


def folded(queries: DataFrame, by: str | None = None) -> list:
    """Ids and estimates (query_id, est) in id order, or dearest first, on the driver: at most FOLDED queries, about 500 MB."""
    rows = queries.select("query_id", "est").orderBy(*([F.desc(by), "query_id"] if by else ["query_id"])).limit(FOLDED + 1).toArrow()
    if rows.num_rows > FOLDED:
        raise ValueError(f"a fold takes {FOLDED} queries at most; schedule them in sets")
    return list(zip(rows.column("query_id").to_pylist(), rows.column("est").to_pylist(), strict=True))


def in_order(queries: DataFrame, fold: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, by: str | None = None) -> DataFrame:
    """A fold over batches of query_id and est, in id order or dearest first: of any number of queries, in one task.

    A row of nulls goes along, so that there is a task where there are no queries.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return fold(b.filter(b.column("query_id").is_valid()) if b.column("query_id").null_count else b for b in batches)

    none = queries.sparkSession.range(1).select(F.lit(None).cast("long").alias("query_id"), F.lit(None).cast("double").alias("est"))
    rows = queries.select("query_id", "est").unionByName(none).repartition(1)
    return rows.sortWithinPartitions(*([F.desc(by), "query_id"] if by else ["query_id"])).mapInArrow(run, schema)


def estimates_of(batch: pa.RecordBatch) -> list[float]:
    """A null is an error."""
    return batch.column("est").to_numpy().tolist()


def greedy_schedule(queries: DataFrame, nodes: int, sort: bool = True) -> DataFrame:
    """queries (query_id, est): query_id, node."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        deal = Greedy(nodes)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("query_id"), pa.array(deal.take(estimates_of(batch)), pa.int32())], ["query_id", "node"])

    return in_order(queries, fold, "query_id long, node int", "est" if sort else None)


def dynamic_schedule(queries: DataFrame, nodes: int, burst: int = 1, sort: bool = False) -> DataFrame:
    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        deal = Dynamic(nodes, burst)
        for batch in batches:
            node, start, end = deal.take(estimates_of(batch))
            yield pa.RecordBatch.from_arrays([batch.column("query_id"), pa.array(node, pa.int32()), pa.array(start, pa.float64()), pa.array(end, pa.float64())], ["query_id", "node", "start", "end"])

    return in_order(queries, fold, "query_id long, node int, start double, end double", "est" if sort else None)


def kept_costs(batches: Iterator[pa.RecordBatch]) -> memoryview:
    """The estimates of a fold's queries in a temporary file that is mapped: any of them can be read, and memory needn't hold them."""
    with tempfile.TemporaryFile() as file:
        for batch in batches:
            file.write(batch.column("est").to_numpy().tobytes())
        file.flush()
        return memoryview(mmap.mmap(file.fileno(), 0) if file.tell() else b"").cast("d")


def stealing_schedule(queries: DataFrame, nodes: int, given: int = 4) -> DataFrame:
    """batch, node after stealing: batches are queries (query_id, est) by their place in id order, and begin dealt in turn."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        costs = kept_costs(batches)
        runs = stolen([costs[n::nodes] for n in range(nodes)], given)
        while some := [(source + nodes * k, node) for source, k, node in islice(runs, 1 << 16)]:
            batch, node = zip(*some, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(batch, pa.int32()), pa.array(node, pa.int32())], ["batch", "node"])

    return in_order(queries, fold, "batch int, node int")


def answered(queries: DataFrame, placed: DataFrame, nodes: int, search: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Each node answers the queries that a schedule (query_id, node) gives it, by any search of queries: query_id, node and the search's columns."""
    out = None
    for node in range(nodes):
        mine = queries.join(placed.filter(F.col("node") == node).select("query_id"), "query_id")
        part = search(mine).withColumn("node", F.lit(node))
        out = part if out is None else out.unionByName(part)
    return out


def merged(answers: DataFrame) -> DataFrame:
    """Best answer of each query over all nodes; unanswered (null) ones don't count."""
    best = F.min(F.when(F.col("d2").isNotNull(), F.struct("d2", "series_id")))
    return answers.groupBy("query_id").agg(best.alias("b")).select("query_id", "b.series_id", "b.d2")


def bounded_queues(bounds: DataFrame, size: int) -> DataFrame:
    """bounds (query_id, batch_id, leaf, lb): leaves of a batch in bound order, cut into queues of a size."""
    order = Window.partitionBy("query_id", "batch_id").orderBy("lb", "leaf")
    return bounds.withColumn("queue", F.floor((F.row_number().over(order) - 1) / size).cast("int"))


def queue_order(queues: DataFrame) -> DataFrame:
    """Queues of a query by their head's bound: query_id, batch_id, queue, head, size, place."""
    heads = queues.groupBy("query_id", "batch_id", "queue").agg(F.min("lb").alias("head"), F.count("*").alias("size"))
    order = Window.partitionBy("query_id").orderBy("head", "batch_id", "queue")
    return heads.withColumn("place", (F.row_number().over(order) - 1).cast("int"))


def batch_ranges(placed: DataFrame) -> DataFrame:
    """First and last place of each batch's queues."""
    return placed.groupBy("query_id", "batch_id").agg(F.min("place").alias("first"), F.max("place").alias("last"))
