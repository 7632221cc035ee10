"""Approximate and exact nearest neighbours, in bulk.

Queries meet the index's blocks that they visit, and nothing else is read. A seed distance comes from the leaf that a
query falls in. Queries are dealt to groups, blocks too, each of at most GROUP_BYTES; a group of queries meets a block
where one of its queries isn't ruled out by the block's box (the hull of its leaves). The folders that are visited at
all are read, and a pair of groups (a tile) is a task: rows are shuffled once for each group on the other side, so at
most about GROUPS times, or as often as groups are needed for memory. An index of a few blocks is visited whole,
without a seed.

In a tile series and queries go in the order of their words, in runs; a run whose box is beyond a query's best distance so
far is left out for it. What remains is compared by a product of matrices, which is off by a known rounding error, and
what may be among the best k within it gets its distance by differences. Bounds compare with <=, so that ties stay and
the smallest id wins. Queries that are null or hold undefined values have no answers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels
from ..plans.config import IndexConfig
from ..plans.storage import written
from .index import BLOCK_SERIES, Index, leaf_of, summarise

BLOCK_QUERIES = 2048
#: Bytes of a group's values; groups on a side where rows allow it, for parallel tasks, and the rows that are worth one; series of a run; queries of a product; numbers of a bound's matrix.
GROUP_BYTES, GROUPS, GROUP_LEAST, RUN, TOGETHER, CELLS = 1 << 25, 8, 256, 512, 1024, 1 << 19
FOUND = "query_id long, series_id long, d2 double"


class SearchStrategy(Protocol):
    """A routine that answers queries (query_id, values) over an index; schedulers take any."""

    def __call__(self, queries: DataFrame, index: Index) -> DataFrame: ...


def prepared(queries: DataFrame, index: Index) -> DataFrame:
    """Queries (query_id, values) with their summaries and leaf."""
    return leaf_of(summarise(queries, index.config, "query_id"), index)


def _top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy("d2", "series_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "series_id", "d2")


def _slack(bounds: np.ndarray) -> np.ndarray:
    """Rounding must not lose a tie."""
    return bounds * (1 - 1e-9)


def _norms(x: np.ndarray) -> np.ndarray:
    return np.einsum("nl,nl->n", x, x)


def _places(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As nonzero(), which takes many times as long over rows and columns as over a line."""
    return np.divmod(np.flatnonzero(mask), mask.shape[1])


class _Nearest:
    """The k nearest series of each query (smallest distance, then id), over series that come a run at a time. cut: what is farther isn't asked for."""

    def __init__(self, q: np.ndarray, k: int, cut: np.ndarray | None = None):
        self.q, self.k, self.cut, self.norm = q, k, np.full(len(q), np.inf) if cut is None else cut, _norms(q)
        self.d, self.ids = np.full((len(q), k), np.inf), np.full((len(q), k), np.iinfo(np.int64).max)
        self.sides: dict[type, np.ndarray] = {}

    def reach(self) -> np.ndarray:
        return np.minimum(self.d[:, -1], self.cut)

    def _side(self, kind: type) -> np.ndarray:
        if kind not in self.sides:
            self.sides[kind] = np.concatenate([-2 * self.q, np.ones((len(self.q), 1))], axis=1).astype(kind)
        return self.sides[kind]

    def take(self, x: np.ndarray, ids: np.ndarray, rows: np.ndarray | None = None) -> None:
        """rows: the queries that meet these series."""
        if not len(x) or not len(self.q):
            return
        x_norm = _norms(x)
        top = max(x_norm.max(), self.norm.max())
        kind = np.float32 if 1e-20 < top < 1e30 else np.float64  # within range products can't overflow, nor lose all digits
        other = np.concatenate([x, x_norm[:, None]], axis=1).astype(kind).T
        rows = np.arange(len(self.q)) if rows is None else rows
        for at in range(0, len(rows), TOGETHER):
            some = rows[at : at + TOGETHER]
            near = self._side(kind)[some] @ other  # less the query's own norm
            slack = 16 * (x.shape[1] + 4) * float(np.finfo(kind).eps) * (self.norm[some] + x_norm.max())
            limit = np.minimum(self.d[some, -1], self.cut[some]) - self.norm[some] + slack
            inside = near <= limit[:, None].astype(kind) if np.isfinite(limit).all() else None
            if near.shape[1] > self.k and (inside is None or np.count_nonzero(inside) > 4 * self.k * len(some)):
                kth = near.min(axis=1) if self.k == 1 else np.partition(near, self.k - 1, axis=1)[:, self.k - 1]
                inside = near <= np.minimum(limit, kth + slack)[:, None].astype(kind)
            i, j = _places(inside if inside is not None else np.ones(near.shape, bool))
            for s in range(0, len(i), 1 << 16):
                i_, j_ = some[i[s : s + (1 << 16)]], j[s : s + (1 << 16)]
                self.offer(i_, ids[j_], _paired(self.q, i_, x, j_))

    def offer(self, i: np.ndarray, ids: np.ndarray, d: np.ndarray) -> None:
        """Distances d of series ids to queries i."""
        far = self.d[i, -1]
        may = (d < far) | ((d == far) & (ids < self.ids[i, -1]))
        i, ids, d = i[may], ids[may], d[may]
        if not len(i):
            return
        rows, of = np.unique(i, return_inverse=True)
        of, d, ids = (np.concatenate(p) for p in ((np.repeat(np.arange(len(rows)), self.k), of), (self.d[rows].ravel(), d), (self.ids[rows].ravel(), ids)))
        order = np.lexsort((ids, d, of))
        of, d, ids = of[order], d[order], ids[order]
        keep = np.arange(len(of)) - np.searchsorted(of, of) < self.k  # each row has k at least
        self.d[rows], self.ids[rows] = d[keep].reshape(-1, self.k), ids[keep].reshape(-1, self.k)

    def found(self, q_ids: np.ndarray) -> pa.Table:
        i, j = np.nonzero(np.isfinite(self.d))
        return pa.table({"query_id": q_ids[i].astype(np.int64), "series_id": self.ids[i, j], "d2": self.d[i, j]})


def _paired(q: np.ndarray, i: np.ndarray, x: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Squared distances of q[i] to x[j], a piece at a time."""
    return np.concatenate([np.zeros(0), *(kernels.paired_distances(q[i[s : s + 8192]], x[j[s : s + 8192]]) for s in range(0, len(i), 8192))])


def _of_each(x: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Rows without copies that can't be among k nearest: of equal series the k smallest ids."""
    whole = np.ascontiguousarray(x + 0.0).view(np.dtype((np.void, x.itemsize * x.shape[1]))).ravel()
    _, of = np.unique(whole, return_inverse=True)
    order = np.lexsort((ids, of))
    return np.sort(order[np.arange(len(of)) - np.searchsorted(of[order], of[order]) < k])


def _word_order(sax: np.ndarray, bits: int) -> np.ndarray:
    """Rows by the first bits of all symbols, then the second ones, and so on: near series are near in it."""
    key = np.zeros(len(sax), np.int64)
    for level in range(min(bits, max(1, 62 // max(1, sax.shape[1])))):
        for s in range(sax.shape[1]):
            key = (key << 1) | ((sax[:, s] >> (bits - 1 - level)) & 1)
    return np.argsort(key, kind="stable")


def _bounds(config: IndexConfig, means: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Lower bounds of queries x boxes, in pieces of CELLS numbers."""
    out, step = np.empty((len(means), len(low))), max(1, CELLS // max(1, len(low)))
    for at in range(0, len(means), step):
        out[at : at + step] = kernels.bounds(means[at : at + step], low, high, config.scale)
    return out


class _Tile:
    """Series of a group of blocks, by leaf, and the queries of a group that meet them, as arrays."""

    def __init__(self, config: IndexConfig, series: pa.Table, queries: pa.Table):
        self.config = config
        names, of = np.unique(series.column("leaf").to_numpy(zero_copy_only=False).astype(str), return_inverse=True)
        order = np.argsort(of, kind="stable")
        self.names, self.leaf, self.starts = names, of[order], np.searchsorted(of[order], np.arange(len(names) + 1))
        self.ids, self.x = series.column("series_id").to_numpy()[order], kernels.matrix(series.column("values"), config.length)[order]
        self.sax, kept = (kernels.matrix(series.column(c), config.segments, np.int64)[order] for c in ("sax", "kept"))
        self.root = series.column("root").to_numpy()[order][self.starts[:-1]]
        self.head = np.maximum.reduceat(series.column("head").to_numpy(zero_copy_only=False)[order].astype(int), self.starts[:-1])
        self.kept = kept[self.starts[:-1]]
        self.word = self.sax[self.starts[:-1]] >> (config.bits - self.kept)
        self.q_ids, self.q, self.means = queries.column("query_id").to_numpy(), kernels.matrix(queries.column("values"), config.length), kernels.matrix(queries.column("paa"), config.segments)
        self.bsf, radius = (np.where(np.isnan(v), np.inf, v) for v in (queries.column(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in ("bsf", "radius")))
        self.limit = np.minimum(self.bsf, radius)

    def rows(self, n: int) -> slice:
        """The series of a leaf."""
        return slice(self.starts[n], self.starts[n + 1])

    def bounds(self, some: slice | np.ndarray = slice(None)) -> np.ndarray:
        """Of queries and leaves."""
        return _bounds(self.config, self.means[some], *kernels.node_ranges(self.word, self.kept, self.config.bits))

    def record_bounds(self) -> Callable[[int, np.ndarray | slice], np.ndarray]:
        """A function of a query and rows of series: the rows' bounds, from a table of a query's squared gaps to each symbol."""
        (low, high), symbols, scale = kernels.edges(self.config.bits), np.ascontiguousarray(self.sax.T).astype(np.intp), self.config.scale

        def run(i: int, rows: np.ndarray | slice) -> np.ndarray:
            m = self.means[i][:, None]
            gap = np.maximum(np.maximum(low - m, m - high), 0)
            gap, out = gap * gap, 0.0
            for s in range(len(gap)):
                out = out + gap[s].take(symbols[s][rows])
            return out * scale

        return run


def _refine(config: IndexConfig, k: int, by_leaf: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """by_leaf: leaves that a query's limit rules out may hold nearer series, and don't count."""

    def run(series: pa.Table, queries: pa.Table) -> pa.Table:
        if not series.num_rows or not queries.num_rows:
            return _Nearest(np.zeros((0, config.length)), k).found(np.zeros(0, np.int64))
        tile = _Tile(config, series, queries)
        best = _Nearest(tile.q, k, tile.bsf)
        if by_leaf:
            for n in range(len(tile.names)):
                box = kernels.node_ranges(tile.word[[n]], tile.kept[[n]], config.bits)
                rows = np.flatnonzero(_slack(_bounds(config, tile.means, *box))[:, 0] <= np.minimum(tile.limit, best.reach()))
                for at in range(tile.starts[n], tile.starts[n + 1], RUN):
                    part = slice(at, min(at + RUN, tile.starts[n + 1]))
                    best.take(tile.x[part], tile.ids[part], rows)
            return best.found(tile.q_ids)
        kept = _of_each(tile.x, tile.ids, k)
        kept = kept[_word_order(tile.sax[kept], config.bits)]
        x, ids, sax, (low, high) = tile.x[kept], tile.ids[kept], tile.sax[kept], kernels.edges(config.bits)
        at = np.arange(0, len(x), RUN)
        lb = _slack(_bounds(config, tile.means, low[np.minimum.reduceat(sax, at)], high[np.maximum.reduceat(sax, at)]))
        order, first = _word_order(kernels.sax(tile.means, config.bits), config.bits), lb.argmin(axis=1)
        for nearest in (True, False):  # a query's nearest run first, for a short reach
            for n, start in enumerate(at):
                mine = (first == n) if nearest else (first != n) & (lb[:, n] <= best.reach())
                best.take(x[start : start + RUN], ids[start : start + RUN], order[mine[order]])
        return best.found(tile.q_ids)

    return run


def _count(config: IndexConfig) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(series: pa.Table, queries: pa.Table) -> pa.Table:
        q_ids = queries.column("query_id").to_numpy() if queries.num_rows else np.zeros(0, np.int64)
        leaves, bounds, real = (np.zeros(len(q_ids), np.int64) for _ in range(3))
        if series.num_rows and queries.num_rows:
            tile = _Tile(config, series, queries)
            sizes, record = np.diff(tile.starts), tile.record_bounds()
            for at in range(0, len(q_ids), 256):
                going = _slack(tile.bounds(slice(at, at + 256))) <= tile.limit[at : at + 256, None]
                leaves[at : at + 256], bounds[at : at + 256] = going @ tile.head, going @ sizes
                for i, mine in enumerate(going, at):
                    real[i] = bounds[i] if np.isinf(tile.bsf[i]) else np.count_nonzero(_slack(record(i, np.flatnonzero(mine[tile.leaf]))) <= tile.bsf[i])
        return pa.table({"query_id": q_ids.astype(np.int64), "leaves": leaves, "bounds": bounds, "real": real})

    return run


def _n_groups(rows: int, length: int, least: int = GROUP_LEAST) -> int:
    return max(1, -(-rows // max(1, GROUP_BYTES // (8 * length))), min(GROUPS, rows // least))


def _dealt(index: Index) -> tuple[DataFrame, int]:
    """block, part, sg (its group; so many), low, high (its box of symbols): as many rows as blocks."""
    low = F.transform(F.arrays_zip("word", "kept"), lambda z: (z["word"] * F.pow(F.lit(2), index.config.bits - z["kept"])).cast("int"))
    high = F.transform(F.arrays_zip("word", "kept"), lambda z: ((z["word"] + 1) * F.pow(F.lit(2), index.config.bits - z["kept"]) - 1).cast("int"))
    spans = index.spans.select("block", "part", low.alias("low"), high.alias("high"))
    segments = range(index.config.segments)
    boxes = spans.groupBy("block").agg(F.first("part").alias("part"), F.array(*(F.min(F.col("low")[s]) for s in segments)).alias("low"), F.array(*(F.max(F.col("high")[s]) for s in segments)).alias("high"))
    n = _n_groups(index.n_series, index.config.length)
    return boxes.withColumn("sg", ((F.row_number().over(Window.orderBy("block")) - 1) % n).cast("int")), n


def _visits(index: Index, asked: DataFrame, n_queries: int) -> DataFrame:
    """block, part, sg, qb: blocks that a query of a group visits, by its limit and the block's box."""
    config = index.config
    limit = F.least(F.coalesce("bsf", F.lit(float("inf"))), F.coalesce("radius", F.lit(float("inf"))))
    boxes = _dealt(index)[0].withColumn("b_qb", F.explode(F.sequence(F.lit(0), F.lit(n_queries - 1))))
    mine = asked.select(_group_of(n_queries).alias("qb"), "paa", limit.alias("limit"))
    low_edges, high_edges = kernels.edges(config.bits)

    def run(some: pa.Table, queries: pa.Table) -> pa.Table:
        keep = np.zeros(some.num_rows, bool)
        if some.num_rows and queries.num_rows:
            low, high = (kernels.matrix(some.column(c), config.segments, np.int64) for c in ("low", "high"))
            means, limits, step = kernels.matrix(queries.column("paa"), config.segments), queries.column("limit").to_numpy(), max(1, CELLS // some.num_rows)
            for at in range(0, len(means), step):
                keep |= (_slack(kernels.bounds(means[at : at + step], low_edges[low], high_edges[high], config.scale)) <= limits[at : at + step, None]).any(axis=0)
        return some.select(["block", "part", "sg", "b_qb"]).rename_columns(["block", "part", "sg", "qb"]).filter(pa.array(keep))

    return boxes.groupBy("b_qb").cogroup(mine.groupBy("qb")).applyInArrow(run, "block string, part int, sg int, qb int")


def _group_of(n: int) -> Column:
    return F.pmod(F.xxhash64("query_id"), F.lit(n)).cast("int")


ENTRY_COLUMNS = ["series_id", "values", "sax", "root", "leaf", "kept", "head"]
ASKED = ["query_id", "values", "paa", "bsf", "radius"]


def _met(index: Index, asked: DataFrame, n_asked: int, run: Callable, schema: str, only: Column | None = None, columns: list[str] = ASKED) -> DataFrame:
    """Groups of blocks and groups of queries (asked, by query_id) that visit one of them."""
    n_queries = _n_groups(n_asked, index.config.length)
    entries = index.entries.filter(only) if only is not None else index.entries
    if index.few:
        sg = F.array_position(F.array(*map(F.lit, index.few)), F.col("block")).cast("int")
        series = entries.withColumns({"sg": sg, "qb": F.explode(F.sequence(F.lit(0), F.lit(n_queries - 1)))})
        places = F.sequence(F.lit(1), F.lit(len(index.few)))
        queries = asked.withColumns({"q_qb": _group_of(n_queries), "q_sg": F.explode(places)})
    else:
        visits = written(_visits(index, asked, n_queries), "visits")
        parts = [r.part for r in visits.select("part").distinct().collect()]  # PARTS at most
        series = entries.filter(F.col("part").isin(parts)).join(visits.select("part", "block", "sg", "qb"), ["part", "block"])
        pairs = visits.select(F.col("qb").alias("q_qb"), F.col("sg").alias("q_sg")).distinct()
        queries = asked.withColumn("q_qb", _group_of(n_queries)).join(F.broadcast(pairs), "q_qb")  # groups x groups
    series = series.select("sg", "qb", *ENTRY_COLUMNS)
    return series.groupBy("sg", "qb").cogroup(queries.select("q_sg", "q_qb", *columns).groupBy("q_sg", "q_qb")).applyInArrow(run, schema)


def _in_own(index: Index, asked: DataFrame, run: Callable, schema: str, columns: list[str]) -> DataFrame:
    """Leaves and the queries that ask for them (asked, a row for each query and leaf), in groups of blocks; where many ask, these in groups too."""
    blocks, n = _dealt(index)
    where = written(index.spans.select("leaf", "block", "part").join(blocks.select("block", "sg"), "block").join(asked.select("leaf").distinct(), "leaf", "left_semi"), "where")
    loads = {r.sg: r.n for r in asked.groupBy("leaf").agg(F.count("*").alias("n")).join(where.select("leaf", "sg").distinct(), "leaf").groupBy("sg").agg(F.sum("n").alias("n")).collect()}  # as many as groups
    split = F.array(*(F.lit(_n_groups(loads.get(g, 0), index.config.length, 1 << 14)) for g in range(n)))
    queries = asked.join(where.select("leaf", F.col("sg").alias("q_sg")).distinct(), "leaf").withColumn("q_qb", F.pmod(F.xxhash64("query_id"), split[F.col("q_sg")]).cast("int"))
    entries = index.entries if index.few else index.entries.filter(F.col("part").isin([r.part for r in where.select("part").distinct().collect()]))
    series = entries.join(where.select("leaf", "block", "sg"), ["leaf", "block"]).withColumn("qb", F.explode(F.sequence(F.lit(0), split[F.col("sg")] - 1)))
    return series.select("sg", "qb", "series_id", "values", "sax", "leaf").groupBy("sg", "qb").cogroup(queries.select("q_sg", "q_qb", *columns).groupBy("q_sg", "q_qb")).applyInArrow(run, schema)


def _by_leaf(series: pa.Table, queries: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of series and of queries, a leaf at a time."""
    names = np.concatenate([t.column("leaf").to_numpy(zero_copy_only=False).astype(str) for t in (series, queries)])
    _, of = np.unique(names, return_inverse=True)
    sides = []
    for codes in (of[: series.num_rows], of[series.num_rows :]):
        order = np.argsort(codes, kind="stable")
        sides.append((order, np.searchsorted(codes[order], np.arange(of.max(initial=-1) + 2))))
    (rows, r), (asking, a) = sides
    for n in np.flatnonzero((np.diff(r) > 0) & (np.diff(a) > 0)):
        yield rows[r[n] : r[n + 1]], asking[a[n] : a[n + 1]]


def approximate(queries: DataFrame, index: Index, k: int = 1) -> DataFrame:
    """The best k of the query's own leaf: query_id, rank, series_id, d2; no row where the leaf is empty. queries: prepared()."""
    asked = written(queries.filter("leaf is not null").select("query_id", "leaf", F.col("values").alias("values")), "asked")
    length = index.config.length

    def run(some: pa.Table, mine: pa.Table) -> pa.Table:
        if not some.num_rows or not mine.num_rows:
            return _Nearest(np.zeros((0, length)), k).found(np.zeros(0, np.int64))
        x, ids, best = kernels.matrix(some.column("values"), length), some.column("series_id").to_numpy(), _Nearest(kernels.matrix(mine.column("values"), length), k)
        pairs = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for rows, asking in _by_leaf(some, mine):
            if len(rows) <= 16:  # leaves of a few series go together
                pairs.append((np.repeat(asking, len(rows)), np.tile(rows, len(asking))))
            else:
                rows = rows[_of_each(x[rows], ids[rows], k)]
                for at in range(0, len(rows), 4 * RUN):
                    best.take(x[rows[at : at + 4 * RUN]], ids[rows[at : at + 4 * RUN]], asking)
        i, j = (np.concatenate(p) for p in zip(*pairs, strict=True))
        for at in range(0, len(i), 1 << 16):
            i_, j_ = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
            best.offer(i_, ids[j_], _paired(best.q, i_, x, j_))
        return best.found(mine.column("query_id").to_numpy())

    return _top(_in_own(index, asked, run, FOUND, ["query_id", "leaf", "values"]), k)


def seeded(queries: DataFrame, index: Index, k: int = 1) -> tuple[DataFrame, DataFrame]:
    """Prepared queries with bsf (the k-th distance in their leaf, null if there are fewer), and the seeds."""
    seeds = written(approximate(queries, index, k), "seeds")
    bsf = seeds.filter(F.col("rank") == k).select("query_id", F.col("d2").alias("bsf"))
    return queries.join(bsf, "query_id", "left"), seeds


def exact(queries: DataFrame, index: Index, k: int = 1, radius: float | None = None, bsf: DataFrame | None = None, only: Column | None = None, seeds_first: bool = False) -> DataFrame:
    """Exact k nearest neighbours of queries (query_id, values): query_id, rank, series_id, d2.

    A query with a seed at distance 0 goes no further if k is 1: series at distance 0 are equal, so in the same leaf.
    seeds_first: seeds also where the blocks are few.

    bsf: distances known before (query_id, bsf) instead of a seed of our own; rows over them (but for rounding) are not returned.
    only: a filter of the index's entries (a batch, a range of roots). radius bounds leaves but not the seed.
    """
    n_asked = queries.count()
    if index.few and bsf is None and radius is None and not seeds_first:
        asked = summarise(queries, index.config, "query_id").withColumn("bsf", F.lit(None).cast("double"))
        found = None
    else:
        asked = written(prepared(queries, index), "asked")
        if bsf is None:
            asked, seeds = seeded(asked, index, k)
            found = seeds.select("query_id", "series_id", "d2") if only is None else None
            if found is not None and k == 1:
                asked = asked.filter("bsf is null or bsf > 0")
        else:
            asked, found = asked.join(bsf, "query_id", "left"), None
    asked = asked.withColumn("radius", F.lit(radius).cast("double"))
    asked = asked if index.few else written(asked.select(*ASKED), "asked")
    refined = _met(index, asked, n_asked, _refine(index.config, k, radius is not None), FOUND, only)
    if bsf is not None:
        refined = refined.join(bsf, "query_id", "left").filter("bsf is null or d2 <= bsf * (1 + 1e-9)").select("query_id", "series_id", "d2")
    return _top(refined.unionByName(found).distinct() if found is not None else refined, k)


def counts(queries: DataFrame, index: Index) -> DataFrame:
    """Of each query: bsf, leaves not pruned, record bounds computed, distances computed."""
    asked, _ = seeded(written(prepared(queries, index), "asked"), index, 1)
    return counts_given(asked, index)


def counts_given(asked: DataFrame, index: Index, only: Column | None = None) -> DataFrame:
    """As counts, of prepared queries with their bsf, over the entries that only lets in."""
    asked = written(asked.withColumn("radius", F.lit(None).cast("double")), "asked")
    each = _met(index, asked, asked.count(), _count(index.config), "query_id long, leaves long, bounds long, real long", only)
    each = each.groupBy("query_id").agg(*(F.sum(c).alias(c) for c in ("leaves", "bounds", "real")))
    return asked.select("query_id", "bsf").join(each, "query_id", "left").na.fill(0, ["leaves", "bounds", "real"])


def policy_counts(asked: DataFrame, index: Index, nodes: Sequence[int]) -> DataFrame:
    """nodes, own, shared: distances that so many nodes compute, which each hold every so-manieth root, for prepared queries with their bsf.

    Of shared seeds it is what counts() has, whoever holds a root; with own seeds, a node without a query's leaf computes all distances.
    So one pass counts for any number of nodes.
    """
    asked, config = written(asked.withColumn("radius", F.lit(None).cast("double")), "asked"), index.config

    def run(series: pa.Table, queries: pa.Table) -> pa.Table:
        own, shared = ([0] * len(nodes) for _ in range(2))
        if series.num_rows and queries.num_rows:
            tile = _Tile(config, series, queries)
            record, roots = tile.record_bounds(), queries.column("root").to_numpy()
            for at in range(0, len(roots), 256):
                going = _slack(tile.bounds(slice(at, at + 256))) <= tile.limit[at : at + 256, None]
                for i, mine in enumerate(going, at):
                    rows = np.flatnonzero(mine[tile.leaf])
                    rows = rows if np.isinf(tile.bsf[i]) else rows[_slack(record(i, rows)) <= tile.bsf[i]]
                    passed = tile.root[tile.leaf[rows]]
                    for k, n in enumerate(nodes):
                        shared[k] += len(rows)
                        own[k] += int(np.count_nonzero(passed % n == roots[i] % n))
        return pa.table({"nodes": pa.array(nodes, pa.int32()), "own": pa.array(own, pa.int64()), "shared": pa.array(shared, pa.int64())})

    met = _met(index, asked, asked.count(), run, "nodes int, own long, shared long", columns=[*ASKED, "root"]).groupBy("nodes").agg(F.sum("own").alias("own"), F.sum("shared").alias("shared"))
    n = F.explode(F.array(*map(F.lit, nodes))).alias("nodes")
    held, ask = index.spans.groupBy("root").agg(F.sum("n").alias("n")).select(n, "root", "n"), asked.groupBy("root").agg(F.count("*").alias("n")).select(n, "root", "n")
    held, ask = (df.groupBy("nodes", F.pmod("root", "nodes").alias(name)).agg(F.sum("n").alias(f"n_{name}")) for df, name in ((held, "held"), (ask, "asked")))  # a row for each node
    others = held.join(ask, "nodes").groupBy("nodes").agg(F.sum(F.when(F.col("held") != F.col("asked"), F.col("n_held") * F.col("n_asked")).otherwise(0)).alias("others"))
    return met.join(others, "nodes", "left").select("nodes", (F.col("own") + F.coalesce("others", F.lit(0))).alias("own"), "shared")


def candidates(queries: DataFrame, index: Index) -> DataFrame:
    """query_id, series_id of every series in a leaf that the seed distance doesn't rule out."""
    asked, _ = seeded(written(prepared(queries, index), "asked"), index, 1)
    asked = written(asked.withColumn("radius", F.lit(None).cast("double")), "asked")

    config = index.config

    def run(series: pa.Table, mine: pa.Table) -> pa.Table:
        found = [(np.zeros(0, np.int64), np.zeros(0, str))]
        if series.num_rows and mine.num_rows:
            tile = _Tile(config, series, mine)
            for at in range(0, len(tile.q_ids), 256):
                i, n = np.nonzero((_slack(tile.bounds(slice(at, at + 256))) <= tile.limit[at : at + 256, None]) & (tile.head > 0))
                found.append((tile.q_ids[at + i], tile.names[n]))
        ids, leaves = zip(*found, strict=True)
        return pa.table({"query_id": np.concatenate(ids), "leaf": pa.array(np.concatenate(leaves), pa.string())})

    visited = _met(index, asked, asked.count(), run, "query_id long, leaf string")
    chunk = F.floor(F.row_number().over(Window.partitionBy("leaf").orderBy("series_id")) / BLOCK_SERIES)
    members = index.entries.select("leaf", "series_id", chunk.alias("chunk")).groupBy("leaf", "chunk").agg(F.collect_list("series_id").alias("ids"))
    return visited.join(members.select("leaf", "ids"), "leaf").select("query_id", F.explode("ids").alias("series_id"))


def leaf_scan(queries: DataFrame, index: Index) -> DataFrame:
    """Scan of the own leaf with record bounds: query_id, d2 (smallest distance), bounds and real (distances computed).

    The record of the smallest bound gives a first distance; others are compared only if their bound is within it.
    """
    asked = written(queries.filter("leaf is not null").select("query_id", "leaf", F.col("values").alias("values"), "paa"), "asked")
    config = index.config

    def run(some: pa.Table, mine: pa.Table) -> pa.Table:
        out = {"query_id": [], "d2": [], "bounds": [], "real": []}
        if some.num_rows and mine.num_rows:
            x, sax, q = kernels.matrix(some.column("values"), config.length), kernels.matrix(some.column("sax"), config.segments, np.int64), kernels.matrix(mine.column("values"), config.length)
            means, q_ids, (low, high) = kernels.matrix(mine.column("paa"), config.segments), mine.column("query_id").to_numpy(), kernels.edges(config.bits)
            for rows, asking in ((rows, part) for rows, all_ in _by_leaf(some, mine) for part in np.array_split(all_, -(-len(all_) * len(rows) // CELLS))):
                lb = _slack(kernels.bounds(means[asking], low[sax[rows]], high[sax[rows]], config.scale))
                first = kernels.paired_distances(q[asking], x[rows[lb.argmin(axis=1)]])
                passes = lb <= first[:, None]
                i, j = np.nonzero(passes)
                best = first.copy()
                for s in range(0, len(i), 8192):
                    np.minimum.at(best, i[s : s + 8192], kernels.paired_distances(q[asking[i[s : s + 8192]]], x[rows[j[s : s + 8192]]]))
                out["query_id"].append(q_ids[asking])
                out["d2"].append(best)
                out["bounds"].append(np.full(len(asking), len(rows)))
                out["real"].append(passes.sum(axis=1))
        kinds = (pa.int64(), pa.float64(), pa.int64(), pa.int64())
        return pa.table({c: pa.array(np.concatenate(v) if v else [], t) for (c, v), t in zip(out.items(), kinds, strict=True)})

    each = _in_own(index, asked, run, "query_id long, d2 double, bounds long, real long", ["query_id", "leaf", "values", "paa"])
    return each.groupBy("query_id").agg(F.min("d2").alias("d2"), F.sum("bounds").alias("bounds"), F.sum("real").alias("real"))


def serial(queries: DataFrame, series: DataFrame, config: IndexConfig, k: int = 1) -> DataFrame:
    """Full scan: every distance. The measure of all other searches."""
    n_series, n_queries = (_n_groups(f.count(), config.length) for f in (series, queries))
    rows = series.select(F.pmod(F.xxhash64("series_id"), F.lit(n_series)).cast("int").alias("sg"), F.explode(F.sequence(F.lit(0), F.lit(n_queries - 1))).alias("qb"), "series_id", "values")
    asked = queries.select(_group_of(n_queries).alias("q_qb"), F.explode(F.sequence(F.lit(0), F.lit(n_series - 1))).alias("q_sg"), "query_id", F.col("values").alias("values"))

    def run(some: pa.Table, mine: pa.Table) -> pa.Table:
        if not some.num_rows or not mine.num_rows:
            return _Nearest(np.zeros((0, config.length)), k).found(np.zeros(0, np.int64))
        (mine, q), (some, x) = (kernels.usable(t, config.length) for t in (mine, some))
        best, ids = _Nearest(q, k), some.column("series_id").to_numpy()
        kept = _of_each(x, ids, k)
        for at in range(0, len(kept), 4 * RUN):
            best.take(x[kept[at : at + 4 * RUN]], ids[kept[at : at + 4 * RUN]])
        return best.found(mine.column("query_id").to_numpy())

    return _top(rows.groupBy("sg", "qb").cogroup(asked.groupBy("q_sg", "q_qb")).applyInArrow(run, FOUND), k)


def classify(neighbours: DataFrame, labels: DataFrame) -> DataFrame:
    """Most frequent label of each query's neighbours, the smallest of equals. labels (series_id, label)."""
    votes = neighbours.join(labels, "series_id").groupBy("query_id", "label").agg(F.count("*").alias("votes"))
    order = Window.partitionBy("query_id").orderBy(F.desc("votes"), "label")
    return votes.withColumn("r", F.row_number().over(order)).filter("r = 1").select("query_id", "label", "votes")


def leaf_bounds(queries: DataFrame, index: Index, most: int | None = None) -> DataFrame:
    """query_id, leaf, lb for every prepared query and leaf, in tiles; what pruning and ordered visits look at.

    most: of each tile only so many of a query's smallest, and their ties.
    """
    config = index.config
    n = max(1, -(-index.leaves.count() // BLOCK_SERIES))
    m = max(1, -(-queries.count() // BLOCK_QUERIES))
    leaves = index.leaves.select(F.pmod(F.xxhash64("leaf"), F.lit(n)).cast("int").alias("lb_block"), F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias("qb"), "leaf", "word", "kept")
    asked = queries.select(F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("q_block"), F.pmod(F.xxhash64("query_id"), F.lit(m)).cast("int").alias("q_qb"), "query_id", "paa")

    def run(some: pa.Table, mine: pa.Table) -> pa.Table:
        if not some.num_rows or not mine.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "leaf": pa.array([], pa.string()), "lb": pa.array([], pa.float64())})
        word, kept = (kernels.matrix(some.column(c), config.segments, np.int64) for c in ("word", "kept"))
        lb = kernels.bounds(kernels.matrix(mine.column("paa"), config.segments), *kernels.node_ranges(word, kept, config.bits), config.scale)
        names = some.column("leaf").to_numpy(zero_copy_only=False)
        q_ids = mine.column("query_id").to_numpy()
        if most is None or len(names) <= most:
            return pa.table({"query_id": np.repeat(q_ids, len(names)), "leaf": pa.array(np.tile(names, len(lb)), pa.string()), "lb": lb.ravel()})
        i, j = np.nonzero(lb <= np.partition(lb, most - 1, axis=1)[:, [most - 1]])
        return pa.table({"query_id": q_ids[i], "leaf": pa.array(names[j], pa.string()), "lb": lb[i, j]})

    return leaves.groupBy("lb_block", "qb").cogroup(asked.groupBy("q_block", "q_qb")).applyInArrow(run, "query_id long, leaf string, lb double")


def limited(queries: DataFrame, index: Index, limit: int, k: int = 1) -> DataFrame:
    """Best first with a limit: the seed's leaf and the limit leaves with the smallest bounds. Not exact by intent."""
    asked = written(prepared(queries, index), "asked")
    order = Window.partitionBy("query_id").orderBy("lb", "leaf")
    visited = leaf_bounds(asked, index, limit).withColumn("r", F.row_number().over(order)).filter(F.col("r") <= limit).select("query_id", "leaf")
    visited = visited.unionByName(asked.filter("leaf is not null").select("query_id", "leaf")).distinct()
    return approximate(asked.select("query_id", "values").join(visited, "query_id"), index, k)


def per_root(queries: DataFrame, index: Index) -> DataFrame:
    """The best distance in every root of a one-leaf-a-root index, and the root's and its records' least bound: query_id, leaf, lb, d2, tight."""
    nothing = (F.lit(None).cast("double").alias(c) for c in ("bsf", "radius"))
    asked, config = written(summarise(queries, index.config, "query_id").select("query_id", "values", "paa", *nothing), "asked"), index.config

    def run(series: pa.Table, mine: pa.Table) -> pa.Table:
        names, columns = ("query_id", "leaf", "lb", "d2", "tight"), []
        if series.num_rows and mine.num_rows:
            tile = _Tile(config, series, mine)
            record, tight = tile.record_bounds(), np.empty((len(tile.q), len(tile.names)))
            for i in range(len(tile.q)):
                tight[i] = np.minimum.reduceat(record(i, slice(None)), tile.starts[:-1])
            best = _Nearest(tile.q, 1)
            for n, name in enumerate(tile.names):
                best.d[:], best.ids[:] = np.inf, np.iinfo(np.int64).max
                for at in range(tile.starts[n], tile.starts[n + 1], 4 * RUN):
                    part = slice(at, min(at + 4 * RUN, tile.starts[n + 1]))
                    best.take(tile.x[part], tile.ids[part])
                lb = _bounds(config, tile.means, *kernels.node_ranges(tile.word[[n]], tile.kept[[n]], config.bits))[:, 0]
                columns.append((tile.q_ids, np.full(len(lb), name), lb, best.d[:, 0].copy(), tight[:, n]))
        kinds = (pa.int64(), pa.string(), pa.float64(), pa.float64(), pa.float64())
        return pa.table({c: pa.chunked_array([pa.array(v[k], t) for v in columns], t) for k, (c, t) in enumerate(zip(names, kinds, strict=True))})

    each = _met(index, asked, asked.count(), run, "query_id long, leaf string, lb double, d2 double, tight double")
    return each.groupBy("query_id", "leaf").agg(*(F.min(c).alias(c) for c in ("lb", "d2", "tight")))


def self_distances(queries: DataFrame, length: int) -> DataFrame:
    """Nearest, farthest and mean distance of each query to the others, from the matrix of all distances in tiles."""
    n = _n_groups(queries.count(), length)
    block = _group_of(n)
    rows = queries.select(block.alias("a"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("b"), "query_id", "values")
    others = queries.select(F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("o_a"), block.alias("o_b"), F.col("query_id").alias("other"), F.col("values").alias("values"))

    def run(mine: pa.Table, rest: pa.Table) -> pa.Table:
        if not mine.num_rows or not rest.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), **{c: pa.array([], pa.float64()) for c in ("low", "high", "sum")}, "n": pa.array([], pa.int64())})
        q, x, own, ids = kernels.matrix(mine.column("values"), length), kernels.matrix(rest.column("values"), length), mine.column("query_id").to_numpy(), rest.column("other").to_numpy()
        q_norm, x_norm = _norms(q), _norms(x)
        low, high = np.full(len(q), np.inf), np.full(len(q), -np.inf)
        place = np.argsort(ids, kind="stable")
        a, b = np.searchsorted(ids[place], own), np.searchsorted(ids[place], own, "right")  # a query's own rows here
        for at in range(0, len(q), TOGETHER):
            some = slice(at, at + TOGETHER)
            for r in range(0, len(x), 4 * RUN):
                part = slice(r, r + 4 * RUN)
                near = q_norm[some, None] + x_norm[part] - 2 * (q[some] @ x[part].T)
                same = own[some, None] == ids[None, part] if (b > a)[some].any() else np.zeros((1, 1), bool)
                slack = (16 * (length + 4) * np.finfo(np.float64).eps * (q_norm[some] + x_norm[part].max()))[:, None]
                for sign, best, fold in ((1, low, np.minimum), (-1, high, np.maximum)):
                    here = np.where(same, sign * np.inf, near) if same.any() else near
                    edge = fold.reduce(here, axis=1, keepdims=True)
                    edge = sign * np.minimum(sign * edge, sign * best[some, None])
                    i, j = _places((sign * here <= sign * edge + slack) & np.isfinite(here))
                    fold.at(best, at + i, _paired(q, at + i, x, r + j))
        mean = x.mean(axis=0)
        spread = _norms(x - mean).sum()
        total, n_own = len(x) * _norms(q - mean) + spread, b - a  # the sum of all distances from that of squares about the mean
        for i in np.flatnonzero(n_own):
            total[i] -= _norms(q[i] - x[place[a[i] : b[i]]]).sum()
        return pa.table({"query_id": mine.column("query_id"), "low": low, "high": high, "sum": total, "n": len(x) - n_own})

    each = rows.groupBy("a", "b").cogroup(others.groupBy("o_a", "o_b")).applyInArrow(run, "query_id long, low double, high double, sum double, n long")
    out = each.groupBy("query_id").agg(F.min("low").alias("nearest"), F.max("high").alias("farthest"), (F.sum("sum") / F.sum("n")).alias("mean"), F.sum("n").alias("n"))
    return out.filter("n > 0").drop("n")
