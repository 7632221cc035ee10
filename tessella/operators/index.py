"""The index: summaries of series, routed by root mask, in leaves that split where they are too full, stored in blocks.

Building takes a handful of jobs. Series are summarised and counted by root; roots go together into packs that a task
holds, and one grouped pass builds the subtrees of a pack: a node that is too full splits by the segment whose symbols
vary most and that has bits to give. Only nodes of more series than a task holds, such as a root with a third of all,
are first split level by level, by aggregations with partial sums. Tree shape affects speed only.

A pass also orders a pack's series by leaf and cuts them into blocks of at most BLOCK_SERIES, whole leaves where they
fit. Blocks are dealt to at most PARTS folders, so a search reads the folders that its queries visit. An index stays
where it was built and is opened again by load().

Series that are null, or hold null, infinite or undefined values, such as constant ones after normalisation, are not
indexed; rejected() lists them. Queries of that kind have no answers. Another length is an error.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import isax_word, kernels
from ..plans.config import IndexConfig
from ..plans.storage import get_text, new_path, put_text, written

#: Series of a block; bytes of a pack's series; leading bits of a root that are counted on the driver; folders.
BLOCK_SERIES, PACK_BYTES, COARSE, PARTS = 4096, 1 << 26, 16, 1024
FEW = 4
ENTRY = "series_id long, values array<double>, paa array<double>, sax array<int>, root long, leaf string, kept array<int>, head boolean, block string, part int"


@dataclass(frozen=True)
class Index:
    """entries: as in ENTRY (head: in its leaf's first block). spans: leaf, block, part, root, word, kept, n (series of a leaf in a block).

    few: the blocks, if these are at most FEW, so that a search may visit all. path: where it is stored.
    """

    config: IndexConfig
    entries: DataFrame
    spans: DataFrame
    n_series: int
    few: tuple[str, ...]
    path: str

    @property
    def leaves(self) -> DataFrame:
        """leaf, root, word, kept, n."""
        return self.spans.groupBy("leaf").agg(*(F.first(c).alias(c) for c in ("root", "word", "kept")), F.sum("n").alias("n"))

    @property
    def splits(self) -> DataFrame:
        """node, segment, n, depth of every inner node; a leaf's name tells the splits above it."""
        steps = F.split("leaf", r"\.")
        above = F.transform(F.sequence(F.lit(1), F.size(steps) - 1, F.lit(2)), lambda k: F.struct(F.array_join(F.slice(steps, 1, k), ".").alias("node"), steps[k].cast("int").alias("segment"), ((k + 1) / 2).cast("int").alias("depth")))
        inner = self.leaves.filter(F.size(steps) > 1).select("n", F.explode(above).alias("at"))
        return inner.groupBy("at").agg(F.sum("n").alias("n")).select("at.node", "at.segment", "n", "at.depth")


def rejected(series: DataFrame, key: str = "series_id") -> DataFrame:
    """Ids of series that an index leaves out."""
    odd = F.col("values").isNull() | F.exists("values", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return series.filter(odd).select(key)


def summarise(series: DataFrame, config: IndexConfig, key: str = "series_id") -> DataFrame:
    """Adds paa, sax and root. Series of another length are rejected by an error, never cut; those of rejected() go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = 1 << np.arange(config.segments - 1, -1, -1)
        for batch in batches:
            batch, values = kernels.usable(batch, config.length)
            means = kernels.paa(values, config.segments)
            symbols = kernels.sax(means, config.bits)
            root = ((symbols >> (config.bits - 1)) * weights).sum(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), kernels.lists(means), kernels.lists(symbols), pa.array(root.astype(np.int64))], [key, "values", "paa", "sax", "root"])

    return series.select(key, "values").mapInArrow(run, f"{key} long, values array<double>, paa array<double>, sax array<int>, root long")


def _subtrees(config: IndexConfig, split: bool, size: int):
    """A pack (pack, part, node, kept and a summary's columns): each row with its leaf and block, in the order of leaves."""

    def leaves_of(node: str, kept: np.ndarray, rows: np.ndarray, sax: np.ndarray) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
        open_ = [(node, kept, rows)]
        while open_:
            node, kept, rows = open_.pop()
            if split and len(rows) > config.leaf_size:
                spread = np.where(kept < config.bits, sax[rows].var(axis=0), 0.0)
                at = int(spread.argmax())
                if spread[at] > 0:
                    bit = (sax[rows, at] >> (config.bits - 1 - kept[at])) & 1
                    more = kept + (np.arange(len(kept)) == at)
                    open_ += [(f"{node}.{at}.{k}", more, rows[bit == k]) for k in (1, 0) if (bit == k).any()]
                    continue
            yield node, kept, rows

    def run(table: pa.Table) -> pa.Table:
        sax, kept = (kernels.matrix(table.column(c), config.segments, np.int64) for c in ("sax", "kept"))
        nodes = table.column("node").to_numpy(zero_copy_only=False).astype(str)
        names, first, of = np.unique(nodes, return_index=True, return_inverse=True)
        by_node = np.argsort(of, kind="stable")
        places = np.split(by_node, np.searchsorted(of[by_node], np.arange(1, len(names))))
        leaves, keeps, order, blocks, heads = [], [], [], [], []
        block, room = 0, size
        rank = sorted(range(len(names)), key=lambda k: (gray_decode_int(int(names[k].split(".")[0])), names[k]))
        for k in rank:
            for leaf, own, rows in leaves_of(str(names[k]), kept[first[k]], places[k], sax):
                if len(rows) > room:  # whole leaves where they fit; else the leaf begins a block
                    block, room = block + (room < size), size
                at = block + np.arange(len(rows)) // size
                block, room = int(at[-1]), room - len(rows) if len(rows) <= room else size - int((at == at[-1]).sum())
                if not room:
                    block, room = block + 1, size
                leaves += [leaf] * len(rows)
                keeps.append(np.tile(own, (len(rows), 1)))
                order.append(rows)
                blocks.append(at)
                heads.append(at == at[0])
        sorted_ = table.take(pa.array(np.concatenate(order)))
        pack = table.column("pack")[0].as_py()
        columns = {c: sorted_.column(c) for c in ("series_id", "values", "paa", "sax", "root")}
        columns |= {"leaf": pa.array(leaves), "kept": kernels.lists(np.concatenate(keeps).astype(np.int32)), "head": pa.array(np.concatenate(heads)), "block": pa.array([f"{pack}#{b}" for b in np.concatenate(blocks).tolist()]), "part": sorted_.column("part")}
        return pa.table(columns)

    return run


def gray_decode_int(code: int) -> int:
    """The place of a root in the order in which neighbours differ by one bit."""
    out = 0
    while code:
        out ^= code
        code >>= 1
    return out


def _widest(kept: Column, config: IndexConfig) -> Column:
    """The segment to split by: the largest variance of those with bits left; null if none."""
    spread = F.array(*(F.when((F.col(f"v{i}") > 0) & (kept[i] < config.bits), F.col(f"v{i}")).otherwise(-1.0) for i in range(config.segments)))
    return F.when(F.array_max(spread) > 0, F.array_position(spread, F.array_max(spread)).cast("int") - 1)


def _opened(rows: DataFrame, config: IndexConfig, most: int, split: bool) -> tuple[DataFrame, DataFrame]:
    """Rows (node, kept, ...) of nodes that a task can't hold, split level by level: those it can hold, and those that can't be split."""
    done = stuck = None
    add = lambda a, b: b if a is None else a.unionByName(b)
    while True:
        variances = [F.var_pop(F.col("sax")[i]).alias(f"v{i}") for i in range(config.segments)]
        full = rows.groupBy("node").agg(F.count("*").alias("n"), F.first("kept").alias("kept"), *variances).filter(F.col("n") > most)
        full = written(full.select("node", "n", (_widest(F.col("kept"), config) if split else F.lit(None).cast("int")).alias("segment")), "full")
        done = add(done, rows.join(full, "node", "left_anti"))
        if full.isEmpty():
            return done, rows.limit(0).withColumn("n", F.lit(0).cast("long")) if stuck is None else stuck
        stuck = add(stuck, rows.join(full.filter("segment is null").select("node", "n"), "node"))
        at, kept = F.col("segment"), F.col("kept")
        symbol, given = F.element_at("sax", at + 1), F.element_at(kept, at + 1)
        bit = F.floor(symbol / F.pow(F.lit(2.0), config.bits - 1 - given)).cast("int") % 2
        more = F.transform(kept, lambda k, i: k + (i == at).cast("int"))
        rows = written(rows.join(full.filter("segment is not null").select("node", "segment"), "node").withColumns({"node": F.concat_ws(".", "node", at, bit), "kept": more}).drop("segment"), "open")


def build(series: DataFrame, config: IndexConfig, split: bool = True, to: str | None = None, pack_bytes: int = PACK_BYTES, block: int = BLOCK_SERIES) -> Index:
    """series (series_id, values). split=False leaves one leaf a root. to: a folder for the index; else one of the shared folder's. block: series of a block at most."""
    spark = series.sparkSession
    to = to or new_path(spark, "index")
    summaries = written(summarise(series, config), "summaries")
    coarse = F.shiftright("root", max(0, config.segments - COARSE))
    counts = {r.c: r.n for r in summaries.groupBy(coarse.alias("c")).agg(F.count("*").alias("n")).collect()}  # 2^COARSE at most
    most, n_series = max(block, pack_bytes // (8 * (config.length + 2 * config.segments))), sum(counts.values())
    pack_of, pack, held = {}, 0, 0
    for c in sorted((c for c in counts if counts[c] <= most), key=gray_decode_int):
        if held + counts[c] > most:
            pack, held = pack + 1, 0
        pack_of[c], held = pack, held + counts[c]
    parts = min(PARTS, max(1, -(-n_series // most)))
    ones = F.array(*([F.lit(1)] * config.segments))
    rows = summaries.withColumns({"node": F.col("root").cast("string"), "kept": ones})
    if len(pack_of) == len(counts) and not pack:
        packed = rows.withColumn("pack", F.lit("p0"))
        stuck = None
    else:
        table = spark.createDataFrame([(c, f"p{p}") for c, p in pack_of.items()], "c long, pack string")
        packed = rows.withColumn("c", coarse).join(F.broadcast(table), "c").drop("c")
        hot = [c for c in counts if c not in pack_of]
        if hot:
            hot = spark.createDataFrame([(c,) for c in hot], "c long")
            big, stuck = _opened(rows.withColumn("c", coarse).join(F.broadcast(hot), "c").drop("c"), config, most, split)
            packed = packed.unionByName(big.withColumn("pack", F.col("node")))
        else:
            stuck = None
    part = F.pmod(F.xxhash64("pack"), F.lit(parts)).cast("int")
    entries = packed.withColumn("part", part).groupBy("pack").applyInArrow(_subtrees(config, split, block), ENTRY)
    if stuck is not None:
        chunk = F.pmod(F.xxhash64("series_id"), F.ceil(F.col("n") / F.lit(block)))
        stuck = stuck.withColumns({"leaf": F.col("node"), "pack": F.concat_ws("#", "node", chunk)})
        entries = entries.unionByName(stuck.withColumns({"head": chunk == 0, "block": F.col("pack"), "part": part}).select(*entries.columns))
    entries.write.partitionBy("part").parquet(f"{to}/entries") if parts > 1 else entries.write.parquet(f"{to}/entries")
    entries = spark.read.schema(ENTRY).parquet(f"{to}/entries")
    spans = entries.groupBy("leaf", "block").agg(*(F.first(c).alias(c) for c in ("part", "root", "kept", "sax")), F.count("*").alias("n"))
    spans.select("leaf", "block", "part", "root", isax_word(F.col("sax"), F.col("kept"), config.bits).alias("word"), "kept", "n").write.parquet(f"{to}/spans")
    blocks = [r.block for r in spark.read.schema(SPAN).parquet(f"{to}/spans").select("block").distinct().limit(FEW + 1).collect()]
    about = asdict(config) | {"n_series": n_series, "few": blocks if len(blocks) <= FEW else []}
    put_text(spark, f"{to}/about.json", json.dumps(about))
    return _index(spark, to, about)


SPAN = "leaf string, block string, part int, root long, word array<int>, kept array<int>, n long"


def _index(spark: SparkSession, path: str, about: dict) -> Index:
    config = IndexConfig(*(about[k] for k in ("length", "segments", "bits", "leaf_size")))
    return Index(config, spark.read.schema(ENTRY).parquet(f"{path}/entries"), spark.read.schema(SPAN).parquet(f"{path}/spans"), about["n_series"], tuple(about["few"]), path)


def load(spark: SparkSession, path: str) -> Index:
    """An index that build() has stored in a folder."""
    return _index(spark, path, json.loads(get_text(spark, f"{path}/about.json")))


def leaf_of(queries: DataFrame, index: Index) -> DataFrame:
    """Queries (with sax, root) and the leaf that each would be put in; null where no series is there."""
    leaves = index.leaves.select(F.col("root").alias("l_root"), "leaf", "word", F.col("kept").alias("l_kept"), F.col("n").alias("leaf_n"))
    fits = isax_word(F.col("sax"), F.col("l_kept"), index.config.bits) == F.col("word")
    return queries.join(leaves, (F.col("root") == F.col("l_root")) & fits, "left").drop("l_root", "l_kept", "word")


def validity(index: Index, series: DataFrame) -> DataFrame:
    """Series given, series in leaves, leaves, and series in the fullest leaf."""
    tree = index.leaves.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_in_leaves"), F.count("*").alias("n_leaves"), F.coalesce(F.max("n"), F.lit(0)).alias("fullest"))
    return series.agg(F.count("*").alias("n_series")).crossJoin(tree)  # one row each


def statistics(index: Index) -> DataFrame:
    """Of each root: series, leaves, splits, height and mean depth of leaves."""
    depth = F.size(F.split("leaf", r"\.")) / 2
    leaves = index.leaves.withColumn("depth", F.floor(depth))
    by_root = leaves.groupBy("root").agg(F.sum("n").alias("n_series"), F.count("*").alias("n_leaves"), F.max("depth").alias("height"), F.avg("depth").alias("mean_depth"))
    splits = index.splits.groupBy(F.split("node", r"\.")[0].cast("long").alias("root")).agg(F.count("*").alias("n_splits"))
    return by_root.join(splits, "root", "left").select("root", "n_series", "n_leaves", F.coalesce("n_splits", F.lit(0)).alias("n_splits"), "height", "mean_depth")


def dot_edges(index: Index) -> DataFrame:
    """Graphviz lines: an edge from each node to each child that holds series."""
    nodes = index.leaves.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("leaf", r"\.")), F.lit(2)), lambda k: F.array_join(F.slice(F.split("leaf", r"\."), 1, k), "."))).alias("node")).distinct()
    parent = F.array_join(F.slice(F.split("node", r"\."), 1, F.size(F.split("node", r"\.")) - 2), ".")
    inner = nodes.filter(F.size(F.split("node", r"\.")) > 1)
    return inner.select(F.concat(F.lit('"'), parent, F.lit('" -> "'), "node", F.lit('";')).alias("line"))
