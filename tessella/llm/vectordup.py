"""Embedding near-duplicates: tiled comparison of PCA-ordered vectors with suffix-norm bounds.

Unit vectors are rotated to the principal axes of a bounded sample (SAMPLE rows, lowest id hash first; any
rotation keeps cosines, so the sample only affects speed). A tile compares two blocks of one label: products over
the leading axes come first; by Cauchy-Schwarz the rest adds at most the product of the suffix norms, and a pair
stops when that can't reach the threshold. Pairs that stay are decided by the cosine of the vectors as given.

Equal vectors of a label form one class first, named by its smallest vec_id and a hash of label and vector, since ids
may repeat; classes are compared, and a class of m counts m links. A tile returns a row per class that has a link: how
many vectors it links to there, and the tile's smallest class that it reaches; never pairs. Components come from those
rows.

Rules: null labels, null or zero vectors and vectors with null or non-finite components link with nothing; so do
vectors of different lengths. Equal rows link with each other; rows that repeat an id are rows of their own in
n_links. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .components import components
from .topk import finite

#: Vectors that the axes come from; components in a block of vectors.
SAMPLE, BLOCK = 2048, 1 << 18
STEPS = (8, 16, 32)


def principal_axes(vectors: DataFrame, sample: int = SAMPLE) -> dict[int, np.ndarray]:
    """For each length in a sample of at most so many unit vectors: an orthogonal matrix, columns by falling variance."""
    rows = vectors.orderBy(F.xxhash64("vec_id")).limit(sample).select("embedding").collect()
    by: dict[int, list] = {}
    for (v,) in rows:
        by.setdefault(len(v), []).append(v)
    out = {}
    for dim, vs in by.items():
        x = np.array(vs, np.float64)
        x /= np.abs(x).max(axis=1, keepdims=True)
        x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
        out[dim] = np.linalg.eigh(x.T @ x)[1][:, ::-1]
    return out


def _pairs(a: np.ndarray, b: np.ndarray, ra: np.ndarray, rb: np.ndarray, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Indices of linked rows of a and b; ra, rb: their unit forms on principal axes."""
    dim = a.shape[1]
    cuts = [s for s in STEPS if s < dim] + [dim]
    rest = lambda r, s: np.sqrt((r[:, s:] ** 2).sum(axis=1))
    suffix = [(rest(ra, s), rest(rb, s)) for s in cuts]
    norm_a, norm_b = np.sqrt((a * a).sum(axis=1)), np.sqrt((b * b).sum(axis=1))
    low = threshold - 1e-9
    found = []
    for at in range(0, len(a), 256):
        strip = slice(at, min(at + 256, len(a)))
        first = ra[strip, : cuts[0]] @ rb[:, : cuts[0]].T
        ok = first + np.outer(suffix[0][0][strip], suffix[0][1]) >= low
        i, j = np.nonzero(ok)
        dot = first[i, j]
        i += at
        if same:
            i, j, dot = (x[i < j] for x in (i, j, dot))
        for (s, e), (sa, sb) in zip(zip(cuts, cuts[1:], strict=False), suffix[1:], strict=True):
            dot = dot + np.einsum("ij,ij->i", ra[i, s:e], rb[j, s:e])
            ok = dot + sa[i] * sb[j] >= low
            i, j, dot = i[ok], j[ok], dot[ok]
        cosine = np.einsum("ij,ij->i", a[i], b[j]) / (norm_a[i] * norm_b[j])
        found.append((i[cosine >= threshold], j[cosine >= threshold]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest index that each of n nodes reaches."""
    root = np.arange(n)
    while True:
        m = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, m)
        np.minimum.at(new, j, m)
        new = np.minimum(new, new[new])
        if (new == root).all():
            return root
        root = new


def _tile(axes: dict[int, np.ndarray], threshold: float):
    def run(table: pa.Table) -> pa.Table:
        ids, marks = table.column("vec_id").to_numpy(), table.column("mark").to_numpy()
        order = np.lexsort((marks, ids))
        lists = table.column("embedding").combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        x = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), -1)[order]
        ids, marks, left = ids[order], marks[order], table.column("block").to_numpy()[order] == table.column("low").to_numpy()[order]
        copies, same = table.column("copies").to_numpy()[order], bool(left.all())
        scaled = x / np.abs(x).max(axis=1, keepdims=True)  # neither squares nor sums overflow
        unit = scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))
        r = unit @ axes[x.shape[1]] if x.shape[1] in axes else unit
        if same:
            i, j = _pairs(scaled, scaled, r, r, threshold, True)
        else:
            at_a, at_b = np.flatnonzero(left), np.flatnonzero(~left)
            i, j = _pairs(scaled[at_a], scaled[at_b], r[at_a], r[at_b], threshold, False) if len(at_a) and len(at_b) else (at_a[:0], at_a[:0])
            i, j = at_a[i], at_b[j]
        links = np.bincount(i, copies[j], len(ids)) + np.bincount(j, copies[i], len(ids))
        root, has = _roots(len(ids), i, j), links > 0
        return pa.table({"vec_id": ids[has], "mark": marks[has], "links": links[has].astype(np.int64), "root": ids[root[has]], "root_mark": marks[root[has]]})

    return run


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, block: int | None = None) -> DataFrame:
    """vectors (vec_id, embedding, label): returns vec_id, n_links, component_id, kept for each row. block: vectors in a block."""
    vectors = vectors.select("vec_id", "embedding", "label")
    able = finite("embedding") & F.exists("embedding", lambda v: v != 0) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    classes = vectors.filter(able).groupBy("label", "embedding").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies"))
    classes = written(classes.withColumn("mark", F.xxhash64("label", "embedding")), "vector-classes")
    axes = principal_axes(classes)
    most = F.lit(block) if block else F.greatest(F.lit(256), F.floor(F.lit(BLOCK) / F.greatest(F.lit(1), "dim")))
    counts = classes.groupBy("label", F.size("embedding").alias("dim")).agg(F.count("*").alias("n")).select("label", "dim", F.ceil(F.col("n") / most).cast("int").alias("blocks"))
    blocks = classes.withColumn("dim", F.size("embedding")).join(counts, ["label", "dim"])
    blocks = blocks.withColumn("block", F.pmod(F.xxhash64("vec_id", "mark"), F.col("blocks")).cast("int"))
    tiles = blocks.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tiles = tiles.select("vec_id", "mark", "embedding", "copies", "label", "dim", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    found = tiles.groupBy("label", "dim", "low", "high").applyInArrow(_tile(axes, threshold), "vec_id long, mark long, links long, root long, root_mark long")
    found = written(found, "vector-links")
    node = F.struct("vec_id", "mark")  # in the order of ids
    reach = components(found.select(node.alias("a"), F.struct(F.col("root").alias("vec_id"), F.col("root_mark").alias("mark")).alias("b")))
    reach = reach.select("node.vec_id", "node.mark", F.col("component.vec_id").alias("component"))
    links = found.groupBy("vec_id", "mark").agg(F.sum("links").alias("links"))
    told = classes.join(links, ["vec_id", "mark"], "left").join(reach, ["vec_id", "mark"], "left")
    told = told.select("label", "embedding", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    out = vectors.join(told, ["label", "embedding"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
