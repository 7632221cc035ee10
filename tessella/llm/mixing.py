"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions.

Only DataFrame functions. Sources in code-point order (null last) weigh 5, 2, 1, repeating. A source's target
stops at max_epochs times its size; what is over goes to the others by weight. The fixed point has a closed
form: with sources in order of cap / weight, the first k are capped where the level (total - caps of the first
k) / (weights of the rest) doesn't pass the next one's cap / weight. A target of r times the size takes every
document floor(r) times, and of the fraction as many words as are missing: documents in order of a seeded hash,
whole until the words are reached; the document at the border gives its share of words. So a source's taken
words miss its target by under one word, however uneven its documents are.

Rules: null and wordless texts have size 0 and are taken 0 times; a null source is a source of its own; rows
that repeat an id count on their own, and tie in the order of the hash by size (equal rows share the border).
An empty table gives an empty result. Other columns are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, named, written

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
#: Hash ranges of a source; only the range at the border needs an order.
RANGES = 4096


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, share: float = 1.5, max_epochs: float = 2.0, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """sources (source, source_size): adds weight and target. One row a source, so the windows are small."""
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    everything = Window.partitionBy()
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    df = sources.withColumn("weight", w.cast("double")).withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    from_here = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    total = F.sum("source_size").over(everything) * F.lit(float(share))
    df = df.withColumn("level", (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(from_here))
    # Uncapped from the first source whose cap isn't below the level that it and the later ones would share.
    fits = F.when(F.col("cap") / F.col("weight") >= F.col("level"), F.col("level"))
    df = df.withColumn("level", F.first(fits, ignorenulls=True).over(by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    target = F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("level") * F.col("weight")))
    return df.select("source", "source_size", "weight", target.alias("target"))


def mix(docs: DataFrame, seed: int = 17, share: float = 1.5, max_epochs: float = 2.0, ranges: int = RANGES, key: str | None = None) -> DataFrame:
    """docs (doc_id, text, source): returns doc_id, source, size, source_size, target, repeats, part, taken.

    repeats: times that the document is taken whole; part: words taken once more from it, under its size.
    key: a column to return as __key; rows that tie otherwise are then told apart by their texts.
    """
    own = [] if key is None else ["__key", "__tie"]
    more = [] if key is None else [*(c.alias("__key") for c in named([key])), F.xxhash64("text").alias("__tie")]
    drawn = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    sized = written(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), drawn.alias("hash"), *more), "mix-sizes")
    sized = sized.withColumn("range", F.floor(F.conv(F.substring("hash", 1, 8), 16, 10).cast("double") * ranges / 2.0**32).cast("int"))
    ranged = sized.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    ranged = written(ranged, "mix-ranges")
    filled = targets(ranged.groupBy("source").agg(F.sum("range_size").alias("source_size")), share, max_epochs)
    ratio = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    filled = filled.withColumn("repeats", ratio.cast("long")).withColumn("missing", F.round(F.col("target") - F.col("repeats") * F.col("source_size")).cast("long"))
    in_order = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranged = ranged.withColumn("ranges_before", F.coalesce(F.sum("range_size").over(in_order), F.lit(0)))
    plan = ranged.alias("r").join(filled.alias("f"), F.col("r.source").eqNullSafe(F.col("f.source"))).select("r.source", "range", "range_size", "ranges_before", "source_size", "target", "repeats", "missing")
    left = F.col("missing") - F.col("ranges_before")
    plan = plan.withColumn("border", (left > 0) & (left < F.col("range_size"))).withColumn("whole", left >= F.col("range_size"))
    joined = sized.alias("d").join(plan.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source")) & (F.col("d.range") == F.col("p.range")))
    joined = joined.select("d.doc_id", "d.source", "size", "hash", "d.range", "source_size", "target", "repeats", "border", "whole", left.alias("left"), *own)
    border = Window.partitionBy("source", "range").orderBy("hash", "size", "doc_id", *own[1:]).rowsBetween(Window.unboundedPreceding, -1)
    inside = joined.filter("border").withColumn("part", F.greatest(F.lit(0), F.least(F.col("size"), F.col("left") - F.coalesce(F.sum("size").over(border), F.lit(0)))))
    outside = joined.filter("not border").withColumn("part", F.when(F.col("whole"), F.col("size")).otherwise(0))
    both = inside.unionByName(outside)
    full = (F.col("part") == F.col("size")) & (F.col("size") > 0)
    both = both.withColumn("repeats", F.when(F.col("size") == 0, 0).otherwise(F.col("repeats") + full.cast("long"))).withColumn("part", F.when(full, 0).otherwise(F.col("part")).cast("long"))
    return both.select("doc_id", "source", "size", "source_size", "target", "repeats", "part", (F.col("repeats") * F.col("size") + F.col("part")).alias("taken"), *own[:1])


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The rows of the mix: each document as often as it is taken; a part of half or more of its words counts as a whole.

    Rows are numbered in a written copy and matched to their repeats by number, so rows that repeat an id, or have none,
    count on their own.
    """
    number, key, times, copy = (fresh(docs.columns, c) for c in ("__row", "__key", "__times", "__copy"))
    rows = written(docs.withColumn(number, F.monotonically_increasing_id()), "mix-rows")
    repeats = F.col("repeats") + (2 * F.col("part") >= F.greatest(F.col("size"), F.lit(1))).cast("long")
    plan = mix(rows, key=number, **options).select(F.col("__key").alias(key), repeats.cast("int").alias(times)).filter(F.col(times) > 0)
    out = rows.join(plan, F.col(number) == F.col(key))
    return out.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*named(docs.columns))
