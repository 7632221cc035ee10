"""Quality classifier: hashed word n-grams, logistic regression by FTRL updates, scores as sparse dot products.

Words are runs of letters and digits, or runs of other characters, A-Z lower-cased; features are hashes of single
words and of runs of two and three words, from the whole text. A text's value for a feature is its count over
the root of SHRINK plus the sum of all squared counts: about unit length, and less for short texts, which stay near
the bias.

Training takes a bounded sample of labelled rows: at most SAMPLE / 2 ids of each label, lowest hash of the id first,
and of these as many as have SAMPLE_BYTES / 2 of features; it is learnt from in one task and never goes to the
driver. Examples weigh what their label's share in the sample lacks of its share in the labels. Everything else
covers all rows.

Rules: null, empty and wordless texts have no features and score by the bias. Rows with a null id are scored, not
learnt from. An id with several labels counts with its lowest, one of several rows with its least text. With labels
of one kind or none the model is empty and scores come from the bias alone. Repeated rows get equal scores; other
columns are never read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import remove, slices, text_bytes, tidy, written
from .ftrl import Ftrl, sigmoid
from .textkernel import Words, ngrams

BITS, SAMPLE, SAMPLE_BYTES, LONGEST, SHRINK = 20, 6000, 1 << 27, 3, 100.0
#: White space 0, letters, digits and bytes over 127 are 1, the rest 2.
CLASSES = np.full(256, 2, np.uint8)
CLASSES[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1
CLASSES[[0x20, *range(0x09, 0x0E)]] = 0


def hashed_ngrams(data: np.ndarray, offsets: np.ndarray, bits: int = BITS, longest: int = LONGEST) -> tuple[np.ndarray, np.ndarray]:
    """Feature indices of all n-grams, ordered by text, and where each text begins."""
    words = Words(data, offsets, CLASSES)
    hashes = words.hashes()
    parts = [ngrams(hashes, words.first, n) for n in range(1, longest + 1)]
    grams, texts = zip(*parts, strict=True)
    index, texts = (np.concatenate(grams) >> np.uint64(64 - bits)).astype(np.int64), np.concatenate(texts)
    order = np.argsort(texts, kind="stable")
    return index[order], np.searchsorted(texts[order], np.arange(len(offsets)))


def labels_of(labels: DataFrame, column: str, kind: str) -> DataFrame:
    """doc_id, label: one row an id (kind: min or max of its labels)."""
    return labels.filter(F.col("doc_id").isNotNull() & F.col(column).isin(0, 1)).groupBy("doc_id").agg(getattr(F, kind)(column).cast("int").alias("label"))


def sampled_labels(labels: DataFrame, column: str, kind: str, most: int) -> DataFrame:
    """At most most / 2 labelled ids of each of two labels, lowest hash first."""
    one = labels_of(labels, column, kind)
    part = lambda v: one.filter(F.col("label") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most // 2)
    return part(0).unionByName(part(1))


def bounded_sample(docs: DataFrame, chosen: DataFrame, featured, schema: str, most_bytes: int) -> DataFrame:
    """Rows (doc_id, label, ..., features) of the chosen ids (doc_id, label, ...), one an id, whatever its rows are; written.

    Of each label as many, lowest hash of the id first, as stay within half of most_bytes at 4 bytes a feature. The table that it reads is
    its sample_table, to be removed after the last use.
    """
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy(*chosen.columns).agg(F.min("text").alias("text"))
    rows = written(rows.mapInArrow(featured, schema), "sample")
    order = Window.partitionBy("label").orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    within = rows.select("doc_id", "label", (4 * F.size("features")).cast("long").alias("bytes")).withColumn("bytes", F.sum("bytes").over(order))
    out = rows.join(F.broadcast(within.filter(F.col("bytes") <= most_bytes // 2).select("doc_id")), "doc_id")
    out.sample_table = rows
    return out


class Each:
    """A sequence whose items are made when they are asked for: the training rows are held once, as whole numbers."""

    def __init__(self, rows: Sequence, make: Callable[[object], np.ndarray]):
        self.rows, self.make = rows, make

    def __len__(self) -> int:
        return len(self.rows)

    def __getitem__(self, k: int) -> np.ndarray:
        return self.make(self.rows[k])


def list_rows(batches: Iterator[pa.RecordBatch], column: str) -> list[np.ndarray]:
    """The lists of a column, one after another, where the batches hold them."""
    out = []
    for batch in batches:
        lists = batch.column(batch.schema.get_field_index(column))
        ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
        out += [flat[a:b] for a, b in zip(ends, ends[1:], strict=False)]
    return out


def normed(counts: np.ndarray) -> np.ndarray:
    counts = counts.astype(np.float64)
    return counts / np.sqrt(SHRINK + (counts * counts).sum())


def _featured(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            index, begins = hashed_ngrams(*text_bytes(batch.column(2)), bits)
            found = [np.unique(index[a:b], return_counts=True) for a, b in zip(begins, begins[1:], strict=False)]
            ends = pa.array(np.cumsum([0, *(len(i) for i, _ in found)]).astype(np.int32))
            flat = (np.concatenate([np.zeros(0, np.int32), *(x[k] for x in found)]).astype(np.int32) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.ListArray.from_arrays(ends, pa.array(x)) for x in flat)], ["doc_id", "label", "features", "counts"])
        tidy()

    return run


def fitted(features: Sequence[np.ndarray], values: Sequence[np.ndarray], y: np.ndarray, weights: np.ndarray, bits: int = BITS, epochs: int = 8) -> tuple[np.ndarray, float]:
    """Dense weights and the bias."""
    return Ftrl(1 << bits, alpha=8.0, l1=0.03, l2=0.0).fit(features, values, y, epochs, weights=weights).finished()


def _learnt(share: float, bits: int, epochs: int):
    """share: of label 1 in the labels. Gives the model as one row; no row where labels are of one kind or none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = list(batches)  # in the order of ids
        y = np.concatenate([np.zeros(0), *(b.column(1).to_numpy() for b in found)])
        if 0 < y.sum() < len(y):
            features, counts = (list_rows(found, c) for c in ("features", "counts"))
            dense, bias = fitted(features, Each(counts, normed), y, np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean())), bits, epochs)
            at = np.flatnonzero(dense)
            yield pa.RecordBatch.from_arrays([pa.array([at.astype(np.int32)], pa.list_(pa.int32())), pa.array([dense[at]], pa.list_(pa.float32())), pa.array([bias])], ["at", "weights", "bias"])
            del features, counts
        del found
        tidy()

    return run


def train(docs: DataFrame, labels: DataFrame, bits: int = BITS, sample: int = SAMPLE, epochs: int = 8, sample_bytes: int = SAMPLE_BYTES) -> tuple[np.ndarray, float]:
    """Weights and bias from labels (doc_id, quality)."""
    one = labels_of(labels, "quality", "min")
    n = {r.label: r["count"] for r in one.groupBy("label").count().collect()}
    if len(n) < 2:
        return np.zeros(1 << bits, np.float32), 3.0 if 1 in n else -3.0 if n else 0.0
    rows = bounded_sample(docs, sampled_labels(labels, "quality", "min", sample), _featured(bits), "doc_id long, label int, features array<int>, counts array<int>", sample_bytes)
    model = rows.repartition(1).sortWithinPartitions("doc_id").mapInArrow(_learnt(n[1] / (n[0] + n[1]), bits, epochs), "at array<int>, weights array<float>, bias double").first()
    kind = rows.agg(F.min("label")).first()[0] if model is None else None
    remove(rows.sample_table)
    dense = np.zeros(1 << bits, np.float32)
    if model is None:  # of the labelled ids docs has one kind or none
        return dense, 0.0 if kind is None else 3.0 if kind else -3.0
    dense[model.at] = model.weights
    return dense, model.bias


def _scorer(model: tuple[np.ndarray, float], bits: int):
    dense, bias = model
    at = np.flatnonzero(dense)
    some = dense[at]

    def scores(array: pa.Array) -> np.ndarray:
        weights = np.zeros(1 << bits)
        weights[at] = some
        out = [np.zeros(0)]
        for batch in slices(iter([pa.RecordBatch.from_arrays([array], ["text"])]), "text"):
            index, begins = hashed_ngrams(*text_bytes(batch.column(0)), bits)
            n = len(begins) - 1
            texts = np.repeat(np.arange(n), np.diff(begins))
            both = np.sort((texts << bits) | index)
            new = np.flatnonzero(np.append(True, both[1:] != both[:-1])) if len(both) else np.zeros(0, np.int64)
            counts = np.diff(np.append(new, len(both))).astype(np.float64)
            texts, index = both[new] >> bits, both[new] & ((1 << bits) - 1)
            dot = np.bincount(texts, weights[index] * counts, n)
            out.append(sigmoid(dot / np.sqrt(SHRINK + np.bincount(texts, counts * counts, n)) + bias))
        return np.concatenate(out)

    return scores


def score(docs: DataFrame, model: tuple[np.ndarray, float], bits: int = BITS) -> DataFrame:
    """docs (doc_id, text): returns doc_id, score."""
    scores = _scorer(model, bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores(batch.column(1)))], ["doc_id", "score"])
        tidy()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def held_out(doc_id: Column) -> Column:
    """Rows that op10 never learns from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Returns doc_id, held_out, score, predicted; learns only from labels of rows that aren't held out."""
    model = train(docs, labels.filter(~held_out(F.col("doc_id"))), **options)
    scored = score(docs, model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def kept(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of docs that aren't rejected, with their columns. Scored in place: rows aren't joined back."""
    scores = _scorer(train(docs, labels, **options), options.get("bits", BITS))

    def run(texts: pa.Array) -> pa.Array:
        out = pa.array(scores(texts))
        tidy()
        return out

    return docs.filter(F.arrow_udf(run, "double")(F.col("text")) >= 0.5)
