"""Toxicity by a classifier chain: linear models of hashed word features, each fed by the ones before it.

The chain's categories come from the label columns, each feeding those after it: low_quality (quality 0),
toxic_low_quality (both), and toxic (toxic 1), which decides. A category's model sees whether the text holds a word,
or a longer word's first 4, 5, 6 or 7 bytes (so endings don't hide a stem), over the whole text, and the probabilities
of the earlier categories. Those it learns from are out-of-fold: predicted by models that didn't see the row, in FOLDS
folds by a hash of the id; the models that score are fitted on all sampled rows.

Training takes a bounded sample: at most SAMPLE / 2 ids of each value of toxic, lowest hash of the id first, and of
these as many as have SAMPLE_BYTES / 2 of features. A category's models are fitted side by side, one task each; the
sample never goes to the driver. An example of the category counts POSITIVE times, as few rows of a text are of it.
Everything else covers all rows.

Rules: null, empty and wordless texts have no features and score by the biases. Rows with a null id are scored,
not learnt from. An id with several labels counts as toxic if one says so, and of low quality if one says so; one of
several rows is learnt from by its least text. A category with labels of one kind or none has that kind's constant
probability. Repeated rows get equal scores; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import remove, slices, text_bytes, tidy, written
from .ftrl import Ftrl, folds, sigmoid
from .quality import CLASSES, Each, bounded_sample, list_rows, sampled_labels
from .textkernel import Words, mix

CATEGORIES = ("low_quality", "toxic_low_quality", "toxic")
BITS, SAMPLE, SAMPLE_BYTES, FOLDS, POSITIVE = 20, 8000, 1 << 27, 3, 6.0
PREFIXES = (4, 5, 6, 7)
#: (weights of features, weights of earlier probabilities, bias) for each category.
Chain = list[tuple[np.ndarray, np.ndarray, float]]


def hashed_words(data: np.ndarray, offsets: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Feature index and text of each word and prefix, repeats included."""
    words = Words(data, offsets, CLASSES)
    texts, lengths = words.texts(), words.ends - words.starts
    hashes, of = [words.hashes()], [texts]
    for k in PREFIXES:
        some = (lengths > k) & (words.kinds == 1)
        hashes.append(mix(words.hashes(k)[some] + np.uint64(k)))
        of.append(texts[some])
    return (np.concatenate(hashes) >> np.uint64(64 - bits)).astype(np.int64), np.concatenate(of)


def _present(index: np.ndarray, texts: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features of each text, ordered by text."""
    both = np.unique((texts << bits) | index)
    return both & ((1 << bits) - 1), both >> bits


def _featured(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            data, offsets = text_bytes(batch.column(3))
            index, texts = _present(*hashed_words(data, offsets, bits), bits)
            ends = np.searchsorted(texts, np.arange(len(offsets))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.ListArray.from_arrays(pa.array(ends), pa.array(index.astype(np.int32)))], ["doc_id", "label", "low_quality", "features"])
        tidy()

    return run


def _fit(features: Sequence[np.ndarray], extra: np.ndarray, y: np.ndarray, rows: np.ndarray, bits: int, epochs: int) -> tuple[np.ndarray, np.ndarray, float]:
    """One model; extra: earlier probabilities, whose slots follow the hashed ones."""
    size = 1 << bits
    if len(set(y[rows])) < 2:
        return np.zeros(size, np.float32), np.zeros(extra.shape[1]), 10.0 if len(rows) and y[rows[0]] else -10.0
    slots = size + np.arange(extra.shape[1])
    index = Each(rows, lambda k: np.concatenate([features[k], slots]))
    values = Each(rows, lambda k: np.concatenate([np.ones(len(features[k])), extra[k]]))
    model = Ftrl(size + extra.shape[1], alpha=0.5, l1=8.0, l2=0.0)
    dense, bias = model.fit(index, values, y[rows], epochs, weights=np.where(y[rows] == 1, POSITIVE, 1.0)).finished()
    return dense[:size], dense[size:].astype(np.float64), bias


def _predict(model: tuple[np.ndarray, np.ndarray, float], features: list[np.ndarray], extra: np.ndarray) -> np.ndarray:
    dense, more, bias = model
    return sigmoid(np.array([float(dense[i].sum()) for i in features]) + extra @ more + bias)


#: A fit's results: of a fold the probabilities of its rows, of the whole sample (fold -1) the model.
FITTED = "fold int, doc_id long, p double, at array<int>, weights array<float>, more array<double>, bias double"


def _fits(number: int, k: int, bits: int, epochs: int):
    """One partition holds the sample for one fit, with the earlier categories' probabilities in the column earlier."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = list(batches)  # in the order of ids
        if not found:
            return
        column = lambda c: np.concatenate([b.column(b.schema.get_field_index(c)).to_numpy() for b in found])
        f, ids, features = int(column("fit")[0]), column("doc_id"), list_rows(found, "features")
        extra = np.array([e for b in found for e in b.column(b.schema.get_field_index("earlier")).to_pylist()], np.float64).reshape(len(ids), number)
        toxic, low = column("label") == 1, column("low_quality") == 1
        y = {"low_quality": low, "toxic": toxic, "toxic_low_quality": low & toxic}[CATEGORIES[number]].astype(np.float64)
        fold = folds(ids, k)
        dense, more, bias = model = _fit(features, extra, y, np.flatnonzero(fold != f), bits, epochs)
        if f < 0:
            at = np.flatnonzero(dense)
            row = {"fold": [-1], "doc_id": [None], "p": [None], "at": [at.astype(np.int32)], "weights": [dense[at]], "more": [more], "bias": [bias]}
        else:
            own = np.flatnonzero(fold == f)
            none = [None] * len(own)
            row = {"fold": [f] * len(own), "doc_id": ids[own], "p": _predict(model, [features[i] for i in own], extra[own]), "at": none, "weights": none, "more": none, "bias": none}
        kinds = [pa.int32(), pa.int64(), pa.float64(), pa.list_(pa.int32()), pa.list_(pa.float32()), pa.list_(pa.float64()), pa.float64()]
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row.values(), kinds, strict=True)], list(row))
        del found, features
        tidy()

    return run


def train(docs: DataFrame, labels: DataFrame, bits: int = BITS, sample: int = SAMPLE, k: int = FOLDS, epochs: int = 8, sample_bytes: int = SAMPLE_BYTES) -> Chain:
    """labels (doc_id, quality, toxic)."""
    chosen = sampled_labels(labels, "toxic", "max", sample)
    low = labels.groupBy("doc_id").agg(F.coalesce(F.max((F.col("quality") == 0).cast("int")), F.lit(0)).alias("low_quality"))
    chosen = chosen.join(low, "doc_id").select("doc_id", "label", "low_quality")
    schema = "doc_id long, label int, low_quality int, features array<int>"
    sample_rows = bounded_sample(docs, chosen, _featured(bits), schema, sample_bytes)
    rows = written(sample_rows.withColumn("earlier", F.array().cast("array<double>")), "chain")
    remove(sample_rows.sample_table)
    chain: Chain = []
    for number in range(len(CATEGORIES)):
        last = number + 1 == len(CATEGORIES)
        dealt = rows.withColumn("fit", F.explode(F.array(*map(F.lit, [-1] if last else range(-1, k)))))
        found = dealt.repartitionById(k + 1, F.col("fit") + 1).sortWithinPartitions("doc_id").mapInArrow(_fits(number, k, bits, epochs), FITTED)
        found = written(found, "fits")
        model, dense = found.filter("fold < 0").first(), np.zeros(1 << bits, np.float32)
        if model is None:  # nothing to learn from
            return [(dense, np.zeros(n), -10.0) for n in range(len(CATEGORIES))]
        dense[model.at] = model.weights
        chain.append((dense, np.array(model.more, np.float64), model.bias))
        was = rows
        if not last:
            told = found.filter("fold >= 0").select("doc_id", "p")
            rows = written(rows.join(told, "doc_id").withColumn("earlier", F.concat("earlier", F.array("p"))).drop("p"), "chain")
        remove(was)
        remove(found)
    return chain


def _scorer(chain: Chain, bits: int):
    kept = [(np.flatnonzero(dense), dense[dense != 0], more, bias) for dense, more, bias in chain]

    def scores(array: pa.Array) -> np.ndarray:
        out = []
        used = np.zeros(1 << bits, bool)
        for at, *_ in kept:
            used[at] = True
        for batch in slices(iter([pa.RecordBatch.from_arrays([array], ["text"])]), "text"):
            index, texts = hashed_words(*text_bytes(batch.column(0)), bits)
            some = used[index]
            index, texts = _present(index[some], texts[some], bits)
            done = np.zeros((batch.num_rows, len(kept)))
            for number, (at, weights, more, bias) in enumerate(kept):
                place = np.minimum(np.searchsorted(at, index), max(0, len(at) - 1))
                own = np.where(at[place] == index, weights[place], 0.0) if len(at) else np.zeros(len(index))
                dot = np.bincount(texts, own, batch.num_rows) + done[:, :number] @ more[:number]
                done[:, number] = sigmoid(dot + bias)
            out.append(done)
        return np.concatenate(out) if out else np.zeros((0, len(kept)))

    return scores


def score(docs: DataFrame, chain: Chain, bits: int = BITS) -> DataFrame:
    """docs (doc_id, text): returns doc_id and a probability for each category."""
    scores = _scorer(chain, bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = scores(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c) for c in done.T.copy())], ["doc_id", *CATEGORIES])
        tidy()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, " + ", ".join(f"{c} double" for c in CATEGORIES))


def classify(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Returns doc_id, a probability for each category, and rejected: toxic is at least 0.5."""
    return score(docs, train(docs, labels, **options)).withColumn("rejected", F.col("toxic") >= 0.5)


def toxic(text: Column, chain: Chain, bits: int = BITS) -> Column:
    """The probability of the category toxic, for use in a filter."""
    scores, number = _scorer(chain, bits), CATEGORIES.index("toxic")

    def run(texts: pa.Array) -> pa.Array:
        out = pa.array(scores(texts)[:, number].copy())
        tidy()
        return out

    return F.arrow_udf(run, "double")(text)


def kept(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of docs that aren't rejected, with their columns."""
    return docs.filter(toxic(F.col("text"), train(docs, labels, **options)) < 0.5)
