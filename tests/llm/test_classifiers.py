from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import quality, toxicity
from tessella.llm.ftrl import Ftrl, folds, sigmoid


def test_ftrl_learns_and_stays_sparse():
    rng = np.random.default_rng(0)
    x = [np.unique(rng.integers(0, 500, 20)) for _ in range(600)]
    y = np.array([float(7 in i or 11 in i) for i in x])
    dense, bias = Ftrl(500, alpha=0.5, l1=2.0, l2=0.0).fit(x, [np.ones(len(i)) for i in x], y, 6).finished()
    p = sigmoid(np.array([dense[i].sum() for i in x]) + bias)
    assert ((p >= 0.5) == y).mean() > 0.98 and dense[7] > 1 and dense[11] > 1 and (dense != 0).sum() < 300
    again = Ftrl(500, alpha=0.5, l1=2.0, l2=0.0).fit(x, [np.ones(len(i)) for i in x], y, 6).finished()
    assert (again[0] == dense).all()


class PlainFtrl:
    """Per coordinate, in dictionaries, feature names as they are."""

    def __init__(self, alpha, l1, beta=1.0, l2=0.0):
        self.alpha, self.l1, self.beta, self.l2, self.z, self.n = alpha, l1, beta, l2, {}, {}

    def weight(self, f):
        z, l1 = self.z.get(f, 0.0), 0.0 if f is None else self.l1
        return 0.0 if abs(z) <= l1 else -(z - math.copysign(l1, z)) / ((self.beta + math.sqrt(self.n[f])) / self.alpha + self.l2)

    def score(self, x):
        return 1 / (1 + math.exp(-sum(self.weight(f) * v for f, v in x.items()) - self.weight(None)))

    def learn(self, x, y, weight):
        error = (self.score(x) - y) * weight
        ws = {f: self.weight(f) for f in [*x, None]}
        for f, v in [*x.items(), (None, 1.0)]:
            g, n = error * v, self.n.get(f, 0.0)
            self.z[f] = self.z.get(f, 0.0) + g - (math.sqrt(n + g * g) - math.sqrt(n)) / self.alpha * ws[f]
            self.n[f] = n + g * g

    def fit(self, xs, ys, weights, epochs):
        order, rng = np.arange(len(ys)), np.random.default_rng(7)
        for _ in range(epochs):
            rng.shuffle(order)
            for k in order:
                self.learn(xs[k], ys[k], weights[k])
        return self


def plain_words(text):
    return [w.lower() if w.isascii() else "".join(c.lower() if c.isascii() else c for c in w) for w in re.findall(r"[0-9A-Za-z\u0080-\U0010ffff]+|[^0-9A-Za-z\u0080-\U0010ffff\s]+", re.sub(r"[\x1c-\x1f\x85\xa0]", "x", text or ""))]


def labelled(docs, labels):
    texts = {r.doc_id: r.text for r in docs.collect()}
    return sorted((r.doc_id, texts[r.doc_id], r.quality, r.toxic) for r in labels.collect() if r.doc_id in texts)


def test_quality_is_plain_ftrl(larger):
    docs, labels = larger
    rows = [r for r in labelled(docs, labels) if len(r[1] or "") < 3000][:150]
    some = labels.filter(F.col("doc_id").isin([r[0] for r in rows]))
    xs = []
    for _, text, *_ in rows:
        words = plain_words(text)
        counts = Counter(tuple(words[k : k + n]) for n in (1, 2, 3) for k in range(len(words) - n + 1))
        norm = math.sqrt(quality.SHRINK + sum(c * c for c in counts.values()))
        xs.append({f: c / norm for f, c in counts.items()})
    ys = [r[2] for r in rows]
    plain = PlainFtrl(8.0, 0.03).fit(xs, ys, [1.0] * len(ys), 8)
    found = {r.doc_id: r.score for r in quality.score(docs, quality.train(docs, some, bits=23), bits=23).collect()}
    assert max(abs(found[r[0]] - plain.score(x)) for r, x in zip(rows, xs, strict=True)) < 1e-4  # at 23 bits features hardly share a place


def test_chain_is_a_plain_chain(larger):
    docs, labels = larger
    rows = [r for r in labelled(docs, labels) if len(r[1] or "") < 3000]
    rows = [r for r in rows if r[3]][:20] + [r for r in rows if not r[3] and not r[2]][:20] + [r for r in rows if not r[3] and r[2]][:40]
    rows.sort()
    some = labels.filter(F.col("doc_id").isin([r[0] for r in rows]))
    xs = []
    for _, text, *_ in rows:
        words = set(plain_words(text))
        byte = {(k, w.encode()[:k]) for w in words for k in toxicity.PREFIXES if len(w.encode()) > k and re.match(r"[0-9A-Za-z\u0080-\U0010ffff]", w)}
        xs.append(dict.fromkeys(words | byte, 1.0))
    fold = folds(np.array([r[0] for r in rows]), 3)
    low, toxic = ([float(v) for v in x] for x in zip(*((1 - r[2], r[3]) for r in rows), strict=True))
    models = []
    for name, ys in (("low_quality", low), ("toxic_low_quality", [a * b for a, b in zip(low, toxic, strict=True)]), ("toxic", toxic)):
        fit = lambda at, ys=ys: PlainFtrl(0.5, 8.0).fit([xs[k] for k in at], [ys[k] for k in at], [6.0 if ys[k] else 1.0 for k in at], 8)
        if len(set(ys)) > 1:
            models.append((name, fit(range(len(ys)))))
            out = {k: m.score(xs[k]) for f in range(3) for m in [fit([k for k in range(len(ys)) if fold[k] != f])] for k in range(len(ys)) if fold[k] == f}
            for k, x in enumerate(xs):
                x[name,] = out[k]
    for x in xs:
        for name, model in models:
            x.pop((name,), None)
    found = {r.doc_id: r for r in toxicity.score(docs, toxicity.train(docs, some, bits=23), bits=23).collect()}
    for (i, *_), x in zip(rows, xs, strict=True):
        for name, model in models:
            x[name,] = model.score(x)
            assert abs(found[i][name] - x[name,]) < 1e-3


def test_one_id_is_one_example(spark, documents, labels):
    """A labelled id that holds most rows is learnt from once; the sample stays within its bytes."""
    chosen = quality.sampled_labels(labels, "quality", "min", 100)
    first = chosen.first().doc_id
    docs = documents.unionByName(documents.filter(F.col("doc_id") == first).withColumn("text", F.explode(F.sequence(F.lit(1), F.lit(3000)).cast("array<string>"))))
    schema = "doc_id long, label int, features array<int>, counts array<int>"
    rows = quality.bounded_sample(docs, chosen, quality._featured(20), schema, 1 << 30).collect()
    assert len(rows) == len({r.doc_id for r in rows}) == chosen.count()
    few = quality.bounded_sample(docs, chosen, quality._featured(20), schema, 20_000).collect()
    assert 0 < len(few) < len(rows) and sum(4 * len(r.features) for r in few) <= 20_000


def test_folds_are_even():
    assert np.bincount(folds(np.arange(3000), 3)).min() > 900


@pytest.fixture(scope="module")
def larger(spark):
    """The next size: its labels are enough to hold some out."""
    at = "/root/testdata/sf0.01"
    return spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/labels.parquet")


def test_quality_on_held_out_rows(larger):
    docs, labels = larger
    found = quality.classify(docs, labels).join(labels, "doc_id").collect()
    held = [r for r in found if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in found)
    assert len(held) > 50 and sum(r.predicted == r.quality for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in found)


def test_held_out_labels_are_never_learnt(larger):
    docs, labels = larger
    flipped = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (sorted(map(tuple, quality.classify(docs, x).collect())) for x in (labels, flipped))
    assert a == b


def test_toxicity_on_held_out_rows(larger):
    docs, labels = larger
    held = labels.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1)
    found = toxicity.classify(docs, labels.join(held.select("doc_id"), "doc_id", "left_anti")).join(held, "doc_id").collect()
    rows = [(r[toxicity.CATEGORIES.index("toxic") + 1], r[-1]) for r in found]
    assert sum(p >= 0.5 for p, y in rows if not y) <= 1  # clean documents stay
    assert sum(p >= 0.5 for p, y in rows if y) >= 0.5 * sum(y for _, y in rows)  # few labels; some have no toxic word


def test_chain_feeds_later_models(spark):
    """low_quality is easy to see; toxic is a word, but only in documents of low quality."""
    rng = np.random.default_rng(4)
    rows, marks = [], []
    for k in range(900):
        low, word = rng.random() < 0.4, rng.random() < 0.4
        rows.append((k, " ".join(rng.choice([f"w{j}" for j in range(60)], 20)) + " zork" * word + " ###" * low))
        marks.append((k, int(not low), int(low and word)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    chain = toxicity.train(docs, labels)
    assert [len(more) for _, more, _ in chain] == [0, 1, 2] and chain[1][1][0] > 0
    found = {r.doc_id: r for r in toxicity.score(docs, chain).collect()}
    assert np.mean([(found[k].low_quality >= 0.5) == (q == 0) for k, q, _ in marks]) > 0.98
    assert np.mean([(found[k].toxic >= 0.5) == t for k, _, t in marks]) > 0.9
    some = toxicity.kept(docs, labels)
    assert {r.doc_id for r in some.collect()} == {k for k in found if found[k].toxic < 0.5}


def test_equal_and_wordless_rows_score_alike(odd, documents, labels):
    for found in (quality.score(odd, quality.train(documents, labels)), toxicity.score(odd, toxicity.train(documents, labels))):
        of = {}
        for r in found.collect():
            of.setdefault(r.doc_id, set()).add(tuple(r)[1:])
        assert len(of[0]) == 1 and of[0] <= of[None] and of[5] == of[6]
        assert len(of[1] | of[2] | of[3]) == 1 and of[1] <= of[None]  # null, empty, blank


def test_odd_rows(spark, odd, empty, documents, labels):
    for classify, keep in ((quality.classify, quality.kept), (toxicity.classify, toxicity.kept)):
        assert classify(odd, labels).count() == odd.count()
        assert classify(empty, labels).isEmpty() and keep(empty, labels).isEmpty()
        assert classify(documents, labels.limit(0)).count() == documents.count()
        assert keep(odd, labels).columns == odd.columns
        one_kind = labels.withColumn("quality", F.lit(1)).withColumn("toxic", F.lit(0))
        assert keep(documents, one_kind).count() == documents.count()
        nulls = labels.withColumn("quality", F.lit(None).cast("int")).withColumn("toxic", F.lit(None).cast("int"))
        assert classify(documents, nulls).count() == documents.count()
