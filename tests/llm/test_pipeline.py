from __future__ import annotations

from collections import Counter

import corpus_pipeline
from tessella.llm import bpe, minhash, mixing, quality, toxicity
from tessella.llm.entries import QUERIES, SQL, tokenizer_path

from test_minhash import brute, crowded


def test_stages_in_turn(spark, documents, sf_dir, labels):
    docs, kept = documents, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, corpus_pipeline.written(stage(spark, docs, sf_dir), "test")
        assert docs.columns == documents.columns
        kept[name] = (before, docs)
    before, after = kept["toxicity"]
    scores = {r.doc_id: r.toxic for r in toxicity.classify(before, labels).collect()}
    assert {r.doc_id for r in after.collect()} == {k for k, v in scores.items() if v < 0.5}
    before, after = kept["quality"]
    scores = {r.doc_id: r.score for r in quality.score(before, quality.train(before, labels)).collect()}
    assert {r.doc_id for r in after.collect()} == {k for k, v in scores.items() if v >= 0.5}
    before, after = kept["near_duplicates"]
    assert {r.doc_id for r in after.collect()} == set(brute([(r.doc_id, r.text) for r in before.collect()]).values())
    before, after = kept["mixing"]
    times = {r.doc_id: r.repeats + (2 * r.part >= max(r.size, 1)) for r in mixing.mix(before).collect()}
    found = {r.doc_id: r["count"] for r in after.groupBy("doc_id").count().collect()}
    assert found == {k: v for k, v in times.items() if v}
    ids = corpus_pipeline.encode_pieces(spark, after, sf_dir)
    back = sorted((r.doc_id, r.text) for r in bpe.decode(ids, tokenizer_path("piece_bpe_32k.model")).collect())
    assert back == sorted((r.doc_id, r.text) for r in after.collect())
    assert corpus_pipeline.run(spark, sf_dir).count() == after.count()


def test_stages_take_odd_tables(spark, odd, empty, labels, sf_dir):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf_dir).isEmpty()
    _, quality_, dedup, mix, pieces = (stage for _, stage in corpus_pipeline.STAGES)
    for stage, scored, ok in ((corpus_pipeline.drop_toxic, toxicity.score(odd, toxicity.train(odd, labels)), lambda r: r.toxic < 0.5), (quality_, quality.score(odd, quality.train(odd, labels)), lambda r: r.score >= 0.5)):
        assert sorted(str(r.doc_id) for r in stage(spark, odd, sf_dir).collect()) == sorted(str(r.doc_id) for r in scored.collect() if ok(r))
    kept = dedup(spark, odd, sf_dir)
    assert kept.columns == odd.columns
    # One of each group; rows that repeat an id are one; null ids stay.
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["0", "1", "2", "3", "5", "7", "8", "10", "None", "None"])
    mixed = mix(spark, odd, sf_dir)
    assert mixed.columns == odd.columns
    rows, taken = [tuple(r) for r in odd.collect()], Counter(tuple(r) for r in mixed.collect())
    assert set(taken) <= set(rows) and all((r[1] or "").strip() and n <= 2 * rows.count(r) for r, n in taken.items())  # no row without words, none over its epochs
    ids = pieces(spark, odd, sf_dir)
    assert sorted(str((r.doc_id, r.text)) for r in bpe.decode(ids, tokenizer_path("piece_bpe_32k.model")).collect()) == sorted(str((r[0], r[1] or "")) for r in rows)


def test_a_wide_band_keeps_one_of_each_group(spark, sf_dir):
    """As wide as only bands of the operator's own settings are: the one linked pair shares nothing else."""
    rows = crowded(4200)
    kept = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), sf_dir)
    assert sorted(r.doc_id for r in kept.collect()) == list(range(4201))


def test_registered_queries():
    assert len(QUERIES) == 10 and set(SQL) <= set(QUERIES)
    assert minhash.PLACES % minhash.ROWS_OF_BAND == 0
