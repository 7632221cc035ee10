from __future__ import annotations

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from tessella.llm import bpe
from tessella.llm.entries import op1_sentencepiece_dropout, tokenizer_path

PATH = tokenizer_path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def plain():
    return bpe.MergeDropout(PATH, 0.0)


@pytest.fixture(scope="module")
def dropping():
    return bpe.MergeDropout(PATH, 0.3, seed=5)


def ids(blob):
    return np.frombuffer(blob, "<u4").tolist()


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("the anding \n\té日🙂")), max_size=60))
def test_without_dropout_it_is_the_library(library, plain, text):
    assert ids(plain.encode([text], [1])[0]) == library.encode(text)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=80), st.integers())
def test_dropout_is_lossless(dropping, text, key):
    try:
        text.encode()
    except UnicodeEncodeError:
        return
    blob = dropping.encode([text], [key])[0]
    assert dropping.decode(blob) == text
    assert dropping.encode([text], [key])[0] == blob


def test_segmentations_vary_and_repeat(plain):
    text = "international understanding " * 40
    seen = {bytes(bpe.MergeDropout(PATH, 0.3, seed=s).encode([text], [k])[0]) for s in (1, 2) for k in range(8)}
    assert len(seen) > 4
    assert len(ids(bpe.MergeDropout(PATH, 1.0).encode([text], [0])[0])) == len(text) + 1  # all merges skipped
    assert len(ids(plain.encode([text], [0])[0])) < min(len(s) // 4 for s in seen)


def test_array_agenda_is_the_heap_agenda(dropping):
    units = ["▁understanding", "▁internationally", "▁a", "aaaaaaaaaa", "▁▁▁▁x", "é日z"]
    keys = dropping._keys(units, 1)
    assert dropping.segment(units, 1) == [dropping._finished(dropping._long(u, int(k))) for u, k in zip(units, keys, strict=True)]


def plain_agenda(unit, gaps, scores):
    """Strings; of all pairs that make a piece and weren't skipped the best, then leftmost, comes up; each that comes up is drawn."""
    symbols = [(c, k) for k, c in enumerate(unit)]
    skipped, since, skips, fresh = set(), 0, 0, len(unit)
    while True:
        able = [(-scores[a + b], k) for k, ((a, i), (b, j)) in enumerate(zip(symbols, symbols[1:])) if a + b in scores and (i, j) not in skipped]
        if not able:
            return [a for a, _ in symbols]
        k = min(able)[1]
        if since == gaps(skips):
            skipped.add((symbols[k][1], symbols[k + 1][1]))
            since, skips = 0, skips + 1
        else:
            symbols[k : k + 2] = [(symbols[k][0] + symbols[k + 1][0], fresh)]
            since, fresh = since + 1, fresh + 1


@pytest.mark.parametrize("alpha", [0.1, 0.5])
def test_dropout_is_a_plain_agenda(library, alpha):
    model = bpe.MergeDropout(PATH, alpha, seed=9)
    scores = {library.id_to_piece(i): library.get_score(i) for i in range(library.get_piece_size()) if not (library.is_byte(i) or library.is_control(i) or library.is_unknown(i))}
    words = "understanding internationally a the of ▁ aaaaaaaaaa Wiederaufnahme reconnaissance x,y;z!! 12345 é日z".split()
    units = [u for k in range(40) for w in words for u in model.units.findall(bpe.BLANK + w)]
    keys = model._keys([f"{k}:{u}" for k, u in enumerate(units)], 2)
    gap = lambda key: lambda n: int(model._gaps(np.array([key], np.uint64), n)[0])
    for unit, key, blob in zip(units, keys, model._drawn(units, keys), strict=True):
        pieces = plain_agenda(unit, gap(key), scores)
        expected = [i for p in pieces for i in ([library.piece_to_id(p)] if p in scores else [library.piece_to_id(f"<0x{b:02X}>") for b in p.encode()])]
        assert ids(blob) == expected


def test_tables(spark, odd, empty, documents, sf_dir):
    rows = bpe.round_trip(odd, PATH).collect()
    assert len(rows) == odd.count() and all(r.lossless for r in rows)
    assert {r.n_ids for r in rows if r.doc_id in (1, 2)} == {0}
    encoded = bpe.encode(odd, PATH)
    back = sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in bpe.decode(encoded, PATH).collect())
    assert back == sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in odd.collect())
    assert bpe.round_trip(empty, PATH).isEmpty() and bpe.encode(empty, PATH).isEmpty()
    found = op1_sentencepiece_dropout(spark, sf_dir)
    assert found.count() == documents.count() and found.filter("not lossless").isEmpty()


def test_each_occurrence_document_and_copy_is_drawn(spark, plain):
    model = bpe.MergeDropout(PATH, 0.1, seed=23)
    words = ["▁understanding"] * 4000
    found = {bytes(x) for x in model._drawn(words, model._keys([str(k) for k in range(4000)], 0))}
    assert len(found) > 20
    merges, whole = model._merged(["▁the"], [()])[1][0], plain.segment(["▁the"])[0]
    drawn = model._drawn(["▁the"] * 20000, model._keys([str(k) for k in range(20000)], 0))
    assert 0.9**merges - 0.02 < drawn.count(whole) / 20000 < 1 and len(set(drawn)) > 4  # other merges may lead to the same piece
    text = "international understanding " * 10
    assert len(set(model.encode([text] * 200, range(200)))) > 150
    docs = spark.createDataFrame([(k % 2 or None, text) for k in range(200)], "doc_id long, text string").repartition(5)
    first, again = ([tuple(r.ids) for r in bpe.encode(docs, PATH).collect()] for _ in range(2))
    assert len(first) == 200 and len(set(first)) > 150 and sorted(first) == sorted(again)
    assert {r.text for r in bpe.decode(bpe.encode(docs, PATH), PATH).collect()} == {text}


def test_bounded_memory_and_order_change_nothing():
    texts, keys = ["international understanding of merges " * 5, "日本語" * 40, "other words"] * 3, list(range(9))
    whole = bpe.MergeDropout(PATH, 0.3).encode(texts, keys)
    small = bpe.MergeDropout(PATH, 0.3, kept=0)
    assert [small.encode([t], [k])[0] for t, k in zip(reversed(texts), reversed(keys), strict=True)] == whole[::-1]


def test_ids_from_the_store_are_those_of_the_heap_agenda():
    """Short, long and piece-less units of many lengths, some known from earlier calls, with stores that grow and are forgotten."""
    rng = np.random.default_rng(3)
    for kept in (bpe.KEPT_STATES, 0):
        model = bpe.MergeDropout(PATH, 0.3, seed=11, kept=kept)
        for call in range(3):
            words = ["".join(rng.choice(list("theandiné日🙂"), rng.integers(1, 70))) for _ in range(300)] + ["▁the", "▁understanding"] * 50
            keys = model._keys([f"{call}:{k}" for k in range(len(words))], 1)
            flat, begins = model._flat(words, keys)
            assert len(begins) == len(words) + 1 and begins[-1] == len(flat)
            for k, word in enumerate(words):
                assert flat[begins[k] : begins[k + 1]].tobytes() == model._finished(model._long(word, int(keys[k])))
    empty, begins = model._flat([], np.zeros(0, np.uint64))
    assert not len(empty) and begins.tolist() == [0]
