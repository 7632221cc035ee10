from __future__ import annotations

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessella.llm import dac
from tessella.llm.entries import op7_token_file, tokenizer_path

PATH = tokenizer_path("word_bpe_49k.json")
IDS = st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 600), max_size=1500)


def image(ids, chunk=8):
    return dac.Image(dac.image_bytes(np.arange(1), np.ones(1), np.array([len(ids)]), np.array(ids, np.uint32), chunk))


@settings(max_examples=80, deadline=None)
@given(IDS, st.sampled_from([3, 8, 12, 16]), st.data())
def test_codes(ids, chunk, data):
    found = image(ids, chunk)
    assert found.ids().tolist() == ids
    if ids:
        a = data.draw(st.integers(0, len(ids)))
        b = data.draw(st.integers(a, len(ids)))
        assert found.ids(a, b).tolist() == ids[a:b]
        i = data.draw(st.integers(0, len(ids) - 1))
        assert found.get(i) == ids[i]


def test_wrong_file():
    with pytest.raises(ValueError, match="not a token file"):
        dac.Image(b"x" * 100)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("abé'sSt12. \n_-—’ÀßſİΣ日🙂́\x1c\x85\xa0<|>")), max_size=60) | st.sampled_from(["<|endoftext|>", "a <|ENDOFTEXT|> b", "don't X'S"]), max_size=5))
def test_pieces_are_the_library(texts):
    expected = [e.ids for e in Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)] if texts else []
    assert [np.frombuffer(b, "<u4").tolist() for b in dac.encoder(PATH).encode(texts)] == expected


def brute(rows):
    """Rows in id order, null first, then by text: (doc_id, start, n_tokens, crc)."""
    library, start, out = Tokenizer.from_file(PATH), 0, []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = library.encode(t or "", add_special_tokens=False).ids + [2]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize(("segment_rows", "most"), [(4096, dac.IMAGE), (3, 50), (1, 1)])
def test_tables(spark, odd, documents, segment_rows, most, tmp_path):
    for docs in (odd, documents):
        path = dac.write(docs, PATH, segment_rows=segment_rows, most=most)
        found = sorted((tuple(r) for r in dac.documents(spark, path).collect()), key=lambda r: r[1])
        assert found == brute([(r.doc_id, r.text) for r in docs.collect()])
    n = dac.export(spark, path, str(tmp_path))
    files = sorted(tmp_path.iterdir())
    assert len(files) == n > 0 and sum(dac.Image(f.read_bytes()).tokens for f in files) == sum(r[2] for r in found)


def test_empty(spark, empty, sf_dir, documents):
    assert dac.documents(spark, dac.write(empty, PATH)).isEmpty()
    assert op7_token_file(spark, sf_dir).count() == documents.count()
