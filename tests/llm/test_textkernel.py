from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tessella.llm.common import slices, text_bytes
from tessella.llm.textkernel import Words, shingle_sets

LOWER = {c: c + 32 for c in range(65, 91)}
TEXTS = st.lists(st.text(alphabet="aB é\n\t\x1c,日", max_size=30) | st.none(), max_size=8)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


@settings(max_examples=200, deadline=None)
@given(TEXTS)
def test_words_have_equal_hashes_where_they_are_equal(texts):
    found = Words(*text_bytes(pa.array(texts, pa.string())))
    expected = [words(t) for t in texts]
    assert found.counts.tolist() == [len(w) for w in expected]
    flat = [w for ws in expected for w in ws]
    hashes = found.hashes().tolist()
    assert len({*zip(flat, hashes, strict=True)}) == len({*flat}) == len({*hashes})


@settings(max_examples=200, deadline=None)
@given(TEXTS)
def test_shingle_sets(texts):
    elements, begins = shingle_sets(*text_bytes(pa.array(texts, pa.string())), 3)
    expected = [{tuple(w[k : k + 3]) for k in range(len(w) - 2)} or ({tuple(w)} if w else set()) for w in map(words, texts)]
    got = [set(elements[a:b].tolist()) for a, b in zip(begins, begins[1:], strict=False)]
    assert [len(g) for g in got] == [len(e) for e in expected]
    for a in range(len(got)):
        for b in range(a):
            assert len(got[a] & got[b]) == len(expected[a] & expected[b])


def test_slices_keep_every_row():
    batch = pa.RecordBatch.from_arrays([pa.array(["a" * k if k % 5 else None for k in range(50)])], ["text"])
    parts = list(slices(iter([batch.slice(3)]), "text", 20))
    assert [v for p in parts for v in p.column(0).to_pylist()] == batch.column(0).to_pylist()[3:]
    assert all(p.num_rows == 1 or sum(len(v or "") for v in p.column(0).to_pylist()) <= 20 for p in parts)
    assert np.array_equal(text_bytes(parts[1].column(0))[1], np.cumsum([0, *(len(v or "") for v in parts[1].column(0).to_pylist())]))
