from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tessella.llm import components, minhash
from tessella.llm.textkernel import mix

LOWER = {c: c + 32 for c in range(65, 91)}


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows, percent=75):
    """Component of each id over exact links of all pairs."""
    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    root = {i: i for i, _ in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            common = len(a & b)
            if common and 100 * common >= percent * (len(a) + len(b) - common):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i, _ in sets}


def sequential(elements, places):
    """SuperMinHash as published, an element at a time, over the same draws."""
    out = [None] * places
    for e in elements:
        order = list(range(places))
        for step in range(places):
            draw = int(mix(np.array([(int(e) + (step + 1) * 0x9E3779B97F4A7C15) % 2**64], np.uint64))[0])
            pick = step + (((draw & 0xFFFF) * (places - step)) >> 16)
            order[step], order[pick] = order[pick], order[step]
            value = step << 48 | draw >> 16
            if out[order[step]] is None or value < out[order[step]]:
                out[order[step]] = value
    return out


def test_signature_is_the_published_one():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 2**63, n, dtype=np.uint64)) for n in (1, 2, 7, 60, 400)]
    begins = np.cumsum([0, *map(len, sets)])
    found = minhash.signatures(np.concatenate(sets), begins, 16)
    assert [row.tolist() for row in found] == [sequential(s, 16) for s in sets]


def test_signatures_estimate():
    rng = np.random.default_rng(3)
    both = rng.integers(0, 2**63, 900, dtype=np.uint64)
    sets = [np.sort(both[:750]), np.sort(both[150:])]  # 600 of 900
    sig = minhash.signatures(np.concatenate(sets), np.array([0, 750, 1500]))
    assert abs((sig[0] == sig[1]).mean() - 2 / 3) < 0.15
    assert (minhash.signatures(np.zeros(0, np.uint64), np.array([0, 0]))[0] == 2**64 - 1).all()


def corpus(seed, n=120):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(3))
    passage = [word() for _ in range(30)]
    rows = []
    for k in range(n):
        base = [word() for _ in range(rng.choice((1, 3, 5, 8, 40, 120)))]
        if rng.random() < 0.3:
            base = passage + base
        rows.append((len(rows), " ".join(base)))
        for _ in range(rng.choice((0, 0, 0, 1, 4, 12))):
            copy = list(base)
            for _ in range(rng.choice((0, 1, 1, 2, 4))):
                copy[rng.randrange(len(copy))] = word()
            rows.append((len(rows), " ".join(copy)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "tile"), [(1, 1024), (2, 3)])
def test_components(spark, seed, tile):
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = minhash.near_duplicates(docs, tile=tile).collect()
    expected = brute(rows)
    assert {r.doc_id: r.component_id for r in found} == expected
    assert all(r.n_shingles == len(shingles(dict(rows)[r.doc_id])) and r.kept == (r.doc_id == r.component_id) for r in found)
    kept = minhash.deduplicated(docs)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(expected.values()))


def test_a_group_of_varied_copies(spark):
    """One base, heavily edited: a star can't reach all of its links."""
    rng = random.Random(5)
    base = [f"w{k}" for k in range(150)]
    rows = []
    for k in range(200):
        copy = list(base)
        for _ in range(rng.randrange(9)):
            copy[rng.randrange(150)] = f"x{rng.randrange(10**6)}"
        rows.append((k, " ".join(copy)))
    found = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in found} == brute(rows)


def crowded(n):
    """Two linked texts that share one band only, which n texts with the band's shingles share as well, linked with nothing."""
    rng = random.Random(79389)
    a = [f"w{rng.randrange(10**6)}" for _ in range(64)]
    b = a[:-8] + [f"v{rng.randrange(10**6)}" for _ in range(8)]

    def bands(texts):
        values = minhash.signatures(*minhash.shingle_sets(*minhash.text_bytes(pa.array(texts)), 5))
        return values.reshape(len(texts), -1, minhash.ROWS_OF_BAND)

    pair = bands([" ".join(a), " ".join(b)])
    (band,) = np.flatnonzero((pair[0] == pair[1]).all(axis=1))
    least = bands([" ".join(a[k : k + 5]) for k in range(52)])[:, band].argmin(axis=0)
    core = " ".join(" ".join(a[k : k + 5]) for k in sorted(set(least.tolist())))
    others = []
    while len(others) < n:
        texts = [f"{core} " + " ".join(f"x{rng.randrange(10**9)}" for _ in range(12)) for _ in range(n)]
        others += [t for t, own in zip(texts, bands(texts), strict=True) if (own[band] == pair[0][band]).all()]
    return [*enumerate(others[:n]), (n, " ".join(a)), (n + 1, " ".join(b))]


def test_a_wide_band_loses_no_link(spark):
    """Tiles of 2 members: what a band of 13 others joins is found, though the pair shares no second band."""
    rows = crowded(12)
    expected = brute(rows)
    assert expected == {i: min(i, 12) for i, _ in rows}
    found = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), tile=2).collect()
    assert {r.doc_id: r.component_id for r in found} == expected


def test_members_are_looked_up_once(spark, monkeypatch):
    """Joins by member make a row for a band's member and one for a tile's undecided one; nothing else, and none before tiles copy."""
    rng, made, told = random.Random(5), [], {}
    base = [f"w{k}" for k in range(150)]
    rows = []
    for k in range(300):
        copy = list(base)
        for _ in range(rng.randrange(12)):
            copy[rng.randrange(150)] = f"x{rng.randrange(10**6)}"
        rows.append((k, " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    join, written = type(docs).join, minhash.written

    def joined(self, other, on=None, how=None):
        out = join(self, other, on, how)
        if on == "rep" and how in (None, "inner"):
            made.append(out.count())
        return out

    def counted(df, tag):
        out = written(df, tag)
        told[tag] = out.count()
        if tag == "mixed":
            told["members"] = out.agg(minhash.F.sum(minhash.F.col("in_big") + minhash.F.col("others"))).first()[0]
        return out

    monkeypatch.setattr(type(docs), "join", joined)
    monkeypatch.setattr(minhash, "written", counted)
    found = minhash.near_duplicates(docs).collect()
    monkeypatch.undo()
    assert {r.doc_id: r.component_id for r in found} == brute(rows)
    assert told["members"] > 1000 and sum(made) <= told["members"] + told["undecided"]


def test_prefixes_meet():
    """Sets that reach the threshold share a shingle of their prefixes, in whatever order the counters put them."""
    rng = random.Random(9)
    for _ in range(40):
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice((1, 4, 5, 7, 8, 20, 90)))]
        texts = [" ".join(words), " ".join(words[: len(words) - rng.randrange(len(words) // 6 + 1)])]
        common = np.array([rng.randrange(5) for _ in range(minhash.COUNTERS)])
        batch = pa.RecordBatch.from_arrays([pa.array([0, 1]), pa.array(texts)], ["doc_id", "text"])
        (out,) = minhash._prefixes(common, 75)(iter([batch]))
        first, second = ({s for r, s in zip(*(c.to_pylist() for c in out.columns), strict=True) if r == k} for k in (0, 1))
        x, y = map(shingles, texts)
        assert first and second and (first & second or 100 * len(x & y) < 75 * len(x | y))


def test_odd_rows(spark, odd, empty):
    found = sorted(((r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(odd).collect()), key=str)
    expected = {0: (3, 0), 1: (0, 1), 2: (0, 2), 3: (0, 3), 4: (3, 0), 5: (6, 5), 6: (6, 5), 7: (1, 7), 8: (1, 8), 9: (1, 8), 10: (2, 10)}
    assert len(found) == odd.count()
    assert all((n, c) == expected[i] and k == (c == i) for null, i, n, c, k in found if not null)
    assert all(c is None and k for null, _, _, c, k in found if null)
    kept = minhash.deduplicated(odd)
    assert kept.columns == odd.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["0", "1", "2", "3", "5", "7", "8", "10", "None", "None"])
    assert minhash.near_duplicates(empty).isEmpty() and minhash.deduplicated(empty).isEmpty()


def test_ids_with_several_texts(spark):
    a, b = "a b c d e f g h", "q r s t u v w x"
    rows = [(1, a), (1, b), (2, a), (3, b), (4, "lonely words stand here alone")]
    found = {(r.doc_id, r.component_id) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {(1, 1), (2, 1), (3, 1), (4, 4)}


def test_whole_table(spark, documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(documents).collect()} == brute(rows)


def test_connected_components(spark):
    rng = random.Random(8)
    edges = [(k, k + 1) for k in range(100, 160)] + [(rng.randrange(100), rng.randrange(100)) for _ in range(70)] + [(500, 500)]
    root = {v: v for e in edges for v in e}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    found = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {v: find(v) for a, b in edges if a != b for v in (a, b)}
    assert components.components(spark.createDataFrame([], "a long, b long")).isEmpty()
