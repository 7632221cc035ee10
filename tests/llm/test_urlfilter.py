from __future__ import annotations

import re

from hypothesis import given, settings
from hypothesis import strategies as st

from tessella.llm import urlfilter
from tessella.llm.urlfilter import ShiftAnd, canonical

GLOBS = ["+.com/*", "a*b", "*ab*", "+x", "é*", "", "*"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="ab./xcomé", max_size=14), min_size=1, max_size=6), st.lists(st.sampled_from(GLOBS) | st.text(alphabet="ab*+/.", max_size=8), min_size=1, max_size=40))
def test_automaton_is_the_regex(urls, globs):
    found = ShiftAnd(globs).match([u.encode() for u in urls])
    for u, row in zip(urls, found, strict=True):
        for g, hit in zip(globs, row, strict=True):
            pattern = "".join(".*" if c == "*" else "[^/]*" if c == "+" else re.escape(c) for c in g)
            assert bool(hit) == bool(re.fullmatch(pattern, u, re.S)), (u, g)


def test_canonical():
    assert canonical("HTTP://Ex.COM:80/Päth?x#y") == ("ex.com:80", "/Päth")
    assert canonical("x://a?b/c") == ("a", "") and canonical("//a/b") == ("", "") and canonical(None) == ("", "") and canonical("a://b://c/d") == ("b:", "//c/d")


def test_verdicts(spark):
    cases = {
        "http://x.com/a": ("com/", "allow"),
        "http://com/a": ("com/", "allow"),
        "http://xcom/a": (None, "allow"),
        "http://x.com": (None, "allow"),
        "http://a.example.com/en/1": ("example.com/en/", "block"),
        "http://a.example.com/en": ("com/", "allow"),
        "http://q.WWW.example.com/en/": ("www.example.com/en/", "allow"),
        "http://a.net/es/": ("net/es/", "block"),
        "http://a.net/fr/x": ("net/fr/", "block"),
        "http://a.net/de/x.com/en/": (None, "allow"),
        "http://spam-farm.example.org/en/": (None, "block"),
        "http://spam-farm.example.com/de/": ("com/", "allow"),
        "http://a.org/spam-farm.x": (None, "allow"),
        "no scheme": (None, "allow"),
        None: (None, "allow"),
        "http://" + "a" * 5000 + ".net/es/" + "b" * 5000: ("net/es/", "block"),
    }
    pages = spark.createDataFrame([(k, u, "x", "y") for k, u in enumerate(cases)], "page_id long, url string, rule string, verdict string")
    found = {r.page_id: (r.rule, r.verdict) for r in urlfilter.judge(pages).collect()}
    assert found == dict(enumerate(cases.values()))
    assert urlfilter.judge(pages.limit(0)).isEmpty()
    many = [("block", f"h{k}.org", "/") for k in range(300)]
    assert urlfilter.judge(spark.createDataFrame([(1, "http://a.h299.org/")], "page_id long, url string"), many, []).first().rule == "h299.org/"
