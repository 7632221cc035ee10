from __future__ import annotations

import html as entities
import random
import re
from collections import Counter
from xml.etree import ElementTree

import pytest

from tessella.llm import html
from tessella.llm.entries import op4_html_main_text


def text(source, template=frozenset()):
    return html.Page(source, 0, template).text()


@pytest.mark.parametrize(
    ("source", "expected"),
    [
        ("", ""),
        ("plain &amp; simple", "plain & simple"),
        ("<p>a < b</p>", "a < b"),
        ("<p>one<p>two<br>three", "one\n\ntwo three"),
        ("<article><h1>T</h1><p> a&nbsp;\n b </p></article><p>out</p>", "T\n\na b"),
        ("<nav>m</nav><div id='content'><p>x</p></div><footer>f</footer>", "x"),
        ("<div class='cookie-notice'>c</div><div role=navigation>n</div><aside>s</aside><form>f</form><p>x</p><div hidden>h</div>", "x"),
        ("<article><p>x</p><section id=comments><p>c</p></section><div class='ad'>a</div></article>", "x"),
        ("<article><header><h1>T</h1></header><p>x</p></article>", "T\n\nx"),
        ("<header>H</header><p>x <script>var a='</p>'</script>y</p><style>p{}</style>", "x y"),
        ("<p>cut <a href='x", "cut"),
        ("<p>cut &am", "cut &am"),
        ("<p>cut</p><scr", "cut"),
        ("<p>a<!-- b --><b>c</b>d</p><!-- open", "acd"),
        ("<ul><li>a<li>b</ul><table><tr><td>c<td>d</table>", "a\n\nb\n\nc\n\nd"),
        ("<article></article><p>out</p>", ""),
        ("</div></p><p>x</p></article>", "x"),
    ],
)
def test_pages(source, expected):
    assert text(source) == expected


def test_deep_and_long_pages():
    assert text("<div>" * 20000 + "x") == "x"
    assert len(text("<p>" + "word " * 200000)) == 999999
    assert text("<" * 100000 + "<p>x</p>").endswith("x")


def site(n):
    strip = "<div class=x>Our site <a href=/a>All</a> since 1999</div>"
    return [(k, f"http://one.example/{k}", f"<body>{strip}<div><p>Own words of page {k}.</p></div><p>Fine print.</p></body>") for k in range(n)]


def test_templates_of_a_host_are_removed(spark):
    rows = [(*r, "k") for r in site(20) + [(100, "http://two.example/", site(1)[0][2]), (101, None, site(1)[0][2]), (102, "http://one.example/x", None), (103, "http://one.example/y", "")]]
    rows += [(200 + k, "http://copies.example/", rows[3][2], "k") for k in range(30)]  # one page, many times: no template
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, keys string")
    for broadcast_keys in (1 << 18, 0):
        found = {r.page_id: r.text for r in html.extract(pages, broadcast_keys=broadcast_keys).collect()}
        assert len(found) == len(rows)
        assert all(found[k] == f"Own words of page {k}." for k in range(20))
        whole = "Our site All since 1999\n\nOwn words of page {}.\n\nFine print."
        assert found[100] == found[101] == whole.format(0) and found[200] == found[229] == whole.format(3)
        assert found[102] == found[103] == ""


def test_articles_that_recur_stay(spark):
    same = "<p>The same words stand on many pages of the host.</p>"
    rows = [(k, "http://one.example/", f"<article><h1>Title {k}</h1>{same}<div><a href=x>More like this</a></div></article>") for k in range(12)]
    found = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert all(r.text == f"Title {r.page_id}\n\nThe same words stand on many pages of the host." and r.n_chars == len(r.text) for r in found)


def test_sections_of_a_large_host_are_templates(spark):
    page = "<div class=x>Notice of section {}</div><p>Own words of page {}.</p>"
    rows = [(k, f"http://one.example/{k}", page.format(k % 20, k)) for k in range(120)]  # a section has 5 % of the pages
    rows += [(200 + k, "http://one.example/few", page.format("few", 200 + k)) for k in range(4)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for broadcast_keys in (1 << 18, 0):
        found = {r.page_id: r.text for r in html.extract(pages, broadcast_keys=broadcast_keys).collect()}
        assert all(found[k] == f"Own words of page {k}." for k in range(120))
        assert found[203] == "Notice of section few\n\nOwn words of page 203."


def extracted(spark, rows, **options):
    return {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), **options).collect()}


def test_templates_inside_articles(spark):
    long = "Terms of use. " * 6000
    notice = "<div class='zz'>Call us on 555</div>"
    rows = [(k, f"http://one.example/{k}", f"<article><h1>T{k}</h1><p>Own {k}.</p>{notice}<div>{long}<br>{long}</div><ul><li>a<li>b</ul></article>") for k in range(20)]
    rows += [(100 + k, f"http://two.example/{k}", f"<div><h2>T{k}</h2>Own {k}.</div><div>{long}<!-- {k} --><script>track({k})</script>{long}</div>") for k in range(20)]
    # Copies of an article, and articles of which all but the heading recurs, keep their parts.
    rows += [(200 + k, f"http://three.example/{k}", f"<nav>{k}</nav><article><h1>T</h1><p>x</p>{notice}</article>") for k in range(6)]
    rows += [(300 + k, f"http://four.example/{k}", f"<article><h1>T{k}</h1><div><p>x</p>{notice}</div></article>") for k in range(6)]
    for broadcast_keys in (1 << 18, 0):
        found = extracted(spark, rows, broadcast_keys=broadcast_keys)
        assert all(found[k] == f"T{k}\n\nOwn {k}." and found[100 + k] == f"T{k}\n\nOwn {k}." for k in range(20))
        assert all(found[200 + k] == "T\n\nx\n\nCall us on 555" and found[300 + k] == f"T{k}\n\nx\n\nCall us on 555" for k in range(6))


@pytest.mark.parametrize("frame", ["<div class='search-results-page'>{}</div>", "<div id='login-guide-widget'>{}</div>", "<div class='related-topic post'>{}</div>", "<form id=all><h1>T</h1>{}<input value=x></form>"])
def test_names_do_not_empty_pages(frame):
    assert text(frame.format("<p>real text</p>")).endswith("real text")


def test_null_urls_have_no_template(spark):
    same = "<div>same</div>"
    rows = [(k, "no scheme", f"<p>{k}</p>{same}") for k in range(6)] + [(10 + k, None, f"<p>{k}</p>{same}") for k in range(6)] + [(3, "no scheme", f"<p>again</p>{same}")]
    for broadcast_keys in (1 << 18, 0):
        frame = spark.createDataFrame(rows, "page_id long, url string, html string")
        found = sorted((r.page_id, r.text) for r in html.extract(frame, broadcast_keys=broadcast_keys).collect())
        assert found == sorted([(k, str(k)) for k in range(6)] + [(3, "again")] + [(10 + k, f"{k}\n\nsame") for k in range(6)])


def brute_force(pages):
    """By whole sources: {page_id: text} of well-formed pages without articles, and how many pages the template changes."""
    trees = {i: (u.split("/")[2], ElementTree.fromstring(h)) for i, u, h in pages}
    of = Counter()
    for source in {(h, ElementTree.tostring(t)) for h, t in trees.values()}:
        of.update({(source[0], ElementTree.tostring(e)) for e in ElementTree.fromstring(source[1]).iter("div")} | {(source[0], ElementTree.tostring(e)) for e in ElementTree.fromstring(source[1]).iter("p")})
    out, changed = {}, 0
    for i, (host, tree) in trees.items():
        kept, everything = [], []

        def walk(e, gone, host=host, kept=kept, everything=everything):
            gone = gone or e.tag != "body" and of[host, ElementTree.tostring(e)] >= html.MIN_PAGES
            for t in [e.text, *(x for c in e for x in (c, c.tail))]:
                if isinstance(t, ElementTree.Element):
                    walk(t, gone)
                elif t:
                    everything.append(t)
                    kept.extend([] if gone else [t])

        walk(tree, False)
        out[i] = "\n\n".join(kept or everything)
        changed += bool(kept) and kept != everything
    return out, changed


def test_against_brute_force(spark):
    draw = random.Random(5)

    def block(depth):
        tag = draw.choice(["div", "div", "p"]) if depth else "p"
        return f"<{tag}>" + (draw.choice("abcdefghij") * draw.randint(1, 3) if tag == "p" or draw.random() < 0.5 else "".join(block(depth - 1) for _ in range(draw.randint(1, 3)))) + f"</{tag}>"

    rows = []
    for k in range(300):
        own = f"<p>page {draw.randrange(250)}</p>" if draw.random() < 0.8 else ""
        rows.append((k, f"http://{draw.choice(['one', 'two', 'three'])}.example/{k}", f"<body>{own}{''.join(block(2) for _ in range(draw.randint(0, 3)))}</body>"))
    expected, changed = brute_force(rows)
    assert changed > 100
    assert extracted(spark, rows) == expected


def test_empty_table(spark):
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).isEmpty()


def test_whole_table(spark, sf_dir):
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    found = op4_html_main_text(spark, sf_dir).collect()
    assert len(found) == len(pages)
    for r in found:
        source = pages[r.page_id].html
        body = source.partition("<article>")[2].partition("</article>")[0]
        blocks = re.split(r"</?(?:p|h1)>", re.sub(r"<[^>]*\Z", "", body))
        blocks = [" ".join(entities.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in blocks]
        assert r.text == "\n\n".join(b for b in blocks if b) and r.url == pages[r.page_id].url
