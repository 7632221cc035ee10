"""Main text of web pages, with site templates removed.

Two passes. The first hashes every block-level element's subtree of a page from the bottom up: an element's digest is
that of its tags, its text and its children's digests, so neither length nor depth is limited; comments and scripts
don't count. Spark counts, per host, how many different pages hold each subtree (pages that are equal count once), and
subtrees on at least MIN_PAGES pages are its template, however many pages the host has. The second pass reads the
pages again, deletes template subtrees, and gives the rest as text. Digests are counted with partial sums and never
gathered: a host with a third of all pages is many keys. The template goes to the second pass as a broadcast only if
it has been counted and is under BROADCAST_KEYS keys; else each page's template keys are found by a join and go to its
page by its digest.

What is deleted: outside of articles every template subtree; inside of one (article or main) template containers
(div, section, list, table and the like), while single paragraphs, headings, quotes and list items stay, as articles
may share passages. An article that recurs as a whole isn't its host's template, nor is anything in it; and no
article, nor a page without one, is left with headings alone: then what recurs in it stays.

What the rest is: if a page has an article (or main) element, the text is inside of it, else in the whole body;
elements whose tag or role says menu, header, footer, sidebar, notice, advert, form, script or style are dropped, and
those whose class or id is one of NAMES, for adverts and comments, which differ from page to page. A form that holds
an article or a first heading is the page's frame and stays.

Blocks: block-level elements and their ends divide the text; references are decoded, white space becomes one space,
blocks are trimmed, empty ones dropped, and joined by blank lines. Rules: null and empty html gives an empty text,
null urls are one host without template; a page that breaks off in a tag ends there; pages that repeat an id are
judged on their own; equal rows give equal rows. Other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remove, slices, written
from .urlfilter import canonical

MIN_PAGES, BROADCAST_KEYS = 5, 1 << 18

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp template svg math".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Not deleted on their own inside an article.
PROSE = HEADINGS | frozenset("p blockquote pre li dt dd tr td th thead tbody tfoot caption figcaption legend summary".split())
DROPPED = frozenset("head script style noscript template nav footer aside button select textarea input option iframe object embed applet svg math canvas audio video map dialog menu title noembed noframes xmp datalist".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar tablist tooltip status note".split())
#: Whole class names or ids.
NAMES = frozenset("ad ads advert adverts advertisement comment comments comment-list comments-area cookie-notice cookie-banner".split())
#: Open elements that a start tag closes first.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
CLOSES_P = BLOCK - {"html", "body", "caption", "td", "th", "tr", "tbody", "thead", "tfoot", "option", "optgroup", "legend"}

_QUOTED = r"\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z)"
_TAG = re.compile(rf"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>\"']*(?:(?:{_QUOTED})[^>\"']*)*)(>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")


class Element:
    __slots__ = ("tag", "dropped", "inside", "parts", "marks", "frame")

    def __init__(self, tag: str, dropped: bool, inside: bool, marks: int, source: str):
        self.tag, self.dropped, self.inside = tag, dropped, inside
        self.marks = marks  # blocks given when it began
        self.parts = [source]  # of a block: its own tags and text, its children's digests
        self.frame = False  # holds an article or a first heading


def _says_dropped(tag: str, attributes: str, in_article: bool) -> bool:
    """Whether an element's tag or attributes name it as something beside the article."""
    if tag in DROPPED or tag == "header" and not in_article:
        return True
    if not attributes or tag in ("html", "body", "article", "main"):
        return False
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), (a or b or c).lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "role" and value in ROLES:
            return True
        if name == "style" and "display:none" in value.replace(" ", ""):
            return True
        if name in ("class", "id") and not NAMES.isdisjoint(value.split()):
            return True
    return False


class Page:
    """One parse of a page: keys of the subtrees of its block elements, and the main text."""

    def __init__(self, source: str, salt: int, template: frozenset[int] | set[int] = frozenset(), want_text: bool = True):
        self.keys: list[int] = []
        self._blocks: list[tuple[bool, bool, str]] = []  # (inside an article, heading, text)
        self._cut: list[tuple[int, int]] = []  # blocks of template subtrees, as ranges that don't meet
        self._gone: list[tuple[int, int]] = []  # blocks of forms
        self._source, self._salt, self._template, self._want = source, salt, template, want_text
        self._parse()

    def text(self) -> str:
        if not self._has_article:
            self._keep_if_bare(0)
        gone = np.zeros(len(self._blocks), bool)
        for start, end in self._cut + self._gone:
            gone[start:end] = True
        return "\n\n".join(t for (inside, _, t), out in zip(self._blocks, gone.tolist(), strict=True) if not out and (inside or not self._has_article))

    def _delete(self, start: int) -> None:
        """Takes the blocks from start on for template, and the ranges within into theirs."""
        while self._cut and self._cut[-1][0] >= start:
            self._cut.pop()
        if start < len(self._blocks):
            self._cut.append((start, len(self._blocks)))

    def _keep_if_bare(self, start: int, whole: bool = False) -> None:
        """Undoes what is taken from start on if that leaves headings alone, or in any case."""
        first = next((k for k, c in enumerate(self._cut) if c[0] >= start), None)
        if first is None:
            return
        at = start
        for a, b in [*self._cut[first:], (len(self._blocks), 0)]:
            if not whole and any(not heading for _, heading, _ in self._blocks[at:a]):
                return
            at = b
        del self._cut[first:]

    def _flush(self) -> None:
        if self._run:
            words = " ".join(entities.unescape("".join(self._run)).split())
            self._run.clear()
            if words:
                self._blocks.append((self._inside, any(self._open_tags[h] for h in HEADINGS), words))

    def _close(self, end_tag: str = "") -> None:
        e = self._stack[-1]
        block = e.tag in BLOCK
        if block:
            self._flush()
        self._stack.pop()
        self._open_tags[e.tag] -= 1
        if block:
            self._holders.pop()
            e.parts.append(end_tag)
            digest = xxhash.xxh3_64_intdigest("".join(e.parts), self._salt)
            if self._holders:
                self._holders[-1].parts.append(f"\0{digest:x}\0")
            if e.tag not in ("html", "body"):
                self._subtree(e, digest - (1 << 63))
            if e.tag == "form" and not e.frame and not e.dropped and e.marks < len(self._blocks):
                self._gone.append((e.marks, len(self._blocks)))
        elif self._holders and end_tag:
            self._holders[-1].parts.append(end_tag)
        if self._stack:
            up = self._stack[-1]
            up.frame |= e.frame
            self._dropped, self._inside = up.dropped, up.inside or up.tag in ("article", "main")
        else:
            self._dropped = self._inside = False

    def _subtree(self, e: Element, key: int) -> None:
        self.keys.append(key)
        if e.dropped or not self._template:
            return
        if e.tag in ("article", "main"):
            self._keep_if_bare(e.marks, key in self._template)
        elif key in self._template and not (e.inside and e.tag in PROSE):
            self._delete(e.marks)

    def _parse(self) -> None:
        source, at, low = self._source, 0, None
        self._stack: list[Element] = []
        self._holders: list[Element] = []  # the open blocks
        self._open_tags: Counter[str] = Counter()
        self._run: list[str] = []
        self._dropped = self._inside = self._has_article = False
        n = len(source)
        while at < n:
            m = _TAG.search(source, at)
            found = m.start() if m else n
            if found > at:
                self._add(source[at:found])
            if not m:
                break
            at, tag = m.end(), m[2]
            if tag is None:
                continue
            if not m[4]:
                break  # the page ends in this tag
            tag = tag.lower()
            if m[1]:
                if self._open_tags[tag]:
                    # An end tag closes what is open inside, but inline tags don't close blocks.
                    depth = next(k for k in range(len(self._stack) - 1, -1, -1) if self._stack[k].tag == tag)
                    if tag in BLOCK or not any(e.tag in BLOCK for e in self._stack[depth + 1 :]):
                        while len(self._stack) > depth + 1:
                            self._close()
                        self._close(source[found:at])
                elif tag in ("p", "br"):
                    self._flush() if tag == "p" else self._add(" ")
                continue
            self._open(tag, m[3], source[found:at])
            if tag in RAW and not m[3].endswith("/"):
                low = source.lower() if low is None else low  # lower() keeps lengths but for a few letters; searched by pattern then
                end = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(source, at) if len(low) != n else None
                close = end.start() if end else low.find(f"</{tag}", at) if len(low) == n else -1
                stop = n if close < 0 else close
                if close < 0:
                    at = n
                else:
                    gt = source.find(">", stop)
                    at = n if gt < 0 else gt + 1
                if self._stack and self._stack[-1].tag == tag:
                    self._close(source[stop:at])
        while self._stack:
            self._close()
        self._flush()

    def _add(self, text: str) -> None:
        if self._holders:
            self._holders[-1].parts.append(text)
        if not self._dropped and self._want:
            self._run.append(text)

    def _open(self, tag: str, attributes: str, source: str) -> None:
        if tag == "br":
            self._add(" ")
            return
        if tag in CLOSES_P and self._open_tags["p"]:
            depth = next(k for k in range(len(self._stack) - 1, -1, -1) if self._stack[k].tag == "p")
            if not any(e.tag in BLOCK for e in self._stack[depth + 1 :]):
                while len(self._stack) > depth:
                    self._close()
        for closed in (CLOSES[tag],) if tag in CLOSES and any(self._open_tags[c] for c in CLOSES[tag]) else ():
            for k in range(len(self._stack) - 1, -1, -1):
                if self._stack[k].tag in closed:
                    while len(self._stack) > k:
                        self._close()
                    break
                if self._stack[k].tag in ("ul", "ol", "dl", "table", "select", "article", "body"):
                    break
        if tag in BLOCK:
            self._flush()
        elif self._holders:
            self._holders[-1].parts.append(source)
        if tag in VOID:
            return
        dropped = self._dropped or _says_dropped(tag, attributes, self._inside)
        e = Element(tag, dropped, self._inside, len(self._blocks), source)
        e.frame = tag in ("article", "main", "h1")
        self._stack.append(e)
        if tag in BLOCK:
            self._holders.append(e)
        self._open_tags[tag] += 1
        self._dropped = dropped
        if tag in ("article", "main") and not dropped:
            self._inside = self._has_article = True


def host_salt(url: str | None) -> int:
    """The host as a number, part of every key."""
    return xxhash.xxh3_64_intdigest(canonical(url)[0])


def _page_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a page: its host's key, its own digest, its subtrees' distinct keys."""
    for batch in slices(batches, "html"):
        hosts, digests, keys = [], [], []
        for url, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            salt = host_salt(url)
            hosts.append(salt - (1 << 63))
            digests.append(xxhash.xxh3_64_intdigest(source or "", salt) - (1 << 63))
            keys.append(sorted(set(Page(source, salt, want_text=False).keys)) if source and url is not None else [])
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.int64()), pa.array(digests, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], ["host", "digest", "keys"])


def template_keys(pages: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """key of each template subtree (the key holds its host), from a written table, page_table."""
    each = pages.select("url", "html").mapInArrow(_page_keys, "host long, digest long, keys array<long>")
    each = written(each.groupBy("host", "digest").agg(F.first("keys").alias("keys")), "page-keys")
    out = each.select("host", F.explode("keys").alias("key")).groupBy("host", "key").agg(F.count("*").alias("n")).filter(F.col("n") >= min_pages).select("key")
    out.page_table = each
    return out


def _texts(keys: np.ndarray | None):
    """keys: the template, sorted; None where each page brings its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        template = frozenset(keys.tolist()) if keys is not None else None
        for batch in slices(batches, "html"):
            texts = []
            own = batch.column(3).to_pylist() if template is None else [None] * batch.num_rows
            for url, source, mine in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), own, strict=True):
                texts.append(Page(source, host_salt(url), frozenset() if url is None else template if template is not None else frozenset(mine or ())).text() if source else "")
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return run


SCHEMA = "page_id long, url string, text string, n_chars long"


def extract(pages: DataFrame, min_pages: int = MIN_PAGES, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """pages (page_id, url, html): returns page_id, url, text, n_chars for each row."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    counted = template_keys(pages, min_pages)
    template = written(counted, "template")
    remove(counted.page_table)
    if template.count() <= broadcast_keys:
        keys = np.sort(template.toArrow().column("key").to_numpy())
        return pages.mapInArrow(_texts(keys), SCHEMA)
    # Too many for a broadcast: each page's template keys by a salted join, then to the page by its digest.
    salts = 16
    with_digest = pages.select("url", "html").mapInArrow(_page_keys, "host long, digest long, keys array<long>")
    asked = with_digest.select("digest", F.explode("keys").alias("key")).distinct().withColumn("salt", F.pmod("digest", F.lit(salts)))
    spread = template.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    mine = asked.join(spread, ["key", "salt"]).groupBy("digest").agg(F.collect_list("key").alias("keys"))
    digest = F.arrow_udf(_digests, "long")
    joined = pages.withColumn("digest", digest(F.col("url"), F.col("html"))).join(written(mine, "page-templates"), "digest", "left")
    return joined.select("page_id", "url", "html", "keys").mapInArrow(_texts(None), SCHEMA)


def _digests(urls: pa.Array, sources: pa.Array) -> pa.Array:
    return pa.array([xxhash.xxh3_64_intdigest(s or "", host_salt(u)) - (1 << 63) for u, s in zip(urls.to_pylist(), sources.to_pylist(), strict=True)], pa.int64())
