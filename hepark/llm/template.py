"""Main text of web pages by site template removal.

Each page is cut into blocks of text; every element that holds text has a hash of its
subtree (tags, class names and text).  Spark counts, per host, on how many different pages
each subtree recurs, and subtrees found on ``min_pages`` pages or more are deleted from
the host's pages: menus, headers, footers and adverts by what they are, whatever
they are called.  What markup itself names as boilerplate (``nav``, ``footer``, ``aside``, forms,
roles, hidden parts, whole class names such as ``sidebar`` or ``cookie-banner``) goes as well,
on hosts with few pages too; a page that marks its content (``article``, ``main``) keeps
only that.

The article is never a template: inside the marked content paragraphs, headings, quotes,
lists without links and tables stay however often the host repeats them; containers
(div, section, link lists) do not.  Equal pages count as one page.

The pages are parsed twice: for the subtrees (hashes and block numbers only) and, with
the recurring ones of each page joined to it, for the text.  A host with a third of all
pages is counted with partial sums; the join on (host, subtree) has one row a subtree on
its small side, and the join that brings the spans to their pages goes by a
128-bit hash of the page.

Edge cases: null or empty html gives an empty text; a page without markup is its
own text; a null url is a host of its own; unclosed and stray tags are tolerated;
rows that share a page_id are kept apart, equal pages of a host share their text; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import html as _html
import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hepark.llm.common import staged

# HTML vocabulary.
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "template", "svg", "math", "object"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd",
          "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var"}
PROSE = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "table", "tbody", "thead", "tr", "td", "th",
         "dl", "dt", "dd", "figure", "figcaption", "li"}
BOILERPLATE = {"head", "nav", "footer", "aside", "form", "button", "select", "dialog", "menu", "fieldset"}
NOISE_WORDS = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs",
               "comment", "comments", "consent", "cookie", "cookies", "disqus", "footer", "gdpr", "header", "masthead",
               "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "notification",
               "pagination", "popup", "promo", "promoted", "promotion", "related", "replies", "reply", "respond",
               "share", "sharing", "sidebar", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget"}
#: Parts that a compound class name may have beside those words: "site-header" is
#: boilerplate, "entry-header" and "notice-period" are not.
NEUTRAL_WORDS = {"site", "page", "top", "left", "right", "bottom", "main", "box", "bar", "list", "block", "area", "section",
                 "container", "wrapper", "wrap", "inner", "outer", "links", "link", "buttons", "button", "post", "posts",
                 "articles", "items", "item", "form", "thread", "slot", "unit", "cta", "global", "primary", "secondary", "js"}
#: Inside the marked content these are parts of the article.
ARTICLE_WORDS = {"header", "masthead", "banner"}
NOISE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "alert", "dialog", "menu", "menubar"}

TOKEN = re.compile(r"""<(?:!--.*?(?:-->|\Z)|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*+>|[^>]*+(?:>|\Z)))""",
                   re.S)
ATTRIBUTE = re.compile(r"""([a-zA-Z_:-]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
PARTS = re.compile(r"[a-z]+|[0-9]+")
#: Elements that a new one of the key ends.
CLOSES = {"li": {"li"}, "p": {"p"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
          "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}


class _Element:
    __slots__ = ("tag", "noise", "root", "inside", "first", "links", "digest")

    def __init__(self, tag, noise, root, inside, first, name):
        self.tag, self.noise, self.root, self.first, self.links = tag, noise, root, first, 0
        self.inside = inside                                # in the marked content, or its root
        self.digest = xxhash.xxh64(name.encode())


def _attributes(text: str) -> dict[str, str]:
    return {k.lower(): v.strip("\"'") for k, v in ATTRIBUTE.findall(text)}


def _names_noise(name: str, inside: bool) -> bool:
    """Does a whole class name or id say that the element is boilerplate?"""
    parts = [p for p in PARTS.findall(name) if not p.isdigit()]
    noise = NOISE_WORDS - ARTICLE_WORDS if inside else NOISE_WORDS
    return any(p in noise for p in parts) and all(p in noise or p in NEUTRAL_WORDS for p in parts)


def _is_noise(tag: str, at: dict[str, str], inside: bool) -> bool:
    if tag in BOILERPLATE or (tag == "header" and not inside):
        return True
    if not at:
        return False
    names = [*at.get("class", "").lower().split(), at.get("id", "").lower()]
    style = at.get("style", "").replace(" ", "").lower()
    return bool(tag not in ("html", "body", "main", "article") and any(_names_noise(n, inside) for n in names)
                or at.get("role", "").lower() in NOISE_ROLES or "hidden" in at
                or at.get("aria-hidden") == "true" or "display:none" in style)


def parse(text: str) -> tuple[list[str], list[bool], list[tuple[int, int, int]]]:
    """(blocks, may the block be content, subtrees): a block may be content if no named
    boilerplate holds it and it lies in the marked content of a page that marks any; a
    subtree is (hash, first block, past the last block) of an element that a template
    may consist of."""
    blocks: list[str] = []
    named: list[bool] = []
    inner: list[bool] = []
    subtrees: list[tuple[int, int, int]] = []
    stack: list[_Element] = []
    run: list[str] = []

    def flush() -> None:
        block = " ".join(_html.unescape("".join(run)).split()) if run else ""
        run.clear()
        if block:
            blocks.append(block)
            top = stack[-1] if stack else None
            named.append(bool(top and top.noise))
            inner.append(bool(top and top.inside))
            if top:
                top.digest.update(b"\x00" + block.encode("utf-8", "replace"))

    def pop() -> None:
        e = stack.pop()
        up = stack[-1] if stack else None
        if e.tag not in INLINE and e.first < len(blocks) and not e.root and e.tag not in ("html", "body"):
            plain = e.tag in PROSE or e.tag in ("ul", "ol") and not e.links
            if not (plain and (e.inside or up and up.noise)):
                subtrees.append((e.digest.intdigest() - (1 << 63), e.first, len(blocks)))
        if up:
            up.links += e.links
            up.digest.update(b"\x01" + e.digest.digest())

    def close_to(i: int) -> None:
        while len(stack) > i:
            if stack[-1].tag not in INLINE:
                flush()
            pop()

    at, end = 0, len(text)
    while at < end:
        m = TOKEN.search(text, at)
        stop = m.start() if m else end
        if stop > at:
            run.append(text[at:stop])
        if not m:
            break
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:                                            # an end tag
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].tag == tag:
                    close_to(i)
                    break
            continue
        if tag == "br" or tag == "hr":
            flush()
        if tag in VOID:
            continue
        if tag in RAW:
            done = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(text, at)
            at = done.end() if done else (at if tag in ("noscript", "svg", "math", "object") else end)
            continue
        attributes = _attributes(m[3]) if "=" in (m[3] or "") or "hidden" in (m[3] or "") else {}
        inside = bool(stack and stack[-1].inside)
        root = tag in ("article", "main") or attributes.get("role", "").lower() in ("main", "article")
        own = _is_noise(tag, attributes, inside)
        if root and not own and not inside:                 # an unclosed part before it ends here
            flush()
            close_to(next((i for i, e in enumerate(stack) if e.noise), len(stack)))
            inside = bool(stack and stack[-1].inside)
        if tag not in INLINE:
            flush()
            if tag in CLOSES:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i].tag in CLOSES[tag]:
                        close_to(i)
                        break
                    if stack[i].tag not in INLINE:
                        break
        noise = own or bool(stack and stack[-1].noise)
        root = root and not noise
        e = _Element(tag, noise, root, inside or root, len(blocks), f"{tag} {attributes.get('class', '')}")
        e.links = int(tag == "a")
        stack.append(e)
    flush()
    close_to(0)
    marked = any(i and not n for i, n in zip(inner, named))
    return blocks, [not n and (i or not marked) for i, n in zip(inner, named)], subtrees


TREES = "host string, h1 long, h2 long, page long, hash long, first int, past int"


def _trees(batches):
    """The subtrees of each page, and a digest of its blocks."""
    for batch in batches:
        at, rows = [], []
        for r, text in enumerate(batch.column(3)):
            blocks, _, trees = parse(text.as_py())
            page = xxhash.xxh64("\n".join(blocks).encode("utf-8", "replace")).intdigest() - (1 << 63)
            at += [r] * len(trees)
            rows += [(page, *t) for t in trees]
        page, tree, first, past = zip(*rows) if rows else ((), (), (), ())
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(i).take(pa.array(at, pa.int64())) for i in range(3)), pa.array(page, pa.int64()),
             pa.array(tree, pa.int64()), pa.array(first, pa.int32()), pa.array(past, pa.int32())],
            ["host", "h1", "h2", "page", "hash", "first", "past"])


def _texts(batches):
    """page_id, url, html and the page's recurring subtrees -> its text."""
    for batch in batches:
        texts, gone = [], []
        for html, spans in zip(batch.column(2), batch.column(3)):
            blocks, content, _ = parse(html.as_py())
            template = [False] * len(blocks)
            for span in spans.as_py() or ():
                template[span["first"]:span["past"]] = [True] * (span["past"] - span["first"])
            texts.append(" ".join(b for b, c, t in zip(blocks, content, template) if c and not t))
            gone.append(sum(template))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()),
             pa.array([len(t) for t in texts], pa.int64()), pa.array(gone, pa.int64())],
            ["page_id", "url", "text", "n_chars", "n_template"])


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                      min_pages: int = 5) -> DataFrame:
    """page_id, url, text, n_chars, n_template (blocks deleted because their subtree recurs
    on the host; named boilerplate that does not recur goes too, but is not counted)."""
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    key = [host.alias("host"), F.xxhash64(html).alias("h1"), F.xxhash64(F.lit("second"), html).alias("h2")]
    trees = staged(pages.select(*key, html.alias("html")).mapInArrow(_trees, TREES), "template-trees")
    often = trees.groupBy("host", "hash", "page").agg(F.lit(1).alias("x")).groupBy("host", "hash") \
        .agg(F.count("*").alias("n")).where(F.col("n") >= min_pages).select("host", "hash")
    often = staged(often, "template-subtrees")
    gone = trees.join(often, ["host", "hash"]).groupBy("host", "h1", "h2").agg(
        F.collect_set(F.struct("first", "past")).alias("gone"))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                        html.alias("html"), *key)
    return rows.join(staged(gone, "template-spans"), ["host", "h1", "h2"], "left") \
        .select("page_id", "url", "html", "gone") \
        .mapInArrow(_texts, "page_id long, url string, text string, n_chars long, n_template long")
