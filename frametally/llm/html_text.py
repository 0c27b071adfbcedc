"""Main text of HTML pages, with site templates found by counting element subtrees.

A page is parsed into a tree of elements.  Every block element's subtree has a
hash of its tags and text, and outside articles one of its shape, in which the
texts of links don't count: menus recur though their items differ.  Spark counts, for each host, on how many different
pages each subtree stands; a subtree on at least ``PAGES`` pages and ``SHARE``
of its host's pages, or on ``OFTEN`` pages, is template and is deleted wherever
it stands on that host, unless nothing of a page would be left.  What
HTML itself marks as no part of the article (menus, headers, footers, sidebars,
forms, notices, adverts, reader comments, scripts, styles) goes on any page.
Running text inside an article is never template: a sentence that many articles
share stays.

If a page has an article or main element, its text is that of those elements;
otherwise that of the whole body.

Defined results: null or empty html gives an empty text; a null url is a host of
its own; rows of equal html count as one page of a host and get equal texts; text
with broken markup is read as a browser would roughly read it, unclosed
elements ending with their parent; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frametally.llm.shared import stored

#: A template stands on at least this many of its host's pages, and this share of them or OFTEN pages.
PAGES = 8
SHARE = 0.25
OFTEN = 1000

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<rest>(?>\"[^\"]*+\"|'[^']*+'|[^'\">])*+)>|[^<]++|<", re.DOTALL
)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.IGNORECASE)

# Elements of HTML by kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody tfoot thead tr ul".split()
)
APART = BLOCK | {"td", "th", "br", "caption"}
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dd dt td th tr".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
NO_TEXT = frozenset(
    "head title script style noscript template iframe object embed svg math canvas audio video map nav menu footer header aside form button select "
    "textarea input label fieldset datalist dialog textarea noembed noframes xmp".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
#: Parts of class names and ids that mark what is no part of an article.
MARKS = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertising banner breadcrumb breadcrumbs byline captcha comment comments commentlist consent cookie "
    "cookies copyright disclaimer discussion disqus footer footnav gdpr header login masthead menu modal nav navbar navigation newsletter notice overlay "
    "pager pagination popup promo promoted recommended related replies reply respond share sharing sidebar signup skip social sponsor sponsored subscribe "
    "subscription toolbar widget".split()
)
#: An open element of the first kind ends where one of the second begins.
CLOSES = {"p": BLOCK - {"option", "optgroup"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot", "thead"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option", "optgroup"}}

CLOSED_BY = {tag: [t for t, by in CLOSES.items() if tag in by] for tag in frozenset().union(*CLOSES.values())}


@dataclass
class Element:
    tag: str
    marked: bool = False
    inner: list = field(default_factory=list)  # elements and strings, in order


def _marked(tag: str, rest: str) -> bool:
    if tag in NO_TEXT:
        return True
    if "=" not in rest and "hidden" not in rest:
        return False
    for name, value in _ATTRIBUTE.findall(rest):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "role" and value in ROLES:
            return True
        if name in ("class", "id") and tag not in ("html", "body", "article", "main") and not MARKS.isdisjoint(re.split(r"[^a-z0-9]+", value)):
            return True
        if name in ("class", "id") and tag == "article" and not {"comment", "comments", "reply", "ad", "advert", "sponsored"}.isdisjoint(re.split(r"[^a-z0-9]+", value)):
            return True
    return False


def parse(page: str) -> Element:
    """The tree of a page."""
    root = Element("#root")
    stack = [root]
    # how many of each tag are open: looking through the stack for one that isn't would cost its depth at every tag
    opened: Counter[str] = Counter()
    at, n = 0, len(page)

    def shut(i: int) -> None:
        opened.subtract(e.tag for e in stack[i:])
        del stack[i:]

    while at < n:
        m = _TOKEN.match(page, at)
        at = m.end()
        tag = m["tag"]
        if tag is None:
            token = m[0]
            if token[0] != "<" or len(token) == 1:
                stack[-1].inner.append(token)
            continue
        tag = tag.lower()
        if m["close"]:
            for i in range(len(stack) - 1, 0, -1) if opened[tag] else ():
                if stack[i].tag == tag:
                    shut(i)
                    break
                if tag not in APART and stack[i].tag in BLOCK:
                    break  # an inline end tag ends nothing outside its block
            continue
        while len(stack) > 1 and tag in BLOCK and stack[-1].tag not in APART and opened["p"]:
            shut(len(stack) - 1)  # inline elements left open end with their paragraph
        for i in range(len(stack) - 1, 0, -1) if any(opened[t] for t in CLOSED_BY.get(tag, ())) else ():
            if tag in CLOSES.get(stack[i].tag, ()):
                shut(i)
                break
            if stack[i].tag in BLOCK and stack[i].tag not in CLOSES or stack[i].tag == "table":
                break
        e = Element(tag, _marked(tag, m["rest"]))
        stack[-1].inner.append(e)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.IGNORECASE).search(page, at)
            stop = end.start() if end else n
            if tag not in ("script", "style"):
                e.inner.append(page[at:stop])
            at = end.end() if end else n
        elif tag not in VOID and not m["rest"].endswith("/"):
            stack.append(e)
            opened[tag] += 1
    return root


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def _walk(root: Element):
    """(element, hashes, inside an article) of every block element, inner ones first.

    The first hash is of all tags and text.  Outside articles a subtree with
    links has a second one, in which a link's text doesn't count and equal
    neighbours count once, so menus of other items, and of more, have it too.
    """
    out = []
    # an explicit stack: pages may nest deeper than Python calls
    work = [(root, False, 0, [], [])]
    while work:
        e, article, i, parts, shape = work.pop()
        while i < len(e.inner):
            x = e.inner[i]
            i += 1
            if isinstance(x, str):
                text = " ".join(x.split())
                parts.append(text)
                if text and e.tag != "a" and shape[-1:] != [text]:
                    shape.append(text)
            else:
                work.append((e, article, i, parts, shape))
                work.append((x, article or x.tag in ("article", "main"), 0, [], []))
                break
        else:
            h = xxhash.xxh64_intdigest("\0".join([e.tag, *parts]).encode("utf-8", "replace"))
            linked = e.tag == "a" or any(p.startswith("\1") for p in shape)
            g = xxhash.xxh64_intdigest("\0".join(["\1", e.tag, *shape]).encode("utf-8", "replace"))
            if work:
                work[-1][3].append(f"{h:x}")
                own = f"\1{g:x}" if linked else f"{h:x}"
                if work[-1][4][-1:] != [own]:
                    work[-1][4].append(own)
            if e.tag in BLOCK and parts:
                out.append((e, (_signed(h), _signed(g)) if linked and not article else (_signed(h),), article))
    return out


def _candidates(page: str) -> list[int]:
    """Hashes of the subtrees that may be template: all blocks but running text, articles and their parents."""
    keep = {"#root", "html", "body", "article", "main"}
    return list({h for e, hashes, article in _walk(parse(page)) if e.tag not in keep and not (article and e.tag in PROSE) for h in hashes})


def main_text(page: str, template: frozenset[int] = frozenset()) -> str:
    """The blocks of a page's main text, joined by two line ends; with templates if they hold all of it."""
    return _blocks(page, template) or (_blocks(page, frozenset()) if template else "")


def _blocks(page: str, template: frozenset[int]) -> str:
    root = parse(page)
    gone = {id(e) for e, hashes, article in _walk(root) if not template.isdisjoint(hashes) and not (article and e.tag in PROSE)} if template else ()
    mains = _mains(root, gone)
    blocks: list[str] = []
    for top in mains or [root]:
        text: list[str] = []

        def flush() -> None:
            whole = " ".join(html.unescape("".join(text)).split())
            if whole:
                blocks.append(whole)
            text.clear()

        work: list = [top]
        while work:
            x = work.pop()
            if x is None:
                flush()
            elif isinstance(x, str):
                text.append(x)
            else:
                if id(x) in gone:
                    continue
                if x.marked and x is not top:
                    if x.tag == "header" and mains:  # an article's own title may stand in a header
                        work += [None, *reversed([h for h in x.inner if isinstance(h, Element) and h.tag in HEADING]), None]
                    continue
                if x.tag in ("br", "td", "th", "img"):
                    text.append(" ")
                block = x.tag in BLOCK or x.tag == "caption"
                if block:
                    work.append(None)
                work += reversed(x.inner)
                if block:
                    work.append(None)
        flush()
    return "\n\n".join(blocks)


def _mains(root: Element, gone) -> list[Element]:
    """The outermost article and main elements that stand in nothing that goes; of a main that holds others, those."""
    out: list[Element] = []
    work: list = [root]
    while work:
        e = work.pop()
        if isinstance(e, tuple):  # the end of a main, and how many there were at its beginning
            if len(out) == e[1]:
                out.append(e[0])
            continue
        if isinstance(e, str) or e.marked or id(e) in gone:
            continue
        if e.tag == "article":
            out.append(e)
            continue
        if e.tag == "main":
            work.append((e, len(out)))
        work += reversed(e.inner)
    return out


def subtree_hashes(page: Column) -> Column:
    @F.arrow_udf("array<long>")
    def hashes(pages: pa.Array) -> pa.Array:
        return pa.array([_candidates(p or "") for p in pages.to_pylist()], pa.list_(pa.int64()))

    return hashes(page)


def text_without(page: Column, template: Column) -> Column:
    @F.arrow_udf("string")
    def text(pages: pa.Array, templates: pa.Array) -> pa.Array:
        return pa.array([main_text(p or "", frozenset(t or ())) for p, t in zip(pages.to_pylist(), templates.to_pylist())], pa.string())

    return text(page, template)


def host(url: Column) -> Column:
    return F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)


def templates(seen: DataFrame, pages: int = PAGES, share: float = SHARE, often: int = OFTEN) -> DataFrame:
    """(host, hash) of the template subtrees of pages (host, k2, hashes); pages of one host and k2 are one."""
    one = seen.groupBy("host", "k2").agg(F.first("hashes").alias("hashes"))
    total = seen.groupBy("host").agg(F.countDistinct("k2").alias("pages"))
    count = one.select("host", F.explode("hashes").alias("hash")).groupBy("host", "hash").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= pages)
    return count.join(total, "host").where((F.col("n") >= F.col("pages") * share) | (F.col("n") >= often)).select("host", "hash")


def extract(pages: DataFrame, least_pages: int = PAGES, share: float = SHARE) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of pages (page_id, url, html)."""
    keys = [F.xxhash64("page_id", "url").alias("k1"), F.xxhash64(F.coalesce("html", F.lit(""))).alias("k2")]
    seen = stored(pages.select(*keys, host(F.col("url")).alias("host"), subtree_hashes(F.col("html")).alias("hashes")), "subtrees")
    known = stored(templates(seen, least_pages, share), "templates")
    placed = seen.select("k1", "k2", "host", F.explode("hashes").alias("hash")).join(known, ["host", "hash"])
    of_page = stored(placed.groupBy("k1", "k2").agg(F.collect_set("hash").alias("template")), "template")
    joined = pages.select("page_id", "url", "html", *keys).join(of_page, ["k1", "k2"], "left")
    text = joined.select("page_id", "url", text_without(F.col("html"), F.col("template")).alias("text"))
    return text.withColumn("n_chars", F.length("text").cast("long"))
