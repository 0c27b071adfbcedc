"""Images that pages ask for: img elements with their srcset, and backgrounds from simple style rules."""

from __future__ import annotations

import re
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_ENTRY = pa.struct([("url", pa.string()), ("descriptor", pa.string())])
_FOUND = pa.struct(
    [("url", pa.string()), ("kind", pa.string()), ("lazy", pa.bool_()), ("attr_w", pa.int64()), ("attr_h", pa.int64()), ("css_w", pa.string()), ("css_h", pa.string()), ("srcset", pa.list_(_ENTRY))]
)
_SPARK = "array<struct<url:string,kind:string,lazy:boolean,attr_w:long,attr_h:long,css_w:string,css_h:string,srcset:array<struct<url:string,descriptor:string>>>>"
_VALID = re.compile(r"(\d+(?:\.\d+)?[wx])?", re.IGNORECASE)


def srcset_entries(text: str) -> list[dict[str, str]]:
    """Entries (url, descriptor) of a srcset, w before x, larger first; invalid descriptors and repeats dropped."""
    out, at = [], 0
    while m := re.compile(r"[\s,]*(\S+)").match(text, at):
        url, at = m[1], m.end()
        if url.endswith(","):
            descriptor, url = "", url.rstrip(",")
        else:
            end = text.find(",", at)
            end = len(text) if end < 0 else end
            descriptor, at = text[at:end].strip(), end + 1
        if url and _VALID.fullmatch(descriptor):
            out.append((descriptor.lower() or "1x", url))
    ranked = sorted(dict.fromkeys(out), key=lambda e: (e[0][-1] == "x", -float(e[0][:-1])))
    return [{"url": u, "descriptor": d} for d, u in ranked]


def declarations(text: str) -> dict[str, str]:
    pairs = (d.partition(":") for d in text.split(";"))
    return {k.strip().lower(): v.strip() for k, c, v in pairs if c and k.strip()}


def style_rules(text: str) -> list[tuple[str, dict[str, str]]]:
    """(selector, declarations) of rules for a single tag, class or id; comments and at-rules are passed over."""
    text, out, at = re.sub(r"/\*.*?\*/", "", text, flags=re.DOTALL), [], 0
    while m := re.compile(r"\s*([^{};]*)([{;])").match(text, at):
        head, at = m[1].strip(), m.end()
        if m[2] == ";":
            continue
        depth, start = 1, at
        while at < len(text) and depth:
            depth += {"{": 1, "}": -1}.get(text[at], 0)
            at += 1
        if not head.startswith("@"):
            body = declarations(text[start : at - 1])
            out += [(s.strip(), body) for s in head.split(",") if re.fullmatch(r"[.#]?[A-Za-z_][\w-]*", s.strip())]
        at += len(re.compile(r"\s*\}?").match(text, at)[0]) if text[at : at + 1] == "}" else 0
    return out


class _Images(HTMLParser):
    def __init__(self, rules: list[tuple[str, dict[str, str]]]):
        super().__init__()
        self.rules, self.found, self.picture = rules, [], None

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        a = {k: v or "" for k, v in attrs}
        names = {tag, *(f".{c}" for c in a.get("class", "").split()), f"#{a.get('id', '')}"}
        css: dict[str, str] = {}
        for selector, body in self.rules:
            if selector in names or selector.lower() == tag:
                css |= body
        css |= declarations(a.get("style", ""))
        if tag == "picture":
            self.picture = []
        elif tag == "source" and self.picture is not None:
            self.picture += srcset_entries(a.get("srcset", ""))
        elif tag == "img":
            entries = list({(e["url"], e["descriptor"]): e for e in [*srcset_entries(a.get("srcset", "")), *(self.picture or [])]}.values())
            url = a.get("src", "").strip() or (entries[0]["url"] if entries else "")
            if url:
                self._add(url, "img", a.get("loading", "").lower() == "lazy", a, css, entries)
        if m := re.search(r"url\(\s*(['\"]?)(.*?)\1\s*\)", css.get("background-image") or css.get("background", "")):
            self._add(m[2], "background", False, {}, css, [])

    def handle_endtag(self, tag: str) -> None:
        if tag == "picture":
            self.picture = None

    def _add(self, url: str, kind: str, lazy: bool, a: dict[str, str], css: dict[str, str], entries: list[dict[str, str]]) -> None:
        if not url.lower().startswith("data:"):
            size = [int(v) if re.fullmatch(r"[1-9]\d{0,8}", v := a.get(k, "").strip()) else None for k in ("width", "height")]
            self.found.append({"url": url, "kind": kind, "lazy": lazy, "attr_w": size[0], "attr_h": size[1], "css_w": css.get("width"), "css_h": css.get("height"), "srcset": entries})


def _resolved(base: str, url: str) -> str | None:
    """The URL that a page's base makes of one; None where there is none, as for a host that is no address."""
    try:
        return urljoin(base, url)
    except ValueError:
        return None


def images_of(html: str, base: str) -> list[dict]:
    rules = style_rules("\n".join(re.findall(r"<style[^>]*>(.*?)</style", html, re.DOTALL | re.IGNORECASE)))
    page = _Images(rules)
    page.feed(html)
    for f in page.found:
        f["url"] = _resolved(base, f["url"])
        f["srcset"] = [e | {"url": url} for e in f["srcset"] if (url := _resolved(base, e["url"])) is not None]
    return [f for f in page.found if f["url"] is not None]


def found_images(html: Column, base: Column) -> Column:
    @F.arrow_udf(_SPARK)
    def found(pages: pa.Array, bases: pa.Array) -> pa.Array:
        return pa.array([images_of(p or "", b or "") for p, b in zip(pages.to_pylist(), bases.to_pylist())], pa.list_(_FOUND))

    return found(html, base)


def images(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, idx, url, kind, lazy, attr_w, attr_h, css_w, css_h, srcset): the images of pages (key, url, html), in document order."""
    return pages.select(key, F.posexplode(found_images(F.col("html"), F.col("url"))).alias("idx", "i")).select(key, "idx", "i.*")


def robots_allow(robots: Column, path: Column, agent: str) -> Column:
    """Whether a robots file lets an agent fetch a path: the longest rule of its group wins, allow on ties;
    no file, no group or no rule allows."""
    name = agent.split("/")[0].lower()

    @F.arrow_udf("boolean")
    def allow(files: pa.Array, paths: pa.Array) -> pa.Array:
        out = []
        for text, p in zip(files.to_pylist(), paths.to_pylist()):
            groups: dict[str, list[tuple[bool, str]]] = {}
            current: list[str] = []
            open_ = False
            for line in (text or "").splitlines():
                k, _, v = (x.strip() for x in line.split("#")[0].partition(":"))
                k = k.lower()
                if k == "user-agent":
                    current = [*current, v.lower()] if open_ else [v.lower()]
                    open_ = True
                    groups.setdefault(v.lower(), [])
                elif k in ("allow", "disallow"):
                    open_ = False
                    for g in current:
                        if v:
                            groups[g].append((k == "allow", v))
            rules = groups.get(name, groups.get("*", []))
            hits = [(len(r), ok) for ok, r in rules if re.match(re.escape(r).replace(r"\*", ".*").removesuffix(r"\$") + ("$" if r.endswith("$") else ""), p or "/")]
            out.append(max(hits)[1] if hits else True)
        return pa.array(out, pa.bool_())

    return allow(robots, path)
