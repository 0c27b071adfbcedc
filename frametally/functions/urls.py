"""URLs taken apart as text, and better sources proposed from their shape.

Parts that aren't touched stay byte for byte, so nothing is parsed and printed
again.  Each builder returns an array of structs (url, via), in order of trust.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

IMAGE = r"(?i)\.(avif|gif|jpe?g|png|webp)$"
# Prefixes of transformation segments and names of transformation parameters.
SEGMENT_PREFIXES = "a ar b bo br c co cs dl dn dpr du e eo f fl fn g h ki l o q r so sp t u vc vs w x y z".split()
PARAMETERS = "ar auto crop cs dpr fit fm h q rect w".split()
VIA = ("wordpress", "nextjs", "shopify", "cdn", "srcset", "retina")
_TYPE = "array<struct<url:string,via:string>>"


def parts(url: Column) -> dict[str, Column]:
    """path, query and hash (each with its mark), and directory, name, stem and ext of the path."""
    before = F.substring_index(url, "#", 1)
    path = F.substring_index(before, "?", 1)
    name = F.regexp_extract(path, r"([^/\\]*)$", 1)
    stem = F.when(name.rlike(r"^.+\.[^.]*$"), F.regexp_extract(name, r"^(.+)\.[^.]*$", 1)).otherwise(name)
    return {
        "path": path,
        "query": F.substr(before, F.length(path) + 1),
        "hash": F.substr(url, F.length(before) + 1),
        "dir": F.substr(path, F.lit(1), F.length(path) - F.length(name)),
        "name": name,
        "stem": stem,
        "ext": F.substr(name, F.length(stem) + 1),
    }


def pairs(query: Column) -> Column:
    """The raw pairs of a query, in order."""
    return F.filter(F.split(F.substr(query, F.lit(2)), "&", -1), lambda p: p != "")


def key_of(pair: Column) -> Column:
    return F.substring_index(pair, "=", 1)


def value_of(pair: Column) -> Column:
    return F.substr(pair, F.length(F.substring_index(pair, "=", 1)) + 2)


def origin(url: Column) -> Column:
    return F.regexp_extract(url, r"^((?i)[a-z][a-z0-9+.-]*://[^/?#]*)", 1)


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^(?i)[a-z][a-z0-9+.-]*://(?:[^@/?#]*@)?([^:/?#]+)", 1))


def _offers(url: Column, via: str, *found: Column) -> Column:
    """Those proposals that are set and differ from the URL, first occurrences only."""
    kept = F.array_distinct(F.filter(F.array(*found), lambda u: u.isNotNull() & (u != url)))
    return F.transform(kept, lambda u: F.struct(u.alias("url"), F.lit(via).alias("via")))


def wordpress(url: Column) -> Column:
    """The upload behind a sized, scaled or rotated rendition."""
    p = parts(url)
    sized = F.regexp_replace(p["stem"], r"-\d{1,5}x\d{1,5}$", "")
    bare = F.regexp_replace(sized, r"(?i)-(scaled|rotated)$", "")
    fits = p["name"].rlike(IMAGE) & (bare != p["stem"]) & (bare != "")
    whole = F.when(fits, F.concat(p["dir"], bare, p["ext"], p["query"], p["hash"]))
    scaled = F.when(fits & (sized != p["stem"]), F.concat(p["dir"], bare, F.lit("-scaled"), p["ext"], p["query"], p["hash"]))
    return _offers(url, "wordpress", whole, scaled)


def nextjs(url: Column) -> Column:
    """The image an optimiser's url parameter names."""
    p = parts(url)
    raw = value_of(F.get(F.filter(pairs(p["query"]), lambda x: key_of(x) == "url"), F.lit(0)))
    # url_decode reads + as a space, which percent decoding of a component doesn't
    decoded = F.try_url_decode(F.replace(raw, F.lit("+"), F.lit("%2B")))
    target = F.when(decoded.rlike(r"^((?i)https?:)?//"), decoded).when(decoded.startswith("/"), F.concat(origin(url), decoded))
    return _offers(url, "nextjs", F.when(p["path"].endswith("/_next/image"), target))


def shopify(url: Column) -> Column:
    """The upload behind a shop rendition's chain of size, crop and scale tokens."""
    p = parts(url)
    chain = r"(?i)(@[23]x|_crop_(top|center|bottom|left|right)|_(\d{1,5}x\d{0,5}|x\d{1,5})|_(pico|icon|thumb|small|compact|medium|large|grande|original|master))+$"
    stem = F.regexp_replace(p["stem"], chain, "")
    shop = (host(url) == "cdn.shopify.com") | host(url).endswith(".cdn.shopify.com") | p["path"].contains("/cdn/shop/")
    fits = shop & p["name"].rlike(IMAGE) & (stem != p["stem"]) & (stem != "")
    return _offers(url, "shopify", F.when(fits, F.concat(p["dir"], stem, p["ext"], p["query"], p["hash"])))


def cdn(url: Column) -> Column:
    """The stored original behind transformation segments of the path and parameters of the query."""
    p = parts(url)
    marker = "/image/upload/"
    at = F.instr(p["path"], marker)
    segments = F.split(F.substr(p["path"], at + len(marker)), "/", -1)
    chunk = "^(" + "|".join(SEGMENT_PREFIXES) + r")_[^\r\n]+$"
    plain = F.transform(segments, lambda s: ~F.forall(F.split(s, ",", -1), lambda c: c.rlike(chunk)))
    leading = F.when(F.array_position(plain, True) > 0, F.array_position(plain, True) - 1).otherwise(F.size(segments))
    skipped = F.least(leading, F.size(segments) - 1)
    stripped = (at > 0) & (skipped > 0)
    clean = F.concat(F.substr(p["path"], F.lit(1), at + len(marker) - 1), F.array_join(F.slice(segments, skipped + 1, F.size(segments) - skipped), "/"))
    kept = F.filter(pairs(p["query"]), lambda x: ~F.lower(key_of(x)).isin(PARAMETERS))
    query = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    asked = p["name"].rlike(IMAGE) & ~p["path"].endswith("/_next/image") & (F.size(kept) < F.size(pairs(p["query"])))
    return _offers(
        url,
        "cdn",
        F.when(stripped & asked, F.concat(clean, query, p["hash"])),
        F.when(stripped, F.concat(clean, p["query"], p["hash"])),
        F.when(asked, F.concat(p["path"], query, p["hash"])),
    )


def descriptor(text: Column) -> Column:
    """struct(value, unit) of a srcset descriptor; none means 1x; null where it is invalid."""
    t = F.lower(F.trim(text))
    return F.when(t == "", F.struct(F.lit(1.0).alias("value"), F.lit("x").alias("unit"))).when(
        t.rlike(r"^\d+(\.\d+)?[wx]$"), F.struct(F.regexp_extract(t, r"^([\d.]+)", 1).cast("double").alias("value"), F.right(t, F.lit(1)).alias("unit"))
    )


def srcset(url: Column, entries: Column) -> Column:
    """Entries (url, descriptor) larger than the one in use; all others, largest first, where the URL isn't listed."""
    entries = F.coalesce(entries, F.array().cast("array<struct<url:string,descriptor:string>>"))
    now = descriptor(F.get(F.filter(entries, lambda e: e["url"] == url), F.lit(0))["descriptor"])
    rest = F.transform(F.filter(entries, lambda e: e["url"] != url), lambda e, i: F.struct(descriptor(e["descriptor"]).alias("d"), i.alias("i"), e["url"].alias("url")))
    pool = F.filter(rest, lambda e: now.isNull() | (e["d"]["unit"] == now["unit"]) & (e["d"]["value"] > now["value"]))
    ranked = F.array_sort(F.transform(pool, lambda e: F.struct((-F.coalesce(e["d"]["value"], F.lit(0.0))).alias("rank"), e["i"].alias("i"), e["url"].alias("url"))))
    return F.transform(F.array_distinct(F.transform(ranked, lambda e: e["url"])), lambda u: F.struct(u.alias("url"), F.lit("srcset").alias("via")))


def retina(url: Column) -> Column:
    """Siblings at twice and three times the density of a name without a density mark."""
    p = parts(url)
    fits = p["name"].rlike(IMAGE) & (p["stem"] != "") & ~p["stem"].rlike(r"(?i)@\d+(\.\d+)?x$")
    return _offers(url, "retina", *[F.when(fits, F.concat(p["dir"], p["stem"], F.lit(m), p["ext"], p["query"], p["hash"])) for m in ("@2x", "@3x")])


def proposals(assets: DataFrame, key: str, url_col: str = "url", srcset_col: str | None = None) -> DataFrame:
    """(key, ord, url, via): all proposals of an asset, recoverer by recoverer, first occurrence of a URL only."""
    u = F.col(url_col)
    listed = F.col(srcset_col) if srcset_col else F.lit(None).cast("array<struct<url:string,descriptor:string>>")
    found = F.concat(*[x.cast(_TYPE) for x in (wordpress(u), nextjs(u), shopify(u), cdn(u), srcset(u, listed), retina(u))])
    rows = assets.select(key, F.posexplode(found).alias("at", "p")).select(key, "at", "p.url", "p.via")
    first = rows.groupBy(key, "url").agg(F.min(F.struct("at", "via")).alias("f"))
    return first.select(key, F.col("f.at").alias("ord"), "url", F.col("f.via").alias("via"))


def normalised(url: Column) -> Column:
    """One form of a URL: scheme and host in lower case, no credentials, default port or fragment, parameters in
    order of their names and encoded alike; what is no absolute URL stays."""
    scheme, at = F.lower(F.regexp_extract(url, r"^([a-zA-Z][a-zA-Z0-9+.-]*)://", 1)), F.lower(F.regexp_extract(url, r"^[^:]*://(?:[^/?#]*@)?([^/?#@]*)", 1))
    at = F.when(scheme == "http", F.regexp_replace(at, ":80$", "")).when(scheme == "https", F.regexp_replace(at, ":443$", "")).otherwise(at)
    before = F.substring_index(url, "#", 1)
    query = F.when(before.contains("?"), F.regexp_extract(before, r"(?s)\?(.*)$", 1)).otherwise("")
    path = F.regexp_extract(F.substring_index(before, "?", 1), r"^[^:]*://[^/]*(.*)$", 1)
    # in order of names; pairs of one name keep theirs
    named = F.transform(pairs(F.concat(F.lit("?"), query)), lambda p, i: F.struct(_decoded(key_of(p)).alias("k"), i.alias("i"), _decoded(value_of(p)).alias("v")))
    sorted_ = F.array_join(F.transform(F.array_sort(named), lambda p: F.concat(F.url_encode(p["k"]), F.lit("="), F.url_encode(p["v"]))), "&")
    whole = F.concat(scheme, F.lit("://"), at, F.when(path == "", "/").otherwise(path), F.when(sorted_ == "", "").otherwise(F.concat(F.lit("?"), sorted_)))
    return F.when((scheme != "") & (at != ""), whole).otherwise(url)


def _decoded(text: Column) -> Column:
    return F.coalesce(F.try_url_decode(text), text)
