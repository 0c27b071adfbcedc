"""File containers by their first bytes, names of formats, and content types."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DECODABLE = ("jpeg", "png", "webp", "avif")
IMAGE_NAME = r"(?i)\.(jpg|jpeg|png|webp|avif|gif|svg)$"
MODES = ("scan", "probe", "ingest")


def _at(content: Column, start: int, n: int) -> Column:
    return F.hex(F.substring(content, start + 1, n))


def sniff(content: Column, mode: str = "scan") -> Column:
    """The container of a file's bytes, null where unknown.

    The modes differ as their callers do: ``scan`` also knows svg and any gif
    and takes avif or avis as major brand; ``probe`` takes gif87a and gif89a and
    no svg; ``ingest`` knows neither gif nor svg but also avif among the
    compatible brands.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    head = _at(content, 0, 12)
    avif = ("61766966", "61766973")
    box = _at(content, 4, 4) == "66747970"
    brand = _at(content, 8, 4)
    major = box & (brand.isin(*avif) if mode != "probe" else brand.isin(*avif))
    kind = (
        F.when(head.startswith("FFD8FF"), "jpeg")
        .when(head.startswith("89504E470D0A1A0A"), "png")
        .when(head.startswith("52494646") & head.endswith("57454250") & (F.length(head) == 24), "webp")
    )
    if mode == "scan":
        kind = kind.when(head.startswith("47494638"), "gif")
    if mode == "probe":
        kind = kind.when(head.startswith("474946383761") | head.startswith("474946383961"), "gif")
    kind = kind.when(major, "avif")
    if mode == "ingest":
        size = F.conv(_at(content, 0, 4), 16, 10).cast("long")
        end = F.least(size, F.octet_length(content).cast("long"), F.lit(4096).cast("long"))
        brands = F.transform(F.sequence(F.lit(16).cast("long"), F.greatest(end - 4, F.lit(16).cast("long")), F.lit(4).cast("long")), lambda i: F.hex(F.substr(content, i.cast("int") + 1, F.lit(4))))
        kind = kind.when(box & (end >= 20) & F.exists(brands, lambda b: b.isin(*avif)), "avif")
    if mode == "scan":
        text = F.lower(F.decode(F.substring(content, 1, 1024), "ISO-8859-1"))
        kind = kind.when(~box & text.contains("<svg"), "svg")
    return kind


def decodable(container: Column) -> Column:
    return F.coalesce(container.isin(*DECODABLE), F.lit(False))


def image_content_type(content_type: Column) -> Column:
    """Absent and empty types, images and plain byte streams may be images."""
    t = F.lower(F.trim(F.substring_index(F.coalesce(content_type, F.lit("")), ";", 1)))
    return (t == "") | t.startswith("image/") | (t == "application/octet-stream")


def format_name(name: Column) -> Column:
    """jpeg, png, webp or avif for a name in any case; null for others."""
    n = F.lower(name)
    return F.when(n == "jpg", "jpeg").when(n.isin(*DECODABLE), n)


def output_path(path: Column, format_: Column) -> Column:
    """The path with its extension replaced; one is added to names without a dot."""
    ext = F.when(format_ == "jpeg", "jpg").otherwise(format_)
    return F.concat(F.regexp_replace(path, r"\.[^./\\]*$", ""), F.lit("."), ext)


def bytes_1024(n: Column) -> Column:
    """Bytes in units of 1024, one decimal."""
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1048576, F.format_string("%.1f kB", n / 1024)).otherwise(F.format_string("%.1f MB", n / 1048576))


def bytes_1000(n: Column) -> Column:
    """Bytes in units of 1000, three significant digits."""
    v = F.when(n < 1_000_000, n / 1000).otherwise(n / 1_000_000)
    text = F.when(v < 10, F.format_string("%.2f", v)).when(v < 100, F.format_string("%.1f", v)).otherwise(F.format_string("%.0f", v))
    return F.when(n < 1000, F.concat(n.cast("string"), F.lit(" B"))).otherwise(F.concat(text, F.when(n < 1_000_000, " kB").otherwise(" MB")))


def content_hash(content: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(content, 256))
