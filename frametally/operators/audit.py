"""Audits of pages by the heads of their images, with what caps cut off reported."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from frametally.operators import headers
from frametally.operators.decide import recoverable

#: Images of a page, bytes of an image, bytes of a page that are looked at.
IMAGES, HEAD, TOTAL = 60, 1 << 16, 8 << 20


def inspected(items: DataFrame, images: int = IMAGES, head: int = HEAD, total: int = TOTAL) -> DataFrame:
    """items (page, idx, length, ...) with ``place`` on the page, ``head`` bytes fetched and ``state``.

    The first ``images`` of a page are considered; each costs the bytes of its
    head, as long as those before it stay below ``total``.  State is inspected,
    failed (a null length), beyond-images or beyond-bytes.
    """
    order = Window.partitionBy("page").orderBy("idx")
    placed = items.withColumn("place", F.row_number().over(order))
    cost = F.when((F.col("place") <= images) & F.col("length").isNotNull(), F.least(F.col("length"), F.lit(head)))
    spent = F.coalesce(F.sum(F.coalesce(cost, F.lit(0))).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    state = F.when(F.col("place") > images, "beyond-images").when(spent >= total, "beyond-bytes").when(F.col("length").isNull(), "failed").otherwise("inspected")
    out = placed.withColumn("state", state)
    return out.withColumn("head", F.when(F.col("state") == "inspected", F.least("length", F.lit(head))).otherwise(0).cast("long"))


def assets(items: DataFrame, images: int = IMAGES, head: int = HEAD, total: int = TOTAL, files: DataFrame | None = None, key: str = "file_id") -> DataFrame:
    """items (page, idx, url, length, content, attr_w, attr_h, display_w, display_h) with state, header evidence and recoverable bytes.

    Sizes are those of the header, or those that the page declares.  Only heads
    of inspected images are parsed.  With ``files`` (key, content), one row a
    key, items have the key instead of content: a file's head is parsed once,
    however many pages show it.
    """
    seen = inspected(items, images, head, total)
    if files is not None:
        return _judged(_shown(seen, headers.evidence(files.withColumn("content", F.substring("content", 1, head)), key), key))
    opened = headers.evidence(seen.withColumn("content", F.when(F.col("state") == "inspected", F.substring("content", 1, head))).withColumn("_row", F.struct(*[c for c in seen.columns if c != "content"])), "_row")
    return _judged(opened.select("_row.*", *[c for c in opened.columns if c != "_row"]))


def _shown(seen: DataFrame, read: DataFrame, key: str) -> DataFrame:
    """Inspected items with what their file's head tells; others, and those without a file, as without content."""
    told = seen.join(read.withColumnRenamed(key, "_file"), (F.col("state") == "inspected") & (F.col(key) == F.col("_file")), "left").drop("_file")
    return told.withColumn("evidence", F.coalesce("evidence", F.array(F.lit("no known container"))))


def _judged(flat: DataFrame) -> DataFrame:
    known = flat.withColumns({"declared_w": F.coalesce("width", "attr_w"), "declared_h": F.coalesce("height", "attr_h"), "file_bytes": F.col("length"), "blocking_score": F.lit(None).cast("double")})
    # bytes of no known container are judged as a JPEG's
    judged = recoverable(known.withColumns({"_container": F.col("container"), "container": F.coalesce("container", F.lit("jpeg"))}))
    taken = F.col("state") == "inspected"
    return judged.withColumns({"container": F.col("_container"), "recoverable": F.when(taken, F.col("recoverable")), "evidence": F.when(taken, F.col("evidence"))}).drop("_container")


def pages(audited: DataFrame, images: int = IMAGES, total: int = TOTAL) -> DataFrame:
    """(page, found, inspected, bytes, recoverable, headroom_none, headroom_low, headroom_normal, truncations) of audited assets, in one pass."""
    state = F.col("state")

    def n(which: str) -> F.Column:
        return F.count_if(state == which)

    failed = F.array_sort(F.collect_list(F.when(state == "failed", F.struct("idx", "url"))))["url"]
    over = F.when(n("beyond-images") > 0, F.concat(F.lit("of "), F.count(F.lit(1)).cast("string"), F.lit(f" images the first {images} are looked at")))
    spent = F.when(n("beyond-bytes") > 0, F.concat(F.lit(f"{total} bytes are spent: "), n("beyond-bytes").cast("string"), F.lit(" images are left out")))
    told = F.array_compact(F.concat(F.array(over), F.transform(failed, lambda u: F.concat(F.lit("not fetched: "), u)), F.array(spent)))
    room = [F.count_if(F.col("headroom") == h).alias(f"headroom_{h}") for h in ("none", "low", "normal")]
    return audited.groupBy("page").agg(F.count(F.lit(1)).alias("found"), n("inspected").alias("inspected"), F.sum("head").alias("bytes"), F.coalesce(F.sum("recoverable"), F.lit(0)).alias("recoverable"), *room, told.alias("truncations"))
