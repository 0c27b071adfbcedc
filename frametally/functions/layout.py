"""Where a page's images stand: sizes, the fold, and caps in document order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

VIEWPORT = (1440, 900)


def css_length(value: Column, axis: str, viewport: tuple[int, int] = VIEWPORT) -> Column:
    """Pixels of a CSS length in px, %, vw or vh; null for others and for what isn't above 0."""
    v = F.lower(F.trim(value))
    ok = v.rlike(r"^\d+(\.\d+)?(px|%|vw|vh)$")
    n = F.when(ok, F.regexp_extract(v, r"^([\d.]+)", 1).cast("double"))
    own = viewport[0] if axis == "width" else viewport[1]
    of = F.when(v.endswith("px"), n).when(v.endswith("%"), n / 100 * own).when(v.endswith("vw"), n / 100 * viewport[0]).otherwise(n / 100 * viewport[1])
    return F.when(n > 0, F.floor(of + 0.5).cast("long"))


def display_size(css_w: Column, css_h: Column, attr_w: Column, attr_h: Column, viewport: tuple[int, int] = VIEWPORT) -> Column:
    """struct(width, height): CSS before attributes; a width beyond the viewport is clamped, and the height
    scaled with it when both came from attributes."""
    w, h = F.coalesce(css_w, F.when(attr_w > 0, attr_w)), F.coalesce(css_h, F.when(attr_h > 0, attr_h))
    wide = w > viewport[0]
    scaled = F.when(wide & css_w.isNull() & css_h.isNull() & h.isNotNull(), F.floor(h * viewport[0] / w + 0.5).cast("long")).otherwise(h)
    return F.struct(F.when(wide, viewport[0]).otherwise(w).cast("long").alias("width"), scaled.cast("long").alias("height"))


def fold(items: DataFrame, page: str, idx: str, viewport: tuple[int, int] = VIEWPORT) -> DataFrame:
    """items (page, idx, width, height, lazy) with top, above_fold and role.

    Images stack in document order; unknown heights add nothing; lazy images
    are below the fold but take their room.  The largest image above it is the
    page's lcp, the earliest of equals.
    """
    before = Window.partitionBy(page).orderBy(idx).rowsBetween(Window.unboundedPreceding, -1)
    placed = items.withColumn("top", F.coalesce(F.sum(F.coalesce("height", F.lit(0))).over(before), F.lit(0)))
    placed = placed.withColumn("above_fold", ~F.col("lazy") & (F.col("top") < viewport[1]))
    area = F.when(F.col("above_fold"), F.col("width") * F.col("height"))
    first = F.row_number().over(Window.partitionBy(page).orderBy(F.coalesce(area, F.lit(0)).desc(), idx))
    lcp = (first == 1) & (F.coalesce(area, F.lit(0)) > 0)
    return placed.withColumn("role", F.when(lcp, "lcp").otherwise("content"))


def capped(items: DataFrame, page: str, idx: str, bytes_: str, most: int = 60, most_bytes: int = 8 << 20) -> DataFrame:
    """The items a scan takes: the first ``most``, as long as the bytes before stay under the cap."""
    order = Window.partitionBy(page).orderBy(idx)
    ranked = items.withColumn("_n", F.row_number().over(order)).withColumn("_before", F.coalesce(F.sum(F.coalesce(bytes_, F.lit(0))).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return ranked.where((F.col("_n") <= most) & (F.col("_before") < most_bytes)).drop("_n", "_before")
