"""Rate-distortion candidates: floors, lower convex hulls, allocation at a rate or a byte budget.

All are expressions and windows; one shuffle brings an asset's candidates
together, after which only hull points travel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Floors of structural similarity: anywhere, above the fold; and the margin that low headroom adds.
FLOOR, FLOOR_ABOVE_FOLD, LOW_MARGIN = 0.97, 0.99, 0.01


def at_or_above_floor(candidates: DataFrame, floor: Column | float) -> DataFrame:
    """Candidates whose similarity reaches the floor (which must lie in 0..1)."""
    f = F.lit(floor) if isinstance(floor, (int, float)) else floor
    checked = F.when((f >= 0) & (f <= 1), f).otherwise(F.raise_error(F.lit("floor must lie in [0, 1]")).cast("double"))
    return candidates.where(F.col("ssim") >= checked)


_POINT = "bytes, distortion, ord, format, quality, ssim"


def hull_of(points: str = "points") -> Column:
    """Lower convex hull of an array of structs that begin (bytes, distortion, ord).

    Sorted by bytes, then distortion, then order of input; a point joins if it
    lowers the distortion, and points that then lie on or above the chord to it
    leave.  The chain before it is convex, so those are a suffix, and filtering
    by the neighbour before each is the same as popping.
    """
    return F.expr(f"""
      aggregate(array_sort({points}), slice({points}, 1, 0), (st, p) ->
        CASE WHEN size(st) > 0 AND p.distortion >= element_at(st, -1).distortion THEN st
             ELSE concat(filter(st, (q, i) -> i = 0 OR
                (q.bytes - st[i - 1].bytes) * (p.distortion - st[i - 1].distortion)
                - (q.distortion - st[i - 1].distortion) * (p.bytes - st[i - 1].bytes) > 0), array(p)) END)
    """)


def hulls(candidates: DataFrame, *keys: str) -> DataFrame:
    """(keys, hull array): the hull of each group of candidates."""
    bad = F.col("bytes").isNull() | (F.col("bytes") < 0) | F.col("distortion").isNull() | F.isnan("distortion") | (F.abs("distortion") == float("inf"))
    point = F.when(bad, F.raise_error(F.lit("bytes must be at least 0 and distortion finite")).cast("string")).isNull()
    grouped = candidates.where(point).groupBy(*keys).agg(F.collect_list(F.struct(*_POINT.split(", "))).alias("points"))
    return grouped.select(*keys, hull_of().alias("hull"))


def hull_points(hulled: DataFrame, *keys: str) -> DataFrame:
    return hulled.select(*keys, F.posexplode("hull").alias("k", "p")).select(*keys, "k", "p.*")


def point_key(format: Column, quality: Column) -> Column:
    """The name of a format at a quality; without one it is lossless."""
    return F.concat(format, F.lit(":"), F.coalesce(F.concat(F.lit("q"), quality.cast("string")), F.lit("lossless")))


def members(candidates: DataFrame, hulled: DataFrame, *keys: str) -> DataFrame:
    """Candidates with their point's key and on_hull, whether a point of that key is on their group's hull."""
    on = hull_points(hulled, *keys).select(*keys, point_key(F.col("format"), F.col("quality")).alias("key"), F.lit(True).alias("on_hull")).distinct()
    named = candidates.withColumn("key", point_key(F.col("format"), F.col("quality")))
    return named.join(on, [*keys, "key"], "left").withColumn("on_hull", F.coalesce("on_hull", F.lit(False)))


def with_rates(hulled: DataFrame) -> DataFrame:
    """Adds ``rates``: weighted distortion saved per byte by each step along the hull (falling)."""
    return hulled.withColumn(
        "rates", F.expr("transform(slice(hull, 1, size(hull) - 1), (x, i) -> (weight * (x.distortion - hull[i + 1].distortion)) / (hull[i + 1].bytes - x.bytes))")
    )


def choose(hulled: DataFrame, rate: Column) -> DataFrame:
    """Adds ``choice``: the hull point bought at a rate; steps worth exactly the rate aren't bought."""
    return hulled.withColumn("rate", rate).withColumn("choice", F.expr("hull[size(filter(rates, r -> r > rate))]"))


def allocate_at_rate(images: DataFrame, rate: float) -> DataFrame:
    """images (keys, weight, hull) with choice at one rate for all."""
    if not (rate >= 0 and rate < float("inf")):
        raise ValueError("the rate must be finite and at least 0")
    return choose(with_rates(images), F.lit(float(rate)))


def budget_rates(images: DataFrame, page: str, budget: DataFrame) -> DataFrame:
    """(page, rate): the smallest rate at which each page's choices fit its budget.

    0 where everything fits; if even the leanest choice overruns, the largest
    rate; 0 if no step has a positive rate.  ``budget`` has (page, budget).
    """
    rated = with_rates(images)
    base = rated.groupBy(page).agg(F.sum(F.col("hull")[0]["bytes"]).alias("base"))
    steps = rated.select(page, F.posexplode("rates").alias("k", "rate"), F.col("hull")).select(
        page, "rate", (F.col("hull")[F.col("k") + 1]["bytes"] - F.col("hull")[F.col("k")]["bytes"]).alias("db")
    )
    merged = steps.where("rate > 0").groupBy(page, "rate").agg(F.sum("db").alias("db"))
    w = Window.partitionBy(page).orderBy(F.desc("rate")).rowsBetween(Window.unboundedPreceding, -1)
    cumulated = merged.withColumn("extra", F.coalesce(F.sum("db").over(w), F.lit(0))).withColumn("full", F.sum("db").over(Window.partitionBy(page)))
    fit = (
        base.join(cumulated, page, "left")
        .join(budget, page)
        .groupBy(page)
        .agg(
            F.first("base").alias("base"),
            F.first("budget").alias("budget"),
            F.max("full").alias("full"),
            F.min(F.when(F.col("base") + F.col("extra") <= F.col("budget"), F.col("rate"))).alias("fits"),
            F.max("rate").alias("leanest"),
        )
    )
    rate = F.when(F.col("base") + F.coalesce("full", F.lit(0)) <= F.col("budget"), F.lit(0.0)).otherwise(F.coalesce("fits", "leanest", F.lit(0.0)))
    return fit.select(page, rate.alias("rate"))


def allocate_in_budget(images: DataFrame, page: str, budget: DataFrame) -> DataFrame:
    """images (page, ..., weight, hull) with the rate of their page and their choice at it."""
    return choose(with_rates(images).join(budget_rates(images, page, budget).withColumnRenamed("rate", "page_rate"), page), F.col("page_rate")).drop("page_rate")


def totals(chosen: DataFrame, *keys: str) -> DataFrame:
    """(keys, total_bytes, total_distortion) of choices, distortion weighted."""
    return chosen.groupBy(*keys).agg(F.sum("choice.bytes").alias("total_bytes"), F.sum(F.col("weight") * F.col("choice.distortion")).alias("total_distortion"))


def knee(points: str = "points") -> Column:
    """The point of an array of (bytes, distortion) structs, by rising bytes, farthest from the chord of
    its ends, both axes scaled to 0..1; of points within 1e-9 the later."""
    return F.expr(f"""
      aggregate(
        transform({points}, p -> named_struct('p', p, 'd', abs(
          (p.bytes - {points}[0].bytes) / nullif(double(element_at({points}, -1).bytes - {points}[0].bytes), 0D)
          + (p.distortion - element_at({points}, -1).distortion) / nullif({points}[0].distortion - element_at({points}, -1).distortion, 0D) - 1))),
        named_struct('p', {points}[0], 'd', -1D),
        (best, x) -> CASE WHEN coalesce(x.d, 0D) >= best.d - 1e-9 THEN named_struct('p', x.p, 'd', coalesce(x.d, 0D)) ELSE best END,
        best -> best.p)
    """)
