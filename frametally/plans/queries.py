"""Queries over the derived views, one for each operator, and DuckDB SQL of the same results.

The SQL states results in another form than the Spark plans where it can: hulls
by an anti-join instead of a fold, allocation by trying every rate, and so on.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from frametally.functions import addresses, containers, layout, rates, urls
from frametally.operators import decide, history, hull, pixels, quant, resize, sweep, verify
from frametally.plans.views import duckdb_sql, view
from frametally.sources import pages, receipts
from frametally.streaming import limits, probe

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = duckdb_sql(sql)
        return f

    return register


# ---- candidates, hulls, allocation -------------------------------------------------

_LEGAL = "legal AS (SELECT * FROM {candidates} WHERE ssim >= 0.97)"
_BEST = """best AS (SELECT asset_id, page, bytes, min(distortion) AS distortion FROM legal GROUP BY ALL),
 low AS (SELECT *, min(distortion) OVER (PARTITION BY asset_id ORDER BY bytes ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM best),
 mono AS (SELECT * FROM low WHERE m IS NULL OR distortion < m),
 hull AS (SELECT p.asset_id, p.page, p.bytes, p.distortion FROM mono p WHERE NOT EXISTS (
   SELECT 1 FROM mono a JOIN mono b ON b.asset_id = a.asset_id AND b.bytes > a.bytes WHERE a.asset_id = p.asset_id AND a.bytes < p.bytes AND b.bytes > p.bytes
   AND (p.bytes - a.bytes) * (b.distortion - a.distortion) - (p.distortion - a.distortion) * (b.bytes - a.bytes) <= 0))"""


@query("SELECT asset_id, ord, format, quality, bytes, ssim FROM {candidates} WHERE ssim >= 0.99")
def floor_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hull.at_or_above_floor(view(spark, sf_dir, "candidates"), 0.99).select("asset_id", "ord", "format", "quality", "bytes", "ssim")


def _hulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hull.hulls(hull.at_or_above_floor(view(spark, sf_dir, "candidates"), hull.FLOOR), "asset_id", "page")


@query(f"WITH {_LEGAL}, {_BEST} SELECT asset_id, CAST(row_number() OVER (PARTITION BY asset_id ORDER BY bytes) - 1 AS INT) AS k, bytes, distortion FROM hull")
def convex_hull(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hull.hull_points(_hulls(spark, sf_dir), "asset_id").select("asset_id", "k", "bytes", "distortion")


_WEIGHTED = """w AS (SELECT *, CAST(asset_id % 5 AS DOUBLE) / 4 AS weight FROM hull),
 seg AS (SELECT asset_id, page, weight, bytes, distortion, row_number() OVER (PARTITION BY asset_id ORDER BY bytes) AS k,
   lead(bytes) OVER (PARTITION BY asset_id ORDER BY bytes) AS nb, lead(distortion) OVER (PARTITION BY asset_id ORDER BY bytes) AS nd FROM w),
 rated AS (SELECT *, weight * (distortion - nd) / (nb - bytes) AS rate FROM seg)"""


@query(f"WITH {_LEGAL}, {_BEST}, {_WEIGHTED} SELECT asset_id, CAST(k - 1 AS INT) AS k, round(rate * 1e9) AS nano_rate FROM rated WHERE nb IS NOT NULL")
def segment_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = hull.with_rates(_weighted(spark, sf_dir))
    return h.select("asset_id", F.posexplode("rates").alias("k", "rate")).select("asset_id", "k", F.round(F.col("rate") * 1e9).alias("nano_rate"))


def _weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hulls(spark, sf_dir).withColumn("weight", (F.col("asset_id") % 5).cast("double") / 4)


@query(f"""WITH {_LEGAL}, {_BEST}, {_WEIGHTED},
 pick AS (SELECT asset_id, 1 + count(*) FILTER (nb IS NOT NULL AND rate > 0.0001) AS k FROM rated GROUP BY asset_id)
 SELECT r.asset_id, r.bytes, r.distortion FROM rated r JOIN pick p ON p.asset_id = r.asset_id AND p.k = r.k""")
def allocate_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hull.allocate_at_rate(_weighted(spark, sf_dir), 0.0001).select("asset_id", "choice.bytes", "choice.distortion")


def _budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's share of what its originals weigh: a quarter, half, all, or almost nothing."""
    h = _hulls(spark, sf_dir).groupBy("page").agg(F.sum(F.element_at("hull", -1)["bytes"]).alias("full"))
    return h.select("page", F.floor(F.col("full") * F.element_at(F.array(*map(F.lit, (0.25, 0.5, 1.0, 0.001))), (F.col("page") % 4 + 1).cast("int"))).alias("budget"))


@query(f"""WITH {_LEGAL}, {_BEST}, {_WEIGHTED},
 full_ AS (SELECT page, sum(b) AS s FROM (SELECT page, asset_id, max(bytes) AS b FROM hull GROUP BY ALL) GROUP BY page),
 bud AS (SELECT page, floor(s * CASE page % 4 WHEN 0 THEN 0.25 WHEN 1 THEN 0.5 WHEN 2 THEN 1.0 ELSE 0.001 END) AS budget FROM full_),
 base AS (SELECT page, sum(bytes) AS base FROM rated WHERE k = 1 GROUP BY page),
 tried AS (SELECT DISTINCT page, rate FROM rated WHERE rate > 0 UNION SELECT page, 0 FROM base),
 spent AS (SELECT page, rate, sum(db) AS db FROM (SELECT page, rate, nb - bytes AS db FROM rated WHERE rate > 0) GROUP BY ALL),
 cost AS (SELECT t.page, t.rate, any_value(b.base) + coalesce(sum(s.db), 0) AS b FROM tried t JOIN base b USING (page) LEFT JOIN spent s ON s.page = t.page AND s.rate > t.rate GROUP BY t.page, t.rate),
 lam AS (SELECT c.page, coalesce(min(c.rate) FILTER (c.b <= bud.budget), max(c.rate)) AS rate FROM cost c JOIN bud USING (page) GROUP BY c.page),
 pick AS (SELECT r.asset_id, 1 + count(*) FILTER (nb IS NOT NULL AND r.rate > l.rate) AS k FROM rated r JOIN lam l USING (page) GROUP BY r.asset_id)
 SELECT r.page, r.asset_id, r.bytes, r.distortion FROM rated r JOIN pick p ON p.asset_id = r.asset_id AND p.k = r.k""")
def allocate_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = _weighted(spark, sf_dir)
    return hull.allocate_in_budget(images, "page", _budgets(spark, sf_dir)).select("page", "asset_id", "choice.bytes", "choice.distortion")


@query(f"""WITH {_LEGAL}, {_BEST}, {_WEIGHTED},
 pick AS (SELECT asset_id, 1 + count(*) FILTER (nb IS NOT NULL AND rate > 0.0001) AS k FROM rated GROUP BY asset_id)
 SELECT r.page, CAST(sum(r.bytes) AS BIGINT) AS total_bytes, round(sum(r.weight * r.distortion), 6) AS total_distortion FROM rated r JOIN pick p ON p.asset_id = r.asset_id AND p.k = r.k GROUP BY r.page""")
def allocation_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = hull.totals(hull.allocate_at_rate(_weighted(spark, sf_dir), 0.0001), "page")
    return t.select("page", "total_bytes", F.round("total_distortion", 6).alias("total_distortion"))


@query(f"""WITH {_LEGAL}, {_BEST},
 e AS (SELECT *, min(bytes) OVER w AS b0, max(bytes) OVER w AS b1, max(distortion) OVER w AS d0, min(distortion) OVER w AS d1 FROM hull WINDOW w AS (PARTITION BY asset_id)),
 d AS (SELECT *, coalesce(abs((bytes - b0) / nullif(CAST(b1 - b0 AS DOUBLE), 0) + (distortion - d1) / nullif(d0 - d1, 0) - 1), 0) AS gap FROM e),
 m AS (SELECT asset_id, max(gap) AS g FROM d GROUP BY asset_id)
 SELECT d.asset_id, max(d.bytes) AS bytes FROM d JOIN m USING (asset_id) WHERE d.gap >= m.g - 1e-9 GROUP BY d.asset_id""")
def knee_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hulls(spark, sf_dir).select("asset_id", hull.knee("hull")["bytes"].alias("bytes"))


@query("""SELECT asset_id, min(bytes) AS bytes, arg_min(ord, (bytes, distortion, ord)) AS ord FROM {candidates} WHERE ssim >= 0.97 GROUP BY asset_id""")
def cheapest_legal(spark: SparkSession, sf_dir: str) -> DataFrame:
    legal = hull.at_or_above_floor(view(spark, sf_dir, "candidates"), hull.FLOOR)
    return legal.groupBy("asset_id").agg(F.min(F.struct("bytes", "distortion", "ord")).alias("p")).select("asset_id", "p.bytes", "p.ord")


@query("""SELECT asset_id, ord, round((1 - ssim) + 0.5 * least(delta_e / 2.3, 1.0), 6) AS distortion FROM {candidates}""")
def point_distortion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "candidates").select("asset_id", "ord", F.round(rates.distortion(F.col("ssim"), F.col("delta_e")), 6).alias("distortion"))


@query("""SELECT asset_id, round(pow(CAST(display_w * display_h AS DOUBLE), 0.6) * vf * rf, 6) AS weight FROM (SELECT *,
  CASE WHEN d <= 0 THEN 1.0 WHEN d >= 2 THEN 0.3 ELSE 1 - 0.35 * d END AS vf, CASE role WHEN 'lcp' THEN 1.5 WHEN 'content' THEN 1.0 ELSE 0.6 END AS rf
  FROM (SELECT *, CAST(asset_id % 12 - 3 AS DOUBLE) / 4 AS d FROM {assets}) a) b WHERE display_w IS NOT NULL""")
def visual_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = view(spark, sf_dir, "assets").where("display_w is not null").withColumn("d", (F.col("asset_id") % 12 - 3).cast("double") / 4)
    w = rates.visual_weight((F.col("display_w") * F.col("display_h")).cast("double"), rates.viewport_factor(F.col("d")), rates.role_factor(F.col("role")))
    return a.select("asset_id", F.round(w, 6).alias("weight"))


# ---- decisions ---------------------------------------------------------------------

_ROOM = """CASE WHEN coalesce(generations >= 2, false) OR coalesce(quality < 60, false) OR (container IN ('png', 'gif') AND blocking_score >= 1.0 / 3) THEN 'none'
 WHEN coalesce(quality < 78, false) THEN 'low' ELSE 'normal' END"""


@query(f"""SELECT asset_id, {_ROOM} AS headroom, CAST(coalesce(generations >= 2, false) AS INT) + CAST(coalesce(quality < 60, false) AS INT)
 + CAST(container IN ('png', 'gif') AND blocking_score >= 1.0 / 3 AS INT) AS exhausted FROM {{assets}}""")
def headroom(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = view(spark, sf_dir, "assets")
    room = decide.headroom(*map(F.col, ("container", "generations", "quality", "blocking_score")))
    return a.select("asset_id", room["headroom"].alias("headroom"), F.when(room["headroom"] == "none", F.size(room["reasons"])).otherwise(0).alias("exhausted"))


_DECISIONS = f"""WITH a AS (SELECT *, {_ROOM} AS room, CASE WHEN coalesce(classification, CASE container WHEN 'svg' THEN 'vector' WHEN 'gif' THEN 'animated' END) IN ('vector', 'animated', 'icon') THEN 1 ELSE 0 END AS skip FROM {{assets}}),
 f AS (SELECT *, least(1.0, CASE WHEN above_fold THEN 0.99 ELSE 0.97 END + CASE WHEN room = 'low' THEN 0.01 ELSE 0 END) AS floor_ FROM a),
 c AS (SELECT asset_id, format, quality, bytes, distortion, ord, ssim FROM {{candidates}}),
 m AS (SELECT asset_id, count(*) AS n, max(bytes) FILTER (format = 'keep-original') AS original FROM c GROUP BY asset_id),
 l AS (SELECT c.* , row_number() OVER (PARTITION BY c.asset_id ORDER BY c.bytes, c.distortion, c.ord) AS r FROM c JOIN f USING (asset_id) WHERE c.ssim >= f.floor_),
 t AS (SELECT f.asset_id, f.room AS headroom, CASE WHEN skip = 1 THEN 'skipped-class' WHEN room = 'none' THEN 'refused' WHEN m.n IS NULL THEN 'skipped-unmeasured' WHEN l.bytes IS NULL THEN 'kept-below-floor'
   WHEN l.format = 'keep-original' THEN 'kept-original' WHEN m.original > 0 AND (m.original - l.bytes) / CAST(m.original AS DOUBLE) < 0.05 AND l.format = f.container THEN 'kept-no-op' ELSE 'encoded' END AS tag, l.format, l.quality, l.bytes
   FROM f LEFT JOIN m USING (asset_id) LEFT JOIN l ON l.asset_id = f.asset_id AND l.r = 1)
 SELECT asset_id, headroom, split_part(tag, '-', 1) AS decision, tag, CASE WHEN tag = 'encoded' THEN format END AS chosen_format, CASE WHEN tag = 'encoded' THEN quality END AS chosen_quality, CASE WHEN tag = 'encoded' THEN bytes END AS chosen_bytes FROM t"""


@query(_DECISIONS)
def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = decide.decide(view(spark, sf_dir, "assets"), view(spark, sf_dir, "candidates"))
    return d.select("asset_id", "headroom", "decision", "tag", "chosen_format", "chosen_quality", "chosen_bytes")


@query(f"""WITH d AS ({_DECISIONS}) SELECT count(*) AS assets, count(*) FILTER (decision = 'encoded') AS encoded, count(*) FILTER (decision = 'refused') AS refused, count(*) FILTER (decision NOT IN ('encoded', 'refused')) AS kept_or_skipped,
 CAST(sum(file_bytes) AS BIGINT) AS bytes_before, CAST(sum(coalesce(chosen_bytes, file_bytes)) AS BIGINT) AS bytes_after FROM d JOIN {{assets}} USING (asset_id)""")
def plan_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decide.plan_totals(decide.decide(view(spark, sf_dir, "assets"), view(spark, sf_dir, "candidates")))


@query(f"""WITH o AS (SELECT asset_id FROM {{assets}} WHERE {_ROOM} <> 'none' AND coalesce(classification, CASE container WHEN 'svg' THEN 'vector' WHEN 'gif' THEN 'animated' END, '') NOT IN ('vector', 'animated', 'icon'))
 SELECT o.asset_id, s.step, s.format, s.quality FROM o, (SELECT -1 AS step, 'keep-original' AS format, NULL AS quality UNION ALL SELECT CAST(12 * f.i + q.i AS INT), f.format, CAST(40 + 5 * q.i AS INT) FROM (VALUES (0, 'jpeg'), (1, 'webp'), (2, 'avif')) f(i, format), range(12) q(i) UNION ALL SELECT 36, 'png', NULL) s""")
def planned_sweeps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps of the assets that a plan has to measure."""
    return sweep.steps_for(decide.to_measure(view(spark, sf_dir, "assets")).select("asset_id"), sweep.plan(spark), "asset_id")


@query("""WITH p AS (SELECT a.asset_id, a.declared_w * a.declared_h AS d1, b.declared_w * b.declared_h AS d2, a.effective_w * a.effective_h AS e1, b.effective_w * b.effective_h AS e2,
   a.generations AS g1, b.generations AS g2, a.quality AS q1, b.quality AS q2 FROM {assets} a JOIN {assets} b ON b.asset_id = a.asset_id + 1),
 v AS (SELECT asset_id, CASE WHEN d2 > d1 THEN 1 WHEN d2 < d1 THEN -1 ELSE 0 END AS declared_verdict, CASE WHEN e1 IS NULL OR e2 IS NULL THEN 0 WHEN e2 > e1 * 1.05 THEN 1 WHEN e2 < e1 * 0.95 THEN -1 ELSE 0 END AS effective_verdict,
   CASE WHEN g2 < g1 THEN 1 WHEN g2 > g1 THEN -1 ELSE 0 END AS generation_verdict, CASE WHEN q2 > q1 + 2 THEN 1 WHEN q2 < q1 - 2 THEN -1 ELSE 0 END AS quality_verdict FROM p)
 SELECT *, declared_verdict >= 0 AND effective_verdict >= 0 AND generation_verdict >= 0 AND quality_verdict >= 0 AND declared_verdict + effective_verdict + generation_verdict + quality_verdict > 0 AS accepted FROM v""")
def accepted_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = view(spark, sf_dir, "assets")
    fields = ["declared_w", "declared_h", "effective_w", "effective_h", "generations", "quality"]
    cur = a.select("asset_id", F.struct(*fields).alias("cur"))
    cand = a.select((F.col("asset_id") - 1).alias("asset_id"), F.struct(*fields).alias("cand"))
    return decide.accept_sources(cur.join(cand, "asset_id")).drop("cur", "cand")


_RECOVER = f"""r AS (SELECT asset_id, file_bytes, container, {_ROOM} AS headroom, CASE WHEN {_ROOM} = 'none' THEN 0 ELSE least(0.95, 1 - (1 - oversize) * (1 - factor)) END AS fraction FROM (SELECT *,
  CASE WHEN coalesce(display_w * display_h > 0 AND display_w * display_h / CAST(declared_w * declared_h AS DOUBLE) < 1 / 1.2, false) THEN 1 - display_w * display_h / CAST(declared_w * declared_h AS DOUBLE) ELSE 0 END AS oversize,
  CASE container WHEN 'jpeg' THEN 0.25 + CASE WHEN quality >= 95 THEN 0.3 WHEN quality >= 90 THEN 0.2 WHEN quality >= 85 THEN 0.1 ELSE 0 END
    WHEN 'png' THEN CASE WHEN blocking_score >= 1.0 / 3 THEN 0.65 ELSE 0.18 END WHEN 'webp' THEN 0.15 WHEN 'gif' THEN 0.65 ELSE 0 END AS factor FROM {{assets}}) a)"""


@query(f"WITH {_RECOVER} SELECT asset_id, round(fraction, 6) AS fraction, CAST(floor(file_bytes * round(fraction, 9) + 0.5) AS BIGINT) AS recoverable FROM r")
def recoverable_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = decide.recoverable(_judged(spark, sf_dir))
    return r.select("asset_id", F.round("fraction", 6).alias("fraction"), F.floor(F.col("file_bytes") * F.round("fraction", 9) + 0.5).cast("long").alias("recoverable"))


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    room = decide.headroom(*map(F.col, ("container", "generations", "quality", "blocking_score")))
    return view(spark, sf_dir, "assets").withColumn("headroom", room["headroom"])


@query(f"""WITH {_RECOVER} SELECT count(*) AS assets, CAST(sum(file_bytes) AS BIGINT) AS bytes, CAST(sum(CAST(floor(file_bytes * fraction + 0.5) AS BIGINT)) AS BIGINT) AS recoverable,
 count(*) FILTER (headroom = 'none') AS headroom_none, count(*) FILTER (headroom = 'low') AS headroom_low, count(*) FILTER (headroom = 'normal') AS headroom_normal,
 count(*) FILTER (floor(file_bytes * fraction + 0.5) = 0) AS nothing_recoverable FROM r""")
def audit_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decide.audit_rollup(decide.recoverable(_judged(spark, sf_dir), decimal=True))


@query("""SELECT c.asset_id, c.step, c.format, c.quality FROM (SELECT p_partkey AS asset_id, s.step, s.format, s.quality FROM part, (
   SELECT CAST(12 * f.i + q.i AS INT) AS step, f.format, CAST(40 + 5 * q.i AS INT) AS quality FROM (VALUES (0, 'jpeg'), (1, 'webp'), (2, 'avif')) f(i, format), range(12) q(i) UNION ALL SELECT 36, 'png', NULL) s
   UNION ALL SELECT p_partkey, -1, 'keep-original', NULL FROM part) c""")
def sweep_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = view(spark, sf_dir, "part").select(F.col("p_partkey").alias("asset_id"))
    return sweep.steps_for(parts, sweep.plan(spark), "asset_id")


# ---- pixels ------------------------------------------------------------------------


@query("""WITH w AS (SELECT a.plane, sum(CAST(a.value AS DOUBLE)) / 64 AS ma, sum(CAST(b.value AS DOUBLE)) / 64 AS mb, sum(CAST(a.value * a.value AS DOUBLE)) / 64 AS saa, sum(CAST(b.value * b.value AS DOUBLE)) / 64 AS sbb, sum(CAST(a.value * b.value AS DOUBLE)) / 64 AS sab
   FROM {planes} a JOIN {planes} b ON b.plane = a.plane + 1 AND b.i = a.i GROUP BY a.plane)
 SELECT plane, round((2 * ma * mb + 6.5025) * (2 * (sab - ma * mb) + 58.5225) / ((ma * ma + mb * mb + 6.5025) * ((saa - ma * ma) + (sbb - mb * mb) + 58.5225)), 6) AS ssim FROM w""")
def structural_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = view(spark, sf_dir, "planes").select("plane", "i", F.col("value").alias("a"))
    q = p.select((F.col("plane") - 1).alias("plane"), "i", F.col("a").alias("b"))
    pairs = p.join(q, ["plane", "i"]).withColumns({"x": F.col("i") % 8, "y": F.floor(F.col("i") / 8)})
    return pixels.ssim(pairs, "plane").select("plane", F.round("ssim", 6).alias("ssim"))


@query("""WITH c AS (SELECT plane // 3 AS image, plane % 3 AS ch, i, CAST(greatest(0, least(255, value)) AS DOUBLE) AS v FROM {planes}),
 l AS (SELECT image, ch, i, CASE WHEN v / 255 <= 0.04045 THEN v / 255 / 12.92 ELSE pow((v / 255 + 0.055) / 1.055, 2.4) END AS v FROM c),
 p AS (SELECT image, i, max(v) FILTER (ch = 0) AS r, max(v) FILTER (ch = 1) AS g, max(v) FILTER (ch = 2) AS b FROM l GROUP BY image, i HAVING count(*) = 3),
 x AS (SELECT image, i, (0.4124564 * r + 0.3575761 * g + 0.1804375 * b) / 0.95047 AS x, 0.2126729 * r + 0.7151522 * g + 0.0721750 * b AS y, (0.0193339 * r + 0.1191920 * g + 0.9503041 * b) / 1.08883 AS z FROM p),
 f AS (SELECT image, i, CASE WHEN x > pow(6.0 / 29, 3) THEN cbrt(x) ELSE x / (3 * pow(6.0 / 29, 2)) + 4.0 / 29 END AS x, CASE WHEN y > pow(6.0 / 29, 3) THEN cbrt(y) ELSE y / (3 * pow(6.0 / 29, 2)) + 4.0 / 29 END AS y,
   CASE WHEN z > pow(6.0 / 29, 3) THEN cbrt(z) ELSE z / (3 * pow(6.0 / 29, 2)) + 4.0 / 29 END AS z FROM x),
 lab AS (SELECT image, i, 116 * y - 16 AS l, 500 * (x - y) AS a, 200 * (y - z) AS b FROM f),
 d AS (SELECT s.image, sqrt(pow(s.l - t.l, 2) + pow(s.a - t.a, 2) + pow(s.b - t.b, 2)) AS d FROM lab s JOIN lab t ON t.image = s.image + 1 AND t.i = s.i)
 SELECT CAST(image AS BIGINT) AS image, round(avg(d), 4) AS mean, round(quantile_disc(d, 0.95), 4) AS p95 FROM d GROUP BY image""")
def colour_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = view(spark, sf_dir, "planes").withColumn("v", F.greatest(F.lit(0), F.least(F.lit(255), "value")).cast("double"))
    ch = {c: F.max(F.when(F.col("plane") % 3 == i, F.col("v"))).alias(c) for i, c in enumerate("rgb")}
    rgb = p.groupBy(F.expr("plane div 3").alias("image"), "i").agg(*ch.values(), F.count(F.lit(1)).alias("n")).where("n = 3")
    one = rgb.select("image", "i", *[F.col(c).alias(f"{c}1") for c in "rgb"])
    two = rgb.select((F.col("image") - 1).alias("image"), "i", *[F.col(c).alias(f"{c}2") for c in "rgb"])
    d = pixels.delta_e(one.join(two, ["image", "i"]), "image")
    return d.select("image", F.round("mean", 4).alias("mean"), F.round("p95", 4).alias("p95"))


def _tiled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nine planes tiled to 24x24 pixels."""
    p = view(spark, sf_dir, "planes").withColumn("t", F.col("plane") % 9)
    return p.select(F.expr("plane div 9").alias("image"), (F.col("i") % 8 + 8 * (F.col("t") % 3)).alias("x"), (F.expr("i div 8") + 8 * F.expr("t div 3")).cast("long").alias("y"), F.col("value").cast("double").alias("value"))


_TILED = "g AS (SELECT CAST(plane // 9 AS BIGINT) AS image, CAST(i % 8 + 8 * ((plane % 9) % 3) AS BIGINT) AS x, CAST(i // 8 + 8 * ((plane % 9) // 3) AS BIGINT) AS y, CAST(value AS DOUBLE) AS value FROM {planes})"


@query(f"""WITH {_TILED}, h AS (SELECT a.image, b.x AS pos, abs(b.value - a.value) AS d FROM g a JOIN g b ON a.image = b.image AND a.y = b.y AND b.x = a.x + 1),
 v AS (SELECT a.image, b.y AS pos, abs(b.value - a.value) AS d FROM g a JOIN g b ON a.image = b.image AND a.x = b.x AND b.y = a.y + 1),
 n AS (SELECT image, max(x) + 1 AS w, max(y) + 1 AS h FROM g GROUP BY image),
 r AS (SELECT image, coalesce(avg(d) FILTER (pos % 8 = 0), 0) + 1e-6 AS e, coalesce(avg(d) FILTER (pos % 8 <> 0), 0) + 1e-6 AS o FROM h GROUP BY image),
 s AS (SELECT image, coalesce(avg(d) FILTER (pos % 8 = 0), 0) + 1e-6 AS e, coalesce(avg(d) FILTER (pos % 8 <> 0), 0) + 1e-6 AS o FROM v GROUP BY image)
 SELECT n.image, round(CASE WHEN w < 17 THEN 1 ELSE r.e / r.o END, 6) AS horizontal, round(CASE WHEN h < 17 THEN 1 ELSE s.e / s.o END, 6) AS vertical FROM n JOIN r USING (image) JOIN s USING (image)""")
def block_seams(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = pixels.blocking(_tiled(spark, sf_dir), "image")
    return b.select("image", F.round("horizontal", 6).alias("horizontal"), F.round("vertical", 6).alias("vertical"))


_BLOCKS = """f AS (SELECT image, x // 8 AS block_x, y // 8 AS block_y FROM g GROUP BY ALL HAVING count(*) = 64),
 d AS (SELECT g.image, f.block_x, f.block_y, u.u, v.v, sum((g.value - 128) * cos((2 * (g.x % 8) + 1) * u.u * pi() / 16) * cos((2 * (g.y % 8) + 1) * v.v * pi() / 16))
   * CASE WHEN u.u = 0 THEN sqrt(0.125) ELSE 0.5 END * CASE WHEN v.v = 0 THEN sqrt(0.125) ELSE 0.5 END AS c
   FROM g JOIN f ON f.image = g.image AND f.block_x = g.x // 8 AND f.block_y = g.y // 8, range(8) u(u), range(8) v(v) GROUP BY g.image, f.block_x, f.block_y, u.u, v.v)"""
_DCT = f"{_TILED}, {_BLOCKS}"


@query(f"WITH {_DCT} SELECT image, block_x, block_y, u, v, round(c, 4) + 0.0 AS coefficient FROM d")
def block_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels.dct_blocks(_tiled(spark, sf_dir), "image").withColumn("coefficient", F.round("coefficient", 4) + 0.0)


@query(f"WITH {_DCT} SELECT image, u, v, CAST(abs(floor(round(c, 6) / 16 + 0.5)) AS BIGINT) AS level, count(*) AS n FROM d WHERE u + v > 0 AND abs(floor(round(c, 6) / 16 + 0.5)) BETWEEN 1 AND 40 GROUP BY ALL")
def quantised_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = pixels.dct_blocks(_tiled(spark, sf_dir), "image").withColumn("coefficient", F.round("coefficient", 6))
    return pixels.quantised_histogram(blocks, F.lit(16.0), "image")


@query(f"""WITH g AS (SELECT CAST(e.label // 5 AS BIGINT) AS image, p.plane * 8 + p.i % 8 AS x, p.i // 8 AS y, CAST(p.value AS DOUBLE) AS value FROM {{planes}} p JOIN embeddings e ON e.vec_id = p.plane), {_BLOCKS},
 h AS (SELECT image, u, v, CAST(abs(floor(round(c, 6) / 4 + 0.5)) AS BIGINT) AS level, count(*) AS n FROM d WHERE u + v > 0 AND abs(floor(round(c, 6) / 4 + 0.5)) BETWEEN 1 AND 40 GROUP BY ALL),
 s AS (SELECT image, u, v, CAST(sum(n) AS BIGINT) AS samples FROM h GROUP BY ALL),
 l AS (SELECT s.image, s.u, s.v, k.i, ln(1.0 + coalesce(h.n, 0)) AS x FROM s CROSS JOIN range(40) k(i) LEFT JOIN h ON h.image = s.image AND h.u = s.u AND h.v = s.v AND h.level = k.i + 1),
 e AS (SELECT image, u, v, i, x - avg(x) OVER (PARTITION BY image, u, v ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS x FROM l),
 p AS (SELECT image, u, v, pow(sum(x * cos(2 * pi() * k.k * i / 40)), 2) + pow(sum(x * sin(2 * pi() * k.k * i / 40)), 2) AS p FROM e CROSS JOIN range(3, 21) k(k) GROUP BY image, u, v, k.k),
 r AS (SELECT image, u, v, max(p) AS peak, list_sort(list(p))[10] AS middle FROM p GROUP BY image, u, v),
 b AS (SELECT image, count(*) FILTER (samples >= 128) AS usable, count(*) FILTER (samples >= 128 AND CASE WHEN middle > 0 THEN peak >= 50 * middle ELSE peak > 0 END) AS periodic FROM r JOIN s USING (image, u, v) GROUP BY image)
 SELECT image, usable, periodic, CASE WHEN usable < 3 THEN NULL WHEN periodic >= 2 THEN 2 WHEN periodic = 0 THEN 1 END AS generations,
  CASE WHEN usable < 3 THEN NULL WHEN periodic >= 2 THEN least(1.0, 0.3 + 0.7 * periodic / CAST(usable AS DOUBLE)) WHEN periodic = 0 THEN CAST(0.7 AS DOUBLE) END AS confidence FROM b""")
def encode_generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images of all planes of several labels, so that bands hold enough samples."""
    labels = view(spark, sf_dir, "embeddings").where("label is not null").select(F.col("vec_id").alias("plane"), F.expr("label div 5").alias("image"))
    p = view(spark, sf_dir, "planes").join(labels, "plane").withColumns({"x": F.col("plane") * 8 + F.col("i") % 8, "y": F.floor(F.col("i") / 8)})
    blocks = pixels.dct_blocks(p, "image").withColumn("coefficient", F.round("coefficient", 6))
    histogram = pixels.quantised_histogram(blocks, F.lit(4.0), "image")
    return pixels.generations(pixels.periodicity(histogram, "image"), "image")


@query(f"""WITH {_TILED}, t AS (SELECT a.a AS tx, b.a AS ty FROM range(10) a(a), range(10) b(a)),
 c AS (SELECT g.image, t.tx, t.ty, g.value, greatest(0, least(g.x + 1, (t.tx + 1) * 2.4) - greatest(g.x, t.tx * 2.4)) * greatest(0, least(g.y + 1, (t.ty + 1) * 2.4) - greatest(g.y, t.ty * 2.4)) AS w FROM g, t WHERE image IN (SELECT image FROM g GROUP BY image HAVING max(x) = 23 AND max(y) = 23))
 SELECT image, CAST(tx AS INT) AS x, CAST(ty AS INT) AS y, round(sum(value * w) / 5.76, 4) AS value FROM c GROUP BY image, tx, ty""")
def area_resized(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _tiled(spark, sf_dir)
    sizes = p.groupBy("image").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h")).where("w = 24 and h = 24").withColumns({"tw": F.lit(10), "th": F.lit(10)})
    return resize.area(p, sizes, "image").withColumn("value", F.round("value", 4))


@query(f"""WITH {_TILED}, t AS (SELECT a.a AS tx, b.a AS ty, least(greatest((a.a + 0.5) * 24 / 31.0 - 0.5, 0), 23) AS sx, least(greatest((b.a + 0.5) * 24 / 31.0 - 0.5, 0), 23) AS sy FROM range(31) a(a), range(31) b(a)),
 c AS (SELECT i.image, tx, ty, sx - floor(sx) AS fx, sy - floor(sy) AS fy, CAST(floor(sx) AS BIGINT) AS x0, CAST(least(floor(sx) + 1, 23) AS BIGINT) AS x1, CAST(floor(sy) AS BIGINT) AS y0, CAST(least(floor(sy) + 1, 23) AS BIGINT) AS y1 FROM t, (SELECT image FROM g GROUP BY image HAVING max(x) = 23 AND max(y) = 23) i)
 SELECT c.image, CAST(tx AS INT) AS x, CAST(ty AS INT) AS y, round((p.value + (q.value - p.value) * fx) * (1 - fy) + (r.value + (s.value - r.value) * fx) * fy, 4) AS value FROM c JOIN g p ON p.image = c.image AND p.x = x0 AND p.y = y0 JOIN g q ON q.image = c.image AND q.x = x1 AND q.y = y0
   JOIN g r ON r.image = c.image AND r.x = x0 AND r.y = y1 JOIN g s ON s.image = c.image AND s.x = x1 AND s.y = y1""")
def bilinear_resized(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _tiled(spark, sf_dir)
    sizes = p.groupBy("image").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h")).where("w = 24 and h = 24").withColumns({"tw": F.lit(31), "th": F.lit(31)})
    return resize.bilinear(p, sizes, "image").withColumn("value", F.round("value", 4))


# ---- quantisation tables -------------------------------------------------------------


def _tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table for each part: the standard one at its quality, some of them disturbed."""
    p = view(spark, sf_dir, "part")
    scaled = quant.scale_table(F.array(*map(F.lit, quant.STANDARD_LUMA)), 50 + F.col("p_size"))
    return p.select("p_partkey", "p_size", F.transform(scaled, lambda v, i: F.when((F.col("p_partkey") % 5 == 1) & (i == 7), v + 1).when((F.col("p_partkey") % 5 == 2), v + i % 4).otherwise(v).cast("int")).alias("luma"))


_BASE = f"base AS (SELECT unnest(range(64)) AS i, unnest({quant.STANDARD_LUMA}) AS b)"
_SCALED = "CAST(least(255, greatest(1, floor((b * (CASE WHEN q < 50 THEN floor(5000 / q) ELSE 200 - 2 * q END) + 50) / 100))) AS INT)"


_OBSERVED = f"obs AS (SELECT p_partkey, i, v + CASE WHEN p_partkey % 5 = 1 AND i = 7 THEN 1 WHEN p_partkey % 5 = 2 THEN i % 4 ELSE 0 END AS o FROM (SELECT p_partkey, i, {_SCALED} AS v FROM (SELECT p_partkey, 50 + p_size AS q FROM part) p, base) t)"


@query(f"WITH {_BASE}, {_OBSERVED} SELECT p_partkey, CAST(i AS INT) AS i, CAST(o AS INT) AS value FROM obs")
def scaled_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _tables(spark, sf_dir)
    return t.select("p_partkey", F.posexplode("luma").alias("i", "value"))


@query(f"""WITH {_BASE}, dim AS (SELECT family_ord, q, i, {_SCALED} AS e FROM (SELECT 0 AS family_ord, q, i, b FROM base, range(1, 101) t(q) UNION ALL SELECT 1, q, i, 16 FROM base, range(1, 101) t(q)) s),
 {_OBSERVED},
 fit AS (SELECT p_partkey, family_ord, q, sum(abs(o - e) / CAST(e AS DOUBLE)) / 64 AS fit FROM obs JOIN dim USING (i) GROUP BY ALL),
 best AS (SELECT p_partkey, arg_min((family_ord, q), (round(fit, 9), family_ord, q)) AS b, min(fit) AS fit, count(DISTINCT family_ord) FILTER (fit = 0) AS exact_in, min(family_ord) FILTER (fit = 0) AS exact_first FROM fit GROUP BY p_partkey)
 SELECT p_partkey, CASE WHEN fit <= 0.05 THEN CASE b[1] WHEN 0 THEN 'standard' ELSE 'flat' END END AS family, CASE WHEN fit <= 0.05 THEN CAST(b[2] AS INT) END AS quality, CASE WHEN fit <= 0.05 THEN round(fit, 6) END AS fit,
   fit = 0 AS exact, CASE WHEN exact_in = 1 THEN CASE exact_first WHEN 0 THEN 'standard' ELSE 'flat' END END AS encoder FROM best""")
def table_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = quant.estimate_quality(_tables(spark, sf_dir), quant.families(spark), "p_partkey")
    return e.withColumn("fit", F.round("fit", 6))


@query(f"""WITH {_BASE}, {_OBSERVED}, l AS (SELECT p_partkey, list_concat([2166136261, 0], flatten(list([CAST(o AS BIGINT) >> 8, CAST(o AS BIGINT) & 255] ORDER BY i))) AS data FROM obs GROUP BY p_partkey)
 SELECT p_partkey, format('{{{{:08x}}}}', list_reduce(data, lambda a, b: (xor(a, b) * 16777619) & 4294967295)) AS signature FROM l""")
def table_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tables(spark, sf_dir).select("p_partkey", quant.signature(F.col("luma")).alias("signature"))


# ---- pages -------------------------------------------------------------------------

_SIZED = """z AS (SELECT page, idx, lazy, bytes, CASE WHEN w > 1440 THEN 1440 ELSE w END AS width,
  CASE WHEN w > 1440 AND css_w_px IS NULL AND attr_h IS NOT NULL THEN CAST(floor(attr_h * 1440 / CAST(w AS DOUBLE) + 0.5) AS BIGINT) ELSE attr_h END AS height FROM (SELECT *, coalesce(css_w_px, attr_w) AS w FROM {page_items}) i)"""


def _sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = view(spark, sf_dir, "page_items")
    css = layout.css_length(F.concat(F.col("css_w_px").cast("string"), F.lit("px")), "width")
    size = layout.display_size(css, F.lit(None).cast("long"), F.col("attr_w"), F.col("attr_h"))
    return i.withColumn("size", size).select("page", "idx", "lazy", "bytes", "size.width", "size.height")


@query(f"WITH {_SIZED} SELECT page, idx, CAST(width AS BIGINT) AS width, height FROM z")
def display_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sized(spark, sf_dir).select("page", "idx", "width", "height")


@query(f"""WITH {_SIZED}, t AS (SELECT a.page, a.idx, a.lazy, a.width, a.height, coalesce(sum(b.height), 0) AS top FROM z a LEFT JOIN z b ON b.page = a.page AND b.idx < a.idx GROUP BY ALL),
 f AS (SELECT *, NOT lazy AND top < 900 AS above_fold FROM t),
 l AS (SELECT page, arg_min(idx, (-(width * height), idx)) AS idx FROM f WHERE above_fold AND width * height > 0 GROUP BY page)
 SELECT f.page, f.idx, CAST(f.top AS BIGINT) AS top, f.above_fold, CASE WHEN l.idx = f.idx THEN 'lcp' ELSE 'content' END AS role FROM f LEFT JOIN l USING (page)""")
def page_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.fold(_sized(spark, sf_dir), "page", "idx").select("page", "idx", "top", "above_fold", "role")


@query("""SELECT a.page, a.idx FROM {page_items} a LEFT JOIN {page_items} b ON b.page = a.page AND b.idx < a.idx GROUP BY a.page, a.idx HAVING count(b.idx) < 4 AND coalesce(sum(b.bytes), 0) < 20000""")
def capped_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.capped(view(spark, sf_dir, "page_items"), "page", "idx", "bytes", 4, 20000).select("page", "idx")


@query("""WITH n AS (SELECT page_id, 'http' || substr(split_part(split_part(url, '#', 1), '?', 1), 5) AS base, regexp_extract(url, '^[a-z]+://[^/]+', 0) AS host FROM pages)
 SELECT page_id, CAST(0 AS INT) AS idx, host || '/hero' || page_id || '.jpg' AS url, 'img' AS kind, false AS lazy, CAST(1200 AS BIGINT) AS attr_w, host || '/hero-800.jpg 800w|' || host || '/hero-2x.jpg 2x' AS listed FROM n
 UNION ALL SELECT page_id, 1, host || '/bg.png', 'background', false, NULL, '' FROM n UNION ALL SELECT page_id, 2, host || '/lazy.png', 'img', true, page_id % 7 + 1, '' FROM n""")
def page_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = view(spark, sf_dir, "pages")
    tags = F.concat(
        F.lit("<style>.hero{width:50%} @media x{img{width:1px}}</style><img class=hero src='/hero"), F.col("page_id").cast("string"), F.lit(".jpg' width=1200 srcset='/hero-2x.jpg 2x, /hero-800.jpg 800w, /bad.jpg 7q'>"),
        F.lit("<div style=\"background: url('/bg.png') no-repeat\"></div><img src='data:image/png;base64,x'><img src='/lazy.png' loading=lazy width='"), (F.col("page_id") % 7 + 1).cast("string"), F.lit("'>"),
    )
    i = pages.images(p.withColumn("html", F.concat(tags, F.coalesce("html", F.lit("")))))
    listed = F.array_join(F.transform("srcset", lambda e: F.concat_ws(" ", e["url"], e["descriptor"])), "|")
    return i.select("page_id", "idx", "url", "kind", "lazy", "attr_w", listed.alias("listed"))


# ---- URLs, addresses, containers ------------------------------------------------------


@query("""WITH k AS (SELECT asset_id, asset_id % 8 AS m, url, CAST(asset_id AS VARCHAR) AS id, regexp_extract(url, 'v=([0-9]+)', 1) AS v FROM {urls}),
 r AS (SELECT asset_id, unnest(CASE m
   WHEN 0 THEN ['https://blog.example.com/up/img' || id || '.jpg?v=' || v, 'https://blog.example.com/up/img' || id || '-scaled.jpg?v=' || v, 'https://blog.example.com/up/img' || id || '-300x200@2x.jpg?v=' || v, 'https://blog.example.com/up/img' || id || '-300x200@3x.jpg?v=' || v]
   WHEN 1 THEN ['https://blog.example.com/up/pic' || id || '.png', 'https://blog.example.com/up/pic' || id || '-scaled@2x.png', 'https://blog.example.com/up/pic' || id || '-scaled@3x.png']
   WHEN 2 THEN ['https://app.example.com/media/p' || id || ' a+b.png']
   WHEN 3 THEN ['https://cdn.shopify.com/s/files/t' || id || '.jpg?v=' || v]
   WHEN 4 THEN ['https://res.cloud.example/demo/image/upload/v1/dir/a' || id || '.webp?v=3#x', 'https://res.cloud.example/demo/image/upload/v1/dir/a' || id || '.webp?w=20&v=3#x', 'https://res.cloud.example/demo/image/upload/w_400,h_300,c_fill/v1/dir/a' || id || '.webp?v=3#x',
     'https://res.cloud.example/demo/image/upload/w_400,h_300,c_fill/v1/dir/a' || id || '@2x.webp?w=20&v=3#x', 'https://res.cloud.example/demo/image/upload/w_400,h_300,c_fill/v1/dir/a' || id || '@3x.webp?w=20&v=3#x']
   WHEN 5 THEN ['https://img.example.org/a/b' || id || '.jpeg?v=' || v, 'https://img.example.org/a/b' || id || '@2x.jpeg?w=300&fit=crop&v=' || v || '&auto', 'https://img.example.org/a/b' || id || '@3x.jpeg?w=300&fit=crop&v=' || v || '&auto']
   WHEN 6 THEN ['/static/logo' || id || '@2x.gif', '/static/logo' || id || '@3x.gif'] ELSE [] END) AS url,
   unnest(CASE m WHEN 0 THEN ['wordpress', 'wordpress', 'retina', 'retina'] WHEN 1 THEN ['wordpress', 'retina', 'retina'] WHEN 2 THEN ['nextjs'] WHEN 3 THEN ['shopify'] WHEN 4 THEN ['cdn', 'cdn', 'cdn', 'retina', 'retina'] WHEN 5 THEN ['cdn', 'retina', 'retina'] WHEN 6 THEN ['retina', 'retina'] ELSE [] END) AS via,
   unnest(range(CASE m WHEN 0 THEN 4 WHEN 1 THEN 3 WHEN 2 THEN 1 WHEN 3 THEN 1 WHEN 4 THEN 5 WHEN 5 THEN 3 WHEN 6 THEN 2 ELSE 0 END)) AS ord FROM k)
 SELECT asset_id, CAST(ord AS INT) AS ord, url, via FROM r""")
def source_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.proposals(view(spark, sf_dir, "urls"), "asset_id")


@query("""WITH r AS (SELECT * FROM (VALUES (0, 0, 8, 'this network'), (1, 167772160, 8, 'private'), (2, 1681915904, 10, 'carrier-grade nat'), (3, 2130706432, 8, 'loopback'), (4, 2851995648, 16, 'link-local'), (5, 2886729728, 12, 'private'),
   (6, 3221225472, 24, 'protocol assignments'), (7, 3221225984, 24, 'documentation'), (8, 3232235520, 16, 'private'), (9, 3323068416, 15, 'benchmarking'), (10, 3325256704, 24, 'documentation'), (11, 3405803776, 24, 'documentation'), (12, 3758096384, 4, 'multicast'), (13, 4026531840, 4, 'reserved')) t(ord, base, bits, reason)),
 n AS (SELECT id, ((a * 256 + b) * 256 + c) * 256 + d AS number FROM {addresses})
 SELECT n.id, n.number, arg_min(r.reason, r.ord) AS reason FROM n LEFT JOIN r ON n.number >> (32 - r.bits) = CAST(r.base AS BIGINT) >> (32 - r.bits) GROUP BY n.id, n.number""")
def blocked_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = view(spark, sf_dir, "addresses").select("id", addresses.ipv4_number(F.concat_ws(".", "a", "b", "c", "d")).alias("number"))
    return addresses.check_ipv4(a, "number")


@query("""WITH r AS (SELECT * FROM (VALUES (0, 0, 8, 'this network'), (1, 167772160, 8, 'private'), (2, 1681915904, 10, 'carrier-grade nat'), (3, 2130706432, 8, 'loopback'), (4, 2851995648, 16, 'link-local'), (5, 2886729728, 12, 'private'),
   (6, 3221225472, 24, 'protocol assignments'), (7, 3221225984, 24, 'documentation'), (8, 3232235520, 16, 'private'), (9, 3323068416, 15, 'benchmarking'), (10, 3325256704, 24, 'documentation'), (11, 3405803776, 24, 'documentation'), (12, 3758096384, 4, 'multicast'), (13, 4026531840, 4, 'reserved')) t(ord, base, bits, reason)),
 n AS (SELECT x.id, arg_min(r.reason, r.ord) AS reason FROM {addresses6} x JOIN r ON (((x.a * 256 + x.b) * 256 + x.c) * 256 + x.d) >> (32 - r.bits) = CAST(r.base AS BIGINT) >> (32 - r.bits) GROUP BY x.id)
 SELECT x.id, x.text, CASE k WHEN 0 THEN 'mapped: ' || n.reason WHEN 1 THEN 'link-local' WHEN 2 THEN '6to4: ' || n.reason WHEN 3 THEN 'nat64: ' || n.reason WHEN 4 THEN 'documentation' WHEN 5 THEN NULL WHEN 6 THEN 'unique-local' WHEN 7 THEN 'no address' WHEN 8 THEN 'loopback' WHEN 9 THEN 'no address' WHEN 10 THEN n.reason
   ELSE CASE WHEN a + b + c + d = 0 THEN 'unspecified' WHEN a + b + c = 0 AND d = 1 THEN 'loopback' ELSE 'compatible: ' || n.reason END END AS reason FROM {addresses6} x LEFT JOIN n ON n.id = x.id""")
def blocked_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "addresses6").select("id", "text", addresses.address_reason(F.col("text")).alias("reason"))


@query("""SELECT asset_id, CASE asset_id % 8 WHEN 2 THEN 'https://app.example.com/_next/image?q=75&url=%2Fmedia%2Fp' || asset_id || '+a+b.png&w=640' WHEN 4 THEN 'https://res.cloud.example/demo/image/upload/w_400,h_300,c_fill/v1/dir/a' || asset_id || '.webp?v=3&w=20'
   WHEN 5 THEN 'https://img.example.org/a/b' || asset_id || '.jpeg?auto=&fit=crop&v=' || regexp_extract(url, 'v=([0-9]+)', 1) || '&w=300' ELSE url END AS url FROM {urls}""")
def normalised_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "urls").select("asset_id", urls.normalised(F.col("url")).alias("url"))


_OLDER = """a AS (SELECT asset_id, CASE WHEN asset_id % 3 <> 0 THEN file_bytes END AS bytes FROM {assets}),
 n AS (SELECT asset_id, first(size ORDER BY ord) AS newest FROM {git_log} WHERE size IS NOT NULL GROUP BY asset_id)"""


@query(f"""WITH {_OLDER}, f AS (SELECT l.asset_id, 'git:' || hash || ':' || path AS url, max(size) AS size, min(ord) AS ord FROM {{git_log}} l JOIN a USING (asset_id) JOIN n USING (asset_id) WHERE size > coalesce(bytes, newest) GROUP BY ALL)
 SELECT asset_id, CAST(row_number() OVER (PARTITION BY asset_id ORDER BY size DESC, ord, url) - 1 AS INT) AS ord, url, 'git-history' AS via, size FROM f""")
def history_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = view(spark, sf_dir, "assets").select("asset_id", F.lit(None).cast("string").alias("url"), F.lit("img").alias("local_path"), F.when(F.col("asset_id") % 3 != 0, F.col("file_bytes")).alias("bytes"))
    return history.proposals(a, view(spark, sf_dir, "git_log"), "asset_id")


@query("""SELECT file_id, CASE WHEN h LIKE 'FFD8FF%' THEN 'jpeg' WHEN h LIKE '89504E470D0A1A0A%' THEN 'png' WHEN h LIKE '52494646%' AND substr(h, 17, 8) = '57454250' THEN 'webp' WHEN h LIKE '47494638%' THEN 'gif'
   WHEN substr(h, 9, 8) = '66747970' THEN CASE WHEN substr(h, 17, 8) IN ('61766966', '61766973') THEN 'avif' END WHEN h LIKE '3C73766720%' THEN 'svg' END AS scan,
  CASE WHEN h LIKE 'FFD8FF%' THEN 'jpeg' WHEN h LIKE '89504E470D0A1A0A%' THEN 'png' WHEN h LIKE '52494646%' AND substr(h, 17, 8) = '57454250' THEN 'webp' WHEN h LIKE '474946383761%' OR h LIKE '474946383961%' THEN 'gif'
   WHEN substr(h, 9, 8) = '66747970' AND substr(h, 17, 8) IN ('61766966', '61766973') THEN 'avif' END AS probe,
  regexp_matches(lower(name), '\\.(jpg|jpeg|png|webp|avif|gif|svg)$') AS image_name FROM (SELECT file_id, name, hexbytes AS h FROM {files}) f""")
def sniffed_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = view(spark, sf_dir, "files").withColumn("content", F.unhex("hexbytes"))
    return f.select("file_id", containers.sniff(F.col("content")).alias("scan"), containers.sniff(F.col("content"), "probe").alias("probe"), F.col("name").rlike(containers.IMAGE_NAME).alias("image_name"))


@query("SELECT file_id, 'sha256:' || sha256(unhex(hexbytes)) AS hash, regexp_replace(name, '\\.[^./]*$', '') || '.webp' AS output FROM {files}")
def content_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = view(spark, sf_dir, "files")
    return f.select("file_id", containers.content_hash(F.unhex("hexbytes")).alias("hash"), containers.output_path(F.col("name"), F.lit("webp")).alias("output"))


# ---- receipts ----------------------------------------------------------------------

_PARSED = """p AS (SELECT line, raw, CASE WHEN line % 17 = 0 THEN 'invalid JSON' WHEN line % 23 = 0 THEN 'v must be 1'
   WHEN line % 13 = 0 THEN 'outputHash must be text or null' WHEN line % 7 = 0 THEN 'reference must have w, h and hash'
   WHEN line % 4 = 0 AND line % 3 = 0 THEN 'an encoded entry must have outputHash, output and metrics' END AS reason,
   raw::VARCHAR AS r FROM {receipts} WHERE line % 17 = 0 OR line % 19 <> 0)"""


@query(f"WITH {_PARSED} SELECT line, reason FROM p")
def receipt_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return receipts.parse(view(spark, sf_dir, "receipts")).select("line", "reason")


_ENTRIES = f"""{_PARSED}, e AS (SELECT line, json_extract_string(r, '$.asset') AS asset, json_extract_string(r, '$.decision') AS decision, json_extract_string(r, '$.sourceHash') AS sh, json_extract_string(r, '$.outputHash') AS oh FROM p WHERE reason IS NULL),
 m AS (SELECT line, asset, decision, EXISTS (SELECT 1 FROM {{provided}} f WHERE f.hash = e.oh) AS o, EXISTS (SELECT 1 FROM {{provided}} f WHERE f.hash = e.sh) AS s,
   EXISTS (SELECT 1 FROM {{provided}} f WHERE lower(f.name) = lower(regexp_extract(e.asset, '[^/]*$'))) AS n FROM e),
 c AS (SELECT line, asset, decision, CASE WHEN decision <> 'encoded' THEN 'not-applicable' WHEN o AND s THEN 'verifiable' WHEN o THEN 'reference-missing' ELSE 'file-missing' END AS classification,
   CASE WHEN decision = 'encoded' THEN CASE WHEN o AND s THEN NULL WHEN o THEN 'unverifiable' WHEN n THEN 'refuted' ELSE 'unverifiable' END WHEN s THEN 'pass' WHEN n THEN 'refuted' ELSE 'unverifiable' END AS verdict FROM m)"""


def _matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = receipts.parse(view(spark, sf_dir, "receipts")).where("reason is null")
    return verify.match(good.select("line", "asset", "decision", "source_hash", "output_hash"), view(spark, sf_dir, "provided"))


@query(f"WITH {_ENTRIES} SELECT line, asset, decision, classification, verdict FROM c")
def receipt_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matched(spark, sf_dir)


@query(f"""WITH {_ENTRIES} SELECT count(*) FILTER (verdict = 'pass') AS pass, count(*) FILTER (verdict = 'refuted') AS refuted, count(*) FILTER (verdict = 'unverifiable') AS unverifiable, count(*) FILTER (verdict IS NULL) AS to_measure, count(*) AS entries FROM c""")
def verify_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.totals(_matched(spark, sf_dir))


# ---- request state -------------------------------------------------------------------


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = view(spark, sf_dir, "requests")
    return r.select("client", "event_id", F.expr("timestampdiff(MILLISECOND, timestamp'1970-01-01 00:00:00', ts)").alias("at"), "url")


@query("""WITH q AS (SELECT client, event_id, epoch_us(ts) // 1000 AS t, row_number() OVER (PARTITION BY client ORDER BY epoch_us(ts) // 1000, event_id) AS k FROM {requests}),
 s AS (SELECT client, event_id, t, k, CAST(0 AS BIGINT) AS wait, [t] AS hits FROM q WHERE k = 1
   UNION ALL SELECT client, event_id, t, k, wait, CASE WHEN wait = 0 THEN list_append(day, t) ELSE day END FROM (SELECT *, greatest(CASE WHEN len(hour) >= 2 THEN hour[len(hour) - 1] + 3600000 - t ELSE 0 END, CASE WHEN len(day) >= 10 THEN day[len(day) - 9] + 86400000 - t ELSE 0 END) AS wait FROM
     (SELECT q.*, list_filter(s.hits, lambda x: x > q.t - 3600000) AS hour, list_filter(s.hits, lambda x: x > q.t - 86400000) AS day FROM s JOIN q ON q.client = s.client AND q.k = s.k + 1) j) w)
 SELECT client, event_id, t AS "at", wait = 0 AS allowed, wait AS retry_after FROM s""")
def rate_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return limits.limit_batch(_requests(spark, sf_dir), ((3_600_000, 2), (86_400_000, 10)))


@query("""WITH q AS (SELECT url, event_id, epoch_us(ts) // 1000 AS t, row_number() OVER (PARTITION BY url ORDER BY epoch_us(ts) // 1000, event_id) AS k FROM {requests}),
 s AS (SELECT url, event_id, t, k, false AS hit, t + 600000 AS until FROM q WHERE k = 1
   UNION ALL SELECT q.url, q.event_id, q.t, q.k, q.t < s.until, CASE WHEN q.t < s.until THEN s.until ELSE q.t + 600000 END FROM s JOIN q ON q.url = s.url AND q.k = s.k + 1)
 SELECT url, event_id, t AS "at", hit FROM s""")
def cache_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return limits.cache_batch(_requests(spark, sf_dir), 600_000).select("url", "event_id", "at", "hit")


# ten clients share an instance; targets are missing, wrong, refused, failing, no images, or written in two ways
_TARGETS = """SELECT event_id, client, CAST(floor(client / 10) AS BIGINT) AS instance, ts, CASE WHEN event_id % 41 = 0 THEN NULL WHEN event_id % 43 = 0 THEN '' WHEN event_id % 37 = 0 THEN 'no address'
  ELSE concat('https://img.example/', split_part(url, '/', 2), '/', CAST(client % 5 AS VARCHAR(9)), CASE WHEN event_id % 2 = 0 THEN '?a=1&b=2' ELSE '?b=2&a=1#top' END) END AS target FROM {requests}"""
_RESPONSES = """SELECT concat('https://img.example/', event_type, '/', CAST(k AS VARCHAR(9)), '?a=1&b=2') AS url, CASE WHEN k = 4 THEN CASE event_type WHEN 'click' THEN 'private-address' WHEN 'view' THEN 'timeout' ELSE 'content-type' END END AS refusal,
  CASE WHEN k = 3 AND event_type <> 'view' THEN 404 ELSE 206 END AS upstream, CASE WHEN k = 2 AND event_type = 'view' THEN 'svg' ELSE 'jpeg' END AS container FROM (SELECT DISTINCT split_part(url, '/', 2) AS event_type, client % 5 AS k FROM {requests}) AS d WHERE NOT (k = 1 AND event_type = 'click')"""


def probe_requests(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Requests and responses of the probe over the events."""
    r = view(spark, sf_dir, "requests")
    asked = spark.sql(_TARGETS, requests=r).withColumn("at", F.expr("timestampdiff(MILLISECOND, timestamp'1970-01-01 00:00:00', ts)"))
    return asked, spark.sql(_RESPONSES, requests=r)


PROBE_LIMITS = {"windows": ((3_600_000, 2), (86_400_000, 4)), "ttl_ms": 172_800_000, "most": 6}


@query(f"""WITH t AS (SELECT *, epoch_us(ts) // 1000 AS t FROM ({_TARGETS}) x), rs AS ({_RESPONSES}),
 q AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY client ORDER BY t, event_id) AS k FROM t WHERE coalesce(target, '') <> ''),
 s AS (SELECT event_id, client, k, CAST(0 AS BIGINT) AS wait, [t] AS hits FROM q WHERE k = 1
   UNION ALL SELECT event_id, client, k, wait, CASE WHEN wait = 0 THEN list_append(day, t) ELSE day END FROM (SELECT *, greatest(CASE WHEN len(hour) >= 2 THEN hour[len(hour) - 1] + 3600000 - t ELSE 0 END, CASE WHEN len(day) >= 4 THEN day[len(day) - 3] + 86400000 - t ELSE 0 END) AS wait FROM
     (SELECT q.*, list_filter(s.hits, lambda x: x > q.t - 3600000) AS hour, list_filter(s.hits, lambda x: x > q.t - 86400000) AS day FROM s JOIN q ON q.client = s.client AND q.k = s.k + 1) j) w),
 a AS (SELECT q.event_id, q.instance, q.t, q.target, s.wait, CASE WHEN s.wait = 0 AND q.target LIKE 'https:%' THEN replace(replace(q.target, '#top', ''), 'b=2&a=1', 'a=1&b=2') END AS url FROM q JOIN s USING (event_id)),
 o AS MATERIALIZED (SELECT a.*, CASE WHEN a.url IS NULL THEN NULL WHEN rs.url IS NULL THEN 'network-error' WHEN refusal IS NOT NULL THEN refusal WHEN upstream >= 300 THEN 'upstream-status' WHEN container = 'svg' THEN 'unrecognized-container' END AS code, row_number() OVER (PARTITION BY instance ORDER BY t, a.event_id) AS k FROM a LEFT JOIN rs ON rs.url = a.url WHERE a.url IS NOT NULL),
 c AS (SELECT event_id, instance, k, false AS hit, CASE WHEN code IS NULL THEN [struct_pack(u := url, e := t + 172800000)] ELSE [] END AS held FROM o WHERE k = 1
   UNION ALL SELECT event_id, instance, k, hit, CASE WHEN hit OR code IS NOT NULL THEN CASE WHEN hit THEN held ELSE gone END ELSE list_append(CASE WHEN len(gone) >= 6 THEN gone[2:] ELSE gone END, struct_pack(u := url, e := t + 172800000)) END FROM
     (SELECT o.*, c.held, len(list_filter(c.held, lambda x: x.u = o.url AND o.t < x.e)) > 0 AS hit, list_filter(c.held, lambda x: x.u <> o.url) AS gone FROM c JOIN o ON o.instance = c.instance AND o.k = c.k + 1) j)
 SELECT t.event_id, t.t AS "at", CAST(CASE WHEN coalesce(t.target, '') = '' THEN 400 WHEN a.wait > 0 THEN 429 WHEN a.url IS NULL THEN 400 WHEN c.hit THEN 200 ELSE CASE o.code WHEN 'private-address' THEN 400 WHEN 'content-type' THEN 415 WHEN 'unrecognized-container' THEN 415 WHEN 'timeout' THEN 504 WHEN 'network-error' THEN 502 WHEN 'upstream-status' THEN 502 ELSE 200 END END AS INT) AS status,
   CASE WHEN coalesce(t.target, '') = '' THEN 'missing-url' WHEN a.wait > 0 THEN 'rate-limited' WHEN a.url IS NULL THEN 'invalid-url' WHEN NOT c.hit THEN o.code END AS code, coalesce(c.hit, false) AS cached, CASE WHEN a.wait > 0 THEN greatest(1, CAST(ceil(a.wait / 1000.0) AS BIGINT)) END AS retry_after
 FROM t LEFT JOIN a USING (event_id) LEFT JOIN o USING (event_id) LEFT JOIN c USING (event_id)""")
def probe_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked, responses = probe_requests(spark, sf_dir)
    return probe.answers(asked, responses, **PROBE_LIMITS)


from frametally.plans import audit_queries, encode_queries, evidence_queries  # noqa: E402, F401  (registers its queries here)
