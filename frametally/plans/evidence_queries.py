"""Queries for what pixels and headers tell of an image's past, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frametally.operators import headers, pixels, provenance, resize, spectrum
from frametally.plans.queries import query
from frametally.plans.views import view

# ---- spectra: SQL by a table of what each source pixel adds to each frequency of the windowed, resampled axis

_HANN = "(0.5 - 0.5 * cos(2 * pi() * t / (n - 1)))"
_SHARES = f"""z AS MATERIALIZED (SELECT image, CAST(max(x) + 1 AS INT) AS w, CAST(max(y) + 1 AS INT) AS h FROM {{pictures}} GROUP BY image),
 g AS MATERIALIZED (SELECT *, CASE WHEN greatest(w, h) <= 256 THEN 256 WHEN greatest(w, h) <= 512 THEN 512 ELSE 1024 END AS n FROM z WHERE least(w, h) >= 16),
 ax AS (SELECT DISTINCT w AS s, n FROM g UNION SELECT DISTINCT h, n FROM g),
 place AS (SELECT s, n, t, least(greatest((t + 0.5) * s / n - 0.5, 0), s - 1) AS p FROM ax, range(1024) r(t) WHERE s <= n AND t < n),
 tap AS (SELECT s, n, t, i, least(i + 1, (t + 1) * (s / n)) - greatest(i, t * (s / n)) AS c FROM ax, range(1024) r(t), range((SELECT max(s) FROM ax)) q(i) WHERE s > n AND i < s AND i + 1 > t * (s / n) AND i < (t + 1) * (s / n)
   UNION ALL SELECT s, n, t, floor(p), (1 - (p - floor(p))) * s / n FROM place UNION ALL SELECT s, n, t, least(floor(p) + 1, s - 1), (p - floor(p)) * s / n FROM place),
 k AS MATERIALIZED (SELECT s, n, CAST(i AS BIGINT) AS i, f, sum(c * n / s * {_HANN} * cos(2 * pi() * f * t / n)) AS re, -sum(c * n / s * {_HANN} * sin(2 * pi() * f * t / n)) AS im FROM tap, range(-512, 513) f(f) WHERE f BETWEEN -n // 2 AND n // 2 GROUP BY s, n, i, f),
 wf AS MATERIALIZED (SELECT n, f, sum({_HANN} * cos(2 * pi() * f * t / n)) AS re, -sum({_HANN} * sin(2 * pi() * f * t / n)) AS im FROM (SELECT DISTINCT n FROM g), range(1024) r(t), range(-512, 513) f(f) WHERE t < n AND f BETWEEN -n // 2 AND n // 2 GROUP BY n, f),
 r AS MATERIALIZED (SELECT g.image, g.h, g.n, p.y, k.f AS u, sum(p.value * k.re) AS re, sum(p.value * k.im) AS im FROM {{pictures}} p JOIN g USING (image) JOIN k ON k.s = g.w AND k.n = g.n AND k.i = p.x WHERE k.f >= 0 GROUP BY ALL),
 m AS (SELECT r.image, sum(r.re * k.re) / any_value(c.re * c.re) AS mean FROM r JOIN k ON k.s = r.h AND k.n = r.n AND k.i = r.y AND k.f = 0 JOIN wf c ON c.n = r.n AND c.f = 0 WHERE r.u = 0 GROUP BY r.image),
 q AS (SELECT r.image, r.n, r.u, k.f AS v, sum(r.re * k.re - r.im * k.im) AS re, sum(r.re * k.im + r.im * k.re) AS im FROM r JOIN k ON k.s = r.h AND k.n = r.n AND k.i = r.y WHERE k.f < r.n // 2 AND 4 * (r.u * r.u + k.f * k.f) <= r.n * r.n GROUP BY ALL),
 a AS (SELECT q.image, least(63, CAST(floor(128 * sqrt(CAST(q.u * q.u + q.v * q.v AS DOUBLE)) / q.n) AS INT)) AS bin, CASE WHEN q.u IN (0, q.n // 2) THEN 1 ELSE 2 END AS times,
   pow(q.re - m.mean * (x.re * y.re - x.im * y.im), 2) + pow(q.im - m.mean * (x.re * y.im + x.im * y.re), 2) AS p FROM q JOIN m USING (image) JOIN wf x ON x.n = q.n AND x.f = q.u JOIN wf y ON y.n = q.n AND y.f = q.v),
 b AS (SELECT image, bin, sum(p * times) / sum(times) AS raw FROM a GROUP BY image, bin),
 o AS (SELECT image, max(raw * (bin + 0.5) * (bin + 0.5)) FILTER (bin >= 3) AS top, max(raw) FILTER (bin >= 1) AS peak FROM b GROUP BY image),
 cut AS (SELECT b.image, CASE WHEN any_value(peak) > 1e-6 THEN (coalesce(max(bin) FILTER (bin >= 1 AND raw * (bin + 0.5) * (bin + 0.5) > 0.4 * top), 1) + 1) / 64.0 END AS cut FROM b JOIN o USING (image) GROUP BY b.image),
 share AS (SELECT z.image, z.w, z.h, g.n, CASE WHEN cut IS NOT NULL THEN least(1.0, CAST(cut AS DOUBLE) * g.n / greatest(z.w, z.h)) WHEN g.n IS NOT NULL THEN 1 / 64.0 END AS share FROM z LEFT JOIN g USING (image) LEFT JOIN cut ON cut.image = z.image),
 resolved AS (SELECT image, w, h, share, CAST(floor(w * share + 0.5) AS INT) AS effective_w, CAST(floor(h * share + 0.5) AS INT) AS effective_h,
   CASE WHEN n IS NOT NULL THEN CAST(floor(w * least(1.0, CAST(n AS DOUBLE) / greatest(w, h)) + 0.5) AS INT) END AS certified_w, CASE WHEN n IS NOT NULL THEN CAST(floor(h * least(1.0, CAST(n AS DOUBLE) / greatest(w, h)) + 0.5) AS INT) END AS certified_h FROM share)"""


@query(f"WITH {_SHARES} SELECT image, w, h, round(share, 6) AS share, effective_w, effective_h, certified_w, certified_h FROM resolved")
def effective_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spectrum.resolution(view(spark, sf_dir, "pictures"), "image").withColumn("share", F.round("share", 6))


# the pictures' interiors hold no tile of 16 pixels, so each is one tile
_SHARPNESS = """size_ AS (SELECT image, CAST(max(x) + 1 AS INT) AS w, CAST(max(y) + 1 AS INT) AS h, 1024.0 / (max(greatest(x, y)) + 1) AS s FROM {pictures} GROUP BY image),
 target AS (SELECT image, w, h, CAST(floor(w * s + 0.5) AS INT) AS tw, CAST(floor(h * s + 0.5) AS INT) AS th FROM size_ WHERE s < 1),
 cover AS MATERIALIZED (SELECT s, n, a, t, least(a + 1, (t + 1) * (s / n)) - greatest(a, t * (s / n)) AS c FROM (SELECT DISTINCT w AS s, tw AS n FROM target UNION SELECT DISTINCT h, th FROM target), range((SELECT max(w) FROM target)) q(a), range(1024) r(t) WHERE a < s AND t < n AND a + 1 > t * (s / n) AND a < (t + 1) * (s / n)),
 small AS (SELECT p.image, i.t AS x, j.t AS y, round_even(round(sum(p.value * i.c * j.c) / sum(i.c * j.c), 9), 0) AS value FROM {pictures} p JOIN target m USING (image) JOIN cover i ON i.s = m.w AND i.n = m.tw AND i.a = p.x JOIN cover j ON j.s = m.h AND j.n = m.th AND j.a = p.y GROUP BY ALL),
 shown AS MATERIALIZED (SELECT image, x, y, CAST(value AS DOUBLE) AS value FROM {pictures} WHERE image NOT IN (SELECT image FROM target) UNION ALL SELECT image, x, y, greatest(0, least(255, value)) FROM small),
 lap AS (SELECT c.image, w.value + e.value + n.value + s.value - 4 * c.value AS l FROM shown c JOIN shown w ON w.image = c.image AND w.y = c.y AND w.x = c.x - 1 JOIN shown e ON e.image = c.image AND e.y = c.y AND e.x = c.x + 1
   JOIN shown n ON n.image = c.image AND n.x = c.x AND n.y = c.y - 1 JOIN shown s ON s.image = c.image AND s.x = c.x AND s.y = c.y + 1),
 sharp AS (SELECT image, greatest(0, avg(l * l) - avg(l) * avg(l)) AS p95 FROM lap GROUP BY image)"""


@query(f"WITH {_SHARPNESS} SELECT image, round(p95, 4) AS p95, CAST(1 AS BIGINT) AS tiles FROM sharp")
def laplacian_sharpness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sharpness of pictures, those over 1,024 pixels scaled down first."""
    s = pixels.laplacian(resize.normalised(view(spark, sf_dir, "pictures"), "image"), "image")
    return s.select("image", F.round("p95", 4).alias("p95"), F.col("tiles").cast("long").alias("tiles"))


# ---- headers: SQL from the tables and frames that the bytes were made of, not from the bytes

_SIGNED = """format('{{:08x}}', list_reduce(list_concat([2166136261, CASE WHEN k = 2 THEN 1 ELSE 0 END], flatten(list([v >> 8, v & 255] ORDER BY i))), lambda a, b: (xor(a, b) * 16777619) & 4294967295))"""
_HEADERS = f"""cells AS MATERIALIZED (SELECT * FROM {{jpeg_cells}} WHERE k NOT IN (8, 9) AND (t = 0 OR k NOT IN (3, 5))),
 pair AS (SELECT DISTINCT k, q, t, i, v FROM cells),
 dims AS (SELECT b.family, c.ql, b.t, b.i, greatest(1, least(CASE WHEN w.wide THEN 32767 ELSE 255 END, floor((b.b * CASE WHEN c.ql < 50 THEN floor(5000 / c.ql) ELSE 200 - 2 * c.ql END + 50) / 100))) AS e, w.wide FROM {{quant_bases}} b, range(1, 101) c(ql), (VALUES (true), (false)) w(wide)),
 fits AS (SELECT p.k, p.q, d.family, d.ql, sum(abs(p.v - d.e) / d.e) / count(*) AS fit FROM pair p JOIN dims d ON d.t = p.t AND d.i = p.i AND d.wide = (p.k = 2) GROUP BY ALL),
 best AS (SELECT k, q, arg_min((family, ql), (round(fit, 12), family, ql)) AS b, min(fit) AS fit, count(DISTINCT family) FILTER (fit = 0) AS families, min(family) FILTER (fit = 0) AS only_ FROM fits GROUP BY k, q),
 sign AS (SELECT file_id, string_agg(CASE WHEN t = 0 THEN 'luma ' ELSE 'chroma ' END || s, ', ' ORDER BY t) AS signed FROM (SELECT file_id, t, {_SIGNED} AS s FROM cells GROUP BY file_id, k, t) x GROUP BY file_id),
 known AS (SELECT p_partkey AS file_id, k.k, CASE WHEN k.k = 8 THEN 'png' ELSE 'jpeg' END AS container, CASE WHEN k.k NOT IN (5, 6, 8, 9) THEN CAST(100 + 3 * p_size AS INT) END AS width, CASE WHEN k.k NOT IN (5, 6, 8, 9) THEN CAST(60 + 2 * p_size AS INT) END AS height,
   CASE WHEN k.k NOT IN (5, 6, 8, 9) THEN 8 END AS bits, CASE WHEN k.k <> 8 THEN k.k = 1 END AS progressive, CASE WHEN k.k <> 8 THEN k.k IN (5, 9) END AS truncated, CASE k.k WHEN 1 THEN '4:4:4' WHEN 3 THEN 'none' WHEN 10 THEN '4:2:2' WHEN 0 THEN '4:2:0' WHEN 2 THEN '4:2:0' WHEN 4 THEN '4:2:0' WHEN 7 THEN '4:2:0' END AS subsampling,
   CASE WHEN fit <= 0.05 THEN CAST(b[2] AS INT) END AS quality, CASE WHEN fit <= 0.05 THEN CASE b[1] WHEN 0 THEN 'standard' ELSE 'psychovisual' END END AS family, fit, CASE WHEN families = 1 THEN CASE only_ WHEN 0 THEN 'standard' ELSE 'psychovisual' END END AS encoder, signed
   FROM part JOIN (SELECT p_partkey AS id, p_partkey % 12 AS k, 50 + p_size AS q FROM part) k ON k.id = p_partkey LEFT JOIN best ON best.k = k.k AND best.q = k.q LEFT JOIN sign s ON s.file_id = p_partkey),
 noted AS (SELECT *, list_filter([CASE WHEN container = 'png' THEN 'only the name of container png is known' END, CASE WHEN truncated THEN 'header cut short' END, 'chroma subsampling ' || subsampling,
   CASE WHEN container = 'png' THEN NULL WHEN fit IS NULL THEN 'no quantisation tables' WHEN quality IS NULL THEN 'tables of no known family: ' || signed WHEN fit = 0 THEN 'tables fit ' || family || ' at quality ' || quality || ' exactly' ELSE 'tables fit ' || family || ' at quality ' || quality || printf(' with deviation %.4f', fit) END,
   'encoder ' || encoder], lambda x: x IS NOT NULL) AS notes FROM known)"""
_ROOM = """CASE WHEN quality < 60 THEN 'none: quality ' || quality || ' is below 60' WHEN quality < 78 THEN 'low: quality ' || quality || ' is below 78' ELSE 'normal: no exhaustion evidence' END"""


@query(f"""WITH {_HEADERS} SELECT file_id, container, width, height, bits, progressive, truncated, subsampling, quality, family, encoder, CASE WHEN container = 'jpeg' THEN split_part({_ROOM}, ':', 1) END AS headroom,
 array_to_string(CASE WHEN container = 'jpeg' THEN list_concat(notes, ['generations are unknown without pixels', 'headroom ' || {_ROOM}]) ELSE notes END, ' | ') AS evidence FROM noted""")
def header_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files built as bytes: tables of 8 and 16 bits, one or two to a segment, repeated, cut short, in grey, and no JPEG."""
    files = view(spark, sf_dir, "jpegs").select("file_id", F.unhex("hexbytes").alias("content"))
    return headers.evidence(files, "file_id").withColumn("evidence", F.array_join("evidence", " | ")).drop("generations")


# ---- provenance records

_SOFTNESS = """CASE WHEN p95 IS NULL THEN 'unknown' WHEN greatest(width, height) <= 1024 THEN CASE WHEN p95 >= 500 THEN 'sharp' WHEN p95 < 100 THEN 'soft' ELSE 'unknown' END ELSE CASE WHEN p95 >= 140 THEN 'sharp' WHEN p95 < 28 THEN 'soft' ELSE 'unknown' END END"""
_TOLD = f"""scored AS (SELECT *, CASE WHEN seams <= 1 THEN 0.0 ELSE 1 - 1 / seams END AS score, coalesce(greatest(ew, eh) < 0.625 * greatest(cw, ch), false) AS upscaled, {_SOFTNESS} AS softness,
   list_filter([CASE WHEN g >= 2 THEN 'at least ' || g || ' encode generations' END, CASE WHEN q < 60 THEN 'quality ' || q || ' is below 60' END, CASE WHEN container IN ('png', 'gif') AND CASE WHEN seams <= 1 THEN 0.0 ELSE 1 - 1 / seams END >= 1 / 3.0 THEN 'lossless container with jpeg seams' END], lambda x: x IS NOT NULL) AS gone FROM i),
 roomy AS (SELECT *, CASE WHEN len(gone) > 0 THEN 'none' WHEN q < 78 THEN 'low' ELSE 'normal' END AS headroom, CASE WHEN len(gone) > 0 THEN array_to_string(gone, '; ') WHEN q < 78 THEN 'quality ' || q || ' is below 78' ELSE 'no exhaustion evidence' END AS why FROM scored),
 told AS (SELECT *, concat_ws(' | ', 'container ' || container || ', ' || width || 'x' || height, nullif(array_to_string(said, ' | '), ''), 'encode generations ' || g, 'seams score ' || printf('%.4f', score),
   CASE WHEN ew IS NULL THEN 'no spectrum to go by' WHEN upscaled THEN 'enlarged from ' || ew || 'x' || eh ELSE 'detail up to ' || ew || 'x' || eh END, 'softness ' || softness, 'headroom ' || headroom || ': ' || why) AS evidence FROM roomy)"""


# a quarter of the assets hold half the detail that they declare
@query(f"""WITH i AS (SELECT asset_id, container, declared_w AS width, declared_h AS height, CASE WHEN container = 'jpeg' THEN quality END AS q, CASE WHEN container = 'jpeg' THEN generations END AS g, CASE WHEN blocking_score = 0 THEN 1 ELSE 1 / (1 - blocking_score) END AS seams,
   CASE WHEN effective_w IS NOT NULL THEN CAST(floor(least(effective_w * half, cw)) AS BIGINT) END AS ew, CASE WHEN effective_h IS NOT NULL THEN CAST(floor(least(effective_h * half, ch)) AS BIGINT) END AS eh, cw, ch, p_size * 12.0 AS p95, [CASE WHEN container = 'jpeg' THEN 'quality about ' || quality END] AS said
   FROM (SELECT *, CASE WHEN asset_id % 4 = 1 THEN 0.5 ELSE 1 END AS half, CAST(floor(declared_w * least(1, 1024.0 / greatest(declared_w, declared_h)) + 0.5) AS BIGINT) AS cw, CAST(floor(declared_h * least(1, 1024.0 / greatest(declared_w, declared_h)) + 0.5) AS BIGINT) AS ch FROM {{assets}}) a),
 {_TOLD} SELECT asset_id, upscaled, softness, headroom, evidence FROM told""")
def provenance_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    jpeg, detail = F.col("container") == "jpeg", F.when(F.col("asset_id") % 4 == 1, 0.5).otherwise(1.0)
    edge = F.greatest("declared_w", "declared_h")
    certified = {s: F.floor(F.col(f"declared_{s}") * F.least(F.lit(1.0), F.lit(1024.0) / edge) + 0.5) for s in "wh"}
    effective = [F.when(F.col(f"effective_{s}").isNotNull(), F.floor(F.least(F.col(f"effective_{s}") * detail, certified[s].cast("double")))).alias(f"effective_{s}") for s in "wh"]
    a = view(spark, sf_dir, "assets").select(
        "asset_id", "container", F.col("declared_w").alias("width"), F.col("declared_h").alias("height"), F.when(jpeg, F.col("quality")).alias("quality"), F.lit(None).cast("string").alias("encoder"), F.lit(None).cast("string").alias("subsampling"),
        F.when(jpeg, F.col("generations")).alias("generations"), F.when(F.col("blocking_score") == 0, 1.0).otherwise(1 / (1 - F.col("blocking_score"))).alias("seams"), *effective, *[certified[s].alias(f"certified_{s}") for s in "wh"],
        (F.col("p_size") * 12.0).alias("p95"), F.array(F.when(jpeg, F.concat(F.lit("quality about "), F.col("quality").cast("string")))).alias("said"),
    )
    return provenance.records(a).select("asset_id", "upscaled", "softness", "headroom", F.array_join("evidence", " | ").alias("evidence"))


_SEAMS = """across AS (SELECT a.image, abs(b.value - a.value) AS d, b.x AS pos FROM {pictures} a JOIN {pictures} b ON a.image = b.image AND a.y = b.y AND b.x = a.x + 1),
 down AS (SELECT a.image, abs(b.value - a.value) AS d, b.y AS pos FROM {pictures} a JOIN {pictures} b ON a.image = b.image AND a.x = b.x AND b.y = a.y + 1),
 seam AS (SELECT z.image, ((CASE WHEN z.w < 17 THEN 1 ELSE a.r END) + (CASE WHEN z.h < 17 THEN 1 ELSE b.r END)) / 2 AS seams FROM z
   JOIN (SELECT image, (coalesce(avg(d) FILTER (pos % 8 = 0), 0) + 1e-6) / (coalesce(avg(d) FILTER (pos % 8 <> 0), 0) + 1e-6) AS r FROM across GROUP BY image) a USING (image)
   JOIN (SELECT image, (coalesce(avg(d) FILTER (pos % 8 = 0), 0) + 1e-6) / (coalesce(avg(d) FILTER (pos % 8 <> 0), 0) + 1e-6) AS r FROM down GROUP BY image) b USING (image))"""


@query(f"""WITH {_SHARES}, {_SHARPNESS}, {_HEADERS}, {_SEAMS},
 i AS (SELECT z.image, coalesce(n.container, 'png') AS container, z.w AS width, z.h AS height, n.quality AS q, n.encoder, n.subsampling, NULL AS g, seams, effective_w AS ew, effective_h AS eh, certified_w AS cw, certified_h AS ch, p95, coalesce(n.notes, []) AS said
   FROM z JOIN resolved e USING (image) JOIN seam USING (image) LEFT JOIN sharp USING (image) LEFT JOIN noted n ON n.file_id = z.image), {_TOLD}
 SELECT image, container, quality, encoder, subsampling, upscaled, softness, headroom, evidence FROM (SELECT *, q AS quality FROM told) t""")
def image_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of the pictures from their pixels and, where a file has their number, its header."""
    files = view(spark, sf_dir, "jpegs").select(F.col("file_id").alias("image"), F.unhex("hexbytes").alias("content"))
    r = provenance.measured(view(spark, sf_dir, "pictures"), files, "image")
    return r.select("image", "container", "quality", "encoder", "subsampling", "upscaled", "softness", "headroom", F.array_join("evidence", " | ").alias("evidence"))
