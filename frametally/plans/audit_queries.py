"""Queries of audits, verification and capped bodies, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frametally.operators import audit, bodies, verify
from frametally.plans.evidence_queries import _HEADERS
from frametally.plans.queries import query
from frametally.plans.views import view


@query("""SELECT l_orderkey AS body, CAST(least(100000, sum(size)) AS BIGINT) AS "read", count(*) FILTER (before < 100000 AND size > 0) AS chunks, sum(size) > 100000 AS truncated FROM (
 SELECT l_orderkey, size, coalesce(sum(size) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(floor(l_extendedprice) AS BIGINT) AS size FROM lineitem) s) c GROUP BY l_orderkey""")
def capped_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as bodies, their lines as chunks."""
    size = F.floor("l_extendedprice").cast("long")
    # lines of one number are told apart by part, supplier and size
    chunks = view(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("body"), F.struct("l_linenumber", "l_partkey", "l_suppkey", size).alias("ord"), size.alias("size"))
    return bodies.read(chunks, "body", "ord", "size", 100_000)


# ---- audits: images of pages are files of the header query; one in eleven can't be fetched

_ITEMS = """SELECT page, idx, concat('/i/', CAST(page AS VARCHAR(20)), '/', CAST(idx AS VARCHAR(9))) AS url, 1 + (page * 7 + idx) % (SELECT count(*) FROM {part}) AS file_id, CASE WHEN (page + idx) % 11 = 0 THEN NULL ELSE bytes END AS length,
 attr_w, attr_h, CASE WHEN idx % 2 = 0 THEN 40 ELSE NULL END AS display_w, CASE WHEN idx % 2 = 0 THEN 30 ELSE NULL END AS display_h FROM {page_items}"""
_CAPS = {"images": 5, "head": 9_000, "total": 24_000}


@query(f"""WITH {_HEADERS}, items AS ({_ITEMS}),
 placed AS (SELECT *, row_number() OVER w AS place, coalesce(sum(CASE WHEN idx_place <= 5 AND length IS NOT NULL THEN least(length, 9000) ELSE 0 END) OVER (PARTITION BY page ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY idx) AS idx_place FROM items) i WINDOW w AS (PARTITION BY page ORDER BY idx)),
 stated AS (SELECT *, CASE WHEN place > 5 THEN 'beyond-images' WHEN spent >= 24000 THEN 'beyond-bytes' WHEN length IS NULL THEN 'failed' ELSE 'inspected' END AS state FROM placed),
 seen AS (SELECT s.*, n.container, n.quality, coalesce(n.width, s.attr_w) AS dw, coalesce(n.height, s.attr_h) AS dh FROM stated s LEFT JOIN noted n ON n.file_id = s.file_id AND s.state = 'inspected'),
 saved AS (SELECT *, CASE WHEN state = 'inspected' THEN CASE WHEN container = 'jpeg' THEN CASE WHEN quality < 60 THEN 'none' WHEN quality < 78 THEN 'low' ELSE 'normal' END END END AS headroom,
   CASE WHEN coalesce(display_w * display_h / CAST(dw * dh AS DOUBLE) < 1 / 1.2e0, false) THEN 1 - display_w * display_h / CAST(dw * dh AS DOUBLE) ELSE 0 END AS oversize,
   CASE WHEN container = 'png' THEN 0.18e0 ELSE 0.25e0 + CASE WHEN quality >= 95 THEN 0.3e0 WHEN quality >= 90 THEN 0.2e0 WHEN quality >= 85 THEN 0.1e0 ELSE 0e0 END END AS factor FROM seen)
 SELECT page, count(*) AS found, count(*) FILTER (state = 'inspected') AS inspected, CAST(sum(CASE WHEN state = 'inspected' THEN least(length, 9000) ELSE 0 END) AS BIGINT) AS bytes,
   CAST(coalesce(sum(CASE WHEN state = 'inspected' THEN CASE WHEN headroom = 'none' THEN 0 ELSE floor(length * least(0.95e0, 1 - (1 - oversize) * (1 - factor)) + 0.5) END END), 0) AS BIGINT) AS recoverable,
   count(*) FILTER (headroom = 'none') AS headroom_none, count(*) FILTER (headroom = 'low') AS headroom_low, count(*) FILTER (headroom = 'normal') AS headroom_normal,
   concat_ws(' | ', CASE WHEN count(*) > 5 THEN 'of ' || count(*) || ' images the first 5 are looked at' END, string_agg('not fetched: ' || url, ' | ' ORDER BY idx) FILTER (state = 'failed'), CASE WHEN count(*) FILTER (state = 'beyond-bytes') > 0 THEN '24000 bytes are spent: ' || count(*) FILTER (state = 'beyond-bytes') || ' images are left out' END) AS truncations FROM saved GROUP BY page""")
def audited_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.sql(_ITEMS, page_items=view(spark, sf_dir, "page_items"), part=view(spark, sf_dir, "part"))
    files = view(spark, sf_dir, "jpegs").select("file_id", F.unhex("hexbytes").alias("content"))
    seen = audit.assets(items, **_CAPS, files=files)
    return audit.pages(seen, _CAPS["images"], _CAPS["total"]).withColumn("truncations", F.array_join("truncations", " | "))


# ---- verification: an entry for each plane, of thirteen kinds that the verdicts tell apart

_KIND = "plane % 13"
_ENTRIES = f"""SELECT plane AS line, {_KIND} AS k, concat('img/', CAST(plane AS VARCHAR(20)), '.png') AS asset, CASE {_KIND} WHEN 0 THEN 'kept' ELSE 'encoded' END AS decision, CASE {_KIND} WHEN 1 THEN 'svg' ELSE 'png' END AS before_format, CASE {_KIND} WHEN 0 THEN NULL ELSE 'webp' END AS output_format,
 concat('s', CAST(plane AS VARCHAR(20))) AS source_hash, CASE {_KIND} WHEN 0 THEN NULL ELSE concat('o', CAST(plane AS VARCHAR(20))) END AS output_hash, CASE {_KIND} WHEN 7 THEN 9 WHEN 8 THEN 4 ELSE 8 END AS reference_w, CASE {_KIND} WHEN 8 THEN 4 ELSE 8 END AS reference_h,
 CASE WHEN {_KIND} = 0 THEN NULL WHEN {_KIND} IN (9, 10) THEN CAST(0.9 AS DOUBLE) ELSE CAST(0.9985 AS DOUBLE) END AS ssim, CASE {_KIND} WHEN 0 THEN NULL ELSE CAST(0.05 AS DOUBLE) END AS delta_e, CASE {_KIND} WHEN 0 THEN NULL ELSE CAST(0.01 AS DOUBLE) END AS distortion FROM (SELECT DISTINCT plane FROM {{planes}}) AS p"""
_FILES = f"""SELECT concat(CASE WHEN {_KIND} = 3 THEN '' ELSE '.frametally/sources/' END, 'img/', CAST(plane AS VARCHAR(20)), '.png') AS path, CASE WHEN {_KIND} = 2 THEN 'changed' ELSE concat('s', CAST(plane AS VARCHAR(20))) END AS hash FROM (SELECT DISTINCT plane FROM {{planes}}) AS p
 UNION ALL SELECT concat('img/', CAST(plane AS VARCHAR(20)), '.webp'), CASE {_KIND} WHEN 5 THEN 'changed' ELSE concat('o', CAST(plane AS VARCHAR(20))) END FROM (SELECT DISTINCT plane FROM {{planes}}) AS q WHERE {_KIND} <> 4"""
_PIXELS = f"""SELECT concat(side, CAST(plane AS VARCHAR(20))) AS hash, i % 8 AS x, CAST(floor(i / 8) AS BIGINT) AS y, greatest(0, least(255, value)) AS r, greatest(0, least(255, value)) AS g, greatest(0, least(255, value)) AS b FROM {{planes}} CROSS JOIN (VALUES ('s'), ('o')) AS v(side) WHERE {_KIND} <> 6 OR side = 's'"""
_REPORT = f"""e AS ({_ENTRIES}),
 v AS (SELECT line, asset, decision, k, CASE WHEN k IN (0, 3, 11, 12) THEN 'pass' WHEN k IN (5, 8, 9) THEN 'refuted' ELSE 'unverifiable' END AS verdict, CASE WHEN k IN (2) THEN NULL WHEN k = 3 THEN asset ELSE '.frametally/sources/' || asset END AS found,
   ['no encode to measure', 'format isn''t decoded', 'source missing', 'measured again', 'output missing', 'other output', 'no pixels', 'reference larger than source', 'output of another size', 'numbers differ', 'numbers and reference differ', 'measured again, reference differs', 'measured again'][k + 1] AS why FROM e)"""


def _verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    planes = view(spark, sf_dir, "planes")
    entries, files, pixels = (spark.sql(q, planes=planes) for q in (_ENTRIES, _FILES, _PIXELS))
    # the recorded reference is the plane itself, but for two kinds of entries
    right = verify._image_hash(pixels.where("hash like 's%'").withColumn("line", F.substring("hash", 2, 20).cast("long")), "line")
    wrong = F.when(F.col("k").isin(10, 11), F.lit("sha256:other")).otherwise(F.col("hash"))
    return verify.verified(entries.join(right, "line").withColumn("reference_hash", wrong).drop("hash", "k"), files, pixels)


@query(f"WITH {_REPORT} SELECT line, asset, decision, verdict, CASE WHEN k IN (3, 9, 12) THEN true WHEN k IN (8, 10, 11) THEN false END AS reference_match, found, why FROM v")
def verified_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _verified(spark, sf_dir)


@query(f"WITH {_REPORT} SELECT count(*) AS entries, count(*) FILTER (verdict = 'pass') AS pass, count(*) FILTER (verdict = 'refuted') AS refuted, count(*) FILTER (verdict = 'unverifiable') AS unverifiable, CAST(CASE WHEN count(*) FILTER (verdict = 'refuted') > 0 THEN 1 WHEN count(*) FILTER (verdict = 'unverifiable') > 0 THEN 2 ELSE 0 END AS INT) AS exit_code FROM v")
def verification_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.verification_totals(_verified(spark, sf_dir))
