"""Queries of block encodes made here, of sweeps in order, hull members and all recoverers together, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from frametally.operators import hull, pixels, quant, recover, sweep
from frametally.plans.queries import _BEST, _BLOCKS, _LEGAL, ORACLE_SQL, _hulls, query
from frametally.plans.views import _bases, view
from frametally.streaming.sweeps import FORMATS

# ---- block encodes: each image is all planes of several labels, side by side

_STRIPS = "SELECT CAST(e.label // 5 AS BIGINT) AS image, p.plane * 8 + p.i % 8 AS x, CAST(p.i // 8 AS BIGINT) AS y, CAST(greatest(0, least(255, p.value)) AS DOUBLE) AS value FROM {planes} p JOIN embeddings e ON e.vec_id = p.plane"


def _strips(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = view(spark, sf_dir, "embeddings").where("label is not null").select(F.col("vec_id").alias("plane"), F.expr("label div 5").alias("image"))
    value = F.greatest(F.lit(0), F.least(F.lit(255), F.col("value"))).cast("double")
    return view(spark, sf_dir, "planes").join(labels, "plane").select("image", (F.col("plane") * 8 + F.col("i") % 8).alias("x"), F.expr("i div 8").alias("y"), value.alias("value"))


def _encode_sql(blocks: str, steps: str, out: str) -> str:
    """The decode (named out) of blocks (a table d of coefficients), quantised by steps (a table of u, v, step)."""
    return f"""{out} AS (SELECT d.image, d.block_x * 8 + n.n AS x, d.block_y * 8 + m.m AS y, CAST(least(255, greatest(0, floor(round(128 + sum(s.step * floor(round(d.c, 6) / s.step + 0.5)
   * CASE WHEN d.u = 0 THEN sqrt(0.125) ELSE 0.5 END * cos((2 * n.n + 1) * d.u * pi() / 16) * CASE WHEN d.v = 0 THEN sqrt(0.125) ELSE 0.5 END * cos((2 * m.m + 1) * d.v * pi() / 16)), 6) + 0.5))) AS DOUBLE) AS value
   FROM {blocks} d JOIN {steps} s ON s.u = d.u AND s.v = d.v, range(8) n(n), range(8) m(m) GROUP BY d.image, d.block_x, d.block_y, n.n, m.m)"""


_LUMA = f"luma AS (SELECT i % 8 AS u, i // 8 AS v, CAST(greatest(1, least(255, floor((b * 50 + 50) / 100.0))) AS DOUBLE) AS step FROM ({_bases()}) WHERE family = 0 AND t = 0)"


@query(f"""WITH g AS ({_STRIPS}), {_BLOCKS}, {_LUMA}, {_encode_sql('d', 'luma', 'e')}
 SELECT g.image, count(*) AS pixels, CAST(count(*) FILTER (e.value <> g.value) AS BIGINT) AS changed, sum(abs(e.value - g.value)) AS distance, max(abs(e.value - g.value)) AS farthest FROM g JOIN e ON e.image = g.image AND e.x = g.x AND e.y = g.y GROUP BY g.image""")
def block_encodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an encode with the standard table at quality 75 changes."""
    strips = _strips(spark, sf_dir)
    step = pixels.table_step(quant.scale_table(F.array(*map(F.lit, quant.STANDARD_LUMA)), F.lit(75)))
    after = pixels.encoded(strips, "image", steps=(step,)).withColumnRenamed("value", "after")
    d = F.abs(F.col("after") - F.col("value"))
    return strips.join(after, ["image", "x", "y"]).groupBy("image").agg(F.count(F.lit(1)).alias("pixels"), F.count_if(d > 0).alias("changed"), F.sum(d).alias("distance"), F.max(d).alias("farthest"))


_TWICE = 3


@query(f"""WITH g AS ({_STRIPS}), {_BLOCKS}, flat AS (SELECT u.u, v.v, CAST({_TWICE} AS DOUBLE) AS step FROM range(8) u(u), range(8) v(v)), {_encode_sql('d', 'flat', 'g2')},
 {_BLOCKS.replace('f AS (', 'f2 AS (').replace(' d AS (', ' d2 AS (').replace('FROM g ', 'FROM g2 g ').replace('JOIN f ON', 'JOIN f2 f ON')},
 a AS (SELECT 1 AS encodes, image, u, v, c FROM d UNION ALL SELECT 2, image, u, v, c FROM d2),
 h AS (SELECT encodes, image, u, v, CAST(abs(floor(round(c, 6) + 0.5)) AS BIGINT) AS level, count(*) AS n FROM a WHERE u + v > 0 AND abs(floor(round(c, 6) + 0.5)) BETWEEN 1 AND 40 GROUP BY ALL),
 s AS (SELECT encodes, image, u, v, CAST(sum(n) AS BIGINT) AS samples FROM h GROUP BY ALL),
 l AS (SELECT s.encodes, s.image, s.u, s.v, k.i, ln(1.0 + coalesce(h.n, 0)) AS x FROM s CROSS JOIN range(40) k(i) LEFT JOIN h ON h.encodes = s.encodes AND h.image = s.image AND h.u = s.u AND h.v = s.v AND h.level = k.i + 1),
 e AS (SELECT encodes, image, u, v, i, x - avg(x) OVER (PARTITION BY encodes, image, u, v ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS x FROM l),
 p AS (SELECT encodes, image, u, v, pow(sum(x * cos(2 * pi() * k.k * i / 40)), 2) + pow(sum(x * sin(2 * pi() * k.k * i / 40)), 2) AS p FROM e CROSS JOIN range(3, 21) k(k) GROUP BY encodes, image, u, v, k.k),
 r AS (SELECT encodes, image, u, v, max(p) AS peak, list_sort(list(p))[10] AS middle FROM p GROUP BY ALL),
 b AS (SELECT encodes, image, count(*) FILTER (samples >= 128) AS usable, count(*) FILTER (samples >= 128 AND CASE WHEN middle > 0 THEN peak >= 50 * middle ELSE peak > 0 END) AS periodic FROM r JOIN s USING (encodes, image, u, v) GROUP BY ALL)
 SELECT CAST(encodes AS INT) AS encodes, image, usable, periodic, CASE WHEN usable < 3 THEN NULL WHEN periodic >= 2 THEN 2 WHEN periodic = 0 THEN 1 END AS generations FROM b""")
def made_generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images encoded once, and those encoded with a coarser step before, told apart by their levels."""
    made = pixels.encoded_blocks(pixels.blocks(_strips(spark, sf_dir), "image"), (F.lit(float(_TWICE)),), out="again")
    both = F.array(*[F.struct(F.lit(i).alias("encodes"), F.col(c).alias("samples")) for i, c in ((1, "samples"), (2, "again"))])
    each = made.select("image", "block_x", "block_y", F.inline(both))
    blocks = pixels.coefficients(each, "encodes", "image").withColumn("coefficient", F.round("coefficient", 6))
    histogram = pixels.quantised_histogram(blocks, F.lit(1.0), "encodes", "image")
    return pixels.generations(pixels.periodicity(histogram, "encodes", "image"), "encodes", "image").drop("confidence")


# ---- sweeps in order: assets' candidates are what their steps measure, one in four isn't compared with its own decode

_PLAN = """steps AS (SELECT CAST(f.i + q.i AS INT) AS step, f.format, CAST(40 + 5 * q.i AS INT) AS quality FROM (VALUES (0, 'jpeg'), (12, 'webp')) f(i, format), range(12) q(i)
  UNION ALL SELECT 24, 'webp', NULL UNION ALL SELECT 25, 'png', NULL UNION ALL SELECT CAST(26 + q.i AS INT), 'avif', CAST(40 + 10 * q.i AS INT) FROM range(6) q(i))"""


def sweep_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "candidates").where(F.col("format") == sweep.ORIGINAL).select("asset_id", "bytes", (F.col("asset_id") % 4 != 0).alias("exact"))


def measured_by_candidates(candidates: DataFrame):
    """A measure that looks steps up among candidates: the smallest of a format and quality."""
    best = candidates.groupBy("asset_id", "format", F.coalesce("quality", F.lit(-1)).alias("q")).agg(F.min(F.struct("bytes", "ord", "ssim", "delta_e")).alias("c"))

    def measure(tries: DataFrame) -> DataFrame:
        t = tries.select("asset_id", "step", "format", F.coalesce("quality", F.lit(-1)).alias("q"))
        return t.join(best, ["asset_id", "format", "q"]).select("asset_id", "step", "c.bytes", "c.ssim", "c.delta_e", F.lit(None).cast("string").alias("error"))

    return measure


@query(f"""WITH {_PLAN}, a AS (SELECT asset_id, bytes, asset_id % 4 <> 0 AS exact FROM {{candidates}} WHERE format = 'keep-original'),
 c AS (SELECT *, row_number() OVER (PARTITION BY asset_id, format, quality ORDER BY bytes, ord) AS k FROM {{candidates}}),
 p AS (SELECT asset_id, 0 AS idx, 'point' AS event, 'keep-original' AS format, CAST(NULL AS INT) AS quality, bytes, CAST(1 AS DOUBLE) AS ssim, CAST(0 AS DOUBLE) AS distortion, CAST(NULL AS VARCHAR) AS message FROM a WHERE exact
   UNION ALL SELECT a.asset_id, s.step + CAST(a.exact AS INT), CASE WHEN c.bytes IS NULL THEN 'step-error' ELSE 'point' END, s.format, s.quality, c.bytes, c.ssim, (1 - c.ssim) + 0.5e0 * least(c.delta_e / 2.3e0, 1), CASE WHEN c.bytes IS NULL THEN 'no encode' END
     FROM a CROSS JOIN steps s LEFT JOIN c ON c.asset_id = a.asset_id AND c.format = s.format AND c.quality IS NOT DISTINCT FROM s.quality AND c.k = 1)
 SELECT asset_id, CAST(idx AS INT) AS idx, event, format, quality, bytes, round(distortion, 9) AS distortion, message, count(*) FILTER (event = 'step-error') OVER w AS failed, min(bytes) FILTER (ssim >= 0.97) OVER w AS cheapest FROM p WINDOW w AS (PARTITION BY asset_id ORDER BY idx)""")
def progressive_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each asset's points in the order in which they come, and what is known after each."""
    assets = sweep_assets(spark, sf_dir)
    measure = measured_by_candidates(view(spark, sf_dir, "candidates"))
    points = sweep.originals(assets, "asset_id").unionByName(sweep.measured(assets, sweep.capped_plan(spark, FORMATS), measure, "asset_id"))
    w = Window.partitionBy("asset_id").orderBy("idx")
    failed, cheapest = F.count_if(F.col("event") == "step-error").over(w), F.min(F.when(F.col("ssim") >= 0.97, F.col("bytes"))).over(w)
    return points.select("asset_id", "idx", "event", "format", "quality", "bytes", F.round("distortion", 9).alias("distortion"), "message", failed.alias("failed"), cheapest.alias("cheapest"))


@query(f"""WITH {_LEGAL}, {_BEST}, k AS (SELECT DISTINCT asset_id, format, coalesce(quality, -1) AS q FROM (SELECT l.asset_id, l.format, l.quality, row_number() OVER (PARTITION BY l.asset_id, l.bytes, l.distortion ORDER BY l.ord) AS n FROM legal l JOIN hull h ON h.asset_id = l.asset_id AND h.bytes = l.bytes AND h.distortion = l.distortion) WHERE n = 1)
 SELECT l.asset_id, l.ord, concat(l.format, ':', CASE WHEN l.quality IS NULL THEN 'lossless' ELSE 'q' || l.quality END) AS key, k.q IS NOT NULL AS on_hull FROM legal l LEFT JOIN k ON k.asset_id = l.asset_id AND k.format = l.format AND k.q = coalesce(l.quality, -1)""")
def hull_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    legal = hull.at_or_above_floor(view(spark, sf_dir, "candidates"), hull.FLOOR)
    return hull.members(legal, _hulls(spark, sf_dir), "asset_id").select("asset_id", "ord", "key", "on_hull")


@query(f"""SELECT asset_id, CAST(row_number() OVER (PARTITION BY asset_id ORDER BY turn, ord) - 1 AS INT) AS ord, url, via FROM (SELECT asset_id, 0 AS turn, ord, url, via FROM ({ORACLE_SQL["source_proposals"]}) s
 UNION ALL SELECT asset_id, 1, ord, url, via FROM ({ORACLE_SQL["history_proposals"]}) h) b""")
def all_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What all seven recoverers propose for an asset, in their order."""
    bytes_ = F.when(F.col("asset_id") % 3 != 0, F.col("file_bytes")).alias("bytes")
    assets = view(spark, sf_dir, "assets").select("asset_id", F.lit("img").alias("local_path"), bytes_).join(view(spark, sf_dir, "urls"), "asset_id")
    return recover.proposals(assets, view(spark, sf_dir, "git_log"), "asset_id")
