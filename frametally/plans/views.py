"""Derived views over the driver's tables, as SQL that Spark and DuckDB both run.

The tables hold no images, so assets, candidates, receipts, addresses and files
are derived from their columns on exact grids (integers, or doubles whose
arithmetic is exact), which lets two engines agree to the last bit.
``{table}`` names a table or another view.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from frametally.operators import quant
from frametally.sources.images import ZIGZAG


def _bases() -> str:
    """Both families' tables as rows (family, t, i, z, b): t is 0 for luma, i and z are places in natural and stored order."""
    tables = ((0, 0, quant.STANDARD_LUMA), (0, 1, quant.STANDARD_CHROMA), (1, 0, quant.PSYCHOVISUAL), (1, 1, quant.PSYCHOVISUAL))
    place = {i: z for z, i in enumerate(ZIGZAG)}
    return "SELECT * FROM (VALUES " + ", ".join(f"({f}, {t}, {i}, {place[i]}, {b})" for f, t, table in tables for i, b in enumerate(table)) + ") AS b(family, t, i, z, b)"


_SIZE = "lpad(hex(60 + 2 * p_size), 4, '0'), lpad(hex(100 + 3 * p_size), 4, '0')"
_SOS = "'FFDA0008010100003F00FFD9'"


def _frame(marker: str, factors: str) -> str:
    return f"concat('{marker}001108', {_SIZE}, '0301{factors}00021101031101')"


#: Files and their tables.
_FILES = "FROM {part} JOIN (SELECT file_id, max(CASE WHEN t = 0 THEN h END) AS l, max(CASE WHEN t = 1 THEN h END) AS c FROM {jpeg_hex} GROUP BY file_id) AS x ON file_id = p_partkey"

VIEWS = {
    "candidates": """
SELECT asset_id, page, format, quality, bytes, ssim, delta_e, distortion, ord FROM (
  SELECT l_partkey AS asset_id, CAST(floor(l_partkey / 50) AS BIGINT) AS page,
    CASE l_linenumber % 4 WHEN 0 THEN 'jpeg' WHEN 1 THEN 'webp' WHEN 2 THEN 'png' ELSE 'avif' END AS format,
    CASE WHEN l_linenumber % 4 = 2 THEN NULL ELSE CAST(40 + 5 * (CAST(l_quantity AS BIGINT) % 12) AS INT) END AS quality,
    CAST(floor(l_extendedprice / 8) AS BIGINT) AS bytes,
    CAST(1024 - (3 * CAST(round(l_discount * 100) AS BIGINT) + CAST(round(l_tax * 100) AS BIGINT)) AS DOUBLE) / 1024 AS ssim,
    CAST(CAST(l_quantity AS BIGINT) % 23 AS DOUBLE) / 8 AS delta_e,
    CAST(8 * (3 * CAST(round(l_discount * 100) AS BIGINT) + CAST(round(l_tax * 100) AS BIGINT)) + CAST(l_quantity AS BIGINT) % 23 AS DOUBLE) / 1024 AS distortion,
    l_orderkey * 8 + l_linenumber AS ord
  FROM {lineitem}
  UNION ALL
  SELECT l_partkey, CAST(floor(l_partkey / 50) AS BIGINT), 'keep-original', CAST(NULL AS INT), max(CAST(floor(l_extendedprice / 8) AS BIGINT)) + 500, CAST(1 AS DOUBLE), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), CAST(0 AS BIGINT)
  FROM {lineitem} GROUP BY l_partkey
) AS c
""",
    "assets": """
SELECT p_partkey AS asset_id, CAST(floor(p_partkey / 50) AS BIGINT) AS page, p_size,
  CASE p_partkey % 7 WHEN 0 THEN 'jpeg' WHEN 1 THEN 'jpeg' WHEN 2 THEN 'png' WHEN 3 THEN 'webp' WHEN 4 THEN 'gif' WHEN 5 THEN 'svg' ELSE 'avif' END AS container,
  CASE WHEN p_partkey % 11 = 0 THEN 'photo' WHEN p_partkey % 13 = 0 THEN 'icon' ELSE NULL END AS classification,
  CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE CAST(1 + p_partkey % 2 AS INT) END AS generations,
  CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE CAST(50 + p_size AS INT) END AS quality,
  CAST(p_partkey % 16 AS DOUBLE) / 16 AS blocking_score,
  CAST(100 + p_size * 37 AS BIGINT) AS declared_w, CAST(80 + p_size * 23 AS BIGINT) AS declared_h,
  CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE CAST(90 + p_size * 31 AS BIGINT) END AS effective_w,
  CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE CAST(70 + p_size * 19 AS BIGINT) END AS effective_h,
  CAST(floor(p_retailprice * 16) AS BIGINT) AS file_bytes,
  p_partkey % 6 < 3 AS above_fold,
  CASE p_partkey % 3 WHEN 0 THEN 'lcp' WHEN 1 THEN 'content' ELSE 'decorative' END AS role,
  CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE CAST(60 + p_size * 20 AS BIGINT) END AS display_w,
  CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE CAST(50 + p_size * 15 AS BIGINT) END AS display_h
FROM {part}
""",
    "page_items": """
SELECT page, idx, CASE WHEN idx % 5 = 0 THEN NULL ELSE q * 24 END AS css_w_px, CASE WHEN idx % 3 = 0 THEN CAST(NULL AS BIGINT) ELSE q * 40 END AS attr_w,
  CASE WHEN idx % 4 = 0 THEN CAST(NULL AS BIGINT) ELSE 20 + d * 30 END AS attr_h, flag = 'R' AS lazy, bytes FROM (
  SELECT l_orderkey AS page, l_linenumber AS idx, max(CAST(l_quantity AS BIGINT)) AS q, max(CAST(round(l_discount * 100) AS BIGINT)) AS d, max(l_returnflag) AS flag, max(CAST(floor(l_extendedprice / 4) AS BIGINT)) AS bytes
  FROM {lineitem} GROUP BY l_orderkey, l_linenumber) AS i
""",
    "planes": """
SELECT vec_id AS plane, pos AS i, CAST(floor(128 + 100 * CAST(v AS DOUBLE)) AS BIGINT) AS value FROM {vectors}
""",
    "urls": """
SELECT p_partkey AS asset_id,
  CASE p_partkey % 8
    WHEN 0 THEN concat('https://blog.example.com/up/img', CAST(p_partkey AS VARCHAR(20)), '-300x200.jpg?v=', CAST(p_size AS VARCHAR(20)))
    WHEN 1 THEN concat('https://blog.example.com/up/pic', CAST(p_partkey AS VARCHAR(20)), '-scaled.png')
    WHEN 2 THEN concat('https://app.example.com/_next/image?url=%2Fmedia%2Fp', CAST(p_partkey AS VARCHAR(20)), '%20a+b.png&w=640&q=75')
    WHEN 3 THEN concat('https://cdn.shopify.com/s/files/t', CAST(p_partkey AS VARCHAR(20)), '_800x600_crop_center@2x.jpg?v=', CAST(p_size AS VARCHAR(20)))
    WHEN 4 THEN concat('https://res.cloud.example/demo/image/upload/w_400,h_300,c_fill/v1/dir/a', CAST(p_partkey AS VARCHAR(20)), '.webp?w=20&v=3#x')
    WHEN 5 THEN concat('https://img.example.org/a/b', CAST(p_partkey AS VARCHAR(20)), '.jpeg?w=300&fit=crop&v=', CAST(p_size AS VARCHAR(20)), '&auto')
    WHEN 6 THEN concat('/static/logo', CAST(p_partkey AS VARCHAR(20)), '.gif')
    ELSE concat('https://x.example.net/icon', CAST(p_partkey AS VARCHAR(20)), '@2x.png')
  END AS url
FROM {part}
""",
    "addresses": """
SELECT c_custkey AS id, (c_custkey * 7919 + 10) % 256 AS a, (c_custkey * 104729) % 256 AS b, (c_custkey * 31) % 256 AS c, c_custkey % 256 AS d
FROM {customer}
""",
    "addresses6": """
SELECT id, k, a, b, c, d, CASE k
  WHEN 0 THEN concat('::ffff:', q) WHEN 1 THEN concat('[fe80::', lower(hex(b)), '%eth0]') WHEN 2 THEN concat('2002:', hex(a * 256 + b), ':', hex(c * 256 + d), '::1') WHEN 3 THEN concat('64:ff9b::', q)
  WHEN 4 THEN concat('2001:db8::', hex(d)) WHEN 5 THEN concat('2606:4700:0:0::', hex(c + 1), ':', hex(d)) WHEN 6 THEN concat('fc00:1:2:3:4:5:6:', hex(d)) WHEN 7 THEN concat(':::', hex(d)) WHEN 8 THEN '::1'
  WHEN 9 THEN concat('1:2:3:4:5:6:7:8:', hex(d)) WHEN 10 THEN q ELSE concat('::', q) END AS text
FROM (SELECT id, id % 12 AS k, a, b, c, d, concat(CAST(a AS VARCHAR(3)), '.', CAST(b AS VARCHAR(3)), '.', CAST(c AS VARCHAR(3)), '.', CAST(d AS VARCHAR(3))) AS q FROM {addresses}) AS x
""",
    "git_log": """
SELECT l_partkey AS asset_id, l_orderkey * 8 + l_linenumber AS ord, lpad(lower(hex(l_orderkey * 8 + l_linenumber)), 40, '0') AS hash,
  concat('img/a', CAST(l_partkey AS VARCHAR(20)), CASE WHEN l_linenumber % 2 = 0 THEN '.png' ELSE '.jpg' END) AS path,
  CASE WHEN l_linenumber = 5 THEN NULL ELSE CAST(floor(l_extendedprice * 4) AS BIGINT) END AS size
FROM {lineitem}
""",
    "files": """
SELECT doc_id AS file_id, concat('img', CAST(doc_id AS VARCHAR(20)), CASE doc_id % 4 WHEN 0 THEN '.JPG' WHEN 1 THEN '.png' WHEN 2 THEN '.webp' ELSE '.txt' END) AS name,
  concat(CASE doc_id % 9 WHEN 0 THEN 'FFD8FFE0' WHEN 1 THEN '89504E470D0A1A0A' WHEN 2 THEN '474946383961' WHEN 3 THEN '52494646000000005745425056503820'
    WHEN 4 THEN '0000001C6674797061766966' WHEN 5 THEN '00000018667479706D696631' WHEN 6 THEN '3C73766720' WHEN 7 THEN '474946383861' ELSE '' END,
    hex(coalesce(text, ''))) AS hexbytes
FROM {documents}
""",
    "receipts": """
SELECT o_orderkey AS line,
  CASE WHEN o_orderkey % 17 = 0 THEN concat('{{"v":1,"ts":', CAST(o_orderkey AS VARCHAR(20)))
       WHEN o_orderkey % 19 = 0 THEN ''
  ELSE concat('{{"v":', CASE WHEN o_orderkey % 23 = 0 THEN '2' ELSE '1' END,
    ',"ts":"2026-01-01T00:00:00Z","asset":"img/a', CAST(o_orderkey AS VARCHAR(20)), CASE WHEN o_orderkey % 2 = 0 THEN '.JPG"' ELSE '.png"' END,
    ',"sourceHash":"sha256:s', CAST(o_orderkey % 97 AS VARCHAR(20)), '"',
    CASE WHEN o_orderkey % 13 = 0 THEN '' WHEN o_orderkey % 3 = 0 THEN ',"outputHash":null' ELSE concat(',"outputHash":"sha256:o', CAST(o_orderkey % 89 AS VARCHAR(20)), '"') END,
    ',"sourceRecovered":null,"reference":{{"w":', CAST(o_orderkey % 7 AS VARCHAR(20)), ',"h":20,"hash":"sha256:r"}}',
    ',"decision":"', CASE o_orderkey % 4 WHEN 0 THEN 'encoded' WHEN 1 THEN 'kept' WHEN 2 THEN 'refused' ELSE 'skipped' END, '"',
    ',"reason":', CASE WHEN o_orderkey % 4 = 0 THEN 'null' ELSE '"because"' END,
    ',"output":', CASE WHEN o_orderkey % 3 = 0 THEN 'null' ELSE '{{"format":"webp","quality":75,"bytes":10}}' END,
    ',"before":{{"format":"jpeg","bytes":', CAST(o_custkey AS VARCHAR(20)), '}}',
    ',"metrics":', CASE WHEN o_orderkey % 3 = 0 THEN 'null' ELSE '{{"ssim":0.98,"deltaE":0.5,"distortion":0.1}}' END,
    ',"weight":null,"lambda":null,"provenance":null,"encoder":null,"tool":"t@1"}}')
  END AS raw
FROM {orders}
""",
    "provided": """
SELECT c_custkey AS file_ord, concat(CASE WHEN c_custkey % 2 = 0 THEN 'A' ELSE 'a' END, CAST(c_custkey * 2 AS VARCHAR(20)), '.jpg') AS name,
  CASE c_custkey % 3 WHEN 0 THEN concat('sha256:s', CAST(c_custkey % 97 AS VARCHAR(20))) WHEN 1 THEN concat('sha256:o', CAST(c_custkey % 89 AS VARCHAR(20))) ELSE concat('sha256:x', CAST(c_custkey AS VARCHAR(20))) END AS hash
FROM {customer}
""",
    "pictures": """
SELECT CAST(floor(plane / 6) AS BIGINT) AS image, i % 8 + 8 * (plane % 6 % cols) AS x, CAST(floor(i / 8) AS BIGINT) + 8 * CAST(floor(plane % 6 / cols) AS BIGINT) AS y, value
FROM (SELECT *, CASE CAST(floor(plane / 6) AS BIGINT) % 3 WHEN 0 THEN 3 WHEN 1 THEN 2 ELSE 6 END AS cols FROM {planes}) AS p
UNION ALL
SELECT -1 - CAST(floor(plane / 300) AS BIGINT), i % 8 + 8 * CAST(floor(plane % 300 / 2) AS BIGINT), CAST(floor(i / 8) AS BIGINT) + 8 * (plane % 2), value FROM {planes}
""",
    "quant_bases": _bases(),
    "jpeg_cells": """
SELECT p_partkey AS file_id, p_partkey % 12 AS k, 50 + p_size AS q, t, i, z,
  CAST(least(255, greatest(1, floor((b * (100 - 2 * p_size) + 50) / 100))) AS BIGINT) + CASE WHEN p_partkey % 12 = 4 THEN 40 WHEN p_partkey % 12 = 10 AND t = 0 AND i = 7 THEN 1 ELSE 0 END AS v
FROM {part} JOIN {quant_bases} ON family = CASE WHEN p_partkey % 12 = 7 THEN 1 ELSE 0 END
""",
    "jpegs": f"""
SELECT p_partkey AS file_id, CASE p_partkey % 12
  WHEN 0 THEN concat('FFD8FFE000104A46494600010100000100010000', 'FFDB004300', l, 'FFDB004301', c, {_frame("FFC0", "22")}, {_SOS})
  WHEN 1 THEN concat('FFD8FFDB008400', l, '01', c, {_frame("FFC2", "11")}, {_SOS})
  WHEN 2 THEN concat('FFD8FFDB008310', l, 'FFDB008311', c, {_frame("FFC0", "22")}, {_SOS})
  WHEN 3 THEN concat('FFD8FFDB004300', l, 'FFC0000B08', {_SIZE}, '01011100', {_SOS})
  WHEN 5 THEN concat('FFD8FFDB004300', l, 'FFDB004301', substr(c, 1, 20))
  WHEN 6 THEN concat('FFD8FFDB004300', l, 'FFDB004301', c, {_SOS})
  WHEN 8 THEN '89504E470D0A1A0A' WHEN 9 THEN 'FFD8FF00'
  WHEN 10 THEN concat('FFD8FFDB004300', c, 'FFDB004300', l, 'FFDB004301', c, {_frame("FFC0", "21")}, {_SOS})
  WHEN 11 THEN concat('FFD8FFFFDB004300', l, 'FFDB004301', c, {_frame("FFC1", "12")}, {_SOS})
  ELSE concat('FFD8FFDB004300', l, 'FFDB004301', c, {_frame("FFC0", "22")}, {_SOS}) END AS hexbytes
{_FILES}
""",
    "requests": """
SELECT event_id, user_id AS client, ts, concat('/', event_type, '/', CAST(user_id AS VARCHAR(20))) AS url FROM {events}
""",
}

#: Views whose text differs between the engines: unnesting with a position, and files.
SPARK_ONLY = {
    "vectors": "SELECT vec_id, pos, v FROM {embeddings} LATERAL VIEW posexplode(embedding) t AS pos, v",
    # a file's tables go by its number modulo 12 and its size: those of a file of each kind, held by all
    "jpeg_kinds": "SELECT min(p_partkey) AS p_partkey, p_size FROM {part} GROUP BY p_partkey % 12, p_size",
    "jpeg_stored": "SELECT k, q, t, concat_ws('', transform(array_sort(collect_list(struct(z, lpad(hex(v), CASE WHEN k = 2 THEN 4 ELSE 2 END, '0') AS h))), x -> x.h)) AS h FROM ("
    + VIEWS["jpeg_cells"].replace("{part}", "{jpeg_kinds}")
    + ") AS c GROUP BY k, q, t",
    "jpeg_pairs": "SELECT k, q, max(CASE WHEN t = 0 THEN h END) AS l, max(CASE WHEN t = 1 THEN h END) AS c FROM {jpeg_stored} GROUP BY k, q",
    # files get the tables of their kind where they are: they are not joined with themselves, which would send all of them to the driver
    "jpegs": VIEWS["jpegs"].replace("SELECT", "SELECT /*+ BROADCAST(x) */", 1).replace(_FILES, "FROM {part} JOIN {jpeg_pairs} AS x ON k = p_partkey % 12 AND q <=> 50 + p_size"),
}
DUCKDB_ONLY = {
    "vectors": "SELECT vec_id, unnest(range(len(embedding))) AS pos, unnest(embedding) AS v FROM {embeddings}",
    "jpeg_hex": "SELECT file_id, t, string_agg(lpad(hex(v), CASE WHEN k = 2 THEN 4 ELSE 2 END, '0'), '' ORDER BY z) AS h FROM {jpeg_cells} GROUP BY file_id, t",
}

#: Tables of a few bytes a row from each of which many rows or long expressions are made, and their keys: as files they are
#: the input of one or two tasks, so their rows are dealt to as many as there are cores first.
DEALT = {"part": "p_partkey", "embeddings": "vec_id"}

_REF = re.compile(r"(?<!\{)\{(\w+)\}(?!\})")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The view, or the table of that name, as a DataFrame."""
    text = SPARK_ONLY.get(name) or VIEWS.get(name)
    if text is None:
        table = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        if name not in DEALT:
            return table
        return table.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism), DEALT[name])
    parts = {r: view(spark, sf_dir, r) for r in dict.fromkeys(_REF.findall(text))}
    return spark.sql(text, **parts)


def duckdb_sql(body: str) -> str:
    """body with every {view} it names, and those they name, as common table expressions."""
    made: dict[str, str] = {}

    def add(name: str) -> None:
        text = VIEWS.get(name) or DUCKDB_ONLY.get(name)
        if text is None or name in made:
            return
        for r in _REF.findall(text):
            add(r)
        made[name] = filled(text)

    def filled(text: str) -> str:
        return _REF.sub(lambda m: f"v_{m[1]}" if m[1] in VIEWS or m[1] in DUCKDB_ONLY else m[1], text).replace("{{", "{").replace("}}", "}")

    for r in _REF.findall(body):
        add(r)
    if not made:
        return filled(body)
    ctes = ", ".join(f"v_{k} AS ({v})" for k, v in made.items())
    body = filled(body).strip()
    return f"WITH RECURSIVE {ctes}, {body[5:]}" if body.upper().startswith("WITH ") else f"WITH {ctes} {body}"
