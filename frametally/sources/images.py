"""Image files: which of a tree are scanned, what their headers say, what decodes."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from frametally.functions import containers

# Folders that a scan passes over, and the order in which a table's 64 values are stored.
SKIPPED = (".git", "node_modules", ".next", "dist", "build", "coverage", ".turbo")
ZIGZAG = [
    0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28,
    35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63,
]
HEAD = 1 << 16

_TABLE = pa.struct([("id", pa.int32()), ("precision", pa.int32()), ("values", pa.list_(pa.int32()))])
_COMPONENT = pa.struct([("id", pa.int32()), ("h", pa.int32()), ("v", pa.int32()), ("table", pa.int32())])
_HEADER = pa.struct([("width", pa.int32()), ("height", pa.int32()), ("bits", pa.int32()), ("progressive", pa.bool_()), ("tables", pa.list_(_TABLE)), ("components", pa.list_(_COMPONENT)), ("truncated", pa.bool_())])
_SPARK = "struct<width:int,height:int,bits:int,progressive:boolean,tables:array<struct<id:int,precision:int,values:array<int>>>,components:array<struct<id:int,h:int,v:int,table:int>>,truncated:boolean>"


def scan(spark: SparkSession, root: str) -> DataFrame:
    """(path, length, content) of the image files under root, skipped folders left out.

    Spark's listing passes over names that begin with a dot or an underscore,
    and its readers over empty files, which are taken from the listing here.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    plain = F.regexp_replace(F.url_decode(F.regexp_replace("name", r"\+", "%2B")), "^file:/+", "file:/")
    listed = spark.createDataFrame([(n,) for n in files.inputFiles()], "name string").select(plain.alias("path"))
    empty = listed.join(files.select("path"), "path", "left_anti").select("path", F.lit(0).cast("long").alias("length"), F.lit(b"").alias("content"))
    skipped = r"(^|/)(" + "|".join(s.replace(".", r"\.") for s in SKIPPED) + r")/"
    return files.select("path", "length", "content").unionByName(empty).where(F.col("path").rlike(containers.IMAGE_NAME) & ~F.col("path").rlike(skipped))


def examine(files: DataFrame) -> DataFrame:
    """files (path, length, content) with container, hash, header (jpeg) and note; nothing fails the job."""
    kind = containers.sniff(F.col("content"))
    note = F.when(F.col("length") == 0, "empty").when(kind.isNull(), "unrecognised").when(~containers.decodable(kind), F.concat(F.lit("not decoded: "), kind))
    header = F.when(kind == "jpeg", jpeg_header(F.substring("content", 1, HEAD)))
    return files.withColumns({"container": kind, "hash": containers.content_hash(F.col("content")), "header": header, "note": note})


def parse_jpeg(data: bytes) -> dict | None:
    """Frame size, quantisation tables (the last of an id counts) and components; damage ends the walk with
    what was read and ``truncated``; None for what isn't a JPEG."""
    if data[:2] != b"\xff\xd8":
        return None
    out = {"width": None, "height": None, "bits": None, "progressive": False, "tables": {}, "components": [], "truncated": True}
    at = 2
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            break
        if data[at + 1] == 0xFF:  # fill bytes
            at += 1
            continue
        marker = data[at + 1]
        if marker in (0xD9, 0xDA):
            out["truncated"] = False
            break
        size = struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + size]
        if size < 2 or len(body) < size - 2:
            break
        if marker == 0xDB:
            while len(body) > 1:
                precision, ident = body[0] >> 4, body[0] & 15
                n = 64 * (1 + precision)
                if precision > 1 or len(body) < 1 + n:
                    return _listed(out)
                stored = np.frombuffer(body, dtype=">u2" if precision else "u1", count=64, offset=1)
                values = np.zeros(64, dtype=np.int32)
                values[ZIGZAG] = stored
                out["tables"][ident] = {"id": ident, "precision": precision, "values": values.tolist()}
                body = body[1 + n :]
        elif marker in (0xC0, 0xC1, 0xC2) and out["width"] is None and len(body) >= 6:
            out["height"], out["width"] = struct.unpack_from(">HH", body, 1)
            out["bits"], out["progressive"] = body[0], marker == 0xC2
            parts = body[6 : 6 + 3 * body[5]]
            out["components"] = [{"id": parts[i], "h": parts[i + 1] >> 4, "v": parts[i + 1] & 15, "table": parts[i + 2]} for i in range(0, len(parts) - 2, 3)]
        at += 2 + size
    return _listed(out)


def _listed(header: dict) -> dict:
    return header | {"tables": list(header["tables"].values())}


def jpeg_header(content: Column) -> Column:
    @F.arrow_udf(_SPARK)
    def header(contents: pa.Array) -> pa.Array:
        return pa.array([parse_jpeg(c) if c is not None else None for c in contents.to_pylist()], _HEADER)

    return header(content)
