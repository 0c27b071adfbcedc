"""JPEG quantisation tables: scaling, quality estimates, encoder fingerprints, signatures."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The luminance table of annex K of the JPEG standard, row by row, and
# the other base table in use.
STANDARD_LUMA = [
    16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99,
]
# The chrominance table of the same annex, and the table of the other encoder in use, for luma and chroma alike.
STANDARD_CHROMA = [
    17, 18, 24, 47, 99, 99, 99, 99, 18, 21, 26, 66, 99, 99, 99, 99, 24, 26, 56, 99, 99, 99, 99, 99, 47, 66, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99,
]
PSYCHOVISUAL = [
    16, 16, 16, 18, 25, 37, 56, 85, 16, 17, 20, 27, 34, 40, 53, 75, 16, 20, 24, 31, 43, 62, 91, 135, 18, 27, 31, 40, 53, 74, 106, 156,
    25, 34, 43, 53, 69, 94, 131, 189, 37, 40, 62, 74, 94, 124, 169, 238, 56, 53, 91, 106, 131, 169, 226, 311, 85, 75, 135, 156, 189, 238, 311, 418,
]
#: Largest value of a table of 8 and of 16 bits.
LIMITS = (255, 32767)
#: Largest mean relative deviation of a fit.
FIT = 0.05


def scale_table(base: Column, quality: Column, limit: int = 255) -> Column:
    """A base table at a quality, clamped to 1..100, in integer steps."""
    q = F.least(F.lit(100), F.greatest(F.lit(1), F.floor(quality + 0.5)))
    scale = F.when(q < 50, F.floor(5000 / q)).otherwise(200 - 2 * q).cast("long")
    return F.transform(base, lambda b: F.least(F.lit(limit), F.greatest(F.lit(1), F.floor((b.cast("long") * scale + 50) / 100))).cast("int"))


def flat_table(value: int = 16) -> list[int]:
    """The base table of encoders that treat all frequencies alike."""
    return [value] * 64


def families(spark: SparkSession, tables: dict[str, list[int]] | None = None) -> DataFrame:
    """(family_ord, family, q, luma): every family at every quality, a fixed 100 rows each."""
    tables = tables or {"standard": STANDARD_LUMA, "flat": flat_table()}
    base = spark.createDataFrame([(i, k, v) for i, (k, v) in enumerate(tables.items())], "family_ord int, family string, base array<int>")
    return base.join(spark.range(1, 101).select(F.col("id").cast("int").alias("q"))).select("family_ord", "family", "q", scale_table(F.col("base"), F.col("q")).alias("luma"))


def deviation(observed: Column, expected: Column) -> Column:
    """Mean relative deviation of two tables."""
    each = F.zip_with(observed, expected, lambda o, e: F.abs(o - e) / e)
    return F.aggregate(each, F.lit(0.0), lambda s, x: s + x) / F.size(observed)


def table_fit(known: DataFrame):
    """A function of a table (an array) that gives struct(family, quality, fit, exact, encoder) as :func:`estimate_quality` has them.

    ``known`` is a few hundred rows that go along with the function; each
    different table of a batch is compared once.
    """
    rows = sorted(known.collect(), key=lambda r: (r.family_ord, r.q))
    expected = np.array([r.luma for r in rows], dtype=float)
    kind = pa.struct([("family", pa.string()), ("quality", pa.int32()), ("fit", pa.float64()), ("exact", pa.bool_()), ("encoder", pa.string())])
    named = [(r.family, r.q) for r in rows]

    def compared(values: list[int | None]) -> dict:
        if len(values) != expected.shape[1] or None in values:
            return dict.fromkeys(kind.names)
        # summed in the order of the values, as a fold does
        fit = np.cumsum(np.abs(np.array(values, dtype=float) - expected) / expected, axis=1)[:, -1] / len(values)
        at, exact = int(np.argmin(fit)), {f for (f, _), x in zip(named, fit) if x == 0}
        family, q = named[at] if fit[at] <= FIT else (None, None)
        return {"family": family, "quality": q, "fit": fit[at] if fit[at] <= FIT else None, "exact": bool(exact), "encoder": exact.pop() if len(exact) == 1 else None}

    @F.arrow_udf("struct<family:string,quality:int,fit:double,exact:boolean,encoder:string>")
    def nearest(tables: pa.Array) -> pa.Array:
        at, out, seen = [], [], {}
        for t in map(tuple, tables.to_pylist()):
            if t not in seen:
                seen[t] = len(out)
                out.append(compared(list(t)))
            at.append(seen[t])
        return pa.array(out, kind).take(pa.array(at, pa.int32()))

    return nearest


def estimate_quality(tables: DataFrame, known: DataFrame, key: str, table: str = "luma") -> DataFrame:
    """(key, family, quality, fit, exact, encoder): the nearest family and quality of each table; rows without a table are left out.

    ``known`` holds a few hundred rows (see :func:`families`).  Earlier families
    and lower qualities win ties; fits over FIT give nulls; encoder names the
    only family that fits exactly.  Tables are compared where they are: no join
    in which one side of them would be sent to all tasks.
    """
    fitted = tables.where(F.col(table).isNotNull()).withColumn("_fit", table_fit(known)(F.col(table)))
    return fitted.select(key, *[F.col(f"_fit.{c}").alias(c) for c in ("family", "quality", "fit", "exact", "encoder")])


def registry(spark: SparkSession) -> DataFrame:
    """(family_ord, family, q, luma8, luma16, chroma8, chroma16): both tables of every family at every quality, 200 rows."""
    known = [(0, "standard", STANDARD_LUMA, STANDARD_CHROMA), (1, "psychovisual", PSYCHOVISUAL, PSYCHOVISUAL)]
    base = spark.createDataFrame(known, "family_ord int, family string, luma array<int>, chroma array<int>")
    q = spark.range(1, 101).select(F.col("id").cast("int").alias("q"))
    scaled = [scale_table(F.col(c), F.col("q"), limit).alias(f"{c}{bits}") for c in ("luma", "chroma") for bits, limit in zip((8, 16), LIMITS)]
    return base.join(q).select("family_ord", "family", "q", *scaled)


def pair_fit(known: DataFrame):
    """A function of luma and chroma tables (id, precision, values) that gives struct(family, quality, fit, exact, encoder).

    The chroma table may be null.  Deviations are means over all values of both;
    earlier families and lower qualities win ties; fits over FIT give nulls, and
    no luma table a null.  ``known`` (see :func:`registry`) is a few hundred rows
    that go along with the function.  Each different pair of a batch is compared
    once: encoders write few.
    """
    rows = sorted(known.collect(), key=lambda r: (r.family_ord, r.q))
    expected = {f"{c}{bits}": np.array([r[f"{c}{bits}"] for r in rows], dtype=float) for c in ("luma", "chroma") for bits in (8, 16)}
    order = {f: i for i, f in enumerate(dict.fromkeys(r.family for r in rows))}
    names, family, q = list(order), np.array([order[r.family] for r in rows]), [r.q for r in rows]
    kind = pa.struct([("family", pa.string()), ("quality", pa.int32()), ("fit", pa.float64()), ("exact", pa.bool_()), ("encoder", pa.string())])

    def compared(tables: list[tuple[str, list[int]]]) -> dict:
        apart = [(np.abs(values - expected[name]) / expected[name]).sum(axis=1) / len(values) for name, values in tables]
        fit = np.sum(apart, axis=0) / len(apart)
        at = int(np.argmin(np.round(fit, 12)))
        exact = {names[f] for f in family[fit == 0]}
        ok = fit[at] <= FIT
        return {"family": names[family[at]] if ok else None, "quality": q[at] if ok else None, "fit": fit[at] if ok else None, "exact": bool(exact), "encoder": exact.pop() if len(exact) == 1 else None}

    @F.arrow_udf("struct<family:string,quality:int,fit:double,exact:boolean,encoder:string>")
    def nearest(luma: pa.Array, luma_bits: pa.Array, chroma: pa.Array, chroma_bits: pa.Array) -> pa.Array:
        out, seen = [], {}
        for lv, lb, cv, cb in zip(*(x.to_pylist() for x in (luma, luma_bits, chroma, chroma_bits))):
            if lv is None:
                out.append(None)
                continue
            key = (tuple(lv), lb, cv and tuple(cv), cb)
            if key not in seen:
                seen[key] = compared([(f"{name}{16 if bits else 8}", values) for name, values, bits in (("luma", lv, lb), ("chroma", cv, cb)) if values is not None])
            out.append(seen[key])
        return pa.array(out, kind)

    def fit(luma: Column, chroma: Column) -> Column:
        return nearest(luma["values"], luma["precision"], chroma["values"], chroma["precision"])

    return fit


def signature(table: Column, precision: int = 0) -> Column:
    """FNV-1a (32 bits, eight hex digits) of the precision byte and the table's values, two bytes each."""
    data = F.concat(F.array(F.lit(precision).cast("long")), F.flatten(F.transform(table, lambda v: F.array(F.shiftright(v, 8).cast("long"), v.bitwiseAND(255).cast("long")))))
    h = F.aggregate(data, F.lit(2166136261).cast("long"), lambda a, b: (a.bitwiseXOR(b) * 16777619).bitwiseAND(4294967295))
    return F.lpad(F.lower(F.hex(h)), 8, "0")


def subsampling(factors: Column) -> Column:
    """Chroma subsampling of an array of (h, v) structs, one for each component."""
    h, v = F.transform(factors, lambda f: f["h"]), F.transform(factors, lambda f: f["v"])
    three = (F.size(factors) == 3) & (F.get(h, F.lit(1)) == 1) & (F.get(v, F.lit(1)) == 1) & (F.get(h, F.lit(2)) == 1) & (F.get(v, F.lit(2)) == 1)
    return (
        F.when(F.size(factors) == 1, "none")
        .when(three & (F.get(h, F.lit(0)) == 1) & (F.get(v, F.lit(0)) == 1), "4:4:4")
        .when(three & (F.get(h, F.lit(0)) == 2) & (F.get(v, F.lit(0)) == 1), "4:2:2")
        .when(three & (F.get(h, F.lit(0)) == 2) & (F.get(v, F.lit(0)) == 2), "4:2:0")
    )


def bound_tables(tables: str = "tables", components: str = "components") -> Column:
    """struct(luma, chroma): the first component's table and the second's, by table id; ids 0 and 1 without components."""
    return F.expr(f"""named_struct(
      'luma', get(filter({tables}, t -> t.id = coalesce(get({components}, 0).table, 0)), 0),
      'chroma', CASE WHEN size({components}) = 1 THEN null ELSE get(filter({tables}, t -> t.id = coalesce(get({components}, 1).table, 1)), 0) END)""")
