"""Product codes of vectors: codebooks for equal parts, found by annular norm pruning.

A part's nearest entry is looked for among the entries whose norm differs from
the part's by no more than the best distance so far: entries are sorted by
norm, a first distance comes from the entry nearest in norm, binary search
gives the interval it allows, both ends included, and only that annulus is
evaluated, exactly, in whole numbers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frametally.llm.shared import stored

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Rows whose parts are compared at a time.
BLOCK = 4096


def bound(width: int, entries: int) -> int:
    """The largest size of a component, so that a part's distance times the number of entries stays below 2^62."""
    return int((2**62 / (4 * max(width, 1) * entries)) ** 0.5)


def whole(values: np.ndarray, most: int) -> np.ndarray:
    """floor(256 * x), held within ``most``."""
    return np.clip(np.floor(values.astype(np.float64) * SCALE), -most, most).astype(np.int64)


def nearest(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of each row of parts (n, width): the nearest row of the book, the first of equals."""
    norm = np.sqrt((book.astype(np.float64) ** 2).sum(axis=1))
    order = np.argsort(norm, kind="stable")
    norm, by_norm = norm[order], book[order]
    own = np.sqrt((parts.astype(np.float64) ** 2).sum(axis=1))
    # the entry nearest in norm gives the first bound
    right = np.minimum(np.searchsorted(norm, own), len(norm) - 1)
    left = np.maximum(right - 1, 0)
    start = np.where(own - norm[left] < norm[right] - own, left, right)
    best = ((parts - by_norm[start]) ** 2).sum(axis=1)
    # whole numbers have exact distances; the radius is widened by more than the roots can be off
    radius = np.sqrt(best.astype(np.float64)) * (1 + 1e-12) + own * 1e-12 + 1e-9
    low = np.searchsorted(norm, own - radius, side="left")
    size = np.searchsorted(norm, own + radius, side="right") - low
    at = np.concatenate([[0], np.cumsum(size)[:-1]])
    row = np.repeat(np.arange(len(parts)), size)
    entry = np.arange(len(row)) - at[row] + low[row]
    distance = np.zeros(len(row), dtype=np.int64)
    for i in range(parts.shape[1]):
        apart = parts[row, i] - by_norm[entry, i]
        distance += apart * apart
    # distance and index in one number: the least has the lower index among equals
    key = np.minimum.reduceat(distance * len(book) + order[entry], at)
    return key % len(book), key // len(book)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def quantised(vectors: DataFrame, dimension: int, most: int) -> DataFrame:
    """(vec_id, label, v) of the rows whose embedding has ``dimension`` components, all of them finite."""
    id_, label = (vectors.schema[c].dataType.simpleString() for c in ("vec_id", "label"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(2).flatten().cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False).reshape(-1, dimension)
            keep = np.isfinite(values).all(axis=1)
            v = whole(values[keep], most)
            flat = pa.ListArray.from_arrays(np.arange(0, v.size + 1, dimension, dtype=np.int32), v.ravel())
            mask = pa.array(keep)
            yield pa.record_batch([batch.column(0).filter(mask), batch.column(1).filter(mask), flat], names=["vec_id", "label", "v"])

    rows = vectors.select("vec_id", "label", "embedding").where(F.size("embedding") == dimension)
    return rows.mapInArrow(run, f"vec_id {id_}, label {label}, v array<long>")


def _dimension(vectors: DataFrame, parts: int) -> int | None:
    """The length that all codes are for: that of the smallest vec_id with a vector that can be cut into the parts."""
    x = F.col("embedding").cast("array<double>")
    sound = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    first = vectors.where((F.size("embedding") > 0) & (F.size("embedding") % parts == 0) & sound).orderBy(F.col("vec_id").asc_nulls_last(), F.size("embedding")).select(F.size("embedding").alias("n")).first()
    return first and first.n


def refined(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks (parts, entries, width) with each entry replaced by the floor of the mean of the parts nearest to it.

    Tasks add up their own rows, so only one row a task, part and entry is shuffled.
    """
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros((parts, entries), dtype=np.int64), np.zeros((parts, entries, width), dtype=np.int64)
        for batch in batches:
            v = _matrix(batch.column(0), parts * width)
            for at in range(0, len(v), BLOCK):
                block = v[at : at + BLOCK].reshape(-1, parts, width)
                for p in range(parts):
                    entry, _ = nearest(block[:, p], books[p])
                    n[p] += np.bincount(entry, minlength=entries)
                    np.add.at(total[p], entry, block[:, p])
        p, e = np.nonzero(n)
        yield pa.record_batch([pa.array(p), pa.array(e), pa.array(n[p, e]), *(pa.array(total[p, e, i]) for i in range(width))], names=["p", "e", "n", *(f"s{i}" for i in range(width))])

    sums = [f"s{i}" for i in range(width)]
    found = rows.select("v").mapInArrow(run, "p long, e long, n long, " + ", ".join(f"{s} long" for s in sums))
    out = books.copy()
    for r in found.groupBy("p", "e").agg(*[F.sum(c).alias(c) for c in ("n", *sums)]).collect():
        out[r.p, r.e] = [r[s] // r.n for s in sums]
    return out


def coded(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """(vec_id, label, code, error): the entries nearest to each part, and the squared distances to them summed."""
    parts, _, width = books.shape
    id_, label = (rows.schema[c].dataType.simpleString() for c in ("vec_id", "label"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _matrix(batch.column(2), parts * width)
            code, error = np.empty((len(v), parts), dtype=np.uint8), np.zeros(len(v), dtype=np.int64)
            for at in range(0, len(v), BLOCK):
                block = v[at : at + BLOCK].reshape(-1, parts, width)
                for p in range(parts):
                    code[at : at + BLOCK, p], distance = nearest(block[:, p], books[p])
                    error[at : at + BLOCK] += distance
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array([c.tobytes().hex() for c in code], pa.string()), pa.array(error)], names=["vec_id", "label", "code", "error"])

    return rows.select("vec_id", "label", "v").mapInArrow(run, f"vec_id {id_}, label {label}, code string, error long")


def compressed(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """(vec_id, label, code, error, label_error, codebooks_sha256) of vectors (vec_id, embedding, label).

    Rows are dropped whose vector is null, empty, or holds a null or non-finite
    component.  All codes are of one length: that of the vector with the smallest
    id that the number of parts divides; vectors of other lengths are dropped.
    Components become floor(256 x), held within :func:`bound` (2^26 for parts of
    four) so that distances stay exact.  Codebooks begin as the ``entries``
    smallest ids (null ids last, equal ids by their components), or all rows
    where there are fewer, and are at most 256 entries of the vector's length,
    which is what goes to the driver and to all tasks.  Repeated rows each get a
    row.  label_error is the sum over equal labels, nulls together, and null
    where it exceeds a long.  An empty table, or one with no such vector, gives no rows.
    """
    if not 0 < entries <= 256:
        raise ValueError("an entry's number has two hex digits")
    spark = vectors.sparkSession
    dimension = _dimension(vectors, parts)
    id_, label = (vectors.schema[c].dataType.simpleString() for c in ("vec_id", "label"))
    if dimension is None:
        return spark.createDataFrame([], f"vec_id {id_}, label {label}, code string, error long, label_error long, codebooks_sha256 string")
    width = dimension // parts
    rows = stored(quantised(vectors, dimension, bound(width, entries)), "vectors")
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    books = np.array([r.v for r in first], dtype=np.int64).reshape(len(first), parts, width).transpose(1, 0, 2)
    for _ in range(rounds):
        books = refined(rows, books)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    out = stored(coded(rows, books), "codes")
    # written, so that Spark knows the labels' size: it broadcasts them only below its threshold, and splits hot labels beyond
    totals = stored(out.groupBy(F.col("label").alias("_label")).agg(F.expr("try_sum(error)").alias("label_error")), "labels")
    joined = out.join(totals, F.col("label").eqNullSafe(F.col("_label")))
    return joined.select("vec_id", "label", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _assigned(name: str, books: str) -> str:
    return f"""{name} AS (SELECT r, part, arg_min(entry, (d, entry)) AS entry, min(d) AS d FROM (
   SELECT p.r, p.part, b.entry, sum((p.x - b.x) * (p.x - b.x)) AS d FROM p JOIN {books} b ON b.part = p.part AND b.pos = p.pos GROUP BY ALL) GROUP BY r, part)"""


def _moved(name: str, books: str, by: str) -> str:
    return f"""{name} AS (SELECT b.part, b.entry, b.pos, coalesce(m.x, b.x) AS x FROM {books} b LEFT JOIN (
   SELECT a.part, a.entry, p.pos, CAST(sum(p.x) // count(*) - CASE WHEN sum(p.x) % count(*) < 0 THEN 1 ELSE 0 END AS BIGINT) AS x FROM {by} a JOIN p ON p.r = a.r AND p.part = a.part GROUP BY ALL) m
   ON m.part = b.part AND m.entry = b.entry AND m.pos = b.pos)"""


#: DuckDB SQL of compressed() with its defaults, by every distance.
SQL = f"""WITH k AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, v) - 1 AS r, vec_id, label, v FROM (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
   FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0) f),
 e AS (SELECT r, v, unnest(range(len(v))) AS i, unnest(v) AS x FROM k),
 p AS MATERIALIZED (SELECT r, i // (len(v) // {PARTS}) AS part, i % (len(v) // {PARTS}) AS pos, x FROM e),
 b0 AS MATERIALIZED (SELECT part, r AS entry, pos, x FROM p WHERE r < {ENTRIES}),
 {_assigned("a0", "b0")}, {_moved("b1", "b0", "a0")}, {_assigned("a1", "b1")}, {_moved("b2", "b1", "a1")}, {_assigned("a2", "b2")},
 c AS (SELECT r, string_agg(format('{{:02x}}', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a2 GROUP BY r),
 h AS (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY part, entry, pos)) AS s FROM b2)
 SELECT k.vec_id, k.label, c.code, c.error, CAST(sum(c.error) OVER (PARTITION BY k.label) AS BIGINT) AS label_error, h.s AS codebooks_sha256 FROM k JOIN c USING (r), h"""
