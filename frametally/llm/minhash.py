"""Document fingerprints by MinHash.

A text's five-word shingles are hashed to 64 bits; PERMUTATIONS universal hash
functions (multiply, add, take the high bits) are evaluated over them in numpy,
and the fingerprint holds the low 16 bits of each function's minimum.  The share
of equal places of two fingerprints estimates the Jaccard likeness of the two
texts' shingle sets, with a standard error of at most 0.045.

``classes`` cuts fingerprints into bands, joins equal bands in Spark and verifies
the Jaccard likeness of the pairs found on the shingle sets themselves;
``near_duplicates`` and ``fingerprinted`` give each row its class.
``edited_neighbours`` compares each text with an edited version of itself and
with the next text in order of id.

Defined results: a null text is empty; an empty text has the empty fingerprint,
like (1.0) only to itself; a text of one to four words has one shingle; rows
without an id come first in order, rows of one id are ordered by their text;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frametally.llm import bytekernels as bk
from frametally.llm.shared import bucket_components, dropped, maybe_wanted, stored

PERMUTATIONS = 128
SHINGLE = 5
#: Bands and the permutations in each: pairs of likeness 0.8 share a band with probability 0.998.
BANDS, ROWS = 21, 6
#: Differing bits of candidates (see :func:`classes`).
REACH = 32
#: Rows in a slice of neighbouring ids, about, and slices at most.
SLICE, MOST_SLICES = 4000, 4000

_draw = np.random.default_rng(20240229)
_A = _draw.integers(1, 1 << 63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _draw.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64)


def minima(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The minimum of every permutation over each group of hashes; groups without hashes get zeros."""
    out = np.zeros((len(at) - 1, PERMUTATIONS), dtype=np.uint32)
    full = np.flatnonzero(np.diff(at))
    if not len(full):
        return out
    cut = at[:-1][full]
    v = np.empty_like(h)
    with np.errstate(over="ignore"):
        for i in range(PERMUTATIONS):
            np.multiply(h, _A[i], out=v)
            v += _B[i]
            v >>= np.uint64(32)
            out[full, i] = np.minimum.reduceat(v, cut)
    return out


def bands(places: np.ndarray) -> np.ndarray:
    """The hash of each band of each row of places."""
    out = np.empty((len(places), BANDS), dtype=np.uint64)
    for b in range(BANDS):
        h = np.full(len(places), b + 1, dtype=np.uint64)
        with np.errstate(over="ignore"):
            for i in range(b * ROWS, (b + 1) * ROWS):
                h = bk.mix(h * np.uint64(0x9E3779B97F4A7C15) + places[:, i].astype(np.uint64))
        out[:, b] = h
    return out


def signatures(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Places of each text's fingerprint, and whether it has any shingle."""
    out, some = np.zeros((len(texts), PERMUTATIONS), dtype=np.uint16), np.zeros(len(texts), dtype=bool)
    for a, b, buf, offsets in bk.text_chunks(texts):
        h, _, _, first = bk.word_hashes(buf, offsets, bk.TOKEN)
        s, at = bk.shingles(h, first, SHINGLE)
        out[a:b] = minima(s, at) & 0xFFFF
        some[a:b] = np.diff(at) > 0
    return out, some


def packed(places: np.ndarray, some: np.ndarray) -> list[bytes]:
    """Fingerprints as bytes, two for each place."""
    return [p.astype(">u2").tobytes() if s else b"" for p, s in zip(places, some)]


def printed(places: np.ndarray, some: np.ndarray) -> list[str]:
    """Fingerprints as hex digits, four for each place."""
    return [p.hex() for p in packed(places, some)]


def likeness(a: np.ndarray, some_a: np.ndarray, b: np.ndarray, some_b: np.ndarray) -> np.ndarray:
    return np.where(some_a & some_b, (a == b).mean(axis=1), (some_a == some_b).astype(float))


def fingerprint(text: Column) -> Column:
    @F.arrow_udf("string")
    def minhash(texts: pa.Array) -> pa.Array:
        return pa.array(printed(*signatures(texts)), pa.string())

    return minhash(text)


#: Digests are bytes until they are returned, as rows are shuffled before.
_DIGESTS = ("edited_sha256", "fingerprint", "edited_fingerprint")
_EDITED = "doc_id long, n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double, node long"


def _pairs(batches: Iterator[pa.RecordBatch], rows: int = 400) -> Iterator[pa.RecordBatch]:
    """Rows (halo, doc_id, text, node) in order; each row but halos with the row after it."""
    rest = None
    for whole in batches:
        for at in range(0, whole.num_rows, rows):
            part = whole.slice(at, rows)
            part = pa.Table.from_batches([part])
            table = part if rest is None else pa.concat_tables([rest, part])
            rest = table.slice(table.num_rows - 1)
            if table.num_rows > 1:
                yield _compared(table)


def _compared(table: pa.Table) -> pa.RecordBatch:
    text = [t or "" for t in table.column(2).to_pylist()]
    own = [i for i, h in enumerate(table.column(0).to_pylist()[:-1]) if not h]
    edited = [text[i][: len(text[i]) - len(text[i]) // 2] + text[i + 1][: len(text[i]) // 2] for i in own]
    place, some = signatures(pa.array(text, pa.string()))
    place2, some2 = signatures(pa.array(edited, pa.string()))
    at = np.array(own, dtype=np.int64)
    names = [x.split()[0] for x in _EDITED.split(", ")]
    return pa.record_batch(
        [
            table.column(1).combine_chunks().take(pa.array(at)).cast(pa.int64()),
            pa.array([len(text[i]) for i in own], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).digest() for t in edited], pa.binary()),
            pa.array(packed(place[at], some[at]), pa.binary()),
            pa.array(packed(place2, some2), pa.binary()),
            pa.array(likeness(place[at], some[at], place2, some2), pa.float64()),
            pa.array(likeness(place[at], some[at], place[at + 1], some[at + 1]), pa.float64()),
            table.column(3).combine_chunks().take(pa.array(at)),
        ],
        names=names,
    )


def _shown(rows: DataFrame) -> DataFrame:
    return rows.withColumns({c: F.lower(F.hex(c)) for c in _DIGESTS})


def edited_neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, node) of every row."""
    return _shown(_edited(docs, id_col, text_col))


def _edited(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of :func:`edited_neighbours`, digests as bytes.

    Rows are dealt into slices of neighbouring ids, each sorted in its task; the
    first document of a slice is also sent to the slice before it, where it is
    the next document of the last one.  Texts are shuffled once.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), text_node(F.col(text_col)).alias("node"))
    total = rows.count()
    slices = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), min(MOST_SLICES, total // SLICE))
    cuts = sorted(set(rows.agg(F.percentile_approx("doc_id", [i / slices for i in range(1, slices)], 100 * slices)).first()[0] or []))
    # the slice is the number of cuts up to the id: counted among every step-th cut, then among those between
    step = max(1, math.isqrt(len(cuts)))
    coarse = F.size(F.filter(F.array(*map(F.lit, cuts[step - 1 :: step])), lambda c: c <= F.col("doc_id"))) if cuts else F.lit(0)
    fine = [cuts[i : i + step] for i in range(0, max(len(cuts), 1), step)]
    rest = F.size(F.filter(F.get(F.array(*[F.array(*map(F.lit, f)).cast("array<bigint>") for f in [*fine, []]]), coarse), lambda c: c <= F.col("doc_id")))
    slice_ = F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(coarse * step + rest + 1)
    firsts = rows.select(slice_.alias("slice"), "doc_id").groupBy("slice").agg(F.min("doc_id").alias("first")).orderBy("slice").collect()  # one row for each slice
    if not firsts:
        return spark.createDataFrame([], _EDITED)
    first, to = [None] * (firsts[-1]["slice"] + 1), [None] * (firsts[-1]["slice"] + 1)
    for i, r in enumerate(firsts):
        first[r["slice"]], to[r["slice"]] = r["first"], firsts[i - 1]["slice"]
    at = [F.get(F.array(*map(F.lit, x)).cast("array<bigint>"), F.col("slice")) for x in (first, to)]
    dealt = rows.withColumn("slice", slice_).withColumns({"first": at[0], "to": at[1]})
    own = F.struct(F.col("slice").cast("long").alias("slice"), F.lit(0).alias("halo"))
    sent = dealt.withColumn("c", F.when(F.col("first").eqNullSafe(F.col("doc_id")), F.array(own, F.struct(F.col("to").alias("slice"), F.lit(1).alias("halo")))).otherwise(F.array(own)))
    sent = sent.select(F.explode("c").alias("c"), "doc_id", "text", "node").select("c.slice", "c.halo", "doc_id", "text", "node")
    ordered = sent.repartition(slices, "slice").sortWithinPartitions("slice", "halo", "doc_id", "text")
    return ordered.select("halo", "doc_id", "text", "node").mapInArrow(_pairs, _EDITED)


def shingle_set(text: Column) -> Column:
    """The distinct shingle hashes of each text, in order."""

    @F.arrow_udf("array<long>")
    def shingled(texts: pa.Array) -> pa.Array:
        out = []
        for _, _, buf, offsets in bk.text_chunks(texts):
            h, _, _, first = bk.word_hashes(buf, offsets, bk.TOKEN)
            s, at = bk.shingles(h, first, SHINGLE)
            out += [np.unique(bk.signed(s[a:b])) for a, b in zip(at[:-1], at[1:])]
        return pa.array(out, pa.list_(pa.int64()))

    return shingled(text)


def banded(text: Column) -> Column:
    """struct(w0, w1, keys) of each text: the lowest bits of its fingerprint's places, and the hashes of its bands (none for no shingles)."""

    @F.arrow_udf("struct<w0:bigint,w1:bigint,keys:array<bigint>>")
    def cut(texts: pa.Array) -> pa.Array:
        places, some = signatures(texts)
        bits = np.packbits((places & 1).astype(np.uint8), axis=1).view(np.int64).reshape(-1, 2)
        keys = [x if s else x[:0] for x, s in zip(bk.signed(bands(places)), some.tolist())]
        return pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(bits[:, 0])), pa.array(np.ascontiguousarray(bits[:, 1])), pa.array(keys, pa.list_(pa.int64()))], names=["w0", "w1", "keys"])

    return cut(text)


def text_node(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def classes(docs: DataFrame, similarity: float = 0.8, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(node, class_id) of every text: the smallest id of the documents linked, directly or by others, at the similarity or above.

    Equal texts are one node.  Pairs that share a band are verified on the
    shingle sets if at most REACH of the 128 lowest bits of their places differ
    (at a likeness of 0.8 the mean is 12.8 with a deviation of 3.4).
    """
    prints = docs.select(text_node(F.col(text_col)).alias("node"), F.col(id_col).cast("long").alias("doc_id"), banded(F.col(text_col)).alias("p"))
    nodes = stored(prints.groupBy("node").agg(F.min("doc_id").alias("rep"), F.first("p").alias("p")).select("node", "rep", "p.*"), "nodes")

    def sets(wanted: DataFrame) -> DataFrame:
        texts = maybe_wanted(docs.select(text_node(F.col(text_col)).alias("node"), F.col(text_col).alias("text")), wanted)
        # equal texts are merged before the shuffle; the join needs no other
        texts = texts.dropDuplicates(["node"]).join(wanted, "node", "left_semi")
        return texts.select("node", shingle_set(F.col("text")).alias("s"))

    found = bucket_components(nodes.select(F.explode("keys").alias("key"), "node"), nodes.select("node", "w0", "w1"), sets, similarity, REACH)
    named = nodes.select("node", "rep").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    low = named.groupBy("component").agg(F.min("rep").alias("class_id"))
    out = stored(named.join(low, "component").select("node", "class_id"), "classes")
    for x in (nodes, found):
        dropped(docs.sparkSession, x)
    return out


def near_duplicates(docs: DataFrame, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, class_id) of every row; see :func:`classes`."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_node(F.col(text_col)).alias("node")).join(classes(docs, similarity, text_col, id_col), "node").select("doc_id", "class_id")


def fingerprinted(docs: DataFrame, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of :func:`edited_neighbours` with one more column, the text's class_id."""
    return _shown(_edited(docs, id_col, text_col).join(classes(docs, similarity, text_col, id_col), "node").drop("node"))
