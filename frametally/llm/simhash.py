"""SimHash near-duplicates: fingerprints, pigeonhole blocks, verified links, components.

A text's shingles vote bit by bit on a 64-bit fingerprint.  Two fingerprints
that differ in at most ``bits`` places agree in at least ``parts - bits`` of
``parts`` blocks, so a join on every choice of that many blocks brings each
close pair together at least once; the Hamming distance is then verified.
With the defaults (6 blocks, 3 differing bits) a join key holds 32 bits, which
keeps chance meetings rare even for billions of fingerprints.

Only *distinct* fingerprints are joined, each with its smallest document, so a
group of thousands of equal texts is one row.  Within a bucket no list of pairs
is made: only the links that join parts of the bucket that were not yet
connected are returned, at most one fewer than its members.

Defined results: a null text is empty; an empty text has fingerprint zero and
links like any other; repeated rows share a fingerprint and so a component; a
row without an id takes part in no component of its own (its component is that
of its fingerprint, null if no row with an id has it).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frametally.llm import bytekernels as bk
from frametally.llm.minhash import bands, minima
from frametally.llm.shared import bucket_components, components, dropped, stored

SEED = 42


def _shingle_hashes(low: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of each text's k-word shingles (joined by one space), and each text's offset among them."""
    size = ends - starts + 1
    to = np.zeros(len(starts) + 1, dtype=np.int64)
    np.cumsum(size, out=to[1:])
    line = low[np.minimum(np.repeat(starts - to[:-1], size) + np.arange(to[-1]), max(len(low) - 1, 0))] if len(starts) else np.zeros(0, np.uint8)
    line[to[1:] - 1] = 0x20
    count = np.diff(first)
    made = np.where(count >= k, count - k + 1, (count > 0).astype(np.int64))
    at = np.zeros(len(made) + 1, dtype=np.int64)
    np.cumsum(made, out=at[1:])
    begin = np.repeat(first[:-1] - at[:-1], made) + np.arange(at[-1])
    stop = begin + np.repeat(np.minimum(count, k), made)
    flat, digest = line.tobytes(), xxhash.xxh64_intdigest
    h = [digest(flat[a:b], SEED) for a, b in zip(to[begin].tolist(), (to[stop] - 1).tolist())]
    return np.array(h, dtype=np.uint64), at


def majority_bits(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each group of hashes, the bits that more than half of them have.

    Eight bit planes are counted at a time in the bytes of a 64-bit word, in
    runs of at most 255 so that no byte overflows.
    """
    n = np.diff(at)
    out = np.zeros(len(n), dtype=np.uint64)
    full = np.flatnonzero(n)
    if not len(full):
        return out
    runs = -(-n[full] // 255)
    group = np.concatenate([[0], np.cumsum(runs)[:-1]])
    cut = np.repeat(at[:-1][full] - 255 * group, runs) + 255 * np.arange(runs.sum())
    counts = np.zeros((len(full), 64), dtype=np.int64)
    lanes = np.uint64(0x0101010101010101)
    for plane in range(8):
        part = np.add.reduceat((h >> np.uint64(plane)) & lanes, cut)
        byte = np.ascontiguousarray(part).view(np.uint8).reshape(-1, 8).astype(np.int64)
        counts[:, plane::8] = np.add.reduceat(byte, group, axis=0)
    most = 2 * counts > n[full][:, None]
    out[full] = (most.astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    return out


def fingerprint(text: Column, k: int = 5) -> Column:
    """The 64-bit SimHash of the words ``[^\\x20\\x09-\\x0D]+`` of each text, A-Z lower-cased, as a long."""

    @F.arrow_udf("long")
    def simhash(texts: pa.Array) -> pa.Array:
        out = np.zeros(len(texts), dtype=np.uint64)
        for a, b, buf, offsets in bk.text_chunks(texts):
            low = bk.LOWER[buf]
            starts, ends, first = bk.spans(low, offsets, bk.TOKEN)
            out[a:b] = majority_bits(*_shingle_hashes(low, starts, ends, first, k))
        return pa.array(bk.signed(out))

    return simhash(text)


def block_masks(parts: int = 6, bits: int = 3) -> list[int]:
    """The masks whose equality the pigeonhole principle promises for one choice at least."""
    cut = [round(64 * i / parts) for i in range(parts + 1)]
    block = [((1 << (b - a)) - 1) << a for a, b in zip(cut, cut[1:])]
    return [sum(c) for c in combinations(block, parts - bits)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def bucket_links(print_: np.ndarray, ids: np.ndarray, bits: int) -> tuple[list[int], list[int]]:
    """Links within ``bits`` that connect a bucket's parts: a spanning forest, at most one fewer than members."""
    label = np.arange(len(ids))
    a, b = [], []
    for i in range(1, len(ids)):
        near = np.flatnonzero(np.bitwise_count(print_[:i] ^ print_[i]) <= bits)
        if len(near):
            parts, where = np.unique(label[near], return_index=True)
            for j in near[where]:
                a.append(int(ids[i]))
                b.append(int(ids[j]))
            label[: i + 1][np.isin(label[: i + 1], parts)] = parts[0]
            label[i] = parts[0]
    return a, b


def _sorted_buckets(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """Links of the runs of equal keys of a sorted partition; a run may cross batches."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    rest = None

    def links(key: np.ndarray, pr: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
        cut = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]])
        left, right = [], []
        for i in np.flatnonzero(np.diff(cut) > 1):
            a, b = bucket_links(pr[cut[i] : cut[i + 1]], ids[cut[i] : cut[i + 1]], bits)
            left += a
            right += b
        return pa.record_batch([pa.array(left, pa.int64()), pa.array(right, pa.int64())], schema=schema)

    for batch in batches:
        now = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
        if rest is not None:
            now = [np.concatenate(x) for x in zip(rest, now)]
        if not len(now[0]):
            continue
        cut = int(np.searchsorted(now[0], now[0][-1]))
        if cut:
            yield links(now[0][:cut], now[1][:cut].view(np.uint64), now[2][:cut])
        rest = [x[cut:] for x in now]
    if rest is not None:
        yield links(rest[0], rest[1].view(np.uint64), rest[2])


def links(prints: DataFrame, bits: int = 3, parts: int = 6) -> DataFrame:
    """Links (a, b) that connect everything within ``bits`` of each other.

    ``prints`` has one row (fingerprint long, rep long) for each distinct
    fingerprint.  Every pair within reach is connected by the links returned,
    directly or by way of others in its bucket.
    """
    keys = F.array(*[F.xxhash64(F.lit(i), F.col("fingerprint").bitwiseAND(F.lit(_signed(m)))) for i, m in enumerate(block_masks(parts, bits))])
    dealt = (
        prints.where("rep is not null")
        .select(F.explode(keys).alias("key"), "fingerprint", "rep")
        .repartition("key")
        .sortWithinPartitions("key")
    )
    return dealt.mapInArrow(partial(_sorted_buckets, bits=bits), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, bits: int = 3) -> DataFrame:
    """(doc_id, fingerprint long, component_id): one row for each row of docs.

    component_id is the smallest id reachable over links of at most ``bits``
    differing bits, the row's own id included.
    """
    prints = stored(docs.select(F.col(id_col).cast("long").alias("doc_id"), fingerprint(F.col(text_col), k).alias("fingerprint")), "simhash")
    reps = prints.groupBy("fingerprint").agg(F.min("doc_id").alias("rep"))
    found = components(links(reps, bits))
    named = reps.join(found, reps.rep == found.node, "left").select("fingerprint", F.coalesce("component", "rep").alias("component_id"))
    return prints.join(named, "fingerprint").select("doc_id", "fingerprint", "component_id")


#: A wide fingerprint's words of 64 bits, and the bits in which candidates may differ (see :func:`similar`).
WIDE, REACH = 8, 128
#: Blocks of the first of them on which texts meet: two of five, so 10 keys of 25 or 26 bits.
PARTS = 5
_draw = np.random.default_rng(64)
_ODD = _draw.integers(1, 1 << 63, WIDE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _distinct(texts: pa.Array, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, end, hashes, offsets) of the distinct k-word shingles of the texts of each chunk, rising in each text."""
    for a, b, buf, offsets in bk.text_chunks(texts):
        h, _, _, first = bk.word_hashes(buf, offsets, bk.TOKEN)
        s, at = bk.shingles(h, first, k)
        sets = [np.unique(s[i:j]) for i, j in zip(at[:-1].tolist(), at[1:].tolist())]
        yield a, b, np.concatenate([*sets, np.zeros(0, np.uint64)]), np.concatenate([[0], np.cumsum([len(x) for x in sets], dtype=np.int64)])


def _node(s: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(np.ascontiguousarray(s).tobytes(), SEED)


def shingle_sets(text: Column, k: int) -> Column:
    """struct(node, s): the distinct shingle hashes of each text, and their hash."""

    @F.arrow_udf("struct<node:bigint,s:array<bigint>>")
    def shingled(texts: pa.Array) -> pa.Array:
        node, sets = [], []
        for _, _, s, at in _distinct(texts, k):
            for i, j in zip(at[:-1].tolist(), at[1:].tolist()):
                node.append(_node(s[i:j]))
                sets.append(bk.signed(s[i:j]))
        return pa.StructArray.from_arrays([pa.array(bk.signed(np.array(node, dtype=np.uint64))), pa.array(sets, pa.list_(pa.int64()))], names=["node", "s"])

    return shingled(text)


def block_keys(prints: np.ndarray) -> np.ndarray:
    """Hashes of the blocks of each fingerprint: two that differ in at most 3 bits share one at least (see :func:`links`)."""
    masks = np.array(block_masks(PARTS), dtype=np.uint64)
    with np.errstate(over="ignore"):
        return bk.mix((prints[:, None] & masks) ^ bk.mix(np.arange(1, len(masks) + 1, dtype=np.uint64) * _ODD[0]))


def wide_fingerprint(text: Column, k: int) -> Column:
    """struct(node, wide, keys) of a text's distinct shingles: their hash, WIDE SimHashes of them under different hash functions,
    and the hashes of the blocks of the first SimHash and of their MinHash bands (none for no shingles)."""

    @F.arrow_udf("struct<node:bigint,wide:array<bigint>,keys:array<bigint>>")
    def simhashes(texts: pa.Array) -> pa.Array:
        node, out, keys = np.zeros(len(texts), dtype=np.uint64), np.zeros((len(texts), WIDE), dtype=np.uint64), []
        for a, b, s, at in _distinct(texts, k):
            with np.errstate(over="ignore"):
                for i in range(WIDE):
                    out[a:b, i] = majority_bits(bk.mix(s * _ODD[i]), at)
            node[a:b] = [_node(s[i:j]) for i, j in zip(at[:-1].tolist(), at[1:].tolist())]
            own = bk.signed(np.concatenate([block_keys(out[a:b, 0]), bands(minima(s, at)).view(np.uint64)], axis=1))
            keys += [x if n else x[:0] for x, n in zip(own, np.diff(at).tolist())]
        wide = pa.ListArray.from_arrays(np.arange(0, out.size + 1, WIDE, dtype=np.int32), bk.signed(out.ravel()))
        return pa.StructArray.from_arrays([pa.array(bk.signed(node)), wide, pa.array(keys, pa.list_(pa.int64()))], names=["node", "wide", "keys"])

    return simhashes(text)


def similar(docs: DataFrame, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text", k: int = 5) -> DataFrame:
    """(doc_id, component_id) of every row: near-duplicates by the Jaccard likeness of distinct k-word shingles.

    Texts of the same shingles are one node.  Nodes meet on blocks of equal bits
    of their SimHash, as in :func:`links`: all whose first 64 bits differ in at
    most 3 share a key.  At a likeness of 0.8 those bits differ in 9.7 on
    average, so nodes meet on MinHash bands as well (two sets of that likeness
    share one with probability 0.998), which adds pairs and takes none away.
    SimHash verifies all of them: pairs are candidates whose wide fingerprints
    differ in at most REACH of 512 bits (at a likeness of 0.8 the mean is 77.6
    with a deviation of 8.1; of sets of a few shingles up to 96 and 9), and
    links if the likeness of the sets is reached.
    """
    printed = wide_fingerprint(F.col(text_col), k)
    prints = stored(docs.select(F.col(id_col).cast("long").alias("doc_id"), printed.alias("p")).select("doc_id", "p.node", *[F.get("p.wide", F.lit(i)).alias(f"w{i}") for i in range(WIDE)], "p.keys"), "wide")
    reps = stored(prints.groupBy("node").agg(F.min("doc_id").alias("rep")), "reps")
    firsts = stored(prints.join(reps.select("node", F.col("rep").alias("doc_id")), ["node", "doc_id"], "left_semi").drop("doc_id").dropDuplicates(["node"]), "firsts")

    def sets(wanted: DataFrame) -> DataFrame:
        ids = wanted.join(reps, "node").select(F.col("rep").alias("_id")).distinct()
        texts = docs.join(ids, F.col(id_col).cast("long") == F.col("_id"), "left_semi")
        return texts.select(shingle_sets(F.col(text_col), k).alias("x")).select("x.*").join(wanted, "node", "left_semi").dropDuplicates(["node"])

    found = bucket_components(firsts.select(F.explode("keys").alias("key"), "node"), firsts.drop("keys"), sets, similarity, REACH)
    dropped(docs.sparkSession, firsts)
    named = reps.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    low = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    return prints.select("doc_id", "node").join(named.join(low, "component").select("node", "component_id"), "node").select("doc_id", "component_id")


def hex_print(col: Column) -> Column:
    """16 lowercase hex digits."""
    return F.lpad(F.lower(F.hex(col)), 16, "0")
