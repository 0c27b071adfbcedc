"""Removal of long repeated strings by suffix sorting in shards.

A byte goes when a string of ``length`` bytes covering it starts at any other
place as well, in the same text or another.  Strings are compared as bytes and
never cross texts.

Shards.  Every window of ``length`` bytes has a content-defined anchor (see
``anchors``), so equal windows meet under one anchor hash, and the windows of
one anchor in one text form a segment of less than ``2 * length`` bytes.
Segments with equal bytes (by 128 bits of two hash functions) are counted as
one class.  A class of two members or more repeats whole.  Anchors with two
classes or more go, one copy of each class, to shards whose suffixes are sorted
by external induced sorting (``suffixes``); a start whose common prefix with a
neighbour reaches ``length`` repeats.  Shards are cut at anchors, so each is
complete in itself.  A shard's queues keep ``MEMORY`` bytes and are on disk
beyond that.

Texts are cut in blocks of about 1 MB.  A block names each class once, with its
members, so a passage that stands in every text costs one row a block in the
joins, and what repeats is dealt back to the texts block by block.

An anchor with more than ``HOT`` classes is dealt anew: its segments are cut
into runs of ``RUN`` windows, keyed also by the bytes that all windows of a run
share; runs that are still hot are cut into single windows, each of which is its
own class and needs no sorting.

Defined results: a null text is empty and nothing goes; texts shorter than
``length`` stay whole; repeated rows repeat each other and so go wherever a
string of the length fits; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frametally.llm import anchors, suffixes
from frametally.llm import bytekernels as bk
from frametally.llm.shared import dropped, stored

LENGTH = 400
#: Bytes of an anchor.
ANCHOR = 128
#: The least bytes of a passage of 51 words, at three letters a word; and of its anchor.
PASSAGE, PASSAGE_ANCHOR = 200, 64
#: More classes than this under one anchor are dealt anew.
HOT = 1 << 14
#: Windows in a run of a hot segment.
RUN = 17
#: Bytes of a shard, and of its queues in memory.
SHARD, MEMORY = 2 << 20, 4 << 20

_CLASS = pa.struct([("x", pa.int64()), ("y", pa.int64())])
_MEMBERS = pa.list_(pa.struct([("i", pa.int32()), ("first", pa.int32())]))
_ROWS = pa.list_(pa.struct([("k1", pa.int64()), ("k2", pa.int64())]))
_BLOCKS = pa.schema([("block", pa.int64()), ("h", pa.int64()), ("seg", _CLASS), ("windows", pa.int32()), ("lead", pa.int32()), ("n", pa.int64()), ("members", _MEMBERS), ("rows", _ROWS)])
_BLOCKS_SQL = "block long, h long, seg struct<x:long,y:long>, windows int, lead int, n long, members array<struct<i:int,first:int>>, rows array<struct<k1:long,k2:long>>"


def _class(x: np.ndarray, y: np.ndarray) -> pa.Array:
    return pa.StructArray.from_arrays([pa.array(bk.signed(x)), pa.array(bk.signed(y))], fields=list(_CLASS))


def _blocks(batches: Iterator[pa.RecordBatch], length: int, k: int) -> Iterator[pa.RecordBatch]:
    """The classes of segments in each block of texts (k1, k2, text), with their members, and one row with the block's rows.

    A member is the number of its text in the block and its first start there.
    """
    for batch in batches:
        keys = [batch.column(i).to_numpy() for i in range(2)]
        for a, b, buf, offsets in bk.text_chunks(batch.column(2)):
            t, h, anchor, first, last, seg = anchors.segments(buf, offsets, length, k)
            if not len(t):
                continue
            raw, at = buf.tobytes(), offsets[t]
            other = np.array([xxhash.xxh3_64_intdigest(raw[i:j]) for i, j in zip((at + first).tolist(), (at + last + length).tolist())], dtype=np.uint64)
            order = np.lexsort((other, seg))
            seg, other = seg[order], other[order]
            new = np.ones(len(order), dtype=bool)
            new[1:] = (seg[1:] != seg[:-1]) | (other[1:] != other[:-1])
            own = np.flatnonzero(new)
            cut = np.append(own, len(order)).astype(np.int32)
            one = order[own]
            k1, k2 = keys[0][a:b], keys[1][a:b]
            name = xxhash.xxh3_64_intdigest(k1.tobytes() + k2.tobytes())
            name -= (1 << 64) * (name >> 63)
            members = pa.StructArray.from_arrays([pa.array(t[order].astype(np.int32)), pa.array(first[order].astype(np.int32))], fields=list(_MEMBERS.value_type))
            yield pa.record_batch(
                [
                    pa.array(np.full(len(one), name, dtype=np.int64)), pa.array(bk.signed(h[one])), _class(seg[own], other[own]), pa.array((last - first + 1)[one].astype(np.int32)),
                    pa.array((anchor - first)[one].astype(np.int32)), pa.array(np.diff(cut).astype(np.int64)), pa.ListArray.from_arrays(pa.array(cut), members), pa.nulls(len(one), _ROWS),
                ],
                schema=_BLOCKS,
            )
            rows = pa.StructArray.from_arrays([pa.array(k1), pa.array(k2)], fields=list(_ROWS.value_type))
            none = [pa.nulls(1, f.type) for f in list(_BLOCKS)[1:7]]
            yield pa.record_batch([pa.array([name], pa.int64()), *none, pa.ListArray.from_arrays(pa.array([0, b - a], pa.int32()), rows)], schema=_BLOCKS)


def _keys(id_col: str, text_col: str) -> list[Column]:
    return [F.xxhash64(id_col).alias("k1"), F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("k2")]


def _cut_bytes(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """The bytes of each wanted segment of each text."""
    for batch in batches:
        wanted = batch.column(1)
        item = wanted.flatten()
        n = np.diff(wanted.offsets.to_numpy())
        first, windows = (item.field(i).to_numpy() for i in (2, 3))
        texts = batch.column(0).fill_null("").cast(pa.binary())
        out, at = [], 0
        for i, k in enumerate(n.tolist()):
            raw = texts[i].as_buffer().to_pybytes() if k else b""
            out += [raw[f : f + w + length - 1] for f, w in zip(first[at : at + k].tolist(), windows[at : at + k].tolist())]
            at += k
        yield pa.record_batch([item.field(0), item.field(1), item.field(4), pa.array(out, pa.binary())], names=["h", "seg", "lead", "bytes"])


def _ranges(starts: np.ndarray) -> list[dict]:
    cut = np.flatnonzero(np.diff(starts) > 1)
    return [{"a": int(a), "b": int(b)} for a, b in zip(starts[np.append(0, cut + 1)], starts[np.append(cut, len(starts) - 1)])]


_HITS = pa.schema([("seg", _CLASS), ("hits", pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))])


def _sorted_shards(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """(seg, ranges of repeating starts) of segments sorted by anchor hash.

    Shards are cut where the hash changes, once they hold SHARD bytes.
    """
    segs: list[dict] = []
    texts: list[bytes] = []
    held, last = 0, None

    def flush() -> pa.RecordBatch:
        rows = [(s, _ranges(x)) for s, x in zip(segs, suffixes.repeated_starts(texts, length, MEMORY)) if len(x)]
        segs.clear()
        texts.clear()
        return pa.record_batch([pa.array([r[0] for r in rows], _CLASS), pa.array([r[1] for r in rows], _HITS.field(1).type)], schema=_HITS)

    for batch in batches:
        for h, s, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            if h != last and held >= SHARD:
                yield flush()
                held = 0
            segs.append(s)
            texts.append(t)
            held += len(t)
            last = h
    if texts:
        yield flush()


def _runs(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Runs of RUN windows of each segment (h, seg, lead, bytes): key, sub-segment, its place and bytes.

    A run holds windows whose anchor stands at like places in them, so equal
    windows fall into runs of equal keys.
    """
    for batch in batches:
        key, sub, other, of, begin, content = [], [], [], [], [], []
        for h, s, lead, t in zip(*(batch.column(i).to_pylist() for i in range(4))):
            sums = bk.prefix_sums(np.frombuffer(t, dtype=np.uint8))
            last = len(t) - length
            place = lead - np.arange(last + 1)  # of the anchor in each window
            cut = np.concatenate([[0], np.flatnonzero(np.diff(place // RUN)) + 1, [last + 1]])
            lo, hi = cut[:-1], cut[1:] - 1
            run = place[lo] // RUN
            core = bk.range_hash(sums, np.clip(lead - run * RUN, 0, None), np.clip(lead - run * RUN - RUN + 1 + length, 0, len(t)))
            with np.errstate(over="ignore"):
                core ^= bk.mix(np.uint64(h & bk._MASK) + (run + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            key.append(bk.signed(core))
            sub.append(bk.range_hash(sums, lo, hi + length))
            of += [s] * len(lo)
            begin.append(lo.astype(np.int32))
            own = [t[a : b + length] for a, b in zip(lo.tolist(), hi.tolist())]
            other += [xxhash.xxh3_64_intdigest(x) for x in own]
            content += own
        if of:
            subs = _class(np.concatenate(sub), np.array(other, dtype=np.uint64))
            yield pa.record_batch([pa.array(np.concatenate(key)), subs, pa.array(of, _CLASS), pa.array(np.concatenate(begin)), pa.array(content, pa.binary())], names=["h", "sub", "seg", "begin", "bytes"])


def _windows(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Every single window of runs (seg, begin, bytes, n): its hash and place."""
    for batch in batches:
        of, start, h, other, n = [], [], [], [], []
        for s, b, t, m in zip(*(batch.column(i).to_pylist() for i in range(4))):
            at = np.arange(len(t) - length + 1)
            h.append(bk.range_hash(bk.prefix_sums(np.frombuffer(t, dtype=np.uint8)), at, at + length))
            other += [xxhash.xxh3_64_intdigest(t[i : i + length]) for i in range(len(at))]
            start.append((at + b).astype(np.int32))
            of += [s] * len(at)
            n += [m] * len(at)
        if of:
            yield pa.record_batch([_class(np.concatenate(h), np.array(other, dtype=np.uint64)), pa.array(of, _CLASS), pa.array(np.concatenate(start)), pa.array(n, pa.int64())], names=["w", "seg", "start", "n"])


def _joined_ranges(ranges: str) -> Column:
    """Ranges of starts (a, b), sorted, those that touch or overlap made one."""
    return F.expr(f"""
      aggregate(array_sort({ranges}), cast(array() as array<struct<a:int,b:int>>), (st, x) ->
        CASE WHEN size(st) > 0 AND x.a <= element_at(st, -1).b + 1
             THEN concat(slice(st, 1, size(st) - 1), array(named_struct('a', element_at(st, -1).a, 'b', greatest(element_at(st, -1).b, x.b))))
             ELSE concat(st, array(x)) END)
    """)


def _sort(rows: DataFrame, length: int) -> DataFrame:
    """(seg, hits) of rows (h, seg, bytes)."""
    return rows.select("h", "seg", "bytes").repartition("h").sortWithinPartitions("h").mapInArrow(partial(_sorted_shards, length=length), "seg struct<x:long,y:long>, hits array<struct<a:int,b:int>>")


def _hot_hits(hot: DataFrame, length: int) -> DataFrame:
    """(seg, hits) of hot rows (h, seg, lead, bytes), dealt anew run by run, then window by window."""
    runs = stored(hot.select("h", "seg", "lead", "bytes").mapInArrow(partial(_runs, length=length), "h long, sub struct<x:long,y:long>, seg struct<x:long,y:long>, begin int, bytes binary"), "runs")
    subs = stored(runs.groupBy("sub").agg(F.first("h").alias("h"), F.count(F.lit(1)).alias("n")), "subs")
    size = subs.groupBy("h").agg(F.count(F.lit(1)).alias("classes"))
    sized = stored(subs.join(size, "h").where("n > 1 or classes > 1"), "subs")
    width = F.octet_length("bytes") - length
    whole = runs.join(sized.where("n > 1").select("sub"), "sub").select("seg", F.array(F.struct(F.col("begin").alias("a"), (F.col("begin") + width).alias("b"))).alias("hits"))
    one = runs.join(sized.where("classes > 1").select("sub", "classes", "n"), "sub").dropDuplicates(["sub"])
    sorted_ = _sort(one.where(F.col("classes") <= HOT).select("h", F.col("sub").alias("seg"), "bytes"), length)
    placed = runs.select("sub", "seg", "begin").join(sorted_.select(F.col("seg").alias("sub"), "hits"), "sub")
    placed = placed.select("seg", F.expr("transform(hits, x -> named_struct('a', x.a + begin, 'b', x.b + begin))").alias("hits"))
    # runs that repeat whole as they stand are known; what is left of the hot ones goes window by window
    single = one.where(F.col("classes") > HOT).select("seg", "begin", "bytes", "n").mapInArrow(partial(_windows, length=length), "w struct<x:long,y:long>, seg struct<x:long,y:long>, start int, n long")
    single = stored(single, "windows")
    twice = single.groupBy("w").agg(F.sum("n").alias("m")).where("m > 1")
    found = single.join(twice, "w").select("seg", F.array(F.struct(F.col("start").alias("a"), F.col("start").alias("b"))).alias("hits"))
    return whole.unionByName(placed).unionByName(found)


def _placed(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """(block, i, spans) of the texts of blocks: rows (block, members, hits) sorted by block; spans that touch are one."""
    rest = None

    def texts(rows: pa.Table) -> pa.RecordBatch:
        block = rows.column(0).to_numpy()
        members, hits = (rows.column(i).combine_chunks() for i in (1, 2))
        at, hit_at = members.offsets.to_numpy().astype(np.int64), hits.offsets.to_numpy().astype(np.int64)
        text, first = (members.values.field(i).to_numpy().astype(np.int64) for i in (0, 1))
        low, high = (hits.values.field(i).to_numpy().astype(np.int64) for i in (0, 1))
        row = np.repeat(np.arange(len(block)), np.diff(at))
        own = np.diff(hit_at)[row]
        member = np.repeat(np.arange(at[0], at[-1]), own)
        hit = np.repeat(hit_at[:-1][row], own) + np.arange(len(member)) - np.repeat(np.cumsum(own) - own, own)
        # the text's number with its block's, then its spans in order
        name = np.cumsum(np.append(True, block[1:] != block[:-1])) - 1
        of = (name[np.repeat(row, own)] << 32) + text[member]
        a, b = low[hit] + first[member], high[hit] + first[member] + length
        order = np.lexsort((a, of))
        of, a, b = of[order], a[order], b[order]
        top = np.maximum.accumulate((np.cumsum(np.append(True, of[1:] != of[:-1])) << 40) + b) & ((1 << 40) - 1)
        new = np.ones(len(of), dtype=bool)
        new[1:] = (of[1:] != of[:-1]) | (a[1:] > top[:-1])
        start = np.flatnonzero(new)
        end = np.append(start[1:], len(of)) - 1
        spans = pa.StructArray.from_arrays([pa.array(a[start].astype(np.int32)), pa.array(top[end].astype(np.int32))], names=["a", "b"])
        own_text = of[start]
        cut = np.flatnonzero(np.append(True, own_text[1:] != own_text[:-1]))
        names = block[np.flatnonzero(np.append(True, block[1:] != block[:-1]))]
        return pa.record_batch(
            [pa.array(names[own_text[cut] >> 32]), pa.array((own_text[cut] & 0xFFFFFFFF).astype(np.int32)), pa.ListArray.from_arrays(pa.array(np.append(cut, len(start)).astype(np.int32)), spans)],
            names=["block", "i", "spans"],
        )

    for batch in batches:
        if not batch.num_rows:
            continue
        now = pa.Table.from_batches([batch])
        if rest is not None:
            now = pa.concat_tables([rest, now])
        block = now.column(0).to_numpy()
        cut = int(np.searchsorted(block, block[-1]))
        if cut:
            yield texts(now.slice(0, cut).combine_chunks())
        rest = now.slice(cut)
    if rest is not None:
        yield texts(rest.combine_chunks())


def repeated_ranges(docs: DataFrame, length: int = LENGTH, k: int = ANCHOR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(k1, k2, spans array<struct(a, b)>): the byte ranges that go, for each distinct row in which any do.

    k1 and k2 are hashes of the row's id and text; ranges neither touch nor overlap.
    """
    spark = docs.sparkSession
    keyed = docs.select(*_keys(id_col, text_col), F.coalesce(text_col, F.lit("")).alias("text"))
    blocks = stored(keyed.mapInArrow(partial(_blocks, length=length, k=k), _BLOCKS_SQL), "blocks")
    members = blocks.where("h is not null").drop("rows")
    rows = blocks.where("h is null").select("block", F.posexplode("rows").alias("i", "row")).select("block", "i", "row.*")
    several = (F.min("seg.x") != F.max("seg.x")) | (F.min("seg.y") != F.max("seg.y"))
    met = stored(members.groupBy("h").agg(F.sum("n").alias("m"), several.alias("several")).where("m > 1").select("h", "several"), "met")
    shared = stored(members.join(met, "h"), "shared")
    one = F.struct("block", F.col("members")[0]["i"].alias("i"), F.col("members")[0]["first"].alias("first"), "windows", "lead")
    classes = stored(shared.groupBy("seg").agg(F.sum("n").alias("n"), F.min(one).alias("one"), F.first("h").alias("h"), F.first("several").alias("several")), "classes")
    # one copy of each class of an anchor that has several: its bytes, cut from the text that holds it
    wanted = classes.where("several").select("one.block", "one.i", F.struct("h", "seg", "one.first", "one.windows", "one.lead").alias("w"))
    lists = stored(wanted.join(rows, ["block", "i"]).groupBy("k1", "k2").agg(F.collect_list("w").alias("w")), "lists")
    found = stored(keyed.join(lists, ["k1", "k2"]).dropDuplicates(["k1", "k2"]).select("text", "w").mapInArrow(partial(_cut_bytes, length=length), "h long, seg struct<x:long,y:long>, lead int, bytes binary"), "found")
    crowd = stored(classes.where("several").groupBy("h").agg(F.count(F.lit(1)).alias("classes")).where(F.col("classes") > HOT).select("h"), "crowd")
    hits = classes.where("n > 1").select("seg", F.array(F.struct(F.lit(0).alias("a"), (F.col("one.windows") - 1).alias("b"))).alias("hits"))
    if crowd.isEmpty():
        hits = hits.unionByName(_sort(found, length))
    else:
        hits = hits.unionByName(_sort(found.join(crowd, "h", "left_anti"), length))
        hits = hits.unionByName(_hot_hits(found.join(crowd, "h", "left_semi"), length))
    # one row for each class, its ranges merged, so that the join below makes one row for each class of a block
    hits = stored(hits.groupBy("seg").agg(F.flatten(F.collect_list("hits")).alias("hits")).select("seg", _joined_ranges("hits").alias("hits")), "hits")
    placed = shared.select("block", "seg", "members").join(hits, "seg").select("block", "members", "hits")
    placed = placed.repartition("block").sortWithinPartitions("block").mapInArrow(partial(_placed, length=length), "block long, i int, spans array<struct<a:int,b:int>>")
    out = stored(placed.join(rows, ["block", "i"]).select("k1", "k2", "spans").dropDuplicates(["k1", "k2"]), "spans")
    for x in (blocks, met, shared, classes, lists, found, crowd, hits):
        dropped(spark, x)
    return out


def _merged(spans: list[dict] | None) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted((s["a"], s["b"]) for s in spans or ()):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def kept(text: Column, spans: Column) -> Column:
    """struct(n_bytes, n_removed, n_spans, sha256, text) of a text without its spans.

    The digest is of the exact bytes left; the text drops what is left of a
    character that was cut in two.
    """
    kind = pa.struct([("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("sha256", pa.string()), ("text", pa.string())])

    @F.arrow_udf("struct<n_bytes:long,n_removed:long,n_spans:long,sha256:string,text:string>")
    def cut(texts: pa.Array, ranges: pa.Array) -> pa.Array:
        rows = []
        for t, r in zip(texts, ranges):
            raw = t.as_buffer().to_pybytes() if t.is_valid else b""
            gone = _merged(r.as_py())
            left, at = [], 0
            for a, b in gone:
                left.append(raw[at:a])
                at = b
            rest = b"".join([*left, raw[at:]])
            rows.append((len(raw), len(raw) - len(rest), len(gone), hashlib.sha256(rest).hexdigest(), rest.decode("utf-8", "ignore")))
        return pa.StructArray.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows) if rows else [[]] * 5, kind)], fields=list(kind))

    return cut(text, spans)


def _with_spans(docs: DataFrame, ranges: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs with the columns of ranges (k1, k2, ...) of its rows."""
    named = ranges.withColumnsRenamed({"k1": "_k1", "k2": "_k2"})
    k1, k2 = _keys(id_col, text_col)
    keyed = docs.withColumns({"_own1": k1, "_own2": k2})
    return keyed.join(named, (F.col("_own1") == F.col("_k1")) & (F.col("_own2") == F.col("_k2")), "left").drop("_own1", "_own2", "_k1", "_k2")


def without_repeats(docs: DataFrame, length: int = LENGTH, k: int = ANCHOR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one more column, ``kept``, the struct of :func:`kept`."""
    ranges = repeated_ranges(docs, length, k, id_col, text_col).withColumnRenamed("spans", "_spans")
    return _with_spans(docs, ranges, id_col, text_col).withColumn("kept", kept(F.col(text_col), F.col("_spans"))).drop("_spans")


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_passages, passage_bytes) of every row.

    Strings of LENGTH bytes are removed; passages are the maximal runs covered
    by repeating strings of PASSAGE bytes, which a passage of over 50 words has
    that the removal leaves in if it is shorter than LENGTH.
    """
    removed = repeated_ranges(docs, LENGTH, ANCHOR, id_col, text_col).withColumnRenamed("spans", "_spans")
    passages = repeated_ranges(docs, PASSAGE, PASSAGE_ANCHOR, id_col, text_col).withColumnRenamed("spans", "_passages")
    both = stored(passages.join(removed, ["k1", "k2"], "left"), "both")  # what LENGTH finds, PASSAGE does as well
    cut = _with_spans(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), both, "doc_id", "text")
    cut = cut.withColumn("kept", kept(F.col("text"), F.col("_spans")))
    passage_bytes = F.expr("aggregate(_passages, 0L, (n, x) -> n + x.b - x.a)")
    return cut.select(
        "doc_id", "kept.n_bytes", "kept.n_removed", "kept.n_spans", F.col("kept.sha256").alias("kept_sha256"),
        F.coalesce(F.size("_passages"), F.lit(0)).cast("long").alias("n_passages"), F.coalesce(passage_bytes, F.lit(0)).alias("passage_bytes"),
    )
