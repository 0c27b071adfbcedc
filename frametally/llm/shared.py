"""What the operators share: reading tables, cutting lineage, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: Application id -> the folder made for it, where the cluster names none.
_own: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Only where none is named (a local session, as in tests) is one made.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = "file://" + tempfile.mkdtemp(prefix="frametally-checkpoint-")
        named = _own[app]
    return named.rstrip("/")


def stored(df: DataFrame, what: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again.

    Cuts the lineage so that a lost executor costs no recomputation, and lets
    Spark see the true size of what follows (it broadcasts only below its
    configured threshold, and shuffles otherwise).
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, df: DataFrame) -> None:
    """Deletes the files behind a frame that :func:`stored` returned."""
    for f in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(f)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Bits of the map of wanted nodes that is broadcast: 16 MB at most.
MAP_BITS = 27


def maybe_wanted(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows whose node is in wanted, and a few others: those that share their lowest MAP_BITS bits with one that is.

    Spares most rows a shuffle at any size; a join with wanted must follow.
    """
    place = F.pmod(F.col("node"), F.lit(1 << MAP_BITS)) + 1
    maps = wanted.select(place.alias("place")).groupBy(F.bitmap_bucket_number("place").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("_map"))
    at = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.substring("_map", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    met = rows.join(F.broadcast(maps), F.bitmap_bucket_number(place) == F.col("_bucket"))
    return met.where(F.getbit(byte, (at % 8).cast("int")) == 1).drop("_bucket", "_map")


#: Nodes of a bucket, about, that are tested against each other in one piece, and shingles looked at a time.
CHUNK, COLUMNS = 1024, 1024


def alike(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of nodes whose sets (node, s) have the Jaccard likeness or more."""
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("node").alias("b"), F.col("s").alias("sb")), "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    return both.where(shared >= similarity * (F.size("sa") + F.size("sb") - shared)).select("a", "b")


def _near(pairs: DataFrame, prints: DataFrame, words: list[str], most: int) -> DataFrame:
    """The pairs (a, b) whose prints differ in at most ``most`` bits, and in how many they do."""
    for side in "ab":
        pairs = pairs.join(prints.select(F.col("node").alias(side), *[F.col(w).alias(f"{side}_{w}") for w in words]), side)
    apart = sum((F.bit_count(F.col(f"a_{w}").bitwiseXOR(F.col(f"b_{w}"))) for w in words), F.lit(0))
    return pairs.withColumn("apart", apart).where(F.col("apart") <= most).select("a", "b", "apart")


def _shared_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many values each set of left shares with each of right."""
    value, at = np.unique(np.concatenate([*left, *right]), return_inverse=True)
    often = np.bincount(at, minlength=len(value)) > 1
    column = np.cumsum(often) - 1
    row = np.repeat(np.arange(len(left) + len(right)), [len(x) for x in [*left, *right]])
    keep = often[at]
    row, at = row[keep], column[at[keep]]
    order = np.argsort(at, kind="stable")
    row, at = row[order], at[order]
    out = np.zeros((len(left), len(right)), dtype=np.float32)
    for first in range(0, int(at[-1]) + 1 if len(at) else 0, COLUMNS):
        a, b = np.searchsorted(at, (first, first + COLUMNS))
        has = np.zeros((len(left) + len(right), COLUMNS), dtype=np.float32)
        has[row[a:b], at[a:b] - first] = 1
        out += has[: len(left)] @ has[len(left) :].T
    return out


def _forest(ok: np.ndarray, part: np.ndarray, shift: int) -> tuple[list[int], list[int]]:
    """Links i, j + shift of a matrix of allowed ones that connect what it connects: at most one fewer than there are parts."""
    _, label = np.unique(part, return_inverse=True)
    i_, j_ = [], []
    for i in range(len(ok)):
        near = np.flatnonzero(ok[i]) + shift
        parts, where = np.unique(label[near], return_index=True)
        new = parts != label[i]
        if new.any():
            j_ += near[where[new]].tolist()
            i_ += [i] * int(new.sum())
            label[np.isin(label, parts)] = label[i]
    return i_, j_


def linked(batches: Iterator[pa.RecordBatch], similarity: float, most: int) -> Iterator[pa.RecordBatch]:
    """Links (a, b) of rows (piece, side, node, part, s, words...) sorted by piece.

    A piece has nodes of side 0 alone, all pairs of which are tested, or of
    both sides, where each is tested with those of the other side.  Nodes of
    different parts may link whose prints differ in at most ``most`` bits and
    whose sets have the likeness; of those links a forest is returned.
    """
    rest = None

    def links(rows: pa.Table) -> pa.RecordBatch | None:
        side, node, part = (rows.column(i).to_numpy() for i in (1, 2, 3))
        left = np.flatnonzero(side == 0)
        right = np.flatnonzero(side == 1) if side.any() else left
        if part.min() == part.max() or not len(left):
            return None
        sets = rows.column(4).combine_chunks()
        at, flat = sets.offsets.to_numpy(), sets.values.to_numpy()
        size = np.diff(at)
        ok = part[left][:, None] != part[right][None, :]
        apart = np.zeros(ok.shape, dtype=np.uint16)
        for i in range(5, rows.num_columns):
            w = rows.column(i).to_numpy().view(np.uint64)
            apart += np.bitwise_count(w[left][:, None] ^ w[right][None, :])
        ok &= apart <= most
        # nodes without a near one are not looked at further
        own, other = ok.any(axis=1), ok.any(axis=0)
        left, right, ok = left[own], right[other], ok[own][:, other]
        if not len(left):
            return None
        both = _shared_counts([flat[at[i] : at[i + 1]] for i in left], [flat[at[i] : at[i + 1]] for i in right])
        ok &= both >= similarity * (size[left][:, None] + size[right][None, :] - both) - 1e-6
        place = np.concatenate([left, right])
        # one that stands on both sides is one node
        i, j = _forest(ok, np.concatenate([part[left], part[right]]), len(left))
        a, b = node[place[i]], node[place[j]]
        return pa.record_batch([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    def pieces(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        piece = rows.column(0).to_numpy()
        cut = np.concatenate([[0], np.flatnonzero(piece[1:] != piece[:-1]) + 1, [len(piece)]])
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
            if b - a > 1 and (out := links(rows.slice(a, b - a).combine_chunks())) is not None:
                yield out
            # a crowded bucket is many pieces: what one needed is given back before the next
            pa.default_memory_pool().release_unused()

    for batch in batches:
        if not batch.num_rows:
            continue
        now = pa.Table.from_batches([batch])
        if rest is not None:
            now = pa.concat_tables([rest, now])
        piece = now.column(0).to_numpy()
        cut = int(np.searchsorted(piece, piece[-1]))
        if cut:
            yield from pieces(now.slice(0, cut))
        rest = now.slice(cut)
    if rest is not None:
        yield from pieces(rest)


def bucket_components(dealt: DataFrame, prints: DataFrame, sets: Callable[[DataFrame], DataFrame], similarity: float, most: int) -> DataFrame:
    """(node, component) of the nodes linked by pairs that share a key, have near prints and whose sets have the likeness.

    ``dealt`` has rows (key, node); ``prints`` has node and its print's words of
    64 bits, which differ in at most ``most`` bits where they are near;
    ``sets`` gives (node, s) of nodes.  First each node is tested with the
    smallest node of each of its buckets, and the nearest of those is verified.
    Then every pair of a bucket whose nodes are in different components is
    tested, in pieces of bounded size that return no more links than nodes, so
    no pair is missed for an unlike node between its two.
    """
    spark = dealt.sparkSession
    words = [c for c in prints.columns if c != "node"]
    lead = stored(dealt.groupBy("key").agg(F.min("node").alias("lead"), F.max("node").alias("top"), F.count(F.lit(1)).alias("n")).where("lead < top").select("key", "lead", "n"), "lead")
    # keys of one node alone, most of them, are shuffled for the last time here
    met = stored(dealt.join(lead, "key").select("key", "node", "lead", "n"), "met")
    dropped(spark, lead)
    near = stored(_near(met.where("node <> lead").select(F.col("lead").alias("a"), F.col("node").alias("b")).distinct(), prints, words, most), "near")
    first = stored(near.groupBy("b").agg(F.min(F.struct("apart", "a")).alias("x")).select("x.a", "b"), "pairs")
    # written first: its size decides how the texts are looked up
    wanted = stored(first.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "wanted")
    known = stored(sets(wanted), "sets")
    links = stored(alike(first, known, similarity), "links")
    found = stored(components(links), "found")
    part = {s: found.select(F.col("node").alias(s), F.col("component").alias(f"part_{s}")) for s in ("a", "b")}
    # buckets of two are known by now but for nodes that had a nearer one elsewhere
    rest = near.select("a", "b").join(part["a"], "a", "left").join(part["b"], "b", "left").where(F.coalesce("part_a", "a") != F.coalesce("part_b", "b")).select("a", "b")
    rest = stored(rest.join(first, ["a", "b"], "left_anti"), "pairs")
    crowd = stored(met.where("n > 2").join(found, "node", "left").select("key", "node", F.coalesce("component", "node").alias("part")), "crowd")
    # a bucket's nodes of its largest part need not meet each other
    sized = crowd.groupBy("key", "part").agg(F.count(F.lit(1)).alias("m")).groupBy("key").agg(F.sum("m").alias("n"), F.max(F.struct("m", "part")).alias("big")).where("big.m < n")
    sized = sized.select("key", F.col("big.part").alias("main"), F.ceil(F.col("big.m") / CHUNK).cast("int").alias("mains"), F.ceil((F.col("n") - F.col("big.m")) / CHUNK).cast("int").alias("others"))
    rows = stored(crowd.join(sized, "key"), "rows")
    wanted2 = stored(rows.select("node").unionByName(rest.select(F.explode(F.array("a", "b")).alias("node"))).distinct(), "wanted")
    known2 = stored(sets(wanted2), "sets")
    in_main = F.col("part") == F.col("main")
    own = F.pmod(F.xxhash64("node"), F.when(in_main, F.col("mains")).otherwise(F.col("others"))).cast("int")

    def place(kind: int, x: Column, y: Column, side: Column) -> Column:
        return F.struct(F.xxhash64("key", F.lit(kind), x, y).alias("piece"), side.cast("int").alias("side"))

    with_main = F.transform(F.sequence(F.lit(0), F.col("mains") - 1), lambda o: place(1, F.col("own"), o, F.lit(0)))
    with_rest = F.transform(F.sequence(F.lit(0), F.col("others") - 1), lambda o: place(0, F.least("own", o), F.greatest("own", o), F.col("own") > o))
    of_main = F.transform(F.sequence(F.lit(0), F.col("others") - 1), lambda o: place(1, o, F.col("own"), F.lit(1)))
    placed = rows.withColumn("own", own).select("node", "part", F.explode(F.when(in_main, of_main).otherwise(F.concat(with_main, with_rest))).alias("x"))
    placed = placed.join(known2, "node").join(prints, "node").select("x.piece", "x.side", "node", "part", "s", *words)
    crowded = placed.repartition("piece").sortWithinPartitions("piece").mapInArrow(partial(linked, similarity=similarity, most=most), "a long, b long")
    more = stored(alike(rest, known2, similarity).unionByName(crowded), "links")
    out = stored(components(links.unionByName(more)), "components")
    for x in (met, near, first, wanted, wanted2, known, links, found, rest, crowd, rows, known2, more):
        dropped(spark, x)
    return out


def components(edges: DataFrame, a: str = "a", b: str = "b", most: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable, for every node in an edge.

    Alternating large-star and small-star steps: each keeps components whole,
    and the number of rounds grows with the logarithm of the longest path.
    Rounds are written to the shared folder.  A null end is no link.
    """
    spark = edges.sparkSession
    now = stored(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u is not null and v is not null and u <> v").distinct(), "links"
    )
    before = None
    for _ in range(most):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # large star: every larger neighbour of a node moves to the node's smallest neighbour
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: the node and its smaller neighbours, few after a large star, move to the smallest of them
        small = (
            large.withColumn("m", F.min("v").over(Window.partitionBy("u")))
            .select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("x"))
            .select(F.col("x.v").alias("u"), F.col("x.m").alias("v"))
            .where("u <> v")
            .distinct()
        )
        nxt = stored(small, "links")
        total = nxt.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if before is None:
            before = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        dropped(spark, now)
        now = nxt
        if total == before:
            break
        before = total
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
