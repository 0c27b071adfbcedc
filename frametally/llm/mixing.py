"""Mixing sources to target weights by pivotal dependent rounding.

DataFrame and SQL functions only.  A source's target divided by its size is the
number of copies each of its documents should have on average; the whole part
is taken outright and the fractional part is rounded by the pivotal method: of
a pair with fractional copies one gives words that the other gets, in a
direction drawn so that neither's expectation changes, until one of the two has
whole copies only.  In a block, whose documents begin with one fraction, the
largest is paired first, with all smaller ones together; so it is settled while
there are words enough to trade with, and the residual is the smallest document
unless a larger one outweighs all that its partners can trade.  Where a source
is one block such a document goes the way that its partners can bear, the one
place where a draw is not free.  A trade keeps the pair's words, so a source's
total moves only when its very last residual is rounded, by at most half of
that document.

Trades run inside blocks of about ``BLOCK`` documents; each block leaves at most
one fractional document, and these residuals trade two by two level by level, a
reduction tree of fan-in ``BLOCK`` whose depth grows with the logarithm of the
largest source.  Blocks are dealt by a hash of the document, so a source with a
third of all rows is spread over as many tasks as any other rows.  Draws are
hashes of the documents in the trade: reruns agree.

Defined results: a null text has size 0, and nothing is taken of it; a null
source is a source of its own, last in order; repeated rows are mixed as the
rows they are; a row without an id is mixed like others; an empty table mixes
to an empty table; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from frametally.llm.shared import stored

WEIGHTS = (5, 2, 1)
#: No source is repeated more often than this.
MOST = 3
#: Documents in a block, on average.
BLOCK = 256
TOKENS = r"[^\x20\x09-\x0D]+"


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, rows, target): the words each source gives to a mix of all words.

    Shares are in proportion to the weights, which repeat over the sources in
    code point order (null last).  A share stops at ``most`` times its source
    and the excess is shared again: with the sources ordered by cap per weight,
    the level at which caps and shares use up all words is the first that no
    later cap lies below.  One row for each source, no document rows.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows"))
    order = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source"))
    weighed = per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((order - 1) % len(weights) + 1).cast("int")))
    ranked = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").isNull(), "source")
    before, everything = ranked.rowsBetween(Window.unboundedPreceding, -1), ranked.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(everything) - F.coalesce(most * F.sum("source_size").over(before), F.lit(0))
    level = left.cast("double") / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    levels = weighed.withColumn("level", level).withColumn("fits", F.col("level") * F.col("weight") <= most * F.col("source_size"))
    water = F.first(F.when(F.col("fits"), F.col("level")), ignorenulls=True).over(everything)
    return levels.withColumn("water", water).select(
        "source", "source_size", "rows", F.coalesce(F.least(F.col("water") * F.col("weight"), (most * F.col("source_size")).cast("double")), F.lit(0.0)).alias("target")
    )


_SCHEMA = "struct<p:double,size:bigint,doc_id:bigint,n:bigint>"
_ITEM = "struct<p:double,size:bigint,doc_id:bigint,n:bigint,one:int>"


def _block_trades() -> str:
    """SQL of the trades of a block's ``items``, whose fractions are equal: struct(rest, done), rest the document still fractional.

    The state holds the words ``m`` still due from the documents not settled
    yet and their ``size``: their fraction is m / size, as each shares a trade
    by its size.  whole is 0 or 1 once the partner of ``rest`` is settled, and
    so are all that follow.  In a source's ``lone`` block nothing can make up for
    a large residual: there a document that can be settled one way only, as all
    others have too few words to give or too little room, goes that way.
    """
    draw = "pmod(xxhash64(-1, x.doc_id, x.n, x.size), 9007199254740992) / 9007199254740992D"

    def state(m: str, size: str, rest: str, whole: str, done: str) -> str:
        return f"named_struct('m', {m}, 'size', {size}, 'rest', {rest}, 'whole', {whole}, 'done', {done})"

    def settled(one: str) -> str:
        return f"concat(a.done, array(named_struct('p', cast({one} as double), 'size', x.size, 'doc_id', x.doc_id, 'n', x.n, 'one', {one})))"

    def residual(p: str, whole: str) -> str:
        return state("a.m", "a.size", f"named_struct('p', {p}, 'size', x.size, 'doc_id', x.doc_id, 'n', x.n)", f"cast({whole} as int)", "a.done")

    # has, lacks: words that the partner, all smaller documents, has and has room for; gives, gets: it can settle x by giving or getting
    partner = """array(named_struct(
        'p', a.m / a.size,
        'has', a.m - a.m / a.size * x.size,
        'lacks', (a.size - a.m) * (a.size - x.size) / a.size,
        'gives', a.m >= x.size,
        'gets', a.size - x.size >= a.m))"""
    gains = "{draw} * (least((1 - w.p) * x.size, w.has) + least(w.p * x.size, w.lacks)) < least(w.p * x.size, w.lacks)".format(draw=draw)
    trade = f"""
        case when a.size = x.size then {residual("w.p", "null")}
        when case when lone and w.gives != w.gets then w.gives else {gains} end then
          case when w.gives then {state("a.m - x.size", "a.size - x.size", "a.rest", "a.whole", settled("1"))} else {residual("a.m / x.size", "0")} end
        else
          case when w.gets then {state("a.m", "a.size - x.size", "a.rest", "a.whole", settled("0"))} else {residual("w.p - w.lacks / x.size", "1")} end
        end"""
    start = state("items[0].p * aggregate(items, 0L, (m, x) -> m + x.size)", "aggregate(items, 0L, (m, x) -> m + x.size)", f"cast(null as {_SCHEMA})", "cast(null as int)", f"cast(array() as array<{_ITEM}>)")
    return f"""
    aggregate(
      items,
      {start},
      (a, x) -> case
        when a.rest is not null then {state("a.m", "a.size", "a.rest", "a.whole", settled("a.whole"))}
        else element_at(transform({partner}, w -> {trade}), 1) end,
      a -> named_struct('rest', a.rest, 'done', a.done))
    """


def _trades(level: int) -> str:
    """SQL of the trades of two at a time along the residuals ``items``: struct(rest, done), rest the document still fractional."""
    none = f"cast(null as {_SCHEMA})"
    gain = "least((1 - a.rest.p) * a.rest.size, x.p * x.size)"
    lose = "least(a.rest.p * a.rest.size, (1 - x.p) * x.size)"
    draw = f"pmod(xxhash64({level}, a.rest.doc_id, a.rest.n, x.doc_id, x.n, x.size), 9007199254740992) / 9007199254740992D"
    settle = "array(named_struct('p', {p}, 'size', {w}.size, 'doc_id', {w}.doc_id, 'n', {w}.n, 'one', {one}))"
    keep = "named_struct('p', {p}, 'size', {w}.size, 'doc_id', {w}.doc_id, 'n', {w}.n)"

    def result(rest: str, done: str) -> str:
        return f"named_struct('rest', {rest}, 'done', concat(a.done, {done}))"

    # r gains: it is full, or x is empty
    full = result(keep.format(p="x.p - (1 - a.rest.p) * a.rest.size / x.size", w="x"), settle.format(p="1D", w="a.rest", one=1))
    empty = result(keep.format(p="a.rest.p + x.p * x.size / a.rest.size", w="a.rest"), settle.format(p="0D", w="x", one=0))
    # r loses: it is empty, or x is full
    gone = result(keep.format(p="x.p + a.rest.p * a.rest.size / x.size", w="x"), settle.format(p="0D", w="a.rest", one=0))
    taken = result(keep.format(p="a.rest.p - (1 - x.p) * x.size / a.rest.size", w="a.rest"), settle.format(p="1D", w="x", one=1))
    return f"""
    aggregate(
      items,
      named_struct('rest', {none}, 'done', cast(array() as array<{_ITEM}>)),
      (a, x) -> case
        when a.rest is null then named_struct('rest', {keep.format(p="x.p", w="x")}, 'done', a.done)
        when {draw} * ({gain} + {lose}) < {lose} then
          case when (1 - a.rest.p) * a.rest.size <= x.p * x.size then {full} else {empty} end
        else
          case when a.rest.p * a.rest.size <= (1 - x.p) * x.size then {gone} else {taken} end
      end)
    """


def _rounded(open_: DataFrame, blocks: int) -> list[DataFrame]:
    """(source, doc_id, n, size, one) of rows (source, lone, block, item) in one frame for each level of the tree."""
    out, level = [], 0
    while True:
        grouped = open_.groupBy("source", "lone", "block").agg(F.array_sort(F.collect_list("item"), lambda a, b: _largest_first(a, b)).alias("items"))
        traded = stored(grouped.select("source", "lone", "block", F.expr(_trades(level) if level else _block_trades()).alias("t")), "trades")
        done = traded.select("source", F.explode("t.done").alias("d"))
        out.append(done.select("source", "d.doc_id", "d.n", "d.size", "d.one"))
        rest = traded.where("t.rest is not null")
        if blocks <= 1:
            return [*out, rest.select("source", "t.rest.doc_id", "t.rest.n", "t.rest.size", (F.col("t.rest.p") >= 0.5).cast("int").alias("one"))]
        blocks = -(-blocks // BLOCK)
        open_ = rest.select("source", "lone", F.expr(f"block div {BLOCK}").alias("block"), F.col("t.rest").alias("item"))
        level += 1


def _largest_first(a: F.Column, b: F.Column) -> F.Column:
    def by(name: str, up: bool) -> F.Column:
        x, y = (a[name], b[name]) if up else (b[name], a[name])
        return F.when(x.isNull() & y.isNotNull(), -1).when(y.isNull() & x.isNotNull(), 1).when(x < y, -1).when(x > y, 1)

    return F.coalesce(by("size", False), by("doc_id", True), by("n", True), F.lit(0))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every row of docs.

    taken is a whole number of copies times the row's words: at least the whole
    part of target / source_size copies and at most one more, never above
    ``MOST``.
    """
    sizes = stored(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"),
            F.col(source_col).alias("source"),
            F.coalesce(F.regexp_count(F.col(text_col), F.lit(TOKENS)), F.lit(0)).cast("long").alias("size"),
        ),
        "sizes",
    )
    targets = stored(source_targets(sizes), "targets").select(F.col("source").alias("named"), "source_size", "rows", "target")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    # n tells repeated rows apart, and deals rows without an id
    known = sizes.groupBy("source", "doc_id", "size").agg(F.count(F.lit(1)).alias("repeats"))
    known = known.withColumn("n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("repeats")))).drop("repeats")
    rated = known.join(targets, F.col("source").eqNullSafe(F.col("named"))).drop("named")
    rated = rated.withColumn("base", F.floor(rate)).withColumn("p", rate - F.floor(rate))
    rated = stored(rated, "rated")
    most = targets.agg(F.max("rows")).first()[0] or 0
    blocks = max(1, -(-most // BLOCK))
    block = F.pmod(F.xxhash64(F.lit(7), "doc_id", "n", "size"), F.greatest(F.lit(1), F.ceil(F.col("rows") / BLOCK)).cast("long"))
    lone = (F.col("rows") <= BLOCK).alias("lone")
    open_ = rated.where("p > 0 and size > 0").select("source", lone, block.alias("block"), F.struct("p", "size", "doc_id", "n").alias("item"))
    columns = ["doc_id", "size", "source_size", "target"]
    whole = rated.where("p = 0 or size = 0").select(*columns, (F.col("base") * F.col("size")).cast("long").alias("taken"))
    rounded = None
    for part in _rounded(open_, blocks):
        rounded = part if rounded is None else rounded.unionByName(part)
    rounded = rounded.join(targets, F.col("source").eqNullSafe(F.col("named"))).select(
        *columns, ((F.floor(F.col("target") / F.col("source_size")) + F.col("one")) * F.col("size")).cast("long").alias("taken")
    )
    return whole.unionByName(rounded)
