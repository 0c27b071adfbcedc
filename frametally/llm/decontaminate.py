"""Benchmark decontamination by a distributed positional inverted index.

Every benchmark item becomes phrases of ``window`` consecutive words (an item of
fewer words is one phrase).  A first pass counts how often each benchmark term
occurs in the corpus; each phrase is then looked up by its rarest terms only.
A second pass stores the positional index: for every row the positions of those
terms, with the words around each.  The lists of a phrase's two rarest terms,
each shifted by the term's offset in the phrase, are intersected by a grouped
join; what both lists hold is compared word for word with the stored context,
so matches are exact.  Proximity matches, for reworded passages, are the lists
brought within a slack of each other where the stored context holds most of
the phrase's words.

The set of wanted terms is shipped to the tasks only while it has at most
``SHIPPED_TERMS`` members (its size is counted first); beyond that every word is
posted and the join with the phrases, a shuffle, does the selection.

Defined results: a null text has no words; an item or document without words
matches nothing; repeated rows are indexed one by one and get equal results;
items without an id hit words but aren't listed; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from frametally.llm import bytekernels as bk
from frametally.llm.shared import stored

WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SHIPPED_TERMS = 200_000
#: A phrase is looked up by this many of its terms, the rarest.
LOOKED_UP = 2


def text_hash(text: Column) -> Column:
    """Tells rows with one id, or none, apart by their text."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORDS), F.lit(0))


def phrases(items: DataFrame, window: int) -> DataFrame:
    """(item_id, phrase, size): the windows of every item."""
    w = items.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("w")).where("size(w) > 0")
    size = F.least(F.lit(window), F.size("w"))
    return w.withColumn("size", size).select(
        "item_id", F.explode(F.expr("transform(sequence(1, size(w) - size + 1), i -> array_join(slice(w, i, size), ' '))")).alias("phrase"), "size"
    )


class Terms:
    """Membership in a set of term hashes: a bitmap first, then the sorted set.  None holds every term."""

    def __init__(self, hashes: np.ndarray | None):
        self.sorted = None if hashes is None else np.unique(hashes)
        if self.sorted is not None:
            self.bits = np.zeros(1 << 16, dtype=bool)
            self.bits[self.sorted >> np.uint64(48)] = True

    def among(self, h: np.ndarray) -> np.ndarray:
        """Indices of the hashes in the set."""
        if self.sorted is None:
            return np.arange(len(h))
        if not len(self.sorted):
            return np.zeros(0, dtype=np.int64)
        maybe = np.flatnonzero(self.bits[h >> np.uint64(48)])
        at = np.searchsorted(self.sorted, h[maybe])
        at[at == len(self.sorted)] = 0
        return maybe[self.sorted[at] == h[maybe]]


def term_hash(word: Column) -> Column:
    """The hash that the index kernels give to a word."""

    @F.arrow_udf("long")
    def hashed(column: pa.Array) -> pa.Array:
        out = np.zeros(len(column), dtype=np.uint64)
        for a, b, buf, offsets in bk.text_chunks(column):
            out[a:b] = bk.range_hash(bk.prefix_sums(buf), offsets[:-1], offsets[1:])
        return pa.array(bk.signed(out))

    return hashed(word)


def _counted(batches: Iterator[pa.RecordBatch], terms: Terms) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, _, buf, offsets in bk.text_chunks(batch.column(0), 4 << 20):
            h = bk.word_hashes(buf, offsets, bk.WORD)[0]
            found, n = np.unique(h[terms.among(h)], return_counts=True)
            yield pa.record_batch([pa.array(bk.signed(found)), pa.array(n.astype(np.int64))], names=["term", "n"])


def _shipped(terms: DataFrame) -> Terms:
    """The terms (column term) as a set for the tasks, or the set of all words if they are too many."""
    few = terms.limit(SHIPPED_TERMS + 1).count() <= SHIPPED_TERMS
    return Terms(np.array([r.term for r in terms.collect()], dtype=np.int64).view(np.uint64) if few else None)


def positions(text: Column, terms: Terms, around: int) -> Column:
    """struct(n_words, hits array<struct(term, at, lead, context)>) of each text.

    ``context`` holds the word at position ``at`` with up to ``around`` words on
    either side, joined by one space; ``lead`` is the number of words before it.
    """
    hit = pa.struct([("term", pa.int64()), ("at", pa.int64()), ("lead", pa.int32()), ("context", pa.string())])
    row = pa.struct([("n_words", pa.int64()), ("hits", pa.list_(hit))])

    @F.arrow_udf("struct<n_words:long,hits:array<struct<term:long,at:long,lead:int,context:string>>>")
    def post(texts: pa.Array) -> pa.Array:
        count, many = [], []
        term, at, lead, context = [], [], [], []
        for _, _, buf, offsets in bk.text_chunks(texts):
            h, starts, ends, first = bk.word_hashes(buf, offsets, bk.WORD)
            count.append(np.diff(first))
            found = terms.among(h)
            owner = np.searchsorted(first, found, side="right") - 1
            many.append(np.bincount(owner, minlength=len(offsets) - 1))
            a, b = np.maximum(found - around, first[owner]), np.minimum(found + around + 1, first[owner + 1])
            term.append(bk.signed(h[found]))
            at.append(found - first[owner])
            lead.append((found - a).astype(np.int32))
            flat = bk.LOWER[buf].tobytes()
            for i, j in zip(a.tolist(), b.tolist()):
                context.append(b" ".join([flat[s:e] for s, e in zip(starts[i:j].tolist(), ends[i:j].tolist())]).decode("utf-8", "replace"))
        if not count:
            return pa.array([], row)
        hits = pa.StructArray.from_arrays([pa.array(np.concatenate(term)), pa.array(np.concatenate(at)), pa.array(np.concatenate(lead)), pa.array(context, pa.string())], fields=list(hit))
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.concatenate(many))]).astype(np.int32)), hits)
        return pa.StructArray.from_arrays([pa.array(np.concatenate(count).astype(np.int64)), lists], fields=list(row))

    return post(text)


def rarest_terms(found: DataFrame, docs: DataFrame, text_col: str) -> DataFrame:
    """(phrase, size, term, offset, n): the LOOKED_UP rarest terms of each distinct phrase, by count over all docs.

    Phrases with a term that no document has can't occur and are left out.
    """
    distinct = found.select("phrase", "size").distinct()
    placed = distinct.select("phrase", "size", F.posexplode(F.split("phrase", " ")).alias("offset", "word"))
    vocabulary = stored(placed.select("word").distinct().select("word", term_hash(F.col("word")).alias("term")), "terms")
    counts = docs.select(text_col).mapInArrow(partial(_counted, terms=_shipped(vocabulary)), "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    known = placed.join(vocabulary.join(counts, "term"), "word")
    by = known.groupBy("phrase", "size").agg(F.array_sort(F.collect_list(F.struct("n", "word", "offset", "term"))).alias("terms")).where("size(terms) = size")
    return by.select("phrase", "size", F.explode(F.slice("terms", 1, LOOKED_UP)).alias("t")).select("phrase", "size", "t.term", "t.offset", "t.n")


def _looked_up(docs: DataFrame, items: DataFrame, window: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, entries, phrases): entries are (row, phrase, size, offset, start, lead, context), the postings of every
    phrase's looked-up terms, each moved back by the term's offset to where the phrase would start."""
    found = stored(phrases(items, window), "phrases")
    wanted = stored(rarest_terms(found, docs, text_col), "wanted")
    terms = _shipped(wanted.select("term").distinct())
    index = stored(
        docs.select(
            F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), text_hash(F.col(text_col)).alias("text_hash"), positions(F.col(text_col), terms, window - 1).alias("p")
        ),
        "index",
    )
    postings = index.select("row", F.explode("p.hits").alias("h")).select("row", "h.term", "h.at", "h.lead", "h.context")
    entries = postings.join(wanted, "term").select(
        "row", "phrase", "size", "offset", (F.col("at") - F.col("offset")).alias("start"), "lead", "context"
    )
    return index.select("row", "doc_id", "text_hash", F.col("p.n_words").alias("n_words")), entries, found


_IN_PLACE = "start >= 0 and lead >= offset and array_join(slice(split(context, ' '), greatest(1, lead - offset + 1), size), ' ') = phrase"


def _exact(entries: DataFrame) -> DataFrame:
    """(row, phrase, size, start) where all lists of a phrase agree, of entries whose context holds it in place."""
    return (
        entries.groupBy("row", "phrase", "size", "start")
        .agg(F.count(F.lit(1)).alias("lists"))
        .where(F.col("lists") == F.least(F.lit(LOOKED_UP), F.col("size")))
        .select("row", "start", "size", "phrase")
    )


def _near(entries: DataFrame, slack: int) -> DataFrame:
    """(row, phrase) where entries of two lists differ by at most slack in their start.

    In order of start two lists that come so close have neighbours that do, so neighbours are compared, not pairs.
    """
    w = Window.partitionBy("row", "phrase").orderBy("start", "offset")
    pair = entries.select("row", "phrase", "offset", "start", F.lag("offset").over(w).alias("other"), F.lag("start").over(w).alias("before"))
    return pair.where((F.col("other") != F.col("offset")) & (F.col("start") - F.col("before") <= slack)).select("row", "phrase").distinct()


def matches(docs: DataFrame, items: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, occurrences, phrases): every row of docs (row, doc_id, text_hash, n_words), the
    exact places (row, start, size, phrase) of benchmark phrases in them, and
    the phrases (item_id, phrase, size)."""
    rows, entries, found = _looked_up(docs, items, window, id_col, text_col)
    return rows, _exact(entries.where(_IN_PLACE)), found


def near_each_other(docs: DataFrame, items: DataFrame, within: int = 20, window: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, at, distance): places where two of an item's looked-up terms stand
    within ``within`` words in any order: proximity matches, for reworded passages.

    Neighbouring positions of one row's postings are compared, not all pairs.
    """
    found = stored(phrases(items, window), "phrases")
    wanted = stored(rarest_terms(found, docs, text_col), "wanted")
    terms = _shipped(wanted.select("term").distinct())
    index = stored(docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), positions(F.col(text_col), terms, 0).alias("p")), "index")
    of_item = wanted.join(found.select("item_id", "phrase").distinct(), "phrase").select("term", "item_id").distinct()
    placed = index.select("row", "doc_id", F.explode("p.hits").alias("h")).select("row", "doc_id", "h.term", "h.at").join(of_item, "term")
    w = Window.partitionBy("row", "item_id").orderBy("at", "term")
    near = placed.withColumn("before", F.lag("at").over(w)).withColumn("other", F.lag("term").over(w))
    return near.where(F.col("other") != F.col("term")).withColumn("distance", F.col("at") - F.col("before")).where(F.col("distance") <= within).select("doc_id", "item_id", F.col("before").alias("at"), "distance")


def _items(phrases_of_rows: DataFrame, found: DataFrame, name: str) -> DataFrame:
    """(row, name): the sorted ids of the items whose phrases (row, phrase) a row has."""
    named = phrases_of_rows.join(found.where("item_id is not null").select("phrase", "item_id").distinct(), "phrase")
    return named.groupBy("row").agg(F.array_sort(F.collect_set("item_id")).alias(name))


def _listed(ids: Column) -> tuple[Column, Column]:
    """How many ids there are, and the digest of their list."""
    ids = F.coalesce(ids, F.array().cast("array<string>"))
    return F.size(ids).cast("long"), F.sha2(F.array_join(ids, ",").cast("binary"), 256)


def contamination(docs: DataFrame, items: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", slack: int | None = None) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, text_hash) of every row of docs.

    n_hit counts the words inside any occurrence of a phrase once.  With slack,
    also n_near and near_sha256 of the items with a proximity match, exact ones
    of two words and more included: the two looked-up terms of a phrase stand
    where its start by one and by the other differ by at most slack words, and
    around each, ``window - 1`` words to either side, at least four fifths of the
    phrase's different words stand.
    """
    rows, entries, found = _looked_up(docs, items, window, id_col, text_col)
    if slack is None:
        places, near = _exact(entries.where(_IN_PLACE)), None
    else:
        common = F.size(F.array_intersect(F.split("context", " "), F.split("phrase", " ")))
        like = 5 * common >= 4 * F.size(F.array_distinct(F.split("phrase", " ")))
        close = stored(entries.where(like).select("row", "phrase", "size", "offset", "start", F.expr(_IN_PLACE).alias("in_place")), "close")
        places, near = _exact(close.where("in_place")), _items(_near(close, slack), found, "near")
    places = stored(places, "places")
    w = Window.partitionBy("row").orderBy("start", "size").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("size")
    hit = (
        places.select("row", "start", "size").distinct()
        .withColumn("covered", F.coalesce(F.max(end).over(w), F.lit(0)))
        .groupBy("row")
        .agg(F.sum(F.greatest(F.lit(0), end - F.greatest("start", "covered"))).alias("n_hit"))
    )
    of = _items(places.select("row", "phrase").distinct(), found, "ids")
    n_items, listed = _listed(F.col("ids"))
    out = [
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        n_items.alias("n_items"),
        listed.alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
        "text_hash",
    ]
    joined = rows.join(hit, "row", "left").join(of, "row", "left")
    if near is None:
        return joined.select(*out)
    n_near, near_listed = _listed(F.col("near"))
    return joined.join(near, "row", "left").select(*out, n_near.alias("n_near"), near_listed.alias("near_sha256"))


#: DuckDB SQL of :func:`contamination` with a slack of 5 over ``documents`` and ``benchmark``.
SQL = """
WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item_id,
             regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
     p AS (SELECT item_id, w, least(10, len(w)) AS n FROM b WHERE len(w) > 0),
     q AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS phrase FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM p)),
     d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
     s AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS phrase
           FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM q) WHERE len(w) >= n)),
     m AS (SELECT s.doc_id, s.i, s.n, q.item_id FROM s JOIN q ON s.phrase = q.phrase AND s.n = q.n),
     h AS (SELECT doc_id, count(DISTINCT word) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS word FROM m) GROUP BY doc_id),
     t AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY doc_id),
     c AS (SELECT word, count(*) AS n FROM (SELECT unnest(w) AS word FROM d) GROUP BY word),
     k AS (SELECT phrase, n, o, string_split(phrase, ' ')[o] AS word FROM (SELECT phrase, n, unnest(range(1, n + 1)) AS o FROM (SELECT DISTINCT phrase, n FROM q))),
     r AS (SELECT phrase, o, word FROM (SELECT k.phrase, k.n, k.o, k.word, row_number() OVER (PARTITION BY k.phrase ORDER BY c.n, k.word, k.o) AS place, count(*) OVER (PARTITION BY k.phrase) AS known FROM k JOIN c ON c.word = k.word) WHERE known = n AND place <= 2),
     x AS (SELECT d.doc_id, r.phrase, r.o, l.i - r.o AS start FROM (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM d) l JOIN r ON r.word = l.word JOIN d ON d.doc_id = l.doc_id
           WHERE 5 * len(list_intersect(d.w[greatest(1, l.i - 9):l.i + 9], string_split(r.phrase, ' '))) >= 4 * len(list_distinct(string_split(r.phrase, ' ')))),
     y AS (SELECT DISTINCT x.doc_id, q.item_id FROM x JOIN x z ON z.doc_id = x.doc_id AND z.phrase = x.phrase AND z.o <> x.o AND abs(z.start - x.start) <= 5 JOIN q ON q.phrase = x.phrase),
     v AS (SELECT doc_id, count(*) AS n_near, string_agg(item_id, ',' ORDER BY item_id) AS near FROM y WHERE item_id IS NOT NULL GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated,
       CAST(coalesce(n_near, 0) AS BIGINT) AS n_near, sha256(coalesce(near, '')) AS near_sha256
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id) LEFT JOIN v USING (doc_id)
"""
