"""Toxicity scores: a learned lexicon, misspellings by Levenshtein automata, context windows.

Lexicon.  From a bounded sample of labelled rows that aren't held out
(``SAMPLE`` of them, by a hash of their id) the words are taken whose share of
toxic documents is far above that of the others, and so are stems that begin
several such words (inflected or compounded forms); a word counts by the different
words it stands next to, so that one copied text can't put its rare words in.

Misspellings.  The lexicon, stems included, is a trie.  Each distinct word of a
task that is long enough becomes a Levenshtein automaton, simulated on bit
vectors, which is intersected with the trie: the walk follows only branches on
which the automaton is alive.  A stem is found where the automaton has read it
with any part of the word left over.  Near spellings that are words of the
sample's clean documents are no match.

Context.  Each match is scored in a window of words around it: quotation marks
and verbs of saying take from it, words that address someone add to it.  The
weights of matches (a misspelled one counts as MISSPELLED of an exact one), of
quoted and of directed ones come from a logistic regression on the same sample; nothing but the text enters a score.

Defined results: a null text is empty; texts without a match, empty ones among
them, all get the same low score; labels that are null or have no document are
left out; without labels of both kinds every score is the share of label 1, or
0; repeated rows get equal scores; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frametally.llm import bytekernels as bk
from frametally.llm.decontaminate import words
from frametally.llm.quality import remainder
from frametally.llm.shared import stored

#: Labelled rows that a fit uses at most.
SAMPLE = 8000
#: Terms of a lexicon at most.
TERMS = 64
#: Words on either side of a match that its context score looks at.
WINDOW = 4
#: Worth of a misspelled match.
MISSPELLED = 0.8
#: A near spelling may stand in this share of the clean documents.
SPELLINGS = 0.001
#: Shortest term, and the lengths of stems.
SHORTEST = 4
STEMS = (5, 6, 7)
#: A stem begins at least this many different words.
FORMS = 4

# Context words.
SAYING = frozenset(b"said says say saying called calls word words term quote quoted quotes wrote writes dijo dice disait dit sagte sagt schrieb mot palabra wort".split())
ADDRESSING = frozenset(b"you your yours yourself youre u ur du dich dein ihr tu te toi vous usted tus eres".split())
_QUOTE = ("\"", "“", "”", "„", "«", "»", "‘", "’", "'", "`")
FEATURES = ("matches", "words", "quoted", "directed", "share", "terms", "stems", "stem_share")
_memo: dict[tuple, dict[bytes, tuple[int, int]]] = {}
_starts: dict[tuple, dict[bytes, bool]] = {}


class Trie:
    """A lexicon as a trie: children by byte; a node's term is its index, or -1.

    Terms from index ``whole`` on are stems, found at the start of a word;
    ``limits`` are the edits that each term allows.
    """

    def __init__(self, terms: list[bytes], whole: int | None = None, limits: list[int] | None = None):
        self.whole, self.limits = len(terms) if whole is None else whole, limits
        self.children: list[dict[int, int]] = [{}]
        self.term = [-1]
        for i, t in enumerate(terms):
            at = 0
            for c in t:
                if c not in self.children[at]:
                    self.children[at][c] = len(self.children)
                    self.children.append({})
                    self.term.append(-1)
                at = self.children[at][c]
            self.term[at] = i

    def within(self, word: bytes, most: int) -> tuple[int, int]:
        """(term, distance) of the nearest term within ``most`` edits of word, (-1, most + 1) if there is none.

        The automaton of the word: bit i of ``state[e]`` is set when the letters
        read so far match the word's first i letters with e edits.
        """
        accept = 1 << len(word)
        mask: dict[int, int] = {}
        for i, c in enumerate(word):
            mask[c] = mask.get(c, 0) | 1 << i
        full = (accept << 1) - 1
        first = [(1 << (e + 1)) - 1 & full for e in range(most + 1)]  # e letters of the word skipped
        best = (-1, most + 1)
        stack = [(0, first)]
        while stack:
            node, state = stack.pop()
            if self.term[node] >= 0:
                end = accept if self.term[node] < self.whole else full
                for e in range(min(most if self.limits is None else min(most, self.limits[self.term[node]]), best[1] - 1) + 1):
                    if state[e] & end:
                        best = (self.term[node], e)
                        break
            for c, child in self.children[node].items():
                m = mask.get(c, 0)
                new = [(state[0] & m) << 1]
                for e in range(1, most + 1):
                    new.append(((state[e] & m) << 1 | state[e - 1] | state[e - 1] << 1 | new[e - 1] << 1) & full)
                if new[most]:
                    stack.append((child, new))
        return best


@dataclass(frozen=True)
class Lexicon:
    """Whole words, and stems that begin words."""

    terms: tuple[bytes, ...]
    stems: tuple[bytes, ...] = ()
    #: Near spellings that aren't matched.
    clean: frozenset[bytes] = frozenset()

    def edits(self, n: int) -> int:
        return 0 if n < SHORTEST else 1 if n < 8 else 2


def deletions(word: bytes, most: int) -> set[bytes]:
    """The word with up to ``most`` of its bytes left out: two words within that many edits have one in common."""
    out = new = {word}
    for _ in range(most):
        new = {w[:i] + w[i + 1 :] for w in new for i in range(len(w))}
        out = out | new
    return out


class Matcher:
    """Finds the lexicon's terms, exact or misspelled, among the words of a chunk."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon
        # a word that is a term of its own comes before a stem of the same letters
        spelt = [*lexicon.terms, *(t for t in lexicon.stems if t not in lexicon.terms)]
        self.whole = len(lexicon.terms)
        self.trie = Trie(spelt, self.whole, [lexicon.edits(len(t)) for t in spelt])
        self.shortest = min((len(t) - lexicon.edits(len(t)) for t in spelt), default=1)
        self.memo = _memo.setdefault((lexicon.terms, lexicon.stems), {})
        # by the length of a word: how many bytes to leave out of it, or of its prefixes, to meet a term's or stem's spelling;
        # a swap of neighbours is met by leaving out one
        most = [max(1, lexicon.edits(len(t))) for t in spelt]
        self.spellings = set().union(*(deletions(t, n) for t, n in zip(spelt, most)))
        self.depth: dict[int, int] = {}
        for t, n in zip(lexicon.terms, most):
            for size in range(len(t) - n, len(t) + n + 1):
                self.depth[size] = max(n, self.depth.get(size, 0))
        self.prefixes: dict[int, int] = {}
        for t, n in zip(spelt[self.whole :], most[self.whole :]):
            for size in range(len(t) - n, len(t) + n + 1):
                self.prefixes[size] = max(n, self.prefixes.get(size, 0))
        self.longest = max(self.prefixes, default=0)
        self.starts = _starts.setdefault((lexicon.terms, lexicon.stems), {})

    def may_match(self, word: bytes) -> bool:
        """False only for words that no term or stem is near: complete for the edits that :meth:`nearest` allows."""
        n = self.depth.get(len(word))
        if n is not None and not self.spellings.isdisjoint(deletions(word, n)):
            return True
        # words of one beginning are told apart by no stem
        start = word[: self.longest]
        found = self.starts.get(start)
        if found is None:
            if len(self.starts) > 500_000:
                self.starts.clear()
            found = self.starts[start] = any(size <= len(start) and not self.spellings.isdisjoint(deletions(start[:size], n)) for size, n in self.prefixes.items())
        return found

    def nearest(self, word: bytes) -> tuple[int, int]:
        """(term, edits) of the nearest term, or (-1, _); two neighbouring letters swapped are one edit, too."""
        got = self.trie.within(word, 2)
        if got[0] >= 0:
            return got
        for i in range(len(word) - 1):
            turned = self.trie.within(word[:i] + word[i + 1 : i + 2] + word[i : i + 1] + word[i + 2 :], 0)
            if turned[0] >= 0:
                return turned[0], 1
        return got

    def find(self, low: np.ndarray, h: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word, term, edits) of every match, by rising word; terms from ``whole`` on are stems."""
        long = np.flatnonzero(ends - starts >= self.shortest)
        _, one, which = np.unique(h[long], return_index=True, return_inverse=True)
        flat = low.tobytes()
        memo, term, edits = self.memo, np.full(len(one), -1), np.zeros(len(one), np.int64)
        if len(memo) > 500_000:
            memo.clear()
        for i, (a, b) in enumerate(zip(starts[long[one]].tolist(), ends[long[one]].tolist())):
            w = flat[a:b]
            got = memo.get(w)
            if got is None:
                got = memo[w] = self.nearest(w) if self.may_match(w) else (-1, 3)
            if got[0] >= 0 and not (got[1] and w in self.lexicon.clean):
                term[i], edits[i] = got
        found = np.flatnonzero(term[which] >= 0)
        return long[found], term[which[found]], edits[which[found]]

    def features(self, texts: pa.Array) -> np.ndarray:
        out = np.zeros((len(texts), len(FEATURES)))
        for a, _, buf, offsets in bk.text_chunks(texts):
            low = bk.LOWER[buf]
            h, starts, ends, first = bk.word_hashes(low, offsets, bk.WORD, lower=False)
            word, term, edits = self.find(low, h, starts, ends)
            owner = np.searchsorted(first, word, side="right") - 1
            flat = low.tobytes()
            seen: dict[int, set[int]] = {}
            stem = np.zeros(len(first) - 1)
            for w, t, e, o in zip(word.tolist(), term.tolist(), edits.tolist(), owner.tolist()):
                lo, hi = max(w - WINDOW, int(first[o])), min(w + WINDOW + 1, int(first[o + 1]))
                near = {flat[starts[i] : ends[i]] for i in range(lo, hi) if i != w}
                before, after = flat[starts[lo] : starts[w]].decode("utf-8", "replace"), flat[ends[w] : ends[hi - 1]].decode("utf-8", "replace")
                if w == hi - 1:  # a mark after the text's last word
                    after = flat[ends[w] : min(ends[w] + 4, int(offsets[o + 1]))].decode("utf-8", "ignore")
                if lo == w:
                    before = flat[max(starts[w] - 4, int(offsets[o])) : starts[w]].decode("utf-8", "ignore")
                quoted = any(q in before for q in _QUOTE) and any(q in after for q in _QUOTE) or not near.isdisjoint(SAYING)
                row = out[a + o]
                worth = 1 if e == 0 else MISSPELLED
                row[0] += worth
                if t >= self.whole:
                    stem[o] += worth
                row[2] += quoted
                row[3] += not near.isdisjoint(ADDRESSING)
                seen.setdefault(o, set()).add(t)
            n = np.maximum(np.diff(first), 1)
            rows = slice(a, a + len(n))
            out[rows, 6] = np.log1p(stem)
            out[rows, 7] = np.sqrt(stem / n)
            out[rows, 1] = n
            out[rows, 4] = np.sqrt(out[rows, 0] / n)
            for o, s in seen.items():
                out[a + o, 5] = np.log1p(len(s))
        out[:, :4] = np.log1p(out[:, :4])
        return out


@dataclass(frozen=True)
class Model:
    lexicon: Lexicon
    weights: tuple[float, ...]  # the last is the constant

    def scores(self, texts: pa.Array) -> np.ndarray:
        x = Matcher(self.lexicon).features(texts)
        return _logistic(x @ np.array(self.weights[:-1]) + self.weights[-1])


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def regression(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Weights of a ridge logistic regression by Newton steps; the constant, last, isn't shrunk."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    shrink = np.full(len(w), ridge)
    shrink[-1] = 1e-6
    for _ in range(rounds):
        p = _logistic(x @ w)
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(shrink), x.T @ (y - p) - shrink * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def labelled_sample(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, most: int = SAMPLE) -> DataFrame:
    """(text, label) of at most ``most`` labelled rows that aren't held out, the first by a hash of their id."""
    seen = labels.where(remainder(F.col("doc_id"), folds) != held).where("toxic in (0, 1)").select("doc_id", F.col("toxic").alias("label"))
    chosen = stored(seen.orderBy(F.xxhash64(F.lit(11), "doc_id"), "doc_id").limit(most), "chosen")
    return stored(docs.select("doc_id", "text").join(chosen, "doc_id").select("text", "label"), "sample")


def learn_lexicon(sample: DataFrame, terms: int = TERMS) -> Lexicon:
    """The words and stems that set toxic documents of the sample apart.

    Each counts by the distinct words before it, not by its occurrences.
    """
    total = {r.label: r.n for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not total.get(0) or not total.get(1):
        return Lexicon(())
    w = sample.select("label", words(F.col("text")).alias("w"))
    pairs = w.select("label", F.explode(F.expr("transform(w, (v, i) -> named_struct('w', v, 'b', if(i = 0, '', w[i - 1])))")).alias("x"))
    pairs = pairs.select("label", F.col("x.w").alias("word"), F.col("x.b").alias("before")).where(F.octet_length("word") >= SHORTEST).distinct()
    keys = F.array(F.struct(F.lit(0).alias("n"), F.col("word").alias("key")), *[F.struct(F.lit(n).alias("n"), F.substring("word", 1, n).alias("key")) for n in STEMS])
    toxic, clean = F.col("label") == 1, F.col("label") == 0
    counted = (
        pairs.withColumn("k", F.explode(F.filter(keys, lambda k: (k["n"] == 0) | (F.length("word") >= k["n"]))))
        .groupBy("k.n", "k.key")
        .agg(F.count(F.when(toxic, 1)).alias("toxic"), F.count(F.when(clean, 1)).alias("clean"), F.approx_count_distinct(F.when(toxic, F.col("word"))).alias("forms"))
    )
    odds = F.log((F.col("toxic") + 0.5) / total[1] / ((F.col("clean") + 0.5) / total[0]))
    rated = counted.where(F.col("toxic") >= max(3, round(0.02 * total[1]))).withColumn("odds", odds).where("odds > 3").where((F.col("n") == 0) | (F.col("forms") >= FORMS))
    best = rated.orderBy(F.desc(F.col("toxic") * F.col("odds")), "n", "key").limit(8 * terms).collect()
    stems: list[bytes] = []
    for key in (r.key.encode() for r in best if r.n):
        if len(stems) < terms and not any(key.startswith(s) or s.startswith(key) for s in stems):
            stems.append(key)
    whole = [k for k in (r.key.encode() for r in best if not r.n) if not k.startswith(tuple(stems))]
    return Lexicon(tuple(sorted(whole[:terms])), tuple(sorted(stems)))


def spellings(lexicon: Lexicon, sample: DataFrame) -> Lexicon:
    """The lexicon with those near spellings of its terms that stand in clean documents."""

    @F.arrow_udf("array<binary>")
    def near(texts: pa.Array) -> pa.Array:
        matcher, out = Matcher(lexicon), [set() for _ in range(len(texts))]
        for a, _, buf, offsets in bk.text_chunks(texts):
            low = bk.LOWER[buf]
            h, starts, ends, first = bk.word_hashes(low, offsets, bk.WORD, lower=False)
            word, term, edits = matcher.find(low, h, starts, ends)
            flat = low.tobytes()
            for o, i in zip((np.searchsorted(first, word[edits > 0], side="right") - 1).tolist(), word[edits > 0].tolist()):
                out[a + o].add(flat[starts[i] : ends[i]])
        return pa.array([sorted(x) for x in out], pa.list_(pa.binary()))

    clean = sample.where("label = 0")
    most = max(1, SPELLINGS * clean.count())
    common = clean.select(F.explode(near(F.col("text"))).alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).collect()
    return Lexicon(lexicon.terms, lexicon.stems, frozenset(bytes(r.t) for r in common))


def features(lexicon: Lexicon, text: Column) -> Column:
    @F.arrow_udf("array<double>")
    def found(texts: pa.Array) -> pa.Array:
        x = Matcher(lexicon).features(texts)
        return pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), x.ravel())

    return found(text)


def train(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, most: int = SAMPLE) -> Model:
    sample = labelled_sample(docs, labels, folds, held, most)
    lexicon = spellings(learn_lexicon(sample), sample)
    rows = sample.select("label", features(lexicon, F.col("text")).alias("x")).orderBy("x", "label").collect()  # SAMPLE rows at most
    y = np.array([r.label for r in rows], dtype=float)
    if not len(rows) or y.min() == y.max():
        p = min(max(float(y.mean()) if len(rows) else 0.0, 1e-6), 1 - 1e-6)
        return Model(Lexicon(()), (*[0.0] * len(FEATURES), float(np.log(p / (1 - p)))))
    return Model(lexicon, tuple(regression(np.array([r.x for r in rows]), y).tolist()))


def score(model: Model, text: Column) -> Column:
    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        return pa.array(model.scores(texts))

    return scored(text)


def classify(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of docs."""
    model = train(docs, labels, folds, held)
    return docs.select(
        "doc_id", (remainder(F.col("doc_id"), folds) == held).alias("held_out"), score(model, F.col("text")).alias("score")
    ).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
