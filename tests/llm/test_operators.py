import base64
import hashlib
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from frametally.llm import decontaminate, html_text, licenses, minhash, mixing, quality, repeats, shared, simhash, suffixes, toxicity, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 97}x{i}" for i in range(20000))
HARD = [
    (1, None, "en", "a", 0),
    (2, "", "en", None, 0),
    (None, "row without id", "en", "a", 14),
    (3, "same text twice here now", "en", "b", 24),
    (3, "same text twice here now", "en", "b", 24),
    (4, "same text twice here now", None, "b", 24),
    (5, LONG, "en", "a", len(LONG)),
    (6, "\n\n  \t", "de", "c", 5),
    (7, "ünïcödé Wörds ünd ☃ snow", "de", "c", 24),
]


@pytest.fixture(scope="module")
def hard(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and columns whose names clash with the operators' own."""
    extra = {n: F.lit(9) for n in ("row", "h", "seg", "fingerprint", "component_id", "size", "target", "k1", "term", "label", "slice", "rep", "node", "key", "p", "x")}
    return spark.createDataFrame(HARD, DOCS).withColumns(extra)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def texts(spark, sf):
    return {r.doc_id: r.text or "" for r in shared.table(spark, sf, "documents").collect()}


def grams(text, k):
    w = text.encode().lower().split()
    return [b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))] if w else []


def test_components(spark):
    edges = [(1, 2), (2, 3), (5, 4), (7, 7), (9, 8), (8, 10), (10, 11), (11, 12), (12, 13), (None, 3)]
    got = {r.node: r.component for r in shared.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, **dict.fromkeys(range(8, 14), 8)}
    assert shared.components(spark.createDataFrame([], "a long, b long")).count() == 0
    path = {r.node: r.component for r in shared.components(spark.createDataFrame([(i, i + 1) for i in range(100)], "a long, b long")).collect()}
    assert set(path.values()) == {0} and len(path) == 101


# 1 ---------------------------------------------------------------------------------


def test_toxicity_on_hard_rows(spark, hard, empty):
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(8)] + [(None, None, None), (99, 1, 1)], "doc_id long, quality int, toxic int")
    got = toxicity.classify(hard, labels).collect()
    assert len(got) == len(HARD) and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in got)
    assert toxicity.classify(empty, labels).count() == 0
    none = toxicity.classify(hard, labels.limit(0)).collect()
    assert all(r.score < 0.01 for r in none)


def test_toxicity_learns_words_spellings_and_quotes(spark):
    plain = "the river runs by old mills and slow boats drift past willow banks today"
    bad = ["blorgo", "snerkle", "wuzzleton"]
    w = plain.split()
    rows = []
    for i in range(300):
        words = w[i % 13 :] + w[: i % 13]
        toxic = i % 3 == 0
        if toxic:
            words[i % 7 : i % 7] = [bad[i // 3 % 3]]
        rows.append((i, " ".join(words), int(toxic)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], 1, r[2]) for r in rows], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, labels)
    assert set(model.lexicon.terms) == {b.encode() for b in bad}
    tries = [plain, "the river blorgo runs", "the river blrgo runs by", "old wuzleton mills", "slow boats drift", 'he said "blorgo" to me', "", None]
    score = [r.s for r in spark.createDataFrame(list(enumerate(tries)), "i int, t string").select("i", toxicity.score(model, F.col("t")).alias("s")).orderBy("i").collect()]
    assert score[1] > 0.5 and min(score[2], score[3]) > 0.4 and max(score[0], score[4], score[6], score[7]) < 0.1


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = toxicity.classify(shared.table(spark, sf, "documents"), shared.table(spark, sf, "labels")).join(shared.table(spark, sf, "labels"), "doc_id")
    rows = got.where("held_out").select("toxic", "predicted").collect()
    assert sum(r.toxic == r.predicted for r in rows) >= 0.93 * len(rows)


# 2 ---------------------------------------------------------------------------------


def test_minhash_neighbours_by_brute_force(spark, sf):
    docs = sorted(texts(spark, sf).items())
    got = {r.doc_id: r for r in minhash.edited_neighbours(shared.table(spark, sf, "documents")).collect()}
    assert len(got) == len(docs)
    for i, (k, t) in enumerate(docs):
        after = docs[(i + 1) % len(docs)][1]
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        g = got[k]
        assert (g.n_chars, g.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        a, b = set(grams(t, 5)), set(grams(edited, 5))
        assert abs(g.near_edited - len(a & b) / max(1, len(a | b))) < 0.25


def test_minhash_on_hard_rows(spark, hard, empty):
    got = minhash.edited_neighbours(hard).collect()
    assert len(got) == len(HARD)
    by = defaultdict(set)
    for r in got:
        by[r.doc_id].add(r.fingerprint)
    assert by[3] == by[4] and by[1] == by[2] == by[6] == {""}
    assert minhash.edited_neighbours(empty).count() == 0
    one = minhash.edited_neighbours(hard.where("doc_id = 5")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0


def test_minhash_classes_by_brute_force(spark, sf):
    docs = texts(spark, sf)
    sets = {k: frozenset(grams(t, 5)) for k, t in docs.items()}
    part = {k: k for k in docs}

    def root(k):
        while part[k] != k:
            k = part[k]
        return k

    ids = sorted(docs)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            s, t = sets[a], sets[b]
            if docs[a] == docs[b] or s and t and len(s & t) >= 0.8 * len(s | t):
                x, y = sorted((root(a), root(b)))
                part[y] = x
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(shared.table(spark, sf, "documents")).collect()}
    assert got == {k: root(k) for k in docs}


# 3 ---------------------------------------------------------------------------------


def removed(docs, n):
    seen = Counter(t[i : i + n] for t in docs for i in range(len(t) - n + 1))
    out = []
    for t in docs:
        gone = bytearray(len(t))
        for i in range(len(t) - n + 1):
            if seen[t[i : i + n]] > 1:
                gone[i : i + n] = b"\1" * n
        out.append((bytes(b for b, g in zip(t, gone) if not g), sum(gone[i] and not (i and gone[i - 1]) for i in range(len(t)))))
    return out


@pytest.mark.parametrize("most", [256, 1, 0])
def test_repeats_by_brute_force(spark, sf, monkeypatch, most):
    monkeypatch.setattr(repeats, "HOT", most)
    docs = texts(spark, sf)
    got = {r.doc_id: r for r in repeats.without_repeats(shared.table(spark, sf, "documents")).select("doc_id", "kept.*").collect()}
    for (k, t), (rest, n) in zip(docs.items(), removed([t.encode() for t in docs.values()], repeats.LENGTH)):
        g = got[k]
        assert (g.n_bytes, g.n_removed, g.n_spans, g.sha256) == (len(t.encode()), len(t.encode()) - len(rest), n, hashlib.sha256(rest).hexdigest())


def test_passages_by_brute_force(spark, sf, hard):
    docs = texts(spark, sf)
    got = {r.doc_id: r for r in repeats.measured(shared.table(spark, sf, "documents")).collect()}
    raw = [t.encode() for t in docs.values()]
    for (k, t), (rest, n), (long_rest, _) in zip(docs.items(), removed(raw, repeats.PASSAGE), removed(raw, repeats.LENGTH)):
        g = got[k]
        assert (g.n_passages, g.passage_bytes, g.n_removed, g.kept_sha256) == (n, len(t.encode()) - len(rest), len(t.encode()) - len(long_rest), hashlib.sha256(long_rest).hexdigest())
    assert repeats.measured(hard).count() == len(HARD)


def test_large_shards_are_sorted_by_queues_on_disk(spark, monkeypatch):
    """One anchor in 300 texts: its shard is larger than the queues' memory."""
    found, old = [], suffixes.DiskQueues._spill
    monkeypatch.setattr(suffixes.DiskQueues, "_spill", lambda self, symbol: (found.append(symbol), old(self, symbol))[1])
    passage = "one passage that stands in every text, " * 20
    shard = [f"{'left ' * 90}{i}{passage}{i}{'right ' * 90}".encode() for i in range(300)]
    batch = pa.record_batch([pa.array([1] * 300), pa.array([{"x": i, "y": 0} for i in range(300)]), pa.array(shard)], names=["h", "seg", "bytes"])
    monkeypatch.setattr(repeats, "MEMORY", 1 << 18)
    hits = [r for out in repeats._sorted_shards(iter([batch]), repeats.LENGTH) for r in out.to_pylist()]
    assert len(hits) == 300 and found
    want = removed(shard, repeats.LENGTH)
    for r, t, (rest, _) in zip(sorted(hits, key=lambda r: r["seg"]["x"]), shard, want):
        assert len({i for b in r["hits"] for i in range(b["a"], b["b"] + repeats.LENGTH)}) == len(t) - len(rest)


def test_repeats_on_hard_rows(spark, hard, empty):
    got = repeats.without_repeats(hard, length=16, k=8).select("doc_id", "text", "kept.*", "seg", "row").collect()
    assert len(got) == len(HARD)
    want = Counter((len((t or "").encode()), hashlib.sha256(rest).hexdigest(), n) for (_, t, *_), (rest, n) in zip(HARD, removed([(h[1] or "").encode() for h in HARD], 16)))
    assert Counter((r.n_bytes, r.sha256, r.n_spans) for r in got) == want
    assert repeats.without_repeats(empty).count() == 0


# 4 ---------------------------------------------------------------------------------


def test_decontamination_by_brute_force(spark):
    bench = [(1, "A b c d e f g h i j k l"), (2, "short item"), (3, None), (4, ""), (5, "the the the the the the the the the the the"), (None, "x1 x2 x3"), (2, "other short"), (12, "short item")]
    docs = [
        (1, "zz a B c d e f g h i j zz"), (2, "Short item, short ITEM"), (3, None), (4, ""), (5, "the " * 30), (6, "x1 x2 x3"), (7, "a b c d e f g h i"),
        (8, "short"), (9, "A b c d e f g h i j k l m short item other short"), (9, "A b c d e f g h i j k l m short item other short"), (None, "short item"),
    ]
    items = spark.createDataFrame(bench, "item_id long, text string")
    got = decontaminate.contamination(spark.createDataFrame(docs, "doc_id long, text string").withColumn("term", F.lit(1)), items).collect()
    assert len(got) == len(docs)
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = []
    for i, t in bench:
        w = pattern.findall((t or "").lower())
        n = min(10, len(w))
        windows += [(i, w[a : a + n]) for a in range(len(w) - n + 1) if n]
    want = []
    for d, t in docs:
        w = pattern.findall((t or "").lower())
        hit, ids = set(), set()
        for i, p in windows:
            for a in range(len(w) - len(p) + 1):
                if w[a : a + len(p)] == p:
                    hit |= set(range(a, a + len(p)))
                    ids |= {str(i)} if i is not None else set()
        want.append((d, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    assert Counter(tuple(r)[:6] for r in got) == Counter(want)


def test_decontamination_without_items_or_documents(spark, hard, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    assert not any(r.contaminated for r in decontaminate.contamination(hard, none).collect())
    assert decontaminate.contamination(empty, spark.createDataFrame([(1, "a b")], "item_id long, text string")).count() == 0


def test_terms_too_many_to_ship_are_all_posted(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "SHIPPED_TERMS", 1)
    docs = spark.createDataFrame([(1, "one two three four"), (2, "two one")], "doc_id long, text string")
    got = decontaminate.contamination(docs, spark.createDataFrame([(7, "two three")], "item_id long, text string")).collect()
    assert {r.doc_id: r.n_hit for r in got} == {1: 2, 2: 0}


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "alpha x x beta"), (2, "alpha " + "x " * 40 + "beta")], "doc_id long, text string")
    got = decontaminate.near_each_other(docs, spark.createDataFrame([(7, "alpha beta")], "item_id long, text string")).collect()
    assert [(r.doc_id, r.item_id, r.distance) for r in got] == [(1, "7", 3)]


# 5 ---------------------------------------------------------------------------------


def shares(sizes):
    """Targets by filling until none is above its cap, over sources in order."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(order)}
    left, open_, out = float(sum(sizes.values())), set(order), {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > 3 * sizes[s]]
        if not over:
            return out | {s: left * weight[s] / total for s in open_}
        for s in over:
            out[s] = 3.0 * sizes[s]
        left -= sum(out[s] for s in over)
        open_ -= set(over)
    return out


def test_mixing(spark):
    docs = shared.table(spark, "/root/testdata/sf0.01", "documents")
    got = mixing.mix(docs)
    source = {r.doc_id: (r.source, len((r.text or "").split())) for r in docs.collect()}
    rows = got.collect()
    sizes = Counter()
    for s, n in source.values():
        sizes[s] += n
    want = shares(sizes)
    taken = Counter()
    for r in rows:
        s, _ = source[r.doc_id]
        assert r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6 * want[s] + 1e-9
        assert r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        taken[s] += r.taken
    largest = Counter()
    for s, n in source.values():
        largest[s] = max(largest[s], n)
    assert all(abs(taken[s] - want[s]) <= largest[s] / 2 + 1 for s in want)
    assert all(abs(taken[s] - want[s]) <= 0.02 * want[s] for s in want if want[s] > largest[s])
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.mix(docs.repartition(3)).collect()))


def test_mixing_targets_stop_at_caps(spark):
    sizes = {"a": 10, "b": 1000, "c": 1000, "d": 0, None: 500}
    rows = [(i, " ".join(["w"] * n), s) for i, (s, n) in enumerate(sizes.items())]
    got = {s.source: s.target for s in mixing.source_targets(spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")).collect()}
    want = shares(sizes)
    assert all(abs(got[s] - want[s]) < 1e-6 for s in sizes)
    assert mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).count() == 5


@pytest.mark.parametrize("p", [0.05, 0.4, 0.9, None])
def test_mixing_trades_favour_no_document(spark, p):
    """Over 2,000 blocks each fraction's mean is what it was, and a block's words are kept."""
    sizes = [60, 25, 9, 8, 8, 7, 5, 3, 2, 1]
    ps = [p or q for q in [0.3, 0.9, 0.1, 0.5, 0.02, 0.7, 0.4, 0.98, 0.6, 0.25]]
    rows = [(b, False, [(p, n, 100 * b + i, 1) for i, (n, p) in enumerate(zip(sizes, ps, strict=True))]) for b in range(2000)]
    blocks = spark.createDataFrame(rows, f"b long, lone boolean, items array<{mixing._SCHEMA}>")
    sums = Counter()
    for r in blocks.select(F.expr(mixing._block_trades() if p else mixing._trades(1)).alias("t")).collect():
        assert len(r.t.done) == len(sizes) - 1
        after = [(x.doc_id % 100, x.size, x.p) for x in [*r.t.done, r.t.rest]]
        assert all(x.p == x.one for x in r.t.done) and -1e-9 <= r.t.rest.p <= 1 + 1e-9
        assert abs(sum(n * p for _, n, p in after) - sum(n * p for n, p in zip(sizes, ps, strict=True))) < 1e-6
        for i, _, p_ in after:
            sums[i] += p_
    for i, q in enumerate(ps):
        assert abs(sums[i] / 2000 - q) < 4.5 * (q * (1 - q) / 2000) ** 0.5


def test_mixing_meets_targets(spark):
    """900 sources of equal sizes are 900 draws: each meets its target to half its smallest document."""
    sizes = [60, 25, 9, 8, 8, 7, 5, 3, 2, 2, 1, 1]
    rows = [(100 * s + i, " ".join(["w"] * n), f"s{s:03}") for s in range(900) for i, n in enumerate(sizes)]
    taken, target = Counter(), {}
    for r in mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect():
        taken[r.doc_id // 100] += r.taken
        target[r.doc_id // 100] = r.target
    assert len(target) == 900 and max(abs(taken[s] - target[s]) for s in target) <= 0.5 + 1e-6


def test_mixing_tree_of_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 4)
    rows = [(i, " ".join(["w"] * (1 + i * i % 37)), "ab"[i % 3 == 0]) for i in range(700)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert len(got) == 700
    for s in (0, 1):
        mine = [r for r in got if (r.doc_id % 3 == 0) == s]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 19


def test_mixing_on_hard_rows(spark, hard, empty):
    got = mixing.mix(hard).collect()
    assert len(got) == len(HARD) and all(r.taken <= 3 * r.size for r in got)
    assert mixing.mix(empty).count() == 0


# 6 ---------------------------------------------------------------------------------

PAGE = """<html><head><title>no</title><style>p{}</style></head><body><header class=top>Site</header><nav><a href="/x">Menu</a></nav>%s
<div class="content"><h2>T &amp; x</h2><p>One
 <b>two</b><br>three<p>four <i>five</i>.</div><div class="cookie-notice">Cookies</div><form><p>mail</form><aside>side</aside>
<div id="comments"><p>hi</p></div><script>var t="<p>x</p>";</script><!-- <p>c</p> --><footer>f</footer></body></html>"""


def test_main_text():
    assert html_text.main_text(PAGE % "") == "T & x\n\nOne two three\n\nfour five."
    assert html_text.main_text("<article><header><h1>A</h1><p>by</p></header><p>b<div class=ad>buy</div></article><p>out") == "A\n\nb"
    assert html_text.main_text("plain &lt;text&gt; &#x41;&copy") == "plain <text> A\N{COPYRIGHT SIGN}"
    assert html_text.main_text("") == html_text.main_text("<") .replace("<", "") == ""
    assert html_text.main_text("<ul><li>a<li>b</ul><p>c") == "a\n\nb\n\nc"
    deep = "<div>" * 5000 + "x" + "</div>" * 5000
    assert html_text.main_text(deep) == "x"


def test_templates_go_where_they_recur(spark):
    box = "<div class='intro'><p>Welcome to the site</p></div>"
    rows = [(i, f"http://a.example/{i}", PAGE % box + f"<p>page {i}</p>") for i in range(12)] + [(99, "http://b.example/", PAGE % box), (100, None, None), (101, "x", "")]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("hash", F.lit(1))).collect()}
    assert len(got) == 15 and got[100] == got[101] == ""
    assert "Welcome" in got[99] and not any("Welcome" in got[i] for i in range(12))
    assert all(got[i].endswith(f"page {i}") for i in range(12))


def test_menus_of_other_items_are_template(spark):
    """Lists of links in plain divs, as many on each page as it has, go; what differs otherwise stays."""
    rows = []
    for i in range(12):
        menu = "".join(f"<li><a href='/{i}/{j}'>item {i} {j}</a></li>" for j in range(2 + i % 3))
        rows.append((i, f"http://m.example/{i}", f"<div><ul>{menu}</ul></div><div>own text {i}<p>and <a href='/x'>a link {i}</a> in it {i}</div>"))
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in got} == {i: f"own text {i}\n\nand a link {i} in it {i}" for i in range(12)}


def test_pages_on_hard_rows(spark):
    kind = "page_id long, url string, html string"
    rows = [(1, None, None), (2, "", ""), (None, "u", "<p>no id"), (3, "u", "<p>twice"), (3, "u", "<p>twice"), (4, "u", "<p>" + LONG), (5, "http://[", "<" * 300 + "</p" * 300)]
    extra = spark.createDataFrame(rows, kind).withColumns({n: F.lit(9) for n in ("hash", "host", "k1", "k2", "hashes", "template", "text", "n_chars")})
    got = html_text.extract(extra).collect()
    assert len(got) == len(rows) and {r.page_id: r.text for r in got if r.page_id != 5} == {1: "", 2: "", None: "no id", 3: "twice", 4: LONG}
    assert html_text.extract(spark.createDataFrame([], kind)).count() == 0


def test_sentences_shared_by_articles_stay(spark):
    rows = [(i, "http://a.example/", f"<article><p>The same line.</p><p>{i}</p></article>") for i in range(20)]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert all(r.text == f"The same line.\n\n{r.page_id}" and r.n_chars == len(r.text) for r in got)


# 7 ---------------------------------------------------------------------------------


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = quality.classify(shared.table(spark, sf, "documents"), shared.table(spark, sf, "labels")).join(shared.table(spark, sf, "labels"), "doc_id")
    rows = got.where("held_out").select("quality", "predicted").collect()
    assert sum(r.quality == r.predicted for r in rows) >= 0.95 * len(rows)


def test_quality_on_hard_rows(spark, hard, empty):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(8)] + [(None, None, None)], "doc_id long, quality int, toxic int")
    got = quality.classify(hard, labels).collect()
    assert len(got) == len(HARD) and all(0 <= r.score <= 1 for r in got)
    assert quality.classify(empty, labels).count() == 0
    assert all(r.score == 1.0 for r in quality.classify(hard, labels.limit(0)).collect())


# 8 ---------------------------------------------------------------------------------


def test_license_places_by_brute_force(spark, hard):
    rows = [
        (1, "under the MIT License and the mit-license"), (2, "GNU General Public License gnu general public licence"), (3, "cc by cc-by 4.0 cc_by"), (4, None), (5, ""),
        (6, "Apache Apache License"), (7, "the software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability"),
        (8, "mit"), (8, "license"),
    ]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string").withColumn("label", F.lit(1))).collect()
    by = {(r.doc_id, r.n_words): r for r in got}
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    for d, t in rows:
        w = pattern.findall((t or "").lower())
        found = [(i, label) for label, p in licenses.BASE for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        g = by[d, len(w)]
        assert (g.n_base, g.base_labels) == (len(found), ",".join(sorted({x for _, x in found})))
        assert (g.first_word, g.last_word) == ((min(found)[0], max(i for i, _ in found)) if found else (None, None))
        assert 0 <= g.score <= 1
    assert next(r for r in got if r.doc_id == 7).labels == "warranty"
    assert licenses.scan(hard).count() == len(HARD)


def test_torn_notices_are_one_span(spark):
    text = dict((k, v) for k, v in licenses.NOTICES if k == "isc")["isc"].split()
    torn = " ".join(text[:9] + ["very"] + text[9:18] + text[19:])
    got = licenses.scan(spark.createDataFrame([(1, "x y " + torn)], "doc_id long, text string")).first()
    assert got.labels == "isc" and got.score > 0.7


# 9 ---------------------------------------------------------------------------------


@pytest.mark.parametrize("segment,least", [(64, 0), (32768, 0), (500, 10)])
def test_warc_round_trip(spark, sf, segment, least):
    pages = shared.table(spark, sf, "pages").limit(20)
    extra = spark.createDataFrame([(900, None, None), (901, "x y\r\n", ""), (902, "u", "dup"), (903, "u", "dup"), (904, "u", "WARC/1.1\r\n\r\n\r\nWARC/1.1"), (None, "v", "z")], pages.schema)
    both = pages.unionByName(extra).withColumn("record", F.lit(1))
    rows = [(r.page_id, (r.html or "").encode()) for r in both.collect()]
    first = {}
    for i, h in rows:
        if i is not None:
            first[h] = min(first.get(h, i), i)
    want = Counter()
    for i, h in rows:
        other = first.get(h, i) if len(h) >= least else i
        sha = base64.b32encode(hashlib.sha1(h).digest()).decode()
        want[i, len(h), sha, "response" if other == i else "revisit", None if other == i else other] += 1
    got = warc.round_trip(both, least, segment).collect()
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want
    assert all(r.valid for r in got) and (segment > 1000 or max(r.segments for r in got) > 3)


def test_warc_damage_is_reported(spark, tmp_path):
    out = b"\r\n\r\n".join([*warc.page_records(1, "u", b"a" * 500, "X", None, 0, 100)[:-1], *warc.page_records(2, "u", b"b" * 500, "X", None, 0, 100)[::2], b""])
    (tmp_path / "part-0").write_bytes(out)
    reasons = {r.record_id.split(":")[2]: r.reason for r in warc.read(spark, str(tmp_path)).collect()}
    assert reasons == {"1": "last segment missing", "2": "segment missing"}
    with pytest.raises(ValueError):
        warc.unchunked(b"5\r\nabc")
    assert warc.unchunked(warc.chunked(b"x" * 20000)) == b"x" * 20000


@pytest.mark.parametrize("old,new,reason", [
    (b"Content-Length: ", b"Content-Length: x", "content length is no number"), (b"Content-Length: ", b"Content-Length: 9", "content length differs"),
    (b"X-Payload-Length: ", b"X-Payload-Length: -", "x-payload-length is no number"), (b"WARC-Date", b"WARC-Segment-Number: 99999999999\r\nWARC-Date", "warc-segment-number is no number"),
])
def test_warc_reading_goes_on_after_damage(spark, tmp_path, old, new, reason):
    sha = [base64.b32encode(hashlib.sha1(x).digest()).decode() for x in (b"aa", b"bb", b"cc")]
    records = [warc.page_records(i, "u", x, s, None) for i, (x, s) in enumerate(zip((b"aa", b"bb", b"cc"), sha))]
    records = [r[0] for r in records]
    records[1] = records[1].replace(old, new, 1)
    (tmp_path / "part-0").write_bytes(b"no record\r\n" + b"".join(r + b"\r\n\r\n" for r in records))
    got = {r.record_id.split(":")[2]: (r.valid, r.reason) for r in warc.read(spark, str(tmp_path)).collect()}
    assert got == {"0": (True, None), "1": (False, reason), "2": (True, None)}


def test_warc_on_hard_rows(spark):
    kind = "page_id long, url string, html string"
    rows = [(1, None, None), (2, "", ""), (None, "u", "no id"), (3, "u", "twice"), (3, "u", "twice"), (4, "u", LONG)]
    extra = spark.createDataFrame(rows, kind).withColumns({n: F.lit(9) for n in ("digest", "first", "record", "block", "number")})
    assert Counter((r.page_id, r.payload_bytes) for r in warc.round_trip(extra).collect()) == Counter((i, len(h or "")) for i, _, h in rows)
    assert warc.round_trip(spark.createDataFrame([], kind)).count() == 0


# 10 --------------------------------------------------------------------------------


def test_simhash_components_by_brute_force(spark, sf):
    docs = texts(spark, sf)
    got = {r.doc_id: r for r in simhash.near_duplicates(shared.table(spark, sf, "documents"), k=3).collect()}
    prints = {k: r.fingerprint & (1 << 64) - 1 for k, r in got.items()}
    part = {k: k for k in docs}
    ids = sorted(docs)
    changed = True
    near = [(a, b) for i, a in enumerate(ids) for b in ids[:i] if bin(prints[a] ^ prints[b]).count("1") <= 3]
    while changed:
        changed = False
        for a, b in near:
            low = min(part[a], part[b])
            if part[a] != low or part[b] != low:
                part[a] = part[b] = low
                changed = True
    assert {k: r.component_id for k, r in got.items()} == part


def test_simhash_on_hard_rows(spark, hard, empty):
    got = simhash.near_duplicates(hard, k=3).collect()
    assert len(got) == len(HARD)
    by = {(r.doc_id, r.fingerprint): r.component_id for r in got}
    assert by[1, 0] == by[2, 0] == by[6, 0] == 1 and {v for (d, _), v in by.items() if d in (3, 4)} == {3} and {v for (d, _), v in by.items() if d is None} == {None}
    assert simhash.near_duplicates(empty).count() == 0


def test_similar_by_brute_force_in_crowded_buckets(spark, sf):
    """Likeness 0.8 by the distinct shingles, also where unlike texts of one long passage stand between."""
    passage = " ".join(f"p{i}" for i in range(60))
    rows = []
    for g in range(12):
        own = [f"g{g}w{i}" for i in range(60)]
        for v in range(3):
            own[-1 - v] = f"v{g}x{v}"
            rows.append((g * 3 + v + 10**6, passage + " " + " ".join(own)))
    line = "one line that is much repeated here "
    rows += [(2 * 10**6 + i, line * 40 + " ".join(f"r{i}y{j}" for j in range(60))) for i in range(2)]
    for n in (5, 6, 8, 9):
        rows += [(3 * 10**6 + n * 10 + i, " ".join(f"s{n}z{j}" for j in range(n + 4 + i))) for i in range(2)]
    docs = texts(spark, sf) | dict(rows)
    sets = {k: frozenset(grams(t, 5)) for k, t in docs.items()}
    part = {k: k for k in docs}

    def root(k):
        while part[k] != k:
            k = part[k]
        return k

    ids = sorted(docs)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            s, t = sets[a], sets[b]
            if s == t or len(s & t) >= 0.8 * len(s | t):
                x, y = sorted((root(a), root(b)))
                part[y] = x
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in simhash.similar(frame).collect()} == {k: root(k) for k in docs}


@pytest.mark.parametrize("chunk", [4096, 7])
def test_every_pair_of_a_bucket_is_tested(spark, monkeypatch, chunk):
    """Of nodes 0 to 199 under one key those are linked whose difference is 100: others stand between."""
    monkeypatch.setattr(shared, "CHUNK", chunk)
    dealt = spark.createDataFrame([(7, i) for i in range(200)], "key long, node long")
    prints = spark.createDataFrame([(i, 0) for i in range(200)], "node long, w long")
    sets = spark.createDataFrame([(i, list(range(i % 100 * 5, i % 100 * 5 + 5))) for i in range(200)], "node long, s array<long>")
    got = shared.bucket_components(dealt, prints, lambda nodes: sets.join(nodes, "node", "left_semi"), 0.8, 3)
    assert {r.node: r.component for r in got.collect()} == {i: i % 100 for i in range(200)}


def test_copies_of_a_page_are_no_template(spark):
    rows = [(i, f"http://h.example/{i}", "<div><p>the one text of a copied page</p></div>") for i in range(8)]
    rows += [(100 + i, f"http://h.example/o{i}", f"<div><p>text number {i}</p></div>") for i in range(22)]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[0] == got[7] == "the one text of a copied page" and got[105] == "text number 5"
    page = "<div><p>all of it</p></div>"
    assert html_text.main_text(page, frozenset(html_text._candidates(page))) == "all of it"


def test_frequent_subtrees_of_large_hosts_are_template(spark):
    seen = spark.createDataFrame([("h", i, [1] if i < 12 else [i]) for i in range(100)], "host string, k2 long, hashes array<long>")
    assert [r.hash for r in html_text.templates(seen, 8, 0.25, 12).collect()] == [1]
