"""Token counts, vector codes and conversation repair against the library, SQL and brute force."""

import hashlib
import itertools
import random
import time
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from frametally.llm import bpe_transducer, conversations, html_text, quality, shared, token_counts, vector_codes, warc
from frametally.llm.queries import QUERIES

public_tokenizers = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")


# ---- token counts


@pytest.fixture(scope="module")
def machine():
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        return token_counts.compiled(f.read())


def library(texts):
    t = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [len(e.ids) for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_token_counts_of_hard_texts(machine, monkeypatch):
    rng = random.Random(5)
    letters = [*"'strevlmdaA1² \n\té漢🙂!?ß̀ͅ\x00\x1c　", "  ", "<|endoftext|>", "<|", "'re", "'ll", " '", "ÃÂ", "aaaa", "==", "\r\n"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 2, 5, 40, 300]))) for _ in range(3000)]
    texts += ["a" * n for n in range(200)] + [" " * n for n in range(150)] + ["ÃÂ" * n for n in range(80)] + [None, "x" * 5000]
    want = library(texts)
    assert token_counts.counts(machine, pa.array(texts)).tolist() == want
    # blocks and batches of other sizes, cut anywhere, and few states kept
    monkeypatch.setattr(bpe_transducer, "BLOCK", 7)
    monkeypatch.setattr(bpe_transducer, "MOST_STATES", 50)
    monkeypatch.setattr(token_counts, "BATCH", 100)
    few = list(range(0, len(texts), 11))
    machine.pieces.counts.clear()
    assert token_counts.counts(machine, pa.array([texts[i] for i in few])).tolist() == [want[i] for i in few]


def test_prefix_scan_composes_maps():
    rng = np.random.default_rng(0)
    maps = bpe_transducer.MAPS[rng.integers(0, len(bpe_transducer.MAPS), 50)]
    out, now = bpe_transducer.composed(maps), np.arange(maps.shape[1])
    for i, m in enumerate(maps):
        now = m[now]
        assert (out[i] == now).all()


def test_merges_agree_with_plain_merging(machine):
    """The pairs that may follow each other are those that merging from single bytes leaves apart."""
    p = machine.pieces

    def merged(data):
        out = [p.of_byte[b] for b in data]
        while True:
            ranked = [(p.merge[x][0], i) for i, x in enumerate(zip(out, out[1:])) if x in p.merge]
            if not ranked:
                return out
            _, i = min(ranked)
            out[i : i + 2] = [p.merge[out[i], out[i + 1]][1]]

    rng = random.Random(2)
    ids = list(p.text)
    for _ in range(3000):
        a, b = rng.choice(ids), rng.choice(ids)
        assert p._goes(-1, b) == (merged(p.text[b]) == [b])
        if p._goes(-1, a) and p._goes(-1, b):
            assert p._goes(a, b) == (merged(p.text[a] + p.text[b]) == [a, b])


def test_token_query_equals_the_library(spark, sf):
    rows = QUERIES["op12_tokens"](spark, sf).collect()
    texts = {r.doc_id: r.text for r in shared.table(spark, sf, "documents").collect()}
    want = dict(zip(texts, library(texts.values())))
    assert len(rows) == len(texts)
    assert all((r.n_bytes, r.n_tokens, r.over_limit) == (len((texts[r.doc_id] or "").encode()), want[r.doc_id], want[r.doc_id] > 1024) for r in rows)


def test_token_counts_edge_tables(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = [(None, "a b", 1, 2), (1, None, 1, 2), (1, None, 1, 2), (2, "", 1, 2), (3, " word" * 50_000, 1, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, n_bytes int")
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.counted(docs, path).collect())
    assert got == [(0, 3, 2, False), (1, 0, 0, False), (1, 0, 0, False), (2, 0, 0, False), (3, 250_000, 50_000, True)]
    assert token_counts.counted(docs.limit(0), path).count() == 0
    with pytest.raises(ValueError):
        with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
            bpe_transducer.Compiled(f.read())


# ---- vector codes


def test_annulus_finds_the_nearest():
    rng = np.random.default_rng(1)
    for width, entries, size in ((4, 64, 50), (4, 64, 2), (1, 64, 30), (4, 1, 9), (3, 200, 2**20), (4, 64, 2**26)):
        book, x = rng.integers(-size, size + 1, (entries, width)), rng.integers(-size, size + 1, (3000, width))
        entry, distance = vector_codes.nearest(x, book)
        full = ((x[:, None] - book[None]) ** 2).sum(-1)
        assert (entry == full.argmin(1)).all() and (distance == full.min(1)).all()


def _codes(spark, tmp_path, rows, name):
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, code string").write.parquet(f"{tmp_path}/{name}.parquet")
    vectors = spark.read.parquet(f"{tmp_path}/{name}.parquet")
    got = sorted(map(tuple, vector_codes.compressed(vectors).collect()), key=repr)
    c = duckdb.connect()
    c.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    return got, sorted(c.execute(vector_codes.SQL).fetchall(), key=repr)


def test_codes_equal_sql(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 0.3) for _ in range(32)], rng.choice([None, 1, 2]), "x") for i in range(120)]
    rows += [(500, None, 1, ""), (501, [float("nan")] * 32, 1, ""), (502, [None] + [0.0] * 31, 1, ""), (503, [float("inf")] * 32, 2, ""), (7, rows[7][1], None, ""), (None, rows[8][1], 5, ""), (504, [-0.001] * 32, 2, "")]
    got, want = _codes(spark, tmp_path, rows, "all")
    assert got == want and len(got) == 123
    got, want = _codes(spark, tmp_path, rows[:5], "few")
    assert got == want and len(got) == 5


def test_codes_of_odd_tables(spark):
    schema = "vec_id long, embedding array<double>, label string"
    assert vector_codes.compressed(spark.createDataFrame([], schema)).count() == 0
    assert vector_codes.compressed(spark.createDataFrame([(1, [1.0, 2.0], "a"), (2, [], "a"), (3, None, None)], schema)).count() == 0
    rows = [(2, [0.5] * 16, "a"), (1, [1e30] * 16, "b"), (3, [1.0] * 32, "a")]
    got = vector_codes.compressed(spark.createDataFrame(rows, schema)).collect()
    assert sorted(r.vec_id for r in got) == [1, 2] and all(r.error == 0 for r in got)


# ---- conversations


def by_hand(rows):
    """Damage, faults and the cheapest edits of one conversation, by trying every string of edits in a breadth-first way."""
    conv = rows[0][0]
    kept = []
    for _, turn, role, text in rows:
        role, text = role if role is not None else " ", text if text is not None else " "
        code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if code == 0:
            continue
        if code == 1:
            text = ""
        if code == 2:
            text = "".join(c for c in text if c not in ".!?")
        if code == 4:
            role = "user"
        kept += [(turn, role, text)] * (2 if code == 3 else 1)
    kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
    turns = {t for t, _, _ in kept if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    faults = []
    for i, (_, role, text) in enumerate(kept):
        s = text.strip(" \t\n\v\f\r")
        faults.append("b" if not s else "d" if (role, text) in {(r, t) for _, r, t in kept[:i]} else "t" if s[-1] not in ".!?" else "")
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(kept, kept[1:]))
    best = {(0, ""): (0, "", ())}
    # costs are small: settle (rows used, last initial) by cost, then by letters
    todo, done = [(0, "", 0, "", ())], {}
    while todo:
        todo.sort()
        cost, letters, at, last, out = todo.pop(0)
        if (at, last) in done:
            continue
        done[at, last] = True
        if at == len(kept) and last in ("", "a"):
            return gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, letters, hashlib.sha256("\n".join(out).encode()).hexdigest()
        after = {"": "su", "s": "u", "u": "a", "a": "u"}[last]
        for c, name in (("u", "user"), ("a", "assistant")):
            if c in after:
                todo.append((cost + 3, letters + "I", at, c, (*out, f"{name}:")))
        if at < len(kept):
            _, role, text = kept[at]
            todo.append((cost + 4, letters + "D", at + 1, last, out))
            if faults[at] not in ("b", "d"):
                extra = 3 if faults[at] == "t" else 0
                if role[:1] and role[0] in after:
                    todo.append((cost + extra, letters + "K", at + 1, role[0], (*out, f"{role}:{text}")))
                for c, name in (("u", "user"), ("a", "assistant")):
                    if c in after:
                        todo.append((cost + extra + 3, letters + "R", at + 1, c, (*out, f"{name}:{text}")))
    raise AssertionError(best)


def _compare(spark, rows, segment=conversations.ROWS):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: tuple(r)[1:] for r in conversations.repaired(df, segment).collect()}
    groups = {}
    for r in rows:
        groups.setdefault(r[0], []).append(r)
    assert got == {c: by_hand(g) for c, g in groups.items()}


def test_conversations_equal_brute_force(spark):
    rng = random.Random(4)
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None]
    texts = ["Yes.", "No!", "no end", "", " \n", None, "Why?", "ü."]
    rows = [(c, rng.choice([None, *range(9)]), rng.choice(roles), rng.choice(texts)) for c in range(120) for _ in range(rng.randrange(1, 9))]
    rows += [(None, 1, "user", "x."), (None, None, None, None)]
    _compare(spark, rows)


def test_long_conversations_go_by_segments(spark):
    rng = random.Random(6)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "assistant", "user"]), rng.choice(["Yes.", "no end", f"Turn {t}.", "", f"Why {t % 7}?"])) for c in range(4) for t in range(rng.randrange(20, 70))]
    _compare(spark, rows, segment=3)
    _compare(spark, [(9, 1, "user", "Same.")] * 40 + rows[:5], segment=4)


def test_segments_compose():
    """Matrices of pieces give the costs of the whole, and walking the pieces gives its letters."""
    rng = random.Random(8)
    for _ in range(300):
        codes = bytes(rng.randrange(16) for _ in range(rng.randrange(0, 14)))
        cost, audit = conversations.repaired_whole(codes)
        assert len(audit.replace("I", "")) == len(codes)
        full = [min(sum(w) for w in ways) for ways in [_costs(codes)]]
        assert cost == full[0]


def _costs(codes):
    """Costs of all strings of edits of few rows."""
    best = {0: 0}
    for code in codes:
        for _ in range(2):
            for _, q, r, c in conversations.INSERTS:
                if q in best:
                    best[r] = min(best.get(r, 1e9), best[q] + c)
        then = {}
        for _, q, r, c in conversations.ARCS[code]:
            if q in best:
                then[r] = min(then.get(r, 1e9), best[q] + c)
        best = then
    end = conversations.closed()
    return [(c, end[q]) for q, c in best.items()]


def test_conversations_edge_tables(spark):
    schema = "conv_id long, turn long, role string, text string, cost int"
    assert conversations.repaired(spark.createDataFrame([], schema)).count() == 0
    dropped = next(i for i in itertools.count() if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    got = conversations.repaired(spark.createDataFrame([(dropped, 0, "user", "Hi.", 1)], schema)).collect()
    assert [tuple(r) for r in got] == [(dropped, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_repair_query_equals_brute_force(spark, sf):
    groups = {}
    for r in shared.table(spark, sf, "conversations").collect():
        groups.setdefault(r.conv_id, []).append((r.conv_id, r.turn, r.role, r.text))
    got = {r.conv_id: tuple(r)[1:] for r in QUERIES["op13_repair"](spark, sf).collect()}
    assert got == {c: by_hand(g) for c, g in groups.items()}


# ---- rows and pages that broke earlier operators


def test_equal_segmented_pages_come_back_each(spark, tmp_path):
    big = "x" * 100_000
    rows = [(7, "http://a/", big), (8, "http://b/", big), (None, "http://c/", big), (None, "http://c/", big), (9, "http://d/", "y" * 70_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    pages = pages.unionByName(spark.createDataFrame([(7, "http://a/", big)], pages.schema))  # a partition of its own
    got = sorted(((r.page_id or 0, r.payload_bytes, r.record_type, r.refers_to, r.valid) for r in warc.round_trip(pages).collect()), key=repr)
    assert got == [(0, 100_000, "revisit", 7, True)] * 2 + [(7, 100_000, "response", None, True)] * 2 + [(8, 100_000, "revisit", 7, True), (9, 70_000, "response", None, True)]
    alone = spark.createDataFrame([(None, "u", big)], pages.schema)
    got = warc.round_trip(alone.unionByName(alone)).collect()
    assert [(r.page_id, r.record_type, r.segments > 1, r.valid) for r in got] == [(None, "response", True, True)] * 2


@pytest.mark.parametrize("text", ["", "One sentence. Another one."])
def test_quality_of_equal_texts(spark, text):
    docs = spark.createDataFrame([(i, text) for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    got = quality.classify(docs, labels).collect()
    assert len(got) == 60 and all(0 <= r.score <= 1 for r in got)


@pytest.mark.parametrize("page", ["<main>" * 5000 + "Deep.", "<b><div>" * 20_000 + "Deep.", "<div>" * 20_000 + "</section>" * 20_000 + "Deep.", "<p>" + "<b>" * 20_000 + "</i>" * 20_000 + "Deep.", "<li>" + "<i>" * 20_000 + "<li>" * 20_000 + "Deep."])
def test_deep_pages_are_read_in_linear_time(page):
    began = time.process_time()
    assert html_text.main_text(page) == "Deep."
    html_text._candidates(page)
    assert time.process_time() - began < 4


def test_mains_in_mains():
    page = "<main>a<main>b<article>c</article></main><main>d</main></main><main>e</main>"
    assert html_text.main_text(page) == "c\n\nd\n\ne"
