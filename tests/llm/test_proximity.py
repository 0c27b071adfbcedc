"""Proximity matches of the decontamination against brute force over random edits."""

import hashlib
import random
import re
from collections import Counter

from frametally.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SLACK, WINDOW = 5, 10


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def near_items(docs, items):
    """For each document the ids of the items that come near, by trying all places of all looked-up terms."""
    count = Counter(w for _, t in docs for w in words(t))
    phrases = {}
    for i, t in items:
        w = words(t)
        n = min(WINDOW, len(w))
        for a in range(len(w) - n + 1 if n else 0):
            phrases.setdefault(tuple(w[a : a + n]), set()).add(i)
    out = []
    for _, t in docs:
        w, found = words(t), set()
        for p, ids in phrases.items():
            if not all(count[x] for x in p):
                continue
            looked_up = sorted((count[x], x.encode(), o) for o, x in enumerate(p))[:2]
            starts = {o: [at - o for at, x in enumerate(w) if x == p[o] and 5 * len(set(w[max(0, at - WINDOW + 1) : at + WINDOW]) & set(p)) >= 4 * len(set(p))] for _, _, o in looked_up}
            if len(starts) == 2:
                one, two = starts.values()
                if any(abs(a - b) <= SLACK for a in one for b in two):
                    found |= {str(i) for i in ids if i is not None}
        out.append(sorted(found))
    return out


def edited(w, rng):
    w = list(w)
    for _ in range(rng.randrange(0, 4) if len(w) > 3 else 0):
        at = rng.randrange(len(w))
        kind = rng.randrange(3)
        w[at : at + 1] = {0: [], 1: [w[at], rng.choice("xyz")], 2: [rng.choice("xyz")]}[kind]
    return w


def test_proximity_by_brute_force(spark):
    rng = random.Random(6)
    letters = [f"w{i}" for i in range(40)] + ["Ünïts", "B"]
    bench = [(i, " ".join(rng.choices(letters, k=rng.choice((2, 4, 10, 13))))) for i in range(30)] + [(30, "solo"), (None, "w1 w2 w3"), (31, ""), (32, None), (33, "w5 w5 w5 w5 w5"), (34, bench_twin := "w1 w2 w3"), (35, bench_twin)]
    docs = []
    for d in range(120):
        text = rng.choices(letters, k=rng.randrange(0, 30))
        for _, t in rng.choices([b for b in bench if b[1]], k=rng.randrange(0, 3)):
            at = rng.randrange(len(text) + 1)
            text[at:at] = edited(t.split(), rng)
        docs.append((d, " ".join(text)))
    docs += [(200, None), (201, ""), (5, docs[5][1]), (5, "w1 w2 w3"), (None, "w1 w2 w3")]
    got = decontaminate.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string"), slack=SLACK).collect()
    want = near_items(docs, bench)
    assert Counter((r.doc_id, r.n_near, r.near_sha256) for r in got) == Counter((d, len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest()) for (d, _), ids in zip(docs, want))
    # some only come near: reworded, not copied
    assert sum(r.n_near > r.n_items for r in got) > 10


def test_exact_columns_do_not_change_with_slack(spark):
    docs = spark.createDataFrame([(1, "a b c d"), (2, "a x b c d"), (3, None)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b c d")], "item_id long, text string")
    plain = decontaminate.contamination(docs, items)
    both = decontaminate.contamination(docs, items, slack=SLACK)
    assert sorted(map(tuple, both.select(plain.columns).collect())) == sorted(map(tuple, plain.collect()))
    assert {r.doc_id: (r.n_items, r.n_near) for r in both.collect()} == {1: (1, 1), 2: (0, 1), 3: (0, 0)}


def test_no_items_nothing_near(spark):
    docs = spark.createDataFrame([(1, "a b c d")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r.n_near for r in decontaminate.contamination(docs, none, slack=SLACK).collect()] == [0]
    assert decontaminate.contamination(docs.limit(0), spark.createDataFrame([(1, "a b")], "item_id long, text string"), slack=SLACK).count() == 0
