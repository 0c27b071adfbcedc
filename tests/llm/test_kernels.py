import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from frametally.llm import bytekernels as bk
from frametally.llm import simhash, suffixes
from frametally.llm.toxicity import Lexicon, Matcher, Trie

TEXTS = ["", None, "a", "Ab  cd\nEF", "ünï Ünï x", " lead", "trail ", "x" * 300]


def chunks(texts, limit=1 << 20):
    return list(bk.text_chunks(pa.array(texts, pa.string()), limit))


@pytest.mark.parametrize("limit", [1, 7, 1 << 20])
def test_spans_stay_inside_texts(limit):
    got = []
    for _, _, buf, offsets in chunks(TEXTS, limit):
        starts, ends, first = bk.spans(buf, offsets, bk.TOKEN)
        raw = buf.tobytes()
        got += [[raw[a:b] for a, b in zip(starts[i:j], ends[i:j])] for i, j in zip(first[:-1], first[1:])]
    assert got == [(t or "").encode().split() for t in TEXTS]


def test_equal_words_have_equal_hashes_wherever_they_stand():
    (_, _, buf, offsets), = chunks(["one Two", "two ONE two", "x"])
    h, _, _, first = bk.word_hashes(buf, offsets, bk.WORD)
    assert h[0] == h[3] and h[1] == h[2] == h[4] and len(set(h.tolist())) == 3
    assert h[0] == bk.word_hash(b"one")
    assert first.tolist() == [0, 2, 5, 6]


def test_code_points():
    (_, _, buf, offsets), = chunks(TEXTS)
    assert bk.code_points(buf, offsets).tolist() == [len(t or "") for t in TEXTS]


def test_shingles_of_short_texts():
    (_, _, buf, offsets), = chunks(["", "a b", "a b c d e f"])
    h, _, _, first = bk.word_hashes(buf, offsets, bk.TOKEN)
    s, at = bk.shingles(h, first, 5)
    assert at.tolist() == [0, 0, 1, 3]


def test_simhash_bits_by_brute_force():
    rng = random.Random(5)
    texts = ["", None, "One", "one TWO", *[" ".join(rng.choice("aá bé cc dd".split()) + str(rng.randint(0, 9)) for _ in range(rng.randint(3, 700))) for _ in range(12)]]
    got = []
    for _, _, buf, offsets in chunks(texts):
        low = bk.LOWER[buf]
        got += simhash.majority_bits(*simhash._shingle_hashes(low, *bk.spans(low, offsets, bk.TOKEN), 3)).tolist()
    for t, g in zip(texts, got):
        w = (t or "").encode().lower().split()
        grams = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        hs = [xxhash.xxh64_intdigest(x, 42) for x in grams]
        assert g == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_block_masks_catch_every_close_pair():
    rng = random.Random(1)
    masks = simhash.block_masks()
    assert len(masks) == 20
    for _ in range(500):
        x = rng.getrandbits(64)
        y = x
        for b in rng.sample(range(64), 3):
            y ^= 1 << b
        assert any(x & m == y & m for m in masks)


def test_bucket_links_connect_what_is_close():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 1 << 62, 6, dtype=np.uint64)
    prints = np.concatenate([base, base ^ np.uint64(1), base[:3] ^ np.uint64(6)])
    a, b = simhash.bucket_links(prints, np.arange(len(prints)), 3)
    assert len(a) <= len(prints) - 1
    near = {(i, j) for i in range(len(prints)) for j in range(i) if bin(int(prints[i] ^ prints[j])).count("1") <= 3}

    def parts(links):
        p = list(range(len(prints)))
        for _ in p:
            for i, j in links:
                p[i] = p[j] = min(p[i], p[j])
        return p

    assert parts(zip(a, b)) == parts(near)


@pytest.mark.parametrize("block,memory", [(1 << 18, 1 << 28), (3, 1 << 28), (1, 10), (7, 500)])
def test_suffix_sorting_finds_every_repeat(monkeypatch, block, memory):
    monkeypatch.setattr(suffixes, "BLOCK", block)
    rng = random.Random(block)
    for _ in range(60):
        alphabet = rng.choice([b"a", b"ab", b"abc", bytes(range(256))])
        texts = [bytes(rng.choice(alphabet) for _ in range(rng.randint(0, 50))) for _ in range(rng.randint(0, 7))]
        for _ in range(3):
            if texts:
                t = rng.choice(texts)
                at = rng.randint(0, len(t))
                texts.append(bytes(rng.choice(alphabet) for _ in range(4)) + t[at : at + 25])
        n = rng.choice([1, 3, 8, 13])
        seen = Counter(t[i : i + n] for t in texts for i in range(len(t) - n + 1))
        assert [g.tolist() for g in suffixes.repeated_starts(texts, n, memory)] == [[i for i in range(len(t) - n + 1) if seen[t[i : i + n]] > 1] for t in texts]


def test_suffix_order_and_prefixes():
    text, _ = suffixes.joined([b"banana", b"ananas", b"", b"aaaa"])
    blocks = list(suffixes.sorted_suffixes(text, 100))
    order = [int(p) for b in blocks for p in b[0]]
    prefix = [int(p) for b in blocks for p in b[1]]
    tail = [text[i:].tolist() for i in order]
    assert tail == sorted(tail, reverse=True)
    for x, y, n in zip(tail, tail[1:], prefix[1:]):
        assert n == next((i for i, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))


def test_trie_walk_gives_the_least_edits():
    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    rng = random.Random(3)
    for _ in range(400):
        terms = list({bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 7))) for _ in range(5)})
        word, most = bytes(rng.choice(b"abcd") for _ in range(rng.randint(0, 8))), rng.randint(0, 2)
        least = min(edits(word, t) for t in terms)
        term, n = Trie(terms).within(word, most)
        assert (n == least == edits(word, terms[term])) if least <= most else (term, n) == (-1, most + 1)


def test_stems_are_found_misspelled_and_in_context():
    lexicon = Lexicon((b"wretched",), (b"idiot",), frozenset([b"idiom"]))
    x = Matcher(lexicon).features(pa.array(["an idoitic plan", "he said idiotic today", "you idiots", "an idiom", "a wrtchhed day", "plain words"]))
    assert (x[:, 0] > 0).tolist() == [True, True, True, False, True, False]
    assert (x[:, 6] > 0).tolist() == [True, True, True, False, False, False]
    assert x[1, 2] > 0 and x[2, 3] > 0


def test_words_are_passed_over_only_where_no_term_is_near():
    rng = random.Random(11)
    draw = lambda a, b: bytes(rng.choice(b"abc") for _ in range(rng.randint(a, b)))
    for _ in range(60):
        lexicon = Lexicon(tuple({draw(4, 10) for _ in range(4)}), tuple({draw(5, 7) for _ in range(2)}))
        m = Matcher(lexicon)
        for _ in range(60):
            t = rng.choice([*lexicon.terms, *lexicon.stems])
            w = bytearray(t)
            for _ in range(rng.randint(0, 3)):
                at = rng.randrange(len(w) + 1)
                w[at : at + rng.randint(0, 1)] = draw(0, 1)
            w = bytes(w) + draw(0, 3) * rng.randint(0, 1)
            assert m.nearest(w)[0] < 0 or m.may_match(w)
