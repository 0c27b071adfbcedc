"""The pipeline's near-duplicates meet on blocks of their SimHash, not on bands alone."""

import numpy as np

from frametally.llm import simhash


def test_prints_within_three_bits_share_a_block():
    draw = np.random.default_rng(3)
    a = draw.integers(0, 1 << 63, 500, dtype=np.uint64) * np.uint64(2)
    b = a.copy()
    for i in range(len(b)):
        for bit in draw.choice(64, i % 4, replace=False):
            b[i] ^= np.uint64(1) << np.uint64(bit)
    ka, kb = simhash.block_keys(a), simhash.block_keys(b)
    assert ka.shape == (500, 10)
    assert (ka == kb).any(axis=1).all()
    # unlike prints share none, nor do places of blocks share keys
    assert not np.isin(ka, np.roll(kb, 1, axis=0)[0]).all() and len(np.unique(ka)) == ka.size


def test_near_duplicates_share_blocks_of_their_simhash(spark):
    words = [f"w{i}" for i in range(400)]
    texts = [(1, " ".join(words)), (2, " ".join(words[:-1] + ["other"])), (3, " ".join(reversed(words))), (4, ""), (5, "")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    printed = docs.select("doc_id", simhash.wide_fingerprint(docs.text, 5).alias("p")).select("doc_id", "p.keys").collect()
    blocks = {r.doc_id: set(r["keys"][:10]) for r in printed}
    assert blocks[1] & blocks[2] and not blocks[1] & blocks[3] and not blocks[4]
    got = {r.doc_id: r.component_id for r in simhash.similar(docs).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 4}
