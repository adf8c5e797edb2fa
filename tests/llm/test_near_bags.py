import random

import numpy as np

from silvaflow.llm import near_dedup


def test_bags_tell_long_texts_apart_and_lose_no_alike_pair(spark):
    rnd = random.Random(4)
    text = lambda n: [f"w{rnd.randrange(rnd.choice((300, 20000, 20000)))}" for _ in range(n)]
    rows, alike, unlike = [], [], []
    for n in (60, 700, 4000, 9000):
        a, b = text(n), text(n)
        near = [f"x{i}" if i % 5 == 2 else w for i, w in enumerate(a)]
        assert near_dedup.alike(a, near) and not near_dedup.alike(a, b)
        k = len(rows)
        rows += [(k + i, " ".join(t)) for i, t in enumerate((a, b, near, a[: n - n // 5]))]
        alike += [(k, k + 2), (k, k + 3)]
        unlike += [(k, k + 1), (k + 1, k + 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = near_dedup._sketched(docs, 0.8).selectExpr("row.doc_id as item", "n_words", "bag").localCheckpoint()
    pairs = spark.createDataFrame(alike + unlike, "a long, b long").localCheckpoint()
    assert sorted(map(tuple, near_dedup._maybe(pairs, items, 0.8).collect())) == sorted(alike)


def test_folded_bags_are_bags_of_fewer_bins():
    rnd = np.random.default_rng(5)
    ids, sizes = rnd.integers(0, 1 << 63, 12000).astype(np.uint64), np.array([3000, 9000])
    many = near_dedup.bags(ids, sizes, 4096)
    assert (near_dedup.folded([many[0].tobytes(), near_dedup.bags(ids, sizes, 512)[1].tobytes()], 512) == near_dedup.bags(ids, sizes, 512)).all()
