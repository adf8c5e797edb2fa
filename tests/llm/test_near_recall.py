import random

from silvaflow.llm import near_dedup


def test_pairs_at_the_threshold_are_found(spark):
    rnd = random.Random(21)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(8))
    pairs = []
    for n in [5, 6, 7, 8, 9] * 3:
        a = [word() for _ in range(n)]
        pairs += [(a, a[: n // 2] + [word()] + a[n // 2 + 1 :])]
        b = [word() for _ in range(n)]
        pairs += [(b, b[: n // 2] + b[n // 2 + 1 :])]
    for n in [10, 15, 20, 30, 50, 100, 600] * 6:
        a = [word() for _ in range(n)]
        pairs.append((a, [word() if i % 5 == 2 else w for i, w in enumerate(a)]))
        b = [word() for _ in range(n)]
        pairs.append((b, b[: n - n // 5]))
    assert all(near_dedup.alike(a, b) for a, b in pairs)
    rows = [(2 * i + j, " ".join(t)) for i, p in enumerate(pairs) for j, t in enumerate(p)]
    got = {r.doc_id: r.class_id for r in near_dedup.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [i for i in range(len(pairs)) if got[2 * i + 1] != 2 * i] == []
