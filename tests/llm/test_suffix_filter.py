import random

from silvaflow.llm import suffix_dedup


def test_no_context_travels_for_short_repeats(spark, monkeypatch):
    rnd = random.Random(5)
    some = lambda n: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    phrases = [some(24) for _ in range(30)]
    texts = ["".join(some(24) + rnd.choice(phrases) for _ in range(30)) for _ in range(60)]
    seen, stretches = [], suffix_dedup._stretches

    def watched(blocks, *rest):
        seen.append(blocks.count())
        return stretches(blocks, *rest)

    monkeypatch.setattr(suffix_dedup, "_stretches", watched)
    got = suffix_dedup.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: bytes(r.kept).decode() for r in got} == dict(enumerate(texts))
    assert seen == [0]


def test_strings_repeated_to_one_side_only(spark):
    rnd = random.Random(6)
    some = lambda n: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    rows = []
    for n in range(46, 56):
        for _ in range(12):
            piece = some(n)
            rows += [(len(rows), some(70) + "1" + piece + "2" + some(70), 0), (len(rows) + 1, some(60) + "3" + piece + "4" + some(80), n if n >= 50 else 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int")
    got = {r.doc_id: sum(e - s for s, e in r.spans) for r in suffix_dedup.remove_repeats(docs).collect()}
    assert got == {i: n for i, _, n in rows}
