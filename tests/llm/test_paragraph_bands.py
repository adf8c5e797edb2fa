from silvaflow.llm import paragraph_dedup


def test_bands_are_crowded_one_at_a_time(spark, monkeypatch):
    n, _ = paragraph_dedup.bands()
    line = "the quick brown fox jumps over the lazy dog by the old river bank today"
    docs = spark.createDataFrame([(i, f"{line}\nonly here number {i} and nothing else of note {i * 7} at all") for i in range(40)], "doc_id long, text string")
    seen, crowded = [], paragraph_dedup.crowded

    def watched(held):
        seen.append(held.groupBy("item").count().agg({"count": "max"}).first()[0])
        return crowded(held)

    monkeypatch.setattr(paragraph_dedup, "crowded", watched)
    got = {r.doc_id: r for r in paragraph_dedup.decisions(docs).collect()}
    assert seen == [1] * n
    assert all(0 in {x.line for x in got[i].removed} for i in range(1, 40)) and 0 not in {x.line for x in got[0].removed}
