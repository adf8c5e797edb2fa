from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from silvaflow.llm import links


@pytest.mark.parametrize("block", [16, 4096])
def test_no_pair_of_a_hot_key_is_left_out(spark, monkeypatch, block):
    monkeypatch.setattr(links, "BLOCK", block)
    big, pairs, lone = range(100, 200), [(1000 + i, 2000 + i) for i in range(20)], range(3000, 3010)
    kin = {i: 0 for i in big} | {i: 1 + k for k, p in enumerate(pairs) for i in p} | {i: -i for i in lone}
    held = [(key, i, 10) for key in range(2) for i in kin] + [(9, 5000, 10), (9, 5001, 20), (8, 5002, 10)]
    rows = links.counted(links.classed(links.crowded(spark.createDataFrame(held, "key long, item long, size int")), 0.8))
    assert 5000 not in {r.item for r in rows.collect()}

    def work(batches):
        for cell in links.each_cell(batches):
            item = cell["item"]
            found = links.spanning(cell, item.copy(), lambda x, y: y, lambda x, y: kin[item[x]] == kin[item[y]])
            if found:
                a, b = np.array(found).T
                yield pa.RecordBatch.from_arrays([pa.array(item[a]), pa.array(item[b])], ["a", "b"])

    found = links.cells(rows).select(*links.CELL, "side", "item").mapInArrow(work, "a long, b long")
    assert found.count() < 4 * len(kin) * (7 if block == 16 else 1)
    got = {r.item: r.root for r in links.components(found).collect()}
    assert got == {i: 100 for i in big} | {i: a for a, b in pairs for i in (a, b)}


def test_every_two_items_of_a_key_meet_once(spark, monkeypatch):
    monkeypatch.setattr(links, "BLOCK", 8)
    rows = spark.range(50).select(F.lit(1).cast("long").alias("key"), F.lit(0).alias("class"), F.col("id").alias("item"), F.lit(50).alias("n"))
    seen = []

    def gather(batches):
        for cell in links.each_cell(batches):
            labels = cell["item"].copy()
            for x in range(len(labels)):
                for y in links.partners(cell, labels, x):
                    yield pa.RecordBatch.from_pydict({"a": [int(labels[x])], "b": [int(labels[y])]})

    seen = [tuple(sorted((r.a, r.b))) for r in links.cells(rows).select(*links.CELL, "side", "item").mapInArrow(gather, "a long, b long").collect()]
    assert sorted(seen) == list(combinations(range(50), 2))


def test_size_classes_hold_every_pair_that_may_be_alike():
    small = np.arange(1, 30_000)
    assert (links.size_class(np.floor(small / 0.8 + 1e-9), 0.8) - links.size_class(small, 0.8)).max() <= 1


def test_only_loses_no_needed_row(spark, monkeypatch):
    from silvaflow.llm import common

    rows = spark.range(20_000).select((F.col("id") * 7919 - 50_000).alias("item"), F.col("id").cast("string").alias("x"))
    needed = rows.filter("item % 40 = 0").select("item")
    got = [r.item for r in common.only(rows, needed, "item").collect()]
    want = {r.item for r in needed.collect()}
    assert want <= set(got) and len(got) == len(set(got)) < 1.1 * len(want)
    monkeypatch.setattr(common, "MOST_BITS", 1 << 15)
    monkeypatch.setattr(common, "LEAST_BITS", 1 << 15)
    assert want <= {r.item for r in common.only(rows, needed, "item").collect()}
    assert common.only(rows, needed.limit(0), "item").count() == 0


def test_crowded_loses_no_shared_key(spark):
    rnd = np.random.default_rng(1)
    held = [(int(rnd.integers(0, 4000)) if i % 3 else 7, i, 10) for i in range(6000)]
    n = {}
    for key, _, _ in held:
        n[key] = n.get(key, 0) + 1
    want = {(key, i) for key, i, _ in held if n[key] > 1}
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    rows = spark.createDataFrame(held, "key long, item long, size int")
    try:
        for batch in ("1", "7", "10000"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
            got = [(r.key, r.item) for r in links.crowded(rows).collect()]
            assert want <= set(got) and len(got) == len(set(got)) <= len(want) + 2 * 200
            assert {(r.key, r.item) for r in links.counted(links.classed(links.crowded(rows), 0.8)).collect()} == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert links.crowded(rows.limit(0)).count() == 0
