import random
import re
from collections import defaultdict

import numpy as np
import pytest

from silvaflow.llm import exact_dedup, links, near_dedup, paragraph_dedup, suffix_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, keep_id long"
WS = re.compile(r"[\x20\x09-\x0D]+")


def prose(rnd, n):
    return " ".join("".join(rnd.choice("aeioumnrst") for _ in range(rnd.randint(2, 7))) for _ in range(n))


def corpus():
    rnd = random.Random(11)
    base = [prose(rnd, rnd.randint(30, 90)) for _ in range(25)]
    shared = prose(rnd, 60)
    texts = [None, "", " ", "\t\n", "a", "a", "x" * 300, "ab" * 200] + base
    texts += [base[0], base[0].replace(" ", "\n"), base[1] + " ", "  " + base[2], base[3], base[3], base[3]]
    for k in range(6):  # near copies
        words = base[4 + k].split()
        words[len(words) // 2] = "changed"
        texts.append(" ".join(words))
    texts += [base[12] + "\n" + shared, shared + "\n" + base[13], base[14] + shared, "é" * 80 + shared]
    texts.append((prose(rnd, 40) + "\n") * 3)
    texts.append(prose(rnd, 4000))
    texts.append(texts[-1] + " more")
    return list(enumerate(texts))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", 0, 1, 2) for i, t in corpus()]
    return spark.createDataFrame(rows[::-1], SCHEMA).repartition(4).cache()


def test_exact_groups(spark, docs, monkeypatch):
    monkeypatch.setattr("silvaflow.llm.common.HOT_ROWS", 1)
    groups = defaultdict(list)
    for i, t in corpus():
        groups[WS.sub(" ", t or "")].append(i)
    want = {i: (min(g), len(g)) for g in groups.values() for i in g}
    for block in (16, exact_dedup.BLOCK):
        got = exact_dedup.exact_groups(docs, block=block).collect()
        assert {r.doc_id: (r.keep_id, r.group_size) for r in got} == want and len(got) == len(want)
        assert all(r.kept == (r.doc_id == r.keep_id) for r in got)
    assert sorted(r.doc_id for r in exact_dedup.drop_copies(docs).collect()) == sorted(map(min, groups.values()))


def test_exact_odd_tables(spark):
    assert exact_dedup.exact_groups(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(1, "a", "", "", 0, 0, 0), (1, "a", "", "", 0, 0, 0), (1, "b", "", "", 0, 0, 0), (None, "a", "", "", 0, 0, 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r.doc_id, r.copies): (r.keep_id, r.group_size) for r in exact_dedup.exact_groups(df).collect()}
    assert got == {(1, 2): (1, 3), (1, 1): (1, 1), (None, 1): (1, 3)}
    assert sorted(r.text for r in exact_dedup.drop_copies(df).collect()) == ["a", "b"]
    clash = df.withColumnsRenamed({"lang": "copies", "source": "__key"})
    assert exact_dedup.drop_copies(clash).columns == clash.columns and exact_dedup.drop_copies(clash).count() == 2


def test_near_odd_tables(spark):
    text = prose(random.Random(4), 50)
    other = text.replace(text.split()[7], "changed")
    rows = [(None, text, 1, 1), ("b", other, 2, 2), ("b", "something else " + prose(random.Random(5), 40), 3, 3), ("a", None, 4, 4), (None, "", 5, 5), ("b", text, 6, 6), ("b", text, 7, 7)]
    df = spark.createDataFrame(rows, "doc_id string, text string, rid int, row int")
    got = near_dedup.near_classes(df).collect()
    assert len(got) == 7 and sum(r.kept for r in got) == 3
    kept = near_dedup.drop_near(df)
    assert kept.columns == df.columns
    left = sorted(r.rid for r in kept.collect())
    assert left[1:] == [3, 4] and left[0] == 2 or left[0] in (3,) and left == [3, 4, 6] or left == [3, 4, 7]


def test_suffix_removal_is_brute_force(spark, docs):
    def brute(rows, length):
        seen, out = set(), {}
        for i, t in rows:
            b = (t or "").encode()
            mask = np.zeros(len(b), bool)
            own = [b[p : p + length] for p in range(len(b) - length + 1)]
            for p, s in enumerate(own):
                if s in seen:
                    mask[p : p + length] = True
            seen.update(own)
            out[i] = bytes(np.frombuffer(b, np.uint8)[~mask])
        return out

    want = brute(corpus(), 50)
    # the second time every piece counts as one in very many documents
    for many in (suffix_dedup.MANY, 0):
        got = {r.doc_id: r for r in suffix_dedup.remove_repeats(docs, many).collect()}
        assert {i: bytes(r.kept) for i, r in got.items()} == want
        for i, r in got.items():
            assert r.n_bytes - sum(e - s for s, e in r.spans) == len(want[i])
    assert suffix_dedup.remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0
    odd = spark.createDataFrame([(1, "q" * 60, "", "", 0, 0, 0), (1, "q" * 70, "", "", 0, 0, 0), (None, "q" * 60, "", "", 0, 0, 0)], SCHEMA)
    assert sorted(len(r.kept) for r in suffix_dedup.remove_repeats(odd).collect()) == [0, 60, 70]


def test_suffix_columns():
    rnd = np.random.default_rng(3)
    columns = rnd.integers(97, 99, (60, 20)).astype(np.uint8)
    columns[30:] = columns[:30]
    doc = rnd.integers(0, 40, 60)
    low, high = rnd.integers(0, 4, 60), rnd.integers(4, 13, 60)
    got = suffix_dedup.repeated(columns, low, high, doc, 8)
    for i in range(60):
        for c in range(13):
            live = [j for j in range(60) if low[j] <= c <= high[j] and (columns[j, c : c + 8] == columns[i, c : c + 8]).all()]
            assert got[i, c] == (low[i] <= c <= high[i] and min(doc[j] for j in live) < doc[i])


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        row = _next(row, x, b, i)
    return row[-1]


def _next(row, x, b, i):
    out = [i + 1]
    for j, y in enumerate(b):
        out.append(min(row[j] + (x != y), row[j + 1] + 1, out[j] + 1))
    return out


def test_alignment_is_exact():
    rnd = random.Random(5)
    for _ in range(400):
        a = [rnd.randint(0, 5) for _ in range(rnd.randint(0, 30))]
        b = list(a)
        for _ in range(rnd.randint(0, 8)):
            k = rnd.randint(0, len(b))
            b[k : k + rnd.randint(0, 2)] = [rnd.randint(0, 5) for _ in range(rnd.randint(0, 2))]
        most = rnd.randint(0, 10)
        assert near_dedup.within(np.array(a, np.int64), np.array(b, np.int64), most) == min(edit(a, b), most + 1)


def test_near_classes(spark, docs):
    words = {i: near_dedup.words_of(t) for i, t in corpus()}
    root = {i: i for i in words}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in words:
        for b in words:
            if a < b and near_dedup.alike(words[a], words[b]) and bool(words[a]) == bool(words[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = {r.doc_id: r for r in near_dedup.near_classes(docs).collect()}
    assert {i: r.class_id for i, r in got.items()} == {i: find(i) for i in words}
    assert sorted(r.doc_id for r in near_dedup.drop_near(docs).collect()) == sorted({find(i) for i in words})
    assert near_dedup.near_classes(spark.createDataFrame([], SCHEMA)).count() == 0


def test_components(spark):
    rnd = random.Random(2)
    pairs = [(i, i + 1) for i in range(40)] + [(rnd.randint(50, 200), rnd.randint(50, 200)) for _ in range(60)]
    root = {i: i for p in pairs for i in p}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {r.item: r.root for r in links.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {i: find(i) for a, b in pairs if a != b for i in (a, b)}


def test_paragraphs(spark, docs):
    pieces = {}
    for i, t in corpus():
        for j, line in enumerate((t or "").split("\n")):
            words = near_dedup.words_of(line)
            for x, y in paragraph_dedup.paragraphs(line):
                pieces[(i, j, x, y)] = paragraph_dedup.shingles(words[x:y])
    root = {k: k for k in pieces}
    for k, s in pieces.items():
        hit = next((o for o in pieces if o < k and paragraph_dedup.jaccard(s, pieces[o]) >= 0.8), None)
        root[k] = root[hit] if hit else k
    shared, want, keep = defaultdict(int), defaultdict(list), defaultdict(set)
    for k, r in root.items():
        shared[k[0]] += list(root.values()).count(r) > 1
        if r != k:
            want[k[0]].append(k[1:])
            keep[k[0]].add(r[0])
    got = {r.doc_id: r for r in paragraph_dedup.decisions(docs).collect()}
    assert len(got) == len(corpus())
    assert {i: sorted(map(tuple, r.removed)) for i, r in got.items() if r.removed} == {i: sorted(v) for i, v in want.items()}
    assert all(r.n_shared == shared[i] and set(r.keep_ids) == keep[i] for i, r in got.items())
    kept = {r.doc_id: r.text for r in paragraph_dedup.drop_paragraphs(docs).collect()}
    for i, t in corpus():
        assert kept[i] == (t if not want[i] else paragraph_dedup.without(t, want[i]))
    # a passage that begins and ends inside other lines is found there too
    n = len(corpus())
    assert all(any(root[k] != k for k in pieces if k[0] == i) for i in range(n) if corpus()[i][1] and corpus()[i][1].startswith("é" * 80))
    assert paragraph_dedup.decisions(spark.createDataFrame([], SCHEMA)).count() == 0


def test_paragraphs_of_odd_rows(spark):
    line = prose(random.Random(3), 30)
    rows = [(None, line, 1, b"x"), (2, line, 2, None), (2, line, 3, None), (2, "other\n" + line, 4, None), (1, None, 5, None), (7, "", 6, None)]
    df = spark.createDataFrame(rows, "doc_id int, text string, removed int, fp binary")
    got = sorted((str(r.doc_id), r.n_shared, len(r.removed), list(r.keep_ids)) for r in paragraph_dedup.decisions(df).collect())
    assert got[:2] == [("1", 0, 0, []), ("2", len(paragraph_dedup.paragraphs(line)), 0, [])] and got[4][1:] == (0, 0, []) and got[5][0] == "None" and got[5][3] == [2]
    out = {r.removed: r.text for r in paragraph_dedup.drop_paragraphs(df).collect()}
    assert out == {1: "", 2: line, 3: line, 4: "other", 5: None, 6: ""}


def test_cutting_paragraphs_out():
    text = "one, two three\nfour five! six seven.\nend"
    assert paragraph_dedup.without(text, [(1, 0, 2)]) == "one, two three\nsix seven.\nend"
    assert paragraph_dedup.without(text, [(1, 2, 4), (0, 0, 3)]) == "four five! \nend"
    assert paragraph_dedup.without(text, [(0, 0, 3), (1, 0, 4), (2, 0, 1)]) == ""


def test_bands():
    n, rows = paragraph_dedup.bands()
    assert 1 - (1 - 0.8**rows) ** n >= 0.999
    with pytest.raises(ValueError, match="recall"):
        paragraph_dedup.bands(0.1, 0.999999, 2)

