import random
import re
from collections import Counter
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from silvaflow.llm import license_scan, logistic, mixing, quality_rules

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, distance double"


def prose(rnd, n):
    return " ".join("".join(rnd.choice("aeioumnrst") for _ in range(rnd.randint(2, 7))) for _ in range(n))


def brute(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    cover = {j for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines, dup = set(), 0
    for x in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", x):
            dup += x in lines
            lines.add(x)
    return [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(cover)]


def test_statistics_are_brute_force():
    rnd = random.Random(4)
    texts = ["", " ", "\n\n", "a", "é ü x \x1c y", "one two three four five six seven eight " * 3, "x\nx\n \n y\nx", "#*$%&|<>", "a b " * 50]
    texts += ["".join(rnd.choice("ab \n#é") for _ in range(rnd.randint(0, 200))) for _ in range(200)]
    got = quality_rules.text_statistics(texts)
    assert np.array([got[c] for c in quality_rules.BASE]).T.tolist() == [brute(t) for t in texts]


def test_chi_squared():
    assert quality_rules.chi2_cdf(quality_rules.chi2_quantile(0.95, 5), 5) == pytest.approx(0.95)
    assert quality_rules.chi2_quantile(0.95, 5) == pytest.approx(11.0705, abs=1e-3)


def test_outliers(spark):
    rnd = random.Random(9)
    rows = [(i, prose(rnd, rnd.randint(60, 300)), "en" if i % 3 else None, "s" if i % 2 else None, 0, True, 0.0) for i in range(400)]
    rows += [(1000 + i, " ".join(w + "###" for w in prose(rnd, 90).split()), "en", "s", 0, True, 0.0) for i in range(12)]
    rows += [(2000, None, "en", "s", 0, True, 0.0), (2001, "", None, None, 0, True, 0.0), (2002, "same words again here " * 30, "en", "s", 0, True, 0.0), (2003, prose(rnd, 80), "xx", "lone", 0, True, 0.0), (3, rows[3][1], "en", "s", 0, True, 0.0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = quality_rules.judged(quality_rules.statistics(docs)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert all(by[i].kept for i in range(400)) and not any(by[1000 + i].kept for i in range(12))
    assert by[2000].base_failed and by[2001].base_failed and by[2002].base_failed and by[2003].kept and by[2003].distance is not None
    assert {r.doc_id for r in quality_rules.drop_poor(docs).collect()} == {r.doc_id for r in got if r.kept}
    assert quality_rules.judged(quality_rules.statistics(docs.limit(0))).count() == 0


def plain_mcd(x):
    """The estimate of one group by the plain algorithm: three starts, concentration to the end, least determinant."""
    floor = np.array(list(quality_rules.FLOOR.values()))
    centre = np.median(x, axis=0)
    spread = np.maximum(1.4826 * np.median(np.abs(x - centre), axis=0), floor)
    z = (x - centre) / spread
    starts = [np.diag(spread**2)]
    for u in (np.tanh(z), z / np.sqrt(np.maximum((z * z).sum(1, keepdims=True), 1e-12)) * np.sqrt(z.shape[1])):
        starts.append(u.T @ u / len(u) * np.outer(spread, spread))
    k = quality_rules.COVER / quality_rules.chi2_cdf(quality_rules.chi2_quantile(quality_rules.COVER, 5), 7)
    found = []
    for s in starts:
        m, s = centre, quality_rules.floored(s[None])[0]
        for _ in range(60):
            d = np.einsum("ni,ij,nj->n", x - m, np.linalg.inv(s), x - m)
            own = x[d <= np.sort(d)[int(np.ceil(quality_rules.COVER * len(d))) - 1]]
            m, s = own.mean(0), quality_rules.floored((np.cov(own.T, bias=True) * k)[None])[0]
        found.append((np.linalg.det(s), m, s))
    return min(found, key=lambda f: f[0])


def test_verdicts_are_those_of_the_plain_algorithm(spark):
    rng = np.random.default_rng(8)
    rows = []
    for i in range(900):
        lang, source = [("en", "a"), ("en", "b"), ("fr", None), ("de", "c")][i % 4] if i < 880 else ("xx", "few")
        n = int(np.exp(rng.normal(5, 0.6))) + 20
        junk = i % 11 == 0
        rows.append((i, lang, source, n, int(n * rng.uniform(4, 6) * (3 if junk and i % 2 else 1)), int(n * (0.9 if junk else 0.01) * rng.uniform(0.5, 1.5)), int(n * 0.02 * rng.uniform(0, 1)), int(n * 0.1 * rng.uniform(0, 1)) if i % 50 else n))
    stats = spark.createDataFrame(rows, "doc_id long, lang string, source string, " + ", ".join(f"{c} long" for c in quality_rules.BASE))
    got = {r.doc_id: r for r in quality_rules.judged(stats).collect()}
    a = np.array([[r[3], r[4], r[5], r[6], r[7]] for r in rows], float)
    x = np.stack([np.log1p(a[:, 0]), np.log(a[:, 1] / a[:, 0]), np.sqrt(a[:, 2] / a[:, 1]), np.sqrt(a[:, 3] / a[:, 0]), np.sqrt(a[:, 4] / a[:, 0])], axis=1)
    failed = 100 * a[:, 4] > 30 * a[:, 0]
    group = [(r[1], r[2]) if r[0] < 880 else "all" for r in rows]
    cutoff = quality_rules.chi2_quantile(quality_rules.CUTOFF_P, 5)
    for g in set(group):
        of = np.array([y == g for y in group])
        _, m, s = plain_mcd(x[~failed] if g == "all" else x[of & ~failed])
        d = np.einsum("ni,ij,nj->n", x - m, np.linalg.inv(s), x - m)
        for i in np.flatnonzero(of):
            assert got[i].base_failed == failed[i]
            assert got[i].distance == pytest.approx(d[i], rel=0.1, abs=0.3)
            if abs(d[i] - cutoff) > 0.1 * cutoff:
                assert got[i].kept == (not failed[i] and d[i] <= cutoff)


def test_rows_that_share_an_id_are_judged_alone(spark):
    rnd = random.Random(2)
    rows = [(i, prose(rnd, 120), "en", "s", i) for i in range(80)] + [(3, "junk ### " * 40, "en", "s", 100), (None, prose(rnd, 100), "en", "s", 101), (3, None, "en", "s", 102)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, lang string, source string, kept int")
    assert {r.kept for r in quality_rules.drop_poor(docs).collect()} == {*range(80), 101}


def test_regression_learns():
    rnd = np.random.default_rng(1)
    x = rnd.normal(size=(400, 3))
    y = (x[:, 0] + 0.5 * x[:, 1] > 0).astype(int) + (x[:, 2] > 1)
    w, b = logistic.fit(x[:300], y[:300], 3)
    assert (np.argmax(x[300:] @ w + b, axis=1) == y[300:]).mean() > 0.85


def test_mixing(spark):
    rnd = random.Random(6)
    rows, labels = [], []
    for i in range(500):
        text = prose(rnd, rnd.randint(40, 120))
        kind = "toxic" if i % 10 == 0 else "poor" if i % 10 == 1 else "clean"
        if kind == "toxic":
            text += " nasty vile" * 3
        elif kind == "poor":
            text = text.upper().replace(" ", "!! ")
        rows.append((i, text, "en", "s", 0, True, 0.0))
        if i % 2 or i % 10 == 0:
            labels.append((i, int(kind != "poor"), int(kind == "toxic")))
    docs, table = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = mixing.mixed(docs, table).collect()
    assert len(got) == len(rows)
    kinds = lambda r: "toxic" if r.doc_id % 10 == 0 else "poor" if r.doc_id % 10 == 1 else "clean"
    right = [max(mixing.DOMAINS, key=lambda d: r[f"p_{d}"]) == kinds(r) for r in got]
    assert np.mean(right) > 0.95
    total = {d: sum(r.rate * r.n_tokens * r[f"p_{d}"] for r in got) for d in mixing.DOMAINS}
    share = {d: v / sum(total.values()) for d, v in total.items()}
    assert all(abs(share[d] - mixing.TARGETS[d]) < 0.02 for d in mixing.DOMAINS) and all(r.rate >= 0 for r in got)
    # the same fit by many plain projected-gradient steps
    n, p = np.array([r.n_tokens for r in got], float), np.array([[r[f"p_{d}"] for d in mixing.DOMAINS] for r in got])
    w, supply = np.array(list(mixing.TARGETS.values())), n @ p
    t, rate = supply[0] / w[0], np.ones(len(got))
    for _ in range(8000):
        gap = (rate * n) @ p / t - w
        rate = np.clip(rate - 0.5 * (p @ (gap / (supply / t)) + mixing.RIDGE * (rate - 1)), 0, mixing.MOST)
    assert np.abs(rate - np.array([r.rate for r in got])).max() < 0.02
    out = mixing.mix(docs, table)
    assert out.columns == docs.columns and out.count() == sum(r.n_copies for r in got)
    alone = mixing.mixed(docs, table.limit(0)).collect()
    assert all(r.rate == 1.0 and r.n_copies == 1 for r in alone)
    odd = spark.createDataFrame([(None, None, None, None, None, None, None), (1, "", "", "", 0, True, 0.0), (1, "", "", "", 0, True, 0.0)], SCHEMA)
    assert mixing.mixed(odd, table).count() == 3 and mixing.mixed(docs.limit(0), table).count() == 0


def test_a_scarce_domain_is_not_repeated_without_bound(spark):
    rows = [(i, 0.5, 100, *((0.02, 0.98, 0.0) if i < 5 else (0.1, 0.0, 0.9) if i < 10 else (0.99, 0.01, 0.0))) for i in range(1000)]
    table = spark.createDataFrame(rows, "doc_id long, chance double, n_tokens long, p_clean double, p_poor double, p_toxic double")
    n, p = np.array([r[2] for r in rows], float), np.array([r[3:] for r in rows])
    for most in (1.0, 2.0):
        found = mixing.fitted(table, {"clean": 0.8, "poor": 0.2, "toxic": 0.0}, most=most)
        r = found.state(p)[0]
        assert r.max() <= most and r[:5].min() > most - 1e-6 and r[5:10].max() < 0.1 and r[10:].min() > 0.9
        got = mixing.shares(table, found)
        assert got["poor"] < 0.05 and sum(got.values()) == pytest.approx(1)
        w = np.array([0.8, 0.2, 0.0])
        total, rate = (n @ p)[0] / w[0], np.ones(len(p))
        share = np.maximum(n @ p / total, 1e-6)
        for _ in range(6000):
            rate = np.clip(rate - 0.5 * (p @ (((rate * n) @ p / total - w) / share) + mixing.RIDGE * (rate - 1)), 0, most)
        assert np.abs(rate - r).max() < 0.01


def test_mixing_keeps_columns_and_rows(spark):
    rows = [(None, "a b", 1, 5), (3, "c d", 2, 6), (3, "c d", 3, 7), (3, None, 4, 8)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, n_copies int, rate int")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert sorted(mixing.mix(docs, labels).collect(), key=lambda r: r.rate) == sorted(docs.collect(), key=lambda r: r.rate)


@pytest.fixture(scope="module")
def licences():
    rnd = random.Random(8)
    return license_scan.Licences([prose(rnd, rnd.randint(3, 40)) for _ in range(150)])


WRAPPED = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software"""


def test_licences(spark, licences):
    assert licences.held_out_accuracy > 0.9
    for text, family in [
        ("Licensed under the Apache License, Version 2.0.", "Apache-2.0"), ("Released under the MIT License.", "MIT"), ("This work is licensed under the GNU General Public License, version 3.", "GPL-3.0"), ("Licensed under CC BY-NC 4.0.", "CC-BY-NC"),
        ("SPDX-License-Identifier: BSD-3-Clause", "BSD-3-Clause"), ("All rights reserved.", None), ("Students at MIT built a robot", None), ("The Apache landed", None), ("", None), ("The Apache helicopter, mark 2, landed.", None),
        ("GNU General Public License as published by the Free Software Foundation, either version 3", "GPL-3.0"), ("Apache License\nVersion 2.0, January 2004", "Apache-2.0"), (WRAPPED, "MIT"), ("# " + WRAPPED.replace("\n", "\n# "), "MIT"),
        ("Redistributions of source code must retain the above copyright\n notice, this list of conditions and the following disclaimer.", "BSD-2-Clause"),
        ("Neither the name of Example Inc. nor the names of its contributors may be used to endorse or promote products derived from this software", "BSD-3-Clause"),
    ]:
        assert [h[2] for h in licences.scan(text)] == ([family] if family else []), text
    rows = [(1, "first.\nReleased under the MIT License.\nlast", "", "", 0, True, 0.0), (2, None, "", "", 0, True, 0.0), (None, "", "", "", 0, True, 0.0), (1, "x y " * 100_000 + "Released under the MIT License." + " x" * 50_000, "", "", 0, True, 0.0)]
    got = license_scan.scan_documents(spark.createDataFrame(rows, SCHEMA).withColumn("hits", F.lit(1)).withColumn("paragraph", F.lit("x")), licences).collect()
    assert sorted([(h.paragraph, h.last, h.family) for h in r.hits] for r in got) == [[], [], [(0, 0, "MIT")], [(1, 1, "MIT")]]
    assert license_scan.scan_documents(spark.createDataFrame([], SCHEMA)).count() == 0


def plain_scan(model, text):
    """Without any shortcut: every window is scored, every template tried at every choice of places."""
    found = []
    for w, lines in license_scan.paragraphs(text):
        for start in range(0, max(1, len(w) - 80), 80):
            part = w[start : start + 160]
            p = model.probabilities(part)
            k = int(np.argmax(p))
            family = model.families[k]
            if not k or p[k] < 0.6:
                continue
            ok = False
            for t in license_scan.TELLING[family]:
                against = ({"by"} if family == "CC0" else license_scan.OTHER) - set(t)
                places = [[i for i, x in enumerate(part) if x == y] for y in t]
                for chosen in product(*places):
                    near = all(0 < b - a <= 13 for a, b in zip(chosen, chosen[1:]))
                    ok |= near and not against & set(part[max(0, chosen[0] - 2) : chosen[-1] + 3])
            texts = {tuple(v[i : i + 3]) for v in map(license_scan.words, license_scan.BODIES.get(family, [])) for i in range(len(v) - 2)}
            own = {tuple(part[i : i + 3]) for i in range(len(part) - 2)} & texts
            if texts and len(own) >= min(12, len(texts)) and any(len(x) >= 9 for t in own for x in t):
                ok = True
            if ok:
                found.append((family, start, lines[start]))
    return found


def test_licences_are_brute_force(spark, licences):
    rnd = random.Random(3)
    vocabulary = "mit license the under apache 2 bsd 3 gnu general public version gpl cc by nc 0 lesser isc mpl . \n \n\n software permission a of work is licensed".split(" ")
    texts = [" ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(1, 12))) for _ in range(500)] + [n.format(x) for n in license_scan.NOTICES for x in ("MIT", "CC0", "LGPLv3", "GPL-2.0", "BSD")]
    texts += [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [h.family for h in r.hits] for r in license_scan.scan_documents(rows, licences).collect()}
    some = 0
    for i, text in enumerate(texts):
        want = plain_scan(licences, text or "")
        some += bool(want)
        assert set(got[i]) == {f for f, _, _ in want} and len(got[i]) <= len(want), text
    assert some > 60


def test_sparse_fit_is_dense_fit():
    rnd = np.random.default_rng(2)
    x = (rnd.random((60, 12)) < 0.3).astype(float)
    x[5] = 0
    y = rnd.integers(0, 3, 60)
    sparse = logistic.Sparse([np.flatnonzero(r).tolist() for r in x], 12)
    a, b = logistic.fit(x, y, 3, rounds=40), logistic.fit(sparse, y, 3, rounds=40)
    assert np.allclose(a[0], b[0]) and np.allclose(a[1], b[1]) and np.allclose(x @ a[0], sparse @ a[0])
