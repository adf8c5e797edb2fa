"""Licence scans by a trained paragraph classifier.

A paragraph is a run of lines with words, ended by a line without words or by a line that ends a sentence, so that a wrapped
notice is one paragraph; comment signs don't count. A paragraph of over WINDOW words is read in windows that overlap by half.
Its features are one- to three-word pieces of the made training rows (sparse); a multinomial logistic regression gives the
probability of each licence family and of an unknown class. The training rows are made here: names of each family in many
notices, cut passages of the standard texts, each also between words of the corpus; and as unknown sentences that speak of
licences or use the same names otherwise, and lines of a bounded sample of the corpus. Whole notices and sentences are held
out; the probabilities are calibrated (temperature) on them. A family is reported if its probability is SURE or more and the
paragraph agrees with a template of it: the template's telling words in order, at most GAP words between two, and none
beside them that makes another family; or SHARED three-word pieces of the family's standard text. The clauses that the BSD
texts share are reported as BSD-2-Clause, the third clause as BSD-3-Clause. A paragraph or window has one family at most.

The classifier is fitted on at most NEGATIVES corpus lines, each of at most NEGATIVE_CHARS characters (a line that agrees with
a template is left out: nobody labelled it); all paragraphs of all documents are scored but those that can agree with no
template, which changes no result. Null and empty texts have no paragraphs. Texts of any length are read whole. Repeated rows
are rows like others, null doc_ids too. More columns are not looked at. An empty table gives an empty result. Equal
probabilities: the family that stands first in NAMES.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import logistic
from .common import slices

NEGATIVES, NEGATIVE_CHARS, SURE = 1500, 2000, 0.6
WINDOW, GAP, SHARED = 160, 12, 12
SLICE = 1 << 21
WORD = regex.compile(r"\p{L}+|\p{N}+")
SENTENCE_END = regex.compile(r"[.!?][\s\"')\]*/>-]*$")

# Public names, notices and texts of licences.
NAMES = {
    "MIT": ["MIT License", "MIT licence", "The MIT License (MIT)", "Expat License", "MIT"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0", "Apache 2.0 license", "Apache License, Version 2"],
    "BSD-3-Clause": ["BSD 3-Clause License", "3-Clause BSD License", "BSD-3-Clause", "New BSD License", "Modified BSD License"],
    "BSD-2-Clause": ["BSD 2-Clause License", "2-Clause BSD License", "BSD-2-Clause", "Simplified BSD License", "FreeBSD License"],
    "GPL-3.0": ["GNU General Public License, version 3", "GNU General Public License v3.0", "GPL-3.0", "GPLv3", "GNU GPL version 3"],
    "GPL-2.0": ["GNU General Public License, version 2", "GNU General Public License v2.0", "GPL-2.0", "GPLv2", "GNU GPL version 2"],
    "LGPL": ["GNU Lesser General Public License", "LGPL", "LGPL-2.1", "LGPLv3", "GNU Library General Public License"],
    "AGPL": ["GNU Affero General Public License", "AGPL", "AGPL-3.0", "AGPLv3"],
    "MPL-2.0": ["Mozilla Public License, version 2.0", "Mozilla Public License 2.0", "MPL-2.0", "MPL 2.0"],
    "ISC": ["ISC License", "ISC licence", "ISC"],
    "Unlicense": ["The Unlicense", "Unlicense"],
    "CC0": ["CC0 1.0 Universal", "CC0", "Creative Commons Zero", "CC0-1.0"],
    "CC-BY": ["CC BY 4.0", "CC-BY-4.0", "Creative Commons Attribution 4.0 International License", "Creative Commons Attribution License"],
    "CC-BY-SA": ["CC BY-SA 4.0", "CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-NC": ["CC BY-NC 4.0", "CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-NC-SA": ["CC BY-NC-SA 4.0", "CC-BY-NC-SA-4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"],
    "CC-BY-ND": ["CC BY-ND 4.0", "CC-BY-ND-4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"],
    "CC-BY-NC-ND": ["CC BY-NC-ND 4.0", "CC-BY-NC-ND-4.0", "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"],
}
#: Standard texts that do not name their licence.
BODIES = {
    "MIT": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "BSD-2-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ],
    "BSD-3-Clause": ["Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ],
    "CC0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
}
#: Names and versions in the notice of the Free Software Foundation.
FREE = [("GPL-3.0", "General", "3"), ("GPL-2.0", "General", "2"), ("LGPL", "Lesser General", "2.1"), ("LGPL", "Lesser General", "3"), ("LGPL", "Library General", "2"), ("AGPL", "Affero General", "3")]
FREE_NOTICES = [
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} Public License as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version.",
    "This file may be used under the terms of the GNU {} Public License version {} as published by the Free Software Foundation.",
    "You should have received a copy of the GNU {} Public License, version {}, along with this program.",
]
NOTICES = [
    "Licensed under the {}.", "Licensed under {}.", "Released under the {}.", "Released under {}.", "This work is licensed under the {}.", "This work is licensed under a {}.",
    "This file is distributed under the terms of the {}.", "Distributed under the {}, see LICENSE.", "This program is free software; you can redistribute it under the terms of the {}.",
    "SPDX-License-Identifier: {}", "License: {}", "The source code is available under {}.", "Copyright (c) 2020 the authors. Licensed under the {}.", "{}",
    "You may use this text under the {} or any later version.", "Published under {}, all other rights reserved.", "Dual use is permitted according to the {}.",
    "Licensed under the {} (the \"License\"); you may not use this file except in compliance with the License.", "This Source Code Form is subject to the terms of the {}.",
    "Except where otherwise noted, content on this site is licensed under a {}.", "See the file COPYING for the {}.", "We make our data available to all under the terms of {}.",
]
UNKNOWN = [
    "All rights reserved.", "Proprietary and confidential.", "You need a driving license to rent a car.", "The license of the bar was revoked last year.", "He released the dog under the bridge.",
    "This work is the result of three years.", "The software is free of charge for members.", "Version 2.0 of the report adds a chapter.", "Students at MIT built the robot.", "The Apache helicopter landed at noon.",
    "Permission to enter was granted by the owner.", "Public libraries lend books.", "Creative people share a common room.", "See the license for details.", "Licensed under the terms of the agreement between the parties.",
    "This work is licensed.", "Released under the old name.", "The general public welcomed version 3.", "License fees are due in June.", "A copy of the contract is attached.", "Terms and conditions apply.",
    "The Apache tribe moved 2 camps under the mountain.", "Apache web server version 2.4 was released with 2 fixes.", "We run Apache 2 and MySQL on this host.", "A professor from MIT was granted a license to drill.",
    "She studied at MIT under the terms of a scholarship.", "The MIT press released 3 books.", "Researchers licensed the patent to MIT.", "FreeBSD 13 was released in April.", "BSD sockets were released in 1983 with version 4.2.",
    "Mozilla released Firefox 3 to the public.", "Mozilla made a public statement about version 2 of the browser.", "The general public may visit 3 days a week.", "GNU tools were ported to 2 systems.", "The GPL is often discussed in court.",
    "I send you the file, cc by mail to 4 people.", "The letter went out with a cc by 4 pm.", "Creative minds, commons and attribution of works were the 3 themes.", "The ISC conference was held under a tent.", "The ISC committee met to license 3 players.",
    "A fishing licence is sold to the public at the post office.", "Under the license the company may sell 2 products.", "Unauthorized copying of this file is strictly prohibited.", "The software is licensed, not sold, and may not be modified or distributed.",
    "You may not redistribute this software without written permission of the owner.", "Permission to use the hall is granted for 2 hours.", "The above notice shall be posted in all rooms.", "A license agreement between you and the vendor governs the use of this software.",
]
#: Notices and sentences (places modulo 5) that are kept from training.
HELD = 3

_USES = ["licensed", "license", "licence", "released", "identifier", "under", "terms", "compliance", "copying"]


def _attribution(*parts: str) -> list[list[str]]:
    short = {"noncommercial": "nc", "sharealike": "sa", "noderivatives": "nd"}
    apart = {"noncommercial": ["non", "commercial"], "sharealike": ["share", "alike"], "noderivatives": ["no", "derivatives"]}
    return [["cc", "by", *(short[p] for p in parts)], ["creative", "commons", "attribution", *parts], ["creative", "commons", "attribution", *(w for p in parts for w in apart[p])]]


#: For each family the telling words that a notice holds in order.
TELLING = {
    "MIT": [["mit", "license"], ["mit", "licence"], *([u, "mit"] for u in _USES), ["expat"]],
    "Apache-2.0": [["apache", "2"]],
    "BSD-3-Clause": [["bsd", "3"], ["3", "bsd"], ["new", "bsd"], ["modified", "bsd"]],
    "BSD-2-Clause": [["bsd", "2"], ["2", "bsd"], ["simplified", "bsd"], ["freebsd"]],
    "GPL-3.0": [["general", "public", "3"], ["gpl", "3"], ["gplv", "3"]],
    "GPL-2.0": [["general", "public", "2"], ["gpl", "2"], ["gplv", "2"]],
    "LGPL": [["lesser", "general", "public"], ["library", "general", "public"], ["lgpl"], ["lgplv"]],
    "AGPL": [["affero", "general", "public"], ["agpl"], ["agplv"]],
    "MPL-2.0": [["mozilla", "public", "2"], ["mpl", "2"]],
    "ISC": [["isc", "license"], ["isc", "licence"], *([u, "isc"] for u in _USES)],
    "Unlicense": [["unlicense"]],
    "CC0": [["cc", "0"], ["creative", "commons", "zero"]],
    "CC-BY": _attribution(),
    "CC-BY-SA": _attribution("sharealike"),
    "CC-BY-NC": _attribution("noncommercial"),
    "CC-BY-NC-SA": _attribution("noncommercial", "sharealike"),
    "CC-BY-ND": _attribution("noderivatives"),
    "CC-BY-NC-ND": _attribution("noncommercial", "noderivatives"),
}
#: Words within or beside a template's words that make another family.
OTHER = {"nc", "noncommercial", "sa", "sharealike", "nd", "noderivatives", "lesser", "library", "affero"}


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def pieces(w: list[str]) -> set[str]:
    return {" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)}


def triples(w: list[str]) -> list[tuple[str, ...]]:
    return list(zip(w, w[1:], w[2:]))


BODY_TRIPLES = {f: set().union(*(triples(words(b)) for b in bodies)) for f, bodies in BODIES.items()}
#: A body is looked for only where one of its long words stands; SHARED pieces must hold one.
BODY_WORDS = {f: {w for t in ts for w in t if len(w) >= 9} for f, ts in BODY_TRIPLES.items()}
#: Of each template its longest word: a paragraph without any of these agrees with nothing.
NEEDED = {max(t, key=lambda x: (len(x), x)) for ts in TELLING.values() for t in ts} | set().union(*BODY_WORDS.values())


def in_order(w: list[str], template: list[str], against: set[str]) -> tuple[int, int] | None:
    """First and last place of the template's words in w, at most GAP words between two; none of against in or beside them."""
    spans = {i: i for i, x in enumerate(w) if x == template[0]}
    for t in template[1:]:
        step: dict[int, int] = {}
        for end, start in spans.items():
            for i in range(end + 1, min(len(w), end + GAP + 2)):
                if w[i] == t:
                    step[i] = max(step.get(i, -1), start)
        spans = step
    for end, start in sorted(spans.items(), key=lambda s: (s[0] - s[1], s[1])):
        if not against.intersection(w[max(0, start - 2) : end + 3]):
            return start, end
    return None


def agrees(w: list[str], family: str) -> tuple[int, int] | None:
    """The places of the words by which w agrees with a template of the family."""
    own = set(w)
    for t in TELLING[family]:
        if own.issuperset(t):
            span = in_order(w, t, ({"by"} if family == "CC0" else OTHER) - set(t))
            if span:
                return span
    known = BODY_TRIPLES.get(family)
    if known and own & BODY_WORDS[family]:
        places = [i for i, t in enumerate(triples(w)) if t in known]
        if len({tuple(w[i : i + 3]) for i in places}) >= min(SHARED, len(known)) and BODY_WORDS[family].intersection(x for i in places for x in w[i : i + 3]):
            return places[0], places[-1] + 2
    return None


def made_rows() -> tuple[list[list[str]], list[str], list[bool]]:
    """Training paragraphs as words, their families ("unknown" too), and whether they are held out."""
    rows: list[tuple[list[str], str, bool]] = []
    rnd = random.Random(5)
    for k, notice in enumerate(NOTICES):
        rows += [(words(notice.format(n)), f, k % 5 == HELD) for f, names in NAMES.items() for n in names if notice != "{}" or len(words(n)) > 1]
    for k, notice in enumerate(FREE_NOTICES):
        rows += [(words(notice.format(n, v)), f, k % 5 == HELD) for f, n, v in FREE for _ in range(4)]
    for f, bodies in BODIES.items():
        for body in bodies:
            w = words(body)
            for k in range(15):
                n = rnd.randint(min(len(w), 14), len(w))
                at = rnd.randint(0, len(w) - n)
                rows.append((w if k < 3 else w[at : at + n], f, k % 5 == HELD))
    for k, text in enumerate(UNKNOWN):
        rows += [(words(text), "unknown", k % 5 == HELD)] * 4
    return [r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows]


class Licences:
    """The classifier. negatives are lines of the corpus."""

    def __init__(self, negatives: list[str]):
        self.families = ["unknown", *NAMES]
        rows, families, held = made_rows()
        plain = [w for w in map(words, dict.fromkeys(negatives)) if w and not any(agrees(w[:WINDOW], f) for f in NAMES)]
        rnd = random.Random(7)
        seen: dict[str, int] = {}
        for w, h in zip(rows, held):
            for p in () if h else pieces(w):
                seen[p] = seen.get(p, 0) + 1
        self.index = {p: i for i, p in enumerate(sorted(p for p, n in seen.items() if n > 1))}
        noise = [w for w in plain if len(w) > 3] or [["a"]]
        for w, f, h in list(zip(rows, families, held)):
            before, after = rnd.choice(noise), rnd.choice(noise)
            a, b = rnd.randint(0, 40), rnd.randint(0, 40)
            rows.append(before[len(before) - min(a, len(before)) :] + w + after[:b])
            families.append(f)
            held.append(h)
        for k, w in enumerate(plain):
            rows.append(w[:WINDOW])
            families.append("unknown")
            held.append(k % 5 == HELD)
        y, apart = np.array([self.families.index(f) for f in families]), np.array(held)
        hits = [sorted(self.index[p] for p in pieces(w) if p in self.index) for w in rows]
        x = logistic.Sparse([h for h, a in zip(hits, apart) if not a], len(self.index))
        z = logistic.Sparse([h for h, a in zip(hits, apart) if a], len(self.index))
        self.w, self.b = logistic.fit(x, y[~apart], len(self.families), ridge=1e-4, rounds=150)
        scores = z @ self.w + self.b
        self.temperature = logistic.temperature(scores, y[apart])
        self.held_out_accuracy = float((np.argmax(scores, axis=1) == y[apart]).mean())
        self.w = self.w.astype(np.float32)

    def probabilities(self, w: list[str]) -> np.ndarray:
        own = sorted(self.index[p] for p in pieces(w) if p in self.index)
        return logistic.softmax((self.w[own].sum(axis=0, dtype=np.float64) + self.b)[None, :] / self.temperature)[0]

    def window(self, w: list[str]) -> tuple[str, float, int, int] | None:
        """Family, probability and places of the confirming words of one window; None if unknown."""
        if NEEDED.isdisjoint(w):
            return None
        spans = [agrees(w, f) for f in NAMES]
        if not any(spans):
            return None
        p = self.probabilities(w)
        k = int(np.argmax(p))
        if k and p[k] >= SURE and spans[k - 1]:
            return self.families[k], float(p[k]), *spans[k - 1]
        return None

    def scan(self, text: str) -> list[tuple[int, int, str, float]]:
        """First line, last line, family and probability of each licence paragraph of a text."""
        found: list[tuple[int, int, str, float]] = []
        for w, lines in paragraphs(text):
            for start in range(0, max(1, len(w) - WINDOW // 2), WINDOW // 2):
                hit = self.window(w[start : start + WINDOW])
                if hit:
                    first, last = lines[start + hit[2]], lines[start + hit[3]]
                    same = [i for i, f in enumerate(found[-3:], max(0, len(found) - 3)) if f[2] == hit[0] and first <= f[1] + 1]
                    if same:
                        a, b, f, p = found[same[-1]]
                        found[same[-1]] = (min(a, first), max(b, last), f, max(p, hit[1]))
                    else:
                        found.append((first, last, hit[0], hit[1]))
        return found


def paragraphs(text: str) -> Iterator[tuple[list[str], list[int]]]:
    """The words of each paragraph with the line of each word."""
    w: list[str] = []
    lines: list[int] = []
    for k, line in enumerate(text.split("\n")):
        own = words(line)
        w += own
        lines += [k] * len(own)
        if w and (not own or SENTENCE_END.search(line[-40:])):
            yield w, lines
            w, lines = [], []
    if w:
        yield w, lines


def trained(docs: DataFrame) -> Licences:
    """The classifier, with negatives from the lines of a bounded sample of docs: those of least hash."""
    lines = docs.select(F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line")).filter(F.length("line").between(1, NEGATIVE_CHARS))
    rows = lines.orderBy(F.xxhash64("line"), "line").limit(NEGATIVES).collect()
    return Licences([r.line for r in rows])


HITS = "array<struct<paragraph: int, last: int, family: string, probability: double>>"


def scan_documents(docs: DataFrame, model: Licences | None = None) -> DataFrame:
    """doc_id and hits, the licence paragraphs of each row of docs: first and last line, family, probability."""
    model = model or trained(docs)
    kind = pa.list_(pa.struct([("paragraph", pa.int32()), ("last", pa.int32()), ("family", pa.string()), ("probability", pa.float64())]))
    near = "(?i)(?:^|[^a-z])(?:" + "|".join(sorted(NEEDED)) + ")(?:[^a-z]|$)"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=SLICE):
            text = pc.fill_null(batch.column("text"), "")
            close = pc.match_substring_regex(text, near).to_pylist()
            out = []
            for i, look in enumerate(close):
                hits = model.scan(text[i].as_py()) if look else []
                out.append([{"paragraph": a, "last": b, "family": f, "probability": round(p, 6)} for a, b, f, p in hits])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, kind)], ["doc_id", "hits"])

    return docs.select("doc_id", "text").mapInArrow(work, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, hits {HITS}")


def op5(spark, sf_dir: str) -> DataFrame:
    found = scan_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    columns = [("paragraphs", "paragraph"), ("last_lines", "last"), ("families", "family"), ("probabilities", "probability")]
    return found.select("doc_id", F.size("hits").cast("long").alias("n_hits"), *(F.col(f"hits.{c}").alias(n) for n, c in columns))
