"""Near-duplicate paragraphs by MinHash banding.

Words are lower-cased runs of letters and digits. Lines are paragraphs; so that a passage inside a longer line is a unit
too, a line is cut where the hash of two neighbouring words is least within REACH words on either side (the leftmost of
equals), but not within K words of its ends. Such cuts depend on the words around them alone, so that a passage is cut
alike wherever it stands. Lines of fewer than K words are always kept.

Paragraphs of equal words are one item (a 128-bit hash of the words). Items are judged by their sets of K-word shingles:
bands() chooses how many hash functions make a band and how many bands there are, so that a pair of similarity LIKE shares
a band with probability RECALL at least, and any equal pair does. Items that share a band meet in cells (see links.py), where
exact Jaccard similarity of LIKE or more links them; components of links are classes. Of each class the first paragraph
stays (by doc_id with nulls last, then by its place), all others are removed: from its first word to the first word of the
next paragraph of the line, or a whole line with its end if all of it goes.

Null text has no paragraphs. Rows equal in doc_id and text can't be told apart: they share their paragraphs, and what stays in
one stays in all. Rows that share only doc_id are told apart by a hash of the text. doc_id may have any type that sorts. Very
long texts are cut like others. Other columns stay as they are, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, discard, only, release, slices, written
from .links import CELL, cells, classed, components, counted, crowded, each_cell, spanning
from .near_dedup import SEEDS, _Ids, _mixed, at_least, bags, words_of
from .pretokens import plain

WORD = regex.compile(r"[\p{L}\p{N}]+")
K, LIKE, RECALL, MOST_BANDS, REACH = 5, 0.8, 0.999, 8, 12
#: Cells of so many rows at most compare shingles without bags first; bins of a bag of shingles.
FEW, BINS = 8, 1024
SLICE = 1 << 20
FAR = np.uint64((1 << 64) - 1)


def bands(like: float = LIKE, recall: float = RECALL, most: int = MOST_BANDS) -> tuple[int, int]:
    """(bands, rows in each): the most rows, and so the fewest chance pairs, with which at most so many bands still find a
    pair of similarity like with probability recall; of these the fewest bands."""
    for rows in range(20, 0, -1):
        for n in range(1, most + 1):
            if 1 - (1 - like**rows) ** n >= recall:
                return n, rows
    raise ValueError("no number of bands reaches this recall")


def band_keys(ids: np.ndarray, first: np.ndarray, n: int, rows: int, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """For paragraphs of k words or more, whose word hashes lie one after another in ids from first on, n band keys each,
    and the number of different shingles."""
    pieces = np.diff(first) - k + 1
    total = int(pieces.sum())
    out = np.zeros((len(pieces), n), np.uint64)
    if not total:
        return out, pieces
    starts = np.concatenate([[0], np.cumsum(pieces)[:-1]])
    place = np.repeat(first[:-1] - starts, pieces) + np.arange(total)
    h = np.zeros(total, np.uint64)
    for j in range(k):
        h = h * np.uint64(0x9E3779B97F4A7C15) + ids[place + j]
    h = _mixed(h)
    for band in range(n):
        key = np.full(len(pieces), SEEDS[band], np.uint64)
        for r in range(rows):
            least = np.minimum.reduceat(_mixed(h ^ SEEDS[1 + band * rows + r]), starts)
            key = _mixed(key * np.uint64(0x9E3779B97F4A7C15) + least)
        out[:, band] = key
    own = np.repeat(np.arange(len(pieces)), pieces)
    mine = h ^ _mixed(own.astype(np.uint64) + np.uint64(77))
    order = np.argsort(mine, kind="stable")
    new = np.concatenate([[True], mine[order][1:] != mine[order][:-1]])
    return out, np.bincount(own[order][new], minlength=len(pieces))


def shingles(words: list[str], k: int = K) -> set[tuple[str, ...]]:
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}


def jaccard(a: set, b: set) -> float:
    both = len(a & b)
    return both / (len(a) + len(b) - both) if a or b else 1.0


def begins(ids: np.ndarray, size: np.ndarray, reach: int = REACH, k: int = K) -> np.ndarray:
    """Where paragraphs begin in lines of k words or more (their numbers of words in size), whose word hashes lie one after
    another in ids."""
    n, line = len(ids), np.repeat(np.arange(len(size)), size)
    first = np.cumsum(size) - size
    place = np.arange(n) - first[line]
    inner = place > 0
    at = np.arange(n) + reach * (line + 1)  # with a gap before, between and after the lines
    v = np.full(n + reach * (len(size) + 1) + 1, FAR)
    v[at[inner]] = _mixed(ids[:-1] * np.uint64(0x9E3779B97F4A7C15) + ids[1:])[inner[1:]] >> np.uint64(1)
    least, have = v, 1
    while have * 2 <= reach:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if have < reach:
        least = np.minimum(least[: len(least) - (reach - have)], least[reach - have :])
    own = v[at]
    found = (own < least[at - reach]) & (own <= least[np.minimum(at + 1, len(least) - 1)])
    return np.flatnonzero((found & (place >= k) & (size[line] - place >= k)) | (place == 0))


def paragraphs(line: str) -> list[tuple[int, int]]:
    """The paragraphs of a line as ranges of its words."""
    words = words_of(line)
    if len(words) < K:
        return []
    known = _Ids()
    at = begins(np.array([known[w] for w in words], np.uint64), np.array([len(words)])).tolist()
    return list(zip(at, [*at[1:], len(words)], strict=True))


def _paragraphs(rows: DataFrame, n: int, per: int) -> DataFrame:
    """doc_id, fp, line, a, b (range of words), ident (16 bytes that stand for the words), size (different shingles), keys
    and body (the words) of each paragraph."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Ids()
        for batch in slices(batches, most=SLICE):
            of, place, size, words = [], [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                for j, line in enumerate(plain(text or "").split("\n")):
                    own = line.split()
                    if len(own) >= K:
                        words += own
                        of.append(i)
                        place.append(j)
                        size.append(len(own))
            size = np.array(size, np.int64)
            ids = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
            at = begins(ids, size)
            ends = np.append(at[1:], len(ids))[: len(at)]
            line = np.repeat(np.arange(len(size)), size)[at]
            start = (np.cumsum(size) - size)[line]
            keys, shingled = band_keys(ids, np.append(at, len(ids)), n, per)
            bodies = [" ".join(words[x:y]) for x, y in zip(at.tolist(), ends.tolist(), strict=True)]
            ident = [hashlib.md5(x.encode("utf-8", "surrogatepass")).digest() for x in bodies]
            of = pa.array(np.array(of, np.int64)[line])
            for k in range(0, len(at), 1 << 14):
                p = slice(k, k + (1 << 14))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").take(of[p]),
                        batch.column("fp").take(of[p]),
                        pa.array(np.array(place, np.int32)[line[p]]),
                        pa.array((at - start)[p].astype(np.int32)),
                        pa.array((ends - start)[p].astype(np.int32)),
                        pa.array(ident[p], pa.binary()),
                        pa.array(shingled[p].astype(np.int32)),
                        pa.FixedSizeListArray.from_arrays(pa.array(keys[p].view(np.int64).ravel()), n).cast(pa.list_(pa.int64())),
                        pa.array(bodies[p], pa.string()),
                    ],
                    ["doc_id", "fp", "line", "a", "b", "ident", "size", "keys", "body"],
                )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(work, f"doc_id {kind}, fp long, line int, a int, b int, ident binary, size int, keys array<long>, body string")


def _cell_links(rows: DataFrame, like: float) -> DataFrame:
    """The links (a, b) that join what is alike in each cell; rows are crowded rows with body."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for cell in each_cell(batches):
            own = [shingles(x.split(" ")) for x in cell["body"]]
            size, item = cell["size"], cell["item"]
            near = lambda x, y: y
            if len(own) > FEW:
                counts = np.fromiter(map(len, own), np.int64, len(own))
                bag = bags(np.fromiter((hash(x) & 0x7FFFFFFF for s in own for x in s), np.uint64, int(counts.sum())), counts, BINS)

                def near(x: int, y: np.ndarray) -> np.ndarray:
                    # of two sets of n and m, alike ones share like / (1 + like) * (n + m) at least
                    larger = np.maximum(size[y], size[x])
                    most = larger - like / (1 + like) * (size[y] + size[x]) + 1e-9
                    return y[(np.minimum(size[y], size[x]) >= like * larger - 1e-9) & (at_least(bag[x], bag[y]) <= most)]

            found = spanning(cell, np.arange(len(own)), near, lambda x, y: jaccard(own[x], own[y]) >= like)
            for x, y in found:
                a.append(item[x])
                b.append(item[y])
            if len(a) >= 1 << 14:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
                a, b = [], []
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return cells(rows).select(*CELL, "side", "item", "size", "body").mapInArrow(work, "a long, b long")


def _fingerprint(docs: DataFrame):
    return F.xxhash64(F.coalesce(docs["text"], F.lit("")))


def repeated_paragraphs(docs: DataFrame, like: float = LIKE) -> DataFrame:
    """doc_id, fp, line, a, b (range of words of the line), keep_id and goes, of each paragraph that is in a class of two or
    more; one of each class, in the document keep_id, doesn't go."""
    spark = docs.sparkSession
    n, per = bands(like)
    found = _paragraphs(docs.select("doc_id", _fingerprint(docs).alias("fp"), "text"), n, per)
    found = written(found.withColumn("rid", F.monotonically_increasing_id()))
    least = [F.min(F.col("keys")[j]).alias(f"k{j}") for j in range(n)]  # equal in all rows of an ident, as the size is
    groups = written(found.groupBy("ident").agg(F.min("rid").alias("item"), F.count("*").alias("n"), F.min("size").cast("long").alias("size"), *least))
    release(spark)
    # a band at a time, so that no more than one band's keys are shuffled at once
    each = [written(crowded(groups.select("item", "size", F.col(f"k{j}").alias("key")))) for j in range(n)]
    crowd = written(counted(classed(reduce(DataFrame.unionByName, each), like)))
    discard(*each)
    release(spark)
    bodies = found.select(F.col("rid").alias("item"), "body")
    links = cut(_cell_links(crowd.join(only(bodies, crowd, "item").hint("merge"), "item"), like))
    discard(crowd)
    release(spark)
    roots = cut(components(links))
    known = written(groups.select("item", "ident", "n").join(roots.hint("merge"), "item", "left").filter("n > 1 or root is not null").select("ident", F.coalesce("root", "item").alias("class_id")))
    discard(groups)
    spots = cut(found.select("doc_id", "fp", "line", "a", "b", "ident").join(known.hint("merge"), "ident").drop("ident"))
    discard(found, known)
    spot = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "line", "a", "fp")
    first = spots.groupBy("class_id").agg(F.min(spot).alias("keep"))
    goes = ~(F.equal_null("doc_id", "keep.doc_id") & (F.col("line") == F.col("keep.line")) & (F.col("a") == F.col("keep.a")) & (F.col("fp") == F.col("keep.fp")))
    return spots.join(first.hint("merge"), "class_id").select("doc_id", "fp", "line", "a", "b", F.col("keep.doc_id").alias("keep_id"), goes.alias("goes"))


def decisions(docs: DataFrame, like: float = LIKE) -> DataFrame:
    """One row for each of docs: doc_id, fp, n_shared (its paragraphs that are in classes of two or more), removed (line, a
    and b of those that go), keep_ids (the documents with the paragraphs that stay for them)."""
    hits = repeated_paragraphs(docs, like).groupBy("doc_id", "fp").agg(F.sort_array(F.collect_set(F.struct("line", "a", "b", "goes", "keep_id"))).alias("hits"))
    every = docs.select("doc_id", _fingerprint(docs).alias("fp"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    gone = F.filter("hits", lambda x: x.goes)
    joined = every.join(hits.hint("merge"), [F.equal_null(every.doc_id, hits.doc_id), every.fp == hits.fp], "left")
    return joined.select(
        every.doc_id,
        every.fp,
        F.coalesce(F.size("hits"), F.lit(0)).cast("long").alias("n_shared"),
        F.coalesce(F.transform(gone, lambda x: F.struct(x.line, x.a, x.b)), F.array().cast("array<struct<line:int,a:int,b:int>>")).alias("removed"),
        F.coalesce(F.array_sort(F.array_distinct(F.transform(gone, lambda x: x.keep_id))), F.array().cast(f"array<{kind}>")).alias("keep_ids"),
    )


def without(text: str, removed: list[tuple[int, int, int]]) -> str:
    """text without the paragraphs (line, a, b)."""
    gone: dict[int, list[tuple[int, int]]] = {}
    for line, a, b in removed:
        gone.setdefault(line, []).append((a, b))
    out = []
    for k, line in enumerate(text.split("\n")):
        if k in gone:
            starts = [m.start() for m in WORD.finditer(line)]
            if sum(b - a for a, b in gone[k]) >= len(starts):
                continue
            starts = [0, *starts[1:], len(line)]
            for a, b in sorted(gone[k], reverse=True):
                line = line[: starts[a]] + line[starts[b] :]
        out.append(line)
    return "\n".join(out)


def drop_paragraphs(docs: DataFrame, like: float = LIKE) -> DataFrame:
    """docs with the removed paragraphs taken out of text; a text of which nothing is left becomes empty."""
    gone = cut(decisions(docs, like).filter(F.size("removed") > 0).select(F.col("doc_id").alias("d"), F.col("fp").alias("f"), "removed").distinct())
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), docs["doc_id"], _fingerprint(docs).alias("fp"))
    joined = rows.join(gone.hint("merge"), [F.equal_null("doc_id", "d"), F.col("fp") == F.col("f")], "left").select("row", F.col("row.text").alias("text"), "removed")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=SLICE):
            texts = [t if r is None else without(t, [(x["line"], x["a"], x["b"]) for x in r]) for t, r in zip(batch.column("text").to_pylist(), batch.column("removed").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string())], ["row", "text"])

    out = joined.mapInArrow(work, f"row {rows.schema['row'].dataType.simpleString()}, text string")
    return out.select(*(F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns))


def op7(spark, sf_dir: str) -> DataFrame:
    found = decisions(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.select("doc_id", "n_shared", F.size("removed").cast("long").alias("n_removed"), "removed", "keep_ids")
