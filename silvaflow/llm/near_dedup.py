"""Near-duplicate documents by order MinHash and banded alignment.

Words are lower-cased runs of letters and digits. Of a document's pieces of K words, each labelled with how often it occurred
before, every hash function picks the PICKED least, and the sketch is these pieces in text order: equal sketches come of
texts whose pieces agree in order, so that they are sensitive to edit similarity. An edit touches K pieces at most, so that
two texts as far apart as LIKE allows share a known number of pieces; sketch_counts() takes as many hash functions as find
such a pair with probability RECALL wherever its edits lie (worst is every fifth word), more for short texts. Labels of a
repeated piece may shift and change the order, which the count leaves out. Texts so short that one edit is all they may differ in have as keys their words and their
words with any one left out, which miss no pair.

Texts with equal words are one item from the start, whatever their number. Items that share a key are candidates:
1. each is paired with the smallest item of its key (one row for each item and key at most);
2. bags(), counts of words in as many bins as bins_of() gives the text, give a lower bound of the edit distance, which drops
   nearly all that aren't alike, long texts as well as short ones;
3. the edit distance of their words, by alignment in a band of diagonals, is at most 1 - LIKE of the longer one's words;
4. the keys whose items are in several components still are compared in cells (see links.py): by bags first, and those rows
   of a cell that may be alike by alignment. No pair that shares a key is left out.

A document without words is alike only those without words. Null text counts as empty. Of a class the row with the smallest
doc_id stays (nulls last, of equal ones the first read). Rows that share a doc_id are rows like others, repeated rows are
copies. doc_id may have any type that sorts. Very long texts are compared whole. Other columns stay as they are, whatever
their names. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import operator
from collections.abc import Iterator, Sequence
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, discard, only, release, slices, trimmed, written
from .links import CELL, cells, classed, components, counted, crowded, each_cell, partners, spanning
from .pretokens import plain

K, LIKE, RECALL, PICKED = 2, 0.8, 0.999, 2
SLICE = 1 << 20
#: As many texts at most follow one copy of their leader's.
TOGETHER = 256
#: Bins of a bag of words (powers of two): least and most as stored, and as made for the rows of one cell.
LEAST_BINS, MOST_BINS, MANY_BINS = 512, 8192, 4096
FAR = np.uint64((1 << 64) - 1)
SEEDS = np.array([(0x9E3779B97F4A7C15 * (2 * i + 1)) & (2**64 - 1) for i in range(1, 65)], np.uint64)


def words_of(text: str | None) -> list[str]:
    """The lower-cased runs of letters and numbers of text."""
    return plain(text).split() if text else []


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    return x ^ (x >> np.uint64(27))


def edits(n: int | np.ndarray, like: float) -> np.ndarray:
    """How many edits a pair may have whose longer text has n words."""
    return np.floor((1 - like) * n + 1e-9).astype(np.int64)


#: From so many words on, texts have the same number of sketches.
LONG = 512


@cache
def sketch_counts(like: float = LIKE, recall: float = RECALL) -> np.ndarray:
    """The number of sketches of a text by its number of words (LONG for all longer ones): enough for every pair that it can
    be the shorter text of; none where one edit is all."""
    needed = np.zeros(2 * LONG + 1, np.int64)
    for n in range(1, len(needed)):
        e = int(edits(n, like))
        if e < 2:
            continue
        both = n - K + 1 - K * e
        every = 2 * (n - K + 1) - both
        if both < PICKED:
            raise ValueError("pairs of this similarity need not share pieces")
        p = np.prod([(both - i) / (every - i) for i in range(PICKED)])
        needed[n] = np.ceil(np.log(1 - recall) / np.log(1 - p))
    out = np.array([needed[n : min(len(needed), int(n / like + 1e-9) + 1)].max() for n in range(LONG)] + [needed[LONG:].max()])
    if out.max() >= len(SEEDS):
        raise ValueError("no number of sketches reaches this recall")
    return np.maximum.accumulate(out[::-1])[::-1] * (out > 0)


def short_keys(words: list[str], like: float = LIKE) -> list[int]:
    """Of a text that may be one edit from another: keys of its words, and of its words with one left out."""
    if not words or edits(len(words), like) > 1:
        return []
    left = [words] + [words[:i] + words[i + 1 :] for i in range(len(words))] * int(edits(len(words), like))
    return sorted({int.from_bytes(hashlib.blake2b(" ".join(w).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little") for w in left})


def sketches(ids: np.ndarray, first: np.ndarray, counts: np.ndarray, k: int = K, picked: int = PICKED) -> np.ndarray:
    """For documents whose word hashes lie one after another in ids, beginning at first (with the end), so many sketches
    each as counts says (zeros follow)."""
    m = int(counts.max()) if len(counts) else 0
    n_docs = len(first) - 1
    size = np.diff(first)
    pieces = np.maximum(size - k + 1, (size > 0).astype(np.int64))
    out = np.zeros((n_docs, m), np.uint64)
    total = int(pieces.sum())
    if not total:
        return out
    doc = np.repeat(np.arange(n_docs), pieces)
    begin = np.concatenate([[0], np.cumsum(pieces)])
    place = first[:-1][doc] + np.arange(total) - begin[:-1][doc]
    h = np.zeros(total, np.uint64)
    for j in range(k):
        at = place + j
        inside = at < first[1:][doc]
        h = h * np.uint64(0x9E3779B97F4A7C15) + np.where(inside, ids[np.minimum(at, len(ids) - 1)], np.uint64(j + 1))
    h = _mixed(h)
    # the label: how many equal pieces of the document come before
    own = h ^ _mixed(doc.astype(np.uint64) + np.uint64(77))
    order = np.argsort(own, kind="stable")
    new = np.concatenate([[True], own[order][1:] != own[order][:-1]])
    label = np.empty(total, np.uint64)
    label[order] = (np.arange(total) - np.maximum.accumulate(np.where(new, np.arange(total), 0))).astype(np.uint64)
    h = h + label * np.uint64(0xD1342543DE82EF95)
    for j in range(m):
        some = np.flatnonzero((pieces > 0) & (counts > j))
        if not len(some):
            break
        if j == 0 or len(some) < len(starts):
            own = h[((pieces > 0) & (counts > j))[doc]]
            starts = np.concatenate([[0], np.cumsum(pieces[some])[:-1]])
            n_own = len(own)
            low = np.uint64((1 << max(16, n_own.bit_length())) - 1)
            at = np.arange(n_own, dtype=np.uint64)
        v = own * SEEDS[j] & ~low | at  # the order of the pieces, and where each is
        chosen = np.zeros((len(some), picked), np.int64)
        for p in range(picked):
            least = np.minimum.reduceat(v, starts)
            chosen[:, p] = np.where(least == FAR, chosen[:, 0], least & low)
            v[chosen[:, p]] = FAR
        chosen.sort(axis=1)  # in text order; a document with fewer pieces repeats one
        key = np.full(len(some), SEEDS[j + 1], np.uint64)
        for p in range(picked):
            key = _mixed(key * np.uint64(0x9E3779B97F4A7C15) + own[np.minimum(chosen[:, p], n_own - 1)])
        out[some, j] = key
    return out


def bags(ids: np.ndarray, sizes: np.ndarray, bins: int) -> np.ndarray:
    """Counts (255 at most) of the words of each text by bin."""
    out, first, own = np.zeros((len(sizes), bins), np.uint8), np.concatenate([[0], np.cumsum(sizes)]), (ids % np.uint64(bins)).astype(np.int64)
    for k in range(0, len(sizes), 64):  # a few texts at a time: counts take eight times the bytes
        p = sizes[k : k + 64]
        at = np.repeat(np.arange(len(p)) * bins, p) + own[first[k] : first[k + len(p)]]
        out[k : k + 64] = np.minimum(np.bincount(at, minlength=len(p) * bins), 255).reshape(len(p), bins)
    return out


def bins_of(sizes: np.ndarray) -> np.ndarray:
    """The bins of the bags of texts by their numbers of words: half as many or more. Where many words share a bin, unlike
    texts have like bags."""
    half = np.clip(-(-sizes // 2), LEAST_BINS, MOST_BINS)
    return 1 << np.ceil(np.log2(half)).astype(np.int64)


def folded(column: list[bytes], bins: int) -> np.ndarray:
    """Stored bags, each of bins bins or more, as bags of bins bins. Both are powers of two, and a bin is a remainder."""
    width = np.fromiter(map(len, column), np.int64, len(column))
    out = np.zeros((len(column), bins), np.uint8)
    for w in np.unique(width).tolist():
        own = np.flatnonzero(width == w)
        x = np.frombuffer(b"".join([column[i] for i in own.tolist()]), np.uint8).reshape(len(own), w // bins, bins)
        out[own] = x[:, 0] if w == bins else np.minimum(x.sum(axis=1, dtype=np.uint16), 255)
    return out


def at_least(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """A lower bound of the edit distance of texts, from their bags (one or many, in the last axis): the words that the one
    text has and the other has not. Bins and cut counts only make it less."""
    both = np.maximum(x, y).sum(axis=-1, dtype=np.int64)
    return both - np.minimum(x.sum(axis=-1, dtype=np.int64), y.sum(axis=-1, dtype=np.int64))


def within(a: Sequence, b: Sequence, most: int) -> int:
    """The edit distance of two rows if it is at most most, else most + 1. Cells of the table of distances further than most
    from the main diagonal are left out. A column of the band is held as bits: where the distance rises or falls from one
    row to the next; the band moves down by a row with each column."""
    if len(a) > len(b):
        a, b = b, a
    n, m = len(a), len(b)
    if m - n > most:
        return most + 1
    head = 0
    while head < n and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < n - head and a[n - 1 - tail] == b[m - 1 - tail]:
        tail += 1
    a, b = a[head : n - tail], b[head : m - tail]
    n, m = len(a), len(b)
    if not n or not most:
        return m if m <= most else most + 1
    places: dict = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    width = 2 * most + 1  # in column j, bit k is row j - most + k
    full = (1 << width) - 1
    up, down = full >> most << most, 0  # rows before the first neither rise nor fall
    slanted = max(0, n - most)  # columns whose band ends above the last row
    distance, last = (most, 1 << (width - 1)) if n >= most else (n, 1 << (n + most))
    hopeless = 2 * most + m - n
    for j, x in enumerate(b):
        hit = places.get(x, 0)
        hit = (hit >> (j - most) if j > most else hit << (most - j)) & full
        level = ((((hit & up) + up) ^ up) | hit | down) & full  # no more than the cell up and to the left
        right = down | (full ^ (level | up))  # more than the cell to the left
        left = level & up
        if j < slanted:
            distance += not level & last
            if distance > hopeless:
                return most + 1
        else:
            last >>= 1
            distance += bool(right & last) - bool(left & last)
        level >>= 1
        up, down = left | (full ^ (level | right)), level & right
    return min(distance, most + 1)


def alike(a: list[str], b: list[str], like: float = LIKE) -> bool:
    """Whether the edit distance of two rows of words is at most 1 - like of the longer."""
    most = int(edits(max(len(a), len(b)), like))
    if len(a) == len(b) and sum(map(operator.ne, a, b)) <= most:
        return True
    return within(a, b, most) <= most


class _Ids(dict):
    """A 64-bit number for each word."""

    def __missing__(self, word: str) -> int:
        if len(self) > 100_000:
            self.clear()
        v = self[word] = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        return v


def _sketched(docs: DataFrame, like: float) -> DataFrame:
    """row (all columns of docs), fp (16 bytes that stand for the words), n_words, bag, keys (the sketches, or the keys of a
    short text)."""
    wanted = sketch_counts(like)

    @trimmed
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Ids()
        for batch in slices(batches, most=SLICE):
            rows, fps, short = [], [], []
            for text in batch.column("text").to_pylist():
                words = words_of(text)
                fps.append(hashlib.md5(" ".join(words).encode("utf-8", "surrogatepass")).digest())
                rows.append(words)
                short.append(np.array(short_keys(words, like), np.uint64))
            size = np.fromiter(map(len, rows), np.int64, len(rows))
            ids = np.fromiter(map(known.__getitem__, chain.from_iterable(rows)), np.uint64, int(size.sum()))
            first = np.concatenate([[0], np.cumsum(size)])
            n = wanted[np.minimum(size, LONG)]
            extra = np.fromiter(map(len, short), np.int64, len(short))
            last = np.zeros((len(rows), int(extra.max(initial=0))), np.uint64)
            for i in np.flatnonzero(extra):
                last[i, : extra[i]] = short[i]
            every = np.concatenate([sketches(ids, first, n), last], axis=1)
            some = np.concatenate([np.arange(every.shape[1] - last.shape[1]) < n[:, None], np.arange(last.shape[1]) < extra[:, None]], axis=1)
            ends = pa.array(np.concatenate([[0], np.cumsum(some.sum(axis=1))]), pa.int32())
            keys = pa.ListArray.from_arrays(ends, pa.array(every[some].view(np.int64)))
            width = bins_of(size)
            bag = np.empty(len(rows), object)
            for w in np.unique(width).tolist():
                bag[width == w] = [x.tobytes() for x in bags(ids[np.repeat(width == w, size)], size[width == w], w)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(fps, pa.binary()), pa.array(size), pa.array(bag, pa.binary()), keys], ["row", "fp", "n_words", "bag", "keys"])

    row = F.struct(*(docs[c] for c in docs.columns)).alias("row")
    kind = docs.select(row).schema["row"].dataType.simpleString()
    return docs.select(row, docs["text"]).mapInArrow(work, f"row {kind}, fp binary, n_words long, bag binary, keys array<long>")


def _maybe(pairs: DataFrame, items: DataFrame, like: float) -> DataFrame:
    """Of pairs (a, b) those that sizes and bags don't tell apart."""

    @trimmed
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(c).to_numpy() for c in ("n_a", "n_b"))
            of_a, of_b = (batch.column(c).to_pylist() for c in ("bag_a", "bag_b"))
            width = np.fromiter(map(min, map(len, of_a), map(len, of_b)), np.int64, len(a))
            least = np.zeros(len(a), np.int64)
            for w in np.unique(width).tolist():
                own = np.flatnonzero(width == w)
                least[own] = at_least(*(folded([column[i] for i in own.tolist()], w) for column in (of_a, of_b)))
            yield batch.select(["a", "b"]).filter(pa.array((least <= edits(np.maximum(a, b), like)) & (np.abs(a - b) <= edits(np.maximum(a, b), like))))

    plain_pairs = pairs
    for c in ("a", "b"):
        own = only(items, plain_pairs.select(F.col(c).alias("item")), "item").select(F.col("item").alias(c), F.col("n_words").alias(f"n_{c}"), F.col("bag").alias(f"bag_{c}"))
        pairs = pairs.join(own.hint("merge"), c)
    return pairs.mapInArrow(work, "a long, b long")


def _verified(pairs: DataFrame, texts: DataFrame, like: float) -> DataFrame:
    """Of pairs (a, b) of items, those whose texts (item, text) are alike. The text of a comes once, followed by those of its
    bs, in one partition; an a with many bs comes once for every TOGETHER of them, in as many partitions."""

    @trimmed
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[str] = []
        for batch in batches:
            good = []
            for first, text in zip(batch.column("first").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words = words_of(text)
                if first:
                    kept = words
                good.append(not first and alike(kept, words, like))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    degree = pairs.groupBy("a").agg(F.ceil(F.count("*") / TOGETHER).cast("int").alias("parts"))
    members = pairs.join(degree.hint("merge"), "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("salt"), F.lit(False).alias("first"), F.col("b").alias("item"))
    leaders = degree.select("a", F.lit(None).cast("long").alias("b"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"), F.lit(True).alias("first"), F.col("a").alias("item"))
    need = cut(members.unionByName(leaders))
    found = only(texts, need, "item").join(need.hint("merge"), "item").select("a", "b", "salt", "first", "text")
    return found.repartition("a", "salt").sortWithinPartitions("a", "salt", F.desc("first"), "b").mapInArrow(work, "a long, b long")


LIVE = "key long, class int, i int, j int, side int, item long, size long, root long"


def _flagged(live: DataFrame, like: float) -> DataFrame:
    """The rows of cells that have a partner there which sizes and bags don't tell apart."""

    @trimmed
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in each_cell(batches):
            size, bag, labels = cell["size"], folded(cell["bag"], min(map(len, cell["bag"]))), cell["root"]
            some = np.zeros(len(size), bool)
            for x in range(len(size) - 1):
                y = partners(cell, labels, x)
                if len(y):
                    y = y[np.abs(size[y] - size[x]) <= edits(np.maximum(size[y], size[x]), like)]
                    y = y[at_least(bag[x], bag[y]) <= edits(np.maximum(size[y], size[x]), like)]
                    some[y] = True
                    some[x] |= len(y) > 0
            if some.any():
                yield pa.RecordBatch.from_arrays([pa.array(cell[c][some]) for c in (*CELL, "side", "item", "size", "root")], [*CELL, "side", "item", "size", "root"])

    return cells(live).select(*CELL, "side", "item", "size", "root", "bag").mapInArrow(work, LIVE)


def _cell_links(rows: DataFrame, like: float) -> DataFrame:
    """The links (a, b) that join what is alike in each cell; rows as _flagged() gives them, with text."""

    @trimmed
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Ids()
        for cell in each_cell(batches):
            words = [words_of(t) for t in cell["text"]]
            size = cell["size"]
            bag = bags(np.fromiter(map(known.__getitem__, chain.from_iterable(words)), np.uint64, sum(map(len, words))), size, MANY_BINS)

            def near(x: int, y: np.ndarray) -> np.ndarray:
                most = edits(np.maximum(size[y], size[x]), like)
                return y[(np.abs(size[y] - size[x]) <= most) & (at_least(bag[x], bag[y]) <= most)]

            found = spanning(cell, cell["root"].copy(), near, lambda x, y: alike(words[x], words[y], like))
            if found:
                a, b = np.array(found).T
                yield pa.RecordBatch.from_arrays([pa.array(cell["item"][a]), pa.array(cell["item"][b])], ["a", "b"])

    return rows.repartition(*CELL).sortWithinPartitions(*CELL, "item").select(*CELL, "side", "item", "size", "root", "text").mapInArrow(work, "a long, b long")


def _roots(rows: DataFrame, items: DataFrame, like: float) -> DataFrame:
    """item, root of the items that have links; rows has the data of each item and of other rows."""
    spark = rows.sparkSession
    bag, texts = rows.select("item", "n_words", "bag"), rows.select("item", F.col("row.text").alias("text"))
    held = written(rows.select("item", "n_words", "keys").join(items.hint("merge"), "item"))
    release(spark)
    crowd = written(counted(classed(crowded(held.select("item", F.col("n_words").alias("size"), F.explode(F.array_distinct("keys")).alias("key"))), like)))
    discard(held)
    release(spark)
    led = crowd.groupBy("key", "class").agg(F.min(F.struct("item", "size")).alias("a"))
    larger = F.greatest("a.size", "size")
    fits = F.abs(F.col("a.size") - F.col("size")) <= F.floor(F.lit(1 - like) * larger + F.lit(1e-9))  # as edits() has it
    pairs = cut(crowd.join(led.hint("merge"), ["key", "class"]).filter(fits & (F.col("a.item") != F.col("item"))).select(F.col("a.item").alias("a"), F.col("item").alias("b")).distinct())
    links = cut(_verified(cut(_maybe(pairs, bag, like)), texts, like))
    release(spark)
    roots = cut(components(links))
    now = crowd.drop("n").join(roots.hint("merge"), "item", "left").withColumn("root", F.coalesce("root", "item"))
    apart = now.groupBy("key", "class").agg(F.count("*").alias("n"), F.min("root").alias("r0"), F.max("root").alias("r1")).filter("r0 != r1").select("key", "class", "n")
    live = written(now.join(apart.hint("merge"), ["key", "class"]))
    discard(crowd)
    flagged = cut(_flagged(live.join(only(bag, live, "item").select("item", "bag").hint("merge"), "item"), like))
    discard(live)
    release(spark)
    more = _cell_links(flagged.join(only(texts, flagged, "item").hint("merge"), "item"), like)
    stars = roots.filter("root != item").select(F.col("root").alias("a"), F.col("item").alias("b"))
    return cut(components(cut(stars.unionByName(more))))


def _classes(docs: DataFrame, like: float) -> tuple[DataFrame, DataFrame]:
    """The written rows of docs (row, rid), and for each its rid, class_id and kept."""
    rows = written(_sketched(docs, like).withColumn("rid", F.monotonically_increasing_id()))
    groups = cut(rows.groupBy("fp").agg(F.min("rid").alias("item")))
    roots = _roots(rows.withColumnRenamed("rid", "item"), groups.select("item"), like)
    whole = groups.join(roots.hint("merge"), "item", "left").select("fp", F.coalesce("root", "item").alias("root"))
    own = cut(rows.select("rid", F.col("row.doc_id").alias("doc_id"), "fp").join(whole.hint("merge"), "fp").select("rid", "doc_id", "root"))
    best = own.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")).alias("best"))
    out = own.join(best.hint("merge"), "root").select("rid", "doc_id", F.col("best.doc_id").alias("class_id"), (F.col("rid") == F.col("best.rid")).alias("kept"))
    return rows, out


def near_classes(docs: DataFrame, like: float = LIKE) -> DataFrame:
    """One row for each of docs: doc_id, class_id (smallest doc_id of the class), kept."""
    rows, out = _classes(docs.select("doc_id", "text"), like)
    out = cut(out)
    discard(rows)
    return out.drop("rid")


def drop_near(docs: DataFrame, like: float = LIKE) -> DataFrame:
    """docs with one row of each class: that of the smallest doc_id."""
    rows, out = _classes(docs, like)
    kept = cut(out.filter("kept").select("rid"))
    return rows.select("rid", "row").join(kept.hint("merge"), "rid").select("row.*")


def op8(spark, sf_dir: str) -> DataFrame:
    return near_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
