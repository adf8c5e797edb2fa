"""Removing repeated byte strings by column-wise multi-document suffix sorting.

Each byte covered by a string of LENGTH bytes that also starts in a document with a smaller doc_id is removed. Strings are
judged on the input; matches never cross documents.

1. Anchors: of the SEED-byte pieces in each string of LENGTH bytes, the one of least hash (the leftmost of equals) is its
   anchor. Equal strings have equal anchors at equal places, so that a string can only be repeated if its anchor's piece is
   in two documents. Successive strings mostly share their anchor, so that there are few anchors.
2. A string holds HALF bytes before its anchor's piece or more than HALF - 1 behind it, and so the piece with the SEED bytes
   on that side. Strings whose 2 * SEED bytes are in one document only are dropped: tags of these bytes travel, not contexts.
3. For each anchor, the bytes of the strings left that have it form one context, the anchor at a fixed column. The contexts
   that share a piece meet in one partition and are suffix-sorted column by column, from the last to the first: each round
   inserts one symbol of every context in front of its suffix. The symbols in the order of the suffixes are the collection's
   Burrows-Wheeler transform, and a stable sort of it gives the next order; common prefixes of neighbours are updated from
   the least of those between. Neighbours with a common prefix of LENGTH at a column are equal strings; the least doc_id
   of such a run is known, and strings of the others are removed.
4. Removed stretches go back to their documents, where they are joined.

A piece in more than about MANY documents would bring too many contexts together: its strings are compared as grouping
keys instead, aggregated where they lie. Partitions are as large as the shuffle makes them and hold everything of a round
in memory, in place of sequential external files.

Null text counts as empty. Rows that share a doc_id never remove from each other. A null doc_id counts as the greatest.
An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, join_bearing_hot, only, release, slices, written

LENGTH, SEED = 50, 16
MANY, SAMPLE = 1 << 18, 64
SLICE, CHUNK = 1 << 21, 1 << 24
#: Strings that begin so many bytes before their anchor, or more, are told by the left side, others by the right.
HALF = (LENGTH - SEED + 1) // 2
#: Tags and bytes of contexts that a task gathers before it packs them, so that blocks stay large when there are many.
TAGS, GATHERED = 1 << 21, 1 << 25
LAST = (1 << 63) - 1
_BYTE = np.random.Generator(np.random.PCG64(5)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _runs(data: np.ndarray, valid: np.ndarray, length: int, seed: int) -> tuple[np.ndarray, ...]:
    """Of the strings of data that begin where valid (len(data) - length + 1 flags): for each run of successive ones with one
    anchor the anchor's place and hash, the first and last beginning, and the hashes of the anchor's piece with as many bytes
    before it, and behind it (of no meaning where no string of the run is told by that side)."""
    n = len(data) - length + 1
    none = np.zeros(0, np.int64)
    if n <= 0 or not valid.any():
        return (none,) * 6
    h, have, base = _BYTE[data], 1, 0x9E3779B97F4A7C15
    while have * 2 <= seed:
        h = h[:-have] * np.uint64(pow(base, have, 1 << 64)) + h[have:]
        have *= 2
    if have != seed:
        raise ValueError("seed must be a power of two")
    raw, h = h, _spread(h)
    width, low = length - seed + 1, np.uint64((1 << 26) - 1)
    key = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    have = 1
    while have * 2 <= width:
        key = np.minimum(key[:-have], key[have:])
        have *= 2
    if have < width:
        key = np.minimum(key[: len(key) - (width - have)], key[width - have :])
    at = (key & low).astype(np.int64)
    begins = np.flatnonzero(valid)
    own = at[begins]
    new = np.concatenate([[True], (own[1:] != own[:-1]) | (np.diff(begins) != 1)])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(begins)) - 1
    a, factor, most = own[first], np.uint64(pow(base, seed, 1 << 64)), len(raw) - 1
    left = _spread(raw[np.maximum(a - seed, 0)] * factor + raw[a])
    right = _spread(raw[a] * factor + raw[np.minimum(a + seed, most)] ^ np.uint64(base))
    return a, h[a].view(np.int64), begins[first], begins[last], left, right


def _spread(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def anchors(texts: list[bytes], length: int = LENGTH, seed: int = SEED) -> tuple[np.ndarray, ...]:
    """All texts' bytes, and for each run: its text's index, the anchor's place, its hash, the first and last beginning, and
    the hashes of both sides."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(size)
    valid = np.zeros(max(0, len(data) - length + 1), bool)
    if len(valid):
        mark = np.zeros(len(data) + 1, np.int32)
        some = size >= length
        np.add.at(mark, (ends - size)[some], 1)
        np.add.at(mark, (ends - length + 1)[some], -1)
        valid = np.cumsum(mark[: len(valid)]) > 0
    parts = []
    for p in range(0, len(valid), CHUNK):
        a, h, f, t, *sides = _runs(data[p : p + CHUNK + length - 1], valid[p : p + CHUNK], length, seed)
        parts.append((a + p, h, f + p, t + p, *sides))
    a, h, f, t, left, right = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),) * 2
    return data, np.searchsorted(ends, f, "right"), a, h, f, t, left, right


def repeated(columns: np.ndarray, low: np.ndarray, high: np.ndarray, doc: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Column-wise suffix sorting of the rows of columns. For each row and each column up to the last at which a string of
    length can begin: whether that string, if it lies between low and high (first and last beginning), also begins at this
    column in a row of a smaller doc."""
    n, width = columns.shape
    starts = width - length + 1
    out = np.zeros((n, starts), bool)
    order = np.arange(n)  # rows in the order of their suffixes
    common = np.zeros(n, np.uint8)  # with the suffix before in this order; all are equal (empty) at the end
    common[1:] = 255
    for c in range(width - 1, -1, -1):
        transform = columns[order, c]  # the symbols before the suffixes sorted so far
        move = np.argsort(transform, kind="stable")
        sorted_symbols = transform[move]
        # common prefixes of new neighbours: one more than the least between their old places, or none
        levels = [common]
        while 2 << (len(levels) - 1) <= n:
            step = 1 << (len(levels) - 1)
            levels.append(np.minimum(levels[-1][:-step], levels[-1][step:]))
        left, right = move[:-1] + 1, move[1:]
        same = sorted_symbols[1:] == sorted_symbols[:-1]
        span = np.where(same, right - left + 1, 1)
        level = np.frexp(span.astype(np.float64))[1] - 1
        fresh = np.zeros(n, np.uint8)
        for k in np.unique(level[same]).tolist():
            q = np.flatnonzero(same & (level == k))
            least = np.minimum(levels[k][left[q]], levels[k][right[q] - (1 << k) + 1])
            fresh[q + 1] = np.minimum(least, 254) + 1
        order, common = order[move], fresh
        if c < starts:
            live = (low[order] <= c) & (high[order] >= c)
            owner = np.where(live, doc[order], LAST)
            group = np.flatnonzero(common < length)
            least = np.minimum.reduceat(owner, group)
            least = np.repeat(least, np.diff(np.append(group, n)))
            out[order, c] = live & (least < owner)
    return out


def _doc_key() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))


def _anchored(docs: DataFrame) -> DataFrame:
    """h, doc of each distinct anchor piece of each document."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=SLICE):
            doc = batch.column("doc").to_numpy()
            texts = [x or b"" for x in batch.column("text").to_pylist()]
            _, of, _, h, *_ = anchors(texts)
            keep = np.lexsort((h, of))
            of, h = of[keep], h[keep]
            new = np.concatenate([[True], (of[1:] != of[:-1]) | (h[1:] != h[:-1])]) if len(h) else np.zeros(0, bool)
            yield pa.RecordBatch.from_arrays([pa.array(h[new]), pa.array(doc[of[new]])], ["h", "doc"])

    return docs.mapInArrow(work, "h long, doc long")


#: Tags and contexts travel in blocks, one for each share of the hashes and each so many of a task: columns one after another,
#: byte by byte, compressed. There are SHARES shares for each shuffle partition, so that partitions grow as small as the
#: cluster is told to make them. Contexts of the pieces in very many documents are in blocks of bucket OFTEN.
SHARES, OFTEN = 4, -1
BLOCK = "bucket int, block binary"
TAG, CONTEXT = (np.int64, np.uint32), (np.int64, np.int64, np.int32, np.uint8, np.uint8)


def pack(columns: list[np.ndarray], kinds: tuple, rest: bytes = b"") -> bytes:
    """Columns, of which the first is mostly in order, and more bytes as one compressed block."""
    parts = [len(columns[0]).to_bytes(4, "little")]
    for k, (c, t) in enumerate(zip(columns, kinds, strict=True)):
        c = np.ascontiguousarray(np.diff(c, prepend=0) if k == 0 else c, t)
        parts.append(c.view(np.uint8).reshape(len(c), -1).T.tobytes())
    return zstandard.ZstdCompressor(level=3).compress(b"".join(parts) + rest)


def unpack(block: bytes, kinds: tuple) -> tuple[list[np.ndarray], bytes]:
    raw = zstandard.ZstdDecompressor().decompress(block)
    n, at, out = int.from_bytes(raw[:4], "little"), 4, []
    for k, t in enumerate(kinds):
        wide = np.dtype(t).itemsize
        c = np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * wide, at).reshape(wide, n).T).view(t).ravel()
        out.append(np.cumsum(c) if k == 0 else c)
        at += n * wide
    return out, raw[at:]


def _shares_of(bucket: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """Each bucket and its places, in order."""
    order = np.argsort(bucket.astype(np.uint16) if len(bucket) and 0 <= bucket.min() and bucket.max() < 1 << 16 else bucket, kind="stable")
    held, edges = np.unique(bucket[order], return_index=True)
    return list(zip(held.tolist(), np.split(order, edges[1:]), strict=True)) if len(held) else []


def _sides(a: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether runs have strings told by the left side, and by the right."""
    return first <= a - HALF, last > a - HALF


def _tag(side: np.ndarray) -> np.ndarray:
    return (side >> np.uint64(32)).astype(np.uint32)


def _tagged(docs: DataFrame, shares: int, often: list[int]) -> DataFrame:
    """Blocks of doc, tag: of each side that tells a string of a document, but for the pieces often."""
    apart = np.array(sorted(often), np.int64)

    def packed(parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        doc, side = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(doc, kind="stable")
        doc, side = doc[order], side[order]
        tag, found = _tag(side), _shares_of((side & np.uint64(0xFFFFFFFF)).astype(np.int64) % shares)
        return pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.int32()), pa.array([pack([doc[p], tag[p]], TAG) for _, p in found], pa.binary())], ["bucket", "block"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, n = [], 0
        for batch in slices(batches, most=SLICE):
            doc = batch.column("doc").to_numpy()
            _, of, a, h, first, last, left, right = anchors([x or b"" for x in batch.column("text").to_pylist()])
            some = np.stack(_sides(a, first, last), 1)
            if len(apart):
                some &= ~np.isin(h, apart)[:, None]
            some = some.ravel()
            parts.append((doc[np.repeat(of, 2)[some]], np.stack([left, right], 1).ravel()[some]))
            n += len(parts[-1][0])
            if n >= TAGS:
                yield packed(parts)
                parts, n = [], 0
        if n:
            yield packed(parts)

    return docs.mapInArrow(work, BLOCK)


def _shared(tagged: DataFrame) -> DataFrame:
    """Of blocks of doc, tag those rows whose tag is in two documents at least. Each partition holds all rows of its tags."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[int, list[bytes]] = {}
        for batch in batches:
            for k, block in zip(batch.column("bucket").to_pylist(), batch.column("block").to_pylist(), strict=True):
                blocks.setdefault(k, []).append(block)
        for k in list(blocks):
            doc, tag = (np.concatenate(x) for x in zip(*(unpack(b, TAG)[0] for b in blocks.pop(k)), strict=True))
            order = np.argsort(tag, kind="stable")
            doc, tag = doc[order], tag[order]
            first = np.flatnonzero(np.concatenate([[True], tag[1:] != tag[:-1]]))
            many = np.repeat(np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first), np.diff(np.append(first, len(tag))))
            tag, doc = tag[many].view(np.int32), doc[many]  # a filter only: half of the hash is enough
            for k in range(0, len(tag), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(tag[k : k + (1 << 16)]), pa.array(doc[k : k + (1 << 16)])], ["tag", "doc"])

    return tagged.repartition("bucket").mapInArrow(work, "tag int, doc long")


def _contexts(rows: DataFrame, shares: int, often: list[int]) -> DataFrame:
    """From doc, fp, text, tags: for each run the bytes of its strings whose side is among tags (of all, if its piece is among
    often), where they begin in the text, and in which column of the matrix (the anchor lies in column LENGTH - SEED)."""
    apart = np.array(sorted(often), np.int64)

    def packed(parts: list[tuple]) -> pa.RecordBatch:
        *columns, context = zip(*parts, strict=True)
        bucket, *columns = (np.concatenate(x) for x in columns)
        context = [x for part in context for x in part]
        found = _shares_of(bucket)
        return pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.int32()), pa.array([pack([c[p] for c in columns], CONTEXT, b"".join(map(context.__getitem__, p.tolist()))) for _, p in found], pa.binary())], ["bucket", "block"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, n = [], 0
        for batch in slices(batches, most=SLICE):
            doc, fp = batch.column("doc").to_numpy(), batch.column("fp").to_numpy()
            texts = [x or b"" for x in batch.column("text").to_pylist()]
            data, of, a, h, first, last, left, right = anchors(texts)
            begin = np.concatenate([[0], np.cumsum([len(x) for x in texts])])
            lists = batch.column("tags")
            size = np.diff(lists.offsets.to_numpy())
            tags, owner = lists.flatten().to_numpy(), np.repeat(np.arange(len(texts)), size)
            wanted = np.unique(tags.astype(np.int64) & 0xFFFFFFFF | owner << 32)

            def among(side: np.ndarray) -> np.ndarray:
                mine = _tag(side).astype(np.int64) | of << 32  # a chance hit only adds a context that no other shares
                at = np.minimum(np.searchsorted(wanted, mine), max(0, len(wanted) - 1))
                return wanted[at] == mine if len(wanted) else np.zeros(len(mine), bool)

            hot = np.isin(h, apart) if len(apart) else np.zeros(len(h), bool)
            by_left, by_right = (x & (among(side) | hot) for x, side in zip(_sides(a, first, last), (left, right), strict=True))
            first = np.where(by_left, first, np.maximum(first, a - HALF + 1))
            last = np.where(by_right, last, np.minimum(last, a - HALF))
            keep = np.flatnonzero(by_left | by_right)
            of, a, h, first, last, hot = of[keep], a[keep], h[keep], first[keep], last[keep], hot[keep]
            raw = data.tobytes()
            context = [raw[x:y] for x, y in zip(first.tolist(), (last + LENGTH).tolist(), strict=True)]
            columns = (doc[of], fp[of], first - begin[of], LENGTH - SEED - (a - first), last + LENGTH - first)
            parts.append((np.where(hot, OFTEN, h % shares), *columns, context))
            n += int(columns[-1].sum()) + 100 * len(keep)
            if n >= GATHERED:
                yield packed(parts)
                parts, n = [], 0
        if n:
            yield packed(parts)

    return rows.mapInArrow(work, BLOCK)


def _by_string(blocks: DataFrame) -> DataFrame:
    """The contexts of the pieces in very many documents, as rows."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.column("block").to_pylist():
                (doc, fp, start, _, size), raw = unpack(block, CONTEXT)
                end = np.cumsum(size.astype(np.int64))
                contexts = [raw[e - z : e] for e, z in zip(end.tolist(), size.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(fp), pa.array(start.astype(np.int64)), pa.array(contexts, pa.binary())], ["doc", "fp", "start", "context"])

    return blocks.filter(F.col("bucket") == OFTEN).mapInArrow(work, "doc long, fp long, start long, context binary")


REMOVED = "doc long, fp long, start long, stop long"


def _stretches(blocks: DataFrame) -> DataFrame:
    """The stretches to remove, but for the pieces in very many documents. Each partition holds all contexts of its buckets."""
    width = 2 * LENGTH - SEED

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, bytes_of = [], []
        for batch in batches:
            for block in batch.column("block").to_pylist():
                columns, raw = unpack(block, CONTEXT)
                parts.append(columns)
                bytes_of.append(raw)
        if not sum(len(x[0]) for x in parts):
            return
        doc, fp, start, low, size = (np.concatenate(x) for x in zip(*parts, strict=True))
        data = np.frombuffer(b"".join(bytes_of), np.uint8)
        del parts, bytes_of
        start, low, size = start.astype(np.int64), low.astype(np.int64), size.astype(np.int64)
        columns = np.zeros((len(doc), width), np.uint8)
        offset = np.cumsum(size) - size
        for k in range(0, len(doc), 1 << 14):  # a few rows at a time: the places take eight times the bytes
            p = slice(k, k + (1 << 14))
            a, b = int(offset[k]), int(offset[p][-1] + size[p][-1])
            columns.ravel()[np.repeat(np.arange(k, k + len(size[p])) * width + low[p] - offset[p], size[p]) + np.arange(a, b)] = data[a:b]
        del data
        out = repeated(columns, low, low + size - LENGTH, doc)
        del columns
        edge = np.diff(np.pad(out, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        row, a = np.nonzero(edge == 1)
        _, b = np.nonzero(edge == -1)
        begin = start[row] + a - low[row]
        stop = start[row] + b - 1 - low[row] + LENGTH
        for k in range(0, len(row), 1 << 16):
            p = slice(k, k + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array(x[p]) for x in (doc[row], fp[row], begin, stop)], ["doc", "fp", "start", "stop"])

    return blocks.filter(F.col("bucket") != OFTEN).repartition("bucket").mapInArrow(work, REMOVED)


def _stretches_by_string(contexts: DataFrame) -> DataFrame:
    """The same for contexts of pieces in very many documents, given as rows: every string is a grouping key."""
    n = F.octet_length("context") - LENGTH
    each = contexts.select("doc", "fp", "start", "context", F.explode(F.sequence(F.lit(0), n)).alias("i"))
    each = each.select("doc", "fp", (F.col("start") + F.col("i")).alias("start"), F.substring(F.col("context"), F.col("i") + 1, F.lit(LENGTH)).alias("string"))
    least = each.groupBy("string").agg(F.min("doc").alias("least"), F.max("doc").alias("most"), F.count("*").alias("n")).filter("least < most")
    return join_bearing_hot(each, cut(least), ["string"]).filter("doc > least").select("doc", "fp", "start", (F.col("start") + LENGTH).alias("stop"))


def _finished(rows: DataFrame) -> DataFrame:
    """From doc_id, fp, whole (whether all goes), text, cuts: each document with its stretches to remove, joined, and the bytes
    that stay."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=SLICE):
            spans, kept = [], []
            for fp, whole, text, cuts in zip(*(batch.column(c).to_pylist() for c in ("fp", "whole", "text", "cuts")), strict=True):
                text, joined, rest, at = text or b"", [], [], 0
                own = [(0, len(text))] if whole else sorted((c["start"], c["stop"]) for c in cuts or () if c["fp"] == fp)
                for s, e in own:
                    if joined and s <= joined[-1][1]:
                        joined[-1][1] = max(joined[-1][1], e)
                    else:
                        joined.append([s, e])
                for s, e in joined:
                    rest.append(text[at:s])
                    at = e
                rest.append(text[at:])
                spans.append(joined)
                kept.append(b"".join(rest))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(x or b"") for x in batch.column("text").to_pylist()], pa.int64()), pa.array(spans, pa.list_(pa.list_(pa.int64()))), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(work, f"doc_id {kind}, n_bytes long, spans array<array<long>>, kept binary")


def remove_repeats(docs: DataFrame, many: int = MANY) -> DataFrame:
    """doc_id, n_bytes, spans ([begin, end) of the removed runs, in bytes) and kept (the bytes that stay)."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = read = docs.select("doc_id", _doc_key().alias("doc"), F.xxhash64(text).alias("fp"), text.alias("text"))
    # a document whose whole text is that of a smaller doc_id goes whole, and adds nothing to what others lose
    marks = written(rows.select("doc", F.unhex(F.sha2("text", 256)).alias("sha"), "fp").distinct())
    least = marks.groupBy("sha").agg(F.min("doc").alias("least"), F.count("*").alias("n")).filter("n > 1")
    copies = cut(join_bearing_hot(marks, cut(least), ["sha"]).filter("doc > least").select("doc", "fp"))
    # fp only tells rows apart that share a doc_id; others go without it
    told = marks.select("doc", F.lit(None).cast("long").alias("gone")).unionByName(copies.select("doc", F.col("fp").alias("gone")))
    told = told.groupBy("doc").agg(F.collect_set("gone").alias("gone"), (F.count_if(F.col("gone").isNull()) > 1).alias("several"))
    told = written(told.filter("several or size(gone) > 0"))
    alone = marks.join(copies, ["doc", "fp"], "left_anti").select("doc")
    # every use of the texts has the same columns and the same key, so that they are shuffled once
    rows = rows.join(told.hint("merge"), "doc", "left")
    whole = F.coalesce(F.array_contains("gone", F.col("fp")), F.lit(False)).alias("whole")
    rows = rows.select("doc_id", "doc", F.when(F.col("several"), F.col("fp")).otherwise(0).alias("fp"), whole, "text")
    own = rows.filter(~F.col("whole"))
    # pieces in very many documents, by a sample of documents: known to be shared, and grouped by string later on
    some = _anchored(read.select("doc", "text").filter(F.pmod(F.xxhash64("doc"), F.lit(SAMPLE)) == 0))
    often = [r.h for r in some.groupBy("h").agg(F.count("*").alias("n")).filter(F.col("n") * SAMPLE > many).orderBy(F.desc("n")).limit(4096).collect()]
    shares = SHARES * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # tags are taken where the texts lie; of whole copies most are left out, and those that aren't only add tags. What is shared
    # is written, so that the shuffles of tags are deleted before contexts travel
    tags = written(_shared(_tagged(only(read.select("doc", "text"), alone, "doc"), shares, often)).groupBy("doc").agg(F.collect_list("tag").alias("tags")))
    release(docs.sparkSession)
    held = own.join(tags.hint("merge"), "doc", "left" if often else "inner").withColumn("tags", F.coalesce("tags", F.array().cast("array<int>")))
    blocks = _contexts(held, shares, often)
    cuts = _stretches(blocks)
    if often:
        cuts = cuts.unionByName(_stretches_by_string(_by_string(blocks)))
    cuts = cuts.groupBy("doc").agg(F.collect_list(F.struct("fp", "start", "stop")).alias("cuts"))
    return _finished(rows.join(cuts.hint("merge"), "doc", "left").select("doc_id", "fp", F.expr(f"whole and octet_length(text) >= {LENGTH}").alias("whole"), "text", "cuts"))


def op6(spark, sf_dir: str) -> DataFrame:
    found = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, x: acc + x[1] - x[0])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
