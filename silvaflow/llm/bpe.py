"""BPE encoding and decoding with a segment tree over the ranks of adjacent pairs.

A pre-token is a row of symbols (bytes at first). The leaves of its tree are (rank, place) of the pair that begins at each
place; the root is the leftmost pair of lowest rank. A merge changes three leaves and the paths above them, so that n
symbols take O(n log n). Many short pre-tokens of one width are worked on as one array of trees; a long one has its own,
whatever its length: its leaves have as many bits for the place as it needs.

Null text counts as empty and has no ids; so has an empty text. Repeated rows, null doc_ids and ties between equal pairs
(the leftmost goes first) need no care: a row's result depends on its text alone. Very long texts are encoded whole. Other
columns of the input are ignored. An empty table gives an empty result. Special strings inside texts are the special token, as is the library's default.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices, trimmed
from .pretokens import Memo, byte_level_spans, distinct

FAR = np.int64(1) << np.int64(62)
PLACE = 24  # bits of a leaf that hold its place, among many trees
PIECE_BYTES = 1 << 19  # texts are worked on in groups of about so many bytes
KNOWN = 75_000  # pre-tokens of each generation of a task's memo


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in plain}
    for i, b in enumerate(b for b in range(256) if b not in set(plain)):
        out[chr(256 + i)] = b
    return out


class Bpe:
    """A byte-level BPE vocabulary with its merges."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        ids, letters = spec["model"]["vocab"], byte_alphabet()
        size = 1 + max(*ids.values(), *(x["id"] for x in spec["added_tokens"]))
        self.bytes_of = [b""] * size
        for token, i in ids.items():
            self.bytes_of[i] = bytes(letters[c] for c in token)
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        for content, i in self.special.items():
            self.bytes_of[i] = content.encode()
        (self.special_text,) = self.special
        self.first = np.zeros(256, np.int64)
        for c, b in letters.items():
            self.first[b] = ids[c]
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        keys = np.array([ids[a] << 20 | ids[b] for a, b in merges], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys = keys[order]
        self.ranks = order.astype(np.int64)
        self.made = np.array([ids[a + b] for a, b in merges], np.int64)[order]
        self.pairs = {int(k): (int(r), int(m)) for k, r, m in zip(self.keys, self.ranks, self.made, strict=True)}

    def look_up(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (FAR if it is no pair) and merged symbol of pairs."""
        key = a << 20 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], FAR), self.made[at]

    def encode(self, words: list[bytes]) -> list[bytes]:
        """The ids of each pre-token, as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(words)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        for width in np.unique(1 << np.ceil(np.log2(np.maximum(sizes, 2))).astype(np.int64)):
            chosen = np.flatnonzero((np.maximum(sizes, 2) <= width) & (np.maximum(sizes, 2) > width // 2 if width > 2 else True))
            if width >= 1 << PLACE or len(chosen) * 8 < width:
                for i in chosen.tolist():
                    out[i] = self.one_tree(words[i])
            else:
                step = max(1, (1 << 20) // int(width))
                for k in range(0, len(chosen), step):
                    part = chosen[k : k + step]
                    for i, ids in zip(part.tolist(), self.many_trees([words[i] for i in part.tolist()], int(width)), strict=True):
                        out[i] = ids
        return out

    def many_trees(self, words: list[bytes], width: int) -> list[bytes]:
        n = len(words)
        sizes = np.fromiter(map(len, words), np.int64, n)
        raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(n, width)
        symbols = self.first[raw]
        places = np.arange(width)
        alive = places < sizes[:, None]
        follows = np.where(places + 1 < sizes[:, None], places + 1, -1)
        before = np.broadcast_to(places - 1, (n, width)).copy()
        tree = np.full((n, 2 * width), FAR, np.int64)
        merged = np.zeros((n, width), np.int64)
        if width > 1:
            ranks, made = self.look_up(symbols[:, :-1], symbols[:, 1:])
            tree[:, width : 2 * width - 1] = np.where(alive[:, 1:] & (ranks < FAR), ranks << PLACE | places[:-1], FAR)
            merged[:, :-1] = made
        for k in range(width.bit_length() - 2, -1, -1):
            level = tree[:, 2 << k : 4 << k]
            tree[:, 1 << k : 2 << k] = np.minimum(level[:, ::2], level[:, 1::2])
        rows = np.flatnonzero(tree[:, 1] < FAR)
        while len(rows):
            left = tree[rows, 1] & ((1 << PLACE) - 1)
            right = follows[rows, left]
            symbols[rows, left] = merged[rows, left]
            alive[rows, right] = False
            after = follows[rows, right]
            follows[rows, left] = after
            has = after >= 0
            before[rows[has], after[has]] = left[has]
            self._leaf(tree, merged, symbols, rows[has], left[has], after[has], width)
            self._leaf(tree, merged, symbols, rows[~has], left[~has], None, width)
            self._leaf(tree, merged, symbols, rows, right, None, width)
            prior = before[rows, left]
            has = prior >= 0
            self._leaf(tree, merged, symbols, rows[has], prior[has], left[has], width)
            rows = rows[tree[rows, 1] < FAR]
        flat = symbols[alive].astype("<u4").tobytes()
        stops = np.concatenate([[0], np.cumsum(alive.sum(axis=1))]) * 4
        return [flat[a:b] for a, b in zip(stops[:-1].tolist(), stops[1:].tolist(), strict=True)]

    def _leaf(self, tree, merged, symbols, rows, place, after, width) -> None:
        """Sets the leaves at place: the pair with the symbol at after, or none; then the paths to the roots."""
        if not len(rows):
            return
        value = FAR
        if after is not None:
            ranks, made = self.look_up(symbols[rows, place], symbols[rows, after])
            value = np.where(ranks < FAR, ranks << PLACE | place, FAR)
            merged[rows, place] = made
        node = place + width
        tree[rows, node] = value
        while width > 1:
            tree[rows, node >> 1] = np.minimum(tree[rows, node], tree[rows, node ^ 1])
            node = node >> 1
            width >>= 1

    def one_tree(self, word: bytes) -> bytes:
        n, pairs, far = len(word), self.pairs, int(FAR)
        symbols = self.first[np.frombuffer(word, np.uint8)].tolist()
        width = 1 << max(1, (n - 1).bit_length())
        bits = width.bit_length()
        tree, merged = [far] * (2 * width), [0] * n
        follows, before, alive = [*range(1, n), -1], [*range(-1, n - 1)], [True] * n

        def leaf(i: int, j: int) -> int:
            found = pairs.get(symbols[i] << 20 | symbols[j]) if j >= 0 else None
            if found is None:
                return far
            merged[i] = found[1]
            return found[0] << bits | i

        def put(i: int, value: int) -> None:
            node = i + width
            tree[node] = value
            while node > 1:
                a, b = tree[node], tree[node ^ 1]
                node >>= 1
                tree[node] = a if a < b else b

        for i in range(n - 1):
            tree[width + i] = leaf(i, i + 1)
        for k in range(width - 1, 0, -1):
            tree[k] = min(tree[2 * k], tree[2 * k + 1])
        while tree[1] < far:
            i = tree[1] & ((1 << bits) - 1)
            j = follows[i]
            symbols[i], alive[j] = merged[i], False
            follows[i] = k = follows[j]
            if k >= 0:
                before[k] = i
            put(j, far)
            put(i, leaf(i, k))
            if before[i] >= 0:
                put(before[i], leaf(before[i], i))
        return np.array([s for s, a in zip(symbols, alive, strict=True) if a], "<u4").tobytes()

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of the text that ids decode to; what is no UTF-8 becomes U+FFFD."""
        raw = b"".join(map(self.bytes_of.__getitem__, ids.tolist()))
        return raw.decode("utf-8", "replace").encode()


@cache
def vocabulary(path: str) -> Bpe:
    return Bpe(path)


def encode_texts(texts: list[str], path: str, memo: Memo | None = None) -> list[bytes]:
    """The ids of each text, as little-endian unsigned 32-bit integers. memo is a task's: it goes with the task."""
    bpe, memo = vocabulary(path), memo or Memo()

    def make(words: list[str]) -> list[bytes]:
        found = bpe.encode([w.encode("utf-8", "surrogatepass") for w in words])
        return [np.array([bpe.special[w]], "<u4").tobytes() if w in bpe.special else ids for w, ids in zip(words, found, strict=True)]

    joined, cp, starts, ends, first = byte_level_spans(texts, bpe.special_text)
    words, which = distinct(joined, cp, starts, ends)
    found = memo.look_up(words, make)
    parts = [found[i] for i in which.tolist()]
    first = first.tolist()
    return [b"".join(parts[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (binary: little-endian unsigned 32-bit integers), decoded (binary: UTF-8) of each row of docs."""

    @trimmed
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, memo = vocabulary(path), Memo(KNOWN)
        for batch in slices(batches, most=PIECE_BYTES):
            ids = encode_texts([x or "" for x in batch.column("text").to_pylist()], path, memo)
            decoded = [bpe.decode(np.frombuffer(x, "<u4")) for x in ids]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.binary()), pa.array(decoded, pa.binary())], ["doc_id", "ids", "decoded"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(work, f"doc_id {kind}, ids binary, decoded binary")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256; only digests leave the worker."""

    @trimmed
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, memo = vocabulary(path), Memo(KNOWN)
        for batch in slices(batches, most=PIECE_BYTES):
            ids = encode_texts([x or "" for x in batch.column("text").to_pylist()], path, memo)
            decoded = (bpe.decode(np.frombuffer(x, "<u4")) for x in ids)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in ids]),
                    pa.array([hashlib.sha256(x).hexdigest() for x in decoded]),
                ],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(work, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op4(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
