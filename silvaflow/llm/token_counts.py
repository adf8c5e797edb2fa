"""Token counts by rank-synchronous array merging.

The distinct pre-tokens of a batch lie one after another in flat arrays of symbols (ragged rows). In each round every row
that still has a pair of symbols that make a piece merges its pair of the best score, all rows at once; what is left at
the end are the tokens. Rows are cut so that no piece spans two of them: between two characters that no piece holds side
by side. A character that is no piece counts as its UTF-8 bytes (byte fallback).

Null text counts as empty, and an empty text has no tokens.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices
from .pretokens import Memo, code_points, distinct

FAR = np.int64(1) << np.int64(40)
SPACE = "▁"
LIMIT = 4096
LONG = 256
PIECE_BYTES = 1 << 20


class Pieces:
    """The pieces of a sentencepiece BPE model with byte fallback and no normalisation but white space."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec, kinds = model.normalizer_spec, {p.type for p in model.pieces}
        if model.trainer_spec.model_type != 2 or not model.trainer_spec.byte_fallback or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.add_dummy_prefix or kinds & {4, 5}:
            raise ValueError("only BPE models with byte fallback, a dummy prefix, no normalisation and no user-defined or unused pieces")
        score = {p.piece: p.score for p in model.pieces if p.type == 1}
        place = {v: i for i, v in enumerate(sorted(set(score.values()), reverse=True))}
        self.rank = {x: place[v] for x, v in score.items()}  # the less the better; equal for equal scores
        order = sorted(score, key=lambda x: self.rank[x])
        symbol = {x: i for i, x in enumerate(order)}
        for x in order:
            for c in x:
                symbol.setdefault(c, len(symbol))
        triples = [(symbol[x[:k]], symbol[x[k:]], symbol[x]) for x in order for k in range(1, len(x)) if x[:k] in symbol and x[k:] in symbol]
        a, b, made = (np.array(v, np.int64) for v in zip(*triples, strict=True))
        keys = a << 20 | b
        by = np.argsort(keys)
        self.keys, self.made = keys[by], made[by]
        self.pairs = dict(zip(self.keys.tolist(), self.made.tolist(), strict=True))
        self.rank_of_symbol = np.full(len(symbol), FAR)
        self.rank_of_symbol[: len(order)] = [self.rank[x] for x in order]
        # ranks with a piece that, as part of a larger one, may give as good a score: merged one at a time
        self.early = np.zeros(len(place), bool)
        for part in (a, b):
            worse = (part < len(order)) & (self.rank_of_symbol[made] <= self.rank_of_symbol[part])
            self.early[self.rank_of_symbol[part[worse]]] = True
        chars = sorted({ord(c) for x in order for c in x})
        self.char = np.zeros(0x110000, np.int64)  # 0: in no piece
        self.char[chars] = np.arange(1, len(chars) + 1)
        self.symbol_of_char = np.array([-1, *(symbol[chr(c)] for c in chars)], np.int64)
        self.beside = np.zeros((len(chars) + 1, len(chars) + 1), bool)
        for x in order:
            for c, d in zip(x, x[1:]):
                self.beside[self.char[ord(c)], self.char[ord(d)]] = True
        self.cost = np.ones(len(symbol), np.int64)
        for x, i in symbol.items():
            if x not in self.rank:
                self.cost[i] = len(x.encode())
        self.single = np.zeros(len(chars) + 1, np.int64)  # tokens of a character alone
        self.single[1:] = self.cost[self.symbol_of_char[1:]]

    def merged(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (FAR if they make no piece) and symbol of what pairs make."""
        key = a << 20 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        made = self.made[at]
        return np.where(self.keys[at] == key, self.rank_of_symbol[made], FAR), made

    def one_by_one(self, symbols: list[int]) -> int:
        """The number of tokens of a long row in which merges must go one at a time."""
        n, pairs, rank = len(symbols), self.pairs, self.rank_of_symbol
        follows, before, alive = [*range(1, n), -1], [*range(-1, n - 1)], [True] * n
        heap: list[tuple[int, int, int, int]] = []

        def push(i: int, j: int) -> None:
            made = pairs.get(symbols[i] << 20 | symbols[j]) if i >= 0 and j >= 0 else None
            if made is not None:
                heappush(heap, (int(rank[made]), i, j, made))

        for i in range(n - 1):
            push(i, i + 1)
        while heap:
            _, i, j, made = heappop(heap)
            if alive[i] and alive[j] and follows[i] == j and pairs.get(symbols[i] << 20 | symbols[j]) == made:
                symbols[i], alive[j] = made, False
                follows[i] = k = follows[j]
                if k >= 0:
                    before[k] = i
                push(before[i], i)
                push(i, k)
        return sum(int(self.cost[x]) for x, a in zip(symbols, alive, strict=True) if a)

    def count(self, words: list[str]) -> np.ndarray:
        """The number of tokens of each word; all characters of a word of two or more are in pieces."""
        out = np.zeros(len(words), np.int64)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        cp = code_points("".join(words))
        ids = self.char[cp]
        row = np.repeat(np.arange(len(words)), sizes)
        unknown = ids == 0
        if unknown.any():
            bytes_of = 1 + (cp[unknown] > 0x7F) + (cp[unknown] > 0x7FF) + (cp[unknown] > 0xFFFF)
            np.add.at(out, row[unknown], bytes_of)
        symbols, row = self.symbol_of_char[ids[~unknown]], row[~unknown]
        while len(symbols):
            rank, made = np.full(len(symbols), FAR), np.zeros(len(symbols), np.int64)
            inner = np.flatnonzero(row[1:] == row[:-1])
            rank[inner], made[inner] = self.merged(symbols[inner], symbols[inner + 1])
            begin = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
            best = np.minimum.reduceat(rank, begin)
            size = np.diff(np.append(begin, len(symbols)))
            ended = best >= FAR
            slow = ~ended & (size > LONG)
            slow[slow] = self.early[best[slow]]
            for i in np.flatnonzero(slow).tolist():
                out[row[begin[i]]] += self.one_by_one(symbols[begin[i] : begin[i] + size[i]].tolist())
            gone = np.repeat(ended, size)
            if gone.any():  # rows without a pair are counted and leave
                np.add.at(out, row[gone], self.cost[symbols[gone]])
            if (ended | slow).any():
                stay = np.repeat(~(ended | slow), size)
                symbols, row, rank, made = symbols[stay], row[stay], rank[stay], made[stay]
                best, size = best[~(ended | slow)], size[~(ended | slow)]
                if not len(symbols):
                    break
            at = np.flatnonzero(rank == np.repeat(best, size))
            # of hits that overlap, every second from the left; of ranks that must go one at a time, the leftmost
            starts_row = np.concatenate([[True], row[at[1:]] != row[at[:-1]]])
            run = starts_row | np.concatenate([[True], np.diff(at) != 1])
            place = np.arange(len(at)) - np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
            take = (place % 2 == 0) & (~self.early[rank[at]] | starts_row)
            at = at[take]
            symbols[at] = made[at]
            stay = np.ones(len(symbols), bool)
            stay[at + 1] = False
            symbols, row = symbols[stay], row[stay]
        return out


@cache
def pieces(path: str) -> tuple[Pieces, Memo]:
    return Pieces(path), Memo()


def count_texts(texts: list[str], path: str) -> np.ndarray:
    """The number of tokens of each text."""
    model, memo = pieces(path)
    marked = [SPACE + x.replace(" ", SPACE) if x else "" for x in texts]
    joined = "".join(marked)
    if not joined:
        return np.zeros(len(texts), np.int64)
    cp = code_points(joined)
    at = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(x) for x in marked], out=at[1:])
    ids = model.char[cp]
    start = np.ones(len(cp), bool)
    start[1:] = ~model.beside[ids[:-1], ids[1:]]
    start[at[:-1][at[:-1] < len(cp)]] = True
    starts = np.flatnonzero(start)
    ends = np.append(starts[1:], len(cp))
    words, which = distinct(joined, cp, starts, ends)
    counts = np.array(memo.look_up(words, lambda new: model.count(new).tolist()), np.int64)
    total = np.concatenate([[0], np.cumsum(counts[which])])
    first = np.searchsorted(starts, at)
    return total[first[1:]] - total[first[:-1]]


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of each row of docs."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=PIECE_BYTES):
            texts = [x or "" for x in batch.column("text").to_pylist()]
            n = count_texts(texts, path)
            size = [len(x.encode("utf-8", "surrogatepass")) for x in texts]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(work, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")


def op3(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))
