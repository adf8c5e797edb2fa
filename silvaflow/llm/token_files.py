"""Token ids in files of independent zstandard frames with a trailing seek table.

A file is: frames of ids (each with zstandard's own checksum), then a skippable frame with the document index (a JSON head,
and doc_id and number of ids of each document), then the seek table as the last skippable frame: for each frame of ids
its compressed size, its size and the low 32 bits of xxh64 of its content, then the number of frames, a flag byte and the
magic number. A reader takes the tail, then only the frames that hold the documents it wants.

Documents lie in ascending doc_id (nulls first, equal ids by text), each ended by end_id; file k holds smaller ids than
file k + 1. Null text counts as empty: the end id alone. An empty table writes no file and reads back as no rows.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .bpe import byte_alphabet
from .common import shared_folder, slices
from .pretokens import Memo, byte_level_spans, distinct

FRAME = 1 << 18  # bytes of ids in a frame
SEEK_MAGIC, FOOT_MAGIC, INDEX_MAGIC = 0x184D2A5E, 0x8F92EAB1, 0x184D2A50
PIECE_BYTES = 1 << 20


class FileWriter:
    """Writes one file of frames to a stream."""

    def __init__(self, out, width: int):
        self.out, self.width, self.table, self.docs, self.counts = out, width, [], [], []
        self.pending: list[bytes] = []
        self.held = self.n = 0
        self.zstd = zstandard.ZstdCompressor(level=3, write_checksum=True)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append(doc_id)
        self.counts.append(len(ids))
        self.n += len(ids)
        raw = ids.astype(f"<u{self.width}").tobytes()
        for k in range(0, len(raw), FRAME):
            self.pending.append(raw[k : k + FRAME])
            self.held += len(self.pending[-1])
            if self.held >= FRAME:
                self._frame()

    def _frame(self) -> None:
        raw = b"".join(self.pending)
        data = self.zstd.compress(raw)
        self.out.write(data)
        self.table.append(struct.pack("<III", len(data), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.pending, self.held = [], 0

    def close(self) -> None:
        if self.pending:
            self._frame()
        head = json.dumps({"width": self.width, "docs": len(self.docs), "null_ids": [i for i, x in enumerate(self.docs) if x is None]}).encode()
        known = np.array([0 if x is None else x for x in self.docs], "<i8").tobytes()
        body = zstandard.ZstdCompressor(level=3, write_checksum=True).compress(struct.pack("<I", len(head)) + head + known + np.array(self.counts, "<u8").tobytes())
        self.out.write(struct.pack("<II", INDEX_MAGIC, len(body) + 4) + body + struct.pack("<I", len(body)))
        foot = struct.pack("<IBI", len(self.table), 0x80, FOOT_MAGIC)
        self.out.write(struct.pack("<II", SEEK_MAGIC, 12 * len(self.table) + len(foot)) + b"".join(self.table) + foot)


class FileReader:
    """Reads documents of one file; opens only the frames they lie in."""

    def __init__(self, source):
        self.source, size = source, source.size()
        n, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != FOOT_MAGIC or not flags & 0x80:
            raise ValueError("no seek table")
        table = size - 9 - 12 * n - 8
        self.frames = np.frombuffer(self._at(table + 8, 12 * n), "<u4").reshape(n, 3).astype(np.int64)
        (length,) = struct.unpack("<I", self._at(table - 4, 4))
        body = zstandard.ZstdDecompressor().decompress(self._at(table - 4 - length, length))
        (head,) = struct.unpack_from("<I", body)
        self.head = json.loads(body[4 : 4 + head])
        docs = self.head["docs"]
        self.doc_ids: list = np.frombuffer(body, "<i8", docs, 4 + head).tolist()
        for i in self.head["null_ids"]:
            self.doc_ids[i] = None
        self.counts = np.frombuffer(body, "<u8", docs, 4 + head + 8 * docs).astype(np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.counts)])
        self.at = np.concatenate([[0], np.cumsum(self.frames[:, 0])])
        self.raw_at = np.concatenate([[0], np.cumsum(self.frames[:, 1])])
        self.kept: tuple[int, bytes] = (-1, b"")

    def _at(self, place: int, length: int) -> bytes:
        self.source.seek(place)
        return self.source.read(length)

    def frame(self, k: int) -> bytes:
        if self.kept[0] != k:
            raw = zstandard.ZstdDecompressor().decompress(self._at(int(self.at[k]), int(self.frames[k, 0])), max_output_size=int(self.frames[k, 1]))
            if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.frames[k, 2]:
                raise ValueError(f"frame {k} doesn't match its checksum")
            self.kept = (k, raw)
        return self.kept[1]

    def ids(self, i: int) -> np.ndarray:
        """The ids of the i-th document of the file."""
        width = self.head["width"]
        a, b = int(self.starts[i]) * width, int(self.starts[i + 1]) * width
        k, out = int(np.searchsorted(self.raw_at, a, "right")) - 1, []
        while a < b:
            stop = min(b, int(self.raw_at[k + 1]))
            out.append(self.frame(k)[a - int(self.raw_at[k]) : stop - int(self.raw_at[k])])
            a, k = stop, k + 1
        return np.frombuffer(b"".join(out), f"<u{width}")


@cache
def library(path: str):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    spec = json.loads(tokenizer.to_str())
    (special,) = spec["added_tokens"]
    if spec["normalizer"] is not None or spec["pre_tokenizer"] != {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}:
        raise ValueError("only byte-level tokenizers with one special token, no normalizer and no prefix space")
    letters = {b: c for c, b in byte_alphabet().items()}
    return tokenizer, special, str.maketrans({chr(b): c for b, c in letters.items()}), Memo()


def encode_texts(texts: list[str], path: str) -> list[bytes]:
    """The ids of each text as the tokenizers library gives them, as little-endian unsigned 32-bit integers. Its model sees
    each distinct pre-token of a batch once."""
    tokenizer, special, letters, memo = library(path)
    model, mark = tokenizer.model, special["content"]

    def make(words: list[str]) -> list[bytes]:
        out = []
        for w in words:
            ids = [special["id"]] if w == mark else [t.id for t in model.tokenize(w.encode("utf-8", "surrogatepass").decode("latin-1").translate(letters))]
            out.append(struct.pack(f"<{len(ids)}I", *ids))
        return out

    joined, cp, starts, ends, first = byte_level_spans(texts, mark)
    words, which = distinct(joined, cp, starts, ends)
    found = memo.look_up(words, make)
    parts = [found[i] for i in which.tolist()]
    first = first.tolist()
    return [b"".join(parts[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]


def write_tokens(docs: DataFrame, path: str, folder: str | None = None, end_id: int = 0) -> tuple[str, list[tuple[str, int, int]]]:
    """Encodes docs and writes their ids to files in folder (by default a new one in the shared folder). Returns the folder
    and for each file its name, the number of its documents and of its ids, in order. A task writes under a name of its own
    and then moves the file, so that a task that runs again does no harm."""
    folder = folder or f"{shared_folder(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        name = f"ids-{task.partitionId():06d}.zst"
        store, place = fs.FileSystem.from_uri(folder)
        writer, out, draft = None, None, f"{place}/.{name}-{task.taskAttemptId()}"
        for batch in slices(batches, most=PIECE_BYTES):
            if writer is None:
                store.create_dir(place, recursive=True)
                out = store.open_output_stream(draft)
                writer = FileWriter(out, 2 if max(library(path)[0].get_vocab_size(), end_id + 1) <= 1 << 16 else 4)
            encoded = encode_texts([x or "" for x in batch.column("text").to_pylist()], path)
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encoded, strict=True):
                writer.add(doc_id, np.append(np.frombuffer(ids, "<u4"), np.uint32(end_id)))
        if writer is not None:
            writer.close()
            out.close()
            store.move(draft, f"{place}/{name}")
            yield pa.RecordBatch.from_pydict({"file": [name], "docs": [len(writer.docs)], "ids": [writer.n]})

    rows = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    files = rows.mapInArrow(work, "file string, docs long, ids long").collect()
    return folder, sorted((r.file, r.docs, r.ids) for r in files)


def read_tokens(spark: SparkSession, folder: str, files: list[tuple[str, int, int]], wanted: list[int] | None = None) -> DataFrame:
    """doc_id, start (ids before it), n_tokens, ids (binary, little-endian unsigned 32-bit) of all documents, or of those
    wanted; then only the frames they lie in are decompressed."""
    return _read(spark, folder, files, wanted, False)


def _read(spark: SparkSession, folder: str, files: list, wanted: list[int] | None, digest: bool) -> DataFrame:
    start, rows = 0, []
    for name, _, n in files:
        rows.append((name, start))
        start += n
    chosen = None if wanted is None else frozenset(wanted)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, place = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, base in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with store.open_input_file(f"{place}/{name}") as source:
                    reader = FileReader(source)
                    order = [i for i, x in enumerate(reader.doc_ids) if chosen is None or x in chosen]
                    for k in range(0, len(order), 256):
                        part = order[k : k + 256]
                        ids = [reader.ids(i).astype("<u4").tobytes() for i in part]
                        last = pa.array([zlib.crc32(x) for x in ids], pa.int64()) if digest else pa.array(ids, pa.binary())
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([reader.doc_ids[i] for i in part], pa.int64()), pa.array([base + int(reader.starts[i]) for i in part], pa.int64()), pa.array([len(x) // 4 for x in ids], pa.int64()), last],
                            ["doc_id", "start", "n_tokens", "last"],
                        )

    frame = spark.createDataFrame(rows, "file string, start long").repartition(max(1, len(rows)))
    return frame.mapInArrow(work, f"doc_id long, start long, n_tokens long, last {'long' if digest else 'binary'}").withColumnRenamed("last", "ids_crc32" if digest else "ids")


def op2(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder, files = write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
    return _read(spark, folder, files, None, True)
