import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from silvaflow.llm import bpe, token_counts, token_files

BYTE, PIECE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, ids string, file string"


def texts() -> list[str | None]:
    rnd = random.Random(7)
    alphabet = "ab 's'll 're\n\t  éß漢字١²½½   \x1c\x85!!$#'d'VE'S’s🙂<s>▁  the thetion 123<|endoftext|>"
    out = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 60))) for _ in range(600)]
    out += ["".join(chr(rnd.choice([rnd.randint(1, 0x2FFF), rnd.randint(0xE000, 0x10FFFF)])) for _ in range(40)) for _ in range(300)]
    out += [None, "", " ", "\n\n", "'", " 's", "x" * 9000, "ab" * 3000, "   a  \n b   ", "<0x0A>", "\x00a", " " * 700, "=-" * 400, "a<|endoftext|>b <|endoftext|>", "<unk>", "the " * 20000]
    return out + out[:5]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts())], SCHEMA).repartition(5)


def library_ids() -> list[list[int]]:
    return [e.ids for e in Tokenizer.from_file(BYTE).encode_batch([t or "" for t in texts()], add_special_tokens=False)]


def test_bpe_is_the_library(docs):
    tokenizer = Tokenizer.from_file(BYTE)
    got = {r.doc_id: r for r in bpe.digests(docs, BYTE).collect()}
    for i, ids in enumerate(library_ids()):
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_outputs_and_empty(spark, docs):
    rows = {r.doc_id: r for r in bpe.encode_documents(docs, BYTE).collect()}
    assert all(bytes(rows[i].decoded).decode() == (t or "") for i, t in enumerate(texts()))
    assert bpe.digests(spark.createDataFrame([], SCHEMA), BYTE).count() == 0


def test_one_tree_equals_many():
    b = bpe.Bpe(BYTE)
    words = [t.encode() for t in texts() if t and len(t) < 100]
    assert b.encode(words) == [b.one_tree(w) for w in words]


def test_decode_replaces_what_is_no_text():
    b = bpe.Bpe(BYTE)
    ids = np.array([b.first[0xC3], b.first[0x28]], "<u4")
    assert b.decode(ids).decode() == Tokenizer.from_file(BYTE).decode(ids.tolist())


def test_counts_are_the_library(spark, docs):
    processor = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    got = {r.doc_id: r for r in token_counts.token_counts(docs, PIECE).collect()}
    for i, t in enumerate(texts()):
        n = len(processor.encode(t or ""))
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (n, len((t or "").encode()), n > 4096)
    assert token_counts.token_counts(spark.createDataFrame([], SCHEMA), PIECE).count() == 0


def test_files_round_trip(spark, docs, tmp_path):
    folder, files = token_files.write_tokens(docs, BYTE, f"file://{tmp_path}/ids")
    start = 0
    got = {r.doc_id: r for r in token_files.read_tokens(spark, folder, files).collect()}
    for i, ids in enumerate(library_ids()):
        assert (got[i].start, got[i].n_tokens) == (start, len(ids) + 1)
        assert bytes(got[i].ids) == np.array([*ids, 0], "<u4").tobytes()
        start += len(ids) + 1
    few = token_files.read_tokens(spark, folder, files, [3, 40]).collect()
    assert sorted(r.doc_id for r in few) == [3, 40] and bytes(few[0].ids) == bytes(got[few[0].doc_id].ids)
    digest = {r.doc_id: r.ids_crc32 for r in token_files._read(spark, folder, files, None, True).collect()}
    assert digest == {i: zlib.crc32(bytes(r.ids)) for i, r in got.items()}


def test_damaged_frame_is_noticed(spark, docs, tmp_path):
    folder, files = token_files.write_tokens(docs.limit(20), BYTE, f"file://{tmp_path}/ids")
    path = next(p for p in (tmp_path / "ids").iterdir() if p.name == files[0][0])
    raw = bytearray(path.read_bytes())
    raw[20] ^= 1
    path.write_bytes(raw)
    with pytest.raises(Exception, match=r"checksum|decompress|[Cc]orrupt"):
        token_files.read_tokens(spark, folder, files).collect()


def test_files_of_empty_and_null_ids(spark, tmp_path):
    folder, files = token_files.write_tokens(spark.createDataFrame([], SCHEMA), BYTE, f"file://{tmp_path}/a")
    assert files == [] and token_files.read_tokens(spark, folder, files).count() == 0
    odd = spark.createDataFrame([(None, "a", "", ""), (1, None, "", ""), (1, "b", "", "")], SCHEMA)
    rows = token_files.read_tokens(spark, *token_files.write_tokens(odd, BYTE, f"file://{tmp_path}/b")).collect()
    assert sorted((r.doc_id is None, r.n_tokens) for r in rows) == [(False, 1), (False, 2), (True, 2)]


def thue_morse(n: int) -> tuple[str, str]:
    bits = [bin(i).count("1") & 1 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


@pytest.mark.parametrize("n", [1024, 2048, 4096])
def test_words_with_equal_polynomials_are_told_apart(n):
    a, b = thue_morse(n)
    library = Tokenizer.from_file(BYTE)
    want = [np.array(library.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in (a, b)]
    assert bpe.encode_texts([a, b], BYTE) == want and token_files.encode_texts([a, b], BYTE) == want
    processor = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    assert token_counts.count_texts([a, b], PIECE).tolist() == [len(processor.encode(x)) for x in (a, b)]
    from silvaflow.llm.quality_rules import text_statistics

    text = " ".join([a, "1 2 3 4 5 6 7", b, "1 2 3 4 5 6 7"])
    assert text_statistics([text])["n_repeat_words"].tolist() == [0]
