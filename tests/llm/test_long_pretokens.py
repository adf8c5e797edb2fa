import public_tokenizers

from silvaflow.llm import bpe


def test_pretokens_beyond_the_place_bits(monkeypatch):
    b = bpe.Bpe(public_tokenizers.path("byte_bpe_50k.json"))
    words = [b"the" * 90, b"x" * 1000, b"ab" * 40, b"thing", b"a"] * 30
    want = b.encode(words)
    monkeypatch.setattr(bpe, "PLACE", 6)
    assert b.encode(words) == want
