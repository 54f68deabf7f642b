import base64
import hashlib
import random
import struct

import public_tokenizers
import pytest
import tiktoken

from gridloom.llm import bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def theirs():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, bpe.read_ranks(PATH).splitlines())}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    r = random.Random(8)
    pool = "abcdefgh  \n\t'sdtm’éüßñ漢字かな한글🙂 ​\x1c\x1f\x85　٣½0123456789#$%-_=\0́ﬁ"
    out = ["", "<|endoftext|>", "a" * 700, " " * 900, "ab" * 400, "é" * 300, "don't we'll I'D x  y", "  \n\n  x", "x" * 120_000]
    out += ["".join(r.choice(pool) for _ in range(r.randrange(200))) for _ in range(300)]
    out += ["".join(r.choice("aeintrsl") for _ in range(r.randrange(250, 3000))) for _ in range(10)]
    return out


def test_matches_the_library(spark, theirs):
    rows = list(enumerate(texts())) + [(9999, None), (0, ""), (None, "null id")]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, n_tokens string")
    want = []
    for i, t in rows:
        ids = theirs.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(tuple, bpe.op4(docs).collect()), key=str) == sorted(want, key=str)
    for x in bpe.encode(docs.limit(20), PATH, public_tokenizers.PATTERN).collect():
        assert theirs.encode_ordinary(x.text) == x.ids and len(x.ids) == x.n_tokens
    assert bpe.op4(docs.limit(0)).count() == 0


def test_memory_of_pieces_is_bounded(theirs, monkeypatch):
    monkeypatch.setattr(bpe, "SEEN", 5)
    monkeypatch.setattr(bpe, "WORDS", 3)
    codec = bpe.Codec(bpe.read_ranks(PATH), public_tokenizers.PATTERN)
    for t in texts()[:60]:
        assert codec.encode([t])[0] == struct.pack(f"<{len(i := theirs.encode_ordinary(t))}I", *i)
        assert codec.decode(codec.encode([t])) == [t.encode()]


def test_long_words_and_texts_fit_in_memory(theirs):
    r = random.Random(3)
    letters = lambda n: "".join(r.choice("aeintrslou") for _ in range(n))
    words = " ".join(letters(240) for _ in range(600))
    prose = " ".join(letters(r.randrange(1, 9)) for _ in range(4000))
    texts = [words, "", prose * 100, "x"]
    codec = bpe.Codec(bpe.read_ranks(PATH), public_tokenizers.PATTERN)
    coded = codec.encode(texts)
    assert [list(struct.unpack(f"<{len(c) // 4}I", c)) for c in coded] == [theirs.encode_ordinary(t) for t in texts]
    assert len(coded[2]) // 4 > 2 * bpe.BLOCK
    assert codec.decode(coded) == [t.encode() for t in texts]


def test_decoding_cuts_anywhere(theirs, monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK", 3)
    codec = bpe.Codec(bpe.read_ranks(PATH), public_tokenizers.PATTERN)
    texts = ["", "漢字かな🙂 déjà vu", "a", "", "one two three four five six seven"]
    assert codec.decode(codec.encode(texts)) == [t.encode() for t in texts]
