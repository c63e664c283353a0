import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from regressa.llm import byte_bpe
from regressa.llm.queries import op12_byte_bpe
from tests.conftest import SF0001


@pytest.fixture(scope="module")
def codec():
    return byte_bpe.Codec(byte_bpe.default_vocabulary())


@pytest.fixture(scope="module")
def library(codec):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN,
                             mergeable_ranks=codec.ranks, special_tokens={})


def encoded(codec, texts):
    ids, counts = codec.encode([t.encode() for t in texts])
    ends = counts.cumsum().tolist()
    return [ids[a:b].tolist() for a, b in zip([0, *ends], ends)]


PIECES = ["the", " The", "'s", " 12", "!?", " ", "\n", "\t", "\r\n", "\xa0", "\x85", "\x1c", "é",
          "日本", "🙂", "<|endoftext|>", "́", "　", "don't", "_", "ñ", "\x00", "​"]


def texts(n, seed):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(PIECES) for _ in range(rnd.randint(0, 30))) for _ in range(n)]


def test_odd_texts_as_the_library(codec, library):
    some = texts(3_000, 1)
    for text, ids in zip(some, encoded(codec, some), strict=True):
        assert ids == library.encode_ordinary(text), repr(text)
    ids, counts = codec.encode([t.encode() for t in some])
    data, length, whole = codec.decode(ids, counts)
    assert bytes(data) == "".join(some).encode() and whole.all()
    assert length.tolist() == [len(t.encode()) for t in some]


def test_every_character_as_the_library(codec, library):
    some = [f"a{c} {c}1{c}{c}b  {c}" for c in map(chr, range(0, 0x110000, 23)) if not "\ud800" <= c <= "\udfff"]
    for text, ids in zip(some, encoded(codec, some), strict=True):
        assert ids == library.encode_ordinary(text), repr(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.binary(min_size=2, max_size=64), min_size=1, max_size=20))
def test_one_tree_and_many_agree(codec, pieces):
    pieces = list(set(pieces))
    ids, start, size = codec.pieces(pieces)
    for p, a, n in zip(pieces, start, size, strict=True):
        assert ids[a:a + n].tolist() == byte_bpe.merge_ranks(p, codec.ranks, codec.longest)


def test_long_pieces(codec, library):
    rnd = random.Random(3)
    for text in ("a" * 50_000, "ab" * 20_000, "".join(rnd.choice("abcdefgh") for _ in range(40_000)),
                 "日" * 9_000, "1" * 70, "!" * 65):
        assert encoded(codec, [text])[0] == library.encode_ordinary(text)


def test_a_full_table_changes_nothing(codec, library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "KEPT", 7)
    monkeypatch.setattr(byte_bpe, "LONGEST", 4)
    small = byte_bpe.Codec(byte_bpe.default_vocabulary())
    for text in texts(300, 5):
        assert encoded(small, [text, text])[1] == library.encode_ordinary(text)
        assert len(small.kept) <= 7 or len(set(text)) > 7


def test_equal_hashes_are_told_apart(codec, library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "_PLACE", np.ones(256, np.uint64))  # anagrams collide
    some = ["stop pots tops spot", " no on", "ab ba ab", "", "pots"] * 3
    assert encoded(codec, some) == [library.encode_ordinary(t) for t in some]


def test_wide_white_space_runs(codec, library):
    some = ["a\xa0  b", "a\u2003 b", "\u3000  x", "a \u2028\n b", "\x85 \x85  c", "é  b", "\xa0", " \xa0 ",
            "x\u200b  y", "\u1680 \u1680 z"]
    assert encoded(codec, some) == [library.encode_ordinary(t) for t in some]


def test_rows_of_every_kind(spark, library, monkeypatch):
    rows = [(1, "one two", 5, "x"), (1, "one two", 5, "x"), (None, None, None, None), (3, "", 6, None),
            (4, "héllo  \n", None, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int, `a.b` string")
    out = byte_bpe.decode(byte_bpe.encode(df.repartition(3))).collect()
    assert len(out) == 5
    for r in out:
        text = r["text"] or ""
        assert r["ids"] == library.encode_ordinary(text) and bytes(r["decoded"]) == text.encode()
    assert sorted(str(r["a.b"]) for r in out) == ["None", "None", "x", "x", "y"]
    assert byte_bpe.report(df.limit(0)).count() == 0
    ids = spark.createDataFrame([([1, 2],), ([],), (None,), ([1, None],), ([99_999_999],)],
                                "ids array<int>")
    got = [r["decoded"] for r in byte_bpe.decode(ids).collect()]
    assert got[1] == b"" and got[2:] == [None, None, None] and got[0] is not None
    with pytest.raises(ValueError):
        byte_bpe.encode(df, ids_col="text")


def test_query_over_the_whole_table(spark, library):
    docs = spark.read.parquet(f"{SF0001}/documents.parquet").select("doc_id", "text").collect()
    want = []
    for r in docs:
        ids = library.encode_ordinary(r["text"] or "")
        want.append((r["doc_id"], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                     hashlib.sha256(library.decode_bytes(ids)).hexdigest()))
    got = [tuple(r) for r in op12_byte_bpe(spark, SF0001).select(
        "doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()]
    assert sorted(got) == sorted(want)
