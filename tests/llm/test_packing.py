import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from regressa.llm import packing
from regressa.llm.packing import Encoder, default_tokenizer, hilbert_keys, lay, pack

PIECES = ["the", " The", "'s", "'ll", " 12", "3", "!?", " ", "\n", "\t", "  ", "\r\n", "\xa0", "\x85",
          " ", "\x1c", "é", "e", "日本", "🙂", "<|endoftext|>", "<|startoftext|>", "́", "　",
          "\x0b", "\x0c", "Zebra", "Σ", "ΑΣ", "İ", "_", "​", "ß", "ñ", "ﬁ", "한"]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(default_tokenizer())
    return lambda x: t.encode(x, add_special_tokens=False).ids


def texts(n, seed):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(PIECES) for _ in range(rnd.randint(0, 24))) for _ in range(n)]


def test_encoder_equals_the_library(library, monkeypatch):
    machine, some = Encoder(default_tokenizer()), texts(1_500, 1)
    for at in range(0, len(some), 100):
        ids, ends = machine.encode(pa.array(some[at:at + 100]))
        for t, x in zip(some[at:at + 100], np.split(ids, ends[:-1]), strict=True):
            assert x.tolist() == library(t), repr(t)
    monkeypatch.setattr(packing, "WORDS", 5)
    monkeypatch.setattr(packing, "LONGEST", 3)
    machine = Encoder(default_tokenizer())
    for t in some[:200]:
        assert machine.encode(pa.array([t]))[0].tolist() == library(t)


@pytest.mark.parametrize("letters", ["ab", "aeht", "abcdefghijklmnopqrstuvwxyz", "éeèaßñ", "aaaab", "÷×aÿ"])
def test_merged_words_equal_the_library(library, letters):
    rnd = random.Random(9)
    words = sorted({"".join(rnd.choice(letters) for _ in range(rnd.randint(1, 20)))
                    for _ in range(4_000)})
    machine = Encoder(default_tokenizer())
    assert machine.merger is not None
    ids, _ = machine.encode(pa.array([" ".join(words)]))
    assert ids.tolist() == library(" ".join(words))


@pytest.mark.parametrize("dims,bits", [(2, 3), (3, 2), (3, 3), (2, 5)])
def test_hilbert_curve_visits_neighbours_once(dims, bits):
    side = 1 << bits
    cell = np.stack(np.meshgrid(*[np.arange(side)] * dims, indexing="ij"), -1).reshape(-1, dims)
    keys = hilbert_keys(cell, bits)
    assert sorted(keys.tolist()) == list(range(side ** dims))
    walk = cell[np.argsort(keys)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_lay_cuts_at_the_size():
    assert lay([3, 5, 1], 4, 2) == [(0, 0, 2, 0), (0, 2, 1, 1), (1, 0, 3, 1), (1, 3, 2, 2),
                                    (2, 0, 1, 2)]


def verify(pieces, docs, ids_of, size):
    """Every id of every row in one piece, sequences gapless, full or a power of two."""
    by_seq, by_doc = {}, {}
    for p in pieces:
        by_seq.setdefault(p.sequence_id, []).append(p)
        by_doc.setdefault(p.doc_id, []).append(p)
    for seq in by_seq.values():
        seq.sort(key=lambda p: p.offset)
        at = 0
        for p in seq:
            assert p.offset == at and p.length > 0
            at += p.length
        assert at <= size and at & (at - 1) == 0
    want = {}
    for i, t in docs:
        want.setdefault(i, []).append(ids_of(t or "") + [1])
    assert set(by_doc) == set(want)
    for i, lists in want.items():
        assert sum(p.length for p in by_doc[i]) == sum(map(len, lists))
        if len({tuple(x) for x in lists}) == 1:
            ids = lists[0]
            starts = sorted((p.start, p.length) for p in by_doc[i])
            for p in by_doc[i]:
                part = np.array(ids[p.start:p.start + p.length], "<u4").tobytes()
                assert p.ids_crc32 == zlib.crc32(part) and p.doc_tokens == len(ids)
            if len(lists) == 1:
                at = 0
                for s, n in starts:
                    assert s == at
                    at += n
                assert at == len(ids)


def test_pack_edge_cases(spark, library):
    rows = [(i, t, "s") for i, t in enumerate(texts(200, 2))]
    rows += [(900, None, "x"), (901, "", "x"), (902, " \n ", "x"), (None, "no id", "x"),
             (903, "very long " * 9_000, None), (904, "twice the same", "y"),
             (904, "twice the same", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, offset string")
    got = pack(docs, size=256).collect()
    verify(got, [(r[0], r[1]) for r in rows], library, 256)
    assert sum(p.length for p in got if p.doc_id == 904) == 2 * (len(library("twice the same")) + 1)
    assert pack(docs.limit(0)).count() == 0


def test_sequences_hold_neighbours(spark):
    rnd = random.Random(3)
    words = {s: [f"{s}{c}" for c in "bcdfghjk"] for s in ("alpha", "omega", "gamma", "delta")}
    rows = [(i, " ".join(rnd.choice(words[s]) for _ in range(60)))
            for i in range(400) for s in [rnd.choice(list(words))]]
    topic = {i: t[:5] for i, t in rows}
    got = pack(spark.createDataFrame(rows, "doc_id long, text string"), size=1024).collect()
    seqs = {}
    for p in got:
        seqs.setdefault(p.sequence_id, []).append(topic[p.doc_id])
    share = np.mean([max(map(s.count, s)) / len(s) for s in seqs.values() if len(s) > 2])
    assert share > 0.7  # in random order it is about 0.4


def test_query_against_the_library(spark, library):
    from regressa.llm.queries import QUERIES
    from tests.conftest import SF0001

    docs = spark.read.parquet(f"{SF0001}/documents.parquet").select("doc_id", "text").collect()
    got = QUERIES["op4_curve_packing"](spark, SF0001).collect()
    verify(got, [(r.doc_id, r.text) for r in docs], library, 2048)
