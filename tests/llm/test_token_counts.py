import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from regressa.llm.token_counts import NEWER, Transducer, default_tokenizer, token_counts

PIECES = ["the", " The", "'s", "'ll", " 12", "3", "!?", " ", "\n", "\t", "  ", "\r\n", "\xa0", "\x85",
          " ", "\x1c", "\x1f", "é", "日本", "🙂", "<|endoftext|>", "<|endo", "́", "　",
          "\x0b", "\x0c", "word", "Zebra", "don't", "_", "​", "ß", "ñ"]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(default_tokenizer())
    return lambda x: len(t.encode(x, add_special_tokens=False).ids)


@pytest.fixture(scope="module")
def machine():
    return Transducer(default_tokenizer())


def texts(n, seed):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(PIECES) for _ in range(rnd.randint(0, 24))) for _ in range(n)]


def test_every_character_as_the_library(machine, library):
    some = [f"a{c} {c}1{c}{c}b  {c}" for c in map(chr, [*range(0, 0x110000, 29), *(a for a, _ in NEWER)])
            if not "\ud800" <= c <= "\udfff"]
    assert machine.totals([t.encode() for t in some]).tolist() == [library(t) for t in some]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="abcdeé tnhs'1日<|>", max_size=40), min_size=1, max_size=12))
def test_one_byte_at_a_time_or_many_pieces_at_once(machine, library, some):
    assert machine.totals([t.encode() for t in some]).tolist() == [library(t) for t in some]
    pieces = [p.encode() for t in some for p in machine.pattern.findall(t) if len(p.encode()) <= 64]
    if pieces:
        assert machine.run(pieces).tolist() == [machine.run_long(p) for p in pieces]


def test_tokens_stand_side_by_side_as_the_merges_leave_them(machine, library):
    """The reverse walk over the merges against merging the joined bytes of random token pairs."""
    rnd = np.random.default_rng(2)
    n = 256 + len(machine.pair_keys)
    a, b = rnd.integers(0, n, 4_000), rnd.integers(0, n, 4_000)
    text = {v: k for k, v in machine.child.items()}

    def spelt(token):
        node, out = int(np.flatnonzero(machine.token == token)[0]), []
        while node:
            out.append(text[node] & 255)
            node = text[node] >> 8
        return bytes(reversed(out))

    def merged(data):
        parts = list(data)
        pair = dict(zip(machine.pair_keys.tolist(), machine.pair_made.tolist(), strict=True))
        while True:
            found = [(pair[x << 32 | y], i) for i, (x, y) in enumerate(zip(parts, parts[1:], strict=False))
                     if x << 32 | y in pair]
            if not found:
                return parts
            made, i = min(found)
            parts[i:i + 2] = [made]

    ok = machine.stand(a, b)
    some = np.r_[np.flatnonzero(ok)[:150], np.flatnonzero(~ok)[:150]]
    for i in some.tolist():
        assert ok[i] == (merged(spelt(a[i]) + spelt(b[i])) == [a[i], b[i]])


def test_chunk_maps_compose_to_the_library_count(machine, library, monkeypatch):
    from regressa.llm import token_counts as module

    rnd = random.Random(5)
    for longest in (64, 3):
        monkeypatch.setattr(module, "LONGEST", longest)
        for text in texts(700, 6) + ["ab1" * 40 + "<|endoftext|>x" * 9, "word" * 30 + "!?" * 30 + "12" * 40]:
            cuts = sorted(rnd.randint(0, len(text)) for _ in range(rnd.randint(0, 4)))
            maps = [machine.map_of(text[i:j].encode())
                    for i, j in zip([0, *cuts], [*cuts, len(text)], strict=True)]
            k = rnd.randint(0, len(maps))
            halves = [machine.fold(maps[:k]), machine.fold(maps[k:])]  # in any grouping
            assert [machine.finish(machine.fold(m)) for m in (maps, halves)] == [library(text)] * 2, repr(text)


def test_open_ends_without_white_space_are_short(machine):
    """Class changes close the ends of a chunk; a run of one class is carried on whole."""
    text = ("abc123" * 2_000).encode()
    head, n, tail = machine.map_of(text)
    assert len(head) < 40 and len(tail) < 40 and n > 1_000
    head, n, tail = machine.map_of(b"x" * 5_000)
    assert (len(head), n, tail) == (5_000, 0, None)


def test_bounded_arcs_do_not_change_counts(library, monkeypatch):
    from regressa.llm import token_counts as module

    monkeypatch.setattr(module, "ARCS", 5)
    monkeypatch.setattr(module, "LONGEST", 6)
    machine = Transducer(default_tokenizer())
    for text in texts(300, 7):
        assert machine.totals([text.encode(), text.encode()]).tolist() == [library(text)] * 2


def test_other_tokenizers_are_refused(tmp_path):
    import public_tokenizers

    with pytest.raises(ValueError):
        Transducer(public_tokenizers.path("word_bpe_49k.json"))


@pytest.mark.parametrize("chunk,fan", [(1 << 18, 256), (7, 3)])
def test_counts_and_edge_cases(spark, library, chunk, fan):
    rows = [(i, t, i) for i, t in enumerate(texts(120, 8))]
    rows += [(500, None, 1), (501, "", 2), (None, "no id here, but a text", 3), (502, "x" * 9_000, 4),
             (503, " ".join(f"w{i}" for i in range(3_000)), 5), (504, "said twice, whole row", 6),
             (504, "said twice, whole row", 6), (504, "same id, other text", 6),
             (505, "abc12,;" * 900 + "<|endoftext|>", 7), (505, "abc12,;" * 900 + "<|endoftext|>", 7),
             (506, "日本" * 700, 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = sorted(map(tuple, token_counts(docs, chunk=chunk, fan=fan).collect()), key=str)
    want = sorted(((i, len((t or "").encode()), n := library(t or ""), n > 512)
                   for i, t, _ in rows), key=str)
    assert got == want
    assert token_counts(docs.limit(0)).count() == 0


def test_query_against_the_library(spark, library):
    from regressa.llm.queries import QUERIES
    from tests.conftest import SF0001

    docs = spark.read.parquet(f"{SF0001}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in
           QUERIES["op10_token_counts"](spark, SF0001).collect()}
    assert got == {r.doc_id: (len((r.text or "").encode()), library(r.text or "")) for r in docs}
