import hashlib
import random
import re

import duckdb
import pytest

from regressa.llm import exact_dedup
from regressa.llm.exact_dedup import (Terminal, Trie, drop_duplicates, gathered, normalised,
                                        report)


def test_normalised_is_the_pattern():
    rnd = random.Random(3)
    for _ in range(300):
        t = "".join(rnd.choice("ab \t\n\x0b\x0c\ré\xa0\x1c") for _ in range(rnd.randint(0, 9)))
        assert normalised(t.encode()).decode() == re.sub(r"[\x20\x09-\x0D]+", " ", t)


def test_trie_keeps_smallest_and_spills_by_subtree():
    rnd = random.Random(4)
    keys = ["".join(rnd.choice("ab") for _ in range(rnd.randint(0, 6))).encode()
            for _ in range(400)]
    want = {}
    for i, k in enumerate(keys):
        n, c = want.get(k, (i, 0))
        want[k] = (min(n, i), c + 1)
    trie = Trie()
    for i in reversed(range(len(keys))):
        trie.insert(keys[i], Terminal((False, i), {"i": i}, 1, [i], None))
    first = trie.spill()
    assert first and len({k[0] for k, _ in first}) == 1
    got = dict([*first, *trie.drain()])
    assert {k: (b.row["i"], b.copies) for k, b in got.items()} == want
    assert {i for b in got.values() for i in b.handles} == set(range(len(keys)))
    assert trie.held == 0


@pytest.mark.parametrize("trie_bytes", [1, 50, 10_000])
def test_an_owner_holds_many_texts_and_spills_only_complete_ones(trie_bytes):
    """Rows sorted by place, with different texts that share one (a collision of length and hash)."""
    rnd = random.Random(5)
    texts = [bytes(rnd.choice(b"ab") for _ in range(rnd.randint(0, 9))) for _ in range(300)]
    rows = [(len(t), sum(t) % 3, t, i) for i, t in enumerate(texts)]
    rows.sort(key=lambda r: r[:2])
    held = []

    def stream():
        for size, code, key, i in rows:
            yield key, Terminal((False, i), i, 1, [i], (size, code))

    out = {}
    for key, t in gathered(stream(), trie_bytes, True):
        assert key not in out  # complete: never twice
        out[key] = (t.row, t.copies, sorted(t.handles))
        held.append(key)
    want = {}
    for i, t in enumerate(texts):
        want.setdefault(t, []).append(i)
    assert out == {t: (min(i), len(i), i) for t, i in want.items()}


ROWS = [(7, "a  b", "x"), (3, "a\tb", None), (9, "a b", "y"), (4, None, "z"), (8, "", "z"),
        (None, "a b", "z"), (None, "only null", "z"), (5, " a b", "q"), (6, "a b ", "q"),
        (2, "é" * 40_000, "q"), (1, "é" * 40_000 + "x", "q"), (11, "rep", "r"), (11, "rep", "r"),
        (12, "\n", "w")]


def docs_of(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, keep_id string") \
        .repartition(3)


@pytest.mark.parametrize("trie_bytes", [1, 60_000, exact_dedup.TRIE_BYTES])
def test_report_edge_cases(spark, trie_bytes):
    got = {(r.doc_id, r.text_sha256): r
           for r in report(docs_of(spark), trie_bytes=trie_bytes).collect()}
    groups = {}
    for i, t, _ in ROWS:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(i)
    assert report(docs_of(spark)).count() == len(ROWS)
    for text, ids in groups.items():
        sha = hashlib.sha256(text.encode()).hexdigest()
        least = min((i for i in ids if i is not None), default=None)
        for i in ids:
            r = got[(i, sha)]
            assert (r.keep_id, r.group_size, r.kept) == (least, len(ids), i == least)
    assert report(docs_of(spark).limit(0)).count() == 0


def test_drop_duplicates_returns_whole_rows(spark):
    df = docs_of(spark)
    got = drop_duplicates(df)
    assert got.columns == df.columns
    rows = {tuple(r) for r in got.collect()}
    assert rows <= set(ROWS) and got.count() == 9
    assert {(3, "a\tb", None), (4, None, "z"), (11, "rep", "r")} <= rows


def test_query_matches_oracle(spark):
    from regressa.llm.oracle import ORACLE
    from regressa.llm.queries import QUERIES
    from tests.conftest import SF0001

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS FROM read_parquet('{SF0001}/documents.parquet')")
    name = "op9_exact_dedup"
    got = QUERIES[name](spark, SF0001)
    exp = con.execute(ORACLE[name])
    names = [d[0] for d in exp.description]
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(tuple, got.select(names).collect())) == sorted(exp.fetchall())
