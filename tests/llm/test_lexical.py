import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from regressa.llm import lexical
from regressa.llm.oracle import ORACLE
from regressa.llm.queries import op13_lexical_search
from tests.conftest import SF0001

TERM = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, items, k=20):
    """The contract in plain loops."""
    bags = [(i, Counter(TERM.findall((t or "").translate(LOWER)))) for i, t in docs]
    known = [sum(b.values()) for _, b in bags]
    n, length = sum(x > 0 for x in known), sum(known)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in set(items):
        asked = Counter(TERM.findall((text or "").translate(LOWER)))
        scored = []
        for (i, bag), size in zip(bags, known, strict=True):
            score = 0
            for t, times in asked.items():
                if tf := bag.get(t):
                    w = math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1)))
                    m = 75 + 25 * size * n // length
                    score += times * w * (1_000_000_000 * tf // (1000 * tf + 12 * m))
            if score > 0:
                scored.append((-score, i is not None, i or 0))
        out += [(item, rank, i if some else None, -score)
                for rank, (score, some, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def run(spark, docs, items, **kw):
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    out = lexical.search(d, b, **kw).select("item_id", "rank", "doc_id", "score").collect()
    return sorted(map(tuple, out), key=repr)


def corpus(n, seed):
    rnd = random.Random(seed)
    words = [w + str(i) for i in range(60) for w in ("Ab", "ñu", "日")]
    pick = lambda m: " ".join(rnd.choice(words[:1 + rnd.randrange(len(words))]) for _ in range(m))
    docs = [(i, pick(rnd.randrange(40))) for i in range(n)]
    return docs + [(n + i, docs[5][1]) for i in range(40)], [(i, pick(8)) for i in range(25)]


def test_equals_brute_force(spark):
    docs, items = corpus(300, 1)
    assert run(spark, docs, items) == brute(docs, items)


def test_small_blocks_and_trees_give_the_same(spark):
    docs, items = corpus(120, 2)
    assert run(spark, docs, items, k=3, block_terms=20, block_items=4) == brute(docs, items, 3)


def test_rows_of_every_kind(spark):
    docs = [(1, "alpha beta"), (1, "alpha beta"), (None, "alpha"), (None, None), (2, ""), (3, "-- ,,"),
            (4, "ALPHA Éa éa"), (5, "alpha " * 5_000), (6, "gamma")]
    items = [(0, "alpha"), (0, "alpha"), (0, "beta beta"), (None, "éa"), (1, None), (2, ""), (3, "zeta")]
    assert run(spark, docs, items) == brute(docs, items)
    assert run(spark, docs, []) == [] and run(spark, [], items) == []
    assert run(spark, [(1, None)], items) == []


def test_names_may_clash(spark):
    docs = spark.createDataFrame([(1, "a b", 7, "z")], "doc_id long, text string, score int, `n.m` string")
    items = spark.createDataFrame([(9, "a", 1)], "item_id long, text string, doc_id int")
    assert [tuple(r)[:3] for r in lexical.search(docs, items).collect()] == [(9, 1, 1)]


def test_pairs_of_nodes_are_pruned_and_none_is_lost():
    """Bounds drop most pairs, and the exact scores of all pairs confirm the result."""
    rnd = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    topics = [rnd.sample(words, 30) for _ in range(20)]
    rows = [{"item_id": i, "text": " ".join(rnd.sample(topics[i % 20], 8))} for i in range(40)]
    block = lexical.Block.of(rows)
    bags = [Counter(rnd.choices(topics[rnd.randrange(20)], k=20)) for _ in range(2_000)]
    df = Counter(t for b in bags for t in b)
    block.weigh(2_000, 40_000, np.array([df[t.decode()] for t in sorted(block.codes)]))
    search, scored = lexical.Search(block, 5), 0
    offer = search._offer

    def counted(item, score, ids, known):
        nonlocal scored
        scored += len(score)
        offer(item, score, ids, known)

    search._offer = counted
    full = np.zeros((2_000, 40), np.int64)
    for start in range(0, 2_000, lexical.TREE):
        part = bags[start:start + lexical.TREE]
        post = [(i, block.codes[t.encode()], n) for i, b in enumerate(part) for t, n in b.items()
                if t.encode() in block.codes]
        doc, code, tf = np.array(post).T
        ids = np.arange(start, start + len(part))
        search.add(ids, np.ones(len(part), np.int64), np.full(len(part), 20), doc, code, tf)
        g = np.zeros((len(part), len(block.codes)), np.int64)
        g[doc, code] = block.saturated(np.full(len(doc), 20), tf)
        full[ids] = g @ block.weight.astype(np.int64).T
    assert scored < 0.25 * full.size
    for j in range(40):
        want = sorted(zip(-full[:, j], range(2_000), strict=True))[:5]
        assert [(-s, i) for s, i in want if s] == list(
            zip(search.best[j][0], search.best[j][1], strict=True))


def test_scores_beyond_doubles_stay_exact():
    block = lexical.Block.of([{"item_id": 1, "text": "a " * 400_000 + "b"}])
    block.weigh(10 ** 12, 10 ** 14, np.array([1, 2]))
    assert block.weight.dtype == np.int64
    assert block.saturated(np.array([10 ** 8]), np.array([3]))[0] == 3 * 10 ** 9 // (
        3000 + 12 * (75 + 25 * 10 ** 8 * 10 ** 12 // 10 ** 14))


@pytest.mark.parametrize("sf", [SF0001])
def test_query_equals_its_sql(spark, sf):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    want = con.execute(f"SELECT item_id, rank, doc_id, score FROM ({ORACLE['op13_lexical_search']})").fetchall()
    got = [tuple(r) for r in op13_lexical_search(spark, sf).select(
        "item_id", "rank", "doc_id", "score").collect()]
    assert sorted(got) == sorted(want) and got
