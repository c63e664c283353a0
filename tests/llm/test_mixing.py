import math
import random
import re

import numpy as np
import pytest

from regressa.llm import mixing
from regressa.llm.queries import QUERIES


def goals(words):
    """Targets by resharing the excess again and again."""
    names = sorted((s for s in words if s is not None), key=lambda s: [ord(c) for c in s])
    names += [None] * (None in words)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target, capped = dict.fromkeys(names, 0.0), set()
    pool = 1.5 * sum(words.values())
    while True:
        open_ = [s for s in names if s not in capped]
        left = pool - sum(2 * words[s] for s in capped)
        if not open_:
            break
        new = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if new[s] > 2 * words[s]}
        if not over:
            target.update(new)
            break
        capped |= over
    target.update({s: 2.0 * words[s] for s in capped})
    return target


def tilt(sizes, target):
    """The multiplier by bisection, and the rates."""
    x = np.array(sizes, float)
    x = x[x > 0]
    unit = x.mean()
    low, high = -200.0, math.log(2) * unit / x.min()
    for _ in range(200):
        t = (low + high) / 2
        low, high = (t, high) if (x * np.minimum(2, np.exp(t * x / unit))).sum() < target else (low, t)
    return t, unit


def check(rows, got, exact_rows=True):
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in rows]
    words, by = {}, {}
    for (_, _, s), n in zip(rows, size, strict=True):
        words[s] = words.get(s, 0) + n
        by.setdefault(s, []).append(n)
    want = goals(words)
    of = {}
    for (i, _, s), n in zip(rows, size, strict=True):
        of.setdefault((i, n, words[s]), []).append(s)
    assert len(got) == len(rows)
    taken = {}
    for r in got:
        s = of[(r.doc_id, r.size, r.source_size)][0]
        assert r.target == pytest.approx(want[s], rel=1e-9, abs=1e-9)
        assert r.taken in (0, r.size, 2 * r.size)
        taken[s] = taken.get(s, 0) + r.taken
        if r.size and 0 < want[s] < 2 * words[s]:
            t, unit = tilt(by[s], want[s])
            assert r.rate == pytest.approx(min(2, math.exp(t * r.size / unit)), rel=1e-3)
    for s, w in want.items():
        least = min((n for n in by[s] if n), default=0)
        assert abs(taken[s] - w) <= max(least, 1, 0.005 * w) + 1e-6, (s, taken[s], w)


def docs(n=400, seed=1):
    rnd = random.Random(seed)
    names = ["src0"] * 6 + ["src1", "src10", "src2", "Ünï", "z", "a", None]
    return [(i, " ".join("w" for _ in range(int(rnd.paretovariate(1.1) * 3))), rnd.choice(names))
            for i in range(n)]


SCHEMA = "doc_id long, text string, source string"


def test_mix_meets_targets_with_tilted_rates(spark):
    rows = docs()
    got = mixing.report(spark.createDataFrame(rows, SCHEMA)).collect()
    check(rows, got)


def test_hot_cell_is_ranked_in_slices(spark):
    rows = [(i, "one two three", "hot") for i in range(3_000)] + docs(300, 2)
    rows = [(i, t, s) for i, (_, t, s) in enumerate(rows)]
    got = mixing.report(spark.createDataFrame(rows, SCHEMA)).collect()
    check(rows, got)


@pytest.mark.parametrize("parts", [1, 5])
def test_a_third_of_a_source_is_equal_rows(spark, parts):
    """The limit of a target falls among the copies: as many are taken as it asks for."""
    rnd = random.Random(8)
    rows = [(7, "same words in every copy " * 5, "hot")] * 300
    rows += [(100 + i, "w " * rnd.randrange(5, 60), "hot") for i in range(400)]
    rows += [(9, "x y", "b")] * 50 + [(600 + i, "v " * (3 + i % 90), "b") for i in range(500)]
    rows += [(2000 + i, "u " * 40, "c") for i in range(60)] + [(3, "t t t", None)] * 90
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    got = mixing.report(df).collect()
    words, taken, want = {}, {}, {}
    size = {(i, s): len(t.split()) for i, t, s in rows}
    for (i, s) in [(i, s) for i, _, s in rows]:
        words[s] = words.get(s, 0) + size[i, s]
    least = {s: min(n for (_, t), n in size.items() if t == s) for s in words}
    by_words = {w: s for s, w in words.items()}
    for r in got:
        s = by_words[r.source_size]
        assert r.copies in (0, 1, 2) and r.taken == r.copies * r.size
        taken[s], want[s] = taken.get(s, 0) + r.taken, r.target
    assert want == pytest.approx(goals(words), rel=1e-9)
    assert all(abs(taken[s] - want[s]) <= least[s] for s in words), (taken, want)
    assert len({r.copies for r in got if r.doc_id == 7}) <= 2
    mixed = mixing.mix(df)
    assert mixed.count() == sum(r.copies for r in got)
    again = mixing.report(df.repartition(3)).collect()
    assert sorted((r.doc_id, r.copies) for r in again) == sorted((r.doc_id, r.copies) for r in got)


def test_names_may_clash(spark):
    df = spark.createDataFrame([(i, "a b c", "s", i, 1, 2) for i in range(9)],
                               SCHEMA + ", mix int, copy int, `x.y` int")
    assert mixing.mix(df).columns == df.columns
    with pytest.raises(ValueError):
        mixing.with_copies(df)
    assert mixing.with_copies(df, name="how").columns == [*df.columns, "how"]


def test_reruns_and_partitions_agree(spark):
    df = spark.createDataFrame(docs(500, 3), SCHEMA)
    a = sorted(map(tuple, mixing.report(df).collect()), key=str)
    assert a == sorted(map(tuple, mixing.report(df.repartition(7)).collect()), key=str)


def test_edge_cases(spark):
    rows = [(1, None, "a"), (2, "", "a"), (3, " \n", "empty"), (4, "x y", None), (None, "no id", "a"),
            (None, "no id other", "a"), (5, "long " * 30_000, "b"), (6, "p q r", "c"), (7, "k", "c"),
            (8, "e f", "d"), (8, "g h", "d")]
    df = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA + ", size int")
    got = mixing.report(df).collect()
    check(rows, got)
    assert mixing.report(df.limit(0)).count() == 0
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns
    assert mixed.count() == sum(r.copies for r in got)
    rep = spark.createDataFrame([(1, "a b", "s")] * 4 + [(2, "c", "t")], SCHEMA)
    assert {r.copies for r in mixing.report(rep).collect()} <= {0, 1, 2}


def test_query_on_the_tables(spark):
    from tests.conftest import SF0001

    rows = [(r.doc_id, r.text, r.source) for r in
            spark.read.parquet(f"{SF0001}/documents.parquet").collect()]
    check(rows, QUERIES["op3_entropy_mixing"](spark, SF0001).collect())
