import random
import zlib
from collections import Counter, defaultdict

import pytest

from regressa.llm.queries import QUERIES
from regressa.llm.sharding import assign


def check(rows, got, shards, named=True):
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in got if r.doc_id is not None) == sorted(
        (i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()))
        for i, t, _ in rows if i is not None)
    assert len(got) == len(rows)
    per = defaultdict(list)
    for r in got:
        per[r.shard].append(r.slot)
    counts = [len(per[s]) for s in range(shards)]
    assert max(counts) - min(counts) <= 1 and set(per) <= set(range(shards))
    for slots in per.values():
        assert sorted(slots) == list(range(len(slots)))


def mixture(got, shards):
    """Each shard holds each source in its share, up to the interleaving's rounding."""
    total, by = Counter(r.source for r in got), defaultdict(Counter)
    for r in got:
        by[r.shard][r.source] += 1
    for s in range(shards):
        for source, n in total.items():
            assert abs(by[s][source] - n / shards) <= len(total) / 2 + 1


SCHEMA = "doc_id long, text string, source string"


@pytest.mark.parametrize("slices", [1, 5, 4096])
def test_shards_match_the_mixture(spark, slices):
    rnd = random.Random(1)
    rows = [(i, "t" * rnd.randint(0, 9), rnd.choice(["hot"] * 8 + ["a", "b", "c", None]))
            for i in range(1_003)]
    got = assign(spark.createDataFrame(rows, SCHEMA), slices=slices).collect()
    check(rows, got, 8)
    mixture(got, 8)
    by = defaultdict(list)
    for r in got:
        by[r.source].append(r.fraction)
    for x in by.values():
        assert sorted(x) == pytest.approx([(k + 0.5) / len(x) for k in range(len(x))])
    order = [r.fraction for r in sorted(got, key=lambda r: r.position)]
    assert order == sorted(order)
    # within a source the order is shuffled, and any partitioning gives the same result
    again = assign(spark.createDataFrame(rows, SCHEMA).repartition(3), slices=7).collect()
    assert sorted(map(tuple, again), key=str) == sorted(map(tuple, got), key=str)


def test_edge_cases(spark):
    rows = [(1, None, "a"), (2, "", None), (None, "x", "a"), (None, "y", "a"), (3, "é" * 70_000, "b"),
            (4, "same", "c"), (4, "same", "c"), (4, "other", "c"), (5, "z", "a")]
    df = spark.createDataFrame([(*r, 0) for r in rows], SCHEMA + ", shard int")
    check(rows, assign(df).collect(), 8)
    assert assign(df.limit(0)).count() == 0
    check(rows[:3], assign(df.limit(3), shards=2).collect(), 2)


def test_query_on_the_tables(spark):
    from tests.conftest import SF0001

    rows = [(r.doc_id, r.text, r.source) for r in
            spark.read.parquet(f"{SF0001}/documents.parquet").collect()]
    got = QUERIES["op8_stratified_sharding"](spark, SF0001).collect()
    check(rows, got, 8)
    assert {(r.law, r.grown_shard) for r in got} == {("rows", None)}
