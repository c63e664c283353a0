import math

import numpy as np
import pytest

from regressa.llm import embedding_dedup
from regressa.llm.embedding_dedup import near_duplicates, plan_tables
from tests.llm.test_simhash import brute_components


def brute(rows, threshold=0.95):
    def unit(v):
        if v is None or not v or any(x is None or not math.isfinite(x) for x in v):
            return None
        v = np.array(v, float)
        m = np.abs(v).max()
        return v / m / np.linalg.norm(v / m) if m else None

    units = [unit(v) for _, v in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i)
             if units[i] is not None and units[j] is not None
             and len(units[i]) == len(units[j]) and units[i] @ units[j] >= threshold]
    n = [0] * len(rows)
    for i, j in links:
        n[i] += 1
        n[j] += 1
    comp = brute_components(len(rows), links)
    out = []
    for i, (vid, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if comp[j] == comp[i] and rows[j][0] is not None]
        c = min(ids) if ids else None
        out.append((vid, n[i], c, vid == c))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in df.collect()), key=str)


def test_plan_meets_the_recall():
    for n in (1, 500, 50_000, 10 ** 9):
        bits, tables = plan_tables(n, 0.95, 0.9999)
        p = (1 - math.acos(0.95) / math.pi) ** bits
        assert 1 - (1 - p) ** tables >= 0.9999 and n / 2 ** bits <= embedding_dedup.BUCKET


def test_links_and_edge_cases(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((40, 16))
    rows = [(i, base[i % 40].tolist()) for i in range(60)]
    rows += [(100 + i, (base[i % 8] + 0.18 * rng.standard_normal(16)).tolist()) for i in range(150)]
    rows += [(400, None), (401, [0.0] * 16), (402, [float("nan")] + [1.0] * 15), (403, []),
             (404, [None] + [1.0] * 15), (405, [float("inf")] + [1.0] * 15), (406, [1.0, 2.0]),
             (407, [2.0, 4.0]), (None, base[39].tolist()), (7, base[39].tolist()),
             (7, base[39].tolist()), (408, (base[3] * 1e-200).tolist())]
    df = spark.createDataFrame([(i, v, "c") for i, v in rows],
                               "vec_id long, embedding array<double>, kept string")
    assert got(near_duplicates(df)) == brute(rows)
    assert near_duplicates(df.limit(0)).count() == 0
    assert got(near_duplicates(df.where("vec_id = 400"))) == [(400, 0, 400, True)]


def test_blocks_of_large_buckets(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 7)
    rng = np.random.default_rng(2)
    center = rng.standard_normal(12)
    rows = [(i, (center + s * rng.standard_normal(12)).tolist())
            for i, s in enumerate(rng.choice([0.02, 0.3], 120))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert got(near_duplicates(df)) == brute(rows)


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_query_against_brute_force(spark, sf):
    from regressa.llm.queries import QUERIES

    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert got(QUERIES["op2_embedding_near_dedup"](spark, sf)) == brute(rows)
