import random

import numpy as np
import pytest
import xxhash

from regressa.llm import simhash
from regressa.llm.components import components, local_labels


def brute_components(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def plain_fingerprint(text):
    import re

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    grams = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    hs = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


@pytest.mark.parametrize("text", ["", " \t\n", "a", "A b", "a b c d", "É x y z w w w w\x0bq",
                                  "one two  three\nfour five six seven " * 9])
def test_fingerprint_is_the_plain_one(text):
    assert int.from_bytes(simhash.fingerprint(text.encode(), 4), "big") == plain_fingerprint(text)


def test_ball_hashing_finds_every_pair(spark):
    rnd = random.Random(1)
    fps = {rnd.getrandbits(64) for _ in range(300)}
    for f in list(fps)[:80]:
        for d in range(1, 7):
            fps.add(f ^ sum(1 << i for i in rnd.sample(range(64), d)))
    fps = sorted(fps)
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    links = [(i, j) for i in range(len(fps)) for j in range(i)
             if (fps[i] ^ fps[j]).bit_count() <= 4]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    got = simhash.ball_links(df, 4).collect()
    at = {x: i for i, x in enumerate(signed)}
    assert brute_components(len(fps), [(at[r.a], at[r.b]) for r in got]) \
        == brute_components(len(fps), links)


def test_collisions_split_ranges(monkeypatch):
    rnd = random.Random(2)
    base = rnd.getrandbits(64)
    fps = np.array(sorted({base ^ sum(1 << i for i in rnd.sample(range(64), 2))
                           for _ in range(60)}), np.uint64)
    monkeypatch.setattr(simhash, "VARIANTS", 5_000)
    pairs = {(min(x, y), max(x, y)) for a, b in simhash.collisions(fps, 0, 0, 2)
             for x, y in zip(a.tolist(), b.tolist(), strict=True)}
    a, b = np.array(sorted(pairs)).T
    links = [(i, j) for i in range(len(fps)) for j in range(i)
             if int(fps[i] ^ fps[j]).bit_count() <= 4]
    assert local_labels(len(fps), a, b).tolist() == brute_components(len(fps), links)


def test_components_chain_star_and_loops(spark):
    chain = [(i, i + 1) for i in range(40)]
    star = [(100, 100 + i) for i in range(1, 60)]
    df = spark.createDataFrame([*chain, *star, (7, 7), (500, 501), (501, 500), (None, 3)],
                               "a long, b long")
    got = {r.node: r.root for r in components(df).collect()}
    groups = {}
    for k, v in got.items():
        groups.setdefault(v, set()).add(k)
    assert sorted(map(sorted, groups.values())) == [
        list(range(41)), [100, *range(101, 160)], [500, 501]]
    assert components(df.limit(0)).count() == 0


def test_near_duplicates_edge_cases(spark):
    long = "word%d " * 1
    big = " ".join(f"w{i % 977}" for i in range(60_000))
    rows = [(5, None, "x", 1), (3, "", "x", 2), (9, " \n", None, 3), (1, big, "a", 4),
            (8, big + " tail", "a", 5), (4, "only three words", "a", 6),
            (4, "only three words", "a", 6), (None, "ONLY three  words", "b", 7), (2, long, "b", 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string, component_id int")
    got = [(r.doc_id, r.fingerprint, r.component_id) for r in
           simhash.near_duplicates(docs).collect()]
    fp = {t: f"{plain_fingerprint(t or ''):016x}" for t in {r[1] for r in rows}}
    ids = [(r[0], int(fp[r[1]], 16)) for r in rows]
    links = [(i, j) for i in range(len(ids)) for j in range(i)
             if (ids[i][1] ^ ids[j][1]).bit_count() <= 4]
    comp = brute_components(len(ids), links)
    least = {c: min(ids[i][0] for i in range(len(ids)) if comp[i] == c and ids[i][0] is not None)
             for c in set(comp)}
    want = [(r[0], fp[r[1]], least[comp[i]]) for i, r in enumerate(rows)]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_query_against_brute_force(spark):
    from regressa.llm.queries import op6_simhash_near_dedup
    from tests.conftest import SF0001

    docs = spark.read.parquet(f"{SF0001}/documents.parquet").select("doc_id", "text").collect()
    fps = [plain_fingerprint(r.text or "") for r in docs]
    links = [(i, j) for i in range(len(fps)) for j in range(i)
             if (fps[i] ^ fps[j]).bit_count() <= 4]
    comp = brute_components(len(fps), links)
    least = {c: min(docs[i].doc_id for i in range(len(fps)) if comp[i] == c) for c in set(comp)}
    want = sorted((r.doc_id, f"{fps[i]:016x}", least[comp[i]]) for i, r in enumerate(docs))
    got = sorted((r.doc_id, r.fingerprint, r.component_id)
                 for r in op6_simhash_near_dedup(spark, SF0001).collect())
    assert got == want


def test_odd_distances_are_exact():
    def parts(fps, distance, lead):
        """Components by ``collisions`` over all groups, and by brute force."""
        arr, radius = np.array(sorted(fps), np.uint64), -(-distance // 2)
        made, want = list(range(len(arr))), list(range(len(arr)))

        def join(label, a, b):
            old, new = label[a], label[b]
            label[:] = [new if x == old else x for x in label]

        for group in range(1 << lead):
            for a, b in simhash.collisions(arr, lead, group, radius, True):
                for x, y in zip(a.tolist(), b.tolist()):
                    assert bin(int(arr[x]) ^ int(arr[y])).count("1") <= distance
                    join(made, x, y)
        for x in range(len(arr)):
            for y in range(x):
                if bin(int(arr[x]) ^ int(arr[y])).count("1") <= distance:
                    join(want, x, y)
        return [[made.index(k) for k in made], [want.index(k) for k in want]]

    made, want = parts([1, 3, 4, 5, 46], 1, 0)
    assert made == want and len(set(made)) == 2
    rng = random.Random(5)
    for distance, bits, n in ((1, 9, 60), (1, 12, 200), (3, 18, 60)):
        for lead in (0, 2):
            fps = {sum(1 << (7 * i % 64) for i in range(bits) if rng.random() < 0.5) for _ in range(n)}
            made, want = parts(fps, distance, lead)
            assert made == want


def test_links_of_an_odd_distance(spark):
    nodes = spark.createDataFrame([(x,) for x in (1, 3, 4, 5, 46)], "fp long")
    links = {frozenset(r) for r in simhash.ball_links(nodes, 1).collect()}
    assert set().union(*links) == {1, 3, 4, 5}
    assert all(bin(a ^ b).count("1") <= 3 for a, b in links)
