import random

import duckdb
import pytest

from regressa.llm.licenses import (PHRASES, STRIDE, TEMPLATES, TemplateIndex, places, report, scan,
                                   stride_of, words_of)
from regressa.llm.oracle import ORACLE
from regressa.llm.queries import QUERIES

NAME = "op5_license_scan"


def test_words_follow_the_pattern():
    import re

    for text in ["The MIT License!", "É-ß\x7fa{b}", "a_b\x00c`d[e", "", "日本 GNU-General"]:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
        want = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        assert [w.decode() for w in words_of(text.encode())] == want


def test_places_are_all_and_on_word_bounds():
    import re

    pattern = re.compile(rb"(?<![^ ])cc by(?![^ ])")
    assert places(b"cc by cc by xcc by cc bye a cc by", pattern) == [0, 2, 9]


@pytest.mark.parametrize("seed", range(6))
def test_filters_lose_no_match(seed):
    rnd = random.Random(seed)
    names = [f"w{i}" for i in range(14)]
    templates = {f"t{i}": " ".join(rnd.choices(names, k=rnd.randint(1, 9))) for i in range(6)}
    counts = {w.encode(): rnd.randint(0, 50) for w in names[:10]}
    threshold, stride = rnd.choice([0.5, 0.8, 0.85, 1.0]), rnd.choice([2, 4, 7])
    index = TemplateIndex(templates, counts, threshold, stride)
    for _ in range(40):
        words = [rnd.choice([*names, "x", "y"]).encode() for _ in range(rnd.randint(0, 60))]
        want = []
        for label, t in templates.items():
            need, step = {w.encode() for w in t.split()}, stride_of(len(t.split()), stride)
            for start in range(0, len(words), step):
                held = set(words[start:start + 2 * step])
                if len(need & held) >= threshold * len(need) - 1e-9:
                    want.append((label, start, len(need & held) / len(need)))
        assert index.matches(words) == sorted(want)


def test_templates_of_any_length_are_found_wherever_they_stand():
    rnd = random.Random(9)
    names = [f"n{i}" for i in range(900)]
    templates = {f"t{n}": " ".join(rnd.choices(names, k=n)) for n in (1, 5, 31, 32, 33, 64, 65, 200, 777, 2_000)}
    index = TemplateIndex(templates, {})
    for label, text in templates.items():
        for at in rnd.sample(range(5_000), 6):
            words = [b"pad"] * at + words_of(text.encode()) + [b"pad"] * 400
            found = [(w, c) for x, w, c in index.matches(words) if x == label]
            assert found and max(c for _, c in found) == 1.0, (label, at)
            size = 2 * stride_of(len(text.split()))
            assert any(w <= at and at + len(text.split()) <= w + size for w, _ in found)
    most = [w for w in words_of(templates["t2000"].encode()) if int(w[1:]) >= 100]
    assert any(x == "t2000" and 0.85 <= c < 1 for x, _, c in index.matches(most))
    assert not index.matches([b"pad"] * 3_000)


ROWS = [(1, "Released under the MIT License."), (2, None), (3, ""), (None, "apache  LICENSE apache license"),
        (4, "Licensed under CC BY-NC 4.0. cc by"), (5, "word " * 60_000 + "mit license"),
        (6, TEMPLATES["mit-grant"]), (6, TEMPLATES["mit-grant"]),
        (7, TEMPLATES["bsd-grant"].replace("binary", "object")), (8, "under the license released"),
        (11, "Copyright 2020.\n\n" + TEMPLATES["mit-text"].replace(" the software is", ". The Software is")),
        (12, "x " * 3_000 + TEMPLATES["bsd-text"].upper() + " y" * 500), (13, TEMPLATES["isc-grant"]),
        (9, "gnu general public license " * 3), (10, "xmit license mit licensee cc-by")]


def table(spark):
    return spark.createDataFrame([(*r, 0) for r in ROWS], "doc_id long, text string, labels int")


def test_scan_shows_places_and_blocks(spark):
    got = {r.doc_id: r for r in scan(table(spark)).collect()}
    assert [(p.label, p.word) for p in got[5].phrases] == [("mit", 60_000)]
    assert [(b.label, b.word, b.containment) for b in got[6].blocks] == [("mit-grant", 0, 1.0)]
    assert [b.label for b in got[7].blocks] == ["bsd-grant"] and got[7].blocks[0].containment < 1
    assert {b.label for b in got[11].blocks} >= {"mit-text", "mit-grant"}
    assert {b.label for b in got[12].blocks} >= {"bsd-text"} and got[13].blocks[0].label == "isc-grant"
    assert not got[8].blocks and not got[2].phrases and got[2].n_words == 0
    assert [(p.label, p.word) for p in got[10].phrases] == [("cc-by", 4)]


def compare(got, con):
    exp = con.execute(ORACLE[NAME])
    names = [d[0] for d in exp.description]
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(tuple, got.select(names).collect()), key=str) == sorted(exp.fetchall(), key=str)


def test_edge_cases_match_oracle(spark, tmp_path):
    table(spark).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    compare(QUERIES[NAME](spark, str(tmp_path)), con)
    assert report(table(spark).limit(0)).count() == 0


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_query_matches_oracle(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS FROM read_parquet('{sf}/documents.parquet')")
    got = QUERIES[NAME](spark, sf)
    compare(got, con)
    assert {"gpl", "apache", "mit", "cc-by"} >= {x for r in got.collect() for x in r.base_labels.split(",") if x}
    assert set(PHRASES.values()) == {"gpl", "apache", "mit", "cc-by"} and STRIDE == 32
