import random

import duckdb
import pytest

from regressa.llm.chat import conversations, format_preferences, preference_pairs
from regressa.llm.oracle import ORACLE
from regressa.llm.queries import QUERIES

NAME = "op1_preference_formatting"
ROWS = [
    (1, 0, "user", "hi", 9), (1, 1, "assistant", "hello", 9), (1, 2, "user", "more", 9),
    (1, 3, "assistant", "ok", 9),
    (2, 0, "user", "hi", 9), (2, 1, "assistant", "hello", 9), (2, 2, "user", "other", 9),
    (3, 0, "user", "hi", 9), (3, 0, "user", "hi", 9), (3, 1, "assistant", None, 9),
    (4, 0, None, "sys", 9), (5, None, "user", "late", 9), (5, 0, "assistant", "é🙂", 9),
    (6, 0, "assistant", "only", 9), (7, 0, "user", "x" * 50_000, 9), (7, 1, "assistant", "y", 9),
    (None, 0, "user", "nobody", 9), (None, 1, "assistant", "n", 9), (8, 0, "user", "", 9),
    (9, 0, "user", "hi", 9), (9, 1, "assistant", "hello", 9), (9, 2, "user", "more", 9),
    (9, 3, "assistant", "ok", 9)]


def table(spark):
    return spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string, prompt int")


def test_hand_made_pair(spark):
    pairs = spark.createDataFrame(
        [(1, [("user", "q"), ("assistant", "good"), ("user", "z")], [("user", "q"), ("assistant", "bad")]),
         (2, [("user", "q")], [("user", "q"), ("assistant", "x")]), (3, None, [("assistant", "a")]),
         (4, [("assistant", "a")], [("assistant", "a")])],
        "id int, chosen array<struct<role:string,text:string>>, "
        "rejected array<struct<role:string,text:string>>")
    r = {x.id: x for x in format_preferences(pairs).collect()}
    assert r[1].common_turns == 1 and r[1].prompt == "<|im_start|>user\nq<|im_end|>\n"
    assert r[1].chosen.startswith("<|im_start|>assistant\ngood<|im_end|>\n") and r[1].usable
    (span,) = r[1].chosen_loss
    assert r[1].chosen[span.start:span.end] == "good<|im_end|>"
    (span,) = r[1].rejected_loss
    assert r[1].rejected[span.start:span.end] == "bad<|im_end|>"
    assert r[2].chosen == "" and r[2].common_turns == 1 and not r[2].usable
    assert r[3].prompt == "" and r[3].chosen == "" and not r[3].usable
    assert r[4].common_turns == 1 and r[4].chosen == r[4].rejected == "" and not r[4].usable


def test_pairs_are_a_star_and_whole(spark):
    pairs = {r.conv_id: r for r in preference_pairs(conversations(table(spark))).collect()}
    assert set(pairs) == {r[0] for r in ROWS}
    assert [pairs[i].chosen_id for i in (1, 2, 3, 9)] == [1, 1, 1, 1]
    assert pairs[1].kind == "stale" and pairs[9].kind == "sibling"
    assert pairs[1].rejected[-1].text == "hello" and pairs[6].rejected[0].text == ""
    assert len(pairs[3].rejected) == 2  # a repeated row counts once


def compare(got, rows):
    con = duckdb.connect()
    con.register("conversations", rows)
    exp = con.execute(ORACLE[NAME])
    names = [d[0] for d in exp.description]
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(tuple, got.select(names).collect()), key=str) == sorted(exp.fetchall(), key=str)


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_query_matches_oracle(spark, sf):
    rows = duckdb.sql(f"FROM read_parquet('{sf}/conversations.parquet')").to_arrow_table()
    compare(QUERIES[NAME](spark, sf), rows)


def test_edge_cases_match_oracle(spark, tmp_path):
    table(spark).write.parquet(f"{tmp_path}/conversations.parquet")
    compare(QUERIES[NAME](spark, str(tmp_path)),
            duckdb.sql(f"FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')").to_arrow_table())
    assert format_preferences(preference_pairs(conversations(table(spark).limit(0)))).count() == 0


def tree(n, seed):
    """Conversations that share system turns, requests and longer prefixes, one opening by a third."""
    rng = random.Random(seed)
    rows = []
    for i in [*range(n), None]:
        texts = ["sys"] * rng.choice([0, 1, 1]) + ["hot" if rng.random() < 0.35 else rng.choice("pqr")]
        texts += [rng.choice("ab") for _ in range(rng.randrange(6))]
        roles = ["system"] * (len(texts) and texts[0] == "sys") + ["user", "assistant"] * 5
        rows += [(i, k, role, text) for k, (role, text) in enumerate(zip(roles, texts))]
    return rows


def test_shared_prefixes_match_oracle(spark, tmp_path):
    rows = tree(250, 5)
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string") \
        .write.parquet(f"{tmp_path}/conversations.parquet")
    got = QUERIES[NAME](spark, str(tmp_path))
    compare(got, duckdb.sql(f"FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')").to_arrow_table())
    kinds = [r.kind for r in got.collect()]
    assert kinds.count("sibling") > 150 and kinds.count("stale") > 3


def test_names_may_clash(spark):
    turns = "array<struct<role:string,text:string>>"
    pairs = spark.createDataFrame([(1, 2, True, "p", 3, [("user", "q")], [("user", "r")])],
                                  f"id int, common_turns int, usable boolean, prompt string, `a.b` int, "
                                  f"chosen {turns}, rejected {turns}")
    out = format_preferences(pairs)
    assert out.columns == ["id", "a.b", "common_turns", "prompt", "chosen", "rejected", "chosen_loss",
                           "rejected_loss", "usable"]
    assert out.first()["common_turns"] == 0


def test_very_long_conversations(spark):
    rows = [(i, k, "user" if k % 2 == 0 else "assistant", f"t{k if k < 1_500 else k + i}")
            for i in (1, 2) for k in range(2_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    made = {r.conv_id: r for r in format_preferences(preference_pairs(conversations(df))).collect()}
    assert made[2].chosen_id == 1 and made[2].common_turns == 1_500
    assert len(made[2].chosen_loss) == 250


def test_siblings_meet_at_their_longest_shared_prefix(spark):
    def conv(i, *texts):
        return [(i, k, role, text) for k, (role, text) in enumerate(zip(
            ("system", "user", "assistant", "user", "assistant", "user", "assistant"), texts))]

    convs = {1: ("s", "q", "a", "u1", "x"), 2: ("s", "q", "a", "u1", "y"), 3: ("s", "q", "b"),
             4: ("s", "other", "c", "u", "d", "v", "e"), 5: ("s", "q", "a", "u2", "z", "w", "t"),
             6: ("s", "lone", "c"), 7: ("s", "q", "a", "u1", "x"), 8: ("s",)}
    rows = [r for i, texts in convs.items() for r in conv(i, *texts)]
    pairs = preference_pairs(conversations(spark.createDataFrame(
        rows, "conv_id long, turn long, role string, text string")))
    got = {r.conv_id: (r.chosen_id, r.kind) for r in pairs.collect()}
    # The longest conversation of the system turn, 4, answers another request and is no partner.
    assert got == {1: (5, "sibling"), 2: (1, "sibling"), 3: (5, "sibling"), 4: (4, "stale"),
                   5: (5, "stale"), 6: (6, "stale"), 7: (1, "sibling"), 8: (8, "stale")}
    common = {r.conv_id: r.common_turns for r in format_preferences(pairs).collect()}
    assert (common[1], common[2], common[3], common[7]) == (3, 4, 2, 5)


def test_pairs_match_brute_force(spark):
    rng = random.Random(3)
    convs = {}
    for i in range(120):
        roles = ["system"] * rng.randint(0, 2) + ["user", "assistant"] * rng.randint(0, 3)
        convs[i] = [(r, rng.choice("ab")) for r in roles] or [("assistant", "a")]

    def share(a, b):
        return next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))

    def request(c):
        roles = [r for r, _ in c]
        return 1 + (roles.index("user") if "user" in roles else
                    next((k for k, r in enumerate(roles) if r != "system"), len(roles) - 1))

    want = {}
    for i, c in convs.items():
        want[i] = i
        for depth in range(len(c), request(c) - 1, -1):
            group = [j for j, d in convs.items() if share(c, d) >= depth and request(d) <= depth]
            if (first := min(group, key=lambda j: (-len(convs[j]), j))) != i:
                want[i] = first
                break
    made = preference_pairs(spark.createDataFrame(
        list(convs.items()), "conv_id long, turns array<struct<role:string,text:string>>")).collect()
    assert len(made) == len(convs) and {r.conv_id: r.chosen_id for r in made} == want
    assert all([tuple(t) for t in r.chosen] == convs[r.chosen_id] for r in made)
    assert {r.conv_id for r in made if r.kind == "stale"} == {i for i, j in want.items() if i == j}
