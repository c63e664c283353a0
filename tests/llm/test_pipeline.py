import re
from collections import Counter

import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from regressa.llm import quality
from regressa.llm.packing import default_tokenizer
from tests.llm.test_mixing import goals
from tests.llm.test_packing import verify
from tests.llm.test_simhash import brute_components, plain_fingerprint

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The rows that every stage gets and gives."""
    top = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs.collect()]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        made = stage(spark, docs, SF)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert made.dtypes == docs.dtypes
        made.write.parquet(f"{top}/{i}")
        docs = spark.read.parquet(f"{top}/{i}")
        out.append(docs.collect())
    return out


def test_quality_stage_keeps_what_the_model_accepts(spark, stages):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    want = {r.doc_id for r in quality.score(docs, model).collect() if r.predicted}
    assert {r.doc_id for r in stages[1]} == want and len(stages[1]) == len(want)
    bad = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if not r.quality}
    assert len(bad & want) <= 0.1 * len(bad)


def test_exact_stage_against_brute_force(stages):
    least = {}
    for r in stages[1]:
        key = re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "")
        least[key] = min(least.get(key, r.doc_id), r.doc_id)
    assert sorted(r.doc_id for r in stages[2]) == sorted(least.values())
    assert {tuple(r) for r in stages[2]} <= {tuple(r) for r in stages[1]}


def test_near_stage_against_brute_force(stages):
    docs = stages[2]
    fps = [plain_fingerprint(r.text or "") for r in docs]
    links = [(i, j) for i in range(len(fps)) for j in range(i)
             if (fps[i] ^ fps[j]).bit_count() <= 4]
    comp = brute_components(len(fps), links)
    least = {}
    for r, c in zip(docs, comp, strict=True):
        least[c] = min(least.get(c, r.doc_id), r.doc_id)
    assert sorted(r.doc_id for r in stages[3]) == sorted(least.values())


def test_mixing_stage_meets_targets(stages):
    size = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in stages[3]}
    words = Counter()
    for r in stages[3]:
        words[r.source] += size[r.doc_id]
    taken, copies = Counter(), Counter(r.doc_id for r in stages[4])
    for r in stages[4]:
        taken[r.source] += size[r.doc_id]
    assert max(copies.values()) <= 2
    for s, w in goals(dict(words)).items():
        assert abs(taken[s] - w) <= 0.02 * w


def test_packing_stage_holds_all_ids(stages):
    t = Tokenizer.from_file(default_tokenizer())
    verify(stages[5], [(r.doc_id, r.text) for r in stages[4]],
           lambda x: t.encode(x, add_special_tokens=False).ids, 2048)


def test_run_applies_all_stages(spark, stages):
    got = corpus_pipeline.run(spark, SF)
    key = lambda r: (r.doc_id, r.start, r.length, r.ids_crc32)
    assert sum(r.length for r in got.collect()) == sum(r.length for r in stages[5])
    assert {r.doc_id for r in got.collect()} == {r.doc_id for r in stages[5]}
    assert key(stages[5][0])


def test_stages_take_empty_tables_and_nulls(spark):
    docs = spark.createDataFrame([(1, None, None, None, None), (None, "a", "en", "s", 1),
                                  (None, "a", "en", "s", 1), (2, "", "en", "s", 0)],
                                 spark.read.parquet(f"{SF}/documents.parquet").schema)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0
        assert stage(spark, docs, SF).count() >= 0
