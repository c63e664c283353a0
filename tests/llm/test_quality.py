import zlib

import numpy as np
import pytest

from regressa.llm import quality
from regressa.llm.quality import AttentionModel, accepted, fit, passages, score, sums, train
from regressa.llm.queries import QUERIES


def test_gradient_is_the_numerical_one():
    rng = np.random.default_rng(0)
    counts = np.array([1, 3, 2, 5])
    x, y = rng.standard_normal((11, quality.FEATURES)), np.array([1.0, 0, 1, 0])
    weights = np.array([1.0, 2, 0.5, 1])
    model = AttentionModel.start(x, 0.6)
    model.p["c"] = rng.standard_normal(quality.CODES)

    def loss():
        s = model.score(x, counts)
        return -(weights * (y * np.log(s) + (1 - y) * np.log(1 - s))).sum() / weights.sum()

    grad = model.gradient(x, counts, y, weights)
    for k, q in model.p.items():
        flat = q.reshape(-1)
        for i in rng.integers(0, flat.size, 4):
            old = flat[i]
            flat[i] = old + 1e-6
            up = loss()
            flat[i] = old - 1e-6
            down = loss()
            flat[i] = old
            assert grad[k].reshape(-1)[i] == pytest.approx((up - down) / 2e-6, abs=1e-6), k


def test_passages_cover_whole_texts_and_do_not_mix():
    texts = [b"", b"a b c", b"x " * 100, "É ü!".encode(), b"  \n", b" lead"]
    x, counts = passages(texts)
    assert counts.tolist() == [1, 1, 3, 1, 1, 1] and x.shape == (8, quality.FEATURES)
    assert not x[0].any()
    alone = np.concatenate([passages([t])[0] for t in texts])
    assert np.allclose(x, alone)
    assert x[2, -4] > 0.9  # every word repeats the one before
    assert passages([])[0].shape[0] == 0


def test_attention_finds_the_telling_passage():
    rng = np.random.default_rng(1)
    counts = rng.integers(2, 9, 400)
    x = rng.standard_normal((counts.sum(), quality.FEATURES))
    y = rng.integers(0, 2, 400).astype(float)
    at = np.cumsum(counts) - counts
    x[at[y == 0], 3] += 6  # one passage of each bad document stands out
    model = fit(x, counts, y, np.ones(400))
    s = model.score(x, counts)
    assert ((s >= 0.5) == (y == 1)).mean() > 0.95
    weight = model.forward(x, counts)[4]
    assert np.mean([weight[a] == weight[a:a + n].max() for a, n in zip(at[y == 0], counts[y == 0],
                                                                      strict=True)]) > 0.8
    assert np.allclose(sums(weight, counts), 1)


def test_query_separates_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in QUERIES["op7_quality_attention"](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert len(got) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())
    labels = [(got[r.doc_id], r.quality) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()
              if got[r.doc_id].held_out]
    good = np.array([r.score for r, q in labels if q == 1])
    bad = np.array([r.score for r, q in labels if q == 0])
    assert (good[:, None] > bad[None]).mean() > 0.97
    assert np.mean([r.predicted == q for r, q in labels]) > 0.95


def plain_passages(text):
    """Features of a text's passages in plain loops."""
    if not text:
        return [[0.0] * quality.FEATURES]
    kind = [int(quality._CLASS[b]) for b in text]
    starts = [i for i in range(len(text)) if i == 0 or (kind[i] and not kind[i - 1])]
    out = []
    for p in range(0, len(starts), quality.PASSAGE):
        own = starts[p:p + quality.PASSAGE]
        end = starts[p + quality.PASSAGE] if p + quality.PASSAGE < len(starts) else len(text)
        pairs = [0] * (quality._N ** 2)
        for i in range(own[0], end - 1):
            pairs[kind[i] * quality._N + kind[i + 1]] += 1
        words = []
        for a, b in zip(own, [*own[1:], end], strict=True):
            words.append([((i - a) % 32, text[i:i + 1].lower()) for i in range(a, b) if kind[i]])
        sizes = [len(w) for w in words]
        row = [n / max(1, sum(pairs)) for n in pairs]
        row += [sum(sizes) / len(words) / 10, (sum(n * n for n in sizes) / len(words)) ** 0.5 / 10]
        row += [sum(words[i] == words[i - lag] for i in range(lag, len(words))) / len(words)
                for lag in (3, 2, 1)]
        out.append(row + [np.log1p(len(words)) / 4])
    return out


def plain_score(model, text):
    """The attention-weighted score of one document, passage by passage."""
    p, codes, logits = model.p, [], []
    for row in plain_passages(text):
        x = np.array([min(8, max(-8, (v - m) / s)) for v, m, s in zip(row, model.mean, model.scale, strict=True)])
        h = np.array([np.tanh(sum(x * p["w"][:, j]) + p["b"][j]) for j in range(quality.CODES)])
        gate = [np.tanh(h @ p["v"][:, j]) / (1 + np.exp(-(h @ p["u"][:, j]))) for j in range(quality.GATES)]
        codes.append(h)
        logits.append(sum(g * a for g, a in zip(gate, p["a"], strict=True)))
    weight = np.exp(np.array(logits) - max(logits))
    z = sum(w * h for w, h in zip(weight / weight.sum(), codes, strict=True))
    return 1 / (1 + np.exp(-(z @ p["c"] + p["d"][0])))


def test_query_equals_plain_loops(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    got = {r.doc_id: r.score for r in QUERIES["op7_quality_attention"](spark, sf).collect()}
    rows = docs.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for r in rows:
        assert got[r.doc_id] == pytest.approx(plain_score(model, (r.text or "").encode()), abs=1e-9)
    odd = [b"", b" ", b"a", b"  Lead THEN lead then", "É ü! É ü!".encode() * 60, b"\n\n" + b"x " * 130]
    x, counts = passages(odd)
    assert np.allclose(x, [row for t in odd for row in plain_passages(t)])
    assert np.allclose(model.score(x, counts), [plain_score(model, t) for t in odd])


def test_telling_passages_after_thousands_of_words(spark):
    """What decides the label stands beyond word 2,304 of every document."""
    rng = np.random.default_rng(6)
    words = ["river", "stone", "walks", "under", "seven", "bright", "hills", "and", "the", "old"]

    def text(good, lead):
        clean = " ".join(rng.choice(words, lead)) + ". "
        return clean + (" ".join(rng.choice(words, 96)) if good else "BUY!! NOW!! $$$ 0000 " * 24)

    rows = [(i, text(i % 2, 2_400 + 10 * (i % 7))) for i in range(240)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, quality int")
    for bound in (quality.PASSAGES // 2, 2_600):  # with and without a full sample
        model = train(docs, labels, passages_of_a_label=bound)
        held = [r for r in score(docs, model).collect() if r.held_out]
        assert len(held) > 30 and np.mean([r.predicted == r.doc_id % 2 for r in held]) > 0.95


def test_the_sample_holds_whole_rows_within_its_bound(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "w " * (48 * (1 + i % 5))) for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    seen = {}

    def spy(x, counts, y, weights):
        seen.update(counts=counts, y=y, x=x)
        return fit(x, counts, y, weights)

    monkeypatch.setattr(quality, "fit", spy)
    train(docs, labels, passages_of_a_label=20)
    for label in (0, 1):
        own = seen["counts"][seen["y"] == label]
        assert 0 < own.sum() <= 20 and own.max() <= 5
    assert len(seen["x"]) == seen["counts"].sum()
    train(docs, labels, passages_of_a_label=0)
    assert len(seen["counts"]) == 2


def test_edge_cases(spark):
    rows = [(1, None, "x"), (2, "", "x"), (None, "no id", "x"), (3, "ok " * 50_000, "x"),
            (4, "same", "y"), (4, "same", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 1, 0), (2, None, 0), (None, 0, 0), (9, 0, 0), (3, 1, 1)],
                                   "doc_id long, quality int, toxic int")
    constant = train(docs, labels)  # no document of label 0
    assert isinstance(constant, float) and 0 <= constant <= 1
    assert train(docs, labels.limit(0)) == 1.0
    model = fit(*passages([b"good words here", b"BAD!! BAD!! BAD!!"] * 20),
                np.array([1.0, 0.0] * 20), np.ones(40))
    got = score(docs, model).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)
    assert {r.score for r in got if r.doc_id == 1} == {r.score for r in got if r.doc_id == 2}
    assert [r.held_out for r in got if r.doc_id is None] == [False]
    assert score(docs.limit(0), model).count() == 0
    kept = accepted(docs, 1.0)
    assert kept.columns == docs.columns and kept.count() == 6 and accepted(docs, 0.0).count() == 0
    some = accepted(docs, model)
    assert some.count() == sum(r.predicted for r in got)
