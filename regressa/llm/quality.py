"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words. Every passage is described by how its bytes
follow each other (pairs of byte classes), how long its words are and how soon they repeat; one
dense layer encodes it. Gated attention (tanh times sigmoid) gives each passage a weight learned
from the labels of whole documents, and the weighted mean of the passages' codes is scored by a
logistic unit. The model is fitted on the driver from a bounded sample of labelled rows: at most
``SAMPLE`` documents of each label, and of these, in their hashed order, as many whole ones as have
``PASSAGES`` passages together (both are parameters of ``train``). The sample's weights restore the
labels' true shares. Fitting and scoring read all passages of a document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from regressa.llm.common import quoted, shared_path

PASSAGE, SAMPLE, PASSAGES, SEED = 48, 2500, 150_000, 42
#: Codes of a passage, units of the attention gate, passes over the sample, bags of a step.
CODES, GATES, EPOCHS, STEP_BAGS, RATE, DECAY = 24, 12, 30, 128, 0.01, 1e-4
#: Bytes of text handled at a time.
CHUNK = 1 << 20

#: Byte classes: white space, small and capital letters, digits, sentence marks, shouts, quotes and
#: brackets, other symbols, bytes of other characters.
_CLASS = np.full(256, 7, np.int32)
for _i, _bytes in enumerate((b" \t\n\r\x0b\x0c", bytes(range(97, 123)), bytes(range(65, 91)),
                             b"0123456789", b".,;:", b"!?", b"'\"()[]{}-")):
    _CLASS[list(_bytes)] = _i
_CLASS[128:] = 8
_N = 9
FEATURES = _N * _N + 6


def passages(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages (rows) and the number of passages of each text; an empty text has
    one passage of zeros."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    first = np.cumsum(size) - size  # a text's first byte
    kind = _CLASS[data]
    starts = np.zeros(len(data), bool)
    if len(data):
        starts[1:] = (kind[1:] != 0) & (kind[:-1] == 0)
    starts[first[size > 0]] = True  # leading white space goes with the first word
    word_at = np.flatnonzero(starts)
    before = np.r_[0, np.cumsum(starts)]
    n_words = before[first + size] - before[first]
    counts = np.maximum(1, -(-n_words // PASSAGE))
    base = np.cumsum(counts) - counts
    of_text = np.repeat(np.arange(len(texts)), n_words)
    number = np.arange(len(word_at)) - before[first][of_text]
    passage = base[of_text] + number // PASSAGE  # of each word
    total = int(counts.sum())
    out = np.zeros((total, FEATURES))
    if not len(data):
        return out, counts
    spans = np.diff(np.r_[word_at, len(data)])
    of_byte = np.repeat(passage.astype(np.int32), spans)
    pair = of_byte[:-1] == of_byte[1:]
    cell = (of_byte[:-1] * (_N * _N) + kind[:-1] * _N + kind[1:])[pair]
    pairs = np.bincount(cell, minlength=total * _N * _N).reshape(total, _N * _N)
    out[:, :_N * _N] = pairs / np.maximum(1, pairs.sum(axis=1, keepdims=True))
    words = np.maximum(1, np.bincount(passage, minlength=total))
    letters = np.add.reduceat(kind != 0, word_at, dtype=np.int64)
    out[:, -6] = np.bincount(passage, letters, total) / words / 10
    out[:, -5] = np.sqrt(np.bincount(passage, letters.astype(float) ** 2, total) / words) / 10
    rng = np.random.default_rng(SEED)
    value, turn = (rng.integers(0, 1 << 63, n, dtype=np.uint64) | np.uint64(1) for n in (256, 32))
    low = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    inside = (np.arange(len(data)) - np.repeat(word_at, spans)) % 32
    code = np.add.reduceat(np.where(kind != 0, value[low] * turn[inside], np.uint64(0)), word_at)
    for lag in (1, 2, 3):
        again = (code[lag:] == code[:-lag]) & (passage[lag:] == passage[:-lag])
        out[:, -1 - lag] = np.bincount(passage[lag:][again], minlength=total) / words
    out[:, -1] = np.log1p(np.bincount(passage, minlength=total)) / 4
    return out, counts


def sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums over the passages of each bag."""
    return np.add.reduceat(values, np.cumsum(counts) - counts, axis=0)


def _squash(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


@dataclass
class AttentionModel:
    """Parameters of the encoder (w, b), the gate (v, u, a) and the scoring unit (c, d)."""

    mean: np.ndarray
    scale: np.ndarray
    p: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def start(cls, x: np.ndarray, share: float) -> AttentionModel:
        rng = np.random.default_rng(SEED)
        made = cls(x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3))
        made.p = {"w": rng.standard_normal((x.shape[1], CODES)) / np.sqrt(x.shape[1]),
                  "b": np.zeros(CODES),
                  "v": rng.standard_normal((CODES, GATES)) / np.sqrt(CODES),
                  "u": rng.standard_normal((CODES, GATES)) / np.sqrt(CODES),
                  "a": rng.standard_normal(GATES) / np.sqrt(GATES),
                  "c": np.zeros(CODES), "d": np.array([np.log(share / (1 - share))])}
        return made

    def forward(self, x: np.ndarray, counts: np.ndarray) -> tuple:
        p = self.p
        x = np.clip((x - self.mean) / self.scale, -8, 8)
        h = np.tanh(x @ p["w"] + p["b"])
        t, g = np.tanh(h @ p["v"]), _squash(h @ p["u"])
        e = (t * g) @ p["a"]
        bag = np.repeat(np.arange(len(counts)), counts)
        top = np.maximum.reduceat(e, np.cumsum(counts) - counts)
        e = np.exp(e - top[bag])
        weight = e / sums(e, counts)[bag]
        z = sums(weight[:, None] * h, counts)
        return x, h, t, g, weight, bag, z, _squash(z @ p["c"] + p["d"])

    def score(self, x: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return self.forward(x, counts)[-1] if len(counts) else np.zeros(0)

    def gradient(self, x: np.ndarray, counts: np.ndarray, y: np.ndarray, weights: np.ndarray
                 ) -> dict[str, np.ndarray]:
        """Gradient of the weighted mean log loss of the bags."""
        p = self.p
        x, h, t, g, weight, bag, z, s = self.forward(x, counts)
        do = weights * (s - y) / weights.sum()
        dz = (do[:, None] * p["c"])[bag]
        da = (dz * h).sum(axis=1)
        de = weight * (da - sums(weight * da, counts)[bag])
        dt, dg = de[:, None] * p["a"] * g * (1 - t * t), de[:, None] * p["a"] * t * g * (1 - g)
        dh = weight[:, None] * dz + dt @ p["v"].T + dg @ p["u"].T
        dx = dh * (1 - h * h)
        return {"w": x.T @ dx, "b": dx.sum(axis=0), "v": h.T @ dt, "u": h.T @ dg,
                "a": (t * g).T @ de, "c": z.T @ do, "d": np.array([do.sum()])}


def fit(x: np.ndarray, counts: np.ndarray, y: np.ndarray, weights: np.ndarray) -> AttentionModel:
    """Adam over mini-batches of bags, in a seeded order."""
    share = float((weights * y).sum() / weights.sum())
    model = AttentionModel.start(x, min(max(share, 1e-3), 1 - 1e-3))
    rng, ends = np.random.default_rng(SEED), np.cumsum(counts)
    m = {k: np.zeros_like(v) for k, v in model.p.items()}
    v = {k: np.zeros_like(q) for k, q in model.p.items()}
    step = 0
    steps = EPOCHS * -(-len(counts) // STEP_BAGS)
    for _ in range(EPOCHS):
        for part in np.array_split(rng.permutation(len(counts)), -(-len(counts) // STEP_BAGS)):
            rows = np.concatenate([np.arange(ends[i] - counts[i], ends[i]) for i in part])
            grad = model.gradient(x[rows], counts[part], y[part], weights[part])
            step += 1
            rate = RATE * (1 - step / (steps + 1))
            for k, q in model.p.items():
                d = grad[k] + DECAY * q * (k not in "bd")
                m[k] = 0.9 * m[k] + 0.1 * d
                v[k] = 0.999 * v[k] + 0.001 * d * d
                q -= rate * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.999 ** step)) + 1e-8)
    return model


def _chunks(batch: pa.RecordBatch, column: str) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy()
    at = 0
    while at < len(sizes):
        stop = max(at + 1, int(np.searchsorted(np.cumsum(sizes[at:]), CHUNK)) + at)
        part = batch.slice(at, stop - at)
        yield part, [t or b"" for t in part.column(column).cast(pa.binary()).to_pylist()]
        at = stop


def held_out(id_col: str = "doc_id") -> Column:
    return F.crc32(F.col(quoted(id_col)).cast("string")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "quality", sample: int = SAMPLE,
          passages_of_a_label: int = PASSAGES // 2) -> AttentionModel | float:
    """Fit on at most ``sample`` rows of each label, smallest hashed ids first, none of them held
    out, and on no more of them than have ``passages_of_a_label`` passages together (the first row
    of a label always counts). A row is taken with all its passages or not at all. Null labels, null ids and labels without a document are left out. Without both labels the
    result is the share of label 1 among the rows there are (1 without any)."""
    marked = labels.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(label_col)).alias("y")) \
        .where(F.col("id").isNotNull() & F.col("y").isin(0, 1) & ~F.coalesce(held_out("id"), F.lit(True)))
    share = {r.y: r.n for r in marked.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = F.xxhash64(F.lit(SEED), "id")
    few = [marked.where(F.col("y") == y).orderBy(order, "id").limit(sample) for y in (0, 1)]
    thin = docs.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).alias("text"))
    # At most 2 * sample rows of two numbers.
    rows = thin.join(F.broadcast(few[0].unionByName(few[1])), "id")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in _chunks(batch, "text"):
                x, counts = passages(texts)
                ends = np.cumsum(counts).tolist()
                rows = [x[end - n:end].astype("<f4").tobytes()
                        for end, n in zip(ends, counts.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("y"), pa.array(counts, pa.int64()),
                     pa.array(rows, pa.binary())], names=["id", "y", "n", "x"])

    kind = rows.schema["id"].dataType.simpleString()
    path = shared_path(docs.sparkSession, "passages")
    rows.select("id", F.col("y").cast("int").alias("y"), "text") \
        .mapInArrow(each, f"id {kind}, y int, n long, x binary") \
        .withColumn("turn", F.xxhash64(F.lit(SEED), "id")).write.parquet(path)
    described = docs.sparkSession.read.parquet(path)
    # The first rows of a label, in hashed order, that the bound has room for.
    last: dict[int, int] = {}
    used = {0: 0, 1: 0}
    for r in sorted(described.select("y", "turn", "n").collect(), key=lambda r: (r.turn, r.n)):
        used[r.y] += r.n
        if used[r.y] <= passages_of_a_label or r.y not in last:
            last[r.y] = r.turn
    within = F.lit(False)
    for label, turn in last.items():
        within = within | ((F.col("y") == label) & (F.col("turn") <= turn))
    got = described.where(within).select("id", "y", "x").collect()
    got.sort(key=lambda r: (r.id, r.y, r.x))
    y = np.array([r.y for r in got], float)
    if len(set(y.tolist())) < 2:
        n = sum(share.values())
        return share.get(1, 0) / n if n else 1.0
    bags = [np.frombuffer(bytes(r.x), "<f4").reshape(-1, FEATURES) for r in got]
    weights = np.array([share[int(v)] / (y == v).sum() for v in y])
    return fit(np.concatenate(bags).astype(float), np.array([len(b) for b in bags]), y, weights)


def _scores(model: AttentionModel | float, texts: list[bytes]) -> np.ndarray:
    if isinstance(model, float):
        return np.full(len(texts), model)
    return model.score(*passages(texts))


def score(docs: DataFrame, model: AttentionModel | float, id_col: str = "doc_id",
          text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted (1 at ``threshold`` or above) for every row.

    Null texts count as empty, which have the score of a passage without words; a null id is not
    held out; rows that repeat give equal rows; an empty table gives none; further columns are
    ignored.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in _chunks(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(_scores(model, texts))],
                                                 names=["doc_id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(quoted(id_col)).alias("doc_id"), F.col(quoted(text_col)).alias("text")) \
        .mapInArrow(each, f"doc_id {kind}, score double") \
        .select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score",
                (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, model: AttentionModel | float, text_col: str = "text",
             threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that the model accepts, columns unchanged."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in _chunks(batch, text_col):
                yield pa.RecordBatch.from_arrays(
                    part.filter(pa.array(_scores(model, texts) >= threshold)).columns, schema=arrow)

    arrow = to_arrow_schema(docs.schema)
    return docs.mapInArrow(each, docs.schema)
