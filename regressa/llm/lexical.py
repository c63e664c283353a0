"""Ranked lexical search by dual trees.

Items (queries) and documents are vectors over the items' terms: an item holds the weight of each
of its terms times its occurrences, a document the saturated occurrence of each term. Both sides
get a hierarchy whose nodes hold the largest value of each coordinate. The product of two nodes'
maxima bounds the score of every pair below them, so a pair of nodes is dropped, with all the
documents and items under it, when that bound is below the weakest ``k``-th score of its items.
A bound that only equals it is followed, as ties go by id. All values are integers, held in doubles
while they are exact there and in 64-bit integers beyond, so the result equals an exhaustive search.

Items are taken in blocks of bounded size, each against all documents. A block reads the texts once
and writes a forward index of its terms to the shared folder; weights come from that index. A first
round over a sixteenth of the index yields scores that the ``k``-th best must reach or pass; the
second round searches the whole index from those bounds. A task returns at most ``k`` documents an
item, and these are ranked in two levels.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from regressa.llm.common import quoted, shared_path, utf8

#: Terms and items of a block (its dense item matrix stays below 64 MB), documents of a tree and of
#: its leaves, items of a leaf, children of a node, share of the first round.
BLOCK_TERMS, BLOCK_ITEMS, TREE, LEAF, ITEM_LEAF, FAN, FIRST = 16_384, 512, 512, 2, 1, 4, 16
# What is left of `[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]` once A-Z are lower-cased;
# on UTF-8 every byte beyond ASCII belongs to such a character.
_TERM = re.compile(rb"[0-9a-z\x80-\xff]+")


def terms(text: bytes) -> list[bytes]:
    """The terms of a UTF-8 text; ``bytes.lower`` changes A-Z only."""
    return _TERM.findall(text.lower())


def arranged(rows: np.ndarray, leaf: int) -> np.ndarray:
    """An order of ``rows`` in which similar ones are neighbours: parts are halved, again and
    again, by their distances from two rows that lie far apart."""
    order, open_ = np.arange(len(rows)), [(0, len(rows))]
    square = (rows * rows).sum(axis=1)
    while open_:
        start, end = open_.pop()
        if end - start <= leaf:
            continue
        part = order[start:end]

        def away(i: int, part=part) -> np.ndarray:
            return square[part] - 2.0 * (rows[part] @ rows[i])

        a = part[np.argmax(away(part[0]))]
        b = part[np.argmax(away(a))]
        order[start:end] = part[np.argsort(away(a) - away(b), kind="stable")]
        # Whole leaves on the left, so that leaves and halves share their limits.
        middle = start + max(leaf, (end - start) // 2 // leaf * leaf)
        open_ += [(start, middle), (middle, end)]
    return order


def levels(rows: np.ndarray, leaf: int) -> list[np.ndarray]:
    """Coordinate maxima of the nodes, from leaves of ``leaf`` rows up to the root."""
    out = [np.maximum.reduceat(rows, np.arange(0, len(rows), leaf))]
    while len(out[-1]) > 1:
        out.append(np.maximum.reduceat(out[-1], np.arange(0, len(out[-1]), FAN)))
    return out


@dataclass
class Block:
    """Items of a block as arrays: postings (item, term code, occurrences), then their weights."""

    ids: list
    codes: dict[bytes, int]
    item: np.ndarray
    code: np.ndarray
    times: np.ndarray
    documents: int = 0
    words: int = 0
    weight: np.ndarray | None = None
    least: np.ndarray | None = None
    nodes: list | None = None

    @staticmethod
    def of(rows: list) -> Block:
        """From (item_id, text) rows, in an order that similar items share."""
        found = [Counter(terms((r["text"] or "").encode())) for r in rows]
        codes = {t: i for i, t in enumerate(sorted(set().union(*found)))}
        dense = np.zeros((len(rows), len(codes)), np.float32)
        for i, f in enumerate(found):
            dense[i, [codes[t] for t in f]] = 1.0
        order = arranged(dense, ITEM_LEAF).tolist()
        posting = [(at, codes[t], n) for at, i in enumerate(order) for t, n in sorted(found[i].items())]
        item, code, times = np.array(posting, np.int64).reshape(-1, 3).T
        return Block([rows[i]["item_id"] for i in order], codes, item, code, times)

    def weigh(self, documents: int, words: int, df: np.ndarray) -> None:
        """Weights from the corpus, and the hierarchy of the items."""
        self.documents, self.words = documents, words
        weight = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * d + 1)))
                           for d in df.tolist()], np.int64)
        highest = Counter()
        for i, c, n in zip(self.item.tolist(), self.code.tolist(), self.times.tolist(), strict=True):
            highest[i] += n * int(weight[c]) * 1_000_000
        exact = max(highest.values(), default=0) < 1 << 53
        self.weight = np.zeros((len(self.ids), len(self.codes)), np.float64 if exact else np.int64)
        self.weight[self.item, self.code] = self.times * weight[self.code]
        self.nodes = levels(self.weight, ITEM_LEAF)
        self.least = np.zeros(len(self.ids), np.int64)

    def saturated(self, length: np.ndarray, tf: np.ndarray) -> np.ndarray:
        """A term's value in a document of ``length`` terms that holds it ``tf`` times."""
        if 25 * int(length.max(initial=0)) * self.documents < 1 << 63:
            m = 75 + (25 * length * self.documents) // self.words
        else:
            m = np.array([75 + 25 * n * self.documents // self.words for n in length.tolist()])
        return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


class Search:
    """The best ``k`` documents of each item of a block among the rows that a task sees."""

    def __init__(self, block: Block, k: int):
        self.block, self.k = block, k
        self.least = block.least.copy()
        none = np.zeros(0, np.int64)
        # Scores, ids and "id is not null" of each item's best documents, best first.
        self.best = [(none, none, none) for _ in block.ids]

    def add(self, ids: np.ndarray, known: np.ndarray, length: np.ndarray, doc: np.ndarray,
            code: np.ndarray, tf: np.ndarray) -> None:
        """One tree of documents: postings (row, term code, occurrences) of its rows."""
        block = self.block
        cols, at = np.unique(code, return_inverse=True)
        rows = np.zeros((len(ids), len(cols)), block.weight.dtype)
        rows[doc, at] = block.saturated(length[doc], tf)
        worth = block.weight.max(axis=0)[cols].astype(np.float32)
        order = arranged(rows.astype(np.float32) * worth, LEAF)
        rows, ids, known = rows[order], ids[order], known[order]
        docs, items = levels(rows, LEAF), [n[:, cols] for n in block.nodes]
        floors = [np.minimum.reduceat(self.least, np.arange(0, len(self.least), ITEM_LEAF))]
        while len(floors[-1]) > 1:
            floors.append(np.minimum.reduceat(floors[-1], np.arange(0, len(floors[-1]), FAN)))
        d, i = len(docs) - 1, len(items) - 1
        live = self._open(docs[d], items[i], floors[i], np.ones((1, 1), bool))
        while live.any() and (d or i):  # one step down on the side with more levels left
            if d >= i:
                d -= 1
                live = np.repeat(live, FAN, axis=0)[:len(docs[d])]
            else:
                i -= 1
                live = np.repeat(live, FAN, axis=1)[:, :len(items[i])]
            live = self._open(docs[d], items[i], floors[i], live)
        wanted = block.weight[:, cols]
        for leaf in np.flatnonzero(live.any(axis=0)).tolist():
            some = (np.flatnonzero(live[:, leaf])[:, None] * LEAF + np.arange(LEAF)).ravel()
            some = some[some < len(rows)]
            first = leaf * ITEM_LEAF
            scores = rows[some] @ wanted[first:first + ITEM_LEAF].T
            for j in range(scores.shape[1]):
                self._offer(first + j, scores[:, j].astype(np.int64), ids[some], known[some])

    @staticmethod
    def _open(docs: np.ndarray, items: np.ndarray, floor: np.ndarray, live: np.ndarray) -> np.ndarray:
        """Which live pairs of nodes may hold a score that counts."""
        a, b = np.flatnonzero(live.any(axis=1)), np.flatnonzero(live.any(axis=0))
        if len(a) and len(b):
            bound = docs[a] @ items[b].T
            live[np.ix_(a, b)] &= (bound >= floor[b]) & (bound > 0)
        return live

    def _offer(self, item: int, score: np.ndarray, ids: np.ndarray, known: np.ndarray) -> None:
        good = (score > 0) & (score >= self.least[item])
        if not good.any():
            return
        old = self.best[item]
        score, ids, known = (np.concatenate([o, x[good]]) for o, x in
                             zip(old, (score, ids, known), strict=True))
        first = np.lexsort((ids, known, -score))[:self.k]
        self.best[item] = score[first], ids[first], known[first]
        if len(first) == self.k:
            self.least[item] = max(self.least[item], score[first[-1]])


def _index(docs: DataFrame, codes: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """doc_id, n (terms with repeats), codes and tfs of the block's terms; one row a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, found = [], []
            for text in utf8(batch.column("text")):
                words = terms(text)
                n.append(len(words))
                found.append(Counter(filter(codes.__contains__, words)))
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array(n, pa.int64()),
                pa.array([[codes[t] for t in f] for f in found], pa.list_(pa.int32())),
                pa.array([list(f.values()) for f in found], pa.list_(pa.int64()))],
                names=["doc_id", "n", "codes", "tfs"])

    return docs.select(F.col(quoted(id_col)).cast("long").alias("doc_id"),
                       F.col(quoted(text_col)).alias("text")) \
        .mapInArrow(run, "doc_id long, n long, codes array<int>, tfs array<long>")


def _search(index: DataFrame, block: Block, k: int) -> DataFrame:
    """item, item_id, doc_id, score, rank: the best ``k`` documents of each item in ``index``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(block, k)
        for batch in batches:
            for start in range(0, batch.num_rows, TREE):
                part = batch.slice(start, TREE)
                size = pa.compute.list_value_length(part.column("codes")).to_numpy(zero_copy_only=False)
                ids = part.column("doc_id")
                search.add(pa.compute.fill_null(ids, 0).to_numpy(), 1 - ids.is_null().to_numpy(
                    zero_copy_only=False).astype(np.int64), part.column("n").to_numpy(),
                    np.repeat(np.arange(len(size)), size),
                    part.column("codes").flatten().to_numpy().astype(np.int64),
                    part.column("tfs").flatten().to_numpy())
        counts = [len(b[0]) for b in search.best]
        score, ids, known = (np.concatenate([np.zeros(0, np.int64), *x])
                             for x in zip(*search.best, strict=True))
        yield pa.RecordBatch.from_arrays([
            pa.array(np.repeat(np.arange(len(counts)), counts)),
            pa.array([i for i, c in zip(block.ids, counts, strict=True) for _ in range(c)], pa.int64()),
            pa.array(ids, mask=known == 0), pa.array(score)],
            names=["item", "item_id", "doc_id", "score"])

    found = index.where(F.size("codes") > 0).mapInArrow(
        run, "item long, item_id long, doc_id long, score long")
    best = [F.desc("score"), F.asc_nulls_first("doc_id")]
    some = Window.partitionBy("item", "part").orderBy(*best)
    found = found.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(64))) \
        .withColumn("rank", F.row_number().over(some)).where(F.col("rank") <= k)
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*best))) \
        .where(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id",
           text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
           block_terms: int = BLOCK_TERMS, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` documents with the highest scores above 0 for each
    item, equal scores by ascending id (null ids first); fewer where fewer have such a score.

    Ids are integers or null. Each distinct (item_id, text) is an item, ranked for itself; every row
    of ``docs`` is a document, also one that repeats another (rows that are equal take any order).
    Null and empty texts have no terms: such items get no rows and such documents count nowhere.
    Texts are read whole. Empty tables give no rows; further columns are ignored.
    """
    spark = docs.sparkSession
    asked = items.select(F.col(quoted(item_col)).cast("long").alias("item_id"),
                         F.col(quoted(item_text)).alias("text")).distinct()

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [pa.array([len(set(terms(t))) for t in utf8(batch.column("text"))], pa.int64())],
                names=["n"])

    total = asked.mapInArrow(sizes, "n long").agg(
        F.count_if(F.col("n") > 0).alias("items"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    blocks = max(-(-total["terms"] // block_terms), -(-total["items"] // block_items))
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    spread = asked.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(max(blocks, 1))))
    for b in range(blocks):
        rows = sorted((r for r in spread.where(F.col("block") == b).collect()
                       if terms((r["text"] or "").encode())),
                      key=lambda r: (r["item_id"] is not None, r["item_id"] or 0, r["text"]))
        if not rows:
            continue
        block = Block.of(rows)
        path = shared_path(spark, "index")
        _index(docs, block.codes, id_col, text_col).write.parquet(path)
        index = spark.read.parquet(path)
        corpus = index.agg(F.count_if(F.col("n") > 0).alias("documents"),
                           F.coalesce(F.sum("n"), F.lit(0)).alias("words")).first()
        df = np.zeros(len(block.codes), np.int64)
        for r in index.select(F.explode("codes").alias("c")).groupBy("c").count().collect():
            df[r["c"]] = r["count"]
        if not df.any():
            continue
        block.weigh(corpus["documents"], corpus["words"], df)
        first = index.where(F.pmod(F.xxhash64("doc_id", "n"), F.lit(FIRST)) == 0)
        for r in _search(first, block, k).where(F.col("rank") == k).select("item", "score").collect():
            block.least[r["item"]] = r["score"]
        out = out.unionByName(_search(index, block, k).select("item_id", "rank", "doc_id", "score"))
    return out
