"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints at most ``distance`` bits apart have a common variant within half of that of
both, so linking the fingerprints that share a variant finds every pair and no other method is
needed. The variants are dealt to groups by their leading bits; a fingerprint is sent once to
each group that holds some of its variants, and the group makes them, which shuffles tens of
rows a fingerprint instead of 2,081. Groups are sized from the number of distinct fingerprints.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regressa.llm.common import keep, popcount, quoted, split_join, utf8
from regressa.llm.components import components, local_labels

SEED = 42
#: Variants that a task holds at a time (8 bytes each, and as much again to sort them).
VARIANTS = 1 << 21


def fingerprint(text: bytes, shingle: int) -> bytes:
    """Big-endian 64-bit SimHash of the ``shingle``-word sequences, repeats counted; fewer words
    than that are one sequence, no words give zero."""
    words = text.lower().split()
    if not words:
        return bytes(8)
    joined, digest = b" ".join(words), xxhash.xxh64_digest
    if len(words) <= shingle:
        return digest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1]
    hashes = b"".join([digest(joined[i:j], SEED) for i, j in
                       zip(starts[: len(words) - shingle + 1].tolist(),
                           ends[shingle - 1:].tolist(), strict=True)])
    ones, n = np.zeros(64, np.int64), len(hashes) // 8
    rows = np.frombuffer(hashes, np.uint8).reshape(n, 8)
    for i in range(0, n, 65_536):
        ones += np.unpackbits(rows[i:i + 65_536], axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > n).tobytes()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 shingle: int = 4) -> DataFrame:
    """``(doc_id, fp)`` of every row; a null text counts as empty."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = b"".join(fingerprint(x, shingle) for x in utf8(batch.column(1)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.frombuffer(fps, ">i8").astype(np.int64))],
                names=["doc_id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(quoted(id_col)).alias("doc_id"), F.col(quoted(text_col)).alias("t")) \
        .mapInArrow(each, f"doc_id {kind}, fp long")


def masks(bits: int, radius: int) -> list[int]:
    """Every pattern of at most ``radius`` ones in ``bits`` bits."""
    return [sum(1 << i for i in c) for r in range(radius + 1) for c in combinations(range(bits), r)]


def leading_bits(n: int, radius: int) -> int:
    """Bits of the group number that give groups of about ``VARIANTS`` variants."""
    made = n * sum(math.comb(64, r) for r in range(radius + 1))
    return min(24, max(0, math.ceil(math.log2(max(1, made / VARIANTS)))))


def collisions(fps: np.ndarray, lead: int, group: int, radius: int, odd: bool = False
               ) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions in ``fps`` (unsigned) that are neighbours in the sorted list of variants whose
    ``lead`` leading bits are ``group``. Halves the range of variants until they fit a task.

    ``odd``: for the distance ``2 * radius - 1``, a variant at the full radius meets only one that
    is nearer; so all of a run are paired with its first nearer one, and without one with none."""
    used = popcount((fps >> np.uint64(64 - lead)) ^ np.uint64(group)) if lead else np.zeros(
        len(fps), np.uint8)
    near = np.flatnonzero(used <= radius)
    if len(near) < 2:
        return
    by = [near[used[near] == r] for r in range(radius + 1)]
    made = sum(len(x) * sum(math.comb(64 - lead, i) for i in range(radius - r + 1))
               for r, x in enumerate(by))
    if made > 2 * VARIANTS and lead < 48:
        for half in (0, 1):
            for a, b in collisions(fps[near], lead + 1, 2 * group + half, radius, odd):
                yield near[a], near[b]
        return
    keys, who, far = [], [], []
    tail = np.uint64((1 << (64 - lead)) - 1)
    for r, x in enumerate(by):
        if len(x):
            flips = np.array(masks(64 - lead, radius - r), np.uint64)
            keys.append(((fps[x] & tail)[:, None] ^ flips[None, :]).ravel())
            who.append(np.repeat(x, len(flips)))
            if odd:
                far.append(np.tile(popcount(flips) + r == radius, len(x)))
    keys, who = np.concatenate(keys), np.concatenate(who)
    if odd:
        far = np.concatenate(far)
        order = np.lexsort((far, keys))
        keys, who, far = keys[order], who[order], far[order]
        starts = np.r_[True, keys[1:] != keys[:-1]]
        first = np.maximum.accumulate(np.where(starts, np.arange(len(keys)), 0))
        met = np.flatnonzero(~starts & ~far[first])
        yield who[first[met]], who[met]
        return
    order = np.argsort(keys)
    keys, who = keys[order], who[order]
    same = np.flatnonzero(keys[1:] == keys[:-1])
    yield who[same], who[same + 1]


def ball_links(nodes: DataFrame, distance: int) -> DataFrame:
    """``(a, b)`` links that join exactly the fingerprints ``fp`` that chains of at most
    ``distance`` differing bits join. Per group the verified pairs are reduced to a spanning
    forest, so a dense cluster yields one row for each member, not one for each pair."""
    radius = -(-distance // 2)
    lead = leading_bits(nodes.count(), radius)
    prefix = F.shiftrightunsigned("fp", 64 - lead) if lead else F.lit(0).cast("long")
    dealt = nodes.select("fp", F.explode(F.array(*[F.lit(m).cast("long")
                                                   for m in masks(lead, radius)])).alias("m")) \
        .select("fp", prefix.bitwiseXOR(F.col("m")).alias("g"))

    def link(key: tuple, table: pa.Table) -> pa.Table:
        fps = np.sort(table.column("fp").to_numpy()).view(np.uint64)
        heads = np.arange(len(fps))
        for a, b in collisions(fps, lead, key[0].as_py(), radius, distance % 2 == 1):
            true = popcount(fps[a] ^ fps[b]) <= distance
            code = np.unique(np.minimum(a, b)[true] * len(fps) + np.maximum(a, b)[true])
            a, b = np.divmod(code, max(1, len(fps)))
            heads = local_labels(len(fps), np.r_[a, np.arange(len(fps))], np.r_[b, heads])
        moved = np.flatnonzero(heads != np.arange(len(fps)))
        signed = fps.view(np.int64)
        return pa.table({"a": signed[heads[moved]], "b": signed[moved]})

    return dealt.groupBy("g").applyInArrow(link, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    shingle: int = 4, distance: int = 4) -> DataFrame:
    """``(doc_id, fingerprint, component_id)``, one row for each input row.

    Equal fingerprints are one node, so copies are never paired. Null or blank texts have
    fingerprint zero and link like others; a null id never becomes a component id unless its
    component has no other; repeated rows give repeated, equal rows; an empty table gives none.
    Other input columns are ignored. ``distance`` is even in the method; an odd one rounds the
    radius up on one side of a pair only (see ``collisions``), which is exact too.
    """
    fps = keep(fingerprints(docs, id_col, text_col, shingle))
    nodes = keep(fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")))
    root = components(ball_links(nodes.select("fp"), distance)) \
        .select(F.col("node").alias("fp"), "root")
    placed = keep(nodes.join(root, "fp", "left")
                  .select("fp", "least", F.coalesce("root", "fp").alias("root")))
    # A component may hold a third of all fingerprints, and a fingerprint a third of all rows.
    named = keep(placed.groupBy("root").agg(F.min("least").alias("component_id"),
                                            F.count(F.lit(1)).alias("n")))
    named = split_join(placed, named, "root", placed.count()).select("fp", "component_id")
    copies = nodes.select("fp", "n")
    return split_join(fps, named.join(copies, "fp"), "fp", fps.count()).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
