"""Embedding near-duplicates by random-hyperplane sign hashing.

Equal vectors are one class. A class is put into one bucket in each of several tables by the
signs of its products with the table's hyperplanes. The bits of a table and the number of
tables follow from the number of classes by one rule: a bucket holds about ``BUCKET`` unrelated
vectors, and a pair at the threshold shares a bucket with probability ``recall``. Buckets with
one member go no further; larger ones are cut into blocks, and every pair of blocks is compared
by exact cosines in double precision. A pair counts in the first table that brings it together.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regressa.llm.common import keep, quoted, runs, split_join
from regressa.llm.components import components, local_labels

SEED = 42
#: Unrelated vectors that a bucket holds on average, and members of a block.
BUCKET, BLOCK = 16, 1024


def plan_tables(n: int, threshold: float, recall: float) -> tuple[int, int]:
    """Bits of a table, and tables, for ``n`` vectors."""
    bits = max(4, math.ceil(math.log2(max(1, n / BUCKET))))
    together = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - together))


def _units(x: np.ndarray) -> np.ndarray:
    """Unit vectors in double precision; the largest entry goes out first, so nothing overflows."""
    x = x.astype(float)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def code_type(bits: int) -> str:
    """The smallest type that holds a bucket number."""
    return "<u2" if bits <= 16 else "<u4" if bits <= 32 else "<u8"


def classes_of(vectors: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, DataFrame]:
    """``(vec_id, key)`` of all rows (key null: links with nothing) and the classes of equal
    vectors ``(key, rep, copies, vector)``."""
    v, kind = F.col("v"), vectors.schema[vector_col].dataType.simpleString()
    usable = v.isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: F.coalesce(
        ~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))) & F.exists("v", lambda x: x != 0)
    rows = vectors.select(F.col(quoted(id_col)).alias("vec_id"),
                          F.col(quoted(vector_col)).alias("raw"),
                          F.col(quoted(vector_col)).cast("array<double>").alias("v")) \
        .withColumn("key", F.when(usable, F.md5(F.concat_ws(",", v.cast("array<string>")))))
    classes = rows.where("key IS NOT NULL").groupBy("key").agg(
        F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies"),
        F.first("raw" if kind == "array<float>" else "v").alias("vector"))
    return rows.select("vec_id", "key"), classes


def signed(classes: DataFrame, dims: int, bits: int, tables: int) -> DataFrame:
    """``(node, copies, vector, code)``: vectors in the precision they came in and the bucket numbers
    of all tables, both as bytes."""
    single = classes.schema["vector"].dataType.simpleString() == "array<float>"

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = np.random.default_rng(SEED).standard_normal((dims, tables * bits))
        weight = (1 << np.arange(bits, dtype=np.int64))
        for batch in batches:
            vectors = batch.column("vector")
            x = np.array(vectors.flatten().to_numpy(zero_copy_only=False)).reshape(-1, dims)
            x = x.astype("<f4" if single else "<f8")
            code = ((_units(x) @ planes > 0).reshape(-1, tables, bits) * weight).sum(axis=2)
            yield pa.RecordBatch.from_arrays(
                [batch.column("node"), batch.column("copies"),
                 pa.array([r.tobytes() for r in x], pa.binary()),
                 pa.array([r.tobytes() for r in code.astype(code_type(bits))], pa.binary()),
                 pa.array(code.tolist(), pa.list_(pa.int64()))],
                names=["node", "copies", "vector", "code", "buckets"])

    return classes.select("node", "copies", "vector").mapInArrow(
        each, "node long, copies long, vector binary, code binary, buckets array<long>")


def places(table: pa.Table) -> np.ndarray:
    """Ascending numbers of the runs of equal (tab, bucket, i, j)."""
    keys = np.stack([table.column(c).to_numpy() for c in ("tab", "bucket", "i", "j")])
    return np.r_[0, np.cumsum((keys[:, 1:] != keys[:, :-1]).any(axis=0))]


def compare(threshold: float, dims: int, bits: int, blocks_per_call: int = 512):
    """Arrow function over rows sorted by (tab, bucket, i, j): links of every block pair."""

    def links(x: np.ndarray, code: np.ndarray, tab: int, near: np.ndarray, far: np.ndarray,
              same: bool) -> tuple[np.ndarray, np.ndarray]:
        found_a, found_b = [], []
        for at in range(0, len(near), blocks_per_call):
            part = near[at:at + blocks_per_call]
            a, b = np.nonzero(x[part] @ x[far].T >= threshold - 1e-9)
            if same:
                a, b = a[at + a < b], b[at + a < b]
            a, b = part[a], far[b]
            # exact products decide what the fast ones only suggest; earlier tables come first
            true = np.einsum("ij,ij->i", x[a], x[b]) >= threshold
            a, b = a[true], b[true]
            if tab:
                first = (code[a, :tab] != code[b, :tab]).all(axis=1)
                a, b = a[first], b[first]
            found_a.append(a)
            found_b.append(b)
        return np.concatenate(found_a), np.concatenate(found_b)

    def task(table: pa.Table) -> pa.RecordBatch | None:
        data = b"".join(table.column("vector").to_pylist())
        single = len(data) == 4 * dims * len(table)
        x = _units(np.frombuffer(data, "<f4" if single else "<f8").reshape(-1, dims))
        code = np.frombuffer(b"".join(table.column("code").to_pylist()),
                             code_type(bits)).reshape(len(table), -1)
        node, copies = table.column("node").to_numpy(), table.column("copies").to_numpy()
        tab, i, j, own = (table.column(c).to_numpy() for c in ("tab", "i", "j", "own"))
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for start, end in runs(places(table)):
            if end - start < 2:
                continue
            rows = np.arange(start, end)
            if i[start] == j[start]:
                near = far = rows
            else:
                near, far = rows[own[start:end] == i[start]], rows[own[start:end] == j[start]]
            if not len(near) or not len(far):
                continue
            a, b = links(x, code, int(tab[start]), near, far, near is far)
            if not len(a):
                continue
            seen = np.zeros(end - start, np.int64)
            np.add.at(seen, a - start, copies[b])
            np.add.at(seen, b - start, copies[a])
            heads = local_labels(end - start, a - start, b - start) + start
            hit = start + np.flatnonzero(seen)
            out.append((node[hit], node[heads[hit - start]], seen[hit - start]))
        if not out:
            return None
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)],
                                          names=["node", "head", "links"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([held, table]) if held is not None else table
            place = places(table)
            cut = int(np.searchsorted(place, place[-1]))  # the last run may go on
            if cut and (made := task(table.slice(0, cut).combine_chunks())) is not None:
                yield made
            held = table.slice(cut)
        if held is not None and (made := task(held.combine_chunks())) is not None:
            yield made

    return each


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
                    threshold: float = 0.95, recall: float = 0.9999) -> DataFrame:
    """vec_id, n_links, component_id, kept, one row for each input row.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing
    and are components of their own. Vectors are compared with those of the same length. Equal
    vectors link with each other; rows that repeat an id count as further vectors. Null ids stay null and are no component's name unless it has no other.
    An empty table gives none; further columns are ignored.
    """
    rows, classes = classes_of(vectors, id_col, vector_col)
    rows = keep(rows)
    # On checkpointed rows the numbers are the same whenever they are made.
    classes = keep(classes).withColumn("node", F.monotonically_increasing_id())
    sizes = classes.groupBy(F.size("vector").alias("d")).count().orderBy("d").collect()
    found = None
    for d, n in sizes:
        part = _links(classes.where(F.size("vector") == d), d, n, threshold, recall)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"),
                           F.col("vec_id").alias("component_id"),
                           F.lit(True).alias("kept"))
    found = keep(found)
    root = components(found.select(F.col("node").alias("a"), F.col("head").alias("b")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    placed = keep(classes.select("key", "node", "least", "copies").join(links, "node", "left")
                  .join(root, "node", "left")
                  .select("key", "least", F.coalesce("root", "node").alias("root"),
                          (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")))
    # A component may hold a third of all classes.
    named = keep(placed.groupBy("root").agg(F.min("least").alias("component_id"),
                                            F.count(F.lit(1)).alias("n")))
    named = split_join(placed, named, "root", placed.count()).select("key", "n_links", "component_id")
    out = rows.join(named, "key", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        F.when(F.col("key").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
        .alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _links(classes: DataFrame, dims: int, n: int, threshold: float, recall: float) -> DataFrame:
    """``(node, head, links)`` of the classes with vectors of one length."""
    bits, tables = plan_tables(n, threshold, recall)
    nodes = keep(signed(classes, dims, bits, tables))
    spread = nodes.select("node", F.posexplode("buckets").alias("tab", "bucket"))
    full = spread.groupBy("tab", "bucket").agg(F.count(F.lit(1)).alias("m")).where("m > 1") \
        .withColumn("blocks", F.ceil(F.col("m") / BLOCK).cast("int"))
    # A member of a bucket of k blocks goes to the k pairs that its own block is part of.
    own = F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks")).cast("int")
    dealt = spread.join(full, ["tab", "bucket"]).withColumn("own", own) \
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))) \
        .select("node", "tab", "bucket", "own", F.least("own", "other").alias("i"),
                F.greatest("own", "other").alias("j"))
    dealt = dealt.join(nodes.select("node", "copies", "vector", "code"), "node") \
        .repartition("tab", "bucket", "i", "j") \
        .sortWithinPartitions("tab", "bucket", "i", "j")
    return dealt.mapInArrow(compare(threshold, dims, bits), "node long, head long, links long")
