"""Distributed ordering primitives: running sums, row numbers, exact quantiles.

A window with ``ORDER BY`` and no ``PARTITION BY`` runs in one task; at
cluster scale that task would hold the whole table. Here the order is cut
into range partitions instead:

1. ``repartitionByRange(B, keys)`` and tag each row with its partition id;
   the result is checkpointed so that the ids never change, even when an
   executor is lost and a stage is recomputed.
2. Per (partition id, group) totals: at most B rows per group.
3. Offsets = running total over those few rows per group.
4. Inside each range partition a partitioned window gives the local running
   sum; offset + local = global running sum.

Skew: a single hot order value is spread by the tie-breaking keys the caller
adds; for value-count inputs (KS) values are aggregated to ``(value, count)``
before ranking, so a hot value is one row.

Where only some ranks are wanted (quantiles, medians, terciles), no row moves at
all: see :func:`order_statistics`.
"""

from __future__ import annotations

import itertools
import math
import struct
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from regressa.functions.columns import col
from regressa.session import cut_lineage


def range_buckets(df: DataFrame, num_buckets: int | None, scale_hint: int = 1) -> int:
    """Range partitions for an ordering: at least ``spark.sql.shuffle.partitions``
    and at least the input's own partition count times ``scale_hint`` (scan
    splits are ~128 MB each, so range partitions stay about that size however
    large the table is). Planning only, no job."""
    if num_buckets:
        return int(num_buckets)
    conf = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return max(conf, df.rdd.getNumPartitions() * max(1, int(scale_hint)))


def _as_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def with_running_sums(
    df: DataFrame,
    order_by: Sequence[str],
    weights: Mapping[str, Column | str],
    partition_by: Sequence[str] = (),
    num_buckets: int | None = None,
) -> DataFrame:
    """Add ``<name>_before`` = sum of weight over all rows strictly earlier in
    the order ``order_by`` (ascending, nulls first) within ``partition_by``.

    ``order_by`` should make the order total (add key columns to break ties).
    """
    order_by = list(order_by)
    partition_by = list(partition_by)
    names = list(weights)
    cols = df.columns
    b = range_buckets(df, num_buckets)

    tagged = df.select(
        *[F.col(c) for c in cols],
        *[_as_col(weights[n]).alias(f"__w_{n}") for n in names],
    )
    ranged = cut_lineage(
        tagged.repartitionByRange(b, *partition_by, *order_by)
        .withColumn("__pid", F.spark_partition_id())
    )

    keys = ["__pid", *partition_by]
    totals = ranged.groupBy(*keys).agg(
        *[F.sum(f"__w_{n}").alias(f"__t_{n}") for n in names]
    )
    ow = (Window.partitionBy(*partition_by) if partition_by else Window).orderBy(
        "__pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *keys,
        *[F.coalesce(F.sum(f"__t_{n}").over(ow), F.lit(0)).alias(f"__o_{n}") for n in names],
    )
    if not partition_by:
        # At most B rows (one per range partition): a proven bound.
        offsets = F.broadcast(offsets)

    lw = Window.partitionBy(*keys).orderBy(*order_by).rowsBetween(
        Window.unboundedPreceding, -1)
    local = ranged.select(
        "*",
        *[F.coalesce(F.sum(f"__w_{n}").over(lw), F.lit(0)).alias(f"__l_{n}") for n in names],
    )
    joined = local.join(offsets, on=keys, how="inner")
    return joined.select(
        *[F.col(c) for c in cols],
        *[(F.col(f"__o_{n}") + F.col(f"__l_{n}")).alias(f"{n}_before") for n in names],
    )


def with_row_number(
    df: DataFrame,
    order_by: Sequence[str],
    partition_by: Sequence[str] = (),
    name: str = "row_number",
    num_buckets: int | None = None,
) -> DataFrame:
    """``row_number()`` (1-based) over a total order without a one-task window."""
    out = with_running_sums(df, order_by, {"__rn": F.lit(1).cast("long")},
                            partition_by=partition_by, num_buckets=num_buckets)
    return out.withColumn(name, F.col("__rn_before") + F.lit(1)).drop("__rn_before")


def value_counts_cumulative(
    long_df: DataFrame,
    value_col: str,
    group_cols: Sequence[str],
    weight_cols: Sequence[str] = (),
    num_buckets: int | None = None,
) -> DataFrame:
    """Aggregate to distinct ``(group, value)`` with counts, then add the
    number of rows with a smaller value in the same group (``cnt_before``).

    ``weight_cols`` are extra 0/1 or count columns summed per value, each with
    its own ``<w>_before`` running sum (used by the two-sample KS test).
    """
    group_cols = list(group_cols)
    aggs = [F.count(F.lit(1)).alias("cnt")]
    aggs += [F.sum(w).alias(w) for w in weight_cols]
    counts = long_df.groupBy(*group_cols, value_col).agg(*aggs)
    weights = {"cnt": "cnt", **{w: w for w in weight_cols}}
    return with_running_sums(counts, [value_col], weights, partition_by=group_cols,
                             num_buckets=num_buckets)


#: Cells of a histogram that narrows a bracket (the first, over the whole range, has 16 times as
#: many), and rows up to which a bracket's values are collected (as distinct values with counts).
SKETCH_CELLS, BRACKET_ROWS = 4096, 4096
#: Rows that a task counts at once, and filled cells up to which it looks at the cells' ends.
BLOCK_ROWS, LOOKED_AT = 1 << 18, 16
_SIGN = np.uint64(1 << 63)


def _ordered(v: np.ndarray) -> np.ndarray:
    """Doubles (no NaN) as unsigned integers of the same order; both zeros are one."""
    u = (v + 0.0).view(np.uint64)
    return np.where(u >= _SIGN, ~u, u | _SIGN)


def _double(key: int) -> float:
    bits = key ^ (1 << 63) if key >> 63 else key ^ (2 ** 64 - 1)
    return struct.unpack("<d", struct.pack("<Q", bits))[0]


@dataclass
class _Bracket:
    """Where the value of one rank lies: the leading bits of its ordered key."""

    column: int
    rank: int
    prefix: int = 0
    known: int = 0
    below: int = 0  # rows below the bracket


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Ordered keys of each column, many batches at once."""
    held, rows = [], 0
    for batch in itertools.chain(batches, [None]):
        if batch is not None:
            held.append([c.drop_null().to_numpy() for c in batch.columns])
            rows += batch.num_rows
        if held and (batch is None or rows >= BLOCK_ROWS):
            yield [_ordered(np.concatenate(c)) for c in zip(*held, strict=True)]
            held, rows = [], 0


def _inside(keys: np.ndarray, prefix: int, known: int) -> np.ndarray:
    return keys[keys >> np.uint64(64 - known) == np.uint64(prefix)] if known else keys


def _cells(flat: DataFrame, brackets: set, bits: int) -> dict:
    """Rows of each filled cell of ``brackets (column, prefix, known bits)``: ``{bracket: [(cell,
    rows, the only key in it or None), ...]}`` in order. One scan."""
    wanted = sorted(brackets)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros(1 << bits, np.int64) for _ in wanted]
        ends: list[dict] = [{} for _ in wanted]
        for block in _blocks(batches):
            for j, (c, prefix, known) in enumerate(wanted):
                keys = _inside(block[c], prefix, known)
                if not len(keys):
                    continue
                cell = ((keys >> np.uint64(64 - known - bits)) & np.uint64((1 << bits) - 1)).astype(np.int64)
                n = np.bincount(cell, minlength=1 << bits)
                total[j] += n
                filled = np.flatnonzero(n)
                for at in filled.tolist() if len(filled) <= LOOKED_AT else ():
                    own = keys if len(filled) == 1 else keys[cell == at]
                    ends[j].setdefault(at, []).extend((own.min(), own.max()))
                if len(filled) > LOOKED_AT:  # not looked at: the cell's own ends
                    ends[j] |= {at: [np.uint64(0), np.uint64(2 ** 64 - 1)] for at in filled.tolist()}
        for j, n in enumerate(total):
            at = np.flatnonzero(n)
            low, high = (np.array([f(ends[j][i]) for i in at.tolist()], np.uint64) ^ _SIGN for f in (min, max))
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(len(at), j, np.int32)), pa.array(at, pa.int32()), pa.array(n[at]),
                pa.array(low.view(np.int64)), pa.array(high.view(np.int64))], names=["j", "cell", "n", "low", "high"])

    found = flat.mapInArrow(count, "j int, cell int, n long, low long, high long").groupBy("j", "cell").agg(
        F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    out: dict = {b: [] for b in wanted}
    for r in found.collect():
        out[wanted[r["j"]]].append((r["cell"], r["n"], r["low"] + 2 ** 63 if r["low"] == r["high"] else None))
    return {b: sorted(cells, key=lambda x: x[0]) for b, cells in out.items()}


def order_statistics(df: DataFrame, ranks: Mapping[str, Callable[[int], Sequence[int]]]) -> dict:
    """Exact order statistics of numeric columns, without sorting, shuffling or writing a row.

    ``ranks`` gives, for a column and its number of values, the 0-based ranks that are wanted;
    nulls and NaN are ignored. Returns ``{column: (n, {rank: (value, rows below it, rows equal to
    it)})}``.

    A scan counts the rows in each cell of a histogram over the leading bits of the values, whose
    order is that of the values; the cells that hold the wanted ranks are cut again by their next
    bits. A cell of few rows is collected as values with counts; one that is a single value is done
    however many rows share it. At most six scans, whatever the values; the driver sees cells of
    counts and at most ``BRACKET_ROWS`` values a bracket.
    """
    columns = list(ranks)
    flat = df.select(*[F.nanvl(col(c).cast("double"), F.lit(None).cast("double")).alias(f"c{i}")
                       for i, c in enumerate(columns)])
    step = SKETCH_CELLS.bit_length() - 1
    found: dict = {}
    few: list[tuple] = []  # brackets of few rows

    def follow(b: _Bracket, cells: list, bits: int) -> _Bracket | None:
        """The cell that holds the rank; None where that settles it."""
        for cell, n, only in cells:
            if b.rank < b.below + n:
                b.prefix, b.known = (b.prefix << bits) | cell, b.known + bits
                if b.known == 64:
                    only = b.prefix
                if only is not None:
                    found[columns[b.column]][1][b.rank] = (_double(only), b.below, n)
                elif n <= BRACKET_ROWS:
                    few.append(b)
                else:
                    return b
                return None
            b.below += n
        raise ValueError(f"rank {b.rank} is beyond the row count")

    bits = min(64, step + 4)
    counted = _cells(flat, {(i, 0, 0) for i in range(len(columns))}, bits)
    open_: list = []
    for i, c in enumerate(columns):
        cells = counted[i, 0, 0]
        n = sum(x[1] for x in cells)
        found[c] = (n, {})
        wanted = sorted({int(r) for r in ranks[c](n) if 0 <= r < n}) if n else []
        open_ += [b for r in wanted if (b := follow(_Bracket(i, r), cells, bits))]
    while open_:
        bits = min(step, 64 - open_[0].known)
        counted = _cells(flat, {(b.column, b.prefix, b.known) for b in open_}, bits)
        open_ = [b for b in open_ if follow(b, counted[b.column, b.prefix, b.known], bits)]
    if few:
        spans = sorted({(b.column, b.prefix, b.known) for b in few})

        def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for block in _blocks(batches):
                for j, (c, prefix, known) in enumerate(spans):
                    keys, n = np.unique(_inside(block[c], prefix, known), return_counts=True)
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.full(len(keys), j, np.int32)), pa.array((keys ^ _SIGN).view(np.int64)),
                        pa.array(n, pa.int64())], names=["j", "key", "n"])

        values: dict[tuple, list] = {}
        for r in flat.mapInArrow(collect, "j int, key long, n long").groupBy("j", "key").agg(
                F.sum("n").alias("n")).collect():
            values.setdefault(spans[r["j"]], []).append((r["key"] + 2 ** 63, r["n"]))
        for b in few:
            below = b.below
            for key, n in sorted(values[b.column, b.prefix, b.known]):
                if b.rank < below + n:
                    found[columns[b.column]][1][b.rank] = (_double(key), below, n)
                    break
                below += n
    return found


def exact_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """Exact quantiles with linear interpolation (pandas' default, DuckDB's ``quantile_cont``) of
    numeric columns: rows ``(column, prob, value)``; nulls and NaN are ignored, and a column with
    no values has no rows."""
    def wanted(n: int) -> list[int]:
        return [r for p in probs for r in (math.floor(p * (n - 1)), math.ceil(p * (n - 1)))]

    rows = []
    for c, (n, at) in order_statistics(df, {c: wanted for c in columns}).items():
        for p in probs if n else ():
            h = p * (n - 1)
            low, high = at[math.floor(h)][0], at[math.ceil(h)][0]
            rows.append((c, float(p), low + (high - low) * (h - math.floor(h)) if high != low else low))
    return df.sparkSession.createDataFrame(rows, "column string, prob double, value double")


def unpivot_numeric(df: DataFrame, columns: Sequence[str], id_cols: Sequence[str] = (),
                    name: str = "column", value: str = "value") -> DataFrame:
    """Long form ``(*id_cols, column, value double)``; NaN becomes null."""
    entries = F.array(*[F.struct(F.lit(c).alias(name), F.nanvl(
        col(c).cast("double"), F.lit(None).cast("double")).alias(value)) for c in columns])
    return df.select(*[col(c) for c in id_cols], F.explode(entries).alias("__e")) \
        .select(*[col(c) for c in id_cols], f"__e.{name}", f"__e.{value}")


# Largest number of rows in the wanted prefix buckets that the last pass may
# collect directly (as distinct hashes with counts) instead of refining the
# prefix once more.
DIRECT_BUCKET_ROWS = 50_000


def hash_prefix_histogram(df: DataFrame, hash_col, width: int = 4) -> list:
    """Row counts per ``width``-digit hash prefix, sorted (at most 16^width
    rows, combined map-side). Their sum is the row count."""
    h = df.select(_as_col(hash_col).alias("__h")).where(F.col("__h").isNotNull())
    rows = h.groupBy(F.substring("__h", 1, width).alias("p")).agg(
        F.count(F.lit(1)).alias("n")).collect()
    return sorted((r["p"], r["n"]) for r in rows)


def hash_rank_thresholds(df: DataFrame, hash_col, ranks, histogram=None) -> list:
    """Exact values at 0-based ``ranks`` in the ascending order of a uniform
    hex hash column (e.g. ``md5``), without sorting or shuffling rows.

    Pass 1 counts rows per 4-hex-digit prefix (at most 65,536 groups,
    combined map-side; pass ``histogram`` to reuse one). While the buckets
    holding the wanted ranks are large, one more pass refines them by 4 more
    digits; once they hold at most ``DIRECT_BUCKET_ROWS`` rows, a last pass
    collects their distinct hashes with counts. The driver only sees these
    bounded histograms; a hash repeated many times is one counted row.
    """
    h = df.select(_as_col(hash_col).alias("__h")).where(F.col("__h").isNotNull())
    ranks = [int(r) for r in ranks]
    hist = histogram if histogram is not None else hash_prefix_histogram(df, hash_col, 4)
    prefixes, rem, sizes = [], [], []
    for r in ranks:
        acc = 0
        for p, n in hist:
            if r < acc + n:
                prefixes.append(p)
                rem.append(r - acc)
                sizes.append(n)
                break
            acc += n
        else:
            raise ValueError(f"rank {r} is beyond the row count")
    width = 4
    while sum(sizes[i] for i in {prefixes.index(p) for p in set(prefixes)}) > DIRECT_BUCKET_ROWS \
            and width < 32:
        wanted = sorted(set(prefixes))
        nxt = min(width + 4, 32)
        counts = (h.where(F.substring("__h", 1, width).isin(wanted))
                  .groupBy(F.substring("__h", 1, nxt).alias("p"))
                  .agg(F.count(F.lit(1)).alias("n")).collect())
        children: dict[str, list] = {}
        for r in counts:
            children.setdefault(r["p"][:width], []).append((r["p"], r["n"]))
        for i, parent in enumerate(prefixes):
            acc = 0
            for p, n in sorted(children.get(parent, [])):
                if rem[i] < acc + n:
                    prefixes[i], rem[i], sizes[i] = p, rem[i] - acc, n
                    break
                acc += n
        width = nxt
    wanted = sorted(set(prefixes))
    vals = (h.where(F.substring("__h", 1, width).isin(wanted))
            .groupBy("__h").agg(F.count(F.lit(1)).alias("n")).collect())
    by_prefix: dict[str, list] = {}
    for r in vals:
        by_prefix.setdefault(r["__h"][:width], []).append((r["__h"], r["n"]))
    out = []
    for i, p in enumerate(prefixes):
        acc = 0
        for v, n in sorted(by_prefix[p]):
            if rem[i] < acc + n:
                out.append(v)
                break
            acc += n
    return out
