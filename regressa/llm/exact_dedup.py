"""Exact deduplication by Patricia-trie owners.

Texts are compared after each run of white space became one space. A text goes to the owner of its
(length, content hash) partition, which inserts the whole byte strings of the partition into one
compressed radix trie: equality is decided on all bytes and never on a hash. A terminal node keeps
the row with the smallest identifier, the number of copies, and the handles of the rows it stands
for. An owner's rows come sorted by length and hash, so when its trie outgrows its memory it spills
the heaviest subtree: the texts in it are complete, but for those that equal the present pair.

Map tasks first insert into a trie of their own, which sends each text once a task however many
copies it has; spilled subtrees go to the shuffle. Each text that a task sends has a handle, a number
of its own; the identifiers of the task's rows stay with the handle, and owners answer by handle. So
the commonest text of all is many handles, one a task, and no key of any join is hot.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from regressa.llm.common import quoted, shared_path, utf8

#: Bytes of keys that a trie holds before it spills a subtree.
TRIE_BYTES = 24 << 20
_WHITE = b" \t\n\r\x0b\x0c"
_ROWS = 2_000
_LEN, _HASH, _COPIES = "__owner_length", "__owner_hash", "__owner_copies"


def normalised(text: bytes) -> bytes:
    """Each run of white space as one space; runs at the ends stay, as one space."""
    words = text.split()
    if not words:
        return text and b" "
    return (b" " * (text[0] in _WHITE)) + b" ".join(words) + (b" " * (text[-1] in _WHITE))


class _Node:
    __slots__ = ("edge", "kids", "best")

    def __init__(self, edge: bytes):
        self.edge, self.kids, self.best = edge, {}, None


class Terminal:
    """What a trie knows of one text: the smallest rank with its row, copies, and handles."""

    __slots__ = ("rank", "row", "copies", "handles", "place")

    def __init__(self, rank: tuple, row, copies: int, handles: list, place):
        self.rank, self.row, self.copies, self.handles, self.place = rank, row, copies, handles, place

    def add(self, other: Terminal) -> None:
        if other.rank < self.rank:
            self.rank, self.row = other.rank, other.row
        self.copies += other.copies
        self.handles += other.handles


class Trie:
    """Compressed radix trie from byte strings to terminals."""

    def __init__(self):
        self.root, self.held, self.weights = _Node(b""), 0, {}

    def insert(self, key: bytes, new: Terminal) -> None:
        node, at = self.root, 0
        while at < len(key):
            kid = node.kids.get(key[at])
            if kid is None:
                kid = node.kids[key[at]] = _Node(key[at:])
                self.held += len(key) - at
                self.weights[key[0]] = self.weights.get(key[0], 0) + len(key) - at
            elif not key.startswith(kid.edge, at):
                same = _shared(kid.edge, key, at)
                upper = node.kids[key[at]] = _Node(kid.edge[:same])
                kid.edge = kid.edge[same:]
                upper.kids[kid.edge[0]] = kid
                kid = upper
            node, at = kid, at + len(kid.edge)
        if node.best is None:
            node.best = new
        else:
            node.best.add(new)

    def spill(self, but: set[int] = frozenset()) -> list[tuple[bytes, Terminal]]:
        """Remove the heaviest subtree below the root, none of those in ``but``, and return its
        terminals (nothing where there is no other)."""
        first = max(self.weights.keys() - but, key=self.weights.get, default=None)
        if first is None:
            return []
        self.held -= self.weights.pop(first)
        return list(_terminals(self.root.kids.pop(first), b""))

    def drain(self) -> Iterator[tuple[bytes, Terminal]]:
        yield from _terminals(self.root, b"")
        self.__init__()


def gathered(rows: Iterator[tuple[bytes, Terminal]], trie_bytes: int, by_place: bool
             ) -> Iterator[tuple[bytes, Terminal]]:
    """The terminals of all ``rows``, from a trie of about ``trie_bytes``. Where rows come sorted by
    place (owners), what is spilled is complete; else (map tasks) a text may come out again."""
    trie = Trie()
    for key, new in rows:
        trie.insert(key, new)
        open_: set[int] = set()  # subtrees that hold texts which may still come
        while trie.held > trie_bytes and (found := trie.spill(open_)):
            for k, t in found:
                if by_place and t.place == new.place:
                    open_.add(k[0])
                    trie.insert(k, t)
                else:
                    yield k, t
    yield from trie.drain()


def _shared(edge: bytes, key: bytes, at: int) -> int:
    """Bytes that ``edge`` and ``key[at:]`` have in common from their start."""
    low, high = 0, min(len(edge), len(key) - at)
    while low < high:
        mid = (low + high + 1) // 2
        if key.startswith(edge[low:mid], at + low):
            low = mid
        else:
            high = mid - 1
    return low


def _terminals(node: _Node, above: bytes) -> Iterator[tuple[bytes, Terminal]]:
    stack = [(node, above)]
    while stack:
        node, above = stack.pop()
        key = above + node.edge
        if node.best is not None:
            yield key, node.best
        stack.extend((kid, key) for kid in node.kids.values())


def _blocks(rows: Iterator[tuple[int, dict]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows, given with their size in bytes, in batches of bounded size."""
    block: list[dict] = []
    total = 0
    for size, row in rows:
        block.append(row)
        total += size
        if len(block) >= _ROWS or total >= 16 << 20:
            yield from pa.Table.from_pylist(block, schema).to_batches()
            block, total = [], 0
    if block:
        yield from pa.Table.from_pylist(block, schema).to_batches()


def _rank(x) -> tuple:
    return (x is None, 0 if x is None else x)


def _code(key: bytes) -> int:
    return xxhash.xxh64_intdigest(key) - (1 << 63)


def owners(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
           trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """One row for each distinct text: the columns of the row that stays, unchanged, then the
    internal columns with the length, hash and number of copies of its normalised text."""
    extra = [T.StructField(_LEN, T.LongType()), T.StructField(_HASH, T.LongType()),
             T.StructField(_COPIES, T.LongType())]
    full = T.StructType([*docs.schema.fields, *extra])
    arrow = to_arrow_schema(full)

    def described(found: Iterator[tuple[bytes, Terminal]]) -> Iterator[tuple[int, dict]]:
        for key, t in found:
            yield len(key), {**t.row, _LEN: len(key), _COPIES: t.copies, _HASH: _code(key)}

    def rows_of(batches: Iterator[pa.RecordBatch], own: bool) -> Iterator[tuple[bytes, Terminal]]:
        for batch in batches:
            for row in batch.to_pylist():
                place = (row[_LEN], row[_HASH]) if own else None
                yield normalised((row[text_col] or "").encode()), Terminal(
                    _rank(row[id_col]), row, row[_COPIES] if own else 1, [], place)

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _blocks(described(gathered(rows_of(batches, False), trie_bytes, False)), arrow)

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _blocks(described(gathered(rows_of(batches, True), trie_bytes, True)), arrow)

    return docs.mapInArrow(combine, full).repartition(_LEN, _HASH) \
        .sortWithinPartitions(_LEN, _HASH).mapInArrow(own, full)


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, one for each distinct text, with the columns of ``docs``.

    Null texts equal empty ones; a null id stays only if its text has no other; among rows that
    repeat an id and a text any one stays; an empty table stays empty.
    """
    return owners(docs, id_col, text_col).select(*[F.col(quoted(c)) for c in docs.columns])


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
           trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """One row for each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    ``kept`` is ``doc_id <=> keep_id``: rows that repeat an id together with its text are one
    document and all say so. Null texts equal empty ones; ``keep_id`` is null only where all ids
    of a text are. Texts are read whole. Further columns of ``docs`` are ignored; an empty table
    gives no rows.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    thin = docs.select(F.col(quoted(id_col)).alias("doc_id"), F.col(quoted(text_col)).alias("text"))
    sent = (f"handle long, ids array<{kind}>, keep_id {kind}, copies long, {_LEN} long, {_HASH} long, "
            "key binary")
    answer = f"handle long, keep_id {kind}, group_size long, text_sha256 string"
    sent_rows, answer_rows = (to_arrow_schema(T.StructType.fromDDL(x)) for x in (sent, answer))

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33

        def rows() -> Iterator[tuple[bytes, Terminal]]:
            for batch in batches:
                for i, text in zip(batch.column("doc_id").to_pylist(), utf8(batch.column("text")), strict=True):
                    # Here a handle is the identifier of a row.
                    yield normalised(text), Terminal(_rank(i), i, 1, [i], None)

        def out() -> Iterator[tuple[int, dict]]:
            for n, (key, t) in enumerate(gathered(rows(), trie_bytes, False), number):
                yield len(key) + 8 * len(t.handles), {
                    "handle": n, "ids": t.handles, "keep_id": t.row, "copies": t.copies,
                    _LEN: len(key), _HASH: _code(key), "key": key}

        yield from _blocks(out(), sent_rows)

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple[bytes, Terminal]]:
            for batch in batches:
                for r in batch.to_pylist():
                    yield bytes(r["key"]), Terminal(_rank(r["keep_id"]), r["keep_id"], r["copies"],
                                                    [r["handle"]], (r[_LEN], r[_HASH]))

        def out() -> Iterator[tuple[int, dict]]:
            for key, t in gathered(rows(), trie_bytes, True):
                sha = hashlib.sha256(key).hexdigest()
                for handle in t.handles:
                    yield 80, {"handle": handle, "keep_id": t.row, "group_size": t.copies,
                               "text_sha256": sha}

        yield from _blocks(out(), answer_rows)

    # Written once, so that a handle means the same in both of its uses.
    path = shared_path(spark, "texts")
    thin.mapInArrow(combine, sent).write.parquet(path)
    texts = spark.read.parquet(path)
    groups = texts.select("handle", "keep_id", "copies", _LEN, _HASH, "key").repartition(_LEN, _HASH) \
        .sortWithinPartitions(_LEN, _HASH).mapInArrow(own, answer)
    return texts.select("handle", F.explode("ids").alias("doc_id")).join(groups, "handle").select(
        "doc_id", "keep_id", "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
