"""Byte-level BPE with a segment tree per piece: encoding and decoding.

A piece (one match of the split pattern) starts as single bytes. A segment tree over its byte
positions holds, for every position that starts a live token, the rank of the pair made of that
token and the next live one; an inner node keeps the leftmost minimum below it, so the root names
the next merge. A merge extends the token at that position and changes three leaves: its own pair,
the pair of the live token before it, and the swallowed token's position, each a point update of
logarithmic cost. Long pieces (a text without white space is one) therefore cost n log n.

Pieces of up to ``TOGETHER`` bytes are merged together: their trees are rows of one array and every
round makes one merge in each, with the same three point updates.

Pieces repeat, so a worker keeps a bounded table of the ids of *segments*. A segment starts where
ASCII white space follows a character that is no white space; no match of the pattern crosses such a
place, so the matches inside a segment are those of the whole text. The segments of many texts are
cut, hashed and made unique as arrays; equal hashes are confirmed byte by byte.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regressa.llm.common import quoted, utf8

#: Segments and ids that a worker keeps, bytes of the longest kept segment, bytes of a step.
KEPT, KEPT_IDS, LONGEST, STEP = 400_000, 1 << 22, 64, 1 << 21
#: Bytes of the longest piece merged together with others, and trees in one array.
TOGETHER, TREES = 64, 1 << 15
# The characters with Unicode's White_Space property.
_W = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_WIDE = {c.encode() for c in "\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000"} | {
    chr(c).encode() for c in range(0x2000, 0x200b)}
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
#: Odd multipliers of a byte's value and of its place in a segment.
_VALUE, _PLACE = (np.random.default_rng(seed).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2)
                  + np.uint64(1) for seed in (1, 2))
_NONE = 1 << 62


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank from a file of base64 tokens and ranks, one a line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def merge_ranks(piece: bytes, ranks: dict[bytes, int], longest: int) -> list[int]:
    """Ids of one piece: repeatedly merges the leftmost pair of the smallest rank."""
    if (whole := ranks.get(piece)) is not None:
        return [whole]
    n = len(piece)
    bits = (n - 1).bit_length()
    size, mask = 1 << bits, (1 << bits) - 1

    # A leaf is (rank, position) as one number: the smallest is the leftmost minimum.
    tree = [_NONE] * (2 * size)
    for i in range(n - 1):
        rank = ranks.get(piece[i:i + 2])
        if rank is not None:
            tree[size + i] = rank << bits | i
    for i in range(size - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a < b else b

    def update(position: int, value: int) -> None:
        i = size + position
        tree[i] = value
        while i > 1:
            other = tree[i ^ 1]
            if other < value:
                value = other
            i >>= 1
            if tree[i] == value:
                return
            tree[i] = value

    def pair(position: int) -> int:
        """The leaf of the live token at ``position`` and the one after it."""
        middle = after[position]
        if middle >= n or after[middle] - position > longest:
            return _NONE
        rank = ranks.get(piece[position:after[middle]])
        return _NONE if rank is None else rank << bits | position

    ids = [ranks[piece[i:i + 1]] for i in range(n)]
    after, before = list(range(1, n + 1)), list(range(-1, n))
    while (top := tree[1]) != _NONE:
        at = top & mask
        gone = after[at]
        ids[at] = top >> bits
        after[at] = after[gone]
        before[after[gone]] = at
        update(gone, _NONE)
        update(at, pair(at))
        if before[at] >= 0:
            update(before[at], pair(before[at]))
    out, at = [], 0
    while at < n:
        out.append(ids[at])
        at = after[at]
    return out


class Pairs:
    """Rank of the token that two tokens make, for arrays of ids."""

    def __init__(self, ranks: dict[bytes, int]):
        made = {(a << 32) | b: rank for token, rank in ranks.items() for i in range(1, len(token))
                if (a := ranks.get(token[:i])) is not None and (b := ranks.get(token[i:])) is not None}
        self.keys = np.array(sorted(made), np.int64)
        self.ranks = np.array([made[k] for k in self.keys.tolist()], np.int64)
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)

    def leaf(self, left: np.ndarray, right: np.ndarray, position: np.ndarray, bits: int) -> np.ndarray:
        """Tree leaves (rank, position); ``_NONE`` where the pair makes no token."""
        key = (left << 32) | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at] << bits | position, _NONE)

    def merge(self, pieces: list[bytes], bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces of 2 to ``2 ** bits`` bytes, one after the other, and their counts."""
        size, m = 1 << bits, len(pieces)
        n = np.fromiter(map(len, pieces), np.int64, m)
        text = np.frombuffer(b"".join([p.ljust(size, b"\0") for p in pieces]), np.uint8).reshape(m, size)
        place = np.arange(size)
        live = place < n[:, None]
        ids = self.single[text]
        tree = np.full((m, 2 * size), _NONE)
        pairs = self.leaf(ids[:, :-1], ids[:, 1:], place[:-1], bits)
        tree[:, size:-1] = np.where(live[:, 1:], pairs, _NONE)
        for low in (1 << b for b in reversed(range(bits))):
            tree[:, low:2 * low] = np.minimum(tree[:, 2 * low:4 * low:2], tree[:, 2 * low + 1:4 * low:2])
        # Flat views: a tree's row starts at ``root``, a piece's bytes at ``first``.
        after = np.tile(place + 1, m)
        before = np.tile(place - 1, m)
        live, ids, tree = live.ravel(), ids.ravel(), tree.ravel()
        row = np.flatnonzero(tree[1::2 * size] != _NONE)
        while len(row):
            root, first = row * (2 * size), row * size
            top = tree[root + 1]
            at = top & (size - 1)
            here = first + at
            gone = after[here]
            end = after[first + gone]
            token = top >> bits
            ids[here], after[here], live[first + gone] = token, end, False
            inner = np.flatnonzero(end < n[row])
            before[(first + end)[inner]] = at[inner]
            mine = np.full(len(row), _NONE)
            mine[inner] = self.leaf(token[inner], ids[(first + end)[inner]], at[inner], bits)
            some = np.flatnonzero(at)
            left = before[here[some]]
            tree[root + size + gone] = _NONE
            tree[root + size + at] = mine
            tree[root[some] + size + left] = self.leaf(ids[first[some] + left], token[some], left, bits)
            base = np.concatenate([root, root, root[some]])
            node = np.concatenate([gone, at, left]) + size
            for _ in range(bits):
                node >>= 1
                below = base + 2 * node
                tree[base + node] = np.minimum(tree[below], tree[below + 1])
            row = row[tree[root + 1] != _NONE]
        return ids[live].astype(np.int32), np.add.reduceat(live, np.arange(0, len(live), size))


def _gathered(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The runs ``flat[start:start + size]``, one after the other."""
    ends = np.cumsum(size)
    if not len(ends):
        return flat[:0]
    return flat[np.repeat(start - ends + size, size) + np.arange(ends[-1])]


def segments(data: bytes, first: np.ndarray) -> tuple[np.ndarray, ...]:
    """Starts and lengths of the segments of joined texts that begin at ``first``, the number of each
    segment's kind, and one segment of each kind."""
    text = np.frombuffer(data, np.uint8)
    blank = _BLANK[text]
    cuts = np.zeros(len(text), bool)
    cuts[1:] = blank[1:] & ~blank[:-1]
    # After a wide white space the run goes on: no cut. (Its last byte is no ASCII.)
    for at in np.flatnonzero(cuts[1:] & (text[:-1] >= 0x80)).tolist():
        if data[at - 1:at + 1] in _WIDE or data[at - 2:at + 1] in _WIDE:
            cuts[at + 1] = False
    cuts[first] = True
    start = np.flatnonzero(cuts)
    if not len(start):
        return start, start, start, start
    length = np.diff(np.append(start, len(text)))
    inside = np.arange(len(text)) - np.repeat(start, length)
    code = np.add.reduceat(_VALUE[text] * _PLACE[inside & 255], start) + length.astype(np.uint64)
    _, unique, of = np.unique(code, return_index=True, return_inverse=True)
    # Confirm that equal codes are equal bytes; a segment that is not gets a kind of its own.
    like = unique[of]
    same = length == length[like]
    twin = np.minimum(np.repeat(start[like], length) + inside, len(text) - 1)
    same &= np.logical_and.reduceat(text == text[twin], start)
    odd = np.flatnonzero(~same)
    of[odd] = len(unique) + np.arange(len(odd))
    return start, length, of, np.concatenate([unique, odd])


class Codec:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str):
        import public_tokenizers
        import regex

        self.ranks = read_ranks(path)
        self.longest = max(map(len, self.ranks))
        # The decoder's table: the bytes of all tokens, and where each token's are.
        self.token_size = np.zeros(max(self.ranks.values()) + 1, np.int64)
        self.token_size[list(self.ranks.values())] = list(map(len, self.ranks))
        self.token_start = np.cumsum(self.token_size) - self.token_size
        self.token_bytes = np.frombuffer(b"".join(sorted(self.ranks, key=self.ranks.get)), np.uint8)
        self.pairs = Pairs(self.ranks)
        # White space by its Unicode property, as the library's engine reads it.
        self.pattern = regex.compile(
            public_tokenizers.PATTERN.replace("[^\\s", f"[^{_W}").replace("\\s", f"[{_W}]")
            .replace("\\S", f"[^{_W}]"))
        self.clear()

    def clear(self) -> None:
        """An empty table: a segment's number, and where its ids lie."""
        self.kept: dict[bytes, int] = {}
        self.ids, self.start, self.size = (np.zeros(0, d) for d in (np.int32, np.int64, np.int64))

    def pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of different pieces in one array, with the start and number of each piece's."""
        start, size = np.zeros(len(pieces), np.int64), np.ones(len(pieces), np.int64)
        parts, total = [], 0
        whole = [(i, r) for i, p in enumerate(pieces) if (r := self.ranks.get(p)) is not None]
        if whole:
            start[[i for i, _ in whole]] = np.arange(len(whole))
            parts, total = [np.array([r for _, r in whole], np.int32)], len(whole)
        length = np.fromiter(map(len, pieces), np.int64, len(pieces))
        length[[i for i, _ in whole]] = 0
        done = np.ceil(np.log2(np.maximum(length, 1))).astype(int)
        for bits in np.unique(done[length > 0]).tolist():
            group = np.flatnonzero((done == bits) & (length > 0))
            if 1 << bits > TOGETHER:
                made = [merge_ranks(pieces[i], self.ranks, self.longest) for i in group.tolist()]
                counts = np.fromiter(map(len, made), np.int64, len(made))
                found = [(group, np.array(list(chain.from_iterable(made)), np.int32), counts)]
            else:
                found = [(g, *self.pairs.merge([pieces[j] for j in g.tolist()], bits))
                         for g in np.split(group, range(TREES, len(group), TREES))]
            for g, ids, counts in found:
                start[g], size[g] = total + np.cumsum(counts) - counts, counts
                parts.append(ids)
                total += len(ids)
        return np.concatenate(parts) if parts else np.zeros(0, np.int32), start, size

    def learn(self, new: list[bytes]) -> None:
        """Adds the ids of new segments to the table."""
        split = [self.pattern.findall(s.decode()) for s in new]
        all_ = list(chain.from_iterable(split))
        number = {p: i for i, p in enumerate(dict.fromkeys(all_))}
        ids, start, size = self.pieces([p.encode() for p in number])
        which = np.fromiter(map(number.__getitem__, all_), np.int64, len(all_))
        of = np.fromiter(map(len, split), np.int64, len(split))
        sizes = np.add.reduceat(size[which], np.cumsum(of) - of)
        first = len(self.start)
        self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(sizes) - sizes])
        self.size = np.concatenate([self.size, sizes])
        self.ids = np.concatenate([self.ids, _gathered(ids, start[which], size[which])])
        self.kept.update(zip(new, range(first, first + len(new)), strict=True))

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of UTF-8 texts, one after the other, and their number in each text."""
        data = b"".join(texts)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        first = np.cumsum(sizes) - sizes
        start, length, of, unique = segments(data, first[sizes > 0])
        found = [data[a:a + n] for a, n in zip(start[unique].tolist(), length[unique].tolist(), strict=True)]
        new = [s for s in found if s not in self.kept]
        if len(self.kept) + len(new) > KEPT or len(self.ids) > KEPT_IDS:
            self.clear()
            new = found
        if new:
            self.learn(new)
        which = np.fromiter(map(self.kept.__getitem__, found), np.int64, len(found))[of]
        counts = self.size[which]
        out = _gathered(self.ids, self.start[which], counts)
        for s in new:
            if len(s) > LONGEST:
                del self.kept[s]
        before = np.concatenate([[0], np.cumsum(counts)])
        ends = np.searchsorted(start, np.append(first, len(data)))
        return out, np.diff(before[ends])

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The bytes of sequences of ``counts`` ids, one after the other, how many each has, and
        whether all of its ids belong to the vocabulary (an unknown id has no bytes)."""
        known = (ids >= 0) & (ids < len(self.token_size))
        at = np.where(known, ids, 0)
        known &= self.token_size[at] > 0
        size = np.where(known, self.token_size[at], 0)
        ends = np.concatenate([[0], np.cumsum(counts)])
        before = np.concatenate([[0], np.cumsum(size)])
        missing = np.concatenate([[0], np.cumsum(~known)])
        return (_gathered(self.token_bytes, self.token_start[at], size), np.diff(before[ends]),
                np.diff(missing[ends]) == 0)


_loaded: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """The worker's codec: its table serves all tasks of the worker."""
    if path not in _loaded:
        _loaded[path] = Codec(path)
    return _loaded[path]


def _steps(sizes: list[int], limit: int) -> Iterator[tuple[int, int]]:
    """Cuts rows into runs of at most ``limit`` in size, or one row."""
    start = total = 0
    for i, size in enumerate(sizes):
        if i > start and total + size > limit:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)


def _with_column(df: DataFrame, name: str, kind: str, taken: str, run) -> DataFrame:
    """``df`` and one more column that ``run`` makes from the column ``taken``. Inside, columns go
    by their position, as ``mapInArrow`` takes no names with dots."""
    if name == taken:
        raise ValueError(f"{name!r} is the column that is read")
    df = df.drop(F.col(quoted(name))) if name in df.columns else df
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    at = df.columns.index(taken)
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in plain.schema.fields),
                        f"made {kind}"])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, made in run(batch, at):
                yield pa.RecordBatch.from_arrays([*part.columns, made],
                                                 names=[*part.schema.names, "made"])

    return plain.mapInArrow(whole, schema).toDF(*df.columns, name)


def encode(df: DataFrame, text_col: str = "text", ids_col: str = "ids",
           vocabulary: str | None = None) -> DataFrame:
    """``df`` with the token ids of ``text_col`` as ``ids_col`` (array<int>).

    ``vocabulary`` is the path of a file of ranks, the same on every executor. Null texts count as
    empty and give an empty array; rows are handled one by one, so repeated rows, ties and empty
    tables need no rule. A column that is already named ``ids_col`` is replaced.
    """
    path = vocabulary or default_vocabulary()

    def run(batch: pa.RecordBatch, at: int) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
        machine = codec(path)
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(at)), 0).to_pylist()
        for start, end in _steps(sizes, STEP):
            part = batch.slice(start, end - start)
            ids, counts = machine.encode(utf8(part.column(at)))
            offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            yield part, pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))

    return _with_column(df, ids_col, "array<int>", text_col, run)


def decode(df: DataFrame, ids_col: str = "ids", bytes_col: str = "decoded",
           vocabulary: str | None = None) -> DataFrame:
    """``df`` with the bytes that ``ids_col`` stands for as ``bytes_col`` (binary).

    Bytes, not a text: a cut sequence may end inside a character. A null array, a null id and an id
    outside the vocabulary give null. A column that is already named ``bytes_col`` is replaced.
    """
    path = vocabulary or default_vocabulary()

    def run(batch: pa.RecordBatch, at: int) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
        machine = codec(path)
        sizes = pa.compute.fill_null(pa.compute.list_value_length(batch.column(at)), 0)
        for start, end in _steps(sizes.to_pylist(), STEP):
            part = batch.slice(start, end - start)
            lists = part.column(at)
            counts = sizes.slice(start, end - start).to_numpy().astype(np.int64)
            ids = pa.compute.fill_null(lists.flatten(), -1).to_numpy()
            data, length, whole = machine.decode(ids, counts)
            offsets = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
            made = pa.Array.from_buffers(pa.binary(), len(part), [None, pa.py_buffer(offsets),
                                                                  pa.py_buffer(data)])
            good = pa.array(whole & lists.is_valid().to_numpy(zero_copy_only=False))
            yield part, pa.compute.if_else(good, made, pa.scalar(None, pa.binary()))

    return _with_column(df, bytes_col, "binary", ids_col, run)


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
           vocabulary: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row: digests of the ids and of the
    bytes that decoding them gives back. Null texts count as empty, null ids are kept, a row that
    repeats gives as many equal rows, an empty table none; further columns are ignored."""
    thin = docs.select(F.col(quoted(id_col)).alias("doc_id"), F.col(quoted(text_col)).alias("text"))
    done = decode(encode(thin, vocabulary=vocabulary).select("doc_id", "ids"), vocabulary=vocabulary)
    joined = F.array_join(F.col("ids").cast("array<string>"), ",")
    return done.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                       F.sha2(joined, 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))
