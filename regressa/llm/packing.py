"""Packing along a space-filling curve.

Each document becomes a hashed vector of its tokens, is projected to a few dimensions and gets
the Hilbert key of its cell; documents are range-sorted by that key, so neighbours along the curve
use similar words, and are laid end to end into sequences. Every sequence is full; the rest of a
range is cut into sequences whose lengths are powers of two, which need no padding.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regressa.llm.common import quoted, shared_path, text_or_empty

#: Hash buckets of a document vector, dimensions of the curve and bits of each (48 in all).
BUCKETS, DIMS, BITS, SEED = 1024, 3, 16, 42
#: Words that a worker keeps, bytes of the longest kept word, bytes of text between two looks-up.
WORDS, LONGEST, STEP = 250_000, 48, 4 << 20
#: A word that is one token, and punctuation that may close a word (no apostrophe: that may open
#: a contraction).
SEPARATOR, CLOSING = b"|", b".,;:!?*#$%&)]}\""
WORD_END, LATIN = "</w>", re.compile("[a-z\xdf-\xf6\xf8-\xff]+").fullmatch


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def projection() -> np.ndarray:
    """The seeded Gaussian map from hash buckets to curve dimensions."""
    return np.random.default_rng(SEED).standard_normal((BUCKETS, DIMS))


def hashed_vectors(ids: np.ndarray, ends: np.ndarray, plane: np.ndarray) -> np.ndarray:
    """Projected unit vectors of hashed token counts, one row a document (zero if it has none);
    ``ends`` are the ends of the documents in ``ids``."""
    hashed = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(54)).astype(np.int64)
    out = np.zeros((len(ends), plane.shape[1]))
    for i, (a, b) in enumerate(zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)):
        if b > a:
            counts = np.bincount(hashed[a:b], minlength=BUCKETS)
            out[i] = counts @ plane / np.sqrt(float(counts @ counts))
    return out


def cells(points: np.ndarray) -> np.ndarray:
    """Grid cells of projected points; the normal scale of the projection fills the grid evenly."""
    even = 1 / (1 + np.exp(-1.702 * points))
    return np.minimum((even * (1 << BITS)).astype(np.int64), (1 << BITS) - 1)


def hilbert_keys(cell: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Positions of grid cells (rows) on the Hilbert curve, by Gray-code reflection of the axes
    from the coarsest bit to the finest."""
    x = cell.astype(np.int64).T.copy()
    dims = len(x)
    for level in range(bits - 1, 0, -1):
        bit, low = 1 << level, (1 << level) - 1
        for axis in range(dims):
            flip = (x[axis] & bit) != 0
            swap = np.where(flip, 0, (x[0] ^ x[axis]) & low)
            x[0] ^= np.where(flip, low, swap)
            x[axis] ^= swap
    for axis in range(1, dims):
        x[axis] ^= x[axis - 1]
    turn = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        turn ^= np.where(x[-1] & (1 << level), (1 << level) - 1, 0)
    x ^= turn
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for axis in range(dims):
            key = key << 1 | (x[axis] >> level & 1)
    return key


def byte_ranks(path: str) -> dict[bytes, int] | None:
    """Merge ranks of a byte-level BPE file with word ends, a word end written as NUL; none if the
    file is of another kind. Ids are ranks there: bytes, closing bytes, then merges in order."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    if model.get("type") != "BPE" or model.get("end_of_word_suffix") != WORD_END:
        return None
    vocab, merges = model["vocab"], model["merges"]
    pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
    if any(vocab.get("".join(p)) != 512 + i for i, p in enumerate(pairs)):
        return None
    # The byte-level alphabet: printing characters are themselves, other bytes follow from 256.
    plain = [b for b in range(256) if 33 <= b < 127 or 161 <= b != 173]
    others = [b for b in range(256) if b not in plain]
    byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}
    ranks = {}
    for token, i in vocab.items():
        if i < 512 + len(merges):
            core = token.removesuffix(WORD_END)
            ranks[bytes(byte[c] for c in core) + b"\0" * (core != token)] = i
    return ranks


class Encoder:
    """Token ids of texts, as packed unsigned integers.

    The tokenizer works within words and lower-cases, so the ids of lower-cased words are kept in
    two bounded generations (the older is dropped when the younger is full). A word that ends in
    punctuation after a letter is the word and the punctuation, which the split pattern parts.
    New words of small Latin letters, which the normaliser and the split pattern leave as they
    are, are merged by the same ranks in ``tiktoken``; others go to the library itself. Either
    gets them in one text, with a separator between them.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        mark = self._ids(SEPARATOR.decode())
        self.mark = mark[0] if len(mark) == 1 else None
        self.ranks, self.merger = byte_ranks(path), None
        if self.ranks:
            import tiktoken

            self.merger = tiktoken.Encoding("words", pat_str="[^ ]+| ", mergeable_ranks=self.ranks,
                                            special_tokens={})

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids,
                        self.dtype)

    def _look_up(self, words: list[bytes]) -> dict[bytes, bytes]:
        """The library's ids of distinct words."""
        if not words:
            return {}
        made, rest = {}, words
        if self.merger:
            texts = [(w, w.decode()) for w in words]
            latin = [x for x in texts if LATIN(x[1])]
            rest = [w for w, t in texts if not LATIN(t)]
            if latin:
                ids = self.merger.encode_ordinary("\0 ".join(t for _, t in latin) + "\0")
                self._part(made, [w for w, _ in latin], np.array(ids, self.dtype), self.ranks[b" "])
        plain = [w for w in rest if SEPARATOR not in w] if self.mark is not None else []
        if plain:
            ids = self._ids((b" " + SEPARATOR + b" ").join(plain).decode())
            self._part(made, plain, ids, self.mark)
        made.update((w, self._ids(w.decode()).tobytes()) for w in rest if w not in made)
        return made

    def _part(self, made: dict, words: list[bytes], ids: np.ndarray, mark: int) -> None:
        """Put the ids between marks under their words."""
        ends = [*np.flatnonzero(ids == mark).tolist(), len(ids)]
        data, width, at = ids.tobytes(), self.dtype.itemsize, 0
        for w, end in zip(words, ends, strict=True):
            made[w] = data[at * width:end * width]
            at = end + 1

    def _learn(self, need: list[bytes]) -> dict[bytes, bytes]:
        """Ids of distinct words that the young generation lacks (and of their parts)."""
        old, known, made, parts, ask = self.old, self.young, {}, [], set()
        for w in need:
            if (x := old.get(w)) is not None:
                made[w] = x
                continue
            stem = w.rstrip(CLOSING)
            if len(stem) < len(w) and stem and 97 <= stem[-1] <= 122:
                parts.append((w, stem, w[len(stem):]))
                for x in parts[-1][1:]:
                    if x not in known:
                        if x in old:
                            made[x] = old[x]
                        else:
                            ask.add(x)
            else:
                ask.add(w)
        made |= self._look_up([w for w in ask if w not in made])
        for w, stem, closing in parts:
            made[w] = (made.get(stem) or known[stem]) + (made.get(closing) or known[closing])
        return made

    def ids_of(self, words: list[bytes]) -> list[bytes]:
        """Ids of distinct words, from what is kept or else from the library."""
        found = list(map(self.young.get, words))
        new = [i for i, x in enumerate(found) if x is None]
        made = self._learn([words[i] for i in new])
        for i in new:
            found[i] = made[words[i]]
        if len(self.young) + len(made) > WORDS:
            self.old, self.young = self.young, {}
        self.young.update((w, x) for w, x in made.items() if len(w) <= LONGEST)
        return found

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts (UTF-8), and where each text's ids end."""
        # Special strings are matched as they are written.
        texts = pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts))
        cut = pc.ascii_split_whitespace(texts.cast(pa.large_string()))
        words = cut.flatten().dictionary_encode()
        found = self.ids_of(words.dictionary.cast(pa.large_binary()).to_pylist())
        ids = np.frombuffer(b"".join(found), self.dtype)
        size = np.fromiter(map(len, found), np.int64, len(found)) // self.dtype.itemsize
        first = np.cumsum(size) - size
        word = words.indices.to_numpy()
        each = size[word]
        ends = np.cumsum(each)
        total = int(ends[-1]) if len(ends) else 0
        small = np.int32 if total < 1 << 31 else np.int64  # positions, at half the memory
        taken = np.repeat((first[word] - (ends - each)).astype(small), each)
        taken += np.arange(total, dtype=small)
        of_text = np.r_[0, ends][np.cumsum(pc.list_value_length(cut).to_numpy())]
        return ids[taken], of_text


_loaded: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]


def tokenized(docs: DataFrame, id_col: str, text_col: str, tokenizer: str, end_id: int) -> DataFrame:
    """doc_id, ids (packed unsigned integers, closed by ``end_id``), curve (Hilbert key), tie."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, plane = encoder(tokenizer), projection()
        width, end = machine.dtype.itemsize, np.array([end_id], machine.dtype).tobytes()
        for batch in batches:
            sizes = pc.binary_length(batch.column("text")).to_numpy()
            at = 0
            while at < len(sizes):
                stop = max(at + 1, int(np.searchsorted(np.cumsum(sizes[at:]), STEP)) + at)
                part = batch.slice(at, stop - at)
                ids, ends = machine.encode(part.column("text"))
                points = hashed_vectors(ids, ends, plane)
                data = ids.tobytes()
                packed = [data[a * width:b * width] + end
                          for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(packed, pa.binary()),
                     pa.array(hilbert_keys(cells(points))), part.column("tie")],
                    names=["doc_id", "ids", "curve", "tie"])
                at = stop

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(quoted(id_col)).alias("doc_id"), text_or_empty(text_col).alias("text")) \
        .withColumn("tie", F.xxhash64("doc_id", "text")) \
        .mapInArrow(each, f"doc_id {kind}, ids binary, curve long, tie long")


def lay(lengths: list[int], size: int, filled: int) -> list[tuple[int, int, int, int]]:
    """Pieces ``(document, start, length, sequence)`` of documents laid end to end into sequences
    of ``size``, the first of which is ``filled`` already (sequence 0)."""
    out, sequence = [], 0
    for doc, left in enumerate(lengths):
        start = 0
        while left:
            n = min(left, size - filled)
            out.append((doc, start, n, sequence))
            start, left, filled = start + n, left - n, filled + n
            if filled == size:
                sequence, filled = sequence + 1, 0
    return out


#: Bytes of the tokenized table that one range of the curve holds.
RANGE_BYTES = 32 << 20


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
         tokenizer: str | None = None, end_id: int = 1, size: int = 2048,
         with_ids: bool = False) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset,
    curve (the document's Hilbert key) and, if asked for, ``ids`` (packed little-endian).

    Every row of ``docs`` is packed, repeated rows as often as they come. Null or blank texts have
    the closing id alone. Null ids stay null. An empty table gives no piece; further columns are
    ignored. Sequences have ``size`` ids or, at the end of a range, a power of two; numbers are
    unique but not gapless (the range in the upper bits).
    """
    spark, path = docs.sparkSession, tokenizer or default_tokenizer()
    kept = shared_path(spark, "tokenized")
    # A table instead of a checkpoint: range sorting reads its input twice, first the keys alone.
    tokenized(docs, id_col, text_col, path, end_id).withColumn("row", F.monotonically_increasing_id()) \
        .write.option("compression", "zstd").parquet(kept)
    rows = spark.read.parquet(kept)
    # Ranges of about ``RANGE_BYTES``, by the size of the files just written.
    written = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    ranges = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-written // RANGE_BYTES))
    # The row's number parts rows that are equal in all else, however many.
    along = rows.repartitionByRange(ranges, "curve", "tie", "doc_id", "row") \
        .sortWithinPartitions("curve", "tie", "doc_id", "row") \
        .withColumn("range", F.spark_partition_id())
    kind = along.schema["doc_id"].dataType.simpleString()
    schema = (f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, "
              "sequence_id long, offset long, curve long" + ", ids binary" * with_ids)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dtype = encoder(path).dtype

        def rows(pieces: list[tuple], sequences: list[int], offsets: list[int]) -> pa.RecordBatch:
            crc = [zlib.crc32(np.frombuffer(p[3], dtype).astype("<u4").tobytes()) for p in pieces]
            columns = [pa.array([p[0] for p in pieces], doc_type)]
            columns += [pa.array(x, pa.int64()) for x in (
                [p[1] for p in pieces], [p[2] for p in pieces], crc, [p[4] for p in pieces],
                sequences, offsets, [p[5] for p in pieces])]
            if with_ids:
                columns.append(pa.array([p[3] for p in pieces], pa.binary()))
            return pa.RecordBatch.from_arrays(columns, names=names)

        names = [x.split()[0] for x in schema.split(", ")]
        doc_type, number, held, filled = pa.int64(), 0, [], 0
        for batch in batches:
            doc_type = batch.column("doc_id").type
            number = number or batch.column("range")[0].as_py() << 40
            ids, docs_of = batch.column("ids").to_pylist(), batch.column("doc_id").to_pylist()
            keys = batch.column("curve").to_pylist()
            laid = lay([len(x) // dtype.itemsize for x in ids], size, filled)
            pieces = held + [
                (docs_of[d], s, n, ids[d][s * dtype.itemsize:(s + n) * dtype.itemsize],
                 len(ids[d]) // dtype.itemsize, keys[d]) for d, s, n, _ in laid]
            starts = np.cumsum([0] + [p[2] for p in pieces])
            whole = int(starts[-1]) // size
            done = int(np.searchsorted(starts, whole * size))
            if done:
                yield rows(pieces[:done], (number + starts[:done] // size).tolist(),
                           (starts[:done] % size).tolist())
            number, held, filled = number + whole, pieces[done:], int(starts[-1]) % size
        # The rest of the range: sequences of the powers of two that add up to it.
        rest, sequences, offsets = [], [], []
        room, taken = 1 << filled.bit_length() >> 1, 0
        for doc, start, n, data, total, key in held:
            at = 0
            while at < n:
                some = min(n - at, room - taken)
                rest.append((doc, start + at, some,
                             data[at * dtype.itemsize:(at + some) * dtype.itemsize], total, key))
                sequences.append(number)
                offsets.append(taken)
                at, taken, filled = at + some, taken + some, filled - some
                if taken == room:
                    number, room, taken = number + 1, 1 << filled.bit_length() >> 1, 0
        if rest:
            yield rows(rest, sequences, offsets)

    return along.mapInArrow(cut, schema)
