"""Token counts by a compiled finite-state transducer over chunks of text.

Compilation reads the tokenizer's file: the bytes of all tokens become a trie, and the merges a table
of pairs. The transducer reads a piece (a match of the split pattern) byte by byte. Its state holds
the trie nodes of the token starts that are still open, and for each of these the last token and the
number of tokens of what came before it; nothing older matters, so states are finite. On a byte, open
starts move on in the trie, and the one token that may end here is the one that stands beside the
last token before it as the merges would leave them: of all tokens that end at a byte, exactly one
does. The transition emits the change in the number of tokens. Whether two tokens may stand side by
side is read from the merges alone: undoing the merges of both in reverse order shows every pair that
ever met across the border, and none of them may merge before its sides are merged on. Many pieces run
at once, one byte of each a step.

A *segment* starts where white space follows a character that is none; there the transducer is in its
first state whatever came before, so the emitted count of a segment is kept as one arc (in a bounded
table). A chunk's state map is (open text at its left end, tokens emitted in between, open text at its
right end): only the open ends depend on the state the chunk is entered in. Letters end where another
class begins and digits likewise, which closes the ends of a text without white space, too. Maps
compose associatively, and the chunks of a long text are composed in levels of ``FAN`` maps. Only a
single run of one class that is longer than a chunk (one piece, in which no place is a first state) is
carried on through the maps as text.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regressa.llm.byte_bpe import _W, _steps, segments
from regressa.llm.common import keep, quoted, utf8

#: Characters of a chunk, arcs that a worker keeps, bytes of the longest kept segment, bytes of a
#: step, and maps composed at a level of the scan.
CHUNK, ARCS, LONGEST, STEP, FAN = 1 << 18, 400_000, 64, 1 << 21, 256
#: Bytes of the longest piece that runs together with others, and pieces that run together.
TOGETHER, RUNS = 64, 1 << 14
# Characters that are letters or numbers only since a later version of Unicode than the
# tokenizer's pattern knows (U+... to U+...).
NEWER = [
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F),
    (0x209D, 0x209F), (0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4), (0xA7DD, 0xA7DD),
    (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D), (0x107BB, 0x107BF), (0x10940, 0x10959),
    (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A), (0x11DB0, 0x11DDB), (0x11DE0, 0x11DE9),
    (0x11DF1, 0x11DF1), (0x1246F, 0x1246F), (0x12475, 0x1247F), (0x12550, 0x12686), (0x16EA0, 0x16EB8),
    (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF6), (0x187F8, 0x187FF), (0x18CD6, 0x18CDA), (0x18D09, 0x18D20),
    (0x18D80, 0x18DF2), (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168),
    (0x1D6A6, 0x1D6A6), (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF),
    (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2), (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4),
    (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD), (0x323B0, 0x33479),
    (0x3D000, 0x3FC3F),
]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones stand for
    themselves, the others follow from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Transducer:
    """The compiled machine of one tokenizer file; see the module's docstring."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, split = spec["model"], spec["pre_tokenizer"]
        if (model["type"], split["type"], spec["normalizer"]) != ("BPE", "ByteLevel", None) or \
                split["add_prefix_space"] or model.get("ignore_merges") or model.get("byte_fallback"):
            raise ValueError(f"{path} is no plain byte-level BPE tokenizer")
        byte_of = _byte_of()
        text = {}
        # Tokens are numbered by their byte, then by their merge: a number is an order of creation.
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        number = {c: b for c, b in byte_of.items()}
        self.left, self.right = np.full(256 + len(merges), -1), np.full(256 + len(merges), -1)
        pairs = {}
        for i, (a, b) in enumerate(merges, 256):
            if a + b in number:
                raise ValueError(f"two merges make {a + b!r}")
            number[a + b] = i
            self.left[i], self.right[i] = number[a], number[b]
            pairs[number[a] << 32 | number[b]] = i
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_made = np.array([pairs[k] for k in self.pair_keys.tolist()])
        text = {i: bytes(map(byte_of.__getitem__, t)) for t, i in number.items()}
        self._compile_trie(text)
        self.special = [t["content"].encode() for t in spec["added_tokens"]]
        self.reach = max(map(len, self.special), default=0)
        self.specials = regex.compile(b"|".join(sorted(map(regex.escape, self.special), key=len, reverse=True))) \
            if self.special else None
        newer = "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in NEWER)
        letter, digit = f"[\\p{{L}}--[{newer}]]", f"[\\p{{N}}--[{newer}]]"
        other = f"[[^{_W}\\p{{L}}\\p{{N}}]||[{newer}]]"

        def pattern(letter: str, digit: str, other: str, flags: int = 0) -> regex.Pattern:
            return regex.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?{letter}+| ?{digit}+| ?{other}+|"
                                 f"[{_W}]+(?![^{_W}])|[{_W}]+", flags)

        self.newer = regex.compile(f"[{newer}]")
        self.pattern = pattern(letter, digit, other, regex.V1)
        self.plain = pattern("\\p{L}", "\\p{N}", f"[^{_W}\\p{{L}}\\p{{N}}]")  # without newer characters
        # Behind letters or digits, before anything that is no more of them (nor white space).
        self.turns = regex.compile(
            f"(?<={letter})(?=[[^{_W}]--{letter}])|(?<={digit})(?=[[^{_W}]--{digit}])", regex.V1)
        self.arcs: dict[bytes, int] = {}

    def _compile_trie(self, text: dict[int, bytes]) -> None:
        child: dict[int, int] = {}
        ends = {}
        for token, t in text.items():
            node = 0
            for b in t:
                node = child.setdefault(node << 8 | b, len(child) + 1)
            ends[node] = token
        self.child = child
        self.keys = np.array(sorted(child), np.int64)
        self.children = np.array([child[k] for k in self.keys.tolist()], np.int32)
        self.token = np.full(len(child) + 1, -1, np.int32)
        self.token[list(ends)] = list(ends.values())
        # Transitions of the first state, which every byte of every piece takes, as a table.
        self.first = np.array([child[b] for b in range(256)], np.int32)

    def stand(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the merges leave tokens ``a`` and ``b`` side by side (arrays of numbers)."""
        ok = np.ones(len(a), bool)
        x, y = a.astype(np.int64), b.astype(np.int64)
        # The merge that ends each side's present token; none yet for the tokens themselves.
        end_x = np.full(len(a), 1 << 40)
        end_y = end_x.copy()
        open_ = np.arange(len(a))
        while len(open_):
            key = x[open_] << 32 | y[open_]
            at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            made = np.where(self.pair_keys[at] == key, self.pair_made[at], 1 << 41)
            # Of equal merges the leftmost comes first: the left side's own beats one across.
            met = (made < end_x[open_]) & (made <= end_y[open_])
            ok[open_[met]] = False
            open_ = open_[~met & ((x[open_] >= 256) | (y[open_] >= 256))]
            older = x[open_] > y[open_]
            i, j = open_[older], open_[~older]
            end_x[i], x[i] = x[i], self.right[x[i]]
            end_y[j], y[j] = y[j], self.left[y[j]]
        return ok

    def run(self, pieces: list[bytes]) -> np.ndarray:
        """Tokens that the machine emits for each piece of at most ``TOGETHER`` bytes."""
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        n = int(size.max())
        order = np.argsort(-size, kind="stable")  # pieces that still run come first
        text = np.frombuffer(b"".join([pieces[i].ljust(n, b"\0") for i in order.tolist()]),
                             np.uint8).reshape(-1, n)
        size = size[order]
        node = np.full((len(size), n), -1, np.int32)
        last = np.zeros((len(size), n + 1), np.int32)
        count = np.zeros((len(size), n + 1), np.int32)
        for i in range(n):
            m = int(np.searchsorted(-size, -i, side="left"))  # pieces longer than i
            r, p = np.nonzero(node[:m, :i] >= 0)
            key = node[r, p].astype(np.int64) << 8 | text[r, i]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            to = np.where(self.keys[at] == key, self.children[at], -1)
            node[r, p] = to
            node[:m, i] = self.first[text[:m, i]]
            # Tokens that end here, of each piece the longest first; a byte is one at last.
            has = np.flatnonzero(to >= 0)
            token = self.token[to[has]]
            has, token = has[token >= 0], token[token >= 0]
            r, p = r[has], p[has]
            last[:m, i + 1], count[:m, i + 1] = text[:m, i], count[:m, i] + 1
            while len(r):
                top = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
                whole = p[top] == 0
                good = whole.copy()
                rest = np.flatnonzero(~whole)
                good[rest] = self.stand(last[r[top[rest]], p[top[rest]]], token[top[rest]])
                g = top[good]
                last[r[g], i + 1], count[r[g], i + 1] = token[g], count[r[g], p[g]] + 1
                left = np.ones(m, bool)
                left[r[g]] = False
                stay = left[r]
                stay[top] = False
                r, p, token = r[stay], p[stay], token[stay]
        out = np.empty(len(size), np.int64)
        out[order] = count[np.arange(len(size)), size]
        return out

    def run_long(self, piece: bytes) -> int:
        """The same for one piece of any length."""
        last, count, open_ = [-1], [0], []
        known: dict[tuple[int, int], bool] = {}
        for i, b in enumerate(piece):
            open_ = [(p, to) for p, node in [*open_, (i, 0)]
                     if (to := self.child.get(node << 8 | b)) is not None]
            for p, node in open_:
                token = int(self.token[node])
                if token < 0:
                    continue
                if p and (pair := (last[p], token)) not in known:
                    known[pair] = bool(self.stand(np.array([last[p]]), np.array([token]))[0])
                if not p or known[last[p], token]:
                    last.append(token)
                    count.append(count[p] + 1)
                    break
        return count[-1]

    def learn(self, new: list[bytes]) -> None:
        """Adds the arcs of segments: specials emit one token, the pieces between them run."""
        every = b"\n".join(new)
        pattern = self.pattern if self.newer.search(every.decode()) else self.plain
        emitted = np.zeros(len(new), np.int64)
        if any(x in every for x in self.special):
            parts = []
            for i, s in enumerate(new):
                cut = self.specials.split(s)
                emitted[i] = len(cut) - 1
                parts.append([p for x in cut for p in pattern.findall(x.decode())])
        else:
            parts = [pattern.findall(s.decode()) for s in new]
        every = [p for x in parts for p in x]
        pieces = {p: i for i, p in enumerate(dict.fromkeys(every))}
        counts = self.counts([p.encode() for p in pieces])
        which = np.fromiter(map(pieces.__getitem__, every), np.int64, len(every))
        ends = np.cumsum([0, *map(len, parts)])
        total = np.concatenate([[0], np.cumsum(counts[which])])
        self.arcs.update(zip(new, (emitted + np.diff(total[ends])).tolist(), strict=True))

    def counts(self, pieces: list[bytes]) -> np.ndarray:
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        out = np.zeros(len(pieces), np.int64)
        order = np.argsort(size, kind="stable")
        short = order[size[order] <= TOGETHER]
        for at in range(0, len(short), RUNS):  # of like length, so little is padded
            group = short[at:at + RUNS]
            out[group] = self.run([pieces[i] for i in group.tolist()])
        for i in order[len(short):].tolist():
            out[i] = self.run_long(pieces[i])
        return out

    def emitted(self, found: list[bytes]) -> np.ndarray:
        """Tokens of segments, from the table or learnt."""
        new = [s for s in found if s not in self.arcs]
        if len(self.arcs) + len(new) > ARCS:
            self.arcs = {}
            new = found
        if new:
            self.learn(list(dict.fromkeys(new)))
        out = np.fromiter(map(self.arcs.__getitem__, found), np.int64, len(found))
        for s in new:
            if len(s) > LONGEST:
                self.arcs.pop(s, None)
        return out

    def totals(self, texts: list[bytes]) -> np.ndarray:
        """Tokens of whole texts."""
        data = b"".join(texts)
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        first = np.cumsum(size) - size
        start, length, of, unique = segments(data, first[size > 0])
        n = self.emitted([data[a:a + k] for a, k in zip(start[unique].tolist(), length[unique].tolist(),
                                                         strict=True)])[of]
        before = np.concatenate([[0], np.cumsum(n)])
        return np.diff(before[np.searchsorted(start, np.append(first, len(data)))])

    def _turns(self, s: bytes) -> list[int]:
        """Places (bytes) inside a segment at which the machine is in its first state whatever comes
        before and after: far enough from both ends to see every special there is."""
        text, out, at, done = s.decode(), [], 0, 0
        for m in self.turns.finditer(text):
            at += len(text[done:m.start()].encode())
            done = m.start()
            if self.reach <= at <= len(s) - self.reach and not any(
                    s.find(x, at - len(x) + 1, at + len(x) - 1) >= 0 for x in self.special):
                out.append(at)
        return out

    def map_of(self, chunk: bytes) -> tuple[bytes, int, bytes | None]:
        """The state map of a chunk: open left end, tokens between, open right end (none where one
        open text is all there is)."""
        if not chunk:
            return b"", 0, None
        start = segments(chunk, np.zeros(1, np.int64))[0].tolist()
        cuts = start[1:]
        head = chunk[:cuts[0] if cuts else None]
        tail = chunk[cuts[-1]:] if cuts else chunk
        if len(head) > LONGEST and (turns := self._turns(head)):
            cuts = [turns[0], *cuts]
        if len(tail) > LONGEST and (turns := self._turns(tail)):
            cuts.append(len(chunk) - len(tail) + turns[-1])
        if not cuts:
            return chunk, 0, None
        inner = [chunk[a:b] for a, b in zip(cuts, cuts[1:], strict=False) if a < b]
        return chunk[:cuts[0]], int(self.emitted(inner).sum()) if inner else 0, chunk[cuts[-1]:]

    def fold(self, maps: Iterator[tuple[bytes, int, bytes | None]]) -> tuple[bytes, int, bytes | None]:
        """The state map of adjacent chunks in order. Open ends are gathered and joined once."""
        head, n, tail, closed = [], 0, [], False
        for h, k, t in maps:
            (tail if closed else head).append(h)
            if t is not None:
                if closed:  # what was open between two chunks is now complete
                    n += int(self.totals([b"".join(tail)])[0])
                n, tail, closed = n + k, [t], True
        return b"".join(head), n, b"".join(tail) if closed else None

    def finish(self, whole: tuple[bytes, int, bytes | None]) -> int:
        """Tokens of a text whose map this is: both ends close."""
        head, n, tail = whole
        return n + int(self.totals([head, tail or b""]).sum())


_loaded: dict[str, Transducer] = {}


def transducer(path: str) -> Transducer:
    """The worker's transducer: its compiled arcs serve all tasks of the worker."""
    if path not in _loaded:
        _loaded[path] = Transducer(path)
    return _loaded[path]


_KEY = ["doc_id", "mark", "size"]
_MAP = "head binary, n long, tail binary, copies long"


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 tokenizer: str | None = None, limit: int = 512, chunk: int | None = None,
                 fan: int | None = None) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > ``limit``) for every row.

    ``tokenizer`` is the path of a byte-level BPE file of the ``tokenizers`` library with the
    standard split pattern; special strings are matched as the library does by default. Null texts
    count as empty (0 tokens). Rows that repeat give as many equal rows; null ids are kept; an empty
    table gives none; further columns are ignored. Texts longer than ``chunk`` characters are handled
    in chunks; equal rows of such a text are counted and handled once.
    """
    path, chunk, fan = tokenizer or default_tokenizer(), chunk or CHUNK, fan or FAN
    kind = docs.schema[id_col].dataType.simpleString()
    thin = docs.select(F.col(quoted(id_col)).alias("doc_id"),
                       F.coalesce(F.col(quoted(text_col)), F.lit("")).alias("text"))
    pieces = f"""CASE WHEN length(text) <= {chunk} THEN array(struct(0L AS chunk, text AS piece))
        ELSE transform(sequence(0L, CAST((length(text) - 1) div {chunk} AS BIGINT)),
             i -> struct(i AS chunk, substring(text, CAST(i * {chunk} + 1 AS INT), {chunk}) AS piece)) END"""
    cut = thin.select("doc_id", F.octet_length("text").cast("long").alias("size"),
                      F.xxhash64("text").alias("mark"), F.expr(pieces).alias("p")) \
        .select("doc_id", "mark", "size", F.size("p").cast("long").alias("chunks"),
                F.explode("p").alias("p")) \
        .select("doc_id", "mark", "size", "chunks", "p.chunk", "p.piece")

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(path)
        for batch in batches:
            sizes = pa.compute.binary_length(batch.column("piece")).to_pylist()
            for a, b in _steps(sizes, STEP):
                part = batch.slice(a, b - a)
                texts, chunks = utf8(part.column("piece")), part.column("chunks").to_numpy()
                n = np.zeros(len(texts), np.int64)
                whole = np.flatnonzero(chunks == 1)
                n[whole] = machine.totals([texts[i] for i in whole.tolist()])
                heads, tails = [b""] * len(texts), [None] * len(texts)
                for i in np.flatnonzero(chunks > 1).tolist():
                    heads[i], n[i], tails[i] = machine.map_of(texts[i])
                yield pa.RecordBatch.from_arrays(
                    [part.column(c) for c in (*_KEY, "chunks", "chunk")]
                    + [pa.array(heads, pa.binary()), pa.array(n), pa.array(tails, pa.binary())],
                    names=[*_KEY, "chunks", "chunk", "head", "n", "tail"])

    schema = (f"doc_id {kind}, mark long, size long, chunks long, chunk long, head binary, "
              "n long, tail binary")
    parts = keep(cut.mapInArrow(summarise, schema))

    def scan(keys: list[str], last: bool):
        def fold(key: tuple, table: pa.Table) -> pa.Table:
            machine = transducer(path)
            table = table.sort_by("chunk")
            total = machine.fold(zip(*(table.column(c).to_pylist() for c in ("head", "n", "tail")), strict=True))
            if last:
                total = (b"", machine.finish(total), None)
            out = {c: [k.as_py()] for c, k in zip(keys, key, strict=True)}
            fields = [*((c, table.schema.field(c).type) for c in keys), ("head", pa.binary()),
                      ("n", pa.int64()), ("tail", pa.binary()), ("copies", pa.int64())]
            return pa.table(out | {"head": [total[0]], "n": [total[1]], "tail": [total[2]],
                                   "copies": [table.column("copies")[0].as_py()]}, schema=pa.schema(fields))
        return fold

    # Rows that repeat bring equal chunks: one stands for all, and says how many they are.
    some = parts.where("chunks > 1").groupBy(*_KEY, "chunk").agg(
        F.first("head").alias("head"), F.first("n").alias("n"), F.first("tail").alias("tail"),
        F.count(F.lit(1)).alias("copies"))
    some = some.withColumn("block", (F.col("chunk") / fan).cast("long"))
    some = some.groupBy(*_KEY, "block").applyInArrow(
        scan([*_KEY, "block"], False), f"doc_id {kind}, mark long, size long, block long, {_MAP}")
    some = some.withColumnRenamed("block", "chunk").groupBy(*_KEY).applyInArrow(
        scan(_KEY, True), f"doc_id {kind}, mark long, size long, {_MAP}")
    some = some.select("doc_id", "size", "n", F.explode(F.sequence(F.lit(1), "copies")).alias("i"))
    return parts.where("chunks = 1").select("doc_id", "size", "n") \
        .unionByName(some.select("doc_id", "size", "n")) \
        .select("doc_id", F.col("size").alias("n_bytes"), F.col("n").alias("n_tokens"),
                (F.col("n") > limit).alias("over_limit"))
