"""License scans by an exact set-similarity join of text blocks with license templates.

Templates fall into classes by length: a template's stride is ``STRIDE`` doubled until it is no
shorter than the template. A block is a window of two strides, one at every stride, so a template of
any length lies whole in some block of its class; it matches a block that holds at least
``THRESHOLD`` of the template's distinct words. Words are ordered
by their count in the whole corpus, rare ones first. A block that meets the threshold must hold
one of the template's first ``|T| - o + 1`` words (``o``: words needed), which is what the blocks
are looked up by; its number of template words (length) and the words that can still follow the
first common one (position) prune further, and the rest is counted. Templates are a parameter of
a few short texts, so their index travels with the task; the texts are never shuffled.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regressa.llm.common import quoted, utf8

STRIDE, THRESHOLD = 32, 0.85

#: Fixed values of the contract: phrase and label.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Label and wording of common license notices and grants, in the words of the scan.
TEMPLATES = {
    "apache-grant": "you may not use this file except in compliance with the license you may obtain "
                    "a copy of the license at",
    "apache-notice": "licensed under the apache license version 2 0",
    "bsd-grant": "redistribution and use in source and binary forms with or without modification are "
                 "permitted provided that the following conditions are met",
    "cc-by-nc-notice": "licensed under cc by nc 4 0",
    "gpl-grant": "this program is free software you can redistribute it and or modify it under the "
                 "terms of the gnu general public license",
    "gpl-notice": "this work is licensed under the gnu general public license version 3",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this "
                 "software and associated documentation files",
    "mit-notice": "released under the mit license",
    "mpl-notice": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "warranty-disclaimer": "the software is provided as is without warranty of any kind express or "
                           "implied",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or "
                 "without fee is hereby granted provided that the above copyright notice and this "
                 "permission notice appear in all copies",
    "mit-text": "permission is hereby granted free of charge to any person obtaining a copy of this "
                "software and associated documentation files the software to deal in the software "
                "without restriction including without limitation the rights to use copy modify merge "
                "publish distribute sublicense and or sell copies of the software and to permit persons "
                "to whom the software is furnished to do so subject to the following conditions the "
                "above copyright notice and this permission notice shall be included in all copies or "
                "substantial portions of the software the software is provided as is without warranty "
                "of any kind express or implied including but not limited to the warranties of "
                "merchantability fitness for a particular purpose and noninfringement in no event shall "
                "the authors or copyright holders be liable for any claim damages or other liability "
                "whether in an action of contract tort or otherwise arising from out of or in "
                "connection with the software or the use or other dealings in the software",
    "bsd-text": "redistribution and use in source and binary forms with or without modification are "
                "permitted provided that the following conditions are met 1 redistributions of source "
                "code must retain the above copyright notice this list of conditions and the following "
                "disclaimer 2 redistributions in binary form must reproduce the above copyright notice "
                "this list of conditions and the following disclaimer in the documentation and or other "
                "materials provided with the distribution this software is provided by the copyright "
                "holders and contributors as is and any express or implied warranties including but not "
                "limited to the implied warranties of merchantability and fitness for a particular "
                "purpose are disclaimed in no event shall the copyright holder or contributors be "
                "liable for any direct indirect incidental special exemplary or consequential damages "
                "including but not limited to procurement of substitute goods or services loss of use "
                "data or profits or business interruption however caused and on any theory of liability "
                "whether in contract strict liability or tort including negligence or otherwise arising "
                "in any way out of the use of this software even if advised of the possibility of such "
                "damage",
}

_WORD = bytes(b for b in range(256) if 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b > 127)
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b in _WORD else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased words; separators are the ASCII characters that are no letter or digit."""
    return text.translate(_TABLE).split()


def places(joined: bytes, pattern: re.Pattern) -> list[int]:
    """Word numbers at which a phrase starts in words joined by single spaces."""
    out, at, word = [], 0, 0
    for m in pattern.finditer(joined):
        word += joined.count(b" ", at, m.start())
        at = m.start()
        out.append(word)
    return out


def stride_of(words: int, stride: int = STRIDE) -> int:
    """The stride of the class that a template of so many words belongs to."""
    while stride < words:
        stride *= 2
    return stride


class TemplateIndex:
    """Prefix index of templates under a global word order."""

    def __init__(self, templates: dict[str, str], counts: dict[bytes, int],
                 threshold: float = THRESHOLD, stride: int = STRIDE):
        listed = {label: words_of(t.encode()) for label, t in templates.items()}
        self.order = {w: i for i, w in enumerate(sorted(
            set().union(*listed.values()), key=lambda w: (counts.get(w, 0), w)))}
        self.prefixes = {}
        self.templates = []
        for label, words in sorted(listed.items()):
            if not words:
                continue
            by_rank = {self.order[w]: w for w in words}
            ranks = sorted(by_rank)
            need = max(1, math.ceil(threshold * len(ranks) - 1e-9))
            self.templates.append((label, ranks, need))
            where = stride_of(len(words), stride)
            for position, r in enumerate(ranks[:len(ranks) - need + 1]):
                self.prefixes.setdefault(by_rank[r], []).append(
                    (len(self.templates) - 1, position, where))

    def matches(self, words: list[bytes]) -> list[tuple[str, int, float]]:
        """``(label, first word of the block, containment)`` of every match."""
        if self.prefixes.keys().isdisjoint(words):
            return []
        # (stride, block) -> template -> rarest common position
        probes: dict[tuple[int, int], dict[int, int]] = {}
        for i, w in enumerate(words):
            for template, position, stride in self.prefixes.get(w, ()):
                for block in (i // stride, i // stride - 1):
                    if block >= 0:
                        found = probes.setdefault((stride, block), {})
                        found[template] = min(position, found.get(template, position))
        out = []
        for (stride, block), found in sorted(probes.items()):
            start = block * stride
            held = sorted({self.order[w] for w in words[start:start + 2 * stride]
                           if w in self.order})
            rank_at = {r: i for i, r in enumerate(held)}
            for template, position in found.items():
                label, ranks, need = self.templates[template]
                if len(held) < need:
                    continue
                after = min(len(ranks) - position, len(held) - rank_at[ranks[position]])
                if after < need:
                    continue
                common = sum(r in rank_at for r in ranks)
                if common >= need:
                    out.append((label, start, common / len(ranks)))
        return sorted(out)


def word_counts(docs: DataFrame, text_col: str, words: set[bytes]) -> dict[bytes, int]:
    """Corpus counts of the given words: one row for each of them comes to the driver."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for text in utf8(batch.column(0)):
                counts.update(filter(words.__contains__, words_of(text)))
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()),
                                          pa.array(list(counts.values()), pa.int64())],
                                         names=["word", "n"])

    rows = docs.select(F.col(quoted(text_col))).mapInArrow(each, "word binary, n long") \
        .groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {bytes(r.word): r.n for r in rows}


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
         templates: dict[str, str] | None = None, phrases: dict[str, str] | None = None,
         threshold: float = THRESHOLD, stride: int = STRIDE) -> DataFrame:
    """One row for each row: doc_id, n_words, phrases (array of (label, word)), blocks (array of
    (label, word, containment): template matches and where their block starts).

    Templates may have any length; one without words matches nothing. Texts are read whole, however
    long. Null texts count as empty; null ids stay; rows that repeat give equal rows; an empty table
    gives none; further columns are ignored. Counts for the word order are over the whole table.
    """
    templates, phrases = templates or TEMPLATES, phrases or PHRASES
    vocabulary = {w for t in templates.values() for w in words_of(t.encode())}
    index = TemplateIndex(templates, word_counts(docs, text_col, vocabulary), threshold, stride)
    patterns = [(label, p.encode(), re.compile(rb"(?<![^ ])" + re.escape(p.encode()) + rb"(?![^ ])"))
                for p, label in phrases.items()]
    kind = docs.schema[id_col].dataType.simpleString()
    place = pa.struct([("label", pa.string()), ("word", pa.int64())])
    block = pa.struct([("label", pa.string()), ("word", pa.int64()), ("containment", pa.float64())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, base, more = [], [], []
            for text in utf8(batch.column("text")):
                words = words_of(text)
                joined = b" ".join(words)
                n.append(len(words))
                base.append([{"label": label, "word": w} for label, p, pattern in patterns
                             if p in joined for w in places(joined, pattern)])
                more.append([{"label": label, "word": w, "containment": c}
                             for label, w, c in index.matches(words)])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(base, pa.list_(place)),
                 pa.array(more, pa.list_(block))], names=["doc_id", "n_words", "phrases", "blocks"])

    return docs.select(F.col(quoted(id_col)).alias("doc_id"), F.col(quoted(text_col)).alias("text")) \
        .mapInArrow(each, f"doc_id {kind}, n_words long, phrases array<struct<label:string,word:long>>, "
                          "blocks array<struct<label:string,word:long,containment:double>>")


def report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score (1 with a base
    phrase, else the best containment that meets the threshold, else 0)."""
    found = scan(docs, **options)
    base = F.transform("phrases", lambda p: p.label)
    both = F.concat(base, F.transform("blocks", lambda b: b.label))

    def listed(labels):
        return F.array_join(F.array_sort(F.array_distinct(labels)), ",")

    return found.select(
        "doc_id", "n_words", F.size("phrases").cast("long").alias("n_base"),
        F.array_min(F.transform("phrases", lambda p: p.word)).alias("first_word"),
        F.array_max(F.transform("phrases", lambda p: p.word)).alias("last_word"),
        listed(base).alias("base_labels"), listed(both).alias("labels"),
        F.when(F.size("phrases") > 0, 1.0).otherwise(F.coalesce(
            F.array_max(F.transform("blocks", lambda b: b.containment)), F.lit(0.0))).alias("score"))
