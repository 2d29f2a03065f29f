"""License scans: an exact set-similarity join of text blocks with license templates.

A template is a set of words. It is sought in blocks of twice its length and a quarter more, each half over the next, so that a
copy of it, even with a quarter of other words in between, lies wholly in one. The words of all templates stand in one order,
from the least to the most frequent in the whole corpus. A block that holds enough of a template holds one of its first
|template| - needed + 1 words (prefix filter), has enough template words at all (length filter), and where the first shared
word stands in both orders leaves enough words to come (positional filter); only such blocks are verified. The fixed
phrases are templates of which all words are needed, verified by their order.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, small_batches, summed_arrays, text_slices
from .license_texts import TEXTS

#: Words from one block to the next, as a multiple of the template's length, and at least.
STRETCH, NEXT = 1.25, 8
#: Part of a template's words that a block must hold; all of them if they are fewer than SHORT.
CONTAINMENT, SHORT = 0.8, 8
#: Fixed phrases and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Fixed texts of public license notices and their labels.
TEMPLATES = {
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction": "mit",
    "licensed under the apache license version 2 0": "apache-2",
    "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0": "apache-2",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "this work is licensed under a creative commons attribution noncommercial 4 0 international license": "cc-by-nc",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc-by",
    "this work is licensed under the gnu general public license version 3": "gpl-3",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation": "gpl",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "isc",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl-2",
} | {text: label for label, text in TEXTS}
_LETTERS = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ" + bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]), b"abcdefghijklmnopqrstuvwxyz" + b" " * (0x30 + 7 + 6 + 5))


def words_of(text: bytes) -> list[bytes]:
    """Runs of letters a-z, digits and characters beyond ASCII, after lower-casing A-Z."""
    return text.translate(_LETTERS).split()


class Scanner:
    """Templates and phrases ready to join, words numbered from the rarest (1) on; 0 is any other word."""

    def __init__(self, templates: dict[str, str], phrases: dict[str, str], frequency: dict[bytes, int]):
        def words(x):
            return words_of(x.encode())

        vocabulary = sorted({w for x in (*templates, *phrases) for w in words(x)}, key=lambda w: (frequency.get(w, 0), w))
        self.number = {w: i for i, w in enumerate(vocabulary, 1)}
        self.phrases = [([self.number[w] for w in words(x)], label) for x, label in phrases.items()]
        self.templates = []
        self.stride = []
        for x, label in templates.items():
            tokens = sorted({self.number[w] for w in words(x)})
            needed = len(tokens) if len(tokens) < SHORT else -int(-CONTAINMENT * len(tokens) // 1)
            self.templates.append((np.array(tokens), needed, label))
            self.stride.append(max(NEXT, -int(-STRETCH * len(words(x)) // 1)))
        #: for each word: the templates (and phrases) in whose prefix it stands
        self.prefix: dict[int, list[int]] = {}
        for k, (tokens, needed, _) in enumerate(self.templates):
            for t in tokens[: len(tokens) - needed + 1].tolist():
                self.prefix.setdefault(t, []).append(k)
        self.rarest: dict[int, list[int]] = {}
        for k, (tokens, _) in enumerate(self.phrases):
            self.rarest.setdefault(min(tokens), []).append(k)
        size = len(vocabulary) + 1
        self.opens = np.zeros(size, bool)
        self.opens[[*self.prefix, *self.rarest]] = True

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, str]], dict[str, float]]:
        """Places of phrases (first word, label), and the containment of the best block of each label found."""
        n = len(words)
        ids = np.fromiter(map(self.number.get, words, iter(lambda: 0, 1)), np.int64, n)
        hits = np.flatnonzero(self.opens[ids])
        if not len(hits):
            return [], {}
        places, found, seen = [], {}, set()
        for at in hits.tolist():
            for k in self.rarest.get(int(ids[at]), ()):
                tokens, label = self.phrases[k]
                for i, t in enumerate(tokens):  # the rarest word may stand in a phrase more than once
                    start = at - i
                    if t == ids[at] and 0 <= start <= n - len(tokens) and (start, k) not in seen and ids[start : start + len(tokens)].tolist() == tokens:
                        seen.add((start, k))
                        places.append((start, label))
            for k in self.prefix.get(int(ids[at]), ()):
                stride = self.stride[k]
                for block in range(max(0, at // stride - 1), at // stride + 1):
                    if (block, k, "t") not in seen:
                        seen.add((block, k, "t"))
                        if (got := self.verify(ids[block * stride : (block + 2) * stride], k)) > found.get(self.templates[k][2], 0.0):
                            found[self.templates[k][2]] = got
        return places, found

    def verify(self, block: np.ndarray, k: int) -> float:
        """Containment of template k in a block, 0 if it is too small."""
        tokens, needed, _ = self.templates[k]
        own = np.unique(block[block > 0])
        if len(own) < needed:
            return 0.0
        where = np.searchsorted(own, tokens)
        shared = own[np.minimum(where, len(own) - 1)] == tokens
        first = int(shared.argmax())
        if not shared[first] or 1 + min(len(tokens) - first, len(own) - int(where[first])) - 1 < needed:
            return 0.0
        count = int(shared.sum())
        return count / len(tokens) if count >= needed else 0.0


def license_scan(docs: DataFrame, *, templates: dict[str, str] = TEMPLATES, phrases: dict[str, str] = PHRASES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for each row.

    n_base counts the places of phrases; first_word and last_word are the smallest and largest of their starts, null without
    any. base_labels and labels, which adds those of templates, are distinct, sorted and joined by commas. score is the
    largest containment found, 0 without any. Null texts count as empty; repeated rows and null ids stay; an empty table gives
    an empty result. Templates and phrases are few by contract: their words are what is broadcast. Other columns are not read.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    small_batches(docs.sparkSession)
    vocabulary = sorted({w for x in (*templates, *phrases) for w in words_of(x.encode())})

    def count(batches):
        number, total = {w: i for i, w in enumerate(vocabulary)}, np.zeros(len(vocabulary) + 1, np.int64)
        for batch in text_slices(batches):
            for text in as_bytes(batch.column("text")):
                found = list(filter(None.__ne__, map(number.get, words_of(text))))
                total += np.bincount(found, minlength=len(total)) if found else 0
        yield "words", total

    total = summed_arrays(docs.select("text"), count, {"words": len(vocabulary) + 1}, pieces=1)["words"]
    frequency = dict(zip(vocabulary, total.tolist()))

    def run(batches):
        scanner = Scanner(templates, phrases, frequency)
        for batch in text_slices(batches):
            rows = []
            for text in as_bytes(batch.column("text")):
                words = words_of(text)
                places, found = scanner.scan(words)
                starts, base = [p for p, _ in places], {label for _, label in places}
                score = 1.0 if base else max(found.values(), default=0.0)
                rows.append((len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | set(found))), score))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, k) for c, k in zip(zip(*rows), kinds)]], names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
