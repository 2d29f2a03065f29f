"""Quality rules and a hashed n-gram log-likelihood ratio between trusted texts and the whole corpus.

Both multinomials are over hashed byte trigrams. The corpus' counts cover all rows, the target's all trusted rows. A document's score is the sum of log ratios over its trigrams, divided by their number and a constant more,
which pulls very short texts towards 0; documents under a fixed threshold are not kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Bloom, as_bytes, bloom, mix64, small_batches, summed_arrays, text_slices
from .shingles import WordHashes, windows

PLACES = 1 << 16
#: Added to each count; added to a text's number of trigrams; nats a trigram under which a text goes.
SMOOTH, SHRINK, THRESHOLD = 0.5, 50, -1.0
#: Words of a window that may not repeat; fewest words; most repeated words, in percent.
WINDOW, FEWEST, REPEATED = 8, 20, 30
SYMBOLS = b"#*$%&|<>"
WHITE = b" \t\n\x0b\x0c\r"
#: Bytes that are no character of a word: white space, and all but the first byte of a character.
NOT_COUNTED = WHITE + bytes(range(0x80, 0xC0))


def trigram_places(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place of the trigram at each byte of the joined texts, whether it lies in one text, and where the texts end."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    joined = b"".join(texts) + b"\0\0\0"
    n, ends = len(joined) - 3, np.cumsum(sizes)
    grams = np.ndarray((n,), "<u4", buffer=joined, strides=(1,)) & np.uint32(0xFFFFFF)
    places = ((grams * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.int64)
    inside = np.repeat(ends, sizes) - np.arange(n) >= 3
    return places, inside, ends


def log_ratios(docs: DataFrame, labels: DataFrame) -> np.ndarray:
    """log p(place | trusted) - log p(place | corpus). docs: doc_id, text; labels: doc_id, quality, toxic."""
    good = labels.where("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null").select(F.col("doc_id").cast("long")).distinct()
    # only texts that a filter of fixed size lets through are joined; raw and target are counted apart
    sent = docs.sparkSession.sparkContext.broadcast(bloom(good, "doc_id", good.count()).parts())

    def possible(batches):
        wanted = Bloom(*sent.value)
        for batch in batches:
            batch = batch.filter(pa.array(wanted.has(batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)), pa.bool_()))
            if batch.num_rows:
                yield batch

    trusted = docs.where("doc_id is not null").mapInArrow(possible, docs.schema).join(good, "doc_id", "left_semi")

    def count(name):
        def run(batches):
            counts = np.zeros(PLACES, np.int64)
            for batch in text_slices(batches):
                places, inside, _ = trigram_places(as_bytes(batch.column("text")))
                counts += np.bincount(places[inside], minlength=PLACES)
            yield name, counts

        return run

    got = {k: summed_arrays(df.select("text"), count(k), {k: PLACES})[k] for k, df in (("raw", docs), ("target", trusted))}
    log = {k: np.log(v + SMOOTH) - np.log(v.sum() + SMOOTH * PLACES) for k, v in got.items()}
    return log["target"] - log["raw"] if got["target"].any() else np.zeros(PLACES)


def repeated_words(words: list[list[bytes]], hashes: WordHashes) -> np.ndarray:
    """Of each text, the words that stand in a window of WINDOW words found twice or more in it."""
    counts = np.fromiter(map(len, words), np.int64, len(words))
    total = int(counts.sum())
    rolled = windows(hashes.of(words, total), WINDOW)
    stops = np.cumsum(counts)
    text = np.repeat(np.arange(len(words)), counts)[: len(rolled)]
    inside = (stops[text] - np.arange(len(rolled))) >= WINDOW
    at = np.flatnonzero(inside)
    if not len(at):
        return np.zeros(len(words), np.int64)
    key = rolled[at] + mix64(text[at])
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = at[order[np.concatenate((same, [False])) | np.concatenate(([False], same))]]
    edge = np.zeros(total + 1, np.int64)
    np.add.at(edge, twice, 1)
    np.add.at(edge, twice + WINDOW, -1)
    covered = np.concatenate(([0], np.cumsum(np.cumsum(edge)[:total] > 0)))
    return covered[stops] - covered[stops - counts]


def quality(docs: DataFrame, labels: DataFrame, *, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, score for each row of docs
    (doc_id, text).

    A null or empty text has no words and fails. Without trusted rows every score is 0. Repeated rows stay, and so do null
    ids, which are never trusted. An empty table gives an empty result. Other columns are not read.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(log_ratios(docs, labels))

    def run(batches):
        ratio, hashes = sent.value, WordHashes()
        for batch in text_slices(batches):
            texts = as_bytes(batch.column("text"))
            words = [t.split() for t in texts]
            n = np.fromiter(map(len, words), np.int64, len(words))
            repeated = repeated_words(words, hashes)
            chars = [len(t.translate(None, NOT_COUNTED)) for t in texts]
            symbols = [len(t) - len(t.translate(None, SYMBOLS)) for t in texts]
            lines = [[x for x in t.split(b"\n") if x.strip(WHITE)] if b"\n" in t else () for t in texts]
            doubled = [len(x) - len(set(x)) for x in lines]
            places, inside, ends = trigram_places(texts)
            sums = np.concatenate(([0.0], np.cumsum(ratio[places] * inside)))
            grams = np.concatenate(([0], np.cumsum(inside)))
            starts = np.concatenate(([0], ends[:-1]))
            score = np.round((sums[ends] - sums[starts]) / (grams[ends] - grams[starts] + SHRINK), 9)
            failed = (n < FEWEST) | (100 * repeated > REPEATED * n)
            columns = [n, chars, symbols, doubled, repeated]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(c, pa.int64()) for c in columns], pa.array(failed), pa.array(~failed & (score >= threshold)), pa.array(score)],
                names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score"],
            )

    return docs.mapInArrow(run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, score double")
