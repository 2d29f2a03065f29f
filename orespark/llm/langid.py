"""Language identification: sparse multinomial logistic regression on TF-IDF of hashed character n-grams.

Features are 1- to 3-grams of lower-case letters, everything else counting as a space, hashed to 2^16 places. Document
frequencies are counted over all learnable documents; the weights are learned by follow-the-regularised-leader (proximal,
with elastic net) from a bounded sample of labelled ones, which has some of every language, and a temperature is fitted on a part of the sample kept apart.
A text's score is linear in its relative n-gram frequencies, so whole texts of any length are read in one pass.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import as_texts, fresh, sampled, small_batches, summed_arrays, text_slices

PLACES = 1 << 16
UNKNOWN = "und"
#: Labelled documents that the weights are learned from at most (the bound of the training sample), besides as many of each
#: language as LEAST if the sample has fewer; and the part for the temperature.
SAMPLE, LEAST, APART = 3000, 20, 5
#: Learning rate and its offset, L1, L2, passes over the sample.
ALPHA, BETA, L1, L2, PASSES = 0.5, 1.0, 2e-3, 1e-4, 4


def letter_table() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)], bool)


def ngram_places(texts: list[str], letters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the n-grams that begin at each character, one row for each n; where each text begins; letters of each.
    An n-gram that would run over the end of its text has place -1."""
    lower = [t.lower() for t in texts]
    sizes = np.fromiter(map(len, lower), np.int64, len(lower))
    cp = np.frombuffer("".join(lower).encode("utf-32-le", "surrogatepass"), "<u4").copy()
    starts = np.cumsum(sizes) - sizes
    is_letter = letters[cp]
    cp[~is_letter] = 32
    count = np.concatenate(([0], np.cumsum(is_letter)))
    left = np.repeat(starts + sizes, sizes) - np.arange(len(cp))
    rows, h = np.full((3, len(cp)), -1, np.int32), np.zeros(len(cp), np.uint32)
    for n in range(3):
        if len(cp) <= n:
            break
        h = (h[: len(cp) - n] + cp[n:]) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
        rows[n, : len(h)] = ((h * np.uint32(0x85EBCA77) + np.uint32(n * 0x27D4EB2F)) >> np.uint32(16)).astype(np.int32)
        rows[n, left <= n] = -1
    return rows, starts, count[starts + sizes] - count[starts]


@dataclass
class Model:
    """Languages; weights (with IDF in them) of each place and language; their biases; the temperature."""

    languages: list[str]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0

    def logits(self, texts: list[str], letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rows, starts, count = ngram_places(texts, letters)
        out = np.tile(self.bias, (len(texts), 1)).astype(np.float64)
        some = np.flatnonzero(count > 0)
        if len(some):
            used = (rows >= 0).sum(0)
            total = np.add.reduceat(used, starts[some])  # texts between are without characters or without letters
            ends = np.append(starts, rows.shape[1])[some + 1]
            prefix = np.concatenate(([0], np.cumsum(used)))
            total = prefix[ends] - prefix[starts[some]]
            for k in range(len(self.languages)):
                w = np.append(self.weights[:, k], np.float32(0))  # place -1 has no weight
                sums = np.concatenate(([0.0], np.cumsum(w[rows[0]] + w[rows[1]] + w[rows[2]], dtype=np.float64)))
                out[some, k] += (sums[ends] - sums[starts[some]]) / total
        return out, count

    def predict(self, texts: list[str], letters: np.ndarray) -> tuple[list[str], np.ndarray]:
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        logits, count = self.logits(texts, letters)
        p = softmax(logits / self.temperature)
        best = p.argmax(1)
        names = [self.languages[b] if c else UNKNOWN for b, c in zip(best.tolist(), count.tolist())]
        return names, np.where(count > 0, p[np.arange(len(best)), best], 0.0)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def follow_leader(examples: list[tuple[np.ndarray, np.ndarray, int]], classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights of each place, and biases, by FTRL-proximal. An example: places, their TF-IDF, its class."""
    z, n = np.zeros((PLACES + 1, classes)), np.zeros((PLACES + 1, classes))

    def weights(at):
        zz, nn = z[at], n[at]
        return np.where(np.abs(zz) <= L1, 0.0, -(zz - np.sign(zz) * L1) / ((BETA * 0.01 + np.sqrt(nn)) / ALPHA + L2))

    for turn in range(PASSES):
        for k in np.random.default_rng(turn).permutation(len(examples)):
            places, x, label = examples[k]
            at, v = np.append(places, PLACES), np.append(x, 1.0)[:, None]
            w = weights(at)
            g = softmax((w * v).sum(0))
            g[label] -= 1
            g = g[None] * v
            step = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - step * w
            n[at] += g * g
    every = weights(np.arange(PLACES + 1))
    return every[:PLACES], every[PLACES]


def held_out(id_col: str):
    """Documents that are never learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Learn from docs (doc_id, text, lang), all of them learnable: lang and text not null. The sample are the ids with the lowest
    hashes, of all and of each language; of rows that share an id and a language, one is learned from."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.xxhash64("doc_id").alias("h"), "text", "lang")
    cut = sampled(docs.select("h"), sample)
    if cut is None:
        return Model([], np.zeros((PLACES, 0), np.float32), np.zeros(0))
    first = Window.partitionBy("lang").orderBy("h")
    least = docs.select("lang", "h").distinct().withColumn("n", F.row_number().over(first)).where(F.col("n") <= LEAST).select("lang", "h").collect()
    languages = sorted({r.lang for r in least})
    chosen = (F.col("h") <= cut) | F.col("h").isin(sorted({r.h for r in least}))
    sent = docs.sparkSession.sparkContext.broadcast(({(r.lang, r.h) for r in least}, letter_table()))

    def frequencies(batches):
        letters, df = sent.value[1], np.zeros(PLACES + 1, np.int64)
        for batch in text_slices(batches):
            rows, starts, _ = ngram_places(as_texts(batch.column("text")), letters)
            stops = [*starts[1:].tolist(), rows.shape[1]]
            for a, b in zip(starts.tolist(), stops):
                seen = np.zeros(PLACES + 1, bool)
                seen[rows[:, a:b].ravel()] = True
                df[: PLACES] += seen[:PLACES]
            df[PLACES] += batch.num_rows
        yield "df", df

    def features(batches):
        own, letters = sent.value
        for batch in batches:
            named = zip(batch.column("lang").to_pylist(), batch.column("h").to_pylist())
            batch = batch.filter(pa.array([h <= cut or (lang, h) in own for lang, h in named], pa.bool_()))
            for part in text_slices([batch]):
                rows, starts, _ = ngram_places(as_texts(part.column("text")), letters)
                stops = [*starts[1:].tolist(), rows.shape[1]]
                got = [np.unique(r[r >= 0], return_counts=True) for r in (rows[:, a:b].ravel() for a, b in zip(starts.tolist(), stops))]
                columns = [pa.array([g[k].astype(np.int32).tobytes() for g in got], pa.binary()) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([part.column("h"), part.column("lang"), *columns], names=["h", "lang", "places", "counts"])

    df = summed_arrays(docs.select("text"), frequencies, {"df": PLACES + 1})["df"]
    idf = np.log((1.0 + df[PLACES]) / (1.0 + df[:PLACES])) + 0.1
    rows = docs.where(chosen).mapInArrow(features, "h long, lang string, places binary, counts binary")
    rows = rows.groupBy("h", "lang").agg(F.min(F.struct("places", "counts")).alias("x")).select("lang", "x.*").collect()
    examples = []
    for r in sorted(rows):
        places, counts = np.frombuffer(r.places, np.int32), np.frombuffer(r.counts, np.int32)
        if len(places) and r.lang in languages:
            examples.append((places, 30.0 * counts / counts.sum() * idf[places], languages.index(r.lang)))
    heads = {e[2]: i for i, e in reversed(list(enumerate(examples)))}  # each language is learned from one at least
    learn = [e for i, e in enumerate(examples) if i % APART or heads[e[2]] == i]
    apart = [e for i, e in enumerate(examples) if i % APART == 0 and heads[e[2]] != i]
    weights, bias = follow_leader(learn or examples, len(languages))
    logits = np.array([bias + x @ weights[places] for places, x, _ in apart]) if apart else np.zeros((0, len(languages)))
    labels = np.array([e[2] for e in apart], np.int64)

    def loss(t):
        p = np.log(softmax(logits / t) + 1e-300)
        slack = 1 / (len(labels) + 2)  # a sample without errors doesn't show that there are none
        return -((1 - slack) * p[np.arange(len(labels)), labels] + slack * p.mean(1)).mean()

    temperature = float(min(np.geomspace(0.2, 50, 80), key=loss)) if len(labels) else 1.0
    return Model(languages, (30.0 * weights * idf[:, None]).astype(np.float32), bias, temperature)


def identify(docs: DataFrame, model: Model, *, text_col: str = "text", pred: str = "lang_pred", score: str = "score", drop: list[str] = ()) -> DataFrame:
    """docs without the columns of ``drop``, with two more, whose names no column may have: the language, ``und`` with score 0 if
    the text is null or has no letter, and its probability. Rows are independent."""
    sent = docs.sparkSession.sparkContext.broadcast((model.languages, model.weights, model.bias, model.temperature, letter_table()))
    kept = [c for c in docs.columns if c not in drop]

    def run(batches):
        model, letters = Model(*sent.value[:4]), sent.value[4]
        for batch in text_slices(batches, text_col, limit=1 << 20):
            names, p = model.predict(as_texts(batch.column(text_col)), letters)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(names, pa.string()), pa.array(p, pa.float64())], names=[*kept, pred, score])

    return docs.mapInArrow(run, StructType([docs.schema[c] for c in kept]).add(pred, "string").add(score, "double"))


def learnable(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    return named.where(~held_out("doc_id")).where("doc_id is not null and text is not null and lang is not null")


def known_language(docs: DataFrame, *, least: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """Those rows of docs (doc_id, text, lang and any others, whatever they are called) whose language is told with at least this
    probability. Null texts and those without a letter go; null ids and languages and repeated rows stay if their text does;
    where nothing can be learned, all go; an empty table gives an empty result."""
    pred, score = fresh("_lang_pred", docs.columns), fresh("_lang_score", docs.columns)
    told = identify(docs, fit(learnable(docs), sample), pred=pred, score=score)
    return told.where((F.col(pred) != UNKNOWN) & (F.col(score) >= least)).select(docs.columns)


def language_id(docs: DataFrame, *, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row of docs (doc_id, text, lang).

    Learned from rows with text, lang and id whose crc32(doc_id as text) mod 4 is not 2; where there are none, every
    prediction is ``und``. lang, source and doc_id are no inputs of a prediction. Repeated rows stay; a null id is not held
    out. An empty table gives an empty result. Other columns are not read.
    """
    out = identify(docs.select("doc_id", F.col("text").cast("string").alias("text")), fit(learnable(docs), sample), drop=["text"])
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")
