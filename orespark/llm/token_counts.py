"""Token counts of whole texts by the compiled transducer of piece_automaton.

Long texts are cut into pieces that are read by different tasks; the pieces' maps are then composed.
"""

from __future__ import annotations

import pickle

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_texts, small_batches, text_slices
from .piece_automaton import SPACE, ChunkMap, Counter, scan

#: Characters of a chunk, of a piece, and of a text from which on it is cut into pieces.
CHUNK, PIECE, LONG = 1 << 15, 1 << 18, 1 << 20
#: Texts that a model which changes them first would count otherwise.
PROBES = ["a  b", " a ", "\u00a0x\u3000y", "\uff21\ufb01\u2460\u00bd", "e\u0301 \u00e9", "\t\r\n", "\u0130I\u00df", "\u200b\ufeff\u00ad"]


def piece_scores(model_file: str) -> dict[str, float]:
    """Score of each entry that text can become, of a sentencepiece BPE model with byte fallback that changes no text; other models
    are refused."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    usual = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i) or model.is_unused(i))]
    score = {model.id_to_piece(i): model.get_score(i) for i in usual}
    if any(SPACE in p.lstrip(SPACE) for p in score):
        raise ValueError("an entry holds a space after something else, so texts can't be cut there")
    counter = Counter(score)
    if any(counter.count(t, CHUNK) != len(model.encode(t)) for t in PROBES):
        raise ValueError("the model is none of byte pairs with byte fallback, or changes texts before it cuts them")
    return score


def token_counts(docs: DataFrame, model_file: str, *, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text", long: int = LONG, piece: int = PIECE) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row.

    The counts are those of the model's library. Null texts count as empty: no bytes, no tokens. Rows are independent, so
    repeated rows and null ids stay as they are, ids may be of any type, and an empty table gives an empty result. Other columns
    are not read. The transducer's states are made in the workers, and kept by a worker for its later tasks. Texts of more than
    ``long`` characters are read in pieces of ``piece`` by several tasks; results don't depend on either.
    """
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast({"score": piece_scores(model_file)})
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def made() -> Counter:
        kept = sent.value
        if "counter" not in kept:
            kept["counter"] = Counter(kept["score"])
        return kept["counter"]

    def run(batches):
        counter = made()
        for batch in text_slices(batches):
            text = batch.column("text")
            tokens = [counter.count(t, CHUNK) for t in as_texts(text)]
            sizes = pc.fill_null(pc.binary_length(text), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), sizes, pa.array(tokens, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    def cut(batches):
        for batch in text_slices(batches):
            for k, (row, text) in enumerate(zip(batch.column("row").to_pylist(), batch.column("text").to_pylist())):
                for i in range(0, len(text), piece):
                    yield pa.RecordBatch.from_arrays([pa.array([row]), batch.column("doc_id").slice(k, 1), pa.array([i]), pa.array([text[i : i + piece]])], names=["row", "doc_id", "at", "text"])

    def read(batches):
        counter = made()
        for batch in text_slices(batches):
            maps = []
            for at, text in zip(batch.column("at").to_pylist(), as_texts(batch.column("text"))):
                counter.rest()
                m = counter.read(counter.spelt(text, at == 0), CHUNK)
                maps.append((m.head, m.met, pickle.dumps((m.exit.suffix, m.exit.last)), m.count))
            kinds = [pa.string(), pa.bool_(), pa.binary(), pa.int64()]
            sizes = pc.binary_length(batch.column("text")).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row", "doc_id", "at")), sizes, *[pa.array(c, t) for c, t in zip(zip(*maps), kinds)]], names=["row", "doc_id", "at", "size", "head", "met", "exit", "count"])

    def compose(got: pa.Table) -> pa.Table:
        counter = made()
        counter.rest()
        rows = sorted(got.select(["at", "head", "met", "exit", "count"]).to_pylist(), key=lambda r: r["at"])
        whole = scan([ChunkMap(counter.auto, r["head"], r["met"], counter.auto.state(*pickle.loads(r["exit"])), r["count"]) for r in rows])
        return pa.table({"doc_id": got.column("doc_id")[:1], "n_bytes": pa.array([sum(got.column("size").to_pylist())], pa.int64()), "n_tokens": pa.array([whole.count], pa.int64())})

    size, counted = F.length("text"), f"doc_id {kind}, n_bytes long, n_tokens long"
    short = docs.where(F.coalesce(size <= long, F.lit(True))).mapInArrow(run, counted)
    pieces = docs.where(size > long).select(F.monotonically_increasing_id().alias("row"), "doc_id", "text").mapInArrow(cut, f"row long, doc_id {kind}, at long, text string")
    maps = pieces.repartition("row", "at").mapInArrow(read, f"row long, doc_id {kind}, at long, size long, head string, met boolean, exit binary, count long")
    every = short.unionByName(maps.groupBy("row").applyInArrow(compose, counted))
    return every.withColumn("over_limit", F.col("n_tokens") > limit)
