"""Benchmark decontamination by the q-gram lemma and banded alignment.

An item of m bytes has a q-gram at every place up to m - q, of which each STRIDE-th is indexed. An edit spoils at most
q / STRIDE of these, so an item that stands in a text with at most k edits shares all but k q / STRIDE of them with it, on
diagonals (place in the text less place in the item) that lie within k of each other. So the indexed q-grams that a text
shares with an item are counted in bands of 2(k + 1) diagonals, each half over the next; bands that reach the number are
verified by an alignment that keeps to the band. Texts are compared in lower case, as UTF-8 bytes.

Q-grams that meet too often (a ruler line against another) are left out of the count, and the number that an item needs falls
by as many as it has. Where none is left to count, item and text are compared by a bit vector a byte, in memory of the item's
size. Items shorter than a q-gram are sought as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructField, StructType

from .common import as_texts, materialize, small_batches, text_slices

#: Bytes of a q-gram; places from one indexed q-gram of an item to the next (a divisor of Q); edits that an item may have, as a
#: part of its bytes; bytes of items that are searched at once.
Q, STRIDE, EDITS, BLOCK_BYTES = 12, 4, 0.06, 32 << 20
#: Places of the table that most q-grams of a text fail to hit.
TABLE_BITS = 22
#: Meetings of q-grams that are held at once, and that are counted for one slice of texts; beyond that the most frequent are
#: left out of the count.
MEETINGS, COUNTED = 1 << 19, 1 << 25


def folded(text: str) -> bytes:
    """Lower case, character by character, so that places stay."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(x if len(x := c.lower()) == 1 else c for c in text)
    return low.encode("utf-8", "replace")


def gram_hashes(joined: bytes, n: int) -> np.ndarray:
    """A hash of the Q bytes at each of the first n places; joined must go on for Q more."""
    low = np.ndarray((n,), "<u8", buffer=joined, strides=(1,))
    high = np.ndarray((n,), "<u4", buffer=joined, offset=8, strides=(1,))
    h = low * np.uint64(0x9E3779B97F4A7C15)
    h += high * np.uint64(0xD6E8FEB86659FD93)
    return h


def edit_budget(m: int, rate: float = EDITS) -> int:
    """Edits allowed in an item of m bytes: its part, but no more than the lemma can see."""
    return max(0, min(int(rate * m), (m - Q) // Q))


def shared_grams(m: int, k: int) -> int:
    """Indexed q-grams that an item of m bytes shares at least with a text that holds it with k edits."""
    return (m - Q) // STRIDE + 1 - k * (Q // STRIDE)


@dataclass
class Items:
    """A block of different items, those of at least Q bytes first: the ids of each; hashes of the indexed q-grams, sorted, with
    the item and place of each."""

    ids: list[list]
    texts: list[bytes]
    hashes: np.ndarray
    item: np.ndarray
    place: np.ndarray

    @staticmethod
    def of(held: dict[bytes, list]) -> Items:
        texts = sorted(held, key=lambda t: len(t) < Q)
        joined, sizes = b"".join(texts) + b"\0" * (Q + 8), np.array([len(t) for t in texts])
        starts, n = np.cumsum(sizes) - sizes, int(sizes.sum())
        item = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
        place = (np.arange(n) - starts[item]).astype(np.int32)
        inside = (place + Q <= sizes[item]) & (place % STRIDE == 0)
        hashes = gram_hashes(joined, n)[inside]
        order = np.argsort(hashes, kind="stable")
        return Items([held[t] for t in texts], texts, hashes[order], item[inside][order], place[inside][order])

    def ready(self, rate: float) -> Items:
        """With what a worker needs besides: the table, budgets, needed q-grams, and the short items' automaton."""
        self.table = np.zeros(1 << TABLE_BITS, bool)
        self.table[(self.hashes >> np.uint64(64 - TABLE_BITS)).astype(np.int64)] = True
        self.budget = np.array([edit_budget(len(t), rate) for t in self.texts], np.int64)
        self.needed = np.array([shared_grams(len(t), k) for t, k in zip(self.texts, self.budget.tolist())], np.int64)
        self.short = ahocorasick.Automaton()
        for i, t in enumerate(self.texts):
            if len(t) < Q:
                self.short.add_word(t.decode("latin-1"), i)
        if len(self.short):
            self.short.make_automaton()
        return self


def blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[Items]:
    """All items but empty ones, in blocks of a bounded size, read one partition after the other."""
    held: dict[bytes, list] = {}
    size = 0
    for r in benchmark.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t")).where("i is not null and t <> ''").distinct().toLocalIterator():
        text = folded(r.t)
        if held and size + len(text) > BLOCK_BYTES:
            yield Items.of(held)
            held, size = {}, 0
        ids = held.setdefault(text, [])
        if r.i not in ids:
            ids.append(r.i)
        size += len(text)
    if held:
        yield Items.of(held)


def align(item: bytes, text: bytes, low: int, high: int, budget: int) -> tuple[int, int, int] | None:
    """Fewest edits between the item and a part of text that begins at low..high, and that part, if within the budget.

    Cells whose diagonal lies outside low - budget .. high + budget are not computed. Of equal parts the one that ends
    first counts, and of its beginnings the last.
    """
    m, first, last = len(item), low - budget, high + budget
    width, far = last - first + 1, len(item) + 1
    t = np.frombuffer(text, np.uint8)
    start = np.arange(first, last + 1)
    inside = (start >= max(low, 0)) & (start <= min(high, len(text)))
    cost, begin, column = np.where(inside, 0, far), np.where(inside, start, -1), np.arange(width)
    for i in range(m):
        j = start + i  # the text's byte that cell (i + 1, j + 1) reads
        valid = (j >= 0) & (j < len(text))
        match = np.where(valid, cost + (t[np.clip(j, 0, len(text) - 1)] != item[i]), far)
        skip = np.append(cost[1:] + 1, far)  # the item's byte stands against nothing
        new = np.minimum(match, skip)
        came = np.where(match <= skip, begin, np.append(begin[1:], -1))
        # the text's bytes against nothing: the cheapest cell to the left, a cost for each step
        base = new - column
        least = np.minimum.accumulate(base)
        source = np.maximum.accumulate(np.where(base == least, column, 0))
        cost, begin = np.minimum(least + column, far), came[source]
        cost = np.where(start + i + 1 <= len(text), cost, far)
        if cost.min() > budget:
            return None
    at = int(cost.argmin())
    return (int(cost[at]), int(begin[at]), int(start[at] + m)) if cost[at] <= budget and begin[at] >= 0 else None


def nearest(item: bytes, text: bytes) -> tuple[int, int]:
    """Fewest edits between the item and any part of text, and where the first such part ends: a bit vector for each byte."""
    m = len(item)
    mask, top = (1 << m) - 1, 1 << (m - 1)
    equal = [0] * 256
    for i, c in enumerate(item):
        equal[c] |= 1 << i
    plus, minus, edits, best = mask, 0, m, (m, 0)
    for end, c in enumerate(text, 1):
        eq = equal[c]
        across = eq | minus
        down = (((eq & plus) + plus) ^ plus) | eq
        up, low = minus | (mask & ~(down | plus)), plus & down
        edits += bool(up & top) - bool(low & top)
        up, low = up << 1 & mask, low << 1 & mask
        plus, minus = low | (mask & ~(across | up)), up & across
        if edits < best[0]:
            best = (edits, end)
            if not edits:
                break
    return best


def _tally(keys: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different columns of keys, with the sums of their counts."""
    order = np.lexsort(keys[::-1])
    keys = keys[:, order]
    first = np.flatnonzero(np.concatenate(([True], (keys[:, 1:] != keys[:, :-1]).any(0))))
    return keys[:, first], np.add.reduceat(count[order], first)


def _bands(at, lo, hi, text, start, items: Items) -> tuple[np.ndarray, np.ndarray]:
    """(text, item, band) and the meetings in it, from places ``at`` of the joined texts whose q-gram is that of lo..hi."""
    ends, keys, count = np.cumsum(hi - lo), np.zeros((3, 0), np.int64), np.zeros(0, np.int64)
    done = 0
    while done < len(at):
        stop = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + MEETINGS, side="right")))
        size = (hi - lo)[done:stop]
        pick = np.repeat(lo[done:stop] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        t, i = np.repeat(text[done:stop], size), items.item[pick]
        band = np.floor_divide(np.repeat(at[done:stop], size) - start[t] - items.place[pick], items.budget[i] + 1)
        new = np.concatenate([np.stack([t, i, b]) for b in (band, band - 1)], axis=1)
        new, times = _tally(new, np.ones(new.shape[1], np.int64))
        keys, count = _tally(np.concatenate((keys, new), axis=1), np.concatenate((count, times))) if done else (new, times)
        done = stop
    return keys, count


def search(texts: list[bytes], items: Items) -> list[tuple[int, int, int, int, int]]:
    """(text, item, edits, start, end) of the best place of each item in each text that has one."""
    best: dict[tuple[int, int], tuple[int, int, int]] = {}

    def found(d, i, place):
        if place and ((d, i) not in best or place < best[d, i]):
            best[d, i] = place

    if len(items.short):
        for d, t in enumerate(texts):
            for last, i in items.short.iter(t.decode("latin-1")):
                begin, end = last + 1 - len(items.texts[i]), last + 1
                if not (_joined(t, begin) or _joined(t, end)):
                    found(d, i, (0, begin, end))
    joined, sizes = b"".join(texts) + b"\0" * (Q + 8), np.fromiter(map(len, texts), np.int64, len(texts))
    n, ends = len(joined) - Q - 8, np.cumsum(sizes)
    if n and len(items.hashes):
        h = gram_hashes(joined, n)
        at = np.flatnonzero(items.table[(h >> np.uint64(64 - TABLE_BITS)).astype(np.int64)])
        lo, hi = np.searchsorted(items.hashes, h[at], "left"), np.searchsorted(items.hashes, h[at], "right")
        text = np.searchsorted(ends, at, side="right")
        inside = (hi > lo) & (at + Q <= ends[np.minimum(text, len(texts) - 1)])
        at, lo, hi, text = at[inside], lo[inside], hi[inside], text[inside]
        needed = items.needed
        if int((hi - lo).sum()) > COUNTED:
            gram, which, times = np.unique(lo, return_inverse=True, return_counts=True)
            until = np.searchsorted(items.hashes, items.hashes[gram], "right")
            order = np.argsort(times * (until - gram), kind="stable")
            usual = np.zeros(len(gram), bool)
            usual[order[np.cumsum((times * (until - gram))[order]) <= COUNTED]] = True
            needed, crowded = needed.copy(), set()
            for g in np.flatnonzero(~usual).tolist():
                np.subtract.at(needed, items.item[gram[g] : until[g]], 1)
            for g in np.flatnonzero(~usual).tolist():
                own = np.unique(items.item[gram[g] : until[g]])
                own = own[needed[own] < 1].tolist()
                crowded.update((d, i) for d in np.unique(text[which == g]).tolist() for i in own)
            for d, i in sorted(crowded):
                k = int(items.budget[i])
                edits, end = nearest(items.texts[i], texts[d])
                if edits <= k:
                    low = end - len(items.texts[i])
                    found(d, i, align(items.texts[i], texts[d], low - k, low + k, k))
            keep = usual[which]
            at, lo, hi, text = at[keep], lo[keep], hi[keep], text[keep]
        if len(at):
            keys, count = _bands(at, lo, hi, text, ends - sizes, items)
            enough = (count >= needed[keys[1]]) & (needed[keys[1]] > 0)
            for d, i, b in keys[:, enough].T.tolist():
                k, item = int(items.budget[i]), items.texts[i]
                low, high = b * (k + 1), (b + 2) * (k + 1) - 1
                begin = texts[d].find(item, max(low, 0), max(high, 0) + len(item))
                found(d, i, (0, begin, begin + len(item)) if begin >= 0 else align(item, texts[d], low, high, k))
    return [(d, i, *place) for (d, i), place in sorted(best.items())]


def _joined(text: bytes, at: int) -> bool:
    """Whether a letter or digit (of ASCII) stands on both sides of a place."""
    return 0 < at < len(text) and text[at - 1 : at + 1].isalnum()


def _searched(docs: DataFrame, benchmark: DataFrame, item_col: str, item_text_col: str, rate: float, step) -> Iterator[DataFrame]:
    """step(docs, ready) for each block of items, where ready() gives a worker the block; what step returned for a block before
    is written down when the next one begins, so the driver holds two blocks at most."""
    before = None
    for items in blocks(benchmark, item_col, item_text_col):
        if before:
            yield materialize(before[0], "searched")
            before[1].unpersist()
        sent = docs.sparkSession.sparkContext.broadcast({"items": (items.ids, items.texts, items.hashes, items.item, items.place)})

        def ready(sent=sent):
            kept = sent.value  # a worker keeps it for its later tasks
            if "ready" not in kept:
                kept["ready"] = Items(*kept["items"]).ready(rate)
            return kept["ready"]

        before = (step(ready), sent)
    if before:
        yield before[0]


def contaminated(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", rate: float = EDITS) -> DataFrame:
    """doc_id, item_id, edits, start_char, end_char, similarity: one row for each document and item of which it holds a
    copy with at most ``rate`` edits a byte (none in an item of under 24 bytes), the best copy, the first of equal ones.

    Items of under 12 bytes are found where no letter or digit of ASCII goes on beside them. Places are code points, the end
    exclusive. Ids may be of any type. Null and empty texts hold nothing; null and empty items, and those without an id, are
    not searched; rows without an id are searched too. Repeated rows give repeated results, repeated items one each; an item's
    id on several texts is several items. Empty tables give an empty result. Other columns are not read. Items are searched in
    blocks of bounded size, each against all documents.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    item_type = benchmark.schema[item_col].dataType
    schema = StructType([docs.schema["doc_id"], StructField("item_id", item_type)]).add("edits", "integer").add("start_char", "long").add("end_char", "long").add("similarity", "double")

    def step(ready):
        def run(batches):
            items = ready()
            for batch in text_slices(batches, limit=1 << 20):
                whole = [folded(t) for t in as_texts(batch.column("text"))]
                got = [(d, i, *place, one) for d, i, *place in search(whole, items) for one in items.ids[i]]

                def chars(d, at):
                    return len(whole[d][:at].decode("utf-8", "ignore"))

                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").take(pa.array([g[0] for g in got], pa.int64())),
                        pa.array([g[5] for g in got], to_arrow_type(item_type)),
                        pa.array([g[2] for g in got], pa.int32()),
                        pa.array([chars(g[0], g[3]) for g in got], pa.int64()),
                        pa.array([chars(g[0], g[4]) for g in got], pa.int64()),
                        pa.array([round(1 - g[2] / len(items.texts[g[1]]), 9) for g in got], pa.float64()),
                    ],
                    names=schema.names,
                )

        return docs.mapInArrow(run, schema)

    out = None
    for found in _searched(docs, benchmark, item_col, item_text_col, rate, step):
        out = found if out is None else out.unionByName(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def decontaminated(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", rate: float = EDITS) -> DataFrame:
    """Those rows of docs (with all their columns, whatever they are called) that hold no copy of an item, as in
    ``contaminated``. Null and empty texts hold none and stay, and so do repeated rows without one; without items all rows
    stay; an empty table gives an empty result."""
    small_batches(docs.sparkSession)

    def step(ready):
        def run(batches):
            items = ready()
            for batch in text_slices(batches, text_col, limit=1 << 20):
                clean = np.ones(batch.num_rows, bool)
                clean[[g[0] for g in search([folded(t) for t in as_texts(batch.column(text_col))], items)]] = False
                yield batch.filter(pa.array(clean))

        return left.mapInArrow(run, docs.schema)

    left = docs
    for left in _searched(docs, benchmark, item_col, item_text_col, rate, step):
        pass
    return left
