"""Decontamination against the full table of edit distances, and in bounded memory."""

import random
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from orespark.llm import decontaminate as d


def least_edits(item: bytes, text: bytes) -> int:
    """Fewest edits between the item and any part of the text, by the whole table."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, x in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != x), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def edited(rng, item: str, edits: int) -> str:
    t = list(item)
    for _ in range(edits):
        k = rng.randrange(len(t))
        how = rng.randrange(3)
        t[k : k + 1] = [["z"], [], [t[k], "z"]][how]
    return "".join(t)


def ready(*items: str) -> d.Items:
    return d.Items.of({d.folded(t): [k] for k, t in enumerate(items)}).ready(d.EDITS)


@pytest.mark.parametrize("counted", [d.COUNTED, 40, 0])
def test_search_finds_what_the_whole_table_finds(monkeypatch, counted):
    monkeypatch.setattr(d, "COUNTED", counted)
    monkeypatch.setattr(d, "MEETINGS", 64)
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcd") for _ in range(rng.randrange(2, 6)))
    items = [" ".join(word() for _ in range(rng.randrange(6, 40))) for _ in range(12)] + ["=" * 40, "ab" * 30, "x" * 13]
    block = ready(*items)
    hits = 0
    for _ in range(60):
        item = rng.choice(items)
        text = d.folded(" ".join(word() for _ in range(10)) + edited(rng, item, rng.randrange(0, 9)) + " ".join(word() for _ in range(10)))
        got = {i: e for _, i, e, _, _ in d.search([text], block)}
        for i, t in enumerate(block.texts):
            edits = least_edits(t, text)
            assert (i in got) == (edits <= block.budget[i]), (t, text)
            if i in got:
                hits += 1
                assert got[i] == edits
    assert hits > 30


def test_repeated_grams_need_little_memory():
    block = ready("a" * 4000, "=" * 200 + " a heading with words of its own " + "=" * 200)
    tracemalloc.start()
    got = d.search([b"a" * 8000, b"=" * 8000, b"=" * 3000 + b" a heading with words of its own " + b"=" * 3000], block)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [(g[0], g[1], g[2]) for g in got] == [(0, 0, 0), (2, 1, 0)] and got[0][3:] == (0, 4000) and peak < 400e6


def test_very_long_text_of_one_letter(monkeypatch):
    monkeypatch.setattr(d, "COUNTED", 1 << 20)
    block = ready("a" * 2000)
    assert d.search([b"a" * 60_000, b"a" * 1000 + b"b" * 60_000], block) == [(0, 0, 0, 0, 2000)]


def test_short_items():
    block = ready("so it is", "北京")
    texts = [d.folded(t) for t in ("and So It Is.", "and so it isn't", "他在北京住", "", "also it is")]
    assert [(t, block.texts[i].decode()) for t, i, *_ in d.search(texts, block)] == [(0, "so it is"), (2, "北京")]


def test_ids_and_columns_of_any_kind(spark):
    item = "a passage of some length that nobody else would write like this"
    docs = spark.createDataFrame([("x", f"Before. {item.upper()} After.", "q", 1), ("y", None, "q", 2), ("x", f"Before. {item.upper()} After.", "q", 1), (None, "", "q", 3)], "doc_id string, text string, item_id string, edits int")
    bench = spark.createDataFrame([("i1", item), ("i2", item), ("i1", item), ("i3", ""), (None, item)], "item_id string, text string")
    got = d.contaminated(docs, bench)
    assert sorted((r.doc_id, r.item_id, r.edits) for r in got.collect()) == [("x", "i1", 0), ("x", "i1", 0), ("x", "i2", 0), ("x", "i2", 0)]
    left = d.decontaminated(docs, bench)
    assert left.columns == docs.columns and sorted(r.edits for r in left.collect()) == [2, 3]
    assert d.decontaminated(docs, bench.where("false")).count() == 4 and d.decontaminated(docs.where("false"), bench).isEmpty()


def test_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(d, "BLOCK_BYTES", 100)
    items = [f"item number {k} has words that {k * 37} other items lack, so it is told from them" for k in range(5)]
    docs = spark.createDataFrame([(k, f"see {items[k]} there") for k in range(4)] + [(9, "nothing of the kind")], "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = d.contaminated(docs, bench).where(F.col("edits") == 0).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(k, k) for k in range(4)]
    assert [r.doc_id for r in d.decontaminated(docs, bench).collect()] == [9]
    assert np.isclose(got[0].similarity, 1.0)
