"""The Jaccard join against all pairs, whatever its parameters, and where keys are crowded."""

import random

import pytest

from orespark.llm import ngram_join

from test_llm import brute_components

SCHEMA = "doc_id long, text string"


def texts(seed, n=160, common=0.5):
    rng = random.Random(seed)
    base = [[rng.choice("abcdefghij") + str(rng.randrange(40)) for _ in range(rng.randrange(6, 60))] for _ in range(12)]
    shared = ["common", "passage", "that", "stands", "in", "very", "many", "texts", "here"]
    rows = []
    for i in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = str(rng.randrange(999))
        rows.append((i, " ".join((shared if rng.random() < common else []) + w)))
    return rows


def made_of_common_lines(n=220, lines=40, of=6):
    """Texts of lines that many texts have: hardly a token is rare, few texts are linked."""
    rng = random.Random(11)
    every = [" ".join(f"l{k}w{j}" for j in range(8)) for k in range(lines)]
    rows = []
    for i in range(n):
        picked = rng.sample(every, of)
        rows.append((i, " ".join(picked)))
        if i % 9 == 0:
            rows.append((1000 + i, " ".join([*picked, "a last word"])))
    return rows


def answer(spark, rows, **how):
    got = ngram_join.ngram_jaccard_join(spark.createDataFrame(rows, SCHEMA), **how).collect()
    assert len(got) == len(rows)
    return {r.doc_id: (r.n_shingles, r.component_id) for r in got}


@pytest.mark.parametrize("how", [{"most_frequent": 8}, {"frequent": 2, "work": 1}])
def test_parameters_change_nothing(spark, how):
    rows = texts(7)
    assert answer(spark, rows, **how) == brute_components(rows)


@pytest.mark.parametrize("how", [{"frequent": 4}, {"frequent": 4, "work": 1}])
def test_texts_of_common_lines(spark, how):
    rows = made_of_common_lines()
    want = brute_components(rows)
    assert len({c for _, c in want.values()}) > 150 and answer(spark, rows, **how) == want


def test_crowded_keys(spark, monkeypatch):
    """One text holds a third of the rows, one hub many near copies; keys of more than five rows are spread."""
    monkeypatch.setattr("orespark.llm.common.SPREAD_ROWS", 5)
    monkeypatch.setattr("orespark.llm.ngram_join.SPREAD_ROWS", 5)
    monkeypatch.setattr("orespark.llm.ngram_join.HUB_LINKS", 5)
    long = " ".join(f"w{k}" for k in range(60))
    rows = [*texts(3, 60), *[(500 + i, "the same few words over and over again") for i in range(60)], *[(700 + i, f"{long} {i}") for i in range(60)]]
    assert answer(spark, rows, frequent=8) == brute_components(rows)


def test_an_id_on_several_texts(spark):
    a, b = (" ".join(f"{x}{k}" for k in range(30)) for x in "ab")
    rows = [(5, a), (3, a), (5, b), (9, f"{b} more"), (7, "something else that stands all on its own")]
    got = ngram_join.ngram_jaccard_join(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(3, 3), (5, 3), (5, 3), (7, 7), (9, 3)]
    stays = ngram_join.one_of_each(spark.createDataFrame([(1, a), (1, b), (1, a), (2, "x y")], SCHEMA)).collect()
    assert sorted(r.doc_id for r in stays) == [1, 2]


def test_ids_must_be_integers(spark):
    with pytest.raises(TypeError):
        ngram_join.ngram_jaccard_join(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


def test_short_forms_let_all_links_through():
    import numpy as np

    rng = np.random.default_rng(1)
    for n in (1, 5, 40, 900, 4000, 5000, 30_000):
        x = np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64))
        for part in (0.0, 0.1, 0.18, 0.3, 0.6):
            keep = rng.random(len(x)) >= part
            y = np.unique(np.concatenate((x[keep], rng.integers(0, 1 << 64, 3, dtype=np.uint64))))
            linked = ngram_join.are_linked(x.tobytes(), y.tobytes())
            assert linked == (100 * len(np.intersect1d(x, y)) >= 80 * len(np.union1d(x, y)))
            told = ngram_join.may_link(ngram_join.shortened(x), ngram_join.shortened(y))
            assert told >= linked and (told or part >= 0.1 or n < 40)
        assert n < 40 or not ngram_join.may_link(ngram_join.shortened(x), ngram_join.shortened(rng.integers(0, 1 << 64, n, dtype=np.uint64)))
