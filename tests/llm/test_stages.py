"""The pipeline's stages, each against a plain version of itself, and on odd tables."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from orespark.llm import common, decontaminate, langid, pii

from test_decontaminate import least_edits
from test_llm import brute_components

public_tokenizers = pytest.importorskip("public_tokenizers")
DIR = "/root/testdata/sf0.001"
STAGE = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DIR}/documents.parquet")


def by_id(df):
    return {r.doc_id: r.asDict() for r in df.collect()}


def test_language(spark, docs):
    kept = by_id(STAGE["language"](spark, docs, DIR))
    told = {r.doc_id: (r.lang_pred, r.score) for r in langid.language_id(docs).collect()}
    assert kept == {i: r for i, r in by_id(docs).items() if told[i][0] != "und" and told[i][1] >= 0.5}


def test_near_duplicates(spark, docs):
    top = {i: c for i, (_, c) in brute_components([(r.doc_id, r.text) for r in docs.collect()]).items()}
    assert by_id(STAGE["near_duplicates"](spark, docs, DIR)) == {i: r for i, r in by_id(docs).items() if top[i] == i}


def test_decontamination(spark, docs):
    items = [decontaminate.folded(r.text) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    some = docs.where(F.length("text") < 700)
    want = {}
    for i, r in by_id(some).items():
        t = decontaminate.folded(r["text"] or "")
        if not any(m in t or (len(m) < 1.1 * len(t) + 20 and m[:4] in t and least_edits(m, t) <= decontaminate.edit_budget(len(m))) for m in items):
            want[i] = r
    assert by_id(STAGE["decontamination"](spark, some, DIR)) == want


def test_personal_data(spark, docs):
    field = pii.train(docs)
    got = by_id(STAGE["personal_data"](spark, docs, DIR))
    for i, r in by_id(docs).items():
        text = r["text"]
        fixed = pii.fixed_spans(text)
        spans, out, end = sorted((a, b, k) for k, a, b in fixed + field.added(text, fixed)), [], 0
        for a, b, k in spans:
            if a >= end:
                out.append(text[end:a] + f"[{pii.KINDS[k].upper()}]")
            end = max(end, b)
        text = "".join(out) + text[end:]
        assert got[i] == r | {"text": text, "n_chars": len(text)}


def test_encoding(spark, docs):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = STAGE["encoding"](spark, docs, DIR)
    want = {r.doc_id: t.encode(r.text, add_special_tokens=False).ids for r in docs.collect()}
    assert {r.doc_id: (r.n_tokens, r.ids) for r in got.collect()} == {i: (len(x), x) for i, x in want.items()}


ODD = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, " \n ", None, "s", 3), (4, "plain words in a row here", "en", "s", 25), (4, "plain words in a row here", "en", "s", 25), (5, "x" * 30_000, "en", None, 30_000), (None, "plain words in a row there", "en", "s", 26), (6, "été 日本 🙂 a@b.co", "fr", "s", 15)]


def test_odd_rows_and_empty_tables(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, spans string, component_id int, ids string, _id int, _stays string"
    df = spark.createDataFrame([(*r, "c", 1, "d", 2, "e") for r in ODD], schema)
    for name, stage in corpus_pipeline.STAGES:
        kept, none = stage(spark, df, DIR), stage(spark, df.where("false"), DIR)
        assert none.isEmpty(), name
        if name == "encoding":
            assert kept.count() == len(ODD)
            continue
        assert kept.columns == df.columns and none.columns == df.columns, name
        ids = sorted((r.doc_id is None, r.doc_id) for r in kept.collect())
        want = {"language": [4, 4, 5, 6, None], "near_duplicates": [1, 2, 3, 4, 5, 6, None]}.get(name, [1, 2, 3, 4, 4, 5, 6, None])
        assert [i for _, i in ids] == want or name == "language" and set(i for _, i in ids) <= set(want), name


def test_the_whole(spark):
    kept = spark.read.parquet(f"{DIR}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        kept = stage(spark, kept, DIR)
    want = sorted((r.doc_id, r.n_tokens, tuple(r.ids)) for r in kept.collect())
    assert sorted((r.doc_id, r.n_tokens, tuple(r.ids)) for r in corpus_pipeline.run(spark, DIR).collect()) == want
    assert len(want) > 50


def test_encoding_makes_no_text_that_it_drops(spark, docs):
    assert "decoded" not in STAGE["encoding"](spark, docs, DIR)._jdf.queryExecution().toString()


def test_freed_memory_goes_back():
    def held():
        with open("/proc/self/smaps_rollup") as file:
            return sum(int(line.split()[1]) for line in file if line.startswith("Anonymous:")) // 1024

    blocks = [bytes(700) for _ in range(300_000)]
    few = blocks[::3000]  # freed blocks between these stay with the allocator
    del blocks
    before = held()
    common.give_back()
    assert before - held() > 100 and len(few) == 100


def test_later_stages_begin_with_the_heap_given_back(spark, docs, monkeypatch):
    class Begun(Exception):
        pass

    def begun(_):
        raise Begun

    monkeypatch.setattr(corpus_pipeline, "collect_garbage", begun)
    for _, stage in corpus_pipeline.STAGES[1:]:
        with pytest.raises(Begun):
            stage(spark, docs, DIR)


def whole_collections(spark):
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    return sum(b.getCollectionCount() for b in beans if "Young" not in b.getName() and "Concurrent" not in b.getName())


@pytest.mark.parametrize("taken, collects", [(0, True), (1, False)])
def test_the_driver_collects_garbage_between_tables_if_enough_is_taken(spark, monkeypatch, taken, collects):
    monkeypatch.setattr(common, "DRIVER_TAKEN", taken, raising=False)
    before = whole_collections(spark)
    with common.scratch(spark):
        common.materialize(spark.range(10).toDF("id"), "some")
    assert (whole_collections(spark) > before) == collects
