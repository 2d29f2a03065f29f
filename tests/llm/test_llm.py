"""The training-data operators against brute force, libraries and edge cases."""

import collections
import random
import re

import pytest
from pyspark.sql import functions as F

from orespark.llm import bpe, chat, decontaminate, langid, licenses, ngram_join, pii, quality, secrets, token_counts

public_tokenizers = pytest.importorskip("public_tokenizers")
DIR = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, component_id int, kept string, spans string, score int"
LONG = "word " * 3000 + "x" * 9000 + "\n" * 500


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows, ties, and columns with clashing names."""
    texts = [None, "", "   \n", LONG, "a b c d e f", "A B C D E F", "a b c d e f", "plain words here", "été à la plage 日本 🙂", "token = abcdefgh12345678"]
    rows = [(i, t, None if i % 3 == 0 else "en", "s", 1, "x", "y", 2) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[4], (None, "a b c d e f", "en", None, None, None, None, None)], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DIR}/documents.parquet")


def sets(rows):
    out = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        out[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    return out


def brute_components(rows):
    s = sets(rows)
    top = {i: i for i in s}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    ids = sorted(s)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if s[a] and s[b] and 100 * len(s[a] & s[b]) >= 80 * len(s[a] | s[b]):
                x, y = find(a), find(b)
                top[max(x, y)] = min(x, y)
    return {i: (len(s[i]), find(i)) for i in s}


@pytest.mark.parametrize("frequent", [2, 32])
def test_join_is_exact(spark, frequent):
    rng = random.Random(frequent)
    base = [[rng.choice("abcdefghij") + str(rng.randrange(40)) for _ in range(rng.randrange(6, 60))] for _ in range(12)]
    shared = ["common", "passage", "that", "stands", "in", "very", "many", "texts", "here"]
    rows = []
    for i in range(160):
        w = list(rng.choice(base))
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = str(rng.randrange(999))
        rows.append((i, " ".join((shared if rng.random() < 0.5 else []) + w)))
    got = ngram_join.ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), frequent=frequent)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == brute_components(rows)


def test_join_edges(spark, odd):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_jaccard_join(odd).collect()}
    assert got[0] == (0, 0) and got[1] == (0, 1) and got[4] == (2, 4) == got[5] == got[6] and got[None] == (2, None)
    assert ngram_join.ngram_jaccard_join(odd).count() == 12 and ngram_join.ngram_jaccard_join(odd.where("false")).isEmpty()
    stays = sorted((r.doc_id is None, r.doc_id) for r in ngram_join.one_of_each(odd).select("doc_id").collect())
    assert [i for _, i in stays] == [0, 1, 2, 3, 4, 7, 8, 9, None]


def test_licenses(spark, odd):
    df = spark.createDataFrame([(1, "Under the\nMIT license. under the mit license"), (2, "Licensed under CC BY-NC 4.0."), (3, "This work is licensed under the GNU General Public License, version 3."), (4, "under the license of mit")], "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.license_scan(df).collect()}
    assert (got[1].n_base, got[1].first_word, got[1].last_word, got[1].labels, got[1].score) == (2, 0, 4, "mit", 1.0)
    assert got[2].base_labels == "cc-by-nc" and (got[3].base_labels, got[3].labels) == ("", "gpl-3") and got[4].n_base == 0
    edge = licenses.license_scan(odd).collect()
    assert len(edge) == 12 and all(r.n_base == 0 and r.first_word is None for r in edge) and licenses.license_scan(odd.where("false")).isEmpty()


def test_token_counts(spark, docs, odd):
    sentencepiece = pytest.importorskip("sentencepiece")
    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    for df in (docs.select("doc_id", "text"), odd):
        want = sorted((r.doc_id or -1, len((r.text or "").encode()), len(model.encode(r.text or ""))) for r in df.select("doc_id", "text").collect())
        assert sorted((r.doc_id or -1, r.n_bytes, r.n_tokens) for r in token_counts.token_counts(df, path).collect()) == want
    assert token_counts.token_counts(odd.where("false"), path).isEmpty()


def test_chunks_compose():
    sentencepiece = pytest.importorskip("sentencepiece")
    from orespark.llm.piece_automaton import Counter

    path = public_tokenizers.path("piece_bpe_32k.model")
    model, counter, rng = sentencepiece.SentencePieceProcessor(model_file=path), Counter(token_counts.piece_scores(path)), random.Random(5)
    for _ in range(300):
        t = "".join(rng.choice("aabthe ing  \n\t.,'()=_--é中😀▁0123") for _ in range(rng.randrange(50)))
        assert {counter.count(t, k) for k in (1, 3, 8, 1000)} == {len(model.encode(t))}


def test_codec(spark, docs, odd):
    tokenizers = pytest.importorskip("tokenizers")
    path = public_tokenizers.path("byte_bpe_50k.json")
    t = tokenizers.Tokenizer.from_file(path)
    special = spark.createDataFrame([(1, "a<|endoftext|>'s b  c\n\n d"), (2, "it's I'LL they've   "), (3, "Straße x\r\n 12½ ")], "doc_id long, text string")
    for df in (docs.select("doc_id", "text"), odd, special):
        want = sorted((r.doc_id or -1, t.encode(r.text or "", add_special_tokens=False).ids, r.text or "") for r in df.select("doc_id", "text").collect())
        assert sorted((r.doc_id or -1, list(r.ids), r.decoded) for r in bpe.bpe_encode(df, path, entries=500).collect()) == want
    assert bpe.bpe_encode(odd.where("false"), path).isEmpty()


def test_secrets(spark, odd):
    live = "Zk93hfQ0sLw8XbT2vYp6"
    rows = [(1, f"key {live} end", "a"), (2, "password: hunter22222", "a"), (3, 'PassWord="hunter22222" token=abc', "b"), (4, "AKIA" + "A1" * 8 + " " + "0f" * 20, "a")]
    got = {r.doc_id: r for r in secrets.secret_scan(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[1].spans == "live:4:24" and got[1].n_assign == 0
    assert (got[2].spans, got[2].n_live, got[2].n_example) == ("assign:0:21", 0, 1) and got[3].n_assign == 1
    assert got[4].spans == "access:0:20,hex:21:61"
    assert secrets.secret_scan(odd).count() == 12 and secrets.secret_scan(odd.where("false")).isEmpty()


def test_quality(spark, docs, odd):
    labels = spark.read.parquet(f"{DIR}/labels.parquet")
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in quality.quality(docs, labels).collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", text[r.doc_id])
        n = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        covered = {j for i in range(len(w) - 7) if n[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        assert (r.n_words, r.word_chars, r.n_repeat_words) == (len(w), sum(map(len, w)), len(covered))
    edge = quality.quality(odd, labels.where("false")).collect()
    assert len(edge) == 12 and all(r.base_failed and not r.kept for r in edge if r.doc_id in (0, 1, 2))
    assert quality.quality(odd.where("false"), labels).isEmpty()


def test_chat(spark):
    rows = [(1, 0, "user", "<|im_end|>\\<|"), (1, 1, "assistant", "ok \\ <\\|"), (2, 0, "assistant", None), (2, None, None, "x"), (None, 0, "user", "y"), (1, 1, "assistant", "ok \\ <\\|")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.read_back(chat.format_chat(df)).collect()}
    assert [(t.role, t.text) for t in got[1].turns] == [("user", "<|im_end|>\\<|"), ("assistant", "ok \\ <\\|"), ("assistant", "ok \\ <\\|")]
    assert got[1].loss_text == "ok \\ <\\|" * 2 and not got[1].valid and got[None].valid and [t.text for t in got[2].turns] == ["x", ""]
    assert chat.chat_digests(df.where("false")).isEmpty()


def test_pii(spark, docs, odd):
    phone = "+1 (212) 555-0123"
    df = spark.createDataFrame([(1, f"call {phone} or mail a.b@c.example, 10.0.0.256 10.0.0.25, 4111111111111111"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in pii.pii_digests(df.unionByName(docs.where("doc_id > 2").select("doc_id", "text"))).collect()}
    assert (got[1].n_phone, got[1].n_email, got[1].n_ip, got[1].n_card) == (1, 1, 1, 1) and got[2].spans == ""
    text = {r.doc_id: r.text for r in pii.redact(df.withColumn("n_chars", F.length("text").cast("long"))).collect()}
    assert text[1].startswith("call [PHONE] or mail [EMAIL], ") and text[2] is None
    assert pii.pii_digests(odd).count() == 12 and pii.pii_digests(odd.where("false")).isEmpty()


def test_decontamination(spark, odd):
    rng = random.Random(4)
    item = " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(30))
    near = item[:40] + "X" + item[41:90] + item[92:]
    rows = [(1, "é " * 50 + item.upper() + " tail"), (2, "start " + near), (3, item[: len(item) // 2]), (4, None)]
    df, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(9, item), (8, None), (7, "tiny")], "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.contaminated(df, bench).collect()}
    assert set(got) == {1, 2} and (got[1].edits, got[1].start_char, got[1].end_char) == (0, 100, 100 + len(item)) and got[2].edits == 3
    assert {r.doc_id for r in decontaminate.decontaminated(df, bench).collect()} == {3, 4}
    assert decontaminate.contaminated(odd, bench).isEmpty() and decontaminate.contaminated(odd, bench.where("false")).isEmpty() and decontaminate.contaminated(df.where("false"), bench).isEmpty()


def test_languages(spark, docs, odd):
    got = langid.language_id(docs).join(docs.select("doc_id", F.col("lang").alias("true")), "doc_id").where("held_out").collect()
    assert len(got) > 20 and sum(r.lang_pred == r.true for r in got) / len(got) > 0.95 and all(0 <= r.score <= 1 for r in got)
    edge = {r.doc_id: r.lang_pred for r in langid.language_id(odd).collect()}
    assert edge[0] == edge[1] == edge[2] == "und" and edge[7] == "en" and langid.language_id(odd.where("false")).isEmpty()
    assert {r.lang_pred for r in langid.language_id(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
