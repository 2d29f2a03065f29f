"""What the queries return, against plain readings of their rules; odd rows and tables."""

import collections
import hashlib
import json
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from orespark.llm import bpe, chat, langid, licenses, piece_automaton, quality, secrets, token_counts

public_tokenizers = pytest.importorskip("public_tokenizers")
DIR = "/root/testdata/sf0.001"
WORD = r"[^\x20\x09-\x0D]+"
LONG = ["x" * 70_000, "日本語" * 20_000, "=" * 50_000, "ab" * 30_000 + " end", " " * 40_000]


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DIR}/documents.parquet")


@pytest.fixture(scope="module")
def long(spark):
    return spark.createDataFrame([(f"id{i}", t) for i, t in enumerate(LONG)] + [("id0", LONG[0]), (None, None)], "doc_id string, text string")


# licenses


def plain_licenses(text, templates, phrases):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    places = [(i, label) for x, label in phrases.items() for p in [x.split()] for i in range(len(words)) if words[i : i + len(p)] == p]
    best = {}
    for x, label in templates.items():
        whole, stride = set(x.split()), max(8, -int(-1.25 * len(x.split()) // 1))
        need = len(whole) if len(whole) < 8 else -int(-0.8 * len(whole) // 1)
        for k in range(0, max(1, len(words)), stride):
            for at in (k,):
                got = len(whole & set(words[at : at + 2 * stride]))
                if got >= need:
                    best[label] = max(best.get(label, 0), got / len(whole))
    return words, places, best


def test_license_scan_finds_every_block(spark):
    rng = random.Random(3)
    templates = {" ".join(rng.choice("abcdefghijklmnop") + str(rng.randrange(4)) for _ in range(n)): f"t{n}" for n in (3, 5, 9, 20, 60)}
    phrases = {"a1 b2": "p", "c0 c0 d1": "q"}
    texts = []
    for i in range(300):
        w = [rng.choice("abcdefghijklmnop") + str(rng.randrange(4)) for _ in range(rng.randrange(30))]
        for x in rng.sample(list(templates), rng.randrange(3)):
            t = x.split()
            for _ in range(rng.randrange(0, len(t) // 3 + 1)):
                t[rng.randrange(len(t))] = "zz"
            w += t + ["y"] * rng.randrange(20)
        texts.append(rng.choice([" ", ", ", "\n"]).join(w).upper())
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(-1, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.license_scan(df, templates=templates, phrases=phrases).collect()}
    found = 0
    for i, t in [*enumerate(texts), (-1, "")]:
        words, places, best = plain_licenses(t, templates, phrases)
        base = {label for _, label in places}
        r = got[i]
        assert (r.n_words, r.n_base, r.base_labels) == (len(words), len(places), ",".join(sorted(base)))
        assert (r.first_word, r.last_word) == (min((p for p, _ in places), default=None), max((p for p, _ in places), default=None))
        assert r.labels == ",".join(sorted(base | set(best)))
        assert r.score == pytest.approx(1.0 if base else max(best.values(), default=0.0))
        found += bool(best)
    assert found > 50


def test_whole_license_texts_are_found(spark):
    from orespark.llm.license_texts import TEXTS

    rng, rows = random.Random(5), []
    for i, (label, text) in enumerate(TEXTS):
        words = text.split()
        for _ in range(len(words) // 12):
            words[rng.randrange(len(words))] = "other"
        rows.append((i, "intro " * rng.randrange(400) + " ".join(words).lower() + " outro" * 300))
    got = {r.doc_id: r for r in licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(label in got[i].labels.split(",") for i, (label, _) in enumerate(TEXTS))
    scattered = " ".join(w + " and so on, with this and that in between" for w in TEXTS[0][1].split())
    assert licenses.license_scan(spark.createDataFrame([(1, scattered)], "doc_id long, text string")).first().labels == ""


# token counts and the codec


def test_token_counts_of_long_texts(spark, long):
    sentencepiece = pytest.importorskip("sentencepiece")
    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    mixed = "a text with words " * 3000 + "日本" * 9000 + " and more"
    df = long.unionByName(spark.createDataFrame([("m", mixed)], long.schema)).withColumn("n_bytes", F.lit("clash"))
    want = sorted((r.doc_id or "", len((r.text or "").encode()), len(model.encode(r.text or "")), len(model.encode(r.text or "")) > 4096) for r in df.collect())
    for how in ({}, {"long": 10_000, "piece": 7001}):
        got = token_counts.token_counts(df, path, **how).collect()
        assert sorted((r.doc_id or "", r.n_bytes, r.n_tokens, r.over_limit) for r in got) == want, how


def test_maps_hold_for_every_state():
    pytest.importorskip("sentencepiece")
    counter = piece_automaton.Counter(token_counts.piece_scores(public_tokenizers.path("piece_bpe_32k.model")))
    rng, auto = random.Random(8), counter.auto
    for _ in range(200):
        first, second, third = ("".join(rng.choice("aabbthe▁in,é中0") for _ in range(rng.randrange(1, 30))) for _ in range(3))
        state, n = auto.run(auto.start, first)
        end, m = auto.run(state, second)
        rest = auto.run(end, third)[1]
        for made in (counter.chunk(second), counter.read(second, 4)):
            other, k = made(state)
            assert k == m and auto.run(other, third)[1] == rest  # states that go on alike need not be one
        assert piece_automaton.scan([counter.chunk(x) for x in (first, second, third)])(auto.start)[1] == n + m + rest


def test_other_models_are_refused(tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}}):
        other = tmp_path / "other.json"
        other.write_text(json.dumps(spec | change), encoding="utf-8")
        with pytest.raises(ValueError):
            bpe.Vocabulary.load(str(other))


def test_codec_digests(spark, docs, long):
    tokenizers = pytest.importorskip("tokenizers")
    path = public_tokenizers.path("byte_bpe_50k.json")
    t = tokenizers.Tokenizer.from_file(path)
    df = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").unionByName(long).withColumn("n_tokens", F.lit("clash"))
    want = []
    for r in df.collect():
        ids = t.encode(r.text or "", add_special_tokens=False).ids
        want.append((r.doc_id or "", len(ids), sha(",".join(map(str, ids))), sha(t.decode(ids, skip_special_tokens=False))))
    got = bpe.bpe_digests(df, path, entries=300)
    assert sorted((r.doc_id or "", r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got.collect()) == sorted(want)
    assert bpe.bpe_digests(df.where("false"), path).isEmpty()


# quality


def test_quality_columns(spark, docs):
    labels = spark.read.parquet(f"{DIR}/labels.parquet")
    odd = ["", None, " \n\t ", "a\na\n a\na\n\n\nb\nb", "#*$%&|<> é#", "w " * 400, "one two three four five six seven eight " * 3, "日本 " * 30]
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(odd)], "doc_id long, text string"))
    text = {r.doc_id: r.text or "" for r in df.collect()}
    clash = df.withColumn("kept", F.lit("x")).withColumn("score", F.lit(1))
    ratio = quality.log_ratios(df, labels)
    rows = quality.quality(clash, labels.withColumn("text", F.lit("clash"))).collect()
    assert len(rows) == len(text)
    for r in rows:
        t = text[r.doc_id]
        w = re.findall(WORD, t)
        windows = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        repeated = {j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        lines = [x for x in t.split("\n") if re.search(WORD, x)]
        failed = len(w) < 20 or 100 * len(repeated) > 30 * len(w)
        b = t.encode()
        score = sum(ratio[((int.from_bytes(b[i : i + 3], "little") * 0x9E3779B1) & 0xFFFFFFFF) >> 16] for i in range(len(b) - 2)) / (max(0, len(b) - 2) + quality.SHRINK)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(repeated))
        assert r.base_failed == failed and r.score == pytest.approx(score, abs=1e-6) and r.kept == (not failed and r.score >= quality.THRESHOLD)


# chat


def test_chat_reads_back_what_it_was_given(spark):
    rng = random.Random(4)
    nasty = ["<|", "<|im_start|>", "<|im_end|>\n", "\\", "<\\|", "<\\n", "\n", "assistant", "", "é", "<", "|"]
    rows = [(c, t, rng.choice(["user", "assistant", "system", "a\nb", "x<|y", "q\\n"]), "".join(rng.choice(nasty) for _ in range(rng.randrange(8)))) for c in range(60) for t in range(rng.randrange(1, 9))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    want = collections.defaultdict(list)
    for c, t, role, text in sorted(rows):
        want[c].append((role, text))
    made = {r.conv_id: r for r in chat.format_chat(df).collect()}
    for r in chat.chat_digests(df.withColumn("formatted", F.lit("clash")).withColumn("t", F.lit(1))).collect():
        turns, f = want[r.conv_id], made[r.conv_id]
        said = "".join(text for role, text in turns if role == "assistant")
        assert (r.n_turns, r.loss_chars, r.formatted_chars) == (len(turns), len(said), len(f.formatted))
        assert r.turns_sha256 == sha("".join(f"{role}\n{text}\n" for role, text in turns)) and r.loss_sha256 == sha(said)
        assert f.formatted == "".join(s.text for s in f.segments) and f.formatted.count("<|im_start|>") == len(turns)
        assert [f.formatted[s.start : s.start + s.length] for s in f.loss_spans] == [s.text for s in f.segments if s.loss]


def test_a_conversation_of_many_turns(spark):
    df = spark.range(20_000).selectExpr("1 AS conv_id", "id AS turn", "if(id % 2 = 0, 'user', 'assistant') AS role", "concat('turn ', id) AS text")
    r = chat.chat_digests(df).first()
    said = "".join(f"turn {i}" for i in range(1, 20_000, 2))
    assert (r.n_turns, r.loss_chars, r.loss_sha256, r.valid) == (20_000, len(said), sha(said), True)


# secrets


def test_owners_and_repositories(spark):
    rows = [(i, "x", "password: widelycopied1") for i in range(2)] + [(10 + i, "same", "password: manyrepos11") for i in range(5)] + [(20 + i, "same", "password: fewrepos111") for i in range(4)]
    rows += [(20, "same", "password: fewrepos111"), (30, "y", "password: widelycopied1")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("kind", F.lit("clash")).withColumn("hash", F.lit("clash"))
    got = collections.defaultdict(set)
    for r in secrets.secret_scan(df).collect():
        got[r.doc_id].add((r.n_live, r.n_example))
    assert got[0] == got[30] == got[10] == {(0, 1)} and got[20] == got[23] == {(1, 0)}
    key = "Zk93hfQ0sLw8XbT2vYp6"
    few = spark.createDataFrame([(i, f"r{i % n}", "o", f"see {key} there") for n in (4,) for i in range(6)], "doc_id long, repo string, source string, text string")
    assert {r.spans for r in secrets.secret_scan(few, repo_col="repo").collect()} == {"live:4:24"}
    assert {r.spans for r in secrets.secret_scan(few).collect()} == {""}


# languages


def test_language_columns(spark, docs):
    df = docs.withColumn("lang_pred", F.lit("clash")).withColumn("h", F.lit("clash"))
    rows = langid.language_id(df).collect()
    assert len(rows) == docs.count() and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    langs = {r.lang for r in docs.select("lang").distinct().collect() if r.lang}
    assert {r.lang_pred for r in rows} <= langs | {"und"} and all(0 <= r.score <= 1 for r in rows)
    blind = docs.select("doc_id", "text", F.when(langid.held_out("doc_id"), F.lit("xx")).otherwise(F.col("lang")).alias("lang"), F.lit("s").alias("source"))
    assert sorted(langid.language_id(blind).collect()) == sorted(rows)
    clash = docs.withColumn("_lang_pred", F.lit(1)).withColumn("_LANG_SCORE", F.lit(2))
    known = langid.known_language(clash)
    assert known.columns == clash.columns and known.count() > 0.9 * docs.count()


def test_an_id_that_comes_again_and_again(spark):
    rows = spark.range(20_000).selectExpr("7L AS doc_id", "'the river runs past the old mill' AS text", "'en' AS lang")
    more = spark.createDataFrame([(i, "der fluss fließt an der alten mühle vorbei", "de") for i in range(8, 20)], "doc_id long, text string, lang string")
    model = langid.fit(rows.unionByName(more), 50)
    assert model.languages == ["de", "en"]
