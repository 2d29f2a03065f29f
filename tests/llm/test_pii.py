"""Personal data: the patterns against a plain reading of their rules, the field against all labelings, and what it adds."""

import hashlib
import itertools
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from orespark.llm import pii

DIR = "/root/testdata/sf0.01"


def base(text):
    """kind:start:end of the patterns' matches, by kind, then start."""
    out = []

    def matches(kind, pattern, good):
        out.extend(f"{kind}:{m.start()}:{m.end()}" for m in re.finditer(pattern, text) if good(m.group()))

    def digits(s):
        return [int(c) for c in s if c in "0123456789"]

    def card(s):
        d = digits(s)
        total = sum(d[-1::-2]) + sum(sum(divmod(2 * x, 10)) for x in d[-2::-2])
        return 16 <= len(d) <= 19 and total % 10 == 0

    matches("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True)
    matches("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split(".")))
    matches("card", r"[0-9]([\x20-]?[0-9])+", card)
    matches("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 8 <= len(digits(s)) <= 15)
    return out


HARD = ["", "1.2.3.4.5.6 0256.1.1.1 255.255.255.255", "a@b.c@d.e x@y-z.q. a.b+c@d", "4111-1111-1111-1111 4111 1111 1111 1111 4242424242424242 1", "+1 (212) 555-0123 10.0.0.1 +44 20 7946 0999, +1", "0" * 19 + " " + "0" * 20]


def test_patterns(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    docs = docs.unionByName(spark.createDataFrame([(f"h{i}", t) for i, t in enumerate(HARD)] + [("null", None)], docs.schema))
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    rows = pii.pii_digests(docs).collect()
    assert len(rows) == len(text)
    more = 0
    for r in rows:
        want = base(text[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), text[r.doc_id]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(w.startswith(k) for w in want) for k in pii.KINDS]
        spans = r.spans.split(",") if r.spans else []
        assert set(want) <= set(spans)
        more += len(spans) - len(want)
    assert more >= 4  # two card numbers beside each other, in two documents


def enumerated(field, t, groups):
    """Marginals of the field over all labelings of the nodes and the groups' own nodes."""
    n = len(t.known)
    names = list(dict.fromkeys(k for k in t.keys if k))
    total = np.zeros((n, pii.LABELS))
    half = pii._strength(pii._series(field.equal) ** 0.5)
    rest = pii._strength(min(1.0, pii._series(field.similar) / pii._series(field.equal)) ** 0.5)
    own = np.zeros((n, pii.LABELS))
    own[: len(t.spans)] = t.features @ field.weights
    for labels in itertools.product(range(pii.LABELS), repeat=n + len(names) + len(groups)):
        if any(k >= 0 and k != label for k, label in zip(t.known, labels)):
            continue
        x = sum(own[i, labels[i]] for i in range(n))
        x += sum(field.transitions[labels[i], labels[i + 1]] for i in np.flatnonzero(t.chained))
        x += sum(half for i, k in enumerate(t.keys) if k and labels[i] == labels[n + names.index(k)])
        x += sum(rest for g, members in enumerate(groups) for m in members if labels[n + m] == labels[n + len(names) + g])
        total[np.arange(n), labels[:n]] += np.exp(x)
    return (total / total.sum(1, keepdims=True))[: len(t.spans)]


@pytest.mark.parametrize("text", ["5551234 and 5551234", "call 7 8 now", "+15551234567 or 25551234567"])
def test_beliefs_are_exact_where_there_is_no_loop(text):
    rng = np.random.default_rng(1)
    field = pii.Field(rng.normal(size=(pii.FEATURES, pii.LABELS)), rng.normal(size=(pii.LABELS, pii.LABELS)), 2.0, 1.2)
    t = pii.nodes(text, pii.fixed_spans(text))
    groups = pii.kin(list(dict.fromkeys(k for k in t.keys if k)))
    assert np.allclose(field.beliefs(t), enumerated(field, t, groups), atol=2e-3)


def test_kin():
    assert pii.kin(["15551234567", "25551234567", "5551234567"]) == [(0, 1), (0, 1, 2)]
    assert pii.kin(["bob.stone@x.org", "bob.stome@x.org", "ann@x.org"]) == [(0, 1)]
    assert pii.kin(["7" * 50, "7" * 49 + "8"]) == []


@pytest.fixture(scope="module")
def field(spark):
    return pii.train(spark.read.parquet(f"{DIR}/documents.parquet"))


def added(field, text):
    return [(pii.KINDS[k], text[a:b]) for k, a, b in field.added(text, pii.fixed_spans(text))]


def test_later_mentions_are_found(field):
    alone = "They said that 442079460999 is best, or 02079460999."
    assert added(field, alone) == []
    assert added(field, f"Ring +442079460999 today. {alone}") == [("phone", "442079460999"), ("phone", "02079460999")]
    assert added(field, "First 4111111111111111 then, with a slip, 4111111111111112.") == [("card", "4111111111111112")]
    assert added(field, "First 4111111111111111 then something else, 4999999999999912.") == []
    far = "word " * 5000
    assert added(field, f"Ring +442079460999. {far} Or 442079460999") == [("phone", "442079460999")]


def test_what_the_patterns_run_together(field):
    assert added(field, "ramiar, 4465758382889437 4465758382889437 para") == [("card", "4465758382889437")] * 2
    assert added(field, "éreé. Des +1 (826) 555-4081 190.137.223.204 du") == [("phone", "+1 (826) 555-4081")]


def test_very_long_texts_settle(field):
    text = " ".join(f"{4111111111111111 + k} x{k % 7}@y.org" for k in range(4000)) + " 5" * 4000
    assert isinstance(field.added(text, pii.fixed_spans(text)), list)


def test_one_row_an_id_is_learned_from(spark):
    rows = spark.range(5000).selectExpr("1 AS doc_id", "'mail ann@example.com' AS text").unionByName(spark.createDataFrame([(2, "call +442079460999"), (None, "x")], "doc_id int, text string"))
    assert pii.sampled(rows.where("doc_id is not null").select(F.xxhash64("doc_id")), 10) is not None
    got = pii.train(rows, 10)
    assert np.allclose(got.weights, pii.train(rows.distinct(), 10).weights)


def test_redaction_keeps_columns(spark):
    df = spark.createDataFrame([(1, "mail a.b@c.example now", 5, "k", True), (2, None, None, None, None), (3, "", 0, "", False)], "doc_id long, text string, n_chars int, spans string, known boolean")
    got = {r.doc_id: r for r in pii.redact(df).collect()}
    assert got[1].text == "mail [EMAIL] now" and got[1].n_chars == 16 and got[1].spans == "k" and got[2].text is None and got[3].text == ""
    assert pii.redact(df.drop("n_chars")).columns == ["doc_id", "text", "spans", "known"] and pii.redact(df.where("false")).isEmpty()
