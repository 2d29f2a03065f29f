"""Personal data: fixed patterns, and a skip-chain conditional random field that carries their labels to other mentions.

The field's nodes are the tokens (between white space) that hold a digit or an @, and the patterns' matches of several tokens.
Neighbouring tokens share a transition potential. Nodes with equal keys (their digits, if seven or more; else their lower-case
letters, if there is an @) share a potential that rewards equal labels, however far apart they stand, and so do, by a weaker
one, nodes with similar keys: one character differs, or the last seven digits are the same. Each group is a star around a node
of its own, so what comes again and again costs a link each time, not one for each pair. Tokens inside a match of a fixed
pattern are known; messages go round until they settle, and unknown tokens that then are surely personal data are added.

Weights are learned together by pseudo-likelihood from a bounded sample with the patterns' labels: each token given those of its
neighbours and kin, once as it is, once with its own looks hidden, so that the field learns what mentions tell of each other, and
once without the labels around it, so that it learns what looks tell.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import as_texts, sampled, small_batches, text_slices

KINDS = ("email", "ip", "card", "phone")
NONE = len(KINDS)
LABELS = NONE + 1
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile("[0-9]")
TOKEN = re.compile(r"(?<![^\x20\x09-\x0D])(?=[^\x20\x09-\x0D]*[0-9@])[^\x20\x09-\x0D]+")
NOT_DIGIT = re.compile("[^0-9]+")
EDGES = ".,;:!?\"'()[]{}<>*#$%&|"
#: Documents that the field is learned from at most, and tokens of each, chosen by hash (the bounds of the training sample).
SAMPLE, SAMPLE_TOKENS = 4000, 50
#: Strength of the potentials of equal and of similar keys before anything is learned, and for how many tokens that counts.
PRIOR, PRIOR_TOKENS = (9.0, 7.0), 20
#: Pull of a token's weights to 0.
L2 = 1e-3
#: Part of a message that stays from the round before, the change under which messages have settled, and the belief from which
#: a token is added.
DAMPING, SETTLED, SURE = 0.3, 1e-4, 0.9
#: Rounds after which beliefs that take turns are taken as they are.
MOST_ROUNDS = 1000
#: Last digits that make keys similar, and characters of a key from which on only equal ones count.
SUFFIX, LONG_KEY = 7, 40


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def octets(ip: str) -> bool:
    return all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in ip.split("."))


def fixed_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind, then start: leftmost matches that don't overlap within a kind, without failing ones."""
    out = []
    if "@" in text:
        out += [(0, m.start(), m.end()) for m in EMAIL.finditer(text)]
    if DIGIT.search(text):
        if "." in text:
            out += [(1, m.start(), m.end()) for m in IP.finditer(text) if octets(m[0])]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 16 and 16 <= len(d := NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d):
                out.append((2, m.start(), m.end()))
        if "+" in text:
            out += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= len(NOT_DIGIT.sub("", m[0])) <= 15]
    return out


def key_of(token: str) -> str:
    """What makes mentions equal."""
    core = token.strip(EDGES)
    digits = NOT_DIGIT.sub("", token)
    return core.lower() if "@" in core else digits if len(digits) >= 7 else ""


def looks(token: str, before: str) -> list[bool]:
    """The features of a token and the one before it; the last is for training, of a token whose looks are hidden."""
    core, n = token.strip(EDGES), len(digits := NOT_DIGIT.sub("", token))
    return [
        True, "@" in token, n == 0, 0 < n < 4, 4 <= n < 7, 7 <= n < 10, 10 <= n < 16, 16 <= n < 20, n >= 20, core.count(".") == 3, "-" in core, token.startswith("+"),
        "(" in token, any(c.isalpha() for c in core), core.isdigit(), ":" in token or "=" in token, before.startswith("+"), before.startswith("("), "." in core, "/" in token, len(token) > 24,
        EMAIL.fullmatch(core) is not None, IP.fullmatch(core) is not None and octets(core), 16 <= n < 20 and core.replace("-", "") == digits and luhn(digits), False,
    ]


FEATURES = len(looks("", ""))
#: Features of tokens that are an address or number by themselves.
WHOLE = slice(FEATURES - 4, FEATURES - 1)


@dataclass
class Tokens:
    """The tokens of a text: where they stand, their features, which follow each other; then known labels (-1: none) and keys of
    the tokens and, after them, of the matches that hold several."""

    spans: list[tuple[int, int]]
    features: np.ndarray
    chained: np.ndarray
    known: np.ndarray
    keys: list[str]


def nodes(text: str, fixed: list[tuple[int, int, int]]) -> Tokens | None:
    spans = [m.span() for m in TOKEN.finditer(text)] if "@" in text or DIGIT.search(text) else []
    if not spans:
        return None
    features, keys, known = np.zeros((len(spans), FEATURES), np.float32), [], np.full(len(spans), -1)
    ordered, k, several, last = sorted((a, b, kind) for kind, a, b in fixed), 0, [], None
    for i, (a, b) in enumerate(spans):
        before = text[max(0, a - 12) : a].split()
        features[i] = looks(text[a:b], before[-1] if before else "")
        keys.append(key_of(text[a:b]))
        while k < len(ordered) and ordered[k][1] <= a:
            k += 1
        for m in ordered[k:]:
            if m[0] >= b:
                break
            if m[1] > a:
                known[i] = m[2]
                if m == last and (not several or several[-1] != m):
                    several.append(m)
                last = m
                break
    chained = np.array([not text[p[1] : q[0]].strip() for p, q in zip(spans, spans[1:])], bool)
    return Tokens(spans, features, chained, np.append(known, [m[2] for m in several]).astype(np.int64), keys + [key_of(text[a:b]) for a, b, _ in several])


def kin(keys: list[str]) -> list[tuple[int, ...]]:
    """Groups of different keys that are similar to each other."""
    groups: set[tuple[int, ...]] = set()

    def group(names):
        held: dict = {}
        for name, i in names:
            held.setdefault(name, []).append(i)
        groups.update(tuple(g) for g in held.values() if len(g) > 1)

    short = [(k, i) for i, k in enumerate(keys) if len(k) <= LONG_KEY]
    for at in range(max((len(k) for k, _ in short), default=0)):
        group(((k[:at], k[at + 1 :]), i) for k, i in short if len(k) > at)
    group((k[-SUFFIX:], i) for k, i in short if k.isdigit())
    return sorted(groups)


def _series(strength: float) -> float:
    """How much of an equal label passes a potential: what stands one after the other multiplies."""
    e = np.exp(min(strength, 30.0))
    return (e - 1) / (e + LABELS - 1)


def _strength(passed: float) -> float:
    passed = min(passed, 1 - 1e-9)
    return float(np.log((1 + (LABELS - 1) * passed) / (1 - passed)))


@dataclass
class Field:
    """Log potentials: of a token's features and label, of two neighbours' labels, and of equal labels of two nodes with equal and
    with similar keys."""

    weights: np.ndarray
    transitions: np.ndarray
    equal: float
    similar: float

    def beliefs(self, t: Tokens) -> np.ndarray:
        """Probability of each label of each token, by loopy messages."""
        n = len(t.spans)
        own = np.zeros((len(t.known), LABELS))
        own[:n] = t.features @ self.weights
        own -= own.max(1, keepdims=True)
        fixed = t.known >= 0
        own[fixed] = -30.0
        own[fixed, t.known[fixed]] = 0.0
        names = {k: i for i, k in enumerate(dict.fromkeys(k for k in t.keys if k))}
        member = np.array([i for i, k in enumerate(t.keys) if k], np.int64)
        # edges of one kind after the other: (nodes, nodes, potential); a group's node follows those of the text
        link = np.flatnonzero(t.chained)
        hub = len(own) + np.array([names[t.keys[i]] for i in member], np.int64)
        groups = kin(list(names)) if len(names) > 1 else []
        inner = np.array([i for g in groups for i in g], np.int64) + len(own)
        outer = np.repeat(np.arange(len(groups)), [len(g) for g in groups]).astype(np.int64) + len(own) + len(names)
        own = np.concatenate((own, np.zeros((len(names) + len(groups), LABELS))))
        passed = _series(self.equal)
        half = _strength(passed**0.5) * np.eye(LABELS)
        rest = _strength(min(1.0, _series(self.similar) / max(passed, 1e-9)) ** 0.5) * np.eye(LABELS)
        edges = [(x, y, p) for x, y, p in ((link, link + 1, self.transitions), (member, hub, half), (inner, outer, rest)) if len(x)]
        messages = [(np.zeros((len(x), LABELS)), np.zeros((len(x), LABELS))) for x, _, _ in edges]

        def through(x, potential):
            m = np.logaddexp.reduce(x[:, :, None] + potential[None], axis=1)
            return m - m.max(1, keepdims=True)

        for _ in range(MOST_ROUNDS if edges else 0):
            b, change = _total(own, edges, messages), 0.0
            for k, (x, y, potential) in enumerate(edges):
                old = messages[k]
                new = through(b[x] - old[1], potential), through(b[y] - old[0], potential.T)
                messages[k] = tuple(DAMPING * m + (1 - DAMPING) * now for m, now in zip(old, new))
                change = max(change, *(float(np.abs(now - m).max()) for m, now in zip(old, messages[k])))
            if change < SETTLED:
                break
        b = _total(own, edges, messages)[:n]
        p = np.exp(b - b.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)

    def added(self, text: str, fixed: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """Spans that the patterns don't cover: unknown tokens, without punctuation around them, surely of a kind;
        neighbours of one kind are one span, unless one is whole by itself."""
        t = nodes(text, fixed)
        if t is None or (t.known >= 0).all():
            return []
        p, known = self.beliefs(t), t.known[: len(t.spans)]
        label = np.where((known < 0) & (p.argmax(1) != NONE) & (p.max(1) >= SURE), p.argmax(1), -1)
        out: list[tuple[int, int, int]] = []
        for i in np.flatnonzero(label >= 0).tolist():
            a, b = t.spans[i]
            core = text[a:b].strip(EDGES)
            a += text[a:b].find(core) if core else 0
            b = a + len(core)
            if not core:
                continue
            goes_on = i and t.chained[i - 1] and label[i - 1] == label[i] and not t.features[i - 1 : i + 1, WHOLE].any()
            if goes_on and out and t.spans[i - 1][0] < out[-1][2] <= t.spans[i - 1][1]:
                out[-1] = (out[-1][0], out[-1][1], b)
            else:
                out.append((int(label[i]), a, b))
        return out


def _total(own, edges, messages) -> np.ndarray:
    """The log beliefs: what each node has of its own and what its edges bring. messages: to the second end, to the first."""
    b = own.copy()
    for (x, y, _), (there, back) in zip(edges, messages):
        np.add.at(b, y, there)
        np.add.at(b, x, back)
    return b


def examples(text: str, most: int) -> np.ndarray:
    """For ``most`` tokens of a text, chosen by hash: features; whether the label before, after, of an equal and of a similar
    mention is each of the labels; and the own label, all as bytes."""
    t = nodes(text, fixed_spans(text))
    if t is None:
        return np.zeros((0, FEATURES + 4 * LABELS + 1), np.uint8)
    n, label = len(t.spans), np.where(t.known < 0, NONE, t.known)
    around, onehot = np.zeros((4, n, LABELS), np.uint8), np.eye(LABELS, dtype=np.int64)[label]
    at = np.flatnonzero(t.chained)
    around[0, at + 1], around[1, at] = onehot[at], onehot[at + 1]
    names = {k: i for i, k in enumerate(dict.fromkeys(k for k in t.keys if k))}
    own = np.array([names.get(k, -1) for k in t.keys], np.int64)
    held = np.zeros((len(names) + 1, LABELS), np.int64)
    np.add.at(held, own[own >= 0], onehot[own >= 0])
    near = np.zeros_like(held)
    for g in kin(list(names)):
        every = held[list(g)].sum(0)
        for i in g:
            near[i] += every - held[i]
    keyed = own[:n] >= 0
    around[2, keyed] = held[own[:n][keyed]] - onehot[:n][keyed] > 0
    around[3, keyed] = near[own[:n][keyed]] > 0
    pick = np.array(sorted(range(n), key=lambda i: (zlib.crc32(b"%d" % i), i))[:most], np.int64)
    return np.concatenate((t.features[pick].astype(np.uint8), *around[:, pick], label[:n, None][pick].astype(np.uint8)), axis=1)


def learn(rows: np.ndarray) -> Field:
    """The field of most pseudo-likelihood of the examples, of the same with hidden looks, and with hidden labels around."""
    hidden, alone = rows.copy(), rows.copy()
    hidden[:, :FEATURES] = 0
    hidden[:, FEATURES - 1] = 1
    alone[:, FEATURES:-1] = 0
    rows = np.concatenate((rows, hidden, alone)).astype(np.float64)
    x, (before, after, equal, similar), y = rows[:, :FEATURES], np.split(rows[:, FEATURES:-1], 4, axis=1), np.eye(LABELS)[rows[:, -1].astype(int)]
    weights, transitions, strength, n = np.zeros((FEATURES, LABELS)), np.zeros((LABELS, LABELS)), np.array(PRIOR), max(1, len(rows))
    for _ in range(400 if len(rows) else 0):
        logit = x @ weights + before @ transitions + after @ transitions.T + strength[0] * equal + strength[1] * similar
        e = np.exp(logit - logit.max(1, keepdims=True))
        off = e / e.sum(1, keepdims=True) - y
        weights -= 2.0 * (x.T @ off / n + L2 * weights)
        transitions -= 2.0 * ((before.T @ off + off.T @ after) / n + 1e-3 * transitions)
        told = np.array([(off * equal).sum(), (off * similar).sum()])
        strength = np.maximum(0.0, strength - 2.0 * (told + PRIOR_TOKENS * 1e-2 * (strength - PRIOR)) / n)
    return Field(weights, transitions, float(strength[0]), float(min(strength)))


def train(docs: DataFrame, sample: int = SAMPLE, *, id_col: str = "doc_id", text_col: str = "text") -> Field:
    """Learn a field from at most ``sample`` documents, those whose ids have the lowest hashes, and SAMPLE_TOKENS tokens of
    each; of rows that share an id, one. Ids may be of any type; rows without one are not learned from. Without examples only
    own labels of known tokens, and the prior strength between mentions, are left."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.xxhash64(id_col).alias("h"), F.col(text_col).cast("string").alias("text")).where(F.col(id_col).isNotNull())
    cut = sampled(docs.select("h"), sample)

    def run(batches):
        for batch in text_slices(batches):
            blobs = [examples(t, SAMPLE_TOKENS).tobytes() for t in as_texts(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("h"), pa.array(blobs, pa.binary())], names=["h", "rows"])

    rows = docs.where(F.col("h") <= cut).mapInArrow(run, "h long, rows binary").groupBy("h").agg(F.min("rows").alias("rows")).orderBy("h").collect() if cut is not None else []
    return learn(np.frombuffer(b"".join(r.rows for r in rows), np.uint8).reshape(-1, FEATURES + 4 * LABELS + 1))


def pii_spans(docs: DataFrame, field: Field, *, id_col: str = "doc_id", text_col: str = "text", keep: list[str] = ()) -> DataFrame:
    """doc_id, the columns of ``keep``, and spans: array of (kind, start, end, fixed), by kind then start, in code points with
    the end exclusive; fixed tells spans of the patterns from those of the field. Null texts have none."""
    sent = docs.sparkSession.sparkContext.broadcast((field.weights, field.transitions, field.equal, field.similar))
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("fixed", pa.bool_())])
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), *keep)

    def run(batches):
        field = Field(*sent.value)
        for batch in text_slices(batches):
            found = []
            for text in as_texts(batch.column("text")):
                fixed = fixed_spans(text)
                every = [(k, a, b, True) for k, a, b in fixed] + [(k, a, b, False) for k, a, b in field.added(text, fixed)]
                found.append([{"kind": KINDS[k], "start": a, "end": b, "fixed": f} for k, a, b, f in sorted(every)])
            columns = [c for i, c in enumerate(batch.columns) if batch.schema.names[i] != "text"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(found, pa.list_(span))], names=[n for n in batch.schema.names if n != "text"] + ["spans"])

    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text")
    return docs.mapInArrow(run, f"{columns}, spans array<struct<kind:string,start:bigint,end:bigint,fixed:boolean>>")


def pii_digests(docs: DataFrame, *, sample: int = SAMPLE) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans for each row of docs (doc_id, text). Ids may be of any type.

    The counts and the digest are of the patterns' spans (kind:start:end by kind, then start, joined by commas); spans has
    all. Null and empty texts have none; repeated rows and null ids stay; an empty table gives an empty result. Other
    columns are not read.
    """
    docs = docs.select("doc_id", "text")
    found = pii_spans(docs, train(docs, sample))
    fixed = F.filter("spans", lambda s: s["fixed"])

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["fixed"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(fixed), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, *, sample: int = SAMPLE) -> DataFrame:
    """docs (doc_id, text, n_chars and any other columns) with each span replaced by its kind in brackets, and n_chars of the
    new text, if there is such a column. Overlapping spans are replaced as one, by the first one's kind. Null texts stay null,
    empty ones empty; repeated rows and null ids stay; an empty table gives an empty result."""
    field = train(docs, sample)
    sent = docs.sparkSession.sparkContext.broadcast((field.weights, field.transitions, field.equal, field.similar))
    names, size = docs.columns, "n_chars" in docs.columns
    at = names.index("text")

    def run(batches):
        field = Field(*sent.value)
        for batch in text_slices(batches):
            out = []
            for text in batch.column("text").to_pylist():
                if text:
                    fixed = fixed_spans(text)
                    parts, end = [], 0
                    for a, b, k in sorted((a, b, k) for k, a, b in fixed + field.added(text, fixed)):
                        if a >= end:
                            parts += [text[end:a], f"[{KINDS[k].upper()}]"]
                        end = max(end, b)
                    text = "".join(parts) + text[end:] if parts else text
                out.append(text)
            columns = list(batch.columns)
            columns[at] = pa.array(out, pa.string())
            if size:
                columns[names.index("n_chars")] = pa.array([None if t is None else len(t) for t in out], pa.int64())
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(run, StructType([StructField(f.name, LongType() if f.name == "n_chars" else f.dataType) for f in docs.schema]))
