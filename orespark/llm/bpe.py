"""Byte-level BPE encoding and decoding with a lexicon of frequent words.

Words are counted over the whole corpus; the most frequent ones, with the ids that merging gives them, are compiled into a
minimal acyclic transducer (lexicon), which the workers map into memory. All other words are merged exactly.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from dataclasses import dataclass, field
from itertools import chain
from typing import ClassVar

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_texts, give_back, mix64, small_batches, text_slices
from .lexicon import Lexicon, compile_lexicon

#: Entries of the lexicon at most, and bytes of a word in it; a word must stand MIN_COUNT times in the corpus.
MOST_ENTRIES, LONGEST, MIN_COUNT = 1 << 16, 64, 8
#: Words that a worker holds before it passes on their counts.
HELD = 300_000
ID_BITS, ID_MASK, NEVER = 20, (1 << 20) - 1, 1 << 60
#: White space of the word pattern (fixed values: the Unicode property).
WHITE = "\t-\r \u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
OTHER, LETTER, NUMBER, BLANK = range(4)
#: What may follow an apostrophe as one word with it (fixed values).
SHORT = ("s", "t", "re", "ve", "m", "ll", "d")
#: Text that is cut at once.
SLICE = 1 << 19


def byte_letters() -> dict[str, int]:
    """The byte that each letter of the vocabulary stands for: printable ones for themselves, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@dataclass
class Vocabulary:
    """bytes of each id; id of each byte; rank and id, as one number, of each mergeable pair of ids, as one number; special
    strings, which texts may hold."""

    pieces: list[bytes]
    single: list[int]
    pairs: dict[int, int]
    special: dict[str, int] = field(default_factory=dict)

    @staticmethod
    def load(path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        cut, model = spec.get("pre_tokenizer") or {}, spec["model"]
        plain = spec.get("normalizer") is None and cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space") and cut.get("use_regex", True)
        plain &= model.get("type", "BPE") == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        if not plain or any(t.get(k) for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("only byte-level vocabularies that change no text and cut it by the usual word pattern are read")
        letters, ids = byte_letters(), spec["model"]["vocab"]
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        pieces = [b""] * (1 + max([*ids.values(), *special.values()]))
        for text, i in ids.items():
            pieces[i] = bytes(letters[c] for c in text)
        for text, i in special.items():
            pieces[i] = text.encode()
        pairs = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            pairs[ids[a] << ID_BITS | ids[b]] = rank << ID_BITS | ids[a + b]
        return Vocabulary(pieces, [ids[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])], pairs, special)

    def merge(self, word: bytes) -> list[int]:
        """Merge the pair of lowest rank, leftmost first, until none is left."""
        part, get = [self.single[b] for b in word], self.pairs.get
        if len(part) > 64:
            return self._merge_long(part)
        ranks = [get(a << ID_BITS | b, NEVER) for a, b in zip(part, part[1:])]
        while ranks and (best := min(ranks)) != NEVER:
            i = ranks.index(best)
            part[i : i + 2] = [best & ID_MASK]
            del ranks[i]
            if i:
                ranks[i - 1] = get(part[i - 1] << ID_BITS | part[i], NEVER)
            if i < len(ranks):
                ranks[i] = get(part[i] << ID_BITS | part[i + 1], NEVER)
        return part

    def _merge_long(self, part: list) -> list[int]:
        """The same by a heap."""
        n, get = len(part), self.pairs.get
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(found, i) for i in range(n - 1) if (found := get(part[i] << ID_BITS | part[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = right[i]
            if part[i] is None or j < 0 or get(part[i] << ID_BITS | part[j]) != rank:
                continue
            part[i], part[j] = rank & ID_MASK, None
            right[i] = right[j]
            if right[j] >= 0:
                left[right[j]] = i
            for a, b in ((left[i], i), (i, right[i])):
                if a >= 0 and b >= 0 and (found := get(part[a] << ID_BITS | part[b])) is not None:
                    heapq.heappush(heap, (found, a))
        return [p for p in part if p is not None]


def spans(text: str, special: dict[str, int]) -> list[str]:
    """The text cut at special strings, which stand at the odd places."""
    if not special or not any(s in text for s in special):
        return [text]
    return regex.split("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")", text)


def character_classes() -> np.ndarray:
    """The class of each code point in the public word pattern of this kind of vocabulary."""
    every = "".join(chr(c) if not 0xD800 <= c < 0xE000 else " " for c in range(0x110000))
    classes = np.full(0x110000, OTHER, np.uint8)
    for kind, what in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (BLANK, f"[{WHITE}]")):
        for found in regex.finditer(what + "+", every):
            classes[found.start() : found.end()] = kind
    classes[0xD800:0xE000] = OTHER
    return classes


class Words:
    """The words of some texts: ``at`` where each begins in ``joined``, ``count`` how many each text has, ``which`` of the
    distinct ones, ``distinct``, each is.

    A word is a run of letters, of numbers or of other characters, with a space before it if there is one; an apostrophe
    with a short ending; or white space, without its last character if something follows, which is a word of its own then.
    """

    def __init__(self, texts: list[str], classes: np.ndarray):
        self.joined = "".join(texts)
        cp = np.frombuffer(self.joined.encode("utf-32-le", "surrogatepass"), "<u4")
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        n, ends = len(cp), np.cumsum(lengths)
        if not n:
            self.at, self.count, self.which, self.distinct = np.zeros(0, np.int64), lengths, np.zeros(0, np.int64), []
            return
        kind, opens = classes[cp], np.zeros(n + 1, bool)
        opens[(ends - lengths)] = True
        opens[n] = True
        begin = opens.copy()
        begin[1:n] |= kind[1:] != kind[:-1]
        edge = np.flatnonzero(begin)
        first, stop = edge[:-1], edge[1:]
        inner = (kind[first] == BLANK) & ~opens[stop]  # white space with something after it
        first, stop = first[inner], stop[inner]
        spaced = cp[stop - 1] == 32
        begin[stop - 1] = True
        begin[stop[spaced]] = False
        quotes = np.flatnonzero((cp == 39) & begin[:n])
        quotes = quotes[(quotes + 1 < n) & ~opens[np.minimum(quotes + 1, n)]]
        for q in quotes[kind[quotes + 1] == LETTER].tolist():
            rest = self.joined[q + 1 : q + 3]
            size = next((len(s) for s in SHORT if rest.startswith(s)), 0)
            if size == 2 and opens[q + 2]:
                size = 0
            if size:
                begin[q + 1] = False
                begin[q + 1 + size] = True
        begin[n] = True
        edge = np.flatnonzero(begin)
        self.at, size = edge[:-1], np.diff(edge)
        self.count = np.diff(np.searchsorted(self.at, np.concatenate(([0], ends))))
        self._name(cp, size)

    POWERS: ClassVar[dict] = {}

    @classmethod
    def _powers(cls, base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The first n powers of base, and of its inverse."""
        if base not in cls.POWERS or len(cls.POWERS[base][0]) < n:
            both = tuple(np.full(n, b, np.uint64) for b in (base, pow(base, -1, 1 << 64)))
            for p in both:
                p[0] = 1
                np.multiply.accumulate(p, out=p)
            cls.POWERS[base] = both
        return tuple(p[:n] for p in cls.POWERS[base])

    def _name(self, cp: np.ndarray, size: np.ndarray) -> None:
        """Number the distinct words, by hashes that are then proved right."""
        n, at = len(cp), self.at
        value = mix64(cp)
        for base in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F):
            power, undo = self._powers(base, n)
            total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(value * power, dtype=np.uint64)))
            key = (total[at + size] - total[at]) * undo[at] + size.astype(np.uint64) * np.uint64(0xE7037ED1A0B428DB)
            _, first, which = np.unique(key, return_index=True, return_inverse=True)
            same = np.repeat(at[first[which]] - at, size) + np.arange(n)
            if (size[first[which]] == size).all() and (cp[same] == cp).all():
                break
        else:
            raise AssertionError("three hashes gave different words one number")
        self.which = which
        self.distinct = [self.joined[a : a + k].encode() for a, k in zip(at[first].tolist(), size[first].tolist())]


class PairTable:
    """The mergeable pairs as a hash table in arrays, to look up many at once."""

    def __init__(self, pairs: dict[int, int]):
        self.size = 1 << max(4, (4 * len(pairs)).bit_length())
        self.keys = np.full(self.size, -1, np.int64)
        self.values = np.full(self.size, NEVER, np.int64)
        keys, values = (np.fromiter(x, np.int64, len(pairs)) for x in (pairs.keys(), pairs.values()))
        place = self.place(keys)
        while len(keys):  # those that find their place taken go on to the next
            free = self.keys[place] < 0
            self.keys[place[free]] = keys[free]
            settled = self.keys[place] == keys
            self.values[place[settled]] = values[settled]
            keys, values, place = keys[~settled], values[~settled], (place[~settled] + 1) & (self.size - 1)

    def place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) & (self.size - 1)

    def get(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = (a << ID_BITS) | b
        place = self.place(keys)
        out, left = self.values[place], np.flatnonzero((self.keys[place] != keys) & (self.keys[place] >= 0))
        out[self.keys[place] != keys] = NEVER
        while len(left):
            place[left] = (place[left] + 1) & (self.size - 1)
            at = self.keys[place[left]]
            hit = at == keys[left]
            out[left[hit]] = self.values[place[left[hit]]]
            left = left[~hit & (at >= 0)]
        return out


def merge_many(words: list[bytes], single: np.ndarray, table: PairTable) -> tuple[np.ndarray, np.ndarray]:
    """Ids of many words, one after the other, and how many each has: in each round every word merges its best pair, leftmost first, until none has any."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    symbol = single[np.frombuffer(b"".join(words), np.uint8)]
    n, ends = len(symbol), np.cumsum(lengths)
    after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
    after[ends - 1], before[ends - lengths] = -1, -1
    best = np.full(n, NEVER, np.int64)
    inner = np.flatnonzero(after >= 0)
    best[inner] = table.get(symbol[inner], symbol[inner + 1])
    left = np.arange(n)  # places of words that still merge
    word = np.repeat(np.arange(len(words)), lengths)
    while len(left):
        first = np.flatnonzero(np.diff(word[left], prepend=-1))
        least = np.repeat(np.minimum.reduceat(best[left], first), np.diff(np.append(first, len(left))))
        left, least = left[least != NEVER], least[least != NEVER]
        at = left[best[left] == least]
        if not len(at):
            break
        at = at[np.diff(word[at], prepend=-1) != 0]
        gone = after[at]
        symbol[at] = best[at] & ID_MASK
        symbol[gone], best[gone], best[at] = -1, NEVER, NEVER
        follow = after[gone]
        after[at] = follow
        has = follow >= 0
        before[follow[has]] = at[has]
        best[at[has]] = table.get(symbol[at[has]], symbol[follow[has]])
        prior = before[at]
        has = prior >= 0
        best[prior[has]] = table.get(symbol[prior[has]], symbol[at[has]])
        left = left[symbol[left] >= 0]
    kept = symbol >= 0
    return symbol[kept], np.add.reduceat(kept, ends - lengths) if n else np.zeros(0, np.int64)


class Encoder:
    """Ids of texts. The ids of words are kept while there are at most MOST, for they come again and again."""

    MOST = 200_000

    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon, classes: np.ndarray):
        self.vocabulary, self.lexicon, self.classes = vocabulary, lexicon, classes
        self.single, self.table = np.array(vocabulary.single, np.int64), PairTable(vocabulary.pairs)
        self.reset()

    def reset(self) -> None:
        self.known: dict[bytes, int] = {}
        self.ids, self.at, self.size = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def learn(self, words: list[bytes]) -> None:
        """Words that the lexicon holds get its ids; the others are merged, all at once."""
        inside = self.lexicon.holds(words)
        found = [w for w, yes in zip(words, inside) if yes]
        rest = [w for w, yes in zip(words, inside) if not yes and len(w) <= 64]
        long = [w for w, yes in zip(words, inside) if not yes and len(w) > 64]
        listed = [self.lexicon.get(w) for w in found] + [self.vocabulary.merge(w) for w in long]
        merged, sizes = merge_many(rest, self.single, self.table)
        sizes = np.concatenate((np.fromiter(map(len, listed), np.int64, len(listed)), sizes))
        flat = np.concatenate((np.fromiter(chain.from_iterable(listed), np.int32), merged.astype(np.int32)))
        self.known.update(zip(found + long + rest, range(len(self.size), len(self.size) + len(sizes))))
        self.at = np.concatenate((self.at, len(self.ids) + np.cumsum(sizes) - sizes))
        self.ids, self.size = np.concatenate((self.ids, flat)), np.concatenate((self.size, sizes))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        special = self.vocabulary.special
        cut = [spans(t, special) for t in texts]
        words = Words([s for parts in cut for s in parts[::2]], self.classes)
        if len(self.known) > self.MOST:
            self.reset()
        if new := [w for w in words.distinct if w not in self.known]:
            self.learn(new)
        word = np.fromiter(map(self.known.__getitem__, words.distinct), np.int64, len(words.distinct))[words.which]
        size, stops = self.size[word], np.cumsum(self.size[word])
        flat = self.ids[np.repeat(self.at[word] - (stops - size), size) + np.arange(stops[-1] if len(stops) else 0)]
        ends = np.concatenate(([0], stops))[np.cumsum(words.count)].tolist()
        parts_of = iter(np.split(flat, ends[:-1]) if ends else [])
        out = []
        for parts in cut:
            got = [next(parts_of) if i % 2 == 0 else np.array([special[s]], np.int32) for i, s in enumerate(parts)]
            out.append(got[0] if len(got) == 1 else np.concatenate(got))
        return out


def word_counts(docs: DataFrame, special: dict[str, int]) -> DataFrame:
    """word, count over all of docs (text)."""
    sent = docs.sparkSession.sparkContext.broadcast(character_classes())

    def run(batches):
        held: dict[bytes, int] = {}

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()), pa.array(held.values(), pa.int64())], names=["word", "n"])
            held.clear()
            return out

        for batch in text_slices(batches, limit=SLICE):
            words = Words([s for t in as_texts(batch.column("text")) for s in spans(t, special)[::2]], sent.value)
            for w, n in zip(words.distinct, np.bincount(words.which, minlength=len(words.distinct)).tolist()):
                held[w] = held.get(w, 0) + n
            if len(held) > HELD:
                yield flush()
        yield flush()
        give_back()

    return docs.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("count"))


def build_lexicon(docs: DataFrame, vocabulary: Vocabulary, entries: int = MOST_ENTRIES) -> bytes:
    """The compiled lexicon of the most frequent words; ``entries`` bounds what reaches the driver."""
    counts = word_counts(docs, vocabulary.special).where((F.col("count") >= MIN_COUNT) & (F.length("word") <= LONGEST))
    top = counts.orderBy(F.desc("count"), "word").limit(entries).select("word").toArrow()
    words = sorted(top.column("word").to_pylist())
    return compile_lexicon([(w, tuple(vocabulary.merge(w))) for w in words])


def bpe_encode(docs: DataFrame, vocabulary_file: str, *, id_col: str = "doc_id", text_col: str = "text", entries: int = MOST_ENTRIES, decode: bool = True) -> DataFrame:
    """doc_id, ids (array of int) and, with ``decode``, decoded (text of these ids) for each row.

    Ids and texts are those of the vocabulary's library: a special string inside a text is its token; null texts count as
    empty and have no ids. Rows are independent; repeated rows and null ids stay. An empty table gives an empty result.
    Other columns are not read.
    """
    return _encode(docs, vocabulary_file, id_col, text_col, entries, "ids array<int>, decoded string" if decode else "ids array<int>")


def bpe_digests(docs: DataFrame, vocabulary_file: str, *, id_col: str = "doc_id", text_col: str = "text", entries: int = MOST_ENTRIES) -> DataFrame:
    """The same as doc_id, n_tokens, ids_sha256 (of the ids joined by commas), decoded_sha256."""
    return _encode(docs, vocabulary_file, id_col, text_col, entries, "n_tokens long, ids_sha256 string, decoded_sha256 string")


def _encode(docs, vocabulary_file, id_col, text_col, entries, returned):
    small_batches(docs.sparkSession)
    vocabulary = Vocabulary.load(vocabulary_file)
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    blob = build_lexicon(docs, vocabulary, entries)
    sent = docs.sparkSession.sparkContext.broadcast({"lexicon": blob, "classes": character_classes(), "vocabulary": (vocabulary.pieces, vocabulary.single, vocabulary.pairs, vocabulary.special)})
    digests, decode = "ids_sha256" in returned, "decoded" in returned

    def run(batches):
        kept = sent.value  # a worker keeps it, and what is made from it, for its later tasks
        if "encoder" not in kept:
            kept["encoder"] = Encoder(Vocabulary(*kept["vocabulary"]), Lexicon(kept["lexicon"]), kept["classes"])
        encoder: Encoder = kept["encoder"]
        pieces = encoder.vocabulary.pieces
        names = [str(i) for i in range(len(pieces))] if digests else []
        for batch in text_slices(batches, limit=SLICE):
            ids, n, hashed, back = [], [], [], []
            for got in encoder.encode(as_texts(batch.column("text"))):
                if not digests:
                    ids.append(got)
                if decode:
                    listed = got.tolist()
                    text = b"".join(map(pieces.__getitem__, listed)).decode("utf-8", "replace")
                    back.append(hashlib.sha256(text.encode()).hexdigest() if digests else text)
                if digests:
                    n.append(len(listed))
                    hashed.append(hashlib.sha256(",".join(map(names.__getitem__, listed)).encode()).hexdigest())
            columns = [pa.array(n, pa.int64()), pa.array(hashed, pa.string())] if digests else [pa.array(ids, pa.list_(pa.int32()))]
            columns += [pa.array(back, pa.string())] if decode else []
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=["doc_id", *(c.split()[0] for c in returned.split(", "))])
        give_back()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, {returned}")
