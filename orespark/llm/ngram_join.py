"""N-gram Jaccard join by token-combination prefixes.

A document's tokens are its five-word shingles. Tokens stand in one global order: rare ones first, then frequent ones by
how frequent they are, each class by hash. Of a set of n tokens at most e = n - ceil(0.8 n) may miss in a partner, so a
prefix of e + 1 rare tokens must share one with the partner's prefix. Where rare tokens don't suffice, the prefix goes on
into the frequent ones, which are dealt into sub-classes; a sub-class with c tokens in the prefix counts c - 1 towards
e + 1, and pairs of its tokens are indexed instead of single tokens. The argument holds for any class of a token, so the
classes may come from a Bloom filter, and for each band of sizes (powers of 5/4) apart, so the number of sub-classes may
follow the size: partners stand in the same or the next band.

Nodes are different sets, named by the number of one row that has it, so copies are one node whatever their ids. Candidates of a
signature are not expanded into pairs: a first round verifies each member against one hub, and a second one only members of
different components. A signature that too many such members share goes a round deeper: its members are indexed anew, in the
order of how many of just them hold a token, so that what they all have in common comes last. Keys that many rows share
(copies of one text, members of one signature, links of one hub) are spread over several tasks.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPREAD_ROWS, Bloom, Held, Seen, as_bytes, bloom, fresh, heavy_keys, integer_id, materialize, mix64, salted_join, settle, small_batches, text_slices
from .graph import components
from .shingles import PERCENT, WordHashes, pack, shingle_sets, unpack

#: Texts that share a token from which on it counts as frequent, and as very frequent (a later place in the order). If more
#: than MOST_FREQUENT tokens reach it, it is doubled until they don't: the filter that is sent out keeps its size.
FREQUENT, VERY, MOST_FREQUENT = 32, 16, 1 << 21
#: Pairs of members of different components that a signature may have before its members are indexed anew.
WORK = 1 << 16
#: Pairs of one node from which on they are spread over several tasks.
HUB_LINKS = 256
#: Tokens that a worker gathers before it passes them on.
FLUSH = 1 << 20
#: Sub-classes of frequent tokens, as a part of a set's size; sets under SMALL tokens index single ones.
SPREAD, SMALL = 0.1, 16
#: Smallest size of each band.
BANDS = np.array([-(-(5**j) // 4**j) for j in range(120)], dtype=object)
BAND_FROM = np.array([min(int(b), 1 << 62) for b in BANDS], np.int64)


def token_sets(docs: DataFrame) -> DataFrame:
    """row (a number of its own), doc_id, n_shingles, the two halves of a 128-bit digest of the set (h1, h2; null if it is
    empty), and the set, as tokens. That is null in rows without an id, and where the partition had the same set before."""

    def run(batches):
        hashes, seen, row = WordHashes(), Seen(), TaskContext.get().partitionId() << 36
        for batch in text_slices(batches):
            sets = shingle_sets(as_bytes(batch.column("text")), hashes)
            digests = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            halves = [np.frombuffer(d, np.int64).tolist() if d else (None, None) for d in digests]
            named = batch.column("doc_id").is_valid().to_pylist()
            tokens = [s.tobytes() if ok and d and seen.is_new(d) else None for s, d, ok in zip(sets, digests, named)]
            columns = [
                pa.array(range(row, row + len(sets)), pa.int64()), batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()),
                pa.array([h[0] for h in halves], pa.int64()), pa.array([h[1] for h in halves], pa.int64()), pa.array(tokens, pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "doc_id", "n_shingles", "h1", "h2", "tokens"])
            row += len(sets)

    return docs.mapInArrow(run, "row long, doc_id long, n_shingles long, h1 long, h2 long, tokens binary")


def _sets(batches, wanted: tuple):
    """(node, set) of the rows (row, tokens) that a filter lets through. A row too many does no harm: it is one more node."""
    wanted = Bloom(*wanted)
    for batch in batches:
        rows = batch.column("row").to_numpy()
        some = np.flatnonzero(wanted.has(rows.view(np.uint64)))
        for i, x in zip(rows[some].tolist(), batch.column("tokens").take(pa.array(some))):
            yield i, np.frombuffer(x.as_buffer(), np.uint64)


def _blobs(schema: list[str], rows: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=schema)


def frequent_tokens(sets: DataFrame, nodes, total: int, frequent: int, buckets: int, most: int) -> tuple[Bloom, Bloom, int]:
    """Filters of the frequent and of the very frequent tokens, and the bits of a token that count for them. sets: row, tokens;
    nodes: a broadcast filter of the rows that count."""
    bits = min(60, max(32, int(total).bit_length() + 4))
    drop = np.uint64(64 - bits)

    def count(batches):
        held, size = [], 0
        def flush():
            values, counts = np.unique(np.concatenate(held) >> drop, return_counts=True)
            cuts = np.searchsorted(values, (np.arange(1, buckets, dtype=np.uint64) * np.uint64((1 << bits) // buckets)))
            rows = [[b, pack(v, c)] for b, (v, c) in enumerate(zip(np.split(values, cuts), np.split(counts, cuts))) if len(v)]
            return _blobs(["bucket", "part"], rows)

        for _, tokens in _sets(batches, nodes.value):
            held.append(tokens)
            size += len(tokens)
            if size >= FLUSH:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    def add(got: pa.Table) -> pa.Table:
        parts = [unpack(x.as_py(), 2) for x in got.column("part")]
        values = np.concatenate([p[0] for p in parts])
        order = np.argsort(values, kind="stable")
        values, counts = values[order], np.concatenate([p[1] for p in parts])[order]
        first = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))
        df = np.add.reduceat(counts, first)
        keep = df >= frequent
        return pa.table({"token": pa.array(values[first][keep].view(np.int64), pa.int64()), "df": pa.array(df[keep].astype(np.int64), pa.int64())})

    tokens = settle(sets.mapInArrow(count, "bucket int, part binary").groupBy("bucket").applyInArrow(add, "token long, df long"), "frequent")
    least, by = frequent, {r.level: r["count"] for r in tokens.groupBy(F.floor(F.log2(F.col("df") / frequent)).cast("int").alias("level")).count().collect()}
    while sum(n for level, n in by.items() if frequent << level >= least) > most:
        least *= 2
    kept = sum(n for level, n in by.items() if frequent << level >= least)
    usual = tokens.where(F.col("df") >= least)
    return bloom(usual, "token", kept), bloom(usual.where(F.col("df") >= VERY * least), "token", kept), bits


def _groups(n: int, band: int) -> tuple[int, int]:
    """Sub-classes of a band, and how many tokens of one make a signature."""
    size = 1.25**band
    return (1, 1) if size < SMALL else (max(1, int(SPREAD * size)), 2)


def _pairs_within(tokens: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A signature for each two tokens of a group, and the place of the later one. tokens stand in the global order."""
    order = np.argsort(group, kind="stable")
    t, g = tokens[order], group[order]
    out, places, lag = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 1
    while lag < len(t) and (same := g[lag:] == g[:-lag]).any():
        out.append(mix64(mix64(t[:-lag][same]) * np.uint64(3) + t[lag:][same]))
        places.append(order[lag:][same])
        lag += 1
    return np.concatenate(out), np.concatenate(places)


def signatures(tokens: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rare tokens of the prefix, in order; signatures of its frequent ones; and for each of these the tokens that the set
    can share with another if they share no rare token and this is their first signature: of the tokens before, at most one
    of each sub-class (two would be a signature), and all from the signature's later token on."""
    n = len(tokens)
    spare = n - (PERCENT * n + 99) // 100
    rare = tokens[level == 0]
    if len(rare) > spare:
        return rare[: spare + 1], np.zeros(0, np.uint64), np.zeros(0, np.int64)
    rest = level > 0
    later = tokens[rest][np.lexsort((tokens[rest], level[rest]))]
    need, own, out, most = spare + 1 - len(rare), int(np.searchsorted(BAND_FROM, n, side="right")) - 1, [], []
    for band in (own, own + 1):
        m, k = _groups(n, band)
        if k == 1:
            out.append(mix64(later[:need] + np.uint64(band)))
            most.append(len(later) - np.arange(len(later[:need])))
            continue
        group = mix64(later ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(m)
        order = np.argsort(group, kind="stable")
        rank = np.empty(len(later), np.int64)
        sorted_group = group[order]
        first = np.concatenate(([True], sorted_group[1:] != sorted_group[:-1]))
        rank[order] = np.arange(len(later)) - np.maximum.accumulate(np.where(first, np.arange(len(later)), 0))
        covered = np.cumsum(rank >= k - 1)
        stop = int(np.searchsorted(covered, need)) + 1
        pairs, place = _pairs_within(later[:stop], group[:stop])
        out.append(mix64(pairs + np.uint64(band)))
        most.append(len(later) - (covered[place] - 1))
    return rare, np.concatenate(out), np.concatenate(most)


def _overlap(a, b):
    """Shared tokens that sets of these sizes need at least."""
    return (PERCENT * (a + b) + 99 + PERCENT) // (100 + PERCENT)


def candidates(sets: DataFrame, nodes, usual: Bloom, very: Bloom, bits: int, buckets: int) -> DataFrame:
    """Rows of two kinds. With hub: a candidate pair of nodes (hub, doc). Without: the node doc is a member of the signature
    ``run``, with its size n and the tokens ``most`` that it can share there. sets and nodes as in frequent_tokens."""
    sc, drop = sets.sparkSession.sparkContext, np.uint64(64 - bits)
    sent = sc.broadcast((usual.parts(), very.parts()))

    def emit(batches):
        usual, very = (Bloom(*x) for x in sent.value)
        token, doc, size, place, held = [], [], [], [], 0
        heavy: list[tuple] = []

        def flush():
            t = np.concatenate(token)
            order = np.argsort(t, kind="stable")
            t, d, n, p = t[order], np.concatenate(doc)[order], np.concatenate(size)[order], np.concatenate(place)[order]
            cuts = np.searchsorted(t >> np.uint64(32), np.arange(1, buckets, dtype=np.uint64) * np.uint64((1 << 32) // buckets))
            cols = [np.split(x, cuts) for x in (t >> np.uint64(16), d, n, p)]
            return _blobs(["bucket", "part"], [[b, pack(*c)] for b, c in enumerate(zip(*cols)) if len(c[0])])

        def flush_heavy():
            """Signatures of frequent tokens are dealt out evenly, whatever their key."""
            s, d, n, m = (np.concatenate(x) for x in zip(*heavy))
            order = np.argsort(s, kind="stable")
            s, d, n, m = s[order], d[order], n[order], m[order]
            to = (mix64(s + d.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
            return _blobs(["bucket", "part"], [[-1 - b, pack(s[k], d[k], n[k], m[k])] for b in np.unique(to) for k in [to == b]])

        batch, batch_size = [], 0
        def work():
            nonlocal held
            every = np.concatenate([s for _, s in batch]) >> drop
            level = usual.has(every).astype(np.int8)
            level += very.has(every) & (level > 0)
            at = 0
            for i, s in batch:
                rare, more, most = signatures(s, level[at : at + len(s)])
                at += len(s)
                token.append(rare), doc.append(np.full(len(rare), i, np.int64)), size.append(np.full(len(rare), len(s), np.int64)), place.append(np.arange(len(rare)))
                held += len(rare)
                if len(more):
                    heavy.append((more, np.full(len(more), i, np.int64), np.full(len(more), len(s), np.int64), most))

        for i, s in _sets(batches, nodes.value):
            batch.append((i, s))
            batch_size += len(s)
            if batch_size >= FLUSH // 4:
                work()
                batch, batch_size = [], 0
                if held >= FLUSH // 2:
                    yield flush()
                    token, doc, size, place, held = [], [], [], [], 0
                if sum(len(h[0]) for h in heavy) >= FLUSH // 2:
                    yield flush_heavy()
                    heavy = []
        if batch:
            work()
        if held:
            yield flush()
        if heavy:
            yield flush_heavy()

    def meet(got: pa.Table) -> pa.Table:
        parts = [unpack(x.as_py(), 4) for x in got.column("part")]
        key, doc, n, place = (np.concatenate([p[c] for p in parts]) for c in range(4))
        doc, n, place = doc.view(np.int64), n.astype(np.int64), place.astype(np.int64)
        if got.column("bucket")[0].as_py() < 0:
            return _rows(key.view(np.int64), doc, n, place, None)
        order = np.lexsort((doc, key))
        key, doc, n, place = key[order], doc[order], n[order], place[order]
        keep = np.concatenate(([True], (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])))
        key, doc, n, place = key[keep], doc[keep], n[keep], place[keep]
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        length = np.diff(np.append(first, len(key)))
        start, length = first[length > 1], length[length > 1]
        if not len(start):
            return _rows(*[np.zeros(0, np.int64)] * 4, None)
        run = np.repeat(np.arange(len(start)), length)
        at = np.arange(len(run)) - np.repeat(np.cumsum(length) - length, length) + start[run]
        hub, other = start[run], at
        fits = (other != hub) & (100 * np.minimum(n[hub], n[other]) >= PERCENT * np.maximum(n[hub], n[other]))
        # as if this were the first token that the two share; where it is, they can share those from here on only
        fits &= np.minimum(n[hub] - place[hub], n[other] - place[other]) >= _overlap(n[hub], n[other])
        pair = np.unique(np.stack([doc[hub][fits], doc[other][fits]]), axis=1) if fits.any() else np.zeros((2, 0), np.int64)
        # the members of longer runs, once for each set of members: its first run, where they can share most
        name = np.add.reduceat(mix64(doc[at].view(np.uint64)), np.cumsum(length) - length)
        pick = np.zeros(len(start), bool)
        pick[np.unique(name, return_index=True)[1]] = True
        pick &= length > 2
        chosen = pick[run]
        members = _rows(name[run][chosen].view(np.int64), doc[at][chosen], n[at][chosen], (n[at] - place[at])[chosen], None)
        zeros = np.zeros(pair.shape[1], np.int64)
        return pa.concat_tables([_rows(zeros, pair[1], zeros, zeros, pair[0]), members])

    def _rows(run, doc, n, most, hub):
        return pa.table({"run": pa.array(run, pa.int64()), "doc": pa.array(doc, pa.int64()), "n": pa.array(n, pa.int64()), "most": pa.array(most, pa.int64()), "hub": pa.array(hub, pa.int64()) if hub is not None else pa.nulls(len(run), pa.int64())})

    return sets.mapInArrow(emit, "bucket int, part binary").groupBy("bucket").applyInArrow(meet, "run long, doc long, n long, most long, hub long")


def _fits(a: str, b: str):
    """Sizes of two members allow a link."""
    na, nb, ma, mb = (F.col(x) for x in (f"{a}.n", f"{b}.n", f"{a}.most", f"{b}.most"))
    return (100 * F.least(na, nb) >= PERCENT * F.greatest(na, nb)) & ((100 + PERCENT) * F.least(ma, mb) >= PERCENT * (na + nb))


def fetch(sets: DataFrame, nodes: DataFrame, count: int, shown) -> DataFrame:
    """node, tokens of the ``count`` nodes, and of some more; tokens as ``shown`` gives them. Only sets that a filter of fixed
    size lets through leave their place."""
    sent = sets.sparkSession.sparkContext.broadcast(bloom(nodes, "node", count).parts())

    def pick(batches):
        for batch in batches:
            got = [(i, shown(s)) for i, s in _sets([batch], sent.value)]
            yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.binary())], names=["node", "tokens"])

    return sets.mapInArrow(pick, "node long, tokens binary")


#: Tokens from which on a set's short form has four bytes of each, not two.
WIDE = 1 << 12


def shortened(tokens: np.ndarray) -> bytes:
    """The first two (or four) bytes of each token, and how many at the end."""
    wide = len(tokens) >= WIDE
    return (tokens >> np.uint64(32 if wide else 48)).astype("<u4" if wide else "<u2").tobytes() + bytes([4 if wide else 2])


def may_link(x: bytes, y: bytes) -> bool:
    """Whether sets of these short forms can be linked: no fewer tokens seem to be shared than are."""
    a, b = (np.frombuffer(t, f"<u{t[-1]}", count=len(t) // t[-1]) for t in (x, y))
    if a.itemsize != b.itemsize:
        a, b = ((t >> 16).astype(np.uint16) if t.itemsize == 4 else t for t in (a, b))
    if a.itemsize == 2:
        held = np.zeros(1 << 16, bool)
        held[b] = True
        shared = int(held[a].sum())
    else:
        shared = int(np.isin(a, b).sum())
    return 100 * shared >= PERCENT * (len(a) + len(b) - shared)


def are_linked(x: bytes, y: bytes) -> bool:
    both = np.frombuffer(x + y, np.uint64).copy()
    both.sort(kind="stable")
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= PERCENT * (len(both) - shared)


def verify(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) of nodes whose sets are linked. pairs is a table, and so is the result. Short forms of the sets
    tell most of the others off before whole sets move."""
    for shown, test in ((shortened, may_link), (np.ndarray.tobytes, are_linked)):
        pairs = _tested(sets, pairs, shown, test)
    return pairs


def _tested(sets: DataFrame, pairs: DataFrame, shown, test) -> DataFrame:
    """Those of the pairs whose sets, as shown, pass the test. Each set that is needed is dealt out once, by its node, and both
    joins find it there; sets of nodes with very many pairs go to several tasks besides."""
    total = 2 * pairs.count()
    if not total:
        return pairs
    degree = materialize(pairs.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("links")), "degree", total)
    heavy = heavy_keys(degree, ["node"], "links", total, HUB_LINKS)

    def run(batches):
        for batch in batches:
            keep = [test(x, y) for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    with Held() as hold:
        found = hold(fetch(sets, degree, degree.count(), shown).repartition("node"))

        def with_set(df, end, other, name, dense):
            own = found.withColumnRenamed("node", end).withColumnRenamed("tokens", name)
            return salted_join(df, own, [end], heavy.withColumnRenamed("node", end), other, "inner") if dense else df.join(own, end)

        if heavy is None:
            both = with_set(with_set(pairs, "a", "b", "x", False), "b", "a", "y", False)
        else:
            marked = pairs
            for end in ("a", "b"):
                marked = marked.join(F.broadcast(heavy.select(F.col("node").alias(end), F.lit(True).alias(f"{end}_dense"))), end, "left")
            both = None
            for dense_a, dense_b in ((False, False), (True, False), (False, True), (True, True)):
                some = marked.where((F.col("a_dense").isNotNull() == dense_a) & (F.col("b_dense").isNotNull() == dense_b)).select("a", "b")
                some = with_set(with_set(some, "a", "b", "x", dense_a), "b", "a", "y", dense_b).select("a", "b", "x", "y")
                both = some if both is None else both.unionByName(some)
        return settle(both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long"), "tested")


def _mixed(postings: DataFrame) -> tuple[DataFrame, int] | None:
    """Of the postings (run, doc, n, most, component; a table) those of runs that several components share, with the run's
    largest component, main, how many members it has, c, and the pairs of members that are to be compared, work; and how
    many postings there were; None if there is none."""
    total = postings.count()
    each = postings.groupBy("run", "component").agg(F.count("*").alias("k"))
    runs = each.groupBy("run").agg(F.max_by("component", F.struct("k", "component")).alias("main"), F.max("k").alias("top"), F.sum("k").alias("c"))
    runs = materialize(runs.where("top < c").select("run", "main", "c", ((F.col("c") - F.col("top")) * F.col("c")).alias("work")), "mixed", total)
    if runs.isEmpty():
        return None
    return materialize(salted_join(postings, runs, ["run"], heavy_keys(runs, ["run"], "c", total), "doc"), "postings", total), total


def _across(mixed: DataFrame) -> DataFrame:
    """Pairs (a, b) of a run's members of different components, one of them outside the largest, whose sizes allow a link. The
    members of a large run are dealt out, and those outside the largest component are sent to all its parts."""
    parts = F.ceil(F.col("c") / SPREAD_ROWS).cast("int")
    all_of = mixed.withColumn("part", F.pmod(F.xxhash64("doc"), parts).cast("int")).alias("q")
    minor = mixed.where("component <> main").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).alias("p")
    pairs = minor.join(all_of, ["run", "part"]).where(F.col("p.component") != F.col("q.component"))
    pairs = pairs.where((F.col("q.component") == F.col("q.main")) | (F.col("p.doc") < F.col("q.doc"))).where(_fits("p", "q"))
    return pairs.select(F.least("p.doc", "q.doc").alias("a"), F.greatest("p.doc", "q.doc").alias("b"))


def _anew(sets: DataFrame, members: DataFrame) -> DataFrame:
    """Postings as in _mixed, by the prefixes of the members (doc, n, component; a table) in the order of how many of them hold
    a token: a run is a token, and who holds a token alone has no posting of it."""

    def spell(batches):
        for batch in batches:
            for i, x in zip(batch.column("node").to_pylist(), batch.column("tokens")):
                x = np.frombuffer(x.as_buffer(), np.int64)
                for k in range(0, len(x), FLUSH):
                    yield pa.RecordBatch.from_arrays([pa.array(x[k : k + FLUSH]), pa.array(np.full(len(x[k : k + FLUSH]), i, np.int64))], names=["run", "doc"])

    spelt = fetch(sets, members.select(F.col("doc").alias("node")), members.count(), np.ndarray.tobytes).mapInArrow(spell, "run long, doc long")
    spelt = settle(spelt.join(members.select("doc"), "doc", "left_semi"), "spelt")
    total = spelt.count()
    held_by = materialize(spelt.groupBy("run").agg(F.count("*").alias("df")).where("df > 1"), "held_by", total)
    met = salted_join(spelt, held_by, ["run"], heavy_keys(held_by, ["run"], "df", total), "doc")
    order = met.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("df", "run"))).alias("t")).join(members, "doc")
    n, spare = F.col("n"), F.expr(f"n - ({PERCENT} * n + 99) div 100")
    alone = n - F.size("t")  # tokens that stand before all that are met again
    prefix = F.slice("t", F.lit(1), F.greatest(F.lit(0), spare + 1 - alone).cast("int"))
    out = order.select("doc", "n", "component", alone.alias("alone"), F.posexplode(prefix).alias("place", "x"))
    return materialize(out.select(F.col("x.run").alias("run"), "doc", "n", (n - F.col("alone") - F.col("place")).alias("most"), "component"), "anew", total)


def ngram_jaccard_join(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", frequent: int = FREQUENT, most_frequent: int = MOST_FREQUENT, work: int = WORK) -> DataFrame:
    """doc_id, n_shingles, class_id, component_id for each row of docs, whose ids are integers.

    Two documents link when 100 * shared >= 80 * union of their sets of five-word shingles. class_id is the smallest
    doc_id with the same set, component_id the smallest that links reach. Null, empty and blank texts have no shingle and
    stand alone. Rows that share an id are one node, linked if any of them is; rows without an id keep null class and
    component. An empty table gives an empty result. Other columns are not read.

    ``frequent`` and ``most_frequent`` set which tokens count as frequent, ``work`` from which size on a signature's members
    are indexed anew; results don't depend on them.
    """
    integer_id(docs, id_col)
    small_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    with Held() as hold:
        every = hold(token_sets(docs))
        seen = every.agg(F.count("*").alias("rows"), F.sum(F.when(F.col("doc_id").isNotNull(), F.col("n_shingles"))).alias("tokens")).first()
        profile = materialize(every.select("row", "doc_id", "n_shingles", "h1", "h2", F.col("tokens").isNotNull().alias("kept")), "profiles", seen.rows)
        placed = _placed(every.where("tokens is not null").select("row", "tokens"), profile, seen.rows, seen.tokens, frequent, most_frequent, work) if seen.tokens else None
    own = F.col("doc_id")
    if placed is None:
        return profile.select("doc_id", "n_shingles", own.alias("class_id"), own.alias("component_id"))
    key = ["n_shingles", "h1", "h2"]
    has = F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)
    out = salted_join(profile.where(has).select("row", "doc_id", *key), placed, key, heavy_keys(placed, key, "copies", seen.rows), "row")
    bare = profile.where(~has).select("doc_id", "n_shingles", own.alias("class_id"), own.alias("component_id"))
    return out.select("doc_id", "n_shingles", "class_id", "component_id").unionByName(bare)


def _same_id(has: DataFrame, classes: DataFrame, rows: int) -> DataFrame:
    """Links (a, b) that join the nodes of an id that stands on several texts."""
    several = has.groupBy("doc_id").agg(F.min("h1").alias("lo"), F.max("h1").alias("hi"), F.count("*").alias("c")).where("lo <> hi")
    several = materialize(several.select("doc_id", "c"), "several", rows)
    if several.isEmpty():
        return has.sparkSession.createDataFrame([], "a long, b long")
    key = ["n_shingles", "h1", "h2"]
    own = salted_join(has.select("row", "doc_id", *key), several, ["doc_id"], heavy_keys(several, ["doc_id"], "c", rows), "row")
    own = own.select("doc_id", *key).distinct().join(classes.select(*key, F.col("row").alias("a")), key).select("doc_id", "a")
    return own.join(own.groupBy("doc_id").agg(F.min("a").alias("b")), "doc_id").where("a <> b").select("a", "b")


def _placed(sets: DataFrame, profile: DataFrame, rows: int, total: int, frequent: int, most_frequent: int, work: int) -> DataFrame:
    """n_shingles, h1, h2, copies, class_id, component_id of each different set. sets: row, tokens of token_sets."""
    has = profile.where("doc_id is not null and n_shingles > 0")
    classes = has.groupBy("n_shingles", "h1", "h2").agg(F.min("doc_id").alias("class_id"), F.min(F.when(F.col("kept"), F.col("row"))).alias("row"), F.count("*").alias("copies"))
    classes = materialize(classes, "classes", rows)
    same_id = _same_id(has, classes, rows)
    nodes = sets.sparkSession.sparkContext.broadcast(bloom(classes, "row", classes.count()).parts())

    buckets = max(32, math.ceil(total / FLUSH))
    usual, very, bits = frequent_tokens(sets, nodes, total, frequent, buckets, most_frequent)
    runs = settle(candidates(sets, nodes, usual, very, bits, buckets), "runs")
    suggested = runs.count()
    members = materialize(runs.where("hub is null").groupBy("run", "doc").agg(F.max("n").alias("n"), F.max("most").alias("most")), "members", suggested)
    # the member of a signature that can share most is nearest to the others
    hubs = members.groupBy("run").agg(F.min(F.struct((F.col("n") - F.col("most")).alias("own"), "doc", "n", "most")).alias("h"), F.count("*").alias("c"))
    hubs = materialize(hubs.where("c > 1").select("run", "c", F.col("h.doc").alias("hub"), F.col("h.n").alias("hub_n"), F.col("h.most").alias("hub_most")), "hubs", suggested)
    stars = salted_join(members, hubs, ["run"], heavy_keys(hubs, ["run"], "c", members.count()), "doc")
    stars = stars.select(F.struct("doc", "n", "most").alias("m"), F.struct(F.col("hub").alias("doc"), F.col("hub_n").alias("n"), F.col("hub_most").alias("most")).alias("h"))
    stars = stars.where("m.doc <> h.doc").where(_fits("m", "h")).select(F.least("m.doc", "h.doc").alias("a"), F.greatest("m.doc", "h.doc").alias("b"))
    pairs = runs.where("hub is not null").select(F.least("hub", "doc").alias("a"), F.greatest("hub", "doc").alias("b"))
    first = materialize(pairs.unionByName(stars).where("a <> b").distinct(), "first", suggested)
    links = verify(sets, first).unionByName(same_id)
    found = components(links)

    # members of one signature in different components: all that is left to verify
    at = found.withColumnRenamed("node", "doc")
    postings = members.join(at, "doc", "left").withColumn("component", F.coalesce("component", "doc"))
    if mixed := _mixed(materialize(postings, "placed", suggested)):
        cross = _across(mixed[0].where(F.col("work") <= work))
        crowd = materialize(mixed[0].where(F.col("work") > work).select("doc", "n", "component").distinct(), "crowd", mixed[1])
        if not crowd.isEmpty() and (deeper := _mixed(_anew(sets, crowd))):
            cross = cross.unionByName(_across(deeper[0]))
        cross = materialize(cross.distinct().join(first, ["a", "b"], "left_anti"), "cross")
        if not cross.isEmpty():
            found = components(links.unionByName(verify(sets, cross)))

    named = found.join(classes.select(F.col("row").alias("node"), "class_id"), "node")
    tops = materialize(named.groupBy("component").agg(F.min("class_id").alias("component_id"), F.count("*").alias("c")), "tops", rows)
    of = salted_join(named.drop("class_id"), tops, ["component"], heavy_keys(tops, ["component"], "c", rows), "node").select(F.col("node").alias("row"), "component_id")
    placed = classes.join(of, "row", "left").withColumn("component_id", F.coalesce("component_id", "class_id"))
    return materialize(placed.select("n_shingles", "h1", "h2", "copies", "class_id", "component_id"), "placed", rows)


#: Ids that are sent to every executor rather than joined, at most (8 MB).
MOST_SENT = 1 << 20


def one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Those rows of docs (with all their columns) whose id is their component's, one for each id, and rows without an id.

    Of rows that share an id the one that comes first by hash of the text, then by all columns as JSON, stays. An empty table
    gives an empty result; null, empty and blank texts are nobody's copies and stay.
    """
    found = materialize(ngram_jaccard_join(docs, id_col=id_col, text_col=text_col).select("doc_id", "component_id"), "components")
    own, stays = fresh("_id", docs.columns), fresh("_stays", docs.columns)
    each = found.where("doc_id is not null").groupBy("doc_id").agg(F.min("component_id").alias("top"), F.count("*").alias("rows"))
    special = each.where("top <> doc_id or rows > 1").select(F.col("doc_id").alias(own), (F.col("top") == F.col("doc_id")).alias(stays))
    special = materialize(special, "special", docs.count())
    ids = F.broadcast(special) if special.count() <= MOST_SENT else special
    same = F.col(id_col).cast("long") == F.col(own)
    single = docs.join(ids, same, "left").where(F.col(own).isNull()).select(docs.columns)
    if special.where(stays).isEmpty():
        return single
    whole = F.struct(*docs.columns)
    repeated = docs.join(special.where(stays), same).groupBy(own).agg(F.min_by(whole, F.struct(F.xxhash64(text_col), F.to_json(whole))).alias(stays))
    return single.unionByName(repeated.select(f"{stays}.*"))
