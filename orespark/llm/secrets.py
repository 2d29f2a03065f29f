"""Secret scans with corpus-wide ownership of the values found. DataFrame functions only.

Fixed patterns give the base spans. A further pattern gives candidates: long runs of key characters that hold upper and lower
case letters, digits and enough different characters. Every value's hash is counted by the different repositories and owners
that hold it: what several owners hold, or one owner in many repositories, is a widely copied example; what one owner holds in
few looks live. Candidates of the latter kind that touch no base span are added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import heavy_keys, materialize, salted_join

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: kind: pattern, group of the value, characters that the value has at least.
BASE = {"assign": (ASSIGN, 1, 8), "access": ("AKIA[A-Z0-9]+", 0, 16), "hex": ("[0-9a-f]{32,}", 0, 32)}
#: The method's own kind; its pattern finds runs with a digit only, from their first character.
LIVE = ("live", r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])[A-Za-z0-9+/_-]{20,}", 20)
#: Different characters of a live-looking value at least; owners, and repositories, from which on a value is an example.
VARIETY, OWNERS, REPOS = 10, 2, 5
KINDS = [*BASE, LIVE[0]]


def _matches(text: Column, kind: str, pattern: str) -> Column:
    """(kind, number of the match, characters between it and the one before, match), in order."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.transform(F.arrays_zip(found.alias("m"), F.split(text, pattern, -1).alias("p")), lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("i"), F.length(x["p"]).cast("long").alias("gap"), x["m"].alias("match")))


def secret_matches(docs: DataFrame) -> DataFrame:
    """row, doc_id, repo, owner and one row for each match of a pattern, whether or not it is long enough: kind, start, end,
    match; a row without matches has nulls there. docs: doc_id, text, repo, owner. The text is read once."""
    text = F.coalesce(F.col("text"), F.lit(""))
    patterns = [(k, p) for k, (p, _, _) in BASE.items()] + [LIVE[:2]]
    every = F.filter(F.concat(*[_matches(text, k, p) for k, p in patterns]), lambda x: x["match"].isNotNull())
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "repo", "owner", every.alias("every"))
    rows = rows.select("row", "doc_id", "repo", "owner", F.explode_outer("every").alias("x")).select("row", "doc_id", "repo", "owner", "x.*")
    rows = materialize(rows, "matches")
    before = Window.partitionBy("row", "kind").orderBy("i")
    length = F.length("match").cast("long")
    end = F.sum(F.col("gap") + length).over(before.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("end", end).withColumn("start", F.col("end") - length)


def ownership(values: DataFrame) -> DataFrame:
    """hash, rows, repos, owners for values (hash, repo, owner): in how many rows a value stands, and how many different
    repositories and owners hold it. Counted key by key, so that a value that stands everywhere is added up before it meets."""
    by_repo = values.groupBy("hash", "repo").agg(F.count("*").alias("rows"))
    repos = by_repo.groupBy("hash").agg(F.sum("rows").alias("rows"), F.count("repo").alias("repos"))
    by_owner = values.groupBy("hash", "owner").agg(F.count("*").alias("rows"))
    return repos.join(by_owner.groupBy("hash").agg(F.count("owner").alias("owners")), "hash")


def classified(matches: DataFrame) -> DataFrame:
    """The matches that count, with base, owners and repos, and live: held by one owner, in few repositories."""
    value, fits = F.lit(None).cast("string"), F.lit(False)
    for kind, (pattern, group, least) in BASE.items():
        own = F.regexp_extract("match", pattern, group)
        value = F.when(F.col("kind") == kind, own).otherwise(value)
        fits = fits | ((F.col("kind") == kind) & (F.length(own) >= least))
    m = F.col("match")
    varied = m.rlike("[A-Z]") & m.rlike("[a-z]") & m.rlike("[0-9]") & (F.size(F.array_distinct(F.split(m, ""))) >= VARIETY)
    found = matches.withColumn("value", F.when(F.col("kind") == LIVE[0], m).otherwise(value)).withColumn("base", F.col("kind") != LIVE[0]).where(F.coalesce(fits | (~F.col("base") & varied), F.lit(False)))
    found = found.withColumn("hash", F.sha2("value", 256))
    # where a candidate touches a base span: one that begins before its end and ends after its start
    near = Window.partitionBy("row").orderBy("start", F.col("base").desc(), "end")
    ended = F.max(F.when(F.col("base"), F.col("end"))).over(near.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.min(F.when(F.col("base"), F.col("start"))).over(near.rowsBetween(1, Window.unboundedFollowing))
    found = found.withColumn("touches", ~F.col("base") & (F.coalesce(ended > F.col("start"), F.lit(False)) | F.coalesce(begins < F.col("end"), F.lit(False))))
    found = materialize(found.where("not touches").select("row", "repo", "owner", "kind", "start", "end", "base", "hash"), "found")
    total = found.count()
    held = materialize(ownership(found), "ownership", total)
    known = salted_join(found, held, ["hash"], heavy_keys(held, ["hash"], "rows", total), "row")
    return known.withColumn("live", (F.col("owners") < OWNERS) & (F.col("repos") < REPOS)).where("base or live")


def secret_scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "doc_id", owner_col: str = "source") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example for each row.

    spans has kind:start:end of all spans, by start, then kind as listed in KINDS, joined by commas; base_sha256 is the
    digest of the same of the base ones. Places are code points, the end exclusive. n_live and n_example count base spans
    whose value looks live (fewer than OWNERS owners, fewer than REPOS repositories hold it), and the others. A null text counts
    as empty; a null repository or owner counts as none; repeated rows and null ids stay; an empty table gives an empty result.
    Other columns are not read. Where there is no column of repositories, each document is one.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(repo_col).cast("string").alias("repo"), F.col(owner_col).cast("string").alias("owner"))
    matches = secret_matches(docs)
    order = F.element_at(F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)]), F.col("kind"))
    span = F.struct("start", order.alias("order"), "end", "kind", "base", "live")
    spans = classified(matches).groupBy("row").agg(F.sort_array(F.collect_list(span)).alias("s"))
    rows = matches.groupBy("row").agg(F.first("doc_id").alias("doc_id")).join(spans, "row", "left").withColumn("s", F.coalesce("s", F.array().cast("array<struct<start:bigint,order:int,end:bigint,kind:string,base:boolean,live:boolean>>")))

    def joined(x):
        return F.array_join(F.transform(x, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def of(kind):
        return lambda s: s["kind"] == kind

    def count(test):
        return F.size(F.filter("s", test)).cast("long")

    return rows.select(
        "doc_id",
        *[count(of(k)).alias(f"n_{k}") for k in BASE],
        F.sha2(joined(F.filter("s", lambda s: s["base"])), 256).alias("base_sha256"),
        joined(F.col("s")).alias("spans"),
        count(lambda s: s["base"] & s["live"]).alias("n_live"),
        count(lambda s: s["base"] & ~s["live"]).alias("n_example"),
    )
