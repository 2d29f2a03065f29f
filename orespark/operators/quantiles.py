"""Exact quantiles without a task that holds a whole group: ranges of values are counted, then the range that holds the rank."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Ranges that a group's values are counted in at once, and values of a range that are read out instead.
PARTS, FEW = 256, 2048


def quantiles(df: DataFrame, by: list[str], value: str, fractions: list[float]) -> DataFrame:
    """by, q0, q1, ...: for each group the values at these fractions of its ranks, linear between two ranks. NULL and NaN values
    don't count; a group without any has NULLs. Groups are few: a row each passes the driver, and PARTS counts of each rank."""
    spark, kinds = df.sparkSession, {f.name: f.dataType.simpleString() for f in df.schema}
    v = F.col(value).cast("double")
    rows = df.select(*by, F.when(~F.isnan(v), v).alias("_v"))
    groups = rows.groupBy(*by).agg(F.count("_v").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")).collect()
    ranks = {}
    for g, r in enumerate(groups):
        for f in fractions:
            for rank in {math.floor(f * (r["_n"] - 1)), math.ceil(f * (r["_n"] - 1))} if r["_n"] else ():
                ranks[g, rank] = {"lo": r["_lo"], "hi": r["_hi"], "below": 0, "rows": r["_n"]}
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in by] + ["_g int, _rank long, _from double, _to double"])

    def inside(wanted):
        """The values of each wanted rank's range."""
        ends = spark.createDataFrame([(*[groups[g][c] for c in by], g, rank, t["lo"], t["hi"]) for (g, rank), t in wanted.items()], schema)
        same = F.lit(True)
        for c in by:
            same = same & rows[c].eqNullSafe(ends[c])
        return rows.join(F.broadcast(ends), same & F.col("_v").between(F.col("_from"), F.col("_to"))).select("_g", "_rank", "_from", "_to", "_v")

    while wanted := {k: t for k, t in ranks.items() if t["lo"] < t["hi"] and t["rows"] > FEW}:
        part = F.least(F.lit(PARTS - 1), F.floor((F.col("_v") - F.col("_from")) / (F.col("_to") - F.col("_from")) * PARTS))
        counted = inside(wanted).groupBy("_g", "_rank", part.alias("part")).agg(F.count("*").alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi")).collect()
        before = {k: dict(t) for k, t in wanted.items()}
        for key, t in wanted.items():
            for r in sorted((r for r in counted if (r["_g"], r["_rank"]) == key), key=lambda r: r["part"]):
                if key[1] < t["below"] + r["n"]:
                    t |= {"lo": r["lo"], "hi": r["hi"], "rows": r["n"]}
                    break
                t["below"] += r["n"]
        if before == wanted:  # values so far apart that their difference is no number: read out as they are
            break
    wanted = {k: t for k, t in ranks.items() if t["lo"] < t["hi"]}
    few = {(r["_g"], r["_rank"]): sorted(r["x"]) for r in inside(wanted).groupBy("_g", "_rank").agg(F.collect_list("_v").alias("x")).collect()} if wanted else {}
    found = {k: few[k][k[1] - t["below"]] if k in few else t["lo"] for k, t in ranks.items()}

    def at(g, f):
        n = groups[g]["_n"]
        if not n:
            return None
        a, b = (found[g, up(f * (n - 1))] for up in (math.floor, math.ceil))
        return a + (b - a) * (f * (n - 1) - math.floor(f * (n - 1)))

    out = [(*[r[c] for c in by], *[at(g, f) for f in fractions]) for g, r in enumerate(groups)]
    return spark.createDataFrame(out, ", ".join([f"`{c}` {kinds[c]}" for c in by] + [f"q{i} double" for i in range(len(fractions))]))
