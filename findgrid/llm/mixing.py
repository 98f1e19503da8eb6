"""Mixing sources to target weights by Pareto order sampling.

Every source has a target size. A document's expected number of copies is c * odds, at most `most`, where c is the one number
that makes the expected sizes of its source add up to the target. Its whole copies are certain; the fraction left is its
inclusion probability p in a fixed-size sample: documents are ranked by the random odds U/(1-U) over the inclusion odds
p/(1-p), and those of least rank are taken until their sizes fill the rest. U is a hash of the document and a seed, so reruns
agree. c is found from sums by (source, odds), as odds are rounded to steps of 1/16 of a power of two; the cut is found from
sums of sizes in cells of the rank, then row by row in the one cell where it falls, so no task sees a whole source.

Null text: size 0, never taken. Null source: a source of its own, last. Null, zero or negative odds: the least odds. Equal rows
have different U by their number among them, and any of them may get any number, as they are equal. Ties of the rank go by
hash and doc_id. Very long documents are whole: the taken size misses its target by half the document at the cut at most. Extra
columns travel in a struct, so no name can clash. Empty table: no rows. Sources are few: their sums by odds (at most 4,000 a
source) are the only thing the driver holds.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from findgrid.llm.common import n_words, save

WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
SEED = 17
_PLAN = pa.schema([("source", pa.string()), ("_step", pa.int32()), ("source_size", pa.int64()), ("target", pa.float64()), ("whole", pa.int64()), ("p", pa.float64()), ("rest", pa.float64())])


def targets(sizes: dict[str | None, int], weights=WEIGHTS, most: int = MOST_COPIES) -> dict[str | None, float]:
    """Target size by source: the total shared by weight (sources by code point, null last, weights repeating), no source over
    `most` times its size; the excess is shared again among the others by weight."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, total, out = list(names), float(sum(sizes.values())), {}
    while left:
        per = total / sum(weight[s] for s in left)
        above = [s for s in left if weight[s] * per > most * sizes[s]]
        if not above:
            out |= {s: weight[s] * per for s in left}
            break
        for s in above:
            out[s] = float(most * sizes[s])
            total -= out[s]
        left = [s for s in left if s not in above]
    return out


def _scale(by: dict[int, int], target: float, most: int) -> float:
    """The c for which sum of size * min(most, c * 2**(step / 16)) over a source's sizes by step is the target."""
    f = lambda c: sum(n * min(float(most), c * 2 ** (k / 16)) for k, n in by.items())
    if not any(by.values()) or target <= 0:
        return 0.0
    lo, hi = 0.0, most * 2 ** (-min(by) / 16)  # at hi every document has all its copies
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f(mid) < target else (lo, mid)
    return hi


def _numbered(d: DataFrame) -> DataFrame:
    """d with _no, the number of a row among equal rows (0 if it has no equal), by counts of parts of a group, so that a row that
    a third of the table repeats is numbered by many tasks."""
    several = d.groupBy("_h").agg(F.count("*").alias("_n")).filter("_n > 1")
    if several.isEmpty():
        return d.withColumn("_no", F.lit(0).cast("long"))
    d = d.withColumn("_part", F.pmod(F.monotonically_increasing_id(), F.lit(256)))
    parts = d.groupBy("_h", "_part").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("_h").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("_h", "_part", F.coalesce(before, F.lit(0)).alias("_before"))
    number = F.row_number().over(Window.partitionBy("_h", "_part").orderBy("doc_id"))
    return d.withColumn("_rn", number).join(parts, ["_h", "_part"]).withColumn("_no", F.col("_before") + F.col("_rn") - 1).drop("_part", "_rn", "_before")


def mix(docs: DataFrame, weights=WEIGHTS, most: int = MOST_COPIES, seed: int = SEED, odds: Column | None = None, size: Column | None = None) -> DataFrame:
    """Rows (row, doc_id, size, source_size, target, copies, taken): `row` is the input row as a struct, so that its names
    can't clash; copies are the whole copies taken, taken is size times copies.

    odds: relative weight of a document within its source, all equal if None. size: of a document, the number of words of text
    if None."""
    spark = docs.sparkSession
    whole_row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    weight = odds.cast("double") if odds is not None else F.lit(1.0)
    # steps of 1/16 of a power of two, from 2**-100 to 2**100
    step = F.round(F.log2(F.when(weight > 0, F.least(F.greatest(weight, F.lit(2.0**-100)), F.lit(2.0**100))).otherwise(F.lit(2.0**-100))) * 16)
    d = docs.select(
        whole_row.alias("row"), "doc_id", "source",
        (size if size is not None else n_words(F.col("text"))).cast("long").alias("size"),
        step.cast("int").alias("_step"), F.xxhash64(whole_row).alias("_h"),
    )
    d = save(d, "mix")
    sums = d.groupBy("source", "_step").agg(F.sum("size").alias("s"), F.count("*").alias("n")).collect()
    out = ["row", "doc_id", "size", "source_size", "target", "copies", "taken"]
    if not sums:
        return d.select("row", "doc_id", "size", *(F.lit(None).cast(t).alias(c) for c, t in (("source_size", "long"), ("target", "double"), ("copies", "long"), ("taken", "long"))))
    of: dict[str | None, dict[int, int]] = {}
    for r in sums:
        of.setdefault(r["source"], {})[r["_step"]] = r["s"]
    sizes = {k: sum(v.values()) for k, v in of.items()}
    want = targets(sizes, weights, most)
    rows = []
    for source, by in of.items():
        c = _scale(by, want[source], most)
        expected = {k: min(float(most), c * 2 ** (k / 16)) for k in by}
        certain = {k: math.floor(e + 1e-9) for k, e in expected.items()}
        rest = max(0.0, want[source] - sum(certain[k] * n for k, n in by.items()))
        rows += [(source, k, sizes[source], float(want[source]), certain[k], max(0.0, expected[k] - certain[k]), rest) for k in by]
    # as an Arrow table: rows of a list would go through Python workers of another kind, which stay beside the others
    plan = spark.createDataFrame(pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _PLAN.types, strict=True)], schema=_PLAN))
    cells = 1 << max(8, math.ceil(math.log2(max(2, sum(r["n"] for r in sums))) / 2))
    # a row for each source and step of the odds
    d = d.join(F.broadcast(plan), d["source"].eqNullSafe(plan["source"]) & (d["_step"] == plan["_step"])).drop(plan["source"]).drop(plan["_step"])
    d = _numbered(d)
    u = (F.pmod(F.xxhash64("doc_id", "_h", "_no", F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    p = F.least(F.col("p"), F.lit(1 - 1e-9))
    q = F.when((p > 0) & (F.col("size") > 0), (u / (1 - u)) / (p / (1 - p)))
    d = d.withColumn("_q", q).withColumn("_c", F.floor(F.col("_q") / (1 + F.col("_q")) * cells).cast("long"))

    ranked = d.filter("_q IS NOT NULL AND rest > 0")
    by_cell = ranked.groupBy("source", "_c").agg(F.sum("size").alias("n"), F.first("rest").alias("rest"))
    upto = Window.partitionBy("source").orderBy("_c")
    by_cell = by_cell.withColumn("sum", F.sum("n").over(upto)).withColumn("before", F.col("sum") - F.col("n"))
    # the cell in which the rest of the target is filled, and what lower cells hold
    cut = by_cell.filter("before <= rest AND sum > rest").select("source", F.col("_c").alias("cut"), "before")
    cut = F.broadcast(cut)  # at most a row for each source
    d = d.join(cut.select(F.col("source").alias("_s"), "cut", "before"), F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
    # within the cut cell by rank and hash; equal rows share a hash and are parted by the running number
    line = Window.partitionBy("source", "_c").orderBy("_q", "_h", "doc_id", "_no").rowsBetween(Window.unboundedPreceding, 0)
    inside = F.col("_c") == F.col("cut")
    cell = d.filter(inside).withColumn("_sum", F.col("before") + F.sum("size").over(line))
    # the last document is taken if that comes nearer than leaving it
    cell = cell.withColumn("_in", F.col("_sum") - F.col("size") / 2 <= F.col("rest")).drop("_sum")
    rest = d.filter(~F.coalesce(inside, F.lit(False))).withColumn("_in", F.coalesce((F.col("rest") > 0) & F.col("_q").isNotNull() & (F.col("cut").isNull() | (F.col("_c") < F.col("cut"))), F.lit(False)))
    d = rest.unionByName(cell)
    copies = F.when(F.col("size") > 0, F.col("whole") + F.col("_in").cast("long")).otherwise(F.lit(0)).cast("long")
    return d.withColumn("copies", copies).withColumn("taken", F.col("copies") * F.col("size")).select(*out)


def repeat(mixed: DataFrame) -> DataFrame:
    """The mix itself: each input row as often as it is taken."""
    return mixed.filter("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_copy")).select("row.*")
