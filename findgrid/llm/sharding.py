"""Shards of near equal bytes by sampled splitters.

Records are ordered by (digest of the text, doc_id, place read), so equal texts are neighbours and no key is longer than three
numbers. A sample drawn with odds in proportion to a record's size gives splitters, quantiles of the bytes; their ranges are summed
up exactly. A range that a shard's border cuts is overfull for the shard before it: it alone is sampled and divided again, until it
is less than TOLERANCE of a shard or one record. Splitters first lie between texts; only where one text with all its copies is
overfull itself, it is divided by doc_id, and then by place for repeated rows. So the copies of a text share a shard wherever the
sizes allow. Rows then go to their ranges by comparing their key with the n - 1 borders, and are numbered by ranges, never in one task.

Null texts have no bytes and the digest of an empty one. A size is never 0 (bytes + 1), so an empty text still counts. Rows without
doc_id come before the others of their text. Repeated rows are records of their own; they are equal, so which of them takes
which slot makes no difference. A text larger than a shard fills its shard alone or with little else. An empty table gives no
rows. shards() reads doc_id and text; sharded() returns all columns and two new ones, whose names must be free (a clash is
refused). The driver holds a sample of about 8 * SAMPLE keys for each range that it
divides, at most n - 1 at once, whatever the input.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from findgrid.functions.shared import in_order
from findgrid.llm.common import save

#: Share of a shard's size by which its border may miss the exact place; splitters expected for one divided range.
TOLERANCE, SAMPLE = 0.002, 128
_LOW, _KEY = -(1 << 63), ("h", "id", "row")


def _records(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, size, text_crc32, h, id, row) of docs, which have their own number `row`."""
    text = F.coalesce("text", F.lit(""))
    size = (F.octet_length(text) + 1).cast("long")
    key = (F.xxhash64(text).alias("h"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_LOW)).alias("id"))
    return docs.select("doc_id", size.alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), *key, "row")


def _sql(key: tuple) -> str:
    return "named_struct(" + ", ".join(f"'{c}', {x}L" for c, x in zip(_KEY, key, strict=True)) + ")"


def _place(keys: list[tuple]) -> Column:
    """How many of the sorted keys are at or before the row's own: first in steps of 32 keys, then among the 32."""
    own = F.struct(*_KEY)
    steps = [keys[i : i + 32] for i in range(0, len(keys), 32)]
    if not steps:
        return F.lit(0)
    firsts = F.expr(f"array({', '.join(_sql(s[0]) for s in steps)})")
    all_ = F.expr(f"array({', '.join('array(' + ', '.join(map(_sql, s)) + ')' for s in steps)})")
    at = F.size(F.filter(firsts, lambda k: k <= own))
    return F.when(at == 0, 0).otherwise((at - 1) * 32 + F.size(F.filter(F.get(all_, at - 1), lambda k: k <= own)))


class _Range(NamedTuple):
    first: tuple
    beyond: tuple | None
    before: int  # bytes before it
    size: int
    alike: int  # leading columns of the key that splitters may no longer differ in alone


def borders(records: DataFrame, n: int, tolerance: float = TOLERANCE, sample: int = SAMPLE) -> list[tuple]:
    """The first keys of shards 1 to n - 1, ascending (a key stands twice if a shard stays empty)."""
    total = records.agg(F.sum("size")).first()[0] or 0
    goals = [total * k // n for k in range(1, n)]
    open_ = dict.fromkeys(range(len(goals)), _Range((_LOW,) * 3, None, 0, total, 0)) if total else {}
    found: dict[int, tuple] = {}
    own, turn = F.struct(*_KEY), 0
    while open_:
        # one pass draws the samples of all open ranges, a second sums up what lies between their splitters
        turn += 1
        spans = sorted(set(open_.values()), key=lambda s: s.first)
        inside = [(own >= F.expr(_sql(s.first))) & (F.lit(True) if s.beyond is None else own < F.expr(_sql(s.beyond))) for s in spans]
        odds = F.coalesce(*(F.when(c, F.lit(8.0 * sample / s.size)) for c, s in zip(inside, spans, strict=True))) * F.col("size")
        active = records.filter(reduce(lambda a, b: a | b, inside))
        draw = F.xxhash64(*_KEY, F.lit(turn)).bitwiseAND((1 << 53) - 1) / float(1 << 53)
        drawn = sorted(tuple(r) for r in active.filter(draw < odds).select(*_KEY).collect())
        cuts: set[tuple] = set()
        for s in spans:
            mine = [x for x in drawn if x >= s.first and (s.beyond is None or x < s.beyond)]
            cuts |= {s.first, *(() if s.beyond is None else (s.beyond,))}
            cuts |= {c for x in mine[:: max(1, len(mine) // sample)] if (c := (x[: s.alike + 1] + (_LOW,) * 3)[:3]) > s.first}
        keys = sorted(cuts)
        ends = [f(c).alias(f"{name}_{c}") for c in _KEY for name, f in (("lo", F.min), ("hi", F.max))]
        sums = {r["place"]: r for r in active.groupBy(_place(keys).alias("place")).agg(F.sum("size").alias("bytes"), *ends).collect()}
        for k, s in list(open_.items()):
            at = s.before
            for i, c in enumerate(keys):
                if c < s.first or not (r := sums.get(i + 1)):
                    continue
                beyond = keys[i + 1] if i + 1 < len(keys) else None
                if at + r["bytes"] > goals[k] or beyond == s.beyond:
                    break
                at += r["bytes"]
            alike = next((j for j, x in enumerate(_KEY) if r[f"lo_{x}"] != r[f"hi_{x}"]), len(_KEY))
            if (c, beyond) == (s.first, s.beyond):  # its other keys are too light to be drawn: divide the heavy one
                alike = max(alike, s.alike + 1)
            if r["bytes"] <= tolerance * total / n or alike >= len(_KEY):
                found[k] = beyond if beyond is not None and goals[k] - at > at + r["bytes"] - goals[k] else c
                del open_[k]
            else:
                open_[k] = _Range(c, beyond, at, r["bytes"], alike)
    return [found[k] for k in sorted(found)]


def _dealt(records: DataFrame, n: int, tolerance: float) -> DataFrame:
    shard = _place(borders(records, n, tolerance)).cast("int")
    placed = in_order(records.withColumn("shard", shard), "shard", *_KEY)
    starts = placed.groupBy("shard").agg(F.min("_no").alias("first"))  # a row for each shard
    return placed.join(F.broadcast(starts), "shard").withColumn("slot", F.col("_no") - F.col("first"))


def shards(docs: DataFrame, n: int = 8, tolerance: float = TOLERANCE) -> DataFrame:
    """Rows (doc_id, size, text_crc32, law, shard, slot, grown_shard), one for each row of docs, in n shards of near equal bytes."""
    records = _records(docs.select("doc_id", "text").withColumn("row", F.monotonically_increasing_id()))
    d = _dealt(save(records, "records"), n, tolerance)
    return d.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def sharded(docs: DataFrame, n: int = 8, tolerance: float = TOLERANCE) -> DataFrame:
    """docs with their shard (0 to n - 1) and slot."""
    if clash := {"shard", "slot"} & {c.lower() for c in docs.columns}:
        raise ValueError(f"columns {sorted(clash)} are taken")
    whole = save(docs.select(F.struct("*").alias("doc"), F.monotonically_increasing_id().alias("row")), "numbered")
    records = save(_records(whole.select("doc.doc_id", "doc.text", "row")), "records")
    return whole.join(_dealt(records, n, tolerance).select("row", "shard", "slot"), "row").select("doc.*", "shard", "slot")


def write(docs: DataFrame, path: str, n: int = 8, tolerance: float = TOLERANCE, split_rows: int = 100_000) -> None:
    """Writes docs to path/shard=k/ in the order of their slots, a file for at most split_rows of them."""
    d = sharded(docs, n, tolerance)
    part = F.floor(F.col("slot") / split_rows)
    d.repartition("shard", part).sortWithinPartitions("shard", "slot").write.partitionBy("shard").option("maxRecordsPerFile", split_rows).parquet(path)
