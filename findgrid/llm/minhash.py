"""Near copies by circulant MinHash, banding and exact verification.

A document's set holds the hashes of its distinct word shingles. One fixed permutation (a mixing function onto a circle of
2**21 places) spreads the set, a second one gives each place a number; signature coordinate k is the least number of the set's
places shifted by k, so two permutations give all coordinates. Documents that agree on all rows of a band are candidates;
a link stands only if the full sets have the similarity.

Equal sets are one class with its least doc_id as representative, so copies never meet each other. A bucket's leader is
its least representative; each representative is first compared with the leader that it meets in most buckets. Where all
members of a bucket are then in one component, a further link would change nothing. In other buckets all pairs of different
components are compared if the bucket is small; members of large ones are joined exactly by prefixes of their sets in an
order that puts rare elements first (_prefix_pairs says why this loses no link and doesn't multiply out groups of copies).
With 32 bands of 4 rows a pair of similarity 0.8 misses every band with probability 5e-8.

Null and empty texts and texts without a word have an empty set and stay alone, as do rows without doc_id (component_id null,
kept). Rows that repeat a doc_id are one document, whose text is the least of theirs. A very long text is one set in one task,
8 bytes a word. Ties don't arise: the least doc_id of a component stands for it. An empty table gives no rows. Columns other
than doc_id and text are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from findgrid.llm.common import packed, raw_texts, released, save, small_batches, unpacked
from findgrid.llm.components import components

BANDS, ROWS = 32, 4
PLACES = 1 << 21
PERCENT = 80
#: Members up to which all open pairs of a bucket are compared.
SMALL = 12
_K = BANDS * ROWS
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose result bits all depend on all bits (the splitmix finaliser)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_RNG = np.random.default_rng(20)
_BYTE = _RNG.integers(0, 1 << 64, 256, dtype=_U)
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[32, *range(9, 14)]] = True
_STEP, _STEP_INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
_POWERS: dict[str, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept for the next text."""
    have = _POWERS.get(str(base))
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, _U)
        have[0] = 1
        have = _POWERS[str(base)] = np.multiply.accumulate(have)
    return have[:n]


def shingle_set(text: bytes | str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of `words` words of a text, A-Z as a-z; fewer words: of the whole run."""
    raw = np.frombuffer(text.encode() if isinstance(text, str) else text or b"", np.uint8)
    if not len(raw):
        return np.empty(0, _U)
    inside = ~_IS_SPACE[raw]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).view(np.int8)))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.empty(0, _U)
    sums = np.concatenate([np.zeros(1, _U), np.cumsum(_BYTE[raw] * _power(_STEP, len(raw)), dtype=_U)])
    h = _mix((sums[end] - sums[start]) * _power(_STEP_INVERSE, len(raw))[start] + (end - start).astype(_U))
    n = min(words, len(h))
    out = h[: len(h) - n + 1]
    for k in range(1, n):
        out = _mix(out * _U(3) + h[k : len(h) - n + 1 + k])
    return np.unique(out + _U(n))


_CIRCLE: list[np.ndarray] = []


def signature(s: np.ndarray) -> np.ndarray:
    """The circulant MinHash of a non-empty set: coordinate k is the least number at the set's places shifted by k."""
    if not _CIRCLE:
        p = np.random.default_rng(21).permutation(PLACES).astype(np.int32)
        _CIRCLE.append(np.lib.stride_tricks.sliding_window_view(np.concatenate([p, p[:_K]]), _K))
    at = (_mix(s ^ _U(0xA5A5A5A5A5A5A5A5)) >> _U(43)).astype(np.int64)
    best = None
    for i in range(0, len(at), 2048):
        least = _CIRCLE[0][at[i : i + 2048]].min(axis=0)
        best = least if best is None else np.minimum(best, least)
    return best


def _forget() -> None:
    _CIRCLE.clear()
    _POWERS.clear()


def _bands(sig: np.ndarray) -> np.ndarray:
    rows = sig.astype(_U).reshape(BANDS, ROWS)
    h = np.arange(BANDS, dtype=_U)
    for r in range(ROWS):
        h = _mix(h * _U(5) + rows[:, r])
    return h.view(np.int64)


_INT64, _KEYS = pa.int64(), ("doc_id", "n_shingles", "key1", "key2")


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """Rows (doc_id, n_shingles, key1, key2, bands) of each row; the keys tell sets apart, bands is empty for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc_id, text in zip(b.column("doc_id").to_pylist(), raw_texts(b.column("text")), strict=True):
                s = shingle_set(text, words)
                k1, k2 = (int(_mix(s + _U(c)).sum(dtype=_U).view(np.int64)) for c in (1, 2))
                rows.append((doc_id, len(s), k1, k2, _bands(signature(s)) if len(s) else np.empty(0, np.int64)))
            ends = pa.array(np.cumsum([0, *(len(r[4]) for r in rows)]), pa.int32())
            bands = pa.ListArray.from_arrays(ends, pa.array(np.concatenate([r[4] for r in rows] or [np.empty(0, np.int64)]), _INT64))
            yield pa.RecordBatch.from_arrays([*(pa.array([r[i] for r in rows], _INT64) for i in range(4)), bands], [*_KEYS, "bands"])

    return small_batches(docs).select("doc_id", "text").mapInArrow(released(run, _forget), "doc_id long, n_shingles long, key1 long, key2 long, bands array<long>")


def _sets(z: DataFrame, words: int) -> DataFrame:
    """Rows (doc, set) of packed documents (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for b in batches:
            sets = [shingle_set(unpack.decompress(t), words).tobytes() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(sets, pa.binary())], ["doc", "set"])

    return small_batches(z).mapInArrow(released(run, _forget), "doc long, set binary")


def similar(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows come by a: its set is read once for all its partners that come in a row
        at, u = None, np.empty(0, _U)
        for p in batches:
            ok = []
            for a, x, y in zip(p.column("a").to_pylist(), p.column("x"), p.column("y"), strict=True):
                if a != at:
                    at, u = a, np.frombuffer(x.as_py(), _U)
                v = np.frombuffer(y.as_buffer(), _U)
                place = np.searchsorted(u, v)
                both = int((u[np.minimum(place, len(u) - 1)] == v).sum()) if len(u) else 0
                ok.append(100 * both >= percent * (len(u) + len(v) - both))
            yield p.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    with_b = small_batches(pairs).select("a", "b").join(sets.select(F.col("doc").alias("b"), F.col("set").alias("y")), "b")
    return with_b.join(sets.select(F.col("doc").alias("a"), F.col("set").alias("x")), "a").select("a", "b", "x", "y").mapInArrow(released(run), "a long, b long")


def _prefix_pairs(docs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of documents (doc, n, comp) of different components that can have the similarity, by prefixes and positions.

    All sets are read in one order, elements that few documents have first. Sets of sizes m and n with the similarity share
    t = percent * (m + n) / (100 + percent) elements, so the first element they share is among the first m - t + 1 of one and
    n - t + 1 of the other. Changes that a copy has alone come first in that order and fill the prefix of a distant copy, so
    copies of one text that aren't similar don't meet, however many there are."""

    def elements(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            for doc, n, comp, x in zip(p["doc"], p["n"], p["comp"], p["set"], strict=True):
                yield pd.DataFrame({"doc": doc, "n": n, "comp": comp, "e": np.frombuffer(x, np.int64)})

    rows = save(docs.join(sets, "doc").mapInPandas(released(elements), "doc long, n long, comp long, e long"), "elements")
    often = rows.groupBy("e").agg(F.count("*").alias("df")).filter("df > 1")
    # an element of one document can't be shared, but it takes its place at the front
    at = F.row_number().over(Window.partitionBy("doc").orderBy("df", "e")) - 1
    placed = rows.join(often, "e", "left").withColumn("df", F.coalesce("df", F.lit(1))).withColumn("at", at).filter(F.col("at") <= F.col("n") - F.ceil(F.col("n") * percent / 100)).filter("df > 1")
    x = placed.select("e", F.col("doc").alias("a"), F.col("n").alias("na"), F.col("comp").alias("ca"), F.col("at").alias("pa"))
    y = placed.select("e", F.col("doc").alias("b"), F.col("n").alias("nb"), F.col("comp").alias("cb"), F.col("at").alias("pb"))
    t = F.ceil(percent * (F.col("na") + F.col("nb")) / (100 + percent))
    on = (x["e"] == y["e"]) & (F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & (F.col("pa") <= F.col("na") - t) & (F.col("pb") <= F.col("nb") - t)
    return x.join(y, on).select("a", "b").distinct()


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = PERCENT, small: int = SMALL) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id, kept), one for each row of docs."""
    if not docs.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("c")).filter("c > 1").isEmpty():
        one = docs.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("text").alias("text"))
        found = save(near_duplicates(one, words, percent, small), "once")
        without = near_duplicates(docs.filter("doc_id IS NULL"), words, percent, small)
        return docs.select("doc_id").join(found, "doc_id").unionByName(without)
    sig = save(signatures(docs, words), "signatures")
    full = sig.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    # sums are written before they meet their rows, so that both sides of the join are plain shuffles, whose hot keys Spark splits
    classes = save(full.groupBy("key1", "key2").agg(F.min("doc_id").alias("rep")), "sums")
    member = save(full.select("doc_id", "n_shingles", "key1", "key2").join(classes, ["key1", "key2"]).select("doc_id", "n_shingles", "rep"), "classes")
    reps = member.filter("doc_id = rep").select("doc_id").distinct()
    rows = full.join(reps, "doc_id").select(F.col("doc_id").alias("doc"), F.col("n_shingles").alias("n"), F.explode("bands").alias("bucket")).distinct()
    lead = save(rows.groupBy("bucket").agg(F.min("doc").alias("lead"), F.count("*").alias("c")).filter("c > 1"), "sums")
    inside = save(rows.join(lead, "bucket"), "buckets")  # (bucket, doc, n, lead, c): documents that share a bucket
    wanted = inside.select(F.col("doc").alias("doc_id")).distinct()
    sets = save(_sets(packed(docs.select("doc_id", "text").filter("text IS NOT NULL")).join(wanted, "doc_id"), words), "sets")
    # every document and the leader that it meets most often
    met = inside.filter("lead <> doc").groupBy("doc", "lead").agg(F.count("*").alias("k")).groupBy("doc").agg(F.max(F.struct("k", (-F.col("lead")).alias("m"))).alias("x"))
    links = save(similar(met.select((-F.col("x.m")).alias("a"), F.col("doc").alias("b")), sets, percent), "linked")
    comps = components(links)

    # buckets whose members are not yet one component
    r = inside.join(comps.select(F.col("node").alias("doc"), "component"), "doc", "left").select("bucket", "doc", "n", "c", F.coalesce("component", "doc").alias("comp"))
    mixed = save(r.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("bucket"), "sums")
    open_ = save(r.join(mixed, "bucket"), "open")
    few = open_.filter(F.col("c") <= small)
    x = few.select("bucket", F.col("doc").alias("a"), F.col("n").alias("na"), F.col("comp").alias("ca"))
    y = few.select("bucket", F.col("doc").alias("b"), F.col("n").alias("nb"), F.col("comp").alias("cb"))
    on = (x["bucket"] == y["bucket"]) & (F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & (100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    near = x.join(y, on).select("a", "b")
    far = _prefix_pairs(open_.filter(F.col("c") > small).select("doc", "n", "comp").distinct(), sets, percent)
    found = save(similar(near.unionByName(far).distinct(), sets, percent), "linked")
    if not found.isEmpty():
        comps = components(links.unionByName(found))
    ids = member.join(comps.select(F.col("node").alias("rep"), "component"), "rep", "left").select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
    alone = sig.filter("n_shingles = 0 OR doc_id IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return ids.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep(docs: DataFrame, words: int = 5, percent: int = PERCENT) -> DataFrame:
    """One document of each group of near copies, with its columns: the one of least doc_id, once if its row is repeated."""
    kept = save(near_duplicates(docs, words, percent).filter("kept AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("copies")), "kept")
    once = unpacked(packed(docs).join(kept.select("doc_id"), "doc_id", "left_semi"))
    if not kept.filter("copies > 1").isEmpty():  # of the rows of one doc_id one with the text that stood for it
        least = once.groupBy("doc_id").agg(F.min("text").alias("least"))
        once = once.join(least, "doc_id").filter(F.col("text").eqNullSafe(F.col("least"))).dropDuplicates(["doc_id"]).select(docs.columns)
    return once.unionByName(docs.filter("doc_id IS NULL"))
