"""Packing by the length histogram: shortest pack first.

Every document becomes its token ids and an end id; documents over the capacity are cut into whole sequences and a rest.
The histogram of piece lengths (at most `capacity` numbers) is packed on the driver: lengths are placed longest first, each
into the pack with the most room or, where none has room, as many as fit into new ones, and packs of equal make-up are one
pattern with a count. Patterns are then joined back by rank: a piece's rank among the pieces of its length picks its pattern,
its sequence and its offset. Ranks come from counts of (length, bucket) cells, so that a length which most pieces share is
still numbered by many tasks.

Null and empty texts: the end id alone. Repeated rows are packed as often as they occur, rows without doc_id too. Very long
texts are tokenised in stretches and cut into whole sequences and a rest. Pieces of one length are interchangeable; they are
placed by (doc_id, start). An empty table gives no rows. Columns other than doc_id and text are not read, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from findgrid.llm.common import released, save, small_batches
from findgrid.llm.tokens import DEFAULT, word_ids

CAPACITY = 4096
END = 2
#: Rows of a (length, bucket) cell aimed at.
CELL = 20_000
_PIECE = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]


class Patterns(NamedTuple):
    """Slots of all patterns as arrays sorted by (length, first rank): pieces of `length` with ranks first..first+count*copies-1
    go to sequences base.., `copies` in each, the j-th of a sequence at offset + j * length. A length has as many slots as
    patterns it is in, a pattern at most sqrt(2 * capacity) lengths, and each length adds three patterns at most."""

    length: np.ndarray
    first: np.ndarray
    copies: np.ndarray
    base: np.ndarray
    offset: np.ndarray


def pack_histogram(histogram: dict[int, int], capacity: int = CAPACITY) -> Patterns:
    """Shortest-pack-first over length counts."""
    packs: list[dict[tuple, int]] = [{} for _ in range(capacity + 1)]  # by room left: make-up ((length, copies), ...) to count
    roomiest = 0

    def put(room: int, made: tuple, n: int) -> None:
        nonlocal roomiest
        packs[room][made] = packs[room].get(made, 0) + n
        roomiest = max(roomiest, room)

    for length in sorted(histogram, reverse=True):
        todo = histogram[length]
        while todo:
            # the shortest pack that exists, if the length fits at all
            while roomiest and not packs[roomiest]:
                roomiest -= 1
            if roomiest < length:
                # none: open as few as the rest of this length needs
                each = capacity // length
                if todo >= each:
                    put(capacity - each * length, ((length, each),), todo // each)
                if todo % each:
                    put(capacity - todo % each * length, ((length, todo % each),), 1)
                break
            room = roomiest
            fit, have = packs[room].popitem()
            # one piece to each of the shortest packs; several if there are more pieces than such packs
            each = max(1, min(room // length, todo // have))
            n = min(have, todo // each)
            if have > n:
                packs[room][fit] = have - n
            put(room - each * length, (*fit[:-1], (length, fit[-1][1] + each)) if fit[-1][0] == length else (*fit, (length, each)), n)
            todo -= each * n
    rows, base, used = [], 0, dict.fromkeys(histogram, 0)
    for p in packs:
        for made, count in p.items():
            at = 0
            for length, copies in made:
                rows.append((length, used[length], copies, base, at))
                used[length] += count * copies
                at += copies * length
            base += count
    rows.sort()
    return Patterns(*(np.array([r[i] for r in rows], np.int64) for i in range(5)))


def pieces(docs: DataFrame, tokenizer: str = DEFAULT, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """Rows (doc_id, start, length, ids_crc32, doc_tokens): each id of each document in exactly one piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, tail = word_ids(tokenizer), np.array([end], "<u4")
        for b in batches:
            of, start, length, crc, size = [], [], [], [], []
            for k, x in enumerate(ids.many(b.column("text"))):
                raw, n = np.concatenate([x, tail]).tobytes(), len(x) + 1
                for s in range(0, n, capacity):
                    of.append(k)
                    start.append(s)
                    length.append(min(capacity, n - s))
                    crc.append(zlib.crc32(raw[4 * s : 4 * (s + capacity)]))
                    size.append(n)
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(of, pa.int32())), *(pa.array(c, pa.int64()) for c in (start, length, crc, size))], _PIECE)
        ids.clear()

    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(released(run), ", ".join(f"{c} long" for c in _PIECE))


def pack(docs: DataFrame, tokenizer: str = DEFAULT, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """Rows (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset)."""
    # a number of its own for each row parts repeated rows; the table is written once, so the numbers stay
    p = save(pieces(docs, tokenizer, capacity, end).withColumn("row", F.monotonically_increasing_id()), "pieces")
    n = p.agg(F.count("*").alias("n")).first()["n"]
    buckets = max(16, -(-n // CELL))
    p = p.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start", "row"), F.lit(buckets)))
    cells = p.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("length", "bucket", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    slots = pack_histogram({r["length"]: r["n"] for r in cells.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity)
    bounds = np.searchsorted(slots.length, np.arange(capacity + 2))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = (b.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            slot = np.empty(b.num_rows, np.int64)
            for x in np.unique(length):
                of = length == x
                lo, hi = bounds[x], bounds[x + 1]
                slot[of] = lo + np.searchsorted(slots.first[lo:hi], rank[of], "right") - 1
            k = rank - slots.first[slot]
            made = slots.base[slot] + k // slots.copies[slot], slots.offset[slot] + k % slots.copies[slot] * length
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in _PIECE), *map(pa.array, made)], [*_PIECE, "sequence_id", "offset"])

    w = Window.partitionBy("length", "bucket").orderBy("doc_id", "start", "row")
    ranked = p.withColumn("rn", F.row_number().over(w)).join(cells.select("length", "bucket", "before"), ["length", "bucket"])
    ranked = ranked.select(*_PIECE, (F.col("before") + F.col("rn") - 1).alias("rank"))
    return ranked.mapInArrow(released(place), ", ".join(f"{c} long" for c in (*_PIECE, "sequence_id", "offset")))
