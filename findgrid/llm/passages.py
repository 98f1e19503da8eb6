"""Repeated passages: every byte that a 50-byte string covers which also starts in a document with a smaller doc_id.

A suffix array of the whole corpus fits no task, so anchors deal its suffixes out. Each 50-byte window belongs to the least
hash among its 20-byte strings; the windows of one anchor are one block of bytes. Equal windows have equal anchors, so
documents meet by anchor:

1. Blocks go to shards by anchor. A block that occurs whole in a smaller document is settled there. Where different blocks
   share an anchor, one document of each block must show its bytes.
2. Those bytes are dealt by 35 bytes around the anchor, and sorted by the linear grouping suffix sorter; runs of suffixes
   that agree in 50 bytes give each window its least document.
3. Every document puts both answers together, and its covered bytes are removed.

Equal blocks in one batch go to a shard once, so a passage that a third of all documents share is as many rows as batches.
Whole-block answers rest on 64-bit hashes of at most 81 bytes; the rest compares bytes.

Null text: no bytes (strip() keeps it null). Texts under 50 bytes keep everything. Rows that repeat a doc_id don't count
against each other. Rows without doc_id come after all others and don't count against each other. Very long texts are cut to
stretches that overlap by a window. An empty table gives no rows. Extra columns are carried under other names, so they can't clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from findgrid.llm.common import packed, released, released_group, save, small_batches
from findgrid.llm.suffixes import suffix_array

WINDOW, ANCHOR, CONTEXT = 50, 20, 35
#: Bytes of text for each shard of anchors (about one anchor in 16 bytes), and of one suffix sort.
SHARD, SORT = 24 << 20, 1 << 18
#: Bytes of text of one batch of blocks, and of one stretch of a long text.
BATCH, STRETCH = 8 << 20, 1 << 19
#: Stands for no doc_id.
LAST = (1 << 63) - 1
_MADE = ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text")
_U = np.uint64
_BYTE = np.random.default_rng(50).integers(0, 1 << 64, 256, dtype=_U)
_ODD = np.random.default_rng(51).integers(0, 1 << 63, 8, dtype=_U) * _U(2) + _U(1)
_LOW = _U((1 << 20) - 1)
_STEP = 0xD1342543DE82EF95
_INVERSE = pow(_STEP, -1, 1 << 64)
_POWERS: list[np.ndarray] = []


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


def _powers(n: int = STRETCH + 2 * WINDOW) -> list[np.ndarray]:
    """Powers of the step and of its inverse, n at least, kept for the next call."""
    if not _POWERS or len(_POWERS[0]) < n:
        _POWERS.clear()
        for base in (_STEP, _INVERSE):
            p = np.full(n, base, _U)
            p[0] = 1
            _POWERS.append(np.multiply.accumulate(p))
    return _POWERS


def _forget() -> None:
    _POWERS.clear()


def blocks(raw: np.ndarray) -> tuple[np.ndarray, ...]:
    """Arrays by block of a text's bytes: first and last window start, anchor position, anchor hash, block hash."""
    parts = [_blocks(raw[i : i + STRETCH + WINDOW - 1], i) for i in range(0, max(1, len(raw) - WINDOW + 1), STRETCH)]
    return parts[0] if len(parts) == 1 else tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _blocks(raw: np.ndarray, at: int) -> tuple[np.ndarray, ...]:
    if len(raw) < WINDOW:
        return (*(np.empty(0, np.int64) for _ in range(3)), np.empty(0, _U), np.empty(0, _U))
    h1 = _BYTE[raw]
    h2 = h1[:-1] * _ODD[0] + h1[1:]
    h4 = h2[:-2] * _ODD[1] + h2[2:]
    h8 = h4[:-4] * _ODD[2] + h4[4:]
    h16 = h8[:-8] * _ODD[3] + h8[8:]
    h = _mix(h16[:-4] * _ODD[4] + h4[16:])  # of 20 bytes
    key = (h & ~_LOW) | np.arange(len(h), dtype=_U)
    m = key
    for s in (1, 2, 4, 8):
        m = np.minimum(m[:-s], m[s:])
    m = np.minimum(m[:-15], m[15:])  # of the 31 anchors of a window; the leftmost of equals
    own = (m & _LOW).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
    last = np.concatenate([first[1:] - 1, [len(own) - 1]])
    p = own[first]
    up, down = _powers()
    sums = np.concatenate([np.zeros(1, _U), np.cumsum(h1 * up[: len(h1)], dtype=_U)])
    stop = last + WINDOW
    b = _mix((sums[stop] - sums[first]) * down[first] + (stop - first).astype(_U) * _ODD[5] + h[p] * _ODD[6])
    return first + at, last + at, p + at, h[p], b


def _runs(keys: np.ndarray) -> np.ndarray:
    """Borders of runs of equal values."""
    return np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]]) if len(keys) else np.zeros(1, np.int64)


def _least(parts: np.ndarray, doc: np.ndarray, rid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of blocks sorted by (block, doc, rid), where parts marks those unlike the one before: the first of each row of the least
    document that has the block, and those of larger documents."""
    if not len(doc):
        return np.zeros(0, bool), np.zeros(0, bool)
    new = np.concatenate([[True], parts])
    least = np.maximum.accumulate(np.where(new, np.arange(len(doc)), 0))
    again = doc > doc[least]
    new[1:] |= ~again[1:] & (rid[1:] != rid[:-1])
    return new, again


def _answers(doc: np.ndarray, rid: np.ndarray, b: np.ndarray, kind: int) -> pd.DataFrame:
    """A row for each document: its block hashes as bytes."""
    o = np.lexsort((rid, doc))
    doc, rid, b = doc[o], rid[o], b[o]
    cut = np.concatenate([[0], np.flatnonzero((doc[1:] != doc[:-1]) | (rid[1:] != rid[:-1])) + 1, [len(doc)]]) if len(doc) else np.zeros(1, np.int64)
    raw = b.tobytes()
    return pd.DataFrame({"doc": doc[cut[:-1]], "rid": rid[cut[:-1]], "kind": np.full(len(cut) - 1, kind, np.int32), "b": [raw[8 * s : 8 * e] for s, e in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]})


_DEALT = "shard long, h binary, b binary, doc binary, rid binary, n binary"
_ANSWER = "doc long, rid long, kind int, b binary"
WHOLE, SHOW = 0, 1  # kinds of answers: the block is covered; its bytes are asked for


def _deal(shards: int):
    """Batches of texts to rows of blocks by shard; h is empty in rows of blocks that a smaller document of the batch settles."""

    def out(texts: list[tuple]) -> Iterator[pd.DataFrame]:
        got = [(doc, rid, *blocks(np.frombuffer(t, np.uint8))[3:]) for doc, rid, t in texts]
        sizes = [len(g[2]) for g in got]
        h, b = (np.concatenate([g[i] for g in got]) for i in (2, 3))
        doc, rid = (np.repeat(np.array([g[i] for g in got], np.int64), sizes) for i in (0, 1))
        o = np.lexsort((rid, doc, b))
        h, b, doc, rid = h[o], b[o], doc[o], rid[o]
        new, again = _least(b[1:] != b[:-1], doc, rid)
        shard = ((h >> _U(32)) % _U(shards)).astype(np.int64)
        rows = []
        for pick, here in ((new, True), (again, False)):
            idx = np.flatnonzero(pick)
            # settled rows may go anywhere: by document, so that no shard gets them all
            where = shard[idx] if here else doc[idx] % shards
            o = np.lexsort((rid[idx], doc[idx], where))
            idx, where = idx[o], where[o]
            cut = _runs(where)
            for s, e in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                i = idx[s:e]
                d = np.concatenate([[0], np.flatnonzero((doc[i][1:] != doc[i][:-1]) | (rid[i][1:] != rid[i][:-1])) + 1, [len(i)]])
                rows.append((int(where[s]), h[i].astype(np.uint32).tobytes() if here else b"", b[i].tobytes(), doc[i][d[:-1]].tobytes(), rid[i][d[:-1]].tobytes(), np.diff(d).astype(np.uint32).tobytes()))
        yield pd.DataFrame(rows, columns=["shard", "h", "b", "doc", "rid", "n"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        have, size = [], 0
        for batch in batches:
            for doc, rid, text in zip(batch["doc_id"], batch["rid"], batch["text"], strict=True):
                raw = (text or "").encode("utf-8", "surrogatepass")
                if len(raw) >= WINDOW:
                    have.append((doc, rid, raw))
                    size += len(raw)
                if size >= BATCH:
                    yield from out(have)
                    have, size = [], 0
        if have:
            yield from out(have)

    return run


def _settle(rows: pd.DataFrame) -> pd.DataFrame:
    """Of one shard: answers for blocks that a smaller document has whole, and for the least document of each block (all rows of
    its doc_id) whose anchor has several blocks."""
    parts: dict[str, list] = {k: [] for k in ("h", "b", "doc", "rid")}
    done = []
    for h, b, doc, rid, n in zip(rows["h"], rows["b"], rows["doc"], rows["rid"], rows["n"], strict=True):
        n = np.frombuffer(n, np.uint32)
        b, doc, rid = np.frombuffer(b, _U), np.repeat(np.frombuffer(doc, np.int64), n), np.repeat(np.frombuffer(rid, np.int64), n)
        if len(h):
            for k, v in (("h", np.frombuffer(h, np.uint32)), ("b", b), ("doc", doc), ("rid", rid)):
                parts[k].append(v)
        else:
            done.append(_answers(doc, rid, b, WHOLE))
    if parts["h"]:
        h, b, doc, rid = (np.concatenate(parts.pop(k)) for k in ("h", "b", "doc", "rid"))
        o = np.argsort(h, kind="stable")  # most anchors are alone; leave them out before the costly sort
        hs = h[o]
        same = np.zeros(len(h), bool)
        same[1:] |= hs[1:] == hs[:-1]
        same[:-1] |= hs[1:] == hs[:-1]
        o = o[same]
        h, b, doc, rid = h[o], b[o], doc[o], rid[o]
        o = np.lexsort((rid, doc, b, h))
        h, b, doc, rid = h[o], b[o], doc[o], rid[o]
        new, again = _least((b[1:] != b[:-1]) | (h[1:] != h[:-1]), doc, rid)
        done.append(_answers(doc[again], rid[again], b[again], WHOLE))
        hf, bf, df, rf = h[new], b[new], doc[new], rid[new]
        cut = _runs(hf)
        if len(hf):
            lo, hi = np.minimum.reduceat(df, cut[:-1]), np.maximum.reduceat(df, cut[:-1])
            show = np.repeat(lo != hi, np.diff(cut))
            done.append(_answers(df[show], rf[show], bf[show], SHOW))
    return pd.concat(done) if done else pd.DataFrame({"doc": [], "rid": [], "kind": [], "b": []})


def _pieces(shards: int):
    """Documents that are asked for blocks to rows (shard, key, doc, rid, pos, piece): windows that reach 15 bytes before the
    anchor go by the 35 bytes that end with it, the others by the 35 bytes that start with it."""
    before = CONTEXT - ANCHOR

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            rows = []
            for doc, rid, z, asked in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "rid", "text", "asked")), strict=True):
                if asked is None or z is None:
                    continue
                text = unpack.decompress(z)
                first, last, p, _, b = blocks(np.frombuffer(text, np.uint8))
                take = np.isin(b, np.frombuffer(b"".join(asked), _U))
                for f, e, a in zip(first[take].tolist(), last[take].tolist(), p[take].tolist(), strict=True):
                    for lo, hi, c in ((f, min(e, a - before), a - before), (max(f, a - before + 1), e, a)):
                        if lo <= hi:
                            key = int.from_bytes(hashlib.blake2b(text[c : c + CONTEXT], digest_size=8).digest(), "little", signed=True)
                            rows.append((key % shards, key, doc, rid, lo, text[lo : hi + WINDOW]))
            cols = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:5]), pa.array(cols[5], pa.binary())], ["shard", "key", "doc", "rid", "pos", "piece"])

    return run


def _sorted_windows(docs: np.ndarray, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Of pieces: (piece, offset) of each window that a piece of a smaller document has too, by a suffix array of all pieces."""
    joined = b"\0".join(texts) + b"\0"
    symbols = [c + 2 for c in joined]
    lengths = np.array([len(t) for t in texts])
    starts = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
    for e in (starts + lengths).tolist():
        symbols[e] = 1
    symbols.append(0)
    sa = np.array(suffix_array(symbols), np.int64)[1:]
    piece = np.searchsorted(starts, sa, "right") - 1
    off = sa - starts[piece]
    whole = off + WINDOW <= lengths[piece]
    sa, piece, off = sa[whole], piece[whole], off[whole]
    if not len(sa):
        return piece, off
    view = np.lib.stride_tricks.sliding_window_view(np.frombuffer(joined, np.uint8), WINDOW)
    new = np.ones(len(sa), bool)
    for i in range(1, len(sa), 1 << 16):
        j = slice(i, min(i + (1 << 16), len(sa)))
        new[j] = (view[sa[j]] != view[sa[j.start - 1 : j.stop - 1]]).any(1)
    at = np.flatnonzero(new)
    least = np.repeat(np.minimum.reduceat(docs[piece], at), np.diff(np.concatenate([at, [len(sa)]])))
    hit = docs[piece] > least
    return piece[hit], off[hit]


def _windows(doc: np.ndarray, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(piece, offset) of the covered windows of some keys' pieces: pieces are cut to the runs of windows whose hash two
    documents have, equal runs are settled by their least document, and the suffix array decides about the rest."""
    joined = np.frombuffer(b"".join(texts), np.uint8)
    lengths = np.array([len(t) for t in texts])
    starts = np.cumsum(lengths) - lengths
    up, down = _powers(len(joined) + 1)
    sums = np.concatenate([np.zeros(1, _U), np.cumsum(_BYTE[joined] * up[: len(joined)], dtype=_U)])
    n = lengths - WINDOW + 1
    piece = np.repeat(np.arange(len(texts)), n)
    off = np.arange(len(piece)) - np.repeat(np.cumsum(n) - n, n)
    at = starts[piece] + off
    h = _mix((sums[at + WINDOW] - sums[at]) * down[at])
    o = np.argsort(h)
    cut = _runs(h[o])
    d = doc[piece[o]]
    shared = np.zeros(len(h), bool)
    shared[o] = np.repeat(np.minimum.reduceat(d, cut[:-1]) != np.maximum.reduceat(d, cut[:-1]), np.diff(cut))
    w = np.flatnonzero(shared)
    if not len(w):
        return w, w
    first = np.concatenate([[True], (w[1:] != w[:-1] + 1) | (piece[w[1:]] != piece[w[:-1]])])
    lo = w[first]
    size = np.diff(np.concatenate([np.flatnonzero(first), [len(w)]]))
    of, begin = piece[lo], off[lo]
    runs = [texts[p][b : b + k + WINDOW - 1] for p, b, k in zip(of.tolist(), begin.tolist(), size.tolist(), strict=True)]
    least: dict[bytes, int] = {}
    for i in np.argsort(doc[of], kind="stable").tolist():
        least.setdefault(runs[i], i)
    owner = np.array([least[r] for r in runs])
    again = doc[of] > doc[of[owner]]
    once = np.array(sorted(least.values()))
    k = size[again]
    out = [(np.repeat(of[again], k), np.repeat(begin[again], k) + np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k))]
    if len(once) > 1:
        r, x = _sorted_windows(doc[of[once]], [runs[i] for i in once.tolist()])
        # what holds for an owner holds for each run of its own document that equals it
        held = np.flatnonzero(~again)
        held = held[np.argsort(owner[held], kind="stable")]
        s = np.searchsorted(owner[held], once[r])
        n = np.searchsorted(owner[held], once[r], "right") - s
        alike = held[np.repeat(s, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        out.append((of[alike], begin[alike] + np.repeat(x, n)))
    return np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])


def _compare(rows: pd.DataFrame) -> pd.DataFrame:
    """Of one shard of pieces: rows (doc, rid, kind 2, positions of covered windows)."""
    o = np.argsort(rows["key"].to_numpy(), kind="stable")
    key, doc, rid, pos = (rows[c].to_numpy()[o] for c in ("key", "doc", "rid", "pos"))
    cut = _runs(key)
    keep = np.repeat(np.minimum.reduceat(doc, cut[:-1]) != np.maximum.reduceat(doc, cut[:-1]), np.diff(cut)) if len(key) else np.zeros(0, bool)
    o, key, doc, rid, pos = o[keep], key[keep], doc[keep], rid[keep], pos[keep]
    text = rows["piece"].to_numpy()[o].tolist()
    found = []
    # some keys at a time, each whole
    ends = _runs(key)[1:]
    sizes = np.cumsum([len(t) for t in text])
    at = 0
    while at < len(key):
        base = sizes[at - 1] if at else 0
        k = np.searchsorted(sizes[ends - 1], base + SORT)
        stop = int(ends[min(k, len(ends) - 1)])
        piece, off = _windows(doc[at:stop], text[at:stop])
        piece = piece + at
        found.append((doc[piece], rid[piece], pos[piece] + off))
        at = stop
    if not found:
        return pd.DataFrame({"doc": [], "rid": [], "kind": [], "b": []})
    return _answers(*(np.concatenate([f[i] for f in found]).astype(np.int64) for i in range(3)), 2)


def remove_repeats(docs: DataFrame, carry: tuple[str, ...] = (), text: bool = False) -> DataFrame:
    """Rows (doc_id, n_bytes, n_removed, n_spans, kept_sha256), one for each row of docs; with text also what is left of it,
    without characters that a cut went through, as `kept_text`, after the columns `carry` as c0, c1, ..."""
    rid = F.xxhash64("doc_id", "text").alias("rid")
    # no doc_id: after all others
    doc = F.coalesce("doc_id", F.lit(LAST)).cast("long").alias("doc_id")
    n = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    shards = max(8, -(-n // SHARD))
    src = small_batches(docs).select(doc, rid, "text")
    dealt = src.mapInPandas(released(_deal(shards), _forget), _DEALT)
    answers = dealt.groupBy("shard").applyInPandas(released_group(_settle), _ANSWER)
    answers = save(answers, "answers")
    kinds = dict(docs.dtypes)
    extra = [(f"c{i}", c) for i, c in enumerate(carry)]
    # both joins below take all columns of `small` on the same keys, so that its texts are shuffled once for both
    small = packed(docs.select(doc, rid, *(F.col(f"`{c}`").alias(k) for k, c in extra), "text"))
    asked = answers.filter(F.col("kind") == SHOW).groupBy(F.col("doc").alias("doc_id"), "rid").agg(F.collect_list("b").alias("asked"))
    pieces = small.join(asked, ["doc_id", "rid"], "left").mapInArrow(released(_pieces(shards), _forget), "shard long, key long, doc long, rid long, pos long, piece binary")
    starts = pieces.groupBy("shard").applyInPandas(released_group(_compare, _forget), _ANSWER)
    both = answers.filter(F.col("kind") == WHOLE).unionByName(starts)
    both = both.groupBy(F.col("doc").alias("doc_id"), "rid").agg(*(F.collect_list(F.when(F.col("kind") == k, F.col("b"))).alias(a) for k, a in ((WHOLE, "whole"), (2, "starts"))))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            out = []
            for z, whole, at in zip(*(batch.column(c).to_pylist() for c in ("text", "whole", "starts")), strict=True):
                raw = unpack.decompress(z) if z is not None else b""
                removed = spans = 0
                left = raw
                if whole or at:
                    a = np.frombuffer(raw, np.uint8)
                    edge = np.zeros(len(a) + 1, np.int32)
                    if whole:
                        first, last, _, _, b = blocks(a)
                        take = np.isin(b, np.frombuffer(b"".join(whole), _U))
                        np.add.at(edge, first[take], 1)
                        np.add.at(edge, last[take] + WINDOW, -1)
                    if at:
                        s = np.frombuffer(b"".join(at), np.int64)
                        np.add.at(edge, s, 1)
                        np.add.at(edge, s + WINDOW, -1)
                    gone = np.cumsum(edge[:-1]) > 0
                    removed = int(gone.sum())
                    spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if len(gone) else 0
                    left = a[~gone].tobytes()
                out.append((len(raw), removed, spans, hashlib.sha256(left).hexdigest(), (left if not removed else left.decode("utf-8", "ignore").encode()) if text and z is not None else None))
            cols = list(zip(*out, strict=True)) or [()] * 5
            made = [*(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string())]
            if text:
                made.append(pa.array(cols[4], pa.binary()).cast(pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(batch.column(k) for k, _ in extra), *made], ["doc_id", *(k for k, _ in extra), *_MADE[: len(made)]])

    schema = "doc_id long, " + "".join(f"{k} {kinds[c]}, " for k, c in extra) + "n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_text string" * text
    done = small.join(both, ["doc_id", "rid"], "left").mapInArrow(released(cut, _forget), schema)
    return done.withColumn("doc_id", F.when(F.col("doc_id") != LAST, F.col("doc_id")))


def strip(docs: DataFrame) -> DataFrame:
    """docs with the repeated passages taken out of text; a document of which nothing but white space is left goes, if it had
    more before."""
    others = tuple(c for c in docs.columns if c != "text")
    done = remove_repeats(docs, others, text=True)
    back = {c: F.col(f"c{i}").alias(c) for i, c in enumerate(others)}
    return done.filter("n_removed = 0 OR kept_text IS NULL OR kept_text RLIKE '[^\\\\x20\\\\x09-\\\\x0D]'").select(*(F.col("kept_text").alias(c) if c == "text" else back[c] for c in docs.columns))
