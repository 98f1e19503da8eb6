"""Small per-row helpers that expressions lack: one-time codes and line differences, over Arrow batches."""

from __future__ import annotations

import base64
import hashlib
import hmac
import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf


def totp_at(secret: bytes, seconds: int, digits: int = 6, step: int = 30) -> str:
    """RFC 6238 code with HMAC-SHA-1."""
    mac = hmac.new(secret, struct.pack(">Q", seconds // step), hashlib.sha1).digest()
    at = mac[-1] & 15
    return str((struct.unpack(">I", mac[at : at + 4])[0] & 0x7FFFFFFF) % 10**digits).zfill(digits)


def totp(secret, seconds) -> Column:
    """Code of a base-32 secret at a time in seconds; null for a secret that can't be read."""

    def one(s, t):
        try:
            return totp_at(base64.b32decode(s.strip().replace(" ", "").upper() + "=" * (-len(s.strip()) % 8)), int(t))
        except (ValueError, AttributeError):
            return None

    def batch(secret: pd.Series, seconds: pd.Series) -> pd.Series:
        return pd.Series([one(s, t) for s, t in zip(secret, seconds, strict=True)])

    return pandas_udf(batch, "string")(secret, seconds)


_OUT = -(1 << 40)  # a diagonal that no path reaches


def _extended(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """x after all equal lines that follow (x, y), for many points at once."""
    x = x.copy()
    left = np.where(x < 0, 0, np.minimum(len(a) - x, len(b) - y))
    on, size = np.flatnonzero(left > 0), 8
    done = np.zeros(len(x), np.int64)
    while len(on):
        j = np.arange(size)
        at = done[on, None] + j
        inside = at < left[on, None]
        same = inside & (a[np.minimum(x[on, None] + at, len(a) - 1)] == b[np.minimum(y[on, None] + at, len(b) - 1)])
        more = np.where(same.all(1), size, same.argmin(1))
        done[on] += more
        on, size = on[more == size], min(4 * size, 1 << 14)
    return x + done


def _middle(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """A point that a shortest edit path of a and b passes, found from both ends; neither is empty, and they differ at both ends."""
    n, m = len(a), len(b)
    delta, zero = n - m, n + m + 2
    far = [np.full(2 * zero + 1, _OUT, np.int64) for _ in range(2)]  # by diagonal: furthest x from the start, and from the end
    sides = ((a, b), (a[::-1], b[::-1]))
    for d in range((n + m + 1) // 2 + 1):
        for side, (p, q) in enumerate(sides):
            v = far[side]
            k = np.arange(-d, d + 1, 2)
            k = k[(k >= -m) & (k <= n)]
            if d == 0:
                x = np.zeros(1, np.int64)
            else:
                down, right = v[k + 1 + zero], v[k - 1 + zero] + 1
                down = np.where((down >= 0) & (down - k <= m), down, _OUT)  # an inserted line
                x = np.maximum(down, np.where((right >= 1) & (right <= n), right, _OUT))
            x = _extended(p, q, x, x - k)
            v[k + zero] = x
            other = far[1 - side][delta - k + zero] if side == 0 else far[0][delta - k + zero]
            met = np.flatnonzero((x >= 0) & (other >= 0) & (x + other >= n))
            if len(met):
                i = met[0]
                return (int(x[i]), int(x[i] - k[i])) if side == 0 else (n - int(x[i]), m - int(x[i] - k[i]))
    raise AssertionError("paths always meet")


def matches(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of a longest common subsequence of two arrays of line hashes, by Myers' O(ND) search from both ends in linear space.
    Lines that only one side has are left out first: they can't be matched."""
    ia, ib = np.flatnonzero(np.isin(a, b)), np.flatnonzero(np.isin(b, a))
    x, y = a[ia], b[ib]
    got: list[tuple[int, int, int]] = []
    todo = [(0, len(x), 0, len(y))]
    while todo:
        i, j, k, l = todo.pop()
        size = min(j - i, l - k)
        if not size:
            continue
        differ = np.flatnonzero(x[i : i + size] != y[k : k + size])
        head = int(differ[0]) if len(differ) else size
        if head:
            got.append((i, k, head))
            i, k = i + head, k + head
        size = min(j - i, l - k)
        differ = np.flatnonzero(x[j - size : j][::-1] != y[l - size : l][::-1]) if size else []
        tail = int(differ[0]) if len(differ) else size
        if tail:
            got.append((j - tail, l - tail, tail))
            j, l = j - tail, l - tail
        if i < j and k < l:
            s, t = _middle(x[i:j], y[k:l])
            todo += [(i, i + s, k, k + t), (i + s, j, k + t, l)]
    got.sort()
    flat = [np.concatenate([np.arange(g[c], g[c] + g[2]) for g in got] or [np.empty(0, np.int64)]).astype(np.int64) for c in (0, 1)]
    return ia[flat[0]], ib[flat[1]]


def edit_runs(a: np.ndarray, b: np.ndarray) -> list[tuple[str, int, int]]:
    """(equal, delete or insert, first place in its own text, number of lines), in order; deletes come before inserts."""
    ia, ib = matches(a, b)
    ends = np.flatnonzero((np.diff(ia) != 1) | (np.diff(ib) != 1)) + 1
    out, i, k = [], 0, 0
    for lo, hi in zip(np.concatenate([[0], ends]), np.concatenate([ends, [len(ia)]]), strict=True):
        s, t, size = (int(ia[lo]), int(ib[lo]), int(hi - lo)) if lo < hi else (len(a), len(b), 0)
        out += [("delete", i, s - i), ("insert", k, t - k), ("equal", s, size)]
        i, k = s + size, t + size
    out += [("delete", i, len(a) - i), ("insert", k, len(b) - k)]
    return [r for r in out if r[2]]


def line_diff(old: Column | str, new: Column | str) -> Column:
    """Lines of two texts as equal, delete and insert, in order. Python sees a hash for each line and gives back runs; the lines stay
    with Spark. A null text is one empty line, as an empty one is."""

    def batch(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([[{"op": o, "at": i, "n": n} for o, i, n in edit_runs(np.asarray(x, np.int64), np.asarray(y, np.int64))] for x, y in zip(a, b, strict=True)])

    lines = [F.split(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")), "\n") for c in (old, new)]
    runs = pandas_udf(batch, "array<struct<op: string, at: int, n: int>>")(*(F.transform(l, lambda x: F.xxhash64(x)) for l in lines))
    of = lambda r: F.slice(F.when(r["op"] == "insert", lines[1]).otherwise(lines[0]), r["at"] + 1, r["n"])
    return F.flatten(F.transform(runs, lambda r: F.transform(of(r), lambda x: F.struct(r["op"].alias("op"), x.alias("line")))))
