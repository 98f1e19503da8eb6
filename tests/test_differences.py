"""Line differences against a longest common subsequence, and the interval join against all pairs."""

import random
import time

import numpy as np
from pyspark.sql import functions as F

from findgrid.functions import codes
from findgrid.operators import findings as fs


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev = 0
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], prev + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def check(a, b):
    runs = codes.edit_runs(np.array(a, np.int64), np.array(b, np.int64))
    i = k = same = 0
    for op, at, n in runs:
        assert at == (k if op == "insert" else i) and n > 0
        if op == "equal":
            assert a[i : i + n] == b[k : k + n]
            same += n
        i, k = i + n * (op != "insert"), k + n * (op != "delete")
    assert (i, k) == (len(a), len(b))
    return same


def test_edit_runs_are_shortest():
    r = random.Random(5)
    for n in range(600):
        size = r.choice((2, 3, 8, 50))
        a = [r.randrange(size) for _ in range(r.randrange(0, 40))]
        b = [r.randrange(size) for _ in range(r.randrange(0, 40))] if n % 3 else [x for x in a if r.random() < 0.8]
        assert check(a, b) == lcs(a, b), (a, b)


def test_long_texts_with_few_differences():
    r, t = random.Random(6), time.time()
    a = [r.randrange(1000) for _ in range(100_000)]
    b = [x for i, x in enumerate(a) if i % 1009] + a[:50]
    assert check(a, a) == 100_000 and check(a, b) >= len(b) - 50
    assert check([0] * 30_000, [0] * 20_000) == 20_000
    assert time.time() - t < 60


def test_line_diff_of_nulls_and_texts(spark):
    rows = [("a\nb\nc", "a\nx\nc"), (None, ""), ("a", None), ("x\n" * 3, "x\n" * 2), ("same", "same")]
    got = spark.createDataFrame(rows, "a string, b string").select(codes.line_diff("a", "b").alias("d")).collect()
    assert [[tuple(x) for x in r.d] for r in got] == [
        [("equal", "a"), ("delete", "b"), ("insert", "x"), ("equal", "c")], [("equal", "")], [("delete", "a"), ("insert", "")],
        [("equal", "x"), ("equal", "x"), ("delete", "x"), ("equal", "")], [("equal", "same")],
    ]


def test_intermediates_equal_all_pairs(spark):
    r = random.Random(7)
    f = [(r.choice("ab"), r.randrange(0, 300), r.choice(("SQL injection", "Debug Mode", "Token leak", "Weak hash"))) for _ in range(400)] + [(None, 5, "x"), ("a", None, "x"), ("a", 9, None)]
    ends = [(k, r.choice("abc"), *sorted((r.randrange(0, 300), r.randrange(0, 300)))) for k in range(60)] + [(60, "a", 0, 1_000_000), (61, "a", 7, 7), (62, "b", 7, 8)]
    fd = spark.createDataFrame(f, "file_path string, line_number long, title string")
    ed = spark.createDataFrame(ends, "chain_id long, file_path string, lo long, hi long")
    got = {}
    for x in fs.intermediates(ed, fd, 5).collect():
        got.setdefault(x.chain_id, []).append((x.step, x.line, x.between_title))
    themed = lambda t: any(k in (t or "").lower() for k in fs.THEME)
    for k, p, lo, hi in ends:
        want = sorted((not themed(t), n, t or "") for q, n, t in f if q == p and n is not None and lo < n < hi)[:3]
        assert [(n, t) for _, n, t in sorted(got.get(k, []), key=lambda s: s[0])] == [(n, t or None) for _, n, t in want]
    assert fs.intermediates(ed.limit(0), fd, 5).count() == 0 and fs.intermediates(ed, fd, 2).count() == 0
    plan = fs.intermediates(ed, fd.filter(F.col("title").isNotNull()), 5)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
