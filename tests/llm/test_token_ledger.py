"""The ledger of token counts: buckets read, a crash before the mark, compaction and what it leaves."""

import os
import random

import pytest
from pyspark.sql import functions as F

from findgrid.llm import tokencounts


def rows(spark, *x):
    return spark.createDataFrame(list(x), tokencounts.BATCH)


def totals(r):
    return sorted((x.source, x.docs, x.tokens) for x in r.totals().collect())


def test_a_small_batch_reads_few_files(spark, tmp_path, monkeypatch):
    r = tokencounts.Rollup(spark, str(tmp_path))
    r.apply(1, rows(spark, *(("put", i, "t", "a", "en", i) for i in range(2000))))
    seen = []
    real = tokencounts.Rollup.ledger

    def watched(self, buckets=None):
        seen.append(buckets)
        return real(self, buckets)

    monkeypatch.setattr(tokencounts.Rollup, "ledger", watched)
    r.apply(2, rows(spark, ("put", 7, "t", "b", "en", 1), ("delete", 9, "t", None, None, 0), ("put", 5000, "t", "b", "en", 2)))
    assert totals(r) == [("a", 1998, sum(range(2000)) - 16), ("b", 2, 3)]
    assert len(seen) == 1 and len(seen[0]) <= 3
    base = r._of_committed("ledger", tokencounts.LEDGER)
    files = lambda d: d.select(F.input_file_name()).distinct().count()
    few = base.filter(F.col("bucket").isin(seen[0]))
    assert files(base) >= 60 and files(few) <= 6
    assert "PartitionFilters: [bucket" in few._jdf.queryExecution().executedPlan().toString().replace("isnotnull(", "").split("part#")[0] or "bucket#" in few._jdf.queryExecution().executedPlan().toString().split("PartitionFilters:")[1][:40]


def test_a_crash_before_the_mark_changes_nothing(spark, tmp_path):
    r = tokencounts.Rollup(spark, str(tmp_path), buckets=4)
    r.apply(1, rows(spark, ("put", 1, "t", "a", "en", 10)))
    batch = rows(spark, ("put", 1, "t", "b", "en", 4), ("put", 2, "t", "a", "en", 1))
    r.apply(2, batch)
    for f in os.listdir(tmp_path / "commits" / "b2"):  # as if the job had ended between the deltas and the mark
        os.remove(tmp_path / "commits" / "b2" / f)
    os.rmdir(tmp_path / "commits" / "b2")
    again = tokencounts.Rollup(spark, str(tmp_path), buckets=9)
    assert again.buckets == 4 and totals(again) == [("a", 1, 10)]
    assert again.apply(2, batch) and totals(again) == [("a", 1, 1), ("b", 1, 4)] and not again.apply(2, batch)


def test_compaction_and_vacuum_keep_state_and_history(spark, tmp_path):
    rnd, r, know = random.Random(8), tokencounts.Rollup(spark, str(tmp_path), compact_every=3, buckets=4), {}
    for k in range(1, 9):
        part = [(rnd.choice(["put", "put", "delete"]), d, "t", rnd.choice("ab"), "en", rnd.randint(0, 9)) for d in rnd.sample(range(20), 8)]
        r.apply(k, rows(spark, *part))
        for op, d, _, s, _, n in part:
            know.pop(d, None)
            if op == "put":
                know[d] = (s, n)
    want = sorted((s, len(v), sum(v)) for s in "ab" if (v := [n for t, n in know.values() if t == s]))
    assert totals(r) == want
    before = len(os.listdir(tmp_path / "ledger"))
    r.compact()
    r.vacuum()
    assert totals(r) == want and [x for x in os.listdir(tmp_path / "ledger") if x[0] == "p"] == ["part=base8"] and before > 1
    assert [x for x in os.listdir(tmp_path / "commits") if x[0] == "b"] == ["base8"]
    assert not r.apply(3, rows(spark)) and r.apply(9, rows(spark)) and totals(r) == want
    with pytest.raises(ValueError):
        r.apply(0, rows(spark))
