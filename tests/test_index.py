"""The saved index: equal to a search without one, pruned, kept up to date by segments; the shared folder without a setting."""

import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from findgrid.functions.shared import shared_dir
from findgrid.operators import index, search

TEXTS = {
    "src/login.py": "password check\nlogin handler for users\n" * 30,
    "src/db.py": "query builder\nconnection pool\n" * 80,
    "lib/util.js": "helper\n\nlogin",
    "docs/empty.md": "",
    "docs/blank.md": " \n\t\n",
    "big/long.txt": "word " * 60_000,
}


def table(spark, texts):
    return spark.createDataFrame(list(texts.items()), "path string, content string")


def plain(spark, texts, question):
    c = search.chunks(table(spark, texts)).withColumn("key", F.struct("path", "ord"))
    return [(r.key.path, r.key.ord, round(r.score, 9)) for r in search.search(c, "key", "content", "path", question).collect()]


def test_index_equals_plain_search_before_and_after_edits(spark):
    i = index.Index(spark, f"{shared_dir(spark)}/test-index")
    assert i.search("login").count() == 0
    assert i.update(table(spark, TEXTS)) == 1
    for q in ("login password", "word pool pool", "src connection", "the", "nothing-here"):
        assert [(r.path, r.ord, round(r.score, 9)) for r in i.search(q).collect()] == plain(spark, TEXTS, q)
    old = {f for f in i.table("chunks").inputFiles()}
    assert i.update(table(spark, TEXTS)) == 1  # nothing changed
    after = {k: v for k, v in TEXTS.items() if k != "src/db.py"} | {"lib/util.js": "login login pool", "new/a.go": "pool party"}
    assert i.update(table(spark, after)) == 2
    for q in ("login password", "word pool pool", "lib party", "helper"):
        assert [(r.path, r.ord, round(r.score, 9)) for r in i.search(q).collect()] == plain(spark, after, q)
    new = {f for f in i.table("chunks").inputFiles()} - old
    assert old <= set(i.table("chunks").inputFiles()) and len(new) == 2  # only the two edited files were chunked again
    fresh = index.Index(spark, f"{shared_dir(spark)}/test-index-fresh")
    fresh.update(table(spark, after))
    assert sorted(map(tuple, i.terms().collect())) == sorted(map(tuple, fresh.terms().collect()))
    assert tuple(i.status().collect()[0])[:4] == tuple(fresh.status().collect()[0])[:4]
    got = i.contents(i.search("party")).collect()
    assert [r.content for r in got] == ["pool party"]
    assert i.update(table(spark, {"new/a.go": "other"}), whole=False) == 3  # other files stay
    assert {r.path for r in i.live().collect()} == set(after)


def test_index_reads_only_the_buckets_of_the_question(spark):
    i = index.Index(spark, f"{shared_dir(spark)}/test-index-pruned")
    i.update(table(spark, {f"f{k}": " ".join(f"w{j}" for j in range(k, k + 50)) for k in range(60)}))
    everything = len(i.table("postings").inputFiles())
    plan = i.search("w7 w31")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "bucket#" in plan.split("PartitionFilters: [")[1][:60]
    asked = spark.createDataFrame([("w7",), ("w31",)], "t string").select(F.pmod(F.hash("t"), F.lit(index.TERM_BUCKETS))).distinct().count()
    read = i.table("postings").filter(F.col("bucket").isin([r[0] for r in spark.createDataFrame([("w7",), ("w31",)], "t string").select(F.pmod(F.hash("t"), F.lit(index.TERM_BUCKETS))).collect()]))
    assert asked <= 2 and read.select("bucket").distinct().count() == asked and everything > 20


def test_an_update_that_was_cut_short_is_not_seen(spark):
    i = index.Index(spark, f"{shared_dir(spark)}/test-index-cut")
    i.update(table(spark, {"a": "apple pear"}))
    broken = index.Index(spark, i.root)
    real = index.Index._write

    def fail(self, df, name, k):
        if name == "files":
            raise RuntimeError("lost")
        real(self, df, name, k)

    broken._write = fail.__get__(broken)
    with pytest.raises(RuntimeError):
        broken.update(table(spark, {"a": "plum", "b": "apple"}))
    assert [r.path for r in i.search("apple").collect()] == ["a"]
    assert i.update(table(spark, {"a": "plum", "b": "apple"})) == 2
    assert [r.path for r in i.search("apple").collect()] == ["b"]
    assert sorted(map(tuple, i.terms().collect())) == [("apple", 1), ("plum", 1)]


def test_tables_are_saved_without_a_setting_and_go_with_the_session(tmp_path):
    code = """
import os, sys
from pyspark.sql import SparkSession
s = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
assert s.conf.get("spark.checkpoint.dir", None) is None
from findgrid.functions.shared import save_table, shared_dir
assert save_table(s.range(3), "t").count() == 3
print(shared_dir(s).replace("file:", ""))
"""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": root + os.pathsep + os.environ.get("PYTHONPATH", "")}
    done = subprocess.run([sys.executable, "-c", code], env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert not os.path.exists(done.stdout.strip().splitlines()[-1])
