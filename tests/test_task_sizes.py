"""What a task holds follows a fixed number of rows, whatever the number of shuffle partitions is."""

import pytest
from pyspark.sql import functions as F

from findgrid.functions import shared
from findgrid.operators import findings as fs
from findgrid.operators import flow
from findgrid.plans.fixtures import code_lines
from findgrid.plans.queries_findings import arrived, found
from findgrid.plans.queries_misc import session_findings

SF = "/root/testdata/sf0.001"


@pytest.fixture
def tasks(monkeypatch):
    monkeypatch.setattr(shared, "tasks_for", lambda spark, rows, most=shared.TASK_ROWS: 37)
    monkeypatch.setattr(fs, "tasks_for", shared.tasks_for)
    return 37


def test_number_of_tasks(spark):
    assert shared.tasks_for(spark, 0) == spark.sparkContext.defaultParallelism
    assert shared.tasks_for(spark, 10 * shared.TASK_ROWS + 1) == 11
    assert shared.dealt(spark.range(100), "id", most=10).rdd.getNumPartitions() == 10


def test_lines_are_dealt_out(spark, tasks):
    assert code_lines(spark, SF).rdd.getNumPartitions() == tasks


def test_findings_are_dealt_out_and_none_is_lost(spark, tasks):
    f = arrived(spark, SF)
    bare = f.limit(1).select(*(F.lit(None).cast(t).alias(c) if c in ("file_path", "line_number") else F.col(c) for c, t in f.dtypes)).withColumn("title", F.lit("no place")).withColumn("x", F.explode(F.array(*map(F.lit, range(5))))).drop("x")
    kept = fs.dedup(f.unionByName(bare))
    assert kept.rdd.getNumPartitions() >= 2 * tasks
    assert kept.filter("title = 'no place'").count() == 1 and kept.count() == fs.dedup(f).count() + 1
    ranked = [(-r.risk, r.seq) for r in fs.merge_and_rank(f).select("risk", "seq").collect()]
    assert ranked == sorted(ranked)


def test_files_and_functions_are_dealt_out_before_they_are_parsed(spark, tasks, monkeypatch):
    monkeypatch.setattr(flow, "tasks_for", shared.tasks_for, raising=False)
    seen = []
    for name in ("functions", "summaries"):
        parse = getattr(flow, name)
        monkeypatch.setattr(flow, name, lambda x, *a, parse=parse: seen.append(x.rdd.getNumPartitions()) or parse(x, *a))
    code = "def run(x):\n    cmd = request.args.get('c')\n    exec(cmd)\n"
    one = spark.createDataFrame([(f"f{i}.py", "py", code) for i in range(50)], "path string, ext string, content string").coalesce(1)
    assert flow.trace(one).count() == 50
    assert seen == [tasks, tasks]


def test_sessions_are_written_by_tasks_of_bounded_rows(spark, tasks, monkeypatch):
    read, merge = [], fs.session_merge
    monkeypatch.setattr(fs, "session_merge", lambda s, *a: read.append(s) or merge(s, *a))
    n = session_findings(spark, SF).agg(F.sum("n")).first()[0]
    assert len(read[0].inputFiles()) > tasks // 2  # a file for each task that has rows, not one for each shuffle partition
    assert n == found(spark, SF).filter("line_number % 3 <> 2").count()
