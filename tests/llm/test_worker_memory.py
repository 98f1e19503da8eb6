"""Python workers are kept for later tasks, of which many share an executor: what they hold, and what one step takes, is bounded."""

import os

import numpy as np
import pandas as pd
import pytest

from findgrid.llm import minhash, mixing, passages


@pytest.fixture
def docs(spark):
    rows = [(i, "a" if i % 2 else None, f"w{i % 7} " * 5 + " ".join(f"w{j}" for j in range(i % 7, i % 7 + 60))) for i in range(64)]
    return spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(4).persist()


def held(spark):
    """Entries of the modules' tables in each worker that is kept."""

    def run(batches):
        for b in batches:
            yield pd.DataFrame({"n": [len(minhash._CIRCLE) + len(minhash._POWERS) + len(passages._POWERS)] * len(b), "pid": os.getpid()})

    return {(r.n, r.pid) for r in spark.range(64, numPartitions=32).mapInPandas(run, "n long, pid long").collect()}


def test_idle_workers_keep_no_tables(spark, docs):
    assert minhash.near_duplicates(docs).count() == 64
    assert {n for n, _ in held(spark)} == {0}
    assert passages.remove_repeats(docs).filter("n_removed > 0").count() > 0
    assert {n for n, _ in held(spark)} == {0}


def test_suffix_sorts_are_small(monkeypatch):
    r, sizes, plain = np.random.default_rng(1), [], passages._windows
    text = [r.integers(97, 123, 60, np.uint8).tobytes() for _ in range(9000)]
    rows = pd.DataFrame([(k, d, d, 0, t) for k, t in enumerate(text) for d in (1, 2)], columns=["key", "doc", "rid", "pos", "piece"])
    monkeypatch.setattr(passages, "_windows", lambda doc, texts: sizes.append(sum(map(len, texts))) or plain(doc, texts))
    found = passages._compare(rows)
    assert sum(sizes) == 2 * 60 * 9000 and max(sizes) < 1 << 19  # a sort takes about 100 bytes for each
    assert found["doc"].tolist() == [2] * len(found) and sum(map(len, found["b"])) == 8 * 11 * 9000


def test_the_plan_of_a_mix_starts_no_other_workers(spark, docs):
    plan = mixing.mix(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert "LocalRelation" in plan and "LogicalRDD" not in plan
