"""Every registered query with SQL gives DuckDB's rows on the smallest given tables."""

import json
import math
import os

import duckdb
import pytest

from findgrid.plans import registry
from findgrid.plans.fixtures import CODE_SQL

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(df):
    def plain(x):
        if x is None or (isinstance(x, float) and math.isnan(x)):
            return "null"
        return f"{x:.6g}" if isinstance(x, float) else str(x)

    cols = sorted(df.columns)
    return cols, sorted(tuple(plain(x) for x in r) for r in df[cols].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_matches(spark, duck, name):
    assert rows(registry.QUERIES[name](spark, SF).toPandas()) == rows(duck.sql(registry.ORACLE_SQL[name]).df())


def _sql(duck, name, what="count(*)"):
    return duck.sql(f"SELECT {what} FROM ({registry.ORACLE_SQL[name]})").fetchall()


def _code(duck, what):
    return duck.sql(f"{CODE_SQL} SELECT {what} FROM code").fetchall()


def _line_counts(rows):
    return {(x.doc_id, x.op): x.n for x in rows}


def _least_differences(duck):
    """Counts of equal, deleted and inserted lines of each document and its redacted text, by a longest common subsequence."""
    out = {}
    for i, old, new in duck.sql(f"SELECT doc_id, documents.text, r.text FROM documents JOIN ({registry.ORACLE_SQL['redact_documents']}) r USING (doc_id)").fetchall():
        a, b = (old or "").split("\n"), (new or "").split("\n")
        row = [0] * (len(b) + 1)
        for x in a:
            prev = 0
            for j, y in enumerate(b, 1):
                prev, row[j] = row[j], prev + 1 if x == y else max(row[j], row[j - 1])
        out |= {(i, op): n for op, n in (("equal", row[-1]), ("delete", len(a) - row[-1]), ("insert", len(b) - row[-1])) if n}
    return out


#: What must hold for the rows of queries that have no SQL, from DuckDB or from the texts themselves.
FACTS = {
    "sbom_cyclonedx": lambda r, d: len(json.loads(r[0].document)["components"]) == _sql(d, "sbom_components")[0][0],
    "sbom_spdx": lambda r, d: sorted(p["SPDXID"] for p in json.loads(r[0].document)["packages"]) == sorted(x for (x,) in _sql(d, "sbom_components", "spdx_id")),
    "sarif_document": lambda r, d: len(json.loads("".join(x.line for x in sorted(r, key=lambda x: (x.part, x.line.startswith(",")))))["runs"][0]["results"]) == _sql(d, "sarif_results")[0][0],
    "index_status": lambda r, d: _code(d, "count(DISTINCT path)")[0][0] in tuple(r[0]),
    "chain_flow": lambda r, d: {(x.chain, x.entry_title, x.target_title, round(min(x.risk, 10.0) - 1e-9, 3)) for x in r if not x.paths} <= {(*x[:3], round(x[3] - 1e-9, 3)) for x in _sql(d, "attack_chains", "chain, entry_title, target_title, risk")} and len(r) == _sql(d, "attack_chains")[0][0],
    "function_table": lambda r, d: len(r) > 0 and all(any(w in t for w in ("def ", "function ", "fn ", "func ")) for x in r for (t,) in d.sql(f"{CODE_SQL} SELECT line FROM code WHERE path = '{x.path}' AND line_no = {x.start_line}").fetchall()),
    "chunk_index": lambda r, d: len(r) >= _code(d, "count(DISTINCT path)")[0][0],
    "packed_queries": lambda r, d: 0 < len(r) == len(set(r)),
    "line_differences": lambda r, d: _line_counts(r) == _least_differences(d),
    "magic_links": lambda r, d: len(r) == d.sql("SELECT count(*) FROM pages").fetchall()[0][0] and all(x.link is None or "http" in x.link or x.link.startswith(("/", "#")) for x in r),
    "silent_catches": lambda r, d: len(r) <= _code(d, "count(*) FILTER (contains(line, 'except') OR contains(line, 'catch'))")[0][0],
    "file_taint": lambda r, d: {x.path for x in r} <= {x for (x,) in _code(d, "DISTINCT path")},
    "taint_trace": lambda r, d: all(x.id.startswith("TRACE-") and 0 < x.risk <= 10 for x in r) and sorted((x.risk for x in r), reverse=True) == [x.risk for x in sorted(r, key=lambda x: int(x.id[6:]))],
    "complex_functions": lambda r, d: {x.path for x in r} <= {x for (x,) in _code(d, "DISTINCT path")},
}


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_facts(spark, duck, name):
    assert FACTS[name](registry.QUERIES[name](spark, SF).collect(), duck)
