"""line_split gives the rows of its SQL on carriage returns, empty texts, final line feeds and repeated ids."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

from findgrid.plans import registry

TEXTS = (
    (1, ""), (2, "\n"), (3, "\n\n"), (4, "a\r\nb\r\n"), (5, "x\r"), (6, None), (7, "a\nbb"), (7, "a\nbb"), (7, "a\nbb\n"), (7, "c"), (8, "\r\r\n\r"),
    (9, "é \r\u0085\nz "), (None, "q"), (None, "q"), (None, None), (10, "a\0b\nc"), (11, "a\nb"), (11, "b\na"),
)


def test_line_split_on_odd_texts(spark, tmp_path):
    pq.write_table(pa.table({"doc_id": pa.array([k for k, _ in TEXTS], pa.int64()), "text": pa.array([t for _, t in TEXTS], pa.string())}), tmp_path / "documents.parquet")
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
    want = c.sql(registry.ORACLE_SQL["line_split"]).fetchall()
    got = [tuple(r) for r in registry.QUERIES["line_split"](spark, str(tmp_path)).select("doc_id", "n_lines", "longest").collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and len(want) == 13
