"""Queries over the saved index, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from findgrid.functions.shared import shared_dir
from findgrid.operators import index
from findgrid.plans.queries_code import _QUESTION, _STOP, _TOK, docs

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

#: Chunks as large as any text, so that SQL can follow.
WHOLE = 1 << 40


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _post(where: str = "true") -> str:
    return f"""WITH d AS (SELECT source || '/' || doc_id AS path, text FROM documents WHERE regexp_matches(text, '\\S') AND {where}),
t AS (SELECT path, unnest({_TOK}) AS term FROM d), post AS (SELECT path, term, count(*) AS tf FROM t WHERE term NOT IN ({_STOP}) GROUP BY ALL),
idf AS (SELECT term, count(*)::BIGINT AS df, ln((SELECT count(*) FROM d)::DOUBLE / (count(*) + 1)) + 1 AS idf FROM post GROUP BY term)"""


def _files(spark, sf_dir):
    return docs(spark, sf_dir).select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("path"), F.col("text").alias("content"), "doc_id")


def _new(spark):
    return index.Index(spark, f"{shared_dir(spark)}/index-{uuid.uuid4().hex}", WHOLE)


@query(f"""{_post()}, q AS (SELECT unnest(string_split('{_QUESTION}', ' ')) AS term), w AS (SELECT q.term, idf FROM q JOIN idf USING (term) WHERE idf > 0),
s AS (SELECT path, (1 + ln(tf)) * idf AS s FROM post JOIN w USING (term) UNION ALL SELECT path, 0.5 * idf FROM d JOIN w ON contains(lower(path), w.term))
SELECT path, round(sum(s), 6) AS score FROM s GROUP BY path ORDER BY sum(s) DESC, path LIMIT 10""")
def indexed_search(spark, sf_dir):
    """A question answered from the saved index of all documents; only its words' buckets are read."""
    i = _new(spark)
    i.update(_files(spark, sf_dir).select("path", "content"))
    return i.search(_QUESTION).select("path", F.round("score", 6).alias("score"))


@query(f"{_post('doc_id % 7 <> 3')} SELECT term, df FROM idf")
def index_after_edits(spark, sf_dir):
    """Document frequencies of an index that first took all documents, a third of them in another wording, and then their present
    texts without every seventh document."""
    i, f = _new(spark), _files(spark, sf_dir)
    i.update(f.select("path", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("once other "), "content")).otherwise(F.col("content")).alias("content")))
    i.update(f.filter("doc_id % 7 <> 3").select("path", "content"))
    return i.terms()
