"""Queries of the secret scan and of reports with a rules table, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from findgrid.operators import secrets
from findgrid.plans import reports
from findgrid.plans.fixtures import CODE_SQL, code_lines
from findgrid.plans.queries_findings import FOUND_SQL, _any, _q, found
from findgrid.sources import files as src

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


_SHARE = "((length(s) - length(replace(s, c, '')))::DOUBLE / length(s))"
_BITS = f"list_sum(list_transform(list_distinct(string_split(s, '')), lambda c: -{_SHARE} * log2({_SHARE})))"
_DIGIT = "(substring(s, length(s) - i, 1)::INT * (1 + i % 2))"
_LUHN = f"list_sum(list_transform(range(0, length(s)), lambda i: {_DIGIT} - CASE WHEN {_DIGIT} > 9 THEN 9 ELSE 0 END)) % 10 = 0"
# SQL has no CRC-32; a token that carries one stands for a row that must not be there, as none of the tables has a right one
_HIT = " UNION ALL ".join(
    f"""SELECT path, line_no, s, {_q(f.title)} AS title, {_q(f.severity)} AS severity, {_q(f.confidence)} AS confidence FROM (SELECT path, line_no, unnest(regexp_extract_all(line, {_q(f.pattern)}, 1)) AS s FROM l WHERE {_any('line', f.hints)})
    WHERE {_BITS} >= {f.entropy} AND {_LUHN if f.checksum == 'luhn' else 'false' if f.checksum else 'true'}"""
    for f in secrets.FORMATS
)
_LINES = """SELECT 'doc/' || doc_id AS path, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents"""


@query(f"""{CODE_SQL}, l AS (SELECT path, line, line_no FROM ({_LINES}) UNION ALL SELECT path, line, line_no FROM code), h AS ({_HIT})
SELECT path AS file_path, line_no::BIGINT AS line_number, title, severity, confidence, left(s, 4) || '***' AS shown, round({_BITS}, 6) AS bits, sha256(title || ':' || s) AS fingerprint FROM h
WHERE title || ':' || s <> 'Password in Code:abc12345'""")
def secret_formats(spark, sf_dir):
    """Secrets of all documents and code lines but one that the allow list holds."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.concat(F.lit("doc/"), "doc_id").alias("path"), F.lit("txt").alias("ext"), F.col("text").alias("content"))
    lines = src.lines(d).select("path", F.col("line_no").cast("long").alias("line_no"), "line").unionByName(code_lines(spark, sf_dir).select("path", "line_no", "line"))
    allowed = spark.range(1).select(F.sha2(F.lit("Password in Code:abc12345"), 256).alias("fingerprint"))
    return secrets.match_secrets(lines, allowed).withColumn("bits", F.round("bits", 6))



@query(f"""{FOUND_SQL}, f AS (SELECT id, coalesce(cwe_id, title) AS rule, owasp_category, row_number() OVER (ORDER BY id) AS no FROM found),
r AS (SELECT rule, min(no) AS first, arg_min(owasp_category, no) AS owasp FROM f GROUP BY rule), n AS (SELECT *, row_number() OVER (ORDER BY first) - 1 AS rule_index FROM r)
SELECT f.id, f.rule, n.rule_index::BIGINT AS rule_index, 'security' || coalesce(',external/owasp/' || lower(n.owasp), '') AS tags FROM f JOIN n USING (rule)""")
def sarif_rules_document(spark, sf_dir):
    """Results of the document with a rules table, joined to the rules that their ruleIndex points at."""
    lines = reports.sarif_rules(found(spark, sf_dir), F.coalesce("cwe_id", "title"))
    j = lambda p: F.get_json_object(F.regexp_replace("line", "^,", ""), p)
    rules = lines.filter("part = 1").select((F.col("ord") - 1).alias("rule_index"), j("$.id").alias("rule"), F.array_join(F.from_json(j("$.properties.tags"), "array<string>"), ",").alias("tags"))
    results = lines.filter("part = 3").select(j("$.partialFingerprints.primaryLocationLineHash").alias("id"), j("$.ruleIndex").cast("long").alias("rule_index"))
    return results.join(rules, "rule_index").select("id", "rule", "rule_index", "tags")
