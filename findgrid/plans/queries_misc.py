"""Queries of indexes, sessions, selections and text helpers, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from findgrid.functions import codes, web
from findgrid.functions.shared import save_table, shared_dir
from findgrid.operators import diffs, flow, search
from findgrid.operators import exchange as ex
from findgrid.operators import findings as fs
from findgrid.plans.fixtures import CODE_SQL, code_lines, files
from findgrid.plans.queries_findings import FOUND_SQL, SEV, _chain_tags, found

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query()
def index_status(spark, sf_dir):
    root = f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
    search.save_index(files(spark, sf_dir), root)
    return search.index_status(search.load_index(spark, root))


@query(f"{FOUND_SQL} SELECT 's' || (line_number % 3) AS session, count(*)::BIGINT AS n, count(DISTINCT title)::BIGINT AS titles FROM found WHERE line_number % 3 <> 2 GROUP BY 1")
def session_findings(spark, sf_dir):
    """Sessions written as JSON lines with nested findings, read with a schema, exploded and merged."""
    root = f"{shared_dir(spark)}/sessions-{uuid.uuid4().hex}"
    f = found(spark, sf_dir).select(F.concat(F.lit("s"), (F.col("line_number") % 3).cast("string")).alias("session"), "file_path", F.struct("title", "severity").alias("f"))
    f.groupBy("session", "file_path").agg(F.collect_list("f").alias("findings")).write.json(root)
    s = fs.session_merge(spark.read.schema("session string, findings array<struct<title: string, severity: string>>").json(root))
    return s.filter("session <> 's2'").groupBy("session").agg(F.count("*").alias("n"), F.count_distinct("title").alias("titles"))


_CHAINS = f"""{FOUND_SQL}, e AS ({_chain_tags("entry")}), t AS ({_chain_tags("target")}),
chains AS (SELECT e.chain, e.title AS entry_title, t.title AS target_title, max(least(10, (e.risk + t.risk) / 2 * e.factor * CASE WHEN e.file_path = t.file_path THEN 1.5::DOUBLE ELSE 1::DOUBLE END)) AS risk FROM e JOIN t ON e.chain = t.chain AND e.id <> t.id GROUP BY ALL)"""


@query(f"{_CHAINS} SELECT chain, entry_title, target_title FROM chains WHERE contains(lower(chain), 'dataex') OR contains(replace(lower(chain), ' ', ''), 'dataex')")
def chain_filter(spark, sf_dir):
    return fs.filter_chains(fs.chains(found(spark, sf_dir)), "DataEx").select("chain", "entry_title", "target_title")


@query(f"""{_CHAINS}, m AS (SELECT DISTINCT c.chain, c.entry_title, c.target_title, f.id FROM chains c JOIN found f ON f.title = c.entry_title OR f.title = c.target_title)
SELECT chain, entry_title, target_title, count(*)::BIGINT AS steps FROM m GROUP BY ALL""")
def chain_members(spark, sf_dir):
    f = found(spark, sf_dir)
    return fs.chain_members(f, fs.chains(f)).groupBy("chain", "entry_title", "target_title").agg(F.count("*").alias("steps"))


@query(r"""WITH u AS (SELECT o_orderkey AS k, ['GET https://api.Ok.test/a', 'post http://ok.test/b', 'https://bad.test/c', '  DELETE   /d  '][o_orderkey % 4 + 1] AS s FROM orders),
p AS (SELECT k, CASE WHEN regexp_matches(trim(s), '^([A-Za-z]+)\s+\S') THEN upper(regexp_extract(trim(s), '^([A-Za-z]+)\s+\S', 1)) ELSE 'GET' END AS method, CASE WHEN regexp_matches(trim(s), '^([A-Za-z]+)\s+\S') THEN trim(regexp_replace(trim(s), '^[A-Za-z]+\s+', '')) ELSE trim(s) END AS url FROM u)
SELECT k, method, url, coalesce(nullif(lower(regexp_extract(url, '^https?://([^/:]*)', 1)), '') = 'ok.test' OR ends_with(nullif(lower(regexp_extract(url, '^https?://([^/:]*)', 1)), ''), '.ok.test'), false) AS allowed FROM p""")
def endpoint_strings(spark, sf_dir):
    s = F.element_at(F.array(*map(F.lit, ("GET https://api.Ok.test/a", "post http://ok.test/b", "https://bad.test/c", "  DELETE   /d  "))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("k"), web.parse_endpoint(s).alias("e"))
    return o.select("k", "e.method", "e.url", web.host_allowed(F.col("e.url"), ["ok.test"]).alias("allowed"))


@query(r"""SELECT c_custkey, regexp_replace(c_name, '[^\p{L}\p{N}_-]', '_', 'g') AS workspace, 'org/' || lower(c_mktsegment) AS repo, sha256(c_name) AS hash, strlen(c_name) // 4 + 1 AS tokens FROM customer""")
def names_and_hashes(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    url = F.concat(F.lit("git@host.test:org/"), F.lower("c_mktsegment"), F.lit(".git"))
    return c.select("c_custkey", web.sanitize_name(F.col("c_name")).alias("workspace"), web.repo_of_remote(url).alias("repo"), F.sha2("c_name", 256).alias("hash"), search.token_estimate(F.col("c_name")).alias("tokens"))


_PATCH = "@@ -1,2 +1,3 @@\n ctx\n+new\n+more"


@query(f"""{FOUND_SQL} SELECT id FROM found WHERE {SEV.format("severity")} >= 4 AND contains(file_path, 'lib/') ORDER BY found.risk DESC, id LIMIT 10""")
def inline_comments(spark, sf_dir):
    """The ten riskiest severe findings in changed files that have a patch."""
    f = found(spark, sf_dir)
    changed = f.select(F.col("file_path").alias("path")).distinct().filter(F.col("path").contains("lib/")).withColumn("patch", F.lit(_PATCH))
    return diffs.inline_candidates(f, changed).select("id")


@query(f"""{CODE_SQL}, l AS (SELECT path, list(line ORDER BY line_no) AS l FROM code GROUP BY path) SELECT path, array_to_string(l[2:4], chr(10)) AS snippet, list_contains(string_split_regex(lower(l[1]), '[^\\p{{L}}\\p{{N}}_]+'), 'password') AS uses FROM l""")
def snippets(spark, sf_dir):
    l = F.split("content", "\n")
    uses = F.array_contains(F.split(F.lower(F.get(l, F.lit(0))), r"[^\p{IsAlphabetic}\p{N}_]+"), "password")
    return files(spark, sf_dir).select("path", F.array_join(F.slice(l, 2, 3), "\n").alias("snippet"), uses.alias("uses"))


@query()
def chain_flow(spark, sf_dir):
    """All chains; the risk of those whose files a taint path connects is raised by 1.5, 10 at most. All pairs of files count, over
    any number of calls and all functions of a name."""
    f = save_table(found(spark, sf_dir).select("id", "title", "file_path", "risk"), "found")
    return fs.with_flow(fs.chains(f), f, *flow.linked_files(files(spark, sf_dir))).select("chain", "entry_title", "target_title", "risk", "paths")


@query()
def line_differences(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.posexplode(codes.line_diff("text", web.redact_text(F.col("text")))).alias("pos", "d"))
    return d.select("doc_id", "pos", "d.op").groupBy("doc_id", "op").agg(F.count("*").alias("n"))


@query("SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations WHERE role = 'assistant' AND contains(lower(text), 'thing')) WHERE rn = 1")
def latest_messages(spark, sf_dir):
    """The newest message of each thread from a sender, whose text, as all there is of a subject here, has a word."""
    m = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", F.col("role").alias("sender"), F.col("text").alias("subject"))
    return ex.newest_message(m, "conv_id", "turn", subject="thing", sender="assistant").select("conv_id", "turn")


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'Secret' WHEN 1 THEN 'BusinessLogic' WHEN 2 THEN 'Injection' ELSE 'Vulnerability' END AS kind, CASE p_partkey % 4 WHEN 0 THEN 'x = 1' WHEN 1 THEN 'y' WHEN 2 THEN 'plain' ELSE '' END AS code FROM part")
def reply_cleaning(spark, sf_dir):
    pick = lambda *v: F.element_at(F.array(*map(F.lit, v)), (F.col("p_partkey") % 4 + 1).cast("int"))
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", ex.finding_type_named(pick("SECRET", "business_logic", "Injection", "?")).alias("kind"), web.strip_fences(pick("```python\nx = 1\n```", "```\ny\n```", "plain", "")).alias("code"))


@query(f"""{FOUND_SQL} SELECT id, count(*)::BIGINT AS n FROM found JOIN (SELECT DISTINCT regexp_extract(path, '([^/]*)$', 1) AS base FROM code) ON regexp_extract(file_path, '([^/]*)$', 1) = base GROUP BY id""")
def resolved_paths(spark, sf_dir):
    """Findings whose path ends in a known file name, by equality on every suffix of the path."""
    base = code_lines(spark, sf_dir).select(F.regexp_extract("path", "([^/]*)$", 1).alias("path")).distinct()
    return diffs.resolve_paths(found(spark, sf_dir), base).groupBy("id").agg(F.count("*").alias("n"))
