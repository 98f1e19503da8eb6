"""Queries of routes, plans, flows, crawls, streams and reports, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from findgrid.functions.shared import shared_dir
from findgrid.operators import flow, recon
from findgrid.plans import reports
from findgrid.plans.fixtures import CODE_SQL, code_lines, files
from findgrid.plans.queries_findings import FOUND_SQL, _any, _q, found
from findgrid.streaming import watch

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


_T = "trim(line)"
_W = "OVER (PARTITION BY path ORDER BY line_no ROWS BETWEEN {} AND {})"
_FN = r"nullif(regexp_extract(line, '\b(?:async\s+)?(?:fn|def|function)\s+([a-zA-Z_][a-zA-Z0-9_]*)', 1), '')"
_DEP = f"((contains(lower({_T}), 'depends(') AND {_any(f'lower({_T})', ('user', 'auth', 'token', 'oauth', 'role', 'permission', 'admin', 'require'))}) OR (starts_with({_T}, '@') AND {_any(f'lower({_T})', ('login_required', 'jwt_required', 'require_', 'roles_required', 'permission_required'))}))"
_PY = f"""py AS (SELECT * FROM (SELECT *, coalesce(first({_FN} IGNORE NULLS) {_W.format("1 FOLLOWING", "8 FOLLOWING")}, '') AS handler,
first(CASE WHEN regexp_matches({_T}, '^(async )?def ') THEN line_no END IGNORE NULLS) {_W.format("CURRENT ROW", "7 FOLLOWING")} AS def_at,
first(CASE WHEN {_DEP} THEN line_no END IGNORE NULLS) {_W.format("CURRENT ROW", "7 FOLLOWING")} AS auth_at FROM code WHERE ext = 'py') WHERE regexp_matches(line, {_q(recon._PY_ROUTE)}))"""


def _rx(p: str, i: int) -> str:
    return f"regexp_extract(line, {_q(p)}, {i})"


_PYS = f"SELECT upper({_rx(recon._PY_ROUTE, 2)}) AS method, {_rx(recon._PY_ROUTE, 3)} AS path, handler, path AS file, line_no, coalesce(auth_at < coalesce(def_at, 1099511627776), false) AS auth_required, 'fastapi' AS framework FROM py"
_AUTHW = lambda x: _any(f"lower({x})", recon.AUTH_WORDS)
_JS = f"""js AS (SELECT path AS file, line_no, upper({_rx(recon._JS_ROUTE, 2)}) AS method, {_rx(recon._JS_ROUTE, 3)} AS path, {_rx(recon._JS_ROUTE + "(.*)$", 4)} AS after FROM code WHERE ext IN ('js', 'ts', 'jsx', 'tsx') AND regexp_matches(line, {_q(recon._JS_ROUTE)})),
jsa AS (SELECT *, list_filter(list_transform(string_split(regexp_extract(after, '^([^)]*)', 1), ','), lambda x: trim(x)), lambda x: x <> '') AS args FROM js)"""
_JSS = rf"SELECT method, path, CASE WHEN contains(after, '=>') OR contains(after, 'function') THEN '<inline>' ELSE regexp_replace(coalesce(args[len(args)], ''), '^[^\p{{L}}\p{{N}}_.$#]+|[^\p{{L}}\p{{N}}_.$#]+$', '', 'g') END AS handler, file, line_no, CASE WHEN contains(after, '=>') OR contains(after, 'function') THEN {_AUTHW('after')} ELSE len(list_filter(args[1:len(args) - 1], lambda x: {_AUTHW('x')})) > 0 END AS auth_required, 'express' AS framework FROM jsa"
_RS = f"SELECT CASE WHEN lower({_rx(recon._AXUM, 2)}) IN ('get', 'post', 'put', 'delete', 'patch', 'options', 'head', 'any') THEN upper({_rx(recon._AXUM, 2)}) ELSE '?' END AS method, {_rx(recon._AXUM, 1)} AS path, {_rx(recon._AXUM, 3)} AS handler, path AS file, line_no, false AS auth_required, 'axum' AS framework FROM code WHERE ext = 'rs' AND regexp_matches(line, {_q(recon._AXUM)})"
_ENDS = f"{CODE_SQL}, {_PY}, {_JS}, ends AS ({_PYS} UNION ALL {_JSS} UNION ALL {_RS})"


@query(f"{_ENDS} SELECT * FROM ends")
def route_extraction(spark, sf_dir):
    return recon.endpoints(code_lines(spark, sf_dir))


def _mission() -> str:
    segs = r"string_split_regex(lower(path), '[/\-_.]')"
    return "CASE " + " ".join(f"WHEN list_has_any({segs}, [{', '.join(map(_q, w))}]) THEN {_q(f)}" for f, _, w in recon.MISSIONS) + f" WHEN contains(path, '{{') OR contains(path, ':') OR list_contains({segs}, 'resource') OR method = 'DELETE' THEN {_q(recon.IDOR)} ELSE {_q(recon.GENERAL)} END"


_SYN = ("/login", "/api/files/download", "/proxy", "/run/cmd", "/users/{id}", "/orders/:order_id/items", "/search", "/resource", "/", "/a.b/otp")
_SYN_SQL = f"WITH e AS (SELECT o_orderkey AS line_no, [{', '.join(map(_q, _SYN))}][o_orderkey % 10 + 1] AS path, ['GET', 'POST', 'DELETE'][o_custkey % 3 + 1] AS method FROM orders)"


def synthetic_endpoints(spark, sf_dir):
    pick = lambda v, c: F.element_at(F.array(*map(F.lit, v)), (F.col(c) % len(v) + 1).cast("int"))
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("line_no"), pick(_SYN, "o_orderkey").alias("path"), pick(("GET", "POST", "DELETE"), "o_custkey").alias("method"), F.lit("f").alias("file"))


@query(f"{_SYN_SQL} SELECT {_mission()} AS focus, count(*)::BIGINT AS n FROM e GROUP BY focus")
def mission_plan(spark, sf_dir):
    return recon.plan(synthetic_endpoints(spark, sf_dir)).select("focus", "n")


@query(f"{_SYN_SQL}, m AS (SELECT {_mission()} AS focus, count(*)::BIGINT AS n FROM e GROUP BY focus), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, focus) AS r FROM m) SELECT CASE WHEN r < 3 THEN focus ELSE {_q(recon.REST)} END AS focus, sum(n)::BIGINT AS n FROM r GROUP BY 1")
def capped_plan(spark, sf_dir):
    return recon.plan(synthetic_endpoints(spark, sf_dir), 3).select("focus", "n")


_ALLOWED = ("auth", "xss", "idor")
_CLASSES = "CASE focus " + " ".join(f"WHEN {_q(f)} THEN [{_q(c)}]" for f, c, _ in recon.MISSIONS) + f" WHEN {_q(recon.IDOR)} THEN ['idor'] ELSE ['sqli', 'xss'] END"


@query(f"""{_SYN_SQL}, m AS (SELECT {_mission()} AS focus, count(*)::BIGINT AS n FROM e GROUP BY focus) SELECT focus, n, classes FROM (SELECT focus, n, array_to_string(list_filter({_CLASSES}, lambda c: list_contains([{', '.join(map(_q, _ALLOWED))}], c)), ',') AS classes FROM m) WHERE classes <> ''""")
def restricted_plan(spark, sf_dir):
    p = recon.restrict(recon.plan(synthetic_endpoints(spark, sf_dir)), list(_ALLOWED))
    return p.select("focus", "n", F.array_join("classes", ",").alias("classes"))


@query(f"""{_SYN_SQL}, m AS (SELECT {_mission()} AS focus, min(row('f', line_no, path, method)) AS place FROM e GROUP BY 1) SELECT focus, row_number() OVER (ORDER BY place)::BIGINT AS seen FROM m
UNION ALL SELECT 'empty: {recon.EMPTY_SURFACE}', 7 UNION ALL SELECT 'restricted: {recon.EMPTY_SURFACE} (config-restricted)', 1""")
def missions_in_order(spark, sf_dir):
    """Missions in the order in which they are first met, and the general ones that stand for none."""
    e = synthetic_endpoints(spark, sf_dir)
    empty = recon.plan(e.limit(0)).select(F.concat(F.lit("empty: "), "focus").alias("focus"), F.size("classes").cast("long").alias("seen"))
    none = recon.restrict(recon.plan(e), ["no-such"]).select(F.concat(F.lit("restricted: "), "focus").alias("focus"), F.size("classes").cast("long").alias("seen"))
    return recon.plan(e).select("focus", F.col("seen").cast("long").alias("seen")).unionByName(empty).unionByName(none)


_CONC = r"regexp_replace(regexp_replace(path, '\{[^}]+\}', '1', 'g'), ':[\p{L}][\p{L}\p{N}_]*', '1', 'g')"


@query(rf"""{_SYN_SQL} SELECT DISTINCT method, 'http://t.test' || {_CONC} AS url, array_to_string(list_transform(regexp_extract_all(path, '(\{{[^}}]+\}}|:[\p{{L}}][\p{{L}}\p{{N}}_]*)', 1), lambda x: regexp_replace(x, '[{{}}:]', '', 'g')), ',') AS params FROM e WHERE path <> '/'""")
def sweep_targets(spark, sf_dir):
    return recon.sweep_targets(synthetic_endpoints(spark, sf_dir), "http://t.test/")


@query(r"""WITH u AS (SELECT o_orderkey AS k, ['http://app.test/api/users', 'http://app.test/logout', 'http://app.test/health', '/api/x', 'https://sub.ok.test/q', 'http://app.test/api/logout2'][o_orderkey % 6 + 1] AS url FROM orders)
SELECT k, CASE WHEN NOT regexp_matches(url, '^https?://') THEN true ELSE NOT list_contains(string_split(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), '/'), 'logout') AND (list_contains(string_split(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), '/'), 'api') OR lower(regexp_extract(url, '^https?://([^/:]*)', 1)) = 'ok.test' OR ends_with(lower(regexp_extract(url, '^https?://([^/:]*)', 1)), '.ok.test')) END AS allowed FROM u""")
def scope_rules(spark, sf_dir):
    url = F.element_at(F.array(*map(F.lit, ("http://app.test/api/users", "http://app.test/logout", "http://app.test/health", "/api/x", "https://sub.ok.test/q", "http://app.test/api/logout2"))), (F.col("o_orderkey") % 6 + 1).cast("int"))
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("k"), url.alias("url"))
    return o.select("k", recon.scope_allows(F.col("url"), [("url_path", "/logout")], [("url_path", "/api"), ("domain", "ok.test")]).alias("allowed"))


@query(f"""{CODE_SQL} SELECT {", ".join(f"bool_or(regexp_matches(line, {_q(p)})) AS {k}" for k, p in recon.AUTH_MARKS)},
(SELECT array_to_string(list(s ORDER BY s), ',') FROM (SELECT s FROM (SELECT unnest(regexp_extract_all(line, {_q(recon.ENV_SECRET)}, 1)) AS s, path, line_no FROM code WHERE {_any("line", ("env(", "os.environ", "process.env", "getenv"))}) GROUP BY s ORDER BY min(row(path, line_no)), s LIMIT 10)) AS secrets FROM code""")
def auth_surface(spark, sf_dir):
    return recon.auth_marks(code_lines(spark, sf_dir))


@query("""WITH RECURSIVE n AS (SELECT max(c_custkey) AS n FROM customer), l AS (SELECT DISTINCT o_custkey AS src, (o_orderkey * 7) % n + 1 AS dst FROM orders, n),
b(url, depth) AS (SELECT min(o_custkey), 0 FROM orders UNION SELECT l.dst, b.depth + 1 FROM b JOIN l ON l.src = b.url JOIN customer ON c_custkey = l.dst WHERE b.depth < 2)
SELECT url, min(depth)::BIGINT AS depth FROM b GROUP BY url""")
def offline_crawl(spark, sf_dir):
    """All customers are pages and all orders links between them."""
    pages = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("url"))
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("src"), F.col("o_orderkey").alias("k"))
    links = o.crossJoin(F.broadcast(pages.agg(F.max("url").alias("n")))).select("src", (F.col("k") * 7 % F.col("n") + 1).alias("dst")).distinct()  # one row
    return recon.crawl(pages, links, o.agg(F.min("src").alias("url")), 2, None).select("url", F.col("depth").cast("long").alias("depth"))


@query()
def complex_functions(spark, sf_dir):
    return flow.complex_functions(files(spark, sf_dir))


@query()
def silent_catches(spark, sf_dir):
    return flow.silent_catches(files(spark, sf_dir))


@query()
def file_taint(spark, sf_dir):
    return flow.file_taint(files(spark, sf_dir))


@query()
def function_table(spark, sf_dir):
    return flow.functions(files(spark, sf_dir)).select("path", "name", "start_line", F.array_join("params", ",").alias("params"), F.size("body").cast("long").alias("body_lines"))


@query()
def taint_trace(spark, sf_dir):
    return flow.dedup_paths(flow.trace(files(spark, sf_dir), depth=4, question="read data"))


def _step_states() -> str:
    """CTEs l1..l4: the functions that taint enters at each level, each with its caller and its handler."""
    out = "l1 AS (SELECT c // 2 AS x, arg_min(c, 'app/f' || c || '.py') AS prev, min('app/f' || c || '.py') AS r FROM c WHERE c % 8 = 7 AND c // 2 IN (SELECT c FROM c) GROUP BY 1)"
    for k in (2, 3, 4):
        seen = " UNION ".join(f"SELECT x FROM l{j}" for j in range(1, k))
        out += f", l{k} AS (SELECT x // 2 AS x, arg_min(x, r) AS prev, min(r) AS r FROM l{k - 1} WHERE x % 3 <> 0 AND x // 2 IN (SELECT c FROM c) AND x // 2 NOT IN ({seen}) GROUP BY 1)"
    return out


@query(f"""WITH RECURSIVE c AS (SELECT c_custkey AS c FROM customer), {_step_states()}, st AS ({" UNION ALL ".join(f"SELECT {k} AS level, * FROM l{k}" for k in (1, 2, 3, 4))}),
walk AS (SELECT x AS sink, level, x, prev FROM st WHERE x % 3 = 0 UNION ALL SELECT w.sink, s.level, s.x, s.prev FROM walk w JOIN st s ON s.level = w.level - 1 AND s.x = w.prev),
b AS (SELECT *, CASE WHEN x % 8 = 7 THEN 5 ELSE 1 END AS first, 'app/f' || x || '.py' AS file, 'step_' || x AS function FROM walk)
SELECT 'app/f' || sink || '.py' AS sink_path, step::BIGINT AS step, file, line::BIGINT AS line, function, action, detail FROM (
SELECT sink, 2 * level + 2 AS step, file, first + 1 AS line, function, 'flow' AS action, '''part'' takes tainted ''value''' AS detail FROM b
UNION ALL SELECT sink, 2 * level + 3, file, first + 2, function, CASE WHEN x = sink THEN 'sink' ELSE 'call' END, CASE WHEN x = sink THEN 'tainted data reaches ''exec''' ELSE 'calls step_' || (x // 2) || '(part) with tainted data' END FROM b
UNION ALL SELECT sink, v.n, 'app/f' || prev || '.py', v.n + 1, 'handle_' || prev, v.action, CASE v.n WHEN 1 THEN 'untrusted input enters ''name''' WHEN 2 THEN '''data'' takes tainted ''name''' ELSE 'calls step_' || (prev // 2) || '(data) with tainted data' END
FROM b, (VALUES (1, 'source'), (2, 'flow'), (3, 'call')) v(n, action) WHERE level = 1)""")
def taint_steps(spark, sf_dir):
    """The chains of taint, step by step, through a file for each customer: every eighth has a handler that reads input, all have a
    function that runs it (every third) or hands it on to the function of half the number."""
    c = F.col("c_custkey")
    half = F.floor(c / 2).cast("string")
    handler = F.when(c % 8 == 7, F.concat(F.lit("def handle_"), c, F.lit("(req):\n    name = request.args.get('k')\n    data = name.strip()\n    step_"), half, F.lit("(data)\n"))).otherwise("")
    last = F.when(c % 3 == 0, F.lit("    exec(part)\n")).otherwise(F.concat(F.lit("    step_"), half, F.lit("(part)\n")))
    code = F.concat(handler, F.lit("def step_"), c, F.lit("(value):\n    part = value + '!'\n"), last)
    f = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.concat(F.lit("app/f"), c, F.lit(".py")).alias("path"), F.lit("py").alias("ext"), code.alias("content"))
    paths, steps = flow.taint_paths(f)
    return steps.join(paths.select("path_id", "sink_path"), "path_id").select("sink_path", "step", "file", "line", "function", "action", "detail")


@query()
def sarif_document(spark, sf_dir):
    return reports.sarif(found(spark, sf_dir)).select("part", "line")


@query("""WITH d AS (SELECT event_type || ':' || (user_id % 400) AS fingerprint, day(ts) % 3 AS b FROM events)
SELECT DISTINCT fingerprint, n::BIGINT AS batch FROM (SELECT d.fingerprint, n FROM (VALUES (1), (2)) v(n) JOIN d ON d.b = n WHERE NOT EXISTS (SELECT 1 FROM d p WHERE p.b = n - 1 AND p.fingerprint = d.fingerprint))""")
def watch_batches(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.concat("event_type", F.lit(":"), (F.col("user_id") % 400).cast("string")).alias("fingerprint"), (F.dayofmonth("ts") % 3).alias("b"))
    w = watch.Watch(spark, f"{shared_dir(spark)}/watch-{uuid.uuid4().hex}")
    out = None
    for n in range(3):
        a = w.apply(e.filter(F.col("b") == n), n)
        out = a if out is None else out.unionByName(a)
    return out


@query("SELECT date_trunc('hour', ts)::VARCHAR AS start, event_type, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_rates(spark, sf_dir):
    r = watch.event_rates(spark.read.parquet(f"{sf_dir}/events.parquet"))
    return r.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query(f"""{FOUND_SQL} SELECT a.file_path, a.title AS kept FROM (SELECT DISTINCT file_path, title FROM found WHERE source = 'security-review') a WHERE NOT EXISTS (SELECT 1 FROM found b WHERE b.source = 'secret-scanner' AND b.file_path IS NOT DISTINCT FROM a.file_path)""")
def merge_without_known(spark, sf_dir):
    f = found(spark, sf_dir)
    known = f.filter("source = 'secret-scanner'").select(F.col("file_path").alias("p")).distinct()
    new = f.filter("source = 'security-review'").select("file_path", F.col("title").alias("kept")).distinct()
    return new.join(known, new["file_path"].eqNullSafe(known["p"]), "left_anti")
