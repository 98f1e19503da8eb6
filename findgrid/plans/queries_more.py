"""Queries of scopes, surfaces, pages, listings and routes of further frameworks, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from findgrid.functions import web
from findgrid.operators import dependencies as dep
from findgrid.operators import exchange as ex
from findgrid.operators import recon, search
from findgrid.plans.fixtures import CODE_SQL, code_lines, files
from findgrid.plans.queries_findings import FOUND_SQL, _any, _q, found
from findgrid.plans.queries_recon import _ENDS
from findgrid.sources import files as src

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


_URLS = ("http://App.test:80/api/users?id=1&q=a=b", "https://sub.ok.test", "http://ok.test?x=1", "ftp://ok.test/a", "http://app.test/api/logout", "https://app.test/admin/?debug", "/relative", "http://[x/y")
_U = f"WITH u AS (SELECT o_orderkey AS k, [{', '.join(map(_q, _URLS))}][o_orderkey % {len(_URLS)} + 1] AS url, ['GET', 'POST', 'delete'][o_orderkey % 3 + 1] AS method, ['Bearer abc', 'Basic x', ''][o_custkey % 3 + 1] AS auth FROM orders)"
_PARTS = r"""p AS (SELECT *, regexp_matches(url, '^https?://') AS ok, regexp_replace(url, '^https?://', '') AS rest, CASE WHEN contains(rest, '/') THEN regexp_replace(rest, '^[^/]*', '') ELSE '/' END AS tail,
lower(regexp_extract(rest, '^([^/:]*)', 1)) AS host, regexp_extract(tail, '^([^?]*)', 1) AS path, regexp_extract(tail, '\?(.*)$', 1) AS query FROM u)"""


def _requests(spark, sf_dir):
    pick = lambda v, c: F.element_at(F.array(*map(F.lit, v)), (F.col(c) % len(v) + 1).cast("int"))
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("k"), pick(_URLS, "o_orderkey").alias("url"), pick(("GET", "POST", "delete"), "o_orderkey").alias("method"), pick(("Bearer abc", "Basic x", ""), "o_custkey").alias("auth"))


@query(f"{_U}, {_PARTS} SELECT k, CASE WHEN ok THEN host END AS host, CASE WHEN ok THEN path END AS path, CASE WHEN ok THEN query END AS query FROM p")
def url_parts(spark, sf_dir):
    return _requests(spark, sf_dir).select("k", recon.url_parts(F.col("url")).alias("p")).select("k", "p.host", "p.path", "p.query")


@query(f"""{_U}, {_PARTS} SELECT k, coalesce(ok AND (list_contains(string_split(path, '/'), 'api') OR host = 'ok.test' OR ends_with(host, '.ok.test')), false) AS by_place, true AS by_method FROM p""")
def allowed_urls(spark, sf_dir):
    u = F.col("url")
    return _requests(spark, sf_dir).select("k", recon.allows_url(u, [("url_path", "/api/"), ("domain", " .ok.test")]).alias("by_place"), recon.allows_url(u, [("method", "PUT"), ("url_path", "/none")]).alias("by_method"))


@query(f"""{_U}, {_PARTS} SELECT k, CASE WHEN NOT ok THEN true ELSE NOT (lower(method) = 'delete' OR contains(lower(auth), 'basic') OR list_contains(list_transform(string_split(query, '&'), lambda q: string_split(q, '=')[1]), 'debug'))
AND (contains(lower(auth), 'bearer') OR list_contains(string_split(path, '/'), 'admin') OR host = 'ok.test' OR ends_with(host, '.ok.test')) END AS allowed FROM p""")
def request_scope(spark, sf_dir):
    headers = F.array(F.struct(F.lit("Authorization").alias("name"), F.col("auth").alias("value")))
    avoid = [("method", "DELETE"), ("header", "authorization: basic"), ("parameter", "debug"), ("code_path", "src")]
    focus = [("header", "Authorization:BEARER"), ("url_path", "admin"), ("domain", "ok.test")]
    return _requests(spark, sf_dir).select("k", recon.scope_allows(F.col("url"), avoid, focus, F.col("method"), headers).alias("allowed"))


@query(f"""{FOUND_SQL}, d AS (SELECT DISTINCT regexp_extract(path, '([^/]*)$', 1) AS name FROM code UNION SELECT 'src' UNION SELECT 'nowhere'), p AS (SELECT file_path, count(*) AS k FROM found GROUP BY 1)
SELECT name, coalesce(sum(k), 0)::BIGINT AS n FROM d LEFT JOIN p ON contains(file_path, name) GROUP BY name""")
def dependency_listing(spark, sf_dir):
    names = code_lines(spark, sf_dir).select(F.regexp_extract("path", "([^/]*)$", 1).alias("name")).distinct()
    deps = names.unionByName(spark.createDataFrame([("src",), ("nowhere",)], "name string"))
    return dep.dependency_listing(deps, found(spark, sf_dir)).select("name", "n")


_PLACES = ("package.json", "src/go.mod", "src/a/b/c/Cargo.toml", "src/a/b/c/d/Cargo.toml", "docs/package.json", "lib/node_modules/x/package.json", "API/Gemfile", "api/GEMFILE.lock", "cmd/a/notes.txt", "build/pom.xml")


@query(f"""SELECT path FROM (SELECT o_orderkey || '/' AS project, [{', '.join(map(_q, _PLACES))}][o_orderkey % {len(_PLACES)} + 1] AS rel, o_orderkey % {len(_PLACES)} AS i, project || rel AS path FROM orders) WHERE i IN (0, 1, 2, 7)""")
def manifest_places(spark, sf_dir):
    rel = F.element_at(F.array(*map(F.lit, _PLACES)), (F.col("o_orderkey") % len(_PLACES) + 1).cast("int"))
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.concat(F.col("o_orderkey").cast("string"), F.lit("/"), rel).alias("path"), rel.alias("rel_path"))
    return dep.find_manifests(o).select("path")


@query(f"""{CODE_SQL}, g AS (SELECT s, min(row(path, line_no, pos)) AS place FROM (SELECT path, line_no, unnest(l) AS s, generate_subscripts(l, 1) - 1 AS pos FROM (SELECT path, line_no, regexp_extract_all(line, {_q(recon.MIDDLEWARE)}, 1) AS l FROM code)) GROUP BY s ORDER BY place, s LIMIT 12)
SELECT s AS name, row_number() OVER (ORDER BY g.place, s)::BIGINT AS place FROM g""")
def guard_names(spark, sf_dir):
    g = recon.guard_names(code_lines(spark, sf_dir))  # twelve rows
    return g.agg(F.array_sort(F.collect_list(F.struct("at", "name"))).alias("l")).select(F.posexplode("l").alias("i", "x")).select("x.name", (F.col("i") + 1).cast("long").alias("place"))


@query(f"""{_ENDS}, l AS (SELECT 'POST ' || path AS endpoint FROM ends WHERE method = 'POST' AND regexp_matches(path, {_q(recon.LOGIN)}) ORDER BY file, line_no, path LIMIT 10)
SELECT (SELECT count(*) FROM ends)::BIGINT AS endpoints, (SELECT string_agg(f, ',' ORDER BY f) FROM (SELECT DISTINCT framework AS f FROM ends)) AS frameworks, (SELECT count(*) FROM l)::BIGINT AS logins,
{", ".join(f"(SELECT bool_or(regexp_matches(line, {_q(p)})) FROM code) AS {k}" for k, p in recon.AUTH_MARKS)}""")
def attack_surface(spark, sf_dir):
    s = recon.attack_surface(code_lines(spark, sf_dir))
    return s.select("endpoints", "frameworks", F.when(F.col("login_endpoints") == "", 0).otherwise(F.size(F.split("login_endpoints", ","))).cast("long").alias("logins"), *(k for k, _ in recon.AUTH_MARKS))


_HTML = """'<p>x</p><form action="/go' || page_id || '" method=post><input name=q value="a b"><INPUT TYPE=''hidden'' name="t"></form><form><input></form><script src=" /a.js "></script><script>var x</script><script async src=b.js></script>'"""


@query(f"""SELECT page_id, 2::BIGINT AS forms, '/go' || page_id AS action, 'post' AS method, 'q:text:a b|t:hidden:' AS inputs, ':GET::text:' AS second, '/a.js,b.js' AS scripts, len(regexp_extract_all(html, '(?i)<script[^>]*>'))::BIGINT AS tags FROM pages""")
def page_forms(spark, sf_dir):
    """Forms, inputs and scripts of each page with a form put before it."""
    p = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html", F.expr(_HTML).alias("added"))
    f = p.select("page_id", "html", web.html_forms(F.concat("added", "html")).alias("f"), web.html_scripts(F.col("added")).alias("s"))
    shown = lambda i: F.array_join(F.transform(F.col("f")[i]["inputs"], lambda x: F.concat_ws(":", x["name"], x["input_type"], x["value"])), "|")
    tags = F.size(F.regexp_extract_all("html", F.lit("(?i)(<script[^>]*>)"), F.lit(1))).cast("long")
    return f.select("page_id", F.size("f").cast("long").alias("forms"), F.col("f")[0]["action"].alias("action"), F.col("f")[0]["method"].alias("method"), shown(0).alias("inputs"), F.concat(F.col("f")[1]["action"], F.lit(":"), F.col("f")[1]["method"], F.lit(":"), shown(1)).alias("second"), F.array_join("s", ",").alias("scripts"), tags.alias("tags"))


@query(f"""{CODE_SQL}, f AS (SELECT path, list(line ORDER BY line_no) AS l FROM code GROUP BY path), one AS (SELECT * FROM f ORDER BY len(l) DESC, path LIMIT 1), n AS (SELECT unnest(range(2, 5)) AS i)
SELECT i::BIGINT AS line_no, lpad(i::VARCHAR, 6, ' ') || ' | ' || l[i] AS shown FROM one, n WHERE i <= len(l) UNION ALL SELECT 5, '... (' || (len(l) - 4) || ' more lines — read_file with start_line=5)' FROM one WHERE len(l) > 4""")
def numbered_lines(spark, sf_dir):
    f = files(spark, sf_dir).withColumnRenamed("path", "rel_path")
    first = f.withColumn("n", F.size(F.split("content", "\n"))).orderBy(F.desc("n"), "rel_path").first()
    return src.numbered_file(f, first["rel_path"], 2, 3)


@query(f"""{CODE_SQL} SELECT DISTINCT path AS rel_path FROM code ORDER BY 1 LIMIT 25""")
def listed_files(spark, sf_dir):
    return src.list_files(files(spark, sf_dir).withColumnRenamed("path", "rel_path"), 25)


@query(f"""{CODE_SQL} SELECT path, min(line_no)::BIGINT AS rank FROM code WHERE contains(line, 'password') GROUP BY path""")
def files_in_order(spark, sf_dir):
    return search.files_in_order(code_lines(spark, sf_dir).filter(F.col("line").contains("password")).select("path", F.col("line_no").alias("rank")))


@query("""SELECT doc_id, len(l) >= 3 AS same, CASE WHEN len(l) >= 2 THEN array_to_string(list_concat(l[1:1], ['a', 'b', 'c', 'd', 'e'], l[3:]), chr(10)) END AS five FROM (SELECT doc_id, string_split(text, chr(10)) AS l, text FROM documents) WHERE len(l) >= 3 AND NOT ends_with(text, chr(10))""")
def guarded_fix(spark, sf_dir):
    """Replacements of one line by five lines, which the guard lets through, and by six, which it refuses."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").filter((F.size(F.split("text", "\n")) >= 3) & ~F.col("text").endswith("\n"))
    fix = lambda n: ex.guarded_replacement(F.col("text"), F.lit(2), F.lit(2), F.lit("\n".join("abcdefgh"[:n])))
    return d.select("doc_id", fix(6).isNull().alias("same"), fix(5).alias("five"))


@query("""SELECT o_orderkey AS k, CASE o_orderkey % 4 WHEN 0 THEN 7 WHEN 1 THEN o_orderkey % 100 END::VARCHAR AS number FROM orders""")
def pull_numbers(spark, sf_dir):
    k = F.col("o_orderkey")
    ref = F.when(k % 4 == 1, F.concat(F.lit("refs/pull/"), (k % 100).cast("string"), F.lit("/merge"))).when(k % 4 == 2, "refs/heads/main").otherwise("refs/pull/99999999999/merge")
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(k.alias("k"), web.pull_number(F.when(k % 4 == 0, 7), ref).cast("string").alias("number"))


#: Lines of one file for each framework, and the routes they must give: (method, path, handler, line, guarded).
FRAMEWORKS = {
    "nestjs": ("ts", ("@Controller('users')", "export class UsersController {", "  @Post()", "  create(@Body() dto: Dto) {", "  }", "  @UseGuards(JwtAuthGuard)", "  @Get(':id')", "  findOne(@Param('id') id: string) {"), (("POST", "/users", "create", 4, False), ("GET", "/users/:id", "findOne", 8, True))),
    "spring": ("java", ('@RequestMapping("/api")', "public class ItemController {", '  @GetMapping("/items")', "  public List<Item> list() {", "  }", '  @PostMapping("/items")', '  @PreAuthorize("hasRole(1)")', "  public Item add(Item x) {"), (("GET", "/api/items", "list", 3, False), ("POST", "/api/items", "add", 6, True))),
    "rails": ("rb", ("Rails.application.routes.draw do", "  get '/health', to: 'health#show'", "  resources :posts, only: [:index, :create]", "end"), (("GET", "/health", "health#show", 2, False), ("GET", "/posts", "posts#index", 3, False), ("POST", "/posts", "posts#create", 3, False))),
    "gin": ("go", ("r := gin.Default()", 'v1 := r.Group("/v1", authMiddleware())', 'v1.GET("/me", getMe)', 'r.POST("/ping", ping)'), (("GET", "/v1/me", "getMe", 3, True), ("POST", "/ping", "ping", 4, False))),
    "laravel": ("php", ("Route::get('/open', [HomeController::class, 'index']);", "Route::middleware(['auth:sanctum'])->group(function () {", "    Route::post('/orders', 'OrderController@store');", "    Route::apiResource('photos', PhotoController::class);", "});", "Route::any('/any', [AnyController::class, 'go'])->middleware('throttle');"),
        (("GET", "/open", "HomeController@index", 1, False), ("POST", "/orders", "OrderController@store", 3, True), ("GET", "/photos", "PhotoController@index", 4, True), ("POST", "/photos", "PhotoController@store", 4, True), ("GET", "/photos/{id}", "PhotoController@show", 4, True), ("PUT", "/photos/{id}", "PhotoController@update", 4, True), ("PATCH", "/photos/{id}", "PhotoController@update", 4, True), ("DELETE", "/photos/{id}", "PhotoController@destroy", 4, True), ("ANY", "/any", "AnyController@go", 6, False))),
    "actix": ("rs", ('#[get("/users")]', "#[allow(unused)]", "async fn list_users() -> impl Responder {", "}", 'web::resource("/items")', "    .route(web::post()", "        .to(create_item))", ".to(nothing)"), (("GET", "/users", "list_users", 3, False), ("GET", "/items", "create_item", 7, False))),
}
_EXPECTED = ", ".join(f"({_q(k)}, {_q(m)}, {_q(p)}, {_q(h)}, {n}, {str(a).lower()})" for k, (_, _, rows) in FRAMEWORKS.items() for m, p, h, n, a in rows)


@query(f"SELECT 'c' || c_custkey || '/' || framework AS file, framework, method, path, handler, line_no::BIGINT AS line_no, auth_required FROM customer, (VALUES {_EXPECTED}) v(framework, method, path, handler, line_no, auth_required)")
def framework_routes(spark, sf_dir):
    """A file of each framework for each customer."""
    rows = [(k, ext, i + 1, line) for k, (ext, lines, _) in FRAMEWORKS.items() for i, line in enumerate(lines)]
    each = F.broadcast(spark.createDataFrame(rows, "framework string, ext string, line_no long, line string"))  # a fixed few lines
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string"), F.lit("/")).alias("c"))
    lines = c.crossJoin(each).select(F.concat("c", "framework").alias("path"), "ext", "line_no", "line")
    return recon.endpoints(lines).select("file", "framework", "method", "path", "handler", "line_no", "auth_required")


@query(f"""{FOUND_SQL} SELECT id, lower(confidence) AS confidence, 'external/owasp/' || lower(owasp_category) AS tag, CASE WHEN contains(cwe_id, 'CWE-79') THEN 'xss' ELSE 'other' END = 'xss' AS xss FROM found""")
def sarif_properties(spark, sf_dir):
    """Confidence label and risk tag in the second SARIF shape."""
    from findgrid.plans import reports

    r = reports.sarif_with_rules(found(spark, sf_dir))
    return r.select("id", F.get_json_object("line", "$.properties.confidence").alias("confidence"), F.get_json_object("line", "$.properties.tags[0]").alias("tag"), (F.get_json_object("line", "$.ruleId") == "xss").alias("xss"))


@query(f"""{CODE_SQL} SELECT path, line_no, octet_length(encode(line)) > 20 AS long FROM code WHERE {_any("line", ("password",))}""")
def long_lines(spark, sf_dir):
    """Lines are matched whole however long they are: each is put behind 20,000 blanks and still found."""
    from findgrid.operators import rules

    l = code_lines(spark, sf_dir).select("path", "ext", "line_no", F.concat(F.repeat(F.lit(" "), F.lit(20_000)), F.lit("x "), "line").alias("line"))
    rule = rules.Rule("Password", "Low", "Low", "A07:2021", "password")
    f = rules.match_rules(l, (rule,), "test", skip_comments=False)
    return f.select(F.col("file_path").alias("path"), F.col("line_number").alias("line_no"), (F.octet_length(F.substr("code_snippet", F.lit(3), F.length("code_snippet"))) > 20).alias("long"))
