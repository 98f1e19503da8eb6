"""Attack surface of a code base: routes of web frameworks, authentication marks, missions, targets, an offline crawl."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from findgrid.functions import web
from findgrid.functions.html import page_analysis
from findgrid.functions.scores import cascade, contains_any, ladder, strip
from findgrid.functions.shared import dealt, save_table
from findgrid.functions.web import resolve_url

# Words and patterns that results depend on.
AUTH_WORDS = ("auth", "jwt", "token", "session", "login", "guard", "passport", "oauth", "permission", "role", "admin", "protect", "secure", "credential", "sanctum", "acl", "mfa")
_PY_ROUTE = r"""@(app|router|bp|blueprint)\.(get|post|put|delete|patch|options|head|route)\s*\(\s*(?:path\s*=\s*)?['"]([^'"]+)['"]"""
_JS_ROUTE = r"""\b(app|router)\.(get|post|put|delete|patch|options|head)\s*\(\s*['"]([^'"]+)['"]"""
_AXUM = r"""\.route\s*\(\s*["']([^"']+)["']\s*,\s*(\w+)\(([^)]*)\)"""
_GIN_GROUP = r"""\b([a-zA-Z_][a-zA-Z0-9_]*)\s*(?::=|:=|=)\s*(?:r|router|engine|e)\.Group\(\s*['"]([^'"]+)['"]([^)]*)"""
_GIN_ROUTE = r"""\b([a-zA-Z_][a-zA-Z0-9_]*)\.(GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS)\s*\(\s*['"]([^'"]+)['"]"""
_RAILS = r"""\b(get|post|put|patch|delete)\s+['"]([^'"]+)['"]"""
AUTH_MARKS = (
    ("jwt", r"(?i)(jsonwebtoken|pyjwt|\bjose\b|\bjwt\b|\.jwt|jwt_secret|signing_key|token_secret|hs256|rs256)"),
    ("session_cookies", r"(?i)(express-session|cookie-parser|request\.session|flask\.session|session_start|set_cookie|session_store|session_id|session_key|cookie_store)"),
    ("api_key_auth", r"""(?i)(x-api-key|api_key|apikey|api-key|authorization\s*[:=]\s*["']?bearer)"""),
    ("oauth", r"(?i)(\boauth\b|passport|openid|oidc|client_secret|redirect_uri|authorization_code)"),
)
ENV_SECRET = r"(?i)([A-Z][A-Z0-9_]*(?:secret|key|token|password|credential)[A-Z0-9_]*)"
MISSIONS = (
    ("Authentication & session hardening", "auth", ("login", "signin", "sign_in", "sign-in", "authenticate", "auth", "token", "session", "otp", "2fa", "mfa")),
    ("Path traversal & arbitrary file read", "path-traversal", ("file", "download", "read", "page", "doc", "template", "include", "static", "asset", "media", "upload", "img", "image")),
    ("Server-side request forgery", "ssrf", ("fetch", "proxy", "url", "uri", "redirect", "link", "callback", "webhook", "import", "external")),
    ("Command injection", "cmdi", ("ping", "host", "ip", "exec", "cmd", "command", "shell", "run", "trace", "lookup", "dns", "resolve")),
)
IDOR, GENERAL, REST = "IDOR / broken object-level authorization", "Injection & reflected XSS", "General exploitation (remaining surface)"


def is_auth_word(text: Column) -> Column:
    return contains_any(F.lower(text), AUTH_WORDS)


def join_path(base: Column, path: Column) -> Column:
    b, p = (F.btrim(strip(x), F.lit("\"'")) for x in (base, path))
    tail = F.regexp_replace(p, "^/+", "")
    return cascade([((b == "") & (p == ""), "/"), (b == "", F.concat(F.lit("/"), tail)), (p == "", b)], F.concat(F.regexp_replace(b, "/+$", ""), F.lit("/"), tail))


def python_routes(lines: DataFrame) -> DataFrame:
    """Decorated handlers: the name of the next function within 8 lines; authentication marks up to its signature."""
    l = lines.filter("ext = 'py'").select(F.col("path").alias("file"), "line_no", "line", strip(F.col("line")).alias("t"))
    w = Window.partitionBy("file").orderBy("line_no")
    name = F.regexp_extract("line", r"\b(?:async\s+)?(?:fn|def|function)\s+([a-zA-Z_][a-zA-Z0-9_]*)", 1)
    low = F.lower("t")
    depends = low.contains("depends(") & contains_any(low, ("user", "auth", "token", "oauth", "role", "permission", "admin", "require"))
    marked = F.col("t").startswith("@") & contains_any(low, ("login_required", "jwt_required", "require_", "roles_required", "permission_required"))
    frame = lambda a, b: w.rowsBetween(a, b)
    l = l.withColumn("handler", F.coalesce(F.first(F.when(name != "", name), True).over(frame(1, 8)), F.lit("")))
    l = l.withColumn("def_at", F.first(F.when(F.col("t").rlike("^(async )?def "), F.col("line_no")), True).over(frame(0, 7)))
    l = l.withColumn("auth_at", F.first(F.when(depends | marked, F.col("line_no")), True).over(frame(0, 7)))
    m = lambda i: F.regexp_extract("line", _PY_ROUTE, i)
    listed = F.upper(F.btrim(strip(F.regexp_extract("line", r"methods\s*=\s*\[([^,\]]*)", 1)), F.lit("\"'")))
    method = F.when(m(2) == "route", F.when(listed == "", "GET").otherwise(listed)).otherwise(F.upper(m(2)))
    auth = F.coalesce(F.col("auth_at") < F.coalesce("def_at", F.lit(1 << 40)), F.lit(False))
    kind = F.when((m(1) == "router") | (m(2) != "route"), "fastapi").otherwise("flask")
    return l.filter(F.col("line").rlike(_PY_ROUTE)).select(method.alias("method"), m(3).alias("path"), "handler", "file", "line_no", auth.alias("auth_required"), kind.alias("framework"))


def express_routes(lines: DataFrame) -> DataFrame:
    """app.get('/x', middleware, handler): the last argument is the handler, words of authentication among the others count."""
    l = lines.filter(F.col("ext").isin("js", "ts", "jsx", "tsx") & F.col("line").rlike(_JS_ROUTE))
    m = lambda i: F.regexp_extract("line", _JS_ROUTE, i)
    after = F.regexp_extract("line", _JS_ROUTE + "(.*)$", 4)
    args = F.filter(F.transform(F.split(F.regexp_extract(after, r"^([^)]*)", 1), ","), lambda x: strip(x)), lambda x: x != "")
    l = l.select(F.col("path").alias("file"), "line_no", F.upper(m(2)).alias("method"), m(3).alias("path"), after.alias("after"), args.alias("args"))
    inline = F.col("after").contains("=>") | F.col("after").contains("function")
    last = F.regexp_replace(F.coalesce(F.try_element_at("args", F.lit(-1)), F.lit("")), r"^[^\p{IsAlphabetic}\p{N}_.$#]+|[^\p{IsAlphabetic}\p{N}_.$#]+$", "")
    auth = F.when(inline, is_auth_word(F.col("after"))).otherwise(F.exists(F.slice("args", 1, F.greatest(F.size("args") - 1, F.lit(0))), lambda x: is_auth_word(x)))
    return l.select("method", "path", F.when(inline, "<inline>").otherwise(last).alias("handler"), "file", "line_no", auth.alias("auth_required"), F.lit("express").alias("framework"))


def axum_routes(lines: DataFrame) -> DataFrame:
    """.route("/x", get(handler)): the first verb only."""
    l = lines.filter((F.col("ext") == "rs") & F.col("line").rlike(_AXUM))
    m = lambda i: F.regexp_extract("line", _AXUM, i)
    verb = F.lower(m(2))
    method = F.when(verb.isin("get", "post", "put", "delete", "patch", "options", "head", "any"), F.upper(verb)).otherwise("?")
    inner = strip(m(3))
    handler = F.when(inner.rlike(r"\{|\|\||async|=>"), "<closure>").otherwise(strip(F.element_at(F.split(F.btrim(inner, F.lit("\"'")), "::"), -1)))
    return l.select(method.alias("method"), m(1).alias("path"), handler.alias("handler"), F.col("path").alias("file"), "line_no", F.lit(False).alias("auth_required"), F.lit("axum").alias("framework"))


def gin_routes(lines: DataFrame) -> DataFrame:
    """v.GET("/x", ...) with the prefix and middleware of the last group that the file assigns to v."""
    l = lines.filter("ext = 'go'").select(F.col("path").alias("file"), "line_no", "line")
    g = lambda i: F.regexp_extract("line", _GIN_GROUP, i)
    groups = l.filter(F.col("line").rlike(_GIN_GROUP)).select("file", g(1).alias("var"), F.struct("line_no", g(2).alias("prefix"), is_auth_word(g(3)).alias("group_auth")).alias("x")).groupBy("file", "var").agg(F.max("x").alias("x"))
    m = lambda i: F.regexp_extract("line", _GIN_ROUTE, i)
    args = F.filter(F.transform(F.split(F.regexp_extract("line", _GIN_ROUTE + r"([^)]*)", 4), ","), lambda x: strip(x)), lambda x: x != "")
    r = l.filter(F.col("line").rlike(_GIN_ROUTE)).select("file", "line_no", m(1).alias("var"), m(2).alias("method"), m(3).alias("p"), args.alias("args")).join(groups, ["file", "var"], "left")
    last = F.regexp_replace(F.coalesce(F.try_element_at("args", F.lit(-1)), F.lit("")), r"^[^\p{IsAlphabetic}\p{N}_.*]+|[^\p{IsAlphabetic}\p{N}_.*]+$", "")
    own = F.exists(F.slice("args", 1, F.greatest(F.size("args") - 1, F.lit(0))), lambda x: is_auth_word(x))
    return r.select("method", F.when(F.col("x").isNull(), F.col("p")).otherwise(join_path(F.col("x.prefix"), F.col("p"))).alias("path"), last.alias("handler"), "file", "line_no", (own | F.coalesce("x.group_auth", F.lit(False))).alias("auth_required"), F.lit("gin").alias("framework"))


def rails_routes(lines: DataFrame) -> DataFrame:
    """Verb lines, and `resources` as its seven routes less those that only: and except: leave out."""
    l = lines.filter("ext = 'rb'").select(F.col("path").alias("file"), "line_no", "line")
    verb = l.filter(F.col("line").rlike(_RAILS)).select(F.upper(F.regexp_extract("line", _RAILS, 1)).alias("method"), F.regexp_extract("line", _RAILS, 2).alias("path"), F.regexp_extract("line", r"""\bto:\s*['"]([^'"]+)['"]""", 1).alias("handler"), "file", "line_no")
    res = l.filter(~F.col("line").rlike(_RAILS)).withColumn("n", F.regexp_extract("line", r"\bresources\s+:([a-zA-Z_][a-zA-Z0-9_]*)", 1)).filter("n <> ''")
    seven = (("GET", "", "index"), ("GET", "/new", "new"), ("POST", "", "create"), ("GET", "/:id", "show"), ("GET", "/:id/edit", "edit"), ("PATCH", "/:id", "update"), ("DELETE", "/:id", "destroy"))
    names = lambda k: F.transform(F.split(F.regexp_extract("line", rf"\b{k}:\s*\[([^\]]*)\]", 1), ","), lambda x: F.btrim(F.regexp_replace(strip(x), "^:+", ""), F.lit("\"'")))
    x = res.select("file", "line_no", "n", F.col("line").rlike(r"\bonly:\s*\[").alias("has_only"), names("only").alias("only"), names("except").alias("skip"), F.explode(F.array(*(F.struct(F.lit(a).alias("m"), F.lit(b).alias("p"), F.lit(c).alias("a")) for a, b, c in seven))).alias("r"))
    x = x.filter(F.expr("(NOT has_only OR array_contains(only, r.a)) AND NOT array_contains(skip, r.a)"))
    table = x.select(F.col("r.m").alias("method"), F.concat(F.lit("/"), "n", "r.p").alias("path"), F.concat("n", F.lit("#"), "r.a").alias("handler"), "file", "line_no")
    return verb.unionByName(table).withColumn("auth_required", F.lit(False)).withColumn("framework", F.lit("rails"))


# Patterns of NestJS and Spring annotations.
_IDENT = r"\b([a-zA-Z_][a-zA-Z0-9_]*)\s*\("
_NEST = r"""@(Get|Post|Put|Delete|Patch|Options|Head)\s*(?:\(\s*['"]([^'"]*)['"]\s*\))?"""
_SPRING = r"@(Get|Post|Put|Delete|Patch)Mapping"
_QUOTED = r"""['"]([^'"]+)['"]"""


def _annotated(lines: DataFrame, exts: tuple[str, ...], verb: str, scope: str, prefix: Column, guard: Column, method: Column, path: Column, framework: str, at_handler: bool) -> DataFrame:
    """Handlers that an annotation precedes: the prefix of the last class annotation, and the next line that declares a name
    before the next annotation of its kind; a guard counts between the class annotation (nest) or the handler's (spring) and it."""
    l = lines.filter(F.col("ext").isin(*exts)).select(F.col("path").alias("file"), "line_no", strip(F.col("line")).alias("t"))
    w = Window.partitionBy("file").orderBy("line_no")
    up, down = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(1, Window.unboundedFollowing)
    t = F.col("t")
    is_verb, is_scope = t.rlike(verb), t.rlike(scope) & ~t.rlike(verb)
    name = F.regexp_extract(F.regexp_extract(t, r"^([^{=;]*)", 1), _IDENT, 1)
    declares = ~t.startswith("@") & (name != "")
    l = l.withColumn("base", F.last(F.when(is_scope, prefix), True).over(up)).withColumn("scope_at", F.last(F.when(is_scope, F.col("line_no")), True).over(up)).withColumn("guard_at", F.last(F.when(guard, F.col("line_no")), True).over(up))
    l = l.withColumn("next", F.first(F.when(declares, F.struct("line_no", name.alias("name"), t.alias("t"), "guard_at")), True).over(down)).withColumn("other", F.first(F.when(is_verb | is_scope, F.col("line_no")), True).over(down))
    l = l.filter(is_verb & F.col("next").isNotNull() & (F.col("other").isNull() | (F.col("other") > F.col("next.line_no"))))
    inside = contains_any(F.col("next.t"), ("SecurityContext", "AuthenticationPrincipal", "RequestHeader", "Authorization")) | (F.col("next.guard_at") > F.col("line_no"))
    auth = F.col("guard_at") > F.coalesce("scope_at", F.lit(0)) if at_handler else inside
    return l.select(method.alias("method"), join_path(F.coalesce("base", F.lit("")), path).alias("path"), F.col("next.name").alias("handler"), "file", (F.col("next.line_no") if at_handler else F.col("line_no")).alias("line_no"), F.coalesce(auth, F.lit(False)).alias("auth_required"), F.lit(framework).alias("framework"))


def nest_routes(lines: DataFrame) -> DataFrame:
    """@Get(':id') below @Controller('users'), with @UseGuards between; the handler's line."""
    t = F.col("t")
    pre = F.concat(F.lit("/"), F.regexp_replace(F.regexp_extract(t, _QUOTED, 1), "^/+", ""))
    return _annotated(lines, ("ts",), _NEST, r"@Controller\s*\(", pre, t.rlike(r"@UseGuards\s*\(\s*[A-Za-z_]"), F.upper(F.regexp_extract(t, _NEST, 1)), F.regexp_extract(t, _NEST, 2), "nestjs", True)


def spring_routes(lines: DataFrame) -> DataFrame:
    """@GetMapping("/x") below a class's @RequestMapping; the annotation's line."""
    t = F.col("t")
    pre = F.concat(F.lit("/"), F.regexp_replace(F.regexp_extract(t, _QUOTED, 1), "^/+", ""))
    path = F.regexp_extract(t, _QUOTED, 1)
    return _annotated(lines, ("java", "kt"), _SPRING, r"@RequestMapping\s*\(", pre, t.rlike(r"@PreAuthorize|@Secured|@RolesAllowed"), F.upper(F.regexp_extract(t, _SPRING, 1)), F.when(path == "", "/").otherwise(path), "spring", False)


# Patterns of Laravel and actix routes.
_LARAVEL = r"""Route::(get|post|put|patch|delete|any)\s*\(\s*['"]([^'"]+)['"]"""
_LARAVEL_RESOURCE = r"""Route::(?:apiResource|resource)\s*\(\s*['"]([^'"]+)['"]"""
_LARAVEL_GROUP = r"""Route::middleware\s*\(\s*(\[[^\]]*\]|['"][^'"]+['"])"""
_CLASS = r"([A-Za-z_\\]+)\s*::class"
_CLASS_METHOD = r"""\[[A-Za-z_\\]+\s*::class\s*,\s*['"]([A-Za-z_][A-Za-z0-9_]*)['"]\]"""
_AT_METHOD = r"""['"]([A-Za-z_\\]+@[a-zA-Z_][A-Za-z0-9_]*)['"]"""
_QUOTED_NAME = r"""['"]([A-Za-z_][A-Za-z0-9_]*)['"]"""
_RESOURCE_ROUTES = (("GET", "", "index"), ("GET", "/create", "create"), ("POST", "", "store"), ("GET", "/{id}", "show"), ("GET", "/{id}/edit", "edit"), ("PUT", "/{id}", "update"), ("PATCH", "/{id}", "update"), ("DELETE", "/{id}", "destroy"))
_ACTIX = r"""#\[(get|post|put|delete|patch|head|options)\s*\(\s*["']([^"']+)["']\s*\)\]"""
_ACTIX_FN = r"\b(?:async\s+)?fn\s+([a-zA-Z_][a-zA-Z0-9_]*)\s*\("
_ACTIX_RESOURCE = r"""web::resource\s*\(\s*["']([^"']+)["']"""
_ACTIX_TO = r"\.to\s*\(\s*([a-zA-Z_][a-zA-Z0-9_:]*)"


def _or_null(text: Column) -> Column:
    return F.when(text != "", text)


def laravel_routes(lines: DataFrame) -> DataFrame:
    """Verbs and resources. A group's middleware says whether the routes below it are guarded until all groups are closed: the
    state after a line is that of the last line that set it, so it is a running window, not a loop."""
    l = lines.filter("ext = 'php'").select(F.col("path").alias("file"), "line_no", strip(F.col("line")).alias("t"))
    t, w = F.col("t"), Window.partitionBy("file").orderBy("line_no")
    middleware, group = t.startswith("Route::middleware"), t.startswith("Route::group")
    closes = ~middleware & ~group & (t.startswith("});") | t.startswith(");"))
    l = l.withColumn("depth", F.sum(F.when(middleware | group, 1).when(closes, -1).otherwise(0)).over(w))
    names = _or_null(F.regexp_extract(t, _LARAVEL_GROUP, 1))
    sets = F.when(middleware & names.isNotNull(), is_auth_word(names)).when(group & t.contains("middleware") & is_auth_word(t), F.lit(True)).when(closes & (F.col("depth") == 0), F.lit(False))
    l = l.withColumn("in_group", F.coalesce(F.last(sets, True).over(w), F.lit(False))).filter(~middleware & ~group & ~closes)
    resource = F.regexp_extract(t, _LARAVEL_RESOURCE, 1)
    rest = F.regexp_replace(t, "^.*?" + _LARAVEL_RESOURCE, "")
    name = F.regexp_replace(resource, "^/+", "")
    controller = F.coalesce(_or_null(F.regexp_extract(rest, _CLASS, 1)), _or_null(F.regexp_extract(rest, _QUOTED_NAME, 1)), name)
    some = F.filter(F.array(*(F.struct(F.lit(a).alias("m"), F.lit(b).alias("p"), F.lit(c).alias("a")) for a, b, c in _RESOURCE_ROUTES)), lambda x: ~t.contains("apiResource") | ~x["a"].isin("create", "edit"))
    out = ("method", "path", "handler", "file", "line_no", "auth_required")
    table = l.filter(resource != "").select("file", "line_no", "in_group", name.alias("n"), controller.alias("c"), F.explode(some).alias("r"))
    table = table.select(F.col("r.m").alias("method"), F.concat(F.lit("/"), "n", "r.p").alias("path"), F.concat("c", F.lit("@"), "r.a").alias("handler"), "file", "line_no", F.col("in_group").alias("auth_required"))
    own = _or_null(F.regexp_extract(t, r"(->middleware\([^)]*)\)", 1))
    method = _or_null(F.regexp_extract(t, _CLASS_METHOD, 1))
    handler = F.coalesce(F.concat(F.regexp_extract(t, _CLASS, 1), F.lit("@"), method), F.regexp_extract(t, _AT_METHOD, 1))
    verbs = l.filter((resource == "") & t.rlike(_LARAVEL)).select(F.upper(F.regexp_extract(t, _LARAVEL, 1)).alias("method"), F.regexp_extract(t, _LARAVEL, 2).alias("path"), handler.alias("handler"), "file", "line_no", F.when(own.isNotNull(), is_auth_word(own)).otherwise(F.col("in_group")).alias("auth_required"))
    return verbs.select(*out).unionByName(table.select(*out)).withColumn("framework", F.lit("laravel"))


def actix_routes(lines: DataFrame) -> DataFrame:
    """Attribute lines and the next function, at its line; and web::resource up to the next .to(), over lines, as GET: the compat
    behaviour. Lines between an attribute and its function hold no resource."""
    l = lines.filter("ext = 'rs'").select(F.col("path").alias("file"), "line_no", strip(F.col("line")).alias("t"))
    t, w = F.col("t"), Window.partitionBy("file").orderBy("line_no")
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    attr = t.rlike(_ACTIX)
    is_fn = ~attr & t.rlike(_ACTIX_FN)
    l = l.withColumn("attr", F.last(F.when(attr, F.struct("line_no", F.upper(F.regexp_extract(t, _ACTIX, 1)).alias("m"), F.regexp_extract(t, _ACTIX, 2).alias("p"))), True).over(past)).withColumn("fn_at", F.last(F.when(is_fn, F.col("line_no")), True).over(past))
    pending = F.col("attr").isNotNull() & (F.col("fn_at").isNull() | (F.col("fn_at") < F.col("attr.line_no")))
    of_attr = l.filter(pending & is_fn).select(F.col("attr.m").alias("method"), F.col("attr.p").alias("path"), F.regexp_extract(t, _ACTIX_FN, 1).alias("handler"), "file", "line_no")
    to = F.regexp_extract(t, _ACTIX_TO, 1)
    free = l.filter(~pending & ~attr).withColumn("turn", F.coalesce(F.sum((to != "").cast("int")).over(past), F.lit(0)))
    first = F.first(_or_null(F.regexp_extract(t, _ACTIX_RESOURCE, 1)), True).over(Window.partitionBy("file", "turn").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0))
    of_resource = free.withColumn("p", first).filter((to != "") & F.col("p").isNotNull()).select(F.lit("GET").alias("method"), F.col("p").alias("path"), to.alias("handler"), "file", "line_no")
    return of_attr.unionByName(of_resource).withColumn("auth_required", F.lit(False)).withColumn("framework", F.lit("actix"))


#: Extensions that any route parser reads.
ROUTE_EXTS = ("py", "js", "ts", "jsx", "tsx", "rs", "go", "rb", "java", "kt", "php")


def endpoints(lines: DataFrame) -> DataFrame:
    """All routes, one for each method, path, file and line. The lines that any parser reads are written once for all parsers, and
    dealt out by file into tasks of bounded size, as are the routes."""
    lines = save_table(lines.filter(F.col("ext").isin(*ROUTE_EXTS)).select("path", "ext", "line_no", "line"), "code")
    n = lines.count()
    lines = dealt(lines, "path", rows=n)
    out = python_routes(lines)
    for parse in (express_routes, axum_routes, gin_routes, rails_routes, nest_routes, spring_routes, laravel_routes, actix_routes):
        out = out.unionByName(parse(lines))
    return dealt(out, "file", "line_no", rows=n).dropDuplicates(["method", "path", "file", "line_no"])


# Patterns of names of guards, and of paths at which one logs in.
MIDDLEWARE = r"(?i)([a-z_][a-z0-9_]*(?:auth|jwt|token|session|login|guard|permission|role|protect|secure|sanctum)[a-z0-9_]*)"
LOGIN = r"(?i)(login|signin|sign-in|sign_in|authenticate|auth|token|session)"


def guard_names(lines: DataFrame, most: int = 12) -> DataFrame:
    """(name): the first `most` distinct names that read like guards, by path and line."""
    names = lines.select("path", "line_no", F.posexplode(F.regexp_extract_all("line", F.lit(MIDDLEWARE), F.lit(1))).alias("pos", "name"))
    return names.groupBy("name").agg(F.min(F.struct("path", "line_no", "pos")).alias("at")).orderBy("at", "name").limit(most).select("name", "at")


def login_endpoints(ends: DataFrame, most: int = 10) -> DataFrame:
    """(endpoint): the first `most` POST routes whose path reads like a login, by file and line."""
    hit = ends.filter((F.col("method") == "POST") & F.col("path").rlike(LOGIN))
    return hit.orderBy("file", "line_no", "path").limit(most).select(F.concat(F.lit("POST "), "path").alias("endpoint"), F.struct("file", "line_no", "path").alias("at"))


def _joined(df: DataFrame, column: str, name: str) -> DataFrame:
    return df.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", column))), lambda x: x[column]), ",").alias(name))


def attack_surface(lines: DataFrame) -> DataFrame:
    """One row: number of endpoints, frameworks, marks of authentication, secrets, guards and login endpoints."""
    ends = save_table(endpoints(lines), "endpoints")
    sums = ends.agg(F.count("*").alias("endpoints"), F.array_join(F.array_sort(F.collect_set("framework")), ",").alias("frameworks"))
    out = sums.crossJoin(auth_marks(lines)).crossJoin(_joined(guard_names(lines), "name", "middleware"))
    return out.crossJoin(_joined(login_endpoints(ends), "endpoint", "login_endpoints"))  # one row each


def auth_marks(lines: DataFrame) -> DataFrame:
    """One row: whether lines show tokens, session cookies, API keys, OAuth, and the first ten names of secrets read from the environment."""
    flags = lines.agg(*(F.coalesce(F.bool_or(F.col("line").rlike(p)), F.lit(False)).alias(k) for k, p in AUTH_MARKS))
    env = lines.filter(contains_any(F.col("line"), ("env(", "os.environ", "process.env", "getenv"))).select(F.explode(F.regexp_extract_all("line", F.lit(ENV_SECRET), F.lit(1))).alias("s"), "path", "line_no")
    first = env.groupBy("s").agg(F.min(F.struct("path", "line_no")).alias("at")).orderBy("at", "s").limit(10)
    return flags.crossJoin(first.agg(F.array_join(F.array_sort(F.collect_list("s")), ",").alias("secrets")))  # one row each


def mission(path: Column, method: Column) -> Column:
    """struct(focus, classes) of an endpoint, by whole segments of its path; the first row that holds decides."""
    p = F.lower(path)
    segs = F.split(p, r"[/\-_.]")
    s = lambda f, *c: F.struct(F.lit(f).alias("focus"), F.array(*map(F.lit, c)).alias("classes"))
    rows = [(F.arrays_overlap(segs, F.array(*map(F.lit, words))), s(f, c)) for f, c, words in MISSIONS]
    idor = p.contains("{") | p.contains(":") | F.array_contains(segs, "resource") | (F.upper(method) == "DELETE")
    return cascade([*rows, (idor, s(IDOR, "idor"))], s(GENERAL, "sqli", "xss"))


ALL_CLASSES = ("sqli", "xss", "cmdi", "ssrf", "path-traversal", "idor", "auth")
EMPTY_SURFACE = "General web exploitation"


def plan(ends: DataFrame, most: int | None = None) -> DataFrame:
    """Rows (focus, n, classes, seen): endpoints by mission, `seen` its place in the order in which missions are first met; with
    `most`, the largest stay and the rest is one. One general mission of all classes without endpoints. A handful of rows."""
    at = F.struct("file", "line_no", "path", "method") if {"file", "line_no"} <= set(ends.columns) else F.struct("path", "method")
    m = ends.select(mission(F.col("path"), F.col("method")).alias("m"), at.alias("at")).groupBy("m.focus").agg(F.count("*").alias("n"), F.first("m.classes").alias("classes"), F.min("at").alias("at"))
    m = m.withColumn("seen", F.row_number().over(Window.orderBy("at"))).drop("at")
    general = ends.sparkSession.createDataFrame([(EMPTY_SURFACE, 0, list(ALL_CLASSES), 1)], "focus string, n long, classes array<string>, seen int")
    m = m.unionByName(general.join(m.agg(F.count("*").alias("k")), F.col("k") == 0).drop("k"))
    if most is None:
        return m
    n_all = m.withColumn("r", F.row_number().over(Window.orderBy(F.desc("n"), "focus"))).withColumn("k", F.count("*").over(Window.partitionBy()))
    focus = F.when((F.col("k") <= most) | (F.col("r") < most), F.col("focus")).otherwise(REST)
    return n_all.groupBy(focus.alias("focus")).agg(F.sum("n").alias("n"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("classes")))).alias("classes"), F.min("seen").alias("seen"))


def restrict(missions: DataFrame, allowed: list[str]) -> DataFrame:
    """Missions with the allowed classes only; those left without one go; if none is left, one general mission of the allowed
    classes. No allowed class: no restriction."""
    if not allowed:
        return missions
    m = missions.withColumn("classes", F.array_intersect("classes", F.array(*map(F.lit, allowed)))).filter(F.size("classes") > 0)
    general = missions.sparkSession.createDataFrame([(f"{EMPTY_SURFACE} (config-restricted)", 0, list(allowed), 1)], "focus string, n long, classes array<string>, seen int")
    return m.unionByName(general.select(*missions.columns).join(m.agg(F.count("*").alias("k")), F.col("k") == 0).drop("k"))


def concrete_path(path: Column) -> Column:
    """{x} and :x as 1."""
    return F.regexp_replace(F.regexp_replace(path, r"\{[^}]+\}", "1"), r":[\p{IsAlphabetic}][\p{IsAlphabetic}\p{N}_]*", "1")


def path_params(path: Column) -> Column:
    return F.transform(F.regexp_extract_all(path, F.lit(r"(\{[^}]+\}|:[\p{IsAlphabetic}][\p{IsAlphabetic}\p{N}_]*)"), F.lit(1)), lambda x: F.regexp_replace(x, r"[{}:]", ""))


def sweep_targets(ends: DataFrame, base: str, focus: list[tuple[str, str]] | None = None) -> DataFrame:
    """Rows (method, url, params): one for each method and URL, the first by place, of the URLs that the focus rules allow."""
    t = ends.filter("path <> '/'").select("method", resolve_url(F.lit(base), concrete_path(F.col("path"))).alias("url"), F.array_join(path_params(F.col("path")), ",").alias("params"), "file", "line_no")
    t = t.filter(allows_url(F.col("url"), focus or []))
    return t.groupBy("method", "url").agg(F.min(F.struct("file", "line_no", "params")).alias("x")).select("method", "url", "x.params")


def url_parts(url: Column) -> Column:
    """struct(host, path, query) of an http(s) URL, else null: the host in lower case without port, the path from the first slash
    ("/" if there is none), the query after the first question mark behind it."""
    rest = F.regexp_replace(url, "^https?://", "")
    tail = F.when(rest.contains("/"), F.regexp_replace(rest, "^[^/]*", "")).otherwise("/")
    host = F.lower(F.regexp_extract(rest, "^([^/:]*)", 1))
    return F.when(url.rlike("^https?://"), F.struct(host.alias("host"), F.regexp_extract(tail, r"(?s)^([^?]*)", 1).alias("path"), F.regexp_extract(tail, r"(?s)\?(.*)$", 1).alias("query")))


def _rule_holds(kind: str, value: str, parts: Column, method: Column, headers: Column) -> Column:
    if kind == "url_path":
        v = value.strip().strip("/")
        return F.array_contains(F.split(parts["path"], "/"), v) if v else F.lit(True)
    if kind in ("domain", "subdomain"):
        v = value.strip().lstrip(".")
        return (parts["host"] == v) | parts["host"].endswith("." + v)
    if kind == "method":
        return F.lower(method) == value.lower()
    if kind == "header":
        name, colon, want = value.partition(":")
        if not colon:
            return F.exists(headers, lambda h: F.lower(h["name"]) == value.lower())
        return F.exists(headers, lambda h: (F.lower(h["name"]) == name.strip().lower()) & F.contains(F.lower(h["value"]), F.lit(want.strip().lower())))
    if kind == "parameter":
        return F.exists(F.split(parts["query"], "&"), lambda p: F.regexp_extract(p, r"(?s)^([^=]*)", 1) == value)
    return F.lit(False)  # code_path: of files, not of requests


def scope_allows(url: Column, avoid: list[tuple[str, str]], focus: list[tuple[str, str]], method: Column | None = None, headers: Column | None = None) -> Column:
    """Whether a request may be sent: avoid wins; with focus one of its rules must hold; URLs that aren't http(s) are allowed.
    Rules are (kind, value): url_path (a whole segment), domain, subdomain, method, header ("name" or "name: part of the
    value"), parameter, code_path. headers: array of (name, value)."""
    method = F.lit("GET") if method is None else method
    headers = F.array().cast("array<struct<name:string,value:string>>") if headers is None else headers
    either = lambda rules: any_of([F.coalesce(_rule_holds(*r, url_parts(url), method, headers), F.lit(False)) for r in rules])
    ok = ~either(avoid) & (either(focus) if focus else F.lit(True))
    return F.when(url.rlike("^https?://"), ok).otherwise(True)


def any_of(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, cols, F.lit(False))


def allows_url(url: Column, focus: list[tuple[str, str]]) -> Column:
    """Whether focus rules allow a URL: no rule allows all; a rule that a URL alone can't decide holds."""
    if not focus:
        return F.lit(True)
    undecided = ("method", "header", "parameter", "code_path")
    return any_of([F.lit(True) if k in undecided else F.coalesce(_rule_holds(k, v, url_parts(url), F.lit(""), F.lit(None)), F.lit(False)) for k, v in focus])


def crawl(pages: DataFrame, links: DataFrame, seeds: DataFrame, depth: int = 2, most: int | None = 20) -> DataFrame:
    """Breadth-first pages (url, depth) from seeds (url) over links (src, dst) that stay among pages (url): one join a level,
    pages seen before left out. most: pages in all, by depth and url."""
    front = save_table(seeds.select("url").distinct().join(pages.select("url"), "url", "left_semi").withColumn("depth", F.lit(0)), "crawl")
    seen = front
    for d in range(1, depth + 1):
        nxt = front.select(F.col("url").alias("src")).join(links, "src").select(F.col("dst").alias("url")).distinct().join(pages.select("url"), "url", "left_semi").join(seen.select("url"), "url", "left_anti")
        front = save_table(nxt.withColumn("depth", F.lit(d)), "crawl")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen.orderBy("depth", "url").limit(most) if most else seen


def crawl_sites(pages: DataFrame, seeds: DataFrame, depth: int = 2, most: int | None = 20, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """A crawl of each site through saved pages (url, html), breadth first from its seeds (site, url, ord). Of pages with one URL
    the one counts that has no fragment, else the least URL; copies of a URL are told apart by a column `ord` of pages, the first
    one counts, or without it by their text.

    The link graph is drawn from the pages as they are reached: targets of anchors, resolved, of the page's own origin, without a
    fragment. A level is a join of its frontier with the pages, so only pages that are reached are parsed; the queue's order is
    (visit of the page that links, place of the link), a URL counts where it first stands, and a site's first `most` pages count.
    Returns pages (site, visit, url, depth, title, forms, links) and what a sweep would try: targets (site, method, url, params) of
    forms and links, each (method, url) once and a link only if no form or link had its URL before."""
    key = web.strip_fragment(F.col("url"))
    by = F.struct("url", *(["ord"] if "ord" in pages.columns else []), "html")
    there = save_table(pages.filter("url IS NOT NULL").select(key.alias("url"), by.alias("p")).groupBy("url").agg(F.min("p").alias("p")).select("url", "p.html"), "pages")
    queue = seeds.select("site", web.strip_fragment(F.trim("url")).alias("url"), F.struct(F.lit(0).cast("long").alias("visit"), F.col("ord").cast("long").alias("no")).alias("place"))
    seen = counts = None
    visited, wanted = [], []
    for d in range(depth + 1):
        front = queue.groupBy("site", "url").agg(F.min("place").alias("place"))
        if seen is not None:
            front = front.join(seen, ["site", "url"], "left_anti")
        front = save_table(front, "frontier")
        if front.isEmpty():
            break
        seen = front.select("site", "url") if seen is None else seen.unionByName(front.select("site", "url"))
        here = front.join(there, "url")
        if most is not None:
            order = F.row_number().over(Window.partitionBy("site").orderBy("place")).cast("long")
            here = here.withColumn("r", order).filter(F.col("r") <= most)
            if counts is not None:
                here = here.join(counts, "site", "left").withColumn("r", F.col("r") + F.coalesce("n", F.lit(0))).filter(F.col("r") <= most).drop("n")
        else:
            here = here.withColumn("r", F.xxhash64("site", "url"))  # no order is needed where all pages count
        here = save_table(here.select("site", "url", F.col("r").alias("visit"), page_analysis("html", strict).alias("a")), "crawled")
        visited.append(here.select("site", "visit", "url", F.lit(d).alias("depth"), "a.title", F.size("a.forms").alias("forms"), F.size("a.links").alias("links")))
        if most is not None:
            upto = here.groupBy("site").agg(F.max("visit").alias("n"))
            counts = upto if counts is None else save_table(counts.unionByName(upto).groupBy("site").agg(F.max("n").alias("n")), "counts")
        at = lambda kind: F.struct(F.lit(d).alias("depth"), "visit", F.lit(kind).alias("kind"), F.col("no").cast("long").alias("no"))
        form = here.select("site", "visit", F.col("url").alias("page"), F.posexplode("a.forms").alias("no", "f"))
        params = F.transform(F.filter("f.inputs", lambda i: i["name"] != ""), lambda i: F.struct(i["name"].alias("name"), i["value"].alias("value")))
        wanted.append(form.select("site", "page", at(0).alias("at"), F.when(F.lower("f.method") == "get", "GET").otherwise("POST").alias("method"), web.resolve_url(F.col("page"), F.col("f.action")).alias("url"), params.alias("params")).filter(web.same_origin(F.col("page"), F.col("url"))))
        link = here.select("site", "visit", F.col("url").alias("page"), F.posexplode("a.links").alias("no", "l")).withColumn("url", web.resolve_url(F.col("page"), F.col("l")))
        link = link.filter(web.same_origin(F.col("page"), F.col("url")) & ~F.col("url").contains("#"))
        wanted.append(link.select("site", "page", at(1).alias("at"), F.lit("GET").alias("method"), "url", web.query_params(F.col("url")).alias("params")))
        queue = link.select("site", "url", F.struct("visit", F.col("no").cast("long").alias("no")).alias("place"))
    if not visited:
        visited, wanted = [front.select("site", F.lit(0).cast("long").alias("visit"), "url", F.lit(0).alias("depth"), F.lit("").alias("title"), F.lit(0).alias("forms"), F.lit(0).alias("links"))], None
    out = reduce(DataFrame.unionByName, visited)
    if wanted is None:
        return out, front.select("site", F.lit("").alias("method"), "url", F.array().cast("array<struct<name: string, value: string>>").alias("params"))
    every = save_table(reduce(DataFrame.unionByName, wanted).drop("page"), "wanted")
    first = every.groupBy("site", "url").agg(F.min("at").alias("first"))
    valid = every.join(first, ["site", "url"]).filter((F.col("at.kind") == 0) | (F.col("at") == F.col("first")))
    targets = valid.groupBy("site", "method", "url").agg(F.min_by("params", "at").alias("params"))
    return out, targets
