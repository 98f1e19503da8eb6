"""Cases of single operators with literal rows."""

import pytest
from pyspark.sql import functions as F

from findgrid.functions import scores, web
from findgrid.operators import configs
from findgrid.operators import dependencies as dep
from findgrid.operators import diffs, flow, recon, rules, search
from findgrid.operators import findings as fs
from findgrid.plans.fixtures import files
from findgrid.plans.queries_findings import found
from findgrid.plans.queries_misc import chain_flow
from findgrid.sources import files as src
from findgrid.streaming.watch import Watch


def one(spark, col, **values):
    return spark.createDataFrame([tuple(values.values())] if values else [(0,)], ", ".join(f"{k} string" for k in values) if values else "x int").select(col).first()[0]


def finding(title, line, source, severity="Critical", expl=0.8, path="a.js", seq=0):
    return (seq, title, severity, "High", "Vulnerability", path, line, expl, source)


def table(spark, rows):
    f = spark.createDataFrame(rows, "seq long, title string, severity string, confidence string, finding_type string, file_path string, line_number long, exploitability double, source string")
    return fs.with_risk(f).withColumn("id", F.concat_ws("|", "seq", "title"))


def test_dedup_cases(spark):
    cases = [
        ([finding("Hardcoded Credentials", 5, "security-review"), finding("Password in Code", 5, "secret-scanner", seq=1)], 1),
        ([finding("SQL Injection", 5, "r"), finding("Command Injection", 5, "r", seq=1)], 2),
        ([finding("AWS Access Key ID", 5, "s"), finding("AWS Secret Access Key", 5, "s", seq=1)], 2),
        ([finding("Hardcoded Credentials", 10, "r"), finding("Hardcoded Credentials", 20, "r", seq=1)], 2),
    ]
    for rows, n in cases:
        assert fs.dedup(table(spark, rows)).count() == n
    kept = fs.dedup(table(spark, [finding("Hardcoded Credentials", 5, "r", "High", 0.4), finding("Password in Code", 5, "secret-scanner", "Critical", 0.9, seq=1)])).collect()
    assert [(r.source, r.seq) for r in kept] == [("secret-scanner", 0)]


def test_dedup_is_idempotent(spark):
    rows = [finding(t, i % 4, s, seq=k) for k, (t, i, s) in enumerate((t, i, s) for t in ("Token leak", "Password in Code", "XSS") for i in range(6) for s in ("a", "b"))]
    once = fs.dedup(table(spark, rows))
    assert sorted(map(str, fs.dedup(once).collect())) == sorted(map(str, once.collect()))


def test_chain_of_two_findings(spark):
    f = table(spark, [finding("Hardcoded password in config", 10, "r"), finding("Mass assignment risk", 30, "r", seq=1)])
    got = fs.chains(f).collect()
    assert [(r.chain, r.n_findings) for r in got] == [("Privilege Escalation", 2)]


def test_chain_flow_keeps_all_chains(spark):
    sf = "/root/testdata/sf0.001"
    f = found(spark, sf)
    chains = [(r.chain, r.entry_title, r.target_title, r.risk) for r in fs.chains(f).collect()]
    at = {}
    for r in f.select("title", "file_path").distinct().collect():
        at.setdefault(r.title, set()).add(r.file_path)
    paths = {(r.source_path, r.sink_path) for r in flow.trace(files(spark, sf)).collect()}
    want = []
    for chain, e, t, risk in chains:
        n = sum(a in at[e] and b in at[t] for a, b in paths)
        want.append((chain, e, t, round(min(risk + 1.5, 10.0) if n else risk, 6), n))
    assert len(want) > 8
    got = [(r.chain, r.entry_title, r.target_title, round(r.risk, 6), r.paths) for r in chain_flow(spark, sf).collect()]
    assert sorted(got) == sorted(want)


def test_security_score(spark):
    empty = table(spark, [finding("x", 1, "r")]).limit(0)
    score = scores.security_score(F.col("severity"), F.col("exploitability"), F.col("business_impact"))
    assert empty.agg(score).first()[0] == 100.0
    assert table(spark, [finding("x", 1, "r")]).agg(score).first()[0] < 100


@pytest.mark.parametrize(
    ("patch", "want"),
    [("@@ -1,3 +1,4 @@\n ctx\n-a\n+b\n+c\n ctx", [2, 3]), ("@@ -1 +5 @@\n x\n+y\n@@ -9 +21 @@\n+z", [6, 21]), ("", []), ("no hunk\n+x", [])],
)
def test_added_lines(spark, patch, want):
    assert sorted(r.line for r in diffs.added_lines(spark.createDataFrame([("p", patch)], "path string, patch string")).collect()) == want


def test_versions(spark):
    yes = [("1.0.0", "<1.0.1"), ("0.9.0", "<1.0.0"), ("1.0.0", "<=1.0.0"), ("1", "<2.0.0"), ("1.0", "<1.1.0")]
    no = [("1.0.0", "<1.0.0"), ("2.0.0", "<=1.9.9"), ("abc", "<1.0.0")]
    got = spark.createDataFrame(yes + no, "v string, c string").select(dep.version_matches(F.col("v"), F.col("c"))).collect()
    assert [r[0] for r in got] == [True] * 5 + [False] * 3


def test_import_tokens(spark):
    lines = spark.createDataFrame([("app.js", "import _ from 'lodash'"), ("lib.py", "import requests"), ("main.rs", "use serde::X;")], "path string, line string")
    m = {r.token: r.files for r in dep.usage_map(lines).collect()}
    assert m["lodash"] == ["app.js"] and m["requests"] == ["lib.py"] and m["serde"] == ["main.rs"]


def test_exclusion_and_binary(spark):
    paths = ["/p/node_modules/express/index.js", "/p/Cargo.lock", "/p/logo.svg", "/p/src/main.rs", "/p/Cargo.toml", "/p/src/builder.py"]
    got = spark.createDataFrame([(p,) for p in paths], "p string").select(src.is_excluded(F.col("p")).alias("a"), src.is_excluded_strict(F.col("p")).alias("b")).collect()
    assert [r.a for r in got] == [True, True, True, False, False, True]
    assert [r.b for r in got] == [True, True, True, False, False, False]
    raw = [(b"",), (b"text",), (b"\x00\x01\x02\xff",), (b"A" * (11 << 20),)]
    assert [r[0] for r in spark.createDataFrame([(bytearray(x[0]),) for x in raw], "c binary").select(src.is_binary(F.col("c"))).collect()] == [True, False, True, True]


def test_walk_reads_a_folder(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.py").write_text("x = 1\r\ny = 2\n")
    (tmp_path / "vendor").mkdir()
    (tmp_path / "vendor" / "b.py").write_text("z")
    f = src.walk(spark, str(tmp_path))
    got = [(r.line_no, r.line) for r in src.lines(f.filter("rel_path = 'src/a.py'")).orderBy("line_no").collect()]
    assert got == [(1, "x = 1"), (2, "y = 2")]
    assert {r.rel_path for r in f.collect()} == {"src/a.py"}


def test_redaction(spark):
    t = web.redact_text(F.col("t"))
    assert one(spark, t, t="token=abc123 password=hunter2 normal text") == "token: *** password: *** normal text"
    assert one(spark, t, t="the token was rotated yesterday") == "the token was rotated yesterday"


def test_html(spark):
    assert one(spark, web.html_to_text(F.col("t")), t="<p>a &amp; b &x &lt;</p>") == "a & b &x &lt;"
    assert one(spark, web.extract_code(F.col("t")), t="1234 and 123456") == "123456"
    assert one(spark, web.percent_encode(F.col("t")), t="a b*~é") == "a%20b%2A~%C3%A9"


def test_chunks_cover_and_end():
    text = "\n".join("x" * 2100 for _ in range(12))
    got = search.chunk_text(text)
    assert {i for a, b, _ in got for i in range(a, b + 1)} == set(range(1, 13))
    assert search.chunk_text("") == [] and search.chunk_text("\n\n") == []


def test_calls():
    assert flow.calls_of("let ok = is_admin(user_id, role);") == [("is_admin", ["user_id", "role"])]
    assert [c for c, _ in flow.calls_of("foo(a); bar(b, c);")] == ["foo", "bar"]


def test_trace_over_a_call(spark):
    app = "function handle(req) {\n  name = req.body.name\n  validateAndExec(name)\n}\n"
    lib = "function validateAndExec(name) {\n  exec(name)\n}\n"
    files = spark.createDataFrame([("app.js", "js", app), ("lib.js", "js", lib)], "path string, ext string, content string")
    got = {(r.source_path, r.sink_path, r.calls) for r in flow.trace(files, question="").filter("sink = 'exec'").collect()}
    assert ("app.js", "lib.js", 1) in got


def test_taint_steps_of_three_files(spark):
    code = {
        "app.js": "function handle(req) {\n  let id = 7;\n  note(id);\n  let name = req.body.name;\n  let full = name + id;\n  passOn(full);\n}\n",
        "mid.js": "function passOn(value) {\n  // exec(value)\n  let kept = value;\n  runIt(1, kept);\n}\n",
        "lib.js": "function runIt(n, cmd) {\n  exec(cmd);\n}\n",
    }
    f = spark.createDataFrame([(p, "js", t) for p, t in code.items()], "path string, ext string, content string")
    paths, steps = flow.taint_paths(f)
    found = paths.collect()
    assert [(r.source_path, r.source_line, r.sink_path, r.sink_line, r.sink, r.risk, r.calls) for r in found] == [("app.js", 4, "lib.js", 2, "exec", 9.0, 2)]
    assert [(r.step, r.file, r.line, r.function, r.action) for r in sorted(steps.collect(), key=lambda r: r.step)] == [
        (1, "app.js", 4, "handle", "source"), (2, "app.js", 5, "handle", "flow"), (3, "app.js", 6, "handle", "call"),
        (4, "mid.js", 3, "passOn", "flow"), (5, "mid.js", 4, "passOn", "call"), (6, "lib.js", 2, "runIt", "sink"),
    ]
    assert {r.path_id for r in steps.select("path_id").distinct().collect()} == {found[0].path_id}


def test_taint_source_is_where_input_enters(spark):
    f = spark.createDataFrame([("a.py", "py", "def run(x):\n    y = 1\n    z = 2\n    cmd = request.args.get('c')\n    w = 3\n    exec(cmd)\n")], "path string, ext string, content string")
    assert [(r.source_line, r.sink_line, r.risk) for r in flow.trace(f).collect()] == [(4, 6, 9.3)]
    assert flow.trace(f.limit(0)).count() == 0 and flow.taint_paths(f.limit(0))[1].count() == 0


def test_between_files(spark):
    p = spark.createDataFrame([("/proj/src/app.js", "/proj/lib.js"), ("/proj/src/lib.js", "x.js")], "source_path string, sink_path string")
    assert flow.between_files(p, "src/app.js", "lib.js").count() == 1 and flow.between_files(p, "/a/proj/src/app.js", "lib.js").count() == 1 and flow.between_files(p, "other.js", "lib.js").count() == 0


def test_silent_catch_and_complexity(spark):
    body = "function f(a) {\n" + "  if (a) { b() }\n" * 8 + "  x()\n" * 90 + "}\n"
    catch = "try {\n  a()\n} catch (e) {\n}\n"
    files = spark.createDataFrame([("a.js", "js", body), ("b.js", "js", "try {\n a()\n}\ncatch (e)\n{ x() } }\n" + catch)], "path string, ext string, content string")
    # only lines that start with the word open a block; "} catch (e) {" is one, its end is the next line
    assert sorted((r.path, r.line_no, r.lines) for r in flow.silent_catches(files).collect()) == [("b.js", 4, 2), ("b.js", 8, 2)]
    assert sorted((r.path, r.line_no, r.name, r.kind, r.n) for r in flow.complex_functions(files).collect()) == [("a.js", 1, "f", "branches", 8), ("a.js", 1, "f", "lines", 99)]


def test_routes(spark):
    code = {
        "a.py": "@app.get('/health')\ndef health():\n  pass\n@app.get('/users')\nasync def users(u = Depends(get_current_user)):\n  pass\n@router.post('/items/{item_id}')\n@login_required\ndef item():\n  pass",
        "b.js": "app.get('/users', listUsers)\napp.post('/o', verifyToken, createOrder)\nrouter.delete('/u', requireAdmin, deleteUser)\napp.get('/x', (q, s) => 1)",
        "c.go": 'api := r.Group("/api", authMiddleware())\napi.GET("/users", getUsers)\nr.GET("/ping", ping)',
        "d.rb": "get '/x', to: 'a#b'\nresources :posts, only: [:index, :show]",
        "e.rs": '.route("/a", get(list))\n.route("/b", post(h).get(i))',
    }
    rows = [(p, p.split(".")[1], i, t) for p, c in code.items() for i, t in enumerate(c.split("\n"), 1)]
    e = {(r.file, r.method, r.path, r.handler, r.auth_required) for r in recon.endpoints(spark.createDataFrame(rows, "path string, ext string, line_no long, line string")).collect()}
    assert ("a.py", "GET", "/health", "health", False) in e and ("a.py", "POST", "/items/{item_id}", "item", True) in e
    assert {("b.js", "GET", "/users", "listUsers", False), ("b.js", "POST", "/o", "createOrder", True), ("b.js", "DELETE", "/u", "deleteUser", True), ("b.js", "GET", "/x", "<inline>", False)} <= e
    assert ("c.go", "GET", "/api/users", "getUsers", True) in e and ("c.go", "GET", "/ping", "ping", False) in e
    assert sum(x[0] == "d.rb" for x in e) == 3 and sum(x[0] == "e.rs" for x in e) == 2


def test_each_rule_has_a_line(spark):
    from findgrid.plans.fixtures import LINES

    lines = spark.createDataFrame([("f", x, i, t) for x in ("py", "php", "js") for i, t in enumerate(LINES)], "path string, ext string, line_no long, line string")
    seen = {r.title for r in rules.match_rules(lines, rules.rule_table("review"), "r").select("title").distinct().collect()}
    assert seen == {r.title for r in rules.REVIEW_RULES}


def test_register_rule(spark):
    rules.register_rule("own", rules.Rule("Todo", "Low", "Low", None, r"TODO"))
    got = rules.match_rules(spark.createDataFrame([("f", "py", 1, "x  TODO y")], "path string, ext string, line_no long, line string"), rules.rule_table("own"), "own").collect()
    assert [(r.title, r.cwe_id) for r in got] == [("Todo", "CWE-693")]


def test_watch(spark, tmp_path):
    w = Watch(spark, str(tmp_path))
    f = lambda *x: spark.createDataFrame([(v,) for v in x], "fingerprint string")
    assert [r[0] for r in w.apply(f("a", "b"), 0).collect()] == []
    assert [r[0] for r in w.apply(f("a", "c"), 1).collect()] == ["c"]
    assert [r[0] for r in w.apply(f("a", "b"), 2).collect()] == ["b"]
    assert [r[0] for r in w.apply(f("a", "b"), 2).collect()] == ["b"]


def test_totp_vector(spark):
    from findgrid.functions import codes

    assert codes.totp_at(b"12345678901234567890", 59, 8) == "94287082"
    assert spark.createDataFrame([("GEZDGNBVGY3TQOJQGEZDGNBVGY3TQOJQ", 59), ("1!", 59)], "s string, t long").select(codes.totp("s", "t")).collect() == [("287082",), (None,)]


def test_line_diff(spark):
    from findgrid.functions import codes

    d = spark.createDataFrame([("a\nb\nc", "a\nx\nc")], "a string, b string").select(codes.line_diff("a", "b")).first()[0]
    assert [(x.op, x.line) for x in d] == [("equal", "a"), ("delete", "b"), ("insert", "x"), ("equal", "c")]


def test_annotated_routes(spark):
    ts = "@Controller('users')\n@UseGuards(AuthGuard)\nexport class U {\n@Get(':id')\nfindOne(@Param() id) {\n@Post()\ncreate() {"
    java = '@RequestMapping("/api")\nclass C {\n@GetMapping("/x")\n@PreAuthorize("y")\npublic String x() {\n@PostMapping\npublic void y() {'
    php = "Route::get('/a', [C::class, 'index']);\nRoute::post('/b', [C::class, 'save'])->middleware('auth');"
    rs = '#[get("/h")]\nasync fn h() -> X {\nweb::resource("/r").route(web::get().to(r))'
    rows = [(f"f.{e}", e, i, t) for e, c in (("ts", ts), ("java", java), ("php", php), ("rs", rs)) for i, t in enumerate(c.split("\n"), 1)]
    e = {(r.framework, r.method, r.path, r.handler, r.auth_required) for r in recon.endpoints(spark.createDataFrame(rows, "path string, ext string, line_no long, line string")).collect()}
    assert {("nestjs", "GET", "/users/:id", "findOne", True), ("nestjs", "POST", "/users", "create", True)} <= e
    assert {("spring", "GET", "/api/x", "x", True), ("spring", "POST", "/api/", "y", False)} <= e
    assert {("laravel", "GET", "/a", "C@index", False), ("laravel", "POST", "/b", "C@save", True)} <= e
    assert {("actix", "GET", "/h", "h", False), ("actix", "GET", "/r", "r", False)} <= e


def test_walk_keeps_hidden_names_and_minds_ignore_files(spark, tmp_path):
    texts = {
        "__init__.py": "x", "_private/b.py": "x", ".hidden/c.py": "x", "a/_util.py": "x", "a/skip.log": "x", "a/keep.log": "x", "a/deep/x/gen/out.py": "x", "a/deep/gen.py": "x",
        "logs/d.py": "x", "a/logs/e.py": "x", "only/here.txt": "x", "a/only/here.txt": "x", "empty.py": "", "node_modules/m.js": "x", "w1.tmp": "x", "w12.tmp": "x",
        ".gitignore": "# c\n*.log\n!keep.log\n/logs/\n/only\ngen/\nw?.tmp\n", "a/.gitignore": "deep/gen.py\n",
    }
    for k, v in texts.items():
        (tmp_path / k).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / k).write_text(v)
    want = ["__init__.py", "_private/b.py", ".hidden/c.py", "a/_util.py", "a/keep.log", "a/logs/e.py", "a/only/here.txt", "w12.tmp"]
    assert sorted(r.rel_path for r in src.walk(spark, str(tmp_path)).collect()) == sorted(want)
    assert {"a/skip.log", "logs/d.py"} <= {r.rel_path for r in src.walk(spark, f"file://{tmp_path}", gitignore=False).collect()}
    assert [r.rel_path for r in src.walk(spark, str(tmp_path), depth=1, glob="*.py").collect()] == ["__init__.py"]
    assert src.listing(spark, str(tmp_path), depth=2).filter("rel_path LIKE 'a/deep/%'").count() == 0


def test_files_of_the_walk_are_read_in_deep_folders(spark, tmp_path):
    at = tmp_path
    for k in range(6):
        at = at / f"d{k}"
        at.mkdir()
        (at / f"f{k}.py").write_text(f"print({k})\n")
    assert {(r.rel_path.count("/"), r.content) for r in src.walk(spark, str(tmp_path)).collect()} == {(k + 1, f"print({k})\n") for k in range(6)}


def test_sarif_is_one_document_of_all_findings(spark):
    import json

    from findgrid.plans import reports

    f = table(spark, [finding(f"T{k}", k, "r", seq=k) for k in range(40)]).withColumn("cwe_id", F.lit("CWE-1"))
    for part in (f, f.limit(1), f.limit(0)):
        doc = json.loads("".join(r.line for r in reports.sarif(part).orderBy("part", "ord").collect()))
        assert len(doc["runs"][0]["results"]) == part.count() and doc["version"] == "2.1.0"


def test_reports(spark):
    from findgrid.plans import reports

    f = table(spark, [finding("<b>|x", 1, "r"), finding("Other", 2, "r", "Low", 0.2, seq=1)]).withColumn("remediation", F.lit("do"))
    page = reports.html(f, "A & B")
    assert "&lt;b&gt;|x" in page and "<title>A &amp; B</title>" in page and "<li>Critical: 1</li>" in page
    assert "Low: 1" in reports.executive(f)
    pull = reports.pull_request(f, f.filter("severity = 'Critical'"))
    assert "1 new findings, 1 from before" in pull and "<b>\\|x" in pull and "### Fixes" in pull


def test_merged_scanners_are_deduplicated(spark):
    a, b = (table(spark, [finding("Hardcoded Credentials", 5, s, e, 0.5)]).drop("seq") for s, e in (("one", "High"), ("two", "Critical")))
    kept = fs.dedup(fs.merge_scanners(a, b)).collect()
    assert [(r.source, r.severity) for r in kept] == [("two", "Critical")]
    assert [r.source for r in fs.merge_and_rank(fs.merge_scanners(a, b)).collect()] == ["two"]


def test_long_lines_are_matched(spark):
    l = spark.createDataFrame([("a.js", "js", 1, "x" * 50_000 + " password = 'abc12345'")], "path string, ext string, line_no long, line string")
    assert rules.match_rules(l, rules.rule_table("secrets"), "s", skip_comments=False).count() == 1


def test_in_order_numbers_all_rows(spark):
    from findgrid.functions.shared import before_it, in_order

    d = spark.range(500).select((F.col("id") * 7919 % 500).alias("v")).repartition(7)
    rows = before_it(in_order(d, F.desc("v")), F.col("v"), "prev").orderBy("_no").collect()
    assert [r.v for r in rows] == list(range(499, -1, -1)) and [r.prev for r in rows] == [None, *range(499, 0, -1)]
    assert in_order(d.limit(0), "v").count() == 0


def test_trace_takes_the_first_functions_of_a_name(spark):
    entry = "def start(req):\n    q = request.args\n    go(q)\n"
    callee = "def go(q):\n    cursor.execute(q)\n"
    f = spark.createDataFrame([("m.py", entry), *((f"f{k}.py", callee) for k in range(9))], "path string, content string").withColumn("ext", F.lit("py"))
    assert {r.sink_path for r in flow.trace(f).collect()} <= {"f0.py", "f1.py"}
    near = f.unionByName(spark.createDataFrame([("m2.py", entry + callee, "py")], "path string, content string, ext string"))
    assert {r.sink_path for r in flow.trace(near).collect() if r.source_path == "m2.py"} <= {"m2.py"}


def test_numbered_file_refuses_paths_outside(spark):
    f = spark.createDataFrame([("a.py", "1\n2\n3\n")], "rel_path string, content string")
    assert [r.shown for r in src.numbered_file(f, "a.py", 2, 1).collect()] == ["     2 | 2", "... (1 more lines — read_file with start_line=3)"]
    for path in ("/etc/x", "../x", "a/../../x"):
        with pytest.raises(ValueError):
            src.numbered_file(f, path)


def test_retest_of_one_finding(spark):
    from findgrid.operators import exchange as ex

    p = spark.createDataFrame([("SQLi in x", "/a", "sqli"), ("sqli IN X", "/b", "sqli"), ("Other", "/a", "xss")], "title string, endpoint string, bug_class string")
    got = {(r.endpoint, r.verdict) for r in ex.retest_finding("sqli in x", p, p.filter("endpoint = '/a'")).collect()}
    assert got == {("/a", "STILL VULNERABLE"), ("/b", "FIXED")}


def test_dependency_scan(spark):
    deps = spark.createDataFrame([("lodash", "4.17.0", "npm", "package.json"), ("safe", "9.0.0", "npm", "package.json")], "name string, version string, ecosystem string, manifest_file string")
    known = spark.createDataFrame([("npm", "Lodash", "<4.17.21", "CVE-1: x", "High")], "ecosystem string, name string, constraint string, description string, severity string")
    lines = spark.createDataFrame([(f"f{k}.js", "js", 1, "import x from 'lodash'") for k in range(6)], "path string, ext string, line_no long, line string")
    got = dep.dependency_findings(deps, known, lines).collect()
    assert [(r.name, r.n_files, r.usage, r.cve_id) for r in got] == [("lodash", 6, "used in 6 file(s): f0.js, f1.js, f2.js, f3.js (+2 more)", "CVE-1")]


def test_run_configs(spark):
    auth = '"authentication": {"login_type": "%s", "credentials": {"username": "ann", "password": ""}, "email": {"imap_host": " %s", "password": "pw"}}'
    texts = [None, "", "{", "[1]", "{}", '{"report": {"min_severity": "info", "min_confidence": "Low"}}', "{%s}" % (auth % ("email", "")), "{%s}" % (auth % ("email", "mx")), '{"exploit": "often"}', '{"vuln_classes": ["idor", "nope", null], "rules": {"focus": [{"type": "domain"}]}}']
    rows = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "path string, text string")
    got = {int(r.path): r for r in configs.checked(rows).collect()}
    assert [got[i].valid for i in range(len(texts))] == [False, False, False, False, True, False, True, True, False, False]
    assert got[4].live and got[4].classes == got[4].warnings == got[4].secrets == []
    assert got[5].errors == ["report.min_severity 'info' is invalid; expected critical|high|medium|low"]
    assert len(got[6].warnings) == 1 and got[7].warnings == [] and got[7].secrets == ["ann", "pw"]
    assert got[9].classes == ["idor"] and len(got[9].warnings) == 2 and got[9].errors == ["a rule needs a known type and a value"]


def test_run_config_files(spark, tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "a.yaml").write_text("exploit: false\nvuln_classes:\n  - sqli\nreport:\n  min_severity: high\n")
    (tmp_path / "b.json").write_text('{"report": {"min_confidence": "sure"}}')
    (tmp_path / "c.yml").write_text("a: [1")
    got = {r.path[-6:]: r for r in configs.read(spark, *(str(tmp_path / n) for n in ("a.yaml", "b.json", "c.yml"))).collect()}
    assert (got["a.yaml"].valid, got["a.yaml"].live, got["a.yaml"].classes) == (True, False, ["sqli"])
    assert not got["b.json"].valid and not got["/c.yml"].valid
