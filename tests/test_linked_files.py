"""Files that taint connects: every source file and sink file, whatever the number of calls and of functions of a name."""

import random

import pytest
from pyspark.sql import functions as F

from findgrid.operators import findings as fs
from findgrid.operators import flow
from findgrid.plans import queries_misc

COLUMNS = "path string, ext string, content string"
ENTRY = "def start(req):\n    q = request.args\n    go(q)\n"
CALLEE = "def go(q):\n    cursor.execute(q)\n"


def pairs(spark, files):
    sources, sinks, links = flow.linked_files(files)
    rows = [(r.s, r.t) for r in links.join(sources, "from_class").join(sinks.withColumnRenamed("path", "to_path"), "to_class").select(F.col("path").alias("s"), F.col("to_path").alias("t")).collect()]
    assert len(rows) == len(set(rows))  # one link a pair
    return set(rows)


def brute(code, depth=None, most=None):
    """Pairs of files by a search from each function that reads input."""
    funcs = [(p, f[1].lower(), f[2], f[3], [(x["line"], x["text"]) for x in f[4]]) for p, t in code.items() for f in flow._functions(p, "py", t.split("\n"))]
    names = ("kind", "line", "target", "arg", "hops", "detail")
    events = {(p, l, e): [dict(zip(names, x, strict=True)) for x in flow._summary(n, params, body, e, [])] for p, n, l, params, body in funcs for e in (None, *params)}
    out = set()
    for path, _, line, *_ in funcs:
        if not any(e["kind"] == "source" for e in events[path, line, None]):
            continue
        seen, todo = {(path, line, None)}, [((path, line, None), 0)]
        while todo:
            (p, l, entry), calls = todo.pop(0)
            for e in events[p, l, entry]:
                if e["kind"] == "sink":
                    out.add((path, p))
                elif e["kind"] == "call" and (depth is None or calls < depth):
                    named = sorted((f for f in funcs if f[1] == e["target"]), key=lambda f: (f[0], f[2]))
                    for f in ([f for f in named if f[0] == p] or named)[:most]:
                        if e["arg"] < len(f[3]) and (state := (f[0], f[2], f[3][e["arg"]])) not in seen:
                            seen.add(state)
                            todo.append((state, calls + 1))
    return out


def table(spark, code):
    return spark.createDataFrame([(p, "py", t) for p, t in code.items()], COLUMNS)


def some_code(seed, n_files=24, names="abcdefghijklmno"):
    """Functions that read input, hand arguments to each other by few names, and end in sinks; some in one file."""
    r, code = random.Random(seed), {}
    for k in range(n_files):
        parts = []
        for _ in range(r.randint(1, 3)):
            params = r.sample(["x", "y"], r.randint(1, 2))
            body = ["    z = request.args"] if r.random() < 0.3 else []
            known = [*params, "z"] if body else params
            body += [f"    {r.choice(names)}_fn({', '.join(r.choice([*known, '1']) for _ in range(r.randint(1, 2)))})" for _ in range(r.randint(1, 3))]
            body += [f"    popen({r.choice(known)})"] if r.random() < 0.25 else []
            parts.append("\n".join([f"def {r.choice(names)}_fn({', '.join(params)}):", *body, "    return 1"]))
        code[f"f{k}.py"] = "\n".join(parts) + "\n"
    return code


@pytest.mark.parametrize("seed", [9, 13])
def test_pairs_are_those_of_a_search_from_each_source(spark, seed):
    code = some_code(seed)
    want = brute(code)
    assert pairs(spark, table(spark, code)) == want and len(want) > 10


def test_no_files_and_no_links(spark):
    files = table(spark, {"a.py": "def f(x):\n    return x\n"})
    assert pairs(spark, files) == set() and pairs(spark, files.limit(0)) == set()


def test_own_sinks_and_cycles(spark):
    own = "def run(x):\n    cmd = request.args\n    exec(cmd)\n"
    loop = {"u.py": "def start(req):\n    q = request.args\n    ping(q)\n", "v.py": "def ping(a):\n    pong(a)\n", "w.py": "def pong(a):\n    ping(a)\n    exec(a)\n"}
    assert pairs(spark, table(spark, {"a.py": own, "b.py": own, **loop})) == {("a.py", "a.py"), ("b.py", "b.py"), ("u.py", "w.py")}


def test_chain_flow_counts_every_source_and_every_function_of_a_name(spark, monkeypatch):
    code = {"m.py": ENTRY, "n.py": ENTRY, **{f"f{k}.py": CALLEE for k in range(9)}}
    found = [(str(k), "Hardcoded password in config" if p in "m.py n.py" else "Mass assignment risk", p, 5.0) for k, p in enumerate(code)]
    monkeypatch.setattr(queries_misc, "files", lambda *_: table(spark, code))
    monkeypatch.setattr(queries_misc, "found", lambda *_: spark.createDataFrame(found, "id string, title string, file_path string, risk double"))
    (row,) = queries_misc.chain_flow(spark, "").collect()
    assert (row.chain, row.paths) == ("Privilege Escalation", 2 * 9)
    before = fs.chains(queries_misc.found()).first().risk
    assert row.risk == pytest.approx(min(before + 1.5, 10.0))


def test_calls_of_any_depth(spark):
    code = {"s.py": "def start(req):\n    q = request.args\n    step_0(q)\n", **{f"c{k}.py": f"def step_{k}(v):\n    step_{k + 1}(v)\n" for k in range(6)}, "t.py": "def step_6(v):\n    exec(v)\n"}
    files = table(spark, code)
    assert pairs(spark, files) == {("s.py", "t.py")}
    assert flow.trace(files).count() == 0
    (row,) = flow.trace(files, depth=None).collect()
    assert (row.source_path, row.sink_path, row.calls) == ("s.py", "t.py", 7)


def test_trace_takes_all_functions_of_a_name_if_asked(spark):
    files = table(spark, {"m.py": ENTRY, "m2.py": ENTRY, **{f"f{k}.py": CALLEE for k in range(9)}})
    assert {r.sink_path for r in flow.trace(files, callees=None).collect()} == {f"f{k}.py" for k in range(9)}
    assert {r.sink_path for r in flow.trace(files).collect()} == {"f0.py", "f1.py"}


@pytest.mark.parametrize("limits", [(2, 1), (None, None)])
def test_trace_reaches_the_sinks_of_a_search(spark, limits):
    code = some_code(9)
    got = flow.trace(table(spark, code), *limits).collect()
    want = brute(code, *limits)
    assert {r.sink_path for r in got} == {t for _, t in want} and {(r.source_path, r.sink_path) for r in got} <= want
