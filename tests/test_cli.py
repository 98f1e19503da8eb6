"""The command line: every report is written and read back, nothing is cut."""

import json
import os

import pytest

from findgrid import cli

LONG = "x" * 3000


@pytest.fixture(scope="module")
def project(tmp_path_factory):
    at = tmp_path_factory.mktemp("project")
    (at / "src").mkdir()
    (at / "src" / "app.js").write_text("function handle(req) {\n  let name = req.body.name;\n  passOn(name);\n}\n")
    (at / "src" / "lib.js").write_text("function passOn(name) {\n  exec(name);\n}\n")
    (at / "src" / "a.py").write_text("password = 'abc12345'\nrequests.get(u, verify=False)\n" + "".join(f"h{i} = md5(data)\n" for i in range(70)))
    (at / "note.txt").write_text(f"start {LONG} token=abc123 end\n")
    (at / "requirements.txt").write_text("flask==0.12.0\ndjango==1.0\n")
    return str(at)


def run(capsys, *args):
    code = cli.main(list(args))
    return code, capsys.readouterr().out


def read(folder):
    return "".join(open(os.path.join(folder, x)).read() for x in sorted(os.listdir(folder)) if x.startswith("part-"))


def test_rows_are_whole(spark, project, tmp_path, capsys):
    rows = [json.loads(x) for x in run(capsys, "review", project, "--max-findings", "0")[1].splitlines()]
    assert sum(r["title"].startswith("Weak Hash") for r in rows) == 70
    assert len(run(capsys, "review", project, "--max-findings", "5")[1].splitlines()) == 5
    redacted = {r["path"]: r["content"] for r in map(json.loads, run(capsys, "redact", project, "--limit", "0")[1].splitlines())}
    assert redacted["note.txt"] == f"start {LONG} token: *** end\n"
    run(capsys, "redact", project, "--output", f"{tmp_path}/red")
    assert {r["path"] for r in map(json.loads, read(f"{tmp_path}/red").splitlines())} == set(redacted)
    trace = [json.loads(x) for x in run(capsys, "trace", project)[1].splitlines()]
    assert [[s["action"] for s in r["steps"]] for r in trace] == [["source", "call", "sink"]] and trace[0]["source_line"] == 2


def test_ask_reads_the_index_and_init_updates_it(spark, project, capsys):
    run(capsys, "init", project)
    first = json.loads(run(capsys, "ask", project, "passOn", "handle")[1].splitlines()[0])
    assert first["path"] == "src/app.js" and "passOn(name)" in first["content"]
    assert json.loads(run(capsys, "status", project)[1])["files"] >= 4


def test_all_scanners_meet_in_ci_and_report(spark, project, tmp_path, capsys):
    code, out = run(capsys, "ci", project, "--fail-on", "critical")
    steps = {s["source"]: s["total"] for s in json.loads(out)["steps"]}
    assert code == 1 and {"security-review", "dependency-scanner", "taint-trace"} <= set(steps)
    rows = [json.loads(x) for x in run(capsys, "report", project, "--format", "json", "--limit", "0")[1].splitlines()]
    assert len({(r["file_path"], r["line_number"], r["title"].lower()) for r in rows if "line_number" in r}) == sum("line_number" in r for r in rows)
    assert sum(r["file_path"] == "src/a.py" and r["line_number"] == 1 for r in rows) == 1  # a credential that two scanners find
    few = ("--scanners", "secrets")
    for form, part in (("markdown", "Security score"), ("html", "<!DOCTYPE html>"), ("executive", "Riskiest:")):
        run(capsys, "report", project, *few, "--format", form, "--output", f"{tmp_path}/{form}")
        assert part in read(f"{tmp_path}/{form}")
    run(capsys, "report", project, *few, "--format", "sarif", "--output", f"{tmp_path}/sarif")
    assert [r["locations"][0]["physicalLocation"]["artifactLocation"]["uri"] for r in json.loads(read(f"{tmp_path}/sarif"))["runs"][0]["results"]] == ["src/a.py"]
    (tmp_path / "changed.json").write_text(json.dumps({"path": "src/a.py", "patch": "@@ -1,0 +1,1 @@\n+password = 'abc12345'"}) + "\n")
    out = run(capsys, "pr", project, *few, "--changed", f"file://{tmp_path}/changed.json")[1]
    assert out.startswith("## ") and "src/a.py:1" in out
    assert "spdxVersion" in run(capsys, "sbom", project, "--format", "spdx")[1]
