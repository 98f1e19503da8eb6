"""Formats of secrets with entropy, checksums and an allow list; the SARIF document with a rules table."""

import json
import math
import random
import string
import zlib
from collections import Counter

from pyspark.sql import functions as F

from findgrid.operators import secrets
from findgrid.plans import reports

B62 = string.digits + string.ascii_uppercase + string.ascii_lowercase


def with_checksum(prefix, body):
    crc, out = zlib.crc32(body.encode()), ""
    for _ in range(6):
        crc, k = divmod(crc, 62)
        out = B62[k] + out
    return prefix + body + out


def scan(spark, rows, allowed=None):
    lines = spark.createDataFrame([("f", i, x) for i, x in enumerate(rows)], "path string, line_no long, line string")
    return [(r.line_number, r.title, r.shown) for r in secrets.match_secrets(lines, allowed).orderBy("line_number", "title").collect()]


def luhn_number(body):
    total = sum(d if i % 2 else (2 * d - 9 * (d > 4)) for i, d in enumerate(int(c) for c in reversed(body)))
    return body + str(-total % 10)


def test_each_format_has_a_case(spark):
    r = random.Random(3)
    some = lambda n, a=string.ascii_letters + string.digits: "".join(r.choice(a) for _ in range(n))
    hexa, up = "0123456789abcdef", string.ascii_uppercase + string.digits
    cases = {
        "AWS Access Key ID": "id = ASIA" + some(16, up), "AWS Secret Access Key": 'aws_secret_access_key = "' + some(40) + '"', "GitHub Token": with_checksum("ghs_", some(30)), "GitHub Fine-Grained Token": f"github_pat_{some(22)}_{some(59)}",
        "GitLab Token": "glpat-" + some(20), "npm Token": "//r/:_auth=" + with_checksum("npm_", some(30)), "PyPI Token": "pypi-AgEIcHlwaS5vcmc" + some(60), "Slack Token": "xoxb-" + some(24), "Slack Webhook": f"https://hooks.slack.com/services/T{some(9, up)}/B{some(9, up)}/{some(24)}",
        "Discord Webhook": f"https://discord.com/api/webhooks/{some(18, string.digits)}/{some(68)}", "Telegram Bot Token": f"bot {some(9, string.digits)}:{some(35)} ", "Stripe Secret Key": "sk_live_" + some(24), "Stripe Webhook Secret": "whsec_" + some(32), "Square Token": "sq0atp-" + some(22), "Shopify Token": "shpat_" + some(32, hexa),
        "Google API Key": "AIza" + some(35), "Google OAuth Client Secret": "GOCSPX-" + some(28), "SendGrid Key": f"SG.{some(22)}.{some(43)}", "Mailgun Key": "key-" + some(32, hexa), "Mailchimp Key": some(32, hexa) + "-us12", "Twilio API Key": "SK" + some(32, hexa), "DigitalOcean Token": "dop_v1_" + some(64, hexa),
        "Databricks Token": "dapi" + some(32, hexa), "Hugging Face Token": "hf_" + some(34, string.ascii_letters), "Linear API Key": "lin_api_" + some(40), "Grafana Service Token": f"glsa_{some(32)}_{some(8, hexa)}", "age Secret Key": "AGE-SECRET-KEY-1" + some(58, "QPZRY9X8GF2TVDW0S3JN54KHCE6MUA7L"),
        "Heroku API Key": "HEROKU_API_KEY=0b3c1a2e-9f47-4d2a-8c1b-5e6f7a8b9c0d", "Private Key Block": "-----BEGIN EC PRIVATE KEY-----", "JSON Web Token": f"eyJ{some(12)}.eyJ{some(20)}.{some(12)}", "Password in URL": "postgres://app:s3cr3tPw@db.host/x", "Password in Code": "passwd: 'hunter2!x'", "Generic Token Assignment": f'api_key = "{some(20)}"',
        "Payment Card Number": "card " + luhn_number("453201511283036"),
    }
    assert set(cases) == {f.title for f in secrets.FORMATS} and len(cases) >= 25
    got = scan(spark, list(cases.values()))
    for i, title in enumerate(cases):
        assert (i, title) in {(n, t) for n, t, _ in got}, title


def test_checksums_entropy_and_shapes_that_are_no_secret(spark):
    body = "abcdefghijklmnopqrstuvwxyz0123"
    wrong = [with_checksum("ghp_", body)[:-1] + "!", "ghp_" + body + "000000", "npm_" + body + "zzzzzz", "card 4532015112830367", "AKIA" + "A" * 16, 'token = "aaaaaaaaaaaaaaaaaaaa"', "xoxb-", None, "", "x" * 100_000, "password = input()", "0." + "4111111111111111"]
    assert scan(spark, wrong) == []
    right = ["a " + luhn_number("453201511283036") + " b", with_checksum("ghp_", body) + " " + with_checksum("gho_", body[::-1])]
    assert sorted(scan(spark, right)) == [(0, "Payment Card Number", "4532***"), (1, "GitHub Token", "gho_***"), (1, "GitHub Token", "ghp_***")]


def test_allow_list(spark):
    one = with_checksum("ghp_", "k" * 29 + "z")
    allowed = spark.range(1).select(F.sha2(F.lit(f"GitHub Token:{one}"), 256).alias("fingerprint"))
    assert scan(spark, [one, "pwd = 'Sommer2024'"], allowed) == [(1, "Password in Code", "Somm***")]


def test_entropy(spark):
    texts = ["", "a", "abab", "hello world", "0123456789abcdef", "日本日本語"]
    got = [r.e for r in spark.createDataFrame([(t,) for t in texts], "t string").select(secrets.entropy(F.col("t")).alias("e")).collect()]
    for t, e in zip(texts, got, strict=True):
        assert abs(e + sum(n / len(t) * math.log2(n / len(t)) for n in Counter(t).values())) < 1e-9


def document(df):
    return json.loads("".join(r.line for r in df.orderBy("part", "ord").collect()))


def test_sarif_with_rules_is_one_document(spark):
    rows = [("b", "SQL", "A03:2021", "High", "CWE-89", "x.py", 3, "Use parameters."), ("a", "XSS", None, "Medium", "CWE-79", None, None, ""), ("c", "SQL again", "A01:2021", "Critical", "CWE-89", "y.py", 1, None)]
    f = spark.createDataFrame(rows, "id string, title string, owasp_category string, severity string, cwe_id string, file_path string, line_number long, remediation string").withColumn("finding_type", F.lit("Vulnerability"))
    d = document(reports.sarif_rules(f, F.col("cwe_id"), run={"target": "t"}))
    run = d["runs"][0]
    rules = run["tool"]["driver"]["rules"]
    assert [(r["id"], r["properties"]["tags"]) for r in rules] == [("CWE-79", ["security"]), ("CWE-89", ["security", "external/owasp/a03:2021"])]
    assert [(r["partialFingerprints"]["primaryLocationLineHash"], r["ruleIndex"], rules[r["ruleIndex"]]["id"] == r["ruleId"]) for r in run["results"]] == [("a", 0, True), ("b", 1, True), ("c", 1, True)]
    assert run["results"][1]["message"]["text"] == "SQL\n\n**Remediation:** Use parameters." and run["results"][0]["locations"] == [{"physicalLocation": {"artifactLocation": {"uri": ""}}}]
    assert run["properties"] == {"totalFindings": 3, "target": "t"} and run["columnKind"] == "utf16CodeUnits" and d["version"] == "2.1.0"
    clean = document(reports.sarif_rules(f.limit(0)))["runs"][0]
    assert clean["results"] == [] and [r["id"] for r in clean["tool"]["driver"]["rules"]] == ["findgrid/clean"]
