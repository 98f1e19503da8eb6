"""Configuration files of runs: read, checked, and turned into what the other operators take.

Rows (path, text) hold a file each. JSON is parsed by Spark; YAML is first rewritten as JSON where PyYAML is installed.
"""

from __future__ import annotations

import json
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from findgrid.operators import exchange

_RULE = "array<struct<type: string, value: string>>"
SCHEMA = (
    "description string, vuln_classes array<string>, exploit boolean, rules_of_engagement string, "
    "authentication struct<login_type: string, login_url: string, login_flow: array<string>, "
    "credentials: struct<username: string, password: string, totp_secret: string, totp_field: string>, "
    "email: struct<imap_host: string, imap_port: int, username: string, password: string, mailbox: string, subject_contains: string, from_contains: string, code_regex: string>, "
    "success_condition: struct<type: string, value: string>>, "
    f"rules struct<avoid: {_RULE}, focus: {_RULE}>, "
    "report struct<min_severity: string, min_confidence: string, guidance: string, sarif: boolean>, "
    "rate_limit struct<max_per_minute: long, delay_ms: long>, _malformed string"
)
# fixed values: names a file may use. A lowest severity of "info" is refused, as the command line's filter refuses it.
SEVERITIES = ("CRITICAL", "HIGH", "MEDIUM", "LOW")
CONFIDENCES = ("HIGH", "MEDIUM", "LOW")
LOGINS = ("form", "basic", "email", "none")
SUCCESSES = ("url_contains", "body_contains", "status")
RULES = ("url_path", "subdomain", "domain", "method", "header", "parameter", "code_path")


def yaml_as_json(rows: DataFrame) -> DataFrame:
    """rows (path, text) with YAML texts as JSON; what is no YAML stays as it is and fails when it is parsed."""
    import yaml

    def as_json(text: str | None) -> str | None:
        try:
            return text if text is None else json.dumps(yaml.safe_load(text), default=str)
        except yaml.YAMLError:
            return text

    @F.pandas_udf("string")
    def convert(texts: pd.Series) -> pd.Series:
        return texts.map(as_json)

    return rows.withColumn("text", convert("text"))


def _among(value: Column, names: tuple[str, ...]) -> Column:
    """Not given, or one of names."""
    return value.isNull() | value.isin(*names)


def _messages(*cases: tuple[Column, Column]) -> Column:
    return F.array_compact(F.array(*(F.when(when, said) for when, said in cases)))


def errors(c: Column) -> Column:
    """What makes a parsed file unusable."""
    said = lambda name, value, names: F.concat(F.lit(f"{name} '"), value, F.lit("' is invalid; expected " + "|".join(names).lower()))
    sev, conf = c["report"]["min_severity"], c["report"]["min_confidence"]
    login, success = c["authentication"]["login_type"], c["authentication"]["success_condition"]
    rules = F.concat(*(F.coalesce(c["rules"][k], F.array().cast(_RULE)) for k in ("avoid", "focus")))
    wrong = lambda r: r["type"].isNull() | r["value"].isNull() | ~r["type"].isin(*RULES)
    return _messages(
        (c.isNull() | c["_malformed"].isNotNull(), F.lit("the file can't be parsed")),
        (~_among(F.upper(sev), SEVERITIES), said("report.min_severity", sev, SEVERITIES)),
        (~_among(F.upper(conf), CONFIDENCES), said("report.min_confidence", conf, CONFIDENCES)),
        (~_among(login, LOGINS), said("authentication.login_type", login, LOGINS)),
        (success.isNotNull() & (success["type"].isNull() | success["value"].isNull() | ~_among(success["type"], SUCCESSES)), F.lit("authentication.success_condition needs a known type and a value")),
        (F.exists(rules, wrong), F.lit("a rule needs a known type and a value")),
    )


def warnings(c: Column) -> Column:
    """What is passed over: unknown classes, a mail login without a mailbox."""
    unknown = F.filter(F.coalesce(c["vuln_classes"], F.array().cast("array<string>")), lambda v: exchange.bug_class(v).isNull())
    named = F.transform(unknown, lambda v: F.concat(F.lit("unknown vuln_class '"), F.coalesce(v, F.lit("")), F.lit("' is ignored")))
    host = F.coalesce(F.trim(c["authentication"]["email"]["imap_host"]), F.lit(""))
    return F.concat(named, _messages(((c["authentication"]["login_type"] == "email") & (host == ""), F.lit("login_type email needs authentication.email.imap_host"))))


def classes(c: Column) -> Column:
    """The allowed classes in the order named; empty allows all."""
    return F.array_compact(F.transform(F.coalesce(c["vuln_classes"], F.array().cast("array<string>")), exchange.bug_class))


def secret_values(c: Column) -> Column:
    """Credentials that texts must be scrubbed of (web.scrub_values)."""
    a = c["authentication"]
    fields = [a["credentials"][k] for k in ("username", "password", "totp_secret")] + [a["email"][k] for k in ("username", "password")]
    return F.array_compact(F.array(*(F.when(f != "", f) for f in fields)))


def checked(rows: DataFrame) -> DataFrame:
    """Rows (path, valid, errors, warnings, classes, live, secrets, config) of JSON files (path, text).

    Everything is optional; live is false only where the file says `exploit: false`. Null and empty texts are not valid.
    """
    c = F.col("config")
    parsed = rows.select("path", F.from_json("text", SCHEMA, {"columnNameOfCorruptRecord": "_malformed"}).alias("config"))
    parsed = parsed.withColumn("errors", errors(c))
    return parsed.select("path", (F.size("errors") == 0).alias("valid"), "errors", F.coalesce(warnings(c), F.array().cast("array<string>")).alias("warnings"), F.coalesce(classes(c), F.array().cast("array<string>")).alias("classes"), F.coalesce(c["exploit"], F.lit(True)).alias("live"), secret_values(c).alias("secrets"), "config")


def read(spark, *paths: str) -> DataFrame:
    """checked() of files; names that end in .json are JSON, others YAML."""
    rows = spark.read.text(list(paths), wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    is_json = [p.lower().endswith(".json") for p in paths]
    if all(is_json):
        return checked(rows)
    plain = F.lower("path").endswith(".json")
    parts = [rows.filter(plain)] * any(is_json) + [yaml_as_json(rows.filter(~plain))]
    return checked(reduce(DataFrame.unionByName, parts))
