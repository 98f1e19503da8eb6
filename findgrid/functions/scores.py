"""Ratings of findings as column expressions: ranks, risk, weakness ids, business impact, security score."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ladder(value: Column, steps: list[tuple], default) -> Column:
    """CASE value WHEN ... in the order of steps."""
    out = None
    for k, v in steps:
        out = F.when(value == k, v) if out is None else out.when(value == k, v)
    return out.otherwise(default)


def cascade(steps: list[tuple[Column, object]], default) -> Column:
    """CASE WHEN ... in the order of steps: the first condition that holds decides."""
    out = None
    for on, v in steps:
        out = F.when(on, v) if out is None else out.when(on, v)
    return out.otherwise(default)


def strip(text: Column) -> Column:
    """Without white space at both ends."""
    return F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))


def contains_any(text: Column, words) -> Column:
    on = F.lit(False)
    for w in words:
        on = on | text.contains(w)
    return on


def severity_score(s: Column) -> Column:
    return ladder(s, [("Critical", 5), ("High", 4), ("Medium", 3), ("Low", 2), ("Info", 1)], None)


def severity_order_inverted(s: Column) -> Column:
    """Declaration order, in which Critical is least: kept for the one tool that filters by it (compat only)."""
    return 5 - severity_score(s)


def confidence_score(c: Column) -> Column:
    return ladder(c, [("High", 3), ("Medium", 2), ("Low", 1)], None)


def effort_score(e: Column) -> Column:
    return ladder(e, [("Minutes", 1), ("Hours", 2), ("Days", 3)], None)


def parse_severity(text: Column, default: str | None = None) -> Column:
    u = F.upper(F.trim(text))
    return cascade([(u == "CRITICAL", "Critical"), (u == "HIGH", "High"), (u == "MEDIUM", "Medium"), (u == "LOW", "Low"), (u == "INFO", "Info")], default)


def parse_confidence(text: Column, default: str | None = None) -> Column:
    u = F.upper(F.trim(text))
    return cascade([(u == "HIGH", "High"), (u == "MEDIUM", "Medium"), (u == "LOW", "Low")], default)


def exploitability(s: Column) -> Column:
    return ladder(s, [("Critical", 0.8), ("High", 0.6), ("Medium", 0.4), ("Low", 0.2)], 0.1)


def effort_for(s: Column) -> Column:
    return ladder(s, [("Critical", "Hours"), ("High", "Hours")], "Minutes")


def risk(severity: Column, confidence: Column, expl: Column, impact: Column) -> Column:
    """0 to 10: severity, exploitability and impact count twice, confidence half."""
    raw = (severity_score(severity) * 2.0 + confidence_score(confidence) * 0.5 + expl * 2.0 + impact * 2.0) / 15.0 * 10.0
    return F.least(F.greatest(raw, F.lit(0.0)), F.lit(10.0))


# The ordered title words and weakness ids; the first row that holds decides.
CWE_BY_TITLE = (
    (("sql injection",), "CWE-89"), (("command injection",), "CWE-78"), (("path traversal",), "CWE-22"), (("template injection",), "CWE-1336"),
    (("xss",), "CWE-79"), (("ssrf",), "CWE-918"), (("md5", "sha1", "weak hash"), "CWE-328"),
    (("weak encryption", "ecb", "des_ede3", "3des", "tripledes"), "CWE-327"),
    (("hardcoded cryptographic key", "encryption_key", "aes_key", "secret_key"), "CWE-321"),
    (("hardcoded", ("credential", "password")), "CWE-798"), (("jwt", "token_secret", "signing_key"), "CWE-345"),
    (("cookie", ("insecure", "httponly", "samesite")), "CWE-614"), (("debug",), "CWE-489"), (("cors",), "CWE-942"),
    (("idor", "object reference"), "CWE-639"), (("deserialization",), "CWE-502"), (("mass assignment", "autobinding"), "CWE-915"),
    (("logging", ("sensitive",)), "CWE-532"), (("ssl", "tls", "verification"), "CWE-295"), (("dependency", "cve", "vulnerable package"), "CWE-1104"),
    (("secret", "api key", "apikey", "token", "credential"), "CWE-798"), (("auth", "login", "session"), "CWE-287"),
    (("access control", "authorization", "permission"), "CWE-862"), (("boundary", "bounds"), "CWE-125"), (("race", "toctou"), "CWE-362"), (("injection",), "CWE-74"),
)
CWE_BY_TYPE = (
    ("Secret", "CWE-798"), ("Injection", "CWE-74"), ("Authentication", "CWE-287"), ("Authorization", "CWE-862"), ("Cryptography", "CWE-327"),
    ("Dependency", "CWE-1104"), ("Misconfiguration", "CWE-16"), ("BusinessLogic", "CWE-840"), ("Vulnerability", "CWE-693"),
)
CREDENTIAL_WORDS = (
    "password", "credential", "secret", "api key", "apikey", "token", "private key", "jwt", "aws", "github", "gitlab", "stripe", "slack",
    "discord", "heroku", "connection string", "service account",
)
IMPACT_BY_TYPE = (
    ("Secret", 0.9), ("Authorization", 0.85), ("Authentication", 0.8), ("BusinessLogic", 0.8), ("Injection", 0.75), ("Cryptography", 0.7),
    ("Dependency", 0.6), ("Misconfiguration", 0.55), ("Vulnerability", 0.65),
)
IMPACT_UP_15 = ("payment", "billing", "checkout", "order", "wallet", "stripe", "charge")
IMPACT_UP_10 = ("login", "auth", "session", "password", "token", "admin")
IMPACT_DOWN_20 = ("test", "tests", "spec", "example", "sample", "fixture")
SEVERITY_WEIGHT = (("Critical", 25.0), ("High", 10.0), ("Medium", 4.0), ("Low", 1.0))


def cwe_for_title(title: Column, finding_type: Column) -> Column:
    t = F.lower(title)

    def holds(words) -> Column:
        if len(words) > 1 and isinstance(words[-1], tuple):
            return t.contains(words[0]) & contains_any(t, words[-1])
        return contains_any(t, words)

    return cascade([(holds(w), c) for w, c in CWE_BY_TITLE], ladder(finding_type, list(CWE_BY_TYPE), None))


def is_credential_like(title: Column) -> Column:
    return contains_any(F.lower(title), CREDENTIAL_WORDS)


def business_impact(finding_type: Column, path: Column) -> Column:
    low = F.coalesce(F.lower(path), F.lit(""))
    x = ladder(finding_type, list(IMPACT_BY_TYPE), None)
    x = F.when(contains_any(low, IMPACT_UP_15), F.least(x + 0.15, F.lit(1.0))).otherwise(x)
    x = F.when(contains_any(low, IMPACT_UP_10), F.least(x + 0.1, F.lit(1.0))).otherwise(x)
    x = F.when(contains_any(low, IMPACT_DOWN_20), F.greatest(x - 0.2, F.lit(0.1))).otherwise(x)
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def security_score(severity: Column, expl: Column, impact: Column) -> Column:
    """Aggregate: 100 less the weighted findings, 0 to 100."""
    lost = F.sum(ladder(severity, list(SEVERITY_WEIGHT), 0.0) * (expl + 0.5) * (impact + 0.5))
    return F.least(F.greatest(100.0 - F.coalesce(lost, F.lit(0.0)), F.lit(0.0)), F.lit(100.0))


def report_class(cwe: Column, finding_type: Column, compat: bool = True) -> Column:
    """Class of a finding in the per-class report. compat looks for the id as a substring, in this order, so CWE-798 counts as
    CWE-79; strict compares whole ids."""
    c = F.coalesce(cwe, F.lit(""))
    has = (lambda x: c.contains(x)) if compat else (lambda x: c == x)
    by_type = [("Authentication", "auth"), ("Authorization", "authz"), ("Injection", "injection"), ("Misconfiguration", "misconfig"), ("Secret", "secrets")]
    return cascade(
        [(has("CWE-79"), "xss"), (has("CWE-89"), "injection"), (has("CWE-78"), "cmdi"), (has("CWE-918"), "ssrf"), (has("CWE-22"), "path-traversal"), (has("CWE-639") | has("CWE-862"), "idor")],
        ladder(finding_type, by_type, "general"),
    )


def sarif_level(severity: Column) -> Column:
    return ladder(severity, [("Critical", "error"), ("High", "error"), ("Medium", "warning")], "note")


def normalise_cwe(text: Column) -> Column:
    """ "89", "cwe-89: x", "CWE-89" become CWE-89; null if there is no number where one belongs."""
    n = F.regexp_extract(F.upper(F.trim(text)), r"^(?:CWE-)?([0-9]+)", 1)
    return F.when(n != "", F.concat(F.lit("CWE-"), n))
