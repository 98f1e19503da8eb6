"""The secret scan: public token formats with their checksums, entropy and an allow list, in one pass over lines.

A format is a regular expression whose first group is the secret, words of which one must be on the line, the least entropy of
the secret in bits a character, and the checksum that it carries, if any: a token whose checksum is wrong is no token. The table is
our own, made from what the issuers publish. All is native; only the allow list is joined.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from findgrid.functions import scores


@dataclass(frozen=True)
class Format:
    title: str
    severity: str
    pattern: str
    hints: tuple[str, ...]
    entropy: float = 0.0
    checksum: str | None = None
    confidence: str = "High"


FORMATS = (
    Format("AWS Access Key ID", "Critical", r"\b((?:AKIA|ASIA|AROA|AIDA)[A-Z0-9]{16})\b", ("AKIA", "ASIA", "AROA", "AIDA"), 2.5),
    Format("AWS Secret Access Key", "Critical", r"""(?i)aws[a-z_ .-]{0,20}secret[a-z_ .-]{0,20}["']?\s*[=:]\s*["']?([A-Za-z0-9/+]{40})(?:[^A-Za-z0-9/+]|$)""", ("aws", "AWS"), 3.5),
    Format("GitHub Token", "Critical", r"\b(gh[pousr]_[A-Za-z0-9]{36})\b", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), checksum="base62"),
    Format("GitHub Fine-Grained Token", "Critical", r"\b(github_pat_[A-Za-z0-9]{22}_[A-Za-z0-9]{59})\b", ("github_pat_",), 3.0),
    Format("GitLab Token", "Critical", r"\b(glpat-[A-Za-z0-9_-]{20})\b", ("glpat-",), 3.0),
    Format("npm Token", "Critical", r"\b(npm_[A-Za-z0-9]{36})\b", ("npm_",), checksum="base62"),
    Format("PyPI Token", "Critical", r"\b(pypi-AgEIcHlwaS5vcmc[A-Za-z0-9_-]{50,})", ("pypi-AgEIcHlwaS5vcmc",)),
    Format("Slack Token", "High", r"\b(xox[abprs]-[0-9A-Za-z-]{10,})", ("xox",), 2.5),
    Format("Slack Webhook", "High", r"(https://hooks\.slack\.com/services/T[A-Z0-9]{8,}/B[A-Z0-9]{8,}/[A-Za-z0-9]{24})", ("hooks.slack.com",)),
    Format("Discord Webhook", "High", r"(https://discord(?:app)?\.com/api/webhooks/[0-9]{17,20}/[A-Za-z0-9_-]{60,68})", ("/api/webhooks/",)),
    Format("Telegram Bot Token", "High", r"(?:^|[^0-9A-Za-z])([0-9]{8,10}:[A-Za-z0-9_-]{35})(?:[^A-Za-z0-9_-]|$)", (":",), 3.5, confidence="Medium"),
    Format("Stripe Secret Key", "Critical", r"\b([sr]k_live_[A-Za-z0-9]{24,99})\b", ("k_live_",), 3.0),
    Format("Stripe Webhook Secret", "High", r"\b(whsec_[A-Za-z0-9+/]{32,})", ("whsec_",), 3.0),
    Format("Square Token", "High", r"\b(sq0(?:atp|csp)-[A-Za-z0-9_-]{22,43})\b", ("sq0",), 3.0),
    Format("Shopify Token", "High", r"\b(shp(?:at|ca|pa|ss)_[A-Fa-f0-9]{32})\b", ("shp",), 2.5),
    Format("Google API Key", "High", r"\b(AIza[0-9A-Za-z_-]{35})(?:[^0-9A-Za-z_-]|$)", ("AIza",), 3.0),
    Format("Google OAuth Client Secret", "High", r"\b(GOCSPX-[A-Za-z0-9_-]{28})(?:[^0-9A-Za-z_-]|$)", ("GOCSPX-",), 3.0),
    Format("SendGrid Key", "High", r"\b(SG\.[A-Za-z0-9_-]{22}\.[A-Za-z0-9_-]{43})(?:[^0-9A-Za-z_-]|$)", ("SG.",), 3.0),
    Format("Mailgun Key", "High", r"\b(key-[0-9a-f]{32})\b", ("key-",), 2.5),
    Format("Mailchimp Key", "High", r"\b([0-9a-f]{32}-us[0-9]{1,2})\b", ("-us",), 2.5),
    Format("Twilio API Key", "High", r"\b(SK[0-9a-f]{32})\b", ("SK",), 2.5, confidence="Medium"),
    Format("DigitalOcean Token", "Critical", r"\b(do[opr]_v1_[a-f0-9]{64})\b", ("_v1_",), 2.5),
    Format("Databricks Token", "High", r"\b(dapi[0-9a-f]{32})\b", ("dapi",), 2.5),
    Format("Hugging Face Token", "High", r"\b(hf_[A-Za-z]{34})\b", ("hf_",), 3.0),
    Format("Linear API Key", "High", r"\b(lin_api_[A-Za-z0-9]{40})\b", ("lin_api_",), 3.0),
    Format("Grafana Service Token", "High", r"\b(glsa_[A-Za-z0-9]{32}_[A-Fa-f0-9]{8})\b", ("glsa_",), 3.0),
    Format("age Secret Key", "Critical", r"\b(AGE-SECRET-KEY-1[02-9AC-HJ-NP-Z]{58})\b", ("AGE-SECRET-KEY-1",)),
    Format("Heroku API Key", "High", r"""(?i)heroku[a-z_ .-]{0,20}["']?\s*[=:]\s*["']?([0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})\b""", ("heroku", "HEROKU", "Heroku"), confidence="Medium"),
    Format("Private Key Block", "Critical", r"(-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----)", ("PRIVATE KEY-----",)),
    Format("JSON Web Token", "Medium", r"\b(eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{4,})", ("eyJ",), 3.0, confidence="Medium"),
    Format("Password in URL", "High", r"""\b[a-z][a-z0-9+.-]{1,20}://[^\s:/@"']{1,64}:([^\s:/@"']{4,128})@[A-Za-z0-9.-]+""", ("://",), 1.5, confidence="Medium"),
    Format("Password in Code", "High", r"""(?i)\b(?:password|passwd|pwd)\s*[=:]\s*["']([^"'\s]{6,})["']""", ("pass", "PASS", "Pass", "pwd", "PWD"), 2.0, confidence="Medium"),
    Format("Generic Token Assignment", "High", r"""(?i)\b(?:token|secret|api_?key)\s*[=:]\s*["']([A-Za-z0-9_\-]{16,})["']""", ("token", "TOKEN", "Token", "ecret", "SECRET", "ey", "EY"), 2.5, confidence="Medium"),
    Format("Payment Card Number", "High", r"(?:^|[^0-9A-Za-z.])([3-6][0-9]{12,18})(?:[^0-9A-Za-z.]|$)", ("3", "4", "5", "6"), 1.5, "luhn", "Medium"),
)
_BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def entropy(text: Column) -> Column:
    """Bits a character of a text by the frequencies of its own characters; 0 for an empty one."""
    n = F.length(text)
    share = lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / n
    return F.when(n == 0, 0.0).otherwise(F.aggregate(F.array_distinct(F.split(text, "")), F.lit(0.0), lambda s, c: s - F.when(c == "", 0.0).otherwise(share(c) * F.log2(share(c)))))


def luhn(digits: Column) -> Column:
    """Whether a number of digits has the right check digit."""
    n = F.length(digits)
    at = lambda i: F.substr(digits, n - i, F.lit(1)).cast("int") * (1 + i % 2)
    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda s, i: s + at(i) - F.when(at(i) > 9, 9).otherwise(0)) % 10 == 0


def base62_checksum(token: Column) -> Column:
    """Whether the last six characters are the CRC-32 of the 30 before, in base 62, as in prefixed tokens of 40 characters."""
    crc = F.crc32(F.substring(token, 5, 30).cast("binary"))
    place = F.transform(F.sequence(F.lit(5), F.lit(0)), lambda i: F.substr(F.lit(_BASE62), (F.floor(crc / F.pow(F.lit(62.0), i)) % 62 + 1).cast("int"), F.lit(1)))
    return F.substring(token, 35, 6) == F.array_join(place, "")


_CHECKS = {"luhn": luhn, "base62": base62_checksum}


def match_secrets(lines: DataFrame, allowed: DataFrame | None = None, formats: tuple[Format, ...] = FORMATS) -> DataFrame:
    """Rows (file_path, line_number, title, severity, confidence, shown, bits, fingerprint) of lines (path, line_no, line): a row for
    each secret of a line and format. shown is its first four characters; the fingerprint is the digest of title and secret, and secrets
    whose fingerprint is in `allowed` (fingerprint) are left out. Null and empty lines have none."""
    line = F.col("line")

    def found(k: int, f: Format) -> Column:
        hint = reduce(lambda a, b: a | b, [line.contains(h) for h in f.hints])
        secrets = F.transform(F.regexp_extract_all(line, F.lit(f.pattern), F.lit(1)), lambda s: F.struct(F.lit(k).alias("format"), s.alias("secret")))
        return F.when(hint, secrets).otherwise(F.array().cast("array<struct<format: int, secret: string>>"))

    hits = lines.select(F.col("path").alias("file_path"), F.col("line_no").alias("line_number"), F.explode(F.flatten(F.array(*(found(k, f) for k, f in enumerate(formats))))).alias("h")).select("file_path", "line_number", "h.*")
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("format") + 1)
    hits = hits.withColumn("bits", entropy(F.col("secret"))).filter(F.col("bits") >= pick([f.entropy for f in formats]))
    right = scores.cascade([(F.col("format").isin(*ks), check(F.col("secret"))) for name, check in _CHECKS.items() if (ks := [k for k, f in enumerate(formats) if f.checksum == name])], F.lit(True))
    hits = hits.filter(right).withColumn("title", pick([f.title for f in formats])).withColumn("severity", pick([f.severity for f in formats])).withColumn("confidence", pick([f.confidence for f in formats]))
    hits = hits.withColumn("fingerprint", F.sha2(F.concat_ws(":", "title", "secret"), 256))
    if allowed is not None:
        hits = hits.join(allowed.select("fingerprint").distinct(), "fingerprint", "left_anti")
    return hits.select("file_path", "line_number", "title", "severity", "confidence", F.concat(F.substring("secret", 1, 4), F.lit("***")).alias("shown"), "bits", "fingerprint")
