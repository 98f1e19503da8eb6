"""URLs, HTML and secrets in text, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from findgrid.functions.scores import cascade, contains_any

# Key names, markers and lists that results depend on.
KEY_VALUE = r"""(?i)\b(authorization|proxy-authorization|x-api-key|api[_-]?key|cookie|x-csrf-token|x-auth-token|password|passwd|secret|token|access[_-]?token|refresh[_-]?token|session|signature|sig|username|totp|otp|2fa|mfa)\b["']?\s*[:=]\s*["']?(?:Bearer\s+)?[A-Za-z0-9._\-+/=]{4,}"""
BEARER = r"(?i)\bBearer\s+[A-Za-z0-9._\-]{8,}"
QUERY_KEYS = ("token", "access_token", "api_key", "apikey", "key", "secret", "password", "session", "auth", "signature", "sig", "code", "state", "credential")
HEADERS = ("authorization", "proxy-authorization", "x-api-key", "cookie", "x-csrf-token", "x-auth-token")
TECH = (
    ("next.js", "__next_data__"), ("react", "data-reactroot"), ("angular", "ng-version"), ("vue", "data-v-"), ("jquery", "jquery"), ("bootstrap", "bootstrap"), ("wordpress", "wp-content"),
    ("django", "csrfmiddlewaretoken"), ("rails", "rails-ujs"), ("laravel", "laravel_session"), ("asp.net", "__viewstate"), ("htmx", "htmx.org"), ("alpine.js", "x-data"), ("csrf-token meta", "csrf-token"),
)
CODE_DIGITS = (6, 5, 7, 4, 8)


def host_of(url: Column) -> Column:
    """Lower-cased host of an http or https URL, else null; the query of a URL without a path stays in it."""
    h = F.lower(F.regexp_extract(url, r"^https?://([^/:]*)", 1))
    return F.when(h != "", h)


def resolve_url(base: Column, url: Column) -> Column:
    """Absolute http(s) URLs as they are, others joined to the whole base with one slash; null for other schemes."""
    u = F.trim(url)
    joined = F.concat(F.regexp_replace(F.trim(base), "/+$", ""), F.lit("/"), F.regexp_replace(u, "^/+", ""))
    return cascade([(u.rlike("^https?://"), u), (u.contains("://"), F.lit(None).cast("string")), (joined.rlike("^https?://"), joined)], F.lit(None).cast("string"))


def origin(url: Column) -> Column:
    o = F.regexp_extract(url, r"^(https?://[^/]*)", 1)
    return F.when(o != "", o)


def same_origin(a: Column, b: Column) -> Column:
    return origin(a).eqNullSafe(origin(b))


def query_params(url: Column) -> Column:
    """Array of (name, value) of the pairs that have a name and an equals sign, in order, not decoded."""
    q = F.regexp_extract(F.regexp_replace(url, r"#.*$", ""), r"\?(.*)$", 1)
    pairs = F.filter(F.split(q, "&"), lambda p: p.rlike("^[^=]+="))
    return F.transform(pairs, lambda p: F.struct(F.regexp_extract(p, "^([^=]*)=", 1).alias("name"), F.regexp_extract(p, "^[^=]*=(.*)$", 1).alias("value")))


def percent_encode(text: Column) -> Column:
    """All bytes but A-Z a-z 0-9 - _ . ~ as %XX."""
    return F.replace(F.replace(F.replace(F.url_encode(text), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def strip_fragment(url: Column) -> Column:
    return F.regexp_replace(url, "#.*$", "")


def tech_markers(html: Column) -> Column:
    """Sorted names of the technologies whose marker the lower-cased page has, and its generator."""
    low = F.lower(html)
    gen = F.regexp_extract(low, r"""<meta\s+name=["']generator["']\s+content=["']([^"']+)["']""", 1)
    return F.array_sort(F.array_distinct(F.filter(F.array(*(F.when(low.contains(m), F.lit(n)) for n, m in TECH), F.when(gen != "", gen)), lambda x: x.isNotNull())))


def html_to_text(html: Column) -> Column:
    """Tags as blanks, seven entities decoded token by token, trimmed."""
    t = F.regexp_replace(html, "<[^>]+>", " ")
    decode = lambda x: cascade([(F.lower(x) == k, v) for k, v in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&nbsp;", " "))], x)
    return F.trim(F.array_join(F.transform(F.regexp_extract_all(t, F.lit("(&[^;]*;|[^&]+|&)"), F.lit(1)), decode), ""))


def html_links(html: Column) -> Column:
    """Distinct targets of the first 20 anchors, in order."""
    return F.array_distinct(F.slice(F.regexp_extract_all(html, F.lit(r"""(?i)<a\s+[^>]*?href\s*=\s*["']([^"']+)["']"""), F.lit(1)), 1, 20))


def html_attr(tag: Column, name: str) -> Column:
    """Value of an attribute of a tag's text, null if it has none."""
    quoted = rf"""(?is)\s{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    has = tag.rlike(quoted)
    return F.when(has, F.concat(*(F.coalesce(F.regexp_extract(tag, quoted, i), F.lit("")) for i in (1, 2, 3))))


def html_forms(html: Column) -> Column:
    """Array of forms (action, method, inputs), inputs being (name, input_type, value), in order. A form ends at its end tag, or
    with the page."""
    forms = F.regexp_extract_all(html, F.lit(r"(?is)(<form(?:\s[^>]*)?>.*?(?:</form\s*>|\z))"), F.lit(1))

    def one(form: Column) -> Column:
        tag = F.regexp_extract(form, r"(?is)^(<form[^>]*>)", 1)
        inputs = F.transform(F.regexp_extract_all(form, F.lit(r"(?is)(<input(?:\s[^>]*)?>)"), F.lit(1)), lambda x: F.struct(F.coalesce(html_attr(x, "name"), F.lit("")).alias("name"), F.coalesce(html_attr(x, "type"), F.lit("text")).alias("input_type"), F.coalesce(html_attr(x, "value"), F.lit("")).alias("value")))
        return F.struct(F.coalesce(html_attr(tag, "action"), F.lit("")).alias("action"), F.coalesce(html_attr(tag, "method"), F.lit("GET")).alias("method"), inputs.alias("inputs"))

    return F.transform(forms, one)


def html_scripts(html: Column, most: int = 10) -> Column:
    """Sources of the first scripts that have one."""
    tags = F.regexp_extract_all(html, F.lit(r"(?is)(<script\s[^>]*>)"), F.lit(1))
    return F.slice(F.filter(F.transform(tags, lambda x: F.trim(html_attr(x, "src"))), lambda x: x.isNotNull()), 1, most)


def pull_number(given: Column, ref: Column) -> Column:
    """The number given, else that of refs/pull/N/...; null without one that fits 32 bits."""
    n = F.try_to_number(F.regexp_extract(ref, r"^refs/pull/\+?([0-9]{1,10})(?:/|$)", 1), F.lit("9999999999")).cast("long")
    return F.coalesce(given.cast("long"), F.when(n < 1 << 32, n))


def html_title(html: Column) -> Column:
    t = F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))
    return F.when(t != "", t)


def extract_code(text: Column) -> Column:
    """A number of 6 digits, else 5, 7, 4 or 8, that stands alone."""
    found = [F.regexp_extract(text, rf"(?:^|[^0-9])([0-9]{{{n}}})(?:[^0-9]|$)", 1) for n in CODE_DIGITS]
    return F.coalesce(*(F.when(x != "", x) for x in found))


def extract_link(html: Column, hint: str | None = None) -> Column:
    """The first link, anchors before bare URLs, one that contains the hint if there is any."""
    a = F.transform(F.regexp_extract_all(html, F.lit(r"""(?i)<a\s+[^>]*?href\s*=\s*["']([^"']+)["']"""), F.lit(1)), lambda x: F.trim(x))
    b = F.transform(F.regexp_extract_all(html_to_text(html), F.lit(r"""(https?://[^\s<>"']+)"""), F.lit(1)), lambda x: F.regexp_replace(x, r"[)\]}.,;]+$", ""))
    links = F.array_distinct(F.filter(F.concat(a, b), lambda x: x != ""))
    first = F.get(links, F.lit(0))
    return F.coalesce(F.get(F.filter(links, lambda x: x.contains(hint)), F.lit(0)), first) if hint else first


def redact_text(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, KEY_VALUE, "$1: ***"), BEARER, "Bearer ***")


def scrub_values(text: Column, values: list[str]) -> Column:
    """Exact secrets of three bytes or more as ***."""
    for v in values:
        if len(v.strip().encode()) >= 3:
            text = F.replace(text, F.lit(v.strip()), F.lit("***"))
    return text


def redact_query(url: Column) -> Column:
    """Values of query keys that contain a secret word are masked; a fragment stays with the last pair."""
    pairs = F.transform(F.split(F.regexp_extract(url, r"(?s)^[^?]*\?(.*)$", 1), "&"), lambda p: F.when(contains_any(F.lower(F.regexp_extract(p, "^([^=]*)", 1)), QUERY_KEYS), F.concat(F.regexp_extract(p, "^([^=]*)", 1), F.lit("=***redacted***"))).otherwise(p))
    return F.when(url.contains("?"), F.concat(F.regexp_extract(url, r"^([^?]*)", 1), F.lit("?"), F.array_join(pairs, "&"))).otherwise(url)


def redact_header(name: Column, value: Column) -> Column:
    """Set-Cookie keeps its name and flags, secret headers nothing."""
    flags = F.filter(F.transform(F.slice(F.split(value, ";"), 2, F.greatest(F.size(F.split(value, ";")) - 1, F.lit(0))), lambda x: F.trim(x)), lambda x: x != "")
    cookie = F.concat(F.regexp_extract(value, "^([^;=]*)", 1), F.lit("=***"))
    n = F.lower(name)
    return F.when(n == "set-cookie", F.when(F.size(flags) == 0, cookie).otherwise(F.concat(cookie, F.lit("; "), F.array_join(flags, "; ")))).when(n.isin(*HEADERS), "*** (redacted)").otherwise(value)


def excerpt(text: Column, most: int) -> Column:
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.left(text, F.lit(most)), F.lit("… ("), (F.length(text) - most).cast("string"), F.lit(" more chars)")))


def slugify(text: Column) -> Column:
    """Lower-cased ASCII letters, other letters and digits kept, all else one hyphen."""
    up = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.regexp_replace(F.regexp_replace(F.translate(text, up, up.lower()), r"[^\p{IsAlphabetic}\p{N}]+", "-"), "^-+|-+$", "")


def sanitize_name(text: Column) -> Column:
    c = F.regexp_replace(text, r"[^\p{IsAlphabetic}\p{N}_-]", "_")
    return F.when(c.rlike(r"[\p{IsAlphabetic}\p{N}]"), c).otherwise("workspace")


def html_escape(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def parse_endpoint(text: Column) -> Column:
    """struct(method, url) of "GET url"; GET if no method is named."""
    m = F.regexp_extract(F.trim(text), r"^([A-Za-z]+)\s+\S", 1)
    return F.struct(F.when(m != "", F.upper(m)).otherwise("GET").alias("method"), F.when(m != "", F.trim(F.regexp_replace(F.trim(text), r"^[A-Za-z]+\s+", ""))).otherwise(F.trim(text)).alias("url"))


def json_object(text: Column) -> Column:
    """From the first { to the last }, or null."""
    x = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    return F.when(x != "", x)


def repo_of_remote(url: Column) -> Column:
    """owner/name of a git remote, over https or ssh."""
    r = F.regexp_extract(F.regexp_replace(F.trim(url), r"\.git/?$", ""), r"[:/]([^/:]+/[^/]+)$", 1)
    return F.when(r != "", r)


def strip_fences(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(text), r"^```[A-Za-z0-9_+-]*\n?", ""), r"\n?```$", ""))


def host_allowed(url: Column, hosts: list[str]) -> Column:
    h = host_of(url)
    on = F.lit(False)
    for x in hosts:
        on = on | (h == x.lower()) | h.endswith("." + x.lower())
    return F.coalesce(on, F.lit(False))
