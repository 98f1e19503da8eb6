"""Queries of URL, HTML and redaction functions, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from findgrid.operators import exchange as ex
from findgrid.functions import web
from findgrid.plans.queries_findings import _any, _q

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_HREF = r"""(?i)<a\s+[^>]*?href\s*=\s*["'']([^"'']+)["'']"""
_SHAPES = ("https://Api.Example.com:8443/users/%d?id=7&token=abc#top", "/orders/%d?sort=asc&sort=desc&flag", "http://shop.test/p/%d", "ftp://files.test/%d", "items?x=%d&=1&auth_code=9", "https://h.test?q=%d")


def urls(spark, sf_dir):
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(k.alias("k"), F.replace(F.element_at(F.array(*map(F.lit, _SHAPES)), (k % 6 + 1).cast("int")), F.lit("%d"), k.cast("string")).alias("url"))


_URLS = f"WITH u AS (SELECT o_orderkey AS k, replace([{', '.join(map(_q, _SHAPES))}][o_orderkey % 6 + 1], '%d', o_orderkey::VARCHAR) AS url FROM orders)"
_BASE = "http://base.test/app/"


@query(f"""{_URLS} SELECT k, nullif(lower(regexp_extract(url, '^https?://([^/:]*)', 1)), '') AS host,
CASE WHEN regexp_matches(url, '^https?://') THEN url WHEN contains(url, '://') THEN NULL ELSE 'http://base.test/app/' || regexp_replace(url, '^/+', '') END AS resolved,
regexp_replace(url, '#.*$', '') AS no_fragment, nullif(regexp_extract(url, '^(https?://[^/]*)', 1), '') IS NOT DISTINCT FROM 'http://shop.test' AS same,
CASE WHEN contains(url, '?') THEN regexp_extract(url, '^([^?]*)', 1) || '?' || array_to_string(list_transform(string_split(regexp_extract(url, '^[^?]*\\?(.*)$', 1), '&'), lambda p: CASE WHEN {_any("lower(regexp_extract(p, '^([^=]*)', 1))", web.QUERY_KEYS)} THEN regexp_extract(p, '^([^=]*)', 1) || '=***redacted***' ELSE p END), '&') ELSE url END AS redacted FROM u""")
def url_functions(spark, sf_dir):
    u = F.col("url")
    return urls(spark, sf_dir).select("k", web.host_of(u).alias("host"), web.resolve_url(F.lit(_BASE), u).alias("resolved"), web.strip_fragment(u).alias("no_fragment"), web.same_origin(u, F.lit("http://shop.test/z")).alias("same"), web.redact_query(u).alias("redacted"))


@query(f"""{_URLS} SELECT k, pos::BIGINT AS pos, regexp_extract(p, '^([^=]*)=', 1) AS name, regexp_extract(p, '^[^=]*=(.*)$', 1) AS value FROM (SELECT k, unnest(l) AS p, generate_subscripts(l, 1) - 1 AS pos FROM
(SELECT k, list_filter(string_split(regexp_extract(regexp_replace(url, '#.*$', ''), '\\?(.*)$', 1), '&'), lambda p: regexp_matches(p, '^[^=]+=')) AS l FROM u))""")
def query_parameters(spark, sf_dir):
    return urls(spark, sf_dir).select("k", F.posexplode(web.query_params(F.col("url"))).alias("pos", "p")).select("k", F.col("pos").cast("long").alias("pos"), "p.name", "p.value")


_TECH = "[" + ", ".join(f"CASE WHEN contains(low, {_q(m)}) THEN {_q(n)} END" for n, m in web.TECH) + "]"


@query(f"""WITH p AS (SELECT page_id, html, lower(html) AS low FROM pages) SELECT page_id, nullif(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), '') AS title,
array_to_string(list_sort(list_distinct(list_filter({_TECH}, lambda x: x IS NOT NULL))), ',') AS tech FROM p""")
def page_facts(spark, sf_dir):
    h = F.col("html")
    return table(spark, sf_dir, "pages").select("page_id", web.html_title(h).alias("title"), F.array_join(web.tech_markers(h), ",").alias("tech"))


@query(f"""SELECT page_id, pos::BIGINT AS pos, link FROM (SELECT page_id, unnest(l) AS link, generate_subscripts(l, 1) - 1 AS pos FROM (SELECT page_id, list_transform(list_filter(list_zip(a, range(len(a))), lambda x: list_position(a, x[1]) = x[2] + 1), lambda x: x[1]) AS l
FROM (SELECT page_id, regexp_extract_all(html, '{_HREF}', 1)[1:20] AS a FROM pages)))""")
def page_links(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.posexplode(web.html_links(F.col("html"))).alias("pos", "link")).select("page_id", F.col("pos").cast("long").alias("pos"), "link")


def _decode(x: str) -> str:
    return f"CASE lower({x}) WHEN '&amp;' THEN '&' WHEN '&lt;' THEN '<' WHEN '&gt;' THEN '>' WHEN '&quot;' THEN '\"' WHEN '&apos;' THEN '''' WHEN '&#39;' THEN '''' WHEN '&nbsp;' THEN ' ' ELSE {x} END"


@query(f"SELECT page_id, trim(array_to_string(list_transform(regexp_extract_all(regexp_replace(html, '<[^>]+>', ' ', 'g'), '(&[^;]*;|[^&]+|&)', 1), lambda x: {_decode('x')}), '')) AS text FROM pages")
def page_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", web.html_to_text(F.col("html")).alias("text"))


_RED = f"regexp_replace(regexp_replace(text, {_q(web.KEY_VALUE)}, '\\1: ***', 'g'), {_q(web.BEARER)}, 'Bearer ***', 'g')"


@query(f"SELECT doc_id, {_RED} AS text FROM documents")
def redact_documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", web.redact_text(F.col("text")).alias("text"))


@query("SELECT doc_id, replace(replace(text, 'Licensed', '***'), 'idiot', '***') AS text FROM documents WHERE contains(text, 'Licensed') OR contains(text, 'idiot')")
def scrub_documents(spark, sf_dir):
    d = table(spark, sf_dir, "documents").filter("contains(text, 'Licensed') OR contains(text, 'idiot')")
    return d.select("doc_id", web.scrub_values(F.col("text"), ["Licensed", "of", " idiot "]).alias("text"))


_CODES = ", ".join(f"nullif(regexp_extract(text, '(?:^|[^0-9])([0-9]{{{n}}})(?:[^0-9]|$)', 1), '')" for n in web.CODE_DIGITS)


@query(rf"""SELECT doc_id, coalesce({_CODES}) AS code, CASE WHEN length(text) <= 80 THEN text ELSE left(text, 80) || '… (' || (length(text) - 80) || ' more chars)' END AS excerpt,
regexp_replace(regexp_replace(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\p{{L}}\p{{N}}]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug,
replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS escaped FROM documents""")
def text_functions(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", web.extract_code(t).alias("code"), web.excerpt(t, 80).alias("excerpt"), web.slugify(t).alias("slug"), web.html_escape(t).alias("escaped"))


_HEAD = ("Set-Cookie", "Authorization", "Accept", "X-Api-Key")
_VAL = ("sid=abc%d; Path=/; HttpOnly", "Bearer %d", "text/%d", "key%d; x")


@query(f"""WITH h AS (SELECT o_orderkey AS k, [{', '.join(map(_q, _HEAD))}][o_orderkey % 4 + 1] AS n, replace([{', '.join(map(_q, _VAL))}][o_orderkey % 4 + 1], '%d', o_orderkey::VARCHAR) AS v FROM orders)
SELECT k, CASE WHEN lower(n) = 'set-cookie' THEN regexp_extract(v, '^([^;=]*)', 1) || '=***; Path=/; HttpOnly' WHEN lower(n) IN ('authorization', 'x-api-key') THEN '*** (redacted)' ELSE v END AS value FROM h""")
def redact_headers(spark, sf_dir):
    k = F.col("o_orderkey")
    pick = lambda v: F.element_at(F.array(*map(F.lit, v)), (k % 4 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select(k.alias("k"), web.redact_header(pick(_HEAD), F.replace(pick(_VAL), F.lit("%d"), k.cast("string"))).alias("value"))


@query("""SELECT event_id, (props::JSON ->> '$.k')::BIGINT AS k, nullif(regexp_extract('note ' || props || ' end', '(?s)(\\{.*\\})', 1), '') AS object FROM events""")
def json_extraction(spark, sf_dir):
    note = F.concat(F.lit("note "), F.col("props"), F.lit(" end"))
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object(web.json_object(note), "$.k").cast("long").alias("k"), web.json_object(note).alias("object"))


@query("""SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS history, count(*)::BIGINT AS turns FROM conversations GROUP BY conv_id""")
def conversation_history(spark, sf_dir):
    return ex.history(table(spark, sf_dir, "conversations"))


@query()
def magic_links(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", web.extract_link(F.col("html")).alias("link"))
