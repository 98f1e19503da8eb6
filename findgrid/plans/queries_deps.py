"""Queries over dependencies, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from findgrid.operators import dependencies as dep
from findgrid.plans.fixtures import CODE_SQL, code_lines
from findgrid.plans.queries_findings import _any, _case, _q

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


_PKGS = (
    ("npm", "lodash"), ("npm", "Express"), ("PyPI", "requests"), ("PyPI", "Django"), ("PyPI", "django"), ("crates.io", "serde"), ("Go", "golang.org/x/net"), ("npm", "left-pad"),
    ("RubyGems", "rails"), ("Packagist", "monolog/monolog"), ("Pub", "http"), ("PyPI", "flask"), ("npm", "axios"),
)


def deps(spark, sf_dir):
    k = F.col("p_partkey")
    p = F.element_at(F.array(*(F.struct(F.lit(e).alias("e"), F.lit(n).alias("n")) for e, n in _PKGS)), (k % len(_PKGS) + 1).cast("int"))
    v = F.concat((F.col("p_size") % 5).cast("string"), F.lit("."), (k % 40).cast("string"), F.when(k % 4 == 0, "").otherwise(F.concat(F.lit("."), (k % 23).cast("string"))), F.when(k % 11 == 0, "-beta").otherwise(""))
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(k.alias("dep_id"), p["e"].alias("ecosystem"), p["n"].alias("name"), F.concat(F.when(k % 7 == 0, "v").otherwise(""), v).alias("version"), F.concat(F.lit("m"), (k % 50).cast("string")).alias("manifest_file"), (k % 3 == 0).alias("is_dev"))


_LIST = lambda i: "[" + ", ".join(_q(p[i]) for p in _PKGS) + f"][p_partkey % {len(_PKGS)} + 1]"
DEPS = f"""WITH deps AS (SELECT p_partkey AS dep_id, {_LIST(0)} AS ecosystem, {_LIST(1)} AS name, CASE WHEN p_partkey % 7 = 0 THEN 'v' ELSE '' END || (p_size % 5) || '.' || (p_partkey % 40) || CASE WHEN p_partkey % 4 = 0 THEN '' ELSE '.' || (p_partkey % 23) END || CASE WHEN p_partkey % 11 = 0 THEN '-beta' ELSE '' END AS version,
'm' || (p_partkey % 50) AS manifest_file, p_partkey % 3 = 0 AS is_dev FROM part)"""
_ADV = "adv(e, n, c, d, s) AS (VALUES " + ", ".join("(" + ", ".join(map(_q, a)) + ")" for a in dep.ADVISORIES) + ")"
_NUM = lambda x: f"list_transform(list_filter(string_split({x}, '.'), lambda p: regexp_matches(p, '^\\+?[0-9]{{1,10}}$') AND try_cast(p AS BIGINT) < 4294967296), lambda p: p::BIGINT)"


def _match(v: str, c: str) -> str:
    k = f"regexp_replace({c}, '^<=?', '')"
    a = lambda x, i: f"coalesce({_NUM(x)}[{i}], 0)"
    x = f"CASE WHEN len({_NUM(k)}) = 2 THEN row({a(v, 1)}, {a(v, 2)}, 0::BIGINT) ELSE row({a(v, 1)}, {a(v, 2)}, {a(v, 3)}) END"
    y = f"row({a(k, 1)}, {a(k, 2)}, {a(k, 3)})"
    return f"(starts_with({c}, '<') AND len({_NUM(v)}) > 0 AND len({_NUM(k)}) > 0 AND CASE WHEN starts_with({c}, '<=') THEN {x} <= {y} ELSE {x} < {y} END)"


@query(f"{DEPS}, {_ADV} SELECT dep_id, name, version, ecosystem, manifest_file, c AS constraint, d AS description, s AS severity, trim(split_part(d, ':', 1)) AS cve_id, 0::BIGINT AS line_number FROM deps JOIN adv ON ecosystem = e AND lower(name) = n AND {_match('version', 'c')}")
def advisory_join(spark, sf_dir):
    return dep.vulnerable(deps(spark, sf_dir).drop("is_dev"), dep.advisories(spark))


@query(f"{DEPS}, c(c) AS (VALUES ('<1.20.3'), ('<=2.10'), ('<3'), ('<=0.0.0'), ('>1.0'), ('<x')) SELECT dep_id, c AS constraint, {_match('version', 'c')} AS matches FROM deps, c")
def version_constraints(spark, sf_dir):
    c = F.explode(F.array(*map(F.lit, ("<1.20.3", "<=2.10", "<3", "<=0.0.0", ">1.0", "<x")))).alias("constraint")
    return deps(spark, sf_dir).select("dep_id", "version", c).select("dep_id", "constraint", dep.version_matches(F.col("version"), F.col("constraint")).alias("matches"))


_FIRST = "SELECT {k}, min(row(manifest_file, version)) AS m FROM deps GROUP BY {k}"


@query(f"{DEPS}, f AS ({_FIRST.format(k='name')}) SELECT name FROM (SELECT name, lag(name) OVER (ORDER BY name) AS p FROM f) WHERE p IS NULL OR lower(p) <> lower(name)")
def dependency_dedup(spark, sf_dir):
    return dep.dedup_adjacent(deps(spark, sf_dir)).select("name")


_KIND = _case("lower(ecosystem)", dep.PURL_TYPES, "ecosystem")


@query(f"""{DEPS}, f AS (SELECT ecosystem, name, manifest_file, version FROM (SELECT *, row_number() OVER (PARTITION BY ecosystem, name ORDER BY manifest_file, version) AS rn FROM deps) WHERE rn = 1),
k AS (SELECT * FROM (SELECT *, lag(name) OVER (PARTITION BY ecosystem ORDER BY name) AS p FROM f) WHERE p IS NULL OR lower(p) <> lower(name))
SELECT ecosystem, name, version, 'pkg:' || {_KIND} || '/' || lower(name) || '@' || version AS purl, 'SPDXRef-Package-' || row_number() OVER (ORDER BY ecosystem, name) AS spdx_id FROM k""")
def sbom_components(spark, sf_dir):
    return dep.components(deps(spark, sf_dir)).select("ecosystem", "name", "version", "purl", "spdx_id")


@query()
def sbom_cyclonedx(spark, sf_dir):
    return dep.cyclonedx(deps(spark, sf_dir))


@query()
def sbom_spdx(spark, sf_dir):
    return dep.spdx(deps(spark, sf_dir))


_ID = r"[\p{L}\p{N}_./]+"
_LOW = "lower(line)"
_AFTER = "[" + ", ".join(f"CASE WHEN contains({_LOW}, '{k}') THEN regexp_extract(substr(line, instr({_LOW}, '{k}') + {len(k)}), '^({_ID})', 1) END" for k in ("use ", "import ", "from ")) + "]"
_IMPORTS = rf"""imp AS (SELECT path, line_no, list_transform(list_filter(list_transform(regexp_extract_all(line, '(''[^'']*''|"[^"]*")'), lambda q: trim(q[2:len(q) - 1])), lambda q: regexp_matches(q, '^[\p{{L}}\p{{N}}_\-.@/]+$')), lambda q: lower(q)) AS quoted,
list_filter({_AFTER}, lambda x: x IS NOT NULL AND x <> '') AS names FROM code WHERE {_any(_LOW, ("import ", "require(", "use ", "from ", "include "))}),
tok AS (SELECT DISTINCT path, unnest(list_concat(quoted, list_transform(names, lambda x: lower(x)), list_filter(list_transform(names, lambda x: lower(regexp_extract(x, '^([^/.]*)', 1))), lambda x: x <> ''))) AS token FROM imp)"""


@query(f"{CODE_SQL}, {_IMPORTS} SELECT token, count(*)::BIGINT AS n_files, min(path) AS first_file FROM tok GROUP BY token")
def usage_index(spark, sf_dir):
    return dep.usage_counts(code_lines(spark, sf_dir)).select("token", "n_files", F.col("files")[0].alias("first_file"))


@query(f"""{CODE_SQL}, {_IMPORTS}, p(name, exploitability) AS (VALUES ('lodash', 0.6::DOUBLE), ('requests', 0.8), ('serde', 0.9), ('golang.org/x/net', 0.4), ('Flask', 0.1)),
u AS (SELECT name, path FROM (SELECT DISTINCT name, path FROM p JOIN tok ON token = lower(name) OR token = regexp_extract(lower(name), '([^/]*)$', 1))),
g AS (SELECT name, count(*) AS n, list(path ORDER BY path)[1:4] AS shown FROM u GROUP BY name)
SELECT p.name, coalesce(n, 0)::BIGINT AS n_files, round(CASE WHEN n IS NULL THEN exploitability * 0.5 ELSE least(exploitability + 0.25, 1) END, 6) AS exploitability,
CASE WHEN n IS NULL THEN 'declared in manifest but not directly imported in source (low reachability)' ELSE 'used in ' || n || ' file(s): ' || array_to_string(shown, ', ') || CASE WHEN n > 4 THEN ' (+' || (n - 4) || ' more)' ELSE '' END END AS usage FROM p LEFT JOIN g USING (name)""")
def usage_annotation(spark, sf_dir):
    p = spark.createDataFrame([("lodash", 0.6), ("requests", 0.8), ("serde", 0.9), ("golang.org/x/net", 0.4), ("Flask", 0.1)], "name string, exploitability double")
    return dep.annotate_usage(p, code_lines(spark, sf_dir)).select("name", "n_files", F.round("exploitability", 6).alias("exploitability"), "usage")


def manifests(spark, sf_dir):
    """A manifest of each kind for each part, with versions made of its numbers."""
    k, s = F.col("p_partkey"), F.col("p_size")
    v = F.concat(s.cast("string"), F.lit("."), (k % 9).cast("string"), F.lit(".0"))
    text = F.element_at(
        F.array(
            F.concat(F.lit('{"dependencies": {"express": "^'), v, F.lit('", "lodash": "~1.0.0"}, "devDependencies": {"jest": "^'), v, F.lit('"}}')),
            F.concat(F.lit("# deps\nflask=="), v, F.lit("\n-r other.txt\ndjango==4.2.0,<5\nplain\n")),
            F.concat(F.lit("module x\n\nrequire (\n\tgithub.com/gin/gin v"), v, F.lit("\n\tgolang.org/x/net v0.14.0 // indirect\n)\nrequire example.com/y v1.0.0\n")),
            F.concat(F.lit("source 'https://x'\ngem 'rails', '~> "), v, F.lit("'\ngem 'puma'\n")),
            F.concat(F.lit('{"require": {"php": ">=8", "monolog/monolog": "^'), v, F.lit('"}, "require-dev": {"phpunit/phpunit": "~9.0"}}')),
            F.concat(F.lit('[package]\nname = "x"\n[dependencies]\nserde = "'), v, F.lit('"\ntokio = { version = "1.0", features = ["full"] }\n[dev-dependencies]\ntempfile = "3.0"\n')),
            F.concat(F.lit("name: x\ndependencies:\n  flutter:\n    sdk: flutter\n  http: ^"), v, F.lit("\ndev_dependencies:\n  mockito: ^5.0.0\n")),
        ),
        (k % 7 + 1).cast("int"),
    )
    name = F.element_at(F.array(*map(F.lit, ("package.json", "requirements.txt", "go.mod", "Gemfile", "composer.json", "Cargo.toml", "pubspec.yaml"))), (k % 7 + 1).cast("int"))
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(F.concat(F.lit("p"), k.cast("string"), F.lit("/"), name).alias("path"), text.alias("content"))


_V = "p_size || '.' || (p_partkey % 9) || '.0'"
_M = lambda k, name, rows: " UNION ALL ".join(f"SELECT {_q(n)} AS name, {v} AS version, {_q(e)} AS ecosystem, 'p' || p_partkey || '/{name}' AS manifest_file, {d} AS is_dev FROM part WHERE p_partkey % 7 = {k}" for n, v, e, d in rows)
_MAN = " UNION ALL ".join(
    _M(k, name, rows)
    for k, name, rows in (
        (0, "package.json", (("express", _V, "npm", "false"), ("lodash", "'1.0.0'", "npm", "false"), ("jest", _V, "npm", "true"))),
        (1, "requirements.txt", (("flask", _V, "PyPI", "false"), ("django", "'4.2.0'", "PyPI", "false"))),
        (2, "go.mod", (("github.com/gin/gin", "'v' || " + _V, "Go", "false"), ("golang.org/x/net", "'v0.14.0'", "Go", "false"), ("example.com/y", "'v1.0.0'", "Go", "false"))),
        (3, "Gemfile", (("rails", _V, "RubyGems", "false"), ("puma", "'*'", "RubyGems", "false"))),
        (4, "composer.json", (("monolog/monolog", _V, "Packagist", "false"), ("phpunit/phpunit", "'9.0'", "Packagist", "true"))),
        (5, "Cargo.toml", (("serde", _V, "crates.io", "false"), ("tokio", "'1.0'", "crates.io", "false"), ("tempfile", "'3.0'", "crates.io", "true"))),
        (6, "pubspec.yaml", (("http", _V, "Pub", "false"), ("mockito", "'5.0.0'", "Pub", "true"))),
    )
)


@query(_MAN)
def manifest_parsers(spark, sf_dir):
    return dep.parse_manifests(manifests(spark, sf_dir))


@query(f"{DEPS} SELECT ecosystem, count(DISTINCT lower(name))::BIGINT AS packages, count(*) FILTER (is_dev)::BIGINT AS dev FROM deps GROUP BY ecosystem")
def dependency_counts(spark, sf_dir):
    return deps(spark, sf_dir).groupBy("ecosystem").agg(F.count_distinct(F.lower("name")).alias("packages"), F.count_if("is_dev").alias("dev"))
