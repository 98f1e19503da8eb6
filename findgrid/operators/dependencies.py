"""Dependencies: manifests to rows, advisories joined by version, usage in source lines, bills of materials."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from findgrid.functions import scores
from findgrid.functions.scores import cascade, contains_any, strip
from findgrid.functions.shared import before_it, in_order
from findgrid.sources.files import file_name, split_lines

# The advisories (ecosystem, package, constraint, description, severity).
ADVISORIES = (
    ("crates.io", "serde", "<1.0.100", "CVE-2023-XXXX: Outdated serde version", "Low"), ("crates.io", "openssl", "<0.10.45", "CVE-2023-0464: OpenSSL vulnerability", "High"),
    ("crates.io", "tokio", "<1.25.0", "CVE-2023-XXXX: Tokio vulnerability", "Medium"), ("crates.io", "hyper", "<0.14.20", "CVE-2023-XXXX: Hyper HTTP request smuggling", "High"),
    ("crates.io", "reqwest", "<0.11.14", "CVE-2023-XXXX: Reqwest redirect header leak", "Medium"), ("crates.io", "regex", "<1.7.3", "CVE-2023-XXXX: Regex DoS vulnerability", "Medium"),
    ("crates.io", "zip", "<0.6.4", "CVE-2023-XXXX: Zip archive vulnerability", "High"), ("npm", "lodash", "<4.17.21", "CVE-2021-23337: Lodash prototype pollution", "High"),
    ("npm", "axios", "<0.21.2", "CVE-2021-3749: Axios SSRF vulnerability", "Medium"), ("npm", "express", "<4.17.3", "CVE-2022-24999: Express open redirect", "Medium"),
    ("npm", "minimist", "<1.2.6", "CVE-2021-44906: Minimist prototype pollution", "Medium"), ("npm", "moment", "<2.29.4", "CVE-2022-24785: Moment.js path traversal", "Low"),
    ("npm", "follow-redirects", "<1.14.8", "CVE-2022-0536: Follow-redirects credential leak", "High"), ("npm", "json5", "<2.2.2", "CVE-2022-46175: JSON5 prototype pollution", "High"),
    ("npm", "nth-check", "<2.0.1", "CVE-2021-3803: Nth-check ReDoS", "Low"), ("npm", "trim-newlines", "<3.0.1", "CVE-2021-33623: Trim-newlines ReDoS", "Low"),
    ("npm", "glob-parent", "<5.1.2", "CVE-2021-40895: Glob-parent ReDoS", "Low"), ("PyPI", "django", "<3.2.18", "CVE-2023-23969: Django potential denial of service", "Medium"),
    ("PyPI", "django", "<4.1.8", "CVE-2023-31047: Django bypass of validation", "Medium"), ("PyPI", "flask", "<2.2.5", "CVE-2023-25577: Flask open redirect", "Medium"),
    ("PyPI", "requests", "<2.31.0", "CVE-2023-32681: Requests certificate verification", "High"), ("PyPI", "urllib3", "<1.26.17", "CVE-2023-43804: Urllib3 cookie header injection", "Medium"),
    ("PyPI", "cryptography", "<39.0.1", "CVE-2023-23931: Cryptography vulnerability", "High"), ("PyPI", "pillow", "<9.5.0", "CVE-2023-3379: Pillow path traversal", "Medium"),
    ("PyPI", "jinja2", "<3.1.2", "CVE-2023-XXXX: Jinja2 XSS vulnerability", "Medium"), ("Go", "golang.org/x/net", "<0.7.0", "CVE-2022-27664: net/http memory exhaustion", "High"),
    ("Go", "golang.org/x/text", "<0.3.8", "CVE-2021-38561: Text encoding vulnerability", "Medium"), ("Go", "golang.org/x/crypto", "<0.1.0", "CVE-2022-27191: SSH key exchange panic", "Medium"),
)
# Manifest names and folders that are searched for them.
MANIFESTS = ("Cargo.toml", "package.json", "requirements.txt", "go.mod", "Gemfile", "composer.json", "pubspec.yaml", "Cargo.lock", "package-lock.json", "yarn.lock", "go.sum", "pom.xml", "build.gradle", "Pipfile")
PURL_TYPES = (("crates.io", "cargo"), ("npm", "npm"), ("pypi", "pypi"), ("go", "golang"), ("rubygems", "gem"), ("packagist", "composer"), ("pub", "pub"))
_DEPS = "name string, version string, ecosystem string, manifest_file string, is_dev boolean"
_COLS = ("name", "version", "ecosystem", "manifest_file", "is_dev")


def advisories(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(ADVISORIES), "ecosystem string, name string, constraint string, description string, severity string")


def is_manifest(path: Column) -> Column:
    return file_name(path).isin(*MANIFESTS)


# Folders below the root in which manifests are looked for, folders that are skipped there, and the names.
MANIFEST_DIRS = ("src", "app", "server", "client", "backend", "frontend", "api", "lib", "cmd", "pkg", "internal", "modules", "packages")
SKIPPED_DIRS = ("node_modules", "target", ".git", "vendor", "build", "dist")
MANIFEST_NAMES = ("cargo.toml", "package.json", "requirements.txt", "gemfile", "go.mod", "composer.json", "pubspec.yaml", "cargo.lock", "package-lock.json", "yarn.lock", "gemfile.lock", "go.sum", "pom.xml", "build.gradle")
MANIFEST_DEPTH = 3


def find_manifests(files: DataFrame, rel: str = "rel_path") -> DataFrame:
    """Files whose name, in any case, is a manifest's: in the root, or up to three folders below one of the named ones."""
    parts = F.split(rel, "/")
    folders = F.slice(parts, 1, F.size(parts) - 1)
    below = F.slice(folders, 2, F.greatest(F.size(folders) - 1, F.lit(0)))
    at = (F.size(folders) == 0) | (F.get(folders, F.lit(0)).isin(*MANIFEST_DIRS) & (F.size(below) <= MANIFEST_DEPTH) & ~F.arrays_overlap(below, F.array(*map(F.lit, SKIPPED_DIRS))))
    return files.filter(F.lower(F.element_at(parts, -1)).isin(*MANIFEST_NAMES) & at)


def dependency_findings(deps: DataFrame, known: DataFrame, lines: DataFrame) -> DataFrame:
    """Findings of vulnerable dependencies with their usage in lines: what the dependency scan reports."""
    f = vulnerable(deps, known).withColumn("exploitability", scores.exploitability(F.col("severity")))
    f = f.withColumn("file_path", F.col("manifest_file")).withColumn("title", F.concat(F.lit("Vulnerable dependency: "), "name", F.lit(" "), "version"))
    return annotate_usage(f.withColumn("finding_type", F.lit("Dependency")).withColumn("source", F.lit("dependency-scanner")), lines)


def dependency_listing(deps: DataFrame, f: DataFrame) -> DataFrame:
    """deps with n, the findings whose file path contains the dependency's name. Every part of a path whose length some name has
    is joined by equality; paths are counted first, so a manifest with many findings is one row."""
    paths = f.filter("file_path IS NOT NULL").groupBy("file_path").agg(F.count("*").alias("k"))
    names = deps.select("name").distinct()
    sizes = names.agg(F.array_sort(F.collect_set(F.length("name"))).alias("sizes"))  # one row: lengths of names
    parts = paths.crossJoin(F.broadcast(sizes)).select("k", "file_path", F.explode("sizes").alias("n")).filter((F.col("n") > 0) & (F.col("n") <= F.length("file_path")))
    parts = parts.select("k", "file_path", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("file_path") - F.col("n") + 1), lambda i: F.substr("file_path", i, F.col("n"))))).alias("name"))
    hits = parts.join(names, "name").groupBy("name").agg(F.sum("k").alias("n"))
    return deps.join(hits, "name", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def _rows(df: DataFrame, name: Column, version: Column, ecosystem: str, dev: Column) -> DataFrame:
    return df.select(name.alias("name"), version.alias("version"), F.lit(ecosystem).alias("ecosystem"), F.col("path").alias("manifest_file"), dev.alias("is_dev"))


def parse_package_json(files: DataFrame) -> DataFrame:
    """dependencies and devDependencies; leading ^ and ~ of versions go."""
    j = files.select("path", F.from_json("content", "dependencies map<string,string>, devDependencies map<string,string>").alias("j"))
    part = lambda k, dev: _rows(j.select("path", F.explode(f"j.{k}").alias("k", "v")), F.col("k"), F.regexp_replace("v", r"^[\^~]+", ""), "npm", F.lit(dev))
    return part("dependencies", False).unionByName(part("devDependencies", True))


def parse_composer_json(files: DataFrame) -> DataFrame:
    """require (without php) and require-dev; leading ^ and ~ of versions go."""
    j = files.select("path", F.from_json("content", "`require` map<string,string>, `require-dev` map<string,string>").alias("j"))
    part = lambda k, dev: _rows(j.select("path", F.explode(F.col("j")[k]).alias("k", "v")), F.col("k"), F.regexp_replace("v", r"^[\^~]+", ""), "Packagist", F.lit(dev))
    return part("require", False).filter("name <> 'php'").unionByName(part("require-dev", True))


def _lines(files: DataFrame) -> DataFrame:
    return files.select("path", F.posexplode(split_lines(F.col("content"))).alias("i", "raw")).select("path", "i", strip(F.col("raw")).alias("t"))


def parse_requirements(files: DataFrame) -> DataFrame:
    """Lines with ==; comments, -r and -- lines don't count; extras and markers stay."""
    l = _lines(files).filter((F.col("t") != "") & ~F.col("t").rlike(r"^(#|-r|--)") & F.col("t").contains("=="))
    name, version = strip(F.regexp_extract("t", r"^(.*?)==", 1)), strip(F.regexp_extract("t", r"==\s*([^,]*)", 1))
    return _rows(l, name, version, "PyPI", F.lit(False)).filter("name <> '' AND version <> ''")


def parse_go_mod(files: DataFrame) -> DataFrame:
    """require lines, single and in blocks; the v of a version stays."""
    w = Window.partitionBy("path").orderBy("i")
    state = F.last(F.when(F.col("t").rlike(r"^require\s*\("), True).when(F.col("t") == ")", False), True).over(w)
    l = _lines(files).withColumn("inside", F.coalesce(state, F.lit(False)) & ~F.col("t").rlike(r"^require\s*\("))
    spec = F.when(F.col("inside"), F.col("t")).when(F.col("t").rlike(r"^require\s+[^(\s]"), F.regexp_replace("t", r"^require\s+", ""))
    parts = F.split(F.regexp_replace(spec, r"\s*//.*$", ""), r"\s+")
    return _rows(l.filter(spec.isNotNull()).withColumn("p", parts).filter(F.size("p") >= 2), F.col("p")[0], F.col("p")[1], "Go", F.lit(False))


def parse_gemfile(files: DataFrame) -> DataFrame:
    """gem lines; version * if none is given, without >=, ~> or >."""
    l = _lines(files).filter(F.col("t").startswith("gem "))
    rest = F.regexp_replace("t", r"^(?:gem )+", "")
    name = F.regexp_replace(F.regexp_extract(rest, r"^([^, \t]*)", 1), r"""^'+|'+$|^"+|"+$""", "")
    v = strip(F.regexp_replace(strip(F.regexp_replace(strip(F.regexp_extract(rest, r",([^,]*)", 1)), r"""^['"]+|['"]+$""", "")), r"^(?:>=)*(?:~>)*>*", ""))
    return _rows(l, name, F.when(v == "", "*").otherwise(v), "RubyGems", F.lit(False)).filter("name <> '' AND NOT startswith(name, '#')")


def _by_file(parse, ecosystem: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(n, v, ecosystem, p, d) for p, t in zip(b["path"], b["content"], strict=True) for n, v, d in parse(t or "")], columns=list(_COLS))

    return run


def _cargo(text: str):
    """Section, name and version line by line. Only [dependencies] and [dev-dependencies]; text after a version stays, and a
    table of a single key keeps its end, as in the compat behaviour."""
    section = ""
    for raw in text.splitlines():
        t = raw.strip()
        if t.startswith("["):
            section = t
        elif section in ("[dependencies]", "[dev-dependencies]") and t and not t.startswith("#") and "=" in t:
            name, value = (x.strip() for x in t.split("=", 1))
            if value.startswith("{"):
                found = [x for x in value.strip("{").split(",") if x.strip().startswith("version")]
                version = found[0].split("=", 1)[1].strip().strip('"') if found and "=" in found[0] else ""
            else:
                version = value.strip('"')
            if name and version:
                yield name.strip('"'), version, section != "[dependencies]"


def _pubspec(text: str):
    """dependencies and dev_dependencies: `name: ^version`, or a nested map with a version; nested sdk maps don't count."""
    section, name = "", ""
    for raw in text.splitlines():
        line = raw.split(" #")[0].rstrip()
        t, depth = line.strip(), len(line) - len(line.lstrip())
        if not t or t.startswith("#") or ":" not in t:
            continue
        key, value = (x.strip() for x in t.split(":", 1))
        if depth == 0:
            section = key
        elif section in ("dependencies", "dev_dependencies"):
            dev = section != "dependencies"
            if depth <= 2:
                name = key
                if value and not value.startswith("{"):
                    yield name, value.strip("'\"").lstrip("^~"), dev
            elif key == "version":
                yield name, value.strip("'\"").lstrip("^~"), dev


def parse_cargo(files: DataFrame) -> DataFrame:
    return files.select("path", "content").mapInPandas(_by_file(_cargo, "crates.io"), _DEPS)


def parse_pubspec(files: DataFrame) -> DataFrame:
    return files.select("path", "content").mapInPandas(_by_file(_pubspec, "Pub"), _DEPS)


PARSERS = (("Cargo.toml", parse_cargo), ("package.json", parse_package_json), ("requirements.txt", parse_requirements), ("go.mod", parse_go_mod), ("Gemfile", parse_gemfile), ("composer.json", parse_composer_json), ("pubspec.yaml", parse_pubspec))


def parse_manifests(files: DataFrame) -> DataFrame:
    """Dependencies of all manifests among files (path, content); names without a parser give nothing."""
    out = None
    for name, parse in PARSERS:
        d = parse(files.filter(file_name(F.col("path")) == name))
        out = d if out is None else out.unionByName(d)
    return out


def _parts(version: Column) -> Column:
    """Numbers of a version; parts that aren't numbers below 2**32 are left out, so v0.6.0 is 6, 0."""
    return F.transform(F.filter(F.split(version, r"\."), lambda x: x.rlike(r"^\+?[0-9]{1,10}$") & (x.cast("bigint") < 1 << 32)), lambda x: x.cast("bigint"))


def version_matches(version: Column, constraint: Column) -> Column:
    """`<` and `<=` constraints of one, two or three numbers; others, and versions without a number, never match."""
    v, c = _parts(version), strip(constraint)
    le = c.startswith("<=")
    k = _parts(strip(F.regexp_replace(c, "^<=?", "")))
    at = lambda a, i: F.coalesce(F.get(a, F.lit(i)), F.lit(0).cast("bigint"))
    full = lambda a: F.struct(at(a, 0), at(a, 1), at(a, 2))
    x, y = F.when(F.size(k) == 2, F.struct(at(v, 0), at(v, 1), F.lit(0).cast("bigint"))).otherwise(full(v)), full(k)
    return c.startswith("<") & (F.size(v) > 0) & (F.size(k) > 0) & F.when(le, x <= y).otherwise(x < y)


def vulnerable(deps: DataFrame, known: DataFrame) -> DataFrame:
    """Findings of dependencies (name, version, ecosystem, manifest_file) that an advisory covers."""
    a = known.select(F.col("ecosystem").alias("e"), F.lower("name").alias("n"), "constraint", "description", "severity")
    # the advisories are a short table of constants; a larger one is not broadcast by hint but left to the size-checked planner
    j = deps.join(a, (F.col("ecosystem") == F.col("e")) & (F.lower("name") == F.col("n"))).filter(version_matches(F.col("version"), F.col("constraint")))
    return j.select(*deps.columns, "constraint", "description", "severity", strip(F.split("description", ":")[0]).alias("cve_id"), F.lit(0).cast("long").alias("line_number"))


def dedup_adjacent(deps: DataFrame, ecosystem: bool = False) -> DataFrame:
    """Drops a row whose name equals that of the row before it in any case; rows by name (by ecosystem and name for bills of
    materials). Only neighbours count: Django and django both stay if another name sorts between them."""
    keys = (["ecosystem"] if ecosystem else []) + ["name"]
    first = deps.groupBy(*keys).agg(F.min(F.struct("manifest_file", "version")).alias("m"))
    ordered = before_it(in_order(first, *keys), F.struct(F.col("ecosystem") if ecosystem else F.lit(""), F.lower("name")), "_p")
    kept = ordered.filter(~F.col("_p").eqNullSafe(F.struct(F.col("ecosystem") if ecosystem else F.lit(""), F.lower("name"))))
    return kept.select(*keys, "m.manifest_file", "m.version")


def import_tokens(line: Column) -> Column:
    """Lower-cased names that an import-like line mentions: quoted specs, and the names after use, import and from."""
    low = F.lower(line)
    importish = contains_any(low, ("import ", "require(", "use ", "from ", "include "))
    quoted = F.transform(F.regexp_extract_all(line, F.lit(r"""('[^']*'|"[^"]*")"""), F.lit(1)), lambda q: strip(F.substr(q, F.lit(2), F.length(q) - 2)))
    quoted = F.filter(quoted, lambda q: q.rlike(r"^[\p{IsAlphabetic}\p{N}_\-.@/]+$"))
    first = F.array(*(F.when(low.contains(k), F.regexp_extract(F.substr(line, F.instr(low, k) + len(k)), r"^([\p{IsAlphabetic}\p{N}_./]+)", 1)) for k in ("use ", "import ", "from ")))
    first = F.filter(first, lambda x: x.isNotNull() & (x != ""))
    segment = F.filter(F.transform(first, lambda x: F.regexp_extract(x, r"^([^/.]*)", 1)), lambda x: x != "")
    return F.when(importish, F.array_distinct(F.transform(F.concat(quoted, first, segment), lambda x: F.lower(x)))).otherwise(F.array().cast("array<string>"))


def usage_map(lines: DataFrame) -> DataFrame:
    """Rows (token, files): the inverted index of import tokens, files in order of path."""
    return imports(lines).groupBy("token").agg(F.array_sort(F.collect_list("path")).alias("files"))


def imports(lines: DataFrame) -> DataFrame:
    """The same index as rows (token, path): what scales when a token is in every file."""
    return lines.select(F.explode(import_tokens(F.col("line"))).alias("token"), "path").distinct()


def usage_counts(lines: DataFrame, shown: int = 4) -> DataFrame:
    """Rows (token, n_files, files): the count and the first `shown` paths of each token. Files are counted by parts of a token's
    paths, each of which gives its first ones, so that a token of every file is no single task's."""
    part = F.pmod(F.xxhash64("path"), F.lit(64))
    some = imports(lines).withColumn("_part", part).groupBy("token", "_part").agg(F.count("*").alias("n"), F.slice(F.array_sort(F.collect_list("path")), 1, shown).alias("f"))
    return some.groupBy("token").agg(F.sum("n").alias("n_files"), F.slice(F.array_sort(F.flatten(F.collect_list("f"))), 1, shown).alias("files"))


def annotate_usage(findings: DataFrame, lines: DataFrame) -> DataFrame:
    """findings (name, exploitability, ...) with n_files, usage and exploitability raised by a quarter where a source line imports
    the package or the last segment of its name, halved where none does. Counts and the first four files come from a partial
    aggregation, so a package that every file imports needs no list of them all."""
    f = findings.withColumn("_id", F.xxhash64(*findings.columns))
    full = F.lower("name")
    keys = f.select("_id", F.explode(F.array_distinct(F.array(full, F.regexp_extract(full, r"([^/]*)$", 1)))).alias("token")).distinct()
    used = imports(lines).join(keys, "token").select("_id", "path").distinct()
    part = used.withColumn("_part", F.pmod(F.xxhash64("path"), F.lit(64))).groupBy("_id", "_part").agg(F.count("*").alias("n"), F.slice(F.array_sort(F.collect_list("path")), 1, 4).alias("f"))
    shown = part.groupBy("_id").agg(F.sum("n").alias("n_files"), F.slice(F.array_sort(F.flatten(F.collect_list("f"))), 1, 4).alias("shown"))
    j = f.join(shown, "_id", "left").drop("_id").withColumn("n_files", F.coalesce("n_files", F.lit(0)))
    more = F.when(F.col("n_files") > 4, F.concat(F.lit(" (+"), (F.col("n_files") - 4).cast("string"), F.lit(" more)"))).otherwise("")
    text = F.concat(F.lit("used in "), F.col("n_files").cast("string"), F.lit(" file(s): "), F.array_join("shown", ", "), more)
    low = F.col("n_files") == 0
    return j.withColumn("usage", F.when(low, "declared in manifest but not directly imported in source (low reachability)").otherwise(text)).withColumn("exploitability", F.when(low, F.col("exploitability") * 0.5).otherwise(F.least(F.col("exploitability") + 0.25, F.lit(1.0)))).drop("shown")


def purl(ecosystem: Column, name: Column, version: Column) -> Column:
    kind = cascade([(F.lower(ecosystem) == k, v) for k, v in PURL_TYPES], ecosystem)
    return F.concat(F.lit("pkg:"), kind, F.lit("/"), F.lower(name), F.lit("@"), version)


def components(deps: DataFrame) -> DataFrame:
    """Rows of a bill of materials: deduplicated, with purl, and a position for the SPDX id."""
    d = dedup_adjacent(deps, ecosystem=True)
    d = d.withColumn("purl", purl(F.col("ecosystem"), F.col("name"), F.col("version")))
    return in_order(d, "ecosystem", "name").withColumn("spdx_id", F.concat(F.lit("SPDXRef-Package-"), F.col("_no").cast("string"))).drop("_no")


def cyclonedx(deps: DataFrame, serial: str = "urn:uuid:00000000-0000-0000-0000-000000000000", timestamp: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """One row with the CycloneDX 1.5 document: a report, as long as the list of packages."""
    c = components(deps).select(F.struct(F.lit("library").alias("type"), "name", "version", "purl").alias("c"))
    doc = c.agg(F.array_sort(F.collect_list("c")).alias("components"))
    return doc.select(F.to_json(F.struct(F.lit("CycloneDX").alias("bomFormat"), F.lit("1.5").alias("specVersion"), F.lit(serial).alias("serialNumber"), F.lit(1).alias("version"), F.struct(F.lit(timestamp).alias("timestamp")).alias("metadata"), "components")).alias("document"))


def spdx(deps: DataFrame, name: str = "project", created: str = "1970-01-01T00:00:00Z", compat: bool = False) -> DataFrame:
    """One row with the SPDX 2.3 document; compat spells versionInfo and externalRefs with underscores."""
    v, x = ("version_info", "external_refs") if compat else ("versionInfo", "externalRefs")
    ref = F.array(F.struct(F.lit("PACKAGE-MANAGER").alias("referenceCategory"), F.lit("purl").alias("referenceType"), F.col("purl").alias("referenceLocator")))
    c = components(deps).select(F.struct(F.col("spdx_id").alias("SPDXID"), "name", F.col("version").alias(v), F.lit("NOASSERTION").alias("downloadLocation"), ref.alias(x)).alias("p"))
    doc = c.agg(F.array_sort(F.collect_list("p")).alias("packages"))
    head = [F.lit("SPDX-2.3").alias("spdxVersion"), F.lit("CC0-1.0").alias("dataLicense"), F.lit("SPDXRef-DOCUMENT").alias("SPDXID"), F.lit(name).alias("name"), F.struct(F.lit(created).alias("created")).alias("creationInfo")]
    return doc.select(F.to_json(F.struct(*head, "packages")).alias("document"))
