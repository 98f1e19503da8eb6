"""Findings tables: filters, merging, deduplication across scanners, scores, gates, snapshots, chains.

A findings table has title, severity, confidence, finding_type, source, file_path, line_number, exploitability and, where
rank or order matters, risk and seq (the order of arrival). Equal ranks keep that order.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from findgrid.functions import scores
from findgrid.functions.shared import dealt, save_table, tasks_for


def with_risk(f: DataFrame) -> DataFrame:
    """Adds business_impact and risk."""
    f = f.withColumn("business_impact", scores.business_impact(F.col("finding_type"), F.col("file_path")))
    return f.withColumn("risk", scores.risk(F.col("severity"), F.col("confidence"), F.col("exploitability"), F.col("business_impact")))


def at_least(f: DataFrame, min_severity: str | None = None, min_confidence: str | None = None) -> DataFrame:
    if min_severity:
        f = f.filter(scores.severity_score(F.col("severity")) >= scores.severity_score(F.lit(min_severity)))
    if min_confidence:
        f = f.filter(scores.confidence_score(F.col("confidence")) >= scores.confidence_score(F.lit(min_confidence)))
    return f


def top(f: DataFrame, n: int | None = 30, min_severity: str | None = None, min_confidence: str | None = None) -> DataFrame:
    """The n riskiest findings that pass the filters; None or, in strict use, 0 means all."""
    f = at_least(f, min_severity, min_confidence).orderBy(F.desc("risk"), "seq")
    return f.limit(n) if n else f


def gate(f: DataFrame, fail_on: str | None) -> DataFrame:
    """One row (n, fails): whether a finding of the level or above exists; Info and unknown levels never fail."""
    least = {"critical": 5, "high": 4, "medium": 3, "low": 2}.get((fail_on or "").lower(), 99)
    hit = F.count_if(scores.severity_score(F.col("severity")) >= least)
    return f.agg(hit.alias("n"), (hit > 0).alias("fails"))


def select_for_fix(f: DataFrame, text: str, everything: bool = False) -> DataFrame:
    """The findings that a selector means: all, else an exact id, else an id prefix, else a part of the path, else a least risk;
    the first kind that matches any decides."""
    try:
        least = float(text)
    except ValueError:
        least = None
    kind = scores.cascade(
        [(F.lit(everything), 0), (F.col("id") == text, 1), (F.col("id").startswith(text), 2), (F.col("file_path").contains(text), 3), (F.lit(least is not None) & (F.col("risk") >= (least or 0.0)), 4)],
        F.lit(None),
    )
    k = f.withColumn("_k", kind).filter("_k IS NOT NULL")
    best = k.agg(F.min("_k").alias("_b"))
    return k.join(F.broadcast(best), F.col("_k") == F.col("_b")).drop("_k", "_b")  # one row


def _key() -> tuple[Column, Column, Column]:
    located = F.col("file_path").isNotNull() & F.col("line_number").isNotNull()
    bucket = F.when(scores.is_credential_like(F.col("title")), F.lit("credential")).otherwise(F.lower("title"))
    return (
        F.when(located, F.col("file_path")).otherwise(F.concat("source", F.lit(":"), F.lower("title"))).alias("k_path"),
        F.when(located, F.col("line_number")).otherwise(F.lit(0)).cast("long").alias("k_line"),
        F.when(located, bucket).otherwise(F.lit("")).alias("k_bucket"),
    )


def dedup(f: DataFrame) -> DataFrame:
    """One finding of each issue: the riskiest, earliest of equals, in the place (`seq`) of the first.

    Outside the credential bucket all findings of a key have one title, so a partial maximum suffices. In it, titles may differ
    and only those of different scanners collapse, in order of arrival: a fold over the few credentials of one line.

    The findings are written once, and those that have a place are dealt out by it into tasks of bounded size; those without are
    many of few keys, of which each task keeps its best before they are shuffled."""
    return _dedup(_keyed(f))


def _keyed(f: DataFrame) -> DataFrame:
    return save_table(f.select("*", *_key()), "keyed")


def _dedup(f: DataFrame) -> DataFrame:
    """dedup() of a table of _keyed()."""
    keys = ["k_path", "k_line", "k_bucket"]
    row = F.struct(*(c for c in f.columns if c not in ("seq", *keys)))
    best = lambda x: x.groupBy(*keys).agg(F.min("seq").alias("seq"), F.min_by(row, F.struct((-F.col("risk")).alias("r"), "seq")).alias("r"))
    placed, n = F.col("file_path").isNotNull() & F.col("line_number").isNotNull(), f.count()
    at_place = lambda x: dealt(x, "k_path", "k_line", rows=n)
    plain = best(at_place(f.filter(placed & (F.col("k_bucket") != "credential")))).unionByName(best(f.filter(~placed)))
    item = F.struct("seq", "risk", F.lower("title").alias("t"), F.col("source").alias("s"), row.alias("r"))
    lists = at_place(f.filter(placed & (F.col("k_bucket") == "credential"))).groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("l"))
    same = lambda a, x: (a["t"] == x["t"]) | (a["s"] != x["s"])

    def place(acc: Column, x: Column) -> Column:
        at = F.array_position(F.transform(acc, lambda a: same(a, x)), True)
        swap = F.transform(acc, lambda a, i: F.when((i + 1 == at) & (x["risk"] > a["risk"]), x.withField("seq", a["seq"])).otherwise(a))
        return F.when(at == 0, F.concat(acc, F.array(x))).otherwise(swap)

    fold = lists.select(F.explode(F.aggregate(F.slice("l", 2, F.size("l")), F.slice("l", 1, 1), place)).alias("x"))
    return plain.select("seq", "r.*").unionByName(fold.select("x.seq", "x.r.*"))


def deduped_all(f: DataFrame) -> DataFrame:
    """Riskiest first, and of each issue the first: seq says the order. Findings of one key and one title (or, as credentials, of
    different scanners) are one issue. Within a key the fold of dedup() runs over the order of risk."""
    best = Window.partitionBy("k_path", "k_line", "k_bucket").orderBy(F.desc("risk"), "seq")
    ranked = f.select("*", *_key()).withColumn("_r", F.row_number().over(best))
    plain = ranked.filter("k_bucket <> 'credential' AND _r = 1")
    # a credential stays unless a riskier one that stays has its title or is of another scanner
    item = F.struct("_r", F.lower("title").alias("t"), F.col("source").alias("s"))
    kept = ranked.filter("k_bucket = 'credential'").groupBy("k_path", "k_line", "k_bucket").agg(F.array_sort(F.collect_list(item)).alias("l"))
    keep = lambda acc, x: F.when(F.exists(acc, lambda a: (a["t"] == x["t"]) | (a["s"] != x["s"])), acc).otherwise(F.concat(acc, F.array(x)))
    kept = kept.select("k_path", "k_line", "k_bucket", F.explode(F.aggregate(F.slice("l", 2, F.size("l")), F.slice("l", 1, 1), keep)["_r"]).alias("_r"))
    creds = ranked.join(kept, ["k_path", "k_line", "k_bucket", "_r"], "left_semi")
    return plain.unionByName(creds).drop("k_path", "k_line", "k_bucket", "_r")


def merge_and_rank(f: DataFrame) -> DataFrame:
    """dedup(), riskiest first, equals by seq. Ranges of bounded size are sorted each."""
    by, kept = (F.desc("risk"), F.col("seq")), save_table(dedup(f), "kept")
    return kept.repartitionByRange(tasks_for(f.sparkSession, kept.count()), *by).sortWithinPartitions(*by)


def scanner_feed(f: DataFrame, min_severity: str = "medium", most: int = 100) -> DataFrame:
    """Rows (risk, line) as an agent's tool shows them: deduplicated findings of the level or above, the `most` (1 to 500)
    riskiest. An unknown level filters nothing."""
    return feed_lines(dedup(f), min_severity).orderBy(F.desc("risk"), "seq").limit(min(max(most, 1), 500)).select("risk", "line")


def feed_lines(kept: DataFrame, min_severity: str) -> DataFrame:
    """kept with the tool's line, without findings below the level."""
    if min_severity.lower() in ("critical", "high", "medium", "low", "info"):
        kept = at_least(kept, min_severity.capitalize())
    place = F.when(F.col("file_path").isNull(), "<unknown>").otherwise(F.concat("file_path", F.lit(":"), F.coalesce(F.col("line_number").cast("string"), F.lit("?"))))
    line = F.concat(F.lit("["), "severity", F.lit("] "), "title", F.lit(" — "), place, F.lit(" (CWE "), F.coalesce("cwe_id", F.lit("-")), F.lit(")"))
    return kept.withColumn("line", line)


def by_layer(f: DataFrame, layer: str = "layer") -> DataFrame:
    """Rows (layer, place, title, severity, risk, total): findings of each layer by risk, place 1 the riskiest, equals by seq."""
    own = Window.partitionBy(layer)
    return f.withColumn("place", F.row_number().over(own.orderBy(F.desc("risk"), "seq"))).withColumn("total", F.count("*").over(own))


def severity_histogram(f: DataFrame, layer: str = "layer") -> DataFrame:
    n = lambda s: F.count_if(F.col("severity") == s).alias(s.lower())
    return f.groupBy(layer).agg(F.count("*").alias("total"), *map(n, ("Critical", "High", "Medium", "Low", "Info")))


def merge_scanners(*tables: DataFrame) -> DataFrame:
    """All findings in the order of the tables, with seq."""
    out = None
    for k, t in enumerate(tables):
        t = t.withColumn("_scan", F.lit(k))
        out = t if out is None else out.unionByName(t, allowMissingColumns=True)
    order = F.xxhash64("file_path", "line_number", "title")
    # a sequence number that needs no global sort: scanner, then place
    return out.withColumn("seq", F.struct("_scan", "file_path", "line_number", "title", order.alias("h"))).drop("_scan")


def summary(f: DataFrame, by: str) -> DataFrame:
    return f.groupBy(by).agg(F.count("*").alias("n"), F.avg("risk").alias("avg_risk"))


def step_table(f: DataFrame) -> DataFrame:
    """Counts by scanner and severity, and a status for each scanner."""
    n = lambda s: F.count_if(F.col("severity") == s).alias(s.lower())
    t = f.groupBy("source").agg(F.count("*").alias("total"), *map(n, ("Critical", "High", "Medium", "Low", "Info")))
    return t.withColumn("status", F.when((F.col("critical") + F.col("high")) > 0, "fail").when(F.col("total") > 0, "warn").otherwise("pass"))


def fingerprint() -> Column:
    return F.concat_ws(":", F.coalesce("file_path", F.lit("")), F.coalesce(F.col("line_number").cast("string"), F.lit("")), F.lower("title"), F.col("severity"), F.coalesce(F.lower("usage"), F.lit("")))


def new_since(now: DataFrame, before: DataFrame) -> DataFrame:
    """Distinct fingerprints of `now` that `before` lacks; what went away is not reported."""
    return now.select("fingerprint").distinct().join(before.select("fingerprint").distinct(), "fingerprint", "left_anti")


@dataclass(frozen=True)
class ChainRule:
    name: str
    factor: float
    entry: tuple[str, ...]
    target: tuple[str, ...]


# Chain types, multipliers and the title words of both sides.
CHAIN_RULES = (
    ChainRule("Privilege Escalation", 0.9, ("password", "credential", "jwt_secret", "jwt", "hardcoded"), ("idor", "access control", "authorization", "mass assignment", "autobinding")),
    ChainRule("Data Exfiltration", 0.8, ("sql injection", "command injection", "injection"), ("cors", "access-control", "wildcard", "debug")),
    ChainRule("Remote Code Execution", 1.0, ("command injection", "shell_exec", "exec", "popen", "eval"), ("insecure deserialization", "no auth", "authentication", "authorization")),
    ChainRule("Authentication Bypass", 0.85, ("jwt_secret", "jwt", "token_secret", "signing_key", "cookie"), ("cors", "access-control", "wildcard", "debug")),
    ChainRule("Cryptographic Breach", 0.7, ("md5", "sha1", "des", "ecb", "weak hash", "weak encryption"), ("encryption_key", "secret_key", "cipher_key", "aes_key", "hardcoded key")),
    ChainRule("Information Disclosure", 0.5, ("debug", "debug mode", "verbose"), ("logging", "log.", "sensitive data", "pii", "console.log")),
    ChainRule("Supply Chain Attack", 0.75, ("vulnerable dependency", "cve", "dependency"), ("mass assignment", "autobinding", "insecure deserialization", "update_attributes")),
    ChainRule("Credential Theft", 0.95, ("github", "token", "secret", "api_key", "aws_access", "private key"), ("ssrf", "debug", "path traversal", "open redirect")),
)
SAME_FILE = 1.5
# Title words of findings that come first between the ends of a chain.
THEME = ("sql", "inject", "exec", "token", "secret")


def _tagged(f: DataFrame, side: str) -> DataFrame:
    hit = lambda r: F.when(scores.contains_any(F.lower("title"), getattr(r, side)), F.struct(F.lit(r.name).alias("chain"), F.lit(r.factor).alias("factor")))
    return f.select("*", F.explode(F.filter(F.array(*map(hit, CHAIN_RULES)), lambda x: x.isNotNull())).alias("_r")).select("*", "_r.chain", "_r.factor").drop("_r")


def chains(f: DataFrame) -> DataFrame:
    """Rows (chain, entry_title, target_title, risk, n_findings): entries and targets of each rule, merged by titles.

    The risk of a pair is the mean of both times the rule's factor, half as much again within one file, 10 at most; a merged
    chain has the largest. Pairs within a file are joined by file; over files only the largest risk of each title on each
    side counts, so both sides are aggregated first and no pair of single findings over files is made."""
    # both sides from one table that is written once: the scan behind it is not repeated for each use
    f = save_table(f.select("id", "title", "file_path", "risk"), "chained")
    e, t = _tagged(f, "entry"), _tagged(f, "target")
    peak = lambda x, p: x.groupBy("chain", "factor", "title").agg(F.max_by(F.struct("risk", "file_path"), F.struct("risk", "id")).alias("m"), F.count_distinct("id").alias("n")).select("chain", "factor", F.col("title").alias(f"{p}_title"), F.col("m.risk").alias(f"{p}_risk"), F.col("n").alias(f"{p}_n"))
    capped = lambda x: F.least(x, F.lit(10.0))
    across = peak(e, "entry").join(peak(t, "target").drop("factor"), "chain").filter("entry_title <> target_title OR entry_n > 1 OR target_n > 1").withColumn("r", capped((F.col("entry_risk") + F.col("target_risk")) / 2 * F.col("factor")))
    in_file = lambda x, p: x.groupBy("chain", "factor", "title", "file_path").agg(F.max("risk").alias(f"{p}_risk"), F.min("id").alias(f"{p}_lo"), F.max("id").alias(f"{p}_hi")).withColumnRenamed("title", f"{p}_title")
    near = in_file(e, "entry").join(in_file(t, "target").drop("factor"), ["chain", "file_path"]).filter("entry_lo <> target_lo OR entry_hi <> target_hi OR entry_lo <> entry_hi")
    near = near.select("chain", "entry_title", "target_title", capped((F.col("entry_risk") + F.col("target_risk")) / 2 * F.col("factor") * SAME_FILE).alias("r"))
    best = across.select("chain", "entry_title", "target_title", "r").unionByName(near).groupBy("chain", "entry_title", "target_title").agg(F.max("r").alias("risk"))
    n = across.groupBy("chain", "entry_title", "target_title").agg(F.max(F.col("entry_n") + F.col("target_n")).alias("n_findings"))
    return best.join(n, ["chain", "entry_title", "target_title"])


def chain_members(f: DataFrame, c: DataFrame) -> DataFrame:
    """Rows (chain, entry_title, target_title, id) of the findings that each merged chain unites, and so its steps: those of the
    entry's title and those of the target's. One row a finding, so no chain is held by one task."""
    of = f.select("id", "title").distinct()
    ends = c.select("chain", "entry_title", "target_title", F.explode(F.array_distinct(F.array("entry_title", "target_title"))).alias("title"))
    return ends.join(of, "title").select("chain", "entry_title", "target_title", "id").distinct()


def filter_chains(c: DataFrame, want: str) -> DataFrame:
    """Chains whose name contains the word in any case, with or without its blanks."""
    low = F.lower("chain")
    return c.filter(low.contains(want.lower()) | F.replace(low, F.lit(" "), F.lit("")).contains(want.lower()))


def with_flow(c: DataFrame, f: DataFrame, sources: DataFrame, sinks: DataFrame, links: DataFrame, bonus: float = 1.5) -> DataFrame:
    """All chains with `paths`, the number of pairs of files (of a source and of a sink) that a taint path connects, from a file of
    the entry's title to one of the target's; the risk of those that have one is raised, 10 at most.

    Pairs come as flow.linked_files() gives them and are counted by class: files of a title times files of a title."""
    at = f.select("title", F.col("file_path").alias("path")).distinct()
    n_from = at.join(sources, "path").groupBy(F.col("title").alias("entry_title"), "from_class").agg(F.count("*").alias("n_from"))
    n_to = at.join(sinks, "path").groupBy(F.col("title").alias("target_title"), "to_class").agg(F.count("*").alias("n_to"))
    hit = links.join(n_from, "from_class").join(n_to, "to_class").groupBy("entry_title", "target_title").agg(F.sum(F.col("n_from") * F.col("n_to")).alias("paths"))
    j = c.join(hit, ["entry_title", "target_title"], "left").withColumn("paths", F.coalesce("paths", F.lit(0)))
    return j.withColumn("risk", F.when(F.col("paths") > 0, F.least(F.col("risk") + bonus, F.lit(10.0))).otherwise(F.col("risk")))


def session_merge(sessions: DataFrame, name: str | None = None) -> DataFrame:
    """Findings of sessions (session, findings) as rows: of one, or of all."""
    s = sessions.filter(F.col("session") == name) if name is not None else sessions
    return s.select("session", F.explode("findings").alias("f")).select("session", "f.*")


def ci_totals(f: DataFrame, n_chains: DataFrame | None = None) -> DataFrame:
    """step_table(), with a step for chains if their table is given, and a total of the findings that are left after dedup()."""
    f = _keyed(f)
    t = step_table(f)
    total = step_table(_dedup(f).withColumn("source", F.lit("total")))
    out = t.unionByName(total)
    if n_chains is not None:
        k = n_chains.agg(F.count("*").alias("total"))
        zero = [F.lit(0).cast("long").alias(c) for c in ("critical", "high", "medium", "low", "info")]
        out = out.unionByName(k.select(F.lit("attack-chains").alias("source"), "total", *zero, F.when(F.col("total") > 0, "warn").otherwise("pass").alias("status")))
    return out


def intermediates(ends: DataFrame, f: DataFrame, depth: int) -> DataFrame:
    """Findings strictly between two lines of one file: rows of ends (chain_id, file_path, lo, hi) with the first depth - 2
    findings between lo and hi, those of the theme first, then by line.

    An interval join by blocks of lines: block (level, i) holds the lines from i * 2**level up to the next one. Each finding is in one
    block of each level, of which a block keeps its first depth - 2; an open interval is the union of at most two blocks a level,
    and meets those alone. So neither a file's findings nor the lines between two ends multiply out."""
    most = max(0, depth - 2)
    x = save_table(f.filter("file_path IS NOT NULL AND line_number >= 0").select("file_path", F.col("line_number").alias("line"), F.col("title").alias("between_title")), "within")
    x = x.withColumn("off", (~F.coalesce(scores.contains_any(F.lower("between_title"), THEME), F.lit(False))).cast("int"))
    ends = save_table(ends, "ends")
    top = ends.agg(F.max("hi")).first()[0] or 0
    levels = F.sequence(F.lit(0), F.lit(int(top).bit_length()))
    n = tasks_for(f.sparkSession, x.count() * (int(top).bit_length() + 1))
    by = ("off", "line", "between_title")
    blocks = x.withColumn("level", F.explode(levels)).withColumn("block", F.expr("shiftright(line, level)")).repartition(n, "file_path", "level", "block")
    first = F.row_number().over(Window.partitionBy("file_path", "level", "block").orderBy(*by))
    blocks = blocks.withColumn("r", first).filter(F.col("r") <= most).drop("r")
    low, high = "shiftright(lo + shiftleft(1L, l), l)", "shiftright(hi, l)"  # first block that starts after lo, first that ends after hi
    cover = F.expr(f"""flatten(transform(sequence(0, {int(top).bit_length()}), l -> filter(array(
        IF({low} < {high} AND {low} % 2 = 1, named_struct('level', l, 'block', {low}), null), IF({low} < {high} AND {high} % 2 = 1, named_struct('level', l, 'block', {high} - 1), null)), b -> b IS NOT NULL)))""")
    wanted = ends.withColumn("c", F.explode(cover)).select(*ends.columns, "c.level", "c.block")
    j = wanted.repartition(n, "file_path", "level", "block").join(blocks, ["file_path", "level", "block"]).drop("level", "block").repartition(n, "chain_id")
    w = Window.partitionBy("chain_id").orderBy(*by)
    return j.withColumn("step", F.row_number().over(w)).filter(F.col("step") <= most).drop("off")
