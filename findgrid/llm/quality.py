"""Quality rules: a threshold table compiled into one projection of text ratios, without user functions.

Rows in, the same rows out plus measures and verdicts. Null or empty text: all counts 0, so the base rule rejects it.
Repeated rows and ties: each row is judged alone. Extra columns of the input are not carried by quality_rules(), only
doc_id is. Equal 8-word windows are recognised by a 64-bit hash. A very long text is one row's arrays, some tens of bytes a word,
in one task. An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from findgrid.llm.common import SPACE, SPACE_CHARS, any_of, let, words

WINDOW = 8
SYMBOLS = "#*$%&|<>"
#: Frequent function words of the four corpus languages; text in a natural language has some of them.
STOP_WORDS = tuple(
    "the of and to in that is was for it with as on be at by are this from or an "
    "le la les de des un une du et que qui est pour dans par sur au aux ne pas "
    "der die das und ist von zu den dem ein eine mit nicht auf als für sich im "
    "el los las del y en que es por con para se su una lo al".split()
)


@dataclass(frozen=True)
class Rule:
    """A row of the threshold table: the measure must lie in [low, high], else the document is rejected for `name`."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None


#: The production thresholds. Ratios are of words, lines or characters in words.
RULES = (
    Rule("length", "n_words", low=20),
    Rule("mean_word_length", "mean_word_chars", low=2.0, high=20.0),
    Rule("symbols", "symbol_ratio", high=0.05),
    Rule("capitals", "upper_ratio", high=0.35),
    Rule("exclamations", "bang_ratio", high=0.15),
    Rule("stop_words", "stop_ratio", low=0.02),
    Rule("repeated_lines", "dup_line_ratio", high=0.6),
    Rule("doubled_words", "doubled_ratio", high=0.4),
)


def _window_hashes(ws: Column, n: int = WINDOW) -> Column:
    """Hash of every window of n = 2**k words, by doubling: three passes over the words instead of n."""

    def doubled(step: int):
        return lambda h: F.transform(F.slice(h, 1, F.greatest(F.size(h) - step, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(h, i + step)))

    out, step = F.transform(ws, lambda w: F.xxhash64(w)), 1
    while step < n:
        out, step = let(out, doubled(step)), 2 * step
    return out


def _covered(h: Column) -> Column:
    """Words that lie in a window whose hash occurs twice or more: lengths of the union of those windows."""

    def union(pos: Column) -> Column:
        # pos ascending: each window adds min(n, gap to the next one); the last adds n
        return F.aggregate(
            F.zip_with(pos, F.slice(pos, 2, F.size(pos)), lambda a, b: F.least(F.coalesce(b - a, F.lit(WINDOW)), F.lit(WINDOW))),
            F.lit(0).cast("int"),
            lambda acc, x: acc + x,
        )

    def twice(hs: Column) -> Column:
        # sorted (hash, position); a window counts if its neighbour on either side has the same hash
        s = F.array_sort(F.transform(hs, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return let(
            s,
            lambda t: F.array_sort(
                F.transform(
                    F.filter(F.transform(t, lambda x, k: F.struct(x["i"].alias("i"), ((F.get(t, k - 1)["h"] == x["h"]) | (F.get(t, k + 1)["h"] == x["h"])).alias("r"))), lambda x: x["r"]),
                    lambda x: x["i"],
                )
            ),
        )

    return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(twice(h), union))


def measures(docs: DataFrame, carry: str = "doc_id", text: str = "text") -> DataFrame:
    """The column `carry` and the raw counts of each document, in one narrow projection."""
    t = F.coalesce(F.col(text), F.lit(""))
    base = docs.select(carry, t.alias("t")).select(carry, "t", words(F.col("t")).alias("w"), F.filter(F.split("t", "\n"), lambda x: x.rlike(f"[^{SPACE}]")).alias("l"))
    w, t = F.col("w"), F.col("t")
    kept = F.length(F.translate(t, SPACE_CHARS, ""))
    return base.select(
        carry,
        F.size(w).cast("long").alias("n_words"),
        kept.cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        F.when(F.size(w) > WINDOW, let(_window_hashes(w), _covered)).otherwise(0).cast("long").alias("n_repeat_words"),
        F.size("l").cast("long").alias("n_lines"),
        F.size(F.filter(w, lambda x: F.lower(x).isin(*STOP_WORDS))).cast("long").alias("n_stop"),
        (F.length(t) - F.length(F.regexp_replace(t, r"\p{Lu}", ""))).cast("long").alias("n_upper"),
        F.size(F.filter(w, lambda x: x.endswith("!!"))).cast("long").alias("n_bang"),
        F.size(let(w, lambda ws: F.filter(ws, lambda x, i: x == F.get(ws, i - 1)))).cast("long").alias("n_doubled"),
    )


def quality_rules(docs: DataFrame, rules=RULES, carry: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: the column `carry`, counts, base_failed, kept and the names of the rules it fails."""
    m = measures(docs, carry, text)
    ratio = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    r = {
        "mean_word_chars": ratio("word_chars", "n_words"),
        "symbol_ratio": ratio("n_symbols", "word_chars"),
        "upper_ratio": ratio("n_upper", "word_chars"),
        "bang_ratio": ratio("n_bang", "n_words"),
        "stop_ratio": ratio("n_stop", "n_words"),
        "doubled_ratio": ratio("n_doubled", "n_words"),
        "dup_line_ratio": ratio("n_dup_lines", "n_lines"),
    }

    def broken(rule: Rule) -> Column:
        x = r.get(rule.measure, F.col(rule.measure))
        return any_of([c for c in (x < rule.low if rule.low is not None else None, x > rule.high if rule.high is not None else None) if c is not None])

    failed = F.filter(F.array(*(F.when(broken(x), F.lit(x.name)) for x in rules)), lambda x: x.isNotNull())
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return m.select(
        carry, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base.alias("base_failed"),
        (~base & (F.size(failed) == 0)).alias("kept"),
        F.array_join(failed, ",").alias("failed_rules"),
    )



def keep(docs: DataFrame, rules=RULES) -> DataFrame:
    """The rows that pass, with all their columns."""
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("text").alias("text"))
    # not a filter: pushed below the measures it would evaluate them all anew
    return quality_rules(whole, rules, carry="row").select(F.explode(F.when(F.col("kept"), F.array("row"))).alias("row")).select("row.*")


#: DuckDB SQL for quality_rules(documents) with RULES.
ORACLE = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(string_split_regex(t, '[ 	-
]+'), lambda x: x <> '') AS w,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ 	-
]')) AS l FROM d),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM w)),
rep AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, s) AS n FROM win) WHERE n > 1),
cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM rep) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[ 	-
]+', '', 'g'))::BIGINT AS word_chars,
        (length(t) - length(translate(t, '{SYMBOLS}', '')))::BIGINT AS n_symbols,
        (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words, len(l) AS n_lines,
        len(list_filter(w, lambda x: lower(x) IN ({", ".join(f"'{x}'" for x in dict.fromkeys(STOP_WORDS))}))) AS n_stop,
        length(t) - length(regexp_replace(t, '\p{{Lu}}', '', 'g')) AS n_upper,
        len(list_filter(w, lambda x: ends_with(x, '!!'))) AS n_bang,
        len(list_filter(list_zip(w[:len(w) - 1], w[2:]), lambda x: x[1] = x[2])) AS n_doubled
      FROM w LEFT JOIN cov USING (doc_id)),
r AS (SELECT *, word_chars / greatest(n_words, 1) AS mean_word_chars, n_symbols / greatest(word_chars, 1) AS symbol_ratio,
        n_upper / greatest(word_chars, 1) AS upper_ratio, n_bang / greatest(n_words, 1) AS bang_ratio, n_stop / greatest(n_words, 1) AS stop_ratio,
        n_doubled / greatest(n_words, 1) AS doubled_ratio, n_dup_lines / greatest(n_lines, 1) AS dup_line_ratio,
        n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m),
f AS (SELECT *, concat_ws(',', {", ".join("CASE WHEN " + " OR ".join([f"{x.measure} < {x.low}"] * (x.low is not None) + [f"{x.measure} > {x.high}"] * (x.high is not None)) + f" THEN '{x.name}' END" for x in RULES)}) AS failed_rules FROM r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND failed_rules = '' AS kept, failed_rules FROM f
"""
