"""Spelling variants: words that differ by one letter, found by halves in Aho-Corasick automata.

One inserted, deleted or replaced letter leaves one half of the shorter word whole: its left half starts the other word, or its right
half ends it. Every word is stored under both halves, and every word looks for the halves that a word of its own length or one
shorter can share with it. Keys (length, whole left part, whole right part) deal both out. A key that more than CROWDED words are
stored under is halved again, for its stored words and for those that look there alike, until what is left of it is one letter: so no
key grows with the table, and no pairs of a crowded half are made. A shard is a run of whole keys of up to SHARD rows. Its automaton
holds the halves of its stored words; all words that look there are scanned by it; of a hit, the place of the half, the lengths and
the letters that the key promises are checked, then the distance itself.

Null and empty texts have no runs. Words are counted where texts are read, in tables of at most COUNTED entries a task, before they
are shuffled; texts of more than LONG characters are scanned run by run. A null doc_id counts as an empty string. Rows that repeat a
document count again. Ties between forms go to the first in code-point order. An empty table gives no rows. Columns other than doc_id
and text are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from findgrid.llm.common import raw_texts, released, save, small_batches
from findgrid.llm.trie import sql_crc32

RUN = re.compile("[a-zÀ-ÿ]+")
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: Words stored under one key, and rows of one automaton.
CROWDED, SHARD = 200, 30_000
COUNTED, LONG = 200_000, 1 << 20


def words(docs: DataFrame, least_length: int = 6, least_n: int = 5, damage: int = 199) -> DataFrame:
    """Rows (word, n) of the runs of letters of all texts, A-Z as a-z, in which one of `damage` occurrences (by the crc32 of doc_id and
    run) lacks a letter; 0 damages none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            b = pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], ["word", "n"])
            total.clear()
            return b

        for b in batches:
            for doc_id, text in zip(b.column("doc_id").to_pylist(), raw_texts(b.column("text")), strict=True):
                if not text:
                    continue
                plain = text.translate(_LOWER).decode()
                runs = Counter(RUN.findall(plain) if len(plain) <= LONG else (m.group() for m in RUN.finditer(plain)))
                start = zlib.crc32(b"%s:" % str("" if doc_id is None else doc_id).encode())
                for w, n in runs.items():
                    if damage and (h := zlib.crc32(w.encode(), start)) % damage == 0:
                        i = h % len(w)
                        w = w[:i] + w[i + 1 :]
                    if len(w) >= least_length:
                        total[w] += n
                if len(total) > COUNTED:
                    yield out()
        yield out()

    counted = small_batches(docs.select("doc_id", "text")).mapInArrow(released(run), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_n)


def one_apart(a: str, b: str) -> bool:
    """Whether exactly one inserted, deleted or replaced code point tells a and b apart."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i:] == b[i + 1 :] if len(a) < len(b) else a[i + 1 :] == b[i + 1 :]


#: Columns of a row: the key's length of stored words and the bounds lo, hi of what is not yet known to be whole in them; extra is 1
#: for a word that looks for shorter ones, 0 for one that looks for its like, and null for a stored word.
_ROW = ("word", "n", "length", "lo", "hi", "extra")


def _keyed(rows: DataFrame) -> DataFrame:
    left, right = F.substring("word", F.lit(1), F.col("lo")), F.expr("substring(word, hi + 1 + coalesce(extra, 0))")
    return rows.select(*_ROW, F.concat_ws("*", F.col("length").cast("string"), left, right).alias("key"))


def _halved(rows: DataFrame) -> DataFrame:
    """Each row twice: with the left half of its rest whole, and with the right half whole."""
    mid = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
    half = F.explode(F.array(F.struct(mid.alias("lo"), F.col("hi").alias("hi")), F.struct(F.col("lo").alias("lo"), mid.alias("hi"))))
    return _keyed(rows.withColumn("half", half).select("word", "n", "length", F.col("half.lo").alias("lo"), F.col("half.hi").alias("hi"), "extra"))


def _found(rows: list[tuple]) -> list[tuple]:
    """Pairs (word, n, other, m) one letter apart of the rows (key, word, n, length, lo, hi, extra) of a shard."""
    stored: dict[str, list[tuple[str, int]]] = defaultdict(list)
    halves: dict[str, set[tuple[int, bool, int, int]]] = defaultdict(set)
    looking: dict[tuple[str, int], set[int]] = defaultdict(set)
    for key, word, n, length, lo, hi, extra in rows:
        if extra is None:
            stored[key].append((word, n))
            left = lo >= length // 2  # which of the word's two segments is whole
            halves[word[: length // 2] if left else word[length // 2 :]].add((length, left, lo, hi))
        else:
            looking[(word, n)].add(extra)
    if not stored or not looking:
        return []
    search = ahocorasick.Automaton()
    for segment, places in halves.items():
        search.add_word(segment, (len(segment), tuple(places)))
    search.make_automaton()
    out = []
    for (word, n), extras in looking.items():
        seen = set()
        for end, (size, places) in search.iter(word):
            for length, left, lo, hi in places:
                extra = len(word) - length
                # a left half stands at the start and a right half at the end, in a word as long or one longer
                if extra not in extras or (end + 1 != size if left else end + 1 != len(word)):
                    continue
                key = f"{length}*{word[:lo]}*{word[hi + extra :]}"
                if key in seen:
                    continue
                seen.add(key)
                out += [(word, n, w, m) for w, m in stored.get(key, ()) if (extra or w < word) and one_apart(w, word)]
    return out


def near(vocabulary: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """Rows (word, n, other, m), one for each ordered pair of words of the table (word, n) that are one letter apart."""
    size = F.length("word").cast("int")
    store = vocabulary.select("word", "n", size.alias("length"), F.lit(0).alias("lo"), size.alias("hi"), F.lit(None).cast("int").alias("extra"))
    look = [vocabulary.select("word", "n", (size - x).alias("length"), F.lit(0).alias("lo"), (size - x).alias("hi"), F.lit(x).alias("extra")).filter("length >= 1") for x in (0, 1)]
    rows, ready, n_rows = _halved(store.unionByName(look[0]).unionByName(look[1])), None, 0
    while True:
        rows = save(rows, "halves")
        kept = rows.groupBy("key").agg(F.count_if(F.col("extra").isNull()).alias("n_stored"), F.count("extra").alias("n_looking"), F.max(F.col("hi") - F.col("lo")).alias("rest"))
        kept = save(kept.filter("n_stored > 0 AND (n_stored > 1 OR n_looking > 1)"), "keys")
        full = (F.col("n_stored") > crowded) & (F.col("rest") > 1)
        n_rows += kept.filter(~full).agg(F.sum(F.col("n_stored") + F.col("n_looking"))).first()[0] or 0
        fit = rows.join(kept.filter(~full).select("key"), "key")
        ready = fit if ready is None else ready.unionByName(fit)
        more = kept.filter(full).select("key")
        if more.isEmpty():
            break
        rows = _halved(rows.join(more, "key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard: list[tuple] = []

        def out(done: list[tuple]) -> pa.RecordBatch:
            types = (pa.string(), pa.int64(), pa.string(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in done], t) for i, t in enumerate(types)], ["word", "n", "other", "m"])

        for b in batches:
            for r in zip(*(b.column(c).to_pylist() for c in ("key", *_ROW)), strict=True):
                if len(shard) >= SHARD and r[0] != shard[-1][0]:
                    yield out(_found(shard))
                    shard = []
                shard.append(r)
        yield out(_found(shard))

    dealt = ready.select("key", *_ROW).repartition(max(1, n_rows // (8 * SHARD), int(vocabulary.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "key").sortWithinPartitions("key")
    once = save(dealt.mapInArrow(released(run), "word string, n long, other string, m long").distinct(), "near")
    return once.unionByName(once.select(F.col("other").alias("word"), F.col("m").alias("n"), F.col("word").alias("other"), F.col("n").alias("m")))


def variants(vocabulary: DataFrame, factor: int = 5) -> DataFrame:
    """Rows (word, form, root, n, n_near, form_n) of the table (word, n): the form is the commonest near word if it is `factor` times
    as common, the root what following forms ends at."""
    vocabulary = save(vocabulary.select("word", "n"), "vocabulary")
    best = near(vocabulary).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), F.col("other").alias("form"))).alias("best"))
    joined = vocabulary.join(best, "word", "left").withColumn("form_n", -F.col("best.m"))
    joined = joined.withColumn("form", F.when(F.col("form_n") >= factor * F.col("n"), F.col("best.form"))).withColumn("form_n", F.when(F.col("form").isNotNull(), F.col("form_n")))
    joined = save(joined.select("word", "form", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n"), "forms")
    # every round doubles the steps; a form is `factor` times as common as its word, so there are few
    roots = joined.filter("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("far"))
        new = save(roots.join(further, "root", "left").select("word", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")), "roots")
        roots = new.select("word", "root")
        if new.filter("moved").isEmpty():
            break
    return joined.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


_CODES = """flatten(list_transform(string_split(concat(coalesce(CAST(doc_id AS VARCHAR), ''), ':', run), ''),
  lambda c: CASE WHEN ord(c) < 128 THEN [ord(c)::UBIGINT] ELSE [192::UBIGINT + (ord(c) >> 6), 128::UBIGINT + (ord(c) & 63)] END))"""

#: The query's rows in DuckDB: words with one place left out are equal if they differ there only.
ORACLE = f"""
WITH RECURSIVE runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM documents),
few AS (SELECT doc_id, run, count(*) AS c FROM runs GROUP BY doc_id, run),
hashed AS (SELECT run, c, {sql_crc32(_CODES)} AS h FROM few),
left_out AS (SELECT CASE WHEN h % 199 = 0 THEN concat(substring(run, 1, (h % length(run))::BIGINT), substring(run, (h % length(run))::BIGINT + 2)) ELSE run END AS word, c FROM hashed),
v AS (SELECT word, sum(c)::BIGINT AS n FROM left_out WHERE length(word) >= 6 GROUP BY word HAVING sum(c) >= 5),
gaps AS (SELECT word, n, i, concat(substring(word, 1, i - 1), substring(word, i + 1)) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
pairs AS (SELECT a.word, b.word AS other, b.n AS m FROM gaps a JOIN gaps b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM gaps a JOIN v b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM gaps a JOIN v b ON a.rest = b.word),
ranked AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY m DESC, other) AS r, count(*) OVER (PARTITION BY word) AS n_near FROM pairs),
forms AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 5 * v.n THEN other END AS form, CASE WHEN m >= 5 * v.n THEN m END AS form_n FROM v LEFT JOIN ranked ON ranked.word = v.word AND r = 1),
up AS (SELECT word, word AS root FROM forms UNION ALL SELECT up.word, forms.form FROM up JOIN forms ON forms.word = up.root WHERE forms.form IS NOT NULL)
SELECT forms.word, forms.form, up.root, forms.n, forms.n_near, forms.form_n FROM forms JOIN up ON up.word = forms.word JOIN forms last ON last.word = up.root AND last.form IS NULL
"""
