"""TF-IDF search over chunks: tokenising, postings, idf, ranking, context packing."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from findgrid.sources.files import extension, language

# Words that are not indexed.
STOP_WORDS = tuple(
    """the is at which on a an and or but in with to for of by from as are was were been be has have had do does did will would could should may might can
    shall this that these those it its not no nor if else then than so such only just also very too about above after again all any both each few more most other
    some into over under up out off down here there when where why how what who whom while during before between through using use get set put let make run new return
    void null true false none self super base class struct enum trait impl type fn fun def function var const static public private protected internal override virtual
    abstract sealed readonly async await import export require include package module namespace default case switch match break continue loop try catch finally throw
    throws raise except yield println print console log debug info warn error assert expect unwrap panic todo fixme hack xxx note warning""".split()
)
CHUNK_BYTES, OVERLAP = 2000, 3
CONTEXT_BYTES = 25_000


def chunk_text(content: str, budget: int = CHUNK_BYTES, overlap: int = OVERLAP) -> list[tuple[int, int, str]]:
    """(first line, last line, text) of the chunks of a text: lines until the byte budget, or from half of it up to a blank or
    closing line; the next chunk starts `overlap` lines back, but always after the start of this one, so it ends."""
    lines = content.split("\n")
    if lines and lines[-1] == "":
        lines.pop()
    out, start, n = [], 0, len(lines)
    while start < n:
        size, end = 0, start
        while end < n and size < budget:
            size += len(lines[end].encode()) + 1
            end += 1
            if size >= budget // 2 and end < n and lines[end - 1].strip() in ("", "}", "```"):
                break
        text = "\n".join(lines[start:end])
        if text.strip():
            out.append((start + 1, end, text))
        start = max(end - overlap, start + 1) if end + overlap < n and end > overlap else end
    return out


def chunks(files: DataFrame, budget: int = CHUNK_BYTES) -> DataFrame:
    """Rows (path, ord, start_line, end_line, content) of files (path, content); no shuffle, a file at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(p, i, *c) for p, t in zip(b["path"], b["content"], strict=True) for i, c in enumerate(chunk_text(t or "", budget))], columns=["path", "ord", "start_line", "end_line", "content"])

    return files.select("path", "content").mapInPandas(run, "path string, ord long, start_line long, end_line long, content string")


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters, digits and underscores of more than one byte."""
    return F.filter(F.split(F.lower(text), r"[^\p{IsAlphabetic}\p{N}_]+"), lambda t: F.octet_length(t) > 1)


def postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Rows (key, term, tf) without stop words."""
    t = docs.select(key, F.explode(F.filter(tokens(F.col(text)), lambda x: ~x.isin(*STOP_WORDS))).alias("term"))
    return t.groupBy(key, "term").agg(F.count("*").alias("tf"))


def idf(post: DataFrame, n: int) -> DataFrame:
    """Rows (term, df, idf): ln(n / (df + 1)) + 1."""
    return post.groupBy("term").agg(F.count("*").alias("df")).withColumn("idf", F.log(F.lit(float(n)) / (F.col("df") + 1)) + 1)


def query_terms(spark: SparkSession, question: str) -> DataFrame:
    """Rows (term, times) of a question, tokenised as documents are."""
    return spark.createDataFrame([(question,)], "q string").select(F.explode(tokens(F.col("q"))).alias("term")).groupBy("term").agg(F.count("*").alias("times"))


def search(docs: DataFrame, key: str, text: str, path: str, question: str, n: int = 10) -> DataFrame:
    """The n best (key, score): each question word with positive idf adds (1 + ln tf) * idf where it occurs, and half its idf
    where the path contains it."""
    spark = docs.sparkSession
    # only postings of the question's words are made: the words of one question are few
    q = query_terms(spark, question)
    total = docs.count()
    mine = docs.select(key, path, F.explode(F.filter(tokens(F.col(text)), lambda x: ~x.isin(*STOP_WORDS))).alias("term")).join(F.broadcast(q), "term").groupBy(key, "term").agg(F.count("*").alias("tf"), F.first("times").alias("times"))
    weights = idf(mine, total).filter("idf > 0").select("term", "idf")
    by_text = mine.join(F.broadcast(weights), "term").select(key, (F.col("times") * (1 + F.log("tf")) * F.col("idf")).alias("s"))
    by_path = docs.select(key, F.lower(path).alias("p")).join(F.broadcast(weights.join(q, "term")), F.expr("contains(p, term)")).select(key, (F.col("times") * 0.5 * F.col("idf")).alias("s"))
    return by_text.unionByName(by_path).groupBy(key).agg(F.sum("s").alias("score")).filter("score > 0").orderBy(F.desc("score"), key).limit(n)


def pack_context(ranked: DataFrame, budget: int = CONTEXT_BYTES) -> DataFrame:
    """Of (rank, content): the leading rows that fit the byte budget, stopping at the first that does not. A report's few rows."""
    size = F.sum(F.octet_length("content")).over(Window.orderBy("rank"))
    return ranked.withColumn("used", size).filter(F.col("used") <= budget)


def save_index(files: DataFrame, root: str, key: str = "path") -> None:
    """Writes the tables chunks, postings and idf of files (path, content) below root, over an older index."""
    spark = files.sparkSession
    chunks(files).withColumn("chunk", F.concat_ws("#", key, F.col("ord").cast("string"))).write.mode("overwrite").parquet(f"{root}/chunks")
    c = spark.read.parquet(f"{root}/chunks")
    postings(c, "chunk", "content").write.mode("overwrite").parquet(f"{root}/postings")
    idf(spark.read.parquet(f"{root}/postings"), c.count()).write.mode("overwrite").parquet(f"{root}/idf")


def load_index(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    return {t: spark.read.parquet(f"{root}/{t}") for t in ("chunks", "postings", "idf")}


def index_status(index: dict[str, DataFrame]) -> DataFrame:
    """One row: files, chunks, terms and bytes of an index."""
    a = index["chunks"].agg(F.count_distinct("path").alias("files"), F.count("*").alias("chunks"), F.sum(F.octet_length("content")).alias("bytes"))
    return a.crossJoin(index["idf"].agg(F.count("*").alias("terms")))  # one row each


def token_estimate(text: Column) -> Column:
    return F.floor(F.octet_length(text) / 4) + 1


def files_in_order(ranked: DataFrame, path: str = "path", rank: str = "rank") -> DataFrame:
    """Rows (path, rank): distinct files of ranked chunks, each at its first place."""
    return ranked.groupBy(path).agg(F.min(rank).alias(rank))


def language_histogram(files: DataFrame) -> DataFrame:
    """Rows (language, files) of all files that have one, before any is left out for its size."""
    return files.select(language(F.col("path")).alias("language")).filter("language IS NOT NULL").groupBy("language").agg(F.count("*").alias("files"))


def project_map(files: DataFrame, indexed: bool = True, most: int = 8) -> DataFrame:
    """Rows (kind, name, files): the `most` frequent languages, or extensions of a project without an index."""
    if indexed:
        t = language_histogram(files).select(F.lit("language").alias("kind"), F.col("language").alias("name"), "files")
    else:
        t = files.select(extension(F.col("path")).alias("name")).filter("name <> ''").groupBy("name").agg(F.count("*").alias("files")).select(F.lit("extension").alias("kind"), "name", "files")
    return t.orderBy(F.desc("files"), "name").limit(most)
