"""The numbered queries over the given tables, each a thin use of its operator, and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from findgrid.llm import knn, langid, licences, minhash, mixing, packing, passages, quality, sharding, spelling, tokencounts, toxicity, trie
from findgrid.llm.common import SPACE, documents, id_mod, n_words, save, shared_dir, small_batches
from findgrid.llm.tokens import word_ids


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(documents(spark, sf_dir))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    learnt = langid.learn(docs.filter(id_mod(F.col("doc_id"), 4) != 2))
    return langid.identify(docs.select("doc_id", "text"), learnt).select("doc_id", (id_mod(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score", "accepted")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic").filter(id_mod(F.col("doc_id"), 5) != 0)
    m = toxicity.fit(docs, labels)
    return toxicity.scan(docs, m).select("doc_id", (id_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted", "n_passages")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Within a source, documents are likelier to be taken the longer they are, by the logarithm of their words."""
    docs = documents(spark, sf_dir).select("doc_id", "source", n_words(F.col("text")).alias("n"))
    return mixing.mix(docs, odds=F.log2(F.col("n") + 2), size=F.col("n")).select("doc_id", "size", "source_size", "target", "taken")


def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = knn.quantised(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return knn.top_k(vectors, F.col("vec_id") % 50 == 0)


def op6_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return licences.scan(docs, licences.train(docs))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after an insert of all documents under two tokenizers, a revision of one to words with a letter or digit, a
    delete of documents of under 5 words, and a replay of the revision."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, kept = word_ids(), ["doc_id", "source", "lang", "w", "v"]
        for b in batches:
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array([len(x) for x in ids.many(b.column("text"))], pa.int64())], [*kept, "t"])
        ids.clear()

    text = F.coalesce("text", F.lit(""))
    wordy = F.size(F.filter(F.split(text, f"[{SPACE}]+"), lambda x: x.rlike(r"[\p{L}\p{N}]"))).cast("long")
    docs = documents(spark, sf_dir).select("doc_id", "source", "lang", n_words(F.col("text")).alias("w"), wordy.alias("v"), "text")
    counted = save(small_batches(docs).mapInArrow(count, "doc_id long, source string, lang string, w long, v long, t long"), "counted")
    row = lambda op, name, n: counted.select(F.lit(op).alias("op"), "doc_id", F.lit(name).alias("tokenizer"), "source", "lang", F.col(n).alias("n_tokens"))
    r = tokencounts.Rollup(spark, f"{shared_dir(spark)}/rollup-{uuid.uuid4().hex}")
    revised = row("put", "words-1", "v").join(counted.filter("v <> w").select("doc_id"), "doc_id", "left_semi")
    r.apply(1, row("put", "words-1", "w").unionByName(row("put", "word_bpe_49k", "t")))
    r.apply(2, revised)
    r.apply(3, row("delete", "words-1", "w").join(counted.filter("w < 5").select("doc_id"), "doc_id", "left_semi"))
    r.apply(2, revised)
    return r.totals()


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir), words=4)


def op10_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.remove_repeats(documents(spark, sf_dir))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.words(documents(spark, sf_dir)))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(*trie.rebuilt(*trie.ordered(spark.read.parquet(f"{sf_dir}/conversations.parquet"))))


def op13_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(documents(spark, sf_dir))


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_language_id": op2_language_id,
    "op3_packing": op3_packing,
    "op4_near_duplicates": op4_near_duplicates,
    "op5_toxicity": op5_toxicity,
    "op6_licences": op6_licences,
    "op7_token_counts": op7_token_counts,
    "op8_mixing": op8_mixing,
    "op9_top_k": op9_top_k,
    "op10_repeated_passages": op10_repeated_passages,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_shards": op13_shards,
}

ORACLE_SQL = {
    "op1_quality_rules": quality.ORACLE,
    "op9_top_k": knn.ORACLE,
    "op11_spelling_variants": spelling.ORACLE,
    "op12_prefix_trie": trie.ORACLE,
}
