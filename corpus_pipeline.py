"""A training-data pipeline over `documents`: rules, near copies, repeated passages, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes as Parquet and reads again for the next.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from findgrid.llm import minhash, mixing, packing, passages, quality
from findgrid.llm.common import n_words, save


def quality_stage(spark, docs, sf_dir):
    """Documents that the quality rules keep."""
    return quality.keep(docs)


def near_copies_stage(spark, docs, sf_dir):
    """One document of each group of near copies (five-word shingles, similarity 0.8)."""
    return minhash.keep(docs, words=5)


def passages_stage(spark, docs, sf_dir):
    """Documents without passages that a smaller doc_id has too; those that consist of nothing else go."""
    return passages.strip(docs)


def mix_stage(spark, docs, sf_dir):
    """Each document as often as the mix takes it; longer ones are likelier, by the logarithm of their words."""
    return mixing.repeat(mixing.mix(docs, odds=F.log2(n_words(F.col("text")) + 2)))


def pack_stage(spark, docs, sf_dir):
    """The pieces of all documents with their place in a sequence."""
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality_stage),
    ("near copies", near_copies_stage),
    ("repeated passages", passages_stage),
    ("mixing", mix_stage),
    ("packing", pack_stage),
]

#: SQL can't express the tokenizer; the pipeline is tested against brute force on a small table.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = save(docs, f"stage{k}")
    return docs
