"""Token counts by source, language and tokenizer version, kept by signed deltas.

A batch holds inserts, revised counts and deletes of (doc_id, tokenizer). apply() writes its rows as ledger rows, dealt into hash
buckets as folders, and joins them with the ledger of the last known count of each pair: only the buckets that the batch touches
are read. The join gives signed deltas, written as sums by (source, lang, tokenizer), and last comes a commit mark. Only marked
batches count, and applying a marked batch again does nothing, so a retry after a crash or a replay changes no total; totals are
sums of the batches' sums. Batches come in order: a number below the last commit that was never committed is refused. compact()
writes the ledger's live rows and the totals as a new base, whose mark names all batches before it, after which older ones aren't
read; apply() calls it every `compact_every` batches. vacuum() deletes what the newest base stands for, when no reader needs it.

Rows: op is `put` (insert or revise) or `delete`; rows of another op, or without doc_id or tokenizer, are left out, as nothing
could revise them. Null source or lang are groups of their own; a null count is 0. Rows of one pair repeated in a batch count
once, the largest (count, source, lang) wins, a delete before any. Deleting an unknown pair does nothing. Empty batches commit.
Texts are not read here, so their length plays no part; extra columns are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Buckets of a new ledger; its number is kept with it.
BUCKETS = 64
LEDGER = "doc_id long, tokenizer string, source string, lang string, n_tokens long, live boolean, batch long, bucket int"
DELTAS = "source string, lang string, tokenizer string, docs long, tokens long, batch long"
COMMITS = "batch long, base boolean"
BATCH = "op string, doc_id long, tokenizer string, source string, lang string, n_tokens long"


class Rollup:
    """The three tables under one folder that driver and executors share."""

    def __init__(self, spark: SparkSession, root: str, compact_every: int = 32, buckets: int = BUCKETS):
        self.spark, self.root, self.compact_every = spark, root, compact_every
        kept = self._read(f"{root}/buckets", "n int").first()
        if kept is None:
            spark.range(1).select(F.lit(buckets).alias("n")).write.mode("overwrite").parquet(f"{root}/buckets")
        self.buckets = kept["n"] if kept else buckets

    def _read(self, path: str, schema: str) -> DataFrame:
        """The table at a path, empty if there is none."""
        try:
            return self.spark.read.schema(schema).parquet(path)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], schema)

    def committed(self) -> DataFrame:
        """Rows (batch, base): committed batches, and those that a base stands for them and all before."""
        return self._read(f"{self.root}/commits/*", COMMITS)

    def _parts(self) -> list[str]:
        """Names of the last base and the batches since: a few numbers, as apply() compacts."""
        base = self.committed().filter("base").agg(F.max("batch").alias("b")).first()["b"]
        later = self.committed().filter(~F.col("base") & (F.col("batch") > F.lit(base if base is not None else -(1 << 62)))).select("batch").distinct().collect()
        return ([f"base{base}"] if base is not None else []) + [f"b{r['batch']}" for r in sorted(later)]

    def _of_committed(self, table: str, schema: str) -> DataFrame:
        parts = self._parts()
        if not parts:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.option("basePath", f"{self.root}/{table}").schema(f"{schema}, part string").parquet(*(f"{self.root}/{table}/part={p}" for p in parts)).drop("part")

    def ledger(self, buckets: list[int] | None = None) -> DataFrame:
        """The last known row of each (doc_id, tokenizer), of some buckets or of all."""
        last = F.max_by(F.struct("source", "lang", "n_tokens", "live"), "batch").alias("x")
        rows = self._of_committed("ledger", LEDGER)
        if buckets is not None:
            rows = rows.filter(F.col("bucket").isin(buckets))
        return rows.groupBy("doc_id", "tokenizer").agg(last).select("doc_id", "tokenizer", "x.*")

    def _write_ledger(self, rows: DataFrame, part: str) -> None:
        bucket = F.pmod(F.xxhash64("doc_id", "tokenizer"), F.lit(self.buckets)).cast("int")
        rows.select("doc_id", "tokenizer", "source", "lang", "n_tokens", "live", "batch", bucket.alias("bucket")).hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/ledger/part={part}")

    def compact(self) -> None:
        """Write live rows and totals up to the last commit as a new base. A crash before its mark leaves the old state."""
        last = self.committed().agg(F.max("batch").alias("b")).first()["b"]
        if last is not None and not self._parts() == [f"base{last}"]:
            number = F.lit(last).cast("long").alias("batch")
            self._write_ledger(self.ledger().filter("live").withColumn("batch", number), f"base{last}")
            self.totals().select("source", "lang", "tokenizer", "docs", "tokens", number).write.mode("overwrite").parquet(f"{self.root}/deltas/part=base{last}")
            before = self.committed().select("batch", F.lit(False).alias("base")).distinct()
            before.unionByName(self.spark.range(1).select(number, F.lit(True).alias("base"))).coalesce(1).write.mode("overwrite").parquet(f"{self.root}/commits/base{last}")  # a few bytes for each batch ever

    def vacuum(self) -> None:
        """Delete tables and marks that the newest base stands for, and parts that were never committed."""
        keep, jvm = set(self._parts()), self.spark.sparkContext._jvm
        for table, named in (("ledger", "part="), ("deltas", "part="), ("commits", "")):
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{table}")
            store = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
            for f in store.listStatus(path) if store.exists(path) else ():
                if f.getPath().getName().removeprefix(named) not in keep:
                    store.delete(f.getPath(), True)

    def apply(self, batch: int, rows: DataFrame) -> bool:
        """Commit rows as batch number `batch`; False if that number was committed before."""
        if not self.committed().filter(F.col("batch") == batch).isEmpty():
            return False
        last = self.committed().agg(F.max("batch").alias("b")).first()["b"]
        if last is not None and batch < last:
            raise ValueError(f"batch {batch} comes after batch {last}, which is committed")
        rows = rows.filter("op IN ('put', 'delete') AND doc_id IS NOT NULL AND tokenizer IS NOT NULL").withColumn("n_tokens", F.coalesce("n_tokens", F.lit(0).cast("long")))
        put = F.col("op") == "put"
        best = F.max_by(F.struct("source", "lang", "n_tokens", put.alias("live")), F.struct(~put, "n_tokens", "source", "lang")).alias("x")
        number = F.lit(batch).cast("long").alias("batch")
        best = rows.groupBy("doc_id", "tokenizer").agg(best).select("doc_id", "tokenizer", F.col("x.source").alias("source"), F.col("x.lang").alias("lang"), F.col("x.n_tokens").alias("n_tokens"), F.col("x.live").alias("live"), number)
        self._write_ledger(best, f"b{batch}")
        new = self.spark.read.schema(LEDGER).parquet(f"{self.root}/ledger/part=b{batch}")
        touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]
        old = self.ledger(touched).filter("live").select("doc_id", "tokenizer", F.struct("source", "lang", "n_tokens").alias("was"))
        both = new.join(old, ["doc_id", "tokenizer"], "left")
        # signed: what was counted goes out under its old source and language, what is counted now comes in
        out = F.when(F.col("was").isNotNull(), F.struct(F.col("was.source").alias("source"), F.col("was.lang").alias("lang"), F.lit(-1).cast("long").alias("docs"), (-F.col("was.n_tokens")).alias("tokens")))
        come = F.when(F.col("live"), F.struct("source", "lang", F.lit(1).cast("long").alias("docs"), F.col("n_tokens").alias("tokens")))
        signed = both.select("tokenizer", F.explode(F.filter(F.array(out, come), lambda d: d.isNotNull())).alias("d"))
        deltas = signed.groupBy("d.source", "d.lang", "tokenizer").agg(F.sum("d.docs").alias("docs"), F.sum("d.tokens").alias("tokens"))
        deltas.select("source", "lang", "tokenizer", "docs", "tokens", number).write.mode("overwrite").parquet(f"{self.root}/deltas/part=b{batch}")
        self.spark.range(1).select(number, F.lit(False).alias("base")).write.mode("overwrite").parquet(f"{self.root}/commits/b{batch}")
        if len(self._parts()) > self.compact_every:
            self.compact()
        return True

    def totals(self) -> DataFrame:
        """Rows (source, lang, tokenizer, docs, tokens) of the groups that have documents."""
        return self._of_committed("deltas", DELTAS).groupBy("source", "lang", "tokenizer").agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).filter("docs <> 0 OR tokens <> 0")
