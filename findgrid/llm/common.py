"""Pieces that several operators share: the shared folder, words, doc_id hashes and literals."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType, StructField, StructType

from findgrid.functions.shared import save_table as save
from findgrid.functions.shared import shared_dir

__all__ = ["any_of", "appended", "documents", "free_memory", "id_mod", "let", "n_words", "packed", "raw_texts", "released", "released_group", "save", "shared_dir", "small_batches", "unpacked", "words"]

#: Java and RE2 class body of the separators of all word rules here: space and \t \n \v \f \r.
SPACE = r"\x20\x09-\x0D"
SPACE_CHARS = " \t\n\x0b\x0c\r"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: Rows of an Arrow batch: rows here are whole texts, and 10,000 of them (Spark's default) are too many for an executor.
BATCH_ROWS = 1000


def small_batches(df: DataFrame, rows: int = BATCH_ROWS) -> DataFrame:
    """df, whose session hands Python at most `rows` rows at once (Spark also ends a batch at 64 MB)."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= rows:
        conf.set(key, str(rows))
    return df


def released(run: Callable, forget: Callable[[], None] | None = None) -> Callable:
    """run(batches) for mapInArrow or mapInPandas, at whose end, or if it is given up, the worker hands free memory back to the system:
    idle workers are kept for later tasks, and what they hold counts against the executor. forget: a function of a module
    that empties the tables which the module keeps from call to call; it is called first."""

    def tidy(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            free_memory(forget)

    return tidy


def released_group(run: Callable, forget: Callable[[], None] | None = None) -> Callable:
    """run(rows) for applyInPandas, with what released() does after each group."""

    def tidy(rows):
        try:
            return run(rows)
        finally:
            free_memory(forget)

    return tidy


def free_memory(forget: Callable[[], None] | None = None) -> None:
    if forget:
        forget()
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def raw_texts(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of an Arrow column of strings, without decoding."""
    return column.cast(pa.binary()).to_pylist()


def packed(docs: DataFrame, column: str = "text") -> DataFrame:
    """docs with `column` as zstandard bytes (null stays null): half of what a shuffle of plain texts writes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1)
        for b in batches:
            i = b.schema.get_field_index(column)
            z = pa.array([None if t is None else pack.compress(t) for t in raw_texts(b.column(i))], pa.binary())
            yield b.set_column(i, pa.field(column, pa.binary()), z)

    schema = StructType([StructField(f.name, BinaryType(), True) if f.name == column else f for f in docs.schema])
    return small_batches(docs).mapInArrow(released(run), schema)


def unpacked(docs: DataFrame, column: str = "text") -> DataFrame:
    """What packed() took, back again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for b in batches:
            i = b.schema.get_field_index(column)
            t = pa.array([None if z is None else unpack.decompress(z) for z in b.column(i).to_pylist()], pa.binary()).cast(pa.string())
            yield b.set_column(i, pa.field(column, pa.string()), t)

    schema = StructType([StructField(f.name, StringType(), True) if f.name == column else f for f in docs.schema])
    return small_batches(docs).mapInArrow(released(run), schema)


def appended(docs: DataFrame, carry: tuple[str, ...], ddl: str, types: dict[str, pa.DataType], make: Callable[[], Callable[[list[str | None]], list[tuple]]]) -> DataFrame:
    """The columns `carry` as they are, and new ones. make() is called once a task and gives a function from the texts of a batch
    to a tuple of new values for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        answer = make()
        for b in batches:
            got = list(zip(*answer(b.column(b.num_columns - 1).to_pylist()), strict=True)) or [()] * len(types)
            made = [pa.array(x, t) for x, t in zip(got, types.values(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(carry))), *made], [*carry, *types])

    kinds = dict(docs.dtypes)
    return small_batches(docs).select(*(F.col(f"`{c}`") for c in carry), "text").mapInArrow(released(run), ", ".join(f"`{c}` {kinds[c]}" for c in carry) + ", " + ddl)


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once a row: a lambda variable bound through a one-element array."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """Array of the words of a text ([^\\x20\\x09-\\x0D]+), empty for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+"), lambda w: w != "")


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def id_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id's decimal text, modulo n: the fold of a document."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def any_of(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, cols, F.lit(False))

