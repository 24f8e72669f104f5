"""What several operators share: tables, checkpoints, Arrow batches and attaching values to hot keys."""

from __future__ import annotations

import sys
from collections.abc import Callable, Hashable, Iterator, Sequence
from types import ModuleType
from typing import TypeVar

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

T = TypeVar("T")

SALTS = 64  # shares into which the rows of one key are dealt; the same for every key
REPEATS = 4096  # equal rows that one task makes of one
BATCH_BYTES = 8 << 20  # text that a Python task works on at a time


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate data that driver and executors share.

    It is the one in ``spark.checkpoint.dir``. Where that is unset, a local session, whose executors
    are the driver, takes a folder in its warehouse; a cluster can't go on.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints")
    return context.getCheckpointDir()


def removed(spark: SparkSession, path: str) -> None:
    """Delete a folder of intermediate data, wherever it lies."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def share(of: Column, salts: int = SALTS) -> Column:
    """A number below ``salts`` that follows from the row, so a task that runs again gets it again."""
    return F.pmod(F.xxhash64(of, F.lit(7)), F.lit(salts)).cast("int")


def attach(rows: DataFrame, values: DataFrame, key: str, spread: str, salts: int = SALTS) -> DataFrame:
    """Add the columns of ``values`` (one row per key) to all rows of that key.

    Rows of a key are dealt over ``salts`` shares by the column ``spread``. The value of a key
    travels to its shares, at most ``salts`` of them however many rows the key has, and meets the
    rows there. Rows without a value get NULL; a NULL key has none.

    Nothing is broadcast. Spark takes rows behind an explode to be as many as in front of it, so it may think
    tens of millions of shares small enough to go through the driver; the hints keep it from that.
    """
    dealt = rows.withColumn("_share", share(F.col(spread), salts))
    shares = dealt.groupBy(key, "_share").agg(F.count(F.lit(1)).alias("_rows")).drop("_rows")
    travelled = shares.hint("merge").join(values.hint("merge"), key)
    return dealt.hint("merge").join(travelled.hint("merge"), [key, "_share"], "left").drop("_share")


def one_of_each(rows: DataFrame, key: Sequence[str], copies: str) -> DataFrame:
    """One row per key, where ``copies`` tells how many there are; only rows that aren't alone are shuffled."""
    again = rows.filter(F.col(copies) > 1).dropDuplicates(list(key))
    return rows.filter(F.col(copies) == 1).unionByName(again)


def repeated(rows: DataFrame, copies: str) -> DataFrame:
    """Each row as often as ``copies`` says, without that column; many copies are made by several tasks."""
    others = [c for c in rows.columns if c != copies]
    blocks = rows.filter(F.col(copies) > 1).withColumn("_block", F.expr(f"explode(sequence(0L, ({copies} - 1) div {REPEATS}))"))
    own = f"least({REPEATS}L, {copies} - _block * {REPEATS})"
    again = blocks.repartition(*others, "_block").withColumn("_copy", F.expr(f"explode(sequence(1L, {own}))"))
    return rows.filter(F.col(copies) == 1).select(*others).unionByName(again.select(*others))


def text_slices(batch: pa.RecordBatch, text: str, size: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``size`` bytes of text each, so that memory doesn't follow text length.

    ``text`` is the column of texts, or one of their sizes.
    """
    column = batch.column(text)
    lengths = (column if pa.types.is_integer(column.type) else pa.compute.binary_length(column)).to_pylist()
    start = held = 0
    for i, n in enumerate(lengths):
        held += n or 0
        if held >= size:
            yield batch.slice(start, i + 1 - start)
            start, held = i + 1, 0
    if start < len(lengths):
        yield batch.slice(start)


def map_text(
    df: DataFrame,
    work: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]],
    schema: str | StructType,
    text: str = "text",
) -> DataFrame:
    """Run a function on bounded parts of every partition.

    ``work`` is called once per task and returns the function, so tables that it builds are
    built once per task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = work()
        for batch in batches:
            for part in text_slices(batch, text):
                yield function(part)

    return df.mapInArrow(run, schema)


def per_worker(key: tuple[str, Hashable], build: Callable[[], T]) -> T:
    """What ``build`` makes, once per Python worker and key, however many tasks the worker runs.

    A worker runs one task at a time. Only the newest key is kept of those with the same first part,
    so a key is a tuple (what it is for, which one).
    """
    kept = sys.modules.setdefault("_kept_by_worker", ModuleType("_kept_by_worker")).__dict__
    if kept.get(key[0], (None,))[0] != key:
        kept[key[0]] = key, build()
    return kept[key[0]][1]


def texts(part: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """UTF-8 of a text column; NULL becomes empty."""
    return [t or b"" for t in part.column(column).cast(pa.binary()).to_pylist()]


def columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Only the columns that an operator reads, so that others cannot clash with its own."""
    return df.select(*[F.col(f"`{n}`") for n in names])
