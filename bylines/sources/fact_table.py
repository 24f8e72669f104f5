"""The fact table as stored data: written once, partitioned by period and bucketed by entity.

All rows of an entity lie in one bucket of their period, so metrics that group or join by entity read
the table without a shuffle. A period can be replaced alone.

Rows of a bucket are dealt over several writing tasks by a hash of the row, so that an entity with a
large part of all rows, or rows without one, are not written by one task. Reading by buckets gives
each bucket to one task, though. ``read_facts`` therefore counts the rows of the buckets first, and
where one holds far more than the others it reads the same files without regard to buckets: they are
cut into equal tasks, and the metrics shuffle what is left after combining. Results are the same.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from bylines.functions.sql import literal
from bylines.functions.sql import name as quoted

BUCKETS = 256  # at least the number of tasks that are to read the table
WRITERS = 8  # tasks over which the rows of a bucket are dealt
OVERWRITE = "spark.sql.sources.partitionOverwriteMode"
ALL_KEYS = "spark.sql.requireAllClusterKeysForCoPartition"
UNEVEN = 8.0  # times the mean bucket that the largest may hold


def _dealt(facts: DataFrame, entity: str, buckets: int, writers: int) -> DataFrame:
    share = F.pmod(F.xxhash64(*map(quoted, facts.columns)), F.lit(writers))
    return facts.repartition(buckets, bucket_of(entity, buckets), share)


def place_of(entity: str, buckets: int) -> str:
    """SQL for the bucket in which the writer puts an entity."""
    return f"pmod(hash({quoted(entity)}), {buckets})"


def bucket_of(entity: str, buckets: int) -> F.Column:
    return F.expr(place_of(entity, buckets))


@contextmanager
def _setting(spark: SparkSession, name: str, value: str | None) -> Iterator[None]:
    """A setting of the session for a while; None leaves it as it is."""
    before = spark.conf.get(name)
    spark.conf.set(name, before if value is None else value)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def write_facts(
    facts: DataFrame,
    table: str,
    path: str,
    entity: str = "doi",
    period: str = "year",
    buckets: int = BUCKETS,
    writers: int = WRITERS,
    dealt: bool = False,
) -> None:
    """Write facts to a new table with its files under ``path``. Rows without entity or period are kept.

    Facts that are ``dealt`` were laid out by ``place_of`` and as many shares as writers when they were built, while they
    were narrow, and are not shuffled again.
    """
    rows = facts if dealt else _dealt(facts, entity, buckets, writers)
    writer = rows.write.partitionBy(period).bucketBy(buckets, entity).sortBy(entity).option("path", path)
    # Rows that are dealt met their values by bucket and share, which are only some of the keys of that join.
    with _setting(facts.sparkSession, ALL_KEYS, "false" if dealt else None):
        writer.saveAsTable(table)


def register_facts(
    spark: SparkSession,
    table: str,
    path: str,
    schema: StructType,
    entity: str = "doi",
    period: str = "year",
    buckets: int = BUCKETS,
) -> None:
    """Make known a table that another session wrote, with the layout it was written with."""
    columns = ", ".join(f"{quoted(f.name)} {f.dataType.simpleString()}" for f in schema.fields)
    spark.sql(
        f"CREATE TABLE {table} ({columns}) USING parquet PARTITIONED BY ({quoted(period)})"
        f" CLUSTERED BY ({quoted(entity)}) SORTED BY ({quoted(entity)}) INTO {buckets} BUCKETS LOCATION {literal(path)}"
    )
    spark.catalog.recoverPartitions(table)


def replace_periods(
    facts: DataFrame, table: str, entity: str = "doi", buckets: int = BUCKETS, writers: int = WRITERS
) -> None:
    """Replace the periods that ``facts`` has; the files of all others stay as they are."""
    spark = facts.sparkSession
    columns = spark.table(table).columns  # those of the table, in its order
    rows = _dealt(facts.select(*map(quoted, columns)), entity, buckets, writers)
    with _setting(spark, OVERWRITE, "dynamic"):  # a writer's own option doesn't reach tables
        rows.write.mode("overwrite").insertInto(table)


def unevenness(stored: DataFrame, entity: str, buckets: int) -> float:
    """Rows of the largest bucket over those of the mean one; reads the entity column only."""
    counts = stored.groupBy(bucket_of(entity, buckets).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    largest, rows = counts.agg(F.max("n"), F.sum("n")).first()
    return largest * buckets / rows if rows else 1.0


def read_facts(
    spark: SparkSession,
    table: str,
    path: str,
    entity: str = "doi",
    buckets: int = BUCKETS,
    uneven: float = UNEVEN,
) -> DataFrame:
    """The stored facts, by buckets unless one of them is much too large."""
    stored = spark.table(table)
    if unevenness(stored, entity, buckets) <= uneven:
        return stored
    return spark.read.schema(stored.schema).parquet(path)
