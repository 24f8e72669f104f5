"""Mixing sources to target weights, in built-in functions only.

Every row gets a key, a hash of its id and text. Within a source the rows are sorted by that key, and
the mix takes them from the front until the source's budget of words is used up: whole epochs first,
then the first rows of one more, and of the row in which the budget ends only its first words. So a
source yields exactly its budget.

The sort is by ranges: keys are evenly spread, so their first digits cut a source, however large, into
ranges of about equal size. What lies before a row is the sum of the ranges before its own, one number
per range, and a running sum within the range. Rows that are equal in everything, as a source of
repeats of one row, are one entry with a count, and are told apart again in blocks at the end.

Budgets follow from weights by levelling: what a source can't take, its epochs being limited, goes to
the others by weight. Sources are ranked and levelled by running sums over ranges as well, so their
number isn't bounded by a task.
"""

from __future__ import annotations

from collections.abc import Sequence
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bylines.llm.common import attach, checkpointed

WEIGHTS = (3, 1, 2)  # of the sources by code point, repeating
SHARE = Fraction(3, 2)  # of all words that the mix has
EPOCHS = 2  # most times that a word is taken
DIGITS = 3  # hexadecimal digits of the key that number the ranges of a source: 4,096 ranges
REPEATS = 4096  # equal rows that are told apart together

SPACES = r"\x20\x09-\x0D"


def word_count(text: Column) -> Column:
    """Number of runs of other characters than white space; 0 for NULL. Each becomes one sign, so no list is made."""
    signs = F.regexp_replace(F.coalesce(text, F.lit("")), f"[{SPACES}]*+[^{SPACES}]++", "x")
    return F.length(F.rtrim(signs, F.lit(" \t\n\x0b\f\r"))).cast("bigint")


def first_words(text: Column, count: Column) -> Column:
    """The text up to the end of its word number ``count``."""
    words = F.regexp_extract_all(text, F.lit(f"[{SPACES}]*+[^{SPACES}]++"), F.lit(0))
    return F.array_join(F.slice(words, F.lit(1), count.cast("int")), "")


def _keyed(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    """source, doc_id, key, size and text of every row."""
    text, number, source = (F.col(f"`{c}`") for c in (text_col, id_col, source_col))
    spelled = F.concat(*(F.coalesce(c, F.lit("")) for c in (F.lit(f"{seed}:"), number.cast("string"), F.lit(":"), text)))
    return docs.select(
        source.alias("source"),
        number.alias("doc_id"),
        F.md5(spelled).alias("key"),
        word_count(text).alias("size"),
        text.alias("text"),
    )


def _entries(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    """Rows as source, doc_id, key and size, equal ones as one entry with their number."""
    rows = _keyed(docs, id_col, text_col, source_col, seed)
    return rows.groupBy("source", "doc_id", "key", "size").agg(F.count(F.lit(1)).alias("copies"))


def running_sums(df: DataFrame, order: Sequence[str], sums: Sequence[str]) -> DataFrame:
    """``df`` with ``_before_x`` for each ``x`` in ``sums``: the sum over all rows earlier in ``order`` (SQL).

    Rows are sorted into ranges, which are written once so that they stay as they are; the ranges'
    totals, one row each, are summed by themselves. ``order`` has to tell rows apart.
    """
    by = [F.expr(o).asc_nulls_last() for o in order]
    dealt = checkpointed(df.repartitionByRange(*by).withColumn("_range", F.spark_partition_id()))
    totals = dealt.groupBy("_range").agg(*[F.sum(x).alias(f"_sum_{x}") for x in sums])
    earlier = "OVER (ORDER BY _range ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"  # one row per range
    bases = totals.selectExpr("_range", *[f"coalesce(sum(_sum_{x}) {earlier}, 0L) AS _base_{x}" for x in sums])
    ordered = ", ".join(f"{o} NULLS LAST" for o in order)
    own = f"OVER (PARTITION BY _range ORDER BY {ordered} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    inside = dealt.selectExpr("*", *[f"sum({x}) {own} - {x} AS _own_{x}" for x in sums])
    found = inside.join(bases, "_range")
    return found.selectExpr(*df.columns, *[f"_base_{x} + _own_{x} AS _before_{x}" for x in sums])


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: Fraction = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """source, source_size and target (words, a double) from one row per source with its size.

    Sources have the weights in turn, by code point, the one without name last. Together they get
    ``share`` of all words, by weight, but none more than ``epochs`` times its words: the excess goes
    to the others by weight until none is above. If all are, the rest isn't handed out.
    """
    ranked = running_sums(sizes.withColumn("_one", F.lit(1).cast("bigint")), ["source"], ["_one"])
    listed = ", ".join(f"{w}L" for w in weights)
    ranked = ranked.selectExpr(
        "source", "source_size", f"array({listed})[CAST(_before__one % {len(weights)} AS int)] AS weight"
    )
    # By size per weight: the first ones are those that can't take their part.
    level = "source_size / weight"
    ranked = ranked.withColumn("_cap", F.col("source_size") * epochs)
    summed = checkpointed(running_sums(ranked, [level, "source"], ["_cap", "weight"]))
    whole = summed.agg(F.sum("source_size"), F.sum("weight")).first()
    total, weight = (int(x or 0) for x in whole)
    up, down = share.numerator, share.denominator
    # Exact in whole numbers: (share * total - caps before) * weight / weights left > cap.
    wide = "CAST({0} AS DECIMAL(38, 0))".format
    over = f"({wide(up * total)} - {down} * {wide('_before__cap')}) * weight > {wide('_cap')} * {down} * ({weight} - _before_weight)"
    marked = summed.withColumn("_full", F.expr(over))
    full = marked.filter("_full").agg(F.sum("_cap"), F.sum("weight")).first()
    caps, gone = (int(x or 0) for x in full)
    left, parts = up * total - down * caps, down * (weight - gone)
    target = f"CASE WHEN _full THEN CAST(_cap AS double) ELSE CAST({wide(left)} * weight AS double) / {max(parts, 1)}D END"
    return marked.selectExpr("source", "source_size", f"{target} AS target")


def _placed(
    entries: DataFrame, weights: Sequence[int], share: Fraction, epochs: int, digits: int
) -> DataFrame:
    """Entries with their source's numbers, whole epochs and rest, and the words before them in an epoch."""
    entries = entries.withColumn("_part", F.struct("source", F.substring("key", 1, digits).alias("range")))
    totals = entries.groupBy("_part").agg(F.sum(F.expr("size * copies")).alias("_sum"))
    sizes = totals.groupBy("_part.source").agg(F.sum("_sum").alias("source_size"))
    budget = "CAST(round(target) AS bigint)"
    of_source = source_targets(sizes, weights, share, epochs).selectExpr(
        "struct(source) AS _source",
        "source_size",
        "target",
        f"coalesce({budget} div nullif(source_size, 0), 0L) AS _epochs",
        f"coalesce({budget} % nullif(source_size, 0), 0L) AS _rest",
    )
    # A source has at most 16^digits ranges.
    earlier = "OVER (PARTITION BY _part.source ORDER BY _part.range ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    bases = totals.selectExpr("_part", "struct(_part.source) AS _source", f"coalesce(sum(_sum) {earlier}, 0L) AS _base")
    bases = attach(bases, of_source, "_source", "_part").drop("_source")
    own = "OVER (PARTITION BY _part ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    inside = entries.selectExpr("*", f"sum(size * copies) {own} - size * copies AS _own")
    return inside.join(bases, "_part").withColumn("before", F.expr("_base + _own")).drop("_part", "_base", "_own")


def _copies(placed: DataFrame) -> DataFrame:
    """One row per copy of an entry, with the words that the mix takes of it."""
    blocks = placed.withColumn("_block", F.explode(F.expr(f"sequence(0L, (copies - 1) div {REPEATS})")))
    blocks = blocks.repartition("key", "_block")  # a block yields a bounded number of rows
    last = f"least(copies, (_block + 1) * {REPEATS}) - 1"
    rows = blocks.withColumn("copy", F.explode(F.expr(f"sequence(_block * {REPEATS}, {last})")))
    more = "greatest(0L, least(size, _rest - (before + copy * size)))"
    return rows.withColumn("taken", F.expr(f"_epochs * size + {more}"))


def mix_sources(
    docs: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    share: Fraction = SHARE,
    epochs: int = EPOCHS,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    seed: int = 42,
    digits: int = DIGITS,
) -> DataFrame:
    """doc_id, source, key, size, source_size, target and taken for every row of ``docs``.

    ``size`` is the number of words, ``target`` the words that the row's source is to yield and
    ``taken`` those that the mix takes of the row, repeats counted. The taken words of a source add
    up to its target, rounded. Rows without id, source or text are rows like others; a NULL text has
    size 0, and NULL is a source of its own. Rows that repeat everything count each time, and so does
    what is taken of them. Equal input gives equal output, however it is partitioned. An empty table
    gives no rows. Other columns are ignored, whatever their names.
    """
    entries = checkpointed(_entries(docs, id_col, text_col, source_col, seed))
    rows = _copies(_placed(entries, weights, share, epochs, digits))
    return rows.select("doc_id", "source", "key", "size", "source_size", "target", "taken")


def mixed_texts(
    docs: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    share: Fraction = SHARE,
    epochs: int = EPOCHS,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    seed: int = 42,
    digits: int = DIGITS,
) -> DataFrame:
    """The mix itself: doc_id, source, epoch (from 0) and text, one row per time that a row is taken.

    The row in which a source's budget ends has the text up to its last word taken. Rows without
    words are taken never. Otherwise as ``mix_sources``, with the same choice.
    """
    entries = checkpointed(_entries(docs, id_col, text_col, source_col, seed))
    placed = _placed(entries, weights, share, epochs, digits).filter("_epochs > 0 OR before < _rest")
    entry = F.struct("source", "doc_id", "key", "size").alias("_entry")
    # One text per entry; equal rows are combined before they travel.
    whole = _keyed(docs, id_col, text_col, source_col, seed).select(entry, "text").groupBy("_entry").agg(F.max("text").alias("text"))
    chosen = placed.select("*", entry).join(whole, "_entry").drop("_entry")
    rows = _copies(chosen).filter("taken > 0")
    times = "sequence(0L, (taken - 1) div size)"
    taken = rows.withColumn("epoch", F.explode(F.expr(times)))
    words = F.least(F.col("size"), F.col("taken") - F.col("epoch") * F.col("size"))
    text = F.when(words == F.col("size"), F.col("text")).otherwise(first_words(F.col("text"), words))
    return taken.select("doc_id", "source", "epoch", text.alias("text"))


def oracle(weights: Sequence[int] = WEIGHTS, seed: int = 42) -> str:
    """The mix as DuckDB SQL, for SHARE and EPOCHS."""
    up, down = SHARE.numerator, SHARE.denominator
    return rf"""
        WITH d AS (
          SELECT doc_id, source, md5('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')) AS key,
            CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
          FROM documents
        ), s AS (
          SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
            {list(weights)}[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(weights)} + 1] AS weight
          FROM d GROUP BY source
        ), o AS (
          SELECT *, {EPOCHS} * source_size AS cap, sum(source_size) OVER () AS total,
            coalesce(sum({EPOCHS} * source_size) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS caps,
            sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights
          FROM s WINDOW w AS (ORDER BY source_size / weight, source NULLS LAST)
        ), f AS (
          SELECT *, ({up} * total - {down} * caps) * weight > {down} * cap * weights AS filled FROM o
        ), t AS (
          SELECT source, source_size, CASE WHEN filled THEN CAST(cap AS DOUBLE) ELSE
            CAST(({up} * total - {down} * coalesce(sum(cap) FILTER (WHERE filled) OVER (), 0)) * weight AS DOUBLE)
            / CAST({down} * sum(weight) FILTER (WHERE NOT filled) OVER () AS DOUBLE) END AS target
          FROM f
        ), b AS (
          SELECT doc_id, size, source_size, target, CAST(round(target) AS BIGINT) AS budget,
            CAST(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) AS BIGINT)
              - size AS ahead
          FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
        )
        SELECT doc_id, size, source_size, target, CASE WHEN source_size = 0 THEN 0 ELSE
          (budget // source_size) * size + greatest(0, least(size, budget % source_size - ahead)) END AS taken
        FROM b"""
