"""Label shares, label rates and binned averages over the fact table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bylines.functions.bins import EDGES, bin_of

# The columns that identify an entity row.
ENTITY_KEYS = (
    "doi",
    "year",
    "subjareas",
    "discipline",
    "row_count",
    "position_max",
    "position_min",
    "paper_credit",
    "paper_credit_num",
)


def tally(
    df: DataFrame, keys: Sequence[str], multi: str | None = None, name: str = "n", weight: str | None = None
) -> DataFrame:
    """Rows per key, or the sum of their ``weight``. ``multi`` is an array column of groups and a
    further key: rows are counted per array first, and only the counts are exploded to single groups."""
    if multi is None:
        return df.groupBy(*keys).agg((F.sum(weight) if weight else F.count(F.lit(1))).alias(name))
    return (
        tally(df, [*keys, multi], name="_n", weight=weight)
        .select(*keys, F.explode(multi).alias(multi), "_n")
        .groupBy(multi, *keys)
        .agg(F.sum("_n").alias(name))
    )


def label_share(
    facts: DataFrame,
    entity: str = "doi",
    categories: str = "subjareas",
    total: str = "row_count",
    labels: str = "credit",
) -> DataFrame:
    """Share of an entity's member rows holding each label that occurs in it.

    The counts per entity and label are joined to the entity's distinct category lists, so each
    row of the result is made once and holds one list. Both come from one count per list and
    label; keeping the count in either lets them share its shuffle.
    """
    counted = tally(
        facts.filter(f"{entity} IS NOT NULL").select(entity, categories, total, F.explode(labels).alias("label")),
        [entity, categories, total, "label"],
    )
    counts = tally(counted, [entity, "label"], weight="n")
    lists = tally(counted, [entity, categories, total], name="_rows", weight="n").filter("_rows > 0")
    return lists.join(counts, entity).selectExpr(
        entity, categories, total, "label", "n", f"try_divide(n, {total}) AS share"
    )


def mean_share(
    share: DataFrame,
    categories: str = "subjareas",
    entity: str = "doi",
    zero_fill: bool = False,
) -> DataFrame:
    """Mean share by category and label over the entities where the label occurs.

    With ``zero_fill`` over all entities of the category that hold any label.
    """
    exploded = share.select(entity, "label", "share", F.explode(categories).alias(categories))
    if not zero_fill:
        return exploded.groupBy(categories, "label").agg(F.avg("share").alias("mean_share"))
    # An entity counts once per category, on one of its labels.
    first = f"row_number() OVER (PARTITION BY {categories}, {entity} ORDER BY label) = 1 AS _first"
    return (
        exploded.selectExpr("*", first)
        .groupBy(categories, "label")
        .agg(F.sum("share").alias("_sum"), F.count_if("_first").alias("_entities"))
        .selectExpr(
            categories,
            "label",
            f"_sum / sum(_entities) OVER (PARTITION BY {categories}) AS mean_share",
        )
    )


def mean_labels(
    facts: DataFrame, entity: str = "doi", value: str = "au_credit_num", name: str = "paper_au_credit_avg"
) -> DataFrame:
    """Mean number of labels per member of each entity."""
    return facts.groupBy(entity).agg(F.avg(value).alias(name))


def to_entities(
    facts: DataFrame,
    keys: Sequence[str] = ENTITY_KEYS,
    entity: str = "doi",
    value: str = "au_credit_num",
    name: str = "paper_au_credit_avg",
) -> DataFrame:
    """One row per entity with its member count and mean number of labels per member.

    Members are counted, not collected into a list: nothing bounds their number. Rows
    of one entity that differ in another key stay apart and share the entity's mean.
    """
    # NULL entities have no mean, so their rows need not meet in one window partition.
    apart = f"CASE WHEN {entity} IS NULL THEN xxhash64({', '.join(keys)}) END"
    whole = f"OVER (PARTITION BY {entity}, {apart})"
    mean = f"CASE WHEN {entity} IS NOT NULL THEN sum(_sum) {whole} / sum(members) {whole} END"
    return (
        facts.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("members"), F.sum(value).alias("_sum"))
        .selectExpr(*keys, "members", f"{mean} AS {name}")
    )


def count_by_group(df: DataFrame, groups: str = "discipline", name: str = "n") -> DataFrame:
    """Rows per group; a row belongs to every group of its array."""
    return tally(df, [], groups, name)


def bin_share(
    entities: DataFrame,
    value: str = "paper_au_credit_avg",
    groups: str = "discipline",
    edges: Sequence[float] = EDGES,
    labels: Sequence[str] | None = None,
) -> DataFrame:
    """Rows per group and bin, and their share of the group."""
    binned = entities.selectExpr(groups, f"{bin_of(value, edges, labels)} AS range")
    return tally(binned, ["range"], groups).selectExpr(
        "*", f"n / sum(n) OVER (PARTITION BY {groups}) AS share"
    )


def count_by_position(
    facts: DataFrame, position: str = "position2", by: str | None = None, name: str = "n"
) -> DataFrame:
    """Members per position class, overall or by group."""
    return tally(facts, [position], by, name)


def label_rate(
    facts: DataFrame, position: str = "position2", labels: str = "credit", by: str | None = None
) -> DataFrame:
    """Share of the members of a position class (of a group) holding each label.

    Members are counted by label set, and only the sets are opened into labels. A NULL
    label added to each set counts the members themselves, so one pass gives both parts.
    """
    keys = [position] if by is None else [by, position]
    sets = tally(facts, [*keys, labels], name="_n")
    if by is not None:
        sets = sets.withColumn(by, F.explode(by))
    total = f"max(CASE WHEN label IS NULL THEN n END) OVER (PARTITION BY {', '.join(keys)}) AS _total"
    return (
        sets.selectExpr(*keys, "_n", f"explode(array_append({labels}, NULL)) AS label")
        .groupBy(*keys, "label")
        .agg(F.sum("_n").alias("n"))
        .selectExpr("*", total)
        .filter("label IS NOT NULL")
        .selectExpr(*keys, "label", "n", "n / _total AS rate")
    )
