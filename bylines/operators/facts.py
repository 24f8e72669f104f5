"""The author-role fact table: one row per member of an entity with its label set."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bylines.functions import labels as L
from bylines.functions.groups import DISCIPLINES, groups_of
from bylines.functions.sql import literal
from bylines.functions.sql import name as quoted
from bylines.operators.joins import SALTS, attach_per_key

# The columns that identify a member row.
MEMBER_KEYS = ("doi", "year", "subjareas", "aunum", "auid", "surname", "position")


def label_counts(
    df: DataFrame,
    keys: Sequence[str] = MEMBER_KEYS,
    labels: str = "credit",
    pattern: str = L.SEPARATOR,
    name: str = "n",
) -> DataFrame:
    """Raw labels of each member with their number of occurrences.

    This is the label list of a member as rows. The list itself is never collected:
    nothing bounds its length, while counts combine before the shuffle.
    """
    label = f"explode({L.split_labels(quoted(labels), pattern)}) AS label"
    return df.selectExpr(*map(quoted, keys), label).groupBy(*keys, "label").agg(F.count(F.lit(1)).alias(name))


def member_masks(
    df: DataFrame,
    keys: Sequence[str],
    labels: str,
    vocab: Sequence[str],
    aliases: Mapping[str, str],
    separator: str,
) -> tuple[DataFrame, list[str]]:
    """One row per member key with its label masks; NULL label strings make no member."""
    masks = L.label_masks(quoted(labels), vocab, aliases, separator)
    names = [f"_mask{i}" for i in range(len(masks))]
    rows = df.filter(f"{quoted(labels)} IS NOT NULL").selectExpr(
        *map(quoted, keys), *[f"{mask} AS {name}" for mask, name in zip(masks, names, strict=True)]
    )
    return rows.groupBy(*keys).agg(*[F.bit_or(name).alias(name) for name in names]), names


def entity_stats(
    members: DataFrame, entity: str, period: str, ordinal: str, masks: Sequence[str]
) -> DataFrame:
    """Per (entity, period): member rows and ordinal bounds of the whole entity, and the
    label masks of the period. The window sees one row per period of an entity."""
    by_period = members.groupBy(entity, period).agg(
        F.count(F.lit(1)).alias("_rows"),
        F.min(ordinal).alias("_low"),
        F.max(ordinal).alias("_high"),
        *[F.bit_or(mask).alias(f"_all{mask}") for mask in masks],
    )
    whole = f"OVER (PARTITION BY {quoted(entity)})"
    return by_period.selectExpr(
        quoted(entity),
        quoted(period),
        f"sum(_rows) {whole} AS row_count",
        f"max(_high) {whole} AS position_max",
        f"min(_low) {whole} AS position_min",
        *[f"_all{mask}" for mask in masks],
    )


def member_facts(
    df: DataFrame,
    keys: Sequence[str] = MEMBER_KEYS,
    categories: str = "subjareas",
    labels: str = "credit",
    vocab: Sequence[str] = L.ROLES,
    aliases: Mapping[str, str] = L.ROLE_ALIASES,
    groups: Mapping[str, Sequence[str]] = DISCIPLINES,
    separator: str = L.SEPARATOR,
) -> DataFrame:
    """The part of ``build_facts`` that needs no other member of the entity: the keys,
    ``credit``, ``discipline`` and ``au_credit_num``, after a single shuffle."""
    members, masks = member_masks(df, keys, labels, vocab, aliases, separator)
    return members.filter(L.any_label(masks)).selectExpr(
        *map(quoted, keys), *_member_columns(masks, vocab, categories, groups)
    )


def _member_columns(
    masks: Sequence[str], vocab: Sequence[str], categories: str, groups: Mapping[str, Sequence[str]]
) -> list[str]:
    return [
        f"{L.labels_of_masks(masks, vocab)} AS credit",
        f"{groups_of(quoted(categories), groups)} AS discipline",
        f"{L.mask_count(masks)} AS au_credit_num",
    ]


def build_facts(
    df: DataFrame,
    keys: Sequence[str] = MEMBER_KEYS,
    entity: str = "doi",
    period: str = "year",
    ordinal: str = "position",
    categories: str = "subjareas",
    labels: str = "credit",
    vocab: Sequence[str] = L.ROLES,
    aliases: Mapping[str, str] = L.ROLE_ALIASES,
    groups: Mapping[str, Sequence[str]] = DISCIPLINES,
    separator: str = L.SEPARATOR,
    keep_empty: bool = False,
    place: str = "",
    parts: int = 0,
    salts: int = SALTS,
) -> DataFrame:
    """Curated rows to facts: the member keys and

    * ``credit``: the member's allowed labels, canonical, distinct, in vocabulary order;
    * ``row_count``, ``position_max``, ``position_min``: over all member rows of the entity,
      also those without an allowed label (0 and NULL for a NULL entity);
    * ``discipline``: groups of the categories;
    * ``au_credit_num``: number of labels of the member;
    * ``paper_credit``, ``paper_credit_num``: labels of the entity in that period, NULL
      where either of the two is NULL.

    Members without an allowed label are dropped unless ``keep_empty``. With ``place`` they are laid out as
    ``attach_per_key`` says, before their masks become lists.
    """
    members, masks = member_masks(df, keys, labels, vocab, aliases, separator)
    stats = entity_stats(members, entity, period, ordinal, masks)
    if not keep_empty:
        members = members.filter(L.any_label(masks))
    joined = attach_per_key(members, stats, [entity], null_safe=[period], salts=salts, place=place, parts=parts)
    of_entity = [f"_all{mask}" for mask in masks]
    known = f"{quoted(entity)} IS NOT NULL AND {quoted(period)} IS NOT NULL"
    return joined.selectExpr(
        *map(quoted, keys),
        *_member_columns(masks, vocab, categories, groups),
        "coalesce(row_count, 0) AS row_count",
        "position_max",
        "position_min",
        f"CASE WHEN {known} THEN {L.labels_of_masks(of_entity, vocab)} END AS paper_credit",
        f"CASE WHEN {known} THEN CAST({L.mask_count(of_entity)} AS BIGINT) END AS paper_credit_num",
    )


def drop_empty(df: DataFrame, labels: str = "credit") -> DataFrame:
    """Drop members whose label array is empty or NULL."""
    return df.filter(f"size({quoted(labels)}) > 0")


def position_class(
    ordinal: str = "position",
    low: str = "position_min",
    high: str = "position_max",
    names: Sequence[str] = ("First author", "Middle author", "Last author"),
) -> str:
    """SQL for first, middle or last; a sole member is first, a NULL ordinal is middle."""
    first, middle, last = map(literal, names)
    return f"CASE WHEN {ordinal} = {low} THEN {first} WHEN {ordinal} = {high} THEN {last} ELSE {middle} END"


def with_position_class(facts: DataFrame, name: str = "position2") -> DataFrame:
    return facts.withColumn(name, F.expr(position_class()))
