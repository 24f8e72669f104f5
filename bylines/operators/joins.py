"""Attaching one value per key to every row of that key, safe for hot keys.

A key may hold a third of all rows. Hashing rows on such a key would send them to
one task, and so would a window over it. ``attach_per_key`` therefore deals the rows of
every key, hot or not, over ``SALTS`` shares by a hash of the row. The shares that a key
really has are found by one aggregate, which combines on the map side; a key's value travels
to these shares, at most ``SALTS`` of them, and meets the rows there. Rows without a key are
dealt in the same way and meet nothing.

No row is dropped, capped or copied, nothing is broadcast, and no key is treated in a
special way. The price is one more shuffle of the shares by key, which cold keys pay too.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bylines.functions.sql import name as quoted

BITS = 63  # of a mask, so that it is never negative
SALTS = 1024  # shares of a key; at least the number of tasks that are to work on one


def attach_per_key(
    df: DataFrame,
    per_key: DataFrame,
    keys: Sequence[str],
    null_safe: Sequence[str] = (),
    how: str = "left",
    salts: int = SALTS,
    place: str = "",
    parts: int = 0,
) -> DataFrame:
    """Add the columns of ``per_key`` to the rows of ``df`` with the same key.

    ``per_key`` holds one row per key. A NULL in ``keys`` matches nothing; in ``null_safe``
    columns, which must also identify the row of ``per_key``, NULL matches NULL.
    ``how`` is 'left' (unmatched rows get NULL) or 'inner'. Where ``place`` is given, SQL on the keys that is never
    NULL, rows meet their values laid out by it and their share, in ``parts`` parts at least, and stay so.
    """
    every = [*keys, *null_safe]
    values = [c for c in per_key.columns if c not in every]
    # A struct is never NULL itself, and NULLs in it are equal, so no NULL test is pushed
    # below the aggregates that share a shuffle. The partition id keeps equal copies of a
    # row apart; unlike a random number it is the same when a lost task runs again.
    taken = [*df.columns, *per_key.columns]
    own_key, own_salt, own_place = unused(["_key", "_salt", "_place"], taken)
    own_values = unused([f"_value{i}" for i in range(len(values))], taken)
    key = f"struct({', '.join(map(quoted, every))}) AS {own_key}"
    salt = f"CAST(pmod(xxhash64({', '.join(map(quoted, df.columns))}, spark_partition_id()), {salts}) AS INT) AS {own_salt}"
    known = " AND ".join(f"{own_key}.{quoted(k)} IS NOT NULL" for k in keys)
    if how == "inner":
        df = df.filter(" AND ".join(f"{quoted(k)} IS NOT NULL" for k in keys))
    # The key's own columns travel in the key only.
    rest = [quoted(c) for c in df.columns if c not in every]
    dealt = df.selectExpr(*rest, key, salt, *([f"{place} AS {own_place}"] if place else []))
    # Columns and no struct: Spark 4.1 takes fields out of a struct below an explode and then misses some of them.
    of_key = per_key.selectExpr(key, *[f"{quoted(v)} AS {own}" for v, own in zip(values, own_values, strict=True)])
    # The shares of a key are bits of a fixed number of masks, which one shuffle by key combines.
    words = range(-(-salts // BITS))
    names = unused([f"_shares{i}" for i in words], taken)
    shares = dealt.groupBy(own_key).agg(
        *[F.expr(f"bit_or({_bit(own_salt, i)})").alias(name) for i, name in zip(words, names, strict=True)],
        *([F.max(own_place).alias(own_place)] if place else []),
    )
    met = shares.join(of_key, own_key)
    kept = [c for c in met.columns if c not in names]
    masks = ", ".join(f"struct({i * BITS} AS low, {name} AS mask)" for i, name in zip(words, names, strict=True))
    met = met.selectExpr(*kept, f"inline(filter(array({masks}), m -> m.mask <> 0)) AS (_low, _mask)")
    met = met.selectExpr(*kept, f"explode({_bits('_low', '_mask')}) AS {own_salt}")
    on = [own_key, own_salt]
    if place:
        on.append(own_place)
        # Spark lays out again what has fewer parts than its own shuffles.
        parts = max(parts, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        dealt, met = (rows.repartition(parts, own_place, own_salt) for rows in (dealt, met))
    # Spark takes the exploded shares for as few as the keys, which it may think small enough to broadcast.
    joined = dealt.join(met.hint("merge"), on, how)
    # NULL keys met each other as parts of structs; their values are taken back here.
    found = [f"CASE WHEN {known} THEN {own} END AS {quoted(v)}" for v, own in zip(values, own_values, strict=True)]
    columns = [f"{own_key}.{quoted(c)} AS {quoted(c)}" if c in every else quoted(c) for c in df.columns]
    return joined.selectExpr(*columns, *found)


def _bit(number: str, word: int) -> str:
    """A mask with the bit of a number, if it lies in this word."""
    low = word * BITS
    return f"CASE WHEN {number} BETWEEN {low} AND {low + BITS - 1} THEN shiftleft(1L, {number} - {low}) ELSE 0L END"


def _bits(low: str, mask: str) -> str:
    """The numbers whose bits are set; mostly there is one."""
    each = f"filter(sequence(0, {BITS - 1}), b -> shiftrightunsigned({mask}, b) & 1 = 1)"
    return (
        f"CASE WHEN bit_count({mask}) = 1 THEN array({low} + bit_count({mask} - 1))"
        f" ELSE transform({each}, b -> {low} + b) END"
    )


def unused(names: Sequence[str], taken: Sequence[str]) -> list[str]:
    """The names, each with as many underscores in front as keep it apart from those taken, in any case."""
    lowered = {t.lower() for t in taken}
    return [next(n for i in range(len(taken) + 1) if (n := "_" * i + name).lower() not in lowered) for name in names]


def attach_distinct_count(df: DataFrame, entity: str, member: str, name: str) -> DataFrame:
    """Add the number of distinct members of each entity; NULL for a NULL entity."""
    return attach_per_key(df, distinct_members(df, entity, member, name), [entity])


def distinct_members(df: DataFrame, entity: str, member: str, name: str) -> DataFrame:
    """Distinct members per entity; members are folded per entity before counting.

    ``member`` is a SQL expression.
    """
    folded = df.selectExpr(quoted(entity), f"{member} AS _member").distinct()
    return folded.groupBy(entity).agg(F.count("_member").alias(name))
