"""The sample tables reshaped into the inputs of the operators (see FIXTURES.md).

Paper = order, author = supplier (facts) or part (linkage), position = line number,
roles = words of the part's type and name, subject code = the part's brand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from bylines.functions import sql
from bylines.operators.facts import build_facts, member_facts, with_position_class

# Subject code of Brand#1 to Brand#25.
CODES = (
    "MEDI", "NURS", "VETE", "DENT", "HEAL",
    "AGRI", "BIOC", "IMMU", "NEUR", "PHAR",
    "CENG", "CHEM", "COMP", "EART", "ENER",
    "ENGI", "ENVI", "MATE", "MATH", "PHYS",
    "ARTS", "BUSI", "DECI", "MULT", "ZZZZ",
)

# Allowed roles and alias spellings on the sample tables.
VOCAB = (
    "MEDIUM", "STANDARD", "LARGE", "PROMO", "SMALL", "ECONOMY",
    "ring", "bolt", "anvil", "widget", "gear", "gizmo", "plate", "rod",
)
ALIASES = {"small": "SMALL", "large": "LARGE"}


LINES = 250_000  # rows of lineitem in one task


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts_of_lines(spark: SparkSession, sf_dir: str, lines: int) -> int:
    """Parts into which lineitem is to be cut, by its number of rows, which the files' footers have."""
    return max(1, -(-table(spark, sf_dir, "lineitem").count() // lines))


def _code(position: str) -> str:
    return f"element_at({sql.array(CODES)}, CAST({position} AS INT))"


# Words and codes are made on the dimension tables, before their rows meet the lines.


def _lines_and_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").selectExpr(
        "p_partkey",
        "p_type",
        "p_size",
        "split_part(p_name, ' ', 1) AS word1",
        "split_part(p_name, ' ', 2) AS word2",
        "CAST(regexp_replace(p_brand, 'Brand#', '') AS INT) AS brand",
    )
    lines = table(spark, sf_dir, "lineitem")
    return lines.join(parts, lines.l_partkey == parts.p_partkey)


def _lines_parts_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = f"""array_compact(array(
        CASE WHEN o_custkey % 50 <> 0 THEN {_code("o_custkey % 25 + 1")} END,
        CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN {_code("o_orderkey % 25 + 1")} END,
        CASE WHEN o_orderpriority = '1-URGENT' THEN {_code("o_custkey % 7 + 1")} END))"""
    orders = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey",
        "o_custkey",
        "o_orderstatus",
        "o_orderpriority",
        "year(o_orderdate) AS year",
        f"sort_array(array_distinct({codes})) AS codes",
    )
    rows = _lines_and_parts(spark, sf_dir)
    parts = parts_of_lines(spark, sf_dir, LINES)
    if parts > 1:
        # Both sides are laid out by paper in parts of bounded rows, where adaptive execution would join
        # parts up to a number of compressed bytes, however many rows these hold.
        rows, orders = rows.repartition(parts, "l_orderkey"), orders.repartition(parts, "o_orderkey")
    return rows.join(orders, rows.l_orderkey == orders.o_orderkey)


def author_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Curated rows: one per line, with codes and a declared author number of the paper."""
    credit = """CASE WHEN l_quantity = 1 THEN NULL WHEN l_quantity = 2 THEN '' ELSE concat_ws(', ',
        CASE WHEN l_linestatus = 'O' THEN p_type END, word1, CASE WHEN l_returnflag <> 'N' THEN word2 END) END"""
    return _lines_parts_orders(spark, sf_dir).selectExpr(
        "l_orderkey AS doi",
        "year",
        "codes AS subjareas",
        "o_custkey % 9 + 1 AS aunum",
        "l_suppkey AS auid",
        "concat('Supplier#', l_suppkey) AS surname",
        "l_linenumber AS position",
        f"{credit} AS credit",
        "o_orderpriority AS issn",
    )


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return member_facts(author_role(spark, sf_dir), vocab=VOCAB, aliases=ALIASES)


def facts(spark: SparkSession, sf_dir: str, keep_empty: bool = False, **layout: str | int) -> DataFrame:
    return build_facts(author_role(spark, sf_dir), vocab=VOCAB, aliases=ALIASES, keep_empty=keep_empty, **layout)


def placed_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_position_class(facts(spark, sf_dir))


def roster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Authors of a paper, named by part: many share a surname within a paper."""
    given = "CASE WHEN word1 IN ('red', 'blue', 'cold', 'hot') THEN concat('a', word1) ELSE word1 END"
    return (
        _lines_and_parts(spark, sf_dir)
        .selectExpr(
            "l_orderkey AS doi", "l_partkey AS auid", f"upper({given}) AS name", "upper(word2) AS surname"
        )
        .distinct()
    )


def _blurred(given: str, family: str) -> list[str]:
    """Names as another source might print them: initials, compounds, misprints."""
    return [
        f"CASE WHEN auid % 3 = 0 THEN left({given}, 1) ELSE {given} END AS name",
        f"""CASE WHEN auid % 5 = 0 THEN concat('VAN-', {family}) WHEN auid % 7 = 0 THEN concat('XX', {family})
            ELSE {family} END AS surname""",
    ]


def contrib(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roster(spark, sf_dir).selectExpr("doi", *_blurred("name", "surname"))


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested articles, one per line with up to three authors.

    The lists are made from the columns of one row, so no group is collected. NULL,
    empty, unmatched, NULL-keyed and repeated entries all occur.
    """
    supplier, part, customer = "l_suppkey", "l_partkey + 100000000", "o_custkey + 200000000"

    def author(seq: int, auid: str, given: str, family: str) -> str:
        return f"named_struct('Authorseq', {seq}, 'auid', {auid}, 'given_name', {given}, 'surname', {family})"

    def roles(auid: str, *labels: str) -> str:
        return f"named_struct('auid', {auid}, 'CRediT_mapping', array({', '.join(labels)}))"

    family = f"CASE WHEN l_partkey % 2 = 0 THEN word2 ELSE p_type END"
    au = f"""array(
        {author(1, supplier, "word1", "word2")},
        {author(2, part, "p_type", family)},
        {author(3, customer, "concat('x', word1)", "o_orderpriority")})"""
    entries = f"""array(
        {roles(supplier, "p_type", "word1")},
        {roles(customer, "word2")},
        {roles(f"CASE WHEN l_returnflag <> 'A' THEN {part} END", "p_type")},
        {roles(f"CASE WHEN l_linestatus = 'F' THEN {supplier} ELSE -1L END", "word2")})"""
    doi = "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey)"
    return _lines_parts_orders(spark, sf_dir).selectExpr(
        f"concat('e', {doi}) AS Eid",
        f"CASE WHEN l_quantity <> 3 THEN {entries} END AS contributions",
        "year AS Year",
        f"array({_code('brand')}, {_code('p_size % 25 + 1')}) AS subjareas",
        f"CASE WHEN l_quantity = 2 THEN slice({au}, 1, 0) WHEN l_quantity <> 1 THEN {au} END AS Au",
        "o_orderstatus AS publication_type",
        f"{doi} AS doi",
        "o_orderpriority AS issn",
        "named_struct('sourcetitle', concat('Journal ', o_custkey % 5)) AS source",
    )


def contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat contribution rows of the authors of ``articles``, all text."""
    return (
        articles(spark, sf_dir)
        .selectExpr("doi", "Year", "inline(Au)")
        .selectExpr(
            "doi",
            *_blurred("given_name", "surname"),
            "concat_ws(', ', given_name, surname) AS credit",
            "concat(CASE WHEN auid % 13 = 0 THEN 'x' ELSE '' END, Year) AS year",
        )
    )
