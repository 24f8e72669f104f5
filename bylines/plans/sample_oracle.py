"""The sample queries again as plain SQL, written the direct way: pairs are listed,
rounds subtract, labels are exploded. Used to check the operators, not to run them."""

from __future__ import annotations

from bylines.functions import sql
from bylines.functions.groups import DISCIPLINES, FIELDS, OVERALL
from bylines.plans.sample_views import ALIASES, CODES, VOCAB

_CODES = "[" + sql.literals(CODES) + "]"
_VOCAB = sql.literals(VOCAB)
_CANONICAL = " ".join(f"WHEN {sql.literal(a)} THEN {sql.literal(c)}" for a, c in ALIASES.items())
_FIELD = (
    "CASE "
    + " ".join(f"WHEN code IN ({sql.literals(c)}) THEN {sql.literal(f)}" for f, c in FIELDS.items())
    + " ELSE 'multidisciplinary' END"
)
_DISCIPLINE = " || ".join(
    f"CASE WHEN list_has_any(subjareas, [{sql.literals(c)}]) THEN [{sql.literal(d)}] ELSE []::VARCHAR[] END"
    for d, c in DISCIPLINES.items()
)
_GROUPS = ", ".join(f"({sql.literal(d)})" for d in DISCIPLINES)
_LABELS = ", ".join(f"({i}, {sql.literal(v)})" for i, v in enumerate(VOCAB))


def _text(labels: str, alias: str) -> str:
    return f"array_to_string(list_sort({labels}), '|') AS {alias}"


VIEWS = {
    "author_role": f"""
        SELECT doi, year, list_sort(list_distinct(list_filter(codes, lambda c: c IS NOT NULL))) AS subjareas,
               aunum, auid, surname, position, credit, issn
        FROM (
          SELECT l_orderkey AS doi, CAST(year(o_orderdate) AS INT) AS year,
                 [CASE WHEN o_custkey % 50 <> 0 THEN {_CODES}[o_custkey % 25 + 1] END,
                  CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN {_CODES}[o_orderkey % 25 + 1] END,
                  CASE WHEN o_orderpriority = '1-URGENT' THEN {_CODES}[o_custkey % 7 + 1] END] AS codes,
                 o_custkey % 9 + 1 AS aunum, l_suppkey AS auid, concat('Supplier#', l_suppkey) AS surname,
                 l_linenumber AS position,
                 CASE WHEN l_quantity = 1 THEN NULL WHEN l_quantity = 2 THEN ''
                      ELSE concat_ws(', ', CASE WHEN l_linestatus = 'O' THEN p_type END,
                                           split_part(p_name, ' ', 1),
                                           CASE WHEN l_returnflag <> 'N' THEN split_part(p_name, ' ', 2) END) END AS credit,
                 o_orderpriority AS issn
          FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey)""",
    "tokens": """
        SELECT doi, year, subjareas, aunum, auid, surname, position, unnest(string_split(credit, ', ')) AS label
        FROM author_role""",
    "members": f"""
        SELECT doi, year, subjareas, aunum, auid, surname, position,
               list_sort(list(DISTINCT canonical) FILTER (canonical IN ({_VOCAB}))) AS credit
        FROM (SELECT *, CASE label {_CANONICAL} ELSE label END AS canonical FROM tokens) GROUP BY ALL""",
    "bounds": """
        SELECT doi, count(*) AS row_count, max(position) AS position_max, min(position) AS position_min
        FROM members GROUP BY doi""",
    "entity_labels": """
        SELECT year, doi, list_sort(list(DISTINCT label)) AS paper_credit, count(DISTINCT label) AS paper_credit_num
        FROM (SELECT year, doi, unnest(credit) AS label FROM members) GROUP BY ALL""",
    "facts": f"""
        SELECT members.*, row_count, position_max, position_min, {_DISCIPLINE} AS discipline,
               CAST(len(credit) AS INT) AS au_credit_num, paper_credit, paper_credit_num,
               CASE WHEN position = position_min THEN 'First author'
                    WHEN position = position_max THEN 'Last author' ELSE 'Middle author' END AS position2
        FROM members JOIN bounds USING (doi) LEFT JOIN entity_labels USING (year, doi)
        WHERE credit IS NOT NULL""",
    "roster": """
        SELECT DISTINCT l_orderkey AS doi, l_partkey AS auid,
               upper(CASE WHEN split_part(p_name, ' ', 1) IN ('red', 'blue', 'cold', 'hot')
                          THEN concat('a', split_part(p_name, ' ', 1)) ELSE split_part(p_name, ' ', 1) END) AS name,
               upper(split_part(p_name, ' ', 2)) AS surname
        FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "contrib": """
        SELECT doi, CASE WHEN auid % 3 = 0 THEN left(name, 1) ELSE name END AS name,
               CASE WHEN auid % 5 = 0 THEN concat('VAN-', surname)
                    WHEN auid % 7 = 0 THEN concat('XX', surname) ELSE surname END AS surname
        FROM roster""",
    "pairs": """
        SELECT doi, r.auid, upper(r.name) AS rname, upper(r.surname) AS rsur, upper(left(r.name, 1)) AS rini,
               upper(c.name) AS cname, upper(c.surname) AS csur, upper(left(c.name, 1)) AS cini
        FROM roster r JOIN contrib c USING (doi)
        WHERE r.surname IS NOT NULL AND c.surname IS NOT NULL""",
    "round1": """
        SELECT * FROM pairs WHERE rsur = csur QUALIFY count(*) OVER (PARTITION BY doi, rsur, csur) = 1""",
    "open2": "SELECT * FROM pairs EXCEPT SELECT * FROM round1",
    "round2": """
        SELECT * FROM open2 WHERE rini = cini AND rsur = csur
        QUALIFY count(*) OVER (PARTITION BY doi, rini, rsur) = 1""",
    "open3": "SELECT * FROM open2 EXCEPT SELECT * FROM round2",
    "round3": """
        SELECT * FROM open3 WHERE rname = cname AND rsur = csur
        QUALIFY count(*) OVER (PARTITION BY doi, rname, rsur) = 1""",
    "open4": "SELECT * FROM open3 EXCEPT SELECT * FROM round3",
    "round4": """
        SELECT * FROM (SELECT *, trim(regexp_extract(csur, '^[^ -]+[ -](.+)$', 1)) AS second FROM open4)
        WHERE second <> '' AND rsur = second QUALIFY count(*) OVER (PARTITION BY doi, rsur, second) = 1""",
    "matched": """
        SELECT 1 AS round, *, csur AS surname FROM round1 UNION ALL SELECT 2, *, csur FROM round2
        UNION ALL SELECT 3, *, csur FROM round3
        UNION ALL SELECT 4, * EXCLUDE (second), second FROM round4""",
    "articles": f"""
        SELECT concat('e', doi) AS eid, * FROM (
          SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS doi,
                 CASE WHEN l_quantity <> 3 THEN [
                   {{'auid': l_suppkey, 'roles': [p_type, split_part(p_name, ' ', 1)]}},
                   {{'auid': o_custkey + 200000000, 'roles': [split_part(p_name, ' ', 2)]}},
                   {{'auid': CASE WHEN l_returnflag <> 'A' THEN l_partkey + 100000000 END, 'roles': [p_type]}},
                   {{'auid': CASE WHEN l_linestatus = 'F' THEN l_suppkey ELSE -1 END,
                     'roles': [split_part(p_name, ' ', 2)]}}] END AS contributions,
                 CAST(year(o_orderdate) AS INT) AS year,
                 [{_CODES}[CAST(replace(p_brand, 'Brand#', '') AS INT)], {_CODES}[p_size % 25 + 1]] AS subjareas,
                 CASE WHEN l_quantity = 2 THEN [] WHEN l_quantity <> 1 THEN [
                   {{'seq': 1, 'auid': l_suppkey, 'given': split_part(p_name, ' ', 1), 'family': split_part(p_name, ' ', 2)}},
                   {{'seq': 2, 'auid': l_partkey + 100000000, 'given': p_type,
                     'family': CASE WHEN l_partkey % 2 = 0 THEN split_part(p_name, ' ', 2) ELSE p_type END}},
                   {{'seq': 3, 'auid': o_custkey + 200000000, 'given': concat('x', split_part(p_name, ' ', 1)),
                     'family': o_orderpriority}}] END AS au,
                 o_orderstatus AS publication_type, o_orderpriority AS issn, concat('Journal ', o_custkey % 5) AS journal
          FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey)""",
    "listed": """
        SELECT * EXCLUDE (c, a), c.roles AS credit, a.seq AS position, a.auid AS auid, a.given AS name, a.family AS surname
        FROM (SELECT * EXCLUDE (contributions, au), unnest(contributions) AS c, au FROM articles)
             CROSS JOIN LATERAL unnest(au) AS u(a) WHERE c.auid = a.auid""",
    "contributions": """
        SELECT doi, CASE WHEN auid % 3 = 0 THEN left(given, 1) ELSE given END AS name,
               CASE WHEN auid % 5 = 0 THEN concat('VAN-', family)
                    WHEN auid % 7 = 0 THEN concat('XX', family) ELSE family END AS surname,
               concat_ws(', ', given, family) AS credit,
               concat(CASE WHEN auid % 13 = 0 THEN 'x' ELSE '' END, year) AS year
        FROM (SELECT doi, year, unnest(au, recursive := true) FROM articles)""",
    "by_code": "SELECT * EXCLUDE (subjareas), unnest(subjareas) AS code FROM author_role",
    "by_field": f"SELECT *, {_FIELD} AS fields FROM by_code",
    "labels_by_field": """
        SELECT DISTINCT doi, fields, trim(unnest(regexp_split_to_array(credit, ',\\s*'))) AS label FROM by_field""",
    "num_au": "SELECT doi, count(DISTINCT auid) AS v FROM by_field GROUP BY doi",
    "num_au_field": "SELECT fields, doi, count(DISTINCT auid) AS v FROM by_field GROUP BY ALL",
    "num_credit": "SELECT doi, count(DISTINCT label) AS v FROM labels_by_field GROUP BY doi",
    "num_credit_field": "SELECT fields, doi, count(DISTINCT label) AS v FROM labels_by_field GROUP BY ALL",
    "opened": "SELECT doi, unnest(credit) AS label FROM facts",
    "shares": """
        SELECT doi, subjareas, row_count, label, n, n / row_count AS share
        FROM (SELECT doi, label, count(*) AS n FROM opened GROUP BY ALL)
        JOIN (SELECT DISTINCT doi, subjareas, row_count FROM facts) USING (doi)""",
    "share_by_code": "SELECT doi, label, share, unnest(subjareas) AS subjareas FROM shares",
    "entities": """
        SELECT doi, year, subjareas, discipline, row_count, position_max, position_min, paper_credit, paper_credit_num,
               count(*) AS members, avg(au_credit_num) AS paper_au_credit_avg
        FROM facts GROUP BY ALL""",
    "means": "SELECT doi, avg(au_credit_num) AS v FROM facts GROUP BY doi",
    "bins": """
        SELECT doi, v, CASE WHEN v >= 1 AND v < 2 THEN '[1,2)' WHEN v >= 2 AND v < 3 THEN '[2,3)'
          WHEN v >= 3 AND v < 4 THEN '[3,4)' WHEN v >= 4 AND v < 5 THEN '[4,5)' WHEN v >= 5 AND v < 6 THEN '[5,6)'
          WHEN v >= 6 AND v < 7 THEN '[6,7)' WHEN v >= 7 AND v < 8 THEN '[7,8)' WHEN v >= 8 THEN '[8,14]' END AS range
        FROM means""",
    "vocab": f"SELECT * FROM (VALUES {_LABELS}) AS t(i, label)",
    "grid": "SELECT a.label AS element1, b.label AS element2 FROM vocab a JOIN vocab b ON a.i < b.i",
    "groups": f"SELECT * FROM (VALUES {_GROUPS}) AS t(discipline)",
    "grouped": "SELECT * EXCLUDE (discipline), unnest(discipline) AS discipline FROM facts",
    "indicator": """
        SELECT doi, auid, position, position2, discipline, label, CAST(list_contains(credit, label) AS INT) AS held
        FROM (SELECT *, unnest(paper_credit) AS label FROM facts)""",
    "indicator_grouped": "SELECT * EXCLUDE (discipline), unnest(discipline) AS discipline FROM indicator",
}

_NEEDS = {
    "tokens": ["author_role"],
    "members": ["tokens"],
    "bounds": ["members"],
    "entity_labels": ["members"],
    "facts": ["members", "bounds", "entity_labels"],
    "contrib": ["roster"],
    "pairs": ["roster", "contrib"],
    "round1": ["pairs"],
    "open2": ["pairs", "round1"],
    "round2": ["open2"],
    "open3": ["open2", "round2"],
    "round3": ["open3"],
    "open4": ["open3", "round3"],
    "round4": ["open4"],
    "matched": ["round1", "round2", "round3", "round4"],
    "listed": ["articles"],
    "contributions": ["articles"],
    "by_code": ["author_role"],
    "by_field": ["by_code"],
    "labels_by_field": ["by_field"],
    "num_au": ["by_field"],
    "num_au_field": ["by_field"],
    "num_credit": ["labels_by_field"],
    "num_credit_field": ["labels_by_field"],
    "opened": ["facts"],
    "shares": ["facts", "opened"],
    "share_by_code": ["shares"],
    "entities": ["facts"],
    "means": ["facts"],
    "bins": ["means"],
    "grid": ["vocab"],
    "grouped": ["facts"],
    "indicator": ["facts"],
    "indicator_grouped": ["indicator"],
}


def with_views(body: str, *views: str, extra: dict[str, str] | None = None) -> str:
    ordered: list[str] = []

    def add(view: str) -> None:
        if view not in ordered:
            for needed in _NEEDS.get(view, []):
                add(needed)
            ordered.append(view)

    for view in views:
        add(view)
    parts = {**{v: VIEWS[v] for v in ordered}, **(extra or {})}
    ctes = ",\n".join(f"{n} AS MATERIALIZED ({q})" for n, q in parts.items())
    return f"WITH {ctes}\n{body}"


def _summary(view: str, by: str = "") -> str:
    keys = f"{by}, " if by else ""
    match = "TRUE" if not by else f"m.{by} IS NOT DISTINCT FROM s.{by}"
    group = f"GROUP BY {by}" if by else ""
    over = f"PARTITION BY {by} " if by else ""
    return with_views(
        f"""SELECT s.*, m.mode FROM (
          SELECT {keys}min(v) AS min, quantile_disc(v, 0.25) AS q1, quantile_disc(v, 0.5) AS median,
                 round(avg(v), 6) AS mean, quantile_disc(v, 0.75) AS q3, max(v) AS max, round(stddev_samp(v), 6) AS sd
          FROM {view} {group}) s
        JOIN (SELECT {keys}v AS mode FROM (SELECT {keys}v, count(*) AS n FROM {view} GROUP BY ALL)
              QUALIFY row_number() OVER ({over}ORDER BY n DESC, v) = 1) m ON {match}""",
        view,
    )


def _round(number: int) -> str:
    surname = "second" if number == 4 else "csur"
    return with_views(
        f"""SELECT doi, auid, rname AS name_roster, rsur AS surname_roster, cname AS name_contributor,
                   {surname} AS surname FROM round{number}""",
        f"round{number}",
    )


def _cooccurrence(by: str = "") -> str:
    source, grid = ("grouped", "grid CROSS JOIN groups") if by else ("facts", "grid")
    on = "AND g.discipline = f.discipline" if by else ""
    keys = "g.discipline, " if by else ""
    columns = "discipline, element1, element2" if by else "element1, element2"
    return with_views(
        f"""SELECT {columns}, "either", "both", round("both" / nullif("either", 0), 6) AS ratio FROM (
          SELECT {keys}element1, element2,
                 count(*) FILTER (list_contains(credit, element1) OR list_contains(credit, element2)) AS "either",
                 count(*) FILTER (list_contains(credit, element1) AND list_contains(credit, element2)) AS "both"
          FROM (SELECT * FROM {grid}) g LEFT JOIN {source} f ON TRUE {on} GROUP BY ALL)""",
        source, "grid", "groups",
    )


def _tail(chi2: str, terms: str) -> str:
    """Even degrees of freedom: exp(-x/2) * sum of (x/2)^k / k! for k < terms."""
    return f"""list_sum(list_transform(range(0, CAST({terms} AS BIGINT)),
        lambda k: exp(-{chi2} / 2) * pow({chi2} / 2, k) / gamma(k + 1)))"""


def _chi2(source: str, rows: str, cols: str, by: str = "", where: str = "TRUE") -> str:
    keys = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    over = f"PARTITION BY {by}" if by else ""
    using = f"USING ({by})" if by else "ON TRUE"
    extra = {
        "cells": f"SELECT {keys}{rows} AS r, {cols} AS c, count(*) AS n FROM {source} WHERE {where} GROUP BY ALL",
        "rs": f"SELECT DISTINCT {keys}r FROM cells",
        "cs": f"SELECT DISTINCT {keys}c FROM cells",
        "full_cells": f"""SELECT {keys}r, c, coalesce(n, 0) AS n FROM rs JOIN cs {using}
            LEFT JOIN cells USING ({keys}r, c)""",
        "tested": f"""SELECT *, sum(n) OVER ({over}{',' if by else 'PARTITION BY'} r)
              * sum(n) OVER ({over}{',' if by else 'PARTITION BY'} c) / sum(n) OVER ({over}) AS e FROM full_cells""",
        "stats": f"""SELECT {keys}sum(pow(n - e, 2) / e) AS chi2,
            (count(DISTINCT r) - 1) * (count(DISTINCT c) - 1) AS dof FROM tested {group}""",
    }
    return with_views(
        f"""SELECT {keys}round(CASE WHEN dof > 0 THEN chi2 END, 6) AS chi2, CAST(dof AS INT) AS dof,
                   round(CASE WHEN dof > 0 THEN {_tail('chi2', 'dof // 2')} END, 6) AS p_value FROM stats""",
        source,
        extra=extra,
    )


ORACLE: dict[str, str] = {
    "a2_csv": with_views("SELECT * FROM contributions", "contributions"),
    "a3_filter": with_views(
        """SELECT eid AS "Eid", year AS "Year", publication_type FROM articles
           WHERE publication_type = 'P' AND year IN (1996, 1997, 1998, 1999)""",
        "articles",
    ),
    "a4_explode_matched": with_views(
        f"""SELECT eid AS "Eid", auid, position, {_text('credit', 'credit')} FROM listed""", "listed"
    ),
    "a5_structured": with_views(
        f"""SELECT eid, auid, name, surname, position, {_text('credit', 'credit')}, year, aunum
            FROM listed JOIN (SELECT doi, count(DISTINCT auid) AS aunum FROM listed GROUP BY doi) USING (doi)
            WHERE publication_type = 'P' AND year IN (1996, 1997, 1998, 1999)""",
        "listed",
    ),
    "a6_explode_outer": with_views(
        """SELECT eid, a.auid AS auid, a.given AS name, a.family AS surname, a.seq AS position
           FROM (SELECT eid, unnest(CASE WHEN au IS NULL OR len(au) = 0 THEN [NULL] ELSE au END) AS a
                 FROM articles WHERE publication_type = 'P')""",
        "articles",
    ),
    "a7_attach_count": with_views(
        """SELECT roster.*, surnames FROM roster
           LEFT JOIN (SELECT doi, count(DISTINCT surname) AS surnames FROM roster GROUP BY doi) USING (doi)""",
        "roster",
    ),
    "a9_union": with_views(
        """SELECT doi, year, auid, array_to_string(credit, ', ') AS credit FROM listed
           UNION ALL SELECT doi, TRY_CAST(year AS INT), NULL, credit FROM contributions""",
        "listed", "contributions",
    ),
    "a9_prefer_source": with_views(
        """SELECT * FROM contributions WHERE doi NOT IN (
             SELECT doi FROM listed WHERE publication_type = 'P' AND year IN (1996, 1997, 1998, 1999))""",
        "listed", "contributions",
    ),
    "curated": with_views(
        f"""SELECT eid, auid, name, surname, position, array_to_string(credit, ', ') AS credit, year,
                   {_text('subjareas', 'subjareas')}, publication_type, doi, issn, journal, aunum
            FROM listed JOIN (SELECT doi, count(DISTINCT auid) AS aunum FROM listed GROUP BY doi) USING (doi)
            WHERE publication_type = 'P' AND year IN (1996, 1997, 1998, 1999)
            UNION ALL
            SELECT eid, auid, cname, surname, position, credit, TRY_CAST(year AS INT), {_text('subjareas', 'subjareas')},
                   publication_type, doi, issn, journal, aunum
            FROM linked JOIN (SELECT doi, count(DISTINCT auid) AS aunum FROM linked GROUP BY doi) USING (doi)
                 JOIN (SELECT doi, count(DISTINCT concat_ws(' ', name, surname)) AS expected
                       FROM contributions GROUP BY doi) USING (doi)
            WHERE aunum = expected""",
        "listed", "contributions",
        extra={
            "flat": """
              SELECT eid, doi, subjareas, publication_type, issn, journal, a.auid AS auid, a.seq AS position,
                     upper(a.given) AS rname, upper(a.family) AS rsur, upper(left(a.given, 1)) AS rini
              FROM (SELECT *, unnest(au) AS a FROM articles WHERE publication_type = 'P')""",
            "said": """
              SELECT doi, credit, year, upper(name) AS cname, upper(surname) AS csur, upper(left(name, 1)) AS cini
              FROM contributions""",
            "p1": "SELECT * FROM flat JOIN said USING (doi)",
            "r1": "SELECT * FROM p1 WHERE rsur = csur QUALIFY count(*) OVER (PARTITION BY doi, rsur) = 1",
            "p2": "SELECT * FROM p1 EXCEPT SELECT * FROM r1",
            "r2": """SELECT * FROM p2 WHERE rini = cini AND rsur = csur
                     QUALIFY count(*) OVER (PARTITION BY doi, rini, rsur) = 1""",
            "p3": "SELECT * FROM p2 EXCEPT SELECT * FROM r2",
            "r3": """SELECT * FROM p3 WHERE rname = cname AND rsur = csur
                     QUALIFY count(*) OVER (PARTITION BY doi, rname, rsur) = 1""",
            "p4": "SELECT * FROM p3 EXCEPT SELECT * FROM r3",
            "r4": """SELECT * FROM (SELECT *, trim(regexp_extract(csur, '^[^ -]+[ -](.+)$', 1)) AS surname FROM p4)
                     WHERE surname <> '' AND rsur = surname QUALIFY count(*) OVER (PARTITION BY doi, rsur) = 1""",
            "linked": """SELECT *, csur AS surname FROM r1 UNION ALL SELECT *, csur FROM r2
                         UNION ALL SELECT *, csur FROM r3 UNION ALL SELECT * FROM r4""",
        },
    ),
    "b1_keys": with_views(
        """SELECT doi, concat_ws(' ', name, surname) AS author_id, upper(name) AS name, upper(surname) AS surname,
                  upper(left(name, 1)) AS initial FROM contrib WHERE surname IS NOT NULL""",
        "contrib",
    ),
    "b2_pairs": with_views("SELECT doi, CAST(count(*) AS DECIMAL(38, 0)) AS pairs FROM pairs GROUP BY doi", "pairs"),
    "b2_pairs_surname": with_views(
        """SELECT doi, csur AS surname, CAST(count(*) AS DECIMAL(38, 0)) AS pairs FROM pairs WHERE rsur = csur
           GROUP BY ALL""",
        "pairs",
    ),
    "b3_round1": _round(1),
    "b4_residual": with_views(
        """SELECT doi, CAST(coalesce(n, 0) AS DECIMAL(38, 0)) AS pairs FROM (SELECT DISTINCT doi FROM pairs)
           LEFT JOIN (SELECT doi, count(*) AS n FROM open2 GROUP BY doi) USING (doi)""",
        "open2",
    ),
    "b4_unresolved": with_views(
        """SELECT 'roster' AS side, doi, auid, upper(name) AS name, upper(surname) AS surname,
             CASE WHEN EXISTS (SELECT 1 FROM contrib AS c WHERE c.doi = r.doi AND upper(c.surname) = upper(r.surname))
                  THEN 'ambiguous' ELSE 'no candidate' END AS reason
           FROM roster AS r WHERE surname IS NOT NULL AND NOT EXISTS (
             SELECT 1 FROM matched AS m WHERE m.doi = r.doi AND m.auid IS NOT DISTINCT FROM r.auid
               AND m.rname IS NOT DISTINCT FROM upper(r.name) AND m.rsur = upper(r.surname))
           UNION ALL
           SELECT DISTINCT 'contributor', doi, NULL, upper(name), upper(surname),
             CASE WHEN EXISTS (SELECT 1 FROM roster AS r WHERE r.doi = c.doi AND upper(r.surname) = upper(c.surname))
                  THEN 'ambiguous' ELSE 'no candidate' END
           FROM contrib AS c WHERE surname IS NOT NULL AND NOT EXISTS (
             SELECT 1 FROM matched AS m WHERE m.doi = c.doi AND m.cname IS NOT DISTINCT FROM upper(c.name)
               AND m.csur = upper(c.surname))""",
        "matched", "roster", "contrib",
    ),
    "b5_round2": _round(2),
    "b6_round3": _round(3),
    "b7_split": with_views(
        """SELECT * FROM (
             SELECT *, trim(regexp_extract(surname, '^([^ -]+)', 1)) AS first_surname,
                    trim(regexp_extract(surname, '^[^ -]+[ -](.+)$', 1)) AS second_surname FROM contrib)
           WHERE second_surname <> ''""",
        "contrib",
    ),
    "b8_round4": _round(4),
    "b9_stack": with_views("SELECT doi, round, auid, cname AS name_contributor, surname FROM matched", "matched"),
    "b10_complete": with_views(
        """SELECT doi, auid, cname AS name_contributor, surname, aunum
           FROM matched JOIN (SELECT doi, count(DISTINCT auid) AS aunum FROM matched GROUP BY doi) USING (doi)
           JOIN (SELECT doi, count(DISTINCT concat_ws(' ', name, surname)) AS expected FROM contrib GROUP BY doi)
             USING (doi)
           WHERE aunum = expected""",
        "matched",
    ),
    "c1_assign_group": with_views(
        "SELECT doi, auid, position, year, code AS subjarea, fields FROM by_field", "by_field"
    ),
    "c2_groups": with_views(
        f"SELECT doi, auid, position, array_to_string({_DISCIPLINE}, '|') AS discipline FROM author_role",
        "author_role",
    ),
    "d1_year": with_views(
        "SELECT year, count(DISTINCT doi) AS unique_dois FROM by_field GROUP BY year", "by_field"
    ),
    "d2_year_group": with_views(
        "SELECT year, fields, count(DISTINCT doi) AS unique_dois FROM by_field GROUP BY ALL", "by_field"
    ),
    "d3_year_category": with_views(
        "SELECT year, code AS subjarea, count(DISTINCT doi) AS unique_dois FROM by_field GROUP BY ALL", "by_field"
    ),
    "d4_source_year": with_views(
        """SELECT issn, journal, year, count(DISTINCT doi) AS unique_doi_count
           FROM (SELECT *, unnest(subjareas) AS code FROM listed
                 WHERE publication_type = 'P' AND year IN (1996, 1997, 1998, 1999)) GROUP BY issn, journal, year""",
        "listed",
    ),
    "d5_members": with_views("SELECT doi, v AS num_au FROM num_au", "num_au"),
    "d6_members_group": with_views("SELECT fields, doi, v AS num_au FROM num_au_field", "num_au_field"),
    "d7_labels": with_views("SELECT doi, v AS num_credit FROM num_credit", "num_credit"),
    "d7_labels_allowed": with_views(
        f"""SELECT doi, count(DISTINCT canonical) AS num_credit
            FROM (SELECT doi, CASE label {_CANONICAL} ELSE label END AS canonical FROM labels_by_field)
            WHERE canonical IN ({_VOCAB}) GROUP BY doi""",
        "labels_by_field",
    ),
    "d8_labels_group": with_views("SELECT fields, doi, v AS num_credit FROM num_credit_field", "num_credit_field"),
    "d9_summary_members": _summary("num_au"),
    "d9_summary_labels": _summary("num_credit"),
    "d9_summary_members_exact": _summary("num_au"),
    "d10_summary_group_members": _summary("num_au_field", "fields"),
    "d10_summary_group_labels": _summary("num_credit_field", "fields"),
    "d10_summary_group_labels_exact": _summary("num_credit_field", "fields"),
    "d11_mode": with_views(
        "SELECT v AS mode FROM num_credit GROUP BY v ORDER BY count(*) DESC, v LIMIT 1", "num_credit"
    ),
    "d12_mode_group": with_views(
        """SELECT fields, v AS mode FROM (SELECT fields, v, count(*) AS n FROM num_au_field GROUP BY ALL)
           QUALIFY row_number() OVER (PARTITION BY fields ORDER BY n DESC, v) = 1""",
        "num_au_field",
    ),
    "e1_facts": with_views(
        f"""SELECT doi, year, {_text('subjareas', 'subjareas')}, aunum, auid, surname, position, label, n
            FROM (SELECT *, count(*) AS n FROM tokens GROUP BY ALL)""",
        "tokens",
    ),
    "e2_row_count": with_views(
        "SELECT doi, auid, position, row_count FROM members JOIN bounds USING (doi)", "members", "bounds"
    ),
    "e3_bounds": with_views(
        "SELECT doi, auid, position, position_max, position_min FROM members JOIN bounds USING (doi)",
        "members", "bounds",
    ),
    "e4_canonical": with_views(
        f"""SELECT doi, auid, position, {_text(f'''list_transform(string_split(credit, ', '),
              lambda x: CASE x {_CANONICAL} ELSE x END)''', 'credit')} FROM author_role""",
        "author_role",
    ),
    "e5_allowed": with_views(
        f"""SELECT doi, auid, position, {_text(f'''list_filter(list_transform(string_split(credit, ', '),
              lambda x: CASE x {_CANONICAL} ELSE x END), lambda x: x IN ({_VOCAB}))''', 'credit')} FROM author_role""",
        "author_role",
    ),
    "e6_nonempty": with_views(
        f"SELECT doi, year, auid, surname, position, {_text('credit', 'credit')} FROM facts", "facts"
    ),
    "e8_label_count": with_views(
        f"""SELECT doi, auid, position, {_text('labels', 'credit')}, CAST(len(labels) AS INT) AS au_credit_num
            FROM (SELECT doi, auid, position,
                    list_distinct(list_filter(list_transform(string_split(credit, ', '),
                      lambda x: CASE x {_CANONICAL} ELSE x END), lambda x: x IN ({_VOCAB}))) AS labels
                  FROM author_role)""",
        "author_role",
    ),
    "e9_entity_labels": with_views(
        f"""SELECT doi, year, auid, position, au_credit_num, {_text('paper_credit', 'paper_credit')}, paper_credit_num
            FROM facts""",
        "facts",
    ),
    "f1_share": with_views(
        f"""SELECT doi, {_text('subjareas', 'subjareas')}, row_count, label, n, round(share, 6) AS share FROM shares""",
        "shares",
    ),
    "f2_mean_share": with_views(
        "SELECT subjareas, label, round(avg(share), 6) AS mean_share FROM share_by_code GROUP BY ALL",
        "share_by_code",
    ),
    "f2_mean_share_zero_fill": with_views(
        """SELECT subjareas, label, round(sum(share) / max(entities), 6) AS mean_share FROM share_by_code
           JOIN (SELECT subjareas, count(DISTINCT doi) AS entities FROM share_by_code GROUP BY ALL) USING (subjareas)
           GROUP BY ALL""",
        "share_by_code",
    ),
    "f3_mean_labels": with_views("SELECT doi, round(v, 6) AS paper_au_credit_avg FROM means", "means"),
    "f4_entities": with_views(
        f"""SELECT doi, year, {_text('subjareas', 'subjareas')}, {_text('discipline', 'discipline')}, row_count,
                   position_max, position_min, {_text('paper_credit', 'paper_credit')}, paper_credit_num, members,
                   round(paper_au_credit_avg, 6) AS paper_au_credit_avg FROM entities""",
        "entities",
    ),
    "f5_group_count": with_views(
        "SELECT discipline, count(*) AS n FROM (SELECT unnest(discipline) AS discipline FROM entities) GROUP BY ALL",
        "entities",
    ),
    "f6_bins": with_views("SELECT doi, range FROM bins", "bins"),
    "f7_bin_share": with_views(
        """SELECT discipline, range, n, round(n / sum(n) OVER (PARTITION BY discipline), 6) AS share
           FROM (SELECT discipline, range, count(*) AS n
                 FROM (SELECT doi, unnest(discipline) AS discipline FROM entities) JOIN bins USING (doi) GROUP BY ALL)""",
        "entities", "bins",
    ),
    "f8_cooccur": _cooccurrence(),
    "f9_cooccur_group": _cooccurrence("discipline"),
    "f10_position": with_views("SELECT doi, auid, position, position2 FROM facts", "facts"),
    "f11_position_count": with_views("SELECT position2, count(*) AS n FROM facts GROUP BY ALL", "facts"),
    "f12_position_group": with_views(
        "SELECT discipline, position2, count(*) AS n FROM grouped GROUP BY ALL", "grouped"
    ),
    "f13_rate": with_views(
        """SELECT position2, label, n, round(n / total, 6) AS rate
           FROM (SELECT position2, label, count(*) AS n
                 FROM (SELECT position2, unnest(credit) AS label FROM facts) GROUP BY ALL)
           JOIN (SELECT position2, count(*) AS total FROM facts GROUP BY ALL) USING (position2)""",
        "facts",
    ),
    "f14_rate_group": with_views(
        """SELECT discipline, position2, label, n, round(n / total, 6) AS rate
           FROM (SELECT discipline, position2, label, count(*) AS n
                 FROM (SELECT discipline, position2, unnest(credit) AS label FROM grouped) GROUP BY ALL)
           JOIN (SELECT discipline, position2, count(*) AS total FROM grouped GROUP BY ALL) USING (discipline, position2)""",
        "grouped",
    ),
    "g1_participation": with_views(
        "SELECT doi, auid, position, position2, label, held FROM indicator", "indicator"
    ),
    "g2_contingency": with_views(
        """SELECT position2, label, coalesce(n, 0) AS n
           FROM (SELECT DISTINCT position2 FROM indicator WHERE held = 1)
           CROSS JOIN (SELECT DISTINCT label FROM indicator WHERE held = 1)
           LEFT JOIN (SELECT position2, label, count(*) AS n FROM indicator WHERE held = 1 GROUP BY ALL)
             USING (position2, label)""",
        "indicator",
    ),
    "g3_expected": with_views(
        """SELECT position2, label, n, round(sum(n) OVER (PARTITION BY position2) * sum(n) OVER (PARTITION BY label)
                  / sum(n) OVER (), 6) AS expected
           FROM (SELECT position2, label, coalesce(n, 0) AS n
                 FROM (SELECT DISTINCT position2 FROM indicator WHERE held = 1)
                 CROSS JOIN (SELECT DISTINCT label FROM indicator WHERE held = 1)
                 LEFT JOIN (SELECT position2, label, count(*) AS n FROM indicator WHERE held = 1 GROUP BY ALL)
                   USING (position2, label))""",
        "indicator",
    ),
    "g4_chi2": _chi2("indicator", "position2", "label", where="held = 1"),
    "g5_chi2_label": _chi2("indicator", "held", "position2", "label"),
    "g6_chi2_group": _chi2("indicator_grouped", "position2", "label", "discipline", "held = 1"),
    "g7_chi2_group_label": _chi2("indicator_grouped", "held", "position2", "discipline, label"),
}
# What was written and read again is the table itself.
ORACLE["a8_curated_round_trip"] = ORACLE["curated"]
for _query in ("e2_row_count", "f2_mean_share", "f7_bin_share", "f13_rate"):
    ORACLE[f"{_query}_stored"] = ORACLE[_query]


def _scopes(overall: str, grouped: str, group: str) -> str:
    """The rows of two queries, with the group or 'All' in a column ``scope``."""
    return (
        f"SELECT {sql.literal(OVERALL)} AS scope, * FROM ({ORACLE[overall]})"
        f" UNION ALL BY NAME SELECT * RENAME ({group} AS scope) FROM ({ORACLE[grouped]})"
    )


ORACLE["f8_f9_cooccur_scopes"] = _scopes("f8_cooccur", "f9_cooccur_group", "discipline")
ORACLE["f11_f12_position_scopes"] = _scopes("f11_position_count", "f12_position_group", "discipline")
ORACLE["f13_f14_rate_scopes"] = _scopes("f13_rate", "f14_rate_group", "discipline")
ORACLE["g4_g6_chi2_scopes"] = _scopes("g4_chi2", "g6_chi2_group", "discipline")
ORACLE["d9_d10_summary_members_scopes"] = _scopes("d9_summary_members", "d10_summary_group_members", "fields")
