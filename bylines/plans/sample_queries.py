"""One query per operator on the sample tables; lists are compared as joined text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bylines.functions import groups as G
from bylines.functions import labels as L
from bylines.functions.bins import bin_of
from bylines.functions.names import first_part, full_name
from bylines.operators import counts as D
from bylines.operators import flatten as A
from bylines.operators import linkage as B
from bylines.operators import metrics as M
from bylines.operators.cooccurrence import cooccurrence
from bylines.operators.facts import drop_empty, label_counts, with_position_class
from bylines.operators.independence import chi_square_position, contingency, participation, with_expected
from bylines.operators.joins import attach_distinct_count, distinct_members
from bylines.plans import sample_views as V
from bylines.plans.curate import curated_table, roster, structured_roles
from bylines.sources import fact_table, tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

TYPES = ("P",)
YEARS = (1996, 1997, 1998, 1999)


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def text(labels: str, alias: str | None = None) -> str:
    return f"array_join(array_sort({labels}), '|') AS {alias or labels}"


def as_text(df: DataFrame, *names: str) -> DataFrame:
    return df.selectExpr(*[text(c) if c in names else c for c in df.columns])


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.selectExpr(*[f"round({c}, 6) AS {c}" if c in names else c for c in df.columns])


ALLOWED = L.allowed_labels(L.canonical_labels(L.split_labels("credit"), V.ALIASES), V.VOCAB)


# Sources, flattening, sinks


@query
def a2_csv(spark, sf_dir):
    path = tables.scratch_path(spark, "contributions")
    tables.write_contributions_csv(V.contributions(spark, sf_dir), path)
    return tables.read_contributions_csv(spark, path)


@query
def a3_filter(spark, sf_dir):
    kept = A.filter_articles(V.articles(spark, sf_dir), TYPES, YEARS, year_col="Year")
    return kept.select("Eid", "Year", "publication_type")


@query
def a4_explode_matched(spark, sf_dir):
    pairs = A.explode_matched(V.articles(spark, sf_dir), "contributions", "Au", "auid")
    fields = {"contributions": {"CRediT_mapping": "credit"}, "Au": {"Authorseq": "position", "auid": "auid"}}
    return A.flatten_member(pairs, fields).selectExpr("Eid", "auid", "position", text("credit"))


@query
def a5_structured(spark, sf_dir):
    rows = structured_roles(V.articles(spark, sf_dir), TYPES, YEARS)
    return rows.selectExpr("eid", "auid", "name", "surname", "position", text("credit"), "year", "aunum")


@query
def a6_explode_outer(spark, sf_dir):
    return roster(V.articles(spark, sf_dir), TYPES).select("eid", "auid", "name", "surname", "position")


@query
def a7_attach_count(spark, sf_dir):
    rows = V.roster(spark, sf_dir)
    return attach_distinct_count(rows, "doi", "surname", "surnames")


def _curated(spark, sf_dir):
    articles = V.articles(spark, sf_dir)
    parts = V.parts_of_lines(spark, sf_dir, V.LINES // 3)  # each line has up to three authors
    return curated_table(articles, articles, V.contributions(spark, sf_dir), TYPES, YEARS, parts=parts)


def _flat(rows):
    return rows.selectExpr(
        "eid", "auid", "name", "surname", "position", "credit", "year", text("subjareas"),
        "publication_type", "doi", "issn", "source.sourcetitle AS journal", "aunum",
    )


@query
def a8_curated_round_trip(spark, sf_dir):
    path = tables.scratch_path(spark, "curated")
    tables.write_curated(_curated(spark, sf_dir), path)
    return _flat(tables.read_curated(spark, path))


@query
def a9_union(spark, sf_dir):
    listed = A.explode_matched(V.articles(spark, sf_dir), "contributions", "Au", "auid").selectExpr(
        "doi", "Year AS year", "Au.auid", "contributions.CRediT_mapping AS credit"
    )
    joined = V.contributions(spark, sf_dir).selectExpr("doi", "year", "CAST(NULL AS BIGINT) AS auid", "credit")
    return A.unify_sources(listed, joined, casts={"year": "int"})


@query
def a9_prefer_source(spark, sf_dir):
    listed = structured_roles(V.articles(spark, sf_dir), TYPES, YEARS)
    return A.prefer_source(listed, V.contributions(spark, sf_dir))


@query
def curated(spark, sf_dir):
    return _flat(_curated(spark, sf_dir))


# Linkage


def _linked(spark, sf_dir, rounds):
    parts = V.parts_of_lines(spark, sf_dir, V.LINES)
    return B.link_members(V.roster(spark, sf_dir), V.contrib(spark, sf_dir), rounds=rounds, parts=parts)


def _round(spark, sf_dir, number):
    return (
        _linked(spark, sf_dir, number)
        .filter(f"round = {number}")
        .select("doi", "auid", "name_roster", "surname_roster", "name_contributor", "surname")
    )


@query
def b1_keys(spark, sf_dir):
    rows = V.contrib(spark, sf_dir).selectExpr("*", f"{full_name('name', 'surname')} AS author_id")
    return B.match_keys(rows, "name", "surname")


@query
def b2_pairs(spark, sf_dir):
    return B.candidate_counts(V.roster(spark, sf_dir), V.contrib(spark, sf_dir), ["doi"])


@query
def b2_pairs_surname(spark, sf_dir):
    return B.candidate_counts(V.roster(spark, sf_dir), V.contrib(spark, sf_dir), ["doi", "surname"])


@query
def b3_round1(spark, sf_dir):
    return _round(spark, sf_dir, 1)


@query
def b4_residual(spark, sf_dir):
    left = B.match_keys(V.roster(spark, sf_dir), "name", "surname")
    right = B.match_keys(V.contrib(spark, sf_dir), "name", "surname")
    return B.residual_counts(left, right, _linked(spark, sf_dir, 1), "doi")


@query
def b4_unresolved(spark, sf_dir):
    roster, said = V.roster(spark, sf_dir), V.contrib(spark, sf_dir)
    members, contributors = B.unresolved(roster, said, parts=V.parts_of_lines(spark, sf_dir, V.LINES))
    sides = [
        rows.selectExpr(
            f"'{side}' AS side", "doi", auid, f"name_{side} AS name", f"surname_{side} AS surname", "reason"
        )
        for side, rows, auid in (("roster", members, "auid"), ("contributor", contributors, "NULL AS auid"))
    ]
    return sides[0].unionByName(sides[1])


@query
def b5_round2(spark, sf_dir):
    return _round(spark, sf_dir, 2)


@query
def b6_round3(spark, sf_dir):
    return _round(spark, sf_dir, 3)


@query
def b7_split(spark, sf_dir):
    rows = B.split_surname(V.contrib(spark, sf_dir), "surname")
    return rows.selectExpr("doi", "name", "surname", f"{first_part('surname')} AS first_surname", "second_surname")


@query
def b8_round4(spark, sf_dir):
    return _round(spark, sf_dir, 4)


@query
def b9_stack(spark, sf_dir):
    return _linked(spark, sf_dir, 4).select("doi", "round", "auid", "name_contributor", "surname")


@query
def b10_complete(spark, sf_dir):
    author = full_name("name", "surname")
    expected = distinct_members(V.contrib(spark, sf_dir), "doi", author, "expected")
    complete = B.complete_entities(_linked(spark, sf_dir, 4), expected, "doi", "auid", "expected")
    return complete.select("doi", "auid", "name_contributor", "surname", "aunum")


# Classification


def _by_code(spark, sf_dir):
    rows = V.author_role(spark, sf_dir)
    return rows.selectExpr("doi", "auid", "position", "year", "explode(subjareas) AS subjarea")


FIELDS = {"fields": G.default_groups_of("subjareas")}


def _coded(spark, sf_dir):
    return V.author_role(spark, sf_dir).filter("size(subjareas) > 0")


@query
def c1_assign_group(spark, sf_dir):
    return _by_code(spark, sf_dir).selectExpr("*", f"{G.group_of('subjarea')} AS fields")


@query
def c2_groups(spark, sf_dir):
    rows = V.author_role(spark, sf_dir)
    groups = f"array_join({G.groups_of('subjareas')}, '|') AS discipline"
    return rows.selectExpr("doi", "auid", "position", groups)


# Counts and distributions


@query
def d1_year(spark, sf_dir):
    return D.distinct_by(_coded(spark, sf_dir), ["year"], "doi", "unique_dois")


@query
def d2_year_group(spark, sf_dir):
    return D.distinct_by(V.author_role(spark, sf_dir), ["year"], "doi", "unique_dois", FIELDS)


@query
def d3_year_category(spark, sf_dir):
    return D.distinct_by(_by_code(spark, sf_dir), ["year", "subjarea"], "doi", "unique_dois")


@query
def d4_source_year(spark, sf_dir):
    rows = structured_roles(V.articles(spark, sf_dir), TYPES, YEARS)
    rows = rows.selectExpr("issn", "source.sourcetitle AS journal", "year", "doi", "explode(subjareas) AS subjarea")
    return D.distinct_by(rows, ["issn", "journal", "year"], "doi", "unique_doi_count")


def _members(spark, sf_dir):
    return D.size_per(_coded(spark, sf_dir), "doi", "auid", "num_au")


def _members_by_field(spark, sf_dir):
    return D.size_per(V.author_role(spark, sf_dir), "doi", "auid", "num_au", multi=FIELDS)


def _labels(spark, sf_dir):
    return D.labels_per(_coded(spark, sf_dir), "doi", "credit", "num_credit")


def _labels_by_field(spark, sf_dir):
    return D.labels_per(V.author_role(spark, sf_dir), "doi", "credit", "num_credit", multi=FIELDS)


@query
def d5_members(spark, sf_dir):
    return _members(spark, sf_dir)


@query
def d6_members_group(spark, sf_dir):
    return _members_by_field(spark, sf_dir)


@query
def d7_labels(spark, sf_dir):
    return _labels(spark, sf_dir)


@query
def d7_labels_allowed(spark, sf_dir):
    rows = _coded(spark, sf_dir)
    return D.labels_per(rows, "doi", "credit", "num_credit", vocab=V.VOCAB, aliases=V.ALIASES)


@query
def d8_labels_group(spark, sf_dir):
    return _labels_by_field(spark, sf_dir)


@query
def d9_summary_members(spark, sf_dir):
    return rounded(D.summarise(_members(spark, sf_dir), "num_au"), "mean", "sd")


@query
def d9_summary_labels(spark, sf_dir):
    return rounded(D.summarise(_labels(spark, sf_dir), "num_credit"), "mean", "sd")


@query
def d9_summary_members_exact(spark, sf_dir):
    return rounded(D.summarise(_members(spark, sf_dir), "num_au", exact=True), "mean", "sd")


@query
def d10_summary_group_members(spark, sf_dir):
    return rounded(D.summarise(_members_by_field(spark, sf_dir), "num_au", ["fields"]), "mean", "sd")


@query
def d10_summary_group_labels(spark, sf_dir):
    return rounded(D.summarise(_labels_by_field(spark, sf_dir), "num_credit", ["fields"]), "mean", "sd")


@query
def d10_summary_group_labels_exact(spark, sf_dir):
    summary = D.summarise(_labels_by_field(spark, sf_dir), "num_credit", ["fields"], exact=True)
    return rounded(summary, "mean", "sd")


@query
def d11_mode(spark, sf_dir):
    return D.mode(_labels(spark, sf_dir), "num_credit")


@query
def d12_mode_group(spark, sf_dir):
    return D.mode(_members_by_field(spark, sf_dir), "num_au", ["fields"])


# Facts


@query
def e1_facts(spark, sf_dir):
    return as_text(label_counts(V.author_role(spark, sf_dir)), "subjareas")


@query
def e2_row_count(spark, sf_dir):
    return V.facts(spark, sf_dir, keep_empty=True).select("doi", "auid", "position", "row_count")


@query
def e3_bounds(spark, sf_dir):
    rows = V.facts(spark, sf_dir, keep_empty=True)
    return rows.select("doi", "auid", "position", "position_max", "position_min")


@query
def e4_canonical(spark, sf_dir):
    rows = V.author_role(spark, sf_dir)
    labels = L.canonical_labels(L.split_labels("credit"), V.ALIASES)
    return rows.selectExpr("doi", "auid", "position", text(labels, "credit"))


@query
def e5_allowed(spark, sf_dir):
    rows = V.author_role(spark, sf_dir)
    return rows.selectExpr("doi", "auid", "position", text(ALLOWED, "credit"))


@query
def e6_nonempty(spark, sf_dir):
    rows = drop_empty(V.facts(spark, sf_dir, keep_empty=True))
    return rows.selectExpr("doi", "year", "auid", "surname", "position", text("credit"))


@query
def e8_label_count(spark, sf_dir):
    rows = V.author_role(spark, sf_dir)
    unique = L.unique_labels(ALLOWED)
    return rows.selectExpr("doi", "auid", "position", text(unique, "credit"), f"size({unique}) AS au_credit_num")


@query
def e9_entity_labels(spark, sf_dir):
    rows = V.facts(spark, sf_dir)
    return rows.selectExpr(
        "doi", "year", "auid", "position", "au_credit_num", text("paper_credit"), "paper_credit_num"
    )


# The same from facts that were written to a table

TABLE_BUCKETS = 8  # at least
LINES_PER_BUCKET = 500_000


def stored_facts(spark, sf_dir):
    """The facts of all members, with position class, written and read again."""
    path = tables.scratch_path(spark, "facts")
    table = path.rsplit("/", 1)[1].replace("-", "_")
    buckets = max(TABLE_BUCKETS, V.parts_of_lines(spark, sf_dir, LINES_PER_BUCKET))
    # Laid out for the table when members meet the values of their paper, so they are shuffled once for both.
    layout = {"place": fact_table.place_of("doi", buckets), "parts": buckets, "salts": fact_table.WRITERS}
    rows = with_position_class(V.facts(spark, sf_dir, keep_empty=True, **layout))
    fact_table.write_facts(rows, table, path, buckets=buckets, dealt=True)
    return fact_table.read_facts(spark, table, path, buckets=buckets)


@query
def e2_row_count_stored(spark, sf_dir):
    return stored_facts(spark, sf_dir).select("doi", "auid", "position", "row_count")


@query
def f2_mean_share_stored(spark, sf_dir):
    share = M.label_share(drop_empty(stored_facts(spark, sf_dir)))
    return rounded(M.mean_share(share), "mean_share")


@query
def f7_bin_share_stored(spark, sf_dir):
    return rounded(M.bin_share(M.to_entities(drop_empty(stored_facts(spark, sf_dir)))), "share")


@query
def f13_rate_stored(spark, sf_dir):
    return rounded(M.label_rate(drop_empty(stored_facts(spark, sf_dir))), "rate")


# Role metrics


@query
def f1_share(spark, sf_dir):
    share = M.label_share(V.facts(spark, sf_dir))
    return rounded(as_text(share, "subjareas"), "share")


@query
def f2_mean_share(spark, sf_dir):
    share = M.label_share(V.facts(spark, sf_dir))
    return rounded(M.mean_share(share), "mean_share")


@query
def f2_mean_share_zero_fill(spark, sf_dir):
    share = M.label_share(V.facts(spark, sf_dir))
    return rounded(M.mean_share(share, zero_fill=True), "mean_share")


@query
def f3_mean_labels(spark, sf_dir):
    return rounded(M.mean_labels(V.members(spark, sf_dir)), "paper_au_credit_avg")


@query
def f4_entities(spark, sf_dir):
    rows = M.to_entities(V.facts(spark, sf_dir))
    return rounded(as_text(rows, "subjareas", "discipline", "paper_credit"), "paper_au_credit_avg")


@query
def f5_group_count(spark, sf_dir):
    return M.count_by_group(M.to_entities(V.facts(spark, sf_dir)))


@query
def f6_bins(spark, sf_dir):
    rows = M.mean_labels(V.members(spark, sf_dir))
    return rows.selectExpr("doi", f"{bin_of('paper_au_credit_avg')} AS range")


@query
def f7_bin_share(spark, sf_dir):
    return rounded(M.bin_share(M.to_entities(V.facts(spark, sf_dir))), "share")


@query
def f8_cooccur(spark, sf_dir):
    return rounded(cooccurrence(V.members(spark, sf_dir), vocab=V.VOCAB), "ratio")


@query
def f9_cooccur_group(spark, sf_dir):
    return rounded(cooccurrence(V.members(spark, sf_dir), vocab=V.VOCAB, by="discipline"), "ratio")


@query
def f10_position(spark, sf_dir):
    return V.placed_facts(spark, sf_dir).select("doi", "auid", "position", "position2")


@query
def f11_position_count(spark, sf_dir):
    return M.count_by_position(V.placed_facts(spark, sf_dir))


@query
def f12_position_group(spark, sf_dir):
    return M.count_by_position(V.placed_facts(spark, sf_dir), by="discipline")


@query
def f13_rate(spark, sf_dir):
    return rounded(M.label_rate(V.placed_facts(spark, sf_dir)), "rate")


@query
def f14_rate_group(spark, sf_dir):
    return rounded(M.label_rate(V.placed_facts(spark, sf_dir), by="discipline"), "rate")


# Independence


@query
def g1_participation(spark, sf_dir):
    return participation(V.placed_facts(spark, sf_dir), ("doi", "auid", "position", "position2"))


def _held(spark, sf_dir):
    return participation(V.placed_facts(spark, sf_dir), ("position2",)).filter("held = 1")


@query
def g2_contingency(spark, sf_dir):
    return contingency(_held(spark, sf_dir), "position2", "label")


@query
def g3_expected(spark, sf_dir):
    cells = with_expected(contingency(_held(spark, sf_dir), "position2", "label"), "position2", "label")
    return rounded(cells, "expected")


@query
def g4_chi2(spark, sf_dir):
    return rounded(chi_square_position(V.placed_facts(spark, sf_dir)), "chi2", "p_value")


@query
def g5_chi2_label(spark, sf_dir):
    return rounded(chi_square_position(V.placed_facts(spark, sf_dir), per_label=True), "chi2", "p_value")


@query
def g6_chi2_group(spark, sf_dir):
    tests = chi_square_position(V.placed_facts(spark, sf_dir), by_group="discipline")
    return rounded(tests, "chi2", "p_value")


@query
def g7_chi2_group_label(spark, sf_dir):
    tests = chi_square_position(V.placed_facts(spark, sf_dir), per_label=True, by_group="discipline")
    return rounded(tests, "chi2", "p_value")


# Overall and by group in one pass

EVERY_SCOPE = (*G.DISCIPLINES, G.OVERALL)


def _scoped(facts):
    return facts.withColumn("scope", F.expr(G.scopes("discipline")))


@query
def d9_d10_summary_members_scopes(spark, sf_dir):
    scope = {"scope": G.scopes(G.default_groups_of("subjareas"))}
    sizes = D.size_per(_coded(spark, sf_dir), "doi", "auid", "num_au", multi=scope)
    return rounded(D.summarise(sizes, "num_au", ["scope"], exact=True), "mean", "sd")


@query
def f8_f9_cooccur_scopes(spark, sf_dir):
    rows = cooccurrence(_scoped(V.members(spark, sf_dir)), vocab=V.VOCAB, by="scope", groups=EVERY_SCOPE)
    return rounded(rows, "ratio")


@query
def f11_f12_position_scopes(spark, sf_dir):
    return M.count_by_position(_scoped(V.placed_facts(spark, sf_dir)), by="scope")


@query
def f13_f14_rate_scopes(spark, sf_dir):
    return rounded(M.label_rate(_scoped(V.placed_facts(spark, sf_dir)), by="scope"), "rate")


@query
def g4_g6_chi2_scopes(spark, sf_dir):
    return rounded(chi_square_position(_scoped(V.placed_facts(spark, sf_dir)), by_group="scope"), "chi2", "p_value")
