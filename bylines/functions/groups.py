"""Subject-area codes grouped into fields."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from bylines.functions import sql

# Subject-area codes per field.
HEALTH = ("MEDI", "NURS", "VETE", "DENT", "HEAL")
LIFE = ("AGRI", "BIOC", "IMMU", "NEUR", "PHAR")
PHYSICAL = ("CENG", "CHEM", "COMP", "EART", "ENER", "ENGI", "ENVI", "MATE", "MATH", "PHYS")
SOCIAL = ("ARTS", "BUSI", "DECI", "ECON", "PSYC", "SOCI")
MULTI = ("MULT",)

# Code -> field for one row per code; codes outside fall to DEFAULT_FIELD.
FIELDS = {
    "health_sciences": HEALTH,
    "life_sciences": LIFE,
    "physical_sciences": PHYSICAL,
    "social_sciences": SOCIAL,
}
DEFAULT_FIELD = "multidisciplinary"

# Code list -> ordered discipline list; codes outside belong to no discipline.
DISCIPLINES = {
    "Health Sciences": HEALTH,
    "Life Sciences": LIFE,
    "Physical Sciences": PHYSICAL,
    "Social Sciences": SOCIAL,
    "Multidisciplinary": MULTI,
}

Mapped = Mapping[str, Sequence[str]]


def group_of(code: str, groups: Mapped = FIELDS, default: str = DEFAULT_FIELD) -> str:
    """SQL for the group of a single code; unknown and NULL codes get the default."""
    cases = " ".join(
        f"WHEN {code} IN ({sql.literals(codes)}) THEN {sql.literal(group)}" for group, codes in groups.items()
    )
    return f"CASE {cases} ELSE {sql.literal(default)} END"


def groups_of(codes: str, groups: Mapped = DISCIPLINES) -> str:
    """SQL for the distinct groups of a code list in mapping order; unknown codes add none."""
    found = [
        f"CASE WHEN arrays_overlap({codes}, {sql.array(members)}) THEN {sql.literal(group)} END"
        for group, members in groups.items()
    ]
    return f"array_compact(array({', '.join(found)}))"


def default_groups_of(codes: str, groups: Mapped = FIELDS, default: str = DEFAULT_FIELD) -> str:
    """SQL for the distinct ``group_of`` values of a code list, one row per group once exploded."""
    return f"array_distinct(transform({codes}, x -> {group_of('x', groups, default)}))"


OVERALL = "All"  # the scope of every row


def scopes(groups: str, overall: str = OVERALL) -> str:
    """SQL for the groups of a row and, last, the scope that every row belongs to.

    Metrics by an array of groups, given this one, have the overall result beside those of the groups
    from one pass: they count rows per array before they open it. A NULL array has the overall scope
    only; ``overall`` must not be the name of a group.
    """
    return f"array_append(coalesce({groups}, CAST(array() AS array<string>)), {sql.literal(overall)})"
