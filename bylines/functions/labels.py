"""Role labels held as strings, arrays or bit masks.

A vocabulary is fixed and short, so the set of labels a row holds fits into a
bit mask. Masks aggregate with ``bit_or`` in a plain hash aggregate (fixed-width
buffer, full map-side combine), where ``collect_set`` would need object buffers.

Arguments are SQL expressions over the columns at hand, often just a column name.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from bylines.functions import sql

# The fourteen contributor roles of the public taxonomy.
ROLES = (
    "Conceptualization",
    "Data curation",
    "Formal analysis",
    "Funding acquisition",
    "Investigation",
    "Methodology",
    "Project administration",
    "Resources",
    "Software",
    "Supervision",
    "Validation",
    "Visualization",
    "Writing – original draft",
    "Writing – review & editing",
)

# Spelling found in the sources -> spelling in the taxonomy.
ROLE_ALIASES = {"Formal Analysis": "Formal analysis"}

SEPARATOR = ", "
LOOSE_SEPARATOR = ",\\s*"
BITS = 63  # labels per BIGINT mask, sign bit left alone


def split_labels(text: str, pattern: str = SEPARATOR) -> str:
    """SQL for a label string as array; NULL stays NULL, '' becomes ['']."""
    return f"split({text}, {sql.literal(pattern)})"


def canonical_labels(labels: str, aliases: Mapping[str, str] = ROLE_ALIASES) -> str:
    """SQL replacing alias spellings inside an array, keeping order and duplicates."""
    if not aliases:
        return labels
    cases = " ".join(f"WHEN {sql.literal(a)} THEN {sql.literal(c)}" for a, c in aliases.items())
    return f"transform({labels}, x -> CASE x {cases} ELSE x END)"


def allowed_labels(labels: str, vocab: Sequence[str] = ROLES) -> str:
    """SQL keeping the array elements found in the vocabulary, duplicates included."""
    return f"filter({labels}, x -> x IN ({sql.literals(vocab)}))"


def unique_labels(labels: str) -> str:
    return f"array_sort(array_distinct({labels}))"


def label_masks(
    text: str,
    vocab: Sequence[str] = ROLES,
    aliases: Mapping[str, str] = ROLE_ALIASES,
    separator: str = SEPARATOR,
) -> list[str]:
    """SQL for the bit masks of the vocabulary labels present in a joined label string.

    Splitting, canonical spelling, allow-list and de-duplication happen in one step: a
    label is present exactly when the text, fenced by separators, contains the label
    fenced by separators. This is a byte search without arrays or regular expressions.
    One mask holds 63 labels; longer vocabularies yield several masks.
    """
    if not separator or any(separator.endswith(separator[:i]) for i in range(1, len(separator))):
        raise ValueError("a separator that overlaps itself does not cut the text in one way")
    fenced = f"concat({sql.literal(separator)}, {text}, {sql.literal(separator)})"

    def bits(part: Sequence[str]) -> str:
        spelled = [(label, i) for i, label in enumerate(part) if label not in aliases]
        spelled += [(alias, part.index(label)) for alias, label in aliases.items() if label in part]
        wanted = [(sql.literal(separator + s + separator), 1 << i) for s, i in spelled if separator not in s]
        return " | ".join(f"CASE WHEN contains({fenced}, {s}) THEN {bit}L ELSE 0L END" for s, bit in wanted) or "0L"

    return [bits(part) for part in _parts(vocab)]


def labels_of_masks(masks: Sequence[str], vocab: Sequence[str] = ROLES) -> str:
    """SQL for the array of the labels whose bits are set, in vocabulary order."""
    held = [
        f"filter({sql.array(part)}, (x, i) -> getbit({mask}, i) = 1)"
        for mask, part in zip(masks, _parts(vocab), strict=True)
    ]
    return f"concat({', '.join(held)})"


def any_label(masks: Sequence[str]) -> str:
    return " OR ".join(f"{mask} <> 0" for mask in masks)


def mask_count(masks: Sequence[str]) -> str:
    return " + ".join(f"bit_count({mask})" for mask in masks)


def _parts(vocab: Sequence[str]) -> list[Sequence[str]]:
    return [vocab[i : i + BITS] for i in range(0, len(vocab), BITS)]
