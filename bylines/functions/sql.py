"""Pieces of SQL text. Generated chains are built as one SQL expression each: a few
parsed strings cost the driver far less than hundreds of Column calls."""

from __future__ import annotations

from collections.abc import Iterable


def literal(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def literals(values: Iterable[str]) -> str:
    return ", ".join(literal(v) for v in values)


def array(values: Iterable[str]) -> str:
    return f"array({literals(values)})"


def name(column: str) -> str:
    return "`" + column.replace("`", "``") + "`"
