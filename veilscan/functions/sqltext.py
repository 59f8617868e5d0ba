"""Literals, lets and boolean chains in Spark SQL text."""

from __future__ import annotations

from collections.abc import Iterable


def text_literal(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def text_list(values: Iterable[str]) -> str:
    return ", ".join(text_literal(v) for v in values)


def let(value: str, name: str, body: str) -> str:
    """Evaluate ``value`` once per row under ``name`` and use it several times in ``body``."""
    return f"transform(array({value}), {name} -> {body})[0]"


def any_of(conditions: Iterable[str]) -> str:
    listed = list(conditions)
    return "(" + " OR ".join(listed) + ")" if listed else "false"


def all_of(conditions: Iterable[str]) -> str:
    listed = [c for c in conditions if c != "true"]
    return "(" + " AND ".join(listed) + ")" if listed else "true"


def around(text: str, start: str, stop: str, chars: int) -> str:
    """``text[max(0, start - chars) : stop + chars]`` with 0-based half-open offsets."""
    left = f"greatest({start} - {chars}, 0)"
    return f"substring({text}, {left} + 1, {stop} + {chars} - {left})"
