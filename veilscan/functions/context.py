"""Score boost from nearby words, and the keyword tests on a character window."""

from __future__ import annotations

from collections.abc import Iterable

from .sqltext import any_of, let, text_literal

# Character windows that nearly always hold the wanted tokens; the full text is used where they do not.
_NEAR_BEFORE = 256
_NEAR_AFTER = 128


def contains_any(text: str, words: Iterable[str]) -> str:
    return any_of(f"contains({text}, {text_literal(w)})" for w in words)


def token_line(text: str) -> str:
    """Lower-cased word tokens joined by single blanks."""
    return f"trim(regexp_replace(lower({text}), '(?U)\\\\W+', ' '))"


def _holds(line: str, tokens: int) -> str:
    return f"length({line}) - length(replace({line}, ' ')) + 1 >= {tokens}"


def tokens_before(text: str, start: str, count: int) -> str:
    """The last ``count`` tokens of ``text[:start]`` as one blank-separated string."""
    near = token_line(f"substring({text}, greatest({start} - {_NEAR_BEFORE}, 0) + 1, least({start}, {_NEAR_BEFORE}))")
    # The first token of the short window may be cut, so it must not be among those taken.
    whole = token_line(f"substring({text}, 1, {start})")
    picked = f"CASE WHEN {start} <= {_NEAR_BEFORE} OR {_holds('line', count + 1)} THEN line ELSE {whole} END"
    return f"substring_index({let(near, 'line', picked)}, ' ', -{count})"


def tokens_after(text: str, stop: str, count: int) -> str:
    """The first ``count`` tokens of ``text[stop:]`` as one blank-separated string."""
    near = token_line(f"substring({text}, {stop} + 1, {_NEAR_AFTER})")
    whole = token_line(f"substring({text}, {stop} + 1)")
    picked = f"CASE WHEN {_holds('line', count + 1)} THEN line ELSE {whole} END"
    return f"substring_index({let(near, 'line', picked)}, ' ', {count})"


def near_word(text: str, start: str, stop: str, words: Iterable[str], before: int, after: int) -> str:
    """True when a token near the span contains one of ``words``; phrases never fit into one token."""
    single = [w.lower() for w in words if not any(ch.isspace() for ch in w.strip())]
    sides = []
    if single and before > 0:
        sides.append(let(tokens_before(text, start, before), "near", contains_any("near", single)))
    if single and after > 0:
        sides.append(let(tokens_after(text, stop, after), "near", contains_any("near", single)))
    return any_of(sides)


def boosted(score: float, factor: float, floor: float) -> float:
    return min(1.0, max(score + factor, floor))
