"""Cutting long texts into independent segments.

Each segment is a core of ``size`` characters with a margin of neighbouring text on both sides; only matches that start
in the core count, so every match is found in exactly one segment. Results equal a scan of the whole text for matches
and context shorter than the margin.

A segment may also carry the spans that start in its core, found in the whole text before it was cut (one linear pass a
pattern). Then left-to-right patterns over digit groups and matches of any length come out as in an uncut text, and the
neighbouring text holds as many word tokens as the context looks at, however long they are: nothing depends on the cut.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.spans import NO_SPANS
from ..functions.sqltext import any_of, let, text_literal

SEGMENT_COLUMNS = ("base", "lo", "hi", "body")


def _reach(text: str, margin: int, tokens: int) -> str:
    """How many leading characters hold ``margin`` characters and ``tokens`` whole word tokens with the one behind them."""
    if not tokens:
        return str(margin)
    regex = text_literal(rf"(?U)^\W*+(?:\w++\W++){{0,{tokens}}}+\w*+")
    return f"greatest({margin}, length(regexp_extract({text}, {regex}, 0)))"


def _lower_bound(spans: str, offset: str) -> str:
    """The number of spans, in text order, that start before ``offset``: a binary search, since a text may hold a million."""
    return f"""aggregate(sequence(0, 31), struct(0 AS a, size({spans}) AS b),
        (acc, n) -> CASE WHEN acc.a >= acc.b THEN acc
            WHEN {spans}[(acc.a + acc.b) div 2].start < {offset} THEN struct(int((acc.a + acc.b) div 2 + 1) AS a, acc.b AS b)
            ELSE struct(acc.a AS a, int((acc.a + acc.b) div 2) AS b) END,
        acc -> acc.a)"""


def _spans_between(spans: str, start: str, stop: str) -> str:
    cut = let(_lower_bound(spans, start), "a", f"slice({spans}, a + 1, {_lower_bound(spans, stop)} - a)")
    return f"CASE WHEN size({spans}) = 0 THEN {NO_SPANS} ELSE {cut} END"


def segments_of(text: str, size: int, margin: int, spans: Sequence[str] = (), before: int = 0, after: int = 0) -> str:
    """``array<struct<base, lo, hi, body, ...>>``: ``body`` starts at offset ``base``, its core is ``[lo, hi)``.

    ``spans`` names columns with the spans of the whole text; each segment has those of its core under the same names,
    with offsets in ``body``; a text that isn't cut keeps what it has there. The body then holds ``before`` and ``after`` word
    tokens around the core and its spans.
    """
    carried = "".join(f", {name} AS {name}" for name in spans)
    whole = f"array(struct(0 AS base, 0 AS lo, length({text}) AS hi, {text} AS body{carried}))"
    if size <= 0:
        return whole
    if margin > size:
        raise ValueError("the margin must not exceed the segment size")
    # Neighbouring text, from the next block where that holds enough; else from the whole text, for a segment with spans.
    wanted = _reach("ahead", margin, after)
    far = let(f"substring({text}, stop + over + 1)", "ahead", f"concat(substring({text}, stop + 1, over), left(ahead, {wanted}))")
    enough = "CASE WHEN reach < length(ahead) OR {last} THEN {near} WHEN NOT found THEN {plain} ELSE {far} END"
    near = enough.format(last="i = size(blocks) - 2", near="left(blocks[i + 1], over + reach)", plain=f"left(blocks[i + 1], {margin})", far=far)
    near = let("substring(blocks[i + 1], over + 1)", "ahead", let(wanted, "reach", near))
    behind = f"CASE WHEN i = size(blocks) - 1 THEN '' ELSE {near} END"
    wanted = _reach("ahead", margin, before)
    far = let(f"reverse(left({text}, i * {size}))", "ahead", f"reverse(left(ahead, {wanted}))")
    near = enough.format(last="i = 1", near="right(blocks[i - 1], reach)", plain=f"right(blocks[i - 1], {margin})", far=far)
    in_front = f"CASE WHEN i = 0 THEN '' ELSE {let('reverse(blocks[i - 1])', 'ahead', let(wanted, 'reach', near))} END"
    moved = "".join(
        f", transform(own.{name}, s -> struct(s.start - base AS start, s.stop - base AS stop, s.value AS value)) AS {name}" for name in spans
    )
    segment = f"struct(base AS base, length(pre) AS lo, length(pre) + length(block) AS hi, concat(pre, block, {behind}) AS body{moved})"
    placed = let(in_front, "pre", let(f"i * {size} - length(pre)", "base", segment))
    if spans:
        ends = "".join(f", coalesce(try_element_at(own.{name}, -1).stop, 0) - stop" for name in spans)
        placed = let(f"greatest(0{ends})", "over", let(any_of(f"size(own.{name}) > 0" for name in spans), "found", placed))
        own = ", ".join(f"{_spans_between(name, f'i * {size}', 'stop')} AS {name}" for name in spans)
        placed = let(f"struct({own})", "own", placed)
    else:
        placed = let("0", "over", let("false", "found", placed))
    cut = f"transform(blocks, (block, i) -> {let(f'i * {size} + length(block)', 'stop', placed)})"
    # One linear pass cuts the text into blocks of ``size`` code points.
    blocks = f"regexp_extract_all({text}, '(?s).{{1,{size}}}', 0)"
    return f"CASE WHEN length({text}) <= {size} THEN {whole} ELSE {let(blocks, 'blocks', cut)} END"


def marker_of(spans: Sequence[str] = ()) -> str:
    """A segment without a core: nothing is found in it, so it stands for its record alone."""
    return f"struct(0 AS base, -1 AS lo, -1 AS hi, '' AS body{''.join(f', {NO_SPANS} AS {name}' for name in spans)})"


def explode_segments(
    records: DataFrame, text: str, size: int, margin: int, spans: Sequence[str] = (), before: int = 0, after: int = 0, markers: bool = False
) -> DataFrame:
    """Replace the text column by one row per segment with columns ``base, lo, hi, body`` and the ``spans`` of its core.

    Texts without any non-blank character have nothing to find and yield no row. With ``markers`` every row yields one
    more segment, without a core, and blank and null texts only that.
    """
    others = [c for c in records.columns if c != text and c not in spans]
    cut = segments_of(f"`{text}`", size, margin, spans, before, after)
    worth = f"coalesce(`{text}` RLIKE '(?U)\\\\S', false)"
    if not markers:
        # inline_outer, because the optimizer would evaluate the segments a second time to pre-filter inline.
        return records.filter(F.expr(worth)).select(*others, F.expr(f"inline_outer({cut})"))
    marker = marker_of(spans)
    return records.select(*others, F.expr(f"inline_outer(CASE WHEN {worth} THEN array_append({cut}, {marker}) ELSE array({marker}) END)"))
