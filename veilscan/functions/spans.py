"""Regex matches with code-point offsets, as a pure SQL expression."""

from __future__ import annotations

from .sqltext import let, text_literal

SPAN_TYPE = "array<struct<start:int,stop:int,value:string>>"
NO_SPANS = f"cast(array() AS {SPAN_TYPE})"


# Stands around matches in a marked copy of the text; texts that hold it show U+FFFD there instead.
_MARK = "'\\uFFFF'"
# Appending to an array copies it, so many matches are walked in runs of this many.
_RUN = 128


def _walk(pieces: str, at: str) -> str:
    """The spans of (skip, value) pieces, the first gap beginning at offset ``at``."""
    return f"""aggregate({pieces}, struct({at} AS pos, {NO_SPANS} AS spans),
        (acc, p) -> struct(
            acc.pos + p.skip + length(p.value) AS pos,
            array_append(acc.spans, struct(
                acc.pos + p.skip AS start, acc.pos + p.skip + length(p.value) AS stop, p.value AS value)) AS spans),
        acc -> acc.spans)"""


def _walk_in_runs() -> str:
    """The same for the array ``pieces`` of any size: one sum per run, the offsets of the runs, then each run by itself."""
    runs = f"transform(sequence(0, (size(pieces) - 1) div {_RUN}), r -> slice(pieces, int(r * {_RUN} + 1), {_RUN}))"
    lengths = "transform(runs, run -> aggregate(run, 0, (n, p) -> n + p.skip + length(p.value)))"
    starts = "aggregate(lengths, array(0), (sums, n) -> array_append(sums, element_at(sums, -1) + n))"
    placed = f"flatten(transform(runs, (run, r) -> {_walk('run', 'starts[r]')}))"
    return let(runs, "runs", let(lengths, "lengths", let(starts, "starts", placed)))


def regex_spans(text: str, pattern: str) -> str:
    """All non-overlapping matches of a JVM ``pattern`` as ``array<struct<start, stop, value>>``.

    Offsets are 0-based half-open code points. A row without a match costs one regex pass; so does a row whose
    only match occurs once in the text, where a plain search gives the offset. Else a second pass marks the
    matches, and the pieces between the marks give the offsets. (``split`` by the pattern would give the same
    pieces but compiles the pattern for every row.) The pattern must not match the empty string.
    """
    regex = text_literal(pattern)
    found = f"regexp_extract_all(coalesce({text}, ''), {regex}, 0)"
    marked = f"regexp_replace(replace({text}, {_MARK}, '\\uFFFD'), {regex}, '\\uFFFF$0\\uFFFF')"
    # Gap, match, gap, ..., match, gap
    gaps = f"filter(split({marked}, {_MARK}, -1), (piece, i) -> i % 2 = 0 AND i < 2 * size(found))"
    pieces = f"zip_with({gaps}, found, (gap, value) -> struct(length(gap) AS skip, value AS value))"
    walked = let(pieces, "pieces", f"CASE WHEN size(pieces) <= {_RUN} THEN {_walk('pieces', '0')} ELSE {_walk_in_runs()} END")
    alone = "array(struct(at - 1 AS start, at - 1 + length(found[0]) AS stop, found[0] AS value))"
    unique = f"CASE WHEN size(found) = 1 AND locate(found[0], {text}, at + 1) = 0 THEN {alone} ELSE {walked} END"
    placed = let(f"locate(found[0], {text})", "at", unique)
    return let(found, "found", f"CASE WHEN size(found) = 0 THEN {NO_SPANS} ELSE {placed} END")
