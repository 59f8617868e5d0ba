"""Detection: all recognisers, checks, boosts, thresholds and rules over one text, as one array column.

Everything happens inside the row that holds the text, so the whole chain runs without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.context import boosted, near_word
from ..functions.spans import NO_SPANS, regex_spans
from ..functions.sqltext import all_of, any_of, around, let, text_literal
from ..rules import RuleSet
from .postprocess import ENTITY_PRIORITY, passes_allow_list, passes_rule
from .recognisers import ModelRecogniser, Pattern, Recogniser
from .segments import explode_segments

AnyRecogniser = Recogniser | ModelRecogniser

# The order of the first six fields decides the winner among equal spans.
HIT_TYPE = (
    "array<struct<start:int,stop:int,neg_priority:int,neg_score:double,entity:string,ordinal:int,"
    "recogniser:string,pattern:string,value:string,snippet:string>>"
)


@dataclass(frozen=True)
class Boost:
    enabled: bool = True
    factor: float = 0.35
    floor: float = 0.45
    before: int = 8
    after: int = 2
    # A scan-wide context word counts as near every span.
    scan_wide_words_apply: bool = True


@dataclass(frozen=True)
class DetectOptions:
    boost: Boost = Boost()
    allow_list: tuple[str, ...] = ()
    allow_list_match: str = "exact"
    snippet_chars: int | None = 24
    # Off: every surviving span of every pattern, for the table-driven operators.
    resolve: bool = True


def _number(value: float | str) -> str:
    return value if isinstance(value, str) else f"{float(value)!r}D"


def score_of(text: str, span: str, base: float | str, rec: AnyRecogniser, rules: RuleSet, boost: Boost) -> float | str:
    """Base score, raised by the context boost; one after a passed check. A number where it is the same for all."""
    if isinstance(rec, Recogniser) and rec.validator is not None and rec.promotes:
        return 1.0
    if not (boost.enabled and rec.context):
        return base
    if isinstance(base, str):
        raised: float | str = f"least(1.0D, greatest({base} + {_number(boost.factor)}, {_number(boost.floor)}))"
    else:
        raised = boosted(base, boost.factor, boost.floor)
    scan_wide = boost.scan_wide_words_apply and any(
        w.lower() in word.lower() for w in rec.context for word in rules.context_words
    )
    if scan_wide:
        return raised
    near = near_word(text, f"{span}.start", f"{span}.stop", rec.context, boost.before, boost.after)
    return f"CASE WHEN {near} THEN {_number(raised)} ELSE {_number(base)} END"


def _surviving(
    found: str, entity: str, rec: AnyRecogniser, pattern: str, base: float | str, ordinal: int, rules: RuleSet, options: DetectOptions
) -> str | None:
    """The spans in ``found`` that pass allow list, check, rules and thresholds, with score and provenance.

    ``None`` when no span can reach the threshold.
    """
    score = score_of("body", "s", base, rec, rules, options.boost)
    floor = rules.min_score(entity)
    if isinstance(score, float) and score < floor:
        return None
    check = "true"
    if isinstance(rec, Recogniser) and rec.validator is not None:
        check = rec.validator("s.value", "num")
    tests = [
        "s.start >= lo",
        "s.start < hi",
        passes_allow_list("s.value", options.allow_list, options.allow_list_match),
        passes_rule("body", "s.start", "s.stop", "s.value", entity, rules.rule(entity), check),
    ]
    snippet = "cast(null AS string)"
    if options.snippet_chars is not None:
        snippet = around("body", "s.start", "s.stop", options.snippet_chars)
    hits = f"""transform(filter({found}, s -> {all_of(tests)}), s -> struct(
        s.start AS start, s.stop AS stop, {-ENTITY_PRIORITY.get(entity, 0)} AS neg_priority,
        -({_number(score)}) AS neg_score,
        {text_literal(entity)} AS entity, {ordinal} AS ordinal, {text_literal(rec.name)} AS recogniser,
        {text_literal(pattern)} AS pattern, s.value AS value, {snippet} AS snippet))"""
    return hits if isinstance(score, float) else f"filter({hits}, h -> -h.neg_score >= {_number(floor)})"


def pattern_hits(spans: str, pattern: Pattern, rec: Recogniser, ordinal: int, rules: RuleSet, options: DetectOptions) -> str | None:
    """The surviving spans among those a pattern has in the segment columns ``body``, ``lo`` and ``hi``."""
    return _surviving(spans, rec.entity, rec, pattern.name, pattern.score, ordinal, rules, options)


def model_hits(column: str, entity: str, rec: ModelRecogniser, ordinal: int, rules: RuleSet, options: DetectOptions) -> str | None:
    """The surviving spans of one entity among those a model found in the segment."""
    found = (
        f"transform(filter({column}, m -> m.entity = {text_literal(entity)}), m -> struct(int(m.start) AS start, "
        "int(m.stop) AS stop, substring(body, m.start + 1, m.stop - m.start) AS value, double(m.score) AS score))"
    )
    return _surviving(found, entity, rec, "model", "s.score", ordinal, rules, options)


def same_span_winners(hits: str) -> str:
    """Per (start, stop): highest entity priority, then highest score, then entity name.

    This also removes duplicates of one entity, keeping the best score. Other overlaps all stay.
    """
    first = "filter(o, (h, i) -> i = 0 OR get(o, i - 1).start != h.start OR get(o, i - 1).stop != h.stop)"
    return let(hits, "raw", f"CASE WHEN size(raw) < 2 THEN raw ELSE {let('sort_array(raw)', 'o', first)} END")


def gate_columns(patterns: list[Pattern], body: str = "body") -> dict[str, str]:
    """Cheap facts of a text that let most texts skip most patterns, computed once each."""
    words = {p.needs for p in patterns if isinstance(p.needs, str)}
    gates = {}
    if any(isinstance(p.needs, int) for p in patterns):
        # A lower bound of the longest digit run, in the steps the patterns ask for.
        gates["_run"] = (
            rf"CASE WHEN NOT {body} RLIKE '(?U)\\d' THEN 0 WHEN NOT {body} RLIKE '(?U)\\d{{4}}' THEN 1 "
            rf"WHEN NOT {body} RLIKE '(?U)\\d{{6}}' THEN 4 ELSE 6 END"
        )
    for i, word in enumerate(sorted(words)):
        haystack = body if word.upper() == word.lower() else f"lower({body})"
        gates[f"_has{i}"] = f"contains({haystack}, {text_literal(word)})"
    return gates


def gate_of(pattern: Pattern, gates: dict[str, str]) -> str | None:
    """The test, over gate columns, that a segment with a match passes; None for a pattern that needs nothing."""
    if pattern.needs is None:
        return None
    if isinstance(pattern.needs, int):
        return f"_run >= {pattern.needs}"
    return next(name for name, sql in gates.items() if sql.endswith(f", {text_literal(pattern.needs)})"))


def _gated(found: str, pattern: Pattern, gates: dict[str, str], nothing: str) -> str:
    test = gate_of(pattern, gates)
    return found if test is None else f"CASE WHEN {test} THEN {found} ELSE {nothing} END"


def detect(
    records: DataFrame,
    text: str,
    recognisers: list[Recogniser],
    rules: RuleSet,
    options: DetectOptions = DetectOptions(),
    models: tuple[ModelRecogniser, ...] = (),
    segment_chars: int = 0,
    margin_chars: int = 0,
    markers: bool = False,
    exact_cuts: bool = False,
) -> DataFrame:
    """One row per surviving span of the text column; ``start`` and ``end`` are offsets in the text.

    The other columns are carried along. Texts longer than ``segment_chars`` (zero: none) are cut. With ``exact_cuts`` patterns run
    over such a text before it is cut for what is decided per span, so rows equal those of an uncut text; this doubles the plan and
    costs time where texts are short. Models see one segment at a time either way. With ``markers`` each record gives one more row,
    without an entity.
    """
    others = [c for c in records.columns if c != text]
    patterns = [(p, r) for r in recognisers for p in r.patterns]
    cuts = exact_cuts and segment_chars > 0

    def spans_in_body(i: int, pattern: Pattern) -> str:
        own = regex_spans("body", pattern.jvm_regex)
        return f"CASE WHEN _spans{i} IS NULL THEN {own} ELSE _spans{i} END" if cuts else own

    hits_of = [(p, pattern_hits(spans_in_body(i, p), p, r, i, rules, options)) for i, (p, r) in enumerate(patterns)]
    live = [(i, p, hits) for i, (p, hits) in enumerate(hits_of) if hits is not None]
    gates = gate_columns([p for _, p, _ in live], f"`{text}`" if cuts else "body")
    parts = [f"cast(array() AS {HIT_TYPE})", *(_gated(hits, p, gates, f"cast(array() AS {HIT_TYPE})") for _, p, hits in live)]
    for m, model in enumerate(models):
        by_entity = (model_hits(f"_model{m}", e, model, len(patterns) + m, rules, options) for e in model.entities if rules.wants(e))
        parts += [hits for hits in by_entity if hits is not None]
    found = f"concat({', '.join(parts)})"

    gate_facts = [F.expr(sql).alias(name) for name, sql in gates.items()]
    if cuts:
        # The spans of texts that are cut; all others have theirs found where they are used, which copies nothing.
        spans_of = {
            f"_spans{i}": f"CASE WHEN length(`{text}`) > {segment_chars} THEN {_gated(regex_spans(f'`{text}`', p.jvm_regex), p, gates, NO_SPANS)} END"
            for i, p, _ in live
        }
        placed = records.select("*", *gate_facts).select("*", *(F.expr(sql).alias(name) for name, sql in spans_of.items()))
        before, after = (options.boost.before, options.boost.after) if options.boost.enabled else (0, 0)
        segments = explode_segments(placed, text, segment_chars, margin_chars, list(spans_of), before, after, markers)
    else:
        segments = explode_segments(records, text, segment_chars, margin_chars, markers=markers).select("*", *gate_facts)
    if models:
        segments = segments.select("*", *(model.find(F.col("body")).alias(f"_model{m}") for m, model in enumerate(models)))
    elif gates and all(p.needs is not None for _, p, _ in live):
        open_gates = any_of(["_run > 0"] * ("_run" in gates) + [g for g in gates if g != "_run"])
        segments = segments.filter(f"{open_gates} OR lo < 0" if markers else open_gates)
    # inline_outer, because the optimizer would evaluate the whole chain a second time to pre-filter inline.
    hits = same_span_winners(found) if options.resolve else found
    kept = F.col("entity").isNotNull() | (F.col("lo") < 0) if markers else F.col("entity").isNotNull()
    spans = segments.select(*others, "base", *(["lo"] if markers else []), F.expr(f"inline_outer({hits})")).filter(kept)
    return spans.select(
        *others,
        F.col("entity").alias("entity_type"),
        "recogniser",
        "pattern",
        (F.col("start") + F.col("base")).alias("start"),
        (F.col("stop") + F.col("base")).alias("end"),
        "value",
        (-F.col("neg_score")).alias("score"),
        "snippet",
    )
