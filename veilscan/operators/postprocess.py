"""Rule filters and conflict resolution.

The predicates (``passes_*``) are SQL text over any span fields, inside an array lambda or on exploded rows.
The DataFrame operators below them are the table-driven forms with joins and windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.checks import digits_of, looks_like_aadhaar, looks_like_mobile
from ..functions.context import contains_any
from ..functions.regex_dialect import RULE, jvm_form
from ..functions.sqltext import all_of, any_of, around, let, text_list, text_literal
from ..rules import EntityRule

# Entity priorities for equal spans, and the keyword test for short account numbers.
ENTITY_PRIORITY = {
    "IN_AADHAAR": 200,
    "IN_PAN": 190,
    "IN_IFSC": 185,
    "IN_UPI_ID": 180,
    "IN_PASSPORT": 175,
    "CREDIT_CARD": 170,
    "IBAN_CODE": 165,
    "US_BANK_NUMBER": 150,
    "IN_BANK_ACCOUNT": 145,
    "EMAIL_ADDRESS": 140,
    "PHONE_NUMBER": 130,
    "PERSON": 120,
    "LOCATION": 110,
    "IP_ADDRESS": 100,
}
BANK_KEYWORDS = ("account", "acct", "a/c", "ifsc", "bank", "beneficiary", "iban")
BANK_WINDOW = 64


def normalise(value: str, mode: str, digits: str | None = None) -> str:
    if mode == "digits":
        return digits or digits_of(value)
    return f"lower({value})" if mode == "lower" else value


def found_in(value: str, patterns: list[str]) -> str:
    """True when any pattern is found in the value, ignoring case."""
    return any_of(f"{value} RLIKE {text_literal(jvm_form(p, RULE))}" for p in patterns)


def passes_values(value: str, rule: EntityRule, digits: str | None = None) -> str:
    """Include and exclude lists and length bounds, all on the normalised value."""
    norm = normalise(value, rule.normalization, digits)

    def listed(values: tuple[str, ...]) -> str:
        return ", ".join(normalise(text_literal(v), rule.normalization) for v in values)

    tests = []
    if rule.include_values:
        tests.append(f"{norm} IN ({listed(rule.include_values)})")
    if rule.exclude_values:
        tests.append(f"{norm} NOT IN ({listed(rule.exclude_values)})")
    if rule.min_length is not None:
        tests.append(f"length({norm}) >= {rule.min_length}")
    if rule.max_length is not None:
        tests.append(f"length({norm}) <= {rule.max_length}")
    return all_of(tests)


def passes_patterns(value: str, rule: EntityRule) -> str:
    """Include and exclude patterns, on the raw value. Patterns that do not compile count as not found."""
    tests = []
    if rule.include_patterns:
        tests.append(found_in(value, rule.usable(rule.include_patterns)))
    if rule.exclude_patterns:
        tests.append("NOT " + found_in(value, rule.usable(rule.exclude_patterns)))
    return all_of(tests)


def passes_context(text: str, start: str, stop: str, rule: EntityRule) -> str:
    """Required and forbidden words as substrings of the window, which includes the span itself."""
    tests = []
    if rule.required_context:
        tests.append(contains_any("win", rule.required_context))
    if rule.forbidden_context:
        tests.append("NOT " + contains_any("win", rule.forbidden_context))
    if not tests:
        return "true"
    return let(f"lower({around(text, start, stop, rule.context_window_chars)})", "win", all_of(tests))


def passes_bank_guard(text: str, start: str, stop: str, digits: str) -> str:
    """11 to 18 digits, neither a mobile nor a valid Aadhaar number; up to 12 digits need a bank word nearby."""
    keyword = let(f"lower({around(text, start, stop, BANK_WINDOW)})", "win", contains_any("win", BANK_KEYWORDS))
    tests = [
        f"length({digits}) BETWEEN 11 AND 18",
        f"NOT {looks_like_mobile(digits)}",
        f"(length({digits}) > 12 OR {keyword})",
        f"NOT {looks_like_aadhaar(digits)}",
    ]
    return all_of(tests)


def passes_phone_guard(digits: str) -> str:
    """After country code 91 the ten local digits must start with 6 to 9."""
    return f"(NOT ({digits} LIKE '91%' AND length({digits}) >= 12) OR right({digits}, 10) RLIKE '^[6-9]')"


def passes_rule(
    text: str, start: str, stop: str, value: str, entity: str, rule: EntityRule, check: str = "true"
) -> str:
    """All rule filters and guards of one entity and an optional ``check`` on the value, cheapest first.

    The check may refer to the digits of the value as ``num``.
    """
    if not rule.enabled:
        return "false"
    tests = [passes_values(value, rule, "num"), passes_patterns(value, rule)]
    if entity == "PHONE_NUMBER":
        tests.append(passes_phone_guard("num"))
    tests.append(check)
    if entity == "IN_BANK_ACCOUNT":
        tests.append(passes_bank_guard(text, start, stop, "num"))
    chain = all_of([*tests, passes_context(text, start, stop, rule)])
    return let(digits_of(value), "num", chain) if "num" in chain else chain


def passes_allow_list(value: str, allow_list: tuple[str, ...], match: str = "exact") -> str:
    """False for allowed values, which are not reported."""
    if not allow_list:
        return "true"
    if match == "regex":
        return "NOT " + any_of(f"{value} RLIKE {text_literal(jvm_form(p))}" for p in allow_list)
    return f"{value} NOT IN ({text_list(allow_list)})"


def priority_of(entity: str) -> Column:
    pairs = ", ".join(f"'{name}', {rank}" for name, rank in ENTITY_PRIORITY.items())
    return F.expr(f"coalesce(try_element_at(map({pairs}), {entity}), 0)")


def _best(spans: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return spans.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def dedup_spans(spans: DataFrame, source: str = "source_id") -> DataFrame:
    """Highest score per (source, entity, start, end). Groups are as small as the number of patterns."""
    return _best(spans, [source, "entity_type", "start", "end"], [F.desc("score"), F.asc("pattern")])


def resolve_same_span(spans: DataFrame, source: str = "source_id") -> DataFrame:
    """Per (source, start, end): highest priority, then highest score, then entity name.

    This covers :func:`dedup_spans`: of one entity's duplicates only the best can win. One shuffle on the span, none of rows dealt by their source.
    """
    order = [priority_of("entity_type").desc(), F.desc("score"), F.asc("entity_type")]
    return _best(spans, [source, "start", "end"], order)
