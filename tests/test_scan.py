import re
from collections import Counter
from dataclasses import replace

import pandas as pd
import pytest
from fixtures import AADHAAR, EXPORT, HARMLESS, NEAR_MISSES, PROFILE, REPEATED
from pyspark.sql import functions as F

from veilscan.functions.spans import regex_spans
from veilscan.operators.detect import Boost, DetectOptions
from veilscan.operators.postprocess import dedup_spans, resolve_same_span
from veilscan.operators.recognisers import ModelRecogniser, Pattern, Recogniser, india_recognisers
from veilscan.operators.segments import explode_segments
from veilscan.plans.config import ScanSpec, rules_for, spec_from
from veilscan.plans.scan import scan_text
from veilscan.rules import EntityRule, RuleSet, choose_environment, layered_rule_frame, merge_layers, resolve_rules, unique

INDIA = {r.entity: r for r in india_recognisers({})}


def texts(spark, *values):
    return spark.createDataFrame(list(enumerate(values)), "id long, text string")


def found(spark, spec, *values):
    rows = scan_text(texts(spark, *values), "text", spec).collect()
    for r in rows:
        assert values[r["id"]][r["start"] : r["end"]] == r["value"]
    return rows


def counts(spark, env, value):
    return Counter(r["entity_type"] for r in found(spark, ScanSpec(rules_for(env)), value))


def only(*recognisers, rules=RuleSet(score_threshold=0.0), **options):
    kept = replace(rules, entities=tuple(r.entity for r in recognisers), custom={"enable_indian_identifiers": False})
    return ScanSpec(kept, DetectOptions(**options), extra_recognisers=recognisers)


# ---- the whole chain --------------------------------------------------------------------------------------


def test_profile_under_default_and_prod_rules(spark):
    default = counts(spark, "default", PROFILE)
    # The spaced Aadhaar fails the include pattern, which sees the raw text.
    expected = {"IN_PAN": 1, "IN_IFSC": 1, "IN_UPI_ID": 1, "IN_PASSPORT": 1, "IN_BANK_ACCOUNT": 1, "EMAIL_ADDRESS": 1, "IN_ADDRESS": 1}
    assert {k: default[k] for k in expected} == expected
    assert default["IN_AADHAAR"] == default["PERSON"] == 0
    prod = counts(spark, "prod", PROFILE)
    assert prod["PERSON"] == 1 and prod["IN_AADHAAR"] == 0 and prod["PHONE_NUMBER"] == 1


def test_export_finds_the_compact_aadhaar(spark):
    for env in ("default", "prod"):
        got = counts(spark, env, EXPORT)
        assert got["IN_AADHAAR"] == got["IN_PAN"] == got["IN_IFSC"] == got["IN_UPI_ID"] == got["IN_BANK_ACCOUNT"] == 1


def test_near_misses_and_harmless_text(spark):
    got = counts(spark, "default", NEAR_MISSES)
    assert not {e for e in got if e.startswith("IN_")} and got["PHONE_NUMBER"] == 0
    assert not counts(spark, "default", HARMLESS)


def test_repeats_are_all_reported(spark):
    got = counts(spark, "default", REPEATED)
    assert got["EMAIL_ADDRESS"] == 3 and got["IN_PAN"] == 2
    assert counts(spark, "prod", REPEATED)["EMAIL_ADDRESS"] == 0  # strict rules ask for an e-mail word nearby


def test_scores(spark):
    by_entity = {r["entity_type"]: round(r["score"], 4) for r in found(spark, ScanSpec(rules_for("default")), PROFILE)}
    assert by_entity["IN_PAN"] == 0.9 and by_entity["IN_BANK_ACCOUNT"] == 0.7 and by_entity["IN_PASSPORT"] == 0.9
    assert by_entity["IN_UPI_ID"] == 1.0 and by_entity["EMAIL_ADDRESS"] == 1.0  # capped


# ---- segments ---------------------------------------------------------------------------------------------


@pytest.mark.parametrize("size", [400, 700, 1500, 100000, 0])
def test_segments_change_nothing(spark, size):
    long = "😀é " + " | ".join(f"{PROFILE} line {i} " for i in range(40))
    whole = ScanSpec(rules_for("default"), segment_chars=0)
    cut = ScanSpec(rules_for("default"), segment_chars=size, overlap_chars=240)
    key = lambda r: (r["start"], r["end"], r["entity_type"], round(r["score"], 4), r["value"])
    assert sorted(map(key, found(spark, cut, long))) == sorted(map(key, found(spark, whole, long)))


def test_segment_cores_partition_the_text(spark):
    text = "".join(chr(97 + i % 26) for i in range(1003)) + "😀" * 5
    rows = explode_segments(texts(spark, text), "text", 100, 30).orderBy("base").collect()
    assert "".join(r["body"][r["lo"] : r["hi"]] for r in rows) == text
    assert all(text[r["base"] : r["base"] + len(r["body"])] == r["body"] for r in rows)
    assert all(len(r["body"]) <= 160 for r in rows)


def test_many_matches_in_one_text(spark):
    text = "é ".join(f"word{i} 12345{i}" for i in range(20000))
    spans = spark.createDataFrame([(text,)], "t string").selectExpr(f"inline({regex_spans('t', chr(92) + 'd+')})").collect()
    assert [(r["start"], r["stop"], r["value"]) for r in spans] == [(*m.span(), m[0]) for m in re.finditer(r"\d+", text)]


def test_texts_below_the_chunk_size_are_whole(spark):
    url = "https://example.org/" + "a" * 2500
    text = "x " * 2000 + url + " " + "1234 " * 4000
    spec = ScanSpec(RuleSet(score_threshold=0.0))
    rows = found(spark, spec, text)
    assert url in {r["value"] for r in rows if r["entity_type"] == "URL"}
    key = lambda r: (r["start"], r["end"], r["entity_type"])
    assert sorted(map(key, rows)) == sorted(map(key, found(spark, replace(spec, segment_chars=0), text)))
    assert spec_from({"analyser_section": {"chunk_size_chars": 12345}}).segment_chars == 12345
    assert spec_from({"analyser_section": {"chunk_exact": True}}).exact_cuts and not spec_from({}).exact_cuts


def _cut_sensitive():
    """Digit groups without an end, a URL over several segments, words far longer than the margin between a number and its context word."""
    far = " ".join("w" * 3000 for _ in range(6))
    after = "v" * 2500
    return "".join((
        "😀 " + "1234 5678 9012 " * 300,
        "+91 98765-43210 " * 60 + "98765" * 200 + " ",
        "see https://example.org/" + "a" * 4000 + "?q=1 then 10.1.2.3 ",
        f"passport {far} M1234567 é {far} ",
        f"K7654321 {after} passport {after} A1234567 ",
        "x" * 1990 + "@" + "y" * 900 + ".example.com " + "ABCDE1234F " * 50,
        "2024-01-" + "02-" * 500 + " card 4111 1111 1111 1111 4111 1111 1111 1111 " * 20,
    ))


@pytest.fixture(scope="module")
def cut_sensitive_rows(spark):
    key = lambda r: (r["start"], r["end"], r["entity_type"], round(r["score"], 6), r["value"], r["snippet"])
    text, spec = _cut_sensitive(), ScanSpec(RuleSet(score_threshold=0.0), overlap_chars=40, exact_cuts=True)
    return key, text, spec, sorted(map(key, found(spark, replace(spec, segment_chars=0), text)))


@pytest.mark.parametrize("size", [1, 1000, 20000])
def test_cuts_change_nothing_even_where_matches_and_context_pass_them(spark, cut_sensitive_rows, size):
    key, text, spec, whole = cut_sensitive_rows
    assert {"URL", "PHONE_NUMBER", "IN_PASSPORT", "EMAIL_ADDRESS", "CREDIT_CARD"} <= {r[2] for r in whole}
    assert sorted(map(key, found(spark, replace(spec, segment_chars=size), text))) == whole


def test_a_text_above_the_default_chunk_size_is_scanned_as_a_whole_one(spark):
    text = "x " * 70000 + _cut_sensitive() + "passport " + "w" * 210000 + " M1234567"
    spec = ScanSpec(RuleSet(score_threshold=0.0), exact_cuts=True)
    key = lambda r: (r["start"], r["end"], r["entity_type"], round(r["score"], 6))
    rows = sorted(map(key, found(spark, spec, text)))
    assert len(text) > 2 * spec.segment_chars and rows == sorted(map(key, found(spark, replace(spec, segment_chars=0), text)))
    assert [r[3] for r in rows if r[2] == "IN_PASSPORT"][-1] == 0.9


def test_windows_wider_than_a_segment(spark):
    rule = EntityRule(required_context=("beacon",), context_window_chars=12000)
    rec = Recogniser("DIGITS", "digits", (Pattern("d", r"\b\d{6}\b", 0.9),))
    spec = only(rec, rules=RuleSet(score_threshold=0.0, entity_rules={"DIGITS": rule}))
    text = "beacon " + "x " * 5000 + "123456" + " y" * 3000
    assert len(found(spark, replace(spec, segment_chars=500), text)) == len(found(spark, replace(spec, segment_chars=0), text)) == 1


def test_blank_text_is_not_scanned(spark):
    assert explode_segments(texts(spark, " \n\t ", "x"), "text", 100, 10).count() == 1


# ---- rules ------------------------------------------------------------------------------------------------


def test_conflicts(spark):
    digits = Recogniser("DIGIT_RUN", "digits", (Pattern("d", r"\b\d{6,22}\b", 0.99),))
    spec = only(INDIA["IN_AADHAAR"], INDIA["IN_BANK_ACCOUNT"], digits, boost=Boost(enabled=False))
    got = found(spark, spec, f"aadhaar {AADHAAR}, account 123456789012, plain 12345678")
    assert [r["entity_type"] for r in got] == ["IN_AADHAAR", "IN_BANK_ACCOUNT", "DIGIT_RUN"]
    raw = scan_text(texts(spark, f"aadhaar {AADHAAR}"), "text", replace(spec, detect=replace(spec.detect, resolve=False)))
    assert raw.count() == 2 and resolve_same_span(raw, "id").first()["entity_type"] == "IN_AADHAAR"
    twice = raw.unionByName(raw.withColumn("score", F.col("score") - 0.2))
    assert dedup_spans(twice, "id").count() == 2 and dedup_spans(dedup_spans(twice, "id"), "id").count() == 2
    assert resolve_same_span(resolve_same_span(twice, "id"), "id").count() == 1


def test_overlapping_spans_of_different_entities_stay(spark):
    wide = Recogniser("WIDE", "wide", (Pattern("w", r"PAN [A-Z0-9]+", 0.9),))
    assert len(found(spark, only(INDIA["IN_PAN"], wide), "PAN ABCDE1234F")) == 2


def test_forbidden_context_counts_substrings(spark):
    # 'mail' inside 'gmail' forbids; 'pan' inside 'company' is enough context.
    got = counts(spark, "default", "pay me by upi asha.verma@ybl now")
    assert got["IN_UPI_ID"] == 1
    assert counts(spark, "default", "upi asha.verma@ybl or by gmail")["IN_UPI_ID"] == 0
    assert counts(spark, "default", "company ABCDE1234F")["IN_PAN"] == 1
    assert counts(spark, "default", "alone ABCDE1234F")["IN_PAN"] == 0


def test_bank_guard(spark):
    spec = only(INDIA["IN_BANK_ACCOUNT"])
    text = "bank 12345678901 222233334444 1234567890"  # eleven digits, a valid Aadhaar, ten digits
    assert [r["value"] for r in found(spark, spec, text)] == ["12345678901"]
    assert [r["value"] for r in found(spark, spec, "no words 12345678901 but 1234567890123")] == ["1234567890123"]


def test_phone_guard(spark):
    spec = spec_from({"analyser": {"entities": ["PHONE_NUMBER"]}, "rule_engine": {"enabled": False}})
    values = [r["value"] for r in found(spark, spec, "phone +91 9876543210 phone +91 5123456789 phone +1-202-555-0186 phone 555-1234")]
    assert values == ["+91 9876543210", "+1-202-555-0186"]


def test_values_patterns_and_lengths(spark):
    run = Recogniser("RUN", "run", (Pattern("r", r"\b[\d-]{3,12}\b", 0.5),))

    def kept(rule, text="12-34 1234 999 12345678"):
        return [r["value"] for r in found(spark, only(run, rules=RuleSet(score_threshold=0.0, entity_rules={"RUN": rule})), text)]

    assert kept(EntityRule(normalization="digits", include_values=("1-2-3-4",))) == ["12-34", "1234"]
    assert kept(EntityRule(normalization="digits", exclude_values=("12 34",))) == ["999", "12345678"]
    assert kept(EntityRule(include_patterns=("^12", "([")), "1234 999") == ["1234"]
    assert kept(EntityRule(include_patterns=("([",)), "1234 999") == []
    assert kept(EntityRule(exclude_patterns=("-",))) == ["1234", "999", "12345678"]
    assert kept(EntityRule(normalization="digits", min_length=4, max_length=4)) == ["12-34", "1234"]
    assert kept(EntityRule(enabled=False)) == []


def test_allow_list(spark):
    base = spec_from({"rule_engine": {"enabled": False}})
    text = "mail a@example.com and b@example.com"
    exact = replace(base, detect=replace(base.detect, allow_list=("a@example.com",)))
    assert [r["value"] for r in found(spark, exact, text)] == ["b@example.com"]
    regex = replace(base, detect=replace(base.detect, allow_list=("^B@",), allow_list_match="regex"))
    assert [r["value"] for r in found(spark, regex, text)] == ["a@example.com"]


def test_boost(spark):
    spec = only(INDIA["IN_PASSPORT"])
    near, far = "passport no K1234567", "passport " + "word " * 9 + "K1234567"
    assert [round(r["score"], 2) for r in sorted(found(spark, spec, near, far), key=lambda r: r["id"])] == [0.9, 0.55]
    after = "K1234567 is passport", "K1234567 is a passport"
    assert [round(r["score"], 2) for r in sorted(found(spark, spec, *after), key=lambda r: r["id"])] == [0.9, 0.55]
    wide = only(INDIA["IN_PASSPORT"], rules=RuleSet(score_threshold=0.0, context_words=("passport",)))
    assert round(found(spark, wide, "K1234567")[0]["score"], 2) == 0.9
    off = only(INDIA["IN_PASSPORT"], boost=Boost(enabled=False))
    assert round(found(spark, off, near)[0]["score"], 2) == 0.55


def test_upi_domains_and_generic(spark):
    strict = {r.entity: r for r in india_recognisers({"upi_handle_domains": ["my.bank"]})}["IN_UPI_ID"]
    assert [r["value"] for r in found(spark, only(strict), "a ab@my.bank ab@myxbank ab@upi")] == ["ab@my.bank"]
    generic = {r.entity: r for r in india_recognisers({"upi_generic_pattern": True})}["IN_UPI_ID"]
    assert {r["value"] for r in found(spark, only(generic), "ab@upi cd@other")} == {"ab@upi", "cd@other"}


def test_model_recogniser(spark):
    @F.pandas_udf("array<struct<entity:string,start:int,stop:int,score:double>>")
    def names(text: pd.Series) -> pd.Series:
        return text.map(lambda t: [("PERSON", t.index("Asha"), t.index("Asha") + 10, 0.85)] if "Asha" in t else [])

    spec = replace(ScanSpec(rules_for("default")), models=(ModelRecogniser("names", ("PERSON", "ORGANIZATION"), names),))
    got = found(spark, spec, "customer Asha Verma called", "nothing", "Asha Verma alone")
    assert [(r["id"], r["entity_type"], r["value"], r["recogniser"]) for r in got] == [(0, "PERSON", "Asha Verma", "names")]


# ---- rule sets --------------------------------------------------------------------------------------------


def test_effective_thresholds():
    table = {
        "IN_AADHAAR": (0.75, 0.75, 0.75, 0.8), "IN_PAN": (0.65, 0.65, 0.65, 0.72), "IN_IFSC": (0.6, 0.6, 0.6, 0.68),
        "IN_UPI_ID": (0.65, 0.65, 0.65, 0.74), "IN_PASSPORT": (0.65, 0.65, 0.65, 0.65), "IN_BANK_ACCOUNT": (0.45, 0.45, 0.5, 0.62),
        "PHONE_NUMBER": (0.6, 0.6, 0.6, 0.7), "EMAIL_ADDRESS": (0.6, 0.55, 0.6, 0.68), "PERSON": (0.67, 0.55, 0.62, 0.78),
        "LOCATION": (0.62, 0.52, 0.6, 0.72), "IN_ADDRESS": (0.58, 0.55, 0.57, 0.72),
    }
    for i, env in enumerate(("default", "dev", "qa", "prod")):
        rules = rules_for(env)
        assert {e: rules.min_score(e) for e in table} == {e: v[i] for e, v in table.items()}
        assert rules.score_threshold == (0.45 if env == "prod" else 0.35)


def test_lists_replace_and_merge():
    dev, prod = rules_for("dev"), rules_for("prod")
    assert len(dev.entities) == 17 and dev.entities[-3:] == ("ORGANIZATION", "DATE_TIME", "URL")
    assert dev.exclude_entities == ("UK_NHS", "US_SSN", "US_PASSPORT", "US_DRIVER_LICENSE", "US_ITIN")
    assert prod.rule("EMAIL_ADDRESS").forbidden_context == ("dummy", "placeholder")
    assert len(rules_for("default").entities) == 14
    assert merge_layers({"a": {"x": 1, "y": [1]}, "b": 1}, {"a": {"y": [2]}, "b": {"z": 1}}) == {"a": {"x": 1, "y": [2]}, "b": {"z": 1}}
    assert unique([" a", "b", ""], ["b ", "c"]) == ["a", "b", "c"]


def test_disabled_engine_and_exclusion():
    off = spec_from({"rule_engine": {"enabled": False}}).rules
    assert not off.entity_rules and off.environment == "disabled" and off.min_score("PERSON") == 0.6
    rules = resolve_rules({"entities": ["A", "B"]}, {}, [{"include_entities": ["C"], "exclude_entities": ["A"]}])
    assert rules.entities == ("B", "C")
    assert resolve_rules({"entities": ["A"]}, {}, [{"exclude_entities": ["A"]}]).entities == ("A",)


def test_environment_choice():
    settings = {"environment_variable": "VEIL_ENV", "environment": "qa", "default_environment": "dev"}
    assert choose_environment(settings, {"VEIL_ENV": " prod "}) == "prod"
    assert choose_environment(settings, {}) == "qa"
    assert choose_environment({**settings, "environment": "${UNSET}"}, {"VEIL_ENV": ""}) == "dev"
    assert choose_environment({}, {}) == "default"


def test_layer_frames(spark):
    schema = "entity string, score_threshold double, min_length int"
    base = spark.createDataFrame([("A", 0.5, 3), ("B", 0.6, None)], schema)
    env = spark.createDataFrame([("A", 0.7, None), ("C", 0.1, 2)], schema)
    got = {r["entity"]: (r["score_threshold"], r["min_length"]) for r in layered_rule_frame(base, env).collect()}
    assert got == {"A": (0.7, 3), "B": (0.6, None), "C": (0.1, 2)}
    frame = rules_for("prod").frame(spark)
    assert frame.count() == 10 and frame.filter("entity = 'IN_PAN'").first()["context_window_chars"] == 80


def test_no_shuffle_and_one_evaluation(spark):
    plan = scan_text(texts(spark, PROFILE), "text", ScanSpec(rules_for("default")))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "BatchEvalPython" not in plan
    assert plan.count("inline(") == 2  # segments and spans, each generated once
