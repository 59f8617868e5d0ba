"""The registered queries. Each takes (spark, sf_dir), reads whole tables and returns plain columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilscan.functions import checks, paths, urls
from veilscan.functions.spans import regex_spans
from veilscan.operators import columns as cols
from veilscan.operators import recognisers as rec
from veilscan.operators.detect import Boost, DetectOptions
from veilscan.operators.findings import category_of, in_report_order
from veilscan.operators.postprocess import dedup_spans, resolve_same_span
from veilscan.operators.recognisers import Pattern, Recogniser
from veilscan.operators.report import entity_profile, findings_per_source, plugin_summary, source_rows
from veilscan.plans.config import ScanSpec, rules_for, spec_from
from veilscan.plans.scan import find_in_records, scan_records, scan_text
from veilscan.rules import EntityRule, RuleSet, layered_rule_frame, resolve_rules
from veilscan.schemas import SKIP, SOURCE
from veilscan.sources import files as fs
from veilscan.sources import tables as tb
from veilscan.sources.databases import database_findings
from veilscan.sources.docx import extracted
from veilscan.sources.records import small_batches, spread, spread_slim, text_records, union_all

from .derived import ACCOUNT_CUT, CUSTOMER_TEXT, EMAIL, HANDLE, K, ORDER_TEXT
from .docx_build import build_documents

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(load(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(load(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.col("html").alias("text")))


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole page behind its address."""
    text = F.concat(F.lit("Link <"), "url", F.lit("> of page "), "page_id", F.lit(": "), "html")
    return spread(load(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), text.alias("text")))


def customer_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread_slim(load(spark, sf_dir, "customer"), "c_custkey").selectExpr("c_custkey AS id", f"{CUSTOMER_TEXT} AS text")


def order_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread_slim(load(spark, sf_dir, "orders"), "o_orderkey").selectExpr("o_orderkey AS id", f"{ORDER_TEXT} AS text")


def spans(texts: DataFrame, pattern: Pattern) -> DataFrame:
    """Raw spans of one pattern: id, start, end, value."""
    found = texts.select("id", F.expr(f"inline_outer({regex_spans('text', pattern.jvm_regex)})")).filter("start IS NOT NULL")
    return found.select("id", "start", F.col("stop").alias("end"), "value")


def only(*recognisers: Recogniser, rules: RuleSet | None = None, resolve: bool = True, **detect) -> ScanSpec:
    """A scan with just these recognisers and no rules unless given."""
    base = rules or RuleSet(score_threshold=0.0)
    names = tuple(r.entity for r in recognisers)
    kept = RuleSet(
        entities=names,
        score_threshold=base.score_threshold,
        thresholds=base.thresholds,
        context_words=base.context_words,
        custom={"enable_indian_identifiers": False},
        entity_rules=base.entity_rules,
    )
    general = {r.entity for r in rec.general_recognisers()}
    extra = tuple(r for r in recognisers if r.entity not in general)
    return ScanSpec(kept, DetectOptions(resolve=resolve, **detect), extra_recognisers=extra)


GENERAL = {r.entity: r for r in rec.general_recognisers()}
INDIA = {r.entity: r for r in rec.india_recognisers({})}
NO_BOOST = Boost(enabled=False)
SPAN_COLUMNS = ["id", "entity_type", "start", "end", "value", "score"]


def scanned(texts: DataFrame, spec: ScanSpec) -> DataFrame:
    return scan_text(texts, "text", spec).withColumn("score", F.round("score", 4)).select(*SPAN_COLUMNS)


# ---- spans of single patterns -------------------------------------------------------------------------------


@query
def email_spans(spark, sf_dir):
    return spans(documents(spark, sf_dir), GENERAL["EMAIL_ADDRESS"].patterns[0])


@query
def ipv4_spans(spark, sf_dir):
    return spans(documents(spark, sf_dir), GENERAL["IP_ADDRESS"].patterns[0])


@query
def ipv6_spans(spark, sf_dir):
    return spans(customer_text(spark, sf_dir), GENERAL["IP_ADDRESS"].patterns[1])


@query
def url_spans(spark, sf_dir):
    return spans(page_links(spark, sf_dir), GENERAL["URL"].patterns[0])


@query
def iso_date_spans(spark, sf_dir):
    return spans(order_text(spark, sf_dir), GENERAL["DATE_TIME"].patterns[0])


@query
def bank_digit_spans(spark, sf_dir):
    return spans(documents(spark, sf_dir), INDIA["IN_BANK_ACCOUNT"].patterns[0])


@query
def phone_spans(spark, sf_dir):
    found = spans(documents(spark, sf_dir), GENERAL["PHONE_NUMBER"].patterns[0])
    return found.filter(F.expr(checks.phone_length(checks.digits_of("value"))))


@query
def pan_spans(spark, sf_dir):
    return spans(customer_text(spark, sf_dir), INDIA["IN_PAN"].patterns[0])


@query
def ifsc_spans(spark, sf_dir):
    return spans(customer_text(spark, sf_dir), INDIA["IN_IFSC"].patterns[0])


@query
def passport_spans(spark, sf_dir):
    return spans(customer_text(spark, sf_dir), INDIA["IN_PASSPORT"].patterns[0])


@query
def upi_strict(spark, sf_dir):
    return spans(customer_text(spark, sf_dir), INDIA["IN_UPI_ID"].patterns[0])


@query
def upi_generic(spark, sf_dir):
    both = {r.entity: r for r in rec.india_recognisers({"upi_generic_pattern": True})}["IN_UPI_ID"]
    return spans(customer_text(spark, sf_dir), both.patterns[1])


def _declared(entity: str, environment: str) -> Recogniser:
    return next(r for r in rec.declared_recognisers(rules_for(environment)) if r.entity == entity)


@query
def address_spans(spark, sf_dir):
    texts = customer_text(spark, sf_dir)
    found = [spans(texts, p).withColumn("pattern", F.lit(p.name)) for p in _declared("IN_ADDRESS", "default").patterns]
    return union_all(found)


@query
def name_label_spans(spark, sf_dir):
    return spans(customer_text(spark, sf_dir), _declared("PERSON", "prod").patterns[0])


@query
def rule_pattern_recogniser(spark, sf_dir):
    """A recogniser written in a rule file: hex digests, with a default score, among the default rules."""
    layer = {
        "additional_pattern_recognizers": [
            {"name": "HEX_DIGEST", "entity": "DIGEST", "patterns": [{"name": "hex", "regex": r"\b[0-9a-f]{32,64}\b"}]}
        ],
        "include_entities": ["DIGEST"],
    }
    rules = resolve_rules({"entities": ["DIGEST"], "score_threshold": 0.35}, {}, [layer])
    return scanned(documents(spark, sf_dir), ScanSpec(rules))


@query
def declared_python_patterns(spark, sf_dir):
    """Patterns of a rule file that Python knows and the JVM doesn't, each for an entity of its own; what has no JVM form or doesn't compile is left out."""
    patterns = {
        "BRACE": [r"{|\bwh{,2}en?an\b", "(broken"],
        "CONDITION": [r"(t)?hean(?(1)re|n)", r"(a)(?<=\1)b"],
        "NAMED": [r"(?P<twice>[hnt])(?P=twice)(?P<end>an\w*)"],
        "SCOPED": [r"\b(?-i:Th)e(?i:A)n\w+"],
        "SPACED": ["(?x) \\d{3} [.] # a network\n \\d{2}"],
        "NOTHING": [r"(a)(?<=\1)b"],
    }
    declared = [{"name": f"{e}_RECOGNIZER", "entity": e, "patterns": [{"name": f"p{k}", "regex": p} for k, p in enumerate(ps)]} for e, ps in patterns.items()]
    rules = resolve_rules({"entities": list(patterns), "score_threshold": 0.35}, {}, [{"additional_pattern_recognizers": declared}])
    return scanned(documents(spark, sf_dir), ScanSpec(rules, DetectOptions(resolve=False)))


# ---- checks -------------------------------------------------------------------------------------------------


@query
def credit_card_luhn(spark, sf_dir):
    card = GENERAL["CREDIT_CARD"].patterns[0]
    both = [
        spans(texts(spark, sf_dir), card).withColumn("source", F.lit(name))
        for name, texts in (("documents", documents), ("pages", pages))
    ]
    return union_all(both).withColumn("valid", F.expr(checks.luhn_valid(checks.digits_of("value"))))


@query
def iban_mod97(spark, sf_dir):
    found = spans(customer_text(spark, sf_dir), GENERAL["IBAN_CODE"].patterns[0])
    return found.withColumn("valid", F.expr(checks.iban_valid("value")))


@query
def aadhaar_verhoeff(spark, sf_dir):
    found = spans(order_text(spark, sf_dir), INDIA["IN_AADHAAR"].patterns[0])
    return found.withColumn("valid", F.expr(checks.aadhaar_valid(checks.digits_of("value"))))


@query
def aadhaar_validation_outcome(spark, sf_dir):
    """A passed check lifts the score to one, a failed one drops the span."""
    return scanned(order_text(spark, sf_dir), only(INDIA["IN_AADHAAR"], boost=NO_BOOST))


@query
def aadhaar_without_checksum(spark, sf_dir):
    """With the checksum switched off any twelve digits of the right shape pass."""
    return scanned(order_text(spark, sf_dir), only(rec.india_recognisers({"aadhaar_checksum_validation": False})[0], boost=NO_BOOST))


# ---- segments, context, thresholds and rules ----------------------------------------------------------------


@query
def chunked_scan(spark, sf_dir):
    """Documents cut into short segments give the same spans as whole documents."""
    from dataclasses import replace

    spec = only(GENERAL["EMAIL_ADDRESS"], GENERAL["IP_ADDRESS"], INDIA["IN_BANK_ACCOUNT"], boost=NO_BOOST, snippet_chars=None)
    return scanned(documents(spark, sf_dir), replace(spec, segment_chars=700, overlap_chars=100))


@query
def context_boost(spark, sf_dir):
    """Passports: the word 'passport' stands near some of them, and only those are lifted."""
    return scanned(customer_text(spark, sf_dir), only(INDIA["IN_PASSPORT"]))


@query
def scan_wide_context(spark, sf_dir):
    """A scan-wide word that a recogniser knows lifts all its spans."""
    rules = RuleSet(score_threshold=0.0, context_words=("passport office", "branch"))
    return scanned(customer_text(spark, sf_dir), only(INDIA["IN_PASSPORT"], INDIA["IN_IFSC"], rules=rules))


@query
def merged_context_words(spark, sf_dir):
    """Scan-wide words of the config and of a rule layer count together, stripped and each once."""
    layer = {"analyser_overrides": {"context_words": ["branch ", "passport office"]}}
    rules = resolve_rules({"score_threshold": 0.0, "context_words": [" passport office", ""]}, {}, [layer])
    return scanned(customer_text(spark, sf_dir), only(INDIA["IN_PASSPORT"], INDIA["IN_IFSC"], rules=rules))


@query
def rule_engine_off(spark, sf_dir):
    """A config without rules: base settings alone decide."""
    config = {"rule_engine": {"enabled": False}, "analyser": {"entities": ["EMAIL_ADDRESS", "IP_ADDRESS"], "context_enhancer": {"enabled": False}}}
    return scanned(documents(spark, sf_dir), spec_from(config))


@query
def global_threshold(spark, sf_dir):
    rules = RuleSet(score_threshold=0.58)
    return scanned(customer_text(spark, sf_dir), only(*INDIA.values(), rules=rules, boost=NO_BOOST))


@query
def entity_threshold(spark, sf_dir):
    """Base scores against a threshold table; entities without a threshold stay."""
    raw = scanned(customer_text(spark, sf_dir), only(*INDIA.values(), boost=NO_BOOST))
    thresholds = rules_for("default").threshold_frame(spark)
    joined = raw.withColumnRenamed("entity_type", "entity").join(F.broadcast(thresholds), "entity", "left")
    kept = joined.filter(F.col("score") >= F.coalesce("threshold", F.lit(0.0)))
    return kept.withColumnRenamed("entity", "entity_type").select(*SPAN_COLUMNS)


def _bank_like(rule: EntityRule) -> ScanSpec:
    """Digit runs under one entity rule, without the account guard."""
    digits = Recogniser("DIGIT_RUN", "digit_run", (Pattern("digit_run", rec.BANK_ACCOUNT, 0.5, 6),))
    return only(digits, rules=RuleSet(score_threshold=0.0, entity_rules={"DIGIT_RUN": rule}))


@query
def include_exclude_values(spark, sf_dir):
    ips = RuleSet(
        score_threshold=0.0,
        entity_rules={
            "EMAIL_ADDRESS": EntityRule(normalization="lower", exclude_values=("THE@MAIL1.EXAMPLE.COM", "und.34@mail7.example.com")),
            "CREDIT_CARD": EntityRule(normalization="digits", include_values=("4316 5226 7852 5456", "4465758382889437")),
        },
    )
    return scanned(documents(spark, sf_dir), only(GENERAL["EMAIL_ADDRESS"], GENERAL["CREDIT_CARD"], rules=ips, boost=NO_BOOST))


@query
def include_exclude_patterns(spark, sf_dir):
    rule = EntityRule(include_patterns=("MAIL[0-5][.]", "([bad"), exclude_patterns=("^the", r"[.]\d[02468]@"))
    rules = RuleSet(score_threshold=0.0, entity_rules={"EMAIL_ADDRESS": rule})
    return scanned(documents(spark, sf_dir), only(GENERAL["EMAIL_ADDRESS"], rules=rules, boost=NO_BOOST))


@query
def python_value_patterns(spark, sf_dir):
    """Rule patterns with named groups, conditionals, open-ended counts and literal braces; the last exclusion has no JVM form."""
    rule = EntityRule(include_patterns=(r"MAIL(?P<n>[0-5])[.]", "{"), exclude_patterns=(r"^(t)?h(?(1)e|a)", r"[.]\d(?=[02468]@)(?!x{,3}y)", r"(.)(?<=\1)"))
    rules = RuleSet(score_threshold=0.0, entity_rules={"EMAIL_ADDRESS": rule})
    return scanned(documents(spark, sf_dir), only(GENERAL["EMAIL_ADDRESS"], rules=rules, boost=NO_BOOST))


@query
def length_bounds(spark, sf_dir):
    return scanned(order_text(spark, sf_dir), _bank_like(EntityRule(normalization="digits", min_length=13, max_length=15)))


@query
def required_forbidden_context(spark, sf_dir):
    rule = EntityRule(required_context=("the", "que", "ein"), forbidden_context=("th ", "###"), context_window_chars=30)
    rules = RuleSet(score_threshold=0.0, entity_rules={"IP_ADDRESS": rule})
    return scanned(documents(spark, sf_dir), only(GENERAL["IP_ADDRESS"], rules=rules, boost=NO_BOOST))


@query
def disabled_entity(spark, sf_dir):
    """A rule that switches an entity off removes it; the others stay."""
    rules = RuleSet(score_threshold=0.0, entity_rules={"IP_ADDRESS": EntityRule(enabled=False)})
    both = only(GENERAL["IP_ADDRESS"], GENERAL["EMAIL_ADDRESS"], rules=rules, boost=NO_BOOST)
    return scanned(documents(spark, sf_dir), both)


@query
def bank_guard(spark, sf_dir):
    return scanned(order_text(spark, sf_dir), only(INDIA["IN_BANK_ACCOUNT"], boost=NO_BOOST))


@query
def phone_guard(spark, sf_dir):
    return scanned(order_text(spark, sf_dir), only(GENERAL["PHONE_NUMBER"], boost=NO_BOOST))


@query
def allow_list(spark, sf_dir):
    """Exact values and patterns that are not reported."""
    texts = documents(spark, sf_dir)
    exact = only(GENERAL["CREDIT_CARD"], boost=NO_BOOST, allow_list=("4316522678525456", "4465758382889437"))
    regex = only(GENERAL["EMAIL_ADDRESS"], boost=NO_BOOST, allow_list=("mail[1-3][.]", "^the"), allow_list_match="regex")
    return scanned(texts, exact).unionByName(scanned(texts, regex))


@query
def rules_left_join(spark, sf_dir):
    """Spans with the rule row of their entity; spans without a rule keep nulls."""
    spec = only(GENERAL["EMAIL_ADDRESS"], GENERAL["CREDIT_CARD"], GENERAL["IP_ADDRESS"], boost=NO_BOOST)
    rules = rules_for("default").frame(spark).withColumnRenamed("entity", "entity_type")
    joined = scanned(documents(spark, sf_dir), spec).join(F.broadcast(rules), "entity_type", "left")
    return joined.select(
        "id", "entity_type", "start", "end", "score_threshold", "context_window_chars",
        F.concat_ws("|", "forbidden_context").alias("forbidden"),
        (F.col("score") >= F.coalesce("score_threshold", F.lit(0.0))).alias("passes"),
    )


def _overlapping() -> ScanSpec:
    """Recognisers whose spans coincide: digit runs as accounts, phones and cards, and an entity named twice."""
    again = Recogniser("IN_BANK_ACCOUNT", "second", (Pattern("wide_digits", r"\b\d{8,19}\b", 0.6, 6),))
    accounts = Recogniser("IN_BANK_ACCOUNT", "first", INDIA["IN_BANK_ACCOUNT"].patterns)
    unranked = Recogniser("DIGIT_RUN", "digit_run", (Pattern("digit_run", r"\b\d{6,22}\b", 0.95, 6),))
    general = (GENERAL["PHONE_NUMBER"], GENERAL["CREDIT_CARD"])
    return only(*general, INDIA["IN_AADHAAR"], accounts, again, unranked, resolve=False, boost=NO_BOOST)


@query
def dedup_spans_best_score(spark, sf_dir):
    raw = scan_text(order_text(spark, sf_dir), "text", _overlapping())
    return dedup_spans(raw, "id").withColumn("score", F.round("score", 4)).select(*SPAN_COLUMNS)


@query
def same_span_winner(spark, sf_dir):
    """Window form of the winner rule over the raw spans."""
    raw = scan_text(order_text(spark, sf_dir), "text", _overlapping())
    winners = resolve_same_span(raw, "id")
    return winners.withColumn("score", F.round("score", 4)).select(*SPAN_COLUMNS)


@query
def same_span_winner_in_row(spark, sf_dir):
    """The same winners, found inside the row without a shuffle."""
    from dataclasses import replace

    spec = _overlapping()
    return scanned(order_text(spark, sf_dir), replace(spec, detect=replace(spec.detect, resolve=True)))


# ---- whole scans --------------------------------------------------------------------------------------------


def _scan(texts: DataFrame, environment: str) -> DataFrame:
    found = scan_text(texts, "text", ScanSpec(rules_for(environment)))
    return found.select(
        "id",
        "entity_type",
        category_of("entity_type").alias("category"),
        F.round("score", 4).alias("score"),
        F.col("value").alias("text"),
        "start",
        "end",
        "snippet",
    )


@query
def scan_documents(spark, sf_dir):
    return _scan(documents(spark, sf_dir), "default")


@query
def scan_documents_dev(spark, sf_dir):
    return _scan(documents(spark, sf_dir), "dev")


@query
def scan_pages(spark, sf_dir):
    return _scan(pages(spark, sf_dir), "default")


@query
def scan_page_links_dev(spark, sf_dir):
    """The dev environment also reports URLs and dates."""
    return _scan(page_links(spark, sf_dir), "dev")


@query
def scan_customer_text(spark, sf_dir):
    return _scan(customer_text(spark, sf_dir), "default")


@query
def scan_customer_text_prod(spark, sf_dir):
    return _scan(customer_text(spark, sf_dir), "prod")


@query
def scan_order_text(spark, sf_dir):
    return _scan(order_text(spark, sf_dir), "default")


@query
def scan_order_text_prod(spark, sf_dir):
    return _scan(order_text(spark, sf_dir), "prod")


# ---- findings, sources and report ---------------------------------------------------------------------------

PLAIN_RULES = RuleSet(
    entities=("EMAIL_ADDRESS", "CREDIT_CARD", "IP_ADDRESS"),
    score_threshold=0.35,
    custom={"enable_indian_identifiers": False},
)


def _doc_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_records(spread(load(spark, sf_dir, "documents").select("doc_id", "text")), "documents", "doc_id", "text")


def _page_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_records(spread(load(spark, sf_dir, "pages").select("page_id", "html")), "pages", "page_id", "html")


def _conversation_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spread_slim(load(spark, sf_dir, "conversations"), "conv_id", "turn").withColumn("turn_id", F.concat_ws("-", "conv_id", "turn"))
    return text_records(turns, "conversations", "turn_id", "text")


FINDING_VIEW = ["file_path", "entity_type", "category", "score", "text", "start", "end", "recognizer_name", "snippet"]


@query
def finding_projection(spark, sf_dir):
    return find_in_records(_doc_records(spark, sf_dir), ScanSpec(PLAIN_RULES)).select(*FINDING_VIEW)


@query
def category_profile(spark, sf_dir):
    return entity_profile(find_in_records(_doc_records(spark, sf_dir), ScanSpec(PLAIN_RULES)))


@query
def union_sources(spark, sf_dir):
    """Documents, pages and conversations as one set of sources."""
    records = union_all(f(spark, sf_dir) for f in (_doc_records, _page_records, _conversation_records))
    return find_in_records(records, ScanSpec(PLAIN_RULES)).select("file_path", "entity_type", "start", "end", "text", "score")


@query
def optional_columns(spark, sf_dir):
    """Findings without source metadata, snippets and hashes."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    spec = ScanSpec(PLAIN_RULES, DetectOptions(snippet_chars=None), keep_source_metadata=False)
    found = find_in_records(text_records(docs, "documents", "doc_id", "text"), spec)
    return found.select("file_path", "entity_type", "start", "end", "snippet", "file_hash", F.lit(len(found.columns)).alias("columns"))


def _gated_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and pages as two plugins; texts over 8,000 bytes are skipped with a reason."""
    parts = []
    for name, records in (("documents", _doc_records(spark, sf_dir)), ("pages", _page_records(spark, sf_dir))):
        too_large = F.octet_length("text") > 8000
        parts.append(
            records.withColumn("plugin_name", F.lit(name))
            .withColumn("record_type", F.when(too_large, SKIP).otherwise(SOURCE))
            .withColumn("reason", F.when(too_large, "File larger than 8000 bytes"))
        )
    return union_all(parts)


def _whole_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents and pages as two plugins."""
    both = (("documents", _doc_records(spark, sf_dir)), ("pages", _page_records(spark, sf_dir)))
    return union_all(records.withColumn("plugin_name", F.lit(name)) for name, records in both)


@query
def scan_status(spark, sf_dir):
    result = scan_records(_gated_records(spark, sf_dir), ScanSpec(PLAIN_RULES))
    return result.sources.select("file_path", "status", "reason", "error", "findings_count", "source_plugin")


@query
def global_counts(spark, sf_dir):
    return scan_records(_whole_records(spark, sf_dir), ScanSpec(PLAIN_RULES)).stats


@query
def plugin_counts(spark, sf_dir):
    result = scan_records(_whole_records(spark, sf_dir), ScanSpec(PLAIN_RULES))
    return plugin_summary(spark, source_rows(result.records), result.findings, ["documents", "pages", "database"])


@query
def findings_count_per_source(spark, sf_dir):
    return findings_per_source(find_in_records(_doc_records(spark, sf_dir), ScanSpec(PLAIN_RULES)))


@query
def blank_sources(spark, sf_dir):
    """All documents, and beside each a text of as many blanks: those have no findings but keep their status row."""
    blanks = spread(load(spark, sf_dir, "documents").select("doc_id", F.regexp_replace("text", r"(?s).", " ").alias("text")))
    records = union_all([_doc_records(spark, sf_dir), text_records(blanks, "blanks", "doc_id", "text")])
    result = scan_records(records, ScanSpec(PLAIN_RULES))
    return result.sources.groupBy("status", F.col("file_path").startswith("table://blanks/").alias("blank")).agg(
        F.count("*").alias("sources"), F.sum("findings_count").alias("findings"), F.count_if(F.col("findings_count") > 0).alias("with_findings")
    )


@query
def findings_sorted_topk(spark, sf_dir):
    """The first fifty findings in report order."""
    found = find_in_records(_doc_records(spark, sf_dir), ScanSpec(PLAIN_RULES))
    return in_report_order(found).select("file_path", "start", "end", "score", "entity_type", "text").limit(50)


@query
def content_hash(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return text_records(docs, "documents", "doc_id", "text", hash_text=True).select("source_path", "content_hash")


@query
def text_decode(spark, sf_dir):
    """Bytes with CRLF line ends and invalid sequences, decoded to clean text."""
    raw = F.concat(F.to_binary(F.lit("FFFE41"), F.lit("hex")), F.encode(F.replace("text", F.lit(" "), F.lit("\r\n")), "UTF-8"), F.to_binary(F.lit("C342E28241"), F.lit("hex")))
    decoded = load(spark, sf_dir, "documents").select("doc_id", raw.alias("content")).select(
        "doc_id", F.expr(fs.decoded("content")).alias("text"), F.expr(fs.decoded("content", newlines=False)).alias("binary_text")
    )
    return decoded.select("doc_id", F.sha2("text", 256).alias("text_hash"), F.length("text").alias("chars"), F.length("binary_text").alias("binary_chars"))


@query
def docx_extract(spark, sf_dir):
    """Documents packed into DOCX bytes, one paragraph per line, and extracted again."""
    texts = small_batches(spread(load(spark, sf_dir, "documents").select("doc_id", "text")))
    packed = texts.mapInPandas(build_documents, "doc_id bigint, content binary")
    return extracted(packed, "doc_id bigint, text string, error string").select("doc_id", F.sha2("text", 256).alias("text_hash"), "error")


# ---- paths and file filters ---------------------------------------------------------------------------------


def _page_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Absolute paths made from page URLs, with a file name for those that end in a directory."""
    path = F.regexp_replace(F.regexp_replace("url", r"[?#].*$", ""), "^https?://", "/data/")
    named = F.when(path.endswith("/"), F.concat(path, F.lit("index.HTML"))).otherwise(path)
    tail = F.expr("CASE page_id % 5 WHEN 0 THEN '/notes.txt' WHEN 1 THEN '.TXT' WHEN 2 THEN '/node_modules/a.json' WHEN 3 THEN '' ELSE '/cache.pyc' END")
    return load(spark, sf_dir, "pages").select("page_id", F.concat(named, tail).alias("path"))


@query
def path_mask_basename(spark, sf_dir):
    return _page_paths(spark, sf_dir).select("page_id", F.expr(paths.masked("path", "basename", [])).alias("masked"))


@query
def path_mask_relative(spark, sf_dir):
    found = _page_paths(spark, sf_dir)
    return found.select("page_id", F.expr(paths.masked("path", "relative", ["/data/blog.", "/data/m.ththth.example.net/", "/data/m.therou.example.com"])).alias("masked"))


@query
def path_mask_hash(spark, sf_dir):
    return _page_paths(spark, sf_dir).select("page_id", F.expr(paths.masked("path", "hash", [], "salt")).alias("masked"))


@query
def path_mask_redacted(spark, sf_dir):
    both = _page_paths(spark, sf_dir)
    return both.select("page_id", F.expr(paths.masked("path", "redacted", [])).alias("masked"), F.expr(paths.masked("path", "unknown", [])).alias("unmasked"))


@query
def file_filters(spark, sf_dir):
    """Extension, glob and directory tests on every path."""
    return _page_paths(spark, sf_dir).select(
        "page_id",
        F.expr(paths.suffix("path")).alias("suffix"),
        fs.extension_allowed("path", (".txt", ".html", ".JSON")).alias("extension_ok"),
        fs.glob_excluded("path", ("*.pyc", "*/en/7*", "not[!a-m]s.t?t")).alias("glob_hit"),
        fs.dir_pruned("path", "/data", ("node_modules", "fr", "data")).alias("pruned"),
    )


# ---- rule layers --------------------------------------------------------------------------------------------


@query
def layered_rules(spark, sf_dir):
    """A base layer per customer, overridden where that customer's orders say otherwise."""
    base = load(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("entity"),
        F.col("c_acctbal").alias("score_threshold"),
        F.col("c_nationkey").alias("min_length"),
        F.array("c_mktsegment", F.lit("any")).alias("required_context"),
    )
    override = load(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("entity")).agg(
        F.when(F.count("*") > 9, F.max("o_totalprice")).alias("score_threshold"),
        F.lit(None).cast("int").alias("min_length"),
        F.when(F.min("o_orderpriority") == "1-URGENT", F.array(F.min("o_orderpriority"))).alias("required_context"),
    )
    merged = layered_rule_frame(base, override)
    return merged.withColumn("required_context", F.concat_ws("|", "required_context"))


ENVIRONMENTS = ("default", "dev", "qa", "prod")


def _pages_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unruled spans of the general entities in pages, counted once."""
    wanted = [GENERAL[e] for e in ("EMAIL_ADDRESS", "CREDIT_CARD", "IP_ADDRESS", "URL", "PHONE_NUMBER")]
    return scanned(page_links(spark, sf_dir), only(*wanted, boost=NO_BOOST)).groupBy("entity_type").agg(F.count("*").alias("n"))


@query
def effective_entities(spark, sf_dir):
    """Spans per environment whose entity is on that environment's effective list."""
    rows = [(env, entity) for env in ENVIRONMENTS for entity in rules_for(env).entities]
    listed = spark.createDataFrame(rows, "environment string, entity_type string")
    return _pages_raw(spark, sf_dir).join(F.broadcast(listed), "entity_type").select("environment", "entity_type", "n")


@query
def effective_thresholds(spark, sf_dir):
    """Base-score spans of customer texts that reach each environment's threshold."""
    entities = [*INDIA, "EMAIL_ADDRESS"]
    rows = [(env, e, rules_for(env).min_score(e)) for env in ENVIRONMENTS for e in entities]
    floors = spark.createDataFrame(rows, "environment string, entity_type string, min_score double")
    spec = only(*INDIA.values(), GENERAL["EMAIL_ADDRESS"], boost=NO_BOOST)
    counted = scanned(customer_text(spark, sf_dir), spec).groupBy("entity_type", "score").agg(F.count("*").alias("n"))
    joined = counted.join(F.broadcast(floors), "entity_type")
    return joined.groupBy("environment", "entity_type", "min_score").agg(
        F.sum("n").alias("spans"), F.sum(F.when(F.col("score") >= F.col("min_score"), F.col("n")).otherwise(0)).alias("kept")
    )


# ---- databases, tables and columns --------------------------------------------------------------------------


@query
def db_targets(spark, sf_dir):
    """Databases named after nations, selected and excluded without regard to case."""
    found = load(spark, sf_dir, "customer").join(load(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    names = found.groupBy(F.concat(F.lit(" Db_"), "n_name").alias("name")).agg(F.count("*").alias("tables"))
    chosen = tb.select_databases(names, exclude=("db_nation_3", "DB_NATION_11 ", "DB_FRANCE"))
    named = tb.select_databases(names, include=("DB_NATION_1", "db_nation_2", "db_india"), exclude=("db_nation_2",))
    return chosen.withColumn("mode", F.lit("all")).unionByName(named.withColumn("mode", F.lit("named")))


@query
def table_filters(spark, sf_dir):
    """Parts as tables (type) in schemas (brand): include, exclude and schema lists."""
    catalog = load(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("schema"), F.col("p_type").alias("table")).agg(F.count("*").alias("n"))
    wanted = tb.TableFilter(include=("economy", "Brand#1.STANDARD", "promo"), exclude=("brand#2.ECONOMY", "Promo"), exclude_schemas=("BRAND#5",))
    return tb.filter_tables(catalog, wanted)


@query
def table_filters_by_frame(spark, sf_dir):
    """Long include and exclude lists as frames, taken from orders and suppliers."""
    catalog = load(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("schema"), F.concat(F.lit("T"), "c_custkey").alias("table"))
    include = load(spark, sf_dir, "orders").select(F.concat(F.lit("t"), "o_custkey").alias("name")).distinct()
    exclude = load(spark, sf_dir, "supplier").select(F.concat(F.lit("machinery.t"), "s_suppkey").alias("name"))
    return tb.filter_tables_by_frame(catalog, include, exclude)


def _connections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A connection per customer: type, engine, host and URL in many spellings."""
    return load(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS id",
        "split_part(' Postgres,,rds,MariaDB,sqlserver,RDS_mysql,snowflake,pgsql', ',', CAST(c_custkey % 8 + 1 AS INT)) AS kind",
        "CASE WHEN c_custkey % 3 = 0 THEN ' mysql ' ELSE '' END AS engine",
        "CASE WHEN c_custkey % 4 = 0 THEN concat('host', c_nationkey) ELSE '' END AS host",
        "concat(split_part('postgresql+psycopg2,mysql,sqlite3,MSSQL+pyodbc,oracle', ',', CAST(c_custkey % 5 + 1 AS INT)), '://u', c_custkey, ':p@h', "
        "c_nationkey, ':5432', CASE WHEN c_custkey % 2 = 0 THEN concat('/', lower(c_mktsegment)) ELSE '' END, "
        "CASE WHEN c_custkey % 7 = 0 THEN '?ssl=1' ELSE '' END) AS url",
    )


@query
def source_type_alias(spark, sf_dir):
    found = _connections(spark, sf_dir)
    return found.select("id", F.expr(urls.source_type("kind", "engine", "url")).alias("source_type"), F.expr(urls.scheme("url")).alias("scheme"))


@query
def url_parts(spark, sf_dir):
    return _connections(spark, sf_dir).select(
        "id",
        F.expr(urls.endpoint("host", "url")).alias("endpoint"),
        F.expr(urls.database_of("url")).alias("database"),
        F.expr(urls.with_database("url", "'archive'")).alias("archive_url"),
        F.expr(urls.discovery_url("'postgresql'", "url")).alias("discovery_url"),
    )


@query
def column_name_pii(spark, sf_dir):
    """Column names made from parts, tested against the name words."""
    name = "concat(replace(p_name, ' ', '_'), '_', split_part('email,Phone_No,pan,ip_address,colour,company,passport,span,full_name,IFSC', ',', CAST(p_size % 10 + 1 AS INT)))"
    names = load(spark, sf_dir, "part").selectExpr("p_brand AS table", f"{name} AS column").distinct()
    return cols.column_names_pii(names)


def _value_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    customer = spread_slim(load(spark, sf_dir, "customer"), "c_custkey")
    contact = customer.selectExpr(
        "c_custkey", f"{EMAIL} AS contact_email", f"{HANDLE} AS login", "c_name", "c_mktsegment",
        f"CASE WHEN {K} % 4 = 0 THEN NULL WHEN {K} % 4 = 3 THEN 'unknown' ELSE concat('10.0.', CAST({K} % 250 AS STRING), '.', CAST(c_nationkey AS STRING)) END AS origin",
    )
    ledger = spread_slim(load(spark, sf_dir, "orders"), "o_orderkey").selectExpr(f"{ACCOUNT_CUT} AS ref", "o_orderpriority", "o_orderstatus")
    return {
        "crm.contact": contact,
        "ledger": ledger,
        "documents": spread(load(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")),
        "events": load(spark, sf_dir, "events").select("event_type", "props"),
    }


PROFILED = ("EMAIL_ADDRESS", "IP_ADDRESS", "CREDIT_CARD")


def _profilers() -> list[Recogniser]:
    return [*(GENERAL[e] for e in PROFILED), INDIA["IN_BANK_ACCOUNT"]]


@query
def column_value_pii(spark, sf_dir):
    profiles = []
    for key, table in _value_tables(spark, sf_dir).items():
        schema, _, name = key.rpartition(".")
        profiles.append(cols.value_profile(table, name, _profilers(), schema))
    return union_all(profiles)


@query
def flagged_columns(spark, sf_dir):
    """Columns flagged by name or because at least half of their values hold personal data."""
    found = cols.discover_columns(_value_tables(spark, sf_dir), _profilers())
    return found.select("schema", "table", "column", "pii_type", "hit_rate", "by_name", "by_value")


def _detector_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detector output derived from events, with values under several alias names."""
    return load(spark, sf_dir, "events").selectExpr(
        "CASE WHEN user_id % 3 = 0 THEN ' ' ELSE 'Sales' END AS schema_name",
        "concat('T_', event_type) AS table_name",
        "CASE WHEN user_id % 5 = 0 THEN '' ELSE 'Orders' END AS table",
        "CASE WHEN event_id % 11 = 0 THEN '  ' ELSE concat('Col', user_id) END AS column_name",
        "CASE WHEN event_id % 2 = 0 THEN NULL ELSE 'EMAIL_ADDRESS' END AS entity_type",
        "CASE WHEN value > 20 THEN 'PHONE_NUMBER' ELSE '' END AS detector",
    )


@query
def detector_output_normalise(spark, sf_dir):
    out = cols.normalise_detections(_detector_rows(spark, sf_dir))
    return out.groupBy("schema", "table", "column", "pii_type").agg(F.count("*").alias("n"))


@query
def detection_catalog(spark, sf_dir):
    catalog = cols.detection_catalog(cols.normalise_detections(_detector_rows(spark, sf_dir)))
    return catalog.withColumn("pii_types", F.concat_ws("|", "pii_types"))


@query
def detection_counts(spark, sf_dir):
    return cols.detection_counts(cols.normalise_detections(_detector_rows(spark, sf_dir)))


@query
def column_findings(spark, sf_dir):
    catalog = cols.detection_catalog(cols.normalise_detections(_detector_rows(spark, sf_dir)))
    records = cols.column_records(catalog, "crm:main", "postgresql", "db.example.com", "main")
    found = cols.column_findings(records)
    return found.select("file_path", "entity_type", "category", "score", "text", "start", "end", F.col("source_metadata.connection").alias("connection"))


@query
def precomputed_findings(spark, sf_dir):
    """Findings of flagged columns join those from texts, whether they come as a frame or from the records."""
    catalog = cols.detection_catalog(cols.normalise_detections(_detector_rows(spark, sf_dir)))
    columns = cols.column_records(catalog, "crm:main", "postgresql", "db.example.com", "main")
    as_frame = scan_records(_doc_records(spark, sf_dir), ScanSpec(PLAIN_RULES), cols.column_findings(columns))
    from_records = scan_records(union_all([_doc_records(spark, sf_dir), columns]), ScanSpec(PLAIN_RULES), database_findings)
    parts = [r.findings.select(F.lit(way).alias("way"), "file_path", "entity_type", "start", "end", "text", "score") for way, r in (("frame", as_frame), ("records", from_records))]
    return union_all(parts)


@query
def column_samples(spark, sf_dir):
    options = cols.SampleOptions.from_config({"limit": 7, "max_chars": 1}, {"max_chars": 16})
    customer = cols.column_samples(load(spark, sf_dir, "customer"), ["c_name", "c_mktsegment", "c_acctbal"], options)
    docs = cols.column_samples(load(spark, sf_dir, "documents"), ["text", "lang"], options)
    return customer.withColumn("table", F.lit("customer")).unionByName(docs.withColumn("table", F.lit("documents")))


@query
def connection_summary(spark, sf_dir):
    """Connections and tables per source type, as the report's config section lists them."""
    kinds = _connections(spark, sf_dir).select("id", F.expr(urls.source_type("kind", "engine", "url")).alias("source_type"))
    tables = load(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").alias("tables"))
    joined = kinds.join(tables, "id", "left")
    return joined.groupBy("source_type").agg(F.count("*").alias("connections"), F.coalesce(F.sum("tables"), F.lit(0)).alias("tables"))
