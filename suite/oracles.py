"""DuckDB counterparts of the registered queries, written from the rules and not from the library.

RE2 has neither lookaround nor a Unicode word boundary. Non-ASCII letters are therefore replaced by '_' (a word
character) in the text that patterns see; lookaround becomes a test of the neighbouring characters.
"""

from __future__ import annotations

from .derived import ACCOUNT_CUT, CUSTOMER_TEXT, EMAIL, HANDLE, K, ORDER_TEXT

ORACLES: dict[str, str] = {}

DOCS = "SELECT doc_id AS id, text FROM documents"
PAGES = "SELECT page_id AS id, html AS text FROM pages"
LINKS = "SELECT page_id AS id, concat('Link <', url, '> of page ', page_id, ': ', html) AS text FROM pages"
CUSTOMERS = f"SELECT c_custkey AS id, {CUSTOMER_TEXT} AS text FROM customer"
ORDERS = f"SELECT o_orderkey AS id, {ORDER_TEXT} AS text FROM orders"


def q(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def spans(source: str, pattern: str, guard: str = "true") -> str:
    """id, text, s, e, value of every match; ``guard`` may test the neighbours ``pre`` and ``post``."""
    return f"""SELECT id, text, s, e, value FROM (
      SELECT id, text, s, e, substr(text, s + 1, e - s) AS value,
             CASE WHEN s = 0 THEN '' ELSE substr(text, s, 1) END AS pre, substr(text, e + 1, 1) AS post
      FROM (
        SELECT id, text, CAST(list_sum(list_transform(g[1:i], lambda x: length(x)))
               + coalesce(list_sum(list_transform(v[1:i-1], lambda x: length(x))), 0) AS INTEGER) AS s,
               CAST(list_sum(list_transform(g[1:i], lambda x: length(x)))
               + list_sum(list_transform(v[1:i], lambda x: length(x))) AS INTEGER) AS e
        FROM (SELECT id, text, regexp_extract_all(t, {q(pattern)}) AS v, string_split_regex(t, {q(pattern)}) AS g
              FROM (SELECT id, text, regexp_replace(text, '[^\\x00-\\x7F]', '_', 'g') AS t FROM ({source})))
             , unnest(range(1, len(v) + 1)) AS u(i))) WHERE {guard}"""


# The patterns, in RE2 form.
I = "(?ims)"
EMAIL_RE = I + r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
IPV4_RE = I + r"\b(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)\b"
IPV6_RE = I + r"\b(?:[0-9a-f]{1,4}:){7}[0-9a-f]{1,4}\b"
URL_RE = I + r"""\bhttps?://[^\s<>"']+"""
DATE_RE = I + r"\d{4}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])"
BANK_RE = I + r"\b\d{9,18}\b"
PHONE_RE = I + r"(?:\+\d{1,3}[ -]?(?:\(\d{2,5}\)[ -]?)?|\(\d{2,5}\)[ -]?|\b)\d{3,5}(?:[ -]?\d{3,5}){1,2}\b"
CARD_RE = I + r"\b(?:\d{13,19}|\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{1,7}|\d{4}[ -]\d{6}[ -]\d{4,5})\b"
IBAN_RE = r"\b[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)\b"
PAN_RE = I + r"\b[A-Z]{5}[0-9]{4}[A-Z]\b"
IFSC_RE = I + r"\b[A-Z]{4}0[A-Z0-9]{6}\b"
PASSPORT_RE = I + r"\b[A-PR-WYa-pr-wy][1-9]\d{6}\b"
UPI_RE = I + r"\b[a-zA-Z0-9._-]{2,}@(?:upi|ybl|ibl|axl|paytm|okhdfcbank|okicici|oksbi|okaxis)\b"
UPI_ANY_RE = I + r"\b[a-zA-Z0-9._-]{2,}@[a-zA-Z]{2,64}\b"
AADHAAR_RE = I + r"[2-9]\d{3}\s?\d{4}\s?\d{4}"
ADDRESS_RE = I + r"\b(?:address|addr)\s*[:\-]\s*[A-Za-z0-9 ,./#\-]{12,180}"
PINCODE_RE = (
    I + r"\b(?:flat|house|plot|building|street|st|road|rd|lane|ln|nagar|sector)\b[\w ,./#\-]{0,120}\b\d{6}\b"
)
NAME_RE = (
    I + r"\b(?:full\s*name|customer\s*name|beneficiary\s*name|applicant\s*name|employee\s*name|name)"
    r"\s*[:\-]\s*[A-Z][A-Za-z' .-]{2,60}"
)
NO_DIGITS = "NOT regexp_matches(pre, '[0-9]') AND NOT regexp_matches(post, '[0-9]')"

DIGITS = "regexp_replace(value, '[^0-9]', '', 'g')"


def phone_ok() -> str:
    return f"length({DIGITS}) BETWEEN 10 AND 13"


def luhn(digits: str = DIGITS) -> str:
    """Sum over reversed digits, every second one doubled less nine."""
    at = f"CAST(substr(reverse({digits}), i, 1) AS INTEGER)"
    return (
        f"list_sum(list_transform(range(1, length({digits}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN {at} "
        f"WHEN {at} > 4 THEN {at} * 2 - 9 ELSE {at} * 2 END)) % 10 = 0"
    )


# Product table of the dihedral group of order ten, and the permutations of the digits by place.
VERHOEFF_PRODUCT = [
    [0, 1, 2, 3, 4, 5, 6, 7, 8, 9],
    [1, 2, 3, 4, 0, 6, 7, 8, 9, 5],
    [2, 3, 4, 0, 1, 7, 8, 9, 5, 6],
    [3, 4, 0, 1, 2, 8, 9, 5, 6, 7],
    [4, 0, 1, 2, 3, 9, 5, 6, 7, 8],
    [5, 9, 8, 7, 6, 0, 4, 3, 2, 1],
    [6, 5, 9, 8, 7, 1, 0, 4, 3, 2],
    [7, 6, 5, 9, 8, 2, 1, 0, 4, 3],
    [8, 7, 6, 5, 9, 3, 2, 1, 0, 4],
    [9, 8, 7, 6, 5, 4, 3, 2, 1, 0],
]
VERHOEFF_PERMUTATION = [
    [0, 1, 2, 3, 4, 5, 6, 7, 8, 9],
    [1, 5, 7, 6, 2, 8, 3, 0, 9, 4],
    [5, 8, 0, 3, 7, 9, 6, 1, 4, 2],
    [8, 9, 1, 6, 0, 4, 3, 5, 2, 7],
    [9, 4, 5, 3, 1, 2, 6, 8, 7, 0],
    [4, 2, 8, 6, 5, 7, 3, 9, 0, 1],
    [2, 7, 9, 3, 8, 0, 6, 4, 1, 5],
    [7, 0, 4, 6, 9, 1, 3, 2, 5, 8],
]


def verhoeff(digits: str = DIGITS) -> str:
    """The textbook tables of the scheme, applied to the reversed digits."""
    product, permutation = VERHOEFF_PRODUCT, VERHOEFF_PERMUTATION
    digit = f"CAST(substr(reverse({digits}), i + 1, 1) AS INTEGER)"
    permuted = f"list_transform(range(0, length({digits})), lambda i: {permutation}[i % 8 + 1][{digit} + 1])"
    return f"list_reduce(list_concat([0], {permuted}), lambda a, b: {product}[a + 1][b + 1]) = 0"


def iban(value: str = "value") -> str:
    compact = f"upper(regexp_replace({value}, '[^A-Za-z0-9]', '', 'g'))"
    moved = f"concat(substr({compact}, 5), substr({compact}, 1, 4))"
    code = (
        f"CASE WHEN regexp_matches(substr({moved}, i, 1), '[0-9]') THEN substr({moved}, i, 1) "
        f"ELSE CAST(ascii(substr({moved}, i, 1)) - 55 AS VARCHAR) END"
    )
    number = f"array_to_string(list_transform(range(1, length({moved}) + 1), lambda i: {code}), '')"
    digits = f"list_transform(string_split({number}, ''), lambda c: CAST(c AS INTEGER))"
    return f"list_reduce({digits}, lambda a, b: (a * 10 + b) % 97) = 1"


def window(chars: int) -> str:
    return f"lower(substr(text, greatest(s - {chars}, 0) + 1, e + {chars} - greatest(s - {chars}, 0)))"


def has_any(text: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, {q(w)})" for w in words) + ")"


def needs(words: list[str], chars: int) -> str:
    return has_any(window(chars), words)


def tokens(text: str) -> str:
    # The character class keeps the accented letters of the test texts inside their words.
    return f"list_filter(string_split_regex(lower({text}), '[^\\p{{L}}\\p{{N}}_]+'), lambda x: x <> '')"


def near(words: list[str]) -> str:
    """A word inside one of the eight tokens before or the two tokens after."""
    before = f"{tokens('substr(text, 1, s)')}"
    after = f"{tokens('substr(text, e + 1)')}"
    return "(" + " OR ".join(
        f"len(list_filter(list_concat(({before})[-8:], ({after})[1:2]), lambda x: contains(x, {q(w)}))) > 0" for w in words
    ) + ")"


def flat(sql: str) -> str:
    return f'SELECT id, s AS start, e AS "end", value FROM ({sql})'


def scored(sql: str, entity: str, score: float | str, keep: str = "true") -> str:
    return (
        f"SELECT id, {q(entity)} AS entity_type, s AS start, e AS \"end\", value, "
        f"CAST(round({score}, 4) AS DOUBLE) AS score FROM ({sql}) WHERE {keep}"
    )


def union(*parts: str) -> str:
    return " UNION ALL ".join(f"({p})" for p in parts)


ORACLES["email_spans"] = flat(spans(DOCS, EMAIL_RE))
ORACLES["ipv4_spans"] = flat(spans(DOCS, IPV4_RE))
ORACLES["ipv6_spans"] = flat(spans(CUSTOMERS, IPV6_RE))
ORACLES["url_spans"] = flat(spans(LINKS, URL_RE))
ORACLES["iso_date_spans"] = flat(spans(ORDERS, DATE_RE, NO_DIGITS))
ORACLES["bank_digit_spans"] = flat(spans(DOCS, BANK_RE))
ORACLES["phone_spans"] = flat(spans(DOCS, PHONE_RE)) + f" WHERE {phone_ok()}"
ORACLES["pan_spans"] = flat(spans(CUSTOMERS, PAN_RE))
ORACLES["ifsc_spans"] = flat(spans(CUSTOMERS, IFSC_RE))
ORACLES["passport_spans"] = flat(spans(CUSTOMERS, PASSPORT_RE))
ORACLES["upi_strict"] = flat(spans(CUSTOMERS, UPI_RE))
ORACLES["upi_generic"] = flat(spans(CUSTOMERS, UPI_ANY_RE))
ORACLES["address_spans"] = union(
    f"SELECT *, 'india_address_labelled' AS pattern FROM ({flat(spans(CUSTOMERS, ADDRESS_RE))})",
    f"SELECT *, 'india_address_with_pincode' AS pattern FROM ({flat(spans(CUSTOMERS, PINCODE_RE))})",
)
ORACLES["name_label_spans"] = flat(spans(CUSTOMERS, NAME_RE))
ORACLES["rule_pattern_recogniser"] = scored(spans(DOCS, I + r"\b[0-9a-f]{32,64}\b"), "DIGEST", 0.5)

ORACLES["declared_python_patterns"] = union(
    *(
        scored(spans(DOCS, I + regex), entity, 0.5)
        for entity, regex in (
            ("BRACE", r"\{|\bwh{0,2}en?an\b"),
            ("CONDITION", r"theanre|heann"),
            ("NAMED", r"(?:hh|nn|tt)an\w*"),
            ("SCOPED", r"\b(?-i:Th)ean\w+"),
            ("SPACED", r"\d{3}[.]\d{2}"),
        )
    )
)

ORACLES["credit_card_luhn"] = union(
    *(f"SELECT id, s AS start, e AS \"end\", value, '{n}' AS source, {luhn()} AS valid FROM ({spans(src, CARD_RE)})" for n, src in (("documents", DOCS), ("pages", PAGES)))
)
ORACLES["iban_mod97"] = f'SELECT id, s AS start, e AS "end", value, {iban()} AS valid FROM ({spans(CUSTOMERS, IBAN_RE)})'
AADHAAR = spans(ORDERS, AADHAAR_RE, NO_DIGITS)
ORACLES["aadhaar_verhoeff"] = f'SELECT id, s AS start, e AS "end", value, {verhoeff()} AS valid FROM ({AADHAAR})'
ORACLES["aadhaar_validation_outcome"] = scored(AADHAAR, "IN_AADHAAR", 1.0, verhoeff())

ORACLES["chunked_scan"] = union(
    scored(spans(DOCS, EMAIL_RE), "EMAIL_ADDRESS", 0.9),
    scored(spans(DOCS, IPV4_RE), "IP_ADDRESS", 0.6),
    scored(spans(DOCS, IPV6_RE), "IP_ADDRESS", 0.6),
    scored(spans(DOCS, BANK_RE), "IN_BANK_ACCOUNT", 0.35, f"length({DIGITS}) BETWEEN 11 AND 18 AND NOT ({{aadhaar}}) AND (length({DIGITS}) > 12 OR {{bank}})".format(
        aadhaar=f"length({DIGITS}) = 12 AND substr({DIGITS}, 1, 1) >= '2' AND {verhoeff()}",
        bank=needs(["account", "acct", "a/c", "ifsc", "bank", "beneficiary", "iban"], 64))),
)
PASSPORT_BOOST = f"CASE WHEN {near(['passport'])} THEN 0.9 ELSE 0.55 END"
ORACLES["context_boost"] = scored(spans(CUSTOMERS, PASSPORT_RE), "IN_PASSPORT", PASSPORT_BOOST)
ORACLES["scan_wide_context"] = union(
    scored(spans(CUSTOMERS, PASSPORT_RE), "IN_PASSPORT", 0.9), scored(spans(CUSTOMERS, IFSC_RE), "IN_IFSC", 0.95)
)

BANK_WORDS = ["account", "acct", "a/c", "ifsc", "bank", "beneficiary", "iban"]
LOOKS_AADHAAR = f"(length({DIGITS}) = 12 AND substr({DIGITS}, 1, 1) BETWEEN '2' AND '9' AND {verhoeff()})"
BANK_GUARD = (
    f"length({DIGITS}) BETWEEN 11 AND 18 AND NOT {LOOKS_AADHAAR} AND (length({DIGITS}) > 12 OR {needs(BANK_WORDS, 64)})"
)
PHONE_GUARD = f"NOT (starts_with({DIGITS}, '91') AND length({DIGITS}) >= 12 AND substr({DIGITS}, -10, 1) NOT BETWEEN '6' AND '9')"


def india_base(source: str, min_score: float) -> str:
    """The India entities at base score, equal spans resolved: no two of them coincide in the customer texts but
    digit runs, where Aadhaar outranks an account."""
    parts = {
        "IN_AADHAAR": (spans(source, AADHAAR_RE, NO_DIGITS), 1.0, verhoeff()),
        "IN_PAN": (spans(source, PAN_RE), 0.55, "true"),
        "IN_IFSC": (spans(source, IFSC_RE), 0.6, "true"),
        "IN_UPI_ID": (spans(source, UPI_RE), 0.7, "true"),
        "IN_PASSPORT": (spans(source, PASSPORT_RE), 0.55, "true"),
        "IN_BANK_ACCOUNT": (spans(source, BANK_RE), 0.35, BANK_GUARD),
    }
    return union(*(scored(sql, e, score, keep) for e, (sql, score, keep) in parts.items() if score >= min_score))


ORACLES["global_threshold"] = india_base(CUSTOMERS, 0.58)
THRESHOLDS = "(VALUES ('IN_AADHAAR', 0.75), ('IN_PAN', 0.65), ('IN_IFSC', 0.6), ('IN_UPI_ID', 0.65), ('IN_PASSPORT', 0.65), ('IN_BANK_ACCOUNT', 0.45)) AS t(entity, floor)"
ORACLES["entity_threshold"] = (
    f"SELECT x.* FROM ({india_base(CUSTOMERS, 0.0)}) x LEFT JOIN {THRESHOLDS} ON x.entity_type = t.entity WHERE score >= coalesce(floor, 0)"
)

ORACLES["include_exclude_values"] = union(
    scored(spans(DOCS, EMAIL_RE), "EMAIL_ADDRESS", 0.9, "lower(value) NOT IN ('the@mail1.example.com', 'und.34@mail7.example.com')"),
    scored(spans(DOCS, CARD_RE), "CREDIT_CARD", 1.0, f"{luhn()} AND {DIGITS} IN ('4316522678525456', '4465758382889437')"),
)
ORACLES["include_exclude_patterns"] = scored(
    spans(DOCS, EMAIL_RE), "EMAIL_ADDRESS", 0.9,
    r"regexp_matches(value, '(?i)MAIL[0-5][.]') AND NOT regexp_matches(value, '(?i)^the') AND NOT regexp_matches(value, '[.]\d[02468]@')",
)
ORACLES["python_value_patterns"] = scored(
    spans(DOCS, EMAIL_RE), "EMAIL_ADDRESS", 0.9,
    r"regexp_matches(value, '(?i)MAIL[0-5][.]') AND NOT regexp_matches(value, '(?i)^(?:the|ha)') AND NOT regexp_matches(value, '[.]\d[02468]@')",
)
ORACLES["length_bounds"] = scored(spans(ORDERS, BANK_RE), "DIGIT_RUN", 0.5, "length(value) BETWEEN 13 AND 15")
IP_BOTH = lambda src, keep: union(*(scored(spans(src, p), "IP_ADDRESS", 0.6, keep) for p in (IPV4_RE, IPV6_RE)))
ORACLES["required_forbidden_context"] = IP_BOTH(DOCS, f"{needs(['the', 'que', 'ein'], 30)} AND NOT {needs(['th ', '###'], 30)}")
ORACLES["disabled_entity"] = scored(spans(DOCS, EMAIL_RE), "EMAIL_ADDRESS", 0.9)
ORACLES["bank_guard"] = scored(spans(ORDERS, BANK_RE), "IN_BANK_ACCOUNT", 0.35, BANK_GUARD)
ORACLES["phone_guard"] = scored(spans(ORDERS, PHONE_RE), "PHONE_NUMBER", 0.4, f"{phone_ok()} AND {PHONE_GUARD}")
ORACLES["allow_list"] = union(
    f"SELECT x.* FROM ({scored(spans(DOCS, CARD_RE), 'CREDIT_CARD', 1.0, luhn())}) x ANTI JOIN (VALUES ('4316522678525456'), ('4465758382889437')) AS a(v) ON x.value = a.v",
    scored(spans(DOCS, EMAIL_RE), "EMAIL_ADDRESS", 0.9, "NOT regexp_matches(value, '(?i)mail[1-3][.]') AND NOT regexp_matches(value, '(?i)^the')"),
)
THREE = union(
    scored(spans(DOCS, EMAIL_RE), "EMAIL_ADDRESS", 0.9),
    scored(spans(DOCS, CARD_RE), "CREDIT_CARD", 1.0, luhn()),
    IP_BOTH(DOCS, "true"),
)
ORACLES["rules_left_join"] = (
    "SELECT id, x.entity_type, start, \"end\", score_threshold, context_window_chars, coalesce(forbidden, '') AS forbidden, score >= coalesce(score_threshold, 0) AS passes "
    f"FROM ({THREE}) x LEFT JOIN (VALUES ('EMAIL_ADDRESS', CAST(0.6 AS DOUBLE), CAST(40 AS INTEGER), 'dummy|placeholder')) "
    "AS r(entity_type, score_threshold, context_window_chars, forbidden) ON x.entity_type = r.entity_type"
)

OVERLAPPING = union(
    scored(spans(ORDERS, PHONE_RE), "PHONE_NUMBER", 0.4, f"{phone_ok()} AND {PHONE_GUARD}"),
    scored(spans(ORDERS, CARD_RE), "CREDIT_CARD", 1.0, luhn()),
    scored(AADHAAR, "IN_AADHAAR", 1.0, verhoeff()),
    scored(spans(ORDERS, BANK_RE), "IN_BANK_ACCOUNT", 0.35, BANK_GUARD),
    scored(spans(ORDERS, I + r"\b\d{8,19}\b"), "IN_BANK_ACCOUNT", 0.6, BANK_GUARD),
    scored(spans(ORDERS, I + r"\b\d{6,22}\b"), "DIGIT_RUN", 0.95),
)
DEDUPED = f'SELECT * FROM ({OVERLAPPING}) QUALIFY row_number() OVER (PARTITION BY id, entity_type, start, "end" ORDER BY score DESC) = 1'
ORACLES["dedup_spans_best_score"] = DEDUPED
PRIORITY = (
    "CASE entity_type WHEN 'IN_AADHAAR' THEN 200 WHEN 'IN_PAN' THEN 190 WHEN 'IN_IFSC' THEN 185 WHEN 'IN_UPI_ID' THEN 180 "
    "WHEN 'IN_PASSPORT' THEN 175 WHEN 'CREDIT_CARD' THEN 170 WHEN 'IBAN_CODE' THEN 165 WHEN 'US_BANK_NUMBER' THEN 150 "
    "WHEN 'IN_BANK_ACCOUNT' THEN 145 WHEN 'EMAIL_ADDRESS' THEN 140 WHEN 'PHONE_NUMBER' THEN 130 WHEN 'PERSON' THEN 120 "
    "WHEN 'LOCATION' THEN 110 WHEN 'IP_ADDRESS' THEN 100 ELSE 0 END"
)


def winners(sql: str, key: str = "id") -> str:
    return f'SELECT * FROM ({sql}) QUALIFY row_number() OVER (PARTITION BY {key}, start, "end" ORDER BY {PRIORITY} DESC, score DESC, entity_type) = 1'


ORACLES["same_span_winner"] = winners(DEDUPED)
ORACLES["same_span_winner_in_row"] = winners(DEDUPED)

# ---- whole scans: per entity pattern, score and rule, for each environment -----------------------------------

UPI_WORDS = ["upi", "vpa", "gpay", "phonepe", "paytm", "payment", "collect"]
PHONE_WORDS = ["phone", "mobile", "contact", "whatsapp", "tel"]
ADDR_WORDS = ["address", "addr", "street", "road", "lane", "city", "state", "pincode", "pin"]
IP_SCORE = f"CASE WHEN {near(['ip', 'ipv4', 'ipv6'])} THEN 0.95 ELSE 0.6 END"
RAW_AADHAAR = r"regexp_matches(value, '^[2-9]\d{11}$')"
PAN_WORDS = ["pan", "income tax", "permanent account number", "tax id"]


def rules_sql(source: str, env: str) -> str:
    """Base and default, dev or prod rules. Scan-wide words lift PAN, IFSC, UPI, account, e-mail, phone and address."""
    prod = env == "prod"
    w = (lambda base, strict: strict if prod else base)
    extra_addr = [*ADDR_WORDS, "district"] if prod else ADDR_WORDS
    parts = [
        ("EMAIL_ADDRESS", spans(source, EMAIL_RE), 1.0,
         f"NOT {needs(['dummy', 'placeholder'], w(40, 48))}" + (f" AND {needs(['email', 'e-mail', 'mail', 'contact'], 48)}" if prod else "")),
        ("PHONE_NUMBER", spans(source, PHONE_RE), 0.75,
         f"{phone_ok()} AND {PHONE_GUARD} AND {needs(PHONE_WORDS, w(56, 64))}"
         + (r" AND (regexp_matches(value, '^(\+91[\-\s]?)?[6-9][0-9]{9}$') OR regexp_matches(value, '^(91)?[6-9][0-9]{9}$'))" if prod else "")),
        ("CREDIT_CARD", spans(source, CARD_RE), 1.0, luhn()),
        ("IBAN_CODE", spans(source, IBAN_RE), 1.0, iban()),
        ("IP_ADDRESS", spans(source, IPV4_RE), IP_SCORE, "true"),
        ("IP_ADDRESS", spans(source, IPV6_RE), IP_SCORE, "true"),
        ("IN_AADHAAR", spans(source, AADHAAR_RE, NO_DIGITS), 1.0,
         f"{verhoeff()} AND {RAW_AADHAAR} AND {needs(['aadhaar', 'uidai', 'identity', 'kyc'], w(72, 96))}"),
        ("IN_PAN", spans(source, PAN_RE), 0.9, needs(PAN_WORDS, w(72, 80))),
        ("IN_IFSC", spans(source, IFSC_RE), 0.95, needs(["ifsc", "bank", "branch"], w(64, 72))),
        ("IN_UPI_ID", spans(source, UPI_RE), 1.0, f"{needs(UPI_WORDS, w(48, 56))} AND NOT {needs(['email', 'mail'], w(48, 56))}"),
        ("IN_PASSPORT", spans(source, PASSPORT_RE), PASSPORT_BOOST, near(["passport"])),
        ("IN_BANK_ACCOUNT", spans(source, BANK_RE), 0.7,
         f"{BANK_GUARD} AND {needs(['account', 'beneficiary', 'bank', 'ifsc', *(['branch'] if prod else [])], w(80, 120))}"),
        ("IN_ADDRESS", spans(source, ADDRESS_RE), 1.0, needs(extra_addr, w(120, 140))),
        ("IN_ADDRESS", spans(source, PINCODE_RE), w(0.97, 1.0), needs(extra_addr, w(120, 140))),
    ]
    if prod:
        # The strict rules lift names by nearby name words, which every label carries in the scan-wide list.
        name_words = ["name", "full name", "customer name", "beneficiary name", "applicant name", "employee name", "holder name"]
        shape = (
            "(regexp_matches(value, '(?i)^[A-Za-z][A-Za-z .''-]{2,63}$') OR regexp_matches(value, '(?i)^(?:full\\s*name|customer\\s*name|"
            "beneficiary\\s*name|applicant\\s*name|employee\\s*name|holder\\s*name|name)\\s*[:\\-]\\s*[A-Za-z][A-Za-z .''-]{2,63}$'))"
        )
        parts.append(
            ("PERSON", spans(source, NAME_RE), 1.0,
             f"length(value) BETWEEN 3 AND 64 AND {shape} AND {needs(name_words, 60)} AND NOT {needs(['company', 'organization', 'team', 'service'], 60)}")
        )
    if env == "dev":
        parts.append(("URL", spans(source, URL_RE), f"CASE WHEN {near(['url', 'website', 'link'])} THEN 0.85 ELSE 0.5 END", "true"))
        parts.append(("DATE_TIME", spans(source, DATE_RE, NO_DIGITS), f"CASE WHEN {near(['date', 'birthday'])} THEN 0.85 ELSE 0.5 END", "true"))
    rows = union(
        *(
            f"SELECT id, '{e}' AS entity_type, CAST(round({score}, 4) AS DOUBLE) AS score, value, s AS start, e AS \"end\", "
            f"substr(text, greatest(s - 24, 0) + 1, e + 24 - greatest(s - 24, 0)) AS snippet FROM ({sql}) WHERE {keep}"
            for e, sql, score, keep in parts
        )
    )
    sensitive = "entity_type IN ('IN_AADHAAR', 'IN_PAN', 'IN_PASSPORT', 'CREDIT_CARD', 'IBAN_CODE', 'CRYPTO', 'US_BANK_NUMBER')"
    return (
        f"SELECT id, entity_type, CASE WHEN {sensitive} THEN 'SENSITIVE_PERSONAL' ELSE 'PERSONAL' END AS category, "
        f"score, value AS text, start, \"end\", snippet FROM ({winners(rows)})"
    )


for name, source, env in (
    ("scan_documents", DOCS, "default"),
    ("scan_documents_dev", DOCS, "dev"),
    ("scan_pages", PAGES, "default"),
    ("scan_page_links_dev", LINKS, "dev"),
    ("scan_customer_text", CUSTOMERS, "default"),
    ("scan_customer_text_prod", CUSTOMERS, "prod"),
    ("scan_order_text", ORDERS, "default"),
    ("scan_order_text_prod", ORDERS, "prod"),
):
    ORACLES[name] = rules_sql(source, env)

# ---- findings, sources and report ----------------------------------------------------------------------------


def plain_findings(source: str) -> str:
    """E-mail, cards and addresses of hosts under no rules, with the context boost of each recogniser."""
    return union(
        *(
            f"SELECT id, '{entity}' AS entity_type, '{category}' AS category, CAST({score} AS DOUBLE) AS score, value AS text, s AS start, e AS \"end\", "
            f"'{recognizer}' AS recognizer_name, substr(text, greatest(s - 24, 0) + 1, e + 24 - greatest(s - 24, 0)) AS snippet FROM ({sql}) WHERE {keep}"
            for entity, category, recognizer, sql, score, keep in (
                ("EMAIL_ADDRESS", "PERSONAL", "EmailRecognizer", spans(source, EMAIL_RE), f"CASE WHEN {near(['email'])} THEN 1.0 ELSE 0.9 END", "true"),
                ("CREDIT_CARD", "SENSITIVE_PERSONAL", "CreditCardRecognizer", spans(source, CARD_RE), "1.0", luhn()),
                ("IP_ADDRESS", "PERSONAL", "IpRecognizer", spans(source, IPV4_RE), IP_SCORE, "true"),
                ("IP_ADDRESS", "PERSONAL", "IpRecognizer", spans(source, IPV6_RE), IP_SCORE, "true"),
            )
        )
    )


FOUND = f"SELECT concat('table://documents/', id) AS file_path, * EXCLUDE (id) FROM ({plain_findings(DOCS)})"
ORACLES["finding_projection"] = FOUND
ORACLES["category_profile"] = (
    f"SELECT entity_type, category, count(*) AS findings, count(DISTINCT file_path) AS sources, max(score) AS max_score FROM ({FOUND}) GROUP BY ALL"
)
TURNS = "SELECT concat(conv_id, '-', turn) AS id, text FROM conversations"
ORACLES["union_sources"] = union(
    *(
        f"SELECT concat('table://{n}/', id) AS file_path, entity_type, start, \"end\", text, score FROM ({plain_findings(src)})"
        for n, src in (("documents", DOCS), ("pages", PAGES), ("conversations", TURNS))
    )
)
def statuses(too_large: str) -> str:
    return union(
        *(
            f"""SELECT concat('table://{n}/', a.id) AS file_path, CASE WHEN {too_large} THEN 'skipped' ELSE 'scanned' END AS status,
            CASE WHEN {too_large} THEN 'File larger than 8000 bytes' END AS reason, CAST(NULL AS VARCHAR) AS error,
            CASE WHEN NOT ({too_large}) THEN coalesce(c.n, 0) END AS findings_count, '{n}' AS source_plugin
            FROM ({src}) a LEFT JOIN (SELECT id, count(*) AS n FROM ({plain_findings(src)}) GROUP BY id) c ON a.id = c.id"""
            for n, src in (("documents", DOCS), ("pages", PAGES))
        )
    )


STATUS = statuses("false")
ORACLES["scan_status"] = statuses("octet_length(encode(a.text)) > 8000")
COUNTS = "count(*) FILTER (status = 'scanned') AS {0}_scanned, count(*) FILTER (status = 'skipped') AS {0}_skipped, count(*) FILTER (status = 'failed') AS {0}_failed"
ORACLES["global_counts"] = (
    f"SELECT {COUNTS.format('files')}, {COUNTS.format('sources')}, CAST(sum(findings_count) AS BIGINT) AS total_findings FROM ({STATUS})"
)
ORACLES["plugin_counts"] = (
    f"SELECT p.plugin, {COUNTS.format('sources')}, CAST(coalesce(sum(findings_count), 0) AS BIGINT) AS findings "
    f"FROM (VALUES ('documents'), ('pages'), ('database')) AS p(plugin) LEFT JOIN ({STATUS}) s ON s.source_plugin = p.plugin GROUP BY p.plugin"
)
ORACLES["findings_count_per_source"] = f"SELECT file_path AS source_id, count(*) AS findings_count FROM ({FOUND}) GROUP BY 1"
ORACLES["blank_sources"] = f"""SELECT 'scanned' AS status, false AS blank, count(*) AS sources, CAST(sum(coalesce(n, 0)) AS BIGINT) AS findings, count(n) AS with_findings
    FROM documents d LEFT JOIN (SELECT id, count(*) AS n FROM ({plain_findings(DOCS)}) GROUP BY id) c ON d.doc_id = c.id
    UNION ALL SELECT 'scanned', true, count(*), CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM documents"""
ORACLES["findings_sorted_topk"] = (
    f'SELECT file_path, start, "end", score, entity_type, text FROM ({FOUND}) ORDER BY file_path, start, "end", score DESC, entity_type LIMIT 50'
)
ORACLES["content_hash"] = "SELECT concat('table://documents/', doc_id) AS source_path, sha256(text) AS content_hash FROM documents"
ORACLES["text_decode"] = (
    "SELECT doc_id, sha256(concat('A', replace(text, ' ', chr(10)), 'BA')) AS text_hash, "
    "CAST(length(text) + 3 AS INTEGER) AS chars, CAST(length(replace(text, ' ', '  ')) + 3 AS INTEGER) AS binary_chars FROM documents"
)
ORACLES["docx_extract"] = "SELECT doc_id, sha256(text) AS text_hash, CAST(NULL AS VARCHAR) AS error FROM documents"

# ---- paths ---------------------------------------------------------------------------------------------------

PATHS = r"""SELECT page_id, concat(CASE WHEN p LIKE '%/' THEN concat(p, 'index.HTML') ELSE p END,
    CASE page_id % 5 WHEN 0 THEN '/notes.txt' WHEN 1 THEN '.TXT' WHEN 2 THEN '/node_modules/a.json' WHEN 3 THEN '' ELSE '/cache.pyc' END) AS path
    FROM (SELECT page_id, regexp_replace(regexp_replace(url, '[?#].*$', ''), '^https?://', '/data/') AS p FROM pages)"""
BASENAME = "string_split(path, '/')[-1]"
SUFFIX = f"CASE WHEN regexp_matches({BASENAME}, '[^/]\\.[^./]+$') THEN concat('.', string_split({BASENAME}, '.')[-1]) ELSE '' END"
ORACLES["path_mask_basename"] = f"SELECT page_id, {BASENAME} AS masked FROM ({PATHS})"
ORACLES["path_mask_relative"] = f"""SELECT page_id, CASE
    WHEN starts_with(path, '/data/blog./') THEN substr(path, 13)
    WHEN starts_with(path, '/data/m.ththth.example.net/') THEN substr(path, 28)
    WHEN starts_with(path, '/data/m.therou.example.com/') THEN substr(path, 28)
    ELSE {BASENAME} END AS masked FROM ({PATHS})"""
ORACLES["path_mask_hash"] = (
    f"SELECT page_id, concat('file_', substr(sha256(concat('salt', chr(124), path)), 1, 24), {SUFFIX}) AS masked FROM ({PATHS})"
)
ORACLES["path_mask_redacted"] = f"SELECT page_id, '[REDACTED_PATH]' AS masked, path AS unmasked FROM ({PATHS})"
ORACLES["file_filters"] = f"""SELECT page_id, {SUFFIX} AS suffix, lower({SUFFIX}) IN ('.txt', '.html', '.json') AS extension_ok,
    path LIKE '%.pyc' OR contains(path, '/en/7') OR regexp_matches({BASENAME}, '^not[^a-m]s\\.t.t$') AS glob_hit,
    len(list_filter(string_split(path, '/')[3:-2], lambda d: d IN ('node_modules', 'fr', 'data'))) > 0 AS pruned FROM ({PATHS})"""

# ---- rule layers ---------------------------------------------------------------------------------------------

ORACLES["layered_rules"] = """
WITH base AS (SELECT c_custkey AS entity, c_acctbal AS score_threshold, c_nationkey AS min_length,
                     concat(c_mktsegment, '|any') AS required_context FROM customer),
     env AS (SELECT o_custkey AS entity, CASE WHEN count(*) > 9 THEN max(o_totalprice) END AS score_threshold,
                    CAST(NULL AS INTEGER) AS min_length,
                    CASE WHEN min(o_orderpriority) = '1-URGENT' THEN '1-URGENT' END AS required_context FROM orders GROUP BY 1)
SELECT coalesce(b.entity, e.entity) AS entity, coalesce(e.score_threshold, b.score_threshold) AS score_threshold,
       coalesce(e.min_length, b.min_length) AS min_length,
       coalesce(e.required_context, b.required_context, '') AS required_context
FROM base b FULL JOIN env e ON b.entity = e.entity"""

BASE_LIST = "['IN_AADHAAR','IN_PAN','IN_IFSC','IN_UPI_ID','IN_PASSPORT','IN_BANK_ACCOUNT','EMAIL_ADDRESS','PHONE_NUMBER','PERSON','LOCATION','IN_ADDRESS','IP_ADDRESS','CREDIT_CARD','IBAN_CODE']"
BASE_OUT = "['DATE_TIME','ORGANIZATION','UK_NHS','US_BANK_NUMBER','US_SSN','US_PASSPORT','US_DRIVER_LICENSE','US_ITIN','MEDICAL_LICENSE','CRYPTO','URL']"
DEV_OUT = "['UK_NHS','US_SSN','US_PASSPORT','US_DRIVER_LICENSE','US_ITIN']"
ENV_LISTS = f"""(VALUES ('default', {BASE_LIST}, {BASE_LIST}, {BASE_OUT}), ('qa', {BASE_LIST}, {BASE_LIST}, {BASE_OUT}),
    ('prod', {BASE_LIST}, {BASE_LIST}, {BASE_OUT}), ('dev', {BASE_LIST}, ['ORGANIZATION','DATE_TIME','URL'], {DEV_OUT})) AS l(environment, listed, included, excluded)"""
LINK_SPANS = winners(
    union(
        scored(spans(LINKS, EMAIL_RE), "EMAIL_ADDRESS", 0.9),
        scored(spans(LINKS, CARD_RE), "CREDIT_CARD", 1.0, luhn()),
        IP_BOTH(LINKS, "true"),
        scored(spans(LINKS, URL_RE), "URL", 0.5),
        scored(spans(LINKS, PHONE_RE), "PHONE_NUMBER", 0.4, f"{phone_ok()} AND {PHONE_GUARD}"),
    )
)
ORACLES["effective_entities"] = f"""SELECT environment, entity_type, count(*) AS n FROM ({LINK_SPANS}) x JOIN (
    SELECT environment, unnest(list_filter(list_distinct(list_concat(listed, included)), lambda e: NOT list_contains(excluded, e))) AS entity FROM {ENV_LISTS}) l
    ON x.entity_type = l.entity GROUP BY ALL"""
FLOORS = """(VALUES ('IN_AADHAAR', [0.75, 0.75, 0.75, 0.8]), ('IN_PAN', [0.65, 0.65, 0.65, 0.72]), ('IN_IFSC', [0.6, 0.6, 0.6, 0.68]),
    ('IN_UPI_ID', [0.65, 0.65, 0.65, 0.74]), ('IN_PASSPORT', [0.65, 0.65, 0.65, 0.65]), ('IN_BANK_ACCOUNT', [0.45, 0.45, 0.5, 0.62]),
    ('EMAIL_ADDRESS', [0.6, 0.55, 0.6, 0.68])) AS f(entity, floors)"""
ORACLES["effective_thresholds"] = f"""WITH x AS ({union(india_base(CUSTOMERS, 0.0), scored(spans(CUSTOMERS, EMAIL_RE), 'EMAIL_ADDRESS', 0.9))}),
    f AS (SELECT entity, ['default', 'dev', 'qa', 'prod'][i] AS environment, CAST(floors[i] AS DOUBLE) AS min_score FROM {FLOORS}, unnest([1, 2, 3, 4]) AS u(i))
    SELECT environment, entity_type, min_score, count(*) AS spans, count(*) FILTER (score >= min_score) AS kept FROM x JOIN f ON x.entity_type = f.entity GROUP BY ALL"""

# ---- databases, tables and columns ---------------------------------------------------------------------------

ORACLES["db_targets"] = """WITH n AS (SELECT concat(' Db_', n_name) AS name, count(*) AS tables FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1)
    SELECT name, tables, 'all' AS mode FROM n ANTI JOIN (VALUES ('db_nation_3'), ('db_nation_11'), ('db_france')) AS x(v) ON lower(trim(name)) = v
    UNION ALL SELECT name, tables, 'named' FROM n SEMI JOIN (VALUES ('db_nation_1'), ('db_india')) AS y(v) ON lower(trim(name)) = v"""
ORACLES["table_filters"] = """SELECT p_brand AS schema, p_type AS table, count(*) AS n FROM part
    WHERE (lower(p_type) IN ('economy', 'promo') OR lower(concat(p_brand, '.', p_type)) = 'brand#1.standard')
    AND lower(p_type) <> 'promo' AND lower(concat(p_brand, '.', p_type)) <> 'brand#2.economy' AND lower(p_brand) <> 'brand#5' GROUP BY 1, 2"""
ORACLES["table_filters_by_frame"] = """SELECT c_mktsegment AS schema, concat('T', c_custkey) AS table FROM customer
    SEMI JOIN orders ON c_custkey = o_custkey WHERE NOT (lower(c_mktsegment) = 'machinery' AND c_custkey IN (SELECT s_suppkey FROM supplier))"""
CONNECTIONS = """SELECT c_custkey AS id, split_part(' Postgres,,rds,MariaDB,sqlserver,RDS_mysql,snowflake,pgsql', ',', CAST(c_custkey % 8 + 1 AS INT)) AS kind,
    CASE WHEN c_custkey % 3 = 0 THEN 'mysql' ELSE '' END AS engine, CASE WHEN c_custkey % 4 = 0 THEN concat('host', c_nationkey) ELSE '' END AS host,
    split_part('postgresql,mysql,sqlite3,MSSQL,oracle', ',', CAST(c_custkey % 5 + 1 AS INT)) AS scheme,
    concat(split_part('postgresql+psycopg2,mysql,sqlite3,MSSQL+pyodbc,oracle', ',', CAST(c_custkey % 5 + 1 AS INT)), '://u', c_custkey, ':p@') AS head,
    concat('h', c_nationkey, ':5432') AS place, CASE WHEN c_custkey % 2 = 0 THEN concat('/', lower(c_mktsegment)) ELSE '' END AS path,
    CASE WHEN c_custkey % 7 = 0 THEN '?ssl=1' ELSE '' END AS query FROM customer"""


def alias(name: str) -> str:
    n = f"lower(trim({name}))"
    return (
        f"CASE WHEN {n} IN ('postgres', 'postgresql', 'pgsql', 'rds_postgresql', 'rds_postgres') THEN 'postgresql' "
        f"WHEN {n} IN ('mariadb', 'mysql', 'rds_mysql') THEN 'mysql' WHEN {n} IN ('sqlserver', 'mssql') THEN 'mssql' "
        f"WHEN {n} IN ('dynamodb', 'aws_dynamodb') THEN 'dynamodb' WHEN {n} = 'sqlite3' THEN 'sqlite' ELSE {n} END"
    )


KIND = f"CASE WHEN kind = '' THEN {alias('scheme')} WHEN kind = 'rds' THEN CASE WHEN engine = '' THEN {alias('scheme')} ELSE {alias('engine')} END ELSE {alias('kind')} END"
ORACLES["source_type_alias"] = f"SELECT id, {KIND} AS source_type, lower(scheme) AS scheme FROM ({CONNECTIONS})"
ORACLES["url_parts"] = f"""SELECT id, CASE WHEN host <> '' THEN host ELSE concat(place, path, query) END AS endpoint, ltrim(path, '/') AS database,
    concat(head, place, '/archive', query) AS archive_url,
    concat(head, place, CASE WHEN path = '' THEN '/postgres' ELSE path END, query) AS discovery_url FROM ({CONNECTIONS})"""
NAMES = """SELECT DISTINCT p_brand AS table, concat(replace(p_name, ' ', '_'), '_',
    split_part('email,Phone_No,pan,ip_address,colour,company,passport,span,full_name,IFSC', ',', CAST(p_size % 10 + 1 AS INT))) AS column FROM part"""
ORACLES["column_name_pii"] = f"""SELECT n.table, n.column, m.pii_type FROM ({NAMES}) n JOIN (VALUES ('email', 'EMAIL_ADDRESS'), ('phone_no', 'PHONE_NUMBER'),
    ('pan', 'IN_PAN'), ('ip_address', 'IP_ADDRESS'), ('ip_address', 'IN_ADDRESS'), ('passport', 'IN_PASSPORT'), ('full_name', 'PERSON'), ('ifsc', 'IN_IFSC')) AS m(word, pii_type)
    ON lower(n.column) LIKE concat('%\\_', m.word) ESCAPE '\\'"""
CONTACT = f"""SELECT {EMAIL} AS contact_email, {HANDLE} AS login, c_name, c_mktsegment, CASE WHEN {K} % 4 = 0 THEN NULL WHEN {K} % 4 = 3 THEN 'unknown'
    ELSE concat('10.0.', CAST({K} % 250 AS STRING), '.', CAST(c_nationkey AS STRING)) END AS origin FROM customer"""
LEDGER = f"SELECT {ACCOUNT_CUT} AS ref, o_orderpriority, o_orderstatus FROM orders"


def value_counts() -> str:
    tables = (
        ("crm", "contact", CONTACT, ("contact_email", "login", "c_name", "c_mktsegment", "origin")),
        ("", "ledger", LEDGER, ("ref", "o_orderpriority", "o_orderstatus")),
        ("", "documents", "SELECT text, lang, source FROM documents", ("text", "lang", "source")),
        ("", "events", "SELECT event_type, props FROM events", ("event_type", "props")),
    )
    rows = []
    for schema, table, sql, columns in tables:
        for c in columns:
            t = "regexp_replace(v, '[^\\x00-\\x7F]', '_', 'g')"
            cards = f"len(list_filter(regexp_extract_all({t}, {q(CARD_RE)}), lambda value: {luhn()})) > 0"
            hits = {
                "EMAIL_ADDRESS": f"regexp_matches({t}, {q(EMAIL_RE)})",
                "IP_ADDRESS": f"regexp_matches({t}, {q(IPV4_RE)}) OR regexp_matches({t}, {q(IPV6_RE)})",
                "CREDIT_CARD": cards,
                "IN_BANK_ACCOUNT": f"regexp_matches({t}, {q(BANK_RE)})",
            }
            for entity, hit in hits.items():
                rows.append(
                    f"SELECT '{schema}' AS schema, '{table}' AS \"table\", '{c}' AS \"column\", '{entity}' AS pii_type, count(v) AS non_null, "
                    f"count(*) FILTER ({hit}) AS hits FROM (SELECT {c} AS v FROM ({sql}))"
                )
    return union(*rows)


ORACLES["column_value_pii"] = value_counts()
ORACLES["flagged_columns"] = f"""WITH v AS (SELECT *, CASE WHEN non_null > 0 THEN hits / non_null ELSE 0 END AS rate FROM ({value_counts()})),
    n AS (SELECT * FROM (VALUES ('crm', 'contact', 'contact_email', 'EMAIL_ADDRESS'), ('crm', 'contact', 'c_name', 'PERSON')) AS t(s, t, c, p))
    SELECT coalesce(schema, s) AS schema, coalesce(v."table", t) AS "table", coalesce(v."column", c) AS "column", coalesce(pii_type, p) AS pii_type,
    round(rate, 4) AS hit_rate, c IS NOT NULL AS by_name, coalesce(rate >= 0.5, false) AS by_value
    FROM v FULL JOIN n ON schema = s AND v."table" = t AND v."column" = c AND pii_type = p WHERE c IS NOT NULL OR rate >= 0.5"""

DETECTED = """SELECT CASE WHEN user_id % 3 = 0 THEN '' ELSE 'sales' END AS schema, concat('t_', event_type) AS "table", concat('col', user_id) AS "column",
    CASE WHEN event_id % 2 = 1 THEN 'EMAIL_ADDRESS' WHEN value > 20 THEN 'PHONE_NUMBER' ELSE '' END AS pii_type FROM events WHERE event_id % 11 <> 0"""
ORACLES["detector_output_normalise"] = f'SELECT schema, "table", "column", pii_type, count(*) AS n FROM ({DETECTED}) GROUP BY ALL'
CATALOG = f"""SELECT schema, "table", "column", list_sort(list_distinct(list(pii_type) FILTER (pii_type <> ''))) AS pii_types FROM ({DETECTED}) GROUP BY ALL"""
ORACLES["detection_catalog"] = f"""SELECT schema, "table", "column", coalesce(array_to_string(pii_types, '|'), '') AS pii_types FROM ({CATALOG})"""
ORACLES["detection_counts"] = f"""SELECT count(DISTINCT concat(schema, '.', "table")) AS table_count,
    count(DISTINCT concat(schema, '.', "table", '.', "column")) AS pii_column_count FROM ({DETECTED})"""
LABEL_SQL = """CASE WHEN schema = '' THEN "table" ELSE concat(schema, '.', "table") END"""
ORACLES["column_findings"] = f"""SELECT concat('db://crm:main/table:', label, '/column:', "column") AS file_path, entity_type, 'PERSONAL' AS category,
    CAST(1 AS DOUBLE) AS score, concat(label, '.', "column") AS text, CAST(0 AS INTEGER) AS start, CAST(length(label) + length("column") + 1 AS INTEGER) AS "end",
    'crm:main' AS connection FROM (SELECT {LABEL_SQL} AS label, "column",
    unnest(CASE WHEN coalesce(len(pii_types), 0) = 0 THEN ['PII'] ELSE pii_types END) AS entity_type FROM ({CATALOG}))"""


def samples(table: str, column: str, cast: str = "") -> str:
    text = "regexp_replace(v, '^\\s+|\\s+$', '', 'g')"
    return f"""SELECT '{column}' AS column, CAST(rank AS INTEGER) AS rank, CASE WHEN length({text}) > 16 THEN concat(substr({text}, 1, 16), '...') ELSE {text} END AS value,
      '{table}' AS table FROM (SELECT v, row_number() OVER (ORDER BY v) AS rank FROM (SELECT DISTINCT CAST({column} AS VARCHAR) AS v FROM {table}) WHERE v IS NOT NULL)
      WHERE rank <= 7 AND {text} <> ''"""


ORACLES["column_samples"] = union(
    *(samples("customer", c) for c in ("c_name", "c_mktsegment", "c_acctbal")), *(samples("documents", c) for c in ("text", "lang"))
)
ORACLES["connection_summary"] = f"""SELECT source_type, count(*) AS connections, CAST(coalesce(sum(n), 0) AS BIGINT) AS tables
    FROM (SELECT id, {KIND} AS source_type FROM ({CONNECTIONS})) c LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) o ON c.id = o.o_custkey GROUP BY 1"""

# ---- further settings ----------------------------------------------------------------------------------------

ORACLES["aadhaar_without_checksum"] = scored(AADHAAR, "IN_AADHAAR", 1.0, f"length({DIGITS}) = 12")
ORACLES["merged_context_words"] = union(
    scored(spans(CUSTOMERS, PASSPORT_RE), "IN_PASSPORT", 0.9), scored(spans(CUSTOMERS, IFSC_RE), "IN_IFSC", 0.95)
)
ORACLES["rule_engine_off"] = union(scored(spans(DOCS, EMAIL_RE), "EMAIL_ADDRESS", 0.9), IP_BOTH(DOCS, "true"))
ORACLES["optional_columns"] = (
    'SELECT file_path, entity_type, start, "end", CAST(NULL AS VARCHAR) AS snippet, CAST(NULL AS VARCHAR) AS file_hash, CAST(13 AS INTEGER) AS columns '
    f"FROM ({FOUND})"
)
ORACLES["precomputed_findings"] = union(
    *(
        f"""SELECT '{way}' AS way, file_path, entity_type, start, "end", text, score FROM ({part})"""
        for way in ("frame", "records")
        for part in (FOUND, ORACLES["column_findings"])
    )
)
