import re
import warnings

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veilscan.functions import checks, paths, urls
from veilscan.functions.context import near_word, tokens_after, tokens_before
from veilscan.functions.regex_dialect import ANALYSER, RULE, has_jvm_form, jvm_form
from veilscan.functions.regexes import PLAIN_FLAGS, glob_regex, jvm_pattern, matches_empty, usable
from veilscan.functions.spans import regex_spans
from veilscan.functions.sqltext import text_literal
from veilscan.operators.recognisers import AADHAAR, BANK_ACCOUNT, EMAIL, EMAIL_JVM, Pattern
from veilscan.rules import EntityRule

FLAGS = re.I | re.M | re.S
PYTHON_PATTERNS = [AADHAAR, BANK_ACCOUNT, r"\b[A-Z]{5}[0-9]{4}[A-Z]\b", r"[a-z]+\s*:\s*\d+"]


def one(spark, sql, **values):
    frame = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return frame.select(F.expr(sql).alias("x")).first()["x"]


def column(spark, sql, values):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r["x"] for r in frame.select("i", F.expr(sql).alias("x")).orderBy("i").collect()]


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet="ab 0123456789\n:é😀५ABCDE", max_size=80), min_size=5, max_size=20))
def test_spans_equal_python(spark, texts):
    texts = [*texts, "PAN ABCDE1234F😀 2345 6789 0124\n345678901238,234567890124", "", "1234567890"]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for pattern in PYTHON_PATTERNS:
        rows = frame.select("i", F.expr(regex_spans("t", jvm_pattern(pattern))).alias("s")).collect()
        for row in rows:
            text = texts[row["i"]]
            expected = [(m.start(), m.end(), m.group()) for m in re.finditer(pattern, text, FLAGS)]
            assert [tuple(s) for s in row["s"]] == expected
            assert all(text[s["start"] : s["stop"]] == s["value"] for s in row["s"])


def test_email_start_trick_changes_nothing(spark):
    texts = ["a@b.com_c@d.com", "x.y+z@host.example.org,q@r.st", "a@b.co.x@y.com", "..@a.bc", "@@a@b", "aaaa" * 50 + "@x.yz"]
    got = column(spark, regex_spans("v", EMAIL_JVM), texts)
    for text, spans in zip(texts, got):
        assert [s["value"] for s in spans] == [m.group() for m in re.finditer(EMAIL, text, FLAGS)]


def test_null_text_has_no_spans(spark):
    assert column(spark, regex_spans("v", "a+"), [None, "", "baa"])[:2] == [[], []]


def test_patterns_that_match_nothing_are_refused():
    assert matches_empty("a*")
    with pytest.raises(ValueError):
        Pattern("bad", "x*")


def _check_digit(body: str) -> str:
    """An independent generator with the textbook tables built by group rules."""
    perm = [[0, 1, 2, 3, 4, 5, 6, 7, 8, 9]]
    for _ in range(7):
        perm.append([(1, 5, 7, 6, 2, 8, 3, 0, 9, 4)[d] for d in perm[-1]])

    def mul(a, b):
        if a < 5:
            return (a + b) % 5 if b < 5 else 5 + (a + b) % 5
        return 5 + (a - b) % 5 if b < 5 else (a - b) % 5

    for digit in "0123456789":
        state = 0
        for i, ch in enumerate(reversed(body + digit)):
            state = mul(state, perm[i % 8][int(ch)])
        if state == 0:
            return digit
    raise AssertionError


def test_verhoeff_accepts_made_and_rejects_changed_numbers(spark):
    bodies = [f"{2 + i % 8}{(i * 7919 + 13) % 10**10:010d}" for i in range(200)]
    good = [b + _check_digit(b) for b in bodies]
    bad = [g[:4] + str((int(g[4]) + 1) % 10) + g[5:] for g in good]
    assert all(column(spark, checks.verhoeff_valid("v"), good))
    assert not any(column(spark, checks.verhoeff_valid("v"), bad))
    assert column(spark, checks.verhoeff_valid("v"), ["234567890124", "222233334444", "123456789012", "", "12a"]) == [True, True, False, False, False]


def test_other_checks(spark):
    assert column(spark, checks.luhn_valid(checks.digits_of("v")), ["4111-1111-1111-1111", "4111 1111 1111 1112"]) == [True, False]
    assert column(spark, checks.iban_valid("v"), ["GB82 WEST 1234 5698 7654 32", "DE89370400440532013000", "DE89370400440532013001"]) == [True, True, False]
    assert column(spark, checks.aadhaar_valid(checks.digits_of("v"), checksum=False), ["2345 6789 0123", "2345"]) == [True, False]
    assert column(spark, checks.looks_like_mobile("v"), ["9876543210", "5876543210", "98765432101"]) == [True, False, False]


def test_context_tokens(spark):
    words = " ".join(f"w{i}" for i in range(200))
    text = f"{words} HIT a-b, c d"
    start = len(words) + 1
    before = one(spark, tokens_before("t", str(start), 8), t=text)
    assert before == " ".join(f"w{i}" for i in range(192, 200))
    assert one(spark, tokens_after("t", str(start + 3), 2), t=text) == "a b"
    long_words = " ".join("x" * 90 + str(i) for i in range(12))
    assert one(spark, tokens_before("t", str(len(long_words)), 8), t=long_words).split(" ") == long_words.split(" ")[-8:]
    near = near_word("t", "20", "25", ["passport", "two words"], 8, 2)
    assert one(spark, near, t="my travel Passports  K1234 x") is True
    assert one(spark, near_word("t", "3", "4", ["two words"], 8, 2), t="two words") is False


def test_globs_cross_directories(spark):
    hits = column(spark, f"v RLIKE '{glob_regex('*.py?').replace(chr(92), chr(92) * 2)}'", ["/a/b.pyc", "/a/b.py", "x.pyo"])
    assert hits == [True, False, True]


def test_path_masks(spark):
    sql = {m: paths.masked("v", m, ["/srv/data", "/srv"], "s") for m in ("full", "basename", "relative", "redacted", "odd")}
    path = ["/srv/data/in/a.txt"]
    assert column(spark, sql["full"], path) == column(spark, sql["odd"], path) == path
    assert column(spark, sql["basename"], path) == ["a.txt"]
    assert column(spark, sql["relative"], [*path, "/srv/x", "/other/y", "/srv/database/z"]) == ["in/a.txt", "x", "y", "database/z"]
    assert column(spark, sql["redacted"], path) == ["[REDACTED_PATH]"]
    import hashlib

    digest = hashlib.sha256(b"s|/srv/data/in/a.txt").hexdigest()[:24]
    assert column(spark, paths.masked("v", "hash", [], "s"), path) == [f"file_{digest}.txt"]
    names = ["/x/b.TAR.GZ", "/x/.env", "/x/a.", "/x.y/plain", "/x/..txt"]
    assert column(spark, paths.suffix("v"), names) == [".GZ", "", "", "", ".txt"]


def test_urls(spark):
    url = ["postgresql+psycopg2://u:p@db.example.com:5432/", "mysql://u:p@h/shop?ssl=1", "sqlite:///data.db"]
    assert column(spark, urls.database_of("v"), url) == ["", "shop", "data.db"]
    assert column(spark, urls.discovery_url("'postgresql'", "v"), url)[0] == "postgresql+psycopg2://u:p@db.example.com:5432/postgres"
    assert column(spark, urls.with_database("v", "'x'"), url)[1] == "mysql://u:p@h/x?ssl=1"
    assert column(spark, urls.endpoint("''", "v"), url) == ["db.example.com:5432/", "h/shop?ssl=1", "sqlite:///data.db"]
    assert column(spark, urls.source_type("''", "''", "v"), url) == ["postgresql", "mysql", "sqlite"]
    assert column(spark, urls.source_type("'RDS'", "'mariadb'", "v"), url[:1]) == ["mysql"]
    assert column(spark, urls.schema_part("v"), ["a.b.t", "t"]) == ["a.b", ""]
    assert column(spark, urls.table_part("v"), ["a.b.t", "t"]) == ["t", "t"]


@pytest.mark.parametrize("pattern", [r"[[(]", r"^[a&&b]", r"a\Z", r"[]x]+", r"[^]a]", r"[\]\[-]", r"\[b", r"(?P<q>a)(?P=q)"])
def test_python_patterns_on_the_jvm(spark, pattern):
    values = ["asha@x", "b", "[(]", "&", "a", "a\n", "xx]", "-[b", "aa", ""]
    sql = f"t RLIKE {text_literal(jvm_pattern(pattern, PLAIN_FLAGS))} AS hit"
    got = {r["t"]: r["hit"] for r in spark.createDataFrame([(v,) for v in values], "t string").selectExpr("t", sql).collect()}
    assert got == {v: re.search(pattern, v) is not None for v in values}


def test_patterns_that_match_nothing_are_left_out():
    assert not usable(r"\d*") and not usable("(") and usable(r"\d+")


DIALECT_PATTERNS = [
    r'{"pan"', r"x{,3}y", r"(x)?(?(1)x|y)", r"(?P<q>a+)-(?P=q)", r"(?i:AB)c", r"(?-i:AB)c", r"(?s:a.b)", "(?x) a \\s b # c", r"[[a]+", r"[a&&b]", r"^a$", r"\Aa\Z", r"[^\W\d]+",
    r"[\W_]+", r"\bé\w+\b", r"\Bx", r"a++b", r"(?>a|ab)c", r"(?<=a)b(?!c)", r"(?:(a)|b)(?(1)c|d)", r"(a)(b)?\1(?(2)\2|x)0", r"[]x]", r"[^]x]+", r"a{2,}?b", r".+", r"\s+", r"\d+", r"\S+",
    r"(?a)\w+\b", r"(?m)^b", r"b$", r"[\d\s]x", r"()\1a", r"(a)(?:\1)0", r"\.\*\\", r"ſ|K", r"(?<=(?:ab|cd))e", r"((a)|(b))+(?(2)x|y)", r"a{x}", r"a{1", r"}{", r"\b(?:ab|cd)\b", r"\b[a-f_]+\b", r"\b\d{2}",
]
DIALECT_TEXTS = [
    "asha@x", '{"pan"', "xxy xxxxy y", "a-a aa-aa", "abC ABc AB c", "a\nb", "a b", "[[a", "&a&b", "a\n", "b\na\nb\n", "ab_1é ü٣ x́y", "éa é xéy", "aab aaab", "abc ac", "ab cb abc", "bd ac bc ad",
    "abax0 aabb0 aax0 ababb0", "]x]-", "x\x1cy z\x85 \xa0", "٣x4 12 x12", "\\.*\\", "ſK kSs", "cde abe", "abx aby bay", "a{x} a{1 }{", "aa0", "é\u0301\u200d", "abé cd́ ab",
]


def test_translated_patterns_find_what_python_finds(spark):
    """All matches of each pattern in each text, under the flags of recognisers and of rules."""
    frame = spark.createDataFrame([(k, t) for k, t in enumerate(DIALECT_TEXTS)], "k int, t string")
    for flags in (ANALYSER, RULE):
        found = [f"regexp_extract_all(t, {text_literal(jvm_form(p, flags))}, 0) AS p{k}" for k, p in enumerate(DIALECT_PATTERNS)]
        for row in frame.selectExpr("k", *found).collect():
            for k, p in enumerate(DIALECT_PATTERNS):
                with warnings.catch_warnings():
                    warnings.simplefilter("ignore")
                    want = [m.group() for m in re.finditer(p, DIALECT_TEXTS[row["k"]], flags)]
                assert list(filter(None, row[f"p{k}"])) == list(filter(None, want)), (p, DIALECT_TEXTS[row["k"]])


def test_what_the_jvm_cannot_express_is_told():
    assert not has_jvm_form(r"(x)(?<=\1)") and not has_jvm_form(r"(?<=(a)(?(1)b|c))d") and not has_jvm_form("(")
    assert not has_jvm_form(r"a(?a:\w)") and has_jvm_form(r"(?<=a)b")
    assert not usable(r"(x)(?<=\1)") and EntityRule().usable((r"a{,2}b", r"(x)(?<=\1)", "(")) == [r"a{,2}b"]
