"""Recognisers: which patterns find which entity, with base scores, context words, checks and cheap gates."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column

from ..functions import checks
from ..functions.regex_dialect import jvm_form
from ..functions.regexes import PLAIN_FLAGS, jvm_pattern, literal, matches_empty, usable
from ..rules import RuleSet

SqlTest = Callable[[str, str], str]


@dataclass(frozen=True)
class Pattern:
    """A named regex in Python syntax with its base score. ``jvm`` replaces the translated form when given.

    ``needs`` names something every match contains, so that texts without it are skipped cheaply: a lower-case
    substring, or the length (1, 4 or 6) of a run of digits.
    """

    name: str
    regex: str
    score: float = 0.5
    needs: str | int | None = None
    jvm: str | None = None

    def __post_init__(self) -> None:
        if matches_empty(self.regex):
            raise ValueError(f"pattern {self.name!r} matches the empty string")
        if isinstance(self.needs, int) and self.needs not in (1, 4, 6):
            raise ValueError("a needed digit run is 1, 4 or 6 long")

    @property
    def jvm_regex(self) -> str:
        return self.jvm or jvm_form(self.regex)


@dataclass(frozen=True)
class Recogniser:
    """``validator`` maps a value and its digits, as SQL text, to a test; spans that fail it are dropped.

    With ``promotes`` a passed test sets the score to one.
    """

    entity: str
    name: str
    patterns: tuple[Pattern, ...]
    context: tuple[str, ...] = ()
    validator: SqlTest | None = None
    promotes: bool = True


@dataclass(frozen=True)
class ModelRecogniser:
    """Spans from a model: ``find`` maps a text column to ``array<struct<entity, start, stop, score>>``.

    ``find`` is typically a pandas UDF. It sees one segment at a time, with offsets relative to it.
    """

    name: str
    entities: tuple[str, ...]
    find: Callable[[Column], Column]
    context: tuple[str, ...] = ()


# Patterns, base scores, context words and handle domains of the India identifiers.
AADHAAR = r"(?<!\d)(?:[2-9]\d{3}\s?\d{4}\s?\d{4})(?!\d)"
PAN = r"\b[A-Z]{5}[0-9]{4}[A-Z]\b"
IFSC = r"\b[A-Z]{4}0[A-Z0-9]{6}\b"
UPI_STRICT = r"\b[a-zA-Z0-9._-]{2,}@(?:DOMAINS)\b"
UPI_GENERIC = r"\b[a-zA-Z0-9._-]{2,}@[a-zA-Z]{2,64}\b"
PASSPORT = r"\b[A-PR-WYa-pr-wy][1-9]\d{6}\b"
BANK_ACCOUNT = r"\b\d{9,18}\b"
UPI_DOMAINS = ("upi", "ybl", "ibl", "axl", "paytm", "okhdfcbank", "okicici", "oksbi", "okaxis")
AADHAAR_CONTEXT = ("aadhaar", "uidai", "identity number", "government id")
PAN_CONTEXT = ("pan", "income tax", "permanent account number")
IFSC_CONTEXT = ("ifsc", "bank", "branch", "account")
UPI_CONTEXT = ("upi", "vpa", "gpay", "phonepe", "paytm", "bhim", "payment")
PASSPORT_CONTEXT = ("passport", "travel document")
BANK_CONTEXT = ("account", "bank", "ifsc", "branch", "beneficiary")

# Our own patterns for the general entities, after public standards.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
# Starts are tried only where a run of address characters begins or the previous match ended, and a run is
# taken whole. The matches are the same, but a long run without '@' costs one pass, not one per character.
EMAIL_JVM = jvm_pattern(r"(?:(?<![A-Za-z0-9._%+-])|\G)" + EMAIL.replace("+@", "++@"))
PHONE = (
    r"(?:\+\d{1,3}[ -]?(?:\(\d{2,5}\)[ -]?)?|\(\d{2,5}\)[ -]?|\b)\d{3,5}(?:[ -]?\d{3,5}){1,2}\b"
)
CARD = r"\b(?:\d{13,19}|\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{1,7}|\d{4}[ -]\d{6}[ -]\d{4,5})\b"
IBAN = r"\b[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)\b"
IPV4 = r"\b(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)\b"
IPV6 = r"\b(?:[0-9a-f]{1,4}:){7}[0-9a-f]{1,4}\b"
# The same patterns behind a test of the first character, which fails faster at most positions.
PHONE_JVM, CARD_JVM, IPV4_JVM = (jvm_pattern(look + p) for look, p in ((r"(?=[+(\d])", PHONE), (r"(?=\d)", CARD), (r"(?=\d)", IPV4)))
URL = r"\bhttps?://[^\s<>\"']+"
ISO_DATE = r"(?<!\d)\d{4}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])(?!\d)"


def _own(name: str, regex: str, score: float, needs: str | int) -> Pattern:
    """One of the patterns above; they are written so that both dialects read them alike."""
    return Pattern(name, regex, score, needs, jvm_pattern(regex))


def india_recognisers(custom: Mapping[str, Any]) -> list[Recogniser]:
    domains = custom.get("upi_handle_domains") or UPI_DOMAINS
    strict = UPI_STRICT.replace("DOMAINS", "|".join(literal(str(d)) for d in domains))
    upi = [_own("upi_strict", strict, 0.7, "@")]
    if custom.get("upi_generic_pattern", False):
        upi.append(_own("upi_generic", UPI_GENERIC, 0.45, "@"))
    checksum = bool(custom.get("aadhaar_checksum_validation", True))
    aadhaar = Recogniser(
        "IN_AADHAAR",
        "IN_AADHAAR_RECOGNIZER",
        (_own("aadhaar_strict", AADHAAR, 0.35, 4),),
        AADHAAR_CONTEXT,
        lambda _value, digits: checks.aadhaar_valid(digits, checksum),
    )
    return [
        aadhaar,
        Recogniser("IN_PAN", "IN_PAN_RECOGNIZER", (_own("pan_regex", PAN, 0.55, 4),), PAN_CONTEXT),
        Recogniser("IN_IFSC", "IN_IFSC_RECOGNIZER", (_own("ifsc_regex", IFSC, 0.6, 1),), IFSC_CONTEXT),
        Recogniser("IN_UPI_ID", "IN_UPI_RECOGNIZER", tuple(upi), UPI_CONTEXT),
        Recogniser("IN_PASSPORT", "IN_PASSPORT_RECOGNIZER", (_own("passport_regex", PASSPORT, 0.55, 6),), PASSPORT_CONTEXT),
        Recogniser("IN_BANK_ACCOUNT", "IN_BANK_ACCOUNT_RECOGNIZER", (_own("bank_account_regex", BANK_ACCOUNT, 0.35, 6),), BANK_CONTEXT),
    ]


def general_recognisers() -> list[Recogniser]:
    """The built-in general entities. Patterns and scores are this library's own."""
    card_words = ("credit", "card", "visa", "mastercard", "amex", "discover", "jcb", "diners", "maestro")
    ip_patterns = (Pattern("ipv4", IPV4, 0.6, 1, IPV4_JVM), _own("ipv6", IPV6, 0.6, ":"))
    phone = Recogniser(
        "PHONE_NUMBER",
        "PhoneRecognizer",
        (Pattern("phone", PHONE, 0.4, 1, PHONE_JVM),),
        ("phone", "number", "telephone", "cell", "cellphone", "mobile", "call"),
        lambda _value, digits: checks.phone_length(digits),
        promotes=False,
    )
    card = Recogniser(
        "CREDIT_CARD",
        "CreditCardRecognizer",
        (Pattern("credit_card", CARD, 0.3, 4, CARD_JVM),),
        card_words,
        lambda _value, digits: checks.luhn_valid(digits),
    )
    iban = Recogniser(
        "IBAN_CODE",
        "IbanRecognizer",
        (Pattern("iban", IBAN, 0.5, 1, jvm_pattern(IBAN, PLAIN_FLAGS)),),
        ("iban", "bank", "transaction"),
        lambda value, _digits: checks.iban_valid(value),
    )
    return [
        Recogniser("EMAIL_ADDRESS", "EmailRecognizer", (Pattern("email", EMAIL, 0.9, "@", EMAIL_JVM),), ("email",)),
        phone,
        card,
        iban,
        Recogniser("IP_ADDRESS", "IpRecognizer", ip_patterns, ("ip", "ipv4", "ipv6")),
        Recogniser("URL", "UrlRecognizer", (_own("url", URL, 0.5, "://"),), ("url", "website", "link")),
        Recogniser("DATE_TIME", "DateRecognizer", (_own("iso_date", ISO_DATE, 0.5, 4),), ("date", "birthday")),
    ]


def declared_recognisers(rules: RuleSet) -> list[Recogniser]:
    """Recognisers written in rule files. Entries without entity, name or a usable pattern are left out."""
    out = []
    for item in rules.extra_recognisers:
        entity, name = (str(item.get(key) or "").strip() for key in ("entity", "name"))
        declared = [p for p in item.get("patterns") or () if isinstance(p, Mapping)]
        patterns = tuple(
            Pattern(str(p["name"]).strip(), str(p["regex"]).strip(), float(p.get("score", 0.5)), p.get("needs"))
            for p in declared
            if str(p.get("name") or "").strip() and str(p.get("regex") or "").strip() and usable(str(p["regex"]).strip())
        )
        if entity and name and patterns and rules.rule(entity).enabled:
            context = tuple(str(w) for w in item.get("context") or () if str(w).strip())
            out.append(Recogniser(entity, name, patterns, context))
    return out


def select_recognisers(rules: RuleSet, extra: tuple[Recogniser, ...] = ()) -> list[Recogniser]:
    """All recognisers of the scan, less those whose entity is not wanted; these are never evaluated."""
    india = india_recognisers(rules.custom) if rules.custom.get("enable_indian_identifiers", True) else []
    everything = [*general_recognisers(), *india, *declared_recognisers(rules), *extra]
    return [r for r in everything if rules.wants(r.entity)]
