"""Helpers for patterns in Python ``re`` syntax. ``jvm_pattern`` serves the library's own patterns, which both dialects read alike; ``regex_dialect`` translates those of users."""

from __future__ import annotations

import fnmatch
import re

from .regex_dialect import ANALYSER, has_jvm_form

# Ignore case, '.' matches newlines, multi-line anchors, Unicode classes, and '\n' as the only line end (d).
ANALYSER_FLAGS = "(?idmsU)"
PLAIN_FLAGS = "(?dU)"


def jvm_pattern(pattern: str, flags: str = ANALYSER_FLAGS) -> str:
    """The same pattern for java.util.regex, with ``flags`` in front."""
    named = re.sub(r"\(\?P=(\w+)\)", r"\\k<\1>", pattern.replace("(?P<", "(?<"))
    return flags + re.sub(_TOKEN, _jvm_token, named)


# An escaped character, or a whole character class.
_TOKEN = r"(?s)\\.|\[\^?\]?(?:\\.|[^\]\\])*\]"


def _jvm_token(token: re.Match[str]) -> str:
    """``\\Z`` is the very end in Python; in a class ``[``, ``&&`` and a leading ``]`` stand for themselves."""
    text = token[0]
    if text[0] == "\\":
        return "\\z" if text == "\\Z" else text
    head = "[^" if text.startswith("[^") else "["
    body = re.sub(r"(?s)\\.|[\[\]&]", lambda c: c[0] if c[0][0] == "\\" else "\\" + c[0], text[len(head) : -1])
    return f"{head}{body}]"


def matches_empty(pattern: str) -> bool:
    return re.search(pattern, "", ANALYSER) is not None


def usable(pattern: str) -> bool:
    """A pattern that compiles, has a JVM form and finds no empty spans; a declared pattern that does not is left out by itself."""
    return has_jvm_form(pattern, ANALYSER) and not matches_empty(pattern)


def literal(text: str) -> str:
    """Escape ``text`` so that it stands for itself in both regex dialects."""
    return re.sub(r"([^A-Za-z0-9_ ])", r"\\\1", text)


def glob_regex(glob: str) -> str:
    """An anchored JVM regex for a shell glob whose '*' also crosses '/'."""
    body = fnmatch.translate(glob)
    # Python closes the pattern with \Z or \z and opens it with (?s:...); both carry over but for \Z.
    return "^" + re.sub(r"\\[Zz]$", "", body) + "\\z"


def any_case_extension_glob(extensions: list[str]) -> str:
    """A listing glob that matches the extensions in any letter case, for example ``*{.[tT][xX][tT]}``."""

    def any_case(ext: str) -> str:
        return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in ext)

    return "*{" + ",".join(any_case(e) for e in extensions) + "}"
