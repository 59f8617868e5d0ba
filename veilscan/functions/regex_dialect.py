"""Python patterns for the JVM: the parse tree of a pattern is walked and each node written in java.util.regex syntax.

What a node means is written out where the dialects differ: ends of lines and texts, the dot, white space and word characters, braces
that are no quantifier, brackets inside classes, named groups, conditionals, flags of a whole pattern or a part of it. Case is left to the JVM's flags.
"""

from __future__ import annotations

import functools
import itertools
import re
import re._parser as parser
import warnings
from re._constants import (
    ANY,
    ASSERT,
    ASSERT_NOT,
    AT,
    ATOMIC_GROUP,
    BRANCH,
    CATEGORY,
    FAILURE,
    GROUPREF,
    GROUPREF_EXISTS,
    IN,
    LITERAL,
    MAX_REPEAT,
    MAXREPEAT,
    MIN_REPEAT,
    NEGATE,
    NOT_LITERAL,
    POSSESSIVE_REPEAT,
    RANGE,
    SUBPATTERN,
)

# Flags under which recogniser patterns and rule patterns are searched.
ANALYSER = re.IGNORECASE | re.MULTILINE | re.DOTALL
RULE = re.IGNORECASE

# Class bodies; Python's word characters are letters, numbers and the underscore, its white space includes four separators that the JVM's lacks.
_UNICODE = {"DIGIT": r"\p{Nd}", "SPACE": r"\s\x{1c}-\x{1f}", "WORD": r"\p{L}\p{N}_"}
_ASCII = {"DIGIT": "0-9", "SPACE": r"\x{9}-\x{d}\x{20}", "WORD": "0-9A-Za-z_"}
_SUFFIX = {MAX_REPEAT: "", MIN_REPEAT: "?", POSSESSIVE_REPEAT: "+"}


class NoJvmForm(ValueError):
    """The JVM has nothing that matches the same texts."""


def _char(code: int) -> str:
    char = chr(code)
    return char if char.isascii() and char.isalnum() else f"\\x{{{code:x}}}"


class _Writer:
    def __init__(self, tree: parser.SubPattern):
        self.flags = tree.state.flags
        self.classes = _ASCII if self.flags & re.ASCII else _UNICODE
        self.tested: set[int] = set()
        self.numbers: dict[int, int] = {}  # Python's group numbers -> those here
        self.marks: dict[int, int] = {}  # an empty group at the end of each group that a condition asks for: a reference to it matches if that group took part
        self.free = itertools.count(1)
        self._find_tested(tree)

    def _find_tested(self, node: object) -> None:
        if isinstance(node, tuple) and node and node[0] is GROUPREF_EXISTS:
            self.tested.add(node[1][0])
        if isinstance(node, (tuple, list, parser.SubPattern)):
            for part in node:
                self._find_tested(part)

    def sequence(self, items: object, flags: int, behind: bool) -> str:
        out, items = [], list(items)
        for k, (op, value) in enumerate(items):
            word = f"[{self.classes['WORD']}]"
            if op is AT and str(value) == "AT_BOUNDARY" and _word_edge(items[k + 1 : k + 2], first=True):
                out.append(f"(?<!{word})")
            elif op is AT and str(value) == "AT_BOUNDARY" and k and _word_edge(items[k - 1 : k], first=False):
                out.append(f"(?!{word})")
            else:
                out.append(self.node(op, value, flags, behind))
        return "".join(out)

    def node(self, op: object, value: object, flags: int, behind: bool) -> str:
        if op is LITERAL:
            return _char(value)
        if op is NOT_LITERAL:
            return f"[^{_char(value)}]"
        if op is ANY:
            return "(?s:.)" if flags & re.DOTALL else r"[^\x{a}]"
        if op is IN:
            return self._class(value)
        if op is AT:
            return self._place(str(value), flags)
        if op is BRANCH:
            return f"(?:{'|'.join(self.sequence(b, flags, behind) for b in value[1])})"
        if op is SUBPATTERN:
            return self._group(*value, flags, behind)
        if op in _SUFFIX:
            least, most, body = value
            inner = self.sequence(body, flags, behind)
            return f"(?:{inner}){{{least},{'' if most is MAXREPEAT else most}}}{_SUFFIX[op]}"
        if op is ATOMIC_GROUP:
            return f"(?>{self.sequence(value, flags, behind)})"
        if op in (ASSERT, ASSERT_NOT):
            direction, body = value
            sign = ("<" if direction < 0 else "") + ("=" if op is ASSERT else "!")
            return f"(?{sign}{self.sequence(body, flags, behind or direction < 0)})"
        if op is FAILURE:
            return "(?!)"
        if op is GROUPREF:
            return f"(?:\\{self._known(self.numbers, value, behind)})"
        if op is GROUPREF_EXISTS:
            group, yes, no = value
            mark = self._known(self.marks, group, behind)
            other = self.sequence(no, flags, behind) if no else ""
            return f"(?:(?:\\{mark}){self.sequence(yes, flags, behind)}|(?!\\{mark}){other})"
        raise NoJvmForm(f"no form of {op}")

    def _known(self, numbers: dict[int, int], group: int, behind: bool) -> int:
        if group not in numbers or behind:
            raise NoJvmForm("a group asked for before its end, or within a lookbehind")
        return numbers[group]

    def _group(self, group: int | None, add: int, remove: int, body: object, flags: int, behind: bool) -> str:
        inner_flags = (flags | add) & ~remove
        if (add | remove) & re.ASCII or add & re.UNICODE:
            raise NoJvmForm("classes that change within a pattern")
        number = next(self.free) if group is not None else None
        inner = self.sequence(body, inner_flags, behind)
        if group is None:
            case = "i" if add & re.IGNORECASE else "-i" if remove & re.IGNORECASE else ""
            return f"(?{case}:{inner})"
        self.numbers[group] = number
        if group in self.tested:
            self.marks[group] = next(self.free)
            inner += "()"
        return f"({inner})"

    def _class(self, items: list) -> str:
        """A class; negative categories (``\\W``) stand beside the others as alternatives, so that no class holds a negated one."""
        negate = items[0][0] is NEGATE
        body, apart = "", []
        for op, value in items[negate:]:
            if op is LITERAL:
                body += _char(value)
            elif op is RANGE:
                body += f"{_char(value[0])}-{_char(value[1])}"
            elif op is CATEGORY:
                name = str(value).removeprefix("CATEGORY_")
                if name.startswith("NOT_"):
                    apart.append(f"[^{self.classes[name.removeprefix('NOT_')]}]")
                else:
                    body += self.classes[name]
            else:
                raise NoJvmForm(f"no form of {op} in a class")
        if not apart:
            return f"[{'^' if negate else ''}{body}]"
        every = "|".join([*([f"[{body}]"] if body else []), *apart])
        return f"(?:(?!{every})(?s:.))" if negate else f"(?:{every})"

    def _place(self, name: str, flags: int) -> str:
        many = bool(flags & re.MULTILINE)
        if name == "AT_BEGINNING_STRING" or (name == "AT_BEGINNING" and not many):
            return r"\A"
        if name == "AT_BEGINNING":
            return r"(?<![^\x{a}])"
        if name == "AT_END_STRING":
            return r"\z"
        if name == "AT_END":
            return r"(?![^\x{a}])" if many else r"(?=\x{a}?\z)"
        word = f"[{self.classes['WORD']}]"
        edge = f"(?<={word})(?!{word})|(?<!{word})(?={word})"
        return f"(?:{edge})" if name == "AT_BOUNDARY" else f"(?!{edge})"


def _word_edge(items: object, first: bool) -> bool:
    """Whatever matches the items begins, or ends, with a word character; then one side of a word boundary beside them is known."""
    items = list(items)
    if not items:
        return False
    op, value = items[0 if first else -1]
    if op is LITERAL:
        return chr(value).isascii() and (chr(value).isalnum() or chr(value) == "_")
    if op is IN:
        plain = lambda c: chr(c).isascii() and (chr(c).isalnum() or chr(c) == "_")
        same = lambda a, b: plain(a) and plain(b) and (a >= 97 or b <= 57 or (65 <= a and b <= 90))
        return all((o is LITERAL and plain(v)) or (o is RANGE and same(*v)) or (o is CATEGORY and str(v) in ("CATEGORY_WORD", "CATEGORY_DIGIT")) for o, v in value)
    if op is SUBPATTERN:
        return _word_edge(value[3], first)
    if op is BRANCH:
        return all(_word_edge(b, first) for b in value[1])
    if op in _SUFFIX:
        return value[0] > 0 and _word_edge(value[2], first)
    return op is ATOMIC_GROUP and _word_edge(value, first)


@functools.lru_cache(maxsize=4096)
def jvm_form(pattern: str, flags: int = ANALYSER) -> str:
    """A pattern for java.util.regex that finds what Python's ``re`` finds with these flags. Raises re.error for what Python rejects, NoJvmForm for what the JVM can't express."""
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        re.compile(pattern, flags)
        tree = parser.parse(pattern, flags)
    writer = _Writer(tree)
    own = ("i" if writer.flags & re.IGNORECASE else "") + ("" if writer.flags & re.ASCII else "uU" if writer.flags & re.IGNORECASE else "U")
    return (f"(?{own})" if own else "") + writer.sequence(tree, writer.flags, False)


def has_jvm_form(pattern: str, flags: int = ANALYSER) -> bool:
    try:
        jvm_form(pattern, flags)
    except (re.error, NoJvmForm, OverflowError, RecursionError):
        return False
    return True
