"""File path parts and masking, as SQL text over an absolute path."""

from __future__ import annotations

from .sqltext import text_literal


def base_name(path: str) -> str:
    return f"regexp_extract({path}, '([^/]*)/*$', 1)"


def suffix(path: str) -> str:
    """The last dotted part of the base name, empty for names like ``.env`` or ``name.``."""
    return f"regexp_extract({path}, '[^/](\\\\.[^./]+)$', 1)"


def relative_to_any(path: str, base_dirs: list[str]) -> str:
    """Relative to the first base directory that contains the path, else the base name."""
    tries = []
    for base in base_dirs:
        prefix = base.rstrip("/") + "/"
        tries.append(f"CASE WHEN startswith({path}, {text_literal(prefix)}) THEN substring({path}, {len(prefix) + 1}) END")
        tries.append(f"CASE WHEN {path} = {text_literal(base.rstrip('/') or '/')} THEN '.' END")
    return f"coalesce({', '.join([*tries, base_name(path)])})"


def hashed(path: str, salt: str) -> str:
    digest = f"sha2(concat({text_literal(salt + '|')}, {path}), 256)"
    return f"concat('file_', substring({digest}, 1, 24), {suffix(path)})"


def masked(path: str, mode: str, base_dirs: list[str], salt: str = "") -> str:
    """Mask by mode ``full``, ``basename``, ``relative``, ``hash`` or ``redacted``; other modes keep the path."""
    return {
        "basename": base_name(path),
        "relative": relative_to_any(path, base_dirs),
        "hash": hashed(path, salt),
        "redacted": "'[REDACTED_PATH]'",
    }.get(mode.strip().lower(), path)
