"""Scan settings from JSON-like dicts or files.

Top-level sections are ``scan``, ``sources``, ``custom_recognizers``, ``rule_engine``, ``output`` and one more
section with the analyser settings, whatever its name.
"""

from __future__ import annotations

import json
import os
from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Any

from ..operators.detect import Boost, DetectOptions
from ..operators.recognisers import UPI_DOMAINS, ModelRecogniser, Recogniser
from ..rules import RuleSet, choose_environment, merge_layers, read_layer, resolve_rules
from ..sources.files import FileOutput, Location
from .rulesets import BASE, ENVIRONMENTS, LISTED_ENTITIES

KNOWN_SECTIONS = {"scan", "sources", "custom_recognizers", "rule_engine", "output", "plugins", "_meta"}

# The settings that hold where a config says nothing.
DEFAULTS: dict[str, Any] = {
    "scan": {"input_paths": ["."]},
    "analyser": {
        "entities": LISTED_ENTITIES,
        "score_threshold": 0.35,
        "entity_score_thresholds": {
            "PERSON": 0.6,
            "LOCATION": 0.55,
            "PHONE_NUMBER": 0.55,
            "EMAIL_ADDRESS": 0.6,
            "IN_BANK_ACCOUNT": 0.45,
        },
        "allow_list": [],
        "allow_list_match": "exact",
        "context_words": [],
        "chunk_size_chars": 200000,
        "chunk_overlap_chars": 500,
        "chunk_exact": False,
        "context_enhancer": {
            "enabled": True,
            "context_similarity_factor": 0.35,
            "min_score_with_context_similarity": 0.45,
            "context_prefix_count": 8,
            "context_suffix_count": 2,
        },
    },
    "custom_recognizers": {
        "enable_indian_identifiers": True,
        "aadhaar_checksum_validation": True,
        "upi_generic_pattern": False,
        "upi_handle_domains": list(UPI_DOMAINS),
    },
    "rule_engine": {"enabled": True, "region": "india", "environment": "default", "default_environment": "default"},
    "sources": {"enabled_sources": [], "filesystem": {"enabled": True}, "database": {"enabled": False}},
    "output": {
        "path": "output/output.json",
        "include_text_snippet": True,
        "snippet_context_chars": 24,
        "include_file_hash": True,
        "include_source_metadata": True,
        "mask_file_paths": False,
        "file_path_mask_mode": "full",
        "file_path_base_dir": "",
        "file_path_hash_salt": "",
    },
}


@dataclass(frozen=True)
class ScanSpec:
    """Everything a scan needs, resolved on the driver."""

    rules: RuleSet
    detect: DetectOptions = DetectOptions()
    # Texts up to this length are scanned whole, longer ones in cores of it. Zero or less keeps all texts whole.
    segment_chars: int = 200000
    # Cut texts give the rows of whole ones, whatever the length of matches and context; costs time on short texts.
    exact_cuts: bool = False
    overlap_chars: int = 500
    extra_recognisers: tuple[Recogniser, ...] = ()
    models: tuple[ModelRecogniser, ...] = ()
    locations: tuple[Location, ...] = ()
    files: FileOutput = FileOutput()
    plugins: tuple[str, ...] = ("filesystem",)
    keep_source_metadata: bool = True
    output_path: str = "output/output.json"
    database: Mapping[str, Any] = field(default_factory=dict)

    @property
    def margin_chars(self) -> int:
        """Room on both sides of a core for a match and the widest window around it."""
        windows = [r.context_window_chars for r in self.rules.entity_rules.values()]
        return self.overlap_chars + max([64, self.detect.snippet_chars or 0, *windows])


def expand_env(value: Any) -> Any:
    """``${NAME}`` in strings replaced from the environment; unknown names stay."""
    if isinstance(value, Mapping):
        return {k: expand_env(v) for k, v in value.items()}
    if isinstance(value, list):
        return [expand_env(v) for v in value]
    return os.path.expandvars(value) if isinstance(value, str) else value


def _canonical(config: Mapping[str, Any]) -> dict[str, Any]:
    """The config with its analyser section under the key ``analyser``."""
    out = {k: v for k, v in config.items() if k in KNOWN_SECTIONS}
    rest = [v for k, v in config.items() if k not in KNOWN_SECTIONS and isinstance(v, Mapping)]
    return merge_layers(out, *({"analyser": v} for v in rest))


def rule_layers(settings: Mapping[str, Any], config_dir: str = ".") -> tuple[str, list[Mapping[str, Any]]]:
    """The chosen environment and its layers: the files named in the settings, else the built-in ones."""
    environment = choose_environment(settings)
    base_file = str(settings.get("base_rules_file") or "").strip()
    files = settings.get("environment_rules") or {}
    if not base_file and not files:
        return environment, [BASE, *([ENVIRONMENTS[environment]] if environment in ENVIRONMENTS else [])]
    named = [f for f in (base_file, str(files.get(environment) or "").strip()) if f]
    return environment, [read_layer(os.path.join(config_dir, os.path.expanduser(f))) for f in named]


def rules_for(environment: str = "default", config: Mapping[str, Any] | None = None) -> RuleSet:
    """The built-in rules of one environment on top of the default settings."""
    settings = merge_layers({"rule_engine": {"environment": environment}}, config or {})
    return spec_from(settings).rules


def _texts(value: Any) -> tuple[str, ...]:
    items = [value] if isinstance(value, str) else value if isinstance(value, list) else []
    return tuple(s for s in (str(v).strip() for v in items) if s)


_LOCATION_LISTS = ("input_paths", "include_extensions", "exclude_dirs", "exclude_file_globs")
_LOCATION_SCALARS = ("recursive", "max_file_size_mb", "read_binary_files_as_text")


def _locations(config: Mapping[str, Any]) -> tuple[Location, ...]:
    """Every location overrides any of the scan-wide settings."""
    scan = config["scan"]
    raw = [loc for loc in config["sources"]["filesystem"].get("locations") or [] if isinstance(loc, Mapping)]
    out = []
    for i, loc in enumerate(raw or [{"name": "local_filesystem"}], start=1):
        merged = {**scan, **loc}
        fields: dict[str, Any] = {k: _texts(merged[k]) for k in _LOCATION_LISTS if k in merged}
        fields.update({k: merged[k] for k in _LOCATION_SCALARS if k in merged})
        fields["input_paths"] = fields.get("input_paths") or _texts(scan.get("input_paths")) or (".",)
        name = str(loc.get("name") or f"filesystem_{i}")
        provider = str(loc.get("provider") or "local").strip().lower() or "local"
        out.append(Location(name=name, provider=provider, enabled=bool(loc.get("enabled", True)), **fields))
    return tuple(out)


def _plugins(sources: Mapping[str, Any]) -> tuple[str, ...]:
    """Enabled sources in fixed order; with none enabled the file source is used."""
    listed = _texts(sources.get("enabled_sources"))
    on = {
        "filesystem": bool(sources["filesystem"].get("enabled", True)),
        "database": bool(sources["database"].get("enabled", False)),
    }
    chosen = tuple(name for name, enabled in on.items() if enabled and (not listed or name in listed))
    return chosen or ("filesystem",)


def _base_dirs(output: Mapping[str, Any], scan: Mapping[str, Any]) -> tuple[str, ...]:
    custom = str(output.get("file_path_base_dir") or "").strip()
    if custom:
        return (os.path.abspath(os.path.expanduser(custom)),)
    paths = [os.path.abspath(os.path.expanduser(p)) for p in _texts(scan.get("input_paths"))]
    found = tuple(p if os.path.isdir(p) else os.path.dirname(p) for p in paths if os.path.exists(p))
    return found or (os.getcwd(),)


def output_location(value: str, default_name: str = "output.json") -> str:
    """Where the report goes: a directory, a trailing slash or a name without suffix takes the default name."""
    raw = (value or "").strip()
    if not raw:
        return default_name
    path = os.path.expanduser(raw)
    is_dir = os.path.isdir(path) or raw.endswith(("/", "\\"))
    if is_dir or (not os.path.exists(path) and not os.path.splitext(path)[1]):
        return os.path.join(path, default_name)
    return path


def spec_from(config: Mapping[str, Any], config_dir: str = ".") -> ScanSpec:
    merged = merge_layers(DEFAULTS, _canonical(expand_env(config)))
    analyser, output, engine = merged["analyser"], merged["output"], merged["rule_engine"]
    custom = merged["custom_recognizers"]
    if engine.get("enabled", False):
        environment, layers = rule_layers(engine, config_dir)
        rules = resolve_rules(analyser, custom, layers, environment, str(engine.get("region") or "india"))
    else:
        rules = resolve_rules(analyser, custom, (), "disabled")

    context = analyser["context_enhancer"]
    boost = Boost(
        enabled=bool(context.get("enabled", True)),
        factor=float(context["context_similarity_factor"]),
        floor=float(context["min_score_with_context_similarity"]),
        before=int(context["context_prefix_count"]),
        after=int(context["context_suffix_count"]),
    )
    chunk, overlap = int(analyser["chunk_size_chars"]), int(analyser["chunk_overlap_chars"])
    masked = bool(output["mask_file_paths"])
    return ScanSpec(
        rules=rules,
        detect=DetectOptions(
            boost=boost,
            allow_list=tuple(str(v) for v in analyser.get("allow_list") or ()),
            allow_list_match=str(analyser.get("allow_list_match") or "exact"),
            snippet_chars=int(output["snippet_context_chars"]) if output["include_text_snippet"] else None,
        ),
        segment_chars=max(chunk, 0),
        exact_cuts=bool(analyser["chunk_exact"]),
        overlap_chars=max(ScanSpec.overlap_chars, overlap),
        locations=_locations(merged),
        files=FileOutput(
            include_file_hash=bool(output["include_file_hash"]),
            mask_mode=str(output["file_path_mask_mode"] or "full") if masked else "full",
            base_dirs=_base_dirs(output, merged["scan"]),
            hash_salt=str(output["file_path_hash_salt"] or ""),
            report_path=output_location(str(output["path"])),
        ),
        plugins=_plugins(merged["sources"]),
        keep_source_metadata=bool(output["include_source_metadata"]),
        output_path=output_location(str(output["path"])),
        database=merged["sources"]["database"],
    )


def load_spec(path: str) -> ScanSpec:
    """Settings from a JSON file; relative rule files are looked up next to it."""
    with open(path, encoding="utf-8") as handle:
        return spec_from(json.load(handle), os.path.dirname(os.path.abspath(path)))
