"""Rule sets: layered per-environment settings resolved once on the driver.

A layer is a JSON-like dict with the keys ``analyser_overrides``, ``custom_recognizers_overrides``,
``include_entities``, ``exclude_entities``, ``entities`` and ``additional_pattern_recognizers``. Layers read
from a user's file may name the analyser section differently: any other ``*_overrides`` key is taken for it.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.regex_dialect import RULE, has_jvm_form

DEFAULT_WINDOW = 64
RULE_SCHEMA = (
    "entity string, enabled boolean, score_threshold double, normalization string, "
    "include_values array<string>, exclude_values array<string>, include_patterns array<string>, "
    "exclude_patterns array<string>, required_context array<string>, forbidden_context array<string>, "
    "min_length int, max_length int, context_window_chars int"
)


def merge_layers(*layers: Mapping[str, Any]) -> dict[str, Any]:
    """Later layers win. Dicts merge key by key; lists and scalars are replaced whole."""
    merged: dict[str, Any] = {}
    for layer in layers:
        for key, value in layer.items():
            both_dicts = isinstance(value, Mapping) and isinstance(merged.get(key), Mapping)
            merged[key] = merge_layers(merged[key], value) if both_dicts else value
    return merged


def unique(*lists: Iterable[Any]) -> list[str]:
    """Concatenate, strip, drop blanks; the first of equal values stays."""
    stripped = (str(item).strip() for one in lists for item in one)
    return list(dict.fromkeys(item for item in stripped if item))


@dataclass(frozen=True)
class EntityRule:
    enabled: bool = True
    score_threshold: float | None = None
    normalization: str = "raw"
    include_values: tuple[str, ...] = ()
    exclude_values: tuple[str, ...] = ()
    include_patterns: tuple[str, ...] = ()
    exclude_patterns: tuple[str, ...] = ()
    required_context: tuple[str, ...] = ()
    forbidden_context: tuple[str, ...] = ()
    min_length: int | None = None
    max_length: int | None = None
    context_window_chars: int = DEFAULT_WINDOW

    @classmethod
    def from_dict(cls, raw: Mapping[str, Any]) -> EntityRule:
        def texts(key: str) -> tuple[str, ...]:
            return tuple(str(v) for v in raw.get(key) or ())

        def number(key: str) -> int | None:
            return None if raw.get(key) is None else int(raw[key])

        return cls(
            enabled=raw.get("enabled", True) is not False,
            score_threshold=float(raw["score_threshold"]) if "score_threshold" in raw else None,
            normalization=str(raw.get("normalization", "raw")).lower().strip(),
            include_values=texts("include_values"),
            exclude_values=texts("exclude_values"),
            include_patterns=texts("include_patterns"),
            exclude_patterns=texts("exclude_patterns"),
            required_context=tuple(w.lower() for w in texts("required_context")),
            forbidden_context=tuple(w.lower() for w in texts("forbidden_context")),
            min_length=number("min_length"),
            max_length=number("max_length"),
            context_window_chars=max(0, int(raw.get("context_window_chars", DEFAULT_WINDOW))),
        )

    def usable(self, patterns: tuple[str, ...]) -> list[str]:
        return [p for p in patterns if has_jvm_form(p, RULE)]


@dataclass(frozen=True)
class RuleSet:
    """The effective settings a scan runs with, after all layers and the caller's config are merged."""

    environment: str = "disabled"
    region: str = ""
    entities: tuple[str, ...] = ()
    score_threshold: float = 0.35
    thresholds: Mapping[str, float] = field(default_factory=dict)
    context_words: tuple[str, ...] = ()
    custom: Mapping[str, Any] = field(default_factory=dict)
    entity_rules: Mapping[str, EntityRule] = field(default_factory=dict)
    extra_recognisers: tuple[Mapping[str, Any], ...] = ()
    include_entities: tuple[str, ...] = ()
    exclude_entities: tuple[str, ...] = ()

    def rule(self, entity: str) -> EntityRule:
        return self.entity_rules.get(entity, EntityRule())

    def min_score(self, entity: str) -> float:
        """The lowest score that survives the global and the per-entity thresholds."""
        rule_floor = self.rule(entity).score_threshold
        return max(self.score_threshold, self.thresholds.get(entity, 0.0), rule_floor or 0.0)

    def wants(self, entity: str) -> bool:
        """Listed (an empty list allows all) and not switched off by its rule."""
        return (not self.entities or entity in self.entities) and self.rule(entity).enabled

    def frame(self, spark: SparkSession) -> DataFrame:
        """One row per entity rule, for the table-driven joins. Its size is the number of entities."""
        rows = [
            (
                entity,
                r.enabled,
                r.score_threshold,
                r.normalization,
                *map(list, (r.include_values, r.exclude_values, r.include_patterns, r.exclude_patterns)),
                *map(list, (r.required_context, r.forbidden_context)),
                r.min_length,
                r.max_length,
                r.context_window_chars,
            )
            for entity, r in self.entity_rules.items()
        ]
        return spark.createDataFrame(rows, RULE_SCHEMA)

    def threshold_frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.thresholds.items()), "entity string, threshold double")


def _analyser_overrides(layer: Mapping[str, Any]) -> Mapping[str, Any]:
    sections = [k for k in layer if k.endswith("_overrides") and k != "custom_recognizers_overrides"]
    return merge_layers(*(layer[k] or {} for k in sections))


def resolve_rules(
    analyser: Mapping[str, Any],
    custom: Mapping[str, Any],
    layers: Iterable[Mapping[str, Any]] = (),
    environment: str = "default",
    region: str = "india",
) -> RuleSet:
    """Push the merged rule layers onto the caller's analyser and recogniser settings."""
    layer = merge_layers(*layers)
    overrides = _analyser_overrides(layer)
    raw_rules = {e: r for e, r in (layer.get("entities") or {}).items() if isinstance(r, Mapping)}

    include = unique(layer.get("include_entities") or ())
    exclude = unique(layer.get("exclude_entities") or ())
    listed = overrides["entities"] if "entities" in overrides else analyser.get("entities")
    configured = unique(listed or ())
    allowed = [e for e in unique(configured, include) if e not in exclude] or configured

    thresholds = dict(analyser.get("entity_score_thresholds") or {})
    thresholds.update(overrides.get("entity_score_thresholds") or {})
    thresholds.update({e: r["score_threshold"] for e, r in raw_rules.items() if "score_threshold" in r})

    return RuleSet(
        environment=environment,
        region=region,
        entities=tuple(allowed),
        score_threshold=float(overrides.get("score_threshold", analyser.get("score_threshold", 0.35))),
        thresholds={e: float(t) for e, t in thresholds.items()},
        context_words=tuple(unique(analyser.get("context_words") or (), overrides.get("context_words") or ())),
        custom=merge_layers(custom, layer.get("custom_recognizers_overrides") or {}),
        entity_rules={e: EntityRule.from_dict(r) for e, r in raw_rules.items()},
        extra_recognisers=tuple(r for r in layer.get("additional_pattern_recognizers") or () if isinstance(r, Mapping)),
        include_entities=tuple(include),
        exclude_entities=tuple(exclude),
    )


def choose_environment(settings: Mapping[str, Any], env: Mapping[str, str] | None = None) -> str:
    """The named environment variable, else the configured value, else the default; ``${X}`` counts as unset."""
    variables = os.environ if env is None else env
    variable = str(settings.get("environment_variable") or "").strip()
    candidates = (variables.get(variable) if variable else None, settings.get("environment"))
    for value in candidates:
        name = str(value or "").strip()
        if name and not (name.startswith("${") and name.endswith("}")):
            return name
    return str(settings.get("default_environment") or "").strip() or "default"


def read_layer(path: str) -> dict[str, Any]:
    with open(path, encoding="utf-8") as handle:
        return json.load(handle)


def layered_rule_frame(base: DataFrame, override: DataFrame, key: str = "entity") -> DataFrame:
    """Two rule layers as one frame: per entity and column the override's value where it has one."""
    columns = [c for c in base.columns if c != key]
    joined = base.alias("b").join(override.alias("o"), key, "full")
    return joined.select(key, *(F.coalesce(F.col(f"o.{c}"), F.col(f"b.{c}")).alias(c) for c in columns))
