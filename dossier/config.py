"""Extraction settings: a validated, ordered view of the configuration file, and the company gazetteer.

Order of dictionary entries is kept, since levels, prefixes and places are tried in that order.
"""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field
from functools import cached_property
from typing import Any

REQUIRED_RULES = ("COMPANY", "TITLE", "SKILL", "CERT", "DATE", "EMAIL")
DASHES = {"–": "-", "—": "-"}
BULLETS = ["●", "•", "▪", "■", "▸", "►", "‣", "⁃"]
FILE_NAME, GAZETTEER_NAME = "resume_config.json", "companies.json"


class ConfigError(ValueError):
    """A setting that is missing or of the wrong type; the message names its path."""


@dataclass(frozen=True)
class Rule:
    """What holds for one entity label."""

    min_length: int | None = None
    exceptions: tuple[str, ...] = ()
    blocked_words: tuple[str, ...] = ()
    aliases: dict[str, str] = field(default_factory=dict)
    strip_prefixes: tuple[str, ...] = ()
    require: str = ""
    reject_patterns: tuple[str, ...] = ()
    gazetteer_bypass: bool = False
    uppercase_bypass: bool = False
    strip_trailing_state_code: bool = False

    @staticmethod
    def of(raw: dict[str, Any]) -> Rule:
        lists = {k: tuple(raw.get(k) or ()) for k in ("exceptions", "blocked_words", "strip_prefixes", "reject_patterns")}
        flags = {k: bool(raw.get(k)) for k in ("gazetteer_bypass", "uppercase_bypass", "strip_trailing_state_code")}
        return Rule(min_length=raw.get("min_length"), aliases=dict(raw.get("aliases") or {}), require=raw.get("require") or "", **lists, **flags)

    @property
    def least(self) -> int:
        return 2 if self.min_length is None else self.min_length


@dataclass(frozen=True)
class Config:
    """Everything the operators need; built by `from_dict` or `load`."""

    seniority_keywords: dict[str, list[str]]
    seniority_by_years: dict[str, int]
    seniority_by_count: dict[str, int]
    phone_prefixes: dict[str, str]
    us_states: tuple[str, ...]
    cities: dict[str, str]
    country_aliases: dict[str, str]
    multi_word_skills: tuple[str, ...]
    dashes: dict[str, str]
    bullets: tuple[str, ...]
    bullet_replacement: str
    strip_labels: tuple[str, ...]
    table_categories: tuple[str, ...]
    table_max_words: int
    table_max_chars: int
    do_dashes: bool
    do_bullets: bool
    do_tables: bool
    do_spaces: bool
    merge_gap: int
    merge_labels: tuple[str, ...]
    gazetteer_max_words: int
    separators: tuple[str, ...]
    max_months: int
    present_words: tuple[str, ...]
    date_words: tuple[str, ...]
    space_pairs: tuple[tuple[str, str], ...]
    rules: dict[str, Rule]
    companies: tuple[str, ...] = ()

    @cached_property
    def company_set(self) -> frozenset[str]:
        return frozenset(self.companies)

    def rule(self, label: str) -> Rule:
        return self.rules.get(label, Rule())


#: path -> kind, of settings that may be left out but not mistyped; fixed format.
_OPTIONAL = {
    "city_country_map": "object", "city_country_map_file": "string", "multi_word_skills": "strings", "pre_processing": "object",
    "pre_processing.normalize_dashes": "boolean", "pre_processing.normalize_bullets": "boolean", "pre_processing.collapse_multi_spaces": "boolean",
    "pre_processing.expand_skill_tables": "boolean", "pre_processing.strip_labels": "strings", "pre_processing.bullet_chars": "strings",
    "pre_processing.bullet_replacement": "string", "pre_processing.dash_replacements": "string map", "pre_processing.skill_table_categories": "strings",
    "pre_processing.table_prose_max_words": "number", "pre_processing.table_continuation_max_chars": "number",
}
_REQUIRED = {
    "seniority_keywords": "object", "seniority_by_years": "object", "seniority_by_experience_count": "object", "phone_country_prefixes": "object",
    "us_states": "strings", "country_name_aliases": "object", "post_processing": "object",
    "post_processing.span_merge_max_gap": "number", "post_processing.span_merge_labels": "strings", "post_processing.company_gazetteer_match_max_words": "number",
    "post_processing.title_company_separators": "strings", "post_processing.max_experience_months": "number", "post_processing.present_words": "strings",
    "post_processing.date_words": "strings", "post_processing.space_collapse_pairs": "pairs", "post_processing.entity_rules": "object",
} | {f"post_processing.entity_rules.{x}": "object" for x in REQUIRED_RULES}
_KINDS = {
    "object": ("an object", lambda x: isinstance(x, dict)),
    "string": ("a string", lambda x: isinstance(x, str)),
    "strings": ("a string array", lambda x: isinstance(x, list) and all(isinstance(y, str) for y in x)),
    "boolean": ("a boolean", lambda x: isinstance(x, bool)),
    "number": ("a number", lambda x: isinstance(x, int | float) and not isinstance(x, bool) and x == x),
    "string map": ("an object", lambda x: isinstance(x, dict)),
    "pairs": ("an array of string pairs", lambda x: isinstance(x, list) and all(isinstance(y, list | tuple) and len(y) == 2 and all(isinstance(z, str) for z in y) for y in x)),
}
_MISSING = object()


def _at(raw: Any, path: str) -> Any:
    for key in path.split("."):
        if not isinstance(raw, dict) or key not in raw:
            return _MISSING
        raw = raw[key]
    return raw


def validate(raw: Any) -> None:
    """Raise ConfigError with the path of the first setting that is missing or mistyped."""
    if not isinstance(raw, dict):
        raise ConfigError("Invalid resume_config.json: expected root to be an object")
    for path, kind in (_REQUIRED | _OPTIONAL).items():
        value = _at(raw, path)
        if value is _MISSING and path in _OPTIONAL:
            continue
        said, ok = _KINDS[kind]
        if value is _MISSING or not ok(value):
            raise ConfigError(f"Invalid resume_config.json: expected {path} to be {said}")
        if kind == "string map":
            for key, entry in value.items():
                if not isinstance(entry, str):
                    raise ConfigError(f"Invalid resume_config.json: expected {path}.{key} to be a string")
    if "city_country_map" not in raw and "city_country_map_file" not in raw:
        raise ConfigError("Invalid resume_config.json: expected city_country_map or city_country_map_file to be set")


def from_dict(raw: dict[str, Any], companies: tuple[str, ...] = (), cities: dict[str, str] | None = None) -> Config:
    validate(raw)
    pre, post = raw.get("pre_processing") or {}, raw["post_processing"]
    on = lambda key: pre.get(key) is not False
    return Config(
        seniority_keywords=raw["seniority_keywords"], seniority_by_years=raw["seniority_by_years"], seniority_by_count=raw["seniority_by_experience_count"],
        phone_prefixes=raw["phone_country_prefixes"], us_states=tuple(raw["us_states"]), cities=cities or dict(raw.get("city_country_map") or {}),
        country_aliases=raw["country_name_aliases"], multi_word_skills=tuple(x.lower() for x in raw.get("multi_word_skills") or ()),
        dashes=DASHES if pre.get("dash_replacements") is None else pre["dash_replacements"], bullets=tuple(BULLETS if pre.get("bullet_chars") is None else pre["bullet_chars"]),
        bullet_replacement=pre.get("bullet_replacement") or "- ", strip_labels=tuple(pre.get("strip_labels") or ()), table_categories=tuple(pre.get("skill_table_categories") or ()),
        table_max_words=pre.get("table_prose_max_words", 15), table_max_chars=pre.get("table_continuation_max_chars", 60),
        do_dashes=on("normalize_dashes"), do_bullets=on("normalize_bullets"), do_tables=on("expand_skill_tables"), do_spaces=on("collapse_multi_spaces"),
        merge_gap=post["span_merge_max_gap"], merge_labels=tuple(post["span_merge_labels"]), gazetteer_max_words=post["company_gazetteer_match_max_words"],
        separators=tuple(post["title_company_separators"]), max_months=post["max_experience_months"], present_words=tuple(post["present_words"]),
        date_words=tuple(x.lower() for x in post["date_words"]), space_pairs=tuple((a, b) for a, b in post["space_collapse_pairs"]),
        rules={k: Rule.of(v) for k, v in post["entity_rules"].items()}, companies=tuple(sorted({x.lower() for x in companies})),
    )


def _json(path: str) -> Any:
    try:
        with open(path, encoding="utf-8") as f:
            return json.load(f)
    except ValueError as e:
        raise ConfigError(f"Failed to parse {path}: {e}") from e


def load_companies(folder: str) -> tuple[str, ...]:
    """Lower-cased names of all buckets; none without a file."""
    path = os.path.join(folder, GAZETTEER_NAME)
    return tuple(sorted({name.lower() for bucket in _json(path).values() for name in bucket})) if os.path.exists(path) else ()


def load(folder: str) -> Config:
    """Settings and gazetteer of a model folder; the city file counts where it has entries, else the inline map."""
    path = os.path.join(folder, FILE_NAME)
    if not os.path.exists(path):
        raise ConfigError(f"{FILE_NAME} not found at {path}")
    raw = _json(path)
    validate(raw)
    cities: dict[str, str] = {}
    if raw.get("city_country_map_file") and os.path.exists(at := os.path.join(folder, raw["city_country_map_file"])):
        for region in _json(at).values():
            cities |= region
    return from_dict(raw, load_companies(folder), cities)
