"""Rule tables: built-in presets and word lists, as plan-time values or as a DataFrame."""

from __future__ import annotations

import json
from functools import lru_cache
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

RULES_DIR = Path(__file__).resolve().parent.parent / "rules"
DEFAULT_PRESET = "fintech"
PRESETS = {
    "fintech": "Fintech & Payments (Default)",
    "saas": "SaaS & B2B Software",
    "ecommerce": "E-Commerce & Retail",
    "general": "General Customer Support",
}
RULE_SCHEMA = (
    "rule_ord int, theme string, keywords array<string>, phrases array<string>, product_area string, "
    "default_severity string, default_intent string, "
    "subthemes array<struct<name:string,terms:array<string>>>, action string"
)


def _checked(rule: dict) -> dict:
    return {
        "theme": rule["theme"],
        "keywords": list(rule["keywords"]),
        "phrases": list(rule["phrases"]),
        "product_area": rule.get("product_area", "other"),
        "default_severity": rule.get("default_severity", "medium"),
        "default_intent": rule.get("default_intent", "complaint"),
        "subthemes": [{"name": s["name"], "terms": list(s["terms"])} for s in rule.get("subthemes", [])],
        "action": rule.get("action", ""),
    }


@lru_cache(maxsize=None)
def _read(path: str) -> tuple:
    try:
        return tuple(_checked(rule) for rule in json.loads(Path(path).read_text("utf-8"))["rules"])
    except (OSError, ValueError, KeyError, TypeError, AttributeError):
        return ()


def load_rules(preset: str | None = DEFAULT_PRESET, folder: str | Path = RULES_DIR) -> list[dict]:
    """Rules of a preset in order; an unknown preset or unreadable file gives the default preset.

    The default preset always comes from the package, whatever ``folder`` holds.
    """
    name = preset or DEFAULT_PRESET
    rules = _read(str(Path(folder) / f"{name}.json")) if name != DEFAULT_PRESET else ()
    return list(rules or _read(str(RULES_DIR / f"{DEFAULT_PRESET}.json")))


def load_taxonomy(spark: SparkSession, preset: str | None = DEFAULT_PRESET, folder: str | Path = RULES_DIR) -> DataFrame:
    """The rules of a preset as a DataFrame keyed by theme, with ``rule_ord``."""
    rows = [{"rule_ord": i, **rule} for i, rule in enumerate(load_rules(preset, folder))]
    return spark.createDataFrame(rows, RULE_SCHEMA)


@lru_cache(maxsize=None)
def lexicon() -> dict:
    return json.loads((RULES_DIR / "lexicon.json").read_text("utf-8"))
