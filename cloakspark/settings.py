"""Configuration: categories, prefixes, thresholds, where the data lies."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field
from pathlib import Path

# Categories of the master list with the prefix of their ids and their entity type, in order of precedence.
CATEGORIES = {"Staff": ("STF", "PERSON"), "Vendor": ("VND", "ORGANIZATION"), "Funder": ("FND", "ORGANIZATION")}
# The sheet that holds each category, and the prefix of ids made up for names outside the list.
SHEETS = {"Staff": "Staff", "Vendor": "Vendors", "Funder": "Funders"}
AUTO_PREFIXES = {"PERSON": "PSN", "ORGANIZATION": "ORG", "EMAIL_ADDRESS": "EML", "URL": "URL", "CUSTOM": "CST"}
# Where a detection can come from; the lower number wins where spans overlap.
SOURCE_PRIORITY = {"master list": 0, "pattern match": 1, "custom word": 2, "model": 3}
# Fixed value: the file that holds the master list.
LIST_FILE = "Names List - Organized.xlsx"


@dataclass(frozen=True)
class Settings:
    language: str = "en"
    score_threshold: float = 0.35
    pages_threshold: float = 0.4
    fuzzy_threshold: float = 0.84
    master_score: float = 0.9
    custom_score: float = 1.0
    pattern_score: float = 0.5
    auto_hash_length: int = 5
    length_slack: int = 3
    entities: tuple[str, ...] = ("PERSON", "ORGANIZATION", "EMAIL_ADDRESS", "URL")
    categories: dict[str, tuple[str, str]] = field(default_factory=lambda: dict(CATEGORIES))
    sheets: dict[str, str] = field(default_factory=lambda: dict(SHEETS))
    auto_prefixes: dict[str, str] = field(default_factory=lambda: dict(AUTO_PREFIXES))

    @property
    def entity_of(self) -> dict[str, str]:
        return {c: e for c, (_, e) in self.categories.items()}

    @property
    def prefix_of(self) -> dict[str, str]:
        return {c: p for c, (p, _) in self.categories.items()}


DEFAULTS = Settings()


def read_saved(path: str | Path) -> dict:
    """The saved settings; a file that is missing, damaged or no JSON object counts as none."""
    try:
        got = json.loads(Path(path).read_text(encoding="utf-8"))
    except (OSError, ValueError):
        return {}
    return got if isinstance(got, dict) else {}


def save(path: str | Path, **values: str) -> None:
    """Adds values to the saved settings and leaves the others as they are."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps({**read_saved(path), **values}, indent=2), encoding="utf-8")


def data_dir(saved: dict, variable: str, fallback: str, environ: dict[str, str] | None = None) -> str:
    """The data folder: the saved one, else a non-empty environment variable, else the fallback."""
    return saved.get("data_dir") or (os.environ if environ is None else environ).get(variable, "").strip() or fallback


def list_path(folder: str | Path) -> Path | None:
    """The master list in a folder, if it is there under its exact name."""
    path = Path(folder, LIST_FILE)
    return path if path.is_file() else None
