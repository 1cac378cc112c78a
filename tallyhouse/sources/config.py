"""Load source mappings, business rules and policy bands from YAML."""

from __future__ import annotations

from pathlib import Path

import yaml

from tallyhouse.operators.bands import Bands, parse_bands

CONFIG_DIR = Path(__file__).resolve().parent.parent / "config"
SOURCES_FILE = CONFIG_DIR / "sources.yaml"
RULES_FILE = CONFIG_DIR / "rules.yaml"
BANDS_FILE = CONFIG_DIR / "bands.yaml"


def load_sources(path: Path | str = SOURCES_FILE) -> dict[str, dict]:
    return yaml.safe_load(Path(path).read_text(encoding="utf-8"))["sources"]


def load_rules(path: Path | str = RULES_FILE) -> list[dict]:
    return yaml.safe_load(Path(path).read_text(encoding="utf-8"))["rules"]


def load_bands(path: Path | str = BANDS_FILE) -> dict[str, Bands]:
    """Bands by name; a ValueError if some of them overlap or leave a gap."""
    found = yaml.safe_load(Path(path).read_text(encoding="utf-8"))["bands"]
    return {name: parse_bands(name, config) for name, config in found.items()}
