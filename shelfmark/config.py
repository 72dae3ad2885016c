"""Settings of a run: defaults, a JSON or TOML file, and what a caller sets on top."""

from __future__ import annotations

import json
import tomllib
from dataclasses import dataclass, fields, replace
from pathlib import Path


@dataclass(frozen=True)
class Settings:
    """What a run reads; a value that is out of range or unknown is an error."""

    site: str = "shop.test"
    max_products: int | None = None
    max_retries: int = 2
    cache_ttl_seconds: int = 86_400
    offline: bool = False
    requests_per_second: float = 1.0
    jitter_seconds: float = 0.3
    agreement_threshold: float = 0.80
    text_threshold: float = 0.90
    shadow_sample: int = 12
    repair_max_fields: int = 2
    repair_samples: int = 8
    repair_candidates: int = 4

    def __post_init__(self) -> None:
        for f in fields(self):
            value = getattr(self, f.name)
            if f.type == "str" and not (isinstance(value, str) and value):
                raise ValueError(f"{f.name} needs a text, not {value!r}")
            if f.type == "bool" and not isinstance(value, bool):
                raise ValueError(f"{f.name} is true or false, not {value!r}")
            if f.type.startswith(("int", "float")) and not (value is None and "None" in f.type) and (isinstance(value, bool) or not isinstance(value, int if f.type.startswith("int") else (int, float)) or value < 0):
                raise ValueError(f"{f.name} needs a number of at least 0, not {value!r}")
        for name in ("agreement_threshold", "text_threshold"):
            if getattr(self, name) > 1:
                raise ValueError(f"{name} is at most 1")
        if self.repair_samples < 1 or self.requests_per_second == 0:
            raise ValueError("repair_samples and requests_per_second are above 0")

    def with_changes(self, **changes) -> Settings:
        """These settings with a caller's values; None leaves a value as it is."""
        return replace(self, **{k: v for k, v in changes.items() if v is not None})


def load(path: str | Path) -> Settings:
    """Settings of a .json or .toml file over the defaults."""
    body = Path(path).read_text(encoding="utf-8")
    found = tomllib.loads(body) if str(path).endswith(".toml") else json.loads(body)
    unknown = set(found) - {f.name for f in fields(Settings)}
    if unknown:
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    return Settings(**found)
