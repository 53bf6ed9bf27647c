"""Settings of an annotation campaign, read from the environment over defaults."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Campaign:
    """Where a campaign reads and writes, and how it orders its work."""

    comments: str = "comments.parquet"
    log: str = "annotations"
    name: str = "default"
    seed: int = 2026
    batch: int = 20
    resume: bool = True


def campaign(environment: Mapping[str, str] | None = None, prefix: str = "CAMPAIGN_") -> Campaign:
    """``CAMPAIGN_SEED=7`` and the like override the defaults; unknown names and broken numbers raise."""
    given = {k.removeprefix(prefix).lower(): v for k, v in (os.environ if environment is None else environment).items() if k.startswith(prefix)}
    known = {f.name: f for f in fields(Campaign)}
    if extra := sorted(set(given) - set(known)):
        raise ValueError(f"unknown settings: {', '.join(extra)}")
    flags = {"1": True, "true": True, "yes": True, "0": False, "false": False, "no": False}
    made = {}
    for name, value in given.items():
        kind = type(known[name].default)
        if kind is bool and value.lower() not in flags:
            raise ValueError(f"not a flag: {name}={value}")
        made[name] = flags[value.lower()] if kind is bool else kind(value)
    return Campaign(**made)
