"""Settings, from defaults, a JSON file and SILTSTONE_* environment variables, the last one winning."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Settings:
    root: str = "./data"
    #: Whether --serve serves at all.
    enabled: bool = True
    #: If given, requests but for /health and /ping need it as a bearer token.
    secret: str = ""
    #: Seconds between merge rounds of the first tier, and between flushes of buffered writes.
    merge_timeout_s: float = 10.0
    save_timeout_s: float = 1.0
    #: Whether tables may be created below the root; otherwise only with an s3_url.
    allow_save_to_hd: bool = True
    no_merges: bool = False
    host: str = "0.0.0.0"
    port: int = 7971
    #: Seconds that merged files stay readable before vacuum deletes them.
    grace_s: float = 30.0
    row_group_rows: int = 8124


def load(path: str | None = None, environment: dict[str, str] | None = None) -> Settings:
    values: dict = {}
    if path:
        with open(path) as f:
            raw = json.load(f)
        values = {f.name: raw[f.name] for f in fields(Settings) if f.name in raw}
    env = os.environ if environment is None else environment
    for f in fields(Settings):
        text = env.get(f"SILTSTONE_{f.name.upper()}")
        if text is not None:
            kind = type(f.default)
            values[f.name] = text.lower() in ("1", "true", "yes", "on") if kind is bool else kind(text)
    return Settings(**values)
