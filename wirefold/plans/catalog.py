"""All host-identification queries and their SQL."""

from __future__ import annotations

import importlib
import importlib.util

from .base import ORACLE, QUERIES

FLAGSHIP = "v05_verdict"
_PARTS = ["inventory", "statistics", "lookups", "detection", "exposure", "topology", "feeds", "scalars", "lifecycle", "records", "exports", "streams", "banners", "frames"]

for _name in _PARTS:
    if importlib.util.find_spec(f"{__package__}.{_name}"):
        importlib.import_module(f"{__package__}.{_name}")


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(ORACLE)
