"""Plug-in surface: user rules and importers as DataFrame functions.

Emitters are registered with ``wirefold.operators.emit.register``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RULES: dict[str, Callable[[DataFrame, DataFrame], DataFrame]] = {}
IMPORTERS: dict[str, Callable[..., DataFrame]] = {}


def register_rule(name: str):
    """A rule: (hosts, verdicts) to rows of hw_addr and severity."""

    def put(fn):
        RULES[name] = fn
        return fn

    return put


def register_importer(name: str):
    """An importer: any arguments to rows of hw_addr, ip_addr, hostname, certainty."""

    def put(fn):
        IMPORTERS[name] = fn
        return fn

    return put


def evaluated(hosts: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Findings of all registered rules."""
    out = None
    for name, fn in RULES.items():
        part = fn(hosts, verdicts).select("hw_addr", F.lit(name).alias("rule"), "severity")
        out = part if out is None else out.unionByName(part)
    return out


@register_rule("unsure")
def _unsure(hosts: DataFrame, verdicts: DataFrame) -> DataFrame:
    low = verdicts.where("certainty < 80").select("hw_addr")
    return hosts.join(low, "hw_addr", "left_semi").select("hw_addr", F.lit("low").alias("severity"))


@register_rule("busy")
def _busy(hosts: DataFrame, verdicts: DataFrame) -> DataFrame:
    return hosts.where("packets > 75").select("hw_addr", F.lit("info").alias("severity"))
