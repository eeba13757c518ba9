"""Rules, routing and inhibition from JSON files; small, checked, and held on the driver."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from pulsegrid.functions.labels import Matcher
from pulsegrid.operators.alerts import Grouping, InhibitRule
from pulsegrid.operators.rules import INTERVAL, Rule

#: Configuration files larger than this are refused.
FILE_LIMIT = 16 << 20
_RULE_FIELDS = {"id", "tenant_id", "name", "expression", "for", "interval", "severity", "labels", "annotations", "receivers", "enabled", "created_at", "updated_at"}
_ROUTING_FIELDS = {"group_by", "group_wait", "group_interval", "repeat_interval", "default_receivers", "receivers", "inhibit_rules"}


@dataclass(frozen=True)
class LoadedRule:
    rule: Rule
    expression: str
    enabled: bool


@dataclass(frozen=True)
class Routing:
    grouping: Grouping
    receivers: tuple[str, ...]
    inhibit: tuple[InhibitRule, ...]


def _read_strict(spark: SparkSession, path: str) -> dict:
    """One JSON object, read by Spark from any store it knows; anything after it is an error."""
    file = spark.read.format("binaryFile").load(path).select("length", F.when(F.col("length") <= FILE_LIMIT, F.col("content")).alias("content")).head()
    if file is None or file["content"] is None:
        raise ValueError(f"{path}: no file, or more than {FILE_LIMIT} bytes")
    value = json.loads(bytes(file["content"]).decode())
    if not isinstance(value, dict):
        raise ValueError(f"{path}: not an object")
    return value


def _known(value: dict, fields: set[str], where: str) -> None:
    if unknown := set(value) - fields:
        raise ValueError(f"{where}: unknown fields {sorted(unknown)}")


def load_rules(spark: SparkSession, path: str) -> list[LoadedRule]:
    """Rules with defaults filled in; ids are required and unique."""
    file = _read_strict(spark, path)
    _known(file, {"rules"}, path)
    out, seen = [], set()
    for n, r in enumerate(file.get("rules") or []):
        where = f"rules[{n}]"
        if r is None:
            raise ValueError(f"{where}: null")
        _known(r, _RULE_FIELDS, where)
        if not r.get("id"):
            raise ValueError(f"{where}: id is required")
        if r["id"] in seen:
            raise ValueError(f"{where}: duplicate rule id {r['id']!r}")
        seen.add(r["id"])
        if not (r.get("expression") or "").strip():
            raise ValueError(f"{where} ({r['id']}): rule expression is required")
        rule = Rule(
            r["id"], r.get("name") or "", for_=r.get("for") or "0", interval=r.get("interval") or INTERVAL, severity=(r.get("severity") or "warning").strip().lower(), tenant=r.get("tenant_id") or "",
            labels=r.get("labels") or {}, annotations=r.get("annotations") or {}, receivers=tuple(r.get("receivers") or ()),
        )
        out.append(LoadedRule(rule, r["expression"], bool(r.get("enabled", False))))
    return out


def _matchers(items: list[dict], where: str) -> tuple[Matcher, ...]:
    for m in items:
        _known(m, {"name", "op", "value"}, where)
    return tuple(Matcher(m.get("name", ""), m.get("op", "="), m.get("value", "")) for m in items)


def load_routing(spark: SparkSession, path: str) -> Routing:
    """Receivers, grouping and inhibition; names are unique, and defaults exist."""
    file = _read_strict(spark, path)
    _known(file, _ROUTING_FIELDS, path)
    names = [r.get("name") or "" for r in file.get("receivers") or []]
    if not names:
        raise ValueError("at least one receiver is required")
    for n, name in enumerate(names):
        if not name:
            raise ValueError(f"receivers[{n}]: name is required")
        if name in names[:n]:
            raise ValueError(f"receivers[{n}]: duplicate receiver name {name!r}")
    defaults = tuple(file.get("default_receivers") or ())
    for name in defaults:
        if name not in names:
            raise ValueError(f"default_receivers: unknown receiver {name!r}")
    if not defaults:
        raise ValueError("default_receivers must name at least one receiver")
    inhibit = []
    for n, r in enumerate(file.get("inhibit_rules") or []):
        where = f"inhibit_rules[{n}]"
        _known(r, {"source_matchers", "target_matchers", "equal"}, where)
        inhibit.append(InhibitRule(_matchers(r.get("source_matchers") or [], where), _matchers(r.get("target_matchers") or [], where), tuple(r.get("equal") or ())))
    standard = Grouping()
    grouping = Grouping(
        tuple(file.get("group_by") or standard.by), file.get("group_wait") or standard.wait, file.get("group_interval") or standard.interval, file.get("repeat_interval") or standard.repeat, defaults
    )
    return Routing(grouping, tuple(names), tuple(inhibit))
