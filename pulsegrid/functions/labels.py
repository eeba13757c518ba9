"""Column expressions over label maps: identity, merging, matching.

A label map is MAP<STRING, STRING>. Maps can be neither joined nor sorted on, so
joins and ordering use the text keys made here and carry the map along. A label that
is absent reads as the empty string everywhere.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Longest pattern that a matcher accepts, in bytes.
PATTERN_LIMIT = 512
MATCHER_TYPE = "array<struct<name:string,op:string,value:string>>"
OPERATORS = ("=", "!=", "=~", "!~")


def entries(labels: Column) -> Column:
    """Array of (key, value), sorted by key; empty for a null map."""
    return F.coalesce(F.array_sort(F.map_entries(labels)), F.array().cast("array<struct<key:string,value:string>>"))


def from_entries(pairs: Column) -> Column:
    return F.map_from_entries(pairs)


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\,={}])", r"\\$1")


def series_key(name: Column, labels: Column) -> Column:
    """Injective text identity: name{k=v,...} with keys sorted and delimiters escaped; the bare name without labels."""
    pairs = F.transform(entries(labels), lambda e: F.concat(escaped(e["key"]), F.lit("="), escaped(e["value"])))
    return F.when(F.size(pairs) == 0, escaped(name)).otherwise(F.concat(escaped(name), F.lit("{"), F.array_join(pairs, ","), F.lit("}")))


def label_key(labels: Column) -> Column:
    """Injective text identity of a label set alone."""
    return F.array_join(F.transform(entries(labels), lambda e: F.concat(escaped(e["key"]), F.lit("="), escaped(e["value"]))), ",")


def labels_of(key: Column) -> Column:
    """The label set of a label_key. Keys without an escaped character, nearly all, are split natively."""
    plain = F.str_to_map(key, F.lit(","), F.lit("="))
    return F.when(key == "", F.create_map().cast("map<string,string>")).when(~key.contains("\\"), plain).otherwise(parse_series_key(F.concat(F.lit("x{"), key, F.lit("}")))["labels"])


_UNIT = r"(?:[^\\,={}]|\\[\\,={}])"


def parse_series_key(key: Column) -> Column:
    """The inverse of series_key as a struct (name, labels); null where the text isn't a key."""
    plain = lambda c: F.regexp_replace(c, r"\\(.)", "$1")
    pair = rf"({_UNIT}*)=({_UNIT}*)"
    whole = rf"(?s)\A{_UNIT}*(?:\{{{pair}(?:,{pair})*\}})?\z".replace("(" + _UNIT, "(?:" + _UNIT)
    body = F.regexp_extract(key, rf"(?s)\A{_UNIT}*\{{(.*)\}}\z", 1)
    found = F.regexp_extract_all(body, F.lit(rf"(?s){pair}(?:,|\z)"), F.lit(0))
    pairs = F.transform(
        found,
        lambda p: F.struct(plain(F.regexp_extract(p, rf"(?s)^{pair}", 1)).alias("key"), plain(F.regexp_extract(p, rf"(?s)^{pair}", 2)).alias("value")),
    )
    name = plain(F.regexp_extract(key, rf"(?s)\A{_UNIT}*", 0))
    labels = F.map_from_entries(F.when(body == "", F.array().cast("array<struct<key:string,value:string>>")).otherwise(pairs))
    return F.when(key.rlike(whole), F.struct(name.alias("name"), labels.alias("labels")))


def canonical_labels(labels: Column) -> Column:
    """Readable text of a label set, keys sorted: k="v", k2="v2"; {} without labels."""
    pairs = F.transform(entries(labels), lambda e: F.concat(e["key"], F.lit('="'), e["value"], F.lit('"')))
    return F.when(F.size(pairs) == 0, "{}").otherwise(F.array_join(pairs, ", "))


def merge_labels(*maps: Column) -> Column:
    """One map of all, later ones winning; null maps count as empty."""
    out = entries(maps[0])
    for later in maps[1:]:
        over = entries(later)
        names = F.transform(over, lambda e: e["key"])
        out = F.concat(F.filter(out, lambda e: ~F.array_contains(names, e["key"])), over)
    return from_entries(out)


def without(labels: Column, names: list[str]) -> Column:
    return F.map_filter(labels, lambda k, _: ~k.isin(names))


def only(labels: Column, names: list[str]) -> Column:
    return F.map_filter(labels, lambda k, _: k.isin(names))


def label(labels: Column, name: str | Column) -> Column:
    """The value of a label, or the empty string."""
    return F.coalesce(F.try_element_at(labels, F.lit(name) if isinstance(name, str) else name), F.lit(""))


def fingerprint(rule_id: Column, labels: Column) -> Column:
    """Sixteen hexadecimal digits of a digest over the rule's id and the sorted labels, each field led by its length."""

    def field(text: Column) -> Column:
        return F.concat(F.unhex(F.lpad(F.hex(F.octet_length(text).cast("long")), 16, "0")), F.encode(text, "UTF-8"))

    all_fields = F.aggregate(entries(labels), field(rule_id), lambda done, e: F.concat(done, field(e["key"]), field(e["value"])))
    return F.substring(F.sha2(all_fields, 256), 1, 16)


def match_labels(labels: Column, wanted: dict[str, str]) -> Column:
    """Whether all labels have the wanted values."""
    out = F.lit(True)
    for name, value in wanted.items():
        out = out & (label(labels, name) == value)
    return out


@dataclass(frozen=True)
class Matcher:
    """A predicate on one label; patterns match whole values."""

    name: str
    op: str
    value: str

    def __post_init__(self):
        if not self.name or self.op not in OPERATORS:
            raise ValueError(f"a matcher needs a label and one of {OPERATORS}, not {self.name!r} {self.op!r}")
        if self.op in ("=~", "!~"):
            check_pattern(self.value)


def check_pattern(pattern: str) -> None:
    """Reject what the rule language's patterns lack: look-around, back-references, over-long text."""
    if len(pattern.encode()) > PATTERN_LIMIT:
        raise ValueError(f"a pattern has at most {PATTERN_LIMIT} bytes")
    if re.search(r"\(\?(?:[=!>]|<[=!])|\\[1-9]|[*+?}]\+", pattern):
        raise ValueError(f"look-around, back-references and possessive repeats are not supported: {pattern!r}")
    re.compile(pattern)


def _whole(pattern: Column) -> Column:
    return F.concat(F.lit(r"(?d)\A(?:"), pattern, F.lit(r")\z"))


def label_matcher(labels: Column, matcher: Matcher) -> Column:
    value = label(labels, matcher.name)
    if matcher.op == "=":
        return value == matcher.value
    if matcher.op == "!=":
        return value != matcher.value
    hit = value.rlike(rf"(?d)\A(?:{matcher.value})\z")
    return hit if matcher.op == "=~" else ~hit


def match_all(matchers: Column, labels: Column) -> Column:
    """Whether every matcher of an array column holds; an empty array matches nothing."""

    def holds(m: Column) -> Column:
        value = label(labels, m["name"])
        hit = F.when(m["op"].isin("=", "!="), value == m["value"]).otherwise(F.regexp_like(value, _whole(m["value"])))
        return F.when(m["op"].isin("=", "=~"), hit).otherwise(~hit)

    return F.coalesce((F.size(matchers) > 0) & F.forall(matchers, holds), F.lit(False))
