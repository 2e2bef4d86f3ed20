"""Registries: what is watched, by which rules, and what was corrected or looked at. Files of YAML (where it is installed) or JSON
are checked field by field and become rows."""

from __future__ import annotations

import datetime as dt
import json
import re
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from tessera.functions.linking import Company, Conditional
from tessera.operators.rules import RULES, SignalRule


class RegistryError(ValueError):
    """A registry that does not keep to its fields; the message says where."""


@dataclass(frozen=True)
class Fields:
    """What the entries of a registry hold: fields with their types, those that may be absent, and those that tell entries apart."""

    types: dict[str, type | tuple[type, ...]]
    optional: frozenset[str] = frozenset()
    unique: tuple[str, ...] = ()


_TEXT, _LIST, _NUMBER = str, list, (int, float)
REGISTRIES = {
    "watchlist": Fields({"symbol": _TEXT, "name": _TEXT, "aliases": _LIST, "ambiguous": _LIST, "conditional": _LIST, "excludes": _LIST, "search": _LIST}, frozenset({"aliases", "ambiguous", "conditional", "excludes", "search"}), ("symbol",)),
    "benchmarks": Fields({"symbol": _TEXT, "name": _TEXT}, unique=("symbol",)),
    "signals": Fields({"name": _TEXT, "type": _TEXT, "params": dict, "direction": _TEXT, "cooldown": int, "label": _TEXT}, frozenset({"direction", "cooldown", "label"}), ("name",)),
    "actions": Fields({"symbol": _TEXT, "ex_date": _TEXT, "action_type": _TEXT, "price_factor": _NUMBER, "note": _TEXT}, frozenset({"note"}), ("symbol", "ex_date")),
    "alerts": Fields({"type": _TEXT, "severity": _TEXT, "params": dict}, frozenset({"params"}), ("type",)),
    "study": Fields({"horizons": _LIST, "benchmark": _TEXT, "cluster_gap": int, "min_events": int, "samples": int, "seed": int}),
    "feeds": Fields({"name": _TEXT, "url": _TEXT, "publisher": _TEXT}, frozenset({"publisher"}), ("name",)),
    "topics": Fields({"topic_id": int, "symbol": _TEXT, "until": _TEXT}, frozenset({"symbol", "until"}), ("topic_id",)),
    "universe": Fields({"symbol": _TEXT, "name": _TEXT}, unique=("symbol",)),
    "overrides": Fields({"symbol": _TEXT, "quarter": _TEXT, "basis": _TEXT, "metric": _TEXT, "value": _NUMBER, "source": _TEXT, "check": _TEXT, "reason": _TEXT}, unique=("symbol", "quarter", "basis", "metric")),
    "acknowledged": Fields({"symbol": _TEXT, "quarter": _TEXT, "basis": _TEXT, "metric": _TEXT, "flag": _TEXT, "reason": _TEXT}, unique=("symbol", "quarter", "basis", "metric")),
    "holidays": Fields({"day": _TEXT}, unique=("day",)),
}
#: Parameters of each type of signal rule.
PARAMS = {"ma_cross": {"fast", "slow", "cross"}, "rsi_cross": {"length", "level", "cross"}, "volume_spike": {"window", "multiple"}, "range_breakout": {"window", "side"}, "gap": {"threshold", "side"}}


def read(path: str | Path) -> list[dict]:
    """The entries of a file."""
    text = Path(path).read_text("utf-8")
    if str(path).endswith(".json"):
        data = json.loads(text)
    else:
        import yaml

        data = yaml.safe_load(text)
    if not isinstance(data, list) or not all(isinstance(x, dict) for x in data):
        raise RegistryError(f"{path}: not a list of entries")
    return [{k: v.isoformat() if isinstance(v, dt.date) else v for k, v in x.items()} for x in data]


def checked(entries: list[dict], kind: str) -> list[dict]:
    """entries as they are, if all of them have the fields of that registry and no two are the same one."""
    fields, seen = REGISTRIES[kind], set()
    for i, e in enumerate(entries):
        at = f"{kind} entry {i + 1}"
        if unknown := set(e) - set(fields.types):
            raise RegistryError(f"{at}: unknown fields {sorted(unknown)}")
        if absent := set(fields.types) - fields.optional - {k for k, v in e.items() if v not in (None, "")}:
            raise RegistryError(f"{at}: missing {sorted(absent)}")
        if wrong := [k for k, v in e.items() if v is not None and (not isinstance(v, fields.types[k]) or isinstance(v, bool))]:
            raise RegistryError(f"{at}: wrong type of {wrong}")
        key = tuple(str(e[k]).upper() for k in fields.unique)
        if key and key in seen:
            raise RegistryError(f"{at}: repeats {key}")
        seen.add(key)
    return entries


def companies(entries: list[dict]) -> list[Company]:
    of = lambda e, k: tuple(e.get(k) or ())
    when = lambda c: dt.date.fromisoformat(c["from"]) if c.get("from") else None
    return [Company(e["symbol"], e["name"], of(e, "aliases"), of(e, "ambiguous"), tuple(Conditional(tuple(c["names"]), tuple(c["context"]), when(c)) for c in of(e, "conditional")), of(e, "excludes"), of(e, "search") or (e["name"],)) for e in checked(entries, "watchlist")]


def signal_rules(entries: list[dict]) -> list[SignalRule]:
    out = []
    for e in checked(entries, "signals"):
        if e["type"] not in RULES:
            raise RegistryError(f"signal {e['name']}: unknown type {e['type']}")
        if set(e["params"]) != PARAMS[e["type"]]:
            raise RegistryError(f"signal {e['name']}: parameters are {sorted(PARAMS[e['type']])}")
        if e.get("direction", "from_price") not in ("bullish", "bearish", "from_price"):
            raise RegistryError(f"signal {e['name']}: unknown direction {e['direction']}")
        out.append(SignalRule(e["name"], e["type"], e["params"], e.get("direction", "from_price"), e.get("cooldown", 0), e.get("label", e["name"])))
    return out


def terms(check: str) -> list[tuple[int, int, str]]:
    """(side, sign, element) of an equation like `A + B - C = D`."""
    sides = check.split("=")
    if len(sides) != 2 or not all(re.fullmatch(r"\s*\w+(?:\s*[+-]\s*\w+)*\s*", s) for s in sides):
        raise RegistryError(f"not an equation of sums: {check}")
    return [(k, -1 if sign == "-" else 1, name) for k, side in enumerate(sides) for sign, name in re.findall(r"([+-]?)\s*(\w+)", side)]


def table(spark: SparkSession, entries: list[dict], kind: str) -> DataFrame:
    """A registry of plain fields as rows; lists are arrays of text, other fields text, numbers double. It is as small as its file."""
    names = [n for n, t in REGISTRIES[kind].types.items() if t is not dict]
    sql = {str: "string", list: "array<string>", int: "long", _NUMBER: "double"}
    schema = ", ".join(f"{n} {sql[REGISTRIES[kind].types[n]]}" for n in names)
    value = lambda e, n: float(e[n]) if REGISTRIES[kind].types[n] == _NUMBER else e.get(n)
    return spark.createDataFrame([tuple(value(e, n) for n in names) for e in checked(entries, kind)], schema)


def checks(spark: SparkSession, entries: list[dict]) -> DataFrame:
    """symbol, quarter, basis, metric, side, sign, element of every override's check."""
    rows = [(e["symbol"], e["quarter"], e["basis"], e["metric"], *t) for e in checked(entries, "overrides") for t in terms(e["check"])]
    return spark.createDataFrame(rows, "symbol string, quarter string, basis string, metric string, side int, sign int, element string")
