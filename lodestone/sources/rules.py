"""Strict reader of rule files: a small YAML subset in which nothing is skipped silently."""

from __future__ import annotations

import re
from pathlib import Path

FIELDS = {"id", "zdarzenie", "dlugosc_dni", "liczenie", "dni_wolne", "podstawa", "zatwierdzil", "data_zatwierdzenia", "uwaga"}
REQUIRED = {"id", "zdarzenie", "dlugosc_dni", "liczenie", "dni_wolne", "podstawa"}
COUNTING = {"od_dnia_nastepnego": True, "od_dnia_zdarzenia": False}
FREE_DAYS = {"przesun_na_nastepny_roboczy": True, "bez_zmian": False}


class RuleError(ValueError):
    """An incomplete or unknown rule."""


def _scalar(raw: str) -> str | int | bool | None:
    raw = raw.strip()
    if m := re.fullmatch(r"([\"'])(.*)\1", raw):
        return m[2]
    if re.fullmatch(r"-?\d+", raw):
        return int(raw)
    return {"null": None, "~": None, "": None, "true": True, "false": False}.get(raw, raw)


def _without_comment(line: str) -> str:
    return re.match(r"(?:\"[^\"]*\"|'[^']*'|[^#\"'])*", line)[0].rstrip()


def parse_rules(text: str) -> list[dict]:
    """The entries under ``reguly:``; unknown fields and missing ones are errors."""
    rules: list[dict] = []
    inside, folded = False, None
    for number, raw in enumerate(text.splitlines(), 1):
        indent = len(raw) - len(raw.lstrip())
        if folded and (not raw.strip() or indent > folded[1]):
            rules[-1][folded[0]] = f"{rules[-1][folded[0]]} {raw.strip()}".strip()
            continue
        folded = None
        line = _without_comment(raw)
        if not line.strip():
            continue
        if indent == 0:
            inside = line == "reguly:"
            continue
        if not inside:
            continue
        entry = line.strip()
        if entry.startswith("- "):
            rules.append({})
            entry = entry[2:]
        key, colon, value = entry.partition(":")
        if not colon or not rules:
            raise RuleError(f"line {number}: not a field: {entry!r}")
        if key not in FIELDS:
            raise RuleError(f"line {number}: unknown field {key!r}")
        if value.strip() == ">":
            folded, value = (key, indent), '""'
        rules[-1][key] = _scalar(value)
    for rule in rules:
        if missing := sorted(REQUIRED - {k for k, v in rule.items() if v is not None}):
            raise RuleError(f"rule {rule.get('id')!r} lacks {missing}")
        if rule["liczenie"] not in COUNTING or rule["dni_wolne"] not in FREE_DAYS or not isinstance(rule["dlugosc_dni"], int):
            raise RuleError(f"rule {rule['id']!r} has an unknown value")
    return rules


def read_rules(spark, path: str):
    """A rules DataFrame as ``lodestone.operators.deadlines`` expects it."""
    from lodestone.operators.deadlines import RULE_SCHEMA

    rows = [
        (r["id"], r["zdarzenie"], r["dlugosc_dni"], r["podstawa"], COUNTING[r["liczenie"]], FREE_DAYS[r["dni_wolne"]], r.get("zatwierdzil"))
        for r in parse_rules(Path(path).read_text(encoding="utf-8"))
    ]
    return spark.createDataFrame(rows, RULE_SCHEMA)
