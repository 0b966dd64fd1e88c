"""The filter list of a query: ``[operator, key, [values]]`` items, all of which must hold.

A null never matches, not even a negative operator. Unknown operators and keys and malformed patterns are errors.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

OPERATORS = ("is", "is_not", "matches", "does_not_match", "contains", "does_not_contain")
NEGATIVE = ("is_not", "does_not_match", "does_not_contain")
#: Keys of a query and the hit columns they stand for.
KEYS = {
    "event:name": "event", "event:page": "page", "event:hostname": "host",
    "visit:source": "source", "visit:referrer": "referrer", "visit:utm_source": "utm_source", "visit:utm_medium": "utm_medium",
    "visit:utm_campaign": "utm_campaign", "visit:utm_content": "utm_content", "visit:utm_term": "utm_term", "visit:screen": "device",
    "visit:device": "device", "visit:browser": "browser", "visit:browser_version": "browser_version", "visit:os": "os",
    "visit:os_version": "os_version", "visit:country": "country", "visit:region": "subdivision1_code", "visit:city": "city",
    "visit:entry_page": "entry_page", "visit:exit_page": "exit_page",
}
_META = re.compile(r"[\\.+*?()|\[\]{}^$]")


def column(key: str) -> str:
    """The hit column of a query's key; column names stand for themselves."""
    if key in KEYS:
        return KEYS[key]
    if key in KEYS.values():
        return key
    raise ValueError(f"unknown filter key {key!r}")


def parse(text: str) -> list[tuple[str, str, list[str]]]:
    """The items of a JSON filter list, keys translated; whole numbers become text, malformed items are left out. An
    item of goals that are both events and pages keeps the key "goal"."""
    out = []
    for item in json.loads(text or "[]"):
        if not (isinstance(item, list) and len(item) == 3 and isinstance(item[0], str) and isinstance(item[1], str)):
            continue
        values = item[2] if isinstance(item[2], list) else [item[2]]
        if not values or not all(isinstance(v, (str, int, float)) for v in values):
            continue
        values = [str(int(v)) if isinstance(v, (int, float)) else v for v in values]
        if item[1] == "event:goal":
            held = _goal_columns(values)
            out.append((item[0], *next(iter(held.items()))) if len(held) == 1 else (item[0], "goal", values))
        else:
            out.append((item[0], column(item[1]), values))
    return out


def goal(name: str) -> tuple[str, list[str]]:
    """A goal's column and values: "Visit /x" is the page /x, anything else an event."""
    return ("page", [name.removeprefix("Visit ")]) if name.startswith("Visit ") else ("event", [name])


def _any(parts: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts, F.lit(False))


def pattern(key: Column, regex: str) -> Column:
    """An unanchored match. Its plain beginning is also asked for where the pattern is anchored, as scans can use that."""
    re.compile(regex)
    if not _META.search(regex):
        return key == regex
    if regex.startswith("^") and (plain := _META.split(regex[1:], maxsplit=1)[0][:-1]) and "|" not in regex:
        return key.startswith(plain) & key.rlike(regex)
    return key.rlike(regex)


def _goal_columns(names: list[str]) -> dict[str, list[str]]:
    """The values of goals by hit column."""
    held: dict[str, list[str]] = {}
    for n in names:
        key, values = goal(n)
        held.setdefault(key, []).extend(values)
    return held


def condition(op: str, key: str, values: list[str]) -> Column:
    """One item as a condition on hits."""
    if key == "goal":
        # any goal may be reached, and a negative operator asks for none
        parts = [condition(op, *x) for x in _goal_columns(values).items()]
        return reduce(lambda a, b: a & b, parts) if op in NEGATIVE else _any(parts)
    name = column(key)
    col = F.col(name)
    if name == "city":
        if op not in ("is", "is_not"):
            raise ValueError(f"{op} does not go with city")
        number = [int(v) for v in values]
        return col.isin(number) if op == "is" else col.isNotNull() & ~col.isin(number)
    if op == "is":
        return col.isin(values)
    if op == "is_not":
        return col.isNotNull() & ~col.isin(values)
    if op in ("matches", "does_not_match"):
        found = _any(pattern(col, v) for v in values)
        return found if op == "matches" else col.isNotNull() & ~found
    if op in ("contains", "does_not_contain"):
        joined = "|".join(values)
        re.compile(joined)
        found = col.rlike(joined)
        return found if op == "contains" else col.isNotNull() & ~found
    raise ValueError(f"unknown operator {op!r}; known are {', '.join(OPERATORS)}")


def all_of(items: Iterable[tuple[str, str, list[str]]]) -> Column:
    return reduce(lambda a, b: a & b, (condition(*i) for i in items), F.lit(True))


def compare(col: Column, op: str, low: int, high: int | None = None) -> Column:
    """Range predicates on whole numbers: eq, neq, lt, lte, gt, gte, between (both ends included)."""
    made = {"eq": col == low, "neq": col != low, "lt": col < low, "lte": col <= low, "gt": col > low, "gte": col >= low, "between": col.between(low, high)}
    if op not in made:
        raise ValueError(f"unknown comparison {op!r}")
    return made[op]
