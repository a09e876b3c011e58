"""Checks and defaults of request values, on the driver."""

from __future__ import annotations

import re
from collections.abc import Iterable

# NER types, model types of column analysis, number of summary rows and of candidates.
NER_TYPES = ("PERS", "LOC", "ORG", "OTHERS")
MODEL_TYPES = ("fast", "accurate")
DEFAULT_K, DEFAULT_LIMIT = 10, 1000


def boolean(value: str | bool | None, default: bool = False) -> bool:
    """``true`` or ``false`` in any case; an absent value is the default."""
    if value is None:
        return default
    if isinstance(value, bool):
        return value
    if value.lower() not in ("true", "false"):
        raise ValueError(f"neither true nor false: {value!r}")
    return value.lower() == "true"


def limit(value: str | int | None, default: int = DEFAULT_LIMIT) -> int:
    if value is None or value == "":
        return default
    try:
        found = int(value)
    except ValueError:
        raise ValueError(f"not a whole number: {value!r}") from None
    if found < 1:
        raise ValueError("a limit is at least 1")
    return found


def k(value: str | int | None) -> int:
    """None and 0 stand for the default."""
    return limit(value or None, DEFAULT_K)


def values(given: str | Iterable[str] | None, preserve_case: bool = True) -> list[str]:
    """Filter values: parts between commas and blanks, distinct and sorted."""
    texts = [given] if isinstance(given, str) else given or []
    parts = {p for t in texts if t for p in re.split(r"[,\s]+", t) if p}
    return sorted(parts if preserve_case else {p.casefold() for p in parts})


def ner_types(given: str | Iterable[str] | None) -> list[str]:
    found = values(given)
    if unknown := [x for x in found if x not in NER_TYPES]:
        raise ValueError(f"not NER types: {', '.join(unknown)}; known are {', '.join(NER_TYPES)}")
    return found


def graph(given: str | None, known: Iterable[str], default: str = "wikidata") -> str:
    """A known graph; the default if none is named."""
    name, known = given or default, list(known)
    if name not in known:
        raise ValueError(f"unknown graph {name!r}; known are {', '.join(known) or 'none'}")
    return name


def model_type(given: str | None) -> str:
    return given if given in MODEL_TYPES else MODEL_TYPES[0]
