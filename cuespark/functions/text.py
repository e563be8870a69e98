"""Texts of elements, their similarity, and responses of models."""

from __future__ import annotations

import json
import re
from difflib import SequenceMatcher
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuespark.schema import DEFAULTS, POSITIONS, STYLES, resolve_color


_FENCE = re.compile(r"```(?:json)?(.*)```", re.DOTALL)


def text_at(elements: Column, position: str) -> Column:
    """Texts of the elements at a position, in order, with nothing between."""
    return F.array_join(F.transform(F.filter(elements, lambda e: e["position"] == position), lambda e: e["text"]), "")


def positions(elements: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(elements, lambda e: e["position"])))


def numbered(texts: Column) -> Column:
    """Readings one a line, numbered from 1; repeated ones stay."""
    return F.array_join(F.transform(texts, lambda t, k: F.concat((k + 1).cast("string"), F.lit(". "), t)), "\n")


def similarity(a: str | None, b: str | None) -> float | None:
    """Ratcliff-Obershelp ratio of b against a; not symmetric."""
    return None if a is None or b is None else SequenceMatcher(None, a, b).ratio()


@F.pandas_udf(T.DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([similarity(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def ratio(a: Column, b: Column) -> Column:
    """similarity() of two columns. It runs for every row: keep those for which it is needed, see ratio_bound()."""
    return _ratio(a, b)


def ratio_bound(a: Column, b: Column) -> Column:
    """What the ratio is at most: twice the shorter length by the sum of both; 1 for two empty texts."""
    n, m = F.char_length(a), F.char_length(b)
    return F.when(n + m == 0, 1.0).otherwise(2.0 * F.least(n, m) / (n + m))


def strip_fence(text: str) -> str:
    """A response without the code fence around it; a fence that is not closed stays."""
    text = text.strip()
    fenced = _FENCE.fullmatch(text)
    return fenced[1].strip() if fenced else text


def parse_object(raw: str) -> dict[str, Any]:
    value = json.loads(raw)
    if not isinstance(value, dict):
        raise ValueError("a JSON object is wanted")
    return value


def parse_element(item: Any) -> dict[str, str]:
    """One element, defaults for fields that are missing. A null or a value of another kind is an error."""
    if not isinstance(item, dict) or not isinstance(item.get("text"), str):
        raise ValueError("an element needs a text")
    out = {"text": item["text"]} | {k: item.get(k, v) for k, v in DEFAULTS.items()}
    if not all(isinstance(x, str) for x in out.values()):
        raise ValueError("fields of an element are texts")
    if out["style"] not in STYLES or out["position"] not in POSITIONS:
        raise ValueError("unknown style or position")
    return out | {"color": resolve_color(out["color"])}


def parse_elements(raw: str) -> list[dict[str, str]]:
    """Elements of a response; an empty object has none; any element that is wrong makes the response wrong."""
    value = parse_object(strip_fence(raw))
    if not value:
        return []
    items = value.get("subtitles")
    if not isinstance(items, list):
        raise ValueError("subtitles must be a list")
    return [parse_element(x) for x in items]


def parse_has_text(raw: str) -> bool:
    value = parse_object(raw).get("has_text")
    if isinstance(value, bool):
        return value
    if isinstance(value, str) and value.lower() in ("true", "false"):
        return value.lower() == "true"
    raise ValueError("has_text must be true or false")
