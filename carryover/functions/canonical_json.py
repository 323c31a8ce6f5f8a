"""Canonical JSON (RFC 8785) and strict reading, for digests that must agree everywhere."""

from __future__ import annotations

import hashlib
import json
import math

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

SAFE = 2**53 - 1
MAX_DEPTH = 128


def _number(x: float) -> str:
    """A number as ECMAScript writes it; numbers beyond the safe integers are refused."""
    if isinstance(x, float) and not math.isfinite(x):
        raise ValueError("not a finite number")
    if float(x).is_integer() and abs(x) > SAFE and (isinstance(x, int) or abs(x) < 1e21):
        raise ValueError("an integer beyond 2^53 - 1")
    if isinstance(x, int):
        return str(x)
    if x == 0:
        return "0"
    digits, _, exponent = repr(x).partition("e")
    sign, digits = ("-", digits[1:]) if digits[0] == "-" else ("", digits)
    whole, _, part = digits.partition(".")
    part = "" if part == "0" else part
    point = len(whole) + int(exponent or 0)
    figures = (whole + part).lstrip("0")
    point -= len(whole + part) - len(figures)
    figures = figures.rstrip("0")
    n = len(figures)
    if n <= point <= 21:
        return sign + figures + "0" * (point - n)
    if 0 < point <= 21:
        return f"{sign}{figures[:point]}.{figures[point:]}"
    if -6 < point <= 0:
        return f"{sign}0.{'0' * -point}{figures}"
    e = point - 1
    mantissa = figures[0] + ("." + figures[1:] if n > 1 else "")
    return f"{sign}{mantissa}e{'+' if e >= 0 else '-'}{abs(e)}"


def canonical(value: object) -> str:
    """Keys in UTF-16 order, no spaces, ECMAScript numbers."""
    if value is None or isinstance(value, bool):
        return json.dumps(value)
    if isinstance(value, str):
        return json.dumps(value, ensure_ascii=False)
    if isinstance(value, int | float):
        return _number(value)
    if isinstance(value, list | tuple):
        return "[" + ",".join(map(canonical, value)) + "]"
    if isinstance(value, dict):
        items = sorted(value.items(), key=lambda kv: kv[0].encode("utf-16-be", "surrogatepass"))
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{canonical(v)}" for k, v in items) + "}"
    raise TypeError(type(value).__name__)


def digest(value: object) -> str:
    return "sha256:" + hashlib.sha256(canonical(value).encode("utf-8", "surrogatepass")).hexdigest()


def strict_load(text: str) -> object:
    """JSON without repeated members, NaN, or nesting beyond MAX_DEPTH."""

    def members(pairs: list) -> dict:
        out = dict(pairs)
        if len(out) != len(pairs):
            raise ValueError("a member is repeated")
        return out

    def refuse(name: str) -> None:
        raise ValueError(name)

    try:
        value = json.loads(text, object_pairs_hook=members, parse_constant=refuse)
    except RecursionError as e:
        raise ValueError("nested too deeply") from e
    level, depth = [value], 0
    while level:
        depth += 1
        if depth > MAX_DEPTH + 1:
            raise ValueError("nested too deeply")
        level = [x for v in level for x in (v.values() if isinstance(v, dict) else v if isinstance(v, list) else ()) if isinstance(x, dict | list)]
    return value


@F.pandas_udf(T.StringType())
def canonical_text(values: pd.Series) -> pd.Series:
    """Canonical form of a JSON text; null where it is null, invalid or not representable."""

    def one(v: object) -> str | None:
        if not isinstance(v, str):
            return None
        try:
            return canonical(strict_load(v))
        except ValueError:
            return None

    return pd.Series([one(v) for v in values], dtype=object)
