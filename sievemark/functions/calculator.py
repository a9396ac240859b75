"""Exact arithmetic on expressions of text, with 34 significant digits in divisions and powers."""

from __future__ import annotations

import decimal
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TOKEN = re.compile(r"\s*(?:(\d+(?:\.\d+)?|\.\d+)|(.))")
_WIDE = decimal.Context(prec=2000, rounding=decimal.ROUND_HALF_UP)
_NARROW = decimal.Context(prec=34, rounding=decimal.ROUND_HALF_UP)
MOST_CHARS, MOST_POWER = 2000, 10_000


def calculate(text: str | None) -> str | None:
    """Value of an expression of + - * / % ^ ( ) and numbers, without trailing zeros; null if it has none.

    ^ binds right and before a sign on its left; division and negative powers are rounded to 34 digits.
    """
    if text is None or not text.strip() or len(text) > MOST_CHARS:
        return None
    tokens = [m[1] or m[2] for m in _TOKEN.finditer(text.strip())]
    at = 0

    def take(options: str) -> str | None:
        nonlocal at
        if at < len(tokens) and tokens[at] in options.split():
            at += 1
            return tokens[at - 1]
        return None

    def atom():
        nonlocal at
        if take("("):
            v = total()
            if not take(")"):
                raise ValueError("unclosed")
            return v
        at += 1
        return decimal.Decimal(tokens[at - 1])

    def power():
        base = atom()
        if take("^"):
            n = signed()
            if n != n.to_integral_value() or abs(n) > MOST_POWER:
                raise ValueError("power")
            return _WIDE.power(base, n) if n >= 0 else _NARROW.divide(decimal.Decimal(1), _WIDE.power(base, -n))
        return base

    def signed():
        sign = take("- +")
        return (_WIDE.minus(signed()) if sign == "-" else signed()) if sign else power()

    def product():
        v = signed()
        while op := take("* / %"):
            w = signed()
            v = _WIDE.multiply(v, w) if op == "*" else _NARROW.divide(v, w) if op == "/" else _WIDE.remainder(v, w)
        return v

    def total():
        v = product()
        while op := take("+ -"):
            w = product()
            v = _WIDE.add(v, w) if op == "+" else _WIDE.subtract(v, w)
        return v

    try:
        v = total()
        if at != len(tokens) or not v.is_finite():
            return None
        shown = format(v, "f")
        return (shown.rstrip("0").rstrip(".") if "." in shown else shown) or "0"
    except (ValueError, IndexError, RecursionError, decimal.DecimalException):
        return None


@F.pandas_udf(T.StringType())
def calculated(text: pd.Series) -> pd.Series:
    return text.map(calculate)
