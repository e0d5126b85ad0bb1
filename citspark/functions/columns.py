"""Column helpers shared by the operators; all stay inside whole-stage code."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

MISSING_KEY = "__missing__"
OTHER_KEY = "__other__"


def is_missing(col: Column, kind: str = "string") -> Column:
    """Null; NaN of floats; empty arrays."""
    if kind in ("float", "double"):
        return col.isNull() | F.isnan(col)
    if kind.startswith("array"):
        return col.isNull() | (F.size(col) == 0)
    return col.isNull()


def normalize_key(col: Column, kind: str = "string") -> Column:
    """A category as text; missing values are a category of their own."""
    return F.when(is_missing(col, kind), F.lit(MISSING_KEY)).otherwise(col.cast("string"))


def join_key(*cols: Column) -> Column:
    """Crossed category: normalised parts joined with two pipe characters."""
    return F.concat_ws("||", *(normalize_key(c) for c in cols))


def sanitize_name(value: str) -> str:
    """A column-name part: others than letters, digits and _ become _, ends trimmed."""
    named = {MISSING_KEY: "missing", OTHER_KEY: "other"}.get(value)
    return named or re.sub(r"[^A-Za-z0-9_]", "_", value).strip("_") or "value"


def sigmoid(x: Column) -> Column:
    """1 / (1 + e^-x) without overflow on either side."""
    e = F.exp(-F.abs(x))
    return F.when(x >= 0, 1 / (1 + e)).otherwise(e / (1 + e))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once however often, and within whatever lambda, ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def softmax(logits: Column) -> Column:
    """Softmax of an array column; maximum, powers and their sum are taken once a row, not once an element."""
    powers = let(F.array_max(logits), lambda top: F.transform(logits, lambda v: F.exp(v - top)))
    return let(powers, lambda e: let(F.aggregate(e, F.lit(0.0), lambda a, x: a + x), lambda total: F.transform(e, lambda v: v / total)))


def argmax(values: Column) -> Column:
    """Place of the first largest element, from 0."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def leaf_weight(g: Column, h: Column, l2: float) -> Column:
    """-G / (H + lambda); 0 where the denominator is 0."""
    return F.coalesce(F.try_divide(-g, h + F.lit(l2)), F.lit(0.0))


def gain(g: Column, h: Column, l2: float) -> Column:
    """G^2 / (H + lambda); 0 where the denominator is 0."""
    return F.coalesce(F.try_divide(g * g, h + F.lit(l2)), F.lit(0.0))


def rounded(x: Column, digits: int) -> Column:
    """``round`` of a double, bit for bit, without a decimal of each value.

    Far from halves the nearest whole number of units is certain, and its quotient
    is the double nearest to that decimal; the others, and large values, take ``round``.
    """
    unit = F.lit(10.0**digits)
    whole = F.rint(x * unit)
    sure = (F.abs(whole) < F.lit(float(1 << 40))) & (F.abs(x * unit - whole) < 0.499)
    return F.when(sure, whole / unit + 0.0).otherwise(F.round(x, digits))  # + 0.0: no negative zeros


def ascii_tokens(text: Column) -> Column:
    """Runs of [a-z0-9_] after lower-casing A-Z alone."""
    low = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(low, F.lit("([a-z0-9_]+)"), 1)


def md5_bucket(token: Column, dim: int) -> Column:
    """Bucket of a token by the first 32 bits of its MD5."""
    return (F.conv(F.substring(F.md5(token), 1, 8), 16, 10).cast("long") % dim).cast("int")


def embedding_stats(vector: Column) -> dict[str, Column]:
    """mean, std (population), min, max, l2, sum, dim; all 0 for missing vectors."""
    x = F.transform(F.coalesce(vector, F.array().cast("array<float>")), lambda v: v.cast("double"))
    n = F.size(x)
    total = F.aggregate(x, F.lit(0.0), lambda a, v: a + v)
    squares = F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v)
    mean = F.when(n > 0, total / n).otherwise(0.0)
    spread = F.when(n > 0, F.aggregate(x, F.lit(0.0), lambda a, v: a + (v - total / n) * (v - total / n)) / n).otherwise(0.0)
    zero = F.lit(0.0)
    return {"mean": mean, "std": F.sqrt(spread), "min": F.coalesce(F.array_min(x), zero), "max": F.coalesce(F.array_max(x), zero), "l2": F.sqrt(squares), "sum": total, "dim": n.cast("double")}


def bin_of(value: Column, cuts: list[float], missing: Column | None = None, mode: str = "min") -> Column:
    """Bin of a value: the number of cuts <= value, by binary decisions.

    With missing values at fit time ``min`` mode keeps bin 0 for them and shifts
    the others by one; ``max`` mode puts them behind the last bin.
    """
    shift = 1 if missing is not None and mode == "min" else 0

    def search(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo + shift)
        mid = (lo + hi) // 2
        return F.when(value < F.lit(cuts[mid]), search(lo, mid)).otherwise(search(mid + 1, hi))

    found = search(0, len(cuts))
    if missing is None:
        return found.cast("int")
    return F.when(missing, F.lit(0 if mode == "min" else len(cuts) + 1)).otherwise(found).cast("int")
