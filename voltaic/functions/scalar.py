"""Scalar helpers (F1-F22) built only from ``pyspark.sql.functions`` so they stay in codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def cents(c) -> Column:
    """Two-decimal amount as exact integer cents (sums of these are exact in any order)."""
    return F.round(_c(c) * 100).cast("long")


def wide_sum(c) -> Column:
    """Exact sum of integer cents that cannot overflow: accumulated as DECIMAL(38,0) (a BIGINT sum
    of money over ~10^11 rows can pass 9.2e18)."""
    return F.sum(_c(c).cast("decimal(38,0)"))


def from_cents_sum(c) -> Column:
    """``sum(cents)`` back to a double amount; identical IEEE steps in Spark and in SQL oracles."""
    return wide_sum(c).cast("double") / 100


def exact_avg_cents(c) -> Column:
    return wide_sum(c).cast("double") / F.count(_c(c)) / 100


def safe_ratio(num: Column, den: Column) -> Column:
    """``num / NULLIF(den, 0)`` — null instead of an ANSI divide-by-zero error."""
    return num / F.nullif(den, F.lit(0))


def month_start(c) -> Column:
    """first day of the month as DATE (``date_trunc`` would give a TIMESTAMP)."""
    return F.trunc(_c(c).cast("date"), "MM")


def months_back(as_of: Column, n: int) -> Column:
    """``add_months(trunc(as_of,'MM'), -n)``; keeps DATE and clamps month ends."""
    return F.add_months(F.trunc(as_of.cast("date"), "MM"), -n)


def month_in_wrapped(c, start: int, end: int) -> Column:
    """Month between ``start`` and ``end`` where the range may wrap the year (10..3)."""
    m = F.month(_c(c))
    return m.between(start, end) if start <= end else (m >= start) | (m <= end)


def code_lookup(key, values: list[str]) -> Column:
    """Simple ``CASE k WHEN 0 THEN v0 ...`` over a small code table, 0-based."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), F.pmod(_c(key), F.lit(len(values))).cast("int") + 1)


def band(c, hi: float, lo: float, labels=("positive", "negative", "neutral")) -> Column:
    """``> hi`` first label, ``< lo`` second, else third."""
    x = _c(c)
    return F.when(x > hi, labels[0]).when(x < lo, labels[1]).otherwise(labels[2])


def locale_number(c, digits: int = 2, currency: str | None = None) -> Column:
    """thousands ``.`` and decimal ``,`` (``1.234.567,89``), optional currency suffix."""
    s = F.translate(F.format_number(_c(c), digits), ",.", ".,")
    return F.concat(s, F.lit(" " + currency)) if currency else s


def tidy_label(c) -> Column:
    """underscores to spaces, then title case (``sql_generation`` -> ``Sql Generation``)."""
    return F.initcap(F.regexp_replace(_c(c), "_", " "))


# The inline-image pattern the chat log replaces before display, and its placeholder.
INLINE_IMAGE = r"!\[.*?\]\(data:image/png;base64,.*?\)"
IMAGE_PLACEHOLDER = "[Grafico visualizzato sopra]"


def strip_inline_images(c, placeholder: str = IMAGE_PLACEHOLDER) -> Column:
    return F.regexp_replace(_c(c), INLINE_IMAGE, placeholder)


def preview(c, n: int = 80) -> Column:
    """First ``n`` characters followed by ``...``."""
    return F.concat(F.substring(_c(c), 1, n), F.lit("..."))


def fold_of(key, folds: int) -> Column:
    """A row's fold, 0 to ``folds`` - 1, from the MD5 of its key as text (any SQL engine can repeat it)."""
    key = F.col(key) if isinstance(key, str) else key
    return F.pmod(F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(folds))


def fold_sql(key: str, folds: int) -> str:
    return f"CAST('0x' || substr(md5(CAST({key} AS VARCHAR)), 1, 8) AS BIGINT) % {folds}"
