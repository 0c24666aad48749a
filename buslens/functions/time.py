"""Text timestamps to exact integer nanoseconds. NULL means the text cannot be represented."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

NANOS_PER_DAY = 86_400 * 1_000_000_000


# Every white space character a text log may carry; trim() alone takes spaces only.
WHITE_SPACE = " \t\n\u000b\f\r\u0085\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITE_SPACE))


def _decimal_ns(text: Column, digits: int) -> Column:
    """Decimal number (point or comma) times 10**digits; finer fractions are rejected."""
    t = F.translate(trimmed(text), ",", ".")
    whole = t.try_cast(f"decimal({20 + digits},{digits})") * F.lit(10 ** digits).cast(f"decimal({digits + 1},0)")
    finer = rf"\.\d{{{digits}}}\d*[1-9]"
    return F.when(t.rlike(r"^[+-]?(?:\d+\.?\d*|\.\d+)$") & ~t.rlike(finer), whole.try_cast("bigint"))


def ts_seconds_ns(text: Column) -> Column:
    return _decimal_ns(text, 9)


def ts_millis_ns(text: Column) -> Column:
    return _decimal_ns(text, 6)


def ts_tod_ns(text: Column) -> Column:
    """h:m:s:fraction with 1 to 9 fraction digits."""
    t = trimmed(text)
    pattern = r"^(\d{1,2}):(\d{1,2}):(\d{1,2}):(\d{1,9})$"
    h, m, s = (F.regexp_extract(t, pattern, i).try_cast("bigint") for i in (1, 2, 3))
    frac = F.rpad(F.regexp_extract(t, pattern, 4), 9, "0").try_cast("bigint")
    ns = ((h * 60 + m) * 60 + s) * F.lit(1_000_000_000) + frac
    return F.when(t.rlike(pattern) & (h <= 23) & (m <= 59) & (s <= 59), ns)


def ts_css_ns(text: Column) -> Column:
    """ddThhmmssmmm, days counted from 1."""
    t = trimmed(text)
    pattern = r"^(\d{2})T(\d{2})(\d{2})(\d{2})(\d{3})$"
    d, h, m, s, ms = (F.regexp_extract(t, pattern, i).try_cast("bigint") for i in range(1, 6))
    millis = ((((d - 1) * 24 + h) * 60 + m) * 60 + s) * 1000 + ms
    return F.when(t.rlike(pattern) & (d >= 1) & (h <= 23) & (m <= 59) & (s <= 59), millis * 1_000_000)
