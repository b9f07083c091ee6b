"""Quantity, hex and identity expressions over columns.

All are built-in expressions but for 128-bit integers and bit masks of binary columns, which are Arrow UDFs.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SAFE_INTEGER = 2**53 - 1
#: Kinds of debug frames, by their upper-cased name: fixed values.
FRAME_KINDS = {"CALL": "call", "CALLCODE": "call", "DELEGATECALL": "call", "STATICCALL": "call", "CREATE": "create", "CREATE2": "create", "SELFDESTRUCT": "selfdestruct", "SUICIDE": "selfdestruct", "STOP": None, "INVALID": None}


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def digits(c: Column | str) -> Column:
    """The text behind ``0x``, if there."""
    return F.regexp_replace(_col(c), "^0x", "")


def qty_u64(c: Column | str) -> Column:
    """A hex quantity as decimal(20,0): 0 where it is malformed or over 64 bits, null for null."""
    c, none = _col(c), F.lit(0).cast("decimal(20,0)")
    return F.when(c.rlike("^(0x)?0*[0-9a-fA-F]{1,16}$"), F.coalesce(F.conv(F.ltrim(c, F.lit("0x")), 16, 10).cast("decimal(20,0)"), none)).when(c.isNotNull(), none)


def qty_long(c: Column | str) -> Column:
    """``qty_u64`` as bigint, for heights, times and indexes."""
    return qty_u64(c).try_cast("long")


def qty_safe(c: Column | str) -> Column:
    """A hex quantity that JSON readers keep exact: null above 2**53 - 1 or where malformed."""
    v = qty_u64(c)
    d = digits(c)
    return F.when(d.rlike("^[0-9a-fA-F]+$") & (F.length(F.regexp_replace(d, "^0+(?=.)", "")) <= 16) & (v <= SAFE_INTEGER), v.cast("long"))


def to_qty(c: Column | str) -> Column:
    """An integer as a hex quantity."""
    return F.concat(F.lit("0x"), F.lower(F.hex(_col(c).cast("long"))))


def to_hex(c: Column | str) -> Column:
    """Bytes as lower-case hex."""
    return F.concat(F.lit("0x"), F.lower(F.hex(_col(c))))


def hex_strict(c: Column | str) -> Column:
    """Bytes of an even number of hex digits; null where malformed."""
    d = digits(c)
    return F.when(d.rlike("^([0-9a-fA-F]{2})*$"), F.unhex(F.when(d.rlike("^([0-9a-fA-F]{2})*$"), d)))


def hex_or_empty(c: Column | str) -> Column:
    """``hex_strict``, empty where malformed or null."""
    return F.coalesce(hex_strict(c), F.lit(b""))


def hex_integer(c: Column | str) -> Column:
    """Big-endian bytes of a quantity of at most 32 bytes without leading zeros; null where malformed."""
    d = F.regexp_replace(digits(c), "^0+", "")
    good = digits(c).rlike("^[0-9a-fA-F]+$") & (F.length(d) <= 64)
    return F.when(good, F.unhex(F.when(good, F.when(F.length(d) % 2 == 1, F.concat(F.lit("0"), d)).otherwise(d))))


def hex_node_style(c: Column | str) -> Column:
    """Bytes up to the first pair that isn't hex; a trailing digit is dropped."""
    return F.unhex(F.regexp_extract(_col(c), "^((?:[0-9a-fA-F]{2})*)", 1))


def revert_reason(output: Column | str) -> Column:
    """The reason in a call's output: from hex digit 134 on, a length byte and so many bytes of text, lossily decoded."""
    raw = hex_node_style(F.substring(digits(output), 135, 1 << 30))
    size = F.when(F.octet_length(raw) > 0, F.conv(F.hex(F.substring(raw, 1, 1)), 16, 10).cast("int")).otherwise(0)
    return _lossy(F.substring(raw, F.lit(2), size))


@F.pandas_udf(T.StringType())
def _lossy(raw: pd.Series) -> pd.Series:
    return raw.map(lambda x: None if x is None else bytes(x).decode("utf-8", "replace"))


def is_zero_bloom(c: Column | str) -> Column:
    return _col(c).rlike("^(0x)?0*$")


def is_address(c: Column | str) -> Column:
    return _col(c).rlike("^0x[0-9a-fA-F]{40}$")


def is_header_safe(c: Column | str) -> Column:
    """Whether a hash can stand in a header: not empty, no control character but the tab."""
    return (F.length(_col(c)) > 0) & ~_col(c).rlike("[\\x00-\\x08\\x0a-\\x1f\\x7f]")


def frame_kind(c: Column | str) -> Column:
    """The upper-cased kind of a debug frame, ``UNKNOWN`` for others."""
    up = F.upper(_col(c))
    return F.when(up.isin(*FRAME_KINDS), up).otherwise("UNKNOWN")


def frame_type(c: Column | str) -> Column:
    """call, create or selfdestruct; null for kinds that make no trace."""
    named = F.create_map(*[F.lit(x) for k, v in FRAME_KINDS.items() if v for x in (k, v)])
    return F.try_element_at(named, F.upper(_col(c)))


def qty_digits(c: Column | str) -> Column:
    """A hex quantity of up to 128 bits as decimal digits, "0" where it is malformed, larger or null; built-in functions alone, for use within arrays.

    Decimals end below 2**128, so the last digit is worked out apart: a * 2**64 + b is 10 * (a div 10) * 2**64 and (a mod 10) * 2**64 + b.
    """
    c, number = _col(c), "decimal(38,0)"
    whole = F.lpad(F.ltrim(c, F.lit("0x")), 32, "0")
    a, b = (F.conv(F.substring(whole, at, 16), 16, 10).cast(number) for at in (1, 17))
    rest = (a % 10) * F.expr("18446744073709551616BD") + b
    tens = F.floor(a / 10).cast(number) * F.expr("18446744073709551616BD") + F.floor(rest / 10).cast(number)
    text = F.concat(F.when(tens > 0, tens.cast("string")).otherwise(""), (rest % 10).cast("int").cast("string"))
    return F.when(c.rlike("^(0x)?0*[0-9a-fA-F]{1,32}$"), text).otherwise("0")


@F.pandas_udf(T.StringType())
def qty_u128(c: pd.Series) -> pd.Series:
    """A hex quantity of up to 128 bits as decimal digits: 0 where it is malformed or larger."""
    return c.map(lambda x: None if x is None else str(parse_u128(x) or 0))


@F.pandas_udf(T.StringType())
def qty_u128_checked(c: pd.Series) -> pd.Series:
    """As ``qty_u128``, null where malformed or larger."""
    return c.map(lambda x: None if x is None or parse_u128(x) is None else str(parse_u128(x)))


def parse_u128(x: str) -> int | None:
    body = x.removeprefix("0x")
    try:
        v = int(body, 16) if body and not set(body) - set("0123456789abcdefABCDEF") else -1
    except ValueError:
        return None
    return v if 0 <= v < 1 << 128 else None


@F.pandas_udf(T.BooleanType())
def bloom_superset(outer: pd.Series, inner: pd.Series) -> pd.Series:
    """Whether a 256-byte filter has all bits of another; false where either isn't 256 bytes."""

    def one(a, b):
        if a is None or b is None or len(a) != 256 or len(b) != 256:
            return False
        x, y = int.from_bytes(a), int.from_bytes(b)
        return x & y == y

    return pd.Series([one(a, b) for a, b in zip(outer, inner, strict=True)])
