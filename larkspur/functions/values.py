"""Declared types, literal coercion, byte truncation and text rendering."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from larkspur.plans import messages as M
from larkspur.plans.dialect import ColumnDef, DialectError, Literal

INTEGRAL, FLOATING = ("DECIMAL", "INT", "DATETIME"), ("FLOAT", "REAL")


def spark_type(column: ColumnDef) -> T.DataType:
    return T.LongType() if column.declared in INTEGRAL else T.DoubleType() if column.declared in FLOATING else T.StringType()


def kind_of(spark: T.DataType) -> str:
    """int, float, str, or other (readable, but equal to no literal)."""
    if isinstance(spark, T.ByteType | T.ShortType | T.IntegerType | T.LongType):
        return "int"
    return "float" if isinstance(spark, T.FloatType | T.DoubleType) else "str" if isinstance(spark, T.StringType) else "other"


def cut(text: str, size: int) -> str:
    """At most size bytes of UTF-8, at a character's end; a text ends at its first NUL."""
    return text.split("\0", 1)[0].encode()[:size].decode("utf-8", "ignore")


def cut_column(text: Column, size: int) -> Column:
    """cut() inside a plan."""
    text = F.substring_index(text, "\0", 1)
    raw = text.cast("binary")

    def kept(n: int) -> Column:
        return F.substring(raw, 1, n).cast("string")

    def inside(n: int) -> Column:
        """Does byte n (from 0) go on with the character before it?"""
        return F.hex(F.substring(raw, n + 1, 1)).between("80", "BF")

    out = kept(max(0, size - 3))
    for n in (size - 2, size - 1, size):
        out = F.when(~inside(n), kept(n)).otherwise(out) if n >= 0 else out
    return F.when(F.octet_length(text) <= size, text).otherwise(out)


def coerce(literal: Literal, column: ColumnDef, drop_fraction: bool = False) -> int | float | str:
    """The stored value of a literal; NULL is stored as 0, 0.0 or the empty text."""
    if column.declared in INTEGRAL:
        if literal.kind == "float" and drop_fraction:
            return int(literal.value)
        if literal.kind not in ("int", "null"):
            raise DialectError(M.NEEDS_INTEGER)
        return literal.value or 0
    if column.declared in FLOATING:
        if literal.kind not in ("int", "float", "null"):
            raise DialectError(M.NEEDS_NUMBER)
        return float(literal.value or 0)
    if literal.kind not in ("str", "null"):
        raise DialectError(M.NEEDS_TEXT)
    return cut(literal.value or "", column.length)


def with_defaults(column: Column, kind: str) -> Column:
    """What NULL is stored as, for rows that arrive as a DataFrame."""
    return F.coalesce(column, F.lit({"int": 0, "float": 0.0, "str": ""}[kind]))


def render(value: object) -> str:
    """Text of a value as clients see it: doubles with 15 significant digits."""
    if value is None:
        return "NULL"
    return f"{value:.15g}" if isinstance(value, float) else str(value)


@F.pandas_udf(T.StringType())
def rendered_double(x: pd.Series) -> pd.Series:
    """render() of doubles inside a plan; only a double joined to a text needs it."""
    return pd.Series(np.char.mod("%.15g", x.to_numpy()), x.index).where(x.notna(), None)
