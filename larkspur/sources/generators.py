"""Rows that are made rather than read."""

from __future__ import annotations

from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from larkspur.plans.dialect import ColumnDef

# Fixed values of the generated table.
BIG_USERS = (ColumnDef("ID", "DECIMAL"), ColumnDef("NAME", "VARCHAR", 64), ColumnDef("EMAIL", "VARCHAR", 64), ColumnDef("BALANCE", "DECIMAL"), ColumnDef("EXPIRES_AT", "DECIMAL"))
EXPIRES = 1_893_456_000


def bulk_generate(spark: SparkSession, start: int, count: int) -> DataFrame:
    """count users from id start on, made on the executors."""
    return spark.range(start, start + count).select("id", F.concat(F.lit("user"), F.col("id")).alias("name"), F.concat(F.lit("user"), F.col("id"), F.lit("@mail.com")).alias("email"), (F.lit(1000) + F.col("id") % 10000).alias("balance"), F.lit(EXPIRES).cast("long").alias("expires_at"))


#: Digits that decide a number modulo 2**64, as 10**64 is a multiple of it; in pieces that a decimal can multiply.
DIGITS, PIECE = 64, 16


def wrapped(digits: Column, bits: int) -> Column:
    """The number modulo 2**bits, as an unsigned register of that width holds it; bits is 64 at most."""
    padded = F.lpad(F.substring(digits, -DIGITS, DIGITS), DIGITS, "0")
    pieces = [F.substring(padded, 1 + i, PIECE).cast(f"decimal({PIECE},0)") * F.lit(Decimal(10 ** (DIGITS - PIECE - i) % (1 << 64))) for i in range(0, DIGITS, PIECE)]
    any_length = reduce(Column.__add__, pieces).cast("decimal(38,0)")
    number = F.when(F.length(digits) <= 19, F.substring(digits, 1, 19).cast("decimal(38,0)")).otherwise(any_length)
    return (number % F.lit(Decimal(1 << bits))).cast("decimal(20,0)")


def triple_columns(t: Column) -> list[Column]:
    """key, val1, val2 of an array of three texts of digits: an unsigned 64-bit number and two of 32 bits; larger numbers wrap."""
    return [wrapped(t[0], 64).alias("key"), wrapped(t[1], 32).cast("long").alias("val1"), wrapped(t[2], 32).cast("long").alias("val2")]


def digit_fields(text: Column) -> Column:
    """Numbers as texts, of a text with any mix of commas and line ends, up to its first other character."""
    return F.filter(F.split(F.regexp_extract(text, r"^[0-9,\r\n]*", 0), r"[,\r\n]+"), lambda x: x != "")


def triples_in(digits: Column, skip: Column) -> Column:
    """Whole triples of an array of fields, after the first ``skip`` fields."""
    count = F.floor((F.size(digits) - skip) / 3).cast("int")
    return F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.slice(digits, skip + i * 3 + 1, 3))).otherwise(F.array().cast("array<array<string>>"))


def csv_triples(lines: DataFrame, column: str = "value") -> DataFrame:
    """(key, val1, val2) from texts that each stand for themselves; an unfinished last triple is left out.

    Works on batch and streaming DataFrames.  Files that may be larger than a
    task should hold go through :func:`larkspur.streaming.triples.file_triples`.
    """
    digits = digit_fields(F.col(column))
    return lines.select(F.explode(triples_in(digits, F.lit(0))).alias("t")).select(*triple_columns(F.col("t")))
