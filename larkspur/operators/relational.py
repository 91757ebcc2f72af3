"""The operators as functions on DataFrames, for use without SQL text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from larkspur.functions.values import kind_of

TTL = "expires_at"
#: Columns of stored rows that no statement sees.
HIDDEN = ("_stmt", "_seq")


def ttl_column(df: DataFrame) -> str | None:
    """The integral column named expires_at, in any case."""
    return next((f.name for f in df.schema.fields if f.name.lower() == TTL and kind_of(f.dataType) == "int"), None)


def live(df: DataFrame, now: int) -> DataFrame:
    """Rows that have not expired: a row is visible while expires_at >= now."""
    name = ttl_column(df)
    return df.where(F.col(f"`{name}`") >= F.lit(now)) if name else df


def expired(df: DataFrame, now: int) -> DataFrame:
    name = ttl_column(df)
    return df.where(F.col(f"`{name}`") < F.lit(now)) if name else df.limit(0)


def purge_count(df: DataFrame, now: int) -> DataFrame:
    """One row: how many rows a purge at ``now`` removes."""
    return expired(df, now).agg(F.count(F.lit(1)).alias("removed"))


def scan(df: DataFrame) -> DataFrame:
    return df.select(*[c for c in df.columns if c not in HIDDEN])


def project(df: DataFrame, *columns: str, **aliases: str) -> DataFrame:
    return df.select(*columns, *[F.col(c).alias(a) for a, c in aliases.items()])


def pk_lookup(df: DataFrame, key: str, value: int) -> DataFrame:
    """Equality on the key; the predicate reaches the Parquet statistics."""
    return df.where(F.col(key) == F.lit(value))


def inner_join(left: DataFrame, right: DataFrame, condition: Column) -> DataFrame:
    return left.join(right, condition, "inner")


def count_star(df: DataFrame, alias: str = "COUNT(*)") -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias(alias))


def pk_violations(df: DataFrame, key: str) -> DataFrame:
    """Keys that more than one row has, and how many: partial counts are exchanged, not rows."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("cnt")).where("cnt > 1")


def pk_conflicts(new: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Keys of new rows that are stored already, or twice among the new."""
    return new.select(key).join(stored.select(key), key, "left_semi").unionByName(pk_violations(new, key).select(key))
