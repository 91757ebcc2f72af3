"""Joins to an index of keys of which one may have a third of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: A key that more than one row in SHARES has is joined in several shares; there are fewer than SHARES such keys.
SHARES = 1000


def share_rows(total: int) -> int:
    return -(-total // SHARES) + 1


def last_share(size: str, total: int) -> Column:
    """Number of shares beyond the first; fewer than SHARES for all keys together."""
    return F.floor(F.col(size) / share_rows(total)).cast("int")


def every_share(size: str, total: int) -> Column:
    return F.explode(F.sequence(F.lit(0), last_share(size, total)))


def salted(rows: DataFrame, index: DataFrame, key: str, size: str, total: int, by: str) -> DataFrame:
    """rows with _salt, the share of its key that a row is in, dealt by column ``by``.

    index: unique keys and the number of rows that have each of them.
    """
    large = index.select(key, last_share(size, total).alias("_last")).where("_last > 0")
    # a null key matches nothing, so its rows may go anywhere
    spread = F.when(F.col(key).isNull(), F.lit(SHARES - 1)).otherwise(F.coalesce("_last", F.lit(0)))
    return rows.join(F.broadcast(large), key, "left").withColumn("_salt", F.pmod(F.xxhash64(by), spread + 1).cast("int")).drop("_last")


def join_index(rows: DataFrame, index: DataFrame, key: str, size: str, total: int, by: str, how: str = "inner") -> DataFrame:
    """rows joined to index on key, without sending all rows of a key to one task."""
    shares = index.withColumn("_salt", every_share(size, total))
    return salted(rows, index, key, size, total, by).join(shares, [key, "_salt"], how).drop("_salt")
