"""The engine: statements in, rendered results or DataFrames out."""

from __future__ import annotations

import threading
import time
from collections import OrderedDict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from larkspur.functions.values import coerce, render
from larkspur.operators.relational import ttl_column
from larkspur.plans import messages as M
from larkspur.plans.dialect import BulkInsert, Create, DialectError, Drop, Insert, Select, normalised, parse, split_statements
from larkspur.plans.planner import lower
from larkspur.sources.catalog import COMPACT_AT, HIDDEN, SEQ, Catalog, Table
from larkspur.sources.generators import BIG_USERS, bulk_generate


@dataclass(frozen=True)
class Result:
    columns: tuple[str, ...] = ()
    rows: tuple[tuple[str, ...], ...] = ()


class Engine:
    """One writer at a time, readers on snapshots.

    A DataFrame reads the batches that its tables had when it was made, whatever
    statements follow; those batches stay for ``retention`` seconds at least.

    cache_size, cache_bytes: results kept and the bytes of their texts, least
    recently used first out; a key names the versions of its tables, and the
    time where a table has expiring rows, so an entry can never be stale.
    """

    def __init__(self, spark: SparkSession, warehouse: str | None = None, cache_size: int = 256, cache_bytes: int = 64 << 20, retention: float = 3600):
        self.spark, self.catalog, self.cache_size, self.cache_bytes, self.retention = spark, Catalog(spark, warehouse), cache_size, cache_bytes, retention
        self.cache: OrderedDict[tuple, tuple[Result, int]] = OrderedDict()
        self.writing, self.caching = threading.RLock(), threading.Lock()

    @classmethod
    def over(cls, spark: SparkSession, folder: str, *tables: str) -> Engine:
        """An engine over Parquet tables of a folder, read-only."""
        engine = cls(spark)
        for t in tables:
            engine.catalog.register(t, spark.read.parquet(f"{folder}/{t}.parquet"))
        return engine

    # --- DataFrames ---

    def table(self, name: str) -> DataFrame:
        return self.catalog.frame(self.catalog.get(name))

    def sql(self, text: str, now: int | None = None) -> DataFrame:
        """The DataFrame of one SELECT; nothing runs yet."""
        statement = parse(text)
        if not isinstance(statement, Select):
            raise DialectError(M.UNSUPPORTED)
        return self._frame(statement, int(time.time()) if now is None else now)

    def _frame(self, s: Select, now: int) -> DataFrame:
        if s.join and s.count_alias is not None:
            for name in (s.table.name, s.join.name):
                self.catalog.get(name)
        return lower(s, self.table, now)

    def sql_extended(self, text: str, now: int | None = None) -> DataFrame:
        """Any Spark query over the same tables, without their expired rows; not part of the dialect."""
        now = int(time.time()) if now is None else now
        frames = {}
        for name, t in self.catalog.tables.items():
            df = self.catalog.frame(t)
            ttl = ttl_column(df)
            frames[name] = (df.where(F.col(ttl) >= now) if ttl else df).drop(*HIDDEN)
        # tables come in by name for this query only: no view outlives it
        used = {n: f for n, f in frames.items() if f"{{{n}}}" in text}
        return self.spark.sql(text, **used)

    # --- statements ---

    def exec(self, text: str, callback: Callable[[tuple[str, ...], tuple[str, ...]], object] | None = None, now: int | None = None) -> list[Result]:
        """Results of all statements.

        callback(columns, row) gets the rows as they arrive and may return true
        to stop, also before later batches are read; the results then hold no rows.
        """
        now = int(time.time()) if now is None else now
        statements = split_statements(text)
        if not statements:
            raise DialectError(M.EMPTY)
        results = []
        for s in statements:
            if not callback:
                results.append(self._run(s, now))
                continue
            statement = parse(s)
            if not isinstance(statement, Select):
                results.append(self._run(s, now))
                continue
            columns, rows = self._stream(s, statement, now)
            results.append(Result(columns))
            for row in rows:
                if callback(columns, row):
                    return results
        return results

    def _run(self, text: str, now: int) -> Result:
        statement = parse(text)
        if isinstance(statement, Select):
            return self._select(text, statement, now)
        with self.writing:
            if isinstance(statement, Create):
                self.catalog.create(statement.table, statement.columns)
            elif isinstance(statement, Drop):
                self.catalog.drop(statement.table, statement.if_exists)
            elif isinstance(statement, Insert):
                self._insert(statement)
            else:
                self._bulk(statement)
        return Result()

    def _select(self, text: str, s: Select, now: int) -> Result:
        found = self._cached(self._key(text, s, now))
        if found:
            return found
        columns, rows = self._stream(text, s, now, whole=True)
        result = Result(columns, tuple(rows))
        return self._cached(self._key(text, s, now)) or result

    def _cached(self, key: tuple) -> Result | None:
        with self.caching:
            if key not in self.cache:
                return None
            self.cache.move_to_end(key)
            return self.cache[key][0]

    def _key(self, text: str, s: Select, now: int) -> tuple:
        tables = [self.catalog.get(r.name) for r in (s.table, s.join) if r]
        expiring = any(ttl_column(self.catalog.frame(t)) for t in tables)
        return normalised(text), tuple((t.name.lower(), t.version) for t in tables), now if expiring else None

    def _stream(self, text: str, s: Select, now: int, whole: bool = False) -> tuple[tuple[str, ...], Iterator[tuple[str, ...]]]:
        """Columns and rendered rows, which are cached if they come to an end and are not too many.

        whole: all rows are wanted, so they are read by one job.
        """
        key = self._key(text, s, now)
        found = self._cached(key)
        if found:
            return found.columns, iter(found.rows)
        if whole or s.join or s.count_alias is not None:
            frames = [self._ordered(s, now)]
        else:
            frames = [self._ordered(s, now, lambda _, part=part: part) for part in self.catalog.parts(self.catalog.get(s.table.name))]
        columns = tuple(c for c in frames[0].columns if c not in HIDDEN)
        return columns, self._rendered(key, columns, frames)

    def _rendered(self, key: tuple, columns: tuple[str, ...], frames: list[DataFrame]) -> Iterator[tuple[str, ...]]:
        held: list | None = []
        size = 0
        for df in frames:
            for r in df.toLocalIterator():
                row = tuple(render(v) for v in r[: len(columns)])
                if held is not None:
                    size += 64 + sum(map(len, row))
                    held.append(row)
                    if size > self.cache_bytes // 4:
                        held = None
                yield row
        if held is not None:
            self._keep(key, Result(columns, tuple(held)), size)

    def _keep(self, key: tuple, result: Result, size: int) -> None:
        with self.caching:
            self.cache[key] = result, size
            total = sum(n for _, n in self.cache.values())
            while len(self.cache) > self.cache_size or total > self.cache_bytes:
                total -= self.cache.popitem(last=False)[1][1]

    def _ordered(self, s: Select, now: int, table: Callable[[str], DataFrame] | None = None) -> DataFrame:
        """As _frame, in the order of insertion where the tables record it; joins left-major."""
        df = lower(s, table, now) if table else self._frame(s, now)
        handles = [h for h, r in (("l", s.table), ("r", s.join)) if r and SEQ in self.table(r.name).columns]
        if s.count_alias is not None or not handles:
            return df
        return df.orderBy(*[F.col(f"{h}.{c}") for h in handles for c in HIDDEN])

    def rows(self, text: str, now: int | None = None) -> Iterator[tuple]:
        """Typed rows of one SELECT, a partition at a time."""
        return map(tuple, self.sql(text, now).toLocalIterator())

    def _insert(self, s: Insert) -> None:
        t = self.catalog.get(s.table)
        drop_fraction = self._is_big_users(t)
        rows = []
        for given in s.rows:
            if len(given) != len(t.columns):
                raise DialectError(M.COLUMN_COUNT)
            rows.append(tuple(coerce(v, c, drop_fraction) for v, c in zip(given, t.columns, strict=True)))
        self.catalog.insert(t, rows)

    @staticmethod
    def _is_big_users(t: Table) -> bool:
        return t.name.lower() == "big_users" and [c.name.lower() for c in t.columns] == [c.name.lower() for c in BIG_USERS]

    def _bulk(self, s: BulkInsert) -> None:
        if "big_users" not in self.catalog.tables:
            raise DialectError(M.NO_TABLE.format("big_users"))
        t = self.catalog.get("big_users")
        if not self._is_big_users(t):
            raise DialectError(M.BIG_USERS_SCHEMA)
        if not s.count:
            return
        made = bulk_generate(self.spark, s.start, s.count).toDF(*[c.name for c in t.columns])
        self.catalog.insert_range(t, made.withColumn(SEQ, F.col(t.columns[0].name) - s.start), s.start, s.start + s.count - 1)

    # --- maintenance ---

    def maintain(self, now: int | None = None) -> dict[str, int]:
        """Purge expired rows, rewrite tables of many batches, remove what nobody reads any more; rows purged by table."""
        now = int(time.time()) if now is None else now
        removed = {}
        with self.writing:
            for t in list(self.catalog.tables.values()):
                if t.external is None:
                    removed[t.name] = self.catalog.purge(t, now)
                    if len(t.batches) > COMPACT_AT:
                        self.catalog.compact(t)
            self.catalog.vacuum(self.retention)
        return removed

    def maintain_every(self, seconds: float) -> Callable[[], None]:
        """Run maintain() in the background, again and again; returns a function that stops it."""
        stop = threading.Event()

        def run() -> None:
            while not stop.wait(seconds):
                self.maintain()

        worker = threading.Thread(target=run, daemon=True)
        worker.start()

        def end() -> None:
            stop.set()
            worker.join()

        return end


def connect(spark: SparkSession, warehouse: str | None = None) -> Engine:
    return Engine(spark, warehouse)
