"""Tables: Parquet batches named by an ordered commit log.

A statement writes its batch folder and then commits one log entry by renaming
it into place.  Opening a warehouse replays the entries.  A batch that a later
entry replaces or drops stays on disk for a time, so that readers who took
their DataFrame before finish; :meth:`Catalog.vacuum` removes it afterwards, as
it does folders of statements that never committed.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from larkspur.functions.values import INTEGRAL, cut_column, kind_of, spark_type, with_defaults
from larkspur.operators.relational import HIDDEN, expired, live, pk_conflicts, pk_violations, ttl_column
from larkspur.plans import messages as M
from larkspur.plans.dialect import ColumnDef, DialectError
from larkspur.sources.files import Files

#: The order of insertion: number of the statement, then of the row in it.
STMT, SEQ = HIDDEN
#: Batches of a table after which maintenance rewrites it, and rows of a file it then writes.
COMPACT_AT, FILE_ROWS = 32, 5_000_000


@dataclass
class Table:
    name: str
    columns: tuple[ColumnDef, ...]
    version: int = 0
    batches: list[str] = field(default_factory=list)
    frames: list[DataFrame] = field(default_factory=list)  # of tables kept in memory
    #: smallest and largest key of each batch; None: not known
    zones: list[list[int] | None] = field(default_factory=list)
    external: DataFrame | None = None

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(c.name, spark_type(c)) for c in self.columns] + [T.StructField(c, T.LongType()) for c in HIDDEN])

    @property
    def key(self) -> str | None:
        """First column flagged PRIMARY KEY, else the first one; enforced only if integral."""
        flagged = next((c for c in self.columns if c.primary), self.columns[0] if self.columns else None)
        return flagged.name if flagged and flagged.declared in INTEGRAL else None


class Catalog:
    def __init__(self, spark: SparkSession, warehouse: str | None):
        """warehouse None: tables live in memory and are gone with the session."""
        self.spark, self.warehouse = spark, warehouse
        self.files = Files(spark, warehouse) if warehouse else None
        self.tables: dict[str, Table] = {}
        #: what no table names any more, since when
        self.retired: dict[str, float] = {}
        self.retired_frames: list[tuple[float, DataFrame]] = []
        self.entry = 0
        if self.files:
            for name in self.files.names("_log"):
                if name.endswith(".json"):
                    self._replay(json.loads(self.files.read(f"_log/{name}")))
                    self.entry = int(name.removesuffix(".json"))

    # --- log ---

    def _commit(self, **entry) -> None:
        entry["at"] = time.time()
        if self.files:
            self.files.commit(f"_log/{self.entry + 1:010d}.json", json.dumps(entry))
        self.entry += 1
        self._replay(entry)

    def _replay(self, e: dict) -> None:
        key = e["table"].lower()
        if e["op"] == "create":
            self.tables[key] = Table(e["table"], tuple(ColumnDef(**c) for c in e["columns"]), self.entry + 1)
        elif e["op"] == "drop":
            self.retired |= dict.fromkeys(self.tables.pop(key).batches, e["at"])
        else:
            t = self.tables[key]
            if e["op"] == "replace":
                self.retired |= dict.fromkeys(t.batches, e["at"])
            t.batches = [*t.batches, *e["batches"]] if e["op"] == "insert" else e["batches"]
            t.zones = [*t.zones, e.get("keys")] if e["op"] == "insert" else [e.get("keys")]
            t.version = self.entry + 1

    # --- tables ---

    def get(self, name: str) -> Table:
        found = self.tables.get(name.lower())
        if not found:
            raise DialectError(M.NO_TABLE.format(name))
        return found

    def frame(self, t: Table) -> DataFrame:
        """All rows as they are now; later statements do not change what it reads."""
        if t.external is not None:
            return t.external
        return self._read(t, range(len(t.zones)))

    def parts(self, t: Table) -> list[DataFrame]:
        """The rows in the order of their statements, in pieces of one batch, two, four and so on."""
        if t.external is not None:
            return [t.external]
        n, cuts = len(t.zones), [0]
        while cuts[-1] < n:
            cuts.append(min(n, 2 * cuts[-1] + 1))
        return [self._read(t, range(i, j)) for i, j in zip(cuts, cuts[1:], strict=False)] or [self._read(t, [])]

    def _read(self, t: Table, which: Sequence[int]) -> DataFrame:
        """The rows of some batches, by their places."""
        if not which:
            return self.spark.createDataFrame([], t.schema)
        if self.files:
            return self.spark.read.schema(t.schema).parquet(*[f"{self.warehouse}/{t.batches[i]}" for i in which])
        return reduce(DataFrame.unionByName, [t.frames[i] for i in which])

    def keys_between(self, t: Table, low: int, high: int) -> DataFrame | None:
        """Stored keys of a range, from those batches that may have some; None if no batch may."""
        which = [i for i, z in enumerate(t.zones) if not z or z[0] <= high and low <= z[1]]
        key = F.col(f"`{t.key}`")
        return self._read(t, which).select(key).where((key >= low) & (key <= high)) if which else None

    def register(self, name: str, df: DataFrame) -> None:
        """A read-only table with its Spark types; no key is enforced."""
        self.entry += 1
        self.tables[name.lower()] = Table(name, (), self.entry, external=df)

    def create(self, name: str, columns: tuple[ColumnDef, ...]) -> None:
        if name.lower() in self.tables:
            raise DialectError(M.TABLE_EXISTS)
        lower = [c.name.lower() for c in columns]
        if len(set(lower)) < len(lower) or set(HIDDEN) & set(lower):
            raise DialectError(M.DUPLICATE_COLUMN)
        self._commit(op="create", table=name, columns=[c.__dict__ for c in columns])

    def drop(self, name: str, if_exists: bool) -> None:
        if name.lower() not in self.tables and if_exists:
            return
        t = self.get(name)
        if t.external is not None:
            del self.tables[name.lower()]
            return
        self._retire(t)
        self._commit(op="drop", table=name)

    # --- rows ---

    def stored(self, t: Table, keys: list[int]) -> DataFrame | None:
        """Those of the keys that are stored; range and keys reach the Parquet scan.  None: no batch may have any."""
        near = self.keys_between(t, min(keys), max(keys))
        return None if near is None else near.where(F.col(f"`{t.key}`").isin(keys))

    def insert(self, t: Table, rows: list[tuple]) -> None:
        """Rows of literals, all or none.

        The keys are checked against stored rows before anything is written;
        expired rows count until maintenance removes them.
        """
        if t.external is not None:
            raise DialectError(M.READ_ONLY.format(t.name))
        zone = None
        if t.key:
            at = [c.name for c in t.columns].index(t.key)
            keys = [r[at] for r in rows]
            known = None if len(set(keys)) < len(keys) else self.stored(t, keys)
            if len(set(keys)) < len(keys) or known is not None and not known.isEmpty():
                raise DialectError(M.DUPLICATE_KEY)
            zone = [min(keys), max(keys)]
        self._add("insert", t, self.spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], T.StructType([f for f in t.schema.fields if f.name != STMT])), zone=zone)

    def insert_range(self, t: Table, rows: DataFrame, low: int, high: int) -> None:
        """Made rows (with SEQ) that have each key of a range once."""
        if t.key:
            known = self.keys_between(t, low, high)
            if known is not None and not known.isEmpty():
                raise DialectError(M.DUPLICATE_KEY)
        # texts and keys that hardly repeat: no dictionaries, differences to the value before
        self._add("insert", t, rows, zone=[low, high], options={"parquet.enable.dictionary": "false", "parquet.writer.version": "v2"})

    def append(self, t: Table, rows: DataFrame) -> None:
        """All rows (with SEQ) or none.

        The batch is written first and its keys are read back, so the rows are
        computed once; a batch that fails the check is never committed.
        """
        if t.external is not None:
            raise DialectError(M.READ_ONLY.format(t.name))
        self._add("insert", t, rows, check=True)

    def insert_frame(self, name: str, df: DataFrame) -> None:
        """Rows of a DataFrame by position, with the rules of INSERT: defaults for NULL, cut texts, unique keys."""
        t = self.get(name)
        if len(df.columns) != len(t.columns):
            raise DialectError(M.COLUMN_COUNT)
        chosen = []
        for f, c in zip(df.schema.fields, t.columns, strict=True):
            want, have = kind_of(spark_type(c)), kind_of(f.dataType)
            if have != want and (want, have) != ("float", "int"):
                raise DialectError(dict(int=M.NEEDS_INTEGER, float=M.NEEDS_NUMBER, str=M.NEEDS_TEXT)[want])
            value = with_defaults(F.col(f"`{f.name}`").cast(spark_type(c)), want)
            chosen.append((cut_column(value, c.length) if want == "str" else value).alias(c.name))
        self.append(t, df.select(*chosen, F.monotonically_increasing_id().alias(SEQ)))

    def _add(self, op: str, t: Table, rows: DataFrame, check: bool = False, zone: list[int] | None = None, options: dict[str, str] | None = None) -> None:
        # batches follow each other in the order of their statements
        rows = rows if op == "replace" else rows.withColumn(STMT, F.lit(self.entry + 1).cast("long")).select(*t.schema.names)
        folder = f"{t.name.lower()}/{uuid.uuid4().hex}"
        if self.files:
            rows.write.options(**(options or {})).parquet(f"{self.warehouse}/{folder}")
        else:
            rows = rows.persist()
        if check and t.key:
            new = (self.spark.read.schema(t.schema).parquet(f"{self.warehouse}/{folder}") if self.files else rows).select(f"`{t.key}`")
            low, high = new.agg(F.min(new[0]), F.max(new[0])).first()
            zone = None if low is None else [low, high]
            near = zone and self.keys_between(t, low, high)
            if not (pk_violations(new, t.key) if near is None else pk_conflicts(new, near, t.key)).isEmpty():
                self.files.delete(folder) if self.files else rows.unpersist()
                raise DialectError(M.DUPLICATE_KEY)
        if op == "replace" and t.zones and all(t.zones):
            zone = [min(z[0] for z in t.zones), max(z[1] for z in t.zones)]
        if not self.files:
            if op == "replace":
                self._retire(t)
            t.frames = [rows] if op == "replace" else [*t.frames, rows]
        self._commit(op=op, table=t.name, batches=[folder] if self.files else [], keys=zone)

    # --- maintenance ---

    def purge(self, t: Table, now: int) -> int:
        """Remove expired rows; how many."""
        if t.external is not None or not ttl_column(self.frame(t)):
            return 0
        gone = expired(self.frame(t), now).count()
        if gone:
            self._add("replace", t, live(self.frame(t), now))
        return gone

    def compact(self, t: Table) -> None:
        """One batch instead of many, clustered by the key and with Bloom filters on it."""
        if not self.files or len(t.batches) < 2:
            return
        frame = self.frame(t)
        n = frame.count()
        files = max(1, -(-n // FILE_ROWS))
        order = [t.key] if t.key else list(HIDDEN)
        bloom = {f"parquet.bloom.filter.enabled#{t.key}": "true", f"parquet.bloom.filter.expected.ndv#{t.key}": str(max(1, n // files))} if t.key else None
        self._add("replace", t, frame.repartitionByRange(files, *order).sortWithinPartitions(*order), options=bloom)

    def _retire(self, t: Table) -> None:
        self.retired_frames += [(time.time(), f) for f in t.frames]

    def vacuum(self, older_than: float) -> int:
        """Remove what no table has named for so many seconds; how many folders.

        A reader's DataFrame works at least that long after a statement has
        replaced what it reads.
        """
        limit = time.time() - older_than
        for _, f in (x for x in self.retired_frames if x[0] <= limit):
            f.unpersist()
        self.retired_frames = [x for x in self.retired_frames if x[0] > limit]
        if not self.files:
            return 0
        used, removed = {b for t in self.tables.values() for b in t.batches}, 0
        for folder in (f for f in self.files.names("") if f != "_log"):
            for name, changed in self.files.changed(folder):
                batch = f"{folder}/{name}"
                if batch not in used and self.retired.get(batch, changed) <= limit:
                    self.files.delete(batch)
                    self.retired.pop(batch, None)
                    removed += 1
        return removed
