"""Operator 5: exact dedup with a log-structured merge index of digests.

Every task fills a memtable (digest -> best row and count) and flushes it as
sorted runs, one per digest range, each with a Bloom filter.  Compaction merges
the runs of a range: digests whose filter cells no second run has set cannot
have a partner and pass by; the others are merge-sorted, and the entry with
the longest text and then the smallest identifier is kept.  Rows look their
digest up, and every hit is compared byte by byte with the row that stays; rows
that differ in spite of an equal digest are grouped again by the bytes.

A group of copies reaches compaction once per memtable, never once per row, and
is looked up and verified in shares of about a thousandth of all rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from larkspur.llm import blocks as B
from larkspur.llm.hot import join_index
from larkspur.llm.scratch import Scratch

MEMTABLE = 200_000
RANGE_ROWS = 1_000_000
#: Rows of the index of hits (about 100 bytes each) up to which it is broadcast to the text scan.
BROADCAST_ROWS = 200_000
RUN = 1
HITS = "digest binary, keep_id long, group_size long"
WHITE = " \t\n\x0b\x0c\r"


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), WHITE, "")


def _cells(digests: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    words = digests.view(np.uint64).reshape(len(digests), 4)
    mask = np.uint64((1 << bits) - 1)
    return words[:, 1] & mask, words[:, 2] & mask


def _flush(table: dict[bytes, list[int]], run: int, count: int) -> Iterator[B.Row]:
    """Sorted runs with filters; the table is empty afterwards."""
    keys = sorted(table)
    values = np.array([table[k] for k in keys], np.int64).reshape(-1, 3)
    first = np.frombuffer(b"".join(keys), ">u8").reshape(-1, 4)[:, 0].astype(np.uint64) if keys else np.zeros(0, np.uint64)
    for b, i, j in B.slices(first, count):
        raw = np.frombuffer(b"".join(keys[i:j]), np.uint8).reshape(-1, 32)
        bits = max(6, int(8 * (j - i) - 1).bit_length())
        cells = np.zeros(1 << bits, bool)
        for c in _cells(np.ascontiguousarray(raw), bits):
            cells[c] = True
        yield b, RUN, run, j - i, raw.tobytes() + values[i:j].T.tobytes() + bytes([bits]) + np.packbits(cells).tobytes()
    table.clear()


def _compact(_: int, by: dict) -> pa.Table:
    raws, values, filters = [], [], []
    for _, n, d in by[RUN]:
        raws.append(np.frombuffer(d, np.uint8, 32 * n).reshape(n, 32))
        values.append(np.frombuffer(d, np.int64, 3 * n, 32 * n).reshape(3, n))
        at = 56 * n
        filters.append((d[at], np.unpackbits(np.frombuffer(d, np.uint8, -1, at + 1))))
    bits = max(b for b, _ in filters)
    held = np.zeros(1 << bits, np.uint32)
    for b, cells in filters:
        held += np.tile(cells[: 1 << b], 1 << (bits - b))
    raw, value = np.concatenate(raws), np.concatenate(values, axis=1)
    x, y = _cells(np.ascontiguousarray(raw), bits)
    maybe = np.flatnonzero((held[x] > 1) & (held[y] > 1) | (value[2] > 1))
    raw, (length, ids, counts) = np.ascontiguousarray(raw[maybe]), value[:, maybe]
    words = raw.view(">u8").reshape(-1, 4)
    order = np.lexsort((ids, -length, words[:, 3], words[:, 2], words[:, 1], words[:, 0]))
    words, ids, counts, raw = words[order], ids[order], counts[order], raw[order]
    new = np.ones(len(order), bool)
    if len(order) > 1:
        new[1:] = (words[1:] != words[:-1]).any(axis=1)
    at = np.flatnonzero(new)
    size = np.add.reduceat(counts, at) if len(at) else counts
    hit = size > 1
    return pa.table({"digest": pa.array([raw[i].tobytes() for i in at[hit]], pa.binary()), "keep_id": pa.array(ids[at[hit]], pa.int64()), "group_size": pa.array(size[hit], pa.int64())})


def build_index(rows: DataFrame, n_rows: int, memtable: int = MEMTABLE) -> DataFrame:
    """Digests that more than one row of (doc_id, length, digest) has: the row that stays, and how many there are."""
    count = max(1, -(-n_rows // RANGE_ROWS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table: dict[bytes, list[int]] = {}
        flushed = 0
        for batch in batches:
            for i, n, d in zip(*(batch[c].to_pylist() for c in ("doc_id", "length", "digest")), strict=True):
                best = table.get(d)
                if best is None:
                    if len(table) >= memtable:
                        yield B._batch(_flush(table, flushed, count))
                        flushed += 1
                    table[d] = [n, i, 1]
                else:
                    best[2] += 1
                    if (-n, i) < (-best[0], best[1]):
                        best[0], best[1] = n, i
        yield B._batch(_flush(table, flushed, count))

    return B.grouped(rows.select("doc_id", "length", "digest").mapInArrow(B.tidy(run), B.ROW), _compact, HITS)


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Column | None = None, memtable: int = MEMTABLE) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal without their ASCII white space; the longest original stays
    (code points), then the smallest id.  Defined results: a null text counts
    as empty, so all empty, blank and null texts are one group; of rows that
    repeat the id of the row that stays every one is marked kept; a null id
    comes after all others; texts of any length are compared as a whole; other
    columns, whatever their names, are ignored; an empty table gives an empty
    one.  digest: another 32-byte digest of column ``_norm``, for tests of
    colliding ones.
    """
    scratch = Scratch(docs.sparkSession, "exact")
    read = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(B.NULL_ID)).alias("doc_id"), F.length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("length"), normalised(F.col(text_col)).alias("_norm"))
    keyed = read.withColumn("text_sha256", F.sha2("_norm", 256)).withColumn("digest", F.unhex("text_sha256") if digest is None else digest)
    rows = scratch.save(keyed.select("doc_id", "length", "text_sha256", "digest"), "rows")
    n_rows = rows.count()
    hits = scratch.save(build_index(rows, n_rows, memtable), "hits")
    small = hits.count() <= BROADCAST_ROWS

    def look_up(r: DataFrame, how: str) -> DataFrame:
        return r.join(F.broadcast(hits), "digest", how) if small else join_index(r, hits, "digest", "group_size", n_rows, "doc_id", how)

    # byte verification of every hit; the text that stays goes to every share of a large group
    members = scratch.save(look_up(keyed, "inner").select("digest", "doc_id", "length", "keep_id", "group_size", "_norm"), "members")
    keeper = members.where("doc_id = keep_id").groupBy("digest").agg(F.max("_norm").alias("_kept_norm"), F.max("group_size").alias("group_size"))
    compared = join_index(members.drop("group_size"), keeper, "digest", "group_size", n_rows, "doc_id")
    wrong = scratch.save(compared.where("_norm <> _kept_norm").select("digest").distinct(), "wrong")
    found = look_up(rows, "left")
    if wrong.isEmpty():
        answered = found
    else:
        again = members.drop("group_size").join(wrong, "digest", "left_semi")
        groups = again.groupBy("digest", "_norm").agg(F.min(F.struct(-F.col("length"), "doc_id")).getField("doc_id").alias("g_keep"), F.count(F.lit(1)).alias("g_size"))
        exact = again.join(groups, ["digest", "_norm"]).select("digest", "doc_id", F.sha2("_norm", 256).alias("text_sha256"), "g_keep", "g_size").distinct()
        answered = found.join(exact, ["digest", "doc_id", "text_sha256"], "left").withColumn("keep_id", F.coalesce("g_keep", "keep_id")).withColumn("group_size", F.coalesce("g_size", "group_size"))
    clean = lambda c: F.nullif(F.col(c), F.lit(B.NULL_ID))
    keep = F.coalesce("keep_id", "doc_id")
    result = scratch.save(answered.select(F.col("doc_id").alias("_id"), keep.alias("_keep"), F.coalesce("group_size", F.lit(1)).alias("group_size"), "text_sha256"), "result")
    scratch.drop("rows", "hits", "members", "wrong")
    return result.select(clean("_id").alias("doc_id"), clean("_keep").alias("keep_id"), "group_size", (F.col("_id") == F.col("_keep")).alias("kept"), "text_sha256")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, that stay: one of each group, also of rows that repeat an id.

    Defined results: as :func:`dedup`; of rows that repeat the id of the row
    that stays the longest text stays, then the greatest row as JSON; all
    columns come back as they are, whatever their names; an empty table gives
    an empty one.
    """
    stays = dedup(docs, id_col, text_col).where("kept").groupBy("doc_id", "text_sha256").agg(F.count(F.lit(1)).alias("n"))
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("i"), F.sha2(normalised(F.col(text_col)), 256).alias("s"), F.length(F.coalesce(F.col(text_col), F.lit(""))).alias("l"))
    same = F.col("i").eqNullSafe(F.col("doc_id")) & (F.col("s") == F.col("text_sha256"))
    again = stays.where("n > 1")
    if again.isEmpty():
        return rows.join(stays, same, "left_semi").select("row.*")
    single = rows.join(stays.where("n = 1"), same, "left_semi").select("row.*")
    one = rows.join(again, same, "left_semi").groupBy("i", "s").agg(F.max_by("row", F.struct("l", F.to_json("row"))).alias("row"))
    return single.unionByName(one.select("row.*"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 5 on all of ``documents``; nulls, ties, repeated rows and other columns as :func:`dedup` says."""
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS len, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t FROM documents),
k AS (SELECT doc_id, t, first_value(doc_id) OVER (PARTITION BY t ORDER BY len DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size FROM n)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM k
"""
