"""Documents as blocks, and rounds of questions between blocks and buckets.

Operators that compare every text with every other one work in rounds.  A block
holds about ``BLOCK_BYTES`` of whole documents (dealt by a hash of id and text,
so a hot source, or an id that many rows repeat or lack, spreads evenly).  In a round every block sends, to buckets dealt by
a hash of the compared unit, one entry per *distinct* unit it holds; a bucket
answers each block.  A unit that a third of the corpus holds therefore costs a
bucket one entry per block, never one per document.

All rows share one layout: ``k`` is the block or bucket the row goes to, ``tag``
says what it is, ``src`` where it comes from, ``n`` a count, ``data`` the payload.
"""

from __future__ import annotations

import ctypes
import hashlib
import struct
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, functions as F

ROW = "k long, tag int, src long, n long, data binary"
BLOCK_BYTES = 8 << 20
BUCKET_BYTES = 16 << 20
#: Stands for a null doc_id inside blocks: after all others.
NULL_ID = (1 << 63) - 1
TEXT = 0

_ARROW = pa.schema([("k", pa.int64()), ("tag", pa.int32()), ("src", pa.int64()), ("n", pa.int64()), ("data", pa.binary())])

Row = tuple[int, int, int, int, bytes]


def squeeze(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def expand(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def give_back() -> None:
    """Return freed memory to the machine: a worker that waits for its next task would keep it for up to a minute."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def tidy(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """f for mapInArrow; what a task has freed is given back when it ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from f(batches)
        give_back()

    return run


def tidy_group(f: Callable[[pa.Table], pa.Table]) -> Callable:
    """f for applyInArrow; what a group has freed is given back."""

    def run(table: pa.Table) -> pa.Table:
        out = f(table)
        give_back()
        return out

    return run


#: Bytes of input per core below which rows are dealt out: Spark does not split less, and a small file is one row group.
SMALL = 4 << 20


def dealt(rows: DataFrame) -> DataFrame:
    """The same rows, dealt to all cores if the table is small; larger ones stay as they are read."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return rows.repartition(cores) if size < cores * SMALL else rows


class Block:
    """ids ascending (nulls last), null marks, offsets into buf."""

    def __init__(self, ids: np.ndarray, offsets: np.ndarray, buf: np.ndarray):
        self.ids, self.offsets, self.buf = ids, offsets, buf

    def __len__(self) -> int:
        return len(self.ids)

    def body(self, i: int) -> np.ndarray:
        return self.buf[self.offsets[i] : self.offsets[i + 1]]

    @staticmethod
    def pack(ids: list[int | None], bodies: list[bytes | None]) -> bytes:
        ids = [NULL_ID if x is None else x for x in ids]
        order = sorted(range(len(ids)), key=lambda i: (ids[i], bodies[i] or b""))
        lens = np.array([len(bodies[i] or b"") for i in order], np.int64)
        return struct.pack("<q", len(ids)) + np.array([ids[i] for i in order], np.int64).tobytes() + lens.tobytes() + squeeze(b"".join(bodies[i] or b"" for i in order))

    @staticmethod
    def unpack(data: bytes) -> Block:
        (n,) = struct.unpack_from("<q", data)
        ids = np.frombuffer(data, np.int64, n, 8)
        lens = np.frombuffer(data, np.int64, n, 8 + 8 * n)
        return Block(ids, np.concatenate([[0], np.cumsum(lens)]).astype(np.int64), np.frombuffer(expand(data[8 + 16 * n :]), np.uint8))


def _batch(rows: Iterable[Row]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, _ARROW, strict=True)], schema=_ARROW)


def to_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, int, int]:
    """Rows of tag TEXT, one per block; the number of blocks; bytes of text.

    Only id and text are read.  Null texts become empty ones.
    """
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0)).alias("b"), F.count(F.lit(1)).alias("n")).first()
    count = max(1, -(-int(size["b"]) // block_bytes), -(-int(size["n"]) // 200_000))

    def pack(table: pa.Table) -> pa.Table:
        data = Block.pack(table["id"].to_pylist(), table["body"].to_pylist())
        return pa.Table.from_batches([_batch([(table["k"][0].as_py(), TEXT, 0, table.num_rows, data)])])

    keyed = docs.select(F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(count)).alias("k"), F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("body"))
    return keyed.groupBy("k").applyInArrow(tidy_group(pack), ROW), count, int(size["b"])


def over(df: DataFrame, f: Callable[[int, int, bytes], Iterable[Row]], end: Callable[[], Iterable[Row]] | None = None) -> DataFrame:
    """Rows that f(k, tag, data) makes of each row by itself; end() may add rows once a task has read all of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, tag, data in zip(batch["k"], batch["tag"], batch["data"], strict=True):
                yield _batch(f(k.as_py(), tag.as_py(), data.as_py()))
        if end:
            yield _batch(end())

    return df.mapInArrow(tidy(run), ROW)


def together(df: DataFrame, f: Callable[[int, dict], Iterable[Row]], columns: tuple[int, ...] = ()) -> DataFrame:
    """Rows that f(k, {tag: [(src, n, data)]}) makes of all rows of one block or bucket.

    Rows of the tags in ``columns`` come as an Arrow table instead.
    """

    def run(table: pa.Table) -> pa.Table:
        k = table["k"][0].as_py()
        by: dict = {}
        for tag in columns:
            by[tag] = table.filter(pc.equal(table["tag"], tag))
        if columns:
            table = table.filter(pc.invert(pc.is_in(table["tag"], pa.array(columns, pa.int32()))))
        for tag, src, n, data in sorted(zip(*(table[c].to_pylist() for c in ("tag", "src", "n", "data")), strict=True), key=lambda r: r[:2]):
            by.setdefault(tag, []).append((src, n, data))
        return pa.Table.from_batches([_batch(f(k, by))])

    return df.groupBy("k").applyInArrow(tidy_group(run), ROW)


def grouped(df: DataFrame, f: Callable[[int, dict[int, list[tuple[int, int, bytes]]]], pa.Table], schema: str) -> DataFrame:
    """As together(), with a table of its own schema from each block."""

    def run(table: pa.Table) -> pa.Table:
        by: dict[int, list[tuple[int, int, bytes]]] = {}
        for tag, src, n, data in sorted(zip(*(table[c].to_pylist() for c in ("tag", "src", "n", "data")), strict=True), key=lambda r: r[:2]):
            by.setdefault(tag, []).append((src, n, data))
        return f(table["k"][0].as_py(), by)

    return df.groupBy("k").applyInArrow(tidy_group(run), schema)


def buckets_for(size: int) -> int:
    """Never fewer than 16, so that small inputs use several tasks too."""
    return max(16, -(-size // BUCKET_BYTES))


def bucket_of(hashes: np.ndarray, count: int) -> np.ndarray:
    """Buckets of 64-bit hashes; ascending hashes have ascending buckets."""
    return ((hashes >> np.uint64(32)) * np.uint64(count)) >> np.uint64(32)


def slices(sorted_hashes: np.ndarray, count: int) -> Iterator[tuple[int, int, int]]:
    """(bucket, from, to) of the non-empty buckets of ascending hashes."""
    return stretches(bucket_of(sorted_hashes, count))


def stretches(sorted_keys: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(key, from, to) of each key that occurs in ascending keys; the work does not grow with the keys there could be."""
    if len(sorted_keys):
        starts = np.concatenate([[0], np.flatnonzero(sorted_keys[1:] != sorted_keys[:-1]) + 1])
        yield from zip(sorted_keys[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(sorted_keys)], strict=True)


def distinct(values: np.ndarray) -> np.ndarray:
    """The distinct values, ascending, by a sort (numpy's unique hashes them, which takes far longer)."""
    out = np.sort(values)
    if len(out):
        new = np.ones(len(out), bool)
        new[1:] = out[1:] != out[:-1]
        out = out[new]
    return out


# --- which units does more than one block hold? -------------------------------


def ask_shared(block: int, distinct: np.ndarray, count: int, tag: int) -> Iterator[Row]:
    """A block's distinct ascending hashes, to their buckets."""
    for b, i, j in slices(distinct, count):
        yield b, tag, block, j - i, distinct[i:j].tobytes()


def answer_shared(tag: int, reply: int) -> Callable:
    """For each block, one bit per hash it sent: does another block hold it too?"""

    def f(bucket: int, by: dict) -> Iterator[Row]:
        sent = [(src, np.frombuffer(data, np.uint64)) for src, _, data in by.get(tag, [])]
        every = np.sort(np.concatenate([x for _, x in sent]))
        twice = distinct(every[1:][every[1:] == every[:-1]])
        for src, x in sent:
            at = np.minimum(np.searchsorted(twice, x), max(0, len(twice) - 1))
            hit = twice[at] == x if len(twice) else np.zeros(len(x), bool)
            yield src, reply, bucket, len(x), squeeze(np.packbits(hit).tobytes())

    return f


def read_shared(replies: list[tuple[int, int, bytes]], size: int) -> np.ndarray:
    """The bits in the order of the distinct hashes; replies come sorted by bucket."""
    parts = [np.unpackbits(np.frombuffer(expand(data), np.uint8), count=n).astype(bool) for _, n, data in replies]
    bits = np.concatenate(parts) if parts else np.zeros(0, bool)
    if len(bits) != size:
        raise ValueError(f"{len(bits)} answers to {size} questions")
    return bits


# --- hashing over whole arrays ----------------------------------------------

_RNG = np.random.default_rng(20_240_117)
#: A random 64-bit value for each byte; the same in every process.
BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INV = np.uint64(pow(int(BASE), -1, 1 << 64))
_POWERS: dict[str, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes (in place where h may be overwritten)."""
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(32)
    return h


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i <= n; grows with the longest request."""
    if len(_POWERS.get("up", ())) <= n:
        size = max(n + 1, 1 << 20)
        for name, base in (("up", BASE), ("down", BASE_INV)):
            a = np.full(size, base, np.uint64)
            a[0] = 1
            _POWERS[name] = np.multiply.accumulate(a)
    return _POWERS["up"], _POWERS["down"]


def prefix_sums(values: np.ndarray) -> np.ndarray:
    up, _ = powers(len(values))
    out = np.empty(len(values) + 1, np.uint64)
    out[0] = 0
    np.cumsum(values * up[: len(values)], out=out[1:])
    return out


def ranges(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of values[start:end] for each pair, whatever its place."""
    _, down = powers(len(sums))
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


# --- words -------------------------------------------------------------------

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes looked at at once; bounds the arrays a task holds.
CHUNK = 1 << 20
#: Words up to this many bytes are kept as they are in two 64-bit numbers; longer ones by a 120-bit digest.
SHORT = 15
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_SALT = np.uint64(0x2545F4914F6CDD1D)


def chunks(block: Block) -> Iterator[tuple[int, int]]:
    """Byte ranges of about CHUNK that end at white space or the end of a document."""
    ends = block.offsets[1:]
    at, total = 0, int(block.offsets[-1])
    while at < total:
        i = int(np.searchsorted(ends, at + CHUNK, "right"))
        to = int(ends[i - 1]) if i and ends[i - 1] > at else 0
        if to <= at:  # a long document: cut it before a word
            limit, to = int(ends[i]), at + CHUNK
            while to < limit:
                space = np.flatnonzero(_SPACE[block.buf[to : to + CHUNK]])
                if len(space):
                    to += int(space[0])
                    break
                to += CHUNK
            to = min(to, limit)
        yield at, to
        at = to


def pieces(block: Block, wanted: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, Block]]:
    """All documents, or the wanted ones, as blocks of about CHUNK bytes of whole documents, each with their places."""
    docs = np.arange(len(block)) if wanted is None else np.asarray(wanted, np.int64)
    ends = np.cumsum(np.diff(block.offsets)[docs])
    at = 0
    while at < len(docs):
        before = int(ends[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + CHUNK, "right")))
        yield docs[at:to], Block(block.ids[docs[at:to]], np.concatenate([[0], ends[at:to] - before]), np.concatenate([block.body(i) for i in docs[at:to].tolist()]))
        at = to


def word_hashes(part: np.ndarray, starts: np.ndarray, ends: np.ndarray, second: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each word part[start:end]; the second ones only if asked for.

    The two together are a bijection of the word's bytes and length (of the
    digest, for long words), so different short words never share both.
    """
    lens = ends - starts
    eight = np.ndarray(len(part) + 8, "<u8", np.concatenate([part, np.zeros(15, np.uint8)]), strides=(1,))
    a = eight[starts] & _FIRST[np.minimum(lens, 8)]
    b = (eight[np.minimum(starts + 8, len(part))] & _FIRST[np.clip(lens - 8, 0, 7)]) | (lens.astype(np.uint64) << np.uint64(56))
    for i in np.flatnonzero(lens > SHORT).tolist():
        x, y = struct.unpack("<QQ", hashlib.blake2b(part[starts[i] : ends[i]], digest_size=16).digest())
        a[i], b[i] = x, y | 0xFF << 56
    one = mix(a ^ mix(b + BASE))
    return one, mix(b ^ mix(one + _SALT)) if second else one[:0]


def words_of(block: Block, lower: bool = False, second: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and second hashes of every word ([^\\x20\\x09-\\x0D]+), and each document's range of words.

    lower: A-Z count as a-z.
    """
    one, two, starts_all = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for a, b in chunks(block):
        part = _LOWER[block.buf[a:b]] if lower else block.buf[a:b]
        space = _SPACE[part]
        cut = block.offsets[np.searchsorted(block.offsets, a, "left") : np.searchsorted(block.offsets, b, "left")] - a
        before = np.empty(len(part), bool)
        before[0], before[1:] = True, space[:-1]
        before[cut] = True
        after = np.empty(len(part), bool)
        after[-1], after[:-1] = True, space[1:]
        after[cut[cut > 0] - 1] = True
        starts = np.flatnonzero(~space & before)
        x, y = word_hashes(part, starts, np.flatnonzero(~space & after) + 1, second)
        one.append(x)
        two.append(y)
        starts_all.append(starts + a)
    return np.concatenate(one), np.concatenate(two), np.searchsorted(np.concatenate(starts_all), block.offsets)


def runs_of(values: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` values from each start on; mixed after each of them."""
    out = np.zeros(len(starts), np.uint64)
    for i in range(size):
        out = mix(out ^ values[starts + i]) + BASE
    return out
