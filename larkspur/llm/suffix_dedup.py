"""Operator 4: remove byte strings that an earlier document already has.

The order of all suffixes that matter is built column by column, as in the
multi-document construction of a collection's Burrows-Wheeler transform: each
round inserts one symbol of every member, moves members to their new places by
a stable sort on that symbol (the LF step) and updates the longest common
prefixes of neighbours by a range minimum.

Whole documents as members would need as many rounds as the longest document
has bytes (122,698 in the test tables), each a pass over everything built so
far.  The members here are therefore pieces: every window of ``length``
bytes belongs to its minimizer, the ``KMER``-byte string with the smallest hash
in it; equal windows have equal minimizers at equal places.  Only minimizers
that occur more than once (counted over all documents) give pieces, and a
bucket runs the rounds over all pieces of its minimizers, aligned at them: a
run of neighbours with common prefixes of ``length`` or more is one string, and
its smallest document keeps it.  The filter loses nothing, and what is compared,
inside a block as in a bucket, are the bytes themselves.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from larkspur.llm import blocks as B
from larkspur.llm.scratch import Scratch

LENGTH = 50
KMER = 20
ASK, SHARED, PIECES, MASKS = 1, 2, 3, 4
SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


class Pieces:
    """Minimizers of a block: place, hash, first and last window, document, hash of the piece."""

    def __init__(self, block: B.Block, length: int, kmer: int):
        parts = [self._of(block, a, b, length, kmer) for a, b in self._ranges(block, length)]
        whole = [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.zeros(0, t) for t in (np.int64, np.uint64, np.int64, np.int64, np.uint64)]
        self.at, self.hash, self.lo, self.hi, self.piece = whole
        self.doc = np.searchsorted(block.offsets, self.lo, "right") - 1

    @staticmethod
    def _ranges(block: B.Block, length: int) -> Iterator[tuple[int, int]]:
        """Whole documents of about CHUNK bytes; long ones in parts that overlap by length - 1."""
        i = 0
        while i < len(block):
            a = int(block.offsets[i])
            j = max(i + 1, int(np.searchsorted(block.offsets, a + B.CHUNK, "right")) - 1)
            b = int(block.offsets[j])
            if b - a > 2 * B.CHUNK:
                for s in range(a, b - length + 1, B.CHUNK):
                    yield s, min(b, s + B.CHUNK + length - 1)
            else:
                yield a, b
            i = j

    @staticmethod
    def _of(block: B.Block, a: int, b: int, length: int, kmer: int) -> tuple[np.ndarray, ...]:
        empty = tuple(np.zeros(0, t) for t in (np.int64, np.uint64, np.int64, np.int64, np.uint64))
        if b - a < length:
            return empty
        values = B.BYTE[block.buf[a:b]]
        sums = B.prefix_sums(values)
        _, down = B.powers(len(sums))
        h = B.mix((sums[kmer:] - sums[:-kmer]) * down[: len(sums) - kmer])
        # smallest hash, then first place, of the k-mers of each window
        least = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
        width, done = length - kmer + 1, 1
        while done < width:
            step = min(done, width - done)
            least = np.minimum(least[:-step], least[step:])
            done += step
        inside = np.ones(len(least), bool)
        cut = block.offsets[np.searchsorted(block.offsets, a, "right") : np.searchsorted(block.offsets, b, "left")] - a
        for e in cut:  # windows that would cross the end of a document
            inside[max(0, e - length + 1) : e] = False
        s = np.flatnonzero(inside)
        if not len(s):
            return empty
        at = (least[s] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        first = np.concatenate([[True], (at[1:] != at[:-1]) | (s[1:] != s[:-1] + 1)])
        i = np.flatnonzero(first)
        lo, hi, at = s[i], s[np.concatenate([i[1:], [len(s)]]) - 1], at[i]
        piece = B.ranges(sums, lo, hi + length) ^ ((at - lo).astype(np.uint64) * B.BASE)
        # minimizers have small hashes: mixed once more they spread over all buckets
        return at + a, B.mix(h[at]), lo + a, hi + a, piece


def columns(pieces: np.ndarray, starts: int, length: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Order and common prefixes of all members' suffixes, from the last column to the first.

    pieces: one member per row.  Yields (column, order, common) for columns
    below ``starts``: members sorted by their suffix from that column, and the
    symbols (``length`` at most) each shares with the one before.
    """
    m, width = pieces.shape
    symbols = np.ascontiguousarray(pieces.T)
    order, common = np.arange(m), np.zeros(m, np.uint8)
    for column in range(width - 1, -1, -1):
        symbol = symbols[column][order]
        move = np.argsort(symbol, kind="stable")
        symbol = symbol[move]
        # least[k][i]: smallest of common[i : i + 2**k]
        least, k = [common], 1
        while 2 * k <= m:
            least.append(np.minimum(least[-1][:-k], least[-1][k:]))
            k *= 2
        new = np.zeros(m, np.uint8)
        same = np.flatnonzero(symbol[1:] == symbol[:-1]) + 1
        lo, hi = move[same - 1] + 1, move[same] + 1
        level = np.floor(np.log2(hi - lo)).astype(np.int64)
        for k in np.flatnonzero(np.bincount(level)).tolist():
            x = level == k
            new[same[x]] = np.minimum(least[k][lo[x]], least[k][hi[x] - (1 << k)])
        new[same] = np.minimum(new[same] + 1, length)
        order, common = order[move], new
        if column < starts:
            yield column, order, common


def _send(block: int, buf: np.ndarray, ids: np.ndarray, p: Pieces, unique: np.ndarray, count: int, length: int) -> Iterator[B.Row]:
    for b, i, j in B.slices(p.hash[unique], count):
        x = unique[i:j]
        lens = p.hi[x] - p.lo[x] + length
        place = np.repeat(p.lo[x] - np.concatenate([[0], np.cumsum(lens)[:-1]]), lens) + np.arange(lens.sum())
        head = np.concatenate([p.at[x] - p.lo[x], p.hi[x] - p.lo[x]]).astype(np.uint8).tobytes()
        yield b, PIECES, block, j - i, B.squeeze(ids[p.doc[x]].tobytes() + head + buf[place].tobytes())


def _distinct(buf: np.ndarray, p: Pieces, again: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pieces in question; the first of each distinct one; where each of them is among those.

    Pieces are sorted by a hash and then held byte by byte against the first
    of their hash; those that differ from it are told apart by their bytes.
    """
    chosen = np.flatnonzero(again)
    _, first, code = np.unique(p.piece[chosen], return_index=True, return_inverse=True)
    lens, head = p.hi[chosen] - p.lo[chosen] + length, p.at[chosen] - p.lo[chosen]
    leader = first[code]
    wrong = (lens != lens[leader]) | (head != head[leader])
    for i in range(0, len(chosen), 8192):  # index arrays for a few pieces at a time
        x = np.arange(i, min(len(chosen), i + 8192))
        x = x[~wrong[x] & (leader[x] != x)]
        if len(x):
            edge = np.cumsum(lens[x]) - lens[x]
            step = np.arange(int(lens[x].sum())) - np.repeat(edge, lens[x])
            differ = buf[np.repeat(p.lo[chosen[x]], lens[x]) + step] != buf[np.repeat(p.lo[chosen[leader[x]]], lens[x]) + step]
            wrong[x] = np.logical_or.reduceat(differ, edge)
    if wrong.any():
        known: dict = {}
        for i in np.flatnonzero(wrong).tolist():
            a = int(p.lo[chosen[i]])
            code[i] = known.setdefault((int(head[i]), buf[a : a + int(lens[i])].tobytes()), len(first) + len(known))
        _, first, code = np.unique(code, return_index=True, return_inverse=True)
    by_bucket = np.argsort(p.hash[chosen][first], kind="stable")
    rank = np.empty(len(first), np.int64)
    rank[by_bucket] = np.arange(len(first))
    return chosen, chosen[first][by_bucket], rank[code]


def _repeated(p: Pieces, replies: list) -> np.ndarray:
    distinct, inverse, counts = np.unique(p.hash, return_inverse=True, return_counts=True)
    return (B.read_shared(replies, len(distinct)) | (counts > 1))[inverse]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, kmer: int = KMER, scratch: Scratch | None = None) -> DataFrame:
    """Per row: bytes, bytes removed, removed runs, SHA-256 of what is kept.

    A byte goes when a ``length``-byte string over it also starts in a document
    with a smaller id.  Defined results: a null text counts as empty; texts
    under ``length`` bytes keep all; rows with the same id never remove each
    other's bytes; a null id comes after all others; a long text is read in
    parts of about 1 MB; other columns, whatever their names, are ignored; an
    empty table gives an empty one.
    """
    # windows of a piece differ in their distance to the minimizer: one bit of a 64-bit mask each
    if not 0 < length - kmer + 1 <= 64 or length > 255:
        raise ValueError("kmer must leave 1 to 64 places in a window of at most 255 bytes")
    own = scratch or Scratch(docs.sparkSession, "suffix")
    packed, _, size = B.to_blocks(docs, id_col, text_col)
    blocks = own.save(packed, "blocks")
    own.drop()
    count, room = B.buckets_for(size), length - kmer

    def ask(k: int, _: int, data: bytes) -> Iterator[B.Row]:
        yield from B.ask_shared(k, B.distinct(Pieces(B.Block.unpack(data), length, kmer).hash), count, ASK)

    shared = own.save(B.together(B.over(blocks, ask), B.answer_shared(ASK, SHARED)), "shared")
    own.drop()

    def pieces(k: int, by: dict) -> Iterator[B.Row]:
        block = B.Block.unpack(by[B.TEXT][0][2])
        p = Pieces(block, length, kmer)
        _, unique, _ = _distinct(block.buf, p, _repeated(p, by.get(SHARED, [])), length)
        yield from _send(k, block.buf, block.ids, p, unique, count, length)

    def judge(bucket: int, by: dict) -> Iterator[B.Row]:
        sent = [(src, n, B.expand(data)) for src, n, data in by[PIECES]]
        ids = np.concatenate([np.frombuffer(d, np.int64, n) for _, n, d in sent])
        off = np.concatenate([np.frombuffer(d, np.uint8, n, 8 * n) for _, n, d in sent]).astype(np.int64)
        span = np.concatenate([np.frombuffer(d, np.uint8, n, 9 * n) for _, n, d in sent]).astype(np.int64)
        flat = np.concatenate([np.frombuffer(d, np.uint8, -1, 10 * n) for _, n, d in sent])
        lens, m = span + length, len(ids)
        table = np.zeros((m, room + length), np.uint8)
        edge = np.concatenate([[0], np.cumsum(lens)])
        for i in range(0, m, 8192):  # index arrays for a few pieces at a time
            j = min(m, i + 8192)
            at = np.arange(edge[i], edge[j])
            row = np.repeat(np.arange(i, j), lens[i:j])
            table[row, at - edge[row] + (room - off)[row]] = flat[edge[i] : edge[j]]
        del flat
        masks = np.zeros(m, np.uint64)
        for column, order, common in columns(table, room + 1, length):
            whole = (room - off <= column) & (column <= room - off + span)
            owner = np.where(whole, ids, B.NULL_ID)[order]
            new = common < length
            new[0] = True
            least = np.minimum.reduceat(owner, np.flatnonzero(new))[np.cumsum(new) - 1]
            late = order[(least < ids[order]) & whole[order]]
            masks[late] |= np.uint64(1 << column)
        at = 0
        for src, n, _ in sent:
            yield src, MASKS, bucket, n, B.squeeze(masks[at : at + n].tobytes())
            at += n

    asked = B.together(blocks.unionByName(shared), pieces)
    masks = own.save(B.together(asked, judge), "masks")
    own.drop()

    def cut(_: int, by: dict) -> pa.Table:
        block = B.Block.unpack(by[B.TEXT][0][2])
        p = Pieces(block, length, kmer)
        chosen, unique, inverse = _distinct(block.buf, p, _repeated(p, by.get(SHARED, [])), length)
        found = [np.frombuffer(B.expand(d), np.uint64) for _, _, d in by.get(MASKS, [])]
        mask = (np.concatenate(found) if found else np.zeros(0, np.uint64))[inverse]
        lo, hi, base = p.lo[chosen], p.hi[chosen], room - (p.at[chosen] - p.lo[chosen])
        ids = block.ids[p.doc[chosen]]
        later = ids > block.ids[p.doc[unique]][inverse]  # the block itself has an earlier owner
        begin, end = [lo[later]], [hi[later] + length]
        for column in range(room + 1):
            x = np.flatnonzero(~later & ((mask >> np.uint64(column)) & np.uint64(1)).astype(bool))
            s = lo[x] + column - base[x]
            begin.append(s)
            end.append(s + length)
        n = len(block.buf)
        gone = np.zeros(n + 1, np.int32)
        gone += np.bincount(np.concatenate(begin), minlength=n + 1).astype(np.int32)
        gone -= np.bincount(np.concatenate(end), minlength=n + 1).astype(np.int32)
        gone = np.cumsum(gone[:-1]) > 0
        out: list[list] = [[], [], [], [], []]
        for i in range(len(block)):
            body, x = block.body(i), gone[block.offsets[i] : block.offsets[i + 1]]
            removed = int(x.sum())
            spans = int(x[0]) + int((x[1:] & ~x[:-1]).sum()) if removed else 0
            kept = body[~x] if removed else body
            for c, v in zip(out, (None if block.ids[i] == B.NULL_ID else int(block.ids[i]), len(body), removed, spans, hashlib.sha256(kept.tobytes()).hexdigest()), strict=True):
                c.append(v)
        return pa.table(dict(zip(("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"), (pa.array(c, t) for c, t in zip(out, (pa.int64(),) * 4 + (pa.string(),), strict=True)), strict=True)))

    result = own.save(B.grouped(blocks.unionByName(shared).unionByName(masks), cut, SCHEMA), "result")
    own.drop("blocks", "shared", "masks")
    return result


def op4_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    """Operator 4 on all of ``documents``; nulls, repeated rows and other columns as :func:`remove_repeats` says."""
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))

