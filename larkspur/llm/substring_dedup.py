"""Operator 10: remove words of windows that already started earlier.

Difference-cover anchors: modulo ``PERIOD`` the positions ``COVER`` have every
difference, so two occurrences of a window, at whatever positions, share an
anchor (``size - PERIOD + 1`` words at a cover position) at the same distance
from their starts.  Only anchors at cover positions are hashed and counted.
Windows with an anchor that occurs more than once are extended to their whole
``size`` words and compared as such; all other windows are unique.

Two windows count as equal if two 64-bit hashes of theirs agree, made from
different halves of 128-bit word hashes (:func:`~larkspur.llm.blocks.word_hashes`);
the second is mixed again after every word, so no linear relation between words
cancels out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from larkspur.llm import blocks as B
from larkspur.llm.scratch import Scratch

SIZE = 20
#: A perfect difference set: each residue but 0 is one difference of two members.
PERIOD, COVER = 13, (0, 1, 3, 9)
ASK, SHARED, WINDOWS, FIRST = 1, 2, 3, 4
SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def same_windows(key: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that puts equal windows side by side, earlier places first; which of them begin a group."""
    order = np.argsort(key, kind="stable")
    for _ in range(2):
        k, c = key[order], check[order]
        new = np.ones(len(order), bool)
        new[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1])
        if not (new[1:] & (k[1:] == k[:-1])).any():
            break
        order = np.lexsort((check, key))  # the first hashes of different windows collide
    return order, new


class Windows:
    """A block's words, its anchors, and the windows that hold a repeated one."""

    def __init__(self, block: B.Block, size: int, second: bool = True):
        words, self.more, self.edges = B.words_of(block, second=second)
        self.n = len(words)
        self.doc = np.repeat(np.arange(len(block)), np.diff(self.edges))
        self.left = self.edges[1:][self.doc] - np.arange(self.n)  # words to the document's end
        self.size, self.span = size, size - PERIOD + 1
        self.words = words
        place = (np.arange(self.n) - self.edges[:-1][self.doc]) % PERIOD
        self.anchor = np.flatnonzero(np.isin(place, COVER) & (self.left >= self.span))
        self.hash = self._hash(words, self.anchor, self.span)

    @staticmethod
    def _hash(values: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
        out = np.zeros(len(starts), np.uint64)
        for i in range(size):
            out = out * B.BASE + values[starts + i]
        return B.mix(out)

    def candidates(self, replies: list) -> None:
        """start: windows that hold a repeated anchor; key, check: two hashes of all their words."""
        distinct, inverse, counts = np.unique(self.hash, return_inverse=True, return_counts=True)
        again = (B.read_shared(replies, len(distinct)) | (counts > 1))[inverse]
        marked = np.zeros(self.n + 1, np.int64)
        marked[self.anchor[again] + 1] = 1
        marked = np.cumsum(marked)
        start = np.flatnonzero(self.left >= self.size)
        self.start = start[marked[start + PERIOD] > marked[start]]
        self.key = self._hash(self.words, self.start, self.size)
        self.check = B.runs_of(self.more, self.start, self.size)
        order, new = same_windows(self.key, self.check)
        self.group = np.empty(len(order), np.int64)
        self.group[order] = np.cumsum(new) - 1
        #: first occurrence in the block (smallest document, smallest start) of each distinct window, by hash
        self.first = order[new]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, scratch: Scratch | None = None) -> DataFrame:
    """Per row: words, words removed, SHA-256 of the kept words joined by one space.

    A word goes when a window of ``size`` words over it has the word sequence
    of a window that starts earlier (smaller id, or same row and earlier).
    Defined results: a null text has no words; rows under ``size`` words keep
    all; of rows with the same id one counts as earlier, by a hash of its text;
    a null id comes last; a long text is read in parts of about 1 MB (one word
    is never cut); other columns, whatever their names, are ignored; an empty
    table gives an empty one.
    """
    if size < PERIOD + 1:
        raise ValueError(f"windows need at least {PERIOD + 1} words")
    own = scratch or Scratch(docs.sparkSession, "substring")
    packed, _, total = B.to_blocks(docs, id_col, text_col)
    blocks = own.save(packed, "blocks")
    own.drop()
    count = B.buckets_for(total)

    def ask(k: int, _: int, data: bytes) -> Iterator[B.Row]:
        yield from B.ask_shared(k, B.distinct(Windows(B.Block.unpack(data), size, False).hash), count, ASK)

    shared = own.save(B.together(B.over(blocks, ask), B.answer_shared(ASK, SHARED)), "shared")
    own.drop()

    def send(k: int, by: dict) -> Iterator[B.Row]:
        block = B.Block.unpack(by[B.TEXT][0][2])
        w = Windows(block, size)
        w.candidates(by.get(SHARED, []))
        for b, i, j in B.slices(w.key[w.first], count):
            x = w.first[i:j]
            ids, at = np.unique(block.ids[w.doc[w.start[x]]], return_inverse=True)
            yield b, WINDOWS, k, j - i, w.key[x].tobytes() + w.check[x].tobytes() + at.astype(np.uint32).tobytes() + ids.tobytes()

    def judge(bucket: int, by: dict) -> Iterator[B.Row]:
        key, check, owner, sent = [], [], [], by[WINDOWS]
        for _, n, d in sent:
            key.append(np.frombuffer(d, np.uint64, n))
            check.append(np.frombuffer(d, np.uint64, n, 8 * n))
            owner.append(np.frombuffer(d, np.int64, -1, 20 * n)[np.frombuffer(d, np.uint32, n, 16 * n)])
        who = np.repeat(np.arange(len(sent)), [n for _, n, _ in sent])
        key, check, owner = np.concatenate(key), np.concatenate(check), np.concatenate(owner)
        order, new = same_windows(key, check)
        at, group = np.flatnonzero(new), np.cumsum(new) - 1
        owner, who = owner[order], who[order]
        # the smallest owner of each window, then the first block of it
        who[owner != np.minimum.reduceat(owner, at)[group]] = len(sent)
        is_first = np.zeros(len(order), bool)
        is_first[order[who == np.minimum.reduceat(who, at)[group]]] = True
        at = 0
        for src, n, _ in sent:
            yield src, FIRST, bucket, n, B.squeeze(np.packbits(is_first[at : at + n]).tobytes())
            at += n

    first = own.save(B.together(B.together(blocks.unionByName(shared), send), judge), "first")
    own.drop()

    def cut(_: int, by: dict) -> pa.Table:
        block = B.Block.unpack(by[B.TEXT][0][2])
        w = Windows(block, size)
        w.candidates(by.get(SHARED, []))
        owns = B.read_shared(by.get(FIRST, []), len(w.first))
        late = np.ones(len(w.start), bool)
        late[w.first[owns]] = False
        s = w.start[late]
        gone = np.zeros(w.n + size + 1, np.int64)
        gone[s] += 1
        gone[s + size] -= 1
        gone = np.cumsum(gone)[: w.n] > 0
        out: list[list] = [[], [], [], []]
        for i in range(len(block)):
            a, b = int(w.edges[i]), int(w.edges[i + 1])
            words = block.body(i).tobytes().split()
            drop = gone[a:b]
            removed = int(drop.sum())
            kept = [x for x, y in zip(words, drop.tolist(), strict=True) if not y] if removed else words
            for c, v in zip(out, (None if block.ids[i] == B.NULL_ID else int(block.ids[i]), b - a, removed, hashlib.sha256(b" ".join(kept)).hexdigest()), strict=True):
                c.append(v)
        return pa.table(dict(zip(("doc_id", "n_words", "n_removed", "kept_sha256"), (pa.array(c, t) for c, t in zip(out, (pa.int64(),) * 3 + (pa.string(),), strict=True)), strict=True)))

    result = own.save(B.grouped(blocks.unionByName(shared).unionByName(first), cut, SCHEMA), "result")
    own.drop("blocks", "shared", "first")
    return result


def op10_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Operator 10 on all of ``documents``; nulls, repeated rows and other columns as :func:`remove_repeats` says."""
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
t AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i, unnest(list_transform(range(1, len(ws) + 1), lambda i: CASE WHEN i + 19 <= len(ws) THEN array_to_string(ws[i:i+19], ' ') END)) AS win FROM d),
o AS (SELECT doc_id, word, i, win IS NOT NULL AND row_number() OVER (PARTITION BY win ORDER BY doc_id, i) > 1 AS late FROM t),
g AS (SELECT doc_id, word, i, max(late::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) = 1 AS gone FROM o),
r AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM g GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN r USING (doc_id)
"""
