"""Operator 2: byte-level BPE without merging step by step.

Encoding a pre-token walks it from left to right: an Aho-Corasick automaton of
the vocabulary gives the longest token that starts at a place, a next-shorter
table the others, and a token is accepted if it is compatible with its left
neighbour: encoding the two joined gives exactly these two.  Compatibility is
decided from the merge table and remembered per pair.  A place that led nowhere
is marked and never tried again, so the walk is linear.  Decoding gathers bytes
through an offset table: token i is blob[offsets[i]:offsets[i+1]].
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F

from larkspur.llm import blocks as B

# White space as Unicode defines it (fixed values of the pattern language).
WHITE = r"\t-\r \x85\xa0  -     　"
# The pre-token pattern that byte-level vocabularies of this family fix.
PRE_TOKEN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"
#: Splits that never cut through a pre-token: a run without white space with the one space before it, or white space.
CHUNK = re.compile(rf" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
CACHE = 400_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte: itself if printable, else the next code point from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Known(dict):
    """Ids of short chunks, remembered."""

    def __init__(self, e: Encoder):
        self.e = e

    def __missing__(self, chunk: str) -> tuple[int, ...] | list[int]:
        found, one = self.e.chunk_ids(chunk), self.e.one
        if len(chunk) <= 32:
            if len(self) >= CACHE:
                self.clear()
            found = self[chunk] = one[found[0]] if len(found) == 1 else tuple(one[i][0] for i in found)
        return found


class Encoder:
    """A byte-level BPE vocabulary file as encoder and decoder."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, alphabet = spec["model"], byte_alphabet()
        raw = {i: bytes(alphabet[c] for c in t) for t, i in model["vocab"].items() if all(c in alphabet for c in t)}
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        raw |= {i: s.encode() for s, i in self.special.items()}
        n = max(raw) + 1
        self.tokens = [raw.get(i, b"") for i in range(n)]
        self.offsets = np.concatenate([[0], np.cumsum([len(t) for t in self.tokens])]).astype(np.int64)
        self.sizes = np.diff(self.offsets)
        self.blob = np.frombuffer(b"".join(self.tokens), np.uint8)
        vocab = model["vocab"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        #: merge of two ids -> id; rank orders tokens by the merge that makes them, bytes first
        self.merge: dict[tuple[int, int], int] = {}
        self.rank = [-1] * n
        self.parts: list[tuple[int, int] | None] = [None] * n
        for r, (a, b) in enumerate(pairs):
            made = vocab[a + b]
            self.merge[vocab[a], vocab[b]] = made
            if self.parts[made] is None:
                self.rank[made], self.parts[made] = r, (vocab[a], vocab[b])
        mergeable = {i: self.tokens[i] for i in raw if i not in set(self.special.values())}
        self.find = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        by_bytes = {t: i for i, t in mergeable.items()}
        for t, i in by_bytes.items():
            self.find.add_word(t.decode("latin-1"), i)
        self.find.make_automaton()
        #: the longest token that is a proper prefix of a token, or -1
        self.shorter = [-1] * n
        for i, t in mergeable.items():
            self.shorter[i] = next((by_bytes[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in by_bytes), -1)
        self.compatible: dict[tuple[int, int], bool] = {}
        self.pre = regex.compile(PRE_TOKEN)
        self.split = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        #: tokens by their bytes as Latin-1 text, bytes of a token beyond its first, and decimal ids
        self.whole = {t.decode("latin-1"): i for t, i in by_bytes.items()}
        self.beyond = [len(t) - 1 for t in self.tokens]
        self.decimal = [str(i) for i in range(n)]
        #: one object per id and per single token, for all that is remembered
        self.one = [(i,) for i in range(n)]
        self.known = Known(self)

    def pair(self, a: int, b: int) -> bool:
        """Would a and b side by side stay as they are?

        Undo the later of the two outer merges again and again: the pair breaks
        if at some stage the two inner neighbours merge before the merge that
        was undone (at equal rank, the left one goes first).
        """
        known = self.compatible.get((a, b))
        if known is not None:
            return known
        x, y, limit, stays = a, b, (1 << 60, 0), True
        while True:
            made = self.merge.get((x, y))
            if made is not None and (self.rank[made], 1) < limit:
                stays = False
                break
            if self.parts[x] is None and self.parts[y] is None:
                break
            if self.rank[x] > self.rank[y]:
                # x came last: before it, its right part stood beside y
                limit, x = (self.rank[x], 1), self.parts[x][1]
            else:
                # a merge of x and y at this rank would have come first, as it stands further left
                limit, y = (self.rank[y], 2), self.parts[y][0]
        if len(self.compatible) > 2_000_000:
            self.compatible.clear()
        self.compatible[self.one[a] + self.one[b]] = stays
        return stays

    def piece(self, text: str) -> list[int]:
        """Ids of one pre-token, given as its bytes in Latin-1."""
        one = self.whole.get(text)
        if one is not None:
            return [one]  # the first token tried, and nothing stands to its left
        n, beyond, shorter, compatible, pair = len(text), self.beyond, self.shorter, self.compatible, self.pair
        longest = [-1] * n
        for end, i in self.find.iter(text):
            longest[end - beyond[i]] = i  # ends ascend: the last one is the longest
        open_, out, at = bytearray(b"\1" * (n + 1)), [], 0
        token = longest[0] if n else -1
        while at < n:
            left = out[-1] if out else -1
            while token >= 0:
                end = at + beyond[token] + 1
                if open_[end]:
                    if left < 0:
                        break
                    stays = compatible.get((left, token))
                    if pair(left, token) if stays is None else stays:
                        break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at = end
                token = longest[at] if at < n else -1
                continue
            if not out:
                raise ValueError("the vocabulary lacks a byte")
            open_[at] = 0
            token = out.pop()
            at -= beyond[token] + 1
            token = shorter[token]
        return out

    def chunk_ids(self, chunk: str) -> list[int]:
        if chunk.isascii():
            # letters alone, or after one space, are a single pre-token
            if chunk.isalpha() or (chunk[0] == " " and chunk[1:].isalpha()):
                return self.piece(chunk)
            return [i for t in self.pre.findall(chunk) for i in self.piece(t)]
        return [i for t in self.pre.findall(chunk) for i in self.piece(t.encode().decode("latin-1"))]

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        for i, part in enumerate(self.split.split(text) if self.split else [text]):
            if i % 2:
                ids.append(self.special[part])
            else:
                ids.extend(chain.from_iterable(map(self.known.__getitem__, CHUNK.findall(part))))
        return ids

    def decode(self, ids: np.ndarray) -> bytes:
        start, size = self.offsets[ids], self.sizes[ids]
        place = np.repeat(start - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(int(size.sum()))
        return self.blob[place].tobytes()


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


#: Tokens decoded at once.
SLICE = 1 << 18


def digests(e: Encoder, text: str | None) -> tuple[int, str, str]:
    """Number of ids, SHA-256 of the decimal ids, SHA-256 of the decoded text."""
    ids = e.encode(text or "")
    back, listed = hashlib.sha256(), hashlib.sha256()
    rest = b""
    for i in range(0, len(ids), SLICE):
        part = ids[i : i + SLICE]
        listed.update(("," * bool(i) + ",".join(map(e.decimal.__getitem__, part))).encode())
        raw = rest + e.decode(np.array(part, np.int64))
        # the decoded text is UTF-8 with replacement marks; an unfinished character waits for the next slice
        cut = len(raw)
        if i + SLICE < len(ids):
            k = next((k for k in range(1, min(4, cut) + 1) if raw[-k] & 0xC0 != 0x80), 0)
            cut -= k if k and raw[-k] >= 0xC0 else 0
        back.update(raw[:cut].decode("utf-8", "replace").encode())
        rest = raw[cut:]
    return len(ids), listed.hexdigest(), back.hexdigest()


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each whole text.

    Special tokens written in a text get their ids, as the tokenizers library
    does by default.  Defined results: null counts as the empty text, a null id
    stays null; a text of any length is encoded as a whole and decoded in parts
    of SLICE tokens; repeated rows give repeated rows; other columns, whatever
    their names, are ignored; an empty table gives an empty one.
    """
    path = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for batch in batches:
            rows = [digests(e, t.as_py()) for t in batch["text"]]
            n, a, b = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return B.dealt(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))).mapInArrow(B.tidy(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def token_ids(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """doc_id and the ids themselves; odd rows as in :func:`encode_documents`."""
    path = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array([e.encode(t.as_py() or "") for t in batch["text"]], pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(B.tidy(run), "doc_id long, ids array<int>")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 2 on all of ``documents``; nulls, repeated rows and other columns as :func:`encode_documents` says."""
    return encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
