"""Operator 6: toxic spans by a linear-chain conditional random field.

Tokens are labelled from the labelled documents: a token that toxic documents
hold far more often than clean ones is toxic in a toxic document, all others are
clean.  A two-state chain (clean, toxic) has weights for a token itself, for its
beginning and ending, so that words never seen with a known stem count too, for
the tokens before and after it, and for the step between two states.
It is trained by diagonal Newton steps on exact forward-backward expectations
over whole texts, summed where the texts are.  Scoring runs forward-backward
over all tokens of every text as one chain; marginals give the offending
offsets, and their sum and maximum the document score, calibrated on the same
labelled documents.

Training sees at most ``SAMPLE`` labelled documents, but all of their words;
what reaches the driver are sums per feature.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from larkspur.llm.blocks import dealt, tidy
from larkspur.llm.scratch import Scratch

#: Labelled documents that training reads, half of either label.
SAMPLE = 6_000
TOKEN = re.compile(r"[^\W\d_]+")
BREAK = re.compile(r"[\W\d_]")
ROUNDS, RIDGE = 20, 0.05
#: Toxic words by mere chance to be expected in the lexicon, and documents that a word must be in, however many documents there are.
FALSE_WORDS, LEAST = 0.1, 3
#: Factors that make several hashes of one.
PRINTS = (1, 0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)
#: Kinds of beginnings (four letters) and endings (three), by hash; words whose code a task remembers; characters of a text split into words at once.
BEGINNINGS, ENDINGS, REMEMBERED, PIECE = 2048, 512, 150_000, 1 << 20
#: Steps of a chain that are taken for many stretches at once, and stretches at once.
STRETCH, STRETCHES = 64, 4096


def held_out(doc_id):
    """Rows whose labels are never learned from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def training_rows(docs: DataFrame, labels: DataFrame, label: str, rows: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """text and label of at most ``rows`` labelled documents, half of either label, chosen by a hash of the id."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label).isin(0, 1) & ~held_out(F.col(id_col))).select(F.col(id_col).alias("_id"), F.col(label).alias("_label")).distinct()
    order = F.xxhash64("_id")
    chosen = None
    for value in (0, 1):
        part = known.where(F.col("_label") == value).orderBy(order, "_id").limit(rows // 2)
        chosen = part if chosen is None else chosen.unionByName(part)
    # at most `rows` ids of 12 bytes
    return docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(chosen), "_id").select(F.col("_id").alias("doc_id"), "text", F.col("_label").alias("label"))


def words(text: str) -> Iterator[str]:
    """Lower-case tokens, in the order of TOKEN.finditer(text); long texts are split between words."""
    at = 0
    while at < len(text):
        cut = BREAK.search(text, at + PIECE) if len(text) - at > PIECE else None
        part = text[at : cut.start() if cut else len(text)]
        at += len(part)
        low = part.lower()
        # lower() may change lengths, and then which letters belong to one token
        yield from TOKEN.findall(low) if len(low) == len(part) else (w.lower() for w in TOKEN.findall(part))


class Codes(dict):
    """word -> its lexicon index + 1 (0: none), ending and beginning in one number."""

    def __init__(self, lexicon: dict[str, int]):
        self.lexicon = lexicon

    def __missing__(self, word: str) -> int:
        ending, beginning = (zlib.crc32(x.encode("utf-8", "replace")) for x in (word[-3:], word[:4]))
        code = ((self.lexicon.get(word, -1) + 1) * ENDINGS + ending % ENDINGS) * BEGINNINGS + beginning % BEGINNINGS
        if len(self) < REMEMBERED:
            self[word] = code
        return code


def forward_backward(e: np.ndarray, begins: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Toxic marginal of every token, and expected steps between states, of several chains in a row.

    e: score of the toxic state against the clean one; begins: is the token the
    first of its chain; move: scores of steps.  The chains are cut to stretches:
    the product of the step matrices of each one is taken for many stretches at
    once, then the vectors that come into the stretches, one after the other,
    and with them the exact sums inside.
    """
    n = len(e)
    rows = -(-n // STRETCH)
    k = np.exp(move)
    incoming, outgoing = np.empty((rows, 2)), np.empty((rows, 2))
    marginal, pairs = np.empty(n), np.zeros((2, 2))

    def steps(i: int, j: int) -> np.ndarray:
        """[step, state before, state after, stretch] of stretches i to j; the steps that fill up the last one change nothing."""
        a, b = i * STRETCH, min(n, j * STRETCH)
        x = np.zeros((2, 2, (j - i) * STRETCH))
        x[0, 0, b - a :] = x[1, 1, b - a :] = 1.0
        toxic, new = np.exp(np.clip(e[a:b], -50, 50)), begins[a:b]
        for before in (0, 1):
            x[before, 0, : b - a] = np.where(new, 1.0, k[before, 0])
            x[before, 1, : b - a] = np.where(new, 1.0, k[before, 1]) * toxic
        return np.ascontiguousarray(x.reshape(2, 2, j - i, STRETCH).transpose(3, 0, 1, 2))

    product = np.empty((rows, 2, 2))
    for i in range(0, rows, STRETCHES):
        j = min(rows, i + STRETCHES)
        x = steps(i, j)
        p = x[0]
        for s in range(1, STRETCH):
            p = np.stack([p[:, 0] * x[s, 0, b] + p[:, 1] * x[s, 1, b] for b in (0, 1)], axis=1)
            p /= p.sum(axis=(0, 1))
        product[i:j] = p.transpose(2, 0, 1)
    x, y = 1.0, 0.0
    for r, ((a, b), (c, d)) in enumerate(product.tolist()):
        incoming[r] = x, y
        x, y = x * a + y * c, x * b + y * d
        x, y = x / (x + y), y / (x + y)
    x, y = 0.5, 0.5
    for r in range(rows - 1, -1, -1):
        outgoing[r] = x, y
        (a, b), (c, d) = product[r].tolist()
        x, y = a * x + b * y, c * x + d * y
        x, y = x / (x + y), y / (x + y)
    for i in range(0, rows, STRETCHES):
        j = min(rows, i + STRETCHES)
        x = steps(i, j)
        f, g = np.empty((STRETCH + 1, 2, j - i)), np.empty((STRETCH, 2, j - i))
        f[0] = incoming[i:j].T
        for s in range(STRETCH):
            f[s + 1] = f[s, 0] * x[s, 0] + f[s, 1] * x[s, 1]
            f[s + 1] /= f[s + 1].sum(axis=0)
        g[-1] = outgoing[i:j].T
        for s in range(STRETCH - 1, 0, -1):
            g[s - 1] = x[s, :, 0] * g[s, 0] + x[s, :, 1] * g[s, 1]
            g[s - 1] /= g[s - 1].sum(axis=0)
        both = f[1:] * g
        a, b = i * STRETCH, min(n, j * STRETCH)
        marginal[a:b] = (both[:, 1] / both.sum(axis=1)).T.reshape(-1)[: b - a]
        inside = np.zeros((j - i) * STRETCH, bool)
        inside[: b - a] = ~begins[a:b]
        weight = np.stack([f[:-1, u] * x[:, u, v] * g[:, v] for u in (0, 1) for v in (0, 1)])
        weight /= weight.sum(axis=0)
        pairs += (weight * inside.reshape(j - i, STRETCH).T).sum(axis=(1, 2)).reshape(2, 2)
    return marginal, pairs


@dataclass
class Chain:
    """Weights of the toxic state against the clean one, and what follows from them."""

    lexicon: dict[str, int] = field(default_factory=dict)
    #: by lexicon index + 1; 0: any other token; last (of tokens before and after): none
    emit: np.ndarray = field(default_factory=lambda: np.zeros(2))
    before: np.ndarray = field(default_factory=lambda: np.zeros(2))
    after: np.ndarray = field(default_factory=lambda: np.zeros(2))
    ending: np.ndarray = field(default_factory=lambda: np.zeros(ENDINGS))
    beginning: np.ndarray = field(default_factory=lambda: np.zeros(BEGINNINGS))
    move: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    document: np.ndarray = field(default_factory=lambda: np.array([-4.0, 0.0, 0.0]))

    @classmethod
    def over(cls, lexicon: dict[str, int]) -> Chain:
        return cls(lexicon, *(np.zeros(len(lexicon) + 2) for _ in range(3)))

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "remembered"}

    def codes(self, text: str) -> np.ndarray:
        known = self.__dict__.setdefault("remembered", Codes(self.lexicon))
        return np.fromiter(map(known.__getitem__, words(text)), np.int64)

    def features(self, codes: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
        """Of texts in a row: token, token before, token after, ending, beginning; first tokens."""
        every = np.concatenate(codes)
        token, none = every // (ENDINGS * BEGINNINGS), len(self.emit) - 1
        lens = np.array([len(c) for c in codes])
        first = (np.cumsum(lens) - lens)[lens > 0]
        begins = np.zeros(len(every), bool)
        begins[first] = True
        before, after = np.concatenate([[none], token[:-1]]), np.concatenate([token[1:], [none]])
        before[first] = none
        after[first[1:] - 1] = none
        return [token, before, after, every // BEGINNINGS % ENDINGS, every % BEGINNINGS], begins

    def weights(self) -> list[np.ndarray]:
        return [self.emit, self.before, self.after, self.ending, self.beginning]

    def marginals(self, codes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        used, begins = self.features(codes)
        return forward_backward(sum(w[u] for w, u in zip(self.weights(), used, strict=True)), begins, self.move)

    def sums(self, codes: list[np.ndarray], toxic: np.ndarray) -> np.ndarray:
        """Per feature seen minus expected, and its variance; then the same of the steps.  toxic: per text."""
        used, begins = self.features(codes)
        marginal, moved = self.marginals(codes)
        state = (used[0] > 0) & np.repeat(toxic, [len(c) for c in codes])
        parts = []
        for w, u in zip(self.weights(), used, strict=True):
            parts += [np.bincount(u, state - marginal, len(w)), np.bincount(u, marginal * (1 - marginal), len(w))]
        inside = ~begins[1:]
        seen = np.bincount((2 * state[:-1] + state[1:])[inside], minlength=4).reshape(2, 2)
        return np.concatenate([*parts, (seen - moved).ravel(), (moved * (1 - moved / max(1, inside.sum()))).ravel()])

    def step(self, sums: np.ndarray) -> None:
        """One damped Newton step on the diagonal."""
        at = 0
        for w in [*self.weights(), self.move.reshape(-1)]:
            gradient, variance = sums[at : at + len(w)], sums[at + len(w) : at + 2 * len(w)]
            w += np.clip(0.5 * (gradient - RIDGE * w) / (variance + RIDGE + 0.5), -1, 1)
            at += 2 * len(w)

    def read(self, texts: list[str], offsets: bool = False) -> list[tuple[float, float, list[tuple[int, int]]]]:
        """Expected toxic tokens, highest marginal, and (begin, end) of tokens with a marginal of 0.5 or more, of each text."""
        out: list = []
        codes: list[np.ndarray] = []
        held = 0
        for i, t in enumerate(texts):
            codes.append(self.codes(t))
            held += len(codes[-1])
            if held < STRETCH * STRETCHES and i + 1 < len(texts):
                continue
            marginal = self.marginals(codes)[0] if held else np.zeros(0)
            at = 0
            for c, text in zip(codes, texts[len(out) : len(out) + len(codes)], strict=True):
                m = marginal[at : at + len(c)]
                at += len(c)
                found = set(np.flatnonzero(m >= 0.5).tolist()) if offsets else set()
                spans = [x.span() for k, x in enumerate(TOKEN.finditer(text)) if k in found] if found else []
                out.append((float(m.sum()), float(m.max(initial=0.0)), spans))
            codes, held = [], 0
        return out

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        """Weights of highest marginal and log of their sum by the labels; a figure that would speak against toxicity is left out."""
        weight = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum()) * len(y)
        used = [0, 1]
        while used:
            w = logistic(np.concatenate([np.ones((len(x), 1)), x[:, used]], axis=1), y, weight, ridge=1.0)
            if (w[1:] > 0).all():
                self.document = np.zeros(3)
                self.document[[0, *(1 + u for u in used)]] = w
                return
            used.remove(used[int(np.argmin(w[1:]))])

    def score(self, total: float, top: float) -> float:
        return float(1 / (1 + np.exp(-(self.document @ [1.0, top, np.log1p(total)]))))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3, rounds: int = 60) -> np.ndarray:
    """Newton steps on the weighted logistic loss."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weight * (p - y)) + ridge * w
        h = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Chain:
    """A trained chain; without labelled rows of both kinds, or words that tell them apart, one that scores every text the same, below 0.5.

    Defined results: rows with a null id or label, or another label than 0 and
    1, teach nothing; a null text is an empty one; other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "toxic")
    rows = scratch.save(training_rows(docs, labels, "toxic", sample, id_col, text_col), "sample")
    sizes = dict(rows.groupBy("label").count().collect())
    if len(sizes) < 2:
        scratch.close()
        return Chain()

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, t in zip(batch["doc_id"], batch["text"], strict=True):
                w = list(words(t.as_py()))
                h = np.array([zlib.crc32(" ".join(w[k : k + 3]).encode("utf-8", "replace")) for k in range(max(1, len(w) - 2))], np.uint32)
                yield pa.RecordBatch.from_arrays([pa.array([i.as_py()] * len(PRINTS), pa.int64()), pa.array(range(len(PRINTS)), pa.int32()), pa.array([int((h * np.uint32(f)).min()) for f in PRINTS], pa.int64())], ["doc_id", "salt", "print"])

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, t, y in zip(batch["doc_id"], batch["text"], batch["label"], strict=True):
                w = sorted(set(words(t.as_py())))
                yield pa.RecordBatch.from_arrays([pa.array([i.as_py()] * len(w), pa.int64()), pa.array(w, pa.string()), pa.array([y.as_py()] * len(w), pa.int32())], ["doc_id", "word", "label"])

    # near copies share one of a few smallest hashes of three words, and count as one document
    known = rows.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("label").cast("int").alias("label"))
    shared = scratch.save(known.select("doc_id", "text").mapInArrow(tidy(prints), "doc_id long, salt int, print long"), "prints")
    # both tables that are broadcast have a few rows for each of at most `sample` documents
    first = F.broadcast(shared.groupBy("salt", "print").agg(F.min("doc_id").alias("family")))
    family = scratch.save(shared.join(first, ["salt", "print"]).groupBy("doc_id").agg(F.min("family").alias("family")), "families")
    by_word = known.mapInArrow(tidy(held), "doc_id long, word string, label int").join(F.broadcast(family), "doc_id").select("word", "label", "family").distinct()
    seen = by_word.groupBy("word").agg(F.sum("label").alias("t"), F.sum(1 - F.col("label")).alias("c"))
    families = dict(known.join(F.broadcast(family), "doc_id").select("label", "family").distinct().groupBy("label").count().collect())
    toxic, clean = families.get(1, 0), families.get(0, 0)
    seen = scratch.save(seen.where(F.col("t") + F.col("c") >= LEAST), "seen")
    odds = F.log((F.col("t") + 0.5) / (toxic + 1)) - F.log((F.col("c") + 0.5) / (clean + 1))
    # Chernoff's bound on the chance of so many toxic ones among the word's documents, held against all words tested
    n, q = F.col("t") + F.col("c"), toxic / (toxic + clean)
    surprise = F.col("t") * F.log(F.col("t") / n / q) + F.when(F.col("c") > 0, F.col("c") * F.log(F.col("c") / n / (1 - q))).otherwise(0.0)
    chosen = seen.where((F.col("t") >= LEAST) & (odds > np.log(6)) & (surprise > np.log(max(1, seen.count()) / FALSE_WORDS))).select("word").collect()
    model = Chain.over({w: i for i, w in enumerate(sorted(r["word"] for r in chosen))})
    if not model.lexicon:  # nothing tells the two labels apart
        scratch.close()
        return model

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["label"], pa.array([model.codes(t.as_py()).tobytes() for t in batch["text"]], pa.binary())], ["label", "codes"])

    chains = scratch.save(rows.select(F.col("label").cast("int").alias("label"), "text").mapInArrow(tidy(encode), "label int, codes binary"), "chains")

    def over(f, schema: str) -> list:
        """f(codes, labels) of every few texts of all tasks."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                codes, y = [np.frombuffer(c.as_py(), np.int64) for c in batch["codes"]], batch["label"].to_numpy()
                group: list[int] = []
                held = 0
                for i, c in enumerate(codes):
                    group.append(i)
                    held += len(c)
                    if held >= STRETCH * STRETCHES or i + 1 == len(codes):
                        yield from f([codes[g] for g in group], y[group])
                        group, held = [], 0

        return chains.mapInArrow(tidy(run), schema).collect()

    def gradient(codes: list[np.ndarray], y: np.ndarray) -> Iterator[pa.RecordBatch]:
        if sum(map(len, codes)):
            yield pa.RecordBatch.from_arrays([pa.array([model.sums(codes, y == 1).tobytes()], pa.binary())], ["sums"])

    for _ in range(ROUNDS):
        parts = over(gradient, "sums binary")
        if parts:
            model.step(np.sum([np.frombuffer(p["sums"]) for p in parts], axis=0))

    def figures(codes: list[np.ndarray], y: np.ndarray) -> Iterator[pa.RecordBatch]:
        marginal = model.marginals(codes)[0] if sum(map(len, codes)) else np.zeros(0)
        each = np.split(marginal, np.cumsum([len(c) for c in codes])[:-1])
        yield pa.RecordBatch.from_arrays([pa.array(y, pa.int32()), pa.array([float(m.sum()) for m in each]), pa.array([float(m.max(initial=0.0)) for m in each])], ["label", "total", "top"])

    got = over(figures, "label int, total double, top double")
    y = np.array([r["label"] for r in got], float)
    model.calibrate(np.array([[r["top"], np.log1p(r["total"])] for r in got]), y)
    scratch.close()
    return model


def score_documents(docs: DataFrame, model: Chain, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, n_toxic_tokens, spans (begin, end in characters) of every whole text.

    Defined results: a null or empty text scores as one without tokens; a text
    of any length is one chain; other columns, whatever their names, are
    ignored; repeated rows give repeated rows; an empty table gives an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # weights of words of at most SAMPLE documents
    span = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            got = m.read([t.as_py() or "" for t in batch["text"]], True)
            yield pa.RecordBatch.from_arrays([
                batch["doc_id"], pa.array([m.score(a, b) for a, b, _ in got], pa.float64()), pa.array([len(s) for _, _, s in got], pa.int64()),
                pa.array([[{"begin": a, "end": b} for a, b in s] for _, _, s in got], span),
            ], ["doc_id", "score", "n_toxic_tokens", "spans"])

    return dealt(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))).mapInArrow(tidy(run), "doc_id long, score double, n_toxic_tokens long, spans array<struct<begin:int,end:int>>")


def drop_toxic(docs: DataFrame, model: Chain, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows, all columns, whose text scores below the threshold.

    Defined results: as :func:`score_documents`; rows that repeat stay or go
    together; all columns come back as they are, whatever their names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            yield batch.filter(pa.array([m.score(a, b) < threshold for a, b, _ in m.read([t.as_py() or "" for t in batch.column(at)])], pa.bool_()))

    return dealt(docs).mapInArrow(tidy(run), docs.schema)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 6 on all of ``documents``; nulls, repeated rows and other columns as :func:`score_documents` says."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scored = score_documents(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_toxic_tokens", "spans")
