"""Operator 8: document quality by Bradley-Terry pairwise ranking.

Pairs of one good and one bad labelled document are preferences; the chance
that a document is preferred is logistic in the difference of the two scores,
and a score is linear in binned text statistics.  Scores become 0-1 by placing
a quantile of the training scores (chosen for the best balanced accuracy there)
at the decision threshold.

The model is fitted on at most ``SAMPLE`` labelled documents and ``PAIRS``
preferences; scoring covers every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from larkspur.llm.scratch import Scratch
from larkspur.llm.toxicity import held_out, logistic, training_rows

SAMPLE, PAIRS, BINS, THRESHOLD = 6_000, 30_000, 12, 0.3
FEATURES = ("words", "word length", "distinct words", "digits", "capitals", "signs", "distinct lines", "white space", "non-ASCII", "letters", "most frequent sign", "distinct pairs")
_CLASS = np.zeros((6, 256))
_CLASS[0, 48:58] = _CLASS[1, 65:91] = _CLASS[3, [9, 10, 11, 12, 13, 32]] = _CLASS[4, 128:] = 1
_CLASS[5, [*range(65, 91), *range(97, 123)]] = 1
_CLASS[2, [b for b in range(33, 127) if not chr(b).isalnum()]] = 1


def statistics(text: str) -> list[float]:
    """FEATURES of a whole text; all zero without words."""
    raw = text.encode("utf-8", "replace")
    words = raw.split()
    if not words:
        return [0.0] * len(FEATURES)
    n, count = len(raw), len(words)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    share = _CLASS @ counts / n
    lines = [x for x in raw.split(b"\n") if x.strip()]
    pairs = set(zip(words, words[1:]))  # noqa: B905
    return [np.log1p(count), (n - share[3] * n) / count, len(set(words)) / count, share[0], share[1], share[2], len(set(lines)) / len(lines), share[3], share[4], share[5], float((counts * _CLASS[2]).max()) / count, (len(pairs) + 1) / count]


@dataclass
class Ranking:
    edges: np.ndarray  # per feature, ascending
    weights: np.ndarray
    cut: float = 0.0
    scale: float = 1.0

    def spread(self, x: np.ndarray) -> np.ndarray:
        """Each statistic as the bins it has reached."""
        return np.concatenate([(x[:, [i]] >= e[None, :]) for i, e in enumerate(self.edges)], axis=1).astype(float)

    def rank(self, x: np.ndarray) -> np.ndarray:
        return self.spread(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        at = np.log(THRESHOLD / (1 - THRESHOLD))
        return 1 / (1 + np.exp(-np.clip((self.rank(x) - self.cut) / self.scale + at, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, pairs: int = PAIRS) -> Ranking:
    grid = np.linspace(0, 1, BINS + 1)[1:]
    model = Ranking(np.quantile(x, grid, axis=0).T if len(x) else np.zeros((len(FEATURES), BINS)), np.zeros(len(FEATURES) * BINS))
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return model
    rng = np.random.default_rng(7)
    z = model.spread(x)
    better, worse = rng.choice(good, pairs), rng.choice(bad, pairs)
    flip = rng.random(pairs) < 0.5
    difference = np.where(flip[:, None], z[worse] - z[better], z[better] - z[worse])
    model.weights = logistic(difference, (~flip).astype(float), np.ones(pairs), ridge=5.0, rounds=25)
    s = z @ model.weights
    best = max((float(((s[good] >= c).mean() + (s[bad] < c).mean()) / 2), -q, float(c)) for q in np.linspace(0.01, 0.99, 197) for c in [np.quantile(s, q)])
    model.cut, model.scale = best[2], max(float(s.std()) / 2, 1e-6)
    return model


def _measured(docs: DataFrame, *columns: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [statistics(t.as_py() or "") for t in batch["text"]]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in columns), pa.array(got, pa.list_(pa.float64()))], [*columns, "x"])

    kinds = dict(docs.dtypes)
    return docs.select(*columns, "text").mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in columns) + ", x array<double>")


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Ranking:
    """A fitted ranking; without labelled rows of both kinds one that scores every text at the threshold."""
    scratch = Scratch(docs.sparkSession, "quality")
    rows = scratch.save(_measured(training_rows(docs, labels, "quality", sample, id_col, text_col), "doc_id", "label"), "sample").orderBy("doc_id").collect()
    scratch.close()
    x = np.array([r["x"] for r in rows]).reshape(-1, len(FEATURES))
    return fit(x, np.array([r["label"] for r in rows]))


def score_documents(docs: DataFrame, model: Ranking, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score (0 to 1) of every whole text.

    Defined results: a null or blank text scores as one with all statistics
    zero; equal texts score equally, also at the threshold; a text of any
    length is measured as a whole; repeated rows give repeated rows; other
    columns, whatever their names, are ignored; an empty table gives an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few hundred numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            x = np.array([statistics(t.as_py() or "") for t in batch["text"]]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(m.score(x), pa.float64())], ["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, score double")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 8 on all of ``documents``; nulls, ties, repeated rows and other columns as :func:`score_documents` says."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scored = score_documents(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
