"""Operator 1: an exact histogram of encoded lengths and what its suffix sums tell.

Documents shrink to one row per distinct length before anything else happens,
so all later work is on at most as many rows as there are lengths.  Suffix sums
are taken in two levels (blocks of ``SPAN`` lengths, then within a block), so
no single task holds the whole histogram.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from larkspur.llm.blocks import dealt
from larkspur.llm.bpe import default_tokenizer, encoder
from larkspur.llm.scratch import Scratch

SPAN = 64


def lengths(docs: DataFrame, text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """(n_tokens, n_docs) partial counts, one per distinct length and task.

    Defined results: null counts as the empty text, of no tokens; a text of any
    length is encoded as a whole; repeated rows count each time; other columns,
    whatever their names, are ignored; an empty table gives no rows.
    """
    path = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, counts = encoder(path), {}
        for batch in batches:
            for t in batch[0]:
                n = len(e.encode(t.as_py() or ""))
                counts[n] = counts.get(n, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.int64()), pa.array(counts.values(), pa.int64())], ["n_tokens", "n_docs"])

    return dealt(docs.select(text_col)).mapInArrow(run, "n_tokens long, n_docs long")


def suffix_sums(partial: DataFrame) -> DataFrame:
    """Per distinct length L, with L as context limit:

    n_docs (documents of this length), docs_at_least and tokens_at_least (of
    documents with L tokens or more), docs_below, tokens_truncated (total if
    each document is cut to L tokens), docs_total and tokens_total.  Totals,
    quantiles and the total at any limit between two lengths follow (see
    :func:`truncated_total`, :func:`quantile`).  Empty input gives no rows.
    """
    # written once: both levels read it, and the texts must not be encoded again
    histogram = Scratch(partial.sparkSession, "lengths").save(partial.groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs")), "histogram")
    h = histogram.withColumn("part", F.floor(F.col("n_tokens") / SPAN)).withColumn("mass", F.col("n_tokens") * F.col("n_docs"))
    later = Window.orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    parts = h.groupBy("part").agg(F.sum("n_docs").alias("d"), F.sum("mass").alias("m")).select(
        "part", F.coalesce(F.sum("d").over(later), F.lit(0)).alias("d_later"), F.coalesce(F.sum("m").over(later), F.lit(0)).alias("m_later"), F.sum("d").over(everything).alias("docs_total"), F.sum("m").over(everything).alias("tokens_total")
    )
    within = Window.partitionBy("part").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    s = h.join(parts, "part").withColumn("docs_at_least", F.col("d_later") + F.sum("n_docs").over(within)).withColumn("tokens_at_least", F.col("m_later") + F.sum("mass").over(within))
    return s.select(
        "n_tokens", "n_docs", "docs_at_least", "tokens_at_least", (F.col("docs_total") - F.col("docs_at_least")).alias("docs_below"),
        (F.col("tokens_total") - F.col("tokens_at_least") + F.col("docs_at_least") * F.col("n_tokens")).alias("tokens_truncated"), "docs_total", "tokens_total",
    )


def truncated_total(sums: DataFrame, limit: int) -> DataFrame:
    """One row: tokens left when every document is cut to ``limit`` tokens."""
    at = sums.where(F.col("n_tokens") >= limit).agg(F.max("docs_at_least").alias("d"), F.max("tokens_at_least").alias("m"))
    return sums.agg(F.max("tokens_total").alias("t")).crossJoin(at).select((F.coalesce("t", F.lit(0)) - F.coalesce("m", F.lit(0)) + limit * F.coalesce("d", F.lit(0))).alias("tokens"))


def quantile(sums: DataFrame, q: float) -> DataFrame:
    """One row: the smallest length that at least a share q of documents do not exceed."""
    return sums.where(F.col("docs_below") + F.col("n_docs") >= F.ceil(F.col("docs_total") * F.lit(float(q)))).agg(F.min("n_tokens").alias("n_tokens"))


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 1 on all of ``documents``; nulls, repeated rows and other columns as :func:`lengths` says."""
    return suffix_sums(lengths(spark.read.parquet(f"{sf_dir}/documents.parquet")))
