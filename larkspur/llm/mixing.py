"""Operator 3: mix sources to target weights.

One pass counts words per row; sources are summed with map-side partial
aggregation, so a source that holds a third of all rows costs each task one row.
Targets share ``budget`` times all words by weight and stop at ``cap`` times
the source; the common level is found by rounds of two sums over the source
table (the driver holds scalars only).

A document is taken floor(rate) times, plus once more with the fraction of the
rate as probability.  These Bernoulli draws are not independent, or a source of
few documents would miss its target by far.  The documents of a source are
dealt to bins of about equal size (bin borders grow with the square root), from
the largest to the smallest.  A bin takes fraction * n of its n documents plus
what makes up for the words that the bins before took too many or too few,
rounded by a seeded offset: those with the smallest seeded hashes.  As the
rounding is fair and errors are made up for, each document is still taken with
the fraction as probability, and a source's total is off by about one of its
smaller documents.  The hash that a bin still takes is found in two levels (counts
of 256 slices of the hash, then the one slice where the count is reached),
so no task holds a whole bin and applying the draw needs no shuffle of texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from larkspur.llm.scratch import Scratch

WEIGHTS = (3.0, 1.0, 2.0)
BUDGET, CAP, SEED = 1.5, 2.0, 20_240_117
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of the table of bins (about 100 bytes each) up to which it is broadcast; beyond, the join is salted.
BROADCAST_ROWS = 100_000
SALTS = 64
#: Draws are whole numbers below 2**52, from the first 13 hexadecimal digits of an MD5.
DIGITS, SLICE_BITS = 13, 44


def _number(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text), 1, DIGITS), 16, 10).cast("long")


def _measured(id_col: str, text_col: str, source_col: str, seed: int) -> list[Column]:
    """skey (the source as a text that is never null), size, bin and draw of a row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    size = F.regexp_count(text, F.lit(WORD)).cast("long")
    draw = _number(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("long").cast("string"), F.lit("")), F.lit(":"), F.md5(text)))
    return [F.coalesce(F.concat(F.lit("="), F.col(source_col)), F.lit("")).alias("skey"), size.alias("size"), F.floor(F.sqrt(size) * 4).cast("long").alias("bin"), draw.alias("draw")]


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).alias("source"), *_measured(id_col, text_col, source_col, seed))


def source_rates(sized: DataFrame, scratch: Scratch, weights: tuple[float, ...] = WEIGHTS, budget: float = BUDGET, cap: float = CAP) -> DataFrame:
    """source, source_size, target, rate: one row per source, weights repeating in code point order, null last."""
    spark = sized.sparkSession
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    schema = T.StructType([T.StructField("source", T.StringType()), T.StructField("source_size", T.LongType()), T.StructField("place", T.LongType())])
    ranked = spark.createDataFrame(totals.sort(F.col("source").asc_nulls_last()).rdd.zipWithIndex().map(lambda x: (x[0][0], x[0][1], x[1])), schema)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    per = scratch.save(ranked.select("source", "source_size", weight.alias("weight")), "sources")
    limit = F.col("source_size") * cap
    total = per.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("t")).first()["t"] * budget
    level = None
    while True:
        full = F.lit(False) if level is None else limit <= F.col("weight") * level
        at = per.agg(F.coalesce(F.sum(F.when(full, limit)), F.lit(0.0)).alias("full"), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0)).alias("weight")).first()
        if not at["weight"]:
            target = limit
            break
        after = (total - at["full"]) / at["weight"]
        if level is not None and after <= level:
            target = F.least(limit, F.col("weight") * level)
            break
        level = after
    return per.select("source", "source_size", target.alias("target"), F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(0.0).alias("rate"))


def plan_mix(sized: DataFrame, scratch: Scratch, weights: tuple[float, ...] = WEIGHTS, budget: float = BUDGET, cap: float = CAP, seed: int = SEED) -> DataFrame:
    """For each skey and bin: source_size, target, rate, and last, the largest draw that is taken once more."""
    rates = source_rates(sized, scratch, weights, budget, cap).withColumn("skey", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))).drop("source")
    slices = scratch.save(sized.groupBy("skey", "bin", F.shiftright("draw", SLICE_BITS).alias("slice")).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("words")), "slices")
    bins = slices.groupBy("skey", "bin").agg(F.sum("n").alias("n"), F.sum("words").alias("words"))
    fraction = F.col("rate") - F.floor("rate")

    def take(done: Column, b: Column) -> Column:
        """What one more bin takes, and the words then owed; a source has as many bins as its longest text's square root."""
        mean = b["words"].cast("double") / b["n"]
        offset = _number(F.concat(F.lit(str(seed)), F.col("skey"), F.lit(":"), b["bin"].cast("string"))) / float(1 << 52)
        want = fraction * b["n"] + F.when(mean > 0, done["owed"] / mean).otherwise(0.0)
        k = F.greatest(F.least(F.floor(want + offset), b["n"]), F.lit(0)).cast("long")
        return F.struct((done["owed"] + fraction * b["words"] - k * mean).alias("owed"), F.concat(done["takes"], F.array(F.struct(b["bin"].alias("bin"), k.alias("take")))).alias("takes"))

    start = F.struct(F.lit(0.0).alias("owed"), F.array().cast("array<struct<bin:bigint,take:bigint>>").alias("takes"))
    by_source = bins.groupBy("skey").agg(F.sort_array(F.collect_list(F.struct("bin", "n", "words")), asc=False).alias("b")).join(rates, "skey")
    bins = scratch.save(by_source.select("skey", "source_size", "target", "rate", F.explode(F.aggregate("b", start, take)["takes"]).alias("t")).select("skey", "source_size", "target", "rate", "t.*"), "bins")
    own = Window.partitionBy("skey", "bin").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    reached = slices.join(bins.where("take > 0").select("skey", "bin", "take"), ["skey", "bin"]).withColumn("before", F.coalesce(F.sum("n").over(own), F.lit(0))).where("before < take and take <= before + n")
    reached = scratch.save(reached.select("skey", "bin", "slice", (F.col("take") - F.col("before")).alias("place")), "reached")
    within = sized.select("skey", "bin", "draw", F.shiftright("draw", SLICE_BITS).alias("slice")).join(F.broadcast(reached) if reached.count() <= BROADCAST_ROWS else reached, ["skey", "bin", "slice"])
    at = F.row_number().over(Window.partitionBy("skey", "bin", "slice").orderBy("draw"))
    last = within.withColumn("at", at).where("at = place").select("skey", "bin", F.col("draw").alias("last"))
    out = scratch.save(bins.join(last, ["skey", "bin"], "left").select("skey", "bin", "source_size", "target", "rate", F.coalesce("last", F.lit(-1)).alias("last")), "plan")
    scratch.drop("slices", "bins", "reached", "sources")
    return out


def with_plan(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """rows (with skey, bin and draw) joined to their bin's figures, and copies; a hot source goes to no single task."""
    if plan.count() <= BROADCAST_ROWS:
        joined = rows.join(F.broadcast(plan), ["skey", "bin"])
    else:
        spread = plan.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.withColumn("salt", F.pmod("draw", F.lit(SALTS)).cast("int")).join(spread, ["skey", "bin", "salt"])
    return joined.withColumn("copies", (F.floor("rate") + (F.col("draw") <= F.col("last")).cast("long")).cast("long"))


def mix_sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, budget: float = BUDGET, cap: float = CAP) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies for every row.

    Defined results: a null text has size 0; a null source is a source of its
    own, last; rows of the same id and text share one draw, so they are taken
    equally often; a null id draws by its text; sources without words have
    target 0; a text of any length is counted as a whole; an empty table gives
    an empty one; other columns, whatever their names, are ignored.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    sized = scratch.save(sizes(docs, id_col, text_col, source_col), "sizes")
    joined = with_plan(sized, plan_mix(sized, scratch, weights, budget, cap))
    return joined.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: docs' columns, each row as often as it is taken.

    Defined results: as :func:`mix_sizes`; all columns come back as they are,
    whatever their names.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    sized = scratch.save(sizes(docs, id_col, text_col, source_col), "sizes")
    plan = plan_mix(sized, scratch)
    scratch.drop("sizes")
    rows = docs.select(F.struct("*").alias("row"), *_measured(id_col, text_col, source_col, SEED))
    often = with_plan(rows, plan).where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    return often.select("row.*")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 3 on all of ``documents``; nulls, ties, repeated rows and other columns as :func:`mix_sizes` says."""
    return mix_sizes(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
  CAST('0x' || substr(md5('20240117:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))), 1, 13) AS BIGINT) AS draw FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM d GROUP BY source),
w AS (SELECT *, CAST([3, 1, 2][place % 3 + 1] AS DOUBLE) AS weight, CAST(2 * source_size AS DOUBLE) AS lim, CAST(2 * source_size AS DOUBLE) / [3, 1, 2][place % 3 + 1] AS stop FROM s),
q AS (SELECT 0.0::DOUBLE AS used, sum(weight) AS free, min(stop) AS next FROM w UNION ALL
  SELECT sum(lim) OVER o, sum(weight) OVER () - sum(weight) OVER o, lead(stop) OVER (ORDER BY stop, place) FROM w WINDOW o AS (ORDER BY stop, place ROWS UNBOUNDED PRECEDING)),
l AS (SELECT ((SELECT 1.5::DOUBLE * CAST(sum(source_size) AS DOUBLE) FROM s) - used) / free AS level FROM q WHERE free > 0 AND ((SELECT 1.5::DOUBLE * CAST(sum(source_size) AS DOUBLE) FROM s) - used) / free < next ORDER BY free DESC LIMIT 1),
r AS (SELECT source, source_size, coalesce(least(lim, weight * (SELECT level FROM l)), lim) AS target FROM w),
f AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM r),
b AS (SELECT source, CAST(floor(sqrt(size) * 4) AS BIGINT) AS bin, CAST(count(*) AS DOUBLE) AS n, CAST(sum(size) AS DOUBLE) AS words FROM d GROUP BY ALL),
c AS (SELECT coalesce('=' || b.source, '') AS skey, b.*, words / n AS mean, rate - floor(rate) AS f, row_number() OVER (PARTITION BY b.source ORDER BY bin DESC) AS i,
  CAST('0x' || substr(md5('20240117' || coalesce('=' || b.source, '') || ':' || bin), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE AS u FROM b JOIN f ON b.source IS NOT DISTINCT FROM f.source),
e AS (SELECT skey, i, bin, greatest(least(floor(f * n + u), n), 0) AS take, f * words - greatest(least(floor(f * n + u), n), 0) * mean AS owed FROM c WHERE i = 1 UNION ALL
  SELECT c.skey, c.i, c.bin, greatest(least(floor(f * n + CASE WHEN mean > 0 THEN owed / mean ELSE 0 END + u), n), 0), owed + f * words - greatest(least(floor(f * n + CASE WHEN mean > 0 THEN owed / mean ELSE 0 END + u), n), 0) * mean FROM e JOIN c ON c.skey = e.skey AND c.i = e.i + 1),
k AS (SELECT f.source, e.bin, source_size, target, rate, take FROM e JOIN f ON e.skey = coalesce('=' || f.source, '')),
o AS (SELECT doc_id, size, source_size, target, rate, take, rank() OVER (PARTITION BY k.source, k.bin ORDER BY draw) AS place FROM d JOIN k ON d.source IS NOT DISTINCT FROM k.source AND floor(sqrt(size) * 4) = k.bin)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST((floor(rate) + (place <= take)::INT) * size AS BIGINT) AS taken, CAST(floor(rate) + (place <= take)::INT AS BIGINT) AS copies FROM o
"""
