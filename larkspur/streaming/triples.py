"""Streaming ingest of CSV triples: the last value per key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from larkspur.sources.files import Files
from larkspur.sources.generators import digit_fields, triple_columns, triples_in

#: Batches after which all are merged into one snapshot.
SNAPSHOT_EVERY = 16


def last_per_key(triples: DataFrame, order: str) -> DataFrame:
    """One row per key, the one highest in ``order``; partial maxima are exchanged, so a hot key costs a row per task."""
    newest = F.max_by(F.struct("val1", "val2"), F.col(order)).alias("v")
    return triples.groupBy("key").agg(newest, F.max(order).alias(order)).select("key", "v.val1", "v.val2", order)


def file_triples(lines: DataFrame) -> DataFrame:
    """key, val1, val2, place of the triples of whole files, read in parts.

    lines: value, and (file, block, line), which order the lines of a file; a
    block is what one task reads of it.  A triple may go over a line's or a
    block's end, and a file counts up to its first other character.  Lines know
    the fields before them from the sums of the blocks before and of the lines
    before in the block; only triples that a line end cuts are put together by
    a shuffle.
    """
    digits = digit_fields(F.col("value"))
    read = lines.select("file", "block", "line", digits.alias("f"), F.col("value").rlike(r"[^0-9,\r\n]").cast("int").alias("bad"))
    earlier = Window.partitionBy("file", "block").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    placed = read.withColumn("at", F.coalesce(F.sum(F.size("f")).over(earlier), F.lit(0))).withColumn("over", F.coalesce(F.max("bad").over(earlier), F.lit(0))).where("over = 0")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = placed.groupBy("file", "block").agg(F.sum(F.size("f")).alias("n"), F.max("bad").alias("bad"))
    blocks = blocks.select("file", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"), F.coalesce(F.max("bad").over(before), F.lit(0)).alias("ended")).where("ended = 0")
    known = placed.join(blocks, ["file", "block"]).withColumn("at", F.col("at") + F.col("base"))
    skip = F.least(((3 - F.col("at") % 3) % 3).cast("int"), F.size("f"))
    known = known.select("file", "at", "f", skip.alias("skip"), triples_in(F.col("f"), skip).alias("whole"))
    whole = known.select("file", F.floor((F.col("at") + F.col("skip")) / 3).alias("first"), F.posexplode("whole").alias("i", "t")).select("file", (F.col("first") + F.col("i")).alias("number"), "t")
    cut = known.select("file", "at", "skip", F.size("whole").alias("w"), F.posexplode("f").alias("i", "d")).where("i < skip or i >= skip + 3 * w")
    field = lambda k: F.max(F.when(F.col("slot") == k, F.col("d")))
    cut = cut.select("file", F.floor((F.col("at") + F.col("i")) / 3).alias("number"), ((F.col("at") + F.col("i")) % 3).alias("slot"), "d")
    joined = cut.groupBy("file", "number").agg(F.array(field(0), field(1), field(2)).alias("t"), F.count(F.lit(1)).alias("n")).where("n = 3").select("file", "number", "t")
    return whole.unionByName(joined).select(*triple_columns(F.col("t")), F.struct("file", "number").alias("place"))


def lines_of(text: DataFrame) -> DataFrame:
    """Lines of a text source with their file, which sort as they arrived, and block."""
    file = F.struct(F.col("_metadata.file_modification_time").alias("time"), F.col("_metadata.file_path").alias("path"))
    return text.select("value", file.alias("file"), F.col("_metadata.file_block_start").alias("block"))


def ingest(spark: SparkSession, source: str, target: str, checkpoint: str):
    """A query that keeps ``target`` up to date with text files that arrive in ``source``.

    Of a key's values the last one counts: in the last batch, of the file that
    arrived last, furthest down in it.  Each batch writes one folder of its own,
    named by its number, so a batch that is run again after a failure replaces
    itself; every SNAPSHOT_EVERY batches all are merged into a snapshot.
    """

    def write(batch: DataFrame, number: int) -> None:
        # a block is read by one task, in which the number grows from line to line
        triples = file_triples(batch.withColumn("line", F.monotonically_increasing_id()))
        last_per_key(triples, "place").drop("place").withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{target}/batches/{number:010d}")
        if number % SNAPSHOT_EVERY == SNAPSHOT_EVERY - 1:
            snapshot(spark, target, number)

    return lines_of(spark.readStream.text(source)).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _folders(files: Files, kind: str) -> list[int]:
    """Numbers of the finished folders of a kind."""
    return [int(n) for n in files.names(kind) if "_SUCCESS" in files.names(f"{kind}/{n}")]


def _merged(spark: SparkSession, target: str, upto: int | None = None) -> DataFrame:
    files = Files(spark, target)
    wanted = lambda kind: [n for n in _folders(files, kind) if upto is None or n <= upto]
    latest = wanted("snapshots")[-1:]
    names = [f"{target}/snapshots/{n:010d}" for n in latest] + [f"{target}/batches/{n:010d}" for n in wanted("batches") if not latest or n > latest[0]]
    if not names:
        return spark.createDataFrame([], "key decimal(20,0), val1 long, val2 long, batch long")
    return last_per_key(spark.read.parquet(*names), "batch")


def snapshot(spark: SparkSession, target: str, number: int) -> None:
    """Merge all batches up to this one; what the snapshot before last merged is removed, as no reader needs it any more."""
    _merged(spark, target, number).write.mode("overwrite").parquet(f"{target}/snapshots/{number:010d}")
    files = Files(spark, target)
    for old in _folders(files, "snapshots")[:-2]:
        files.delete(f"snapshots/{old:010d}")
    for n in _folders(files, "batches"):
        if n <= number - SNAPSHOT_EVERY:
            files.delete(f"batches/{n:010d}")


def current(spark: SparkSession, target: str) -> DataFrame:
    """Last value per key over all batches."""
    return _merged(spark, target).drop("batch")
