"""The scan over a stream of texts. It keeps no state of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from swayscan.plans import scan as plan
from swayscan.sources.pack import RulePack


def scan_stream(
    texts: DataFrame, keys: list[str], pack: RulePack | None = None, domain=None, text: str = "text"
) -> DataFrame:
    """Move rows of a streaming source; the same plan as for a table."""
    return plan.moves(texts, keys, pack, domain, text)


def tier_counts_by_window(
    texts: DataFrame, time: str, window: str, late: str,
    pack: RulePack | None = None, domain=None, text: str = "text",
) -> DataFrame:
    """Texts and moves per tier in each tumbling window of event time.

    The watermark bounds the state: a window is dropped once it is closed.
    """
    scanned = plan.with_moves(texts, pack, domain, text)
    counted = scanned.select(time, plan.tier_counts(F.col("moves")).alias("counts"))
    return (
        counted.withWatermark(time, late)
        .groupBy(F.window(time, window).alias("window"))
        .agg(
            F.count("*").alias("texts"),
            *(F.sum(f"counts.tier_{t}").alias(f"tier_{t}") for t in (1, 2, 3)),
        )
        .select(F.col("window.start").alias("window_start"), "texts", "tier_1", "tier_2", "tier_3")
    )


def count_windows(
    texts: DataFrame, time: str, window: str, late: str, folder: str,
    pack: RulePack | None = None, domain=None, text: str = "text",
) -> None:
    """Read a stream to its present end into counts that lose no text; run again, it goes on with what came since.

    Each batch writes its counts per window below ``folder``, in a place of its own that a repeated batch overwrites.
    The watermark of a batch is the latest event time of the batches before, less ``late``; texts of windows that end
    at or before it are late and counted apart. ``window_totals`` adds up.
    """

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        seen = _batches(spark, folder, number).agg(F.max("latest")).first()[0]
        mark = F.expr(f"timestamp'{seen}' - interval {late}") if seen is not None else F.lit(None).cast("timestamp")
        scanned = plan.with_moves(rows, pack, domain, text)
        known = F.coalesce(time, F.timestamp_seconds(F.lit(0)))  # windows of a null would drop the row
        counted = scanned.select(time, F.window(known, window).alias("w"), plan.tier_counts(F.col("moves")).alias("counts"))
        counted = counted.withColumn("w", F.when(F.col(time).isNotNull(), F.col("w")))
        is_late = F.coalesce(F.col("w.end") <= mark, F.lit(False))
        sums = counted.groupBy(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end")).agg(
            F.count_if(~is_late).alias("texts"), F.count_if(is_late).alias("late"),
            *(F.sum(F.when(~is_late, F.coalesce(F.col(f"counts.tier_{t}"), F.lit(0))).otherwise(0)).alias(f"tier_{t}") for t in (1, 2, 3)),
            F.max(time).alias("latest"),
        )
        sums.write.mode("overwrite").parquet(f"{folder}/counts/batch={number}")

    writer = texts.writeStream.foreachBatch(batch).option("checkpointLocation", f"{folder}/state")
    writer.trigger(availableNow=True).start().awaitTermination()


_COUNTS = "window_start timestamp, window_end timestamp, texts long, late long, tier_1 long, tier_2 long, tier_3 long, latest timestamp, batch int"


def _batches(spark: SparkSession, folder: str, before: int | None = None) -> DataFrame:
    """What batches have written; none is fine."""
    spark.createDataFrame([], _COUNTS).write.mode("ignore").partitionBy("batch").parquet(f"{folder}/counts")
    found = spark.read.schema(_COUNTS).parquet(f"{folder}/counts")
    return found if before is None else found.where(F.col("batch") < before)


def window_totals(spark: SparkSession, folder: str, late: str) -> DataFrame:
    """All windows of ``count_windows``, open ones too: ``(window_start, texts, late, tier_1, tier_2, tier_3, closed)``.

    ``texts`` and ``late`` together are all texts with an event time. A window is closed if the watermark of what has
    been read so far has passed its end. A text without an event time belongs to no window: null, counted as well.
    """
    found = _batches(spark, folder)
    mark = found.agg(F.max("latest").alias("latest"))
    totals = found.groupBy("window_start", "window_end").agg(*(F.sum(c).alias(c) for c in ("texts", "late", "tier_1", "tier_2", "tier_3")))
    closed = F.coalesce(F.col("window_end") <= F.col("latest") - F.expr(f"interval {late}"), F.lit(False))
    return totals.join(mark).select("window_start", "texts", "late", "tier_1", "tier_2", "tier_3", closed.alias("closed"))
