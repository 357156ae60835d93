"""The asynchronous side as Structured Streaming: submissions, rate windows and the job log.

State lives in tables that are appended to and read as latest-state views, so a replayed
micro-batch changes nothing: rows carry the batch number, and reading takes the newest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.analysis import analyse
from ..plans.store import latest

SUBMISSION = "id string, workspace_id string, text string, mode string, created_at timestamp"


def read_submissions(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(SUBMISSION).parquet(path)


def rate_counts(requests: DataFrame, key: str, at: str, window: str = "60 seconds", late: str = "60 seconds", limit: int = 60) -> DataFrame:
    """Requests of each key and tumbling window; the watermark bounds the state, as a time to live would."""
    hits = requests.withWatermark(at, late).groupBy(F.window(at, window), key).agg(F.count("*").alias("hits"))
    return hits.select(key, F.col("window.start").alias("window_start"), "hits", F.greatest(F.lit(0), F.col("hits") - limit).alias("rejected"))


def first_submissions(submissions: DataFrame, late: str = "1 hour") -> DataFrame:
    """One of each workspace, text and mode within the watermark."""
    keyed = submissions.withColumn("sha256", F.sha2("text", 256)).withWatermark("created_at", late)
    return keyed.dropDuplicatesWithinWatermark(["workspace_id", "sha256", "mode"])


def run_batch(batch: DataFrame, batch_id: int, out: str) -> None:
    """Analyse a micro-batch and write results, marked with the batch: one pass, rows of a repeated id stay rows."""
    keep = ["workspace_id", "mode"]
    packed = batch.select(F.struct("id", *keep).alias("id"), "text")
    done = analyse(packed, "id", "text").select("id.*", "watermark_score", "watermark_label", "style_value", "risk_score", "n_words")
    done.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{out}/results/batch={batch_id}")


def start(submissions: DataFrame, out: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    writer = submissions.writeStream.foreachBatch(lambda df, n: run_batch(df, n, out)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="5 minutes")).start()


def results(spark: SparkSession, out: str) -> DataFrame:
    """The newest result of each submission."""
    return latest(spark.read.parquet(f"{out}/results").drop("batch"), ["id"], ["batch_id"])
