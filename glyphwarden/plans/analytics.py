"""The questions asked of the tables: lists, look-ups, statistics, sweeps and windows of rates.

Times are epoch milliseconds and `now` is a parameter, so results don't depend on the clock.
Every read that a tenant makes is filtered by its workspace.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import STATUSES

DAY_MS = 86_400_000
METRICS = ("risk_score", "risk_label", "watermark_score", "watermark_label", "llm_score", "llm_label", "language", "word_count", "payload_count", "signal_count")


def summaries(analyses: DataFrame, metrics: DataFrame) -> DataFrame:
    m = metrics.select(F.col("analysis_id").alias("__a"), *(c for c in METRICS if c in metrics.columns))
    return analyses.join(m, F.col("id") == F.col("__a"), "left").drop("__a")


def list_page(df: DataFrame, workspace: str, limit: int = 20, offset: int = 0, status: str | None = None) -> DataFrame:
    """A page, newest first, ids deciding between equal times."""
    if not 1 <= limit <= 100 or offset < 0:
        raise ValueError("limit is 1 to 100, offset 0 or more")
    mine = df.where(F.col("workspace_id") == workspace)
    if status:
        mine = mine.where(F.col("status") == status)
    return mine.orderBy(F.desc("created_at"), F.desc("id")).offset(offset).limit(limit)


def status_counts(analyses: DataFrame) -> DataFrame:
    """All four statuses, those without a row as 0: conditional sums, so one partial aggregate does it."""
    counts = analyses.agg(*(F.coalesce(F.sum(F.when(F.col("status") == s, 1).otherwise(0)), F.lit(0)).alias(s) for s in STATUSES), F.count("*").alias("total"))
    return counts.select(F.explode(F.array(*(F.struct(F.lit(s).alias("status"), F.col(s).alias("n")) for s in (*STATUSES, "total")))).alias("r")).select("r.status", "r.n")


def headline(analyses: DataFrame, metrics: DataFrame, workspace: str | None = None) -> DataFrame:
    """Analyses, mean risk, watermarks and payloads; sums of nothing are 0 and the mean null."""
    a = analyses.select(F.col("id").alias("analysis_id"), "workspace_id")
    df = metrics.join(a, "analysis_id")
    if workspace:
        df = df.where(F.col("workspace_id") == workspace)
    marked = F.col("watermark_label").isin("payload_recovered", "watermark_detected", "watermark_suspected")

    def total(cond: Column) -> Column:
        return F.coalesce(F.sum(F.when(cond, 1).otherwise(0)), F.lit(0))

    return df.agg(F.count("*").alias("n"), F.round(F.avg("risk_score"), 4).alias("average_risk"), total(marked).alias("watermarks"), total(F.col("payload_count") > 0).alias("payloads"))


def daily(analyses: DataFrame, now: int, days: int = 7) -> DataFrame:
    return analyses.where(F.col("created_at") >= now - days * DAY_MS).groupBy(F.date_format(F.to_date(F.timestamp_millis("created_at")), "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))


def newest_done(analyses: DataFrame) -> DataFrame:
    """The newest finished analysis of each workspace, text and mode."""
    w = Window.partitionBy("workspace_id", "text_sha256", "mode").orderBy(F.desc("created_at"), F.desc("id"))
    return analyses.where("status = 'done'").withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def split_submissions(new: DataFrame, history: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(submissions that a finished analysis answers, those to run)."""
    key = ["workspace_id", "text_sha256", "mode"]
    done = newest_done(history).select(*key, F.col("id").alias("reused_id"))
    return new.join(done, key), new.join(done, key, "left_anti")


def stalled(analyses: DataFrame, before: int, most_attempts: int = 3, limit: int = 10) -> DataFrame:
    waiting = (F.col("status") == "pending") & (F.col("created_at") < before)
    hanging = (F.col("status") == "running") & F.col("started_at").isNotNull() & (F.col("started_at") < before)
    return analyses.where((F.col("attempts") < most_attempts) & (waiting | hanging)).orderBy("created_at", "id").limit(limit)


def exhausted(analyses: DataFrame, most_attempts: int = 3, limit: int = 25) -> DataFrame:
    return analyses.where((F.col("attempts") >= most_attempts) & F.col("status").isin("pending", "running")).orderBy("created_at", "id").limit(limit)


def event_trail(events: DataFrame, key: str = "analysis_id") -> DataFrame:
    """Events with their place in the trail and the time since the one before."""
    w = Window.partitionBy(key).orderBy("created_at", "id")
    return events.withColumns({"step": F.row_number().over(w), "since_ms": F.col("created_at") - F.lag("created_at").over(w)})


def recent_errors(events: DataFrame, analyses: DataFrame, limit: int = 20) -> DataFrame:
    a = analyses.select(F.col("id").alias("__a"), "status", "error")
    j = events.join(a, F.col("analysis_id") == F.col("__a"), "left").where("status = 'error'")
    return j.drop("__a").orderBy(F.desc("created_at"), F.desc("id")).limit(limit)


def report_documents(reports: DataFrame, analyses: DataFrame, metrics: DataFrame) -> DataFrame:
    a = analyses.select(F.col("id").alias("analysis_id"), "status", "text_sha256")
    return reports.join(a, "analysis_id", "left").join(metrics.select("analysis_id", "risk_score", "watermark_label"), "analysis_id", "left")


def riskiest(df: DataFrame, k: int, score: str = "risk_score", key: str = "id") -> DataFrame:
    return df.orderBy(F.desc_nulls_last(score), key).limit(k)


def rate_windows(requests: DataFrame, key: str, at: str, seconds: int, limit: int) -> DataFrame:
    """key, window_start, hits, rejected: every request counts, those above the limit are rejected."""
    start = F.floor(F.unix_timestamp(at) / seconds) * seconds
    return requests.groupBy(key, start.alias("window_start")).agg(F.count("*").alias("hits")).withColumn("rejected", F.greatest(F.lit(0), F.col("hits") - limit))


def with_quota(requests: DataFrame, key: str, at: str, tie: str, seconds: int, limit: int) -> DataFrame:
    """Requests with what is left after each within its window and whether it was allowed."""
    start = F.floor(F.unix_timestamp(at) / seconds) * seconds
    w = Window.partitionBy(key, "window_start").orderBy(at, tie)
    df = requests.withColumn("window_start", start).withColumn("__n", F.row_number().over(w))
    return df.withColumns({"remaining": F.greatest(F.lit(0), limit - F.col("__n")), "allowed": F.col("__n") <= limit}).drop("__n")


def validated(docs: DataFrame, text: str = "text", mode: str = "mode", most: int = 200_000) -> DataFrame:
    """docs with the reason why a row is refused, null for an accepted one."""
    t = F.col(text)
    return docs.withColumn("refused", F.when(t.isNull() | ~t.rlike(r"\S"), "empty text").when(F.length(t) > most, "text too long").when(F.col(mode).isNull() | ~F.col(mode).isin("quick", "forensic"), "unknown mode"))


def validated_reports(reports: DataFrame) -> DataFrame:
    """reports with the column that is refused: title (1 to 200 characters), notes (5,000 at most) or analysis_id."""
    title = F.trim("title")
    return reports.withColumn("refused", F.when(title.isNull() | (F.length(title) == 0) | (F.length(title) > 200), "title").when(F.length(F.trim("notes")) > 5000, "notes").when(F.col("analysis_id").isNull() | ~F.col("analysis_id").rlike(r"^[a-z0-9]{1,64}\z"), "analysis_id"))
