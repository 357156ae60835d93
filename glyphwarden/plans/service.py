"""What the service around the tables does: look-ups, the sweep of jobs, retries, polling, cached results, tokens, models.

Consistency: counters and states are exact here, as every read sees whole committed files; a key-value
store that answers later with older values has no counterpart.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import hmac

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .analytics import METRICS, exhausted, stalled, summaries

#: Statuses of a request that are tried again.
RETRYABLE = (408, 425, 429, 500, 502, 503, 504)
#: Columns of a list of analyses: of the analysis itself, then of its metrics (null until there are any).
SUMMARY = ("id", "workspace_id", "status", "mode", "source", "filename", "char_count", "attempts", "error", "created_at", "started_at", "completed_at", "source_format")


def summary_rows(analyses: DataFrame, metrics: DataFrame) -> DataFrame:
    """Analyses with their metrics; columns that a table does not have are null."""
    df = summaries(analyses, metrics)
    return df.select(*((F.col(c) if c in df.columns else F.lit(None).cast("string")).alias(c) for c in (*SUMMARY, *METRICS)))


def to_summary(df: DataFrame) -> DataFrame:
    """The names that readers of a list see; no label without an analysis that is done."""
    return df.select("id", "status", F.col("created_at").alias("submitted_at"), F.col("completed_at").alias("finished_at"), F.coalesce("filename", "source").alias("title"), F.col("risk_score").alias("risk"), F.coalesce("watermark_label", F.lit("none")).alias("verdict"))


def one(df: DataFrame, key: str, workspace: str | None = None) -> DataFrame:
    """The row with an id, within a workspace where one is given."""
    found = df.where(F.col("id") == key)
    return found.where(F.col("workspace_id") == workspace) if workspace else found


def page_total(df: DataFrame, workspace: str, status: str | None = None) -> DataFrame:
    """How many rows all pages of a list have."""
    mine = df.where(F.col("workspace_id") == workspace)
    return (mine.where(F.col("status") == status) if status else mine).agg(F.count("*").alias("total"))


def scaled(days: DataFrame) -> DataFrame:
    """Daily counts (a handful of rows) with the largest, for bars of equal scale."""
    return days.join(F.broadcast(days.agg(F.max("n").alias("most"))), F.lit(True), "left").withColumn("height", F.round(F.col("n") / F.greatest("most", F.lit(1)), 4))


def sweep(analyses: DataFrame, now: int, stall_ms: int, most_attempts: int = 3, retries: int = 5, give_ups: int = 25) -> DataFrame:
    """What a sweep does: (id, workspace_id, action, to, error, event, detail); jobs out of attempts end, stalled ones are tried again, the oldest first."""
    tried = F.col("attempts").cast("string")
    gone = exhausted(analyses, most_attempts, give_ups).select(
        "id", "workspace_id", F.lit("give_up").alias("action"), F.lit("error").alias("to"), F.concat(F.lit("given up after "), tried, F.lit(" attempts")).alias("error"),
        F.lit("analysis.abandoned").alias("event"), F.concat(F.lit("attempts="), tried).alias("detail"),
    )
    again = stalled(analyses, now - stall_ms, most_attempts, retries).select(
        "id", "workspace_id", F.lit("retry").alias("action"), F.lit("running").alias("to"), F.lit(None).cast("string").alias("error"),
        F.lit("analysis.retry").alias("event"), F.concat(F.lit("attempt="), (F.col("attempts") + 1).cast("string")).alias("detail"),
    )
    return gone.unionByName(again)


def after_failure(jobs: DataFrame, message: str = "message", most_attempts: int = 3) -> DataFrame:
    """jobs with the state that a failed run leads to: back to pending while attempts are left, else error."""
    left = F.col("attempts") < most_attempts
    return jobs.withColumns({
        "to": F.when(left, "pending").otherwise("error"), "event": F.when(left, "analysis.retry_scheduled").otherwise("analysis.failed"),
        "detail": F.left(F.when(left, F.concat(F.lit("attempt "), F.col("attempts").cast("string"), F.lit(" failed: "), F.col(message))).otherwise(F.col(message)), F.lit(1000)),
    })


def retry_plan(requests: DataFrame, status: str = "status", attempt: str = "attempt", most: int = 2, first_ms: int = 500) -> DataFrame:
    """requests with wait_ms before the next attempt, doubled each time (a caller adds its jitter); null where none follows."""
    again = F.col(status).isin(*RETRYABLE) & (F.col(attempt) < most)
    return requests.withColumns({"retryable": F.col(status).isin(*RETRYABLE), "wait_ms": F.when(again, first_ms * F.pow(F.lit(2), F.col(attempt)).cast("int"))})


def poll_times(first_ms: int = 1200, factor: float = 1.4, longest_ms: int = 8000, timeout_ms: int = 180_000) -> list[int]:
    """When a waiting client asks: delays grow up to the longest, until the timeout has passed."""
    at, delay, out = 0, first_ms, []
    while at <= timeout_ms:
        out.append(at)
        at, delay = at + delay, min(int(delay * factor + 0.5), longest_ms)
    return out


def clamped(limit: Column, service_limit: int) -> Column:
    """An engine's limit, no larger than the service's own."""
    return F.least(limit, F.lit(service_limit))


def heat_alpha(score: Column) -> Column:
    """Opacity of a score's colour: the further from a half, the stronger."""
    return F.round(0.08 + 0.32 * F.abs(score - 0.5) * 2, 3)


def read_through(stored: DataFrame, cached: DataFrame, now: int, ttl_ms: int = 3_600_000, most_bytes: int = 1_000_000) -> DataFrame:
    """(id, result, from_cache): the cached JSON (id, result, cached_at) where it is fresh, small and readable, else the stored one."""
    fresh = cached.where((F.col("cached_at") > now - ttl_ms) & (F.length(F.encode("result", "UTF-8")) <= most_bytes) & F.try_parse_json("result").isNotNull())
    hit = fresh.groupBy("id").agg(F.max_by("result", "cached_at").alias("__hit"))
    return stored.join(hit, "id", "left").select("id", F.coalesce("__hit", "result").alias("result"), F.col("__hit").isNotNull().alias("from_cache"))


def signed(ids: Column, secret: str) -> Column:
    """id.signature, HMAC-SHA256 in base64url without padding."""

    @F.pandas_udf(StringType())
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda i: f"{i}.{_mac(i, secret)}", na_action="ignore")

    return run(ids)


def verified(tokens: Column, secret: str) -> Column:
    """The id of a token whose signature holds, else null; signatures are compared in constant time."""

    @F.pandas_udf(StringType())
    def run(s: pd.Series) -> pd.Series:
        def read(token: str) -> str | None:
            name, dot, mac = token.rpartition(".")
            return name if dot and hmac.compare_digest(mac.encode(), _mac(name, secret).encode()) else None

        return s.map(read, na_action="ignore")

    return run(tokens)


def _mac(text: str, secret: str) -> str:
    return base64.urlsafe_b64encode(hmac.new(secret.encode(), text.encode(), hashlib.sha256).digest()).rstrip(b"=").decode()


def timed(df: DataFrame, name: str) -> tuple[DataFrame, object]:
    """df and an observation of it (rows; Spark fills it as the plan runs): stage times are in the listener's metrics, not in the rows."""
    from pyspark.sql import Observation

    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen


@functools.lru_cache(maxsize=4)
def load_model(path: str | None):
    """The trained style model at a path; None, which means the documented priors, where there is none or it can't be read.  Loaded once."""
    from pyspark.ml import PipelineModel

    if not path:
        return None
    try:
        return PipelineModel.load(path)
    except Exception:  # a missing or damaged model is no reason to fail: the priors are always there
        return None


def judged_by(measured: DataFrame, path: str | None = None) -> DataFrame:
    """Measured rows judged by the trained model at path, else by the priors."""
    from ..operators import style, training

    model = load_model(path)
    return style.trained_score(training.predict(model, measured)) if model else style.style_score(measured)
