"""The six tables, as an append-only log with latest-state views: plain Parquet has no MERGE."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCHEMAS = {
    "workspaces": "id string, created_at long, last_seen_at long",
    "analyses": "id string, workspace_id string, status string, mode string, source string, filename string, text_sha256 string, char_count int, attempts int, engine_version string, error string, created_at long, started_at long, completed_at long, source_format string",
    "analysis_metrics": "analysis_id string, risk_score double, risk_label string, watermark_score double, watermark_label string, llm_score double, llm_low double, llm_high double, llm_label string, llm_model_id string, llm_trained int, language string, word_count int, payload_count int, signal_count int, created_at long",
    "analysis_segments": "analysis_id string, idx int, start_offset int, end_offset int, word_count int, llm_likelihood double, label string, watermark_hits int, preview string",
    "reports": "id string, workspace_id string, analysis_id string, title string, notes string, created_at long",
    "events": "id long, workspace_id string, analysis_id string, type string, detail string, created_at long",
}
STATUSES = ("pending", "running", "done", "error")


def latest(log: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The newest row of each key; `order` must decide."""
    w = Window.partitionBy(*key).orderBy(*(F.col(c).desc() for c in order))
    return log.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def upsert(old: DataFrame, new: DataFrame, key: list[str], keep: list[str] = ()) -> DataFrame:
    """old with the rows of new by key; columns in `keep` stay as first written."""
    kept = old.select(*key, *(F.col(c).alias(f"__{c}") for c in keep))
    merged = new.join(kept, key, "left") if keep else new
    for c in keep:
        merged = merged.withColumn(c, F.coalesce(f"__{c}", c))
    return old.join(new.select(*key), key, "left_anti").unionByName(merged.select(*old.columns))


def touch_workspaces(old: DataFrame, seen: DataFrame) -> DataFrame:
    """Workspaces with the first and the last time they were seen: one aggregate, whatever the order."""
    return old.unionByName(seen.select("id", F.col("at").alias("created_at"), F.col("at").alias("last_seen_at"))).groupBy("id").agg(F.min("created_at").alias("created_at"), F.max("last_seen_at").alias("last_seen_at"))


def replace_group(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old with all rows of each key in new replaced by those of new: delete and insert as one."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new.select(*old.columns))


def delete_cascade(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """The tables without the analyses named in gone(id) and what hangs on them."""
    out = dict(tables)
    out["analyses"] = tables["analyses"].join(gone, "id", "left_anti")
    child = gone.select(F.col("id").alias("analysis_id"))
    for name in ("analysis_metrics", "analysis_segments", "reports"):
        if name in tables:
            out[name] = tables[name].join(child, "analysis_id", "left_anti")
    return out


def insert(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """old and those of new whose key is not there yet, so that a repeated insert changes nothing; columns that new lacks are null."""
    fresh = new.dropDuplicates([key]).join(old.select(key), key, "left_anti")
    return old.unionByName(fresh, allowMissingColumns=True)


def event_row(type_: Column, detail: Column, at: Column) -> Column:
    return F.struct(type_.alias("type"), F.left(detail, F.lit(1000)).alias("detail"), at.alias("created_at"))


#: Which state may follow which; `running` to `pending` is a retry.
NEXT = {"pending": ("running", "error"), "running": ("done", "error", "pending"), "done": (), "error": ()}


def refused(state: DataFrame, changes: DataFrame) -> DataFrame:
    """(id, status, to) of changes that the present state forbids, or whose job is unknown."""
    j = changes.select("id", "to").join(state.select("id", "status"), "id", "left")
    allowed = F.lit(False)
    for a, following in NEXT.items():
        allowed = allowed | ((F.col("status") == a) & F.col("to").isin(*following)) if following else allowed
    return j.where(~F.coalesce(allowed, F.lit(False))).select("id", "status", "to")


def permitted(state: DataFrame, changes: DataFrame) -> DataFrame:
    """The changes that the present state allows."""
    return changes.join(refused(state, changes).select("id", "to"), ["id", "to"], "left_anti")


def transition(state: DataFrame, changes: DataFrame) -> DataFrame:
    """The job table after changes that are permitted (id, to, at, error): running counts an attempt, pending clears the start, error keeps 1000 characters."""
    c = permitted(state, changes).select("id", "to", "at", F.col("error").alias("__error"))
    j = state.join(c, "id", "left")
    to = F.col("to")
    return j.select(*(
        {
            "status": F.coalesce(to, "status"),
            "attempts": F.col("attempts") + F.when(to == "running", 1).otherwise(0),
            "started_at": F.when(to == "running", F.col("at")).when(to == "pending", F.lit(None)).otherwise(F.col("started_at")),
            "completed_at": F.when(to.isin("done", "error"), F.col("at")).otherwise(F.col("completed_at")),
            "error": F.when(to == "error", F.left("__error", F.lit(1000))).when(to == "done", F.lit(None)).otherwise(F.col("error")),
        }.get(name, F.col(name)).alias(name)
        for name in state.columns
    ))
