"""The whole analysis of documents as one projection chain: one Arrow pass at the bottom, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import study
from ..operators import features, report, signals, style
from ..operators.payloads import decode_all

#: Modes that rank profiles.
WITH_PROFILES = ("forensic",)
MEASURED = tuple(n for n in (*study.SIZES, *study.FEATURES))


def studied(docs: DataFrame, mode: str, key: str, text: str, more: list[str]) -> DataFrame:
    """docs with what the Arrow pass and the decoders find."""
    if mode not in study.MODES:
        raise ValueError(f"mode is one of {tuple(study.MODES)}")
    source = F.coalesce(F.col(text), F.lit(""))
    df = docs.select(key, F.col(text).alias("__t"), *more).withColumn("__x", study.studied(F.col("__t"), mode)).withColumn("__p", decode_all(F.coalesce(F.col("__t"), F.lit("")))).withColumn("sha256", F.sha2(source if text == "__t" else F.coalesce(F.col("__t"), F.lit("")), 256))
    df = df.withColumns({
        "payloads": signals.placed_payloads(F.col("__p"), F.col("__x.carriers")), "scripts": F.map_from_entries("__x.scripts"), "segments": F.col("__x.segments"), "n_hits": F.col("__x.hits"),
        "n_homoglyphs": F.col("__x.homoglyphs"), "bold_run_rate": F.col("__x.bold_run_rate"), "opening_pleasantry": F.col("__x.opening_pleasantry"), "n_chars_measured": F.col("__x.cleaned_chars"),
    })
    df = features.unpacked(df, "__x.measures")
    # sizes of the source are those of the text as it came, not of the cleaned one
    df = df.withColumns({"n_chars_source": F.length(F.coalesce(F.col("__t"), F.lit("")))})
    return df.withColumn("signals", signals.ordered(F.concat(signals.payload_signals(F.col("payloads")), F.col("__x.found")))).drop("__x", "__p", "__t")


def analyse(docs: DataFrame, key: str = "doc_id", text: str = "text", mode: str = "forensic", source_format: str | None = None, surprisal: str | None = None) -> DataFrame:
    """A row for each of docs: key, sha256, language, scripts, sizes, measures, payloads, signals with evidence, watermark, style with contributions and
    notes, segments, profiles, findings, warnings, risk and the report.

    `source_format` and `surprisal` name columns of docs (the container the text came from; a language model's signal, null
    where there is none).  Null texts count as empty; the mode is quick (large windows, no profiles) or forensic.
    """
    df = signals.watermark(studied(docs, mode, key, text, [c for c in (source_format, surprisal) if c]))
    df = style.style_score(df)
    if surprisal:
        df = style.blended(df, surprisal)
    none = F.array().cast("array<struct<family:string,similarity:double>>")
    df = report.with_risk(df).withColumns({"contributions": style.contribution_array(), "style_notes": style.style_notes(df), "profiles": style.profile_array() if mode in WITH_PROFILES else none})
    origin = F.lower(F.col(source_format)) if source_format else F.lit(None).cast("string")
    df = df.withColumns({"findings": report.findings(df), "warnings": report.warnings(F.col("n_words"), F.size("scripts"), origin, F.col("watermark_label"))})
    return df.withColumn("report", report.markdown(df, key)).withColumn("mode", F.lit(mode)).drop("n_chars_measured")


def result_json(key: str = "doc_id") -> Column:
    """The result of analyse() as one JSON document, nested as readers of such results expect it."""
    return F.to_json(F.struct(
        F.lit("1.0").alias("schema_version"), F.struct("mode", F.col("style_model"), F.col("style_trained")).alias("engine"),
        F.struct(F.col("n_chars_source").alias("chars"), F.col("n_words_source").alias("words"), F.col("n_chars").alias("chars_measured"), F.col("n_words").alias("words_measured"), F.col("n_sentences").alias("sentences"), F.col("n_paragraphs").alias("paragraphs"), "language", "scripts", "sha256").alias("input"),
        F.struct(
            F.struct(F.col("style_value").alias("value"), F.col("style_low").alias("low"), F.col("style_high").alias("high"), F.col("style_label").alias("label"), F.col("style_confidence").alias("confidence"), "contributions").alias("llm_likelihood"),
            F.struct(F.col("watermark_score").alias("value"), F.col("watermark_label").alias("label"), F.col("watermark_confidence").alias("confidence"), F.col("watermark_basis").alias("basis")).alias("watermark"),
            F.struct(F.col("risk_score").alias("value"), F.col("risk_label").alias("label")).alias("risk"),
        ).alias("scores"),
        "signals", "payloads", "segments", "profiles", F.struct(*study.FEATURES).alias("features"), "findings", "warnings", F.col("report").alias("technical_report_markdown"),
    ))


def analyse_distinct(docs: DataFrame, key: str = "doc_id", text: str = "text", mode: str = "forensic") -> DataFrame:
    """As analyse, each distinct text once: for corpora with many exact copies.

    Copies are told by hash: the least row number of each hash is found first, so texts are not shuffled, and results (without
    their texts) are joined back; a frequent text is one row on one side of that join.
    """
    numbered = docs.select(key, F.col(text).alias("text"), F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("sha256"), F.xxhash64(key).alias("__h"))
    first = numbered.groupBy("sha256").agg(F.min(F.struct("__h", key)).alias("f")).select("sha256", F.col(f"f.{key}").alias(key))
    once = numbered.join(first, ["sha256", key], "left_semi").dropDuplicates(["sha256"]).select("sha256", "text")
    done = analyse(once.withColumnRenamed("sha256", "__sha"), "__sha", "text", mode).drop("__sha")
    return numbered.select(key, "sha256").join(done, "sha256")
