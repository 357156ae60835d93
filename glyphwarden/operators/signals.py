"""Watermark evidence: what the detectors found, payloads among it, and the score that combines them.

Detectors of characters, typography, repetition and layout run in the Arrow pass of
functions/study.py; payload decoders, their signals and the score are Column expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import study
from ..functions.text import let, preview
from .payloads import decode_all

SEVERITIES = ("info", "low", "medium", "high", "critical")
SIGNALS = study.spark_type(study.pa.list_(study.SIGNAL))


def severity(score: Column) -> Column:
    return F.when(score >= 0.85, "critical").when(score >= 0.65, "high").when(score >= 0.4, "medium").when(score >= 0.15, "low").otherwise("info")


def severity_rank(sev: Column) -> Column:
    return F.array_position(F.array(*(F.lit(s) for s in SEVERITIES)), sev).cast("int")


def placed_payloads(payloads: Column, carriers: Column) -> Column:
    """Payloads with the offsets of their first and last carrier, which `carriers` (note, first, last) has by the decoder's note."""

    def one(p: Column) -> Column:
        mine = F.get(F.filter(carriers, lambda c: F.startswith(p["note"], c["note"])), F.lit(0))
        return let(mine, lambda c: F.struct(
            p["channel"].alias("channel"), p["text"].alias("text"), p["byte_length"].alias("byte_length"), F.round(p["printable_ratio"], 4).alias("printable_ratio"), p["n_carriers"].alias("carrier_count"),
            c["first"].alias("first_offset"), c["last"].alias("last_offset"), p["note"].alias("note")))

    return F.transform(payloads, one)


def payload_signals(payloads: Column) -> Column:
    """The signal of each placed payload: critical, with its content and where its carriers stand as evidence."""

    def one(p: Column) -> Column:
        said = F.struct(F.lit("payload").alias("kind"), F.concat(F.lit("content: "), preview(p["text"], 160)).alias("detail"), F.lit(None).cast("int").alias("offset"), F.lit(1).alias("length"))
        where = F.struct(
            F.lit("span").alias("kind"), F.format_string("%d carriers from offset %d to %d", p["carrier_count"], p["first_offset"], p["last_offset"]).alias("detail"),
            p["first_offset"].alias("offset"), (p["last_offset"] - p["first_offset"] + 1).cast("int").alias("length"))
        return F.struct(
            F.concat(F.lit("payload_"), p["channel"]).alias("id"), F.lit("covert_channel").alias("category"), F.concat(F.lit("Hidden message in "), F.replace(p["channel"], F.lit("_"), F.lit(" "))).alias("title"),
            F.format_string("%d bytes of invisible characters decode to text. %s", p["byte_length"], p["note"]).alias("description"), F.lit(0.97).alias("score"), F.lit(1.0).alias("weight"), F.lit("critical").alias("severity"),
            F.lit(0).alias("rank"), F.array(said, where).alias("evidence"), F.lit(2).alias("evidence_total"))

    return F.transform(payloads, one).cast(SIGNALS)


def ordered(found: Column) -> Column:
    """Highest severity first, then score, then the detectors' order."""
    keyed = F.transform(found, lambda s: F.struct((-severity_rank(s["severity"])).alias("a"), (-s["score"]).alias("b"), s["rank"].alias("c"), s.alias("s")))
    return F.transform(F.array_sort(keyed), lambda x: x["s"])


def signals(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with payloads and the array of signals.  Null texts count as empty."""
    df = docs.withColumn("__x", study.signalled(F.col(text))).withColumn("__p", decode_all(F.coalesce(F.col(text), F.lit(""))))
    df = df.withColumn("payloads", placed_payloads(F.col("__p"), F.col("__x.carriers")))
    return df.withColumn("signals", ordered(F.concat(payload_signals(F.col("payloads")), F.col("__x.found")))).drop("__x", "__p")


def watermark(docs: DataFrame) -> DataFrame:
    """After signals(): watermark_value, its rounded watermark_score, _label, _confidence and _basis."""
    hard = F.filter("signals", lambda s: s["category"] != "stylistic")
    soft = F.filter("signals", lambda s: s["category"] == "stylistic")
    # the strongest counts in full; each further channel takes half its strength of what is left
    strength = F.reverse(F.array_sort(F.transform(hard, lambda s: s["score"] * s["weight"])))
    bytes_score = let(strength, lambda v: F.aggregate(F.slice(v, 2, 100), F.coalesce(F.get(v, F.lit(0)), F.lit(0.0)), lambda h, x: h + (1.0 - h) * x * 0.5))
    total = F.aggregate(soft, F.lit(0.0), lambda a, s: a + s["weight"])
    style = F.when(total > 0, F.aggregate(soft, F.lit(0.0), lambda a, s: a + s["score"] * s["weight"]) / total).otherwise(0.0)
    payload = F.exists("signals", lambda s: s["id"].startswith("payload_"))
    score = F.least(F.lit(0.99), F.greatest(bytes_score, style * 0.45))
    s = F.col("watermark_value")
    return docs.withColumn("watermark_value", F.when(payload, F.greatest(score, F.lit(0.95))).otherwise(score)).withColumns({
        "watermark_label": F.when(payload, "payload_recovered").when(s >= 0.8, "watermark_detected").when(s >= 0.5, "watermark_suspected").when(s >= 0.2, "weak_indicators").otherwise("clean"),
        "watermark_confidence": F.when(payload | (s >= 0.8), "high").when(s >= 0.5, "medium").otherwise("low"),
        "watermark_basis": F.when(F.size(hard) > 0, "bytes").when(F.size(soft) > 0, "stylistic").otherwise("none"),
        "watermark_score": F.round(s, 4),
    })
