"""Segments and the joins of points and intervals with them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import study
from ..functions.spans import window_spans

MODES = study.MODES


def window_rows(docs: DataFrame, mode: str = "forensic", key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, idx, start_offset, end_offset, n_words, text of the windows of each document."""
    rows = docs.select(key, F.posexplode(window_spans(F.col(text), *MODES[mode])).alias("idx", "w"))
    return rows.select(key, "idx", F.col("w.start").alias("start_offset"), F.col("w.end").alias("end_offset"), F.col("w.n_words").alias("n_words"), F.col("w.text").alias("text"))


def segment_rows(docs: DataFrame, segments: str = "segments", key: str = "doc_id") -> DataFrame:
    """A row for each segment of an array of them: key, idx, start_offset, end_offset, word_count, llm_likelihood, label, watermark_hits, preview."""
    # not explode(): for it Spark infers a filter on the array and pushes that, with the pass that makes it, below
    rows = docs.select(key, F.explode_outer(segments).alias("s")).where("s.index is not null")
    return rows.select(
        key, F.col("s.index").alias("idx"), F.col("s.start").alias("start_offset"), F.col("s.end").alias("end_offset"), "s.word_count", "s.llm_likelihood", "s.label", "s.watermark_hits", "s.preview",
    )


def segments(docs: DataFrame, mode: str = "forensic", key: str = "doc_id", text: str = "text", language: str = "language") -> DataFrame:
    """Scored windows of docs, whose language is known; hidden characters and look-alikes in a window are its hits.

    One Arrow pass: a window is measured once, and hits are counted by their positions.
    """
    return segment_rows(docs.select(key, study.segmented(F.col(text), F.col(language), mode).alias("segments")), key=key)


def count_hits(segs: DataFrame, hits: DataFrame, key: str = "doc_id") -> DataFrame:
    """segs with watermark_hits, the hits whose offset lies in the segment.

    Hits are gathered by document first (one row each), so segs are read once, however they were made.
    """
    h = hits.groupBy(F.col(key).alias("__k")).agg(F.collect_list("offset").alias("__at"))
    inside = F.size(F.filter("__at", lambda o: (o >= F.col("start_offset")) & (o < F.col("end_offset"))))
    return segs.join(h, F.col(key) == F.col("__k"), "left").withColumn("watermark_hits", F.when(F.col("__at").isNull(), 0).otherwise(inside).cast("long")).drop("__k", "__at")


def fragments(segs: DataFrame, lengths: DataFrame, key: str = "doc_id", score: str = "llm_likelihood") -> DataFrame:
    """key, start, end, score, n_segments: the text cut at every segment end, each piece with the mean of what covers it.

    lengths (key, n) gives the length of each text; pieces no segment covers have a null score.
    """
    inner = segs.select(key, F.explode(F.array("start_offset", "end_offset")).alias("cut"))
    edges = lengths.select(key, F.explode(F.array(F.lit(0), F.col("n"))).alias("cut"))
    n = lengths.select(F.col(key).alias("__k"), F.col("n").alias("__n"))
    cuts = inner.unionByName(edges).join(n, F.col(key) == F.col("__k")).where("cut >= 0 and cut <= __n").select(key, "cut").distinct()
    w = Window.partitionBy(key).orderBy("cut")
    pieces = cuts.select(key, F.col("cut").alias("start"), F.lead("cut").over(w).alias("end")).where("end is not null")
    s = segs.select(F.col(key).alias("__k"), F.col("start_offset").alias("__s"), F.col("end_offset").alias("__e"), F.col(score).alias("__v"))
    over = (F.col(key) == F.col("__k")) & (F.col("__s") < F.col("end")) & (F.col("__e") > F.col("start"))
    return pieces.join(s, over, "left").groupBy(key, "start", "end").agg(F.avg("__v").alias("score"), F.count("__v").alias("n_segments"))


def weighted_mean(segs: DataFrame, key: str = "doc_id", score: str = "llm_likelihood") -> DataFrame:
    """key, n_segments and the mean score weighted by words, a segment counting at least one."""
    w = F.greatest(F.col("word_count"), F.lit(1))
    return segs.groupBy(key).agg(F.count("*").alias("n_segments"), (F.sum(F.col(score) * w) / F.sum(w)).alias("mean_score"))


def carrier_offsets(spans: DataFrame, key: str = "doc_id", most: int = 8) -> DataFrame:
    """key, at: every offset of evidence spans (offset, length), `most` of each span."""
    return spans.select(key, F.explode(F.sequence(F.col("offset"), F.col("offset") + F.least(F.greatest("length", F.lit(1)), F.lit(most)) - 1)).alias("at")).distinct()


def marked_characters(docs: DataFrame, carriers: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, start, length, marked, piece: each text cut where characters that are carriers (key, at) begin and end.

    Offsets are gathered by document, and runs are found in the row: no row for each character.
    """
    at = carriers.groupBy(F.col(key).alias("__k")).agg(F.array_sort(F.collect_set("at")).alias("__at"))
    df = docs.select(key, text).join(at, F.col(key) == F.col("__k"), "left").withColumn("__at", F.coalesce("__at", F.array().cast("array<int>")))
    n = F.length(text)
    edges = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0), n), F.flatten(F.transform(F.filter("__at", lambda o: o < n), lambda o: F.array(o, o + 1))))))
    df = df.withColumn("__e", edges)
    runs = F.transform(F.slice("__e", F.lit(1), F.greatest(F.size("__e") - 1, F.lit(0))), lambda a, i: F.struct(a.alias("start"), (F.get("__e", i + 1) - a).alias("length")))
    pieces = df.select(key, text, "__at", F.explode(runs).alias("r")).where("r.length > 0")
    # a run of neighbours is one piece for each carrier; stretches without any are whole
    return pieces.select(key, "r.start", "r.length", F.array_contains("__at", F.col("r.start")).alias("marked"), F.substring(text, F.col("r.start") + 1, F.col("r.length")).alias("piece"))
