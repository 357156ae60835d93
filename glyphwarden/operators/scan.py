"""Scans of characters, look-alike letters and scripts.

All are projections and explodes: no shuffle but for the aggregates.  A regex in the JVM
leaves texts without a suspicious character out before anything is split up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import codepoints as cp
from ..functions.text import let, strip_invisible

RADIUS = 24


def context(text: Column, offset: Column) -> Column:
    """The characters around an offset, a caret in the place of the character itself."""
    start = F.greatest(offset - RADIUS, F.lit(0))
    around = F.concat(F.substring(text, start + 1, offset - start), F.lit("‸"), F.substring(text, offset + 2, F.lit(RADIUS)))
    return F.replace(strip_invisible(around), F.lit("\n"), F.lit(" "))


def char_hits(docs: DataFrame, text: str = "text", with_context: bool = False) -> DataFrame:
    """A row for each suspicious character: the other columns, offset, codepoint, category, name (and context).

    A lone presentation selector after a pictograph is ordinary text and no hit.
    """
    chars = docs.where(F.col(text).rlike(f"[{cp.SUSPICIOUS_SET}]")).withColumn("__c", F.split(text, ""))
    n = F.size("__c")
    pieces = F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda i: F.struct(i.alias("offset"), F.get("__c", i).alias("ch"), F.get("__c", i - 1).alias("before"), F.get("__c", i + 1).alias("after")),
    )
    hit = F.filter(pieces, lambda p: p["ch"].rlike(f"[{cp.SUSPICIOUS_SET}]"))
    selector = F.col("p.ch").rlike(r"[\x{FE0E}\x{FE0F}]") & F.coalesce(F.col("p.before").rlike(f"[{cp.SCAN_PICTOGRAPH_SET}]"), F.lit(False)) & ~F.coalesce(F.col("p.after").rlike(r"[\x{FE0E}\x{FE0F}]"), F.lit(False))
    rows = chars.withColumn("p", F.explode(hit)).where(~selector).withColumn("codepoint", cp.code_point(F.col("p.ch")))
    keep = [F.col(c) for c in docs.columns if c != text]
    out = [F.col("p.offset").alias("offset"), "codepoint", cp.category_of(F.col("codepoint")).alias("category"), cp.name_of(F.col("codepoint")).alias("name")]
    if with_context:
        out.append(context(F.col(text), F.col("p.offset")).alias("context"))
    return rows.select(*keep, *out)


def hits_by_name(hits: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, n_hits, summary: 'label xN' for each label in order."""
    each = hits.groupBy(key, cp.label_of(F.col("codepoint"), F.col("name")).alias("label")).agg(F.count("*").alias("n"))
    item = F.concat("label", F.lit(" x"), F.col("n").cast("string"))
    return each.groupBy(key).agg(F.sum("n").alias("n_hits"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("label", item.alias("item")))), lambda s: s["item"]), ", ").alias("summary"))


def gap_regularity(offsets: Column) -> Column:
    """1 - pstdev/mean of the gaps of an ascending array of offsets, within 0 and 1; 0 below four offsets."""

    def of(o: Column) -> Column:
        n = F.size(o) - 1
        mean = (F.element_at(o, -1) - F.element_at(o, 1)) / n

        def spread(m: Column) -> Column:
            var = F.aggregate(F.sequence(F.lit(1), n), F.lit(0.0), lambda a, i: a + (F.get(o, i) - F.get(o, i - 1) - m) * (F.get(o, i) - F.get(o, i - 1) - m)) / n
            return F.when(m > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.sqrt(var) / m))).otherwise(0.0)

        return F.when(F.size(o) >= 4, let(mean, spread)).otherwise(0.0)

    return let(offsets, of)


def hit_gaps(hits: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, n_hits, mean_gap, regularity by a window over the hits of each document in order."""
    w = Window.partitionBy(key).orderBy("offset")
    gaps = hits.select(key, "offset", (F.col("offset") - F.lag("offset").over(w)).alias("gap"))
    stats = gaps.groupBy(key).agg(F.count("*").alias("n_hits"), F.avg("gap").alias("mean_gap"), F.stddev_pop("gap").alias("sd"))
    raw = F.when((F.col("n_hits") >= 4) & (F.col("mean_gap") > 0), F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("sd") / F.col("mean_gap")))).otherwise(0.0)
    return stats.select(key, "n_hits", "mean_gap", raw.alias("regularity"))


WORD_RUN = r"[\p{L}\p{N}_]+"


def homoglyph_array(text: Column) -> Column:
    """array<struct<offset,ch,latin,word>> of look-alikes inside words that have a Latin letter."""
    every = F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+"), F.lit(0))
    placed = F.aggregate(
        every,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<at:int,word:string>>").alias("words")),
        lambda a, w: F.struct(
            (a["at"] + F.length(w)).alias("at"),
            F.when(w.rlike(f"[{cp.LOOK_ALIKES}]") & (F.length(w) >= 2), F.concat(a["words"], F.array(F.struct(a["at"].alias("at"), w.alias("word"))))).otherwise(a["words"]).alias("words"),
        ),
    )["words"]
    latin = F.filter(placed, lambda p: p["word"].rlike(r"[\p{IsLatin}&&\p{L}&&[^\x{FF21}-\x{FF5A}]]"))
    return F.flatten(
        F.transform(
            latin,
            lambda p: F.filter(
                F.transform(F.split(p["word"], ""), lambda c, i: F.struct((p["at"] + i).alias("offset"), c.alias("ch"), F.translate(c, cp.LOOK_ALIKES, cp.LATIN_TWINS).alias("latin"), p["word"].alias("word"))),
                lambda h: h["ch"] != h["latin"],
            ),
        )
    )


def homoglyph_hits(docs: DataFrame, text: str = "text") -> DataFrame:
    """A row for each look-alike letter: the other columns, offset, ch, latin, script, word."""
    keep = [F.col(c) for c in docs.columns if c != text]
    found = docs.where(F.col(text).rlike(f"[{cp.LOOK_ALIKES}]")).select(*keep, F.explode(homoglyph_array(F.col(text))).alias("h"))
    return found.select(*keep, "h.offset", "h.ch", "h.latin", cp.script_of(F.col("h.ch")).alias("script"), "h.word")


def affected_words(hits: DataFrame, key: str = "doc_id", most: int = 12) -> DataFrame:
    """key, n_hits and the first words in order."""
    return hits.groupBy(key).agg(F.count("*").alias("n_hits"), F.array_join(F.slice(F.array_sort(F.collect_set("word")), 1, most), ", ").alias("words"))


def script_profile(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, script, n: letters of each script.  Letters are counted by character before scripts are looked up."""
    letters = docs.select(key, F.explode(F.regexp_extract_all(F.col(text), F.lit(r"\p{L}"), F.lit(0))).alias("ch")).groupBy(key, "ch").agg(F.count("*").alias("n"))
    return letters.groupBy(key, cp.script_of(F.col("ch")).alias("script")).agg(F.sum("n").alias("n"))
