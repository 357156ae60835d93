"""Risk, findings and the written report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rounding import rounded
from ..functions.study import FEATURES
from ..functions.text import preview, unit


def risk_score(watermark: Column, watermark_label: Column, style: Column, style_label: Column) -> Column:
    """One number for triage: the watermark in the main, style as a smaller share, a recovered payload at least 0.9."""
    base = F.when(style_label == "insufficient_text", 0.85 * watermark).otherwise(0.75 * watermark + 0.25 * F.greatest(F.lit(0.0), style - 0.5) * 2)
    return rounded(unit(F.when(watermark_label == "payload_recovered", F.greatest(base, F.lit(0.9))).otherwise(base)), 4)


def risk_label(score: Column) -> Column:
    return F.when(score >= 0.8, "critical").when(score >= 0.6, "high").when(score >= 0.35, "medium").when(score >= 0.15, "low").otherwise("minimal")


def with_risk(docs: DataFrame) -> DataFrame:
    df = docs.withColumn("risk_score", risk_score(F.col("watermark_score"), F.col("watermark_label"), F.col("style_raw"), F.col("style_label")))
    return df.withColumn("risk_label", risk_label(F.col("risk_score")))


FINDING = "struct<id:string,severity:string,title:string,detail:string,recommendation:string>"
#: What to do about each signal.
ADVICE = {
    "invisible_characters": "Strip invisible characters before publishing, and find out whether the source puts them in.",
    "bidi_controls": "Strip the controls and compare: what is shown may not be what is stored.",
    "homoglyph_substitution": "Map the letters back to Latin and compare with the original.",
    "exotic_whitespace": "Replace unusual spaces by plain ones before publishing.",
    "typographic_fingerprint": "For information: typography alone means nothing.",
    "ngram_recycling": "Look for templates behind the repeated phrases.",
    "structural_uniformity": "For information: manuals are laid out like this.",
}


def _finding(name: Column, sev: Column | str, title: Column | str, detail: Column | str, advice: Column | str) -> Column:
    given = {"id": name, "severity": sev, "title": title, "detail": detail, "recommendation": advice}
    return F.struct(*((F.lit(v) if isinstance(v, str) else v).alias(k) for k, v in given.items()))


def findings(docs: DataFrame) -> Column:
    """array of findings (id, severity, title, detail, recommendation) by severity, in the order found among equals."""
    order = {"critical": 0, "high": 1, "medium": 2, "low": 3, "info": 4}
    ranks = F.create_map(*(x for k, v in order.items() for x in (F.lit(k), F.lit(v))))
    advice = F.create_map(*(F.lit(x) for kv in ADVICE.items() for x in kv))
    kind = f"array<{FINDING}>"
    payloads = F.transform("payloads", lambda p: _finding(
        F.concat(F.lit("payload-"), p["channel"]), "critical", F.concat(F.lit("Message hidden in "), F.replace(p["channel"], F.lit("_"), F.lit(" "))),
        F.format_string("%d bytes in %d invisible characters: \"%s\"", p["byte_length"], p["carrier_count"], preview(p["text"], 200)), "Keep the original as evidence; strip the carriers before passing the text on.")).cast(kind)
    shown = F.filter("signals", lambda s: ~s["id"].startswith("payload_") & ~s["severity"].isin("info", "low"))
    others = F.transform(shown, lambda s: _finding(F.concat(F.lit("signal-"), s["id"]), s["severity"], s["title"], s["description"], F.coalesce(F.element_at(advice, s["id"]), F.lit("Look at the evidence.")))).cast(kind)
    label = F.col("style_label")
    band = F.format_string("style score %.2f, band %.2f to %.2f, confidence %s", F.col("style_value"), F.col("style_low"), F.col("style_high"), F.col("style_confidence"))
    review = "Take it as a reason to look, not as proof."
    said = F.filter(F.array(
        F.when(label == "likely_assistant", _finding(F.lit("style-assistant-register"), "medium", "Reads like unedited assistant text", band, review))
        .when(label == "likely_assistant_strong", _finding(F.lit("style-assistant-register"), "high", "Reads like unedited assistant text", band, review))
        .when(label == "likely_human", _finding(F.lit("style-human-register"), "info", "Reads like human text", band, "Nothing to do on this side."))
        .when(label == "insufficient_text", _finding(F.lit("style-insufficient"), "info", "Too little text for a verdict on style", band, "Ask for a longer sample if style matters."))
    ), lambda x: x.isNotNull()).cast(kind)
    keyed = F.transform(F.concat(payloads, others, said), lambda f, i: F.struct(F.element_at(ranks, f["severity"]).alias("r"), i.alias("i"), f.alias("f")))
    return F.transform(F.array_sort(keyed), lambda x: x["f"])


def warnings(n_words: Column, n_scripts: Column, source_format: Column, label: Column) -> Column:
    """What a reader should know before trusting the numbers."""
    return F.filter(F.array(
        F.when(n_words < 40, "fewer than 40 words: the style score is unreliable"),
        F.when(n_scripts > 2, "more than two scripts in one document"),
        F.when(source_format.isin("pdf", "html") & label.isin("clean", "weak_indicators"), "the source format may have lost invisible characters"),
    ), lambda w: w.isNotNull())


def _percent(c: Column) -> Column:
    return F.format_string("%.1f%%", c * 100)


def _table(head: str, rows: Column, none: str) -> Column:
    """A Markdown table of an array of lines, or what to say without any."""
    width = head.count("|") + 1
    top = f"| {head} |\n|{' --- |' * width}"
    return F.when(F.size(rows) > 0, F.concat_ws("\n", F.lit(top), F.array_join(rows, "\n"))).otherwise(F.lit(none))


EVIDENCE_SHOWN, SEGMENTS_SHOWN, PAYLOAD_SHOWN = 10, 40, 2000
LIMITS = (
    "Hidden characters and decoded payloads are facts about the bytes.",
    "Style is a likelihood about register, not authorship; it is unreliable in short, translated or edited text.",
    "A clean result proves nothing: normalising a text removes every channel that is looked for.",
    "A style score alone is no ground for an accusation.",
)


def markdown(docs: DataFrame, key: str = "doc_id") -> Column:
    """The report of an analysed document as Markdown: sizes, verdicts, payloads, signals with evidence, findings, style, profiles, segments, measures, limits."""
    def words(c: Column) -> Column:
        return F.replace(c, F.lit("_"), F.lit(" "))

    def evidence(s: Column) -> Column:
        lines = F.transform(F.slice(s["evidence"], 1, EVIDENCE_SHOWN), lambda e: F.concat(F.lit("- "), e["detail"], F.when(e["offset"].isNotNull(), F.format_string(" (offset %d)", e["offset"])).otherwise("")))
        more = F.when(s["evidence_total"] > EVIDENCE_SHOWN, F.format_string("\n- and %d more", s["evidence_total"] - EVIDENCE_SHOWN)).otherwise("")
        return F.concat(F.format_string("\n### %s\n\n%s\n\n", s["title"], s["description"]), F.array_join(lines, "\n"), more)

    excluded = F.col("n_chars_measured") - F.col("n_chars")
    size = F.format_string("- Size: %d characters, %d words", F.col("n_chars_source"), F.col("n_words_source"))
    size = F.concat(size, F.when(excluded > 0, F.format_string(" (%d characters of fenced blocks left out)", excluded)).otherwise(F.format_string(", %d sentences, %d paragraphs", F.col("n_sentences"), F.col("n_paragraphs"))))
    payloads = F.transform("payloads", lambda p: F.format_string("\n### %s\n\n- %d carriers from offset %d\n- %d bytes\n\n```\n%s\n```", words(p["channel"]), p["carrier_count"], p["first_offset"], p["byte_length"], F.left(p["text"], F.lit(PAYLOAD_SHOWN))))
    signals = F.transform("signals", lambda s: F.format_string("| %s | %s | %s | %s |", s["title"], s["category"], _percent(s["score"]), s["severity"]))
    found = F.transform("findings", lambda f: F.format_string("### [%s] %s\n\n%s\n\nWhat to do: %s\n", F.upper(f["severity"]), f["title"], f["detail"], f["recommendation"]))
    given = F.transform("contributions", lambda c: F.format_string("| %s | %.3f | %+.2f | %+.3f | %s |", c["feature"], c["value"], c["z"], c["contribution"], c["direction"]))
    alike = F.transform("profiles", lambda p: F.format_string("| %s | %s |", words(p["family"]), _percent(p["similarity"])))
    parts = F.transform(F.slice("segments", 1, SEGMENTS_SHOWN), lambda g: F.format_string("| %d | %d-%d | %d | %s | %d |", g["index"], g["start"], g["end"], g["word_count"], _percent(g["llm_likelihood"]), g["watermark_hits"]))
    more = F.size("segments") - SEGMENTS_SHOWN
    measures = [F.format_string(f"| {name} | %.4f |", F.col(name)) for name in FEATURES]
    return F.concat_ws(
        "\n", F.format_string("# Document %s\n", F.col(key).cast("string")), F.format_string("- SHA-256: `%s`", F.col("sha256")), size, F.format_string("- Language: %s", F.col("language")),
        F.format_string("- Risk: %s (%s)", _percent(F.col("risk_score")), F.col("risk_label")),
        F.lit("\n## Verdicts\n\n| Side | Score | Label | Confidence |\n| --- | --- | --- | --- |"),
        F.format_string("| Watermark | %s | %s | %s |", _percent(F.col("watermark_score")), words(F.col("watermark_label")), F.col("watermark_confidence")),
        F.format_string("| Style | %s (%s to %s) | %s | %s |", _percent(F.col("style_value")), _percent(F.col("style_low")), _percent(F.col("style_high")), words(F.col("style_label")), F.col("style_confidence")),
        F.when(F.size("payloads") > 0, F.concat(F.lit("\n## Payloads\n"), F.array_join(payloads, "\n"))),
        F.lit("\n## Signals\n"), _table("Signal | Category | Score | Severity", signals, "None."), F.when(F.size("signals") > 0, F.array_join(F.transform("signals", evidence), "\n")),
        F.lit("\n## Findings\n"), F.when(F.size("findings") > 0, F.array_join(found, "\n")).otherwise(F.lit("None.")),
        F.format_string("\n## Style\n\nModel: `%s`, trained: %s\n", F.col("style_model"), F.when(F.col("style_trained"), "yes").otherwise("no")),
        F.when(F.size("contributions") > 0, _table("Measure | Value | z | Log-odds | Towards", given, "")), F.array_join(F.transform("style_notes", lambda x: F.concat(F.lit("> "), x)), "\n"),
        F.when(F.size("profiles") > 0, F.concat(F.lit("\n## Alike profiles (likeness of register, not authorship)\n\n"), _table("Profile | Likeness", alike, ""))),
        F.lit("\n## Segments\n"), _table("# | Range | Words | Style | Hits", parts, "The text is too short."), F.when(more > 0, F.format_string("| ... | %d more | | | |", more)),
        F.lit("\n## Measures\n\n| Measure | Value |\n| --- | --- |"), *measures, F.lit("\n## Limits\n\n" + "\n".join(f"- {x}" for x in LIMITS)),
        F.when(F.size("warnings") > 0, F.concat(F.lit("\n## Warnings\n\n"), F.array_join(F.transform("warnings", lambda w: F.concat(F.lit("- "), w)), "\n"))),
    )
