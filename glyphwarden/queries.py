"""One query for each operator, over whole tables.

The documents hold no carriers, so `carried` puts them in by id, a different kind for each
remainder of eight; the analyses tables are made from documents and events by fixed rules.
Both are done the same way in oracle.py.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import codepoints as cp
from .functions import spans
from .functions import text as tx
from .operators import features, marking, payloads, provenance, report, sanitize, scan, segments, signals, style, training
from .plans import analytics, service, store
from .plans.analysis import analyse, analyse_distinct
from .sources import extract, samples

HOUR = 3_600_000
START = 1_700_000_000_000


def load(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A small table in fewer splits than there are cores is dealt out; a large one has splits enough and is left alone."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


def docs(spark: SparkSession, d: str) -> DataFrame:
    return spread(load(spark, d, "documents").select("doc_id", "text"))


def carried_text(i: Column, t: Column) -> Column:
    name = i.cast("string")
    kind = i % 8
    return (
        F.when(kind == 0, F.concat(t, payloads.encode("tag_characters", F.concat(F.lit("WF-"), name))))
        .when(kind == 1, F.concat(t, payloads.encode("variation_selectors", F.concat(F.lit("id:"), name))))
        .when(kind == 2, F.concat(t, payloads.encode("zero_width_binary", F.concat(F.lit("key "), name, F.lit("x")))))
        .when(kind == 3, F.replace(t, F.lit(". "), F.lit(".\u200b ")))
        .when(kind == 4, F.translate(t, "eoa", "\u0435\u043e\u0430"))
        .when(kind == 5, F.concat(F.lit("\u202e"), t, F.lit("\u202c")))
        .when(kind == 6, F.replace(t, F.lit(", "), F.lit(",\u00a0 ")))
        .otherwise(t)
    )


def carried(spark: SparkSession, d: str) -> DataFrame:
    """let() keeps the long expression above from being folded into every use."""
    return docs(spark, d).select("doc_id", tx.let(F.struct("doc_id", "text"), lambda x: carried_text(x["doc_id"], x["text"])).alias("text"))


def analyses(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    status = F.when(i % 10 == 6, "pending").when(i % 10 == 7, "running").when(i % 10 == 8, "error").otherwise("done")
    made = START + i * HOUR
    return load(spark, d, "documents").select(
        F.concat(F.lit("a"), F.lpad(i.cast("string"), 10, "0")).alias("id"), F.concat(F.lit("w"), (i % 7).cast("string")).alias("workspace_id"),
        status.alias("status"), F.when(i % 3 == 0, "quick").otherwise("forensic").alias("mode"), F.when(i % 4 == 0, "file").otherwise("text").alias("source"),
        F.sha2("text", 256).alias("text_sha256"), F.length("text").cast("int").alias("char_count"), (i % 5).cast("int").alias("attempts"),
        F.when(i % 10 == 8, F.concat(F.lit("engine error "), i.cast("string"))).alias("error"), made.alias("created_at"),
        F.when(i % 10 != 6, made + 1000).alias("started_at"), F.when(~(i % 10).isin(6, 7), made + 5000).alias("completed_at"),
    )


def metrics(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    label = F.when(i % 4 == 0, "payload_recovered").when(i % 4 == 1, "watermark_suspected").otherwise("clean")
    return load(spark, d, "documents").where(~(i % 10).isin(6, 7, 8)).select(
        F.concat(F.lit("a"), F.lpad(i.cast("string"), 10, "0")).alias("analysis_id"), ((i * 37) % 1000 / 1000.0).alias("risk_score"), label.alias("watermark_label"),
        (i % 4 == 0).cast("int").alias("payload_count"), F.col("lang").alias("language"), (START + i * HOUR + 5000).alias("created_at"),
    )


def job_events(spark: SparkSession, d: str) -> DataFrame:
    """The events table as the log of analyses; an event belongs to the document of its number."""
    e = load(spark, d, "events")
    return e.select(F.col("event_id").alias("id"), F.concat(F.lit("a"), F.lpad((F.col("event_id") % 500).cast("string"), 10, "0")).alias("analysis_id"), F.col("event_type").alias("type"), F.unix_millis(F.col("ts").cast("timestamp")).alias("created_at"))


def scored_windows(spark: SparkSession, d: str) -> DataFrame:
    """Fixed segments of 400 characters every 300 with a made-up score, for the interval joins."""
    n = F.length("text")
    s = F.explode(F.sequence(F.lit(0), F.greatest(F.floor((n - 1) / 300), F.lit(0)).cast("int"))).alias("idx")
    rows = docs(spark, d).select("doc_id", n.alias("n"), s)
    return rows.select("doc_id", "n", "idx", (F.col("idx") * 300).alias("start_offset"), F.least(F.col("idx") * 300 + 400, F.col("n")).alias("end_offset"), ((F.col("doc_id") * 7 + F.col("idx") * 13) % 100 / 100.0).alias("llm_likelihood"), (F.col("idx") % 60).alias("word_count"))


def payload_decode(kind: int, decode):
    def run(spark: SparkSession, d: str) -> DataFrame:
        p = carried(spark, d).where(F.col("doc_id") % 8 == kind).select("doc_id", decode(F.col("text")).alias("p"))
        return p.select("doc_id", F.col("p.text").alias("payload"), F.col("p.byte_length").alias("byte_length"), F.col("p.n_carriers").alias("n_carriers"))

    return run


def payload_decode_all(decode):
    """Every document, whatever it carries; nulls where this decoder finds nothing."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        p = carried(spark, d).select("doc_id", decode(F.col("text")).alias("p"))
        return p.select("doc_id", F.col("p.text").alias("payload"), F.col("p.byte_length").alias("byte_length"), F.col("p.n_carriers").alias("n_carriers"))

    return run


def q_char_scan(s, d):
    return scan.char_hits(carried(s, d)).select("doc_id", "offset", "codepoint", "category", "name")


def q_char_context(s, d):
    return scan.char_hits(carried(s, d), with_context=True).where("category = 'zero_width'").select("doc_id", "offset", "context")


def q_hits_by_name(s, d):
    return scan.hits_by_name(scan.char_hits(carried(s, d)))


def q_gap_regularity(s, d):
    g = scan.hit_gaps(scan.char_hits(carried(s, d)))
    return g.select("doc_id", "n_hits", F.round("mean_gap", 6).alias("mean_gap"), F.round("regularity", 6).alias("regularity"))


def q_homoglyphs(s, d):
    return scan.homoglyph_hits(carried(s, d)).select("doc_id", "offset", "ch", "latin", "script", "word")


def q_homoglyph_words(s, d):
    return scan.affected_words(scan.homoglyph_hits(carried(s, d)))


def q_script_profile(s, d):
    return scan.script_profile(carried(s, d))


def q_strip_invisible(s, d):
    t = tx.strip_invisible(F.col("text"))
    return carried(s, d).select("doc_id", F.length(t).alias("n_chars"), F.sha2(t, 256).alias("sha256"))


def q_normalize(s, d):
    return carried(s, d).select("doc_id", F.sha2(tx.normalize_whitespace(F.col("text")), 256).alias("sha256"))


def q_clean(s, d):
    decomposed = F.replace(F.col("text"), F.lit("\u00e9"), F.lit("e\u0301"))
    return carried(s, d).select("doc_id", F.sha2(tx.clean(decomposed), 256).alias("sha256"))


def q_sanitize(level):
    def run(s, d):
        t = sanitize.sanitized(F.col("text"), level)
        return carried(s, d).select("doc_id", F.length(t).alias("n_chars"), F.sha2(t, 256).alias("sha256"))

    return run


def q_sanitize_audit(s, d):
    return sanitize.audit(carried(s, d)).groupBy("doc_id", "decision").agg(F.count("*").alias("n"), F.min("offset").alias("first_offset"))


def q_latinize(s, d):
    return carried(s, d).select("doc_id", F.sha2(sanitize.latinized(F.col("text")), 256).alias("sha256"))


RECIPIENTS = ["ann", "bob", "cho"]


def q_mark(s, d):
    m = marking.mark_copies(docs(s, d), RECIPIENTS, "WF-{index:03d}")
    return m.select("doc_id", "recipient", "payload", "carrier_chars", "verified", F.sha2("text", 256).alias("sha256"))


def q_trace(s, d):
    m = marking.mark_copies(docs(s, d), RECIPIENTS, "{recipient}#{index}")
    leaked = m.where((F.col("doc_id") % 3 == 0) & (F.col("recipient") == "bob")).select("doc_id", "text")
    return marking.trace(leaked, m.select("payload", "recipient")).select("doc_id", "payload", "recipient")


def q_trace_all(s, d):
    m = marking.mark_copies(docs(s, d), RECIPIENTS, "{recipient}#{index}")
    return marking.trace(m.select("doc_id", "text"), m.select("payload", "recipient")).select("doc_id", "payload", "recipient")


def q_signals(s, d):
    # not explode(): for it Spark infers a filter on the whole signals expression and pushes that below every step
    x = signals.signals(carried(s, d)).select("doc_id", F.explode_outer("signals").alias("g")).select("doc_id", "g.*")
    return x.where("id is not null").select("doc_id", "id", F.round("score", 6).alias("score"), "weight", "severity")


def q_watermark(s, d):
    return signals.watermark(signals.signals(carried(s, d))).select("doc_id", "watermark_score", "watermark_label", "watermark_confidence", "watermark_basis")


def q_language(s, d):
    return features.detect_language(docs(s, d)).select("doc_id", "language", "language_confidence")


def q_language_confusion(s, d):
    x = features.detect_language(load(s, d, "documents").select("doc_id", "lang", "text"))
    return x.groupBy("lang", "language").agg(F.count("*").alias("n"))


def _tokens(s, d) -> DataFrame:
    return docs(s, d).select("doc_id", F.transform(tx.words(F.col("text")), F.lower).alias("tok"))


def q_word_counts(s, d):
    return _tokens(s, d).select("doc_id", F.explode("tok").alias("token")).groupBy("doc_id", "token").agg(F.count("*").alias("n"))


def q_hapax(s, d):
    x = q_word_counts(s, d).groupBy("doc_id").agg(F.count("*").alias("types"), F.sum(F.when(F.col("n") == 1, 1).otherwise(0)).alias("hapax"))
    return x.select("doc_id", "types", "hapax", F.round(F.col("hapax") / F.col("types"), 6).alias("ratio"))


def q_mattr(s, d):
    return _tokens(s, d).select("doc_id", F.round(features.moving_types(F.col("tok")), 6).alias("mattr"))


def _grams(s, d) -> DataFrame:
    x = _tokens(s, d).select("doc_id", F.posexplode(features.repeated_grams(F.col("tok"))).alias("pos", "gram"))
    return x.groupBy("doc_id", "gram").agg(F.count("*").alias("n"), F.min("pos").alias("first_pos")).where("n > 1")


def q_ngram_top(s, d):
    from pyspark.sql import Window

    w = Window.partitionBy("doc_id").orderBy(F.desc("n"), "first_pos")
    return _grams(s, d).withColumn("rank", F.row_number().over(w)).where("rank <= 8").select("doc_id", "rank", "gram", "n")


def q_ngram_recycling(s, d):
    total = _tokens(s, d).select("doc_id", (F.size("tok") - 4).alias("total"))
    x = _grams(s, d).groupBy("doc_id").agg(F.count("*").alias("distinct_repeated"), F.sum("n").alias("repeated")).join(total, "doc_id")
    return x.select("doc_id", "distinct_repeated", "repeated", F.round(F.col("repeated") / F.col("total"), 6).alias("rate"))


def q_lexicons(s, d):
    from .functions import lexicons as lex

    x = _tokens(s, d)
    return x.select("doc_id", tx.in_list(F.col("tok"), lex.FIRST_PERSON["en"]).alias("pronouns"), tx.in_list(F.col("tok"), lex.STOPWORDS["en"]).alias("stopwords_en"), tx.in_list(F.col("tok"), lex.STOPWORDS["fr"]).alias("stopwords_fr"), tx.in_list(F.col("tok"), lex.CONTRACTIONS).alias("contractions"))


def q_typos(s, d):
    t = F.col("text")
    return docs(s, d).select("doc_id", tx.matches(t, features.DOUBLE_SPACE).alias("double_space"), tx.matches(t, features.REPEATED).alias("repeated"), tx.matches(F.lower(t), features.MISSING_SPACE).alias("missing_space"))


def q_punctuation(s, d):
    t = F.col("text")
    return docs(s, d).select("doc_id", tx.occurrences(t, ",").alias("commas"), tx.occurrences(t, "!").alias("exclamations"), tx.occurrences(t, "—").alias("em_dashes"), tx.matches(t, "[\"']").alias("straight_quotes"), tx.estimate_tokens(t).alias("token_estimate"))


def q_lines(s, d):
    t = F.col("text")
    return docs(s, d).select("doc_id", F.size(features.filled_lines(t)).alias("filled_lines"), tx.matches(t, r"(?m)^[ \t]*(?:[-*•‣·]|\d+[.)]|[a-z][.)])[ \t]+").alias("bullets"))


def q_sentences(s, d):
    return docs(s, d).select("doc_id", F.posexplode(spans.sentence_spans(F.col("text"))).alias("idx", "x")).select("doc_id", "idx", F.col("x.start").alias("start"), F.col("x.end").alias("end"), F.col("x.n_words").alias("n_words"))


def q_paragraphs(s, d):
    return docs(s, d).select("doc_id", F.posexplode(spans.paragraph_spans(F.regexp_replace("text", "\n", "\n\n"))).alias("idx", "x")).select("doc_id", "idx", F.col("x.text").alias("paragraph"))


def q_windows(s, d):
    return segments.window_rows(docs(s, d)).select("doc_id", "idx", "start_offset", "end_offset", "n_words")


def measured(s, d) -> DataFrame:
    """The cleaned documents with their measures and the layout traits of profiles."""
    cleaned = docs(s, d).select("doc_id", spans.cleaned(F.col("text")).alias("text"))
    return features.with_layout(features.measure(cleaned)).drop("text")


def q_features(s, d):
    return measured(s, d).drop("language_confidence", "bold_run_rate", "opening_pleasantry")


def q_style(s, d):
    return style.style_score(measured(s, d)).select("doc_id", "style_value", "style_low", "style_high", "style_label", "style_confidence")


def q_contributions(s, d):
    return style.contributions(measured(s, d))


def q_profiles(s, d):
    return style.profiles(measured(s, d))


def q_segments(s, d):
    c = features.detect_language(carried(s, d))
    return segments.segments(c).drop("preview")


def q_segment_hits(s, d):
    hits = scan.char_hits(carried(s, d)).select("doc_id", "offset")
    return segments.count_hits(scored_windows(s, d), hits).select("doc_id", "idx", "watermark_hits")


def q_fragments(s, d):
    lengths = docs(s, d).select("doc_id", F.length("text").alias("n"))
    f = segments.fragments(scored_windows(s, d), lengths)
    return f.select("doc_id", "start", "end", F.round("score", 6).alias("score"), "n_segments")


def q_mean_score(s, d):
    m = segments.weighted_mean(scored_windows(s, d))
    return m.select("doc_id", "n_segments", F.round("mean_score", 6).alias("mean_score"))


def q_carrier_offsets(s, d):
    h = scan.char_hits(carried(s, d)).select("doc_id", "offset", F.lit(2).alias("length"))
    return segments.carrier_offsets(h)


def q_analyse(s, d):
    r = analyse(carried(s, d))
    return r.select("doc_id", "watermark_label", "style_label", "language", "n_words", "risk_score", "risk_label", F.size("findings").alias("n_findings"))


def q_analyse_distinct(s, d):
    return analyse_distinct(docs(s, d)).select("doc_id", "sha256", "risk_score", "style_label")


def q_report(s, d):
    return analyse(carried(s, d)).select("doc_id", F.length("report").alias("report_chars"), "report")


def q_risk(s, d):
    x = metrics(s, d).select("analysis_id", "watermark_label", (F.col("risk_score") * 0.9871234).alias("w"), (F.round(F.col("risk_score") * 1000).cast("int") % 97 / 96.0).alias("v"))
    x = x.withColumn("style_label", F.when(F.col("v") < 0.1, "insufficient_text").otherwise("inconclusive"))
    r = report.risk_score(F.col("w"), F.col("watermark_label"), F.col("v"), F.col("style_label"))
    return x.select("analysis_id", r.alias("risk_score"), report.risk_label(r).alias("risk_label"))


def q_list_page(s, d):
    return analytics.list_page(analytics.summaries(analyses(s, d), metrics(s, d)), "w3", 20, 20).select("id", "status", "risk_score", "watermark_label", "created_at")


def q_status(s, d):
    return analytics.status_counts(analyses(s, d).where("workspace_id = 'w2'"))


def q_headline(s, d):
    return analytics.headline(analyses(s, d), metrics(s, d), "w1")


def q_daily(s, d):
    return analytics.daily(analyses(s, d), START + 150 * HOUR)


def q_dedup(s, d):
    return analytics.newest_done(analyses(s, d)).select("workspace_id", "text_sha256", "mode", "id")


def q_reused(s, d):
    new = analyses(s, d).where("status = 'pending'").withColumn("workspace_id", F.lit("w1"))
    return analytics.split_submissions(new, analyses(s, d))[0].select("id", "reused_id")


def q_to_run(s, d):
    new = analyses(s, d).where("status = 'pending'").withColumn("workspace_id", F.lit("w1"))
    return analytics.split_submissions(new, analyses(s, d))[1].select("id", "mode")


def q_stalled(s, d):
    return analytics.stalled(analyses(s, d), START + 400 * HOUR).select("id", "status", "attempts", "created_at")


def q_exhausted(s, d):
    return analytics.exhausted(analyses(s, d)).select("id", "status", "attempts", "created_at")


def q_trail(s, d):
    return analytics.event_trail(job_events(s, d)).select("analysis_id", "id", "step", "since_ms")


def q_errors(s, d):
    return analytics.recent_errors(job_events(s, d), analyses(s, d)).select("id", "analysis_id", "type", "error")


def q_riskiest(s, d):
    return analytics.riskiest(analytics.summaries(analyses(s, d), metrics(s, d)), 15).select("id", "risk_score")


def q_riskiest_segments(s, d):
    w = scored_windows(s, d).withColumn("key", F.concat_ws("/", F.lpad(F.col("doc_id").cast("string"), 12, "0"), F.lpad(F.col("idx").cast("string"), 6, "0")))
    return analytics.riskiest(w, 25, "llm_likelihood", "key").select("doc_id", "idx", "llm_likelihood")


def q_rate_windows(s, d):
    e = load(s, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    return analytics.rate_windows(e, "user_id", "ts", 3600, 2)


def q_daily_limit(s, d):
    e = load(s, d, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    return analytics.with_quota(e, "user_id", "ts", "event_id", 86400, 5).select("event_id", "window_start", "remaining", "allowed")


def q_upsert(s, d):
    old = metrics(s, d)
    new = old.where(F.substring("analysis_id", -1, 1) == "4").withColumns({"risk_score": F.lit(0.5), "created_at": F.lit(0).cast("long")})
    return store.upsert(old, new, ["analysis_id"], keep=["created_at"]).select("analysis_id", "risk_score", "created_at")


def q_touch(s, d):
    a = analyses(s, d).where("status = 'done'")
    old = a.groupBy(F.col("workspace_id").alias("id")).agg(F.min("created_at").alias("created_at"), F.min("created_at").alias("last_seen_at"))
    return store.touch_workspaces(old, analyses(s, d).select(F.col("workspace_id").alias("id"), F.col("created_at").alias("at")))


def q_replace_segments(s, d):
    w = scored_windows(s, d).select("doc_id", "idx", "llm_likelihood")
    new = w.where("doc_id % 5 = 0 and idx < 2").withColumn("llm_likelihood", F.lit(0.25))
    return store.replace_group(w, new, "doc_id").groupBy("doc_id").agg(F.count("*").alias("n"), F.round(F.sum("llm_likelihood"), 6).alias("total"))


def q_delete(s, d):
    left = store.delete_cascade({"analyses": analyses(s, d), "analysis_metrics": metrics(s, d)}, analyses(s, d).where("workspace_id = 'w5'").select("id"))
    a = left["analyses"].agg(F.count("*").alias("n")).select(F.lit("analyses").alias("name"), "n")
    return a.unionByName(left["analysis_metrics"].agg(F.count("*").alias("n")).select(F.lit("analysis_metrics").alias("name"), "n"))


def q_transition(s, d):
    a = analyses(s, d)
    c = a.where("status in ('pending', 'running')").select("id", F.when(F.col("status") == "pending", "running").otherwise("error").alias("to"), (F.col("created_at") + 9000).alias("at"), F.lit("timed out").alias("error"))
    return store.transition(a, c).select("id", "status", "attempts", "started_at", "completed_at", "error")


def q_latest(s, d):
    return store.latest(job_events(s, d), ["analysis_id"], ["created_at", "id"]).select("analysis_id", "id", "type")


def q_reports(s, d):
    r = analyses(s, d).where("status in ('done', 'error')").select(F.concat(F.lit("r"), "id").alias("id"), F.col("id").alias("analysis_id"), F.concat(F.lit("Report "), "id").alias("title"))
    return analytics.report_documents(r, analyses(s, d), metrics(s, d)).select("id", "status", "risk_score", "watermark_label")


def q_validate(s, d):
    x = docs(s, d).select("doc_id", F.when(F.col("doc_id") % 11 == 0, "  ").otherwise(F.col("text")).alias("text"), F.when(F.col("doc_id") % 13 == 0, "slow").otherwise("quick").alias("mode"))
    return analytics.validated(x, most=5000).select("doc_id", "refused")


def q_html(s, d):
    return load(s, d, "pages").select("page_id", extract.html_udf(F.col("html")).alias("text"))


def q_json(s, d):
    return load(s, d, "events").where("props is not null").select("event_id", extract.json_udf(F.to_json(F.struct(F.col("event_type").alias("a"), F.struct(F.col("props").alias("c")).alias("b")))).alias("text"))


def q_conversations(s, d):
    c = load(s, d, "conversations")
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    return c.groupBy("conv_id").agg(turns.alias("t")).select("conv_id", F.size("t").alias("n_turns"), F.array_join(F.transform("t", lambda x: F.concat_ws(": ", x["role"], x["text"])), "\n").alias("text"))


def _labelled(s, d) -> DataFrame:
    lab = load(s, d, "labels").select("doc_id", F.col("quality").cast("double").alias("label"))
    return features.measure(docs(s, d).join(lab, "doc_id")).drop("text")


def q_train(s, d):
    rows = _labelled(s, d)
    return training.predict(training.train(rows, least=20), rows).select("doc_id", "label", "style_probability")


def q_cv(s, d):
    return training.cross_validated(_labelled(s, d))


# -- look-ups, checks, sweeps and what surrounds an analysis ------------------------------------------------------


def q_manifests(s, d):
    """Manifests made from documents: a third without, one in seven unreadable, actions and sources by id."""
    i = F.col("doc_id")
    source = F.when(i % 3 == 0, "http://cv.iptc.org/newscodes/digitalsourcetype/trainedAlgorithmicMedia").when(i % 3 == 1, "http://cv.iptc.org/newscodes/digitalsourcetype/digitalCapture")
    action = F.struct(F.lit("c2pa.created").alias("action"), source.alias("digitalSourceType"))
    edited = F.struct(F.lit("c2pa.edited").alias("action"), F.lit(None).cast("string").alias("digitalSourceType"))
    label = F.when(i % 5 == 0, "stds.exif").otherwise("c2pa.actions.v2")
    one = F.struct(
        F.concat(F.lit("title "), i.cast("string")).alias("title"), F.array(F.struct(F.col("source").alias("name"))).alias("claim_generator_info"), F.struct(F.col("lang").alias("common_name"), F.lit("CA").alias("issuer"), F.lit("es256").alias("alg")).alias("signature_info"),
        F.array(F.struct(F.lit("stds.schema-org").alias("label"), F.struct(F.array(edited).alias("actions")).alias("data")), F.struct(label.alias("label"), F.struct(F.array(action, edited).alias("actions")).alias("data"))).alias("assertions"),
    )
    made = F.to_json(F.struct(F.lit("urn:1").alias("active_manifest"), F.create_map(F.lit("urn:1"), one).alias("manifests")))
    state = F.when(i % 4 == 0, "Trusted").when(i % 4 == 1, "Valid").when(i % 4 == 2, "Invalid")
    failures = F.when(i % 4 == 2, F.lit('{"activeManifest": {"failure": [{"code": "assertion.hashedURI.mismatch"}]}}'))
    files = load(s, d, "documents").select("doc_id", F.when(i % 9 < 3, F.lit(None)).when(i % 7 == 0, F.lit("not json")).otherwise(made).alias("manifest"), state.alias("state"), failures.alias("results"))
    r = provenance.inspect(files)
    return r.select("doc_id", "present", "integrity", "trust", "raw_state", "generator", "signer", "issuer", "algorithm", "title", "ai_declared", F.array_join("actions", ",").alias("actions"), F.array_join("failures", ",").alias("failures"), F.size("notes").alias("n_notes"), "reason")


def q_trust_anchors(s, d):
    pem = F.repeat(F.lit("-----BEGIN CERTIFICATE-----\nMII\n-----END CERTIFICATE-----\n"), (F.col("doc_id") % 5).cast("int"))
    return load(s, d, "documents").select("doc_id", provenance.trust_anchors(pem).alias("n"))


def q_feature_values(s, d):
    return features.unpivoted(measured(s, d))


def q_marked_pieces(s, d):
    c = carried(s, d)
    pieces = segments.marked_characters(c, scan.char_hits(c).select("doc_id", F.col("offset").alias("at")))
    return pieces.groupBy("doc_id").agg(F.count("*").alias("pieces"), F.sum(F.col("marked").cast("int")).alias("marked"), F.sum("length").alias("chars"))


def q_page_total(s, d):
    return service.page_total(analyses(s, d), "w3", "done")


def q_day_bars(s, d):
    return service.scaled(analytics.daily(analyses(s, d), START + 150 * HOUR))


def q_summary_page(s, d):
    rows = service.to_summary(service.summary_rows(analyses(s, d), metrics(s, d)).where("workspace_id = 'w2'"))
    return rows.select("id", "status", "submitted_at", "finished_at", "title", "risk", "verdict")


def q_lookup(s, d):
    return service.one(analyses(s, d), "a0000000010", "w3").select("id", "workspace_id", "status", "text_sha256")


def blobs(s, d) -> DataFrame:
    """Uploads as the object store names them."""
    i = F.col("doc_id")
    kinds = ["notes.TXT", "pa/ge.html", "scan.pdf", "archive.zip", "no extension", " table.csv", "\u0001odd.json", ""]
    name = F.element_at(F.array(*(F.lit(k) for k in kinds)), (i % 8 + 1).cast("int"))
    return load(s, d, "documents").select("doc_id", F.concat(F.lit("uploads/w"), (i % 7).cast("string"), F.lit("/"), F.lpad(i.cast("string"), 8, "0")).alias("path"), name.alias("name"), F.when(i % 12 == 5, 0).otherwise(F.octet_length("text")).cast("long").alias("size"))


def q_prefix(s, d):
    return extract.has_prefix(blobs(s, d), "uploads/w3/").select("path")


def q_uploads(s, d):
    return extract.validated_uploads(blobs(s, d), most=9000).select("doc_id", "clean_name", "extension", "refused")


def q_result_cache(s, d):
    i = F.col("doc_id")
    kept = load(s, d, "documents").select(i.alias("id"), F.concat(F.lit('{"stored": '), i.cast("string"), F.lit("}")).alias("result"))
    fresh = load(s, d, "documents").where("doc_id % 2 = 0").select(
        i.alias("id"), F.when(i % 6 == 0, "{broken").when(i % 10 == 0, F.concat(F.lit('"'), F.repeat(F.lit("x"), 1_000_000), F.lit('"'))).otherwise(F.concat(F.lit('{"cached": '), i.cast("string"), F.lit("}"))).alias("result"),
        (START - (i % 9) * 600_000).alias("cached_at"),
    )
    return service.read_through(kept, fresh, START)


def q_markers(s, d):
    return docs(s, d).select("doc_id", F.sha2(samples.with_markers(F.col("text")), 256).alias("sha256"))


def mark_requests(s, d) -> DataFrame:
    i = F.col("doc_id")
    who = F.when(i % 6 == 0, F.array().cast("array<string>")).when(i % 6 == 1, F.array(F.lit("a"), F.lit(" "))).when(i % 6 == 2, F.array(F.lit("a"), F.lit("b"), F.lit("a"))).otherwise(F.transform(F.sequence(F.lit(1), (i % 120 + 1).cast("int")), lambda k: F.concat(F.lit("r"), k.cast("string"))))
    return load(s, d, "documents").select("doc_id", who.alias("who"), F.repeat(F.lit("x"), (i % 140).cast("int")).alias("template"), F.when(i % 5 == 0, "smoke").otherwise("tag_characters").alias("channel"), (i % 25).cast("int").alias("repeat"))


def q_mark_requests(s, d):
    return mark_requests(s, d).select("doc_id", marking.request_refusal(F.col("who"), F.col("template"), F.col("channel"), F.col("repeat")).alias("refused"))


def q_recipients(s, d):
    names = marking.parse_recipients(F.concat(F.col("source"), F.lit(", "), F.col("lang"), F.lit("\n\n ,"), F.when(F.col("doc_id") % 2 == 0, F.col("lang")).otherwise("z"), F.lit(" ")))
    x = load(s, d, "documents").select("doc_id", names.alias("names"))
    return x.select("doc_id", F.array_join("names", "|").alias("names"), marking.has_duplicates(F.col("names")).alias("twice"))


def q_copies(s, d):
    return marking.distinct_copies(marking.mark_copies(docs(s, d), RECIPIENTS, "WF-{index:03d}"))


def busy(s, d) -> DataFrame:
    """The job table with more attempts spent."""
    return analyses(s, d).withColumn("attempts", (F.col("attempts") + F.col("char_count") % 3).cast("int"))


def q_sweep(s, d):
    return service.sweep(busy(s, d), START + 400 * HOUR, 90_000)


def q_refused(s, d):
    a = analyses(s, d)
    wanted = F.element_at(F.array(*(F.lit(x) for x in store.STATUSES)), (F.col("char_count") % 4 + 1).cast("int"))
    return store.refused(a, a.select("id", wanted.alias("to")).unionByName(s.createDataFrame([("nobody", "done")], "id string, to string")))


def q_failures(s, d):
    x = busy(s, d).where("status = 'running'").withColumn("message", F.concat(F.lit("timeout "), F.col("id")))
    return service.after_failure(x).select("id", "to", "event", "detail")


def q_retries(s, d):
    codes = F.element_at(F.array(*(F.lit(c) for c in (200, 400, 404, 408, 429, 500, 503, 504))), (F.col("event_id") % 8 + 1).cast("int"))
    x = load(s, d, "events").select("event_id", codes.alias("status"), (F.col("event_id") % 4).cast("int").alias("attempt"))
    return service.retry_plan(x)


def q_poll(s, d):
    return s.createDataFrame([(i, t) for i, t in enumerate(service.poll_times())], "step int, at_ms int")


def q_insert(s, d):
    a = analyses(s, d).select("id", "workspace_id", "status", "created_at")
    old, new = a.where("status = 'done'"), a.withColumn("status", F.lit("pending"))
    return store.insert(old, new.unionByName(new.where("workspace_id = 'w1'")))


def q_delete_all(s, d):
    a = analyses(s, d)
    segs = scored_windows(s, d).select(F.concat(F.lit("a"), F.lpad(F.col("doc_id").cast("string"), 10, "0")).alias("analysis_id"), "idx")
    reports = a.where("status = 'done'").select(F.concat(F.lit("r"), "id").alias("id"), F.col("id").alias("analysis_id"))
    left = store.delete_cascade({"analyses": a, "analysis_metrics": metrics(s, d), "analysis_segments": segs, "reports": reports}, a.where("workspace_id = 'w5'").select("id"))
    out = None
    for name, t in left.items():
        n = t.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = n if out is None else out.unionByName(n)
    return out


def q_event_log(s, d):
    x = docs(s, d).select("doc_id", store.event_row(F.lit("analysis.completed"), F.col("text"), START + F.col("doc_id")).alias("e"))
    return x.select("doc_id", "e.type", F.length("e.detail").alias("detail_chars"), "e.created_at")


def q_report_checks(s, d):
    i = F.col("doc_id")
    x = docs(s, d).select("doc_id", F.left("text", (i % 260).cast("int")).alias("title"), F.col("text").alias("notes"), F.when(i % 9 == 0, "Bad Id").when(i % 10 != 3, F.concat(F.lit("a"), i.cast("string"))).alias("analysis_id"))
    return analytics.validated_reports(x).select("doc_id", "refused")


def q_blend(s, d):
    x = style.style_score(measured(s, d)).withColumn("signal", F.when(F.col("doc_id") % 3 > 0, (F.col("doc_id") % 11) / 10.0))
    return style.blended(x, "signal").select("doc_id", "style_value", "style_low", "style_high")


def q_surprisal(s, d):
    v = F.transform(F.sequence(F.lit(1), (F.col("doc_id") % 40 + 1).cast("int")), lambda k: 2.0 + (k * 7 + F.col("doc_id")) % 13 / 4.0)
    x = load(s, d, "documents").select("doc_id", style.surprisal_summary(v).alias("p"))
    return x.select("doc_id", "p.available", F.round("p.mean", 3).alias("mean"), F.round("p.cv", 3).alias("cv"), F.round("p.signal", 3).alias("signal"))


def q_heat(s, d):
    return scored_windows(s, d).select("doc_id", "idx", service.heat_alpha(F.col("llm_likelihood")).alias("alpha"), service.clamped(F.col("end_offset"), 1000).alias("shown"))


def q_warnings(s, d):
    c = carried(s, d).withColumn("format", F.when(F.col("doc_id") % 3 == 0, "PDF").when(F.col("doc_id") % 3 == 1, "docx"))
    r = analyse(c, source_format="format").select("doc_id", F.explode_outer("warnings").alias("w"))
    return r.groupBy("doc_id").agg(F.coalesce(F.max(F.col("w").contains("40 words")), F.lit(False)).alias("short"), F.coalesce(F.max(F.col("w").contains("format")), F.lit(False)).alias("lossy"))


def q_evidence(s, d):
    x = signals.signals(carried(s, d)).select("doc_id", F.explode_outer("signals").alias("g")).where("g.id is not null")
    return x.where("g.category <> 'stylistic'").select("doc_id", F.col("g.id").alias("id"), F.size("g.evidence").alias("shown"), F.col("g.evidence_total").alias("total"), F.get(F.filter("g.evidence", lambda e: e["offset"].isNotNull()), F.lit(0))["offset"].alias("first_offset"))


def q_payload_spans(s, d):
    p = signals.signals(carried(s, d)).select("doc_id", F.explode_outer("payloads").alias("p")).where("p.channel is not null")
    return p.select("doc_id", "p.channel", "p.text", "p.carrier_count", "p.first_offset", "p.last_offset")


def q_sanitize_reasons(s, d):
    return sanitize.audit(carried(s, d)).groupBy("doc_id", "decision", "reason").agg(F.count("*").alias("n"))


def q_sanitize_warnings(s, d):
    return sanitize.warnings(carried(s, d)).select("doc_id", F.size("warnings").alias("n"), F.array_join("warnings", "; ").alias("said"))


def q_context_all(s, d):
    return scan.char_hits(carried(s, d), with_context=True).select("doc_id", "offset", "category", "context")


def q_typos_all(s, d):
    return docs(s, d).select("doc_id", features.typo_hits(F.col("text"), F.lower("text")).alias("slips"), tx.matches(F.col("text"), features.SPACE_BEFORE).alias("space_before"))


def q_layout(s, d):
    t = F.col("text")
    return docs(s, d).select("doc_id", tx.matches(t, r"(?m)^\s*(#{1,6}\s+\S|\*\*[^*\n]+\*\*\s*$)").alias("headings"), tx.matches(t, r"\*\*[^*\n]+\*\*").alias("bold"), tx.matches(t, r"\S+").alias("tokens"), tx.preview(t, 60).alias("preview"))


def q_reused_own(s, d):
    a = analyses(s, d)
    new = a.where("status = 'done'").withColumn("id", F.concat(F.lit("n"), "id"))
    return analytics.split_submissions(new, a)[0].select("id", "reused_id")


def q_exhausted_two(s, d):
    return analytics.exhausted(busy(s, d), most_attempts=2, limit=40).select("id", "status", "attempts", "created_at")


def q_validate_default(s, d):
    x = docs(s, d).select("doc_id", F.when(F.col("doc_id") % 17 == 0, F.repeat("text", 400)).otherwise(F.col("text")).alias("text"), F.lit("forensic").alias("mode"))
    return analytics.validated(x).select("doc_id", "refused")


def q_sources(s, d):
    x = load(s, d, "documents").join(load(s, d, "labels").select("doc_id", "quality"), "doc_id")
    return training.sources_of(x).select(F.array_join("sources", ",").alias("sources"), "n")


def q_classes(s, d):
    return training.class_counts(load(s, d, "labels").withColumnRenamed("quality", "label"))


def q_fold_means(s, d):
    return training.fold_means(training.cross_validated(_labelled(s, d)))


def q_tokens_signed(s, d):
    x = load(s, d, "documents").select("doc_id", F.concat(F.lit("w"), F.col("doc_id").cast("string")).alias("id")).withColumn("token", service.signed(F.col("id"), "secret"))
    bad = F.when(F.col("doc_id") % 5 == 0, F.concat("token", F.lit("x"))).otherwise(F.col("token"))
    return x.select("doc_id", service.verified(bad, "secret").alias("id"))


def q_judged(s, d):
    return service.judged_by(measured(s, d), None).select("doc_id", "style_value", "style_label", "style_model", "style_trained")


def q_segment_scores(s, d):
    """Segments of the analysis, with the mean of their scores by words."""
    return segments.weighted_mean(segments.segments(features.detect_language(carried(s, d)))).select("doc_id", "n_segments", F.round("mean_score", 4).alias("mean_score"))


MORE = {
    "provenance_manifests": q_manifests, "trust_anchor_count": q_trust_anchors, "feature_values": q_feature_values, "marked_pieces": q_marked_pieces, "page_total": q_page_total, "day_bars": q_day_bars, "summary_page": q_summary_page,
    "analysis_lookup": q_lookup, "prefix_lookup": q_prefix, "upload_checks": q_uploads, "result_cache": q_result_cache, "marker_watermark": q_markers, "mark_requests": q_mark_requests, "recipient_lists": q_recipients, "distinct_copies": q_copies,
    "job_sweep": q_sweep, "refused_transitions": q_refused, "failed_runs": q_failures, "retry_plan": q_retries, "poll_times": q_poll, "insert_analyses": q_insert, "delete_cascade_all": q_delete_all, "event_log": q_event_log,
    "report_checks": q_report_checks, "style_blend": q_blend, "surprisal_signal": q_surprisal, "heat_alpha": q_heat, "analysis_warnings": q_warnings, "signal_evidence": q_evidence, "payload_spans": q_payload_spans,
    "sanitize_reasons": q_sanitize_reasons, "sanitize_warnings": q_sanitize_warnings, "char_context_all": q_context_all, "typo_counts_all": q_typos_all, "text_layout": q_layout, "dedup_reused_own": q_reused_own,
    "exhausted_after_two": q_exhausted_two, "input_validation_default": q_validate_default, "corpus_sources": q_sources, "class_counts": q_classes, "cv_means": q_fold_means, "workspace_tokens": q_tokens_signed,
    "style_judged": q_judged, "segment_mean_score": q_segment_scores,
}

QUERIES = {
    "payload_tag_decode": payload_decode(0, payloads.decode_tag), "payload_vs_decode": payload_decode(1, payloads.decode_selectors), "payload_zwb_decode": payload_decode(2, payloads.decode_zero_width),
    "payload_tag_decode_all": payload_decode_all(payloads.decode_tag), "payload_vs_decode_all": payload_decode_all(payloads.decode_selectors), "payload_zwb_decode_all": payload_decode_all(payloads.decode_zero_width), "trace_leak_all": q_trace_all,
    "invisible_char_scan": q_char_scan, "char_context": q_char_context, "invisible_by_name": q_hits_by_name, "hit_gap_regularity": q_gap_regularity,
    "homoglyph_hits": q_homoglyphs, "homoglyph_words": q_homoglyph_words, "script_profile": q_script_profile, "strip_invisible": q_strip_invisible,
    "normalize_whitespace": q_normalize, "nfc_clean": q_clean, "sanitize_safe": q_sanitize("safe"), "sanitize_aggressive": q_sanitize("aggressive"),
    "sanitize_audit": q_sanitize_audit, "latinize_homoglyphs": q_latinize, "mark_recipients": q_mark, "trace_leak": q_trace, "watermark_signals": q_signals, "watermark_score": q_watermark,
    "language_detect": q_language, "language_confusion": q_language_confusion, "word_counts": q_word_counts, "hapax": q_hapax, "mattr": q_mattr, "ngram_top": q_ngram_top, "ngram_recycling": q_ngram_recycling,
    "lexicon_counts": q_lexicons, "typo_counts": q_typos, "punctuation_counts": q_punctuation, "line_counts": q_lines, "sentence_spans": q_sentences, "paragraph_spans": q_paragraphs, "sliding_windows": q_windows,
    "style_features": q_features, "style_score": q_style, "style_contributions": q_contributions, "profile_match": q_profiles, "segments": q_segments, "segment_hits": q_segment_hits,
    "heatmap_fragments": q_fragments, "doc_mean_score": q_mean_score, "carrier_offsets": q_carrier_offsets, "analyse": q_analyse, "analyse_distinct": q_analyse_distinct, "markdown_report": q_report, "risk_score": q_risk,
    "list_analyses_page": q_list_page, "stats_by_status": q_status, "stats_headline": q_headline, "stats_daily": q_daily, "dedup_latest": q_dedup, "dedup_reused": q_reused, "dedup_to_run": q_to_run,
    "stalled_jobs": q_stalled, "exhausted_jobs": q_exhausted, "event_trail": q_trail, "recent_errors": q_errors, "risk_triage_topk": q_riskiest, "riskiest_segments": q_riskiest_segments,
    "rate_limit_windows": q_rate_windows, "daily_limit": q_daily_limit, "metrics_upsert": q_upsert, "workspace_upsert": q_touch, "segments_replace": q_replace_segments, "delete_cascade": q_delete,
    "job_transition": q_transition, "latest_state": q_latest, "report_documents": q_reports, "input_validation": q_validate, "html_extract": q_html, "json_strings": q_json, "conversation_join": q_conversations,
    "train_style": q_train, "cv_metrics": q_cv,
}

QUERIES |= MORE

__all__ = ["QUERIES", "cp"]
