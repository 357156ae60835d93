"""Scores, segments and the tables."""

import pytest
from pyspark.sql import functions as F

from glyphwarden.operators import features, segments, style
from glyphwarden.plans import store
from glyphwarden.plans.analysis import analyse
from glyphwarden.sources import extract


def test_analyse_defined_for_every_row(spark):
    tagged = "Some words here." + "".join(chr(0xE0000 + ord(c)) for c in "mark|")
    df = spark.createDataFrame([(1, tagged), (2, None), (3, ""), (4, "plain words")], "doc_id int, text string")
    rows = {r.doc_id: r for r in analyse(df).collect()}
    assert rows[1].watermark_label == "payload_recovered" and rows[1].watermark_score >= 0.95 and rows[1].risk_score >= 0.9
    for i in (2, 3, 4):
        assert rows[i].watermark_label == "clean" and rows[i].style_label == "insufficient_text"
    for r in rows.values():
        assert 0 <= r.style_low <= r.style_value <= r.style_high <= 1 and r.report.startswith("# Document")


def test_more_carriers_never_lower_the_score(spark):
    df = spark.createDataFrame([(n, "word " * 30 + "​" * n) for n in (0, 1, 2, 5, 20, 64)], "doc_id int, text string")
    scores = [r.watermark_score for r in analyse(df).orderBy("doc_id").collect()]
    assert scores == sorted(scores) and scores[0] == 0


def test_style_alone_stays_low(spark):
    text = "# Head\n" + "\n".join(f"- **point {i}** — it is… “so”" for i in range(30))
    r = analyse(spark.createDataFrame([(1, text)], "doc_id int, text string")).first()
    assert r.watermark_basis == "stylistic" and r.watermark_score < 0.5


def test_fences_are_not_prose(spark):
    text = "Prose before it.\n```\na  b , c  d\n```\nProse after it."
    r = features.measure(spark.createDataFrame([(1, text)], "doc_id int, text string")).first()
    assert r.typo_indicator_rate == 0 and r.n_words == 6 and r.n_words_source > r.n_words


def test_unknown_language(spark):
    r = features.detect_language(spark.createDataFrame([(1, "zzz qqq xxx vvv"), (2, None)], "doc_id int, text string")).orderBy("doc_id").collect()
    assert [x.language for x in r] == ["unknown", "unknown"] or r[1].language is None


def test_profiles_are_capped(spark):
    df = features.measure(spark.createDataFrame([(1, "I don't know. We can't say, my friend!! " * 30)], "doc_id int, text string"))
    assert all(r.similarity <= style.MOST_ALIKE for r in style.profiles(df).collect())


def test_fragments_cover_the_text(spark):
    segs = spark.createDataFrame([(1, 0, 0, 15, 1.0), (1, 1, 10, 26, 0.0)], "doc_id int, idx int, start_offset int, end_offset int, llm_likelihood double")
    f = segments.fragments(segs, spark.createDataFrame([(1, 26)], "doc_id int, n int")).orderBy("start").collect()
    assert [(r.start, r.end, r.score) for r in f] == [(0, 10, 1.0), (10, 15, 0.5), (15, 26, 0.0)]


def test_upsert_keeps_first_creation_and_is_idempotent(spark):
    old = spark.createDataFrame([("a", 1, 10), ("b", 2, 20)], "id string, v int, created_at long")
    new = spark.createDataFrame([("b", 5, 99), ("c", 7, 30)], "id string, v int, created_at long")
    once = store.upsert(old, new, ["id"], keep=["created_at"])
    twice = store.upsert(once, new, ["id"], keep=["created_at"])
    want = {("a", 1, 10), ("b", 5, 20), ("c", 7, 30)}
    assert {tuple(r) for r in once.collect()} == want == {tuple(r) for r in twice.collect()}


def test_extract_kinds():
    page = "<html><head><title>x</title></head><body><p>One &amp; two</p><script>no()</script><p>Three</p></body></html>"
    assert extract.extract_one(page.encode(), "a.HTML")[0] == "One & two\n\nThree"
    assert extract.extract_one(b'{"a": ["x", {"b": "y"}], "c": 3}', "a.json")[0] == "x\ny"
    assert extract.extract_one("zażółć".encode("cp1250"), "a.txt")[0] == "zażółć"
    assert extract.extract_one(b"%PDF-1.7", "a.pdf")[2] and extract.extract_one(b"", "a.txt")[2] == "empty file"
    assert extract.extract_one(b"{", "a.json")[2].startswith("unreadable")


def test_corpus_refuses_other_labels(spark, tmp_path):
    good = '{"text": "' + "word " * 50 + '", "label": "ai"}\n// note\n\n{"text": "short", "label": "human"}\n'
    (tmp_path / "a.jsonl").write_text(good)
    rows = extract.read_corpus(spark, str(tmp_path)).collect()
    assert [(r.label, r.source) for r in rows] == [("ai", "a.jsonl")]
    (tmp_path / "b.jsonl").write_text('{"text": "x", "label": "robot"}\n')
    with pytest.raises(Exception, match="label must be"):
        extract.read_corpus(spark, str(tmp_path)).collect()


def test_stream_replay_changes_nothing(spark, tmp_path):
    from glyphwarden.streaming import jobs

    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    rows = spark.createDataFrame([("s1", "w", "Some text.", "quick"), ("s2", "w", None, "quick")], "id string, workspace_id string, text string, mode string").withColumn("created_at", F.current_timestamp())
    rows.write.parquet(src)
    q = jobs.start(jobs.read_submissions(spark, src), out, ck, once=True)
    q.awaitTermination(120)
    jobs.run_batch(spark.read.parquet(src), 0, out)
    assert jobs.results(spark, out).count() == 2


def test_queries_and_sql_agree_on_names():
    from glyphwarden.oracle import ORACLE_SQL
    from glyphwarden.queries import QUERIES

    assert set(ORACLE_SQL) <= set(QUERIES)
