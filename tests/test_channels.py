"""Scans, hidden channels, cleaning and marking on strings with known outcomes."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from glyphwarden.functions import spans
from glyphwarden.operators import marking, payloads, sanitize, scan

TEXTS = [
    (1, "hello​world"), (2, "This is a pаssword field."), (3, "Uwaga ⚠️ koniec."), (4, "plain text️ here"),
    (5, "Это русский текст"), (6, "a\U0001f600b c"), (7, None), (8, ""),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(TEXTS, "doc_id int, text string")


def test_char_hits(docs):
    rows = {(r.doc_id, r.offset, r.category) for r in scan.char_hits(docs).collect()}
    assert rows == {(1, 5, "zero_width"), (4, 10, "variation_selector"), (6, 3, "exotic_space")}


def test_homoglyphs_only_in_latin_words(docs):
    rows = [(r.doc_id, r.offset, r.latin, r.script) for r in scan.homoglyph_hits(docs).collect()]
    assert rows == [(2, 11, "a", "CYRILLIC")]


def test_script_profile(spark):
    df = spark.createDataFrame([(1, "Hello there")], "doc_id int, text string")
    assert [(r.script, r.n) for r in scan.script_profile(df).collect()] == [("LATIN", 10)]


@pytest.mark.parametrize(("channel", "payload"), [("tag_characters", "watermark-42"), ("variation_selectors", "ĄĆĘ unicode"), ("zero_width_binary", "secret")])
def test_round_trip(spark, channel, payload):
    df = spark.createDataFrame([(payload,)], "p string")
    hidden = df.select(F.concat(F.lit("Visible text."), payloads.encode(channel, F.col("p")), F.lit(" world")).alias("t"))
    found = hidden.select(payloads.decode_all(F.col("t")).alias("x")).first()["x"]
    assert [(p["channel"], p["text"], p["byte_length"]) for p in found] == [(channel, payload, len(payload.encode()))]


def test_markers_are_no_payload(spark):
    text = " ".join(("word​" if i % 9 == 0 else "word‍" if i % 14 == 0 else "word") for i in range(200))
    df = spark.createDataFrame([(1, text)], "doc_id int, text string")
    assert df.select(payloads.decode_all(F.col("text")).alias("x")).first()["x"] == []
    assert scan.char_hits(df).count() >= 10


def test_sanitize_keeps_what_text_needs(spark):
    family, persian = "\U0001f468‍\U0001f469", "می‌خواهم"
    df = spark.createDataFrame([(1, family), (2, persian), (3, "a​b"), (4, "a b c"), (5, "c‌d")], "doc_id int, text string")
    safe = {r.doc_id: r.s for r in df.select("doc_id", sanitize.sanitized(F.col("text")).alias("s")).collect()}
    assert safe == {1: family, 2: persian, 3: "ab", 4: "a b c", 5: "cd"}
    hard = {r.doc_id: r.s for r in df.select("doc_id", sanitize.sanitized(F.col("text"), "aggressive").alias("s")).collect()}
    assert hard[3] == "ab" and hard[4] == "a b c" and "‍" not in hard[1]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet="abc XYZ.!?", min_size=0, max_size=40), min_size=3, max_size=6))
def test_cleaning_undoes_marking(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    m = marking.mark_copies(df, ["ann", "bob"], "id:{index:02d}").withColumn("back", sanitize.sanitized(F.col("text"), "aggressive"))
    for r in m.collect():
        assert r.back == texts[r.doc_id] and r.verified
    assert m.select("text").distinct().count() == m.groupBy("doc_id").count().count() * 2 or len(set(texts)) < len(texts)


def test_marking_refuses(docs):
    with pytest.raises(marking.MarkingError):
        marking.mark_copies(docs, ["a", "a"])
    with pytest.raises(marking.MarkingError):
        marking.mark_copies(docs, ["a"], "{other}")


def test_sentences_and_windows():
    assert len(spans.sentences("We met dr. Kowalski yesterday. He was late.")) == 2
    text = " ".join(f"Sentence number {i} is here." for i in range(60))
    w = spans.windows(text, 50, 10)
    starts = [x[0] for x in w]
    assert len(w) > 1 and starts == sorted(set(starts)) and all(b[0] < a[1] for a, b in zip(w, w[1:]))
    assert spans.windows("") == []
    with pytest.raises(ValueError):
        spans.windows(text, 10, 10)


@pytest.mark.parametrize("name", ["payload_tag_decode_all", "payload_vs_decode_all", "payload_zwb_decode_all", "trace_leak_all"])
def test_decoders_on_every_document(spark, name):
    duckdb = pytest.importorskip("duckdb")
    from glyphwarden.oracle import ORACLE_SQL
    from glyphwarden.queries import QUERIES

    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{d}/documents.parquet'")
    want = con.execute(ORACLE_SQL[name]).fetchall()
    assert sorted(map(repr, map(tuple, QUERIES[name](spark, d).collect()))) == sorted(map(repr, want))
    assert len({r[0] for r in want}) == con.execute("SELECT count(*) FROM documents").fetchone()[0]
