"""The Arrow pass against independent readings of the same rules, the documents with known marks, and the service layer."""

import io
import random
import re
import unicodedata
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from glyphwarden.functions import spans, study
from glyphwarden.operators import features, marking, provenance, segments, signals, style
from glyphwarden.plans import service, store
from glyphwarden.plans.analysis import analyse, result_json
from glyphwarden.sources import extract, samples
from glyphwarden.sources.pdf import PdfError, pdf_pages

# The base text of the documents with known marks, and what is known of them.
BASE = (
    "Analiza nowoczesnych systemów autonomicznych wskazuje na kluczowe znaczenie zaawansowanych algorytmów uczenia maszynowego w optymalizacji procesów decyzyjnych. "
    "W kontekście współczesnej inżynierii, dynamiczny rozwój sieci neuronowych pozwala na bardziej precyzyjne przewidywanie wyników w złożonych środowiskach operacyjnych. "
    "Kluczowym wyzwaniem pozostaje jednak zapewnienie pełnej transparentności modeli, co jest niezbędne do budowania zaufania w interakcjach człowiek-maszyna.\n\n"
    "Zastosowanie podejścia opartego na architekturze typu Mixture-of-Experts umożliwia znaczącą poprawę wydajności obliczeniowej przy jednoczesnym zachowaniu wysokiej jakości wyników. "
    "Dynamiczny charakter tych rozwiązań pozwala na efektywne skalowanie systemów w odpowiedzi na zmienne obciążenie. "
    "Kluczowe znaczenie ma również odpowiednia kalibracja parametrów, która bezpośrednio wpływa na stabilność całego procesu wnioskowania.\n\n"
    "W kontekście praktycznych wdrożeń, podejście oparte na ciągłej walidacji wyników stanowi fundament niezawodności. "
    "Systemy autonomiczne wymagają stałego monitorowania kluczowych wskaźników wydajności, co umożliwia szybką reakcję na anomalie. "
    "Transparentność procesu decyzyjnego pozostaje kluczowym elementem budowania zaufania użytkowników do rozwiązań opartych na sztucznej inteligencji."
)
SWAPS = (("systemów", "systеmów", 3), ("kluczowe", "kluczowе", 2), ("modeli", "mоdeli", 2))
KNOWN = {"clean": (0, "clean"), "markers": (92, "watermark_detected"), "tags": (98, "payload_recovered"), "selectors": (98, "payload_recovered"), "bits": (99, "payload_recovered"), "look_alikes": (65, "watermark_suspected")}


def test_documents_with_known_marks(spark):
    swapped = BASE
    for old, new, n in SWAPS:
        swapped = swapped.replace(old, new, n)
    said = {"tags": "owner:Example|release:2026-08-13|id:WF-001", "selectors": "leak-trace-42", "bits": "wm:demo-2026"}
    docs = samples.samples(spark, BASE, swapped, said["tags"], said["selectors"], said["bits"])
    rows = {r["name"]: r for r in analyse(docs, "name").collect()}
    for name, (percent, label) in KNOWN.items():
        r = rows[name]
        assert (round(100 * r.watermark_score), r.watermark_label) == (percent, label), name
        assert [p.text for p in r.payloads] == ([said[name]] if name in said else [])
        assert round(100 * r.style_value) == 85 and r.language == "pl"
        assert sum(s.watermark_hits for s in r.segments) >= (0 if name == "clean" else 1)
    assert rows["clean"].signals == [] or all(s.category == "stylistic" for s in rows["clean"].signals)


def brute_windows(counts, target, overlap, least):
    """Windows found by trying every length."""
    out, first = [], 0
    while True:
        last = next((j for j in range(first + 1, len(counts) + 1) if sum(counts[first:j]) >= target), len(counts))
        out.append((first, last))
        if last == len(counts):
            break
        back = next((j for j in range(last, first, -1) if sum(counts[j:last]) >= overlap), first + 1)
        first = max(back, first + 1)
    if len(out) > 1 and sum(counts[out[-1][0] : out[-1][1]]) < least:
        out = out[:-2] + [(out[-2][0], len(counts))]
    return out


def test_windows_against_brute_force():
    rng = random.Random(3)
    for _ in range(400):
        counts = [rng.choice([0, 1, 3, 8, 20, 60]) for _ in range(rng.randint(1, 40))]
        target = rng.choice([5, 30, 120])
        overlap = rng.choice([0, 1, target // 4, target - 1])
        assert spans.window_ranges(counts, target, overlap) == brute_windows(counts, target, overlap, 25)
    assert spans.window_ranges([], 5, 1) == []
    text = " ".join(f"Sentence number {i} is here." for i in range(300))
    few = spans.windows(text, 20, 5, most=10)
    assert len(few) <= 10 and few[0][0] == 0
    assert spans.sentences("It cost e.g. five (approx. six) dr. no. 5. Yes!  \"So.\" he said\n\nNew one") == [
        (0, 42, "It cost e.g. five (approx. six) dr. no. 5.", 9), (43, 47, "Yes!", 1), (49, 54, '"So."', 1), (55, 62, "he said", 2), (64, 71, "New one", 2)]


def test_segments_count_hidden_characters_and_look_alikes(spark):
    sentence = "The quick brown fox jumps over the lazy dog near the river bank today. "
    text = sentence * 30
    text = text[:100] + "​" + text[100:500] + " " + text[500:900].replace("o", "о", 2) + text[900:]
    df = spark.createDataFrame([(1, text, "en"), (2, None, "en"), (3, "", None)], "doc_id int, text string, language string")
    rows = segments.segments(df).orderBy("idx").collect()
    hits = [100] + [m.start() for m in re.finditer("о", text)]
    assert len(hits) == 3 and {r.doc_id for r in rows} == {1}
    for r in rows:
        assert r.watermark_hits == sum(r.start_offset <= h < r.end_offset for h in hits)  # not the unusual space
        window = spans.visible(text[r.start_offset : r.end_offset].strip())
        m = features.measure(spark.createDataFrame([(window, "en")], "text string, language string"), language="language")
        want = style.style_score(m).first()
        assert (r.word_count, r.llm_likelihood) == (want.n_words, pytest.approx(want.style_value, abs=1e-4))


def test_evidence_is_capped_and_counted(spark):
    text = "word‮ " * 40 + "​x" * 30
    g = {s.id: s for s in signals.signals(spark.createDataFrame([(1, text)], "doc_id int, text string")).first().signals}
    assert len(g["bidi_controls"].evidence) == 20 == g["bidi_controls"].evidence_total
    inv = g["invisible_characters"]
    assert inv.evidence[0].kind == "summary" and inv.evidence[0].detail == "U+200B ZERO WIDTH SPACE x30" and len(inv.evidence) == inv.evidence_total == 22
    first = next(e for e in inv.evidence if e.offset is not None)
    assert first.offset == text.index("​") and "‸" in first.detail


def test_result_is_one_document(spark):
    text = "Plain words here, and more of them. " * 40
    r = analyse(spark.createDataFrame([(1, text, "pdf"), (2, "hi", None)], "doc_id int, text string, format string"), source_format="format")
    j = {x.doc_id: __import__("json").loads(x.j) for x in r.select("doc_id", result_json().alias("j")).collect()}
    assert j[1]["input"]["words"] == 280 and j[1]["scores"]["risk"]["label"] and len(j[1]["segments"]) > 1 and j[1]["input"]["scripts"] == {"LATIN": 1080}
    assert len(j[1]["features"]) == 20 and any("format" in w for w in j[1]["warnings"]) and "40 words" in j[2]["warnings"][0]
    for head in ("## Verdicts", "## Signals", "## Findings", "## Style", "## Segments", "## Measures", "## Limits"):
        assert head in j[1]["technical_report_markdown"]
    quick = analyse(r.select("doc_id").join(spark.createDataFrame([(1, text)], "doc_id int, text string"), "doc_id"), mode="quick").first()
    assert quick.mode == "quick" and quick.profiles == [] and len(quick.segments) < len(j[1]["segments"])
    with pytest.raises(ValueError):
        analyse(r, mode="slow")


def test_measure_by_hand():
    m = study.measure("I don't know. We can't say, my friend!! I do ,really..... so—so…")
    assert m["n_words"] == 13 and m["n_sentences"] == 4
    assert m["exclamation_rate"] == round(2000 / 63, 6) and m["em_dash_rate"] == round(1000 / 63, 6) == m["ellipsis_char_rate"]
    fenced = study.measure("Before.\n```\nx  y ,\n```\nAfter it.")
    assert fenced["n_words"] == 3 and fenced["n_words_source"] == 5 and fenced["typo_indicator_rate"] == 0
    assert study.measure("")["n_sentences"] == 0 and study.moving_types(["a"] * 60) == pytest.approx(1 / 50)
    assert unicodedata.normalize("NFC", "é") == spans.normalized("é")


def simple_pdf(pages, compress=True, fonts=b""):
    out, objects = b"%PDF-1.4\n", {}
    kids = " ".join(f"{10 + 2 * i} 0 R" for i in range(len(pages))).encode()
    objects[1], objects[2] = b"<</Type /Catalog /Pages 2 0 R>>", b"<</Type /Pages /Kids [" + kids + b"] /Count " + str(len(pages)).encode() + b">>"
    for i, content in enumerate(pages):
        body = zlib.compress(content) if compress else content
        objects[10 + 2 * i] = b"<</Type /Page /Parent 2 0 R /Resources <</Font <<" + fonts + b">>>> /Contents " + str(11 + 2 * i).encode() + b" 0 R>>"
        objects[11 + 2 * i] = (b"<</Filter /FlateDecode " if compress else b"<<") + b"/Length " + str(len(body)).encode() + b">>\nstream\n" + body + b"\nendstream"
    return out + b"".join(str(n).encode() + b" 0 obj\n" + b + b"\nendobj\n" for n, b in objects.items())


def test_pdf_text():
    pages = [rb"BT /F1 12 Tf 72 700 Td (Hello \(big\) world) Tj 0 -14 Td [(sec) -20 (ond) -300 (line)] TJ ET", b"BT (page two) Tj ET"]
    for compress in (True, False):
        assert pdf_pages(simple_pdf(pages, compress)) == ["Hello (big) world\nsecond line", "page two"]
    text, kind, reason, n = extract.extract_one(simple_pdf(pages), "file:/data/v1.2/x.pdf")
    assert (kind, reason, n) == ("pdf", None, 2) and text.endswith("\n\npage two")
    assert extract.extract_one(simple_pdf([b"q Q"]), "scan.pdf")[2].startswith("no text")
    with pytest.raises(PdfError):
        pdf_pages(b"%PDF-1.4\ntrailer <</Encrypt 5 0 R>>")


def docx(paragraphs, rows):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    p = "".join(f"<w:p><w:r><w:t>{x}</w:t></w:r></w:p>" for x in paragraphs)
    t = "".join("<w:tr>" + "".join(f"<w:tc><w:p><w:r><w:t>{c}</w:t></w:r></w:p></w:tc>" for c in row) + "</w:tr>" for row in rows)
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{p}<w:tbl>{t}</w:tbl></w:body></w:document>')
    return held.getvalue()


def test_files_by_name(spark, tmp_path):
    (tmp_path / "v1.2").mkdir()
    for name, data in {"v1.2/readme": b"plain text here", "a.docx": docx(["One", "Two"], [["x", "y"]]), "b.json": b'["deep"' + b"]", "c.bin": b"\x00\x01", "d.html": b"<p>A</p><p>B</p>", "e.json": b"[" * 100_000}.items():
        (tmp_path / name).write_bytes(data)
    rows = {r.path.rsplit("/", 1)[1]: r for r in extract.read_files(spark, str(tmp_path), most=8).collect()}
    assert rows["readme"].text == "plain te" and rows["readme"].truncated and rows["readme"].notes and rows["readme"].format == "text"
    assert extract.extract_one((tmp_path / "a.docx").read_bytes(), "a.docx")[0] == "One\nTwo\nx\ty"
    assert rows["b.json"].text == "deep" and rows["c.bin"].reason == "unsupported file type" and rows["e.json"].reason.startswith("unreadable") and rows["d.html"].notes
    bad = spark.createDataFrame([('{"a": "x"}',), ("{",), (None,)], "j string").select(extract.json_udf(F.col("j")).alias("t")).collect()
    assert [r.t for r in bad] == ["x", None, None]


@pytest.mark.parametrize("given", [dict(recipients=[]), dict(recipients=["a"] * 101), dict(recipients=["a", " "]), dict(template="x" * 129), dict(channel="smoke"), dict(repeat=21), dict(repeat=True), dict(template=" "), dict(recipients=["zoë"])])
def test_marking_requests_are_checked(spark, given):
    docs = spark.createDataFrame([(1, "One. Two.")], "doc_id int, text string")
    with pytest.raises(marking.MarkingError):
        marking.mark_copies(docs, **({"recipients": ["a"]} | given))
    r = marking.mark_copies(docs, ["zoë"], channel="variation_selectors").first()
    assert r.verified and r.copies_embedded == 1 and marking.filled("WF-{index:03d}-{recipient}", "a", 7) == "WF-007-a"


def test_unreadable_marks_are_refused(spark):
    # another carrier in the text spoils the message
    docs = spark.createDataFrame([(1, "\U000e0041" * 3 + "One. Two.")], "doc_id int, text string")
    spoiled = spark.createDataFrame([(1, "One. " + "︀︁︂" * 40 + " Two. ")], "doc_id int, text string")
    assert marking.mark_copies(docs, ["a"]).first().verified
    with pytest.raises(Exception, match="does not decode"):
        marking.mark_copies(spoiled, ["a"], channel="variation_selectors", repeat=1).collect()


def test_states_follow_one_another(spark):
    state = spark.createDataFrame([("a", "pending", 0, None, None, None), ("b", "done", 1, 5, 6, None)], "id string, status string, attempts int, started_at long, completed_at long, error string")
    changes = spark.createDataFrame([("a", "running", 9, None), ("b", "running", 9, None)], "id string, to string, at long, error string")
    assert {(r.id, r.status) for r in store.transition(state, changes).collect()} == {("a", "running"), ("b", "done")}
    assert [(r.id, r.to) for r in store.refused(state, changes).collect()] == [("b", "running")]


def test_models_fall_back(spark, tmp_path):
    assert service.load_model(None) is None and service.load_model(str(tmp_path / "nothing")) is None
    rows = features.measure(spark.createDataFrame([(1, "Some words here.")], "doc_id int, text string"))
    assert service.judged_by(rows, str(tmp_path / "nothing")).first().style_model == "prior-logistic"
    t = style.trained_score(rows.withColumn("style_probability", F.lit(0.9))).first()
    assert t.style_trained and t.style_raw == pytest.approx(0.5 + 0.4 * (3 / 150) ** 0.5) and t.style_label == "insufficient_text"


def test_streams_replay_and_limits(spark, tmp_path):
    from glyphwarden.streaming import jobs

    at = "2026-01-01 00:00:"
    rows = [("a", "w", "Same text.", "quick", at + "01"), ("b", "w", "Same text.", "quick", at + "02"), ("c", "w", "Other text.", "quick", at + "03"), ("d", "v", "Same text.", "quick", at + "59")]
    df = spark.createDataFrame(rows, "id string, workspace_id string, text string, mode string, at string").withColumn("created_at", F.to_timestamp("at")).drop("at")
    src = str(tmp_path / "in")
    df.write.parquet(src)
    for name, stream in (("first", jobs.first_submissions(jobs.read_submissions(spark, src))), ("rates", jobs.rate_counts(jobs.read_submissions(spark, src), "workspace_id", "created_at", limit=2))):
        mode = "append" if name == "first" else "complete"
        stream.writeStream.format("memory").queryName(f"t_{name}").outputMode(mode).trigger(availableNow=True).start().awaitTermination(120)
    assert {r.id for r in spark.table("t_first").collect()} in ({"a", "c", "d"}, {"b", "c", "d"})
    assert {(r.workspace_id, r.hits, r.rejected) for r in spark.table("t_rates").collect()} == {("w", 3, 1), ("v", 1, 0)}


def test_manifest_without_anything(spark):
    df = spark.createDataFrame([("{}", None, None), (None, None, None)], "manifest string, state string, results string")
    assert [(r.present, r.integrity, r.actions, r.reason is None) for r in provenance.inspect(df).collect()] == [(False, "unknown", [], False), (False, "unknown", [], False)]


def test_observed_counts(spark):
    df, seen = service.timed(spark.range(7), "rows seen")
    df.write.format("noop").mode("overwrite").save()
    assert seen.get["rows"] == 7
