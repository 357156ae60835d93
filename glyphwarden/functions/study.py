"""All that Python does for an analysis, in one Arrow pass: hits, measures, segments and evidence.

Each text is cut into words once.  A word is looked up once in one dictionary whose value
holds a bit for each list that it is in; sentences, paragraphs and windows count words by
their positions; style values of all windows of a batch are one matrix product.  What
needs no Python (payloads, scores, risk, findings, the report) stays with Column expressions.
"""

from __future__ import annotations

import functools
import re
from bisect import bisect_left
from collections import Counter


import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import codepoints as cp
from . import lexicons as lex
from . import spans
from .rounding import exact_half_up, half_even, half_up

FEATURES = (
    "mean_sentence_length", "sentence_length_cv", "paragraph_length_cv", "mean_word_length", "long_word_ratio", "mattr", "hapax_ratio",
    "discourse_marker_rate", "assistant_lexicon_rate", "hedge_rate", "contraction_rate", "personal_pronoun_rate", "em_dash_rate", "curly_quote_ratio",
    "ellipsis_char_rate", "bullet_line_ratio", "sentence_start_repetition", "typo_indicator_rate", "comma_per_sentence", "exclamation_rate",
)
SIZES = ("n_words", "n_sentences", "n_paragraphs", "n_chars", "n_chars_source", "n_words_source")
#: Words of a window of the moving type share; windows begin a fifth of it apart.
WINDOW, STEP, LONG_WORD, SAMPLE = 50, 10, 7, 2000
# The patterns of slips, bullets, headings and bold runs, in this module's dialect.
SLIPS = tuple(map(re.compile, (r"(?<=\S)  +(?=\S)", r"\s+[,;:!?](?=\s|\Z)", r"[!?]{2,}|\.{4,}|,{2,}")))
CRAMPED = re.compile(r"[a-ząćęłńóśźż],[a-ząćęłńóśźż]")
BULLET = re.compile(r"(?m)^\s*(?:[-*•‣·]|\d+[.)]|[a-z][.)])\s+")
LIST_LINE = re.compile(r"\s*(?:[-*•]|\d+[.)])\s+")
HEADING = re.compile(r"(?m)^\s*(?:#{1,6}\s+\S|\*\*[^*\n]+\*\*\s*$)")
BOLD = re.compile(r"\*\*[^*\n]+\*\*")
OPENING = re.compile(r"\s*(?:certainly|sure|of course|great question|absolutely|happy to help|oczywiście|jasne|świetne pytanie|z przyjemnością)\b[!,.]", re.I)
QUOTES, CURLY, ALL_CURLY = "\"'", "‘’“”", "‘’“”„«»"
EDGE_SIGNS = ".,;:—-"

# One bit for each list.
_TABLES = {"discourse": lex.DISCOURSE, "assistant": lex.ASSISTANT, "hedges": lex.HEDGES, "pronouns": lex.FIRST_PERSON}
_LISTS = [("stop", code, words) for code, words in lex.STOPWORDS.items()] + [(name, code, t[code]) for name, t in _TABLES.items() for code in ("en", "pl")] + [("contractions", "en", lex.CONTRACTIONS)]
BIT = {(name, code): i for i, (name, code, _) in enumerate(_LISTS)}


@functools.lru_cache(maxsize=1)
def _bits() -> dict[str, int]:
    out: dict[str, int] = {}
    for i, (_, _, words) in enumerate(_LISTS):
        for w in set(words):
            if " " not in w:
                out[w] = out.get(w, 0) | 1 << i
    return out


_PHRASES = {key: [p for p in dict.fromkeys(words) if " " in p] for (name, code, words) in _LISTS for key in [(name, code)]}


class Words:
    """The words of a text: where they start, themselves in lower case, and which lists each is in."""

    def __init__(self, text: str):
        found = list(spans._WORD.finditer(text))
        self.starts = [m.start() for m in found]
        self.lower = [m[0].lower() for m in found]
        get = _bits().get
        self.lists = np.fromiter((get(w, 0) for w in self.lower), np.int64, len(self.lower))

    def __len__(self) -> int:
        return len(self.lower)

    def listed(self, name: str, code: str, first: int | None = None) -> int:
        return int((self.lists[:first] >> BIT[name, code] & 1).sum())


def language_of(text: str, words: Words) -> tuple[str, float]:
    """(code, confidence) by stop words among the first words and by telling letters; unknown below 0.08."""
    n = min(len(words), SAMPLE)
    if not n:
        return "unknown", 0.0
    low = text.lower()
    scores = {}
    for code in lex.STOPWORDS:
        told = sum(map(low.count, lex.HINTS.get(code, ""))) / max(len(low), 1) * 6.0
        scores[code] = half_up(words.listed("stop", code, SAMPLE) / n + min(0.15, told), 4)
    best = max(scores, key=scores.__getitem__)
    first, second = sorted(scores.values(), reverse=True)[:2]
    return (best, half_up(min(1.0, 0.5 + (first - second) * 6), 3)) if first >= 0.08 else ("unknown", half_up(first * 4, 3))


def _spread(values: list[int]) -> float:
    """Population deviation over mean of the positive values; 0 below two of them."""
    v = np.array([x for x in values if x > 0], float)
    return float(v.std() / v.mean()) if v.size > 1 else 0.0


def moving_types(lower: list[str]) -> float:
    """Mean share of distinct words in windows: a word counts where it did not stand in the window before."""
    n = len(lower)
    if n <= WINDOW:
        return len(set(lower)) / n if n else 0.0
    last: dict[str, int] = {}
    before = np.empty(n, np.int64)
    for i, w in enumerate(lower):
        before[i] = last.get(w, -1)
        last[w] = i
    begin = np.arange(0, n - WINDOW + 1, STEP)[:, None]
    return float((before[begin + np.arange(WINDOW)] < begin).sum(axis=1).mean() / WINDOW)


def measure(source: str, language: str | None = None) -> dict:
    """The twenty measures of a text without its fenced blocks, its language and sizes."""
    text = spans.without_fences(source)
    words, low = Words(text), text.lower()
    confidence = None
    if language is None:
        language, confidence = language_of(text, words)
    sentences = spans.sentence_ranges(text)
    per_sentence = spans.words_in(words.starts, sentences)
    per_paragraph = spans.words_in(words.starts, spans.paragraph_ranges(text))
    n, n_sent, n_lines = len(words), len(sentences), sum(not line.isspace() for line in text.splitlines() if line)
    openings = [w for a, b in sentences if (w := text[a:b].split(None, 1)[0].lower().strip(EDGE_SIGNS))]
    times = Counter(words.lower)
    lists = "pl" if language == "pl" else "en"
    straight, curly = sum(map(text.count, QUOTES)), sum(map(text.count, ALL_CURLY))
    slips = sum(sum(1 for _ in p.finditer(text)) for p in SLIPS) + sum(1 for _ in CRAMPED.finditer(low))

    def share(part: float, whole: float) -> float:
        return part / whole if whole else 0.0

    def rate(name: str) -> float:
        return (words.listed(name, lists) + sum(map(low.count, _PHRASES[name, lists]))) * 100.0 / max(n, 1)

    def per_k(hits: int) -> float:
        return hits * 1000.0 / max(len(text), 1)

    values = (
        share(sum(per_sentence), n_sent), _spread(per_sentence), _spread(per_paragraph), share(sum(map(len, words.lower)), n), share(sum(len(w) >= LONG_WORD for w in words.lower), n),
        exact_half_up(moving_types(words.lower), 6), share(sum(k == 1 for k in times.values()), len(times)), rate("discourse"), rate("assistant"), rate("hedges"),
        words.listed("contractions", "en") * 100.0 / max(n, 1) if language == "en" else 0.0, rate("pronouns"), per_k(text.count("—")), share(curly, curly + straight), per_k(text.count("…")),
        share(sum(1 for _ in BULLET.finditer(text)), n_lines), share(len(openings) - len(set(openings)), n_sent), per_k(slips), share(text.count(","), n_sent), per_k(text.count("!")),
    )
    sizes = (n, n_sent, len(per_paragraph), len(text), len(source), n if text == source else len(spans.word_starts(source)))
    return {"language": language, "language_confidence": confidence} | dict(zip(SIZES, sizes, strict=True)) | {k: half_even(float(v), 6) for k, v in zip(FEATURES, values, strict=True)}


# -- characters --------------------------------------------------------------------------------

_CLASS = {c: name for name, table in (("zero_width", cp.ZERO_WIDTH), ("bidi_control", cp.BIDI_CONTROL), ("format_control", cp.FORMAT_CONTROL), ("exotic_space", cp.EXOTIC_SPACE)) for c in table}
_NAME = {c: name for table in (cp.ZERO_WIDTH, cp.BIDI_CONTROL, cp.FORMAT_CONTROL, cp.EXOTIC_SPACE) for c, name in table.items()}
_SUSPECT = re.compile("[" + "".join(map(chr, _CLASS)) + "\uFE00-\uFE0F\U000E0100-\U000E01EF\U000E0000-\U000E007F]")
_PICTOGRAPH = re.compile("[" + re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: chr(int(m[1], 16)), cp.SCAN_PICTOGRAPH_SET) + "]")
_TWIN = dict(zip(cp.LOOK_ALIKES, cp.LATIN_TWINS, strict=True))
_LOOK_ALIKE, _RUN = re.compile(f"[{cp.LOOK_ALIKES}]"), re.compile(r"\w+")
_STYLING = "\uFE0E\uFE0F"
CARET, RADIUS = "‸", 24


def class_of(c: int) -> tuple[str, str]:
    """(category, label) of a suspicious code point."""
    if c in _CLASS:
        kind, name = _CLASS[c], _NAME[c]
    elif 0xE0000 <= c <= 0xE007F:
        kind, name = "tag_char", f"TAG CHARACTER U+{c:04X}"
    else:
        kind, name = "variation_selector", f"VARIATION SELECTOR-{c - 0xFE00 + 1 if c <= 0xFE0F else c - 0xE0100 + 17}"
    return kind, f"U+{c:04X} {name}"


def char_hits(text: str) -> list[tuple[int, int, str, str]]:
    """(offset, code point, category, label); a lone presentation selector after a pictograph is ordinary text."""
    if text.isascii():
        return []
    out = []
    for m in _SUSPECT.finditer(text):
        i = m.start()
        if m[0] in _STYLING and i and _PICTOGRAPH.match(text[i - 1]) and text[i + 1 : i + 2] not in (*_STYLING,):
            continue
        out.append((i, ord(m[0]), *class_of(ord(m[0]))))
    return out


@functools.lru_cache(maxsize=1 << 16)
def script_of(c: str) -> str:
    return cp.script_name(c)


def look_alikes(text: str) -> list[tuple[int, str, str, str, str]]:
    """(offset, letter, Latin twin, script, word) of letters of other scripts in words that have a Latin one."""
    if text.isascii() or not _LOOK_ALIKE.search(text):
        return []
    return [
        (run.start() + i, c, _TWIN[c], script_of(c), run[0])
        for run in _RUN.finditer(text)
        if len(run[0]) > 1 and _LOOK_ALIKE.search(run[0]) and any(c.isalpha() and script_of(c) == "LATIN" for c in run[0])
        for i, c in enumerate(run[0])
        if c in _TWIN
    ]


def scripts(text: str) -> dict[str, int]:
    out: Counter = Counter()
    for c, n in Counter(text).items():
        if c.isalpha():
            out[script_of(c)] += n
    return dict(sorted(out.items()))


def context(text: str, at: int) -> str:
    around = text[max(0, at - RADIUS) : at] + CARET + text[at + 1 : at + 1 + RADIUS]
    return spans.visible(around).replace("\n", " ")


def regularity(offsets: list[int]) -> float:
    """1 for even gaps, 0 for random ones; 0 below four offsets."""
    gaps = np.diff(np.array(offsets, float))
    return max(0.0, min(1.0, 1.0 - float(gaps.std() / gaps.mean()))) if len(offsets) >= 4 and gaps.mean() > 0 else 0.0


def carriers(text: str) -> list[dict]:
    """First and last offset of each channel's carriers, by the note that its decoder gives."""
    if text.isascii():
        return []
    from ..operators.payloads import ALPHABETS, NOTES

    out = []
    for channel, pattern in (("tag_characters", "[\U000E0000-\U000E007F]"), ("variation_selectors", "[\uFE00-\uFE0F\U000E0100-\U000E01EF]")):
        at = [m.start() for m in re.finditer(pattern, text)]
        if at:
            out.append({"note": NOTES[channel], "first": at[0], "last": at[-1]})
    for zero, one in ALPHABETS:
        at = [m.start() for m in re.finditer(f"[{zero}{one}]", text)]
        if len(at) >= 16:
            out.append({"note": f"8-bit groups, 0=U+{ord(zero):04X} 1=U+{ord(one):04X}", "first": at[0], "last": at[len(at) // 8 * 8 - 1]})
    return out


# -- signals that need no payload ----------------------------------------------------------------

# Steps of counts, weights, caps and limits of the detectors.
INVISIBLE_STEPS = ((1, 0.45), (2, 0.6), (5, 0.75), (20, 0.88), (64, 0.94))
BIDI_STEPS = ((1, 0.55), (2, 0.7), (6, 0.85))
HOMOGLYPH_STEPS = ((1, 0.5), (3, 0.68), (10, 0.85), (30, 0.93))
EXOTIC_STEPS = ((1, 0.12), (4, 0.25), (15, 0.4), (50, 0.55))
SEVERITY_STEPS = ((0.0, "info"), (0.15, "low"), (0.4, "medium"), (0.65, "high"), (0.85, "critical"))
SHOWN, KEPT, TOP_GRAMS, TOP_WORDS, GRAM, LEAST_GRAM_WORDS, LEAST_LINES = 20, 25, 8, 12, 5, 40, 6
#: Title and explanation of each signal.
SAID = {
    "invisible_characters": ("Invisible characters in the text", "Characters that show nothing stand in the text; hidden marks are usually made of them."),
    "bidi_controls": ("Controls of writing direction", "Such controls change the order in which text is shown but not its bytes."),
    "homoglyph_substitution": ("Letters of another script in Latin words", "Look-alike letters survive copying and are hard to see."),
    "exotic_whitespace": ("Unusual spaces", "Spaces of unusual width can hold a message; web pages have some by nature."),
    "typographic_fingerprint": ("Typographic punctuation", "Dashes, curly quotes and ellipses are commoner in generated text; a hint, no proof."),
    "ngram_recycling": ("Repeated runs of words", "The same runs of words come again more often than in edited prose."),
    "structural_uniformity": ("Layout of lists and headings", "Lists, headings and bold runs dominate; manuals look alike."),
}


def step_of(n: float, steps: tuple) -> float | str:
    """The value of the highest step that n reaches; 0 below the first."""
    i = bisect_left([a for a, _ in steps], n + 1e-12)
    return steps[i - 1][1] if i else 0.0


def _signal(rank: int, name: str, category: str, score: float, weight: float, evidence: list[tuple]) -> dict:
    title, description = SAID[name]
    shown = [{"kind": kind, "detail": detail, "offset": offset, "length": length} for kind, detail, offset, length in evidence[:KEPT]]
    return {"id": name, "category": category, "title": title, "description": description, "score": score, "weight": weight, "severity": step_of(score, SEVERITY_STEPS), "rank": rank, "evidence": shown, "evidence_total": len(evidence)}


def _by_label(hits: list[tuple]) -> str:
    return ", ".join(f"{label} x{n}" for label, n in sorted(Counter(h[3] for h in hits).items()))


def char_signals(text: str, hits: list[tuple], twins: list[tuple]) -> list[dict]:
    of = {kind: [h for h in hits if h[2] in names] for kind, names in (("hidden", ("zero_width", "tag_char", "variation_selector")), ("bidi", ("bidi_control",)), ("space", ("exotic_space",)))}
    out = []

    def near(found: list[tuple]) -> list[tuple]:
        return [("char", f"{h[3]} near: {context(text, h[0])}", h[0], 1) for h in found[:SHOWN]]

    if found := of["hidden"]:
        even = regularity([h[0] for h in found])
        pattern = [("pattern", f"evenly spaced, regularity {even:.2f}", None, 1)] if even > 0.5 else []
        out.append(_signal(1, "invisible_characters", "covert_channel", min(0.99, step_of(len(found), INVISIBLE_STEPS) + 0.08 * even), 1.0, [("summary", _by_label(found), None, 1), *pattern, *near(found)]))
    if found := of["bidi"]:
        out.append(_signal(2, "bidi_controls", "obfuscation", step_of(len(found), BIDI_STEPS), 0.9, near(found)))
    if twins:
        shown = [("char", f"'{c}' (U+{ord(c):04X}, {script}) for '{latin}' in \"{word}\"", at, 1) for at, c, latin, script, word in twins[:SHOWN]]
        words = ", ".join(sorted({t[4] for t in twins})[:TOP_WORDS])
        out.append(_signal(3, "homoglyph_substitution", "obfuscation", step_of(len(twins), HOMOGLYPH_STEPS), 0.95, [*shown, ("summary", f"words: {words}", None, 1)]))
    if found := of["space"]:
        even = regularity([h[0] for h in found])
        out.append(_signal(4, "exotic_whitespace", "obfuscation", min(0.8, step_of(len(found), EXOTIC_STEPS) + 0.25 * even), 0.5, [("summary", _by_label(found), None, 1)]))
    return out


def style_signals(normal: str) -> list[dict]:
    """Signals of typography, repetition and layout, from the text with plain spaces."""
    out = []
    dashes, dots, hyphens = normal.count("—"), normal.count("…"), normal.count("‑")
    curly, straight = sum(map(normal.count, CURLY)), sum(map(normal.count, QUOTES))
    curled = curly / (curly + straight) if curly + straight else 0.0
    score = min(0.75, (dashes + dots + hyphens) * 1000.0 / max(len(normal), 1) / 6.0 + curled * 0.35)
    if score >= 0.12:
        out.append(_signal(5, "typographic_fingerprint", "stylistic", score, 0.35, [("summary", f"em dash x{dashes}, ellipsis x{dots}, non-breaking hyphen x{hyphens}, curly quotes {curled:.0%}", None, 1)]))
    lower = [w.lower() for w in spans._WORD.findall(normal)]
    if len(lower) >= LEAST_GRAM_WORDS:
        grams = Counter(zip(*(lower[i:] for i in range(GRAM)), strict=False))
        again = [(g, n) for g, n in grams.items() if n > 1]
        score = min(0.7, 5.0 * sum(n for _, n in again) / (len(lower) - GRAM + 1))
        if again and score >= 0.12:
            top = sorted(again, key=lambda x: -x[1])[:TOP_GRAMS]
            out.append(_signal(6, "ngram_recycling", "stylistic", score, 0.3, [("ngram", f'"{" ".join(g)}" x{n}', None, 1) for g, n in top]))
    lines = [line for line in normal.splitlines() if line.strip()]
    if len(lines) >= LEAST_LINES:
        bullets, headings, bold = sum(bool(LIST_LINE.match(line)) for line in lines), sum(1 for _ in HEADING.finditer(normal)), normal.count("**") // 2
        score = min(0.6, (bullets + headings) / len(lines) * 0.9 + min(bold, 12) * 0.02)
        if score >= 0.15:
            out.append(_signal(7, "structural_uniformity", "stylistic", score, 0.25, [("summary", f"{bullets} list lines, {headings} headings, {bold} bold runs in {len(lines)} lines", None, 1)]))
    return out


# -- segments ------------------------------------------------------------------------------------

# Window words, overlap and most segments by mode.
MODES = {"quick": (250, 0, 25), "forensic": (120, 30, 300)}
PREVIEW = 180


def segment_label(v: float) -> str:
    return "assistant" if v >= 0.75 else "leaning_assistant" if v >= 0.55 else "human" if v <= 0.3 else "leaning_human" if v <= 0.45 else "mixed"


def windows_of(text: str, mode: str) -> list[tuple[int, int]]:
    return spans.bounded_ranges(text, spans.word_starts(text), *MODES[mode])


def segments_of(text: str, language: str, offsets: list[int], mode: str) -> tuple[list[dict], list[dict]]:
    """(segments without their style, the measures of each); offsets of hits ascend."""
    out, measured = [], []
    for i, (a, b) in enumerate(windows_of(text, mode)):
        seen = spans.visible(text[a:b].strip())
        m = measure(seen, language)
        line = seen.strip().replace("\n", " ")
        hits = bisect_left(offsets, b) - bisect_left(offsets, a)
        out.append({"index": i, "start": a, "end": b, "word_count": m["n_words"], "preview": line[:PREVIEW] + ("..." if len(line) > PREVIEW else ""), "watermark_hits": hits})
        measured.append(m)
    return out, measured


def with_style(found: list[dict], measured: list[dict]) -> list[dict]:
    from ..operators.style import values_of

    for s, v in zip(found, values_of(measured), strict=True):
        s |= {"llm_likelihood": round(v, 4), "label": segment_label(v)}
    return found


# -- the passes ----------------------------------------------------------------------------------

MEASURES = pa.struct([("language", pa.string()), ("language_confidence", pa.float64())] + [(k, pa.int32()) for k in SIZES] + [(k, pa.float64()) for k in FEATURES])
_EVIDENCE = pa.struct([("kind", pa.string()), ("detail", pa.string()), ("offset", pa.int32()), ("length", pa.int32())])
SIGNAL = pa.struct([("id", pa.string()), ("category", pa.string()), ("title", pa.string()), ("description", pa.string()), ("score", pa.float64()), ("weight", pa.float64()), ("severity", pa.string()), ("rank", pa.int32()), ("evidence", pa.list_(_EVIDENCE)), ("evidence_total", pa.int32())])
SEGMENT = pa.struct([("index", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("word_count", pa.int32()), ("preview", pa.string()), ("llm_likelihood", pa.float64()), ("label", pa.string()), ("watermark_hits", pa.int32())])
SCRIPT = pa.struct([("script", pa.string()), ("n", pa.int32())])
CARRIER = pa.struct([("note", pa.string()), ("first", pa.int32()), ("last", pa.int32())])
STUDY = pa.struct([
    ("cleaned_chars", pa.int32()), ("measures", MEASURES), ("scripts", pa.list_(SCRIPT)), ("found", pa.list_(SIGNAL)), ("carriers", pa.list_(CARRIER)), ("segments", pa.list_(SEGMENT)),
    ("hits", pa.int32()), ("homoglyphs", pa.int32()), ("bold_run_rate", pa.float64()), ("opening_pleasantry", pa.float64()),
])


def spark_type(t: pa.DataType) -> T.DataType:
    if pa.types.is_struct(t):
        return T.StructType([T.StructField(f.name, spark_type(f.type)) for f in t])
    if pa.types.is_list(t):
        return T.ArrayType(spark_type(t.value_type))
    return {pa.string(): T.StringType(), pa.float64(): T.DoubleType(), pa.int32(): T.IntegerType()}[t]


def layout(cleaned: str) -> tuple[float, float]:
    """(bold runs a filled line, 1 where the text opens with a pleasantry)."""
    lines = sum(1 for line in cleaned.splitlines() if line.strip())
    return sum(1 for _ in BOLD.finditer(cleaned)) / max(lines, 1), float(bool(OPENING.match(cleaned)))


def study(text: str | None, mode: str = "forensic") -> tuple[dict, list[dict]]:
    """(all of STUDY but the segments' style, measures of the segments).  Null counts as empty."""
    text = text or ""
    normal = spans.normalized(text)
    cleaned = spans.visible(normal)
    hits, twins = char_hits(text), look_alikes(text)
    m = measure(cleaned)
    # spaces of unusual width are visible: they count as hits of the scan, not of a segment
    offsets = sorted([h[0] for h in hits if h[2] != "exotic_space"] + [t[0] for t in twins])
    found, measured = segments_of(text, m["language"], offsets, mode)
    bold, opening = layout(cleaned)
    return {
        "cleaned_chars": len(cleaned), "measures": m, "scripts": [{"script": s, "n": n} for s, n in scripts(cleaned).items()], "found": char_signals(text, hits, twins) + style_signals(normal),
        "carriers": carriers(text), "segments": found, "hits": len(hits), "homoglyphs": len(twins), "bold_run_rate": bold, "opening_pleasantry": opening,
    }, measured


def studied(c: Column, mode: str = "forensic") -> Column:
    """The struct STUDY of a text."""

    @F.arrow_udf(spark_type(STUDY))
    def run(texts: pa.Array) -> pa.Array:
        rows = [study(t, mode) for t in texts.to_pylist()]
        with_style([s for r, _ in rows for s in r["segments"]], [m for _, ms in rows for m in ms])
        return pa.array([r for r, _ in rows], STUDY)

    return run(c)


def measured(c: Column, language: Column | None = None) -> Column:
    """The struct MEASURES of a text, in the given language or the one detected.  Null counts as empty."""

    @F.arrow_udf(spark_type(MEASURES))
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([measure(t or "") for t in texts.to_pylist()], MEASURES)

    @F.arrow_udf(spark_type(MEASURES))
    def run_in(texts: pa.Array, codes: pa.Array) -> pa.Array:
        return pa.array([measure(t or "", code or "unknown") for t, code in zip(texts.to_pylist(), codes.to_pylist(), strict=True)], MEASURES)

    return run(c) if language is None else run_in(c, language)


def laid_out(c: Column) -> Column:
    """struct<bold_run_rate, opening_pleasantry> of a cleaned text."""
    kind = pa.struct([("bold_run_rate", pa.float64()), ("opening_pleasantry", pa.float64())])

    @F.arrow_udf(spark_type(kind))
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([dict(zip(("bold_run_rate", "opening_pleasantry"), layout(t or ""), strict=True)) for t in texts.to_pylist()], kind)

    return run(c)


def signalled(c: Column) -> Column:
    """struct<found, carriers> of a text: its signals without those of payloads."""
    kind = pa.struct([("found", pa.list_(SIGNAL)), ("carriers", pa.list_(CARRIER))])

    @F.arrow_udf(spark_type(kind))
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([{"found": char_signals(t, char_hits(t), look_alikes(t)) + style_signals(spans.normalized(t)), "carriers": carriers(t)} for t in ((x or "") for x in texts.to_pylist())], kind)

    return run(c)


def segmented(c: Column, language: Column, mode: str = "forensic") -> Column:
    """array<SEGMENT> of a text whose language is known."""

    @F.arrow_udf(spark_type(pa.list_(SEGMENT)))
    def run(texts: pa.Array, codes: pa.Array) -> pa.Array:
        rows = []
        for t, code in zip(((x or "") for x in texts.to_pylist()), codes.to_pylist(), strict=True):
            offsets = sorted([h[0] for h in char_hits(t) if h[2] != "exotic_space"] + [x[0] for x in look_alikes(t)])
            rows.append(segments_of(t, code or "unknown", offsets, mode))
        with_style([s for r, _ in rows for s in r], [m for _, ms in rows for m in ms])
        return pa.array([r for r, _ in rows], pa.list_(SEGMENT))

    return run(c, language)


__all__ = ["FEATURES", "MODES", "SIZES", "measured", "segmented", "signalled", "studied"]
