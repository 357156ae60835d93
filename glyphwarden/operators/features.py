"""Language, moving type share and n-grams as Column expressions; the twenty measures from one Arrow pass.  No shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicons as lex
from ..functions import study
from ..functions.codepoints import WHITE_SET
from ..functions.rounding import rounded
from ..functions.text import in_list, let, matches, words

FEATURES = study.FEATURES
WINDOW = 50
#: Line ends as Python's splitlines() knows them.
LINE_END = r"\r\n|[\n\x0B\x0C\r\x{1C}-\x{1E}\x{85}\x{2028}\x{2029}]"
# The patterns of slips and bullets.
BULLET = r"(?m)^[\s\x{1C}-\x{1F}\x{85}\x{A0}]*(?:[-*•‣·]|\d+[.)]|[a-z][.)])\s+"
DOUBLE_SPACE = rf"(?<=[^{WHITE_SET}])  +(?=[^{WHITE_SET}])"
SPACE_BEFORE = rf"[{WHITE_SET}]+[,;:!?](?=[{WHITE_SET}]|\z)"
REPEATED = r"[!?]{2,}|\.{4,}|,{2,}"
MISSING_SPACE = r"[a-ząćęłńóśźż],[a-ząćęłńóśźż]"


def language_scores(tokens: Column, lowered: Column) -> Column:
    """array<struct<score,rank,code>> of the stop-word share of the first 2000 words with a bonus for telling letters."""
    head = F.slice(tokens, 1, 2000)
    out = []
    for rank, (code, stops) in enumerate(lex.STOPWORDS.items()):
        share = in_list(head, stops) / F.size(head)
        if code in lex.HINTS:
            share = share + F.least(F.lit(0.15), matches(lowered, f"[{lex.HINTS[code]}]") / F.greatest(F.length(lowered), F.lit(1)) * 6.0)
        out.append(F.struct(rounded(share, 4).alias("score"), F.lit(-rank).alias("rank"), F.lit(code).alias("code")))
    return F.array(*out)


def detect_language(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with language and language_confidence; unknown where no language reaches 0.08."""
    named = docs.withColumn("__tok", F.transform(words(F.col(text)), F.lower)).withColumn("__low", F.lower(text))
    scored = named.withColumn("__s", F.when(F.size("__tok") > 0, F.reverse(F.array_sort(language_scores(F.col("__tok"), F.col("__low"))))))
    best, next_best = F.get("__s", F.lit(0)), F.get("__s", F.lit(1))
    clear = best["score"] >= 0.08
    confidence = F.when(clear, rounded(F.least(F.lit(1.0), 0.5 + (best["score"] - next_best["score"]) * 6), 3)).otherwise(rounded(best["score"] * 4, 3))
    return scored.withColumn("language", F.when(clear, best["code"]).otherwise("unknown")).withColumn("language_confidence", F.coalesce(confidence, F.lit(0.0))).drop("__tok", "__low", "__s")


def moving_types(tokens: Column, window: int = WINDOW) -> Column:
    """Mean share of distinct words over windows a fifth apart; of the whole below one window."""
    n = F.size(tokens)
    starts = F.sequence(F.lit(1), n - window + 1, F.lit(window // 5))
    shares = F.transform(starts, lambda i: F.size(F.array_distinct(F.slice(tokens, i, window))) / window)
    mean = let(shares, lambda v: F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / F.size(v))
    return F.when(n == 0, 0.0).when(n <= window, F.size(F.array_distinct(tokens)) / n).otherwise(mean)


def typo_hits(text: Column, lowered: Column) -> Column:
    """Slips of four kinds: double blanks within a line, a blank before a sign, repeated signs, no blank after a comma."""
    return matches(text, DOUBLE_SPACE) + matches(text, SPACE_BEFORE) + matches(text, REPEATED) + matches(lowered, MISSING_SPACE)


def filled_lines(text: Column) -> Column:
    return F.filter(F.split(text, LINE_END), lambda s: s.rlike(f"[^{WHITE_SET}]"))


def measure(docs: DataFrame, text: str = "text", language: str | None = None) -> DataFrame:
    """docs with the twenty measures, language, n_words, n_sentences, n_paragraphs, n_chars and the source sizes.

    Text is measured as it stands; an analysis measures the cleaned one.  `language` names a
    column that has it; it is detected otherwise.  Null texts count as empty.
    """
    df = docs.withColumn("__m", study.measured(F.col(text), F.col(language) if language else None))
    return unpacked(df, "__m", detected=language is None).drop("__m")


def with_layout(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the traits of layout that profiles look at: bold_run_rate and opening_pleasantry."""
    df = docs.withColumn("__l", study.laid_out(F.col(text)))
    return df.withColumns({n: F.col(f"__l.{n}") for n in ("bold_run_rate", "opening_pleasantry")}).drop("__l")


def unpacked(df: DataFrame, struct: str, detected: bool = True) -> DataFrame:
    """df with the fields of a struct of measures as columns."""
    names = [*study.SIZES, *FEATURES] + ["language", "language_confidence"] * detected
    return df.withColumns({n: F.col(f"{struct}.{n}") for n in names})


def repeated_grams(tokens: Column, n: int = 5) -> Column:
    """The n-grams of words of a text, as strings."""
    return F.when(F.size(tokens) >= n, F.transform(F.sequence(F.lit(1), F.size(tokens) - n + 1), lambda i: F.array_join(F.slice(tokens, i, n), " ")))


def unpivoted(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, feature, value: a row for each measure of measured docs."""
    return docs.select(key, *FEATURES).unpivot(key, list(FEATURES), "feature", "value")
