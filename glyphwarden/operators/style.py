"""Style score from documented priors, and the likeness to five style profiles: unrolled arithmetic."""

from __future__ import annotations

from decimal import Decimal

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rounding import rounded, rounded_sql
from . import features


# Mean, standard deviation and weight of each scored measure.
PRIOR = {
    "sentence_length_cv": (0.55, 0.18, -0.85), "assistant_lexicon_rate": (0.35, 0.45, 0.95), "discourse_marker_rate": (0.55, 0.60, 0.75),
    "typo_indicator_rate": (0.55, 1.00, -0.60), "hedge_rate": (0.20, 0.35, 0.50), "contraction_rate": (0.90, 1.00, -0.45), "em_dash_rate": (0.35, 0.80, 0.45),
    "personal_pronoun_rate": (1.60, 1.60, -0.35), "paragraph_length_cv": (0.50, 0.25, -0.30), "bullet_line_ratio": (0.12, 0.22, 0.30),
    "mean_sentence_length": (17.5, 6.0, 0.30), "long_word_ratio": (0.22, 0.08, 0.25), "sentence_start_repetition": (0.18, 0.15, 0.25),
    "curly_quote_ratio": (0.35, 0.40, 0.25), "mean_word_length": (4.90, 0.70, 0.20), "exclamation_rate": (0.25, 0.70, -0.20),
    "comma_per_sentence": (1.50, 0.80, 0.15), "ellipsis_char_rate": (0.10, 0.35, 0.15),
}
BIAS, TEMPERATURE, CLIP, FULL_WORDS, LEAST_WORDS = -0.35, 0.45, 2.5, 150, 15
#: Weight by temperature of each measure: the decimal product, not that of two doubles.
SHARE = {f: float(Decimal(str(w)) * Decimal(str(TEMPERATURE))) for f, (_, _, w) in PRIOR.items()}
# Profiles as (measure, target, tolerance, direction, weight, language).
PROFILES = {
    "structured_assistant": [
        ("bullet_line_ratio", 0.30, 0.30, "at_least", 2.0, None), ("bold_run_rate", 0.15, 0.35, "at_least", 1.0, None), ("sentence_length_cv", 0.55, 0.35, "at_most", 1.0, None),
        ("discourse_marker_rate", 0.60, 1.00, "at_least", 1.0, None), ("opening_pleasantry", 1.00, 1.00, "at_least", 0.5, None),
    ],
    "prose_assistant": [
        ("bullet_line_ratio", 0.08, 0.15, "at_most", 1.5, None), ("mean_sentence_length", 18.0, 8.0, "at_least", 1.0, None), ("sentence_length_cv", 0.50, 0.30, "at_most", 1.5, None),
        ("typo_indicator_rate", 0.80, 1.20, "at_most", 1.5, None), ("discourse_marker_rate", 0.50, 0.90, "at_least", 1.0, None), ("contraction_rate", 1.50, 2.50, "at_most", 0.5, "en"),
    ],
    "marketing_copy": [
        ("assistant_lexicon_rate", 1.20, 1.40, "at_least", 2.0, None), ("exclamation_rate", 0.80, 1.50, "at_least", 1.0, None),
        ("mean_sentence_length", 15.0, 7.0, "at_most", 1.0, None), ("sentence_start_repetition", 0.25, 0.30, "at_least", 1.0, None),
    ],
    "human_unedited": [
        ("typo_indicator_rate", 1.50, 1.80, "at_least", 1.5, None), ("sentence_length_cv", 0.55, 0.35, "at_least", 1.0, None), ("personal_pronoun_rate", 2.00, 3.00, "at_least", 1.0, None),
        ("curly_quote_ratio", 0.20, 0.30, "at_most", 0.5, None), ("bullet_line_ratio", 0.10, 0.25, "at_most", 0.5, None), ("contraction_rate", 1.50, 2.50, "at_least", 1.0, "en"),
    ],
    "human_edited": [
        ("typo_indicator_rate", 0.60, 0.80, "at_most", 1.0, None), ("sentence_length_cv", 0.55, 0.30, "at_least", 1.5, None), ("curly_quote_ratio", 0.50, 0.50, "at_least", 0.75, None),
        ("bullet_line_ratio", 0.10, 0.25, "at_most", 0.5, None), ("assistant_lexicon_rate", 0.50, 0.80, "at_most", 1.0, None), ("discourse_marker_rate", 0.60, 0.90, "at_most", 1.0, None),
    ],
}
MOST_ALIKE = 0.85


def _z(feature: str) -> str:
    mean, sd, _ = PRIOR[feature]
    return f"greatest(-{CLIP}D, least({CLIP}D, ({feature} - {mean}D) / {sd}D))"


def _part(feature: str) -> str:
    """What a measure adds to the log-odds, as SQL: one string costs less to build than its many Columns."""
    part = f"{_z(feature)} * {SHARE[feature]!r}D"
    return f"if(language = 'en', {part}, 0D)" if feature == "contraction_rate" else part


def contribution_array(most: int = 10) -> Column:
    """array<struct<feature,value,z,contribution,direction>> of the strongest, by size; English contractions count in English alone."""
    every = ", ".join(f"named_struct('by', -abs({_part(f)}), 'i', {i}, 'feature', '{f}', 'value', {f}, 'z', {_z(f)}, 'part', {_part(f)})" for i, f in enumerate(PRIOR))
    return F.expr(
        f"""transform(slice(array_sort(filter(array({every}), c -> c.feature <> 'contraction_rate' or language = 'en')), 1, {most}),
            c -> named_struct('feature', c.feature, 'value', {rounded_sql('c.value', 4)}, 'z', {rounded_sql('c.z', 3)}, 'contribution', {rounded_sql('c.part', 4)}, 'direction', if(c.part > 0, 'assistant', 'human')))"""
    )


def contributions(docs: DataFrame, most: int = 10, key: str = "doc_id") -> DataFrame:
    """key, rank, feature, value, z, contribution, direction: the strongest of each document."""
    return docs.select(key, F.posexplode(contribution_array(most)).alias("rank", "c")).select(key, "rank", "c.*")


def values_of(measured: list[dict]) -> list[float]:
    """The unrounded style value of each record of measures: one matrix product."""
    if not measured:
        return []
    table = np.array([[m[f] for f in PRIOR] for m in measured])
    mean, sd, _ = np.array(list(PRIOR.values())).T
    z = np.clip((table - mean) / sd, -CLIP, CLIP) * np.array([SHARE[f] for f in PRIOR])
    z[:, list(PRIOR).index("contraction_rate")] *= [m["language"] == "en" for m in measured]
    n = np.array([m["n_words"] for m in measured])
    raw = 1 / (1 + np.exp(-(z.sum(axis=1) + BIAS)))
    return np.clip(0.5 + (raw - 0.5) * np.minimum(1.0, np.sqrt(n / FULL_WORDS)), 0.02, 0.98).tolist()


def shrunk(raw: Column, n_words: Column) -> Column:
    """A probability drawn towards a half where there is little text."""
    kept = F.least(F.lit(1.0), F.sqrt(n_words / FULL_WORDS))
    return F.greatest(F.lit(0.02), F.least(F.lit(0.98), 0.5 + (raw - 0.5) * kept))


def half_band(n_words: Column) -> Column:
    return F.greatest(F.lit(0.05), F.least(F.lit(0.35), 0.5 / F.sqrt(F.greatest(n_words, F.lit(1)) / 60.0)))


def judged(docs: DataFrame, value: Column, model: str, trained: bool, half: Column | None = None) -> DataFrame:
    """docs with style_raw (unrounded), style_value, _low, _high, _label, _confidence, _model and _trained of a value."""
    v, b, n = F.col("style_raw"), F.col("__b"), F.col("n_words")
    return docs.withColumn("style_raw", value).withColumn("__b", half_band(n) if half is None else half).withColumns({
        "style_value": rounded(v, 4), "style_low": rounded(F.greatest(F.lit(0.0), v - b), 4), "style_high": rounded(F.least(F.lit(1.0), v + b), 4),
        "style_label": F.when(n < LEAST_WORDS, "insufficient_text").when(v >= 0.85, "likely_assistant_strong").when(v >= 0.65, "likely_assistant").when(v <= 0.35, "likely_human").otherwise("inconclusive"),
        "style_confidence": F.when(n < LEAST_WORDS, "none").when((b <= 0.12) & (n >= 250), "high").when(b <= 0.22, "medium").otherwise("low"),
        "style_model": F.lit(model), "style_trained": F.lit(trained),
    }).drop("__b")


def style_score(docs: DataFrame) -> DataFrame:
    """Measured docs, judged by the documented priors."""
    total = F.expr(f"{BIAS}D + " + " + ".join(map(_part, PRIOR)))
    return judged(docs, shrunk(1 / (1 + F.exp(-total)), F.col("n_words")), "prior-logistic", False)


def trained_score(docs: DataFrame, probability: str = "style_probability") -> DataFrame:
    """Measured docs, judged by a trained model's probability: the same shrinking, band and labels."""
    return judged(docs, shrunk(F.col(probability), F.col("n_words")), "trained-logistic", True)


def style_notes(docs: DataFrame) -> Column:
    """What limits a style score."""
    n = F.col("n_words")
    return F.filter(F.array(
        F.when(n < LEAST_WORDS, F.format_string("%d words: too few for a verdict", n)).when((n < FULL_WORDS) & ~F.col("style_trained"), F.format_string("%d words, fewer than %d: the score is drawn towards a half", n, F.lit(FULL_WORDS))),
        F.when((F.col("language") == "unknown") & ~F.col("style_trained"), "language unknown: English lists were used"),
        F.when(F.col("style_trained"), "scored by a model fitted on labelled texts").otherwise("weights are documented priors, not fitted"),
    ), lambda x: x.isNotNull())


def likeness(traits: list[tuple]) -> str:
    """Likeness to a profile, as SQL: 1 less the weighted mean of penalties of the traits that its language allows."""
    penalties, weights = [], []
    for name, target, tolerance, direction, weight, language in traits:
        away = {"at_least": f"greatest(0D, {target}D - {name})", "at_most": f"greatest(0D, {name} - {target}D)"}.get(direction, f"abs({name} - {target}D)")
        penalty, share = f"least(1D, {away} / {max(tolerance, 1e-6)}D) * {weight}D", f"{weight}D"
        penalties.append(f"if(language = '{language}', {penalty}, 0D)" if language else penalty)
        weights.append(f"if(language = '{language}', {share}, 0D)" if language else share)
    return rounded_sql(f"least({MOST_ALIKE}D, greatest(0D, 1 - ({' + '.join(penalties)}) / ({' + '.join(weights)})))", 4)


def profile_array(most: int = 3) -> Column:
    """array<struct<family,similarity>> of the most alike profiles, from columns of measures, bold_run_rate and opening_pleasantry."""
    every = ", ".join(f"named_struct('by', -{likeness(traits)}, 'i', {i}, 'family', '{family}')" for i, (family, traits) in enumerate(PROFILES.items()))
    return F.expr(f"transform(slice(array_sort(array({every})), 1, {most}), p -> named_struct('family', p.family, 'similarity', -p.by))")


def profiles(docs: DataFrame, most: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, rank, family, similarity of the most alike profiles of measured docs; traits of layout are taken from the text where they are missing."""
    if "bold_run_rate" not in docs.columns:
        docs = features.with_layout(docs, text)
    return docs.select(key, F.posexplode(profile_array(most)).alias("rank", "p")).select(key, "rank", "p.family", "p.similarity")


def blended(docs: DataFrame, surprisal: str) -> DataFrame:
    """Judged docs whose score takes three tenths of a language model's signal where there is one: clipped, rounded, with a band wider by 0.02."""
    s, v = F.col(surprisal), rounded(F.greatest(F.lit(0.02), F.least(F.lit(0.98), 0.7 * F.col("style_raw") + 0.3 * F.col(surprisal))), 4)
    return docs.withColumns({
        "style_raw": F.when(s.isNull(), F.col("style_raw")).otherwise(v), "style_value": F.when(s.isNull(), F.col("style_value")).otherwise(v),
        "style_low": F.when(s.isNull(), F.col("style_low")).otherwise(rounded(F.greatest(F.lit(0.0), F.col("style_low") - 0.02), 4)),
        "style_high": F.when(s.isNull(), F.col("style_high")).otherwise(rounded(F.least(F.lit(1.0), F.col("style_high") + 0.02), 4)),
    })


def surprisal_signal(mean: Column, cv: Column) -> Column:
    """Evenness of surprisal: low and even reads as generated."""
    def between(x: Column, lo: float, hi: float) -> Column:
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x - lo) / (hi - lo)))

    return 0.65 * between(mean, 4.5, 2.5) + 0.35 * between(cv, 0.85, 0.55)


def surprisal_summary(surprisals: Column, least: int = 8) -> Column:
    """struct<available, reason, mean, cv, perplexity, signal> of an array of surprisals in nats; unavailable below `least` tokens."""
    n = F.size(surprisals)
    mean = F.aggregate(surprisals, F.lit(0.0), lambda a, x: a + x) / n
    spread = F.sqrt(F.aggregate(surprisals, F.lit(0.0), lambda a, x: a + x * x) / n - mean * mean)
    enough = F.coalesce(n >= least, F.lit(False))
    cv = F.when(mean > 0, spread / mean).otherwise(0.0)
    return F.struct(
        enough.alias("available"), F.when(~enough, "too few tokens, or no language model").alias("reason"), F.when(enough, rounded(mean, 4)).alias("mean"), F.when(enough, rounded(cv, 4)).alias("cv"),
        F.when(enough, rounded(F.exp(mean), 3)).alias("perplexity"), F.when(enough, rounded(surprisal_signal(mean, cv), 4)).alias("signal"))
