"""Rounding at halves of the last place, where Spark, Python and SQL differ."""

from pyspark.sql import functions as F

from glyphwarden.functions import study
from glyphwarden.operators import report, style


def contributions(spark, **values) -> dict:
    row = {f: 0.0 for f in style.PRIOR} | values | {"language": "en", "doc_id": 1}
    return {r.feature: r for r in style.contributions(spark.createDataFrame([row]), most=18).collect()}


def test_contributions_by_scaled_value(spark):
    got = contributions(spark, sentence_length_cv=0.87607, mean_sentence_length=11.48)
    assert got["sentence_length_cv"].z == 1.812  # 1811.5 thousandths; its shortest text is 1.8114999...
    assert got["mean_sentence_length"].contribution == -0.1354  # 1354.4999... ten-thousandths; its shortest text is 0.13545


def test_weights_are_decimal_products():
    assert style.SHARE["mean_sentence_length"] == 0.135 and style.SHARE["sentence_length_cv"] == -0.3825


def test_measures_by_scaled_value():
    words = " ".join(["ab"] * 357 + ["c"] * 283)  # 997 letters in 640 words: 1.5578125, whose exact value is above the half
    assert study.measure(words, "en")["mean_word_length"] == 1.557812
    text = "!a!a!" + "a" * 3067  # 3 in 3,072 characters: 0.9765625
    assert len(text) == 3072 and study.measure(text, "en")["exclamation_rate"] == 0.976562
    assert study.half_up(1 / 32, 4) == 0.0313


def test_risk_by_scaled_value(spark):
    def risk(w: float) -> float:
        return spark.range(1).select(report.risk_score(F.lit(w), F.lit("clean"), F.lit(0.5), F.lit("inconclusive")).alias("r")).first().r

    assert risk(0.7614) == 0.571  # analyse: 5710.4999... ten-thousandths
    assert risk(0.2778) == 0.2084  # analyse_distinct: 2083.5
