"""Abbreviations before several signs."""

from glyphwarden.functions import spans


def test_more_signs_after_an_abbreviation_end_a_sentence():
    assert [x[2] for x in spans.sentences("ON!! ST.!! THEN no. 5 etc.) more. No... End")] == ["ON!!", "ST.!!", "THEN no. 5 etc.) more.", "No...", "End"]
    # the measures, windows and segments keep the wider rule, as their SQL does
    assert len(spans.sentence_ranges("ON!! ST.!! THEN")) == 2
