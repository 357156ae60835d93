"""Sentences, paragraphs and overlapping windows: the sequential part, over Arrow.

Texts are cut at breaks; words are found once, and how many of them stand in a sentence, a
paragraph or a window is a difference of two positions in their ascending starts.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterable
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import codepoints as cp

# Abbreviations that end no sentence.
ABBREVIATIONS = frozenset("mr mrs ms dr prof st vs etc e.g i.e fig no approx np itp itd tzn tj ul godz mln mld ok".split())
# What ends a sentence, what parts paragraphs, and a word.
SENTENCE_END = r"[.!?…]+[\"'”’)\]]*\s+|\n{2,}"
PARAGRAPH_GAP = r"\n\s*\n"
WORD = r"[^\W\d_]+(?:['’-][^\W\d_]+)*"
_END, _GAP, _WORD = re.compile(SENTENCE_END), re.compile(PARAGRAPH_GAP), re.compile(WORD)
#: A listed abbreviation with its full stop, at the end of a few characters.
_SHORT = re.compile(r"(?:\A|[\s(])(?:" + "|".join(sorted(map(re.escape, ABBREVIATIONS))) + r")\.*\Z", re.I)
_REACH = 12
# a schema object, not a string: workers import this module without a session
SPAN = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("text", T.StringType()), T.StructField("n_words", T.IntegerType())]))


def word_starts(text: str) -> list[int]:
    return [m.start() for m in _WORD.finditer(text)]


def filled(text: str, breaks: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """The non-blank stretches between breaks, each given by where it starts and ends."""
    edges = [(0, 0), *breaks, (len(text), len(text))]
    return [(begin, end) for (_, begin), (end, _) in zip(edges, edges[1:], strict=False) if text[begin:end].strip()]


def sentence_ranges(text: str, lone: bool = False) -> list[tuple[int, int]]:
    """Where sentences start and end.  A full stop after an abbreviation ends none; with `lone` it does where more signs follow it ("No.!!")."""

    def real(m: re.Match) -> bool:
        if m[0].isspace() or lone and m[0][1] in ".!?…":
            return True
        return not _SHORT.search(text[max(0, m.start() + 1 - _REACH) : m.start() + 1])

    return filled(text, ((m.start() + len(m[0].rstrip()), m.end()) for m in _END.finditer(text) if real(m)))


def paragraph_ranges(text: str) -> list[tuple[int, int]]:
    return filled(text, (m.span() for m in _GAP.finditer(text)))


def words_in(starts: list[int], ranges: list[tuple[int, int]]) -> list[int]:
    """How many of the ascending starts lie in each range."""
    return [bisect_left(starts, end) - bisect_left(starts, begin) for begin, end in ranges]


def window_ranges(counts: list[int], target: int, overlap: int, least: int = 25) -> list[tuple[int, int]]:
    """(first sentence, one past the last) of windows over sentences with these numbers of words.

    A window is the fewest sentences with `target` words; the next one begins with the fewest last
    sentences that have `overlap` words, but later than its predecessor.  A last window of
    fewer than `least` words belongs to the one before.
    """
    if overlap >= target:
        raise ValueError("overlap must be smaller than target")
    before = [0, *accumulate(counts)]  # words before each sentence
    n, out = len(counts), []
    begin = end = 0
    while end < n:
        if out:
            begin = max(begin + 1, bisect_right(before, before[end] - overlap, 0, end + 1) - 1)
        end = min(n, bisect_left(before, before[begin] + target, begin + 1))
        out.append((begin, end))
    if len(out) > 1 and before[out[-1][1]] - before[out[-1][0]] < least:
        out[-2:] = [(out[-2][0], n)]
    return out


def bounded_ranges(text: str, starts: list[int], target: int, overlap: int, most: int, least: int = 25) -> list[tuple[int, int]]:
    """Where the windows of a text start and end; with more than `most` of them they are cut larger in proportion."""
    sentences = sentence_ranges(text)
    counts = words_in(starts, sentences)
    found = window_ranges(counts, target, overlap, least)
    if len(found) > most:
        wide = int(target * (len(found) / most))
        found = window_ranges(counts, wide + 1, min(overlap, wide // 2), least)[:most]
    return [(sentences[a][0], sentences[b - 1][1]) for a, b in found]


def _rows(text: str, ranges: list[tuple[int, int]], starts: list[int] | None = None) -> list[tuple[int, int, str, int]]:
    counts = words_in(word_starts(text) if starts is None else starts, ranges)
    return [(a, b, text[a:b].strip(), n) for (a, b), n in zip(ranges, counts, strict=True)]


def sentences(text: str) -> list[tuple[int, int, str, int]]:
    return _rows(text, sentence_ranges(text, lone=True))


def paragraphs(text: str) -> list[tuple[int, int, str, int]]:
    return _rows(text, paragraph_ranges(text))


def windows(text: str, target: int = 120, overlap: int = 30, most: int = 1 << 30) -> list[tuple[int, int, str, int]]:
    starts = word_starts(text)
    return _rows(text, bounded_ranges(text, starts, target, overlap, most), starts)


_EXOTIC = re.compile("[" + "".join(map(chr, cp.EXOTIC_SPACE)) + "]")
_INVISIBLE = re.compile("[" + "".join(map(chr, (*cp.ZERO_WIDTH, *cp.BIDI_CONTROL, *cp.FORMAT_CONTROL))) + "\uFE00-\uFE0F\U000E0100-\U000E01EF\U000E0000-\U000E007F]")
_FENCE = re.compile(r"\s*(?:```|~~~)")


def normalized(text: str) -> str:
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    return text if text.isascii() else unicodedata.normalize("NFC", _EXOTIC.sub(" ", text))


def visible(text: str) -> str:
    return text if text.isascii() else _INVISIBLE.sub("", text)


def without_fences(text: str) -> str:
    """Fenced blocks blanked, line by line; an open fence blanks the rest."""
    if "```" not in text and "~~~" not in text:
        return text
    lines = text.split("\n")
    edges = [bool(_FENCE.match(line)) for line in lines]
    # a line is prose when an even number of edges stands before it and it is none itself
    return "\n".join(line if not edge and k % 2 == 0 else "" for line, edge, k in zip(lines, edges, accumulate(edges), strict=True))


@F.pandas_udf(T.StringType())
def _cleaned(s: pd.Series) -> pd.Series:
    return s.map(lambda t: visible(normalized(t)), na_action="ignore")


def cleaned(c: Column) -> Column:
    """Plain spaces and line ends, NFC, nothing invisible: what is measured of a text."""
    return _cleaned(c)


@F.pandas_udf(SPAN)
def _sentences(s: pd.Series) -> pd.Series:
    return s.map(lambda t: sentences(t) if t else [])


@F.pandas_udf(SPAN)
def _paragraphs(s: pd.Series) -> pd.Series:
    return s.map(lambda t: paragraphs(t) if t else [])


def sentence_spans(c: Column) -> Column:
    return _sentences(c)


def paragraph_spans(c: Column) -> Column:
    return _paragraphs(c)


def window_spans(c: Column, target: int = 120, overlap: int = 30, most: int = 300) -> Column:
    @F.pandas_udf(SPAN)
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: windows(t, target, overlap, most) if t else [])

    return run(c)
