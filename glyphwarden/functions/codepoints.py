"""The character dimension: classes of code points, as fixed values and as regex classes.

Spark counts code points in length/substring/split(''), so every offset in this
library is a 0-based code point offset.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Code points and their Unicode names.
ZERO_WIDTH = {
    0x200B: "ZERO WIDTH SPACE",
    0x200C: "ZERO WIDTH NON-JOINER",
    0x200D: "ZERO WIDTH JOINER",
    0x2060: "WORD JOINER",
    0x2061: "FUNCTION APPLICATION",
    0x2062: "INVISIBLE TIMES",
    0x2063: "INVISIBLE SEPARATOR",
    0x2064: "INVISIBLE PLUS",
    0xFEFF: "ZERO WIDTH NO-BREAK SPACE (BOM)",
    0x180E: "MONGOLIAN VOWEL SEPARATOR",
}
BIDI_CONTROL = {cp: unicodedata.name(chr(cp)) for cp in (0x200E, 0x200F, *range(0x202A, 0x202F), *range(0x2066, 0x206A))}
FORMAT_CONTROL = {cp: unicodedata.name(chr(cp)) for cp in (0x00AD, 0x034F, 0x115F, 0x1160, 0x3164, 0xFFA0)}
EXOTIC_SPACE = {cp: unicodedata.name(chr(cp)) for cp in (0x00A0, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000)}
# Letters of other scripts that look Latin (Cyrillic, Greek, fullwidth, Armenian, Cherokee).
LOOK_ALIKES = "аеорсухіјһАВЕКМНОРСТУХЅІЈ" "οαβεικνρτχΑΒΕΖΗΙΚΜΝΟΡΤΥΧ" "ａｅｏ" "\u0585\u13A0\u13C0"
LATIN_TWINS = "aeopcyxijhABEKMHOPCTYXSIJ" "oabeikvptxABEZHIKMNOPTYX" "aeo" "oDG"
# Scripts told apart by character name, and those that spell with joiners.
SCRIPTS = ("CYRILLIC", "GREEK", "ARMENIAN", "HEBREW", "ARABIC", "CHEROKEE", "FULLWIDTH", "LATIN")
JOINING = ("ARABIC", "SYRIAC", "THAANA", "DEVANAGARI", "BENGALI", "GURMUKHI", "GUJARATI", "ORIYA", "TAMIL", "TELUGU", "KANNADA", "MALAYALAM", "SINHALA", "MYANMAR", "KHMER", "HEBREW")

INVISIBLE = ("zero_width", "bidi_control", "variation_selector", "tag_char", "format_control")


def regex_set(cps) -> str:
    """The inside of a regex class for code points, neighbours as ranges."""
    out, run = [], []
    for cp in sorted(cps):
        if run and cp == run[-1] + 1:
            run.append(cp)
            continue
        if run:
            out.append(run)
        run = [cp]
    out.append(run)
    return "".join(f"\\x{{{r[0]:X}}}" + (f"-\\x{{{r[-1]:X}}}" if len(r) > 1 else "") for r in out)


SELECTOR_SET = r"\x{FE00}-\x{FE0F}\x{E0100}-\x{E01EF}"
TAG_SET = r"\x{E0000}-\x{E007F}"
INVISIBLE_SET = regex_set([*ZERO_WIDTH, *BIDI_CONTROL, *FORMAT_CONTROL]) + SELECTOR_SET + TAG_SET
EXOTIC_SET = regex_set(EXOTIC_SPACE)
SUSPICIOUS_SET = INVISIBLE_SET + EXOTIC_SET
#: What Python calls white space, spelled out: Java's \s is ASCII only.
WHITE_SET = r"\x{9}-\x{D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
#: Pictographs of the scanner; the sanitizer knows fewer.
PICTOGRAPH_SET = r"\x{1F000}-\x{1FAFF}\x{2600}-\x{27BF}\x{2190}-\x{21FF}\x{A9}\x{AE}\x{203C}\x{2049}"
SCAN_PICTOGRAPH_SET = PICTOGRAPH_SET + r"\x{2B00}-\x{2BFF}\x{3030}-\x{303D}\x{2122}\x{2139}"


def _name_set(test) -> str:
    return regex_set(cp for cp in range(0x110000) if not 0xD800 <= cp <= 0xDFFF and test(chr(cp)))


def joining_set() -> str:
    """Characters whose names start with a script that spells with joiners."""
    return _name_set(lambda c: unicodedata.name(c, "").startswith(JOINING))


def rtl_set() -> str:
    return _name_set(lambda c: unicodedata.bidirectional(c) in ("R", "AL", "AN"))


def cjk_set() -> str:
    return _name_set(lambda c: unicodedata.name(c, "").startswith("CJK"))


def code_point(c: Column) -> Column:
    return F.ascii(c)


def char_of(cp: Column) -> Column:
    """The character of a code point; chr() would take it modulo 256."""
    return F.decode(F.unhex(F.lpad(F.hex(cp), 8, "0")), "UTF-32")


def label_of(cp: Column, name: Column) -> Column:
    h = F.hex(cp)
    return F.concat(F.lit("U+"), F.when(F.length(h) < 4, F.lpad(h, 4, "0")).otherwise(h), F.lit(" "), name)


def category_of(cp: Column) -> Column:
    """Class of a code point, null for an ordinary character."""
    return (
        F.when(cp.isin(*ZERO_WIDTH), "zero_width").when(cp.isin(*BIDI_CONTROL), "bidi_control").when(cp.isin(*FORMAT_CONTROL), "format_control")
        .when(cp.isin(*EXOTIC_SPACE), "exotic_space").when(cp.between(0xFE00, 0xFE0F) | cp.between(0xE0100, 0xE01EF), "variation_selector")
        .when(cp.between(0xE0000, 0xE007F), "tag_char")
    )


def name_of(cp: Column) -> Column:
    named = {**ZERO_WIDTH, **BIDI_CONTROL, **FORMAT_CONTROL, **EXOTIC_SPACE}
    fixed = F.create_map(*(x for k, v in named.items() for x in (F.lit(k), F.lit(v))))
    selector = F.concat(F.lit("VARIATION SELECTOR-"), F.when(cp <= 0xFE0F, cp - 0xFE00 + 1).otherwise(cp - 0xE0100 + 17).cast("string"))
    return F.when(category_of(cp) == "variation_selector", selector).when(category_of(cp) == "tag_char", F.concat(F.lit("TAG CHARACTER U+"), F.hex(cp))).otherwise(F.element_at(fixed, cp))


def script_name(c: str) -> str:
    """Script by character name: the first of the listed ones that is a word of the name, then CJK, else OTHER."""
    name = unicodedata.name(c, "")
    if not name:
        return "UNKNOWN"
    words = name.split(" ")
    for s in SCRIPTS:
        if name.startswith(s) or s in words:
            return s
    return "CJK" if name.startswith("CJK") else "OTHER"


def script_dimension(spark: SparkSession) -> DataFrame:
    """(ch, script) of all letters outside the large unnamed planes: a fixed table of about 140,000 rows at most."""
    rows = [(chr(cp), script_name(chr(cp))) for cp in range(0x80, 0x30000) if not 0xD800 <= cp <= 0xDFFF and chr(cp).isalpha() and not 0x3400 <= cp <= 0x9FFF and not 0xAC00 <= cp <= 0xD7A3 and cp < 0x20000]
    return spark.createDataFrame(rows, "ch string, script string")


def script_of(c: Column) -> Column:
    """Script of a letter without a join, for the letters that Latin-script text meets; others are OTHER."""
    cp = code_point(c)
    runs = _script_runs()
    out = None
    for lo, hi, s in runs:
        cond = cp.between(lo, hi)
        out = F.when(cond, s) if out is None else out.when(cond, s)
    return out.otherwise("OTHER")


def _script_runs() -> list[tuple[int, int, str]]:
    """Ranges of letters of one listed script, gaps of non-letters closed."""
    runs: list[list] = []
    for cp in range(0x41, 0x20000):
        if 0xD800 <= cp <= 0xDFFF or not chr(cp).isalpha():
            continue
        s = script_name(chr(cp))
        if runs and runs[-1][2] == s:
            runs[-1][1] = cp
        else:
            runs.append([cp, cp, s])
    return [tuple(r) for r in runs if r[2] != "OTHER"]
