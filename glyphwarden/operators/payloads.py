"""Encoders and decoders of the three hidden channels, in higher-order functions alone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.codepoints import SELECTOR_SET, TAG_SET, char_of, code_point
from ..functions.text import let, matches, printable_ratio

CHANNELS = ("tag_characters", "variation_selectors", "zero_width_binary")
# Which zero-width character says 0 and which 1, in the order tried.
ALPHABETS = (("\u200b", "\u200c"), ("\u200c", "\u200b"), ("\u200b", "\u200d"), ("\u200d", "\u200b"), ("\u200c", "\u200d"), ("\u2060", "\u200b"))
NOTES = {"tag_characters": "Unicode tag block (U+E0000-U+E007F)", "variation_selectors": "Variation selector byte encoding (VS1-VS256)"}
# Signs that a message may hold beside letters, digits and white space.
MESSAGE_SIGNS = r"\-_.:;,/|@#()\[\]{}+=*?!'\"<>%$&~^`"


def _bytes(text: Column) -> Column:
    """Numbers of the UTF-8 bytes of a text."""
    h = F.hex(F.encode(text, "UTF-8"))
    return F.transform(F.sequence(F.lit(0), (F.length(h) / 2).cast("int") - 1), lambda i: F.conv(F.substring(h, i * 2 + 1, F.lit(2)), 16, 10).cast("int"))


def encode(channel: str, payload: Column) -> Column:
    """The carrier characters of a payload; the tag channel holds printable ASCII alone and drops the rest."""
    if channel == "tag_characters":
        return F.array_join(F.transform(F.regexp_extract_all(payload, F.lit("[ -~]"), F.lit(0)), lambda c: char_of(code_point(c) + 0xE0000)), "")
    if channel == "variation_selectors":
        return F.array_join(F.transform(_bytes(payload), lambda b: char_of(F.when(b < 16, b + 0xFE00).otherwise(b - 16 + 0xE0100))), "")
    bits = F.array_join(F.transform(_bytes(payload), lambda b: F.lpad(F.bin(b), 8, "0")), "")
    return F.translate(bits, "01", "".join(ALPHABETS[0]))


def _text_of(hexed: Column, channel: str, note: Column, n_bytes: Column, first: Column, speculative: bool = False) -> Column:
    """The payload struct of bytes given in hex; null where they are not worth showing."""

    def shown(v: Column) -> Column:
        said = F.when(v["utf8"].isNull(), F.concat(note, F.lit(" (not valid UTF-8, shown as Latin-1)"))).otherwise(note)
        good = (n_bytes >= 2) & (v["ratio"] >= 0.8)
        if speculative:
            good = good & _message(v["text"])
        made = F.struct(F.lit(channel).alias("channel"), v["text"].alias("text"), n_bytes.cast("int").alias("byte_length"), v["ratio"].alias("printable_ratio"), first.alias("n_carriers"), said.alias("note"))
        return F.when(good, made)

    def rated(v: Column) -> Column:
        return let(F.struct(v["utf8"].alias("utf8"), v["text"].alias("text"), printable_ratio(v["text"]).alias("ratio")), shown)

    def read(raw: Column) -> Column:
        utf8 = F.try_validate_utf8(raw.cast("string"))
        return let(F.struct(utf8.alias("utf8"), F.coalesce(utf8, F.decode(raw, "ISO-8859-1")).alias("text")), rated)

    return let(F.unhex(hexed), read)


def _message(text: Column) -> Column:
    """Could this be language: three distinct characters, none above 60 %, no control codes, 80 % of message characters."""
    def fits(kinds: Column) -> Column:
        most = F.array_max(F.transform(kinds, lambda k: F.length(text) - F.length(F.replace(text, k))))
        signs = matches(text, r"[\p{L}\p{N}\s" + MESSAGE_SIGNS + "]")
        return (F.size(kinds) >= 3) & ~text.rlike(r"[\p{Cc}&&[^\n\r\t]]") & (most / F.length(text) <= 0.6) & (signs / F.length(text) >= 0.8)

    return let(F.array_distinct(F.split(text, "")), fits)


def decode_tag(text: Column) -> Column:
    def read(carriers: Column) -> Column:
        said = F.filter(F.transform(carriers, lambda c: code_point(c) - 0xE0000), lambda b: b.between(0x20, 0x7E))
        return let(said, lambda s: _text_of(_hex(s), "tag_characters", F.lit(NOTES["tag_characters"]), F.size(s), F.size(carriers)))

    return F.when(text.rlike(f"[{TAG_SET}]"), let(F.regexp_extract_all(text, F.lit(f"[{TAG_SET}]"), F.lit(0)), read))


def decode_selectors(text: Column) -> Column:
    def read(carriers: Column) -> Column:
        said = F.transform(F.transform(carriers, code_point), lambda c: F.when(c <= 0xFE0F, c - 0xFE00).otherwise(c - 0xE0100 + 16))
        return let(said, lambda s: _text_of(_hex(s), "variation_selectors", F.lit(NOTES["variation_selectors"]), F.size(s), F.size(carriers)))

    return F.when(text.rlike(f"[{SELECTOR_SET}]"), let(F.regexp_extract_all(text, F.lit(f"[{SELECTOR_SET}]"), F.lit(0)), read))


def _hex(numbers: Column) -> Column:
    return F.array_join(F.transform(numbers, lambda b: F.lpad(F.hex(b), 2, "0")), "")


def _octets(bits: Column, n: Column) -> Column:
    """n groups of eight bits as hex."""
    return F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.lpad(F.conv(F.substring(bits, i * 8 + 1, F.lit(8)), 2, 16), 2, "0")), "")


def decode_zero_width(text: Column) -> Column:
    """The alphabet of the best printable ratio wins, the first of equal ones."""
    every = "".join(sorted({c for pair in ALPHABETS for c in pair}))
    tried = F.array(*(F.struct(F.lit(zero).alias("zero"), F.lit(one).alias("one"), F.lit(-i).alias("i"), F.lit(f"8-bit groups, 0=U+{ord(zero):04X} 1=U+{ord(one):04X}").alias("note")) for i, (zero, one) in enumerate(ALPHABETS)))

    def read(carriers: Column) -> Column:
        def candidate(a: Column) -> Column:
            def of(bits: Column) -> Column:
                n = (F.length(bits) / 8).cast("int")
                found = F.when(n >= 2, _text_of(F.when(n >= 2, _octets(bits, n)), "zero_width_binary", a["note"], n, n * 8, speculative=True))
                return let(found, lambda p: F.when(p.isNotNull(), F.struct(p["printable_ratio"].alias("r"), a["i"].alias("i"), p.alias("p"))))

            own = F.regexp_replace(carriers, F.concat(F.lit("[^"), a["zero"], a["one"], F.lit("]")), F.lit(""))
            return let(F.call_function("translate", own, F.concat(a["zero"], a["one"]), F.lit("01")), of)

        # one expression for all alphabets, not one for each
        return F.array_max(F.filter(F.transform(tried, candidate), lambda x: x.isNotNull()))["p"]

    return F.when(text.rlike(f"[{every}]"), let(F.regexp_replace(text, f"[^{every}]", ""), read))


def decode_all(text: Column) -> Column:
    """array of payload structs, by channel in order, of those that decode."""
    return F.filter(F.array(decode_tag(text), decode_selectors(text), decode_zero_width(text)), lambda p: p.isNotNull())
