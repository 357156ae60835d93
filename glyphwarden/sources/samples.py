"""Documents with known marks: one for each detector, from one base text, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.payloads import encode

#: A marker follows every so many spaces; the longer step counts where the shorter one does not.
MARKERS = ((9, "\u200b"), (14, "\u200d"))


def with_markers(text: Column) -> Column:
    """Zero-width markers after every ninth space, and after every fourteenth that is no ninth: a mark without a message."""
    def after(i: Column) -> Column:
        (a, first), (b, second) = MARKERS
        return F.when(i % a == 0, first).when(i % b == 0, second).otherwise("")

    pieces = F.split(text, " ", -1)
    return F.array_join(F.transform(pieces, lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.lit(" "), after(i), p))), "")


def after_first_stop(text: Column, block: Column) -> Column:
    """The block behind the first full stop; at the end, behind a stop, where there is none."""
    at = F.locate(".", text)
    return F.when(at == 0, F.concat(text, F.lit("."), block)).otherwise(F.concat(F.substring(text, F.lit(1), at), block, F.substring(text, at + 1, F.length(text))))


def samples(spark: SparkSession, base: str, swapped: str, tag: str, selectors: str, bits: str) -> DataFrame:
    """(name, text): clean, markers, three payloads and look-alikes; `swapped` is the base with letters of another script."""
    b = F.lit(base)
    made = {
        "clean": b, "markers": with_markers(b), "tags": F.concat(b, encode("tag_characters", F.lit(tag))), "selectors": after_first_stop(b, encode("variation_selectors", F.lit(selectors))),
        "bits": F.concat(b, encode("zero_width_binary", F.lit(bits))), "look_alikes": F.lit(swapped),
    }
    rows = F.array(*(F.struct(F.lit(k).alias("name"), v.alias("text")) for k, v in made.items()))
    return spark.range(1).select(F.explode(rows).alias("s")).select("s.*")
