"""Marked copies: a payload, hidden at spread sentence ends, one copy for each recipient."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.codepoints import WHITE_SET
from ..functions.text import let
from .payloads import CHANNELS, decode_all, encode

SEPARATOR = "|"
_FIELD = re.compile(r"\{recipient\}|\{index(?::0(\d)d)?\}")


class MarkingError(ValueError):
    """The request can't be met."""


MOST_RECIPIENTS, LONGEST_TEMPLATE, MOST_REPEATS = 100, 128, 20


def refusal(recipients: list[str], template: str, channel: str, repeat: int) -> str | None:
    """Why a request can't be met, or None."""
    if not 0 < len(recipients) <= MOST_RECIPIENTS:
        return f"1 to {MOST_RECIPIENTS} recipients are required"
    if not all(isinstance(r, str) and r.strip() for r in recipients):
        return "a recipient is blank"
    if len(set(recipients)) != len(recipients):
        return "a recipient is named twice"
    if not isinstance(template, str) or len(template) > LONGEST_TEMPLATE:
        return f"a template has at most {LONGEST_TEMPLATE} characters"
    if channel not in CHANNELS:
        return f"no such channel: {channel!r}"
    if isinstance(repeat, bool) or not isinstance(repeat, int) or not 1 <= repeat <= MOST_REPEATS:
        return f"repeat is a whole number from 1 to {MOST_REPEATS}"
    return None


def request_refusal(recipients: Column, template: Column, channel: Column, repeat: Column) -> Column:
    """The same of a table of requests, as codes."""
    return (
        F.when(recipients.isNull() | ~F.size(recipients).between(1, MOST_RECIPIENTS), "recipients").when(F.exists(recipients, lambda r: ~F.coalesce(r.rlike(r"\S"), F.lit(False))), "blank")
        .when(F.size(F.array_distinct(recipients)) < F.size(recipients), "twice").when(F.length(template) > LONGEST_TEMPLATE, "template").when(~channel.isin(*CHANNELS), "channel").when(~repeat.between(1, MOST_REPEATS), "repeat")
    )


def filled(template: str, recipient: str, index: int) -> str:
    """A template with its fields filled in."""
    return _FIELD.sub(lambda m: recipient if m[0] == "{recipient}" else str(index).zfill(int(m[1] or 0)), template)


def payload_of(template: str, recipient: Column, index: Column) -> Column:
    """A template of text, {recipient}, {index} and {index:0Nd}; nothing else."""
    parts, at = [], 0
    for m in _FIELD.finditer(template):
        parts.append(F.lit(template[at : m.start()]))
        number = index.cast("string")
        parts.append(recipient if m[0] == "{recipient}" else F.when(F.length(number) < int(m[1]), F.lpad(number, int(m[1]), "0")).otherwise(number) if m[1] else number)
        at = m.end()
    rest = template[at:]
    if re.search(r"[{}]", _FIELD.sub("", template)):
        raise MarkingError(f"only {{recipient}} and {{index}} can stand in braces: {template!r}")
    return F.concat(*parts, F.lit(rest))


def marked_text(text: Column, payload: Column, channel: str = "tag_characters", repeat: int = 2) -> Column:
    """The text with the payload at `repeat` spread sentence ends, at the end where there is none."""
    if channel not in CHANNELS:
        raise MarkingError(f"no such channel: {channel!r}")
    if repeat < 1:
        raise MarkingError("repeat is 1 or more")
    block = encode(channel, F.concat(payload, F.lit(SEPARATOR)))
    end = rf"(?<=[.!?])[{WHITE_SET}]+"
    pieces = F.regexp_extract_all(text, F.lit(rf"(?s).+?{end}|.+"), F.lit(0))

    def spread(v: Column) -> Column:
        n, ps, mark = v["n"], v["pieces"], v["block"]
        chosen = F.transform(F.sequence(F.lit(0), F.lit(repeat - 1)), lambda i: F.least(F.floor(i * n / repeat).cast("int"), n - 1))
        some = let(chosen, lambda c: F.array_join(F.transform(ps, lambda p, i: F.when((i < n) & ((n <= repeat) | F.array_contains(c, i)), F.concat(p, mark)).otherwise(p)), ""))
        return F.when(n > 0, some).otherwise(F.concat(text, mark))

    ends = F.size(F.filter(pieces, lambda p: p.rlike(rf"{end}\z")))
    return let(F.struct(pieces.alias("pieces"), ends.alias("n"), block.alias("block")), spread)


def copies_in(text: Column, repeat: int) -> Column:
    """How often a payload stands in a marked text."""
    ends = F.regexp_count(text, F.lit(rf"(?<=[.!?])[{WHITE_SET}]+"))
    return F.when(ends == 0, 1).otherwise(F.least(ends, F.lit(repeat)))


def distinct_copies(copies: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, copies, distinct_texts, distinct_recipients: marked copies of a document must all differ."""
    return copies.groupBy(key).agg(F.count("*").alias("copies"), F.count_distinct(F.sha2("text", 256)).alias("distinct_texts"), F.count_distinct("recipient").alias("distinct_recipients"))


def mark_copies(docs: DataFrame, recipients: list[str], template: str = "{recipient}", channel: str = "tag_characters", repeat: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, recipient, payload, text, channel, carrier_chars, verified: a row for each document and recipient.

    Recipients are a list of the caller's, 100 at most, so they are unrolled rather than joined.  A request that
    can't be met, a blank payload, and one that the channel can't hold are refused; so is, when it is made, a copy
    that does not decode to its payload: a mark that can't be read back is worse than none.
    """
    why = refusal(recipients, template, channel, repeat)
    if why:
        raise MarkingError(why)
    for i, r in enumerate(recipients, 1):
        said = filled(template, r, i)
        if not said.strip():
            raise MarkingError("a payload is blank")
        if channel == "tag_characters" and not all(" " <= c <= "~" for c in said):
            raise MarkingError("tag characters hold printable ASCII alone: take variation_selectors")
    who = F.array(*(F.struct(F.lit(i).alias("index"), F.lit(r).alias("recipient")) for i, r in enumerate(recipients, 1)))
    rows = docs.select(key, F.col(text).alias("__t"), F.explode(who).alias("w")).withColumn("payload", payload_of(template, F.col("w.recipient"), F.col("w.index")))
    rows = rows.withColumn("text", marked_text(F.col("__t"), F.col("payload"), channel, repeat)).withColumn("__p", decode_all(F.col("text")))
    verified = F.exists("__p", lambda p: F.contains(p["text"], F.concat("payload", F.lit(SEPARATOR))))
    return rows.select(key, F.col("w.recipient").alias("recipient"), "payload", "text", F.lit(channel).alias("channel"), (F.length("text") - F.length("__t")).alias("carrier_chars"), copies_in(F.col("__t"), repeat).alias("copies_embedded"),
        F.when(F.col("__t").isNull(), F.lit(False)).when(verified, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("a mark does not decode back: document "), F.col(key).cast("string")))).cast("boolean").alias("verified"))


def trace(leaked: DataFrame, issued: DataFrame, text: str = "text") -> DataFrame:
    """leaked rows with the recipients whose issued payload (payload, recipient) stands in them: an equi join on the payload."""
    keep = [F.col(c) for c in leaked.columns if c != text]
    said = leaked.select(*keep, F.explode(decode_all(F.col(text))).alias("p")).select(*keep, F.explode(F.filter(F.array_distinct(F.split(F.col("p.text"), r"\|")), lambda x: x != "")).alias("payload"))
    return said.join(issued.select("payload", "recipient").distinct(), "payload").distinct()


def parse_recipients(text: Column) -> Column:
    """Names between line ends and commas, blanks trimmed and dropped."""
    return F.filter(F.transform(F.split(text, "[\n,]"), lambda x: F.trim(x)), lambda x: x != "")


def has_duplicates(names: Column) -> Column:
    return F.size(F.array_distinct(names)) < F.size(names)
