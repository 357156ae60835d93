"""Secret scans (operator 10): fixed patterns, and random strings by token efficiency.

The patterns give spans of the kinds assign, access and hex.  The token-efficiency
test gives spans of the kind token: stretches of key characters that a public byte-pair
vocabulary can only spell in very short tokens are random strings.  Every run of
LEAST_RUN key characters or more is tested, whatever its letters: without those parts that lie in
spans of a pattern, are digests (plain hex of a digest's length), UUIDs or numbers without
letters.  A part of WINDOW characters, or of LEAST_RUN with both digits and letters, is a span if
it has fewer than `ratio` characters a token as a whole; else the stretches of WINDOW characters or
more in it that are spelled so by themselves are, whatever surrounds them.
Offsets are code points; ends are exclusive.

Special cases: a null text is the empty text and has no spans; texts and runs of any length are
read whole (runs are tokenized in steps of 256 characters); repeated rows are
scanned one by one; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import itertools
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import slices, tidy
from .tokens import default_path

#: Fixed values of the contract.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 8, "access": 16, "hex": 32}
KINDS = ("assign", "access", "hex", "token")

_KEYWORDS = ("passw", "secret", "token", "key")
_LONG_HEX = re.compile(r"[0-9a-f]{32,}")
_RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
_UUID = r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}"
#: Lengths of plain hex that are digests or object ids.
DIGESTS = (128, 96, 64, 56, 40, 32, 24)
_KNOWN = re.compile(rf"(?<![A-Za-z0-9])(?:{_UUID}|{'|'.join(f'[0-9a-f]{{{n}}}|[0-9A-F]{{{n}}}' for n in DIGESTS)})(?![A-Za-z0-9])")
#: Least characters of a part with digits and letters, of any other and of a stretch within one, and of a token that readable text has at its edge.
LEAST_RUN, WINDOW, READABLE = 16, 20, 4


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the pattern kinds, sorted by start and then kind as listed."""
    found = []
    low = text.lower()
    if any(k in low for k in _KEYWORDS):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    # a run of 32 or more, taken from its first character, is a whole maximal run
    found += [(m.start(), m.end(), "hex") for m in _LONG_HEX.finditer(text)]
    return sorted(found, key=_order)


def _order(span: tuple[int, int, str]) -> tuple[int, int, int]:
    return span[0], KINDS.index(span[2]), span[1]


@functools.lru_cache(maxsize=2)
def vocabulary(path: str | None):
    import public_tokenizers
    import tiktoken

    with open(path or default_path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def chars_per_token(run: str, path: str | None = None, step: int = 256) -> float:
    """Characters to a token; long runs are counted in steps, which bounds the work of the merges."""
    enc = vocabulary(path)
    return len(run) / sum(len(enc.encode_ordinary(run[i : i + step])) for i in range(0, len(run), step))


def enough(part: str) -> bool:
    """Whether a part is long enough for the test, and no mere number."""
    return any(c.isalpha() for c in part) and (len(part) >= WINDOW or (len(part) >= LEAST_RUN and any(c.isdigit() for c in part)))


def without(lo: int, hi: int, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """What is left of lo .. hi outside the spans, which ascend by start."""
    out = []
    for s, e in spans:
        if lo < s < hi:
            out.append((lo, s))
        lo = max(lo, e)
    return [*out, (lo, hi)] if lo < hi else out


def stretches(run: str, ratio: float, path: str | None, step: int = 256) -> list[tuple[int, int]]:
    """(start, end) of the parts of a run where windows of whole tokens, WINDOW characters or more, stay below the ratio; readable tokens at their edges are cut off."""
    enc = vocabulary(path)
    sizes = [len(enc.decode_single_token_bytes(t)) for i in range(0, len(run), step) for t in enc.encode_ordinary(run[i : i + step])]
    ends = list(itertools.accumulate(sizes))
    found: list[list[int]] = []  # first token, one past the last token
    last = 0
    for first in range(len(sizes)):
        start = ends[first] - sizes[first]
        while last < len(sizes) and ends[last] - start < WINDOW:
            last += 1
        if last == len(sizes):
            break
        if ends[last] - start < ratio * (last + 1 - first) and any(c.isalpha() for c in run[start : ends[last]]):
            if found and first < found[-1][1]:
                found[-1][1] = last + 1
            else:
                found.append([first, last + 1])
    out = []
    for first, stop in found:
        while stop - first > 1 and sizes[first] >= READABLE:
            first += 1
        while stop - first > 1 and sizes[stop - 1] >= READABLE:
            stop -= 1
        out.append((ends[first] - sizes[first], ends[stop - 1]))
    return out


def token_spans(text: str, base: list[tuple[int, int, str]], ratio: float, path: str | None) -> list[tuple[int, int, str]]:
    found, taken = [], [(s, e) for s, e, _ in base]
    for m in _RUN.finditer(text):
        excluded = taken + [k.span() for k in _KNOWN.finditer(text, m.start(), m.end())]
        for lo, hi in without(m.start(), m.end(), sorted(x for x in excluded if x[0] < m.end() and m.start() < x[1])):
            part = text[lo:hi]
            if not enough(part):
                continue
            if chars_per_token(part, path) < ratio:
                found.append((lo, hi, "token"))
            elif len(part) >= WINDOW:
                found += [(lo + s, lo + e, "token") for s, e in stretches(part, ratio, path)]
    return found


def all_spans(text: str, ratio: float, path: str | None) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    base = base_spans(text)
    return base, sorted(base + token_spans(text, base, ratio, path), key=_order)


def listed(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ratio: float = 1.9, path: str | None = None) -> DataFrame:
    """One row for each input row: id, n_assign, n_access, n_hex, n_token, base_sha256, spans."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            for s in slices(b, "text"):
                out: list[tuple] = []
                for text in s.column(1).to_pylist():
                    base, spans = all_spans(text or "", ratio, path)
                    n = [sum(k == kind for _, _, k in spans) for kind in KINDS]
                    out.append((*n, hashlib.sha256(listed(base).encode()).hexdigest(), listed(spans)))
                cols = list(zip(*out, strict=True))
                types = [pa.int64()] * 4 + [pa.string()] * 2
                yield pa.RecordBatch.from_arrays([s.column(0), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=[id_col, "n_assign", "n_access", "n_hex", "n_token", "base_sha256", "spans"])

    schema = f"`{id_col}` {id_type}, n_assign long, n_access long, n_hex long, n_token long, base_sha256 string, spans string"
    return docs.select(F.col(id_col), F.col(text_col).alias("text")).mapInArrow(run, schema)


def redact_text(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with every span, overlapping ones as one, replaced by <KIND>."""
    out, at = [], 0
    for s, e, kind in spans:
        if s >= at:
            out += [text[at:s], f"<{kind.upper()}>"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text_col: str = "text", ratio: float = 1.9, path: str | None = None) -> DataFrame:
    """The same rows and columns; spans in the texts are replaced.  Null texts stay null."""
    names = docs.columns
    at = names.index(text_col)

    def run(batches):
        for b in batches:
            for s in slices(b, text_col):
                texts = [t if t is None or not (spans := all_spans(t, ratio, path)[1]) else redact_text(t, spans) for t in s.column(at).to_pylist()]
                cols = list(s.columns)
                cols[at] = pa.array(texts, s.schema.field(at).type)
                yield pa.RecordBatch.from_arrays(cols, schema=s.schema)
        tidy()

    return docs.mapInArrow(run, docs.schema)
