"""64-bit hashes of the words of whole texts, computed on whole Arrow batches.

A word is a run without white space (blank, tab to carriage return) or, with SIGNS, a run of
digits, letters and anything beyond ASCII; A-Z count as a-z.  A word of up to 32 bytes has
the sum of a random number for each byte at its place (tabulation hashing: two words agree by a
chance of 2**-64, whatever their letters), finalised together with its length; a longer one
has the xxh3 hash of its bytes.  Work goes in runs of about a megabyte, so memory does not
depend on the length of a text.
"""

from __future__ import annotations

import functools

import numpy as np
import xxhash

from .shared import mix64

_RUN = 1 << 20
_PLACES = 32
#: What stands between words: white space, or all of ASCII but digits and letters.
BLANKS = (0x20, *range(0x09, 0x0E))
SIGNS = (*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80))


@functools.lru_cache(maxsize=4)
def _tables(between: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Random numbers by place * 256 + byte, and what stands between words by byte."""
    values = mix64(mix64(np.arange(1, 256 * _PLACES + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) + np.uint64(0x9E3779B97F4A7C15)).reshape(_PLACES, 256)
    values[:, 65:91] = values[:, 97:123]
    blank = np.zeros(256, bool)
    blank[list(between)] = True
    return values.ravel(), blank


def _long_hash(word: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(word.tobytes().lower())


def _run_hashes(raw: np.ndarray, between: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(starts, hashes) of the words of a run that cuts no word."""
    values, blank = _tables(between)
    is_word = ~blank[raw]
    edge = np.diff(np.concatenate([[False], is_word, [False]]).view(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not starts.size:
        return starts, np.zeros(0, np.uint64)
    size = ends - starts
    letters = raw[is_word]
    first = np.cumsum(size) - size
    place = np.arange(letters.size, dtype=np.int64) - np.repeat(first, size)
    h = np.add.reduceat(values[((place & (_PLACES - 1)) << 8) | letters], first)
    h = mix64(h ^ (size.astype(np.uint64) * np.uint64(0xA0761D6478BD642F)))
    for i in np.flatnonzero(size > _PLACES).tolist():
        h[i] = _long_hash(raw[starts[i] : ends[i]])
    return starts, h


def word_hashes(raw: np.ndarray, offsets: np.ndarray, between: tuple[int, ...] = BLANKS) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words in order, number of words of each text)."""
    counts, all_hashes, all_doc = np.zeros(offsets.size - 1, np.int64), [], []
    if raw.size == 0:
        return np.zeros(0, np.uint64), counts
    blank = _tables(between)[1]
    at, n = 0, raw.size
    while at < n:
        end = min(at + _RUN, n)
        if end < n:
            back = np.flatnonzero(blank[raw[at : end + 1]])
            last_text = offsets[np.searchsorted(offsets, end, side="right") - 1]  # start of the text that the run ends in
            cut = max(min(at + int(back[-1]) + 1, end) if back.size else at, int(last_text))
            if cut <= at:  # one word longer than a run: hashed by itself
                nxt = int(offsets[np.searchsorted(offsets, at, side="right")])
                stop = at + _RUN
                while stop < nxt and not blank[raw[stop : stop + _RUN]].any():
                    stop += _RUN
                more = np.flatnonzero(blank[raw[stop:nxt][:_RUN]])
                stop = min(nxt, stop + int(more[0])) if more.size else nxt
                all_hashes.append(np.array([_long_hash(raw[at:stop])], np.uint64))
                all_doc.append(np.array([np.searchsorted(offsets, at, side="right") - 1]))
                at = stop
                continue
            end = cut
        piece = raw[at:end]
        inner = offsets[(offsets > at) & (offsets < end)] - at
        if inner.size:  # texts meet inside the run: a separator goes between them
            piece = np.insert(piece, inner, 0x20)
        starts, h = _run_hashes(piece, between)
        if inner.size:
            shifted = inner + np.arange(inner.size)
            starts = starts - np.searchsorted(shifted, starts, side="right")
        all_hashes.append(h)
        all_doc.append(np.searchsorted(offsets, starts + at, side="right") - 1)
        at = end
    hashes, doc = np.concatenate(all_hashes), np.concatenate(all_doc)
    counts += np.bincount(doc, minlength=counts.size)[: counts.size]
    return hashes, counts


def term_counts(raw: np.ndarray, offsets: np.ndarray, between: tuple[int, ...] = BLANKS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(terms, row, times, words of each row), rows ascending and terms ascending within a row."""
    h, counts = word_hashes(raw, offsets, between)
    row = np.repeat(np.arange(counts.size), counts)
    order = np.argsort(h)
    narrow = row.astype(np.uint16) if counts.size <= 1 << 16 else row  # sorted by counting, not by comparing
    order = order[np.argsort(narrow[order], kind="stable")]
    h, row = h[order], row[order]
    first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (row[1:] != row[:-1])])) if h.size else np.zeros(0, np.int64)
    return h[first], row[first], np.diff(np.append(first, h.size)), counts


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, size: int = 5) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles of `size` words; fewer words make one shingle."""
    h, counts = word_hashes(raw, offsets)
    bounds = np.concatenate([[0], np.cumsum(counts)])
    n = max(h.size - size + 1, 0)
    grams = np.zeros(n, np.uint64)
    for k in range(size):
        grams = (grams ^ h[k : k + n]) * np.uint64(0x9FB21C651E98DF25)
        grams ^= grams >> np.uint64(32)
    grams = mix64(grams)
    out = []
    for i, c in enumerate(counts):
        lo, hi = int(bounds[i]), int(bounds[i + 1])
        if c == 0:
            out.append(np.zeros(0, np.uint64))
        elif c < size:
            out.append(np.array([xxhash.xxh3_64_intdigest(h[lo:hi].tobytes(), seed=size)], np.uint64))
        else:
            out.append(np.unique(grams[lo : hi - size + 1]))
    return out
