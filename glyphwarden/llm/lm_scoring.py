"""LM scoring (operator 6): context-tree weighting over bytes, beside a word-count base.

Model.  A text is its UTF-8 bytes and one end byte (0xFF, which UTF-8 never has); before
it stand `depth` end bytes.  Each byte is eight binary decisions.  For every context of 0
to `depth` bytes and every bit prefix, the training documents give counts of zeros and
ones; each such node has the Krichevsky-Trofimov estimate of its own counts, and
P_w = (P_e + product of P_w over contexts one byte longer) / 2, with P_w = P_e at the full
depth.  All of it follows from the counts of (depth + 1)-byte strings, which tasks gather
over all training documents and shuffle by string.  A byte's probability mixes the
estimates along its context path with the posterior weights of the nodes; unseen contexts
say 1/2 to each bit.  The code length in bits a byte is -score / log10(2) / bytes.

The counts of all strings stay dealt out by a hash of their last CUT context bytes, so a
task holds all of a node of CUT context bytes or more and weighs it.  Nodes of shorter
contexts, at most 256**CUT strings whatever the input, are weighed on the driver.  The
values of at most `strings` of the most frequent strings are broadcast; the other strings
of each document, and those never seen, are shuffled to the counts, as rare words are, so
the bound changes the way to a value and not the value.

Base.  Words (blank-separated, A-Z lower-cased) and one end for each text are counted over
all training documents.  Words that stand there four times or more, the most frequent
`words` of them at most, are broadcast; the other tokens of each document are shuffled to
the counts by word.

Special cases: null texts are empty texts (an end alone); a null id counts as the empty
text for the fold; repeated rows are scored, and learned from, one by one; texts of any length
are read whole, a megabyte at a time; an empty table gives an empty result; without
training rows every byte has 2**-8 and every token 0.1 / 0.1.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import crc_remainder, mix64, n_groups, slices, stored, tidy, utf8_column
from .wordhash import word_hashes

_RUN = 1 << 20
#: Nodes of so many context bytes and more are weighed where their strings are.
CUT = 3


def _press(a: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(a.tobytes())


def _pack(keys: np.ndarray) -> bytes:
    return _press(np.diff(keys, prepend=np.uint64(0)))


def _open(blob: bytes, kind) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), kind)


def _unpack(blob: bytes) -> np.ndarray:
    return np.cumsum(_open(blob, np.uint64), dtype=np.uint64)


def merge(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Ascending distinct keys and the sums of their counts."""
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if k.size else np.zeros(0, int)
    return k[first], np.add.reduceat(c, first) if k.size else c


class Tally:
    """Counts of 64-bit keys, merged whenever much new has come in."""

    def __init__(self, flush: int = 4_000_000):
        self.flush, self.raw, self.n = flush, [], 0
        self.keys, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def add(self, keys: np.ndarray) -> None:
        self.raw.append(keys)
        self.n += keys.size
        if self.n >= self.flush:
            self.settle()

    def settle(self) -> None:
        if self.raw:
            u, c = np.unique(np.concatenate(self.raw), return_counts=True)
            self.keys, self.counts = merge([self.keys, u], [self.counts, c.astype(np.int64)])
            self.raw, self.n = [], 0


def framed(raw: np.ndarray, offsets: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes with `depth` end bytes before and one after each text, where scored bytes stand, their text)."""
    n = offsets.size - 1
    inner = np.diff(offsets)
    starts = np.concatenate([[0], np.cumsum(inner + depth + 1)[:-1]])
    out = np.full(int((inner + depth + 1).sum()), 0xFF, np.uint8)
    out[np.repeat(starts + depth - offsets[:-1], inner) + np.arange(raw.size)] = raw
    lengths = np.diff(offsets) + 1
    starts = np.concatenate([[0], np.cumsum(lengths + depth)[:-1]]) + depth
    doc = np.repeat(np.arange(n), lengths)
    place = np.repeat(starts - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(doc.size)
    return out, place, doc


def strings_of(raw: np.ndarray, offsets: np.ndarray, depth: int):
    """Runs of (keys of depth + 1 bytes ending at scored bytes, text of each)."""
    data, place, doc = framed(raw, offsets, depth)
    for lo in range(0, place.size, _RUN):
        p = place[lo : lo + _RUN]
        base = int(p[0]) - depth
        wide = data[base : int(p[-1]) + 1].astype(np.uint64)
        rel = p - base
        n = wide.size - depth
        keys = np.zeros(n, np.uint64)
        for k in range(depth + 1):
            keys = (keys << np.uint64(8)) | wide[k : k + n]
        yield keys[rel - depth], doc[lo : lo + _RUN]


def placed(keys: np.ndarray, depth: int, parts: int) -> np.ndarray:
    """The part of each string: those with the same last CUT context bytes are together."""
    return (mix64((keys >> np.uint64(8)) & np.uint64((1 << 8 * min(CUT, depth)) - 1)) % np.uint64(parts)).astype(np.int64)


def train_counts(docs: DataFrame, depth: int, parts: int) -> DataFrame:
    """docs(text) -> packed counts: (kind 's' or 'w', part, keys, counts), and one row of kind 'n' a task with token and row numbers."""

    def run(batches):
        grams, words, n_words, n_rows = Tally(), Tally(), 0, 0
        for b in batches:
            for s in slices(b, "text"):
                raw, off = utf8_column(s.column(0))
                for keys, _ in strings_of(raw, off, depth):
                    grams.add(keys)
                h, _ = word_hashes(raw, off)
                words.add(h)
                n_words += h.size
                n_rows += s.num_rows
        for kind, tally in (("s", grams), ("w", words)):
            tally.settle()
            part = placed(tally.keys, depth, parts) if kind == "s" else (mix64(tally.keys) % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            cuts = np.searchsorted(part[order], np.arange(parts + 1))
            for p in range(parts):
                at = order[cuts[p] : cuts[p + 1]]
                if at.size:
                    yield _row(kind, p, _pack(tally.keys[at]), _press(tally.counts[at]))
        tidy()
        yield _row("n", None, n_words.to_bytes(8, "big"), n_rows.to_bytes(8, "big"))

    return docs.select("text").mapInArrow(run, "kind string, part int, keys binary, counts binary")


def _row(kind: str, part: int | None, keys: bytes, counts: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([kind]), pa.array([part], pa.int32()), pa.array([keys], pa.binary()), pa.array([counts], pa.binary())], names=["kind", "part", "keys", "counts"])


def reduced(packed: DataFrame) -> DataFrame:
    """One row for each kind, part and power of two of the counts: (kind, part, power, n, keys, counts)."""

    def run(t: pa.Table) -> pa.Table:
        keys, counts = merge([_unpack(x) for x in t.column("keys").to_pylist()], [_open(x, np.int64) for x in t.column("counts").to_pylist()])
        kind, part = t.column("kind")[0].as_py(), t.column("part")[0].as_py()
        power = np.frexp(counts)[1] - 1
        rows = [(kind, part, int(p), int((power == p).sum()), _pack(keys[power == p]), _press(counts[power == p])) for p in np.unique(power)]
        kinds = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
        return pa.table({n: pa.array(c, k) for n, c, k in zip(("kind", "part", "power", "n", "keys", "counts"), zip(*rows, strict=True), kinds, strict=True)})

    return packed.groupBy("kind", "part").applyInArrow(run, "kind string, part int, power int, n long, keys binary, counts binary")


def least_power(counted: DataFrame, room: int) -> int:
    """The least power of two of the counts such that there are at most `room` keys from it on; 64 where none fits."""
    least = 64
    for r in counted.groupBy("power").agg(F.sum("n").alias("n")).orderBy(F.desc("power")).collect():
        if r["n"] > room:
            break
        least, room = r["power"], room - r["n"]
    return least


def most_frequent(counted: DataFrame, room: int, lowest: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(keys, counts) of whole powers of two from above down to `lowest`, `room` at most."""
    counted = counted.where(F.col("power") >= lowest)
    rows = counted.where(F.col("power") >= least_power(counted, room)).select("keys", "counts").collect()
    return merge([_unpack(r["keys"]) for r in rows], [_open(r["counts"], np.int64) for r in rows])


_TABLE = np.array([[math.lgamma(i + 0.5) for i in range(4096)], [math.lgamma(i + 1.0) for i in range(4096)]])


def _lgamma(n: np.ndarray, half: bool) -> np.ndarray:
    """log gamma of n + 1/2 or of n + 1 for whole n: a table, then Stirling's series."""
    x = np.maximum(n, 4096) + (0.5 if half else 1.0)
    big = (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3)
    return np.where(n < 4096, _TABLE[0 if half else 1][np.minimum(n, 4095)], big)


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """log of the Krichevsky-Trofimov probability of any sequence with these counts."""
    return _lgamma(zeros, True) + _lgamma(ones, True) - _lgamma(zeros + ones, False) - math.log(math.pi)


def _mask(d: int) -> np.uint64:
    return np.uint64((1 << 8 * (d + 1)) - 1)


class Levels:
    """Context-tree weighting over contexts of `low` to `high` bytes, from ascending keys of high + 1 bytes and their counts.

    `split` has, for each bit and key, what the nodes one byte deeper add to log P_w; None at the full depth.
    """

    def __init__(self, low: int, high: int, keys: np.ndarray, counts: np.ndarray, split: np.ndarray | None = None):
        self.low, self.high = low, high
        levels = [(keys, counts)]
        for d in range(high - 1, low - 1, -1):
            levels.append(merge([levels[-1][0] & _mask(d)], [levels[-1][1]]))
        levels.reverse()
        self.keys = [k for k, _ in levels]
        self.total = [np.concatenate([[0], np.cumsum(c)]) for _, c in levels]
        self.below = [np.searchsorted(self.keys[i], self.keys[i + 1] & _mask(low + i)).astype(np.int32) for i in range(high - low)]
        self.weights = [np.ones((8, k.size), np.float32) for k in self.keys]
        self.whole = np.zeros((8, self.keys[0].size))  # log P_w of each node of `low` bytes, at its first key
        for bit in range(8 if keys.size else 0):
            inner = split[bit] if split is not None else None
            for i in range(high - low, -1, -1):
                first, group, zeros, ones = self._groups(i, bit)
                whole = log_kt(zeros, ones)
                if inner is not None:
                    own = whole - math.log(2)
                    whole = np.logaddexp(own, np.add.reduceat(inner, first) - math.log(2))
                    self.weights[i][bit] = np.exp(own - whole)[group]
                if i:
                    inner = np.bincount(self.below[i - 1][first], weights=whole, minlength=self.keys[i - 1].size)
            self.whole[bit, first] = whole

    def _groups(self, i: int, bit: int):
        """(first entry of each node at this bit, group of each entry, zeros, ones)."""
        k = self.keys[i] >> np.uint64(8 - bit)
        new = k[1:] != k[:-1]
        first = np.flatnonzero(np.concatenate([[True], new]))
        group = np.cumsum(np.concatenate([[0], new.astype(np.int32)]), dtype=np.int32)
        c = np.diff(self.total[i])
        one = (self.keys[i] >> np.uint64(7 - bit)) & np.uint64(1)
        ones = np.add.reduceat(np.where(one == 1, c, 0), first)
        return first, group, np.add.reduceat(c, first) - ones, ones

    def raised(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(keys, counts, split) of the contexts one byte shorter than `low`."""
        short = self.keys[0] & _mask(self.low - 1)
        keys, counts = merge([short], [np.diff(self.total[0])])
        at = np.searchsorted(keys, short)
        return keys, counts, np.stack([np.bincount(at, weights=w, minlength=keys.size) for w in self.whole])

    def mix(self, above: Levels | None) -> None:
        """Probability mixed so far of the last byte's bits, and the weight left to longer contexts, for each key of high + 1 bytes."""
        n = self.keys[-1].size
        self.mixed, self.left = np.zeros((8, n), np.float32), np.zeros((8, n), np.float32)
        at = np.searchsorted(above.keys[-1], self.keys[0] & _mask(above.high)) if above else None
        for bit in range(8 if n else 0):
            mixed, left = (above.mixed[bit, at].astype(float), above.left[bit, at].astype(float)) if above else (np.zeros(self.keys[0].size), np.ones(self.keys[0].size))
            for i in range(len(self.keys)):
                if i:
                    mixed, left = mixed[self.below[i - 1]], left[self.below[i - 1]]
                _, group, zeros, ones = self._groups(i, bit)
                one = ((self.keys[i] >> np.uint64(7 - bit)) & np.uint64(1)) == 1
                p = (np.where(one, ones[group], zeros[group]) + 0.5) / (zeros + ones + 1)[group]
                w = self.weights[i][bit].astype(float)
                mixed, left = mixed + left * w * p, left * (1.0 - w)
            self.mixed[bit], self.left[bit] = mixed, left

    def log10(self) -> np.ndarray:
        """log10 probability of the last byte of each key of the full depth, after mix()."""
        return np.log10(self.mixed.astype(float)).sum(axis=0).astype(np.float32)


def unseen(levels: list[Levels], strings: np.ndarray) -> np.ndarray:
    """log10 probability of the last byte of any strings of depth + 1 bytes, by levels of contexts from 0 bytes to the full depth."""
    tree = [(x.low + i, k, x.total[i], x.weights[i]) for x in levels for i, k in enumerate(x.keys)]
    result = np.zeros(strings.size)
    for bit in range(8):
        mixed, left = np.zeros(strings.size), np.ones(strings.size)
        live = np.arange(strings.size)
        for d, k, total, weights in tree:
            s = strings[live] & _mask(d)
            span = np.uint64((1 << (8 - bit)) - 1)
            low = s & ~span
            lo, hi = np.searchsorted(k, low), np.searchsorted(k, low | span, side="right")
            there = hi > lo
            mixed[live[~there]] += 0.5 * left[live[~there]]
            left[live[~there]] = 0.0
            live, s, lo, hi, low = live[there], s[there], lo[there], hi[there], low[there]
            if not live.size:
                break
            half = np.searchsorted(k, low | np.uint64(1 << (7 - bit)))
            one = ((s >> np.uint64(7 - bit)) & np.uint64(1)) == 1
            n = total[hi] - total[lo]
            p = (np.where(one, total[hi] - total[half], total[half] - total[lo]) + 0.5) / (n + 1)
            w = weights[bit][lo].astype(float)
            mixed[live] += left[live] * w * p
            left[live] *= 1.0 - w
        result += np.log10(mixed)
    return result


class Hashed:
    """Open-addressed table from 64-bit keys to float32 values; missing keys give nan."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(keys.size * 1.7).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.keys, self.values = np.zeros(1 << bits, np.uint64), np.full(1 << bits, np.nan, np.float32)
        used = np.zeros(1 << bits, bool)
        at, todo = self._home(keys), np.arange(keys.size)
        while todo.size:
            at[todo] = np.where(used[at[todo]], (at[todo] + 1) & self.mask, at[todo])
            free = todo[~used[at[todo]]]
            slot, first = np.unique(at[free], return_index=True)
            won = free[first]
            self.keys[slot], self.values[slot], used[slot] = keys[won], values[won], True
            placed = np.zeros(keys.size, bool)
            placed[won] = True
            todo = todo[~placed[todo]]

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        at = self._home(keys)
        out = self.values[at]
        todo = np.flatnonzero(self.keys[at] != keys)
        while todo.size:
            empty = np.isnan(self.values[at[todo]])
            out[todo[empty]] = np.nan
            todo = todo[~empty]
            at[todo] = (at[todo] + 1) & self.mask
            out[todo] = self.values[at[todo]]
            todo = todo[self.keys[at[todo]] != keys[todo]]
        return out


def _gathered(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return merge(
        [_unpack(x) for x in t.column("keys").to_pylist() if x is not None], [_open(x, np.int64) for x in t.column("counts").to_pylist() if x is not None]
    )


def fit_upper(counted: DataFrame, depth: int) -> Levels | None:
    """The levels of contexts shorter than CUT bytes, from reduced string counts; None without strings, or where `depth` is 0."""
    cut = min(CUT, depth)
    if not cut:
        return None

    def run(t: pa.Table) -> pa.Table:
        keys, counts, split = Levels(cut, depth, *_gathered(t)).raised()
        return pa.table({"part": pa.array([t.column("part")[0].as_py()], pa.int32()), "keys": pa.array([_pack(keys)], pa.binary()), "counts": pa.array([_press(counts)], pa.binary()), "split": pa.array([_press(split)], pa.binary())})

    rows = sorted(counted.select("part", "keys", "counts").groupBy("part").applyInArrow(run, "part int, keys binary, counts binary, split binary").collect(), key=lambda r: r["part"])
    if not rows:
        return None
    found = [_unpack(r["keys"]) for r in rows]
    keys, counts = merge(found, [_open(r["counts"], np.int64) for r in rows])
    split = np.zeros((8, keys.size))
    for k, r in zip(found, rows, strict=True):
        split[:, np.searchsorted(keys, k)] += _open(r["split"], np.float64).reshape(8, -1)
    upper = Levels(0, cut - 1, keys, counts, split)
    upper.mix(None)
    del upper.whole
    return upper


def frequent_values(counted: DataFrame, depth: int, strings: int, upper) -> tuple[np.ndarray, np.ndarray]:
    """(keys, log10 probabilities) of the most frequent strings, `strings` at most; `upper` is broadcast."""
    least = least_power(counted, strings)

    def run(t: pa.Table) -> pa.Table:
        keys, counts = _gathered(t)
        local = Levels(min(CUT, depth), depth, keys, counts)
        local.mix(upper.value)
        often = np.frexp(counts)[1] - 1 >= least
        return pa.table({"keys": pa.array([_pack(keys[often])], pa.binary()), "values": pa.array([_press(local.log10()[often])], pa.binary())})

    rows = counted.select("part", "keys", "counts").groupBy("part").applyInArrow(run, "keys binary, values binary").collect() if least < 64 else []
    keys = np.concatenate([_unpack(r["keys"]) for r in rows] or [np.zeros(0, np.uint64)])
    return keys, np.concatenate([_open(r["values"], np.float32) for r in rows] or [np.zeros(0, np.float32)])


def score(docs: DataFrame, train: Column, depth: int = 5, strings: int = 2_000_000, words: int = 2_000_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, n_known, train_tokens, base_score, score, n_bytes of every row; `train` is a condition on docs."""
    spark = docs.sparkSession
    parts = n_groups(docs)
    id_type = docs.schema[id_col].dataType.simpleString()
    learned = docs.where(train).select(F.col(text_col).alias("text"))
    packed = stored(train_counts(learned, depth, parts), "packed")
    counted = stored(reduced(packed.where("kind <> 'n'")), "counted")
    n_words, n_rows = 0, 0
    for r in packed.where("kind = 'n'").groupBy("kind").agg(
        F.sum(F.conv(F.hex("keys"), 16, 10).cast("long")).alias("w"), F.sum(F.conv(F.hex("counts"), 16, 10).cast("long")).alias("r")
    ).collect():
        n_words, n_rows = r["w"], r["r"]
    counted_words = counted.where("kind = 'w'")
    tokens = n_words + n_rows
    kinds = (counted_words.agg(F.sum("n")).first()[0] or 0) + (n_rows > 0)
    counted_strings = counted.where("kind = 's'")
    upper = spark.sparkContext.broadcast(fit_upper(counted_strings, depth))
    heavy_keys, heavy_counts = most_frequent(counted_words, words, lowest=2)
    below = tokens + 0.1 * (kinds + 1)
    values = np.log10((heavy_counts + 0.1) / below)
    end_value = math.log10((n_rows + 0.1) / below)
    held = spark.sparkContext.broadcast((*frequent_values(counted_strings, depth, strings, upper), heavy_keys, values))
    del heavy_keys, values, heavy_counts
    tidy()

    def run(batches):
        string_keys, string_values, keys, values = held.value
        table = Hashed(string_keys, string_values)
        uid = itertools.count(TaskContext.get().partitionId() << 40)
        for b in batches:
            for s in slices(b, "text"):
                raw, off = utf8_column(s.column(1))
                n = s.num_rows
                ids = np.fromiter(itertools.islice(uid, n), np.int64, n)
                total = np.zeros(n)
                looked_up, whose_string = [], []
                for k, doc in strings_of(raw, off, depth):
                    got = table.get(k).astype(float)
                    missing = np.isnan(got)
                    looked_up.append(k[missing])
                    whose_string.append(ids[doc[missing]])
                    got[missing] = 0.0
                    total += np.bincount(doc, weights=got, minlength=n)
                h, counts = word_hashes(raw, off)
                doc = np.repeat(np.arange(n), counts)
                at = np.minimum(np.searchsorted(keys, h), max(keys.size - 1, 0))
                found = keys[at] == h if keys.size else np.zeros(h.size, bool)
                base = np.bincount(doc[found], weights=values[at[found]], minlength=n) + end_value
                known = np.bincount(doc[found], minlength=n) + (n_rows > 0)
                none = pa.nulls(n, pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [s.column(0), pa.array(ids), pa.array(counts + 1), pa.array(known.astype(np.int64)), pa.array(base), pa.array(total), pa.array(np.diff(off)), pa.nulls(n, pa.string()), pa.nulls(n, pa.int32()), none, none],
                    names=_names(id_col),
                )
                rare, rest = h[~found], np.concatenate(looked_up or [np.zeros(0, np.uint64)])
                for kind, q, whose, part in (
                    ("w", rare, ids[doc[~found]], (mix64(rare) % np.uint64(parts)).astype(np.int64)),
                    ("s", rest, np.concatenate(whose_string or [np.zeros(0, np.int64)]), placed(rest, depth, parts)),
                ):
                    order = np.argsort(part, kind="stable")
                    cuts = np.searchsorted(part[order], np.arange(parts + 1))
                    out = [(kind, p, q[order[cuts[p] : cuts[p + 1]]].tobytes(), _press(whose[order[cuts[p] : cuts[p + 1]]])) for p in range(parts) if cuts[p] < cuts[p + 1]]
                    if out:
                        m = len(out)
                        cols = list(zip(*out, strict=True))
                        nulls = [pa.nulls(m, s.schema.field(0).type)] + [pa.nulls(m, t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64())]
                        yield pa.RecordBatch.from_arrays([*nulls, pa.array(cols[0]), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.binary()), pa.array(cols[3], pa.binary())], names=_names(id_col))

    schema = f"`{id_col}` {id_type}, uid long, n_tokens long, n_known long, base double, score double, n_bytes long, kind string, part int, rare binary, whose binary"
    scored = stored(docs.select(F.col(id_col), F.col(text_col).alias("text")).mapInArrow(run, schema), "scored")

    def asked(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        rare = [np.frombuffer(x, np.uint64) for x in t.column("rare").to_pylist() if x is not None]
        whose = [_open(x, np.int64) for x in t.column("whose").to_pylist() if x is not None]
        return np.concatenate(rare or [np.zeros(0, np.uint64)]), np.concatenate(whose or [np.zeros(0, np.int64)])

    def look_up(t: pa.Table) -> pa.Table:
        h, who = asked(t)
        keys, counts = _gathered(t)
        at = np.minimum(np.searchsorted(keys, h), max(keys.size - 1, 0))
        c = np.where(keys[at] == h, counts[at], 0) if keys.size else np.zeros(h.size, np.int64)
        return pa.table({"uid": pa.array(who), "n": pa.array(c)})

    def look_up_strings(t: pa.Table) -> pa.Table:
        q, who = asked(t)
        if not q.size:
            return pa.table({"uid": pa.array(who), "more_score": pa.array([], pa.float64())})
        local = Levels(min(CUT, depth), depth, *_gathered(t))
        local.mix(upper.value)
        keys = local.keys[-1]
        new, index = np.unique(q, return_inverse=True)
        at = np.minimum(np.searchsorted(keys, new), max(keys.size - 1, 0))
        known = keys[at] == new if keys.size else np.zeros(new.size, bool)
        got = np.zeros(new.size)
        got[known] = local.log10()[at[known]]
        got[~known] = unseen([upper.value, local] if upper.value else [local], new[~known])
        order = np.lexsort((index, who))  # sums that do not depend on the order of the rows
        uid, back = np.unique(who[order], return_inverse=True)
        return pa.table({"uid": pa.array(uid), "more_score": pa.array(np.bincount(back, weights=got[index[order]]))})

    def beside(kind: str, known: DataFrame) -> DataFrame:
        """What documents ask of this kind, and the counts, by part."""
        none = F.lit(None).cast("binary")
        mine = scored.where(F.col("kind") == kind).select("part", none.alias("keys"), none.alias("counts"), "rare", "whose")
        return mine.unionByName(known.select("part", "keys", "counts", none.alias("rare"), none.alias("whose"))).groupBy("part")

    value = F.log10((F.col("n") + 0.1) / F.lit(below))
    by_word = beside("w", counted_words).applyInArrow(look_up, "uid long, n long").groupBy("uid").agg(F.sum((F.col("n") > 0).cast("long")).alias("more_known"), F.sum(value).alias("more_base"))
    by_string = beside("s", counted_strings).applyInArrow(look_up_strings, "uid long, more_score double").groupBy("uid").agg(F.sum("more_score").alias("more_score"))
    rows = scored.where("part is null").select(id_col, "uid", "n_tokens", "n_known", "base", "score", "n_bytes")
    return rows.join(by_word, "uid", "left").join(by_string, "uid", "left").select(
        id_col, "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("more_score", F.lit(0.0))).alias("score"), "n_bytes",
    )


def _names(id_col: str) -> list[str]:
    return [id_col, "uid", "n_tokens", "n_known", "base", "score", "n_bytes", "kind", "part", "rare", "whose"]


def trained_on(id_col: str = "doc_id", m: int = 10) -> Column:
    return crc_remainder(F.col(id_col), m) != 0
