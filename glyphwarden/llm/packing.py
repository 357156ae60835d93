"""Packing (operator 8): sum-of-squares online packing of tokenized documents into windows.

A document's ids are cut into whole windows as far as they go; the rest, shorter than
a window, goes to the fill level that leaves the least sum of squared counts of partly
filled windows, tracked in a level array.  Each task packs its own rows in their order
(no shuffle); when its rows end, what stands in partly filled windows is cut anew into
whole windows and, for the last ones, into sequences whose length is a power of two,
which need no padding.

Special cases: a null text is the empty text and has the end id alone; null ids are ids like others; repeated rows
are packed one by one; texts of any length are read whole; an empty table gives no pieces.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import slices, tidy
from .tokens import encoder


class Levels:
    """Partly filled windows by fill level; choose() is the sum-of-squares rule."""

    def __init__(self, window: int):
        self.window = window
        self.count = np.zeros(window + 1, np.int64)
        self.open: list[list[list]] = [[] for _ in range(window)]

    def choose(self, r: int) -> int:
        """The level (0: a new window) where r ids leave the least sum of squares; of equals the fullest."""
        w, n = self.window, self.count
        levels = np.flatnonzero(n[1 : w - r + 1]) + 1
        best, least = 0, 2 * n[r] + 1
        if levels.size:
            cost = np.where(levels + r == w, 1 - 2 * n[levels], 2 * (n[levels + r] - n[levels]) + 2)
            k = levels.size - 1 - int(np.argmin(cost[::-1]))
            if cost[k] <= least:
                best = int(levels[k])
        return best

    def place(self, piece: tuple, r: int) -> list | None:
        """Put a piece of r ids; returns the window if that filled it."""
        h = self.choose(r)
        held = self.open[h].pop() if h else []
        self.count[h] -= h > 0
        held.append(piece)
        if h + r == self.window:
            return held
        self.open[h + r].append(held)
        self.count[h + r] += 1
        return None

    def rest(self) -> list[tuple]:
        return [piece for level in reversed(self.open) for held in level for piece in held]


def powers(n: int) -> list[int]:
    """n as a sum of descending powers of two."""
    return [1 << k for k in range(n.bit_length() - 1, -1, -1) if n >> k & 1]


def recut(pieces: list[tuple], window: int) -> list[list[tuple]]:
    """Pieces (doc, start, ids, doc_tokens) end to end, cut into whole windows and then powers of two."""
    total = sum(len(p[2]) // 4 for p in pieces)
    sizes = [window] * (total // window) + powers(total % window)
    out, at, queue = [], 0, iter(pieces)
    piece = next(queue, None)
    for size in sizes:
        held, room = [], size
        while room:
            doc, start, ids, tokens = piece
            take = min(room, len(ids) // 4 - at)
            held.append((doc, start + at, ids[4 * at : 4 * (at + take)], tokens))
            room, at = room - take, at + take
            if at == len(ids) // 4:
                piece, at = next(queue, None), 0
        out.append(held)
    return out


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "byte_bpe_50k.json", path: str | None = None, end_id: int = 0, window: int = 1024, with_ids: bool = False, cache_pieces: int = 1_200_000) -> DataFrame:
    """One row for each piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and the ids themselves).

    `cache_pieces` bounds the tokenizer's cache in each worker: fewer take less memory and more time.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids

    def run(batches):
        tidy()
        enc, levels, end = encoder(path, tokenizer, "byte", cache_pieces), Levels(window), np.array([end_id], "<u4").tobytes()
        sequence = TaskContext.get().partitionId() << 32
        rows: list[tuple] = []
        kind = None

        def close(held: list[tuple]) -> None:
            nonlocal sequence
            offset = 0
            for doc, start, ids, tokens in held:
                n = len(ids) // 4
                rows.append((doc, start, n, zlib.crc32(ids), tokens, sequence, offset) + ((ids,) if with_ids else ()))
                offset += n
            sequence += 1

        def out():
            cols = list(zip(*rows, strict=True))
            types = [kind] + [pa.int64()] * 6 + [pa.binary()] * with_ids
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

        for b in batches:
            kind = b.schema.field(0).type
            for s in slices(b, "text"):
                for doc, got in zip(s.column(0).to_pylist(), enc.encode(s.column(1).to_pylist()), strict=True):
                    ids = got + end
                    n, at = len(ids) // 4, 0
                    while n - at >= window:
                        close([(doc, at, ids[4 * at : 4 * (at + window)], n)])
                        at += window
                    if at < n and (full := levels.place((doc, at, ids[4 * at :], n), n - at)):
                        close(full)
                if rows:
                    yield out()
        for held in recut(levels.rest(), window):
            close(held)
        if rows:
            yield out()
        tidy()

    schema = f"`{id_col}` {id_type}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids binary" * with_ids
    return docs.select(F.col(id_col), F.col(text_col).alias("text")).mapInArrow(run, schema)
