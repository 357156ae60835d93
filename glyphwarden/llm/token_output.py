"""Token-id output (operator 5): documents as separately compressed arrays of token ids.

Format: a folder with two Parquet containers, so that it can lie in any store Spark
reaches.  `dictionary` has one row (sha256, bytes): a zstandard dictionary trained on
serialized id arrays.  `blocks` has one row for each run of documents in ascending id
order: part, block, first_id, last_id, ids_before (ids of the part before the block),
n_ids, width (bytes an id), dictionary_sha256, doc_ids, n_tokens, ends, payload.
Every document is its own zstandard frame; document k of a block is
payload[ends[k-1]:ends[k]], so a short document is read without its neighbours.

Special cases: a null text is the empty text and has the end id alone; null ids come
first; rows that repeat an id are written one by one, by the hash of their
texts; texts of any length are read whole; an empty table gives no blocks.
"""

from __future__ import annotations

import hashlib
import itertools
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import slices, tidy
from .tokens import encoder

BLOCK_SCHEMA = (
    "part int, block int, first_id long, last_id long, ids_before long, n_ids long, width int, dictionary_sha256 string, "
    "doc_ids array<long>, n_tokens array<long>, ends array<long>, payload binary"
)


def train_dictionary(docs: DataFrame, id_col: str, text_col: str, tokenizer: str, path: str | None, end_id: int, sample_docs: int = 400, longest: int = 20_000, size: int = 65_536) -> bytes:
    """A dictionary from a bounded sample: the `sample_docs` documents of least id hash among those of at most
    `longest` characters (short documents are what a dictionary helps).  b"" where the sample is too small to train on."""
    import zstandard

    key = [F.xxhash64(id_col).alias("h"), F.xxhash64(text_col).alias("t")]
    short = docs.where(F.length(text_col) <= longest).select(*key, F.col(text_col).alias("text"))
    # numbers first: only texts that are chosen travel, once each
    chosen = short.select("h", "t").distinct().orderBy("h", "t").limit(sample_docs)
    rows = short.join(F.broadcast(chosen), ["h", "t"]).groupBy("h", "t").agg(F.min("text").alias("text")).orderBy("h", "t").collect()
    end, width = np.array([end_id], "<u4").tobytes(), id_width(tokenizer, path)
    arrays = [_narrow(ids + end, width) for ids in encoder(path, tokenizer, "word").encode([r["text"] for r in rows])]
    try:
        return zstandard.train_dictionary(size, arrays).as_bytes() if len(arrays) >= 16 else b""
    except zstandard.ZstdError:  # too little text
        return b""


def id_width(tokenizer: str, path: str | None) -> int:
    return 2 if encoder(path, tokenizer, "word").tokenizer.get_vocab_size() <= 65_536 else 4


def _narrow(ids: bytes, width: int) -> bytes:
    return np.frombuffer(ids, "<u4").astype("<u2").tobytes() if width == 2 else ids


def _widen(ids: bytes, width: int) -> bytes:
    return np.frombuffer(ids, "<u2").astype("<u4").tobytes() if width == 2 else ids


def write_tokens(docs: DataFrame, out: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "word_bpe_49k.json", path: str | None = None, end_id: int = 2, block_bytes: int = 1_000_000) -> None:
    """Tokenize every whole text and write the folder described above to `out`."""
    spark = docs.sparkSession
    chosen = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    dictionary = train_dictionary(chosen, "id", "text", tokenizer, path, end_id)
    sha = hashlib.sha256(dictionary).hexdigest()
    spark.createDataFrame([(sha, bytearray(dictionary))], "sha256 string, bytes binary").coalesce(1).write.parquet(f"{out}/dictionary")

    def run(batches):
        import zstandard

        enc, width = encoder(path, tokenizer, "word"), id_width(tokenizer, path)
        shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        if shared:
            shared.precompute_compress(level=3)  # else every document would digest it again
        press = zstandard.ZstdCompressor(level=3, dict_data=shared, write_content_size=True)
        end = np.array([end_id], "<u4").tobytes()
        part, blocks, before = TaskContext.get().partitionId(), itertools.count(), 0
        ids, counts, frames, size = [], [], [], 0

        def block():
            nonlocal before, ids, counts, frames, size
            known = [i for i in ids if i is not None]
            ends = np.cumsum([len(f) for f in frames]).tolist()
            row = (part, next(blocks), min(known, default=None), max(known, default=None), before, sum(counts), width, sha, ids, counts, ends, b"".join(frames))
            before += sum(counts)
            ids, counts, frames, size = [], [], [], 0
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, BLOCK_TYPES, strict=True)], names=BLOCK_NAMES)

        for b in batches:
            for s in slices(b, "text"):
                for i, got in zip(s.column(0).to_pylist(), enc.encode(s.column(1).to_pylist()), strict=True):
                    frame = press.compress(_narrow(got + end, width))
                    ids.append(i)
                    counts.append(len(got) // 4 + 1)
                    frames.append(frame)
                    size += len(frame)
                    if size >= block_bytes or len(ids) >= 4096:
                        yield block()
        if ids:
            yield block()
        tidy()

    # the hash of a text orders rows that repeat an id, and lets them fall into many parts
    ordered = chosen.withColumn("h", F.xxhash64("text")).repartitionByRange("id", "h").sortWithinPartitions("id", "h").drop("h")
    ordered.mapInArrow(run, BLOCK_SCHEMA).write.option("compression", "uncompressed").parquet(f"{out}/blocks")


BLOCK_NAMES = [f.split()[0] for f in BLOCK_SCHEMA.split(", ")]
BLOCK_TYPES = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]


def _dictionary(spark: SparkSession, out: str) -> tuple[str, bytes]:
    r = spark.read.schema("sha256 string, bytes binary").parquet(f"{out}/dictionary").first()
    data = bytes(r["bytes"])
    if hashlib.sha256(data).hexdigest() != r["sha256"]:
        raise ValueError(f"the dictionary of {out} is not the one it was written with")
    return r["sha256"], data


def _opener(sha: str, data: bytes):
    import zstandard

    plain = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data) if data else None)

    def open_frame(frame: bytes, width: int, written_with: str) -> bytes:
        if written_with != sha:
            raise ValueError("the block names another dictionary")
        return _widen(plain.decompress(frame), width)

    return open_frame


def read_tokens(spark: SparkSession, out: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids) of every document, from the files alone; ids: little-endian 32 bits."""
    sha, data = _dictionary(spark, out)
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(f"{out}/blocks")
    # one row for each part, that is for each task that wrote
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    starts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("part_start"))
    placed = blocks.join(starts, "part").select(
        (F.col("part_start") + F.col("ids_before")).alias("start"), "width", "dictionary_sha256", "doc_ids", "n_tokens", "ends", "payload"
    )

    def run(batches):
        open_frame = _opener(sha, data)
        for b in batches:
            for k in range(b.num_rows):
                start, width, with_sha, ids, counts, ends, payload = (c[0].as_py() for c in b.slice(k, 1).columns)
                arrays, at = [], 0
                for e in ends:
                    arrays.append(open_frame(payload[at:e], width, with_sha))
                    at = e
                if any(len(a) != 4 * n for a, n in zip(arrays, counts, strict=True)):
                    raise ValueError("a frame does not hold as many ids as its index says")
                firsts = start + np.concatenate([[0], np.cumsum(counts)[:-1]])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(firsts.astype(np.int64)), pa.array(counts, pa.int64()), pa.array([zlib.crc32(a) for a in arrays], pa.int64()), pa.array(arrays, pa.binary())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"],
                )

    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")


def read_document(spark: SparkSession, out: str, doc_id: int) -> list[list[int]]:
    """The ids of the rows with this id; only blocks whose id range holds it are read and only its own frames opened."""
    sha, data = _dictionary(spark, out)
    open_frame = _opener(sha, data)
    held = (
        spark.read.schema(BLOCK_SCHEMA).parquet(f"{out}/blocks")
        .where((F.col("first_id") <= doc_id) & (F.col("last_id") >= doc_id))
        .select("width", "dictionary_sha256", F.posexplode("doc_ids").alias("k", "id"), "ends", "payload")
        .where(F.col("id") == doc_id)
        .select("width", "dictionary_sha256", F.expr("substring(payload, if(k = 0, 0, ends[k - 1]) + 1, ends[k] - if(k = 0, 0, ends[k - 1]))").alias("frame"))
    )
    return [np.frombuffer(open_frame(bytes(r["frame"]), r["width"], r["dictionary_sha256"]), "<u4").tolist() for r in held.toLocalIterator()]
