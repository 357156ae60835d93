"""Benchmark decontamination (operator 1), with DataFrame functions alone.

A text is lower-cased in A-Z and split into words (digits, letters and all non-ASCII).
A window is `size` consecutive words of a benchmark item; an item of fewer words is one
window.  Any occurrence of a window of L words, wherever it starts, holds a chunk of
c = ceil(L / 2) words whose position is a multiple of s = L - c + 1; so documents are
scanned at those positions only, and the benchmark gives its chunks at all s offsets.
Chunk hashes are looked up in the broadcast hash set; each row takes along the words
around its chunk, and every hit is verified on them, word for word.  Documents are
never shuffled: only verified hits and one row for each document are.

The set is broadcast up to `broadcast_bytes` (its texts are measured first); a larger one is
joined by Spark's own choice.  Special cases: null and empty texts have no words and no
hits; null ids are ids like others; benchmark rows without an id or words are left out; repeated document rows each
get their row; a text of any length is scanned whole, as one row's array of chunks; an empty benchmark hits nothing,
an empty table gives an empty result; columns of any name are kept as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import ascii_lower, few, stored, unused

#: Fixed value of the contract: what stands between words, after lower-casing.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BETWEEN), "")


def chunk_sizes(length: int) -> tuple[int, int]:
    """(words in a chunk, step between chunks) for windows of this length."""
    chunk = (length + 1) // 2
    return chunk, length - chunk + 1


def _chunk_hash(length: Column | int, chunk: Column) -> Column:
    return F.xxhash64(F.lit(length) if isinstance(length, int) else length, chunk)


def windows(benchmark: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """(item_id, length, window) of every item, each window once for an item."""
    w = F.col("w")
    return (
        benchmark.where(F.col(id_col).isNotNull())
        .select(F.col(id_col).cast("string").alias("item_id"), words(F.col(text_col)).alias("w"))
        .where(F.size(w) > 0)
        .select("item_id", "w", F.least(F.size(w), F.lit(size)).alias("length"))
        .select("item_id", "length", F.explode(F.expr("transform(sequence(1, size(w) - length + 1), i -> array_join(slice(w, i, length), ' '))")).alias("window"))
        .distinct()
    )


def chunk_set(found: DataFrame) -> DataFrame:
    """(h, shift, length, window, item_id): a row for each chunk of each window."""
    return found.select(
        "item_id", "length", "window",
        F.explode(F.expr("transform(sequence(0, length - ceil(length / 2)), o -> struct(cast(o as int) as shift, array_join(slice(split(window, ' '), o + 1, int(ceil(length / 2))), ' ') as chunk))")).alias("c"),
    ).select(_chunk_hash(F.col("length"), F.col("c.chunk")).alias("h"), F.col("c.shift").alias("shift"), F.col("length").alias("w_length"), "window", "item_id")


def _chunks(length: int) -> Column:
    """The chunks of the words column w, with the words that a window around each can have.

    Words are taken one by one: slice() would copy the whole array for each chunk, which long texts can't bear.
    """
    c, s = chunk_sizes(length)

    def joined(first: int, last: int) -> str:
        return f"concat_ws(' ', {', '.join(f'get(w, q + {k})' for k in range(first, last + 1))})"

    return F.expr(
        f"""if(size(w) < {length}, array(), transform(sequence(0, size(w) - {c}, {s}), q -> struct(
            q as q, {length} as length, {joined(0, c - 1)} as chunk, {joined(1 - s, length - 1)} as around)))"""
    ).cast("array<struct<q:int,length:int,chunk:string,around:string>>")


def hits(docs: DataFrame, benchmark: DataFrame, keys: list[Column], text: Column, item_id: str = "item_id", item_text: str = "text", size: int = 13, broadcast_bytes: int = 64_000_000) -> DataFrame:
    """keys, n_words, positions array<struct<p,length>>, items array<string> of every row of docs; keys must tell rows apart."""
    names = [f"k{i}" for i in range(len(keys))]
    found = stored(windows(benchmark, item_id, item_text, size), "windows")
    # at most `size` lengths
    lengths = sorted(r[0] for r in found.select("length").distinct().collect())
    chunks = chunk_set(found)
    each = F.octet_length("window") + F.octet_length("item_id") + 64
    held = found.agg(F.coalesce(F.sum((F.col("length") - F.ceil(F.col("length") / 2) + 1) * each), F.lit(0))).first()[0]
    if held <= broadcast_bytes:
        chunks = F.broadcast(chunks)

    # each document's own record comes first, so that documents without a chunk stay
    own = F.array(F.struct(F.lit(-1).alias("q"), F.lit(0).alias("length"), F.lit("").alias("chunk"), F.lit("").alias("around")))
    texts = docs.select(*(k.alias(n) for k, n in zip(keys, names, strict=True)), words(text).alias("w"))
    # the number of words is taken before the words are exploded, so that no exploded row carries them
    texts = texts.select(*names, F.size("w").cast("long").alias("n_words"), "w")
    scanned = texts.select(*names, "n_words", F.explode(F.concat(own, *(_chunks(n) for n in lengths))).alias("c")).select(
        *names, "n_words", "c.q", "c.length", 
        # a document's own record matches nothing (no window has length 0); its hash deals such records out
        F.when(F.col("c.q") >= 0, _chunk_hash(F.col("c.length"), F.col("c.chunk"))).otherwise(F.xxhash64(*names)).alias("dh"), "c.around"
    )
    p = F.col("q") - F.col("shift")
    joined = scanned.join(chunks, (F.col("dh") == F.col("h")) & (F.col("length") == F.col("w_length")), "left")
    step = F.col("length") - F.ceil(F.col("length") / 2) + 1
    first = F.greatest(F.col("q") - step + 1, F.lit(0))
    same = F.array_join(F.slice(F.split("around", " "), (p - first + 1).cast("int"), F.col("length")), " ") == F.col("window")
    kept = joined.where((F.col("q") < 0) | F.when(F.col("h").isNotNull() & (p >= 0), same).otherwise(False))
    hit = F.col("q") >= 0
    return kept.groupBy(*names).agg(
        F.max("n_words").alias("n_words"),
        F.collect_set(F.when(hit, F.struct(p.cast("int").alias("p"), F.col("length").alias("length")))).alias("positions"),
        F.collect_set(F.when(hit, F.col("item_id"))).alias("items"),
    )


def _hit_words(positions: str = "positions") -> Column:
    return F.expr(f"array_distinct(flatten(transform({positions}, x -> sequence(x.p, x.p + x.length - 1))))")


def is_contaminated(n_hit: Column, n_words: Column, share: int = 20) -> Column:
    return (n_hit > 0) & (share * n_hit >= n_words)


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 13) -> DataFrame:
    """id, n_words, n_hit, n_items, items_sha256, contaminated of every row."""
    found = hits(docs, benchmark, [F.col(id_col), F.monotonically_increasing_id()], F.col(text_col), size=size)
    n_hit = F.size(_hit_words()).cast("long")
    return found.select(
        F.col("k0").alias(id_col), "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        is_contaminated(n_hit, F.col("n_words")).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", size: int = 13, remove: str = "documents") -> DataFrame:
    """The same columns without contaminated documents, or (remove="spans") with the hit words of any document cut out.

    The verdict depends on the text alone, so rows are matched by the hash of their text.
    """
    key = F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))
    found = hits(docs, benchmark, [key, F.monotonically_increasing_id()], F.col(text_col), size=size)
    k, hit, pieces = unused(docs, "__key", "__hit", "__pieces")
    counted = found.select(F.col("k0").alias(k), "n_words", _hit_words().alias(hit)).where(F.size(hit) > 0)
    names = [F.col(f"`{c}`") for c in docs.columns]
    if remove == "documents":
        gone = stored(counted.where(is_contaminated(F.size(hit), F.col("n_words"))).select(k).distinct(), "contaminated")
        return docs.withColumn(k, key).join(few(gone, 500_000), k, "left_anti").select(*names)
    cut = stored(counted.select(k, hit).dropDuplicates([k]), "hit-words")
    every = F.regexp_extract_all(F.col(text_col), F.lit(r"[0-9A-Za-z\x{80}-\x{10FFFF}]+|[^0-9A-Za-z\x{80}-\x{10FFFF}]+"), F.lit(0))
    kept = F.expr(f"array_join(filter({pieces}, (x, i) -> (i % 2 = 0) != ({pieces}[0] rlike '^[0-9A-Za-z\\\\x{{80}}-\\\\x{{10FFFF}}]') or not array_contains({hit}, int(i div 2))), '')")
    return (
        docs.withColumn(k, key).join(cut, k, "left").withColumn(pieces, F.when(F.col(hit).isNotNull(), every))
        .withColumn(text_col, F.when(F.col(hit).isNull(), F.col(text_col)).otherwise(kept)).select(*names)
    )
