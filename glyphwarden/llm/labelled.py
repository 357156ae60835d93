"""A bounded sample of labelled documents, and a bounded cache of what is derived from words."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sample(docs: DataFrame, labels: DataFrame, label: str, usable: Column, per_class: int, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, dict[int, int]]:
    """((label, h, text) of at most `per_class` usable ids of each label, the ids of each label that there are).

    Ids are those of least hash, so the choice does not depend on partitions; of an id that
    repeats the least text is taken, so the sample is bounded by rows as well.  Null ids and
    labels are left out.  `usable` is a condition on the id column of `labels`.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("y")).where(usable & F.col("id").isNotNull() & F.col("y").isin(0, 1)).distinct()
    sizes = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    h = F.xxhash64("id")
    chosen = None
    for y in (0, 1):
        part = known.where(F.col("y") == y).select("id", "y", h.alias("h")).orderBy("h", "id").limit(per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    # 2 * per_class rows of three numbers: a bounded side
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(chosen), "id")
    return texts.groupBy("id", "y", "h").agg(F.min("text").alias("text")).select("y", "h", "text"), sizes


class WordCache:
    """make(word) for words, kept in two generations of at most `room` words each."""

    def __init__(self, make: Callable, room: int = 200_000):
        self.make, self.room = make, room
        self.young: dict = {}
        self.old: dict = {}

    def of(self, words: list[str]) -> list:
        young = self.young
        missing = set(words).difference(young)
        if missing:
            if len(young) + len(missing) > self.room:
                self.old, self.young = young, {}
                young, missing = self.young, set(words)
            old, make = self.old, self.make
            for w in missing:
                got = old.get(w)
                young[w] = make(w) if got is None else got
        return list(map(young.__getitem__, words))
