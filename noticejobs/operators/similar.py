"""Near-equal documents by Jaccard similarity of word n-grams: exactly, and by banded MinHash for large corpora.

Both ways collapse documents with equal n-grams into classes, make candidate pairs of classes from shared keys (rare n-grams, or
bands of a MinHash signature), and decide every candidate by its whole sets. A key that very many classes share is split: its
classes are dealt to sub-buckets of bounded size, and each meets the classes of every sub-bucket in another task.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noticejobs.sources.shared import discard, materialized

#: Classes of a sub-bucket.
BUCKET_CLASSES = 256
#: Bands and values of a band: a pair at similarity 0.8 shares no band with a probability of 5e-8, one at 0.3 shares some with 0.23.
BANDS, ROWS = 32, 4


#: Ids that are broadcast at most.
BROADCAST_IDS = 1 << 21


@dataclass
class Classes:
    #: (id, s, n): the smallest id of each class, its sorted set and the set's size.
    sets: DataFrame
    #: (id): the same ids, without their sets.
    first: DataFrame
    #: (key, a, b, jaccard): every other document of a class with the class' smallest id.
    copies: DataFrame
    #: (id, s, n, key): all documents.
    stored: DataFrame

    def discard(self) -> None:
        discard(self.stored, self.copies)


def classes_of(docs: DataFrame, n: int) -> Classes:
    """Classes of ``docs`` (id, content) by their distinct n-grams of words; documents with fewer than n words are in none."""
    words = docs.select("id", F.filter(F.split(F.lower("content"), r"\s+"), lambda w: w != "").alias("w"))
    rows = F.transform(F.sequence(F.lit(0), F.size("w") - n), lambda i: F.xxhash64(*[F.get("w", i + k) for k in range(n)]))
    keyed = words.filter(F.size("w") >= n).select("id", F.sort_array(F.array_distinct(rows)).alias("s"))
    keyed = materialized(keyed.withColumn("n", F.size("s")).withColumn("key", F.md5(F.array_join(F.transform("s", lambda x: x.cast("string")), ","))))
    first = keyed.groupBy("key").agg(F.min("id").alias("a"))
    copies = materialized(keyed.select("key", F.col("id").alias("b")).join(first, "key").filter("a <> b").select("key", "a", "b", F.lit(1.0).alias("jaccard")))
    ids = first.select(F.col("a").alias("id"))
    again = copies.select(F.col("b").alias("id"), "key").distinct()  # few beside all: no set is moved to leave them out
    sets = keyed.filter("id is not null").join(F.broadcast(again) if copies.count() <= BROADCAST_IDS else again, ["id", "key"], "left_anti").select("id", "s", "n")
    return Classes(sets, ids, copies, keyed)


def sharing_pairs(entries: DataFrame, near: Column, bucket: int = BUCKET_CLASSES) -> DataFrame:
    """(a, b), a < b, of the rows (key, id, n) that share a key; ``near`` is a condition on the sizes na and nb."""
    sizes = entries.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1").select("key", F.ceil(F.col("c") / bucket).cast("int").alias("parts"))
    held = entries.join(sizes, "key")
    left = held.select("key", F.col("id").alias("a"), F.col("n").alias("na"), F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"))
    right = held.select("key", F.col("id").alias("b"), F.col("n").alias("nb"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    return left.join(right, ["key", "part"]).filter((F.col("a") < F.col("b")) & near).select("a", "b").distinct()


def verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(a, b, jaccard) of the pairs that reach the threshold. Only sets that stand in a pair are moved."""
    pairs = materialized(pairs)
    needed = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    sets = sets.select("id", "s").join(F.broadcast(needed) if needed.count() <= BROADCAST_IDS else needed, "id", "left_semi")
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b")
    both = both.withColumn("common", F.size(F.array_intersect("sa", "sb")))
    scored = both.select("a", "b", F.round(F.col("common") / (F.size("sa") + F.size("sb") - F.col("common")), 6).alias("jaccard"))
    return scored.filter(F.col("jaccard") >= threshold)


def sizes_allow(threshold: float) -> Column:
    return F.least("na", "nb") >= F.lit(threshold) * F.greatest("na", "nb")


def shared_prefixes(sets: DataFrame, threshold: float) -> DataFrame:
    """(key, id, n): of the ``n - ceil(threshold * n) + 1`` rarest n-grams of each set, those that other sets have.

    N-grams of one set come first in that order, so they need only be counted: n-grams are shuffled once, and of a set that shares c of them the rarest
    ``c - ceil(threshold * n) + 1`` are kept. Sets that share fewer than ``ceil(threshold * n)`` are like no other.
    """
    grams = sets.select("id", F.explode("s").alias("g")).repartition("g")
    # Ids are distinct, so the least and the largest differ if there are several; both sides read one shuffle.
    shared = grams.groupBy("g").agg(F.count("*").alias("df"), F.min("id").alias("least"), F.max("id").alias("largest")).filter("least < largest")
    held = grams.join(shared.select("g", "df").hint("shuffle_hash"), "g").join(sets.select("id", "n"), "id")
    least = F.ceil(F.lit(threshold) * F.col("n"))
    near = held.withColumn("c", F.count("*").over(Window.partitionBy("id"))).filter(F.col("c") >= least)
    order = F.row_number().over(Window.partitionBy("id").orderBy("df", "g"))
    return near.withColumn("k", order).filter(F.col("k") <= F.col("c") - least + 1).select(F.col("g").alias("key"), "id", "n")


def compare_documents(docs: DataFrame, threshold: float = 0.8, n: int = 5) -> DataFrame:
    """Near-equal documents: (a, b, jaccard).

    The smallest id of a class is paired with each other member (1.0), and stands for them in the pairs between classes. Two
    sets that are similar enough share one of their ``n - ceil(threshold * n) + 1`` rarest n-grams, so only those
    make candidates, without any cap.
    """
    found = classes_of(docs, n)
    entries = materialized(shared_prefixes(found.sets, threshold))
    return verified(sharing_pairs(entries, sizes_allow(threshold)), found.stored, threshold).unionByName(found.copies.drop("key"))


_SEEDS = np.random.default_rng(12).integers(0, 1 << 64, (2, BANDS * ROWS), np.uint64)


@F.pandas_udf(T.ArrayType(T.LongType()))
def bands(sets: pd.Series) -> pd.Series:
    """Keys of the bands of a set's MinHash signature: the least values of ``a x + b`` modulo 2^64, a odd, folded by band."""
    a, b = _SEEDS[0] | np.uint64(1), _SEEDS[1]
    out = []
    for s in sets:
        x = np.asarray(s, np.int64).view(np.uint64)
        least = np.array([(x * a[j] + b[j]).min() for j in range(BANDS * ROWS)]).reshape(BANDS, ROWS)
        keys = np.arange(1, BANDS + 1, dtype=np.uint64)
        for j in range(ROWS):
            keys = (keys ^ (least[:, j] >> np.uint64(7))) * np.uint64(0x9E3779B97F4A7C15)
            keys ^= keys >> np.uint64(32)
        out.append(keys.view(np.int64))
    return pd.Series(out)


def near_documents(docs: DataFrame, threshold: float = 0.8, n: int = 5, bucket: int = BUCKET_CLASSES) -> DataFrame:
    """As compare_documents, for large corpora: candidates share a band of a MinHash signature.

    A class makes ``BANDS`` rows whatever the length of its documents, no frequency is counted over the corpus and no n-gram is
    shuffled but those of candidates; pairs of low similarity seldom meet. What it may miss is a pair that shares no band.
    """
    found = classes_of(docs, n)
    signed = found.stored.select("id", F.size("s").alias("n"), bands("s").alias("keys")).join(found.first, "id", "left_semi")  # no set is moved
    entries = materialized(signed.select(F.explode("keys").alias("key"), "id", "n"))
    return verified(sharing_pairs(entries, sizes_allow(threshold), bucket), found.stored, threshold).unionByName(found.copies.drop("key"))
