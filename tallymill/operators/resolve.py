"""Fuzzy entity resolution by Jaro-Winkler within blocks, and clusters of the pairs.

Most pairs are ruled out before they are scored. With m characters matched of a
and b, Jaro is at most (m/|a| + m/|b| + 1) / 3, and m is at most what the two
bags of characters share. A common prefix of p characters (four at most) raises
a Jaro J above 0.7 to J + p (1 - J) / 10, so a similarity of t needs a J of
(t - p/10) / (1 - p/10), or more than 0.7 where that is less; without a raise it needs
t itself. Hence shared * (1/|a| + 1/|b|) >= 3 J - 1 for every pair that counts:
a test of bits and lengths, which drops no pair at or above the threshold.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymill.operators.clusters import clusters
from tallymill.operators.silver import FUZZY_THRESHOLD
from tallymill.session import materialize


def jaro_winkler(a: str, b: str, scale: float = 0.1) -> float:
    """Jaro similarity, raised by a common prefix of up to four characters where it is above 0.7."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    taken = [False] * len(b)
    left = []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == x:
                taken[j] = True
                left.append(x)
                break
    if not left:
        return 0.0
    right = [y for y, t in zip(b, taken, strict=True) if t]
    m, swaps = len(left), sum(x != y for x, y in zip(left, right, strict=True)) // 2
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    common = next((i for i, (x, y) in enumerate(zip(a[:4], b[:4], strict=False)) if x != y), min(4, len(a), len(b)))
    return jaro + common * scale * (1 - jaro) if jaro > 0.7 else jaro


def least_ratio(threshold: float) -> float:
    """The least ratio of two lengths at which the similarity can reach ``threshold``.

    All characters of the shorter name matched give Jaro (2 + ratio) / 3, and
    a common prefix of four raises a Jaro above 0.7 by 0.4 of what it lacks.
    """
    jaro = min(threshold, max(0.7, (threshold - 0.4) / 0.6))
    return max(0.0, 3 * jaro - 2 - 1e-9)


#: Characters told apart in bags, each up to this many times; all else in a name counts as shared.
_LETTERS, _TIMES = "abcdefghijklmnopqrstuvwxyz0123456789 ", 5
#: Names of a block that one task holds against all of it.
CHUNK = 2000


def letter_bag(name: Column) -> tuple[list[Column], Column]:
    """Bits for the first, second, ... time that a character stands in a name, in longs, and how many of its characters have no bit."""
    bare = [F.length(name) - F.length(F.replace(name, F.lit(c), F.lit(""))) for c in _LETTERS]
    words, held = [], F.lit(0)
    for i in range(0, len(bare), 63 // _TIMES):
        word = F.lit(0).cast("long")
        for j, n in enumerate(bare[i : i + 63 // _TIMES]):
            some = F.least(n, F.lit(_TIMES))
            ones = F.expr("shiftleft(1L, 0)")
            word = word.bitwiseOR(F.call_function("shiftleft", F.call_function("shiftleft", ones, some) - 1, F.lit(j * _TIMES)))
            held = held + some
        words.append(word)
    return words, F.length(name) - held


def least_jaro(threshold: float, prefix: int) -> float:
    """The least Jaro similarity at which names with so long a common prefix can reach ``threshold``."""
    raised = (threshold - prefix / 10) / (1 - prefix / 10)
    return min(threshold, max(0.7, raised))


def similar_pairs(df: DataFrame, key: str, name: str, block: Column, threshold: float = FUZZY_THRESHOLD) -> DataFrame:
    """(left_id, right_id, similarity) of distinct names that share a block, by the least id of each.

    Names are made distinct first, so copies don't multiply pairs;
    ``same_names`` says whose ids a name's least id stands for. A block's names
    are cut into chunks, each held against the whole block in a task of its own, so
    a block of a third of all names spreads; what is scored is what the bags of
    letters leave.
    """

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in batches:
            yield pd.Series([jaro_winkler(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")

    names = df.filter(F.col(name).isNotNull()).withColumn("__block", block).groupBy("__block", F.col(name).alias("n")).agg(F.min(key).alias("id"))
    bags, rest = letter_bag(F.col("n"))
    about = F.struct(F.col("n").alias("n"), F.col("id").alias("id"), F.length("n").alias("len"), rest.alias("rest"), *[w.alias(f"bag{i}") for i, w in enumerate(bags)])
    names = materialize(names.select("__block", about.alias("a")), "names")
    chunks = names.groupBy("__block").agg(F.ceil(F.count(F.lit(1)) / CHUNK).alias("__chunks"))
    sized = names.join(chunks, "__block")
    left = sized.withColumn("__chunk", F.pmod(F.xxhash64("a.n"), F.col("__chunks")))
    right = sized.select("__block", F.col("a").alias("b"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("__chunks") - 1)).alias("__chunk"))
    shared = F.least("a.rest", "b.rest")
    for i in range(len(bags)):
        shared = shared + F.bit_count(F.col(f"a.bag{i}").bitwiseAND(F.col(f"b.bag{i}")))
    prefix = F.lit(0)
    for p in range(4, 0, -1):
        common = (F.substring("a.n", 1, p) == F.substring("b.n", 1, p)) & (F.least("a.len", "b.len") >= p)
        prefix = F.when(common, F.lit(p)).otherwise(prefix) if p == 4 else F.when((prefix == 0) & common, F.lit(p)).otherwise(prefix)
    need = F.element_at(F.array(*[F.lit(3 * least_jaro(threshold, p) - 1 - 1e-9) for p in range(5)]), prefix + 1)
    ratio = F.least("a.len", "b.len") >= least_ratio(threshold) * F.greatest("a.len", "b.len")
    may = shared * (F.col("a.len") + F.col("b.len")) >= need * F.col("a.len") * F.col("b.len")
    pairs = left.join(right, ["__block", "__chunk"]).filter((F.col("a.id") < F.col("b.id")) & ratio & may)
    pairs = pairs.select(F.col("a.id").alias("left_id"), F.col("b.id").alias("right_id"), F.col("a.n").alias("n"), F.col("b.n").alias("n2")).withColumn("similarity", score("n", "n2"))
    return pairs.filter(F.col("similarity") >= threshold).select("left_id", "right_id", F.round("similarity", 6).alias("similarity"))


def golden_ids(df: DataFrame, key: str, name: str, block: Column, threshold: float = FUZZY_THRESHOLD) -> DataFrame:
    """(id, golden_id) of every row with a name: the least id that its name is linked to over pairs of similar names of its block.

    A row's own name counts as linked, and similar names link across everything they are linked to in turn.
    """
    linked = clusters(similar_pairs(df, key, name, block, threshold))
    rows = same_names(df, key, name, block)
    return rows.join(linked.select(F.col("id").alias("name_id"), "cluster_id"), "name_id", "left").select("id", F.coalesce("cluster_id", "name_id").alias("golden_id"))


def same_names(df: DataFrame, key: str, name: str, block: Column) -> DataFrame:
    """(id, name_id) of every row with a name: the least id of its name in its block, which ``similar_pairs`` knows it by."""
    rows = df.filter(F.col(name).isNotNull()).withColumn("__block", block)
    least = rows.groupBy(F.col("__block").alias("__b"), F.col(name).alias("__n")).agg(F.min(key).alias("name_id"))
    return rows.join(least, F.col("__block").eqNullSafe(F.col("__b")) & (F.col(name) == F.col("__n"))).select(F.col(key).alias("id"), "name_id")
