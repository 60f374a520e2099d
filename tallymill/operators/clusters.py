"""Connected classes of pairs, as tables: labels spread by stars, nothing is gathered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymill.session import discard, materialize


def _least(edges: DataFrame) -> DataFrame:
    """u with the least of itself and its neighbours."""
    return edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))


def _signature(edges: DataFrame):
    """Count and an order-free hash of the edges, to see when nothing changes any more."""
    return edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()


def clusters(pairs: DataFrame, left: str = "left_id", right: str = "right_id") -> DataFrame:
    """(id, cluster_id) of every id in a pair: the least id that it is connected to.

    Two steps in turn until they change nothing: every vertex hangs its greater
    neighbours on its least one, then its lesser ones and itself. The number of
    rounds grows with the logarithm of the longest chain; in a round a vertex's
    neighbours are only aggregated and joined, never collected. Pairs with a
    null, of one id with itself or given twice change nothing.
    """
    a, b = F.col(left), F.col(right)
    edges = pairs.filter(a.isNotNull() & b.isNotNull()).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    edges = materialize(edges, "edges")
    ids = materialize(edges.select(F.col("u").alias("id")).union(edges.select("v")).distinct(), "ids")
    edges_now = edges.filter(F.col("u") != F.col("v"))
    seen, held = None, [edges]
    while True:
        both = edges_now.select("u", "v").union(edges_now.select("v", "u"))
        large = both.join(_least(both), "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter(F.col("u") != F.col("v")).distinct()
        low = _least(large)
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        step = materialize(small.filter(F.col("u") != F.col("v")).distinct(), "stars")
        now = _signature(step)
        discard(*held)
        edges_now, held = step, [step]
        if now == seen:
            break
        seen = now
    labels = edges_now.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("cluster_id"))
    return ids.join(labels, "id", "left").select("id", F.coalesce("cluster_id", "id").alias("cluster_id"))
