"""Mixing sources to target weights by systematic sampling.

Every source has a rate, its target words over its words. Within a source the
documents stand by size, their expected copies (the rate each) are
prefix-summed, one random offset is added, and a document comes once per
integer boundary that its step crosses. Standing by size bounds the error of a
source's words by the size of its largest document.

Edge cases: a null text has size 0; a null source is a source of its own, the
last one; a source without words has target 0; repeated rows count one by one;
an empty table gives an empty result; extra columns are not read. The offset
comes from the seed and the source's name, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallymill.llm.ranking import gapless_rank
from tallymill.llm.rows import free_name, placed_rows
from tallymill.session import materialize

WEIGHTS = (3, 1, 2)
SEED = 17
#: Up to this many row ids with their copies (16 bytes each) are sent to all tasks; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def source_targets(sizes: DataFrame, weights=WEIGHTS, budget: float = 1.5, most: float = 2.0) -> DataFrame:
    """From (mix_source, source_size), one row a source, add the target.

    Targets are min(most * source_size, weight * level) with the one level
    that spends the budget; resharing the excess by weight ends there.
    """
    by_name = Window.orderBy(F.col("mix_source").asc_nulls_last())
    whole = Window.partitionBy()
    turn = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn.cast("int") + 1)
    s = sizes.withColumn("__w", weight).withColumn("__cap", F.col("source_size") * F.lit(most))
    s = s.withColumn("__budget", F.sum("source_size").over(whole) * F.lit(budget))
    fill = Window.orderBy(F.col("__cap") / F.col("__w"), F.col("mix_source").asc_nulls_last())
    spent = F.coalesce(F.sum("__cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    open_weight = F.sum("__w").over(fill.rowsBetween(0, Window.unboundedFollowing))
    s = s.withColumn("__level", (F.col("__budget") - spent) / open_weight).withColumn("__turn", F.row_number().over(fill))
    fits = F.when(F.col("__level") * F.col("__w") <= F.col("__cap"), F.struct("__turn", "__level"))
    s = s.withColumn("__level", F.min(fits).over(whole)["__level"])
    target = F.least(F.col("__cap"), F.col("__w") * F.coalesce(F.col("__level"), F.lit(float("inf"))))
    return s.select("mix_source", "source_size", target.alias("target"))


def _offset(source, seed: int):
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def mix_sources(
    docs: DataFrame, weights=WEIGHTS, budget: float = 1.5, most: float = 2.0, seed: int = SEED, key: str = "doc_id", text: str = "text", source: str = "source", carry: tuple = ()
) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row; ``carry`` names further columns to keep."""
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    rows = materialize(docs.select(F.col(key).alias("doc_id"), F.col(source).alias("mix_source"), size.alias("size"), *carry), "sized")
    sums = rows.groupBy("mix_source").agg(F.sum("size").alias("source_size"))
    goals = source_targets(sums, weights, budget, most).withColumnRenamed("mix_source", "__source")
    ranked = gapless_rank(rows, "mix_source", ["size", "doc_id"], "__rank")
    r = ranked.join(goals, ranked["mix_source"].eqNullSafe(goals["__source"]))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    r = r.withColumn("__rate", rate).withColumn("__start", _offset(F.col("mix_source"), seed))
    edge = lambda k: F.floor(F.col("__start") + k * F.col("__rate"))
    copies = F.least(edge(F.col("__rank") + 1) - edge(F.col("__rank")), F.ceil("__rate"))
    return r.select("doc_id", "size", "source_size", "target", (copies * F.col("size")).cast("long").alias("taken"), copies.cast("long").alias("copies"), *carry)


def mixed_documents(docs: DataFrame, from_files: bool = False) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, with their columns as they were. ``from_files``: see rows.py."""
    rows, file, row = placed_rows(docs, from_files)
    times, turn = free_name(rows.columns, "__times"), free_name(rows.columns, "__turn")
    narrow = rows.select(*[F.col(c).alias(n) for c, n in (("doc_id", "doc_id"), ("text", "text"), ("source", "source"), (file, "file"), (row, "row"))])
    taken = mix_sources(narrow, carry=("file", "row")).filter(F.col("copies") > 0)
    taken = materialize(taken.select(F.col("file").alias(file), F.col("row").alias(row), F.col("copies").alias(times)), "copies")
    few = taken.count() <= BROADCAST_ROWS
    joined = rows.join(F.broadcast(taken) if few else taken, [file, row])
    return joined.withColumn(turn, F.explode(F.sequence(F.lit(1).cast("long"), F.col(times)))).select(*docs.columns)
