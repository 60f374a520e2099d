"""Circular payments: money that comes back to its sender over one or two others.

First the accounts: a cycle of two is a pair that pays both ways, a cycle of
three is found from its account of fewest partners (ties by id), joined with two
of its partners of more, and closed by the third edge. As every account has few
partners of more than its own, the wedges stay within the edges to the power of
1.5, however many partners a hub has. Only then do transfers come in: those of
a cycle's edges are read in order of time by a sweep that keeps the window's
best chains, so that no combination of transfers is ever listed.

A cycle from ``a`` is closed by a transfer back to ``a`` that follows one for
each of the other edges, in order and strictly later each, within ``span``
seconds, together worth ``least`` or more; it counts once for its closing
transfer, with the highest such sum.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_NONE = float("-inf")


class _Chains:
    """The best sums of chains of hops i..j-1 over a stretch of time: a square of them, joined like matrices of (max, +)."""

    @staticmethod
    def of(best: list[int | None], hops: int) -> list[list[float]]:
        """Transfers of one second: none follows another, so they make chains of one hop only."""
        out = [[_NONE] * (hops + 1) for _ in range(hops + 1)]
        for i in range(hops + 1):
            out[i][i] = 0
        for i, amount in enumerate(best):
            if amount is not None:
                out[i][i + 1] = amount
        return out

    @staticmethod
    def join(a: list[list[float]], b: list[list[float]]) -> list[list[float]]:
        n = len(a)
        return [[max((a[i][k] + b[k][j] for k in range(i, j + 1)), default=_NONE) for j in range(n)] for i in range(n)]


class _Window:
    """The seconds of the window as a queue of two stacks, with the chains of what each holds."""

    def __init__(self, hops: int):
        self.hops = hops
        self.front: list[tuple] = []  # (time, chains of it and all later ones in front), oldest last
        self.back: list[tuple] = []
        self.whole: list | None = None  # chains of the back

    def push(self, time: int, chains: list) -> None:
        self.back.append((time, chains))
        self.whole = chains if self.whole is None else _Chains.join(self.whole, chains)

    def drop_before(self, time: int) -> None:
        while True:
            if not self.front:
                if not self.back or self.back[0][0] >= time:
                    return
                rest = None
                while self.back:
                    t, c = self.back.pop()
                    rest = c if rest is None else _Chains.join(c, rest)
                    self.front.append((t, rest))
                self.whole = None
            if self.front[-1][0] >= time:
                return
            self.front.pop()

    def best(self) -> float:
        """The best chain over all hops."""
        parts = [x for x in (self.front[-1][1] if self.front else None, self.whole) if x is not None]
        if not parts:
            return _NONE
        return (parts[0] if len(parts) == 1 else _Chains.join(*parts))[0][self.hops]


def closings(hops: Iterator[tuple], chain: int, span: int) -> Iterator[tuple]:
    """From (cycle, time, hop, txn, amount) in order of cycle and time the closing transfers: (cycle, time, txn, best sum of the hops before with its own).

    ``chain``: the hops before the closing one, which is hop number ``chain``.
    """
    now, window, second, waiting, closing = None, None, None, [None] * chain, []

    def settle() -> Iterator[tuple]:
        """Close what this second closes by what came before, then let its transfers in."""
        nonlocal waiting, closing
        if closing:
            window.drop_before(second - span)
            best = window.best()
            if best > _NONE:
                for txn, amount in closing:
                    yield now, second, txn, int(best) + amount
        if any(x is not None for x in waiting):
            window.drop_before(second - span)
            window.push(second, _Chains.of(waiting, chain))
        waiting, closing = [None] * chain, []

    for cycle, time, hop, txn, amount in hops:
        if (cycle, time) != (now, second):
            if now is not None:
                yield from settle()
            if cycle != now:
                window = _Window(chain)
            now, second = cycle, time
        if hop == chain:
            closing.append((txn, amount))
        else:
            waiting[hop] = amount if waiting[hop] is None else max(waiting[hop], amount)
    if now is not None:
        yield from settle()


def account_cycles(edges: DataFrame, length: int) -> DataFrame:
    """From different (u, v) the cycles of two or three accounts as arrays, each from each of its accounts."""
    if length == 2:
        back = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
        found = edges.join(back, ["u", "v"]).filter(F.col("u") < F.col("v")).select(F.array("u", "v").alias("cycle"))
    else:
        ends = edges.select("u", "v").union(edges.select("v", "u")).distinct()
        degree = ends.groupBy("u").agg(F.count(F.lit(1)).alias("d"))
        e = edges.join(degree.toDF("u", "du"), "u").join(degree.toDF("v", "dv"), "v")
        order = lambda d, x: F.struct(F.col(d), F.col(x))
        rises = order("du", "u") < order("dv", "v")
        into = e.filter(~rises).select(F.col("v").alias("m"), F.col("u").alias("x"))
        out = e.filter(rises).select(F.col("u").alias("m"), F.col("v").alias("y"))
        wedges = into.join(out, "m").filter(F.col("x") != F.col("y"))
        found = wedges.join(edges.select(F.col("u").alias("y"), F.col("v").alias("x")), ["x", "y"]).select(F.array("x", "m", "y").alias("cycle"))
    turned = F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda i: F.concat(F.slice("cycle", i + 1, F.lit(length)), F.slice("cycle", F.lit(1), i)))
    return found.select(F.explode(turned).alias("cycle"))


def circular_payments(t: DataFrame, length: int = 3, least: float = 500_000, span: int = 7 * 86_400, repeats: int = 3) -> DataFrame:
    """Cycles (an array of accounts, the first of which pays first and is paid last) closed ``repeats`` times or more within some ``span`` seconds.

    n_cycles counts all closings of the cycle, largest is the highest sum, first_alert_at the second of the first closing that
    makes up the number. Transfers without an account, a time or an amount are in no cycle, nor are those to oneself.
    """
    if length not in (2, 3):
        raise ValueError("cycles have two or three accounts")
    known = [F.col(c).isNotNull() for c in ("sender", "receiver", "at", "amount")]
    paid = t.filter(known[0] & known[1] & known[2] & known[3] & (F.col("sender") != F.col("receiver")))
    paid = paid.select("sender", "receiver", "at", F.col("txn").cast("string").alias("txn"), F.round(F.col("amount").cast("decimal(18,2)") * 100).cast("long").alias("amount"))
    cycles = account_cycles(paid.select(F.col("sender").alias("u"), F.col("receiver").alias("v")).distinct(), length)
    edge = F.posexplode(F.transform(F.sequence(F.lit(1), F.lit(length)), lambda i: F.struct(F.element_at("cycle", i).alias("s"), F.element_at("cycle", i % length + 1).alias("r"))))
    sides = cycles.select("cycle", edge.alias("hop", "edge")).select("cycle", "hop", F.col("edge.s").alias("sender"), F.col("edge.r").alias("receiver"))
    hops = sides.join(paid, ["sender", "receiver"]).select("cycle", "at", "hop", "txn", "amount")

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                cycle, *rest = (c.to_pylist() for c in batch.columns)
                yield from zip(map(tuple, cycle), *rest)

        def made(some: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*some)) if some else [[], [], [], []]
            types = [pa.list_(kind), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(list(map(list, c)) if i == 0 else list(c), k) for i, (c, k) in enumerate(zip(columns, types))], ["cycle", "at", "txn", "total"])

        held = []
        for found in closings(rows(), length - 1, span):
            held.append(found)
            if len(held) == 10_000:
                yield made(held)
                held = []
        yield made(held)

    account = dict(paid.dtypes)["sender"]
    kind = pa.string() if account == "string" else pa.int64()
    if account not in ("string", "bigint"):
        raise ValueError("accounts are longs or strings")
    ordered = hops.repartition("cycle").sortWithinPartitions("cycle", "at")
    closed = ordered.mapInArrow(sweep, f"cycle array<{account}>, at long, txn string, total long").filter(F.col("total") >= round(least * 100))
    closed = closed.groupBy("cycle", "at", "txn").agg(F.max("total").alias("total"))  # a row given twice closes once
    before = F.lag("at", repeats - 1).over(Window.partitionBy("cycle").orderBy("at", "txn"))
    alert = F.when(F.col("at") - before <= span, F.col("at"))
    by = closed.withColumn("__alert", alert).groupBy("cycle").agg(F.count(F.lit(1)).alias("n_cycles"), (F.max("total") / 100).alias("largest"), F.min("__alert").alias("first_alert_at"))
    return by.filter(F.col("first_alert_at").isNotNull())
