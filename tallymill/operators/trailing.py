"""Sums, counts and distinct counts over a trailing span of seconds, in time linear in the rows.

What a window holds is the running sum up to a row's time, less the running sum
up to the last second before the span; both are frames without a lower end over
the same sorted rows, so no row looks back over the window. A distinct count is
such a difference too: a party's rows that follow each other within the span are
one stay, which is counted up at its first row and down a span after its last.

Keys are cut into blocks of time a little longer than the longest span. The rows
of a block's last span stand in the next block as well, where they only count,
so blocks are summed on their own: a busy account is dealt over as many tasks as
it has blocks, and a row is sorted twice at most, however many sums it is in.
Sums of decimals are exact; decayed sums are scaled to the block's start, so
that nothing overflows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Half-lives to a block that a double's exponent can hold.
_MOST_HALVINGS = 900


@dataclass(frozen=True)
class Total:
    """The sum of ``value`` (a whole number or decimal; null counts as 0) over the rows of the last ``span`` seconds."""

    span: int
    value: Column


@dataclass(frozen=True)
class Different:
    """How many values other than null the column ``party`` has in the last ``span`` seconds."""

    span: int
    party: str


@dataclass(frozen=True)
class Decayed:
    """The rows of the last ``span`` seconds, each counted as 1/2 to the power of its age in half-lives."""

    span: int
    half_life: int


def count_if(hit: Column) -> Column:
    return F.coalesce(hit, F.lit(False)).cast("long")


def cents(amount: str) -> Column:
    return F.col(amount).cast("decimal(18,2)")


def squares(amount: str) -> Column:
    return (cents(amount) * cents(amount)).cast("decimal(36,4)")


def deviation(n: Column, total: Column, square: Column) -> Column:
    """The sample's standard deviation from exact sums; null for fewer than two."""
    return F.when(n > 1, F.sqrt((n * square - total * total).cast("double") / (n * (n - 1)).cast("double")))


def with_trailing(t: DataFrame, key: str | list[str], stats: dict[str, Total | Different | Decayed], at: str = "at") -> DataFrame:
    """``t`` with a column for each of ``stats``, over the rows of the same ``key`` up to ``span`` seconds before, rows of the same second included.

    Rows without a time have nulls there and count for no other row; rows whose key is null are one key.
    """
    keys = [key] if isinstance(key, str) else list(key)
    names = [f"__key{i}" for i in range(len(keys))]
    longest = max(s.span for s in stats.values())
    block = longest + 1
    for name, s in stats.items():
        if isinstance(s, Decayed) and block > _MOST_HALVINGS * s.half_life:
            raise ValueError(f"{name}: a half-life of {s.half_life} seconds is too short beside spans of {block - 1}")
    now = F.col(at)
    mine = F.floor(now / block)
    place = lambda b, own: F.struct(b.alias("block"), F.lit(own).alias("own"))
    places = F.array_compact(F.array(place(mine, True), F.when(now + longest >= (mine + 1) * block, place(mine + 1, False))))
    given = {name: F.coalesce(s.value, F.lit(0)) if isinstance(s, Total) else F.col(s.party) for name, s in stats.items() if not isinstance(s, Decayed)}
    e = t.select(
        *[F.col(k).alias(n) for k, n in zip(keys, names)],
        F.struct(*[F.col(c) for c in t.columns]).alias("__row"),
        *[v.alias(f"__given_{name}") for name, v in given.items()],
        now.alias("__at"),
        F.explode(places).alias("__place"),
    )
    e = e.withColumns({"__block": F.col("__place.block"), "__own": F.col("__place.own"), "__row": F.when(F.col("__place.own"), F.col("__row"))}).drop("__place")
    e = e.repartition(*names, "__block")  # all windows below are within these
    start = F.col("__block") * block
    adds, takes = {}, {}
    for name, s in stats.items():
        adds[name] = takes[name] = F.col(f"__given_{name}")
        if isinstance(s, Different):
            same = Window.partitionBy(*names, "__block", f"__given_{name}").orderBy("__at")
            e = e.withColumns({f"__last_{name}": F.lag("__at").over(same), f"__next_{name}": F.lead("__at").over(same)})
            apart = lambda gap: (F.col(f"__given_{name}").isNotNull() & F.coalesce(gap > s.span, F.lit(True))).cast("long")  # noqa: B023, E731
            adds[name], takes[name] = apart(F.col("__at") - F.col(f"__last_{name}")), apart(F.col(f"__next_{name}") - F.col("__at"))
        elif isinstance(s, Decayed):
            adds[name] = takes[name] = F.pow(F.lit(2.0), (F.col("__at") - start) / s.half_life)
    e = e.select(*names, "__block", "__own", "__row", "__at", *[c.alias(f"__{k}_{n}") for k, some in (("add", adds), ("take", takes)) for n, c in some.items()])
    w = Window.partitionBy(*names, "__block").orderBy("__at")
    upto = lambda seconds: w.rangeBetween(Window.unboundedPreceding, seconds)
    e = e.withColumns({f"__sum_{n}": F.sum(f"__add_{n}").over(upto(0)) for n in stats} | {f"__old_{n}": F.sum(f"__take_{n}").over(upto(-s.span - 1)) for n, s in stats.items()})
    kinds, sums = dict(e.dtypes), {}
    for name, s in stats.items():
        total = (F.col(f"__sum_{name}") - F.coalesce(f"__old_{name}", F.lit(0))).cast(kinds[f"__sum_{name}"])
        if isinstance(s, Decayed):
            total = F.greatest(total * F.pow(F.lit(2.0), (start - F.col("__at")) / s.half_life), F.lit(0.0))
        sums[name] = F.when(F.col("__at").isNotNull(), total)
    return e.filter("__own").select("__row", *[v.alias(n) for n, v in sums.items()]).select("__row.*", *sums)
