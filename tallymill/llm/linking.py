"""Links between members of buckets, and the groups that links connect.

Bucket members meet hubs first: in the first round each is compared with the
least hub of its buckets, in the next ones the members of every bucket that
still holds several groups with hubs of other groups, one of the least group,
one of the greatest and any one, drawn anew each round. That is linear in the
members and joins the dense groups. What is open then is settled whole: every
pair of vertices of different groups that shares a key is tested, once. The
keys are those of the open buckets, or narrower ones that the caller makes for
the open vertices. No cap or number of rounds ends the search, so groups are
those of an exhaustive comparison within buckets.

Links found in a round are contracted to links between groups before they are
united, so a round costs what is new in it. Of every key, the members of its
largest group meet the others only, and pairs are filtered where they arise.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymill.session import discard, materialize

#: Up to this many buckets with several members (32 bytes each) are sent to all tasks; more are joined by a shuffle.
BROADCAST_BUCKETS = 1_000_000
#: What a task reads when the size of the rows is known beforehand.
TASK_BYTES, LINK_BYTES = 24 << 20, 100
#: Rounds with hubs; what they leave open is settled whole.
ROUNDS = 3


def sized(df: DataFrame, size: float) -> DataFrame:
    """With as many partitions at most as ``size`` bytes need: rounds over few links should not start many tasks."""
    return df.coalesce(max(1, int(-(-size // TASK_BYTES))))


def components(edges: DataFrame) -> DataFrame:
    """(v, c): for every end of an edge (a, b) the least vertex that edges lead to.

    Each round takes the least group among a vertex's neighbours, hooks the
    vertex's present group under it and follows one pointer, so the rounds grow
    with the logarithm of a group's diameter. All of it is joins and minima.
    """
    both = materialize(edges.select("a", "b").union(edges.select("b", "a")), "edges")
    size = both.count() * LINK_BYTES
    now = both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("c")).select("v", F.least("v", "c").alias("c"))
    now = materialize(sized(now, size), "groups")
    while True:
        near = both.join(now, both["b"] == now["v"]).groupBy("a").agg(F.min("c").alias("n"))
        seen = now.join(near, now["v"] == near["a"]).select("v", F.col("c").alias("old"), F.least("c", "n").alias("c"))
        hooks = seen.select(F.col("old").alias("v"), F.lit(None).cast("long").alias("old"), "c")
        hooked = seen.unionByName(hooks).groupBy("v").agg(F.min("c").alias("c"), F.min("old").alias("old"))
        up = hooked.select(F.col("v").alias("u"), F.col("c").alias("top"))
        new = hooked.join(up, hooked["c"] == up["u"]).select("v", F.least("c", "top").alias("c"), "old")
        new = materialize(sized(new, size), "groups")
        discard(now)
        if new.filter(F.col("c") != F.col("old")).isEmpty():
            discard(both)
            return new.select("v", "c")
        now = new


def _named(some: DataFrame, groups: DataFrame | None) -> DataFrame:
    """With the group ``c`` of every ``v``: itself where no link leads to it."""
    if groups is None:
        return some.withColumn("c", F.col("v"))
    return some.join(groups, "v", "left").withColumn("c", F.coalesce("c", "v"))


def _united(groups: DataFrame | None, links: DataFrame) -> DataFrame | None:
    """``groups`` with the ``links`` (a, b), which are contracted to edges between groups first."""
    if groups is None:
        return None if links.isEmpty() else components(links)
    ends = _named(links.select(F.col("a").alias("v"), "b"), groups).select(F.col("c").alias("ca"), F.col("b").alias("v"))
    edges = _named(ends, groups).filter(F.col("ca") != F.col("c")).select(F.col("ca").alias("a"), F.col("c").alias("b")).distinct()
    edges = materialize(sized(edges, links.count() * LINK_BYTES), "contracted")
    if edges.isEmpty():
        return groups
    tops = components(edges).toDF("g", "top")
    moved = groups.join(tops, F.col("c") == F.col("g"), "left").select("v", F.coalesce("top", "c").alias("c"))
    alone = tops.join(groups, F.col("g") == F.col("v"), "left_anti").select(F.col("g").alias("v"), F.col("top").alias("c"))
    new = moved.unionByName(alone)
    return materialize(sized(new, (groups.count() + edges.count()) * LINK_BYTES), "groups")


def _pairs(stars: DataFrame, may: Callable[[Column, Column], Column]) -> DataFrame:
    """Distinct (a, xa, b, xb), a < b, that ``may`` allows, of (v, x, h) with h a struct of v and x."""
    some = stars.filter((F.col("v") != F.col("h.v")) & may(F.col("x"), F.col("h.x")))
    first = F.col("v") < F.col("h.v")
    pick = lambda one, other: F.when(first, F.col(one)).otherwise(F.col(other))
    return some.select(pick("v", "h.v").alias("a"), pick("x", "h.x").alias("xa"), pick("h.v", "v").alias("b"), pick("h.x", "x").alias("xb")).distinct()


def across(keyed: DataFrame, may: Callable[[Column, Column], Column], meet: Callable[..., Column] | None = None) -> DataFrame:
    """Distinct pairs that share a key, are of different groups and that ``may`` allows, of (key, v, x, c).

    With ``meet``, ``keyed`` has a column ``y`` of what is known of the vertex
    under the key, and ``meet(xa, ya, xb, yb)`` says whether the pair can be a link by this key.

    Of every key the members of the largest group are not compared with each other.
    """
    counts = keyed.groupBy("key", "c").agg(F.count(F.lit(1)).alias("n"))
    tops = counts.groupBy("key").agg(F.max(F.struct("n", "c"))["c"].alias("top"), F.count(F.lit(1)).alias("groups")).filter(F.col("groups") > 1).select("key", "top")
    keyed = keyed if meet else keyed.withColumn("y", F.lit(0))
    keyed = materialize(keyed.join(tops, "key").select("key", "v", "x", "c", "y", "top"), "keyed")
    rest = keyed.filter(F.col("c") != F.col("top")).select("key", F.col("v").alias("a"), F.col("x").alias("xa"), F.col("y").alias("ya"), F.col("c").alias("ca"))
    every = keyed.select("key", "top", F.col("v").alias("b"), F.col("x").alias("xb"), F.col("y").alias("yb"), F.col("c").alias("cb"))
    once = (F.col("cb") == F.col("top")) | (F.col("a") < F.col("b"))
    if meet:
        once = once & meet(*map(F.col, ("xa", "ya", "xb", "yb")))
    both = rest.join(every, (rest["key"] == every["key"]) & (F.col("ca") != F.col("cb")) & once & may(F.col("xa"), F.col("xb")))
    return _pairs(both.select(F.col("a").alias("v"), F.col("xa").alias("x"), F.struct(F.col("b").alias("v"), F.col("xb").alias("x")).alias("h")), may)


def connect(
    members: DataFrame,
    verify: Callable[[DataFrame], DataFrame],
    about: DataFrame | None = None,
    may: Callable[[Column, Column], Column] = lambda xa, xb: F.lit(True),
    narrow: Callable[[DataFrame], DataFrame] | None = None,
    meet: Callable[..., Column] | None = None,
    prepare: Callable[[DataFrame], None] | None = None,
    rounds: int = ROUNDS,
) -> DataFrame:
    """(v, c) for the linked vertices of ``members`` (key, v), whose rows may be repeated.

    ``about`` (v, x) has what is known of a vertex; ``may`` says from the ``x`` of two whether they can
    be a link. ``verify`` takes distinct pairs (a, xa, b, xb), a < b, and
    returns those (a, b) that are links. ``narrow`` makes rows (key, v, x, c)
    of the open vertices (v, x, c) such that every link between groups shares
    a key, for ``meet`` with a column ``y`` (see ``across``). ``prepare`` gets the vertices that share a bucket, before the first pairs.
    """
    nothing = members.sparkSession.createDataFrame([], "v long, c long")
    hubs = members.groupBy("key").agg(F.min("v").alias("lo"), F.max("v").alias("hi")).filter(F.col("lo") < F.col("hi")).select("key", "lo")
    hubs = materialize(hubs, "hubs")
    few = hubs.count() <= BROADCAST_BUCKETS
    bare = materialize(members.join(F.broadcast(hubs) if few else hubs, "key").select("key", "v", "lo").distinct(), "shared")
    size = bare.count() * LINK_BYTES
    vertices = materialize(sized(bare.select("v").distinct(), size), "vertices")
    if prepare:
        prepare(vertices)
    if about is None:
        known = vertices.withColumn("x", F.lit(0))
    else:
        few = vertices.count() <= BROADCAST_BUCKETS
        known = materialize(sized(about.join(F.broadcast(vertices) if few else vertices, "v").dropDuplicates(["v"]), size), "known")
    hub = known.select(F.col("v").alias("lo"), F.struct("v", "x").alias("hub"))
    shared = materialize(bare.join(known, "v").join(hub, "lo").select("key", "v", "x", F.col("hub").alias("lo")), "shared")
    discard(hubs, bare)
    allowed = shared.filter((F.col("v") != F.col("lo.v")) & may(F.col("x"), F.col("lo.x")))
    first = allowed.groupBy("v").agg(F.min(F.struct("lo.v", "x", "lo")).alias("m")).select("v", "m.x", F.col("m.lo").alias("h"))
    tested = materialize(sized(_pairs(first, may), size), "pairs")
    groups = _united(None, materialize(verify(tested), "links"))
    for turn in range(1, rounds):
        m = _named(shared.select("key", "v", "x"), groups).withColumn("h", F.xxhash64(F.lit(turn), "v"))
        one = F.struct("c", "h", "v", "x")
        ends = m.groupBy("key").agg(F.min(one).alias("lo"), F.max(one).alias("hi"), F.min(F.struct("h", "v", "c", "x")).alias("any"))
        stars = F.explode(F.array(*[F.struct(F.col(f"{e}.c").alias("c"), F.col(f"{e}.v").alias("v"), F.col(f"{e}.x").alias("x")) for e in ("lo", "hi", "any")]))
        cross = m.join(ends.filter(F.col("lo.c") < F.col("hi.c")), "key").select("v", "x", "c", stars.alias("h")).filter(F.col("c") != F.col("h.c"))
        fresh = _pairs(cross.select("v", "x", F.struct("h.v", "h.x").alias("h")), may).join(tested.select("a", "b"), ["a", "b"], "left_anti").select(*tested.columns)
        fresh = materialize(sized(fresh, size), "pairs")
        if fresh.isEmpty():
            break
        tested = tested.unionByName(fresh)
        groups = _united(groups, materialize(verify(fresh), "links"))
    # a round tests the least member of two groups in every bucket: of three members all pairs
    m = _named(shared.select("key", "v", "x"), groups)
    ends = m.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count(F.lit(1)).alias("n"))
    ends = materialize(ends.filter((F.col("lo") < F.col("hi")) & (F.col("n") > (3 if rounds > 1 else 1))).select("key"), "open")
    buckets = ends.count()
    if not buckets:
        return nothing if groups is None else groups
    rest = m.join(F.broadcast(ends) if buckets <= BROADCAST_BUCKETS else ends, "key").select("key", "v", "x", "c")
    keyed = narrow(materialize(sized(rest.select("v", "x", "c").distinct(), size), "open")) if narrow else rest
    fresh = materialize(across(keyed, may, meet if narrow else None).join(tested.select("a", "b"), ["a", "b"], "left_anti").select(*tested.columns), "pairs")
    if not fresh.isEmpty():
        groups = _united(groups, materialize(verify(fresh), "links"))
    return nothing if groups is None else groups
