"""The trie of conversation prefixes, from sorted turn arrays.

Turns become digests salted with their place, and a conversation the array of
them. The arrays are sorted over all tasks by ranges; neighbours share a prefix
as long as their LCP, so a sweep with a stack opens a node where an array goes
on beyond it and closes nodes down to it at the next one. A node whose interval
touches the edge of a range is given out open, with its part of the counts, and
the parts of one node are stitched by its key afterwards: no more than two paths
a range. A node's key is the sum of the digests up to it (128 bits), so equal
prefixes have equal keys wherever they are met.

Conversations of any length: arrays are cut into segments of ``SEGMENT`` turns,
each with the key of all before it, and sorted in one go. The node at the end
of a segment is the root of the segments that go on from it; their sums are
carried up by pointer jumping, in as many rounds as the longest conversation's
number of segments has binary digits. No row holds more than one segment, and
copies of one conversation, however many, spread over ranges by conversation
id. Only the hash of a node's conversation ids, which is sequential by nature,
is taken in one task a node, as a stream.

Edge cases: rows without conv_id belong to no conversation; a null role or text
is empty; a null turn comes first, turns of one number stand by the digest of
role and text, so repeated rows count each; a conversation without turns of its
own is one that no row names, but one rebuilt without turns is a member of the
root alone; without conversations there is no root; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymill.llm.ranking import gapless_rank
from tallymill.session import discard, materialize

SEGMENT = 64
_HEADS = 9  # shared turns are fewer
_KEY = 16
_ROOT = bytes(_KEY)
_MARK = b"/"
_CLOSED, _OPEN, _END, _LINK = range(4)
_SWEPT = "kind int, key binary, parent binary, depth long, conv_id long, n long, children long, leaves long, saved long, size long, more boolean, path array<binary>"


def rebuilt_turns(conversations: DataFrame, group: int = 5) -> tuple[DataFrame, DataFrame]:
    """(c, pos, length, digest, size) of the rebuilt conversations, and (c, length) of all of them."""
    role, text = (F.coalesce(F.col(x), F.lit("")) for x in ("role", "text"))
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    turns = conversations.filter(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("c"), "turn", digest.alias("digest"), F.octet_length(text).cast("long").alias("size"))
    ranked = materialize(gapless_rank(turns, "c", ["turn", "digest"], "at").select("c", "at", "digest", "size"), "turns")
    heads = ranked.filter((F.col("c") % group == 0) & (F.col("at") < _HEADS - 1)).select(F.col("c").alias("base"), F.col("at").alias("pos"), "digest", "size")
    shared = F.crc32(F.col("c").cast("string").cast("binary")) % _HEADS
    convs = ranked.groupBy("c").agg(F.count(F.lit(1)).alias("own")).withColumn("h", shared).withColumn("base", F.col("c") - F.col("c") % group)
    convs = convs.join(heads.groupBy("base").agg(F.count(F.lit(1)).alias("there")), "base", "left")
    taken = F.least("h", F.coalesce("there", F.lit(0)))
    convs = convs.withColumn("taken", taken).withColumn("length", F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0)))
    convs = materialize(convs.select("c", "base", "h", "taken", "length"), "conversations")
    own = ranked.join(convs, "c").filter(F.col("at") >= F.col("h")).withColumn("pos", F.col("at") - F.col("h") + F.col("taken"))
    borrowed = convs.join(heads, "base").filter(F.col("pos") < F.col("h"))
    columns = ["c", "pos", "length", "digest", "size"]
    return own.select(columns).unionByName(borrowed.select(columns)), convs.select("c", "length")


def segments(turns: DataFrame, convs: DataFrame, segment: int) -> DataFrame:
    """seg, chain (key of all turns before), path (16 bytes a turn), sizes, c, more: one row a segment of a conversation."""
    salted = F.substring(F.sha2(F.concat(F.col("pos").cast("string"), F.lit(":"), F.col("digest")).cast("binary"), 256), 1, 2 * _KEY)
    t = turns.select("c", "length", F.floor(F.col("pos") / segment).alias("seg"), F.struct("pos", salted.alias("t"), "size").alias("turn"))
    rows = t.groupBy("c", "length", "seg").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    more = F.col("length") > (F.col("seg") + 1) * segment
    hexed = F.array_join(F.transform("turns", lambda x: x["t"]), "")
    rows = rows.select("c", "seg", more.alias("more"), hexed.alias("hexed"), F.transform("turns", lambda x: x["size"]).alias("sizes"))
    rows = materialize(rows, "segments")
    long = rows.filter((F.col("seg") > 0) | F.col("more"))
    before = Window.partitionBy("c").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)

    def limb(i: int) -> Column:
        """The sum, modulo 2^32, of the i-th 32 bits of all turns of the segments before."""
        of = lambda j: F.conv(F.col("hexed").substr(j * (2 * _KEY) + (8 * i + 1), F.lit(8)), 16, 10).cast("long")
        own = F.aggregate(F.sequence(F.lit(0), F.size("sizes") - 1), F.lit(0).cast("long"), lambda s, j: (s + of(j)) % (1 << 32))
        return F.lpad(F.hex(F.coalesce(F.sum(own).over(before), F.lit(0)) % (1 << 32)), 8, "0")

    none = convs.filter("length = 0").select("c", F.lit(0).cast("long").alias("seg"), F.lit(False).alias("more"), F.lit("").alias("hexed"), F.array().cast("array<long>").alias("sizes"))
    short = rows.filter((F.col("seg") == 0) & ~F.col("more")).unionByName(none).withColumn("chain", F.lit(_ROOT))
    every = short.unionByName(long.withColumn("chain", F.unhex(F.concat(*map(limb, range(_KEY // 4))))))
    return every.select("seg", "chain", F.unhex("hexed").alias("path"), "sizes", "c", "more")


class _Node:
    __slots__ = ("children", "conv", "depth", "key", "leaves", "local", "more", "n", "open", "saved", "size")

    def __init__(self, key: bytes, depth: int, local: int, size: int, left: bool):
        self.key, self.depth, self.local, self.size, self.open = key, depth, local, size, left
        self.conv, self.more = None, False
        self.n = self.children = self.leaves = self.saved = 0


class Sweep:
    """The stack over the sorted segments of one range."""

    def __init__(self, segment: int):
        self.segment = segment
        self.stack: list[_Node] = []
        self.last: tuple = (None, None, b"")
        self.out: list[tuple] = []
        self.begun = False

    def _close(self) -> None:
        x = self.stack.pop()
        up = self.stack[-1] if self.stack else None
        path = [s.key for s in self.stack] + [x.key] if x.open or x.more and x.local else None
        if not x.open:
            x.leaves += not x.children and not x.more
            x.saved += (x.n - 1) * x.size
        self.out.append((_OPEN if x.open else _CLOSED, x.key, up and up.key, x.depth, x.conv, x.n, x.children, x.leaves, x.saved, x.size, x.more, path))
        if up:
            up.n += x.n
            up.conv = x.conv if up.conv is None else min(up.conv, x.conv)
            if not x.open:  # what is open is added when it is whole
                up.children += 1
                up.leaves += x.leaves
                up.saved += x.saved

    def add(self, seg: int, chain: bytes, path: bytes, keys: bytes, sizes: list[int], conv: int, more: bool) -> None:
        """One segment; ``keys`` holds the key of every node on its path."""
        lcp = 0
        if self.last[:2] == (seg, chain):
            most = min(len(path), len(self.last[2])) // _KEY
            while lcp < most and path[lcp * _KEY : lcp * _KEY + _KEY] == self.last[2][lcp * _KEY : lcp * _KEY + _KEY]:
                lcp += 1
        else:
            while self.stack:
                self._close()
            # a later segment's root stands for a node of the segment before, whose key without the mark it has
            root = _Node(chain + _MARK if seg else chain, seg * self.segment, 0, 0, not self.begun)
            root.more = seg > 0
            self.stack.append(root)
        while len(self.stack) > lcp + 1:
            self._close()
        for j in range(lcp, len(sizes)):
            self.stack.append(_Node(keys[j * _KEY : j * _KEY + _KEY], seg * self.segment + j + 1, j + 1, sizes[j], not self.begun))
        top = self.stack[-1]
        top.n += 1
        top.conv = conv if top.conv is None else min(top.conv, conv)
        if more:
            top.more = True
        else:
            self.out.append((_END, top.key, None, top.depth, conv, *[None] * 7))
        self.begun, self.last = True, (seg, chain, path)

    def end(self) -> None:
        for x in self.stack:
            x.open = True
        while self.stack:
            self._close()


def _path_keys(chains: list[bytes], paths: list[bytes]) -> list[bytes]:
    """For every path the keys of its nodes: the chain's limbs plus the running sums of the turns' limbs."""
    counts = np.array([len(p) // _KEY for p in paths])
    turns = np.frombuffer(b"".join(paths), ">u4").reshape(-1, 4).astype(np.uint32)
    sums = np.concatenate((np.zeros((1, 4), np.uint32), np.cumsum(turns, axis=0, dtype=np.uint32)))
    starts = np.concatenate(([0], np.cumsum(counts)))
    base = np.frombuffer(b"".join(chains), ">u4").reshape(-1, 4).astype(np.uint32) - sums[starts[:-1]]
    keys = (sums[1:] + np.repeat(base, counts, axis=0)).astype(">u4").tobytes()
    return [keys[_KEY * a : _KEY * b] for a, b in zip(starts[:-1].tolist(), starts[1:].tolist())]


def sweep(rows: DataFrame, segment: int) -> DataFrame:
    """Closed nodes, open parts of nodes, ends of conversations."""
    order = ["seg", "chain", "path", "c"]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = [x.split()[0] for x in _SWEPT.split(", ")]
    types = [pa.int32(), pa.binary(), pa.binary(), *[pa.int64()] * 7, pa.bool_(), pa.list_(pa.binary())]

    def made(some: list[tuple]) -> pa.RecordBatch:
        columns = zip(*some) if some else [[] for _ in names]
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack = Sweep(segment)
        for batch in batches:
            if not batch.num_rows:
                continue
            segs, chains, paths, sizes, convs, mores = (c.to_pylist() for c in batch.columns)
            for row in zip(segs, chains, paths, _path_keys(chains, paths), sizes, convs, mores):
                stack.add(*row)
            yield made(stack.out)
            stack.out = []
        stack.end()
        yield made(stack.out)

    return rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(run, _SWEPT)


def stitched(parts: DataFrame) -> DataFrame:
    """Open nodes made whole: parts of one key added, then what lies below added along their paths."""
    same = ["parent", "depth", "size", "path"]
    whole = parts.groupBy("key").agg(*[F.first(c).alias(c) for c in same], F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in ("n", "children", "leaves", "saved")], F.max("more").alias("more"))
    whole = materialize(whole, "open")
    below = whole.filter(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("key")).agg(F.count(F.lit(1)).alias("__below"))
    whole = whole.join(below, "key", "left").withColumn("children", F.col("children") + F.coalesce("__below", F.lit(0)))
    leaf = ((F.col("children") == 0) & ~F.col("more")).cast("long")
    part = whole.select(F.explode("path").alias("key"), (F.col("leaves") + leaf).alias("leaves"), (F.col("saved") + (F.col("n") - 1) * F.col("size")).alias("saved"))
    sums = part.groupBy("key").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    return whole.drop("leaves", "saved", "__below").join(sums, "key")


def carried(roots: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What segments add to nodes before them: (key, children) of the nodes they begin at and (key, leaves, saved) of these and all above.

    ``roots``: key, children, leaves, saved of segment roots; ``links``: key and path of the nodes they are, in the segment before.
    """
    head = F.element_at("path", 1)
    up = F.when(head != F.lit(_ROOT), F.substring(head, 1, _KEY)).alias("up")
    sums = materialize(roots.join(links.select("key", up), "key").select("key", "up", "leaves", "saved"), "carried")
    while not sums.filter(F.col("up").isNotNull()).isEmpty():  # sums reach twice as far every round
        below = sums.filter(F.col("up").isNotNull()).groupBy(F.col("up").alias("key")).agg(F.sum("leaves").alias("__leaves"), F.sum("saved").alias("__saved"))
        beyond = sums.select(F.col("key").alias("up"), F.col("up").alias("__next"))
        more = sums.join(below, "key", "left").join(beyond, "up", "left")
        add = lambda c: (F.col(c) + F.coalesce(f"__{c}", F.lit(0))).alias(c)
        old, sums = sums, materialize(more.select("key", F.col("__next").alias("up"), add("leaves"), add("saved")), "carried")
        discard(old)
    # the node of a later segment's root lies on the paths of the segment before
    nodes = F.filter("path", lambda x: F.octet_length(x) == _KEY)
    spread = links.join(sums, "key").select(F.explode(nodes).alias("key"), "leaves", "saved")
    return roots.select("key", F.col("children").alias("__children")), spread.groupBy("key").agg(F.sum("leaves").alias("__leaves"), F.sum("saved").alias("__saved"))


def hashed_ends(ends: DataFrame) -> DataFrame:
    """key, ends_sha256: SHA-256 of the ids in numeric order, taken as a stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, None
        for batch in batches:
            keys, made = [], []
            for key, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if key != now:
                    if digest:
                        keys.append(now)
                        made.append(digest.hexdigest())
                    now, digest = key, hashlib.sha256(b"%d" % conv)
                else:
                    digest.update(b",%d" % conv)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(made, pa.string())], ["key", "ends_sha256"])
        if digest:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([digest.hexdigest()])], ["key", "ends_sha256"])

    return ends.repartition("key").sortWithinPartitions("key", "conv_id").mapInArrow(run, "key binary, ends_sha256 string")


def prefix_trie(conversations: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 for every node."""
    turns, convs = rebuilt_turns(conversations)
    swept = materialize(sweep(segments(turns, convs, segment), segment), "swept")
    columns = ["key", "parent", "depth", "conv_id", "n", "children", "leaves", "saved"]
    closed = swept.filter(F.col("kind") == _CLOSED)
    joined = materialize(stitched(swept.filter(F.col("kind") == _OPEN)), "stitched")
    nodes = closed.select(*columns, "path", "more").unionByName(joined.select(*columns, "path", "more"))
    later_root = F.octet_length("key") > _KEY
    roots = nodes.filter(later_root).withColumn("key", F.substring("key", 1, _KEY))
    own = nodes.filter(~later_root)
    links = own.filter(F.col("more")).select("key", "path")
    roots, links = materialize(roots.select("key", "children", "leaves", "saved"), "roots"), materialize(links, "links")
    own = own.select(*columns[:1], F.substring("parent", 1, _KEY).alias("parent"), *columns[2:])
    if not roots.isEmpty():
        children, sums = carried(roots, links)
        own = own.join(children, "key", "left").join(sums, "key", "left")
        for c in ("children", "leaves", "saved"):
            own = own.withColumn(c, F.col(c) + F.coalesce(f"__{c}", F.lit(0)))
        own = own.select(columns)
    own = materialize(own.join(hashed_ends(swept.filter(F.col("kind") == _END).select("key", "conv_id")), "key", "left"), "nodes")
    up = own.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    top = F.broadcast(up.filter(F.col("parent") == F.lit(_ROOT)))  # one row; most conversations may begin anew from it
    low = own.filter(F.col("depth") < 2).join(top, "parent", "left").unionByName(own.filter(F.col("depth") > 1).join(up, "parent"))
    none = hashlib.sha256().hexdigest()
    return low.select(
        "conv_id", "depth", "parent_conv_id", F.col("n").alias("n_convs"), F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256")
    )
