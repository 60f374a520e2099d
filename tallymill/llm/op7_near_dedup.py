"""Near-duplicate classes by BagMinHash.

A document is the multiset of its runs of five words (all its words, if there
are fewer). The weight of an element is how often it stands there. Over the
weights, cut at the powers of two, each element has independent Poisson
processes, one per piece of the weight axis; a piece that the weight ends in
is thinned to the part below it. Every point falls on one component of the
signature, and a component keeps its least point: two documents share it with
the probability of their weighted Jaccard similarity. Points are drawn up to a
limit at which all components are filled, so elements beyond the first few
points cost one draw each.

Equal word sequences are collapsed first. Bands of the signature give buckets,
bucket members are compared with hubs, and every candidate pair is verified on
the multisets: overlap over union of 0.8 or more. Buckets that stay open are
settled whole (see linking.py): of two multisets that are so near, the rarest
fifth of either shares an element, so those of the open vertices are joined on
these, where enough elements follow in both. Recall: a pair at exactly 0.8 shares one of 20 bands of 6 with
probability 0.998.

Edge cases: null and empty texts have no words and are copies of each other; a
class takes the id of its least document (null ids last); repeated rows are
copies; an empty table gives an empty result; extra columns are kept by
``drop_near_duplicates`` and not read otherwise.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymill.llm.batches import bounded_batches
from tallymill.llm.linking import connect, sized
from tallymill.llm.rows import placed_rows
from tallymill.llm.words import mix, normalized, shingle_hashes, word_spans
from tallymill.session import materialize

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 20, 6
#: Up to this many ids (8 bytes each) are sent to all tasks; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
_ELEMENTS = 200_000
_GOLDEN, _PIECE, _COPY = 0x9E3779B97F4A7C15, 0xD1B54A32D192ED03, 0x8CB92BA72F3D8DD7


def _times(n: int, constant: int) -> np.uint64:
    return np.uint64(n * constant & (1 << 64) - 1)


def multiset(text: str | None, k: int = SHINGLE) -> tuple[bytes, np.ndarray, np.ndarray]:
    """Digest of the words, the distinct shingles and their counts."""
    norm = normalized(text)
    spans = word_spans(norm)
    n = len(spans[0])
    hashes = shingle_hashes(norm, min(k, n), spans) if n else np.zeros(0, np.uint64)
    values, counts = np.unique(hashes, return_counts=True)
    return hashlib.blake2b(norm, digest_size=16).digest(), values, counts


def elements(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The multiset as a sorted set of 64-bit codes of (shingle, how many times before)."""
    parts, again, at = [mix(values)], np.flatnonzero(counts > 1), 1
    while len(again):
        parts.append(mix(values[again] + _times(at, _COPY)))
        at += 1
        again = again[counts[again] > at]
    return np.unique(np.concatenate(parts)).view(np.int64)


def signatures(owner: np.ndarray, values: np.ndarray, counts: np.ndarray, n: int, m: int) -> np.ndarray:
    """Least points, n x m, of n multisets given flat; a multiset without elements has infinities."""
    out = np.full((n, m), np.inf)
    weight = np.bincount(owner, counts, n)
    limit = np.zeros(n)
    limit[weight > 0] = (np.log(m) + 3) / weight[weight > 0]
    todo = weight > 0
    while todo.any():
        some = todo[owner]
        out[todo] = np.inf
        _draw(out, limit, owner[some], values[some], counts[some], m)
        todo = todo & np.isinf(out).any(1)
        limit[todo] *= 2
    return out


def _draw(out, limit, owner, values, counts, m) -> None:
    who, seeds, low, width, most = [], [], [], [], []
    piece, lo, wide = 0, 0, 1
    which = np.arange(len(values))
    while len(which):  # (0, 1], (1, 2], (2, 4], ... as far as a weight reaches
        who.append(owner[which])
        seeds.append(mix(values[which] + _times(piece, _PIECE)))
        low.append(np.full(len(which), lo, np.int64))
        width.append(np.full(len(which), wide, np.int64))
        most.append(counts[which])
        lo, piece = lo + wide, piece + 1
        wide = lo
        which = which[counts[which] > lo]
    who, seeds, low, width, most = map(np.concatenate, (who, seeds, low, width, most))
    x, draw = np.zeros(len(who)), 0
    while len(who):
        first = mix(seeds + _times(2 * draw + 1, _GOLDEN))
        second = mix(seeds + _times(2 * draw + 2, _GOLDEN))
        draw += 1
        x = x - np.log1p(-(first >> np.uint64(11)).astype(float) * 2.0**-53) / (m * width)
        on = x <= limit[who]
        who, seeds, low, width, most, x, second = (v[on] for v in (who, seeds, low, width, most, x, second))
        level = low + 1 + (((second & np.uint64(0xFFFFFFFF)) * width.astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
        below = level <= most
        place = who[below] * m + ((second[below] >> np.uint64(32)) % np.uint64(m)).astype(np.int64)
        np.minimum.at(out.reshape(-1), place, x[below])


def band_keys(points: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key per band, the band's number within it."""
    bits = np.ascontiguousarray(points).view(np.uint64).reshape(len(points), bands, rows)
    key = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(_GOLDEN)), bits.shape[:2]).copy()
    for r in range(rows):
        key = mix((key ^ bits[:, :, r]) * np.uint64(_PIECE))
    return key.view(np.int64)


SKETCH = "file long, row long, doc_id long, digest binary, bands array<long>, elems array<long>"


def sketches(rows: DataFrame, shingle: int = SHINGLE, bands: int = BANDS, per_band: int = ROWS) -> DataFrame:
    """From (file, row, doc_id, text): digest, band keys and elements of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, texts = batch.columns[:3], batch.column(3)
            at = 0
            while at < batch.num_rows:
                begin, held, digests, sets = at, 0, [], []
                while at < batch.num_rows and (held < _ELEMENTS or at == begin):
                    digest, values, counts = multiset(texts[at].as_py(), shingle)
                    digests.append(digest)
                    sets.append((values, counts))
                    held += len(values)
                    at += 1
                n = at - begin
                owner = np.repeat(np.arange(n), [len(v) for v, _ in sets])
                points = signatures(owner, np.concatenate([v for v, _ in sets]), np.concatenate([c for _, c in sets]), n, bands * per_band)
                filled = np.array([len(v) > 0 for v, _ in sets])
                codes = [elements(v, c) for v, c in sets]
                found = band_keys(points[filled], bands, per_band)
                yield pa.RecordBatch.from_arrays(
                    [
                        *[c.slice(begin, n) for c in names],
                        pa.array(digests, pa.binary()),
                        _lists(filled * bands, found.reshape(-1), pa.int64()),
                        _lists(np.array([len(c) for c in codes]), np.concatenate(codes), pa.int64()),
                    ],
                    ["file", "row", "doc_id", "digest", "bands", "elems"],
                )

    return rows.select("file", "row", "doc_id", "text").mapInArrow(run, SKETCH)


def _lists(lengths: np.ndarray, values: np.ndarray, kind) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)), pa.array(values, kind))


def _rarest(profiles: DataFrame, similarity: float) -> DataFrame:
    """(key, v, x, c, y) of those elements of (v, x, c, elems) of which two sets so near share one.

    Elements stand by how many of the sets have them, ``y`` is an element's
    place; a set of n has n - ceil(similarity * n) + 1 of the rarest to show.
    """
    spread = materialize(profiles.select("v", "x", "c", F.explode("elems").alias("key")), "elements")
    often = spread.groupBy("key").agg(F.count(F.lit(1)).alias("often"), F.min("c").alias("lo"), F.max("c").alias("hi"))
    order = Window.partitionBy("v").orderBy("often", "key")
    shown = F.col("x") - F.ceil(F.col("x") * F.lit(similarity) - F.lit(1e-9)) + 1
    ranked = spread.join(often, "key").withColumn("at", F.row_number().over(order))
    return ranked.filter((F.col("at") <= shown) & (F.col("lo") < F.col("hi"))).select("key", "v", "x", "c", F.col("at").alias("y"))


def near_duplicate_classes(rows: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE) -> DataFrame:
    """From stable rows (file, row, doc_id, text): file, row, doc_id, class_id, class_size, kept, one row each.

    ``kept`` holds for exactly one row of a class, its head.
    """
    with bounded_batches(rows.sparkSession):
        made = materialize(sketches(rows, shingle).withColumn("rid", F.monotonically_increasing_id()), "sketches")
    rank = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "rid")
    reps = made.groupBy("digest").agg(F.min(rank).alias("head"), F.count(F.lit(1)).alias("copies"), F.first("bands").alias("bands"), F.first(F.size("elems")).alias("x"))
    reps = materialize(reps, "texts")
    members = reps.select(F.explode("bands").alias("key"), F.col("head.rid").alias("v"))
    close = lambda p, q: F.least(p, q) >= F.lit(similarity) * F.greatest(p, q)

    def meet(xa: Column, ya: Column, xb: Column, yb: Column) -> Column:
        """The first element that two sets share has enough elements behind it in both; no other one has to."""
        return F.least(xa - ya, xb - yb) + 1 >= F.lit(similarity / (1 + similarity)) * (xa + xb) - F.lit(1e-9)

    def profiles(vertices: DataFrame, few: bool) -> DataFrame:
        return made.select(F.col("rid").alias("v"), "elems").join(F.broadcast(vertices) if few else vertices, "v")

    def narrow(vertices: DataFrame) -> DataFrame:
        return _rarest(profiles(vertices, vertices.count() <= BROADCAST_IDS), similarity)

    def verify(pairs: DataFrame) -> DataFrame:
        size = (pairs.agg(F.sum(F.col("xa") + F.col("xb"))).first()[0] or 0) * 8
        ends = materialize(pairs.select(F.col("a").alias("v")).union(pairs.select(F.col("b").alias("v"))).distinct(), "ends")
        some = profiles(ends, ends.count() <= BROADCAST_IDS)
        both = pairs.join(some.toDF("a", "ea"), "a").join(some.toDF("b", "eb"), "b")
        common = F.size(F.array_intersect("ea", "eb"))
        near = common.cast("double") >= F.lit(similarity) * (F.col("xa") + F.col("xb") - common)
        return sized(both.filter(near).select("a", "b"), size)

    groups = connect(members, verify, reps.select(F.col("head.rid").alias("v"), "x"), close, narrow, meet)
    named = reps.join(groups, F.col("head.rid") == F.col("v"), "left").select("digest", "head", "copies", F.coalesce("c", "head.rid").alias("c"))
    heads = named.groupBy("c").agg(F.min("head").alias("top"), F.sum("copies").alias("class_size"))
    classes = named.select("digest", "c").join(heads, "c").select("digest", "top", "class_size")
    done = made.select("file", "row", "rid", "doc_id", "digest").join(classes, "digest")
    return done.select("file", "row", "doc_id", F.col("top.doc_id").alias("class_id"), "class_size", (F.col("rid") == F.col("top.rid")).alias("kept"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, class_id, class_size, kept for every row of ``docs``."""
    zero = F.lit(0).cast("long")
    rows = docs.select(zero.alias("file"), zero.alias("row"), F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return near_duplicate_classes(rows).drop("file", "row")


def drop_near_duplicates(docs: DataFrame, from_files: bool = False) -> DataFrame:
    """One row of every class, with its columns as they were. ``from_files``: see rows.py."""
    rows, file, row = placed_rows(docs, from_files)
    judged = near_duplicate_classes(rows.select(F.col(file).alias("file"), F.col(row).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text"))
    dropped = materialize(judged.filter(~F.col("kept")).select(F.col("file").alias(file), F.col("row").alias(row)), "dropped")
    few = dropped.count() <= BROADCAST_IDS
    return rows.join(F.broadcast(dropped) if few else dropped, [file, row], "left_anti").select(*docs.columns)
