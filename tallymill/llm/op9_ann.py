"""Nearest neighbours by stable projections and a kd-tree.

Unit vectors are projected to ``DIMENSIONS`` Gaussian coordinates. A projected
squared distance over the true one follows a chi-square law with as many
degrees of freedom, so neighbours are taken from a kd-tree over the projections
in the order of their projected distance, verified by their exact cosine, and
the search stops once the chi-square test says that a nearer vector would have
shown up before with probability ``CONFIDENCE``.

Rows are dealt by one kd-tree over the projections of a sample, whose leaves are
cells of space; a cell of many rows is split by hash into blocks of bounded size,
each with a kd-tree of its own for the order within. A query searches its own
cell first. The score of its last neighbour there says how far away a cell may
be for the chi-square test to be open still, and a walk down the tree finds
those cells; the query goes to no other. Queries travel in blocks of bounded
size, and a cell's rows are copied once per block of queries open for it, so
what is shuffled grows with the rows where neighbours are near, and with rows
times queries only where the test rules nothing out. Equal vectors are one
point of a block.

Edge cases: vectors that are null, empty, zero or hold null or non-finite
components take no part; vectors of another length are no candidates; a query
with fewer candidates gets all of them; ties go to the smaller vec_id; of a
repeated row each copy is a candidate of the other; an empty table gives an
empty result; extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from tallymill.session import materialize

DIMENSIONS, CONFIDENCE, SEED = 8, 0.98, 5
BLOCK_ROWS, BLOCK_QUERIES, LEAF = 8192, 2048, 32
#: The projections that the cells' tree is fitted to (8 doubles each, on the driver), and its leaves, at most.
SAMPLE, MOST_CELLS = 65_536, 2048
#: Added to squared radii: equal vectors are not parted by how their projections were rounded.
_SLACK = 1e-6
FOUND = "query_row long, query_id long, vec_id long, vec_row long, score double"


def chi_square_point(p: float, degrees: int) -> float:
    """Where the chi-square distribution of an even number of degrees reaches p."""

    def below(x: float) -> float:
        term = total = 1.0
        for j in range(1, degrees // 2):
            term *= x / 2 / j
            total += term
        return 1 - np.exp(-x / 2) * total

    lo, hi = 0.0, 1000.0
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if below(mid) < p else (lo, mid)
    return hi


class Tree:
    """A kd-tree over points: leaves of bounded size with their boxes."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.order: list[np.ndarray] = []
        todo = [np.arange(len(points))]
        while todo:
            part = todo.pop()
            if len(part) <= leaf:
                self.order.append(part)
                continue
            axis = int(np.argmax(np.ptp(points[part], axis=0)))
            half = len(part) // 2
            split = np.argpartition(points[part, axis], half)
            todo += [part[split[:half]], part[split[half:]]]
        self.low = np.array([points[p].min(0) for p in self.order])
        self.high = np.array([points[p].max(0) for p in self.order])

    def by_distance(self, point: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leaves by the squared distance of their boxes, and those distances."""
        gap = np.maximum(np.maximum(self.low - point, point - self.high), 0)
        near = (gap * gap).sum(1)
        order = np.argsort(near, kind="stable")
        return order, near[order]


class Cells:
    """A kd-tree whose leaves part all of space: (axis, edge, left, right) a node, or (-1, 0, cell, cell) for a leaf."""

    def __init__(self, points: np.ndarray, most: int):
        self.nodes: list[tuple[int, float, int, int]] = []
        self.count = 0
        self._grow(points, most)

    def _grow(self, points: np.ndarray, most: int) -> int:
        at = len(self.nodes)
        self.nodes.append((-1, 0.0, self.count, self.count))
        if most > 1 and len(points) and np.ptp(points, axis=0).max() > 0:
            axis = int(np.argmax(np.ptp(points, axis=0)))
            values = np.sort(points[:, axis])
            edge = values[len(values) // 2]
            if edge == values[0]:  # less than it is nothing: cut behind the equal ones
                edge = values[np.searchsorted(values, edge, "right")]
            below = points[:, axis] < edge
            left = self._grow(points[below], most // 2)
            right = self._grow(points[~below], most - most // 2)
            self.nodes[at] = (axis, float(edge), left, right)
        else:
            self.count += 1
        return at

    def of(self, points: np.ndarray) -> np.ndarray:
        """The cell of every point."""
        return self.within(points, np.full(len(points), -1.0))[1]

    def within(self, points: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (point, cell), sorted, of cells at most so far (squared) from the point; a negative radius: of its own."""
        who, where = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        todo = [(0, np.arange(len(points)), np.zeros(points.shape))]
        while todo:
            node, some, gap = todo.pop()
            axis, edge, left, right = self.nodes[node]
            if axis < 0:
                who.append(some)
                where.append(np.full(len(some), left))
                continue
            x = points[some, axis]
            for child, own, far in ((left, x < edge, x - edge), (right, x >= edge, edge - x)):
                there = gap.copy()
                there[:, axis] = np.maximum(there[:, axis], np.maximum(far, 0))
                on = np.where(radius[some] < 0, own, (there * there).sum(1) <= radius[some])
                if on.any():
                    todo.append((child, some[on], there[on]))
        who, where = np.concatenate(who), np.concatenate(where)
        order = np.lexsort((where, who))
        return who[order], where[order]


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Each vector times the power of two that brings its largest component near 1, so that squares neither vanish nor overflow; cosines stay exactly as they are."""
    _, power = np.frexp(np.abs(vectors).max(-1, keepdims=True))
    return np.ldexp(vectors, -power)


def project(vectors: np.ndarray, dims: int, seed: int) -> np.ndarray:
    """Gaussian coordinates of the unit vectors."""
    vectors = scaled(vectors)
    norms = np.sqrt((vectors * vectors).sum(1))
    return (vectors / norms[:, None]) @ np.random.default_rng(seed).standard_normal((vectors.shape[1], dims))


def _projected(vectors: pd.Series, dims: int, seed: int) -> np.ndarray:
    """``project`` for vectors of several lengths."""
    out, lengths = np.zeros((len(vectors), dims)), vectors.map(len).to_numpy()
    for n in np.unique(lengths):
        which = np.flatnonzero(lengths == n)
        out[which] = project(np.array(vectors.iloc[which].tolist(), float), dims, seed)
    return out


def search_block(vectors: np.ndarray, ids: np.ndarray, rows: np.ndarray, queries: np.ndarray, query_rows: np.ndarray, k: int, dims: int, confidence: float, seed: int, least: np.ndarray | None = None):
    """For each query the arrays (vec_id, row, score) of its best k in the block, and how many points were verified.

    ``least`` has the scores below which a query needs no more neighbours.
    """
    flat = np.ascontiguousarray(vectors).view(np.dtype((np.void, vectors.shape[1] * vectors.itemsize))).ravel()
    _, first, inverse = np.unique(flat, return_index=True, return_inverse=True)
    by = np.lexsort((rows, ids, inverse))  # of equal vectors the k + 1 with the least ids: one of them may be the query
    begins = np.searchsorted(inverse[by], np.arange(len(first)))
    copies = [by[b : min(e, b + k + 1)] for b, e in zip(begins, np.append(begins[1:], len(by)), strict=True)]
    points = scaled(vectors[first].astype(float))
    norms = np.sqrt((points * points).sum(1))
    spread = np.random.default_rng(seed).standard_normal((points.shape[1], dims))
    tree = Tree((points / norms[:, None]) @ spread)
    stop = chi_square_point(confidence, dims)
    found, verified = [], 0
    least = np.full(len(queries), -1.0) if least is None else least
    for q, own, low in zip(scaled(queries.astype(float)), query_rows, least, strict=True):
        norm = np.sqrt((q * q).sum())
        order, near = tree.by_distance((q / norm) @ spread)
        best_i, best_s, at, batch = np.zeros(0, np.int64), np.zeros(0), 0, 2
        while at < len(order):
            last = max(low, best_s[-1]) if len(best_s) >= k + 1 else low
            if last > -1 and near[at] > stop * max(0.0, 2 - 2 * last) + _SLACK:
                break
            some = np.concatenate([tree.order[j] for j in order[at : at + batch]])
            at, batch = at + batch, min(16, batch * 2)
            verified += len(some)
            score = (points[some] * q).sum(1) / (norms[some] * norm)
            best_i, best_s = np.concatenate((best_i, some)), np.concatenate((best_s, score))
            if len(best_s) > k + 1:  # points with as high a score as the last one stay
                keep = best_s >= np.partition(best_s, len(best_s) - k - 1)[len(best_s) - k - 1]
                best_i, best_s = best_i[keep], best_s[keep]
            high = np.argsort(-best_s, kind="stable")
            best_i, best_s = best_i[high], best_s[high]
        which = np.concatenate([copies[i] for i in best_i]) if len(best_i) else np.zeros(0, np.int64)
        score = np.repeat(best_s, [len(copies[i]) for i in best_i])
        other = rows[which] != own
        which, score = which[other], score[other]
        top = np.lexsort((rows[which], ids[which], -score))[:k]
        found.append((ids[which[top]], rows[which[top]], score[top]))
    return found, verified


def nearest(table: DataFrame, k: int = 5, every: int = 50, dims: int = DIMENSIONS, confidence: float = CONFIDENCE, seed: int = SEED, block_rows: int = BLOCK_ROWS, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every row whose id is divisible by ``every``."""
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    usable = v.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(v, lambda x: x != 0) & F.col(key).isNotNull()
    base = table.filter(usable).select(F.monotonically_increasing_id().alias("row"), F.col(key).cast("long").alias("id"), v.cast("array<double>").alias("v"), F.size(v).alias("n"))
    base = materialize(base, "vectors")
    asking = F.pmod("id", F.lit(every)) == 0
    count = base.count()
    tree = None
    if count > block_rows:

        @F.pandas_udf("array<double>")
        def projection(v: pd.Series) -> pd.Series:
            return pd.Series(list(_projected(v, dims, seed)))

        @F.pandas_udf("int")
        def own_cell(v: pd.Series) -> pd.Series:
            return pd.Series(tree.of(_projected(v, dims, seed)), dtype="int32")

        some = base.filter(F.pmod(F.xxhash64("row", F.lit(seed)), F.lit(-(-count // SAMPLE))) == 0).select(projection("v").alias("p")).toPandas()["p"]
        tree = Cells(np.array(some.tolist(), float).reshape(-1, dims), min(MOST_CELLS, -(-count // block_rows)))
        base = materialize(base.withColumn("cell", own_cell("v")), "cells")
    else:
        base = base.withColumn("cell", F.lit(0))
    subs = base.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(block_rows)).cast("int").alias("subs"))
    stop = chi_square_point(confidence, dims)

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        parts = []
        if len(left) and len(right):
            points, queries = np.array(left["v"].tolist(), float), np.array(right["q_v"].tolist(), float)
            found, _ = search_block(points, left["id"].to_numpy(), left["row"].to_numpy(), queries, right["q_row"].to_numpy(), k, dims, confidence, seed, right["q_least"].to_numpy())
            for q, i, (ids, rows, scores) in zip(right["q_row"], right["q_id"], found, strict=True):
                parts.append(pd.DataFrame({"query_row": q, "query_id": i, "vec_id": ids, "vec_row": rows, "score": scores}))
        kinds = {"query_row": "int64", "query_id": "int64", "vec_id": "int64", "vec_row": "int64", "score": "float64"}
        return pd.concat(parts).astype(kinds) if parts else pd.DataFrame({c: pd.Series(dtype=t) for c, t in kinds.items()})

    def searched(asks: DataFrame) -> DataFrame:
        """What (row, id, v, n, cell, least) find; written, for a caller's selection of columns must not reach the grouped inputs."""
        wanted = asks.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK_QUERIES)).cast("int").alias("turns"))
        plan = F.broadcast(subs.join(wanted, "cell"))  # a row a cell: MOST_CELLS
        each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        dealt = lambda n: F.pmod(F.xxhash64("row"), F.col(n)).cast("int")
        held = base.join(plan, "cell").select("row", "id", "v", "n", "cell", dealt("subs").alias("sub"), each("turns").alias("turn"))
        come = asks.join(plan, "cell").select("row", "id", "v", "n", "least", "cell", dealt("turns").alias("turn"), each("subs").alias("sub"))
        come = come.select(*[F.col(c).alias(f"q_{c}") for c in come.columns])
        left, right = held.groupBy("cell", "sub", "turn", "n"), come.groupBy("q_cell", "q_sub", "q_turn", "q_n")
        return materialize(left.cogroup(right).applyInPandas(search, FOUND), "found")

    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "vec_row")
    ranked = lambda found: found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    asked = base.filter(asking)
    found = searched(asked.withColumn("least", F.lit(-1.0)))
    if tree is not None:
        last = ranked(found).groupBy("query_row").agg(F.min("score").alias("last"), F.count(F.lit(1)).alias("have"))
        known = asked.join(last, F.col("row") == F.col("query_row"), "left")
        known = known.withColumn("least", F.when(F.col("have") >= k, F.col("last")).otherwise(F.lit(-1.0)))

        @F.pandas_udf(ArrayType(IntegerType()))
        def still_open(v: pd.Series, least: pd.Series) -> pd.Series:
            radius = np.where(least > -1, stop * np.maximum(0, 2 - 2 * least) + _SLACK, np.inf)
            who, where = tree.within(_projected(v, dims, seed), radius)
            return pd.Series(np.split(where.astype(np.int32), np.searchsorted(who, np.arange(1, len(v)))))

        cells = known.select("row", "id", "v", "n", "least", F.col("cell").alias("own"), F.explode(still_open("v", "least")).alias("cell"))
        found = found.unionByName(searched(cells.filter(F.col("cell") != F.col("own")).drop("own")))
    return ranked(found).select("query_id", "rank", "vec_id", "score")
