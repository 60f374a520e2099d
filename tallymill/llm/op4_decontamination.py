"""Benchmark decontamination by a prefix-filtered containment join.

An item gives windows of 13 consecutive words (a shorter item is one window).
A window is contained in a document only if all its shingles are, so the
rarest one alone is its necessary prefix token. Shingles are ordered by their
document frequency over all documents, counted in one pass in a table of fixed
size: shingles that share a place share its count, which may choose another
token but changes no result. Documents' shingles are joined with the
prefix tokens; a candidate must fit the length and position bounds (the window
starts and ends within the document); the words of its window are then
compared byte by byte.

The benchmark is taken in blocks of a fixed size, each sent to all tasks, so
what is broadcast is bounded however large the benchmark is; documents are
never shuffled and no word or passage is hot. With several blocks, each one's
finds are written by the rows' places, and united at the end.

Edge cases: null or empty texts have no words and are not contaminated; null or
empty items have no windows; a null item_id counts as "null" in the digest, equal
item_ids count once; repeated rows are judged one by one; an empty benchmark
contaminates nothing; an empty table gives an empty result; extra columns are
kept by ``decontaminate`` and not read otherwise.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymill.llm.batches import bounded_batches
from tallymill.llm.rows import free_name, placed_rows
from tallymill.llm.words import normalized, shingle_hashes, word_spans
from tallymill.session import materialize

WINDOW, SHINGLE = 13, 3
#: Bytes of item text in one block; its index takes some forty times as much in a task.
BLOCK_BYTES = 4_000_000
#: Places of the table of document frequencies (a bit each where they are sent to tasks, 8 bytes each on the driver), by their number of bits.
TABLE_BITS = 22
#: Up to this many rows with finds are sent to all tasks (by their places and spans, some 100 bytes each); more are joined by a shuffle.
BROADCAST_ROWS = 100_000
RESULT = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
MARKS = "n_words long, spans array<long>, items array<string>"


class Windows:
    """The windows of some items and, once frequencies are known, their prefix tokens."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW, shingle: int = SHINGLE):
        self.names: list[str] = []
        self.texts: list[bytes] = []
        self.sizes: list[int] = []
        self.owners: list[set[int]] = []
        self.tokens: list[np.ndarray] = []
        seen: dict[bytes, int] = {}
        known: dict[str, int] = {}
        for name, norm in items:
            if not norm:
                continue
            owner = known.setdefault(name, len(known))
            starts, ends = word_spans(norm)
            size = min(window, len(starts))
            k = min(shingle, size)
            hashes = shingle_hashes(norm, k, (starts, ends))
            for i in range(len(starts) - size + 1):
                text = norm[starts[i] : ends[i + size - 1]]
                if text not in seen:
                    seen[text] = len(self.texts)
                    self.texts.append(text)
                    self.sizes.append(size)
                    self.owners.append(set())
                    self.tokens.append(hashes[i : i + size - k + 1])
                self.owners[seen[text]].add(owner)
        self.names = list(known)
        self.shingle = shingle
        self.prefix: dict[int, tuple[np.ndarray, dict[int, list[tuple[int, int]]]]] = {}

    @classmethod
    def of(cls, state: dict) -> Windows:
        """From what ``vars`` gave: plain values can be broadcast, a class of this package cannot."""
        made = cls.__new__(cls)
        made.__dict__.update(state)
        return made

    def vocabulary(self) -> dict[int, np.ndarray]:
        """The places of all shingles in the table of frequencies, by their length in words."""
        by: dict[int, list[np.ndarray]] = {}
        for size, t in zip(self.sizes, self.tokens, strict=True):
            by.setdefault(min(self.shingle, size), []).append(t)
        return {k: np.unique(table_place(np.concatenate(v))) for k, v in by.items()}

    def choose(self, frequency: dict[int, np.ndarray]) -> None:
        """Take each window's rarest shingle, ties to the smaller hash, as its prefix token."""
        index: dict[int, dict[int, list[tuple[int, int]]]] = {}
        for w, (size, t) in enumerate(zip(self.sizes, self.tokens, strict=True)):
            at = int(np.lexsort((t, frequency[min(self.shingle, size)][table_place(t)]))[0])
            index.setdefault(min(self.shingle, size), {}).setdefault(int(t[at]), []).append((w, at))
        self.prefix = {k: (np.array(sorted(v), np.uint64), v) for k, v in index.items()}

    def marks(self, norm: bytes, hashes: dict[int, np.ndarray], spans) -> tuple[list[int], set[str]]:
        """First and last+1 words of the windows' occurrences, flat, and the items that they are of."""
        starts, ends = spans
        found: list[int] = []
        items: set[str] = set()
        for k, (tokens, index) in self.prefix.items():
            for at in np.flatnonzero(isin_sorted(hashes[k], tokens)).tolist():
                for w, offset in index[int(hashes[k][at])]:
                    first, size = at - offset, self.sizes[w]
                    if first < 0 or first + size > len(starts):
                        continue
                    if norm[starts[first] : ends[first + size - 1]] == self.texts[w]:
                        found += (first, first + size)
                        items.update(self.names[o] for o in self.owners[w])
        return found, items


def table_place(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - TABLE_BITS)).astype(np.int64)


def isin_sorted(values: np.ndarray, sorted_set: np.ndarray) -> np.ndarray:
    """Membership of many values in a small sorted set; a table of 16 bits rules most values out."""
    if not len(sorted_set) or not len(values):
        return np.zeros(len(values), bool)
    table = np.zeros(1 << 16, bool)
    table[(sorted_set >> np.uint64(48)).astype(np.int64)] = True
    out = table[(values >> np.uint64(48)).astype(np.int64)]
    maybe = np.flatnonzero(out)
    place = np.searchsorted(sorted_set, values[maybe])
    place[place == len(sorted_set)] = 0
    out[maybe] = sorted_set[place] == values[maybe]
    return out


def summary(n_words: int, spans, items) -> tuple:
    """A document's result row from its occurrences."""
    edges = np.zeros(n_words + 1, np.int64)
    pairs = np.asarray(spans, np.int64).reshape(-1, 2)
    np.add.at(edges, pairs[:, 0], 1)
    np.add.at(edges, pairs[:, 1], -1)
    hit = int(np.count_nonzero(np.cumsum(edges)))
    digest = hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
    return n_words, hit, len(items), digest, hit > 0 and 20 * hit >= n_words


def _blocks(benchmark: DataFrame, key: str, text: str, block_bytes: int) -> list[DataFrame]:
    """The benchmark's items (name, text) by blocks of about ``block_bytes``."""
    name = F.coalesce(F.col(key).cast("string"), F.lit("null"))
    items = benchmark.select(name.alias("name"), F.col(text).alias("text")).distinct()
    total = items.agg(F.sum(F.octet_length(F.coalesce("text", F.lit(""))) + F.lit(16))).first()[0] or 0
    count = -(-total // block_bytes) or 1
    return [items if count == 1 else items.filter(F.pmod(F.xxhash64("name", "text"), F.lit(count)) == b) for b in range(count)]


def _windows(block: DataFrame) -> Windows:
    """The block is on the driver as long as its windows are made."""
    return Windows([(r[0], normalized(r[1])) for r in block.toLocalIterator()])


def _frequencies(docs: DataFrame, text: str, places: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """In how many of all documents shingles stand, for the benchmark's places of the table."""
    sent = docs.sparkSession.sparkContext.broadcast({k: np.packbits(v) for k, v in places.items()})

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        asked = {k: np.unpackbits(v).view(bool) for k, v in sent.value.items()}
        totals = {k: np.zeros(len(v), np.int64) for k, v in asked.items()}
        for batch in batches:
            for t in batch.iloc[:, 0]:
                norm = normalized(t)
                spans = word_spans(norm)
                for k, v in asked.items():
                    at = (shingle_hashes(norm, k, spans) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
                    totals[k][np.unique(at[v[at]])] += 1
        for k, v in totals.items():
            at = np.flatnonzero(v)
            yield pd.DataFrame({"k": np.full(len(at), k), "at": at, "n": v[at]})

    out = {k: np.zeros(len(v), np.int64) for k, v in places.items()}
    if out:
        rows = docs.select(text).mapInPandas(count, "k int, at int, n long").groupBy("k", "at").agg(F.sum("n").alias("n"))
        for r in rows.toLocalIterator():
            out[r[0]][r[1]] = r[2]
    return out


def contamination(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES, out: str = "__contamination", from_files: bool = False
) -> DataFrame:
    """``docs`` with a struct column ``out`` of the fields of RESULT. ``from_files``: see rows.py.

    The plan is run by the caller, who bounds the Arrow batches (see batches.py).
    """
    context = docs.sparkSession.sparkContext
    blocks = _blocks(benchmark, item_key, item_text, block_bytes)
    asked: dict[int, np.ndarray] = {}
    for block in blocks:
        windows = _windows(block)
        for k, at in windows.vocabulary().items():
            asked.setdefault(k, np.zeros(1 << TABLE_BITS, bool))[at] = True
    with bounded_batches(docs.sparkSession):
        often = _frequencies(docs, text, asked)
    finish = _finisher()
    if len(blocks) == 1:
        mark = _marker(context, windows, often)
        marks = free_name([*docs.columns, out], "__marks")
        judged = docs.withColumn(marks, mark(F.col(text)))
        return judged.withColumn(out, finish(*[F.col(marks)[c] for c in ("n_words", "spans", "items")])).drop(marks)
    rows, file, row = placed_rows(docs, from_files)
    found: DataFrame | None = None
    for block in blocks:
        mark = _marker(context, _windows(block), often)
        some = rows.select(F.col(file).alias("file"), F.col(row).alias("row"), mark(F.col(text)).alias("m")).filter(F.size("m.items") > 0)
        with bounded_batches(docs.sparkSession):
            some = materialize(some.select("file", "row", "m.spans", "m.items"), "marks")
        mark.shared.destroy()
        found = some if found is None else found.unionByName(some)
    spans, items = free_name([*rows.columns, out], "__spans"), free_name([*rows.columns, out], "__items")
    whole = found.groupBy(F.col("file").alias(file), F.col("row").alias(row)).agg(F.flatten(F.collect_list("spans")).alias(spans), F.flatten(F.collect_list("items")).alias(items))
    whole = materialize(whole, "marks")
    few = whole.count() <= BROADCAST_ROWS
    judged = rows.join(F.broadcast(whole) if few else whole, [file, row], "left")
    return judged.withColumn(out, finish(_counter()(F.col(text)), F.col(spans), F.col(items))).select(*docs.columns, out)


def _counter():
    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        return pd.Series([len(word_spans(normalized(t))[0]) for t in texts], dtype="int64")

    return count


def _finisher():
    @F.pandas_udf(RESULT)
    def finish(n: pd.Series, spans: pd.Series, items: pd.Series) -> pd.DataFrame:
        rows = [summary(int(a), [] if b is None else b, set() if c is None else set(c)) for a, b, c in zip(n, spans, items, strict=True)]
        return pd.DataFrame(rows, columns=[x.split()[0] for x in RESULT.split(", ")])

    return finish


def _marker(context, windows: Windows, often: dict[int, np.ndarray]):
    windows.choose(often)
    windows.tokens = []
    shared = context.broadcast(vars(windows))

    @F.pandas_udf(MARKS)
    def mark(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        windows = Windows.of(shared.value)
        for texts in batches:
            n, spans, items = [], [], []
            for t in texts:
                norm = normalized(t)
                span = word_spans(norm)
                found, names = windows.marks(norm, {k: shingle_hashes(norm, k, span) for k in windows.prefix}, span)
                n.append(len(span[0]))
                spans.append(found)
                items.append(sorted(names))
            yield pd.DataFrame({"n_words": n, "spans": spans, "items": items})

    mark.shared = shared
    return mark


def decontaminate(docs: DataFrame, benchmark: DataFrame, from_files: bool = False) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with their columns as they were. ``from_files``: see rows.py."""
    name = free_name(docs.columns, "__contamination")
    judged = contamination(docs, benchmark, out=name, from_files=from_files)
    return judged.filter(~F.col(name)["contaminated"]).select(*docs.columns)
