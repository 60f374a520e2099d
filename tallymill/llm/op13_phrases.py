"""Phrase collocation mining by contiguous pattern growth.

A phrase grows to the right only where it is frequent so far. Words are counted
first, then pairs of frequent words, and every place whose next pairs are all
frequent becomes an occurrence pointer: the ids of up to ``longest`` words from
there on. Pointers are sorted by their words, so the projection of a prefix is
an interval of them; tasks hold ranges of prefixes and grow each prefix depth
first by cutting its interval into the intervals of its next words. A prefix
too common for one task spans several: the first and last path of every block
is given out with its part of the count, and the parts are added. So no prefix,
however common, is gathered in one place, and counts are exact.

What is sent to all tasks are two bit sets of at most ``FILTER_BITS`` bits, over
the frequent words and pairs. They only spare pointers: what they let through
by chance is counted and dropped. A word is known by 64 bits of a hash of its
language and itself; should one that could count stand for two words, mining
starts again under another seed.

Edge cases: null texts are empty; a null language is ``und``; a null or empty
text and one of separators alone have no words; repeated rows count one by one;
a language without candidates has no rows; an empty table gives an empty
result; extra columns are not read. Ties in score and count go to the phrase of
smaller UTF-8 bytes.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallymill.llm.batches import bounded_batches
from tallymill.llm.words import mix
from tallymill.session import discard, materialize

LONGEST, MIN_COUNT, TOP = 5, 100, 2000
FILTER_BITS = 1 << 27
#: Tokens that a worker counts at once before it gives out what it has.
TOKENS = 1 << 20
_SEEDS = 16
_SALTS = 64
_TABLE = bytes(0xFF if chr(b) in ".,;:!?\n\x0b\x0c\r" else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_BREAK = b"\xff"  # no byte of UTF-8


def split_tokens(text: str | None) -> list[bytes]:
    """The words of a text, with a break for every separator."""
    return (text or "").encode("utf-8", "replace").translate(_TABLE).replace(_BREAK, b" \xff ").split()


class _Ids(dict):
    """Ids of one language's words; 0 is the break."""

    def __init__(self, lang: str, seed: int):
        super().__init__({_BREAK: 0})
        self.lang, self.seed = lang.encode("utf-8", "replace") + b"\n", seed

    def __missing__(self, word: bytes) -> int:
        import xxhash

        made = xxhash.xxh64_intdigest(self.lang + word, self.seed) or 1
        if len(self) < 1 << 20:
            self[word] = made
        return made


def _id_runs(batches: Iterator[pa.RecordBatch], seed: int) -> Iterator[np.ndarray]:
    """The ids of the words of many texts, a break after each text, about ``TOKENS`` at a time."""
    known: dict[str, _Ids] = {}
    held, n = [], 0
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            ids = known.setdefault(lang, _Ids(lang, seed)) if len(known) < 1000 or lang in known else _Ids(lang, seed)
            tokens = split_tokens(text)
            tokens.append(_BREAK)
            held.append(np.fromiter(map(ids.__getitem__, tokens), np.uint64, len(tokens)))
            n += len(tokens)
            if n >= TOKENS:
                yield np.concatenate(held)
                held, n = [], 0
    if held:
        yield np.concatenate(held)


def count_words(texts: DataFrame, seed: int) -> DataFrame:
    """id, lang, word (bytes), n of every word of (lang, text)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}

        def flush():
            for lang, words in counts.items():
                words.pop(_BREAK, None)
                ids = _Ids(lang, seed)
                made = np.fromiter(map(ids.__getitem__, words), np.uint64, len(words)).view(np.int64)
                columns = [pa.array(made), pa.array([lang] * len(words), pa.string()), pa.array(list(words), pa.binary()), pa.array(list(words.values()), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["id", "lang", "word", "n"])

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts.setdefault(lang, Counter()).update(split_tokens(text))
            if sum(map(len, counts.values())) > TOKENS // 4:
                yield from flush()
                counts = {}
        yield from flush()

    part = texts.mapInArrow(count, "id long, lang string, word binary, n long")
    return part.groupBy("id", "lang", "word").agg(F.sum("n").alias("n"))


def bit_set(hashes: DataFrame, column: str, count: int) -> np.ndarray:
    """A set of bits over a column of hashed longs, two bits each; its size is at most ``FILTER_BITS``, whatever the count."""
    bits = 1 << 16
    while bits < 16 * count and bits < FILTER_BITS:
        bits *= 2
    places = F.array(F.col(column).bitwiseAND(bits - 1), F.shiftrightunsigned(column, 32).bitwiseAND(bits - 1))
    at = hashes.select(F.explode(places).alias("at"))
    cells = at.groupBy(F.shiftright("at", 6).alias("cell")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(at & 63 AS INT))")).alias("bits"))
    found = cells.toPandas()  # at most FILTER_BITS / 64 rows
    out = np.zeros(bits // 64, np.uint64)
    out[found["cell"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64).view(np.uint64)
    return out


def may_hold(cells: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    last = np.uint64(64 * len(cells) - 1)
    out = np.ones(len(hashes), bool)
    for at in (hashes & last, (hashes >> np.uint64(32)) & last):
        out &= (cells[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1
    return out


def _pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(mix(a) * np.uint64(0x9E3779B97F4A7C15) + b)


def count_pairs(texts: DataFrame, words, seed: int) -> DataFrame:
    """a, b, n of neighbouring words that may both be frequent (``words``: the broadcast bit set)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids in _id_runs(batches, seed):
            known, code = np.unique(np.where(may_hold(words.value, ids), ids, np.uint64(0)), return_inverse=True)
            both = (known[code[:-1]] != 0) & (known[code[1:]] != 0)
            pairs, n = np.unique(code[:-1][both] * len(known) + code[1:][both], return_counts=True)
            a, b = known[pairs // len(known)], known[pairs % len(known)]
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(n.astype(np.int64))], ["a", "b", "n"])

    return texts.mapInArrow(count, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


def project(texts: DataFrame, pairs, seed: int, longest: int) -> DataFrame:
    """Occurrence pointers w1..w<longest>, n: words from a place on as long as neighbours may be frequent pairs, three or more; 0 ends them."""
    names = [f"w{j + 1}" for j in range(longest)]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids in _id_runs(batches, seed):
            good = (ids[:-1] != 0) & (ids[1:] != 0)
            good[good] = may_hold(pairs.value, _pair_hash(ids[:-1][good], ids[1:][good]))
            good = np.concatenate((good, np.zeros(longest, bool)))
            start = np.flatnonzero(good[:-1] & good[1:])
            known, code = np.unique(ids, return_inverse=True)
            code, more, row = code.astype(np.int64), np.ones(len(start), bool), np.zeros(len(start), np.int64)
            none = len(known)  # the code of what lies behind the end
            columns = []
            for j in range(longest):
                if j:
                    more &= good[start + j - 1]
                at = np.where(more, code[np.minimum(start + j, len(code) - 1)], none)
                columns.append(at)
                row = np.unique(row * (none + 1) + at, return_inverse=True)[1].astype(np.int64)
            _, first, n = np.unique(row, return_index=True, return_counts=True)
            values = np.append(known, np.uint64(0)).view(np.int64)
            yield pa.RecordBatch.from_arrays([*[pa.array(values[c[first]]) for c in columns], pa.array(n.astype(np.int64))], [*names, "n"])

    return texts.mapInArrow(find, ", ".join(f"{c} long" for c in [*names, "n"]))


def grow(words: np.ndarray, n: np.ndarray, least: int, shortest: int = 3) -> list[tuple[tuple, int]]:
    """The phrases that begin in a block of sorted pointers, with their counts there.

    Depth first: the interval of a prefix is cut where the next word changes.
    Phrases on the block's first or last path may go on in other blocks and are
    given whatever their count; of the others those of at least ``least``.
    """
    total = np.concatenate(([0], np.cumsum(n)))
    rows, longest = words.shape
    found: list[tuple[tuple, int]] = []
    open_intervals = [(0, rows, 0)] if rows else []
    while open_intervals:
        lo, hi, depth = open_intervals.pop()
        column = words[lo:hi, depth]
        cuts = np.concatenate(([0], np.flatnonzero(column[1:] != column[:-1]) + 1, [hi - lo])) + lo
        counts = total[cuts[1:]] - total[cuts[:-1]]
        keep = (words[cuts[:-1], depth] != 0) & ((counts >= least) | (cuts[:-1] == 0) | (cuts[1:] == rows))
        for i in np.flatnonzero(keep)[::-1]:
            if depth + 1 >= shortest:
                found.append((tuple(words[cuts[i], : depth + 1].tolist()), int(counts[i])))
            if depth + 1 < longest:
                open_intervals.append((int(cuts[i]), int(cuts[i + 1]), depth + 1))
    return found


def grown_phrases(pointers: DataFrame, least: int, longest: int) -> DataFrame:
    """p (ids), f of the phrases of three words and more: prefixes in ranges over the tasks, parts of counts added."""
    names = [f"w{j + 1}" for j in range(longest)]
    parts = int(pointers.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def mine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = np.stack([batch.column(j).to_numpy() for j in range(longest)], axis=1)
            found = grow(words, batch.column(longest).to_numpy(), least)
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in found], pa.list_(pa.int64())), pa.array([f for _, f in found], pa.int64())], ["p", "f"])

    dealt = pointers.repartitionByRange(parts, *names).sortWithinPartitions(*names)
    return dealt.mapInArrow(mine, "p array<long>, f long").groupBy("p").agg(F.sum("f").alias("f")).filter(F.col("f") >= least)


def _scored(phrases: DataFrame, words: DataFrame, totals: DataFrame) -> DataFrame:
    """lang, p, a, l, r, n, score of the candidates that no longer one of the same count contains."""
    longer = phrases.filter(F.size("p") > 2)
    shorter = F.explode(F.array(F.slice("p", 1, F.size("p") - 1), F.slice("p", 2, F.size("p") - 1)))
    # a longer candidate of the same count holds one that is longer by one word, of that count too
    inside = longer.select(shorter.alias("p"), "f").groupBy("p").agg(F.max("f").alias("__outer"))
    kept = phrases.filter(F.size("p") > 1).join(inside, "p", "left").filter(F.coalesce(F.col("__outer") < F.col("f"), F.lit(True)))
    head = words.select(F.col("id").alias("__head"), "lang")
    kept = kept.withColumn("__head", F.element_at("p", 1)).join(head, "__head").join(totals, "lang")
    cuts = kept.select("lang", "p", F.col("f").alias("a"), "n", F.explode(F.sequence(F.lit(1), F.size("p") - 1)).alias("k"))
    cuts = cuts.withColumn("__left", F.slice("p", F.lit(1), F.col("k"))).withColumn("__right", F.slice("p", F.col("k") + 1, F.size("p") - F.col("k")))
    left = phrases.select(F.col("p").alias("__left"), F.col("f").alias("l"))
    right = phrases.select(F.col("p").alias("__right"), F.col("f").alias("r"))
    wide = lambda c: F.col(c).cast("decimal(18,0)")
    score = F.expr("(1000BD * __a * __n) div (__l * __r)")
    cuts = cuts.join(left, "__left").join(right, "__right").withColumns({f"__{c}": wide(c) for c in ("a", "n", "l", "r")})
    best = cuts.withColumn("score", score).groupBy("lang", "p", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("__best"))
    return best.select("lang", "p", "a", "n", "__best.score", "__best.l", "__best.r")


def mine_phrases(
    docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = LONGEST, min_count: int = MIN_COUNT, top: int = TOP
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first ``top`` phrases of every language."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    with bounded_batches(spark):
        for seed in range(_SEEDS):
            words = materialize(count_words(texts, seed), "words")
            shared = words.groupBy("id").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("n")).filter((F.col("c") > 1) & (F.col("n") >= min_count))
            if shared.isEmpty():
                break
            discard(words)
        else:
            raise RuntimeError("words share 64-bit hashes under every seed")
        frequent = words.filter(F.col("n") >= min_count)
        word_bits = spark.sparkContext.broadcast(bit_set(frequent, "id", frequent.count()))
        pairs = materialize(count_pairs(texts, word_bits, seed).filter(F.col("n") >= min_count), "pairs")

        @F.pandas_udf("long")
        def hashed(a, b):
            import pandas as pd

            return pd.Series(_pair_hash(a.to_numpy(np.int64).view(np.uint64), b.to_numpy(np.int64).view(np.uint64)).view(np.int64))

        pair_bits = spark.sparkContext.broadcast(bit_set(pairs.select(hashed("a", "b").alias("h")), "h", pairs.count()))
        pointers = materialize(project(texts, pair_bits, seed, longest), "pointers")
    grown = grown_phrases(pointers, min_count, longest)
    ones = frequent.select(F.array("id").alias("p"), F.col("n").alias("f"))
    phrases = materialize(ones.unionByName(pairs.select(F.array("a", "b").alias("p"), F.col("n").alias("f"))).unionByName(grown), "phrases")
    discard(pointers, pairs)
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    first = [F.col("score").desc(), F.col("a").desc()]
    # ties stay in until their words are known; the first cut is spread over salts
    ranked = _scored(phrases, frequent, totals).withColumn("__salt", F.pmod(F.xxhash64("p"), F.lit(_SALTS)))
    for by in (["lang", "__salt"], ["lang"]):
        ranked = ranked.withColumn("__rank", F.rank().over(Window.partitionBy(*by).orderBy(*first))).filter(F.col("__rank") <= top)
    ranked = materialize(ranked.drop("__salt", "__rank"), "ranked")
    spelled = ranked.select("lang", "p", F.posexplode("p").alias("at", "id")).join(frequent.select("id", F.col("word").cast("string").alias("word")), "id")
    spelled = spelled.groupBy("lang", "p").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    place = Window.partitionBy("lang").orderBy(*first, F.col("phrase").asc())
    out = ranked.join(spelled, ["lang", "p"]).withColumn("rank", F.row_number().over(place).cast("long")).filter(F.col("rank") <= top)
    out = materialize(out.select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), "mined")
    discard(words, phrases, ranked)
    return out
