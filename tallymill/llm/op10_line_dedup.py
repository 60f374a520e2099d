"""Fuzzy line deduplication by SimHash.

Lines are normalized (lower case, no white space or punctuation at the ends).
The 64 bits of a line's SimHash are the majority votes of the hashes of its
words of five characters or more, or of all where it has none of these: shorter
ones are function words mostly, which would make all long lines of a language
alike. Two SimHashes at most one bit apart agree on three of four blocks whole,
so every line stands under the four choices of three blocks, and with it
whatever else agrees on 48 bits. A replaced word moves more bits
than that, so the words are pigeonholed too: by their hashes eight to sixteen
of them (in short lines all) fall into four parts, and a line stands under the
words of each two parts. One replaced word, two left out or two put in touch
two parts at most, so the other two are a key of both lines; of more changes
the sample sees some only. Lines with nearly as many words as the next thinner
sample begins with stand under its keys as well.

Members of a bucket whose SimHashes are at most ``BITS_APART`` bits apart are
candidates (see linking.py), and are verified by edit similarity of 0.8 or
more. Of every connected group the first occurrence by (doc_id, row, line) is
kept.

Only DataFrame functions are used. Line ids are 64-bit hashes of the
normalized lines.

Edge cases: lines without words are never dropped; a null text stays null and
has no lines; an empty text has one line without words; of repeated rows the
first keeps its lines; null doc_ids come last; an empty table gives an empty
result; extra columns are not read.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymill.llm.linking import TASK_BYTES, connect, sized
from tallymill.session import materialize

#: Blocks of a SimHash and how many of them agree in a bucket; the bits that the SimHashes of candidates differ in at most.
SIMILARITY, BLOCKS, AGREE, BITS_APART = 0.8, 4, 3, 26
_EDGES = " \t\r.,;:!?\"'()[]|-"
#: Four lanes of a long; the most votes that their comparison bears; the characters that can hold no more words.
_LANES, _MOST, _LONG = 0x0001000100010001, 8191, 16_000
#: A word of five characters within a line.
_WORD = r"[^ \t\r.,;:!?\"'()\[\]|-]{5}"
#: Parts of the sampled words, how many make a key, and the words that the sample has on an average at least.
_PARTS, _CHOSEN, _SAMPLE = 4, 2, 8
#: Widths of the bands in which an edit distance is looked for, before the allowed one.
_BANDS = (24, 192, 1536, 12288)
#: Up to this many line ids (8 bytes each), or places of dropped lines (4 bytes each, 8 places' worth a document), are sent to all tasks; more are joined by a shuffle.
BROADCAST_IDS, BROADCAST_PLACES = 1_000_000, 4_000_000
#: Pairs and characters that one task compares.
TASK_PAIRS, TASK_CHARS = 2_000, 1 << 20


def _lines(text: Column) -> Column:
    """The normalized lines of a text."""
    return F.transform(F.split(F.lower(text), "\n"), lambda x: F.trim(x, F.lit(_EDGES)))


def _numbered(docs: DataFrame) -> DataFrame:
    """(file, row, doc_id, pos, norm) of every line with words.

    Outer explodes: for inner ones Spark adds a filter on the array's size and
    builds the array twice.
    """
    return docs.select("file", "row", "doc_id", F.posexplode_outer(_lines(F.col("text"))).alias("pos", "norm")).filter(F.col("norm") != "")


def _either(bits: list[Column]) -> Column:
    out = bits[0]
    for i, b in enumerate(bits[1:], 1):
        out = out.bitwiseOR(F.shiftleft(b, i))
    return out


def _coded(docs: DataFrame) -> DataFrame:
    """(file, row, doc_id, pos, lid, n, simhash, keys) of every line with words.

    Where votes are even the words with the greatest and the least hash decide
    by turns, else lines of two words would be mostly zeros. Four counts share
    a long, 16 bits each, and are compared with half the votes together; the
    few lines of so many words that this could overflow are counted bit by bit.
    A part is the sum of 31 bits of its words' hashes; ``seen`` has 16 bits a
    part, one of which each of its words sets. Both stand there for the sample
    that a line has and for the next one.
    """
    keys = ["file", "row", "doc_id", "pos", "lid", "n"]

    def votes(some: DataFrame, mask: int, bits: int) -> DataFrame:
        # beside an explode in one select these would be computed for every word
        spaces = F.length("norm") - F.length(F.replace("norm", F.lit(" "), F.lit(""))) + 1
        scale = F.greatest(F.floor(F.log2(spaces.cast("double") / _SAMPLE)).cast("int"), F.lit(0))
        picky = F.rlike("norm", F.lit(_WORD))
        lines = some.select(*keys[:4], picky.alias("picky"), F.xxhash64("norm").alias("lid"), F.length("norm").alias("n"), spaces.alias("spaces"), F.call_function("shiftleft", F.lit(1), scale).alias("scale"), "norm")
        words = lines.select(*keys, "scale", "spaces", "picky", F.explode_outer(F.split("norm", " ")).alias("word")).withColumn("word", F.trim("word", F.lit(_EDGES)))
        votes = (F.length("word") > 4) | ~F.col("picky")
        words = words.filter(F.col("word") != "").select(*keys, "scale", "spaces", votes.alias("votes"), F.xxhash64("word").alias("h"))
        heard = lambda c: F.when(F.col("votes"), c).otherwise(F.lit(0).cast("long"))
        sampled = F.shiftrightunsigned("h", 40).cast("int")
        words = words.withColumns({f"at{j}": sampled.bitwiseAND(F.col("scale") * F.lit(_PARTS << j) - F.lit(1)) for j in (0, 1)})
        words = words.withColumn("heard", heard(F.col("h")))
        nil, parts = F.lit(0).cast("long"), []
        for j in (0, 1):
            at = F.col(f"at{j}")
            bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("h").bitwiseAND(15).cast("int") + at * 16)
            parts.append(F.bit_or(F.when(at < _PARTS, bit).otherwise(nil)).alias(f"seen{j}"))
            parts += [F.sum(F.when(at == i, F.col("h").bitwiseAND(0x7FFFFFFF)).otherwise(nil)).alias(f"part{j}{i}") for i in range(_PARTS)]
        counts = [F.sum(F.shiftright("heard", i).bitwiseAND(F.lit(mask).cast("long"))).alias(f"s{i}") for i in range(bits)]
        return words.groupBy(*keys, "scale", "spaces").agg(F.count_if("votes").alias("n_votes"), F.count(F.lit(1)).alias("n_words"), F.max(F.when(F.col("votes"), F.col("h"))).alias("tie0"), F.min(F.when(F.col("votes"), F.col("h"))).alias("tie1"), *parts, *counts)

    out = [*keys, "scale", "spaces", "n_words", *[f"{x}{j}{i}" for j in (0, 1) for x, i in [("seen", ""), *[("part", i) for i in range(_PARTS)]]]]
    short = votes(_numbered(docs).filter(F.length("norm") < _LONG), _LANES, 16)
    spare = (F.lit(_MOST) - F.col("n_votes")) * F.lit(_LANES)  # brings a lane that has more than half to the bit above _MOST
    tied = lambda i, mask: F.shiftright(f"tie{i % 2}", i).bitwiseAND(F.lit(mask).cast("long"))
    packed = [F.shiftright(F.shiftleft(f"s{i}", 1) + tied(i, _LANES) + spare, _MOST.bit_length()).bitwiseAND(_LANES) for i in range(16)]
    long = votes(_numbered(docs.filter(F.length("text") >= _LONG)).filter(F.length("norm") >= _LONG), 1, 64)
    single = [(F.col(f"s{i}") * 2 + tied(i, 1) > F.col("n_votes")).cast("long") for i in range(64)]
    both = short.select(*out, _either(packed).alias("simhash")).unionByName(long.select(*out, _either(single).alias("simhash")))
    return both.select(*keys, "simhash", F.concat(block_keys(F.col("simhash")), part_keys()).alias("keys"))


def part_keys() -> Column:
    """One key per two parts of a line's sampled words, if they hold three words, in lines of up to eight words two."""
    least = F.when(F.col("n_words") > 8, F.lit(3)).otherwise(F.lit(2))
    keys = []
    for j in (0, 1):
        scale = F.col("scale") * F.lit(1 << j)
        # a line is at most a quarter longer than a near one: this one's next sample is that one's own
        here = F.lit(True) if j == 0 else F.col("spaces") * 5 >= scale * F.lit(4 * _SAMPLE)
        for some in combinations(range(_PARTS), _CHOSEN):
            mask = sum(0xFFFF << 16 * i for i in some)
            held = F.bit_count(F.col(f"seen{j}").bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask).cast("long")))
            keys.append(F.when(here & (held >= least), F.xxhash64(F.lit(100 + 10 * some[0] + some[1]), scale, *[f"part{j}{i}" for i in some])))
    return F.array_compact(F.array(*keys))


def block_keys(simhash: Column, blocks: int = BLOCKS, agree: int = AGREE) -> Column:
    """One key per choice of the blocks that must agree: all pairs at most ``blocks - agree`` bits apart share one."""
    edges = [64 * b // blocks for b in range(blocks + 1)]
    parts = [F.shiftrightunsigned(simhash, a).bitwiseAND((1 << (b - a)) - 1) for a, b in zip(edges, edges[1:], strict=False)]
    return F.array(*[F.xxhash64(F.lit(i + 2), *[parts[b] for b in some]) for i, some in enumerate(combinations(range(blocks), agree))])


def _allowed(longest: Column, similarity: float) -> Column:
    return F.floor(longest * F.lit(1 - similarity) + F.lit(1e-9)).cast("int")


def _near(a: Column, b: Column, similarity: float) -> Column:
    """Whether the edit distance is at most the allowed share of the longer text, by bands as narrow as settle it."""
    longest = F.greatest(F.length(a), F.length(b))
    allowed = _allowed(longest, similarity)
    within = lambda band: F.call_function("levenshtein", a, b, band) >= 0
    out = within(F.least(allowed, F.lit(_BANDS[0])))
    for narrower, band in zip(_BANDS, (*_BANDS[1:], None), strict=True):
        out = out | ((allowed > narrower) & within(allowed if band is None else F.least(allowed, F.lit(band))))
    return (F.least(F.length(a), F.length(b)) >= longest - allowed) & out


def dedup_lines(docs: DataFrame, similarity: float = SIMILARITY, key: str = "doc_id", text: str = "text", row: tuple[str, str] | None = None) -> DataFrame:
    """doc_id, n_lines, n_dropped, text: every document without the dropped lines.

    ``row`` names two columns of longs that tell rows apart and stay the same
    when ``docs`` is read again, such as a file's hash and the row's place in
    it; without them the documents are numbered and written first.
    """
    place = [F.col(row[0]).alias("file"), F.col(row[1]).alias("row")] if row else [F.lit(0).cast("long").alias("file"), F.monotonically_increasing_id().alias("row")]
    base = docs.select(*place, F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    if not row:
        base = materialize(base, "numbered")
    coded = materialize(_coded(base), "places")
    places = coded.select("file", "row", "doc_id", "pos", "lid")
    members = coded.select(F.explode_outer("keys").alias("key"), F.col("lid").alias("v"))
    codes = coded.select(F.col("lid").alias("v"), F.struct("simhash", "n").alias("x"))
    known: list[DataFrame] = []

    def may(p: Column, q: Column) -> Column:
        longest = F.greatest(p["n"], q["n"])
        close = F.bit_count(p["simhash"].bitwiseXOR(q["simhash"])) <= BITS_APART
        return close & (F.least(p["n"], q["n"]) >= longest - _allowed(longest, similarity))

    def prepare(vertices: DataFrame) -> None:
        """Texts, each from one place, of the lines that share a bucket."""
        few = vertices.count() <= BROADCAST_IDS
        here = F.broadcast(vertices) if few else vertices
        picks = places.join(here, F.col("lid") == F.col("v"), "left_semi").groupBy("lid").agg(F.min(F.struct("file", "row", "pos")).alias("at"))
        picks = materialize(picks.select("lid", "at.*"), "picks")
        some = _numbered(base).join(F.broadcast(picks) if few else picks, ["file", "row", "pos"])
        known.append(materialize(some.select("lid", "norm"), "texts"))

    def verify(pairs: DataFrame) -> DataFrame:
        count, chars = pairs.agg(F.count(F.lit(1)), F.sum(F.col("xa.n") + F.col("xb.n"))).first()
        chars = chars or 0
        most = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), chars // TASK_BYTES)
        tasks = max(1, min(most, max(-(-count // TASK_PAIRS), -(-chars // TASK_CHARS))))
        ends = materialize(pairs.select(F.col("a").alias("lid")).union(pairs.select(F.col("b").alias("lid"))).distinct(), "ends")
        some = known[0].join(F.broadcast(ends) if ends.count() <= BROADCAST_IDS else ends, "lid", "left_semi")
        both = pairs.select("a", "b").join(some.toDF("a", "na"), "a").join(some.toDF("b", "nb"), "b")
        return sized(both.repartition(tasks, "a", "b").filter(_near(F.col("na"), F.col("nb"), similarity)).select("a", "b"), chars)

    groups = connect(members, verify, codes, may, prepare=prepare)
    rank = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "file", "row", "pos")
    stats = places.groupBy("lid").agg(F.min(rank).alias("head"), F.count(F.lit(1)).alias("n"))
    named = stats.join(groups, F.col("lid") == F.col("v"), "left").select("lid", "head", "n", F.coalesce("c", "lid").alias("c"), F.col("c").isNotNull().alias("linked"))
    named = materialize(named.filter(F.col("linked") | (F.col("n") > 1)), "named")
    tops = named.join(named.groupBy("c").agg(F.min("head").alias("top")), "c").select("lid", F.struct("top.file", "top.row", "top.pos").alias("top"))
    dropped = places.join(tops, "lid").filter(F.struct("file", "row", "pos") != F.col("top"))
    drops = materialize(dropped.groupBy("file", "row").agg(F.collect_list("pos").alias("drops")), "drops")
    few = (drops.agg(F.sum(F.size("drops") + F.lit(8))).first()[0] or 0) <= BROADCAST_PLACES
    # in the one-element array the lines are split once and not for every place
    places_kept = lambda lines: F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("drops"))
    kept = F.get(F.transform(F.array(F.split("text", "\n")), lambda lines: F.array_join(F.transform(places_kept(lines), lambda i: F.get(lines, i)), "\n")), F.lit(0))
    return base.join(F.broadcast(drops) if few else drops, ["file", "row"], "left").select(
        "doc_id",
        F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size(F.split("text", "\n"))).cast("long").alias("n_lines"),
        F.when(F.col("drops").isNull(), F.lit(0)).otherwise(F.size("drops")).cast("long").alias("n_dropped"),
        F.when(F.col("drops").isNull(), F.col("text")).otherwise(kept).alias("text"),
    )
