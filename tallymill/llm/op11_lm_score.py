"""Language-model scores by context-tree weighting over bytes.

Every byte is eight binary decisions. Each decision has a tree of its own over
the bytes before, up to ``depth`` of them, and a node's counts of zeros and ones
give the Krichevsky-Trofimov probability of what was seen there. A node's
weighted probability is half that and half the product of its children's; so
all depths are mixed, and the share of each at a context follows from the
weighted probabilities on the way down. A text begins after ``depth`` NUL bytes
and ends with one, which is coded too: the score is the log10 probability of
the text and its end, and its code length per byte is told beside it.

Nothing of the model is gathered in one place. Texts are dealt to groups of
about ``GROUP_BYTES``; a group gives out its different byte grams (a context and
the byte after it) and words with their training counts, the trees are summed
level by level as tables and weighted from the leaves up and the root down, and
a group gets back the values of its own grams and words. What is asked but was
never in training counts as seen zero times, which leaves the mixture as it is.

Edge cases: a null or empty text has the end alone; a null doc_id is trained on;
without training rows every bit costs one bit, N and V are 0; repeated rows
count and are scored one by one; an empty table gives an empty result; extra
columns are not read. A text is held in one worker at a time, whole, its grams
a quarter of a million at a time.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymill.llm.rows import placed_rows
from tallymill.session import discard, free_shuffles, materialize

DEPTH = 5
GROUP_BYTES = 32 << 20
#: Grams of one text or several that are looked up together, that are counted together, and the different ones held before they are compacted.
_PIECE, _COUNTED, _HELD = 1 << 18, 1 << 21, 1 << 22
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_END = b"\n"  # no word has it


def split_words(text: bytes) -> list[bytes]:
    """Words between ASCII white space, and the end."""
    return [*text.translate(_LOWER).split(), _END]


def grams(text: bytes, depth: int):
    """The contexts of ``depth`` bytes with the byte after them, packed into longs, a piece of the text at a time."""
    data = np.frombuffer(bytes(depth) + text + b"\0", np.uint8)
    n = len(data) - depth
    for i in range(0, n, _PIECE):
        j = min(n, i + _PIECE)
        out = np.zeros(j - i, np.int64)
        for k in range(depth + 1):
            out = out << 8 | data[i + k : j + k]
        yield out


class _GramCounts:
    """Different grams with added weights; compacted as they come."""

    def __init__(self):
        self.held: list[tuple[np.ndarray, np.ndarray]] = []
        self.n = 0
        self.waiting: dict[int, list[np.ndarray]] = {0: [], 1: []}
        self.size = {0: 0, 1: 0}

    def add(self, some: np.ndarray, weight: int) -> None:
        self.waiting[weight].append(some)
        self.size[weight] += len(some)
        if self.size[weight] >= _COUNTED:
            self._take(weight)

    def _take(self, weight: int) -> None:
        if not self.waiting[weight]:
            return
        values, n = np.unique(np.concatenate(self.waiting[weight]), return_counts=True)
        self.waiting[weight], self.size[weight] = [], 0
        self.held.append((values, n * weight))
        self.n += len(values)
        if self.n > _HELD:
            self._compact()
            self.n = len(self.held[0][0]) // 2  # compact again only after as much as is there

    def _compact(self) -> None:
        values = np.unique(np.concatenate([v for v, _ in self.held]))
        total = np.zeros(len(values), np.int64)
        for v, n in self.held:
            total[np.searchsorted(values, v)] += n
        self.held = [(values, total)]

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        for weight in self.waiting:
            self._take(weight)
        if not self.held:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        self._compact()
        return self.held[0]


def summed(texts: list[bytes], depth: int, at: np.ndarray, value: np.ndarray) -> np.ndarray:
    """For every text the sum of its grams' values, of the sorted grams ``at``.

    The grams of several texts are sorted together, each with its text's number
    behind it, and looked up in order: one after the other they would each miss the cache.
    """
    out, room = np.zeros(len(texts)), max(0, 63 - 8 * (depth + 1))
    waiting, n, first = [], 0, 0

    def take(last: int) -> None:
        keys = np.concatenate(waiting)
        keys.sort()
        some = keys >> room
        new = np.concatenate(([True], some[1:] != some[:-1]))
        found = value[np.searchsorted(at, some[new])][np.cumsum(new) - 1]
        out[first : last + 1] += np.bincount(keys & ((1 << room) - 1), weights=found, minlength=last + 1 - first)

    for i, t in enumerate(texts):
        if waiting and i - first >= 1 << room:
            take(i - 1)
            waiting, n = [], 0
        for some in grams(t, depth):
            if not waiting:
                first = i
            waiting.append(some << room | (i - first))
            n += len(some)
            if n >= _PIECE:
                take(i)
                waiting, n = [], 0
    if waiting:
        take(len(texts) - 1)
    return out


def _lgamma(x: Column) -> Column:
    """ln of the gamma function for x >= 1/2: Stirling's series eight steps up."""
    z = x + 8
    steps = x
    for i in range(1, 8):
        steps = steps * (x + i)
    series = 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * z * z * z * z * z)
    return (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + series - F.log(steps)


def kt_log(a: Column, b: Column) -> Column:
    """ln of the Krichevsky-Trofimov probability of a zeros and b ones."""
    a, b = a.cast("double"), b.cast("double")
    return _lgamma(a + 0.5) + _lgamma(b + 0.5) - _lgamma(a + b + 1) - math.log(math.pi)


def _bits(gram: str = "gram") -> list[tuple[Column, Column]]:
    """For each of a gram's eight decisions the leaf's key (context, bits so far behind a leading one) and the bit."""
    g = F.col(gram)
    byte, context = g.bitwiseAND(255), F.shiftleft(F.shiftright(g, 8), 8)
    return [(context.bitwiseOR(F.lit(1 << j).bitwiseOR(F.shiftright(byte, 8 - j))), F.shiftright(byte, 7 - j).bitwiseAND(1)) for j in range(8)]


def weighted_levels(counted: DataFrame, depth: int) -> list[DataFrame]:
    """From (gram, n) the nodes of every depth: key, a, b, stop and go, the shares of the node itself and of its children."""
    each = F.explode(F.array(*[F.struct(k.alias("key"), (F.col("n") * (1 - bit)).alias("a"), (F.col("n") * bit).alias("b")) for k, bit in _bits()]))
    # dealt by context before they are taken apart, the decisions of a context are together
    dealt = counted.withColumn("context", F.shiftright("gram", 8)).repartition("context")
    level = dealt.select("context", each.alias("x")).groupBy("context", "x.key").agg(F.sum("x.a").alias("a"), F.sum("x.b").alias("b")).drop("context")
    level = level.withColumn("lw", kt_log(F.col("a"), F.col("b"))).withColumns({"stop": F.lit(1.0), "go": F.lit(0.0)})
    levels = [materialize(level, f"level{depth}")]
    half = math.log(0.5)
    for d in range(depth - 1, -1, -1):
        up = F.col("key").bitwiseAND((1 << (8 * d + 8)) - 1)
        level = levels[-1].groupBy(up.alias("key")).agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("lw").alias("__below")).withColumn("__own", kt_log(F.col("a"), F.col("b")))
        both = F.greatest("__own", "__below") + F.log1p(F.exp(F.least("__own", "__below") - F.greatest("__own", "__below")))
        level = level.withColumn("lw", half + both).withColumn("stop", F.exp(half + F.col("__own") - F.col("lw"))).withColumn("go", F.exp(half + F.col("__below") - F.col("lw")))
        levels.append(materialize(level.drop("__own", "__below"), f"level{d}"))
    free_shuffles(counted.sparkSession)
    return levels[::-1]


def priced_grams(counted: DataFrame, depth: int) -> DataFrame:
    """gram, value: log10 of the probability of its last byte after the bytes before."""
    levels = weighted_levels(counted, depth)
    zero, one = ((F.col(c) + 0.5) / (F.col("a") + F.col("b") + 1) for c in ("a", "b"))
    path = None
    for d, level in enumerate(levels):
        here = level.select("key", "stop", "go", zero.alias("zero"), one.alias("one"))
        if path is None:
            here = here.withColumns({"__zero": F.lit(0.0), "__one": F.lit(0.0), "__reach": F.lit(1.0)})
        else:
            here = here.withColumn("up", F.col("key").bitwiseAND((1 << (8 * d)) - 1)).join(path, "up")
        mass = lambda c: F.col(f"__{c}") + F.col("__reach") * F.col("stop") * F.col(c)
        path = here.select(F.col("key").alias("up"), mass("zero").alias("__zero"), mass("one").alias("__one"), (F.col("__reach") * F.col("go")).alias("__reach"))
    leaf = F.struct(F.col("up").bitwiseAND(255).alias("node"), F.struct(F.log10("__zero").alias("zero"), F.log10("__one").alias("one")).alias("cost"))
    costs = path.select(F.shiftright("up", 8).alias("context"), leaf.alias("leaf")).groupBy("context").agg(F.map_from_entries(F.collect_list("leaf")).alias("costs"))  # 255 decisions at most
    total = F.lit(0.0)
    for leaf_key, bit in _bits():
        cost = F.element_at("costs", leaf_key.bitwiseAND(255))
        total = total + F.when(bit == 1, cost["one"]).otherwise(cost["zero"])
    out = counted.select("gram", F.shiftright("gram", 8).alias("context")).join(costs, "context").select("gram", total.alias("value"))
    out = materialize(out, "priced")
    discard(*levels)
    free_shuffles(counted.sparkSession)
    return out


def score_texts(docs: DataFrame, depth: int = DEPTH, group_bytes: int = GROUP_BYTES, folds: int = 7, held: int = 2, key: str = "doc_id", text: str = "text", from_files: bool = False) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte for every row. ``from_files``: see rows.py."""
    rows, file, row = placed_rows(docs.select(key, text) if not from_files else docs, from_files)
    body = F.coalesce(F.col(text), F.lit(""))
    held_out = F.coalesce(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(folds)) == held, F.lit(False))
    total = rows.agg(F.sum(F.octet_length(body) + 64)).first()[0] or 0
    group = F.pmod(F.xxhash64(file, row), F.lit(max(1, -(-total // group_bytes)))).alias("g")
    # ids travel as strings, as pandas would make floats of longs with nulls
    dealt = rows.select(F.col(key).cast("string").alias("doc_id"), held_out.alias("held_out"), body.cast("binary").alias("text"), group)

    def ask(part: pa.Table) -> pa.Table:
        found, words = _GramCounts(), Counter()
        for t, out in zip(part["text"].to_pylist(), part["held_out"].to_pylist()):
            for some in grams(t, depth):
                found.add(some, int(not out))
            if out:
                for w in set(split_words(t)):
                    words[w] += 0
            else:
                words.update(split_words(t))
        values, n = found.counts()
        none = lambda k, t: pa.nulls(k, t)
        g = pa.array(np.full(len(values) + len(words), part["g"][0].as_py()))
        gram = pa.chunked_array([pa.array(values), none(len(words), pa.int64())])
        word = pa.chunked_array([none(len(values), pa.binary()), pa.array(list(words), pa.binary())])
        return pa.table({"g": g, "gram": gram, "word": word, "n": pa.array(np.concatenate((n, np.fromiter(words.values(), np.int64, len(words)))))})

    asked = materialize(dealt.groupBy("g").applyInArrow(ask, "g long, gram long, word binary, n long"), "asked")
    free_shuffles(docs.sparkSession)
    by_gram, by_word = asked.filter(F.col("gram").isNotNull()).select("g", "gram", "n"), asked.filter(F.col("word").isNotNull()).select("g", "word", "n")
    counted = materialize(by_gram.groupBy("gram").agg(F.sum("n").alias("n")), "grams")
    words = materialize(by_word.groupBy("word").agg(F.sum("n").alias("c")), "words")
    n_all, n_different = (int(x or 0) for x in words.agg(F.sum("c"), F.count_if(F.col("c") > 0)).first())
    priced = priced_grams(counted, depth)
    nothing = F.lit(-1).cast("long")
    answers = (
        by_gram.select("g", "gram").join(priced, "gram").select("g", "gram", F.lit(None).cast("binary").alias("word"), "value", nothing.alias("c"))
        .unionByName(by_word.select("g", "word").join(words, "word").select("g", nothing.alias("gram"), "word", F.lit(0.0).alias("value"), "c"))
    )
    room = math.log10(n_all + n_different + 1)

    def score(part: pa.Table, known: pa.Table) -> pa.Table:
        c = known["c"].to_numpy()
        of_words = c >= 0
        count = dict(zip(known["word"].filter(pa.array(of_words)).to_pylist(), c[of_words].tolist()))
        at, value = known["gram"].to_numpy()[~of_words], known["value"].to_numpy()[~of_words]
        order = np.argsort(at)
        at, value = at[order], value[order]
        out, texts = [], part["text"].to_pylist()
        models = summed(texts, depth, at, value).tolist()
        for doc, is_held, t, model in zip(part["doc_id"].to_pylist(), part["held_out"].to_pylist(), texts, models):
            words = split_words(t)
            c = np.fromiter(map(count.__getitem__, words), float, len(words))
            base = float(np.log10(c + 1).sum()) - len(c) * room
            out.append((doc, is_held, len(c), int((c > 0).sum()), n_all, base, model, len(t), -model / math.log10(2) / (len(t) + 1)))
        columns = list(zip(*out)) if out else [[]] * 9
        kinds = [pa.string(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.float64()]
        return pa.table({x.split()[0]: pa.array(list(v), k) for x, v, k in zip(schema.split(", "), columns, kinds)})

    schema = "doc_id string, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long, bits_per_byte double"
    scored = dealt.groupBy("g").cogroup(answers.groupBy("g")).applyInArrow(score, schema)
    scored = materialize(scored.withColumn("doc_id", F.col("doc_id").cast(docs.schema[key].dataType)), "scored")
    discard(asked, counted, words, priced)
    return scored
