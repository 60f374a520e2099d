"""BM25, exact vector search and their fusion, over tables instead of an in-memory index."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymill.functions.text import tokenize
from tallymill.session import materialize

# BM25's parameters and the constant of reciprocal rank fusion.
K1, B, RRF = 1.5, 0.75, 60
#: Up to this many keys that stand twice are sent to all tasks; more are joined by a shuffle.
BROADCAST_KEYS = 1_000_000


def postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(doc_id, term, tf, doc_len): the index table; written once, searched often."""
    words = docs.select(F.col(key).alias("doc_id"), tokenize(F.col(text)).alias("w")).withColumn("doc_len", F.size("w").cast("long"))
    # an inner explode would make Spark filter by the array's size and tokenize twice
    return words.select("doc_id", "doc_len", F.explode_outer("w").alias("term")).filter(F.col("term").isNotNull()).groupBy("doc_id", "term", "doc_len").agg(F.count(F.lit(1)).alias("tf"))


def corpus_stats(docs: DataFrame, text: str) -> DataFrame:
    """One row: n_docs, avg_len."""
    return docs.agg(F.count(F.lit(1)).alias("n_docs"), F.avg(F.coalesce(F.size(tokenize(F.col(text))), F.lit(0))).alias("avg_len"))


def document_frequencies(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(term, df): in how many documents a term is; rows of one key, or without one, are one document.

    A row's own repeats go within the row, so what is counted and shuffled are
    terms, and not pairs of document and term. Only rows whose key stands twice
    are compared by such pairs; their keys are broadcast up to ``BROADCAST_KEYS``.
    """
    def terms(some: DataFrame) -> DataFrame:
        w = some.select(F.col(key).alias("doc_id"), F.array_distinct(tokenize(F.col(text))).alias("w"))
        # an inner explode would make Spark filter by the array's size and tokenize twice
        return w.select("doc_id", F.explode_outer("w").alias("term")).filter(F.col("term").isNotNull())

    again = docs.groupBy(F.col(key).alias("__again")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1).select("__again")
    n_again = again.count()
    if not n_again:
        return terms(docs).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    keys = F.broadcast(again) if n_again <= BROADCAST_KEYS else again
    same = F.col(key).eqNullSafe(F.col("__again"))
    once = terms(docs.join(keys, same, "left_anti")).select("term")
    return once.unionByName(terms(docs.join(keys, same, "left_semi")).distinct().select("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def term_stats(post: DataFrame, stats: DataFrame) -> DataFrame:
    """(term, df, idf)."""
    return with_idf(post.groupBy("term").agg(F.count(F.lit(1)).alias("df")), stats)


def with_idf(df: DataFrame, stats: DataFrame) -> DataFrame:
    """(term, df, idf) from (term, df)."""
    return df.crossJoin(F.broadcast(stats.select("n_docs"))).select("term", "df", F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1).alias("idf"))


def asked_terms(spark: SparkSession, query: str) -> dict[str, int]:
    """The query's terms and how often each is asked; as many as the query has."""
    row = spark.createDataFrame([(query,)], "q string").select(tokenize(F.col("q")).alias("w")).first()
    return dict(Counter(row["w"] or []))


def _score_hits(hits: DataFrame, stats: DataFrame, asked: dict[str, int]) -> DataFrame:
    """(doc_id, score) from (doc_id, doc_len, term, tf) of the asked terms and one row of n_docs, avg_len."""
    idf = F.broadcast(term_stats(hits, stats))  # one row a query term
    times = F.create_map(*[F.lit(x) for pair in asked.items() for x in pair])[F.col("term")]
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("doc_len") / F.col("avg_len")))
    scored = hits.join(idf, "term").crossJoin(F.broadcast(stats.select("avg_len")))
    return scored.groupBy("doc_id").agg(F.sum(F.round(times * part, 9).cast("decimal(28,9)")).cast("double").alias("score"))


def bm25_scores(docs: DataFrame, query: str, key: str, text: str) -> DataFrame:
    """(doc_id, score) of every document; 0 without a query term; a repeated query term adds again.

    Texts are read and cut into words once: a document's length and its hits are
    written, and all else comes from these.
    """
    asked = asked_terms(docs.sparkSession, query)
    w = docs.select(F.col(key).alias("doc_id"), tokenize(F.col(text)).alias("w"))
    found = materialize(w.select("doc_id", F.size("w").alias("doc_len"), F.filter("w", lambda x: x.isin(*asked)).alias("found")), "hits")
    stats = found.agg(F.count(F.lit(1)).alias("n_docs"), F.avg(F.greatest(F.coalesce("doc_len", F.lit(0)), F.lit(0))).alias("avg_len"))
    if not asked:
        return found.select("doc_id", F.lit(0.0).alias("score"))
    hits = found.select("doc_id", "doc_len", F.explode("found").alias("term")).groupBy("doc_id", "doc_len", "term").agg(F.count(F.lit(1)).alias("tf"))
    return found.select("doc_id").join(_score_hits(hits, stats, asked), "doc_id", "left").select("doc_id", F.coalesce("score", F.lit(0.0)).alias("score"))


def term_counts(words: Column) -> Column:
    """An array of (term, tf) from an array of words: sorted, and cut where the word changes. The arrays in between stand in arrays of one, so that they are made once."""
    def cut(s: Column) -> Column:
        starts = F.array_compact(F.transform(s, lambda x, i: F.when((i == 0) | (x != F.get(s, i - 1)), i)))
        counted = lambda b: F.transform(b, lambda at, j: F.struct(F.get(s, at).alias("term"), (F.coalesce(F.get(b, j + 1), F.size(s)) - at).cast("long").alias("tf")))
        return F.get(F.transform(F.array(starts), counted), F.lit(0))

    return F.get(F.transform(F.array(F.sort_array(words)), cut), F.lit(0))


class TermIndex:
    """Postings in a folder: by batch of documents and bucket of the term, beside one row of totals a batch.

    A row is a document's count of one term. One row a document has no term and
    stands in a bucket of its own, which is the table of lengths. A text is cut
    into words once and counted within its row; the postings are dealt by bucket
    in parts of the size that adaptive execution aims at, so neither the number of
    buckets nor a large one bounds the tasks that write. A batch that is added
    again replaces itself, all buckets of it. A search reads the buckets of the
    terms that it asks for, the totals, and the lengths only where documents
    without a hit are wanted; rows of one document are added up there.
    """

    LENGTHS = -1

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def _bucket(self, term: Column) -> Column:
        return F.pmod(F.xxhash64(term), F.lit(self.buckets)).cast("int")

    def add(self, docs: DataFrame, batch: str, key: str = "doc_id", text: str = "text") -> None:
        """Documents' ids are new ones, or those of the batch that is replaced."""
        folder = "batch=" + re.sub(r"[^\w.-]", lambda m: f"%{ord(m[0]):02X}", batch)
        w = docs.select(F.col(key).alias("doc_id"), F.coalesce(tokenize(F.col(text)), F.array().cast("array<string>")).alias("w"))
        itself = F.array(F.struct(F.lit(None).cast("string").alias("term"), F.lit(0).cast("long").alias("tf")))
        post = w.select("doc_id", F.size("w").cast("long").alias("doc_len"), F.explode_outer(F.concat(itself, term_counts(F.col("w")))).alias("x")).select("doc_id", "doc_len", "x.*")
        post = post.withColumn("bucket", F.when(F.col("term").isNull(), F.lit(self.LENGTHS)).otherwise(self._bucket(F.col("term"))))
        post.hint("rebalance", "bucket").sortWithinPartitions("bucket").write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("bucket").parquet(f"{self.path}/postings/{folder}")
        lengths = self.spark.read.schema(post.schema).parquet(f"{self.path}/postings/{folder}").filter(F.col("bucket") == self.LENGTHS)
        totals = lengths.agg(F.count(F.lit(1)).alias("n_docs"), F.coalesce(F.sum("doc_len"), F.lit(0)).alias("total_len"))
        totals.write.mode("overwrite").parquet(f"{self.path}/totals/{folder}")

    def postings(self, terms: list[str]) -> DataFrame:
        """The postings of some terms; only their buckets' folders are listed and read."""
        asked = self.spark.createDataFrame([(t,) for t in terms], "term string").select(self._bucket(F.col("term")).alias("b")).distinct().collect()
        return self.spark.read.parquet(f"{self.path}/postings").filter(F.col("bucket").isin(*[r["b"] for r in asked]) & F.col("term").isin(*terms))

    def scores(self, query: str, every: bool = True) -> DataFrame:
        """(doc_id, score) of every document, or of those with a hit only."""
        asked = asked_terms(self.spark, query)
        lengths = self.spark.read.parquet(f"{self.path}/postings").filter(F.col("bucket") == self.LENGTHS).select("doc_id")
        if not asked:
            return lengths.select("doc_id", F.lit(0.0).alias("score")).filter(F.lit(every))
        totals = self.spark.read.parquet(f"{self.path}/totals").agg(F.sum("n_docs").alias("n_docs"), F.sum("total_len").alias("total_len"))
        stats = totals.select("n_docs", (F.col("total_len") / F.col("n_docs")).alias("avg_len"))
        hits = self.postings(list(asked)).groupBy("doc_id", "doc_len", "term").agg(F.sum("tf").alias("tf"))
        sums = _score_hits(hits, stats, asked)
        return lengths.join(sums, "doc_id", "left").select("doc_id", F.coalesce("score", F.lit(0.0)).alias("score")) if every else sums


def top_k(scored: DataFrame, k: int, score: str = "score", key: str = "doc_id", ascending: bool = False) -> DataFrame:
    """The best k, ties to the smaller key: TakeOrderedAndProject, no sort of the whole."""
    return scored.orderBy(F.asc(score) if ascending else F.desc(score), F.asc(key)).limit(k)


def _vector(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def l2_squared(c: Column, query: Sequence[float]) -> Column:
    return F.aggregate(F.zip_with(c, _vector(query), lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x)


def cosine(c: Column, query: Sequence[float]) -> Column:
    norms = F.sqrt(_dot(c, c)) * F.sqrt(_dot(_vector(query), _vector(query)))
    return F.try_divide(_dot(c, _vector(query)), norms)


def vector_top_k(vectors: DataFrame, query: Sequence[float], k: int, key: str, vector: str, metric: str = "l2", where: Column | None = None) -> DataFrame:
    """(doc_id, distance) nearest first, or (doc_id, similarity) for cosine; the filter runs before the ranking."""
    some = vectors.filter(where) if where is not None else vectors
    if metric == "cosine":
        return top_k(some.select(F.col(key).alias("doc_id"), F.round(cosine(F.col(vector), query), 6).alias("similarity")), k, "similarity")
    return top_k(some.select(F.col(key).alias("doc_id"), F.round(l2_squared(F.col(vector), query), 6).alias("distance")), k, "distance", ascending=True)


def ranked(hits: DataFrame, score: str, ascending: bool = False) -> DataFrame:
    """Top-k lists get their 1-based rank; a list has k rows."""
    from pyspark.sql import Window

    return hits.withColumn("rank", F.row_number().over(Window.orderBy(F.asc(score) if ascending else F.desc(score), F.asc("doc_id"))).cast("long"))


def hybrid_merge(dense: DataFrame, sparse: DataFrame, k: int) -> DataFrame:
    """Dense hits in their order, then sparse hits that dense lacks, cut to k: with k dense hits no sparse one shows."""
    rest = sparse.join(dense.select("doc_id"), "doc_id", "left_anti")
    both = dense.select("doc_id", F.lit("dense").alias("origin"), "rank").unionByName(rest.select("doc_id", F.lit("sparse").alias("origin"), "rank"))
    return both.orderBy("origin", "rank").limit(k).withColumn("confidence_score", F.lit(0.5))


def hybrid_rrf(dense: DataFrame, sparse: DataFrame, k: int, constant: int = RRF) -> DataFrame:
    """True reciprocal rank fusion: the sum of 1 / (constant + rank)."""
    both = dense.select("doc_id", "rank").unionByName(sparse.select("doc_id", "rank"))
    sums = both.groupBy("doc_id").agg(F.round(F.sum(F.lit(1.0) / (F.lit(constant) + F.col("rank"))), 9).alias("score"))
    return top_k(sums, k)


def rerank(hits: DataFrame, score: Callable[[DataFrame], Column] | None = None, k: int | None = None) -> DataFrame:
    """Hits with a confidence_score: that of ``score``, a column over the hits (a model behind a pandas UDF, say), best first and ties by doc_id; without one all are alike and stay as they are."""
    if score is None:
        out = hits.withColumn("confidence_score", F.lit(0.5))
        return out.limit(k) if k else out
    out = hits.withColumn("confidence_score", score(hits)).orderBy(F.desc_nulls_last("confidence_score"), F.asc("doc_id"))
    return out.limit(k) if k else out


def context(hits: DataFrame, content: str = "content", source: str = "source_id", score: str = "confidence_score", rank: str = "rank") -> DataFrame:
    """One row: the hits as numbered blocks; of a top-k list."""
    block = F.format_string("[%d] Source: %s\nContent: %s\nConfidence: %.3f", F.col(rank), F.col(source), F.col(content), F.col(score))
    blocks = F.sort_array(F.collect_list(F.struct(F.col(rank).alias("rank"), block.alias("block"))))
    return hits.agg(F.array_join(F.transform(blocks, lambda b: b["block"]), "\n\n").alias("context"))


def without_null_values(metadata: Column) -> Column:
    return F.map_filter(metadata, lambda _, v: v.isNotNull())


def chunk_metadata(m: Column) -> Column:
    """Typed metadata from a map, with defaults."""
    text = lambda k, d: F.coalesce(m[k], F.lit(d)).alias(k)
    return F.struct(
        text("source_origin", "unknown"),
        m["page_number"].cast("int").alias("page_number"),
        text("document_version", "1.0"),
        text("retention_policy_id", "unknown"),
        text("sensitivity_label", "unknown"),
        text("metadata_hash", "unknown"),
    )
