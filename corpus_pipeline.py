"""From raw documents to shards of training data.

Each stage takes what its predecessor kept, as Parquet. Documents judged of
low quality go, one document of every near-duplicate class stays, contaminated
documents go, sources are mixed to their target weights (a document comes 0, 1
or 2 times), and the rest is dealt to shards. All stages but the last return
the columns of ``documents``, extra ones with clashing names included.

Edge cases: null and empty texts are scored by the quality model like others,
are copies of each other, are not contaminated and have size 0 in the mix
(which takes as many as its source's rate says); a null source is a source of
its own, the last; null doc_ids come last in ties and count as key -1 in the
shards; ties go to the least doc_id, then to the first row; repeated rows are
copies, and what the mix takes twice gets a slot each; without labels every
document is kept by the quality stage, without benchmark by decontamination;
empty tables give empty results.

The stages' texts go to Python in bounded Arrow batches, which the stages set
for their session, since their plans are run by others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallymill.llm import batches, op2_quality, op4_decontamination, op5_sharding, op6_mixing, op7_near_dedup
from tallymill.session import materialize, read_table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    batches.bound_batches(spark)
    return op2_quality.keep_good(docs, read_table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op7_near_dedup.drop_near_duplicates(docs, from_files=True)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    batches.bound_batches(spark)
    return op4_decontamination.decontaminate(docs, read_table(spark, sf_dir, "benchmark"), from_files=True)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op6_mixing.mixed_documents(docs, from_files=True)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op5_sharding.shard_documents(docs, 40)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontamination", decontamination), ("mixing", mixing), ("sharding", sharding)]

#: Neither a trained model nor sampled signatures are expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
