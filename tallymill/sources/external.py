"""Readers and writers at the edges: databases, object stores, JSON corpora, profiles."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymill import schemas
from tallymill.functions.text import chunk_hash


def retried(call: Callable[[], Any], attempts: int = 3, low: float = 2.0, high: float = 10.0, on: tuple = (Exception,), sleep=time.sleep) -> Any:
    """For calls of the driver: waits that double between ``low`` and ``high`` seconds, then the last error. Tasks are retried by Spark."""
    for i in range(attempts):
        try:
            return call()
        except on:
            if i == attempts - 1:
                raise
            sleep(min(high, low * 2**i))


def between(df: DataFrame, column: str, start, end) -> DataFrame:
    """Closed on both ends; reaches Parquet and JDBC scans as a pushed filter."""
    return df.filter(F.col(column).between(F.lit(start), F.lit(end)))


def jdbc_transactions(spark: SparkSession, url: str, start, end, table: str = "transactions", column: str = "date", lower: int | None = None, upper: int | None = None, parts: int = 16, key: str = "transaction_id", **options) -> DataFrame:
    """Range scan of a database table, in parallel over ``key`` where its bounds are given."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if lower is not None and upper is not None:
        reader = reader.options(partitionColumn=key, lowerBound=lower, upperBound=upper, numPartitions=parts)
    return validated(between(retried(reader.load), column, start, end).select("transaction_id", "amount", "currency"), table)


def validated(df: DataFrame, origin: str, version: str = "v1.0") -> DataFrame:
    return df.select(
        F.col("transaction_id").cast("string").alias("transaction_id"),
        F.expr("try_cast(amount AS double)").alias("amount"),
        F.col("currency").cast("string").alias("currency"),
        F.lit(origin).alias("source_origin"),
        F.current_timestamp().alias("ingestion_timestamp"),
        F.lit(version).alias("governance_version"),
    )


def object_bytes(spark: SparkSession, path: str) -> DataFrame:
    """path, length, content of the objects below a path of any store that Spark reads."""
    return spark.read.format("binaryFile").load(path).select("path", "length", "content")


def json_corpus(spark: SparkSession, path: str, version: str = "1.0", retention: str = "unknown", sensitivity: str = "unknown") -> DataFrame:
    """{"documents": [{id, document, metadata}]} as chunks with typed metadata; no documents, no rows."""
    d = spark.read.schema(schemas.CORPUS_FILE).option("multiLine", True).json(path).select(F.explode("documents").alias("d")).select("d.*")
    source, doc_version = F.coalesce(F.col("metadata")["source"], F.lit("unknown")), F.coalesce(F.col("metadata")["version"], F.lit(version))
    return d.select(
        "id",
        F.col("document").alias("content"),
        F.struct(
            source.alias("source_origin"),
            F.lit(None).cast("int").alias("page_number"),
            doc_version.alias("document_version"),
            F.lit(retention).alias("retention_policy_id"),
            F.lit(sensitivity).alias("sensitivity_label"),
            chunk_hash(F.col("document"), source, F.lit(None), doc_version).alias("metadata_hash"),
        ).alias("metadata"),
    )


def pdf_pages(spark: SparkSession, path: str) -> DataFrame:
    """path, page (from 1), content; needs an optional PDF library on the executors."""

    def pages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io

        from pypdf import PdfReader

        for batch in batches:
            rows = [(p, i, page.extract_text()) for p, c in zip(batch["path"], batch["content"], strict=True) for i, page in enumerate(PdfReader(io.BytesIO(c)).pages, 1)]
            yield pd.DataFrame(rows, columns=["path", "page", "content"])

    return object_bytes(spark, path).select("path", "content").mapInPandas(pages, "path string, page int, content string")


def kafka_stream(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    return spark.readStream.format("kafka").options(**{"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": "earliest"}).load()


def embed(df: DataFrame, text: str, model: Callable[[list[str]], list[list[float]]], batch: int = 100, out: str = "embedding") -> DataFrame:
    """The hook for an embedding service: ``model`` gets batches of texts, with retries."""

    @F.pandas_udf("array<float>")
    def call(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            vectors: list[list[float]] = []
            for at in range(0, len(texts), batch):
                vectors += retried(lambda some=texts[at : at + batch].tolist(): model(some), attempts=5, high=60.0, on=(ConnectionError, TimeoutError))
            yield pd.Series(vectors)

    return df.withColumn(out, call(F.col(text)))


def check_profile(profile: dict) -> list[str]:
    """What is wrong with a simulation profile; empty if nothing is."""
    allowed = {"transaction_type_probs", "amount_mean", "amount_std", "velocity_lambda", "dataset_size", "total_queries_per_year", "query_type", "clipping_bound", "seed", "model_version"}
    wrong = [f"unknown field {k}" for k in sorted(set(profile) - allowed)]
    probs = profile.get("transaction_type_probs", {})
    wrong += [f"probability of {k} is not in (0, 1]" for k, p in probs.items() if not 0 < p <= 1]
    if probs and abs(sum(probs.values()) - 1) > 1e-9:
        wrong.append("probabilities do not sum to 1")
    if profile.get("clipping_bound", 1) > 250_000:
        wrong.append("clipping_bound is above 250000")
    return wrong + [f"{k} is not positive" for k in ("amount_std", "velocity_lambda", "dataset_size", "total_queries_per_year", "clipping_bound") if profile.get(k, 1) <= 0]


def load_profiles(path: str) -> dict[str, dict]:
    """Profiles from YAML where the library is installed, else from JSON."""
    with open(path) as f:
        if path.endswith((".yaml", ".yml")):
            import yaml

            return yaml.safe_load(f)
        return json.load(f)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def append_table(df: DataFrame, name: str, properties: dict[str, str] | None = None) -> None:
    """Create if missing, else append; ``properties`` and the descriptions of columns (as description.<column>) become table properties, beside those that are there."""
    df.write.mode("append").saveAsTable(name)
    about = {f"description.{f.name}": str(f.metadata["description"]) for f in df.schema.fields if "description" in f.metadata} | (properties or {})
    if about:
        quoted = lambda x: "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
        df.sparkSession.sql(f"ALTER TABLE {name} SET TBLPROPERTIES ({', '.join(f'{quoted(k)} = {quoted(v)}' for k, v in about.items())})")


def write_vectors(docs: DataFrame, path: str) -> None:
    """Documents for search: null metadata values dropped; embeddings kept only where every document has one."""
    whole = docs.agg(F.coalesce(F.bool_and(F.col("embedding").isNotNull()), F.lit(False))).first()[0] if "embedding" in docs.columns else False
    out = docs.withColumn("metadata", F.map_filter("metadata", lambda _, v: v.isNotNull()))
    (out if whole else out.drop("embedding")).write.mode("append").parquet(path)


def run_artifact(df: DataFrame, parameters: dict, fidelity: dict, rows: int) -> str:
    """JSON with the run's parameters, fidelity, row count and first five rows."""
    head = [json.loads(x) for x in df.limit(5).toJSON().collect()]
    return json.dumps({"parameters": parameters, "fidelity": fidelity, "rows": rows, "sample": head}, default=str)
