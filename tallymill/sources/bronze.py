"""Bronze: conform, append without rewriting, read a partition."""

from __future__ import annotations

import json
import uuid
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallymill import lineage, schemas

# Where the columns of generated batches go. Ids keep their meaning: a transaction id is no customer id.
SYNTHETIC_COLUMNS = {"sender_id": "customer_id", "transaction_amount": "amount"}


def conform(df: DataFrame, mapping: dict[str, str] | None = None, source_table: str = "", source_type: str = "batch", synthetic: bool = False, ingested: str | None = None) -> DataFrame:
    """Rename, add missing base columns as typed nulls and the four metadata columns; further columns pass."""
    df = df.withColumnsRenamed({k: v for k, v in (mapping or {}).items() if k in df.columns})
    have = {f.name: f.dataType for f in df.schema.fields}
    made = {f.name: F.lit(None).cast(f.dataType) for f in schemas.BRONZE_BASE.fields if f.name not in have}
    made |= {f.name: F.col(f.name).cast(f.dataType) for f in schemas.BRONZE_BASE.fields if f.name in have and have[f.name] != f.dataType}
    made |= {"source_table": F.lit(source_table), "ingestion_date": F.lit(ingested or datetime.now(UTC).isoformat()), "source_type": F.lit(source_type), "synthetic_flag": F.lit(synthetic)}
    return df.withColumns(made)


def today() -> str:
    return datetime.now(UTC).strftime("%Y-%m-%d")


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def append(df: DataFrame, root: str, partition_key: str | None = None) -> dict:
    """Write new files into a partition and return the sidecar's content; the row count comes with the write."""
    key, run = partition_key or today(), uuid.uuid4().hex
    seen_df, seen = lineage.counted(df, "bronze")
    seen_df.write.mode("append").parquet(f"{root}/transactions/{key}")
    about = {"layer": "bronze", "run_id": run, "partition_key": key, "row_count": seen.get["rows"], "schema": json.loads(df.schema.json()), "path": f"{root}/transactions/{key}", "immutable": True}
    df.sparkSession.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.mode("overwrite").text(f"{root}/metadata/{run}")
    return about


def read_partition(spark: SparkSession, root: str, partition_key: str, schema: StructType = schemas.BRONZE) -> DataFrame:
    """All files of a partition; unreadable ones are passed over, a missing partition is empty with the schema."""
    path = f"{root}/transactions/{partition_key}"
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("ignoreCorruptFiles", "true").parquet(path)


def ingest_once(df: DataFrame, root: str, partition_key: str) -> dict | None:
    """Append unless the partition has rows already."""
    if not read_partition(df.sparkSession, root, partition_key).isEmpty():
        return None
    return append(df, root, partition_key)
