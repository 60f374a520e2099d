"""Column contracts of the layers."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _D, _TS, _B, _L, _I = T.StringType(), T.DoubleType(), T.TimestampNTZType(), T.BooleanType(), T.LongType(), T.IntegerType()


def _schema(*fields) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


BRONZE_BASE = _schema(("customer_id", _S), ("customer_name", _S), ("email", _S), ("tax_id", _S), ("currency", _S), ("amount", _D), ("timestamp", _S))
BRONZE_META = _schema(("source_table", _S), ("ingestion_date", _S), ("source_type", _S), ("synthetic_flag", _B))
BRONZE = T.StructType(BRONZE_BASE.fields + BRONZE_META.fields)
SILVER = T.StructType([T.StructField(f.name, _TS if f.name == "timestamp" else f.dataType, True) for f in BRONZE.fields] + _schema(("golden_record_id", _S)).fields)
GOLD_FEATURES = _schema(
    ("partition_date", _S), ("day_of_month", _L), ("day_of_week", _L), ("hour_of_day", _L), ("transaction_count", _L), ("transaction_velocity", _D),
    ("mean_transaction_amount", _D), ("clv", _D), ("high_risk_amount", _L), ("z_score_deviation", _D),
)
DRIFT = _schema(
    ("timestamp", _S), ("er_logic_version", _S), ("partition_key", _S), ("bronze_row_count", _I), ("transaction_fact_count", _I), ("customer_dimension_count", _I),
    ("fact_attrition_rate", _D), ("null_tax_id_before", _I), ("null_tax_id_after_fact", _I), ("null_tax_id_after_dim", _I),
)
CHUNK = T.StructType([
    T.StructField("content", _S),
    T.StructField("metadata", _schema(("source_origin", _S), ("page_number", _I), ("document_version", _S), ("retention_policy_id", _S), ("sensitivity_label", _S), ("metadata_hash", _S))),
])
CORPUS_FILE = T.StructType([T.StructField("documents", T.ArrayType(_schema(("id", _S), ("document", _S), ("metadata", T.MapType(_S, _S)))))])


def missing_or_mistyped(have: T.StructType, want: T.StructType) -> list[str]:
    """Names in ``want`` that ``have`` lacks or holds with another type; further columns are allowed."""
    types = {f.name: f.dataType for f in have.fields}
    return [f.name for f in want.fields if types.get(f.name) != f.dataType]
