"""Silver: standardise, deduplicate, resolve, validate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymill import rules
from tallymill.functions.text import strip_all
from tallymill.operators.latest import keep_latest
from tallymill.session import materialize

# The version of the resolution logic and the threshold of fuzzy name matches.
ER_LOGIC_VERSION = "v1.0"
FUZZY_THRESHOLD = 0.85


def utc_time(text: Column) -> Column:
    """A string's time in UTC; null where it is none."""
    local = F.convert_timezone(F.current_timezone(), F.lit("UTC"), text.try_cast("timestamp").cast("timestamp_ntz"))
    return F.when(text.rlike(r":\d{2}(\.\d+)?\s*(Z|UTC|GMT|[+-]\d{1,2}(:?\d{2})?)\s*$"), local).otherwise(text.try_cast("timestamp_ntz"))


def standardize(df: DataFrame) -> DataFrame:
    """email lower, name upper, both stripped; currency upper, USD where null; amount and timestamp typed, null where they can't be.

    A time with an offset or Z is turned into UTC, one without is taken as UTC, whatever the session's zone.
    """
    made = {}
    if "email" in df.columns:
        made["email"] = strip_all(F.lower("email"))
    if "customer_name" in df.columns:
        made["customer_name"] = strip_all(F.upper("customer_name"))
    if "currency" in df.columns:
        made["currency"] = F.coalesce(F.upper("currency"), F.lit("USD"))
    types = dict(df.dtypes)
    if types.get("amount", "double") != "double":
        made["amount"] = F.expr("try_cast(amount AS double)")
    if types.get("timestamp") == "string":
        made["timestamp"] = utc_time(F.col("timestamp"))
    return df.withColumns(made)


def event_key(tax_id: Column, ts: Column, amount: Column) -> Column:
    """tax_id, time to the second and amount with two decimals; null if any is."""
    return F.sha2(F.concat(tax_id, F.lit("|"), F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), F.lit("|"), amount.cast("decimal(18,2)").cast("string")), 256)


def golden_id(name: Column, email: Column, tax_id: Column) -> Column:
    """Null if any part is."""
    return F.sha2(F.concat(name, F.lit("_"), email, F.lit("_"), tax_id), 256)


def transaction_facts(df: DataFrame, tiebreak: list[str] | None = None, null_keys: str = "keep", nulls_first: bool = False) -> DataFrame:
    """Facts at the grain of transaction_id where there is one, else of the event key."""
    if "transaction_id" in df.columns:
        return keep_latest(df, ["transaction_id"], "timestamp", tiebreak, nulls_first, null_keys)
    hashed = df.withColumn("event_hash", event_key(F.col("tax_id"), F.col("timestamp"), F.col("amount")))
    return keep_latest(hashed, ["event_hash"], "timestamp", tiebreak, nulls_first, null_keys)


def customer_dimension(df: DataFrame, tiebreak: list[str] | None = None, null_keys: str = "keep", nulls_first: bool = False) -> DataFrame:
    """The latest row per (tax_id, email), with its golden record id."""
    dim = keep_latest(df, ["tax_id", "email"], "timestamp", tiebreak, nulls_first, null_keys)
    return dim.withColumn("golden_record_id", golden_id(F.col("customer_name"), F.col("email"), F.col("tax_id")))


def attach_golden_id(facts: DataFrame, dim: DataFrame) -> DataFrame:
    """Facts with the dimension's golden id; no fan-out, null keys get null; left as it is where the facts have one."""
    if "golden_record_id" in facts.columns:
        return facts
    keys = dim.filter(F.col("tax_id").isNotNull() & F.col("email").isNotNull()).select("tax_id", "email", "golden_record_id")
    return facts.join(keys, ["tax_id", "email"], "left").select(*facts.columns, "golden_record_id")


def split_fact_dimension(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    dim = customer_dimension(df)
    return attach_golden_id(transaction_facts(df), dim), dim


def quarantine(bad: DataFrame, partition_key: str | None, suite: str = "default", run_id: str = "", at: str | None = None) -> DataFrame:
    stamp = F.lit(at) if at else F.date_format(F.current_timestamp(), "yyyyMMdd_HHmmss")
    return bad.withColumns({"quarantine_timestamp": stamp, "partition_key": F.lit(f"{partition_key}_transactions"), "failed_expectation_suite": F.lit(suite), "validation_run_id": F.lit(run_id)})


def write_quarantine(bad: DataFrame, path: str) -> None:
    bad.write.mode("append").partitionBy("partition_key").parquet(path)


def drift_report(bronze: DataFrame, facts: DataFrame, dim: DataFrame, partition_key: str | None = None, at: str | None = None) -> DataFrame:
    """One row: counts before and after, attrition, null tax ids. Three one-row aggregates, joined as such."""

    def counts(df, n, nulls):
        return df.agg(F.count(F.lit(1)).cast("int").alias(n), F.count_if(F.col("tax_id").isNull()).cast("int").alias(nulls))

    one = counts(bronze, "bronze_row_count", "null_tax_id_before")
    one = one.crossJoin(counts(facts, "transaction_fact_count", "null_tax_id_after_fact")).crossJoin(counts(dim, "customer_dimension_count", "null_tax_id_after_dim"))
    lost = F.col("bronze_row_count") - F.col("transaction_fact_count")
    return one.select(
        (F.lit(at) if at else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")).alias("timestamp"),
        F.lit(ER_LOGIC_VERSION).alias("er_logic_version"),
        F.lit(partition_key or "full").alias("partition_key"),
        "bronze_row_count",
        "transaction_fact_count",
        "customer_dimension_count",
        F.when(F.col("bronze_row_count") > 0, lost / F.col("bronze_row_count")).otherwise(F.lit(0.0)).alias("fact_attrition_rate"),
        "null_tax_id_before",
        "null_tax_id_after_fact",
        "null_tax_id_after_dim",
    )


def write(tables: dict[str, DataFrame], root: str, partition_key: str) -> None:
    """Facts and dimension of a partition replace what is there; quarantine and drift are appended."""
    for name in ("facts", "dimension"):
        tables[name].write.mode("overwrite").parquet(f"{root}/{name}/{partition_key}")
    write_quarantine(tables["quarantine"], f"{root}/quarantine")
    append_drift(tables["drift"], f"{root}/drift")


def append_drift(report: DataFrame, path: str) -> None:
    """Columns may be new or missing: ``drift_history`` reads what any report has."""
    report.write.mode("append").parquet(path)


def drift_history(spark: SparkSession, path: str) -> DataFrame:
    """All reports, with the columns of each; null where a report lacks one."""
    return spark.read.option("mergeSchema", "true").parquet(path)


# The share of a run's rows, and the rows of a day, above which quarantine raises an alert.
RUN_SHARE, DAY_ROWS = 0.05, 1000


def quarantine_alerts(held: DataFrame, runs: DataFrame, share: float = RUN_SHARE, rows: int = DAY_ROWS) -> DataFrame:
    """(kind, name, held, checked, alert): quarantine by run against the rows it checked, and by day of its timestamp.

    ``runs``: (validation_run_id, checked), summed where a run stands several
    times; runs without held rows are told too, as are held rows of runs that
    ``runs`` lacks, whose ``checked`` is null and which alert.
    """
    checked = runs.groupBy("validation_run_id").agg(F.sum("checked").alias("checked"))
    by_run = held.groupBy("validation_run_id").agg(F.count(F.lit(1)).alias("held")).join(checked, "validation_run_id", "full")
    by_run = by_run.select(F.lit("run").alias("kind"), F.col("validation_run_id").alias("name"), F.coalesce("held", F.lit(0)).cast("long").alias("held"), "checked")
    by_run = by_run.withColumn("alert", F.when(F.coalesce("checked", F.lit(0)) > 0, F.col("held") / F.col("checked") > share).otherwise(F.col("held") > 0))
    by_day = held.groupBy(F.substring("quarantine_timestamp", 1, 8).alias("name")).agg(F.count(F.lit(1)).alias("held"))
    return by_run.unionByName(by_day.select(F.lit("day").alias("kind"), "name", "held", F.lit(None).cast("long").alias("checked"), (F.col("held") > rows).alias("alert")))


def build(bronze: DataFrame, partition_key: str | None = None, suite: Sequence[rules.Rule] = rules.DEFAULT_SUITE, run_id: str = "") -> dict[str, DataFrame]:
    """All of Silver from one Bronze partition: facts, dimension, quarantine, drift.

    The standardized rows, the dimension and the facts are written to the shared
    folder first, since each of the four tables reads them.
    """
    clean = materialize(standardize(bronze), "standardized")
    dim = materialize(customer_dimension(clean), "dimension")
    facts = materialize(attach_golden_id(transaction_facts(clean), dim), "facts")
    good, bad = rules.split(facts, suite)
    good_dim, bad_dim = rules.split(dim, suite)
    held = quarantine(bad, partition_key, run_id=run_id).unionByName(quarantine(bad_dim, partition_key, run_id=run_id), allowMissingColumns=True)
    return {"facts": good, "dimension": good_dim, "quarantine": held, "drift": drift_report(clean, good, good_dim, partition_key)}
