"""Gold: one feature row per transaction."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymill import lineage

# Fixed value: amounts above this are high-risk.
HIGH_RISK_ABOVE = 10_000


def orphans(facts: DataFrame, dim: DataFrame) -> DataFrame:
    """Facts without a customer; a null customer_id is one."""
    return facts.join(dim.select("customer_id"), "customer_id", "left_anti").select(*facts.columns)


def denormalize(facts: DataFrame, dim: DataFrame) -> DataFrame:
    """Facts with their customers; columns of both sides keep apart as name and name_right, with one more _right as long as that name is taken."""
    taken, names = {c.lower() for c in (*facts.columns, *dim.columns)}, {}
    for c in dim.columns:
        if c != "customer_id" and c.lower() in {f.lower() for f in facts.columns}:
            names[c] = f"{c}_right"
            while names[c].lower() in taken:
                names[c] += "_right"
            taken.add(names[c].lower())
    right = dim.withColumnsRenamed(names)
    return facts.join(right, "customer_id").select(*facts.columns, *[c for c in right.columns if c != "customer_id"])


def temporal(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    """Calendar features; weekdays are ISO, Monday 1 to Sunday 7. A missing time column counts as now."""
    t = F.col(ts) if ts in df.columns else F.current_timestamp()
    return df.withColumns({
        "partition_date": F.date_format(t, "yyyy-MM-dd"),
        "day_of_month": F.dayofmonth(t).cast("long"),
        "day_of_week": (F.weekday(t) + 1).cast("long"),
        "hour_of_day": F.hour(t).cast("long"),
    })


def high_risk(df: DataFrame, amount: str = "amount", above: float = HIGH_RISK_ABOVE) -> DataFrame:
    return df.withColumn("high_risk_amount", (F.col(amount) > above).cast("long"))


def exact_sum(c: Column) -> Column:
    """Of money: the same whatever the order of the rows."""
    return F.sum(c.cast("decimal(18,2)")).cast("double")


def customer_stats(df: DataFrame, key: str = "customer_id", amount: str = "amount", null_keys: bool = True) -> DataFrame:
    """count, velocity, mean and lifetime value per customer, joined back.

    Aggregated before the shuffle and joined, not a window: a customer with a
    third of all rows is split by the adaptive join and never one task's.
    Where no key is null (``null_keys=False``) the aggregate's partitioning
    serves the join as well.
    """
    n = F.count(F.lit(1))
    stats = df.groupBy(F.col(key).alias("__key")).agg(
        n.alias("transaction_count"),
        n.cast("double").alias("transaction_velocity"),
        (exact_sum(F.col(amount)) / F.count(amount)).alias("mean_transaction_amount"),
        F.coalesce(exact_sum(F.col(amount)), F.lit(0.0)).alias("clv"),
    )
    same = F.col(key).eqNullSafe(F.col("__key")) if null_keys else F.col(key) == F.col("__key")
    return df.join(stats, same).drop("__key")


def zscore_global(df: DataFrame, amount: str = "amount", out: str = "z_score_deviation", over: DataFrame | None = None) -> DataFrame:
    """By the mean and sample deviation of all rows (of ``over`` if given); 0 where there is none. The joined side is one row."""
    one = (df if over is None else over).agg(F.avg(amount).alias("__mean"), F.stddev_samp(amount).alias("__std"))
    z = F.when(F.col("__std") > 0, (F.col(amount) - F.col("__mean")) / F.col("__std")).otherwise(F.lit(0.0))
    return df.crossJoin(F.broadcast(one)).withColumn(out, z).drop("__mean", "__std")


def features(facts: DataFrame, dim: DataFrame) -> DataFrame:
    """Statistics and global moments both come from the joined facts, not from each other's plans."""
    joined = temporal(denormalize(facts, dim))
    return zscore_global(high_risk(customer_stats(joined, null_keys=False)), over=joined)


def write(features_: DataFrame, orphans_: DataFrame, path: str, version: str = "1.0", facts: DataFrame | None = None, dim: DataFrame | None = None) -> None:
    """Features and orphans by day, and a one-line manifest of this write: rows in and out, the time and the columns' types.

    The days that are written replace themselves, and other days stay, so a day
    can be run again. Orphans without a time are a day of their own. A day that
    has no rows any more stays as it was.
    """
    root = f"{path}/v{version.removeprefix('v')}"
    seen = {}
    for name, df in (("features", features_), ("orphans", orphans_ if "partition_date" in orphans_.columns else temporal(orphans_).select(*orphans_.columns, "partition_date"))):
        counted, seen[name] = lineage.counted(df, name)
        counted.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("partition_date").parquet(f"{root}/{name}")
    rows = {"output_rows": seen["features"].get["rows"], "orphan_rows": seen["orphans"].get["rows"]}
    rows |= {name: None if df is None else df.count() for name, df in (("input_rows_fact", facts), ("input_rows_dim", dim))}
    about = {"version": F.lit(version), "timestamp": F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX"), "schema": F.lit(json.dumps(dict(features_.dtypes)))}
    about |= {"rows": F.col("output_rows"), "orphans": F.col("orphan_rows")}
    one = features_.sparkSession.range(1).select(*[F.lit(n).cast("long").alias(name) for name, n in rows.items()])
    one.withColumns(about).coalesce(1).write.mode("overwrite").option("ignoreNullFields", "false").json(f"{root}/manifest")
