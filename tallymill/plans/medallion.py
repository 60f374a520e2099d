"""Bronze, Silver, Gold and privacy queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tallymill import rules
from tallymill.operators import features, gold, privacy, resolve, silver
from tallymill.operators.latest import keep_latest
from tallymill.plans.registry import query
from tallymill.session import read_table, shared_dir
from tallymill.sources import bronze, external


def facts(spark, sf_dir):
    return read_table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("transaction_id"), F.col("o_custkey").alias("customer_id"), F.col("o_totalprice").alias("amount"), F.col("o_orderdate").alias("timestamp")
    )


def customers(spark, sf_dir):
    return read_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("customer_id"), F.col("c_name").alias("customer_name"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance"))


def people(spark, sf_dir):
    """Customers as Silver sees them: e-mails, tax ids (one in ten is missing), amounts (some negative)."""
    c = read_table(spark, sf_dir, "customer")
    return c.select(
        F.col("c_custkey").cast("string").alias("customer_id"),
        F.concat(F.lit("  "), F.col("c_name"), F.lit("\t")).alias("customer_name"),
        F.concat(F.lit(" C"), F.col("c_custkey"), F.lit("@Example.COM\n")).alias("email"),
        F.when(F.col("c_custkey") % 10 != 0, F.concat(F.lit("TAX"), F.col("c_custkey"))).alias("tax_id"),
        F.when(F.col("c_custkey") % 3 != 0, F.when(F.col("c_custkey") % 2 == 0, "kes").otherwise("KES")).alias("currency"),
        F.concat(F.lit("2024-01-01T03:00:0"), F.col("c_custkey") % 10, F.element_at(F.array(*map(F.lit, ("", "Z", "+03:00", "-05:30"))), (F.col("c_custkey") % 4 + 1).cast("int"))).alias("timestamp"),
        F.col("c_acctbal").alias("amount"),
    )


PEOPLE = r"""p AS (SELECT c_custkey::VARCHAR AS customer_id, '  ' || c_name || chr(9) AS customer_name, ' C' || c_custkey || '@Example.COM' || chr(10) AS email,
  CASE WHEN c_custkey % 10 <> 0 THEN 'TAX' || c_custkey END AS tax_id, CASE WHEN c_custkey % 3 <> 0 THEN CASE WHEN c_custkey % 2 = 0 THEN 'kes' ELSE 'KES' END END AS currency, c_acctbal AS amount,
  TIMESTAMP '2024-01-01 03:00:00' + to_seconds(c_custkey % 10) - to_minutes(([0, 0, 180, -330])[c_custkey % 4 + 1]) AS "timestamp" FROM customer),
s AS (SELECT customer_id, regexp_replace(upper(customer_name), '^\s+|\s+$', '', 'g') AS customer_name, regexp_replace(lower(email), '^\s+|\s+$', '', 'g') AS email,
  tax_id, coalesce(upper(currency), 'USD') AS currency, amount, "timestamp" FROM p)"""


def dated_people(spark, sf_dir):
    """Each user's events as sightings of one customer, at day grain so that there are ties and repeats."""
    e = read_table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").cast("string").alias("customer_id"),
        F.concat(F.lit("user "), F.col("user_id")).alias("customer_name"),
        F.concat(F.lit("u"), F.col("user_id"), F.lit("@example.com")).alias("email"),
        F.when(F.col("user_id") % 10 != 0, F.concat(F.lit("TAX"), F.col("user_id"))).alias("tax_id"),
        F.col("value").alias("amount"),
        F.date_trunc("day", "ts").cast("timestamp_ntz").alias("timestamp"),
        F.col("event_id"),
    )


DATED = """d AS (SELECT event_id::VARCHAR AS customer_id, 'user ' || user_id AS customer_name, 'u' || user_id || '@example.com' AS email,
  CASE WHEN user_id % 10 <> 0 THEN 'TAX' || user_id END AS tax_id, value AS amount, date_trunc('day', ts)::TIMESTAMP AS "timestamp", event_id FROM events)"""


@query(
    "gold_features",
    """WITH f AS (SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate, c_name, c_mktsegment, c_acctbal FROM orders JOIN customer ON o_custkey = c_custkey),
    g AS (SELECT avg(o_totalprice) AS m, stddev_samp(o_totalprice) AS s FROM f),
    c AS (SELECT o_custkey AS k, count(*) AS n, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS total FROM f GROUP BY 1)
    SELECT o_orderkey AS transaction_id, o_custkey AS customer_id, o_totalprice AS amount, o_orderdate AS "timestamp", c_name AS customer_name, c_mktsegment AS segment, c_acctbal AS balance,
    strftime(o_orderdate, '%Y-%m-%d') AS partition_date, day(o_orderdate)::BIGINT AS day_of_month, isodow(o_orderdate)::BIGINT AS day_of_week, hour(o_orderdate)::BIGINT AS hour_of_day,
    n AS transaction_count, n::DOUBLE AS transaction_velocity, round(total / n, 6) AS mean_transaction_amount, total AS clv, (o_totalprice > 10000)::BIGINT AS high_risk_amount,
    round(CASE WHEN s > 0 THEN (o_totalprice - m) / s ELSE 0.0 END, 6) AS z_score_deviation FROM f JOIN c ON k = o_custkey, g""",
)
def gold_features(spark, sf_dir):
    out = gold.features(facts(spark, sf_dir), customers(spark, sf_dir))
    return out.withColumns({c: F.round(c, 6) for c in ("mean_transaction_amount", "z_score_deviation")})


@query("gold_temporal", """SELECT o_orderkey AS transaction_id, strftime(o_orderdate, '%Y-%m-%d') AS partition_date, day(o_orderdate)::BIGINT AS day_of_month, isodow(o_orderdate)::BIGINT AS day_of_week, hour(o_orderdate)::BIGINT AS hour_of_day FROM orders""")
def gold_temporal(spark, sf_dir):
    return gold.temporal(facts(spark, sf_dir)).select("transaction_id", "partition_date", "day_of_month", "day_of_week", "hour_of_day")


@query("gold_high_risk", "SELECT o_orderkey AS transaction_id, (o_totalprice > 10000)::BIGINT AS high_risk_amount FROM orders")
def gold_high_risk(spark, sf_dir):
    return gold.high_risk(facts(spark, sf_dir)).select("transaction_id", "high_risk_amount")


@query("gold_zscore_global", "WITH g AS (SELECT avg(o_totalprice) AS m, stddev_samp(o_totalprice) AS s FROM orders) SELECT o_orderkey AS transaction_id, round(CASE WHEN s > 0 THEN (o_totalprice - m) / s ELSE 0.0 END, 6) AS z_score_deviation FROM orders, g")
def gold_zscore_global(spark, sf_dir):
    return gold.zscore_global(facts(spark, sf_dir)).select("transaction_id", F.round("z_score_deviation", 6).alias("z_score_deviation"))


@query("gold_orphans", 'SELECT o_orderkey AS transaction_id, o_custkey AS customer_id, o_totalprice AS amount, o_orderdate AS "timestamp" FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal >= 0)')
def gold_orphans(spark, sf_dir):
    return gold.orphans(facts(spark, sf_dir), customers(spark, sf_dir).filter(F.col("balance") >= 0))


@query("gold_denormalize", 'SELECT o_orderkey AS transaction_id, o_custkey AS customer_id, o_totalprice AS amount, o_orderdate AS "timestamp", c_name AS customer_name, c_mktsegment AS segment, c_acctbal AS balance FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal >= 0')
def gold_denormalize(spark, sf_dir):
    return gold.denormalize(facts(spark, sf_dir), customers(spark, sf_dir).filter(F.col("balance") >= 0))


@query(
    "bronze_conform",
    """SELECT o_orderkey AS transaction_id, o_custkey::VARCHAR AS customer_id, NULL::VARCHAR AS customer_name, NULL::VARCHAR AS email, NULL::VARCHAR AS tax_id, NULL::VARCHAR AS currency, o_totalprice AS amount,
    strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS "timestamp", 'orders' AS source_table, '2024-01-01' AS ingestion_date, 'batch' AS source_type, false AS synthetic_flag FROM orders""",
)
def bronze_conform(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    names = {"o_orderkey": "transaction_id", "o_custkey": "customer_id", "o_totalprice": "amount", "o_orderdate": "timestamp"}
    return bronze.conform(o, names, "orders", "batch", False, "2024-01-01")


@query("bronze_read_partition", "SELECT event_id, user_id, event_type, value, ts FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-07'")
def bronze_read_partition(spark, sf_dir):
    """Days are appended as partitions of their own, one of them twice with the guard on; two are read back."""
    e = read_table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", "ts")
    root = f"{shared_dir(spark)}/bronze-{uuid.uuid4().hex}"
    for day in ("2024-01-04", "2024-01-05", "2024-01-06", "2024-01-05"):
        bronze.ingest_once(e.filter(F.to_date("ts") == F.lit(day).cast("date")), root, day)
    return bronze.read_partition(spark, root, "2024-01-05", e.schema).unionByName(bronze.read_partition(spark, root, "2024-01-06", e.schema))


@query("source_range_scan", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-12-31'")
def source_range_scan(spark, sf_dir):
    low, high = F.lit("1996-01-01").cast("timestamp_ntz"), F.lit("1996-12-31").cast("timestamp_ntz")
    return external.between(read_table(spark, sf_dir, "orders"), "o_orderdate", low, high).select("o_orderkey", "o_totalprice")


@query("silver_standardize", f"WITH {PEOPLE} SELECT * FROM s")
def silver_standardize(spark, sf_dir):
    return silver.standardize(people(spark, sf_dir))


@query(
    "silver_dedup_event_hash",
    f"""WITH {DATED}, u AS (SELECT * FROM d UNION ALL SELECT * REPLACE (event_id + 1000000 AS event_id) FROM d WHERE event_id % 3 = 0),
    h AS (SELECT *, sha256(tax_id || '|' || strftime("timestamp", '%Y-%m-%d %H:%M:%S') || '|' || amount::DECIMAL(18,2)::VARCHAR) AS event_hash FROM u),
    r AS (SELECT *, row_number() OVER (PARTITION BY event_hash ORDER BY "timestamp" DESC, event_id DESC) AS n FROM h)
    SELECT event_hash, event_id, tax_id, amount FROM r WHERE n = 1 OR event_hash IS NULL""",
)
def silver_dedup_event_hash(spark, sf_dir):
    d = dated_people(spark, sf_dir)
    again = d.filter(F.col("event_id") % 3 == 0).withColumn("event_id", F.col("event_id") + 1_000_000)
    return silver.transaction_facts(d.unionByName(again), ["event_id"]).select("event_hash", "event_id", "tax_id", "amount")


@query(
    "silver_dedup_txn_id",
    """WITH u AS (SELECT o_orderkey AS transaction_id, o_totalprice AS amount, o_orderdate AS ts FROM orders
      UNION ALL SELECT o_orderkey, o_totalprice + 1, o_orderdate + INTERVAL 1 DAY FROM orders WHERE o_orderkey % 4 = 0)
    SELECT transaction_id, amount, ts AS "timestamp" FROM (SELECT *, row_number() OVER (PARTITION BY transaction_id ORDER BY ts DESC) AS n FROM u) WHERE n = 1""",
)
def silver_dedup_txn_id(spark, sf_dir):
    f = facts(spark, sf_dir).select("transaction_id", "amount", "timestamp")
    later = f.filter(F.col("transaction_id") % 4 == 0).select("transaction_id", (F.col("amount") + 1).alias("amount"), F.expr("timestampadd(DAY, 1, timestamp)").alias("timestamp"))
    return silver.transaction_facts(f.unionByName(later))


@query(
    "silver_customer_dim",
    f"""WITH {DATED}, r AS (SELECT *, row_number() OVER (PARTITION BY tax_id, email ORDER BY "timestamp" DESC, event_id DESC) AS n FROM d)
    SELECT customer_id, customer_name, email, tax_id, amount, sha256(customer_name || '_' || email || '_' || tax_id) AS golden_record_id FROM r WHERE n = 1 OR tax_id IS NULL""",
)
def silver_customer_dim(spark, sf_dir):
    return silver.customer_dimension(dated_people(spark, sf_dir), ["event_id"]).select("customer_id", "customer_name", "email", "tax_id", "amount", "golden_record_id")


@query("silver_golden_id", f"WITH {PEOPLE} SELECT customer_id, sha256(customer_name || '_' || email || '_' || tax_id) AS golden_record_id FROM s")
def silver_golden_id(spark, sf_dir):
    s = silver.standardize(people(spark, sf_dir))
    return s.select("customer_id", silver.golden_id(F.col("customer_name"), F.col("email"), F.col("tax_id")).alias("golden_record_id"))


@query(
    "silver_fact_golden_join",
    f"""WITH {DATED}, r AS (SELECT *, row_number() OVER (PARTITION BY tax_id, email ORDER BY "timestamp" DESC, event_id DESC) AS n FROM d WHERE tax_id IS NOT NULL),
    m AS (SELECT tax_id, email, sha256(customer_name || '_' || email || '_' || tax_id) AS golden_record_id FROM r WHERE n = 1)
    SELECT d.event_id, d.tax_id, m.golden_record_id FROM d LEFT JOIN m ON d.tax_id = m.tax_id AND d.email = m.email""",
)
def silver_fact_golden_join(spark, sf_dir):
    d = dated_people(spark, sf_dir)
    return silver.attach_golden_id(d, silver.customer_dimension(d, ["event_id"])).select("event_id", "tax_id", "golden_record_id")


@query(
    "silver_quality_split",
    f"""WITH {PEOPLE} SELECT customer_id, coalesce(array_to_string(list_filter([CASE WHEN customer_id IS NULL THEN 'customer_id_not_null' END, CASE WHEN tax_id IS NULL THEN 'tax_id_not_null' END, CASE WHEN amount < 0 THEN 'amount_at_least' END], lambda x: x IS NOT NULL), ','), '') AS violations FROM s""",
)
def silver_quality_split(spark, sf_dir):
    good, bad = rules.split(silver.standardize(people(spark, sf_dir)))
    return good.select("customer_id", F.lit("").alias("violations")).unionByName(bad.select("customer_id", F.array_join("violations", ",").alias("violations")))


@query("silver_quality_report", f"WITH {PEOPLE} SELECT 'customer_id_not_null' AS rule, count_if(customer_id IS NULL)::BIGINT AS failed, count(*) AS checked FROM s UNION ALL SELECT 'tax_id_not_null', count_if(tax_id IS NULL)::BIGINT, count(*) FROM s UNION ALL SELECT 'amount_at_least', count_if(amount < 0)::BIGINT, count(*) FROM s")
def silver_quality_report(spark, sf_dir):
    return rules.report(silver.standardize(people(spark, sf_dir)))


@query("silver_quarantine_fact", f"WITH {PEOPLE} SELECT customer_id, amount, '20240101_000000' AS quarantine_timestamp, '2024-01-01_transactions' AS partition_key, 'default' AS failed_expectation_suite, 'run' AS validation_run_id FROM s WHERE tax_id IS NULL OR amount < 0")
def silver_quarantine_fact(spark, sf_dir):
    _, bad = rules.split(silver.standardize(people(spark, sf_dir)))
    held = silver.quarantine(bad, "2024-01-01", run_id="run", at="20240101_000000")
    return held.select("customer_id", "amount", "quarantine_timestamp", "partition_key", "failed_expectation_suite", "validation_run_id")


@query(
    "silver_drift_report",
    f"""WITH {PEOPLE}, g AS (SELECT * FROM s WHERE tax_id IS NOT NULL AND amount >= 0)
    SELECT '2024-01-01' AS "timestamp", 'v1.0' AS er_logic_version, 'full' AS partition_key, (SELECT count(*) FROM s)::INTEGER AS bronze_row_count, (SELECT count(*) FROM g)::INTEGER AS transaction_fact_count, (SELECT count(*) FROM g)::INTEGER AS customer_dimension_count,
    round(((SELECT count(*) FROM s) - (SELECT count(*) FROM g)) / (SELECT count(*) FROM s), 9) AS fact_attrition_rate, (SELECT count(*) FROM s WHERE tax_id IS NULL)::INTEGER AS null_tax_id_before, 0 AS null_tax_id_after_fact, 0 AS null_tax_id_after_dim""",
)
def silver_drift_report(spark, sf_dir):
    s = silver.standardize(people(spark, sf_dir))
    good, _ = rules.split(s)
    return silver.drift_report(s, good, good, at="2024-01-01").withColumn("fact_attrition_rate", F.round("fact_attrition_rate", 9))


@query(
    "pipeline_retention",
    """WITH n AS (SELECT count(*) AS bronze, count_if(o_totalprice >= 0) AS silver, count_if(o_totalprice >= 0 AND EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal >= 0)) AS gold FROM orders)
    SELECT 'silver' AS stage, round(silver / bronze, 6) AS retention, silver / bronze >= 0.95 AS ok FROM n UNION ALL SELECT 'gold', round(gold / silver, 6), gold / silver >= 0.95 FROM n""",
)
def pipeline_retention(spark, sf_dir):
    f, d = facts(spark, sf_dir), customers(spark, sf_dir).filter(F.col("balance") >= 0)
    good, _ = rules.split(f, (rules.at_least("amount", 0),))
    count = lambda df, n: df.agg(F.count(F.lit(1)).alias(n))
    one = count(f, "bronze").crossJoin(count(good, "silver")).crossJoin(count(gold.denormalize(good, d), "gold"))
    stages = F.array(F.struct(F.lit("silver").alias("stage"), F.try_divide("silver", "bronze").alias("r")), F.struct(F.lit("gold").alias("stage"), F.try_divide("gold", "silver").alias("r")))
    return one.select(F.inline(stages)).select("stage", F.round("r", 6).alias("retention"), (F.col("r") >= 0.95).alias("ok"))


@query("feature_rule_check", "SELECT 'high_risk_amount_in_set' AS rule, 0::BIGINT AS failed, count(*) AS checked FROM orders UNION ALL SELECT 'transaction_velocity_not_null', count_if(o_orderkey % 7 = 0)::BIGINT, count(*) FROM orders")
def feature_rule_check(spark, sf_dir):
    f = gold.high_risk(facts(spark, sf_dir)).withColumn("transaction_velocity", F.when(F.col("transaction_id") % 7 != 0, F.lit(1.0)))
    return rules.report(f, rules.FEATURE_SUITE)


def activity(spark, sf_dir):
    return read_table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("customer_id"), F.when(F.col("event_id") % 11 != 0, F.col("value")).alias("amount"), F.col("ts").alias("timestamp"))


ACTIVITY = "a AS (SELECT event_id, user_id AS customer_id, CASE WHEN event_id % 11 <> 0 THEN value END AS amount, ts FROM events)"


@query("fe_rolling_velocity", f"WITH {ACTIVITY} SELECT event_id, sum(amount::DECIMAL(18,2)) OVER (PARTITION BY customer_id ORDER BY ts, event_id ROWS 2 PRECEDING)::DOUBLE AS velocity_rolling3 FROM a")
def fe_rolling_velocity(spark, sf_dir):
    return features.rolling_velocity(activity(spark, sf_dir), tiebreak="event_id").select("event_id", "velocity_rolling3")


@query("fe_cumulative_clv", f"WITH {ACTIVITY} SELECT event_id, CASE WHEN amount IS NOT NULL THEN sum(amount::DECIMAL(18,2)) OVER (PARTITION BY customer_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::DOUBLE END AS clv_cumulative FROM a")
def fe_cumulative_clv(spark, sf_dir):
    return features.cumulative_clv(activity(spark, sf_dir), tiebreak="event_id").select("event_id", "clv_cumulative")


@query("fe_customer_stats", f"WITH {ACTIVITY} SELECT event_id, round((sum(amount::DECIMAL(18,2)) OVER w)::DOUBLE / count(amount) OVER w, 6) AS mean_amount, round(stddev_samp(amount) OVER w, 6) AS std_amount FROM a WINDOW w AS (PARTITION BY customer_id)")
def fe_customer_stats(spark, sf_dir):
    return features.customer_zscore(activity(spark, sf_dir)).select("event_id", F.round("mean_amount", 6).alias("mean_amount"), F.round("std_amount", 6).alias("std_amount"))


@query("fe_customer_zscore", f"WITH {ACTIVITY} SELECT event_id, round(CASE WHEN stddev_samp(amount) OVER w > 0 THEN (amount - (sum(amount::DECIMAL(18,2)) OVER w)::DOUBLE / count(amount) OVER w) / stddev_samp(amount) OVER w ELSE 0.0 END, 6) AS customer_zscore FROM a WINDOW w AS (PARTITION BY customer_id)")
def fe_customer_zscore(spark, sf_dir):
    return features.customer_zscore(activity(spark, sf_dir)).select("event_id", F.round("customer_zscore", 6).alias("customer_zscore"))


@query(
    "ks_two_sample",
    """WITH s AS (SELECT l_extendedprice AS x, (l_returnflag = 'A')::INTEGER AS k FROM lineitem),
    g AS (SELECT x, count_if(k = 0) AS a, count_if(k = 1) AS b FROM s GROUP BY x), n AS (SELECT sum(a)::BIGINT AS n1, sum(b)::BIGINT AS n2 FROM g),
    c AS (SELECT sum(a) OVER (ORDER BY x) AS a, sum(b) OVER (ORDER BY x) AS b FROM g)
    SELECT max(n1) AS n1, max(n2) AS n2, round(max(abs(a / n1 - b / n2)), 6) AS ks_statistic FROM c, n""",
)
def ks_two_sample(spark, sf_dir):
    li = read_table(spark, sf_dir, "lineitem").select("l_extendedprice", (F.col("l_returnflag") == "A").cast("int").alias("k"))
    return privacy.ks_two_sample(li, "l_extendedprice", "k").withColumn("ks_statistic", F.round("ks_statistic", 6))


@query("dp_budget", "SELECT o_orderkey, round(CASE WHEN o_orderstatus = 'F' THEN 1.0::DOUBLE / (o_orderkey % 12 + 1) / 2 ELSE 1.0::DOUBLE / (o_orderkey % 12 + 1) END, 9) AS epsilon, 1.0::DOUBLE / ((o_orderkey + 1) * 10) AS delta FROM orders")
def dp_budget(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders")
    kind = F.when(F.col("o_orderstatus") == "F", "high_sensitivity").otherwise("standard")
    epsilon, delta = privacy.dp_budget(F.col("o_orderkey") + 1, F.col("o_orderkey") % 12 + 1, kind)
    return o.select("o_orderkey", F.round(epsilon, 9).alias("epsilon"), delta.alias("delta"))


@query("dp_clip", "SELECT c_custkey, least(greatest(c_acctbal, 0.0), 5000.0)::DOUBLE AS clipped FROM customer")
def dp_clip(spark, sf_dir):
    return read_table(spark, sf_dir, "customer").select("c_custkey", privacy.clip(F.col("c_acctbal"), 5000.0).alias("clipped"))


@query(
    "balance_constraint",
    """SELECT event_id, user_id, spent <= greatest(c_acctbal, 0) AS covered FROM (SELECT event_id, user_id, sum(value::DECIMAL(18,2)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::DOUBLE AS spent FROM events) JOIN customer ON c_custkey = user_id""",
)
def balance_constraint(spark, sf_dir):
    e = read_table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("customer_id"), F.col("value").alias("amount"), F.col("ts").alias("timestamp"))
    run = features.cumulative_clv(e, tiebreak="event_id")
    c = read_table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    return run.join(c, F.col("customer_id") == F.col("c_custkey")).select("event_id", F.col("customer_id").alias("user_id"), (F.col("clv_cumulative") <= F.greatest("c_acctbal", F.lit(0.0))).alias("covered"))


@query(
    "psi_drift",
    """WITH s AS (SELECT ((l_extendedprice > 20000)::INTEGER + (l_extendedprice > 40000)::INTEGER + (l_extendedprice > 60000)::INTEGER + (l_extendedprice > 80000)::INTEGER) AS bucket, (l_shipdate >= TIMESTAMP '1998-01-01')::INTEGER AS k FROM lineitem),
    c AS (SELECT bucket, count_if(k = 0) AS a, count_if(k = 1) AS b FROM s GROUP BY bucket), p AS (SELECT bucket, a / (sum(a) OVER ()) AS e, b / (sum(b) OVER ()) AS f FROM c)
    SELECT bucket, round(e, 6) AS expected, round(f, 6) AS actual, round((greatest(f, 1e-6) - greatest(e, 1e-6)) * ln(greatest(f, 1e-6) / greatest(e, 1e-6)), 6) AS part FROM p""",
)
def psi_drift(spark, sf_dir):
    li = read_table(spark, sf_dir, "lineitem").select("l_extendedprice", (F.col("l_shipdate") >= F.lit("1998-01-01").cast("timestamp_ntz")).cast("int").alias("k"))
    out = privacy.psi(li, "l_extendedprice", "k", [20_000.0, 40_000.0, 60_000.0, 80_000.0])
    return out.select("bucket", *[F.round(c, 6).alias(c) for c in ("expected", "actual", "part")])


@query(
    "er_jaro_winkler_pairs",
    """WITH n AS (SELECT p_brand AS blk, p_name AS n, min(p_partkey) AS id FROM part GROUP BY 1, 2)
    SELECT a.id AS left_id, b.id AS right_id, round(jaro_winkler_similarity(a.n, b.n), 6) AS similarity FROM n a JOIN n b ON a.blk = b.blk AND a.id < b.id WHERE jaro_winkler_similarity(a.n, b.n) >= 0.85""",
)
def er_jaro_winkler_pairs(spark, sf_dir):
    return resolve.similar_pairs(read_table(spark, sf_dir, "part"), "p_partkey", "p_name", F.col("p_brand"))


@query(
    "er_golden_ids",
    """WITH RECURSIVE n AS (SELECT p_brand AS blk, p_name AS n, min(p_partkey) AS id FROM part GROUP BY 1, 2),
    e AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM n a JOIN n b ON a.blk = b.blk AND a.id <> b.id WHERE jaro_winkler_similarity(a.n, b.n) >= 0.93),
    r(id, c) AS (SELECT id, id FROM n UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.id WHERE r.c < e.b),
    g AS (SELECT id, min(c) AS c FROM r GROUP BY id) SELECT p_partkey AS id, g.c AS golden_id FROM part JOIN n ON n.blk = p_brand AND n.n = p_name JOIN g ON g.id = n.id""",
)
def er_golden_ids(spark, sf_dir):
    return resolve.golden_ids(read_table(spark, sf_dir, "part"), "p_partkey", "p_name", F.col("p_brand"), 0.93)


@query(
    "psi_quantiles",
    """WITH s AS (SELECT l_extendedprice AS x, (l_shipdate >= TIMESTAMP '1998-01-01')::INTEGER AS k FROM lineitem), q AS (SELECT list_distinct(quantile_disc(x, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS edges FROM s WHERE k = 0),
    c AS (SELECT len(list_filter(edges, lambda e: x > e))::INTEGER AS bucket, count_if(k = 0) AS a, count_if(k = 1) AS b FROM s, q GROUP BY 1), p AS (SELECT bucket, a / (sum(a) OVER ()) AS e, b / (sum(b) OVER ()) AS f FROM c)
    SELECT bucket, round(e, 6) AS expected, round(f, 6) AS actual, round((f - e) * ln(f / e), 6) AS part FROM p""",
)
def psi_quantiles(spark, sf_dir):
    """Buckets of equal counts of the reference; a sketch of error 1e-7 is exact on fewer than ten million rows."""
    li = read_table(spark, sf_dir, "lineitem").select("l_extendedprice", (F.col("l_shipdate") >= F.lit("1998-01-01").cast("timestamp_ntz")).cast("int").alias("k"))
    out = privacy.psi(li, "l_extendedprice", "k", privacy.reference_edges(li, "l_extendedprice", "k", error=1e-7))
    return out.select("bucket", *[F.round(c, 6).alias(c) for c in ("expected", "actual", "part")])


@query("events_props_json", "SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events")
def events_props_json(spark, sf_dir):
    return read_table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query(
    "silver_latest_nulls_first",
    """WITH e AS (SELECT event_id, user_id, CASE WHEN event_id % 5 <> 0 THEN ts END AS ts FROM events)
    SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC NULLS FIRST, event_id DESC) AS n FROM e) WHERE n = 1""",
)
def silver_latest_nulls_first(spark, sf_dir):
    e = read_table(spark, sf_dir, "events").select("event_id", "user_id", F.when(F.col("event_id") % 5 != 0, F.col("ts")).alias("ts"))
    return keep_latest(e, ["user_id"], "ts", ["event_id"], nulls_first=True).select("user_id", "event_id")


@query("er_same_names", "SELECT p_partkey AS id, min(p_partkey) OVER (PARTITION BY p_brand, split_part(p_name, ' ', 1)) AS name_id FROM part")
def er_same_names(spark, sf_dir):
    p = read_table(spark, sf_dir, "part").select("p_partkey", "p_brand", F.split_part("p_name", F.lit(" "), F.lit(1)).alias("word"))
    return resolve.same_names(p, "p_partkey", "word", F.col("p_brand"))


@query(
    "psi_alerts",
    """WITH s AS (SELECT ((l_extendedprice > 20000)::INTEGER + (l_extendedprice > 40000)::INTEGER) AS bucket, (l_shipdate >= TIMESTAMP '1998-01-01')::INTEGER AS k FROM lineitem),
    c AS (SELECT bucket, count_if(k = 0) AS a, count_if(k = 1) AS b FROM s GROUP BY bucket), p AS (SELECT bucket, a / (sum(a) OVER ()) AS e, b / (sum(b) OVER ()) AS f FROM c),
    t AS (SELECT sum((greatest(f, 1e-6) - greatest(e, 1e-6)) * ln(greatest(f, 1e-6) / greatest(e, 1e-6))) AS x FROM p) SELECT round(x, 6) AS psi, x > 0.15 AS alert FROM t""",
)
def psi_alerts(spark, sf_dir):
    li = read_table(spark, sf_dir, "lineitem").select("l_extendedprice", (F.col("l_shipdate") >= F.lit("1998-01-01").cast("timestamp_ntz")).cast("int").alias("k"))
    return privacy.psi_alert(li, "l_extendedprice", "k", [20_000.0, 40_000.0]).withColumn("psi", F.round("psi", 6))


def _silver_input(spark, sf_dir):
    e = read_table(spark, sf_dir, "events")
    user = F.col("user_id").cast("string")
    return e.select(
        F.col("event_id").alias("transaction_id"), user.alias("customer_id"), F.concat(F.lit("User "), user).alias("customer_name"), F.concat(F.lit("U"), user, F.lit("@x.com ")).alias("email"),
        F.concat(F.lit("TAX"), user).alias("tax_id"), (F.col("value") - 50).alias("amount"), F.col("ts").alias("timestamp"),
    )


@query(
    "silver_build",
    """WITH e AS (SELECT event_id AS transaction_id, 'TAX' || user_id AS tax_id, 'u' || user_id || '@x.com' AS email, 'USER ' || user_id AS customer_name, round(value - 50, 6) AS amount, ts AS "timestamp" FROM events),
    d AS (SELECT *, row_number() OVER (PARTITION BY tax_id, email ORDER BY "timestamp" DESC, transaction_id DESC) AS n FROM e)
    SELECT 'facts' AS part, transaction_id, tax_id, email, customer_name, amount FROM e WHERE amount >= 0
    UNION ALL SELECT 'held', transaction_id, tax_id, email, customer_name, amount FROM e WHERE amount < 0
    UNION ALL SELECT 'dimension', NULL, tax_id, email, customer_name, amount FROM d WHERE n = 1 AND amount >= 0""",
)
def silver_build(spark, sf_dir):
    """Silver written by partition, and read back row by row: facts, the facts held back, and customers."""
    root = f"{shared_dir(spark)}/silver-{uuid.uuid4().hex}"
    silver.write(silver.build(_silver_input(spark, sf_dir), "2024-01-01", run_id="run"), root, "2024-01-01")
    columns = ["transaction_id", "tax_id", "email", "customer_name", F.round("amount", 6).alias("amount")]
    facts_ = spark.read.parquet(f"{root}/facts/2024-01-01").select(F.lit("facts").alias("part"), *columns)
    held = spark.read.parquet(f"{root}/quarantine").filter(F.col("transaction_id").isNotNull()).select(F.lit("held").alias("part"), *columns).distinct()
    people_ = spark.read.parquet(f"{root}/dimension/2024-01-01").select(F.lit("dimension").alias("part"), F.lit(None).cast("long").alias("transaction_id"), *columns[1:])
    return facts_.unionByName(held).unionByName(people_)


@query(
    "silver_drift_history",
    """WITH d AS (SELECT count(*) AS n, count_if(n = 1 AND value - 50 >= 0) AS people, count_if(value - 50 >= 0) AS facts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events))
    SELECT k AS partition_key, n::INTEGER AS bronze_row_count, facts::INTEGER AS transaction_fact_count, people::INTEGER AS customer_dimension_count, CASE WHEN k = 'b' THEN 'late' END AS note FROM d, (VALUES ('a'), ('b')) AS x(k)""",
)
def silver_drift_history(spark, sf_dir):
    """Two reports appended, the second with a column more."""
    path = f"{shared_dir(spark)}/drift-{uuid.uuid4().hex}"
    report = silver.build(_silver_input(spark, sf_dir), "a", run_id="run")["drift"]
    silver.append_drift(report, path)
    silver.append_drift(report.withColumns({"partition_key": F.lit("b"), "note": F.lit("late")}), path)
    return silver.drift_history(spark, path).select("partition_key", "bronze_row_count", "transaction_fact_count", "customer_dimension_count", "note")


@query(
    "quarantine_volume",
    """WITH r AS (SELECT 'run' || user_id % 8 AS name, count(*) AS checked, count_if(value > 20 + 30 * (user_id % 8)) AS held FROM events GROUP BY 1), d AS (SELECT strftime(ts, '%Y%m%d') AS name, count_if(value > 20 + 30 * (user_id % 8)) AS held FROM events GROUP BY 1)
    SELECT 'run' AS kind, name, held, checked::BIGINT AS checked, held / checked > 0.05 AS alert FROM r UNION ALL SELECT 'day', name, held, NULL, held > 60 FROM d WHERE held > 0""",
)
def quarantine_volume(spark, sf_dir):
    """Events as rows of eight runs, those of high value held back, on the day that they come."""
    e = read_table(spark, sf_dir, "events").withColumn("validation_run_id", F.concat(F.lit("run"), (F.col("user_id") % 8).cast("string")))
    held = e.filter(F.col("value") > 20 + 30 * (F.col("user_id") % 8)).withColumn("quarantine_timestamp", F.date_format("ts", "yyyyMMdd_HHmmss"))
    return silver.quarantine_alerts(held, e.groupBy("validation_run_id").agg(F.count(F.lit(1)).alias("checked")), rows=60)


@query(
    "gold_days",
    """WITH f AS (SELECT strftime(o_orderdate, '%Y') AS day, o_totalprice::DECIMAL(18,2) AS amount FROM orders JOIN customer ON o_custkey = c_custkey)
    SELECT day AS partition_date, count(*) AS n, sum(CASE WHEN day = '1999' THEN 2 * amount ELSE amount END)::DOUBLE AS total FROM f GROUP BY 1""",
)
def gold_days(spark, sf_dir):
    """By years here: all written, then 1999 again with twice the amounts; read back."""
    root = f"{shared_dir(spark)}/gold-{uuid.uuid4().hex}"
    f, d = facts(spark, sf_dir), customers(spark, sf_dir)
    again = f.filter(F.year("timestamp") == 1999).withColumn("amount", F.col("amount") * 2)
    for some in (f, again):
        gold.write(gold.features(some, d).withColumn("partition_date", F.substring("partition_date", 1, 4)), gold.orphans(some, d).withColumn("partition_date", F.lit("all")), root)
    back = spark.read.parquet(f"{root}/v1.0/features")
    return back.groupBy(F.col("partition_date").cast("string").alias("partition_date")).agg(F.count(F.lit(1)).alias("n"), gold.exact_sum(F.col("amount")).alias("total"))


@query("gold_manifest", "SELECT (SELECT count(*) FROM orders) AS input_rows_fact, (SELECT count(*) FROM customer WHERE c_custkey % 3 > 0) AS input_rows_dim, count(*) FILTER (c_custkey IS NOT NULL) AS output_rows, count(*) FILTER (c_custkey IS NULL) AS orphan_rows FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_custkey % 3 > 0")
def gold_manifest(spark, sf_dir):
    """A third of the customers is unknown."""
    root = f"{shared_dir(spark)}/gold-{uuid.uuid4().hex}"
    f, d = facts(spark, sf_dir), customers(spark, sf_dir).filter(F.col("customer_id") % 3 > 0)
    out = gold.features(f, d)
    gold.write(out.withColumn("partition_date", F.substring("partition_date", 1, 4)), gold.orphans(f, d).withColumn("partition_date", F.lit("all")), root, facts=f, dim=d)
    return spark.read.json(f"{root}/v1.0/manifest").select("input_rows_fact", "input_rows_dim", "output_rows", "orphan_rows")
