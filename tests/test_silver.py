import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallymill import rules, schemas
from tallymill.operators import silver
from tallymill.operators.latest import keep_latest

T0 = dt.datetime(2024, 1, 1, 9)
FULL = "customer_id string, customer_name string, email string, tax_id string, currency string, amount double, timestamp timestamp_ntz"


def people(spark, rows):
    return spark.createDataFrame(rows, FULL)


def row(i="1", name="Alice", mail="a@x.com", tax="TAX1", cur=None, amount=10.0, ts=T0):
    return (i, name, mail, tax, cur, amount, ts)


def test_standardize(spark):
    df = spark.createDataFrame([("  alice smith\t", " Alice@Example.com \n", None, "12.5", "2024-01-07T10:00:00"), ("B", "b", "kes", "x", "never")], "customer_name string, email string, currency string, amount string, timestamp string")
    a, b = silver.standardize(df).orderBy("customer_name").collect()
    assert (a.customer_name, a.email, a.currency, a.amount, a.timestamp) == ("ALICE SMITH", "alice@example.com", "USD", 12.5, dt.datetime(2024, 1, 7, 10))
    assert (b.currency, b.amount, b.timestamp) == ("KES", None, None)


def test_history_is_kept_and_customers_are_one(spark):
    df = people(spark, [row(ts=T0 + dt.timedelta(hours=h), amount=10.0 + h) for h in range(3)])
    facts, dim = silver.split_fact_dimension(df)
    assert facts.count() == 3 and dim.count() == 1
    assert {r.golden_record_id for r in facts.collect()} == {dim.first().golden_record_id} != {None}
    assert dim.first().amount == 12.0


def test_facts_and_customers(spark):
    df = people(spark, [row(), row(ts=T0 + dt.timedelta(days=1)), row(tax="TAX2", mail="b@x.com")])
    facts, dim = silver.split_fact_dimension(df)
    assert (facts.count(), dim.count()) == (3, 2)


def test_null_keys_do_not_collapse(spark):
    df = people(spark, [row(tax=None, amount=1.0), row(tax=None, amount=2.0)])
    assert silver.transaction_facts(df).count() == 2
    assert silver.transaction_facts(df, null_keys="collapse").count() == 1
    assert silver.customer_dimension(df).count() == 2


def test_dated_row_beats_the_undated(spark):
    df = spark.createDataFrame([(1, None, "a"), (1, T0, "b")], "k int, ts timestamp_ntz, v string")
    assert keep_latest(df, ["k"], "ts").first().v == "b"
    assert keep_latest(df, ["k"], "ts", nulls_first=True).first().v == "a"


def test_ties_are_settled_the_same_way(spark):
    rows = [(1, T0, v) for v in "abcdef"]
    schema = "k int, ts timestamp_ntz, v string"
    assert keep_latest(spark.createDataFrame(rows, schema), ["k"], "ts").first() == keep_latest(spark.createDataFrame(rows[::-1], schema), ["k"], "ts").first()


def test_same_second_is_one_event(spark):
    df = people(spark, [row(ts=T0.replace(microsecond=1)), row(ts=T0.replace(microsecond=9))])
    assert silver.transaction_facts(df).count() == 1


def test_event_key_of_round_amounts(spark):
    got = spark.range(1).select(silver.event_key(F.lit("T"), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"), F.lit(1.0e7)).alias("h")).first().h
    want = spark.range(1).select(F.sha2(F.lit("T|2024-01-01 00:00:00|10000000.00"), 256).alias("h")).first().h
    assert got == want


def test_split_loses_no_row(spark):
    df = people(spark, [row(amount=-1.0), row(amount=None), row(amount=5.0), row(tax=None)])
    good, bad = rules.split(df)
    assert (good.count(), bad.count()) == (2, 2)
    assert sorted(r.violations[0] for r in bad.collect()) == ["amount_at_least", "tax_id_not_null"]
    assert {r.rule: r.failed for r in rules.report(df).collect()} == {"customer_id_not_null": 0, "tax_id_not_null": 1, "amount_at_least": 1}


def test_rule_over_a_missing_column(spark):
    _, bad = rules.split(spark.range(2), (rules.not_null("nowhere"),))
    assert bad.count() == 2


@pytest.mark.parametrize("n", [0, 3])
def test_drift(spark, n):
    bronze = people(spark, [row(tax=None), row(), row()][:n])
    facts = bronze.filter(F.col("tax_id").isNotNull())
    r = silver.drift_report(bronze, facts, facts.limit(1)).first()
    assert (r.bronze_row_count, r.transaction_fact_count) == (n, max(0, n - 1))
    assert r.fact_attrition_rate == pytest.approx(1 / 3 if n else 0.0)
    assert set(schemas.DRIFT.names) == set(r.asDict())


def test_whole_layer_and_quarantine(spark, tmp_path):
    out = silver.build(people(spark, [row(), row(amount=-5.0, ts=T0 + dt.timedelta(days=1)), row(tax=None)]), None)
    assert out["facts"].count() == 1
    held = out["quarantine"]
    assert {r.partition_key for r in held.collect()} == {"None_transactions"}
    silver.write_quarantine(held, str(tmp_path / "q"))
    assert spark.read.parquet(str(tmp_path / "q")).count() == held.count()


def test_empty_input_keeps_its_columns(spark):
    out = silver.build(people(spark, []))
    assert out["facts"].count() == 0 and "golden_record_id" in out["facts"].columns
    assert out["drift"].first().bronze_row_count == 0


def test_zones_are_turned_into_utc_and_currency_is_upper(spark):
    rows = [("2024-01-01T03:00:00+03:00", "kes"), ("2024-01-01 03:00:00Z", None), ("2024-01-01 03:00:00.5 -05:30", "uSd"), ("2024-01-01 03:00:00", "KES"), ("2024-01-01", ""), ("soon", "x"), (None, "x")]
    df = spark.createDataFrame(rows, "timestamp string, currency string")
    want = ["2024-01-01 00:00:00", "2024-01-01 03:00:00", "2024-01-01 08:30:00.5", "2024-01-01 03:00:00", "2024-01-01 00:00:00", None, None]
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for z in ("UTC", "Asia/Tokyo"):
            spark.conf.set("spark.sql.session.timeZone", z)
            got = silver.standardize(df).selectExpr("cast(timestamp as string) t", "currency").collect()
            assert [r.t for r in got] == want, z
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert [r.currency for r in got] == ["KES", "USD", "USD", "KES", "", "X", "X"]


def test_quarantine_alerts_by_run_and_day(spark):
    held = spark.createDataFrame([("a", "20240101_000000")] * 5 + [("b", "20240101_230000")] * 6 + [("lost", "20240102_000000"), (None, None)], "validation_run_id string, quarantine_timestamp string")
    runs = spark.createDataFrame([("a", 60), ("a", 40), ("b", 100), ("c", 10), ("d", 0)], "validation_run_id string, checked long")
    got = {(r.kind, r.name): (r.held, r.checked, r.alert) for r in silver.quarantine_alerts(held, runs, rows=10).collect()}
    assert got["run", "a"] == (5, 100, False) and got["run", "b"] == (6, 100, True) and got["run", "c"] == (0, 10, False) and got["run", "d"] == (0, 0, False)
    assert got["run", "lost"] == (1, None, True) and got["day", "20240101"] == (11, None, True) and got["day", "20240102"] == (1, None, False)


def test_drift_history_of_changing_columns(spark, tmp_path):
    silver.append_drift(spark.createDataFrame([("a", 1)], "partition_key string, n int"), str(tmp_path))
    silver.append_drift(spark.createDataFrame([("b", "x")], "partition_key string, note string"), str(tmp_path))
    assert sorted(tuple(r) for r in silver.drift_history(spark, str(tmp_path)).select("partition_key", "n", "note").collect()) == [("a", 1, None), ("b", None, "x")]
