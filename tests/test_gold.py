import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallymill.operators import features, gold

FACTS = "customer_id string, amount double, timestamp timestamp_ntz"
SUNDAY = dt.datetime(2024, 1, 7, 15)


def facts(spark, rows):
    return spark.createDataFrame(rows, FACTS)


def test_inner_and_orphans(spark):
    f = facts(spark, [("c1", 100.0, SUNDAY), ("c2", 200.0, SUNDAY), ("c3", 300.0, SUNDAY), (None, 1.0, SUNDAY)])
    d = spark.createDataFrame([("c1", "A", "x"), ("c2", "B", "y"), ("c4", "C", "z")], "customer_id string, name string, segment string")
    assert gold.denormalize(f, d).count() == 2
    assert {r.customer_id for r in gold.orphans(f, d).collect()} == {"c3", None}


def test_right_hand_names_do_not_clash(spark):
    d = spark.createDataFrame([("c1", 9.0)], "customer_id string, amount double")
    r = gold.denormalize(facts(spark, [("c1", 1.0, SUNDAY)]), d).first()
    assert (r.amount, r.amount_right) == (1.0, 9.0)


def test_temporal(spark):
    r = gold.temporal(facts(spark, [("c", 1.0, SUNDAY)])).first()
    assert (r.partition_date, r.day_of_month, r.day_of_week, r.hour_of_day) == ("2024-01-07", 7, 7, 15)


def test_high_risk_limit(spark):
    got = gold.high_risk(facts(spark, [("c", 10000.0, SUNDAY), ("c", 10000.01, SUNDAY), ("c", None, SUNDAY)])).orderBy("amount").collect()
    assert [r.high_risk_amount for r in got] == [None, 0, 1]


def test_stats_of_nulls(spark):
    r = gold.customer_stats(facts(spark, [("c", None, SUNDAY), ("c", None, SUNDAY)])).first()
    assert (r.transaction_count, r.transaction_velocity, r.mean_transaction_amount, r.clv) == (2, 2.0, None, 0.0)
    assert gold.customer_stats(facts(spark, [(None, 4.0, SUNDAY)])).first().clv == 4.0


def test_zscore_guard(spark):
    assert [r.z_score_deviation for r in gold.zscore_global(facts(spark, [("c", 5.0, SUNDAY)])).collect()] == [0.0]
    assert gold.zscore_global(facts(spark, [])).count() == 0
    assert features.customer_zscore(facts(spark, [("c", 5.0, SUNDAY)])).first().customer_zscore == 0.0


def test_running_features(spark):
    f = facts(spark, [("c", a, SUNDAY + dt.timedelta(hours=h)) for h, a in enumerate([10.0, None, 5.0, 1.0, 2.0])])
    got = features.cumulative_clv(features.rolling_velocity(f)).orderBy("timestamp").collect()
    assert [r.clv_cumulative for r in got] == [10.0, None, 15.0, 16.0, 18.0]
    assert [r.velocity_rolling3 for r in got] == [10.0, 10.0, 15.0, 6.0, 8.0]


def test_descriptions_survive_parquet(spark, tmp_path):
    f = features.described(features.rolling_velocity(facts(spark, [("c", 1.0, SUNDAY)])))
    f.write.parquet(str(tmp_path / "f"))
    assert spark.read.parquet(str(tmp_path / "f")).schema["velocity_rolling3"].metadata["description"]


def test_write(spark, tmp_path):
    d = spark.createDataFrame([("c1", "A")], "customer_id string, name string")
    f = facts(spark, [("c1", 1.0, SUNDAY), ("c2", 2.0, SUNDAY)])
    out = gold.features(f, d)
    gold.write(out, gold.orphans(f, d), str(tmp_path), "v1.0")
    m = spark.read.json(str(tmp_path / "v1.0/manifest")).first()
    assert (m.rows, m.orphans) == (1, 1)
    gold.write(out, gold.orphans(f, d), str(tmp_path), "2", facts=f, dim=d)
    m = spark.read.json(str(tmp_path / "v2/manifest")).first()
    assert (m.version, m.input_rows_fact, m.input_rows_dim, m.output_rows, m.orphan_rows) == ("2", 2, 1, 1, 1)
    assert m.timestamp and '"amount": "double"' in m.schema
    assert spark.read.parquet(str(tmp_path / "v1.0/features")).filter(F.col("partition_date") == "2024-01-07").count() == 1


@pytest.mark.parametrize("rows", [[], [("c", 1.0, None)]])
def test_no_rows_or_no_time(spark, rows):
    d = spark.createDataFrame([("c", "A")], "customer_id string, name string")
    assert gold.features(facts(spark, rows), d).count() == len(rows)


def test_writing_a_day_leaves_the_others(spark, tmp_path):
    d = spark.createDataFrame([("c1", "A")], "customer_id string, name string")
    run = lambda *rows: gold.write(gold.features(facts(spark, rows), d), gold.orphans(facts(spark, rows), d), str(tmp_path))
    run(("c1", 1.0, SUNDAY), ("c1", 2.0, SUNDAY + dt.timedelta(days=1)), ("c9", 3.0, SUNDAY), ("c9", 3.0, None))
    run(("c1", 5.0, SUNDAY), ("c1", 6.0, SUNDAY), ("c9", 7.0, SUNDAY + dt.timedelta(days=2)))
    got = {(str(r.partition_date), r.amount) for r in spark.read.parquet(str(tmp_path / "v1.0/features")).collect()}
    assert got == {("2024-01-07", 5.0), ("2024-01-07", 6.0), ("2024-01-08", 2.0)}
    left = {(str(r.partition_date), r.amount) for r in spark.read.parquet(str(tmp_path / "v1.0/orphans")).collect()}
    assert left == {("2024-01-07", 3.0), ("None", 3.0), ("2024-01-09", 7.0)}
    m = spark.read.json(str(tmp_path / "v1.0/manifest")).first()
    assert (m.output_rows, m.orphan_rows) == (2, 1)


def test_names_that_are_taken_on_both_sides(spark):
    f = spark.createDataFrame([("c1", 1, 2)], "customer_id string, name int, name_right int")
    d = spark.createDataFrame([("c1", 3, 4, 5)], "customer_id string, name int, NAME_RIGHT int, name_right_right int")
    r = gold.denormalize(f, d).first().asDict()
    assert len(r) == 6 and sorted(v for k, v in r.items() if k != "customer_id") == [1, 2, 3, 4, 5]
