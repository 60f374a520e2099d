"""Credit features by hand, and streams of replays that are stopped and started again."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallymill.operators import credit
from tallymill.streaming import jobs, replays

LEDGER = "account string, txn long, ts timestamp_ntz, party string, direction string, kind string, category string, amount double, balance double"
ADVANCES = "account string, drawn_at timestamp_ntz, due_at timestamp_ntz, repaid_at timestamp_ntz, amount double, granted double"
PROFILES = "account string, registered_at date, sim_since date, feature_phone boolean"
AS_OF = dt.datetime(2024, 7, 10)


def day(month, d=1, year=2024):
    return dt.datetime(year, month, d)


def features(spark, ledger=(), advances=(), profiles=(("a", dt.date(2023, 7, 10), dt.date(2024, 1, 11), True),)):
    rows = [("a", i, *x) for i, x in enumerate(ledger)]
    out = credit.credit_features(spark.createDataFrame(rows, LEDGER), spark.createDataFrame([("a", *x) for x in advances], ADVANCES), spark.createDataFrame(list(profiles), PROFILES), F.lit(AS_OF).cast("timestamp_ntz"))
    assert out.columns == ["account", *credit.FEATURES, "savings_group_volume"] and len(credit.FEATURES) == 24
    return {r.account: r for r in out.collect()}


def test_months_without_income_count_and_balances_carry(spark):
    """January to June: income of 600 in February and 1,200 in June; the balance of last November holds until May."""
    rows = [
        (day(11, 3, 2023), "x", "in", "p2p", None, 50.0, 70.0), (day(2, 5), "x", "in", "p2p", None, 600.0, None), (day(5, 5), "x", "out", "merchant", "food", 10.0, 20.0),
        (day(6, 5), "y", "in", "deposit", None, 1200.0, 300.0), (day(6, 6), "y", "in", "remittance", None, 200.0, None), (day(7, 1), "y", "in", "p2p", None, 5000.0, 1.0), (day(7, 11), "z", "in", "p2p", None, 9e9, 0.0), (None, "z", "in", "p2p", None, 9e9, 0.0),
    ]
    r = features(spark, rows)["a"]
    assert r.avg_monthly_income_6m == pytest.approx(300) and r.min_monthly_balance_6m == 20.0
    assert r.income_volatility_cv == pytest.approx((((300**2) * 5 - 300**2 * 0 + 300**2 - 300**2 * 0 + 900**2 - 300**2) / 5) ** 0.5 / 300)
    assert r.savings_rate == pytest.approx((70 * 4 + 20 + 300) / 2000)
    assert r.income_growth_trend == pytest.approx((-1.5 * 600 + 2.5 * 1200) / 17.5)
    assert r.international_remittance_inflow == pytest.approx(200 / 7050)


def test_recent_behaviour(spark):
    rows = [
        (day(4, 1), "x", "out", "merchant", "old", 1e6, None), (day(6, 1), "x", "out", "merchant", "food", 100.0, None), (day(6, 2), "x", "out", "merchant", "food", 50.0, None), (day(6, 3), "x", "out", "merchant", None, 50.0, None), (day(6, 4), "y", "out", "merchant", "fuel", 50.0, None),
        (day(6, 5), "y", "out", "airtime", None, 10.0, None), (day(6, 6), "y", "out", "withdrawal", None, 40.0, None), (day(6, 7), "g", "out", "group", None, 5.0, None), (day(6, 8), "g", "out", "group", None, 5.0, None),
        (day(6, 10), "u", "out", "utility", None, 1.0, None), (day(6, 20), "u", "out", "utility", None, 1.0, None), (day(6, 24), "u", "out", "utility", None, 1.0, None), (day(6, 25), "p", "in", "p2p", None, 1.0, None), (day(6, 26), "p", "out", "p2p", None, 1.0, None), (day(6, 27), "p", "out", "p2p", None, 1.0, None),
    ]
    r = features(spark, rows)["a"]
    assert (r.merchant_diversity, r.savings_group_indicators, r.savings_group_volume, r.reciprocity_score, r.airtime_to_cash_ratio) == (2, 2, 10.0, 0.5, 0.25)
    assert r.avg_txn_amount == pytest.approx(316 / 14) and r.txn_frequency_per_day == pytest.approx(14 / 90) and r.utility_payment_regularity == pytest.approx(18**0.5)
    assert 0 < r.txn_regularity_score < 1 and r.network_density == pytest.approx(6 / 6)


def test_repayment_and_spells(spark):
    rows = [
        (day(1, 1), day(2, 1), day(1, 21), 100.0, 200.0), (day(1, 1), day(2, 1), day(2, 11), 100.0, 200.0), (day(1, 1), day(2, 5), day(2, 20), 100.0, 200.0), (day(3, 1), day(4, 1), day(4, 3), 100.0, 100.0),
        (day(5, 1), day(6, 30), None, 100.0, 100.0), (day(6, 1), day(8, 1), None, 50.0, 100.0), (day(6, 1), day(7, 1), day(7, 20), 0.0, 100.0), (day(7, 20), day(7, 25), None, 9e9, 0.0),
    ]
    r = features(spark, advances=rows)["a"]
    assert r.fuliza_repayment_rate == pytest.approx(1 / 6) and r.loan_utilization_ratio == pytest.approx(550 / 1000)
    assert r.avg_days_to_repay == pytest.approx((20 + 41 + 50 + 33) / 4) and r.max_delinquency_days == 15.0
    assert r.credit_resurrection_count == 2  # 1 to 20 February, 1 to 3 April; the one from 30 June is not over


def test_network_and_profile(spark):
    run = lambda party, months: [(dt.datetime(2023 + (m - 1) // 12, (m - 1) % 12 + 1, 2), party, "out", "p2p", None, 1.0, None) for m in months]
    rows = run("seven", range(3, 10)) + run("six", range(3, 9)) + run("gap", [*range(1, 7), *range(8, 14)]) + run("seven", [3]) + run("late", range(13, 19))
    r = features(spark, rows)["a"]
    assert (r.trusted_network_size, r.wallet_age_days, r.sim_tenure, r.feature_phone_indicator) == (1, 366, 5, 1)
    assert r.network_density == pytest.approx((2 + 1 * 5) / 6)


def test_accounts_without_rows_and_with_several_profiles(spark):
    got = features(spark, profiles=[("a", dt.date(2020, 1, 1), None, None), ("a", dt.date(2024, 7, 9), None, False), ("b", None, None, None)])
    assert (got["a"].wallet_age_days, got["a"].merchant_diversity, got["a"].avg_monthly_income_6m, got["b"].wallet_age_days) == (1, 0, None, None)
    assert features(spark, profiles=[]) == {}


def test_factors(spark):
    c = {"a": -0.3, "b": 0.2, "c": -0.1, "d": -0.3, "e": -0.05, "f": 0.0}
    one, none = spark.createDataFrame([(c,), ({},)], "c map<string,double>").select(credit.top_factors(F.col("c"), True).alias("p"), credit.top_factors(F.col("c"), False).alias("n")).collect()
    assert [(x.feature, x.magnitude) for x in one.p] == [("a", 0.3), ("d", 0.3), ("c", 0.1)] and [(x.feature, x.magnitude) for x in one.n] == [("b", 0.2)]
    assert none.p == [] == none.n


def test_replays_go_on_after_a_restart(spark, tmp_path):
    """Two runs of one stream: the second one knows the first one's receipts, until their time is up."""
    t0 = dt.datetime(2024, 1, 1)
    schema = "receipt string, request string, ts timestamp"

    def run(rows, name):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = jobs.read_files(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema)
        with replays.rocksdb_state(spark):
            q = replays.replays(stream, "ts", "receipt", "request", 90 * replays.DAY).writeStream.format("parquet").outputMode("append").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
            q.awaitTermination()
        return sorted(tuple(x) for x in spark.read.parquet(str(tmp_path / "out")).collect())

    at = lambda d, h=0: t0 + dt.timedelta(days=d, hours=h)
    first = run([("r", "1", at(0)), ("r", "1", at(1)), ("s", "1", at(1)), ("s", "2", at(2)), (None, "1", at(0)), ("r", None, at(0)), ("r", "9", None)], "a")
    assert first == [("s", "2", "1")]
    second = run([("r", "2", at(89)), ("r", "2", at(90)), ("s", "3", at(100)), ("r", "1", at(90, 1))], "b")
    assert second == sorted([*first, ("r", "2", "1"), ("r", "2", "1"), ("r", "1", "2")])
