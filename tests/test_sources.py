import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tallymill import lineage, schemas
from tallymill.operators import detection as d
from tallymill.operators import privacy
from tallymill.sources import bronze, external, generator
from tallymill.streaming import jobs


def test_bronze_round_trip(spark, tmp_path):
    root = str(tmp_path)
    df = bronze.conform(spark.createDataFrame([("u1", 5.0)], "sender_id string, transaction_amount double"), bronze.SYNTHETIC_COLUMNS, "batch", "synthetic", True)
    assert schemas.missing_or_mistyped(df.schema, schemas.BRONZE) == []
    about = bronze.ingest_once(df, root, "2024-01-01")
    assert about["row_count"] == 1 and about["immutable"]
    assert bronze.ingest_once(df, root, "2024-01-01") is None
    bronze.append(df, root, "2024-01-01")
    (tmp_path / "transactions/2024-01-01/broken.parquet").write_text("no parquet")
    assert bronze.read_partition(spark, root, "2024-01-01").count() == 2
    empty = bronze.read_partition(spark, root, "1999-01-01")
    assert empty.count() == 0 and empty.schema == schemas.BRONZE


def test_range_scan_is_pushed_down(spark, data):
    from tallymill.plans.medallion import source_range_scan

    plan = source_range_scan(spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_orderdate" in plan and "o_custkey" not in plan


def test_retry():
    calls, waits = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise ConnectionError
        return "ok"

    assert external.retried(flaky, sleep=waits.append) == "ok" and waits == [2.0, 4.0]
    with pytest.raises(ZeroDivisionError):
        external.retried(lambda: 1 // 0, attempts=2, sleep=waits.append)


def test_profiles(tmp_path):
    good = {"transaction_type_probs": {"a": 0.5, "b": 0.5}, "clipping_bound": 10.0}
    assert external.check_profile(good) == []
    bad = {"transaction_type_probs": {"a": 0.5, "b": 0.6, "c": 0.0}, "clipping_bound": 1e9, "amount_std": 0, "what": 1}
    assert len(external.check_profile(bad)) == 5
    (tmp_path / "p.json").write_text(json.dumps({"x": good}))
    assert external.load_profiles(str(tmp_path / "p.json"))["x"] == good


def test_generators_respect_balances(spark):
    p = generator.Profile()
    for make in (generator.generate, generator.generate_sequential):
        df = make(spark, 400, 40, p)
        rows = df.collect()
        assert 0 < len(rows) <= 400 and min(r.transaction_amount for r in rows) >= 1.0
        spent = df.groupBy("sender_id").agg(F.sum("transaction_amount").alias("s")).join(generator.users(spark, 40, p), "sender_id")
        assert spent.filter(F.col("s") > F.col("balance") + 0.01).count() == 0
        assert {r.channel_type for r in rows} <= set(p.transaction_type_probs)
    with pytest.raises(ValueError):
        generator.generate_sequential(spark, 10, most=5)


def test_fidelity(spark):
    same = spark.range(2000).select(F.floor(F.col("id") / 2).cast("double").alias("v"), (F.col("id") % 2).alias("k"))
    assert privacy.fidelity(same, "v", "k")["fidelity_status"] == "PASS"
    apart = same.withColumn("v", F.col("v") + F.col("k") * 500)
    assert privacy.fidelity(apart, "v", "k")["fidelity_status"] == "FAIL"
    assert privacy.fidelity(same.filter("k = 0"), "v", "k")["fidelity_status"] == "FAIL"
    assert privacy.kolmogorov_p(0.05, 1000, 1000) == pytest.approx(0.1641, abs=1e-3)


def test_lineage(spark):
    def deaf(_):
        raise OSError

    log = lineage.Lineage(deaf)
    with log.job("j", ["a"], ["b"]):
        pass
    with pytest.raises(KeyError), log.job("k", [], []):
        raise KeyError("x")
    assert [e["state"] for e in log.events] == ["START", "COMPLETE", "START", "FAIL"]
    assert log.frame(spark).count() == 4
    seen_df, seen = lineage.counted(spark.range(7), "n")
    seen_df.collect()
    assert seen.get["rows"] == 7


def test_hooks(spark):
    h = lineage.Hooks()
    h.register("pre", "n", lambda df: df.count())
    h.register("pre", "bad", lambda df: 1 / 0)
    assert h.run("pre", spark.range(3)) == {"n": 3}


def test_replay_and_tiers(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [("r1", "q1", t0), ("r1", "q2", t0 + dt.timedelta(days=5)), ("r1", "q3", t0 + dt.timedelta(days=200))]
    t = spark.createDataFrame(rows, "receipt string, request string, ts timestamp_ntz").withColumn("at", d.seconds("ts"))
    assert [(x.request, x.earlier_request) for x in d.replays(t, "receipt", "request").collect()] == [("q2", "q1")]
    assert [r[0] for r in spark.createDataFrame([(0.3,), (0.65,), (0.85,), (0.1,)], "s double").select(d.risk_tier(F.col("s"))).collect()] == ["low", "medium", "high", "low"]


def test_late_repeats_and_silver_batches(spark, tmp_path):
    df = spark.createDataFrame([(1, dt.datetime(2024, 1, 1)), (1, dt.datetime(2024, 1, 1)), (2, dt.datetime(2024, 1, 1, 1))], "k long, ts timestamp")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = jobs.read_files(spark, str(tmp_path / "in"), df.schema)
    assert jobs.run_once(jobs.first_seen(stream, "ts", ["k"], "1 day")).count() == 2
    q = jobs.silver_micro_batches(stream, lambda b: {"facts": b}, str(tmp_path / "out"), str(tmp_path / "state"))
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out/facts")).count() == 3
    assert jobs.run_once(jobs.sessions(stream, "ts", "k", "10 minutes", "1 hour"), "complete").count() == 2


def test_replays_behind_a_run_of_equal_requests(spark):
    rows = [("r", "1", 0), ("r", "2", 10), ("r", "2", 20), ("r", "2", 95), ("r", "1", 100), ("s", "1", 0)]
    t = spark.createDataFrame(rows, "receipt string, request string, at long")
    got = d.replays(t, "receipt", "request", 90).orderBy("request", "earlier_request").collect()
    assert sorted((x.request, x.earlier_request) for x in got) == [("1", "2"), ("2", "1"), ("2", "1")]


def test_callbacks(spark):
    import json

    from tallymill.operators import callbacks

    def sent(code=0, receipt="QWE23RT4Y7", amount="10.129", phone="0712345678", at="20250125163000", items=True):
        item = [{"Name": n, "Value": v} for n, v in (("Amount", amount), ("MpesaReceiptNumber", receipt), ("PhoneNumber", phone), ("TransactionDate", at)) if v is not None]
        return json.dumps({"Body": {"stkCallback": {"MerchantRequestID": "m", "CheckoutRequestID": "c", "ResultCode": code, **({"CallbackMetadata": {"Item": item}} if items else {})}}})

    payloads = [sent(), sent(code=None), sent(code=1, items=False), sent(receipt=None), sent(receipt="qwe23rt4y7"), sent(amount="0"), sent(amount="150000.01"), sent(amount="x"), sent(phone="25571234567"), sent(at="20990101000000"), sent(at="no"), "{", None]
    df = spark.createDataFrame(list(enumerate(payloads)), "i int, payload string")
    got = callbacks.validate(df, F.lit("2025-01-25 16:26:00")).orderBy("i").collect()
    assert [r.verdict for r in got] == ["accept", "review", "failed", *["reject"] * 7, "accept", "reject", "reject"]
    assert (got[0].amount, got[0].msisdn) == (10.12, "254712345678") and [r.no_time for r in got[:11]].index(True) == 10
    assert [list(r.reasons) for r in got[3:10]] == [["receipt"], ["receipt"], ["amount"], ["amount"], ["amount"], ["msisdn"], ["future"]]
    asked = spark.createDataFrame([("c", 12.0)], "checkout_request_id string, requested_amount double")
    assert {r.flag for r in callbacks.reconcile(callbacks.validate(df.limit(1), F.lit("2025-02-01")), asked).collect()} == {"AMOUNT_INTEGRITY_FAILURE"}
    assert [r.flag for r in callbacks.reconcile(callbacks.validate(df.limit(1), F.lit("2025-02-01")), asked.limit(0)).collect()] == ["ORPHAN_CALLBACK"]


def test_structuring_with_ages_and_withdrawals(spark):
    rows = [(i, f"s{i}", "r", 145_000.0, i * 60) for i in range(3)] + [(9, "old", "r", 145_000.0, 200)]
    t = spark.createDataFrame(rows, "txn int, sender string, receiver string, amount double, at long")
    opened = spark.createDataFrame([(f"s{i}", -86_400) for i in range(3)] + [("old", -8 * 86_400)], "sender string, opened_at long")
    assert [(x.txn, x.parties) for x in d.new_sender_wave(t, opened).collect()] == [(2, 3)]
    moves = [(i, "w", f"a{i}", "in", 100_000.0, i * 60) for i in range(10)] + [(50, "w", "b", "out", 900_000.0, 700), (51, "w", "b", "out", 900_000.0, 90_000)]
    m = spark.createDataFrame(moves, "txn int, account string, agent string, kind string, amount double, at long")
    assert [(x.txn, x.n_agents) for x in d.gathered_withdrawal(m).collect()] == [(50, 10)]
    chain = spark.createDataFrame([("D", 0), ("E", 0)], "target string, at long")
    bank = spark.createDataFrame([("D", 5_000), ("E", 6_000)], "account string, at2 long")
    assert [x.target for x in d.to_bank(chain, bank).collect()] == ["D"]


def test_credit_decisions(spark):
    df = spark.createDataFrame([(0.14,), (0.1399,), (0.09,), (0.0899,), (None,)], "p double")
    assert [r[0] for r in df.select(d.credit_decision(F.col("p"))).collect()] == ["DECLINE", "REFER", "REFER", "APPROVE", None]
    c = {f: 0.03 for f, limit, _ in d.ADVERSE} | {"merchant_diversity": -0.5, "wallet_age_days": -0.01}
    got = spark.createDataFrame([(c,), ({},)], "c map<string,double>").select(d.reason_codes(F.col("c"))).collect()
    assert got[0][0] == ["RC-104", "RC-001", "RC-002", "RC-003", "RC-004", "RC-005"] and got[1][0] == []


def test_appended_tables_have_properties(spark, tmp_path):
    from tallymill.sources import external

    spark.sql(f"CREATE DATABASE held LOCATION '{tmp_path}/held'")
    df = spark.range(2).select(F.col("id").alias("v", metadata={"description": "it's a \\ value"}))
    external.append_table(df, "held.feature", {"version": "1"})
    external.append_table(df, "held.feature", {"team": "x"})
    about = {r.key: r.value for r in spark.sql("SHOW TBLPROPERTIES held.feature").collect()}
    assert (about["description.v"], about["version"], about["team"], spark.table("held.feature").count()) == ("it's a \\ value", "1", "x", 4)
    spark.sql("DROP DATABASE held CASCADE")


def test_payouts(spark):
    import json

    from tallymill.operators import callbacks

    def sent(code=0, **items):
        given = {"TransactionAmount": 5000.009, "TransactionReceipt": "QWE23RT4Y7", "B2CPartyName": "254712345678 - John Doe", "B2CChargesPaidAccount": -45.5, "B2CUtilityAccountAvailableFunds": 950000.0, "B2CRecipientRegisteredMetadata": "RECEIVED"} | items
        return json.dumps({"Result": {"ResultCode": code, "OriginatorConversationID": "o", "ConversationID": "v", "TransactionID": "t", "ResultParameters": {"ResultParameter": [{"Key": k, "Value": v} for k, v in given.items() if v is not None]}}})

    payloads = [sent(), sent(1), sent(1, TransactionReceipt=None), sent(TransactionAmount=-1), sent(TransactionAmount=500000), sent(TransactionAmount=500001), sent(None), sent(None, TransactionReceipt=None), "[]", json.dumps({"Result": None}), sent(B2CPartyName=None), json.dumps({"Result": {"ResultCode": "x"}})]
    df = spark.createDataFrame(list(enumerate(payloads)), "i int, payload string")
    got = callbacks.validate(df, F.lit("2025-01-25 16:26:00")).orderBy("i").collect()
    assert [r.verdict for r in got] == ["accept", "failed", "failed", "reject", "accept", "reject", "review", "reject", "reject", "reject", "reject", "reject"]
    first = got[0]
    assert (first.kind, first.amount, first.charges, first.utility_funds, first.msisdn, first.party_name, first.recipient_status, first.checkout_request_id, first.no_time) == ("b2c", 5000.0, -45.5, 950000.0, "254712345678", "John Doe", "RECEIVED", "o", False)
    asked = spark.createDataFrame([("o", 5000.0), ("o", 5000.0)], "checkout_request_id string, requested_amount double")
    flags = sorted((r.i, r.flag) for r in callbacks.reconcile(callbacks.validate(df, F.lit("2025-02-01")), asked).collect())
    assert [f for f in flags if f[1] == "INCONSISTENT_B2C_STATE"] == [(1, "INCONSISTENT_B2C_STATE")]
    assert {i for i, f in flags if f == "AMOUNT_INTEGRITY_FAILURE"} == {3, 4, 5} and {i for i, f in flags if f == "ORPHAN_CALLBACK"} == {8, 9, 11}


def test_a_payload_is_parsed_once(spark):
    """Not once for each field that is read; and both kinds give what they gave."""
    from tallymill.operators import callbacks

    stk = {"Body": {"stkCallback": {"CheckoutRequestID": "c1", "ResultCode": 0, "CallbackMetadata": {"Item": [{"Name": "Amount", "Value": 5}, {"Name": "Amount", "Value": 6}]}}}}
    b2c = {"Result": {"OriginatorConversationID": "c2", "ResultParameters": {"ResultParameter": [{"Key": "B2CPartyName", "Value": "0712345678 - A B"}]}}}
    df = spark.createDataFrame([(json.dumps(stk),), (json.dumps(b2c),), ("{",), ("[]",), (None,)], "payload string")
    v = callbacks.validate(df, F.lit("2025-02-01"))
    assert [(x.kind, x.checkout_request_id, x.result_code, x.amount, x.party_name) for x in v.collect()] == [("stk", "c1", 0, 5.0, None), ("b2c", "c2", None, None, "A B"), *[(None,) * 5] * 3]
    plan = v._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson") == 1
