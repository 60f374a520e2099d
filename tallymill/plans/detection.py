"""Detection rules over line items as transfers and events as account activity."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallymill.operators import callbacks, cycles
from tallymill.operators import detection as d
from tallymill.operators import fraud
from tallymill.plans.registry import query
from tallymill.session import read_table

HOUR, DAY = d.HOUR, d.DAY


def transfers(spark, sf_dir):
    """Events as transfers between users: times to the second, amounts a thousandfold."""
    e = read_table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("txn"),
        F.col("user_id").alias("sender"),
        ((F.col("user_id") * 7 + F.col("event_id") % 5) % 150).alias("receiver"),
        (F.col("user_id") % 20).alias("agent"),
        F.col("event_type").alias("place"),
        F.when(F.col("event_id") % 2 == 0, "in").otherwise("out").alias("kind"),
        F.round(F.col("value") * 1000, 2).alias("amount"),
        "ts",
        d.seconds("ts").alias("at"),
    )


T = """t AS (SELECT event_id AS txn, user_id AS sender, (user_id * 7 + event_id % 5) % 150 AS receiver, user_id % 20 AS agent, event_type AS place, CASE WHEN event_id % 2 = 0 THEN 'in' ELSE 'out' END AS kind,
  round(value * 1000, 2) AS amount, ts, epoch(date_trunc('second', ts))::BIGINT AS sec FROM events)"""


def _w(key: str, span: int) -> str:
    return f"OVER (PARTITION BY {key} ORDER BY sec RANGE BETWEEN {span} PRECEDING AND CURRENT ROW)"


_SUM = "sum(amount::DECIMAL(18,2))"


@query("aml_threshold_breach", f"WITH {T}, s AS (SELECT *, ({_SUM} OVER (PARTITION BY sender, ts::DATE ORDER BY sec, txn ROWS UNBOUNDED PRECEDING))::DOUBLE AS day_sum FROM t) SELECT txn, sender, day_sum, 'THRESHOLD_BREACH' AS flag FROM s WHERE amount > 150000 OR day_sum > 300000")
def aml_threshold_breach(spark, sf_dir):
    return d.threshold_breach(transfers(spark, sf_dir), 150_000, 300_000)


@query("aml_velocity", f"WITH {T} SELECT sender, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, {_SUM}::DOUBLE AS turnover, 'VELOCITY_WARNING' AS flag FROM t GROUP BY sender, strftime(ts, '%Y-%m-%d') HAVING count(*) > 5 OR {_SUM} > 200000")
def aml_velocity(spark, sf_dir):
    return d.velocity(transfers(spark, sf_dir), 5, 200_000)


@query("aml_structuring", f"WITH {T}, s AS (SELECT *, count(*) OVER (PARTITION BY sender, receiver, ts::DATE) AS pair_day, ({_SUM} {_w('sender', 12 * HOUR)})::DOUBLE AS window_sum FROM t) SELECT txn, sender, receiver, pair_day, window_sum, 'STRUCTURING_SUSPECTED' AS flag FROM s WHERE amount BETWEEN 20000 AND 149999 AND pair_day >= 2 AND window_sum > 100000")
def aml_structuring(spark, sf_dir):
    return d.structuring(transfers(spark, sf_dir), 20_000, 149_999, 2, 100_000)


@query("aml_rapid_escalation", f"WITH {T}, f AS (SELECT sender, min(sec) AS a FROM t GROUP BY 1) SELECT t.sender, {_SUM}::DOUBLE AS volume, count(*) AS n, 'RAPID_ESCALATION' AS flag FROM t JOIN f USING (sender) WHERE sec < a + {7 * DAY} GROUP BY t.sender HAVING {_SUM} > 700000")
def aml_rapid_escalation(spark, sf_dir):
    return d.rapid_escalation(transfers(spark, sf_dir), 7, 700_000)


@query("aml_float_anomaly", f"""WITH {T}, s AS (SELECT txn, agent, (sum(CASE WHEN kind = 'in' THEN amount::DECIMAL(18,2) END) {_w('agent', 12 * HOUR)})::DOUBLE AS float_growth, count(CASE WHEN kind = 'out' AND amount >= 30000 THEN 1 END) {_w('agent', 12 * HOUR)} AS n_out,
  coalesce((sum(CASE WHEN kind = 'in' THEN amount::DECIMAL(18,2) END) {_w('agent', 6 * HOUR)})::DOUBLE, 0) > 1.0::DOUBLE * coalesce((sum(CASE WHEN kind = 'out' THEN amount::DECIMAL(18,2) END) {_w('agent', 6 * HOUR)})::DOUBLE, 0) AS high_confidence FROM t) SELECT *, 'CUCKOO_SMURFING_RISK' AS flag FROM s WHERE float_growth > 300000 AND n_out > 3""")
def aml_float_anomaly(spark, sf_dir):
    return d.float_anomaly(transfers(spark, sf_dir), 300_000, 12 * HOUR, 3, 30_000, 1.0)


@query("aml_geographic", f"WITH {T}, s AS (SELECT txn, sender, len(list_distinct(list(place) {_w('sender', 12 * HOUR)}))::BIGINT AS n_places FROM t) SELECT *, 'GEOGRAPHIC_ANOMALY' AS flag FROM s WHERE n_places > 2")
def aml_geographic(spark, sf_dir):
    return d.geographic(transfers(spark, sf_dir), 2)


@query("aml_threshold_testing", f"WITH {T} SELECT sender, strftime(date_trunc('week', ts), '%Y-%m-%d') AS week, count(*) AS n, 'THRESHOLD_TESTING' AS flag FROM t WHERE floor(amount / 1000)::BIGINT % 10 = 0 GROUP BY ALL HAVING count(*) >= 2")
def aml_threshold_testing(spark, sf_dir):
    return d.threshold_testing(transfers(spark, sf_dir), F.floor(F.col("amount") / 1000) % 10 == 0, 2)


@query("aml_fan_out", f"WITH {T}, s AS (SELECT txn, sender, len(list_distinct(list(receiver) {_w('sender', 6 * HOUR)}))::BIGINT AS parties, ({_SUM} {_w('sender', 6 * HOUR)})::DOUBLE AS total FROM t WHERE amount BETWEEN 5000 AND 200000) SELECT * FROM s WHERE parties >= 3 AND total > 100000")
def aml_fan_out(spark, sf_dir):
    return d.fan(transfers(spark, sf_dir), "sender", "receiver", 5_000, 200_000, 6 * HOUR, 3, 100_000)


@query("aml_fan_in", f"WITH {T}, s AS (SELECT txn, receiver, len(list_distinct(list(sender) {_w('receiver', 12 * HOUR)}))::BIGINT AS parties, ({_SUM} {_w('receiver', 12 * HOUR)})::DOUBLE AS total FROM t WHERE amount BETWEEN 5000 AND 200000) SELECT * FROM s WHERE parties >= 3 AND total > 100000")
def aml_fan_in(spark, sf_dir):
    return d.fan(transfers(spark, sf_dir), "receiver", "sender", 5_000, 200_000, 12 * HOUR, 3, 100_000)


@query("aml_cooling_off", f"WITH {T}, b AS (SELECT *, sec - lag(sec) OVER (PARTITION BY sender, receiver ORDER BY sec, txn) AS gap FROM t WHERE amount BETWEEN 1000 AND 200000), s AS (SELECT *, (gap BETWEEN 3600 AND 172800)::INTEGER AS spaced FROM b), x AS (SELECT txn, sender, receiver, spaced, (sum(coalesce(spaced, 0)) {_w('sender, receiver', 4 * DAY)})::BIGINT AS n_spaced FROM s) SELECT txn, sender, receiver, n_spaced FROM x WHERE spaced = 1 AND n_spaced >= 2")
def aml_cooling_off(spark, sf_dir):
    return d.cooling_off(transfers(spark, sf_dir), 1_000, 200_000, HOUR, 2 * DAY, 2, 4 * DAY)


@query("aml_chains", f"WITH {T}, h AS (SELECT * FROM t WHERE amount >= 60000) SELECT a.txn, b.txn AS txn2, c.txn AS txn3, a.sender AS source, c.receiver AS target FROM h a JOIN h b ON b.sender = a.receiver AND b.sec > a.sec AND b.sec <= a.sec + 43200 JOIN h c ON c.sender = b.receiver AND c.sec > b.sec AND c.sec <= a.sec + 43200 WHERE b.receiver <> a.sender AND c.receiver <> a.sender AND c.receiver <> a.receiver")
def aml_chains(spark, sf_dir):
    return d.chains(transfers(spark, sf_dir), 60_000, 12 * HOUR)


def _circular(joins: str, path: str, total: str, least: int, repeats: int, span: int) -> str:
    return f"""WITH {T}, m AS (SELECT *, amount::DECIMAL(18,2) AS v FROM t WHERE sender <> receiver), c AS (SELECT {path} AS cycle, z.txn, z.sec, max({total}) AS total FROM {joins} GROUP BY ALL HAVING max({total}) >= {least}),
    r AS (SELECT *, CASE WHEN sec - lag(sec, {repeats - 1}) OVER (PARTITION BY cycle ORDER BY sec, txn::VARCHAR) <= {span} THEN sec END AS alert FROM c)
    SELECT cycle, count(*) AS n_cycles, max(total)::DOUBLE AS largest, min(alert) AS first_alert_at FROM r GROUP BY cycle HAVING min(alert) IS NOT NULL"""


@query("aml_circular", _circular(f"m x JOIN m z ON z.sender = x.receiver AND z.receiver = x.sender AND z.sec > x.sec AND z.sec - x.sec <= {7 * DAY}", "x.sender || '>' || z.sender", "x.v + z.v", 20_000, 3, 7 * DAY))
def aml_circular(spark, sf_dir):
    """Money that comes straight back, three times in seven days."""
    found = cycles.circular_payments(transfers(spark, sf_dir), 2, 20_000, 7 * DAY, 3)
    return found.withColumn("cycle", F.array_join("cycle", ">"))


@query(
    "aml_merchant_cycles",
    _circular(
        f"m x JOIN m y ON y.sender = x.receiver AND y.receiver <> x.sender AND y.sec > x.sec JOIN m z ON z.sender = y.receiver AND z.receiver = x.sender AND z.sec > y.sec AND z.sec - x.sec <= {14 * DAY}",
        "x.sender || '>' || y.sender || '>' || z.sender", "x.v + y.v + z.v", 50_000, 3, 14 * DAY,
    ),
)
def aml_merchant_cycles(spark, sf_dir):
    """Money that comes back over two others, at a scale of these amounts: 50,000 a cycle, three times in fourteen days."""
    found = cycles.circular_payments(transfers(spark, sf_dir), 3, 50_000, 14 * DAY, 3)
    return found.withColumn("cycle", F.array_join("cycle", ">"))


@query(
    "fraud_velocity",
    f"WITH {T} SELECT a.txn, a.sender, count(*) AS agg_velocity_12h, round(sum(pow(2, (b.sec - a.sec) / 10800)), 6) AS agg_velocity_12h_decayed FROM t a JOIN t b ON b.sender = a.sender AND b.sec BETWEEN a.sec - 43200 AND a.sec GROUP BY 1, 2",
)
def fraud_velocity(spark, sf_dir):
    return d.decayed_velocity(transfers(spark, sf_dir)).withColumn("agg_velocity_12h_decayed", F.round("agg_velocity_12h_decayed", 6))


@query(
    "aml_new_sender_wave",
    f"""WITH {T}, y AS (SELECT * FROM t WHERE amount BETWEEN 20000 AND 149999 AND sec - (1704067200 + sender % 20 * 86400) BETWEEN 0 AND 7 * 86400 - 1),
    s AS (SELECT txn, receiver, len(list_distinct(list(sender) {_w('receiver', 12 * HOUR)}))::BIGINT AS parties, ({_SUM} {_w('receiver', 12 * HOUR)})::DOUBLE AS total FROM y) SELECT * FROM s WHERE parties >= 2""",
)
def aml_new_sender_wave(spark, sf_dir):
    """Accounts opened on the first twenty days of the year."""
    t = transfers(spark, sf_dir)
    opened = t.select("sender").distinct().withColumn("opened_at", F.lit(1_704_067_200) + F.col("sender") % 20 * DAY)
    return d.new_sender_wave(t, opened, 20_000, 149_999, 7, 12 * HOUR, 2)


@query(
    "aml_gathered_withdrawal",
    f"""WITH {T}, m AS (SELECT txn, receiver AS account, sender AS agent, kind, floor(amount / 10000) * 10000 AS amount, sec FROM t),
    s AS (SELECT *, len(list_distinct(list_filter(list(CASE WHEN kind = 'in' AND amount = 10000 THEN agent END) {_w('account', 2 * DAY)}, lambda x: x IS NOT NULL)))::BIGINT AS n_agents FROM m) SELECT txn, account, n_agents FROM s WHERE kind = 'out' AND amount >= 50000 AND n_agents >= 2""",
)
def aml_gathered_withdrawal(spark, sf_dir):
    """Receivers as accounts, senders as agents, amounts to the ten thousand below."""
    t = transfers(spark, sf_dir)
    moves = t.select("txn", F.col("receiver").alias("account"), F.col("sender").alias("agent"), "kind", (F.floor(F.col("amount") / 10_000) * 10_000).cast("double").alias("amount"), "at")
    return d.gathered_withdrawal(moves, 10_000, 2, 2 * DAY, 50_000)


@query(
    "aml_chains_to_bank",
    f"""WITH {T}, h AS (SELECT * FROM t WHERE amount >= 50000), c AS (SELECT a.txn, b.txn AS txn2, c.txn AS txn3, a.sender AS source, c.receiver AS target, a.sec AS at FROM h a JOIN h b ON b.sender = a.receiver AND b.sec > a.sec AND b.sec <= a.sec + 43200
    JOIN h c ON c.sender = b.receiver AND c.sec > b.sec AND c.sec <= a.sec + 43200 WHERE b.receiver <> a.sender AND c.receiver <> a.sender AND c.receiver <> a.receiver)
    SELECT DISTINCT c.* FROM c JOIN t k ON k.sender = c.target AND k.txn % 3 = 0 AND k.sec BETWEEN c.at AND c.at + 43200""",
)
def aml_chains_to_bank(spark, sf_dir):
    """Every third transfer goes to a bank."""
    t = transfers(spark, sf_dir)
    bank = t.filter(F.col("txn") % 3 == 0).select(F.col("sender").alias("account"), F.col("at").alias("at2"))
    return d.to_bank(d.chains(t, 50_000, 12 * HOUR, keep_time=True), bank, 12 * HOUR)


@query("aml_large_cash", f"WITH {T} SELECT sender, strftime(ts, '%Y-%m-%d') AS day, {_SUM}::DOUBLE AS day_sum, max(amount) AS largest FROM t GROUP BY 1, 2 HAVING max(amount) > 400000 OR {_SUM} >= 400000")
def aml_large_cash(spark, sf_dir):
    return d.large_cash(transfers(spark, sf_dir), 400_000)


@query("aml_rolling_sum", f"WITH {T}, s AS (SELECT txn, sender, ({_SUM} {_w('sender', 10 * DAY)})::DOUBLE AS window_sum FROM t) SELECT * FROM s WHERE window_sum > 1500000")
def aml_rolling_sum(spark, sf_dir):
    return d.rolling_sum_alert(transfers(spark, sf_dir), 1_500_000, 10 * DAY)


@query(
    "aml_replays",
    f"""WITH {T}, x AS (SELECT a.sender, a.place, b.place AS earlier_request, row_number() OVER (PARTITION BY a.txn ORDER BY b.sec DESC, b.place DESC) AS n
    FROM t a JOIN t b ON b.sender = a.sender AND b.place <> a.place AND a.sec - b.sec <= 7200 AND (b.sec < a.sec OR b.sec = a.sec AND b.place < a.place)) SELECT sender, place, earlier_request FROM x WHERE n = 1""",
)
def aml_replays(spark, sf_dir):
    """Places as requests: runs of the same one, of which each row has been preceded by another."""
    return d.replays(transfers(spark, sf_dir), "sender", "place", 2 * HOUR)


@query(
    "fraud_features",
    f"""WITH {T}, s AS (SELECT txn, sender, receiver, amount, count(*) {_w("sender", HOUR)} AS n_1h, count(*) {_w("sender", DAY)} AS n_24h, ({_SUM} {_w("sender", HOUR)})::DOUBLE AS sum_1h, ({_SUM} {_w("sender", DAY)})::DOUBLE AS sum_24h,
    count(*) {_w("receiver", DAY)} AS in_n_24h, ({_SUM} {_w("receiver", DAY)})::DOUBLE AS in_sum_24h, avg(amount) {_w("sender", 30 * DAY)} AS m, stddev_samp(amount) {_w("sender", 30 * DAY)} AS s FROM t)
    SELECT txn, sender, receiver, n_1h, n_24h, sum_1h, sum_24h, in_n_24h, in_sum_24h, round(CASE WHEN s > 0 THEN (amount - m) / s ELSE 0.0 END, 6) AS z_30d FROM s""",
)
def fraud_features(spark, sf_dir):
    return d.fraud_features(transfers(spark, sf_dir))


def accounts(spark):
    """Profiles of the 150 users."""
    i = F.col("id")
    return spark.range(150).select(
        i.alias("account"), (i % 5).alias("county"), (i % 8 * 0.5 - 4.0).alias("lat"), (i % 6 * 0.5 + 34.0).alias("lon"), (F.lit(1_700_000_000) - i * 40_000).alias("opened_at"), (F.lit(1_702_000_000) - i * 9_000).alias("device_at"),
        (i % 9 != 0).alias("sim_match"), (i % 4 + 1).alias("tier"), (i % 3).alias("kyc"), F.when(i % 10 == 0, 2).alias("frauds_90d"),
    )


@query(
    "fraud_features_full",
    f"""WITH {T}, a AS (SELECT range AS account, range % 5 AS county, range % 8 * 0.5::DOUBLE - 4.0 AS lat, range % 6 * 0.5::DOUBLE + 34.0 AS lon, 1700000000 - range * 40000 AS opened_at, 1702000000 - range * 9000 AS device_at,
      range % 9 <> 0 AS sim_match, range % 4 + 1 AS tier, range % 3 AS kyc, CASE WHEN range % 10 = 0 THEN 2 ELSE 0 END AS frauds FROM range(150)),
    p AS (SELECT *, ts::DATE AS day, (['stk_push', 'b2c', 'p2p', 'agent_float'])[txn % 4 + 1] AS channel FROM t),
    q AS (SELECT x.txn, count(*) FILTER (y.amount <= x.amount) / nullif(count(y.txn), 0) AS pc FROM p x LEFT JOIN p y ON y.sender = x.sender AND y.day BETWEEN x.day - 7 AND x.day - 1 GROUP BY x.txn),
    e AS (SELECT a.txn, sum(pow(2, (b.sec - a.sec) / 10800)) AS decayed FROM t a JOIN t b ON b.sender = a.sender AND b.sec BETWEEN a.sec - 43200 AND a.sec GROUP BY 1),
    w AS (SELECT *, count(*) {_w("sender", HOUR)} AS s1, count(*) {_w("sender", DAY)} AS s24, count(*) {_w("sender", 12 * HOUR)} AS v12, ({_SUM} {_w("sender", HOUR)})::DOUBLE AS v1, ({_SUM} {_w("sender", DAY)})::DOUBLE AS v24, count(*) {_w("receiver", HOUR)} AS r1, count(*) {_w("receiver", DAY)} AS r24,
      ({_SUM} {_w("receiver", HOUR)})::DOUBLE AS rv, count(*) {_w("agent", HOUR)} AS a1, coalesce((sum(CASE WHEN kind = 'in' THEN amount::DECIMAL(18,2) END) {_w("agent", 3 * HOUR)})::DOUBLE, 0) - coalesce((sum(CASE WHEN kind = 'out' THEN amount::DECIMAL(18,2) END) {_w("agent", 3 * HOUR)})::DOUBLE, 0) AS growth,
      coalesce((sum(CASE WHEN kind = 'in' THEN amount::DECIMAL(18,2) END) {_w("agent", 6 * HOUR)})::DOUBLE, 0) AS ci, coalesce((sum(CASE WHEN kind = 'out' THEN amount::DECIMAL(18,2) END) {_w("agent", 6 * HOUR)})::DOUBLE, 0) AS co,
      len(list_distinct(list(place) {_w("sender", DAY)}))::BIGINT AS sc, len(list_distinct(list(place) {_w("receiver", DAY)}))::BIGINT AS rc, avg(amount) {_w("sender", 30 * DAY)} AS m, stddev_samp(amount) {_w("sender", 30 * DAY)} AS d,
      sec - lag(sec) OVER (PARTITION BY sender ORDER BY sec, txn) AS gap, ({_SUM} OVER (PARTITION BY sender, day ORDER BY sec, txn ROWS UNBOUNDED PRECEDING))::DOUBLE AS spent FROM p),
    j AS (SELECT w.*, q.pc, s.county = r.county AS same, s.opened_at, s.device_at, s.sim_match, s.tier, s.kyc, s.frauds,
      2 * 6371.0::DOUBLE * asin(least(sqrt(pow(sin((radians(r.lat) - radians(s.lat)) / 2), 2) + cos(radians(s.lat)) * cos(radians(r.lat)) * pow(sin((radians(r.lon) - radians(s.lon)) / 2), 2)), 1.0)) AS km
      FROM w JOIN q USING (txn) LEFT JOIN a s ON s.account = w.sender LEFT JOIN a r ON r.account = w.receiver)
    SELECT txn, amount AS txn_amount, round(ln(1 + amount), 5) AS log_amount, round(pc, 5) AS amount_percentile_7d, round(CASE WHEN d > 0 THEN (amount - m) / d ELSE 0.0 END, 5) AS amount_zscore_30d, hour(ts)::BIGINT AS hour_of_day, isodow(ts)::BIGINT AS day_of_week, (isodow(ts) >= 6)::BIGINT AS is_weekend,
    gap / 86400 AS days_since_last_txn, round(s1 / 60, 5) AS txn_frequency_1h, s1 AS txn_count_1h_sender, s24 AS txn_count_24h_sender, v1 AS sum_amount_1h_sender, v24 AS sum_amount_24h_sender, r1 AS txn_count_1h_receiver, r24 AS txn_count_24h_receiver, rv AS sum_amount_1h_receiver,
    a1 AS agent_txn_count_1h, round(growth, 2) AS agent_float_growth_3h, round(CASE WHEN co > 0 THEN ci / co END, 5) AS agent_cash_in_out_ratio_6h, sc AS sender_counties_24h, rc AS receiver_counties_24h, round(km, 3) AS sender_receiver_distance_km, coalesce(same, false)::BIGINT AS is_same_county,
    (channel = 'stk_push')::BIGINT AS is_stk_push, (channel = 'b2c')::BIGINT AS is_b2c, (channel = 'p2p')::BIGINT AS is_p2p, (channel = 'agent_float')::BIGINT AS is_agent_float, (sec - device_at) / 86400 AS device_age_days, coalesce(sim_match, false)::BIGINT AS sim_match_status,
    (sec - opened_at) / 86400 AS account_age_days, tier::BIGINT AS wallet_tier_encoded, kyc::BIGINT AS kyc_level_encoded, coalesce(frauds, 0)::BIGINT AS prev_fraud_flag_count_90d, (amount BETWEEN 140000 AND 149999)::BIGINT AS amount_near_threshold, (amount > 0 AND amount % 100000 = 0)::BIGINT AS is_round_number_100k,
    round(greatest(0.0, 1 - spent / 500000), 5) AS daily_cumulative_remaining_pct, round(amount * s24, 2) AS amount_x_velocity, amount * ((sec - opened_at) / 86400) AS amount_x_account_age, round((150000 - amount) * ln(s1 + 1), 3) AS threshold_proximity_x_velocity, v12 AS agg_velocity_12h, round(e.decayed, 5) AS agg_velocity_12h_decayed FROM j JOIN e USING (txn)""",
)
def fraud_features_full(spark, sf_dir):
    channel = F.element_at(F.array(*map(F.lit, ("stk_push", "b2c", "p2p", "agent_float"))), (F.col("txn") % 4 + 1).cast("int"))
    out = fraud.features(transfers(spark, sf_dir).withColumn("channel", channel), accounts(spark))
    places = {"agent_float_growth_3h": 2, "sender_receiver_distance_km": 3, "amount_x_velocity": 2, "threshold_proximity_x_velocity": 3}
    exact = {"txn_amount", "days_since_last_txn", "device_age_days", "account_age_days", "amount_x_account_age", "sum_amount_1h_sender", "sum_amount_24h_sender", "sum_amount_1h_receiver"}
    return out.withColumns({c: F.round(c, places.get(c, 5)) for c, kind in out.dtypes if kind == "double" and c not in exact})


@query("risk_tiers", """SELECT event_id, CASE WHEN score <= 0.30 THEN 'low' WHEN score <= 0.65 THEN 'medium' WHEN score <= 0.85 THEN 'high' ELSE 'critical' END AS tier, score >= 0.70 AS escalate
  FROM (SELECT event_id, floor(value)::INTEGER % 101 / 100::DOUBLE AS score FROM events UNION ALL SELECT -event_id - 1, value / 500 FROM events)""")
def risk_tiers(spark, sf_dir):
    """Scores of whole hundredths, so that every limit is met, and others."""
    e = read_table(spark, sf_dir, "events")
    risk = e.select("event_id", (F.floor("value") % 101 / 100).alias("score")).union(e.select(-F.col("event_id") - 1, F.col("value") / 500))
    return risk.select("event_id", d.risk_tier(F.col("score")).alias("tier"), d.escalates(F.col("score"), 0.70).alias("escalate"))


@query("credit_decisions", "SELECT event_id, CASE WHEN value / 500 >= 0.14 THEN 'DECLINE' WHEN value / 500 >= 0.09 THEN 'REFER' ELSE 'APPROVE' END AS recommendation, concat_ws(',', CASE WHEN value > 50 THEN 'RC-001' END, CASE WHEN value < 40 THEN 'RC-102' END) AS codes FROM events")
def credit_decisions(spark, sf_dir):
    """Contributions made up from the value: income speaks against, repayment for the account."""
    e = read_table(spark, sf_dir, "events")
    c = F.create_map(F.lit("avg_monthly_income_6m"), F.when(F.col("value") > 50, 0.05).otherwise(0.0), F.lit("fuliza_repayment_rate"), F.when(F.col("value") < 40, -0.03).otherwise(0.0))
    return e.select("event_id", d.credit_decision(F.col("value") / 500).alias("recommendation"), F.array_join(d.reason_codes(c), ",").alias("codes"))


@query("quarantine_alerts", "SELECT c_nationkey, count(*) AS checked, count_if(c_acctbal < 0)::BIGINT AS held, count_if(c_acctbal < 0) / count(*) > 0.05 OR count_if(c_acctbal < 0) > 1000 AS alert FROM customer GROUP BY 1")
def quarantine_alerts(spark, sf_dir):
    """By share of a group, or by more than 1,000 rows of it."""
    c = read_table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("checked"), F.count_if(F.col("c_acctbal") < 0).alias("held"))
    return c.withColumn("alert", (F.col("held") / F.col("checked") > 0.05) | (F.col("held") > 1000))


def sent_callbacks(spark, sf_dir):
    """Events as callbacks, every third a payout: some receipts, numbers, amounts and times break the contract, some result codes are missing or failures, some payloads are cut off."""
    e = read_table(spark, sf_dir, "events")
    i = F.col("event_id")
    receipt = F.when(i % 11 == 3, F.lit("short")).otherwise(F.concat(F.lit("R"), F.lpad((i * 7919).cast("string"), 9, "0")))
    phone = F.concat(F.element_at(F.array(*map(F.lit, ("2547", "07", "7", "+2541", "2559"))), (i % 5 + 1).cast("int")), F.lpad(F.col("user_id").cast("string"), 8, "0"))
    amount = F.when(i % 17 == 0, F.lit("none")).when(i % 13 == 0, F.lit("-5")).otherwise(F.concat((F.floor("value") * F.when(i % 37 == 0, 2000).otherwise(1)).cast("string"), F.lit(".129")))
    when = F.when(i % 19 == 0, F.lit("20990101000000")).when(i % 23 == 0, F.lit("soon")).otherwise(F.date_format("ts", "yyyyMMddHHmmss"))
    code = F.when(i % 29 == 0, F.lit(None).cast("int")).when(i % 7 == 0, F.lit(1)).otherwise(F.lit(0))
    item = lambda key, n, v: F.struct(F.lit(n).alias(key), v.cast("string").alias("Value"))
    items = F.array(*[item("Name", n, v) for n, v in (("Amount", amount), ("MpesaReceiptNumber", receipt), ("PhoneNumber", phone), ("TransactionDate", when))])
    body = F.struct(F.concat(F.lit("m"), i).alias("MerchantRequestID"), F.concat(F.lit("c"), i).alias("CheckoutRequestID"), code.alias("ResultCode"), F.struct(items.alias("Item")).alias("CallbackMetadata"))
    given = (("TransactionAmount", amount), ("TransactionReceipt", receipt), ("B2CPartyName", F.concat(phone, F.lit(" - Jo Doe-Roe"))), ("B2CChargesPaidAccount", -(i % 50)), ("B2CWorkingAccountAvailableFunds", i * 10))
    result = F.struct(F.concat(F.lit("c"), i).alias("OriginatorConversationID"), F.concat(F.lit("v"), i).alias("ConversationID"), code.alias("ResultCode"), F.struct(F.array(*[item("Key", n, v) for n, v in given]).alias("ResultParameter")).alias("ResultParameters"))
    payload = F.when(i % 3 == 0, F.to_json(F.struct(result.alias("Result")))).otherwise(F.to_json(F.struct(F.struct(body.alias("stkCallback")).alias("Body"))))
    return e.select("event_id", F.when(i % 41 == 0, F.substring(payload, 1, 40)).otherwise(payload).alias("payload"))


CALLBACKS = r"""e AS (SELECT event_id, event_id % 41 = 0 AS cut, CASE WHEN event_id % 3 = 0 THEN 'b2c' ELSE 'stk' END AS kind, CASE WHEN event_id % 29 = 0 THEN NULL WHEN event_id % 7 = 0 THEN 1 ELSE 0 END AS code,
  CASE WHEN event_id % 11 = 3 THEN 'short' ELSE 'R' || lpad((event_id * 7919)::VARCHAR, 9, '0') END AS receipt,
  CASE WHEN event_id % 17 = 0 THEN NULL WHEN event_id % 13 = 0 THEN -5.0 ELSE floor(value) * CASE WHEN event_id % 37 = 0 THEN 2000 ELSE 1 END + 0.12 END AS amount,
  CASE WHEN event_id % 5 = 4 THEN NULL ELSE '254' || CASE WHEN event_id % 5 = 3 THEN '1' ELSE '7' END || lpad(user_id::VARCHAR, 8, '0') END AS phone, -(event_id % 50) AS charges,
  event_id % 3 > 0 AND event_id % 19 = 0 AS future, event_id % 3 > 0 AND event_id % 19 <> 0 AND event_id % 23 = 0 AS no_time FROM events),
k AS (SELECT event_id, CASE WHEN NOT cut THEN kind END AS kind, CASE WHEN NOT cut THEN code END AS code, CASE WHEN NOT cut THEN receipt END AS receipt, CASE WHEN NOT cut THEN amount END AS amount, CASE WHEN NOT cut THEN phone END AS phone,
  CASE WHEN NOT cut AND kind = 'b2c' THEN charges END AS charges, CASE WHEN NOT cut AND kind = 'b2c' THEN 'Jo Doe-Roe' END AS party_name, future AND NOT cut AS future, no_time FROM e),
v AS (SELECT *, CASE WHEN code IS NULL THEN concat_ws(',', CASE WHEN receipt IS NULL THEN 'receipt' END, CASE WHEN amount IS NULL THEN 'amount' END) WHEN code <> 0 THEN '' ELSE concat_ws(',', CASE WHEN NOT regexp_full_match(receipt, '[A-Z0-9]{10}') THEN 'receipt' END,
  CASE WHEN coalesce(amount < 1 OR amount > CASE WHEN kind = 'b2c' THEN 500000 ELSE 150000 END, true) THEN 'amount' END, CASE WHEN phone IS NULL THEN 'msisdn' END, CASE WHEN future THEN 'future' END) END AS reasons FROM k)"""


@query(
    "callback_payload",
    f"""WITH {CALLBACKS} SELECT event_id, kind, receipt, round(amount, 2)::DOUBLE AS amount, charges::DOUBLE AS charges, party_name, phone AS msisdn, code AS result_code, reasons, CASE WHEN reasons <> '' THEN 'reject' WHEN code IS NULL THEN 'review' WHEN code <> 0 THEN 'failed' ELSE 'accept' END AS verdict,
    coalesce(code = 0 AND no_time, false) AS no_time FROM v""",
)
def callback_payload(spark, sf_dir):
    v = callbacks.validate(sent_callbacks(spark, sf_dir), F.lit("2026-01-01 00:00:00"))
    no_time = F.coalesce("no_time", F.lit(False))
    return v.select("event_id", "kind", "receipt", "amount", "charges", "party_name", "msisdn", "result_code", F.array_join("reasons", ",").alias("reasons"), "verdict", no_time.alias("no_time"))


@query(
    "callback_flags",
    f"""WITH {CALLBACKS}, r AS (SELECT event_id, floor(value) * CASE WHEN event_id % 37 = 0 THEN 2000 ELSE 1 END + CASE WHEN event_id % 4 = 0 THEN 2 ELSE 0 END AS asked FROM events WHERE event_id % 31 <> 0), x AS (SELECT v.*, r.asked, r.event_id AS known FROM v LEFT JOIN r ON r.event_id = v.event_id AND kind IS NOT NULL)
    SELECT event_id, 'ORPHAN_CALLBACK' AS flag FROM x WHERE known IS NULL UNION ALL SELECT event_id, 'INCONSISTENT_B2C_STATE' FROM x WHERE code <> 0 AND kind = 'b2c' UNION ALL SELECT event_id, 'AMOUNT_INTEGRITY_FAILURE' FROM x WHERE code = 0 AND abs(amount - asked) >= 1""",
)
def callback_flags(spark, sf_dir):
    """Every request stands twice; what was asked is off by two for every fourth."""
    e = read_table(spark, sf_dir, "events").filter(F.col("event_id") % 31 != 0)
    value = F.floor("value") * F.when(F.col("event_id") % 37 == 0, 2000).otherwise(1)
    asked = e.select(F.concat(F.lit("c"), F.col("event_id")).alias("checkout_request_id"), (value + F.when(F.col("event_id") % 4 == 0, 2).otherwise(0)).cast("double").alias("requested_amount"))
    v = callbacks.validate(sent_callbacks(spark, sf_dir), F.lit("2026-01-01 00:00:00"))
    return callbacks.reconcile(v, asked.union(asked)).select("event_id", "flag")


@query("amount_mismatch", "SELECT o_orderkey, round(o_totalprice - coalesce(p, 0), 2) AS difference FROM orders LEFT JOIN (SELECT l_orderkey, sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS p FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey WHERE abs(o_totalprice - coalesce(p, 0)) >= 1")
def amount_mismatch(spark, sf_dir):
    """Orders whose lines do not add up to their total."""
    lines = read_table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(d.money("l_extendedprice").cast("double").alias("p"))
    gap = F.col("o_totalprice") - F.coalesce("p", F.lit(0.0))
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return o.filter(F.abs(gap) >= 1).select("o_orderkey", F.round(gap, 2).alias("difference"))
