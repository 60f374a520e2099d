"""The credit score's inputs over orders as a ledger, lines as advances and customers as profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallymill.operators import credit
from tallymill.plans.registry import query
from tallymill.session import read_table

AS_OF = "2001-06-15 00:00:00"
KINDS = ("p2p", "deposit", "merchant", "airtime", "withdrawal", "group", "remittance", "utility")


def ledger(spark, sf_dir):
    """Orders of 25 customers at a time as the movements of one wallet; every fifth tells no balance."""
    k = F.col("o_orderkey")
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (F.floor(k / 2) % 8 + 1).cast("int"))
    return read_table(spark, sf_dir, "orders").select(
        F.floor(F.col("o_custkey") / 25).alias("account"), k.alias("txn"), F.col("o_orderdate").alias("ts"), (k % 7).alias("party"), F.when(k % 2 == 0, "in").otherwise("out").alias("direction"), kind.alias("kind"),
        F.col("o_orderpriority").alias("category"), F.col("o_totalprice").alias("amount"), F.when(k % 5 > 0, (k * 37 % 100_000).cast("decimal(18,2)")).alias("balance"),
    )


def advances(spark, sf_dir):
    """Lines as advances due after 45 days and repaid after as many as their quantity; every sixth is not repaid."""
    days = lambda n: F.col("l_shipdate") + F.make_dt_interval(days=n)
    paid = F.when(F.col("l_partkey") % 6 > 0, days(F.col("l_quantity").cast("int")))
    return read_table(spark, sf_dir, "lineitem").select(F.floor(F.col("l_orderkey") / 250).alias("account"), F.col("l_shipdate").alias("drawn_at"), days(F.lit(45)).alias("due_at"), paid.alias("repaid_at"), F.col("l_extendedprice").alias("amount"), (F.col("l_extendedprice") * 2).alias("granted"))


def profiles(spark, sf_dir):
    """Customers as profiles: 25 to a wallet."""
    k = F.col("c_custkey")
    return read_table(spark, sf_dir, "customer").select(F.floor(k / 25).alias("account"), F.date_add(F.lit("1995-01-01").cast("date"), F.col("c_nationkey").cast("int")).alias("registered_at"), F.date_add(F.lit("1996-01-01").cast("date"), (k % 900).cast("int")).alias("sim_since"), (k % 3 == 0).alias("feature_phone"))


_CREDIT = f"""WITH p AS (SELECT account, max({{'r': r, 's': s, 'f': f}}) AS p FROM (SELECT c_custkey // 25 AS account, DATE '1995-01-01' + c_nationkey::INTEGER AS r, DATE '1996-01-01' + (c_custkey % 900)::INTEGER AS s, c_custkey % 3 = 0 AS f FROM customer) GROUP BY account),
    l AS (SELECT o_custkey // 25 AS account, o_orderkey AS txn, o_orderdate AS ts, o_orderkey % 7 AS party, o_orderkey % 2 = 0 AS into_it, ({list(KINDS)})[o_orderkey // 2 % 8 + 1] AS kind, o_orderpriority AS category, o_totalprice::DECIMAL(18,2) AS amount,
      CASE WHEN o_orderkey % 5 > 0 THEN (o_orderkey * 37 % 100000)::DECIMAL(18,2) END AS balance FROM orders WHERE o_orderdate <= TIMESTAMP '{AS_OF}'),
    s AS (SELECT account, i AS step, DATE '2000-12-01' + to_months((i - 1)::INTEGER) AS a, DATE '2000-12-01' + to_months(i::INTEGER) AS z FROM (SELECT DISTINCT account FROM l), range(1, 7) AS r(i)),
    m AS (SELECT s.account, s.step, coalesce(sum(amount) FILTER (ts >= a AND into_it AND kind IN ('p2p', 'deposit')), 0)::DOUBLE AS income, coalesce(sum(amount) FILTER (ts >= a AND into_it), 0)::DOUBLE AS inflow,
      arg_max(balance, ts::VARCHAR || lpad(txn::VARCHAR, 12, '0')) FILTER (balance IS NOT NULL)::DOUBLE AS balance FROM s LEFT JOIN l ON l.account = s.account AND l.ts < s.z GROUP BY 1, 2),
    c AS (SELECT account, sum(income) / 6 AS avg_monthly_income_6m, CASE WHEN sum(income) > 0 THEN stddev_samp(income) / (sum(income) / 6) END AS income_volatility_cv, min(balance) AS min_monthly_balance_6m, CASE WHEN sum(inflow) <> 0 THEN sum(balance) / sum(inflow) END AS savings_rate,
      regr_slope(income, step) AS income_growth_trend FROM m GROUP BY 1),
    g AS (SELECT *, epoch(ts) AS e, ts > TIMESTAMP '{AS_OF}' - INTERVAL 90 DAY AS recent, (epoch(ts) - lag(epoch(ts)) OVER (PARTITION BY account ORDER BY ts, txn)) / 86400 AS gap, (epoch(ts) - lag(epoch(ts)) OVER (PARTITION BY account, kind ORDER BY ts, txn)) / 86400 AS kind_gap FROM l),
    b AS (SELECT account, 1 / (1 + stddev_samp(gap)) AS txn_regularity_score, sum(amount) FILTER (recent) / count(*) FILTER (recent) AS avg_txn_amount, count(*) FILTER (recent) / 90 AS txn_frequency_per_day, count(DISTINCT category) FILTER (recent AND kind = 'merchant') AS merchant_diversity,
      coalesce(sum(amount) FILTER (recent AND kind = 'airtime'), 0) / sum(amount) FILTER (recent AND kind = 'withdrawal') AS airtime_to_cash_ratio, count(*) FILTER (recent AND kind = 'group') AS savings_group_indicators, coalesce(sum(amount) FILTER (recent AND kind = 'group'), 0) AS savings_group_volume,
      coalesce(sum(amount) FILTER (into_it AND kind = 'remittance'), 0) / sum(amount) FILTER (into_it) AS international_remittance_inflow, stddev_samp(kind_gap) FILTER (kind = 'utility') AS utility_payment_regularity,
      count(*) FILTER (into_it AND kind = 'p2p') / nullif(count(*) FILTER (NOT into_it AND kind = 'p2p'), 0) AS reciprocity_score FROM g GROUP BY 1),
    v AS (SELECT l_orderkey // 250 AS account, l_shipdate AS drawn, l_shipdate + INTERVAL 45 DAY AS due, CASE WHEN l_partkey % 6 > 0 AND l_shipdate + to_days(l_quantity::INTEGER) <= TIMESTAMP '{AS_OF}' THEN l_shipdate + to_days(l_quantity::INTEGER) END AS repaid, l_extendedprice::DECIMAL(18,2) AS amount,
      (l_extendedprice * 2)::DECIMAL(18,2) AS granted FROM lineitem WHERE l_shipdate <= TIMESTAMP '{AS_OF}'),
    u AS (SELECT *, coalesce(repaid, TIMESTAMP '{AS_OF}') AS til FROM v),
    d AS (SELECT account, count(*) FILTER (repaid <= due) / nullif(count(*) FILTER (due <= TIMESTAMP '{AS_OF}' OR repaid IS NOT NULL), 0) AS fuliza_repayment_rate, sum(amount)::DOUBLE / sum(granted)::DOUBLE AS loan_utilization_ratio, avg((epoch(repaid) - epoch(drawn)) / 86400) AS avg_days_to_repay,
      coalesce(max((epoch(til) - epoch(due)) / 86400) FILTER (due < til), 0) AS max_delinquency_days, bool_or(due < til AND repaid IS NULL) AS open FROM u GROUP BY 1),
    w AS (SELECT account, count(DISTINCT due) AS spells FROM u x WHERE due < til AND NOT EXISTS (SELECT 1 FROM u y WHERE y.account = x.account AND y.due < y.til AND y.due < x.due AND y.til >= x.due) GROUP BY 1),
    pm AS (SELECT DISTINCT account, party, year(ts) * 12 + month(ts) AS mo FROM l),
    r AS (SELECT account, party, max(n) AS n FROM (SELECT account, party, count(*) AS n FROM (SELECT *, mo - row_number() OVER (PARTITION BY account, party ORDER BY mo) AS k FROM pm) GROUP BY account, party, k) GROUP BY 1, 2),
    nt AS (SELECT account, count(*) FILTER (n > 6) AS trusted_network_size FROM r GROUP BY 1), nd AS (SELECT account, count(*) / 6 AS network_density FROM pm WHERE mo BETWEEN 2001 * 12 + 0 AND 2001 * 12 + 5 GROUP BY 1)"""


@query(
    "credit_inputs",
    f"""{_CREDIT}
    SELECT account, round(avg_monthly_income_6m, 4) AS avg_monthly_income_6m, round(income_volatility_cv, 6) AS income_volatility_cv, min_monthly_balance_6m, round(savings_rate, 6) AS savings_rate, round(income_growth_trend, 4) AS income_growth_trend, round(txn_regularity_score, 6) AS txn_regularity_score,
      round(fuliza_repayment_rate, 6) AS fuliza_repayment_rate, round(loan_utilization_ratio, 6) AS loan_utilization_ratio, round(avg_days_to_repay, 6) AS avg_days_to_repay, max_delinquency_days, coalesce(spells, 0) - coalesce(open, false)::BIGINT AS credit_resurrection_count,
      round(avg_txn_amount::DOUBLE, 4) AS avg_txn_amount, round(txn_frequency_per_day, 6) AS txn_frequency_per_day, coalesce(merchant_diversity, 0) AS merchant_diversity, round(airtime_to_cash_ratio::DOUBLE, 6) AS airtime_to_cash_ratio, coalesce(savings_group_indicators, 0) AS savings_group_indicators,
      savings_group_volume::DOUBLE AS savings_group_volume, round(international_remittance_inflow::DOUBLE, 6) AS international_remittance_inflow, round(utility_payment_regularity, 6) AS utility_payment_regularity, round(reciprocity_score, 6) AS reciprocity_score,
      DATE '2001-06-15' - p.r AS wallet_age_days, datesub('month', p.s, DATE '2001-06-15') AS sim_tenure, p.f::BIGINT AS feature_phone_indicator, round(coalesce(network_density, 0), 6) AS network_density, coalesce(trusted_network_size, 0) AS trusted_network_size
    FROM p LEFT JOIN c USING (account) LEFT JOIN b USING (account) LEFT JOIN d USING (account) LEFT JOIN w USING (account) LEFT JOIN nt USING (account) LEFT JOIN nd USING (account)""",
)
def credit_inputs(spark, sf_dir):
    out = credit.credit_features(ledger(spark, sf_dir), advances(spark, sf_dir), profiles(spark, sf_dir), _as_of())
    places = {"avg_monthly_income_6m": 4, "income_growth_trend": 4, "avg_txn_amount": 4}
    exact = {"min_monthly_balance_6m", "max_delinquency_days", "savings_group_volume"}
    return out.withColumns({c: F.round(c, places.get(c, 6)) for c, kind in out.dtypes if kind == "double" and c not in exact})


def _as_of():
    return F.lit(AS_OF).cast("timestamp_ntz")


def _past(spark, sf_dir):
    return ledger(spark, sf_dir).filter(F.col("ts") <= _as_of())


@query("credit_income", f"{_CREDIT} SELECT account, step, income, inflow, balance FROM m")
def credit_income(spark, sf_dir):
    """Six months of every account, those without a movement too."""
    m = credit.monthly_calendar(_past(spark, sf_dir), _as_of())
    return m.select("account", F.col("step").cast("long").alias("step"), *[F.col(c).cast("double").alias(c) for c in ("income", "inflow", "balance")])


@query("credit_network", f"{_CREDIT} SELECT account, round(coalesce(network_density, 0), 6) AS network_density, trusted_network_size FROM nt LEFT JOIN nd USING (account)")
def credit_network(spark, sf_dir):
    return credit.network(_past(spark, sf_dir), _as_of()).withColumn("network_density", F.round("network_density", 6))


@query(
    "credit_features",
    f"{_CREDIT} SELECT account, round(txn_regularity_score, 6) AS txn_regularity_score, round(avg_txn_amount::DOUBLE, 4) AS avg_txn_amount, round(txn_frequency_per_day, 6) AS txn_frequency_per_day, merchant_diversity, round(reciprocity_score, 6) AS reciprocity_score FROM b",
)
def credit_features(spark, sf_dir):
    """The last 90 days, and the regularity and balance of all of them."""
    out = credit.behaviour(_past(spark, sf_dir), _as_of())
    return out.select("account", *[F.round(c, n).alias(c) for c, n in (("txn_regularity_score", 6), ("avg_txn_amount", 4), ("txn_frequency_per_day", 6))], "merchant_diversity", F.round("reciprocity_score", 6).alias("reciprocity_score"))


@query(
    "credit_factors",
    """WITH c AS (SELECT event_id, unnest(['avg_monthly_income_6m', 'savings_rate', 'merchant_diversity', 'txn_regularity_score', 'wallet_age_days']) AS feature, unnest([value / 1000 - 0.05, 0.03 - value / 2000, (event_id % 5)::DOUBLE - 2, 0.0, (event_id % 3)::DOUBLE - 1]) AS v FROM events),
    r AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY v, feature) AS up, row_number() OVER (PARTITION BY event_id ORDER BY -v, feature) AS down FROM c)
    SELECT event_id, coalesce(string_agg(feature, ',' ORDER BY up) FILTER (v < 0 AND up <= 3), '') AS positive, coalesce(string_agg(feature, ',' ORDER BY down) FILTER (v > 0 AND down <= 3), '') AS negative FROM r GROUP BY event_id""",
)
def credit_factors(spark, sf_dir):
    """Contributions made up from events: the three factors that speak most for and against."""
    e, v = read_table(spark, sf_dir, "events"), F.col("value")
    made = {"avg_monthly_income_6m": v / 1000 - 0.05, "savings_rate": 0.03 - v / 2000, "merchant_diversity": (F.col("event_id") % 5).cast("double") - 2, "txn_regularity_score": F.lit(0.0), "wallet_age_days": (F.col("event_id") % 3).cast("double") - 1}
    c = F.create_map(*[x for k, column in made.items() for x in (F.lit(k), column)])
    names = lambda up: F.array_join(F.transform(credit.top_factors(c, up), lambda x: x["feature"]), ",")
    return e.select("event_id", names(True).alias("positive"), names(False).alias("negative"))
