"""Time-window detection rules over transfers (sender, receiver, agent, place, amount, ts)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymill.operators.trailing import Decayed, Different, Total, cents, count_if, deviation, squares, with_trailing

HOUR, DAY = 3600, 86400


def seconds(ts: str | Column) -> Column:
    """Epoch seconds of a time without zone, whatever the session's zone."""
    return F.expr(f"timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', {ts})") if isinstance(ts, str) else F.unix_seconds(ts)


def money(c: str) -> Column:
    return F.sum(F.col(c).cast("decimal(18,2)"))


def threshold_breach(t: DataFrame, single: float = 150_000, daily: float = 500_000) -> DataFrame:
    """Rows above ``single``, or that bring their sender's day above ``daily``."""
    w = Window.partitionBy("sender", F.to_date("ts")).orderBy("at", "txn").rowsBetween(Window.unboundedPreceding, 0)
    s = t.withColumn("day_sum", money("amount").over(w).cast("double"))
    return s.filter((F.col("amount") > single) | (F.col("day_sum") > daily)).select("txn", "sender", "day_sum", F.lit("THRESHOLD_BREACH").alias("flag"))


def velocity(t: DataFrame, count: int, turnover: float) -> DataFrame:
    by = t.groupBy("sender", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n"), money("amount").cast("double").alias("turnover"))
    return by.filter((F.col("n") > count) | (F.col("turnover") > turnover)).withColumn("flag", F.lit("VELOCITY_WARNING"))


def structuring(t: DataFrame, low: float, high: float, pair_count: int, window_sum: float, span: int = 12 * HOUR) -> DataFrame:
    """Amounts just below a limit, several the same day for the same pair, and a large sum in the hours before."""
    pair = Window.partitionBy("sender", "receiver", F.to_date("ts"))
    s = with_trailing(t.withColumn("pair_day", F.count(F.lit(1)).over(pair)), "sender", {"window_sum": Total(span, cents("amount"))})
    s = s.withColumn("window_sum", F.col("window_sum").cast("double"))
    hit = F.col("amount").between(low, high) & (F.col("pair_day") >= pair_count) & (F.col("window_sum") > window_sum)
    return s.filter(hit).select("txn", "sender", "receiver", "pair_day", "window_sum", F.lit("STRUCTURING_SUSPECTED").alias("flag"))


def rapid_escalation(t: DataFrame, days: int, volume: float) -> DataFrame:
    """Accounts whose first days carry more than ``volume``; an account's age counts from its first row."""
    first = t.groupBy("sender").agg(F.min("at").alias("first_at"))
    young = t.join(first, "sender").filter(F.col("at") < F.col("first_at") + days * DAY)
    return young.groupBy("sender").agg(money("amount").cast("double").alias("volume"), F.count(F.lit(1)).alias("n")).filter(F.col("volume") > volume).withColumn("flag", F.lit("RAPID_ESCALATION"))


def float_anomaly(t: DataFrame, growth: float = 500_000, span: int = 3 * HOUR, count: int = 10, each: float = 50_000, ratio: float = 4.0, ratio_span: int = 6 * HOUR) -> DataFrame:
    """Agents whose window's inflow exceeds ``growth`` while they make more than ``count`` transfers of ``each`` or more.

    ``ratio``: of cash in to what is sent in a window of its own, above which the row is marked as of high confidence.
    """
    cash = lambda kind: F.when(F.col("kind") == kind, cents("amount"))
    sent = count_if((F.col("kind") == "out") & (F.col("amount") >= each))
    stats = {"float_growth": Total(span, cash("in")), "n_out": Total(span, sent), "__in": Total(ratio_span, cash("in")), "__out": Total(ratio_span, cash("out"))}
    s = with_trailing(t, "agent", stats)
    s = s.withColumns({"float_growth": F.col("float_growth").cast("double"), "high_confidence": F.col("__in").cast("double") > ratio * F.col("__out").cast("double")})
    hit = (F.col("float_growth") > growth) & (F.col("n_out") > count)
    return s.filter(hit).select("txn", "agent", "float_growth", "n_out", "high_confidence", F.lit("CUCKOO_SMURFING_RISK").alias("flag"))


def geographic(t: DataFrame, places: int, span: int = 12 * HOUR) -> DataFrame:
    s = with_trailing(t, "sender", {"n_places": Different(span, "place")})
    return s.filter(F.col("n_places") > places).select("txn", "sender", "n_places", F.lit("GEOGRAPHIC_ANOMALY").alias("flag"))


def threshold_testing(t: DataFrame, tested: Column, per_week: int) -> DataFrame:
    by = t.filter(tested).groupBy("sender", F.date_format(F.date_trunc("week", "ts"), "yyyy-MM-dd").alias("week")).agg(F.count(F.lit(1)).alias("n"))
    return by.filter(F.col("n") >= per_week).withColumn("flag", F.lit("THRESHOLD_TESTING"))


def fan(t: DataFrame, one: str, many: str, low: float, high: float, span: int, parties: int, total: float) -> DataFrame:
    """Fan-out (one sender, many receivers) or fan-in: amounts in a band, many counterparties, a large sum within the span."""
    s = with_trailing(t.filter(F.col("amount").between(low, high)), one, {"parties": Different(span, many), "total": Total(span, cents("amount"))})
    return s.withColumn("total", F.col("total").cast("double")).filter((F.col("parties") >= parties) & (F.col("total") > total)).select("txn", one, "parties", "total")


def new_sender_wave(t: DataFrame, opened: DataFrame, low: float = 140_000, high: float = 149_999, days: int = 7, span: int = 2 * HOUR, senders: int = 3) -> DataFrame:
    """Receivers that ``senders`` or more accounts younger than ``days`` pay amounts in a band within ``span`` seconds. ``opened``: (sender, opened_at in seconds)."""
    young = t.filter(F.col("amount").between(low, high)).join(opened, "sender").filter((F.col("at") - F.col("opened_at")).between(0, days * DAY - 1))
    s = with_trailing(young, "receiver", {"parties": Different(span, "sender"), "total": Total(span, cents("amount"))})
    return s.withColumn("total", F.col("total").cast("double")).filter(F.col("parties") >= senders).select("txn", "receiver", "parties", "total")


def gathered_withdrawal(t: DataFrame, deposit: float = 100_000, agents: int = 10, span: int = 4 * HOUR, withdrawal: float = 900_000) -> DataFrame:
    """Withdrawals of ``withdrawal`` or more from accounts that got deposits of just ``deposit`` at ``agents`` or more agents in the ``span`` seconds before."""
    paid_in = t.withColumn("__at_agent", F.when((F.col("kind") == "in") & (F.col("amount") == deposit), F.col("agent")))
    s = with_trailing(paid_in, "account", {"n_agents": Different(span, "__at_agent")})
    return s.filter((F.col("kind") == "out") & (F.col("amount") >= withdrawal) & (F.col("n_agents") >= agents)).select("txn", "account", "n_agents")


def to_bank(chains_: DataFrame, bank: DataFrame, span: int = 90 * 60) -> DataFrame:
    """Chains (target, at) whose last account pays a bank (account, at2) within ``span`` seconds of the chain's first hop."""
    in_time = (F.col("at2") >= F.col("at")) & (F.col("at2") <= F.col("at") + span)
    return _within(chains_, bank.select(F.col("account").alias("bank_account"), "at2"), span, ("target", "bank_account"), in_time).select(*chains_.columns).distinct()


def cooling_off(t: DataFrame, low: float, high: float, gap_low: int, gap_high: int, repeats: int, span: int = 12 * HOUR) -> DataFrame:
    """Rows of a pair in a band whose gap to the one before is in a range, ``repeats`` times within the span."""
    banded = t.filter(F.col("amount").between(low, high))
    gap = F.col("at") - F.lag("at").over(Window.partitionBy("sender", "receiver").orderBy("at", "txn"))
    spaced = banded.withColumn("spaced", gap.between(gap_low, gap_high).cast("int"))
    s = with_trailing(spaced, ["sender", "receiver"], {"n_spaced": Total(span, F.col("spaced").cast("long"))})
    return s.filter((F.col("spaced") == 1) & (F.col("n_spaced") >= repeats)).select("txn", "sender", "receiver", "n_spaced")


def _within(a: DataFrame, b: DataFrame, span: int, on: tuple[str, str], where: Column) -> DataFrame:
    """Rows of ``b`` up to ``span`` seconds after rows of ``a``: an interval join by buckets of the span's size, two to probe."""
    left = a.withColumn("__bucket", F.explode(F.array(F.floor(F.col("at") / span), F.floor(F.col("at") / span) + 1)))
    right = b.withColumn("__b", F.floor(F.col("at2") / span))
    return left.join(right, (left[on[0]] == right[on[1]]) & (left["__bucket"] == right["__b"]) & where).drop("__bucket", "__b")


def chains(t: DataFrame, low: float = 145_000, span: int = 90 * 60, keep_time: bool = False) -> DataFrame:
    """Three hops A to B to C to D of ``low`` or more within ``span`` seconds of the first."""
    hop = t.filter(F.col("amount") >= low).select("txn", "sender", "receiver", "at")
    second = hop.toDF("txn2", "s2", "r2", "at2")
    third = hop.toDF("txn3", "s3", "r3", "at2")
    in_time = (F.col("at2") > F.col("at")) & (F.col("at2") <= F.col("at") + span)
    two = _within(hop, second, span, ("receiver", "s2"), in_time).filter(F.col("r2") != F.col("sender")).withColumnRenamed("at2", "mid")
    three = _within(two, third, span, ("r2", "s3"), in_time & (F.col("at2") > F.col("mid")))
    return three.filter((F.col("r3") != F.col("sender")) & (F.col("r3") != F.col("receiver"))).select("txn", "txn2", "txn3", F.col("sender").alias("source"), F.col("r3").alias("target"), *([F.col("at")] if keep_time else []))


def large_cash(t: DataFrame, limit: float) -> DataFrame:
    """A single row, or a sender's day, of more than ``limit``."""
    by = t.groupBy("sender", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(money("amount").cast("double").alias("day_sum"), F.max("amount").alias("largest"))
    return by.filter((F.col("largest") > limit) | (F.col("day_sum") >= limit))


def rolling_sum_alert(t: DataFrame, limit: float, span: int = 30 * DAY) -> DataFrame:
    s = with_trailing(t, "sender", {"window_sum": Total(span, cents("amount"))}).withColumn("window_sum", F.col("window_sum").cast("double"))
    return s.filter(F.col("window_sum") > limit).select("txn", "sender", "window_sum")


def replays(t: DataFrame, receipt: str, request: str, span: int = 90 * DAY) -> DataFrame:
    """Rows whose receipt was seen with another request up to ``span`` seconds before.

    The last row of another request stands before the run of equal requests
    that a row is in, so it is carried along from the run's first row.
    """
    w = Window.partitionBy(receipt).orderBy("at", request)
    before = F.when(F.lag(request).over(w) != F.col(request), F.struct(F.lag("at").over(w).alias("at"), F.lag(request).over(w).alias("request")))
    s = t.withColumn("__before", before)
    s = s.withColumn("__before", F.last("__before", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return s.filter(F.col("at") - F.col("__before.at") <= span).select(receipt, request, F.col("__before.request").alias("earlier_request"))


def fraud_features(t: DataFrame) -> DataFrame:
    """Counts, sums and deviations over trailing hours and days per sender and receiver; fraud.py has all of them."""
    one, amount = F.lit(1).cast("long"), cents("amount")
    out = {f"n_{n}": Total(span, one) for n, span in (("1h", HOUR), ("24h", DAY))} | {f"sum_{n}": Total(span, amount) for n, span in (("1h", HOUR), ("24h", DAY))}
    month = {"__n": Total(30 * DAY, one), "__sum": Total(30 * DAY, amount), "__squares": Total(30 * DAY, squares("amount"))}
    s = with_trailing(t, "sender", out | month)
    s = with_trailing(s, "receiver", {"in_n_24h": Total(DAY, one), "in_sum_24h": Total(DAY, amount)})
    dev = deviation(F.col("__n"), F.col("__sum"), F.col("__squares"))
    z = F.when(dev > 0, (F.col("amount") - F.col("__sum").cast("double") / F.col("__n")) / dev).otherwise(F.lit(0.0))
    sums = {c: F.col(c).cast("double") for c in ("sum_1h", "sum_24h", "in_sum_24h")}
    return s.withColumns({**sums, "z_30d": F.round(z, 6)}).select("txn", "sender", "receiver", "n_1h", "n_24h", "sum_1h", "sum_24h", "in_n_24h", "in_sum_24h", "z_30d")


def decayed_velocity(t: DataFrame, span: int = 12 * HOUR, half_life: int = 3 * HOUR) -> DataFrame:
    """A sender's transfers over the last ``span`` seconds, and the same count with those of one half-life ago counted half."""
    s = with_trailing(t, "sender", {"agg_velocity_12h": Total(span, F.lit(1).cast("long")), "agg_velocity_12h_decayed": Decayed(span, half_life)})
    return s.select("txn", "sender", "agg_velocity_12h", "agg_velocity_12h_decayed")


def risk_tier(score: Column) -> Column:
    """Fixed cut-offs 0.30, 0.65 and 0.85; each belongs to the tier below it. Null without a score."""
    return F.when(score > 0.85, "critical").when(score > 0.65, "high").when(score > 0.30, "medium").when(score <= 0.30, "low")


def escalates(risk: Column, at: float = 0.7) -> Column:
    return risk >= F.lit(at)


def credit_decision(probability: Column) -> Column:
    """Fixed cut-offs of the default probability: 0.14 and above declines, 0.09 and above refers, below approves."""
    return F.when(probability >= 0.14, "DECLINE").when(probability >= 0.09, "REFER").when(probability < 0.09, "APPROVE")


# Codes by feature, with the contribution that they need; at most six are given.
ADVERSE = (("avg_monthly_income_6m", 0.02, "RC-001"), ("fuliza_repayment_rate", 0.02, "RC-002"), ("income_volatility_cv", 0.02, "RC-003"), ("min_monthly_balance_6m", 0.02, "RC-004"), ("max_delinquency_days", 0.02, "RC-005"), ("savings_rate", 0.01, "RC-006"))
FAVOURABLE = (("avg_monthly_income_6m", -0.02, "RC-101"), ("fuliza_repayment_rate", -0.02, "RC-102"), ("savings_rate", -0.02, "RC-103"), ("merchant_diversity", -0.02, "RC-104"), ("txn_regularity_score", -0.02, "RC-105"), ("wallet_age_days", -0.02, "RC-106"))
MOST_CODES = 6


def reason_codes(contributions: Column) -> Column:
    """Codes of a map from feature to contribution, the greatest contributions first, ties by code."""
    ranked = []
    for feature, limit, code in (*ADVERSE, *FAVOURABLE):
        value = F.try_element_at(contributions, F.lit(feature))
        beyond = value > limit if limit > 0 else value < limit
        ranked.append(F.when(beyond, F.struct((-F.abs(value)).alias("by"), F.lit(code).alias("code"))))
    top = F.slice(F.array_sort(F.array_compact(F.array(*ranked))), 1, MOST_CODES)
    return F.transform(top, lambda x: x["code"])
