"""The 24 inputs of the credit score per wallet, over its ledger, its advances and its profile.

Months are calendar months; the six before the month of ``as_of`` count, those
without a movement too: a wallet's months stand in a calendar of their own, in
which income is zero and the balance the last one known. Continuous dealings
with a party are runs of successive months (gaps and islands), and spells of
delinquency are the union of the times that advances were overdue.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY, MONTHS, RECENT_DAYS = 86_400, 6, 90
# The kinds of movement that features are about.
INCOME = ("p2p", "deposit")
PEER, REMITTANCE, MERCHANT, AIRTIME, CASH, GROUP, UTILITY = "p2p", "remittance", "merchant", "airtime", "withdrawal", "group", "utility"
FEATURES = (
    "avg_monthly_income_6m", "income_volatility_cv", "min_monthly_balance_6m", "savings_rate", "income_growth_trend", "txn_regularity_score",
    "fuliza_repayment_rate", "loan_utilization_ratio", "avg_days_to_repay", "max_delinquency_days", "credit_resurrection_count",
    "avg_txn_amount", "txn_frequency_per_day", "merchant_diversity", "airtime_to_cash_ratio", "savings_group_indicators", "international_remittance_inflow", "utility_payment_regularity",
    "wallet_age_days", "sim_tenure", "feature_phone_indicator",
    "network_density", "reciprocity_score", "trusted_network_size",
)


def _month(ts: Column) -> Column:
    """Months since year 0."""
    return F.year(ts) * 12 + F.month(ts) - 1


def _money(hit: Column | None = None) -> Column:
    amount = F.col("amount").cast("decimal(18,2)")
    return F.coalesce(F.sum(amount if hit is None else F.when(hit, amount)), F.lit(0)).cast("decimal(28,2)")


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a.cast("double") / b.cast("double"))


def monthly_calendar(ledger: DataFrame, as_of: Column, months: int = MONTHS) -> DataFrame:
    """account, step (1 to ``months``, the last the month before that of ``as_of``), income, inflow, balance at the month's end.

    The balance is that of the last movement up to the month's end, null before the first one known.
    """
    last = _month(as_of) - 1
    at = ledger.withColumn("step", _month(F.col("ts")) - last + months).filter(F.col("step") <= months)
    into = F.col("direction") == "in"
    # all that lies before the calendar counts for the balance carried into it
    at = at.withColumn("step", F.greatest("step", F.lit(0)))
    known = F.when(F.col("balance").isNotNull(), F.struct("ts", "txn", F.col("balance").cast("decimal(18,2)").alias("balance")))
    by = at.groupBy("account", "step").agg(_money(into & F.col("kind").isin(*INCOME)).alias("income"), _money(into).alias("inflow"), F.max(known)["balance"].alias("balance"))
    all_steps = ledger.select("account").distinct().withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(months))))
    filled = all_steps.join(by, ["account", "step"], "left")
    carried = F.last("balance", ignorenulls=True).over(Window.partitionBy("account").orderBy("step").rowsBetween(Window.unboundedPreceding, 0))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return filled.select("account", "step", zero("income"), zero("inflow"), carried.alias("balance")).filter(F.col("step") > 0)


def cash_flow(ledger: DataFrame, as_of: Column) -> DataFrame:
    """Level, spread and slope of six months' income, the least month-end balance and what is kept of what comes in."""
    by = monthly_calendar(ledger, as_of).groupBy("account").agg(
        F.sum("income").alias("total"), F.stddev_samp("income").alias("spread"), F.regr_slope("income", "step").alias("income_growth_trend"),
        F.min("balance").cast("double").alias("min_monthly_balance_6m"), F.sum("balance").alias("balances"), F.sum("inflow").alias("inflow"),
    )
    mean = F.col("total").cast("double") / MONTHS
    return by.select("account", mean.alias("avg_monthly_income_6m"), F.when(mean > 0, F.col("spread") / mean).alias("income_volatility_cv"), "min_monthly_balance_6m", _ratio(F.col("balances"), F.col("inflow")).alias("savings_rate"), "income_growth_trend")


def behaviour(ledger: DataFrame, as_of: Column) -> DataFrame:
    """Counts, sums and intervals of the last 90 days; regularity over all days."""
    since = as_of - F.make_dt_interval(days=F.lit(RECENT_DAYS))
    recent = (F.col("ts") > since) & (F.col("ts") <= as_of)
    seconds = lambda c: F.expr(f"timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', {c})")
    gap = lambda *by: (seconds("ts") - F.lag(seconds("ts")).over(Window.partitionBy(*by).orderBy("ts", "txn"))) / F.lit(float(DAY))
    kind, into, out = F.col("kind"), F.col("direction") == "in", F.col("direction") == "out"
    s = ledger.filter(F.col("ts") <= as_of).withColumns({"__gap": gap("account"), "__bill_gap": F.when(kind == UTILITY, gap("account", "kind"))})
    count = lambda hit: F.count_if(hit)
    by = s.groupBy("account").agg(
        F.stddev_samp("__gap").alias("interval"), F.stddev_samp("__bill_gap").alias("utility_payment_regularity"),
        count(recent).alias("n"), _money(recent).alias("sum"), F.count_distinct(F.when(recent & (kind == MERCHANT), F.col("category"))).alias("merchant_diversity"),
        _money(recent & (kind == AIRTIME)).alias("airtime"), _money(recent & (kind == CASH)).alias("cash"), count(recent & (kind == GROUP)).alias("savings_group_indicators"), _money(recent & (kind == GROUP)).alias("savings_group_volume"),
        _money(into & (kind == REMITTANCE)).alias("remitted"), _money(into).alias("inflow"), count(into & (kind == PEER)).alias("peers_in"), count(out & (kind == PEER)).alias("peers_out"),
    )
    return by.select(
        "account", (1 / (1 + F.col("interval"))).alias("txn_regularity_score"), _ratio(F.col("sum"), F.col("n")).alias("avg_txn_amount"), (F.col("n") / RECENT_DAYS).alias("txn_frequency_per_day"), "merchant_diversity",
        _ratio(F.col("airtime"), F.col("cash")).alias("airtime_to_cash_ratio"), "savings_group_indicators", F.col("savings_group_volume").cast("double").alias("savings_group_volume"),
        _ratio(F.col("remitted"), F.col("inflow")).alias("international_remittance_inflow"), "utility_payment_regularity", _ratio(F.col("peers_in"), F.col("peers_out")).alias("reciprocity_score"),
    )


def repayment(advances: DataFrame, as_of: Column) -> DataFrame:
    """From (account, drawn_at, due_at, repaid_at, amount, granted): shares, lags and spells of delinquency, as known at ``as_of``."""
    days = lambda a, b: F.expr(f"timestampdiff(SECOND, {a}, {b})") / F.lit(float(DAY))
    a = advances.filter(F.col("drawn_at") <= as_of).withColumn("__now", as_of)
    a = a.withColumn("repaid_at", F.when(F.col("repaid_at") <= F.col("__now"), F.col("repaid_at"))).withColumn("__until", F.coalesce("repaid_at", "__now"))
    overdue = F.when((F.col("due_at") < F.col("__until")), days("due_at", "__until"))
    settled = (F.col("due_at") <= F.col("__now")) | F.col("repaid_at").isNotNull()
    by = a.groupBy("account").agg(
        F.count_if(settled).alias("judged"), F.count_if(F.col("repaid_at") <= F.col("due_at")).alias("in_time"), _money().alias("drawn"), F.sum(F.col("granted").cast("decimal(18,2)")).alias("granted"),
        F.avg(F.when(F.col("repaid_at").isNotNull(), days("drawn_at", "repaid_at"))).alias("avg_days_to_repay"), F.coalesce(F.max(overdue), F.lit(0.0)).alias("max_delinquency_days"),
    )
    # spells: an overdue time begins a new one where all before it in order of begin have ended
    late = a.filter(F.col("due_at") < F.col("__until"))
    order = Window.partitionBy("account").orderBy("due_at", "__until")
    reach = F.max("__until").over(order.rowsBetween(Window.unboundedPreceding, -1))
    numbered = late.withColumn("__new", (reach.isNull() | (F.col("due_at") > reach)).cast("int"))
    numbered = numbered.withColumn("__spell", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    spells = numbered.groupBy("account", "__spell").agg(F.every(F.col("repaid_at").isNotNull()).alias("over"))
    back = spells.groupBy("account").agg(F.count_if("over").alias("credit_resurrection_count"))
    return by.join(back, "account", "left").select(
        "account", _ratio(F.col("in_time"), F.col("judged")).alias("fuliza_repayment_rate"), _ratio(F.col("drawn"), F.col("granted")).alias("loan_utilization_ratio"), "avg_days_to_repay", "max_delinquency_days",
        F.coalesce("credit_resurrection_count", F.lit(0)).cast("long").alias("credit_resurrection_count"),
    )


def network(ledger: DataFrame, as_of: Column, months: int = MONTHS) -> DataFrame:
    """Different parties a month over six months, and parties dealt with in more than ``months`` successive months."""
    dealt = ledger.filter((F.col("ts") <= as_of) & F.col("party").isNotNull()).select("account", "party", _month(F.col("ts")).alias("month")).distinct()
    last = _month(as_of) - 1
    monthly = dealt.filter(F.col("month").between(last - MONTHS + 1, last)).groupBy("account").agg((F.count(F.lit(1)) / MONTHS).alias("network_density"))
    # in a run of successive months the month less its number stays the same
    run = F.col("month") - F.row_number().over(Window.partitionBy("account", "party").orderBy("month"))
    runs = dealt.withColumn("__run", run).groupBy("account", "party", "__run").agg(F.count(F.lit(1)).alias("n")).groupBy("account", "party").agg(F.max("n").alias("n"))
    trusted = runs.groupBy("account").agg(F.count_if(F.col("n") > months).alias("trusted_network_size"))
    return trusted.join(monthly, "account", "left").select("account", F.coalesce("network_density", F.lit(0.0)).alias("network_density"), "trusted_network_size")


def credit_features(ledger: DataFrame, advances: DataFrame, profiles: DataFrame, as_of: Column) -> DataFrame:
    """The 24 features, and savings_group_volume, for every account of ``profiles`` (account, registered_at, sim_since, feature_phone).

    ``ledger``: (account, txn, ts, party, direction in/out, kind, category, amount, balance after it or null). Movements after
    ``as_of`` and without a time count for nothing. Of an account with several profiles the greatest counts. A feature without
    the rows it needs is null; counts are 0.
    """
    ledger = ledger.filter(F.col("ts") <= as_of)
    about = profiles.groupBy("account").agg(F.max(F.struct("registered_at", "sim_since", "feature_phone")).alias("p"))
    out = about
    for part in (cash_flow(ledger, as_of), behaviour(ledger, as_of), repayment(advances, as_of), network(ledger, as_of)):
        out = out.join(part, "account", "left")
    age = F.expr("CAST(__as_of AS DATE)")
    out = out.withColumn("__as_of", as_of).withColumns(
        {
            "wallet_age_days": F.date_diff(age, F.col("p.registered_at").cast("date")).cast("long"),
            "sim_tenure": F.floor(F.months_between(age, F.col("p.sim_since").cast("date"))).cast("long"),
            "feature_phone_indicator": F.coalesce(F.col("p.feature_phone"), F.lit(False)).cast("long"),
        }
    )
    counts = ("merchant_diversity", "savings_group_indicators", "trusted_network_size", "credit_resurrection_count")
    return out.select("account", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) if c in counts else F.col(c) for c in (*FEATURES, "savings_group_volume")])


def top_factors(contributions: Column, towards_approval: bool, most: int = 3) -> Column:
    """The features of a map from feature to contribution that lower the default probability most (or raise it), with their size; ties by name."""
    signed = F.transform(F.map_entries(contributions), lambda x: F.struct((x["value"] if towards_approval else -x["value"]).alias("by"), x["key"].alias("feature")))
    top = F.slice(F.array_sort(F.filter(signed, lambda x: x["by"] < 0)), 1, most)
    return F.transform(top, lambda x: F.struct(x["feature"].alias("feature"), (-x["by"]).alias("magnitude")))
