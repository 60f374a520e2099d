"""The features of the fraud score: 38 per transfer and two rolling counts, over trailing windows and the accounts of both sides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymill.operators.detection import DAY, HOUR, money
from tallymill.operators.trailing import Decayed, Different, Total, cents, deviation, squares, with_trailing

# The limit of a transfer, the band just below it, the round amount, a day's cap, and the channels with a flag of their own.
LIMIT, NEAR_LOW, NEAR_HIGH, ROUND, DAILY_CAP = 150_000, 140_000, 149_999, 100_000, 500_000
CHANNELS = {"is_stk_push": "stk_push", "is_b2c": "b2c", "is_p2p": "p2p", "is_agent_float": "agent_float"}
EARTH_KM = 6371.0
#: Seconds after which a transfer counts half in the decayed rolling count.
HALF_LIFE = 3 * HOUR


def distance_km(a: str, b: str) -> Column:
    """Great-circle distance of two structs with lat and lon in degrees."""
    lat = lambda x: F.radians(f"{x}.lat")
    lon = lambda x: F.radians(f"{x}.lon")
    h = F.pow(F.sin((lat(b) - lat(a)) / 2), 2) + F.cos(lat(a)) * F.cos(lat(b)) * F.pow(F.sin((lon(b) - lon(a)) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.least(F.sqrt(h), F.lit(1.0)))


def percentile_7d(t: DataFrame) -> DataFrame:
    """(sender, day, amount, amount_percentile_7d): the share of the sender's transfers on the seven days before of no higher amount; null without any.

    Counted by day and amount first, and every count is carried to the seven
    days it is asked on, so the work is eight rows a transfer at most and not the pairs of them.
    """
    by = t.groupBy("sender", "day", "amount").agg(F.count(F.lit(1)).alias("n"))
    ahead = by.select("sender", F.explode(F.sequence(F.lit(1), F.lit(7))).alias("k"), "day", "amount", "n")
    past = ahead.select("sender", F.date_add("day", F.col("k")).alias("day"), "amount", "n", F.lit(False).alias("asked"))
    both = past.unionByName(by.withColumns({"n": F.lit(0).cast("long"), "asked": F.lit(True)})).groupBy("sender", "day", "amount").agg(F.sum("n").alias("n"), F.bool_or("asked").alias("asked"))
    whole = Window.partitionBy("sender", "day")
    upto = F.sum("n").over(whole.orderBy("amount").rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("n").over(whole)
    return both.withColumn("amount_percentile_7d", F.when(total > 0, upto / total)).filter("asked").drop("n", "asked")


def features(t: DataFrame, accounts: DataFrame) -> DataFrame:
    """From (txn, sender, receiver, agent, place, channel, kind, amount, ts, at) and (account, county, lat, lon, opened_at, device_at, sim_match, tier, kyc, frauds_90d): txn and its features.

    Of an account with several profiles the greatest counts, compared column by
    column as they stand. Amounts count to the cent.
    """
    profile = accounts.groupBy("account").agg(F.max(F.struct(*[c for c in accounts.columns if c != "account"])).alias("about"))
    s = t.join(profile.toDF("sender", "s"), "sender", "left").join(profile.toDF("receiver", "r"), "receiver", "left").withColumn("day", F.to_date("ts"))
    one, amount = F.lit(1).cast("long"), cents("amount")
    cash = lambda kind: F.when(F.col("kind") == kind, amount)
    sent = {
        "txn_count_1h_sender": Total(HOUR, one), "txn_count_24h_sender": Total(DAY, one), "sum_amount_1h_sender": Total(HOUR, amount), "sum_amount_24h_sender": Total(DAY, amount),
        "sender_counties_24h": Different(DAY, "place"), "agg_velocity_12h": Total(12 * HOUR, one), "agg_velocity_12h_decayed": Decayed(12 * HOUR, HALF_LIFE),
    }
    month = {"__n": Total(30 * DAY, one), "__sum": Total(30 * DAY, amount), "__squares": Total(30 * DAY, squares("amount"))}
    got = {"txn_count_1h_receiver": Total(HOUR, one), "txn_count_24h_receiver": Total(DAY, one), "sum_amount_1h_receiver": Total(HOUR, amount), "receiver_counties_24h": Different(DAY, "place")}
    agent = {"agent_txn_count_1h": Total(HOUR, one), **{f"__{kind}_{n}h": Total(n * HOUR, cash(kind)) for kind in ("in", "out") for n in (3, 6)}}
    for key, stats in (("sender", sent), ("sender", month), ("receiver", got), ("agent", agent)):
        s = with_trailing(s, key, stats)
    number = lambda c: F.col(c).cast("double")
    in_order = Window.partitionBy("sender").orderBy("at", "txn")
    today = Window.partitionBy("sender", "day").orderBy("at", "txn").rowsBetween(Window.unboundedPreceding, 0)
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("long")
    made = {
        "txn_amount": F.col("amount"),
        "log_amount": F.log1p("amount"),
        "__mean": number("__sum") / F.col("__n"),
        "__dev": deviation(F.col("__n"), F.col("__sum"), F.col("__squares")),
        "agent_float_growth_3h": number("__in_3h") - number("__out_3h"),
        **{c: number(c) for c in ("sum_amount_1h_sender", "sum_amount_24h_sender", "sum_amount_1h_receiver")},
        "hour_of_day": F.hour("ts").cast("long"),
        "day_of_week": (F.weekday("ts") + 1).cast("long"),
        "is_weekend": flag(F.weekday("ts") >= 5),
        "days_since_last_txn": (F.col("at") - F.lag("at").over(in_order)) / F.lit(DAY),
        "sender_receiver_distance_km": distance_km("s", "r"),
        "is_same_county": flag(F.col("s.county") == F.col("r.county")),
        **{name: flag(F.col("channel") == channel) for name, channel in CHANNELS.items()},
        "device_age_days": (F.col("at") - F.col("s.device_at")) / F.lit(DAY),
        "sim_match_status": flag(F.col("s.sim_match")),
        "account_age_days": (F.col("at") - F.col("s.opened_at")) / F.lit(DAY),
        "wallet_tier_encoded": F.col("s.tier").cast("long"),
        "kyc_level_encoded": F.col("s.kyc").cast("long"),
        "prev_fraud_flag_count_90d": F.coalesce(F.col("s.frauds_90d"), F.lit(0)).cast("long"),
        "amount_near_threshold": flag(F.col("amount").between(NEAR_LOW, NEAR_HIGH)),
        "is_round_number_100k": flag((F.col("amount") > 0) & (F.col("amount") % ROUND == 0)),
        "daily_cumulative_remaining_pct": F.greatest(F.lit(0.0), 1 - money("amount").over(today).cast("double") / F.lit(DAILY_CAP)),
    }
    s = s.withColumns(made).withColumns({
        "amount_zscore_30d": F.when(F.col("__dev") > 0, (F.col("amount") - F.col("__mean")) / F.col("__dev")).otherwise(F.lit(0.0)),
        "txn_frequency_1h": F.col("txn_count_1h_sender") / F.lit(60.0),
        "agent_cash_in_out_ratio_6h": F.when(F.col("__out_6h") > 0, number("__in_6h") / number("__out_6h")),
        "amount_x_velocity": F.col("amount") * F.col("txn_count_24h_sender"),
        "amount_x_account_age": F.col("amount") * F.col("account_age_days"),
        "threshold_proximity_x_velocity": (F.lit(LIMIT) - F.col("amount")) * F.log1p(F.col("txn_count_1h_sender").cast("double")),
    })
    s = s.join(percentile_7d(s.select("sender", "day", "amount")), ["sender", "day", "amount"], "left")
    return s.select("txn", *FEATURES)


FEATURES = (
    "txn_amount", "log_amount", "amount_percentile_7d", "amount_zscore_30d",
    "hour_of_day", "day_of_week", "is_weekend", "days_since_last_txn", "txn_frequency_1h",
    "txn_count_1h_sender", "txn_count_24h_sender", "sum_amount_1h_sender", "sum_amount_24h_sender",
    "txn_count_1h_receiver", "txn_count_24h_receiver", "sum_amount_1h_receiver",
    "agent_txn_count_1h", "agent_float_growth_3h", "agent_cash_in_out_ratio_6h",
    "sender_counties_24h", "receiver_counties_24h", "sender_receiver_distance_km", "is_same_county",
    *CHANNELS, "device_age_days", "sim_match_status",
    "account_age_days", "wallet_tier_encoded", "kyc_level_encoded", "prev_fraud_flag_count_90d",
    "amount_near_threshold", "is_round_number_100k", "daily_cumulative_remaining_pct",
    "amount_x_velocity", "amount_x_account_age", "threshold_proximity_x_velocity",
    "agg_velocity_12h", "agg_velocity_12h_decayed",
)
