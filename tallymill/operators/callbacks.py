"""Payment callbacks: payloads of two kinds parsed, validated and held against the requests they answer.

A payload is parsed once, as a VARIANT, and its top-level key tells its kind:
``Body.stkCallback`` for payments (``stk``), ``Result`` for payouts (``b2c``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Formats, limits and flags of the callback contract.
RECEIPT, MSISDN = r"^[A-Z0-9]{10}$", r"^254[17]\d{8}$"
LEAST, MOST, MOST_PAYOUT, SKEW_SECONDS = 1.0, 150_000.0, 500_000.0, 300
STK, B2C = "stk", "b2c"
STK_ITEMS = {"MpesaReceiptNumber": "receipt", "Amount": "amount", "PhoneNumber": "msisdn", "TransactionDate": "paid_at"}
B2C_ITEMS = {
    "TransactionReceipt": "receipt", "TransactionAmount": "amount", "B2CPartyName": "party_name", "B2CRecipientRegisteredMetadata": "recipient_status",
    "B2CChargesPaidAccount": "charges", "B2CUtilityAccountAvailableFunds": "utility_funds", "B2CWorkingAccountAvailableFunds": "working_funds",
}
_STK_ROOT, _B2C_ROOT = "$.Body.stkCallback", "$.Result"


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is made once a row: as the only element of an array, as Spark would make it anew for each place in ``use``."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def parse(payload: Column) -> Column:
    """A struct of the kind, the ids, the result code and the items by name, as strings; null fields where the payload has none, and no kind where it is of neither.

    The first item of a name counts. A payout names its recipient as number and name in one.
    """
    return _bound(F.try_parse_json(payload), _roots)


def _roots(v: Column) -> Column:
    at = lambda path, kind: F.try_variant_get(v, path, kind)
    roots = F.struct(
        at(_STK_ROOT, "variant").isNotNull().alias("stk"),
        at(_B2C_ROOT, "variant").isNotNull().alias("b2c"),
        at(f"{_STK_ROOT}.CallbackMetadata.Item", "array<struct<Name string, Value string>>").alias("stk_items"),
        at(f"{_B2C_ROOT}.ResultParameters.ResultParameter", "array<struct<Key string, Value string>>").alias("b2c_items"),
        at(f"{_STK_ROOT}.MerchantRequestID", "string").alias("merchant_request_id"),
        F.coalesce(at(f"{_STK_ROOT}.CheckoutRequestID", "string"), at(f"{_B2C_ROOT}.OriginatorConversationID", "string")).alias("checkout_request_id"),
        at(f"{_B2C_ROOT}.ConversationID", "string").alias("conversation_id"),
        F.coalesce(at(f"{_STK_ROOT}.ResultCode", "int"), at(f"{_B2C_ROOT}.ResultCode", "int")).alias("result_code"),
    )
    return _bound(roots, _fields)


def _fields(p: Column) -> Column:
    def first(items: Column, key: str, theirs: str) -> Column:
        return F.get(F.filter(items, lambda x: x[key] == theirs), F.lit(0))["Value"]

    def item(name: str) -> Column:
        kinds = ((p["stk_items"], STK_ITEMS, "Name"), (p["b2c_items"], B2C_ITEMS, "Key"))
        return F.coalesce(*[first(items, key, theirs) for items, names, key in kinds for theirs, ours in names.items() if ours == name])

    party = item("party_name")
    return F.struct(
        F.when(p["stk"], STK).when(p["b2c"], B2C).alias("kind"),
        *[p[c].alias(c) for c in ("merchant_request_id", "checkout_request_id", "conversation_id", "result_code")],
        item("receipt").alias("receipt"),
        item("amount").alias("amount"),
        F.coalesce(item("msisdn"), F.regexp_extract(party, r"^\s*(\+?\d+)", 1)).alias("msisdn"),
        item("paid_at").alias("paid_at"),
        F.nullif(F.trim(F.regexp_extract(party, r"^[^-]*-(.*)$", 1)), F.lit("")).alias("party_name"),
        *[item(c).alias(c) for c in ("recipient_status", "charges", "utility_funds", "working_funds")],
    )


def normal_msisdn(number: Column) -> Column:
    """With the country's code: one leading zero goes, 254 comes before numbers of nine digits; null where that gives no valid number."""
    digits = F.regexp_replace(F.trim(number), r"^\+", "")
    local = F.when(digits.startswith("254"), digits).otherwise(F.concat(F.lit("254"), F.regexp_replace(digits, "^0", "")))
    return F.when(local.rlike(MSISDN), local)


def truncated(amount: Column) -> Column:
    """To two decimals, towards zero; null where it is no number."""
    wide = amount.try_cast("decimal(28,6)")
    return (F.when(wide < 0, F.ceil(wide, F.lit(2))).otherwise(F.floor(wide, F.lit(2)))).cast("double")


def validate(callbacks: DataFrame, now: Column, payout: bool = False, payload: str = "payload") -> DataFrame:
    """``callbacks`` with what the payload says, typed, a verdict and its reasons.

    A verdict is ``accept``, ``failed`` (the payment failed, items are not
    judged), ``review`` (no result code) or ``reject``. What cannot be parsed or
    lacks a receipt or an amount is rejected, with a result code or without. A
    time that is missing or cannot be read is a warning, and payouts tell none;
    one beyond the clock's skew in the future rejects. Payouts may be larger;
    ``payout`` allows all payloads that much. Charges may be negative, and are not judged.
    """
    p = callbacks.withColumn("__p", parse(F.col(payload)))
    paid = F.try_to_timestamp(F.regexp_replace(F.col("__p.paid_at"), r"\.0$", ""), F.lit("yyyyMMddHHmmss")).cast("timestamp_ntz")
    p = p.select(
        *callbacks.columns,
        *[F.col(f"__p.{c}").alias(c) for c in ("kind", "merchant_request_id", "checkout_request_id", "conversation_id", "result_code", "receipt", "party_name", "recipient_status")],
        *[truncated(F.col(f"__p.{c}")).alias(c) for c in ("amount", "charges", "utility_funds", "working_funds")],
        normal_msisdn(F.col("__p.msisdn")).alias("msisdn"),
        F.when(F.col("__p.paid_at").rlike(r"^\d{14}(\.0)?$"), paid).alias("paid_at"),
    )
    late = F.col("paid_at") > now.cast("timestamp_ntz") + F.make_dt_interval(secs=F.lit(SKEW_SECONDS))
    most = F.lit(MOST_PAYOUT) if payout else F.when(F.col("kind") == B2C, MOST_PAYOUT).otherwise(MOST)
    faults = {
        "receipt": ~F.coalesce(F.col("receipt").rlike(RECEIPT), F.lit(False)),
        "amount": ~F.coalesce(F.col("amount").between(F.lit(LEAST), most), F.lit(False)),
        "msisdn": F.col("msisdn").isNull(),
        "future": F.coalesce(late, F.lit(False)),
    }
    missing = {"receipt": F.coalesce(F.col("receipt"), F.lit("")) == "", "amount": F.col("amount").isNull()}
    named = lambda some: F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in some.items()]))
    code = F.col("result_code")
    p = p.withColumn("reasons", F.when(code == 0, named(faults)).when(code.isNull(), named(missing)).otherwise(F.array().cast("array<string>")))
    verdict = F.when(F.size("reasons") > 0, "reject").when(code.isNull(), "review").when(code != 0, "failed").otherwise("accept")
    no_time = (code == 0) & F.col("paid_at").isNull() & (F.col("kind") == STK)
    return p.withColumns({"verdict": verdict, "no_time": no_time})


def reconcile(validated: DataFrame, requests: DataFrame) -> DataFrame:
    """Flags of callbacks against ``requests`` (checkout_request_id, requested_amount), one row a callback and flag.

    A payout answers the request of its originator's conversation. Requests of
    one id are one; if they ask for different amounts, the least and the greatest
    count as asked for. A failed payout that has a receipt is inconsistent. Charges are held against nothing.
    """
    asked = requests.groupBy("checkout_request_id").agg(F.min("requested_amount").alias("__least"), F.max("requested_amount").alias("__most"), F.lit(True).alias("__asked"))
    both = validated.join(asked, "checkout_request_id", "left")
    off = lambda c: F.abs(F.col("amount") - F.col(c)) >= 1.0
    flags = {
        "ORPHAN_CALLBACK": F.col("__asked").isNull(),
        "INCONSISTENT_B2C_STATE": (F.col("kind") == B2C) & (F.col("result_code") != 0) & (F.coalesce(F.col("receipt"), F.lit("")) != ""),
        "AMOUNT_INTEGRITY_FAILURE": (F.col("result_code") == 0) & off("__least") & off("__most"),
    }
    flag = F.explode(F.array_compact(F.array(*[F.when(hit, F.lit(name)) for name, hit in flags.items()])))
    return both.select(*validated.columns, flag.alias("flag"))
