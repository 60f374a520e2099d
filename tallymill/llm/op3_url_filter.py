"""URL filters: host-suffix and path-prefix expressions against hashed rules.

A url is expanded into host suffix + path prefix expressions, those are
equi-joined with the rules on the first bytes of a digest, and the full digest
confirms a match. The longest rule wins. Only suffixes with as many labels and
prefixes with as many characters as some rule has are made: these cover every
possible match, and junk urls can't expand without bound.

Edge cases: a null url or one without "://" has an empty host and path and
fits no rule; repeated rows and null ids are judged one by one; without rules
everything gets the default verdict; an empty table gives an empty result;
extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The rules of the contract.
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PREFIX_HEX = 8
#: Rules up to this many are sent to all tasks (a row is some 200 bytes); more are shuffled, with the hot expressions salted.
BROADCAST_RULES = 100_000
SALTS = 16


def url_parts(url: Column) -> tuple[Column, Column]:
    url = F.coalesce(url, F.lit(""))
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rules_frame(spark, rules=RULES) -> DataFrame:
    return spark.createDataFrame(rules, "rule_host string, rule_path string, rule_verdict string")


def _digest(expression: Column) -> Column:
    return F.sha2(expression.cast("binary"), 256)


def filter_urls(pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict for every row.

    Of two rules for one expression the blocking one holds; of matching rules
    the longest expression does, and between equally long ones the longer host.
    """
    labels = F.size(F.split("rule_host", r"\."))
    shapes = rules.select(labels.alias("n"), F.length("rule_path").alias("m"))
    # both lists are as long as a host has labels and a path has characters at most
    label_counts = sorted(r[0] for r in shapes.select("n").distinct().collect())
    path_lengths = sorted(r[0] for r in shapes.select("m").distinct().collect())
    coded = rules.groupBy("rule_host", "rule_path").agg(F.max("rule_verdict").alias("rule_verdict"))
    coded = coded.select(
        F.concat("rule_host", "rule_path").alias("rule"), "rule_verdict", F.length("rule_host").alias("rule_host_n")
    ).withColumn("rule_digest", _digest(F.col("rule")))
    coded = coded.withColumn("rule_prefix", F.substring("rule_digest", 1, PREFIX_HEX))

    host, path = url_parts(F.col(url))
    p = pages.select(F.col(key).alias("page_id"), host.alias("host"), path.alias("path")).withColumn("__row", F.monotonically_increasing_id())
    count = F.size(F.split("host", r"\."))
    suffixes = F.array_compact(F.array(*[F.when(count >= n, F.substring_index("host", ".", -n)) for n in label_counts])) if label_counts else F.array().cast("array<string>")
    prefixes = F.array_compact(F.array(*[F.when(F.length("path") >= m, F.substring("path", 1, m)) for m in path_lengths])) if path_lengths else F.array().cast("array<string>")
    expressions = F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda x: F.concat(h, x))))
    e = p.select("*", F.explode_outer(F.when(F.col("host") != "", expressions)).alias("__expression"))
    e = e.withColumn("__digest", _digest(F.col("__expression"))).withColumn("__prefix", F.substring("__digest", 1, PREFIX_HEX))
    match = F.col("__prefix") == F.col("rule_prefix")
    if rules.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES:
        joined = e.join(F.broadcast(coded), match, "left")
    else:
        e = e.withColumn("__salt", F.pmod(F.xxhash64("__row"), F.lit(SALTS)).cast("int"))
        salted = coded.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("rule_salt"))
        joined = e.join(salted, match & (F.col("__salt") == F.col("rule_salt")), "left")
    best = F.max(F.when(F.col("__digest") == F.col("rule_digest"), F.struct(F.length("rule").alias("n"), F.col("rule_host_n"), F.col("rule"), F.col("rule_verdict"))))
    judged = joined.groupBy("__row", "page_id", "host", "path").agg(best.alias("__best"))
    return judged.select("page_id", "host", "path", F.col("__best.rule").alias("rule"), F.coalesce("__best.rule_verdict", F.lit(default)).alias("verdict"))
