"""Retrieval-quality queries: every document is a case, labelled by one of a fixed set of citations and a section of its own."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallymill.functions import text
from tallymill.operators import evaluation as ev
from tallymill.plans.registry import query
from tallymill.session import read_table

# The labelled cases (id, category, target citation).
CASES = [
    ("001", "Structuring", "POCAMLA Regulations 2013, Section 16(1) - Cash Transaction Reporting"),
    ("002", "Agent Fraud", "CBK Prudential Guidelines on Agent Banking, Section 7.3 - Agent Monitoring"),
    ("003", "Digital Lending", "FRC National Risk Assessment 2022, Section 4.2 - Digital Lending Risks"),
    ("004", "Agent Collusion", "POCAMLA Section 44 - Obligations of Reporting Institutions"),
    ("005", "Digital Credit Misuse", "CBK Regulation on Digital Credit, Section 12 - Responsible Lending"),
    ("006", "Trade-Based Money Laundering", "POCAMLA Section 23 - Trade-Based Money Laundering"),
    ("007", "PEP Transaction", "CBK AML/CFT Guidelines, Section 9.2 - PEP Enhanced Due Diligence"),
    ("008", "Terrorist Financing", "POCAMLA Section 28 - Terrorist Financing Offenses"),
    ("009", "Shell Company Layering", "POCAMLA Section 21 - Shell Company Due Diligence"),
    ("010", "Cash Intensive Business", "CBK AML Guidelines, Section 6.4 - Cash Intensive Business Monitoring"),
    ("011", "Real Estate", "POCAMLA Section 25 - Real Estate Due Diligence"),
    ("012", "Cryptocurrency", "CBK Guidance on Virtual Assets, Section 8.1 - VASP Due Diligence"),
]
#: Rank to how many ids further on the document retrieved there is; even cases find their own in third place.
STEPS = {1: 12, 2: 360, 3: 7, 4: 24, 5: 61}
_LABELS = "l(i, category, label) AS (VALUES " + ", ".join(f"({i}, '{b}', '{t}')" for i, (_, b, t) in enumerate(CASES)) + ")"
_CASES = _LABELS + ", c AS (SELECT DISTINCT doc_id AS case_id, category, label || '; Section ' || doc_id % 30 AS target FROM documents JOIN l ON l.i = doc_id % 12)"
_HITS = "x(r, step) AS (VALUES " + ", ".join(f"({r}, {d})" for r, d in STEPS.items()) + """),
h AS (SELECT a.case_id, a.category, a.target, r AS rank, b.target AS content FROM c a, x JOIN c b ON b.case_id = a.case_id + CASE WHEN r = 3 AND a.case_id % 2 = 0 THEN 0 ELSE step END)"""


def _terms(c: str) -> str:
    return f"""list_concat(list_filter([CASE WHEN contains(lower({c}), 'pocamla') THEN 'pocamla' END, CASE WHEN contains(lower({c}), 'dpa') OR contains(lower({c}), 'data protection') THEN 'dpa' END,
  CASE WHEN contains(lower({c}), 'cbk') THEN 'cbk' END, CASE WHEN contains(lower({c}), 'frc') THEN 'frc' END], lambda x: x IS NOT NULL), list_transform(regexp_extract_all(lower({c}), 'section\\s*(\\d+)', 1), lambda x: 'sec' || x))"""


_SIM = f"""s AS (SELECT *, list_distinct({_terms("target")}) AS a, list_distinct({_terms("content")}) AS b FROM h),
j AS (SELECT case_id, category, rank, CASE WHEN len(a) = 0 THEN 0.0 ELSE len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) END AS similarity FROM s)"""
_PER = f"""{_CASES}, {_HITS}, {_SIM}, m AS (SELECT c.case_id, c.category, coalesce(count_if(rank <= 1 AND similarity >= 0.7) / nullif(count_if(rank <= 1), 0), 0.0) AS precision_at_1, coalesce(count_if(rank <= 3 AND similarity >= 0.7) / nullif(count_if(rank <= 3), 0), 0.0) AS precision_at_3,
  coalesce(count_if(rank <= 5 AND similarity >= 0.7) / nullif(count_if(rank <= 5), 0), 0.0) AS precision_at_5, coalesce(1.0::DOUBLE / min(CASE WHEN similarity >= 0.7 THEN rank END), 0.0) AS reciprocal_rank, coalesce(max(similarity), 0.0) AS citation_similarity, coalesce(max(similarity), 0.0) > 0.7 AS citation_match FROM c LEFT JOIN j USING (case_id) GROUP BY c.case_id, c.category)"""
METRICS = ["precision_at_1", "precision_at_3", "precision_at_5", "reciprocal_rank", "citation_similarity", "citation_match"]


def cases(spark, sf_dir):
    labels = spark.createDataFrame([(i, b, t) for i, (_, b, t) in enumerate(CASES)], "i int, category string, label string")
    d = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("case_id")).distinct()
    of = d.join(F.broadcast(labels), F.col("i") == F.col("case_id") % len(CASES))  # twelve rows
    return of.select("case_id", "category", F.concat("label", F.lit("; Section "), (F.col("case_id") % 30).cast("string")).alias("target"))


def hits(spark, sf_dir):
    c = cases(spark, sf_dir)
    step = F.create_map(*[F.lit(v) for pair in STEPS.items() for v in pair])
    wanted = c.withColumn("rank", F.explode(F.array(*map(F.lit, STEPS))))
    wanted = wanted.withColumn("other", F.col("case_id") + F.when((F.col("rank") == 3) & (F.col("case_id") % 2 == 0), 0).otherwise(step[F.col("rank")]))
    return wanted.join(c.select(F.col("case_id").alias("other"), F.col("target").alias("content")), "other").select("case_id", "category", "target", "rank", "content")


def _per_case(spark, sf_dir):
    return ev.per_case(hits(spark, sf_dir), cases(spark, sf_dir))


@query("eval_normalize_citation", f"WITH {_CASES} SELECT case_id, replace(replace(replace(replace(trim(lower(target)), 'section', 'sec'), 'clause', 'cl'), 'regulation', 'reg'), 'guideline', 'guide') AS citation FROM c")
def eval_normalize_citation(spark, sf_dir):
    return cases(spark, sf_dir).select("case_id", text.normalize_citation(F.col("target")).alias("citation"))


@query("eval_key_terms", f"WITH {_LABELS}, d AS (SELECT doc_id, coalesce(text, '') || ' ' || label || '; Section ' || doc_id % 30 AS t FROM documents JOIN l ON l.i = doc_id % 12) SELECT doc_id, array_to_string({_terms('t')}, ',') AS terms FROM d")
def eval_key_terms(spark, sf_dir):
    """Of whole texts with their citation."""
    d = read_table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    both = d.join(cases(spark, sf_dir), F.col("doc_id") == F.col("case_id"))
    return both.select("doc_id", F.array_join(text.key_terms(F.concat_ws(" ", "text", "target")), ",").alias("terms"))


@query("eval_jaccard", f"WITH {_CASES}, {_HITS}, {_SIM} SELECT case_id, rank::INTEGER AS rank, round(similarity, 6) AS similarity FROM j")
def eval_jaccard(spark, sf_dir):
    return ev.judged(hits(spark, sf_dir)).select("case_id", "rank", F.round("similarity", 6).alias("similarity"))


@query("eval_precision_at_k", f"WITH {_PER} SELECT case_id, round(precision_at_1, 6) AS precision_at_1, round(precision_at_3, 6) AS precision_at_3, round(precision_at_5, 6) AS precision_at_5 FROM m")
def eval_precision_at_k(spark, sf_dir):
    return _per_case(spark, sf_dir).select("case_id", *[F.round(f"precision_at_{k}", 6).alias(f"precision_at_{k}") for k in (1, 3, 5)])


@query("eval_mrr", f"WITH {_PER} SELECT round(avg(reciprocal_rank), 6) AS mrr FROM m")
def eval_mrr(spark, sf_dir):
    return _per_case(spark, sf_dir).agg(F.round(F.avg("reciprocal_rank"), 6).alias("mrr"))


@query("eval_overall", f"WITH {_PER} SELECT count(*) AS total_cases, " + ", ".join(f"round(avg({m}::DOUBLE), 6) AS {m}" for m in METRICS) + " FROM m")
def eval_overall(spark, sf_dir):
    return ev.overall(_per_case(spark, sf_dir), METRICS)


@query("eval_per_category", f"WITH {_PER} SELECT category, " + ", ".join(f"round(avg({m}::DOUBLE), 6) AS {m}" for m in METRICS) + " FROM m GROUP BY category")
def eval_per_category(spark, sf_dir):
    return ev.per_category(_per_case(spark, sf_dir), METRICS)


@query(
    "eval_reasoning_alignment",
    r"""WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents), s AS (SELECT doc_id, list_filter(l, lambda x, i: i % 2 = 1) AS e, list_filter(l, lambda x, i: i % 2 = 0) AS a FROM d)
    SELECT doc_id, round(CASE WHEN len(e) = 0 THEN (len(a) = 0)::INTEGER::DOUBLE ELSE len(list_filter(e, lambda x: len(list_filter(a, lambda y: len(list_filter(string_split_regex(lower(x), '\s+'), lambda w: w <> '' AND contains(lower(y), w))) > 0)) > 0)) / len(e) END, 6) AS alignment FROM s""",
)
def eval_reasoning_alignment(spark, sf_dir):
    """A text's first, third, ... lines as the expected steps, the others as the actual ones."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    every_other = lambda c, odd: F.filter(c, lambda x, i: i % 2 == odd)
    s = read_table(spark, sf_dir, "documents").select("doc_id", lines.alias("l"))
    return s.select("doc_id", F.round(ev.alignment(every_other(F.col("l"), 0), every_other(F.col("l"), 1)), 6).alias("alignment"))


@query("eval_decision_accuracy", "SELECT o_orderpriority AS category, round(avg((o_orderstatus = 'F')::INTEGER), 6) AS decision_accuracy FROM orders GROUP BY 1")
def eval_decision_accuracy(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("category"), (F.col("o_orderstatus") == "F").alias("decision_accuracy"))
    return ev.per_category(o, ["decision_accuracy"])
