"""Trailing windows and circular payments against brute force, odd rows and busy accounts."""

import itertools
import random
import time

import pytest
from pyspark.sql import functions as F

from tallymill.operators import cycles, detection, fraud
from tallymill.operators.trailing import Decayed, Different, Total, cents, count_if, deviation, squares, with_trailing

ROWS = "id long, key string, party string, amount double, at long"


def sample(seed, n, latest):
    r = random.Random(seed)
    rows = [(i, r.choice(["a", "b", None]), r.choice(["x", "y", "z", None]), r.choice([None, 0.01, 5.5, -3.25, 100.0]), r.choice([r.randrange(-latest, latest), r.randrange(20)])) for i in range(n)]
    return rows + [(n, "a", "x", 1.0, None), (n + 1, "lone", None, None, 7), *[(n + 2 + k, "lone", "x", 2.0, 99) for k in range(3)]]


@pytest.mark.parametrize("spans", [(5, 17, 17), (1, 1, 2), (300, 40, 100)])
def test_windows(spark, spans):
    rows = sample(spans[0], 400, 300)
    one, two, three = spans
    stats = {"n": Total(one, F.lit(1).cast("long")), "s": Total(two, cents("amount")), "big": Total(two, count_if(F.col("amount") > 1)), "p": Different(three, "party"), "d": Decayed(two, 7)}
    got = with_trailing(spark.createDataFrame(rows, ROWS), "key", stats)
    assert got.columns == ["id", "key", "party", "amount", "at", "n", "s", "big", "p", "d"]
    for r in got.collect():
        before = lambda span: [x for x in rows if r.at is not None and x[1] == r.key and x[4] is not None and r.at - span <= x[4] <= r.at]
        if r.at is None:
            assert (r.n, r.s, r.big, r.p, r.d) == (None,) * 5
            continue
        assert r.n == len(before(one))
        assert float(r.s) == pytest.approx(sum(x[3] or 0 for x in before(two)), abs=1e-9)
        assert r.big == sum((x[3] or 0) > 1 for x in before(two))
        assert r.p == len({x[2] for x in before(three)} - {None})
        assert r.d == pytest.approx(sum(2 ** ((x[4] - r.at) / 7) for x in before(two)), rel=1e-9)
    assert got.count() == len(rows)


def test_windows_of_no_rows_and_short_half_lives(spark):
    none = spark.createDataFrame([], ROWS)
    assert with_trailing(none, ["key", "party"], {"n": Total(9, F.lit(1).cast("long"))}).count() == 0
    with pytest.raises(ValueError, match="half-life"):
        with_trailing(none, "key", {"d": Decayed(86_400, 1)})


def test_deviation_is_the_samples(spark):
    rows = [(i, "a", "x", float(v), i) for i, v in enumerate([2, 4, 4, 4, 5, 5, 7, 9])]
    one = F.lit(1).cast("long")
    got = with_trailing(spark.createDataFrame(rows, ROWS), "key", {"n": Total(100, one), "s": Total(100, cents("amount")), "q": Total(100, squares("amount"))})
    by = {r.id: r.d for r in got.select("id", deviation(F.col("n"), F.col("s"), F.col("q")).alias("d")).collect()}
    assert by[0] is None and by[7] == pytest.approx((32 / 7) ** 0.5)


def test_a_busy_account_takes_linear_time(spark):
    """Every row's window holds all rows before it: looked back over, 200,000 rows would be 2 * 10^10 steps."""
    busy = spark.range(200_000).select("id", F.lit("a").alias("key"), (F.col("id") % 1000).cast("string").alias("party"), F.lit(1.5).alias("amount"), F.col("id").alias("at"))
    began = time.time()
    got = with_trailing(busy, "key", {"n": Total(10**6, F.lit(1).cast("long")), "s": Total(10**6, cents("amount")), "p": Different(10**6, "party")})
    wrong = got.filter((F.col("n") != F.col("id") + 1) | (F.col("s") != (F.col("id") + 1) * 1.5) | (F.col("p") != F.least(F.col("id") + 1, F.lit(1000))))
    assert wrong.count() == 0 and time.time() - began < 60


TRANSFERS = "txn long, sender long, receiver long, amount double, at long"


def brute_cycles(rows, length, least, span, repeats):
    known = [r for r in rows if None not in r[1:] and r[1] != r[2]]
    best = {}
    for path in itertools.product(known, repeat=length):
        accounts = tuple(r[1] for r in path)
        follow = all(a[2] == b[1] and a[4] < b[4] for a, b in itertools.pairwise(path))
        if len(set(accounts)) == length and follow and path[-1][2] == path[0][1] and path[-1][4] - path[0][4] <= span:
            key = (accounts, path[-1][0])
            best[key] = max(best.get(key, (0, 0)), (round(sum(r[3] for r in path), 2), path[-1][4]))
    closed = {}
    for (accounts, _), (total, at) in best.items():
        if total >= least:
            closed.setdefault(accounts, []).append((at, total))
    out = []
    for accounts, some in closed.items():
        times = sorted(at for at, _ in some)
        alerts = [b for a, b in zip(times, times[repeats - 1 :]) if b - a <= span]
        if alerts:
            out.append((list(accounts), len(some), max(v for _, v in some), min(alerts)))
    return sorted(out)


def found(spark, rows, *args):
    return sorted((r.cycle, r.n_cycles, r.largest, r.first_alert_at) for r in cycles.circular_payments(spark.createDataFrame(rows, TRANSFERS), *args).collect())


@pytest.mark.parametrize("length", [2, 3])
def test_cycles(spark, length):
    for seed in range(3):
        r = random.Random(seed)
        rows = [(i, r.randrange(4), r.randrange(4), r.choice([1.0, 2.5, 10.25]), r.randrange(60)) for i in range(70)]
        rows += [(100, None, 1, 1.0, 5), (101, 1, None, 1.0, 5), (102, 1, 2, None, 5), (103, 1, 2, 1.0, None), (104, 2, 2, 9.0, 5), rows[0]]
        for least, span, repeats in ((0, 20, 1), (12, 30, 2), (5, 60, 3)):
            assert found(spark, rows, length, least, span, repeats) == brute_cycles(rows, length, least, span, repeats)
    assert found(spark, [], length) == []


def test_loops_far_apart_are_no_alert(spark):
    day = 86_400
    loop = lambda k, start: [(3 * k, 1, 2, 200_000.0, start), (3 * k + 1, 2, 3, 200_000.0, start + 60), (3 * k + 2, 3, 1, 200_000.0, start + 120)]
    apart = sum((loop(k, 60 * day * k) for k in range(3)), [])
    close = sum((loop(k, 2 * day * k) for k in range(3)), [])
    assert found(spark, apart, 3) == []
    assert [c[0] for c in found(spark, close, 3)] == [[1, 2, 3]]
    assert found(spark, [(a, b, c, 100_000.0, e) for a, b, c, _, e in close], 3) == []


def test_cycles_through_a_hub(spark):
    """The hub pays and is paid by 4,000 accounts, which would be 16 million wedges over it; it is in one cycle of three."""
    hub = [(i, 0, i, 1.0, i) for i in range(1, 4001)] + [(10_000 + i, i, 0, 1.0, 5000 + i) for i in range(1, 4001)]
    rows = [*hub, (1, 7, 9, 1.0, 4000)]
    got = found(spark, rows, 3, 0, 10_000, 1)
    assert got == [([0, 7, 9], 1, 3.0, 5009)]
    edges = spark.createDataFrame([(a, b) for _, a, b, _, _ in rows], "u long, v long").distinct()
    assert cycles.account_cycles(edges, 3).count() == 3


def test_tiers_and_fraud_interactions(spark):
    scores = [0.0, 0.3, 0.31, 0.65, 0.651, 0.85, 0.86, 1.0, None]
    got = [r[0] for r in spark.createDataFrame([(s,) for s in scores], "s double").coalesce(1).select(detection.risk_tier(F.col("s"))).collect()]
    assert got == ["low", "low", "medium", "medium", "high", "high", "critical", "critical", None]
    t = spark.sql("SELECT 1L txn, 'a' sender, 'b' receiver, 'g' agent, 'p' place, 'p2p' channel, 'in' kind, 149000.0D amount, TIMESTAMP_NTZ '2024-01-01 10:00:00' ts, 1704103200L at")
    profile = "account string, county long, lat double, lon double, opened_at long, device_at long, sim_match boolean, tier int, kyc int, frauds_90d int"
    twice = spark.createDataFrame([("a", 1, 0.0, 0.0, 0, 0, True, 1, 1, 0), ("a", 2, 0.0, 0.0, 0, 0, True, 1, 1, 0)], profile)
    (r,) = fraud.features(t, twice).collect()
    assert r.threshold_proximity_x_velocity == pytest.approx(1000 * 0.6931471805599453)
    assert (r.txn_count_24h_sender, r.agg_velocity_12h, r.agg_velocity_12h_decayed) == (1, 1, 1.0)


def test_a_row_is_sorted_twice_at_most_however_many_spans(spark):
    """The rows that go into the windows depend on the longest span alone."""
    import re

    from tallymill.operators import trailing

    t = spark.createDataFrame([("a", s) for s in (0, 5, 9, 10, 11, 30)], "k string, at long")
    one = F.lit(1).cast("long")
    few = trailing.with_trailing(t, "k", {"n9": trailing.Total(9, one)})
    many = trailing.with_trailing(t, "k", {f"n{i}": trailing.Total(i, one) for i in (1, 4, 6, 9)})
    made = lambda df: [re.sub(r"#\d+", "", x).split("[")[0] for x in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Generate" in x]
    assert [x.strip(" +-:") for x in made(few)] == [x.strip(" +-:") for x in made(many)]
    assert {(x.at, x.n1, x.n4, x.n9) for x in many.collect()} == {(0, 1, 1, 1), (5, 1, 1, 2), (9, 1, 2, 3), (10, 2, 2, 3), (11, 2, 3, 4), (30, 1, 1, 1)}
