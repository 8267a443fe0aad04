"""As-of and interval joins against plain versions, with hot keys, ties, nulls and long intervals."""

import random
from datetime import datetime, timedelta

import pytest

from filigraph.operators.timed import asof_join, interval_join

BASE = datetime(2024, 1, 1)


def made(seed, n, most=3000):
    r = random.Random(seed)
    key = lambda: r.choice(["HOT", "HOT", "a", "b", None])
    return [(i, key(), None if r.random() < 0.05 else BASE + timedelta(minutes=r.randint(-most, most))) for i in range(n)]


@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("bin", ["1 hour", "30 minutes", "400 days"])
def test_asof(spark, strict, bin):
    left, right = made(1, 300) + made(1, 300)[:20], made(2, 120) + [(900, "HOT", BASE), (901, "HOT", BASE)]
    out = asof_join(spark.createDataFrame(left, "id long, k string, ts timestamp_ntz"), spark.createDataFrame(right, "id long, k string, ts timestamp_ntz"), ["k"], bin=bin, tie="id", strict=strict)

    def plain(k, t):
        found = [(rt, i) for i, rk, rt in right if k is not None and t is not None and rk == k and rt is not None and (rt < t if strict else rt <= t)]
        return max(found)[1] if found else None

    assert sorted(((r["id"], r["last_id"]) for r in out.collect()), key=repr) == sorted(((i, plain(k, t)) for i, k, t in left), key=repr)
    assert out.columns == ["id", "k", "ts", "last_id", "last_k", "last_ts"]


def test_asof_keeps_nulls_of_the_last_row(spark):
    left = spark.createDataFrame([(1, "a", BASE)], "id long, k string, ts timestamp_ntz")
    right = spark.createDataFrame([("a", BASE - timedelta(days=2), 1.0), ("a", BASE - timedelta(days=1), None)], "k string, ts timestamp_ntz, v double")
    row = asof_join(left, right, ["k"]).first()
    assert row["last_v"] is None and row["last_ts"] == BASE - timedelta(days=1)
    assert asof_join(left, right.limit(0), ["k"]).first()["last_k"] is None and asof_join(left.limit(0), right, ["k"]).count() == 0
    with pytest.raises(ValueError):
        asof_join(left, right, ["k"], prefix="")


@pytest.mark.parametrize("closed", [False, True])
def test_interval(spark, closed):
    r = random.Random(5)
    points = made(3, 200)
    spans = [(i, k, t, None if t is None else t + timedelta(minutes=r.choice([-5, 0, 10, 90, 5000]))) for i, k, t in made(4, 80)]
    out = interval_join(spark.createDataFrame(points, "id long, k string, ts timestamp_ntz"), spark.createDataFrame(spans, "id long, k string, start timestamp_ntz, end timestamp_ntz"), ["k"], closed=closed)
    plain = [(i, j) for i, k, t in points for j, sk, a, b in spans if None not in (k, t, a) and k == sk and a <= b and a <= t and (t <= b if closed else t < b)]
    assert sorted((r["id"], r["in_id"]) for r in out.collect()) == sorted(plain) and len(plain) > 50
    assert "CartesianProduct" not in out._jdf.queryExecution().executedPlan().toString() and "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()
