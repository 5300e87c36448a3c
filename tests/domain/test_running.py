"""Running figures and window medians against plain loops."""

from __future__ import annotations

import random
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathomline.operators import running


@pytest.mark.parametrize("size", [1, 7, 1000])
def test_up_to(spark, size):
    rng = random.Random(size)
    entries = [(rng.choice("ab"), rng.randrange(60), Decimal(rng.randrange(100)), rng.choice([None, rng.randrange(9)])) for _ in range(150)]
    queries = [(rng.choice("abc"), rng.randrange(-5, 70), rng.random() < 0.5, k) for k in range(80)]
    e = spark.createDataFrame(entries, "k string, at bigint, v decimal(19,7), m int")
    q = spark.createDataFrame(queries, "k string, at bigint, strict boolean, id int")
    got = {r["id"]: (r["v"], r["m"]) for r in running.up_to(e, q, ["k"], lambda c: F.floor(c / size), ["v"], ["m"]).collect()}
    for k, at, strict, i in queries:
        before = [x for x in entries if x[0] == k and (x[1] < at or x[1] == at and not strict)]
        assert got[i] == (sum((x[2] for x in before), Decimal(0)), max((x[3] for x in before if x[3] is not None), default=None))


def test_ranked_middle():
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 17, 64, 65):
        values = rng.integers(0, 6, n)
        rank = np.argsort(np.argsort(values, kind="stable"), kind="stable")
        times = rng.integers(1, 4, n)
        i, j = np.array([(a, b) for a in range(n + 1) for b in range(a, n + 1)]).T
        for a, b, got in zip(i, j, running.ranked_middle(rank, times, i, j), strict=True):
            every = np.sort(np.repeat(values[a:b], times[a:b]))
            assert (got == -1) == (a == b)
            assert a == b or np.sort(values)[got] == every[len(every) // 2]


@pytest.mark.parametrize("chunk", [10, 40, 1000])
def test_window_medians(spark, chunk):
    rng = random.Random(chunk)
    prices = [(rng.choice("ab"), rng.randrange(-50, 200), Decimal(rng.randrange(1, 9)) / 4, rng.randrange(1, 4)) for _ in range(120)]
    queries = [(rng.choice("abc"), low, low + rng.randrange(11), k) for k in range(90) for low in [rng.randrange(-60, 210)]]
    p = spark.createDataFrame(prices, "k string, at bigint, price decimal(38,18), n bigint")
    q = spark.createDataFrame(queries, "k string, low bigint, high bigint, id int")
    out = running.window_medians(p, q, ["k"], 10, chunk)
    assert out.columns == ["k", "low", "high", "id", "median"]
    got = {r["id"]: r["median"] for r in out.collect()}
    assert len(got) == len(queries)
    for k, low, high, i in queries:
        every = sorted(x[2] for x in prices if x[0] == k and low <= x[1] <= high for _ in range(x[3]))
        assert got[i] == (every[len(every) // 2] if every else None)
