"""Group folds by filling levels, against the greedy loop."""

import numpy as np
import pytest

from sievelight.operators import split


def greedy(sizes, k):
    loads, out = [0] * k, {}
    for name, n in sorted(sizes.items(), key=lambda x: (-x[1], x[0])):
        f = loads.index(min(loads))
        out[name] = f
        loads[f] += n
    return out


@pytest.mark.parametrize("seed", range(300))
def test_fill(seed):
    rng = np.random.default_rng(seed)
    k = int(rng.integers(1, 7))
    loads = [int(x) for x in rng.integers(0, [1, 4, 40][seed % 3], k)]
    size, count = int(rng.integers(1, 9)), int(rng.integers(1, 60))
    want, now = [], list(loads)
    for _ in range(count):
        f = now.index(min(now))
        want.append(f)
        now[f] += size
    starts, orders = split.fill(loads, size, count)
    got = []
    for r in range(count):
        p = max(i for i, s in enumerate(starts) if s <= r)
        got.append(orders[p][(r - starts[p]) % len(orders[p])])
    assert got == want and loads == now


def test_group_folds(spark):
    rng = np.random.default_rng(0)
    sizes = {f"g{i}": int(n) for i, n in enumerate(rng.zipf(1.6, 400)) if n < 200} | {"big": 300, "x,y": 7}
    rows = [(name, i) for name, n in sizes.items() for i in range(n)]
    df = spark.createDataFrame(rows, "group string, i int").repartition(6)
    got = {r["group"]: r["fold"] for r in split.group_folds(df, 4).collect()}
    assert got == greedy(sizes, 4)
    assert split.group_folds(df.limit(0), 4).collect() == []


def test_many_groups_share_tasks(spark):
    """200,000 groups of one row: the plan has one run, and folds are even."""
    df = spark.range(200_000).selectExpr("cast(id as string) as g")
    per = {r["fold"]: r["count"] for r in split.group_folds(df, 5, "g").groupBy("fold").count().collect()}
    assert per == {f: 40_000 for f in range(5)}
