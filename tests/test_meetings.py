"""Interval joins and pairs under rare items against nested loops."""

from __future__ import annotations

import random
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import pytest

from plenum.operators import graphs, intervals, sparse_pairs

DAY0 = datetime(2024, 1, 1)


@pytest.mark.parametrize(("finest", "part"), [(intervals.FINEST, intervals.PART), (60_000_000, 3)])
def test_interval_join(spark, finest, part):
    """Overlapping, open, empty and long intervals, a busy instant, nulls; in few bins and in many, split and not; names that clash."""
    rng = random.Random(1)
    at = lambda: DAY0 + timedelta(minutes=rng.randrange(200_000)) if rng.random() > 0.05 else None
    points = [(k, rng.choice(["a", "b", None]), DAY0 + timedelta(days=9) if k % 4 == 0 else at()) for k in range(200)]
    spans = []
    for k in range(60):
        a = at()
        spans.append((k, rng.choice(["a", "b", None]), a, None if a is None or rng.random() < 0.1 else a + timedelta(minutes=rng.choice([-5, 0, 1, 90, 5000, 150_000]))))
    p = spark.createDataFrame(points, "bin long, g string, lo timestamp_ntz")
    s = spark.createDataFrame(spans, "k long, g string, first timestamp_ntz, last timestamp_ntz")
    inside = lambda t, a, b: t is not None and (a is None or a <= t) and (b is None or t < b)
    df = intervals.interval_join(p, "lo", s, "first", "last", by=["g"], finest=finest, part=part)
    assert df.columns == ["g", "bin", "lo", "k", "first", "last"]
    assert Counter((r["bin"], r["k"]) for r in df.collect()) == Counter((n, k) for n, g, t in points for k, h, a, b in spans if g is not None and g == h and inside(t, a, b))
    df = intervals.interval_join(p.drop("g"), "lo", s.drop("g"), "first", "last", finest=finest, part=part)
    assert Counter((r["bin"], r["k"]) for r in df.collect()) == Counter((n, k) for n, _, t in points for k, _, a, b in spans if inside(t, a, b))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_interval_join_of_nothing(spark):
    p = spark.createDataFrame([(1, DAY0)], "n long, t timestamp_ntz")
    s = spark.createDataFrame([(1, DAY0, None)], "k long, a timestamp_ntz, b timestamp_ntz")
    assert intervals.interval_join(p.limit(0), "t", s, "a", "b").count() == 0
    assert intervals.interval_join(p, "t", s.limit(0), "a", "b").count() == 0
    assert intervals.interval_join(p, "t", s, "a", "b").count() == 1


@pytest.mark.parametrize("least", [1, 2, 4])
def test_sparse_pairs(spark, monkeypatch, least):
    """What nested loops find, with items that most have, repeated rows, nulls, and blocks of a popular item."""
    monkeypatch.setattr(graphs, "BLOCK", 8)
    rng = random.Random(2)
    rows = [(rng.randrange(2), rng.randrange(60), min(int(rng.expovariate(0.08)), 90), rng.choice([-1.0, 0.0, 0.5])) for _ in range(900)] + [(0, None, 3, 1.0), (0, 5, None, 1.0)]
    means = {(c, a, t): s for c, a, t, s in rows}
    df = spark.createDataFrame([(c, a, t, s) for (c, a, t), s in means.items()], "case_id long, actor long, theme long, s double")
    of = defaultdict(dict)
    for (c, a, t), s in means.items():
        if a is not None and t is not None:
            of[c, a][t] = s
    pairs, agree, against = {}, {}, {}
    for c, a in of:
        for d, b in of:
            both = of[c, a].keys() & of[d, b].keys()
            if c == d and a < b and len(both) >= least:
                pairs[c, a, b] = len(both)
                x = [of[c, a][t] * of[c, b][t] for t in both]
                for table, n in ((agree, sum(v > 0 for v in x)), (against, sum(v < 0 for v in x))):
                    if n:
                        table[c, a, b] = (n, len(both))
    assert len(pairs) > 50
    got = sparse_pairs.shared_pairs(df.unionByName(df), ["case_id"], "actor", "theme", least).collect()
    assert Counter(((r["case_id"], r["src"], r["dst"]), r["shared"]) for r in got) == Counter(pairs.items())
    for sign, want in ((True, agree), (False, against)):
        rows = sparse_pairs.sparse_stance_edges(df, sign, least)
        assert {(r["case_id"], r["src"], r["dst"]): (r["weight"], r["shared"]) for r in rows.collect()} == want
