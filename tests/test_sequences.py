import random
import statistics
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from drawlens.operators import checks, explore, features, history
from drawlens.operators.sequences import along, distinct_counts, grouped_quantiles, large_groups

START = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def lopsided(spark):
    """One member has a third of the rows, some without a time, some at one time; one member has no id."""
    rng = random.Random(3)
    who = ["house"] * 400 + [f"m{rng.randrange(40)}" for _ in range(780)] + [None] * 20
    rows = []
    for i, m in enumerate(who):
        ts = None if rng.random() < 0.05 else START + timedelta(minutes=rng.randrange(300))
        rows.append((m, i, ts, rng.choice((None, 1.5, -2.0, 3.25)), float(rng.randrange(30)), rng.choice("xyz")))
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, "member_id string, draw_id long, ts timestamp_ntz, net_result double, stake double, kind string").repartition(4).cache()


def in_order(rows):
    members = {}
    for r in rows:
        members.setdefault(r[0], []).append(r)
    return {m: sorted(x, key=lambda r: (r[2] is None, r[2] or START, r[1])) for m, x in members.items()}


@pytest.mark.parametrize("large", [5, 60, 150, 10**6])
def test_along_is_the_plain_window(lopsided, large):
    rows, df = lopsided
    got = along(df, ["member_id"], ["ts", "draw_id"], previous={"before": "ts", "last": "stake"}, running={"sum": "net_result"}, sequence="n", overall={"least": (F.min, F.col("net_result")), "total": (F.sum, F.col("stake"))}, large=large)
    assert got.columns == [*df.columns, "before", "last", "sum", "n", "least", "total"]
    want = []
    for mine in in_order(rows).values():
        total, seen, nets = None, None, [r[3] for r in mine if r[3] is not None]
        for n, r in enumerate(mine, 1):
            total = total if r[3] is None else (total or 0) + r[3]
            want.append((*r, seen and seen[2], seen and seen[4], total, n, min(nets, default=None), sum(x[4] for x in mine)))
            seen = r
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_no_slice_holds_a_large_group(lopsided):
    rows, df = lopsided
    assert [r["_k_member_id"] for r in large_groups(df, ["member_id"], 60).collect()] == ["house"] and large_groups(df, ["member_id"], 400) is None
    out = along(df, ["member_id"], ["ts", "draw_id"], sequence="n", large=60)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "_slice" in plan
    from drawlens.operators.sequences import _sliced

    sizes = [r["count"] for r in _sliced(df, ["member_id"], "ts", large_groups(df, ["member_id"], 60), 60).groupBy("member_id", "_slice").count().collect()]
    assert max(sizes) < 110 and sum(sizes) == len(rows)


@pytest.mark.parametrize("large", [4, 10**6])
def test_quantiles_of_groups(lopsided, large):
    rows, df = lopsided
    got = {r.member_id: r for r in grouped_quantiles(df, ["member_id"], {"a": ("stake", 0.5), "b": ("stake", 0.9), "c": ("net_result", 0.25)}, large).collect()}
    for m, mine in in_order(rows).items():
        stakes, nets = [r[4] for r in mine], [r[3] for r in mine if r[3] is not None]
        assert got[m].a == statistics.median(stakes) and np.isclose(got[m].b, np.quantile(stakes, 0.9))
        assert got[m].c is None if not nets else np.isclose(got[m].c, np.quantile(nets, 0.25))
    whole = grouped_quantiles(df, [], {"a": ("stake", 0.5)}, large).first()
    assert whole.a == statistics.median(r[4] for r in rows)
    assert grouped_quantiles(df.limit(0), ["member_id"], {"a": ("stake", 0.5)}).count() == 0
    kinds = {r.member_id: r.k for r in distinct_counts(df, ["member_id"], {"k": "kind", "s": "stake"}).collect()}
    assert kinds["house"] == 3


def test_gaps_trajectories_and_slopes_do_not_depend_on_the_split(lopsided):
    _, df = lopsided
    df = df.withColumnRenamed("stake", "total_bet_amount")
    key = lambda f: sorted(map(str, f.collect()))
    assert key(history.with_gaps(df, 50)) == key(history.with_gaps(df))
    assert key(explore.trajectory(df, 50)) == key(explore.trajectory(df))


def test_single_pass_cutoff_is_the_join(lopsided):
    _, df = lopsided
    for share in (0.0, 0.02, 0.3):
        labelled = df.withColumn("event_label", (F.pmod(F.xxhash64("draw_id"), F.lit(1000)) < share * 1000).cast("int"))
        want = history.before_events(history.with_gaps(labelled.where("member_id IS NOT NULL")))
        for large in (40, 10**6):
            got = history.gaps_before_events(labelled.where("member_id IS NOT NULL"), large)
            assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))
    plan = history.gaps_before_events(labelled)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(member_id") == 1 and "Join" not in plan


def test_large_members_have_the_same_features(spark, sf_dir):
    from drawlens.plans.queries import _history

    h = _history(spark, sf_dir)
    want = {r.member_id: r for r in features.member_features(h).collect()}
    got = {r.member_id: r for r in features.member_features(h, large=12).collect()}
    assert set(got) == set(want) and h.groupBy("member_id").count().where("count > 12").count() > 3
    for m, r in want.items():
        for a, b in zip(r, got[m], strict=True):
            assert a == b or np.isclose(a, b, atol=1e-9), (m, a, b)


def test_diagnosis_by_running_counts(spark, lopsided):
    rows, df = lopsided
    rng = random.Random(5)
    labels = [(m, d) for m, d, *_ in rng.sample(rows, 60) if m] + [("house", 10**6), ("nobody", 3), ("nobody", 10**7)]
    labels += labels[:3]
    marks = spark.createDataFrame(labels, "member_id string, draw_id long")
    for large in (30, 10**6):
        got = {(r.member_id, r.draw_id): tuple(r)[2:] for r in checks.diagnose_labels(marks, df.select("member_id", "draw_id", "ts"), large).collect()}
        assert set(got) == set(labels)
        for m, d in labels:
            event = min((r[2] for r in rows if r[0] == m and r[1] == d and r[2]), default=None)
            mine = [r[2] for r in rows if r[0] == m]
            before = sum(t is not None and t < event for t in mine) if event else 0
            after = sum(t is not None and t >= event for t in mine) if event else 0
            assert got[m, d][:2] == (before, after)
            known = any(r[1] == d for r in rows)
            assert got[m, d][2] == ("matched_with_history" if event and before else "matched_no_history" if event else "member_only" if mine else "draw_only" if known else "absent")
