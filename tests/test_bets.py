import math

import numpy as np
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from drawlens.functions import bets as B

amount = st.floats(0, 1000, allow_nan=False).map(lambda x: round(x, 3))


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=st.lists(st.lists(amount, max_size=6), min_size=1, max_size=20))
def test_draw_features_against_numpy(spark, rows):
    df = spark.createDataFrame([(i, [("1", a) for a in r]) for i, r in enumerate(rows)], f"i int, bets {B.TYPED}")
    df = df.withColumn("v", B.amounts(F.col("bets"))).withColumn("z", B.positive(F.col("v")))
    got = {r.i: r for r in df.select("i", *(c.alias(n) for n, c in B.draw_features(F.col("v"), F.col("z")).items())).collect()}
    for i, r in enumerate(rows):
        z = np.array(sorted(a for a in r if a > 0))
        n, t = len(z), z.sum()
        assert got[i].bets_per_draw == len(r) and got[i].nonzero_bets_per_draw == n
        assert math.isclose(got[i].bet_amount_mean_in_draw, z.mean() if n else 0, abs_tol=1e-9)
        assert math.isclose(got[i].bet_amount_std_in_draw, z.std() if n > 1 else 0, abs_tol=1e-7)
        assert math.isclose(got[i].entropy_in_draw, -(z / t * np.log2(z / t)).sum() if n else 0, abs_tol=1e-9)
        gini = 2 * (np.arange(1, n + 1) * z).sum() / (n * t) - (n + 1) / n if n else 0
        assert math.isclose(got[i].gini_in_draw, max(0, gini), abs_tol=1e-9)
        assert math.isclose(got[i].max_bet_share_in_draw, max(r) / sum(r) if sum(r) > 0 else 0, abs_tol=1e-9)
        assert got[i].tiny_bet_ratio_in_draw == (z <= 1).sum() / max(1, n)


def test_parse_bets_takes_any_text(spark):
    texts = ['[{"number":"17","bet_amount":"2.5"},{"number":1,"bet_amount":1e-3},{"number":"00"}]', "[]", "no json", None, '[{"bet_amount":"x"}]']
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", B.parse_bets(F.col("t")).alias("b")).orderBy("i").collect()
    assert [(x.number, x.bet_amount) for x in rows[0].b] == [("17", 2.5), ("1", 0.001), ("00", 0.0)]
    assert [len(r.b) for r in rows[1:4]] == [0, 0, 0] and rows[4].b[0].bet_amount == 0.0


def test_template_ignores_order_and_zeros(spark):
    df = spark.createDataFrame([([("2", 1.0), ("1", 3.0), ("5", 0.0)],), ([("1", 3.0), ("2", 1.0)],), ([],), (None,)], f"bets {B.TYPED}")
    keys = [r[0] for r in df.select(B.template_key(F.col("bets"))).collect()]
    assert keys[0] == keys[1] != keys[2] == keys[3] == "[]"
