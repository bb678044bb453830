"""Evaluation of scores against labels: capture, lift, ranking metrics, separation, drift.

Metrics over the whole order of scores work on one row per distinct score with running counts, so ties are exact
and no task orders the whole cohort.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from drawlens.operators.ranking import positions, quantiles, running_counts
from drawlens.operators.sequences import grouped_quantiles
from drawlens.sources.stages import stored

#: Rows of a side up to which the exact law is worked out.
EXACT = 10_000


def bucket_sizes(n: int, shares: tuple[float, ...] = (0.01, 0.05, 0.10, 0.20), counts: tuple[int, ...] = (50, 500)) -> list[tuple[str, int]]:
    """Names and sizes of review buckets; a share of the cohort is at least one member."""
    return [(f"top_{int(p * 100)}pct", max(1, int(n * p))) for p in shares] + [(f"top_{k}", k) for k in counts]


def capture_topk(scored: DataFrame, scores: list[str], label: str, key: str, shares: tuple[float, ...] = (0.01, 0.05, 0.10, 0.20), counts_of: tuple[int, ...] = (50, 500)) -> DataFrame:
    """For each score column and bucket: k, captured, capture_rate, precision, lift, over the k highest scores
    (ties by key, null scores last). All scores are counted by distinct value at once; only rows of the values at the
    buckets' edges are ordered, and those by ranges."""
    value = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(float("-inf")))
    tall = F.explode(F.array(*(F.struct(F.lit(c).alias("score_type"), value(c).alias("v")) for c in scores))).alias("s")
    valued = stored(scored.select(tall, F.col(label).cast("long").alias("label"), F.col(key).alias("key")).select("s.*", "label", "key"), "valued")
    counts = valued.groupBy("score_type", "v").agg(F.coalesce(F.sum("label"), F.lit(0)).alias("p"), F.count("*").alias("k"))
    cut = stored(running_counts(counts, -F.col("v"), {"above": "k"}, within=("score_type",)), "cut")
    total = cut.groupBy("score_type").agg(F.sum("k").alias("n"), F.sum("p").alias("p")).first()
    if total is None:
        return scored.sparkSession.createDataFrame([], "score_type string, bucket string, k long, captured long, capture_rate double, precision double, lift double")
    buckets = [(name, max(1, min(k, total.n))) for name, k in bucket_sizes(total.n, shares, counts_of)]
    inside = {r.score_type: r for r in cut.groupBy("score_type").agg(*(F.coalesce(F.sum(F.when(F.col("above") + F.col("k") <= k, F.col("p"))), F.lit(0)).alias(name) for name, k in buckets)).collect()}
    at_edge = F.filter(F.array(*(F.struct(F.lit(name).alias("bucket"), (F.lit(k) - F.col("above")).alias("rest")) for name, k in buckets)), lambda b: (b["rest"] > 0) & (b["rest"] < F.col("k")))
    edges = cut.select("score_type", "v", F.explode(at_edge).alias("b")).select("score_type", "v", "b.*")  # one row for each score and bucket at most
    part = {}
    if not edges.isEmpty():
        rows = valued.join(F.broadcast(edges.select("score_type", "v").distinct()), ["score_type", "v"], "left_semi")
        ordered = positions(rows, ["score_type", "v"], [F.col("key")]).join(F.broadcast(edges), ["score_type", "v"])
        taken = ordered.groupBy("score_type", "bucket").agg(F.coalesce(F.sum(F.when(F.col("position") < F.col("rest"), F.col("label"))), F.lit(0)).alias("hits"))
        part = {(r.score_type, r.bucket): r.hits for r in taken.collect()}
    out, good = [], total.p or 0
    for score in scores:
        for name, k in buckets:
            hit = int(inside[score][name]) + int(part.get((score, name), 0))
            out.append((score, name, k, hit, hit / good if good else 0.0, hit / k, hit / k / (good / total.n) if good else 0.0))
    return scored.sparkSession.createDataFrame(out, "score_type string, bucket string, k long, captured long, capture_rate double, precision double, lift double")


def capture_threshold(scored: DataFrame, score: str, label: str, shares: tuple[float, ...] = (0.01, 0.05, 0.10, 0.20)) -> DataFrame:
    """For each share: threshold (that quantile from the top), members and positives at or above it."""
    q = quantiles(scored, score, {f"q{i}": 1 - p for i, p in enumerate(shares)}).first()
    rows = [F.struct(F.lit(p).alias("share"), F.lit(q[i]).alias("threshold"), F.count_if(F.col(score) >= q[i]).alias("flagged"), F.count_if((F.col(score) >= q[i]) & (F.col(label) == 1)).alias("captured")) for i, p in enumerate(shares)]
    return scored.agg(F.array(*rows).alias("r")).select(F.inline("r"))


def gate(captured: DataFrame, bucket: str = "top_5pct", min_capture: float = 0.40, min_lift: float = 5.0) -> DataFrame:
    """The promotion decision for each score type."""
    rows = captured.where(F.col("bucket") == bucket)
    return rows.select("score_type", "capture_rate", "lift", ((F.col("capture_rate") >= min_capture) & (F.col("lift") >= min_lift)).alias("passed"))


def _by_value(df: DataFrame, by: list[str], value: str, label: str) -> DataFrame:
    return df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("v")).agg(F.sum(F.col(label).cast("long")).alias("p"), F.count("*").alias("k"))


def ranking_metrics(scored: DataFrame, score: str, label: str) -> DataFrame:
    """One row: positives, negatives, roc_auc (ties count half), average_precision (step sum), ks."""
    cut = _by_value(scored, [], score, label)
    cut = running_counts(cut, -F.col("v"), {"p_above": "p", "k_above": "k"})
    total = cut.agg(F.sum("p").alias("all_p"), F.sum("k").alias("all_k")).first()
    P, K = total.all_p or 0, total.all_k or 0
    neg = F.col("k") - F.col("p")
    tp, seen = F.col("p_above") + F.col("p"), F.col("k_above") + F.col("k")
    div = lambda a, b: F.try_divide(a.cast("double"), F.lit(float(b)))
    ks = F.max(F.abs(div(tp, P) - div(seen - tp, K - P)))
    return cut.agg(
        F.lit(P).cast("long").alias("positives"), F.lit(K - P).cast("long").alias("negatives"),
        div(F.sum(neg * (tp - F.col("p") / 2)), P * (K - P)).alias("roc_auc"), div(F.sum(F.col("p") * tp / seen), P).alias("average_precision"), ks.alias("ks"),
    )


def separation(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """For each feature: auc (the better direction) and ks between the classes."""
    long = df.select(label, F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in features))).alias("f")).select(label, "f.*")
    cut = _by_value(long, ["feature"], "value", label)  # one row per feature and distinct value
    totals = cut.groupBy("feature").agg(F.sum("p").alias("all_p"), F.sum("k").alias("all_k"))
    cut = running_counts(cut, F.col("v"), {"tp": "p", "seen": "k"}, within=("feature",)).join(F.broadcast(totals), "feature")  # one row for each feature
    cut = cut.withColumns({"tp": F.col("tp") + F.col("p"), "seen": F.col("seen") + F.col("k")})
    below = F.col("seen") - F.col("tp") - (F.col("k") - F.col("p")) / 2
    out = cut.groupBy("feature", "all_p", "all_k").agg(F.sum(F.col("p") * below).alias("u"), F.max(F.abs(F.col("tp") / F.col("all_p") - (F.col("seen") - F.col("tp")) / (F.col("all_k") - F.col("all_p")))).alias("ks"))
    auc = F.col("u") / (F.col("all_p") * (F.col("all_k") - F.col("all_p")))
    return out.select("feature", F.greatest(auc, 1 - auc).alias("auc"), "ks")


def separation_table(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """separation with each feature's size, mean and median in both classes (rows where it is there)."""
    names = {1: "positive", 0: "negative"}
    split = df.select(*(F.when(F.col(label) == v, F.col(c).cast("double")).alias(f"x{i}_{n}") for i, c in enumerate(features) for v, n in names.items()))
    columns = [f"x{i}_{n}" for i in range(len(features)) for n in names.values()]
    plain = split.agg(*(f(c).alias(f"{k}_{c}") for c in columns for k, f in (("n", F.count), ("mean", F.avg)))).first()
    middle = grouped_quantiles(split, [], {c: (c, 0.5) for c in columns}).first()
    rows = [(c, *(plain[f"{k}_x{i}_{n}"] for k in ("n", "mean") for n in names.values()), *(middle[f"x{i}_{n}"] if middle else None for n in names.values())) for i, c in enumerate(features)]
    kinds = ", ".join(f"{k}_{n} {'long' if k == 'n' else 'double'}" for k in ("n", "mean", "median") for n in names.values())
    return df.sparkSession.createDataFrame(rows, f"feature string, {kinds}").join(separation(df, features, label), "feature", "left")


def confusion(scored: DataFrame, score: str, label: str, threshold: float = 0.5) -> DataFrame:
    hit, pos = F.col(score) >= threshold, F.col(label) == 1
    return scored.agg(F.count_if(hit & pos).alias("tp"), F.count_if(hit & ~pos).alias("fp"), F.count_if(~hit & ~pos).alias("tn"), F.count_if(~hit & pos).alias("fn"))


def effect_sizes(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """For each feature: means by class and their difference over the sample deviation of all."""
    rows = []
    for c in features:
        a, b = F.avg(F.when(F.col(label) == 1, F.col(c))), F.avg(F.when(F.col(label) == 0, F.col(c)))
        rows.append(F.struct(F.lit(c).alias("feature"), a.alias("mean_positive"), b.alias("mean_negative"), F.try_divide(a - b, F.nullif(F.stddev_samp(c), F.lit(0.0))).alias("effect")))
    return df.agg(F.array(*rows).alias("r")).select(F.inline("r"))


def drift(reference: DataFrame, current: DataFrame, columns: list[str], small: int = 1000, wasserstein_limit: float = 0.1) -> DataFrame:
    """For each column: ks, its p_value, wasserstein, that over the reference's deviation, and drifted.

    Up to `small` rows a column drifts by the two-sample test at 5 % (exact law), beyond that by the normalised
    distance. Both come from one row per distinct value with the running difference of the two distributions, made by
    ranges of values, so no task orders a column. NaN counts as null.
    """
    tall = lambda df, side: df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in columns))).alias("f")).select("f.*", F.lit(side).alias("side")).where("v IS NOT NULL AND NOT isnan(v)")
    both = tall(reference, 1).unionByName(tall(current, 0))
    sizes = both.groupBy("feature").agg(F.sum("side").alias("n"), F.sum(1 - F.col("side")).alias("m"), F.stddev_pop(F.when(F.col("side") == 1, F.col("v"))).alias("sd"))
    counts = both.groupBy("feature", "v").agg(F.sum("side").alias("a"), F.sum(1 - F.col("side")).alias("b"))
    cut = running_counts(counts, F.col("v"), {"a0": "a", "b0": "b"}, within=("feature",)).join(F.broadcast(sizes), "feature")  # one row for each column
    # area between the curves: each value v adds v * (gap up to the value before - gap up to v)
    before = F.abs(F.try_divide("a0", "n") - F.try_divide("b0", "m"))
    gap = F.abs(F.try_divide(F.col("a0") + F.col("a"), F.col("n")) - F.try_divide(F.col("b0") + F.col("b"), F.col("m")))
    out = cut.groupBy("feature", "n", "m", "sd").agg(F.max(gap).alias("ks"), F.sum(F.col("v") * (before - gap)).alias("wasserstein"))
    out = out.withColumn("wasserstein", F.greatest("wasserstein", F.lit(0.0)))
    out = out.withColumn("distance", F.coalesce(F.try_divide(F.col("wasserstein"), F.nullif("sd", F.lit(0.0))), F.col("wasserstein")))
    law = F.when(F.greatest("n", "m") <= small, exact_p_value(F.col("ks"), F.col("n"), F.col("m")))
    out = out.withColumn("p_value", F.coalesce(law, ks_p_value(F.col("ks"), F.col("n"), F.col("m"))))
    drifted = F.when(F.greatest("n", "m") <= small, F.col("p_value") < 0.05).otherwise(F.col("distance") >= wasserstein_limit)
    return out.select("feature", F.col("n").cast("long").alias("n_reference"), F.col("m").cast("long").alias("n_current"), "ks", "p_value", "wasserstein", "distance", drifted.alias("drifted"))


def lattice_p_value(ks: float, n: int, m: int) -> float:
    """Of the two-sample test: the chance that a random order of n and m values has a difference of ks or more.

    An order is a path from (0, 0) to (n, m); p is the chance that a path has stayed below the difference, given where
    it is, diagonal after diagonal. Differences are whole multiples of 1 / (n m), so they are compared exactly.
    """
    limit, i = round(ks * n * m), np.arange(n + 1)
    p = np.zeros(n + 1)
    p[0] = float(limit > 0)
    for step in range(1, n + m + 1):
        j = step - i
        before = np.concatenate(([0.0], p[:-1]))
        p = (i * before + j * p) / step
        p[(j < 0) | (j > m) | (np.abs(i * m - j * n) >= limit)] = 0.0
    return float(min(1.0, max(0.0, 1.0 - p[n])))


def exact_p_value(ks: Column, n: Column, m: Column) -> Column:
    """lattice_p_value of each row (a row for each column compared); null for an empty side."""

    @F.pandas_udf("double")
    def law(ks: pd.Series, n: pd.Series, m: pd.Series) -> pd.Series:
        known = lambda x, a, b: x is not None and x == x and 0 < a <= EXACT and 0 < b <= EXACT
        return pd.Series([lattice_p_value(float(x), int(a), int(b)) if known(x, a, b) else None for x, a, b in zip(ks, n.fillna(0), m.fillna(0), strict=True)], dtype="float64")

    return law(ks.cast("double"), n.cast("long"), m.cast("long"))


def ks_p_value(ks: Column, n: Column, m: Column) -> Column:
    """Of the two-sample test: the Kolmogorov law at ks * sqrt(n m / (n + m))."""
    x = ks * F.sqrt(n * m / (n + m))
    terms = F.transform(F.sequence(F.lit(1), F.lit(60)), lambda j: F.when(j % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * j * j * x * x))
    return F.when(x < 0.2, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.aggregate(terms, F.lit(0.0), lambda s, t: s + t))))


def score_columns(reference: DataFrame, current: DataFrame, preferred: str = "hybrid_score") -> list[str]:
    """The columns to compare scored cohorts by: the preferred one, or else every shared one named like a score."""
    shared = [c for c in current.columns if c in reference.columns]
    return [preferred] if preferred in shared else [c for c in shared if "score" in c.lower()]


def prediction_drift(reference: DataFrame, current: DataFrame, **options) -> DataFrame:
    """drift() over the score columns; raises where there are none."""
    columns = score_columns(reference, current)
    if not columns:
        raise ValueError("no score columns in common")
    return drift(reference, current, columns, **options)


def monitored(reports: dict[str, Callable[[], DataFrame]], threshold: float = 0.3) -> dict:
    """drift_summary of each report and over all; a report that fails is named with its error and counts for nothing,
    so monitoring never stops a run."""
    found, errors = {}, {}
    for name, make in reports.items():
        try:
            found[name] = drift_summary(make(), threshold).first().asDict()
        except Exception as error:
            errors[name] = str(error).splitlines()[0][:300]
    shares = [r["drift_share"] for r in found.values() if r["drift_share"] is not None]
    share = round(sum(shares) / len(shares), 4) if shares else 0.0
    return {"reports": found, "errors": errors, "overall_drift_detected": any(r["drift_detected"] for r in found.values()), "average_drift_share": share, "above_threshold": bool(shares) and share >= threshold}


def drift_summary(found: DataFrame, threshold: float = 0.3) -> DataFrame:
    share = F.round(F.avg(F.col("drifted").cast("double")), 4)
    return found.agg(F.count("*").alias("columns"), F.count_if("drifted").alias("drifted_columns"), share.alias("drift_share"), (share >= threshold).alias("drift_detected"))
