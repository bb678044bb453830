"""Anomaly and supervised models over a frame of doubles (member_id, features...).

Fits need only sums over the data (means, covariance), Spark ML, or bounded samples (isolation trees); scores are
expressions or vectorised functions over Arrow batches. Fitted models are small and plain.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseMatrix
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from drawlens.operators.products import covariance_matrix
from drawlens.operators.ranking import positions
from drawlens.sources.stages import discard, stored


@dataclass(frozen=True)
class Scaler:
    columns: tuple[str, ...]
    mean: tuple[float, ...]
    scale: tuple[float, ...]

    def vector(self, value: Callable[[str], Column] = F.col) -> Column:
        """The scaled columns as an array; value gives a column's expression."""
        return F.array(*((value(c) - F.lit(m)) / F.lit(s) for c, m, s in zip(self.columns, self.mean, self.scale, strict=True)))


def fit_scalers(frame: DataFrame, columns: list[str], inside: list[Column]) -> list[Scaler]:
    """For each condition means and population deviations (1 where that is 0, or rounding of the mean: a column of one
    value in fractions would else become noise of unit size) of the rows where it holds.

    One pass for all: each task gives counts, means and squares around them, and these few numbers are merged. Nulls
    count for nothing.
    """
    d, k = len(columns), len(inside)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, mean, square = np.zeros((k, d)), np.zeros((k, d)), np.zeros((k, d))
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[1:]])
            valid = np.column_stack([c.is_valid().to_numpy(zero_copy_only=False) for c in batch.columns[1:]])
            there = batch.column(0).to_numpy(zero_copy_only=False)
            for m in range(k):
                mine = (there >> m & 1).astype(bool)
                rows, has = x[mine], valid[mine]
                more = has.sum(axis=0).astype(np.float64)
                centre = np.where(has, rows, 0.0).sum(axis=0) / np.maximum(more, 1)
                total, apart = np.maximum(n[m] + more, 1), centre - mean[m]
                square[m] += (np.where(has, rows - centre, 0.0) ** 2).sum(axis=0) + apart**2 * n[m] * more / total
                mean[m] += apart * more / total
                n[m] += more
        at = np.arange(k * d)
        yield pa.record_batch([pa.array(at, pa.int32()), *(pa.array(v.ravel()) for v in (n, mean, square))], names=["i", "n", "mean", "square"])

    numbers = frame.select(_members_of(inside).alias("m"), *(F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)))
    parts = numbers.mapInArrow(run, "i int, n double, mean double, square double").where("n > 0")
    total = lambda value: F.aggregate("p", F.lit(0.0), lambda s, x: s + value(x))
    merged = parts.groupBy("i").agg(F.collect_list(F.struct("n", "mean", "square")).alias("p"))  # one item for each task
    merged = merged.withColumn("all", total(lambda x: x["n"])).withColumn("mean", total(lambda x: x["n"] * x["mean"]) / F.col("all"))
    spread = total(lambda x: x["square"] + x["n"] * (x["mean"] - F.col("mean")) * (x["mean"] - F.col("mean"))) / F.col("all")
    stats = {r.i: r for r in merged.select("i", "mean", F.sqrt(spread).alias("s")).collect()}
    out = []
    for m in range(k):
        found = [(r.mean, r.s) if (r := stats.get(m * d + i)) else (0.0, 0.0) for i in range(d)]
        out.append(Scaler(tuple(columns), tuple(x for x, _ in found), tuple(s if s > 1e-9 * abs(x) else 1.0 for x, s in found)))
    return out


def fit_scaler(frame: DataFrame, columns: list[str]) -> Scaler:
    """The scaler of all rows."""
    return fit_scalers(frame, columns, [F.lit(True)])[0]


def _members_of(inside: list[Column]) -> Column:
    """The conditions that hold, as bits."""
    mask = F.lit(0)
    for m, c in enumerate(inside):
        mask = mask + F.when(c, 1 << m).otherwise(0)
    return mask


@dataclass(frozen=True)
class Ellipsoid:
    """Mean and pseudo-inverse of the sample covariance."""

    mean: np.ndarray
    precision: np.ndarray

    def distance(self, vector: Column) -> Column:
        ellipsoid = self

        @F.pandas_udf("double")
        def score(x: pd.Series) -> pd.Series:
            return pd.Series(ellipsoid.of(np.stack(x.to_numpy())) if len(x) else [], dtype="float64")

        return score(vector)

    def of(self, rows: np.ndarray) -> np.ndarray:
        d = rows - self.mean
        return np.sqrt(np.maximum(np.einsum("ij,jk,ik->i", d, self.precision, d), 0))


def fit_ellipsoid(frame: DataFrame, vector: Column, n: int) -> Ellipsoid:
    """Covariance from sums of products: one pass, one row of n * (n + 1) / 2 numbers to the driver."""
    columns = [f"x{i}" for i in range(n)]
    mean, cov = covariance_matrix(frame.select(vector.alias("x")).select(*(F.col("x")[i].alias(c) for i, c in enumerate(columns))), columns)
    return Ellipsoid(mean, np.linalg.pinv(cov, hermitian=True))


@dataclass(frozen=True)
class Centres:
    points: tuple[tuple[float, ...], ...]

    def _squares(self, vector: Column) -> list[Column]:
        square = lambda p: F.aggregate(F.zip_with(vector, F.array(*map(F.lit, p)), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
        return [square(p) for p in self.points]

    def cluster(self, vector: Column) -> Column:
        d = F.array(*self._squares(vector))
        return (F.array_position(d, F.array_min(d)) - 1).cast("int")

    def distance(self, vector: Column) -> Column:
        return F.sqrt(F.array_min(F.array(*self._squares(vector))))


def _vectors(frame: DataFrame, vector: Column, keep: tuple[str, ...] = ()) -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    return frame.select(*keep, array_to_vector(vector).alias("features"))


def fit_centres(frame: DataFrame, vector: Column, k: int = 4, tries: int = 10, seed: int = 42) -> Centres:
    """The best of several k-means runs, with centres in ascending order so that cluster numbers are stable.

    The vectors are stored, not cached: read back they come in as few tasks as their bytes need, and every task of every
    step of every run reports to the driver; each run keeps them in memory itself.
    """
    rows = stored(_vectors(frame, vector), "vectors")
    runs = [KMeans(k=k, seed=seed + i, maxIter=100).fit(rows) for i in range(tries)]
    best = min(runs, key=lambda m: m.summary.trainingCost)
    discard(rows)
    return Centres(tuple(sorted(tuple(float(x) for x in c) for c in best.clusterCenters())))


def cluster_count(n: int | Column) -> int | Column:
    """Clusters for so many members (a number or a column): an eighth of them, within 2 and 4."""
    if isinstance(n, Column):
        return F.least(F.lit(4), F.greatest(F.lit(2), F.when(n >= 16, F.floor(n / 8)).otherwise(2))).cast("int")
    return min(4, max(2, n // 8 if n >= 16 else 2))


@dataclass(frozen=True)
class Axes:
    loadings: tuple[tuple[float, ...], ...]
    explained: tuple[float, ...]

    def coordinate(self, vector: Column, i: int) -> Column:
        return F.aggregate(F.zip_with(vector, F.array(*map(F.lit, self.loadings[i])), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)


def fit_axes(frame: DataFrame, vector: Column, k: int = 2) -> Axes:
    """Principal components; each axis points so that its largest loading is positive."""
    model = PCA(k=k, inputCol="features", outputCol="pc").fit(_vectors(frame, vector))
    pc: DenseMatrix = model.pc
    columns = pc.toArray().T
    signed = [c * (1 if c[np.argmax(np.abs(c))] >= 0 else -1) for c in columns]
    return Axes(tuple(tuple(float(x) for x in c) for c in signed), tuple(float(x) for x in model.explainedVariance.toArray()))


def loadings_table(axes: Axes, columns: list[str], spark) -> DataFrame:
    rows = [(c, i, axes.loadings[i][j], axes.explained[i]) for i in range(len(axes.loadings)) for j, c in enumerate(columns)]
    return spark.createDataFrame(rows, "feature string, component int, loading double, explained double")


@dataclass(frozen=True)
class Logit:
    weights: tuple[float, ...]
    intercept: float

    def probability(self, vector: Column) -> Column:
        z = F.aggregate(F.zip_with(vector, F.array(*map(F.lit, self.weights)), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x) + F.lit(self.intercept)
        return 1 / (1 + F.exp(-z))


def _passes(frame: DataFrame, vector: Column, label: str, scalers: list[Scaler | None], inside: list[Column], at: list[np.ndarray], weights: list[tuple[float, float]], at_once: int = 4096) -> list[np.ndarray]:
    """For each model its loss, gradient and Hessian (upper triangle) at a point, without the penalty, summed over the
    rows inside it: one pass for all of them, which adds a few matrices in each task."""
    n = len(at[0])
    upper = np.triu_indices(n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(at), 1 + n + len(upper[0])))
        for batch in batches:
            for start in range(0, batch.num_rows, at_once):
                part = batch.slice(start, at_once)
                x = part.column("x").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, n - 1)
                y, there = part.column("y").to_numpy(zero_copy_only=False), part.column("m").to_numpy(zero_copy_only=False)
                for m, (scaler, point, (w0, w1)) in enumerate(zip(scalers, at, weights, strict=True)):
                    mine = (there >> m & 1).astype(bool)
                    rows = x[mine] if scaler is None else (x[mine] - np.array(scaler.mean)) / np.array(scaler.scale)
                    rows, hit = np.column_stack((rows, np.ones(len(rows)))), y[mine] == 1
                    z, w = rows @ point, np.where(hit, w1, w0)
                    p = np.exp(-np.logaddexp(0, -z))
                    curve = (rows * (w * p * np.exp(-np.logaddexp(0, z)))[:, None]).T @ rows
                    total[m] += np.concatenate(([(w * np.logaddexp(0, np.where(hit, -z, z))).sum()], (w * (p - hit)) @ rows, curve[upper]))
        yield pa.record_batch([pa.array(np.repeat(np.arange(len(at)), total.shape[1]), pa.int32()), pa.array(np.tile(np.arange(total.shape[1]), len(at)), pa.int32()), pa.array(total.ravel())], names=["m", "i", "v"])

    sums = frame.select(vector.alias("x"), F.coalesce(F.col(label).cast("int"), F.lit(0)).alias("y"), _members_of(inside).alias("m")).mapInArrow(run, "m int, i int, v double")
    out = np.zeros((len(at), 1 + n + len(upper[0])))
    for r in sums.groupBy("m", "i").agg(F.sum("v").alias("v")).collect():
        out[r.m, r.i] = r.v
    return list(out)


def fit_logits(frame: DataFrame, vector: Column, label: str, scalers: list[Scaler | None], inside: list[Column], c: float = 0.1, iterations: int = 2000) -> list[Logit]:
    """L2-regularised logistic regressions with classes of equal total weight, one for each scaler (of vector; None:
    as it is) over the rows where its condition holds.

    Newton's method: the penalised loss is strictly convex, so that its one minimum is found in some ten passes, where
    a method of gradients takes hundreds. All models share each pass; a step that does not lower the loss is halved.
    """
    sides = frame.groupBy(F.col(label).alias("y")).agg(*(F.count_if(x).alias(f"n{m}") for m, x in enumerate(inside))).collect()
    weights, sizes = [], []
    for m in range(len(inside)):
        counts = {r["y"]: r[f"n{m}"] for r in sides if r[f"n{m}"]}
        if len(counts) < 2:
            raise ValueError("both classes are needed")
        sizes.append(sum(counts.values()))
        weights.append((sizes[m] / (2 * counts[0]), sizes[m] / (2 * counts[1])))
    first = frame.select(F.size(vector).alias("n")).first()
    n, upper = first.n + 1, np.triu_indices(first.n + 1)
    penalty = np.append(np.full(n - 1, 1 / c), 0.0)
    at = {m: np.zeros(n) for m in range(len(inside))}
    best: dict[int, tuple[float, np.ndarray, np.ndarray]] = {}  # loss, point and step of the best point so far
    todo = list(at)
    for _ in range(iterations):
        if not todo:
            break
        found = _passes(frame, vector, label, [scalers[m] for m in todo], [inside[m] for m in todo], [at[m] for m in todo], [weights[m] for m in todo])
        for m, sums in zip(list(todo), found, strict=True):
            loss = sums[0] + (penalty * at[m] ** 2).sum() / 2
            if m in best and not loss <= best[m][0] + 1e-12 * abs(best[m][0]):
                best[m] = (best[m][0], best[m][1], best[m][2] / 2)
            else:
                gradient, hessian = sums[1 : n + 1] + penalty * at[m], np.zeros((n, n))
                hessian[upper] = sums[n + 1 :]
                hessian = hessian + np.triu(hessian, 1).T + np.diag(penalty)
                step = np.linalg.lstsq(hessian, -gradient, rcond=None)[0]
                best[m] = (loss, at[m], step)
                if -(gradient @ step) <= 1e-14 * (1 + loss):  # twice what is left to gain, from where steps square the error
                    todo.remove(m)
            at[m] = best[m][1] + best[m][2]
    return [Logit(tuple(float(x) for x in at[m][:-1]), float(at[m][-1])) for m in at]


def fit_logit(frame: DataFrame, vector: Column, label: str, c: float = 0.1, iterations: int = 2000) -> Logit:
    """L2-regularised logistic regression with classes of equal total weight."""
    return fit_logits(frame, vector, label, [None], [F.lit(True)], c, iterations)[0]


def importance(model: Logit, columns: list[str], spark) -> DataFrame:
    return spark.createDataFrame([(c, w, abs(w)) for c, w in zip(columns, model.weights, strict=True)], "feature string, weight double, importance double").orderBy(F.desc("importance"), "feature")


def _dealt(frame: DataFrame, label: str, key: str, seed: int) -> DataFrame:
    """Adds _place (from 0) in each class in order of a hash of the id, then the id."""
    return positions(frame.withColumn("_u", F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))))), [label], [F.col("_u"), F.col(key)]).withColumnRenamed("position", "_place").drop("_u")


def folds(frame: DataFrame, label: str, key: str, k: int, seed: int = 42) -> DataFrame:
    """Adds fold (0 to k - 1): each class is dealt out in the order of a hash of the id, so that the sizes of its parts
    differ by one at most."""
    return _dealt(frame, label, key, seed).withColumn("fold", (F.col("_place") % k).cast("int")).drop("_place")


def test_split(frame: DataFrame, label: str, key: str, share: float = 0.3, seed: int = 42) -> DataFrame:
    """Adds is_test (0/1): in each class the first `share` (rounded half up) by a hash of the id."""
    sizes = frame.groupBy(F.col(label).alias("_class")).agg(F.floor(F.count("*") * F.lit(share) + 0.5).alias("_first"))
    out = _dealt(frame, label, key, seed).join(F.broadcast(sizes), F.col(label).eqNullSafe(F.col("_class")))  # one row for each class
    return out.withColumn("is_test", (F.col("_place") < F.col("_first")).cast("int")).drop("_place", "_class", "_first")


def fold_count(positives: int) -> int:
    """As many folds as positives, within 2 and 5."""
    return max(2, min(5, positives))


def _scored_by_fold(rows: DataFrame, columns: list[str], label: str, key: str, folds: list[int], c: float) -> DataFrame:
    """key, fold, supervised_score_eval: rows of each of the folds scored by a model of the rows that are neither in it
    nor in fold -1; rows of fold -1 by one of all others."""
    inside = [~F.col("fold").isin(-1, i) for i in folds]
    scalers = fit_scalers(rows, columns, inside)
    fitted = fit_logits(rows, F.array(*columns), label, scalers, inside, c)
    score = F.lit(None).cast("double")
    for i, scaler, model in zip(folds, scalers, fitted, strict=True):
        score = F.when(F.col("fold") == i, model.probability(scaler.vector())).otherwise(score)
    return rows.select(key, "fold", score.alias("supervised_score_eval"))


def out_of_fold(frame: DataFrame, columns: list[str], label: str, key: str, k: int, c: float = 0.1) -> DataFrame:
    """key, supervised_score_eval: each row scored by a model fitted without its fold."""
    rows = stored(folds(frame, label, key, k), "folds")
    return _scored_by_fold(rows, columns, label, key, list(range(k)), c).drop("fold")


def evaluation_scores(frame: DataFrame, columns: list[str], label: str, key: str, share: float = 0.3, c: float = 0.1, seed: int = 42) -> DataFrame:
    """key, is_test, supervised_score_eval for every row: held-out rows by a model of the development rows, those by
    models fitted without their fold. With fewer than two positives all rows are development rows; without a
    positive outside some fold no model can be fitted, and an error says so."""
    positives = frame.where(F.col(label) == 1).count()
    rows = test_split(frame, label, key, share, seed) if positives >= 2 else frame.withColumn("is_test", F.lit(0))
    rows = stored(rows, "split")
    dev, held = rows.where("is_test = 0"), rows.where("is_test = 1")
    k = fold_count(dev.where(F.col(label) == 1).count())
    dealt = folds(dev, label, key, k).unionByName(held.withColumn("fold", F.lit(-1)))
    dealt = stored(dealt.select(key, label, *columns, "fold"), "folds")
    return _scored_by_fold(dealt, columns, label, key, [-1, *range(k)], c).select(key, (F.col("fold") == -1).cast("int").alias("is_test"), "supervised_score_eval")


def comparison_models(frame: DataFrame, columns: list[str], label: str, key: str, threshold: float = 0.5, trees: int = 50, seed: int = 42) -> DataFrame:
    """Logistic regression, random forest and boosted trees on one nested split (30 % test, then 30 % of the rest for
    validation): model, part, members, positives and recall at the threshold."""
    rows = test_split(frame, label, key, 0.3, seed).withColumnRenamed("is_test", "_test")
    rest = test_split(rows.where("_test = 0"), label, key, 0.3, seed + 1).withColumn("part", F.when(F.col("is_test") == 1, "validation").otherwise("train")).drop("is_test")
    rows = stored(rest.unionByName(rows.where("_test = 1").withColumn("part", F.lit("test"))), "nested")
    scaler = fit_scaler(rows.where("part = 'train'"), columns)
    scored = _vectors(rows, scaler.vector(), (label, "part"))
    train, parts = scored.where("part = 'train'"), []
    score = lambda df: df.withColumn("_p", vector_to_array("probability")[1])
    logit = fit_logit(rows.where("part = 'train'"), scaler.vector(), label)
    parts.append(rows.select(label, "part", logit.probability(scaler.vector()).alias("_p")).withColumn("model", F.lit("logistic")))
    for name, kind in (("random_forest", RandomForestClassifier(labelCol=label, numTrees=trees, maxDepth=5, seed=seed)), ("boosted_trees", GBTClassifier(labelCol=label, maxIter=max(5, trees // 5), maxDepth=3, seed=seed))):
        parts.append(score(kind.fit(train).transform(scored)).select(label, "part", "_p").withColumn("model", F.lit(name)))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    hit = F.avg(F.when(F.col(label) == 1, (F.col("_p") >= threshold).cast("double")))
    return every.groupBy("model", "part").agg(F.count("*").alias("members"), F.sum(F.col(label).cast("long")).alias("positives"), hit.alias("recall"))


# isolation forest


def _c(n: float) -> float:
    return 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n if n > 2 else float(n == 2)


@dataclass(frozen=True)
class Forest:
    """Trees as arrays: feature (-1 at a leaf, whose value is its depth with the rest's mean), threshold, left child."""

    feature: np.ndarray
    value: np.ndarray
    child: np.ndarray
    sample: int

    def score(self, vector: Column) -> Column:
        """2 ** -(mean depth / expected depth); higher is stranger."""
        forest = self

        @F.pandas_udf("double")
        def run(x: pd.Series) -> pd.Series:
            return pd.Series(forest.of(np.stack(x.to_numpy())) if len(x) else [], dtype="float64")

        return run(vector)

    def of(self, rows: np.ndarray) -> np.ndarray:
        depth, flat, start = np.zeros(len(rows)), np.ascontiguousarray(rows, np.float64).ravel(), np.arange(len(rows)) * rows.shape[1]
        for feature, value, child in zip(self.feature, self.value, self.child, strict=True):
            # all rows go down together: a leaf leads to itself, as nothing is above infinity
            leaf = feature < 0
            column, cut, left = np.where(leaf, 0, feature), np.where(leaf, np.inf, value), np.where(leaf, np.arange(len(feature)), child)
            node = np.zeros(len(rows), np.int64)
            while not leaf[node].all():
                node = left[node] + (flat[start + column[node]] > cut[node])
            depth += value[node]
        return 2.0 ** (-depth / len(self.feature) / max(_c(self.sample), 1e-9))


def _grow(rows: np.ndarray, rng: np.random.Generator) -> tuple[list[int], list[float], list[int]]:
    feature, value, child, limit = [0], [0.0], [0], math.ceil(math.log2(max(2, len(rows))))
    todo = [(0, rows, 0)]
    while todo:
        node, part, depth = todo.pop()
        # a column whose values differ by rounding alone is constant: a cut there would fall differently each time
        spread = np.flatnonzero(np.ptp(part, axis=0) > 1e-9 * np.maximum(1, np.abs(part).max(axis=0))) if len(part) > 1 else np.zeros(0, int)
        if depth >= limit or not len(spread):
            feature[node], value[node] = -1, depth + _c(len(part))
            continue
        f = int(rng.choice(spread))
        cut = float(rng.uniform(part[:, f].min(), part[:, f].max()))
        feature[node], value[node], child[node] = f, cut, len(feature)
        right = part[:, f] > cut
        for half in (part[~right], part[right]):
            todo.append((len(feature), half, depth + 1))
            feature.append(0)
            value.append(0.0)
            child.append(0)
    return feature, value, child


def _candidates(frame: DataFrame, vector: Column, key: str, trees: int, share: float, seed: int) -> DataFrame:
    """key, x, tree, h: each tree's rows with the smallest hashes, about this share of all.

    Rows meet all trees in compiled code, which drops most at once; only what is left gets its vector.
    """
    end = F.lit(int(-(2**63) + share * (2**64 - 1)) if share < 1 else 2**63 - 1)
    met = frame.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))).withColumn("h", F.xxhash64(F.col(key), F.col("tree"), F.lit(seed)))
    return met.where(F.col("h") <= end).select(key, vector.alias("x"), "tree", "h")


def fit_forest(frame: DataFrame, vector: Column, key: str, trees: int = 300, sample: int = 256, seed: int = 42) -> Forest:
    """Isolation forest (Liu, Ting & Zhou 2008). Each tree sees up to `sample` rows, the first by a hash of (id, tree).

    Rows far from any tree's first ones are dropped by a threshold on the hash before they are ordered, so what moves
    is about twice trees * sample rows, and trees grow where their rows are.
    """
    n = frame.count()
    tagged = _candidates(frame, vector, key, trees, min(1.0, 2.0 * sample / max(1, n) + 64 / max(1, n)), seed)
    few = tagged.withColumn("n", F.row_number().over(W.partitionBy("tree").orderBy("h", key))).where(F.col("n") <= sample)

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("n")
        tree = int(pdf.tree.iloc[0])
        f, v, c = _grow(np.stack(pdf.x.to_numpy()), np.random.default_rng((seed, tree)))
        return pd.DataFrame({"tree": [tree], "feature": [f], "value": [v], "child": [c]})

    grown = few.select("tree", "n", "x").groupBy("tree").applyInPandas(grow, "tree int, feature array<int>, value array<double>, child array<int>").orderBy("tree").collect()
    as_arrays = lambda name, kind: np.array([np.array(row[name], kind) for row in grown] + [None], dtype=object)[:-1]
    return Forest(as_arrays("feature", np.int64), as_arrays("value", np.float64), as_arrays("child", np.int64), min(sample, n))
