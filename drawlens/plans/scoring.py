"""Training and batch scoring: from draw records to a scored cohort, an alert queue and an evaluation."""

from __future__ import annotations

import uuid
from dataclasses import asdict, dataclass, field, replace
from datetime import UTC, datetime

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from drawlens.functions.scalars import normalised
from drawlens.ml import models
from drawlens.operators import checks, features, history, metrics, ranking
from drawlens.sources.stages import exists, latest_json, publish_json, read_json, stored, write_json

#: Shares of the three components in the anomaly score, and of anomaly and supervised score in the risk score.
ANOMALY = {"iso_forest_score": 0.40, "mahalanobis_distance": 0.30, "cluster_distance": 0.30}
RISK = {"anomaly_score": 0.60, "supervised_score": 0.40}


@dataclass(frozen=True)
class Style:
    """The style space: its columns, scaled, and two principal axes."""

    log_columns: tuple[str, ...]
    scaler: models.Scaler
    axes: models.Axes

    def coordinates(self) -> dict[str, Column]:
        x = self.scaler.vector(lambda c: features.model_value(c, self.log_columns))
        return {f"style_pc{i + 1}": self.axes.coordinate(x, i) for i in range(len(self.axes.loadings))}


@dataclass(frozen=True)
class Bundle:
    """What scoring needs; all of it small. axes and style are None in bundles stored without them."""

    columns: tuple[str, ...]
    log_columns: tuple[str, ...]
    scaler: models.Scaler
    forest: models.Forest
    ellipsoid: models.Ellipsoid
    centres: models.Centres
    logit: models.Logit
    bounds: dict[str, tuple[float, float]]
    quantiles: dict[str, float] = field(default_factory=dict)
    axes: models.Axes | None = None
    style: Style | None = None

    def save(self, spark: SparkSession, path: str) -> None:
        out = {
            "columns": self.columns, "log_columns": self.log_columns, "mean": self.scaler.mean, "scale": self.scaler.scale,
            "forest": [[x.tolist() for x in part] for part in (self.forest.feature, self.forest.value, self.forest.child)], "sample": self.forest.sample,
            "centre": self.ellipsoid.mean.tolist(), "precision": self.ellipsoid.precision.tolist(), "centres": self.centres.points,
            "weights": self.logit.weights, "intercept": self.logit.intercept, "bounds": self.bounds, "quantiles": self.quantiles,
            "axes": self.axes and asdict(self.axes), "style": self.style and asdict(self.style),
        }
        write_json(spark, path, out)

    @staticmethod
    def load(spark: SparkSession, path: str) -> Bundle:
        x = read_json(spark, path)
        parts = [np.array([np.array(t, k) for t in p] + [None], dtype=object)[:-1] for p, k in zip(x["forest"], (np.int64, np.float64, np.int64), strict=True)]
        scaler = models.Scaler(tuple(x["columns"]), tuple(x["mean"]), tuple(x["scale"]))
        axes = lambda a: models.Axes(tuple(map(tuple, a["loadings"])), tuple(a["explained"]))
        style = x.get("style") and Style(tuple(x["style"]["log_columns"]), models.Scaler(*(tuple(x["style"]["scaler"][k]) for k in ("columns", "mean", "scale"))), axes(x["style"]["axes"]))
        return Bundle(
            tuple(x["columns"]), tuple(x["log_columns"]), scaler, models.Forest(*parts, x["sample"]), models.Ellipsoid(np.array(x["centre"]), np.array(x["precision"])),
            models.Centres(tuple(map(tuple, x["centres"]))), models.Logit(tuple(x["weights"]), x["intercept"]), {k: tuple(v) for k, v in x["bounds"].items()}, x["quantiles"],
            x.get("axes") and axes(x["axes"]), style,
        )


def prepare(raw: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """Member features of records with typed bets; with labels without what follows a member's first event."""
    rows = history.with_gaps(history.with_draw_features(raw))
    if labels is not None:
        rows = history.before_events(history.with_event_label(rows, labels))
    return features.member_features(rows)


def fit_style(members: DataFrame, columns: tuple[str, ...] = features.STYLE, log_columns: tuple[str, ...] = features.LOG_STYLE) -> Style:
    frame = features.model_frame(members, log_columns, columns)
    scaler = models.fit_scaler(frame, list(columns))
    return Style(tuple(log_columns), scaler, models.fit_axes(frame, scaler.vector()))


def fit(members: DataFrame, columns: tuple[str, ...] = features.FEATURES, log_columns: tuple[str, ...] = features.LOG_FEATURES, trees: int = 300, k: int = 4, seed: int = 42, scored: str | None = None) -> Bundle:
    """Fits all models to the members. Quantiles of the risk are those of the column `scored` where it is given, else
    of the risk scores by the new models. The style space is fitted if the members have all its columns."""
    frame = stored(features.model_frame(members, log_columns, columns), "frame")
    scaler = models.fit_scaler(frame, list(columns))
    x = scaler.vector()
    parts = {
        "forest": models.fit_forest(frame, x, "member_id", trees, seed=seed),
        "ellipsoid": models.fit_ellipsoid(frame, x, len(columns)),
        "centres": models.fit_centres(frame, x, k, seed=seed),
        "logit": models.fit_logit(frame, x, "event_fraud_flag"),
        "axes": models.fit_axes(frame, x),
        "style": fit_style(members) if set(features.STYLE) <= set(members.columns) else None,
    }
    bundle = Bundle(tuple(columns), tuple(log_columns), scaler, bounds={}, **parts)
    found = stored(components(frame, bundle), "components")  # read for the bounds and for the quantiles
    got = found.agg(*(f(c).alias(f"{f.__name__}_{c}") for c in ANOMALY for f in (F.min, F.max))).first()
    bounds = {c: (got[f"min_{c}"], got[f"max_{c}"]) for c in ANOMALY}
    bundle = Bundle(tuple(columns), tuple(log_columns), scaler, bounds=bounds, **parts)
    q = ranking.quantiles(members if scored else mixed(found, bundle), scored or "risk_score", {"p80": 0.80, "p95": 0.95}).first().asDict()
    return replace(bundle, quantiles=q)


def components(frame: DataFrame, bundle: Bundle) -> DataFrame:
    x = F.col("_x")
    out = frame.withColumn("_x", bundle.scaler.vector())
    out = out.withColumns(
        {
            "iso_forest_score": bundle.forest.score(x), "mahalanobis_distance": bundle.ellipsoid.distance(x), "cluster": bundle.centres.cluster(x),
            "cluster_distance": bundle.centres.distance(x), "supervised_score": bundle.logit.probability(x),
        }
    )
    axes = {f"pc{i + 1}": bundle.axes.coordinate(x, i) for i in range(len(bundle.axes.loadings))} if bundle.axes else {}
    return out.select("member_id", *ANOMALY, "cluster", "supervised_score", *(c.alias(n) for n, c in axes.items()))


def mixed(found: DataFrame, bundle: Bundle) -> DataFrame:
    """components() with their normalised values, the anomaly score and the risk score."""
    norm = {f"{c}_norm": normalised(F.col(c), F.lit(bundle.bounds[c][0]), F.lit(bundle.bounds[c][1])) for c in ANOMALY}
    out = found.withColumns(norm).withColumn("anomaly_score", sum((F.lit(w) * F.col(f"{c}_norm") for c, w in ANOMALY.items()), F.lit(0.0)))
    return out.withColumn("risk_score", sum((F.lit(w) * F.col(c) for c, w in RISK.items()), F.lit(0.0)))


def score(members: DataFrame, bundle: Bundle) -> DataFrame:
    """Each member's component, anomaly, supervised and risk scores, by the bundle's own ranges, with its coordinates
    on the axes of all features (pc1, pc2) and of style (style_pc1, style_pc2) where the bundle has them."""
    out = mixed(components(features.model_frame(members, bundle.log_columns, bundle.columns), bundle), bundle)
    keep = [c for c in ("member_id", "primary_ccs_id", "event_fraud_flag", "draws_played") if c in members.columns]
    style = bundle.style.coordinates() if bundle.style and set(bundle.style.scaler.columns) <= set(members.columns) else {}
    return members.select(*keep, *(c.alias(n) for n, c in style.items())).join(out, "member_id")


def register(spark: SparkSession, bundle: Bundle, prefix: str = "") -> tuple[str, ...]:
    """Makes the bundle's scorers functions of SQL and gives their names: risk_score, anomaly_score, supervised_score,
    iso_forest_score and mahalanobis_distance, with the prefix before each.

    Each takes one array: a model frame's columns in the bundle's order. The bundle is broadcast once for all of them,
    and rows come in Arrow batches. A null array, or one with a null or NaN, has no score.
    """
    sent = spark.sparkContext.broadcast(bundle)

    def scores(rows: np.ndarray, asked: str) -> np.ndarray:
        b = sent.value
        x = (rows - np.array(b.scaler.mean)) / np.array(b.scaler.scale)
        logit = lambda: 1 / (1 + np.exp(-(x @ np.array(b.logit.weights) + b.logit.intercept)))
        if asked == "supervised_score":
            return logit()
        parts = {"iso_forest_score": lambda: b.forest.of(x), "mahalanobis_distance": lambda: b.ellipsoid.of(x)}
        if asked in parts:
            return parts[asked]()
        points = np.array(b.centres.points)
        parts["cluster_distance"] = lambda: np.sqrt(((x[:, None, :] - points) ** 2).sum(axis=2).min(axis=1))
        anomaly = sum(w * norm(parts[c](), *b.bounds[c]) for c, w in ANOMALY.items())
        return anomaly if asked == "anomaly_score" else RISK["anomaly_score"] * anomaly + RISK["supervised_score"] * logit()

    def norm(x: np.ndarray, low: float, high: float) -> np.ndarray:
        return np.clip((x - low) / (high - low), 0, 1.5) if high > low else np.zeros(len(x))

    names = ("risk_score", "anomaly_score", "supervised_score", "iso_forest_score", "mahalanobis_distance")

    def function(name: str):
        @F.pandas_udf("double")
        def run(x: pd.Series) -> pd.Series:
            there = np.array([v is not None and not any(e is None or e != e for e in v) for v in x], dtype=bool)
            out = np.full(len(x), np.nan)
            if there.any():
                out[there] = scores(np.stack([np.asarray(v, np.float64) for v in x[there]]), name)
            return pd.Series(out).where(there, None)

        return run

    for name in names:
        spark.udf.register(f"{prefix}{name}", function(name))
    return tuple(f"{prefix}{n}" for n in names)


def batch_score(raw: DataFrame, bundle: Bundle, path: str, labels: DataFrame | None = None, min_draws: int | None = 10, queue: int = 50) -> dict:
    """Writes cohort and queue below path and gives a summary; with labels also capture statistics (replay)."""
    scored = ranking.with_ranks(ranking.with_tiers(stored(score(stored(prepare(raw, labels), "members"), bundle), "scores")), "risk_score")
    scored.write.mode("overwrite").parquet(f"{path}/scored")
    scored = raw.sparkSession.read.parquet(f"{path}/scored")
    ranking.alert_queue(scored, queue, min_draws).coalesce(1).write.mode("overwrite").option("header", True).csv(f"{path}/queue")
    facts = scored.agg(F.count("*").alias("members"), F.avg("risk_score").alias("mean")).first().asDict()
    facts |= ranking.quantiles(scored, "risk_score", {"median": 0.5, "p95": 0.95}).first().asDict()
    facts["tiers"] = {x.risk_tier: x.members for x in ranking.tier_distribution(scored).collect()}
    if labels is not None:
        found = metrics.capture_topk(scored, ["anomaly_score", "supervised_score", "risk_score"], "event_fraud_flag", "member_id")
        facts["capture"] = [x.asDict() for x in found.collect()]
    facts["mode"] = "operational" if labels is None else "replay_eval"
    return facts


def decide(facts: dict, min_capture: float = 0.40, min_lift: float = 5.0) -> dict:
    """Whether a run is promoted, and why not."""
    row = next(x for x in facts["capture"] if x["score_type"] == "risk_score" and x["bucket"] == "top_5pct")
    reasons = [f"{k} {row[k]:.4g} is below {limit:g}" for k, limit in (("capture_rate", min_capture), ("lift", min_lift)) if row[k] < limit]
    return {"promoted": not reasons, "reasons": reasons, "metrics": {k: row[k] for k in ("capture_rate", "lift")}, "thresholds": {"capture_rate": min_capture, "lift": min_lift}}


def train(raw: DataFrame, labels: DataFrame, path: str, trees: int = 300, min_rows: int = 1000) -> dict:
    """Validates, fits, scores, evaluates and, if the gate passes, publishes the bundle as the current one."""
    checks.validate(raw, labels.columns, min_rows=min_rows)
    bundle = fit(stored(prepare(raw, labels), "members"), trees=trees)
    bundle.save(raw.sparkSession, f"{path}/bundle.json")
    facts = batch_score(raw, bundle, path, labels)
    decision = decide(facts)
    if decision["promoted"]:
        publish(raw.sparkSession, path, bundle)
    return facts | {"decision": decision}


def publish(spark: SparkSession, path: str, bundle: Bundle, keep: int = 5) -> str:
    """Makes a run's cohort and bundle the published ones: both go to a new folder of their own, and only then is the
    pointer to them put beside the ones before. Readers have the old version whole or the new one whole."""
    version = f"{path}/versions/{datetime.now(UTC):%Y%m%dT%H%M%S%f}-{uuid.uuid4().hex[:8]}"
    spark.read.parquet(f"{path}/scored").write.parquet(f"{version}/scored")
    bundle.save(spark, f"{version}/bundle.json")
    publish_json(spark, f"{path}/current", {"bundle": f"{version}/bundle.json", "scored": f"{version}/scored", "at": datetime.now(UTC).isoformat()}, keep)
    return version


def current(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """The published cohort (ids trimmed, upper case) and its manifest with snapshot_available, snapshot_status and
    snapshot_reason. Without a manifest that is an error; without its cohort an empty table with the reason."""
    manifest, at = latest_json(spark, f"{path}/current"), f"{path}/current.json"
    if manifest is None:  # a pointer put there by hand
        if not exists(spark, at):
            raise FileNotFoundError(f"no serving manifest at {path}/current")
        manifest = read_json(spark, at)
    reason = None
    if not manifest.get("scored"):
        reason = "the snapshot has not been generated yet"
    elif not (exists(spark, f"{manifest['scored']}/_SUCCESS") and exists(spark, manifest["bundle"])):
        reason = "the snapshot is incomplete"
    if reason:
        scored = spark.createDataFrame([], "member_id string, risk_score double, risk_tier string")
    else:
        scored = spark.read.parquet(manifest["scored"]).withColumn("member_id", F.upper(F.trim("member_id")))
    return scored, manifest | {"snapshot_available": reason is None, "snapshot_status": "insufficient_data" if reason else "ready", "snapshot_reason": reason}


def lookup(scored: DataFrame, member: str) -> dict:
    """One member's scores, or why there are none."""
    who = member.strip().upper()
    row = scored.where(F.col("member_id") == who).limit(1).collect()
    return row[0].asDict() if row else {"member_id": who, "status": "insufficient_data"}
