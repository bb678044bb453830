"""A cohort scored anew in three parts (models without labels, models with labels, risk), its report files, and a
bundle refitted to a stored scored cohort."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drawlens.ml import models
from drawlens.operators import cohort, features, history, metrics, ranking
from drawlens.plans import scoring
from drawlens.sources import tables
from drawlens.sources.stages import stored, write_json

LABEL, KEY = "event_fraud_flag", "member_id"
QUEUE = ("member_id", "primary_ccs_id", "risk_score", "risk_tier", "anomaly_score", "supervised_score", "draws_played", "total_staked", "avg_entropy", "template_reuse_ratio", "avg_tiny_bet_ratio")
CAPTURED = {"anomaly": "anomaly_score", "supervised_oos": "supervised_score_eval", "combined_oos": "risk_score_eval"}
STATISTIC_TEXTS = {"sum": "Total", "avg": "Mean", "median": "Median", "std": "Sample deviation", "max": "Largest", "min": "Smallest"}


def refit(scored: DataFrame, **options) -> scoring.Bundle:
    """A bundle fitted to a stored scored cohort (its features, event_fraud_flag and risk_score): all models and their
    ranges are new, the tiers' quantiles are those of the stored risk scores."""
    columns = tuple(c for c in features.FEATURES if c in scored.columns)
    return scoring.fit(scored, columns, scored="risk_score", **options)


def without_labels(members: DataFrame, bundle: scoring.Bundle) -> DataFrame:
    """The members' features with components, cluster, anomaly score and coordinates. The supervised score comes of the
    same pass over the vectors and is kept."""
    scores = scoring.score(members, bundle)
    return members.join(scores.drop("primary_ccs_id", LABEL, "draws_played", "risk_score"), KEY)


def with_labels(rows: DataFrame, columns: tuple[str, ...] = features.FEATURES, seed: int = 42) -> DataFrame:
    """Adds is_test and supervised_score_eval, a score by a model that has not seen the row."""
    return rows.join(models.evaluation_scores(features.model_frame(rows, columns=columns), list(columns), LABEL, KEY, seed=seed), KEY)


def with_risk(rows: DataFrame) -> DataFrame:
    """Adds risk_score and risk_score_eval, risk_tier by the cohort's quantiles, risk_rank and the percentiles of all
    three scores."""
    mixed = lambda supervised: sum((F.lit(w) * F.col(supervised if c == "supervised_score" else c) for c, w in scoring.RISK.items()), F.lit(0.0))
    out = stored(rows.withColumns({"risk_score": mixed("supervised_score"), "risk_score_eval": mixed("supervised_score_eval"), "source": F.lit("precomputed")}), "risk")
    ranked = ranking.with_tiers(out)
    for score in ("risk", "anomaly", "supervised"):  # each of the stored rows: ranks of ranked rows would repeat those before
        names = {f"{score}_score_rank": f"{score}_rank", f"{score}_score_percentile": f"{score}_percentile"}
        placed = ranking.with_ranks(out.select(KEY, f"{score}_score"), f"{score}_score").withColumnsRenamed(names)
        ranked = ranked.join(placed.select(KEY, *(names.values() if score == "risk" else [f"{score}_percentile"])), KEY)
    return ranked


def rebuilt(members: DataFrame, bundle: scoring.Bundle, seed: int = 42) -> DataFrame:
    """The three parts in order, each stored."""
    rows = stored(without_labels(members, bundle), "unsupervised")
    return with_risk(stored(with_labels(rows, bundle.columns, seed), "supervised"))


def capture_table(cohort_rows: DataFrame) -> DataFrame:
    """Positives among the highest scores, by scores that have not seen the labels they are held against."""
    rows = cohort_rows.select(KEY, LABEL, *(F.col(c).alias(name) for name, c in CAPTURED.items()))
    return metrics.capture_topk(rows, list(CAPTURED), LABEL, KEY)


def feature_dictionary(columns: list[str], spark) -> DataFrame:
    """feature, description: what a member's column measures, told from the statistic and the history column it is of."""
    told = {name: f"{STATISTIC_TEXTS[s]} of {c} over the member's draws" for c, names in features.MEASURES.items() for s, name in names.items()}
    told |= {name: f"Distinct values of {c.lstrip('_')} among the member's draws" for name, c in features.DISTINCT.items()}
    told |= {c: f"{c.removeprefix('ccs_')} of the member's main group" for c in features.FEATURES if c.startswith("ccs_")}
    told |= {f"style_pc{i}": f"Coordinate on axis {i} of the style space" for i in (1, 2)} | {f"pc{i}": f"Coordinate on axis {i} of all features" for i in (1, 2)}
    return spark.createDataFrame([(c, told.get(c, c.replace("_", " ").capitalize())) for c in columns], "feature string, description string")


def rebuild(raw: DataFrame, labels: DataFrame, path: str, trees: int = 300, queue: int = 50, seed: int = 42) -> dict:
    """Everything from raw draws on: fits, scores, writes and gives the evaluation record.

    Below path: scored (Parquet), bundle.json, evaluation.json and the CSV reports queue, capture, importance and
    dictionary. Positives whose every draw follows their first event have no features; they are counted as dropped.
    """
    spark = raw.sparkSession
    marked = stored(history.with_event_label(history.with_draw_features(raw), labels), "marked")
    usable = stored(history.before_events(history.with_gaps(marked)), "usable")
    members = stored(features.member_features(usable), "members")
    bundle = scoring.fit(members, trees=trees, seed=seed)
    bundle.save(spark, f"{path}/bundle.json")
    rebuilt(members, bundle, seed).write.mode("overwrite").parquet(f"{path}/scored")
    scored = spark.read.parquet(f"{path}/scored")
    captured = stored(capture_table(scored), "captured")
    tables.write_csv(ranking.alert_queue(scored, queue).select(*QUEUE), f"{path}/queue")
    tables.write_csv(captured.orderBy("score_type", "k", "bucket"), f"{path}/capture")
    tables.write_csv(models.importance(bundle.logit, list(bundle.columns), spark), f"{path}/importance")
    tables.write_csv(feature_dictionary(scored.columns, spark), f"{path}/dictionary")
    known = cohort.member_counters(marked, usable).agg(F.sum(LABEL).alias("known"), F.sum("matched_event_rows").alias("rows"), F.sum("raw_history_rows").alias("raw"), F.sum("history_rows_used").alias("used")).first()
    facts = scored.agg(F.count("*").alias("members"), F.sum(F.col(LABEL).cast("long")).alias("positives")).first()
    record = {
        "members": facts.members, "positives": facts.positives, "dropped_positives": (known.known or 0) - (facts.positives or 0), "matched_event_rows": known.rows,
        "raw_rows": known.raw, "history_rows": known.used, "weights": scoring.RISK, "tiers": {r.risk_tier: r.members for r in ranking.tier_distribution(scored).collect()},
        "capture": [r.asDict() for r in captured.orderBy("score_type", "k", "bucket").collect()],
    }
    write_json(spark, f"{path}/evaluation.json", record)
    return record
