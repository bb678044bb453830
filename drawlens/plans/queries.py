"""The library's queries over the given tables, each with its SQL where SQL can say it.

Doubles are rounded to six places at the end of a query.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from drawlens.functions import bets as B
from drawlens.functions import scalars as S
from drawlens.ml import models
from drawlens.operators import checks, explore, features, history, metrics, products, ranking
from drawlens.plans import oracles as O
from drawlens.plans import scoring
from drawlens.sources import tables
from drawlens.sources.stages import stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = f(spark, sf_dir)
            return out.select(*(F.round(c, 6).alias(c) if kind == "double" else F.col(c) for c, kind in out.dtypes))

        QUERIES[f.__name__] = run
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def r(*names: str) -> str:
    return ", ".join(f"round({n}, 6) AS {n.split('.')[-1]}" for n in names)


# what several queries share


def _featured(spark, d):
    return history.with_draw_features(tables.draws(spark, d))


def _marked(spark, d):
    """Labelled draws with their features, stored once as several passes read them."""
    return stored(history.with_event_label(_featured(spark, d).drop("bets"), tables.event_labels(spark, d)), "marked")


def _labelled(spark, d):
    return history.with_gaps(_marked(spark, d))


def _history(spark, d):
    return stored(history.gaps_before_events(_marked(spark, d)), "history")


def _members(spark, d):
    return features.member_features(_history(spark, d))


def _scored(spark, d):
    m = stored(features.core_features(_history(spark, d)), "members")
    b = m.agg(F.min("stake_cv"), F.max("stake_cv"), F.min("total_staked"), F.max("total_staked")).first()
    a = S.normalised(F.col("stake_cv"), F.lit(b[0]), F.lit(b[1]))
    s = S.normalised(F.col("total_staked"), F.lit(b[2]), F.lit(b[3]))
    out = m.select("member_id", "draws_played", "event_fraud_flag", "primary_ccs_id", F.round(a, 6).alias("anomaly_score"), F.round(s, 6).alias("supervised_score"))
    return stored(out.withColumn("risk_score", F.round(0.6 * F.col("anomaly_score") + 0.4 * F.col("supervised_score"), 6)), "scored")


IN_DRAW = ("tiny_bet_ratio_in_draw", "max_bet_share_in_draw", "bet_amount_std_in_draw", "bet_amount_mean_in_draw", "entropy_in_draw", "gini_in_draw", "position_coverage")

# draws and history


@query(f"WITH {O.FEATURES} SELECT member_id, draw_id, bets_per_draw, nonzero_bets_per_draw, nonzero_bets_per_draw AS unique_positions_in_draw, net_result, {r(*IN_DRAW)} FROM featured")
def draw_features(spark, d):
    return _featured(spark, d).select("member_id", "draw_id", "bets_per_draw", "nonzero_bets_per_draw", "unique_positions_in_draw", "net_result", *IN_DRAW)


@query(
    f"""WITH {O.FEATURES} SELECT draw_id, len(list_distinct(list_transform(bets, lambda b: b.number)))::BIGINT AS distinct_numbers_in_draw,
    len(list_filter(bets, lambda b: b.bet_amount > 0 AND b.bet_amount <= 1))::BIGINT AS tiny_bets_per_draw,
    round(CASE WHEN len(bets) > 0 THEN len(list_filter(bets, lambda b: b.bet_amount > 0 AND b.bet_amount <= 1)) / len(bets)::DOUBLE END, 6) AS tiny_bet_ratio_all,
    list_max(list_transform(bets, lambda b: b.bet_amount)) AS max_bet_amount_in_draw,
    round(CASE WHEN len(bets) > 0 AND total_bet_amount > 0 THEN list_max(list_transform(bets, lambda b: b.bet_amount)) / total_bet_amount END, 6) AS max_bet_share_of_stake,
    round(CASE WHEN len(bets) = 1 THEN 0 WHEN len(bets) > 1 THEN bet_amount_std_in_draw END, 6) AS bet_amount_std_all FROM featured"""
)
def draw_features_explored(spark, d):
    draws = tables.draws(spark, d)
    return draws.select("draw_id", *(c.alias(n) for n, c in B.explored_features(F.col("bets"), F.col("total_bet_amount")).items()))


@query(
    f"""WITH {O.DRAWS}, b AS (SELECT member_id, unnest(bets) AS bet FROM draws)
    SELECT bet.number AS number, count(*) AS bets, count(DISTINCT member_id) AS members, sum(bet.bet_amount) AS staked, round(avg(bet.bet_amount), 6) AS avg_bet,
    count_if(bet.bet_amount > 0)::BIGINT AS positive_bets, CASE WHEN bet.number = '00' THEN 37 ELSE bet.number::INT END AS position FROM b GROUP BY bet.number"""
)
def bet_explode_position_summary(spark, d):
    return explore.position_summary(tables.bets(spark, d))


@query(f"WITH {O.DRAWS} SELECT number FROM (SELECT i::VARCHAR AS number FROM range(37) t(i) UNION ALL SELECT '00') EXCEPT SELECT bet.number FROM (SELECT unnest(bets) AS bet FROM draws)")
def set_difference_positions(spark, d):
    return explore.missing_positions(tables.bets(spark, d))


@query(f"WITH {O.FEATURES}, c AS (SELECT member_id, bet_template, count(*) AS n FROM featured GROUP BY ALL) SELECT member_id, sum(n)::BIGINT AS rows, count(*) AS templates, max(n) AS max_template_reuse, round(1 - count(*) / sum(n)::DOUBLE, 6) AS reuse_ratio FROM c GROUP BY 1")
def bet_template_reuse(spark, d):
    return explore.template_reuse(_featured(spark, d).select("member_id", "bet_template"))


@query(
    f"""WITH {O.FEATURES}, top AS (SELECT member_id FROM featured GROUP BY 1 ORDER BY count(*) DESC, member_id LIMIT 5)
    SELECT member_id, count(*) AS draws, count(DISTINCT bet_template) AS templates, count(DISTINCT bet_template) = 1 AS all_same FROM featured WHERE member_id IN (FROM top) GROUP BY 1"""
)
def repeated_patterns(spark, d):
    return explore.repeated_patterns(_featured(spark, d).select("member_id", "bet_template"))


@query(f"WITH {O.HISTORY} SELECT member_id, draw_id, {r('inter_draw_seconds')} FROM labelled")
def inter_draw_gap(spark, d):
    return history.with_gaps(tables.draws(spark, d).select("member_id", "draw_id", "ts")).drop("ts")


@query("SELECT event_id, user_id, event_type FROM events, (SELECT min(ts) AS t0 FROM events) WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-15'")
def window_filtered_scan(spark, d):
    return tables.in_window(tables.table(spark, d, "events"), "ts", datetime(2024, 1, 5), datetime(2024, 1, 15)).select("event_id", "user_id", "event_type")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def member_list_scan(spark, d):
    ids = tables.table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").cast("string").alias("id"))
    return tables.by_strategy(tables.table(spark, d, "orders").withColumn("member_id", F.col("o_custkey").cast("string")), "member_list", {}, ids).select("o_orderkey", "o_custkey")


@query(f"WITH {O.HISTORY} SELECT member_id, draw_id, event_label FROM labelled")
def label_match(spark, d):
    draws = tables.draws(spark, d).select("member_id", "draw_id")
    return history.with_event_label(draws, tables.event_labels(spark, d)).select("member_id", "draw_id", "event_label")


@query("SELECT 'GK' || lpad(o_custkey::VARCHAR, 8, '0') AS member_id, o_orderkey AS draw_id FROM orders WHERE o_orderkey % 151 = 0 AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def unmatched_labels(spark, d):
    played = tables.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("draw_id"))
    return tables.event_labels(spark, d).join(played, "draw_id", "left_anti").select("member_id", "draw_id")


@query(f"WITH {O.HISTORY} SELECT member_id, first_ts, first_draw_id FROM first_events")
def first_label_event(spark, d):
    draws = tables.draws(spark, d).select("member_id", "draw_id", "ts")
    return history.first_events(history.with_event_label(draws, tables.event_labels(spark, d)))


@query(f"WITH {O.HISTORY} SELECT member_id, min(ts) AS first_ts, min(draw_id) AS first_draw_id FROM labelled WHERE event_label = 1 GROUP BY 1")
def first_label_event_independent(spark, d):
    draws = tables.draws(spark, d).select("member_id", "draw_id", "ts")
    return history.first_match_independent(history.with_event_label(draws, tables.event_labels(spark, d)))


@query(f"WITH {O.HISTORY} SELECT member_id, draw_id, event_fraud_flag FROM history")
def pre_event_history(spark, d):
    draws = tables.draws(spark, d).select("member_id", "draw_id", "ts")
    return history.before_events(history.with_event_label(draws, tables.event_labels(spark, d))).select("member_id", "draw_id", "event_fraud_flag")


@query(f"WITH {O.HISTORY} SELECT member_id, draw_id, event_fraud_flag, {r('inter_draw_seconds')} FROM history")
def pre_event_history_single_pass(spark, d):
    draws = tables.draws(spark, d).select("member_id", "draw_id", "ts")
    return history.gaps_before_events(history.with_event_label(draws, tables.event_labels(spark, d))).select("member_id", "draw_id", "event_fraud_flag", "inter_draw_seconds")


@query(f"WITH {O.HISTORY} SELECT count(DISTINCT member_id) AS fraud_player_count, count(DISTINCT member_id) FILTER (member_id NOT IN (SELECT member_id FROM history)) AS dropped_positive_count FROM first_events")
def label_loss(spark, d):
    labelled = history.with_event_label(tables.draws(spark, d).select("member_id", "draw_id", "ts"), tables.event_labels(spark, d))
    return history.loss_summary(labelled, history.before_events(labelled))


# member features

CORE = [c for c in features.FEATURES if c not in ("avg_draws_per_session", "max_template_reuse", "ccs_player_count", "ccs_total_staked", "ccs_avg_bet")]
COUNTS = ("draws_played", "sessions_played", "active_days", "unique_templates", "max_template_reuse", "ccs_player_count")


def _columns(names) -> str:
    return ", ".join(n if n in COUNTS else f"round({n}, 6) AS {n}" for n in names)


@query(f"WITH {O.MEMBERS} SELECT member_id, primary_ccs_id, event_fraud_flag, {_columns(CORE)} FROM members")
def member_features_core(spark, d):
    return features.core_features(_history(spark, d)).select("member_id", "primary_ccs_id", "event_fraud_flag", *CORE)


@query(f"WITH {O.MEMBERS} SELECT member_id, {r('avg_draws_per_session')} FROM sessions")
def member_features_sessions(spark, d):
    return features.session_features(_history(spark, d))


@query(f"WITH {O.MEMBERS} SELECT ccs_id, ccs_player_count, {r('ccs_total_staked', 'ccs_avg_bet')} FROM groups")
def ccs_features(spark, d):
    return features.ccs_features(_history(spark, d))


@query(f"WITH {O.MEMBERS} SELECT member_id, primary_ccs_id, event_fraud_flag, {_columns(features.FEATURES)} FROM members")
def member_features_full(spark, d):
    return _members(spark, d)


@query(f"WITH {O.MEMBERS} SELECT member_id, event_fraud_flag, " + ", ".join(f"round({f'ln(1 + greatest({c}, 0))' if c in features.LOG_FEATURES else f'{c}::DOUBLE'}, 6) AS {c}" for c in features.FEATURES) + " FROM members")
def model_frame(spark, d):
    return features.model_frame(_members(spark, d))


@query(f"WITH {O.MEMBERS}, f AS (SELECT member_id, event_fraud_flag, " + ", ".join(f"{f'ln(1 + greatest({c}, 0))' if c in features.LOG_STYLE else f'{c}::DOUBLE'} AS {c}" for c in features.STYLE) + ") SELECT member_id, event_fraud_flag, ".replace(") SELECT", " FROM members) SELECT") + ", ".join(f"round(({c} - avg({c}) OVER ()) / coalesce(nullif(stddev_pop({c}) OVER (), 0), 1), 5) AS {c}" for c in features.STYLE) + " FROM f")
def scaled_style_frame(spark, d):
    frame = features.model_frame(_members(spark, d), features.LOG_STYLE, features.STYLE)
    out = features.scaled(frame, features.STYLE)
    return out.select("member_id", "event_fraud_flag", *(F.round(c, 5).alias(c) for c in features.STYLE))


@query(f"WITH {O.FEATURES} SELECT member_id, count(*) AS rows, sum(total_bet_amount) AS total_staked, count(DISTINCT draw_id) AS draws FROM featured GROUP BY 1 ORDER BY total_staked DESC, member_id LIMIT 50")
def top_members(spark, d):
    per = tables.draws(spark, d).groupBy("member_id").agg(F.count("*").alias("rows"), F.sum("total_bet_amount").alias("total_staked"), F.count_distinct("draw_id").alias("draws"))
    return per.orderBy(F.desc("total_staked"), "member_id").limit(50)


# ranking and evaluation


@query(f"WITH {O.SCORED}, q AS (SELECT quantile_cont(risk_score, 0.8) AS a, quantile_cont(risk_score, 0.95) AS b FROM risk) SELECT member_id, risk_score, CASE WHEN risk_score <= a THEN 'LOW' WHEN risk_score <= b THEN 'MEDIUM' ELSE 'HIGH' END AS risk_tier FROM risk, q")
def risk_tiers(spark, d):
    return ranking.with_tiers(_scored(spark, d)).select("member_id", "risk_score", "risk_tier")


@query(f"WITH {O.SCORED}, q AS (SELECT quantile_cont(risk_score, 0.8) AS a, quantile_cont(risk_score, 0.95) AS b FROM risk), t AS (SELECT CASE WHEN risk_score <= a THEN 'LOW' WHEN risk_score <= b THEN 'MEDIUM' ELSE 'HIGH' END AS risk_tier FROM risk, q) SELECT v AS risk_tier, (SELECT count(*) FROM t WHERE risk_tier = v) AS members FROM (VALUES ('LOW'), ('MEDIUM'), ('HIGH')) x(v)")
def tier_distribution(spark, d):
    return ranking.tier_distribution(ranking.with_tiers(_scored(spark, d)))


@query(f"WITH {O.SCORED} SELECT member_id, risk_score, rank() OVER (ORDER BY risk_score DESC) AS risk_score_rank, round((rank() OVER (ORDER BY risk_score) + (count(*) OVER (PARTITION BY risk_score) - 1) / 2.0) / count(*) OVER (), 6)::DOUBLE AS risk_score_percentile FROM risk")
def risk_rank_percentile(spark, d):
    return ranking.with_ranks(_scored(spark, d), "risk_score").select("member_id", "risk_score", "risk_score_rank", "risk_score_percentile")


@query(f"WITH {O.SCORED} SELECT member_id, risk_score, anomaly_score, supervised_score, draws_played FROM risk WHERE draws_played >= 10 ORDER BY risk_score DESC, member_id LIMIT 50")
def alert_queue(spark, d):
    return ranking.alert_queue(_scored(spark, d), 50, 10).select("member_id", "risk_score", "anomaly_score", "supervised_score", "draws_played")


CAPTURE = """, long AS (UNPIVOT (SELECT member_id, event_fraud_flag, anomaly_score, supervised_score, risk_score FROM risk) ON anomaly_score, supervised_score, risk_score INTO NAME score_type VALUE score),
ranked AS (SELECT *, row_number() OVER (PARTITION BY score_type ORDER BY score DESC, member_id) AS rn FROM long), total AS (SELECT count(*) AS n, sum(event_fraud_flag) AS p FROM risk),
buckets AS (SELECT name, least(greatest(k, 1), n)::BIGINT AS k FROM total, LATERAL (VALUES ('top_1pct', floor(n * 0.01)), ('top_5pct', floor(n * 0.05)), ('top_10pct', floor(n * 0.10)), ('top_20pct', floor(n * 0.20)), ('top_50', 50), ('top_500', 500)) b(name, k)),
captured AS (SELECT score_type, name AS bucket, k, sum(event_fraud_flag)::BIGINT AS captured FROM buckets JOIN ranked ON rn <= k GROUP BY ALL),
stats AS (SELECT score_type, bucket, k, captured, captured / p AS capture_rate, captured / k AS precision, captured / k / (p / n) AS lift FROM captured, total)"""


@query(f"WITH {O.SCORED}{CAPTURE} SELECT score_type, bucket, k, captured, {r('capture_rate', 'precision', 'lift')} FROM stats")
def capture_stats_topk(spark, d):
    return metrics.capture_topk(_scored(spark, d), ["anomaly_score", "supervised_score", "risk_score"], "event_fraud_flag", "member_id")


@query(f"WITH {O.SCORED}{CAPTURE} SELECT score_type, {r('capture_rate', 'lift')}, capture_rate >= 0.4 AND lift >= 5 AS passed FROM stats WHERE bucket = 'top_5pct'")
def gate(spark, d):
    return metrics.gate(metrics.capture_topk(_scored(spark, d), ["anomaly_score", "supervised_score", "risk_score"], "event_fraud_flag", "member_id"))


@query(f"WITH {O.SCORED}, q AS (" + " UNION ALL ".join(f"SELECT {p}::DOUBLE AS share, quantile_cont(risk_score, {1 - p}) AS t FROM risk" for p in (0.01, 0.05, 0.1, 0.2)) + ") SELECT share, round(t, 6) AS threshold, count_if(risk_score >= t)::BIGINT AS flagged, count_if(risk_score >= t AND event_fraud_flag = 1)::BIGINT AS captured FROM q, risk GROUP BY share, t")
def capture_threshold(spark, d):
    return metrics.capture_threshold(_scored(spark, d), "risk_score", "event_fraud_flag")


RANKED = """, g AS (SELECT v, sum(l)::BIGINT AS p, count(*) AS k FROM s GROUP BY v),
c AS (SELECT *, sum(p) OVER w AS tp, sum(k) OVER w AS seen, sum(p) OVER () AS P1, sum(k) OVER () AS K1 FROM g WINDOW w AS (ORDER BY v DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT max(P1)::BIGINT AS positives, max(K1 - P1)::BIGINT AS negatives, round(sum((k - p) * (tp - p / 2)) / max(P1 * (K1 - P1))::DOUBLE, 6) AS roc_auc,
round(sum(p * tp / seen) / max(P1)::DOUBLE, 6) AS average_precision, round(max(abs(tp / P1 - (seen - tp) / (K1 - P1))), 6) AS ks FROM c"""


@query(f"WITH {O.SCORED}, s AS (SELECT risk_score AS v, event_fraud_flag AS l FROM risk){RANKED}")
def ranking_metrics(spark, d):
    return metrics.ranking_metrics(_scored(spark, d), "risk_score", "event_fraud_flag")


@query(f"WITH s AS (SELECT n_chars::DOUBLE AS v, quality AS l FROM documents JOIN labels USING (doc_id)){RANKED}")
def document_length_metrics(spark, d):
    docs = tables.table(spark, d, "documents").select("doc_id", "n_chars").join(tables.table(spark, d, "labels"), "doc_id")
    return metrics.ranking_metrics(docs, "n_chars", "quality")


@query(f"WITH {O.SCORED} SELECT count_if(risk_score >= 0.5 AND event_fraud_flag = 1)::BIGINT AS tp, count_if(risk_score >= 0.5 AND event_fraud_flag = 0)::BIGINT AS fp, count_if(risk_score < 0.5 AND event_fraud_flag = 0)::BIGINT AS tn, count_if(risk_score < 0.5 AND event_fraud_flag = 1)::BIGINT AS fn FROM risk")
def confusion_matrix(spark, d):
    return metrics.confusion(_scored(spark, d), "risk_score", "event_fraud_flag")


SEPARATED = ("total_staked", "stake_cv", "template_reuse_ratio", "positive_draw_rate", "draws_played")


@query(
    f"""WITH {O.MEMBERS}, s AS (UNPIVOT (SELECT event_fraud_flag AS l, {', '.join(f'round({c}, 6)::DOUBLE AS {c}' for c in SEPARATED)} FROM members) ON {', '.join(SEPARATED)} INTO NAME feature VALUE v),
    g AS (SELECT feature, v, sum(l)::BIGINT AS p, count(*) AS k FROM s GROUP BY ALL),
    c AS (SELECT *, sum(p) OVER w AS tp, sum(k) OVER w AS seen, sum(p) OVER e AS P1, sum(k) OVER e AS K1 FROM g WINDOW w AS (PARTITION BY feature ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), e AS (PARTITION BY feature)),
    u AS (SELECT feature, sum(p * (seen - tp - (k - p) / 2)) / max(P1 * (K1 - P1))::DOUBLE AS a, max(abs(tp / P1 - (seen - tp) / (K1 - P1))) AS ks FROM c GROUP BY 1)
    SELECT feature, round(greatest(a, 1 - a), 6) AS auc, round(ks, 6) AS ks FROM u"""
)
def feature_separation(spark, d):
    m = _members(spark, d).select("event_fraud_flag", *(F.round(F.col(c).cast("double"), 6).alias(c) for c in SEPARATED))
    return metrics.separation(m, list(SEPARATED), "event_fraud_flag")


@query(f"WITH {O.MEMBERS} " + " UNION ALL ".join(f"SELECT '{c}' AS feature, round(avg({c}) FILTER (event_fraud_flag = 1), 6) AS mean_positive, round(avg({c}) FILTER (event_fraud_flag = 0), 6) AS mean_negative, round((avg({c}) FILTER (event_fraud_flag = 1) - avg({c}) FILTER (event_fraud_flag = 0)) / stddev_samp({c}), 6) AS effect FROM members" for c in SEPARATED))
def effect_size(spark, d):
    return metrics.effect_sizes(_members(spark, d), list(SEPARATED), "event_fraud_flag")


@query(f"WITH {O.MEMBERS} " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS corr FROM members" for i, a in enumerate(SEPARATED) for b in SEPARATED[i:]))
def correlation_matrix(spark, d):
    return products.correlations(_members(spark, d), list(SEPARATED))


@query(f"WITH {O.MEMBERS} " + " UNION ALL ".join(f"SELECT event_fraud_flag, '{c}' AS feature, round(avg({c}), 6) AS mean, round(median({c})::DOUBLE, 6) AS median, round(stddev_samp({c}), 6) AS std FROM members GROUP BY 1" for c in SEPARATED))
def class_comparison(spark, d):
    return metrics_comparison(_members(spark, d))


def metrics_comparison(members: DataFrame) -> DataFrame:
    return explore.comparison(members.select("event_fraud_flag", *(F.col(c).cast("double").alias(c) for c in SEPARATED)), list(SEPARATED), "event_fraud_flag")


DRIFT = ("total_bet_amount", "win_points", "nonzero_bets_per_draw")


@query(
    f"""WITH {O.FEATURES}, t AS (UNPIVOT (SELECT (year(ts) % 2 = 0)::INT AS side, total_bet_amount::DOUBLE AS total_bet_amount, win_points::DOUBLE AS win_points, nonzero_bets_per_draw::DOUBLE AS nonzero_bets_per_draw FROM featured) ON total_bet_amount, win_points, nonzero_bets_per_draw INTO NAME feature VALUE v),
    sizes AS (SELECT feature, sum(side) AS n, sum(1 - side) AS m, stddev_pop(v) FILTER (side = 1) AS sd FROM t GROUP BY 1),
    c AS (SELECT feature, v, sum(side) AS a, sum(1 - side) AS b FROM t GROUP BY ALL),
    w AS (SELECT feature, v, n, m, sd, abs(sum(a) OVER w / n - sum(b) OVER w / m) AS gap, coalesce(lead(v) OVER (PARTITION BY feature ORDER BY v) - v, 0) AS step FROM c JOIN sizes USING (feature) WINDOW w AS (PARTITION BY feature ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
    o AS (SELECT feature, max(n)::BIGINT AS n_reference, max(m)::BIGINT AS n_current, max(gap) AS ks, sum(gap * step) AS wasserstein, max(sd) AS sd FROM w GROUP BY 1)
    SELECT feature, n_reference, n_current, round(ks, 6) AS ks, round(wasserstein, 6) AS wasserstein, round(wasserstein / sd, 6) AS distance,
    CASE WHEN greatest(n_reference, n_current) <= 1000 THEN ks > 1.358 * sqrt((n_reference + n_current) / (n_reference * n_current)) ELSE wasserstein / sd >= 0.1 END AS drifted FROM o"""
)
def drift(spark, d):
    f = _featured(spark, d)
    return metrics.drift(f.where(F.year("ts") % 2 == 0), f.where(F.year("ts") % 2 != 0), list(DRIFT)).drop("p_value")


# exploration


@query("SELECT hour(ts)::INT AS hour, count(*) AS rows, count(DISTINCT user_id) AS users FROM events WHERE ts IS NOT NULL GROUP BY 1")
def hourly_activity(spark, d):
    return explore.hourly(tables.table(spark, d, "events"))


@query(f"WITH {O.DRAWS} SELECT ts::DATE AS day, count(*) AS draws, count(DISTINCT member_id) AS members, sum(total_bet_amount) AS staked FROM draws GROUP BY 1")
def daily_activity(spark, d):
    return explore.daily(tables.draws(spark, d))


@query(f"WITH {O.FEATURES} SELECT member_id, session_id, count(*) AS rows, count(DISTINCT draw_id) AS draws, sum(total_bet_amount) AS staked, sum(net_result) AS net, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 6e7::DOUBLE, 6) AS duration_minutes FROM featured GROUP BY 1, 2")
def session_summary(spark, d):
    return explore.session_summary(tables.draws(spark, d).withColumn("net_result", F.col("win_points") - F.col("total_bet_amount")))


@query(f"WITH {O.DRAWS} SELECT ccs_id, count(DISTINCT member_id) AS members, count(DISTINCT (member_id, session_id)) AS sessions, count(DISTINCT draw_id) AS draws, count(*) AS rows, sum(total_bet_amount) AS staked, sum(win_points) AS won FROM draws WHERE ccs_id IS NOT NULL GROUP BY 1")
def group_hierarchy(spark, d):
    return explore.group_hierarchy(tables.draws(spark, d))


@query(f"WITH {O.DRAWS}, g AS (SELECT count(DISTINCT member_id) AS members, count(DISTINCT draw_id) AS draws FROM draws WHERE ccs_id IS NOT NULL GROUP BY ccs_id) SELECT count(*) AS groups, round(avg(members), 6) AS avg_members, median(members)::DOUBLE AS median_members, round(avg(draws), 6) AS avg_draws, median(draws)::DOUBLE AS median_draws FROM g")
def group_hierarchy_overview(spark, d):
    return explore.group_hierarchy_overview(tables.draws(spark, d))


@query(f"WITH {O.HISTORY} SELECT ccs_id, count(DISTINCT member_id) AS members, count(DISTINCT member_id) FILTER (event_label = 1) AS labelled_members, round(count(DISTINCT member_id) FILTER (event_label = 1) / count(DISTINCT member_id)::DOUBLE, 6) AS labelled_rate FROM labelled GROUP BY 1")
def ccs_label_concentration(spark, d):
    draws = tables.draws(spark, d).select("member_id", "draw_id", "ccs_id")
    return explore.group_concentration(history.with_event_label(draws, tables.event_labels(spark, d)))


@query(f"WITH {O.HISTORY}, e AS (SELECT draw_id::VARCHAR AS d, member_id AS m, ccs_id AS g FROM labelled WHERE event_label = 1), u AS (SELECT 'draw' AS kind, d AS id FROM e UNION ALL SELECT 'member', m FROM e UNION ALL SELECT 'group', g FROM e) SELECT kind, id, count(*) AS rows, round(count(*) / (SELECT count(*) FROM e)::DOUBLE, 6) AS share, count(*) > 1 AS repeats FROM u GROUP BY 1, 2")
def label_flow_summary(spark, d):
    draws = tables.draws(spark, d).select("member_id", "draw_id", "ccs_id")
    return explore.label_flow(history.with_event_label(draws, tables.event_labels(spark, d)))


@query(f"WITH {O.FEATURES}, p AS (SELECT member_id, count(*) AS rows, count(DISTINCT draw_id) AS draws, avg(total_bet_amount) AS avg_stake, sum(net_result) AS net, string_agg(DISTINCT ccs_id, ',' ORDER BY ccs_id) AS groups_seen FROM featured GROUP BY 1) SELECT member_id, rows, draws, round(avg_stake, 6) AS avg_stake, net, groups_seen, avg_stake <= (SELECT quantile_cont(avg_stake, 0.1) FROM p) AS low_bettor FROM p")
def player_behaviour(spark, d):
    return explore.behaviour(tables.draws(spark, d).withColumn("net_result", F.col("win_points") - F.col("total_bet_amount")))


@query(f"WITH {O.FEATURES} SELECT member_id, draw_id, row_number() OVER w AS sequence, sum(net_result) OVER w AS running_net, total_bet_amount FROM featured WINDOW w AS (PARTITION BY member_id ORDER BY ts, draw_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
def trajectory_running_sum(spark, d):
    return explore.trajectory(tables.draws(spark, d).withColumn("net_result", F.col("win_points") - F.col("total_bet_amount")))


@query(f"WITH {O.FEATURES}, q AS (SELECT member_id, total_bet_amount AS y, row_number() OVER (PARTITION BY member_id ORDER BY ts, draw_id) AS x FROM featured) SELECT member_id, count(*) AS draws, round(CASE WHEN count(*) > 1 THEN regr_slope(y, x) ELSE 0 END, 6) AS slope FROM q GROUP BY 1")
def stake_slope(spark, d):
    return explore.stake_slopes(tables.draws(spark, d).withColumn("net_result", F.col("win_points") - F.col("total_bet_amount")))


@query(
    f"""WITH {O.DRAWS}, l AS (SELECT o_orderkey AS label_id, 'GK' || lpad(o_custkey::VARCHAR, 8, '0') AS member_id, o_orderdate::DATE + 1 AS label_date, (o_custkey % 25)::VARCHAR AS g FROM orders WHERE o_orderkey % 37 = 0),
    m AS (SELECT label_id, l.member_id, draw_id, coalesce(g = ccs_id, false) AS ccs_match, abs(date_diff('day', label_date, ts::DATE))::INT AS delta_days, ts FROM l JOIN draws d ON l.member_id = d.member_id AND abs(date_diff('day', label_date, ts::DATE)) <= 1)
    SELECT label_id, member_id, draw_id, ccs_match, delta_days FROM m QUALIFY row_number() OVER (PARTITION BY label_id ORDER BY ccs_match DESC, delta_days, ts, draw_id) = 1"""
)
def fallback_band_match(spark, d):
    o = tables.table(spark, d, "orders").where("o_orderkey % 37 = 0")
    labels = o.select(F.col("o_orderkey").alias("label_id"), F.concat(F.lit("GK"), F.lpad(F.col("o_custkey").cast("string"), 8, "0")).alias("member_id"), F.date_add(F.to_date("o_orderdate"), 1).alias("label_date"), (F.col("o_custkey") % 25).cast("string").alias("ccs_id"))
    return explore.band_matches(labels, tables.draws(spark, d))


@query("SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def latest_per_key_dedupe(spark, d):
    e = tables.table(spark, d, "events")
    return explore.dedupe_latest(e, ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_type", "event_id", "value")


@query("SELECT o_custkey AS id FROM orders EXCEPT SELECT user_id FROM events")
def set_difference_ids(spark, d):
    return tables.table(spark, d, "orders").select(F.col("o_custkey").alias("id")).subtract(tables.table(spark, d, "events").select("user_id"))


@query("SELECT c_custkey AS id, c_acctbal AS balance, c_mktsegment AS segment, NULL::VARCHAR AS side FROM customer UNION ALL SELECT s_suppkey, s_acctbal, NULL, 'supplier' FROM supplier")
def union_mismatched(spark, d):
    c = tables.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    s = tables.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance"), F.lit("supplier").alias("side"))
    return c.unionByName(s, allowMissingColumns=True)


@query("SELECT event_id, coalesce(try_cast(json_extract_string(props, '$.k') AS DOUBLE), 0) AS k FROM events")
def json_props_extract(spark, d):
    k = F.from_json("props", "k string")["k"]
    return tables.table(spark, d, "events").select("event_id", S.or_zero(S.number(k)).alias("k"))


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", round(avg(({c} IS NULL)::INT)::DOUBLE, 6) AS missing, count(DISTINCT {c}) AS \"distinct\" FROM events" for c in ("event_id", "ts", "user_id", "event_type", "value", "props")))
def column_profile(spark, d):
    return explore.column_profile(tables.table(spark, d, "events")).drop("dtype")


@query(f"WITH {O.DRAWS} SELECT count(*) AS rows, min(len(bets))::INT AS min_bets, median(len(bets))::DOUBLE AS median_bets, max(len(bets))::INT AS max_bets, count_if(len(bets) = 0)::BIGINT AS empty_rows, count_if(ts IS NULL)::BIGINT AS no_time FROM draws")
def payload_stats(spark, d):
    return explore.payload_stats(tables.draws(spark, d))


@query(
    f"""WITH {O.DRAWS}, k AS (SELECT count(*) AS n, count_if(member_id IS NULL) AS no_member, count_if(draw_id IS NULL) AS no_draw, count(ts) AS timed, count_if(bets IS NULL) AS no_bets FROM draws)
    SELECT unnest(['min_row_count', 'required_columns', 'member_id_not_null', 'draw_id_not_null', 'bets_parse', 'time_parses', 'label_columns']) AS "check",
    unnest([n >= 100, (SELECT count(*) FROM (DESCRIBE draws) WHERE column_name IN ('member_id', 'draw_id', 'total_bet_amount', 'win_points', 'bets')) = 5, no_member = 0, no_draw = 0, no_bets = 0, timed > 0, true]) AS passed FROM k"""
)
def validation_report(spark, d):
    raw = tables.draws(spark, d).withColumn("bets", F.to_json("bets"))
    return checks.validation_report(raw, [" DRAW_ID ", "Member_ID"], min_rows=100)


@query(
    f"""WITH {O.DRAWS}, l AS (SELECT 'GK' || lpad((o_custkey + CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END)::VARCHAR, 8, '0') AS member_id, o_orderkey AS draw_id FROM orders WHERE o_orderkey % 151 = 0),
    m AS (SELECT l.*, (SELECT min(ts) FROM draws d WHERE d.member_id = l.member_id AND d.draw_id = l.draw_id) AS event_ts FROM l),
    c AS (SELECT m.member_id, m.draw_id, any_value(event_ts) AS event_ts, coalesce(count_if(d.ts < event_ts), 0)::BIGINT AS rows_before, coalesce(count_if(d.ts >= event_ts), 0)::BIGINT AS rows_after, count(d.member_id) AS member_rows FROM m LEFT JOIN draws d ON d.member_id = m.member_id GROUP BY 1, 2)
    SELECT member_id, draw_id, rows_before, rows_after, CASE WHEN event_ts IS NOT NULL AND rows_before > 0 THEN 'matched_with_history' WHEN event_ts IS NOT NULL THEN 'matched_no_history'
    WHEN member_rows > 0 THEN 'member_only' WHEN draw_id IN (SELECT draw_id FROM draws) THEN 'draw_only' ELSE 'absent' END AS status FROM c"""
)
def label_match_diagnosis(spark, d):
    o = tables.table(spark, d, "orders").where("o_orderkey % 151 = 0")
    off = F.col("o_custkey") + F.when(F.col("o_orderkey") % 3 == 0, 1).otherwise(0)
    labels = o.select(F.concat(F.lit("GK"), F.lpad(off.cast("string"), 8, "0")).alias("member_id"), F.col("o_orderkey").alias("draw_id"))
    return checks.diagnose_labels(labels, tables.draws(spark, d).select("member_id", "draw_id", "ts"))


@query(f"WITH {O.SCORED}, me AS (SELECT * FROM risk ORDER BY risk_score DESC, member_id LIMIT 1) " + " UNION ALL ".join(f"SELECT '{c}' AS feature, round(m.{c}, 6)::DOUBLE AS value, round(avg((r.{c} < m.{c})::INT), 6)::DOUBLE AS below, round(avg((r.{c} <= m.{c})::INT), 6)::DOUBLE AS at_or_below, (count_if(r.{c} > m.{c}) + 1)::BIGINT AS rank FROM risk r, me m GROUP BY m.{c}" for c in ("anomaly_score", "supervised_score", "risk_score", "draws_played")))
def ecdf_profile(spark, d):
    scored = _scored(spark, d)
    who = scored.orderBy(F.desc("risk_score"), "member_id").first().member_id
    return ranking.profile_of(scored, "member_id", who, ["anomaly_score", "supervised_score", "risk_score", "draws_played"])


@query(f"WITH {O.SCORED}, me AS (SELECT * FROM risk ORDER BY risk_score DESC, member_id LIMIT 1) SELECT r.member_id, round(sqrt(pow(r.anomaly_score - m.anomaly_score, 2) + pow(r.supervised_score - m.supervised_score, 2)), 6) AS distance FROM risk r, me m WHERE r.member_id <> m.member_id ORDER BY sqrt(pow(r.anomaly_score - m.anomaly_score, 2) + pow(r.supervised_score - m.supervised_score, 2)), r.member_id LIMIT 8")
def nearest_peers(spark, d):
    scored = _scored(spark, d)
    who = scored.orderBy(F.desc("risk_score"), "member_id").first().member_id
    return ranking.nearest_peers(scored, "member_id", who, ["anomaly_score", "supervised_score"]).select("member_id", "distance")


@query("WITH n AS (SELECT count(*) FILTER (toxic = 1) AS p FROM labels) SELECT doc_id, toxic FROM labels WHERE toxic = 1 UNION ALL SELECT doc_id, toxic FROM (SELECT doc_id, toxic, row_number() OVER (ORDER BY doc_id % 97, doc_id) AS rn FROM labels WHERE toxic = 0), n WHERE rn <= greatest(200 - p, 0)")
def stratified_sample(spark, d):
    labels = tables.table(spark, d, "labels").select("doc_id", "toxic")
    return explore.stratified_sample(labels, "toxic", 200, F.asc_nulls_last(F.col("doc_id") % 97), F.asc_nulls_last("doc_id"))


@query(f"WITH {O.SCORED} SELECT member_id, risk_score FROM risk WHERE member_id = 'GK00000007'")
def member_lookup(spark, d):
    return _scored(spark, d).where(S.member_id(F.lit(" gk00000007 ")) == F.col("member_id")).select("member_id", "risk_score")


@query(f"WITH {O.MEMBERS}, k AS (SELECT * FROM members WHERE avg_inter_draw_seconds IS NOT NULL) SELECT member_id, rank() OVER (ORDER BY round(avg_inter_draw_seconds, 6)) AS r_gap, rank() OVER (ORDER BY round(stake_cv, 6)) AS r_cv, rank() OVER (ORDER BY round(template_reuse_ratio, 6) DESC) AS r_reuse, (rank() OVER (ORDER BY round(avg_inter_draw_seconds, 6)) + rank() OVER (ORDER BY round(stake_cv, 6)) + rank() OVER (ORDER BY round(template_reuse_ratio, 6) DESC))::BIGINT AS suspicion FROM k")
def suspicion_rank_sum(spark, d):
    m = features.core_features(_history(spark, d)).select("member_id", *(F.round(c, 6).alias(c) for c in ("avg_inter_draw_seconds", "stake_cv", "template_reuse_ratio")))
    return explore.suspicion(m).select("member_id", "r_gap", "r_cv", "r_reuse", "suspicion")


@query("SELECT l_returnflag, sum(l_quantity) AS l_quantity_sum, round(avg(l_quantity), 6) AS l_quantity_mean, count(DISTINCT l_partkey) AS l_partkey_nunique, max(l_partkey) AS l_partkey_max FROM lineitem GROUP BY 1")
def dynamic_aggregate(spark, d):
    return explore.aggregate_by(tables.table(spark, d, "lineitem"), ["l_returnflag"], {"l_quantity": ["sum", "mean"], "l_partkey": ["nunique", "max"]})


# models


@query(
    f"""WITH {O.MEMBERS}, c AS (SELECT avg(avg_entropy) AS mx, avg(avg_gini) AS my, var_samp(avg_entropy) AS a, covar_samp(avg_entropy, avg_gini) AS b, var_samp(avg_gini) AS c FROM members)
    SELECT member_id, round(sqrt(greatest(((avg_entropy - mx) ** 2 * c - 2 * (avg_entropy - mx) * (avg_gini - my) * b + (avg_gini - my) ** 2 * a) / (a * c - b * b), 0)), 5) AS distance FROM members, c"""
)
def mahalanobis_2d(spark, d):
    m = stored(_members(spark, d).select("member_id", "avg_entropy", "avg_gini"), "members")
    x = F.array("avg_entropy", "avg_gini")
    return m.select("member_id", F.round(models.fit_ellipsoid(m, x, 2).distance(x), 5).alias("distance"))


def _model_frame(spark, d):
    """The models' columns of all members, stored as each fit reads them several times."""
    return stored(features.model_frame(_members(spark, d)), "frame")


def _frame(spark, d):
    frame = _model_frame(spark, d)
    return frame, models.fit_scaler(frame, list(features.FEATURES)).vector()


@query()
def mahalanobis_full(spark, d):
    frame, x = _frame(spark, d)
    return frame.select("member_id", models.fit_ellipsoid(frame, x, len(features.FEATURES)).distance(x).alias("distance"))


@query()
def kmeans_distance(spark, d):
    frame, x = _frame(spark, d)
    centres = models.fit_centres(frame, x)
    return frame.select("member_id", centres.cluster(x).alias("cluster"), centres.distance(x).alias("distance"))


@query()
def pca_scores(spark, d):
    frame, x = _frame(spark, d)
    axes = models.fit_axes(frame, x)
    return frame.select("member_id", axes.coordinate(x, 0).alias("pc1"), axes.coordinate(x, 1).alias("pc2"))


@query()
def logistic_scores(spark, d):
    frame, x = _frame(spark, d)
    return frame.select("member_id", "event_fraud_flag", models.fit_logit(frame, x, "event_fraud_flag").probability(x).alias("supervised_score"))


@query()
def isolation_scores(spark, d):
    frame, x = _frame(spark, d)
    return frame.select("member_id", models.fit_forest(frame, x, "member_id").score(x).alias("iso_forest_score"))


@query()
def score_pipeline(spark, d):
    members = stored(_members(spark, d), "members")
    scored = stored(scoring.score(members, scoring.fit(members)), "scores")
    return ranking.with_ranks(ranking.with_tiers(scored), "risk_score")


from drawlens.plans import reports  # noqa: E402, F401  registers more queries
