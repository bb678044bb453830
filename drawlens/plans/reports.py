"""More queries: reports on the cohort, profiles, folds, samples, checks and scalar helpers, each with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from drawlens.functions import scalars as S
from drawlens.ml import models
from drawlens.operators import checks, cohort, explore, features, history, kept, metrics, peers, products, profiles, ranking
from drawlens.plans import oracles as O
from drawlens.plans import rebuild, scoring
from drawlens.plans.queries import ORACLES, QUERIES, SEPARATED, _featured, _history, _labelled, _marked, _members, _model_frame, _scored, query, r
from drawlens.sources import buckets, records, tables
from drawlens.sources.stages import stage_dir, stored

TIERED = f"WITH {O.SCORED}, q AS (SELECT quantile_cont(risk_score, 0.8) AS a, quantile_cont(risk_score, 0.95) AS b FROM risk), tiered AS (SELECT risk.*, CASE WHEN risk_score <= a THEN 'LOW' WHEN risk_score <= b THEN 'MEDIUM' ELSE 'HIGH' END AS risk_tier FROM risk, q)"


def _tiered(spark, d):
    return ranking.with_tiers(_scored(spark, d))


# the cohort


@query(f"WITH {O.HISTORY} SELECT member_id, count(*) AS raw_history_rows, sum(event_label)::BIGINT AS matched_event_rows, max(event_label)::INT AS event_fraud_flag, (SELECT count(*) FROM history h WHERE h.member_id = l.member_id) AS history_rows_used FROM labelled l GROUP BY member_id")
def member_counters(spark, d):
    rows = history.with_event_label(tables.draws(spark, d).select("member_id", "draw_id", "ts"), tables.event_labels(spark, d))
    return cohort.member_counters(rows, history.before_events(rows))


@query(f"WITH {O.HISTORY}, u AS (SELECT member_id, count(*) AS k, count(DISTINCT draw_id) AS n FROM history GROUP BY 1) SELECT l.member_id, count(*) AS raw_history_rows, coalesce(max(n), 0) AS draws_played, count(*) >= 5 AND coalesce(max(n), 0) >= 5 AS enough_history FROM labelled l LEFT JOIN u USING (member_id) GROUP BY 1")
def minimum_history(spark, d):
    rows = history.with_event_label(tables.draws(spark, d).select("member_id", "draw_id", "ts"), tables.event_labels(spark, d))
    used = history.before_events(rows)
    draws = used.groupBy("member_id").agg(F.count_distinct("draw_id").alias("draws_played"))
    return cohort.enough_history(cohort.member_counters(rows, used), draws).select("member_id", "raw_history_rows", "draws_played", "enough_history")


@query(f"WITH {O.HISTORY}, u AS (SELECT member_id, count(DISTINCT draw_id) AS draws_played FROM history GROUP BY 1) SELECT l.member_id, count(*) AS raw_rows, draws_played FROM labelled l JOIN u USING (member_id) GROUP BY 1, 3 HAVING count(*) >= 5 AND draws_played >= 5")
def eligible_members(spark, d):
    rows = history.with_event_label(tables.draws(spark, d).select("member_id", "draw_id", "ts"), tables.event_labels(spark, d))
    used = history.before_events(rows).groupBy("member_id").agg(F.count_distinct("draw_id").alias("draws_played"))
    return ranking.eligible(rows.groupBy("member_id").agg(F.count("*").alias("raw_rows")).join(used, "member_id"))


@query(f"{TIERED} SELECT risk_tier, count(*) AS members, sum(event_fraud_flag)::BIGINT AS positives, round(avg(event_fraud_flag), 6) AS rate FROM tiered GROUP BY 1")
def rate_by_tier(spark, d):
    return cohort.rate_by_tier(_tiered(spark, d), "event_fraud_flag")


@query(
    f"WITH {O.SCORED}, q AS ("
    + " UNION ALL ".join(f"SELECT {p}::DOUBLE AS share, quantile_cont(risk_score, {1 - p}) AS a, quantile_cont(anomaly_score, {1 - p}) AS b, quantile_cont(supervised_score, {1 - p}) AS c FROM risk" for p in (0.05, 0.1, 0.2))
    + "), h AS (SELECT share, count_if(risk_score >= a)::BIGINT AS risk_score, count_if(anomaly_score >= b)::BIGINT AS anomaly_score, count_if(supervised_score >= c)::BIGINT AS supervised_score FROM risk, q WHERE event_fraud_flag = 1 GROUP BY 1) SELECT *, CASE WHEN risk_score >= greatest(anomaly_score, supervised_score) THEN 'HYBRID' ELSE 'SINGLE' END AS winner FROM h"
)
def method_winner(spark, d):
    return cohort.method_winner(_scored(spark, d), "risk_score", ["anomaly_score", "supervised_score"], "event_fraud_flag")


@query(f"WITH {O.SCORED}, n AS (SELECT *, (rank() OVER (ORDER BY anomaly_score) - 1) / count(*) OVER ()::DOUBLE AS below FROM risk) SELECT member_id, anomaly_score, round(below, 6) AS below, below < 0.5 AS low FROM n WHERE event_fraud_flag = 1")
def label_percentiles(spark, d):
    return cohort.label_percentiles(_scored(spark, d), "anomaly_score", "event_fraud_flag")


@query(f"WITH {O.SCORED} SELECT member_id, round(0.6 * anomaly_score / nullif(risk_score, 0), 3) AS anomaly_score_share, round(0.4 * supervised_score / nullif(risk_score, 0), 3) AS supervised_score_share FROM risk")
def contribution_shares(spark, d):
    out = cohort.contribution_shares(_scored(spark, d), {"anomaly_score": 0.6, "supervised_score": 0.4}, "risk_score")
    return out.select("member_id", "anomaly_score_share", "supervised_score_share")


@query(f"{TIERED} SELECT member_id, risk_score FROM tiered WHERE risk_tier = 'HIGH' AND coalesce(event_fraud_flag, 0) = 0")
def high_unlabelled(spark, d):
    return cohort.high_unlabelled(_tiered(spark, d), "event_fraud_flag").select("member_id", "risk_score")


@query(f"WITH {O.SCORED} SELECT member_id, draws_played, risk_score FROM risk WHERE contains(member_id, 'GK000000')")
def id_search(spark, d):
    return cohort.without(cohort.matching_ids(_scored(spark, d), " gk000000 "), ("anomaly_score", "supervised_score", "event_fraud_flag", "primary_ccs_id", "no_such_column"))


@query(f"{TIERED} SELECT CASE WHEN sum(event_fraud_flag) > 0 THEN 'replay_eval' ELSE 'live_unlabelled' END AS mode, count(*) AS members, sum(event_fraud_flag)::BIGINT AS positives, round(avg(risk_score), 6) AS mean_score, count_if(risk_tier = 'LOW')::BIGINT AS low, count_if(risk_tier = 'MEDIUM')::BIGINT AS medium, count_if(risk_tier = 'HIGH')::BIGINT AS high, round(quantile_cont(risk_score, 0.5), 6) AS median_score, round(quantile_cont(risk_score, 0.95), 6) AS p95_score FROM tiered")
def cohort_summary(spark, d):
    return cohort.cohort_summary(_tiered(spark, d), "risk_score", "event_fraud_flag")


@query(f"WITH {O.MEMBERS}, s AS (SELECT stddev_samp(avg_entropy) FILTER (event_fraud_flag = 1) AS a, stddev_samp(avg_entropy) FILTER (event_fraud_flag = 0) AS b FROM members) SELECT round(a, 6) AS std_positive, round(b, 6) AS std_negative, round(a / nullif(b, 0), 6) AS ratio FROM s")
def spread_ratio(spark, d):
    return cohort.spread_ratio(features.core_features(_history(spark, d)), "avg_entropy", "event_fraud_flag")


@query(
    """WITH t AS (SELECT l_returnflag AS g, avg(l_quantity) AS q, avg(l_discount) AS x FROM lineitem GROUP BY 1), u AS (SELECT l_returnflag AS g, avg(l_quantity) + 1 AS q, avg(l_discount) AS x FROM lineitem GROUP BY 1),
    m AS (SELECT g, 'q' AS metric, t.q AS value, u.q AS stored FROM t JOIN u USING (g) UNION ALL SELECT g, 'x', t.x, u.x FROM t JOIN u USING (g)) SELECT g, metric, round(value, 6)::DOUBLE AS value, round(stored, 6)::DOUBLE AS stored, value >= stored - 0.02 AS passed FROM m"""
)
def metric_regression(spark, d):
    now = tables.table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("g")).agg(F.avg("l_quantity").alias("q"), F.avg("l_discount").alias("x"))
    return cohort.metric_regression(now, now.withColumn("q", F.col("q") + 1), ["g"], ["q", "x"])


PREDICTED = ("anomaly_score", "supervised_score", "risk_score")


@query(
    f"""WITH RECURSIVE {O.SCORED}, t AS (UNPIVOT (SELECT (right(member_id, 1)::INT % 2 = 0)::INT AS side, {', '.join(PREDICTED)} FROM risk) ON {', '.join(PREDICTED)} INTO NAME feature VALUE v),
    sizes AS (SELECT feature, sum(side) AS n, sum(1 - side) AS m, stddev_pop(v) FILTER (side = 1) AS sd FROM t GROUP BY 1),
    c AS (SELECT feature, v, sum(side) AS a, sum(1 - side) AS b FROM t GROUP BY ALL),
    w AS (SELECT feature, v, n, m, sd, abs(sum(a) OVER w / n - sum(b) OVER w / m) AS gap, coalesce(lead(v) OVER (PARTITION BY feature ORDER BY v) - v, 0) AS step FROM c JOIN sizes USING (feature) WINDOW w AS (PARTITION BY feature ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
    o AS (SELECT feature, max(n)::BIGINT AS n_reference, max(m)::BIGINT AS n_current, max(gap) AS ks, sum(gap * step) AS wasserstein, max(sd) AS sd FROM w GROUP BY 1),
    p AS (SELECT *, ks * sqrt(n_reference * n_current / (n_reference + n_current)::DOUBLE) AS x, round(ks * n_reference * n_current)::BIGINT AS h FROM o),
    walk AS (
        SELECT feature, n_reference AS n, n_current AS m, h, 0::BIGINT AS k, [(CASE WHEN i = 0 AND h > 0 THEN 1 ELSE 0 END)::DOUBLE FOR i IN range(n_reference + 1)] AS p FROM p WHERE greatest(n_reference, n_current) <= 1000
        UNION ALL
        SELECT feature, n, m, h, k + 1, [(CASE WHEN k + 1 - i < 0 OR k + 1 - i > m OR abs(i * m - (k + 1 - i) * n) >= h THEN 0 ELSE (CASE WHEN i > 0 THEN i * p[i] ELSE 0 END + (k + 1 - i) * p[i + 1]) / (k + 1) END)::DOUBLE FOR i IN range(n + 1)]
        FROM walk WHERE k < n + m
    ), exact AS (SELECT feature, greatest(0, least(1, 1 - p[n + 1])) AS e FROM walk WHERE k = n + m)
    SELECT feature, n_reference, n_current, round(ks, 6) AS ks, round(coalesce(e, CASE WHEN x < 0.2 THEN 1 ELSE greatest(0, least(1, list_sum([(CASE WHEN j % 2 = 1 THEN 2.0 ELSE -2.0 END)::DOUBLE * exp(-2.0 * j * j * x * x) FOR j IN range(1, 61)]))) END), 6)::DOUBLE AS p_value FROM p LEFT JOIN exact USING (feature)"""
)
def prediction_drift(spark, d):
    s = _scored(spark, d).select("member_id", *PREDICTED)
    even = F.right("member_id", F.lit(1)).cast("int") % 2 == 0
    return metrics.prediction_drift(s.where(even), s.where(~even)).select("feature", "n_reference", "n_current", "ks", "p_value")


# folds


@query(
    f"""WITH {O.SCORED}, t AS (SELECT member_id, event_fraud_flag, md5(member_id || ':42') AS u, count(*) OVER (PARTITION BY event_fraud_flag) AS n FROM risk),
    s AS (SELECT *, (row_number() OVER (PARTITION BY event_fraud_flag ORDER BY u, member_id) - 1 < floor(n * 0.3::DOUBLE + 0.5))::INT AS is_test FROM t),
    k AS (SELECT greatest(2, least(5, count_if(event_fraud_flag = 1 AND is_test = 0))) AS k FROM s)
    SELECT member_id, event_fraud_flag, is_test, CASE WHEN is_test = 0 THEN (row_number() OVER (PARTITION BY event_fraud_flag, is_test ORDER BY u, member_id) - 1) % k END::INT AS fold FROM s, k"""
)
def stratified_folds(spark, d):
    s = models.test_split(_scored(spark, d).select("member_id", "event_fraud_flag"), "event_fraud_flag", "member_id")
    dev = s.where("is_test = 0")
    k = models.fold_count(dev.where("event_fraud_flag = 1").count())
    return models.folds(dev, "event_fraud_flag", "member_id", k).unionByName(s.where("is_test = 1").withColumn("fold", F.lit(None).cast("int"))).select("member_id", "event_fraud_flag", "is_test", "fold")


#: Coefficients as a stored model has them, to check the form of the probability.
WEIGHTS, INTERCEPT = {"avg_entropy": 0.75, "avg_gini": -1.25, "stake_cv": 0.5}, -0.3


@query(f"WITH {O.MEMBERS} SELECT member_id, round(1 / (1 + exp(-({INTERCEPT} + " + " + ".join(f"({w}) * {c}" for c, w in WEIGHTS.items()) + "))), 6) AS probability FROM members")
def stored_logit(spark, d):
    m = features.core_features(_history(spark, d))
    return m.select("member_id", models.Logit(tuple(WEIGHTS.values()), INTERCEPT).probability(F.array(*WEIGHTS)).alias("probability"))


@query()
def feature_importance(spark, d):
    frame = _model_frame(spark, d)
    return models.importance(models.fit_logit(frame, models.fit_scaler(frame, list(features.FEATURES)).vector(), "event_fraud_flag"), list(features.FEATURES), spark)


@query(f"WITH {O.DRAWS}, k AS (SELECT ccs_id, count(DISTINCT member_id) AS members FROM draws GROUP BY 1) SELECT ccs_id, members, least(4, greatest(2, CASE WHEN members >= 16 THEN members // 8 ELSE 2 END))::INT AS clusters FROM k")
def cluster_count(spark, d):
    sizes = tables.draws(spark, d).groupBy("ccs_id").agg(F.count_distinct("member_id").alias("members"))
    return sizes.withColumn("clusters", models.cluster_count(F.col("members")))


# profiles and samples

DESCRIBED = ("l_quantity", "l_extendedprice", "l_discount")


@query(" UNION ALL ".join(f"SELECT '{c}' AS feature, count({c}) AS count, round(avg({c}), 6)::DOUBLE AS mean, round(stddev_samp({c}), 6)::DOUBLE AS std, min({c})::DOUBLE AS min, round(quantile_cont({c}::DOUBLE, 0.25), 6) AS q25, round(quantile_cont({c}::DOUBLE, 0.5), 6) AS median, round(quantile_cont({c}::DOUBLE, 0.75), 6) AS q75, max({c})::DOUBLE AS max FROM lineitem" for c in DESCRIBED))
def describe(spark, d):
    return profiles.describe(tables.table(spark, d, "lineitem"), list(DESCRIBED))


@query(f"WITH {O.DRAWS}, p AS (SELECT member_id, count(DISTINCT draw_id) AS k FROM draws GROUP BY 1) SELECT count(*) AS rows, min(ts) AS first_time, max(ts) AS last_time, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 3.6e9, 4)::DOUBLE AS span_hours, count(DISTINCT draw_id) AS draws, min(draw_id) AS smallest_draw, max(draw_id) AS largest_draw, count(DISTINCT member_id) AS members, (SELECT count_if(k = 1) FROM p)::BIGINT AS members_with_one_draw, (SELECT count_if(k = (SELECT max(k) FROM p)) FROM p)::BIGINT AS members_with_most_draws FROM draws")
def coverage(spark, d):
    return profiles.coverage(tables.draws(spark, d), "ts", "draw_id", "member_id")


MEANS = {"avg_draws": "draws_played", "avg_total_bet": "avg_stake_per_draw", "avg_tiny_ratio": "avg_tiny_bet_ratio", "avg_reuse": "template_reuse_ratio"}


@query(f"WITH {O.MEMBERS} SELECT primary_ccs_id, count(*) AS members, sum(event_fraud_flag)::BIGINT AS positives, " + ", ".join(f"round(avg({c}), 6)::DOUBLE AS {new}" for new, c in MEANS.items()) + ", round(sum(event_fraud_flag) / count(*)::DOUBLE, 6) AS rate, CASE WHEN sum(event_fraud_flag) / count(*)::DOUBLE > 0.10 THEN 'High-Stake Volatile' WHEN avg(avg_tiny_bet_ratio) > 0.30 THEN 'Tiny-Bet Repeaters' WHEN avg(template_reuse_ratio) > 0.10 THEN 'Template Reusers' WHEN avg(avg_stake_per_draw) > 2000 THEN 'Mid-Stake Active' ELSE 'Casual Low-Stake' END || ' (n=' || count(*) || ')' AS name FROM members GROUP BY 1")
def cluster_profile(spark, d):
    out = profiles.cluster_profile(features.core_features(_history(spark, d)), "primary_ccs_id", "event_fraud_flag", MEANS)
    return out.withColumn("name", profiles.cluster_name(*(F.col(c) for c in ("rate", "avg_tiny_ratio", "avg_reuse", "avg_total_bet", "members"))))


TIMELINE = {"avg_stake_per_draw": "total_bet_amount", "avg_nonzero_bets_per_draw": "nonzero_bets_per_draw", "avg_max_bet_share": "max_bet_share_in_draw", "avg_entropy": "entropy_in_draw", "avg_gini": "gini_in_draw", "avg_tiny_bet_ratio": "tiny_bet_ratio_in_draw", "avg_position_coverage": "position_coverage"}


@query(
    f"WITH {O.FEATURES}, c AS (SELECT member_id, count(*) AS unique_templates, max(k) AS max_template_reuse FROM (SELECT member_id, bet_template, count(*) AS k FROM featured GROUP BY ALL) GROUP BY 1) SELECT member_id, count(DISTINCT draw_id) AS draws_played, "
    + ", ".join(f"round(avg({c}), 6)::DOUBLE AS {new}" for new, c in TIMELINE.items())
    + ", round(coalesce(stddev_samp(total_bet_amount), 0) / greatest(avg(total_bet_amount), 1e-9), 6) AS stake_cv, round(avg((net_result > 0)::INT), 6)::DOUBLE AS positive_draw_rate, count(*) AS rows, any_value(unique_templates) AS unique_templates, any_value(max_template_reuse) AS max_template_reuse, round(greatest(1 - any_value(unique_templates) / count(*)::DOUBLE, 0), 6)::DOUBLE AS template_reuse_ratio FROM featured JOIN c USING (member_id) GROUP BY 1"
)
def full_timeline(spark, d):
    return profiles.full_timeline(_featured(spark, d))


@query(f"WITH {O.HISTORY} SELECT member_id, count(DISTINCT draw_id) AS draws_played, count(DISTINCT session_id) AS sessions_played, sum(total_bet_amount) AS total_staked, round(avg(total_bet_amount), 6) AS avg_total_bet_amount, round(coalesce(stddev_samp(total_bet_amount), 0), 6) AS std_total_bet_amount, round(avg(entropy_in_draw), 6) AS avg_entropy, round(avg(tiny_bet_ratio_in_draw), 6) AS avg_tiny_bet_ratio, sum(net_result) AS total_net_result, max(event_label) AS fraud_flag, CASE WHEN max(event_label) = 1 THEN 'fraud' ELSE 'normal' END AS fraud_label FROM labelled GROUP BY 1")
def style_table(spark, d):
    return profiles.style_table(_labelled(spark, d))


@query(f"WITH {O.DRAWS}, top AS (SELECT member_id FROM draws GROUP BY 1 ORDER BY count(*) DESC, member_id LIMIT 5) SELECT member_id, draw_id, array_to_string(list_transform(list_filter(bets, lambda b: b.bet_amount > 0), lambda b: b.number || '=' || b.bet_amount::BIGINT), ',') AS nonzero FROM draws WHERE member_id IN (FROM top)")
def nonzero_bets_of_top_members(spark, d):
    draws = tables.draws(spark, d)
    top = draws.groupBy("member_id").count().orderBy(F.desc("count"), "member_id").limit(5)
    listed = F.transform(F.array_sort("nonzero"), lambda b: F.concat(b["number"], F.lit("="), b["bet_amount"].cast("long").cast("string")))
    return profiles.nonzero_bets(draws, top).select("member_id", "draw_id", F.array_join(listed, ",").alias("nonzero"))


@query("SELECT event_id, user_id, event_type FROM events ORDER BY md5(event_id::VARCHAR || ':42'), event_id LIMIT 500")
def random_sample(spark, d):
    return profiles.random_sample(tables.table(spark, d, "events"), "event_id", 500).select("event_id", "user_id", "event_type")


@query("SELECT event_id, user_id, value FROM events WHERE event_type = 'click' ORDER BY ts DESC, event_id LIMIT 200")
def limited_sample(spark, d):
    return profiles.limited(tables.table(spark, d, "events"), 200, "event_type = 'click'", [F.desc("ts"), F.asc("event_id")]).select("event_id", "user_id", "value")


CATALOG = ("region", "nation", "customer", "orders", "events")


@query(" UNION ALL ".join(f"SELECT '{t}' AS \"table\", (SELECT count(*) FROM {t}) AS rows, (SELECT string_agg(column_name, ',' ORDER BY column_name) FROM (DESCRIBE {t})) AS columns" for t in CATALOG))
def catalog_overview(spark, d):
    return profiles.catalog_overview(spark, {t: tables.table(spark, d, t) for t in CATALOG})


@query("SELECT c_custkey, (SELECT min(n_name) FROM nation WHERE n_nationkey = c_nationkey) AS nation FROM customer")
def dimension_lookup(spark, d):
    nations = tables.table(spark, d, "nation").select("n_nationkey", "n_name")
    return profiles.looked_up(tables.table(spark, d, "customer"), "c_nationkey", nations.unionByName(nations), "n_nationkey", "n_name", "nation").select("c_custkey", "nation")


# scalars and checks


@query("SELECT o_orderkey, CASE WHEN o_totalprice > 0 AND o_totalprice <= 50000 THEN 'small' WHEN o_totalprice > 50000 AND o_totalprice <= 150000 THEN 'medium' WHEN o_totalprice > 150000 AND o_totalprice <= 250000 THEN 'large' END AS size FROM orders")
def binned_prices(spark, d):
    return tables.table(spark, d, "orders").select("o_orderkey", S.binned(F.col("o_totalprice"), [0, 50_000, 150_000, 250_000], ["small", "medium", "large"]).alias("size"))


@query("SELECT event_id, coalesce(printf('%.4f', value), 'N/A') AS value, coalesce(user_id::VARCHAR, 'N/A') AS user_id FROM events")
def shown_values(spark, d):
    return tables.table(spark, d, "events").select("event_id", S.shown(F.col("value"), "double").alias("value"), S.shown(F.col("user_id"), "long").alias("user_id"))


@query("SELECT l_returnflag, printf('%.1f%%', 100 * avg((l_quantity > 25)::INT)) AS share FROM lineitem GROUP BY 1")
def percent_shares(spark, d):
    return tables.table(spark, d, "lineitem").groupBy("l_returnflag").agg(S.percent(F.avg((F.col("l_quantity") > 25).cast("int"))).alias("share"))


@query("SELECT c_custkey, regexp_full_match(upper(trim(c_name)), '[A-Z0-9_-]{4,64}') AS name_valid, regexp_full_match(upper(trim('gk' || c_custkey || 'xx')), '[A-Z0-9_-]{4,64}') AS id_valid FROM customer")
def valid_ids(spark, d):
    made = F.concat(F.lit("gk"), F.col("c_custkey").cast("string"), F.lit("xx"))
    return tables.table(spark, d, "customer").select("c_custkey", S.is_member_id(S.member_id(F.col("c_name"))).alias("name_valid"), S.is_member_id(S.member_id(made)).alias("id_valid"))


@query(
    f"""{TIERED}, x AS (SELECT member_id, risk_tier, CASE WHEN draws_played < 5 THEN 'low' WHEN draws_played < 20 THEN 'medium' ELSE 'higher' END AS reliability FROM tiered)
    SELECT member_id, reliability, CASE WHEN reliability = 'low' THEN 'Collect more history before escalation' WHEN reliability = 'medium' AND risk_tier = 'HIGH' THEN 'Investigate carefully (limited history)'
    WHEN risk_tier = 'HIGH' THEN 'Investigate now' WHEN risk_tier = 'MEDIUM' THEN 'Monitor / secondary review' WHEN risk_tier = 'LOW' THEN 'Low priority' ELSE 'Unassigned' END AS recommendation FROM x"""
)
def recommendations(spark, d):
    out = _tiered(spark, d).withColumn("reliability", S.reliability(F.col("draws_played"), F.col("draws_played")))
    return out.select("member_id", "reliability", S.recommendation(F.col("risk_tier"), F.col("reliability")).alias("recommendation"))


@query("SELECT event_id, floor(epoch(ts) / 900)::BIGINT AS bucket FROM events")
def cache_buckets(spark, d):
    return tables.table(spark, d, "events").select("event_id", S.cache_bucket(F.col("ts")).alias("bucket"))


@query("SELECT s_suppkey, 'http://***@host/' || s_suppkey AS uri FROM supplier")
def redacted_uris(spark, d):
    uri = F.concat(F.lit("http://user:secret"), F.col("s_suppkey").cast("string"), F.lit("@host/"), F.col("s_suppkey").cast("string"))
    return tables.table(spark, d, "supplier").select("s_suppkey", S.redacted(uri).alias("uri"))


NULLED = ("event_id", "ts", "user_id", "event_type", "value")


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", count_if({c} IS NULL)::BIGINT AS nulls, round(avg(({c} IS NULL)::INT), 6)::DOUBLE AS share FROM events" for c in NULLED))
def null_shares(spark, d):
    return checks.null_shares(tables.table(spark, d, "events").select(*NULLED))


@query(f"WITH {O.FEATURES} SELECT 'gini' AS rule, count_if(NOT coalesce(gini_in_draw BETWEEN 0 AND 1, false))::BIGINT AS broken FROM featured UNION ALL SELECT 'few bets', count_if(NOT coalesce(bets_per_draw <= 3, false))::BIGINT FROM featured")
def range_checks(spark, d):
    return checks.range_checks(_featured(spark, d), {"gini": "gini_in_draw BETWEEN 0 AND 1", "few bets": "bets_per_draw <= 3"})


@query("SELECT 'o_totalprice' AS \"column\", count(*) AS rows, round(max(abs(o_totalprice - (o_totalprice + o_orderkey % 7))), 6)::DOUBLE AS max_diff, round(avg(abs(o_totalprice - (o_totalprice + o_orderkey % 7))), 6)::DOUBLE AS mean_diff, round(corr(o_totalprice, o_totalprice + o_orderkey % 7), 6) AS corr FROM orders")
def compared_frames(spark, d):
    o = tables.table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return checks.compare_frames(o, o.withColumn("o_totalprice", F.col("o_totalprice") + F.col("o_orderkey") % 7), "o_orderkey", ["o_totalprice"])


@query("(SELECT DISTINCT c_nationkey AS id, 'a' AS side FROM customer WHERE c_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_suppkey % 3 = 0)) UNION ALL (SELECT DISTINCT s_nationkey, 'b' FROM supplier WHERE s_suppkey % 3 = 0 AND s_nationkey NOT IN (SELECT c_nationkey FROM customer))")
def only_in_one(spark, d):
    a = tables.table(spark, d, "customer").select(F.col("c_nationkey").alias("id"))
    b = tables.table(spark, d, "supplier").where("s_suppkey % 3 = 0").select(F.col("s_nationkey").alias("id"))
    return checks.only_in_one(a, b, "id")


@query(f"SELECT member_id, min_by(status, CASE status WHEN 'matched_with_history' THEN 1 WHEN 'matched_no_history' THEN 2 WHEN 'member_only' THEN 3 WHEN 'draw_only' THEN 4 ELSE 5 END) AS status FROM ({ORACLES['label_match_diagnosis']}) GROUP BY 1")
def member_status(spark, d):
    return checks.member_status(QUERIES["label_match_diagnosis"](spark, d))


@query("SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal, c_mktsegment FROM customer")
def updated_rows(spark, d):
    c = tables.table(spark, d, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    changes = c.where("c_custkey % 5 = 0").select("c_custkey", (F.col("c_acctbal") + 1).alias("c_acctbal"), F.lit(None).cast("string").alias("c_mktsegment"))
    return explore.updated_from(c, changes, "c_custkey", ["c_acctbal", "c_mktsegment"])


@query("SELECT o_orderkey, (row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1)::BIGINT AS position FROM orders")
def grouped_positions(spark, d):
    o = tables.table(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    return ranking.positions(o, ["o_orderpriority"], [F.col("o_orderkey")]).select("o_orderkey", "position")


@query()
def evaluation_scores(spark, d):
    return models.evaluation_scores(_model_frame(spark, d), list(features.FEATURES), "event_fraud_flag", "member_id")


@query()
def comparison_models(spark, d):
    return models.comparison_models(_model_frame(spark, d), list(features.FEATURES), "event_fraud_flag", "member_id")


# all members at once


@query(f"WITH {O.SCORED}, d AS (SELECT a.member_id, b.member_id AS peer, sqrt(pow(a.anomaly_score - b.anomaly_score, 2) + pow(a.supervised_score - b.supervised_score, 2)) AS distance FROM risk a JOIN risk b ON a.member_id <> b.member_id) SELECT member_id, peer, round(distance, 6) AS distance, (row_number() OVER (PARTITION BY member_id ORDER BY distance, peer))::INT AS place FROM d QUALIFY place <= 8")
def all_nearest_peers(spark, d):
    return peers.nearest_of_all(_scored(spark, d), "member_id", ["anomaly_score", "supervised_score"])


#: Columns that are another one times a constant or do not vary give correlations that are rounding; they are in both.
PAIRS = [(a, b) for i, a in enumerate(features.FEATURES) for b in features.FEATURES[i:]]
VARIES = f"SELECT *, {', '.join(f'stddev_pop({c}::DOUBLE) OVER () > 1e-6 * (1 + max(abs({c}::DOUBLE)) OVER ()) AS v_{c}' for c in features.FEATURES)} FROM members"


@query(f"WITH {O.MEMBERS}, k AS ({VARIES}) " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, CASE WHEN any_value(v_{a}) AND any_value(v_{b}) THEN round(corr({a}::DOUBLE, {b}::DOUBLE), 6) END AS corr FROM k" for a, b in PAIRS))
def correlation_matrix_full(spark, d):
    return products.correlations(_members(spark, d).select(*features.FEATURES), list(features.FEATURES))


@query(f"WITH {O.MEMBERS} " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, count(*) AS n, round(covar_samp(ln(1 + greatest({a}::DOUBLE, 0)), ln(1 + greatest({b}::DOUBLE, 0))), 6) AS cov FROM members" for i, a in enumerate(features.STYLE) for b in features.STYLE[i:]))
def style_covariances(spark, d):
    frame = features.model_frame(_members(spark, d), features.STYLE, features.STYLE)
    return products.covariances(frame, list(features.STYLE))


@query(f"WITH {O.MEMBERS}, k AS (SELECT member_id, round(avg_inter_draw_seconds, 6) AS a, round(stake_cv, 6) AS b, round(template_reuse_ratio, 6) AS c FROM members WHERE avg_inter_draw_seconds IS NOT NULL) SELECT member_id, dense_rank() OVER (ORDER BY a) AS r_gap, dense_rank() OVER (ORDER BY b) AS r_cv, dense_rank() OVER (ORDER BY c DESC) AS r_reuse, (dense_rank() OVER (ORDER BY a) + dense_rank() OVER (ORDER BY b) + dense_rank() OVER (ORDER BY c DESC))::BIGINT AS suspicion FROM k")
def suspicion_dense_ranks(spark, d):
    m = features.core_features(_history(spark, d)).select("member_id", *(F.round(c, 6).alias(c) for c in ("avg_inter_draw_seconds", "stake_cv", "template_reuse_ratio")))
    return explore.suspicion(m, dense=True).select("member_id", "r_gap", "r_cv", "r_reuse", "suspicion")


# kept state, buckets, records, scorers in SQL


@query("SELECT user_id, count(*) AS rows, round(sum(value), 6) AS sum_value, min(ts) AS min_ts, max(ts) AS max_ts, count(DISTINCT event_type) AS distinct_event_type, count(DISTINCT props) AS distinct_props FROM events GROUP BY 1")
def merged_activity(spark, d):
    """Four batches, the second of them offered twice, and what they add up to."""
    state = kept.Kept(f"{stage_dir(spark)}/activity-{uuid.uuid4().hex}", ("user_id",), sums=("value",), extremes=("ts",), distinct=("event_type", "props"))
    events = tables.table(spark, d, "events")
    for batch in (0, 1, 2, 1, 3):
        state.absorb(events.where(F.col("event_id") % 4 == batch), f"part-{batch}")
    return state.totals(spark)


@query(ORACLES["member_features_full"])
def bucketed_member_features(spark, d):
    """The member table from a history stored in buckets by member."""
    marked = _marked(spark, d)
    n = buckets.bucket_count(marked.count())
    return features.member_features(buckets.bucketed(history.gaps_before_events(buckets.bucketed(marked, buckets=n)), buckets=n))


@query("SELECT event_id, event_type, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS detail_k, value AS detail_value FROM events")
def untyped_records(spark, d):
    """Events as texts of nested JSON, read back without a schema."""
    e = tables.table(spark, d, "events")
    text = F.concat(F.lit('{"detail": {"k": '), F.coalesce(F.get_json_object("props", "$.k"), F.lit("null")), F.lit(', "value": '), F.coalesce(F.col("value").cast("string"), F.lit("null")), F.lit('}, "event_type": "'), F.col("event_type"), F.lit('"}'))
    found = records.typed(e.select("event_id", text.alias("record")), "record")
    return found.select("event_id", "event_type", F.col("`detail.k`").cast("long").alias("detail_k"), F.col("`detail.value`").cast("double").alias("detail_value"))


@query("SELECT count(*) AS rows, count(DISTINCT user_id) AS members, 'ts' AS time_column, min(ts) AS first_time, max(ts) AS last_time FROM events")
def ingest_summary(spark, d):
    events = tables.table(spark, d, "events").withColumn("createdAt", F.lit(None).cast("timestamp"))
    return tables.ingest_summary(events, ["trans_date", "createdAt", "ts"], "user_id")


@query(
    f"WITH {O.MEMBERS}, k AS ("
    + " UNION ALL ".join(f"SELECT '{c}' AS feature, event_fraud_flag AS l, round({c}, 6)::DOUBLE AS v FROM members" for c in SEPARATED)
    + ") SELECT feature, count_if(l = 1)::BIGINT AS n_positive, count_if(l = 0)::BIGINT AS n_negative, round(avg(v) FILTER (l = 1), 6) AS mean_positive, round(avg(v) FILTER (l = 0), 6) AS mean_negative, round(median(v) FILTER (l = 1), 6) AS median_positive, round(median(v) FILTER (l = 0), 6) AS median_negative FROM k GROUP BY 1"
)
def separation_by_class(spark, d):
    m = _members(spark, d).select("event_fraud_flag", *(F.round(F.col(c).cast("double"), 6).alias(c) for c in SEPARATED))
    return metrics.separation_table(stored(m, "separated"), list(SEPARATED), "event_fraud_flag").drop("auc", "ks")


@query(f"WITH {O.FEATURES}, u AS (SELECT draw_id, count(*) AS rows, count(DISTINCT member_id) AS members, sum(total_bet_amount) AS staked, sum(bets_per_draw)::BIGINT AS bets, count(DISTINCT bet_template) AS templates FROM featured GROUP BY 1) SELECT *, round(staked / nullif(bets, 0), 6) AS mean_bet FROM u")
def draw_summary(spark, d):
    return explore.draw_summary(_featured(spark, d))


@query(f"WITH {O.FEATURES}, t AS (SELECT bet_template, count(*) AS uses, count(DISTINCT member_id) AS members FROM featured GROUP BY 1) SELECT uses > 1 AS repeated, members > 1 AS shared, count(*) AS templates, sum(uses)::BIGINT AS rows, max(uses) AS most_uses, round(avg(uses), 6) AS mean_uses FROM t GROUP BY 1, 2")
def template_statistics(spark, d):
    return explore.template_statistics(_featured(spark, d).select("member_id", "bet_template"))


@query()
def sql_risk(spark, d):
    """The fitted scorers called from SQL."""
    members = stored(_members(spark, d), "members")
    bundle = scoring.fit(members)
    tag = uuid.uuid4().hex
    scoring.register(spark, bundle, f"drawlens_{tag}_")
    features.model_frame(members, bundle.log_columns, bundle.columns).createOrReplaceTempView(f"frame_{tag}")
    row = f"array({', '.join(bundle.columns)})"
    return spark.sql(f"SELECT member_id, drawlens_{tag}_risk_score({row}) AS risk_score, drawlens_{tag}_anomaly_score({row}) AS anomaly_score FROM frame_{tag}")


# the style space, the fitted logit, and cohorts scored anew


def _style(spark, d):
    """Members, their style space, and the expression of their scaled vectors."""
    members = stored(_members(spark, d), "members")
    style = scoring.fit_style(members)
    return members, style, style.scaler.vector(lambda c: features.model_value(c, style.log_columns))


@query(f"WITH RECURSIVE {O.STYLE_SPACE}, axes AS (SELECT 0 AS component, v, e FROM a1 UNION ALL SELECT 1, v, e FROM a2) " + " UNION ALL ".join(f"SELECT '{c}' AS feature, component::INT AS component, round(v[{i + 1}], 6) AS loading, round(e / (SELECT list_sum([m[j][j] FOR j IN range(1, 14)]) FROM covariance), 6) AS explained FROM axes" for i, c in enumerate(features.STYLE)))
def style_axes(spark, d):
    """Loadings of the two axes of the members' style, and the share of the variance that each explains."""
    _, style, _ = _style(spark, d)
    return models.loadings_table(style.axes, list(features.STYLE), spark)


@query(f"WITH RECURSIVE {O.STYLE_SPACE} SELECT member_id, round(list_dot_product(x, a1.v), 6) AS style_pc1, round(list_dot_product(x, a2.v), 6) AS style_pc2 FROM vectors, a1, a2")
def style_coordinates(spark, d):
    members, style, _ = _style(spark, d)
    return members.select("member_id", *(c.alias(n) for n, c in style.coordinates().items()))


@query(f"WITH RECURSIVE {O.STYLE_SPACE} SELECT member_id, round(sqrt(greatest(list_dot_product(x, list_transform(m, lambda row: list_dot_product(row, x))), 0)), 6) AS distance FROM vectors, inverse")
def style_distance(spark, d):
    """Each member's ellipsoid distance from the cohort's centre in the style space."""
    members, _, x = _style(spark, d)
    return members.select("member_id", models.fit_ellipsoid(members, x, len(features.STYLE)).distance(x).alias("distance"))


@query(f"WITH RECURSIVE {O.LOGIT} SELECT unnest(['intercept', 'total_staked', 'stake_cv']) AS feature, round(unnest([c, p, q]), 4) AS weight FROM steps WHERE i = 25")
def logit_weights(spark, d):
    """Weights of the balanced logit on two features."""
    columns = ["total_staked", "stake_cv"]
    frame = stored(features.model_frame(_members(spark, d), columns=tuple(columns)), "frame")
    model = models.fit_logit(frame, models.fit_scaler(frame, columns).vector(), "event_fraud_flag")
    rows = spark.createDataFrame([("intercept", model.intercept)], "feature string, weight double").unionByName(models.importance(model, columns, spark).drop("importance"))
    return rows.withColumn("weight", F.round("weight", 4))


@query()
def rebuilt_cohort(spark, d):
    """All members by the three parts: without labels, with labels, risk."""
    members = stored(_members(spark, d), "members")
    return rebuild.rebuilt(members, scoring.fit(members))


@query()
def refitted_cohort(spark, d):
    """A scored cohort as it is stored, scored once more by a bundle fitted to it, with the tiers of its own bounds."""
    members = stored(_members(spark, d), "members")
    was = stored(members.join(_scored(spark, d).select("member_id", "risk_score"), "member_id"), "cohort")
    bundle = rebuild.refit(was)
    tier = S.tier(F.col("risk_score"), F.lit(bundle.quantiles["p80"]), F.lit(bundle.quantiles["p95"]))
    return scoring.score(was, bundle).withColumn("risk_tier", tier)


AUDITED = {"draws_played": "count(DISTINCT draw_id)", "sessions_played": "count(DISTINCT session_id)", "active_days": "count(DISTINCT ts::DATE)", "total_staked": "sum(total_bet_amount)", "max_stake_per_draw": "max(total_bet_amount)", "avg_stake_per_draw": "avg(total_bet_amount)", "avg_entropy": "avg(entropy_in_draw)", "total_net_result": "sum(net_result)"}


@query(
    f"WITH {O.HISTORY}, "
    + ", ".join(f"{name} AS (SELECT member_id, {', '.join(f'{x}::DOUBLE AS {c}' for c, x in AUDITED.items())} FROM {rows} GROUP BY 1)" for name, rows in (("a", "history"), ("b", "labelled")))
    + ", k AS ("
    + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) AS rows, round(corr(a.{c}, b.{c}), 6) AS corr FROM a JOIN b USING (member_id)" for c in AUDITED)
    + ') SELECT *, coalesce(abs(corr) < 0.95, true) AS low FROM k'
)
def recompute_audit(spark, d):
    """Features before the first event held against those of all draws."""
    marked = _marked(spark, d)  # of both: what is not audited is neither made nor read
    now, saved = (features.core_features(rows(marked)).select("member_id", *AUDITED) for rows in (history.gaps_before_events, history.with_gaps))
    return checks.recompute_audit(now, saved, "member_id")


@query(
    f"""WITH {O.DRAWS} SELECT unnest(['member', 'time', 'round', 'outcome', 'bets', 'bet_codes']) AS role, unnest(['member_id', 'ts', 'draw_id', 'win_points', 'bets', NULL]) AS "column",
    unnest(['string', 'timestamp_ntz', 'bigint', 'double', 'array<struct<number:string,bet_amount:double>>', NULL]) AS type, unnest([count(member_id), count(ts), count(draw_id), count(win_points), count(bets), 0]) AS filled FROM draws"""
)
def column_report(spark, d):
    """Which columns of the draw records serve as what, and how many rows have them."""
    return tables.column_report(tables.draws(spark, d))


# lookups and normal forms


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey IN (SELECT user_id * 7 FROM events) OR o_custkey IN (SELECT user_id * 7 FROM events)")
def any_field_scan(spark, d):
    """Rows with a listed id in one of several fields."""
    ids = tables.table(spark, d, "events").select((F.col("user_id") * 7).alias("id"))
    return tables.of_any(tables.table(spark, d, "orders").select("o_orderkey", "o_custkey"), ids, ["no_such_id", "o_orderkey", "o_custkey"])


@query(
    """WITH w AS (SELECT DISTINCT (user_id * 7)::VARCHAR AS id FROM events), f AS (SELECT o_orderkey::VARCHAR AS id, 2 AS place, o_orderkey AS k FROM orders UNION ALL SELECT o_custkey::VARCHAR, 1, o_orderkey FROM orders)
    SELECT w.id, CASE min(place) WHEN 1 THEN 'o_custkey' WHEN 2 THEN 'o_orderkey' END AS field, count(DISTINCT k) AS rows FROM w LEFT JOIN f USING (id) GROUP BY 1"""
)
def found_ids(spark, d):
    """Where each listed id is found, and how often."""
    ids = tables.table(spark, d, "events").select((F.col("user_id") * 7).alias("id"))
    return tables.found_in(tables.table(spark, d, "orders"), ids, ["o_custkey", "no_such_id", "o_orderkey"])


@query("SELECT event_id, user_id, event_type, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1")
def distinct_on_available(spark, d):
    e = tables.table(spark, d, "events")
    return explore.distinct_rows(e, ["user_id", "no_such_key", "event_type"], [F.asc("ts"), F.asc("event_id")]).select("event_id", "user_id", "event_type", "ts")


@query("SELECT event_id, epoch_us(ts) - CASE event_id % 4 WHEN 1 THEN 19800000000 WHEN 2 THEN -28800000000 ELSE 0 END AS at FROM events")
def utc_times(spark, d):
    """The moments of texts with and without an offset."""
    zone = F.get(F.array(*map(F.lit, ("", "+05:30", "-0800", "Z"))), (F.col("event_id") % 4).cast("int"))
    return tables.table(spark, d, "events").select("event_id", S.micros(S.utc_time(F.concat(F.col("ts").cast("string"), zone))).alias("at"))


@query("SELECT event_id, CASE event_id % 6 WHEN 5 THEN NULL ELSE event_id % 6 IN (0, 3) END AS says, event_id % 3 > 0 AS holds, value <> 0 AS counts, value > 50 AS flagged FROM events")
def signals(spark, d):
    """Values of several types as signals of a positive."""
    texts = F.array(*(F.lit(t).cast("string") for t in (" Yes", "no", "[]", "FRAUD ", "pending", None)))
    rows = tables.table(spark, d, "events").select("event_id", F.get(texts, (F.col("event_id") % 6).cast("int")).alias("says"), F.slice(F.array(F.lit("a"), F.lit("b")), F.lit(1), (F.col("event_id") % 3).cast("int")).alias("holds"), F.col("value").alias("counts"), (F.col("value") > 50).alias("flagged"))
    return rows.select("event_id", *(S.signal(F.col(f.name), f.dataType).alias(f.name) for f in rows.schema[1:]))


@query(
    f"""WITH {O.DRAWS}, l AS (SELECT member_id, draw_id FROM draws WHERE draw_id % 151 = 0)
    SELECT count(*) AS rows, count(DISTINCT member_id) AS members, min(ts) AS first_time, max(ts) AS last_time, count_if(ts IS NULL)::BIGINT AS no_time, min(len(bets))::INT AS min_bets, median(len(bets))::DOUBLE AS median_bets, max(len(bets))::INT AS max_bets,
    count_if(len(bets) = 0)::BIGINT AS empty_rows, (SELECT count(*) FROM l) AS labels, (SELECT count(DISTINCT member_id) FROM l) AS labelled_members, count_if((member_id, draw_id) IN (SELECT (member_id, draw_id) FROM l))::BIGINT AS matched_rows FROM draws"""
)
def extract_report(spark, d):
    return explore.extract_report(tables.draws(spark, d), tables.event_labels(spark, d))
