"""The queries of plans.queries in DuckDB's SQL."""

from __future__ import annotations

DRAWS = """
lines AS (
    SELECT l_orderkey,
           list(struct_pack(number := (l_partkey % 38)::VARCHAR, bet_amount := l_quantity) ORDER BY (l_partkey % 38)::VARCHAR, l_quantity) AS bets,
           sum(l_quantity) AS staked, sum(CASE WHEN l_returnflag = 'R' THEN 2 * l_quantity ELSE 0 END) AS won
    FROM lineitem GROUP BY l_orderkey
), draws AS (
    SELECT 'GK' || lpad(o_custkey::VARCHAR, 8, '0') AS member_id, o_orderkey AS draw_id, o_orderdate AS ts, c_nationkey::VARCHAR AS ccs_id,
           (year(o_orderdate) * 12 + month(o_orderdate))::BIGINT AS session_id, coalesce(bets, []) AS bets,
           coalesce(staked, 0)::DOUBLE AS total_bet_amount, coalesce(won, 0)::DOUBLE AS win_points
    FROM orders LEFT JOIN lines ON o_orderkey = l_orderkey LEFT JOIN customer ON o_custkey = c_custkey
)"""

FEATURES = (
    DRAWS
    + """, amounts AS (
    SELECT *, list_transform(bets, lambda b: b.bet_amount) AS a, list_filter(list_transform(bets, lambda b: b.bet_amount), lambda x: x > 0) AS z FROM draws
), summed AS (
    SELECT *, len(z) AS n, coalesce(list_sum(z), 0) AS t, coalesce(list_sum(z), 0) / nullif(len(z), 0) AS m FROM amounts
), featured AS (
    SELECT member_id, draw_id, ts, ccs_id, session_id, bets, total_bet_amount, win_points, win_points - total_bet_amount AS net_result,
           len(a)::BIGINT AS bets_per_draw, n::BIGINT AS nonzero_bets_per_draw,
           len(list_filter(z, lambda x: x <= 1)) / greatest(n, 1)::DOUBLE AS tiny_bet_ratio_in_draw,
           CASE WHEN t > 0 THEN list_max(a) / t ELSE 0 END::DOUBLE AS max_bet_share_in_draw,
           CASE WHEN n > 1 THEN sqrt(list_sum(list_transform(z, lambda x: (x - m) * (x - m))) / n) ELSE 0 END::DOUBLE AS bet_amount_std_in_draw,
           coalesce(m, 0)::DOUBLE AS bet_amount_mean_in_draw,
           CASE WHEN t > 0 THEN 0 - list_sum(list_transform(z, lambda x: (x / t) * log2(x / t))) ELSE 0 END::DOUBLE AS entropy_in_draw,
           CASE WHEN t > 0 THEN greatest(2 * list_sum(list_transform(list_sort(z), lambda x, i: x * i)) / (n * t) - (n + 1) / n::DOUBLE, 0) ELSE 0 END::DOUBLE AS gini_in_draw,
           n / 38.0::DOUBLE AS position_coverage,
           list_transform(list_filter(bets, lambda b: b.bet_amount > 0), lambda b: b.number || '=' || b.bet_amount::VARCHAR)::VARCHAR AS bet_template
    FROM summed
)"""
)

HISTORY = (
    FEATURES
    + """, labelled AS (
    SELECT *, (draw_id % 151 = 0)::INT AS event_label,
           (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY member_id ORDER BY ts NULLS LAST, draw_id NULLS LAST))) / 1e6::DOUBLE AS inter_draw_seconds
    FROM featured
), first_events AS (
    SELECT member_id, arg_min(ts, struct_pack(t := ts, d := draw_id)) AS first_ts, arg_min(draw_id, struct_pack(t := ts, d := draw_id)) AS first_draw_id
    FROM labelled WHERE event_label = 1 GROUP BY member_id
), history AS (
    SELECT l.*, (f.member_id IS NOT NULL)::INT AS event_fraud_flag
    FROM labelled l LEFT JOIN first_events f USING (member_id) WHERE f.member_id IS NULL OR l.ts < f.first_ts
)"""
)


def _measures() -> str:
    from drawlens.operators.features import MEASURES

    names = {"sum": "sum", "avg": "avg", "median": "median", "std": "stddev_samp", "max": "max", "min": "min"}
    return ", ".join(f"coalesce({names[s]}({c})::DOUBLE, 0) AS {name}" for c, columns in MEASURES.items() for s, name in columns.items())


MEMBERS = (
    HISTORY
    + f""", modes AS (
    SELECT member_id, arg_max(ccs_id, struct_pack(n := n, o := -ccs_id::INT)) AS primary_ccs_id FROM (SELECT member_id, ccs_id, count(*) AS n FROM history GROUP BY ALL) WHERE ccs_id IS NOT NULL GROUP BY 1
), core AS (
    SELECT member_id, count(DISTINCT draw_id) AS draws_played, count(DISTINCT session_id) AS sessions_played, count(DISTINCT ts::DATE) AS active_days,
           count(DISTINCT bet_template) AS unique_templates, {_measures()}, avg((net_result > 0)::INT)::DOUBLE AS positive_draw_rate, max(event_fraud_flag) AS event_fraud_flag
    FROM history GROUP BY member_id
), ratios AS (
    SELECT *, coalesce(stake_std / nullif(avg_stake_per_draw, 0), 0) AS stake_cv, greatest(1 - unique_templates / draws_played::DOUBLE, 0) AS template_reuse_ratio,
           coalesce(std_net_result / nullif(avg_stake_per_draw, 0), 0) AS pnl_volatility, positive_draw_rate AS win_rate, draws_played / active_days::DOUBLE AS draws_per_active_day
    FROM core
), sessions AS (
    SELECT member_id, avg(n)::DOUBLE AS avg_draws_per_session FROM (SELECT member_id, session_id, count(DISTINCT draw_id) AS n FROM history GROUP BY ALL) GROUP BY 1
), templates AS (
    SELECT member_id, max(n) AS max_template_reuse FROM (SELECT member_id, bet_template, count(*) AS n FROM history GROUP BY ALL) GROUP BY 1
), groups AS (
    SELECT ccs_id, count(DISTINCT member_id) AS ccs_player_count, sum(total_bet_amount) AS ccs_total_staked, avg(total_bet_amount) AS ccs_avg_bet FROM history WHERE ccs_id IS NOT NULL GROUP BY 1
), members AS (
    SELECT r.*, primary_ccs_id, coalesce(avg_draws_per_session, 1) AS avg_draws_per_session, coalesce(max_template_reuse, 1) AS max_template_reuse,
           coalesce(ccs_player_count, 0) AS ccs_player_count, coalesce(ccs_total_staked, 0) AS ccs_total_staked, coalesce(ccs_avg_bet, 0) AS ccs_avg_bet
    FROM ratios r LEFT JOIN modes USING (member_id) LEFT JOIN sessions USING (member_id) LEFT JOIN templates USING (member_id) LEFT JOIN groups g ON g.ccs_id = primary_ccs_id
)"""
)

SCORED = (
    MEMBERS
    + """, bounds AS (SELECT min(stake_cv) AS a0, max(stake_cv) AS a1, min(template_reuse_ratio) AS b0, max(template_reuse_ratio) AS b1, min(total_staked) AS c0, max(total_staked) AS c1 FROM members
), scored AS (
    SELECT member_id, draws_played, event_fraud_flag, primary_ccs_id,
           round(CASE WHEN a1 <= a0 THEN 0 ELSE least(greatest((stake_cv - a0) / (a1 - a0), 0), 1.5) END, 6) AS anomaly_score,
           round(CASE WHEN c1 <= c0 THEN 0 ELSE least(greatest((total_staked - c0) / (c1 - c0), 0), 1.5) END, 6) AS supervised_score
    FROM members, bounds
), risk AS (SELECT *, round(0.6::DOUBLE * anomaly_score + 0.4::DOUBLE * supervised_score, 6) AS risk_score FROM scored)"""
)


def _style_columns() -> str:
    from drawlens.operators.features import LOG_STYLE, STYLE

    value = lambda c: f"coalesce(ln(1 + greatest({c}::DOUBLE, 0)), 0)" if c in LOG_STYLE else f"coalesce({c}::DOUBLE, 0)"
    return ", ".join(f"{value(c)} AS v{i}" for i, c in enumerate(STYLE))


def _axis(n: int, matrix: str, steps: int) -> str:
    """Power iteration: the matrix's first axis with its largest loading positive, and its eigenvalue."""
    times = "list_transform(m, lambda row: list_dot_product(row, v))"
    return f"""p{n}(i, v) AS (
    SELECT 0, [1 + j / 7.0 FOR j IN range(13)]::DOUBLE[]
    UNION ALL SELECT i + 1, list_transform(w, lambda t: t / sqrt(list_dot_product(w, w))) FROM (SELECT i, {times} AS w FROM p{n}, {matrix} WHERE i < {steps})
), a{n} AS MATERIALIZED (
    SELECT list_transform(v, lambda t: t * CASE WHEN list_max(v) >= -list_min(v) THEN 1 ELSE -1 END) AS v, list_dot_product(v, {times}) AS e FROM p{n}, {matrix} WHERE i = {steps}
)"""


#: The members' style space: scaled vectors x, their covariance m, two axes by power iteration and deflation, and the
#: inverse covariance by sweeping each column that varies.
STYLE_SPACE = (
    MEMBERS
    + f""", style AS (SELECT member_id, {_style_columns()} FROM members
), vectors AS MATERIALIZED (
    SELECT member_id, [{", ".join(f"(v{i} - avg(v{i}) OVER ()) / coalesce(nullif(stddev_pop(v{i}) OVER (), 0), 1)" for i in range(13))}] AS x FROM style
), covariance AS MATERIALIZED (
    SELECT [{", ".join("[" + ", ".join(f"sum(x[{i + 1}] * x[{j + 1}]) / (count(*) - 1)" for j in range(13)) + "]" for i in range(13))}] AS m FROM vectors
), {_axis(1, "covariance", 3000)}, deflated AS MATERIALIZED (
    SELECT list_transform(m, lambda row, k: list_transform(row, lambda t, l: t - e * v[k] * v[l])) AS m FROM covariance, a1
), {_axis(2, "deflated", 3000)}, swept(k, b) AS (
    SELECT 0, m FROM covariance
    UNION ALL SELECT k + 1, list_transform(b, lambda row, i: list_transform(row, lambda t, j: CASE
        WHEN b[k + 1][k + 1] < 1e-9 THEN CASE WHEN i = k + 1 OR j = k + 1 THEN 0 ELSE t END
        WHEN i = k + 1 AND j = k + 1 THEN -1 / b[k + 1][k + 1]
        WHEN i = k + 1 OR j = k + 1 THEN t / b[k + 1][k + 1]
        ELSE t - b[i][k + 1] * b[k + 1][j] / b[k + 1][k + 1] END)) FROM swept WHERE k < 13
), inverse AS MATERIALIZED (SELECT list_transform(b, lambda row: list_transform(row, lambda t: -t)) AS m FROM swept WHERE k = 13)"""
)

#: Newton's method for the balanced logit with an L2 penalty of 10 / 2 on both weights, from two scaled features.
LOGIT = (
    MEMBERS
    + """, logs AS (SELECT event_fraud_flag AS y, coalesce(ln(1 + greatest(total_staked, 0)), 0) AS u, coalesce(ln(1 + greatest(stake_cv, 0)), 0) AS v FROM members
), points AS MATERIALIZED (
    SELECT y, count(*) OVER () / (2.0 * count(*) OVER (PARTITION BY y)) AS w, (u - avg(u) OVER ()) / stddev_pop(u) OVER () AS a, (v - avg(v) OVER ()) / stddev_pop(v) OVER () AS b FROM logs
), steps(i, c, p, q) AS (
    SELECT 0, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE
    UNION ALL
    SELECT i + 1, c - (g0 * (h11 * h22 - h12 * h12) - h01 * (g1 * h22 - h12 * g2) + h02 * (g1 * h12 - h11 * g2)) / det,
           p - (h00 * (g1 * h22 - h12 * g2) - g0 * (h01 * h22 - h12 * h02) + h02 * (h01 * g2 - g1 * h02)) / det,
           q - (h00 * (h11 * g2 - g1 * h12) - h01 * (h01 * g2 - g1 * h02) + g0 * (h01 * h12 - h11 * h02)) / det
    FROM (
        SELECT *, h00 * (h11 * h22 - h12 * h12) - h01 * (h01 * h22 - h12 * h02) + h02 * (h01 * h12 - h11 * h02) AS det FROM (
            SELECT i, c, p, q, sum(w * (s - y)) AS g0, sum(w * (s - y) * a) + 10 * p AS g1, sum(w * (s - y) * b) + 10 * q AS g2, sum(w * s * (1 - s)) AS h00, sum(w * s * (1 - s) * a) AS h01,
                   sum(w * s * (1 - s) * b) AS h02, sum(w * s * (1 - s) * a * a) + 10 AS h11, sum(w * s * (1 - s) * a * b) AS h12, sum(w * s * (1 - s) * b * b) + 10 AS h22
            FROM (SELECT i, c, p, q, w, y, a, b, 1 / (1 + exp(-(c + p * a + q * b))) AS s FROM steps, points WHERE i < 25) GROUP BY i, c, p, q
        )
    )
)"""
)
