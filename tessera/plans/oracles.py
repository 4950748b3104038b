"""DuckDB SQL for the queries that SQL can express, over the same tables."""

from __future__ import annotations

import numpy as np

from ..operators.listnet import ListNet

ORACLE_SQL: dict[str, str] = {}

HIST = """
    ev AS (SELECT event_id, ts, user_id, event_type, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS hp FROM events),
    hist AS (
        SELECT user_id, hp AS hist_pos, event_id AS id, hp // 15 AS session, (hp // 5) % 3 AS query_count, (hp // 5) % 7 AS query_id, hp % 5 AS rank,
            'u' || (k % 20) AS url, 'd' || (k % 6) AS domain, isodow(ts) - 1 AS day, event_id % 3 AS user_feedback,
            CASE event_type WHEN 'purchase' THEN 2 WHEN 'click' THEN 1 ELSE 0 END AS relevance,
            CASE event_type WHEN 'view' THEN 0 WHEN 'error' THEN 1 WHEN 'click' THEN 3 WHEN 'purchase' THEN 4 ELSE 2 END AS action,
            'w' || ((hp // 5) % 7) || ' w' || ((hp // 5) % 7 % 3) AS query_words
        FROM ev)"""


def runs(name: str, source: str) -> str:
    return f"""
    {name}_new AS (SELECT *, CASE WHEN lag(session) OVER w = session AND lag(query_count) OVER w = query_count THEN 0 ELSE 1 END AS fresh FROM {source} WINDOW w AS (PARTITION BY user_id ORDER BY hist_pos)),
    {name}_ids AS (SELECT * EXCLUDE (fresh), sum(fresh) OVER (PARTITION BY user_id ORDER BY hist_pos) AS run_id FROM {name}_new),
    {name} AS (
        SELECT *, action >= 3 AS clicked, sum(CASE WHEN action >= 3 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, run_id ORDER BY hist_pos) - 1 AS click_index,
            sum(CASE WHEN action >= 3 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, run_id) AS run_clicks
        FROM {name}_ids)"""


HRUN = HIST + "," + runs("h", "hist")
D = "CAST({} AS DOUBLE[])"
A, B = "CAST(a.embedding AS DOUBLE[])", "CAST(b.embedding AS DOUBLE[])"
NEXT = "embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"

ORACLE_SQL["vec_l2_norm"] = "SELECT vec_id, round(sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 6) AS norm FROM embeddings"
ORACLE_SQL["vec_l2_distance_pairs"] = f"SELECT a.vec_id, round(list_distance({A}, {B}), 6) AS distance, round(list_cosine_similarity({A}, {B}), 6) AS cosine FROM {NEXT}"
ORACLE_SQL["vec_mean_shift"] = f"SELECT a.vec_id, round((({A})[1] + ({B})[1]) / 2, 6) AS mid1, round(({A})[2] * 0.9 + ({B})[2] * 0.1, 6) AS shift2, round(list_sum([(({A})[i] + ({B})[i]) / 2 * i for i in range(1, 65)]), 6) AS mid_weighted, round(list_sum([(({A})[i] * 0.9 + ({B})[i] * 0.1) * i for i in range(1, 65)]), 6) AS shift_weighted FROM {NEXT}"
ORACLE_SQL["vec_softmax_kl"] = f"""
    WITH e AS (SELECT a.vec_id, i, exp(({A})[i]) AS x, exp(({B})[i]) AS y FROM {NEXT}, range(1, 65) t(i)),
    p AS (SELECT vec_id, i, x / sum(x) OVER (PARTITION BY vec_id) AS p, y / sum(y) OVER (PARTITION BY vec_id) AS q FROM e)
    SELECT vec_id, round(max(p) FILTER (i = 1), 6) AS p1, round(sum(p * ln(p / q)), 6) AS kl FROM p GROUP BY vec_id"""
COIS = """
    firsts AS (SELECT (vec_id // 20) % 4 AS user_id, label, arg_min(embedding, vec_id) AS point FROM embeddings GROUP BY ALL),
    cois AS (SELECT user_id, label, CAST(point AS DOUBLE[]) AS point, CASE WHEN label < 5 THEN 'pos' ELSE 'neg' END AS polarity, 'coi' || lpad(CAST(label AS VARCHAR), 2, '0') AS coi_id, label + 1 AS view_count, label * 10.0 AS view_time, label * 3 AS days FROM firsts)"""
DECAY = "greatest(0, (exp(-3.0) - exp(-0.1 * {days})) / (exp(-3.0) - 1 - 1.1920928955078125e-07))"
ORACLE_SQL["vec_cosine_topk"] = f"""
    WITH {COIS}, p AS (SELECT e.vec_id AS id, c.label AS coi_pos, round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), c.point), 6) AS cosine FROM embeddings e JOIN cois c ON c.user_id = (e.vec_id // 20) % 4)
    SELECT id, coi_pos, cosine, place FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY cosine DESC, coi_pos) AS place FROM p) WHERE place <= 3"""
ASSIGNED = f"""{COIS},
    sims AS (SELECT e.vec_id AS id, c.label, c.polarity, c.coi_id, list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), c.point) AS s FROM embeddings e JOIN cois c ON c.user_id = (e.vec_id // 20) % 4),
    assigned AS (
        SELECT id // 20 AS request_id, id, id % 20 AS doc_pos, arg_max(coi_id, (s, -label)) FILTER (polarity = 'pos') AS coi_id,
            max(s) FILTER (polarity = 'pos') AS ps, coalesce(max(s) FILTER (polarity = 'neg'), -1) AS ns
        FROM sims GROUP BY id),
    scored AS (
        SELECT *, (7 * 0.5 + CASE WHEN avg(ps) OVER r > 0 THEN 1 / (1 + ps / avg(ps) OVER r) ELSE 1 END + 1 / (1 + max(ns) OVER r - ns) + 0.5) / 10 AS context
        FROM assigned WINDOW r AS (PARTITION BY request_id)),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY context DESC, doc_pos) - 1 AS final_rank FROM scored)"""
ORACLE_SQL["coi_assign"] = f"WITH {ASSIGNED} SELECT request_id, id, coi_id, round(ps, 6) AS pos_similarity, round(ns, 6) AS neg_similarity FROM assigned"
ORACLE_SQL["context_score"] = f"WITH {ASSIGNED} SELECT request_id, id, round(context, 6) AS context FROM scored"
ORACLE_SQL["rerank_personalized_news"] = f"WITH {ASSIGNED} SELECT request_id, id, coi_id, round(context, 6) AS context, final_rank FROM ranked"
ORACLE_SQL["rerank_standard_news"] = "SELECT vec_id // 20 AS request_id, vec_id AS id, 0.6 AS context, vec_id % 20 AS final_rank FROM embeddings"
ORACLE_SQL["rerank_faults"] = "SELECT DISTINCT (vec_id // 20) % 4 AS user_id, vec_id // 20 AS request_id, 'coi' AS stage, 'NoCoi' AS code FROM embeddings"
ORACLE_SQL["initial_ranking"] = "SELECT vec_id // 20 AS request_id, vec_id AS id, vec_id % 20 AS final_rank FROM embeddings"
NDCG = "CASE WHEN e.g = 0 THEN {0} ELSE {0} / e.g END"
ORACLE_SQL["ndcg_at_2"] = f"""
    WITH {ASSIGNED},
    rel AS (SELECT r.request_id, r.context, r.final_rank, r.doc_pos, l.quality + 1 - l.toxic AS rel FROM ranked r JOIN labels l ON l.doc_id = r.id),
    placed AS (
        SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY doc_pos) AS i0, row_number() OVER (PARTITION BY request_id ORDER BY context DESC, doc_pos) AS i1,
            row_number() OVER (PARTITION BY request_id ORDER BY final_rank, doc_pos) AS i2, row_number() OVER (PARTITION BY request_id ORDER BY rel DESC, doc_pos) AS j
        FROM rel),
    sums AS (
        SELECT request_id, {', '.join(f"sum(CASE WHEN {c} <= 2 THEN (2 ** rel - 1) / log2({c} + 1) ELSE 0 END) AS {n}" for c, n in (("i0", "d0"), ("i1", "d1"), ("i2", "d2"), ("j", "g")))}
        FROM placed GROUP BY request_id)
    SELECT request_id, {', '.join(f"round(CASE WHEN g = 0 THEN {c} ELSE {c} / g END, 6) AS {n}" for c, n in (("d0", "ndcg_ltr"), ("d1", "ndcg_context"), ("d2", "ndcg_final_ranking"), ("d0", "ndcg_initial_ranking")))}
    FROM sums"""
ORACLE_SQL["coi_decay"] = f"WITH {COIS} SELECT user_id, coi_id, round({DECAY.format(days='days')}, 6) AS decay FROM cois"
REL = f"""
    rel AS (
        SELECT *, {DECAY.format(days='days')} AS decay,
            greatest(0, (view_count / (sum(view_count) OVER (PARTITION BY user_id) + 1.1920928955078125e-07) + view_time / (sum(view_time) OVER (PARTITION BY user_id) + 1.1920928955078125e-07)) * {DECAY.format(days='days')}) AS relevance
        FROM cois WHERE polarity = 'pos')"""
ORACLE_SQL["coi_relevance"] = f"WITH {COIS}, {REL} SELECT user_id, coi_id, round(relevance, 6) AS relevance FROM rel"
RELALL = REL.replace("FROM cois WHERE polarity = 'pos')", "FROM cois)").replace("OVER (P", "FILTER (polarity = 'pos') OVER (P")
ORACLE_SQL["ranker_score"] = f"""
    WITH {COIS}, {RELALL},
    sims AS (SELECT e.vec_id AS id, c.label, c.polarity, c.decay, c.relevance, list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), c.point) AS s FROM embeddings e JOIN rel c ON c.user_id = (e.vec_id // 20) % 4),
    best AS (SELECT *, row_number() OVER (PARTITION BY id, polarity ORDER BY s DESC, label) AS n FROM sims)
    SELECT p.id, round(p.s * p.decay + p.relevance - q.s * q.decay, 6) AS score
    FROM best p JOIN best q ON p.id = q.id AND p.polarity = 'pos' AND q.polarity = 'neg' AND p.n = 1 AND q.n = 1"""
ORACLE_SQL["ranker_rank"] = f"""
    WITH docs AS (SELECT vec_id // 20 AS request_id, vec_id AS id, vec_id % 20 AS r, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
    own AS (
        SELECT *, {DECAY.format(days='r')} AS decay,
            (r + 1) / (sum(r + 1) FILTER (r < 2) OVER (PARTITION BY request_id) + 1.1920928955078125e-07) + 1 / (sum(1.0) FILTER (r < 2) OVER (PARTITION BY request_id) + 1.1920928955078125e-07) AS share
        FROM docs WHERE r < 4),
    able AS (SELECT request_id FROM own GROUP BY request_id HAVING count(*) = 4),
    sims AS (SELECT d.request_id, d.id, o.r, o.r < 2 AS pos, o.decay, greatest(0, o.share * o.decay) AS relevance, list_cosine_similarity(d.v, o.v) AS s FROM docs d JOIN own o ON d.request_id = o.request_id WHERE d.r >= 4),
    best AS (SELECT *, row_number() OVER (PARTITION BY id, pos ORDER BY s DESC, r) AS n FROM sims)
    SELECT p.request_id, p.id, round(p.s * p.decay + p.relevance - q.s * q.decay, 6) AS score
    FROM best p JOIN best q ON p.id = q.id AND p.pos AND NOT q.pos AND p.n = 1 AND q.n = 1 JOIN able ON able.request_id = p.request_id"""
ORACLE_SQL["rank_by_date_fallback"] = "SELECT vec_id // 20 AS request_id, vec_id AS id, row_number() OVER (PARTITION BY vec_id // 20 ORDER BY vec_id % 97 DESC, vec_id) - 1 AS position FROM embeddings"
ORACLE_SQL["top_key_phrases"] = f"""
    WITH {COIS}, {REL},
    placed AS (SELECT (vec_id // 20) % 4 AS user_id, 'coi' || lpad(CAST(label AS VARCHAR), 2, '0') AS coi_id, 'phrase ' || lpad(CAST(vec_id AS VARCHAR), 6, '0') AS words, row_number() OVER (PARTITION BY (vec_id // 20) % 4, label ORDER BY vec_id DESC) AS place FROM embeddings),
    scores AS (SELECT p.user_id, p.coi_id, p.words, p.place, r.relevance, r.relevance * [1.0, 0.75, 0.66][p.place] AS score FROM placed p JOIN rel r ON r.user_id = p.user_id AND r.coi_id = p.coi_id WHERE p.place <= 3)
    SELECT user_id, position, coi_id, words, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, relevance, coi_id, place) AS position FROM scores) WHERE position <= 10"""
ORACLE_SQL["sync_append"] = f"""
    WITH {COIS}, local AS (SELECT user_id, polarity, label AS coi_pos, coi_id, view_count FROM cois WHERE label % 2 = 0),
    n AS (SELECT user_id, polarity, max(coi_pos) + 1 AS n FROM local GROUP BY ALL)
    SELECT * FROM local
    UNION ALL SELECT c.user_id, c.polarity, c.label + coalesce(n.n, 0), c.coi_id, c.view_count + 100 FROM cois c LEFT JOIN n ON n.user_id = c.user_id AND n.polarity = c.polarity WHERE c.label % 2 = 1"""

ORACLE_SQL["coi_close_pairs"] = f"""
    WITH p AS (SELECT a.label AS user_id, 'v' || lpad(CAST(a.vec_id AS VARCHAR), 9, '0') AS id0, 'v' || lpad(CAST(b.vec_id AS VARCHAR), 9, '0') AS id1, 4 * list_distance({A}, {B}) AS d FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id)
    SELECT user_id, id0, id1, round(d, 6) AS distance FROM p WHERE d < 4.5"""
ORACLE_SQL["feedback_faults"] = """
    WITH lost AS (SELECT vec_id // 20 AS request_id FROM embeddings GROUP BY 1 HAVING count(*) FILTER (vec_id IN (SELECT doc_id FROM labels WHERE toxic = 1)) = 0)
    SELECT request_id % 4 AS user_id, request_id, stage, code FROM lost, (VALUES ('coi', 'NoMatchingDocuments'), ('analytics', 'NoRelevantHistoricInfo')) f(stage, code)"""
ORACLE_SQL["streamed_ndcg_at_2"] = ORACLE_SQL["ndcg_at_2"]
ORACLE_SQL["streamed_feedback_faults"] = ORACLE_SQL["feedback_faults"]
ORACLE_SQL["csv_history_scan"] = f"""
    WITH {HIST} SELECT user_id, hist_pos, format('{{:08x}}-eb92-4d36-0000-{{:012x}}', hist_pos, user_id) AS id, session, query_count, query_id, query_words, url, domain, day, relevance, rank FROM hist"""
ORACLE_SQL["state_migrations"] = f"""
    WITH {COIS} SELECT user_id, polarity, label AS coi_pos, coi_id || 'v' || v AS coi_id, CASE WHEN v = 3 THEN view_count ELSE 1 END AS view_count, CASE WHEN v = 3 THEN view_time ELSE 0 END AS view_time,
        CASE WHEN v = 3 THEN epoch(TIMESTAMP '2024-06-01 00:00:00') - 86400 * days ELSE 0 END AS last_view FROM cois, range(4) t(v)"""
ORACLE_SQL["feedback_events"] = """
    SELECT (e.vec_id // 20) || '/' || e.vec_id AS event_id, e.vec_id % 20 + CASE WHEN l.quality + 1 - l.toxic = 0 THEN 1099511627776 ELSE 0 END AS seq,
        CASE WHEN l.quality + 1 - l.toxic = 0 THEN 'dislike' ELSE 'like' END AS kind
    FROM embeddings e JOIN labels l ON l.doc_id = e.vec_id"""
ORACLE_SQL["encoder_agreement"] = f"""
    WITH e AS (SELECT a.vec_id, abs(({A})[i] - ({B})[i]) AS x, CASE WHEN ({A})[i] = 0 THEN abs(({B})[i]) ELSE abs((({A})[i] - ({B})[i]) / ({A})[i]) END AS y FROM {NEXT}, range(1, 65) t(i)),
    m AS (SELECT vec_id, avg(x) AS mae, avg(y) AS mre, avg(x * x) AS mse FROM e GROUP BY vec_id)
    SELECT round(avg(m.mae), 6) AS mae, round(avg(m.mre), 6) AS mre, round(avg(m.mse), 6) AS mse, round(avg(list_cosine_similarity({A}, {B})), 6) AS mean_cosine FROM {NEXT} JOIN m ON m.vec_id = a.vec_id"""

ORACLE_SQL["history_actions"] = f"WITH {HIST} SELECT user_id, hist_pos, action, action >= 3 AS clicked, 2 AS n_terms FROM hist"
ORACLE_SQL["history_runs"] = f"WITH {HRUN} SELECT user_id, hist_pos, run_id, click_index, run_clicks FROM h"
ORACLE_SQL["user_action_inference"] = f"""
    WITH {HIST},
    a AS (SELECT *, CASE WHEN lag(query_id) OVER (PARTITION BY user_id ORDER BY hist_pos) = query_id THEN 0 ELSE 1 END AS fresh FROM hist),
    b AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY hist_pos) AS run FROM a)
    SELECT user_id, hist_pos, CASE WHEN relevance > 0 THEN 2
        WHEN coalesce(max(relevance) OVER (PARTITION BY user_id, run ORDER BY hist_pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) > 0 THEN 1 ELSE 0 END AS inferred_action
    FROM b"""
ORACLE_SQL["history_runs_by_segments"] = ORACLE_SQL["history_runs"]
ORACLE_SQL["user_action_inference_by_segments"] = ORACLE_SQL["user_action_inference"]
ORACLE_SQL["clicks_so_far"] = f"WITH {HIST} SELECT user_id, hist_pos, count(*) FILTER (action >= 3) OVER (PARTITION BY user_id ORDER BY hist_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS clicks FROM hist"
ORACLE_SQL["feedback_classification"] = f"WITH {HIST} SELECT user_id, count(*) FILTER (relevance = 0 AND user_feedback IN (1, 2)) AS n_negative, count(*) FILTER (NOT (relevance = 0 AND user_feedback IN (1, 2))) AS n_positive FROM hist GROUP BY user_id"
ORACLE_SQL["last_query_start"] = f"""
    WITH {HIST}, e AS (SELECT user_id, arg_max(session, hist_pos) AS s, arg_max(query_count, hist_pos) AS q FROM hist GROUP BY user_id)
    SELECT e.user_id, coalesce(max(h.hist_pos) + 1, 0) AS start FROM e LEFT JOIN hist h ON h.user_id = e.user_id AND h.session <> e.s AND h.query_count <> e.q GROUP BY e.user_id"""


def mrr(where: str) -> str:
    return f"round((0.283 + coalesce(sum(1.0 / (rank + 1)) FILTER ({where}), 0)) / (1 + count(*) FILTER ({where})), 6)"


ORACLE_SQL["mrr_by_url"] = f"WITH {HIST} SELECT user_id, url, {mrr('true')} AS mrr, {mrr('action = 1')} AS mrr_miss, {mrr('action = 0')} AS mrr_skip, {mrr('action >= 3')} AS mrr_click FROM hist GROUP BY user_id, url"
ORACLE_SQL["cond_prob_by_domain"] = f"""
    WITH {HIST} SELECT user_id, domain, round((count(*) FILTER (action = 1) + 1) / (count(*) + count(*) FILTER (action = 1)), 6) AS p_miss, round(count(*) FILTER (action = 0) / count(*), 6) AS p_skip,
        round(count(*) FILTER (action = 4) / count(*), 6) AS p_click2 FROM hist GROUP BY user_id, domain"""
ORACLE_SQL["snippet_quality_by_url"] = f"""
    WITH {HRUN},
    r AS (SELECT user_id, url, run_id, max(CASE WHEN action = 0 THEN 1 ELSE 0 END) AS skip, max(run_clicks) AS clicks, min(CASE WHEN clicked THEN click_index END) AS first, count(*) FILTER (action IN (0, 1)) AS n FROM h GROUP BY user_id, url, run_id)
    SELECT user_id, url, round(CASE WHEN sum(n) = 0 THEN 0 ELSE sum(CASE WHEN skip = 1 AND clicks > 0 THEN -1.0 / clicks ELSE 0 END + CASE WHEN first IS NOT NULL THEN 1.0 / (first + 1) ELSE 0 END) / sum(n) END, 6) AS quality
    FROM r GROUP BY user_id, url"""
ENTROPY = "{name} AS (SELECT {keys}, 0 - sum(p * log2(p)) AS click_entropy FROM (SELECT {keys}, n / sum(n) OVER (PARTITION BY {keys}) AS p FROM (SELECT {keys}, rank, count(*) AS n FROM {source} WHERE action >= 3 GROUP BY {keys}, rank)) GROUP BY {keys})"
ORACLE_SQL["click_entropy_by_user"] = f"WITH {HIST}, {ENTROPY.format(name='e', keys='user_id', source='hist')} SELECT user_id, round(click_entropy, 6) AS click_entropy FROM e"


def query_cte(source: str) -> str:
    return f"""
    {ENTROPY.format(name='qe', keys='user_id, query_id', source=source)},
    occ AS (SELECT user_id, query_id, session, query_count, count(*) AS n, count(*) FILTER (action >= 3) AS c, coalesce(sum(1.0 / (rank + 1)) FILTER (action >= 3), 0) AS rr FROM {source} GROUP BY user_id, query_id, session, query_count),
    qs AS (SELECT user_id, query_id, count(*) AS num_occurs, avg(query_count) AS mean_query_count, count(*) / count(DISTINCT session) AS occurs_per_session, (0.283 + sum(rr)) / (1 + sum(c)) AS click_mrr,
        sum(c) / count(*) AS mean_clicks, (sum(n) - sum(c)) / count(*) AS mean_non_clicks FROM occ GROUP BY user_id, query_id),
    qf AS (SELECT qs.*, coalesce(qe.click_entropy, 0) AS click_entropy FROM qs LEFT JOIN qe ON qe.user_id = qs.user_id AND qe.query_id = qs.query_id)"""


def user_cte(source: str) -> str:
    return f"""
    {ENTROPY.format(name='ue', keys='user_id', source=source)},
    uc AS (SELECT user_id, count(*) FILTER (action >= 3 AND rank <= 1) AS click12, count(*) FILTER (action >= 3 AND rank BETWEEN 2 AND 4) AS click345, count(*) FILTER (action >= 3 AND rank > 4) AS click6up FROM {source} GROUP BY user_id),
    uq AS (SELECT DISTINCT user_id, session, query_count, query_id, query_words FROM {source}),
    uw AS (SELECT user_id, count(*) AS num_queries, avg(len(string_split(query_words, ' '))) AS words_per_query FROM uq GROUP BY user_id),
    us AS (SELECT user_id, avg(w) AS unique_words_per_session FROM (SELECT user_id, session, count(DISTINCT x) AS w FROM (SELECT user_id, session, unnest(string_split(query_words, ' ')) AS x FROM uq) GROUP BY user_id, session) GROUP BY user_id),
    uf AS (SELECT uc.*, uw.num_queries, uw.words_per_query, us.unique_words_per_session, coalesce(ue.click_entropy, 0) AS click_entropy FROM uc JOIN uw ON uw.user_id = uc.user_id JOIN us ON us.user_id = uc.user_id LEFT JOIN ue ON ue.user_id = uc.user_id)"""


ORACLE_SQL["query_features"] = f"WITH {HIST}, {query_cte('hist')} SELECT user_id, query_id, num_occurs, round(click_entropy, 6) AS click_entropy, round(mean_query_count, 6) AS mean_query_count, round(occurs_per_session, 6) AS occurs_per_session, round(click_mrr, 6) AS click_mrr, round(mean_clicks, 6) AS mean_clicks, round(mean_non_clicks, 6) AS mean_non_clicks FROM qf"
ORACLE_SQL["user_features"] = f"WITH {HIST}, {user_cte('hist')} SELECT user_id, click12, click345, click6up, num_queries, round(click_entropy, 6) AS click_entropy, round(words_per_query, 6) AS words_per_query, round(unique_words_per_session, 6) AS unique_words_per_session FROM uf"
ORACLE_SQL["seasonality"] = f"WITH {HIST} SELECT user_id, domain, round(2.5 * (1 + count(*) FILTER (day IN (3, 4))) / (1 + count(*) FILTER (day NOT IN (3, 4))), 6) AS seasonality FROM hist WHERE action >= 3 GROUP BY user_id, domain"
SPLIT = HIST + """,
    last AS (SELECT user_id, max(hist_pos // 5) AS q FROM hist GROUP BY user_id),
    now AS (SELECT h.* FROM hist h JOIN last l ON l.user_id = h.user_id AND h.hist_pos // 5 = l.q),
    past AS (SELECT h.* FROM hist h JOIN last l ON l.user_id = h.user_id AND h.hist_pos // 5 < l.q)"""
ORACLE_SQL["terms_variety"] = f"WITH {SPLIT} SELECT user_id, rank, len(list_distinct(string_split(query_words, ' '))) AS terms_variety FROM now"
ORACLE_SQL["target_distribution"] = f"""
    WITH {SPLIT},
    s AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY rank) - 1 AS rank, (count(*) OVER u - row_number() OVER (PARTITION BY user_id ORDER BY rank)) / count(*) OVER u + relevance AS s, max(relevance) OVER u AS m FROM now WINDOW u AS (PARTITION BY user_id))
    SELECT user_id, rank, round(exp(s) / sum(exp(s)) OVER (PARTITION BY user_id), 6) AS target FROM s WHERE m > 0"""


# --- the fifty features, predicate by predicate over a plain join of documents and history ----------


def _atoms() -> tuple[str, list[str]]:
    """Aggregates over (document, history row) pairs, and the expressions of features 1 to 29."""
    masks = {"base": "true", "ant": "h.session <> d.session", "q": "h.query_id = d.query_id", "q_ant": "h.query_id = d.query_id AND h.session <> d.session", "q_cur": "h.query_id = d.query_id AND h.session = d.session"}
    outcomes = {"": "true", "miss": "h.action = 1", "skip": "h.action = 0", "click": "h.action >= 3", "click1": "h.action = 3", "click2": "h.action = 4"}
    sums = [f"count(*) FILTER ({k} AND {m} AND {o}) AS {p}_{mn}_n_{on}, coalesce(sum(1.0 / (h.rank + 1)) FILTER ({k} AND {m} AND {o}), 0) AS {p}_{mn}_r_{on}" for p, k in (("u", "h.url = d.url"), ("d", "h.domain = d.domain")) for mn, m in masks.items() for on, o in outcomes.items()]
    mrr_ = lambda k, o="": f"(0.283 + {k}_r_{o}) / (1 + {k}_n_{o})"
    prob = lambda k, o: f"CASE WHEN {k}_n_ = 0 THEN 0 ELSE ({k}_n_{o} + {int(o == 'miss')}) / ({k}_n_" + (f" + {k}_n_miss" if o == "miss" else "") + ") END"
    sq = lambda k: f"CASE WHEN {k}_n_miss + {k}_n_skip = 0 THEN 0 ELSE coalesce({k}_score, 0) / ({k}_n_miss + {k}_n_skip) END"
    exprs = [
        mrr_("u_base", "click"), prob("u_base", "click2"), prob("u_base", "miss"), sq("u_base"), prob("u_ant", "click2"), prob("u_ant", "miss"), sq("u_ant"), mrr_("u_q"), prob("u_q", "click2"), prob("u_q", "miss"), sq("u_q"),
        mrr_("u_q_ant"), mrr_("u_q_ant", "click"), mrr_("u_q_ant", "miss"), mrr_("u_q_ant", "skip"), prob("u_q_ant", "miss"), sq("u_q_ant"), mrr_("u_q_cur", "miss"),
        prob("d_base", "skip"), prob("d_base", "miss"), prob("d_base", "click2"), sq("d_base"), prob("d_ant", "click2"), prob("d_ant", "miss"), sq("d_ant"), prob("d_q", "miss"), sq("d_q"), mrr_("d_q", "miss"), sq("d_q_ant"),
    ]
    return ", ".join(sums), exprs


def _scores() -> str:
    """Snippet scores of each document's key, by predicate: a run at a time."""
    parts = []
    for p, c in (("u", "url"), ("d", "domain")):
        for m, where in (("base", "true"), ("ant", "h.session <> d.session"), ("q", "h.query_id = d.query_id"), ("q_ant", "h.query_id = d.query_id AND h.session <> d.session")):
            parts.append(f"""
    {p}_{m} AS (
        SELECT user_id, rank, sum(CASE WHEN skip = 1 AND clicks > 0 THEN -1.0 / clicks ELSE 0 END + CASE WHEN first IS NOT NULL THEN 1.0 / (first + 1) ELSE 0 END) AS {p}_{m}_score
        FROM (SELECT d.user_id, d.rank, h.run_id, max(CASE WHEN h.action = 0 THEN 1 ELSE 0 END) AS skip, max(h.run_clicks) AS clicks, min(CASE WHEN h.clicked THEN h.click_index END) AS first
            FROM now d JOIN p h ON h.user_id = d.user_id AND h.{c} = d.{c} AND {where} GROUP BY d.user_id, d.rank, h.run_id) GROUP BY user_id, rank)""")
    return ",".join(parts)


_SUMS, _EXPRS = _atoms()
FEATURES = f"""
    WITH {SPLIT}, {runs('p', 'past')}, {_scores()}, {query_cte('past')}, {user_cte('past')},
    se AS (SELECT user_id, domain, 2.5 * (1 + count(*) FILTER (day IN (3, 4))) / (1 + count(*) FILTER (day NOT IN (3, 4))) AS v FROM past WHERE action >= 3 GROUP BY user_id, domain),
    sums AS (SELECT d.user_id, d.rank, {_SUMS} FROM now d LEFT JOIN past h ON h.user_id = d.user_id GROUP BY d.user_id, d.rank),
    cum AS (
        SELECT user_id, rank, {', '.join(f"coalesce(sum(CASE WHEN u_base_n_ = 0 THEN 0 ELSE u_base_n_{o} / u_base_n_ END) OVER (PARTITION BY user_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cum_{o}" for o in ("skip", "click1", "click2"))}
        FROM sums)"""
_JOINS = "FROM now d JOIN sums s ON s.user_id = d.user_id AND s.rank = d.rank JOIN cum c ON c.user_id = d.user_id AND c.rank = d.rank " + " ".join(
    f"LEFT JOIN {p}_{m} ON {p}_{m}.user_id = d.user_id AND {p}_{m}.rank = d.rank" for p in "ud" for m in ("base", "ant", "q", "q_ant")
) + " LEFT JOIN qf ON qf.user_id = d.user_id AND qf.query_id = d.query_id LEFT JOIN uf ON uf.user_id = d.user_id LEFT JOIN se ON se.user_id = d.user_id AND se.domain = d.domain"
_ALL = [
    "d.rank + 1", *_EXPRS,
    "coalesce(qf.click_entropy, 0)", "2", "coalesce(qf.mean_query_count, 0)", "coalesce(qf.occurs_per_session, 0)", "coalesce(qf.num_occurs, 0)", "coalesce(qf.click_mrr, 0.283)", "coalesce(qf.mean_clicks, 0)", "coalesce(qf.mean_non_clicks, 0)",
    *[f"coalesce(uf.{c}, 0)" for c in ("click_entropy", "click12", "click345", "click6up", "num_queries", "words_per_query", "unique_words_per_session")],
    "cum_skip", "cum_click1", "cum_click2", "len(list_distinct(string_split(d.query_words, ' ')))", "coalesce(se.v, 0)",
]
ORACLE_SQL["features_50"] = f"{FEATURES} SELECT d.user_id, d.rank, {', '.join(f'round(CAST({e} AS DOUBLE), 6) AS f{i:02d}' for i, e in enumerate(_ALL))} {_JOINS}"
ORACLE_SQL["cumulated_features"] = f"{FEATURES} SELECT user_id, rank, round(cum_skip, 6) AS cum_skip, round(cum_click1, 6) AS cum_click1, round(cum_click2, 6) AS cum_click2 FROM cum"

# --- texts --------------------------------------------------------------------------------------

ORACLE_SQL["clean_key_phrase"] = r"SELECT item_id, trim(regexp_replace(regexp_replace(text, '[\p{S}\p{P}]+\p{Z}*', ' ', 'g'), '\p{Z}+', ' ', 'g')) AS cleaned FROM benchmark"
WORDS = r"w AS (SELECT item_id, list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda x: x <> '') AS w FROM benchmark)"
ORACLE_SQL["ngram_candidates"] = f"""
    WITH {WORDS}, g AS (SELECT item_id, n, pos, array_to_string(w[pos + 1:pos + n], ' ') AS phrase FROM (SELECT item_id, w, n, unnest(range(len(w) - n + 1)) AS pos FROM w, range(1, 6) t(n) WHERE len(w) >= 5))
    SELECT item_id, n, phrase, min(pos) AS first_pos, count(*) AS mentions FROM g GROUP BY item_id, n, phrase"""
ORACLE_SQL["ranked_phrases"] = f"""
    WITH {WORDS}, m AS (SELECT item_id, unnest(w) AS phrase, unnest(range(len(w))) AS p FROM w),
    b AS (SELECT item_id, phrase, max(round(1.0 / (p + 1), 6)) AS score FROM m GROUP BY item_id, phrase)
    SELECT * FROM (SELECT item_id, phrase, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, phrase) AS position FROM b WHERE score >= 0.01) WHERE position <= 5"""

# --- spans, samples, shown phrases -----------------------------------------------------------------

SPANS = f"""{HIST},
    starts AS (
        SELECT a.user_id, a.hist_pos + 1 AS stop, coalesce(max(b.hist_pos) FILTER (b.session <> a.session AND b.query_count <> a.query_count) + 1, 0) AS start
        FROM hist a JOIN hist b ON b.user_id = a.user_id AND b.hist_pos <= a.hist_pos GROUP BY a.user_id, a.hist_pos),
    known AS (SELECT s.*, (SELECT max(h.relevance) FROM hist h WHERE h.user_id = s.user_id AND h.hist_pos >= s.start AND h.hist_pos < s.stop) > 0 AS fine FROM starts s),
    back AS (
        SELECT k.* FROM known k JOIN (SELECT user_id, count(*) AS n FROM hist GROUP BY user_id) u ON u.user_id = k.user_id AND u.n = k.stop
        UNION ALL SELECT k.* FROM back p JOIN known k ON k.user_id = p.user_id AND k.stop = p.start WHERE NOT p.fine),
    spans AS (SELECT user_id, start, stop FROM back WHERE fine)"""
ORACLE_SQL["sample_spans"] = f"WITH RECURSIVE {SPANS} SELECT user_id, start, stop FROM spans"
ORACLE_SQL["training_samples"] = f"""
    WITH RECURSIVE {SPANS},
    q AS (SELECT h.* FROM hist h JOIN spans s ON s.user_id = h.user_id AND h.hist_pos >= s.start AND h.hist_pos < s.stop),
    fine AS (SELECT user_id, count(*) AS n FROM q GROUP BY user_id HAVING count(*) = count(DISTINCT rank) AND max(rank) = count(*) - 1 AND count(DISTINCT (session, query_id)) = 1),
    s AS (SELECT q.user_id AS sample_id, f.n, q.rank, (f.n - q.rank - 1) / CAST(f.n AS DOUBLE) + q.relevance AS s FROM q JOIN fine f ON f.user_id = q.user_id)
    SELECT sample_id, n, rank, round(exp(s) / sum(exp(s)) OVER (PARTITION BY sample_id), 6) AS target FROM s"""
ORACLE_SQL["phrases_taken"] = f"""
    WITH shown AS ({ORACLE_SQL["top_key_phrases"]}),
    rows AS (SELECT (vec_id // 20) % 4 AS user_id, 'coi' || lpad(CAST(label AS VARCHAR), 2, '0') AS coi_id, 'phrase ' || lpad(CAST(vec_id AS VARCHAR), 6, '0') AS words FROM embeddings)
    SELECT r.user_id, r.coi_id, r.words, s.words IS NOT NULL AS cleaned FROM rows r LEFT JOIN shown s ON s.user_id = r.user_id AND s.coi_id = r.coi_id AND s.words = r.words"""

# --- the network, with its seeded weights; requests of at most ten documents -----------------------


def _literal(a: np.ndarray) -> str:
    return "[" + ", ".join(f"CAST({x!r} AS DOUBLE)" for x in a.tolist()) + "]" if a.ndim == 1 else "[" + ", ".join(map(_literal, a)) + "]"


def _dense(name: str, x: str, relu: bool) -> str:
    """A layer over a list: each output is the product with its column of weights, plus its bias."""
    p = ListNet.random(7).params
    out = f"list_dot_product({x}, ({_literal(p[f'{name}/weights'].T)})[j]) + ({_literal(p[f'{name}/bias'])})[j]"
    return f"[{f'greatest(0, {out})' if relu else out} for j in range(1, {p[f'{name}/bias'].size + 1})]"


ORACLE_SQL["listnet_ltr_scores"] = f"""
    {FEATURES},
    f AS (SELECT d.user_id, d.rank, [{', '.join(f'CAST({e} AS DOUBLE)' for e in _ALL)}] AS x {_JOINS}),
    h1 AS (SELECT user_id, rank, {_dense("dense1", "x", True)} AS x FROM f),
    h2 AS (SELECT user_id, rank, {_dense("dense2", "x", True)} AS x FROM h1),
    s AS (SELECT user_id, rank, ({_dense("scores", "x", False)})[1] AS s FROM h2),
    lists AS (SELECT user_id, list(s ORDER BY rank) AS l FROM s GROUP BY user_id),
    filled AS (SELECT user_id, len(l) AS n, [coalesce(l[i], l[len(l)]) for i in range(1, 11)] AS x FROM lists),
    logits AS (SELECT user_id, n, {_dense("prob_dist", "x", False)} AS z FROM filled),
    e AS (SELECT user_id, n, [exp(v - list_max(z)) for v in z] AS e FROM logits)
    SELECT user_id, unnest(range(n)) AS rank, round(unnest(e[1:n]) / list_sum(e), 6) AS ltr_score FROM e"""

# --- hashed n-grams of bytes ------------------------------------------------------------------------

WRAP = "18446744073709551615::UHUGEINT"


def _hash_step(h: str, b: str) -> str:
    """One byte into a 64-bit hash, modulo 2**64, then the high bits into the low ones."""
    return f"(xor({h}, {b}) * 11400714819323198485::UHUGEINT) & {WRAP}"


QA = f"""
    t AS (SELECT conv_id, turn, coalesce(CASE WHEN text = '' THEN role ELSE text END, role, '') AS text, coalesce(text, '') AS query FROM conversations),
    asked AS (SELECT conv_id, arg_min(query, turn) AS query FROM t GROUP BY conv_id),
    texts AS (SELECT DISTINCT text FROM (SELECT text FROM t UNION ALL SELECT query FROM asked)),
    padded AS (SELECT text, CASE WHEN text = '' THEN '' ELSE repeat('00', greatest(0, 3 - strlen(text))) || hex(encode(text)) END AS x FROM texts),
    grams AS (SELECT text, x, unnest(range(len(x) // 2 - 2)) AS i FROM padded WHERE x <> ''),
    bytes AS (SELECT text, {', '.join(f"CAST(CAST('0x' || substr(x, 2 * i + {2 * k + 1}, 2) AS INTEGER) AS UHUGEINT) AS b{k}" for k in range(3))} FROM grams),
    m0 AS (SELECT text, b1, b2, {_hash_step("0::UHUGEINT", "b0")} AS h FROM bytes), g0 AS (SELECT text, b1, b2, xor(h, h >> 29) AS h FROM m0),
    m1 AS (SELECT text, b2, {_hash_step("h", "b1")} AS h FROM g0), g1 AS (SELECT text, b2, xor(h, h >> 29) AS h FROM m1),
    m2 AS (SELECT text, {_hash_step("h", "b2")} AS h FROM g1), g2 AS (SELECT text, xor(h, h >> 29) & 31::UHUGEINT AS place FROM m2),
    counts AS (SELECT text, place, count(*) AS n FROM g2 GROUP BY text, place),
    pairs AS (SELECT t.conv_id, t.turn, t.text, f.query FROM t JOIN asked f ON f.conv_id = t.conv_id),
    joint AS (
        SELECT p.conv_id, p.turn, c.place, c.n FROM pairs p JOIN counts c ON c.text = p.text
        UNION ALL SELECT p.conv_id, p.turn, c.place, -c.n FROM pairs p JOIN counts c ON c.text = p.query),
    gaps AS (SELECT conv_id, turn, place, sum(n) AS g FROM joint GROUP BY conv_id, turn, place),
    sums AS (SELECT conv_id, turn, sqrt(sum(CAST(g AS DOUBLE) * g)) AS s FROM gaps GROUP BY conv_id, turn),
    qa AS (SELECT t.conv_id, t.turn, t.conv_id || '-' || t.turn AS id, coalesce(s.s, 0) AS similarity FROM t LEFT JOIN sums s ON s.conv_id = t.conv_id AND s.turn = t.turn)"""
ORACLE_SQL["qa_distance"] = f"WITH {QA} SELECT conv_id AS request_id, id, round(similarity, 6) AS similarity FROM qa"
_SIMILAR = "7 * CASE WHEN avg(similarity) OVER r > 0 THEN 1 / (1 + similarity / avg(similarity) OVER r) ELSE 0.5 END"
_RANKED = "SELECT conv_id AS request_id, id, round(context, 6) AS context, row_number() OVER (PARTITION BY conv_id ORDER BY context DESC, turn) - 1 AS final_rank FROM scored"
ORACLE_SQL["rerank_standard_search"] = f"""
    WITH {QA}, scored AS (SELECT *, ({_SIMILAR} + 1.0 + 1.0 + 0.5) / 10 AS context FROM qa WINDOW r AS (PARTITION BY conv_id)) {_RANKED}"""
ORACLE_SQL["rerank_personalized_search"] = f"""
    WITH {QA}, {COIS},
    met AS (SELECT q.*, c.polarity, list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), c.point) AS s FROM qa q JOIN embeddings e ON e.vec_id = (q.conv_id * 7 + q.turn) % (SELECT count(*) FROM embeddings) JOIN cois c ON c.user_id = q.conv_id % 4),
    near AS (SELECT conv_id, turn, id, similarity, max(s) FILTER (polarity = 'pos') AS ps, coalesce(max(s) FILTER (polarity = 'neg'), -1) AS ns FROM met GROUP BY ALL),
    scored AS (
        SELECT *, ({_SIMILAR} + CASE WHEN avg(ps) OVER r > 0 THEN 1 / (1 + ps / avg(ps) OVER r) ELSE 1 END + 1 / (1 + max(ns) OVER r - ns) + 0.5) / 10 AS context
        FROM near WINDOW r AS (PARTITION BY conv_id))
    {_RANKED}"""

# --- column types -------------------------------------------------------------------------------

#: Columns of the results: b BIGINT, d DOUBLE, s VARCHAR, t BOOLEAN.
SCHEMAS = """
vec_l2_norm: vec_id b, norm d
vec_l2_distance_pairs: vec_id b, distance d, cosine d
vec_mean_shift: vec_id b, mid1 d, shift2 d, mid_weighted d, shift_weighted d
vec_softmax_kl: vec_id b, p1 d, kl d
vec_cosine_topk: id b, coi_pos b, cosine d, place b
coi_assign: request_id b, id b, coi_id s, pos_similarity d, neg_similarity d
context_score: request_id b, id b, context d
rerank_personalized_news: request_id b, id b, coi_id s, context d, final_rank b
rerank_standard_news: request_id b, id b, context d, final_rank b
rerank_faults: user_id b, request_id b, stage s, code s
initial_ranking: request_id b, id b, final_rank b
ndcg_at_2: request_id b, ndcg_ltr d, ndcg_context d, ndcg_final_ranking d, ndcg_initial_ranking d
coi_decay: user_id b, coi_id s, decay d
coi_relevance: user_id b, coi_id s, relevance d
ranker_score: id b, score d
ranker_rank: request_id b, id b, score d
rank_by_date_fallback: request_id b, id b, position b
top_key_phrases: user_id b, position b, coi_id s, words s, score d
sync_append: user_id b, polarity s, coi_pos b, coi_id s, view_count b
history_actions: user_id b, hist_pos b, action b, clicked t, n_terms b
history_runs: user_id b, hist_pos b, run_id b, click_index b, run_clicks b
user_action_inference: user_id b, hist_pos b, inferred_action b
history_runs_by_segments: user_id b, hist_pos b, run_id b, click_index b, run_clicks b
user_action_inference_by_segments: user_id b, hist_pos b, inferred_action b
clicks_so_far: user_id b, hist_pos b, clicks b
feedback_classification: user_id b, n_negative b, n_positive b
last_query_start: user_id b, start b
mrr_by_url: user_id b, url s, mrr d, mrr_miss d, mrr_skip d, mrr_click d
cond_prob_by_domain: user_id b, domain s, p_miss d, p_skip d, p_click2 d
snippet_quality_by_url: user_id b, url s, quality d
click_entropy_by_user: user_id b, click_entropy d
query_features: user_id b, query_id b, num_occurs b, click_entropy d, mean_query_count d, occurs_per_session d, click_mrr d, mean_clicks d, mean_non_clicks d
user_features: user_id b, click12 b, click345 b, click6up b, num_queries b, click_entropy d, words_per_query d, unique_words_per_session d
seasonality: user_id b, domain s, seasonality d
terms_variety: user_id b, rank b, terms_variety b
target_distribution: user_id b, rank b, target d
cumulated_features: user_id b, rank b, cum_skip d, cum_click1 d, cum_click2 d
coi_close_pairs: user_id b, id0 s, id1 s, distance d
feedback_faults: user_id b, request_id b, stage s, code s
feedback_events: event_id s, seq b, kind s
streamed_ndcg_at_2: request_id b, ndcg_ltr d, ndcg_context d, ndcg_final_ranking d, ndcg_initial_ranking d
streamed_feedback_faults: user_id b, request_id b, stage s, code s
csv_history_scan: user_id b, hist_pos b, id s, session b, query_count b, query_id b, query_words s, url s, domain s, day b, relevance b, rank b
state_migrations: user_id b, polarity s, coi_pos b, coi_id s, view_count b, view_time d, last_view b
sample_spans: user_id b, start b, stop b
training_samples: sample_id b, n b, rank b, target d
phrases_taken: user_id b, coi_id s, words s, cleaned t
listnet_ltr_scores: user_id b, rank b, ltr_score d
qa_distance: request_id b, id s, similarity d
rerank_standard_search: request_id b, id s, context d, final_rank b
rerank_personalized_search: request_id b, id s, context d, final_rank b
encoder_agreement: mae d, mre d, mse d, mean_cosine d
clean_key_phrase: item_id b, cleaned s
ngram_candidates: item_id b, n b, phrase s, first_pos b, mentions b
ranked_phrases: item_id b, phrase s, score d, position b
""".strip().splitlines()
_KINDS = {"b": "BIGINT", "d": "DOUBLE", "s": "VARCHAR", "t": "BOOLEAN"}


def _cast(sql: str, columns: list[str]) -> str:
    """The query with its columns cast, in this order."""
    names = [c.split() for c in columns]
    return f"SELECT {', '.join(f'CAST({n} AS {_KINDS[k]}) AS {n}' for n, k in names)} FROM ({sql}) AS q"


for _line in SCHEMAS:
    _name, _, _columns = _line.partition(": ")
    ORACLE_SQL[_name] = _cast(ORACLE_SQL[_name], _columns.split(", "))
ORACLE_SQL["features_50"] = _cast(ORACLE_SQL["features_50"], ["user_id b", "rank b", *(f"f{i:02d} d" for i in range(50))])
