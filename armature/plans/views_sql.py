"""The experiment views as DuckDB SQL (twins of ``armature.sources.tables``).

Used only to build the oracle SQL strings; the Spark side never parses SQL.
"""

from __future__ import annotations

from armature.schemas import RULES

_RULE_VALUES = ", ".join(f"({i}, '{r}')" for i, r in enumerate(RULES))

VIEWS: dict[str, str] = {
    "v_distractors": """
        SELECT s_suppkey AS id,
               CASE s_suppkey % 4 WHEN 1 THEN 'positive' WHEN 2 THEN 'neutral' ELSE 'negative' END AS sentiment,
               CASE WHEN s_suppkey % 8 < 4 THEN 'text' ELSE 'image' END AS modality,
               'asset/' || CAST(s_suppkey % 50 AS VARCHAR) AS file_path
        FROM supplier WHERE s_suppkey % 4 <> 0""",
    "v_scenarios": """
        SELECT p_partkey AS id, p_name AS context, p_brand AS action1, p_type AS action2 FROM part""",
    "v_scenario_rules": f"""
        SELECT p_partkey AS id, r.rule AS rule,
               CASE (p_partkey * 7 + r.k) % 3 WHEN 0 THEN 'No' WHEN 1 THEN 'Yes' ELSE 'No agreement' END AS a1,
               CASE (p_size + r.k) % 3 WHEN 0 THEN 'No' WHEN 1 THEN 'Yes' ELSE 'No agreement' END AS a2
        FROM part CROSS JOIN (VALUES {_RULE_VALUES}) AS r(k, rule)""",
    "v_responses": """
        SELECT l_returnflag AS model_id, l_partkey AS scenario_id, l_linenumber % 2 AS question_ordering,
               CAST(l_partkey AS VARCHAR) || '_' || CAST(l_linenumber % 2 AS VARCHAR) AS baseline_id,
               CASE WHEN l_suppkey % 4 = 0 THEN NULL ELSE l_suppkey END AS distractor_id,
               l_discount AS a1_prob, l_tax AS a2_prob
        FROM lineitem""",
    "v_option_responses": """
        SELECT event_id, 'm' || CAST(event_id % 3 AS VARCHAR) AS model_id, user_id AS scenario_id,
               CASE WHEN event_id % 4 = 0 THEN NULL ELSE event_id % 4 END AS distractor_id,
               CASE WHEN event_id % 1009 = 0 THEN 0.0 ELSE CAST((event_id * 7) % 101 AS DOUBLE) / 101 END AS good_prob,
               CASE WHEN event_id % 1009 = 0 THEN 0.0 ELSE CAST((event_id * 13 + 5) % 101 AS DOUBLE) / 101 END AS ok_prob,
               CASE WHEN event_id % 1009 = 0 THEN 0.0 ELSE CAST((event_id * 29 + 11) % 101 AS DOUBLE) / 101 END AS bad_prob,
               CASE WHEN event_id % 50 = 0 THEN NULL WHEN event_type = 'signup' THEN 'ESH'
                    WHEN event_type = 'purchase' THEN 'YTA' WHEN event_type = 'error' THEN 'NTA'
                    WHEN event_type = 'click' THEN 'NAH' ELSE 'INFO' END AS verdict,
               value AS score
        FROM events""",
    "v_foundations": """
        SELECT vec_id, 'm' || CAST(label % 3 AS VARCHAR) AS model_id, vec_id - vec_id % 4 AS scenario_id,
               CASE WHEN vec_id % 4 = 0 THEN NULL ELSE vec_id % 4 END AS distractor_id,
               CAST(embedding[1] AS DOUBLE) AS ch_score, CAST(embedding[2] AS DOUBLE) AS fc_score,
               CAST(embedding[3] AS DOUBLE) AS lb_score, CAST(embedding[4] AS DOUBLE) AS as_score,
               CAST(embedding[5] AS DOUBLE) AS pd_score
        FROM embeddings""",
    "v_verdict_probs": """
        SELECT vec_id, 'm' || CAST(label % 3 AS VARCHAR) AS model_id, vec_id - vec_id % 4 AS scenario_id,
               CASE WHEN vec_id % 4 = 0 THEN NULL ELSE vec_id % 4 END AS distractor_id,
               abs(CAST(embedding[6] AS DOUBLE)) AS esh_prob, abs(CAST(embedding[7] AS DOUBLE)) AS yta_prob,
               abs(CAST(embedding[8] AS DOUBLE)) AS nta_prob, abs(CAST(embedding[9] AS DOUBLE)) AS nah_prob,
               abs(CAST(embedding[10] AS DOUBLE)) AS info_prob
        FROM embeddings""",
    "v_text_responses": """
        SELECT doc_id,
               CASE doc_id % 5 WHEN 0 THEN 'Verdict: nta' WHEN 1 THEN 'I say NTA, not YTA'
                    WHEN 2 THEN 'verdict - ESH' WHEN 3 THEN 'unsure' ELSE '' END
               || CASE WHEN doc_id % 3 = 0 THEN chr(10) || 'Reasoning: ' ELSE ' ' END
               || text
               || CASE WHEN doc_id % 7 = 0 THEN chr(10) || 'Summary: end' ELSE '' END AS answer
        FROM documents""",
    "v_batch_responses": """
        SELECT CAST(conv_id AS VARCHAR) AS custom_id, turn AS line_no, text AS content FROM conversations""",
}

# view -> views it reads
_DEPS = {"v_done_pairs": ["v_responses"]}


def with_views(body: str, *names: str) -> str:
    """Prefix ``body`` with the CTEs for ``names`` (in dependency order)."""
    seen: list[str] = []

    def add(n):
        for d in _DEPS.get(n, []):
            add(d)
        if n not in seen:
            seen.append(n)
    for n in names:
        add(n)
    ctes = ",\n".join(f"{n} AS ({VIEWS[n].strip()})" for n in seen)
    body = body.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
