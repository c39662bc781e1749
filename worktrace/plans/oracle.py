"""DuckDB side of the registered plans: shared CTEs, put together as a query needs them."""

from __future__ import annotations

import re

#: name -> SQL of the CTE. A CTE may use those before it.
CTES: dict[str, str] = {
    "raw": """
SELECT concat('u', CAST(user_id AS VARCHAR)) AS session_id, event_id, (epoch_us(ts) // 1000) AS timestamp_ms, event_type, value,
       CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, user_id, strftime(ts, '%Y-%m-%d') AS chunk_id
FROM events""",
    "canon": """
SELECT *, CASE WHEN application IS NULL OR application = 'app3' THEN NULL WHEN contains(window_title, 'Doc_5') THEN 'system:Doc_5'
               WHEN window_title = 'Doc_6 - Word' THEN NULL WHEN browser_domain IS NOT NULL THEN concat('browser:', browser_domain)
               ELSE concat('app:', application) END AS system
FROM (SELECT session_id, event_id, timestamp_ms, event_type,
    CASE event_type WHEN 'view' THEN 'navigation' WHEN 'signup' THEN 'input' WHEN 'click' THEN 'pointer' WHEN 'purchase' THEN 'clipboard' WHEN 'error' THEN 'ui_state' ELSE 'unknown' END AS interaction_category,
    CASE WHEN k % 10 = 9 THEN NULL ELSE concat('app', CAST(k % 4 AS VARCHAR)) END AS application,
    CASE WHEN k % 7 = 0 THEN NULL ELSE concat('Doc_', CAST(k % 7 AS VARCHAR), ' - Word') END AS window_title,
    CASE WHEN k % 2 = 0 THEN concat('127.0.0.1:', CAST(5130 + k % 3 AS VARCHAR)) END AS browser_domain,
    CASE WHEN k % 2 = 0 THEN concat('http://127.0.0.1:', CAST(5130 + k % 3 AS VARCHAR), '/#/r', CAST(k % 6 AS VARCHAR)) END AS browser_url,
    value > 100 AS has_extracted_text, chunk_id, concat('op', CAST(user_id % 4 AS VARCHAR)) AS operator,
    CAST(row_number() OVER (PARTITION BY session_id ORDER BY timestamp_ms, event_id) - 1 AS BIGINT) AS idx FROM raw)""",
    "gt": """
SELECT session_id, concat(session_id, '-c', CAST(grp AS VARCHAR)) AS case_id, concat('P', CAST(max(k) % 15 AS VARCHAR)) AS process_code,
       min(timestamp_ms) AS start_ms, max(timestamp_ms) AS end_ms, count(*) AS n_events
FROM (SELECT r.*, coalesce(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY timestamp_ms, event_id
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS grp FROM raw r) g
WHERE grp % 5 <> 4 GROUP BY session_id, grp""",
    "points": """
SELECT session_id, start_ms AS at_ms, CAST(substr(process_code, 2) AS INTEGER) % 3 = 0 AS is_resume
FROM (SELECT *, lag(end_ms) OVER (PARTITION BY session_id ORDER BY start_ms) AS prev FROM gt) WHERE prev IS NOT NULL""",
    "trans": """
SELECT * FROM (SELECT session_id, idx, event_id AS event_i_id, lead(event_id) OVER w AS event_next_id, timestamp_ms, lead(timestamp_ms) OVER w AS next_timestamp_ms,
  lead(timestamp_ms) OVER w - timestamp_ms AS delta_t_ms, ln(1 + greatest(lead(timestamp_ms) OVER w - timestamp_ms, 0)) AS log1p_delta_t_ms,
  density_before, lead(ahead) OVER w AS density_after,
  application IS DISTINCT FROM lead(application) OVER w AS application_changed, window_title IS DISTINCT FROM lead(window_title) OVER w AS window_title_changed,
  browser_domain IS DISTINCT FROM lead(browser_domain) OVER w AS browser_domain_changed, interaction_category IS DISTINCT FROM lead(interaction_category) OVER w AS interaction_category_changed,
  has_extracted_text OR lead(has_extracted_text) OVER w AS extracted_text_at_transition, chunk_id IS DISTINCT FROM lead(chunk_id) OVER w AS chunk_boundary
  FROM (SELECT *, count(*) OVER (PARTITION BY session_id ORDER BY timestamp_ms RANGE BETWEEN 43199999 PRECEDING AND CURRENT ROW) AS density_before,
               count(*) OVER (PARTITION BY session_id ORDER BY timestamp_ms RANGE BETWEEN CURRENT ROW AND 43199999 FOLLOWING) AS ahead FROM canon)
  WINDOW w AS (PARTITION BY session_id ORDER BY idx)) WHERE event_next_id IS NOT NULL""",
    "labelled": """
SELECT t.*, p.at_ms IS NOT NULL AS is_boundary, p.is_resume FROM trans t LEFT JOIN points p ON p.session_id = t.session_id AND t.timestamp_ms <= p.at_ms AND p.at_ms < t.next_timestamp_ms""",
    "filled": """
SELECT *, last_value(system IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY idx ROWS UNBOUNDED PRECEDING) AS f FROM canon""",
    "fruns": """
SELECT *, sum(CAST(f IS DISTINCT FROM p AND idx > 0 AS INTEGER)) OVER (PARTITION BY session_id ORDER BY idx ROWS UNBOUNDED PRECEDING) AS run_no
FROM (SELECT *, lag(f) OVER (PARTITION BY session_id ORDER BY idx) AS p FROM filled)""",
    "cut0": """
SELECT session_id, idx, coalesce(f <> n, false) AS boundary FROM (SELECT *, lead(f) OVER w AS n, lead(idx) OVER w AS ni FROM filled WINDOW w AS (PARTITION BY session_id ORDER BY idx)) WHERE ni IS NOT NULL""",
    "fr": """
SELECT session_id, run_no, min(f) AS value, min(idx) AS start_idx, max(idx) AS end_idx, count(*) AS length FROM fruns WHERE f IS NOT NULL GROUP BY session_id, run_no""",
    "shortreturns": """
SELECT session_id, left_end, start_idx FROM (SELECT *, lag(run_no) OVER w AS left_run, lag(end_idx) OVER w AS left_end FROM fr WINDOW w AS (PARTITION BY session_id, value ORDER BY run_no))
WHERE run_no - left_run = 2 AND start_idx - left_end - 1 <= 2""",
    "cut": """
SELECT c.session_id, c.idx, c.boundary AND NOT EXISTS (SELECT 1 FROM shortreturns r WHERE r.session_id = c.session_id AND (r.left_end = c.idx OR r.start_idx - 1 = c.idx)) AS boundary FROM cut0 c""",
    "seg": """
SELECT n.*, CAST(coalesce(sum(CAST(cutbefore AS INTEGER)) OVER (PARTITION BY session_id ORDER BY idx ROWS UNBOUNDED PRECEDING), 0) AS BIGINT) AS seg_no
FROM (SELECT e.*, coalesce(lag(c.boundary) OVER (PARTITION BY e.session_id ORDER BY e.idx), false) AS cutbefore FROM canon e LEFT JOIN cut c USING (session_id, idx)) n""",
    "segf": """
SELECT *, last_value(system IGNORE NULLS) OVER (PARTITION BY session_id, seg_no ORDER BY idx ROWS UNBOUNDED PRECEDING) AS f FROM seg""",
    "domsys": """
SELECT session_id, seg_no, arg_min(f, (-n, first)) AS dominant FROM (SELECT session_id, seg_no, f, count(*) AS n, min(idx) AS first FROM segf WHERE f IS NOT NULL GROUP BY ALL) GROUP BY ALL""",
    "domdoc": """
SELECT session_id, seg_no, arg_min(d, (-n, first)) AS document FROM (
  SELECT s.session_id, s.seg_no, trim(ltrim(regexp_replace(window_title, '\\s*-\\s*Word$', ''), '*')) AS d, count(*) AS n, min(idx) AS first
  FROM segf s JOIN domsys m ON s.session_id = m.session_id AND s.seg_no = m.seg_no AND m.dominant = concat('app:', s.application)
  WHERE s.application IN ('app0', 'app1') AND window_title IS NOT NULL GROUP BY ALL) WHERE d <> '' GROUP BY ALL""",
    "ctx": """
SELECT session_id, seg_no, CASE WHEN dominant IS NULL THEN 'unknown' WHEN document IS NULL THEN dominant ELSE concat(dominant, '::', document) END AS dominant_context
FROM (SELECT DISTINCT session_id, seg_no FROM seg) LEFT JOIN domsys USING (session_id, seg_no) LEFT JOIN domdoc USING (session_id, seg_no)""",
    "exec": """
SELECT concat(session_id, '::exec', CAST(seg_no AS VARCHAR)) AS execution_id, session_id, seg_no, min(operator) AS operator, min(timestamp_ms) AS start_ms, max(timestamp_ms) AS end_ms,
       max(timestamp_ms) - min(timestamp_ms) AS duration_ms, count(*) AS event_count, dominant_context
FROM seg JOIN ctx USING (session_id, seg_no) GROUP BY session_id, seg_no, dominant_context""",
    "stepev": """
SELECT *, CAST(sum(CAST(new AS INTEGER)) OVER (PARTITION BY session_id, seg_no ORDER BY idx ROWS UNBOUNDED PRECEDING) AS BIGINT) AS step_no
FROM (SELECT *, row_number() OVER w > 1 AND (lag(f) OVER w IS DISTINCT FROM f OR lag(interaction_category) OVER w IS DISTINCT FROM interaction_category) AS new
      FROM segf WINDOW w AS (PARTITION BY session_id, seg_no ORDER BY idx))""",
    "step": """
SELECT session_id, seg_no, step_no, min(f) AS system, min(interaction_category) AS interaction_category, count(*) AS n_events, min(timestamp_ms) AS start_ms, max(timestamp_ms) AS end_ms
FROM stepev GROUP BY session_id, seg_no, step_no""",
    "sigs": """
SELECT session_id, seg_no, string_agg(system, '>' ORDER BY step_no) AS signature, count(*) AS len
FROM (SELECT session_id, seg_no, step_no, system, lag(system) OVER (PARTITION BY session_id, seg_no ORDER BY step_no) AS p FROM step WHERE system IS NOT NULL)
WHERE p IS DISTINCT FROM system GROUP BY session_id, seg_no""",
    "ex": """
SELECT e.*, coalesce(s.signature, '') AS signature FROM exec e LEFT JOIN sigs s USING (session_id, seg_no)""",
    "manual": """
SELECT session_id, seg_no, count(*) FILTER (interaction_category IN ('input', 'pointer', 'clipboard')) / count(*) AS manual_share, count(DISTINCT interaction_category) AS n_categories FROM seg GROUP BY ALL""",
    "touch": """
SELECT session_id, seg_no, count(DISTINCT system) AS n_systems FROM step GROUP BY ALL""",
    "prof": """
SELECT dominant_context AS process_id, count(*) AS n, sum(duration_ms) AS total_ms, avg(manual_share) AS manual_share, avg(n_systems) AS systems, count(DISTINCT operator) AS operators, count(DISTINCT signature) AS n_variants,
       max(c) / count(*) AS dominant_share
FROM (SELECT ex.*, manual_share, n_systems, count(*) OVER (PARTITION BY dominant_context, signature) AS c FROM ex JOIN manual USING (session_id, seg_no) JOIN touch USING (session_id, seg_no)) GROUP BY 1""",
    "ent": """
SELECT process_id, CASE WHEN count(*) > 1 THEN -sum(q * log2(q)) / log2(count(*)) ELSE 0 END AS norm_entropy, CASE WHEN count(*) > 1 THEN -sum(q * log2(q)) ELSE 0 END AS entropy
FROM (SELECT dominant_context AS process_id, signature, count(*) / sum(count(*)) OVER (PARTITION BY dominant_context) AS q FROM ex GROUP BY 1, 2) GROUP BY 1""",
    "norm": """
SELECT process_id, CASE WHEN hi1 = lo1 THEN .5 ELSE (freq - lo1) / (hi1 - lo1) END AS nf, CASE WHEN hi2 = lo2 THEN .5 ELSE (tm - lo2) / (hi2 - lo2) END AS nt, CASE WHEN hi3 = lo3 THEN .5 ELSE (manual_share - lo3) / (hi3 - lo3) END AS nm,
       CASE WHEN hi4 = lo4 THEN .5 ELSE (dominant_share - lo4) / (hi4 - lo4) END AS nd, CASE WHEN hi5 = lo5 THEN .5 ELSE (norm_entropy - lo5) / (hi5 - lo5) END AS ne, CASE WHEN hi6 = lo6 THEN .5 ELSE (surface - lo6) / (hi6 - lo6) END AS nsf,
       CASE WHEN hi7 = lo7 THEN .5 ELSE (systems - lo7) / (hi7 - lo7) END AS nc
FROM (SELECT *, max(freq) OVER () AS hi1, min(freq) OVER () AS lo1, max(tm) OVER () AS hi2, min(tm) OVER () AS lo2, max(manual_share) OVER () AS hi3, min(manual_share) OVER () AS lo3, max(dominant_share) OVER () AS hi4, min(dominant_share) OVER () AS lo4,
             max(norm_entropy) OVER () AS hi5, min(norm_entropy) OVER () AS lo5, max(surface) OVER () AS hi6, min(surface) OVER () AS lo6, max(systems) OVER () AS hi7, min(systems) OVER () AS lo7
      FROM (SELECT prof.*, norm_entropy, dominant_share * manual_share AS surface, n / sum(n) OVER () AS freq, total_ms / sum(total_ms) OVER () AS tm FROM prof JOIN ent USING (process_id)))""",
    "scored": """
SELECT process_id, round((nf + nt + nm) / 3, 9) AS impact, round((nd + (1 - ne) + nsf + (1 - nc)) / 4, 9) AS feasibility, round((nf + nt + nm) / 3, 9) * round((nd + (1 - ne) + nsf + (1 - nc)) / 4, 9) AS opportunity FROM norm""",
    "spans": """
SELECT session_id, seg_no, min(timestamp_ms) AS start_ms, max(timestamp_ms) AS end_ms FROM seg GROUP BY ALL""",
    "over": """
SELECT s.session_id, s.seg_no, g.case_id, least(s.end_ms, g.end_ms) - greatest(s.start_ms, g.start_ms) AS overlap_ms FROM spans s JOIN gt g ON s.session_id = g.session_id AND s.start_ms < g.end_ms AND g.start_ms < s.end_ms""",
    "cased": """
SELECT c.*, g.case_id, g.process_code FROM canon c LEFT JOIN gt g ON g.session_id = c.session_id AND g.start_ms <= c.timestamp_ms AND c.timestamp_ms <= g.end_ms""",
    "win": """
SELECT * FROM (SELECT session_id, idx, list_distinct(list(event_type) OVER b) AS tb, list_distinct(list(application) OVER b) AS ab, list_distinct(list(browser_domain) OVER b) AS db, lead(ta) OVER w AS ta, lead(aa) OVER w AS aa, lead(da) OVER w AS da, ni,
        timestamp_ms - first(timestamp_ms) OVER b AS duration_before, lead(dura) OVER w AS duration_after, max(has_extracted_text) OVER b AS text_before, lead(texta) OVER w AS text_after
  FROM (SELECT *, list_distinct(list(event_type) OVER a) AS ta, list_distinct(list(application) OVER a) AS aa, list_distinct(list(browser_domain) OVER a) AS da, lead(idx) OVER (PARTITION BY session_id ORDER BY idx) AS ni,
               last(timestamp_ms) OVER a - timestamp_ms AS dura, max(has_extracted_text) OVER a AS texta
        FROM canon WINDOW a AS (PARTITION BY session_id ORDER BY idx ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING))
  WINDOW b AS (PARTITION BY session_id ORDER BY idx ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), w AS (PARTITION BY session_id ORDER BY idx)) WHERE ni IS NOT NULL""",
    "traj": """
SELECT session_id, idx, len(list_intersect(tb, ta)) / nullif(len(list_distinct(list_concat(tb, ta))), 0) AS types_jaccard,
       len(list_intersect(list_filter(ab, lambda x: x IS NOT NULL), list_filter(aa, lambda x: x IS NOT NULL))) / nullif(len(list_distinct(list_concat(ab, aa))), 0) AS apps_jaccard,
       len(list_intersect(list_filter(db, lambda x: x IS NOT NULL), list_filter(da, lambda x: x IS NOT NULL))) / nullif(len(list_distinct(list_concat(db, da))), 0) AS domains_jaccard,
       duration_before, duration_after, text_before, text_after FROM win""",
}


def sql(body: str) -> str:
    """The body with the CTEs that it names, and those that they name, before it."""
    names = list(CTES)
    need: set[str] = set()

    def visit(text: str) -> None:
        for name in names:
            if name not in need and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", text):
                need.add(name)
                visit(CTES[name])

    visit(body)
    head = ",\n".join(f"{n} AS ({CTES[n].strip()})" for n in names if n in need)
    return f"WITH {head}\n{body.strip()}" if head else body.strip()
