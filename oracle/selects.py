"""The final select of each query's expected result."""

from __future__ import annotations

from failtriage.rules import DUPLICATE_THRESHOLD, LIST_KEYS, OPTIONAL_KEYS, REQUIRED_KEYS, TEAMS
from oracle.blocks import (
    BLOCKS, compose, holds_phrase, jac, like_column, like_glob, normalized, q, score, stamp, stripped, text_patterns, words,
)


def bar(lst: str) -> str:
    return f"array_to_string({lst}, '|')"


def hash_of(lst: str) -> str:
    """Hash from the size of a set and the sums of the four parts of the digests of its values."""
    distinct = f"list_distinct({lst})"

    def total(start: int) -> str:
        return f"CAST(list_sum(list_transform({distinct}, lambda v: CAST('0x' || substring(md5(v), {start}, 8) AS BIGINT))) AS BIGINT)"

    sums = ", ':', ".join(total(start) for start in (1, 9, 17, 25))
    return f"CASE WHEN len({lst}) = 0 THEN 'empty' ELSE md5(concat(len({distinct}), ':', {sums})) END"


def lowered(lst: str, expr: str) -> str:
    return f"list_transform({lst}, lambda v: lower({stripped(expr)}))"


BASE_NAME = "regexp_extract(v, '[^/]*$', 0)"

BLOCKS["row_hashes"] = f"""
    SELECT repo, job_id, {hash_of(lowered('error_patterns', normalized('v')))} AS error_hash,
           {hash_of(lowered('affected_files', BASE_NAME))} AS file_hash,
           {hash_of(lowered('[failure_type]', 'v'))} AS type_hash FROM failures"""


def group_hashes(failures: str) -> str:
    """Group signatures straight from the failures of a group."""
    return f"""
        SELECT repo, group_key, number, error_hash, file_hash, type_hash,
               sha256(concat_ws('|', error_hash, file_hash, type_hash)) AS signature
        FROM (SELECT repo, group_key, number, {hash_of(lowered('ps', normalized('v')))} AS error_hash,
                     {hash_of(lowered('fs', BASE_NAME))} AS file_hash, {hash_of(lowered('ts', 'v'))} AS type_hash
              FROM (SELECT repo, group_key, min(job_id) AS number, flatten(list(error_patterns)) AS ps,
                           flatten(list(affected_files)) AS fs, list(failure_type) AS ts
                    FROM {failures} GROUP BY repo, group_key) g) h"""


BLOCKS["all_hashes"] = group_hashes("failures")
BLOCKS["new_hashes"] = group_hashes("new_jobs")
BLOCKS["old_hashes"] = group_hashes("old_jobs")
BLOCKS["first_sig"] = """
    SELECT n.repo, n.number, n.signature,
           (SELECT min(o.number) FROM old_hashes o WHERE o.repo = n.repo AND o.signature = n.signature) AS p,
           (SELECT min(b.number) FROM new_hashes b WHERE b.repo = n.repo AND b.signature = n.signature AND b.number < n.number) AS b
    FROM new_hashes n"""
BLOCKS["identity"] = """
    SELECT run_id, url, CASE WHEN len(parts) >= 2 THEN parts[-2] END AS owner,
           CASE WHEN len(parts) >= 2 THEN regexp_replace(parts[-1], '\\.git$', '') END AS repo_name
    FROM (SELECT run_id, url, CASE
              WHEN starts_with(url, 'http') THEN list_slice(string_split(rtrim(url, '/'), '/'), 4, 99)
              WHEN starts_with(url, 'git@') THEN string_split(string_split(rtrim(url, '/'), ':')[2], '/')
              ELSE [] END AS parts FROM addresses) a"""
BLOCKS["turns"] = f"SELECT conv_id, turn, {words('text')} AS ws FROM conversations"
BLOCKS["keyed"] = (
    "SELECT o_orderkey, list_distinct([o_orderstatus, o_orderpriority, substring(o_orderpriority, 1, 1)]) AS ls FROM orders"
)
# Documents are compared only where their titles share a word, as the title part
# alone then decides that all other pairs stay below the threshold.
BLOCKS["d_feat"] = f"""
    SELECT repo, number, {words('title')} AS tw, {words('body')} AS bw, list_distinct(labels) AS ls, lower(title) AS lt,
           lower(body) AS lb, risk_level, failure_types FROM doc_issues"""
BLOCKS["d_scored"] = f"""
    SELECT repo, number, candidate, {score('t', 'l', 'r', 'b', 'y')} AS similarity
    FROM (SELECT n.repo, n.number, e.number AS candidate, {jac('n.tw', 'e.tw')} AS t, {jac('n.ls', 'e.ls')} AS l,
                 contains(e.lt, lower(n.risk_level)) OR contains(e.lb, lower(n.risk_level)) AS r,
                 {jac('n.bw', 'e.bw')} AS b,
                 len(list_filter(n.failure_types, lambda x: contains(e.lb, lower(x)))) > 0 AS y
          FROM d_feat n JOIN d_feat e ON e.repo = n.repo AND e.number < n.number
               AND len(list_intersect(n.tw, e.tw)) * 4 >= len(n.tw) + len(e.tw)) p"""

_verdict_rows = "SELECT n.*, v.is_duplicate, v.matched_number FROM new_issues n JOIN verdict v ON v.repo = n.repo AND v.number = n.number"


# A dry run over all failures against all issues on file.
for _name, _like, _from, _to in (
    ("dry_n", "n_feat", "new_issues", "all_issues"), ("dry_e", "e_feat", "on_file", "all_on_file"),
):
    BLOCKS[_name] = BLOCKS[_like].replace(f"FROM {_from}", f"FROM {_to}")
BLOCKS["dry_scored"] = BLOCKS["scored_all"].replace("FROM n_feat", "FROM dry_n").replace("JOIN e_feat", "JOIN dry_e")
BLOCKS["dry_best"] = BLOCKS["best"].replace("FROM scored_all", "FROM dry_scored")
BLOCKS["dry_verdict"] = (
    BLOCKS["verdict"].replace("FROM new_issues", "FROM all_issues").replace("JOIN best", "JOIN dry_best")
)


def oldest(scored: str, threshold: float = DUPLICATE_THRESHOLD) -> str:
    return f"""
        SELECT repo, number, candidate AS matched_number, similarity FROM (
            SELECT *, row_number() OVER (PARTITION BY repo, number ORDER BY candidate) AS rn
            FROM {scored} WHERE similarity >= {threshold}::DOUBLE) s WHERE rn = 1"""


_teams = " UNION ALL ".join(
    f"SELECT DISTINCT repo, group_key, {q(t.team)} AS team FROM vals WHERE kind = 'file' AND ("
    + " OR ".join(like_glob("value", g, any_case=False) for g in t.patterns) + ")"
    for t in TEAMS
)
_issue_cols = "repo, group_key, number"
_export = (
    "to_json({repository: repo, title: title, risk_level: risk_level, priority: priority, estimated_effort: estimated_effort,"
    " required_expertise: required_expertise, labels: labels, assignees: assignees, failure_count: failure_count})"
)

_stats = f"""SELECT f.repo, CAST({{requested}} AS BIGINT) AS runs_requested, runs_seen, total_failures,
        coalesce(failure_groups, 0) AS failure_groups, coalesce(issues_left, 0) AS issues_left
        FROM (SELECT repo, count(DISTINCT run_id) AS runs_seen, count(*) AS total_failures FROM new_jobs GROUP BY repo) f
        LEFT JOIN (SELECT repo, count(*) AS failure_groups FROM new_issues GROUP BY repo) g ON g.repo = f.repo
        LEFT JOIN (SELECT repo, count(*) AS issues_left FROM ({_verdict_rows}) r WHERE NOT is_duplicate GROUP BY repo) k
             ON k.repo = f.repo"""

SELECTS: dict[str, str] = {
    "recent_failed_runs": f"""SELECT repo, run_id, workflow_name, {stamp('created_at')} AS created_at, run_url FROM (
        SELECT *, row_number() OVER (PARTITION BY repo ORDER BY created_at DESC, run_id DESC) AS rn
        FROM runs WHERE status = 'failure') r WHERE rn <= 5""",
    "failed_jobs": """SELECT j.repo, j.run_id, j.job_id, j.job_name, r.workflow_name FROM jobs j
        JOIN runs r ON r.repo = j.repo AND r.run_id = j.run_id WHERE r.status = 'failure' AND j.conclusion = 'failure'""",
    "jobs_with_logs": """SELECT j.repo, j.job_id, length(l.logs) AS log_chars, md5(l.logs) AS log_md5 FROM jobs j
        JOIN logs l ON l.repo = j.repo AND l.job_id = j.job_id WHERE j.conclusion = 'failure'""",
    "jobs_without_logs": """SELECT repo, job_id, run_id FROM jobs j WHERE conclusion = 'failure'
        AND NOT EXISTS (SELECT 1 FROM logs l WHERE l.repo = j.repo AND l.job_id = j.job_id)""",
    "repo_identity": "SELECT run_id, owner, repo_name FROM identity WHERE owner IS NOT NULL",
    "repo_identity_rejects": "SELECT run_id, url FROM identity WHERE owner IS NULL",
    "open_issues": f"SELECT repo, number, title, {bar('labels')} AS labels FROM all_on_file WHERE state = 'open'",
    "error_patterns": f"SELECT repo, job_id, {bar('error_patterns')} AS patterns FROM parsed",
    "affected_files": f"SELECT repo, job_id, {bar('affected_files')} AS files FROM parsed",
    "failure_types": "SELECT repo, job_id, failure_type, group_key FROM parsed",
    "document_patterns": text_patterns("documents", "doc_id", "text"),
    "page_patterns": text_patterns("pages", "page_id", "html"),
    "failure_type_counts": f"""SELECT repo, failure_type, count(*) AS failure_count, {stamp('max(created_at)')} AS last_seen
        FROM failures GROUP BY repo, failure_type""",
    "failure_groups": f"""SELECT repo, group_key, failure_count, failure_type, {stamp('first_seen')} AS first_seen,
        {stamp('last_seen')} AS last_seen, first_job_id FROM grouped""",
    "group_values": "SELECT repo, group_key, kind, value, occurrences FROM vals",
    "group_context": f"""SELECT c.repo, c.group_key, type_count, pattern_count, file_count,
        {bar('top_patterns')} AS top_patterns, {bar('top_files')} AS top_files
        FROM (SELECT repo, group_key, count(*) FILTER (WHERE kind = 'type') AS type_count,
                     count(*) FILTER (WHERE kind = 'pattern') AS pattern_count,
                     count(*) FILTER (WHERE kind = 'file') AS file_count FROM vals GROUP BY repo, group_key) c
        LEFT JOIN shown s ON s.repo = c.repo AND s.group_key = c.group_key""",
    "group_recent_links": f"""SELECT g.repo, g.group_key, failure_count, {stamp('first_seen')} AS first_seen,
        {stamp('last_seen')} AS last_seen, {bar('links')} AS links, greatest(failure_count - 3, 0) AS more_links
        FROM grouped g JOIN links k ON k.repo = g.repo AND k.group_key = g.group_key""",
    "analysis_context": """SELECT g.repo, g.group_key, concat_ws(chr(10), concat('Repository: ', g.repo),
            concat('Failures: ', failure_count), concat('Kind: ', failure_type),
            CASE WHEN len(top_patterns) > 0 THEN concat('Errors: ', concat_ws('; ', array_to_string(top_patterns, '; '),
                CASE WHEN more_patterns > 0 THEN concat('and ', more_patterns, ' more') END)) END,
            CASE WHEN len(top_files) > 0 THEN concat('Files: ', concat_ws(', ', array_to_string(top_files, ', '),
                CASE WHEN more_files > 0 THEN concat('and ', more_files, ' more') END)) END,
            concat('Sample log:', chr(10), w.logs)) AS context
        FROM grouped g LEFT JOIN shown s ON s.repo = g.repo AND s.group_key = g.group_key
        JOIN (SELECT repo, group_key, job_id FROM (SELECT *, row_number() OVER (PARTITION BY repo, group_key
              ORDER BY created_at DESC, run_id DESC, job_id DESC) AS rn FROM failures) f WHERE rn = 1) l
        ON l.repo = g.repo AND l.group_key = g.group_key
        JOIN logs w ON w.repo = l.repo AND w.job_id = l.job_id""",
    "pattern_runs": "SELECT repo, failure_type, signature, run_id, count(*) AS occurrences FROM signed GROUP BY ALL",
    "pattern_rollup": f"""SELECT repo, failure_type, signature, count(*) AS occurrences, count(DISTINCT run_id) AS affected_runs,
        {stamp('min(created_at)')} AS first_seen, {stamp('max(created_at)')} AS last_seen
        FROM signed GROUP BY repo, failure_type, signature""",
    "text_jaccard_pairs": f"""SELECT a.conv_id, a.turn, {jac('a.ws', 'b.ws')} AS similarity
        FROM turns a JOIN turns b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1""",
    "label_jaccard_pairs": f"""SELECT a.o_orderkey, {jac('a.ls', 'b.ls')} AS similarity
        FROM keyed a JOIN keyed b ON b.o_orderkey = a.o_orderkey + 1""",
    "normalized_patterns": f"""SELECT repo, job_id, i - 1 AS line_no, {normalized('lines[i]')} AS normalized
        FROM (SELECT repo, job_id, lines, unnest(range(1, len(lines) + 1)) AS i
              FROM (SELECT repo, job_id, string_split(logs, chr(10)) AS lines FROM logs) s) l""",
    "issue_signatures": """SELECT *, substring(signature, 1, 16) AS short_signature
        FROM (SELECT *, sha256(concat_ws('|', error_hash, file_hash, type_hash)) AS signature FROM row_hashes) r""",
    "group_signatures": "SELECT repo, group_key, error_hash, file_hash, type_hash, signature, substring(signature, 1, 16) AS short_signature FROM all_hashes",
    "search_terms": """SELECT doc_id AS number, array_to_string(list_filter(regexp_extract_all(coalesce(text, ''), '[\\p{L}\\p{N}_]+(?:-[\\p{L}\\p{N}_]+)*', 0),
        lambda w: length(w) > 2 AND NOT regexp_full_match(w, '\\p{Nd}+')), ' ') AS terms FROM documents""",
    "exact_signature_dups": """SELECT repo, number, signature, coalesce(p, b) AS matched_number,
        CASE WHEN p IS NOT NULL THEN 'prior' ELSE 'batch' END AS scope FROM first_sig WHERE coalesce(p, b) IS NOT NULL""",
    "risk_overrides": "SELECT repo, group_key, override_pos::BIGINT AS override_pos, risk_level FROM assessed WHERE override_pos IS NOT NULL",
    "safe_score": "SELECT repo, group_key, safe_hits, pattern_count, file_count, safe_score FROM scores",
    "strategic_score": "SELECT repo, group_key, strategic_hits, phrase_count, strategic_score FROM scores",
    "tactical_hits": "SELECT repo, group_key, tactical_hits FROM scores",
    "risk_levels": "SELECT repo, group_key, risk_level, required_expertise, confidence FROM assessed",
    "blast_radius": "SELECT repo, group_key, blast_radius FROM assessed",
    "effort": "SELECT repo, group_key, risk_level, estimated_effort FROM assessed",
    "reasoning": "SELECT repo, group_key, reasoning FROM assessed",
    "team_routing": _teams,
    "repo_risk_overrides": f"""SELECT repo, group_key, min(pos)::BIGINT AS override_pos, arg_min(risk_level, pos) AS risk_level
        FROM (SELECT v.repo, v.group_key, r.pos, r.risk_level FROM vals v JOIN repo_rules r ON r.repo = v.repo
              WHERE v.kind = 'file' AND {like_column('v.value', 'r.pattern', any_case=True)}) h GROUP BY repo, group_key""",
    "repo_team_routing": f"""SELECT DISTINCT v.repo, v.group_key, r.team FROM vals v JOIN repo_rules r ON r.repo = v.repo
        WHERE v.kind = 'file' AND {like_column('v.value', 'r.pattern', any_case=False)}""",
    "fallback_issues": f"""SELECT repo, group_key, title, risk_level, priority::BIGINT AS priority, estimated_effort,
        required_expertise, {bar('labels')} AS labels FROM fallback""",
    "parsed_responses": "SELECT repo, group_key, "
    + ", ".join(f"{k}::BIGINT AS {k}" if k == "priority" else k for k in REQUIRED_KEYS + OPTIONAL_KEYS)
    + "".join(f", {bar(k)} AS {k}" for k in LIST_KEYS)
    + " FROM answers WHERE valid",
    "issue_files": "SELECT DISTINCT repo, group_key, unnest(related_files) AS file FROM answers WHERE valid",
    "rejected_responses": "SELECT repo, group_key, response, reason FROM answers WHERE NOT valid",
    "unused_responses": "SELECT repo, group_key, title, priority::BIGINT AS priority, estimated_effort FROM ranked_answers WHERE rn > 1",
    "response_issues": f"""SELECT {_issue_cols}, title, risk_level, priority::BIGINT AS priority, estimated_effort,
        required_expertise FROM all_issues""",
    "issue_overrides": f"""SELECT i.repo, i.group_key, o.override_pos::BIGINT AS override_pos, i.risk_level, title,
        {bar('labels')} AS labels, {bar('assignees')} AS assignees
        FROM all_issues i JOIN all_over o ON o.repo = i.repo AND o.group_key = i.group_key""",
    "issue_bodies": "SELECT repo, group_key, body FROM all_issues",
    "issue_labels": f"SELECT repo, group_key, {bar('labels')} AS labels FROM all_issues",
    "issue_assignees": f"SELECT repo, group_key, {bar('assignees')} AS assignees FROM all_issues",
    "focus_filter": "SELECT repo, number, title FROM all_issues WHERE risk_level = 'strategic'",
    "priority_filter": "SELECT repo, number, priority::BIGINT AS priority FROM all_issues WHERE priority >= 60",
    "risk_summary": """SELECT repo, count(*) FILTER (WHERE risk_level = 'safe') AS safe,
        count(*) FILTER (WHERE risk_level = 'tactical') AS tactical,
        count(*) FILTER (WHERE risk_level = 'strategic') AS strategic FROM all_issues GROUP BY repo""",
    "json_export": f"SELECT repo, group_key, {_export}::VARCHAR AS issue_json FROM all_issues",
    "candidates": "SELECT repo, number, candidate, search_rank::BIGINT AS search_rank, place FROM cands",
    "phrase_candidates": f"""SELECT DISTINCT n.repo, n.phrase, e.number AS candidate
        FROM n_phrase n JOIN e_phrase e ON e.repo = n.repo WHERE {holds_phrase}""",
    "candidate_scores": """SELECT repo, number, candidate, title_similarity, label_similarity, risk_match,
        body_similarity, type_match, similarity FROM scored""",
    "best_match": "SELECT repo, number, matched_number, similarity, oldest_number FROM best",
    "duplicate_verdicts": "SELECT repo, number, is_duplicate, matched_number, similarity, reason, oldest_number FROM verdict",
    "new_issues": f"SELECT repo, number, title FROM ({_verdict_rows}) r WHERE NOT is_duplicate",
    "recurrence_notes": f"""SELECT repo, number, matched_number,
        concat('Seen again: ', title, ' (', failure_count, ' failures)') AS comment FROM ({_verdict_rows}) r WHERE is_duplicate""",
    "create_actions": f"""SELECT repo, number, title, body, {bar('labels')} AS labels, {bar('assignees')} AS assignees
        FROM ({_verdict_rows}) r WHERE NOT is_duplicate""",
    "comment_actions": f"""SELECT repo, matched_number,
        concat('Seen again: ', title, ' (', failure_count, ' failures)') AS comment FROM ({_verdict_rows}) r WHERE is_duplicate""",
    "emitted_actions": f"""SELECT sha256(concat_ws(chr(31), kind, repo, number, coalesce(matched_number::VARCHAR, ''))) AS action_id,
        kind, repo, number, matched_number, title, batch FROM (
            SELECT 'create' AS kind, repo, number, CAST(NULL AS BIGINT) AS matched_number, title, 'all' AS batch
            FROM ({_verdict_rows}) r WHERE NOT is_duplicate
            UNION ALL SELECT 'comment', repo, number, matched_number, NULL, 'notes' FROM ({_verdict_rows}) r WHERE is_duplicate) a""",
    "triage_stats": _stats.replace("{requested}", "NULL"),
    "json_stats": f"""SELECT repo, to_json({{repository: repo, stats: {{runs_requested: runs_requested, runs_seen: runs_seen,
        total_failures: total_failures, failure_groups: failure_groups, issues_left: issues_left}}}})::VARCHAR AS stats_json
        FROM ({_stats.replace("{requested}", "5")}) s""",
    "dry_run": """SELECT n.repo, n.number, n.title FROM all_issues n JOIN dry_verdict v ON v.repo = n.repo AND v.number = n.number
        WHERE n.priority >= 60 AND NOT v.is_duplicate""",
    "near_duplicates": oldest("scored_all"),
    "near_duplicates_half": oldest("scored_all", 0.5),
    "near_duplicate_documents": oldest("d_scored"),
}


def oracle() -> dict[str, str]:
    return {name: compose(sql) for name, sql in SELECTS.items()}
