"""The expected results as DuckDB SQL: named blocks, put together per query.

Rule tables are inputs, so they are shared with the library; everything computed
from them is written here independently.
"""

from __future__ import annotations

import re

from failtriage import rules as R
from failtriage.sources import derived

LEGAL = "[ \\t\\n\\r\\x0b\\f]"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def re2(pattern: str) -> str:
    return pattern.replace(rf"(?:(?<!{R.PATH_CHARS})|\G)", "")


def match_list(text: str, rule: R.ExtractRule, flags: str) -> str:
    pattern = q(flags + re2(rule.pattern))
    if rule.groups <= 1:
        return f"regexp_extract_all({text}, {pattern}, {rule.groups})"
    a, b = (f"regexp_extract_all({text}, {pattern}, {g})" for g in (1, 2))
    return f"list_transform(range(1, len({a}) + 1), lambda i: concat('(''', {a}[i], ''', ''', {b}[i], ''')'))"


def all_matches(text: str, rule_list, flags: str) -> str:
    return "list_concat(" + ", ".join(match_list(text, r, flags) for r in rule_list) + ")"


def first_kept(lst: str) -> str:
    return f"list_filter({lst}, lambda x, i: list_position({lst}, x) = i)"


def any_contains(text: str, phrases) -> str:
    return "(" + " OR ".join(f"contains({text}, {q(p)})" for p in phrases) + ")"


def any_match(text: str, patterns, flags: str = "(?i)") -> str:
    return "regexp_matches(" + text + ", " + q(flags + "|".join(f"(?:{p})" for p in patterns)) + ")"


def found(text: str, family) -> str:
    """Phrases in and patterns on a text, as a list."""
    parts = [f"CASE WHEN contains({text}, {q(p)}) THEN {q(p)} END" for p in family.log_phrases]
    parts += [f"CASE WHEN regexp_matches({text}, {q(p)}) THEN {q(p)} END" for p in family.log_patterns]
    return f"list_filter([{', '.join(parts)}], lambda x: x IS NOT NULL)"


def like_glob(path: str, glob: str, *, any_case: bool) -> str:
    """An unanchored glob as LIKE: a star is any text."""
    op = "ILIKE" if any_case else "LIKE"
    pattern = glob.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_").replace("*", "%")
    return f"{path} {op} {q('%' + pattern + '%')} ESCAPE '\\'"


def like_column(path: str, glob: str, *, any_case: bool) -> str:
    """The same for a column of globs."""
    escaped = f"replace(replace(replace(replace({glob}, '\\', '\\\\'), '%', '\\%'), '_', '\\_'), '*', '%')"
    return f"{path} {'ILIKE' if any_case else 'LIKE'} concat('%', {escaped}, '%') ESCAPE '\\'"


def stamp(col: str, fmt: str = "%Y-%m-%d %H:%M:%S.%f") -> str:
    return f"strftime({col}, '{fmt}')"


def type_case(low: str, rules=R.TYPE_RULES) -> str:
    whens = " ".join(f"WHEN {any_contains(low, t.phrases)} THEN {q(t.failure_type)}" for t in rules)
    return f"CASE {whens} ELSE {q(R.UNKNOWN)} END"


def normalized(p: str) -> str:
    for part, mask in R.VARIABLE_PARTS:
        p = f"regexp_replace({p}, {q(part)}, {q(mask)}, 'g')"
    return p


def stripped(p: str) -> str:
    return f"regexp_replace({p}, '^\\s+|\\s+$', '', 'g')"


def words(text: str) -> str:
    stop = "[" + ", ".join(q(w) for w in R.STOP_WORDS) + "]"
    found = f"list_distinct(regexp_extract_all(lower(coalesce({text}, '')), '[\\p{{L}}\\p{{N}}_]+', 0))"
    return f"list_filter({found}, lambda w: NOT list_contains({stop}, w))"


def jac(a: str, b: str) -> str:
    both = f"len(list_intersect({a}, {b}))::DOUBLE"
    return (
        f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0::DOUBLE "
        f"ELSE {both} / (len({a})::DOUBLE + len({b})::DOUBLE - {both}) END"
    )


def score(t: str, l: str, r: str, b: str, y: str) -> str:
    w = R.WEIGHTS
    d = lambda x: f"{x}::DOUBLE"
    return (
        f"least({t} * {d(w.title)} + {l} * {d(w.labels)} + CASE WHEN {r} THEN {d(w.risk)} ELSE 0.0::DOUBLE END"
        f" + {b} * {d(w.body)} + CASE WHEN {y} THEN {d(w.failure_type)} ELSE 0.0::DOUBLE END, 1.0::DOUBLE)"
    )


def tag(level: str) -> str:
    whens = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in R.RISK_TAGS.items())
    return f"CASE {level} {whens} ELSE {q(R.DEFAULT_TAG)} END"


def template(attr: str) -> str:
    def lit(v):
        return str(v) if isinstance(v, int) else q(v)

    whens = " ".join(f"WHEN {q(k)} THEN {lit(getattr(t, attr))}" for k, t in R.TEMPLATES.items())
    return f"CASE failure_type {whens} ELSE {lit(getattr(R.DEFAULT_TEMPLATE, attr))} END"


def two_decimals(v: str) -> str:
    c = f"CAST(floor({v} * 100.0::DOUBLE + 0.5::DOUBLE) AS BIGINT)"
    return f"concat({c} // 100, '.', lpad(CAST({c} % 100 AS VARCHAR), 2, '0'))"


def section(heading: str, text: str) -> str:
    return f"CASE WHEN coalesce({text}, '') <> '' THEN concat(chr(10), '## {heading}', chr(10), {text}) END"


def bullets(lst: str) -> str:
    return f"array_to_string(list_transform({lst}, lambda x: concat('- ', x)), chr(10))"


def and_more(text: str, more: str, glue: str) -> str:
    return f"concat_ws({glue}, {text}, CASE WHEN {more} > 0 THEN concat('and ', {more}, ' more') END)"


def cleaned(text: str) -> str:
    """Words worth searching for, lower-cased, as one text."""
    found = f"regexp_extract_all(coalesce({text}, ''), '[\\p{{L}}\\p{{N}}_]+(?:-[\\p{{L}}\\p{{N}}_]+)*', 0)"
    return f"lower(array_to_string(list_filter({found}, lambda w: length(w) >= 3 AND NOT regexp_full_match(w, '\\p{{Nd}}+')), ' '))"


holds_phrase = """length(n.phrase) > 3 AND (contains(e.in_title, concat(' ', n.phrase, ' ')) OR contains(e.in_body, concat(' ', n.phrase, ' ')))"""
_files = all_matches("logs", R.FILE_RULES, "")
_errors = all_matches("logs", R.ERROR_RULES, "(?i)")
_value_file, _value_pattern = "kind = 'file'", "kind = 'pattern'"


def _hits(family) -> str:
    return (
        f"count(*) FILTER (WHERE ({_value_pattern} AND {any_match('value', family.error_patterns)})"
        f" OR ({_value_file} AND {any_match('value', family.file_patterns)}))"
    )


_override = "CASE " + " ".join(
    f"WHEN {like_glob('value', o.pattern, any_case=True)} THEN {i}" for i, o in enumerate(R.OVERRIDES)
) + " END"
_override_level = "CASE override_pos " + " ".join(
    f"WHEN {i} THEN {q(o.risk_level)}" for i, o in enumerate(R.OVERRIDES)
) + " END"

BLOCKS: dict[str, str] = {
    "jobs": derived.JOBS_SQL.replace("{events}", "events"),
    "runs": derived.RUNS_SQL.replace("{orders}", "orders"),
    "logs": derived.LOGS_SQL.replace("{events}", "events"),
    "repo_rules": derived.RULES_SQL.replace("{customer}", "customer"),
    "addresses": derived.ADDRESSES_SQL.replace("{orders}", "orders"),
    "parsed": f"""
        SELECT repo, job_id, error_patterns, affected_files, failure_type, commands, phrases,
               concat_ws('|', failure_type, error_patterns[1], affected_files[1]) AS group_key
        FROM (SELECT repo, job_id,
                     {first_kept('errs')} AS error_patterns,
                     list_filter({first_kept('paths')}, lambda p: NOT {any_contains('p', R.FILE_NOISE)}
                         AND NOT regexp_full_match(p, '[0-9]{{1,3}}(\\.[0-9]{{1,3}}){{3}}')) AS affected_files,
                     {type_case('low')} AS failure_type,
                     {found('low', R.SAFE_RULES)} AS commands,
                     {found('low', R.STRATEGIC_RULES)} AS phrases
              FROM (SELECT repo, job_id, logs, lower(logs) AS low, {_errors} AS errs, {_files} AS paths FROM logs) l) p""",
    "failures": """
        SELECT j.repo, j.run_id, j.job_id, j.job_name, j.created_at, r.workflow_name, r.run_url,
               p.error_patterns, p.affected_files, p.failure_type, p.commands, p.phrases, p.group_key
        FROM jobs j JOIN runs r ON r.repo = j.repo AND r.run_id = j.run_id
        JOIN parsed p ON p.repo = j.repo AND p.job_id = j.job_id WHERE j.conclusion = 'failure'""",
    "vals": """
        SELECT repo, group_key, kind, value, count(*) AS occurrences FROM (
            SELECT repo, group_key, 'type' AS kind, failure_type AS value FROM failures
            UNION ALL SELECT repo, group_key, 'pattern', unnest(error_patterns) FROM failures
            UNION ALL SELECT repo, group_key, 'file', unnest(affected_files) FROM failures
            UNION ALL SELECT repo, group_key, 'command', unnest(commands) FROM failures
            UNION ALL SELECT repo, group_key, 'phrase', unnest(phrases) FROM failures) v
        GROUP BY ALL""",
    "grouped": """
        SELECT repo, group_key, count(*) AS failure_count, min(failure_type) AS failure_type,
               min(created_at) AS first_seen, max(created_at) AS last_seen, min(job_id) AS first_job_id
        FROM failures GROUP BY repo, group_key""",
    "ranked": "SELECT *, row_number() OVER (PARTITION BY repo, group_key, kind ORDER BY occurrences DESC, value) AS rn FROM vals",
    "shown": """
        SELECT repo, group_key,
               coalesce(list(value ORDER BY rn) FILTER (WHERE kind = 'pattern' AND rn <= 5), []) AS top_patterns,
               coalesce(list(value ORDER BY rn) FILTER (WHERE kind = 'file' AND rn <= 10), []) AS top_files,
               greatest(count(*) FILTER (WHERE kind = 'pattern') - 5, 0) AS more_patterns,
               greatest(count(*) FILTER (WHERE kind = 'file') - 10, 0) AS more_files
        FROM ranked WHERE kind IN ('pattern', 'file') GROUP BY repo, group_key""",
    "links": """
        SELECT repo, group_key, list(run_url ORDER BY rn) AS links,
               list(concat(workflow_name, ' / ', job_name, ': ', run_url) ORDER BY rn) AS named_links FROM (
            SELECT *, row_number() OVER (PARTITION BY repo, group_key ORDER BY created_at DESC, run_id DESC, job_id) AS rn
            FROM failures) f WHERE rn <= 3 GROUP BY repo, group_key""",
    "signed": f"""
        SELECT repo, failure_type, run_id, created_at, lower({stripped(normalized('p'))}) AS signature
        FROM (SELECT *, unnest(error_patterns) AS p FROM failures) f""",
    "hits": f"""
        SELECT repo, group_key,
               count(*) FILTER (WHERE {_value_pattern}) AS pattern_count,
               count(*) FILTER (WHERE {_value_file}) AS file_count,
               {_hits(R.SAFE_RULES)} AS safe_hits, {_hits(R.STRATEGIC_RULES)} AS strategic_hits,
               {_hits(R.TACTICAL_RULES)} AS tactical_hits,
               count(*) FILTER (WHERE {_value_pattern} AND {any_contains('lower(value)', R.AUTOFIX_PHRASES)}) > 0 AS autofix,
               count(*) FILTER (WHERE {_value_file} AND {any_match('value', R.STRATEGIC_RULES.file_patterns, '')}) AS critical_files,
               count(*) FILTER (WHERE kind = 'command') AS command_count, count(*) FILTER (WHERE kind = 'phrase') AS phrase_count,
               count(*) FILTER (WHERE {_value_file} AND {any_match('value', [R.DOCUMENT_FILES])}) AS document_files,
               list_filter([{', '.join(f"CASE WHEN count(*) FILTER (WHERE {_value_file} AND {any_match('value', [p])}) > 0 THEN {q(n)} END" for n, p in R.BLAST_FAMILIES)}],
                   lambda x: x IS NOT NULL) AS blast,
               min(CASE WHEN {_value_file} THEN {_override} END) AS override_pos
        FROM vals GROUP BY repo, group_key""",
    "scores": """
        SELECT h.*,
               (safe_hits + CASE WHEN command_count > 0 THEN 1 ELSE 0 END)::DOUBLE
                   / (pattern_count + file_count + 1)::DOUBLE AS safe_score,
               (strategic_hits::DOUBLE * 2.0::DOUBLE + phrase_count::DOUBLE * 0.5::DOUBLE)
                   / ((pattern_count + file_count)::DOUBLE * 2.0::DOUBLE + 1.0::DOUBLE) AS strategic_score
        FROM hits h""",
    "leveled": f"""
        SELECT *, CASE WHEN strategic_score > {R.STRATEGIC_THRESHOLD}::DOUBLE THEN 'strategic'
                       WHEN safe_score > {R.SAFE_THRESHOLD}::DOUBLE THEN 'safe' ELSE 'tactical' END AS scored
        FROM scores""",
    "assessed": f"""
        SELECT repo, group_key, safe_score, strategic_score, tactical_hits, override_pos,
               coalesce({_override_level}, scored) AS risk_level,
               CASE WHEN override_pos IS NOT NULL THEN 1.0::DOUBLE WHEN scored = 'strategic' THEN least(strategic_score, 0.9::DOUBLE)
                    WHEN scored = 'safe' THEN safe_score ELSE 0.6::DOUBLE END AS confidence,
               CASE WHEN override_pos IS NOT NULL THEN 'configured'
                    ELSE CASE scored WHEN 'strategic' THEN 'senior' WHEN 'safe' THEN 'junior' ELSE 'mid' END END AS required_expertise,
               CASE WHEN override_pos IS NOT NULL THEN 'configured'
                    WHEN scored <> 'strategic' THEN CASE scored {' '.join(f"WHEN {q(k)} THEN {q(v)}" for k, v in R.LEVEL_BLAST.items())} END
                    WHEN len(blast) = 0 THEN {q(R.DEFAULT_BLAST)}
                    ELSE array_to_string(blast, '; ') END AS blast_radius,
               CASE WHEN override_pos IS NOT NULL THEN 'configured'
                    WHEN scored = 'strategic' THEN CASE WHEN strategic_score > 0.8::DOUBLE THEN '1 to 2 weeks'
                        WHEN strategic_score > 0.5::DOUBLE THEN '3 to 5 days' ELSE '1 to 3 days' END
                    WHEN scored = 'safe' THEN CASE WHEN autofix THEN 'under 30 minutes' ELSE '1 to 2 hours' END
                    ELSE '4 to 8 hours' END AS estimated_effort,
               CASE WHEN override_pos IS NOT NULL THEN 'configured override'
                    WHEN scored = 'strategic' THEN concat_ws('; ', concat('strategic score ', {two_decimals('strategic_score')}),
                        CASE WHEN critical_files > 0 THEN concat('critical files: ', critical_files) END,
                        {', '.join(f"CASE WHEN list_contains(blast, {q(n)}) THEN {q('touches ' + n)} END" for n in R.NAMED_FAMILIES)},
                        CASE WHEN phrase_count > 0 THEN 'the log names sensitive areas' END)
                    WHEN scored = 'safe' THEN concat_ws('; ', concat('safe score ', {two_decimals('safe_score')}),
                        CASE WHEN autofix THEN 'a tool can fix it' END,
                        CASE WHEN file_count > 0 AND document_files = file_count THEN 'only documentation is affected' END)
                    ELSE concat_ws('; ', 'neither clearly safe nor strategic',
                        CASE WHEN tactical_hits > 0 THEN concat('tactical hits: ', tactical_hits) END,
                        CASE WHEN strategic_score > {R.RAISED_SCORE}::DOUBLE
                             THEN concat('raised strategic score ', {two_decimals('strategic_score')}) END) END AS reasoning
        FROM leveled""",
    "fallback": f"""
        SELECT *, concat_ws(' ', {tag('risk_level')}, raw_title) AS title,
               [{q(R.BASE_LABEL)}, concat('risk:', risk_level), concat('type:', failure_type)] AS labels
        FROM (SELECT *, {template('title')} AS raw_title, {template('risk_level')} AS risk_level,
                     {template('priority')} AS priority, {template('estimated_effort')} AS estimated_effort,
                     'mid' AS required_expertise FROM grouped) g""",
    "new_jobs": f"SELECT * FROM failures WHERE created_at >= TIMESTAMP '{derived.CUTOFF}'",
    "old_jobs": f"SELECT * FROM failures WHERE created_at < TIMESTAMP '{derived.CUTOFF}'",
    "e_feat": f"""
        SELECT repo, number, {words('title')} AS tw, {words('body')} AS bw, list_distinct(labels) AS ls,
               lower(title) AS lt, lower(coalesce(body, '')) AS lb FROM on_file WHERE state = 'open'""",
    "n_feat": f"""
        SELECT repo, number, {words('title')} AS tw, {words('body')} AS bw, list_distinct(labels) AS ls,
               risk_level, failure_types FROM new_issues""",
    "scored_all": f"""
        SELECT repo, number, candidate, t AS title_similarity, l AS label_similarity, r AS risk_match,
               b AS body_similarity, y AS type_match, {score('t', 'l', 'r', 'b', 'y')} AS similarity
        FROM (SELECT n.repo, n.number, e.number AS candidate, {jac('n.tw', 'e.tw')} AS t, {jac('n.ls', 'e.ls')} AS l,
                     contains(e.lt, lower(n.risk_level)) OR contains(e.lb, lower(n.risk_level)) AS r,
                     {jac('n.bw', 'e.bw')} AS b,
                     len(list_filter(n.failure_types, lambda x: contains(e.lb, lower(x)))) > 0 AS y
              FROM n_feat n JOIN e_feat e ON e.repo = n.repo) p""",
    "n_phrase": f"""
        SELECT repo, number, risk_level, failure_types, {cleaned('first_pattern')} AS phrase FROM new_issues""",
    "e_phrase": f"""
        SELECT repo, number, labels, title, concat(' ', {cleaned('title')}, ' ') AS in_title, concat(' ', {cleaned('body')}, ' ') AS in_body
        FROM on_file WHERE state = 'open'""",
    "found": f"""
        SELECT n.repo, n.number, e.number AS candidate,
               CASE WHEN list_contains(e.labels, concat('risk:', n.risk_level)) THEN 0
                    WHEN list_contains(e.labels, {q(R.BASE_LABEL)}) THEN 1
                    WHEN contains(lower(e.title), {q(R.TITLE_PHRASE.lower())}) THEN 2
                    WHEN {holds_phrase} THEN 3
                    WHEN list_contains(e.labels, concat('type:', n.failure_types[1])) THEN 4 END AS search_rank
        FROM n_phrase n JOIN e_phrase e ON e.repo = n.repo""",
    "cands": f"""
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo, number ORDER BY search_rank, candidate DESC) AS place
                       FROM found WHERE search_rank IS NOT NULL) f WHERE place <= {R.CANDIDATE_CAP}""",
    "scored": """
        SELECT c.search_rank, c.place, s.* FROM cands c
        JOIN scored_all s ON s.repo = c.repo AND s.number = c.number AND s.candidate = c.candidate""",
    "best": f"""
        SELECT repo, number, candidate AS matched_number, similarity, oldest_number FROM (
            SELECT *, row_number() OVER (PARTITION BY repo, number ORDER BY similarity DESC, candidate DESC) AS rn,
                   min(candidate) OVER (PARTITION BY repo, number) AS oldest_number
            FROM scored_all WHERE similarity >= {R.DUPLICATE_THRESHOLD}::DOUBLE) s WHERE rn = 1""",
    "verdict": f"""
        SELECT n.repo, n.number, matched_number IS NOT NULL AS is_duplicate, matched_number,
               coalesce(similarity, 0.0::DOUBLE) AS similarity,
               CASE WHEN matched_number IS NULL THEN 'no issue on file is similar enough'
                    WHEN similarity >= {R.EXACT_THRESHOLD}::DOUBLE THEN 'same problem as an issue on file'
                    ELSE 'very similar to an issue on file' END AS reason, oldest_number
        FROM new_issues n LEFT JOIN best b ON b.repo = n.repo AND b.number = n.number""",
    "doc_issues": f"SELECT *, [lang, source] AS labels, [failure_type] AS failure_types FROM ("
    + derived.DOC_ISSUES_SQL.replace("{documents}", "documents")
    + ") d",
}

_as_number = "floor(TRY_CAST(json_extract_string(j, '$.priority') AS DOUBLE) + 0.5)"


def _member(key: str) -> str:
    if key == "priority":
        return f"TRY_CAST({_as_number} AS INTEGER)"
    if key in R.LIST_KEYS:
        return (
            f"CASE json_type(json_extract(j, '$.{key}')) WHEN 'ARRAY' THEN CAST(json_extract(j, '$.{key}') AS VARCHAR[])"
            f" WHEN 'NULL' THEN NULL ELSE CASE WHEN json_extract(j, '$.{key}') IS NOT NULL"
            f" THEN [json_extract_string(j, '$.{key}')] END END"
        )
    return f"json_extract_string(j, '$.{key}')"


_keys = ", ".join(f"{_member(k)} AS {k}" for k in R.REQUIRED_KEYS + R.OPTIONAL_KEYS + R.LIST_KEYS)
_missing = "CASE " + " ".join(f"WHEN {k} IS NULL THEN {q(k)}" for k in R.REQUIRED_KEYS) + " END"
_order = ", ".join(f"{k} NULLS FIRST" for k in R.REQUIRED_KEYS + R.OPTIONAL_KEYS + R.LIST_KEYS)
# Depth of braces over the pieces of a text, as a fold.
_scan = r"""list_reduce(list_prepend(
    {t: '', pos: 1, depth: 0, quoted: false, start: 0, spans: []::STRUCT(s INTEGER, n INTEGER)[]},
    list_transform(regexp_extract_all(response, '(?s)\\.|["{}]|[^\\"{}]+|\\', 0),
        lambda t: {t: t, pos: 0, depth: 0, quoted: false, start: 0, spans: []::STRUCT(s INTEGER, n INTEGER)[]})),
    lambda a, b: {t: b.t, pos: a.pos + length(b.t)::INTEGER,
        depth: CASE WHEN a.quoted THEN a.depth WHEN b.t = '{' THEN a.depth + 1 WHEN b.t = '}' AND a.depth > 0 THEN a.depth - 1 ELSE a.depth END,
        quoted: CASE WHEN b.t = '"' AND a.depth > 0 THEN NOT a.quoted ELSE a.quoted END,
        start: CASE WHEN NOT a.quoted AND b.t = '{' AND a.depth = 0 THEN a.pos ELSE a.start END,
        spans: CASE WHEN NOT a.quoted AND b.t = '}' AND a.depth = 1 THEN list_append(a.spans, {s: a.start, n: a.pos - a.start + 1}) ELSE a.spans END})"""


def response_blocks(prefix: str, groups: str) -> dict[str, str]:
    """Responses to the groups in block ``groups`` and what is read from them."""
    return {
        f"{prefix}responses": "SELECT row_number() OVER () AS rid, * FROM (" + derived.RESPONSES_SQL.replace("{groups}", groups) + ") r",
        f"{prefix}spans": rf"""
            SELECT rid, repo, group_key, response, i, texts[i] AS span FROM (
                SELECT *, unnest(range(1, len(texts) + 1)) AS i FROM (
                    SELECT *, list_concat(list_transform(f.spans, lambda x: substring(response, x.s, x.n)),
                                          [regexp_extract(response, '(?s)\{{.*\}}', 0)]) AS texts
                    FROM (SELECT *, {_scan} AS f FROM {prefix}responses) s) t) u WHERE texts[i] <> ''""",
        f"{prefix}objects": f"""
            SELECT *, {_missing} AS missing FROM (SELECT rid, i, {_keys} FROM (
                SELECT rid, i, TRY_CAST(span AS JSON) AS j FROM {prefix}spans) s WHERE json_type(j) = 'OBJECT') o""",
        f"{prefix}answers": f"""
            SELECT r.repo, r.group_key, r.response, o.* EXCLUDE (rid, i, missing), o.rid IS NOT NULL AS valid,
                   CASE WHEN o.rid IS NOT NULL THEN NULL
                        WHEN NOT EXISTS (SELECT 1 FROM {prefix}spans s WHERE s.rid = r.rid) THEN 'no object'
                        WHEN NOT EXISTS (SELECT 1 FROM {prefix}objects s WHERE s.rid = r.rid) THEN 'no readable object'
                        ELSE concat('no usable ', (SELECT arg_min(s.missing, s.i) FROM {prefix}objects s WHERE s.rid = r.rid)) END AS reason
            FROM {prefix}responses r LEFT JOIN (
                SELECT * FROM {prefix}objects WHERE missing IS NULL
                QUALIFY row_number() OVER (PARTITION BY rid ORDER BY i) = 1) o ON o.rid = r.rid""",
        f"{prefix}ranked_answers": f"""
            SELECT *, row_number() OVER (PARTITION BY repo, group_key ORDER BY {_order}) AS rn
            FROM (SELECT DISTINCT * EXCLUDE (response, valid, reason) FROM {prefix}answers WHERE valid) a""",
    }


def issue_blocks(prefix: str, failures: str) -> dict[str, str]:
    """The chain from the failures in block ``failures`` to issues, with response fields where valid."""
    renamed = {n: prefix + n for n in ("vals", "grouped", "ranked", "shown", "links", "fallback")}

    def rename(sql: str) -> str:
        sql = re.sub(r"\bfailures\b", failures, sql)
        for old, new in renamed.items():
            sql = re.sub(rf"\b(FROM|JOIN) {old}\b", rf"\1 {new}", sql)
        return sql

    out = {renamed[n]: rename(BLOCKS[n]) for n in renamed}
    out.update(response_blocks(prefix, f"{prefix}grouped"))
    fields = ("priority", "estimated_effort", "required_expertise", "risk_level")
    picked = ", ".join(f"CASE WHEN a.repo IS NOT NULL THEN a.{f} ELSE f.{f} END AS {f}" for f in fields)
    bucket = "CASE WHEN a.priority >= 80 THEN 'high' WHEN a.priority >= 50 THEN 'medium' ELSE 'low' END"
    out[f"{prefix}over"] = f"""
        SELECT repo, group_key, override_pos, {_override_level} AS level FROM (
            SELECT repo, group_key, min(CASE WHEN {_value_file} THEN {_override} END) AS override_pos
            FROM {prefix}vals GROUP BY repo, group_key) o WHERE override_pos IS NOT NULL"""
    out[f"{prefix}scored_fields"] = f"""
        SELECT f.repo, f.group_key, f.failure_count, f.failure_type, f.first_seen, f.last_seen, f.first_job_id, {picked},
               CASE WHEN a.repo IS NOT NULL THEN concat_ws(' ', {tag('a.risk_level')}, a.title) ELSE f.title END AS title,
               CASE WHEN a.repo IS NOT NULL THEN list_filter([{q(R.BASE_LABEL)}, concat('risk:', a.risk_level),
                        concat('type:', f.failure_type), concat('priority:', {bucket}),
                        CASE WHEN a.risk_level = 'safe' THEN {q(R.NEWCOMER_LABEL)} END], lambda x: x IS NOT NULL)
                    ELSE f.labels END AS labels,
               a.risk_reason, a.root_cause, a.impact, a.suggested_fix, a.verification, a.prevention, a.commands, a.related_files
        FROM {prefix}fallback f LEFT JOIN (SELECT * FROM {prefix}ranked_answers WHERE rn = 1) a
             ON a.repo = f.repo AND a.group_key = f.group_key"""
    out[f"{prefix}fields"] = f"""
        SELECT f.* EXCLUDE (risk_level, title, labels, risk_reason), coalesce(o.level, f.risk_level) AS risk_level,
               CASE WHEN o.level IS NULL THEN f.risk_reason ELSE 'configured for its files' END AS risk_reason,
               CASE WHEN o.level IS NULL THEN f.title
                    ELSE concat_ws(' ', {tag('o.level')}, regexp_replace(f.title, '^\\[[A-Z]+\\] ', '')) END AS title,
               CASE WHEN o.level IS NULL THEN f.labels
                    ELSE list_transform(list_filter(f.labels, lambda x: x <> {q(R.NEWCOMER_LABEL)} OR o.level = 'safe'),
                        lambda x: CASE WHEN starts_with(x, 'risk:') THEN concat('risk:', o.level) ELSE x END) END AS labels
        FROM {prefix}scored_fields f LEFT JOIN {prefix}over o ON o.repo = f.repo AND o.group_key = f.group_key"""
    stamp_s = "%Y-%m-%d %H:%M:%S"
    out[f"{prefix}issues"] = f"""
        SELECT f.repo, f.group_key, first_job_id AS number, title, risk_level, priority, estimated_effort,
               required_expertise, labels, failure_count, [failure_type] AS failure_types, s.top_patterns[1] AS first_pattern,
               CASE WHEN risk_level = 'strategic' THEN [{q(R.SENIOR_ASSIGNEE)}] ELSE [] END AS assignees,
               concat_ws(chr(10), concat('Repository: ', f.repo), concat('Risk: ', concat_ws(' - ', risk_level, risk_reason)),
                   concat('Type: ', failure_type), concat('Priority: ', priority),
                   concat('Effort: ', estimated_effort), concat('Expertise: ', required_expertise),
                   CASE WHEN risk_level = 'strategic' THEN concat(chr(10), '## Plan first', chr(10),
                        'This change needs a senior review before any work starts.') END,
                   {section('Root cause', 'root_cause')}, {section('Impact', 'impact')},
                   {section('Suggested fix', 'suggested_fix')},
                   CASE WHEN len(commands) > 0 THEN concat(chr(10), '## Commands', chr(10), '```', chr(10),
                        array_to_string(commands, chr(10)), chr(10), '```') END,
                   {section('Related files', bullets('related_files'))}, {section('How to verify', 'verification')},
                   {section('How to prevent', 'prevention')},
                   {section('Errors', and_more(bullets('top_patterns'), 'more_patterns', 'chr(10)'))},
                   {section('Files', and_more(bullets('top_files'), 'more_files', 'chr(10)'))},
                   concat(chr(10), '## Occurrences'),
                   concat('Most recent: ', {stamp('last_seen', stamp_s)}), concat('First: ', {stamp('first_seen', stamp_s)}),
                   concat('Total: ', failure_count), {bullets('named_links')},
                   CASE WHEN failure_count > 3 THEN concat('and ', failure_count - 3, ' more') END,
                   concat(chr(10), 'Opened by failure triage.')) AS body
        FROM {prefix}fields f
        LEFT JOIN {prefix}shown s ON s.repo = f.repo AND s.group_key = f.group_key
        LEFT JOIN {prefix}links k ON k.repo = f.repo AND k.group_key = f.group_key"""
    return out


def text_patterns(table: str, key: str, text: str) -> str:
    """Patterns and paths of whole texts, as distinct rows."""
    rules = R.TEXT_RULES
    return f"""
        SELECT DISTINCT {key}, class, kind, value FROM (
            SELECT {key}, class, 'pattern' AS kind, unnest(errs) AS value FROM t
            UNION ALL SELECT {key}, class, 'path', unnest(paths) FROM t) u""".replace(
        "FROM t", f"""FROM (
            SELECT {key}, {type_case(f'lower({text})', rules.types)} AS class, {all_matches(text, rules.errors, '(?i)')} AS errs,
                   {all_matches(text, rules.files, '')} AS paths FROM {table} WHERE {text} IS NOT NULL) t""")


BLOCKS.update(response_blocks("", "grouped"))
BLOCKS.update(issue_blocks("new_", "new_jobs"))
BLOCKS.update(issue_blocks("old_", "old_jobs"))
BLOCKS.update(issue_blocks("all_", "failures"))
for _name, _issues in (("on_file", "old_issues"), ("all_on_file", "all_issues")):
    BLOCKS[_name] = f"""
        SELECT repo, number, title, CASE WHEN number % 7 = 0 THEN NULL ELSE body END AS body,
               CASE WHEN number % 5 = 0 THEN 'closed' ELSE 'open' END AS state, labels FROM {_issues}"""


def compose(select: str) -> str:
    """``select`` preceded by all blocks it needs, in order of use."""
    names = re.compile(r"\b(?:FROM|JOIN)\s+([a-z_]+)\b")
    done: dict[str, str] = {}

    def add(sql: str) -> None:
        for name in names.findall(sql):
            if name in BLOCKS and name not in done:
                add(BLOCKS[name])
                done[name] = BLOCKS[name]

    add(select)
    if not done:
        return select
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({s})" for n, s in done.items()) + "\n" + select
