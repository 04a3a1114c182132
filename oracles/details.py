"""Common table expressions for matches, smells, functions and classes."""

from __future__ import annotations

from debtscope import dims
from oracles.base import cte, hits, lead, newlines, q, strip
from oracles.fixed import CLASS_PATTERNS, FUNCTION_PATTERNS, KEYWORDS, SMELL_PATTERNS

cte(
    "advisor",
    "SELECT file_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS n FROM (SELECT file_id, string_split(text, chr(10)) AS ls FROM src)",
    "src",
)
cte("advisor_size", "SELECT file_id, count(*) AS n_lines FROM advisor GROUP BY file_id", "advisor")


def match_lists(pattern: str, where: str = "true", groups: int = 0) -> str:
    names = "".join(f", regexp_extract_all(text, {q(pattern)}, {i}) AS g{i}" for i in range(1, groups + 1))
    return (
        f"SELECT file_id, regexp_extract_all(text, {q(pattern)}) AS ms, string_split_regex(text, {q(pattern)}) AS gaps{names} "
        f"FROM src WHERE {where}"
    )


def match_rows(lists: str, extra: str = "") -> str:
    """``file_id, k, line, m, gap`` per match; the line number is a running newline count."""
    return f"""SELECT *, 1 + sum(nl_gap) OVER (PARTITION BY file_id ORDER BY k)
        + coalesce(sum(nl_m) OVER (PARTITION BY file_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS line
        FROM (SELECT *, {newlines('before')} AS nl_gap, {newlines('m')} AS nl_m FROM
              (SELECT file_id, k, ms[k] AS m, gaps[k] AS before, gaps[k + 1] AS gap{extra}
               FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS k FROM ({lists}))))"""


# RE2 has no look-around and no back references; these two are taken apart below.
_APART = ("magic_number", "duplicate_string")
SMELLS = {key: pattern for key, pattern in SMELL_PATTERNS.items() if key not in _APART}
for _key, _pattern in SMELLS.items():
    cte(f"hits_{_key}", match_rows(match_lists(_pattern)), "src")
_NUMBER = {key: no for no, key, *_ in dims.SMELLS}
cte(
    "pattern_smells",
    " UNION ALL ".join(
        f"SELECT file_id, {_NUMBER[key]} AS detector_no, {q(key)} AS key, count(*) AS count, "
        f"list_slice(list(line ORDER BY k), 1, 5) AS lines FROM hits_{key} GROUP BY file_id"
        for key in SMELLS
    ),
    *[f"hits_{key}" for key in SMELLS],
)
# Magic numbers: a number is a whole run of word characters, all digits, that no quote touches; behind
# it a point and a further run may belong to it.  In a chain of such runs every other one is used up.
_QUOTE = """IN ('"', '''')"""
cte("word_runs", match_rows(match_lists(r"[\p{L}\p{N}_]+", r"regexp_matches(text, '\p{Nd}')")), "src")
cte(
    "number_runs",
    rf"""SELECT *, digits AND length(m) > 1 AND right(before, 1) NOT {_QUOTE} AND left(gap, 1) NOT {_QUOTE} AS fits,
        digits_after AND gap = '.' AND left(gap_after, 1) NOT {_QUOTE} AS goes_on
        FROM (SELECT file_id, k, m, before, gap, line, regexp_full_match(m, '\p{{Nd}}+') AS digits,
                     lead(regexp_full_match(m, '\p{{Nd}}+'), 1, false) OVER w AS digits_after, lead(gap, 1, '') OVER w AS gap_after
              FROM word_runs WINDOW w AS (PARTITION BY file_id ORDER BY k))""",
    "word_runs",
)
cte(
    "number_chains",
    """SELECT *, k - max(CASE WHEN follows THEN 0 ELSE k END) OVER (PARTITION BY file_id ORDER BY k) AS in_chain
       FROM (SELECT *, lag(fits AND goes_on, 1, false) OVER (PARTITION BY file_id ORDER BY k) AS follows FROM number_runs)""",
    "number_runs",
)
cte(
    "hits_magic_number",
    """SELECT file_id, k, line FROM number_chains WHERE fits AND in_chain % 2 = 0
       UNION ALL SELECT file_id, k, line FROM (SELECT file_id, k, line, unnest(regexp_extract_all(m, '0x[0-9a-fA-F]{4,}')) FROM word_runs)""",
    "number_chains", "word_runs",
)
# Repeated strings: what stands between two neighbouring quotes and comes again on the same line,
# within 2,000 characters; a match uses up all in between, so the matches are walked along.
cte(
    "quotes",
    "SELECT file_id, k, m, gap, line, sum(length(before) + 1) OVER (PARTITION BY file_id ORDER BY k) AS pos FROM ("
    + match_rows(match_lists("""["']""")) + ")",
    "src",
)
cte(
    "quoted",
    """SELECT file_id, k, line, pos, m || gap || lead(m) OVER w AS piece, length(gap) AS size, lead(line) OVER w AS end_line, lead(pos) OVER w AS end_pos
       FROM quotes WINDOW w AS (PARTITION BY file_id ORDER BY k)""",
    "quotes",
)
cte(
    "repeated",
    """SELECT file_id, k, line, again FROM (
         SELECT file_id, k, line, end_line, end_pos, CASE WHEN k1 > k + 1 THEN k1 ELSE k2 END AS again,
                CASE WHEN k1 > k + 1 THEN line1 ELSE line2 END AS again_line, CASE WHEN k1 > k + 1 THEN pos1 ELSE pos2 END AS again_pos
         FROM (SELECT *, lead(k) OVER w AS k1, lead(line) OVER w AS line1, lead(pos) OVER w AS pos1,
                      lead(k, 2) OVER w AS k2, lead(line, 2) OVER w AS line2, lead(pos, 2) OVER w AS pos2
               FROM quoted WHERE size >= 10 AND piece IS NOT NULL WINDOW w AS (PARTITION BY file_id, piece ORDER BY k)))
       WHERE again_line = end_line AND again_pos - end_pos - 1 <= 2000""",
    "quoted",
)
cte(
    "repeated_next",
    """SELECT a.*, b.k AS next_k, row_number() OVER (PARTITION BY a.file_id ORDER BY a.k) AS turn
       FROM repeated a ASOF LEFT JOIN repeated b ON a.file_id = b.file_id AND a.again + 2 <= b.k""",
    "repeated",
)
cte(
    "hits_duplicate_string",
    """SELECT file_id, k, line, next_k FROM repeated_next WHERE turn = 1
       UNION ALL SELECT r.file_id, r.k, r.line, r.next_k FROM hits_duplicate_string h JOIN repeated_next r ON r.file_id = h.file_id AND r.k = h.next_k""",
    "repeated_next",
)
for _key in _APART:
    cte(
        f"smells_{_key}",
        f"""SELECT file_id, {_NUMBER[_key]} AS detector_no, {q(_key)} AS key, count(*) AS count,
            list_slice(list(line ORDER BY k), 1, 5) AS lines FROM hits_{_key} GROUP BY file_id""",
        f"hits_{_key}",
    )
cte(
    "long_lines",
    "SELECT file_id, count(*) AS count, list_slice(list(n ORDER BY n), 1, 5) AS lines FROM advisor WHERE length(line) > 120 GROUP BY file_id",
    "advisor",
)
cte(
    "def_ranges",
    f"""SELECT file_id, k, g1[k] AS name, line AS start_line,
        coalesce(lead(line) OVER (PARTITION BY file_id ORDER BY k) - 1, n_lines) AS end_line
        FROM ({match_rows(match_lists(r"(?m)^(?: {4})*def\s+(\w+)\s*\(", "contains(text, 'def')", 1), ", g1")}) JOIN advisor_size USING (file_id)""",
    "src", "advisor_size",
)
cte(
    "long_functions",
    """SELECT file_id, count(*) AS count, list_slice(list(start_line ORDER BY k), 1, 3) AS lines,
       array_to_string(list_slice(list(name || ':' || (end_line - start_line) ORDER BY k), 1, 3), ',') AS details
       FROM def_ranges WHERE end_line - start_line > 50 GROUP BY file_id""",
    "def_ranges",
)
cte(
    "smells",
    """SELECT file_id, detector_no, key, count, lines FROM pattern_smells
       UNION ALL SELECT * FROM smells_magic_number
       UNION ALL SELECT * FROM smells_duplicate_string
       UNION ALL SELECT file_id, 10, 'long_lines', count, lines FROM long_lines
       UNION ALL SELECT file_id, 11, 'long_function', count, lines FROM long_functions""",
    "pattern_smells", "smells_magic_number", "smells_duplicate_string", "long_lines", "long_functions",
)
cte(
    "deep_lines",
    """SELECT h.file_id, h.line, r.name AS func FROM hits_deep_nesting h
       LEFT JOIN def_ranges r ON r.file_id = h.file_id AND h.line BETWEEN r.start_line AND r.end_line""",
    "hits_deep_nesting", "def_ranges",
)
cte(
    "deep_ranges",
    """SELECT file_id, func, min(line) AS first_line, max(line) AS last_line
       FROM (SELECT *, line - row_number() OVER (PARTITION BY file_id, func ORDER BY line) AS island FROM (SELECT DISTINCT * FROM deep_lines))
       GROUP BY file_id, func, island""",
    "deep_lines",
)
cte(
    "deep_groups",
    """SELECT file_id, func, min(first_line) AS first_hit,
       '[' || coalesce(func, 'global') || ']' || string_agg('L' || first_line || CASE WHEN last_line > first_line THEN '-' || last_line ELSE '' END, ','
            ORDER BY first_line) FILTER (range_no <= 2) AS entry
       FROM (SELECT *, row_number() OVER (PARTITION BY file_id, func ORDER BY first_line) AS range_no FROM deep_ranges)
       GROUP BY file_id, func""",
    "deep_ranges",
)

# --- functions and classes -------------------------------------------------------------------

def _function_matches(extractor: str, pattern: str, groups: int) -> str:
    name = "coalesce(" + ", ".join(f"nullif(g{i}[k], '')" for i in range(1, groups + 1)) + ")"
    extra = "".join(f", g{i}" for i in range(1, groups + 1))
    rows = match_rows(match_lists(pattern, f"extractor = {q(extractor)}", groups), extra)
    return f"SELECT file_id, {q(extractor)} AS extractor, k, line, {name} AS name, m || gap AS segment, m FROM ({rows})"


cte("function_matches", " UNION ALL ".join(_function_matches(key, *spec) for key, spec in FUNCTION_PATTERNS.items()), "src")
_TOKENS = r"""\\[\s\S]?|"(?:[^"\\]|\\[\s\S]?)*(?:"|\z)|'(?:[^'\\]|\\[\s\S]?)*(?:'|\z)|[{}\n]"""
cte(
    "brace_tokens",
    f"""SELECT file_id, k, i, token, sum(CASE token WHEN '{{' THEN 1 WHEN '}}' THEN -1 ELSE 0 END) OVER w AS depth,
        sum({newlines('token')}) OVER w AS passed
        FROM (SELECT file_id, k, unnest(ts) AS token, generate_subscripts(ts, 1) AS i
              FROM (SELECT file_id, k, regexp_extract_all(segment, {q(_TOKENS)}) AS ts FROM function_matches WHERE extractor <> 'Python'))
        WINDOW w AS (PARTITION BY file_id, k ORDER BY i)""",
    "function_matches",
)
cte(
    "braced_lengths",
    f"""SELECT f.file_id, f.k, coalesce(e.passed, {newlines('f.segment')}) AS length FROM function_matches f
        LEFT JOIN (SELECT file_id, k, arg_min(passed, i) AS passed FROM brace_tokens WHERE token = '}}' AND depth = 0 GROUP BY file_id, k) e
        USING (file_id, k) WHERE f.extractor <> 'Python'""",
    "function_matches", "brace_tokens",
)
cte(
    "indented_lengths",
    f"""SELECT f.file_id, f.k, coalesce(min(a.n) - 1 - f.line, least(100, z.n_lines - f.line)) AS length
        FROM function_matches f JOIN advisor_size z USING (file_id)
        LEFT JOIN advisor a ON a.file_id = f.file_id AND a.n BETWEEN f.line + 2 AND f.line + 200
             AND {strip('a.line')} <> '' AND NOT starts_with({strip('a.line')}, '#')
             AND length(a.line) - length(ltrim(a.line, ' ')) <= length(f.m) - length(ltrim(f.m, ' '))
        WHERE f.extractor = 'Python' GROUP BY f.file_id, f.k, f.line, z.n_lines""",
    "function_matches", "advisor", "advisor_size",
)
cte(
    "functions",
    f"""SELECT f.file_id, f.k, f.extractor, f.name, f.line, l.length,
        1 + {hits("string_agg(a.line, chr(10) ORDER BY a.n)", KEYWORDS)} AS complexity,
        max(CASE WHEN {strip('a.line')} = '' THEN 0 ELSE {lead('a.line')} // 4 END) AS nesting
        FROM function_matches f JOIN (FROM braced_lengths UNION ALL FROM indented_lengths) l USING (file_id, k)
        JOIN advisor a ON a.file_id = f.file_id AND a.n BETWEEN f.line AND f.line + l.length
        GROUP BY f.file_id, f.k, f.extractor, f.name, f.line, l.length""",
    "function_matches", "braced_lengths", "indented_lengths", "advisor",
)
cte(
    "hotspots",
    """SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY complexity DESC, k) AS rank FROM functions
       WHERE length > 30 OR complexity > 10""",
    "functions",
)
cte(
    "class_matches",
    " UNION ALL ".join(
        f"SELECT file_id, g{group}[k] AS name, line FROM ({match_rows(match_lists(pattern, f'extractor = {q(key)}', group), f', g{group}')})"
        for key, (pattern, group) in CLASS_PATTERNS.items()
    ),
    "src",
)

# --- diagnosis -------------------------------------------------------------------------------

cte(
    "problems",
    """SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY severity DESC, rule_no) AS rank FROM (
       SELECT file_id, 1 AS rule_no, 'high_complexity' AS key, least(100, (complexity - 25) * 3) AS severity, complexity::DOUBLE AS value, complexity::BIGINT::VARCHAR AS value_text
       FROM metrics WHERE complexity > 25
       UNION ALL SELECT file_id, 2, 'high_nesting', least(100, (max_nesting - 5) * 15), max_nesting, max_nesting::BIGINT::VARCHAR FROM metrics WHERE max_nesting > 5
       UNION ALL SELECT file_id, 3, 'high_coupling', least(100, (imports - 15) * 5), imports, imports::BIGINT::VARCHAR FROM metrics WHERE imports > 15
       UNION ALL SELECT file_id, 4, 'long_file', least(100, trunc((total - 300) / 5)), total, total::BIGINT::VARCHAR FROM metrics WHERE total > 300
       UNION ALL SELECT file_id, 5, 'low_comment', least(100, trunc((0.05::DOUBLE - ratio) * 500)), ratio * 100, format('{:.1f}%', ratio * 100)
       FROM metrics WHERE ratio < 0.05::DOUBLE AND total > 50)""",
    "metrics",
)
