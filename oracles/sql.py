"""Oracle SQL per registered query."""

from __future__ import annotations

from debtscope import dims
from oracles import details  # noqa: F401  (registers its expressions)
from oracles.base import cte, hits, lookup, q, query, values
from oracles.details import SMELLS

ORACLES: dict[str, str] = {}


def put(name: str, final: str, *deps: str) -> None:
    ORACLES[name] = query(final, *deps)


def _ints(*names: str) -> str:
    return ", ".join(f"{n}::BIGINT AS {n}" for n in names)


def _joined(name: str, sep: str = ",") -> str:
    return f"array_to_string({name}, {q(sep)}) AS {name}"


# --- sources ---------------------------------------------------------------------------------

put("src_01_corpus_scan", "SELECT file_id, repo, path, length(content) AS n_chars, md5(content) AS digest FROM files", "files")
put(
    "src_01_directory_tree",
    """SELECT repo || '/' || path AS path, octet_length(encode(content))::BIGINT AS n_bytes, md5(content) AS digest, 'none' AS error FROM kept
       WHERE file_id IN (SELECT file_id FROM code_files)""",
    "kept", "code_files",
)
put("src_02_directory_pruning", "SELECT file_id, path FROM kept", "kept")
put(
    "src_03_language",
    "SELECT file_id, l.ext, lang FROM files JOIN languages l ON contains(string_split(path, '/')[-1], '.') "
    "AND l.ext = lower(string_split(path, '.')[-1])",
    "files", "languages",
)
put(
    "src_04_decoded_text",
    "SELECT file_id, md5(t) AS digest, length(t) AS n_chars FROM (SELECT file_id, replace(content, ' ', chr(65533) || ' ') AS t FROM files)",
    "files",
)
put(
    "src_05_lines",
    """SELECT s.file_id, coalesce(m.c, 0)::BIGINT AS metric_lines, a.c AS advisor_lines, a.longest FROM src s
       LEFT JOIN (SELECT file_id, count(*) AS c FROM raw_lines GROUP BY file_id) m USING (file_id)
       JOIN (SELECT file_id, count(*) AS c, max(length(line)) AS longest FROM advisor GROUP BY file_id) a USING (file_id)""",
    "src", "raw_lines", "advisor",
)
put(
    "src_06_syntax_nodes",
    """SELECT file_id, n.kind, n.arity::BIGINT AS arity, n.docstring, sum(n.n)::BIGINT AS n FROM ast_nodes n JOIN src USING (file_id)
       WHERE lang = 'Python' GROUP BY ALL""",
    "ast_nodes", "src",
)

# --- line predicates and states ----------------------------------------------------------------

put("prj_01_exempt", "SELECT file_id, is_exempt FROM src", "src")
put("prj_02_script_start", "SELECT file_id, n::BIGINT AS n FROM lines WHERE tag = 1", "lines")
put("prj_03_script_end", "SELECT file_id, n::BIGINT AS n FROM lines WHERE tag = 0", "lines")
put("prj_04_effective_language", "SELECT file_id, n::BIGINT AS n, stripped FROM lines WHERE html AND tag IS NULL AND in_script", "lines")
_COUNT = "SELECT file_id, count(*) AS n_lines FROM {} WHERE {} GROUP BY file_id"
put("prj_05_blank_lines", _COUNT.format("lines", "tag IS NULL AND stripped = ''"), "lines")
put(
    "prj_06_block_start",
    "SELECT file_id, n::BIGINT AS n FROM lines WHERE tag IS NULL AND stripped <> '' AND NOT in_comment AND first_start IS NOT NULL",
    "lines",
)
put("prj_07_single_line_comment", _COUNT.format("lines", "kind = 'C' AND NOT in_comment AND first_start IS NULL"), "lines")
put("prj_08_logic_lines", _COUNT.format("clean", "logic"), "clean")
put(
    "prj_09_sanitised_text",
    """SELECT file_id, md5(t) AS digest, length(t) AS n_chars FROM
       (SELECT file_id, string_agg(cleaned, chr(10) ORDER BY n) AS t FROM clean WHERE logic AND fam IS NOT NULL GROUP BY file_id)""",
    "clean",
)
put(
    "prj_10_line_complexity",
    """SELECT file_id, sum(branches)::BIGINT AS branches, sum(cc)::DOUBLE AS weight FROM
       (SELECT file_id, cc, CASE fam WHEN 'C-Family' THEN """
    + hits("ascii", r"\b(?:if|else|for|while|switch|case|catch|try)\b|&&|\|\|")
    + " WHEN 'Go' THEN " + hits("ascii", r"\b(?:if|else|for|select|case|default)\b|&&|\|\|")
    + " WHEN 'Rust' THEN " + hits("ascii", r"\b(?:if|else|for|while|loop|match|None|Some|Err|Ok)\b|&&|\|\|")
    + " WHEN 'Lua' THEN " + hits("ascii", r"\b(?:if|else|elseif|for|while|repeat|and|or)\b")
    + """ ELSE 0 END AS branches FROM line_facts WHERE logic) GROUP BY file_id HAVING sum(branches) > 0""",
    "line_facts",
)
put(
    "prj_11_indent_level",
    "SELECT file_id, sum(depth)::BIGINT AS levels, max(depth)::BIGINT AS deepest FROM line_facts WHERE kind IN ('P', 'K') GROUP BY file_id",
    "line_facts",
)
put("prj_12_import_lines", "SELECT DISTINCT file_id, import_line AS line FROM line_facts WHERE import_line IS NOT NULL", "line_facts")
put("prj_13_lone_bracket", _COUNT.format("lines", "kind = 'P'"), "lines")
put("win_01_script_mode", "SELECT file_id, n::BIGINT AS n, in_script FROM lines WHERE html AND tag IS NULL", "lines")
put("win_02_comment_state", "SELECT file_id, n::BIGINT AS n, in_comment, kind FROM lines WHERE kind IN ('C', 'P', 'K')", "lines")

put("win_02_segmented_counts", f"SELECT file_id, {_ints('total', 'code', 'comments', 'boilerplate', 'logic_lines')} FROM metrics", "metrics")

# --- scores, labels and filters ----------------------------------------------------------------

put("prj_14_html_relabel", f"SELECT file_id, lang, {_ints('logic_lines')} FROM metrics WHERE starts_with(lang, 'HTML')", "metrics")
put("prj_15_debt_score", f"SELECT file_id, {_ints('debt_score')} FROM metrics", "metrics")
put("prj_16_quality_score", f"SELECT file_id, {_ints('quality_score')} FROM metrics", "metrics")
put("prj_15_contents_once", f"SELECT file_id, repo, path, {_ints('debt_score', 'quality_score')} FROM metrics", "metrics")
put("prj_17_display_filter", "SELECT file_id, lang FROM metrics WHERE scored", "metrics")
_ALL_DEBT = "CASE WHEN scored THEN debt_score ELSE trunc(total / 50::DOUBLE + (max_nesting - 4) * 10) END"
put("prj_18_all_mode_override", f"SELECT file_id, ({_ALL_DEBT})::BIGINT AS debt_score FROM metrics", "metrics")
_LABEL = "CASE WHEN complexity > 0 THEN CASE WHEN ast_ok THEN 'AST:' ELSE 'Rgx:' END || complexity::BIGINT ELSE 'Dp:' || max_nesting::BIGINT END"
_CELL = "CASE WHEN complexity > 0 THEN complexity::BIGINT::VARCHAR ELSE 'Dp:' || max_nesting::BIGINT END"
_VALUE = "CASE WHEN complexity > 0 THEN complexity ELSE max_nesting END::BIGINT::VARCHAR"
_TYPE = "CASE WHEN ast_ok THEN 'AST' WHEN complexity > 0 THEN 'Regex' ELSE 'Depth' END"
_QUALITY = "CASE WHEN quality_score >= 0 THEN quality_score::BIGINT::VARCHAR ELSE '--' END"
put("prj_19_complexity_label", f"SELECT file_id, {_LABEL} AS label, {_VALUE} AS value, {_TYPE} AS type, {_CELL} AS cell FROM metrics", "metrics")
_DEBT_BAND = "CASE WHEN {0} > 80 THEN 'fail' WHEN {0} > 40 THEN 'warn' ELSE 'plain' END"
_QUALITY_BAND = "CASE WHEN quality_score = -1 THEN 'plain' WHEN quality_score >= 80 THEN 'good' WHEN quality_score >= 50 THEN 'warn' ELSE 'fail' END"
put("prj_20_bands", f"SELECT file_id, {_DEBT_BAND.format('debt_score')} AS debt_band, {_QUALITY_BAND} AS quality_band FROM metrics", "metrics")
put("prj_20_severity_bands", "SELECT file_id, key, CASE WHEN severity > 60 THEN 'fail' ELSE 'warn' END AS band FROM problems", "problems")
put("prj_20_hotspot_bands", "SELECT file_id, rank, CASE WHEN complexity > 15 THEN 'fail' ELSE 'warn' END AS band FROM hotspots", "hotspots")
_VERDICT = "CASE WHEN project_index >= 90 THEN 'legendary' WHEN project_index >= 80 THEN 'solid' WHEN project_index >= 65 THEN 'average' WHEN project_index >= 50 THEN 'shaky' ELSE 'toxic' END"
_INDEX = """SELECT {by} sum(quality_score * code)::BIGINT AS weighted, sum(code)::BIGINT AS weight,
            trunc(sum(quality_score * code) / sum(code))::BIGINT AS project_index
            FROM metrics WHERE quality_score >= 0 AND NOT is_exempt {group} HAVING sum(code) > 0"""
put("prj_21_verdict", f"SELECT repo, project_index, {_VERDICT} AS verdict FROM ({_INDEX.format(by='repo,', group='GROUP BY repo')})", "metrics")
_SHOWN = "path || CASE WHEN NOT is_logic AND logic_lines >= 5 THEN ' [JavaScript]' ELSE '' END"
put("prj_22_shown_path", f"SELECT file_id, {_SHOWN} AS shown_path, {_QUALITY} AS quality_text FROM metrics", "metrics")
_HINT = "CASE WHEN complexity > 20 THEN 'hint_split' WHEN length > 50 THEN 'hint_extract' WHEN nesting > 4 THEN 'hint_guard' ELSE {} END"
put("prj_23_hotspot_hint", f"SELECT file_id, rank, {_HINT.format(q('none'))} AS hint FROM hotspots", "hotspots")
_REPORTED = """SELECT * FROM metrics
    WHERE file_id IN (SELECT file_id FROM problems)
       OR (debt_score >= 5 AND file_id IN (SELECT file_id FROM smells UNION SELECT file_id FROM hotspots))"""
_REPORT_DEPS = ("metrics", "problems", "smells", "hotspots")
put("prj_24_reported_files", f"SELECT file_id, {_ints('debt_score')} FROM ({_REPORTED})", *_REPORT_DEPS)
_FUNCTION_COLUMNS = "file_id, name, line::BIGINT AS line, length::BIGINT AS length, complexity::BIGINT AS complexity"
put("prj_25_hotspot_filter", f"SELECT {_FUNCTION_COLUMNS} FROM hotspots", "hotspots")
put("prj_26_scoring_population", f"SELECT file_id, {_ints('code', 'quality_score')} FROM metrics WHERE quality_score >= 0 AND NOT is_exempt", "metrics")

# --- joins -------------------------------------------------------------------------------------

put("join_01_language", "SELECT lang, count(*) AS files FROM src GROUP BY lang", "src")
put("join_02_family", "SELECT file_id, coalesce(family, 'none') AS family, coalesce(import_kind, 'none') AS import_kind FROM src", "src")
put("join_03_extractor", "SELECT file_id, coalesce(extractor, 'none') AS extractor FROM src", "src")
put("join_04_line_function", "SELECT file_id, line::BIGINT AS line, coalesce(func, 'global') AS func FROM deep_lines", "deep_lines")
_ADVICE = [(k, d, " | ".join(s[:2])) for k, locale, d, s in dims.ADVICE if locale == "en"]
put("join_05_problem_advice", f"SELECT file_id, key, diagnosis, suggestions FROM problems JOIN ({values(_ADVICE, 'key, diagnosis, suggestions')}) USING (key)", "problems")
_ZH = [(k, d) for k, locale, d, _ in dims.ADVICE if locale == "zh"]
put("join_06_labels", f"SELECT file_id, key, label FROM problems JOIN ({values(_ZH, 'key, label')}) USING (key)", "problems")

# --- aggregates --------------------------------------------------------------------------------

put("agg_01_line_counts", f"SELECT file_id, {_ints('total', 'code', 'comments', 'boilerplate', 'logic_lines')} FROM metrics", "metrics")
put("agg_02_distinct_imports", f"SELECT file_id, {_ints('imports')} FROM metrics WHERE NOT ast_ok", "metrics")
put("agg_03_max_nesting", f"SELECT file_id, {_ints('max_nesting')} FROM metrics", "metrics")
put("agg_04_regex_complexity", f"SELECT file_id, {_ints('complexity')} FROM metrics WHERE NOT ast_ok", "metrics")
for _name, _column, _source in (
    ("agg_05_syntax_complexity", "complexity", "cc"),
    ("agg_06_syntax_imports", "imports", "imports"),
    ("agg_07_docstrings", "docstrings", "docstrings"),
):
    put(_name, f"SELECT file_id, ast.{_source}::BIGINT AS {_column} FROM ast JOIN src USING (file_id) WHERE lang = 'Python'", "ast", "src")
_ROLLUP = """count(*) AS files, sum(total)::BIGINT AS total, sum(code)::BIGINT AS code, sum(comments)::BIGINT AS comments,
             sum(boilerplate)::BIGINT AS boilerplate, sum(imports)::BIGINT AS imports, sum(complexity)::BIGINT AS cc"""
_AVERAGE = "CASE WHEN sum(complexity) > 0 THEN format('{:.1f}', sum(complexity)::DOUBLE / count(*)) ELSE '-' END"
put("agg_08_language_rollup", f"SELECT lang, {_ROLLUP} FROM metrics GROUP BY lang", "metrics")
put("agg_08_updated_rollup", f"SELECT lang, {_ROLLUP} FROM metrics GROUP BY lang", "metrics")
put("agg_09_average_complexity", f"SELECT lang, {_AVERAGE} AS avg_cc FROM metrics GROUP BY lang", "metrics")
_TOTALS = f"""SELECT lang, false AS is_total, {_AVERAGE} AS avg_cc, {_ROLLUP} FROM metrics GROUP BY lang
              UNION ALL SELECT 'TOTAL', true, '-', {_ROLLUP} FROM metrics"""
put("agg_10_grand_total", _TOTALS, "metrics")
put("agg_11_project_index", f"SELECT *, {_VERDICT} AS verdict FROM ({_INDEX.format(by='', group='')})", "metrics")
put(
    "agg_12_boilerplate_share",
    "SELECT sum(total)::BIGINT AS total, sum(boilerplate)::BIGINT AS boilerplate, format('{:.1f}', sum(boilerplate)::DOUBLE / sum(total) * 100) AS share FROM metrics",
    "metrics",
)
put("agg_13_smell_counts", "SELECT file_id, key, count FROM smells", "smells")
put("agg_14_smell_samples", f"SELECT file_id, key, {_joined('lines')} FROM smells", "smells")
_PLACES = """SELECT file_id, string_agg(entry, ';' ORDER BY func IS NULL, first_hit) AS places FROM
    (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY func IS NULL, first_hit) AS no FROM deep_groups)
    WHERE no <= {} GROUP BY file_id"""
put("agg_15_deep_nesting_places", _PLACES.format(5), "deep_groups")

# --- ordered state -----------------------------------------------------------------------------

put(
    "win_03_merged_ranges",
    """SELECT file_id, string_agg('L' || a || CASE WHEN b > a THEN '-' || b ELSE '' END, ',' ORDER BY a) AS ranges FROM
       (SELECT file_id, min(line) AS a, max(line) AS b FROM
        (SELECT file_id, line, line - row_number() OVER (PARTITION BY file_id ORDER BY line) AS island FROM hits_deep_nesting)
        GROUP BY file_id, island) GROUP BY file_id""",
    "hits_deep_nesting",
)
put("win_04_def_ranges", f"SELECT file_id, name, {_ints('start_line', 'end_line')} FROM def_ranges", "def_ranges")
_ENDS = "SELECT file_id, name, line::BIGINT AS line, (line + length)::BIGINT AS end_line FROM functions WHERE extractor {} 'Python'"
put("win_05_braced_end", _ENDS.format("<>"), "functions")
put("win_06_indented_end", _ENDS.format("="), "functions")

# --- rankings ----------------------------------------------------------------------------------

_BY_DEBT = "ORDER BY debt_score DESC, repo, path"
_TOP = f"SELECT * FROM metrics WHERE scored AND NOT is_exempt {_BY_DEBT} LIMIT"
put("top_01_top_files", f"SELECT repo, path, {_ints('debt_score', 'quality_score', 'complexity')} FROM ({_TOP} 10)", "metrics")
put(
    "top_01_top_files_per_repo",
    f"""SELECT repo, rank, path, {_ints('debt_score')} FROM
        (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY debt_score DESC, path) AS rank FROM metrics WHERE scored AND NOT is_exempt)
        WHERE rank <= 10""",
    "metrics",
)
put("top_02_exempt_files", f"SELECT repo, path, {_ints('debt_score')} FROM metrics WHERE scored AND is_exempt AND debt_score > 20", "metrics")
put("top_03_languages", f"SELECT lang, files, code, avg_cc FROM ({_TOTALS})", "metrics")
put(
    "top_04_functions",
    "SELECT file_id, rank, name, complexity::BIGINT AS complexity FROM hotspots WHERE rank <= 5",
    "hotspots",
)
put("top_05_problems", f"SELECT file_id, rank, key, {_ints('severity')} FROM problems", "problems")
put(
    "top_06_smells",
    """SELECT file_id, rank, key, count FROM
       (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY detector_no) AS rank FROM smells)
       WHERE rank <= 5""",
    "smells",
)
put("top_07_advised_files", f"SELECT repo, path, {_ints('debt_score')} FROM ({_TOP} 5)", "metrics")
put("top_08_report_order", f"SELECT repo, path, {_ints('debt_score')} FROM metrics {_BY_DEBT}", "metrics")

# --- sets, smells ------------------------------------------------------------------------------

put("set_01_all_smells", f"SELECT file_id, {_ints('detector_no')}, key, count FROM smells", "smells")
put("set_02_all_problems", f"SELECT file_id, key, {_ints('severity')}, value::DOUBLE AS value FROM problems", "problems")
put("set_03_distinct_lines", "SELECT DISTINCT file_id, line::BIGINT AS line FROM hits_hardcoded_path", "hits_hardcoded_path")
_NUMBERS = {key: no for no, key, *_ in dims.SMELLS}
for _key in SMELLS:
    put(f"sml_{_NUMBERS[_key]:02d}_{_key}", f"SELECT file_id, count, {_joined('lines')} FROM pattern_smells WHERE key = {q(_key)}", "pattern_smells")
for _key in ("magic_number", "duplicate_string"):
    put(f"sml_{_NUMBERS[_key]:02d}_{_key}", f"SELECT file_id, count, {_joined('lines')} FROM smells_{_key}", f"smells_{_key}")
put("sml_10_long_lines", f"SELECT file_id, count, {_joined('lines')} FROM long_lines", "long_lines")
put("sml_11_long_function", f"SELECT file_id, count, {_joined('lines')}, details FROM long_functions", "long_functions")

# --- functions and classes ---------------------------------------------------------------------

put("fn_01_match_rows", "SELECT file_id, (k - 1)::BIGINT AS pos, line::BIGINT AS line, m AS match FROM hits_commented_code", "hits_commented_code")
put("fn_02_function_names", f"SELECT file_id, extractor, name, {_ints('line')} FROM functions", "functions")
for _no, _column in ((3, "length"), (4, "complexity"), (5, "nesting")):
    put(f"fn_{_no:02d}_function_{_column}", f"SELECT file_id, name, {_ints('line', _column)} FROM functions", "functions")
put("fn_06_classes", f"SELECT file_id, name, {_ints('line')} FROM class_matches", "class_matches")

# --- diagnosis ---------------------------------------------------------------------------------

for _no, _key in enumerate(["high_complexity", "high_nesting", "high_coupling", "long_file", "low_comment"], 1):
    put(
        f"dia_{_no:02d}_{_key}",
        f"SELECT file_id, {_ints('severity')}, value::DOUBLE AS value, value_text FROM problems WHERE key = {q(_key)}",
        "problems",
    )

# --- sinks -------------------------------------------------------------------------------------

put(
    "snk_01_csv_report",
    f"""SELECT repo, path AS file_path, lang AS language, {_ints('debt_score')}, {_QUALITY} AS quality_score, {_VALUE} AS complexity,
        {_TYPE} AS type, total::BIGINT AS lines, {_ints('code', 'comments', 'imports')} FROM metrics""",
    "metrics",
)
put(
    "snk_01_csv_lines",
    f"""SELECT repo, path || ',' || lang || ',' || debt_score::BIGINT || ',' || {_QUALITY} || ',' || {_VALUE} || ',' || {_TYPE} || ',' || total::BIGINT
        || ',' || code::BIGINT || ',' || comments::BIGINT || ',' || imports::BIGINT AS line FROM metrics
        UNION ALL SELECT '', 'File Path,Language,Debt Score,Quality Score,Complexity,Type,Lines,Code,Comments,Imports'""",
    "metrics",
)
put(
    "snk_02_file_table",
    f"""SELECT repo, path, {_ints('debt_score')}, '| `' || path || '` | ' || lang || ' | ' || debt_score::BIGINT || ' | ' || {_QUALITY} || ' | '
        || {_CELL} || ' | ' || total::BIGINT || ' | ' || imports::BIGINT || ' |' AS line FROM metrics""",
    "metrics",
)
put("snk_04_summary", _TOTALS, "metrics")
put(
    "snk_05_ranking",
    f"""WITH shown AS (SELECT * EXCLUDE (debt_score), {_ALL_DEBT} AS debt_score FROM metrics),
        picked AS (SELECT 'top' AS section, * FROM (SELECT * FROM shown WHERE NOT is_exempt {_BY_DEBT} LIMIT 10)
                   UNION ALL SELECT 'exempt', * FROM shown WHERE is_exempt AND debt_score > 20)
        SELECT section, {_ints('debt_score')}, {_QUALITY} AS quality_text, {_LABEL} AS complexity_label, {_ints('imports', 'total')},
        CASE WHEN section = 'exempt' THEN path || ' [Exempt]' ELSE {_SHOWN} END AS shown_path,
        {_DEBT_BAND.format('debt_score')} AS debt_band, {_QUALITY_BAND} AS quality_band, repo, path FROM picked""",
    "metrics",
)
ORACLES["snk_05_ranking"] = ORACLES["snk_05_ranking"].replace("\nWITH shown", ",\nshown", 1)


def _lines(section: int, item: str, part: int, line: str, source: str) -> str:
    return f"SELECT repo, path, {_ints('debt_score')}, {section}::BIGINT AS section, ({item})::BIGINT AS item, {part}::BIGINT AS part, {line} AS line FROM {source}"


_KEYED = "reported JOIN {} USING (file_id)"
_WITH_PROBLEMS = "reported WHERE file_id IN (SELECT file_id FROM problems)"
_WITH_HOTSPOTS = "reported WHERE file_id IN (SELECT file_id FROM hotspots)"
_TIPS = [(k, d, s[0].replace("▸ ", ""), s[1].replace("▸ ", "")) for k, locale, d, s in dims.ADVICE if locale == "en"]
_PROBLEM_SOURCE = _KEYED.format(f"(SELECT * FROM problems JOIN ({values(_TIPS, 'key, diagnosis, tip1, tip2')}) USING (key))")
_HOTSPOT_SOURCE = _KEYED.format("(SELECT file_id, rank, name, line AS line_no, length AS len, complexity AS cc, nesting AS nest FROM hotspots WHERE rank <= 5)")
_REPORT_LINES = [
    _lines(0, "-1", 0, "'### 📄 `' || path || '`'", "reported"),
    _lines(0, "-1", 1, "''", "reported"),
    _lines(0, "-1", 2, "'**Debt Score:** ' || debt_score::BIGINT || ' | **Complexity:** ' || complexity::BIGINT || ' | **Lines:** ' || total::BIGINT", "reported"),
    _lines(0, "-1", 3, "''", "reported"),
    _lines(1, "-1", 0, "'#### Problem Diagnosis'", _WITH_PROBLEMS),
    _lines(1, "-1", 1, "''", _WITH_PROBLEMS),
    _lines(1, "rank - 1", 0, "'- ' || CASE WHEN severity > 60 THEN '🔴' ELSE '🟡' END || ' **' || diagnosis || '** (Complexity: ' || value_text || ')'", _PROBLEM_SOURCE),
    _lines(1, "rank - 1", 1, "'  - ' || tip1", _PROBLEM_SOURCE),
    _lines(1, "rank - 1", 2, "'  - ' || tip2", _PROBLEM_SOURCE),
    _lines(2, "-1", 0, "'#### Complexity Hotspot Functions'", _WITH_HOTSPOTS),
    _lines(2, "-1", 1, "''", _WITH_HOTSPOTS),
    _lines(2, "-1", 2, "'| Function | Line | CC | Lines | Nesting |'", _WITH_HOTSPOTS),
    _lines(2, "-1", 3, "'| --- | ---: | ---: | ---: | ---: |'", _WITH_HOTSPOTS),
    _lines(
        2, "rank - 1", 0,
        "'| `' || name || '()` | L' || line_no::BIGINT || ' | ' || cc::BIGINT || ' | ' || len::BIGINT || ' | ' || nest::BIGINT || ' |'", _HOTSPOT_SOURCE,
    ),
    _lines(4, "-1", 0, "'---'", "reported"),
    _lines(4, "-1", 1, "''", "reported"),
]
_PLAIN_SMELLS = [(key, name, tip, dims.SMELL_DISPLAY_EN.get(key, name)) for _, key, name, tip, *_ in dims.SMELLS]
_SAMPLES = "array_to_string(list_slice(list_transform(lines, lambda n: 'L' || n::BIGINT), 1, 3), ', ') || CASE WHEN len(lines) > 3 THEN '...' ELSE '' END"
cte(
    "shown_smells",
    f"""SELECT s.*, n.name, n.tip, n.display, {_SAMPLES} AS samples, row_number() OVER (PARTITION BY file_id ORDER BY detector_no) AS rank
        FROM smells s JOIN ({values(_PLAIN_SMELLS, 'key, name, tip, display')}) n USING (key)""",
    "smells",
)
cte("reported", _REPORTED, *_REPORT_DEPS)
_WITH_SMELLS = "reported WHERE file_id IN (SELECT file_id FROM smells)"
_SMELL_SOURCE = _KEYED.format("(SELECT * FROM shown_smells WHERE rank <= 5)")
_SMELL_LINES = [
    _lines(3, "-1", 0, "'#### Code Smells'", _WITH_SMELLS),
    _lines(3, "-1", 1, "''", _WITH_SMELLS),
    _lines(3, "rank - 1", 0, "'- ⚠️ **' || name || '** × ' || count || ' [' || samples || ']' || CASE WHEN tip <> '' THEN ' → ' || tip ELSE '' END", _SMELL_SOURCE),
]
put("snk_03_advice_report", " UNION ALL ".join(_REPORT_LINES + _SMELL_LINES), "reported", "shown_smells")
put("snk_03_report_problems_and_hotspots", " UNION ALL ".join(_REPORT_LINES), "reported")

# the first five of the top ten, with their problems, three functions and three smells
cte("advised", f"{_TOP} 5", "metrics")
cte(
    "smell_places",
    f"""SELECT file_id, array_to_string(list_slice(list(entry ORDER BY func IS NULL, first_hit), 1, 3), ', ')
        || CASE WHEN count(*) > 3 THEN '...' ELSE '' END AS place FROM deep_groups GROUP BY file_id""",
    "deep_groups",
)
cte(
    "smell_functions",
    """SELECT file_id, ' → ' || array_to_string(list_slice(list(name || '(' || (end_line - start_line) || 'lines)' ORDER BY k), 1, 3), ', ') AS detail
       FROM def_ranges WHERE end_line - start_line > 50 GROUP BY file_id""",
    "def_ranges",
)
_LABEL_TEXT = {key: text for key, locale, text in dims.label_rows() if locale == "en"}
_MINE = "advised JOIN {} USING (file_id)"
_ADVISED_PROBLEMS = _MINE.format(
    f"(SELECT * FROM problems JOIN ({values([(k, d, s[0], s[1]) for k, own, d, s in dims.ADVICE if own == 'en'], 'key, diagnosis, tip1, tip2')}) USING (key))"
)
_ADVISED_FUNCTIONS = f"""(SELECT repo, path, debt_score, rank, name, line, length, f.complexity, nesting,
    {lookup({key: _LABEL_TEXT[key] for key in ("hint_split", "hint_extract", "hint_guard")}, "hint")} AS hint_text
    FROM advised JOIN (SELECT *, {_HINT.format("NULL")} AS hint FROM hotspots WHERE rank <= 3) f USING (file_id))"""
_ADVISED_SMELLS = """(SELECT repo, path, debt_score, rank, display, count, coalesce(place, samples) AS place, coalesce(detail, '') AS detail, tip
    FROM advised JOIN shown_smells s USING (file_id) LEFT JOIN smell_places p ON p.file_id = s.file_id AND s.key = 'deep_nesting'
    LEFT JOIN smell_functions f ON f.file_id = s.file_id AND s.key = 'long_function' WHERE rank <= 3)"""
_HAS = "advised WHERE file_id IN (SELECT file_id FROM {})"
_ADVICE_LINES = [
    _lines(0, "-1", 0, "'📄 ' || path || ' (Debt Score: ' || debt_score::BIGINT || ')'", _HAS.format("problems UNION SELECT file_id FROM hotspots UNION SELECT file_id FROM smells")),
    _lines(1, "rank - 1", 0, "'  ■ ' || diagnosis || ' (value: ' || value_text || ')'", _ADVISED_PROBLEMS),
    _lines(1, "rank - 1", 1, "'    ' || tip1", _ADVISED_PROBLEMS),
    _lines(1, "rank - 1", 2, "'    ' || tip2", _ADVISED_PROBLEMS),
    _lines(2, "-1", 0, q("  " + _LABEL_TEXT["hotspot_title"]), _HAS.format("hotspots")),
    _lines(
        2, "rank - 1", 0,
        "'    🔥 ' || name || '() [L' || line::BIGINT || '] CC=' || complexity::BIGINT || ', ' || length::BIGINT || ' lines, nesting ' || nesting::BIGINT",
        _ADVISED_FUNCTIONS,
    ),
    _lines(2, "rank - 1", 1, "'      ' || hint_text", _ADVISED_FUNCTIONS + " WHERE hint_text IS NOT NULL"),
    _lines(3, "-1", 0, q("  " + _LABEL_TEXT["smell_title"]), _HAS.format("smells")),
    _lines(3, "rank - 1", 0, "'    ⚠ ' || display || ' × ' || count || ' [' || place || ']' || detail", _ADVISED_SMELLS),
    _lines(3, "rank - 1", 1, "'      └ ' || tip", _ADVISED_SMELLS + " WHERE tip <> ''"),
]
put(
    "snk_06_advice",
    " UNION ALL ".join(_ADVICE_LINES),
    "advised", "problems", "hotspots", "shown_smells", "smell_places", "smell_functions",
)
