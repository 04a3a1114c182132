"""Common table expressions shared by the oracle queries (DuckDB SQL).

They rebuild the corpora from the given tables and recompute every measure with window
functions and RE2 patterns.  Syntax trees are summed from hand-written weights of the templates.
"""

from __future__ import annotations

from debtscope import dims
from debtscope.sources import templates as T


def q(value) -> str:
    """SQL literal."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (list, tuple)):
        return "[" + ", ".join(q(v) for v in value) + "]::VARCHAR[]" if not value else "[" + ", ".join(q(v) for v in value) + "]"
    if isinstance(value, (int, float)):
        return str(value)
    return "'" + value.replace("'", "''") + "'"


def values(rows, columns: str) -> str:
    body = ",\n".join("(" + ", ".join(q(v) for v in row) + ")" for row in rows)
    return f"SELECT * FROM (VALUES {body}) AS v({columns})"


def lookup(pairs: dict, key: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in pairs.items()) + " END"


# White space as RE2 sees it through explicit code points.
WS = r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def strip(expr: str) -> str:
    return f"regexp_replace({expr}, '^[{WS}]+|[{WS}]+$', '', 'g')"


def lead(expr: str) -> str:
    return f"(length({expr}) - length(regexp_replace({expr}, '^[{WS}]+', '')))"


def ascii_words(expr: str) -> str:
    """Map other letters and numbers to ``z`` and other symbols to ``-`` so that RE2's ASCII word classes agree."""
    return f"regexp_replace(regexp_replace({expr}, '[^\\x00-\\x7F\\p{{L}}\\p{{N}}]', '-', 'g'), '[^\\x00-\\x7F]', 'z', 'g')"


def hits(expr: str, pattern: str) -> str:
    return f"len(regexp_extract_all({expr}, {q(pattern)}))"


def newlines(expr: str) -> str:
    return f"(length({expr}) - length(replace({expr}, chr(10), '')))"


CTE: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, sql: str, *deps: str) -> None:
    CTE[name] = (deps, sql)


def query(final: str, *deps: str) -> str:
    """Prepend the expressions ``final`` needs, in dependency order."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in ordered:
            return
        for dep in CTE[name][0]:
            visit(dep)
        ordered.append(name)

    for dep in deps:
        visit(dep)
    body = ",\n".join(f"{name} AS ({CTE[name][1]})" for name in ordered)
    return f"WITH RECURSIVE {body}\n{final}" if body else final


cte("templates", values([(t.family, t.k, t.body) for t in T.TEMPLATES], "family, k, body"))
cte(
    "template_nodes",
    values([(t.family, t.k, *node) for t in T.TEMPLATES for node in t.nodes], "family, k, kind, arity, docstring, n"),
)
cte("languages", values(dims.LANGUAGES, "ext, lang, singles, starts, ends, is_logic, family, import_kind, extractor"))
cte("slots", "SELECT greatest(1, count(*) // 24) AS s FROM lineitem")
cte(
    "slotted",
    """SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey,
       (l_orderkey * 7919 + l_partkey * 104729 + l_suppkey * 1299709 + l_linenumber::BIGINT * 15485863) % (SELECT s FROM slots) AS slot
       FROM lineitem""",
    "slots",
)
_EXT = f"({q(T.EXTENSIONS)})[(file_id % {len(T.EXTENSIONS)} + 1)::INT]"
cte(
    "code_rows",
    f"""SELECT *, (l_orderkey * 7 + l_suppkey * 3 + l_linenumber + l_partkey) % {lookup(T.FAMILY_SIZES, 'family')} AS k
        FROM (SELECT *, {lookup(T.FAMILY_OF_EXTENSION, 'code_ext')} AS family
              FROM (SELECT *, {_EXT} AS code_ext
                    FROM (SELECT *, CASE WHEN slot % 4 = 0 THEN 1000000000000 + slot // 40 ELSE slot END AS file_id FROM slotted)))""",
    "slotted",
)
cte(
    "code_files",
    f"""SELECT file_id, 'repo' || (file_id % 5) AS repo,
        CASE WHEN file_id % 22 = 0 THEN 'build/' WHEN file_id % 11 = 0 THEN 'web/node_modules/' ELSE '' END
        || 'src/m' || (file_id % 10) || '/'
        || CASE WHEN file_id % 23 = 0 THEN 'Makefile' || file_id
                WHEN file_id % 13 = 0 AND code_ext IN ('py', 'js', 'ts', 'rs', 'go')
                THEN 'd' || file_id || '/' || {lookup(T.EXEMPT_NAME_OF_EXTENSION, 'code_ext')}
                ELSE 'f' || file_id || '.' || CASE WHEN file_id % 19 = 0 THEN 'txt' WHEN file_id % 17 = 0 THEN upper(code_ext) ELSE code_ext END
           END AS path,
        string_agg(replace(body, '@', 'r' || l_orderkey || '_' || l_linenumber || '_' || l_suppkey || '_' || l_partkey), chr(10)
                   ORDER BY l_orderkey, l_linenumber, l_suppkey, l_partkey) AS content
        FROM code_rows JOIN templates USING (family, k) GROUP BY file_id, code_ext""",
    "code_rows", "templates",
)
_DOC_EXT = f"({q(T.EXTENSIONS)})[(doc_id % {len(T.EXTENSIONS)} + 1)::INT]"
cte(
    "files",
    f"""SELECT file_id, repo, path, content FROM code_files
        UNION ALL SELECT doc_id + 2000000000000, 'documents', 'docs/d' || doc_id || '.' || {_DOC_EXT}, text FROM documents
        UNION ALL SELECT page_id + 3000000000000, 'pages', 'pages/p' || page_id || '.html', replace(html, '>', '>' || chr(10)) FROM pages
        UNION ALL SELECT conv_id * 1000000 + turn + 4000000000000, 'conversations', 'talk/c' || conv_id || '/t' || turn || '.md', text FROM conversations""",
    "code_files",
)
cte(
    "kept",
    f"""SELECT * FROM files WHERE NOT list_has_any(array_pop_back(string_split(path, '/')), {q(dims.IGNORED_DIRS)})""",
    "files",
)
cte(
    "src",
    f"""SELECT k.file_id, k.repo, k.path, k.content AS text, k.base, l.*, k.base IN ({', '.join(map(q, dims.EXEMPT_FILES))}) AS is_exempt
        FROM (SELECT *, string_split(path, '/')[-1] AS base FROM kept) k
        JOIN languages l ON l.ext = CASE WHEN contains(k.base, '.') THEN lower(string_split(k.base, '.')[-1]) ELSE '' END""",
    "kept", "languages",
)

# --- lines -----------------------------------------------------------------------------------

_SCRIPT_TYPE = (
    r"""(?i)\btype\s*=\s*["']?(?:application/(?:json|ld\+json)|text/(?:template|html|x-template)|importmap)["']?[^>]*>"""
)
cte(
    "raw_lines",
    """SELECT file_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS n
       FROM (SELECT file_id, CASE WHEN text = '' THEN []::VARCHAR[]
                    ELSE string_split(CASE WHEN ends_with(text, chr(10)) THEN left(text, length(text) - 1) ELSE text END, chr(10)) END AS ls
             FROM src)""",
    "src",
)
cte(
    "tagged",
    f"""SELECT r.file_id, r.n, r.line, {strip('r.line')} AS stripped, s.lang, s.singles, s.starts, s.ends, s.is_logic, s.family, s.import_kind,
        s.lang = 'HTML' AS html,
        CASE WHEN s.lang = 'HTML' AND len(list_filter(regexp_extract_all(r.line, '(?i)<script\\b[^>]*>'),
                 lambda t: NOT regexp_matches(t, '(?i)\\bsrc\\s*=') AND NOT regexp_matches(t, {q(_SCRIPT_TYPE)}))) > 0 THEN 1
             WHEN s.lang = 'HTML' AND regexp_matches(r.line, '(?i)</script\\s*>') THEN 0 END AS tag
        FROM raw_lines r JOIN src s USING (file_id)""",
    "raw_lines", "src",
)
cte(
    "moded",
    """SELECT *, html AND coalesce(last_value(tag IGNORE NULLS) OVER (PARTITION BY file_id ORDER BY n
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS in_script FROM tagged""",
    "tagged",
)
cte(
    "tokens",
    """SELECT *, CASE WHEN in_script THEN ['/*'] ELSE starts END AS st, CASE WHEN in_script THEN ['*/'] ELSE ends END AS en,
              CASE WHEN in_script THEN ['//'] ELSE singles END AS si FROM moded""",
    "moded",
)
cte(
    "opened",
    """SELECT *, tag IS NULL AND len(list_filter(en, lambda t: contains(stripped, t))) > 0 AS e,
              CASE WHEN tag IS NULL THEN list_filter(st, lambda t: contains(stripped, t))[1] END AS first_start FROM tokens""",
    "tokens",
)
cte(
    "blocks",
    """SELECT *, first_start IS NOT NULL
              AND len(list_filter(en, lambda t: contains(substr(stripped, strpos(stripped, first_start) + length(first_start)), t))) = 0 AS u
       FROM opened""",
    "opened",
)
cte(
    "swaps",
    "SELECT *, sum((u AND e)::INT) OVER (PARTITION BY file_id ORDER BY n) AS swap_count FROM blocks",
    "blocks",
)
cte(
    "stated",
    """SELECT *, (coalesce(last_value(CASE WHEN u <> e THEN u::INT END IGNORE NULLS) OVER w, 0)
                  + coalesce(last_value(swap_count) OVER w, 0)
                  - coalesce(last_value(CASE WHEN u <> e THEN swap_count END IGNORE NULLS) OVER w, 0)) % 2 = 1 AS in_comment
       FROM swaps WINDOW w AS (PARTITION BY file_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
    "swaps",
)
cte(
    "lines",
    """SELECT *, CASE WHEN tag IS NOT NULL THEN 'T' WHEN stripped = '' THEN 'B' WHEN in_comment OR first_start IS NOT NULL THEN 'C'
                     WHEN len(list_filter(si, lambda t: starts_with(stripped, t))) > 0 THEN 'C'
                     WHEN length(stripped) = 1 AND contains('{}[]();,', stripped) THEN 'P' ELSE 'K' END AS kind
       FROM stated""",
    "stated",
)
_BRANCH = {
    "C-Family": r"\b(?:if|else|for|while|switch|case|catch|try)\b|&&|\|\|",
    "Go": r"\b(?:if|else|for|select|case|default)\b|&&|\|\|",
    "Rust": r"\b(?:if|else|for|while|loop|match|None|Some|Err|Ok)\b|&&|\|\|",
    "Lua": r"\b(?:if|else|elseif|for|while|repeat)\b|\band\b|\bor\b",
}
_HALF = {"C-Family": r"\b(?:case|else)\b", "Go": r"\b(?:case|default|else)\b", "Rust": r"\belse\b", "Lua": r"\belse\b"}
_IMPORT = {
    "import": r"^import\s+",
    "script": r"^(?:import|require|export.*from)\s+",
    "include": r"^#include",
    "rust": r"^(?:use|mod|extern crate|pub use)\s+",
    "php": r"^(?:require|include|use)\s+",
}
_LITERAL = r'"(?:[^"\\]|\\.)*"|' + r"'(?:[^'\\]|\\.)*'"
cte(
    "clean",
    f"""SELECT *, CASE WHEN lang = 'PHP' THEN regexp_replace(b, '(//|#).*$', '') WHEN lang = 'Lua' THEN regexp_replace(b, '--.*$', '')
                       ELSE regexp_replace(b, '//.*$', '') END AS cleaned
        FROM (SELECT *, kind IN ('P', 'K') AND (in_script OR is_logic) AS logic,
                     CASE WHEN html THEN 'C-Family' ELSE family END AS fam, CASE WHEN html THEN 'script' ELSE import_kind END AS imp,
                     regexp_replace(stripped, {q(_LITERAL)}, '""', 'g') AS b FROM lines)""",
    "lines",
)


def _per(key: str, patterns: dict, expr: str, make) -> str:
    return f"CASE {key} " + " ".join(f"WHEN {q(k)} THEN {make(expr, p)}" for k, p in patterns.items()) + " ELSE 0 END"


_WORDS = "ascii"
cte("worded", f"SELECT *, {ascii_words('cleaned')} AS ascii FROM clean", "clean")
cte(
    "line_facts",
    f"""SELECT *, CASE WHEN logic THEN {_per('fam', _BRANCH, _WORDS, hits)} - 0.5 * {_per('fam', _HALF, _WORDS, hits)} ELSE 0 END AS cc,
        CASE WHEN kind IN ('P', 'K') THEN list_reduce(string_split(regexp_extract(line, '^[{WS}]*'), ''),
             lambda w, c: CASE WHEN c = chr(9) THEN (w // 4 + 1) * 4 WHEN c = '' THEN w ELSE w + 1 END, 0) // 4 END AS depth,
        CASE WHEN logic AND ({' OR '.join(f"(imp = {q(k)} AND regexp_matches(stripped, {q(p)}))" for k, p in _IMPORT.items())})
             THEN stripped END AS import_line
        FROM worded""",
    "worded",
)

# --- syntax trees from weights ---------------------------------------------------------------

cte(
    "ast_nodes",
    """SELECT r.file_id, n.kind, n.arity, n.docstring, sum(n.n)::BIGINT AS n FROM code_rows r JOIN template_nodes n USING (family, k)
       GROUP BY ALL
       UNION ALL SELECT DISTINCT file_id, 'Module', 1, false, 1 FROM code_rows WHERE family = 'py'""",
    "code_rows", "template_nodes",
)
cte(
    "ast",
    """SELECT file_id,
       floor(1.5 + sum(n * CASE WHEN kind IN ('If', 'For', 'AsyncFor', 'While', 'IfExp') THEN 1
             WHEN kind IN ('ListComp', 'SetComp', 'DictComp', 'GeneratorExp') THEN arity WHEN kind = 'Try' THEN 1
             WHEN kind = 'BoolOp' THEN arity - 1 WHEN kind = 'Match' THEN CASE WHEN arity <= 3 THEN 1 ELSE arity * 0.5 END ELSE 0 END)) AS cc,
       sum(n * CASE WHEN kind IN ('Import', 'ImportFrom') THEN arity ELSE 0 END) AS imports,
       sum(n * docstring::INT) AS docstrings
       FROM ast_nodes GROUP BY file_id""",
    "ast_nodes",
)

# --- file metrics ----------------------------------------------------------------------------

cte(
    "counts",
    """SELECT file_id, count(*) AS total, count(*) FILTER (kind = 'K') AS code, count(*) FILTER (kind = 'C') AS comments,
       count(*) FILTER (kind IN ('T', 'B', 'P')) AS boilerplate, count(*) FILTER (logic) AS logic_lines,
       count(DISTINCT import_line) AS imports, coalesce(max(depth) FILTER (logic), 0) AS depth, trunc(1 + sum(cc)) AS cc
       FROM line_facts GROUP BY file_id""",
    "line_facts",
)
cte(
    "measures",
    """SELECT s.file_id, s.repo, s.path, s.is_logic, s.is_exempt, s.extractor,
       CASE WHEN s.lang = 'HTML' AND coalesce(c.logic_lines, 0) >= 5 THEN 'HTML+JS' ELSE s.lang END AS lang,
       a.file_id IS NOT NULL AND s.lang = 'Python' AS ast_ok,
       coalesce(c.total, 0) AS total, coalesce(c.code, 0) AS code, coalesce(c.comments, 0) AS comments,
       coalesce(c.boilerplate, 0) AS boilerplate, coalesce(c.logic_lines, 0) AS logic_lines,
       coalesce(a.imports, c.imports, 0) AS imports, CASE WHEN a.file_id IS NULL THEN coalesce(c.depth, 0) ELSE 0 END AS max_nesting,
       coalesce(a.cc, c.cc, 1) AS complexity, coalesce(a.docstrings, 0) AS docstrings
       FROM src s LEFT JOIN counts c USING (file_id) LEFT JOIN (SELECT ast.* FROM ast JOIN src USING (file_id) WHERE lang = 'Python') a USING (file_id)""",
    "src", "counts", "ast",
)
cte(
    "metrics",
    """SELECT *, CASE WHEN NOT scored THEN 0 ELSE trunc(
            ((CASE WHEN is_logic THEN total ELSE logic_lines END) / 50.0::DOUBLE
             + CASE WHEN complexity = 0 THEN greatest(max_nesting - 4, 0) * 12.0::DOUBLE ELSE greatest(0, complexity - 10) * 1.5::DOUBLE END
             + imports * 1.5::DOUBLE)
            * (1.0::DOUBLE - least(CASE WHEN base > 0 THEN comments / base ELSE 0 END, 0.4::DOUBLE))) END AS debt_score,
       CASE WHEN NOT scored THEN -1 ELSE greatest(0, least(100, trunc(100.0::DOUBLE - greatest(0, complexity - 15)
            - CASE WHEN total > lim THEN (total - lim) / 20.0::DOUBLE ELSE 0 END
            + CASE WHEN ratio >= 0.1::DOUBLE AND ratio <= 0.3::DOUBLE THEN 5 ELSE 0 END))) END AS quality_score
       FROM (SELECT *, is_logic OR logic_lines >= 5 AS scored, CASE WHEN is_logic THEN 300 ELSE 500 END AS lim,
                    CASE WHEN NOT is_logic AND logic_lines > 0 THEN logic_lines ELSE total END AS base,
                    CASE WHEN total > 0 THEN comments::DOUBLE / total ELSE 0 END AS ratio FROM measures)""",
    "measures",
)
