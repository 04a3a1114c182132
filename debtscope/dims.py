"""Dimension tables: languages, thresholds, advice and labels.

All of them are fixed and small (at most some 150 short rows), which is what makes the
broadcast joins on them safe at any corpus size.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, types as T
from pyspark.sql.pandas.types import to_arrow_schema

# --- fixed values: language definitions ----------------------------------------------------
# extension, language, single-line tokens, block starts, block ends, logic language,
# complexity family, import pattern, function extractor

_C_LIKE = (["//"], ["/*"], ["*/"], True)
_TRIPLE = ['"""', "'''"]

LANGUAGES = [
    ("py", "Python", ["#"], _TRIPLE, _TRIPLE, True, None, None, "Python"),
    ("js", "JavaScript", *_C_LIKE, "C-Family", "script", "JavaScript"),
    ("ts", "TypeScript", *_C_LIKE, "C-Family", "script", "TypeScript"),
    ("jsx", "React", *_C_LIKE, "C-Family", None, "JavaScript"),
    ("tsx", "React TS", *_C_LIKE, "C-Family", None, "JavaScript"),
    ("java", "Java", *_C_LIKE, "C-Family", "import", "Java"),
    ("c", "C", *_C_LIKE, "C-Family", "include", "C"),
    ("cpp", "C++", *_C_LIKE, "C-Family", "include", "C++"),
    ("h", "C/C++ Header", *_C_LIKE, None, None, None),
    ("hpp", "C++ Header", *_C_LIKE, None, None, None),
    ("cs", "C#", *_C_LIKE, "C-Family", None, "C#"),
    ("go", "Go", *_C_LIKE, "Go", "import", "Go"),
    ("rs", "Rust", ["//", "///", "//!"], ["/*"], ["*/"], True, "Rust", "rust", "Rust"),
    ("kt", "Kotlin", *_C_LIKE, "C-Family", "import", "Kotlin"),
    ("kts", "Kotlin Script", *_C_LIKE, "C-Family", "import", None),
    ("rb", "Ruby", ["#"], ["=begin"], ["=end"], True, None, None, None),
    ("php", "PHP", ["//", "#"], ["/*"], ["*/"], True, "C-Family", "php", "PHP"),
    ("lua", "Lua", ["--"], ["--[["], ["]]"], True, "Lua", None, "Lua"),
    ("html", "HTML", [], ["<!--"], ["-->"], False, None, None, None),
    ("css", "CSS", [], ["/*"], ["*/"], False, None, None, None),
    ("scss", "SCSS", ["//"], ["/*"], ["*/"], False, None, None, None),
    ("md", "Markdown", [], ["<!--"], ["-->"], False, None, None, None),
    ("sh", "Shell", ["#"], [], [], False, None, None, None),
    ("ps1", "PowerShell", ["#"], ["<#"], ["#>"], False, None, None, None),
]

_LANGUAGE_SCHEMA = (
    "ext string, lang string, single array<string>, block_start array<string>, block_end array<string>, "
    "is_logic boolean, family string, import_kind string, extractor string"
)

# --- fixed values: pruned directories and exempt file names --------------------------------

IGNORED_DIRS = [
    ".git", "node_modules", "venv", ".venv", "__pycache__", "dist", "build", ".next", ".nuxt", "migrations",
]
EXEMPT_FILES = ["__init__.py", "index.js", "index.ts", "mod.rs", "package.go"]

# --- fixed values: diagnosis thresholds ----------------------------------------------------

HIGH_COMPLEXITY = 25
HIGH_NESTING = 5
HIGH_COUPLING = 15
LONG_FILE = 300
LOW_COMMENT_RATIO = 0.05
LONG_FUNCTION = 50
LONG_LINE = 120

# --- fixed values: advice per problem ------------------------------------------------------
# key, locale, diagnosis, suggestions

ADVICE = [
    ("high_complexity", "zh", "圈复杂度过高", [
        "▸ 提取子函数：将复杂逻辑拆分为单一职责的小函数",
        "▸ 使用 Guard Clauses：提前 return 减少嵌套",
        "▸ 策略模式：用字典或类替代 switch/if-else 链"]),
    ("high_nesting", "zh", "嵌套层级过深", [
        "▸ 提前返回：用 Guard Clauses 扁平化逻辑",
        "▸ 提取方法：将深层逻辑移到独立函数"]),
    ("high_coupling", "zh", "模块耦合度高", [
        "▸ 依赖注入：将依赖通过参数传入",
        "▸ 模块拆分：按功能领域拆分为独立模块"]),
    ("long_file", "zh", "文件过长", [
        "▸ 按职责拆分：一个文件一个核心职责",
        "▸ 分层架构：拆分为 Controller/Service/Repository"]),
    ("low_comment", "zh", "注释严重不足", [
        "▸ 添加模块 docstring：说明模块职责",
        "▸ 函数注释：说明参数、返回值、异常"]),
    ("high_complexity", "en", "High Cyclomatic Complexity", [
        "▸ Extract sub-functions: Split complex logic into single-responsibility functions",
        "▸ Use Guard Clauses: Early returns to reduce nesting",
        "▸ Strategy Pattern: Use dict or classes instead of switch/if-else chains"]),
    ("high_nesting", "en", "Deep Nesting", [
        "▸ Return early: Flatten the logic with guard clauses",
        "▸ Extract methods: Move deep logic into functions of its own"]),
    ("high_coupling", "en", "High Module Coupling", [
        "▸ Dependency Injection: Pass dependencies as parameters",
        "▸ Split modules: One module per area of function"]),
    ("long_file", "en", "Long File", [
        "▸ Split by Responsibility: One core responsibility per file",
        "▸ Layer the code: Separate controllers, services and repositories"]),
    ("low_comment", "en", "Insufficient Comments", [
        "▸ Add module docstring: Describe module purpose",
        "▸ Comment functions: Describe parameters, results and exceptions"]),
]

# --- fixed values: smells in detector order ------------------------------------------------
# number, key, English name, English suggestion, Chinese name, Chinese suggestion

SMELLS = [
    (1, "deep_nesting", "Deep Nesting", "", "深度嵌套", ""),
    (2, "magic_number", "Magic Number", "Extract as named constant", "魔法数字", "提取为命名常量"),
    (3, "long_param_list", "Long Parameter List", "Consider using data class or dict", "过长参数列表", "考虑使用数据类或字典封装"),
    (4, "duplicate_string", "Duplicate String", "Extract as constant", "重复字符串", "提取为常量"),
    (5, "print_debug", "Debug Code Residue", "Remove or replace with proper logging", "调试代码残留", "移除或替换为正式日志"),
    (6, "todo_fixme", "TODO/FIXME Marker", "Handle or create tracking issue", "未完成标记", "处理或创建 issue 跟踪"),
    (7, "bare_except", "Bare Except", "Catch specific exception types", "裸 except", "明确捕获特定异常类型"),
    (8, "hardcoded_path", "Hardcoded Path", "Use config file or environment variable", "硬编码路径", "使用配置文件或环境变量"),
    (9, "commented_code", "Commented Code", "Delete or use version control", "注释掉的代码", "删除或使用版本控制"),
    (10, "long_lines", "Long Code Lines", "Split or format", "过长代码行", "拆分或格式化"),
    (11, "long_function", "Long Function", "Split into smaller functions", "过长函数", "拆分为多个小函数"),
]

#: Detector names of the terminal view that carry their threshold.
SMELL_DISPLAY_ZH = {"long_lines": "过长代码行 (>120字符)", "long_function": "过长函数 (>50行)"}
SMELL_DISPLAY_EN = {"long_lines": "Long Code Lines (>120 characters)", "long_function": "Long Function (>50 lines)"}

# --- fixed values: labels ------------------------------------------------------------------
# key, English, Chinese; a key without Chinese text falls back to English

LABELS = [
    ("quality_metric", "Quality Metric", "质量指标"),
    ("total", "TOTAL", "合计"),
    ("project_index", "Project Quality Index", "项目代码质量指数"),
    ("total_lines", "Total Lines", "总行数"),
    ("boilerplate", "Boilerplate", "样板代码"),
    ("language", "Language", "语言"),
    ("files", "Files", "文件数"),
    ("lines", "Lines", "行数"),
    ("code", "Code", "代码"),
    ("comments", "Comments", "注释"),
    ("coupling", "Coupling", "耦合度"),
    ("avg_cc", "Avg-CC", "平均CC"),
    ("file_path", "File Path", "文件路径"),
    ("debt_score", "Debt Score", "债务分数"),
    ("quality_score", "Quality Score", "质量分数"),
    ("complexity", "Complexity", "复杂度"),
    ("imports", "Imports", "导入数"),
    ("legendary", "LEGENDARY 🏆", "传奇 🏆"),
    ("solid", "SOLID 💎", "稳健 💎"),
    ("average", "AVERAGE 🚧", "一般 🚧"),
    ("shaky", "SHAKY 🏚️", "脆弱 🏚️"),
    ("toxic", "TOXIC ☢️", "有毒 ☢️"),
    ("top_files", "🏔️ TOP 10 DEBT FILES (Logic Complexity)", None),
    ("refactor_advisor", "🔧 REFACTOR ADVISOR (Heuristic Scan)", "🔧 重构建议 (启发式扫描)"),
    ("exempted_aggregators", "🛡️ EXEMPTED AGGREGATORS (High Complexity but Allowed)", "🛡️ 豁免的聚合文件 (高复杂度但允许)"),
    ("code_quality_report", "Code Quality Report", "代码质量报告"),
    ("generated_by", "Generated from the file metrics table", None),
    ("file_analysis", "File Analysis", "文件分析"),
    ("problem_diagnosis", "Problem Diagnosis", "问题诊断"),
    ("complexity_hotspots", "Complexity Hotspot Functions", "复杂度热点函数"),
    ("code_smells", "Code Smells", "代码异味"),
    ("function_name", "Function", "函数名"),
    ("line_no", "Line", "行号"),
    ("nesting", "Nesting", "嵌套"),
    ("hint_split", "└ Split into several functions with one responsibility each", "└ 拆分为多个子函数，每个函数单一职责"),
    ("hint_extract", "└ Extract repeated logic into functions", "└ 提取重复逻辑为独立函数"),
    ("hint_guard", "└ Use Guard Clauses to return early", "└ 使用 Guard Clauses 提前返回"),
    ("hotspot_title", "▼ Complexity hotspot functions:", "▼ 复杂度热点函数:"),
    ("smell_title", "▼ Code smells:", "▼ 代码异味检测:"),
]

LOCALES = ("en", "zh")


def local_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A fixed table as a local relation, whose exact size the optimizer knows."""
    arrow = to_arrow_schema(T.StructType.fromDDL(schema))
    columns = [pa.array(list(values), field.type) for values, field in zip(zip(*rows), arrow)]
    return spark.createDataFrame(pa.Table.from_arrays(columns, schema=arrow), schema)


def languages(spark: SparkSession) -> DataFrame:
    """``lang_dim``: one row per file extension."""
    return local_table(spark, LANGUAGES, _LANGUAGE_SCHEMA)


def advice(spark: SparkSession) -> DataFrame:
    """``advice_dim``: diagnosis and suggestions per problem key and locale."""
    return local_table(spark, ADVICE, "key string, locale string, diagnosis string, suggestions array<string>")


def label_rows() -> list[tuple[str, str, str]]:
    """``(key, locale, text)`` for every label that has a text in that locale."""
    named = LABELS + [(key, en, zh) for _, key, en, _, zh, _ in SMELLS]
    named += [(key, diagnosis, None) for key, locale, diagnosis, _ in ADVICE if locale == "en"]
    rows = [(key, "en", en) for key, en, _ in named] + [(key, "zh", zh) for key, _, zh in named if zh]
    return rows + [(key, "zh", diagnosis) for key, locale, diagnosis, _ in ADVICE if locale == "zh"]


def spoken(locale: str) -> str:
    """The locale whose texts are shown: a locale without any text falls back to English."""
    return locale if any(own == locale for _, own, _ in label_rows()) else "en"


def labels(spark: SparkSession) -> DataFrame:
    """``label_dim``: display text per key and locale."""
    return local_table(spark, label_rows(), "key string, locale string, text string")


def smells(spark: SparkSession) -> DataFrame:
    """``smell_dim``: names and suggestions per detector and locale."""
    rows = [
        (no, key, locale, display.get(key, name), suggestion)
        for no, key, en, en_tip, zh, zh_tip in SMELLS
        for locale, name, suggestion, display in (
            ("en", en, en_tip, SMELL_DISPLAY_EN),
            ("zh", zh, zh_tip, SMELL_DISPLAY_ZH),
        )
    ]
    return local_table(
        spark, rows, "detector_no int, key string, locale string, display_name string, suggestion string"
    )
