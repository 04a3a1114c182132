"""Advice lines for the worst files and per-file report sections.

All lines of a file are built as one array of ``section, item, part, line`` and unfolded once,
so a report reads the profile once.  The fixed texts are literal maps inside the expressions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from debtscope import dims
from debtscope.functions import scores as S
from debtscope.operators import ranking

KEYS = ["repo", "path", "debt_score"]


def _text(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def _number(value: Column) -> Column:
    return value.cast("string")


def _texts(pairs: list[tuple[str, object]]) -> Callable[[Column], Column]:
    """Look a fixed text up by key."""
    entries = [F.lit(key) if i == 0 else (F.array(*map(F.lit, value)) if isinstance(value, list) else F.lit(value)) for key, value in pairs for i in (0, 1)]
    table = F.create_map(*entries)
    return lambda key: F.try_element_at(table, key)


def _labels(locale: str) -> dict[str, str]:
    """Label texts of a locale, in English where it has none."""
    return {key: text for wanted in ("en", locale) for key, own, text in dims.label_rows() if own == wanted}


def _lines(section: int, item: Column, texts: Column) -> Column:
    """Number the non-null lines of one item."""
    return F.transform(
        F.array_compact(texts),
        lambda line, part: F.struct(F.lit(section).alias("section"), item.cast("int").alias("item"), part.alias("part"), line.alias("line")),
    )


def _items(section: int, rows: Column, lines: Callable[[Column], Column]) -> Column:
    """The lines of every element of an array column."""
    return F.flatten(F.transform(rows, lambda row, item: _lines(section, item, lines(row))))


def _title(section: int, shown: Column, *lines) -> Column:
    """Lines in front of a section's items, where it has any."""
    texts = F.array(*[x if isinstance(x, Column) else F.lit(x) for x in lines])
    return _lines(section, F.lit(-1), F.when(shown, texts).otherwise(F.array().cast("array<string>")))


def _unfolded(files: DataFrame, *sections: Column) -> DataFrame:
    return files.select(*KEYS, F.inline(F.concat(*sections)))


def _samples(lines: Column, most: int = 3) -> Column:
    return F.concat(F.array_join(F.slice(lines, 1, most), ", "), F.when(F.size(lines) > most, "...").otherwise(""))


def _line_samples(smell: Column) -> Column:
    return _samples(F.transform(smell["lines"], lambda n: F.concat(F.lit("L"), _number(n))))


def _problem_texts(locale: str):
    """Diagnosis and first two suggestions of a problem; an unknown key shows as itself."""
    rows = [(key, diagnosis, suggestions) for key, own, diagnosis, suggestions in dims.ADVICE if own == locale]
    diagnosis, tips = _texts([r[:2] for r in rows]), _texts([(r[0], list(r[2])) for r in rows])
    none = F.array().cast("array<string>")
    return lambda p: F.coalesce(diagnosis(p["key"]), p["key"]), lambda p: F.slice(F.coalesce(tips(p["key"]), none), 1, 2)


def _smell_texts(locale: str):
    """Shown name and suggestion of a smell."""
    shown = dims.SMELL_DISPLAY_ZH if locale == "zh" else dims.SMELL_DISPLAY_EN
    rows = [(key, zh, zh_tip) if locale == "zh" else (key, en, en_tip) for _, key, en, en_tip, zh, zh_tip in dims.SMELLS]
    name, tip = _texts([(key, shown.get(key, name)) for key, name, _ in rows]), _texts([(key, tip) for key, _, tip in rows])
    return lambda s: F.coalesce(name(s["key"]), s["key"]), lambda s: F.coalesce(tip(s["key"]), F.lit(""))


def top_file_advice(profile: DataFrame, show_all: bool = False, locale: str = "en", most: int = ranking.ADVISED_FILES) -> DataFrame:
    """Advice for the first five of the top ten: problems, hotspots and smells as text lines.

    The files are ranked first and only their rows are unfolded.  A locale without texts falls
    back to English.
    """
    locale = dims.spoken(locale)
    label = _labels(locale)
    top = ranking.top_files(profile, show_all).orderBy(*ranking.by_debt()).limit(most)
    unit = {"en": " lines", "zh": "行"}[locale]
    depth = {"en": ("nesting ", ""), "zh": ("嵌套", "层")}[locale]
    value = {"en": "value", "zh": "值"}[locale]
    diagnosis, tips = _problem_texts(locale)
    smell_name, smell_tip = _smell_texts(locale)
    hints = _texts([(key, label[key]) for key in ("hint_split", "hint_extract", "hint_guard")])

    def problem(p: Column) -> Column:
        head = _text("  ■ ", diagnosis(p), f" ({value}: ", p["value_text"], ")")
        return F.concat(F.array(head), F.transform(tips(p), lambda tip: F.concat(F.lit("    "), tip)))

    def function(f: Column) -> Column:
        head = _text("    🔥 ", f["name"], "() [L", _number(f["line"]), "] CC=", _number(f["complexity"]), ", ", _number(f["length"]),
                     unit, ", ", depth[0], _number(f["nesting"]), depth[1])
        hint = hints(S.hint_key(f["complexity"], f["length"], f["nesting"]))
        return F.array(head, F.concat(F.lit("      "), hint))

    def smell(s: Column) -> Column:
        place = F.when(F.size(s["formatted"]) > 0, _samples(s["formatted"])).otherwise(_line_samples(s))
        named = F.transform(s["details"], lambda d: F.concat(d["name"], F.lit("("), _number(d["length"]), F.lit(unit.strip() + ")")))
        detail = F.coalesce(F.concat(F.lit(" → "), F.array_join(named, ", ")), F.lit(""))
        head = _text("    ⚠ ", smell_name(s), " × ", _number(s["count"]), " [", place, "]", detail)
        return F.array(head, F.when(smell_tip(s) != "", F.concat(F.lit("      └ "), smell_tip(s))))

    has_functions, has_smells = F.size("functions") > 0, F.size("smells") > 0
    advised = (F.size("problems") > 0) | has_functions | has_smells
    heading = _text("📄 ", F.col("path"), f" ({label['debt_score']}: ", _number(F.col("debt_score")), ")")
    lines = _unfolded(
        top,
        _title(0, advised, heading),
        _items(1, F.col("problems"), problem),
        _title(2, has_functions, f"  {label['hotspot_title']}"),
        _items(2, F.slice("functions", 1, 3), function),
        _title(3, has_smells, f"  {label['smell_title']}"),
        _items(3, F.slice("smells", 1, 3), smell),
    )
    return lines.orderBy(*ranking.by_debt(), "section", "item", "part")


def reported(profile: DataFrame) -> DataFrame:
    """Files with something to say; low-debt files only when they have problems."""
    any_problem = F.size("problems") > 0
    anything = any_problem | (F.size("functions") > 0) | (F.size("smells") > 0)
    return profile.filter(anything & ((F.col("debt_score") >= 5) | any_problem))


def report_sections(profile: DataFrame, locale: str = "en", smells: bool = True) -> DataFrame:
    """Per-file report lines of every reported file, unsorted, with or without the smells; a locale without texts falls back to English."""
    locale = dims.spoken(locale)
    label = _labels(locale)
    diagnosis, tips = _problem_texts(locale)
    _, smell_tip = _smell_texts(locale)
    smell_label = _texts([(key, label[key]) for _, key, *_ in dims.SMELLS])

    def problem(p: Column) -> Column:
        marker = F.when(p["severity"] > 60, "🔴").otherwise("🟡")
        head = _text("- ", marker, " **", diagnosis(p), f"** ({label['complexity']}: ", p["value_text"], ")")
        return F.concat(F.array(head), F.transform(tips(p), lambda tip: F.concat(F.lit("  - "), F.replace(tip, F.lit("▸ "), F.lit("")))))

    def function(f: Column) -> Column:
        cells = [_number(f[name]) for name in ("line", "complexity", "length", "nesting")]
        return F.array(_text("| `", f["name"], "()` | L", cells[0], " | ", cells[1], " | ", cells[2], " | ", cells[3], " |"))

    def smell(s: Column) -> Column:
        tip = F.when(smell_tip(s) != "", F.concat(F.lit(" → "), smell_tip(s))).otherwise("")
        name = F.coalesce(smell_label(s["key"]), s["key"])
        return F.array(_text("- ⚠️ **", name, "** × ", _number(s["count"]), " [", _line_samples(s), "]", tip))

    header = [label[k] for k in ("function_name", "line_no")] + ["CC", label["lines"], label["nesting"]]
    measures = _text(f"**{label['debt_score']}:** ", _number(F.col("debt_score")), f" | **{label['complexity']}:** ", _number(F.col("complexity")),
                     f" | **{label['lines']}:** ", _number(F.col("total")))
    always = F.lit(True)
    smelt = [_title(3, F.size("smells") > 0, f"#### {label['code_smells']}", ""), _items(3, F.slice("smells", 1, 5), smell)] if smells else []
    return _unfolded(
        reported(profile),
        _title(0, always, _text("### 📄 `", F.col("path"), "`"), "", measures, ""),
        _title(1, F.size("problems") > 0, f"#### {label['problem_diagnosis']}", ""),
        _items(1, F.col("problems"), problem),
        _title(2, F.size("functions") > 0, f"#### {label['complexity_hotspots']}", "", "| " + " | ".join(header) + " |", "| --- | ---: | ---: | ---: | ---: |"),
        _items(2, F.slice("functions", 1, 5), function),
        *smelt,
        _title(4, always, "---", ""),
    )
