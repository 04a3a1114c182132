"""Score formulas and display labels."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _zero(value: Column) -> Column:
    return F.greatest(F.lit(0), value)


def is_scored(is_logic: Column, logic_lines: Column) -> Column:
    """Only logic languages, or files with at least five logic lines, get scores."""
    return is_logic | (logic_lines >= 5)


def debt_score(is_logic, logic_lines, total, comments, imports, complexity, max_nesting) -> Column:
    """Size, complexity and coupling, relieved by up to 40 % for comments; truncated."""
    size = F.when(is_logic, total).otherwise(logic_lines) / F.lit(50.0)
    depth = F.when(max_nesting > 4, (max_nesting - 4) * 12.0).otherwise(0.0)
    load = F.when(complexity == 0, depth).otherwise(_zero(complexity - 10) * 1.5)
    base = F.when(~is_logic & (logic_lines > 0), logic_lines).otherwise(total)
    ratio = F.when(base > 0, comments / base).otherwise(0.0)
    raw = (size + load + imports * 1.5) * (F.lit(1.0) - F.least(ratio, F.lit(0.4)))
    return F.when(is_scored(is_logic, logic_lines), raw.cast("int")).otherwise(0)


def quality_score(is_logic, logic_lines, total, comments, complexity) -> Column:
    """0..100, or -1 where the file is not scored."""
    limit = F.when(is_logic, 300).otherwise(500)
    length = F.when(total > limit, (total - limit) / F.lit(20.0)).otherwise(0.0)
    ratio = F.when(total > 0, comments / total).otherwise(0.0)
    bonus = F.when((ratio >= 0.1) & (ratio <= 0.3), 5.0).otherwise(0.0)
    raw = F.lit(100.0) - _zero(complexity - 15) * 1.0 - length + bonus
    clipped = F.greatest(F.lit(0), F.least(F.lit(100), raw.cast("int")))
    return F.when(is_scored(is_logic, logic_lines), clipped).otherwise(-1)


def all_mode_debt(is_logic, logic_lines, total, max_nesting, debt) -> Column:
    """Debt shown when every file is displayed: unscored files rank by size and depth."""
    shown = (total / 50 + (max_nesting - 4) * 10).cast("int")
    return F.when(~is_logic & (logic_lines < 5), shown).otherwise(debt)


# --- fixed values: label formats and band limits -------------------------------------------


def complexity_label(complexity, max_nesting, ast_ok) -> Column:
    """``AST:n`` or ``Rgx:n``; ``Dp:n`` where there is no complexity."""
    source = F.when(ast_ok, "AST:").otherwise("Rgx:")
    return F.when(complexity > 0, F.concat(source, complexity.cast("string"))).otherwise(
        F.concat(F.lit("Dp:"), max_nesting.cast("string"))
    )


def complexity_cell(complexity, max_nesting) -> Column:
    """``n`` or ``Dp:n``, as in the file table."""
    return F.when(complexity > 0, complexity.cast("string")).otherwise(
        F.concat(F.lit("Dp:"), max_nesting.cast("string"))
    )


def complexity_value(complexity, max_nesting) -> Column:
    return F.when(complexity > 0, complexity).otherwise(max_nesting).cast("string")


def complexity_type(complexity, ast_ok) -> Column:
    return F.when(ast_ok, "AST").when(complexity > 0, "Regex").otherwise("Depth")


def quality_text(quality) -> Column:
    return F.when(quality >= 0, quality.cast("string")).otherwise("--")


def debt_band(debt) -> Column:
    return F.when(debt > 80, "fail").when(debt > 40, "warn").otherwise("plain")


def quality_band(quality) -> Column:
    return (
        F.when(quality == -1, "plain").when(quality >= 80, "good").when(quality >= 50, "warn").otherwise("fail")
    )


def severity_band(severity) -> Column:
    return F.when(severity > 60, "fail").otherwise("warn")


def hotspot_band(complexity) -> Column:
    return F.when(complexity > 15, "fail").otherwise("warn")


def verdict_key(index) -> Column:
    return (
        F.when(index >= 90, "legendary")
        .when(index >= 80, "solid")
        .when(index >= 65, "average")
        .when(index >= 50, "shaky")
        .otherwise("toxic")
    )


def hint_key(complexity, length, nesting) -> Column:
    """Advice for a hotspot function, or null."""
    return F.when(complexity > 20, "hint_split").when(length > 50, "hint_extract").when(nesting > 4, "hint_guard")
