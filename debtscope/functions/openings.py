"""Texts prepared so that function patterns scan them in linear time.

A pattern that looks from an opening to its closing and at what follows would do so again for
every opening in front of the same closing.  What follows is the same for all of them, so it is
looked at once per closing: the openings in front of a closing that no match goes on from are
replaced by :data:`MASKS`, at which a pattern stops at once.  Where the closing fits, the first
opening makes a match that runs over all others.  Most texts close what they open; a cheap gate
leaves those as they are, as a closing with few openings is looked at few times.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from debtscope.functions import text as X
from debtscope.functions.regex import FUNCTION_TAILS, GENERIC_TAIL, MASKS, RECEIVER_TAIL, rx

_ROUND, _LINE, _COLON, _ANGLE, _RECEIVER = MASKS
#: Stands for a closing that no match goes on from.
_DEAD = "\ufdd8"
#: So many openings or lines that one look-ahead may run over are enough to prepare a text.
_MANY = 64
_OPENINGS = rf"(?:\([^()]*+){{{_MANY}}}"
_ANGLES = rf"(?:<[^<>]*+){{{_MANY}}}"
_COLONS = rf"(?:(?:const|let|var)[^=:]*+:[^=]*?){{{_MANY}}}"
_WORD_LINES = rx(r"^(?:(?:(?!\n)[\w\s\*])*+\n){" + str(_MANY) + "}", "m")


def _behind_last(text: Column, closing: str, masked) -> Column:
    """Change what stands behind the last ``closing``."""
    rest = F.substring_index(text, closing, -1)
    return F.concat(F.left(text, F.length(text) - F.length(rest)), masked(rest))


def _where_dead(text: Column, closing: str, tail: str | None, masked) -> Column:
    """Change the stretches in front of closings that ``tail`` does not follow, and the one behind the last closing."""
    if tail is None:
        return _behind_last(text, closing, masked)
    told = F.regexp_replace(text, F.lit(rf"\{closing}(?!{tail})"), F.lit(_DEAD + closing))
    stretches = F.split(F.concat(told, F.lit(_DEAD)), rf"\{closing}", -1)
    return F.array_join(
        F.transform(stretches, lambda s: F.when(F.endswith(s, F.lit(_DEAD)), masked(F.left(s, F.length(s) - 1))).otherwise(s)), closing
    )


def _mask(opening: str, mask: str):
    return lambda text: F.translate(text, opening, mask)


def _heads_of_c(text: Column) -> Column:
    """Hide the line ends that no definition starts behind.

    A definition reaches its parenthesis over words, white space and stars only, and its name
    stands behind white space, so only the last such run in front of a parenthesis can hold one.
    """
    name = F.lit(rx(r"\s\w++\s*+\z"))
    run = rx(r"(?<![\w\s\*])[\w\s\*]++\z")
    hidden = _mask("\n", _LINE)

    def head(stretch: Column) -> Column:
        kept = F.when(F.rlike(stretch, name), F.regexp_extract(stretch, run, 0)).otherwise("")
        return F.concat(hidden(F.left(stretch, F.length(stretch) - F.length(kept))), kept)

    return _behind_last(F.array_join(F.transform(F.split(text, r"\(", -1), head), "("), "(", hidden)


def cleaned(text: Column) -> Column:
    """The text without any mask; few texts hold one, so the others are not gone through letter by letter."""
    clean = F.translate(text, MASKS + _DEAD, "\ufdd1" * (len(MASKS) + 1))
    return F.when(F.rlike(text, F.lit(f"[{MASKS}{_DEAD}]")), clean).otherwise(text)


def prepared(text: Column, extractor: str) -> Column:
    """The text as the function pattern of ``extractor`` scans it, of the same length; :func:`restored` undoes it."""
    clean = cleaned(text)
    if extractor not in FUNCTION_TAILS:
        return clean
    gate, out = _masked(clean, extractor)
    return F.when(gate, out).otherwise(clean)


def marked(clean: Column, extractor: str, pattern: str) -> Column:
    """Put marks in front of the matches in a :func:`cleaned` text, which is prepared and restored only where it has to be."""
    plain = X.put_marks(clean, pattern)
    if extractor not in FUNCTION_TAILS:
        return plain
    gate, out = _masked(clean, extractor)
    return F.when(gate, restored(X.put_marks(out, pattern))).otherwise(plain)


def _masked(clean: Column, extractor: str) -> tuple[Column, Column]:
    """Whether a text has to be prepared, and the text prepared."""
    gate = F.rlike(clean, F.lit(_OPENINGS))
    out = _where_dead(clean, ")", FUNCTION_TAILS[extractor], _mask("(", _ROUND))
    if extractor == "C":
        gate, out = gate | F.rlike(clean, F.lit(_WORD_LINES)), _heads_of_c(out)
    elif extractor in ("Java", "C#"):
        gate = gate | F.rlike(clean, F.lit(_ANGLES))
        out = _where_dead(out, ">", GENERIC_TAIL, _mask("<", _ANGLE))
    elif extractor == "Go":
        func = F.lit(rx(r"(func\s++)\("))
        out = _where_dead(out, ")", RECEIVER_TAIL, lambda s: F.regexp_replace(s, func, F.lit("$1" + _RECEIVER)))
    elif extractor == "TypeScript":
        gate = gate | F.rlike(F.substring_index(clean, "=", -1), F.lit(_COLONS))
        out = _behind_last(out, "=", _mask(":", _COLON))
    return gate, out


def restored(text: Column) -> Column:
    """A prepared text as it was."""
    return F.translate(text, MASKS, "(\n:<(")
