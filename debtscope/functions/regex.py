r"""Java regular expressions used by the operators.

Patterns are written with the usual shorthands and expanded by :func:`rx` into explicit
classes, because ``\w``, ``\s`` and ``\d`` mean different things in Java and in the text
model the results are defined on (Unicode letters, numbers and underscore; Unicode white
space including the four separators U+001C..U+001F).  Word boundaries are written as
look-around on ``\w``.  Quantified groups over arbitrary text are possessive wherever that
keeps the matches, so that long runs neither backtrack nor grow the Java stack.
"""

from __future__ import annotations

WORD = r"\p{L}\p{N}_"
SPACE = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: The same white space as literal characters, for ``btrim`` / ``ltrim``.
SPACE_CHARS = (
    "".join(map(chr, range(0x09, 0x0E)))
    + "".join(map(chr, range(0x1C, 0x21)))
    + "\x85\xa0\u1680"
    + "".join(map(chr, range(0x2000, 0x200B)))
    + "\u2028\u2029\u202f\u205f\u3000"
)

_SHORTHAND = {"w": WORD, "s": SPACE, "d": r"\p{Nd}"}


def rx(pattern: str, flags: str = "") -> str:
    r"""Expand ``\w \s \S \d`` in ``pattern`` and prefix the flags (``\n`` is the only line end)."""
    out, in_class, i = [], False, 0
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\":
            short = pattern[i + 1]
            if short in _SHORTHAND:
                body = _SHORTHAND[short]
                out.append(body if in_class else f"[{body}]")
            elif short == "S":
                out.append(f"[^{SPACE}]")
            else:
                out.append(ch + short)
            i += 2
            continue
        if ch == "[":
            in_class = True
        elif ch == "]":
            in_class = False
        out.append(ch)
        i += 1
    return f"(?d{flags})" + "".join(out)


def words(alternatives: str, first: str) -> str:
    """Whole-word alternation; ``first`` lists the first letters and lets most positions fail fast."""
    return rf"(?=[{first}])(?<!\w)(?:{alternatives})(?!\w)"


# --- fixed values: comment, complexity and import patterns ---------------------------------

#: String literals; never cross a line.
LITERAL = rx(r'"(?:[^"\\\n]|\\[^\n])*+"|\'(?:[^\'\\\n]|\\[^\n])*+\'')

#: Branch keywords and operators per language family.
BRANCHES = {
    "C-Family": rx(words("if|else|for|while|switch|case|catch|try", "ifewsct") + r"|&&|\|\|"),
    "Go": rx(words("if|else|for|select|case|default", "ifescd") + r"|&&|\|\|"),
    "Rust": rx(words("if|else|for|while|loop|match|None|Some|Err|Ok", "ifewlmNSEO") + r"|&&|\|\|"),
    "Lua": rx(words("if|else|elseif|for|while|repeat|and|or", "ifewrao")),
}
#: Branch words that weigh one half.
HALF_BRANCHES = ("case", "default", "else")

#: Inline comment per family or language, cut after the literals were blanked.
INLINE_COMMENT = {
    "PHP": rx(r"(?://|#)[^\n]*"),
    "Lua": rx(r"--[^\n]*"),
    None: rx(r"//[^\n]*"),
}

#: Import statements, matched on stripped lines joined by newlines; ``\n`` is kept out of the
#: white space so that a statement never borrows it from the next line.
_GAP = r"(?:(?!\n)\s)+"
_HEAD = r"^(?:(?!\n)\s)*"
IMPORTS = {
    "import": rx(_HEAD + "import" + _GAP + r"[^\n]*", "m"),
    "script": rx(_HEAD + r"(?=(?:import|require|export[^\n]*from)" + _GAP + r")[^\n]*", "m"),
    "include": rx(_HEAD + r"#include[^\n]*", "m"),
    "rust": rx(_HEAD + "(?:use|mod|extern crate|pub use)" + _GAP + r"[^\n]*", "m"),
    "php": rx(_HEAD + "(?:require|include|use)" + _GAP + r"[^\n]*", "m"),
}

#: Inline-script tags of HTML: no external source, no data or template type.
SCRIPT_OPEN = rx(
    r"<script(?!\w)"
    r"(?![^>]*(?<!\w)src\s*=)"
    r"(?![^>]*(?<!\w)type\s*=\s*[\"']?(?:application/(?:json|ld\+json)|text/(?:template|html|x-template)|importmap)[\"']?[^>]*>)"
    r"[^>]*>",
    "iu",
)
SCRIPT_CLOSE = rx(r"</script\s*>", "iu")

# --- fixed values: smell patterns, in detector order ---------------------------------------

SMELL_PATTERNS = {
    "deep_nesting": rx(r"^(?:\t{5,}|[ ]{20,})\S", "m"),
    "magic_number": rx(
        r"(?=[-\d])(?<![\"'\w])(?!-?[012](?!\w))-?\d{2,}(?:\.\d+)?(?![\"'\w])|0x[0-9a-fA-F]{4,}"
    ),
    "long_param_list": rx(
        r"(?:def|function|func)\s+\w+\s*\([^)]{80,}\)"
        r"|(?:public|private|protected)\s+\w+\s+\w+\s*\([^)]{80,}\)"
    ),
    "duplicate_string": rx(r"([\"'][^\"']{10,}[\"'])(?:.{0,2000}?)\1"),
    "print_debug": rx(
        r"(?=[pcsfvd])(?<!\w)(?:print|console\.log|System\.out\.print|fmt\.Print|var_dump|dd)\s*\(", "iu"
    ),
    "todo_fixme": rx(r"(?:#|//|/\*)\s*(?:TODO|FIXME|XXX|HACK|BUG)(?!\w)", "iu"),
    "bare_except": rx(r"(?<!\w)except\s*:\s*$", "m"),
    "hardcoded_path": rx(r"[\"'](?:[A-Za-z]:\\|/(?:home|usr|var|etc|opt|tmp)/)"),
    "commented_code": rx(
        r"(?:#|//)\s*(?:if|for|def|class|return|import|function|var|let|const)\s+\w+"
    ),
}

#: Function definitions that delimit ranges for the smell locations, in any language.
DEF_LINE = rx(r"^(?: {4})*def\s+(\w+)\s*\(", "m")

# --- fixed values: function and class patterns per extractor --------------------------------

#: Keeps a match from starting inside a run of white space, which never changes the leftmost match.
_RUN = r"(?:(?<!\s)|(?!\s))"


def _modified(*names: str) -> tuple[str, str]:
    """Where a definition with modifiers may start, and the modifiers in front of its type and name.

    A run of modifiers is walked possessively, so it costs no stack; only the last words, which
    may be type and name, are given back.  A match that starts in white space or right behind a
    modifier would have started earlier, so no other start is tried inside a run.
    """
    start = r"(?<!\s)" + "".join(f"(?<!{name})" for name in names)
    word = f"(?:{'|'.join(names)})++"
    one = rf"\s*+{word}"
    ends = rf"(?:{one}(?=\s))"
    return start, rf"(?:{one}(?=\s++{word}\s++{word}(?!\w)))++{ends}{{0,3}}|{ends}{{1,3}}"


_JAVA, _JAVA_MODIFIERS = _modified("public", "private", "protected", "static")
_SHARP, _SHARP_MODIFIERS = _modified("public", "private", "protected", "internal", "static", "async", "virtual", "override")

#: What stands for an opening or line end that no match goes on from: a round one, a line end, a
#: colon, an angle and the round one of a receiver (see ``functions.openings``).
MASKS = "\ufdd2\ufdd3\ufdd4\ufdd5\ufdd6"
#: What follows the closing parenthesis of a definition, where anything has to.
FUNCTION_TAILS = {
    "Python": None,
    "JavaScript": rx(r"\s*+=>").removeprefix("(?d)"),
    "TypeScript": rx(r"\s*+(?::\s*+\w++)?+\s*+\{").removeprefix("(?d)"),
    "Java": rx(r"\s*+(?:throws\s++[\w,\s]++)?+\{").removeprefix("(?d)"),
    "C": rx(r"\s*+\{").removeprefix("(?d)"),
    "C++": rx(r"\s*+(?:const\s*+)?+(?:override\s*+)?+\{").removeprefix("(?d)"),
    "C#": None,
    "PHP": None,
    "Go": None,
}
#: What follows type arguments, and the receiver of a method.
GENERIC_TAIL = rx(r"\s++\w++\s*+\(").removeprefix("(?d)")
RECEIVER_TAIL = rx(r"\s*+\w++\s*+\(").removeprefix("(?d)")

FUNCTION_PATTERNS = {
    "Python": rx(r"^ *+(?:async\s++)?+def\s++(\w++)\s*+\([^)]*+\)", "m"),
    "JavaScript": rx(
        r"function\s++(\w++)|(?:const|let|var)\s++(\w++)\s*+=\s*+(?:async\s++)?+(?:function|\([^)]*+\)\s*+=>)"
    ),
    "TypeScript": rx(
        r"function\s++(\w++)|(?:const|let|var)\s++(\w++)\s*+(?::[^=]++)?+="
        r"|(?<!\w)(\w++)\s*+\([^)]*+\)\s*+(?:[:\ufdd4]\s*+\w++)?+\s*+\{"
    ),
    "Java": rx(
        _JAVA + rf"(?:(?:{_JAVA_MODIFIERS})\s++|\s{{2,}}+)"
        r"\w++(?:<[^>]*+>)?+\s++(\w++)\s*+\([^)]*+\)\s*+(?:throws\s++[\w,\s]++)?+\{"
    ),
    "C": rx(r"^\w(?=[\w\s\*]++\()[\w\s\*]+\s+(\w+)\s*+\([^)]*+\)[\s\ufdd3]*+\{", "m"),
    "C++": rx(r"(?<!\w)(?:(?<![\w:])[\w:]++\s++)?(\w++)\s*+\([^)]*+\)\s*+(?:const\s*+)?+(?:override\s*+)?+\{"),
    "C#": rx(
        _SHARP + rf"(?:(?:{_SHARP_MODIFIERS})\s++|\s{{2,}}+)"
        r"\w++(?:<[^>]*+>)?+\s++(\w++)\s*+\([^)]*+\)"
    ),
    "PHP": rx(_JAVA + r"(?:\s*+(?:public|private|protected|static))*+\s*+function\s++(\w++)\s*+\([^)]*+\)"),
    "Go": rx(r"func\s++(?:\([^)]*+\)\s*+)?+(\w++)\s*+[(\ufdd6][^)]*+\)"),
    "Rust": rx(r"(?:pub\s+)?(?:async\s+)?fn\s+(\w+)"),
    "Kotlin": rx(r"(?:fun|suspend\s+fun)\s+(\w+)\s*\("),
    "Lua": rx(r"(?:local\s+)?function\s+(\w+)\s*\(|(?<!\w)(\w+)\s*=\s*function\s*\("),
}
#: Capture groups that may hold the function name.
FUNCTION_NAME_GROUPS = {"JavaScript": 2, "TypeScript": 3, "Lua": 2}

CLASS_PATTERNS = {
    "Python": rx(r"^( *)class\s+(\w+)", "m"),
    "JavaScript": rx(r"class\s+(\w+)"),
    "TypeScript": rx(r"class\s+(\w+)"),
    "Java": rx(_RUN + r"(?:public|private|protected)?\s*+(?:abstract\s*+)?class\s+(\w+)"),
    "C++": rx(r"class\s+(\w+)"),
    "C#": rx(_RUN + r"(?:public|private|protected|internal)?\s*+(?:(?:partial|abstract|sealed)\s*+)?class\s+(\w+)"),
    "PHP": rx(r"class\s+(\w+)"),
    "Rust": rx(r"(?:pub\s+)?(?:struct|enum|trait)\s+(\w+)"),
    "Kotlin": rx(r"(?:class|object|interface)\s+(\w+)"),
}
#: Capture group of the class name where it is not the first one.
CLASS_NAME_GROUPS = {"Python": 2}

#: Decision keywords of the function-level complexity; the operators only count between words.
FUNCTION_BRANCHES = rx(
    words("if|else|elif|for|while|switch|case|catch|except|try|and|or", "ifewscetao")
    + r"|(?:&&|\|\|)(?<=\w(?:&&|\|\|))(?=\w)"
)

#: What the brace matcher looks at: escapes, quoted text (may span lines, may stay open) and
#: braces, each with the plain text in front of it; the rest of a text is the last one.
BRACE_STRETCHES = (
    r"[^\\\"'{}]*+(?:\\[\s\S]?|\"(?:[^\"\\]|\\[\s\S]?)*+(?:\"|\z)|'(?:[^'\\]|\\[\s\S]?)*+(?:'|\z)|[{}]|\z)"
)
