"""Patterns in their plain form, as the oracles and the tests state them; the engine has its own, in Java's dialect."""

# --- fixed values: smell patterns, in detector order ---------------------------------------
# RE2 runs all but two of them; those look around or back and are taken apart by the oracles.

SMELL_PATTERNS = {
    "deep_nesting": r"(?m)^(?:\t{5,}|[ ]{20,})[^\s]",
    "magic_number": r"""(?<!["'\w])(?!-?[012]\b)-?\b\d{2,}(?:\.\d+)?(?!["'\w])|0x[0-9a-fA-F]{4,}""",
    "long_param_list": r"(?:def|function|func)\s+\w+\s*\([^)]{80,}\)|(?:public|private|protected)\s+\w+\s+\w+\s*\([^)]{80,}\)",
    "duplicate_string": r"""(["'][^"']{10,}["'])(?:.{0,2000}?)\1""",
    "print_debug": r"(?i)\b(?:print|console\.log|System\.out\.print|fmt\.Print|var_dump|dd)\s*\(",
    "todo_fixme": r"(?i)(?:#|//|/\*)\s*(?:TODO|FIXME|XXX|HACK|BUG)\b",
    "bare_except": r"(?m)\bexcept\s*:\s*$",
    "hardcoded_path": r"""["'][A-Za-z]:\\|["']/(?:home|usr|var|etc|opt|tmp)/""",
    "commented_code": r"(?:#|//)\s*(?:if|for|def|class|return|import|function|var|let|const)\s+\w+",
}

# --- fixed values: function patterns per extractor, with the number of groups that may hold the name ---

FUNCTION_PATTERNS = {
    "Python": (r"(?m)^ *(?:async\s+)?def\s+(\w+)\s*\([^)]*\)", 1),
    "JavaScript": (r"function\s+(\w+)|(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s+)?(?:function|\([^)]*\)\s*=>)", 2),
    "TypeScript": (
        r"function\s+(\w+)|(?:const|let|var)\s+(\w+)\s*(?::\s*[^=]+)?\s*=|(\w+)\s*\([^)]*\)\s*(?::\s*\w+)?\s*\{", 3),
    "Java": (
        r"(?:public|private|protected|static|\s)+\s+\w+(?:<[^>]*>)?\s+(\w+)\s*\([^)]*\)\s*(?:throws\s+[\w,\s]+)?\s*\{", 1),
    "C": (r"(?m)^\w[\w\s\*]+\s+(\w+)\s*\([^)]*\)\s*\{", 1),
    "C++": (r"(?:[\w:]+\s+)?(\w+)\s*\([^)]*\)\s*(?:const)?\s*(?:override)?\s*\{", 1),
    "C#": (
        r"(?:public|private|protected|internal|static|async|virtual|override|\s)+\s+\w+(?:<[^>]*>)?\s+(\w+)\s*\([^)]*\)", 1),
    "PHP": (r"(?:public|private|protected|static|\s)*function\s+(\w+)\s*\([^)]*\)", 1),
    "Go": (r"func\s+(?:\([^)]*\)\s*)?(\w+)\s*\([^)]*\)", 1),
    "Rust": (r"(?:pub\s+)?(?:async\s+)?fn\s+(\w+)", 1),
    "Kotlin": (r"(?:fun|suspend\s+fun)\s+(\w+)\s*\(", 1),
    "Lua": (r"(?:local\s+)?function\s+(\w+)\s*\(|(\w+)\s*=\s*function\s*\(", 2),
}

# --- fixed values: class patterns per extractor, with the group that holds the name ---------

CLASS_PATTERNS = {
    "Python": (r"(?m)^( *)class\s+(\w+)", 2),
    "JavaScript": (r"class\s+(\w+)", 1),
    "TypeScript": (r"class\s+(\w+)", 1),
    "Java": (r"(?:public|private|protected)?\s*(?:abstract)?\s*class\s+(\w+)", 1),
    "C++": (r"class\s+(\w+)", 1),
    "C#": (r"(?:public|private|protected|internal)?\s*(?:partial|abstract|sealed)?\s*class\s+(\w+)", 1),
    "PHP": (r"class\s+(\w+)", 1),
    "Rust": (r"(?:pub\s+)?(?:struct|enum|trait)\s+(\w+)", 1),
    "Kotlin": (r"(?:class|object|interface)\s+(\w+)", 1),
}

# --- fixed values: decision keywords of a function -----------------------------------------

KEYWORDS = r"\b(?:if|else|elif|for|while|switch|case|catch|except|try|and|or|&&|\|\|)\b"
