"""Column functions on names, paths and identifiers. All run inside the JVM."""

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.schema import lookup

# ---------------------------------------------------------------- characters


def _fold_table() -> tuple[str, str]:
    """Characters whose canonical decomposition leaves one ASCII base character."""
    src, dst = [], []
    for code in range(0x80, 0xFFFF):
        ch = chr(code)
        base = "".join(
            c for c in unicodedata.normalize("NFD", ch) if not 0x300 <= ord(c) <= 0x36F
        )
        if base != ch and len(base) == 1 and ord(base) < 128:
            src.append(ch)
            dst.append(base)
    return "".join(src), "".join(dst)


FOLD_FROM, FOLD_TO = _fold_table()


def fold(col: Column) -> Column:
    """Lower case without accents; keeps one character per character."""
    return F.lower(F.translate(col, FOLD_FROM, FOLD_TO))


def mask_of_folded(name: str) -> Column:
    """Character bit set of an already folded text column, given by name.

    Bits 0-25 are letters, 26 any digit, 30 other ASCII, 31 other characters;
    spaces and combining accents set nothing. Plain `contains` tests keep the
    expression in generated code.
    """
    bit = "shiftleft(cast({} as bigint), {})"
    bits = [bit.format(f"contains({name}, '{chr(97 + i)}')", i) for i in range(26)]
    bits.append(bit.format(f"{name} rlike '[0-9]'", 26))
    bits.append(bit.format(rf"{name} rlike r'[\x00-\x1f\x21-\x2f\x3a-\x60\x7b-\x7f]'", 30))
    bits.append(bit.format(rf"{name} rlike r'[^\x00-\x7f\u0300-\u036f]'", 31))
    return F.expr(f"coalesce({' | '.join(bits)}, 0L)")


def with_mask(df: DataFrame, source: Column, out: str) -> DataFrame:
    """Add the character bit set of any text expression."""
    return df.withColumn("_low", fold(source)).withColumn(out, mask_of_folded("_low")).drop("_low")


def escape_literal(col: Column) -> Column:
    """Escape the 14 regular-expression metacharacters."""
    return F.regexp_replace(col, r"([.*+?^${}()|\[\]\\])", r"\\$1")


# --------------------------------------------------------------------- paths


def basename(col: Column) -> Column:
    return F.regexp_extract(col, r"([^/\\]*)$", 1)


def slashes(col: Column) -> Column:
    return F.translate(col, "\\", "/")


def normalize_path(col: Column, fold_case: bool = False) -> Column:
    """Collapse `.`, `..`, double and backward slashes; drop a trailing slash."""
    p = slashes(col)
    absolute = F.startswith(p, F.lit("/"))
    parts = F.filter(F.split(p, "/"), lambda s: (s != "") & (s != "."))

    def step(acc, part):
        can_pop = (F.size(acc) > 0) & (F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit("")) != "..")
        return (
            F.when(part != "..", F.concat(acc, F.array(part)))
            .when(can_pop, F.slice(acc, F.lit(1), F.size(acc) - 1))
            .when(absolute, acc)
            .otherwise(F.concat(acc, F.array(part)))
        )

    joined = F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")
    clean = F.when(absolute, F.concat(F.lit("/"), joined)).otherwise(
        F.when(joined == "", F.lit(".")).otherwise(joined)
    )
    # Most paths are clean already: only the others pay for the fold.
    out = F.when(p.rlike(r"(^|/)\.{1,2}(/|$)|//|./$|^$"), clean).otherwise(p)
    return F.lower(out) if fold_case else out


def uri_to_path(col: Column) -> Column:
    """`file://` forms to plain paths; anything else is returned as it is."""
    decoded = F.url_decode(F.replace(F.substr(col, F.lit(8)), F.lit("+"), F.lit("%2B")))
    path = F.when(decoded.rlike("^/[a-zA-Z]:"), F.substr(decoded, F.lit(2))).otherwise(decoded)
    return F.when(F.startswith(col, F.lit("file://")), normalize_path(path)).otherwise(col)


# File extension -> language.
LANGUAGE_BY_EXTENSION = {
    ".ts": "typescript",
    ".tsx": "typescriptreact",
    ".js": "javascript",
    ".jsx": "javascriptreact",
    ".cs": "csharp",
    ".py": "python",
    ".java": "java",
    ".go": "go",
    ".cpp": "cpp",
    ".cc": "cpp",
    ".cxx": "cpp",
    ".hpp": "cpp",
    ".c": "c",
    ".h": "c",
    ".rb": "ruby",
    ".php": "php",
}


def language_of(path: Column) -> Column:
    """Language of a path by its extension; '' when unknown."""
    ext = F.lower(F.regexp_extract(path, r"[^/\\](\.[^./\\]*)$", 1))
    return F.coalesce(lookup(ext, LANGUAGE_BY_EXTENSION), F.lit(""))


def combine_routes(prefix: Column, suffix: Column) -> Column:
    """Join two route parts with exactly one slash; an empty side passes the other."""
    left = F.regexp_replace(prefix, "/$", "")
    right = F.regexp_replace(suffix, "^/", "")
    return (
        F.when(F.coalesce(suffix, F.lit("")) == "", prefix)
        .when(F.coalesce(prefix, F.lit("")) == "", suffix)
        .otherwise(F.concat(left, F.lit("/"), right))
    )


def resolve_controller_token(prefix: Column, container: Column) -> Column:
    """Replace the first `[controller]` by the container name without `Controller`."""
    token = F.regexp_replace(F.coalesce(container, F.lit("")), "Controller$", "")
    at = F.instr(prefix, "[controller]")
    return F.when(at > 0, F.overlay(prefix, token, at, F.lit(12))).otherwise(prefix)


# --------------------------------------------------------------------- globs


def glob_to_regex(pattern: str) -> str:
    """Translate one glob (`**`, `*`, `?`, `[..]`, `{a,b}`) at plan time."""
    out, i, braces = [], 0, 0
    while i < len(pattern):
        if pattern.startswith("**/", i) and (i == 0 or pattern[i - 1] == "/"):
            out.append("(?:.*/)?")
            i += 3
            continue
        ch = pattern[i]
        if pattern.startswith("**", i):
            out.append(".*")
            i += 1
        elif ch == "*":
            whole = (i == 0 or pattern[i - 1] == "/") and pattern[i + 1:i + 2] in ("", "/")
            out.append("[^/]+" if whole else "[^/]*")
        elif ch == "?":
            out.append("[^/]")
        elif ch == "{":
            out.append("(?:")
            braces += 1
        elif ch == "}" and braces:
            out.append(")")
            braces -= 1
        elif ch == "," and braces:
            out.append("|")
        elif ch == "[" and "]" in pattern[i + 2:]:
            end = pattern.index("]", i + 2)
            body = pattern[i + 1:end].replace("\\", "\\\\")
            out.append("[" + ("^" + body[1:] if body[0] in "!^" else body) + "]")
            i = end
        else:
            out.append("\\" + ch if ch in ".+^$()|{}[]\\" else ch)
        i += 1
    return "".join(out)


def any_glob_regex(patterns) -> str:
    """All globs as one anchored alternation."""
    return "^(?:" + "|".join(glob_to_regex(p) for p in patterns) + ")$"


# --------------------------------------------------------- identifiers, values

# Identifier prefixes that titles leave out; at most one is removed.
TITLE_PREFIXES = ["workbench.action.", "editor.action.", "vscode."]


def id_to_title(col: Column) -> Column:
    """`workbench.action.files.saveAll` -> `Files Save All`."""
    prefixes = "|".join(p.replace(".", r"\.") for p in TITLE_PREFIXES)
    body = F.regexp_replace(col, f"^(?:{prefixes})", "")
    parts = F.filter(F.split(body, r"\."), lambda p: p != "")

    def title(part):
        spaced = F.regexp_replace(part, "(?<=[a-z])(?=[A-Z])|(?<=[^ ])(?=[A-Z][a-z])", " ")
        first = F.substr(part, F.lit(1), F.lit(1))
        head = F.when(first.rlike("[a-z]"), F.upper(first)).otherwise(first)
        return F.concat(head, F.substr(spaced, F.lit(2)))

    return F.array_join(F.transform(parts, title), " ")


def clamp_or_default(col: Column, low, high, default) -> Column:
    """Number within [low, high]; text that is no number gives the default."""
    value = col.try_cast("double")
    clamped = F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), value))
    return F.when(value.isNull() | F.isnan(value), F.lit(float(default))).otherwise(clamped)


def relative_time(elapsed_micros: Column) -> Column:
    """Age as words: just now, 5m ago, 3h ago, yesterday, 4d ago."""
    seconds = F.floor(elapsed_micros / 1_000_000)
    minutes = F.floor(seconds / 60)
    hours = F.floor(minutes / 60)
    days = F.floor(hours / 24)
    return (
        F.when(seconds < 60, F.lit("just now"))
        .when(minutes < 60, F.concat(minutes.cast("string"), F.lit("m ago")))
        .when(hours < 24, F.concat(hours.cast("string"), F.lit("h ago")))
        .when(days == 1, F.lit("yesterday"))
        .otherwise(F.concat(days.cast("string"), F.lit("d ago")))
    )


def format_duration(ms: Column) -> Column:
    """Milliseconds as text with two decimals and a fitting unit."""
    two = lambda c: F.regexp_replace(F.format_number(c, 2), ",", "")
    return (
        F.when(ms < 1, F.concat(two(ms * 1000), F.lit("μs")))
        .when(ms < 1000, F.concat(two(ms), F.lit("ms")))
        .otherwise(F.concat(two(ms / 1000), F.lit("s")))
    )


def count_label(n: Column, noun: str) -> Column:
    """`no references`, `1 reference`, `5 references`."""
    return (
        F.when(n == 0, F.lit(f"no {noun}s"))
        .when(n == 1, F.lit(f"1 {noun}"))
        .otherwise(F.concat(n.cast("string"), F.lit(f" {noun}s")))
    )
