"""Code, comments and strings of source texts, line by line.

What a line means depends on what is open where it starts: nothing, a comment or a string
over several lines, brackets. For each line its effect is computed for itself, as a map
from the state before it to the state after it and as the brackets it closes and opens.
Effects compose, so the states before all lines come from chunks: each chunk's lines
compose to one effect, the chunks' effects give the state before each chunk, and these the
state before each line. All of it happens in the row that holds the text; no shuffle.
"""

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK = 64


class Lexis(NamedTuple):
    """How a language writes what is not code.

    `pieces` takes a line apart: a comment, a string, a run of code or one character.
    `aside` tells the first two by their start, `comment` the first. `spans` are what may
    stay open at the end of a line, as (start, end).
    """

    pieces: str
    aside: str
    comment: str
    spans: tuple[tuple[str, str], ...]
    brackets: str = "("
    escapes: str = r"\\."


_BLOCK, _SLASHES = r"/\*.*?(?:\*/|$)", r"//.*"
_DOUBLE, _SINGLE = '"[^"]*"?', "'[^']*'?"


def _c_like(*strings: str, other: str, spans: tuple = (), hash_: str = "", **more) -> Lexis:
    pieces = "|".join(["(?s)" + _BLOCK, _SLASHES, *([hash_] if hash_ else []), *strings, _DOUBLE, _SINGLE, f"[^{other}]+", "."])
    comment = r"^(?:/[/*]" + (f"|{hash_[: -len('.*')]}" if hash_ else "") + ")"
    return Lexis(pieces, rf"{comment}|^[\"'`]|^@\$?\"", comment, (("/*", "*/"), *spans), **more)


_JS = _c_like("`[^`]*`?", other="/\"'`", spans=(("`", "`"),))
_TEXT_BLOCK = '""".*?(?:"""|$)'
LANGUAGES = {
    "typescript": _JS,
    "typescriptreact": _JS,
    "javascript": _JS,
    "javascriptreact": _JS,
    # A quote is doubled in a verbatim string, where a backslash is none of its own.
    "csharp": _c_like(
        _TEXT_BLOCK, r'@\$?"[^"]*"?', other="/\"'@", spans=(('"""', '"""'), ('@"', '"')), brackets="([",
        escapes=r'(?<!")""(?!")|\\(?<!@"[^"]{0,200}).',
    ),
    "java": _c_like(_TEXT_BLOCK, other="/\"'", spans=(('"""', '"""'),)),
    "c": _c_like(other="/\"'"),
    "cpp": _c_like(other="/\"'"),
    "go": _c_like("`[^`]*`?", other="/\"'`", spans=(("`", "`"),)),
    "php": _c_like(other="/\"'#", hash_=r"#(?!\[).*"),
    "python": Lexis(
        "(?s)" + _TEXT_BLOCK + "|'''.*?(?:'''|$)|#.*|" + _DOUBLE + "|" + _SINGLE + "|[^\"'#]+|.",
        "^[\"'#]", "^#", (('"""', '"""'), ("'''", "'''")), "",
    ),
    "ruby": Lexis("(?s)=begin.*?(?:=end|$)|#.*|`[^`]*`?|" + _DOUBLE + "|" + _SINGLE + "|[^\"'`#=]+|.", "^(?:[\"'`#]|=begin)", "^(?:#|=begin)", (("=begin", "=end"),), ""),
    "html": Lexis("(?s)<!--.*?(?:-->|$)|[^<]+|.", "^<!--", "^<!--", (("<!--", "-->"),), "", r"(?!)"),
}


def _by_language(value: Callable[[Lexis], Column]) -> Column:
    pairs = [x for name, lexis in LANGUAGES.items() for x in (F.lit(name), value(lexis))]
    return F.create_map(*pairs)[F.col("language")]


def before_each(values: Column, zero: Column, kind: str, combine: Callable[[Column, Column], Column], width: int = CHUNK) -> Column:
    """What the values before each place of a non-empty array combine to.

    `combine` must be associative and `zero` change nothing. Work is linear in the length,
    but for a list of the chunks' values that grows by one for each chunk.
    """
    starts = F.sequence(F.lit(0), F.size(values) - 1, F.lit(width))
    none = F.array().cast(f"array<{kind}>")

    def running(part: Column, first: Column) -> Column:
        return F.aggregate(
            part, F.struct(first.alias("v"), none.alias("all")),
            lambda s, x: F.struct(combine(s["v"], x).alias("v"), F.concat(s["all"], F.array(s["v"])).alias("all")),
            lambda s: s["all"],
        )

    whole = F.transform(starts, lambda i: F.aggregate(F.slice(values, i + 1, width), zero, combine))
    heads = running(whole, zero)
    zipped = F.arrays_zip(starts.alias("at"), heads.alias("head"))
    return F.flatten(F.transform(zipped, lambda z: running(F.slice(values, z["at"] + 1, width), z["head"])))


def _open_after(pieces: Column, spans: Column) -> Column:
    """Number of the span that the last piece of a line leaves open, 0 for none."""
    last = F.element_at(pieces, -1)

    def left_open(s: Column) -> Column:
        rest = F.substr(last, F.length(s["start"]) + 1)
        return F.startswith(last, s["start"]) & ~(F.endswith(rest, s["end"]))

    hit = F.filter(F.transform(spans, lambda s, i: F.when(left_open(s), i + 1)), lambda k: k.isNotNull())
    return F.coalesce(F.get(hit, F.lit(0)), F.lit(0))


def _line_brackets(code: Column) -> Column:
    """Brackets that a line closes from before, and those it leaves open."""
    signs = F.regexp_replace(code, r"[^(){}\[\]]", "")
    return F.when(signs == "", F.struct(F.lit(0).alias("pops"), F.lit("").alias("opens"))).otherwise(
        F.aggregate(
            F.filter(F.split(signs, ""), lambda c: c != ""),
            F.struct(F.lit(0).alias("pops"), F.lit("").alias("opens")),
            lambda s, c: F.when(c.isin("(", "[", "{"), F.struct(s["pops"].alias("pops"), F.concat(s["opens"], c).alias("opens")))
            .when(s["opens"] == "", F.struct((s["pops"] + 1).alias("pops"), s["opens"].alias("opens")))
            .otherwise(F.struct(s["pops"].alias("pops"), F.substring(s["opens"], F.lit(1), F.length(s["opens"]) - 1).alias("opens"))),
        )
    )


def _then_brackets(a: Column, b: Column) -> Column:
    left = F.length(a["opens"]) - b["pops"]
    return F.struct(
        (a["pops"] + F.greatest(F.lit(0), -left)).alias("pops"),
        F.concat(F.substring(a["opens"], F.lit(1), F.greatest(F.lit(0), left)), b["opens"]).alias("opens"),
    )


def code_lines(docs: DataFrame, *keep: str) -> DataFrame:
    """Logical lines of `docs(language, text)` with the columns `keep`.

    Rows `(*keep, language, line, raw, code, kept, depth)`: the 0-based first line and its
    raw text; the line without strings and comments (`code`) and without comments (`kept`),
    blanks in their place, so that columns stay; and the braces open before it. A line that
    starts inside a parenthesis (C#: or an attribute's bracket) goes on with the one before;
    `code` and `kept` hold all of them. Languages unknown here are taken as code throughout.
    """
    spans = _by_language(lambda x: F.array(*[F.struct(F.lit(s).alias("start"), F.lit(e).alias("end")) for s, e in x.spans]))
    known = docs.select(
        *keep, "language", F.split("text", "\n").alias("_raw"),
        _by_language(lambda x: F.lit(x.pieces)).alias("_pieces"), _by_language(lambda x: F.lit(x.aside)).alias("_aside"),
        _by_language(lambda x: F.lit(x.comment)).alias("_comment"), F.coalesce(_by_language(lambda x: F.lit(x.brackets)), F.lit("")).alias("_brackets"),
        _by_language(lambda x: F.lit(x.escapes)).alias("_escapes"), spans.alias("_spans"),
    )
    # An escaped character ends nothing.
    plain = F.coalesce(F.transform("_raw", lambda t: F.when(F.contains(t, F.lit("\\")) | F.contains(t, F.lit('""')), F.regexp_replace(t, F.col("_escapes"), F.lit("__"))).otherwise(t)), F.col("_raw"))
    bare = known.withColumn("_plain", plain)
    same = F.sequence(F.lit(0), F.size("_spans"))

    def effect(line: Column) -> Column:
        """State after the line for each state before it."""
        starts = F.concat(F.array(F.lit("")), F.col("_spans.start"))
        return F.transform(starts, lambda s: _open_after(F.regexp_extract_all(F.concat(s, line), F.col("_pieces"), F.lit(0)), F.col("_spans")))

    # Only lines with a start or an end of a span change the state.
    touched = F.transform("_plain", lambda t: F.exists("_spans", lambda s: F.contains(t, s["start"]) | F.contains(t, s["end"])))
    marked = bare.withColumn("_touched", touched).withColumn("_any", F.exists("_touched", lambda x: x))
    effects = F.transform(F.arrays_zip("_plain", "_touched"), lambda z: F.when(z["_touched"], effect(z["_plain"])).otherwise(same))
    marked = marked.withColumn("_effects", F.when(F.col("_any"), effects))
    composed = before_each(F.col("_effects"), same, "array<int>", lambda a, b: F.transform(a, lambda s: F.get(b, s)))
    states = F.when(F.col("_any"), F.transform(composed, lambda m: F.get(m, F.lit(0)))).otherwise(F.array_repeat(F.lit(0), F.size("_raw")))
    marked = marked.withColumn("_states", states)

    def taken_apart(z: Column) -> Column:
        start = F.when(z["_states"] > 0, F.get(F.col("_spans"), z["_states"] - 1)["start"]).otherwise(F.lit(""))
        pieces = F.regexp_extract_all(F.concat(start, z["_plain"]), F.col("_pieces"), F.lit(0))

        def shown(test: str) -> Column:
            blank = F.transform(pieces, lambda p: F.when(F.regexp_like(p, F.col(test)), F.repeat(F.lit(" "), F.length(p))).otherwise(p))
            return F.substr(F.array_join(blank, ""), F.length(start) + 1)

        return F.struct(shown("_aside").alias("code"), shown("_comment").alias("kept"))

    whole = F.transform(
        F.arrays_zip("_raw", "_plain", "_states"),
        lambda z: F.when(F.col("_pieces").isNotNull() & ((z["_states"] > 0) | z["_plain"].rlike("[\"'`#/<=]")), taken_apart(z)).otherwise(
            F.struct(z["_raw"].alias("code"), z["_raw"].alias("kept"))
        ),
    )
    parted = marked.withColumn("_lines", whole)
    zero = F.struct(F.lit(0).alias("pops"), F.lit("").alias("opens"))
    signs = F.when((F.col("_brackets") != "") | F.exists("_lines", lambda x: x["code"].rlike("[{}]")), F.transform("_lines", lambda x: _line_brackets(x["code"])))
    parted = parted.withColumn("_signs", signs)
    opened = before_each(F.col("_signs"), zero, "struct<pops:int,opens:string>", _then_brackets)
    opens = F.when(F.col("_signs").isNotNull(), F.transform(opened, lambda s: s["opens"])).otherwise(F.array_repeat(F.lit(""), F.size("_raw")))
    parted = parted.withColumn("_open", opens)
    goes_on = F.transform("_open", lambda o: (o != "") & F.contains(F.col("_brackets"), F.substring(o, F.length(o), F.lit(1))))
    places = F.filter(F.transform(goes_on, lambda on, i: F.when(~on, i)), lambda i: i.isNotNull())
    parted = parted.withColumn("_starts", places)

    def logical(at: Column, k: Column) -> Column:
        count = F.coalesce(F.get(F.col("_starts"), k + 1), F.size("_raw")) - at
        first = F.get(F.col("_open"), at)

        def joined(name: str) -> Column:
            one = F.get(F.col("_lines"), at)[name]
            return F.when(count == 1, one).otherwise(F.array_join(F.transform(F.slice("_lines", at + 1, count), lambda x: x[name]), " "))

        return F.struct(
            at.alias("line"), F.get(F.col("_raw"), at).alias("raw"), joined("code").alias("code"), joined("kept").alias("kept"),
            (F.length(first) - F.length(F.regexp_replace(first, r"\{", ""))).cast("bigint").alias("depth"),
        )

    return parted.select(*keep, "language", F.inline(F.transform("_starts", logical)))
