"""Column functions on concrete request paths and route templates."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Verbs that may precede a path.
VERBS = ["GET", "POST", "PUT", "DELETE", "PATCH", "OPTIONS", "HEAD", "TRACE"]
_VERB = "(?:" + "|".join(VERBS) + ")"


def is_potential_url(col: Column) -> Column:
    """At least 2 characters and a slash, or a verb followed by a path start."""
    q = F.trim(col)
    bare = ~F.contains(q, F.lit(" ")) & F.contains(q, F.lit("/"))
    with_verb = q.rlike(f"^(?i:{_VERB}) +[/A-Za-z0-9_]")
    return F.coalesce((F.length(q) >= 2) & (bare | with_verb), F.lit(False))


def _strip_slashes(col: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(col, "/$", ""), "^/", "")


def path_verb(col: Column) -> Column:
    """Verb in front of a concrete path, upper case, or NULL."""
    verb = F.regexp_extract(F.trim(col), f"^(?i)({_VERB}) .", 1)
    return F.when(verb != "", F.upper(verb))


def clean_path(col: Column) -> Column:
    """Concrete path without verb, outer spaces and one slash at each end."""
    rest = F.regexp_replace(F.trim(col), f"^(?i:{_VERB}) (?=.)", "")
    return _strip_slashes(F.trim(rest))


def segments(clean: Column) -> Column:
    empty = F.array().cast("array<string>")
    return F.when(F.coalesce(clean, F.lit("")) == "", empty).otherwise(F.split(clean, "/"))


def template_verb(col: Column) -> Column:
    """Upper-case verb of `[VERB] route`, or NULL."""
    verb = F.regexp_extract(F.trim(col), r"^\[([A-Z]+)\]", 1)
    return F.when(verb != "", verb)


def clean_template(col: Column) -> Column:
    """Template without its verb and without one slash at each end."""
    rest = F.regexp_replace(F.trim(col), r"^\[[A-Z]+\] *", "")
    return _strip_slashes(F.trim(rest))


def is_parameter(segment: Column) -> Column:
    return (F.length(segment) >= 2) & F.startswith(segment, F.lit("{")) & F.endswith(segment, F.lit("}"))


def template_regex(clean: Column) -> Column:
    """Anchored, case-insensitive regular expression of a cleaned template.

    Everything outside braces is quoted; `{x}` is one segment, `{*x}` the rest.
    """
    quoted = F.regexp_replace(clean, r"([.*+?^${}()|\[\]\\])", r"\\$1")
    # Braces were escaped too: recognise the escaped form of a parameter.
    rest = F.regexp_replace(quoted, r"\\\{\\\*[^}]*?\}", "(.*)")
    one = F.regexp_replace(rest, r"\\\{[^}]*?\}", "([^/]+)")
    return F.concat(F.lit("(?i)^"), one, F.lit("$"))


def has_catch_all(clean: Column) -> Column:
    return clean.rlike(r"\{\*[^}]*\}")


def regex_score(path_segments: Column, is_param: Column) -> Column:
    """Score of a full template hit: 2 plus 0.1 per literal segment."""
    count = F.least(F.size(path_segments), F.size(is_param))
    literals = F.size(F.filter(F.slice(is_param, F.lit(1), count), lambda p: ~p))
    return F.lit(2.0) + F.lit(0.1) * literals


def verb_bonus(query_verb: Column, item_verb: Column) -> Column:
    """0.5 for compatible verbs, 0 when one is missing, NULL on a clash."""
    return (
        F.when(query_verb.isNull() | item_verb.isNull(), F.lit(0.0))
        .when(F.startswith(item_verb, query_verb) | F.startswith(query_verb, item_verb), F.lit(0.5))
    )
