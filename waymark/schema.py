"""Fixed values and table schemas shared by all operators.

The tables in this module are fixed values: results depend on them.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Item type, type id, ranking boost, search scope.
ITEM_TYPES = [
    ("file", 1, 0.9, "files"),
    ("class", 2, 1.5, "types"),
    ("interface", 3, 1.35, "types"),
    ("enum", 4, 1.3, "types"),
    ("function", 5, 1.25, "symbols"),
    ("method", 6, 1.25, "symbols"),
    ("property", 7, 1.1, "properties"),
    ("variable", 8, 1.0, "properties"),
    ("text", 9, 0.7, "text"),
    ("command", 10, 1.2, "commands"),
    ("endpoint", 11, 1.4, "endpoints"),
]

# Scopes searched first, in this order, by the fast search.
FAST_SCOPE_ORDER = ["types", "symbols", "endpoints", "files"]

# Symbol kind codes of the editor protocol (0-based) -> item type.
SYMBOL_KIND_TYPES = {
    4: "class",
    5: "method",
    6: "property",
    7: "property",
    9: "enum",
    10: "interface",
    11: "function",
    12: "variable",
    13: "variable",
}

# Scores and limits.
MIN_SCORE = 0.01
NAME_GOOD_ENOUGH = 0.9
FULL_NAME_WEIGHT = 0.9
PATH_GATE = 0.8
PATH_WEIGHT = 0.8
ACTIVITY_WEIGHT = 0.3
ACTIVITY_FLOOR = 0.05
DEFAULT_RESULTS = 20
DEFAULT_FAST_RESULTS = 10
MAX_FILE_BYTES = 20 * 1024 * 1024
MAX_LINE_CHARS = 10000
RETENTION_DAYS = 30
CALL_DEPTH = 4

ITEM_COLUMNS = [
    ("seq", "bigint"),
    ("id", "string"),
    ("name", "string"),
    ("type", "string"),
    ("file_path", "string"),
    ("relative_path", "string"),
    ("line", "int"),
    ("col", "int"),
    ("container", "string"),
    ("full_name", "string"),
    ("detail", "string"),
    ("command_id", "string"),
    ("size", "bigint"),
]

ITEM_DDL = ", ".join(f"{name} {dtype}" for name, dtype in ITEM_COLUMNS)


def _literal(value) -> str:
    return "'" + value.replace("'", "\\'") + "'" if isinstance(value, str) else repr(value)


def lookup(col: Column, mapping: dict) -> Column:
    """Value of a small fixed dimension, NULL for unknown keys: no join needed."""
    pairs = ", ".join(
        f"{_literal(k)}, {_literal(v)}{'D' if isinstance(v, float) else ''}" for k, v in mapping.items()
    )
    return F.expr(f"map({pairs})")[col]


def scope_of(item_type: Column) -> Column:
    """Scope of an item type; unknown types belong to `everything`."""
    return F.coalesce(lookup(item_type, {t: s for t, _, _, s in ITEM_TYPES}), F.lit("everything"))


def boost_of(item_type: Column) -> Column:
    """Ranking boost of an item type; unknown types are not boosted."""
    return F.coalesce(lookup(item_type, {t: b for t, _, b, _ in ITEM_TYPES}), F.lit(1.0))


def conform_items(df):
    """Project to the item schema, filling columns the producer does not know."""
    have = set(df.columns)
    return df.select(
        *[
            (F.col(n) if n in have else F.lit(None)).cast(t).alias(n)
            for n, t in ITEM_COLUMNS
        ]
    )
