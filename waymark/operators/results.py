"""Result rows as clients show them."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.schema import lookup

# Item type -> kind word of the compact client; others are `Symbol`.
CLIENT_KINDS = {
    "file": "File",
    "class": "Class",
    "interface": "Interface",
    "enum": "Enum",
    "method": "Method",
    "function": "Function",
    "property": "Property",
    "field": "Field",
    "variable": "Variable",
    "text": "Text",
    "endpoint": "Endpoint",
    "command": "Command",
    "struct": "Struct",
    "namespace": "Namespace",
    "event": "Event",
    "delegate": "Delegate",
    "constructor": "Constructor",
}

# Item type -> symbol kind of the editor protocol (1-based).
PROTOCOL_KINDS = {
    "file": 1,
    "class": 5,
    "method": 6,
    "property": 7,
    "enum": 10,
    "interface": 11,
    "function": 12,
    "variable": 13,
}
OTHER_KIND = 19


def client_rows(results: DataFrame) -> DataFrame:
    """1-based line, integer score, display kind and a unique key."""
    kind = F.coalesce(lookup(F.lower("type"), CLIENT_KINDS), F.lit("Symbol"))
    rows = results.select(
        "qid",
        "name",
        kind.alias("kind"),
        "file_path",
        (F.coalesce("line", F.lit(0)) + 1).alias("line"),
        F.col("container").alias("container_name"),
        (F.col("score") * 10000).cast("int").alias("score"),
    )
    key = F.concat_ws(":", "file_path", F.col("line").cast("string"), "name", "kind")
    return rows.withColumn("unique_key", key)


def symbol_locations(results: DataFrame) -> DataFrame:
    """Protocol kind and range; the range ends after the name."""
    line, col = F.coalesce("line", F.lit(0)), F.coalesce("col", F.lit(0))
    return results.select(
        "qid",
        "id",
        "name",
        F.coalesce(lookup(F.col("type"), PROTOCOL_KINDS), F.lit(OTHER_KIND)).alias("kind"),
        F.concat(F.lit("file://"), F.col("file_path")).alias("uri"),
        line.alias("line"),
        col.alias("start_col"),
        (col + F.length("name")).alias("end_col"),
        F.col("container").alias("container_name"),
    )


def display_rows(results: DataFrame) -> DataFrame:
    """Label, description and detail of a result list, and the reference text."""
    command = F.col("type") == "command"
    container = F.when(F.col("container") != "", F.col("container"))
    detail = F.when(F.col("detail") != "", F.col("detail"))
    path = F.coalesce("relative_path", "file_path")
    place = F.when(F.col("line").isNull(), path).otherwise(
        F.concat(path, F.lit(":"), (F.col("line") + 1).cast("string"))
    )
    return results.select(
        "qid",
        "id",
        F.col("name").alias("label"),
        F.when(command, F.concat_ws("", container))
        .otherwise(F.concat_ws(" - ", container, detail))
        .alias("description"),
        F.when(command, F.coalesce(detail, F.lit(""))).otherwise(place).alias("detail"),
        F.concat_ws(".", container, "name").alias("reference"),
    )


def needed_lines(results: DataFrame, docs: DataFrame) -> DataFrame:
    """The lines `(file_path, line, text)` of `docs(file_path, text)` that results point to.

    The lines wanted of each file are gathered first and meet the texts by file, so texts
    of other files are neither parted nor moved, and only wanted lines leave a text.
    """
    wanted = results.select("file_path", "line").filter("line >= 0").distinct()
    wanted = wanted.groupBy("file_path").agg(F.collect_list("line").alias("_wanted"))
    met = docs.select("file_path", "text").join(wanted, "file_path").select("file_path", "_wanted", F.split("text", "\n").alias("_all"))
    there = F.filter("_wanted", lambda i: i < F.size("_all"))
    return met.select("file_path", F.inline(F.transform(there, lambda i: F.struct(i.alias("line"), F.get("_all", i).alias("text")))))


def source_lines(results: DataFrame, source: DataFrame) -> DataFrame:
    """Results joined with the text of their line, from `source(file_path, line, text)` or documents `(file_path, text)`."""
    lines = source if "line" in source.columns else needed_lines(results, source)
    return results.join(lines, ["file_path", "line"])


def project_highlights(with_text: DataFrame) -> DataFrame:
    """Name-relative highlights as column ranges of the source line.

    Clamped to the line; empty ranges and lines without the name are dropped.
    """
    ranges = F.expr(
        """filter(transform(highlights, h -> named_struct(
             'start', least(instr(text, name) - 1 + h.start, length(text)),
             'end', least(instr(text, name) - 1 + h.end, length(text)))), r -> r.start < r.end)"""
    )
    found = with_text.filter(F.expr("instr(text, name) > 0"))
    return found.withColumn("ranges", ranges).withColumn("range", F.explode("ranges")).drop("ranges")


def locate_symbol(with_text: DataFrame) -> DataFrame:
    """Column range of a name in its line: exact, trimmed, any case, stored."""
    at = F.expr(
        """coalesce(nullif(instr(text, name), 0), nullif(instr(text, trim(name)), 0),
             nullif(instr(lower(text), lower(trim(name))), 0), col + 1) - 1"""
    )
    found = with_text.filter("name <> ''").withColumn("_at", at).filter("_at >= 0")
    return (
        found.withColumn("start_col", F.least(F.col("_at"), F.length("text")))
        .withColumn("end_col", F.least(F.col("start_col") + F.length("name"), F.length("text")))
        .drop("_at")
    )
